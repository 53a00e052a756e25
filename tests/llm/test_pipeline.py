"""The corpus pipeline on a small table."""

from __future__ import annotations

import corpus_pipeline

from lumenfold.llm.common import cut

from .fixtures import documents, empty, rows


def test_stages_keep_columns_and_take_effect(spark, tmp_path):
    bench = spark.createDataFrame([("1", "nothing that occurs anywhere in these texts but here and now okay")], "item_id string, text string")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([r[:5] for r in rows()], "doc_id long, text string, lang string, source string, n_chars long")
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
            out.write.parquet(f"{tmp_path}/{name}")
            docs = spark.read.parquet(f"{tmp_path}/{name}")
            counts.append(docs.count())
    assert counts == sorted(counts, reverse=True) and counts[0] > counts[1] > counts[2] == counts[3] > counts[4] > 0
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and out.count() == counts[-1]


def test_run_equals_its_stages_on_sf_tables(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    assert out and sorted(r["start"] for r in out)[0] == 0
    total = sum(r["n_tokens"] for r in out)
    assert max(r["start"] + r["n_tokens"] for r in out) == total


def stages_of(spark, docs, folder):
    """What each stage makes of its predecessor's rows, in order."""
    out = []
    for name, stage in corpus_pipeline.STAGES:
        found = stage(spark, docs, folder)
        out.append(found)
        docs = cut(found.toDF(*[f"c{i}" for i in range(len(found.columns))]), name).toDF(*found.columns)
    return out


def benchmark(spark, tmp_path):
    rows = [("1", "nothing that occurs anywhere in these texts but here and now okay"), ("2", None), ("3", ""), ("1", "a short item")]
    spark.createDataFrame(rows, "item_id string, text string").write.mode("overwrite").parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_awkward_rows_and_clashing_names(spark, tmp_path):
    """Nulls, empty and very long texts, repeated rows, null ids, columns that differ in case only: each stage keeps all columns as they are."""
    docs = documents(spark)
    *filters, tokens = stages_of(spark, docs, benchmark(spark, tmp_path))
    for found in filters:
        assert found.columns == docs.columns
    known, unique, clean, mixed = (f.toDF("doc_id", "text", *[f"x{i}" for i in range(6)]).select("doc_id", "text", "x3").collect() for f in filters)
    assert all(r["text"] and any(c.isalpha() for c in r["text"]) and r["x3"] == "clash" for r in known)
    # of repeated rows one stays, and of a document and its near copy the one with the smaller id
    ids = [r["doc_id"] for r in unique]
    assert len(ids) == len(set(ids)) and 8 in ids and not {9, 10, 11} & set(ids)
    assert sorted(map(str, unique)) == sorted(map(str, clean)) and set(map(str, mixed)) <= set(map(str, clean))
    assert tokens.count() == len(mixed)


def test_empty_tables(spark, tmp_path):
    for found in stages_of(spark, empty(spark), benchmark(spark, tmp_path)):
        assert found.count() == 0


def test_rows_of_nulls(spark, tmp_path):
    docs = spark.createDataFrame([(None,) * 5] * 3 + [(1, "some words in a row that is labelled", "en", None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    known = stages_of(spark, docs, benchmark(spark, tmp_path))[0].collect()
    assert all(r["doc_id"] == 1 for r in known)
