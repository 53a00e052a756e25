"""Sharding, token output, mixing, near-duplicates, scoring, repeated substrings."""

from __future__ import annotations

import hashlib
import math
import random
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfold.llm import induced, katz, minhash, mixing, repeats, sharding, simple8b, tokens
from lumenfold.llm.words import mixed

from .fixtures import documents, empty, rows


@pytest.mark.parametrize("block_rows", [8192, 5])
def test_shards_are_exact_and_repeatable(spark, block_rows):
    one = sharding.shard(documents(spark), shards=7, block_rows=block_rows).collect()
    two = sharding.shard(documents(spark, partitions=5), shards=7, block_rows=block_rows).collect()
    assert sorted(map(str, one)) == sorted(map(str, two))
    n = len(rows())
    sizes = Counter(r["shard"] for r in one)
    assert len(one) == n and all(sizes[s] in (n // 7, n // 7 + 1) for s in range(7))
    for s in range(7):
        assert sorted(r["slot"] for r in one if r["shard"] == s) == list(range(sizes[s]))
    raw = Counter((r[0], len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in rows())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in one) == raw
    assert sharding.shard(empty(spark)).count() == 0


def test_shards_are_uniform(spark):
    """Over seeds, rows fall into each shard alike, and so do pairs of rows of one block."""
    docs = spark.range(60).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    first, both = Counter(), 0
    for seed in range(20):
        got = {r["doc_id"]: r["shard"] for r in sharding.shard(docs, shards=3, seed=seed, block_rows=10).collect()}
        first[got[0]] += 1
        both += got[0] == got[1]
    assert all(1 <= first[s] <= 15 for s in range(3)) and 1 <= both <= 15


def test_equal_rows_are_shuffled_like_others(spark):
    """Chi-square of the shards of 4,800 equal rows among 20,000, and of where in their shard they are; a draw of plain numpy has the same spread."""
    docs = spark.range(20_000).select(F.when(F.col("id") % 25 >= 6, F.col("id")).alias("doc_id"), F.when(F.col("id") % 25 >= 6, F.concat(F.lit("t"), F.col("id"))).otherwise(F.lit("one text")).alias("text"))
    out = [tuple(r) for r in sharding.shard(docs, block_rows=500).where("doc_id is null").select("shard", "slot").collect()]
    again = [tuple(r) for r in sharding.shard(docs.repartition(3), block_rows=500).where("doc_id is null").select("shard", "slot").collect()]
    assert len(set(out)) == 4800 and sorted(out) == sorted(again)
    size = 20_000 / 24
    # one degree of freedom fewer than cells, less the finite population's share: bounds are some five standard deviations
    square = lambda counts: sum((c - 200) ** 2 / (200 * (1 - 0.24)) for c in counts)
    assert square(Counter(s for s, _ in out).get(i, 0) for i in range(24)) < 23 + 5 * math.sqrt(2 * 23)
    assert square(Counter(int(slot * 24 / (size + 1)) for _, slot in out).get(i, 0) for i in range(24)) < 23 + 5 * math.sqrt(2 * 23)
    plain = np.random.default_rng(1).permutation(20_000)[:4800]
    assert square(Counter((plain // size).astype(int).tolist()).get(i, 0) for i in range(24)) < 23 + 5 * math.sqrt(2 * 23)


def test_matrix_has_hypergeometric_moments(spark):
    sizes = spark.createDataFrame([(0, 30), (1, 50), (2, 20)], "block int, n long")
    draws = []
    for seed in range(20):
        ends = {r["block"]: r["ends"] for r in sharding.communication_matrix(sizes, 3, 4, seed).collect()}
        cells = np.array([np.diff([0, *ends[b]]) for b in range(3)])
        assert (cells >= 0).all() and cells.sum(axis=1).tolist() == [30, 50, 20] and cells.sum(axis=0).tolist() == [25] * 4
        draws.append(cells)
    mean = np.mean(draws, axis=0)
    assert np.abs(mean - np.outer([30, 50, 20], [0.25] * 4)).max() < 2.4


def test_sharding_is_native(spark):
    plan = sharding.shard(documents(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("n", [0, 1, 5, 1023, 1024, 1025, 4000])
@pytest.mark.parametrize("high", [1, 2, 300, 50_000, 1 << 33, (1 << 64) - 1])
def test_simple8b_round_trip(n, high):
    ids = np.random.default_rng(n).integers(0, high, n, dtype=np.uint64)
    words, offsets = simple8b.encode(ids)
    assert (simple8b.decode(words, offsets, n) == ids).all()
    for b in range(len(offsets) - 1):  # any block by itself
        part = words[offsets[b] : offsets[b + 1]]
        own = ids[b * simple8b.BLOCK : (b + 1) * simple8b.BLOCK]
        assert (simple8b.decode(part, np.array([0, len(part)]), len(own)) == own).all()


def test_token_files(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(tokens.tokenizer_json())
    out = tokens.token_output(documents(spark)).collect()
    order = sorted(rows(), key=lambda r: (r[0] is None, r[0] or 0))
    encoded = {}
    for r in order:
        ids = [*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 1]
        encoded.setdefault(r[0], []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    found = sorted(out, key=lambda r: r["start"])
    at = 0
    for r, e in zip(found, order, strict=True):
        assert r["start"] == at and r["doc_id"] == e[0]
        encoded[r["doc_id"]].remove((r["n_tokens"], r["ids_crc32"]))
        at += r["n_tokens"]
    assert tokens.token_output(empty(spark)).count() == 0


def test_words_encode_like_whole_texts():
    encoder = tokens.WordTokenizer(tokens.tokenizer_json())
    texts = ["<|endoftext|> a<|startoftext|>b it's DON'T l'été", "ΣΑΣ ΟΔΟΣ. İstanbul é\ńx y\x85z \x1c q", "日本語 12３4 Ⅷ ﬁ", "", "  \x0b\x0c ", "semi;colon,stop. ##x |y| ñÑ ŸÿŒœ µ ªº × ÷"]
    ids, counts = encoder.encode_all(texts)
    parts = np.split(ids, np.cumsum(counts)[:-1])
    for t, p in zip(texts, parts, strict=True):
        assert p.tolist() == encoder.tokenizer.encode(t, add_special_tokens=False).ids


def mixable(spark):
    import random

    rng = random.Random(2)
    out = [(i, "word " * rng.randint(1, 300), rng.choice(["en", "en", "de"]), "hot" if i % 3 == 0 else f"s{i % 4}") for i in range(1500)]
    return spark.createDataFrame(out, "doc_id long, text string, lang string, source string")


def test_raking_meets_its_marginals(spark):
    docs = mixable(spark)
    goals = {"lang": {"en": 0.5, "de": 0.5}, "source": {"hot": 0.2, "s0": 0.2, "s1": 0.2, "s2": 0.2, "s3": 0.2}}
    out = mixing.mix(docs, goals, kept_share=0.3).toPandas()
    cells = out.drop_duplicates(["source", "lang", "topic"])
    assert abs(cells.weight.sum() - 1) < 1e-6
    for margin, goal in goals.items():
        sums = cells.groupby(margin).weight.sum()
        assert all(abs(sums[k] - v) < 1e-3 for k, v in goal.items())
        kept = out[out.sampled].groupby(margin).n_tokens.sum() / out[out.sampled].n_tokens.sum()
        assert all(abs(kept[k] - v) < 0.08 for k, v in goal.items())
    assert abs((out.probability * out.n_tokens).sum() / out.n_tokens.sum() - 0.3) < 1e-3
    assert abs(out[out.sampled].n_tokens.sum() / out.n_tokens.sum() - 0.3) < 0.05


def plain_raking(cells: dict, goals: list[dict]) -> dict:
    """Proportional fitting by dictionaries, to its end."""
    weight = {c: float(n) for c, n in cells.items()}
    for _ in range(400):
        for m, goal in enumerate(goals):
            sums = Counter()
            for c, w in weight.items():
                sums[c[m]] += w
            weight = {c: w * goal.get(c[m], 0.0) / sums[c[m]] if sums[c[m]] else 0.0 for c, w in weight.items()}
    return weight


def test_raking_against_a_second_form(spark):
    rng = random.Random(3)
    cells = {(s, g, t): rng.randint(1, 500) for s in ("a", "b", "c") for g in ("en", "de") for t in ("x", "y") if (s, g, t) != ("a", "de", "y")}
    goals = [{"a": 0.2, "b": 0.5, "c": 0.3}, {"en": 0.6, "de": 0.4}, {"x": 0.55, "y": 0.45}]
    df = spark.createDataFrame([(*c, n) for c, n in cells.items()], "source string, lang string, topic string, tokens long")
    found = {(r["source"], r["lang"], r["topic"]): r["weight"] for r in mixing.raked(df, dict(zip(mixing.MARGINS, goals, strict=True)), tolerance=1e-5).collect()}
    want = plain_raking(cells, goals)
    assert set(found) == set(want) and all(abs(found[c] - want[c]) < 1e-4 for c in want)


def test_targets_that_cannot_be_met_are_refused(spark):
    df = spark.createDataFrame([("a", "en", "x", 10), ("b", "de", "x", 10)], "source string, lang string, topic string, tokens long")
    with pytest.raises(ValueError, match="not met after 1 sweeps"):
        mixing.raked(df, {"source": {"a": 0.9, "b": 0.1}, "lang": {"en": 0.1, "de": 0.9}}, sweeps=1)
    with pytest.raises(ValueError, match="no tokens for targets of source: c"):
        mixing.raked(df, {"source": {"a": 0.5, "c": 0.5}})
    with pytest.raises(ValueError, match="zero or more"):
        mixing.raked(df, {"source": {"a": -1.0}})


def test_topics_of_the_caller(spark):
    docs = spark.createDataFrame([(i, "word " * 30, "en", "s", ("law", "art", None)[i % 3]) for i in range(30)], "doc_id long, text string, lang string, source string, about string")
    out = mixing.mix(docs, {"topic": {"law": 0.5, "art": 0.3, "(none)": 0.2}}, topics="about").toPandas()
    assert out.drop_duplicates("topic").set_index("topic").weight.round(6).to_dict() == {"law": 0.5, "art": 0.3, "(none)": 0.2}


def test_mixing_of_awkward_rows(spark):
    out = mixing.mix(documents(spark)).collect()
    assert len(out) == len(rows()) and all(0 <= r["probability"] <= 1 for r in out)
    assert {r["source"] for r in out} == {"(none)", "s0", "s1", "s2"}
    kept = mixing.sampled(documents(spark))
    assert kept.columns == documents(spark).columns
    assert sorted(str(r[0]) for r in kept.collect()) == sorted(str(r["doc_id"]) for r in out if r["sampled"])
    assert mixing.mix(empty(spark)).count() == 0
    plan = mixing.mix(documents(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def shingles(text: str | None, k: int) -> frozenset:
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if len(words) >= k else frozenset([tuple(words)] if words else [])


def linked_components(pairs: list[tuple[int, frozenset]]) -> dict[int, int]:
    parent = {i: i for i, _ in pairs}

    def root(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in pairs:
        for j, b in pairs:
            if i < j and a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in parent}


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates_against_brute_force(spark, k):
    given = [(r[0], shingles(r[1], k)) for r in rows(ids=False)]
    expected = linked_components(list(dict(given).items()))
    out = minhash.near_duplicates(documents(spark, ids=False), shingle=k).collect()
    assert len(out) == len(given)
    for r in out:
        assert (r["n_shingles"], r["component_id"]) == (len(dict(given)[r["doc_id"]]), expected[r["doc_id"]])
        assert r["kept"] == (r["doc_id"] == r["component_id"])
    left = minhash.deduplicated(documents(spark, ids=False), shingle=k)
    assert sorted(r[0] for r in left.collect()) == sorted(set(expected.values()))
    assert left.columns == documents(spark, ids=False).columns


def test_chains_and_groups_without_hub_links(spark):
    """Texts with a common passage share buckets but few links; a chain links its ends only step by step."""
    import random

    rng = random.Random(8)
    passage = [f"p{i}" for i in range(40)]
    docs = [(i, " ".join([*passage, *(f"w{rng.randrange(10**6)}" for _ in range(18 + i % 5))])) for i in range(60)]
    chain = [f"c{i}" for i in range(130)]
    docs += [(1000 - i, " ".join(chain[4 * i : 4 * i + 100])) for i in range(7)]
    expected = linked_components([(i, shingles(t, 2)) for i, t in docs])
    out = minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in out} == expected
    assert expected[1000] == 994


def test_near_duplicates_of_awkward_rows(spark):
    out = minhash.near_duplicates(documents(spark)).collect()
    assert len(out) == len(rows())
    assert all(r["kept"] for r in out if r["doc_id"] is None)
    assert minhash.near_duplicates(empty(spark)).count() == 0
    assert minhash.deduplicated(empty(spark)).count() == 0


def test_parities_bound_the_difference():
    rng = np.random.default_rng(4)
    for _ in range(50):
        both = np.unique(mixed(rng.integers(0, 2**63, 300).astype(np.uint64)))
        a, b = both[:250], both[rng.integers(0, 200) :]
        differing = np.bitwise_count((minhash.parities(a) ^ minhash.parities(b)).view(np.uint64)).sum()
        assert differing <= len(np.setxor1d(a, b))


def katz_by_hand(given: list[tuple[int | None, str | None]]) -> dict[int | None, tuple]:
    split = [(i, [*(t or "").encode().lower().split(), "end"]) for i, t in given]
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 10 == 0
    uni, bi, hist = Counter(), Counter(), Counter()
    for i, t in split:
        if not held(i):
            uni.update(t)
            for h, w in zip(["begin", *t[:-1]], t, strict=True):
                bi[h, w] += 1
                hist[h] += 1
    n, v = sum(uni.values()), len(uni)
    d = lambda c: katz.discounts(np.bincount(np.minimum(list(c.values()), 7), minlength=8)[:7])
    du, db = d(uni), d(bi)
    at = lambda x, c: x[min(c, 6)]
    taken = 1 - sum(at(du, c) * c for c in uni.values()) / n
    unseen = max(taken, 1 / (n + 1))
    p1 = {w: at(du, c) * c / n * (1 - unseen) / (1 - taken) for w, c in uni.items()}
    after: dict = {}
    for (h, w), c in bi.items():
        after.setdefault(h, []).append((w, c))
    model = {}
    for h, s in after.items():
        seen = {w: at(db, c) * c / hist[h] for w, c in s}
        left = 1 - sum(seen.values())
        if left <= 1e-12:
            seen = {w: p * hist[h] / (hist[h] + 1) for w, p in seen.items()}
            left = 1 / (hist[h] + 1)
        weight = left / (1 - sum(p1[w] for w in seen))
        model[h] = (seen, weight)
        total = sum(seen.values()) + weight * (sum(p for w, p in p1.items() if w not in seen) + unseen)
        assert abs(total - 1) < 1e-9  # exactly normalised
    out = []
    for i, t in split:
        score = base = 0.0
        for h, w in zip(["begin", *t[:-1]], t, strict=True):
            base += math.log10((uni[w] + 0.1) / (n + 0.1 * (v + 1)))
            p = p1.get(w, unseen)
            if h in model:
                seen, weight = model[h]
                p = seen.get(w, weight * p)
            score += math.log10(p)
        out.append((str(i), held(i), len(t), sum(uni[w] > 0 for w in t), n, round(base, 6), round(score, 6)))
    return sorted(out)


@pytest.mark.parametrize("share", [4, 10**6])
def test_katz_against_brute_force(spark, monkeypatch, share):
    monkeypatch.setattr(katz, "HOT_SHARE", share)  # the second makes every history of more than a token hot
    out = katz.katz_scores(documents(spark)).collect()
    found = sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6), round(r["score"], 6)) for r in out)
    expected = katz_by_hand([(r[0], r[1]) for r in rows()])
    assert [f[:5] for f in found] == [e[:5] for e in expected]
    assert all(abs(f[5] - e[5]) < 1e-4 and abs(f[6] - e[6]) < 1e-4 for f, e in zip(found, expected, strict=True))
    assert katz.katz_scores(empty(spark)).count() == 0


def katz_recursively(given: list[tuple[int | None, str | None]], order: int) -> list[tuple[str, float]]:
    """A model of dictionaries whose recursion is written out."""
    split = [(i, [*(t or "").encode().lower().split(), "end"]) for i, t in given]
    grams = lambda t, n: [tuple((["begin", *t])[k - n + 1 : k + 1]) for k in range(n - 1 if n > 1 else 1, len(t) + 1)]
    counts = {n: Counter(g for i, t in split if zlib.crc32(b"" if i is None else str(i).encode()) % 10 for g in grams(t, n)) for n in range(1, order + 1)}
    d = {n: katz.discounts(np.bincount(np.minimum(list(c.values()), 7), minlength=8)[:7]) for n, c in counts.items()}
    total = sum(counts[1].values())
    taken = 1 - sum(d[1][min(c, 6)] * c for c in counts[1].values()) / total
    unseen = max(taken, 1 / (total + 1))
    after: dict = {}
    for n in range(2, order + 1):
        for g, c in counts[n].items():
            after.setdefault(g[:-1], {})[g[-1]] = c
    weight: dict = {}

    def p(h: tuple, w) -> float:
        if not h:
            c = counts[1][w,]
            return d[1][min(c, 6)] * c / total * (1 - unseen) / (1 - taken) if c else unseen
        if h not in after:
            return p(h[1:], w)
        if h not in weight:
            c_h = sum(after[h].values())
            seen = {x: d[len(h) + 1][min(c, 6)] * c / c_h for x, c in after[h].items()}
            left = 1 - sum(seen.values())
            if left <= 1e-12:
                seen, left = {x: q * c_h / (c_h + 1) for x, q in seen.items()}, 1 / (c_h + 1)
            weight[h] = seen, left / (1 - sum(p(h[1:], x) for x in seen))
        return weight[h][0].get(w) or weight[h][1] * p(h[1:], w)

    out = []
    for i, t in split:
        whole = ["begin", *t]
        out.append((str(i), sum(math.log10(p(tuple(whole[max(0, k - order + 1) : k]), whole[k])) for k in range(1, len(whole)))))
    return sorted(out)


@pytest.mark.parametrize("order", [2, 3, 4])
@pytest.mark.parametrize("share", [4, 10**6])
def test_katz_of_higher_order(spark, monkeypatch, order, share):
    monkeypatch.setattr(katz, "HOT_SHARE", share)
    monkeypatch.setattr(katz.S, "chunk_bytes", lambda df: 2000)
    found = sorted((str(r["doc_id"]), r["score"]) for r in katz.katz_scores(documents(spark), order=order).collect())
    expected = katz_recursively([(r[0], r[1]) for r in rows()], order)
    assert [f[0] for f in found] == [e[0] for e in expected]
    assert all(abs(f[1] - e[1]) < 1e-6 for f, e in zip(found, expected, strict=True))


def test_katz_holds_little_per_token():
    words = (np.random.default_rng(3).zipf(1.2, 300_000) % 20_000).astype(str).reshape(300, 1000)
    first = katz.Tokens.of(katz.S.Chunk(list(range(300)), [" ".join(w).encode() for w in words]))
    raw, asked = first.dump(), dict(first.asked(1))
    (_, totals), (_, told) = katz._words_bucket([0], [asked[0]])
    totals = katz.S.unplanes(totals, np.int64)
    unigrams = katz.Unigrams(totals[0], totals[1], totals[2:])
    models: list = []
    answers: list[dict[int, bytes]] = []
    peaks = []

    def measured(f):
        tracemalloc.start()
        try:
            found = f()
            peaks.append(tracemalloc.get_traced_memory()[1] / first.counts.sum())
        finally:
            tracemalloc.stop()
        return found

    def sent(order: int) -> bytes:
        tokens = katz.Tokens.load(raw)
        tokens.told({0: told}, 1)
        level, _ = tokens.levels(answers, 1, 1 << 40, unigrams, models, order)
        return dict(level.sent())[0]

    for order in (2, 3):
        blob = measured(lambda: sent(order))  # noqa: B023
        found = dict(measured(lambda: katz._ngrams_bucket([0], [blob], order == 3)))  # noqa: B023
        models.append((katz.discounts(katz.S.unplanes(found[-1], np.int64)), {}))
        answers.append({0: found[0]})
    assert max(peaks) < 130  # bytes a token


def test_katz_answers_are_exchanged_once(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(katz, "scratch", lambda spark, what: f"file://{tmp_path}/{what}")
    monkeypatch.setattr(katz.S, "chunk_bytes", lambda df: 2000)
    assert katz.katz_scores(documents(spark), order=4).count() == len(rows())
    tables = {p.name for p in (tmp_path / "katz").iterdir()}
    assert "order4" in tables and not tables & {"words", "counts", "order2", "order3"}


def test_katz_tells_last_weights_where_needed(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(katz, "scratch", lambda spark, what: f"file://{tmp_path}/{what}")
    monkeypatch.setattr(katz.S, "chunk_bytes", lambda df: 2000)
    katz.katz_scores(documents(spark), order=3)
    found = [katz.S.parts(bytes(r["blob"])) for r in spark.read.parquet(f"file://{tmp_path}/katz/order3").where("chunk >= 0").collect()]
    weights, marks = (sum(len(f[i]) > 0 for f in found) for i in (2, 5))
    assert weights and marks


@pytest.mark.parametrize("high", [1 << 16, 1 << 40])
def test_token_files_are_small_for_skewed_ids(high):
    rng = np.random.default_rng(5)
    names = rng.choice(high, 40_000)
    ids = names[np.minimum(rng.zipf(1.3, 200_000), len(names)) - 1].astype(np.uint64)
    raw = tokens.pack([7, None], np.array([150_000, 50_000]), ids)
    doc_ids, counts, found = tokens.unpack(raw)
    assert doc_ids == [7, None] and counts.tolist() == [150_000, 50_000] and (found == ids).all()
    assert len(raw) < 0.8 * 8 * len(simple8b.encode(ids)[0])
    assert len(tokens.unpack(tokens.pack([], np.zeros(0, np.int64), np.zeros(0, np.uint64)))[2]) == 0


def test_chunks_do_not_grow_with_partitions(spark):
    key = "spark.sql.files.maxPartitionBytes"
    before, found = spark.conf.get(key), {}
    try:
        for size in ("1m", "16m", "128m", "1g"):
            spark.conf.set(key, size)
            found[size] = katz.S.chunk_bytes(documents(spark))
    finally:
        spark.conf.set(key, before)
    assert found == {"1m": 1 << 20, "16m": 4 << 20, "128m": 4 << 20, "1g": 4 << 20}


def common_prefix(a: bytes, b: bytes) -> int:
    return next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


def sorted_by_induction(text: np.ndarray, depth: int, **bounds) -> None:
    raw = text.tobytes()
    batches = list(induced.descending(text, depth, **bounds))
    order, common = (np.concatenate(x).tolist() for x in zip(*batches, strict=True))
    heads = [raw[i : i + depth] for i in order]
    assert sorted(order) == list(range(len(raw))) and heads == sorted(heads, reverse=True)
    assert common[1:] == [common_prefix(a, b) for a, b in zip(heads[:-1], heads[1:], strict=True)]


@pytest.mark.parametrize("least, ranges", [(2, 1024), (2, 4), (40, 16), (1 << 20, 1024)])
def test_suffixes_are_in_order_with_their_common_prefixes(monkeypatch, least, ranges):
    """least: names from which on they are sorted by recursion; ranges: so few that the queue's ranges hold several priorities."""
    monkeypatch.setattr(induced, "LEAST", least)
    monkeypatch.setattr(induced, "RANGES", ranges)
    rng = np.random.default_rng(0)
    for i in range(60):
        text = rng.integers(97, 97 + int(rng.integers(1, 6)), int(rng.integers(1, 200))).astype(np.uint8)
        if i % 3 == 0:
            text = np.concatenate([text, text[: len(text) // 2], text])
        sorted_by_induction(text, (5, 20, 50, 200)[i % 4])


def test_a_string_much_longer_than_the_queue(monkeypatch, tmp_path):
    """Queues of 200 entries for 30,000 bytes: nearly all of it goes to files of the folder, which are gone afterwards."""
    monkeypatch.setattr(induced, "LEAST", 50)
    stored = []
    put = induced.Store.put
    monkeypatch.setattr(induced.Store, "put", lambda self, batches: stored.append(sum(len(b[0]) for b in batches)) or put(self, batches))
    rng = np.random.default_rng(1)
    text = rng.integers(97, 103, 18_000).astype(np.uint8)
    text = np.concatenate([text, text[500:9_000], text[:3_500]])
    sorted_by_induction(text, 50, memory=200, folder=f"file://{tmp_path}/queues")
    assert sum(stored) > 2 * len(text) and not list(tmp_path.glob("queues/*"))


def repeats_by_hand(given: list[tuple[int | None, str | None]]) -> list[tuple]:
    rank = lambda i: 1 << 62 if i is None else i
    first: dict[bytes, int] = {}
    for i, t in given:
        raw = (t or "").encode()
        for p in range(len(raw) - 49):
            w = raw[p : p + 50]
            first[w] = min(first.get(w, 1 << 62), rank(i))
    out = []
    for i, t in given:
        raw = (t or "").encode()
        gone = [False] * len(raw)
        for p in range(len(raw) - 49):
            if first[raw[p : p + 50]] < rank(i):
                gone[p : p + 50] = [True] * 50
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        out.append((str(i), len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("chunk", [1 << 20, 700])
def test_repeats_against_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(repeats.S, "chunk_bytes", lambda df: chunk)
    out = repeats.repeats_digest(documents(spark)).collect()
    found = sorted((str(r["doc_id"]), *tuple(r)[1:]) for r in out)
    assert found == repeats_by_hand([(r[0], r[1]) for r in rows()])
    assert sum(f[2] for f in found) > 0
    assert repeats.repeats_digest(empty(spark)).count() == 0


def test_repeats_of_a_phrase_in_all_rows(spark, monkeypatch):
    """A phrase shorter than a stretch, other bytes around it: no bucket of runs gets all its stretches, and the result is exact."""
    rng = random.Random(11)
    other = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    phrase, lefts, given = "Licensed under the terms of the file LICENSE.txt", [], []
    for i in range(24_000):
        lefts.append(lefts[rng.randrange(i)] if i % 5 == 4 else other(28))
        given.append((i, lefts[-1] + phrase + other(28)))
    asked = []
    plain = repeats._by_bucket
    monkeypatch.setattr(repeats, "_by_bucket", lambda blobs, answer: (asked.append(blobs), plain(blobs, answer))[1])
    docs = spark.createDataFrame(given, "doc_id long, text string").repartition(3)
    out = repeats.repeats_digest(docs).collect()
    assert sorted((str(r["doc_id"]), *tuple(r)[1:]) for r in out) == repeats_by_hand(given)
    assert sum(r["n_removed"] for r in out) > 0
    runs, single = repeats.RUN_BUCKETS * repeats.S.buckets_for(docs), 0
    held = Counter()
    for r in asked[1].collect():
        _, counts, raw = repeats.S.parts(r["blob"])
        held[r["bucket"]] += len(repeats.S.spread(raw))
        single += r["bucket"] >= runs and set(repeats.S.unplanes(counts, np.int64).tolist()) == {1}
    assert single and max(n for b, n in held.items() if b < runs) <= (1 << 20)


def test_deduplication_decides_by_row(spark):
    """Different texts of one doc_id: one is a near copy of a smaller doc_id's, the other is not and has a near copy itself."""
    words = [f"{a}{b}" for a in "bcdfghklmn" for b in ("ada", "ebe", "ici", "odo", "ufu", "ala", "eme", "ini")]
    one, two = words[:70], words[:9:-1]
    given = [(1, one), (5, [*one[:-1], "changed"]), (5, two), (5, two), (7, [*two[:-1], "changed"]), (None, [*words[::3], *words[1::3]])]
    docs = spark.createDataFrame([(i, " ".join(w), k) for k, (i, w) in enumerate(given)], "doc_id long, text string, at int")
    for partitions in (1, 4):
        left = sorted(r["at"] for r in minhash.deduplicated(docs.repartition(partitions)).collect())
        assert left in ([0, 2, 5], [0, 3, 5])
