"""Small tables with the awkward cases: nulls, empty and very long texts, ties, repeated rows, columns with clashing names."""

from __future__ import annotations

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, Text string, shard string, node string"


def texts() -> list[str | None]:
    rng = random.Random(5)
    syllables = ["an", "ber", "che", "del", "en", "for", "gel", "hin", "is", "ja", "kor", "lu"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 3)))
    prose = lambda n: " ".join(word() for _ in range(n))
    base, passage = prose(80), prose(30)
    near = base.split()
    near[40] = "changed"
    out: list[str | None] = [None, "", "   \n\t ", "one", "One", "42", "two words", "Two  Words"]
    out += [base, base, " ".join(near), base.upper(), prose(50) + " " + passage + " " + prose(20), passage + "\n" + prose(60), prose(10) + passage]
    out += ["x" * 5000, "ab " * 3000, "line of text here\n" * 40, "mail a.b@c.example.org or +1 (017) 555-7713, 4111 1111 1111 1111, 10.0.0.1"]
    out += [prose(rng.randint(1, 120)) for _ in range(30)]
    out += ["é ñ ü ß " + prose(25), "日本語 テキスト 日本語 テキスト", "é ​ \U0001f600 " + prose(12), prose(4000)]
    return out


def rows(ids: bool = True) -> list[tuple]:
    out = []
    for i, t in enumerate(texts()):
        lang = None if i % 11 == 0 else ("en", "de", "fr", "es")[i % 4]
        out.append((i, t, lang, None if i % 7 == 0 else f"s{i % 3}", 0 if t is None else len(t), "clash", "clash", "clash"))
    out.append(out[8])  # a repeated row
    out.append(out[20])
    if ids:
        out.append((None, "a row without an id, which holds some words of its own", "en", "s1", 10, "clash", "clash", "clash"))
        out.append((None, None, None, None, None, None, None, None))
    random.Random(1).shuffle(out)
    return out


def documents(spark, ids: bool = True, partitions: int = 3):
    spark.conf.set("spark.sql.caseSensitive", "true")
    try:
        return spark.createDataFrame(rows(ids), DOCS).repartition(partitions)
    finally:
        spark.conf.set("spark.sql.caseSensitive", "false")


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
