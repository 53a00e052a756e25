"""Personal data, language identification, quality rules, decontamination."""

from __future__ import annotations

import hashlib
import re
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st

from lumenfold.llm import decontam, langid, pii, quality

from .fixtures import documents, empty, rows

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    digits = lambda s: "".join(c for c in s if c in "0123456789")

    def luhn(d: str) -> bool:
        doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(d))]
        return sum(x - 9 if x > 9 else x for x in doubled) % 10 == 0

    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p[-9:]) <= 255 for p in m.group().split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(text) if 16 <= len(digits(m.group())) <= 19 and luhn(digits(m.group()))]
    return out + [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(digits(m.group())) <= 15]


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab.@-_ 0123456789+()4411é\n", max_size=60))
def test_base_spans_are_those_of_the_patterns(text):
    found = [(s.kind, s.start, s.end) for s in pii.find_spans(text) if s.kind in pii.BASE_KINDS]
    assert found == base_spans(text)


def test_long_runs_take_linear_time():
    assert pii.find_spans("a" * 200_000 + "@" + "1" * 200_000 + "." * 1000) == []
    assert pii.find_spans("1." * 100_000 + "+" * 100_000) is not None


def test_checksums_and_context():
    kinds = lambda t: [s.kind for s in pii.find_spans(t)]
    assert kinds("IBAN DE89 3704 0044 0532 0130 00 please") == ["iban"]
    assert kinds("code DE88 3704 0044 0532 0130 00 please") == []
    assert kinds("number 078-05-1120") == [] and kinds("my ssn: 078-05-1120") == ["ssn"]
    assert kinds("378282246310005") == ["card_short"]
    assert pii.find_spans("card 4111 1111 1111 1111")[0].score > pii.find_spans("xxxx 4111 1111 1111 1111")[0].score


def test_ibans_beside_capitals_and_numbers():
    found = lambda t: [t[s.start : s.end] for s in pii.find_spans(t) if s.kind == "iban"]
    assert found("DE89370400440532013000 BIC COBADEFFXXX") == ["DE89370400440532013000"]
    assert found("GB82 WEST 1234 5698 7654 32 I will") == ["GB82 WEST 1234 5698 7654 32"]
    assert found("GB82WEST12345698765432 2024-01-01") == ["GB82WEST12345698765432"]
    assert found("NO12 DE89 3704 0044 0532 0130 00") == ["DE89 3704 0044 0532 0130 00"]
    assert found("DE89370400440532013000 GB82WEST12345698765432 NO9386011117947") == ["DE89370400440532013000", "GB82WEST12345698765432", "NO9386011117947"]
    assert found("ACCOUNT NO 9 DE89 3704 0044 0532 0130 00 OR BY CARD") == ["DE89 3704 0044 0532 0130 00"]
    assert found("DE89370400440532013000X") == [] and found("XDE89370400440532013000") == [] and found("DE89") == []
    digits = next(f"{c:02}" for c in range(2, 99) if pii.mod97(f"ZZ{c:02}ABCD12345678901"))
    assert found(f"ZZ{digits} ABCD 1234 5678 901 IS") == [f"ZZ{digits} ABCD 1234 5678 901"]
    assert found("AB12 " * 50_000) is not None


def test_pii_rows(spark):
    out = pii.pii_digest(documents(spark)).collect()
    assert len(out) == len(rows())
    hit = [r for r in out if r["n_email"]]
    assert len(hit) == 1 and (hit[0]["n_ip"], hit[0]["n_card"], hit[0]["n_phone"]) == (1, 1, 1)
    none = hashlib.sha256(b"").hexdigest()
    assert all(r["base_sha256"] == none and r["spans"] == "" for r in out if r["doc_id"] in (0, 1, None))
    assert pii.pii_digest(empty(spark)).count() == 0


def sample(spark):
    """Prose of four made-up languages by their own letters."""
    import random

    rng = random.Random(3)
    parts = {"en": ["the", "ing", "tion", "wh", "ly"], "de": ["sch", "ung", "keit", "ver", "ö"], "fr": ["eau", "ment", "qu", "é", "oi"], "es": ["ción", "mente", "ñ", "os", "rr"]}
    out = []
    for i in range(240):
        lang = list(parts)[i % 4]
        text = " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(4, 40)))
        out.append((i, text, None if i % 17 == 0 else lang))
    return spark.createDataFrame(out, "doc_id long, text string, lang string"), {r[0]: list(parts)[r[0] % 4] for r in out}


def test_language_of_held_out_texts(spark):
    docs, truth = sample(spark)
    out = langid.predict_languages(docs).collect()
    held = [r for r in out if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 3 == 1}
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) / len(held) > 0.95
    assert all(0 <= r["score"] <= 1 for r in out)


def test_sample_under_copies_and_with_many_languages(spark, monkeypatch):
    """Copies of one text take nobody's place in the sample, and no language goes without a text."""
    fitted = []
    monkeypatch.setattr(langid, "Model", lambda rows, langs: fitted.append(langs))
    copies = [(i, "the same text again and again", "en") for i in range(6000)]
    others = [(10_000 + i, f"text number {'abcdefgh'[i % 8]} {'xyz' * (i // 8 + 1)}", "en") for i in range(120)]
    langid.fit(spark.createDataFrame(copies + others, "doc_id long, text string, lang string"), sample_rows=40)
    assert 20 <= len(fitted[0]) <= 80
    many = [(i, f"text {'abcdefghijk'[i % 11]} {'pqr' * (i % 13)} {i}", f"l{i % 70}") for i in range(1400)]
    langid.fit(spark.createDataFrame(many, "doc_id long, text string, lang string"), sample_rows=1)
    assert len(set(fitted[1])) == 70


def test_labels_of_held_out_rows_change_nothing(spark):
    from pyspark.sql import functions as F

    docs, _ = sample(spark)
    other = docs.withColumn("lang", F.when(langid.held_out(F.col("doc_id")), F.lit("xx")).otherwise(F.col("lang")))
    key = lambda d: sorted((r["doc_id"], r["lang_pred"], round(r["score"], 9)) for r in langid.predict_languages(d).collect())
    assert key(docs) == key(other)


def test_language_of_awkward_rows(spark):
    out = langid.predict_languages(documents(spark)).collect()
    assert len(out) == len(rows())
    by = {r["doc_id"]: r for r in out}
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 for i in (0, 1, 2, 5))
    assert langid.predict_languages(empty(spark)).count() == 0
    kept = langid.accepted(documents(spark))
    assert kept.columns == documents(spark).columns and {0, 1, 2, 5}.isdisjoint({r[0] for r in kept.collect()})


def quality_row(text: str | None) -> tuple:
    text = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    places: dict[tuple, list[int]] = {}
    for i in range(len(words) - 7):
        places.setdefault(tuple(words[i : i + 8]), []).append(i)
    inside = {p + k for at in places.values() if len(at) > 1 for p in at for k in range(8)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside)


def test_quality_against_brute_force(spark):
    out = quality.quality(documents(spark)).collect()
    found = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in out)
    assert found == sorted((r[0] if r[0] is not None else -1, *quality_row(r[1])) for r in rows())
    for r in out:
        assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])
    assert quality.quality(empty(spark)).count() == 0


def test_quality_is_native(spark):
    plan = quality.quality(documents(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def contaminated_row(text: str | None, items: list[tuple[str, str | None]]) -> tuple:
    fold = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    words, hit, names = fold(text), set(), set()
    for name, item in items:
        own = fold(item)
        n = min(10, len(own))
        grams = {tuple(own[i : i + n]) for i in range(len(own) - n + 1)} if n else set()
        for i in range(len(words) - n + 1):
            if n and tuple(words[i : i + n]) in grams:
                hit |= set(range(i, i + n))
                names.add(name)
    return len(words), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)


def items() -> list[tuple[str, str | None]]:
    by = {r[0]: r[1] for r in rows()}
    long, passage = by[13].split(), by[12].split()
    return [("1", " ".join(long[20:34])), ("10", " ".join(passage[50:80])), ("2", "two words"), ("3", None), ("4", "..."), ("5", "ONE"), ("6", " ".join(long[20:34])), ("7", "ab " * 15), ("8", "nothing that occurs anywhere in these texts but here and now okay")]


def test_decontamination_against_brute_force(spark, monkeypatch):
    bench = spark.createDataFrame(items(), "item_id string, text string")
    expected = sorted((r[0] if r[0] is not None else -1, *contaminated_row(r[1], items())) for r in rows())
    for size in (decontam.BLOCK_BYTES, 300):  # one block of items, and several
        monkeypatch.setattr(decontam, "BLOCK_BYTES", size)
        out = decontam.contamination_digest(documents(spark), bench).collect()
        assert sorted((r[0] if r[0] is not None else -1, *r[1:]) for r in map(tuple, out)) == expected
        clean = decontam.cleaned(documents(spark), bench)
        assert sorted(str(r[0]) for r in clean.collect()) == sorted(str(None if e[0] == -1 else e[0]) for e in expected if not e[5])
    none = spark.createDataFrame([], "item_id string, text string")
    assert not any(r["contaminated"] for r in decontam.contamination_digest(documents(spark), none).collect())
    assert decontam.contamination_digest(empty(spark), bench).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from("abcdef"), min_size=0, max_size=60), st.lists(st.sampled_from("abcdef"), min_size=0, max_size=40))
def test_winnowing_misses_nothing(doc, item):
    index = decontam.Index([("i", " ".join(item))])
    spans, names = index.hits([w.encode() for w in doc])
    _, hit, n, _, _ = contaminated_row(" ".join(doc), [("i", " ".join(item))])
    assert (sum(b - a for a, b in spans), len(names)) == (hit, n)
