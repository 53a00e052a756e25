"""Quality rules: a table of thresholds compiled into one Spark projection, without user functions."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pick

#: Words are runs of anything but these characters.
_BLANK = r"[\x20\x09-\x0D]+"
WINDOW = 8

#: Frequent function words of the languages served.
STOP_WORDS = {
    "en": ("the", "be", "to", "of", "and", "that", "have", "with", "in", "is", "a", "for", "on", "it", "was", "as", "this", "by"),
    "de": ("der", "die", "und", "das", "den", "von", "mit", "zu", "ist", "des", "auf", "ein", "im", "für", "nicht"),
    "fr": ("le", "la", "les", "de", "des", "et", "un", "une", "que", "qui", "dans", "du", "en", "pour", "est", "par", "il"),
    "es": ("el", "la", "los", "las", "de", "que", "y", "en", "un", "una", "por", "con", "del", "se", "para", "es"),
}


class Rule(NamedTuple):
    """A row of the threshold table: metric has to lie in [low, high], a bound of None is open. Metrics are named in METRICS.
    A rule is applied to texts of at least least_words words."""

    name: str
    metric: str
    low: float | None
    high: float | None
    least_words: int = 0


#: The method's own verdict. Ratios are of words unless the name says otherwise.
THRESHOLDS: tuple[Rule, ...] = (
    Rule("length", "n_words", 20, None),
    Rule("word_length", "chars_per_word", 2, 15),
    Rule("symbols", "symbol_ratio", None, 0.5, 20),
    Rule("stop_words", "stop_ratio", 0.01, None, 50),
    Rule("duplicate_lines", "dup_line_ratio", None, 0.5),
    Rule("bullets", "bullet_line_ratio", None, 0.9, 20),
    Rule("ellipses", "ellipsis_line_ratio", None, 0.5, 20),
)


def _let(value: Column, body) -> Column:
    """body(value) with value computed once: within a lambda, a bound variable is not evaluated again for each element."""
    return F.transform(F.array(value), body)[0]


def _repeat_words(words: Column) -> Column:
    """Words inside the 8-word windows that are found twice or more in the text.

    Windows are 64-bit hashes of the hashes of their words. A set of them tells whether any repeats; only then are they sorted to find which.
    Each repeated window adds the words up to the next repeated one, at most its own length."""

    def starts(hashes: Column) -> Column:
        paired = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def repeated(z: Column) -> Column:
            n = F.size(z)
            before = F.concat(F.array(F.lit(None).cast("struct<h:bigint,i:int>")), F.slice(z, 1, n - 1))
            after = F.concat(F.slice(z, 2, n - 1), F.array(F.lit(None).cast("struct<h:bigint,i:int>")))
            known = F.zip_with(F.zip_with(before, z, lambda a, b: F.when(a["h"] == b["h"], b["i"])), F.zip_with(z, after, lambda a, b: F.when(a["h"] == b["h"], a["i"])), lambda p, q: F.coalesce(p, q))
            return F.array_sort(F.filter(known, lambda i: i.isNotNull()))

        return _let(paired, repeated)

    def covered(found: Column) -> Column:
        n = F.size(found)
        gaps = F.zip_with(F.slice(found, 1, n - 1), F.slice(found, 2, n - 1), lambda a, b: F.least(b - a, F.lit(WINDOW)))
        return F.aggregate(gaps, F.lit(WINDOW).cast("long"), lambda s, g: s + g)

    def from_hashes(h: Column) -> Column:
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(_let(starts(h), covered))

    def from_words(w: Column) -> Column:
        n = F.size(w)
        shifted = [F.slice(w, k + 1, n - (WINDOW - 1)) for k in range(WINDOW)]
        pairs = F.arrays_zip(*shifted)
        return _let(F.transform(pairs, lambda s: F.xxhash64(s)), from_hashes)

    return F.when(F.size(words) < WINDOW + 1, F.lit(0).cast("long")).otherwise(_let(F.transform(words, lambda x: F.xxhash64(x)), from_words))


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def measured(docs: DataFrame, stop_words: Sequence[str] | None = None) -> DataFrame:
    """doc_id and the metrics of every whole text, native expressions only."""
    stops = sorted(set(stop_words if stop_words is not None else [w for ws in STOP_WORDS.values() for w in ws]))
    text = F.coalesce(F.col("text"), F.lit(""))
    df = pick(docs, doc_id="long", text="string").select("doc_id", text.alias("text"))
    df = df.select("doc_id", "text", F.filter(F.split("text", _BLANK), lambda w: w != "").alias("words"), F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"))
    words, lines = F.col("words"), F.col("lines")
    return df.select(
        "doc_id",
        F.size(words).cast("long").alias("n_words"),
        F.char_length(F.array_join(words, "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        _repeat_words(words).alias("n_repeat_words"),
        F.size(lines).cast("long").alias("n_lines"),
        F.size(F.filter(words, lambda w: F.lower(w).isin(stops))).cast("long").alias("n_stop_words"),
        F.size(F.filter(lines, lambda x: x.rlike(r"^\s*[-*•]"))).cast("long").alias("n_bullet_lines"),
        F.size(F.filter(lines, lambda x: x.rlike(r"(\.\.\.|…)\s*$"))).cast("long").alias("n_ellipsis_lines"),
    )


METRICS = {
    "n_words": lambda: F.col("n_words").cast("double"),
    "chars_per_word": lambda: _ratio(F.col("word_chars"), F.col("n_words")),
    "symbol_ratio": lambda: _ratio(F.col("n_symbols"), F.col("n_words")),
    "stop_ratio": lambda: _ratio(F.col("n_stop_words"), F.col("n_words")),
    "dup_line_ratio": lambda: _ratio(F.col("n_dup_lines"), F.col("n_lines")),
    "bullet_line_ratio": lambda: _ratio(F.col("n_bullet_lines"), F.col("n_lines")),
    "ellipsis_line_ratio": lambda: _ratio(F.col("n_ellipsis_lines"), F.col("n_lines")),
}


def compiled(rules: Sequence[Rule] = THRESHOLDS) -> Column:
    """The names of the rules that a row of measured() breaks, in the table's order."""
    tests = []
    for r in rules:
        value = METRICS[r.metric]()
        broken = F.lit(False)
        if r.low is not None:
            broken = broken | (value < F.lit(float(r.low)))
        if r.high is not None:
            broken = broken | (value > F.lit(float(r.high)))
        tests.append(F.when(broken & (F.col("n_words") >= r.least_words), F.lit(r.name)))
    return F.filter(F.array(*tests), lambda x: x.isNotNull())


def quality(docs: DataFrame, rules: Sequence[Rule] = THRESHOLDS) -> DataFrame:
    """One row per row of docs: its metrics, base_failed, the names of broken rules, and kept.

    A null or empty text has no words, so base_failed is true and kept false. Repeated rows are judged each on its own; a null doc_id stays
    null; an empty table gives none. There is no shuffle: the plan is a scan and projections."""
    df = measured(docs)
    df = df.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))
    return df.withColumn("broken", compiled(rules)).withColumn("kept", ~F.col("base_failed") & (F.size("broken") == 0)).withColumn("broken", F.array_join("broken", ","))
