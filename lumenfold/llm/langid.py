"""Language identification in two steps: a linear classifier predicts the language family, then one-versus-one linear support vector
machines separate the languages within it. Features are hashed character n-grams of the whole text."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, batch, bounded_batches, pick, texts, whole_rows

#: Families of languages by ISO 639-1 code. A language not listed is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "is"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca"),
    "slavic": ("ru", "pl", "cs", "uk", "bg", "sk", "sr", "hr", "sl"),
    "turkic": ("tr", "az", "kk"),
    "uralic": ("fi", "hu", "et"),
}
#: Hashed feature space, and n-gram lengths in bytes of the lower-cased text.
DIMENSIONS, LENGTHS = 1 << 14, (1, 2, 3)
#: The classifier is fitted on about this many different labelled texts of each language, at least one; the sample is drawn by a hash of the text, so it does not
#: depend on the partitioning. Its features, at most SAMPLE_ROWS times the number of languages rows, are the only data sent to the driver.
#: With very many languages it is fewer of each, MOST_ROWS in all.
SAMPLE_ROWS, MOST_ROWS = 800, 20_000
EPOCHS, COST = 12, 4.0

_LETTER = re.compile(r"[^\W\d_]")
_BLANKS = re.compile(r"[\s\d!-@\[-`{-~]+")
_MULTIPLIERS = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))


def family_of(lang: str) -> str:
    return next((f for f, ls in FAMILIES.items() if lang in ls), lang)


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values, of length 1 together: square roots of hashed n-gram counts. Digits, punctuation and blanks count as one blank."""
    raw = np.frombuffer((" " + _BLANKS.sub(" ", text.lower()).strip() + " ").encode("utf-8", "surrogatepass"), dtype=np.uint8).astype(np.uint32)
    counts = np.zeros(DIMENSIONS, dtype=np.int64)
    for n in LENGTHS:
        if len(raw) >= n:
            h = raw[: len(raw) - n + 1] + np.uint32(n * 257)
            for k in range(1, n):
                h = h * np.uint32(257) + raw[k : len(raw) - n + 1 + k]
            h *= _MULTIPLIERS[n - 1]
            counts += np.bincount((h ^ (h >> np.uint32(15))) & np.uint32(DIMENSIONS - 1), minlength=DIMENSIONS)
    at = np.flatnonzero(counts)
    values = np.sqrt(counts[at]).astype(np.float32)
    return at.astype(np.int32), values / np.float32(max(1e-12, np.sqrt(float((values**2).sum()))))


def fit_svm(rows: list[tuple[np.ndarray, np.ndarray]], signs: np.ndarray) -> np.ndarray:
    """Weights and bias of a linear SVM with squared hinge loss, by dual coordinate descent; classes weigh alike. The order of steps is seeded."""
    n, w = len(rows), np.zeros(DIMENSIONS + 1)
    alpha, rng = np.zeros(n), np.random.default_rng(7)
    cost = np.where(signs > 0, COST * n / (2 * max(1, (signs > 0).sum())), COST * n / (2 * max(1, (signs < 0).sum())))
    for _ in range(EPOCHS):
        for i in rng.permutation(n):
            at, v = rows[i]
            slack = 1 / (2 * cost[i])
            step = (signs[i] * (w[at] @ v + w[-1]) - 1 + slack * alpha[i]) / (2.0 + slack)
            new = max(0.0, alpha[i] - step)
            if new != alpha[i]:
                change = (new - alpha[i]) * signs[i]
                w[at] += change * v
                w[-1] += change
                alpha[i] = new
    return w.astype(np.float32)


class Model:
    """Family classifiers, one against the rest, and pair classifiers within each family. Its size is that of the feature space times the
    number of classifiers, whatever the corpus."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]], langs: list[str]) -> None:
        self.langs = sorted(set(langs))
        self.members: dict[str, list[str]] = {}
        for x in self.langs:
            self.members.setdefault(family_of(x), []).append(x)
        self.families = sorted(self.members)
        at = np.array(langs)
        family = np.array([family_of(x) for x in langs])
        columns, self.pairs = [], []
        if len(self.families) > 1:
            columns += [fit_svm(rows, np.where(family == f, 1, -1)) for f in self.families]
        for f in self.families:
            for a, b in combinations(self.members[f], 2):
                own = np.flatnonzero((at == a) | (at == b))
                self.pairs.append((f, a, b))
                columns.append(fit_svm([rows[i] for i in own], np.where(at[own] == a, 1, -1)))
        self.weights = np.stack(columns, axis=1) if columns else np.zeros((DIMENSIONS + 1, 0), dtype=np.float32)

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language and a score in [0, 1]; und with score 0 for a text without letters or a model without languages."""
        if not text or not self.langs or not _LETTER.search(text):
            return "und", 0.0
        at, v = features(text)
        margins = v @ self.weights[at] + self.weights[-1]
        likely = 1 / (1 + np.exp(-np.clip(4.0 * margins, -60, 60)))
        n = len(self.families) if len(self.families) > 1 else 0
        k = int(np.argmax(margins[:n])) if n else 0
        score = float(likely[k] / max(1e-12, likely[:n].sum())) if n else 1.0
        votes = {x: [0, 0.0] for x in self.members[self.families[k]]}
        for (f, a, b), p in zip(self.pairs, likely[n:], strict=True):
            if f == self.families[k]:
                votes[a if p >= 0.5 else b][0] += 1
                votes[a][1] += float(p)
                votes[b][1] += 1 - float(p)
        best = max(votes, key=lambda x: (*votes[x], x))
        if len(votes) > 1:
            score *= votes[best][1] / (len(votes) - 1)
        return best, min(1.0, max(0.0, score))


def held_out(doc_id) -> F.Column:
    """Whether the row is kept from learning: crc32 of the id as text, modulo 3, is 1. A null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def fit(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Learns from text and non-null lang of rows outside the held-out third."""
    known = pick(docs, doc_id="long", text="string", lang="string").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))).select("text", "lang")
    # Copies of one text count once, here as in the sample.
    known = known.withColumn("h", F.xxhash64("text", F.lit("langid")))
    place = F.col("h").bitwiseAND(F.lit((1 << 30) - 1)) / float(1 << 30)
    found = known.select("lang", "h").distinct().groupBy("lang").agg(F.count("*").alias("n"), F.min(place).alias("least")).collect()
    if not found:
        return Model([], [])
    sample_rows = max(1, min(sample_rows, MOST_ROWS // len(found)))
    # The least text of a language is drawn at any share, so that no language is left out.
    share = F.create_map(*[F.lit(x) for r in found for x in (r["lang"], min(1.0, sample_rows / r["n"]))])
    least = F.create_map(*[F.lit(x) for r in found for x in (r["lang"], r["least"])])
    drawn = (place < share[F.col("lang")]) | (place == least[F.col("lang")])

    ddl = "lang string, at binary, v binary"
    schema = arrow_schema(ddl)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [features(t) for t in texts(b.column(0))]
            yield batch([b.column(1), [g[0].tobytes() for g in got], [g[1].tobytes() for g in got]], schema)

    rows: pd.DataFrame = known.where(drawn).select("text", "lang").dropDuplicates(["text", "lang"]).mapInArrow(extract, ddl).toPandas()
    rows = rows.sort_values(["lang", "at", "v"], kind="stable").groupby("lang").head(2 * sample_rows)
    return Model([(np.frombuffer(a, np.int32), np.frombuffer(v, np.float32)) for a, v in zip(rows["at"], rows["v"], strict=True)], rows["lang"].tolist())


PREDICTED = "doc_id long, held_out boolean, lang_pred string, score double"


def predict_languages(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """One row per row of docs: doc_id, held_out, lang_pred and score. Only the text decides the prediction.

    A null text, an empty one or one without letters is und with score 0; with no labelled rows at all, everything is. A null doc_id stays null
    and is not held out; repeated rows give repeated rows; an empty table gives none. Prediction is one map without shuffle."""
    model = model or fit(docs)
    schema = arrow_schema(PREDICTED)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [model.predict(t) for t in texts(b.column(1))]
            out = [zlib.crc32(("" if i is None else str(i)).encode()) % 3 == 1 for i in b.column(0).to_pylist()]
            yield batch([b.column(0), out, [g[0] for g in got], [g[1] for g in got]], schema)

    bounded_batches(docs.sparkSession)
    return pick(docs, doc_id="long", text="string").mapInArrow(apply, PREDICTED)


#: Rows with a score below this are rejected by accepted(), like those without a language.
LEAST_SCORE = 0.3


def accepted(docs: DataFrame, least_score: float = LEAST_SCORE, model: Model | None = None) -> DataFrame:
    """The rows of docs, all columns, whose text has a language: not und, and a score of at least least_score. Null and empty texts go."""
    model = model or fit(docs)

    @F.pandas_udf("boolean")
    def has_language(column: pd.Series) -> pd.Series:
        got = [model.predict(t) for t in column]
        return pd.Series([g[0] != "und" and g[1] >= least_score for g in got], dtype=bool)

    bounded_batches(docs.sparkSession)
    plain, (text,), own = whole_rows(docs, "text")
    return plain.where(has_language(text.cast("string"))).toDF(*own)
