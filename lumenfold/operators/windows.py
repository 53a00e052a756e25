"""Windows over token positions, spans and their localization, composition of documents."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import seeded_random, typed_id
from ..functions.scalars import let
from ..session import bounded_batches
from .scan import prefixes


def starts(length: Column, width: int, stride: int) -> Column:
    """Starts of complete windows; none if the text is shorter."""
    return F.when(length >= width, F.sequence(F.lit(0), length - width, F.lit(stride))).otherwise(F.array().cast("array<int>"))


def window_maximum(df: DataFrame, tokens: str, width: int, stride: int, score) -> DataFrame:
    """Adds window_count, window_start, window_end and window_score: the best complete window by score(slice), the first on a tie. A row's
    windows are looked at within the row, nothing is exploded or shuffled."""
    if width < 1 or stride < 1:
        raise ValueError("width and stride have to be positive")
    scored = let(F.col(tokens), lambda t: F.transform(starts(F.size(t), width, stride), lambda i: F.struct(score(F.slice(t, i + 1, width)).cast("double").alias("score"), (-i).alias("first"))))
    df = df.withColumn("_windows", scored).withColumn("_best", F.array_max("_windows"))
    out = df.withColumns({"window_count": F.size("_windows"), "window_start": -F.col("_best.first"), "window_end": -F.col("_best.first") + width, "window_score": F.col("_best.score")})
    return out.drop("_windows", "_best")


def _number(of: np.ndarray) -> tuple[np.ndarray, int]:
    """Numbers of the distinct values, and how many there are."""
    distinct, number = np.unique(of, return_inverse=True)
    return number.reshape(-1), len(distinct)


def _again(row: np.ndarray, tokens: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """For the n-grams that begin at these places, the index among them of the same row's last equal one before, or -1. Tokens are numbered, and
    an n-gram is the number its tokens and its row are the digits of; where that would be too large, it is numbered anew."""
    token, base = _number(tokens)
    kind, kinds = token[at], base
    for more in (*(token[at + j] for j in range(1, width)), None):
        digit, size = (row, int(row[-1]) + 1 if len(row) else 1) if more is None else (more, base)
        if kinds * size >= 1 << 62:
            kind, kinds = _number(kind)
        kind, kinds = (digit.astype(np.int64) * kinds + kind, kinds * size)
    bits = max(1, len(kind).bit_length())
    if kinds >= 1 << (63 - bits):
        kind, kinds = _number(kind)
    keyed = kind << bits | np.arange(len(kind))  # one sort of numbers that hold the n-gram and its place
    keyed.sort()
    order, kind = keyed & ((1 << bits) - 1), keyed >> bits
    before = np.full(len(kind), -1)
    again = kind[1:] == kind[:-1]
    before[order[1:][again]] = order[:-1][again]
    return before


def _windows_of_rows(lengths: np.ndarray, tokens: np.ndarray, flags: np.ndarray, width: int, window: int, stride: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams, and flagged ones, of every complete window of rows that have one, one row after another. A gram counts in the windows
    that hold it and not its last occurrence before: these are neighbours, so it adds one at the first and takes one away after the last;
    running sums give all windows of all rows at once. flags are those of the rows' n-grams."""
    m, grams = (lengths - window) // stride + 1, lengths - width + 1
    row = np.repeat(np.arange(len(lengths)), grams)
    at = np.arange(len(row)) - np.repeat(np.cumsum(grams) - grams, grams)
    before = _again(row, tokens, at + np.repeat(np.cumsum(lengths) - lengths, grams), width)
    before = np.where(before >= 0, at[before], -1)
    low = -(-np.maximum(before + 1, np.maximum(at - (window - width), 0)) // stride)
    high = np.minimum(at // stride, m[row] - 1)
    places = m + 1  # one more for what is taken away after the last
    first = (np.cumsum(places) - places)[row]
    inside = np.ones(int(places.sum()), bool)
    inside[np.cumsum(places) - 1] = False
    counts = []
    for held in ((of := low <= high), of & flags):
        ends = np.bincount((first + low)[held], minlength=len(inside)) - np.bincount((first + high)[held] + 1, minlength=len(inside))
        counts.append(np.cumsum(ends)[inside])
    return counts[0], counts[1]


def _windows_of_grams(tokens: np.ndarray, flags: np.ndarray, width: int, window: int, stride: int) -> tuple[np.ndarray, np.ndarray]:
    """_windows_of_rows() of a single row; of its flags those of n-grams are read."""
    return _windows_of_rows(np.array([len(tokens)]), tokens, np.asarray(flags[: len(tokens) - width + 1], dtype=bool), width, window, stride)


def ngram_window_maximum(df: DataFrame, tokens: str, green, width: int, window: int, stride: int, gamma: float = 0.25) -> DataFrame:
    """Adds window_count and, of the complete window with the greatest unique n-gram z statistic (the first on a tie): window_start, window_end,
    window_score, scored_units and green_count; null without complete windows. green(ngram) is the scheme's own predicate, asked once a position.
    All windows' statistics come from one pass over a row, whatever their overlap. Windows of at most `width` tokens have no units and score 0."""
    if width < 1 or window < 1 or stride < 1 or not 0 < gamma < 1:
        raise ValueError("width, window and stride have to be positive, gamma between zero and one")

    def best(column: pd.Series, flagged: pd.Series) -> pd.DataFrame:
        lengths = np.fromiter((0 if t is None else len(t) for t in column), np.int64, len(column))
        some = np.flatnonzero(lengths >= window)
        out = pd.DataFrame({"window_count": pd.array(np.zeros(len(column), np.int32), "Int32")} | dict.fromkeys(("window_start", "window_end")) | {"window_score": np.nan} | dict.fromkeys(("scored_units", "green_count")))
        m = (lengths[some] - window) // stride + 1
        units = greens = np.zeros(int(m.sum()), np.int64)
        if len(some) and window > width:
            joined = lambda arrays, kind: np.concatenate([np.asarray(arrays.iat[i], dtype=kind) for i in some.tolist()])
            units, greens = _windows_of_rows(lengths[some], joined(column, np.int64), joined(flagged, bool), width, window, stride)
        with np.errstate(invalid="ignore", divide="ignore"):
            z = np.where(units > 0, (greens - gamma * units) / np.sqrt(units * (gamma * (1 - gamma))), 0.0)
        if len(some):
            begin = np.cumsum(m) - m
            top = np.flatnonzero(z == np.repeat(np.maximum.reduceat(z, begin), m))
            i = top[np.searchsorted(top, begin)]
            start = (i - begin) * stride
            for name, values in (("window_count", m), ("window_start", start), ("window_end", start + window), ("scored_units", units[i]), ("green_count", greens[i])):
                filled = np.zeros(len(column), np.int32)
                filled[some] = values
                out[name] = pd.array(filled, "Int32") if name == "window_count" else pd.arrays.IntegerArray(filled, lengths < window)
            score = np.full(len(column), np.nan)
            score[some] = z[i]
            out["window_score"] = score
        return out.astype(dict.fromkeys(("window_start", "window_end", "scored_units", "green_count"), "Int32"))

    bounded_batches(df.sparkSession)
    t = F.col(tokens)
    count = F.greatest(F.coalesce(F.size(t), F.lit(0)) - (width - 1), F.lit(0))
    grams = F.arrays_zip(*[F.slice(t, i + 1, count) for i in range(width)])
    flags = F.transform(grams, lambda z: F.coalesce(green(F.array(*[z[str(i)] for i in range(width)])), F.lit(False)))
    kind = "struct<window_count int, window_start int, window_end int, window_score double, scored_units int, green_count int>"
    return df.withColumn("_w", F.pandas_udf(best, kind)(F.col(tokens), flags)).select("*", "_w.*").drop("_w")


def search_id(width: int, stride: int, statistic: str) -> str:
    return typed_id("search", {"width": width, "stride": stride, "statistic": statistic})


def overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.greatest(F.lit(0), F.least(a1, b1) - F.greatest(a0, b0))


def span_iou(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Overlap by the hull of both spans; 1 for two empty spans at one place."""
    hull = F.greatest(a1, b1) - F.least(a0, b0)
    return F.when(hull == 0, 1.0).otherwise(overlap(a0, a1, b0, b1) / hull)


def best_iou(start: Column, end: Column, truths: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(truths, lambda t: span_iou(start, end, t["start"], t["end"]))), F.lit(0.0))


def localized(df: DataFrame, start: str = "pred_start", end: str = "pred_end", truths: str = "truths", coordinates: str = "TOKEN") -> DataFrame:
    """Adds overlap, union, iou and offset errors of a predicted span against spans array<struct<start,end>>, which must not overlap.

    The matched span has the most overlap, then the nearest start, then the first place."""
    if coordinates != "TOKEN":
        raise ValueError("spans have token coordinates")
    p0, p1 = F.col(start), F.col(end)
    spans = F.array_sort(truths)
    clash = F.exists(F.zip_with(F.slice(spans, 1, F.greatest(F.size(spans) - 1, F.lit(0))), F.slice(spans, 2, F.greatest(F.size(spans) - 1, F.lit(0))), lambda a, b: a["end"] > b["start"]), lambda x: x)
    bad = F.when(F.size(spans) == 0, "a truth span is required").when(clash, "truth spans overlap").when((p0 < 0) | (p0 > p1) | F.exists(spans, lambda t: (t["start"] < 0) | (t["start"] > t["end"])), "spans are ordered")
    df = df.withColumn("_spans", F.when(bad.isNotNull(), F.raise_error(bad).cast("array<struct<start:int,end:int>>")).otherwise(spans))
    common = F.aggregate("_spans", F.lit(0), lambda s, t: s + overlap(p0, p1, t["start"], t["end"]).cast("int"))
    truth = F.aggregate("_spans", F.lit(0), lambda s, t: s + (t["end"] - t["start"]).cast("int"))
    ranked = F.transform("_spans", lambda t, i: F.struct(overlap(p0, p1, t["start"], t["end"]).alias("o"), (-F.abs(p0 - t["start"])).alias("near"), (-i).alias("i"), t["start"].alias("start"), t["end"].alias("end")))
    df = df.withColumns({"overlap_token_count": common, "union_token_count": truth + (p1 - p0) - common, "_matched": F.array_max(ranked)})
    iou = F.when(F.col("union_token_count") == 0, 1.0).otherwise(F.col("overlap_token_count") / F.col("union_token_count"))
    return df.withColumns({"iou": iou, "start_offset_error": p0 - F.col("_matched.start"), "end_offset_error": p1 - F.col("_matched.end")}).drop("_spans", "_matched")


def overlapping(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """Spans of two tables (key, start, end) that overlap: joined on the key and on blocks of positions both touch, so that long keys spread."""
    block = 1024
    blocks = lambda d, a, b: d.withColumn("block", F.explode(F.sequence(F.floor(F.col(a) / block), F.floor((F.greatest(F.col(b), F.col(a) + 1) - 1) / block))))
    a = blocks(left.withColumnsRenamed({"start": "a_start", "end": "a_end"}), "a_start", "a_end")
    b = blocks(right.withColumnsRenamed({"start": "b_start", "end": "b_end"}), "b_start", "b_end")
    joined = a.join(b, [*key, "block"]).where((F.col("a_start") < F.col("b_end")) & (F.col("b_start") < F.col("a_end")))
    # a pair is reported by the first block both touch
    return joined.where(F.col("block") == F.floor(F.greatest("a_start", "b_start") / block)).drop("block")


def overlap_counts(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """left with `overlaps`: how many spans of right (key, start, end; positions are integers) overlap each of its own. Of the spans that begin before
    a span ends, those are left out that end by its start; both numbers are ranks in an order, so no pair is ever made, and hot keys or long
    spans cost what any others do (see scan.py)."""
    if not key:
        raise ValueError("a key is required")
    g = F.struct(*key)
    long = lambda c: F.coalesce(F.col(c).cast("long"), F.raise_error(F.lit("spans need both ends")).cast("long"))
    ordered = F.when(long("start") <= long("end"), True).otherwise(F.raise_error(F.lit("spans are ordered")).cast("boolean"))

    def ranks(points: Column, asked: Column, name: str) -> DataFrame:
        events = right.where(ordered).select(g.alias("_g"), points.alias("_k"), F.lit(1).cast("long").alias("w")).unionByName(left.where(ordered).select(g.alias("_g"), asked.alias("_k"), F.lit(0).cast("long").alias("w")))
        return prefixes(events, "_g", "_k", "w").select("_g", F.col("_k").alias(f"_{name}"), F.coalesce("before", F.lit(0)).alias(f"n_{name}"))

    begun = ranks(long("start"), long("end"), "end")
    ended = ranks(long("end"), long("start") + 1, "start")
    # spans without extent at the place of one without extent: they have ended by its start, but not begun before its end
    points = right.where(F.col("start") == F.col("end")).groupBy(g.alias("_g"), long("start").alias("_at")).agg(F.count("*").alias("n_point"))
    keyed = left.withColumn("_g", g).withColumn("_end", long("end")).withColumn("_start", long("start") + 1).withColumn("_at", F.when(F.col("start") == F.col("end"), long("start")))
    out = keyed.join(begun, ["_g", "_end"]).join(ended, ["_g", "_start"]).join(points, ["_g", "_at"], "left")
    return out.select(*left.columns, (F.col("n_end") - F.col("n_start") + F.coalesce("n_point", F.lit(0))).alias("overlaps"))


def composed(df: DataFrame, marked: str, unmarked: str, fraction: float, separated: bool, split: Column | None = None, seed: Column | None = None) -> DataFrame:
    """Adds tokens, segments and realized_fraction. Marked tokens stand in one segment at `split` (a column, up to the unmarked count), or where each
    row's `seed` puts them (see split_point), or in two segments with unmarked ones after each. A fraction outside (0, 1] or a side without tokens is an error."""
    if not 0 < fraction <= 1:
        raise ValueError("the fraction has to be in (0, 1]")
    full = lambda c: F.when(F.size(c) > 0, F.col(c)).otherwise(F.raise_error(F.lit("both sides need tokens")).cast(df.schema[c].dataType))
    df = df.withColumns({marked: full(marked), unmarked: full(unmarked)})
    m, u = F.col(marked), F.col(unmarked)
    total = F.least(F.size(m) + F.size(u), F.greatest(F.size(m), F.size(u)))
    df = df.withColumn("_m", F.greatest(F.lit(1), F.least(F.size(m), F.bround(total * F.lit(float(fraction))).cast("int")))).withColumn("_u", F.least(F.size(u), total - F.col("_m")))
    if seed is not None:
        df = df.withColumn("_at", _split_points(seed, F.col("_u")))
        split = F.col("_at")
    at = F.least(split if split is not None else F.lit(0), F.col("_u")).cast("int")
    one = [(F.slice(u, 1, at), False), (F.slice(m, F.lit(1), F.col("_m")), True), (F.slice(u, at + 1, F.col("_u") - at), False)]
    half, cut = F.floor(F.col("_m") / 2).cast("int"), F.least(F.col("_u"), F.greatest(F.lit(1), F.floor(F.col("_u") / 2).cast("int")))
    two = [(F.slice(m, F.lit(1), half), True), (F.slice(u, F.lit(1), cut), False), (F.slice(m, half + 1, F.col("_m") - half), True), (F.slice(u, cut + 1, F.col("_u") - cut), False)]
    pack = lambda parts: F.array(*[F.struct(t.alias("tokens"), F.lit(k).alias("marked")) for t, k in parts])
    pieces = F.filter(F.when(F.lit(separated) & (F.col("_m") >= 2), pack(two)).otherwise(pack(one)), lambda p: F.size(p["tokens"]) > 0)
    df = df.withColumn("_pieces", pieces).withColumn("tokens", F.flatten(F.transform("_pieces", lambda p: p["tokens"])))
    before = lambda i: F.aggregate(F.slice("_pieces", 1, i), F.lit(0), lambda s, p: s + F.size(p["tokens"]))
    df = df.withColumn("segments", F.transform("_pieces", lambda p, i: F.struct(before(i).alias("start"), (before(i) + F.size(p["tokens"])).alias("end"), p["marked"].alias("marked"))))
    count = F.aggregate("segments", F.lit(0), lambda s, x: s + F.when(x["marked"], x["end"] - x["start"]).otherwise(0))
    return df.withColumn("realized_fraction", count / F.size("tokens")).drop("_m", "_u", "_at", "_pieces")


def split_point(seed: int, unmarked_count: int) -> int:
    """Where marked tokens stand among unmarked ones."""
    return seeded_random(seed, "composition").randrange(unmarked_count + 1)


def _split_points(seed: Column, unmarked_count: Column) -> Column:
    """split_point() of each row: the generator is Python's, as its draws are what a study has to agree on."""

    def points(seeds: pd.Series, counts: pd.Series) -> pd.Series:
        return pd.Series([split_point(int(s), int(n)) for s, n in zip(seeds, counts, strict=True)], dtype="int32")

    return F.pandas_udf(points, "int")(seed, unmarked_count)
