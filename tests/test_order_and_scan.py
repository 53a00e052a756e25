"""Exact order statistics, prefix scans, sweeps, window rescoring, draws and intervals, each against a plain Python form."""

from __future__ import annotations

import math
import random
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfold.functions.statistics import from_sortable, interval, next_up, with_sortable
from lumenfold.operators import calibrate, ledger, metrics, order, scan, windows

AWKWARD = [0.0, -0.0, 5e-324, -5e-324, 1e-320, 2.0**-1022, 2.0**-1023, 1.7976931348623157e308, -1.7976931348623157e308, 1.0, math.nextafter(1.0, 0), math.nextafter(1.0, 2), 0.1, -0.1, 1 / 3, 2.0**-500, 2.0**500, 8.0, math.nextafter(8.0, 0), 1e300, -1e-300]


def test_doubles_as_sortable_integers(spark):
    rng = random.Random(1)
    values = AWKWARD + [rng.uniform(-1, 1) * 10.0 ** rng.randint(-320, 308) for _ in range(3000)] + [2.0**e for e in range(-1074, 1024)] + [math.nextafter(2.0**e, 0) for e in range(-1070, 1024)]
    rows = with_sortable(spark.createDataFrame([(v,) for v in values], "v double"), F.col("v"), "k").select("v", "k", from_sortable(F.col("k")).alias("back"), F.when(F.col("v") < 1e308, next_up(F.col("v"))).alias("up")).collect()
    for r in rows:
        bits = int(np.float64(abs(r["v"])).view(np.int64))
        assert r["k"] == (-bits if r["v"] < 0 else bits) and r["back"] == r["v"]
        assert r["up"] is None or r["up"] == math.nextafter(r["v"], math.inf)


def test_order_statistics_against_sorting(spark):
    rng = random.Random(2)
    rows = [(g, x) for g in ("a", None, "b") for x in (rng.choice([0.0, -0.0, 1.5, -2.5, rng.gauss(0, 1e-3), rng.gauss(0, 1e6)]) for _ in range(400))]
    rows += [("ties", 7.0)] * 500 + [("one", -3.0)] + [("close", 1 + i * 2.0**-52) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(5)
    wanted = (0, 3, 17, 199, 10_000)
    found = order.order_statistics(df, ["g"], "x", lambda n: F.array(*[F.lit(w) for w in wanted], n - 1, F.lit(-4))).collect()
    groups = defaultdict(list)
    for g, x in rows:
        groups[g].append(x)
    assert {r["g"] for r in found} == set(groups)
    for r in found:
        values = sorted(groups[r["g"]])
        n = len(values)
        assert r["n"] == n
        for w, p in zip((*wanted, n - 1, -4), r["picks"], strict=True):
            at = max(0, min(w, n - 1))
            assert (p["rank"], p["value"]) == (at, values[at])
            assert p["below"] == sum(v < values[at] for v in values) and p["ties"] == values.count(values[at])
    plan = order.order_statistics(df, ["g"], "x", lambda n: F.array(n - 1))._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "percentile" not in plan and "Python" not in plan


def test_quantiles_without_groups_and_of_nothing(spark):
    df = spark.createDataFrame([(float(i),) for i in range(11)], "x double")
    assert order.quantiles(df, [], "x", (0.0, 0.25, 0.5, 1.0)).first()["quantiles"] == [0.0, 2.5, 5.0, 10.0]
    assert order.quantiles(df.where("false"), [], "x", (0.5,)).count() == 0
    for bad in (float("nan"), float("inf"), None):
        with pytest.raises(Exception, match="finite"):
            order.quantiles(spark.createDataFrame([(1.0,), (bad,)], "x double"), [], "x", (0.5,)).collect()


@pytest.mark.parametrize(("comparator", "threshold"), [(">", 98.0), (">=", 99.0)])
def test_calibration_of_distinct_and_tied_scores(spark, comparator, threshold):
    rows = [("distinct", float(i)) for i in range(100)] + [("tied", x) for x in [9.0, 9.0, *([0.0] * 98)]] + [("equal", 4.0)] * 100 + [("few", 1.0), ("few", 2.0)]
    found = {r["c"]: r for r in calibrate.calibrated(spark.createDataFrame(rows, "c string, score double"), ["c"], 0.01, comparator).collect()}
    assert (found["distinct"]["threshold"], found["distinct"]["false_positive_count"], found["distinct"]["resolution_status"]) == (threshold, 1, "RESOLVED")
    assert found["tied"]["false_positive_count"] == found["equal"]["false_positive_count"] == found["few"]["false_positive_count"] == 0
    assert found["few"]["resolution_status"] == "UNRESOLVED" and found["few"]["negative_count"] == 2


@pytest.mark.parametrize("comparator", [">", ">="])
def test_calibration_against_sorting(spark, comparator):
    rng = random.Random(9)
    groups = {k: [float(rng.randint(0, 30)) if k % 2 else rng.random() for _ in range(rng.randint(1, 200))] for k in range(12)}
    df = spark.createDataFrame([(k, x) for k, xs in groups.items() for x in xs], "c int, score double")
    for r in calibrate.calibrated(df, ["c"], 0.07, comparator).collect():
        xs = sorted(groups[r["c"]], reverse=True)
        allowed = math.floor(0.07 * len(xs))
        if comparator == ">":
            want = xs[allowed] if allowed < len(xs) else xs[-1]
        else:
            want = math.nextafter(xs[0], math.inf) if allowed == 0 else xs[allowed - 1] if sum(x >= xs[allowed - 1] for x in xs) <= allowed else math.nextafter(xs[allowed - 1], math.inf)
        hits = sum(x > want if comparator == ">" else x >= want for x in xs)
        assert (r["threshold"], r["maximum_allowed_false_positives"], r["false_positive_count"], r["negative_count"]) == (want, allowed, hits, len(xs))


def test_calibration_refuses_what_is_no_score(spark):
    for bad in (float("nan"), float("inf"), float("-inf"), None):
        with pytest.raises(Exception, match="finite"):
            calibrate.calibrated(spark.createDataFrame([("a", 1.0), ("a", bad)], "c string, score double"), ["c"], 0.5, ">").collect()
    with pytest.raises(Exception, match="without scored units"):
        calibrate.calibrated(spark.createDataFrame([(0, 1.0)], "scored_unit_count int, score double"), ["scored_unit_count"], 0.5, ">").collect()
    for rate in (0, 1):
        with pytest.raises(ValueError):
            calibrate.calibrated(spark.createDataFrame([("a", 1.0)], "c string, score double"), ["c"], rate, ">")


def test_selection_refuses_two_thresholds_of_one_context(spark):
    thresholds = spark.createDataFrame([("a", 5, 1.0), ("a", 5, 2.0), ("b", 5, 3.0)], "scheme string, scored_unit_count int, threshold double")
    ask = lambda s: calibrate.selected(spark.createDataFrame([(s, 5, 1.5)], "scheme string, scored_unit_count int, score double"), thresholds, ["scheme", "scored_unit_count"])
    assert ask("b").first()["threshold"] == 3.0 and ask("c").first()["status"] == "UNRESOLVED"
    with pytest.raises(Exception, match="duplicate threshold"):
        calibrate.decided(ask("a"), ">=").collect()


def test_provenance_of_a_calibration(spark):
    rows = [("a", f"s{i}", i / 7) for i in range(50)] + [(None, "x", 1.0)]
    schema = "c string, sample_id string, score double"
    of = lambda r, n=2: {x["c"]: x["calibration_sha256"] for x in calibrate.calibrated(spark.createDataFrame(r, schema).repartition(n), ["c"], 0.1, ">", sample="sample_id").collect()}
    first = of(rows)
    assert first == of(rows[::-1], 5) and set(first) == {"a", None}
    assert first["a"] != of([*rows[1:], ("a", "s0", 0.5)])["a"] and first["a"] != of([*rows, rows[0]])["a"]


def test_running_aggregates_against_a_loop(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(rng.choice(["a", None]), rng.choice([rng.randint(-(1 << 40), 1 << 40), rng.randint(-3, 3)]), rng.randint(0, 9)) for _ in range(600)]
    df = spark.createDataFrame(rows, "g string, o long, v int")
    for op, fold in (("sum", sum), ("max", max)):
        for r in scan.running_before(df, ["g"], "o", F.col("v"), op, "b").collect():
            earlier = [v for g, o, v in rows if g == r["g"] and o < r["o"]]
            assert r["b"] == (fold(earlier) if earlier else None)
    doubles = spark.createDataFrame([(x, i) for i, x in enumerate(sorted(set(AWKWARD)))], "o double, v int")
    assert all(r["b"] == (r["v"] - 1 if r["v"] else None) for r in scan.running_before(doubles, [], "o", F.col("v"), "max", "b").collect())


def test_no_scan_passes_everything_through_one_window(spark):
    lines = spark.createDataFrame([(1, "x")], "ordinal long, value string")
    points = spark.createDataFrame([("a", 0.1, 0.2)], "k string, damage double, survival double")
    for df in (ledger.parsed_checksums(lines), metrics.pareto_frontier(points, ["k"])):
        found = [x for x in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Window [" in x]
        # three levels by their range, and at the top at most 2^16 ranges of a group
        assert len(found) == scan.DEPTH + 1 and sum("k3#" in x.split("windowspecdefinition")[1].split("ASC")[0].split(",")[-1] for x in found) == 1


def test_frontier_against_all_pairs(spark):
    rng = random.Random(4)
    rows = [(rng.choice("ab"), rng.choice([0.0, 1.0, rng.random()]), rng.choice([0.0, 1.0, rng.random()])) for _ in range(300)]
    found = sorted(tuple(r) for r in metrics.pareto_frontier(spark.createDataFrame(rows, "k string, damage double, survival double"), ["k"]).collect())
    want = sorted({(k, d, s) for k, d, s in rows if not any(k2 == k and (d2 < d and s2 >= s or d2 == d and s2 > s) for k2, d2, s2 in rows)})
    assert found == want


def test_overlap_counts_against_pairs(spark):
    rng = random.Random(5)
    span = lambda: (lambda a: (a, a + rng.choice([0, 0, 1, 5, 2000])))(rng.randint(-5, 40))
    left, right = [(rng.choice(["x", None]), *span(), i) for i in range(200)], [(rng.choice(["x", None, "y"]), *span()) for _ in range(200)]
    out = windows.overlap_counts(spark.createDataFrame(left, "k string, start long, end long, i int"), spark.createDataFrame(right, "k string, start long, end long"), ["k"])
    found = {r["i"]: r["overlaps"] for r in out.collect()}
    assert found == {i: sum(k == k2 and a < b2 and a2 < b for k2, a2, b2 in right) for k, a, b, i in left}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "NestedLoop" not in plan
    with pytest.raises(Exception, match="ordered"):
        windows.overlap_counts(spark.createDataFrame([("x", 3, 1)], "k string, start long, end long"), spark.createDataFrame(right, "k string, start long, end long"), ["k"]).collect()


def plain_window(t, width, window, stride, gamma=0.25):
    best, m = None, 0
    for s in range(0, len(t) - window + 1, stride):
        m += 1
        w = t[s : s + window]
        grams = {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) > width else set()
        g = sum(sum(x) % 4 == 0 for x in grams)
        z = (g - gamma * len(grams)) / math.sqrt(len(grams) * gamma * (1 - gamma)) if grams else 0.0
        if best is None or z > best[2]:
            best = (s, s + window, z, len(grams), g)
    return m, best


@pytest.mark.parametrize(("width", "window", "stride"), [(4, 16, 8), (2, 7, 1), (3, 3, 2), (1, 5, 3), (4, 20, 40)])
def test_window_rescoring_against_slices(spark, width, window, stride):
    rng = random.Random(width * window)
    texts = [[rng.randint(0, rng.choice([1, 3, 50])) for _ in range(rng.randint(0, 90))] for _ in range(60)] + [[], [1] * 60]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t array<int>")
    green = lambda g: F.aggregate(g, F.lit(0), lambda s, x: s + x) % 4 == 0
    for r in windows.ngram_window_maximum(df, "t", green, width, window, stride).collect():
        m, best = plain_window(texts[r["i"]], width, window, stride)
        assert r["window_count"] == m
        if best is None:
            assert r["window_start"] is None
        else:
            assert (r["window_start"], r["window_end"], r["scored_units"], r["green_count"]) == (best[0], best[1], best[3], best[4]) and abs(r["window_score"] - best[2]) < 1e-12


def test_window_rescoring_is_linear():
    rng = np.random.default_rng(1)
    start = time.perf_counter()
    units, greens = windows._windows_of_grams(rng.integers(0, 50, 400_000), rng.random(400_000) < 0.25, 4, 5_000, 1)
    assert len(units) == 395_001 and time.perf_counter() - start < 5


@pytest.mark.parametrize("high", [3, 1 << 40])
def test_windows_of_many_rows_at_once(high):
    rng = np.random.default_rng(4)
    lengths = rng.integers(9, 60, 200)
    tokens = [rng.integers(0, high, n) % (high if i % 2 else 2) for i, n in enumerate(lengths)]
    flags = [rng.random(n - 3) < 0.5 for n in lengths]
    for wide in (4, 30):  # 30 tokens are more than a number holds
        rows = [i for i, n in enumerate(lengths) if n >= wide + 5]
        cut = [flags[i][: lengths[i] - wide + 1] for i in rows]
        got = windows._windows_of_rows(lengths[rows], np.concatenate([tokens[i] for i in rows]), np.concatenate(cut), wide, wide + 5, 2)
        grams = lambda t, s: [tuple(t[j : j + wide]) for j in range(s, s + 6)]
        want = [len(set(grams(tokens[i], s))) for i in rows for s in range(0, lengths[i] - wide - 4, 2)]
        assert got[0].tolist() == want


def test_interior_intervals(spark):
    """Bounds at which the binomial tails, summed term by term, are 2.5 per cent; and equal-tailed bounds for known pairs."""
    pairs = [(5, 20), (1, 10), (9, 10), (1, 2), (3, 1000), (500, 1000), (997, 1000), (37, 4321), (1, 100_000), (99_999, 100_000)]
    rows = spark.createDataFrame([(k, n) for k, n in pairs], "k long, n long").withColumn("i", interval(F.col("k"), F.col("n"))).collect()

    def tail(k, n, p):  # P(X >= k), the smaller side summed
        term = lambda i: math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p))
        return math.fsum(term(i) for i in range(k, n + 1)) if k > n * p else 1 - math.fsum(term(i) for i in range(k))

    for r in rows:
        k, n, low, high = r["k"], r["n"], r["i"]["lower"], r["i"]["upper"]
        assert 0 < low < k / n < high < 1
        assert abs(tail(k, n, low) / 0.025 - 1) < 2e-8 and abs(tail(n - k, n, 1 - high) / 0.025 - 1) < 2e-8
    by = {(r["k"], r["n"]): r["i"] for r in rows}
    assert (by[5, 20]["lower"], by[5, 20]["upper"]) == pytest.approx((0.08657146910143461, 0.49104587170795744), abs=1e-13)
    assert (by[1, 2]["lower"], by[1, 2]["upper"]) == pytest.approx((1 - math.sqrt(0.975), math.sqrt(0.975)), abs=1e-14)


def test_interval_ends_and_large_counts(spark):
    pairs = [(0, 1), (1, 1), (0, 100), (20, 20), (0, 0), (None, 5), (500_000_000, 1_000_000_000), (3, 1_000_000_000), (500, 100_000)]
    df = spark.createDataFrame(pairs, "k long, n long")
    rows = {(r["k"], r["n"]): r["i"] for r in df.select("k", "n", interval(F.col("k"), F.col("n")).alias("i")).collect()}
    assert rows[0, 1]["lower"] == 0 and abs(rows[0, 1]["upper"] - 0.975) < 1e-15 and abs(rows[1, 1]["lower"] - 0.025) < 1e-15 and rows[20, 20]["upper"] == 1
    assert rows[0, 0] is None and rows[None, 5] is None
    half = 1.959963984540054 * math.sqrt(0.25 / 1e9)
    assert abs(rows[500_000_000, 1_000_000_000]["lower"] - (0.5 - half)) < 2e-9
    # three of very many is a Poisson count: its exact bounds are 0.6187 and 8.7673
    assert rows[3, 1_000_000_000]["lower"] * 1e9 == pytest.approx(0.61867, abs=1e-4) and rows[3, 1_000_000_000]["upper"] * 1e9 == pytest.approx(8.76727, abs=1e-4)
    start = time.perf_counter()
    spark.range(200).select(interval(F.col("id") * 1_000_000 + 1, F.lit(1_000_000_000)).alias("i")).agg(F.sum("i.lower")).collect()
    assert time.perf_counter() - start < 10
    with pytest.raises(Exception, match="successes"):
        df.select(interval(F.lit(3), F.lit(2)).alias("i")).collect()


def plain_nucleus(logits, temperature, top_k, top_p):
    x = [(v / temperature, -i) for i, v in enumerate(logits)]
    if top_k:
        bound = sorted((v for v, _ in x), reverse=True)[min(top_k, len(x)) - 1]
        x = [y for y in x if y[0] >= bound]
    x.sort(reverse=True)
    e = [math.exp(v - x[0][0]) for v, _ in x]
    p = [v / sum(e) for v in e]
    kept, total = [], 0.0
    for (_, i), q in zip(x, p, strict=True):
        if kept and total > top_p:
            break
        kept.append((-i, q))
        total += q
    return [(i, q / total) for i, q in kept]


@pytest.mark.parametrize(("temperature", "top_k", "top_p"), [(1.0, None, None), (0.8, 3, 0.95), (0.5, 0, 0.5), (2.0, 50, 0.01)])
def test_nucleus_against_a_loop(spark, temperature, top_k, top_p):
    rng = random.Random(7)
    rows = [[rng.choice([rng.gauss(0, 2), 1.0, -3.0]) for _ in range(rng.randint(1, 12))] for _ in range(50)]
    df = spark.createDataFrame(list(enumerate(rows)), "i int, l array<double>")
    kept = {r["i"]: [(x["token"], x["p"]) for x in r["kept"]] for r in metrics.filtered_probabilities(df, "l", temperature, top_k, top_p).collect()}
    drawn = {r["i"]: r for r in metrics.drawn_tokens(df, "l", 11, ["i"], temperature, top_k, top_p).withColumn("u", metrics.uniform(11, F.col("i"))).collect()}
    for i, logits in enumerate(rows):
        want = plain_nucleus(logits, temperature, top_k, 1.0 if top_p is None else top_p)
        assert [t for t, _ in kept[i]] == [t for t, _ in want] and np.allclose([p for _, p in kept[i]], [p for _, p in want])
        total = 0.0
        for token, p in want:
            total += p
            if total > drawn[i]["u"]:
                break
        assert drawn[i]["token"] == token and drawn[i]["kept_n"] == len(want)


def test_draws_follow_their_probabilities_and_are_quick(spark):
    df = spark.range(4000).select("id", F.array(F.lit(math.log(6.0)), F.lit(math.log(3.0)), F.lit(0.0)).alias("l"))
    counts = Counter(r["token"] for r in metrics.drawn_tokens(df, "l", 3, ["id"], 1.0, None, None).collect())
    assert all(abs(counts[t] / 4000 - p) < 0.03 for t, p in enumerate((0.6, 0.3, 0.1)))
    again = metrics.drawn_tokens(df.repartition(5), "l", 3, ["id"], 1.0, None, None)
    assert Counter(r["token"] for r in again.collect()) == counts
    start = time.perf_counter()
    tokens, _ = metrics._nucleus(np.random.default_rng(2).normal(size=50_000) * 3, 0.8, 0, 0.95)
    assert time.perf_counter() - start < 1 and len(tokens) > 1
    for bad in ([], [float("nan")], [float("inf"), 1.0]):
        with pytest.raises(Exception, match="finite"):
            metrics.drawn_tokens(spark.createDataFrame([(1, bad)], "id int, l array<double>"), "l", 1, ["id"]).collect()
    assert metrics.drawn_tokens(spark.createDataFrame([(1, None)], "id int, l array<double>"), "l", 1, ["id"]).first()["token"] is None
    for wrong in ((0, 1, 0.5), (1.0, -1, 0.5), (1.0, 1, 0.0), (1.0, 1, 1.5)):
        with pytest.raises(ValueError):
            metrics.drawn_tokens(df, "l", 1, ["id"], *wrong)


def test_checksum_lines_in_order(spark):
    h = "0" * 64
    names = ["a", "b", "b", "A", "c", "d"]
    lines = spark.createDataFrame([(i * 70_000, f"{h}  {n}") for i, n in enumerate(names)], "ordinal long, value string").repartition(4)
    assert [r["problem"] for r in ledger.parsed_checksums(lines).orderBy("ordinal").collect()] == [None, None, "duplicate", "order", None, None]


def test_marked_tokens_stand_where_each_seed_puts_them(spark):
    rows = [(i, [1] * (3 + i % 4), [0] * (12 + i)) for i in range(30)]
    df = spark.createDataFrame(rows, "seed long, m array<int>, u array<int>").repartition(3)
    for r in windows.composed(df, "m", "u", 0.25, False, seed=F.col("seed")).collect():
        marked = sum(r["tokens"])
        assert r["tokens"].index(1) == windows.split_point(r["seed"], len(r["tokens"]) - marked)
        assert [s["end"] - s["start"] for s in r["segments"] if s["marked"]] == [marked]
    assert len({r["tokens"].index(1) for r in windows.composed(df, "m", "u", 0.25, False, seed=F.col("seed")).collect()}) > 3
