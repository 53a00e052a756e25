"""Seeds, splits, calibration, windows, metrics, transforms, quality, ledgers."""

from __future__ import annotations

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumenfold.functions import hashing
from lumenfold.functions.statistics import interval
from lumenfold.operators import c2pa, calibrate, evidence, ledger, metrics, quality, samples, transforms, windows


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_seeds_agree_between_python_and_spark(spark):
    df = spark.range(5).select(hashing.derived_seed(F.lit(42), F.col("id"), 64).cast("string"), hashing.derived_seed(F.lit(42), F.col("id"), 31).cast("long"), hashing.third(F.col("id"), 7))
    for i, (wide, narrow, third) in enumerate(rows(df)):
        assert int(wide) == hashing.derive_seed(42, str(i), 64) and narrow == hashing.derive_seed(42, str(i), 31)
        import hashlib

        assert third == int.from_bytes(hashlib.sha256(f"{hashing.SPLIT_DOMAIN}\0{7}\0{i}".encode()).digest()[:8], "big") % 3
    keys = hashing.distinct_keys(1)
    assert len(set(keys)) == 30 and all(0 < k < 2**31 for k in keys)


def test_seeds_keys_and_draws_by_their_formulas(spark):
    """Written from the formulas: SHA-256 of tag, seed and namespace with NUL between them, its last bits as a number."""
    import hashlib
    import random

    number = lambda tag, seed, name: int.from_bytes(hashlib.sha256(f"{tag}\0{seed}\0{name}".encode()).digest(), "big")
    assert hashing.derive_seed(5, "a", domain="tag") == number("tag", 5, "a") % 2**63
    assert hashing.benchmark_key(5, "m", "tag") == (number("tag", 5, "benchmark-key/m") % 2**63 or 1)
    assert hashing.distinct_keys(5, 4, "tag") == [number("tag", 5, f"synthid/key/{i}") % 2**31 for i in range(4)]
    assert windows.split_point(5, 9) == random.Random(number(hashing.SEED_DOMAIN, 5, "composition") % 2**63).randrange(10)
    tokens = list(range(12))
    rng = random.Random(number("tag", 5, "random_deletion") % 2**63)
    gone = set(rng.sample(range(12), 3))
    assert transforms.edited(tokens, [], 0.25, 5, "random_deletion", "tag")[0] == [t for t in tokens if t not in gone]
    rng, out = random.Random(number("tag", 5, "random_substitution") % 2**63), list(tokens)
    for i in rng.sample(range(12), 3):
        out[i] = rng.choice([v for v in (3, 5, 40) if v != out[i]])
    assert transforms.edited(tokens, [3, 5, 40], 0.25, 5, "random_substitution", "tag")[0] == out
    df = spark.createDataFrame([(tokens, 5)], "t array<int>, s long")
    found = transforms.token_edit(df, "t", F.col("s"), "random_substitution", 0.25, [3, 5, 40], domain="tag").first()
    assert found["edited"]["token_ids"] == out
    for bad in ((-1, "a", 63), (1, "", 63), (1, "a", 0), (1, "a", 257)):
        with pytest.raises(ValueError):
            hashing.derive_seed(*bad)


def test_splits_by_their_formulas(spark):
    import hashlib

    ids = [f"s{i}" for i in range(40)]
    digest = lambda tag, i: hashlib.sha256(f"{tag}\0{7}\0{i}".encode()).digest()
    df = spark.createDataFrame([(i,) for i in ids], "id string")
    names = ("generation", "calibration", "test")
    assert dict(rows(samples.assign_splits(df, "id", 7, "tag").select("id", "split"))) == {i: names[int.from_bytes(digest("tag", i)[:8], "big") % 3] for i in ids}
    ranked = sorted(ids, key=lambda i: digest("tag", i))
    out = samples.fixed_count_splits(df, "id", 5, 7, domain="tag")
    assert dict(rows(out.select("id", "split"))) == {i: names[k // 5] for k, i in enumerate(ranked[:15])}
    grouped = samples.fixed_count_splits(df.withColumn("g", F.right("id", F.lit(1))), "id", 5, 7, ["g"], strict=False)
    assert "WindowGroupLimit" in grouped._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(Exception, match="fewer"):
        samples.fixed_count_splits(df, "id", 14, 7).collect()
    with pytest.raises(Exception, match="twice"):
        samples.fixed_count_splits(df.unionAll(df), "id", 5, 7).collect()
    with pytest.raises(ValueError):
        samples.require_splits(samples.assign_splits(df.limit(1), "id", 7))


def test_composition_errors(spark):
    df = spark.createDataFrame([([1, 2], [])], "m array<int>, u array<int>")
    with pytest.raises(ValueError):
        windows.composed(df, "m", "u", 0.0, True)
    with pytest.raises(Exception, match="both sides"):
        windows.composed(df, "m", "u", 0.5, True).collect()


def test_canonical_json():
    assert hashing.canonical_json({"é": [1, True], "a": 2}) == '{"a":2,"é":[1,true]}'
    with pytest.raises(ValueError):
        hashing.canonical_json({"x": math.nan})
    with pytest.raises(ValueError):
        hashing.no_duplicate_keys('{"a":1,"a":2}')


def threshold(spark, values, comparator, fpr=0.01):
    df = spark.createDataFrame([(None, float(v)) for v in values], "task string, score double")
    return calibrate.calibrated(df, ["task"], fpr, comparator).first()


@pytest.mark.parametrize(("values", "comparator", "expected", "fp"), [
    (range(100), ">", 98, 1), (range(100), ">=", 99, 1), ([9, 9] + [0] * 98, ">", 9, 0), ([9, 9] + [0] * 98, ">=", math.nextafter(9, math.inf), 0), ([4] * 100, ">", 4, 0), ([4] * 100, ">=", math.nextafter(4, math.inf), 0),
])
def test_calibration_vectors(spark, values, comparator, expected, fp):
    found = threshold(spark, values, comparator)
    assert found["threshold"] == expected and found["false_positive_count"] == fp


def test_calibration_resolution(spark):
    assert threshold(spark, [1, 2], ">")["resolution_status"] == "UNRESOLVED"
    assert threshold(spark, range(99), ">")["resolution_status"] == "UNRESOLVED" and threshold(spark, range(100), ">")["resolution_status"] == "RESOLVED"


def test_calibration_against_sorting(spark):
    rng = np.random.default_rng(0)
    data = [(int(g), float(v)) for g in range(12) for v in rng.integers(0, 9, int(rng.integers(1, 60)))]
    df = spark.createDataFrame(data, "g int, score double")
    for comparator in (">", ">="):
        for r in calibrate.calibrated(df, ["g"], 0.2, comparator).collect():
            down = sorted((v for g, v in data if g == r["g"]), reverse=True)
            allowed = math.floor(0.2 * len(down))
            if comparator == ">":
                t = down[allowed] if allowed < len(down) else down[-1]
            elif allowed == 0:
                t = math.nextafter(down[0], math.inf)
            else:
                t = down[allowed - 1] if sum(v >= down[allowed - 1] for v in down) <= allowed else math.nextafter(down[allowed - 1], math.inf)
            assert r["threshold"] == t and r["maximum_allowed_false_positives"] == allowed


def test_selection(spark):
    thresholds = spark.createDataFrame([("a", None, 10, 1.0), ("a", None, 20, 2.0)], "scheme string, operation string, scored_unit_count int, threshold double")
    requests = spark.createDataFrame([("a", None, u, 1.5) for u in (10, 5, 0, 15, 25)] + [("b", None, 10, 1.5), ("a", "x", 10, 1.5)], "scheme string, operation string, scored_unit_count int, score double")
    out = calibrate.decided(calibrate.selected(requests, thresholds, ["scheme", "operation", "scored_unit_count"]), ">=")
    found = {(r["scheme"], r["operation"], r["scored_unit_count"]): (r["status"], r["decision_status"]) for r in out.collect()}
    assert found == {("a", None, 10): ("SELECTED", "DETECTED"), ("a", None, 5): ("UNSUPPORTED", "UNSUPPORTED"), ("a", None, 0): ("UNSUPPORTED", "UNSUPPORTED"), ("a", None, 15): ("UNRESOLVED", "UNRESOLVED"), ("a", None, 25): ("UNRESOLVED", "UNRESOLVED"), ("b", None, 10): ("UNRESOLVED", "UNRESOLVED"), ("a", "x", 10): ("UNRESOLVED", "UNRESOLVED")}
    assert calibrate.duplicates(thresholds.unionAll(thresholds), ["scheme", "operation", "scored_unit_count"]).count() == 2


def test_intervals(spark):
    pairs = spark.createDataFrame([(0, 1), (0, 100), (5, 20), (20, 20)], "k long, n long")
    found = {(r["k"], r["n"]): tuple(r["i"]) for r in pairs.select("k", "n", interval(F.col("k"), F.col("n")).alias("i")).collect()}
    assert found[0, 1][0] == 0.0 and abs(found[0, 1][1] - 0.975) < 1e-15
    assert 0.03 < found[0, 100][1] < 0.04
    low, high = found[5, 20]
    assert abs(low - 0.08657147) < 1e-6 and abs(high - 0.49104587) < 1e-6
    assert found[20, 20][1] == 1.0


def test_windows(spark):
    df = spark.createDataFrame([([0, 0, 9, 9, 0],), ([1],), ([5, 5, 5],)], "tokens array<int>")
    out = windows.window_maximum(df, "tokens", 2, 1, lambda x: F.aggregate(x, F.lit(0), lambda s, v: s + v))
    assert rows(out.select("window_start", "window_end", "window_score", "window_count")) == [(2, 4, 18.0, 4), (None, None, None, 0), (0, 2, 10.0, 2)]


@pytest.mark.parametrize(("pred", "truths", "iou", "overlap"), [((10, 20), [(10, 20)], 1, 10), ((10, 20), [(15, 25)], 1 / 3, 5), ((0, 5), [(10, 20)], 0, 0), ((0, 10), [(0, 5), (8, 12)], 7 / 12, 7), ((0, 1), [(1, 2)], 0, 0)])
def test_localization(spark, pred, truths, iou, overlap):
    df = spark.createDataFrame([(*pred, truths)], "pred_start int, pred_end int, truths array<struct<start:int,end:int>>")
    found = windows.localized(df).first()
    assert abs(found["iou"] - iou) < 1e-12 and found["overlap_token_count"] == overlap


def test_localization_rejects_overlapping_truths(spark):
    df = spark.createDataFrame([(0, 1, [(0, 5), (4, 6)])], "pred_start int, pred_end int, truths array<struct<start:int,end:int>>")
    with pytest.raises(Exception, match="overlap"):
        windows.localized(df).collect()


def test_overlapping_spans(spark):
    rng = np.random.default_rng(2)
    make = lambda: [(int(rng.integers(0, 2)), int(s), int(s + rng.integers(1, 3000))) for s in rng.integers(0, 9000, 40)]
    a, b = make(), make()
    schema = "k int, start long, end long"
    out = windows.overlapping(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), ["k"])
    expected = sorted((x[0], *x[1:], *y[1:]) for x in a for y in b if x[0] == y[0] and x[1] < y[2] and y[1] < x[2])
    assert sorted(rows(out.select("k", "a_start", "a_end", "b_start", "b_end"))) == expected


def test_composition(spark):
    df = spark.createDataFrame([([1] * 10, [0] * 20)], "m array<int>, u array<int>")
    one = windows.composed(df, "m", "u", 0.25, False, F.lit(3)).first()
    assert [(s["start"], s["end"], s["marked"]) for s in one["segments"]] == [(0, 3, False), (3, 8, True), (8, 20, False)] and one["realized_fraction"] == 0.25
    two = windows.composed(df, "m", "u", 0.25, True).first()
    assert [s["marked"] for s in two["segments"]] == [True, False, True, False] and sum(two["tokens"]) == 5


def test_aggregation_keeps_open_decisions_open(spark):
    data = [("a", None, "watermarked", True, None, 1.0), ("a", None, "unwatermarked", None, "UNSUPPORTED", 2.0), ("a", "s", "unwatermarked", False, None, 3.0), ("b", None, "unwatermarked", None, "UNRESOLVED", 4.0)]
    df = spark.createDataFrame(data, "scheme string, task string, label string, decision boolean, decision_status string, score double")
    out = {(r["scheme"], r["task"]): r for r in metrics.aggregated(df, 0.01, ["scheme", "task"]).collect()}
    assert out["a", None]["negative_n"] == 0 and out["a", None]["resolution_status"] == "UNSUPPORTED" and out["a", None]["tpr"] is None
    assert out["a", "s"]["empirical_fpr"] == 0.0 and out["a", "s"]["fpr_interval"]["upper"] == 0.975 and out["a", "s"]["resolution_status"] == "UNRESOLVED"
    assert out["b", None]["empirical_fpr"] is None and out["b", None]["resolution_status"] == "UNRESOLVED"
    ids = metrics.with_id(metrics.aggregated(df, 0.01, ["scheme", "task"]), ["scheme", "task"])
    assert ids.select("aggregate_id").distinct().count() == 3


def test_detector_vectors(spark):
    df = spark.createDataFrame([(4, 15)], "g int, t int")
    z = df.select(metrics.z_of_counts(F.col("g"), F.col("t"), 0.25)).first()[0]
    assert abs(z - 0.14907119849998599) < 1e-12
    scored = spark.createDataFrame([(list(range(4)),), (list(range(18)) + list(range(18)),)], "tokens array<int>")
    out = metrics.ngram_z(scored, "tokens", lambda g: g[0] % 4 == 0).select("scored_units", "green_count", "p_value").collect()
    assert tuple(out[0]) == (0, 0, 1.0) and out[1]["scored_units"] == 18
    values = [[1.0, 0.0], [0.0, 1.0], [1.0, 1.0]]
    g = spark.createDataFrame([(values, [True, True, False])], "g array<array<double>>, m array<boolean>")
    w = np.linspace(10, 1, 2) / np.linspace(10, 1, 2).mean()
    assert abs(g.select(metrics.weighted_mean(F.col("g"), F.col("m"), 2)).first()[0] - (w[0] + w[1]) / 4) < 1e-12


@pytest.mark.parametrize("history", [None, 3])
def test_repetition_mask(spark, history):
    tokens = [1, 2, 1, 2, 1, 2, 3, 1, 2, 9, 1, 2]
    found = spark.createDataFrame([(tokens,), ([1],)], "t array<int>").select(metrics.repetition_mask(F.col("t"), 2, history)).collect()
    contexts = [tuple(tokens[i : i + 2]) for i in range(len(tokens) - 2)]
    expected = [c not in contexts[max(0, i - history) if history else 0 : i] for i, c in enumerate(contexts)]
    assert found[0][0] == expected and found[1][0] == []


def test_entropy(spark):
    p = metrics.with_probabilities(spark.createDataFrame([([0.0, 0.0],)], "l array<double>"), "l")
    h, s = p.select(metrics.shannon(F.col("probabilities")), metrics.spike(F.col("probabilities"))).first()
    assert abs(h - math.log(2)) < 1e-12 and abs(s - 1 / (1 + math.tanh(1) / 2)) < 1e-12
    with pytest.raises(Exception, match="finite"):
        metrics.summarized(spark.createDataFrame([("a", float("nan"))], "k string, v double"), ["k"], "v").collect()


def test_sampling_filters(spark):
    df = spark.createDataFrame([([2.0, 1.0, 1.0, -5.0],)], "l array<double>")
    assert [x["token"] for x in metrics.filtered_probabilities(df, "l", 1.0, 2, None).first()["kept"]] == [0, 1, 2]
    assert [x["token"] for x in metrics.filtered_probabilities(df, "l", 1.0, None, 0.1).first()["kept"]] == [0]


def test_frontier(spark):
    points = [("a", d / 10, s / 10) for d, s in [(1, 2), (1, 5), (2, 5), (3, 6), (4, 1), (9, 9)]]
    out = metrics.pareto_frontier(spark.createDataFrame(points, "k string, damage double, survival double"), ["k"])
    assert sorted(rows(out.select("damage", "survival"))) == [(0.1, 0.5), (0.3, 0.6), (0.9, 0.9)]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 5), max_size=12), st.lists(st.integers(0, 5), max_size=12))
def test_edit_distance_is_a_metric(a, b):
    d = quality.edit_distance(a, b)
    table = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        table.append([i])
        for j, y in enumerate(b, 1):
            table[-1].append(min(table[-1][-1] + 1, table[-2][j] + 1, table[-2][j - 1] + (x != y)))
    assert d == table[-1][-1]
    assert d == quality.edit_distance(b, a) and (d == 0) == (a == b) and abs(len(a) - len(b)) <= d <= max(len(a), len(b))


@pytest.mark.parametrize("kind", transforms.KINDS)
def test_token_edits(spark, kind):
    tokens = list(range(20))
    out, n = transforms.edited(tokens, [100, 101], 0.25, 5, kind)
    assert n == 5 and (out, n) == transforms.edited(tokens, [100, 101], 0.25, 5, kind)
    assert len(out) == 20 + {"random_deletion": -5, "span_deletion": -5, "random_insertion": 5}.get(kind, 0)
    df = spark.createDataFrame([(tokens, 5), (None, 1), ([], 1)], "t array<int>, s long")
    found = transforms.token_edit(df, "t", F.col("s"), kind, 0.25, [100, 101]).collect()
    assert found[0]["edited"]["token_ids"] == out and found[1]["edited"]["token_ids"] is None and found[2]["edited"]["token_ids"] == []


def test_text_transforms(spark):
    df = spark.createDataFrame([("  a\t b  \r\nc  d \x0b e.  Yes! No?\n",)], "t string")
    one = lambda c: df.select(c).first()[0]
    assert one(transforms.whitespace(F.col("t"))) == "a b\nc d\n e. Yes! No?"
    assert one(transforms.line_endings(F.lit("a\r\nb\rc"))) == "a\nb\nc"
    assert one(transforms.bullets(F.lit("One.  Two! Three"))) == "- One.\n- Two!\n- Three"
    assert one(transforms.delete_sentence(F.lit("One.  Two! Three"), 1)) == "One. Three"
    with pytest.raises(Exception, match="range"):
        one(transforms.delete_sentence(F.lit("One."), 1))


def test_native_deletion(spark):
    df = spark.createDataFrame([(list(range(10)), 1), (list(range(10)), 2), ([], 3)], "t array<int>, k int")
    out = [r["edited"] for r in transforms.native_deletion(df, "t", "k", 0.3, 1).collect()]
    assert [len(x) for x in out] == [7, 7, 0] and out[0] != out[1] and out[0] == sorted(out[0])


def test_literals_and_numbers(spark):
    a, b = "see https://x.org/a) or 3 and 3 and -4.5e2, `code`, \"q\" 'r'", "3 and `code` \"q\""
    df = spark.createDataFrame([(1, a, b), (2, "none", "none")], "k int, a string, b string")
    out = {(r["k"], r["kind"]): (r["source_count"], r["preserved_count"], r["recall"]) for r in quality.literal_recall(df, "k", "a", "b").collect()}
    assert out[1, "numbers"] == (3, 1, 1 / 3) and out[1, "urls"] == (1, 0, 0.0) and out[1, "code_spans"] == (1, 1, 1.0) and out[1, "quoted_literals"] == (2, 1, 0.5) and out[2, "urls"] == (0, 0, None)
    same = spark.createDataFrame([("#### 1,024", "it is 7 #### 1024"), ("x", "1"), ("5 then 6", "6.0")], "a string, b string")
    assert [r[0] for r in same.select(quality.answer_preserved(F.col("a"), F.col("b"))).collect()] == [True, None, True]
    with pytest.raises(PermissionError):
        quality.run_code("print()")


def test_splits_and_checkpoints(spark):
    df = spark.range(100).select(F.col("id").cast("string").alias("sample_id"))
    out = samples.fixed_count_splits(df, "sample_id", 10, 3)
    assert {r["split"]: r["count"] for r in out.groupBy("split").count().collect()} == dict.fromkeys(samples.SPLITS, 10)
    members = spark.createDataFrame([("t", "test", "a", 1, "x"), ("t", "test", "a", 1, "x"), ("t", "calibration", "a", 2, "y"), ("u", "other", "b", 1, "z")], "task string, split string, sample_id string, row_index long, row_sha256 string")
    kinds = {r["kind"] for r in samples.split_violations(members).collect()}
    assert kinds == {"duplicate_id", "split_leakage", "conflicting_hashes", "unknown_split", "empty_split"}
    done = spark.createDataFrame([("t", "a", "s", "k", 1)], "task string, split string, sample_id string, kind string, v int")
    more = spark.createDataFrame([("t", "a", "s", "k", 2), ("t", "a", "s2", "k", 3), ("t", "a", "s2", "k", 3)], done.schema)
    assert sorted(r["v"] for r in samples.appended(done, more).collect()) == [1, 3]
    assert samples.remaining(more, done).count() == 2
    assert samples.grid(spark, a=[1, 2], b=["x", "y", "z"]).count() == 6


def test_c2pa_tables(spark):
    codes = spark.createDataFrame([(1, "success", "assertion.dataHash.match"), (1, "failure", "assertion.bmffHash.mismatch"), (2, "success", "other"), (3, "success", "assertion.boxesHash.match")], "store int, kind string, code string")
    assert {r["store"]: r["status"] for r in c2pa.hard_bindings(codes).collect()} == {1: "invalid", 2: "not_applicable", 3: "present"}
    manifests = spark.createDataFrame([(1, "a", True, False), (1, "b", True, False), (2, "a", True, False), (3, "a", True, True)], "store int, label string, has_time boolean, has_certificate_status boolean")
    edges = spark.createDataFrame([(1, "a", "b"), (1, "b", "a"), (2, "a", "gone")], "store int, label string, ingredient string")
    active = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a")], "store int, label string")
    assert {r["store"]: r["reproducible"] for r in c2pa.validation_basis(manifests, edges, active).collect()} == {1: True, 2: False, 3: False}
    a = spark.createDataFrame([("f", "x", "y"), ("g", "x", "y")], "fixture_id string, l1 string, l2 string")
    assert c2pa.replayed(a, a.where("fixture_id = 'f'"), ["l1", "l2"]).count() == 1


def test_ledgers(spark):
    files = spark.createDataFrame([("b", b"2"), ("a", b"1"), ("SHA256SUMS", b"")], "name string, content binary")
    lines = [r["line"] for r in ledger.checksums(files).collect()]
    listed = spark.createDataFrame(list(enumerate([*lines, "bad", lines[0], lines[0]])), "ordinal int, value string")
    assert [r["problem"] for r in ledger.parsed_checksums(listed).orderBy("ordinal").collect()] == [None, None, "form", None, "duplicate"]
    x = spark.createDataFrame([("a", "1"), ("b", "2")], "name string, sha256 string")
    y = spark.createDataFrame([("a", "1"), ("b", "3"), ("c", "4")], "name string, sha256 string")
    assert sorted(rows(ledger.release_violations(x, x, y).select("name"))) == [("b",), ("c",)]
    assert sorted(rows(ledger.both_sided_difference(x, y, ["name"], ["sha256"]))) == [("b", "changed"), ("c", "extra")]
    assert rows(ledger.order_differences(listed.limit(1), listed.limit(1), "ordinal", "value")) == []
    state = ledger.gates(spark.createDataFrame([("p", 0), ("p", 0), ("q", 1), ("r", None)], "k string, exit_code int"), ["k"])
    assert {r["k"]: r["state"] for r in state.collect()} == {"p": "PROOF_COMPLETE", "q": "PROOF_INCOMPLETE", "r": "PROOF_INCOMPLETE"}
    packages = spark.createDataFrame([("a", "1"), ("b", "1")], "name string, version string")
    own = spark.createDataFrame([("a", "1", "MIT")], "name string, version string, license string")
    other = spark.createDataFrame([("b", "1", "BSD"), ("z", "1", "X")], own.schema)
    found, unused = ledger.with_fallback(packages, own, other, ["name", "version"], "license")
    assert sorted(rows(found)) == [("a", "1", "MIT"), ("b", "1", "BSD")] and rows(unused.select("name")) == [("z",)]
    assert ledger.union_inventory({"x": own, "y": own}).first()["targets"] == ["x", "y"]
    assert ledger.recomputed_differences(x, y).count() == 3


def test_rescoring_names_each_mismatch(spark):
    schema = "id int, statistic_name string, score double, scored_units int, p_value double, threshold double, comparator string, decision boolean, decision_status string"
    records = spark.createDataFrame([(1, "z", 2.0, 5, 0.1, 1.0, ">", True, "DETECTED"), (2, "z", 2.0, 5, 0.1, 1.0, ">", False, "NOT_DETECTED"), (3, "z", 2.0, 5, None, 3.0, ">", False, "NOT_DETECTED")], schema)
    again = spark.createDataFrame([(1, 2.0, 5, 0.1), (2, 2.5, 6, 0.2)], "id int, score double, scored_units int, p_value double")
    assert sorted(rows(evidence.rescored(records, again, ["id"]))) == [(2, "decision"), (2, "p_value"), (2, "score"), (2, "scored_units"), (3, "missing")]
    assert evidence.recorded(records).select("evaluation_id").distinct().count() == 3


def test_validation_basis_reaches_the_last_manifest(spark):
    manifests = spark.createDataFrame([(1, k, True, k == 6) for k in range(7)], "store int, label int, has_time boolean, has_certificate_status boolean")
    edges = spark.createDataFrame([(1, k, k + 1) for k in range(6)], "store int, label int, ingredient int")
    active = spark.createDataFrame([(1, 0)], "store int, label int")
    assert [r["reproducible"] for r in c2pa.validation_basis(manifests, edges, active).collect()] == [False]
    with pytest.raises(ValueError, match="deeper"):
        c2pa.validation_basis(manifests, edges, active, most_rounds=3)
