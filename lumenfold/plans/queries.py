"""The engine's queries by name, each (spark, sf_dir) -> DataFrame, over whole tables, with the DuckDB statement that has to agree.

The tables' texts hold no default-ignorable or bidi characters and no normalization differences, so queries about those put some in, the
same way on both sides, in front of texts whose id leaves a remainder. Remainders serve elsewhere too to put in cases the tables lack
(violations, missing rows); every query reads its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import scalars as S


from ..operators import archives, calibrate, c2pa, evidence, incremental, inspect, ledger, licenses, metrics, quality, report, samples, transforms, windows
from ..sources import artifacts as A
from ..sources.tables import dealt, stored

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


_table = stored


def _chr(code: int) -> Column:
    return F.lit(chr(code))


def _marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with characters put in front: a zero-width space (id % 3 = 1), or an override, an `e` with an acute and a ligature (= 2)."""
    docs = dealt(_table(spark, sf_dir, "documents"))
    rest = F.col("doc_id") % 3
    text = F.when(rest == 1, F.concat(F.lit("a"), _chr(0x200B), "text")).when(rest == 2, F.concat(_chr(0x202E), F.lit("e"), _chr(0x301), _chr(0xFB03), "text")).otherwise(F.col("text"))
    return docs.withColumn("text", text)


_MARKED = (
    "(SELECT doc_id, lang, source, CASE doc_id % 3 WHEN 1 THEN 'a' || chr(8203) || text WHEN 2 THEN chr(8238) || 'e' || chr(769) || chr(64259) || text ELSE text END AS text FROM documents)"
)
_DICP_SET = "[" + "".join(chr(a) if a == b else f"{chr(a)}-{chr(b)}" for a, b in C.DEFAULT_IGNORABLE) + "]"
_BIDI_SET = "[" + "".join(chr(c) for c in C.BIDI_CONTROL) + "]"


@query("SELECT doc_id, strlen(text) AS byte_length, length(text) AS scalar_count, sha256(text) AS content_sha256, doc_id || '.txt' AS name FROM documents")
def artifact_identity(spark, sf_dir):
    found = A.with_identity(A.from_text(_table(spark, sf_dir, "documents"), "doc_id", "text", "documents"))
    return found.select(F.col("artifact_id").cast("long").alias("doc_id"), "byte_length", F.char_length("text").cast("long").alias("scalar_count"), "content_sha256", A.display_name(F.col("path")).alias("name"))


@query(f"SELECT doc_id, CAST(length(text) - length(regexp_replace(text, '{_DICP_SET}', '', 'g')) AS BIGINT) AS dicp_count, CAST(length(text) - length(regexp_replace(text, '{_BIDI_SET}', '', 'g')) AS BIGINT) AS bidi_count FROM {_MARKED}")
def unicode_property_counts(spark, sf_dir):
    return _marked(spark, sf_dir).select("doc_id", S.occurrences(F.col("text"), S.DICP_CLASS).alias("dicp_count"), S.occurrences(F.col("text"), S.BIDI_CLASS).alias("bidi_count"))


@query(f"""WITH c AS (SELECT doc_id, unnest(string_split(text, '')) AS ch, generate_subscripts(string_split(text, ''), 1) - 1 AS i FROM {_MARKED}),
    o AS (SELECT doc_id, ch, i, coalesce(sum(strlen(ch)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM c)
    SELECT doc_id, 'U+' || upper(lpad(to_hex(unicode(ch)), 4, '0')) AS code_point, CAST(b AS BIGINT) AS byte_offset, CAST(i AS BIGINT) AS scalar_offset FROM o WHERE regexp_matches(ch, '{_DICP_SET}')""")
def dicp_locations(spark, sf_dir):
    found = _marked(spark, sf_dir).select("doc_id", F.explode(S.locations(F.col("text"), S.DICP_CLASS)).alias("x"))
    return found.select("doc_id", "x.code_point", "x.byte_offset", "x.scalar_offset")


@query(f"""SELECT lang, CAST(count(*) FILTER (WHERE regexp_matches(text, '{_DICP_SET}')) AS BIGINT) AS dicp_present, CAST(count(*) FILTER (WHERE regexp_matches(text, '{_BIDI_SET}')) AS BIGINT) AS bidi_present,
    count(*) AS artifacts FROM {_MARKED} GROUP BY lang""")
def unicode_status_by_lang(spark, sf_dir):
    docs = _marked(spark, sf_dir)
    return docs.groupBy("lang").agg(F.count_if(F.col("text").rlike(S.DICP_CLASS)).alias("dicp_present"), F.count_if(F.col("text").rlike(S.BIDI_CLASS)).alias("bidi_present"), F.count("*").alias("artifacts"))


@query(f"SELECT doc_id, replace(replace(text, chr(8238), '\\u{{202e}}'), chr(10), '\\u{{a}}') AS safe FROM {_MARKED}")
def human_safe(spark, sf_dir):
    return _marked(spark, sf_dir).select("doc_id", S.human_safe(F.col("text")).alias("safe"))


@query(f"SELECT doc_id, nfc_normalize(text) <> text AS differs, CASE WHEN nfc_normalize(text) <> text THEN sha256(nfc_normalize(text)) END AS normalized_sha256, CASE WHEN nfc_normalize(text) <> text THEN CAST(strlen(nfc_normalize(text)) AS BIGINT) END AS normalized_byte_length FROM {_MARKED}")
def nfc_difference(spark, sf_dir):
    from ..functions.text import nfc_difference as difference

    text = F.when(F.octet_length("text") != F.char_length("text"), F.col("text"))
    found = _marked(spark, sf_dir).withColumn("d", difference(text))
    return found.select("doc_id", F.col("d.normalized_sha256").isNotNull().alias("differs"), "d.normalized_sha256", "d.normalized_byte_length")


@query(f"""WITH d AS {_MARKED}, f AS (
    SELECT doc_id, unnest(['{C.BIDI}', '{C.DICP}', '{C.NFC}', '{C.NFKC}', '{C.WRAPPER}', '{C.STORE}', '{C.VALIDATION}', '{C.BINDING}', '{C.TRUST}', '{C.PROVIDER}']) AS mechanism_id FROM d)
    SELECT mechanism_id, CASE WHEN mechanism_id = '{C.BIDI}' THEN CASE doc_id % 3 WHEN 2 THEN 'present' ELSE 'absent' END WHEN mechanism_id = '{C.DICP}' THEN CASE doc_id % 3 WHEN 0 THEN 'absent' ELSE 'present' END
    WHEN mechanism_id IN ('{C.NFC}', '{C.NFKC}') THEN CASE doc_id % 3 WHEN 2 THEN 'present' ELSE 'absent' END WHEN mechanism_id = '{C.WRAPPER}' THEN 'absent' WHEN mechanism_id = '{C.PROVIDER}' THEN 'unknown' ELSE 'not_applicable' END AS status,
    count(*) AS findings FROM f GROUP BY ALL""")
def findings_by_status(spark, sf_dir):
    found = inspect.findings(A.from_text(_marked(spark, sf_dir), "doc_id", "text", "documents"))
    return found.groupBy("mechanism_id", "status").agg(F.count("*").alias("findings"))


@query()
def report_json(spark, sf_dir):
    return report.reports_of(inspect.inspected(A.from_text(_marked(spark, sf_dir), "doc_id", "text", "documents")))


@query("SELECT mechanism_id, count(*) AS findings, count(*) FILTER (WHERE supported) AS supporting FROM (SELECT unnest(['unicode.bidi_control', 'c2pa.credential_trust', 'other.mechanism']) AS mechanism_id, lang, doc_id % 2 = 0 AS present FROM documents), LATERAL (SELECT present AND mechanism_id <> 'other.mechanism' AS supported) GROUP BY mechanism_id")
def trace_join(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    rows = docs.select(F.explode(F.array(F.lit(C.BIDI), F.lit(C.TRUST), F.lit("other.mechanism"))).alias("mechanism_id"), F.when(F.col("doc_id") % 2 == 0, "present").otherwise("unknown").alias("status"))
    return report.traced(rows).groupBy("mechanism_id").agg(F.count("*").alias("findings"), F.count_if(F.size("supports") > 0).alias("supporting"))


@query("""SELECT 'duplicate' AS kind, CAST(doc_id AS VARCHAR) AS artifact_id, 'unicode.bidi_control' AS mechanism_id FROM documents WHERE doc_id % 7 = 0
    UNION ALL SELECT 'status', CAST(doc_id AS VARCHAR), 'unicode.bidi_control' FROM documents WHERE doc_id % 5 = 0
    UNION ALL SELECT 'provider_claim', CAST(doc_id AS VARCHAR), 'provider.embedded_text_watermark' FROM documents WHERE doc_id % 11 = 0""")
def report_violations(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("artifact_id"), "doc_id")
    one = docs.select("artifact_id", F.lit(C.BIDI).alias("mechanism_id"), F.when(F.col("doc_id") % 5 == 0, "clean").otherwise("absent").alias("status"), "doc_id")
    twice = one.where("doc_id % 7 = 0").withColumn("status", F.lit("absent"))
    provider = docs.select("artifact_id", F.lit(C.PROVIDER).alias("mechanism_id"), F.when(F.col("doc_id") % 11 == 0, "absent").otherwise("unknown").alias("status"), "doc_id")
    return report.violations(one.unionByName(twice).unionByName(provider))


_HEX = "[" + ", ".join(f"'{c}'" for c in "0123456789abcdef") + "]"


@query(f"""SELECT doc_id, ['generation', 'calibration', 'test'][1 + CAST(list_sum(list_transform(string_split(left(sha256('{samples.SPLIT_DOMAIN}' || chr(0) || '7' || chr(0) || doc_id), 16), ''), lambda x: list_position({_HEX}, x) - 1)) % 3 AS INT)] AS split FROM documents""")
def assign_splits(spark, sf_dir):
    return samples.assign_splits(_table(spark, sf_dir, "documents"), "doc_id", 7).select("doc_id", "split")


@query(f"""SELECT lang, doc_id, ordinal, ['generation', 'calibration', 'test'][1 + CAST(ordinal // 20 AS INT)] AS split FROM (
    SELECT lang, doc_id, CAST(row_number() OVER (PARTITION BY lang ORDER BY sha256('{samples.RANK_DOMAIN}' || chr(0) || '7' || chr(0) || doc_id), doc_id) - 1 AS INT) AS ordinal FROM documents) WHERE ordinal < 60""")
def fixed_count_splits(spark, sf_dir):
    return samples.fixed_count_splits(_table(spark, sf_dir, "documents"), "doc_id", 20, 7, ["lang"], strict=False).select("lang", "doc_id", "ordinal", "split")


@query("""WITH m AS (SELECT lang AS task, ['generation', 'calibration', 'test'][1 + CAST(doc_id % 3 AS INT)] AS split, sha256(text) AS sample_id FROM documents)
    SELECT 'duplicate_id' AS kind, task, sample_id AS key FROM m GROUP BY task, split, sample_id HAVING count(*) > 1
    UNION ALL SELECT 'split_leakage', task, sample_id FROM m GROUP BY task, sample_id HAVING count(DISTINCT split) > 1
    UNION ALL SELECT 'id_in_several_tasks', min(task), sample_id FROM m GROUP BY sample_id HAVING count(DISTINCT task) > 1""")
def split_leakage(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    members = docs.select(F.col("lang").alias("task"), F.element_at(F.array(*[F.lit(s) for s in samples.SPLITS]), (F.col("doc_id") % 3 + 1).cast("int")).alias("split"), F.sha2("text", 256).alias("sample_id"), F.col("doc_id").alias("row_index"), F.sha2("text", 256).alias("row_sha256"))
    return samples.split_violations(members)


@query(f"SELECT doc_id, CAST(('0x' || right(sha256('lumenfold-rng-v1' || chr(0) || '42' || chr(0) || doc_id), 8)) AS BIGINT) % 2147483648 AS seed FROM documents")
def derived_seeds(spark, sf_dir):
    from ..functions.hashing import derived_seed

    return _table(spark, sf_dir, "documents").select("doc_id", derived_seed(F.lit(42), F.col("doc_id"), 31).cast("long").alias("seed"))


def _word_lengths(spark, sf_dir) -> DataFrame:
    docs = dealt(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", F.transform(F.split("text", " "), lambda w: F.char_length(w).cast("int")).alias("tokens"))


_WORD_LENGTHS = "(SELECT doc_id, list_transform(string_split(text, ' '), lambda w: CAST(length(w) AS INT)) AS tokens FROM documents)"


@query(f"""WITH s AS (SELECT doc_id, tokens, unnest(range(0, len(tokens) - 15, 8)) AS start FROM {_WORD_LENGTHS} WHERE len(tokens) >= 16),
    w AS (SELECT doc_id, CAST(start AS INT) AS start, CAST(list_sum(tokens[start + 1 : start + 16]) AS DOUBLE) AS score FROM s)
    SELECT doc_id, CAST(count(*) AS INT) AS window_count, arg_max(start, (score, -start)) AS window_start, arg_max(start, (score, -start)) + 16 AS window_end, max(score) AS window_score FROM w GROUP BY doc_id""")
def sliding_window_max(spark, sf_dir):
    found = windows.window_maximum(_word_lengths(spark, sf_dir), "tokens", 16, 8, lambda x: F.aggregate(x, F.lit(0), lambda s, v: s + v))
    return found.where("window_count > 0").drop("tokens")


@query("""WITH p AS (SELECT doc_id, CAST(n_chars % 50 AS INT) AS p0, CAST(n_chars % 50 + 10 + doc_id % 7 AS INT) AS p1 FROM documents)
    , o AS (SELECT doc_id, p0, p1, greatest(0, least(p1, 20) - greatest(p0, 5)) AS a, greatest(0, least(p1, 50) - greatest(p0, 30)) AS b FROM p)
    , u AS (SELECT doc_id, p0, p1, a, b, a + b AS overlap, 35 + p1 - p0 - a - b AS total, (a > b OR (a = b AND abs(p0 - 5) <= abs(p0 - 30))) AS first FROM o)
    SELECT doc_id, overlap AS overlap_token_count, total AS union_token_count, round(overlap / total, 9) AS iou, p0 - CASE WHEN first THEN 5 ELSE 30 END AS start_offset_error, p1 - CASE WHEN first THEN 20 ELSE 50 END AS end_offset_error FROM u""")
def localization(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    truths = F.array(F.struct(F.lit(30).alias("start"), F.lit(50).alias("end")), F.struct(F.lit(5).alias("start"), F.lit(20).alias("end")))
    start = (F.col("n_chars") % 50).cast("int")
    rows = docs.select("doc_id", start.alias("pred_start"), (start + 10 + F.col("doc_id") % 7).cast("int").alias("pred_end"), truths.alias("truths"))
    found = windows.localized(rows)
    return found.select("doc_id", "overlap_token_count", "union_token_count", F.round("iou", 9).alias("iou"), "start_offset_error", "end_offset_error")


def _scores(spark, sf_dir) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    return docs.join(labels, "doc_id").select("doc_id", "lang", "source", (F.col("n_chars") % 97).cast("double").alias("score"), (F.col("n_chars") % 3).cast("int").alias("scored_unit_count"), "quality", "toxic")


_SCORES = "(SELECT doc_id, lang, source, CAST(n_chars % 97 AS DOUBLE) AS score, CAST(n_chars % 3 AS INT) AS scored_unit_count, quality, toxic FROM documents JOIN labels USING (doc_id))"


def _calibration_sql(comparator: str) -> str:
    pick = "coalesce(max(score) FILTER (WHERE i = allowed), min(score))" if comparator == ">" else (
        "CASE WHEN max(allowed) = 0 THEN nextafter(max(score), 'infinity'::DOUBLE) WHEN max(ties) FILTER (WHERE i = allowed - 1) <= max(allowed) THEN max(score) FILTER (WHERE i = allowed - 1) ELSE nextafter(max(score) FILTER (WHERE i = allowed - 1), 'infinity'::DOUBLE) END"
    )
    return f"""WITH n AS (SELECT *, count(*) OVER (PARTITION BY lang) AS n, CAST(floor(0.05::DOUBLE * count(*) OVER (PARTITION BY lang)) AS BIGINT) AS allowed, row_number() OVER (PARTITION BY lang ORDER BY score DESC) - 1 AS i,
        count(*) OVER (PARTITION BY lang ORDER BY score DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ties FROM {_SCORES} WHERE quality = 1),
    t AS (SELECT lang, max(n) AS negative_count, max(allowed) AS maximum_allowed_false_positives, {pick} AS threshold FROM n GROUP BY lang)
    SELECT lang, threshold, negative_count, maximum_allowed_false_positives, count(*) FILTER (WHERE score {comparator} threshold) AS false_positive_count,
        round(count(*) FILTER (WHERE score {comparator} threshold) / negative_count, 12) AS empirical_calibration_exceedance, CASE WHEN negative_count * 0.05::DOUBLE >= 1 THEN 'RESOLVED' ELSE 'UNRESOLVED' END AS resolution_status
    FROM n JOIN t USING (lang) GROUP BY lang, threshold, negative_count, maximum_allowed_false_positives"""


def _calibration(spark, sf_dir, comparator: str) -> DataFrame:
    found = calibrate.calibrated(_scores(spark, sf_dir).where("quality = 1"), ["lang"], 0.05, comparator)
    return found.select("lang", "threshold", "negative_count", "maximum_allowed_false_positives", "false_positive_count", F.round("empirical_calibration_exceedance", 12).alias("empirical_calibration_exceedance"), "resolution_status")


@query(_calibration_sql(">"))
def calibrate_strict(spark, sf_dir):
    return _calibration(spark, sf_dir, ">")


@query(_calibration_sql(">="))
def calibrate_inclusive(spark, sf_dir):
    return _calibration(spark, sf_dir, ">=")


_THRESHOLDS = "(SELECT lang, scored_unit_count, max(score) - 5 AS threshold FROM " + _SCORES + " WHERE quality = 1 AND scored_unit_count IN (1) GROUP BY ALL UNION ALL SELECT lang, 5, 50.0 FROM " + _SCORES + " GROUP BY lang)"
_SELECTED = f"""WITH t AS {_THRESHOLDS}, s AS (SELECT lang, min(scored_unit_count) AS least, max(scored_unit_count) AS most FROM t GROUP BY lang),
    r AS (SELECT doc_id, lang, score, CASE WHEN doc_id % 10 = 9 THEN 7 WHEN doc_id % 10 = 8 THEN 3 ELSE scored_unit_count END AS scored_unit_count FROM {_SCORES}),
    j AS (SELECT r.*, t.threshold, CASE WHEN t.threshold IS NOT NULL THEN 'SELECTED' WHEN r.scored_unit_count < least THEN 'UNSUPPORTED' ELSE 'UNRESOLVED' END AS status,
        CASE WHEN t.threshold IS NOT NULL THEN 'exact match' WHEN least IS NULL THEN 'no threshold for exact conditioning' WHEN r.scored_unit_count < least THEN 'observed evidence is below minimum calibrated support'
        WHEN r.scored_unit_count > most THEN 'observed evidence exceeds calibrated support' ELSE 'observed evidence length lies between exact calibrated lengths' END AS reason
    FROM r LEFT JOIN t ON r.lang = t.lang AND r.scored_unit_count = t.scored_unit_count LEFT JOIN s ON r.lang = s.lang)"""


def _selection(spark, sf_dir) -> DataFrame:
    scores = _scores(spark, sf_dir)
    own = scores.where("quality = 1 and scored_unit_count = 1").groupBy("lang", "scored_unit_count").agg((F.max("score") - 5).alias("threshold"))
    fixed = scores.select("lang").distinct().select("lang", F.lit(5).alias("scored_unit_count"), F.lit(50.0).alias("threshold"))
    units = F.when(F.col("doc_id") % 10 == 9, 7).when(F.col("doc_id") % 10 == 8, 3).otherwise(F.col("scored_unit_count"))
    requests = scores.select("doc_id", "lang", "score", units.alias("scored_unit_count"))
    return calibrate.selected(requests, own.unionByName(fixed), ["lang", "scored_unit_count"])


@query(_SELECTED + " SELECT * FROM j")
def select_threshold(spark, sf_dir):
    return _selection(spark, sf_dir)


@query(_SELECTED + " SELECT doc_id, score >= threshold AS decision, CASE WHEN score >= threshold THEN 'DETECTED' WHEN score < threshold THEN 'NOT_DETECTED' WHEN status = 'UNSUPPORTED' THEN 'UNSUPPORTED' ELSE 'UNRESOLVED' END AS decision_status FROM j")
def decisions(spark, sf_dir):
    return calibrate.decided(_selection(spark, sf_dir), ">=").select("doc_id", "decision", "decision_status")


def _records(spark, sf_dir) -> DataFrame:
    scores = _scores(spark, sf_dir)
    label = F.when(F.col("quality") == 1, "watermarked").otherwise("unwatermarked")
    decision = F.when(F.col("doc_id") % 13 == 0, F.lit(None)).otherwise(F.col("score") > 48)
    task = F.when(F.col("doc_id") % 4 == 3, F.lit(None)).otherwise(F.col("source"))
    return scores.select("doc_id", F.col("lang").alias("scheme"), task.alias("task"), label.alias("label"), decision.alias("decision"), F.when(F.col("doc_id") % 13 == 0, F.when(F.col("doc_id") % 26 == 0, "UNSUPPORTED").otherwise("UNRESOLVED")).otherwise("DECIDED").alias("decision_status"), "score", F.create_map(F.lit("a"), F.col("score") / 2, F.lit("b"), F.col("toxic").cast("double")).alias("quality"))


_RECORDS = f"""(SELECT doc_id, lang AS scheme, CASE WHEN doc_id % 4 = 3 THEN NULL ELSE source END AS task, CASE WHEN quality = 1 THEN 'watermarked' ELSE 'unwatermarked' END AS label,
    CASE WHEN doc_id % 13 = 0 THEN NULL ELSE score > 48 END AS decision, CASE WHEN doc_id % 26 = 0 THEN 'UNSUPPORTED' WHEN doc_id % 13 = 0 THEN 'UNRESOLVED' ELSE 'DECIDED' END AS decision_status, score, score / 2 AS qa, CAST(toxic AS DOUBLE) AS qb FROM {_SCORES})"""


@query(f"""WITH r AS {_RECORDS}, g AS (SELECT scheme, task, count(*) AS n, count(*) FILTER (WHERE label = 'watermarked' AND decision IS NOT NULL) AS positive_n, count(*) FILTER (WHERE label = 'unwatermarked' AND decision IS NOT NULL) AS negative_n,
    count(*) FILTER (WHERE label = 'unwatermarked') AS held_out_negative_n, count(*) FILTER (WHERE decision IS NULL) AS unresolved_n, count(*) FILTER (WHERE label = 'unwatermarked' AND decision IS NULL) AS unresolved_negative_n,
    count(*) FILTER (WHERE label = 'watermarked' AND decision) AS true_positives, count(*) FILTER (WHERE label = 'unwatermarked' AND decision) AS false_positives,
    coalesce(bool_and(decision_status = 'UNSUPPORTED') FILTER (WHERE label = 'unwatermarked' AND decision IS NULL), false) AS u, round(avg(score), 9) AS score_mean, median(score) AS score_median FROM r GROUP BY scheme, task),
    q AS (SELECT scheme, task, round(avg(v), 9) AS quality_mean, median(v) AS quality_median FROM (SELECT scheme, task, unnest([qa, qb]) AS v FROM r) GROUP BY scheme, task)
    SELECT g.* EXCLUDE (u), quality_mean, quality_median, CASE WHEN positive_n > 0 AND negative_n > 0 THEN round(true_positives / positive_n, 12) END AS tpr, CASE WHEN negative_n > 0 AND unresolved_negative_n = 0 THEN round(false_positives / negative_n, 12) END AS empirical_fpr,
    CASE WHEN held_out_negative_n = 0 THEN NULL WHEN unresolved_negative_n > 0 AND u THEN 'UNSUPPORTED' WHEN unresolved_negative_n > 0 OR negative_n * 0.05::DOUBLE < 1 THEN 'UNRESOLVED' ELSE 'RESOLVED' END AS resolution_status
    FROM g JOIN q ON g.scheme = q.scheme AND g.task IS NOT DISTINCT FROM q.task""")
def aggregate_records(spark, sf_dir):
    found = metrics.aggregated(_records(spark, sf_dir), 0.05, ["scheme", "task"], intervals=False)
    return found.select(
        "scheme", "task", "n", "positive_n", "negative_n", "held_out_negative_n", "unresolved_n", "unresolved_negative_n", "true_positives", "false_positives", F.round("score_mean", 9).alias("score_mean"), "score_median",
        F.round("quality_mean", 9).alias("quality_mean"), "quality_median", F.round("tpr", 12).alias("tpr"), F.round("empirical_fpr", 12).alias("empirical_fpr"), "resolution_status",
    )


@query(f"""SELECT scheme, count(*) AS n, round(CASE WHEN k = 0 THEN 0 WHEN k = m THEN pow(0.025, 1.0 / m) END, 9) AS lower, round(CASE WHEN k = m THEN 1 WHEN k = 0 THEN 1 - pow(0.025, 1.0 / m) END, 9) AS upper
    FROM (SELECT scheme, CASE WHEN scheme IN ('en', 'fr') THEN 0 ELSE m END AS k, m FROM (SELECT scheme, count(*) OVER (PARTITION BY scheme) AS m FROM {_RECORDS})) GROUP BY scheme, k, m""")
def exact_intervals(spark, sf_dir):
    found = _records(spark, sf_dir).groupBy("scheme").agg(F.count("*").alias("n"))
    found = metrics.with_interval(found.withColumn("k", F.when(F.col("scheme").isin("en", "fr"), 0).otherwise(F.col("n"))), "k", "n", "bounds")
    return found.select("scheme", "n", F.round("bounds.lower", 9).alias("lower"), F.round("bounds.upper", 9).alias("upper"))


@query(f"SELECT coalesce(task, 'UNSPECIFIED') AS subgroup, count(*) FILTER (WHERE decision) AS false_positive_count, count(*) AS negative_count, round(count(*) FILTER (WHERE decision) / count(*), 12) AS fpr FROM {_RECORDS} WHERE label = 'unwatermarked' AND decision IS NOT NULL GROUP BY 1")
def subgroup_fpr(spark, sf_dir):
    return metrics.subgroup_fpr(_records(spark, sf_dir), "task").withColumn("fpr", F.round("fpr", 12))


@query("""WITH p AS (SELECT lang, (n_chars % 100) / 100.0 AS damage, ((doc_id * 37) % 101) / 101.0 AS survival FROM documents), b AS (SELECT lang, damage, max(survival) AS survival FROM p GROUP BY ALL),
    f AS (SELECT *, max(survival) OVER (PARTITION BY lang ORDER BY damage ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM b) SELECT lang, round(CAST(damage AS DOUBLE), 9) AS damage, round(CAST(survival AS DOUBLE), 9) AS survival FROM f WHERE prev IS NULL OR survival > prev""")
def pareto_frontier(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    points = docs.select("lang", ((F.col("n_chars") % 100) / F.lit(100.0)).alias("damage"), ((F.col("doc_id") * 37 % 101) / F.lit(101.0)).alias("survival"))
    found = metrics.pareto_frontier(points, ["lang"])
    return found.select("lang", F.round("damage", 9).alias("damage"), F.round("survival", 9).alias("survival"))


@query("""WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: exp(CAST(x AS DOUBLE) - CAST(list_max(embedding) AS DOUBLE))) AS e FROM embeddings),
    p AS (SELECT vec_id, label, list_transform(e, lambda x: x / list_sum(e)) AS p FROM e)
    SELECT vec_id, round(-list_sum(list_transform(p, lambda x: CASE WHEN x > 0 THEN x * ln(x) ELSE 0 END)), 6) AS shannon, round(list_sum(list_transform(p, lambda x: x / (1 + 0.7615941559557649::DOUBLE * x))), 6) AS spike FROM p""")
def entropy(spark, sf_dir):
    found = metrics.with_probabilities(_table(spark, sf_dir, "embeddings"), "embedding")
    return found.select("vec_id", F.round(metrics.shannon(F.col("probabilities")), 6).alias("shannon"), F.round(metrics.spike(F.col("probabilities")), 6).alias("spike"))


@query("SELECT lang, round(avg(n_chars), 6) AS mean, median(n_chars) AS median, round(quantile_cont(CAST(n_chars AS DOUBLE), 0.05), 6) AS q05, round(quantile_cont(CAST(n_chars AS DOUBLE), 0.95), 6) AS q95 FROM documents GROUP BY lang")
def entropy_summary(spark, sf_dir):
    values = _table(spark, sf_dir, "documents").select("lang", F.col("n_chars").cast("double").alias("v"))
    found = metrics.summarized(values, ["lang"], "v")
    return found.select("lang", F.round("mean", 6).alias("mean"), "median", F.round(F.col("quantiles")[0], 6).alias("q05"), F.round(F.col("quantiles")[3], 6).alias("q95"))


@query(f"""WITH g AS (SELECT doc_id, tokens, unnest(range(1, len(tokens) - 2)) AS i FROM {_WORD_LENGTHS} WHERE len(tokens) > 4), u AS (SELECT DISTINCT doc_id, tokens[i : i + 3] AS gram FROM g),
    c AS (SELECT doc_id, count(*) AS t, count(*) FILTER (WHERE list_sum(gram) % 4 = 0) AS green FROM u GROUP BY doc_id)
    SELECT doc_id, CAST(t AS INT) AS scored_units, CAST(green AS INT) AS green_count, round((green - 0.25::DOUBLE * t) / sqrt(t * 0.1875::DOUBLE), 9) AS score FROM c""")
def ngram_units(spark, sf_dir):
    green = lambda g: F.aggregate(g, F.lit(0), lambda s, x: s + x) % 4 == 0
    # the filter is on what decides it: on the units, it would have them worked out twice
    found = metrics.ngram_z(_word_lengths(spark, sf_dir).where(F.size("tokens") > 4), "tokens", green)
    return found.select("doc_id", "scored_units", "green_count", F.round("score", 9).alias("score"))


@query(f"""WITH g AS (SELECT doc_id, tokens, unnest(range(1, len(tokens) - 3)) AS i FROM {_WORD_LENGTHS} WHERE len(tokens) > 4), k AS (SELECT doc_id, i, row_number() OVER (PARTITION BY doc_id, tokens[i : i + 3] ORDER BY i) AS r FROM g)
    SELECT doc_id, count(*) AS positions, count(*) FILTER (WHERE r = 1) AS scored FROM k GROUP BY doc_id""")
def repetition_mask(spark, sf_dir):
    mask = metrics.repetition_mask(F.col("tokens"), 4, None)
    found = _word_lengths(spark, sf_dir).where(F.size("tokens") > 4).withColumn("mask", mask)
    return found.select("doc_id", F.size("mask").cast("long").alias("positions"), F.size(F.filter("mask", lambda m: m)).cast("long").alias("scored"))


@query(r"""WITH d AS (SELECT doc_id, text || ' 12 and 3.5 and 12 and "' || lang || '" end' AS a, text || ' 12 and 4.5 and "' || lang || '" end' AS b FROM documents),
    q AS (SELECT doc_id, regexp_extract_all(a, '"([^"]+)"|''([^'']+)''') AS x, regexp_extract_all(b, '"([^"]+)"|''([^'']+)''') AS y FROM d),
    xs AS (SELECT doc_id, v, count(*) AS n FROM (SELECT doc_id, unnest(x) AS v FROM q) GROUP BY ALL), ys AS (SELECT doc_id, v, count(*) AS m FROM (SELECT doc_id, unnest(y) AS v FROM q) GROUP BY ALL)
    SELECT doc_id, CAST(sum(n) AS BIGINT) AS source_count, CAST(sum(least(n, coalesce(m, 0))) AS BIGINT) AS preserved_count, round(sum(least(n, coalesce(m, 0))) / sum(n), 12) AS recall FROM xs LEFT JOIN ys USING (doc_id, v) GROUP BY doc_id""")
def literal_recall(spark, sf_dir):
    docs = dealt(_table(spark, sf_dir, "documents"))
    quote = F.concat(F.lit('"'), "lang", F.lit('" end'))
    rows = docs.select("doc_id", F.concat("text", F.lit(" 12 and 3.5 and 12 and "), quote).alias("a"), F.concat("text", F.lit(" 12 and 4.5 and "), quote).alias("b"))
    found = quality.literal_recall(rows, "doc_id", "a", "b").where("kind = 'quoted_literals'")
    return found.select("doc_id", "source_count", "preserved_count", F.round("recall", 12).alias("recall"))


@query(r"""SELECT conv_id, turn, CASE WHEN len(f) > 0 THEN round(TRY_CAST(replace(f[-1], ',', '') AS DOUBLE), 6) END AS number FROM (SELECT conv_id, turn, regexp_extract_all(text || CASE WHEN turn % 2 = 0 THEN ' #### 1,0' || turn ELSE '' END, '[+-]?[0-9,]+(?:\.[0-9]+)?') AS f FROM conversations)""")
def final_number(spark, sf_dir):
    rows = _table(spark, sf_dir, "conversations")
    text = F.when(F.col("turn") % 2 == 0, F.concat("text", F.lit(" #### 1,0"), F.col("turn").cast("string"))).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", F.round(quality.final_number(text).cast("double"), 6).alias("number"))


@query(r"""SELECT doc_id, trim(array_to_string(list_transform(string_split(text, chr(10)), lambda x: rtrim(regexp_replace(x, '[\t ]+', ' ', 'g'))), chr(10)), ' ' || chr(10)) AS text FROM documents""")
def whitespace_norm(spark, sf_dir):
    return dealt(_table(spark, sf_dir, "documents")).select("doc_id", transforms.whitespace(F.col("text")).alias("text"))


@query(r"""WITH s AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, ' ' || chr(10))), lambda x: x <> '') AS s FROM documents)
    SELECT doc_id, array_to_string(list_transform(s, lambda x: '- ' || x), chr(10)) AS text FROM s""")
def bullets(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", transforms.bullets(F.col("text")).alias("text"))


@query(r"""WITH s AS (SELECT doc_id, list_filter(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS s FROM documents) SELECT doc_id, array_to_string(s[2:], ' ') AS text FROM s""")
def delete_sentence(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", transforms.delete_sentence(F.col("text"), 0).alias("text"))


@query("SELECT doc_id, least(len(tokens), CAST(floor(len(tokens) * 0.1::DOUBLE + 0.5) AS INT)) AS operations, len(tokens) - least(len(tokens), CAST(floor(len(tokens) * 0.1::DOUBLE + 0.5) AS INT)) AS kept FROM " + _WORD_LENGTHS)
def token_deletion(spark, sf_dir):
    found = transforms.token_edit(_word_lengths(spark, sf_dir), "tokens", F.col("doc_id"), "random_deletion", 0.1, [])
    return found.select("doc_id", F.col("edited.operation_count").cast("long").alias("operations"), F.size("edited.token_ids").cast("long").alias("kept"))


@query()
def token_distance(spark, sf_dir):
    edited = transforms.token_edit(_word_lengths(spark, sf_dir), "tokens", F.col("doc_id"), "random_substitution", 0.25, list(range(1, 40)))
    return edited.select("doc_id", quality.token_distance("tokens", "edited.token_ids").alias("d")).select("doc_id", "d.distance", F.round("d.normalized", 9).alias("normalized"))


@query("""WITH d AS (SELECT doc_id, 1 + doc_id % 40 AS m, 60 - doc_id % 30 AS u FROM documents), t AS (SELECT doc_id, m, u, greatest(m, u) AS total FROM d),
    c AS (SELECT doc_id, greatest(1, least(m, CAST(round_even(total * 0.25::DOUBLE, 0) AS BIGINT))) AS k, total, u FROM t)
    SELECT doc_id, k + least(u, total - k) AS tokens, round(k / (k + least(u, total - k)), 9) AS realized FROM c""")
def composition(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", F.array_repeat(F.lit(1), (1 + F.col("doc_id") % 40).cast("int")).alias("m"), F.array_repeat(F.lit(0), (60 - F.col("doc_id") % 30).cast("int")).alias("u"))
    found = windows.composed(rows, "m", "u", 0.25, True)
    return found.select("doc_id", F.size("tokens").cast("long").alias("tokens"), F.round("realized_fraction", 9).alias("realized"))


@query("""SELECT 'unknown_source' AS kind, CAST(doc_id AS VARCHAR) AS claim_id, 'label-' || doc_id AS detail FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
    UNION ALL SELECT 'missing_evidence', CAST(doc_id AS VARCHAR), 'item-' || doc_id FROM documents WHERE doc_id NOT IN (SELECT item_id FROM benchmark)
    UNION ALL SELECT 'command', CAST(doc_id AS VARCHAR), lang FROM documents WHERE lang NOT IN ('en', 'de')""")
def ledger_violations(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    claims = docs.select(F.col("doc_id").cast("string").alias("claim_id"), F.array(F.concat(F.lit("label-"), F.col("doc_id").cast("string"))).alias("source_ids"), F.array(F.concat(F.lit("item-"), F.col("doc_id").cast("string"))).alias("evidence_paths"), F.col("lang").alias("command"))
    sources = _table(spark, sf_dir, "labels").select(F.concat(F.lit("label-"), F.col("doc_id").cast("string")).alias("source_id"))
    files = _table(spark, sf_dir, "benchmark").select(F.concat(F.lit("item-"), F.col("item_id").cast("string")).alias("path"))
    return ledger.claim_violations(claims, sources, files, ["en", "de"])


@query("""SELECT source AS source_id, CAST(doc_id AS VARCHAR) AS path, CASE WHEN source NOT IN ('src0', 'src1', 'src2') THEN 'IDENTITY_RECORDED' WHEN doc_id % 5 = 0 THEN 'CACHE_MISSING' WHEN doc_id % 7 = 0 THEN 'HASH_MISMATCH' ELSE 'VERIFIED' END AS status FROM documents""")
def artifact_status(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select(F.col("source").alias("source_id"), F.col("doc_id").cast("string").alias("path"), "doc_id", F.sha2("text", 256).alias("sha256"))
    found = docs.where("doc_id % 5 <> 0").select("source_id", "path", F.when(F.col("doc_id") % 7 == 0, F.lit("0")).otherwise(F.col("sha256")).alias("found_sha256"))
    return ledger.artifact_status(docs.drop("doc_id"), found, docs.where(F.col("source_id").isin("src0", "src1", "src2")).select("source_id"))


@query("""SELECT doc_id AS fixture_id, CAST(3 - CASE WHEN doc_id % 10 = 0 THEN 1 ELSE 0 END AS BIGINT) AS platforms, CAST(1 AS BIGINT) AS inputs, CAST(CASE WHEN doc_id % 10 <> 0 AND doc_id % 4 = 0 THEN 2 ELSE 1 END AS BIGINT) AS meanings,
    CASE WHEN doc_id % 10 = 0 THEN 'MISSING_PLATFORM' WHEN doc_id % 4 = 0 THEN 'MEANING_DIFFERS' ELSE 'ESTABLISHED' END AS status FROM documents""")
def compare_runs(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("fixture_id"), F.sha2("text", 256).alias("input_sha256"))
    one = lambda p: docs.select(F.lit(p).alias("platform"), "fixture_id", "input_sha256", F.sha2(F.concat("input_sha256", F.when((F.lit(p) == "c") & (F.col("fixture_id") % 4 == 0), "x").otherwise("")), 256).alias("semantic_sha256"))
    results = one("a").unionByName(one("b")).unionByName(one("c").where("fixture_id % 10 <> 0"))
    return ledger.platform_comparison(results, ["a", "b", "c"])


@query("""SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN b.doc_id IS NULL THEN 'missing' WHEN a.doc_id IS NULL THEN 'extra' ELSE 'changed' END AS kind FROM documents a FULL JOIN (SELECT doc_id, quality FROM labels) b ON a.doc_id = b.doc_id
    WHERE a.doc_id IS NULL OR b.doc_id IS NULL OR (a.n_chars % 2 <> b.quality)""")
def inventory_difference(spark, sf_dir):
    left = _table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") % 2).cast("long").alias("v"))
    right = _table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("long").alias("v"))
    return ledger.both_sided_difference(left, right, ["doc_id"], ["v"])


@query("SELECT name, sha256(text) || '  ' || name AS line FROM (SELECT 'item-' || item_id || '.txt' AS name, text FROM benchmark)")
def release_checksums(spark, sf_dir):
    rows = _table(spark, sf_dir, "benchmark")
    return ledger.checksums(rows.select(F.concat(F.lit("item-"), F.col("item_id").cast("string"), F.lit(".txt")).alias("name"), F.col("text").cast("binary").alias("content")))


@query("""WITH RECURSIVE r(store, label) AS (SELECT doc_id // 8, doc_id FROM documents WHERE doc_id % 8 = 0 UNION SELECT r.store, r.label + s FROM r, (VALUES (1), (2)) t(s) WHERE (r.label + s) // 8 = r.store AND r.label % 8 < 5)
    SELECT store, bool_and(d.doc_id IS NOT NULL AND d.n_chars % 11 <> 0 AND d.n_chars % 13 <> 0) AS reproducible FROM r LEFT JOIN documents d ON d.doc_id = r.label GROUP BY store""")
def validation_basis(spark, sf_dir):
    _checkpoints(spark)
    docs = _table(spark, sf_dir, "documents")
    rows = docs.select(F.floor(F.col("doc_id") / 8).alias("store"), F.col("doc_id").alias("label"), (F.col("n_chars") % 11 != 0).alias("has_time"), (F.col("n_chars") % 13 == 0).alias("has_certificate_status"))
    edges = rows.where("label % 8 < 5").select("store", "label", F.explode(F.array(F.col("label") + 1, F.col("label") + 2)).alias("ingredient")).where("floor(ingredient / 8) = store")
    back = rows.where("label % 8 = 4").select("store", "label", (F.col("label") - 4).alias("ingredient"))  # a cycle
    return c2pa.validation_basis(rows, edges.unionByName(back), rows.where("label % 8 = 0").select("store", "label"))


def _checkpoints(spark: SparkSession) -> None:
    """Checkpoints go to spark.checkpoint.dir; where that is unset, on a single machine, to an own folder."""
    import tempfile

    if not spark.conf.get("spark.checkpoint.dir", None) and not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lumenfold-checkpoint-"))


@query("""WITH c AS (SELECT doc_id % 50 AS store, CASE WHEN doc_id % 3 = 0 THEN 'failure' ELSE 'success' END AS kind, CASE doc_id % 5 WHEN 0 THEN 'assertion.dataHash.match' WHEN 1 THEN 'assertion.bmffHash.mismatch' WHEN 2 THEN 'claimSignature.validated' WHEN 3 THEN 'assertion.boxesHash.match' ELSE 'other' END AS code FROM documents),
    k AS (SELECT *, code LIKE 'assertion.%' AS known FROM c)
    SELECT store, CASE WHEN count(*) FILTER (WHERE known) = 0 THEN 'not_applicable' WHEN count(*) FILTER (WHERE known AND kind = 'failure') > 0 THEN 'invalid' ELSE 'present' END AS status,
    coalesce(min(code) FILTER (WHERE known AND kind = 'failure'), min(code) FILTER (WHERE known)) AS validation_code FROM k GROUP BY store""")
def hard_binding(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    code = F.element_at(F.array(*[F.lit(x) for x in ("assertion.dataHash.match", "assertion.bmffHash.mismatch", "claimSignature.validated", "assertion.boxesHash.match", "other")]), (F.col("doc_id") % 5 + 1).cast("int"))
    codes = docs.select((F.col("doc_id") % 50).alias("store"), F.when(F.col("doc_id") % 3 == 0, "failure").otherwise("success").alias("kind"), code.alias("code"))
    return c2pa.hard_bindings(codes).select("store", "status", "validation_code")


@query("SELECT lang AS store, source AS kind, CAST(count(DISTINCT n_chars) AS INT) AS total, count(DISTINCT n_chars) > 256 AS truncated, CAST(least(256, count(DISTINCT n_chars)) AS INT) AS kept FROM documents GROUP BY ALL")
def status_codes(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    found = c2pa.status_codes(docs.select(F.col("lang").alias("store"), F.col("source").alias("kind"), F.col("n_chars").cast("string").alias("code")))
    return found.select("store", "kind", "total", "truncated", F.size("codes").alias("kept"))


@query(f"SELECT doc_id, problem FROM (SELECT doc_id, unnest(list_filter([CASE WHEN doc_id % 17 = 0 THEN 'missing' END, CASE WHEN doc_id % 17 <> 0 AND doc_id % 5 = 0 THEN 'score' END, CASE WHEN doc_id % 17 <> 0 AND doc_id % 7 = 0 THEN 'scored_units' END, CASE WHEN doc_id % 3 = 0 THEN 'decision' END], lambda x: x IS NOT NULL)) AS problem FROM {_SCORES})")
def rescored_evidence(spark, sf_dir):
    base = _scores(spark, sf_dir).select("doc_id", "score", F.col("scored_unit_count").alias("scored_units"), F.lit(None).cast("double").alias("p_value"), F.lit(48.0).alias("threshold"), F.lit(">").alias("comparator"))
    right = F.col("score") > 48
    records = base.withColumn("decision", F.when(F.col("doc_id") % 3 == 0, ~right).otherwise(right))
    again = base.where("doc_id % 17 <> 0").withColumns({"score": F.when(F.col("doc_id") % 5 == 0, F.col("score") + 1).otherwise(F.col("score") + 1e-14), "scored_units": F.when(F.col("doc_id") % 7 == 0, F.col("scored_units") + 1).otherwise(F.col("scored_units"))})
    return evidence.rescored(records, again, ["doc_id"])


@query("SELECT lang, CASE WHEN count(*) FILTER (WHERE tpr >= 0.5) = 0 THEN 'UNATTAINABLE' ELSE 'SUPPORTED' END AS status, min(value) FILTER (WHERE tpr >= 0.5) AS value FROM (SELECT lang, doc_id AS value, (n_chars % 100) / 100.0 AS tpr FROM documents) GROUP BY lang")
def matched_strength(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    return calibrate.weakest_attaining(docs.select("lang", F.col("doc_id").alias("value"), ((F.col("n_chars") % 100) / F.lit(100.0)).alias("tpr"), F.lit(1.0).alias("quality")), ["lang"], 0.5)


@query(f"""WITH s AS (SELECT lang, CASE WHEN regexp_matches(text, '{_DICP_SET}') THEN 'present' ELSE 'absent' END AS status, coalesce(CAST(quality AS INT), -1) AS quality FROM {_MARKED} LEFT JOIN labels USING (doc_id))
    SELECT lang, status, quality, count(*) AS documents FROM s GROUP BY ALL""")
def inspected_documents(spark, sf_dir):
    found = inspect.findings(A.from_text(_marked(spark, sf_dir), "doc_id", "text", "documents")).where(F.col("mechanism_id") == C.DICP)
    docs = _table(spark, sf_dir, "documents").select("doc_id", "lang").join(_table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    joined = found.select(F.col("artifact_id").cast("long").alias("doc_id"), "status").join(docs, "doc_id")
    return joined.groupBy("lang", "status", F.coalesce(F.col("quality").cast("int"), F.lit(-1)).alias("quality")).agg(F.count("*").alias("documents"))




@query(f"""WITH s AS (SELECT doc_id, tokens, unnest(range(0, len(tokens) - 15, 8)) AS start FROM {_WORD_LENGTHS} WHERE len(tokens) >= 16),
    m AS (SELECT lang, max(CAST(list_sum(tokens[start + 1 : start + 16]) AS DOUBLE)) AS score FROM s JOIN documents USING (doc_id) GROUP BY lang, doc_id),
    r AS (SELECT lang, score, count(*) OVER (PARTITION BY lang) AS n, row_number() OVER (PARTITION BY lang ORDER BY score DESC) - 1 AS i FROM m)
    SELECT lang, n AS negative_count, max(score) FILTER (WHERE i = CAST(floor(0.05::DOUBLE * n) AS BIGINT)) AS threshold FROM r GROUP BY lang, n""")
def window_calibration(spark, sf_dir):
    best = windows.window_maximum(_word_lengths(spark, sf_dir), "tokens", 16, 8, lambda x: F.aggregate(x, F.lit(0), lambda s, v: s + v)).where("window_count > 0")
    scores = best.join(_table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id").select("lang", F.col("window_score").alias("score"))
    return calibrate.calibrated(scores, ["lang"], 0.05, ">").select("lang", "negative_count", "threshold")


@query("""WITH p AS (SELECT doc_id, CAST(n_chars % 50 AS INT) AS a, CAST(n_chars % 50 + 10 AS INT) AS b FROM documents)
    SELECT doc_id, round(greatest(greatest(0, least(b, 20) - greatest(a, 5)) / (greatest(b, 20) - least(a, 5)), greatest(0, least(b, 50) - greatest(a, 30)) / (greatest(b, 50) - least(a, 30))), 9) AS iou FROM p""")
def best_overlap(spark, sf_dir):
    truths = F.array(F.struct(F.lit(5).alias("start"), F.lit(20).alias("end")), F.struct(F.lit(30).alias("start"), F.lit(50).alias("end")))
    start = (F.col("n_chars") % 50).cast("int")
    return _table(spark, sf_dir, "documents").select("doc_id", F.round(windows.best_iou(start, start + 10, truths), 9).alias("iou"))


@query("SELECT lang, min(n_chars) FILTER (WHERE (doc_id * 7 % 100) / 100.0 >= 0.9) AS length FROM documents GROUP BY lang")
def length_at_target(spark, sf_dir):
    rates = _table(spark, sf_dir, "documents").select("lang", F.col("n_chars").alias("length"), (F.col("doc_id") * 7 % 100 / F.lit(100.0)).alias("tpr"))
    return metrics.length_at_target(rates, ["lang"], 0.9)


@query("""SELECT 'item-' || item_id AS name, CASE WHEN item_id % 3 = 0 THEN 'missing' ELSE 'content' END AS problem FROM benchmark WHERE item_id % 3 = 0 OR item_id % 4 = 0""")
def checksum_problems(spark, sf_dir):
    from ..operators import manifests

    rows = _table(spark, sf_dir, "benchmark").select(F.concat(F.lit("item-"), F.col("item_id").cast("string")).alias("name"), "item_id", F.sha2("text", 256).alias("sha256"))
    files = rows.where("item_id % 3 <> 0").select(F.concat(F.lit("/data/"), "name").alias("path"), F.when(F.col("item_id") % 4 == 0, F.lit("0")).otherwise(F.col("sha256")).alias("sha256"))
    return manifests.checksum_problems(rows.select("name", "sha256"), files)


@query("SELECT doc_id AS ordinal, text AS left_key, CASE WHEN doc_id % 10 <> 0 THEN lower(text) END AS right_key FROM documents WHERE doc_id % 10 = 0 OR text <> lower(text)")
def order_differences(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ordinal"), "text")
    return ledger.order_differences(docs, docs.where("ordinal % 10 <> 0").withColumn("text", F.lower("text")), "ordinal", "text")


@query("""WITH s AS (SELECT a.doc_id AS doc_id, a.lang AS lang, CAST(a.n_chars % 4000 AS BIGINT) AS a0, CAST(a.n_chars % 4000 + 100 + a.doc_id % 900 AS BIGINT) AS a1 FROM documents a)
    SELECT x.lang, x.doc_id AS doc_id, count(*) AS overlaps FROM s x JOIN (SELECT lang, CAST(n_chars % 3000 AS BIGINT) AS b0, CAST(n_chars % 3000 + 50 AS BIGINT) AS b1 FROM documents) y ON x.lang = y.lang AND x.a0 < y.b1 AND y.b0 < x.a1 GROUP BY ALL""")
def overlapping_spans(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    left = docs.select("lang", "doc_id", (F.col("n_chars") % 4000).alias("start"), (F.col("n_chars") % 4000 + 100 + F.col("doc_id") % 900).alias("end"))
    right = docs.select("lang", (F.col("n_chars") % 3000).alias("start"), (F.col("n_chars") % 3000 + 50).alias("end"))
    return windows.overlap_counts(left, right, ["lang"]).where("overlaps > 0").select("lang", "doc_id", "overlaps")


@query()
def keyed_detection(spark, sf_dir):
    from ..operators import schemes

    found = schemes.keyed_ngrams(97).score(_word_lengths(spark, sf_dir), "tokens")
    return found.select("doc_id", "scored_units", "green_count", F.round("score", 9).alias("score"), F.round("p_value", 9).alias("p_value"))


@query("""SELECT '{"event_id":' || event_id || ',"event_type":"' || event_type || '","user_id":' || user_id || ',"value":' || CAST(value AS VARCHAR) || '}' AS value FROM events""")
def canonical_records(spark, sf_dir):
    from ..sources import sinks

    return sinks.canonical_lines(_table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value"), ["event_id"])


def _carrier(payload: bytes, version: int = 1, length: int | None = None) -> str:
    """A text wrapper of a manifest store: a mark, and its bytes as variation selectors, 0 to 15 from U+FE00, the rest from U+E0100."""
    raw = C.WRAPPER_MAGIC + bytes([version]) + (len(payload) if length is None else length).to_bytes(4, "big") + payload
    return "\ufeff" + "".join(chr(0xFE00 + b) if b < 16 else chr(0xE0100 + b - 16) for b in raw)


_STORE = bytes(range(5, 45))
_STORE_HEX = _STORE.hex()


@query(f"""WITH d AS (SELECT doc_id, strlen(text) AS n, doc_id % 5 AS k FROM documents)
    SELECT doc_id, CASE k WHEN 0 THEN 'absent' WHEN 1 THEN 'present' ELSE 'invalid' END AS status, CASE k WHEN 1 THEN 'unsupported' ELSE 'not_applicable' END AS store_status,
        CASE k WHEN 1 THEN CAST(n AS VARCHAR) END AS wrapper_offset, CASE k WHEN 1 THEN sha256(unhex('{_STORE_HEX}')) END AS store_sha256,
        CASE WHEN k IN (2, 3) THEN 'manifest.text.corruptedWrapper' WHEN k = 4 THEN 'manifest.text.multipleWrappers' END AS error,
        CASE WHEN k IN (2, 3) THEN CAST(n AS VARCHAR) WHEN k = 4 THEN CAST(n + {len((_carrier(_STORE) + " and ").encode())} AS VARCHAR) END AS error_offset FROM d""")
def wrapper_findings(spark, sf_dir):
    """Texts with nothing, one wrapper, one of another version, one cut short, and two, put behind them by the remainder of their id."""
    behind = [F.lit(""), F.lit(_carrier(_STORE)), F.lit(_carrier(_STORE, version=2)), F.lit(_carrier(_STORE, length=99)), F.lit(_carrier(_STORE) + " and " + _carrier(_STORE))]
    docs = _table(spark, sf_dir, "documents")
    text = F.concat("text", F.element_at(F.array(*behind), (F.col("doc_id") % 5 + 1).cast("int")))
    found = inspect.inspected(A.from_text(dealt(docs).select("doc_id", text.alias("text")), "doc_id", "text", "documents"))
    one = lambda m: F.filter("findings", lambda f: f["mechanism_id"] == m)[0]
    told = lambda n: F.get(F.filter("wrapper.evidence", lambda e: e["name"] == n), 0)["value"]
    found = found.select(F.col("artifact_id").cast("long").alias("doc_id"), one(C.WRAPPER).alias("wrapper"), one(C.STORE)["status"].alias("store_status"))
    get = lambda n, k: F.get_json_object(told(n), f"$.{k}")
    return found.select("doc_id", "wrapper.status", "store_status", get("first_wrapper", "original_byte_offset").alias("wrapper_offset"), get("first_wrapper", "manifest_store_sha256").alias("store_sha256"), get("first_error", "code").alias("error"), get("first_error", "original_byte_offset").alias("error_offset"))


@query("""WITH b AS (SELECT CAST(item_id AS VARCHAR) AS i, text FROM benchmark)
    SELECT 'item-' || i || '.tar.gz' AS path, 1 AS ordinal, 'item-' || i || '/id' AS name, CAST(strlen(i) AS BIGINT) AS size, sha256(i) AS sha256, CAST(NULL AS VARCHAR) AS problem FROM b
    UNION ALL SELECT 'item-' || i || '.tar.gz', 2, 'item-' || i || '/text', CAST(strlen(text) AS BIGINT), sha256(text), NULL FROM b""")
def archive_members(spark, sf_dir):
    """Each item of the benchmark packed as an archive, and read back."""
    items = _table(spark, sf_dir, "benchmark").select(F.concat(F.lit("item-"), F.col("item_id").cast("string")).alias("archive"), F.col("item_id").cast("string").alias("id"), "text")
    files = items.select("archive", F.explode(F.create_map(F.lit("id"), F.col("id").cast("binary"), F.lit("text"), F.col("text").cast("binary"))).alias("name", "content")).withColumn("mode", F.lit(archives.PLAIN))
    return archives.members(archives.built(files)).where("ordinal > 0").select("path", "ordinal", "name", "size", "sha256", "problem")


@query("""SELECT count(DISTINCT conv_id) AS packages, count(*) AS mappings, count(DISTINCT text) AS texts FROM conversations""")
def licence_counts(spark, sf_dir):
    files = _table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("name"), F.lit("1").alias("version"), F.sha2("text", 256).alias("sha256"))
    return licenses.counts(files)


@query("""SELECT CASE WHEN doc_id % 6 = 0 THEN 'missing' WHEN doc_id % 6 = 1 THEN 'unknown' END AS kind, CAST(doc_id AS VARCHAR) AS name FROM documents WHERE doc_id % 6 IN (0, 1)
    UNION ALL SELECT DISTINCT 'text', sha256(text || 'other') FROM documents WHERE doc_id % 6 = 2""")
def bundle_violations(spark, sf_dir):
    """A bundle of the documents, of which some files were not reviewed, some reviewed ones are not in it, and some texts are not what is told."""
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id"), F.col("doc_id").cast("string").alias("name"), F.lit("1").alias("version"), F.lit("LICENSE").alias("filename"), "text")
    told = docs.withColumn("text", F.when(F.col("doc_id") % 6 == 2, F.concat("text", F.lit("other"))).otherwise(F.col("text")))
    files = told.select("doc_id", "name", "version", "filename", F.octet_length("text").cast("long").alias("byte_length"), F.sha2("text", 256).alias("sha256"), F.col("text").cast("binary").alias("content"))
    # the digest told of a changed text is that of the change, what the bundle holds is not
    held = files.withColumn("content", F.when(F.col("doc_id") % 6 == 2, F.substring("content", F.lit(1), F.octet_length("content") - 5)).otherwise(F.col("content")))
    lines = licenses.bundle(held.where(F.col("doc_id") % 6 != 0))
    return licenses.bundle_violations(lines, files.where(F.col("doc_id") % 6 != 1))


@query("""SELECT CAST(conv_id AS VARCHAR) AS name, CASE WHEN conv_id % 3 = 0 THEN ['size'] WHEN conv_id % 3 = 1 THEN ['size', 'sha256'] ELSE ['sha256'] END AS differing FROM (SELECT DISTINCT conv_id FROM conversations)""")
def archive_differences(spark, sf_dir):
    """Archives of another size, missing ones, and those of another digest."""
    ids = _table(spark, sf_dir, "conversations").select("conv_id").distinct().withColumns({"name": F.col("conv_id").cast("string"), "size": F.lit(1), "sha256": F.lit("a")})
    expected = ids.withColumns({"size": F.when(F.col("conv_id") % 3 == 0, 2).otherwise(1), "sha256": F.when(F.col("conv_id") % 3 == 2, "b").otherwise("a")})
    return archives.verified(ids.where(F.col("conv_id") % 3 != 1), expected, ["name"], ["size", "sha256"]).select("name", "differing")


@query("""SELECT doc_id, doc_id % 4 < 3 AS absolute FROM documents""")
def absolute_paths(spark, sf_dir):
    kinds = F.element_at(F.array(F.lit("/opt/"), F.lit("C:\\"), F.lit("at d:/"), F.lit("relative/")), (F.col("doc_id") % 4 + 1).cast("int"))
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.to_json(F.struct(F.array(F.concat(kinds, F.col("source"))).alias("/key"))).alias("json"))
    return docs.select("doc_id", archives.absolute_path(F.col("json")).alias("absolute"))


#: Texts with a zero-width space before each word that begins with t, in chunks whose size depends on the id; some are broken at an end.
_CUT = """(SELECT doc_id, CASE WHEN doc_id % 3 = 2 THEN chr(8238) ELSE '' END || replace(text, ' t', ' ' || chr(8203) || 't') AS t, doc_id % 11 = 0 AS begun, doc_id % 13 = 0 AS ended FROM documents WHERE text IS NOT NULL)"""


@query(f"""WITH d AS (SELECT *, NOT (begun OR ended) AS valid FROM {_CUT}), p AS (SELECT doc_id, i, length(piece) AS l, strlen(piece) AS b FROM (SELECT doc_id, unnest(string_split(t, chr(8203))) AS piece, generate_subscripts(string_split(t, chr(8203)), 1) AS i FROM d)),
    z AS (SELECT doc_id, i, sum(l) OVER w + i - 1 AS pos, sum(b) OVER w + 3 * (i - 1) AS byte_pos, count(*) OVER (PARTITION BY doc_id) AS n FROM p WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
    k AS (SELECT z.doc_id, count(*) AS kept, sum(pos) AS scalar_sum, sum(byte_pos) AS byte_sum FROM z JOIN d USING (doc_id) WHERE i < n AND i <= CASE WHEN doc_id % 3 = 2 THEN 255 ELSE 256 END GROUP BY z.doc_id)
    SELECT doc_id, CAST(strlen(t) + CASE WHEN begun THEN 1 ELSE 0 END + CASE WHEN ended THEN 2 ELSE 0 END AS BIGINT) AS byte_length, valid AS valid_utf8, CASE WHEN valid THEN length(t) END AS scalar_count,
        CASE WHEN valid THEN length(t) - length(replace(t, chr(8203), '')) + CASE WHEN doc_id % 3 = 2 THEN 1 ELSE 0 END END AS dicp_count, CASE WHEN valid THEN CASE WHEN doc_id % 3 = 2 THEN 1 ELSE 0 END END AS bidi_count,
        CASE WHEN valid THEN CAST(coalesce(kept, 0) + CASE WHEN doc_id % 3 = 2 THEN 1 ELSE 0 END AS INTEGER) END AS kept, CASE WHEN valid THEN CAST(coalesce(scalar_sum, 0) AS BIGINT) END AS scalar_sum, CASE WHEN valid THEN CAST(coalesce(byte_sum, 0) AS BIGINT) END AS byte_sum
        FROM d LEFT JOIN k USING (doc_id)""")
def chunked_findings(spark, sf_dir):
    """Chunks of 64 bytes and more, which cut scalars anywhere; summaries are merged, texts are not put together."""
    docs = dealt(_table(spark, sf_dir, "documents").select("doc_id", "text")).where("text is not null")
    text = F.concat(F.when(F.col("doc_id") % 3 == 2, _chr(0x202E)).otherwise(F.lit("")), F.replace("text", F.lit(" t"), F.lit(" " + chr(0x200B) + "t")))
    hexed = lambda c, x: F.when(c, F.unhex(F.lit(x))).otherwise(F.unhex(F.lit("")))
    content = F.concat(hexed(F.col("doc_id") % 11 == 0, "FF"), text.cast("binary"), hexed(F.col("doc_id") % 13 == 0, "E282"))
    size = (64 + F.col("doc_id") % 200).cast("int")
    whole = docs.select("doc_id", content.alias("content"), size.alias("size")).withColumn("n", F.greatest(F.lit(1), F.ceil(F.octet_length("content") / F.col("size")).cast("int")))
    chunks = whole.select("doc_id", "content", "size", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"))
    chunks = chunks.select("doc_id", F.col("i").cast("long").alias("chunk_seq"), F.substr("content", F.col("i") * F.col("size") + 1, F.col("size")).alias("bytes"))
    found = incremental.inspected_chunks(chunks, "doc_id")
    total = lambda field: F.aggregate("dicp", F.lit(0).cast("long"), lambda s, x: s + x[field])
    return found.select("doc_id", "byte_length", "valid_utf8", "scalar_count", "dicp_count", "bidi_count", F.size("dicp").alias("kept"), total("scalar_offset").alias("scalar_sum"), total("byte_offset").alias("byte_sum"))


@query(f"""WITH RECURSIVE c AS (SELECT scheme, count(*) FILTER (WHERE score > 48) AS k, count(*) AS n FROM {_RECORDS} GROUP BY scheme),
    f AS (SELECT scheme, n, k, 0::DOUBLE AS a, 1::DOUBLE AS b, 0::DOUBLE AS c, 1::DOUBLE AS d, 0 AS i FROM c WHERE k > 0 AND k < n
        UNION ALL SELECT scheme, n, k, CASE WHEN low < 0.025 THEN (a + b) / 2 ELSE a END, CASE WHEN low < 0.025 THEN b ELSE (a + b) / 2 END, CASE WHEN high < 0.025 THEN c ELSE (c + d) / 2 END, CASE WHEN high < 0.025 THEN (c + d) / 2 ELSE d END, i + 1
        FROM (SELECT *, list_sum(list_transform(range(k, n + 1), lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln((a + b) / 2) + (n - j) * ln(1 - (a + b) / 2)))) AS low,
            list_sum(list_transform(range(0, k + 1), lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln((c + d) / 2) + (n - j) * ln(1 - (c + d) / 2)))) AS high FROM f WHERE i < 50))
    SELECT scheme, n, k, round(a, 8) AS lower, round(c, 8) AS upper FROM f WHERE i = 50""")
def interior_intervals(spark, sf_dir):
    found = _records(spark, sf_dir).groupBy("scheme").agg(F.count_if(F.col("score") > 48).alias("k"), F.count("*").alias("n")).where("k > 0 and k < n")
    found = metrics.with_interval(found, "k", "n", "bounds")
    return found.select("scheme", "n", "k", F.round("bounds.lower", 8).alias("lower"), F.round("bounds.upper", 8).alias("upper"))


@query("""WITH l AS (SELECT vec_id, unnest(embedding)::DOUBLE / 0.8::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS token FROM embeddings),
    k AS (SELECT *, rank() OVER (PARTITION BY vec_id ORDER BY x DESC) AS r FROM l), e AS (SELECT vec_id, token, x, exp(x - max(x) OVER (PARTITION BY vec_id)) AS e FROM k WHERE r <= 40),
    p AS (SELECT vec_id, token, x, e / sum(e) OVER (PARTITION BY vec_id) AS p FROM e), c AS (SELECT *, coalesce(sum(p) OVER (PARTITION BY vec_id ORDER BY x DESC, token ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM p),
    h AS (SELECT vec_id, token, x, p / sum(p) OVER (PARTITION BY vec_id) AS p, count(*) OVER (PARTITION BY vec_id) AS n FROM c WHERE before <= 0.95),
    u AS (SELECT *, sum(p) OVER (PARTITION BY vec_id ORDER BY x DESC, token ROWS UNBOUNDED PRECEDING) AS upto, ('0x' || substr(sha256('7' || chr(0) || vec_id), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS draw FROM h)
    SELECT vec_id, CAST(arg_min(token, upto) AS INTEGER) AS token, CAST(any_value(n) AS INTEGER) AS kept_n, round(arg_min(p, upto), 9) AS p FROM u WHERE upto > draw GROUP BY vec_id""")
def nucleus_draw(spark, sf_dir):
    found = metrics.drawn_tokens(_table(spark, sf_dir, "embeddings"), "embedding", 7, ["vec_id"])
    return found.select("vec_id", "token", "kept_n", F.round("p", 9).alias("p"))


@query(f"""WITH s AS (SELECT doc_id, tokens, unnest(range(0, len(tokens) - 63, 16)) AS start FROM {_WORD_LENGTHS} WHERE len(tokens) >= 64), g AS (SELECT doc_id, start, unnest(list_transform(range(start + 1, start + 62), lambda i: tokens[i : i + 3])) AS gram FROM s),
    c AS (SELECT doc_id, start, count(DISTINCT gram) AS t, count(DISTINCT gram) FILTER (list_sum(gram) % 4 = 0) AS green FROM g GROUP BY doc_id, start), z AS (SELECT *, (green - 0.25::DOUBLE * t) / sqrt(t * 0.1875::DOUBLE) AS z FROM c)
    SELECT doc_id, CAST(count(*) AS INTEGER) AS window_count, CAST(arg_max(start, (z, -start)) AS INTEGER) AS window_start, CAST(arg_max(t, (z, -start)) AS INTEGER) AS scored_units, CAST(arg_max(green, (z, -start)) AS INTEGER) AS green_count, round(max(z), 9) AS window_score FROM z GROUP BY doc_id""")
def window_ngram_maximum(spark, sf_dir):
    green = lambda g: (g[0] + g[1] + g[2] + g[3]) % 4 == 0
    found = windows.ngram_window_maximum(_word_lengths(spark, sf_dir), "tokens", green, 4, 64, 16).where("window_count > 0")
    return found.select("doc_id", "window_count", "window_start", "scored_units", "green_count", F.round("window_score", 9).alias("window_score"))


@query(f"""WITH r AS (SELECT lang, '=' || length(CAST(doc_id AS VARCHAR)) || ':' || doc_id || coalesce('=' || length(source) || ':' || source, '-') AS t FROM {_SCORES} WHERE quality = 1),
    w AS (SELECT lang, count(*) AS n, {", ".join(f"CAST(sum(('0x' || substr(sha256(t), {8 * i + 1}, 8))::BIGINT) AS VARCHAR) AS w{i}" for i in range(8))} FROM r GROUP BY lang)
    SELECT lang, sha256(concat_ws(',', CAST(n AS VARCHAR), {", ".join(f"w{i}" for i in range(8))})) AS calibration_sha256 FROM w""")
def calibration_provenance(spark, sf_dir):
    rows = _scores(spark, sf_dir).where("quality = 1")
    return calibrate.multiset_digest(rows, ["lang"], ["doc_id", "source"], "calibration_sha256")


@query("""WITH l AS (SELECT doc_id AS ordinal, sha256(text) || '  item-' || CASE WHEN doc_id % 17 = 5 THEN lpad(CAST(doc_id - 1 AS VARCHAR), 12, '0') WHEN doc_id % 19 = 7 THEN lpad(CAST(doc_id - 2 AS VARCHAR), 12, '0') ELSE lpad(CAST(doc_id AS VARCHAR), 12, '0') END AS line, doc_id % 23 = 3 AS bad FROM documents WHERE text IS NOT NULL),
    n AS (SELECT ordinal, CASE WHEN bad THEN '' ELSE line[67:] END AS name, bad FROM l), b AS (SELECT *, lag(name) OVER (ORDER BY ordinal) AS before FROM n)
    SELECT ordinal, name, CASE WHEN bad THEN 'form' WHEN before = name THEN 'duplicate' WHEN before > name THEN 'order' END AS problem FROM b""")
def checksum_lines(spark, sf_dir):
    d = F.col("doc_id")
    own = F.when(d % 17 == 5, d - 1).when(d % 19 == 7, d - 2).otherwise(d)
    line = F.concat(F.sha2("text", 256), F.when(d % 23 == 3, " ").otherwise("  "), F.lit("item-"), F.lpad(own.cast("string"), 12, "0"))
    lines = _table(spark, sf_dir, "documents").where("text is not null").select(d.alias("ordinal"), line.alias("value"))
    return ledger.parsed_checksums(lines).select("ordinal", "name", "problem")


#: What is planted in a report by its id's last digit, and what the import says of it.
_PLANTED = (
    (None, None), ("keys", "$: unknown key"), ("type", "artifact.byte_length: not an integer"), ("keys", "findings[]: missing key"), ("trace", f"findings[].trace: not that of {C.NFC}"),
    ("unsupported schema version", "schema_version: unsupported"), ("not JSON", "$: not JSON"), ("duplicate", "findings[]: a mechanism twice"), ("digest", "artifact.content_sha256: not of its form"), ("status", "findings[].status: not a known value"),
)


@query("SELECT doc_id, " + ", ".join("CASE doc_id % 10 " + " ".join(f"WHEN {i} THEN '{p[j]}'" for i, p in enumerate(_PLANTED) if p[j]) + f" END AS {name}" for j, name in enumerate(("problem", "detail"))) + f", CASE WHEN doc_id % 10 = 0 THEN sha256(text) END AS content_sha256, CASE WHEN doc_id % 10 = 0 THEN '{C.NFC}' END AS mechanism_id, CASE WHEN doc_id % 10 = 0 THEN CASE WHEN n_chars % 2 = 0 THEN 'present' ELSE 'absent' END END AS status FROM documents WHERE text IS NOT NULL")
def imported_reports(spark, sf_dir):
    """A report for each document as JSON, some with something planted, read back as if it came from outside."""
    d = F.col("doc_id") % 10
    docs = _table(spark, sf_dir, "documents").where("text is not null")
    status = F.when(d == 9, "maybe").otherwise(F.when(F.col("n_chars") % 2 == 0, "present").otherwise("absent"))
    known = docs.select("doc_id", F.octet_length("text").cast("long").alias("byte_length"), F.sha2("text", 256).alias("content_sha256"), F.lit(C.NFC).alias("mechanism_id"), F.lit("15").alias("mechanism_version"), status.alias("status"), F.array().cast("array<struct<name:string,value:string>>").alias("evidence"), F.array(F.lit("none")).alias("limitations"), d.alias("d"))
    found = report.with_trace(known)
    supports = F.when(F.col("d") == 4, F.array(F.lit("human_authorship"))).otherwise(F.col("trace.supports"))
    found = found.withColumn("trace", F.col("trace").withField("supports", supports))
    finding = F.struct("mechanism_id", "mechanism_version", "status", "evidence", "limitations", "trace")
    findings_ = F.when(F.col("d") == 7, F.array(finding, finding)).otherwise(F.array(finding))
    digest = F.when(F.col("d") == 8, F.upper("content_sha256")).otherwise(F.col("content_sha256"))
    body = F.to_json(F.struct(F.when(F.col("d") == 5, "0.3").otherwise("0.2").alias("schema_version"), F.struct("byte_length", digest.alias("content_sha256")).alias("artifact"), findings_.alias("findings")), {"ignoreNullFields": "false"})
    text = (
        F.when(F.col("d") == 1, F.concat(F.lit('{"extra":1,'), F.substr(body, F.lit(2)))).when(F.col("d") == 2, F.regexp_replace(body, '"byte_length":(\\d+)', '"byte_length":"$1"'))
        .when(F.col("d") == 3, F.replace(body, F.lit('"limitations":["none"],'), F.lit(""))).when(F.col("d") == 6, F.concat(F.lit("x"), body)).otherwise(body)
    )
    return report.imported(found.select("doc_id", text.alias("value")), need_traces=True, keep=["doc_id"]).drop("is_untrusted")


@query("""SELECT lang AS task, sha256('[' || string_agg('"' || doc_id || '"', ',' ORDER BY doc_id) || ']') AS sample_ids_sha256 FROM documents GROUP BY lang""")
def sample_digests(spark, sf_dir):
    members = _table(spark, sf_dir, "documents").select(F.col("lang").alias("task"), F.col("doc_id").alias("ordinal"), F.col("doc_id").cast("string").alias("sample_id"))
    return samples.ids_digest(members, ["task"])


@query("""WITH l AS (SELECT unnest(['en', 'de', 'fr', 'xx']) AS lang, generate_subscripts([0, 0, 0, 0], 1) - 1 AS i), n AS (SELECT unnest([32, 64, 128]) AS length, generate_subscripts([0, 0, 0], 1) - 1 AS j), s AS (SELECT unnest([0.1::DOUBLE, 0.2::DOUBLE]) AS strength, generate_subscripts([0, 0], 1) - 1 AS k)
    SELECT i * 6 + j * 2 + k AS cell, l.lang AS lang, length, strength, count(doc_id) AS entries, count(doc_id) FILTER (n_chars >= length * 10) AS long_enough FROM l CROSS JOIN n CROSS JOIN s LEFT JOIN documents d ON d.lang = l.lang GROUP BY ALL""")
def experiment_grid(spark, sf_dir):
    cells = samples.grid(spark, lang=["en", "de", "fr", "xx"], length=[32, 64, 128], strength=[0.1, 0.2])
    found = samples.expanded(cells, _table(spark, sf_dir, "documents").select("lang", "doc_id", "n_chars"), ["lang"])
    return found.groupBy("cell", "lang", "length", "strength").agg(F.count("doc_id").alias("entries"), F.count_if(F.col("n_chars") >= F.col("length") * 10).alias("long_enough"))


@query(f"""WITH t AS (SELECT doc_id, list_transform(tokens, lambda x: chr(33 + least(x, 89))) AS a, list_transform(list_filter(range(1, len(tokens) + 1), lambda i: i % 7 <> 0), lambda i: chr(33 + least(tokens[i], 89) + CASE WHEN i % 5 = 0 THEN 1 ELSE 0 END)) AS b FROM {_WORD_LENGTHS}),
    d AS (SELECT doc_id, len(a) AS n, levenshtein(array_to_string(a, ''), array_to_string(b, '')) AS distance FROM t) SELECT doc_id, CAST(distance AS INTEGER) AS distance, round(distance / n, 9) AS normalized FROM d""")
def distance_of_edits(spark, sf_dir):
    """Each seventh token deleted, each fifth one changed: the distance is at most their number, and less where neighbours are alike."""
    rows = _word_lengths(spark, sf_dir).select("doc_id", F.transform("tokens", lambda x: F.least(x, F.lit(89))).alias("a"))
    numbered = F.transform("a", lambda x, i: F.struct((i + 1).alias("i"), x.alias("x")))
    edited = F.transform(F.filter(numbered, lambda s: s["i"] % 7 != 0), lambda s: s["x"] + F.when(s["i"] % 5 == 0, 1).otherwise(0))
    return rows.select("doc_id", quality.token_distance(F.col("a"), edited).alias("d")).select("doc_id", "d.distance", F.round("d.normalized", 9).alias("normalized"))
