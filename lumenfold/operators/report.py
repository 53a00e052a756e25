"""Report algebra: traces, legality, canonical order, JSON, semantic identity, import."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as C
from .closed import Items, Keys, Text, Truth, Whole
from .closed import problem as closed_problem

TRACE = (
    "mechanism_id string, status string, observation string, verifier string, verifier_available boolean, authority array<string>, sources array<string>, configuration string, "
    "supports array<string>, does_not_support array<string>, related_reference string"
)
_MARKS = ("watermark_present", "watermark_absent")
_C2PA_LIMITS = ("authorship", "truthfulness", *_MARKS)
#: Rows of the trace ontology: observation, verifier, available, authority, sources, configuration, what present and absent support, what is
#: never supported beyond ALWAYS_FORBIDDEN.
ONTOLOGY = {
    C.BIDI: ("unicode_property_membership", "engine.unicode_property_scan", True, ("STANDARD", "PROJECT_IMPLEMENTATION", "PROJECT_IMPLEMENTATION"), ("unicode-proplist-17.0.0", "unicode-uax44-17.0.0"), "unicode-17.0.0", "unicode_property_present", "unicode_property_absent_within_scope", ("malicious_intent", *_MARKS)),
    C.DICP: ("unicode_property_membership", "engine.unicode_property_scan", True, ("STANDARD", "PROJECT_IMPLEMENTATION", "PROJECT_IMPLEMENTATION"), ("unicode-derived-core-properties-17.0.0", "unicode-uax44-17.0.0"), "unicode-17.0.0", "unicode_property_present", "unicode_property_absent_within_scope", ("malicious_intent", *_MARKS)),
    C.NFC: ("unicode_normalization_difference", "engine.unicodedata", True, ("STANDARD", "PUBLIC_REFERENCE", "PUBLIC_REFERENCE"), ("unicode-uax15",), "unicodedata", "unicode_normalization_difference_present", "unicode_normalization_difference_absent_within_scope", ("malicious_intent", *_MARKS)),
    C.NFKC: ("unicode_normalization_difference", "engine.unicodedata", True, ("STANDARD", "PUBLIC_REFERENCE", "PUBLIC_REFERENCE"), ("unicode-uax15",), "unicodedata", "unicode_normalization_difference_present", "unicode_normalization_difference_absent_within_scope", ("malicious_intent", *_MARKS)),
    C.WRAPPER: ("c2pa_text_manifest_wrapper", "engine.c2pa_text_wrapper", True, ("STANDARD", "PROJECT_IMPLEMENTATION", "PROJECT_IMPLEMENTATION"), ("c2pa-spec-2.4",), "c2pa-2.4-a8", "c2pa_carrier_present", "c2pa_carrier_absent_within_scope", ("c2pa_claim_validity", "c2pa_credential_trust", "c2pa_hard_binding", *_C2PA_LIMITS)),
    C.STORE: ("c2pa_manifest_store", "c2pa", False, ("STANDARD", "PUBLIC_REFERENCE", "PUBLIC_REFERENCE"), ("c2pa-spec-2.4",), "none", "c2pa_manifest_store_present", "c2pa_manifest_store_absent_within_scope", ("c2pa_claim_validity", "c2pa_hard_binding", "c2pa_credential_trust", *_C2PA_LIMITS)),
    C.VALIDATION: ("c2pa_manifest_validation", "c2pa", False, ("STANDARD", "PUBLIC_REFERENCE", "PUBLIC_REFERENCE"), ("c2pa-spec-2.4",), "none", "c2pa_claim_valid", None, ("c2pa_hard_binding", "c2pa_credential_trust", *_C2PA_LIMITS)),
    C.BINDING: ("c2pa_hard_binding", "c2pa", False, ("STANDARD", "PUBLIC_REFERENCE", "PUBLIC_REFERENCE"), ("c2pa-spec-2.4",), "none", "c2pa_hard_binding_valid", None, ("c2pa_credential_trust", *_C2PA_LIMITS)),
    C.TRUST: ("c2pa_credential_trust", "c2pa", False, ("STANDARD", "PUBLIC_REFERENCE", "PUBLIC_REFERENCE"), ("c2pa-spec-2.4",), "none", "c2pa_credential_trusted", None, _C2PA_LIMITS),
    C.REFERENCE_DETECTOR: ("statistical_watermark_decision", "engine.reference_detector", True, ("PUBLIC_REFERENCE",) * 3, ("synthid-text",), "recorded-controlled-configuration-required", "public_reference_watermark_present", "public_reference_watermark_absent_within_configuration", ("claude_provider_parity", "claude_watermark_absent", "claude_watermark_present")),
    C.PROVIDER: ("provider_text_watermark", "provider.detector", False, ("PUBLIC_MECHANISM_PRIVATE_KEY", "UNDOCUMENTED_PROVIDER", "UNDOCUMENTED_PROVIDER"), ("provider-marking",), None, None, None, ("claude_provider_parity", "claude_watermark_absent", "claude_watermark_present", *_MARKS)),
}


def trace(mechanism: str, status: str) -> tuple:
    """The trace of a finding, a function of mechanism and status alone."""
    order = C.INFERENCES.index
    if mechanism not in ONTOLOGY:
        return mechanism, status, "unclassified", "unspecified", False, ["UNSPECIFIED"] * 3, [], None, [], sorted(C.ALWAYS_FORBIDDEN, key=order), None
    observation, verifier, available, authority, sources, configuration, present, absent, never = ONTOLOGY[mechanism]
    supports = {"present": [present] if present else [], "absent": [absent] if absent else []}.get(status, [])
    if mechanism == C.PROVIDER:
        supports = ["provider_mechanism_family_disclosed", "provider_detector_unavailable"]
    related = C.REFERENCE_DETECTOR if mechanism == C.PROVIDER else None
    return mechanism, status, observation, verifier, available, list(authority), sorted(sources), configuration, sorted(supports, key=order), sorted({*C.ALWAYS_FORBIDDEN, *never}, key=order), related


def ontology(spark: SparkSession) -> DataFrame:
    """All traces: a dimension of a row for each known mechanism and status."""
    return spark.createDataFrame([trace(m, s) for m in C.MECHANISMS for s in C.STATUSES], TRACE)


def traced(findings: DataFrame) -> DataFrame:
    """Findings with their traces; an unknown mechanism gets the unclassified one. The dimension has a fixed number of rows."""
    known = F.broadcast(ontology(findings.sparkSession))
    out = findings.join(known, ["mechanism_id", "status"], "left")
    forbidden = F.array(*[F.lit(x) for x in trace("other", "unknown")[9]])
    default = {"observation": F.lit("unclassified"), "verifier": F.lit("unspecified"), "verifier_available": F.lit(False), "authority": F.array(*[F.lit(x) for x in trace("other", "unknown")[5]]), "sources": F.array().cast("array<string>"), "supports": F.array().cast("array<string>"), "does_not_support": forbidden}
    return out.withColumns({k: F.coalesce(F.col(k), v) for k, v in default.items()})


def violations(findings: DataFrame) -> DataFrame:
    """(kind, artifact_id, mechanism_id): statuses outside the domain, a provider row that claims a result, mechanisms met twice in a report."""
    bad = findings.where(~F.col("status").isin(*C.STATUSES)).select(F.lit("status").alias("kind"), "artifact_id", "mechanism_id")
    claims = findings.where((F.col("mechanism_id") == C.PROVIDER) & ~F.col("status").isin("unknown", "not_applicable")).select(F.lit("provider_claim").alias("kind"), "artifact_id", "mechanism_id")
    twice = findings.groupBy("artifact_id", "mechanism_id").count().where("count > 1").select(F.lit("duplicate").alias("kind"), "artifact_id", "mechanism_id")
    return bad.unionByName(claims).unionByName(twice)


def rank(mechanism: Column) -> Column:
    out = F.lit(len(C.MECHANISMS))
    for i, m in enumerate(C.MECHANISMS):
        out = F.when(mechanism == m, i).otherwise(out)
    return out


FIELDS = ("mechanism_id", "mechanism_version", "status", "evidence", "limitations", "trace")


def _report(all_: Column, fields: list[str]) -> Column:
    body = F.struct(
        F.lit("0.2").alias("schema_version"),
        F.struct(F.col("byte_length"), F.col("content_sha256")).alias("artifact"),
        F.transform(all_, lambda x: F.struct(*[(F.array_sort(x[f]) if f in ("evidence", "limitations") else x[f]).alias(f) for f in fields])).alias("findings"),
    )
    return F.to_json(body, {"ignoreNullFields": "false"}).alias("report")


def reports(findings: DataFrame) -> DataFrame:
    """Findings grouped back: (artifact_id, report), the report being JSON with nulls shown, findings in canonical order, evidence by name."""
    fields = [c for c in FIELDS if c in findings.columns]
    one = F.struct(rank(F.col("mechanism_id")).alias("rank"), *fields)
    grouped = findings.groupBy("artifact_id", "byte_length", "content_sha256").agg(F.array_sort(F.collect_list(one)).alias("all"))
    return grouped.select("artifact_id", _report(F.col("all"), fields))


def reports_of(inspected: DataFrame) -> DataFrame:
    """The same from inspected artifacts, whose findings are an array in canonical order already: no shuffle."""
    return inspected.select("artifact_id", _report(F.col("findings"), list(FIELDS[:-1])))


#: The version of the semantic projection's own form, which is not that of a report.
SEMANTIC_VERSION = "0.1"


def semantic_digest(reports_: DataFrame) -> DataFrame:
    """Reports' identity: the hash of the semantic projection, which is the report without the path (left out of the JSON already) under a schema
    version of its own."""
    head = '{"schema_version":"0.2"'
    projected = F.when(F.startswith("report", F.lit(head)), F.concat(F.lit(head.replace("0.2", SEMANTIC_VERSION)), F.substr("report", F.lit(len(head) + 1)))).otherwise(F.raise_error(F.lit("not a report of schema version 0.2")).cast("string"))
    return reports_.select("artifact_id", F.sha2(projected, 256).alias("semantic_sha256"))


TRACE_FIELDS = tuple(x.split()[0] for x in TRACE.split(", "))[2:]
_TRACE_STRUCT = "struct<" + ", ".join(TRACE.split(", ")[2:]) + ">"
REPORT = f"schema_version string, artifact struct<byte_length:bigint,content_sha256:string>, findings array<struct<mechanism_id:string,mechanism_version:string,status:string,evidence:array<struct<name:string,value:string>>,limitations:array<string>,trace:{_TRACE_STRUCT}>>"
_TRACE_KIND = Keys({
    "observation": Text(), "verifier": Text(), "verifier_available": Truth(), "authority": Items(Text()), "sources": Items(Text()), "configuration": Text(nullable=True),
    "supports": Items(Text()), "does_not_support": Items(Text()), "related_reference": Text(nullable=True),
})


def report_kind(need_traces: bool) -> Keys:
    """The closed schema of a report."""
    finding = {
        "mechanism_id": Text(), "mechanism_version": Text(nullable=True), "status": Text(choices=C.STATUSES), "evidence": Items(Keys({"name": Text(), "value": Text(nullable=True)})),
        "limitations": Items(Text()), "trace": _TRACE_KIND,
    }
    return Keys({
        "schema_version": Text(choices=("0.2",)),
        "artifact": Keys({"byte_length": Whole(least=0), "content_sha256": Text(pattern="[0-9a-f]{64}")}),
        "findings": Items(Keys(finding, optional=frozenset() if need_traces else frozenset({"trace"}))),
    })


def with_trace(findings: DataFrame) -> DataFrame:
    """Findings with their trace as one struct, as reports() writes it and imported() reads it."""
    return traced(findings).withColumn("trace", F.struct(*TRACE_FIELDS)).drop(*TRACE_FIELDS)


def _expected(mechanism: Column, status: Column) -> Column:
    """The ontology's trace of a mechanism and status, from a constant; the unclassified one for an unknown mechanism."""
    told = lambda m, s: dict(zip(TRACE_FIELDS, trace(m, s)[2:], strict=True))
    known = {f"{m}|{s}": told(m, s) for m in C.MECHANISMS for s in C.STATUSES} | {"": told("other", "unknown")}
    table = F.from_json(F.lit(json.dumps(known)), f"map<string, {_TRACE_STRUCT}>")
    return F.coalesce(F.try_element_at(table, F.concat(mechanism, F.lit("|"), status)), F.try_element_at(table, F.lit("")))


def imported(lines: DataFrame, column: str = "value", need_traces: bool = False, keep: Sequence[str] = ()) -> DataFrame:
    """Untrusted reports: their findings, a row each, or one row with `problem` (a short name) and `detail` (where and what) for a report that is none.

    In this order: JSON without repeated keys, the schema version, the closed schema at every level, mechanisms met twice, a provider row that claims
    a result, and traces: one that is not the ontology's for its mechanism and status, as when a finding is said to support more than it does,
    makes the whole report no report. Never mixed with produced rows: is_untrusted is true. One projection, nothing is exchanged."""
    df = lines.select(*keep, F.col(column).alias("_t"), F.expr(f"try_parse_json(`{column}`)").alias("_v"))
    version = F.try_variant_get("_v", "$.schema_version", "string")
    closed = F.when(F.col("_v").isNull(), "$: not JSON").when(~version.eqNullSafe(F.lit("0.2")), "schema_version: unsupported").otherwise(closed_problem(F.col("_v"), report_kind(need_traces)))
    df = df.withColumn("_p", closed).withColumn("_r", F.when(F.col("_p").isNull(), F.from_json("_t", REPORT)))
    found = F.col("_r.findings")
    ids = F.transform(found, lambda f: f["mechanism_id"])
    forged = F.filter(found, lambda f: f["trace"].isNotNull() & ~f["trace"].eqNullSafe(_expected(f["mechanism_id"], f["status"])))
    detail = (
        F.when(F.col("_p").isNotNull(), F.col("_p"))
        .when(F.size(F.array_distinct(ids)) < F.size(ids), "findings[]: a mechanism twice")
        .when(F.exists(found, lambda f: (f["mechanism_id"] == C.PROVIDER) & ~f["status"].isin("unknown", "not_applicable")), "findings[]: a provider claim")
        .when(F.size(forged) > 0, F.concat(F.lit("findings[].trace: not that of "), F.get(forged, F.lit(0))["mechanism_id"]))
    )
    short = (
        F.when(F.col("detail").isNull(), F.lit(None).cast("string"))
        .when(F.col("detail") == "$: not JSON", "not JSON")
        .when(F.col("detail").startswith("schema_version"), "unsupported schema version")
        .when(F.col("detail").endswith("key"), "keys")
        .when(F.col("detail") == "artifact.content_sha256: not of its form", "digest")
        .when(F.col("detail") == "findings[].status: not a known value", "status")
        .when(F.col("detail").endswith("a mechanism twice"), "duplicate")
        .when(F.col("detail").endswith("a provider claim"), "provider_claim")
        .when(F.col("detail").contains("not that of"), "trace")
        .otherwise("type")
    )
    df = df.withColumn("detail", detail).withColumn("problem", short).withColumn("_f", F.when(F.col("detail").isNull(), found))
    rows = df.select(*keep, "problem", "detail", "_r", F.explode_outer("_f").alias("f"))
    return rows.select(*keep, F.lit(True).alias("is_untrusted"), "problem", "detail", F.when(F.col("problem").isNull(), F.col("_r.artifact.content_sha256")).alias("content_sha256"), "f.mechanism_id", "f.status")


def upgraded(imported_traces: DataFrame) -> DataFrame:
    """Imported rows (mechanism_id, status, supports, does_not_support) whose trace is not the ontology's."""
    known = F.broadcast(ontology(imported_traces.sparkSession).select("mechanism_id", "status", F.col("supports").alias("known_supports"), F.col("does_not_support").alias("known_limits")))
    joined = imported_traces.join(known, ["mechanism_id", "status"], "left")
    return joined.where(~(F.col("supports").eqNullSafe(F.col("known_supports")) & F.col("does_not_support").eqNullSafe(F.col("known_limits"))))


def shown(findings: DataFrame) -> DataFrame:
    """A short view: no absent findings, the first two items of evidence, grouped as Unicode, C2PA or provider."""
    group = F.when(F.col("mechanism_id").startswith("unicode."), "Unicode").when(F.col("mechanism_id").startswith("c2pa."), "C2PA").otherwise("Provider")
    items = F.array_join(F.transform(F.slice("evidence", 1, 2), lambda e: F.concat(e["name"], F.lit("="), e["value"])), "; ")
    return findings.where("status <> 'absent'").select("artifact_id", group.alias("group"), F.format_string("%s: %s", "mechanism_id", "status").alias("line"), items.alias("evidence"))
