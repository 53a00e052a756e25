"""Findings of artifacts: Unicode properties, normalization, C2PA carriers, provider slot. One row a mechanism and artifact.

UNKNOWN is never ABSENT: what cannot be decided says so. All evidence values are strings, sorted by name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import scalars as S
from ..functions import text as T
from ..sources.artifacts import with_identity

EVIDENCE = "array<struct<name:string,value:string>>"
FINDING = ("mechanism_id", "mechanism_version", "status", "evidence", "limitations")

#: Limitations, by what they are about.
LIMITS = {
    C.DICP: "Default_Ignorable_Code_Point presence is a neutral property observation with legitimate formatting, shaping, language and emoji uses.",
    C.BIDI: "Bidi_Control presence is a neutral property observation; directional controls have legitimate uses.",
    C.NFC: "An NFC difference is a neutral observation; it shows no risk, provenance, authorship, intent or watermark.",
    C.NFKC: "An NFKC difference is a neutral compatibility observation; folding can erase distinctions and is no sanitization.",
    "utf8": "Evidence is unavailable because the complete artifact is not valid UTF-8.",
    "unassigned": "The text has code points that these normalization tables do not assign; a later version may differ.",
    "a8": "C2PA 2.4 Appendix A.8 is under review and may change; this carrier is not a statistical text watermark.",
    "no_verifier": "No verifier of manifest stores is available here; nothing is claimed about integrity or trust.",
    "provider": "The provider's configuration, key, statistic, threshold and interface are not public; unknown does not mean unmarked or written by a person.",
    "provider_binary": "Text-watermark inspection applies to text, not to this binary artifact.",
}


def _evidence(**values: Column) -> Column:
    return F.array(*[F.struct(F.lit(k).alias("name"), v.cast("string").alias("value")) for k, v in sorted(values.items())])


def _none() -> Column:
    return F.array().cast(EVIDENCE)


def _finding(mechanism: str, version: str | Column, status: Column, evidence: Column, limitation: Column) -> Column:
    version = F.lit(version) if isinstance(version, str) else version
    return F.struct(F.lit(mechanism).alias("mechanism_id"), version.alias("mechanism_version"), status.alias("status"), evidence.cast(EVIDENCE).alias("evidence"), F.array(limitation).cast("array<string>").alias("limitations"))


def _invalid() -> Column:
    return _evidence(utf8_validation=F.lit(C.INVALID_UTF8))


def located(mechanism: str, text: Column) -> Column:
    """Locations as JSON: byte and scalar offsets of the first occurrences, with abbreviations for bidi controls only."""
    one = S.DICP_CLASS if mechanism == C.DICP else S.BIDI_CLASS
    found = S.locations(text, one)
    if mechanism == C.DICP:
        found = F.transform(found, lambda x: F.struct(x["code_point"].alias("code_point"), x["byte_offset"].alias("byte_offset"), x["scalar_offset"].alias("scalar_offset")))
    return F.to_json(found)


def property_finding(mechanism: str, text: Column, count: Column) -> Column:
    """count: the occurrences in the text, worked out once; the text is taken apart only if there are any."""
    status = F.when(text.isNull(), "invalid").when(count > 0, "present").otherwise("absent")
    evidence = F.when(text.isNull(), _invalid()).otherwise(_evidence(locations=F.when(count > 0, located(mechanism, text)).otherwise("[]"), locations_truncated=count > C.LOCATIONS, total_occurrence_count=count))
    return _finding(mechanism, "17.0.0", status, evidence, F.when(text.isNull(), LIMITS["utf8"]).otherwise(LIMITS[mechanism]))


def normalization_finding(mechanism: str, text: Column, found: Column) -> Column:
    """found: the difference struct, null columns where the text is in the form. Text with unassigned code points is unknown unless it differs."""
    differs = found["normalized_sha256"].isNotNull()
    status = F.when(text.isNull(), "invalid").when(differs, "present").when(F.coalesce(found["unassigned"], F.lit(False)), "unknown").otherwise("absent")
    names = ("first_difference", "normalized_byte_length", "normalized_scalar_count", "normalized_sha256")
    evidence = F.when(text.isNull(), _invalid()).when(differs, _evidence(**{n: found[n] for n in names})).otherwise(_none())
    limit = F.when(text.isNull(), LIMITS["utf8"]).when(status == "unknown", LIMITS["unassigned"]).otherwise(LIMITS[mechanism])
    return _finding(mechanism, T.NORMALIZATION_VERSION, status, evidence, limit)


def c2pa_findings(textual: Column, valid: Column, carrier: Column, is_svg: Column, scan: Column) -> list[Column]:
    """The ladder: malformed text, unsupported bytes, SVG and binary carriers (no verifier here), and text with or without a wrapper."""
    text = valid & ~carrier & ~is_svg
    status = F.when(text & scan["first_error"].isNotNull(), "invalid").when(text & (scan["wrapper_count"] == 1), "present").when(text, "absent").when(carrier | is_svg, "not_applicable").when(textual, "invalid").otherwise("unsupported")
    evidence = (
        F.when(text & scan["first_error"].isNotNull(), _evidence(candidate_count=scan["candidate_count"], first_error=scan["first_error"]))
        .when(text & (scan["wrapper_count"] == 1), _evidence(first_wrapper=scan["first_wrapper"], wrapper_count=scan["wrapper_count"]))
        .when(status == "invalid", _invalid())
        .otherwise(_none())
    )
    others = F.when(carrier | is_svg | (status == "present") | (status == "unsupported"), "unsupported").otherwise("not_applicable")
    out = [_finding(C.WRAPPER, "2.4", status, evidence, F.lit(LIMITS["a8"]))]
    return out + [_finding(m, "2.4", others, _none(), F.lit(LIMITS["no_verifier"])) for m in C.C2PA[1:]]


def provider_finding(textual: Column) -> Column:
    known = {
        "detector_availability": "announced_forthcoming",
        "exact_deployed_configuration": "undisclosed",
        "provider_detector_api_contract": "unknown_not_public",
        "provider_key": "private_not_public",
        "public_reference_relationship": "related_family_not_deployment_parity",
    }
    evidence = F.when(textual, _evidence(**{k: F.lit(v) for k, v in known.items()})).otherwise(_none())
    return _finding(C.PROVIDER, "exact deployment undisclosed", F.when(textual, "unknown").otherwise("not_applicable"), evidence, F.when(textual, LIMITS["provider"]).otherwise(LIMITS["provider_binary"]))


def inspected(artifacts: DataFrame) -> DataFrame:
    """Artifacts with identity and `findings`, an array of ten. Python sees only texts that are not ASCII, hold U+FEFF or `<svg`."""
    df = with_identity(artifacts)
    text = F.col("text")
    wide = F.when(F.octet_length(text) != F.char_length(text), text)
    marked = F.when(F.contains(text, F.lit("﻿")), text)
    drawn = F.when(F.contains(text, F.lit("<svg")), F.col("content"))
    # An ASCII text has none of these characters; bidi controls are among the default-ignorable ones. Both columns are finished below the
    # Python functions, so what follows does not count again.
    df = df.withColumn("dicp", F.when(wide.isNotNull(), S.occurrences(text, S.DICP_CLASS)).otherwise(F.lit(0).cast("long")))
    df = df.withColumn("bidi", F.when(F.col("dicp") > 0, S.occurrences(text, S.BIDI_CLASS)).otherwise(F.lit(0).cast("long")))
    df = df.withColumns({"nfc": T.nfc_difference(wide), "nfkc": T.nfkc_difference(wide), "wrapper": T.wrapper_scan(marked), "svg": T.svg(drawn)})
    carrier = F.col("format").isNotNull()
    findings = [
        property_finding(C.BIDI, text, F.col("bidi")),
        property_finding(C.DICP, text, F.col("dicp")),
        normalization_finding(C.NFC, text, F.col("nfc")),
        normalization_finding(C.NFKC, text, F.col("nfkc")),
        *c2pa_findings(F.col("textual"), F.col("valid_utf8"), carrier, F.col("svg"), F.col("wrapper")),
        provider_finding(F.col("textual")),
    ]
    return df.withColumn("findings", F.array(*findings)).select("artifact_id", "path", "byte_length", "content_sha256", "valid_utf8", "findings")


def findings(artifacts: DataFrame) -> DataFrame:
    """One row a finding, in canonical order by `rank`. (The array is opened by inline: the optimizer would take an exploded one apart by field,
    and work it out again for each.)"""
    ranked = F.transform("findings", lambda f, i: F.struct(i.alias("rank"), *[f[c].alias(c) for c in FINDING]))
    return inspected(artifacts).select("artifact_id", "byte_length", "content_sha256", F.inline(ranked))
