"""Ledgers, manifests and releases: integrity as joins that yield violations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scan import running_before


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("rows")).where("rows > 1")


def unresolved(claims: DataFrame, listed: str, known: DataFrame, key: str, claim: str = "claim_id") -> DataFrame:
    """(claim, key) for entries of the array `listed` that `known` does not have."""
    return claims.select(claim, F.explode(listed).alias(key)).join(known, key, "left_anti").select(claim, key)


def claim_violations(claims: DataFrame, sources: DataFrame, evidence: DataFrame, commands: list[str]) -> DataFrame:
    """From claims (claim_id, source_ids, evidence_paths, command): (kind, claim_id, detail)."""
    twice = duplicate_keys(claims, "claim_id").select(F.lit("duplicate_claim").alias("kind"), "claim_id", F.col("rows").cast("string").alias("detail"))
    no_source = unresolved(claims, "source_ids", sources, "source_id").select(F.lit("unknown_source").alias("kind"), "claim_id", F.col("source_id").alias("detail"))
    no_file = unresolved(claims, "evidence_paths", evidence, "path").select(F.lit("missing_evidence").alias("kind"), "claim_id", F.col("path").alias("detail"))
    command = claims.where(~F.col("command").isin(*commands)).select(F.lit("command").alias("kind"), "claim_id", F.col("command").alias("detail"))
    return twice.unionByName(no_source).unionByName(no_file).unionByName(command)


def artifact_status(expected: DataFrame, found: DataFrame, checked_out: DataFrame) -> DataFrame:
    """From expected (source_id, path, sha256), found (source_id, path, found_sha256) and checked_out (source_id): a status for each artifact."""
    joined = expected.join(checked_out.distinct().withColumn("_there", F.lit(True)), "source_id", "left").join(found, ["source_id", "path"], "left")
    status = F.when(F.col("_there").isNull(), "IDENTITY_RECORDED").when(F.col("found_sha256").isNull(), "CACHE_MISSING").when(F.col("found_sha256") == F.col("sha256"), "VERIFIED").otherwise("HASH_MISMATCH")
    return joined.select("source_id", "path", status.alias("status"))


def gates(results: DataFrame, by: list[str]) -> DataFrame:
    """A gate passes on exit code 0 alone; a proof is complete if all gates pass."""
    passed = F.coalesce(F.col("exit_code") == 0, F.lit(False))
    return results.groupBy(*by).agg(F.count("*").alias("gates"), F.count_if(passed).alias("passed"), F.when(F.bool_and(passed), "PROOF_COMPLETE").otherwise("PROOF_INCOMPLETE").alias("state"))


def order_differences(left: DataFrame, right: DataFrame, ordinal: str, key: str) -> DataFrame:
    """Places at which two ordered lists differ, missing places included."""
    a, b = left.select(ordinal, F.col(key).alias("left_key")), right.select(ordinal, F.col(key).alias("right_key"))
    return a.join(b, ordinal, "full_outer").where(~F.col("left_key").eqNullSafe(F.col("right_key")))


def both_sided_difference(left: DataFrame, right: DataFrame, keys: list[str], compared: list[str] | None = None) -> DataFrame:
    """Keys on one side only (`missing`: left only, `extra`: right only), and those whose compared attributes differ (`changed`)."""
    compared = compared or []
    a = left.select(*keys, F.struct(F.lit(1).alias("_"), *compared).alias("_a"))
    b = right.select(*keys, F.struct(F.lit(1).alias("_"), *compared).alias("_b"))
    kind = F.when(F.col("_b").isNull(), "missing").when(F.col("_a").isNull(), "extra").when(F.col("_a") != F.col("_b"), "changed").when(~F.col("_a").eqNullSafe(F.col("_b")), "changed")
    return a.join(b, keys, "full_outer").select(*keys, kind.alias("kind")).where("kind is not null")


def assembled(claims: DataFrame) -> DataFrame:
    """All sources and fixtures of a ledger, distinct and in order."""
    return claims.agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("source_ids")))).alias("source_ids"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("evidence_paths")))).alias("fixtures"))


def platform_comparison(results: DataFrame, platforms: list[str]) -> DataFrame:
    """From results (platform, fixture_id, input_sha256, semantic_sha256): by fixture, whether all platforms have it, on one input and with one
    meaning."""
    out = results.groupBy("fixture_id").agg(F.count_distinct("platform").alias("platforms"), F.count_distinct("input_sha256").alias("inputs"), F.count_distinct("semantic_sha256").alias("meanings"))
    return out.withColumn("status", F.when(F.col("platforms") < len(platforms), "MISSING_PLATFORM").when(F.col("inputs") > 1, "INPUT_DIFFERS").when(F.col("meanings") > 1, "MEANING_DIFFERS").otherwise("ESTABLISHED"))


def checksums(files: DataFrame, own_name: str = "SHA256SUMS") -> DataFrame:
    """Lines `hash  name` of files (name, content) in the order of names, without the list's own entry."""
    return files.where(F.col("name") != own_name).select("name", F.format_string("%s  %s", F.sha2("content", 256), "name").alias("line")).orderBy("name")


def parsed_checksums(lines: DataFrame) -> DataFrame:
    """(ordinal, sha256, name, problem) from lines (ordinal, value): form, order and repeats are looked at."""
    form = r"^([0-9a-f]{64})  ([^/\\\n]+)$"
    out = lines.select("ordinal", F.regexp_extract("value", form, 1).alias("sha256"), F.regexp_extract("value", form, 2).alias("name"))
    out = running_before(out, [], "ordinal", F.struct("ordinal", "name"), "max", "_before")
    before = F.col("_before.name")
    return out.withColumn("problem", F.when(F.col("sha256") == "", "form").when(before == F.col("name"), "duplicate").when(before > F.col("name"), "order")).drop("_before")


def release_violations(manifest: DataFrame, listed: DataFrame, files: DataFrame) -> DataFrame:
    """From manifest (name, sha256), listed (name, sha256) and files (name, sha256): names that are not the same everywhere."""
    a, b, c = (d.select("name", F.col("sha256").alias(n)) for d, n in ((manifest, "manifest"), (listed, "listed"), (files, "file")))
    joined = a.join(b, "name", "full_outer").join(c, "name", "full_outer")
    return joined.where(~(F.col("manifest").eqNullSafe(F.col("listed")) & F.col("manifest").eqNullSafe(F.col("file"))))


def size_violations(members: DataFrame, bounds: dict[str, int], most: int) -> DataFrame:
    """Members (name, size) over the bound of their suffix, or over the general one."""
    bound = F.lit(most)
    for suffix, n in bounds.items():
        bound = F.when(F.col("name").endswith(suffix), n).otherwise(bound)
    return members.where((F.col("size") > bound) | F.col("name").rlike(r"(^/)|(^|/)\.\.(/|$)"))


def union_inventory(targets: dict[str, DataFrame]) -> DataFrame:
    """Packages (name, version, license) of several targets: by package its targets, and how many licenses are told for it."""
    everything = None
    for target, packages in targets.items():
        own = packages.select("name", "version", "license").withColumn("target", F.lit(target))
        everything = own if everything is None else everything.unionByName(own)
    return everything.groupBy("name", "version").agg(F.array_sort(F.collect_set("target")).alias("targets"), F.count_distinct("license").alias("licenses"), F.min("license").alias("license"))


def by_digest(wanted: DataFrame, candidates: DataFrame) -> DataFrame:
    """From wanted (name, sha256) and candidates (path, sha256): the one candidate of each digest, `problem` if there is none or several."""
    out = wanted.join(candidates, "sha256", "left").groupBy("name", "sha256").agg(F.count("path").alias("n"), F.min("path").alias("path"))
    return out.select("name", "sha256", F.when(F.col("n") == 1, F.col("path")).alias("path"), F.when(F.col("n") == 0, "missing").when(F.col("n") > 1, "ambiguous").alias("problem"))


def with_fallback(packages: DataFrame, own: DataFrame, fallback: DataFrame, keys: list[str], value: str) -> tuple[DataFrame, DataFrame]:
    """Packages with their own value, else the fallback's; and fallbacks that nothing used."""
    a = own.select(*keys, F.col(value).alias("_own"))
    b = fallback.select(*keys, F.col(value).alias("_fallback"))
    joined = packages.join(a, keys, "left").join(b, keys, "left")
    used = joined.where("_own is null and _fallback is not null").select(*keys)
    return joined.withColumn(value, F.coalesce("_own", "_fallback")).drop("_own", "_fallback"), fallback.join(used, keys, "left_anti")


def recomputed_differences(stored: DataFrame, recomputed: DataFrame) -> DataFrame:
    """Rows of one table and not the other, with repeats."""
    recomputed = recomputed.select(*stored.columns)
    return stored.exceptAll(recomputed).withColumn("side", F.lit("stored")).unionByName(recomputed.exceptAll(stored).withColumn("side", F.lit("recomputed")))
