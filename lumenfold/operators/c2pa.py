"""C2PA results supplied as tables: validation basis over the ingredient graph, hard bindings, status codes, replay of expectations."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import BINDING_TYPES, STATUS_CODES


def validation_basis(manifests: DataFrame, ingredients: DataFrame, active: DataFrame, most_rounds: int | None = None) -> DataFrame:
    """From manifests (store, label, has_time, has_certificate_status), ingredients (store, label, ingredient) and active (store, label):
    (store, reproducible), true iff every manifest reached from the active one has a time and no certificate status. A missing one fails.

    Frontier joins until nothing new is reached; cycles end there. Each round's frontier is checkpointed. Where most_rounds do not reach the
    end, a ValueError is raised."""
    reached = frontier = active.select("store", "label").distinct().checkpoint()
    for done in count():
        fresh = frontier.join(ingredients, ["store", "label"]).select("store", F.col("ingredient").alias("label")).distinct().join(reached, ["store", "label"], "left_anti")
        fresh = fresh.checkpoint()  # what is new alone: what was reached before stays where it is
        if fresh.isEmpty():
            break
        if most_rounds is not None and done + 1 >= most_rounds:
            raise ValueError(f"manifests lie deeper than {most_rounds} rounds reach")
        reached, frontier = reached.unionByName(fresh), fresh
    good = F.coalesce(F.col("has_time") & ~F.col("has_certificate_status"), F.lit(False))
    return reached.join(manifests, ["store", "label"], "left").groupBy("store").agg(F.bool_and(good).alias("reproducible"))


def hard_bindings(codes: DataFrame) -> DataFrame:
    """From codes (store, kind: success or failure, code): the finding of each store. A failure goes before a success, the least code first."""
    types = F.create_map(*[F.lit(x) for kv in BINDING_TYPES.items() for x in kv])
    known = codes.withColumn("binding_type", F.try_element_at(types, F.col("code")))
    ranked = F.when(F.col("binding_type").isNotNull() & F.col("kind").isin("success", "failure"), F.struct((F.col("kind") == "success").alias("success"), "code", "binding_type"))
    out = known.groupBy("store").agg(F.min(ranked).alias("b"))
    status = F.when(F.col("b").isNull(), "not_applicable").when(F.col("b.success"), "present").otherwise("invalid")
    return out.select("store", status.alias("status"), F.col("b.code").alias("validation_code"), F.col("b.binding_type").alias("binding_type"))


def status_codes(codes: DataFrame) -> DataFrame:
    """By store and kind: distinct codes of the active manifest and its ingredients in order, the first STATUS_CODES kept, the total told."""
    out = codes.groupBy("store", "kind").agg(F.array_sort(F.collect_set("code")).alias("all"))
    return out.select("store", "kind", F.slice("all", 1, STATUS_CODES).alias("codes"), F.size("all").alias("total"), (F.size("all") > STATUS_CODES).alias("truncated"))


def resource_errors(errors: DataFrame) -> DataFrame:
    """(error) with what follows: limits and missing resources stop the inspection, everything else makes the store invalid."""
    return errors.withColumn("outcome", F.when(F.lower("error").rlike("limit|memory|resource|i/o|io error"), "abort").otherwise("invalid"))


def replayed(expected: DataFrame, actual: DataFrame, layers: list[str], key: str = "fixture_id") -> DataFrame:
    """Fixtures whose statuses by layer differ from what is expected, or that are missing on either side."""
    a = expected.select(key, F.struct(*layers).alias("expected"))
    b = actual.select(key, F.struct(*layers).alias("actual"))
    return a.join(b, key, "full_outer").where(~F.col("expected").eqNullSafe(F.col("actual")))
