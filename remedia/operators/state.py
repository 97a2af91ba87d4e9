"""Verification states: comparison, acceptance, target selection, candidate ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import labels, scalars


def worst_states(results: DataFrame, file: str = "file", name: str = "names") -> DataFrame:
    """The worst state of each name in each file (names may repeat)."""
    state = labels.state(F.col("success"), F.col("message"), F.col("failed_offset"))
    return results.groupBy(file, name).agg(F.min(state).alias("state"), F.max(F.coalesce("success", F.lit(False))).alias("any_success"))


def compare(before: DataFrame, after: DataFrame, file: str = "file", name: str = "names") -> DataFrame:
    """file, improved, regressed (sorted name lists), successes_before, successes_after for every file of either side.

    Both sides are tagged and aggregated together: one shuffle by (file, name), then one by file.
    """
    state = labels.state(F.col("success"), F.col("message"), F.col("failed_offset"))
    side = lambda rows, tag: rows.select(file, name, F.lit(tag).alias("after"), state.alias("state"), F.coalesce(F.col("success"), F.lit(False)).alias("good"))
    both = side(before, False).unionByName(side(after, True))
    of = lambda tag, value: F.when(F.col("after") == tag, value)
    named = both.groupBy(file, name).agg(
        F.min(of(False, F.col("state"))).alias("old"), F.min(of(True, F.col("state"))).alias("new"),
        F.count_if(of(False, F.col("good"))).alias("good_old"), F.count_if(of(True, F.col("good"))).alias("good_new"),
    )
    old, new = F.col("old"), F.col("new")
    better = F.when(old.isNotNull() & new.isNotNull(), new > old).otherwise(old.isNull() & (new["rank"] == labels.RANK_EQUAL))
    worse = F.when(old.isNotNull() & new.isNotNull(), new < old).otherwise(new.isNull() & (old["rank"] == labels.RANK_EQUAL))
    return named.groupBy(file).agg(
        F.array_sort(F.collect_list(F.when(better, F.col(name)))).alias("improved"), F.array_sort(F.collect_list(F.when(worse, F.col(name)))).alias("regressed"),
        F.sum("good_old").alias("successes_before"), F.sum("good_new").alias("successes_after"),
    )


def non_regressing() -> Column:
    return (F.size("regressed") == 0) & (F.col("successes_after") >= F.col("successes_before"))


def strict_improvement() -> Column:
    return (F.size("improved") > 0) & (F.size("regressed") == 0)


def accept_by_distance(distance_before: Column, distance_after: Column, good_before: Column, good_after: Column) -> Column:
    """Distance must drop without losing a success; or a success must be won. Unknown success counts are ignored."""
    lost, won = F.coalesce(good_after < good_before, F.lit(False)), F.coalesce(good_after > good_before, F.lit(False))
    return F.when(distance_after < distance_before, ~lost).otherwise(won)


def accept_by_oracle(regressed: Column, improved: Column, distance_before: Column, distance_after: Column) -> Column:
    return F.when(regressed > 0, False).when(improved > 0, True).otherwise(distance_after < distance_before)


def improved_enough(before: Column, after: Column, least: int = 1) -> Column:
    return F.coalesce(after <= before - max(1, least), F.lit(False))


def repair_targets(rows: DataFrame, file: str = "file", include_module: bool = True) -> DataFrame:
    """file, target, depth: matched rows with a distance, without those below another target.

    Suppression by a selected ancestor equals suppression by any candidate ancestor, so it is an anti join.
    """
    same = (F.col("status") == "matched") & (F.col("combined_distance") > 0) & (F.col("gt_name") == F.col("derived_name")) & ~scalars.is_synthetic(F.col("gt_name"))
    found = rows.filter(same).select(file, F.col("gt_name").alias("target")).distinct()
    if not include_module:
        found = found.filter("target <> '<module>'")
    above = found.select(file, "target", F.explode(scalars.ancestors(F.col("target"))).alias("_above"))
    hit = above.join(found.select(F.col(file).alias("_f"), F.col("target").alias("_t")), (F.col(file) == F.col("_f")) & (F.col("_above") == F.col("_t")), "left_semi")
    return found.join(hit.select(file, "target").distinct(), [file, "target"], "left_anti").withColumn("depth", scalars.qualname_depth(F.col("target")))


def missing_targets(rows: DataFrame, file: str = "file", filtered: bool = True) -> DataFrame:
    out = rows.filter((F.col("status") == "missing") & (F.coalesce(F.col("gt_name"), F.lit("")) != "")).select(file, F.col("gt_name").alias("target"))
    return out.filter((F.col("target") != "<module>") & ~scalars.is_synthetic(F.col("target"))).distinct() if filtered else out


def extra_targets(rows: DataFrame, file: str = "file") -> DataFrame:
    """Names only the derived side has, deepest first."""
    found = rows.filter((F.col("status") == "extra") & (F.coalesce(F.col("derived_name"), F.lit("")) != "") & (F.col("derived_name") != "<module>"))
    found = found.select(file, F.col("derived_name").alias("target")).distinct().withColumn("depth", scalars.qualname_depth(F.col("target")))
    return found.withColumn("nth", F.row_number().over(Window.partitionBy(file).orderBy(F.desc("depth"), F.desc("target"))).cast("long"))


def child_parents(rows: DataFrame, file: str = "file") -> DataFrame:
    """Missing expression children whose parent exists on either side: file, child, child_kind, parent."""
    names = rows.select(file, F.explode(F.array("gt_name", "derived_name")).alias("parent")).filter("parent IS NOT NULL").distinct()
    child = rows.filter(F.col("status") == "missing").select(file, F.col("gt_name").alias("child"))
    child = child.withColumn("parent", scalars.expression_parent(F.col("child"))).filter("parent IS NOT NULL AND parent <> '' AND parent <> '<module>'")
    return child.join(names, [file, "parent"], "left_semi").select(file, "child", scalars.expression_kind(F.col("child")).alias("child_kind"), "parent")


def failing_targets(results: DataFrame, attempts: DataFrame, most: int, file: str = "file") -> DataFrame:
    """Names that fail verification and have attempts left, in order of first appearance."""
    failing = results.filter(~F.coalesce(F.col("success"), F.lit(False))).groupBy(file, "names").agg(F.min("row_idx").alias("first_idx"))
    left = failing.join(attempts, [file, "names"], "left").filter(F.coalesce(F.col("attempts"), F.lit(0)) < most)
    return left.select(file, "names", F.row_number().over(Window.partitionBy(file).orderBy("first_idx", "names")).cast("long").alias("nth"))


def best_candidates(candidates: DataFrame, *keys: str) -> DataFrame:
    """One candidate a key: accepted first, then least distance, most successes, first index."""
    order = F.struct(~F.col("accepted"), F.col("distance"), -F.col("successes"), F.col("candidate_idx"))
    rows = candidates.groupBy(*keys).agg(F.min(F.struct(order.alias("o"), F.struct(*(c for c in candidates.columns if c not in keys)).alias("row"))).alias("best"))
    return rows.select(*keys, "best.row.*")


def score_changes(before: DataFrame, after: DataFrame, file: str = "file") -> DataFrame:
    """First score of each name on both sides; a name that is gone afterwards counts as resolved to zero."""
    first = lambda rows, out: rows.groupBy(file, "names").agg(F.min_by("combined_distance", "row_idx").cast("long").alias(out))
    both = first(before, "initial").join(first(after, "final"), [file, "names"], "full_outer")
    resolved = F.col("initial").isNotNull() & F.col("final").isNull()
    both = both.withColumn("resolved", resolved).withColumn("final", F.when(resolved, 0).otherwise(F.col("final")))
    return both.withColumn("delta", F.col("final") - F.col("initial"))


def siblings_lost(before: Column, after: Column, target: Column) -> Column:
    """Names that a candidate would make vanish besides its target."""
    return F.array_remove(F.array_except(before, after), target)
