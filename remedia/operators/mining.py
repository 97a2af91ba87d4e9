"""Aggregates over mined action patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def action_summary(patterns: DataFrame) -> DataFrame:
    """Count, mean and least delta, and the first example of each action."""
    return patterns.groupBy("action_type").agg(
        F.count("*").alias("n_cases"), F.round(F.avg("combined_distance_delta"), 6).alias("mean_delta"),
        F.min("combined_distance_delta").cast("long").alias("min_delta"), F.min_by("case_id", "row_idx").alias("example"),
    )


def action_counts(patterns: DataFrame) -> DataFrame:
    """Counts, most common first; equals in order of first appearance."""
    counts = patterns.groupBy("action_type").agg(F.count("*").alias("n_cases"), F.min("row_idx").alias("first_idx"))
    return counts.orderBy(F.desc("n_cases"), "first_idx")


def lowest_deltas(patterns: DataFrame, top: int = 200) -> DataFrame:
    return patterns.orderBy(F.asc_nulls_last("combined_distance_delta"), "row_idx").limit(top)


def top_values(rows: DataFrame, by: str, values: str, top: int = 5) -> DataFrame:
    """The most common non-blank list members of each group; equals in order of first appearance, then by value."""
    each = rows.select(by, "row_idx", F.explode(values).alias("value")).filter(F.coalesce(F.col("value"), F.lit("")) != "")
    counts = each.groupBy(by, "value").agg(F.count("*").alias("n"), F.min("row_idx").alias("first_idx"))
    nth = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("n"), "first_idx", "value"))
    return counts.withColumn("nth", nth).filter(F.col("nth") <= top).select(by, "value", "n", F.col("nth").cast("long").alias("nth"))


def metadata_delta(gt: dict[str, Column], derived: dict[str, Column]) -> dict[str, Column]:
    """Set-difference counts of names, constants and variables both ways, and whether arguments and flags differ."""
    out = {}
    for name in ("names", "consts", "varnames"):
        out[f"gt_only_{name}_count"] = F.size(F.array_except(gt[name], derived[name]))
        out[f"derived_only_{name}_count"] = F.size(F.array_except(derived[name], gt[name]))
    differs = lambda k: ~gt[k].eqNullSafe(derived[k])
    out["arg_shape_changed"] = differs("argcount") | differs("posonlyargcount") | differs("kwonlyargcount")
    out["flags_changed"] = differs("flags")
    return out


def strategies(records: DataFrame, names: list[str], count: int) -> DataFrame:
    """One row a record and candidate strategy; the list is cut to 1 to all of its members."""
    kept = names[: max(1, min(count, len(names)))]
    return records.select("*", F.posexplode(F.array(*map(F.lit, kept))).alias("strategy_idx", "strategy"))


def first_overall(rows: DataFrame, test: Column, most: int, *order: str) -> DataFrame:
    """The first ``most`` rows that pass a test, over the whole table in a declared order."""
    return rows.filter(test).orderBy(*order).limit(most)


def build_patterns(cases: DataFrame) -> DataFrame:
    """Pattern rows from accepted telemetry cases.

    ``cases`` has row_idx, case_id, accepted, repair_operation, target_kind, alignment_tag, before_fragment, after_fragment,
    instruction_diff, gt_window, derived_window, gt and derived (structs of names, consts, varnames, argcount,
    posonlyargcount, kwonlyargcount, flags) and combined_distance_delta. Fragments are parsed once each, in Arrow batches.
    """
    from ..functions import deltas, fragments, labels

    rows = cases.filter(F.coalesce(F.col("accepted"), F.lit(False)))
    rows = rows.withColumn("_before", fragments.features("before_fragment")).withColumn("_after", fragments.features("after_fragment"))
    rows = rows.withColumns({k: F.coalesce(c, F.lit(False)) for k, c in labels.instruction_flags(F.col("instruction_diff"), F.col("gt_window"), F.col("derived_window")).items()})
    side = lambda s: {k: F.col(f"{s}.{k}") for k in ("names", "consts", "varnames", "argcount", "posonlyargcount", "kwonlyargcount", "flags")}
    rows = rows.withColumns({k: F.coalesce(c, F.lit(0)) if k.endswith("_count") else c for k, c in metadata_delta(side("gt"), side("derived")).items()})
    rows = rows.withColumns(deltas.source_delta(F.col("_before"), F.col("_after")))
    rows = rows.withColumn("alignment_category", labels.indexed_alignment(F.col("repair_operation"), F.col("alignment_tag")))
    return rows.withColumn("action_type", labels.action(F.col)).drop("_before", "_after", "gt", "derived")
