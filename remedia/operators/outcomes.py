"""Outcome reports of repair runs, and line-level deltas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import labels
from ..functions.scalars import stripped


def latest(log: DataFrame, key: str = "file_hash", *order: str) -> DataFrame:
    """The last attempt at each file."""
    w = Window.partitionBy(key).orderBy(*(F.desc(o) for o in order))
    return log.withColumn("_nth", F.row_number().over(w)).filter("_nth = 1").drop("_nth")


def with_outcome(log: DataFrame) -> DataFrame:
    get = lambda name, kind: F.col(name) if name in log.columns else F.lit(None).cast(kind)
    return log.withColumn(
        "outcome",
        labels.outcome(
            F.col("compiled_success"), get("delete_only_fallback_used", "boolean"), get("lines_deleted_vs_original", "int"), get("delete_only_deletions", "int"),
            get("forced_compile_used", "boolean"), get("lossy_literal_closure", "boolean"),
        ),
    )


def rollup(log: DataFrame, *by: str) -> DataFrame:
    """Files, deleted lines and rate of each outcome; rates leave out what is out of scope.

    One aggregation; the total is a window over its few result rows.
    """
    counts = with_outcome(log).groupBy(*by, "outcome").agg(F.count("*").alias("n_files"), F.sum("lines_deleted").cast("long").alias("sum_deleted"))
    scoped = F.col("outcome") != "out_of_scope"
    total = F.sum(F.when(scoped, F.col("n_files")).otherwise(0)).over(Window.partitionBy(*(by or [F.lit(0)])))
    return counts.withColumn("rate", F.when(scoped, F.round(F.col("n_files") / total, 6)))


def counters(log: DataFrame, *by: str) -> DataFrame:
    return log.groupBy(*by).agg(
        F.count("*").alias("processed"),
        F.count_if(F.col("compiled_success")).alias("repaired"),
        F.count_if(~F.col("compiled_success")).alias("failed"),
        F.count_if(F.col("compiled_success").isNull()).alias("deferred"),
    )


def significant_lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\r\n|\n|\r"), stripped), lambda s: s != "")


def deleted_lines(pairs: DataFrame, key: str, before: str, after: str) -> DataFrame:
    """key, n_deleted: stripped non-blank lines, with repeats, of ``before`` that ``after`` lacks.

    Both sides become signed line counts beside a mark that keeps keys without lines. Grouping by (key, line) and
    by key is met by rows dealt by key, so behind a join on the key no line is shuffled. An empty side counts as nothing deleted.
    """
    none = F.array().cast("array<struct<line:string,n:int>>")
    usable = (F.col(before) != "") & (F.col(after) != "")
    side = lambda column, sign: F.when(usable, F.transform(significant_lines(F.col(column)), lambda s: F.struct(s.alias("line"), F.lit(sign).alias("n")))).otherwise(none)
    mark = F.array(F.struct(F.lit("").alias("line"), F.lit(0).alias("n")))
    lines = pairs.select(key, F.explode(F.concat(mark, side(before, 1), side(after, -1))).alias("l")).select(key, "l.line", "l.n")
    net = lines.groupBy(key, "line").agg(F.sum("n").alias("n"))
    return net.groupBy(key).agg(F.sum(F.greatest(F.col("n"), F.lit(0))).cast("long").alias("n_deleted"))


def set_delta(before: Column, after: Column) -> dict[str, Column]:
    """Sorted additions and removals, their counts, and what is shared."""
    added, removed = F.array_sort(F.array_except(after, before)), F.array_sort(F.array_except(before, after))
    return {"added": added, "removed": removed, "n_added": F.size(added), "n_removed": F.size(removed), "n_shared": F.size(F.array_intersect(before, after))}


def set_sizes(before: Column, after: Column) -> Column:
    """n_removed, n_added, n_shared of two arrays of distinct values, by one intersection."""
    sizes = F.transform(F.array(F.struct(before.alias("a"), after.alias("b"))), lambda p: F.struct(F.size(p["a"]).alias("a"), F.size(p["b"]).alias("b"), F.size(F.array_intersect(p["a"], p["b"])).alias("both")))
    counted = F.transform(sizes, lambda n: F.struct((n["a"] - n["both"]).cast("long").alias("n_removed"), (n["b"] - n["both"]).cast("long").alias("n_added"), n["both"].cast("long").alias("n_shared")))
    return F.get(counted, 0)


def all_succeeded(results: DataFrame, *by: str) -> DataFrame:
    """successes, n and all_equal (false where nothing is known to fail but nothing is there) of each group."""
    good = F.coalesce(F.col("success"), F.lit(False))
    return results.groupBy(*by).agg(F.count_if(good).alias("successes"), F.count("*").alias("n"), F.coalesce(F.bool_and(good), F.lit(False)).alias("all_equal"))


#: What may become of a case.
DISPOSITIONS = ("processed", "repaired", "failed", "deferred", "timed_out")


def dispositions(log: DataFrame, *by: str) -> DataFrame:
    """Rows of each disposition (column ``disposition``; processed is all of them), by group."""
    return log.groupBy(*by).agg(F.count("*").alias("processed"), *(F.count_if(F.col("disposition") == d).alias(d) for d in DISPOSITIONS[1:]))


def accepted_steps(steps: Column) -> Column:
    """How many of an array of steps were accepted."""
    return F.coalesce(F.size(F.filter(steps, lambda s: F.coalesce(s["accepted"], F.lit(False)))), F.lit(0))


def line_audit(before: Column, after: Column) -> Column:
    """Significant lines of both sides, and how many distinct ones they share, lose and add."""
    a, b = significant_lines(before), significant_lines(after)
    kept = F.size(F.array_intersect(a, b))
    return F.struct(F.size(a).alias("n_before"), F.size(b).alias("n_after"), kept.alias("n_shared"), F.size(F.array_except(a, b)).alias("n_lost"), F.size(F.array_except(b, a)).alias("n_added"))
