"""Choosing repair cases: filters, row ranges, re-runs, deferral and order."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def with_error_type(cases: DataFrame, error_type: str) -> DataFrame:
    """Rows of an error type; all rows if the table has no such column."""
    return cases.filter(F.col("error_type") == error_type) if "error_type" in cases.columns else cases


def from_source(cases: DataFrame, source: str) -> DataFrame:
    return cases.filter(F.lower(F.col("source").cast("string")) == source.lower())


def with_hash(cases: DataFrame, file_hash: str) -> DataFrame:
    return cases.filter(F.col("file_hash").cast("string") == file_hash)


def with_keys(cases: DataFrame, *keys: str) -> DataFrame:
    """Rows whose keys are neither null nor blank, with the keys stripped."""
    for k in keys:
        cases = cases.withColumn(k, F.regexp_replace(F.col(k).cast("string"), r"^\s+|\s+$", "")).filter(F.col(k) != "")
    return cases


def parse_row_range(text: str) -> tuple[int, int | None]:
    """``START:END``, ``START:``, ``:END`` or a single row ``N`` as (start, end); end None is open. Rows count from 0."""
    found = re.fullmatch(r"\s*(\d*)\s*(:?)\s*(\d*)\s*", text)
    if not found or not (found[1] or found[2]):
        raise ValueError(f"not a row range: {text!r}")
    start = int(found[1] or 0)
    end = (int(found[3]) if found[3] else None) if found[2] else start + 1
    if end is not None and end < start:
        raise ValueError(f"row range ends before it starts: {text!r}")
    return start, end


def row_range(cases: DataFrame, text: str, *order: str) -> DataFrame:
    """Rows of a range in a declared order; a limit and an offset, so only as many rows as the range ends at are kept."""
    start, end = parse_row_range(text)
    out = cases.orderBy(*order)
    return (out if end is None else out.limit(end)).offset(start) if start else (out if end is None else out.limit(end))


def succeeded(log: DataFrame) -> DataFrame:
    """file_hash, succeeded for each file of a run log; a file whose successes are all unknown has not succeeded."""
    return log.groupBy("file_hash").agg(F.coalesce(F.bool_or("compiled_success"), F.lit(False)).alias("succeeded"))


def retry_failed(cases: DataFrame, log: DataFrame) -> DataFrame:
    return cases.join(succeeded(log).filter("NOT succeeded"), "file_hash", "left_semi")


def skip_done(cases: DataFrame, log: DataFrame) -> DataFrame:
    """Cases that no earlier run has a record of; cases without a hash stay."""
    return cases.join(log.select("file_hash").filter("file_hash IS NOT NULL").distinct(), "file_hash", "left_anti")


def first_shuffled(cases: DataFrame, n: int, *order: str, seed: int = 42) -> DataFrame:
    """The first n rows in a declared order, in a reproducible random order."""
    return cases.orderBy(*order).limit(n).orderBy(F.xxhash64("file_hash", F.lit(seed)), *order)


def defer_reasons(distance: Column, targets: Column, missing: Column, extra: Column, max_distance: int | None = 200, max_targets: int | None = 2, allow_missing: bool = False, allow_extra: bool = False) -> Column:
    """Why a preflight defers a case, in fixed order, or NULL."""
    why = []
    if max_distance is not None:
        why.append(F.when(distance > max_distance, F.concat(F.lit("initial_combined_distance "), distance.cast("string"), F.lit(f" exceeds {max_distance}"))))
    if max_targets is not None:
        why.append(F.when(targets > max_targets, F.concat(F.lit("repair_target_count "), targets.cast("string"), F.lit(f" exceeds {max_targets}"))))
    for name, count, allowed in (("missing", missing, allow_missing), ("extra", extra, allow_extra)):
        if not allowed:
            why.append(F.when(count != 0, F.concat(F.lit(f"{name}_target_count "), count.cast("string"), F.lit(" is nonzero"))))
    text = F.concat_ws("; ", *why) if why else F.lit("")
    return F.when(text != "", text)


def easy_first(distance: Column, targets: Column, missing: Column, extra: Column, parents: Column, present: Column) -> Column:
    """struct that sorts easy cases first; rows without a preflight come last."""
    topology = F.when((F.coalesce(missing, F.lit(0)) != 0) | (F.coalesce(extra, F.lit(0)) != 0), 1).otherwise(0)
    return F.struct(
        F.when(present, topology).otherwise(1).alias("topology"),
        F.when(present, F.coalesce(targets, F.lit(1_000_000))).otherwise(1_000_000).alias("targets"),
        F.when(present, F.coalesce(distance, F.lit(1_000_000_000))).otherwise(1_000_000_000).alias("distance"),
        F.when(present, F.coalesce(parents, F.lit(1_000_000))).otherwise(1_000_000).alias("parents"),
    )


def ranked(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` (no other columns than ``order``, which tells all rows apart) with their rank ``n`` from 1, without bringing them to one task.

    Rows are numbered within ranges of ``order``; only one row a range is summed in one place. The number of ranges is
    given, so that both uses of the ranges read the same ones.
    """
    ranges = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = rows.select(*order).repartitionByRange(ranges, *order).withColumn("_part", F.spark_partition_id())
    parts = spread.groupBy("_part").agg(F.count("*").alias("_size"))
    parts = parts.withColumn("_before", F.sum("_size").over(Window.orderBy("_part")) - F.col("_size")).select("_part", "_before")
    spread = spread.withColumn("_nth", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    return spread.join(F.broadcast(parts), "_part").select(*order, (F.col("_before") + F.col("_nth")).alias("n"))


def size_guard(texts: DataFrame, column: str, most: int) -> DataFrame:
    """All rows, with ``skipped`` true where the text has more bytes than allowed: rejects are rows, not losses."""
    return texts.withColumn("skipped", F.coalesce(F.octet_length(column) > most, F.lit(False)))


def keep_last(rows: DataFrame, keys: list[str], *order: str, n: int = 1) -> DataFrame:
    """The last ``n`` rows of each key by ``order`` (later duplicates win)."""
    w = Window.partitionBy(*keys).orderBy(*(F.desc(o) for o in order))
    return rows.withColumn("_nth", F.row_number().over(w)).filter(F.col("_nth") <= n).drop("_nth")


def keep_sets(cases: DataFrame, source: str = "source", file_hash: str = "file_hash") -> DataFrame:
    """The distinct non-blank hashes of each source, a row each, so that no source's set has to fit one task."""
    rows = cases.select(F.lower(F.trim(F.col(source).cast("string"))).alias("source"), F.trim(F.col(file_hash).cast("string")).alias("file_hash"))
    return rows.filter("source <> '' AND file_hash <> ''").distinct()


def with_rejects(cases: DataFrame, *required: str) -> DataFrame:
    """All rows, with ``reject_reason`` naming the required columns that are null or blank (NULL for none): what can't be processed is reported, not lost."""
    missing = [F.when(F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == "", c) for c in required]
    said = F.concat_ws(", ", *missing)
    return cases.withColumn("reject_reason", F.when(said != "", F.concat(F.lit("missing "), said)))


def has_module_target(targets: Column) -> Column:
    """Whether the module's own body is among the repair targets."""
    return F.coalesce(F.array_contains(targets, "<module>"), F.lit(False))


def union_targets(*lists: Column) -> Column:
    """All targets of several lists once, sorted; a null list has none."""
    out = F.array().cast("array<string>")
    for targets in lists:
        out = F.array_union(out, F.coalesce(targets, F.array().cast("array<string>")))
    return F.array_sort(out)


def failing_names(results: DataFrame, *order: str) -> DataFrame:
    """file and the distinct names of its results without success, in order of first appearance."""
    place = F.struct(*order)
    failing = results.filter(~F.coalesce(F.col("success"), F.lit(False)) & (F.coalesce(F.col("names"), F.lit("")) != ""))
    first = failing.groupBy("file", "names").agg(F.min(place).alias("at"))
    return first.groupBy("file").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "names"))), lambda x: x["names"]).alias("failing"))


def first_seen(candidates: Column) -> Column:
    """Of an array of structs (text_hash, shape_hash, ...) those whose text and shape were both not kept before; a null hash is never seen.

    One fold in order: a candidate that is dropped leaves no trace, so what only it resembles stays.
    """
    kept = F.filter(candidates, lambda c: F.lit(False))
    none = F.array().cast("array<string>")
    known = lambda seen, h: F.coalesce(F.array_contains(seen, h), F.lit(False))
    grown = lambda seen, h: F.when(h.isNull(), seen).otherwise(F.array_append(seen, h))

    def step(acc: Column, c: Column) -> Column:
        repeated = known(acc["texts"], c["text_hash"]) | known(acc["shapes"], c["shape_hash"])
        return F.when(repeated, acc).otherwise(
            F.struct(F.array_append(acc["kept"], c).alias("kept"), grown(acc["texts"], c["text_hash"]).alias("texts"), grown(acc["shapes"], c["shape_hash"]).alias("shapes"))
        )

    return F.aggregate(candidates, F.struct(kept.alias("kept"), none.alias("texts"), none.alias("shapes")), step, lambda acc: acc["kept"])


def prune_list(present: DataFrame, keep: DataFrame) -> DataFrame:
    """(root, hash) directories that no kept row names; deletion itself is left to the caller."""
    return present.select("root", "file_hash").join(keep.select("root", "file_hash").distinct(), ["root", "file_hash"], "left_anti")
