"""Writers with fixed columns, splits by disposition, and resuming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .readers import exists


def flattened(rows: DataFrame) -> DataFrame:
    """Columns fit for text output: lists joined by a comma and a blank, maps and structs as JSON."""
    out = []
    for f in rows.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.ArrayType):
            c = F.array_join(F.transform(c, lambda x: x.cast("string")), ", ") if not isinstance(f.dataType.elementType, (T.StructType, T.MapType, T.ArrayType)) else F.to_json(c)
        elif isinstance(f.dataType, (T.StructType, T.MapType)):
            c = F.to_json(c)
        out.append(c.alias(f.name))
    return rows.select(*out)


def fixed_decimals(rows: DataFrame, places: int = 6) -> DataFrame:
    """Doubles as text with a fixed number of places, for CSV output only."""
    return rows.select(*(F.format_string(f"%.{places}f", f.name).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f"`{f.name}`") for f in rows.schema))


def write_csv(rows: DataFrame, path: str, columns: list[str], mode: str = "overwrite") -> None:
    """Exactly these columns in this order; missing ones are NULL."""
    have = set(rows.columns)
    flattened(rows.select(*(F.col(f"`{c}`") if c in have else F.lit(None).cast("string").alias(c) for c in columns))).write.mode(mode).csv(path, header=True)


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def write_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def write_split(rows: DataFrame, results: str, deferred: str, columns: list[str], deferred_columns: list[str]) -> None:
    """Rows with a defer_reason go to the deferred file, the others to the results; each row goes to one of them."""
    write_csv(rows.filter("defer_reason IS NULL"), results, columns)
    write_csv(rows.filter("defer_reason IS NOT NULL"), deferred, deferred_columns)


def not_done(rows: DataFrame, done_path: str, *keys: str) -> DataFrame:
    """Rows that an interrupted run has not written to ``done_path`` (Parquet) yet."""
    spark = rows.sparkSession
    if not exists(spark, done_path):
        return rows
    return rows.join(spark.read.parquet(done_path).select(*keys).distinct(), list(keys), "left_anti")


def resumed(rows: DataFrame, results_path: str, *keys: str) -> tuple[DataFrame, DataFrame | None]:
    """(rows still to do, finished results) of an interrupted run: a result counts if it has a final_summary."""
    spark = rows.sparkSession
    if not exists(spark, results_path):
        return rows, None
    finished = spark.read.json(results_path)
    if "final_summary" not in finished.columns:
        return rows, None
    finished = finished.filter("final_summary IS NOT NULL")
    return rows.join(finished.select(*keys).distinct(), list(keys), "left_anti"), finished


#: Columns of the mapping table, in order.
MAPPING_COLUMNS = (
    "row_type", "source_qualname", "source_kind", "source_lineno", "source_end_lineno", "source_col_offset", "source_end_col_offset", "source_occurrence_index", "source_sibling_ordinal", "source_ordinal_path",
    "source_immediate_child_count", "source_collision_size", "source_context", "pyc_qualname", "pyc_firstlineno", "pyc_occurrence_index", "pyc_sibling_ordinal", "pyc_ordinal_path", "pyc_immediate_child_count",
    "pyc_collision_size", "match_reason", "matched",
)


def write_mapping(rows: DataFrame, path: str) -> None:
    """The source mapping as CSV with its fixed columns; ordinal paths are joined by dots."""
    dotted = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ".").alias(c)
    plain = rows.select(*(dotted(f.name) if isinstance(f.dataType, T.ArrayType) else F.col(f"`{f.name}`") for f in rows.schema))
    write_csv(plain, path, list(MAPPING_COLUMNS))


def write_workbook(patterns: DataFrame, path: str) -> None:
    """The three tables of a mining report: rows, summary by action, lowest deltas (one folder each)."""
    from ..operators import mining

    flattened(patterns).write.mode("overwrite").csv(f"{path}/rows", header=True)
    mining.action_summary(patterns).write.mode("overwrite").csv(f"{path}/summary", header=True)
    flattened(mining.lowest_deltas(patterns)).write.mode("overwrite").csv(f"{path}/best", header=True)


def write_action_counts(patterns: DataFrame, path: str) -> None:
    from ..operators import mining

    mining.action_counts(patterns).select("action_type", F.col("n_cases").alias("count")).write.mode("overwrite").csv(path, header=True)
