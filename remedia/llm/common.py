"""Helpers shared by the training-data operators: scratch tables, column hygiene, row selection."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Characters that separate words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE_CHARS = " \t\n\x0b\x0c\r"
#: A written table of at most so many narrow rows may be broadcast; a larger one is joined by shuffling.
BROADCAST_ROWS = 250_000
#: Text that one Arrow batch may hold.
BATCH_BYTES = 4 << 20


def scratch_root(spark: SparkSession) -> str:
    """Folder for written tables: ``spark.checkpoint.dir``, which driver and executors share.

    Where the setting is missing, a local temporary folder is used if Spark itself is local (as in tests);
    a cluster without the setting is an error, since executors could not see each other's files.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return "file://" + os.path.join(tempfile.gettempdir(), "remedia-scratch")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut, and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Let Arrow batches hold BATCH_BYTES at most, unless the session asks for less: long texts then need little memory.

    Spark reads the setting when a plan runs, so it stays for the session; it changes no result.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(str(spark.conf.get(name)).removesuffix("b")) <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def broadcast_if_small(table: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """A written table, marked for broadcast if its row count (from Parquet footers) is within the bound."""
    return F.broadcast(table) if table.count() <= most else table


def drop_written(df: DataFrame) -> None:
    """Delete the files behind a table made by :func:`written` that nothing will read again."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def squeezed(text: Column) -> Column:
    """The text without any of the six separator characters (null: empty)."""
    out = F.coalesce(text, F.lit(""))
    for c in SPACE_CHARS:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def rows_kept(docs: DataFrame, decided: DataFrame, digest: Column, best: list[Column] | None = None) -> DataFrame:
    """Rows of ``docs`` that ``decided`` keeps, with all columns of ``docs``; nulls match nulls.

    ``decided`` has each (``_rk_id``, ``_rk_digest``) of ``docs`` once, with ``_rk_any`` (some row of it stays) and ``_rk_rows``
    (its rows in ``docs``); ``digest`` is computed on ``docs``. Few rows are dropped as a rule, so they are what is joined.
    A kept pair that stands for several rows yields one, the first by ``best``.
    """
    decided = written(decided.filter("NOT _rk_any OR _rk_rows > 1"), "rows-decided")
    names = docs.columns
    marked = docs.withColumns({"_rk_doc_id": F.col("doc_id"), "_rk_doc_digest": digest})
    same = lambda k: k["_rk_id"].eqNullSafe(marked["_rk_doc_id"]) & (k["_rk_digest"] == marked["_rk_doc_digest"])
    dropped = broadcast_if_small(decided)
    out = marked.join(dropped, same(dropped), "left_anti").drop("_rk_doc_id", "_rk_doc_digest")
    more = decided.filter("_rk_any")
    if not more.isEmpty():
        first = F.row_number().over(Window.partitionBy("_rk_doc_id", "_rk_doc_digest").orderBy(*(best or [F.lit(0)])))
        again = marked.join(more, same(more), "left_semi").withColumn("_rk_first", first).filter("_rk_first = 1")
        out = out.unionByName(again.select(*(F.col(f"`{c}`") for c in names)))
    return out


def small_table(spark: SparkSession, rows: list[dict], fields: str) -> DataFrame:
    """A table of plan-time rows (bounded by the caller) as one JSON literal, read by Spark's own parser."""
    import json

    one = spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{fields}>>")).alias("r"))
    return one.select("r.*")
