"""Typed readers. Paths go to Spark as they are, so any store that Spark reads will do."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas

CORRUPT = "_corrupt_record"


def read_csv(spark: SparkSession, path: str, schema: T.StructType = schemas.DATASET) -> DataFrame:
    """A CSV with a header. Columns are matched by name: those of the schema are typed, those it lacks are text, absent ones NULL."""
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"')
    have = {c.lower(): c for c in raw.columns}
    typed = [(F.col(f"`{have[f.name.lower()]}`") if f.name.lower() in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema]
    extra = [F.col(f"`{c}`") for c in raw.columns if c.lower() not in {f.name.lower() for f in schema}]
    return raw.select(*typed, *extra)


def read_input_rows(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a dataset CSV that a corpus is generated from: syntactic errors with a hash and a supported version; rows that don't parse are skipped."""
    from ..functions.scalars import version

    with_corrupt = T.StructType([*schemas.schema("file string, file_hash string, bytecode_version string, error_type string, error string"), T.StructField(CORRUPT, T.StringType())])
    header = [c.strip() for c in (spark.read.text(path).first() or [""])[0].split(",")]
    by_name = {f.name: f for f in with_corrupt}
    fields = [by_name.get(c, T.StructField(c, T.StringType())) for c in header]
    rows = spark.read.schema(T.StructType([*fields, with_corrupt[CORRUPT]])).csv(path, header=True, mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT)
    rows = rows.filter((F.col("error_type") == "syntactic_error") & (F.trim("file_hash") != "") & F.col(CORRUPT).isNull())
    return rows.withColumn("version", version(F.col("bytecode_version"))).filter("version IS NOT NULL").drop(CORRUPT)


def read_jsonl_strict(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """JSON lines; a line that isn't JSON is an error, blank lines and values that aren't objects are left out."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    parsed = lines.select("value", F.try_parse_json("value").alias("v"))
    checked = parsed.select(F.when(F.col("v").isNull() & (F.trim("value") != "null"), F.raise_error(F.concat(F.lit(f"{path}: not JSON: "), F.left("value", F.lit(120))))).otherwise(F.col("value")).alias("value"))
    objects = checked.filter(F.startswith(F.ltrim("value"), F.lit("{")))
    return _typed(spark, objects, schema)


def read_jsonl_lenient(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines of a log that may be missing or damaged: a missing file is empty, bad lines and non-objects are left out."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    lines = spark.read.text(path).filter(F.startswith(F.ltrim("value"), F.lit("{")) & F.try_parse_json("value").isNotNull())
    return _typed(spark, lines, schema)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines as they are; anything wrong is an error."""
    return spark.read.schema(schema).json(path, mode="FAILFAST")


def _typed(spark: SparkSession, lines: DataFrame, schema: T.StructType | None) -> DataFrame:
    if schema is None:
        return lines.select(F.parse_json("value").alias("record"))
    return lines.select(F.from_json("value", schema).alias("r")).select("r.*")


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def first_existing(spark: SparkSession, paths: Iterable[str]) -> str:
    """The first of several paths that is there."""
    paths = list(paths)
    for p in paths:
        if exists(spark, p):
            return p
    raise FileNotFoundError(", ".join(paths))


#: Folders that Spark's own listing passes over as hidden, and how deep below the root they are looked for.
HIDDEN, HIDDEN_DEPTH = "__pycache__", 6


def list_files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """root, file_hash (first folder below the root), path, name, modified, size of all files; contents are not read.

    Files of compiled-code folders are listed too, down to ``HIDDEN_DEPTH`` folders below the root.
    """
    base = spark._jvm.org.apache.hadoop.fs.Path(root)
    store = base.getFileSystem(spark._jsc.hadoopConfiguration())
    globs = [f"{root.rstrip('/')}/{'*/' * depth}{HIDDEN}" for depth in range(HIDDEN_DEPTH)]
    hidden = [g for g in globs if store.globStatus(spark._jvm.org.apache.hadoop.fs.Path(g))]
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load([root, *hidden])
    plain = base.toUri().getPath().rstrip("/")
    # Spark spells a path as the store does (file:/x, hdfs://host/x): scheme and host are read over.
    below = F.regexp_extract("path", r"^(?:[A-Za-z][\w+.-]*:)?(?://[^/]*)?\Q" + plain + r"\E/([^/]+)/", 1)
    return files.select(F.lit(root).alias("root"), below.alias("file_hash"), "path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("modificationTime").alias("modified"), F.col("length").alias("size"))


def highest_indented(files: DataFrame) -> DataFrame:
    """For each hash the decompiler output with the highest number in its name."""
    n = F.regexp_extract("name", r"indented_(\d+)", 1)
    numbered = files.withColumn("n", F.when(n != "", n).cast("bigint")).filter("n IS NOT NULL")
    return numbered.groupBy("file_hash").agg(F.max_by("path", F.struct("n", "path")).alias("path"))


def newest(files: DataFrame) -> DataFrame:
    """For each hash the file written last."""
    return files.groupBy("file_hash").agg(F.max_by("path", F.struct("modified", "path")).alias("path"))


def gt_hash(file_hash):
    """The hash that ground-truth files are kept under: without a numeric suffix."""
    return F.regexp_replace(file_hash, r"_\d+$", "")


def resolve_pairs(cases: DataFrame, files: DataFrame) -> DataFrame:
    """Cases with gt_pyc and derived_pyc by their source's layout, and status unresolved_pyc where either is missing."""
    in_cache = F.contains("path", F.lit("/__pycache__/"))
    decompiled = F.contains("path", F.lit("decompiled_output_pylingual/"))
    pypi = files.groupBy("file_hash").agg(
        F.min(F.when(in_cache & ~decompiled & F.col("name").rlike(r"\.cpython-310\.pyc$"), F.col("path"))).alias("pypi_gt"),
        F.min(F.when(in_cache & decompiled & F.startswith("name", F.lit("decompiled_")), F.col("path"))).alias("pypi_derived"),
        F.min(F.when(F.col("path").rlike(r"/[^/]+\.pyc$") & ~in_cache & ~F.contains("path", F.lit("/decompiler_output/")), F.col("path"))).alias("gt"),
    )
    outputs = highest_indented(files.filter(F.col("name").rlike(r"\.pyc$") & F.contains("path", F.lit("/decompiler_output/")))).withColumnRenamed("path", "derived")
    found = cases.join(pypi, "file_hash", "left").join(outputs, "file_hash", "left")
    is_pypi = F.lower("source") == "pypi"
    found = found.withColumn("gt_pyc", F.when(is_pypi, F.col("pypi_gt")).otherwise(F.col("gt"))).withColumn("derived_pyc", F.when(is_pypi, F.col("pypi_derived")).otherwise(F.col("derived")))
    status = F.when(F.col("gt_pyc").isNull() | F.col("derived_pyc").isNull(), "unresolved_pyc")
    return found.drop("pypi_gt", "pypi_derived", "gt", "derived").withColumn("status", status)
