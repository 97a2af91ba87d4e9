"""Exact dedup by a heavy-hitter split.

Digests are computed once and written as a narrow table. A mergeable Misra-Gries summary of their hashes (Spark's
frequent-items sketch, one per task, merged in two levels) names at most ``MAX_CANDIDATES`` that may be frequent. Their exact
counts are verified with partial aggregation, their winners (one row each, so at most ``MAX_CANDIDATES`` rows) are
broadcast, and all their copies are decided on the map side without moving. Every other digest is bounded to a small
share of the rows by the summary's guarantee and takes an ordinary shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import rows_kept, squeezed, written

#: Digests that the summary may name, hence rows that may be broadcast.
MAX_CANDIDATES = 512
#: Counters that each Misra-Gries summary holds; a digest with more than rows / (0.75 * counters) copies is found.
COUNTERS = 16384
#: Tasks that merge the summaries of all tasks, before one merges theirs.
MERGERS = 64
#: A candidate is heavy if it has at least this many rows and this share of all rows.
HEAVY_ROWS, HEAVY_SHARE = 64, 1 / 4096


def digest(text):
    """SHA-256, as 32 bytes, of the text without separator characters (null counts as empty)."""
    return F.unhex(F.sha2(squeezed(text), 256))


def _order():
    """Best first: most code points, then smallest doc_id (null last), then first row read."""
    return F.struct(-F.col("n"), F.col("doc_id").isNull(), F.col("doc_id"), F.col("uid"))


def digest_table(docs: DataFrame) -> DataFrame:
    """One written row per document: doc_id, n (code points), digest, uid (unique per row)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return written(
        docs.select("doc_id", F.length(text).alias("n"), digest(F.col("text")).alias("digest"), F.monotonically_increasing_id().alias("uid")),
        "exact-digests",
    )


def heavy_winners(table: DataFrame) -> DataFrame:
    """Verified frequent digests with their winner: digest, best (the order struct), group_size; at most MAX_CANDIDATES rows."""
    item = F.xxhash64("digest")  # 8 bytes a counter instead of 32; the count by whole digests below decides
    level = table.select(item.alias("item"), F.pmod(F.spark_partition_id(), F.lit(MERGERS)).alias("merger"))
    level = level.groupBy("merger").agg(F.expr(f"approx_top_k_accumulate(item, {COUNTERS})").alias("summary"), F.count("*").alias("n"))
    # Grouped by a constant: without rows there is no summary to merge.
    named = level.groupBy(F.lit(0).alias("all")).agg(F.expr(f"approx_top_k_estimate(approx_top_k_combine(summary, {COUNTERS}), {MAX_CANDIDATES})").alias("top"), F.sum("n").alias("total"))
    named = named.select(F.explode("top").alias("t"), "total").filter(F.col("t.count") >= F.greatest(F.lit(HEAVY_ROWS), F.col("total") * F.lit(HEAVY_SHARE)))
    named = named.select(F.col("t.item").alias("item"), "total")
    return (
        table.join(F.broadcast(named), item == F.col("item"))
        .groupBy("digest")
        .agg(F.min(_order()).alias("best"), F.count("*").alias("group_size"), F.max("total").alias("total"))
        .filter(F.col("group_size") >= F.greatest(F.lit(HEAVY_ROWS), F.col("total") * F.lit(HEAVY_SHARE)))
        .select("digest", "best", "group_size")
    )


def decide(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (columns doc_id, text; others are ignored).

    Returns doc_id, digest (32 bytes), uid, keep_id, keep_uid, group_size, kept. Null texts are empty texts and form one group
    with them; a null doc_id loses ties against any other; of rows repeated in full exactly one is kept. An
    empty table gives an empty result.
    """
    table = digest_table(docs)
    winners = written(heavy_winners(table), "exact-winners")
    heavy = table.join(F.broadcast(winners), "digest").select("doc_id", "digest", "uid", "best", "group_size")
    same = Window.partitionBy("digest")
    rest = table.join(F.broadcast(winners.select("digest")), "digest", "left_anti")
    rest = rest.select("doc_id", "digest", "uid", F.min(_order()).over(same).alias("best"), F.count("*").over(same).alias("group_size"))
    return heavy.unionByName(rest).select(
        "doc_id", "digest", "uid", F.col("best.doc_id").alias("keep_id"), F.col("best.uid").alias("keep_uid"), "group_size", (F.col("uid") == F.col("best.uid")).alias("kept")
    )


def deduplicate(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of equal texts, all columns kept."""
    kept = decide(docs).select("doc_id", "digest", "kept")
    pairs = kept.groupBy(F.col("doc_id").alias("_rk_id"), F.col("digest").alias("_rk_digest")).agg(F.max("kept").alias("_rk_any"), F.count("*").alias("_rk_rows"))
    return rows_kept(docs, pairs, digest(F.col("text")), [F.length("text").desc_nulls_last(), F.col("text")])
