"""Mixing sources to target weights by Pfair scheduling.

Each source's documents are put into a fixed order and cut into blocks; every source is a stream. Block i of a stream with b
of all T blocks has release time floor(i * T / b) and deadline ceil((i + 1) * T / b). Every slot goes to the released block
with the earliest deadline, so that after any number of slots each stream has its share to within less than one block.
The T turns depend on each other, so the driver makes them, one a block, and writes them in parts to be joined to the blocks.
Blocks have ``BLOCK`` rows, or more where the mixture would have over ``MAX_TURNS`` of them: the deviation of any source is then still less
than a ``MAX_TURNS``-th of the mixture, and the driver's work is bounded whatever the input.

Ranks within a source never put one source into one task: rows are counted by (stream, order bucket), the counts are
summed into offsets, and each bucket is numbered by itself.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from heapq import heappop, heappush
from itertools import islice
from math import ceil, floor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import BROADCAST_ROWS, broadcast_if_small, scratch_root, small_table, written

#: Turns that the driver holds at once.
CHUNK_TURNS = 250_000
#: Rows of a block, and turns that the driver makes at most (beyond them blocks grow).
BLOCK, MAX_TURNS = 16, 1 << 22
#: Targets with a cap, for callers that ask for it: natural shares, but no source above this share of the mixture ...
MAX_SHARE = 0.25
#: ... and none loses more than this part of its documents to it.
MAX_LOSS = 0.5
_BUCKET_DIGITS = 3


def order_key(doc_id):
    """Fixed pseudo-random order of documents, the same in any engine that has MD5."""
    return F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def capped_quotas(sizes: list[int], total: int, max_share: float = MAX_SHARE, max_loss: float = MAX_LOSS) -> list[int]:
    """Documents that each of the largest sources (``sizes``, descending, of ``total``) gives to the mixture.

    All of them where no mixture has the cap, as with fewer than 1 / ``max_share`` sources.
    """
    for k in range(len(sizes) + 1):
        if 1 - k * max_share <= 0:
            break
        mixture = (total - sum(sizes[:k])) / (1 - k * max_share)
        if mixture <= 0:
            break
        if k == len(sizes) or sizes[k] <= max_share * mixture:
            return [max(min(n, floor(max_share * mixture)), ceil((1 - max_loss) * n)) if i < k else n for i, n in enumerate(sizes)]
    return list(sizes)


def turns(blocks: list[int]) -> Iterator[tuple[int, int, int, int, int]]:
    """(slot, stream, nth, release, deadline) of every block of every stream, earliest deadline first among the released."""
    total = sum(blocks)
    window = lambda s, i: (i * total // blocks[s], -(-(i + 1) * total // blocks[s]))
    waiting = [(0, s, 0) for s, b in enumerate(blocks) if b > 0]
    ready: list[tuple[int, int, int, int]] = []
    for slot in range(total):
        while waiting and waiting[0][0] <= slot:
            release, s, i = heappop(waiting)
            heappush(ready, (window(s, i)[1], s, i, release))
        deadline, s, i, release = heappop(ready)
        yield slot, s, i, release, deadline
        if i + 1 < blocks[s]:
            heappush(waiting, (window(s, i + 1)[0], s, i + 1))


def schedule(spark, blocks: list[int]) -> DataFrame:
    """The turns as a table of text files in the shared folder, made and written CHUNK_TURNS at a time."""
    fields = "slot bigint, stream bigint, nth bigint, release bigint, deadline bigint"
    folder = f"{scratch_root(spark)}/mix-schedule-{uuid.uuid4().hex}"
    jvm = spark._jvm
    store = jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    store.mkdirs(jvm.org.apache.hadoop.fs.Path(folder))
    made, part = turns(blocks), 0
    while rows := list(islice(made, CHUNK_TURNS)):
        out = store.create(jvm.org.apache.hadoop.fs.Path(f"{folder}/part-{part:05d}.csv"))
        out.write(bytearray("".join(f"{slot},{s},{i},{release},{deadline}\n" for slot, s, i, release, deadline in rows).encode()))
        out.close()
        part += 1
    return spark.read.schema(fields).csv(folder)


def block_rows(total: int, block: int = BLOCK) -> int:
    """Rows of a block of a mixture of ``total`` rows."""
    return max(block, -(-total // MAX_TURNS))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, block: int = BLOCK, max_share: float | None = None) -> DataFrame:
    """One row per row of ``docs`` (columns doc_id, source, text): where it stands in the mixture.

    Returns doc_id, text_hash, source, stream, rank, block, release, deadline, slot, position, selected. ``weights`` are target
    shares by source (others get none); the mixture then ends where the first of them is used up, so it is empty where no weight
    is above zero or a source has no row. Without them the targets are natural shares and every row of every source
    is taken, or, where ``max_share`` is given, natural shares with that cap. A null source is a source of its own, a null id sorts first,
    repeated rows have ranks of their own, and an empty table gives an empty result. Rows beyond their source's quota
    keep a rank but have ``selected`` false and no slot or position.
    """
    spark = docs.sparkSession
    key = order_key(F.col("doc_id"))
    rows = written(
        docs.select("doc_id", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("text_hash"), "source", key.alias("o"), F.substring(key, 1, _BUCKET_DIGITS).alias("bucket")),
        "mix-rows",
    )
    sizes = written(rows.groupBy("source").agg(F.count("*").alias("n")), "mix-sizes")
    total = sizes.agg(F.sum("n")).first()[0] or 0
    if weights is None:
        order = (F.desc("n"), F.col("source"))
        counts = [r["n"] for r in sizes.orderBy(*order).select("n").collect()]
        quotas = counts if max_share is None else capped_quotas(counts, total, max_share)
        named = sizes.select(F.col("source").alias("s"), (F.row_number().over(Window.orderBy(*order)) - 1).cast("long").alias("stream"), F.col("n").alias("quota"))
        if quotas != counts:
            caps = small_table(spark, [{"c": i, "q": q} for i, q in enumerate(quotas)], "c: bigint, q: bigint")
            named = named.join(caps, F.col("stream") == F.col("c")).select("s", "stream", F.col("q").alias("quota"))
    else:
        wanted = {s: w for s, w in sorted(weights.items()) if w > 0}
        counted = {r["source"]: r["n"] for r in sizes.filter(F.col("source").isin(list(wanted))).collect()}
        share = {s: w / sum(wanted.values()) for s, w in wanted.items()}
        length = min((counted.get(s, 0) / share[s] for s in wanted), default=0)
        quotas = [min(counted.get(s, 0), floor(length * share[s] + 1e-9)) for s in wanted]
        named = small_table(spark, [{"s": s, "stream": i, "quota": q} for i, (s, q) in enumerate(zip(wanted, quotas))], "s: string, stream: bigint, quota: bigint")
        named = named.withColumn("s", F.col("s").cast(sizes.schema["source"].dataType))
    block = block_rows(sum(quotas), block)
    named = broadcast_if_small(written(named, "mix-streams"))
    dealt = rows.join(named, F.col("source").eqNullSafe(F.col("s")), "left").select(*rows.columns, F.coalesce("stream", F.lit(-1)).alias("stream"), F.coalesce("quota", F.lit(0)).alias("quota"))
    counts = dealt.groupBy("stream", "bucket").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("stream").orderBy("bucket")) - F.col("n")
    offsets = counts.select(F.col("stream").alias("_s"), F.col("bucket").alias("_b"), before.alias("before"))
    nth = F.row_number().over(Window.partitionBy("stream", "bucket").orderBy("o", "doc_id", "text_hash"))
    ranked = dealt.withColumn("nth", nth).join(offsets, (F.col("stream") == F.col("_s")) & (F.col("bucket") == F.col("_b")))
    ranked = ranked.withColumn("rank", F.col("before") + F.col("nth") - 1).withColumn("block", F.floor(F.col("rank") / block))
    ranked = ranked.withColumn("selected", F.col("rank") < F.col("quota"))
    blocks = [-(-q // block) for q in quotas]
    at = schedule(spark, blocks).select(F.col("stream").alias("_t"), F.col("nth").alias("_n"), "release", "deadline", "slot")
    placed = ranked.join(F.broadcast(at) if sum(blocks) <= BROADCAST_ROWS else at, F.col("selected") & (F.col("stream") == F.col("_t")) & (F.col("block") == F.col("_n")), "left")
    return placed.select(
        "doc_id", "text_hash", "source", "stream", "rank", "block", "release", "deadline", "slot", (F.col("slot") * block + F.col("rank") % block).alias("position"), "selected",
    )


def mixture(docs: DataFrame, weights: dict[str, float] | None = None, max_share: float | None = None) -> DataFrame:
    """The selected rows of ``docs``, all columns kept, range-partitioned and sorted into the mixture's order.

    Rows that repeat both id and text stand together at the first of their positions; where only some of them are
    selected, as many stay (which of them can't be told apart by id, source and text).
    """
    places = mix(docs, weights, max_share=max_share).groupBy(F.col("doc_id").alias("_rk_id"), F.col("source").alias("_rk_source"), F.col("text_hash").alias("_rk_digest"))
    places = places.agg(F.min("position").alias("_rk_position"), F.count_if("selected").alias("_rk_taken"), F.count("*").alias("_rk_rows"))
    places = written(places.filter("_rk_taken > 0"), "mix-places")
    names = docs.columns
    marked = docs.withColumns({"_rk_doc_id": F.col("doc_id"), "_rk_doc_source": F.col("source"), "_rk_doc_digest": F.xxhash64(F.coalesce(F.col("text"), F.lit("")))})

    def found(some: DataFrame) -> DataFrame:
        same = some["_rk_id"].eqNullSafe(marked["_rk_doc_id"]) & some["_rk_source"].eqNullSafe(marked["_rk_doc_source"]) & (some["_rk_digest"] == marked["_rk_doc_digest"])
        return marked.join(some, same)

    kept = found(places.filter("_rk_taken = _rk_rows")).select(*(F.col(f"`{c}`") for c in names), "_rk_position")
    partly = places.filter("_rk_taken < _rk_rows")
    if not partly.isEmpty():
        nth = F.row_number().over(Window.partitionBy("_rk_doc_id", "_rk_doc_source", "_rk_doc_digest").orderBy("_rk_position"))
        some = found(partly).withColumn("_rk_nth", nth).filter("_rk_nth <= _rk_taken")
        kept = kept.unionByName(some.select(*(F.col(f"`{c}`") for c in names), "_rk_position"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return kept.repartitionByRange(parts, "_rk_position").sortWithinPartitions("_rk_position").drop("_rk_position")
