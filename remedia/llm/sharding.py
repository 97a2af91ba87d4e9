"""Size-balanced shards by sampled splitters.

Records are ordered by a hash of their text, so equal texts are neighbours. A size-weighted sample of keys gives
quantile boundaries that cut the key space into many small ranges; exact range totals then cut the ranges into
shards of near equal bytes. Ranges that came out overfull are searched for the groups of equal texts that fill them:
those groups leave the ranges, are placed first (largest first, whole where a shard has room, else subdivided into
pieces by doc_id), and the light ranges fill what room is left, in key order. Only the few ranges that hold a shard
boundary are scanned in order to find the record where it falls.

What reaches the driver is bounded by the plan, not the data: sampled keys (about DRAWS_PER_RANGE a range), one total
a range, heavy groups (each above a fixed share of all bytes or rows, so their number is bounded) and their pieces.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import small_table, written

MIN_RANGES, MAX_RANGES, RANGE_BYTES = 1024, 4096, 256 << 20
DRAWS_PER_RANGE = 16
#: A range, or a group of equal texts, is overfull beyond so many times the mean range.
OVERFULL = 2
#: Part of a shard that a group of equal texts may exceed a shard's room by rather than be subdivided.
SLACK = 0.02
_FAN = 64


def _splitters(table: DataFrame, n_bytes: int, n_rows: int, ranges: int) -> list[int]:
    """Quantile boundaries of a sample in which a record's chance follows its share of bytes and of rows."""
    share = F.col("size") / F.lit(float(n_bytes)) + F.lit(1.0 / n_rows)
    draws = F.floor(share * F.lit(DRAWS_PER_RANGE * ranges / 2.0) + F.rand(17))
    sample = table.select("h", draws.alias("draws")).filter("draws > 0").groupBy("h").agg(F.sum("draws").alias("draws"))
    keys = sorted((r.h, r.draws) for r in sample.collect())
    upto, total = list(accumulate(d for _, d in keys)), sum(d for _, d in keys)
    cuts = {keys[bisect_left(upto, total * k / ranges)][0] for k in range(1, ranges)} if keys else set()
    return sorted(cuts)


def _range_of(splitters: list[int]):
    """Index of a key's range (boundaries belong to the range below), by a two-level search."""
    groups = [splitters[i : i + _FAN] for i in range(0, len(splitters), _FAN)]
    if not groups:
        return F.lit(0)
    below = lambda keys: F.size(F.filter(keys, lambda x: x < F.col("h")))
    coarse = below(F.array(*(F.lit(g[-1]) for g in groups)))
    fine = F.array(*(F.array(*map(F.lit, g)) for g in groups))
    return F.when(coarse == len(groups), F.lit(len(splitters))).otherwise(coarse * _FAN + below(F.get(fine, coarse)))


def _place(heavy: list, pieces: dict[int, list], room: list[float]) -> dict[int, int]:
    """Shard of each piece of each heavy group; takes what it places from ``room``."""
    at: dict[int, int] = {}
    slack = SLACK * sum(room) / len(room)
    for g in sorted(heavy, key=lambda g: (-g.bytes, g.h)):
        best = max(range(len(room)), key=lambda s: room[s])
        whole = g.bytes <= room[best] + slack
        for p in sorted(pieces[g.h], key=lambda p: (-p.bytes, p.unit)):
            s = best if whole else max(range(len(room)), key=lambda s: room[s])
            at[p.unit] = s
            room[s] -= p.bytes
    return at


def assign(docs: DataFrame, shards: int = 8) -> DataFrame:
    """One row per row of ``docs`` (columns doc_id, text): doc_id, size, text_crc32, shard, slot.

    Size is UTF-8 bytes plus 1 (null text: 1). Shards differ from their mean by SLACK at most unless single texts
    are larger than that; equal texts share a shard unless they don't fit one. Slots number each
    shard's rows from 0 without gaps in key order. Null ids are rows like any other; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    table = written(
        docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("h")),
        "shard-keys",
    )
    n_bytes, n_rows = table.agg(F.sum("size"), F.count("*")).first()
    if not n_rows:
        return table.select("doc_id", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    ranges = max(MIN_RANGES, min(MAX_RANGES, -(-n_bytes // RANGE_BYTES)))
    splitters = _splitters(table, n_bytes, n_rows, ranges)
    ranged = table.withColumn("unit", _range_of(splitters).cast("long"))
    most_bytes, most_rows = OVERFULL * n_bytes / ranges, OVERFULL * n_rows / ranges
    over = (F.col("bytes") > most_bytes) | (F.col("n") > most_rows)
    total = [F.sum("size").alias("bytes"), F.count("*").alias("n")]
    totals = {r.unit: r for r in ranged.groupBy("unit").agg(*total).collect()}
    overfull = [u for u, r in totals.items() if r.bytes > most_bytes or r.n > most_rows]
    heavy = ranged.filter(F.col("unit").isin(overfull)).groupBy("unit", "h").agg(*total).filter(over).collect() if overfull else []

    pieces: dict[int, list] = {}
    units = ranged
    if heavy:
        base, split = len(splitters) + 1, []
        for g in sorted(heavy, key=lambda g: g.h):
            parts = max(1, round(max(g.bytes / most_bytes, g.n / most_rows)) * OVERFULL)
            split.append({"hh": g.h, "base": base, "parts": parts})
            base += parts
        groups = F.broadcast(small_table(spark, split, "hh: bigint, base: bigint, parts: bigint"))
        own = F.col("base") + F.pmod(F.xxhash64("doc_id", F.lit(29)), F.col("parts"))
        units = ranged.join(groups, ranged["h"] == groups["hh"], "left").select(*table.columns, F.coalesce(own, F.col("unit")).alias("unit"), F.col("hh").isNotNull().alias("big"))
        for p in units.filter("big").groupBy("h", "unit").agg(*total).collect():
            pieces.setdefault(p.h, []).append(p)
        units = units.drop("big")
    room = [n_bytes / shards] * shards
    at = _place(heavy, pieces, room)
    left = {u: r.bytes for u, r in totals.items()}
    for g in heavy:
        left[g.unit] -= g.bytes
    light = sum(left.values())
    room = [max(0.0, x) for x in room]
    bounds = [x * light / (sum(room) or 1) for x in accumulate(room)][:-1]

    plan, upto = [{"u": u, "to": s, "low": 0} for u, s in at.items()], 0
    for u in sorted(left):
        first, last = bisect_right(bounds, upto), bisect_left(bounds, upto + left[u])
        plan.append({"u": u, "to": first if first >= last else None, "low": upto})
        upto += left[u]
    planned = F.broadcast(small_table(spark, plan, "u: bigint, to: int, low: bigint"))
    found = units.join(planned, units["unit"] == planned["u"])
    cut = found.filter("to IS NULL").withColumn("upto", F.col("low") + F.sum("size").over(Window.partitionBy("unit").orderBy("h")))
    where = F.size(F.filter(F.array(*map(F.lit, bounds)) if bounds else F.array(F.lit(float(n_bytes))), lambda b: b < F.col("upto")))
    columns = [*table.columns, "unit"]
    placed = written(
        found.filter("to IS NOT NULL").select(*columns, F.col("to").alias("shard")).unionByName(cut.select(*columns, where.cast("int").alias("shard"))),
        "shard-placed",
    )
    counts: dict[int, int] = {}
    offsets = []
    for r in sorted(placed.groupBy("shard", "unit").count().collect(), key=lambda r: (r["shard"], r["unit"])):
        offsets.append({"s": r["shard"], "u": r["unit"], "before": counts.get(r["shard"], 0)})
        counts[r["shard"]] = counts.get(r["shard"], 0) + r["count"]
    offset = F.broadcast(small_table(spark, offsets, "s: int, u: bigint, before: bigint"))
    nth = F.row_number().over(Window.partitionBy("shard", "unit").orderBy("h", "doc_id", "size"))
    numbered = placed.withColumn("nth", nth).join(offset, (F.col("shard") == F.col("s")) & (F.col("unit") == F.col("u")))
    return numbered.select("doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("nth") - 1).cast("long").alias("slot"))
