"""SimHash near-dedup by covering locality-sensitive hashing.

Fingerprints are made from word shingles in Arrow batches and collapsed to their distinct values, so copies cost
nothing from there on. Each bit position gets a non-zero vector of radius + 1 bits; table v (every non-zero v) keeps
the bits whose vector has odd inner product with v. Any radius or fewer differing positions give that many linear
equations in radius + 1 unknowns, so some table drops all of them: every pair within the radius meets there.

A bucket of up to ``BUCKET`` distinct fingerprints is searched in one task, which emits a spanning forest of its links
and never all pairs. Larger buckets are split by a second covering family, whose tables keep other bits: a pair that differs
in bits that the first table dropped meets in one of the second's too. Members of buckets that are still
too large take an exact way that no bucket size can hurt: each emits the values one
bit away, and those of even parity the values two bits away; groups around one value are bounded by combinatorics
(at most 65 near and 2016 far members), and every pair within three bits meets around one.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow_text import lean, slices
from .common import rows_kept, small_batches, written
from .components import connected_components

BITS = 64
SHINGLE_WORDS = 3
RADIUS = 3
SEED = 42
#: Largest bucket that one task searches; beyond it the exact way around single values is taken.
BUCKET = 4096
#: Run length of vectors in the second covering family.
SECOND_STEP = 5
#: Text bytes that a worker holds as Python objects at once.
SLICE_BYTES = 4 << 20


def fingerprint(text: bytes, words: int = SHINGLE_WORDS) -> int:
    """SimHash of UTF-8 bytes, unsigned: A-Z lower-cased, words between ASCII white space, shingles with repeats."""
    found = text.lower().split()
    if not found:
        return 0
    if len(found) <= words:
        return xxhash.xxh64_intdigest(b" ".join(found), SEED)
    digest = xxhash.xxh64_intdigest
    shingles = map(b" ".join, zip(*(found[i:] for i in range(words))))
    hashes = np.array([digest(s, SEED) for s in shingles], dtype="<u8")
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), 8192):  # bounded unpacking for very long texts
        ones += np.unpackbits(hashes[at : at + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash (of the exact text), fp (signed 64-bit), uid for each row; null texts have no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 3, SLICE_BYTES):
                texts = part.column(3).cast(pa.binary()).to_pylist()
                made = np.array([fingerprint(t) if t else 0 for t in texts], dtype=np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(made)], names=["doc_id", "text_hash", "uid", "fp"])

    small_batches(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", F.xxhash64(text).alias("text_hash"), F.monotonically_increasing_id().alias("uid"), text.alias("text"))
    schema = T.StructType([*rows.schema.fields[:3], T.StructField("fp", T.LongType(), False)])
    return rows.mapInArrow(lean(run), schema)


def covering_masks(radius: int = RADIUS, step: int = 1) -> list[int]:
    """The bits that each table keeps, as signed 64-bit masks; ``step`` deals the vectors to the bits in runs of that length."""
    vectors = [i // step % (2 ** (radius + 1) - 1) + 1 for i in range(BITS)]
    masks = [sum(1 << i for i, x in enumerate(vectors) if (x & v).bit_count() % 2) for v in range(1, 2 ** (radius + 1))]
    return [_signed(m) for m in masks]


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def forest(values: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """A spanning forest of the links among distinct values (signed): pairs within ``radius`` bits."""
    if len(values) <= 24:
        left, out = [int(v) for v in values], []
        frontier: list[int] = []
        while left:
            frontier = [left.pop()]
            while frontier:
                x = frontier.pop()
                near = [y for y in left if ((x ^ y) & 0xFFFFFFFFFFFFFFFF).bit_count() <= radius]
                if near:
                    out += [(x, y) for y in near]
                    taken = set(near)
                    left = [y for y in left if y not in taken]
                    frontier += near
        return out
    left, out = values.view(np.uint64), []
    while len(left):
        frontier, left = [left[-1]], left[:-1]
        while frontier and len(left):
            x = frontier.pop()
            hit = np.bitwise_count(left ^ x) <= radius
            if hit.any():
                near = left[hit]
                a = _signed(int(x))
                out += [(a, b) for b in near.view(np.int64).tolist()]
                left = left[~hit]
                frontier += list(near)
    return out


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (k, key, fp) rows to links; a bucket may span batches, and is at most BUCKET rows."""
    names = ["a", "b"]

    def links(key: np.ndarray, fp: np.ndarray, starts: np.ndarray) -> pa.RecordBatch:
        ends = np.append(starts[1:], len(fp))
        out: list[tuple[int, int]] = []
        for s, e in zip(starts[ends - starts > 1].tolist(), ends[ends - starts > 1].tolist()):
            out += forest(fp[s:e])
        a, b = zip(*out) if out else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=names)

    kept = [np.empty(0, np.int64)] * 3
    for batch in batches:
        k, key, fp = (np.concatenate([old, new.to_numpy(zero_copy_only=False).astype(np.int64)]) for old, new in zip(kept, batch.columns))
        new = np.append(True, (k[1:] != k[:-1]) | (key[1:] != key[:-1])) if len(k) else np.empty(0, bool)
        starts = np.flatnonzero(new)
        if not len(starts):
            continue
        last = starts[-1]
        if last:
            yield links(key[:last], fp[:last], starts[:-1])
        kept = [k[last:], key[last:], fp[last:]]
    if len(kept[0]) > 1:
        yield links(kept[1], kept[2], np.array([0]))


def _flips(n: int) -> list[int]:
    return [_signed(sum(1 << i for i in c)) for c in combinations(range(BITS), n)]


def _crowded_links(fps: DataFrame) -> DataFrame:
    """Links of values (column fp) that share oversized buckets, joined around values one or two bits away."""
    xor = lambda masks: F.explode(F.transform(F.array(*map(F.lit, masks)), lambda m: F.col("fp").bitwiseXOR(m)))
    near = fps.select("fp", xor([0, *_flips(1)]).alias("z"))
    far = fps.filter(F.bit_count("fp") % 2 == 0).select("fp", xor(_flips(2)).alias("z"))
    least = near.groupBy("z").agg(F.min("fp").alias("m"))
    return near.unionByName(far).join(least, "z").select(F.col("fp").alias("a"), F.col("m").alias("b")).filter("a <> b")


def links(distinct: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) among distinct fingerprints (column fp) that connect exactly what pairs within RADIUS connect."""
    tables = F.array(*(F.struct(F.lit(k).cast("short").alias("k"), F.lit(m).alias("mask")) for k, m in enumerate(covering_masks())))
    rows = distinct.select("fp", F.explode(tables).alias("t")).select(F.col("t.k").alias("k"), F.col("fp").bitwiseAND(F.col("t.mask")).alias("key"), "fp")
    found, extra = rows, None
    crowded = _crowded(rows, bucket)
    if not crowded.isEmpty():
        found = rows.join(crowded, ["k", "key"], "left_anti").select("k", "key", "fp")
        second = F.array(*(F.struct(F.lit(j).alias("j"), F.lit(m).alias("mask")) for j, m in enumerate(covering_masks(step=SECOND_STEP))))
        own = F.get(F.array(*map(F.lit, covering_masks())), F.col("k"))
        again = rows.join(crowded, ["k", "key"], "left_semi").select("k", "fp", own.alias("own"), F.explode(second).alias("t"))
        again = again.select((F.col("k") * 16 + F.col("t.j") + 16).cast("short").alias("k"), F.col("fp").bitwiseAND(F.col("own").bitwiseOR(F.col("t.mask"))).alias("key"), "fp")
        again = written(again, "simhash-second")
        still = _crowded(again, bucket)
        if not still.isEmpty():
            extra = _crowded_links(written(again.join(still, ["k", "key"], "left_semi").select("fp").distinct(), "simhash-crowded-fps"))
            again = again.join(still, ["k", "key"], "left_anti").select("k", "key", "fp")
        found = found.unionByName(again)
    out = found.repartition("k", "key").sortWithinPartitions("k", "key").mapInArrow(lean(_search), "a long, b long")
    return out.unionByName(extra) if extra is not None else out


def _crowded(rows: DataFrame, bucket: int) -> DataFrame:
    return written(rows.groupBy("k", "key").agg(F.count("*").alias("n")).filter(F.col("n") > bucket).select("k", "key"), "simhash-crowded")


def components(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (columns doc_id, text): doc_id, text_hash, uid, fp, component_id, keeper (struct).

    Fingerprints within RADIUS bits are linked; component_id is the least doc_id reachable (null only if all are
    null) and keeper.uid the row that holds it. Null and empty texts have fingerprint 0, which is linked like any
    other. Repeated rows and ids stay rows of their own; an empty table gives an empty result.
    """
    table = written(fingerprints(docs), "simhash-fingerprints")
    best = F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("uid"))).alias("best")
    distinct = written(table.groupBy("fp").agg(best), "simhash-distinct")
    joined = written(connected_components(links(distinct.select("fp"))), "simhash-components")
    groups = distinct.join(joined, distinct["fp"] == joined["node"]).select("fp", "component", "best")
    least = groups.groupBy("component").agg(F.min("best").alias("best"))
    linked = groups.select("fp", "component").join(least, "component").select("fp", F.col("best").alias("linked"))
    owner = written(distinct.join(linked, "fp", "left").select("fp", F.coalesce("linked", "best").alias("keeper")), "simhash-owners")
    return table.join(owner, "fp").select("doc_id", "text_hash", "uid", "fp", F.col("keeper.doc_id").alias("component_id"), "keeper")


def deduplicate(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component, that of the least doc_id; all columns kept."""
    kept = components(docs).groupBy(F.col("doc_id").alias("_rk_id"), F.col("text_hash").alias("_rk_digest"))
    pairs = kept.agg(F.max(F.col("uid") == F.col("keeper.uid")).alias("_rk_any"), F.count("*").alias("_rk_rows"))
    return rows_kept(docs, pairs, F.xxhash64(F.coalesce(F.col("text"), F.lit(""))))


def hex_fingerprint(fp):
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
