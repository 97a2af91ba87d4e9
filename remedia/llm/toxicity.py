"""Toxicity by a subsequence string-kernel support vector machine with Nyström landmarks, trained on labelled sentences.

Strings are the windows of a sentence: WIDTH places and the SPAN - 1 characters that triples may reach beyond them; words stay
together with the spaces between them, so that phrases and split words count. The kernel of two strings is the inner product of
their character triples, in order and with gaps inside SPAN characters, each weighted by ``DECAY`` to the length it
spans: spellings with gaps or inserted characters stay close to the plain one. Strings are projected on landmark strings
(Nyström), and a linear machine with squared hinge loss separates the sentences of toxic documents from those of clean ones.

A label says that some sentence is toxic, not which. So the machine is trained in rounds: a toxic document counts
through the strings with the highest margins, a clean one through its highest too (and some drawn at random), and the next
machine learns from what the last one found. All rounds read the sample's whole texts on the executors.

The decision is linear in the kernel and the kernel in the triples, so the landmarks fold into one table of triple
weights; a text's margins are sliding sums of table reads. A logistic model on a document's highest margin, on how many
stretches have a positive one, and on its length turns that into a score from 0 to 1.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow_text import lean, slices
from .common import small_batches, written

#: The fitting sample: labelled documents, toxic and clean alike, with their whole texts.
TRAIN_ROWS = 6000
#: Part of the sample, in 8ths, that the machine learns from; the logistic model learns from the rest.
MACHINE_EIGHTHS = 5
#: Strings that a document gives to the first round, drawn at random, and that a toxic one gives to each later round at most.
RANDOM_STRINGS, PEAKS = 8, 6
#: Strings of either label that one round learns from, and the landmarks among them.
POSITIVE_STRINGS, NEGATIVE_STRINGS = 4000, 8000
LANDMARKS, CLEAN_LANDMARKS = 300, 200
MACHINES = 4
SPAN, WIDTH, DECAY = 7, 12, 0.6
HARDNESS, ROUNDS = 1e-5, 500
#: A peak teaches if its margin is above this quantile of the highest margins of clean documents.
PEAK_QUANTILE = 0.9
THRESHOLD = 0.7
SLICE_BYTES = 2 << 20
#: Places of a text that are scored at once.
SEGMENT = 1 << 20
_SYMBOLS, _SPACE, _NONE = 64, 62, 63
_BREAK = "\n" * (SPAN - 1)
_PLACES = [(j, k) for j in range(1, SPAN - 1) for k in range(j + 1, SPAN)]
_STRING = WIDTH + SPAN - 1
_SPACED = re.compile(r"(?<!\S)(?:\w[^\w\s]?[ \t]){3,}\w(?!\w)")
_EMPTY = (-3.0, 0.0, 0.0)


def sentences(texts: pa.Array) -> list[str]:
    """Each text in lower case without punctuation, its sentences framed by spaces and parted by breaks that no triple crosses."""
    low = pc.utf8_lower(texts)
    if pc.any(spaced := pc.match_substring_regex(low, r"(^|\s)\w([^\w\s]?[ \t]\w){3}")).as_py():
        low = pa.array([_SPACED.sub(lambda m: m.group().replace(" ", ""), t) if s else t for t, s in zip(low.to_pylist(), spaced.to_pylist())], pa.string())
    for pattern, put in ((r"[.!?]+(\s+|$)", "\n"), (r"[^\p{L}\p{M}\p{N}\s\p{Z}]+", ""), (r"[ \t\r\f\v\p{Z}]+", " "), (r" ?\n[ \n]*", f" {_BREAK} ")):
        low = pc.replace_substring_regex(low, pattern, put)
    return [f" {t} {_BREAK}" for t in low.to_pylist()]


def symbols(text: str) -> np.ndarray:
    """a-z are 1 to 26, digits 27, other characters share 28 to 61; a space is 62, a break 63."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    out = (28 + codes % 34).astype(np.int32)
    out = np.where((codes >= 97) & (codes <= 122), codes.astype(np.int32) - 96, out)
    out = np.where((codes >= 48) & (codes <= 57), 27, out)
    return np.where(codes == 32, _SPACE, np.where(codes == 10, _NONE, out)).astype(np.int32)


def contributions(marks: np.ndarray, n: int, table: np.ndarray) -> np.ndarray:
    """What the triples that start at each of the first ``n`` places add; ``marks`` goes on for SPAN - 1 places."""
    out, first = np.zeros(n, np.float32), marks[:n] << 12
    for j in range(1, SPAN - 1):
        pair = first + (marks[j : n + j] << 6)
        for k in range(j + 1, SPAN):
            out += np.float32(DECAY ** (k + 1)) * table[pair + marks[k : n + k]]
    return out


def margins(marks: np.ndarray, table: np.ndarray, bias: float) -> Iterator[tuple[int, np.ndarray]]:
    """(place, margins of the strings that start there and after it) of a whole text, a segment at a time.

    A string ends with its sentence; at a break the margin is the bias.
    """
    total = len(marks)
    for at in range(0, total, SEGMENT):
        n = min(SEGMENT, total - at)
        more = min(n + WIDTH, total - at)
        seen = marks[at : at + more + SPAN - 1]
        seen = np.concatenate([seen, np.full(more + SPAN - 1 - len(seen), _NONE, np.int32)])
        upto = np.concatenate([[0.0], np.cumsum(contributions(seen, more, table), dtype=np.float64)])
        ends = np.where(seen[:more] == _NONE, np.arange(more), more)
        ends = np.minimum.accumulate(ends[::-1])[::-1][:n]
        yield at, upto[np.minimum(np.arange(n) + WIDTH, ends)] - upto[:n] + bias


def triples(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Triple codes of each string (rows; the last code where there is none) and the weights of the columns."""
    marks = np.full((len(strings), _STRING), _NONE, np.int32)
    for i, s in enumerate(strings):
        marks[i, : min(len(s), _STRING)] = symbols(s[:_STRING])
    first = marks[:, :WIDTH]
    codes = [(first << 12) + (marks[:, j : WIDTH + j] << 6) + marks[:, k : WIDTH + k] for j, k in _PLACES]
    live = [(first != _NONE) & (marks[:, j : WIDTH + j] != _NONE) & (marks[:, k : WIDTH + k] != _NONE) for j, k in _PLACES]
    none = _SYMBOLS**3 - 1
    return np.hstack([np.where(ok, c, none) for c, ok in zip(codes, live)]), np.repeat([DECAY ** (k + 1) for _, k in _PLACES], WIDTH).astype(np.float32)


def kernel(strings: list[str], marks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Kernel of each string with each landmark, and the landmarks' features: triples (rows) that occur, and their weights."""
    codes, weights = triples(strings)
    of_marks, _ = triples(marks)
    used = np.setdiff1d(of_marks, [_SYMBOLS**3 - 1])
    row = np.full(_SYMBOLS**3, len(used))
    row[used] = np.arange(len(used))
    basis = np.zeros((len(used) + 1, len(marks)), np.float32)
    for column, of in enumerate(of_marks):
        np.add.at(basis[:, column], row[of], weights)
    basis[-1] = 0
    return np.stack([weights @ basis[row[c]] for c in codes]), used, basis[:-1]


def disguised(string: str) -> str:
    """The string with one character inserted at a place fixed by its letters."""
    at = 2 + zlib.crc32(string.encode()) % max(1, len(string) - 3)
    return (string[:at] + "x1o"[at % 3] + string[at:])[:_STRING]


def machine(positive: list[str], negative: list[str]) -> tuple[np.ndarray, float]:
    """Triple table and bias of the machine that separates two lists of strings; both labels weigh alike."""
    spread = lambda rows, most: rows[:: max(1, -(-len(rows) // most))]
    marks = spread(positive, LANDMARKS) + spread(negative, CLEAN_LANDMARKS)
    strings = positive + [disguised(s) for s in positive] + negative
    y = np.repeat([1.0, 1.0, -1.0], [len(positive), len(positive), len(negative)])
    weight = np.repeat([0.8, 0.2, 1.0], [len(positive), len(positive), len(negative)])
    weight /= np.where(y > 0, weight[y > 0].sum(), weight[y < 0].sum())
    near, used, basis = kernel(strings + marks, marks)
    values, vectors = np.linalg.eigh(near[len(strings) :].astype(float))
    good = values > 1e-5 * values.max()
    whiten = vectors[:, good] / np.sqrt(values[good])
    z = near[: len(strings)] @ whiten
    scale = np.sqrt((z**2).sum(axis=1).mean())
    z /= scale
    w, b, m, v = np.zeros(z.shape[1]), 0.0, np.zeros(z.shape[1] + 1), np.zeros(z.shape[1] + 1)
    for t in range(1, ROUNDS + 1):  # squared hinge loss, whole batches, Adam
        pull = weight * y * np.maximum(0, 1 - y * (z @ w + b))
        grad = np.append(HARDNESS * w - z.T @ pull, -pull.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        move = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
        w, b = w - move[:-1], b - move[-1]
    table = np.zeros(_SYMBOLS**3, np.float32)
    table[used] = basis @ (whiten @ (w / scale))
    return table, float(b)


@dataclass
class Model:
    table: np.ndarray
    bias: float
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    #: The score of every text, where the sample lacks one of the labels.
    constant: float | None = None

    def score(self, measures: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(measures), self.constant)
        x = np.hstack([(measures - self.mean) / self.spread, np.ones((len(measures), 1))])
        return 1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30)))


def measure(table: np.ndarray, bias: float, texts: pa.Array) -> np.ndarray:
    """Per text: highest margin, stretches with a positive one (log), and length (log)."""
    made = sentences(pc.fill_null(texts.cast(pa.string()), ""))
    starts = np.cumsum([0, *map(len, made)])
    top, hits = np.full(len(made), -np.inf), np.zeros(len(made))
    before = False
    for at, found in margins(symbols("".join(made)), table, bias):
        rows = np.arange(np.searchsorted(starts, at, side="right") - 1, np.searchsorted(starts, at + len(found), side="left"))
        cuts = np.maximum(starts[rows] - at, 0)
        top[rows] = np.maximum(top[rows], np.maximum.reduceat(found, cuts))
        good = found > 0
        begun = good & ~np.concatenate([[before], good[:-1]])
        hits[rows] += np.add.reduceat(begun, cuts, dtype=np.int64)
        before = bool(good[-1])
    length = np.diff(starts) - len(_BREAK) - 2
    return np.where((length <= 0)[:, None], _EMPTY, np.column_stack([np.clip(top, -3, 2), np.log1p(hits), np.log1p(np.maximum(length, 0))]))


def strings_of(text: str, table: np.ndarray | None, bias: float, peaks: int) -> list[tuple[float, str]]:
    """(margin, string) of the ``peaks`` highest strings of a text that don't overlap; without a table, of strings drawn by its letters."""
    text = sentences(pa.array([text]))[0]
    marks = symbols(text)
    cut = lambda p: text[p : p + _STRING].split("\n", 1)[0]
    if table is None:
        places = np.flatnonzero(marks != _NONE)
        draw = np.random.default_rng(zlib.crc32(text.encode()))
        return [(0.0, cut(p)) for p in draw.choice(places, min(peaks, len(places)), replace=False)] if len(places) > 3 else []
    values = np.concatenate([found for _, found in margins(marks, table, bias)])
    values[marks == _NONE] = -np.inf
    out: list[tuple[float, str]] = []
    taken: list[int] = []
    # The highest places of a text lie around its peaks; a peak rules out WIDTH places on either side.
    for p in np.argsort(-values, kind="stable")[: peaks * 4 * WIDTH].tolist():
        if len(out) < peaks and np.isfinite(values[p]) and all(abs(p - q) >= WIDTH for q in taken):
            taken.append(p)
            out.append((float(values[p]), cut(p)))
    return out


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, spread and weights (last: constant), by Newton's method."""
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-9
    x = np.hstack([(x - mean) / spread, np.ones((len(x), 1))])
    w, penalty = np.zeros(x.shape[1]), np.append(np.full(x.shape[1] - 1, ridge), 1e-3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(penalty)
        w = w - np.linalg.solve(hessian, x.T @ (p - y) + penalty * w)
    return mean, spread, w


def held_out(doc_id):
    """True for the third of documents that no label is learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """text, toxic, part (0 to 7) of at most ``rows`` learnable documents with one clear label, in an order fixed by doc_id."""
    clear = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id")
    clear = clear.agg(F.min("toxic").cast("int").alias("toxic"), F.max("toxic").cast("int").alias("most")).filter((F.col("toxic") == F.col("most")) & F.col("toxic").isin(0, 1))
    order = F.xxhash64(F.col("doc_id"), F.lit(5))
    chosen = clear.orderBy(order, "doc_id").limit(rows).select(F.col("doc_id").alias("_id"), "toxic", F.pmod(order, F.lit(8)).alias("part"))
    found = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))
    # Copies of one text would make all its strings look telling.
    return found.groupBy(F.sha2("text", 256)).agg(F.first("text").alias("text"), F.max("toxic").alias("toxic"), F.min("part").alias("part")).select("text", "toxic", "part")


def mined(rows: DataFrame, table: np.ndarray | None, bias: float) -> list:
    """(toxic, nth, margin, string) of each text of the sample: a toxic one's highest strings, a clean one's highest; at first drawn ones."""
    shared = rows.sparkSession.sparkContext.broadcast((table, bias))  # 1 MB, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                peaks = RANDOM_STRINGS if shared.value[0] is None else PEAKS if toxic else 1
                out += [(toxic, nth, margin, s) for nth, (margin, s) in enumerate(strings_of(text, *shared.value, peaks))]
            columns = list(zip(*out)) or [()] * 4
            kinds = (pa.int32(), pa.int32(), pa.float64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["toxic", "nth", "margin", "string"])

    got = rows.select("text", "toxic").mapInArrow(lean(run), "toxic int, nth int, margin double, string string").collect()
    shared.unpersist()
    # In an order that does not depend on partitions.
    return sorted(got, key=lambda r: (zlib.crc32(r["string"].encode()), r["string"], r["margin"]))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """The model, from at most TRAIN_ROWS labelled documents.

    What comes to the driver: at most RANDOM_STRINGS strings of 18 characters in each round, and three numbers, for each
    document of the sample. Documents whose labels contradict each other, and labels other than 0 and 1, are not learned from. With no
    example of one of the labels every score is the share of toxic labels (0 without labels).
    """
    spark = docs.sparkSession
    small_batches(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = written(sample(docs, labels).repartition(parts), "toxicity-sample")
    size = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    flat = Model(np.zeros(_SYMBOLS**3, np.float32), -1.0, np.zeros(3), np.ones(3), np.zeros(4), constant=1.0 if size.get(1) else 0.0)
    if not size.get(1) or not size.get(0):
        return flat
    learning = rows.filter(F.col("part") < MACHINE_EIGHTHS)
    if {r["toxic"] for r in learning.select("toxic").distinct().collect()} != {0, 1} or size[1] < 100:
        learning = rows
    table, bias = None, 0.0
    negative: dict[str, None] = {}
    for _ in range(MACHINES):
        found = mined(learning, table, bias)
        if table is not None:
            tops = [r["margin"] for r in found if not r["toxic"]]
            least = float(np.quantile(tops, PEAK_QUANTILE)) if tops else 0.0
            found = [r for r in found if not r["toxic"] or not r["nth"] or r["margin"] > least]
        positive = list(dict.fromkeys(r["string"] for r in found if r["toxic"]))
        # Clean strings of all rounds teach, the latest first.
        negative = dict.fromkeys([*(r["string"] for r in found if not r["toxic"]), *negative])
        if not positive or not negative:
            return flat
        spread = sorted(list(negative)[:NEGATIVE_STRINGS], key=lambda s: zlib.crc32(s.encode()))
        table, bias = machine(positive[:POSITIVE_STRINGS], spread)
    got = measures(rows.select("toxic", "part", "text"), table, bias).collect()
    rest = [r for r in got if r["part"] >= MACHINE_EIGHTHS]
    if sum(r["toxic"] for r in rest) < 40 or sum(1 - r["toxic"] for r in rest) < 40:
        rest = got
    fitted = _logistic(np.array([r["measures"] for r in rest]), np.array([float(r["toxic"]) for r in rest]))
    return Model(table, bias, *fitted)


def measures(rows: DataFrame, table: np.ndarray, bias: float) -> DataFrame:
    """The columns of ``rows`` other than text, and measures (array of doubles)."""
    shared = rows.sparkSession.sparkContext.broadcast((table, bias))  # 1 MB, whatever the input
    keep = [c for c in rows.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, len(keep), SLICE_BYTES):
                got = measure(*shared.value, part.column(len(keep)))
                values = pa.FixedSizeListArray.from_arrays(pa.array(got.ravel()), got.shape[1]).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], values], names=[*keep, "measures"])

    schema = T.StructType([*(rows.schema[c] for c in keep), T.StructField("measures", T.ArrayType(T.DoubleType()))])
    return rows.select(*keep, "text").mapInArrow(lean(run), schema)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, predicted for each row of ``docs`` (columns doc_id, text), whole texts.

    Null and empty texts have no sentences and get the score of a text without any sign of toxicity. Rows are scored by
    themselves: null ids and repeated rows make no difference; an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, SLICE_BYTES):
                own = shared.value
                got = own.score(measure(own.table, own.bias, part.column(1)))
                flags = pa.array((got >= THRESHOLD).astype(np.int32))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(got), flags], names=["doc_id", "score", "predicted"])

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    schema = T.StructType([rows.schema["doc_id"], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return rows.mapInArrow(lean(run), schema)
