"""Language ID by segmentation-marginalised unigrams.

The pieces of a fixed public vocabulary get a probability in each language, learned by expectation maximisation on a
bounded sample of labelled documents. A word's probability is the sum over all its segmentations into pieces, by the
forward algorithm; a text's is the product over its words. Words of an Arrow batch are dictionary-encoded, so each
distinct word is scored once, and all words of one length advance through the lattice together in arrays; a word
follows the vocabulary's trie, so only pieces that it holds cost anything.

A word is a run of letters and marks, lower-cased, with the vocabulary's word-start sign before it, whole whatever its
length: words beyond ``LONGEST`` go through the same lattice one by one, in logarithms. A character outside the
vocabulary has the same small probability in each language.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .arrow_text import by_length, code_points, encoded, lean, slices
from .common import broadcast_if_small, small_batches, written

#: The fitting sample: documents of each language, with all their words.
TRAIN_ROWS = 400
#: Files that the sample's words are dealt to, for each round of learning.
WORD_PARTS = 32
#: Labels that a model may have: it holds a number for each piece and language, and every task reads it.
MAX_LANGUAGES = 512
EM_ROUNDS = 4
SMOOTH = 0.05
UNKNOWN = 1e-8
#: Longest word that is scored in plain numbers together with others; no smaller probability underflows.
LONGEST = 32
START = "▁"
UNDECIDED = "und"
#: Texts below this posterior are rejected by the filter.
LEAST_SCORE = 0.5
#: Text bytes that are scored at once.
SLICE_BYTES = 4 << 20
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_SLOT_BITS = 18


def vocabulary(path: str) -> list[str]:
    """Lower-case pieces of letters and marks of a SentencePiece model file, with or without the word-start sign."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {model.id_to_piece(i) for i in range(model.get_piece_size())}
    lettered = lambda c: bool(c) and all(unicodedata.category(x)[0] in "LM" for x in c)
    return sorted(p for p in pieces if lettered(c := p.removeprefix(START)) and c == c.lower())


def _hash_step(h: np.ndarray, code: np.ndarray) -> np.ndarray:
    return (h ^ (code + np.uint64(1))) * _MULTIPLIER


class Lattice:
    """The vocabulary as a trie: hashes of all beginnings of pieces, each with the number of the piece that it is, or ``none``."""

    def __init__(self, pieces: list[str]) -> None:
        self.none, self.longest = len(pieces), max(map(len, pieces), default=0)
        numbers = {p: i for i, p in enumerate(pieces)}
        beginnings = sorted({p[:k] for p in pieces for k in range(1, len(p) + 1)})
        hashes = np.zeros(len(beginnings), np.uint64)
        for length, at, codes in by_length(beginnings):
            for e in range(length):
                hashes[at] = _hash_step(hashes[at], codes[:, e].astype(np.uint64))
        order = np.argsort(hashes)
        self.hashes, self.piece = hashes[order], np.array([numbers.get(b, self.none) for b in beginnings], dtype=np.int64)[order]
        assert len(np.unique(self.hashes)) == len(beginnings), "piece hashes collide"
        # First sorted entry of each hash prefix, so a lookup is one array read and a few steps.
        self.shift = np.uint64(64 - _SLOT_BITS)
        self.first = np.searchsorted(self.hashes, np.arange(1 << _SLOT_BITS, dtype=np.uint64) << self.shift).astype(np.int32)
        self.steps = int(np.bincount((self.hashes >> self.shift).astype(np.int64)).max()) if beginnings else 0

    def find(self, h: np.ndarray) -> np.ndarray:
        """Entry of each hash, or -1."""
        at = self.first[(h >> self.shift).astype(np.int64)]
        out = np.full(len(h), -1, dtype=np.int64)
        for step in range(self.steps):
            i = np.minimum(at + step, len(self.hashes) - 1)
            out = np.where(self.hashes[i] == h, i, out)
        return out

    def _grow(self, starts: np.ndarray, code_at) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(length, which of ``starts``, piece) of all pieces from the starts on; ``code_at(which, offset)`` is -1 beyond the word."""
        which, h = starts, np.zeros(len(starts), np.uint64)
        for offset in range(self.longest):
            code = code_at(which, offset)
            inside = code >= 0
            which, h = which[inside], _hash_step(h[inside], code[inside].astype(np.uint64))
            entry = self.find(h)
            known = entry >= 0
            which, h, piece = which[known], h[known], self.piece[entry[known]]
            if not len(which):
                return
            hit = piece != self.none
            yield offset + 1, which[hit], piece[hit]

    def edges(self, codes: np.ndarray) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
        """(start, end, words, pieces), by start, of the words that are the rows of ``codes``; an unknown character is piece ``none``."""
        n, length = codes.shape
        out = []
        for s in range(length):
            single = np.full(n, self.none)
            found = []
            for size, rows, piece in self._grow(np.arange(n), lambda rows, o: codes[rows, s + o].astype(np.int64) if s + o < length else np.full(len(rows), -1)):  # noqa: B023
                if size == 1:
                    single[rows] = piece
                elif len(rows):
                    found.append((s, s + size, rows, piece))
            out += [(s, s + 1, np.arange(n), single), *found]
        return out

    def edges_of(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """start, end, piece of all pieces in one word, by end; an unknown character is piece ``none``."""
        n = len(codes)
        padded = np.concatenate([codes.astype(np.int64), np.full(self.longest, -1)])
        single, parts = np.full(n, self.none), []
        for size, at, piece in self._grow(np.arange(n), lambda at, o: padded[at + o]):
            if size == 1:
                single[at] = piece
            else:
                parts.append((at, at + size, piece))
        s, e, p = (np.concatenate(c) for c in zip((np.arange(n), np.arange(n) + 1, single), *parts))
        order = np.argsort(e, kind="stable")
        return s[order], e[order], p[order]


def forward(edges: list, n: int, length: int, probs: np.ndarray) -> np.ndarray:
    """alpha[place, word, language]; the last row of ``probs`` is an unknown character's."""
    alpha = np.zeros((length + 1, n, probs.shape[1]))
    alpha[0] = 1
    for s, e, rows, piece in edges:
        if len(rows) == n:
            alpha[e] += alpha[s] * probs[piece]
        else:
            alpha[e][rows] += alpha[s][rows] * probs[piece]
    return alpha


def _backward(edges: list, n: int, length: int, probs: np.ndarray) -> np.ndarray:
    beta = np.zeros((length + 1, n, probs.shape[1]))
    beta[length] = 1
    for s, e, rows, piece in reversed(edges):
        beta[s][rows] += beta[e][rows] * probs[piece]
    return beta


def _log_forward(s: np.ndarray, e: np.ndarray, p: np.ndarray, n: int, logs: np.ndarray) -> np.ndarray:
    """Logarithms of alpha (place, language) of one word whose edges are given by end."""
    alpha = np.zeros((n + 1, logs.shape[1]))
    cuts = np.searchsorted(e, np.arange(1, n + 2))
    for k in range(1, n + 1):
        i, j = cuts[k - 1], cuts[k]
        terms = alpha[s[i:j]] + logs[p[i:j]]
        top = terms.max(axis=0)
        alpha[k] = top + np.log(np.exp(terms - top).sum(axis=0))
    return alpha


def expected(lattice: Lattice, words: list[str], weights: np.ndarray, probs: np.ndarray | None) -> np.ndarray:
    """Expected piece counts of weighted words for one language (``probs`` of one column); without it, each piece at each of its places."""
    counts = np.zeros(lattice.none + 1)
    tally = lambda piece, w: np.add(counts, np.bincount(piece, weights=w, minlength=len(counts)), out=counts)
    framed = [START + w for w in words]
    long = [i for i, w in enumerate(framed) if len(w) > LONGEST]
    for length, at, codes in by_length([w if len(w) <= LONGEST else "" for w in framed]):
        step = max(64, 400_000 // (length + 1))
        for k in range(0, len(at), step):
            rows_at, weight = at[k : k + step], weights[at[k : k + step]]
            edges = lattice.edges(codes[k : k + step])
            if probs is None:
                for _, _, rows, piece in edges:
                    tally(piece, weight[rows])
                continue
            alpha, beta = (f(edges, len(rows_at), length, probs)[:, :, 0] for f in (forward, _backward))
            for s, e, rows, piece in edges:
                tally(piece, weight[rows] * alpha[s][rows] * probs[piece, 0] * beta[e][rows] / alpha[length][rows])
    for i in long:
        codes = code_points([framed[i]])
        n = len(codes)
        s, e, p = lattice.edges_of(codes)
        if probs is None:
            tally(p, np.full(len(p), weights[i]))
            continue
        logs = np.log(probs)
        alpha = _log_forward(s, e, p, n, logs)[:, 0]
        # Backwards is forwards over the mirrored word.
        mirrored = np.argsort(n - s, kind="stable")
        beta = _log_forward((n - e)[mirrored], (n - s)[mirrored], p[mirrored], n, logs)[::-1, 0]
        tally(p, weights[i] * np.exp(alpha[s] + logs[p, 0] + beta[e] - alpha[n]))
    counts[-1] = 0
    return counts


@dataclass
class Model:
    languages: list[str]
    lattice: Lattice
    #: Probability of each piece in each language; the last row is an unknown character's.
    probs: np.ndarray

    def score_words(self, words: list[str]) -> np.ndarray:
        """Log-probability of each word in each language; 0 for an empty word."""
        framed = [START + w if w else "" for w in words]
        out = np.zeros((len(words), len(self.languages)))
        for length, at, codes in by_length([w if len(w) <= LONGEST else "" for w in framed]):
            step = max(64, 1_500_000 // ((length + 1) * len(self.languages)))
            for k in range(0, len(at), step):
                some = codes[k : k + step]
                out[at[k : k + step]] = np.log(forward(self.lattice.edges(some), len(some), length, self.probs)[length])
        if long := [i for i, w in enumerate(framed) if len(w) > LONGEST]:
            logs = np.log(self.probs)
            for i in long:
                codes = code_points([framed[i]])
                out[i] = _log_forward(*self.lattice.edges_of(codes), len(codes), logs)[-1]
        return out


def split_words(texts: pa.Array) -> pa.ListArray:
    """Lower-case runs of letters and marks of each text (some may be empty)."""
    clean = pc.replace_substring_regex(pc.utf8_lower(texts), r"[^\p{L}\p{M}]+", " ")
    return pc.split_pattern(clean, " ")


def score_texts(model: Model, texts: pa.Array) -> tuple[list[str], np.ndarray]:
    """Predicted language and its posterior (equal priors) for each text."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    words = split_words(texts)
    distinct, which, owner = encoded(words)
    n, languages = len(texts), model.languages
    total = np.zeros((n, len(languages)))
    if distinct and languages:
        logs = model.score_words(distinct)
        for k in range(len(languages)):
            total[:, k] = np.bincount(owner, weights=logs[which, k], minlength=n)
    lettered = pc.match_substring_regex(texts, r"\p{L}").to_numpy(zero_copy_only=False)
    if not languages:
        return [UNDECIDED] * n, np.zeros(n)
    best = total.argmax(axis=1)
    share = np.exp(total - total.max(axis=1, keepdims=True))
    score = np.where(lettered, 1 / share.sum(axis=1), 0.0)
    return [languages[b] if ok else UNDECIDED for b, ok in zip(best, lettered)], score


def held_out(doc_id):
    """True for the quarter of documents that no label is learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def _lowest(rows: DataFrame, most: int) -> DataFrame:
    """The ``most`` rows (doc_id, lang, h) of each language with the least hash ``h`` (0 to 2**62).

    A language's rows never meet in one task: counts of hash ranges, twice refined, tell below which range they lie, and only
    rows of these ranges, a 65,536th more than asked for, are ranked.
    """
    ranges = rows.select("doc_id", "lang", "h", F.shiftright("h", 54).alias("r1"), (F.shiftright("h", 46).bitwiseAND(F.lit(255))).alias("r2"))

    def cut(counted: DataFrame, r: str, before) -> DataFrame:
        upto = before + F.sum("n").over(Window.partitionBy("lang").orderBy(r))
        reached = counted.withColumn("upto", upto).withColumn("least", F.when((F.col("upto") >= most), F.col(r)))
        last = reached.groupBy("lang").agg(F.coalesce(F.min("least"), F.lit(255)).alias("c"), F.max_by("upto", r).alias("all"), F.collect_list(F.struct(r, "upto", "n")).alias("seen"))
        below = F.coalesce(F.get(F.filter("seen", lambda x: x[r] == F.col("c")), 0), F.lit(None))
        return last.select(F.col("lang").alias("_lang"), F.col("c").alias(f"c_{r}"), F.coalesce(below["upto"] - below["n"], F.col("all")).alias(f"below_{r}"))

    c1 = F.broadcast(written(cut(ranges.groupBy("lang", "r1").agg(F.count("*").alias("n")), "r1", F.lit(0)), "langid-ranges"))
    within = ranges.join(c1, F.col("lang") == F.col("_lang")).filter("r1 = c_r1").groupBy("lang", "below_r1", "r2").agg(F.count("*").alias("n"))
    c2 = F.broadcast(written(cut(within, "r2", F.col("below_r1")), "langid-ranges"))
    near = ranges.join(c1.select("_lang", "c_r1"), F.col("lang") == F.col("_lang")).drop("_lang")
    near = near.join(c2.select("_lang", "c_r2"), F.col("lang") == F.col("_lang"), "left").filter("r1 < c_r1 OR (r1 = c_r1 AND r2 <= coalesce(c_r2, 255))")
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))
    return near.withColumn("_nth", nth).filter(F.col("_nth") <= most).select("doc_id", "lang")


def training_words(docs: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """lang, word, n: all words of at most ``rows`` learnable documents of each language, in an order fixed by doc_id.

    More than MAX_LANGUAGES labels are an error: group or filter them first.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, SLICE_BYTES):
                found = split_words(pc.fill_null(part.column(1).cast(pa.string()), ""))
                lang = pc.take(part.column(0), pc.list_parent_indices(found))
                table = pa.table({"lang": lang, "word": found.flatten()}).group_by(["lang", "word"]).aggregate([([], "count_all")])
                yield from table.select(["lang", "word", "count_all"]).rename_columns(["lang", "word", "n"]).to_batches()

    usable = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), "text")
    usable = usable.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    if (n := usable.select("lang").distinct().limit(MAX_LANGUAGES + 1).count()) > MAX_LANGUAGES:
        raise ValueError(f"{n} or more language labels, {MAX_LANGUAGES} allowed")
    chosen = _lowest(usable.select("doc_id", "lang", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 62)).alias("h")), rows)
    chosen = broadcast_if_small(written(chosen.select(F.col("doc_id").alias("_id"), F.col("lang").alias("_lang")).distinct(), "langid-sample"))  # at most ``rows`` a language
    texts = usable.join(chosen, (F.col("doc_id") == F.col("_id")) & (F.col("lang") == F.col("_lang"))).select("lang", "text")
    return texts.mapInArrow(lean(count), "lang string, word string, n long").filter("word <> ''").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _piece_counts(words: DataFrame, lattice: Lattice, languages: list[str], probs: np.ndarray | None) -> np.ndarray:
    """Expected piece counts of each language (columns) over the words, summed by Spark: pieces x languages numbers come to the driver."""
    shared = words.sparkSession.sparkContext.broadcast((lattice, languages, probs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, names, now = shared.value
        for batch in batches:
            table = pa.Table.from_batches([batch])
            for k, name in enumerate(names):
                some = table.filter(pc.equal(table["lang"], name))
                if some.num_rows:
                    counts = expected(own, some["word"].to_pylist(), some["n"].to_numpy().astype(float), None if now is None else now[:, [k]])
                    hit = np.flatnonzero(counts)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(hit), k)), pa.array(hit), pa.array(counts[hit])], names=["k", "piece", "n"])

    found = words.mapInArrow(lean(run), "k long, piece long, n double").groupBy("k", "piece").agg(F.sum("n").alias("n")).toArrow()
    shared.unpersist()
    counts = np.zeros((lattice.none + 1, len(languages)))
    counts[found["piece"].to_numpy(), found["k"].to_numpy()] = found["n"].to_numpy()
    return counts


def fit(docs: DataFrame, vocabulary_path: str, rounds: int = EM_ROUNDS) -> Model:
    """Piece probabilities of each language, learned by all executors from the sample's words; the driver sees sums only."""
    pieces = vocabulary(vocabulary_path)
    lattice = Lattice(pieces)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    words = written(training_words(docs).repartition(min(parts, WORD_PARTS), "lang", "word"), "langid-words")
    languages = sorted(r["lang"] for r in words.select("lang").distinct().collect())
    if not languages:
        return Model([], lattice, np.full((len(pieces) + 1, 1), UNKNOWN))

    def normalised(counts: np.ndarray) -> np.ndarray:
        probs = (counts + SMOOTH) / (counts[:-1].sum(axis=0) + SMOOTH * len(pieces))
        probs[-1] = UNKNOWN
        return probs

    probs = normalised(_piece_counts(words, lattice, languages, None))
    for _ in range(rounds):
        probs = normalised(_piece_counts(words, lattice, languages, probs))
    return Model(languages, lattice, probs)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score for each row of ``docs`` (columns doc_id, text), whole texts.

    A null text, or one without a letter, is ``und`` with score 0; of languages with equal probability the first in
    alphabetical order is named. Rows are scored by themselves, so null ids and repeated rows make no difference;
    an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # vocabulary size x languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, SLICE_BYTES):
                lang, score = score_texts(shared.value, part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lang, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    schema = T.StructType([rows.schema["doc_id"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(lean(run), schema)


def keep_identified(docs: DataFrame, model: Model, least: float = LEAST_SCORE) -> DataFrame:
    """Rows of ``docs`` in a known language with a score of ``least`` or more: all columns, no shuffle.

    Rejected are null texts, texts without a letter, and texts that no language explains clearly better than the others.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, at, SLICE_BYTES):
                lang, score = score_texts(shared.value, part.column(at))
                yield part.filter(pa.array((np.array(lang, dtype=object) != UNDECIDED) & (score >= least)))

    return docs.mapInArrow(lean(run), docs.schema)
