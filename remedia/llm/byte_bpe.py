"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

A rank file (base64 token and rank on each line) becomes a byte-level BPE model of the tokenizers library: bytes are
written as printable characters by the public byte table, and every way to put a token together from two others is a
merge, in order of the token's rank. Texts are cut where a single space stands between two characters that aren't white
space; the pre-token pattern always has a boundary there, so chunks encode independently and each distinct chunk of a
batch is cut into pre-tokens and encoded once. Decoding reverses the byte table; characters may be split over tokens.

Two merges that make the same token have one rank in the rank file and two in the library. They can only compete where
the token overlaps itself; the few pre-tokens in which one does (found by an Aho-Corasick search) go to tiktoken.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import chain

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow_text import lean, slices
from .common import small_batches

#: Chunks that a worker remembers, and the longest one it does.
REMEMBERED, REMEMBERED_CHARS = 200_000, 48
SLICE_BYTES = 4 << 20
#: ASCII letters: the byte table leaves them as they are, and a pattern that takes letters in runs (told by the probes) takes them whole.
_WORD, _PROBES = re.compile(r"[A-Za-z]+"), ("a", "Z", "theQuickFOX", "s", "ll", "VEre", "q" * 200)
_UNSAFE = re.compile(r" \s|\s ")
_SAFE_CUT = re.compile(r"(?<=\S) (?=\S)")


def byte_table() -> dict[int, str]:
    """The public byte-to-character table: printable Latin-1 bytes are themselves, the others follow from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


def safe_chunks(text: str) -> tuple[str, list[str]]:
    """First chunk, and the others without the one space before each; pre-tokens never span two chunks."""
    first, *rest = _SAFE_CUT.split(text) if _UNSAFE.search(text) else text.split(" ")
    return first, rest


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class _Recent:
    """What a worker remembers: two generations, the older one dropped when the younger is full."""

    def __init__(self, most: int) -> None:
        self.most, self.young, self.old = most, {}, {}

    def turn(self) -> dict[str, tuple[int, ...]]:
        """The younger generation, begun anew if it is full."""
        if len(self.young) >= self.most:
            self.young, self.old = {}, self.young
        return self.young


class Codec:
    """Encoder and decoder of one rank file; made once a worker and kept."""

    def __init__(self, path: str, pattern: str, remembered: int = REMEMBERED) -> None:
        import ahocorasick
        from tokenizers import models

        ranks = load_ranks(path)
        table = byte_table()
        shown = {token: "".join(map(table.__getitem__, token)) for token in ranks}
        merges, overlaps = [], ahocorasick.Automaton()
        for token, rank in ranks.items():
            ways = [(token[:i], token[i:]) for i in range(1, len(token)) if token[:i] in ranks and token[i:] in ranks]
            merges += [(rank, ranks[a], ranks[b], shown[a], shown[b]) for a, b in ways]
            for shared in {a for a, _ in ways} & {b for _, b in ways}:  # the token can overlap itself by this much
                overlaps.add_word(shown[token] + shown[token[len(shared) :]], rank)
        overlaps.make_automaton()
        merges.sort()
        self.overlaps = overlaps
        self.model = models.BPE({shown[t]: r for t, r in ranks.items()}, [(a, b) for *_, a, b in merges], cache_capacity=0)
        self.pattern = regex.compile(pattern)
        self.exact = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.table = {b: c for b, c in table.items() if chr(b) != c}
        self.space = table[ord(" ")]
        self.takes_runs = all(self.pattern.findall(" " + w) == [" " + w] for w in _PROBES)
        back = {c: b for b, c in table.items()}
        size = max(ranks.values()) + 1
        self.bytes_of = [b""] * size
        for token, rank in ranks.items():
            self.bytes_of[rank] = bytes(map(back.__getitem__, shown[token]))
        self.decimal = list(map(str, range(size)))
        self.number = list(range(size))  # one object for each id, so that remembered pieces share them
        self.whole = {shown[t]: (self.number[r],) for t, r in ranks.items()}
        self.chunks, self.pieces = _Recent(remembered), _Recent(remembered)

    def _ids(self, seen: str, piece: str) -> tuple[int, ...]:
        """Ids of one match of the pattern, given also with each byte as its character."""
        ids = self.whole.get(seen)
        if ids is None:
            if self.overlaps and next(self.overlaps.iter(seen), None):
                ids = self.exact.encode_ordinary(piece)
            else:
                ids = [t.id for t in self.model.tokenize(seen)]
            ids = tuple(map(self.number.__getitem__, ids))
        return ids

    def _chunk(self, chunk: str) -> tuple[int, ...]:
        """Ids of a text without safe cuts inside; pieces are looked up before they are encoded."""
        memo, old, out = self.pieces.young, self.pieces.old, []
        for piece in self.pattern.findall(chunk):
            ids = memo.get(piece)
            if ids is None:
                ids = old.get(piece)
                if ids is None:
                    ids = self._ids(piece.encode("utf-8", "replace").decode("latin-1").translate(self.table), piece)
                if len(piece) <= REMEMBERED_CHARS:
                    memo[piece] = ids
            out.append(ids)
        return out[0] if len(out) == 1 else tuple(chain.from_iterable(out))

    def _learn(self, chunks: Iterable[str]) -> tuple[dict[str, tuple[int, ...]], list[str]]:
        """Ids of all distinct chunks, each behind a space, and the long ones among them, to be forgotten after use."""
        memo, old = self.chunks.turn(), self.chunks.old
        self.pieces.turn()
        long, space = [], self.space
        for c in dict.fromkeys(chunks):
            if c in memo:
                continue
            ids = old.get(c)
            if ids is None:
                if self.takes_runs and _WORD.fullmatch(c):  # one match of the pattern, whose bytes are characters of their own
                    ids = self._ids(space + c, " " + c)
                else:
                    ids = self._chunk(" " + c)
            memo[c] = ids
            if len(c) > REMEMBERED_CHARS:
                long.append(c)
        return memo, long

    def encode(self, texts: list[str]) -> Iterator[list[int]]:
        """Ids of each text, no special tokens. Every distinct chunk of ``texts`` is looked up once."""
        cut = list(map(safe_chunks, texts))
        memo, long = self._learn(chain.from_iterable(rest for _, rest in cut))
        for first, rest in cut:
            ids = list(self._chunk(first)) if first else []
            ids.extend(chain.from_iterable(map(memo.__getitem__, rest)))
            yield ids
        for c in long:
            memo.pop(c, None)

    def decode_bytes(self, ids: Iterable[int | None]) -> bytes:
        """Bytes of the ids; a null one has none, one outside the vocabulary is a ValueError."""
        ids = [i for i in ids if i is not None]
        if ids and not (0 <= min(ids) and max(ids) < len(self.bytes_of)):
            raise ValueError(f"ids from {min(ids)} to {max(ids)}, vocabulary of {len(self.bytes_of)}")
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def decode_pieces(self, ids: Iterable[int]) -> list[str]:
        """Text that each id completes: a character split over tokens appears with its last one; broken bytes as U+FFFD."""
        decoder = codecs.getincrementaldecoder("utf-8")("replace")
        out = [decoder.decode(self.bytes_of[i]) for i in ids]
        if rest := decoder.decode(b"", True):
            out.append(rest)
        return out

    def offsets(self, ids: Iterable[int]) -> list[tuple[int, int]]:
        """Code points (start, end) that each token touches; parts of one character share its place."""
        out, heads = [], 0
        for i in ids:
            b = self.bytes_of[i]  # none for a number that the rank file leaves out
            starts = sum(x & 0xC0 != 0x80 for x in b)
            out.append((heads - 1 if b and b[0] & 0xC0 == 0x80 else heads, heads + starts))
            heads += starts
        return out


@cache
def codec(path: str, pattern: str, remembered: int = REMEMBERED) -> Codec:
    return Codec(path, pattern, remembered)


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def encode(docs: DataFrame, path: str, pattern: str, with_offsets: bool = False) -> DataFrame:
    """doc_id and ids (and starts, ends in code points) for each row of ``docs``; null and empty texts have no ids.

    Rows are encoded by themselves: null ids and repeated rows make no difference; an empty table stays empty.
    """
    small_batches(docs.sparkSession)
    rows = _rows(docs)
    names = ["ids", *(["starts", "ends"] if with_offsets else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, kind = codec(path, pattern), pa.list_(pa.int32())
        for batch in batches:
            for part in slices(batch, 1, SLICE_BYTES):
                ids = list(own.encode(part.column(1).to_pylist()))
                columns = [pa.array(ids, kind)]
                if with_offsets:
                    places = [own.offsets(x) for x in ids]
                    columns += [pa.array([[p[k] for p in x] for x in places], kind) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=["doc_id", *names])

    return rows.mapInArrow(lean(run), T.StructType([rows.schema["doc_id"], *(T.StructField(n, T.ArrayType(T.IntegerType())) for n in names)]))


def decode(tokens: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and the decoded bytes for rows of doc_id and ids (a null list, or a null in it: none).

    An id outside the vocabulary fails the job with a ValueError, since its bytes are unknown. An empty table stays empty.
    """
    rows = tokens.select("doc_id", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            back = [own.decode_bytes(ids.as_py() or ()) for ids in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(back, pa.binary())], names=["doc_id", "decoded"])

    return rows.mapInArrow(lean(run), T.StructType([rows.schema["doc_id"], T.StructField("decoded", T.BinaryType())]))


def round_trip(docs: DataFrame, path: str, pattern: str, remembered: int = REMEMBERED) -> DataFrame:
    """Encode and decode in one pass: doc_id, n_tokens, ids_sha256 (of decimal ids joined by commas), decoded_sha256."""
    small_batches(docs.sparkSession)
    rows = _rows(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, sha = codec(path, pattern, remembered), hashlib.sha256
        for batch in batches:
            for part in slices(batch, 1, SLICE_BYTES):
                counts, marks, back = [], [], []
                for ids in own.encode(part.column(1).to_pylist()):
                    counts.append(len(ids))
                    marks.append(sha(",".join(map(own.decimal.__getitem__, ids)).encode()).hexdigest())
                    back.append(sha(b"".join(map(own.bytes_of.__getitem__, ids))).hexdigest())
                columns = [part.column(0), pa.array(counts, pa.int64()), pa.array(marks, pa.string()), pa.array(back, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    schema = T.StructType([rows.schema["doc_id"], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
    return rows.mapInArrow(lean(run), schema)
