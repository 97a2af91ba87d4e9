"""Quality rules: base word and line counts, and zstandard compression bands.

A text is compressed as a whole and in fixed chunks. Repetitive text compresses too well and random text not at all;
how well ordinary prose compresses depends on length, so each length has limits of its own. A text is rejected if its
ratio (compressed / raw bytes) is outside its band, or if more than ``MAX_BAD_CHUNKS`` of its chunks are outside theirs.
Each document is judged by itself, in Arrow batches, without any shuffle.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow_text import lean
from .common import small_batches

LEVEL = 3
#: (at least so many bytes, lowest ratio, highest ratio). Frames have a fixed cost, so short texts may exceed 1.
#: Highest ratios are a margin over ordinary prose of that length. Random letters and digits are above them from 176 bytes on (most of
#: them from 128), random lower-case letters from 1,536 on; shorter ones are not told from prose.
BANDS = [
    (0, 0.20, 1e9), (64, 0.25, 1.50), (128, 0.25, 0.955), (144, 0.25, 0.94), (176, 0.25, 0.91), (192, 0.25, 0.88), (208, 0.25, 0.87), (224, 0.25, 0.85), (256, 0.30, 0.82), (384, 0.30, 0.77),
    (512, 0.30, 0.72), (1024, 0.25, 0.62), (1536, 0.25, 0.59), (2048, 0.25, 0.58), (4096, 0.20, 0.54), (16384, 0.16, 0.50), (65536, 0.14, 0.50),
]
CHUNK = 4096
#: A last chunk shorter than this is judged together with the one before.
CHUNK_LEAST = 1024
#: The lowest ratio of a chunk; the highest is that of a text of its length.
CHUNK_LOW = 0.20
MAX_BAD_CHUNKS = 0.25
WINDOW = 5
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20
_SYMBOLS = b"#*$%&|<>"
#: ASCII separators and UTF-8 continuation bytes: what is left of a text without them is one byte per code point in words.
_NOT_HEADS = b" \t\n\x0b\x0c\r" + bytes(range(0x80, 0xC0))
#: Texts with more words count windows in arrays rather than in a dict, which keeps their memory small.
_MANY_WORDS = 100_000


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words covered by windows that occur at least twice, first occurrences included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    if len(words) > _MANY_WORDS:
        number: dict[bytes, int] = {}
        ids = np.array([number.setdefault(w, len(number)) for w in words], dtype=np.int64)
        same = ids[:n]
        for i in range(1, window):
            _, same = np.unique(same * len(number) + ids[i : i + n], return_inverse=True)
        starts = np.flatnonzero(np.bincount(same)[same] > 1)
    else:
        windows = list(zip(*(words[i:] for i in range(window))))
        if len(set(windows)) == n:
            return 0
        counts = Counter(windows)
        starts = np.array([i for i, w in enumerate(windows) if counts[w] > 1])
    covered = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(covered, starts, 1)
    np.add.at(covered, starts + window, -1)
    return int((np.cumsum(covered) > 0).sum())


def base_counts(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of UTF-8 bytes."""
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    return (len(words), len(text.translate(None, _NOT_HEADS)), len(text) - len(text.translate(None, _SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words))


def chunks(text: bytes) -> list[bytes]:
    """Fixed chunks that together are the whole text."""
    cuts = list(range(0, len(text), CHUNK))
    if len(cuts) > 1 and len(text) - cuts[-1] < CHUNK_LEAST:
        cuts.pop()
    return [text[a:b] for a, b in zip(cuts, [*cuts[1:], len(text)])]


def band(n: int) -> tuple[float, float]:
    """Lowest and highest ratio of a text of ``n`` bytes."""
    return BANDS[bisect_right(BANDS, (n, 2e9, 2e9)) - 1][1:]


def compression(text: bytes, packer: zstandard.ZstdCompressor) -> tuple[float, int, int, int, bool]:
    """Whole ratio, chunks, chunks too low, chunks too high, verdict. An empty text has ratio 0 and passes."""
    if not text:
        return 0.0, 0, 0, 0, True
    ratio = len(packer.compress(text)) / len(text)
    low, high = band(len(text))
    parts = chunks(text) if len(text) > CHUNK + CHUNK_LEAST else []
    each = [len(packer.compress(c)) / len(c) for c in parts]
    too_low, too_high = sum(r < CHUNK_LOW for r in each), sum(r > band(len(c))[1] for r, c in zip(each, parts))
    return ratio, len(each), too_low, too_high, low <= ratio <= high and too_low + too_high <= MAX_BAD_CHUNKS * len(each)


_SCHEMA = [
    ("n_words", "long"), ("word_chars", "long"), ("n_symbols", "long"), ("n_dup_lines", "long"), ("n_repeat_words", "long"), ("base_failed", "boolean"), ("kept", "boolean"),
    ("ratio", "double"), ("n_chunks", "long"), ("n_chunks_low", "long"), ("n_chunks_high", "long"),
]


def judge(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (columns doc_id, text; others are ignored): counts, ratios, base_failed, kept.

    A null or empty text has no words, so it fails the base rule and is not kept. Rows are judged by themselves:
    null ids and repeated rows make no difference, and an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=LEVEL)
        kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] + [pa.int64()] * 3
        for batch in batches:
            rows = []
            for text in batch.column(1).cast(pa.binary()):
                text = text.as_py() or b""
                counts = base_counts(text)
                ratio, n, low, high, good = compression(text, packer)
                failed = counts[0] < MIN_WORDS or 100 * counts[4] > MAX_REPEAT_PERCENT * counts[0]
                rows.append((*counts, failed, good and not failed, ratio, n, low, high))
            columns = zip(*rows) if rows else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=["doc_id", *(n for n, _ in _SCHEMA)])

    small_batches(docs.sparkSession)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    schema = T.StructType([rows.schema["doc_id"]])
    for name, kind in _SCHEMA:
        schema = schema.add(name, kind)
    return rows.mapInArrow(lean(run), schema)
