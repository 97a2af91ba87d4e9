"""Edit-aware token counts.

A document is kept as a segment tree. Its leaves are runs of pre-tokens of about ``LEAF`` code points, cut where encoding surely
starts anew: at a single space between two characters that aren't white space, or, where there is none nearby, between a
letter and a number or between two letters beyond ASCII whose touching bytes no token of the vocabulary holds. Each leaf holds its
length and token count; each inner node the sums below it.

An edit walks down to the leaves it touches, takes neighbouring leaves as boundary context where the cut beside them is no
longer sure, encodes the new text of only those leaves, and puts the new leaves in their place: nodes on the way up are
split where they grow too wide, and their sums updated. So counting again costs as much as the edit is long and
the tree is deep. Only one pre-token without a sure place inside (``====`` or ``aaaa`` of any length) is encoded anew as a whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow_text import lean, slices
from .byte_bpe import load_ranks
from .common import small_batches

LEAF = 256
#: How far beyond LEAF a cut at a space is looked for before any other sure place is taken.
NEARBY = 64
#: Children that the nodes of a new tree have; a node is split when it has twice as many.
WIDTH = 16
SLICE_BYTES = 8 << 20
_CUT = regex.compile(r"(?<=\S) (?=\S)")
_PLACE = regex.compile(r"(?<=\S) (?=\S)|(?<=\p{L})(?=\p{N})|(?<=\p{N})(?=\p{L})|(?<=\p{L})(?=\p{L})")
_LETTER, _NUMBER = regex.compile(r"\p{L}"), regex.compile(r"\p{N}")


class Measure:
    """Counts tokens of one rank file; made once a worker and kept."""

    def __init__(self, path: str, pattern: str) -> None:
        ranks = load_ranks(path)
        self.exact = tiktoken.Encoding("counted", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        #: Pairs of neighbouring bytes that some token holds; no merge crosses any other pair.
        self.touching = frozenset(token[i : i + 2] for token in ranks for i in range(len(token) - 1))

    def count(self, texts: list[str]) -> list[int]:
        return list(map(len, map(self.exact.encode_ordinary, texts)))


@cache
def measure(path: str, pattern: str) -> Measure:
    return Measure(path, pattern)


def sure(own: Measure, left: str, right: str) -> bool:
    """Whether the two texts encode side by side as they do by themselves; False where that can't be told from their ends."""
    if not left or not right:
        return False
    a, b = left[-1], right[0]
    if b == " ":
        return len(right) > 1 and not a.isspace() and not right[1].isspace()
    if _LETTER.match(a) and _LETTER.match(b):
        return a > "\x7f" and b > "\x7f" and a.encode("utf-8", "replace")[-1:] + b.encode("utf-8", "replace")[:1] not in own.touching
    return bool(_LETTER.match(a) and _NUMBER.match(b) or _NUMBER.match(a) and _LETTER.match(b))


def leaves(own: Measure, text: str, size: int = LEAF) -> list[str]:
    """Consecutive parts of the text, cut only at sure places, each at least ``size`` long but the last."""
    out, at = [], 0
    while len(text) - at > size:
        if cut := _CUT.search(text, at + size, at + size + NEARBY):
            end = cut.start()
        else:
            end = next((m.start() for m in _PLACE.finditer(text, at + size) if m.end() > m.start() or sure(own, text[m.start() - 1], text[m.start()])), None)
        if end is None:
            break
        out.append(text[at:end])
        at = end
    return [*out, text[at:]] if at < len(text) or not out else out


class Node:
    """A leaf (``text``) or an inner node (``kids``), with the leaves, code points and tokens below it."""

    __slots__ = ("text", "kids", "leaves", "chars", "tokens")

    def __init__(self, text: str | None, kids: list[Node], chars: int, tokens: int) -> None:
        self.text, self.kids, self.chars, self.tokens = text, kids, chars, tokens
        self.leaves = sum(k.leaves for k in kids) if text is None else 1


def _over(kids: list[Node]) -> Node:
    return Node(None, kids, sum(k.chars for k in kids), sum(k.tokens for k in kids))


def _gathered(nodes: list[Node]) -> list[Node]:
    """One level above: a single node if it is not too wide, else nodes of WIDTH children or more."""
    if len(nodes) <= 2 * WIDTH:
        return [_over(nodes)] if nodes else []
    cuts = range(0, len(nodes) - WIDTH + 1, WIDTH)
    return [_over(nodes[c : c + WIDTH] if c != cuts[-1] else nodes[c:]) for c in cuts]


def _spliced(node: Node, low: int, high: int, fresh: list[Node]) -> list[Node]:
    """What takes the place of ``node`` when its leaves ``low`` to ``high`` (at least one) give way to ``fresh``."""
    if node.text is not None:
        return fresh
    before, first = 0, 0
    while before + node.kids[first].leaves <= low:
        before += node.kids[first].leaves
        first += 1
    after, last, put = before, first, []
    while True:
        kid = node.kids[last]
        put += _spliced(kid, max(low - after, 0), min(high - after, kid.leaves), fresh if last == first else [])
        after += kid.leaves
        if after >= high:
            break
        last += 1
    return _gathered(node.kids[:first] + put + node.kids[last + 1 :])


class Tree:
    """Segment tree over the leaves of a text."""

    def __init__(self, parts: list[str], counts: list[int]) -> None:
        self.encoded = 0
        self._set([Node(p, [], len(p), n) for p, n in zip(parts, counts)])

    def _set(self, nodes: list[Node]) -> None:
        nodes = nodes or [Node("", [], 0, 0)]
        while len(nodes) > 1:
            nodes = _gathered(nodes)
        self.root = nodes[0]
        while len(self.root.kids) == 1:
            self.root = self.root.kids[0]

    @property
    def total(self) -> int:
        return self.root.tokens

    @property
    def length(self) -> int:
        return self.root.chars

    @property
    def parts(self) -> list[str]:
        walk = lambda node: [node.text] if node.text is not None else [t for k in node.kids for t in walk(k)]
        return walk(self.root)

    def find(self, place: int) -> tuple[int, int]:
        """Number of the leaf that holds the character at ``place``, and the place within it (the last leaf holds the end)."""
        node, nth = self.root, 0
        while node.text is None:
            for kid in node.kids[:-1]:
                if place < kid.chars:
                    break
                place -= kid.chars
                nth += kid.leaves
            else:
                kid = node.kids[-1]
            node = kid
        return nth, place

    def leaf(self, nth: int) -> str:
        node = self.root
        while node.text is None:
            for kid in node.kids:
                if nth < kid.leaves:
                    break
                nth -= kid.leaves
            node = kid
        return node.text

    def edit(self, own: Measure, start: int, deleted: int, inserted: str) -> None:
        """Replace ``deleted`` characters from ``start`` (both cut to the text) and count again what the edit can change."""
        start = min(max(start, 0), self.length)
        end = min(start + max(deleted, 0), self.length)
        (low, a), (last, b) = self.find(start), self.find(end)
        text, high, most = self.leaf(low)[:a] + inserted + self.leaf(last)[b:], last + 1, self.root.leaves
        while high < most and not sure(own, text, right := self.leaf(high)):
            text, high = text + right, high + 1
        while low > 0 and not sure(own, left := self.leaf(low - 1), text):
            text, low = left + text, low - 1
        fresh = leaves(own, text) if text else []
        self.encoded += len(text)
        self._set(_spliced(self.root, low, high, [Node(p, [], len(p), n) for p, n in zip(fresh, own.count(fresh))]))


def build(own: Measure, texts: list[str]) -> list[Tree]:
    """Trees of many texts, whose leaves are encoded together."""
    split = [leaves(own, t) for t in texts]
    counts = iter(own.count([p for parts in split for p in parts]))
    return [Tree(parts, [next(counts) for _ in parts]) for parts in split]


_SCHEMA = "n_chars long, n_tokens long, n_leaves long, n_edits long, n_chars_after long, n_tokens_after long, chars_reencoded long"


def count_with_edits(docs: DataFrame, edits: DataFrame, path: str, pattern: str) -> DataFrame:
    """Token counts of every document before and after its edits.

    ``docs`` has doc_id, text; ``edits`` has doc_id, seq, start, deleted, inserted, applied in order of seq, each to the
    text that the one before left. Returns doc_id, n_chars, n_tokens, n_leaves, n_edits, n_chars_after, n_tokens_after and
    chars_reencoded (text that was encoded for the edits) for each row of ``docs``. A null text is empty; places
    beyond the text are cut to it; a null place is 0, a null insertion empty; edits of unknown or null documents have
    no effect; repeated documents take the same edits each. An empty table gives an empty result.
    """
    edit = F.struct("seq", F.coalesce("start", F.lit(0)).cast("long").alias("start"), F.coalesce("deleted", F.lit(0)).cast("long").alias("deleted"), F.coalesce("inserted", F.lit("")).alias("inserted"))
    lists = edits.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("_id")).agg(F.sort_array(F.collect_list(edit)).alias("edits"))
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    rows = docs.select("doc_id", text).join(lists, F.col("doc_id") == F.col("_id"), "left").select("doc_id", "text", "edits")
    return count_rows(rows, path, pattern)


def count_rows(rows: DataFrame, path: str, pattern: str) -> DataFrame:
    """As :func:`count_with_edits`, for rows of doc_id, text and edits (array of seq, start, deleted, inserted)."""
    small_batches(rows.sparkSession)
    names = [f.split()[0] for f in _SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = measure(path, pattern)
        for batch in batches:
            for part in slices(batch, 1, SLICE_BYTES):
                out = []
                for tree, edits in zip(build(own, part.column(1).to_pylist()), part.column(2).to_pylist()):
                    before = (tree.length, tree.total, tree.root.leaves, len(edits or ()))
                    for e in edits or ():
                        tree.edit(own, e["start"], e["deleted"], e["inserted"])
                    out.append((*before, tree.length, tree.total, tree.encoded))
                columns = [pa.array(c, pa.int64()) for c in zip(*out)] if out else [pa.array([], pa.int64())] * len(names)
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=["doc_id", *names])

    schema = T.StructType([rows.schema["doc_id"]])
    for field_ in _SCHEMA.split(", "):
        schema = schema.add(*field_.split())
    return rows.mapInArrow(lean(run), schema)
