"""Chat formatting with relational and array expressions only.

The turns of a conversation are collected as structs and sorted; runs of adjacent turns of one role become one
block, and everything is joined into one string with Spark's array functions. Texts and roles are escaped so that
no control string can occur inside them, and the output can be read back turn by turn.

    <|im_start|>role NEWLINE text [<|im_sep|>text ...]<|im_end|> NEWLINE

Escaping: a backslash is doubled; then ``<|`` becomes ``<\\|``; in roles a line feed becomes ``<\\n|``. Runs of literal
backslashes are even after doubling, so a single one marks an escape and reading back is unambiguous.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Turns whose places are summed together: running sums over a conversation take two levels, so they grow with its turns, not their square.
STEP = 256
START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n"
LEARNED_ROLE = "assistant"


def once(value: Column, use) -> Column:
    """``use`` of a value that is evaluated once, even where ``use`` reads it for each element of an array."""
    return F.get(F.transform(F.array(value), use), 0)


def _chunks(values: Column) -> Column:
    """An array cut into arrays of STEP elements."""
    last = F.floor((F.size(values) - 1) / STEP).cast("int")
    return F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda c: F.slice(values, c * STEP + 1, STEP))


def running(widths: Column) -> Column:
    """Sum of the elements before each element of an array of longs (not null)."""
    zero = F.lit(0).cast("long")
    nothing = F.struct(zero.alias("at"), F.expr("cast(array() as array<bigint>)").alias("all"))
    step = lambda acc, w: F.struct((acc["at"] + w).alias("at"), F.array_append(acc["all"], acc["at"]).alias("all"))
    before = lambda values: F.aggregate(values, nothing, step, lambda acc: acc["all"])

    def over(chunks: Column) -> Column:
        totals = F.transform(chunks, lambda c: F.aggregate(c, zero, lambda acc, w: acc + w))
        return once(before(totals), lambda low: F.flatten(F.transform(chunks, lambda c, i: F.transform(before(c), lambda x: x + F.get(low, i)))))

    return once(widths, lambda w: once(_chunks(w), over))


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("<\\n|"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("<\\n|"), F.lit("\n")))


def format_conversations(turns: DataFrame) -> DataFrame:
    """One row per conv_id: conv_id, n_rows, formatted, loss_spans (array of start, length in code points).

    ``turns`` needs conv_id, turn, role, text; other columns are ignored. A null role or text is an empty one, a
    null turn comes first, a null conv_id is a conversation of its own; turns with equal numbers are ordered by
    role, then text, and repeated rows all stay. ``loss_spans`` covers the escaped text of each assistant turn and
    nothing of the template. An empty table gives an empty result.
    """
    empty = F.lit("")
    rows = turns.select("conv_id", "turn", F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text"))
    sorted_turns = F.sort_array(F.collect_list(F.struct("turn", "role", "text")))
    one = rows.groupBy("conv_id").agg(sorted_turns.alias("turns"))
    escaped = F.transform("turns", lambda t: F.struct(escape_role(t["role"]).alias("role"), escape(t["text"]).alias("text"), (t["role"] == LEARNED_ROLE).alias("learned")))
    one = one.select("conv_id", escaped.alias("turns"))
    role_at = lambda i: F.get("turns", i)["role"]
    starts = F.filter(F.sequence(F.lit(0), F.size("turns") - 1), lambda i: (i == 0) | (role_at(i) != F.coalesce(role_at(i - 1), empty)))
    one = one.withColumn("starts", starts)
    block = lambda s, j: F.slice("turns", s + 1, F.coalesce(F.get("starts", j + 1), F.size("turns")) - s)
    blocks = F.transform("starts", lambda s, j: F.concat(F.lit(START), role_at(s), F.lit("\n"), F.array_join(F.transform(block(s, j), lambda t: t["text"]), SEP), F.lit(END)))
    # Code points before each text: a block's head or a separator; after it: the end mark if the block ends here.
    opens = lambda t, i: F.when((i == 0) | (t["role"] != F.coalesce(role_at(i - 1), empty)), F.length(t["role"]) + len(START) + 1).otherwise(len(SEP)).cast("long")
    closes = lambda t, i: F.when((i == F.size("turns") - 1) | (t["role"] != F.coalesce(role_at(i + 1), empty)), len(END)).otherwise(0).cast("long")
    wide = lambda t: F.length(t["text"]).cast("long")
    one = one.select("conv_id", "turns", F.size("turns").cast("long").alias("n_rows"), F.array_join(blocks, "").alias("formatted"), running(F.transform("turns", lambda t, i: opens(t, i) + wide(t) + closes(t, i))).alias("begins"))
    spans = F.transform("turns", lambda t, i: F.struct(t["learned"].alias("learned"), opens(t, i).alias("start"), wide(t).alias("length")))
    spans = F.zip_with(spans, "begins", lambda s, at: F.struct(s["learned"].alias("learned"), (s["start"] + at).alias("start"), s["length"].alias("length")))
    spans = F.transform(F.filter(spans, lambda s: s["learned"]), lambda s: F.struct(s["start"].alias("start"), s["length"].alias("length")))
    return one.select("conv_id", "n_rows", "formatted", spans.alias("loss_spans"))


def read_back(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of role, text."""
    blocks = F.filter(F.split(formatted, r"<\|im_end\|>\n"), lambda b: b != "")
    head = lambda b: F.substring_index(b, "\n", 1)
    parts = F.transform(
        blocks,
        lambda b: F.struct(
            unescape_role(F.substring(head(b), len(START) + 1, F.length(head(b)))).alias("role"),
            F.split(F.substring(b, F.length(head(b)) + 2, F.length(b)), r"<\|im_sep\|>").alias("texts"),
        ),
    )
    return F.flatten(F.transform(parts, lambda p: F.transform(p["texts"], lambda t: F.struct(p["role"].alias("role"), unescape(t).alias("text")))))


def learned_texts(formatted: Column, loss_spans: Column) -> Column:
    """The texts under the loss mask, unescaped, in order: array of strings.

    Spans are read STEP at a time from their own part of the text, since finding a place in a text means walking to it.
    """
    cut = lambda text, start, length: F.substring(text, (start + 1).cast("int"), length.cast("int"))

    def of_chunk(text: Column, spans: Column) -> Column:
        first, last = F.get(spans, 0)["start"], F.get(spans, F.size(spans) - 1)
        part = cut(text, first, last["start"] + last["length"] - first)
        return once(part, lambda p: F.transform(spans, lambda s: unescape(cut(p, s["start"] - first, s["length"]))))

    each = lambda pair: F.flatten(F.transform(_chunks(pair["spans"]), lambda c: F.when(F.size(c) > 0, of_chunk(pair["text"], c)).otherwise(F.expr("cast(array() as array<string>)"))))
    return once(F.struct(formatted.alias("text"), loss_spans.alias("spans")), each)
