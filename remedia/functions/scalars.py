"""Scalar functions on columns: messages, versions, names, hashes, token estimates."""

from __future__ import annotations

import os
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python versions that the pipeline supports.
SUPPORTED_MINORS = (10, 11, 12, 13, 14, 15)

# Qualname parts that mark an expression's code object inside its parent.
EXPRESSION_PARTS = (".<lambda>", ".<listcomp>", ".<dictcomp>", ".<setcomp>", ".<genexpr>")
SYNTHETIC_LEAF = "__annotate__"

# Word patterns of traceback lines.
ERROR_LINE = r"^\s*(\w+(?:Error|Exception))(?:\s*:\s*(.*))?$"
SORRY_LINE = r"^\s*Sorry:\s*(\w+(?:Error|Exception))\s*:\s*(.*?)\s*\(([^,]+),\s*line\s*(\d+)\)\s*$"
FILE_LINE = r'^\s*File "([^"]+)", line (\d+)'


#: ASCII white space: what a pattern's white space class means.
SPACE = " \t\n\x0b\f\r"


def stripped(text: Column) -> Column:
    """The text without white space at either end."""
    return F.btrim(text, F.lit(SPACE))


def null_if_blank(text: Column) -> Column:
    return F.when(stripped(text) != "", text)


def normalised_cell(text: Column) -> Column:
    """NULL for NULL, blank, and any spelling of nan; else the stripped text."""
    bare = stripped(text.cast("string"))
    return F.when(~F.lower(bare).isin("", "nan"), bare)


def line_number(message: Column) -> Column:
    """Number after "line" in a message, or NULL."""
    found = F.regexp_extract(message, r"line\s+(\d+)", 1)
    return F.when(found != "", found).cast("int")


def clean_message(message: Column) -> Column:
    """Lower-case message without bracketed parts; NULL stays NULL and empty becomes NULL."""
    return F.when(message != "", stripped(F.regexp_replace(stripped(F.lower(message)), r"\(.*?\)", "")))


def first_error(*columns: Column) -> Column:
    """The first of several error columns that isn't blank."""
    return F.coalesce(*(null_if_blank(c) for c in columns))


def initial_error(row_error: Column, probe_compiled: Column, probe_error: Column) -> Column:
    """A row's own error if it names a line, else the compile probe's, else the row's."""
    probed = ~F.coalesce(probe_compiled, F.lit(False)) & (F.coalesce(probe_error, F.lit("")) != "")
    return F.when(line_number(row_error).isNotNull(), row_error).when(probed, probe_error).otherwise(row_error)


def traceback_error(text: Column, sorry: bool = True) -> Column:
    """struct(word, message) of the first error line in a traceback's text; NULL fields if there is none."""
    lines = F.filter(F.split(text, "\n"), lambda s: ~s.rlike(FILE_LINE) & (s.rlike(ERROR_LINE) | (s.rlike(SORRY_LINE) if sorry else F.lit(False))))
    line = F.get(lines, 0)
    plain = line.rlike(ERROR_LINE)
    word = F.when(plain, F.regexp_extract(line, ERROR_LINE, 1)).otherwise(F.regexp_extract(line, SORRY_LINE, 1))
    message = F.when(plain, F.regexp_extract(line, ERROR_LINE, 2)).otherwise(F.regexp_extract(line, SORRY_LINE, 2))
    return F.struct(F.when(line.isNotNull(), word).alias("word"), F.when(line.isNotNull(), stripped(message)).alias("message"))


def version(text: Column) -> Column:
    """struct(major, minor) of a supported version in any of its spellings ("3.1" is 3.10, "312" and "12" are 3.12); else NULL."""
    bare = stripped(text.cast("string"))
    bare = F.when(bare == "3.1", F.lit("3.10")).otherwise(bare)
    parts = F.split(bare, r"\.")
    digits = lambda c: F.when(c.rlike(r"^\d{1,4}$"), c).cast("int")
    dotted, minor = F.size(parts) >= 2, digits(stripped(F.get(parts, 1)))
    short = F.when(bare.rlike(r"^3\d\d$"), digits(F.substring(bare, 2, 2))).when(bare.rlike(r"^\d\d?$"), digits(bare))
    minor = F.when(dotted & (stripped(F.get(parts, 0)) == "3"), minor).when(~dotted, short)
    return F.when(minor.isin(*SUPPORTED_MINORS), F.struct(F.lit(3).alias("major"), minor.alias("minor")))


def version_text(text: Column) -> Column:
    v = version(text)
    return F.when(v.isNotNull(), F.concat_ws(".", v["major"].cast("string"), v["minor"].cast("string")))


def bytecode_version(text: Column) -> Column:
    """The major.minor that a decompiler names in its header comment."""
    found = F.regexp_extract(text, r"(\d+\.\d+)", 1)
    return F.when(found != "", found)


def truthy(value: Column, kind: str) -> Column:
    """Booleans as they are, numbers if above zero, other values if not empty."""
    if kind == "boolean":
        return F.coalesce(value, F.lit(False))
    if kind == "string":
        return F.coalesce(value != "", F.lit(False))
    return F.coalesce(value > 0, F.lit(False))


def kind_set(csv: Column) -> Column:
    """Distinct non-empty parts of a comma-joined string."""
    return F.array_distinct(F.array_remove(F.split(F.coalesce(csv, F.lit("")), ","), ""))


def window_tokens(text: Column) -> Column:
    """Estimate for repair windows: a third of the characters, and out of reach above 40,000."""
    n = F.length(F.coalesce(text, F.lit("")))
    return F.when(n > 40000, F.lit(10**9)).otherwise(F.floor(n / 3.3)).cast("long")


def chunk_tokens(text: Column) -> Column:
    """Estimate for chunks: a quarter of the characters, at least one."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("long")


def replacement_hash(text: Column) -> Column:
    """SHA-256 of the text without white space around it and at line ends."""
    lines = F.transform(F.split(stripped(text), "\n"), lambda s: F.rtrim(s, F.lit(SPACE)))
    return F.sha2(F.array_join(lines, "\n"), 256)


def json_string(text: Column) -> Column:
    """Text as a JSON string of ASCII letters only, as Python's json module writes it: what is beyond ASCII becomes ``\\uXXXX``, in two where needed."""
    unit = lambda code: F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(code)), 4, "0"))
    pair = lambda code: F.concat(unit(F.lit(0xD800) + F.shiftright(code - 0x10000, 10)), unit(F.lit(0xDC00) + (code - 0x10000).bitwiseAND(F.lit(0x3FF))))
    short = {'"': '\\"', "\\": "\\\\", "\n": "\\n", "\r": "\\r", "\t": "\\t", "\f": "\\f", "\b": "\\b"}

    def letter(c: Column) -> Column:
        code = F.ascii(c)
        out = F.when(code > 0xFFFF, pair(code)).when((code < 32) | (code > 126), unit(code)).otherwise(c)
        for plain, escaped in short.items():
            out = F.when(c == F.lit(plain), F.lit(escaped)).otherwise(out)
        return out

    spelled = F.array_join(F.transform(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)), letter), "")
    return F.concat(F.lit('"'), F.when(text.rlike(r"^[ !#-\[\]-~]*$"), text).otherwise(spelled), F.lit('"'))


def case_id(fields: dict[str, Column]) -> Column:
    """SHA-1 of fields as JSON with sorted keys, spelled as Python's json module does: ``", "`` and ``": "``, whole numbers and booleans bare, null for NULL."""
    bare = lambda c: F.typeof(c).isin("tinyint", "smallint", "int", "bigint", "boolean")
    value = lambda c: F.coalesce(F.when(bare(c), c.cast("string")).otherwise(json_string(c.cast("string"))), F.lit("null"))
    members = [F.concat(F.lit(f'"{k}": '), value(fields[k])) for k in sorted(fields)]
    return F.sha1(F.concat(F.lit("{"), F.concat_ws(", ", *members), F.lit("}")).cast("binary"))


def qualname_depth(name: Column) -> Column:
    return F.size(F.split(name, r"\."))


def is_synthetic(name: Column) -> Column:
    return F.coalesce(F.element_at(F.split(name, r"\."), -1) == SYNTHETIC_LEAF, F.lit(False))


def _part_places(name: Column) -> Column:
    return F.filter(F.array(*(F.instr(name, p) for p in EXPRESSION_PARTS)), lambda i: i > 0)


def expression_parent(name: Column) -> Column:
    """What stands before the first expression part of a qualname, or NULL."""
    places = _part_places(name)
    return F.when(F.size(places) > 0, F.substring(name, F.lit(1), F.array_min(places) - 1))


def expression_kind(name: Column) -> Column:
    """lambda, listcomp, ... (the first kind in fixed order that the name contains), or NULL."""
    chain = F.lit(None).cast("string")
    for part in reversed(EXPRESSION_PARTS):
        chain = F.when(F.contains(name, F.lit(part)), F.lit(part.strip(".<>"))).otherwise(chain)
    return chain


def ancestors(name: Column) -> Column:
    """Proper ancestors of a dotted name from its two-segment prefix on; ``<module>`` alone is none."""
    parts = F.split(name, r"\.")
    n = F.size(parts)
    return F.when(n > 2, F.transform(F.sequence(F.lit(2), n - 1), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "."))).otherwise(F.array().cast("array<string>"))


def dedented(text: Column) -> Column:
    """Lines without the least indent of the non-blank ones."""
    lines = F.split(text, "\n")
    indent = lambda s: F.length(s) - F.length(F.ltrim(s))
    least = F.coalesce(F.array_min(F.transform(F.filter(lines, lambda s: stripped(s) != ""), indent)), F.lit(0))
    return F.array_join(F.transform(lines, lambda s: F.when(stripped(s) != "", F.substring(s, least + 1, F.length(s))).otherwise(F.ltrim(s))), "\n")


def truncated_literal(line: Column) -> Column:
    """A line of 80 characters or more with an odd number of quotes and more brackets opened than closed."""
    count = lambda chars: F.length(line) - F.length(F.translate(line, chars, ""))
    odd = count("'\"") % 2 == 1
    return (F.length(line) >= 80) & odd & (count("([{") > count(")]}"))


def jump_direction(gt_target: Column, derived_target: Column) -> Column:
    """Which way a derived jump misses its target: later, earlier, or NULL if it doesn't."""
    return F.when(derived_target > gt_target, "later").when(derived_target < gt_target, "earlier")


def public_keys(m: Column) -> Column:
    """A map without the keys that start with an underscore."""
    return F.map_filter(m, lambda k, _: ~F.startswith(k, F.lit("_")))


def numbered_lines(text: Column, start: int = 1) -> Column:
    lines = F.split(text, "\n")
    return F.array_join(F.transform(lines, lambda s, i: F.concat((i + start).cast("string"), F.lit(": "), s)), "\n")


def unnumbered_lines(text: Column) -> Column:
    return F.array_join(F.transform(F.split(text, "\n"), lambda s: F.regexp_replace(s, r"^\s*\d+: ?", "")), "\n")


def code_fence_removed(text: Column) -> Column:
    """The inside of the first fenced block, or the text itself."""
    inside = F.regexp_extract(text, r"(?s)```[A-Za-z0-9_+-]*\n(.*?)\n?```", 1)
    return F.when(text.rlike(r"(?s)```[A-Za-z0-9_+-]*\n.*?```"), inside).otherwise(text)


def truncated(text: Column, limit: int = 160) -> Column:
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.left(text, F.lit(limit - 3)), F.lit("...")))


def nested(record: Column, path: str, kind: str = "string") -> Column:
    """A field of a variant by dotted path; NULL if any hop is absent or not an object."""
    return F.try_variant_get(record, "$." + path, kind)


def token_threshold(limit: Column) -> Column:
    """Tokens that a prompt may take of a context limit: all but 5,000."""
    return limit - F.lit(5000)


# Marks that a decompiler leaves where it gives up.
SURRENDER = r"<mask_\d+>|<Code\d+ code object>"


def surrendered(text: Column) -> Column:
    return F.coalesce(text.rlike(SURRENDER), F.lit(False))


def misshapen_tokens(line: Column) -> Column:
    """Whether a line has a number with several points, a name that begins with a digit, or a target that can't be one."""
    code = F.coalesce(line, F.lit(""))
    target = stripped(F.substring_index(code, "=", 1))
    odd_target = F.contains(code, F.lit("=")) & (target != "") & target.rlike(r"^\d|[:.]|\d[A-Za-z_:]")
    odd_word = code.rlike(r"\b\d+(?:\.\d+){2,}\b") | code.rlike(r"\b\d[A-Za-z_:][\w:]*\b")
    return (stripped(code) != "") & ~F.startswith(stripped(code), F.lit("#")) & (odd_word | odd_target)


def decompiler_report(stdout: Column) -> Column:
    """struct(rate, rows, failed) of a decompiler's output: the success rate in per cent, and the rows of its box table, all and failed ones."""
    pattern = r"^\s*│\s*(.*?)\s*│\s*(Success|Failure)\s*│\s*(.*?)\s*│\s*$"
    rate = F.regexp_extract(stdout, r"(?i)([0-9]+(?:\.[0-9]+)?)%\s+code object success rate", 1)
    part = lambda s, n: F.regexp_extract(s, pattern, n)
    lines = F.filter(F.split(F.coalesce(stdout, F.lit("")), r"\r\n|\n|\r"), lambda s: s.rlike(pattern))
    rows = F.transform(lines, lambda s: F.struct(part(s, 1).alias("code_object"), part(s, 2).alias("success"), part(s, 3).alias("message")))
    return F.struct(F.when(rate != "", rate).cast("double").alias("rate"), rows.alias("rows"), F.filter(rows, lambda r: r["success"] == "Failure").alias("failed"))


# Long literals, out of the way of whatever reads the text.


def elide_literals(source: str, most: int = 2000) -> tuple[str, dict[str, str]]:
    """The source with string literals of ``most`` characters or more replaced by tokens in the same quotes, and token to literal."""
    found: dict[str, str] = {}

    def swap(m: re.Match) -> str:
        token = f"__PYLLM_PAYLOAD_{len(found)}__"
        found[token] = m[0]
        return m[0][0] + token + m[0][0]

    body = r"(?:[^{q}\\\n]|\\.){{{n},}}"
    return re.sub("|".join(f"{q}{body.format(q=q, n=most)}{q}" for q in ("'", '"')), swap, source or ""), found


def restore_literals(source: str, literals: dict[str, str]) -> tuple[str, bool]:
    """The source with its literals back, and whether all of them are there and no token is left."""
    for token, literal in literals.items():
        source = source.replace(literal[0] + token + literal[0], literal)
    return source, all(literal in source and token not in source for token, literal in literals.items())


# Settings of the driver's environment.


def flag(name: str, default: bool = False) -> bool:
    """An environment variable as a switch: 1, true, yes, y and on are true in any case."""
    value = os.environ.get(name)
    return default if value is None else value.strip().lower() in {"1", "true", "yes", "y", "on"}


def bounded_int(name: str, default: int, least: int, most: int) -> int:
    """An environment variable as a number within bounds; the default where it is no number."""
    try:
        value = int(os.environ.get(name, default))
    except ValueError:
        value = default
    return max(least, min(most, value))
