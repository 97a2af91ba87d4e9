"""Repair windows in source text, token budgets, and packing into chunks."""

from __future__ import annotations

import ast
import io
import re
import tokenize
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame

#: Code objects longer than this are not taken whole.
OBJECT_LINES = 400

_HEADER = re.compile(r"\s*(?:async\s+def|def|class)\s+[A-Za-z_]\w*")
_TOP = re.compile(r"(?:@|async\s+def\b|def\b|class\b)")
_IMPORT = re.compile(r"(?:import|from)\b")
_PAIRS = {")": "(", "]": "[", "}": "{"}


@dataclass(frozen=True)
class Window:
    text: str
    start: int
    end: int
    indent: str


def indent_of(line: str) -> str:
    return line[: len(line) - len(line.lstrip(" \t"))]


def scan(line: str, quote: str = "", depth: int = 0) -> tuple[str, int]:
    """Open quote and bracket depth after a line, given those before it; comments are skipped, single quotes end with the line."""
    i = 0
    while i < len(line):
        c = line[i]
        if quote:
            if c == "\\":
                i += 1
            elif line.startswith(quote, i):
                i += len(quote) - 1
                quote = ""
        elif c == "#":
            break
        elif c in "'\"":
            quote = c * 3 if line.startswith(c * 3, i) else c
            i += len(quote) - 1
        elif c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
        i += 1
    return (quote if len(quote) == 3 else ""), depth


def _window(lines: list[str], start: int, end: int) -> Window:
    part = lines[start - 1 : end]
    margins = [indent_of(s) for s in part if s.strip()]
    margin = min(margins, key=len, default="")
    return Window("".join(s[len(margin) :] if s.strip() else s for s in part), start, end, margin)


def _previous(lines: list[str], line: int) -> int:
    """Number of the last non-blank line before ``line``, or ``line``."""
    return next((k for k in range(line - 1, 0, -1) if lines[k - 1].strip()), line)


def _balanced_end(lines: list[str], start: int) -> int:
    """Last line of the statement that opens at ``start``, by its brackets."""
    margin, end = len(indent_of(lines[start - 1])), start
    quote, depth = scan(lines[start - 1])
    while end < len(lines) and depth > 0:
        following = lines[end]
        closing = not following.strip(" \t\r\n)]},:")
        if not closing and len(indent_of(following)) <= margin:
            break
        quote, depth = scan(following, quote, depth)
        end += 1
    return end


def minimal_window(source: str, line: int | None, expansion: int = 0) -> Window:
    """The statement at a line; each expansion widens to the block around it, or does nothing at the top level."""
    lines = source.splitlines(keepends=True)
    if not lines:
        return Window("", 1, 1, "")
    start = min(max(line or 1, 1), len(lines))
    end = _balanced_end(lines, start)
    for _ in range(expansion):
        margin = len(indent_of(lines[start - 1]))
        above = next((k for k in range(start - 1, 0, -1) if lines[k - 1].strip() and len(indent_of(lines[k - 1])) < margin), None)
        if above is None or not lines[above - 1].rstrip().endswith(":"):
            continue
        start = above
        while end < len(lines) and (not lines[end].strip() or len(indent_of(lines[end])) >= margin):
            end += 1
    return _window(lines, start, end)


def _statement_start(lines: list[str], line: int) -> int:
    """First line of the statement that a line continues, by open brackets above it."""
    best, quote, depth, opened = line, "", 0, line
    for k in range(1, line):
        if depth <= 0 and not quote:
            opened = k
        quote, depth = scan(lines[k - 1], quote, max(depth, 0))
    return opened if depth > 0 or quote else best


def cause(source: str, line: int | None, message: str | None) -> tuple[int, str]:
    """The line that an error is likely caused at, and why."""
    lines = source.splitlines(keepends=True)
    n, low = len(lines), (message or "").lower()
    at = min(max(line or 1, 1), max(n, 1))
    text = lines[at - 1].strip() if n else ""
    leaked = "<generic parameters of" in text
    if n and (leaked or _HEADER.match(text)):
        opener = _statement_start(lines, at)
        if opener < at:
            return opener, "unclosed_delimiter_above"
        return at, "pep695_generic_leak" if leaked else "def_header"
    if not n:
        return at, "reported_line"
    if "unexpected indent" in low:
        return _previous(lines, at), "unexpected_indent_prev_line"
    if "expected an indented block" in low:
        named = re.search(r"line\s+(\d+)", low)
        return (min(max(int(named[1]), 1), n) if named else _previous(lines, at)), "empty_block_header"
    if "was never closed" in low or "unterminated" in low:
        return at, "unclosed_delimiter"
    if "unindent does not match" in low:
        margin = len(indent_of(lines[at - 1]))
        return next((k for k in range(at - 1, 0, -1) if lines[k - 1].strip() and len(indent_of(lines[k - 1])) < margin), at), "unindent_mismatch"
    if "invalid syntax" in low or "perhaps you forgot a comma" in low:
        return _statement_start(lines, at), "mid_statement"
    return at, "reported_line"


_SPANNING = ("unclosed_delimiter_above", "unclosed_delimiter", "mid_statement")


def cause_window(source: str, line: int | None, message: str | None, expansion: int = 0) -> Window:
    """The minimal window, stretched up to the cause but not out of the definition it is in."""
    lines = source.splitlines(keepends=True)
    base = minimal_window(source, line, expansion)
    if not lines:
        return base
    anchor, why = cause(source, line, message)
    start, end = min(base.start, max(1, min(anchor, len(lines)))), base.end
    if why in _SPANNING:
        start = min(start, _statement_start(lines, start))
    span = object_span(lines, min(max(line or start, 1), len(lines)))
    start = max(start, min(span[0] + 1 if span else 1, base.start))
    if why in ("pep695_generic_leak", "def_header"):
        while start > 1 and lines[start - 2].lstrip().startswith("@"):
            start -= 1
    if why == "unclosed_delimiter_above":
        end = max(end, _balanced_end(lines, start))
    return _window(lines, start, end)


def _header_above(lines: list[str], line: int, margin: int) -> int | None:
    """The nearest shallower definition header whose body reaches ``line``."""
    least = margin
    for k in range(line - 1, 0, -1):
        text = lines[k - 1]
        if text.strip() and len(indent_of(text)) < least:
            if _HEADER.match(text):
                return k
            least = len(indent_of(text))
    return None


def _body_end(lines: list[str], header: int) -> int:
    margin, end, k = len(indent_of(lines[header - 1])), header, header
    while k < len(lines) and (not lines[k].strip() or len(indent_of(lines[k])) > margin):
        k += 1
        end = k
    return end


def object_span(lines: list[str], line: int) -> tuple[int, int] | None:
    """First and last line of the innermost definition around a line."""
    if not 1 <= line <= len(lines):
        return None
    at = line if lines[line - 1].strip() else _previous(lines, line)
    if not lines[at - 1].strip():
        return None
    header = _header_above(lines, at, len(indent_of(lines[at - 1])))
    return None if header is None else (header, _body_end(lines, header))


def object_window(source: str, line: int | None, message: str | None, expansion: int = 0) -> Window:
    """The definition around a line, or ``expansion`` definitions further out; the cause window if there is none or it is long."""
    lines = source.splitlines(keepends=True)
    span = object_span(lines, min(max(line or 1, 1), max(len(lines), 1)))
    for _ in range(expansion if span else 0):
        outer = _header_above(lines, span[0], len(indent_of(lines[span[0] - 1])))
        if outer is None:
            break
        span = (outer, _body_end(lines, outer))
    if span is None or span[1] - span[0] + 1 > OBJECT_LINES:
        return cause_window(source, line, message, expansion)
    return _window(lines, *span)


def reattach(source: str, window: Window, fixed: str) -> str:
    """The source with a window's lines replaced, indented as they were."""
    lines = source.splitlines(keepends=True)
    body = "\n".join(window.indent + s if s.strip() else s for s in fixed.splitlines())
    newline = "\n" if source.endswith("\n") or window.end < len(lines) else ""
    return "".join(lines[: window.start - 1]) + body + newline + "".join(lines[window.end :])


def roles(n: int) -> list[str]:
    """Begin, inside and end marks of a segment's lines."""
    return [] if n <= 0 else ["B/E"] if n == 1 else ["B", *["I"] * (n - 2), "E"]


def clamp(lines: list[str], at: int, budget: int, count: Callable[[str], int]) -> tuple[int, int] | None:
    """Lines [start, end) around ``at`` within a token budget: all if they fit, else grown up and down in turn until a line doesn't fit."""
    if not lines:
        return None
    at = max(0, min(at, len(lines) - 1))
    if budget <= 0 or count("".join(lines)) <= budget:
        return 0, len(lines)
    left = budget - count(lines[at])
    if left < 0:
        return None
    start, end, up = at, at + 1, True
    while start > 0 or end < len(lines):
        up = (up and start > 0) or end == len(lines)
        left -= count(lines[start - 1] if up else lines[end])
        if left < 0:
            break
        start, end = (start - 1, end) if up else (start, end + 1)
        up = not up
    return start, end


def window_tokens(text: str) -> int:
    return 10**9 if len(text) > 40000 else int(len(text) / 3.3)


def clamp_windows(rows: DataFrame, budget: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_lines, start, end of the window around each text's middle line; NULL where that line alone is too long."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            out = []
            for k, t in zip(frame[key], frame[text]):
                lines = (t or "").splitlines(keepends=True)
                out.append((k, len(lines), *(clamp(lines, len(lines) // 2, budget, window_tokens) or (None, None))))
            yield pd.DataFrame(out, columns=[key, "n_lines", "start", "end"]).astype({"start": "Int64", "end": "Int64"})

    return rows.select(key, text).mapInPandas(run, f"{key} {rows.schema[key].dataType.simpleString()}, n_lines long, start long, end long")


def top_level_objects(source: str) -> list[tuple[str, str]]:
    """(kind, text) of imports, functions, classes and other top-level code, which join to the source from its first non-blank line on."""
    lines = source.splitlines(keepends=True)
    starts: list[tuple[int, str]] = []
    quote, depth, decorated = "", 0, False
    for k, s in enumerate(lines):
        top = bool(s.strip()) and not indent_of(s) and depth <= 0 and not quote
        if top and _IMPORT.match(s):
            if not starts or starts[-1][1] != "imports":
                starts.append((k, "imports"))
            decorated = False
        elif top and _TOP.match(s):
            kind = "decorated" if s.startswith("@") else "class" if s.startswith("class") else "function"
            if decorated:
                starts[-1] = (starts[-1][0], kind)
            else:
                starts.append((k, kind))
            decorated = kind == "decorated"
        elif s.strip() and (not starts or (top and starts[-1][1] == "imports")):
            starts.append((k, "global"))
        quote, depth = scan(s, quote, max(depth, 0))
    ends = [k for k, _ in starts[1:]] + [len(lines)]
    return [(kind, "".join(lines[a:b])) for (a, kind), b in zip(starts, ends)]


def pack(parts: list[str], budget: int, count: Callable[[str], int]) -> list[str]:
    """Parts joined in order into chunks within a budget; a part that is too large is a chunk of its own."""
    out: list[str] = []
    sizes: list[int] = []
    for p in parts:
        n = count(p)
        if out and sizes[-1] + n <= budget:
            out[-1] += p
            sizes[-1] += n
        else:
            out.append(p)
            sizes.append(n)
    merged = out[:1]
    for chunk in out[1:]:
        if count(merged[-1] + chunk) <= budget:
            merged[-1] += chunk
        else:
            merged.append(chunk)
    return merged


def chunk_tokens(text: str) -> int:
    return max(1, len(text) // 4)


def pack_chunks(rows: DataFrame, budget: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, chunk, text, tokens: each text's lines packed into chunks, in order."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            out = []
            for k, t in zip(frame[key], frame[text]):
                out += [(k, i, c, chunk_tokens(c)) for i, c in enumerate(pack((t or "").splitlines(keepends=True), budget, chunk_tokens))]
            yield pd.DataFrame(out, columns=[key, "chunk", "text", "tokens"])

    return rows.select(key, text).mapInPandas(run, f"{key} {rows.schema[key].dataType.simpleString()}, chunk long, text string, tokens long")


# Context by strategy: what the error's words suggest, tried in order and wider each time.

# Words that make whole blocks the better context, and the number of wider tries.
BLOCK_WORDS = (
    "indentationerror", "expected an indented block", "unexpected indent", "unindent does not match", "expected ':'", "unexpected eof", "was never closed", "unterminated", "f-string",
    "single '}' is not allowed", "expecting '}'", "unmatched ')'", "unmatched ']'", "unmatched '}'",
)
DELIMITER_WORDS = ("unexpected eof", "was never closed", "unterminated", "f-string", "single '}' is not allowed", "expecting '}'", "unmatched ')'", "unmatched ']'", "unmatched '}'")
INDENT_WORDS = ("indentationerror", "expected an indented block", "unexpected indent", "unindent does not match", "expected ':'")
NUMERIC_WORDS = ("invalid decimal literal",)
WIDER, UPWARD = 3, 100
_DEFINITION = re.compile(r"\s*(?:async\s+def|def|class)\b")


def strategy_order(message: str | None) -> tuple[str, ...]:
    """Strategies in the order in which a message calls for them."""
    low = (message or "").lower()
    blocks = any(w in low for w in BLOCK_WORDS)
    if any(w in low for w in DELIMITER_WORDS):
        return ("delimiter", "block", "line") if blocks else ("delimiter", "line", "block")
    if any(w in low for w in INDENT_WORDS):
        return ("block", "line", "delimiter") if blocks else ("line", "block", "delimiter")
    if any(w in low for w in NUMERIC_WORDS):
        return ("line", "delimiter", "block")
    return ("block", "line", "delimiter") if blocks else ("line", "block", "delimiter")


def _margin(line: str) -> int:
    return len(line) - len(line.lstrip(" "))


def _line_context(lines: list[str], at: int, extra: int) -> tuple[int, int]:
    """The function or class around a line, else the run between lines at the margin, with up to UPWARD lines above it."""
    head = next((k for k in range(at, -1, -1) if lines[k].strip() and _margin(lines[k]) < _margin(lines[at]) and _DEFINITION.match(lines[k])), None)
    if head is not None:
        end = next((k for k in range(head + 1, len(lines)) if lines[k].strip() and _margin(lines[k]) <= _margin(lines[head])), len(lines))
        return head, end - 1
    top = lambda k: bool(lines[k].strip()) and not _margin(lines[k])
    start = next((k for k in range(at, -1, -1) if top(k)), at)
    end = next((k for k in range(start + 1, len(lines)) if top(k)), len(lines)) - 1
    return max(0, start - UPWARD - extra), min(len(lines) - 1, end + extra)


def _block_context(lines: list[str], at: int, extra: int) -> tuple[int, int]:
    """From the last definition or decorator above a line (at the margin for a line at the margin) to the next one at the margin."""
    inside, quote = [], ""
    for s in lines:
        for mark in ('"""', "'''"):
            if s.strip().count(mark) % 2 and quote in ("", mark):
                quote = "" if quote else mark
        inside.append(bool(quote))
    anchor = lambda k: not inside[k] and (lines[k].lstrip().startswith("@") or bool(_DEFINITION.match(lines[k])))
    top = lambda k: anchor(k) and not _margin(lines[k])
    deep = _margin(lines[at]) > 0
    start = next((k for k in range(at if deep else at - 1, -1, -1) if (anchor(k) if deep else top(k))), 0)
    end = next((k for k in range(at + 1, len(lines)) if top(k)), len(lines)) - 1
    return max(0, start - extra), min(len(lines) - 1, end + extra)


def _delimiter_context(lines: list[str], at: int, message: str | None, extra: int) -> tuple[int, int] | None:
    """Around a closer that matches nothing; from an open quote to the error; or from the bracket that is open to the next block at the margin."""
    stack: list[tuple[str, int]] = []
    issue, closer = "", 0
    try:
        for token in tokenize.generate_tokens(io.StringIO("\n".join(lines)).readline):
            if token.type == tokenize.OP and token.string in "([{":
                stack.append((token.string, token.start[0]))
            elif token.type == tokenize.OP and token.string in ")]}":
                if not stack or stack[-1][0] + token.string not in ("()", "[]", "{}"):
                    issue, closer = "closer", token.start[0]
                    break
                stack.pop()
    except (tokenize.TokenError, SyntaxError) as e:
        issue = "open" if "multi-line" in str(e).lower() else ""
    low, last = (message or "").lower(), len(lines) - 1
    if not issue and any(w in low for w in ("f-string", "expecting '}'", "single '}' is not allowed", "unexpected eof", "was never closed", "unterminated")):
        issue = "open"
    if issue == "closer":
        return max(0, closer - 3 - extra), min(last, closer + 1 + extra)
    if issue == "open":
        marks = ('f"', "f'", 'F"', "F'", '"', "'") if "f-string" in low else ('"', "'")
        quoted = next((k for k in range(min(at, last), -1, -1) if any(m in lines[k] for m in marks)), None)
        if quoted is not None:
            return max(0, quoted - extra), min(last, max(at + 1, quoted + 1) + 1 + extra)
    if not stack:
        return None
    start = max(0, next((n for _, n in reversed(stack) if n <= at + 1), stack[-1][1]) - 1 - extra)
    end = next((k for k in range(at + 1, len(lines)) if lines[k].strip() and not _margin(lines[k]) and lines[k].rstrip().endswith(":")), len(lines)) - 1
    return start, min(last, (end if end >= start else last) + extra)


def context(source: str, line: int | None, message: str | None = None, expansion: int = 0) -> Window | None:
    """The first context that parses by itself, by strategy and then wider; else the one of fewest lines. None without lines or for a line that the source hasn't."""
    lines = source.splitlines()
    if line is None or not 1 <= line <= len(lines):
        return None
    best: Window | None = None
    for extra in range(max(0, expansion), max(0, expansion) + WIDER + 1):
        for strategy in strategy_order(message):
            if strategy == "delimiter":
                span = _delimiter_context(lines, line - 1, message, extra)
            else:
                span = (_block_context if strategy == "block" else _line_context)(lines, line - 1, extra)
            if span is None:
                continue
            found = _window([s + "\n" for s in lines], span[0] + 1, span[1] + 1)
            try:
                ast.parse(found.text)
                return found
            except (SyntaxError, ValueError, RecursionError):
                if best is None or found.end - found.start < best.end - best.start:
                    best = found
    return best


def contexts(rows: DataFrame, key: str, source: str, line: str, message: str) -> DataFrame:
    """key, start, end, text, indent, strategies of the context of each row's error; NULL where there is none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            out = []
            for k, text, at, said in zip(frame[key], frame[source], frame[line], frame[message]):
                found = context(text or "", None if pd.isna(at) else int(at), said)
                out.append((k, *((found.start, found.end, found.text, found.indent) if found else (None,) * 4), ",".join(strategy_order(said))))
            yield pd.DataFrame(out, columns=[key, "start", "end", "text", "indent", "strategies"]).astype({"start": "Int64", "end": "Int64"})

    return rows.select(key, source, line, message).mapInPandas(run, f"{key} {rows.schema[key].dataType.simpleString()}, start long, end long, text string, indent string, strategies string")
