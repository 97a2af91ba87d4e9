"""Putting replacement text back into source: spans by line and column, candidates by indentation, and the one that parses best."""

from __future__ import annotations

import ast
import textwrap
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame

from .localise import indent_of

_DEFINITIONS = {"function": ast.FunctionDef, "async_function": ast.AsyncFunctionDef, "class": ast.ClassDef}
# What opens a suite, and what goes on with one.
SUITES = ("async def ", "def ", "class ", "if ", "elif ", "for ", "while ", "try", "except ", "finally", "with ", "match ", "case ")
BRANCHES = frozenset({"elif", "else", "except", "finally", "case"})


@dataclass(frozen=True)
class Span:
    """Lines from 1, columns from 0, the end excluded; the kind of object where it is known."""

    line: int
    col: int
    end_line: int
    end_col: int
    kind: str = ""


@dataclass(frozen=True)
class Candidate:
    kind: str
    text: str
    updated: str
    error: str | None


def indices(source: str, span: Span) -> tuple[int, int]:
    """Places of a span's ends in the text; ValueError for lines that it hasn't."""
    lines = source.splitlines(keepends=True)
    if not (1 <= span.line <= len(lines) and 1 <= span.end_line <= len(lines)):
        raise ValueError("span outside the source")
    starts = [0]
    for s in lines:
        starts.append(starts[-1] + len(s))
    return starts[span.line - 1] + span.col, starts[span.end_line - 1] + span.end_col


def segment(source: str, span: Span) -> str:
    a, b = indices(source, span)
    return source[a:b]


def spliced(source: str, span: Span, replacement: str) -> str:
    a, b = indices(source, span)
    return source[:a] + replacement + source[b:]


def _parse_error(source: str) -> str | None:
    try:
        ast.parse(source)
    except (SyntaxError, ValueError, RecursionError) as e:
        return str(e) or type(e).__name__
    return None


def _opens_suite(line: str) -> bool:
    head = line.strip()
    return head.endswith(":") and (head[:-1].strip().startswith(SUITES) or head[:-1].strip() == "else")


def normalised(replacement: str, margin: str) -> str:
    """A replacement's lines at the margin; a suite's header at 0 with its body below it, deeper bodies flattened if only that parses."""
    lines = textwrap.dedent(replacement.strip("\n")).splitlines()
    if not lines:
        return ""
    if not _opens_suite(lines[0]):
        return "\n".join(margin + s if s.strip() else "" for s in lines)

    def body(s: str, flat: bool) -> str:
        if not s.strip():
            return ""
        if s.split(None, 1)[0].rstrip(":") in BRANCHES:
            return s.lstrip()
        return s if not flat and s[0] in " \t" else "    " + s.lstrip()

    made = ["\n".join([lines[0], *(body(s, flat) for s in lines[1:])]) for flat in (False, True)]
    return next((m for m in made if _parse_error(m) is None), made[0])


def candidates(replacement: str, margin: str) -> dict[str, str]:
    """Ways to write a replacement into a span at a margin, by kind, without repeats: three texts, each as it is, with its first line bare, and with the margin before the rest."""
    raw = replacement.strip("\n")
    texts = {"raw": raw, "dedented": textwrap.dedent(raw), "fragment_normalized": normalised(replacement, margin)}
    bare = lambda t: "\n".join([s.lstrip() if not i else s for i, s in enumerate(t.splitlines())])
    rest = lambda t: "\n".join([s if not i else margin + s if s.strip() else "" for i, s in enumerate(bare(t).splitlines())])
    named = [*texts.items(), *((f"span_relative_{k}", bare(t)) for k, t in texts.items()), *((f"absolute_continuations_{k}", rest(t)) for k, t in texts.items())]
    out: dict[str, str] = {}
    for kind, text in named:
        if text not in out.values():
            out[kind] = text
    return out


def _spans(source: str, span: Span) -> list[Span]:
    """The span, and that of the least definition around it with its decorators, where that is another."""
    if span.kind and span.kind not in _DEFINITIONS:
        return [span]
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return [span]
    wanted = _DEFINITIONS[span.kind] if span.kind else tuple(_DEFINITIONS.values())
    around = []
    for node in ast.walk(tree):
        if isinstance(node, wanted):
            first = node.decorator_list[0] if node.decorator_list else node
            if first.lineno <= span.line and span.end_line <= node.end_lineno:
                around.append(Span(first.lineno, first.col_offset, node.end_lineno, node.end_col_offset, span.kind))
    least = min(around, key=lambda s: (s.end_line - s.line, s.end_col - s.col), default=span)
    return [span] if indices(source, least) == indices(source, span) else [span, least]


def reattach(source: str, span: Span, replacement: str) -> Candidate:
    """The best of all candidates that parse, else the last that doesn't.

    A definition prefers the span itself, anything else the definition around it; then fewest lines left of the margin, then margins
    before continuations, then the order of candidates.
    """
    definition = textwrap.dedent(replacement.strip("\n")).lstrip().startswith(("def ", "async def ", "class ", "@"))
    best, failed = None, None
    for nth, place in enumerate(_spans(source, span)):
        margin = " " * place.col
        for kind, text in candidates(replacement, margin).items():
            updated = spliced(source, place, text)
            made = Candidate(f"{'ast_expanded' if nth else 'mapped'}:{kind}", text, updated, _parse_error(updated))
            if made.error is not None:
                failed = made
                continue
            escaped = sum(bool(s.strip()) and not s.startswith(margin) for s in text.splitlines()[1:])
            score = (int(definition == (nth == 0)), escaped, int(not kind.startswith("absolute_continuations")), nth)
            if best is None or score < best[0]:
                best = (score, made)
    return best[1] if best else failed


def insert_missing(source: str, parent: Span | None, text: str) -> str:
    """Text behind its parent's last line, indented as the parent's first deeper line is, or at the end of the module; blank lines set it off."""
    lines = source.splitlines()
    margin, at = "", len(lines)
    if parent is not None:
        own = " " * parent.col
        margin, at = next((indent_of(s) for s in lines[parent.line : parent.end_line] if s.strip() and len(indent_of(s)) > len(own)), own + "    "), parent.end_line
    fresh = [margin + s if s.strip() else "" for s in textwrap.dedent(text.strip("\n")).splitlines()]
    above = [""] if at and lines[at - 1].strip() else []
    below = [""] if at < len(lines) and lines[at].strip() else []
    return "\n".join([*lines[:at], *above, *fresh, *below, *lines[at:]]) + "\n"


def reattach_rows(rows: DataFrame, key: str = "key") -> DataFrame:
    """key, kind, updated, parses, error of rows (key, source, line, col, end_line, end_col, kind, replacement), in Arrow batches.

    A null source or replacement is empty; a span outside its source gives a row with kind NULL and the error.
    """
    names = [key, "source", "line", "col", "end_line", "end_col", "kind", "replacement"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            out = []
            for k, source, a, b, c, d, kind, text in frame[names].itertuples(index=False):
                try:
                    made = reattach(source or "", Span(int(a), int(b), int(c), int(d), kind or ""), text or "")
                    out.append((k, made.kind, made.updated, made.error is None, made.error))
                except (ValueError, TypeError) as e:
                    out.append((k, None, source, False, str(e)))
            yield pd.DataFrame(out, columns=[key, "candidate", "updated", "parses", "error"])

    return rows.select(*names).mapInPandas(run, f"{key} {rows.schema[key].dataType.simpleString()}, candidate string, updated string, parses boolean, error string")
