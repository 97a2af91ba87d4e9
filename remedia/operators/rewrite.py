"""Compile-gated rewriting of source that doesn't parse: operators, registries, and the cascade as one Arrow UDF.

Every operator maps a source and its first error to a new source, or None. An operator's result counts only if the
gate accepts it, so operators may guess; the gate is a parameter, by default the worker's own compiler.
"""

from __future__ import annotations

import ast
import keyword
import re
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .localise import indent_of, minimal_window, reattach, scan

Operator = Callable[[str, SyntaxError | None], str | None]
#: The compile oracle: a source's first error, or None. Any callable will do, such as one that asks another version's compiler.
Gate = Callable[[str], SyntaxError | None]

_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}"}, {")": "(", "]": "[", "}": "{"}
_STRING = re.compile(r"'([^'\\]*(?:\\.[^'\\]*)*)'|\"([^\"\\]*(?:\\.[^\"\\]*)*)\"")
_CLAUSE = re.compile(r"(elif\b.*|else\s*|except\b.*|finally\s*):")
_HANDLER = re.compile(r"(except\b.*|finally\s*):")
#: Words that start statements without being reserved.
_SOFT_WORDS = ("match", "case", "type", "print", "exec")
_STATEMENT = re.compile(r"(?:if|for|while|with|try|def|class|return|raise|import|from|async|del|assert|global|nonlocal|pass|break|continue|yield|lambda|print)\b")


def syntax_error(source: str) -> SyntaxError | None:
    """The first error, or None if the source compiles."""
    try:
        compile(source, "<source>", "exec", dont_inherit=True)
    except SyntaxError as e:
        return e
    except (ValueError, RecursionError, MemoryError, OverflowError) as e:
        return SyntaxError(str(e))
    return None


def _parses(source: str) -> bool:
    """Whether a fragment is well-formed, whatever the gate."""
    try:
        ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return False
    return True


def _line(lines: list[str], error: SyntaxError | None) -> int:
    return min(max((error.lineno if error else None) or 1, 1), max(len(lines), 1)) - 1


def _says(error: SyntaxError | None, *parts: str) -> bool:
    return error is not None and any(p in (error.msg or "").lower() for p in parts)


def _join(lines: list[str], source: str) -> str:
    text = "\n".join(lines)
    return text + "\n" if source.endswith("\n") and not text.endswith("\n") else text


def _open_brackets(text: str) -> list[str]:
    """Brackets left open, outside strings and comments; closers that match nothing are skipped."""
    stack, i, quote = [], 0, ""
    while i < len(text):
        c = text[i]
        if quote:
            if c == "\\":
                i += 1
            elif text.startswith(quote, i):
                i, quote = i + len(quote) - 1, ""
            elif c == "\n" and len(quote) == 1:
                quote = ""
        elif c == "#":
            i = text.find("\n", i)
            if i < 0:
                break
        elif c in "'\"":
            quote = c * 3 if text.startswith(c * 3, i) else c
            i += len(quote) - 1
        elif c in _OPEN:
            stack.append(c)
        elif c in _CLOSE and stack and stack[-1] == _CLOSE[c]:
            stack.pop()
        i += 1
    return stack


def _block_end(lines: list[str], header: int) -> int:
    """Index after the suite of a header line."""
    margin, k = len(indent_of(lines[header])), header + 1
    while k < len(lines) and (not lines[k].strip() or len(indent_of(lines[k])) > margin):
        k += 1
    while k > header + 1 and not lines[k - 1].strip():
        k -= 1
    return k


def _shift(line: str, by: int) -> str:
    if not line.strip():
        return line
    return " " * max(0, len(indent_of(line)) + by) + line.lstrip(" \t")


def statements(lines: list[str]) -> list[tuple[int, int]]:
    """(first line, line after the last) of each logical statement: lines joined by open brackets, triple quotes or backslashes."""
    out, quote, depth, joined, start = [], "", 0, False, 0
    for k, s in enumerate(lines):
        if not quote and depth <= 0 and not joined:
            if not s.strip() or s.lstrip().startswith("#"):
                continue
            start = k
            out.append((k, k + 1))
        quote, depth = scan(s, quote, max(depth, 0))
        joined = not quote and s.rstrip("\n").endswith("\\")
        out[-1] = (start, k + 1)
    return out


def _bare(line: str) -> str:
    """The line with the insides of its strings and its comment blanked, places kept."""
    out, quote, i = list(line), "", 0
    while i < len(line):
        c = line[i]
        if quote:
            if c == "\\":
                out[i : i + 2] = "  "[: len(line) - i]
                i += 1
            elif line.startswith(quote, i):
                i, quote = i + len(quote) - 1, ""
            else:
                out[i] = " "
        elif c == "#":
            out[i:] = " " * (len(line) - i)
            break
        elif c in "'\"":
            quote = c * 3 if line.startswith(c * 3, i) else c
            i += len(quote) - 1
        i += 1
    return "".join(out)


# Error-driven operators.


def balance_delimiters(source: str, error: SyntaxError | None) -> str | None:
    """Close all that the source leaves open on the error's line, an open quote first; an open triple quote ends with the source."""
    lines, message = source.split("\n"), (error.msg if error else "") or ""
    broken = "unterminated" in message.lower() and "string" in message.lower()
    at = _line(lines, error)
    column = max((error.offset or 1) - 1, 0) if error else 0
    # Behind an open quote nothing is code, so brackets count up to it.
    left = _open_brackets("\n".join([*lines[:at], lines[at][:column]]) if broken else source)
    if not left and not broken:
        return None
    closers = "".join(_OPEN[c] for c in reversed(left))
    if broken:
        text = lines[at]
        triple = next((q for q in ("'''", '"""') if text[column : column + 3] == q), None) or next((q for q in ("'''", '"""') if text.count(q) % 2), None)
        if triple:
            return source.rstrip("\n") + triple + closers + "\n"
        closers = ("'" if text.count("'") % 2 else '"' if text.count('"') % 2 else "'") + closers
    lines[at] = lines[at].rstrip("\n") + closers
    return _join(lines, source)


def dedent_stray_block(source: str, error: SyntaxError | None) -> str | None:
    """Move an unexpectedly indented run back to the line before it, unless that opens a block."""
    if not _says(error, "unexpected indent"):
        return None
    lines = source.split("\n")
    at = _line(lines, error)
    before = next((s for s in reversed(lines[:at]) if s.strip()), None)
    if before is not None and before.rstrip().endswith(":"):
        return None
    margin, goal = len(indent_of(lines[at])), len(indent_of(before or ""))
    if margin <= goal:
        return None
    end = at
    while end < len(lines) and (not lines[end].strip() or len(indent_of(lines[end])) >= margin):
        end += 1
    return _join(lines[:at] + [_shift(s, goal - margin) for s in lines[at:end]] + lines[end:], source)


def fix_line_continuation(source: str, error: SyntaxError | None) -> str | None:
    """Drop a stray backslash and what follows it on the line."""
    if not _says(error, "line continuation"):
        return None
    lines = source.split("\n")
    at = _line(lines, error)
    if "\\" not in lines[at]:
        return None
    lines[at] = lines[at][: lines[at].index("\\")].rstrip()
    return _join(lines, source)


def fix_numeric_literal(source: str, error: SyntaxError | None) -> str | None:
    """A registered placeholder that never fires."""
    return None


def literal_lhs_rename(source: str, error: SyntaxError | None) -> str | None:
    """Numbers that are assigned to become names."""
    out = re.sub(r"(?m)^([ \t]*)(\d+)([ \t]*=(?!=))", r"\1_lit_\2\3", source)
    return out if out != source else None


def _orphan_tries(lines: list[str]) -> Iterator[tuple[int, int]]:
    for k, s in enumerate(lines):
        if s.strip().rstrip() == "try:":
            end = _block_end(lines, k)
            following = lines[end] if end < len(lines) else ""
            if not (_HANDLER.match(following.strip()) and indent_of(following) == indent_of(s)):
                yield k, end


def _handled(lines: list[str], k: int, end: int) -> list[str]:
    margin = indent_of(lines[k])
    body = [] if end > k + 1 else [margin + "    pass"]
    return lines[:end] + body + [margin + "except Exception:", margin + "    pass"] + lines[end:]


def complete_orphan_try(source: str, error: SyntaxError | None) -> str | None:
    """Give the first ``try`` without a handler one that passes."""
    lines = source.split("\n")
    found = next(_orphan_tries(lines), None)
    return _join(_handled(lines, *found), source) if found else None


# Whole-file operators.


def _target(line: str) -> tuple[str, str] | None:
    """What stands before a line's plain assignment sign outside brackets and strings, and the rest from the sign on."""
    depth, bare = 0, _bare(line)
    for i, c in enumerate(bare):
        depth += (c in _OPEN) - (c in _CLOSE)
        if c == "=" and not depth and bare[i + 1 : i + 2] != "=" and (not i or bare[i - 1] not in "=!<>+-*/%&|^@:~"):
            return line[:i], line[i:]
    return None


def bad_lhs_rename(source: str, error: SyntaxError | None) -> str | None:
    """Assignment targets of all statements that cannot be one become names made from their letters."""
    lines, changed = source.split("\n"), False
    for k, _ in statements(lines):
        text = lines[k]
        word = re.match(r"[ \t]*([A-Za-z_]\w*)", text)
        if text.lstrip().startswith("@") or word and (keyword.iskeyword(word[1]) or word[1] in _SOFT_WORDS) or (found := _target(text)) is None:
            continue
        target = found[0].strip()
        name = "_lit_" + re.sub(r"\W+", "_", target).strip("_")
        if target and not _parses(f"{target} = None") and _parses(f"{name} = None"):
            lines[k], changed = indent_of(text) + name + found[1], True
    return _join(lines, source) if changed else None


def insert_missing_open_paren(source: str, error: SyntaxError | None) -> str | None:
    """Put the parentheses that a line closes too many in front of its expression."""
    if not _says(error, "unmatched ')'"):
        return None
    lines = source.split("\n")
    at = _line(lines, error)
    for k in sorted(range(max(0, at - 4), min(len(lines), at + 5)), key=lambda k: abs(k - at)):
        text = lines[k]
        low = depth = 0
        for c in text:
            depth += (c == "(") - (c == ")")
            low = min(low, depth)
        if low < 0:
            place = re.match(r"[ \t]*(?:[\w.\[\]'\"]+[ \t]*=(?!=)[ \t]*|return[ \t]+)?", text).end()
            lines[k] = text[:place] + "(" * -low + text[place:]
            return _join(lines, source)
    return None


def retype_mismatched_closer(source: str, error: SyntaxError | None) -> str | None:
    """Change one closing bracket to the kind that was opened."""
    found = re.search(r"closing parenthesis '(.)' does not match opening parenthesis '(.)'", (error.msg if error else "") or "")
    if not found or not error.offset:
        return None
    lines = source.split("\n")
    at, column = _line(lines, error), error.offset - 1
    if lines[at][column : column + 1] != found[1]:
        return None
    lines[at] = lines[at][:column] + _OPEN[found[2]] + lines[at][column + 1 :]
    return _join(lines, source)


#: Shortest line that counts as cut off, what may complete it (closers follow), and repeats.
CUT_LINE, CUT_TAILS, CUT_REPEATS = 20, ("", ": None", "None", "'x'"), 200


def _completed(source: str) -> str | None:
    """The source with the last statement's first line completed, if the rest of the file was swallowed by it."""
    lines = source.split("\n")
    spans = statements(lines)
    if not spans or spans[-1][1] < len(lines) or not (_open_brackets("\n".join(lines[spans[-1][0] :])) or syntax_error(source)):
        return None
    k = spans[-1][0]
    text = lines[k].rstrip()
    bare = _bare(text)
    quote = next((q for q in ("'", '"') if bare.count(q) % 2), "")
    left = _open_brackets(text + quote)
    if len(text.strip()) < CUT_LINE or not (left or quote) or bare.count('"""') % 2 or bare.count("'''") % 2:
        return None
    closers = "".join(_OPEN[c] for c in reversed(left))
    header = re.match(r"[ \t]*(?:if|elif|for|while|with|except|def|class|async|match|case)\b", text)
    for tail in [*(t + closers for t in CUT_TAILS), *([": None" + closers[1:]] if closers else [])]:
        made = text + quote + tail
        probe = made.lstrip() + (":\n    pass" if header else "")
        if _parses(probe.removeprefix("el")):
            following = next((s for s in lines[k + 1 :] if s.strip()), None)
            body = [indent_of(text) + "    pass"] if header and (following is None or len(indent_of(following)) <= len(indent_of(text))) else []
            return _join([*lines[:k], made + (":" if header else ""), *body, *lines[k + 1 :]], source)
    return None


def complete_truncated_statement(source: str, error: SyntaxError | None) -> str | None:
    """Complete statements that were cut off and swallowed the file's rest, one after another."""
    now = source
    for _ in range(CUT_REPEATS):
        new = _completed(now)
        if new is None or new == now:
            break
        now = new
    return now if now != source else None


def _clause_peers(clause: str) -> tuple[str, ...]:
    word = clause.split(":")[0].split()[0]
    return {"elif": ("if", "elif"), "else": ("if", "elif", "for", "while", "try", "except", "async"), "except": ("try", "except"), "finally": ("try", "except", "else")}[word]


def _dangling(lines: list[str]) -> Iterator[int]:
    """Lines with a clause that no block of its indentation ends right before."""
    for k, s in enumerate(lines):
        if not _CLAUSE.match(s.strip()):
            continue
        margin = len(indent_of(s))
        peer = next((i for i in range(k - 1, -1, -1) if lines[i].strip() and len(indent_of(lines[i])) <= margin), None)
        if peer is None or len(indent_of(lines[peer])) < margin or not (lines[peer].strip().split("(")[0].split(":")[0].split() or [""])[0] in _clause_peers(s.strip()):
            yield k


def _realign(source: str, wanted: tuple[str, ...], peers: tuple[str, ...] | None) -> str | None:
    """Shift a dangling clause and its suite to the nearest line above that it can belong to."""
    lines = source.split("\n")
    for k in _dangling(lines):
        word = lines[k].strip().split(":")[0].split()[0]
        if word not in wanted:
            continue
        margin = len(indent_of(lines[k]))
        for i in range(k - 1, -1, -1):
            first = (lines[i].strip().split(":")[0].split() or [""])[0]
            if re.match(r"\s*(?:def|class)\b", lines[i]) and len(indent_of(lines[i])) < margin:
                break
            if first in (peers or _clause_peers(lines[k].strip())) and lines[i].rstrip().endswith(":") and len(indent_of(lines[i])) != margin:
                end = _block_end(lines, k)
                by = len(indent_of(lines[i])) - margin
                return _join(lines[:k] + [_shift(s, by) for s in lines[k:end]] + lines[end:], source)
    return None


def align_handlers(source: str, error: SyntaxError | None) -> str | None:
    """Shift a handler's suite to its ``try``."""
    return _realign(source, ("except", "finally"), ("try",))


def align_clause_to_opener(source: str, error: SyntaxError | None) -> str | None:
    """Shift a clause without an opener to one that fits."""
    return _realign(source, ("elif", "else", "except", "finally"), None)


def fold_postinserted_handler_body(source: str, error: SyntaxError | None) -> str | None:
    """Indent what stands between a handler and the decompiler's inserted ``else`` that should hold it."""
    lines = source.split("\n")
    for k, s in enumerate(lines):
        if re.match(r"\s*except\b.*:\s*#\s*post-?inserted", s):
            margin = len(indent_of(s))
            stop = next((i for i in range(k + 1, len(lines)) if re.match(r"\s*else:\s*#\s*inserted", lines[i]) and len(indent_of(lines[i])) == margin), None)
            body = lines[k + 1 : stop] if stop else []
            if any(x.strip() and len(indent_of(x)) <= margin for x in body):
                return _join(lines[: k + 1] + [_shift(x, 4) if len(indent_of(x)) <= margin else x for x in body] + lines[stop:], source)
    return None


def clause_to_if_true(source: str, error: SyntaxError | None) -> str | None:
    """Every dangling else, except or finally becomes an ``if True``."""
    lines = source.split("\n")
    found = [k for k in _dangling(lines) if not lines[k].strip().startswith("elif")]
    for k in found:
        lines[k] = re.sub(r"^(\s*).*?:", r"\1if True:", lines[k], count=1)
    return _join(lines, source) if found else None


def normalize_indentation(source: str, error: SyntaxError | None) -> str | None:
    """Rebuild indentation from a stack of levels, with the file's most common step."""
    if not _says(error, "indent"):
        return None
    lines = source.expandtabs(4).split("\n")
    margins = [len(indent_of(s)) for s in lines if s.strip()]
    steps = [b - a for a, b in zip(margins, margins[1:]) if b > a]
    step = max(set(steps), key=steps.count) if steps else 4
    stack, out, opened = [0], [], False
    quote, depth = "", 0
    for s in lines:
        margin = len(indent_of(s))
        if s.strip() and not quote and depth <= 0:
            if opened and margin > stack[-1]:
                stack.append(margin)
            elif not opened:
                while len(stack) > 1 and margin < stack[-1] and margin <= (stack[-1] + stack[-2]) / 2:
                    stack.pop()
            out.append(" " * (step * (len(stack) - 1)) + s.strip())
            opened = s.split("#")[0].rstrip().endswith(":")
        else:
            out.append(s)
        quote, depth = scan(s, quote, max(depth, 0))
    return _join(out, source)


def complete_all_orphan_try(source: str, error: SyntaxError | None) -> str | None:
    lines, changed = source.split("\n"), False
    while (found := next(_orphan_tries(lines), None)) is not None:
        lines, changed = _handled(lines, *found), True
    return _join(lines, source) if changed else None


def synthesize_try_for_orphan_handler(source: str, error: SyntaxError | None) -> str | None:
    """Put the statement before a handler without ``try`` into one."""
    lines = source.split("\n")
    for k in _dangling(lines):
        if not _HANDLER.match(lines[k].strip()):
            continue
        margin = len(indent_of(lines[k]))
        start = next((i for i in range(k - 1, -1, -1) if lines[i].strip() and len(indent_of(lines[i])) <= margin), None)
        if start is not None and len(indent_of(lines[start])) == margin:
            return _join(lines[:start] + [" " * margin + "try:"] + [_shift(s, 4) for s in lines[start:k]] + lines[k:], source)
    return None


def drop_surplus_closer(source: str, error: SyntaxError | None) -> str | None:
    """Remove one closing bracket that matches nothing."""
    found = re.search(r"unmatched '(.)'", (error.msg if error else "") or "")
    lines = source.split("\n")
    at, column = _line(lines, error), (error.offset or 0) - 1 if error else -1
    if not found or lines[at][column : column + 1] != found[1]:
        return None
    lines[at] = lines[at][:column] + lines[at][column + 1 :]
    return _join(lines, source)


def truncate_partial_element(source: str, error: SyntaxError | None) -> str | None:
    """Cut the error's line at its last comma inside brackets, and close them."""
    lines = source.split("\n")
    at = _line(lines, error)
    cut = lines[at].rfind(",")
    while cut > 0:
        left = _open_brackets(lines[at][:cut])
        if left:
            lines[at] = lines[at][:cut] + "".join(_OPEN[c] for c in reversed(left))
            return _join(lines, source)
        cut = lines[at].rfind(",", 0, cut)
    return None


# Structural operators.


def _each_line(source: str, change: Callable[[str], str | None]) -> str | None:
    """The source with ``change`` made to every line that it knows, or None where it knows none."""
    lines = source.split("\n")
    made = [change(s) for s in lines]
    return _join([s if m is None else m for s, m in zip(lines, made)], source) if any(m is not None for m in made) else None


def strip_surplus_leading_delimiters(source: str, error: SyntaxError | None) -> str | None:
    """Two or more brackets in front of a statement's keyword go, on every line."""
    out = re.sub(rf"(?m)^([ \t]*)[(\[{{]{{2,}}(?=(?:{'|'.join(keyword.kwlist)})\b)(?!(?:None|True|False|not|and|or|in|is)\b)", r"\1", source)
    return out if out != source else None


def normalize_leaked_generic_params(source: str, error: SyntaxError | None) -> str | None:
    """The compiler's own names for generic parameters, and dotted parameters beside them, become identifiers."""
    marked = re.compile(r"<generic parameters of ([A-Za-z_]\w*)>")
    return _each_line(source, lambda s: re.sub(r"(?<=[(,\s])\.([A-Za-z_]\w*)", r"_\1", marked.sub(r"_generic_\1", s)) if marked.search(s) else None)


def rejoin_split_comprehension(source: str, error: SyntaxError | None) -> str | None:
    """A ``for`` clause that closes more than it opens, before a deeper line that opens more than it closes, goes behind that line."""
    lines, out, k, changed = source.split("\n"), [], 0, False
    balance = lambda s: (lambda t: sum(c in _OPEN for c in t) - sum(c in _CLOSE for c in t))(_bare(s))
    while k < len(lines):
        s, head = lines[k], lines[k + 1] if k + 1 < len(lines) else ""
        if re.match(r"\s*for\s+\S", s) and balance(s) < 0 < balance(head) and len(indent_of(head)) > len(indent_of(s)):
            out.append(f"{indent_of(s)}{head.strip()} {s.strip()}")
            k, changed = k + 2, True
        else:
            out.append(s)
            k += 1
    return _join(out, source) if changed else None


_DOUBLED = re.compile(r"([ \t]*)for\s+([\w, ]+?)\s+in\s+(.+?)\s+for\s+([\w, ]+?)\s+in\s+\[(.+?)\]\s*:\s*(?:#.*)?$")
_FLATTENED = re.compile(r"([ \t]*)(\S.*?)\s+for\s+([\w, ]+?)\s+in\s+(.+?):\s*(?:#.*)?$")


def reduce_doubled_for(source: str, error: SyntaxError | None) -> str | None:
    """``for V in IT for V in [EXPR]:`` becomes a loop with the expression as its body, on every line."""

    def change(s: str) -> str | None:
        found = _DOUBLED.match(s)
        return f"{found[1]}for {found[2].strip()} in {found[3].strip()}:\n{found[1]}    {found[5].strip()}" if found and found[2].strip() == found[4].strip() else None

    return _each_line(source, change)


def renest_flattened_for(source: str, error: SyntaxError | None) -> str | None:
    """``EXPR for V in IT:`` becomes a loop with the expression as its body, on every line."""

    def change(s: str) -> str | None:
        found = None if _DOUBLED.match(s) else _FLATTENED.match(s)
        body = found[2].strip() if found else ""
        return f"{found[1]}for {found[3].strip()} in {found[4].strip()}:\n{found[1]}    {body}" if body and body[0] not in "([{" and body[-1] not in "([{," else None

    return _each_line(source, change)


def give_headerless_block_a_body(source: str, error: SyntaxError | None) -> str | None:
    """Every header that a clause or a dedent follows gets a body that passes."""
    lines, out, changed = source.split("\n"), [], False
    for k, s in enumerate(lines):
        out.append(s)
        following = next((x for x in lines[k + 1 :] if x.strip()), None)
        if re.match(r"\s*(?:if|elif|else|for|while|with|try|except|finally|def|class|async)\b.*:\s*(?:#.*)?$", s) and following is not None:
            if re.match(r"\s*(?:else|elif|except|finally)\b", following) or len(indent_of(following)) <= len(indent_of(s)):
                out.append(indent_of(s) + "    pass")
                changed = True
    return _join(out, source) if changed else None


# Literals that ground truth knows in full.


def is_cut_literal(line: str) -> bool:
    """A long line with an odd number of quotes and more brackets opened than closed."""
    return len(line) >= 80 and (line.count("'") + line.count('"')) % 2 == 1 and sum(c in _OPEN for c in line) > sum(c in _CLOSE for c in line)


def recover_literal(line: str, sequences: list) -> str | None:
    """A cut-off list, tuple or set with all elements of the one longest constant that goes on as the line begins."""
    first = _STRING.search(line)
    shown: list = [m[1] if m[1] is not None else m[2] for m in _STRING.finditer(line)] or [int(n) for n in re.findall(r"(?<![\w.])(\d+)(?![\w.])", line)]
    if (line.count("'") + line.count('"')) % 2 == 0 or not shown or not first:
        return None

    def going_on(begun: list) -> list[list]:
        out = []
        for sequence in sequences:
            items = list(sequence)
            if len(items) <= len(begun) or not all(isinstance(x, (str, int, bytes)) for x in items):
                continue
            if isinstance(sequence, (set, frozenset)):
                if set(begun) <= set(items):
                    out.append(begun + sorted((x for x in items if x not in begun), key=repr))
            elif items[: len(begun)] == begun:
                out.append(items)
        return out

    # The last element may itself be cut off.
    found = going_on(shown) or ([x for x in going_on(shown[:-1]) if len(x) > len(shown)] if len(shown) > 1 else [])
    longest = [x for x in found if len(x) == max(map(len, found))]
    head = line[: first.start()]
    left = _open_brackets(head)
    if len(longest) != 1 or not left:
        return None
    return head + ", ".join(map(repr, longest[0])) + "".join(_OPEN[c] for c in reversed(left))


def splice_truncated_literals(source: str, error: SyntaxError | None, sequences: list) -> str | None:
    """The first cut-off literal, the error's line first, completed from constants of the ground truth."""
    lines = source.split("\n")
    at = _line(lines, error)
    for k in [at, *(i for i in range(len(lines)) if i != at)]:
        if is_cut_literal(lines[k]) and (full := recover_literal(lines[k], sequences)):
            return _join([*lines[:k], full, *lines[k + 1 :]], source)
    return None


# Registries, in the order in which operators are tried.
PREPASS: tuple[Operator, ...] = (balance_delimiters, dedent_stray_block, fix_line_continuation, fix_numeric_literal, literal_lhs_rename, complete_orphan_try)
PURE: tuple[Operator, ...] = (
    bad_lhs_rename, insert_missing_open_paren, retype_mismatched_closer, complete_truncated_statement, align_handlers, align_clause_to_opener,
    fold_postinserted_handler_body, clause_to_if_true, normalize_indentation,
)
SYNTHETIC: tuple[Operator, ...] = (complete_all_orphan_try, synthesize_try_for_orphan_handler, drop_surplus_closer, truncate_partial_element)
STRUCTURAL: tuple[Operator, ...] = (
    strip_surplus_leading_delimiters, normalize_leaked_generic_params, rejoin_split_comprehension, reduce_doubled_for, renest_flattened_for, give_headerless_block_a_body,
)
#: Operators that change control flow rather than spelling.
CONTROL_FLOW_REWRITES = frozenset({"clause_to_if_true", "reduce_doubled_for", "renest_flattened_for"})
PREPASS_ROUNDS, STACK_ROUNDS = 24, 12


def prepass(source: str, operators: tuple[Operator, ...] = PREPASS, rounds: int = PREPASS_ROUNDS, gate: Gate = syntax_error) -> tuple[str, list[str]]:
    """Apply operators one at a time; a step stays if the source compiles then or its first error moves down."""
    done: list[str] = []
    error = gate(source)
    for _ in range(rounds):
        if error is None:
            break
        for op in operators:
            new = op(source, error)
            if new is None or new == source:
                continue
            after = gate(new)
            if after is None or (after.lineno or 0) > (error.lineno or 0):
                source, error = new, after
                done.append(op.__name__)
                break
        else:
            break
    return source, done


def stack(source: str, operators: tuple[Operator, ...], rounds: int = STACK_ROUNDS, gate: Gate = syntax_error) -> tuple[str, list[str]]:
    """Apply every operator in turn to a fixpoint, without a gate in between; stops when the source compiles."""
    done: list[str] = []
    for _ in range(rounds):
        before = source
        for op in operators:
            error = gate(source)
            if error is None:
                return source, done
            new = op(source, error)
            if new is not None and new != source:
                source = new
                done.append(op.__name__)
        if source == before:
            break
    return source, done


def exhaustive(source: str, operators: tuple[Operator, ...] = PREPASS + PURE + SYNTHETIC, depth: int = 4, states: int = 250, gate: Gate = syntax_error) -> tuple[str, list[str]] | None:
    """Breadth-first search over operator sequences for a text that compiles; every text is compiled when it is made, ``states`` at most."""
    error = gate(source)
    if error is None:
        return source, []
    seen, level = {source}, [(source, [], error)]
    for _ in range(depth):
        below = []
        for text, done, error in level:
            for op in operators:
                new = op(text, error)
                if new is None or new in seen:
                    continue
                if len(seen) > states:
                    return None
                seen.add(new)
                after = gate(new)
                if after is None:
                    return new, [*done, op.__name__]
                below.append((new, [*done, op.__name__], after))
        level = below
    return None


def delete_until_compilable(source: str, most: float = 0.95, gate: Gate = syntax_error) -> tuple[str, int] | None:
    """Delete the erroneous span, wider the more often an error stays; None if more than ``most`` of the lines would go."""
    lines, total, tries = source.split("\n"), max(1, len(source.split("\n"))), 0
    gone, last = 0, -1
    while (error := gate("\n".join(lines))) is not None:
        at = _line(lines, error)
        tries = tries + 1 if at == last else 0
        last = at
        window = minimal_window("\n".join(lines), at + 1, min(tries, 3))
        gone += window.end - window.start + 1
        del lines[window.start - 1 : window.end]
        if gone > most * total or not lines:
            return None
    return "\n".join(lines), gone


#: Fixed value: the mark behind a chunk that was made a string.
CHUNK_MARKER = "# pyllmpatch: unparsed-chunk"


def top_level_chunks(lines: list[str]) -> list[tuple[int, int]]:
    """(first line, line after the last) of what starts at the margin outside brackets, quotes and continued lines; all lines from the first non-blank on."""
    starts, quote, depth, joined = [], "", 0, False
    for k, s in enumerate(lines):
        fresh = s.strip() and depth <= 0 and not joined and not quote and not s[:1].isspace()
        if fresh or s.strip() and not starts:
            starts.append(k)
        quote, depth = scan(s, quote, max(depth, 0))
        joined = _bare(s).rstrip().endswith("\\")
    return list(zip(starts, [*starts[1:], len(lines)]))


def neutralise(source: str, gate: Gate = syntax_error, fix: Callable[[str], str | None] | None = None) -> tuple[str, int]:
    """Top-level chunks that don't compile, even after ``fix``, become marked string literals, lines kept; and how many lines did.

    Where the chunks don't compile side by side, the whole source becomes one literal, so the result always compiles.
    """
    lines, gone = source.removesuffix("\n").split("\n"), 0
    chunks = top_level_chunks(lines)
    out = lines[: chunks[0][0]] if chunks else lines
    for start, end in chunks:
        part = lines[start:end]
        text = "\n".join(part)
        if gate(text) is None:
            out += part
        elif fix and (fixed := fix(text + "\n")) is not None and gate(fixed) is None:
            made = fixed.rstrip("\n").split("\n")
            out += made + [""] * max(0, len(part) - len(made))
        else:
            out += [f"{text!r}  {CHUNK_MARKER}", *[""] * (len(part) - 1)]
            gone += len(part)
    text = _join(out, source)
    return (text, gone) if gate(text) is None else (f"{source!r}  {CHUNK_MARKER}\n", len(lines))


def repair_source(source: str, deletion: bool = True, forced: bool = True, gate: Gate = syntax_error, sequences: list | None = None) -> dict:
    """The cascade: pre-pass, pure, synthetic and structural stacks, search, deletion, and neutralising; the first text that compiles.

    With ``sequences``, constants of the ground truth, cut-off literals are completed before anything is guessed.
    """
    result = lambda text, stage, done, gone=0: {"repaired": text, "stage": stage, "operations": done, "lines_deleted": gone}
    if gate(source) is None:
        return result(source, "clean", [])
    first: tuple[Operator, ...] = ()
    if sequences:

        def spliced(text: str, error: SyntaxError | None) -> str | None:
            return splice_truncated_literals(text, error, sequences)

        spliced.__name__ = "splice_truncated_literals"
        first = (spliced,)
    text, done = prepass(source, first + PREPASS, gate=gate)
    if gate(text) is None:
        return result(text, "prepass", done)
    for stage, operators in (("pure", PURE), ("synthetic", PURE + SYNTHETIC), ("structural", PURE + SYNTHETIC + STRUCTURAL)):
        new, more = stack(text, operators, gate=gate)
        if gate(new) is None:
            return result(new, stage, done + more)
    if (found := exhaustive(text, gate=gate)) is not None:
        return result(found[0], "exhaustive", done + found[1])
    if deletion and (cut := delete_until_compilable(text, gate=gate)) is not None:
        return result(cut[0], "deleted", done, cut[1])
    if forced:
        made, gone = neutralise(text, gate, lambda chunk: stack(chunk, PURE + SYNTHETIC, gate=gate)[0])
        return result(made, "neutralised", done, gone)
    return result(None, "failed", done)


_RESULT = T.StructType([T.StructField("repaired", T.StringType()), T.StructField("stage", T.StringType()), T.StructField("operations", T.ArrayType(T.StringType())), T.StructField("lines_deleted", T.LongType())])


def control_flow_rewrites(operations: Column) -> Column:
    """Those of the operations that change control flow rather than spelling."""
    return F.array_intersect(operations, F.array(*map(F.lit, sorted(CONTROL_FLOW_REWRITES))))


class OutOfTime(Exception):
    """A source took longer than its time."""


def timed(gate: Gate, seconds: float) -> Gate:
    """A gate that ends its source's repair when the time is over; every step of the cascade asks its gate."""
    end = time.monotonic() + seconds

    def ask(source: str) -> SyntaxError | None:
        if time.monotonic() > end:
            raise OutOfTime
        return gate(source)

    return ask


def repair(rows: DataFrame, column: str, deletion: bool = True, forced: bool = True, gate: Gate = syntax_error, seconds: float | None = None) -> DataFrame:
    """``rows`` with repaired, stage, operations, control_flow_rewrites and lines_deleted; a null source stays null with stage NULL.

    With ``seconds`` a source that takes longer has stage timed_out and nothing repaired.
    """

    def one(source: str) -> dict:
        try:
            return repair_source(source, deletion, forced, timed(gate, seconds) if seconds is not None else gate)
        except OutOfTime:
            return {"repaired": None, "stage": "timed_out", "operations": [], "lines_deleted": 0}

    def run(sources: pd.Series) -> pd.DataFrame:
        empty = {"repaired": None, "stage": None, "operations": None, "lines_deleted": None}
        out = pd.DataFrame([empty if s is None else one(s) for s in sources], columns=list(empty))
        return out.astype({"lines_deleted": "Int64"})

    run.__annotations__ = {"sources": pd.Series, "return": pd.DataFrame}
    fixed = F.pandas_udf(run, _RESULT)(rows[column])
    names = [c for c in rows.columns if c not in _RESULT.fieldNames()]
    return rows.withColumn("_fixed", fixed).select(*names, "_fixed.*").withColumn("control_flow_rewrites", control_flow_rewrites(F.col("operations")))


def apply_window(source: str, line: int, replacement: str, expansion: int = 0) -> str:
    """Put a model's replacement for the minimal window around a line back into the source."""
    return reattach(source, minimal_window(source, line, expansion), replacement)
