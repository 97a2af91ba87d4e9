"""Code objects of source text: what a module defines, where, in which scope and context; and which row a target name means."""

from __future__ import annotations

import ast
import io
import tokenize
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Kinds and names of code objects, and what the parts of a statement are called.
NAMED = {ast.FunctionDef: "function", ast.AsyncFunctionDef: "async_function", ast.ClassDef: "class"}
ANONYMOUS = {ast.Lambda: "lambda", ast.ListComp: "listcomp", ast.SetComp: "setcomp", ast.DictComp: "dictcomp", ast.GeneratorExp: "genexpr"}
PARTS: dict[type, list[tuple[str, tuple[str, ...]]]] = {
    ast.If: [("if_test", ("test",)), ("if_body", ("body",)), ("else_body", ("orelse",))],
    ast.For: [("for_header", ("target", "iter")), ("for_body", ("body",)), ("else_body", ("orelse",))],
    ast.While: [("while_test", ("test",)), ("while_body", ("body",)), ("else_body", ("orelse",))],
    ast.Try: [("try_body", ("body",)), ("", ("handlers",)), ("else_body", ("orelse",)), ("finally_body", ("finalbody",))],
    ast.With: [("with_header", ("items",)), ("with_body", ("body",))],
    ast.ExceptHandler: [("except_handler", ("type",)), ("body", ("body",))],
    ast.match_case: [("match_case", ("pattern", "guard")), ("body", ("body",))],
}
PARTS |= {ast.AsyncFor: PARTS[ast.For], ast.AsyncWith: PARTS[ast.With], ast.TryStar: PARTS[ast.Try]}
HEADS = {
    ast.ClassDef: [("decorator", ("decorator_list",)), ("class_base", ("bases",)), ("class_keyword", ("keywords",))],
    ast.FunctionDef: [("decorator", ("decorator_list",)), ("default_or_annotation", ("args",)), ("annotation", ("returns",))],
}
HEADS[ast.AsyncFunctionDef] = HEADS[ast.FunctionDef]
MODULE = "<module>"


def parenthesised_handlers(source: str) -> str:
    """``except A, B:`` as ``except (A, B):``; a source that can't be read in tokens stays as it is."""
    try:
        tokens = list(tokenize.generate_tokens(io.StringIO(source).readline))
    except (tokenize.TokenError, SyntaxError):
        return source
    lines = source.splitlines(keepends=True)
    edits = []
    for n, token in enumerate(tokens):
        if token.type != tokenize.NAME or token.string != "except":
            continue
        depth, comma, first, last, end = 0, False, None, None, None
        for t in tokens[n + 1 :]:
            if t.type in (tokenize.NL, tokenize.COMMENT) or first is None and t.string == "*":
                continue
            if not depth and (t.string == ":" or t.type == tokenize.NAME and t.string == "as"):
                end = last
                break
            first = first or t.start
            depth += (t.string in "([{") - (t.string in ")]}") if t.type == tokenize.OP else 0
            comma |= not depth and t.string == ","
            last = t.end
        if comma and end:
            edits += [(first, "("), (end, ")")]
    for (row, column), mark in sorted(edits, reverse=True):
        lines[row - 1] = lines[row - 1][:column] + mark + lines[row - 1][column:]
    return "".join(lines)


def _children(node: ast.AST) -> Iterator[ast.AST]:
    """What a node holds, in the order in which code objects in it are numbered."""
    if isinstance(node, ast.arguments):
        named = [*node.posonlyargs, *node.args, *node.kwonlyargs, *filter(None, (node.vararg, node.kwarg))]
        yield from filter(None, [*(a.annotation for a in named), *node.defaults, *node.kw_defaults])
    elif isinstance(node, ast.withitem):
        yield from filter(None, (node.context_expr, node.optional_vars))
    else:
        yield from ast.iter_child_nodes(node)


def collect(source: str) -> list[dict]:
    """All code objects in order, the module first; SyntaxError for a source that doesn't parse.

    ``occurrence`` counts objects of one scope, name and line, ``sibling`` all objects of one scope; ``ordinal_path`` is the
    path of the nearest object that the scope names, and the sibling number.
    """
    tree = ast.parse(parenthesised_handlers(source))
    out = [
        {
            "qualname": MODULE, "base_name": MODULE, "kind": "module", "line": 1, "end_line": 1, "col": 0, "end_col": 0, "scope_path": [], "occurrence": 0, "sibling": 0,
            "ordinal_path": [0], "context": "module",
        }
    ]
    paths, occurrences, siblings = {(): [0]}, {}, {}

    def add(node: ast.AST, name: str, kind: str, scope: tuple[str, ...], context: str) -> None:
        line = min([node.lineno, *(d.lineno for d in getattr(node, "decorator_list", []))])
        nth = occurrences[scope, name, line] = occurrences.get((scope, name, line), -1) + 1
        sibling = siblings[scope] = siblings.get(scope, -1) + 1
        path = [*paths.get(scope, [0]), sibling]
        paths[(*scope, name)] = path
        out.append(
            {
                "qualname": ".".join((MODULE, *scope, name)), "base_name": name, "kind": kind, "line": line, "end_line": node.end_lineno, "col": node.col_offset, "end_col": node.end_col_offset,
                "scope_path": list(scope), "occurrence": nth, "sibling": sibling, "ordinal_path": path, "context": context,
            }
        )

    def part(node: ast.AST, parts: list[tuple[str, tuple[str, ...]]], scope: tuple[str, ...], context: str) -> None:
        for label, fields in parts:
            for value in (getattr(node, f) for f in fields):
                for child in value if isinstance(value, list) else [value]:
                    if isinstance(child, ast.AST):
                        visit(child, scope, label or context)

    def visit(node: ast.AST, scope: tuple[str, ...], context: str) -> None:
        kind = type(node)
        if kind in NAMED:
            add(node, node.name, NAMED[kind], scope, context)
            part(node, HEADS[kind], scope, context)
            part(node, [("body", ("body",))], (*scope, node.name), context)
        elif kind in PARTS:
            part(node, PARTS[kind], scope, context)
        else:
            if kind in ANONYMOUS:
                name = f"<{ANONYMOUS[kind]}>"
                add(node, name, ANONYMOUS[kind], scope, context)
                scope = (*scope, name)
            for child in _children(node):
                visit(child, scope, context)

    visit(tree, (), "module")
    for record in out:
        record["child_count"] = sum(len(o["ordinal_path"]) > 1 and o["ordinal_path"][:-1] == record["ordinal_path"] for o in out)
    return out


_OBJECT = "idx long, qualname string, base_name string, kind string, line long, end_line long, col long, end_col long, scope_path array<string>, occurrence long, sibling long, ordinal_path array<long>, context string, child_count long"


def source_objects(rows: DataFrame, key: str, source: str) -> DataFrame:
    """One row an object of each source: key, idx (order) and the fields of :func:`collect`.

    A source that doesn't parse gives one row of kind ``unparsed``; a null one is empty and gives its module.
    """
    names = [f.split()[0] for f in _OBJECT.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            made = []
            for k, text in zip(frame[key], frame[source]):
                try:
                    found = collect(text or "")
                except (SyntaxError, ValueError, RecursionError):
                    found = [{"kind": "unparsed"}]
                made += [(k, i, *(o.get(n) for n in names[1:])) for i, o in enumerate(found)]
            yield pd.DataFrame(made, columns=[key, *names]).astype({f.split()[0]: "Int64" for f in _OBJECT.split(", ") if f.endswith(" long")})

    return rows.select(key, source).mapInPandas(run, f"{key} {rows.schema[key].dataType.simpleString()}, {_OBJECT}")


# Fixed value: what a missing number counts as when candidates are ordered.
FAR = 10**9


def resolve_targets(mapping: DataFrame, targets: DataFrame, strict: bool = False) -> DataFrame:
    """file, target, status, n_candidates and the chosen row's idx for each target name of each file.

    ``mapping`` has file, idx, row_type, source_qualname, pyc_qualname, matched, source_line, pyc_line, source_collisions,
    pyc_collisions, source_path, pyc_path (arrays of ints), source_occurrence, pyc_occurrence, source_col, source_end_line,
    source_end_col. Of several rows with the name the best by identity is chosen (its own name, matched, nearest lines, fewest
    collisions, first paths, occurrences and spans); with ``strict`` none is. Status: found, ranked, ambiguous or missing.
    """
    known = lambda c: F.coalesce(F.col(c), F.lit(FAR))
    path = lambda c: F.coalesce(F.when(F.size(c) > 0, F.col(c)), F.array(F.lit(FAR).cast("long")))
    gap = F.when(F.col("pyc_line").isNull(), F.lit(FAR)).otherwise(F.abs(known("source_line") - F.col("pyc_line")))
    order = [
        F.when(F.col("pyc_qualname").eqNullSafe(F.col("target")), 0).otherwise(1), F.when(F.col("matched").eqNullSafe(F.lit(True)), 0).otherwise(1), gap, known("source_collisions"), known("pyc_collisions"),
        path("source_path"), path("pyc_path"), known("source_occurrence"), known("pyc_occurrence"), known("source_line"), known("source_col"), known("source_end_line"), known("source_end_col"), F.col("idx"),
    ]
    wanted = targets.select("file", "target").distinct()
    rows = mapping.filter(F.col("row_type") == "mapped")
    found = wanted.join(rows, (wanted["file"].eqNullSafe(rows["file"])) & (wanted["target"] == rows["source_qualname"]), "left").drop(rows["file"])
    each = Window.partitionBy("file", "target")
    found = found.withColumn("_nth", F.row_number().over(each.orderBy(*order))).withColumn("n_candidates", F.count("idx").over(each)).filter("_nth = 1")
    many = F.col("n_candidates") > 1
    status = F.when(F.col("n_candidates") == 0, "missing").when(many, "ambiguous" if strict else "ranked").otherwise("found")
    chosen = F.when(many, F.lit(None)).otherwise(F.col("idx")) if strict else F.col("idx")
    return found.select("file", "target", status.alias("status"), "n_candidates", chosen.alias("idx"))
