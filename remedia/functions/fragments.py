"""Syntax-tree features of code fragments, as one Arrow UDF that returns a struct."""

from __future__ import annotations

import ast
import hashlib
from collections import Counter

import pandas as pd
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

# Node types that count as control flow and as definition boundaries.
CONTROL_FLOW = ("If", "For", "AsyncFor", "While", "With", "AsyncWith", "Try", "Match")
BOUNDARIES = ("FunctionDef", "AsyncFunctionDef", "ClassDef")
_COMPREHENSIONS = ("ListComp", "SetComp", "DictComp", "GeneratorExp")

_SETS = ("statement_types", "control_flow_nodes", "loaded_names", "bound_names", "constants", "return_value_kinds", "assign_value_kinds", "expr_value_kinds", "call_func_kinds", "boundary_kinds")
#: Counted node types by output field.
_COUNTS = {
    "call_count": ("Call",), "attribute_count": ("Attribute",), "compare_count": ("Compare",), "boolop_count": ("BoolOp",), "binop_count": ("BinOp",), "unaryop_count": ("UnaryOp",),
    "subscript_count": ("Subscript",), "assign_count": ("Assign", "AnnAssign", "AugAssign"), "return_count": ("Return",), "yield_count": ("Yield", "YieldFrom"), "raise_count": ("Raise",),
}
_NUMBERS = (*_COUNTS, "call_arg_count", "call_keyword_count", "return_value_count", "line_count", "char_count")
SCHEMA = T.StructType(
    [T.StructField("parsed", T.BooleanType()), *(T.StructField(n, T.ArrayType(T.StringType())) for n in _SETS), *(T.StructField(n, T.IntegerType()) for n in _NUMBERS)]
)


def kind(node: ast.AST | None) -> str:
    """Family of an expression: comprehensions are one, everything else goes by its node type."""
    name = type(node).__name__
    return "None" if node is None else "Comprehension" if name in _COMPREHENSIONS else name


def _tree(text: str) -> ast.Module | None:
    lines = text.splitlines()
    margin = min((len(s) - len(s.lstrip(" ")) for s in lines if s.strip()), default=0)
    for form in (text, "\n".join(s[margin:] for s in lines)):
        try:
            return ast.parse(form)
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            pass
    return None


def fragment_features(text: str | None) -> dict:
    """All features of a fragment; one that doesn't parse, as it is or dedented, has only its size."""
    text = text or ""
    sets: dict[str, set[str]] = {n: set() for n in _SETS}
    numbers = Counter(line_count=len(text.splitlines()), char_count=len(text))
    tree = _tree(text)
    if tree is not None:
        by_type: Counter = Counter()
        sets["statement_types"].update(type(s).__name__ for s in tree.body)
        for node in ast.walk(tree):
            name = type(node).__name__
            by_type[name] += 1
            if name in CONTROL_FLOW:
                sets["control_flow_nodes"].add(name)
            elif name in BOUNDARIES:
                sets["boundary_kinds"].add(name)
            match node:
                case ast.Name(id=i, ctx=ast.Load()):
                    sets["loaded_names"].add(i)
                case ast.Name(id=i):
                    sets["bound_names"].add(i)
                case ast.Constant(value=value):
                    sets["constants"].add(type(value).__name__)
                case ast.Call(func=f, args=args, keywords=keywords):
                    numbers["call_arg_count"] += len(args)
                    numbers["call_keyword_count"] += len(keywords)
                    sets["call_func_kinds"].add(kind(f))
                case ast.Return(value=value) if value is not None:
                    numbers["return_value_count"] += 1
                    sets["return_value_kinds"].add(kind(value))
                case ast.Assign(value=value) | ast.AugAssign(value=value) | ast.AnnAssign(value=value) if value is not None:
                    sets["assign_value_kinds"].add(kind(value))
                case ast.Expr(value=value):
                    sets["expr_value_kinds"].add(kind(value))
        for field, types in _COUNTS.items():
            numbers[field] = sum(by_type[t] for t in types)
    return {"parsed": tree is not None, **{n: sorted(s) for n, s in sets.items()}, **{n: numbers[n] for n in _NUMBERS}}


@pandas_udf(SCHEMA)
def features(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([fragment_features(t) for t in texts], columns=["parsed", *_SETS, *_NUMBERS])


@pandas_udf(T.StringType())
def structural_hash(texts: pd.Series) -> pd.Series:
    """SHA-256 of a fragment's syntax tree; NULL if it doesn't parse."""
    trees = [None if t is None else _tree(t) for t in texts]
    return pd.Series([None if t is None else hashlib.sha256(ast.dump(t).encode()).hexdigest() for t in trees])


def first_seen(candidates: list[tuple[str, str | None]]) -> list[int]:
    """Places of candidates (text hash, structural hash) of which neither hash was kept before; only kept ones count."""
    texts: set[str] = set()
    shapes: set[str] = set()
    out = []
    for i, (text, shape) in enumerate(candidates):
        if text not in texts and (shape is None or shape not in shapes):
            out.append(i)
            texts.add(text)
            if shape is not None:
                shapes.add(shape)
    return out
