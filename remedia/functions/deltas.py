"""Before/after differences of fragment features, as columns of a pattern row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Feature sets whose members are compared, and the counts whose change is recorded.
KIND_SETS = ("return_value_kinds", "assign_value_kinds", "expr_value_kinds", "call_func_kinds")
CHANGED_COUNTS = (
    "call_count", "call_arg_count", "call_keyword_count", "attribute_count", "compare_count", "boolop_count", "binop_count", "unaryop_count", "subscript_count", "assign_count",
    "return_count", "return_value_count", "yield_count", "raise_count", "line_count", "char_count",
)
#: Presence flags, each by the counts that make it true.
PRESENCE = {
    "return": ("return_count",), "assignment": ("assign_count",), "call_or_attribute": ("call_count", "attribute_count"), "compare": ("compare_count",), "boolop": ("boolop_count",),
    "arithmetic_or_unary": ("binop_count", "unaryop_count"), "subscript": ("subscript_count",),
}


def _any(side: Column, counts: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for c in counts:
        out = out | (side[c] > 0)
    return out


def source_delta(before: Column, after: Column) -> dict[str, Column]:
    """Columns of a pattern row from two feature structs (see :mod:`functions.fragments`)."""
    out: dict[str, Column] = {}

    def sets(name: str, a: Column, b: Column, lists: bool = True) -> None:
        added, removed = F.array_sort(F.array_except(b, a)), F.array_sort(F.array_except(a, b))
        out[f"{name}_added_count"], out[f"{name}_removed_count"] = F.size(added), F.size(removed)
        if lists:
            out[f"{name}_added"], out[f"{name}_removed"] = added, removed

    names = lambda side: F.array_union(side["loaded_names"], side["bound_names"])
    sets("names", names(before), names(after), lists=False)
    sets("constants", before["constants"], after["constants"], lists=False)
    for kind in KIND_SETS:
        sets(kind, before[kind], after[kind])
        out[f"{kind}_before"], out[f"{kind}_after"] = F.array_join(before[kind], ","), F.array_join(after[kind], ",")
    sets("statements", before["statement_types"], after["statement_types"])
    sets("control_flow", before["control_flow_nodes"], after["control_flow_nodes"])
    out["boundary_changed"] = F.size(F.array_except(before["boundary_kinds"], after["boundary_kinds"])) + F.size(F.array_except(after["boundary_kinds"], before["boundary_kinds"])) > 0
    for c in CHANGED_COUNTS:
        out[f"{c}_before"], out[f"{c}_after"], out[f"{c}_delta"] = before[c], after[c], after[c] - before[c]
    for name, counts in PRESENCE.items():
        out[f"source_has_{name}_before"], out[f"source_has_{name}_after"] = _any(before, counts), _any(after, counts)
        if name != "return":
            out[f"has_{name}"] = _any(before, counts) | _any(after, counts)
    out["has_return_value"] = _any(before, ("return_value_count",)) | _any(after, ("return_value_count",))
    out["source_shape_before"], out["source_shape_after"] = F.array_join(before["statement_types"], ","), F.array_join(after["statement_types"], ",")
    return out


def feature_transitions(before: Column, after: Column, flags: tuple[str, ...]) -> dict[str, Column]:
    """``"true->false"`` for each flag that changes between two structs, else NULL."""
    return {f: F.when(~before[f].eqNullSafe(after[f]), F.concat_ws("->", F.coalesce(before[f].cast("string"), F.lit("null")), F.coalesce(after[f].cast("string"), F.lit("null")))) for f in flags}
