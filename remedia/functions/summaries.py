"""Sentences about repair actions: what the evidence was, what was done, what was kept; and guidance from lists of similar repairs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The wording that readers of these texts know.
SITUATIONS = (
    (("gt_only_names_count", "gt_only_consts_count"), "ground-truth metadata contained names or constants absent from the derived code object"),
    (("derived_only_names_count", "derived_only_consts_count"), "derived metadata contained extra names or constants not present in ground truth"),
    (("instruction_has_jump",), "the instruction evidence involved control-flow jumps or blocks"),
    (("instruction_has_call_or_attr",), "the instruction evidence involved call or attribute access operations"),
)
NO_SITUATION = "the derived fragment had semantic drift from the target code object"
ACTIONS = {
    "insert_missing_definition_fragment": "inserted only the missing definition or statement fragment without repeating parent context",
    "repair_top_level_module_statement": "localized the edit to the mismatching top-level module statement",
    "add_missing_control_flow": "added the missing local control-flow structure indicated by bytecode evidence",
    "remove_extra_control_flow": "removed or simplified extra local control-flow structure unsupported by the target bytecode",
    "add_missing_return_or_yield": "restored a missing return or yield shape while preserving the surrounding fragment",
    "simplify_extra_return_or_branch": "simplified an extra return or branch shape unsupported by the target bytecode",
    "restore_missing_literal_or_constant": "restored a missing literal or constant use with a minimal local edit",
    "remove_extra_literal_or_constant": "removed or replaced an extra literal or constant use from the derived fragment",
    "restore_missing_expression_reference": "restored a missing expression-level name, call, or attribute reference",
    "remove_extra_expression_reference": "removed or replaced an extra expression-level reference from the derived fragment",
    "adjust_return_call_expression": "adjusted a returned call expression while preserving surrounding structure",
    "adjust_return_attribute_expression": "adjusted a returned attribute expression while preserving surrounding structure",
    "adjust_return_literal_expression": "adjusted a returned literal/constant expression while preserving surrounding structure",
    "adjust_return_condition_expression": "adjusted a returned conditional/boolean expression while preserving surrounding structure",
    "adjust_return_subscript_expression": "adjusted a returned subscript/indexing expression while preserving surrounding structure",
    "adjust_call_or_attribute_expression": "adjusted call or attribute expression shape without rewriting the whole fragment",
    "adjust_call_arguments": "adjusted call argument or keyword shape without rewriting the whole fragment",
    "adjust_method_vs_attribute_access": "changed method-call versus attribute-access expression shape without rewriting the whole fragment",
    "adjust_attribute_access": "adjusted attribute-access expression shape without rewriting the whole fragment",
    "adjust_comparison_expression": "adjusted comparison expression shape while preserving surrounding structure",
    "adjust_boolean_expression": "adjusted boolean expression shape while preserving surrounding structure",
    "adjust_arithmetic_or_unary_expression": "adjusted arithmetic or unary expression shape while preserving surrounding structure",
    "adjust_subscript_or_index_expression": "adjusted subscript or indexing expression shape while preserving surrounding structure",
    "adjust_assignment_value_or_target": "adjusted an assignment target or value while preserving surrounding structure",
    "adjust_assignment_call_value": "adjusted a call expression used as an assignment value while preserving surrounding structure",
    "adjust_assignment_literal_value": "adjusted a literal/constant used as an assignment value while preserving surrounding structure",
    "adjust_return_expression": "adjusted the returned expression while preserving surrounding structure",
    "preserve_structure_expression_edit": "made an expression-level edit while preserving surrounding statement and boundary structure",
    "other_structural_edit": "changed local structure to better match the target bytecode",
}
OTHER_ACTION = "made a local source edit that reduced semantic drift"
GUIDANCE = {
    "names_added": ("restored missing references to", "If these names appear in the ground-truth metadata or instruction diff, add the smallest expression-level use that accounts for them."),
    "names_removed": ("removed or replaced extra references to", "If these names appear only in the derived side, remove the local use instead of restructuring the fragment."),
    "statement_types_added": ("added these statement forms", "Only add the same form when the current bytecode shows the corresponding missing branch, loop, definition, or return."),
    "statement_types_removed": ("removed these statement forms", "If the derived bytecode has extra structure, simplify that local statement rather than adding new code."),
    "control_flow_added": ("introduced control flow", "Use this only when the ground-truth instruction window has jumps or blocks missing from the derived fragment."),
    "control_flow_removed": ("removed control flow", "Use this only when the derived instruction window has extra jumps or blocks."),
}
GUIDANCE_HEAD = "Action guidance from prior accepted repairs:"
GUIDANCE_TAIL = "- Apply these actions only when they explain the current source, metadata, and bytecode mismatch."
GUIDANCE_BY_OPERATION = {
    "insert_missing": "- Return only the missing fragment; do not repeat the parent context around the insertion point.",
    "repair_module_statement": "- Keep the edit inside the shown top-level statement; do not rewrite neighboring module code.",
}
_SITUATION, _ACTION, _CONSTRAINT = "Situation: ", "Action that reduced drift: ", "Constraint observed: "


def _looked_up(key: Column, table: dict[str, str], other: Column) -> Column:
    pairs = F.create_map(*(F.lit(x) for pair in table.items() for x in pair))
    return F.coalesce(F.try_element_at(pairs, F.coalesce(key, F.lit(""))), other)


def action_summary(action: Column, operation: Column, evidence, boundary_changed: Column) -> Column:
    """Situation, action and constraint of a pattern in three sentences; ``evidence`` gives a count or flag by name."""
    seen = lambda c: F.coalesce(evidence(c).cast("int"), F.lit(0)) != 0
    said = [F.when(seen(names[0]) | (seen(names[1]) if len(names) > 1 else F.lit(False)), text) for names, text in SITUATIONS]
    situation = F.concat_ws("; ", *said)
    kept = F.when(F.coalesce(boundary_changed, F.lit(False)), "changed a function/class boundary").otherwise("preserved function/class boundary")
    constraint = F.when(operation == "insert_missing", "returned only the missing insertable fragment").when(operation == "repair_module_statement", "kept the edit inside the selected module statement").otherwise(kept)
    return F.concat(
        F.lit(_SITUATION), F.when(situation != "", situation).otherwise(NO_SITUATION), F.lit(". " + _ACTION), _looked_up(action, ACTIONS, F.lit(OTHER_ACTION)),
        F.lit(". " + _CONSTRAINT), constraint, F.lit("."),
    )


def summary_parts(summary: Column) -> Column:
    """struct(situation, action, constraint) of a summary; empty where a sentence is missing, the last of several."""
    sentences = F.split(F.coalesce(summary, F.lit("")), r"\. ")

    def part(head: str) -> Column:
        own = F.filter(sentences, lambda s: F.startswith(s, F.lit(head)))
        last = F.get(own, F.size(own) - 1)
        return F.coalesce(F.regexp_replace(F.substring(last, F.lit(len(head) + 1), F.length(last)), r"\.+$", ""), F.lit(""))

    return F.struct(part(_SITUATION).alias("situation"), part(_ACTION).alias("action"), part(_CONSTRAINT).alias("constraint"))


def guidance(lists: dict[str, Column], operation: Column) -> Column:
    """Guidance from the top values of similar repairs by kind of change (arrays); empty if there is nothing to say."""
    line = lambda kind: F.when(F.size(lists[kind]) > 0, F.concat(F.lit(f"- Prior accepted edits {GUIDANCE[kind][0]}: "), F.array_join(lists[kind], ", "), F.lit(". " + GUIDANCE[kind][1])))
    lines = F.concat_ws("\n", *(line(k) for k in GUIDANCE if k in lists), _looked_up(operation, GUIDANCE_BY_OPERATION, F.lit(None)))
    return F.when(lines != "", F.concat_ws("\n", F.lit(GUIDANCE_HEAD), lines, F.lit(GUIDANCE_TAIL))).otherwise("")
