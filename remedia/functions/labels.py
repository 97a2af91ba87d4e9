"""Classifications as column expressions: outcomes, statuses, error categories, regimes, actions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Deletions up to this many lines are light.
LIGHT_DELETION = 50

# Substrings of compiler messages, by category.
DELIMITER_HINTS = ("unexpected eof", "was never closed", "unterminated", "f-string", "single '}' is not allowed", "expecting '}'", "unmatched ')'", "unmatched ']'", "unmatched '}'")
INDENTATION_HINTS = ("indentationerror", "expected an indented block", "unexpected indent", "unindent does not match", "expected ':'")
NUMERIC_HINTS = ("invalid decimal literal",)
UNCLOSED_HINTS = ("was never closed", "unexpected eof", "unterminated", "eol while scanning")
BLOCK_HINTS = ("expected ':'", "expected an indented block", "unexpected indent", "unindent does not match", "indentation")

# Verification messages and the rank of a code object's state.
EQUAL, DIFFERENT_BYTECODE, DIFFERENT_FLOW, MISSING, EXTRA = "Equal", "Different bytecode", "Different control flow", "Missing bytecode", "Extra bytecode"
RANK_EQUAL, RANK_OFFSET, RANK_NO_OFFSET, RANK_FLOW, RANK_MISSING_EXTRA = 4, 3, 2, 1, 0


def _any_in(text: Column, parts: tuple[str, ...]) -> Column:
    out = F.contains(text, F.lit(parts[0]))
    for p in parts[1:]:
        out = out | F.contains(text, F.lit(p))
    return out


def outcome(compiled: Column, fallback: Column, measured: Column, tallied: Column, forced: Column, lossy: Column) -> Column:
    """Outcome of a syntactic repair; an unknown success is out of scope, never a failure."""
    fallback = F.coalesce(fallback, F.lit(False))
    deleted = F.coalesce(measured, tallied, F.lit(0))
    return (
        F.when(compiled.isNull(), "out_of_scope")
        .when(~compiled, "failed")
        .when(fallback & (deleted > LIGHT_DELETION), "heavy_deletion")
        .when(fallback & (deleted > 0), "light_deletion")
        .when(F.coalesce(forced, F.lit(False)), "neutralised_compile")
        .when(F.coalesce(lossy, F.lit(False)), "genuine_lossy")
        .otherwise("genuine")
    )


def decompile_status(syntax_error: Column, return_code: Column, success_rate: Column) -> Column:
    return (
        F.when(syntax_error, "syntactic_error")
        .when(return_code != 0, "decompiler_failure")
        .when(success_rate.isNull(), "unknown")
        .when(success_rate < 100, "semantic_error")
        .otherwise("success")
    )


def syntax_category(message: Column) -> Column:
    low = F.lower(F.coalesce(message, F.lit("")))
    return F.when(_any_in(low, DELIMITER_HINTS), "delimiter").when(_any_in(low, INDENTATION_HINTS), "indentation").when(_any_in(low, NUMERIC_HINTS), "numeric").otherwise("generic")


def deletion_bucket(message: Column) -> Column:
    low = F.lower(F.coalesce(message, F.lit("")))
    return F.when(_any_in(low, UNCLOSED_HINTS), "UNCLOSED").when(_any_in(low, BLOCK_HINTS), "BLOCK").when(F.contains(low, F.lit("invalid syntax")), "GENERIC").otherwise("OTHER")


def regime(success: Column, message: Column, failed_offset: Column) -> Column:
    named = F.when(message == DIFFERENT_BYTECODE, F.when(failed_offset.isNotNull(), "Different bytecode (offset)").otherwise("Different bytecode (no-offset / exc-table)"))
    return F.when(F.coalesce(success, F.lit(False)), EQUAL).otherwise(F.coalesce(named, F.when(message != "", message), F.lit("Unknown")))


def state(success: Column, message: Column, failed_offset: Column) -> Column:
    """struct(rank, offset), which orders the states of a code object from worst to best."""
    success, message = F.coalesce(success, F.lit(False)), F.coalesce(message, F.lit(""))
    located = (message == DIFFERENT_BYTECODE) & failed_offset.isNotNull()
    rank = (
        F.when(success, RANK_EQUAL).when(located, RANK_OFFSET).when(message == DIFFERENT_BYTECODE, RANK_NO_OFFSET)
        .when(message.isin(MISSING, EXTRA), RANK_MISSING_EXTRA).otherwise(RANK_FLOW)
    )
    return F.struct(rank.alias("rank"), F.when(~success & located, failed_offset.cast("int")).otherwise(0).alias("offset"))


def repair_operation(qualname: Column, derived_exists: Column) -> Column:
    return F.when(qualname == "<module>", "repair_module_statement").when(~derived_exists, "insert_missing").otherwise("repair_source_fragment")


def indexed_alignment(operation: Column, tag: Column) -> Column:
    """Alignment category as patterns are indexed: the tag is looked at before a module statement is."""
    low, operation = F.lower(F.coalesce(tag, F.lit(""))), F.coalesce(operation, F.lit(""))
    has = lambda word: F.contains(low, F.lit(word))
    return (
        F.when(has("insert") | (operation == "insert_missing"), "insert").when(has("delete"), "delete").when(has("replace"), "replace")
        .when(operation == "repair_module_statement", "module_statement").otherwise(F.coalesce(F.when(low != "", low), F.lit("unknown")))
    )


def queried_alignment(operation: Column, tag: Column) -> Column:
    """Alignment category as queries state it: the operation is looked at before the tag is."""
    low, operation = F.lower(F.coalesce(tag, F.lit(""))), F.coalesce(operation, F.lit(""))
    has = lambda word: F.contains(low, F.lit(word))
    return (
        F.when(operation == "insert_missing", "insert").when(operation == "repair_module_statement", "module_statement")
        .when(has("insert"), "insert").when(has("delete"), "delete").when(has("replace"), "replace").otherwise(F.coalesce(F.when(low != "", low), F.lit("unknown")))
    )


# What marks each instruction flag in upper-cased disassembly.
INSTRUCTION_TOKENS = {
    "instruction_has_call_or_attr": ("LOAD_METHOD", "CALL", "LOAD_ATTR", "STORE_ATTR"),
    "instruction_has_jump": ("JUMP", "FOR_ITER"),
    "instruction_has_return": ("RETURN_VALUE",),
    "instruction_has_load_const": ("LOAD_CONST",),
    "instruction_has_store": ("STORE_",),
    "instruction_has_import": ("IMPORT_",),
    "instruction_has_compare": ("COMPARE_OP", "IS_OP", "CONTAINS_OP"),
    "instruction_has_binary_op": ("BINARY_",),
    "instruction_has_subscript": ("SUBSCR",),
    "instruction_has_kw_names": ("KW_NAMES", "CALL_KW"),
    "instruction_has_build_collection": ("BUILD_LIST", "BUILD_TUPLE", "BUILD_MAP", "BUILD_SET"),
}


def instruction_flags(*texts: Column) -> dict[str, Column]:
    """Flags of the instruction kinds that a diff and its windows mention."""
    text = F.upper(F.concat_ws("\n", *(F.coalesce(t, F.lit("")) for t in texts)))
    return {name: _any_in(text, tokens) for name, tokens in INSTRUCTION_TOKENS.items()}


def action(c) -> Column:
    """Label of an accepted edit, first rule that holds. ``c(name)`` gives a column of the pattern row.

    Shapes and kinds are comma-joined strings; a test for a statement type is a substring test on them, so that
    ``Assign`` also finds annotated and augmented assignments.
    """
    more, less, changed = (lambda n: c(n) > 0), (lambda n: c(n) < 0), (lambda n: c(n) != 0)
    shaped = lambda word: F.contains(c("source_shape_before"), F.lit(word)) | F.contains(c("source_shape_after"), F.lit(word))
    kinds = lambda family: F.split(F.concat_ws(",", c(f"{family}_value_kinds_after"), c(f"{family}_value_kinds_before")), ",")
    holds = lambda family, *names: F.arrays_overlap(kinds(family), F.array(*map(F.lit, names)))
    arguments = changed("call_arg_count_delta") | changed("call_keyword_count_delta") | c("instruction_has_kw_names")
    returned = (
        F.when(holds("return", "Call"), "adjust_return_call_expression").when(holds("return", "Attribute"), "adjust_return_attribute_expression")
        .when(holds("return", "Constant"), "adjust_return_literal_expression").when(holds("return", "BoolOp", "Compare", "IfExp"), "adjust_return_condition_expression")
        .when(holds("return", "Subscript"), "adjust_return_subscript_expression").otherwise("adjust_return_expression")
    )
    called = (
        F.when(arguments, "adjust_call_arguments").when(changed("call_count_delta") & changed("attribute_count_delta"), "adjust_method_vs_attribute_access")
        .when(changed("attribute_count_delta"), "adjust_attribute_access").otherwise("adjust_call_or_attribute_expression")
    )
    assigned = F.when(holds("assign", "Call"), "adjust_assignment_call_value").when(holds("assign", "Constant"), "adjust_assignment_literal_value").otherwise("adjust_assignment_value_or_target")
    calls_there = F.when(arguments, "adjust_call_arguments").when(changed("attribute_count_delta"), "adjust_attribute_access").otherwise("adjust_call_or_attribute_expression")
    rules = [
        (c("repair_operation") == "insert_missing", "insert_missing_definition_fragment"),
        (c("repair_operation") == "repair_module_statement", "repair_top_level_module_statement"),
        (more("control_flow_added_count"), "add_missing_control_flow"),
        (more("control_flow_removed_count"), "remove_extra_control_flow"),
        (more("return_count_delta") | more("yield_count_delta"), "add_missing_return_or_yield"),
        (less("return_count_delta"), "simplify_extra_return_or_branch"),
        (more("constants_added_count") & more("gt_only_consts_count"), "restore_missing_literal_or_constant"),
        (more("constants_removed_count") & more("derived_only_consts_count"), "remove_extra_literal_or_constant"),
        (more("names_added_count") & (more("gt_only_names_count") | c("instruction_has_call_or_attr")), "restore_missing_expression_reference"),
        (more("names_removed_count") & more("derived_only_names_count"), "remove_extra_expression_reference"),
        (shaped("Return") | c("has_return_value"), returned),
        (changed("call_count_delta") | changed("attribute_count_delta"), called),
        (changed("compare_count_delta"), "adjust_comparison_expression"),
        (changed("boolop_count_delta"), "adjust_boolean_expression"),
        (changed("binop_count_delta") | changed("unaryop_count_delta"), "adjust_arithmetic_or_unary_expression"),
        (changed("subscript_count_delta"), "adjust_subscript_or_index_expression"),
        (changed("assign_count_delta") | shaped("Assign"), assigned),
        (c("has_call_or_attribute") | c("instruction_has_call_or_attr"), calls_there),
        (c("has_compare"), "adjust_comparison_expression"),
        (c("has_boolop"), "adjust_boolean_expression"),
        (c("has_arithmetic_or_unary"), "adjust_arithmetic_or_unary_expression"),
        (c("has_subscript"), "adjust_subscript_or_index_expression"),
        (c("has_assignment"), "adjust_assignment_value_or_target"),
        (~c("boundary_changed"), "preserve_structure_expression_edit"),
    ]
    out = F.lit("other_structural_edit")
    for test, label in reversed(rules):
        out = F.when(test, label if isinstance(label, Column) else F.lit(label)).otherwise(out)
    return out
