"""Where two instruction sequences diverge: opcode families, aligned context, run summaries, single-operand differences."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .alignment import bounded_window, diff_chunks, largest_chunk

# Opcode names of each family.
LOCAL_LOADS = ("LOAD_FAST", "LOAD_FAST_CHECK", "LOAD_FAST_AND_CLEAR", "LOAD_FAST_BORROW", "LOAD_DEREF", "LOAD_CLASSDEREF")
CONST_LOADS = ("LOAD_CONST", "LOAD_SMALL_INT", "RETURN_CONST", "LOAD_COMMON_CONSTANT")
ATTR_LOADS = ("LOAD_ATTR", "LOAD_METHOD", "LOAD_SUPER_ATTR")
RETURNS = ("RETURN_VALUE", "RETURN_CONST", "RETURN_GENERATOR")
UNCONDITIONAL_JUMPS = ("JUMP_FORWARD", "JUMP_BACKWARD", "JUMP_ABSOLUTE", "JUMP_BACKWARD_NO_INTERRUPT", "JUMP")
#: Rows of a control-flow skeleton, runs of a summary, chunks of a diagnosis.
SKELETON_ROWS, SUMMARY_RUNS, DIAGNOSIS_CHUNKS, CONTEXT_ROWS = 80, 6, 3, 40


def is_jump(op: Column) -> Column:
    return F.contains(op, F.lit("JUMP")) | op.isin("FOR_ITER", "SEND")


def is_conditional_jump(op: Column) -> Column:
    return is_jump(op) & ~op.isin(*UNCONDITIONAL_JUMPS)


def family(op: Column) -> Column:
    """One family for each opcode name."""
    return (
        F.when(is_conditional_jump(op), "conditional_jump").when(is_jump(op), "jump").when(op.isin(*RETURNS), "return").when(op.isin(*LOCAL_LOADS), "local_load")
        .when(op.isin(*CONST_LOADS), "const_load").when(op.isin(*ATTR_LOADS), "attr_load").when(F.startswith(op, F.lit("STORE_")), "store").when(F.startswith(op, F.lit("CALL")), "call").otherwise("other")
    )


def skeleton(instructions: Column) -> Column:
    """Jumps, jump targets and returns of an array of instruction structs, the first SKELETON_ROWS."""
    kept = F.filter(instructions, lambda i: is_jump(i["opname"]) | i["is_jump_target"] | i["opname"].isin(*RETURNS, "RAISE_VARARGS", "RERAISE", "PUSH_EXC_INFO"))
    return F.slice(kept, 1, SKELETON_ROWS)


def _names(rows) -> list[tuple[str, str]]:
    return [] if rows is None else [(r["opname"], r["argval"]) for r in rows]


def run_summary(gt: list, derived: list, most: int = SUMMARY_RUNS) -> list[str]:
    """What the derived side lacks, adds or changes, run by run."""
    out = []
    for tag, a, b, c, d in diff_chunks(gt, derived, most):
        ops = lambda rows: " ".join(f"{o}({x})" if x else o for o, x in rows)
        out.append({"delete": f"missing: {ops(gt[a:b])}", "insert": f"spurious: {ops(derived[c:d])}", "replace": f"changed: {ops(gt[a:b])} -> {ops(derived[c:d])}"}[tag])
    return out


def single_operand(gt: list, derived: list) -> tuple[int, str, str, str] | None:
    """(place, opcode, wanted, found) if the sequences differ in exactly one instruction's operand."""
    found = diff_chunks(gt, derived)
    if len(found) != 1 or found[0][0] != "replace" or found[0][2] - found[0][1] != 1 or found[0][4] - found[0][3] != 1:
        return None
    (op, wanted), (other, seen) = gt[found[0][1]], derived[found[0][3]]
    return (found[0][1], op, wanted, seen) if op == other else None


def contexts(pairs: DataFrame, key: str = "key", radius: int = 6) -> DataFrame:
    """key, n_chunks, largest (tag), gt_window, derived_window (places), summary, operand_op, wanted, found of pairs of instruction arrays.

    ``gt`` and ``derived`` are arrays of structs with opname and argval; ``failed`` is the derived place that failed or NULL.
    The windows are around the failing place, or else around the largest difference.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [key, "n_chunks", "largest", "gt_window", "derived_window", "summary", "operand_op", "wanted", "found"]
        for frame in batches:
            out = []
            for k, a, b, failed in zip(frame[key], frame["gt"], frame["derived"], frame["failed"]):
                gt, derived = _names(a), _names(b)
                chunk = largest_chunk(gt, derived)
                at = (chunk[1], chunk[2], chunk[3], chunk[4]) if chunk else (0, 0, 0, 0)
                if failed is not None and not pd.isna(failed):
                    at = (int(failed), int(failed) + 1, int(failed), int(failed) + 1)
                one = single_operand(gt, derived) or (None, None, None, None)
                windows = bounded_window(len(gt), at[0], at[1], radius, CONTEXT_ROWS), bounded_window(len(derived), at[2], at[3], radius, CONTEXT_ROWS)
                out.append((k, len(diff_chunks(gt, derived)), chunk[0] if chunk else None, *windows, run_summary(gt, derived), *one[1:]))
            yield pd.DataFrame(out, columns=columns)

    kind = pairs.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, n_chunks long, largest string, gt_window array<long>, derived_window array<long>, summary array<string>, operand_op string, wanted string, found string"
    return pairs.select(key, "gt", "derived", "failed").mapInPandas(run, schema)
