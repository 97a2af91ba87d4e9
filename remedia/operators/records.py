"""Records of accepted repair steps: telemetry cases and the dataset of accepted code objects, from one table of steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars

# The fields that make a case's identity, and those that records hold as they are.
FINGERPRINT = (
    "source_file_hash", "qualname", "repair_operation", "iteration", "step", "localized_line_number", "source_lineno", "source_col_offset", "source_end_lineno", "source_end_col_offset", "source_kind",
    "target_identity", "parent_target_identity", "gt_target_identity",
)
HEAD = ("run_id", "timestamp", "source_file_hash", "qualname", "repair_operation", "iteration", "step", "accepted", "acceptance_reason", "target_kind")
SPAN = ("localized_line_number", "source_lineno", "source_col_offset", "source_end_lineno", "source_end_col_offset", "parent_qualname", "source_kind", "target_identity", "parent_target_identity", "gt_target_identity")
REATTACHMENT = ("candidate_kind", "parse_ok", "parse_error", "structure_ok", "structure_reason")


def _of(steps: DataFrame):
    have = set(steps.columns)
    return lambda name: F.col(name) if name in have else F.lit(None).cast("string").alias(name)


def _verification(results: Column) -> Column:
    """all_equal, success_count and failed_targets of an array of results (names, success); NULL results have neither, and no failed targets."""
    good = lambda r: F.coalesce(r["success"], F.lit(False))
    count = F.size(F.filter(results, good))
    failed = F.filter(results, lambda r: ~good(r) & (F.coalesce(r["names"], F.lit("")) != ""))
    return F.struct(
        F.when(results.isNotNull(), F.forall(results, good)).alias("all_equal"), F.when(results.isNotNull(), count).alias("success_count"),
        F.coalesce(F.transform(failed, lambda r: r["names"]), F.array().cast("array<string>")).alias("failed_targets"),
    )


def _shared(steps: DataFrame) -> dict[str, Column]:
    at = _of(steps)
    delta = F.coalesce(at("combined_distance_delta"), at("target_distance_after") - at("target_distance_before")) if "target_distance_after" in steps.columns else at("combined_distance_delta")
    return {
        "reattachment": F.struct(*(at(f"reattachment_{n}").alias(n) for n in REATTACHMENT)),
        "pylingual_after": _verification(F.col("results")) if "results" in steps.columns else F.lit(None),
        "combined_distance_delta": delta,
    }


def telemetry_cases(steps: DataFrame) -> DataFrame:
    """One telemetry case an accepted step: identity, source span, fragments, context summary, distance change, reattachment and verification.

    Columns that ``steps`` lacks are NULL. Steps that weren't accepted have no record.
    """
    at, shared = _of(steps), _shared(steps)
    accepted = steps.filter(F.coalesce(F.col("accepted"), F.lit(False)))
    return accepted.select(
        scalars.case_id({n: at(n) for n in FINGERPRINT}).alias("case_id"), *(at(n).alias(n) for n in HEAD), F.struct(*(at(n).alias(n) for n in SPAN)).alias("source_span"),
        F.struct(
            at("failed_offset").alias("failed_offset"), at("alignment_tag").alias("alignment_tag"), (F.coalesce(F.length(at("instruction_diff")), F.lit(0)) > 0).alias("has_instruction_diff"),
            (F.coalesce(F.length(at("prompt")), F.lit(0)) > 0).alias("has_llm_prompt_record"),
        ).alias("repair_context_summary"),
        at("extracted_before").alias("before_fragment"), at("replacement_text").alias("after_fragment"), *(c.alias(n) for n, c in shared.items()), at("prompt").alias("prompt"),
    )


def accepted_objects(steps: DataFrame) -> DataFrame:
    """One dataset record an accepted step: what was replaced by what, where, on which evidence, and how it verified."""
    at, shared = _of(steps), _shared(steps)
    accepted = steps.filter(F.coalesce(F.col("accepted"), F.lit(False)))
    evidence = ("failed_offset", "alignment_tag", "gt_instruction_window", "derived_instruction_window", "instruction_diff")
    return accepted.select(
        *(at(n).alias(n) for n in HEAD), at("source_kind").alias("source_kind"), at("target_identity").alias("target_identity"), at("extracted_before").alias("extracted_before"),
        at("replacement_text").alias("replacement_text"), *(c.alias(n) for n, c in shared.items()), F.struct(*(at(n).alias(n) for n in evidence)).alias("bytecode_context"), at("prompt").alias("prompt"),
    )
