"""Schemas of the tables that the pipeline reads and writes. Versions are text: inference would turn 3.10 into 3.1."""

from __future__ import annotations

from pyspark.sql import types as T


def schema(ddl: str) -> T.StructType:
    """A schema from "name type" pairs (simple types and arrays of them), without needing a session."""
    simple = {"string": T.StringType(), "int": T.IntegerType(), "bigint": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "timestamp": T.TimestampType()}
    fields = []
    for part in ddl.replace("\n", " ").split(","):
        name, kind = part.split()
        fields.append(T.StructField(name, T.ArrayType(simple[kind[6:-1]]) if kind.startswith("array<") else simple[kind]))
    return T.StructType(fields)


DATASET = schema(
    "file_hash string, source string, error_type string, bytecode_version string, file string, file_path string, decompiler string, dataset string, error string, error_message string, "
    "error_description string, syntactic_error_message string, syntactic_error_word string, gt_pyc string, derived_pyc string, derived_source string, gt_source string"
)
RUN_LOG = schema(
    "run_id string, timestamp timestamp, file_hash string, file_name string, row_index int, total_attempts_allowed int, retries_allowed int, path_in string, path_out string, bytecode_version string, "
    "decompiler string, dataset string, input_file_size_bytes bigint, max_whole_file_bytes bigint, compile_error_word_before string, compile_error_message_before string, compile_error_word_after string, "
    "compile_error_message_after string, compiled_success boolean, total_attempts_completed int, llm_calls int, llm_latency_ms_total bigint, compile_latency_ms bigint, delete_only_mode boolean, "
    "delete_only_fallback_used boolean, delete_only_deletions int, lines_deleted_vs_original int, forced_compile_used boolean, forced_compile_neutralised_lines int, lossy_literal_closure boolean, "
    "deterministic_prepass_used boolean, deterministic_prepass_operations array<string>, deterministic_cascade_stage int, deterministic_control_flow_rewrites array<string>, payload_elision_used boolean, "
    "skipped_due_to_file_size_guard boolean, skipped_due_to_blob_window boolean, segment_kind string, segment_line_roles array<string>"
)
VERIFICATION = schema(
    "file string, names string, pylingual_occurrence_index int, duplicate_name_count int, result_key string, success boolean, message string, failed_line_number int, failed_offset int"
)
CFG_NODE = schema("file string, side string, object string, node int, min_offset int, category string, opcode_seq array<string>, inst_count int, starts_with string, ends_with string")
CFG_EDGE = schema("file string, side string, object string, src int, dst int, kind string")
DISTANCE_ROW = schema(
    "code_object string, gt_name string, derived_name string, status string, gt_inst_count int, derived_inst_count int, instruction_distance int, control_flow_distance int, control_flow_weight int, "
    "interaction_penalty int, unmatched_penalty int, exception_table_distance int, combined_distance int, instruction_basis int, cfg_basis int, normalized_instruction_distance double, "
    "normalized_cfg_distance double, normalized_interaction_penalty double, normalized_unmatched_penalty double, normalized_combined_distance double"
)
INSTRUCTION = schema("opname string, opcode int, optype string, real_size int, has_arg boolean, has_extended_arg boolean, is_jump_target boolean, argval string")
EXCEPTION_ENTRY = schema("start int, end int, target int, depth int")
CODE_OBJECT = T.StructType(
    [
        *schema(
            "file string, side string, ord int, name string, inst_count int, cfg_complexity_basis int, unmatched_instruction_distance int, unmatched_cfg_distance int, block_count int, "
            "branch_count int, loop_header_count int, exception_edge_count int"
        ),
        T.StructField("instruction_signatures", T.ArrayType(INSTRUCTION)),
        T.StructField("exception_table", T.ArrayType(EXCEPTION_ENTRY)),
    ]
)
