"""Catalogue queries: retrieval, mining, distances and graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import labels, scoring
from ..operators import alignment, distance, mining, retrieval
from . import views as v
from .catalogue import query


@query(v.PATTERNS, v.pairs_sql(), sql="SELECT q_idx, p_idx, action_type, score FROM pairs")
def pattern_scores(spark: SparkSession, d: str) -> DataFrame:
    rows = v.patterns(spark, d)
    return retrieval.pair_scores(rows, rows).withColumn("score", F.col("score").cast("long"))


@query(v.PATTERNS, v.pairs_sql(True), sql="SELECT action_type, score, count(*) AS n_pairs FROM pairs GROUP BY 1, 2")
def pattern_scores_runtime(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.score_counts(v.patterns(spark, d), runtime=True).withColumn("score", F.col("score").cast("long"))


@query(v.PATTERNS, v.pairs_sql(), v.RANKED, sql="SELECT q_idx, action_type, best_idx, best, adjusted, nth FROM top")
def retrieve_topk(spark: SparkSession, d: str) -> DataFrame:
    rows = v.patterns(spark, d)
    return retrieval.retrieve_topk(rows, rows)


@query(v.PATTERNS, v.pairs_sql(), v.RANKED, sql="""SELECT action_type, count(*) AS evaluated, count(*) FILTER (WHERE n = 0) AS no_retrieval, count(*) FILTER (WHERE one) AS top1_hits, count(*) FILTER (WHERE hit) AS topk_hits
  FROM (SELECT p.row_idx, p.action_type, count(t.q_idx) AS n, coalesce(bool_or(t.action_type = p.action_type AND nth = 1), false) AS one, coalesce(bool_or(t.action_type = p.action_type), false) AS hit
    FROM patterns p LEFT JOIN top t ON p.row_idx = t.q_idx WHERE p.action_type <> '' GROUP BY 1, 2) GROUP BY 1""")  # fmt: skip
def leave_one_out(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.leave_one_out(v.patterns(spark, d))


def _telemetry(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("p_partkey")
    return v.table(spark, d, "part").select(
        key.alias("row_idx"), F.when(key % 3 == 0, "v1").when(key % 3 == 1, "v2").alias("prompt_variant"), F.col("p_type").alias("repair_operation"),
        F.col("p_brand").alias("target_kind"), F.element_at(F.split("p_name", " "), 1).alias("alignment_tag"), F.element_at(F.split("p_name", " "), 2).alias("qualname"), (F.col("p_size") > 25).alias("accepted"),
    )


@query("""t AS (SELECT p_partkey AS row_idx, CASE p_partkey % 3 WHEN 0 THEN 'v1' WHEN 1 THEN 'v2' END AS prompt_variant, p_type AS repair_operation, p_brand AS target_kind,
  string_split(p_name, ' ')[1] AS alignment_tag, string_split(p_name, ' ')[2] AS qualname, p_size > 25 AS accepted FROM part)""", sql="""SELECT q_idx, p_idx, score, nth FROM (
  SELECT *, row_number() OVER (PARTITION BY q_idx ORDER BY score DESC, p_idx) AS nth FROM (
    SELECT q.row_idx AS q_idx, p.row_idx AS p_idx, (CASE WHEN q.prompt_variant IS NOT DISTINCT FROM p.prompt_variant THEN 4 ELSE 0 END + 5 + CASE WHEN q.target_kind = p.target_kind THEN 3 ELSE 0 END
      + CASE WHEN q.alignment_tag = p.alignment_tag THEN 2 ELSE 0 END + CASE WHEN q.qualname = p.qualname THEN 1 ELSE 0 END + 1)::BIGINT AS score
    FROM t q JOIN t p ON p.accepted AND q.repair_operation = p.repair_operation AND (p.prompt_variant IS NULL OR p.prompt_variant IS NOT DISTINCT FROM q.prompt_variant) WHERE q.row_idx % 20 = 0)) WHERE nth <= 3""")  # fmt: skip
def telemetry_top3(spark: SparkSession, d: str) -> DataFrame:
    """The three most similar accepted cases of each twentieth case (the cases that ask are a stated query set)."""
    cases = _telemetry(spark, d)
    return retrieval.telemetry_top(cases.filter("row_idx % 20 = 0"), cases)


@query(sql="""WITH r AS (SELECT user_id AS q_idx, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS back, [event_type, CASE WHEN value > 20 THEN 'error' ELSE '' END, 'view', 'click'] AS l FROM events),
  e AS (SELECT q_idx, back, unnest(list_filter(l, lambda x: x <> '')[1:3]) AS action_type, generate_subscripts(list_filter(l, lambda x: x <> '')[1:3], 1) - 1 AS place FROM r WHERE back <= 3)
  SELECT q_idx, action_type, max(CASE WHEN back = 1 AND place = 0 THEN 18 WHEN back = 1 OR place = 0 THEN 8 ELSE 4 END)::BIGINT AS penalty FROM e GROUP BY 1, 2""")  # fmt: skip
def rejection_penalties(spark: SparkSession, d: str) -> DataFrame:
    named = F.array("event_type", F.when(F.col("value") > 20, "error").otherwise(""), F.lit("view"), F.lit("click"))
    rows = v.table(spark, d, "events").select(F.col("user_id").alias("q_idx"), F.struct("ts", "event_id").alias("attempt"), named.alias("action_types"))
    return retrieval.rejection_penalties(rows)


@query(v.PATTERNS, sql="""SELECT action_type, count(*) AS n_cases, round(avg(combined_distance_delta), 6) AS mean_delta, min(combined_distance_delta)::BIGINT AS min_delta, min_by(case_id, row_idx) AS example FROM patterns GROUP BY 1""")
def action_summary(spark: SparkSession, d: str) -> DataFrame:
    return mining.action_summary(v.patterns(spark, d))


@query(v.PATTERNS, sql="SELECT action_type, count(*) AS n_cases, min(row_idx) AS first_idx FROM patterns GROUP BY 1 ORDER BY 2 DESC, 3")
def action_counts(spark: SparkSession, d: str) -> DataFrame:
    return mining.action_counts(v.patterns(spark, d))


@query(v.PATTERNS, sql="SELECT row_idx, action_type, combined_distance_delta FROM patterns ORDER BY combined_distance_delta ASC NULLS LAST, row_idx LIMIT 200")
def top_deltas(spark: SparkSession, d: str) -> DataFrame:
    return mining.lowest_deltas(v.patterns(spark, d)).select("row_idx", "action_type", "combined_distance_delta")


@query(v.PATTERNS, sql="""SELECT repair_operation, value, n, nth FROM (SELECT *, row_number() OVER (PARTITION BY repair_operation ORDER BY n DESC, first_idx, value) AS nth FROM (
  SELECT repair_operation, value, count(*) AS n, min(row_idx) AS first_idx FROM (SELECT repair_operation, row_idx, unnest(source_shape_before) AS value FROM patterns) GROUP BY 1, 2)) WHERE nth <= 5""")  # fmt: skip
def top_values_in_arrays(spark: SparkSession, d: str) -> DataFrame:
    rows = v.patterns(spark, d).withColumn("kinds", F.array_distinct(F.split("source_shape_before", ",")))
    return mining.top_values(rows, "repair_operation", "kinds")


_EDIT = """edits AS (SELECT p_partkey AS row_idx, ['insert_missing', 'repair_module_statement', 'repair_source_fragment', 'repair_source_fragment', 'repair_source_fragment'][(p_partkey % 5 + 1)::INT] AS op,
  ['x-insert', 'delete', 'REPLACE', '', 'other', NULL][(p_partkey % 6 + 1)::INT] AS tag, p_size AS s, p_partkey AS k FROM part)"""


@query(_EDIT, sql="""SELECT row_idx,
  CASE WHEN contains(lower(coalesce(tag, '')), 'insert') OR op = 'insert_missing' THEN 'insert' WHEN lower(tag) = 'delete' THEN 'delete' WHEN lower(tag) = 'replace' THEN 'replace'
    WHEN op = 'repair_module_statement' THEN 'module_statement' WHEN coalesce(tag, '') <> '' THEN lower(tag) ELSE 'unknown' END AS indexed,
  CASE WHEN op = 'insert_missing' THEN 'insert' WHEN op = 'repair_module_statement' THEN 'module_statement' WHEN contains(lower(coalesce(tag, '')), 'insert') THEN 'insert' WHEN lower(tag) = 'delete' THEN 'delete'
    WHEN lower(tag) = 'replace' THEN 'replace' WHEN coalesce(tag, '') <> '' THEN lower(tag) ELSE 'unknown' END AS queried FROM edits""")  # fmt: skip
def alignment_categories(spark: SparkSession, d: str) -> DataFrame:
    rows = _edits(spark, d)
    return rows.select("row_idx", labels.indexed_alignment(F.col("repair_operation"), F.col("tag")).alias("indexed"), labels.queried_alignment(F.col("repair_operation"), F.col("tag")).alias("queried"))


def _edits(spark: SparkSession, d: str) -> DataFrame:
    k, s = F.col("p_partkey"), F.col("p_size")
    pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (k % n + 1).cast("int"))
    zero = F.lit(0)
    flags = {"instruction_has_kw_names": s % 7 == 0, "instruction_has_call_or_attr": s % 11 == 0, "has_return_value": F.lit(False), "has_call_or_attribute": s % 3 == 0, "has_compare": s % 5 == 0}
    flags |= {"has_boolop": s % 7 == 1, "has_arithmetic_or_unary": s % 7 == 2, "has_subscript": s % 7 == 3, "has_assignment": s % 2 == 0, "boundary_changed": k % 2 == 0}
    when = lambda i, value=1: F.when(s == i, value).otherwise(zero)
    counts = {
        "control_flow_added_count": when(1), "control_flow_removed_count": when(2), "return_count_delta": F.when(s == 3, 1).when(s == 4, -1).otherwise(0), "yield_count_delta": when(5),
        "constants_added_count": when(6), "gt_only_consts_count": k % 2, "constants_removed_count": when(7), "derived_only_consts_count": k % 2, "names_added_count": when(8), "gt_only_names_count": k % 3,
        "names_removed_count": when(9), "derived_only_names_count": k % 2, "call_count_delta": F.when(s.isin(14, 15, 16), 1).otherwise(0), "attribute_count_delta": F.when(s.isin(15, 17), -1).otherwise(0),
        "call_arg_count_delta": when(16), "call_keyword_count_delta": zero, "compare_count_delta": when(18), "boolop_count_delta": when(19), "binop_count_delta": when(20), "unaryop_count_delta": when(21),
        "subscript_count_delta": when(22), "assign_count_delta": when(23),
    }
    text = {
        "source_shape_before": F.when(s.isin(10, 11, 12, 13), "If,Return").when(s == 24, "AnnAssign").otherwise(""), "source_shape_after": F.lit(""),
        "return_value_kinds_before": F.when(s == 10, "Call").when(s == 11, "Compare").otherwise(""), "return_value_kinds_after": F.when(s == 12, "Attribute").otherwise(""),
        "assign_value_kinds_before": F.when(k % 3 == 0, "Call").otherwise(""), "assign_value_kinds_after": F.when(k % 3 == 1, "Constant,Name").otherwise(""),
    }
    base = {"row_idx": k, "repair_operation": pick(("insert_missing", "repair_module_statement", "repair_source_fragment", "repair_source_fragment", "repair_source_fragment"), 5), "tag": pick(("x-insert", "delete", "REPLACE", "", "other", None), 6)}
    return v.table(spark, d, "part").select(*(c.alias(n) for n, c in (base | flags | counts | text).items()))


@query(_EDIT, sql="""SELECT row_idx, CASE WHEN op = 'insert_missing' THEN 'insert_missing_definition_fragment' WHEN op = 'repair_module_statement' THEN 'repair_top_level_module_statement'
  WHEN s = 1 THEN 'add_missing_control_flow' WHEN s = 2 THEN 'remove_extra_control_flow' WHEN s IN (3, 5) THEN 'add_missing_return_or_yield' WHEN s = 4 THEN 'simplify_extra_return_or_branch'
  WHEN s = 6 AND k % 2 > 0 THEN 'restore_missing_literal_or_constant' WHEN s = 7 AND k % 2 > 0 THEN 'remove_extra_literal_or_constant' WHEN s = 8 AND k % 3 > 0 THEN 'restore_missing_expression_reference'
  WHEN s = 9 AND k % 2 > 0 THEN 'remove_extra_expression_reference' WHEN s = 10 THEN 'adjust_return_call_expression' WHEN s = 11 THEN 'adjust_return_condition_expression' WHEN s = 12 THEN 'adjust_return_attribute_expression'
  WHEN s = 13 THEN 'adjust_return_expression' WHEN s IN (14, 15, 16, 17) THEN CASE WHEN s = 16 OR s % 7 = 0 THEN 'adjust_call_arguments' WHEN s = 15 THEN 'adjust_method_vs_attribute_access' WHEN s = 17 THEN 'adjust_attribute_access' ELSE 'adjust_call_or_attribute_expression' END
  WHEN s = 18 THEN 'adjust_comparison_expression' WHEN s = 19 THEN 'adjust_boolean_expression' WHEN s IN (20, 21) THEN 'adjust_arithmetic_or_unary_expression' WHEN s = 22 THEN 'adjust_subscript_or_index_expression'
  WHEN s IN (23, 24) THEN CASE k % 3 WHEN 0 THEN 'adjust_assignment_call_value' WHEN 1 THEN 'adjust_assignment_literal_value' ELSE 'adjust_assignment_value_or_target' END
  WHEN s % 3 = 0 OR s % 11 = 0 THEN CASE WHEN s % 7 = 0 THEN 'adjust_call_arguments' ELSE 'adjust_call_or_attribute_expression' END WHEN s % 5 = 0 THEN 'adjust_comparison_expression' WHEN s % 7 = 1 THEN 'adjust_boolean_expression'
  WHEN s % 7 = 2 THEN 'adjust_arithmetic_or_unary_expression' WHEN s % 7 = 3 THEN 'adjust_subscript_or_index_expression' WHEN s % 2 = 0 THEN 'adjust_assignment_value_or_target'
  WHEN k % 2 <> 0 THEN 'preserve_structure_expression_edit' ELSE 'other_structural_edit' END AS action_type FROM edits""")  # fmt: skip
def classify_action(spark: SparkSession, d: str) -> DataFrame:
    return _edits(spark, d).select("row_idx", labels.action(F.col).alias("action_type"))


@query(v.PATTERNS, sql="""SELECT round(corr(size, price), 6) AS pearson, round(corr(rs, rp), 6) AS spearman, count(*) AS n FROM (SELECT size, price, rank() OVER (ORDER BY size) + (count(*) OVER (PARTITION BY size) - 1) / 2 AS rs,
  rank() OVER (ORDER BY price) + (count(*) OVER (PARTITION BY price) - 1) / 2 AS rp FROM patterns)""")  # fmt: skip
def pearson_spearman(spark: SparkSession, d: str) -> DataFrame:
    rows = distance.average_ranks(distance.average_ranks(v.patterns(spark, d).select("row_idx", "size", "price"), "size", "rs"), "price", "rp")
    return rows.agg(F.round(distance.pearson("size", "price"), 6).alias("pearson"), F.round(distance.pearson("rs", "rp"), 6).alias("spearman"), F.count("*").alias("n"))


_CFG = """deg AS (SELECT graph, src, count(*) AS degree FROM edges GROUP BY 1, 2),
counts AS (SELECT b.graph, count(*) AS n_blocks, coalesce(sum(degree), 0)::BIGINT AS n_edges, count(*) FILTER (WHERE degree > 1) AS n_branches FROM blocks b LEFT JOIN deg ON b.graph = deg.graph AND block = src GROUP BY 1)"""


@query(v.GRAPH, _CFG, sql="SELECT graph, n_blocks, n_edges, n_branches FROM counts")
def cfg_counts(spark: SparkSession, d: str) -> DataFrame:
    return distance.graph_counts(v.edges(spark, d), v.blocks(spark, d))


def _graph_pairs(spark: SparkSession, d: str) -> DataFrame:
    have = v.table(spark, d, "events").select(F.col("user_id").alias("a")).distinct()
    return have.join(have.select((F.col("a") - 1).alias("a")), "a", "left_semi").withColumn("b", F.col("a") + 1)


_KINDS = """kinds AS (SELECT graph, kind, count(*) AS n FROM edges GROUP BY 1, 2),
l1 AS (SELECT p.a, p.b, sum(abs(coalesce(x.n, 0) - coalesce(y.n, 0)))::BIGINT AS kind_diff FROM graph_pairs p CROSS JOIN (SELECT DISTINCT kind FROM edges) k
  LEFT JOIN kinds x ON x.graph = p.a AND x.kind = k.kind LEFT JOIN kinds y ON y.graph = p.b AND y.kind = k.kind GROUP BY 1, 2)"""


@query(v.GRAPH, _KINDS, sql="SELECT a, b, kind_diff FROM l1")
def edge_histogram_l1(spark: SparkSession, d: str) -> DataFrame:
    return distance.flow_distances(_graph_pairs(spark, d), distance.graphs(v.edges(spark, d), v.blocks(spark, d))).select("a", "b", "kind_diff")


_HEURISTIC = """placed AS (SELECT e.graph, s.place AS s, t.place AS t FROM edges e JOIN blocks s ON s.graph = e.graph AND s.block = e.src JOIN blocks t ON t.graph = e.graph AND t.block = e.dst),
succ AS (SELECT a, b, count(*)::BIGINT AS successor_diff FROM (
  SELECT p.a, p.b, s, t, count(*) AS c FROM graph_pairs p JOIN counts x ON x.graph = p.a JOIN counts y ON y.graph = p.b JOIN placed e ON e.graph IN (p.a, p.b)
  WHERE s < least(x.n_blocks, y.n_blocks) AND (e.graph = p.b OR t < least(x.n_blocks, y.n_blocks)) GROUP BY ALL HAVING count(*) = 1) GROUP BY 1, 2),
terms AS (SELECT p.a, p.b, abs(x.n_blocks - y.n_blocks) AS block_diff, abs(x.n_edges - y.n_edges) AS edge_diff, abs(x.n_branches - y.n_branches) AS branch_diff, kind_diff, coalesce(successor_diff, 0) AS successor_diff
  FROM graph_pairs p JOIN counts x ON x.graph = p.a JOIN counts y ON y.graph = p.b JOIN l1 ON l1.a = p.a AND l1.b = p.b LEFT JOIN succ ON succ.a = p.a AND succ.b = p.b)"""


@query(v.GRAPH, _CFG, _KINDS, _HEURISTIC, sql="""SELECT *, block_diff + edge_diff + branch_diff + kind_diff + successor_diff AS heuristic, block_diff = 0 AND successor_diff = 0 AS equivalent,
  CASE WHEN block_diff = 0 AND successor_diff = 0 THEN 0 ELSE block_diff + edge_diff + branch_diff + kind_diff + successor_diff END AS distance FROM terms""")  # fmt: skip
def cfg_heuristic(spark: SparkSession, d: str) -> DataFrame:
    return distance.flow_distances(_graph_pairs(spark, d), distance.graphs(v.edges(spark, d), v.blocks(spark, d)))


_DISTANCE = """dist AS (SELECT file, status, s AS instruction_distance, c AS control_flow_distance, ib AS instruction_basis, cb AS cfg_basis, u AS unmatched_penalty,
    CASE WHEN s > 0 AND c > 0 THEN least(s, c, 3) ELSE 0 END AS interaction_penalty, s + 3 * c + CASE WHEN s > 0 AND c > 0 THEN least(s, c, 3) ELSE 0 END + u AS combined_distance FROM (
  SELECT l_orderkey AS file, CASE l_returnflag WHEN 'A' THEN 'matched' WHEN 'R' THEN 'missing' ELSE 'extra' END AS status, l_quantity::BIGINT AS s, l_suppkey % 4 AS c, l_quantity::BIGINT + 5 AS ib, 1 + l_partkey % 3 AS cb,
    CASE l_returnflag WHEN 'A' THEN 0 WHEN 'R' THEN 4 ELSE 2 END AS u FROM lineitem)),
norm AS (SELECT *, instruction_distance / instruction_basis AS ni, control_flow_distance / cfg_basis AS nc, interaction_penalty / least(instruction_basis, cfg_basis) AS nx, unmatched_penalty / (instruction_basis + cfg_basis) AS nu FROM dist)"""


def _distance_rows(spark: SparkSession, d: str) -> DataFrame:
    flag = F.col("l_returnflag")
    rows = v.table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("file"), F.when(flag == "A", "matched").when(flag == "R", "missing").otherwise("extra").alias("status"), F.col("l_quantity").cast("long").alias("instruction_distance"),
        (F.col("l_suppkey") % 4).alias("control_flow_distance"), (F.col("l_quantity").cast("long") + 5).alias("instruction_basis"), (F.col("l_partkey") % 3 + 1).alias("cfg_basis"),
    )
    return distance.comparison_rows(rows)


@query(_DISTANCE, sql="SELECT status, combined_distance, count(*) AS n, sum(interaction_penalty)::BIGINT AS interaction FROM norm GROUP BY 1, 2")
def combined_distance(spark: SparkSession, d: str) -> DataFrame:
    return _distance_rows(spark, d).groupBy("status", "combined_distance").agg(F.count("*").alias("n"), F.sum("interaction_penalty").cast("long").alias("interaction"))


@query(_DISTANCE, sql="""SELECT file, count(*) FILTER (WHERE status <> 'extra') AS gt_code_object_count, count(*) FILTER (WHERE status <> 'missing') AS derived_code_object_count, sum(combined_distance)::BIGINT AS combined_distance,
  sum(instruction_distance)::BIGINT AS instruction_distance, sum(control_flow_distance)::BIGINT AS control_flow_distance, sum(interaction_penalty)::BIGINT AS interaction_penalty, sum(unmatched_penalty)::BIGINT AS unmatched_penalty,
  round(avg(ni), 6) AS normalized_instruction_distance, round(avg(nc), 6) AS normalized_cfg_distance, round(avg(nx), 6) AS normalized_interaction_penalty, round(avg(nu), 6) AS normalized_unmatched_penalty,
  round(avg(ni + 3 * nc + nx + nu), 6) AS normalized_combined_distance FROM norm GROUP BY 1""")  # fmt: skip
def file_rollup(spark: SparkSession, d: str) -> DataFrame:
    return distance.file_rollup(_distance_rows(spark, d), "file")


_SEQ = "seq AS (SELECT conv_id, turn AS idx, role AS op, (length(text) % 7)::VARCHAR AS arg FROM conversations)"


def _sequences(spark: SparkSession, d: str) -> DataFrame:
    step = F.struct(F.col("role").alias("opcode"), (F.length("text") % 7).cast("string").alias("argval"), (F.col("turn") % 2 == 0).alias("is_jump_target"))
    rows = v.table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", step.alias("s")))).alias("all"))
    return rows.select("conv_id", F.transform("all", lambda x: x["s"]).alias("steps"))


def _sequence_pairs(spark: SparkSession, d: str) -> DataFrame:
    rows = _sequences(spark, d)
    other = rows.select((F.col("conv_id") - 1).alias("conv_id"), F.col("steps").alias("other"))
    return rows.join(other, "conv_id")


@query("x AS (SELECT conv_id, turn, role AS op, length(text) % 7 AS arg, turn % 2 = 0 AS t FROM conversations)", sql="""SELECT a.conv_id, a.turn AS i, b.turn AS j,
  CASE WHEN a.op = b.op AND a.arg = b.arg AND a.t = b.t THEN 0 WHEN (a.op = b.op) <> (a.arg = b.arg) THEN 1 ELSE 2 END AS cost FROM x a JOIN x b ON b.conv_id = a.conv_id + 1""")  # fmt: skip
def substitution_cost(spark: SparkSession, d: str) -> DataFrame:
    step = v.table(spark, d, "conversations").select("conv_id", "turn", F.col("role").alias("opcode"), (F.length("text") % 7).alias("argval"), (F.col("turn") % 2 == 0).alias("is_jump_target"))
    a, b = step.alias("a"), step.withColumn("conv_id", F.col("conv_id") - 1).alias("b")
    of = lambda s: lambda n: F.col(f"{s}.{n}")
    cost = distance.substitution_cost(of("a"), of("b"), ["opcode", "argval", "is_jump_target"])
    return a.join(b, F.col("a.conv_id") == F.col("b.conv_id")).select("a.conv_id", F.col("a.turn").alias("i"), F.col("b.turn").alias("j"), cost.alias("cost"))


@query(sql="""WITH RECURSIVE x AS (SELECT conv_id, list({'op': role, 'arg': length(text) % 7, 't': turn % 2 = 0} ORDER BY turn) AS s FROM conversations GROUP BY 1),
p AS (SELECT a.conv_id, a.s AS a, b.s AS b, len(a.s) AS n, len(b.s) AS m FROM x a JOIN x b ON b.conv_id = a.conv_id + 1),
cell(conv_id, k, costs) AS (
  SELECT conv_id, 0, []::BIGINT[] FROM p
  UNION ALL
  SELECT conv_id, k + 1, list_append(costs, CASE WHEN i = 0 THEN 2 * j WHEN j = 0 THEN 2 * i ELSE least(costs[k - m - 1] + CASE WHEN a[i].op = b[j].op AND a[i].arg = b[j].arg AND a[i].t = b[j].t THEN 0 WHEN (a[i].op = b[j].op) <> (a[i].arg = b[j].arg) THEN 1 ELSE 2 END,
    costs[k - m] + 2, costs[k] + 2) END) FROM (SELECT c.*, a, b, m, k // (m + 1) AS i, k % (m + 1) AS j FROM cell c JOIN p USING (conv_id) WHERE k < (n + 1) * (m + 1)))
SELECT conv_id, costs[-1] AS distance FROM cell JOIN p USING (conv_id) WHERE k = (n + 1) * (m + 1)""")  # fmt: skip
def weighted_edit_distance(spark: SparkSession, d: str) -> DataFrame:
    """Edit distance of each conversation's steps and the next one's (tested against the textbook recursion)."""
    return _sequence_pairs(spark, d).select("conv_id", distance.edit_distance("steps", "other").alias("distance"))


@query()
def align_sequences(spark: SparkSession, d: str) -> DataFrame:
    """Non-equal chunks between each conversation's roles and the next one's (tested against the standard library)."""
    names = lambda c: F.transform(c, lambda s: F.concat_ws(":", s["opcode"], s["argval"]))
    pairs = _sequence_pairs(spark, d).select(F.col("conv_id").alias("key"), names(F.col("steps")).alias("gt"), names(F.col("other")).alias("derived"))
    return alignment.sequence_diffs(pairs)


@query()
def align_objects(spark: SparkSession, d: str) -> DataFrame:
    """Ordered alignment of the names on both sides of each region's tree."""
    rows = v.tree(spark, d).select("file", "row_idx", F.explode(F.array(F.struct(F.lit("gt").alias("side"), F.col("gt_name").alias("name")), F.struct(F.lit("derived").alias("side"), F.col("derived_name").alias("name")))).alias("o"))
    return alignment.align_objects(rows.select("file", "o.side", F.col("row_idx").alias("ord"), "o.name").filter("name IS NOT NULL"))


@query(sql="""WITH e AS (SELECT user_id AS k, event_id, epoch_ms(ts) // 60000 AS line, event_type FROM events),
  n AS (SELECT a.k, a.event_id AS left_idx, b.event_id AS right_idx, abs(a.line - b.line) AS gap, row_number() OVER w AS r, lead(abs(a.line - b.line)) OVER w AS next FROM e a JOIN e b ON a.k = b.k AND abs(a.line - b.line) <= 60
    WHERE a.event_type = 'click' AND b.event_type = 'view' WINDOW w AS (PARTITION BY a.event_id ORDER BY abs(a.line - b.line), b.event_id))
  SELECT k AS user_id, left_idx, right_idx, gap FROM n WHERE r = 1 AND (next IS NULL OR gap < next)""")  # fmt: skip
def nearest_line(spark: SparkSession, d: str) -> DataFrame:
    rows = v.table(spark, d, "events").select("user_id", F.call_function("div", v.epoch_ms(F.col("ts")), F.lit(60000)).alias("line"), F.col("event_id").alias("idx"), "event_type")
    return alignment.nearest_lines(rows.filter("event_type = 'click'"), rows.filter("event_type = 'view'"), "user_id", reach=60)


@query(sql="""SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) - 1 AS occurrence, count(*) OVER (PARTITION BY user_id, event_type) AS duplicates FROM events""")
def occurrence_index(spark: SparkSession, d: str) -> DataFrame:
    keys = ("user_id", "event_type")
    return v.table(spark, d, "events").select("event_id", alignment.occurrence_index(["ts", "event_id"], *keys).cast("long").alias("occurrence"), alignment.duplicate_count(*keys).alias("duplicates"))


_MAP = """src AS (SELECT c_nationkey AS file, c_mktsegment AS scope, c_custkey % 50 AS line, row_number() OVER (PARTITION BY c_nationkey, c_mktsegment, c_custkey % 50 ORDER BY c_custkey) - 1 AS occ FROM customer WHERE c_custkey % 3 <> 0),
pyc AS (SELECT c_nationkey AS file, c_mktsegment AS scope, c_custkey % 50 AS line, row_number() OVER (PARTITION BY c_nationkey, c_mktsegment, c_custkey % 50 ORDER BY c_custkey) - 1 AS occ FROM customer WHERE c_custkey % 4 <> 0)"""


def _objects(spark: SparkSession, d: str, skip: int) -> DataFrame:
    keys = ("file", "scope_path", "line")
    rows = v.table(spark, d, "customer").filter(F.col("c_custkey") % skip != 0).select(F.col("c_nationkey").alias("file"), F.col("c_mktsegment").alias("scope_path"), (F.col("c_custkey") % 50).alias("line"), F.lit("f").alias("base_name"), "c_custkey")
    return rows.withColumn("occurrence", (F.row_number().over(Window.partitionBy(*keys).orderBy("c_custkey")) - 1).cast("long"))


@query(_MAP, sql="""SELECT coalesce(s.file, p.file) AS file, coalesce(s.scope, p.scope) AS scope_path, 'f' AS base_name, coalesce(s.line, p.line) AS line, coalesce(s.occ, p.occ) AS occurrence,
  CASE WHEN s.file IS NULL THEN 'pyc_only' WHEN p.file IS NULL THEN 'source_only' ELSE 'mapped' END AS row_type FROM src s FULL OUTER JOIN pyc p ON s.file = p.file AND s.scope = p.scope AND s.line = p.line AND s.occ = p.occ""")  # fmt: skip
def mapping_outer(spark: SparkSession, d: str) -> DataFrame:
    return alignment.exact_mapping(_objects(spark, d, 3), _objects(spark, d, 4))


@query()
def mapping_fallback(spark: SparkSession, d: str) -> DataFrame:
    """The whole mapping cascade with its reasons, file by file (tested on hand-made files)."""
    side = lambda rows, name: rows.select("file", F.lit(name).alias("side"), F.col("c_custkey").alias("idx"), "scope_path", "base_name", "line", "occurrence", F.format_string("%d.%d", "line", "occurrence").alias("ordinal_path"), F.lit(0).alias("child_count"))
    return alignment.map_objects(side(_objects(spark, d, 3), "source").unionByName(side(_objects(spark, d, 4), "pyc")))


@query(v.PATTERNS, sql="SELECT repair_operation, strategy_idx, strategy, count(*) AS n FROM (SELECT repair_operation, unnest(['retrieval_guided', 'control_flow_residual', 'call_attribute_residual']) AS strategy, unnest([0, 1, 2]) AS strategy_idx FROM patterns) GROUP BY ALL")
def strategy_explode(spark: SparkSession, d: str) -> DataFrame:
    rows = mining.strategies(v.patterns(spark, d), list(STRATEGIES), 3)
    return rows.groupBy("repair_operation", "strategy_idx", "strategy").agg(F.count("*").alias("n"))


# Candidate strategies in order.
STRATEGIES = ("retrieval_guided", "control_flow_residual", "call_attribute_residual", "metadata_literal_name_residual", "conservative_minimal_delta")
LEAST_SCORE = scoring.LEAST
