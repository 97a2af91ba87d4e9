"""Repair-shaped views of the driver's tables, in Spark and as SQL text of the same meaning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scoring


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch_ms(ts: Column) -> Column:
    """Milliseconds since 1970 as DuckDB's epoch_ms gives them: microseconds are rounded, halves away from zero."""
    micros = F.unix_micros(ts.cast("timestamp"))
    return F.call_function("div", micros + F.when(micros < 0, -500).otherwise(500), F.lit(1000))


def cases(spark: SparkSession, d: str) -> DataFrame:
    """Documents as repair cases: file_hash, source, error_type, error_message, bytecode_version, doc_id."""
    labels = table(spark, d, "labels").select("doc_id", "quality")
    quality = F.when(F.col("quality") == 0, "syntactic_error").when(F.col("quality") == 1, "semantic_error")
    message = F.when(F.col("doc_id") % 5 == 0, " nan ").when(F.col("doc_id") % 5 == 1, "  ").when(F.col("doc_id") % 5 == 2, F.concat(F.lit("Invalid syntax (line "), F.col("doc_id").cast("string"), F.lit(")")))
    version = F.element_at(F.array(*map(F.lit, ("3.1", "3.11.4", "12", "3.9", "313", " 3.14 "))), (F.col("doc_id") % 6 + 1).cast("int"))
    docs = table(spark, d, "documents").select("doc_id", "source")
    return docs.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("file_hash"), "source", quality.alias("error_type"), message.alias("error_message"), version.alias("bytecode_version"), "doc_id"
    )


CASES = """cases AS (
  SELECT d.doc_id AS file_hash, d.source, CASE quality WHEN 0 THEN 'syntactic_error' WHEN 1 THEN 'semantic_error' END AS error_type,
    CASE d.doc_id % 5 WHEN 0 THEN ' nan ' WHEN 1 THEN '  ' WHEN 2 THEN 'Invalid syntax (line ' || d.doc_id || ')' END AS error_message,
    ['3.1', '3.11.4', '12', '3.9', '313', ' 3.14 '][(d.doc_id % 6 + 1)::INT] AS bytecode_version, d.doc_id
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


def attempts(spark: SparkSession, d: str) -> DataFrame:
    """Events as run-log attempts; a view is a run out of scope."""
    kind = F.col("event_type")
    return table(spark, d, "events").select(
        F.col("user_id").alias("file_hash"), "ts", "event_id", "event_type",
        F.when(kind == "view", F.lit(None)).otherwise(kind != "error").cast("boolean").alias("compiled_success"),
        (kind == "click").alias("delete_only_fallback_used"), (kind == "signup").alias("forced_compile_used"),
        F.floor("value").alias("lines_deleted"), F.floor("value").cast("int").alias("delete_only_deletions"),
    )


ATTEMPTS = """attempts AS (
  SELECT user_id AS file_hash, ts, event_id, event_type, CASE WHEN event_type = 'view' THEN NULL ELSE event_type <> 'error' END AS compiled_success,
    event_type = 'click' AS fallback, event_type = 'signup' AS forced, floor(value)::BIGINT AS lines_deleted FROM events)"""

OUTCOME = """CASE WHEN compiled_success IS NULL THEN 'out_of_scope' WHEN NOT compiled_success THEN 'failed' WHEN fallback AND lines_deleted > 50 THEN 'heavy_deletion'
  WHEN fallback AND lines_deleted > 0 THEN 'light_deletion' WHEN forced THEN 'neutralised_compile' ELSE 'genuine' END"""

# Action labels that the pattern view deals out; the empty one is a pattern without a label.
ACTIONS = (
    "", "add_missing_control_flow", "remove_extra_control_flow", "restore_missing_expression_reference", "remove_extra_expression_reference", "adjust_return_expression",
    "adjust_call_arguments", "adjust_comparison_expression", "adjust_boolean_expression", "adjust_arithmetic_or_unary_expression", "adjust_subscript_or_index_expression",
)


def patterns(spark: SparkSession, d: str) -> DataFrame:
    """Parts as action patterns."""
    size, key = F.col("p_size"), F.col("p_partkey")
    out: dict[str, Column] = {
        "row_idx": key, "case_id": F.concat(F.lit("case-"), key.cast("string")), "repair_operation": F.col("p_type"), "target_kind": F.when(key % 7 != 0, F.col("p_brand")),
        "alignment_category": F.element_at(F.array(*map(F.lit, ("insert", "replace", "unknown", None))), (key % 4 + 1).cast("int")),
        "action_type": F.element_at(F.array(*map(F.lit, ACTIONS)), (key % len(ACTIONS) + 1).cast("int")), "combined_distance_delta": F.when(key % 13 != 0, size - 40),
        "arg_shape_changed": size % 2 == 0, "source_shape_before": F.replace("p_name", F.lit(" "), F.lit(",")), "price": F.col("p_retailprice"), "size": size,
        "call_arg_count_before": size % 3, "call_keyword_count_before": size % 2, "call_arg_count_delta": size % 4 - 1, "call_keyword_count_delta": F.lit(0),
        "return_value_kinds_before": F.when(size % 3 == 0, "Compare,Call").when(size % 3 == 1, "BoolOp"), "assign_value_kinds_before": F.when(size % 4 == 0, "Call"),
        "expr_value_kinds_before": F.lit(""), "call_func_kinds_before": F.when(size % 5 == 0, "Name,Attribute"),
    }
    out |= {f"{m}_count": (size + i) % 3 for i, m in enumerate(scoring.METADATA)}
    out |= {name: (size + i) % 3 == 0 for i, name in enumerate(scoring.INSTRUCTIONS)}
    out |= {f"source_has_{s}_before": (size + i) % 4 == 0 for i, s in enumerate(scoring.SOURCE)}
    return table(spark, d, "part").select(*(c.alias(n) for n, c in out.items()))


_LIST = "', '".join(ACTIONS)
PATTERNS = f"""patterns AS (
  SELECT p_partkey AS row_idx, 'case-' || p_partkey AS case_id, p_type AS repair_operation, CASE WHEN p_partkey % 7 <> 0 THEN p_brand END AS target_kind,
    ['insert', 'replace', 'unknown', NULL][(p_partkey % 4 + 1)::INT] AS alignment_category, ['{_LIST}'][(p_partkey % {len(ACTIONS)} + 1)::INT] AS action_type,
    CASE WHEN p_partkey % 13 <> 0 THEN p_size - 40 END AS combined_distance_delta, p_size % 2 = 0 AS arg_shape_changed, p_retailprice AS price, p_size AS size,
    list_distinct(string_split(p_name, ' ')) AS source_shape_before, p_size % 3 AS call_arg_count_before, p_size % 2 AS call_keyword_count_before, p_size % 4 - 1 AS call_arg_count_delta,
    CASE p_size % 3 WHEN 0 THEN ['Compare', 'Call'] WHEN 1 THEN ['BoolOp'] ELSE [] END AS return_value_kinds_before,
    CASE WHEN p_size % 4 = 0 THEN ['Call'] ELSE [] END AS assign_value_kinds_before, CASE WHEN p_size % 5 = 0 THEN ['Name', 'Attribute'] ELSE [] END AS call_func_kinds_before,
    {", ".join(f"(p_size + {i}) % 3 AS {m}_count" for i, m in enumerate(scoring.METADATA))},
    {", ".join(f"(p_size + {i}) % 3 = 0 AS {n}" for i, n in enumerate(scoring.INSTRUCTIONS))},
    {", ".join(f"(p_size + {i}) % 4 = 0 AS source_has_{s}_before" for i, s in enumerate(scoring.SOURCE))}
  FROM part)"""


def score_sql(runtime: bool = False) -> str:
    """SQL text of the score of pattern p for query q, written out term by term."""
    same = (lambda c: f"coalesce(q.{c} = p.{c}, false)") if runtime else (lambda c: f"q.{c} IS NOT DISTINCT FROM p.{c}")
    terms = ["6", *(f"CASE WHEN {same(c)} THEN 2 ELSE 0 END" for c in ("target_kind", "alignment_category"))]
    for a, b in [(f"q.{m}_count > 0", f"p.{m}_count > 0") for m in scoring.METADATA] + [("q.arg_shape_changed", "p.arg_shape_changed")]:
        terms.append(f"CASE WHEN {a} AND {b} THEN 3 WHEN ({a}) <> ({b}) THEN -1 ELSE 0 END")
    terms += [f"CASE WHEN q.{n} AND p.{n} THEN 3 WHEN p.{n} THEN -1 ELSE 0 END" for n in scoring.INSTRUCTIONS]
    terms += [f"CASE WHEN q.source_has_{s}_before AND p.source_has_{s}_before THEN 3 WHEN p.source_has_{s}_before THEN -2 ELSE 0 END" for s in scoring.SOURCE]
    for c, miss in (("source_shape_before", -2), ("return_value_kinds_before", -1), ("assign_value_kinds_before", -1), ("call_func_kinds_before", -1)):
        terms.append(f"CASE WHEN len(q.{c}) = 0 OR len(p.{c}) = 0 THEN 0 WHEN len(list_intersect(q.{c}, p.{c})) > 0 THEN least(3, len(list_intersect(q.{c}, p.{c}))) ELSE {miss} END")
    argued = "(q.call_arg_count_before <> 0 OR q.call_keyword_count_before <> 0 OR q.instruction_has_kw_names)"
    terms.append(f"CASE WHEN p.call_arg_count_delta = 0 THEN 0 WHEN {argued} THEN 2 ELSE -3 END")
    has = lambda s: f"q.source_has_{s}_before"
    extra = (lambda kind, s: has(s)) if runtime else (lambda kind, s: f"list_contains(q.return_value_kinds_before, '{kind}')")
    called = f"({has('call_or_attribute')} OR q.instruction_has_call_or_attr" + ("" if runtime else " OR len(q.call_func_kinds_before) > 0") + ")"
    returned = f"({has('return')} OR q.instruction_has_return)"
    rules = [
        ("p.action_type IN ('add_missing_control_flow', 'remove_extra_control_flow')", "q.instruction_has_jump", 5),
        ("p.action_type = 'restore_missing_expression_reference'", "(q.gt_only_names_count > 0 OR q.instruction_has_call_or_attr)", 4),
        ("p.action_type = 'remove_extra_expression_reference'", "q.derived_only_names_count > 0", 4),
        ("p.action_type LIKE 'adjust~_return~_%' ESCAPE '~'", returned, 3),
        ("p.action_type = 'adjust_call_arguments'", called, 3),
        ("p.action_type = 'adjust_call_arguments'", argued, 4),
        ("p.action_type = 'adjust_comparison_expression'", f"(q.instruction_has_compare OR {extra('Compare', 'compare')})", 3),
        ("p.action_type = 'adjust_boolean_expression'", f"(q.instruction_has_jump OR {extra('BoolOp', 'boolop')})", 3),
        ("p.action_type = 'adjust_arithmetic_or_unary_expression'", "q.instruction_has_binary_op", 2),
        ("p.action_type = 'adjust_subscript_or_index_expression'", f"(q.instruction_has_subscript OR {extra('Subscript', 'subscript')})", 3),
    ]
    if runtime:
        rules.append(("p.action_type = 'adjust_return_expression'", returned, 3))
    terms += [f"CASE WHEN {test} AND NOT {excuse} THEN -{cost} ELSE 0 END" for test, excuse, cost in rules]
    return " + ".join(f"({t})" for t in terms)


def pairs_sql(runtime: bool = False) -> str:
    return f"""pairs AS (
  SELECT * FROM (SELECT q.row_idx AS q_idx, p.row_idx AS p_idx, p.action_type, ({score_sql(runtime)})::BIGINT AS score
  FROM patterns q JOIN patterns p ON q.repair_operation = p.repair_operation AND q.row_idx <> p.row_idx AND p.action_type <> ''
    AND (q.target_kind IS NULL OR p.target_kind IS NULL OR q.target_kind = p.target_kind)
    AND (coalesce(q.alignment_category, 'unknown') = 'unknown' OR coalesce(p.alignment_category, 'unknown') = 'unknown' OR q.alignment_category = p.alignment_category))
  WHERE score >= {scoring.LEAST})"""


RANKED = f"""ranked AS (
  SELECT q_idx, action_type, max(score) AS best, min(p_idx) FILTER (WHERE n = 1) AS best_idx, min(p_idx) AS first_any,
    (max(score) + sum(CASE WHEN n <= 5 THEN greatest(score - {scoring.LEAST}, 0) ELSE 0 END) // 5)::BIGINT AS adjusted
  FROM (SELECT *, row_number() OVER (PARTITION BY q_idx, action_type ORDER BY score DESC, p_idx) AS n FROM pairs) GROUP BY ALL),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q_idx ORDER BY adjusted DESC, best DESC, first_any) AS nth FROM ranked) WHERE nth <= 3)"""


def edges(spark: SparkSession, d: str) -> DataFrame:
    """Each user's steps from event to event as a control-flow graph: graph, src, dst, kind (distinct src, dst)."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    steps = table(spark, d, "events").select(F.col("user_id").alias("graph"), F.col("event_type").alias("src"), F.lead("event_type").over(w).alias("dst"), F.when(F.col("value") >= 50, "jump").otherwise("fall").alias("kind"))
    return steps.filter("dst IS NOT NULL").groupBy("graph", "src", "dst").agg(F.min("kind").alias("kind"))


def blocks(spark: SparkSession, d: str) -> DataFrame:
    """graph, block, place: blocks by their first occurrence."""
    from pyspark.sql.window import Window

    first = table(spark, d, "events").groupBy(F.col("user_id").alias("graph"), F.col("event_type").alias("block")).agg(F.min(F.struct("ts", "event_id")).alias("at"))
    return first.select("graph", "block", (F.row_number().over(Window.partitionBy("graph").orderBy("at")) - 1).alias("place"))


GRAPH = """edges AS (
  SELECT graph, src, dst, min(kind) AS kind FROM (
    SELECT user_id AS graph, event_type AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst, CASE WHEN value >= 50 THEN 'jump' ELSE 'fall' END AS kind FROM events)
  WHERE dst IS NOT NULL GROUP BY ALL),
blocks AS (
  SELECT graph, block, row_number() OVER (PARTITION BY graph ORDER BY ts, event_id) - 1 AS place FROM (
    SELECT user_id AS graph, event_type AS block, ts, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1)),
graph_pairs AS (SELECT DISTINCT a.graph AS a, a.graph + 1 AS b FROM blocks a WHERE a.graph + 1 IN (SELECT graph FROM blocks))"""


def tree(spark: SparkSession, d: str) -> DataFrame:
    """Three-level qualnames from region, nation and customer, as distance rows of one file a region."""
    regions = table(spark, d, "region").select(F.col("r_regionkey"), F.concat(F.lit("<module>.R"), F.col("r_regionkey").cast("string")).alias("r"))
    nations = table(spark, d, "nation").join(regions, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_regionkey", "r", F.concat("r", F.lit(".N"), F.col("n_nationkey").cast("string")).alias("n"))
    customers = table(spark, d, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    rest = F.when(F.col("c_custkey") % 9 == 0, ".<lambda>").when(F.col("c_custkey") % 9 == 1, ".__annotate__").otherwise(F.concat(F.lit(".C"), F.col("c_custkey").cast("string")))
    status = F.element_at(F.array(*map(F.lit, ("matched", "matched", "missing", "extra"))), (F.col("c_custkey") % 4 + 1).cast("int"))
    leaf = customers.select(F.col("r_regionkey").alias("file"), F.concat("n", rest).alias("name"), status.alias("status"), F.floor(F.abs("c_acctbal")).cast("long").alias("d"), (F.col("c_acctbal") > 5000).alias("on"), F.col("c_custkey").alias("row_idx"))
    node = lambda rows, name, idx: rows.select(F.col("r_regionkey").alias("file"), F.col(name).alias("name"), F.lit("matched").alias("status"), (F.col(idx) % 3).cast("long").alias("d"), F.lit(True).alias("on"), (-1 - F.col(idx)).cast("long").alias("row_idx"))
    rows = leaf.unionByName(node(nations, "n", "n_nationkey")).unionByName(node(regions, "r", "r_regionkey"))
    return rows.select(
        "file", "status", F.when(F.col("status") != "extra", F.col("name")).alias("gt_name"), F.when(F.col("status") != "missing", F.col("name")).alias("derived_name"),
        F.when(F.col("on"), F.col("d")).otherwise(0).cast("long").alias("combined_distance"), "row_idx",
    )


TREE = """tree AS (
  SELECT file, status, CASE WHEN status <> 'extra' THEN name END AS gt_name, CASE WHEN status <> 'missing' THEN name END AS derived_name, d AS combined_distance, row_idx FROM (
    SELECT r_regionkey AS file, '<module>.R' || r_regionkey || '.N' || n_nationkey || CASE c_custkey % 9 WHEN 0 THEN '.<lambda>' WHEN 1 THEN '.__annotate__' ELSE '.C' || c_custkey END AS name,
      ['matched', 'matched', 'missing', 'extra'][(c_custkey % 4 + 1)::INT] AS status, CASE WHEN c_acctbal > 5000 THEN floor(abs(c_acctbal))::BIGINT ELSE 0 END AS d, c_custkey AS row_idx
    FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    UNION ALL SELECT r_regionkey, '<module>.R' || r_regionkey || '.N' || n_nationkey, 'matched', n_nationkey % 3, -1 - n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey
    UNION ALL SELECT r_regionkey, '<module>.R' || r_regionkey, 'matched', r_regionkey % 3, -1 - r_regionkey FROM region))"""


def verifications(spark: SparkSession, d: str, after: bool) -> DataFrame:
    """All orders as verification results: file is the customer, names a seventh of the order keys; ``after`` shifts what passes.

    An order of low priority verifies another name before, an urgent one another name after, so names may have one side only.
    """
    shift = 1 if after else 0
    k, rare = F.col("o_orderkey"), F.col("o_orderpriority") == ("1-URGENT" if after else "5-LOW")
    message = F.element_at(F.array(*map(F.lit, ("Different bytecode", "Different control flow", "Missing bytecode", "Strange"))), ((k + shift) % 4 + 1).cast("int"))
    return table(spark, d, "orders").select(
        F.col("o_custkey").alias("file"), F.concat(F.when(rare, "new" if after else "old").otherwise("f"), (k % 7).cast("string")).alias("names"),
        (F.col("o_orderstatus") == ("F" if not after else "O")).alias("success"),
        message.alias("message"), F.when(k % 3 != shift, (k % 50).cast("int")).alias("failed_offset"), k.alias("row_idx"),
    )


def verifications_sql(name: str, after: bool) -> str:
    s = 1 if after else 0
    return f"""{name} AS (
  SELECT o_custkey AS file, CASE WHEN o_orderpriority = '{"1-URGENT" if after else "5-LOW"}' THEN '{"new" if after else "old"}' ELSE 'f' END || (o_orderkey % 7) AS names, o_orderstatus = '{"O" if after else "F"}' AS success,
    ['Different bytecode', 'Different control flow', 'Missing bytecode', 'Strange'][((o_orderkey + {s}) % 4 + 1)::INT] AS message,
    CASE WHEN o_orderkey % 3 <> {s} THEN (o_orderkey % 50)::INT END AS failed_offset, o_orderkey AS row_idx
  FROM orders),
{name}_state AS (
  SELECT *, CASE WHEN success THEN 4 WHEN message = 'Different bytecode' AND failed_offset IS NOT NULL THEN 3 WHEN message = 'Different bytecode' THEN 2
    WHEN message IN ('Missing bytecode', 'Extra bytecode') THEN 0 ELSE 1 END AS rnk,
    CASE WHEN NOT success AND message = 'Different bytecode' AND failed_offset IS NOT NULL THEN failed_offset ELSE 0 END AS off FROM {name})"""


def preflights(spark: SparkSession, d: str) -> DataFrame:
    """Lineitem aggregates by order as preflight rows: file_hash, distance, targets, missing, extra, parents."""
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(
        F.sum(F.col("l_quantity").cast("long")).alias("distance"), F.count("*").alias("targets"), F.count_if(F.col("l_returnflag") == "R").alias("missing"),
        F.count_if(F.col("l_linestatus") == "O").alias("extra"), F.count_if(F.col("l_tax") > 0.05).alias("parents"),
    )
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("file_hash"))
    return orders.join(lines, F.col("file_hash") == F.col("k"), "left").withColumn("present", F.col("k").isNotNull()).drop("k")


PREFLIGHTS = """preflights AS (
  SELECT o_orderkey AS file_hash, l.*, l.k IS NOT NULL AS present FROM orders LEFT JOIN (
    SELECT l_orderkey AS k, sum(l_quantity::BIGINT)::BIGINT AS distance, count(*) AS targets, count(*) FILTER (WHERE l_returnflag = 'R') AS missing,
      count(*) FILTER (WHERE l_linestatus = 'O') AS extra, count(*) FILTER (WHERE l_tax > 0.05) AS parents FROM lineitem GROUP BY 1) l ON o_orderkey = l.k)"""
