"""Catalogue queries: source maps, reattachment, context by strategy, reports, target lists and studies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars, summaries
from ..operators import distance, editors, localise, outcomes, reattach, selection, sourcemap, state, study
from . import analytics
from . import views as v
from .catalogue import query


@query(sql="SELECT o_custkey AS file, count(*) FILTER (WHERE o_orderstatus = 'F') AS successes, count(*) AS n, bool_and(o_orderstatus = 'F') AS all_equal FROM orders GROUP BY 1")
def all_succeeded(spark: SparkSession, d: str) -> DataFrame:
    return outcomes.all_succeeded(v.table(spark, d, "orders").select(F.col("o_custkey").alias("file"), (F.col("o_orderstatus") == "F").alias("success")), "file")


@query(sql="""SELECT user_id, count(*) AS processed, count(*) FILTER (WHERE event_type IN ('click', 'purchase')) AS repaired, count(*) FILTER (WHERE event_type = 'error') AS failed,
  count(*) FILTER (WHERE event_type = 'view') AS deferred, count(*) FILTER (WHERE event_type = 'signup') AS timed_out FROM events GROUP BY 1""")  # fmt: skip
def dispositions(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("event_type")
    what = F.when(kind.isin("click", "purchase"), "repaired").when(kind == "error", "failed").when(kind == "view", "deferred").otherwise("timed_out")
    return outcomes.dispositions(v.table(spark, d, "events").select("user_id", what.alias("disposition")), "user_id")


@query(sql="SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) <= 5")
def last_five_attempts(spark: SparkSession, d: str) -> DataFrame:
    return selection.keep_last(v.table(spark, d, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], "o_orderkey", n=5)


@query(sql="""SELECT file, list(names ORDER BY first) AS failing FROM (SELECT o_custkey AS file, 'f' || o_orderkey % 7 AS names, min(o_orderkey) AS first FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1, 2) GROUP BY 1""")
def failing_names(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    rows = v.table(spark, d, "orders").select(F.col("o_custkey").alias("file"), F.concat(F.lit("f"), (k % 7).cast("string")).alias("names"), (F.col("o_orderstatus") == "F").alias("success"), "o_orderkey")
    return selection.failing_names(rows, "o_orderkey")


@query()
def first_seen_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Candidates of each user whose text and shape no kept one has, in order of events (tested against a plain loop)."""
    c = F.struct("ts", "event_id", F.concat("event_type", F.floor(F.col("value") / 40).cast("string")).alias("text_hash"), F.when(F.col("value") < 150, F.floor(F.col("value") / 15).cast("string")).alias("shape_hash"))
    rows = v.table(spark, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(c)).alias("all"))
    return rows.select("user_id", F.transform(selection.first_seen(F.col("all")), lambda x: x["event_id"]).alias("kept"))


@query(v.TREE, sql="""SELECT file, list_sort(list(DISTINCT target)) AS targets, list_contains(list(target), '<module>') AS module_body FROM (
  SELECT file, gt_name AS target FROM tree WHERE status = 'missing' AND gt_name <> '<module>' AND NOT ends_with(gt_name, '.__annotate__')
  UNION ALL SELECT file, gt_name FROM tree WHERE status = 'matched' AND combined_distance > 0 AND gt_name = derived_name AND NOT ends_with(gt_name, '.__annotate__')) GROUP BY 1""")  # fmt: skip
def target_lists(spark: SparkSession, d: str) -> DataFrame:
    """Missing and failing targets of each file in one sorted list, and whether the module's own body is among them."""
    rows = v.tree(spark, d)
    missing = state.missing_targets(rows).select("file", F.lit("missing").alias("kind"), "target")
    failing = rows.filter("status = 'matched' AND combined_distance > 0 AND gt_name = derived_name AND NOT endswith(gt_name, '.__annotate__')").select("file", F.lit("failing").alias("kind"), F.col("gt_name").alias("target"))
    of = lambda kind: F.collect_list(F.when(F.col("kind") == kind, F.col("target")))
    both = missing.unionByName(failing).groupBy("file").agg(of("missing").alias("m"), of("failing").alias("f"))
    both = both.select("file", selection.union_targets(F.col("m"), F.col("f")).alias("targets"))
    return both.withColumn("module_body", selection.has_module_target(F.col("targets")))


@query(v.CASES, sql="SELECT DISTINCT lower(trim(source)) AS source, trim(file_hash::VARCHAR) AS file_hash FROM cases WHERE trim(source) <> ''")
def keep_sets(spark: SparkSession, d: str) -> DataFrame:
    return selection.keep_sets(v.cases(spark, d))


@query(v.CASES, sql="""SELECT file_hash, 'missing ' || nullif(concat_ws(', ', CASE WHEN coalesce(trim(error_message), '') = '' THEN 'error_message' END, CASE WHEN coalesce(trim(bytecode_version), '') = '' THEN 'bytecode_version' END,
  CASE WHEN error_type IS NULL THEN 'error_type' END), '') AS reject_reason FROM cases""")  # fmt: skip
def reject_rows(spark: SparkSession, d: str) -> DataFrame:
    return selection.with_rejects(v.cases(spark, d), "error_message", "bytecode_version", "error_type").select("file_hash", "reject_reason")


_SAID = " || '; ' || ".join(f"CASE WHEN {' OR '.join(f'{n}::INT <> 0' for n in names)} THEN '{text}' ELSE '' END" for names, text in summaries.SITUATIONS)
_ACTION = "CASE action_type " + " ".join(f"WHEN '{k}' THEN '{t}'" for k, t in summaries.ACTIONS.items()) + f" ELSE '{summaries.OTHER_ACTION}' END"


@query(v.PATTERNS, sql=f"""SELECT row_idx, CASE WHEN said = '' THEN '{summaries.NO_SITUATION}' ELSE said END AS situation, action, bound AS constraint_kept, length(CASE WHEN said = '' THEN '{summaries.NO_SITUATION}' ELSE said END) + length(action) + length(bound) + 64 AS n_chars FROM (
  SELECT row_idx, array_to_string(list_filter(string_split({_SAID}, '; '), lambda x: x <> ''), '; ') AS said, {_ACTION} AS action,
    CASE WHEN size % 5 = 0 THEN 'changed a function/class boundary' ELSE 'preserved function/class boundary' END AS bound FROM patterns)""")  # fmt: skip
def action_summaries(spark: SparkSession, d: str) -> DataFrame:
    """Summaries of all patterns, taken apart again."""
    text = summaries.action_summary(F.col("action_type"), F.col("repair_operation"), F.col, F.col("size") % 5 == 0)
    rows = v.patterns(spark, d).select("row_idx", text.alias("text")).withColumn("p", summaries.summary_parts(F.col("text")))
    return rows.select("row_idx", "p.situation", "p.action", F.col("p.constraint").alias("constraint_kept"), F.length("text").cast("long").alias("n_chars"))


_STDOUT = "run of %d\nOverall: %d.5%% Code Object Success Rate\n│ object │ result │ message │\n│ <module> │ Success │ Equal │\n  │ <module>.f%d │ %s │ Different bytecode │\nend\n"


def _outputs(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    text = F.format_string(_STDOUT, k, k % 100, k, F.when(k % 2 == 0, "Failure").otherwise("Success"))
    text = F.when(k % 7 == 0, F.lit("no table, no rate\n")).when(k % 7 == 1, F.concat(F.lit("100% code object success rate\n"), F.lit("│ <module> │ Success │ Equal │"))).otherwise(text)
    return v.table(spark, d, "part").select(
        F.col("p_partkey").alias("file_hash"), F.lit("d").alias("decompiler"), F.concat(F.lit("3."), (F.col("p_size") % 5 + 10).cast("string")).alias("bytecode_version"), text.alias("stdout"),
        F.when(k % 11 == 0, 1).otherwise(0).alias("returncode"), (k % 13 == 0).alias("syntax_error"),
    )


_REPORT = """report AS (SELECT p_partkey AS file_hash, '3.' || (p_size % 5 + 10) AS bytecode_version, p_partkey % 13 = 0 AS broken, p_partkey % 11 = 0 AS failed,
  CASE p_partkey % 7 WHEN 0 THEN NULL WHEN 1 THEN 100.0 ELSE p_partkey % 100 + 0.5 END::DOUBLE AS rate, CASE p_partkey % 7 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END AS n_rows,
  CASE WHEN p_partkey % 7 > 1 AND p_partkey % 2 = 0 THEN '<module>.f' || p_partkey END AS failing FROM part),
record AS (SELECT *, CASE WHEN broken THEN 'syntactic_error' WHEN failed THEN 'decompiler_failure' WHEN rate IS NULL THEN 'unknown' WHEN rate < 100 THEN 'semantic_error' ELSE 'success' END AS status FROM report)"""


@query(_REPORT, sql="SELECT file_hash, status, rate, n_rows::BIGINT AS n_rows, failing FROM record")
def corpus_records(spark: SparkSession, d: str) -> DataFrame:
    rows = study.corpus_records(_outputs(spark, d))
    failing = F.get(F.transform("failed_code_objects", lambda r: r["code_object"]), 0)
    return rows.select("file_hash", "status", F.col("code_object_success_rate").alias("rate"), F.size("equivalence_rows").cast("long").alias("n_rows"), failing.alias("failing"))


@query(_REPORT, sql="""SELECT bytecode_version, count(*) AS processed, count(*) FILTER (WHERE status = 'syntactic_error') AS syntactic_error, count(*) FILTER (WHERE status = 'semantic_error') AS semantic_error,
  count(*) FILTER (WHERE status = 'success') AS success, count(*) FILTER (WHERE status = 'unknown') AS unknown, count(*) FILTER (WHERE status = 'decompiler_failure') AS decompiler_failure FROM record GROUP BY 1""")  # fmt: skip
def corpus_status_counts(spark: SparkSession, d: str) -> DataFrame:
    return study.status_counts(study.corpus_records(_outputs(spark, d)), "bytecode_version")


@query("""m AS (SELECT l_orderkey AS file, l_partkey * 1000 + l_suppkey * 10 + l_linenumber AS idx, CASE WHEN l_returnflag = 'A' THEN 'pyc_only' ELSE 'mapped' END AS row_type, 'f' || (l_partkey % 3) AS source_qualname, 'f' || (l_suppkey % 3) AS pyc_qualname,
  l_linestatus = 'O' AS matched, l_quantity::BIGINT AS source_line, CASE WHEN l_suppkey % 5 <> 0 THEN l_partkey % 50 END AS pyc_line, l_suppkey % 4 AS sc FROM lineitem),
t AS (SELECT DISTINCT l_orderkey AS file, 'f' || n AS target FROM lineitem, (SELECT unnest([0, 1, 2]) AS n))""", sql="""SELECT t.file, t.target, CASE WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'ranked' ELSE 'found' END AS status, coalesce(n, 0) AS n_candidates, idx FROM t LEFT JOIN (
  SELECT *, count(*) OVER (PARTITION BY file, source_qualname) AS n FROM m WHERE row_type = 'mapped' QUALIFY row_number() OVER (PARTITION BY file, source_qualname ORDER BY (pyc_qualname = source_qualname) DESC, matched DESC,
    CASE WHEN pyc_line IS NULL THEN 1000000000 ELSE abs(source_line - pyc_line) END, sc, source_line, idx) = 1) b ON b.file = t.file AND b.source_qualname = t.target""")  # fmt: skip
def target_resolution(spark: SparkSession, d: str) -> DataFrame:
    """The mapping row that each of three names means in each file, by identity where several have it."""
    c, none = F.col, F.lit(None).cast("long")
    rows = v.table(spark, d, "lineitem").select(
        c("l_orderkey").alias("file"), (c("l_partkey") * 1000 + c("l_suppkey") * 10 + c("l_linenumber")).alias("idx"), F.when(c("l_returnflag") == "A", "pyc_only").otherwise("mapped").alias("row_type"),
        F.concat(F.lit("f"), (c("l_partkey") % 3).cast("string")).alias("source_qualname"), F.concat(F.lit("f"), (c("l_suppkey") % 3).cast("string")).alias("pyc_qualname"), (c("l_linestatus") == "O").alias("matched"),
        c("l_quantity").cast("long").alias("source_line"), F.when(c("l_suppkey") % 5 != 0, c("l_partkey") % 50).alias("pyc_line"), (c("l_suppkey") % 4).alias("source_collisions"),
        *(none.alias(n) for n in ("pyc_collisions", "source_occurrence", "pyc_occurrence", "source_col", "source_end_line", "source_end_col")), *(F.lit(None).cast("array<bigint>").alias(n) for n in ("source_path", "pyc_path")),
    )
    targets = v.table(spark, d, "lineitem").select(c("l_orderkey").alias("file"), F.explode(F.array(*map(F.lit, ("f0", "f1", "f2")))).alias("target"))
    return sourcemap.resolve_targets(rows, targets)


# A module whose code objects are known, and where.
MODULE_TEXT = "import os\n@wrap(lambda q: q)\ndef f(a=[x for x in y]) -> int:\n    if any(k for k in a):\n        def g(): return {1: %d}\n    return g\nclass K(B):\n    def f(self): pass\n    def f(self): pass\n"


@query(sql="""SELECT p_partkey, o.* FROM part, (VALUES
  (0, '<module>', 'module', 1, 0, 0, '0', 'module', 4), (1, '<module>.f', 'function', 2, 0, 0, '0.0', 'module', 2), (2, '<module>.<lambda>', 'lambda', 2, 0, 1, '0.1', 'decorator', 0),
  (3, '<module>.<listcomp>', 'listcomp', 3, 0, 2, '0.2', 'default_or_annotation', 0), (4, '<module>.f.<genexpr>', 'genexpr', 4, 0, 0, '0.0.0', 'if_test', 0), (5, '<module>.f.g', 'function', 5, 0, 1, '0.0.1', 'if_body', 0),
  (6, '<module>.K', 'class', 7, 0, 3, '0.3', 'module', 2), (7, '<module>.K.f', 'function', 8, 0, 0, '0.3.0', 'body', 0), (8, '<module>.K.f', 'function', 9, 0, 1, '0.3.1', 'body', 0))
  AS o(idx, qualname, kind, line, occurrence, sibling, path, context, child_count)""")  # fmt: skip
def source_objects(spark: SparkSession, d: str) -> DataFrame:
    rows = v.table(spark, d, "part").select("p_partkey", F.format_string(MODULE_TEXT, "p_size").alias("source"))
    found = sourcemap.source_objects(rows, "p_partkey", "source")
    return found.select("p_partkey", "idx", "qualname", "kind", "line", "occurrence", "sibling", F.array_join(F.col("ordinal_path").cast("array<string>"), ".").alias("path"), "context", "child_count")


CONTEXT_TEXT = "a = 1\ndef f():\n    x = g(1\n    return x\n\ndef h():\n    return %d\n"


@query(sql="""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'delimiter,block,line' WHEN 1 THEN 'block,line,delimiter' WHEN 2 THEN 'line,delimiter,block' ELSE 'line,block,delimiter' END AS strategies,
  CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE 6 END AS "start", CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE 7 END AS "end" FROM part""")  # fmt: skip
def strategy_contexts(spark: SparkSession, d: str) -> DataFrame:
    """The context of an error in the last function, by strategies that its message calls for; none for a line that isn't there."""
    k = F.col("p_partkey")
    message = F.when(k % 4 == 0, "'(' was never closed").when(k % 4 == 1, "unexpected indent").when(k % 4 == 2, "invalid decimal literal").otherwise("invalid syntax")
    rows = v.table(spark, d, "part").select("p_partkey", F.format_string(CONTEXT_TEXT.replace("g(1\n", "g(1)\n"), "p_size").alias("source"), F.when(k % 5 == 0, 99).otherwise(7).alias("line"), message.alias("message"))
    return localise.contexts(rows, "p_partkey", "source", "line", "message").select("p_partkey", "strategies", "start", "end")


@query(sql="""SELECT p_partkey, p_partkey % 3 <> 2 AS parses, 'class K:' || chr(10) || '    def f(self):' || chr(10) || CASE p_partkey % 3 WHEN 0 THEN '        return ' || p_size || chr(10) WHEN 1 THEN '            if a:' || chr(10) || '                return ' || p_size || chr(10) END || 'x = 1' || chr(10) AS updated FROM part""")
def reattached_sources(spark: SparkSession, d: str) -> DataFrame:
    """A method's replacement, put back as it parses best: flat or with a block of its own, or not parsing at all (updated NULL here)."""
    k = F.col("p_partkey")
    source = "class K:\n    def f(self):\n        return 0\nx = 1\n"
    text = F.when(k % 3 == 0, F.format_string("def f(self):\n    return %d", "p_size")).when(k % 3 == 1, F.format_string("    def f(self):\n        if a:\n            return %d", "p_size")).otherwise("def f(:\n")
    rows = v.table(spark, d, "part").select("p_partkey", F.lit(source).alias("source"), F.lit(2).alias("line"), F.lit(4).alias("col"), F.lit(3).alias("end_line"), F.lit(16).alias("end_col"), F.lit("function").alias("kind"), text.alias("replacement"))
    out = reattach.reattach_rows(rows, "p_partkey")
    return out.select("p_partkey", "parses", F.when(F.col("parses"), F.col("updated")).alias("updated"))


@query(sql="""SELECT p_partkey, p_partkey % 6 IN (0, 1, 2) AS misshapen, p_partkey % 6 = 5 AS surrendered FROM part""")
def text_checks(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    line = F.element_at(F.array(*map(F.lit, ("version = 1.2.3", "x = 2abc", "a.b = 1", "y = 12.5", "# 1.2.3", "f(<mask_7>)"))), (k % 6 + 1).cast("int"))
    return v.table(spark, d, "part").select("p_partkey", scalars.misshapen_tokens(line).alias("misshapen"), scalars.surrendered(line).alias("surrendered"))


@query(v.CASES, analytics._DISTANCE, sql="""SELECT file_hash, source, CASE WHEN doc_id % 10 = 0 THEN 'unresolved_pyc' WHEN r.file IS NULL THEN 'comparison_failed' ELSE 'summary' END AS status, CASE WHEN doc_id % 10 <> 0 THEN combined END AS combined_distance, CASE WHEN doc_id % 10 <> 0 THEN n END AS gt_code_object_count
  FROM cases LEFT JOIN (SELECT file, sum(combined_distance)::BIGINT AS combined, count(*) FILTER (WHERE status <> 'extra') AS n FROM dist GROUP BY 1) r ON r.file = doc_id WHERE error_type = 'semantic_error'""")  # fmt: skip
def dataset_distance_run(spark: SparkSession, d: str) -> DataFrame:
    cases = v.cases(spark, d).withColumns({"gt_pyc": F.when(F.col("doc_id") % 10 != 0, "gt"), "derived_pyc": F.lit("derived")})
    rows = analytics._distance_rows(spark, d).withColumnRenamed("file", "file_hash")
    return study.dataset_run(cases, rows).select("file_hash", "source", "status", "combined_distance", "gt_code_object_count")


@query()
def graph_edit_study(spark: SparkSession, d: str) -> DataFrame:
    """Heuristic and exact flow distances of neighbouring users' event graphs, and how they agree (the search is tested against all assignments)."""
    edges, blocks = v.edges(spark, d), v.blocks(spark, d)
    flow = distance.flow_distances(analytics._graph_pairs(spark, d), distance.graphs(edges, blocks))
    degree = edges.groupBy("graph", F.col("src").alias("block")).agg(F.count("*").alias("degree"))
    node = F.struct("place", F.lit("block").alias("category"), F.array("block").alias("opcodes"), F.coalesce("degree", F.lit(0)).alias("degree"), F.col("place").alias("rank"))
    nodes = blocks.join(degree, ["graph", "block"], "left").groupBy("graph").agg(F.array_sort(F.collect_list(node)).alias("nodes"))
    at = lambda c, n: blocks.select("graph", F.col("block").alias(c), F.col("place").alias(n))
    placed = edges.join(at("src", "a"), ["graph", "src"]).join(at("dst", "b"), ["graph", "dst"]).groupBy("graph").agg(F.collect_list(F.struct(F.col("a").alias("src"), F.col("b").alias("dst"), "kind")).alias("edges"))
    sides = nodes.join(placed, "graph", "left")
    side = lambda s: sides.select(F.col("graph").alias(s), F.col("nodes").alias(f"{s}_nodes"), F.col("edges").alias(f"{s}_edges"))
    pairs = flow.select("a", "b", "heuristic", "equivalent").join(side("a"), "a").join(side("b"), "b")
    exact = study.graph_edit_distances(pairs.withColumnRenamed("a", "key")).withColumnRenamed("distance", "exact")
    rows = study.compared(flow.select("a", "heuristic", "equivalent").join(exact, F.col("a") == F.col("key")))
    return study.agreement(rows.withColumn("half", F.col("a") % 2), "half")


# (opname wanted side, operand wanted, operand found, fragment, edited fragment)
EDITS = (
    ("BINARY_OP", "-", "+", "    return a + b * c", "    return a - b * c"), ("COMPARE_OP", ">=", "<", "if x < y:\n    f(x)", "if x >= y:\n    f(x)"), ("LOAD_CONST", "'new'", "'old'", "x = ['old', 1]", "x = ['new', 1]"),
    ("LOAD_FAST", "beta", "alpha", "g(alpha, 1)", "g(beta, 1)"), ("LOAD_ATTR", "close", "open", "return h.open()", "return h.close()"), ("IS_OP", "is not", "is", "y = x is None", "y = x is not None"),
    ("CONTAINS_OP", "in", "not in", "y = k not in d", "y = k in d"), ("FORMAT_VALUE", "!r", "", "s = f'a{x}b'", "s = f'a{x!r}b'"), ("LOAD_CONST", "3", "2", "x = 2\ny = x + 2", None),
)


_EDITED = " ".join(f"WHEN {i} THEN " + ("NULL" if e[4] is None else "'" + e[4].replace("'", "''").replace("\n", "' || chr(10) || '") + "'") for i, e in enumerate(EDITS))


@query(sql=f"SELECT p_partkey, CASE p_partkey % {len(EDITS)} {_EDITED} END AS edited FROM part")
def proposed_edits(spark: SparkSession, d: str) -> DataFrame:
    """Fragments edited as the one differing operand of their instructions asks; the last kind has two places and a wrong ordinal, so it stays."""
    at = lambda n: F.element_at(F.array(*(F.lit(e[n]) for e in EDITS)), (F.col("p_partkey") % len(EDITS) + 1).cast("int"))
    step = lambda op, arg: F.struct(op.alias("opname"), arg.alias("argval"))
    ends = lambda middle: F.array(step(F.lit("RESUME"), F.lit("0")), *middle, step(F.lit("RETURN_VALUE"), F.lit("")))
    again = [step(F.lit("LOAD_CONST"), F.lit("2"))] * 2
    before = F.when(at(4).isNull(), F.array(*again)).otherwise(F.array().cast("array<struct<opname:string,argval:string>>"))
    side = lambda n: F.concat(before, ends([step(at(0), at(n))]))
    rows = v.table(spark, d, "part").select(F.col("p_partkey").alias("key"), side(1).alias("gt"), side(2).alias("derived"), at(3).alias("fragment"))
    return editors.proposals(rows).select(F.col("key").alias("p_partkey"), "edited")


@query(sql="SELECT doc_id, sha1('{\"gt_target_identity\": null, \"iteration\": ' || doc_id % 4 || ', \"localized_line_number\": null, \"parent_target_identity\": null, \"qualname\": \"<module>.f' || doc_id || '\", \"repair_operation\": ' || coalesce('\"' || source || '\"', 'null') || ', \"source_col_offset\": null, \"source_end_col_offset\": null, \"source_end_lineno\": null, \"source_file_hash\": ' || doc_id || ', \"source_kind\": null, \"source_lineno\": null, \"step\": null, \"target_identity\": null}') AS case_id, doc_id % 2 AS success_count, CASE WHEN doc_id % 2 = 0 THEN 'f' ELSE '' END AS failed FROM documents WHERE doc_id % 3 <> 0")
def telemetry_records(spark: SparkSession, d: str) -> DataFrame:
    """Telemetry cases of accepted steps, a step a document; two in three are accepted."""
    from ..operators import records

    k = F.col("doc_id")
    steps = v.table(spark, d, "documents").select(
        k.alias("source_file_hash"), F.concat(F.lit("<module>.f"), k.cast("string")).alias("qualname"), F.col("source").alias("repair_operation"), (k % 4).alias("iteration"), (k % 3 != 0).alias("accepted"),
        F.array(F.struct(F.lit("f").alias("names"), (k % 2 == 1).alias("success"))).alias("results"),
    )
    rows = records.telemetry_cases(steps)
    return rows.select(F.col("source_file_hash").alias("doc_id"), "case_id", F.col("pylingual_after.success_count").cast("long").alias("success_count"), F.array_join("pylingual_after.failed_targets", ",").alias("failed"))
