"""Operators on hand-computed cases and against plain loops."""

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from remedia.functions import fragments
from remedia.operators import alignment, distance, localise, outcomes, retrieval, rewrite, state
from remedia.streaming import deadlines


def levenshtein(a, b):
    rows = [[2 * (i + j) if not i or not j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            cost = 0 if x == y else 1 if (x[0] == y[0]) != (x[1] == y[1]) else 2
            rows[i][j] = min(rows[i - 1][j] + 2, rows[i][j - 1] + 2, rows[i - 1][j - 1] + cost)
    return rows[-1][-1]


def test_edit_distance_matches_recursion():
    assert distance.weighted_edit_distance([("A", "")], [("A", ""), ("B", "")]) == 2
    assert distance.weighted_edit_distance([], [("A", "")] * 3) == 6
    rng = random.Random(4)
    for _ in range(200):
        a, b = ([(rng.choice("abc"), rng.choice("xy"), rng.random() < 0.5) for _ in range(rng.randint(0, 9))] for _ in range(2))
        assert distance.weighted_edit_distance(a, b) == levenshtein(a, b)


def test_substitution_cost(spark):
    rows = [(("A", "1", True), ("A", "1", True)), (("A", "1", True), ("A", "2", True)), (("A", "1", True), ("B", "2", True)), (("A", "1", True), ("A", "1", False))]
    df = spark.createDataFrame(rows, "a struct<opcode string, argval string, j boolean>, b struct<opcode string, argval string, j boolean>")
    of = lambda s: lambda n: F.col(f"{s}.{n}")
    assert [r[0] for r in df.select(distance.substitution_cost(of("a"), of("b"), ["opcode", "argval", "j"])).collect()] == [0, 1, 2, 2]


def test_combined_distance(spark):
    df = spark.createDataFrame([(4, 2), (0, 5)], "i int, c int")
    assert [r[0] for r in df.select(distance.combined(F.col("i"), F.col("c"))).collect()] == [12, 15]
    missing = spark.createDataFrame([("missing", 10, 3, 10, 3), ("extra", 10, 3, 10, 3)], "status string, instruction_distance int, control_flow_distance int, instruction_basis int, cfg_basis int")
    assert [r["combined_distance"] for r in distance.comparison_rows(missing).collect()] == [26, 24]


def test_exception_tables(spark):
    df = spark.createDataFrame([([(1, 2, 3, 0)], [(1, 2, 3, 0), (4, 5, 6, 1)])], "a array<struct<s int, e int, t int, d int>>, b array<struct<s int, e int, t int, d int>>")
    assert df.select(distance.exception_distance(F.col("a"), F.col("b"))).first()[0] == 1


def test_ranks_and_correlation(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 1.0), (2, 1.0), (3, 1.0)], "x int, y double")
    got = sorted((r["x"], r["r"]) for r in distance.average_ranks(df, "x", "r").collect())
    assert got == [(1, 1.0), (2, 2.5), (2, 2.5), (3, 4.0)]
    assert df.agg(distance.pearson("x", "y")).first()[0] is None


def test_flow_distance_by_hand(spark):
    blocks = spark.createDataFrame([("a", "p", 0), ("a", "q", 1), ("a", "r", 2), ("b", "p", 0), ("b", "q", 1)], "graph string, block string, place int")
    edges = spark.createDataFrame([("a", "p", "q", "x"), ("a", "p", "r", "x"), ("a", "q", "r", "y"), ("b", "p", "q", "x"), ("b", "q", "p", "x")], "graph string, src string, dst string, kind string")
    pairs = spark.createDataFrame([("a", "b"), ("a", "a")], "a string, b string")
    got = {(r["a"], r["b"]): r for r in distance.flow_distances(pairs, distance.graphs(edges, blocks)).collect()}
    r = got["a", "b"]
    # one block, one edge, one branch; x 2 against 2 and y 1 against 0; b's q to p has no counterpart
    assert (r["block_diff"], r["edge_diff"], r["branch_diff"], r["kind_diff"], r["successor_diff"]) == (1, 1, 1, 1, 1)
    assert not r["equivalent"] and r["distance"] == 5 and got["a", "a"]["distance"] == 0


def test_multiset_delta(spark):
    df = spark.createDataFrame([(1, "a\nb\na", "a\nc"), (2, "", "x"), (3, "x", None)], "k int, before string, after string")
    assert sorted(tuple(r) for r in outcomes.deleted_lines(df, "k", "before", "after").collect()) == [(1, 2), (2, 0), (3, 0)]


def test_compare_states(spark):
    schema = "file string, names string, success boolean, message string, failed_offset int"
    before = spark.createDataFrame([("1", "f", False, "Different bytecode", 8), ("2", "f", True, None, None)], schema)
    after = spark.createDataFrame([("1", "f", False, "Different bytecode", 12), ("1", "g", True, None, None)], schema)
    got = {r["file"]: (r["improved"], r["regressed"]) for r in state.compare(before, after).collect()}
    assert got == {"1": (["f", "g"], []), "2": ([], ["f"])}


def test_accept(spark):
    df = spark.createDataFrame([(10, 9, 5, 4), (10, 9, 5, 5), (10, 10, 4, 5), (10, 9, None, 1)], "a int, b int, c int, d int")
    assert [r[0] for r in df.select(state.accept_by_distance(*map(F.col, "abcd"))).collect()] == [False, True, True, True]


def test_targets(spark):
    names = ["<module>", "<module>.f", "<module>.f.g", "<module>.h.k"]
    rows = spark.createDataFrame([("x", "matched", n, n, 3) for n in names], "file string, status string, gt_name string, derived_name string, combined_distance int")
    assert sorted(r["target"] for r in state.repair_targets(rows).collect()) == ["<module>", "<module>.f", "<module>.h.k"]


def test_consensus_and_penalties(spark):
    pairs = spark.createDataFrame([(0, i, "x", s) for i, s in enumerate((16, 20, 14))], "q_idx int, p_idx int, action_type string, score int")
    r = retrieval.ranked(pairs).first()
    assert (r["adjusted"], r["best"], r["best_idx"]) == (22, 20, 1)
    attempts = spark.createDataFrame([(0, 1, ["y", "z"]), (0, 2, ["x", "y"])], "q_idx int, attempt int, action_types array<string>")
    assert {r["action_type"]: r["penalty"] for r in retrieval.rejection_penalties(attempts).collect()} == {"x": 18, "y": 8, "z": 4}


def test_align_names():
    rng = random.Random(1)
    for _ in range(50):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 8))] for _ in range(2))
        got = alignment.align_names(a, b)
        assert [x for _, x, _ in got if x is not None] == list(range(len(a))) and [y for _, _, y in got if y is not None] == list(range(len(b)))
        assert sum(s == "matched" for s, *_ in got) == sum(m.size for m in SequenceMatcher(None, a, b).get_matching_blocks())


def test_mapping_cascade(spark):
    schema = "file string, side string, idx int, scope_path string, base_name string, line int, occurrence int, ordinal_path string, child_count int"
    rows = [
        ("f", "source", 0, "m", "a", 1, 0, "0", 0), ("f", "pyc", 0, "m", "a", 1, 0, "9", 0),  # exact
        ("f", "source", 1, "m", "b", 5, 0, "1", 0), ("f", "pyc", 1, "m", "b", 9, 3, "1", 7),  # ordinal path
        ("f", "source", 2, "m", "c", 5, 1, "2", 0), ("f", "pyc", 2, "m", "c", 8, 1, "x", 0), ("f", "pyc", 3, "m", "c", 9, 2, "y", 0),  # occurrence
        ("f", "source", 3, "m", "d", 5, 1, "3", 2),  # nothing
    ]
    got = {(r["source_idx"], r["pyc_idx"]): r["reason"] for r in alignment.map_objects(spark.createDataFrame(rows, schema)).collect()}
    assert got == {
        (0, 0): "exact(scope,name,line,occurrence)", (1, 1): "fallback(scope,name,ordinal_path)", (2, 2): "fallback(scope,name,occurrence)", (3, None): "unmatched_source", (None, 3): "unmatched_pyc",
    }


def test_first_seen():
    assert fragments.first_seen([("h1", "s1"), ("h2", "s1"), ("h2", "s2")]) == [0, 2]


def test_fragment_features():
    f = fragments.fragment_features("    def f(a):\n        if a > 1 and g(a.b[0], k=2):\n            return a + 1\n")
    assert f["parsed"] and f["call_count"] == 1 and f["call_keyword_count"] == 1 and f["boolop_count"] == 1 and f["return_value_kinds"] == ["BinOp"]
    assert f["control_flow_nodes"] == ["If"] and f["statement_types"] == ["FunctionDef"] and f["line_count"] == 3
    bad = fragments.fragment_features("x = (")
    assert not bad["parsed"] and bad["char_count"] == 5 and bad["call_count"] == 0


def test_clamp():
    lines = [f"{i}\n" for i in range(9)]
    count = len
    assert localise.clamp(lines, 4, 100, count) == (0, 9)
    assert localise.clamp(lines, 4, 6, count) == (3, 6)
    assert localise.clamp(lines, 0, 4, count) == (0, 2)
    assert localise.clamp(["long line"], 0, 3, count) is None and localise.clamp([], 0, 3, count) is None


def test_windows():
    source = "def f():\n    x = g(\n        1,\n    )\n    return x\n\ny = 2\n"
    w = localise.minimal_window(source, 2)
    assert (w.start, w.end, w.indent) == (2, 4, "    ")
    assert localise.minimal_window(source, 2, 1).start == 1 and localise.minimal_window(source, 7, 2).start == 7
    assert localise.object_span(source.splitlines(keepends=True), 3) == (1, 6)
    assert localise.reattach(source, w, "x = 1") == "def f():\n    x = 1\n    return x\n\ny = 2\n"
    assert localise.cause(source, 5, "unexpected indent") == (4, "unexpected_indent_prev_line")
    assert localise.roles(1) == ["B/E"] and localise.roles(3) == ["B", "I", "E"]


def test_chunks():
    source = "import a\nfrom b import c\nx = 1\n\n@d\ndef f():\n    return 1\nclass K:\n    pass\n"
    objects = localise.top_level_objects(source)
    assert [k for k, _ in objects] == ["imports", "global", "function", "class"]
    assert "".join(t for _, t in objects) == source
    assert "".join(localise.pack([t for _, t in objects], 8, localise.chunk_tokens)) == source


@pytest.mark.parametrize(
    "source",
    ["x = (1 + 2\ny = 3\n", "12 = x\n", "try:\n    f()\nx = 1\n", "if a:\nx = 1\n", "x = 1\n    y = 2\n", "f(1, 2))\n", "x = [1, 2)\n", "def <generic parameters of f>():\n    pass\n", "else:\n    x = 1\n", "x = 'abc\n"],
)
def test_repairs_compile(source):
    fixed = rewrite.repair_source(source)
    assert fixed["repaired"] is not None and rewrite.syntax_error(fixed["repaired"]) is None and fixed["stage"] != "clean"


def test_single_operators():
    error = rewrite.syntax_error
    assert rewrite.literal_lhs_rename("12 = x\n", error("12 = x\n")) == "_lit_12 = x\n"
    assert rewrite.complete_orphan_try("try:\n    f()\n", None) == "try:\n    f()\nexcept Exception:\n    pass\n"
    assert rewrite.retype_mismatched_closer("x = [1, 2)\n", error("x = [1, 2)\n")) == "x = [1, 2]\n"
    assert rewrite.drop_surplus_closer("f(1))\n", error("f(1))\n")) == "f(1)\n"
    assert rewrite.clause_to_if_true("else:\n    x = 1\n", None) == "if True:\n    x = 1\n"
    assert rewrite.renest_flattened_for("print_it for a in b:\n", None) == "for a in b:\n    print_it\n"
    assert rewrite.fix_numeric_literal("1_", None) is None
    assert rewrite.delete_until_compilable("x = 1\n)(\ny = 2")[0] == "x = 1\ny = 2"
    assert rewrite.syntax_error(rewrite.neutralise("def f(:\n  x\ny = 1\n")[0]) is None


def test_deadline_fold(spark):
    rng = random.Random(2)
    rows = [Row(key=k, at=at, distance=rng.randint(0, 40), event_id=i) for k in range(6) for i, at in enumerate(sorted(rng.randint(0, 400) for _ in range(12)))]
    want = {}
    for r in rows:
        want[r.key] = deadlines.step(want.get(r.key), r.at, r.distance, 30, 300, 100)
    got = {r["key"]: (r["status"], r["best"], r["n"]) for r in deadlines.fold(spark.createDataFrame(rows), 30, 300, 100).collect()}
    assert got == {k: (s["status"], s["best"], s["n"]) for k, s in want.items()}


def test_patterns_from_telemetry(spark):
    from remedia.operators import mining

    side = "struct<names array<string>, consts array<string>, varnames array<string>, argcount int, posonlyargcount int, kwonlyargcount int, flags int>"
    meta = lambda names, consts: (names, consts, [], 0, 0, 0, 3)
    rows = [
        (0, "c0", True, "repair_source_fragment", "f", "replace", "x = 1\n", "if a:\n    x = 1\n", "POP_JUMP_IF_FALSE", None, None, meta(["a"], []), meta([], []), -5),
        (1, "c1", True, "repair_source_fragment", "f", None, "return f(1)\n", "return f(2)\n", "LOAD_CONST", None, None, meta([], ["2"]), meta([], ["1"]), -1),
        (2, "c2", True, "insert_missing", "f", "", None, "def g(): pass\n", None, None, None, meta([], []), None, None),
        (3, "c3", False, "insert_missing", "f", "", None, "", None, None, None, None, None, None),
    ]
    names = "row_idx int, case_id string, accepted boolean, repair_operation string, target_kind string, alignment_tag string, before_fragment string, after_fragment string, instruction_diff string, "
    cases = spark.createDataFrame(rows, names + f"gt_window string, derived_window string, gt {side}, derived {side}, combined_distance_delta int")
    got = {r["case_id"]: r for r in mining.build_patterns(cases).collect()}
    assert set(got) == {"c0", "c1", "c2"}
    assert got["c0"]["action_type"] == "add_missing_control_flow" and got["c0"]["instruction_has_jump"] and got["c0"]["gt_only_names_count"] == 1
    assert got["c1"]["action_type"] == "adjust_return_call_expression" and got["c1"]["alignment_category"] == "unknown"
    assert got["c2"]["action_type"] == "insert_missing_definition_fragment" and got["c2"]["alignment_category"] == "insert"
    stored = spark.createDataFrame(list(got.values()), mining.build_patterns(cases).schema)  # patterns are a stored table in use
    assert retrieval.pair_scores(stored, stored, least=-100).count() == 2
