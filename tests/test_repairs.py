"""Rewriting, source maps, reattachment, contexts, reports and studies on hand-made cases and against brute force."""

import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from remedia import cli
from remedia.functions import scalars, summaries
from remedia.operators import editors, localise, outcomes, reattach, records, rewrite, selection, sourcemap, study
from remedia.plans import repairs, texts
from remedia.sources import writers
from remedia.streaming import deadlines


@pytest.mark.parametrize(
    ("operator", "source", "want"),
    [
        (rewrite.balance_delimiters, "x = (1\ny = [2\n", "x = (1])\ny = [2\n"),
        (rewrite.balance_delimiters, 'x = """abc\ny\n', 'x = """abc\ny"""\n'),
        (rewrite.dedent_stray_block, "x = 1\n    y = 2\n    z = 3\nw = 4\n", "x = 1\ny = 2\nz = 3\nw = 4\n"),
        (rewrite.bad_lhs_rename, "a.b() = 1\nif x: f() = 2\n'q' = [1,\n", "_lit_a_b= 1\nif x: f() = 2\n_lit_q= [1,\n"),
        (rewrite.complete_truncated_statement, "x = 1\nvalues = ['one', 'two', 'thr", "x = 1\nvalues = ['one', 'two', 'thr']"),
        (rewrite.complete_truncated_statement, "values = ['one', (2, {'k': 3", "values = ['one', (2, {'k': 3})]"),
        (rewrite.complete_truncated_statement, "def some_function(a, b=(1, 2\nx = 1", "def some_function(a, b=(1, 2)):\n    pass\nx = 1"),
        (rewrite.clause_to_if_true, "else:\n    a\nx = 1\nexcept E:\n    b\n", "if True:\n    a\nx = 1\nif True:\n    b\n"),
        (rewrite.strip_surplus_leading_delimiters, "((if a:\n    b\n[[return x\n((a)\n", "if a:\n    b\nreturn x\n((a)\n"),
        (rewrite.normalize_leaked_generic_params, "def <generic parameters of f>(.defaults, x):\n    .5\n", "def _generic_f(_defaults, x):\n    .5\n"),
        (rewrite.rejoin_split_comprehension, "for k in y if k]\n    x = [k\nfor a in b)\n    (a\n", "x = [k for k in y if k]\n(a for a in b)\n"),
        (rewrite.reduce_doubled_for, "for a in b for a in [f(a)]:\n  for c in d for c in [g]: # x\nfor a in b for c in [h]:\n", "for a in b:\n    f(a)\n  for c in d:\n      g\nfor a in b for c in [h]:\n"),
        (rewrite.renest_flattened_for, "f(a) for a in b:\n[c for c in d:\ng, for e in h:\ni for j in k: # x\n", "for a in b:\n    f(a)\n[c for c in d:\ng, for e in h:\nfor j in k:\n    i\n"),
        (rewrite.give_headerless_block_a_body, "try:\nexcept E:\n    else:\nx = 1\nif a:\n    b\n", "try:\n    pass\nexcept E:\n    pass\n    else:\n        pass\nx = 1\nif a:\n    b\n"),
        (rewrite.fold_postinserted_handler_body, "try:\n    f()\nexcept E: # postinserted\ng()\nelse: # inserted\n    h()\n", "try:\n    f()\nexcept E: # postinserted\n    g()\nelse: # inserted\n    h()\n"),
        (rewrite.complete_all_orphan_try, "try:\n    f()\ntry:\n    g()\n", "try:\n    f()\nexcept Exception:\n    pass\ntry:\n    g()\nexcept Exception:\n    pass\n"),
        (rewrite.synthesize_try_for_orphan_handler, "f()\nexcept E:\n    g()\n", "try:\n    f()\nexcept E:\n    g()\n"),
        (rewrite.normalize_indentation, "def f():\n    x = 1\n  y = 2\n", None),
        (rewrite.literal_lhs_rename, "1 = a\n2 == b\n", "_lit_1 = a\n2 == b\n"),
    ],
)
def test_each_operator(operator, source, want):
    made = operator(source, rewrite.syntax_error(source))
    assert made == want if want is not None else rewrite.syntax_error(made) is None


def test_every_broken_source_is_repaired():
    used = set()
    for source in texts.BROKEN:
        fixed = rewrite.repair_source(source)
        assert rewrite.syntax_error(fixed["repaired"]) is None
        used.update(fixed["operations"])
    assert len(used) >= 18


def test_search_compiles_every_text_that_it_makes():
    step = lambda n: (lambda s, e: s + f"#{n}\n" if s.count("#") < 3 else None)
    operators = []
    for n in range(19):
        op = step(n)
        op.__name__ = f"op{n}"
        operators.append(op)
    gate = lambda s: None if s.endswith("#18\n#0\n#0\n") else SyntaxError("no")
    found = rewrite.exhaustive("x\n", tuple(operators), depth=3, states=19 + 19 * 19 + 19 * 19 * 19, gate=gate)
    assert found == ("x\n#18\n#0\n#0\n", ["op18", "op0", "op0"])
    asked = []
    rewrite.exhaustive("x\n", tuple(operators), depth=3, states=250, gate=lambda s: asked.append(s) or SyntaxError("no"))
    assert len(asked) == 251 and len(set(asked)) == 251


def test_literals_from_ground_truth():
    words = [f"word{i}" for i in range(20)]
    line = "    values = (" + ", ".join(map(repr, words[:12])) + ", 'wor"
    assert rewrite.is_cut_literal(line) and rewrite.recover_literal(line, [["other"], tuple(words)]) == "    values = (" + ", ".join(map(repr, words)) + ")"
    assert rewrite.recover_literal(line, [tuple(words), tuple(words[:12] + ["x"] * 8)]) is None
    source = f"def f():\n{line}\nx = 1\n"
    fixed = rewrite.repair_source(source, sequences=[tuple(words)])
    assert fixed["stage"] == "prepass" and fixed["operations"] == ["splice_truncated_literals"] and repr(words[-1]) in fixed["repaired"]


def test_neutralised_chunks_keep_lines():
    source = "x = 1\ndef f() y:\n  y\n  z\nw = 2\n"
    made, gone = rewrite.neutralise(source)
    assert rewrite.syntax_error(made) is None and gone == 3 and made.count("\n") == source.count("\n") and made.splitlines()[4] == "w = 2" and rewrite.CHUNK_MARKER in made
    assert rewrite.neutralise(source, fix=lambda c: "y = 3\n")[0] == "x = 1\ny = 3\n\n\nw = 2\n"


def test_rewrites_are_tagged(spark):
    rows = spark.createDataFrame([(1, "else:\n    x = 1\n"), (2, "x = (1\n"), (3, None)], "k int, source string")
    got = {r["k"]: r["control_flow_rewrites"] for r in rewrite.repair(rows, "source").collect()}
    assert got == {1: ["clause_to_if_true"], 2: [], 3: None}


def test_source_objects(spark):
    rows = spark.createDataFrame([(1, "def f(:\n"), (2, None), (3, "try:\n    a\nexcept A, B:\n    lambda: 0\nmatch x:\n    case 1 if (lambda: 1)():\n        pass\n")], "k int, source string")
    got = [(r["k"], r["idx"], r["kind"], r["context"]) for r in sourcemap.source_objects(rows, "k", "source").collect()]
    assert got == [(1, 0, "unparsed", None), (2, 0, "module", "module"), (3, 0, "module", "module"), (3, 1, "lambda", "body"), (3, 2, "lambda", "match_case")]
    assert sourcemap.parenthesised_handlers("try:\n  f()\nexcept* (A), B as e:\n  g()\nexcept (C, D):\n  h()\n") == "try:\n  f()\nexcept* ((A), B) as e:\n  g()\nexcept (C, D):\n  h()\n"
    assert sourcemap.parenthesised_handlers("x = '''\n") == "x = '''\n"


def test_ambiguous_targets(spark):
    kind = "file int, idx int, row_type string, source_qualname string, pyc_qualname string, matched boolean, source_line int, pyc_line int, source_collisions int, pyc_collisions int, source_path array<bigint>, pyc_path array<bigint>, source_occurrence int, pyc_occurrence int, source_col int, source_end_line int, source_end_col int"
    row = lambda idx, name, line, path, kind="mapped": (1, idx, kind, name, name, True, line, 5, 1, 1, path, None, 0, 0, 0, 9, 0)
    mapping = spark.createDataFrame([row(1, "f", 9, [0, 1]), row(2, "f", 6, [0, 2]), row(3, "f", 4, [0, 1]), row(4, "g", 1, None), row(5, "h", 1, None, "pyc_only")], kind)
    targets = spark.createDataFrame([(1, "f"), (1, "g"), (1, "h"), (1, "g"), (2, "f")], "file int, target string")
    got = {(r["file"], r["target"]): (r["status"], r["n_candidates"], r["idx"]) for r in sourcemap.resolve_targets(mapping, targets).collect()}
    assert got == {(1, "f"): ("ranked", 3, 3), (1, "g"): ("found", 1, 4), (1, "h"): ("missing", 0, None), (2, "f"): ("missing", 0, None)}
    strict = {r["target"]: (r["status"], r["idx"]) for r in sourcemap.resolve_targets(mapping, targets, strict=True).filter("file = 1").collect()}
    assert strict == {"f": ("ambiguous", None), "g": ("found", 4), "h": ("missing", None)}


def test_reattachment(spark):
    source = "import a\nclass K:\n    @d\n    def f(self):\n        return 1\n\nx = 1\n"
    span = reattach.Span(4, 4, 5, 16, "function")
    assert reattach.segment(source, span) == "def f(self):\n        return 1"
    made = reattach.reattach(source, span, "def f(self):\n    if a:\n        return 2")
    assert made.kind == "mapped:absolute_continuations_raw" and made.updated == source.replace("        return 1", "        if a:\n            return 2")
    assert reattach.reattach(source, span, "@e\ndef f(self): return 3").updated.count("@") == 2
    replaced = reattach.reattach(source, span, "g = 3")
    assert replaced.kind.startswith("ast_expanded") and "@d" not in replaced.updated and "    g = 3\n" in replaced.updated
    assert reattach.reattach(source, span, "def f(:").error is not None
    assert reattach.insert_missing(source, reattach.Span(2, 0, 5, 16, "class"), "def g(self):\n    return 2\n") == source.replace("\n\nx", "\n\n    def g(self):\n        return 2\n\nx")
    assert reattach.insert_missing("x = 1\n", None, "  y = 2") == "x = 1\n\ny = 2\n"
    rows = spark.createDataFrame([(1, source, 99, 0, 99, 1, "", "y"), (2, None, None, None, None, None, None, None)], "key int, source string, line int, col int, end_line int, end_col int, kind string, replacement string")
    assert [(r["key"], r["candidate"], r["parses"]) for r in reattach.reattach_rows(rows).collect()] == [(1, None, False), (2, None, False)]


def test_contexts():
    source = "import a\n\n@d\ndef f():\n    x = (1,\n         2\n    return x\n\ndef g():\n    return 1\n"
    assert localise.strategy_order("'(' was never closed") == ("delimiter", "block", "line") and localise.strategy_order(None) == ("line", "block", "delimiter")
    window = localise.context(source, 5, "'(' was never closed")
    assert window.start <= 5 <= window.end
    parsed = localise.context(source.replace("(1,", "(1,)").replace("         2\n", ""), 6, "invalid syntax")
    assert parsed.text == "def f():\n    x = (1,)\n    return x\n" + "\n" and (parsed.start, parsed.end) == (4, 7)
    assert localise.context(source, 99) is None and localise.context("", 1) is None and localise.context(source, None) is None
    closer = localise.context("a = 1\nb = 2)\nc = 3\n", 2, "unmatched ')'")
    assert closer.start <= 2 <= closer.end


def test_first_seen_candidates(spark):
    rng = random.Random(3)
    groups = [[(i, rng.choice(["a", "b", "c", None]), rng.choice(["x", "y", None, None])) for i in range(rng.randint(0, 9))] for _ in range(60)]
    groups.append([(0, "h1", "s1"), (1, "h2", "s1"), (2, "h2", "s2")])
    rows = spark.createDataFrame(list(enumerate(groups)), "k int, c array<struct<i:int,text_hash:string,shape_hash:string>>")
    got = {r["k"]: [c["i"] for c in r["kept"]] for r in rows.select("k", selection.first_seen(F.col("c")).alias("kept")).collect()}
    for k, group in enumerate(groups):
        kept, texts_seen, shapes = [], set(), set()
        for i, text, shape in group:
            if (text and text in texts_seen) or (shape and shape in shapes):
                continue
            kept.append(i)
            texts_seen.add(text)
            shapes.add(shape)
        assert got[k] == kept
    assert got[60] == [0, 2]


def test_scalars_of_reports(spark, monkeypatch):
    strings = ["plain", "a\"b\\c\n\t\r\x01", "é語🙂 </x>", "", None, "~ \x7f"]
    rows = spark.createDataFrame([(i, s, i % 2 == 0) for i, s in enumerate(strings)], "n int, s string, b boolean")
    import hashlib

    for r in rows.select("*", scalars.case_id({"s": F.col("s"), "n": F.col("n"), "b": F.col("b")}).alias("id")).collect():
        assert r["id"] == hashlib.sha1(json.dumps({"s": r["s"], "n": r["n"], "b": r["b"]}, sort_keys=True).encode()).hexdigest()
    long = "x = '" + "a" * 40 + "'\ny = \"" + "b\\\"" * 20 + '"\nz = \'short\'\n'
    cut, found = scalars.elide_literals(long, 30)
    assert len(found) == 2 and len(cut) < len(long) and scalars.restore_literals(cut, found) == (long, True)
    assert scalars.restore_literals(cut.replace("PAYLOAD_0", "LOST"), found)[1] is False
    monkeypatch.setenv("A_FLAG", " Yes ")
    monkeypatch.setenv("A_NUMBER", "77")
    assert scalars.flag("A_FLAG") and not scalars.flag("NO_FLAG") and scalars.bounded_int("A_NUMBER", 5, 0, 50) == 50 and scalars.bounded_int("NO_NUMBER", 5, 0, 50) == 5
    record = spark.sql("""SELECT parse_json('{"a": {"b": "x"}, "c": 1}') AS r""")
    assert record.select(scalars.nested(F.col("r"), "a.b"), scalars.nested(F.col("r"), "c.b")).first()[:] == ("x", None)
    lists = {"names_added": F.array(F.lit("os"), F.lit("sys")), "names_removed": F.array().cast("array<string>")}
    said = record.select(summaries.guidance(lists, F.lit("insert_missing")), summaries.guidance({"names_removed": lists["names_removed"]}, F.lit(None))).first()
    assert said[0].splitlines()[1].startswith("- Prior accepted edits restored missing references to: os, sys. If these") and said[0].count("\n") == 3 and said[1] == ""
    audit = record.select(outcomes.line_audit(F.lit("a\n\n b \nc"), F.lit("b\nd\n")).alias("x")).first()["x"]
    assert tuple(audit) == (3, 2, 1, 2, 1)
    steps = spark.sql("SELECT array(named_struct('accepted', true), named_struct('accepted', null), named_struct('accepted', true)) AS s")
    assert steps.select(outcomes.accepted_steps(F.col("s"))).first()[0] == 2


def test_graph_edit_distance_against_all_assignments(spark):
    rng = random.Random(1)

    def graph(n):
        nodes = [{"category": rng.choice(["block", "block", "start"]), "opcodes": rng.choices("abc", k=rng.randint(0, 3)), "degree": rng.randint(0, 2), "rank": i} for i in range(n)]
        return nodes, {(i, j): rng.choice("xy") for i in range(n) for j in range(n) if rng.random() < 0.4}

    def slow(a, b):
        (nodes_a, edges_a), (nodes_b, edges_b) = a, b
        best = 10**9
        for to in itertools.product([*range(len(nodes_b)), None], repeat=len(nodes_a)):
            used = [j for j in to if j is not None]
            if len(set(used)) == len(used):
                moved = {(to[i], to[k]): kind for (i, k), kind in edges_a.items()}
                cost = sum(study._alone(nodes_a[i]) if j is None else study.node_cost(nodes_a[i], nodes_b[j]) for i, j in enumerate(to)) + sum(study._alone(n) for j, n in enumerate(nodes_b) if j not in used)
                cost += sum(to[i] is None or to[k] is None or edges_b.get((to[i], to[k])) != kind for (i, k), kind in edges_a.items())
                best = min(best, cost + sum(e not in moved for e in edges_b))
        return best

    for _ in range(120):
        a, b = graph(rng.randint(0, 4)), graph(rng.randint(0, 4))
        assert study.edit_distance(*a, *b) == slow(a, b)
    assert study.edit_distance(*graph(9), *graph(9), steps=10) is None
    kind = "array<struct<category:string,opcodes:array<string>,degree:int,rank:int>>"
    rows = spark.createDataFrame([(1, None, None, None, None), (2, [("block", ["a"], 0, i) for i in range(13)], None, None, None)], f"key int, a_nodes {kind}, a_edges array<struct<src:int,dst:int,kind:string>>, b_nodes {kind}, b_edges array<struct<src:int,dst:int,kind:string>>")
    assert {r["key"]: r["distance"] for r in study.graph_edit_distances(rows).collect()} == {1: 0, 2: None}


def test_candidates_of_users(spark):
    got = {r["user_id"]: r["kept"] for r in repairs.first_seen_candidates(spark, "/root/testdata/sf0.001").collect()}
    by: dict = {}
    for e in sorted(spark.read.parquet("/root/testdata/sf0.001/events.parquet").collect(), key=lambda e: (e["ts"], e["event_id"])):
        by.setdefault(e["user_id"], []).append((e["event_id"], e["event_type"] + str(int(e["value"] // 40)), str(int(e["value"] // 15)) if e["value"] < 150 else None))
    for user, events in by.items():
        kept, seen, shapes = [], set(), set()
        for i, text, shape in events:
            if text not in seen and shape not in shapes:
                kept.append(i)
                seen.add(text)
                shapes |= {shape} - {None}
        assert got[user] == kept


def test_edits_of_operands():
    for op, wanted, found, fragment, edited in repairs.EDITS[:-1]:
        made = editors.operand_edit(fragment, op, wanted, found)
        assert made.text == edited and made.confidence == "unique"
    two = "x = a + b\ny = c + d"
    assert editors.operand_edit(two, "BINARY_OP", "*", "+", 1).text == "x = a + b\ny = c * d" and editors.operand_edit(two, "BINARY_OP", "*", "+", 5) is None
    assert editors.operand_edit("[k + 1 for k in a + b]", "BINARY_OP", "*", "+", 1) is None  # evaluation isn't tree order there
    assert editors.operand_edit("x = True == 1", "LOAD_CONST", "2", "1").text == "x = True == 2" and editors.operand_edit("f(-5, 5)", "LOAD_CONST", "7", "-5").text == "f(7, 5)"
    assert editors.operand_edit("s = 'é' + name", "LOAD_NAME", "other", "name").text == "s = 'é' + other" and editors.operand_edit("x = (", "LOAD_NAME", "a", "b") is None
    assert editors.operand_edit("f(a)", "CALL", "2", "1") is None and editors.operand_edit("x = 1", "LOAD_CONST", "<code>", "1") is None
    assert editors.unary_edit("  return a + b", "UNARY_NEGATIVE", None, "b").text == "  return a + (-b)" and editors.unary_edit("f(a)", "TO_BOOL", None, "a").text == "f(bool(a))"
    assert editors.unary_edit("x = not y", None, "UNARY_NOT").text == "x = y" and editors.unary_edit("x = -y", "UNARY_INVERT", "UNARY_NEGATIVE").text == "x = (~y)"
    assert editors.unary_edit("a + a", "UNARY_NOT", None, "a") is None and editors.unary_edit("x = y", None, "UNARY_NOT") is None
    load = ("LOAD_FAST", "x")
    assert editors.proposed([load, ("UNARY_NOT", ""), ("RETURN_VALUE", "")], [load, ("RETURN_VALUE", "")], "return x").text == "return (not x)"
    assert editors.proposed([load], [load], "x") is None and editors.proposed([load, load], [("LOAD_FAST", "y"), ("LOAD_GLOBAL", "z")], "y(z)") is None
    assert editors.proposed([("LOAD_FAST_BORROW", "x")], [("LOAD_FAST", "y")], "return y").text == "return x"


def test_no_proposal_for_empty_rows(spark):
    kind = "array<struct<opname:string,argval:string>>"
    rows = spark.createDataFrame([(1, None, None, None), (2, [], [("NOP", None)], "x")], f"key int, gt {kind}, derived {kind}, fragment string")
    assert [tuple(r)[1:] for r in editors.proposals(rows).collect()] == [(None, None, None)] * 2


def test_time_runs_out(spark):
    rows = spark.createDataFrame([(1, "x = (1\n"), (2, None)], "k int, source string")
    assert {r["k"]: r["stage"] for r in rewrite.repair(rows, "source", seconds=-1.0).collect()} == {1: "timed_out", 2: None}
    assert {r["k"]: r["stage"] for r in rewrite.repair(rows, "source", seconds=60.0).collect()} == {1: "prepass", 2: None}


def test_records_of_accepted_steps(spark):
    steps = spark.createDataFrame([("h", "q", True, "a", "b", [("f", True), ("g", None)]), ("h", "r", False, "a", "b", None), ("h", "s", True, None, None, None)], "source_file_hash string, qualname string, accepted boolean, extracted_before string, replacement_text string, results array<struct<names:string,success:boolean>>")
    got = {r["qualname"]: r for r in records.telemetry_cases(steps).collect()}
    assert set(got) == {"q", "s"} and tuple(got["q"]["pylingual_after"]) == (False, 1, ["g"]) and tuple(got["s"]["pylingual_after"]) == (None, None, [])
    import hashlib

    want = {n: None for n in records.FINGERPRINT} | {"source_file_hash": "h", "qualname": "q"}
    assert got["q"]["case_id"] == hashlib.sha1(json.dumps(want, sort_keys=True).encode()).hexdigest() and got["q"]["after_fragment"] == "b"
    assert {r["qualname"]: r["replacement_text"] for r in records.accepted_objects(steps).collect()} == {"q": "b", "s": None}


def test_resume_and_mapping_files(spark, tmp_path):
    rows = spark.createDataFrame([(1,), (2,), (3,)], "k long")
    todo, done = writers.resumed(rows, f"{tmp_path}/none", "k")
    assert todo.count() == 3 and done is None
    spark.createDataFrame([(1, "ok"), (2, None)], "k long, final_summary string").write.json(f"{tmp_path}/done")
    todo, done = writers.resumed(rows, f"{tmp_path}/done", "k")
    assert sorted(r["k"] for r in todo.collect()) == [2, 3] and [r["k"] for r in done.collect()] == [1]
    writers.write_mapping(spark.createDataFrame([("mapped", [0, 1], 5)], "row_type string, source_ordinal_path array<int>, extra int"), f"{tmp_path}/m")
    back = spark.read.csv(f"{tmp_path}/m", header=True)
    assert back.columns == list(writers.MAPPING_COLUMNS) and back.first()["source_ordinal_path"] == "0.1"


def test_command_line(spark, tmp_path, capsys):
    assert cli.main(["queries"]) == 0 and "outcome_rollup" in capsys.readouterr().out
    assert cli.main(["run", "no_such", "x"], spark) == 2
    assert cli.main(["run", "run_counters", "/root/testdata/sf0.001", "--out", f"{tmp_path}/o"], spark) == 0 and spark.read.parquet(f"{tmp_path}/o").count() == 5
    spark.createDataFrame([(1, "x = (1\n")], "k int, source string").write.parquet(f"{tmp_path}/in")
    assert cli.main(["repair", f"{tmp_path}/in", f"{tmp_path}/out", "--seconds", "30"], spark) == 0
    assert spark.read.parquet(f"{tmp_path}/out").first()["repaired"] == "x = (1)\n"


class Kept:
    """A key's state as a stream keeps it."""

    def __init__(self):
        self.get, self.hasTimedOut, self.wait = None, False, None

    exists = property(lambda self: self.get is not None)

    def update(self, value):
        self.get = value

    def remove(self):
        self.get = None

    def setTimeoutDuration(self, ms):  # noqa: N802
        self.wait = ms


def test_deadlines_pass_without_observations():
    import pandas as pd

    turn = lambda state, *seen: [tuple(r) for f in deadlines.observed(("k",), [pd.DataFrame(seen, columns=["at", "distance"])] if seen else [], state, 10, 100, 50) for r in f.itertuples(index=False)]
    state = Kept()
    assert turn(state, (0, 9), (2, 5)) == [("k", "running", 2, 5, 9, 10)] and state.wait == 9000
    state.hasTimedOut = True
    assert turn(state) == [("k", "extended", 2, 5, 9, 21)] and state.wait == 11_000
    assert turn(state) == [("k", "failed", 2, 5, 9, 21)] and state.wait == deadlines.REMEMBERED_MS
    assert turn(state) == [] and not state.exists
    state.hasTimedOut = False
    assert turn(state, (7, 3)) == [("k", "running", 1, 3, 3, 17)]
