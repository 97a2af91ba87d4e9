"""Scalar functions and labels on hand-computed cases."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from remedia.functions import labels, scalars
from remedia.operators import selection


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_messages(spark):
    rows = [("bad token (line 42)",), ("",), (None,), ("  Oops (x) MORE (y) ",)]
    got = values(spark, rows, "m string", scalars.line_number(F.col("m")), scalars.clean_message(F.col("m")))
    assert got == [(42, "bad token"), (None, None), (None, None), (None, "oops  more")]


def test_versions(spark):
    rows = [("3.1",), ("3.11.4",), ("12",), ("313",), ("3.9",), ("x",), (None,), (" 3.14 ",), ("4.12",)]
    got = values(spark, rows, "v string", scalars.version_text(F.col("v")))
    assert [g[0] for g in got] == ["3.10", "3.11", "3.12", "3.13", None, None, None, "3.14", None]


def test_null_normaliser(spark):
    got = values(spark, [("NaN",), (" ",), (None,), (" a ",)], "x string", scalars.normalised_cell(F.col("x")))
    assert [g[0] for g in got] == [None, None, None, "a"]


def test_outcomes(spark):
    rows = [
        (None, None, None, None, None), (False, None, None, None, None), (True, True, 50, None, None), (True, True, 51, None, None), (True, True, 0, None, None),
        (True, False, 99, None, True), (True, True, None, 7, None), (True, None, None, None, None),
    ]
    c = F.col
    got = values(spark, rows, "ok boolean, fb boolean, m int, t int, fc boolean", labels.outcome(c("ok"), c("fb"), c("m"), c("t"), c("fc"), F.lit(None).cast("boolean")))
    assert [g[0] for g in got] == ["out_of_scope", "failed", "light_deletion", "heavy_deletion", "genuine", "neutralised_compile", "light_deletion", "genuine"]


def test_decompile_status(spark):
    rows = [(False, 1, None), (False, 0, None), (False, 0, 99.9), (False, 0, 100.0), (True, 1, None)]
    got = values(spark, rows, "s boolean, rc int, rate double", labels.decompile_status(F.col("s"), F.col("rc"), F.col("rate")))
    assert [g[0] for g in got] == ["decompiler_failure", "unknown", "semantic_error", "success", "syntactic_error"]


def test_alignment_orders_differ(spark):
    rows = [("repair_module_statement", "replace")]
    got = values(spark, rows, "o string, t string", labels.indexed_alignment(F.col("o"), F.col("t")), labels.queried_alignment(F.col("o"), F.col("t")))
    assert got == [("replace", "module_statement")]


def test_names(spark):
    rows = [("<module>.f.<lambda>",), ("<module>.f.__annotate__",), ("<module>",), ("<module>.a.b.c",)]
    got = values(spark, rows, "n string", scalars.expression_parent(F.col("n")), scalars.expression_kind(F.col("n")), scalars.is_synthetic(F.col("n")), scalars.ancestors(F.col("n")))
    assert got[0][:3] == ("<module>.f", "lambda", False)
    assert got[1][2] is True and got[2][3] == []
    assert got[3][3] == ["<module>.a", "<module>.a.b"]


def test_hash_and_case_id(spark):
    rows = [("  a  \nb \n", 'q"x\\')]
    got = values(spark, rows, "t string, k string", scalars.replacement_hash(F.col("t")), scalars.case_id({"z": F.col("k"), "a": F.lit("1")}))
    assert got[0][0] == hashlib.sha256(b"a\nb").hexdigest()
    assert got[0][1] == hashlib.sha1(json.dumps({"z": 'q"x\\', "a": "1"}, sort_keys=True).encode()).hexdigest()


def test_text_helpers(spark):
    rows = [("    x\n      y\n\n", "```python\nz = 1\n```")]
    got = values(spark, rows, "t string, f string", scalars.dedented(F.col("t")), scalars.code_fence_removed(F.col("f")), scalars.unnumbered_lines(scalars.numbered_lines(F.col("f"))))
    assert got == [("x\n  y\n\n", "z = 1", "```python\nz = 1\n```")]


def test_traceback(spark):
    text = 'Traceback (most recent call last):\n  File "a.py", line 3\nValueError: bad\nKeyError: x'
    got = values(spark, [(text,), ("fine",)], "t string", scalars.traceback_error(F.col("t")))
    assert tuple(got[0][0]) == ("ValueError", "bad") and tuple(got[1][0]) == (None, None)


def test_row_ranges():
    assert selection.parse_row_range("2:4") == (2, 4)
    assert selection.parse_row_range("3") == (3, 4)
    assert selection.parse_row_range(":0") == (0, 0)
    assert selection.parse_row_range("5:") == (5, None)
    assert selection.parse_row_range(":") == (0, None)
    for bad in ("5:2", "-1", "", "a"):
        with pytest.raises(ValueError):
            selection.parse_row_range(bad)


def test_defer_reasons(spark):
    c = F.col
    got = values(spark, [(201, 3, 1, 0), (1, 1, 0, 0), (None, None, None, None)], "d int, t int, m int, e int", selection.defer_reasons(c("d"), c("t"), c("m"), c("e")))
    assert [g[0] for g in got] == ["initial_combined_distance 201 exceeds 200; repair_target_count 3 exceeds 2; missing_target_count 1 is nonzero", None, None]


def test_retry_counts_unknown_as_failed(spark):
    cases = spark.createDataFrame([("a",), ("b",), ("c",), (None,)], "file_hash string")
    log = spark.createDataFrame([("a", None), ("b", True), ("b", False)], "file_hash string, compiled_success boolean")
    assert [r[0] for r in selection.retry_failed(cases, log).collect()] == ["a"]
    assert sorted(str(r[0]) for r in selection.skip_done(cases, log).collect()) == ["None", "c"]
