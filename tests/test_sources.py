"""Readers, writers and the stream on small files."""

import json
import time

import pytest
from pyspark.sql import functions as F

from remedia import schemas
from remedia.sources import readers, writers
from remedia.streaming import deadlines


def test_csv_keeps_versions(spark, tmp_path):
    (tmp_path / "d.csv").write_text('file_hash,bytecode_version,source,more\nh1,3.10,PyPi,"a, ""b"""\n,,x,\n')
    rows = readers.read_csv(spark, f"{tmp_path}/d.csv").collect()
    assert rows[0]["bytecode_version"] == "3.10" and rows[0]["more"] == 'a, "b"' and rows[0]["error_type"] is None and len(rows) == 2


def test_jsonl(spark, tmp_path):
    kind = schemas.schema("a int, b string")
    path = tmp_path / "x.jsonl"
    path.write_text('{"a": 1, "b": "x"}\n\n[1]\n{"a": 2}\n')
    assert [tuple(r) for r in readers.read_jsonl_strict(spark, str(path), kind).collect()] == [(1, "x"), (2, None)]
    path.write_text('{"a": 1}\n{bad\n{"a": 2}\n')
    assert [r["a"] for r in readers.read_jsonl_lenient(spark, str(path), kind).collect()] == [1, 2]
    assert readers.read_jsonl_lenient(spark, f"{tmp_path}/missing", kind).count() == 0
    with pytest.raises(Exception, match="not JSON"):
        readers.read_jsonl_strict(spark, str(path), kind).collect()
    with pytest.raises(Exception):
        readers.read_jsonl(spark, str(path), kind).collect()
    assert readers.first_existing(spark, [f"{tmp_path}/no", str(path)]) == str(path)


def test_input_rows(spark, tmp_path):
    (tmp_path / "in.csv").write_text("file,file_hash,bytecode_version,error_type,error\na,h1,3.11,syntactic_error,e\nb,h2,3.11,semantic_error,e\nc, ,3.11,syntactic_error,e\nd,h4,2.7,syntactic_error,e\n")
    assert [r["file_hash"] for r in readers.read_input_rows(spark, f"{tmp_path}/in.csv").collect()] == ["h1"]


def test_files(spark, tmp_path):
    for name in ("h1/decompiler_output/indented_2.pyc", "h1/decompiler_output/indented_10.pyc", "h1/m.pyc", "h2/__pycache__/m.cpython-310.pyc"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    for root in (f"file://{tmp_path}", f"file:{tmp_path}", f"file://{tmp_path}/", str(tmp_path)):
        assert {r["file_hash"] for r in readers.list_files(spark, root).collect()} == {"h1", "h2"}
    files = readers.list_files(spark, f"file://{tmp_path}")
    best = {r["file_hash"]: r["path"] for r in readers.highest_indented(files).collect()}
    assert best["h1"].endswith("indented_10.pyc") and len(best) == 1 and readers.newest(files).count() == 2
    cases = spark.createDataFrame([("h1", "x"), ("h2", "PyPi"), ("h3", "x")], "file_hash string, source string")
    got = {r["file_hash"]: r for r in readers.resolve_pairs(cases, files).collect()}
    assert got["h1"]["gt_pyc"].endswith("m.pyc") and got["h1"]["status"] is None and got["h2"]["status"] == got["h3"]["status"] == "unresolved_pyc"
    assert cases.select(readers.gt_hash(F.lit("abc_12"))).first()[0] == "abc"


def test_writers(spark, tmp_path):
    rows = spark.createDataFrame([(1, ["a", "b"], None, 0.5), (2, [], "why", 1.0)], "k int, l array<string>, defer_reason string, x double")
    writers.write_split(rows, f"{tmp_path}/r", f"{tmp_path}/d", ["k", "l", "absent"], ["k", "defer_reason"])
    assert [tuple(r) for r in spark.read.csv(f"{tmp_path}/r", header=True).collect()] == [("1", "a, b", None)]
    assert [r["k"] for r in spark.read.csv(f"{tmp_path}/d", header=True).collect()] == ["2"]
    assert [r["x"] for r in writers.fixed_decimals(rows).collect()] == ["0.500000", "1.000000"]
    assert writers.not_done(rows, f"{tmp_path}/done", "k").count() == 2
    rows.filter("k = 1").select("k").write.parquet(f"{tmp_path}/done")
    assert [r["k"] for r in writers.not_done(rows, f"{tmp_path}/done", "k").collect()] == [2]
    writers.append_log(rows, f"{tmp_path}/log")
    writers.append_log(rows, f"{tmp_path}/log")
    assert spark.read.json(f"{tmp_path}/log").count() == 4


def test_stream_equals_fold(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    rows = [(k, at, (k * 7 + at * 13) % 41) for k in range(4) for at in range(0, 300, 20)]
    for i, part in enumerate((rows[::2], rows[1::2])):
        (folder / f"{i}.json").write_text("\n".join(json.dumps({"key": k, "at": at, "distance": d, "event_id": at}) for k, at, d in sorted(part, key=lambda r: r[1])))
    kind = "key long, at long, distance long, event_id long"
    batch = deadlines.fold(spark.read.schema(kind).json(str(folder)), 1000, 5000, 5000)
    want = {r["key"]: r["best"] for r in batch.collect()}
    out = deadlines.stream(spark.readStream.schema(kind).json(str(folder)), 1000, 5000, 5000)
    run = out.writeStream.format("memory").queryName("states").outputMode("update").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    end = time.monotonic() + 60
    # Timeouts by the clock keep a query running for as long as it is let, so it is stopped when its data are through.
    while sum(p["numInputRows"] for p in run.recentProgress) < len(rows) and time.monotonic() < end:
        time.sleep(0.3)
    run.stop()
    got = {r["key"]: r["best"] for r in spark.sql("SELECT key, min(best) AS best FROM states GROUP BY key").collect()}
    assert got == want
