"""Queries over whole texts and tables against brute force, with what a cut would lose planted behind it."""

from remedia.plans import selection, texts
from remedia.plans import views as v

FILLER = " ".join(f"w{i}" for i in range(70))


def documents(spark, folder, rows):
    spark.createDataFrame(rows, "doc_id long, source string, text string").write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def test_superset_of_whole_texts(spark, tmp_path):
    rows = [(0, "a", "y x"), (1, "a", "x y"), (2, "a", f"{FILLER} x Y"), (3, "a", "x y z"), (4, "a", f"{FILLER} q"), (5, "b", "x y"), (6, "a", "z y x"), (7, "a", "Y x"), (20, "a", f"q {FILLER}"), (40, "b", "y"), (60, "a", "absent"), (80, "b", "none  of"), (8, "b", None), (9, "b", "x  y"), (10, None, "x y"), (11, "a", "")]
    sets = {i: (s, set(t.lower().split(" "))) for i, s, t in rows if t is not None and s}
    want = {i: min((-len(c), k) for k, (f, c) in sets.items() if f == s and w <= c)[1] for i, (s, w) in sets.items() if i % 20 == 0}
    got = {r["frag_id"]: r["cont_id"] for r in texts.literal_superset_match(spark, documents(spark, tmp_path, rows)).collect()}
    assert got == want and got[0] == 2 and got[20] == 4 and got[60] == 60


SF = "/root/testdata/sf0.001"


def test_retry_reads_the_whole_log(spark):
    done = {}
    for r in v.attempts(spark, SF).collect():
        done[r["file_hash"]] = done.get(r["file_hash"], False) or bool(r["compiled_success"] and r["lines_deleted"] >= 200)
    want = sorted(r["file_hash"] for r in v.cases(spark, SF).collect() if done.get(r["file_hash"]) is False)
    assert sorted(r["file_hash"] for r in selection.retry_failed_semi(spark, SF).collect()) == want


def test_states_of_all_orders(spark):
    orders = spark.read.parquet(f"{SF}/orders.parquet").collect()
    worst, better, worse, good = {}, {}, {}, {}
    for after in (0, 1):
        for o in orders:
            k = o["o_orderkey"]
            success, message = o["o_orderstatus"] == "FO"[after], ("Different bytecode", "Different control flow", "Missing bytecode", "Strange")[(k + after) % 4]
            exact = message == "Different bytecode" and k % 3 != after
            state = (4, 0) if success else (3, k % 50) if exact else (2, 0) if message == "Different bytecode" else (0, 0) if message == "Missing bytecode" else (1, 0)
            name = ("new" if after else "old") if o["o_orderpriority"] == ("5-LOW", "1-URGENT")[after] else "f"
            at = worst.setdefault((o["o_custkey"], f"{name}{k % 7}"), [None, None, False])
            at[after] = state if at[after] is None else min(at[after], state)
            at[2] = at[2] or (success and not after)
            good.setdefault(o["o_custkey"], [0, 0])[after] += success
    for (file, name), (old, new, _) in worst.items():
        better.setdefault(file, []).extend([name] * (new == (4, 0) if old is None else new is not None and new > old))
        worse.setdefault(file, []).extend([name] * (old == (4, 0) if new is None else old is not None and new < old))
    got = {(r["file"], r["names"]): [(r["worst_rank"], r["worst_offset"]), r["any_success"]] for r in selection.state_worst(spark, SF).collect()}
    assert got == {k: [old, any_success] for k, (old, _, any_success) in worst.items() if old}
    compared = {r["file"]: (r["improved"], r["regressed"], [r["successes_before"], r["successes_after"]]) for r in selection.state_compare(spark, SF).collect()}
    assert compared == {f: (",".join(sorted(better[f])), ",".join(sorted(worse[f])), good[f]) for f in good}
    for r in selection.accept_gate(spark, SF).collect():
        f = r["file"]
        assert r["by_oracle"] == (False if worse[f] else True if better[f] else f * 7 % 50 < f * 11 % 50)


def test_deltas_of_whole_texts(spark, tmp_path):
    rows = [(1, "a", f"{FILLER} Old both"), (2, "a", f"new {FILLER}  both"), (3, "a", "both"), (5, "a", "x"), (6, "a", None)]
    d = documents(spark, tmp_path, rows)
    text = {i: t for i, _, t in rows}
    pairs = [(i, text[i], text[i + 1]) for i in text if text.get(i + 1) is not None]
    got = {r["doc_id"]: tuple(r)[1:] for r in texts.set_delta_counts(spark, d).collect()}
    for i, a, b in pairs:
        a, b = ({w for w in t.lower().split(" ") if w} for t in (a, b))
        assert got[i] == (len(a - b), len(b - a), len(a & b), min(3, len(a & b)))
    added = {r["doc_id"]: (r["added"], r["removed"], r["n_differing"]) for r in texts.symdiff_sets(spark, d).collect()}
    for i, a, b in pairs:
        a, b = (set(t.split(" ")) for t in (a, b))
        assert added[i] == (sorted(b - a), sorted(a - b), len(a ^ b))
    assert got[1] == (1, 1, 71, 3) and added[1][0] == ["", "new"]


def test_rank_of_every_case(spark):
    big = 10**9
    rows = v.preflights(spark, SF).collect()
    key = lambda r: (int(bool(r["missing"] or r["extra"])), r["targets"], r["distance"], r["parents"]) if r["present"] else (1, 10**6, big, 10**6)
    want = [r["file_hash"] for r in sorted(rows, key=lambda r: (*key(r), r["file_hash"]))]
    got = sorted(selection.easy_first_order(spark, SF).collect(), key=lambda r: r["n"])
    assert [r["n"] for r in got] == list(range(1, len(rows) + 1)) and [r["file_hash"] for r in got] == want
