"""The same results by plain single-threaded Python loops over rows, timed: what bench.py is to be compared with.

    python baseline.py [TABLES]
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
import time
from collections import Counter, defaultdict

import pyarrow.parquet as pq


def rows(folder: str, name: str, *columns: str) -> list[dict]:
    return pq.read_table(f"{folder}/{name}.parquet", columns=list(columns) or None).to_pylist()


def outcome_rollup(d: str) -> dict:
    latest: dict = {}
    for e in rows(d, "events", "user_id", "ts", "event_id", "event_type", "value"):
        if e["user_id"] not in latest or (e["ts"], e["event_id"]) > (latest[e["user_id"]]["ts"], latest[e["user_id"]]["event_id"]):
            latest[e["user_id"]] = e
    out: Counter = Counter()
    for e in latest.values():
        kind, deleted = e["event_type"], int(e["value"] // 1)
        out["out_of_scope" if kind == "view" else "failed" if kind == "error" else ("heavy_deletion" if deleted > 50 else "light_deletion" if deleted > 0 else "genuine") if kind == "click" else "neutralised_compile" if kind == "signup" else "genuine"] += 1
    return out


def retry_failed_semi(d: str) -> list:
    done: dict = defaultdict(bool)
    for e in rows(d, "events", "user_id", "event_type", "value"):
        done[e["user_id"]] |= e["event_type"] not in ("view", "error") and e["value"] >= 200
    return [r["doc_id"] for r in rows(d, "documents", "doc_id") if done.get(r["doc_id"]) is False]


def candidate_rank(d: str) -> dict:
    best: dict = {}
    for r in rows(d, "lineitem", "l_orderkey", "l_partkey", "l_linenumber", "l_returnflag", "l_quantity", "l_suppkey"):
        key = (r["l_returnflag"] != "A", int(r["l_quantity"]), -(r["l_suppkey"] % 5), r["l_partkey"] * 10 + r["l_linenumber"])
        if r["l_orderkey"] not in best or key < best[r["l_orderkey"]]:
            best[r["l_orderkey"]] = key
    return best


def file_rollup(d: str) -> dict:
    out: dict = defaultdict(lambda: [0, 0, 0.0])
    for r in rows(d, "lineitem", "l_orderkey", "l_returnflag", "l_quantity", "l_suppkey", "l_partkey"):
        s, c = int(r["l_quantity"]), r["l_suppkey"] % 4
        extra = {"A": 0, "R": 4}.get(r["l_returnflag"], 2)
        both = min(s, c, 3) if s and c else 0
        one = out[r["l_orderkey"]]
        one[0] += 1
        one[1] += s + 3 * c + both + extra
        one[2] += s / (s + 5) + 3 * c / (1 + r["l_partkey"] % 3) + both / max(min(s + 5, 1 + r["l_partkey"] % 3), 1) + extra / (s + 6 + r["l_partkey"] % 3)
    return {k: (n, total, round(x / n, 6)) for k, (n, total, x) in out.items()}


def cfg_heuristic(d: str) -> dict:
    steps: dict = defaultdict(list)
    for e in rows(d, "events", "user_id", "ts", "event_id", "event_type", "value"):
        steps[e["user_id"]].append((e["ts"], e["event_id"], e["event_type"], e["value"]))
    graphs = {}
    for user, seen in steps.items():
        seen.sort()
        place, edges = {}, {}
        for _, _, kind, _ in seen:
            place.setdefault(kind, len(place))
        for (_, _, a, x), (_, _, b, _) in zip(seen, seen[1:]):
            edges[a, b] = min(edges.get((a, b), "~"), "jump" if x >= 50 else "fall")
        after: dict = defaultdict(set)
        for a, b in edges:
            after[place[a]].add(place[b])
        graphs[user] = (len(place), len(edges), sum(len(v) > 1 for v in after.values()), Counter(edges.values()), after)
    out = {}
    for user, a in graphs.items():
        if (b := graphs.get(user + 1)) is not None:
            paired = min(a[0], b[0])
            out[user] = sum(abs(a[i] - b[i]) for i in range(3)) + sum(abs(a[3][k] - b[3][k]) for k in {*a[3], *b[3]}) + sum(len({s for s in a[4][k] if s < paired} ^ b[4][k]) for k in range(paired))
    return out


def line_multiset_delta(d: str) -> dict:
    texts = {r["doc_id"]: r["text"] for r in rows(d, "documents", "doc_id", "text")}
    lines = lambda t: Counter(s for s in map(str.strip, re.split(r"\r\n|\n|\r", t or "")) if s)
    return {i: sum((lines(t) - lines(texts[i + 1])).values()) for i, t in texts.items() if i + 1 in texts}


def text_hashes(d: str) -> dict:
    return {r["doc_id"]: hashlib.sha256("\n".join(s.rstrip() for s in (r["text"] or "").strip().split("\n")).encode()).hexdigest() for r in rows(d, "documents", "doc_id", "text")}


def op7_exact_dedup(d: str) -> dict:
    best: dict = {}
    blank = {ord(c): None for c in " \t\n\x0b\x0c\r"}
    for r in rows(d, "documents", "doc_id", "text"):
        text = r["text"] or ""
        digest = hashlib.sha256(text.translate(blank).encode()).hexdigest()
        best[digest] = min(best.get(digest, (1, 0)), (-len(text), r["doc_id"]))
    return best


if __name__ == "__main__":
    folder, seconds = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1", {}
    for run in (outcome_rollup, retry_failed_semi, candidate_rank, file_rollup, cfg_heuristic, line_multiset_delta, text_hashes, op7_exact_dedup):
        began = time.perf_counter()
        run(folder)
        seconds[run.__name__] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "seconds of plain Python loops, one thread", "queries": seconds}))
