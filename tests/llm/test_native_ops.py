"""Exact dedup, sharding, mixing and chat formatting on small and awkward tables."""

import hashlib
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from remedia.llm import chat_format, exact_dedup, mixing, sharding

DOCS = "doc_id long, text string, lang string, source string, n_chars long, digest string, uid int, kept string"


def docs(spark, rows):
    """Rows of (doc_id, text, source), with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, None, s, None, "x", 1, "no") for i, t, s in rows], DOCS)


AWKWARD = [
    (1, "a b", "s"), (2, "ab", "s"), (3, None, None), (4, "", "s"), (5, " \t\n", "t"), (None, "a b", "s"), (6, "a  b", "s"), (6, "a  b", "s"), (7, "z" * 200_000, "t"),
    (8, "ab ", "s"), (None, None, None), (9, "a\x0bb ", "s"),
]


def brute_dedup(rows):
    groups = defaultdict(list)
    for k, (i, t, _) in enumerate(rows):
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i is None, i or 0, k))
    return {text: (rows[min(g)[3]][0], len(g)) for text, g in groups.items()}


def test_exact_dedup_awkward(spark):
    got = exact_dedup.decide(docs(spark, AWKWARD)).collect()
    want = brute_dedup(AWKWARD)
    by_digest = {hashlib.sha256(t.encode()).digest(): v for t, v in want.items()}
    assert len(got) == len(AWKWARD)
    for r in got:
        assert (r["keep_id"], r["group_size"]) == by_digest[bytes(r["digest"])]
    assert Counter(bytes(r["digest"]) for r in got if r["kept"]) == Counter(by_digest.keys())
    kept = exact_dedup.deduplicate(docs(spark, AWKWARD))
    assert kept.columns == DOCS.replace(" long", "").replace(" string", "").replace(" int", "").split(", ")
    assert sorted((str(r["doc_id"]), r["text"] or "") for r in kept.collect()) == sorted((str(rows[0]), rows[1] or "") for rows in _kept(AWKWARD))


def _kept(rows):
    groups = defaultdict(list)
    for k, (i, t, _) in enumerate(rows):
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i is None, i or 0, k))
    return [rows[min(g)[3]] for g in groups.values()]


def test_exact_dedup_heavy_groups(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(i, "hot  " if i % 3 else rng.choice("abcdefgh") * (i % 50), "s") for i in range(900)]
    got = exact_dedup.decide(docs(spark, rows)).collect()
    want = brute_dedup(rows)
    assert exact_dedup.heavy_winners(exact_dedup.digest_table(docs(spark, rows))).count() > 0
    for r in got:
        assert (r["keep_id"], r["group_size"]) == next(v for t, v in want.items() if hashlib.sha256(t.encode()).digest() == bytes(r["digest"]))
    assert sum(r["kept"] for r in got) == len(want)


def test_empty_tables(spark):
    none = docs(spark, [])
    assert exact_dedup.decide(none).count() == 0 and exact_dedup.deduplicate(none).count() == 0
    assert sharding.assign(none).count() == 0
    assert mixing.mix(none).count() == 0 and mixing.mixture(none).count() == 0
    assert chat_format.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


@pytest.mark.parametrize("hot", [False, True])
def test_shards(spark, hot):
    rng = random.Random(7)
    rows = [(i, ("hot" if hot and i % 3 == 0 else "".join(rng.choices("abc ", k=rng.randint(0, 300)))), "s") for i in range(3000)] + [(None, None, None), (5, "x" * 2000, None), (5, "x" * 2000, None)]
    got = sharding.assign(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    size, slots = Counter(), defaultdict(list)
    for r in got:
        size[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert sum(size.values()) == sum(len((t or "").encode()) + 1 for _, t, _ in rows)
    mean = sum(size.values()) / 8
    assert len(size) == 8 and max(size.values()) - min(size.values()) < 0.04 * mean
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shards_of_equal_texts(spark):
    got = sharding.assign(docs(spark, [(i, f"text {i % 500} " * 8, "s") for i in range(4000)])).collect()
    where = defaultdict(set)
    for r in got:
        where[r["text_crc32"]].add(r["shard"])
    assert all(len(s) == 1 for s in where.values())


def slow_assign(rows, splitters, shards):
    """Shards and slots by plain loops over all rows, from the same boundaries."""
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    keyed = []
    for i, text, *_ in rows:
        data = (text or "").encode()
        keyed.append([i, len(data) + 1, signed(xxhash.xxh64_intdigest(data, 42))])
    n_bytes, n_rows = sum(k[1] for k in keyed), len(keyed)
    ranges = max(sharding.MIN_RANGES, min(sharding.MAX_RANGES, -(-n_bytes // sharding.RANGE_BYTES)))
    most_bytes, most_rows = sharding.OVERFULL * n_bytes / ranges, sharding.OVERFULL * n_rows / ranges
    unit_of = {h: sum(s < h for s in splitters) for _, _, h in keyed}
    totals, groups = defaultdict(lambda: [0, 0]), defaultdict(lambda: [0, 0])
    for _, size, h in keyed:
        for t in (totals[unit_of[h]], groups[h]):
            t[0] += size
            t[1] += 1
    too_big = lambda t: t[0] > most_bytes or t[1] > most_rows
    heavy = sorted(h for h in groups if too_big(groups[h]) and too_big(totals[unit_of[h]]))
    base, pieces, piece_of = len(splitters) + 1, defaultdict(lambda: defaultdict(int)), {}
    for h in heavy:
        parts = max(1, round(max(groups[h][0] / most_bytes, groups[h][1] / most_rows)) * sharding.OVERFULL)
        for n, (i, size, own) in enumerate(keyed):
            if own == h:
                seed = 42 if i is None else xxhash.xxh64_intdigest(struct.pack("<q", i), 42)
                unit = base + signed(xxhash.xxh64_intdigest(struct.pack("<i", 29), seed)) % parts
                piece_of[n] = unit
                pieces[h][unit] += size
        base += parts
    room, shard_of_unit = [n_bytes / shards] * shards, {}
    for h in sorted(heavy, key=lambda h: (-groups[h][0], h)):
        best = max(range(shards), key=lambda s: room[s])
        whole = groups[h][0] <= room[best] + sharding.SLACK * n_bytes / shards
        for unit, size in sorted(pieces[h].items(), key=lambda p: (-p[1], p[0])):
            to = best if whole else max(range(shards), key=lambda s: room[s])
            shard_of_unit[unit] = to
            room[to] -= size
    room = [max(0.0, x) for x in room]
    light = sum(t[0] for t in totals.values()) - sum(groups[h][0] for h in heavy)
    bounds, upto = [], 0
    for x in room[:-1]:
        upto += x
        bounds.append(upto * light / (sum(room) or 1))
    out, at = [], 0
    by_key = defaultdict(list)
    for n, (i, size, h) in enumerate(keyed):
        if n not in piece_of:
            by_key[unit_of[h], h].append(n)
    start_of = {}
    for u in sorted(totals):
        start_of[u] = at
        at += totals[u][0] - sum(groups[h][0] for h in heavy if unit_of[h] == u)
    where = {}
    for u in sorted(totals):
        begin, end = start_of[u], start_of[u] + sum(keyed[n][1] for (v, _), ns in by_key.items() if v == u for n in ns)
        inside = [b for b in bounds if begin < b < end]
        upto = begin
        for (v, h), ns in sorted(by_key.items()):
            if v == u:
                upto += sum(keyed[n][1] for n in ns)  # equal keys are one step of the running sum
                for n in ns:
                    where[n] = sum(b < upto for b in bounds) if inside else sum(b <= begin for b in bounds)
    where |= {n: shard_of_unit[u] for n, u in piece_of.items()}
    order = sorted(range(n_rows), key=lambda n: (where[n], piece_of.get(n, unit_of[keyed[n][2]]), keyed[n][2], keyed[n][0] is not None, keyed[n][0] or 0, keyed[n][1]))
    slots, seen = {}, Counter()
    for n in order:
        slots[n] = seen[where[n]]
        seen[where[n]] += 1
    for n, (i, size, _) in enumerate(keyed):
        out.append((i, size, zlib.crc32((rows[n][1] or "").encode()), where[n], slots[n]))
    return Counter(out)


@pytest.mark.parametrize("hot", [0, 600, 1500])
def test_shards_against_loops(spark, monkeypatch, hot):
    rng = random.Random(hot)
    rows = [(i, "hot text " * 9 if i < hot else "".join(rng.choices("abc ", k=rng.randint(0, 300))), "s") for i in range(3000)] + [(None, "hot text " * 9, None), (None, None, None), (7, "x" * 9000, None)]
    splitters = sorted(rng.getrandbits(64) - 2**63 for _ in range(300))
    monkeypatch.setattr(sharding, "_splitters", lambda *_: splitters)
    got = sharding.assign(docs(spark, rows)).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["slot"]) for r in got) == slow_assign(rows, splitters, 8)


def test_groups_at_the_slack():
    from collections import namedtuple

    group, piece = namedtuple("G", "h bytes"), namedtuple("P", "unit bytes")
    slack = sharding.SLACK * 100
    for extra, shards in ((0, 1), (slack, 1), (slack + 1, 2)):
        size = 100 + extra
        at = sharding._place([group(5, size)], {5: [piece(0, size / 2), piece(1, size / 2)]}, [100.0] * 4)
        assert len(set(at.values())) == shards


def test_mixture(spark):
    rows = [(i, f"t{i}", "big" if i < 800 else f"s{i % 7}") for i in range(1200)] + [(None, "n", None), (3, "t3", "big")]
    got = mixing.mix(docs(spark, rows), max_share=0.25).collect()
    assert len(got) == len(rows)
    kept = Counter(r["source"] for r in got if r["selected"])
    assert all(kept[s] == n for s, n in Counter(s for _, _, s in rows).items() if s != "big")
    assert kept["big"] == max(int(0.25 * (401 / 0.75)), 401) and kept["big"] < 801
    places = [r["position"] for r in got if r["selected"]]
    assert len(set(places)) == len(places) and all(r["position"] is None for r in got if not r["selected"])
    for r in got:
        if r["selected"]:
            assert r["release"] <= r["slot"] < r["deadline"]
    ordered = mixing.mixture(docs(spark, rows), max_share=0.25)
    assert ordered.columns == [c.split()[0] for c in DOCS.split(", ")] and ordered.count() == len(places)


def test_mixture_takes_as_many_repeats_as_selected(spark):
    rows = [(1, "same", "a")] * 40 + [(i, f"t{i}", "b") for i in range(10)]
    for weights, want in (({"a": 0.5, "b": 0.5}, {"a": 10, "b": 10}), ({"a": 4, "b": 1}, {"a": 40, "b": 10}), ({"a": 1.0}, {"a": 40}), ({}, {}), ({"a": 0.0}, {}), (None, {"a": 40, "b": 10})):
        assert Counter(r["source"] for r in mixing.mixture(docs(spark, rows), weights).collect()) == want


def test_blocks_grow_beyond_the_most_turns(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MAX_TURNS", 20)
    rows = [(i, f"t{i}", f"s{i % 3}") for i in range(900)]
    got = mixing.mix(docs(spark, rows)).collect()
    assert mixing.block_rows(900) == 45 and max(r["slot"] for r in got) == 20 and len({r["position"] for r in got}) == 900


def test_mixture_keeps_every_row(spark):
    from remedia.llm import queries

    for sizes in ([1000], [700, 300], [600, 300, 100]):
        assert mixing.capped_quotas(sizes, sum(sizes)) == sizes
    folder = "/root/testdata/sf0.001"
    assert all(r["selected"] for r in queries.op4_mixing(spark, folder).collect())
    import duckdb

    from remedia.llm import oracles

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    out = con.execute(oracles.oracle_sql()["op4_mixing"])
    names = [c[0] for c in out.description]
    assert Counter(out.fetchall()) == Counter(tuple(r[n] for n in names) for r in queries.op4_mixing(spark, folder).collect())
    rows = [(i, f"t{i}", "big" if i < 900 else f"s{i % 3}") for i in range(1000)]
    assert corpus_pipeline.source_mixing(spark, docs(spark, rows), folder).count() == 1000


def test_schedule_follows_exact_shares(spark):
    rng = random.Random(4)
    blocks = [rng.randint(1, 60) for _ in range(200)] + [0, 3000]
    total, done = sum(blocks), Counter()
    for slot, s, nth, release, deadline in mixing.turns(blocks):
        assert release <= slot < deadline and nth == done[s]
        done[s] += 1
        assert all(abs(done[k] * total - b * (slot + 1)) < total for k, b in enumerate(blocks)) or slot % 97
    assert [done[s] for s in range(len(blocks))] == blocks
    rows = [(i, f"t{i}", f"s{i}") for i in range(1200)] + [(2000 + i, "x", "big") for i in range(3200)]
    got = mixing.mix(docs(spark, rows), max_share=None).collect()
    assert len({r["stream"] for r in got}) == 1201 and all(r["release"] <= r["slot"] < r["deadline"] for r in got)
    assert sorted(r["slot"] for r in got if r["rank"] % 16 == 0) == list(range(1400))


def test_mixture_with_weights(spark):
    rows = [(i, f"t{i}", "ab"[i % 2]) for i in range(1000)]
    got = Counter(r["source"] for r in mixing.mix(docs(spark, rows), {"a": 0.8, "b": 0.2}).collect() if r["selected"])
    assert got == {"a": 500, "b": 125}
    assert not any(r["selected"] for r in mixing.mix(docs(spark, rows), {"a": 0.5, "zzz": 0.5}).collect())


CHAT = "conv_id long, turn long, role string, text string, turns int, blocks string"


@pytest.mark.parametrize("roles", [["user", "assistant"], ["assistant"]])
def test_long_conversations(spark, roles):
    """Time grows with a conversation's turns, not with their square or cube; spans are right on both sides of each step."""
    import time

    turns = spark.range(10_000).selectExpr("1L AS conv_id", "id AS turn", f"element_at(array({', '.join(map(repr, roles))}), cast(id % {len(roles)} AS int) + 1) AS role", "concat('turn <|', id, repeat(' é', id % 9)) AS text")
    turns = turns.unionByName(turns.filter(f"turn < {chat_format.STEP * 2 + 1}").withColumn("conv_id", F.lit(2).cast("long")))
    began = time.perf_counter()
    out = chat_format.format_conversations(turns)
    out = out.select("conv_id", chat_format.read_back(F.col("formatted")).alias("back"), chat_format.learned_texts(F.col("formatted"), F.col("loss_spans")).alias("learned")).collect()
    assert time.perf_counter() - began < 30
    for r in out:
        want = [(roles[i % len(roles)], f"turn <|{i}" + " é" * (i % 9)) for i in range(10_000 if r["conv_id"] == 1 else chat_format.STEP * 2 + 1)]
        assert [tuple(t) for t in r["back"]] == want and r["learned"] == [t for role, t in want if role == "assistant"]


def test_chat_round_trip(spark):
    rng = random.Random(9)
    bits = ["<|im_end|>", "<|im_start|>", "<|im_sep|>", "\\", "<\\|", "<", "|", "\n", "é", "x", "<|"]
    rows = [(c, t, rng.choice(["user", "assistant", "system", "we\nird<|role"]), "".join(rng.choices(bits, k=rng.randint(0, 12))), 1, "b") for c in range(60) for t in range(rng.randint(1, 9))]
    rows += [(None, None, None, None, 1, "b"), (70, 1, "assistant", None, 1, "b"), (70, 1, "assistant", "same", 1, "b"), (70, 1, "assistant", "same", 1, "b"), (71, 0, "user", "l" * 100_000, 1, "b")]
    out = chat_format.format_conversations(spark.createDataFrame(rows, CHAT))
    out = out.select("conv_id", "n_rows", "formatted", chat_format.read_back(F.col("formatted")).alias("back"), chat_format.learned_texts(F.col("formatted"), F.col("loss_spans")).alias("learned"))
    got = {r["conv_id"]: r for r in out.collect()}
    want = defaultdict(list)
    for c, t, role, text, *_ in rows:
        want[c].append((t if t is not None else -1, role or "", text or ""))
    assert set(got) == set(want)
    for c, turns in want.items():
        turns = [x[1:] for x in sorted(turns)]
        assert [(x["role"], x["text"]) for x in got[c]["back"]] == turns
        assert got[c]["learned"] == [t for r, t in turns if r == "assistant"]
        blocks = 1 + sum(a[0] != b[0] for a, b in zip(turns, turns[1:]))
        assert got[c]["formatted"].count("<|im_start|>") == blocks == got[c]["formatted"].count("<|im_end|>")
