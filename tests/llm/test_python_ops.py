"""SimHash, quality bands, BPE, token counts, language ID and toxicity against brute force and held-out labels."""

import base64
import random
import re
import zlib
from collections import Counter

import public_tokenizers
import pytest
import xxhash
import zstandard
from pyspark.sql import functions as F

import remedia.llm.simhash as simhash
from remedia.llm import byte_bpe, components, langid, quality_bands, token_counts, toxicity
from remedia.llm.queries import COUNT_RANKS, PATTERN, PIECES, RANKS

DOCS = "doc_id long, text string, fp string, lang string, score int, component_id string"
SF = "/root/testdata/sf0.01"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "f", None, 1, "c") for i, t in rows], DOCS)


AWKWARD = [(1, None), (2, ""), (3, "one"), (4, "one two"), (None, "A B c d"), (5, "a b C D"), (5, "a b C D"), (6, "ä " * 9000), (7, " x y z w")]


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def slow_fingerprint(text):
    words = words_of("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(values):
    parent = list(range(len(values)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(values):
        for j in range(i):
            if (a ^ values[j]).bit_count() <= 3:
                parent[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(values))]


def test_fingerprints():
    for _, text in AWKWARD:
        assert simhash.fingerprint((text or "").encode()) == slow_fingerprint(text)


@pytest.mark.parametrize("step", [1, simhash.SECOND_STEP])
def test_covering_masks_cover(step):
    masks = [m & (2**64 - 1) for m in simhash.covering_masks(step=step)]
    rng = random.Random(1)
    assert len(masks) == 15
    for _ in range(3000):
        diff = sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3)))
        assert any(m & diff == 0 for m in masks)


@pytest.mark.parametrize("bucket", [4096, 10, 2])
def test_links(spark, bucket):
    rng = random.Random(5)
    values = set()
    for _ in range(12):
        center = rng.getrandbits(64)
        for _ in range(14):
            x = center
            for b in rng.sample(range(64), rng.randint(0, 5)):
                x ^= 1 << b
            values.add(x)
    values = sorted(values)
    table = spark.createDataFrame([(simhash._signed(v),) for v in values], "fp long")
    found = components.connected_components(simhash.links(table, bucket)).collect()
    group = {v: v for v in map(simhash._signed, values)} | {r["node"]: r["component"] for r in found}
    want = slow_components(values)
    assert Counter(Counter(group.values()).values()) == Counter(Counter(want).values())
    by = {}
    for v, w in zip(values, want):
        assert by.setdefault(w, group[simhash._signed(v)]) == group[simhash._signed(v)]


def test_simhash_rows(spark):
    got = simhash.components(docs(spark, AWKWARD)).collect()
    assert len(got) == len(AWKWARD)
    values = [slow_fingerprint(t) for _, t in AWKWARD]
    roots = slow_components(values)
    least = {r: min((i for (i, _), x in zip(AWKWARD, roots) if x == r and i is not None), default=None) for r in roots}
    want = Counter((i, v, least[r]) for (i, _), v, r in zip(AWKWARD, values, roots))
    assert Counter((r["doc_id"], r["fp"] & (2**64 - 1), r["component_id"]) for r in got) == want
    kept = simhash.deduplicate(docs(spark, AWKWARD))
    assert kept.columns == [c.split()[0] for c in DOCS.split(", ")] and kept.count() == len(set(roots))
    assert simhash.components(docs(spark, [])).count() == 0 and simhash.deduplicate(docs(spark, [])).count() == 0


def test_long_chain_of_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 100), (200, 201), (201, 200)], "a long, b long")
    got = {r["node"]: r["component"] for r in components.connected_components(edges).collect()}
    assert got == {**{i: 0 for i in range(61)}, 200: 200, 201: 200}


def slow_counts(text):
    text = text or ""
    words = words_of(text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if words_of(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def slow_verdict(text):
    """Whole and chunk ratios against the bands, spelled out."""
    data, packer = (text or "").encode(), zstandard.ZstdCompressor(level=quality_bands.LEVEL)
    if len(words_of(text)) < 10 or 100 * slow_counts(text)[4] > 20 * len(words_of(text)):
        return False
    limits = lambda n: [b for b in quality_bands.BANDS if b[0] <= n][-1][1:]
    ratio = lambda d: len(packer.compress(d)) / len(d)
    bad = total = 0
    if len(data) > quality_bands.CHUNK + quality_bands.CHUNK_LEAST:
        at = 0
        while at < len(data):
            end = at + quality_bands.CHUNK
            if len(data) - end < quality_bands.CHUNK_LEAST:
                end = len(data)
            r = ratio(data[at:end])
            total, bad, at = total + 1, bad + (not quality_bands.CHUNK_LOW <= r <= limits(len(data[at:end]))[1]), end
    low, high = limits(len(data))
    return low <= ratio(data) <= high and bad <= quality_bands.MAX_BAD_CHUNKS * total


def test_quality_verdict_of_whole_texts(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rng = random.Random(9)
    prose = max((r["text"] or "" for r in table.collect()), key=len)
    junk = lambda n: " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=8)) for _ in range(n))
    odd = [(9_000_000 + i, t) for i, t in enumerate([prose + junk(k) + prose for k in (100, 600, 3000)] + [prose + "the same words again and on " * k for k in (5, 300, 3000)] + [junk(k) for k in (12, 60, 900)])]
    rows = table.unionByName(spark.createDataFrame(odd, "doc_id long, text string"))
    text = {r["doc_id"]: r["text"] for r in rows.collect()}
    got = {r["doc_id"]: r["kept"] for r in quality_bands.judge(rows).collect()}
    assert got == {i: slow_verdict(t) for i, t in text.items()} and 0 < sum(not got[i] for i, _ in odd) < len(odd)


def test_quality_counts(spark, monkeypatch):
    rng = random.Random(6)
    texts = [t for _, t in AWKWARD] + ["".join(rng.choice(["a ", "b ", "c\n", "# ", "é\t", "\n"]) for _ in range(rng.randint(0, 80))) for _ in range(60)]
    got = {r["doc_id"]: r for r in quality_bands.judge(docs(spark, list(enumerate(texts)))).collect()}
    for i, text in enumerate(texts):
        r, want = got[i], slow_counts(text)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 10 or 100 * want[4] > 20 * want[0]) and (not r["kept"] or not r["base_failed"])
    monkeypatch.setattr(quality_bands, "_MANY_WORDS", 3)
    for text in texts:
        assert quality_bands.base_counts((text or "").encode())[4] == slow_counts(text)[4]
    assert quality_bands.judge(docs(spark, [])).count() == 0


def test_compression_bands():
    rng = random.Random(8)
    prose = " ".join("".join(rng.choices("etaoinshrdlu", k=rng.randint(2, 9))) for _ in range(900)).encode()
    packer = zstandard.ZstdCompressor(level=3)
    judge = lambda b: quality_bands.compression(b, packer)[-1]
    assert judge(prose) and judge(prose[:300])
    assert not judge(b"buy now " * 800) and not judge(base64.b64encode(rng.randbytes(6000)))
    assert not judge(prose[:4096] + b"spam " * 4000)
    for n in (0, 1, 4095, 4096, 5119, 5120, 9000):
        assert b"".join(quality_bands.chunks(b"x" * n)) == b"x" * n


def test_random_text_is_outside_every_band():
    rng = random.Random(9)
    packer = zstandard.ZstdCompressor(level=3)
    judge = lambda b: quality_bands.compression(b, packer)[-1]
    words = lambda letters, n: " ".join("".join(rng.choices(letters, k=rng.randint(2, 9))) for _ in range(n)).encode()[:n]
    lower = "abcdefghijklmnopqrstuvwxyz"
    for n in (128, 176, 192, 208, 224, 256, 383, 384, 511, 512, 1000, 1023, 1024, 1535, 1536, 2000, 2048, 4000, 4095, 4096, 5119, 5120, 16384, 65536):
        assert not judge(words(lower + lower.upper() + "0123456789", n)), n
        assert n < 1536 or not judge(words(lower, n)), n
        assert judge(words("etaoinshrdlu", n)) or n > 16000, n
    assert not judge(words("etaoinshrdlu", 4096) + words(lower + "0123456789", 4096))


TRICKY = ["", " ", "  a", "a  b", "x\n y", "don't  stop\t\n", "…语言🙂🙂", "a" * 5000, " " * 300, "=" * 99, "ere" * 7, " x  y", "<|endoftext|>", "é \x1c z", "1234 567"]


def exact(path):
    return byte_bpe.codec(path, PATTERN).exact


def test_bpe_equals_tiktoken():
    own = byte_bpe.codec(RANKS, PATTERN)
    rng = random.Random(2)
    bits = ["a", "b", " ", "  ", "\n", "ere", "…", "é", "語", "🙂", "'s", "12", "...", "--", "The ", "\t"]
    texts = TRICKY + ["".join(rng.choices(bits, k=rng.randint(0, 50))) for _ in range(2000)]
    for text, ids in zip(texts, own.encode(texts)):
        assert ids == own.exact.encode_ordinary(text)
        assert own.decode_bytes(ids).decode() == text and "".join(own.decode_pieces(ids)) == text
        spans = own.offsets(ids)
        assert all(0 <= s < e <= len(text) for s, e in spans) and (not text or spans[-1][1] == len(text))


def test_bpe_table(spark):
    table = docs(spark, [*AWKWARD, *((10 + i, t) for i, t in enumerate(TRICKY))])
    got = {r["doc_id"]: r for r in byte_bpe.round_trip(table, RANKS, PATTERN).collect() if r["doc_id"]}
    import hashlib

    for i, t in enumerate(TRICKY):
        ids = exact(RANKS).encode_ordinary(t)
        assert got[10 + i]["n_tokens"] == len(ids) and got[10 + i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[10 + i]["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest()
    tokens = byte_bpe.encode(table, RANKS, PATTERN, with_offsets=True)
    assert all(len(r["ids"]) == len(r["starts"]) == len(r["ends"]) for r in tokens.collect())
    back = {r["doc_id"]: bytes(r["decoded"]).decode() for r in byte_bpe.decode(tokens, RANKS, PATTERN).collect()}
    assert all(back[10 + i] == t for i, t in enumerate(TRICKY)) and back[1] == ""
    assert byte_bpe.round_trip(docs(spark, []), RANKS, PATTERN).count() == 0
    own = byte_bpe.codec(RANKS, PATTERN)
    odd = spark.createDataFrame([(1, None), (2, []), (3, [None, 65, None])], "doc_id long, ids array<int>")
    assert [bytes(r["decoded"]) for r in byte_bpe.decode(odd, RANKS, PATTERN).orderBy("doc_id").collect()] == [b"", b"", own.decode_bytes([65])]
    for bad in (-1, len(own.bytes_of)):
        with pytest.raises(ValueError):
            own.decode_bytes([65, bad])


def test_edits(spark):
    own = token_counts.measure(COUNT_RANKS, PATTERN)
    rng = random.Random(5)
    bits = ["the ", "and ", "  ", "\n", "a", "é", "語", " ", "x y", "12", "'s", "...", "\t", "longwordhere "]
    for _ in range(60):
        text = "".join(rng.choices(bits, k=rng.randint(0, 1500)))
        tree = token_counts.build(own, [text])[0]
        for _ in range(5):
            start, gone, new = rng.randint(0, len(text) + 3), rng.choice([0, 1, 40, 900]), "".join(rng.choices(bits, k=rng.choice([0, 1, 5, 300])))
            tree.edit(own, start, gone, new)
            at = min(start, len(text))
            text = text[:at] + new + text[at + gone :]
            assert "".join(tree.parts) == text and (tree.length, tree.total) == (len(text), len(own.exact.encode_ordinary(text)))
    long = token_counts.build(own, ["some words here " * 5000])[0]
    long.edit(own, 40_000, 5, "x")
    assert long.encoded < 3000


@pytest.mark.parametrize("path", [COUNT_RANKS, RANKS])
def test_edits_of_text_without_spaces(path):
    own = token_counts.measure(path, PATTERN)
    rng = random.Random(6)
    for letters in ("語言文字日本国中人大小上下の", "абвгдежзиклмнопрст", "ทดสอบภาษาไทย", "ab1cd2", "éè語x7"):
        text = "".join(rng.choices(letters, k=20_000))
        tree = token_counts.build(own, [text])[0]
        for step in range(12):
            start, gone, new = rng.randrange(len(text)), rng.choice([0, 1, 30]), "".join(rng.choices(letters + " '", k=rng.choice([1, 2, 700])))
            before = tree.encoded
            tree.edit(own, start, gone, new)
            text = text[:start] + new + text[start + gone :]
            if letters[0] in "語éa":
                assert tree.encoded - before < 3000
            if step % 4 == 3:
                assert "".join(tree.parts) == text and tree.total == len(own.exact.encode_ordinary(text))


def test_tree_stays_low():
    """Thousands of edits at one place and all over: sums hold, nodes stay narrow, depth stays logarithmic."""
    own = token_counts.measure(COUNT_RANKS, PATTERN)
    rng = random.Random(8)
    tree = token_counts.build(own, ["word " * 4000])[0]
    for k in range(1500):
        tree.edit(own, 777 if k % 2 else rng.randrange(tree.length), 0, " some more words and numbers 12345" * 4)

    def depth(node):
        if node.text is not None:
            return 0
        assert len(node.kids) <= 2 * token_counts.WIDTH and (node.chars, node.tokens, node.leaves) == tuple(sum(getattr(k, n) for k in node.kids) for n in ("chars", "tokens", "leaves"))
        return 1 + max(map(depth, node.kids))

    text = "".join(tree.parts)
    assert depth(tree.root) <= 5 and tree.total == len(own.exact.encode_ordinary(text)) and tree.encoded < 1500 * 1200
    tree.edit(own, 0, len(text), "")
    assert (tree.length, tree.total, tree.parts) == (0, 0, [""])


def test_edit_table(spark):
    table = docs(spark, AWKWARD)
    edits = spark.createDataFrame([(3, 0, 1, 1, "zz"), (3, 1, None, None, None), (6, 0, 4, 100, " new "), (99, 0, 0, 0, "q"), (None, 0, 0, 0, "q")], "doc_id long, seq int, start int, deleted int, inserted string")
    got = {r["doc_id"]: r for r in token_counts.count_with_edits(table, edits, COUNT_RANKS, PATTERN).collect()}
    long = "ä " * 9000
    size = lambda t: len(exact(COUNT_RANKS).encode_ordinary(t))
    assert (got[3]["n_tokens"], got[3]["n_tokens_after"], got[3]["n_edits"]) == (size("one"), size("ozze"), 2)
    assert got[6]["n_tokens_after"] == size(long[:4] + " new " + long[104:]) and got[1]["n_tokens"] == 0
    assert token_counts.count_with_edits(docs(spark, []), edits, COUNT_RANKS, PATTERN).count() == 0


LATTICE_PIECES = ["▁a", "ab", "a", "b", "▁", "▁ab", "abababababab"]


def segmentations(word, pieces, probs):
    """(probability, pieces) of every segmentation; an unknown character is a piece of its own."""
    if not word:
        yield 1.0, []
    for k in range(1, len(word) + 1):
        known = word[:k] in pieces
        if known or k == 1:
            own = probs[pieces.index(word[:k])] if known else langid.UNKNOWN
            for p, rest in segmentations(word[k:], pieces, probs):
                yield own * p, [word[:k], *rest]


def lattice_model():
    import numpy as np

    probs = np.append(np.linspace(0.05, 0.2, len(LATTICE_PIECES)), langid.UNKNOWN)
    return langid.Model(["x"], langid.Lattice(LATTICE_PIECES), probs[:, None]), probs


def test_forward_sums_all_segmentations(monkeypatch):
    import numpy as np

    model, probs = lattice_model()
    words = ["ab", "b", "aba", "zab", "abab", "", "abababababab", "zzabz"]
    want = [np.log(sum(p for p, _ in segmentations("▁" + w, LATTICE_PIECES, probs))) if w else 0 for w in words]
    for longest in (langid.LONGEST, 4):
        monkeypatch.setattr(langid, "LONGEST", longest)
        assert np.allclose(model.score_words(words)[:, 0], want)
    monkeypatch.undo()
    # A long word is scored whole: as by a plain recursion over its ends.
    long = "▁" + "ab" * 500 + "z"
    alpha = [0.0]
    for e in range(1, len(long) + 1):
        terms = [alpha[s] + np.log(probs[LATTICE_PIECES.index(long[s:e])] if long[s:e] in LATTICE_PIECES else langid.UNKNOWN) for s in range(max(0, e - 12), e) if long[s:e] in LATTICE_PIECES or e - s == 1]
        alpha.append(np.logaddexp.reduce(terms))
    assert np.isclose(model.score_words([long[1:]])[0, 0], alpha[-1])


def test_expected_counts_of_all_segmentations(monkeypatch):
    import numpy as np

    model, probs = lattice_model()
    words, weights = ["ab", "aba", "zab", "ababab"], np.array([2.0, 1.0, 3.0, 0.5])
    want = np.zeros(len(LATTICE_PIECES) + 1)
    for word, weight in zip(words, weights):
        found = list(segmentations("▁" + word, LATTICE_PIECES, probs))
        total = sum(p for p, _ in found)
        for p, cut in found:
            for piece in cut:
                if piece in LATTICE_PIECES:
                    want[LATTICE_PIECES.index(piece)] += weight * p / total
    for longest in (langid.LONGEST, 4):
        monkeypatch.setattr(langid, "LONGEST", longest)
        assert np.allclose(langid.expected(model.lattice, words, weights, model.probs), want)


def test_posterior_of_whole_texts():
    import numpy as np
    import pyarrow as pa

    one, probs = lattice_model()
    model = langid.Model(["x", "y"], one.lattice, np.column_stack([probs, np.append(probs[-2::-1], langid.UNKNOWN)]))
    text = "Ab, aba! zab " * 3
    logs = [3 * sum(np.log(sum(p for p, _ in segmentations("▁" + w, LATTICE_PIECES, model.probs[:, k]))) for w in ("ab", "aba", "zab")) for k in (0, 1)]
    names, scores = langid.score_texts(model, pa.array([text, None, "12"]))
    assert names == ["xy"[int(np.argmax(logs))], "und", "und"] and np.isclose(scores[0], 1 / (1 + np.exp(min(logs) - max(logs)))) and scores[1] == scores[2] == 0


def test_vocabulary_and_sample(spark, monkeypatch):
    pieces = langid.vocabulary(PIECES)
    assert max(map(len, pieces)) > 10 and all(p == p.lower() for p in pieces)
    rows = [(i, f"word{i}", "f", "ab"[i % 3 == 0], 1, "c") for i in range(4000)]
    table = spark.createDataFrame(rows, DOCS)
    usable = table.select("doc_id", "lang", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 62)).alias("h"))
    by: dict = {}
    for r in usable.collect():
        by.setdefault(r["lang"], []).append((r["h"], r["doc_id"]))
    for most in (1, 7, 300, 1500, 9000):
        got = {(r["lang"], r["doc_id"]) for r in langid._lowest(usable, most).collect()}
        assert got == {(lang, i) for lang, found in by.items() for _, i in sorted(found)[:most]}
    monkeypatch.setattr(langid, "MAX_LANGUAGES", 1)
    with pytest.raises(ValueError):
        langid.training_words(table)


def test_language_accuracy(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(table, PIECES)
    rows = langid.identify(table, model).join(table.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.97 * len(held)
    odd = langid.identify(docs(spark, [(1, None), (2, ""), (3, "123 ###"), (4, "語" * 50_000), (None, "the of and")]), model).collect()
    assert [r["lang_pred"] for r in odd if r["doc_id"] in (1, 2, 3)] == ["und"] * 3 and all(0 <= r["score"] <= 1 for r in odd)
    kept = langid.keep_identified(docs(spark, [(1, None), (2, "12"), (3, "the of and that")]), model)
    assert [r["doc_id"] for r in kept.collect()] == [3] and kept.columns[2] == "fp"
    nothing = langid.fit(table.limit(0), PIECES)
    assert [r["lang_pred"] for r in langid.identify(docs(spark, [(1, "abc")]), nothing).collect()] == ["und"]


def slow_triples(string):
    """Weights of the triples that start in the first WIDTH places, by the definition."""
    out = Counter()
    marks = toxicity.symbols(string[: toxicity._STRING]).tolist()
    for i in range(min(toxicity.WIDTH, len(marks))):
        for j in range(i + 1, len(marks)):
            for k in range(j + 1, min(len(marks), i + toxicity.SPAN)):
                out[marks[i], marks[j], marks[k]] += toxicity.DECAY ** (k - i + 1)
    return out


def slow_kernel(a, b):
    a, b = slow_triples(a), slow_triples(b)
    return sum(w * b[t] for t, w in a.items())


def test_string_kernel():
    import numpy as np

    strings = [" you moron ", " you mo1ron", " m o r o n ", " of a table", "ä", "", " the the the the the the"]
    marks = [strings[0], strings[3], strings[6]]
    near, used, basis = toxicity.kernel(strings, marks)
    assert np.allclose(near, [[slow_kernel(a, b) for b in marks] for a in strings], rtol=1e-4)
    assert near[1, 0] > 1.5 * near[3, 0] and used.size == len(basis)


def test_margins_are_the_machine_on_every_string(monkeypatch):
    """A text's sliding sums equal the machine's decision on each of its strings, taken by itself, over segment ends too."""
    import numpy as np
    import pyarrow as pa

    positive, negative = [" you idiot here", " what an idiot ", " the idiot did it"], [" you are here and", " what an answer is", " the table did it", " of an"]
    table, bias = toxicity.machine(positive, negative)
    assert all(s > 0 for s in toxicity.kernel(positive, positive)[0].diagonal())
    text = toxicity.sentences(pa.array(["You IDIOT! What, an answer.\nOf i.d.i.o.t and m o r o n ofer, ü no"]))[0]
    assert "you idiot" in text and " idiot and moron ofer " in text.replace("\n", " ")
    want = []
    for p in range(len(text)):
        string = text[p : p + toxicity._STRING].split("\n", 1)[0]
        folded = sum(w * table[(a << 12) + (b << 6) + c] for (a, b, c), w in slow_triples(string).items())
        want.append(folded + bias)
    for segment in (1 << 20, 7):
        monkeypatch.setattr(toxicity, "SEGMENT", segment)
        got = np.concatenate([m for _, m in toxicity.margins(toxicity.symbols(text), table, bias)])
        assert np.allclose(got, want, atol=1e-4)
        one, two, none = toxicity.measure(table, bias, pa.array(["You IDIOT! What, an answer.\nOf i.d.i.o.t and m o r o n ofer, ü no", "fine", None]))
        assert np.isclose(one[0], np.clip(max(want), -3, 2), atol=1e-4) and one[1] >= np.log(3) - 1e-9 and tuple(none) == toxicity._EMPTY and two[0] < 0


def test_machine_minimises_its_loss():
    """The Nyström machine against plain gradient descent on the same landmarks' kernel rows."""
    import numpy as np

    positive, negative = [f" {w} idiot {w}" for w in ("an", "of", "to", "or")], [f" {w} table {w}" for w in ("an", "of", "to", "or", "in")]
    table, bias = toxicity.machine(positive, negative)
    value = lambda s: sum(w * table[(a << 12) + (b << 6) + c] for (a, b, c), w in slow_triples(s).items()) + bias
    assert np.all([value(s) > 0.9 for s in positive]) and np.all([value(s) < -0.9 for s in negative])
    assert value(" by idiot by") > 0.5 > -0.5 > value(" by table by")


def test_toxicity_accuracy(spark):
    table, labels = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "labels"))
    model = toxicity.fit(table, labels)
    rows = toxicity.score(table, model).join(labels, "doc_id").collect()
    held = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    assert sum(r["predicted"] == r["toxic"] for r in held) >= 0.9 * len(held)
    assert sum(r["predicted"] and not r["toxic"] for r in held) <= 0.03 * len(held)
    odd = toxicity.score(docs(spark, [(1, None), (2, ""), (None, "x"), (3, "a" * 300_000), (4, "fine " * 50)]), model).collect()
    assert len(odd) == 5 and all(0 <= r["score"] < 0.7 for r in odd)
    assert toxicity.score(docs(spark, []), model).count() == 0
    blank = toxicity.fit(table, labels.limit(0))
    assert all(not r["predicted"] for r in toxicity.score(docs(spark, [(1, "idiot")]), blank).collect())
    only = toxicity.fit(table, labels.filter("toxic = 1").withColumn("text", F.lit("clash")))
    assert [r["score"] for r in toxicity.score(docs(spark, [(1, "idiot"), (2, None)]), only).collect()] == [1.0, 1.0]


def test_toxicity_catches_disguises(spark):
    """Learned from plain insults in labelled sentences: gapped, spaced, split and inserted-character ones count, near words don't."""
    draw = random.Random(3)
    plain = ["the", "onea", "thing", "ration", "and", "ofer", "stand", "reer", "haing", "tion", "ided", "mornon", "table"]
    sentence = lambda bad: " ".join([*draw.choices(plain, k=draw.randrange(3, 12)), *([bad] if bad else []), *draw.choices(plain, k=draw.randrange(2, 9))])
    rows = [(i, ". ".join(sentence(draw.choice(["idiot", "moron", "worthless"]) if i % 4 == 0 and k == 1 else "") for k in range(4))) for i in range(900)]
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i, _ in rows], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs(spark, rows), labels)
    bad = ["idiot", "i d i o t", "id1iot", "i.d.i.o.t", "mor0on", "worth less", "worthlesss"]
    odd = [(i, f"the thing and {w} of onea stand. table and reer") for i, w in enumerate(bad)] + [(100 + i, ". ".join(sentence("") for _ in range(4))) for i in range(50)]
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score(docs(spark, odd), model).collect()}
    assert all(got[i] for i in range(len(bad))) and sum(got[100 + i] for i in range(50)) == 0


def test_pipeline(spark):
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    table = spark.read.parquet(f"{d}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    now = table
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, now, d)
        assert after.columns == table.columns
        rows = after.collect()
        assert len({r["doc_id"] for r in rows}) == len(rows) and {r["doc_id"] for r in rows} <= {r["doc_id"] for r in now.select("doc_id").collect()}
        now = spark.createDataFrame(rows, table.schema)
    texts = {r["doc_id"]: r["text"] for r in now.collect()}
    assert len({re.sub(r"[\x20\x09-\x0D]", "", t) for t in texts.values()}) == len(texts)
    final = {r["doc_id"]: r["n_tokens"] for r in corpus_pipeline.STAGES[-1][1](spark, now, d).collect()}
    assert final == {i: len(exact(RANKS).encode_ordinary(t)) for i, t in texts.items()}
    assert corpus_pipeline.run(spark, d).count() == len(final)


def test_pipeline_of_awkward_tables(spark, tmp_path):
    """No rows, null texts, sources and ids, repeated rows, very long and letterless texts: stages keep what their rules say."""
    import corpus_pipeline

    kind = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").schema
    prose = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter("lang = 'en' AND n_chars > 300").limit(4).collect()]
    learn = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    rows = [(100_001, prose[0], None, None, 1), (100_001, prose[0], None, None, 1), (None, prose[1] + " more", None, "s", None), (None, None, None, None, None), (100_003, "", "en", "s", 0), (100_004, "123 456 !", "en", "s", 9), (100_005, (prose[2] + "\n") * 300, "en", "s", 9)]
    spark.createDataFrame([], kind).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
    spark.createDataFrame([*learn, *rows], kind).write.parquet(f"{tmp_path}/odd/documents.parquet")
    got = Counter(r["doc_id"] for r in corpus_pipeline.run(spark, f"{tmp_path}/odd").collect())
    assert max(got.values()) == 1 and got[None] == 1 and got[100_005] == 1
    assert not {100_003, 100_004} & set(got)
    whole = {r[0] for r in learn if r[1] == prose[0]}
    assert got[100_001] + sum(got[i] for i in whole) == 1


def test_vocabularies_are_parameters():
    assert RANKS == public_tokenizers.path("byte_bpe_multi_50k.tiktoken") and F is not None
