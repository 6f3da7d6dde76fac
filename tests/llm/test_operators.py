"""Brute-force comparisons on small tables with nulls, empties, ties, repeats and clashing columns."""

from __future__ import annotations

import collections
import hashlib
import math
import pickle
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from roadpulse.llm import common, mixing, neighbours, packing, quality_rules, recompression, secret_scan, simhash, suffix_dedup, suffix_tree_lm, toxicity

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, th int, lo string, key string, words string, n string, fp string"


def _texts():
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(60)]
    passage = " ".join(rng.choice(vocab) for _ in range(45))
    out = []
    for i in range(30):
        body = [rng.choice(vocab) for _ in range(rng.randint(1, 90))]
        if i % 3 == 0:
            body.insert(rng.randint(0, len(body)), passage)
        out.append((i, " ".join(body) + "."))
    out += [(40, out[3][1]), (41, out[3][1] + " tail"), (42, None), (43, ""), (44, " \t\n\x0b "), (45, "one two"), (46, "go " * 70),
            (47, "Größe été " * 30), (48, " ".join(rng.choice(vocab) for _ in range(4000))), (None, out[6][1]), (None, None), (7, out[7][1])]
    return out


@pytest.fixture(scope="module")
def texts():
    return _texts()


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 3}" if i != 5 else None, len(t or ""), 1, "x", None, "y", "z", None) for i, t in texts], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def _repeats(texts, width, units):
    """Removed-unit masks by the definition; equal places under one id are not earlier."""
    first = {}
    key = lambda i: -1 if i is None else i
    for i, t in texts:
        u = units(t or "")
        for s in range(len(u) - width + 1):
            w = tuple(u[s:s + width])
            first[w] = min(first.get(w, (1 << 60, 0)), (key(i), s))
    out = []
    for i, t in texts:
        u = units(t or "")
        gone = [False] * len(u)
        for s in range(len(u) - width + 1):
            if first[tuple(u[s:s + width])] < (key(i), s):
                gone[s:s + width] = [True] * width
        out.append((i, u, gone))
    return out


def test_recompression(docs, texts, empty):
    got = recompression.remove_repeats(docs).select("doc_id", "n_words", "n_removed", "kept").collect()
    want = [(i, len(u), sum(g), b" ".join(w for w, x in zip(u, g) if not x).decode()) for i, u, g in _repeats(texts, 20, lambda t: t.encode().split())]
    assert collections.Counter(map(tuple, got)) == collections.Counter(want)
    assert sum(w[2] for w in want) > 300
    assert recompression.remove_repeats(empty).collect() == []


@pytest.mark.parametrize("width", [100, 10])
def test_suffix_dedup(docs, texts, empty, width):
    got = suffix_dedup.remove_repeats(docs, width).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept").collect()
    want = []
    for i, u, g in _repeats(texts, width, lambda t: t.encode()):
        spans = sum(x and (k == 0 or not g[k - 1]) for k, x in enumerate(g))
        want.append((i, len(u), sum(g), spans, hashlib.sha256(bytes(b for b, x in zip(u, g) if not x)).hexdigest()))
    assert collections.Counter((*r[:4], hashlib.sha256(r[4]).hexdigest()) for r in got) == collections.Counter(want)
    assert suffix_dedup.remove_repeats(empty, width).collect() == []


def _fingerprint(text):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[i:i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [b" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _linked(fps):
    group = list(range(len(fps)))

    def root(x):
        while group[x] != x:
            x = group[x]
        return x
    for a in range(len(fps)):
        for b in range(a):
            if bin(fps[a] ^ fps[b]).count("1") <= 2:
                group[max(root(a), root(b))] = min(root(a), root(b))
    return [root(i) for i in range(len(fps))]


def test_simhash(docs, texts, empty):
    fps = [_fingerprint(t) for _, t in texts]
    roots = _linked(fps)
    least = {}
    for (i, _), r in zip(texts, roots):
        if i is not None:
            least[r] = min(i, least.get(r, i))
    got = simhash.near_duplicates(docs).select("doc_id", "fingerprint", "component_id").collect()
    assert collections.Counter(map(tuple, got)) == collections.Counter(
        (i, f"{f:016x}", least.get(r)) for (i, _), f, r in zip(texts, fps, roots))
    assert simhash.near_duplicates(empty).collect() == []
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(set(least.values()))


def test_keep_one_with_null_and_repeated_ids(spark):
    rng = random.Random(12)
    words = lambda: [rng.choice("abcdefghij") + str(rng.randint(0, 99)) for _ in range(300)]
    named, other, clean, alone = words(), words(), words(), words()
    near = next(t for t in (alone[:i] + ["changed"] + alone[i + 1:] for i in range(300))
                if 0 < bin(_fingerprint(" ".join(t)) ^ _fingerprint(" ".join(alone))).count("1") <= 2)
    rows = [(i, " ".join(t), s) for i, t, s in [
        (5, named, "a"), (None, named, "a"), (9, named, "b"), (8, other, "a"), (9, other, "a"), (9, clean, "a"),
        (None, alone, "a"), (None, near, "b"), (None, near, "c"), (20, words(), "q"), (20, words(), "p")]]
    rows += [(20, rows[-1][1], "p"), (20, rows[-1][1], "o")]
    for n in (1, 7):
        kept = [tuple(r) for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(n)).collect()]
        nameless = [r for r in kept if r[0] is None]
        assert len(nameless) == 1 and nameless[0] in rows[6:9]
        assert sorted(r for r in kept if r[0] is not None) == sorted([rows[0], rows[3], rows[5], rows[9], rows[-1]])


@pytest.mark.parametrize("crowd", [64, 3])
def test_links_with_crowds(spark, monkeypatch, crowd):
    monkeypatch.setattr(simhash, "CROWD", crowd)
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2 ** 63, 12, dtype=np.int64)
    out = [base]
    for _ in range(10):
        x = out[-1].copy() if rng.random() < 0.7 else base.copy()
        for _ in range(int(rng.integers(1, 4))):
            x ^= np.int64(1) << rng.integers(0, 63, len(x))
        out.append(x)
    fps = np.unique(np.concatenate(out)).tolist()
    found = [(r["a"], r["b"]) for r in simhash.links(spark.createDataFrame([(f,) for f in fps], "fp bigint")).collect()]
    assert all(bin((a ^ b) & (2 ** 64 - 1)).count("1") <= 2 for a, b in found)
    group = {f: f for f in fps}

    def root(x):
        while group[x] != x:
            x = group[x]
        return x
    for a, b in found:
        group[max(root(a), root(b))] = min(root(a), root(b))
    assert [root(f) for f in fps] == [fps[r] for r in _linked(fps)]


def test_packing(docs, texts, empty):
    import public_tokenizers
    from tokenizers import Tokenizer
    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = packing.pack(docs, 64).collect()
    want = collections.Counter()
    for i, t in texts:
        ids = exact.encode(t or "", add_special_tokens=False).ids + [2]
        size, at, piece = len(ids) % 64 or 64, 0, 0
        while at < len(ids):
            want[(i, piece, at, size, zlib.crc32(np.array(ids[at:at + size], "<u4").tobytes()))] += 1
            at, piece, size = at + size, piece + 1, 64
    assert collections.Counter(tuple(r[:5]) for r in rows) == want
    sequences = collections.defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.pack(empty, 64).collect() == []


@pytest.mark.parametrize("text", ["a  b", "x \n y", "one<|endoftext|>two", "tab\there  ", "Ünïcode ßtraße 東京 ok", "don't   stop", "\n\n a"])
def test_tokens_equal_the_tokenizer(text):
    tokens = packing.Tokens()
    assert np.frombuffer(tokens(text), "<u4").tolist() == tokens.exact.encode(text, add_special_tokens=False).ids


def test_plan_uses_every_piece_and_is_tight():
    rng = random.Random(5)
    histogram = collections.Counter(rng.choice([rng.randint(1, 100), rng.randint(300, 700), 1024]) for _ in range(20_000))
    plan = packing.plan(dict(histogram))
    used = collections.Counter()
    for config, many in plan:
        assert sum(l * k for l, k in config.items()) <= 1024
        for l, k in config.items():
            used[l] += k * many
    assert used == histogram
    least = max(-(-sum(l * n for l, n in histogram.items()) // 1024), sum(n for l, n in histogram.items() if l > 512))
    assert sum(many for _, many in plan) <= 1.02 * least


def test_mixing(docs, texts, empty):
    rows = mixing.mix(docs, repetition_limit=1.5).select("doc_id", "source", "n_tokens", "epoch", "text").collect()
    tokens = collections.Counter()
    whole = collections.Counter()
    for i, t in texts:
        tokens[f"s{(i or 0) % 3}" if i != 5 else None] += len((t or "").encode().split())
        whole[(i, t)] += 1
    assert collections.Counter((r["doc_id"], r["text"]) for r in rows if r["epoch"] == 0) == whole
    read = collections.Counter()
    for r in rows:
        read[r["source"]] += r["n_tokens"]
    rates = {s: read[s] / n for s, n in tokens.items()}
    assert all(1 <= rate <= 1.5 for rate in rates.values()) and max(rates.values()) > 1.1
    assert mixing.mix(empty, repetition_limit=1.5).collect() == []


def test_exponent_meets_an_entropy(spark):
    p = [0.5, 0.3, 0.15, 0.05]
    sources = spark.createDataFrame([(x,) for x in p], "p double")
    t = mixing.find_exponent(sources, 1.25, None)
    w = np.array(p) ** t / (np.array(p) ** t).sum()
    assert abs(-(w * np.log(w)).sum() - 1.25) < 1e-4


def test_neighbours(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(20, 16))
    x = centres[rng.integers(0, 20, 600)] + 0.4 * rng.normal(size=(600, 16))
    x[100:400] = x[100]  # one vector fills half the rows
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    rows += [(5000, None, 1), (5001, [], 1), (5050, [0.0] * 16, 1), (5003, [float("nan")] + [1.0] * 15, 1), (5004, [None] + [1.0] * 15, 1),
             (None, [1.0] * 16, 1), (50, rows[50][1], 1)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, node int")
    got = collections.defaultdict(list)
    for r in neighbours.nearest(table, F.col("id") % 50 == 0).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    hits = 0
    for q in range(0, 600, 50):
        s = np.round(unit @ unit[q], 9)
        s[q] = -9
        best = np.lexsort((np.arange(600), -s))[:5].tolist()
        found = sorted(got.pop(q))
        assert [r for r, _, _ in found] == [1, 2, 3, 4, 5]
        assert all(abs(score - s[v]) < 1e-6 for _, v, score in found)
        hits += len(set(best) & {v for _, v, _ in found})
    assert not got and hits >= 0.9 * 60
    assert neighbours.nearest(table.limit(0), F.col("id") % 50 == 0).collect() == []


def test_suffix_tree_scores(docs, texts, empty):
    rows = suffix_tree_lm.score_texts(docs).collect()
    tokens = {k: (t or "").encode().lower().split() + [b"\n"] for k, (_, t) in enumerate(texts)}
    held = [i is not None and zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in texts]
    c = collections.Counter(w for k, words in tokens.items() if not held[k] for w in words)
    n, v = sum(c.values()), len(c)
    want = collections.Counter((i, held[k], len(tokens[k]), sum(c[w] > 0 for w in tokens[k]), n,
                                round(math.fsum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens[k]), 6))
                               for k, (i, _) in enumerate(texts))
    assert collections.Counter((*r[:5], round(r[5], 6)) for r in rows) == want
    assert all(r["score"] <= 0 for r in rows)
    assert sum(r["score"] for r in rows) > 1.1 * sum(r["base_score"] for r in rows)
    assert suffix_tree_lm.score_texts(empty).collect() == []


def test_tree_is_a_distribution():
    rng = random.Random(1)
    words = sorted({"".join(rng.choice(["ab", "ba", "c", "dé"]) for _ in range(rng.randint(1, 4))).encode() for _ in range(400)})
    data, place = suffix_tree_lm._spelling(words)
    code, following, n = [], [], []
    for depth in range(suffix_tree_lm.DEPTH + 1):
        context = suffix_tree_lm._contexts(data, place, depth) if depth else np.zeros(len(data), np.int64)
        key, many = np.unique((context[context >= 0] << 8) | data[context >= 0], return_counts=True)
        code.append(key >> 8)
        following.append(key & 255)
        n.append(many)
    tree = suffix_tree_lm.SuffixTree(np.concatenate(code), np.concatenate(following), np.concatenate(n))
    assert len(tree.codes) > 3
    short = [b""] + [bytes([a]) for a in range(256) if a != 10]
    mass = (10 ** tree.score([w for w in short if w])).sum()
    assert 0 < mass < 1
    assert tree.score([b"ab"])[0] > tree.score([b"zq"])[0] + 1


def _token_tree(texts):
    """Tree and word numbers of the texts, every run counted one by one."""
    words = sorted({w for t in texts for w in t})
    number = {w: i for i, w in enumerate(words, suffix_tree_lm.END + 1)}
    runs = collections.Counter()
    for t in texts:
        row = [suffix_tree_lm.START, *(number[w] for w in t), suffix_tree_lm.END]
        for i in range(len(row)):
            for j in range(i + 1, min(i + suffix_tree_lm.REACH + 1, len(row)) + 1):
                code = 0
                for x in row[i:j]:
                    code = code << suffix_tree_lm.BITS | x
                runs[code] += 1
    runs = {c: n for c, n in runs.items() if n >= 2}
    p = np.ones(len(words) + suffix_tree_lm.END + 1)
    p[:suffix_tree_lm.END] = 0
    return suffix_tree_lm.TokenTree(np.array(list(runs)), np.array(list(runs.values())), p / p.sum()), number, p / p.sum()


def test_token_tree_is_a_distribution():
    rng = random.Random(5)
    texts = [[rng.choice(["a b c d", "a c", "b b d", "e"]) for _ in range(12)] for _ in range(20)]
    texts = [" ".join(t).encode().split() for t in texts]
    tree, number, root = _token_tree(texts)
    kept = np.flatnonzero(tree.rest < 1)
    depths = {sum(int(tree.codes[k]) >> (suffix_tree_lm.BITS * d) > 0 for d in range(4)) for k in kept}
    assert len(kept) > 5 and max(depths) >= 2
    for before in ([], [b"a"], [b"a", b"b"], [b"b", b"b", b"d"], [b"d", b"a", b"b", b"c"]):
        ahead = [suffix_tree_lm.START, *(number[w] for w in before)]
        total = sum(tree.predict(np.array([*ahead, x]), np.array([1.0] * len(ahead) + [root[x]]))[-1]
                    for x in range(suffix_tree_lm.END, len(root)))
        assert total == pytest.approx(1.0)
    after = np.array([suffix_tree_lm.START, number[b"a"], number[b"b"], number[b"c"]])
    assert tree.predict(after, root[after])[-1] > 3 * root[number[b"c"]]


def test_tokens_are_predicted_from_the_tokens_before(spark, monkeypatch):
    rng = random.Random(6)
    names = [f"n{i}" for i in range(12)]
    said = [" ".join(f"{n} met {n}x at noon" for n in rng.choices(names, k=6)) for _ in range(60)]
    held = [i for i in range(1000, 2000) if zlib.crc32(str(i).encode()) % 10 == 0][:2]
    turned = " ".join(reversed(said[0].split()))
    rows = [(i, t) for i, t in zip((i for i in range(1000) if zlib.crc32(str(i).encode()) % 10), said)] + [(held[0], said[0]), (held[1], turned)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in suffix_tree_lm.score_texts(docs.repartition(1)).collect()}
    assert got[held[0]]["base_score"] == pytest.approx(got[held[1]]["base_score"])
    assert got[held[0]]["score"] > got[held[1]]["score"] + 10  # same words, in the order of the training texts
    monkeypatch.setattr(suffix_tree_lm, "BLOCK", 50)
    again = {r["doc_id"]: r["score"] for r in suffix_tree_lm.score_texts(docs.repartition(5)).collect()}
    assert again == pytest.approx({k: r["score"] for k, r in got.items()})


def test_new_words_of_a_text_are_encoded_together(monkeypatch):
    tokens = packing.Tokens()
    rng = random.Random(7)
    parts = [" ", " ", "  ", "\n", " \n", "\t", "\xa0", "\x85", "a", "the", "été", "中", "<|endoftext|>", "<|", "'s", "12", ",", "日本"]
    odd = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(1000)]
    for text in odd + odd[:50]:
        assert tokens(text) == np.array(tokens.exact.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    calls, ids = [], tokens._ids
    monkeypatch.setattr(tokens, "_ids", lambda text: calls.append(text) or ids(text))
    text = " ".join(f"new{i}x" for i in range(300))
    assert tokens(text) == np.array(tokens.exact.encode(text, add_special_tokens=False).ids, "<u4").tobytes() and len(calls) == 2
    monkeypatch.setattr(packing, "CACHE_ENTRIES", 10)
    assert tokens(text + " more") == np.array(tokens.exact.encode(text + " more", add_special_tokens=False).ids, "<u4").tobytes()


def test_tasks_of_a_worker_share_a_reader(monkeypatch):
    monkeypatch.setattr(toxicity, "_KEPT", {})
    reader = toxicity.Reader({}, -9.0, {"idiot": 2.0, "r": 1.0, "^scum": 3.0, "scumbag": 1.5})
    first, second = (toxicity._kept(pickle.loads(pickle.dumps(reader))) for _ in range(2))
    assert first is second
    assert toxicity._kept(toxicity.Reader({}, -9.0, {})) is not first
    calls, squeezed = [], toxicity._squeezed
    monkeypatch.setattr(toxicity, "_squeezed", lambda *a: calls.append(a) or squeezed(*a))
    assert reader.may_hide(["id iot", "r r r or ar", "an id of", "idiot is", "s cum b ag"]) == {0, 4}
    assert len(calls) <= 6  # windows with hits, not their tokens
    assert [reader.weight(w) for w in ("idiot", "Idiot".lower() + "!", "scumbags.", "scumbo", "scums", "r,", "clean")] == [2.0, 2.0, 3.0, 3.0, 0.0, 1.0, 0.0]


def test_quality_rules(spark, docs, empty):
    import duckdb
    documents = docs.select("doc_id", "text").toPandas().astype({"doc_id": "Int64"})  # noqa: F841 - read by the query
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    con = duckdb.connect()
    con.register("documents", documents)
    want = con.execute(f"SELECT {', '.join(names)} FROM ({quality_rules.oracle()})").fetchall()
    assert collections.Counter(map(tuple, quality_rules.judge(docs).select(*names).collect())) == collections.Counter(want)
    body = " ".join(f"word{i}" for i in range(60)) + ".\n"
    cases = [(1, body), (2, body + "Home | About | News | Contact\n"), (3, "# a b c d\n" * 2 + " ".join(f"x{i}" for i in range(55)))]
    got = {r["doc_id"]: r for r in quality_rules.judge(spark.createDataFrame(cases, "doc_id bigint, text string")).collect()}
    assert got[1]["kept"] and got[2]["kept"] and "Home" not in got[2]["clean_text"] and got[3]["n_dup_lines"] == 1
    assert quality_rules.judge(empty).collect() == []


def test_many_repeated_windows(spark):
    text = " ".join(f"a{i} b{i} c{i} x{i}" for i in range(80)) + " " + " ".join(f"a{i} b{i} c{i}" for i in range(80))
    words = text.split()
    grams = collections.Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if grams[tuple(words[i:i + 3])] > 1 for k in range(3)}
    row = quality_rules.judge(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).first()
    assert row["n_repeat_words"] == len(covered) > 400


def test_toxicity(spark):
    rng = random.Random(4)
    vocab = ["house", "river", "green", "table", "window", "morning", "light", "stone", "paper", "garden", "music", "travel"]
    rows, labels = [], []
    for i in range(400):
        words = [rng.choice(vocab) for _ in range(30)]
        if i % 4 == 0:
            words.insert(rng.randint(0, 30), rng.choice(["idiot", "moron", "loser"]))
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(i % 4 == 0)))
    rows += [(1000, "the river 1d10t light"), (1001, "a green looooser table"), (1002, "you m.o.r.o.n stone"), (1003, "you i d i o t now"), (1004, None), (1005, ""),
             (None, "garden music"), (3, rows[3][1])]
    docs = spark.createDataFrame([(i, t, 0.5) for i, t in rows], "doc_id bigint, text string, score double")
    table = spark.createDataFrame(labels + [(None, 1, 1), (7, None, None)], "doc_id bigint, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.score_documents(docs, table).collect()}
    assert all(got[i]["predicted"] == int(i % 4 == 0) for i in range(400))
    assert [got[i]["predicted"] for i in (1000, 1001, 1002, 1003, 1004, 1005, None)] == [1, 1, 1, 1, 0, 0, 0]
    assert all(0 <= r["score"] <= 1 and r["held_out"] == (i is not None and zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    kept = toxicity.drop_toxic(docs, table)
    assert kept.columns == docs.columns and kept.where("doc_id = 3").count() == 2
    assert toxicity.score_documents(docs, table.limit(0)).where("predicted = 1").count() == 0
    assert toxicity.score_documents(docs.limit(0), table).collect() == []


def test_words_spelled_over_spaces(spark):
    rng = random.Random(4)
    vocab = ["what", "idea", "you", "now", "a", "it", "is", "the", "so", "am", "i", "house", "river", "green", "to", "in", "of", "table", "said", "did"]
    rows = [(i, " ".join(rng.choice(vocab) for _ in range(40)) + (" " + rng.choice(["idiot", "stupid"]) if i % 3 == 0 else "")) for i in range(300)]
    toxic = ["what a s t u p i d idea", "s t u p i d i d i o t", "s t u p i d  i d i o t", "you i d i o t.", "you id iot now", "the stup id house",
             "it is s t u p ! d", "what a 5 t u p 1 d idea", "so s.t u.p i.d", "the stupi d river", "(i d i o t) green"]
    clean = ["it is what it is so i am in it", "a i o it is so", "i d the i o t", "what is a i d in the house", "1 2 3 4 5", "did i so it to", "x y z"]
    docs = spark.createDataFrame(rows + [(1000 + i, t) for i, t in enumerate(toxic + clean)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(300)], "doc_id bigint, quality int, toxic int")
    reader, _ = toxicity.learn(docs, labels)
    assert [t for t in toxic if not reader.evidence(t)[0]] == []
    assert [t for t in clean if reader.evidence(t)[0]] == []
    assert reader.evidence("s t u p i d i d i o t")[1] == math.log1p(2)
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score_documents(docs, labels).where("doc_id >= 1000").collect()}
    assert [got[1000 + i] for i in range(len(got))] == [1] * len(toxic) + [0] * len(clean)


def test_toxic_lexicon_keeps_rare_words(spark):
    rng = random.Random(5)
    plain = [f"plain{i}" for i in range(5000)]
    rows = [(" ".join(rng.sample(plain, 1000)) + (" vermin" if i < 5 else " idiot"), 1) for i in range(600)]
    rows += [(" ".join(rng.sample(plain, 1000)), 0) for _ in range(600)]
    found = toxicity.lexicon(spark.createDataFrame(rows, "text string, toxic int"), 600, 600)
    assert {"vermin", "idiot"} <= set(found) and not any("plain" in f for f in found)


def test_trigrams_of_all_documents(spark, docs, texts):
    want = collections.Counter()
    for _, text in texts:
        for word in (text or "").lower().split():
            word = word.strip(toxicity.OUTER)
            if word and set(word) <= set("abcdefghijklmnopqrstuvwxyz"):
                want.update(("^^" + word + "$")[i:i + 3] for i in range(len(word) + 1))
    assert {r["key"]: r["n"] for r in toxicity.trigram_counts(docs).collect()} == want
    table = spark.createDataFrame([(0, 1, 1), (2, 1, 0)], "doc_id bigint, quality int, toxic int")
    reader, _ = toxicity.learn(docs.where("doc_id is not null"), table)
    assert "^^g" in reader.trigrams  # only in rows without a label


def test_secret_scan(spark):
    rng = random.Random(6)
    rows = []
    for i in range(120):
        words = [rng.choice(["alpha", "beta", "gamma", "delta."]) for _ in range(25)]
        if i % 3 == 0:
            words.insert(9, 'token = "%s"' % hashlib.sha1(str(i).encode()).hexdigest())
        if i % 5 == 0:
            words.insert(3, "AKIA" + hashlib.sha1(str(i).encode()).hexdigest().upper()[:16])
        rows.append((i, " ".join(words)))
    rows += [(500, None), (501, ""), (None, "PassWord:'abcdefghijkl' é API_key=short x=0123456789abcdef"), (502, rows[0][1])]
    docs = spark.createDataFrame([(i, t, len(t or ""), "k") for i, t in rows], "doc_id bigint, text string, n_chars bigint, base string")

    def base(text):
        assign = r"(?ai:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
        out = [(m.start(), 0, f"assign:{m.start()}:{m.end()}") for m in re.finditer(assign, text) if len(m[1]) >= 12]
        out += [(m.start(), 1, f"access:{m.start()}:{m.end()}") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
        out += [(m.start(), 2, f"hex:{m.start()}:{m.end()}") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
        return ",".join(s for _, _, s in sorted(out))
    got = secret_scan.scan(docs).collect()
    assert collections.Counter((r["doc_id"], r["base"]) for r in got) == collections.Counter((i, base(t or "")) for i, t in rows)
    assert all(set(r["base"].split(",")) <= set(r["spans"].split(",")) for r in got)
    clean = {r["doc_id"]: r for r in secret_scan.redact(docs).collect()}
    assert clean[500]["text"] is None and not re.search("[0-9a-f]{16}|AKIA", " ".join(r["text"] or "" for r in clean.values()))
    assert all(r["n_chars"] == len(r["text"]) for r in clean.values() if r["text"] is not None) and 'token = "[SECRET]"' in clean[0]["text"]
    assert secret_scan.scan(docs.limit(0)).collect() == []


def test_field_finds_secrets_of_other_shapes():
    rng = random.Random(9)
    plain = ["alpha", "beta", "gamma", "delta.", "river,", "house"]
    texts = []
    for i in range(300):
        words = [rng.choice(plain) for _ in range(40)]
        if i % 3 == 0:
            words.insert(20, 'token = "%s"' % hashlib.sha1(str(i).encode()).hexdigest())
        texts.append(" ".join(words))
    field = secret_scan.fit([w for t in texts for w in secret_scan.tagged_windows(t, True)])
    signs = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    shapes = [("ghp_", 36), ("sk_live_", 24), ("AIza", 35), ("", 40)]
    found = 0
    for i in range(80):
        head, size = shapes[i % 4]
        secret = head + "".join(rng.choice(signs) for _ in range(size))
        words = [rng.choice(plain) for _ in range(30)]
        text = " ".join(words[:12] + [secret] + words[12:])
        at = text.index(secret)
        found += (at, at + len(secret), "crf") in field.spans(text)
    assert found >= 72
    for usual in ("https://www.example.org/alpha/river-12", "jane.doe42@mail.example.org", "2024-09-10T18:30:00", "12345678901234", "alpha_river_house"):
        assert field.spans(" ".join(plain * 3 + [usual] + plain * 3)) == []


def test_viterbi_beats_every_other_path():
    rng = np.random.default_rng(3)
    windows = [(["alpha", "token", "=", "0123456789abcdef00", "beta"], [0, 0, 0, 1, 0], 0)] * 3
    field = secret_scan.fit(windows)
    for _ in range(20):
        u = rng.normal(size=(5, 3)) * 3
        paths = [(a, b, c, d, e) for a in range(3) for b in range(3) for c in range(3) for d in range(3) for e in range(3)]
        value = lambda p: sum(u[i, t] for i, t in enumerate(p)) + sum(field.pair_w[a, b] for a, b in zip(p, p[1:]))
        assert abs(value(field._viterbi(u, False, False)) - max(map(value, paths))) < 1e-9


def test_pipeline_stages_keep_columns(spark, tmp_path):
    import corpus_pipeline
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_copies", "secrets", "mixing", "packing"]
    rng = random.Random(8)
    vocab = [f"v{i}" for i in range(300)]
    rows = []
    for i in range(60):
        words = [rng.choice(vocab) for _ in range(60)]
        if i % 10 == 1:
            words[5] = "idiot"
        rows.append((i, " ".join(words), "en", f"s{i % 2}", 0))
    rows += [(70, rows[0][1], "en", "s0", 0), (71, None, None, None, None), (None, "lonely text here now", "en", "s1", 0)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 10 == 1)) for i in range(60)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == columns, name
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
    ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
    assert ids == {i for i in range(60) if i % 10 != 1} | {71, None}
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in packed} == ids


def test_internal_names_as_columns(spark):
    """Columns of documents that carry the names the operators use inside come back bit for bit."""
    names = ["epoch", "n_tokens", "block", "block_key", "Doc_Key", "k_id", "k_text", "k_rest", "_text_key", "_rest_key",
             "text_key", "rest_key", "row", "id", "tokens", "label", "fp", "k", "stop", "epochs", "rest"]
    rows = [(i, f"w{i} " * (5 + i), "ab"[i % 2], *(f"{n}{i}" for n in names)) for i in range(12)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, source string, " + ", ".join(f"`{n}` string" for n in names))
    kept = simhash.keep_one(table)
    assert kept.columns == table.columns and sorted(map(tuple, kept.collect())) == sorted(rows)
    mixed = mixing.mix(table, repetition_limit=2.0)
    assert mixed.columns[-5:] == ["n_tokens_", "epoch_", "block_", "block_key_", "doc_key_"]
    assert set(map(tuple, mixed.select(*table.columns).collect())) == set(rows)


def test_hash_samples_of_any_share(spark):
    key = F.xxhash64("id")
    rows = spark.range(4_000_000)
    count = lambda share: rows.where(common.in_share(key, share)).count()
    assert count(1.0) == 4_000_000 and count(0.0) == 0
    assert 1 <= count(2.5e-7) + count(2.5e-6) <= 40    # below a millionth, and between two
    assert abs(count(0.25) - 1_000_000) < 5000


def test_toxic_words_do_not_depend_on_partitions(spark):
    rows = spark.createDataFrame([("some nasty words",)] * 40 + [("nasty again",)], "text string")
    seen = [{r["key"]: r["n"] for r in toxicity._seen(rows.repartition(n)).collect()} for n in (1, 8)]
    assert seen[0] == seen[1] and seen[0]["nasty"] == 2 and seen[0]["words"] == 1


def test_runs_that_occur_twice_are_in_the_tree(spark):
    """Scores worked out between chunks against the tree in one place, among ten million other tokens."""
    lm = suffix_tree_lm
    rng = random.Random(8)
    words = [f"w{i}" for i in range(40)]
    phrase = "odd phrase in two texts"
    said = [" ".join(rng.choices(words, k=rng.randint(0, 60))) for _ in range(150)]
    said[3] += " " + " ".join([phrase] * 6)
    said[9] += " " + " ".join([phrase] * 6)
    texts = [t.encode().split() for t in said]
    asked = [f"w1 {phrase} w2 unseen w3".encode().split(), b"w1 two texts phrase in odd w2 unseen w3".split(), []]
    tree, number, _ = _token_tree(texts)
    many = collections.Counter(w for t in texts for w in t)
    root = {w: many[w] / 1e7 for w in many} | {b"unseen": 1e-9}
    rows = []
    for chunk in range(3):
        own = [(i, t, True) for i, t in enumerate(texts) if i % 3 == chunk] + [(1000 + i, t, False) for i, t in enumerate(asked) if i % 3 == chunk]
        known = sorted({w for _, t, _ in own for w in t}, key=lambda w: (len(w), w))
        at = {w: i for i, w in enumerate(known, 2)}
        keys = np.array([1, 2, *(zlib.crc32(w) + 3 for w in known)], np.uint64)
        n = np.array([len(texts), len(texts), *(many[w] for w in known)], np.int64)
        p = np.array([1.0, 1e-4, *(root[w] for w in known)])
        tokens = np.concatenate([[0, *(at[w] for w in t), 1] for _, t, _ in own]).astype(np.int32)
        rows.append((chunk, *(bytearray(lm._zip(x.tobytes())) for x in (lm.mix(keys), n, p)), [bytearray(lm._zip(x.tobytes())) for x in (tokens[:50], tokens[50:])],
                     [i for i, _, _ in own], [learn for _, _, learn in own], [len(t) for _, t, _ in own], [0] * len(own), [0.0] * len(own)))
    got = {r["doc_id"]: r["score"] for r in lm.predict_tokens(spark.createDataFrame(rows, lm._NUMBERED), 4).collect()}
    p = np.array([0.0, 1.0, 1e-4, *(root[w] for w in sorted(many))])
    codes = tree.codes[tree.codes >> lm.BITS == 0]
    tree = lm.TokenTree(tree.codes, _run_counts(texts, number, tree.codes), p)
    assert len(codes) == len(many) + 2 and (tree.rest < 1).sum() > 5
    for i, t in [*enumerate(texts), *enumerate(asked, 1000)]:
        token = np.array([lm.START, *(number.get(w, 0) for w in t), lm.END])
        first = np.array([1.0, *(root[w] for w in t), 1e-4])
        assert got[i] == pytest.approx(np.log10(tree.predict(token, first)).sum(), abs=1e-9)
    assert got[1000] > got[1001] + 10


def _run_counts(texts, number, codes):
    found = collections.Counter()
    for t in texts:
        row = [suffix_tree_lm.START, *(number[w] for w in t), suffix_tree_lm.END]
        for i in range(len(row)):
            code = 0
            for x in row[i:i + suffix_tree_lm.REACH + 1]:
                code = code << suffix_tree_lm.BITS | x
                found[code] += 1
    return np.array([found[int(c)] for c in codes])
