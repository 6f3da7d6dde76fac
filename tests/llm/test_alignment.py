"""Alignment of two tokenizers against a plain merge of their token ends."""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from roadpulse.llm import alignment
from roadpulse.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
TEXTS = [
    None, "", " ", "plain words here", "plain words here", "<|endoftext|> <s> </s>", "日本語 テスト", "हिन्दी", "😀 emoji 😀😀", "under▁score",
    "tab\tline\n\n  spaces", "nul\x00byte", "=" * 3000, "word salad " * 2000, "ünïcödé straße", "x", "don't we'll", "\x1c\x1d", "１２３ ½",
]


def frame(spark, texts):
    return spark.createDataFrame([(None if i == 7 else i // 2 * 2, t, 1, "p", 2) for i, t in enumerate(texts)],
                                 "doc_id bigint, text string, chunk int, pair string, slot int")


def plain_alignment(texts):
    """Groups of every text by walking both lists of ends; then counts over all texts."""
    tokens, rows, held = alignment.Pair(), [], Counter()
    for text in texts:
        a = tokens.a.encode(" " + (text or ""), add_special_tokens=False).ids if text else []
        b = tokens.b.encode(text) if text else []
        want = b" " + (text or "").encode()
        if b"".join(tokens.a_bytes[i] for i in a) != want or b"".join(tokens.b_bytes[i] for i in b) != want:
            a, b = [], []
        ends = [np.cumsum([len(table[i]) for i in ids]).tolist() for ids, table in ((a, tokens.a_bytes), (b, tokens.b_bytes))]
        common, groups = set(ends[0]) & set(ends[1]), []
        for side, ids in enumerate((a, b)):
            k, cut = 0, [[]]
            for token, end in zip(ids, ends[side]):
                cut[-1].append(token)
                if end in common:
                    cut.append([])
            groups.append(cut[:-1])
        groups = list(zip(*groups))
        links = Counter((x, y) for g in groups for x in g[0] for y in g[1])
        held.update(links.keys())
        rows.append((len(a), len(b), groups, links))
    most = defaultdict(int)
    for (x, _), n in held.items():
        most[x] = max(most[x], n)
    for n_a, n_b, groups, links in rows:
        spelled = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        yield (n_a, n_b, len(groups), sum(links.values()), sum(n for p, n in links.items() if held[p] == most[p[0]]),
               sum(n * held[p] for p, n in links.items()), hashlib.sha256(spelled.encode()).hexdigest() if n_a else "")


@pytest.mark.parametrize("chunk_bytes, lane", [(1, 1), (5000, 7), (alignment.CHUNK_BYTES, alignment.LANE)])
def test_digests_equal_a_plain_merge(spark, chunk_bytes, lane):
    found = alignment.digests(frame(spark, TEXTS).repartition(2), chunk_bytes=chunk_bytes, lane=lane).collect()
    want = [(None if i == 7 else i // 2 * 2, *r) for i, r in enumerate(plain_alignment(TEXTS))]
    assert sorted(map(tuple, found), key=str) == sorted(want, key=str)


def test_a_group_of_many_tokens_keeps_all_its_links(monkeypatch):
    """Sides that meet only at the end: one group of all tokens, with and without the short form."""
    rng = np.random.default_rng(1)
    a_size, b_size = np.array([2, 4, 6]), np.array([3, 5, 9])
    a = rng.integers(0, 3, 60)
    b = np.array([0] * 3)
    want = int(a_size[a].sum()) - int(b_size[b].sum())
    b = np.concatenate([b, np.zeros(want // 3, np.int64)]) if want % 3 == 0 else np.concatenate([b, np.full(want % 3 and 1, 1), np.zeros((want - 5) // 3, np.int64)]) if (want - 5) % 3 == 0 else np.concatenate([b, [1, 1], np.zeros((want - 10) // 3, np.int64)])
    assert a_size[a].sum() == b_size[b].sum()
    for limit in (0, 1 << 14):
        monkeypatch.setattr(alignment, "BIG_GROUP", limit)
        merged = alignment.Merged([a], [b], a_size, b_size, 5)
        doc, pair, many = merged.document_pairs()
        links = Counter()
        for a0, a1, b0, b1 in merged.cuts.T.tolist():
            links.update((x * 3 + y) for x in a[a0:a1].tolist() for y in b[b0:b1].tolist())
        assert dict(zip(pair.tolist(), many.tolist())) == dict(links) and many.sum() == merged.groups()[1].sum()


def test_aligned_documents_and_empty_table(spark):
    rows = alignment.aligned_documents(frame(spark, TEXTS)).collect()
    assert len(rows) == len(TEXTS)
    tokens = alignment.Pair()
    for r in rows:
        at_a = [sum(tokens.a_size[r.a_ids[:i]]) for i in r.a_stops]
        assert at_a == [sum(tokens.b_size[r.b_ids[:i]]) for i in r.b_stops]
        assert not r.a_ids or (r.a_stops[-1] == len(r.a_ids) and r.b_stops[-1] == len(r.b_ids))
    assert alignment.digests(frame(spark, [])).count() == 0


def test_query_on_the_small_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = sorted((r.doc_id, *w) for r, w in zip(docs, plain_alignment([r.text for r in docs])))
    assert sorted(map(tuple, QUERIES["op11_lockstep_alignment"](spark, SF).collect())) == want
