"""Encoding and decoding through distinct words, against the tokenizers library itself."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest

from roadpulse.llm import word_table
from roadpulse.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
TEXTS = [
    None, "", " ", "  two  spaces ", "a<|endoftext|>b  <|endoftext|>\n", "it's we'll I'D don't", "日本語 テスト　全角", "हिन्दी १२ ।",
    "tab\tnew\n\nline \r\n", "²³ ½x _a_ __", "😀 smile😀", "ctrl\x1c\x1d x", "word " * 3000 + "end", "x" * 50_000, "word end", "word end",
    "ǅ ՠ ֐ ߊ", "a b", "Ａ１", "mixed  \n  ends  ",
]


def frame(spark, texts):
    return spark.createDataFrame([(None if i == 7 else i // 2 * 2, t, "k", "c", 1) for i, t in enumerate(texts)],
                                 "doc_id bigint, text string, key string, chunk string, part int")


def expected(texts):
    bpe, rows = word_table.tokenizer(), []
    for i, text in enumerate(texts):
        ids = bpe.encode(text or "", add_special_tokens=False).ids
        back = bpe.decode(ids, skip_special_tokens=False)
        rows.append((None if i == 7 else i // 2 * 2, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                     hashlib.sha256(back.encode()).hexdigest()))
    return sorted(rows, key=str)


@pytest.mark.parametrize("chunk_bytes", [1, 200, word_table.CHUNK_BYTES])
def test_digests_equal_the_tokenizer(spark, chunk_bytes):
    found = word_table.digests(frame(spark, TEXTS).repartition(3), chunk_bytes=chunk_bytes).collect()
    assert sorted(map(tuple, found), key=str) == expected(TEXTS)


def test_encoded_documents_and_join_decoding(spark):
    encoded = word_table.encode_documents(frame(spark, TEXTS))
    rows = encoded.collect()
    bpe = word_table.tokenizer()
    assert sorted((str(r.doc_id), r.ids) for r in rows) == sorted(
        (str(None if i == 7 else i // 2 * 2), bpe.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(TEXTS))
    joined = word_table.decode_ids(encoded).collect()
    assert sorted((str(r.doc_id), r.decoded) for r in joined) == sorted((str(r.doc_id), r.decoded) for r in rows)
    assert sorted(r.decoded for r in rows) == sorted(t or "" for t in TEXTS)


def test_splitter_agrees_with_the_tokenizer_on_the_checked_range():
    bpe = word_table.tokenizer()
    split = word_table.Splitter(bpe, special=False)
    for code in range(ord(word_table.CHECKED_TO) + 1):
        c = chr(code)
        for text in (f"a{c}1", f"!{c}!", f" {c}{c}a", f"{c}'s {c}", f"{c}  {c}"):
            whole = [text[a:b] for _, (a, b) in bpe.pre_tokenizer.pre_tokenize_str(text)]
            slots = word_table.Slots(split)
            numbers = slots.of(text).tolist()
            assert split(text) == whole and [list(slots)[i] for i in numbers] == whole, text
    assert "".join(split("ab <|endoftext|>c")) == "ab <|endoftext|>c" and len(split("<|endoftext|>")) > 1


def test_empty_table(spark):
    assert word_table.digests(frame(spark, []), chunk_bytes=10).count() == 0


def test_query_on_the_small_table(spark):
    found = {r.doc_id: r for r in QUERIES["op12_word_table_bpe"](spark, SF).collect()}
    texts = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    bpe = word_table.tokenizer()
    assert len(found) == len(texts)
    for row, code in zip(texts, bpe.encode_batch([r.text or "" for r in texts], add_special_tokens=False)):
        got = found[row.doc_id]
        assert got.ids_sha256 == hashlib.sha256(np.array(code.ids, "<u4").tobytes()).hexdigest() and got.n_tokens == len(code.ids)
        assert got.decoded_sha256 == hashlib.sha256((row.text or "").encode()).hexdigest()
