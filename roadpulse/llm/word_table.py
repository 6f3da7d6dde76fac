"""Operator 12: byte-pair encoding and decoding through a table of distinct words.

Pre-tokens ("words") never influence each other, so a word has the same ids wherever it
stands. Texts are split into words in the tasks that read them. A chunk (some megabytes of
whole documents) keeps its words once, and its documents become positions in that list. Of
each chunk the words travel to their bucket, where every distinct word is encoded once; the
ids come back to the chunk and replace the positions. Words and positions leave the first
stage in one shuffle, the ids return in a second one: no word occurrence is ever a row, and
a word that fills a third of the corpus costs a bucket one entry a chunk.

Decoding joins ids with the table of pieces (fixed by the vocabulary) and puts the pieces
of a document together in order.

Inputs: rows with doc_id and text; other columns, whatever their names, are ignored. A null
or empty text has no ids and decodes to the empty string. A null doc_id stays null. Repeated
rows, and rows that share an id, are each encoded and returned. An empty table gives no rows.
A long text is one document of one chunk, so memory follows the longest document.
"""

from __future__ import annotations

import hashlib
import math
import os
import re
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from roadpulse.llm.common import NULL_ID, id_and_text, ids_of, pieces

VOCABULARY = "byte_bpe_50k.json"
CHUNK_BYTES = 8 << 20      # text of one chunk
TASK_BYTES = 8 << 20       # input bytes for each shuffle partition
CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
CHECKED_TO = "՗"      # up to here ``re`` and the tokenizer agree on letters, digits and spaces (tested)


def tokenizer(folder: str | None = None, name: str = VOCABULARY):
    import public_tokenizers
    from tokenizers import Tokenizer
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")   # Spark deals out the cores
    found = Tokenizer.from_file(f"{folder}/{name}" if folder else public_tokenizers.path(name))
    found.no_truncation()
    found.no_padding()
    return found


class Splitter:
    """A text's words as the tokenizer's own pre-tokenizer cuts them.

    ``special``: strings of special tokens are words of their own (else ordinary text).
    Characters beyond ``CHECKED_TO`` leave the split to the tokenizer, whose tables of
    letters and digits may be of another Unicode version than Python's.
    """

    def __init__(self, bpe, special: bool):
        # Letters and digits as runs of word characters: \w is letters, digits and "_", [^\W\d_] the letters
        # with the few other numbers, which are spelled out.
        others = "".join(chr(c) for c in range(ord(CHECKED_TO) + 1) if chr(c).isnumeric() and not chr(c).isdecimal())
        letter, digit = rf"[^\W\d_{others}]", rf"[\d{others}]"
        self.words = re.compile(rf"{CONTRACTIONS}| ?{letter}+| ?{digit}+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+").findall
        self.checked = re.compile(rf"[\x00-\x1b\x20-{CHECKED_TO}]*").fullmatch  # re counts \x1c-\x1f as spaces
        self.rough = re.compile(r" \s|\s ").search
        self.pre = bpe.pre_tokenizer.pre_tokenize_str
        names = [re.escape(t.content) for t in bpe.get_added_tokens_decoder().values()] if special else []
        self.cut = re.compile(f"({'|'.join(names)})").split if names else None

    def _plain(self, text: str) -> list[str]:
        if self.checked(text):
            return self.words(text)
        return [text[a:b] for _, (a, b) in self.pre(text)]

    def cuts(self, text: str) -> list[str]:
        """The text cut before single spaces, where words never cross; whole where it has other spacing."""
        if self.rough(text) or not self.checked(text):
            return [text]
        first, *rest = text.split(" ")
        return [first, *[" " + cut for cut in rest]]

    def __call__(self, text: str) -> list[str]:
        if self.cut is None:
            return self._plain(text)
        parts = self.cut(text)
        if len(parts) == 1:
            return self._plain(text)
        return [w for i, part in enumerate(parts) for w in ((part,) if i % 2 else self._plain(part))]


class Slots(dict):
    """Numbers words in the order they are first asked for; ``cuts`` remembers the numbers of a cut's words."""

    def __init__(self, split: Splitter):
        self.split, self.cuts = split, Cuts(self)

    def __missing__(self, word: str) -> int:
        slot = self[word] = len(self)
        return slot

    def of(self, text: str) -> np.ndarray:
        found, cuts = [], self.cuts
        for cut in self.split.cuts(text):
            found += cuts[cut]
        return np.array(found, np.int64)


class Cuts(dict):
    LONGEST = 64   # longer cuts are hardly seen again

    def __init__(self, slots: Slots):
        self.slots = slots

    def __missing__(self, cut: str) -> tuple[int, ...]:
        if cut[1:].isalpha() and cut[0] == " " and self.slots.split.checked(cut):   # the usual case: one word of letters
            found = (self.slots[cut],)
        else:
            found = tuple([self.slots[w] for w in self.slots.split(cut)])
        if len(cut) <= self.LONGEST:
            self[cut] = found
        return found


def shuffle_parts(df: DataFrame, task_bytes: int = TASK_BYTES) -> int:
    """Partitions for a shuffle about as large as ``df``'s input: grows with it, never below the session's number.

    An input whose size Spark does not know (it then assumes 8 EB) gets the session's number.
    """
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return least if size >= 1 << 60 else max(least, math.ceil(size / task_bytes))


def packed(**arrays) -> bytes:
    """Arrays of one length as compressed bytes."""
    batch = pa.record_batch(list(arrays.values()), names=list(arrays))
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpacked(data: bytes) -> pa.RecordBatch:
    with pa.ipc.open_stream(data) as reader:
        return reader.read_next_batch()


def planes(numbers: np.ndarray) -> bytes:
    """Numbers below 2**32, one byte plane after the other: small ones leave planes of zeros."""
    return np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def chunk_number(index: int) -> int:
    """The same for a task that runs again."""
    return (TaskContext.get().partitionId() << 32) | index


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Indices of the runs ``starts[i] .. starts[i] + counts[i]``, one run after the other."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)


# --- first stage: split ---------------------------------------------------------------

SPLIT_SCHEMA = "key bigint, chunk bigint, part int, data binary"


def splitting(buckets: int, folder: str | None, chunk_bytes: int = CHUNK_BYTES):
    """Per chunk one row of positions (key: the chunk) and one of words a bucket (key: -1 - bucket)."""
    def rows(index, slots, ids, codes):
        chunk = chunk_number(index)
        flat = np.concatenate(codes) if codes else np.zeros(0, np.int64)
        words = list(slots)
        common = np.argsort(-np.bincount(flat, minlength=len(words)), kind="stable")  # frequent words get small numbers
        rank = np.empty(len(words), np.int64)
        rank[common] = np.arange(len(words))
        words = [words[i] for i in common.tolist()]
        bucket = np.array([zlib.crc32(w.encode()) % buckets for w in words], np.int64)
        order = np.argsort(bucket, kind="stable")
        bounds = np.searchsorted(bucket[order], np.arange(buckets + 1))
        key, part, data = [chunk], [0], [packed(
            docs=pa.array([np.array(ids, np.int64)], pa.list_(pa.int64())),
            words=pa.array([np.array([len(c) for c in codes], np.int64)], pa.list_(pa.int64())),
            codes=pa.array([planes(rank[flat])], pa.large_binary()), buckets=pa.array([planes(bucket)], pa.large_binary()))]
        for b in np.unique(bucket).tolist():
            key.append(-1 - b)
            part.append(b)
            data.append(packed(word=pa.array([words[i] for i in order[bounds[b]:bounds[b + 1]].tolist()], pa.large_string())))
        return pa.record_batch([pa.array(key, pa.int64()), pa.array([chunk] * len(key), pa.int64()), pa.array(part, pa.int32()),
                                pa.array(data, pa.binary())], names=["key", "chunk", "part", "data"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = Splitter(tokenizer(folder), special=True)
        index, size, slots, ids, codes = 0, 0, Slots(split), [], []
        for piece in pieces(batches):
            for doc, text in zip(ids_of(piece.column(0)).tolist(), piece.column(1).to_pylist()):
                ids.append(doc)
                codes.append(slots.of(text))
                size += len(text)
                if size >= chunk_bytes:
                    yield rows(index, slots, ids, codes)
                    index, size, slots, ids, codes = index + 1, 0, Slots(split), [], []
        if ids:
            yield rows(index, slots, ids, codes)
    return run


# --- second stage: every distinct word of a bucket once ---------------------------------

def encoding(folder: str | None):
    """Answers to the word rows: the ids of each word, in the row's order."""
    def run(batches):
        bpe, known = tokenizer(folder), {}
        for batch in batches:
            for key, chunk, part, data in zip(*(batch.column(i) for i in range(3)), batch.column(3)):
                if key.as_py() >= 0:
                    continue
                words = unpacked(data.as_py()).column(0).to_pylist()
                fresh = [w for w in words if w not in known]
                for word, found in zip(fresh, bpe.encode_batch_fast(fresh, add_special_tokens=False)):
                    known[word] = np.array(found.ids, "<u4")
                ids = [known[w] for w in words]
                answer = packed(count=pa.array([planes(np.array([len(i) for i in ids]))], pa.large_binary()),
                                ids=pa.array([planes(np.concatenate(ids))], pa.large_binary()))
                yield pa.record_batch([pa.array([chunk.as_py()], pa.int64()), pa.array([part.as_py()], pa.int32()), pa.array([answer], pa.binary())],
                                      names=["key", "part", "data"])
    return run


# --- third stage: back to the documents -------------------------------------------------

def chunk_documents(positions: pa.RecordBatch, answers: list[tuple[int, bytes]]) -> Iterator[tuple[int, np.ndarray]]:
    """(doc_id, ids) of a chunk's documents."""
    docs, words = (positions.column(i)[0].values.to_numpy() for i in (0, 1))
    codes, bucket = (from_planes(positions.column(i)[0].as_py()).astype(np.int64) for i in (2, 3))
    found = [unpacked(data) for _, data in sorted(answers)]
    count, ids = (np.concatenate([from_planes(f.column(i)[0].as_py()) for f in found] or [np.zeros(0, "<u4")]) for i in (0, 1))
    order = np.argsort(bucket, kind="stable")   # the answers' order
    start, many = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
    many[order] = count
    start[order] = np.cumsum(count, dtype=np.int64) - count
    at = 0
    for doc, n in zip(docs.tolist(), words.tolist()):
        own = codes[at:at + n]
        at += n
        yield doc, ids[ragged(start[own], many[own])]


def piece_table(bpe) -> list[bytes]:
    """The bytes of each id: the fixed table that decoding joins with."""
    as_byte = {}
    for b in range(256):  # the byte-level alphabet: printable bytes stand for themselves, the rest follow from 256 on
        printable = 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255
        as_byte[chr(b) if printable else chr(256 + sum(v != ord(k) for k, v in as_byte.items()))] = b
    table = [b""] * bpe.get_vocab_size(with_added_tokens=True)
    for piece, i in bpe.get_vocab(with_added_tokens=False).items():
        table[i] = bytes(as_byte[c] for c in piece)
    for i, token in bpe.get_added_tokens_decoder().items():
        table[i] = token.content.encode()
    return table


def decode(ids: np.ndarray, table: list[bytes]) -> str:
    return b"".join([table[i] for i in ids.tolist()]).decode("utf-8", "replace")


def per_document(docs: DataFrame, columns: str, work: Callable, folder: str | None = None, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Apply ``work(ids, table)``, a tuple of ``columns``, to the ids of every document."""
    source = id_and_text(docs)
    parts = shuffle_parts(source)
    split = source.mapInArrow(splitting(parts, folder, chunk_bytes), SPLIT_SCHEMA).repartition(parts, "key")
    answers = split.mapInArrow(encoding(folder), "key bigint, part int, data binary").repartition(parts, "key")
    schema = f"doc_id bigint, {columns}"
    fields = _arrow_schema(docs.sparkSession, schema)
    tables: list[list[bytes]] = []   # filled once in a task

    def finish(key, chunk: pa.Table, ids: pa.Table) -> pa.Table:
        out = []
        if key[0].as_py() >= 0:
            if not tables:
                tables.append(piece_table(tokenizer(folder)))
            table = tables[0]
            replies = list(zip(ids["part"].to_pylist(), ids["data"].to_pylist()))
            out = [(None if doc == NULL_ID else doc, *work(found, table))
                   for doc, found in chunk_documents(unpacked(chunk["data"][0].as_py()), replies)]
        return pa.table([pa.array([row[i] for row in out], kind.type) for i, kind in enumerate(fields)], schema=fields)

    return split.groupBy("key").cogroup(answers.groupBy("key")).applyInArrow(finish, schema)


def _arrow_schema(spark, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType
    return to_arrow_schema(StructType.fromDDL(ddl))


def encode_documents(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """(doc_id, ids, decoded): the ids of every document and the text that they decode to."""
    return per_document(docs, "ids array<int>, decoded string", lambda ids, table: (ids.astype(np.int32), decode(ids, table)), folder)


def digests(docs: DataFrame, folder: str | None = None, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every document."""
    def work(ids, table):
        return (len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(),
                hashlib.sha256(decode(ids, table).encode()).hexdigest())
    return per_document(docs, "n_tokens bigint, ids_sha256 string, decoded_sha256 string", work, folder, chunk_bytes)


def decode_ids(encoded: DataFrame, folder: str | None = None) -> DataFrame:
    """(doc_id, decoded) of rows (doc_id, ids array<int>): ids joined with the table of pieces, in order.

    The table has one row for each id of the vocabulary, some 50 000, so the join may broadcast it.
    """
    spark = encoded.sparkSession
    table = spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate(piece_table(tokenizer(folder)))], "id int, piece binary")
    row = encoded.select("doc_id", "ids", F.monotonically_increasing_id().alias("row"))
    tokens = row.select("doc_id", "row", F.posexplode_outer("ids").alias("at", "id"))
    return (tokens.join(F.broadcast(table), "id", "left").groupBy("row", "doc_id")
            .agg(F.array_sort(F.collect_list(F.struct("at", "piece"))).alias("found"))
            .select("doc_id", F.coalesce(F.decode(F.aggregate("found", F.lit(b""), lambda all_, one: F.concat(all_, one["piece"])), "UTF-8"),
                                         F.lit("")).alias("decoded")))
