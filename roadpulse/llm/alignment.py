"""Operator 11: aligning the tokens of two tokenizers over the same bytes.

Each text is encoded by a byte-level vocabulary (A) and a piece vocabulary (B). Where a token
of A and one of B end at the same byte the text is cut; tokens between two cuts form a group,
and every A-B pair of a group is a link. All documents of a chunk are merged in lockstep: one
NumPy state holds the A and B pointers of all of them, each step advances the pointer that is
behind (both at a cut), writes down the cuts and links that it closed, and drops finished
documents. A document of many tokens takes part as several lanes, each beginning right after
a cut, so the number of steps does not follow the longest text.

How many documents hold a pair linked is counted over the whole corpus: a chunk hands on each
of its pairs once with its number of documents, the sums are joined back to the chunks by
pair, and each chunk's documents look their links up. No link is a row of a shuffle.

Inputs: rows with doc_id and text; other columns, whatever their names, are ignored. A text
that is null or empty, or that one of the vocabularies does not give back byte for byte, has
no tokens: zeros and an empty hash. Such rows are returned too. A null doc_id stays null;
repeated rows are aligned each and count each as a document. An empty table gives no rows.
Memory follows a chunk, or the longest document; the links of a group of very many tokens are
kept as distinct id pairs with multiplicities.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from roadpulse.llm.common import NULL_ID, id_and_text, ids_of, pieces
from roadpulse.llm.word_table import Splitter, chunk_number, from_planes, packed, piece_table, planes, ragged, tokenizer, unpacked
from roadpulse.session import settle

PIECES = "piece_bpe_32k.model"
TWIN = "byte_bpe_50k.tiktoken"   # the ranks of A's merges
CHUNK_BYTES = 2 << 20
LANE = 256                # tokens of A in a lane, about
REMEMBERED = 150_000      # cuts whose ids a task keeps
BIG_GROUP = 1 << 14       # links of a group above which only distinct pairs are written down


class Pair:
    """Both tokenizers; encodes the texts of a chunk."""

    def __init__(self, folder: str | None = None):
        import public_tokenizers
        import tiktoken
        from sentencepiece import SentencePieceProcessor
        self.a = tokenizer(folder)
        self.a.encode_special_tokens = True
        self.split = Splitter(self.a, special=False)
        self.b = SentencePieceProcessor(model_file=f"{folder}/{PIECES}" if folder else public_tokenizers.path(PIECES))
        self.a_bytes = piece_table(self.a)
        self.b_bytes = [self._piece(i) for i in range(self.b.get_piece_size())]
        if any("▁" in self.b.id_to_piece(i).lstrip("▁") for i in range(self.b.get_piece_size())):
            raise ValueError("pieces that go on behind a space cannot be encoded cut by cut")
        with open(f"{folder}/{TWIN}" if folder else public_tokenizers.path(TWIN), "rb") as lines:
            ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}
        self.plain = tiktoken.Encoding("twin", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})._encode_single_piece
        self._forget()
        self.a_size, self.b_size = (np.array([len(t) for t in table], np.int64) for table in (self.a_bytes, self.b_bytes))

    def _forget(self) -> None:
        self.known, self.flat, self.many, self.sound = Numbers(), ([], []), ([], []), []

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    def _encode_a(self, cuts: list[str]) -> list[list[int]]:
        """One word of letters goes straight to the merges, in the vocabulary's faster twin; the rest through the tokenizer."""
        plain, checked = self.plain, self.split.checked
        found = [plain(c.encode()) if c[1:].isalpha() and checked(c) else None for c in cuts]
        rest = [k for k, f in enumerate(found) if f is None]
        for k, e in zip(rest, self.a.encode_batch_fast([cuts[k] for k in rest], add_special_tokens=False)):
            found[k] = e.ids
        return found

    def _learn(self, fresh: list[str]) -> None:
        """Encode cuts that were not seen before; A's words and B's pieces never cross the space before a cut."""
        both = self._encode_a(fresh), self.b.encode([c[1:] for c in fresh], num_threads=1)
        for side, found in enumerate(both):
            self.many[side].append(np.fromiter(map(len, found), np.int64, len(found)))
            self.flat[side].append(np.fromiter(chain.from_iterable(found), np.int32))
        self.sound.append(np.array([all(b"".join([table[i] for i in ids]) == c.encode() for ids, table in ((a, self.a_bytes), (b, self.b_bytes)))
                                    for c, a, b in zip(fresh, *both)], bool))

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of A and B of every text; none where a side does not give the bytes back."""
        if len(self.known) > REMEMBERED:
            self._forget()
        cuts = [[" " + text] if text.endswith(" ") else self.split.cuts(" " + text)[1:] or [" " + text] for text in texts]
        before = len(self.known)
        own = np.fromiter(map(self.known.__getitem__, chain.from_iterable(cuts)), np.int64)
        self._learn(list(islice(self.known, before, None)))
        ends = np.cumsum([0, *map(len, cuts)])
        self.sound[:] = [np.concatenate(self.sound)]
        doubtful = np.concatenate([[0], np.cumsum(~self.sound[0][own])])[ends]
        sides = []
        for side in (0, 1):
            many, flat = np.concatenate(self.many[side]), np.concatenate(self.flat[side])
            self.many[side][:], self.flat[side][:] = [many], [flat]
            ids, at = flat[ragged((np.cumsum(many) - many)[own], many[own])].astype(np.int64), np.concatenate([[0], np.cumsum(many[own])])[ends]
            sides.append([ids[i:j] for i, j in zip(at, at[1:])])
        for k, text in enumerate(texts):
            if not text or doubtful[k + 1] > doubtful[k] and any(
                    b"".join([table[i] for i in ids[k].tolist()]) != b" " + text.encode()
                    for ids, table in zip(sides, (self.a_bytes, self.b_bytes))):
                sides[0][k] = sides[1][k] = np.zeros(0, np.int64)
        return sides[0], sides[1]


class Numbers(dict):
    def __missing__(self, cut: str) -> int:
        number = self[cut] = len(self)
        return number


class Merged:
    """Cuts and links of a chunk, from the flat tokens of all its documents."""

    def __init__(self, a_ids: list[np.ndarray], b_ids: list[np.ndarray], a_size: np.ndarray, b_size: np.ndarray, lane: int = LANE):
        self.a, self.b = (np.concatenate(ids) if ids else np.zeros(0, np.int64) for ids in (a_ids, b_ids))
        self.a_from, self.b_from = (np.cumsum([0, *map(len, ids)]) for ids in (a_ids, b_ids))
        # documents stand one after the other, so positions grow over the whole chunk and documents end at cuts
        self.a_end, self.b_end = np.cumsum(a_size[self.a]), np.cumsum(b_size[self.b])
        self.width = np.int64(len(b_size))
        self.span = np.int64(len(a_size)) * self.width
        self.weighted = False   # whether some links are written down with a multiplicity
        self._merge(*self._lanes(lane))

    def _lanes(self, lane: int) -> tuple[np.ndarray, ...]:
        """First tokens of each lane, and the token of A after its last."""
        first, last = self.a_from[:-1], self.a_from[1:]
        some = last > first
        at = np.concatenate([first[some], *(np.arange(f + lane, t, lane) for f, t in zip(first.tolist(), last.tolist()) if t - f > lane)])
        start = np.isin(at, first[some])
        begins = [at[start]]
        look = at[~start] - 1
        while len(look):  # the next token of A that ends at a cut; a document's last one does
            place = np.searchsorted(self.b_end, self.a_end[look])
            cut = self.b_end[place] == self.a_end[look]
            begins.append(look[cut] + 1)
            look = look[~cut] + 1
        a0 = np.unique(np.concatenate(begins))
        a0 = a0[a0 < len(self.a)]
        b0 = np.where(a0 > 0, np.searchsorted(self.b_end, self.a_end[a0 - 1]) + 1, 0)
        return a0, b0, np.append(a0[1:], len(self.a))

    def _merge(self, a_at: np.ndarray, b_at: np.ndarray, stop: np.ndarray) -> None:
        a_open, b_open = a_at.copy(), b_at.copy()
        cuts, links, pairs, many = [], [], [], []
        while len(a_at):
            a_end, b_end = self.a_end[a_at], self.b_end[b_at]
            closed = np.flatnonzero(a_end == b_end)
            if len(closed):
                group = np.stack([a_open[closed], a_at[closed] + 1, b_open[closed], b_at[closed] + 1])
                cuts.append(group)
                self._link(group, links, pairs, many)
            a_at = a_at + (a_end <= b_end)
            b_at = b_at + (b_end <= a_end)
            if len(closed):
                a_open[closed], b_open[closed] = a_at[closed], b_at[closed]
                alive = a_at < stop
                if not alive.all():
                    a_at, b_at, a_open, b_open, stop = (x[alive] for x in (a_at, b_at, a_open, b_open, stop))
        self.cuts = np.concatenate(cuts, axis=1) if cuts else np.zeros((4, 0), np.int64)
        self.cuts = self.cuts[:, np.argsort(self.cuts[0])]
        none = [np.zeros(0, np.int64)]
        self.link_at, self.link_pair, self.link_many = (np.concatenate(x or none) for x in (links, pairs, many))

    def _link(self, group: np.ndarray, links: list, pairs: list, many: list) -> None:
        """Write down the links of closed groups: a token of A (for its document), the id pair, how many."""
        a0, a1, b0, b1 = group
        wide = b1 - b0
        count = (a1 - a0) * wide
        big = count > BIG_GROUP
        if big.any():
            self.weighted = True
            for i in np.flatnonzero(big).tolist():
                a, a_many = np.unique(self.a[a0[i]:a1[i]], return_counts=True)
                b, b_many = np.unique(self.b[b0[i]:b1[i]], return_counts=True)
                links.append(np.full(len(a) * len(b), a0[i]))
                pairs.append((a[:, None] * self.width + b).ravel())
                many.append((a_many[:, None] * b_many).ravel())
            a0, b0, wide, count = (x[~big] for x in (a0, b0, wide, count))
        if len(count) and count.max() > 1:
            own = np.repeat(np.arange(len(count)), count)
            inside = ragged(np.zeros(len(count), np.int64), count)
            a, b = a0[own] + inside // wide[own], b0[own] + inside % wide[own]
        else:
            a, b = a0, b0
        links.append(a)
        pairs.append(self.a[a] * self.width + self.b[b])
        many.append(np.ones(len(a), np.int64))

    def groups(self) -> tuple[np.ndarray, np.ndarray]:
        """Per document the first of its cuts (one more at the end), and the links of each cut."""
        a0, a1, b0, b1 = self.cuts
        return np.searchsorted(a0, self.a_from), (a1 - a0) * (b1 - b0)

    def spelled(self, words: list[str], a_count: int) -> Iterator[str]:
        """Each document's groups as ``a1,a2|b1;a3|b2,b3``. ``words``: see ``spellings``."""
        a0, a1, b0, b1 = self.cuts
        shown = np.empty(len(self.a) + len(self.b), np.int64)   # tokens group by group, A before B
        closing = np.zeros(len(shown), bool)
        shown[np.arange(len(self.a)) + np.repeat(b0, a1 - a0)] = self.a
        shown[np.arange(len(self.b)) + np.repeat(a1, b1 - b0)] = self.b + a_count
        closing[a1 + b0 - 1] = closing[a1 + b1 - 1] = True
        shown[closing] += len(words) // 2
        ends = self.a_from + self.b_from
        for i, j in zip(ends, ends[1:]):
            yield "".join(map(words.__getitem__, shown[i:j].tolist()))[:-1]

    def document_pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, id pair, links) of every distinct pair of a document, in this order."""
        doc = np.searchsorted(self.a_from, self.link_at, side="right") - 1
        key, span = doc * self.span + self.link_pair, self.span
        if self.weighted:
            order = np.argsort(key)
            key, many = key[order], self.link_many[order]
        else:
            key, many = np.sort(key), self.link_many
        at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])[:len(key)])
        return key[at] // span, key[at] % span, np.add.reduceat(many, at) if len(at) else np.zeros(0, np.int64)


def spellings(a_count: int, b_count: int) -> list[str]:
    """Decimal ids followed by a comma, and once more by the sign that ends a side of a group."""
    ids = [*map(str, range(a_count)), *map(str, range(b_count))]
    return [i + "," for i in ids] + [i + "|" for i in ids[:a_count]] + [i + ";" for i in ids[a_count:]]


def _chunks(batches: Iterable[pa.RecordBatch], limit: int) -> Iterator[tuple[int, list[int], list[str]]]:
    """Numbered runs of whole documents with about ``limit`` characters."""
    index, size, ids, texts = 0, 0, [], []
    for piece in pieces(batches):
        for doc, text in zip(ids_of(piece.column(0)).tolist(), piece.column(1).to_pylist()):
            ids.append(doc)
            texts.append(text)
            size += len(text)
            if size >= limit:
                yield chunk_number(index), ids, texts
                index, size, ids, texts = index + 1, 0, [], []
    if ids:
        yield chunk_number(index), ids, texts


CHUNK_SCHEMA = "chunk bigint, documents binary, pair array<bigint>, holders array<bigint>"
DIGEST_SCHEMA = ("doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, "
                 "groups_sha256 string")


def _aligning(folder: str | None, chunk_bytes: int, lane: int):
    def one(tokens: Pair, words: list[str], chunk: int, ids: list[int], texts: list[str]) -> pa.RecordBatch:
        a_ids, b_ids = tokens.encode(texts)
        merged = Merged(a_ids, b_ids, tokens.a_size, tokens.b_size, lane)
        bounds, links = merged.groups()
        before = np.concatenate([[0], np.cumsum(links)])
        doc, pair, many = merged.document_pairs()
        known, slot = np.unique(pair, return_inverse=True)
        kept = packed(
            doc_id=pa.array(ids, pa.int64()), n_a=pa.array([len(x) for x in a_ids], pa.int64()), n_b=pa.array([len(x) for x in b_ids], pa.int64()),
            n_groups=pa.array(np.diff(bounds)), n_links=pa.array(before[bounds[1:]] - before[bounds[:-1]]),
            pairs=pa.array(np.bincount(doc, minlength=len(ids))),
            groups_sha256=pa.array([hashlib.sha256(shown.encode()).hexdigest() if shown else ""
                                    for shown in merged.spelled(words, len(tokens.a_bytes))], pa.string()))
        rest = packed(slot=pa.array([planes(slot)], pa.large_binary()), many=pa.array([planes(many)], pa.large_binary()))
        both = len(kept).to_bytes(8, "little") + kept + rest
        return pa.record_batch([pa.array([chunk], pa.int64()), pa.array([both], pa.binary()), pa.array([known], pa.list_(pa.int64())),
                                pa.array([np.bincount(slot, minlength=len(known))], pa.list_(pa.int64()))],
                               names=["chunk", "documents", "pair", "holders"])

    def run(batches):
        tokens = Pair(folder)
        words = spellings(len(tokens.a_bytes), len(tokens.b_bytes))
        for chunk, ids, texts in _chunks(batches, chunk_bytes):
            yield one(tokens, words, chunk, ids, texts)
    return run


def aligned_chunks(docs: DataFrame, folder: str | None = None, chunk_bytes: int = CHUNK_BYTES, lane: int = LANE) -> DataFrame:
    """Settled table of chunks: documents with their links as positions in the chunk's list of id pairs."""
    return settle(id_and_text(docs).mapInArrow(_aligning(folder, chunk_bytes, lane), CHUNK_SCHEMA), "aligned")


def pair_counts(chunks: DataFrame, b_vocabulary: int) -> DataFrame:
    """(pair, a_id, b_id, documents, best): how many documents hold a pair linked, and whether no pair of its A id has more."""
    counts = settle(chunks.select(F.explode(F.arrays_zip("pair", "holders")).alias("x")).groupBy(F.col("x.pair").alias("pair"))
                    .agg(F.sum("x.holders").alias("documents"))
                    .withColumn("a_id", F.expr(f"pair div {b_vocabulary}")), "pairs")
    most = counts.groupBy("a_id").agg(F.max("documents").alias("most"))   # at most one row for each id of A's vocabulary
    return counts.join(most, "a_id").select("pair", "a_id", F.pmod("pair", F.lit(b_vocabulary)).alias("b_id"), "documents",
                                            (F.col("documents") == F.col("most")).alias("best"))


def _b_vocabulary(folder: str | None) -> int:
    return len(Pair(folder).b_bytes)


def digests(docs: DataFrame, folder: str | None = None, chunk_bytes: int = CHUNK_BYTES, lane: int = LANE) -> DataFrame:
    """One row a document: tokens, groups, links, links whose pair is its A id's most frequent, and the sum of counts."""
    chunks = aligned_chunks(docs, folder, chunk_bytes, lane)
    counts = settle(pair_counts(chunks, _b_vocabulary(folder)).select("pair", "documents", "best"), "counts")
    asked = chunks.select("chunk", F.posexplode("pair").alias("slot", "pair"))
    replies = asked.join(counts, "pair").select(F.col("chunk").alias("of_chunk"), "slot", "documents", "best")

    def finish(key, own: pa.Table, found: pa.Table) -> pa.Table:
        data = own["documents"][0].as_py()
        size = int.from_bytes(data[:8], "little")
        rows, rest = unpacked(data[8:8 + size]), unpacked(data[8 + size:])
        slot, many = (from_planes(rest.column(i)[0].as_py()).astype(np.int64) for i in (0, 1))
        count, best = np.zeros(found.num_rows, np.int64), np.zeros(found.num_rows, np.int64)
        at = found["slot"].to_numpy()
        count[at], best[at] = found["documents"].to_numpy(), found["best"].to_numpy()
        ends = np.concatenate([[0], np.cumsum(rows.column("pairs").to_numpy())])

        def summed(values):
            sums = np.concatenate([[0], np.cumsum(values[slot] * many)])
            return pa.array(sums[ends[1:]] - sums[ends[:-1]])

        ids = rows.column("doc_id").to_numpy()
        return pa.table({"doc_id": pa.array(ids, mask=ids == NULL_ID), **{n: rows.column(n) for n in ("n_a", "n_b", "n_groups", "n_links")},
                         "n_best": summed(best), "count_sum": summed(count), "groups_sha256": rows.column("groups_sha256")})

    return chunks.select("chunk", "documents").groupBy("chunk").cogroup(replies.groupBy("of_chunk")).applyInArrow(finish, DIGEST_SCHEMA)


def aligned_documents(docs: DataFrame, folder: str | None = None, chunk_bytes: int = CHUNK_BYTES, lane: int = LANE) -> DataFrame:
    """(doc_id, a_ids, b_ids, a_stops, b_stops): tokens, and for each group how many tokens of A and B end with it."""
    def run(batches):
        tokens = Pair(folder)
        for _, ids, texts in _chunks(batches, chunk_bytes):
            a_ids, b_ids = tokens.encode(texts)
            merged = Merged(a_ids, b_ids, tokens.a_size, tokens.b_size, lane)
            bounds, _ = merged.groups()
            own = [slice(i, j) for i, j in zip(bounds, bounds[1:])]
            kind = pa.list_(pa.int32())
            yield pa.record_batch([
                pa.array([None if i == NULL_ID else i for i in ids], pa.int64()),
                pa.array([x.astype(np.int32) for x in a_ids], kind), pa.array([x.astype(np.int32) for x in b_ids], kind),
                pa.array([(merged.cuts[1, s] - merged.a_from[k]).astype(np.int32) for k, s in enumerate(own)], kind),
                pa.array([(merged.cuts[3, s] - merged.b_from[k]).astype(np.int32) for k, s in enumerate(own)], kind)],
                names=["doc_id", "a_ids", "b_ids", "a_stops", "b_stops"])
    return id_and_text(docs).mapInArrow(run, "doc_id bigint, a_ids array<int>, b_ids array<int>, a_stops array<int>, b_stops array<int>")
