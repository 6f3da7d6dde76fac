"""Operator 1: packing token pieces into as few sequences as possible.

Only the histogram of piece lengths reaches the driver: at most ``capacity`` numbers,
whatever the corpus. There the configuration linear program (how often to use each way of
filling a sequence) is solved by multiplicative weights: a length's price falls
exponentially with its coverage, knapsack dynamic programming finds the configuration
worth most, and that one is used more. Multiplicities are rounded down and never exceed
what is left; the rest of the histogram is packed best-fit decreasing. Every slot of the
plan is then filled by exactly one piece: pieces of one length are numbered (in salted
groups, so a length with a third of all pieces is no single task) and look their slot up.

Inputs: rows with doc_id and text; other columns are ignored. A null text is empty and
makes a piece of one end token. Repeated rows are packed repeatedly. An empty table gives
no rows.
"""

from __future__ import annotations

import base64
import functools
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from roadpulse.llm.common import id_and_text, pieces
from roadpulse.session import settle

CAPACITY = 1024
END_TOKEN = 2
SALTS = 64
CACHE_ENTRIES = 200_000


class Tokens:
    """Token ids of texts as little-endian 32-bit strings.

    A text is cut at its single spaces, where the tokenizer's pre-tokens never cross, and
    the ids of each cut are remembered; a text's new cuts are encoded together. Cuts of characters beyond Latin letters go through
    the tokenizer file itself; the others through its faster twin with the same ids.
    """

    def __init__(self, folder: str | None = None):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer
        path = (lambda name: f"{folder}/{name}") if folder else public_tokenizers.path
        self.exact = Tokenizer.from_file(path("byte_bpe_50k.json"))
        with open(path("byte_bpe_50k.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                                      special_tokens={"<|endoftext|>": len(ranks)})
        self.plain = re.compile(r"[\x00-ɏ]*").fullmatch
        self.spaced = np.zeros(self.fast.n_vocab + self.exact.get_vocab_size(), bool)
        self.spaced[[i for piece, i in ranks.items() if piece.startswith(b" ")]] = True
        self.known: dict[str, bytes] = {}

    def _ids(self, text: str) -> list[int]:
        if not self.plain(text):
            return self.exact.encode(text, add_special_tokens=False).ids
        if "<|" in text:
            return self.fast.encode(text, allowed_special="all")
        return self.fast.encode_ordinary(text)

    def _encode(self, text: str) -> bytes:
        ids = self._ids(text)
        return struct.pack(f"<{len(ids)}I", *ids)

    def _learn(self, cuts: list[str]) -> bool:
        """Remember the ids of ``cuts``, encoded in one go: a token that begins with a space begins a cut."""
        ids = np.array(self._ids(" " + " ".join(cuts)), "<u4")
        at = np.flatnonzero(self.spaced[ids])
        if len(at) != len(cuts):
            return False
        data, ends = ids.tobytes(), [*(at[1:] * 4).tolist(), len(ids) * 4]
        for cut, start, end in zip(cuts, (at * 4).tolist(), ends):
            self.known[cut] = data[start:end]
        return True

    def __call__(self, text: str) -> bytes:
        first, *rest = text.split(" ")
        if first[-1:].isspace():
            return self._encode(text)
        known = self.known
        out = [*map(known.get, rest)]
        if None in out:
            missing = [*dict.fromkeys(cut for cut, ids in zip(rest, out) if ids is None)]
            # white space beside a space: the pre-tokens are others there
            if any(not cut or cut[0].isspace() or cut[-1].isspace() for cut in missing):
                return self._encode(text)
            if len(known) > CACHE_ENTRIES:
                known.clear()
                missing = [*dict.fromkeys(rest)]
            groups = [], []
            for cut in missing:
                groups[self.plain(cut) is None].append(cut)
            if not all(self._learn(group) for group in groups if group):
                return self._encode(text)
            out = map(known.__getitem__, rest)
        return self._encode(first) + b"".join(out)


@functools.lru_cache(maxsize=2)
def _tokens(folder: str | None) -> Tokens:
    """One for all tasks of a Python worker: loading takes time, and what it remembers stays."""
    return Tokens(folder)


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, folder: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): documents cut to the capacity.

    All pieces of a cut document but the first are full.
    """
    def run(batches):
        tokens, end = _tokens(folder), np.array([END_TOKEN], "<u4").tobytes()
        for part in pieces(batches):
            doc, piece, start, length, crc = [], [], [], [], []
            for i, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                ids = tokens(text) + end
                n, at, k = len(ids) // 4, 0, 0
                size = n % capacity or capacity
                while at < n:
                    doc.append(i)
                    piece.append(k)
                    start.append(at)
                    length.append(size)
                    crc.append(zlib.crc32(ids[4 * at:4 * (at + size)]))
                    at, k, size = at + size, k + 1, capacity
            yield pa.record_batch([pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                                   pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                                  names=["doc_id", "piece", "start", "length", "ids_crc32"])
    return id_and_text(docs).mapInArrow(run, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


# --- the plan, from the histogram alone -----------------------------------------------

def priciest_configuration(lengths: np.ndarray, prices: np.ndarray, capacity: int) -> np.ndarray:
    """How many of each length fill one sequence at the highest total price (unbounded knapsack)."""
    best = np.zeros(capacity + 1)
    choice = np.full(capacity + 1, -1)
    fits = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for room in range(1, capacity + 1):
        best[room], choice[room] = best[room - 1], -1
        if fits[room]:
            worth = best[room - lengths[:fits[room]]] + prices[:fits[room]]
            top = int(worth.argmax())
            if worth[top] > best[room]:
                best[room], choice[room] = worth[top], top
    counts, room = np.zeros(len(lengths), np.int64), capacity
    while room > 0:
        if choice[room] < 0:
            room -= 1
        else:
            counts[choice[room]] += 1
            room -= lengths[choice[room]]
    return counts


def fractional_configurations(lengths, counts, capacity, step: float = 0.5, rate: float = 4.0, rounds: int = 1500):
    """Multiplicative weights for the covering program: [(configuration, multiplicity)]."""
    coverage, used = np.zeros(len(lengths)), {}
    for _ in range(rounds):
        short = coverage < 1
        if not short.any():
            break
        prices = np.where(short, lengths * np.exp(-rate * coverage), 0.0)
        configuration = priciest_configuration(lengths, prices, capacity)
        part = configuration > 0
        amount = step * float((counts[part] / configuration[part]).min())
        coverage[part] += amount * configuration[part] / counts[part]
        key = configuration.tobytes()
        used[key] = used.get(key, 0.0) + amount
    return [(np.frombuffer(k, np.int64), x) for k, x in used.items()]


def best_fit(lengths, counts, capacity) -> list[tuple[dict[int, int], int]]:
    """Best-fit decreasing on a histogram: [(pieces by length, number of sequences)]."""
    open_: dict[int, list] = {}
    for length, left in sorted(zip(lengths.tolist(), counts.tolist()), reverse=True):
        while left:
            room = min((r for r in open_ if r >= length), default=None)
            if room is None:
                per = capacity // length
                for inside, many in ((per, left // per), (left % per, 1 if left % per else 0)):
                    if many:
                        open_.setdefault(capacity - inside * length, []).append(({length: inside}, many))
                left = 0
                continue
            group = open_[room]
            config, many = group.pop()
            if not group:
                del open_[room]
            take = min(many, left)
            if many > take:
                open_.setdefault(room, []).append((config, many - take))
            open_.setdefault(room - length, []).append(({**config, length: config.get(length, 0) + 1}, take))
            left -= take
    return [entry for group in open_.values() for entry in group]


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """Sequences as [(pieces by length, how many such sequences)]; uses every piece once."""
    full = histogram.get(capacity, 0)
    out = [({capacity: 1}, full)] if full else []
    lengths = np.array(sorted(l for l, n in histogram.items() if n and l < capacity), np.int64)
    left = np.array([histogram[l] for l in lengths.tolist()], np.int64)
    if not len(lengths):
        return out
    for configuration, amount in sorted(fractional_configurations(lengths, left.copy(), capacity),
                                        key=lambda c: (-int((c[0] * lengths).sum()), -c[1])):
        part = configuration > 0
        many = min(int(amount), int((left[part] // configuration[part]).min()))
        if many > 0:
            left = left - many * configuration
            out.append(({int(l): int(k) for l, k in zip(lengths[part], configuration[part])}, many))
    rest = left > 0
    return out + best_fit(lengths[rest], left[rest], capacity)


def slots(sequences) -> tuple[np.ndarray, ...]:
    """Lookup arrays (length, first piece number, per sequence, first sequence, offset)."""
    rows, base, seen = [], 0, {}
    for config, many in sequences:
        offset = 0
        for length, per in sorted(config.items(), reverse=True):
            rows.append((length, seen.get(length, 0), per, base, offset))
            seen[length] = seen.get(length, 0) + many * per
            offset += per * length
        base += many
    rows.sort()
    return tuple(np.array(c, np.int64) for c in zip(*rows)) if rows else (np.zeros(0, np.int64),) * 5


def pack(docs: DataFrame, capacity: int = CAPACITY, folder: str | None = None) -> DataFrame:
    """Token pieces with their sequence_id and gapless offset."""
    cut = settle(token_pieces(docs, capacity, folder).withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(SALTS)).cast("int")), "pieces")
    sizes = settle(cut.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n")), "sizes")
    histogram = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    length, first, per, base, offset = slots(plan(histogram, capacity))
    before = sizes.withColumn("before", F.sum("n").over(W.partitionBy("length").orderBy("salt")) - F.col("n")).select(
        F.col("length").alias("k_length"), F.col("salt").alias("k_salt"), "before")
    numbered = cut.withColumn("at", F.row_number().over(W.partitionBy("length", "salt").orderBy("doc_id", "piece")) - F.lit(1))
    numbered = numbered.join(before, (F.col("length") == F.col("k_length")) & (F.col("salt") == F.col("k_salt"))).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("at")).alias("number"))
    keys = (length << 44) | first

    def place(batches):
        for batch in batches:
            n = batch.column(3).to_numpy()
            number = batch.column(5).to_numpy()
            row = np.searchsorted(keys, (n << 44) | number, side="right") - 1
            i = number - first[row]
            yield pa.record_batch([*batch.columns[:5], pa.array(base[row] + i // per[row]), pa.array(offset[row] + i % per[row] * n)],
                                  names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])
    return numbered.mapInArrow(place, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")
