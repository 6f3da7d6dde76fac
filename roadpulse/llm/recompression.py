"""Operator 3: removal of long repeated word passages by recompression.

Two kinds of rounds rename the word sequence. The run round replaces a run of one word by
one symbol; a pair round gives every symbol a side by a coin on its name and replaces each
left symbol followed by a right one by a symbol for the pair. A name is a 64-bit function
of what it stands for, so all tasks of a Spark round name alike and no dictionary has to be
shared. Equal passages get equal symbols except near their ends: each symbol keeps the
range of words its parse depended on, and a window *sees* a symbol whose range lies inside
it. The highest, then smallest-named symbol seen owns the window (the earlier of equals). A window
that sees none, such as one inside a long run, owns itself. Windows meet by owner and are
verified by content (module ``repeats``).

Inputs: rows with doc_id and text; other columns are ignored. Null text: no words. A null
doc_id is smaller than every other. Rows that repeat an id are one document for "earlier".
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from roadpulse.llm.common import BYTE_SYMBOLS, Rolling, flat_bytes, mix, pieces, word_bounds
from roadpulse.llm.repeats import ZIPPED_PIECE, Scheme, covered, inflate, repeated_ranges, with_ranges

PAIR_ROUNDS = 3
_LOW = np.uint64((1 << 32) - 1)
_NONE = np.uint64(2 ** 64 - 1)
_ALONE = 1 << 50  # marks windows that own themselves


def _pair_name(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * np.uint64(0x9E3779B97F4A7C15) + mix(b + np.uint64(0x632BE59BD9B4E019)))


class Symbols:
    """A level of the parse: names, the words they stand for, and what they depend on."""

    def __init__(self, name, start, stop, need_from, need_to, row):
        self.name, self.start, self.stop = name, start, stop
        self.need_from, self.need_to, self.row = need_from, need_to, row


def run_round(words: np.ndarray, row: np.ndarray) -> Symbols:
    n = len(words)
    new = np.ones(n, bool)
    new[1:] = (words[1:] != words[:-1]) | (row[1:] != row[:-1])
    start = np.flatnonzero(new)
    stop = np.append(start[1:], n)
    size = (stop - start).astype(np.uint64)
    name = np.where(size > 1, mix(words[start] ^ mix(size)), words[start])
    # the neighbours show that a run is whole; a row's edge is outside every window
    return Symbols(name, start, stop, start - 1, stop + 1, row[start])


def pair_round(s: Symbols, level: int) -> Symbols:
    n = len(s.name)
    left = (mix(s.name + np.uint64(level)) & np.uint64(1)) == 0
    paired = np.zeros(n, bool)
    paired[:-1] = left[:-1] & ~left[1:] & (s.row[:-1] == s.row[1:])
    second = np.zeros(n, bool)
    second[1:] = paired[:-1]
    # a lone left symbol depends on the next one, a lone right symbol on the one before
    nxt, prv = np.minimum(np.arange(n) + 1, n - 1), np.maximum(np.arange(n) - 1, 0)
    outside_after = np.where(s.row[nxt] == s.row, s.need_to[nxt], s.stop + (1 << 40))
    outside_before = np.where(s.row[prv] == s.row, s.need_from[prv], s.start - (1 << 40))
    if n:
        outside_after[-1] = s.stop[-1] + (1 << 40)
        outside_before[0] = s.start[0] - (1 << 40)
    need_from = np.where(left, s.need_from, np.minimum(s.need_from, outside_before))
    need_to = np.where(left, np.maximum(s.need_to, outside_after), s.need_to)
    name, stop = s.name.copy(), s.stop.copy()
    first = np.flatnonzero(paired)
    name[first] = _pair_name(s.name[first], s.name[first + 1])
    stop[first] = s.stop[first + 1]
    need_from[first] = np.minimum(s.need_from[first], s.need_from[first + 1])
    need_to[first] = np.maximum(s.need_to[first], s.need_to[first + 1])
    keep = ~second
    return Symbols(name[keep], s.start[keep], stop[keep], need_from[keep], need_to[keep], s.row[keep])


class WordScheme(Scheme):
    def __init__(self, width: int, buckets: int):
        self.width, self.n_buckets = width, buckets

    def parse(self, data, offsets):
        starts, stops, row = word_bounds(data, offsets)
        words = Rolling(BYTE_SYMBOLS[data]).slices(starts, stops)
        return words, np.searchsorted(row, np.arange(len(offsets)))

    def owners(self, words, rolling, offsets, valid):
        n = len(words)
        row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        levels = [run_round(words, row)]
        for level in range(1, PAIR_ROUNDS + 1):
            levels.append(pair_round(levels[-1], level))
        own = np.arange(n) | _ALONE
        open_ = valid.copy()
        self.names = []
        for s in reversed(levels):
            # rank: hash of the name above the place, so the smallest name wins, then the earliest
            rank = (mix(s.name ^ np.uint64(0xD6E8FEB86659FD93)) & ~_LOW) | s.start.astype(np.uint64)
            best = np.full(n, _NONE)
            room = s.need_from - (s.need_to - self.width)  # a window may start this much before need_from
            alive = np.flatnonzero((room >= 0) & (s.need_from >= 0))
            for t in range(self.width):
                alive = alive[(room[alive] >= t) & (s.need_from[alive] >= t)]
                np.minimum.at(best, s.need_from[alive] - t, rank[alive])
            seen = open_ & (best != _NONE)
            own[seen] = (best[seen] & _LOW).astype(np.int64) | (len(self.names) << 40)
            open_ &= ~seen
            names = np.zeros(n, np.uint64)
            names[s.start] = s.name
            self.names.append(names)
        return own

    def keys(self, words, rolling, own, data):
        at, level = own & ((1 << 40) - 1), own >> 40
        out = np.zeros(len(own), np.uint64)
        for i, names in enumerate(self.names):
            out[level == i] = names[at[level == i]]
        alone = at[own >= _ALONE]
        out[own >= _ALONE] = rolling.slices(alone, alone + self.width)
        return out[:, None]

    def buckets(self, first_word):
        return (first_word % np.uint64(self.n_buckets)).astype(np.int64)


def remove_repeats(docs: DataFrame, width: int = 20) -> DataFrame:
    """Remove every word covered by a ``width``-word window that also starts earlier.

    Returns doc_id, n_words, n_removed, ``kept`` (the remaining words joined by a space)
    and ``spans`` (removed word ranges, end exclusive).
    """
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    scheme = WordScheme(width, 4 * partitions)
    rows = with_ranges(docs, repeated_ranges(docs, scheme))

    def apply(batches):
        for piece in pieces(batches, ZIPPED_PIECE):
            texts = [t.split() for t in inflate(piece.column(1)).to_pylist()]
            units = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
            gone = covered(piece.column(2), units, width)
            kept, removed, spans = [], [], []
            for words, a, b in zip(texts, units[:-1], units[1:]):
                mask = gone[a:b]
                lost = int(mask.sum())
                removed.append(lost)
                if lost:
                    words = [w for w, g in zip(words, mask.tolist()) if not g]
                edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))) if lost else np.zeros(0, int)
                spans.append([{"start": int(x), "stop": int(y)} for x, y in zip(edges[::2], edges[1::2])])
                kept.append(b" ".join(words))
            yield pa.record_batch([piece.column(0), pa.array(np.diff(units)), pa.array(removed, pa.int64()),
                                   pa.array(kept, pa.binary()).cast(pa.string()),
                                   pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))],
                                  names=["doc_id", "n_words", "n_removed", "kept", "spans"])
    return rows.mapInArrow(apply, "doc_id bigint, n_words bigint, n_removed bigint, kept string, "
                                  "spans array<struct<start:bigint,stop:bigint>>")
