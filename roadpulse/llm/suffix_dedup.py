"""Operator 4: removal of long repeated byte strings by a range-partitioned suffix sort.

Suffixes are cut at the window's width, and of all suffixes only those at locally chosen
anchors are sorted: the position whose first ``LEAD`` bytes hash smallest inside a window
(so every window has one, and equal windows have it at the same place). Splitters sampled
from the anchors' leading bytes range-partition the suffixes; every range sorts its own
by multikey quicksort on 8-byte words. Equal leading words always share a range, so
suffixes that agree beyond it are neighbours inside one range, and no repeat hangs over
a boundary. Full suffixes would cost the shuffle a hundred times the text.

Inputs: ``documents``-like rows (doc_id, text, any other columns, which are ignored).
A null text counts as empty, a null doc_id as smaller than every other. Rows that repeat
an id are one document for "earlier": a string at the same start under the same id is
not earlier. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from roadpulse.llm.common import BYTE_SYMBOLS, Rolling, flat_bytes, pieces
from roadpulse.llm.repeats import (ZIPPED_PIECE, Scheme, covered, inflate, repeated_ranges, stretches, texts_with_id, with_ranges)

LEAD = 24
SPLITTER_SAMPLE_DOCS = 4000
SPLITTERS_AT_MOST = 2000
_LOW = np.uint64((1 << 32) - 1)


def _word(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The 8 bytes from ``at`` as a big-endian number, so numbers sort as strings do."""
    out = np.zeros(len(at), np.uint64)
    for i in range(8):
        out = (out << np.uint64(8)) | data[at + i]
    return out


class ByteScheme(Scheme):
    def __init__(self, width: int, splitters: np.ndarray | None = None):
        self.width = width
        self.lead = max(1, min(LEAD, width))
        self.splitters = splitters if splitters is not None else np.zeros(0, np.uint64)

    def parse(self, data, offsets):
        return BYTE_SYMBOLS[data], offsets

    def owners(self, symbols, rolling, offsets, valid):
        least = rolling.windows(self.lead)
        least = (least & ~_LOW) | np.arange(len(least), dtype=np.uint64)
        reach, span = self.width - self.lead + 1, 1
        while 2 * span <= reach:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        n = len(symbols) - self.width + 1
        least = np.minimum(least[:n], least[reach - span:reach - span + n])
        own = np.zeros(len(symbols), np.int64)
        own[:n] = (least & _LOW).astype(np.int64)
        return own

    def keys(self, symbols, rolling, own, data):
        words = [_word(data, own + i) for i in range(0, self.lead - 7, 8)]
        return np.stack(words or [rolling.slices(own, own + self.lead)], axis=1)

    def buckets(self, first_word):
        return np.searchsorted(self.splitters, first_word, side="right")


def _splitters(docs: DataFrame, width: int) -> np.ndarray:
    """Quantiles of the leading words of a bounded sample of rows."""
    total = docs.count()
    texts = texts_with_id(docs).sample(min(1.0, SPLITTER_SAMPLE_DOCS / max(total, 1)), seed=7)
    scheme = ByteScheme(width)

    def leads(batches):
        for piece in pieces(batches):
            records = stretches(scheme, *flat_bytes(piece.column(2)))
            if records:  # flipped top bit: signed order equals byte order
                yield pa.record_batch([pa.array((records["keys"][:, 0] ^ np.uint64(1 << 63)).view(np.int64))], names=["lead"])
    wanted = min(SPLITTERS_AT_MOST, 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    shares = [i / wanted for i in range(1, wanted)]
    row = texts.mapInArrow(leads, "lead bigint").agg(F.percentile_approx("lead", shares, 20 * wanted).alias("q")).first()
    return np.unique(np.array(row["q"] or [], np.int64).view(np.uint64) ^ np.uint64(1 << 63))


def remove_repeats(docs: DataFrame, width: int = 100) -> DataFrame:
    """Delete every byte covered by a ``width``-byte string that also starts earlier.

    Returns doc_id, n_bytes, n_removed, n_spans, spans (removed byte ranges, end
    exclusive) and ``kept`` (the remaining bytes).
    """
    scheme = ByteScheme(width, _splitters(docs, width))
    rows = with_ranges(docs, repeated_ranges(docs, scheme))

    def apply(batches):
        for piece in pieces(batches, ZIPPED_PIECE):
            data, offsets = flat_bytes(inflate(piece.column(1)))
            gone = covered(piece.column(2), offsets, width)
            edge = np.zeros(len(gone) + 1, np.int8)
            edge[:-1] = gone
            before = np.zeros(len(gone) + 1, np.int8)
            before[1:] = gone
            before[offsets] = 0
            opens = np.flatnonzero((edge == 1) & (before == 0))
            follows = edge.copy()
            follows[offsets] = 0
            after = np.flatnonzero(gone & (follows[1:] == 0)) + 1
            row = np.searchsorted(offsets, opens, side="right") - 1
            sums = np.concatenate([[0], np.cumsum(gone)])
            removed = sums[offsets[1:]] - sums[offsets[:-1]]
            span_offsets = np.searchsorted(row, np.arange(len(offsets)))
            spans = pa.ListArray.from_arrays(pa.array(span_offsets.astype(np.int32)), pa.StructArray.from_arrays(
                [pa.array(opens - offsets[row]), pa.array(after - offsets[row])], ["start", "stop"]))
            kept = data[~gone].tobytes()
            ends = np.cumsum(np.diff(offsets) - removed)
            kept_rows = [kept[a:b] for a, b in zip(np.concatenate([[0], ends[:-1]]), ends)]
            yield pa.record_batch([piece.column(0), pa.array(np.diff(offsets)), pa.array(removed.astype(np.int64)),
                                   pa.array(np.diff(span_offsets).astype(np.int64)), spans, pa.array(kept_rows, pa.binary())],
                                  names=["doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept"])
    return rows.mapInArrow(apply, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, "
                                  "spans array<struct<start:bigint,stop:bigint>>, kept binary")
