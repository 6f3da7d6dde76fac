"""Exact removal of repeated fixed-width windows; shared by the two passage deduplicators.

A window (``width`` consecutive units, bytes or words, of one row) is removed when its
content also starts earlier: under a smaller doc_id, or earlier under the same one.
A scheme names, from a window's content alone, one *owner* inside it, so equal windows
have equal owners at equal places. Neighbouring windows with one owner form a *stretch*.

1. Every stretch sends one record (owner key, hash of the stretch, place). Records meet
   by key; equal stretches are settled at once, all but the earliest are repeats.
2. Different stretches under one key may still share some windows. Only for the earliest
   copy of those, the single windows are sent and meet by content.
3. The repeats of a row go to its text, which is masked.

Records leave a task packed by bucket, and equal ones are combined before they leave:
a passage that fills a third of all rows sends one record per task. No step compares
pairs. Hashes have 64 bits on top of an equal key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from roadpulse.llm.common import NULL_ID, PIECE_BYTES, Rolling, flat_bytes, id_and_text, ids_of, pieces
from roadpulse.session import settle

FLUSH_RECORDS = 1 << 18
ZIPPED_PIECE = PIECE_BYTES // 4  # pieces of compressed texts
PACKED = "bucket int, payload binary, settled binary"
FOUND = "doc_id bigint, th int, lo int, hi int, route int"  # route: null where all windows repeat
_FOUND_TYPES = pa.schema([("doc_id", pa.int64()), ("th", pa.int32()), ("lo", pa.int32()), ("hi", pa.int32()),
                          ("route", pa.int32())])


class Scheme:
    """What a deduplicator has to say about its units; see ``bytes`` and ``words``."""

    width: int

    def parse(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Unit symbols (64 bits each) of the concatenated rows, and the rows' unit offsets."""
        raise NotImplementedError

    def owners(self, symbols, rolling, offsets, valid) -> np.ndarray:
        """For every valid window start a number that names its owner within the piece."""
        raise NotImplementedError

    def keys(self, symbols, rolling, own: np.ndarray, data) -> np.ndarray:
        """Key words, shape (len(own), n): what the owners consist of."""
        raise NotImplementedError

    def buckets(self, first_word: np.ndarray) -> np.ndarray:
        raise NotImplementedError


def window_starts(offsets: np.ndarray, width: int) -> np.ndarray:
    """Mask of the unit positions at which a whole window of one row starts."""
    n = int(offsets[-1])
    change = np.zeros(n + 1, np.int32)
    np.add.at(change, np.maximum(offsets[1:] - width + 1, offsets[:-1]), 1)
    np.add.at(change, offsets[1:], -1)
    return np.cumsum(change[:-1]) == 0


def stretches(scheme: Scheme, data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    symbols, units = scheme.parse(data, offsets)
    valid = window_starts(units, scheme.width)
    if not valid.any():
        return {}
    rolling = Rolling(symbols)
    own = np.where(valid, scheme.owners(symbols, rolling, units, valid), -1)
    edge = np.ones(len(own), bool)
    edge[1:] = own[1:] != own[:-1]
    lo = np.flatnonzero(edge & valid)
    last = np.ones(len(own), bool)
    last[:-1] = edge[1:]
    hi = np.flatnonzero(last & valid)
    return _records(scheme.keys(symbols, rolling, own[lo], data), rolling.slices(lo, hi + scheme.width), units, lo, hi)


def single_windows(scheme: Scheme, data, offsets, rows, lo, hi, route) -> dict[str, np.ndarray]:
    """Every window that starts in the given unit ranges of the rows.

    Equal windows had equal owners, so they meet in the bucket of their stretch; there
    the content is the key. Neighbours travel together and cost little beside their hash.
    """
    symbols, units = scheme.parse(data, offsets)
    counts = hi - lo + 1
    at = np.repeat(units[rows] + lo - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
    content = Rolling(symbols).slices(at, at + scheme.width)
    return _records(content[:, None][:, :0], content, units, at, at) | {"route": np.repeat(route, counts)}


def _records(keys, content, units, lo, hi) -> dict[str, np.ndarray]:
    row = np.searchsorted(units, lo, side="right") - 1
    return {"keys": keys, "content": content, "row": row,
            "lo": (lo - units[row]).astype(np.int32), "hi": (hi - units[row]).astype(np.int32)}


# --- packing --------------------------------------------------------------------------

_FIELDS = (("content", np.uint64), ("doc", np.int64), ("th", np.int32), ("lo", np.int32), ("hi", np.int32))


def _pack(records: dict[str, np.ndarray], select) -> bytes:
    parts = [records[name][select] for name, _ in _FIELDS]
    parts[4] = parts[4] - parts[3]
    for i in (1, 3):  # differences wrap around, as do the sums that undo them
        parts[i] = np.diff(parts[i], prepend=parts[i].dtype.type(0))
    keys = records["keys"][select]
    head = np.array([len(parts[0]), keys.shape[1]], np.int64).tobytes()
    return zstandard.ZstdCompressor(level=1).compress(
        head + b"".join(np.ascontiguousarray(keys[:, i]).tobytes() for i in range(keys.shape[1]))
        + b"".join(np.ascontiguousarray(p.astype(kind)).tobytes() for p, (_, kind) in zip(parts, _FIELDS)))


def _unpack(blob: bytes) -> dict[str, np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, width = np.frombuffer(raw, np.int64, 2)
    at = 16 + 8 * n * width
    out = {"keys": np.frombuffer(raw, np.uint64, n * width, 16).reshape(width, n).T}
    for name, kind in _FIELDS:
        out[name] = np.frombuffer(raw, kind, n, at)
        at += n * np.dtype(kind).itemsize
    out["doc"] = np.cumsum(out["doc"])
    out["lo"] = np.cumsum(out["lo"], dtype=np.int32)
    out["hi"] = out["hi"] + out["lo"]
    return out


def _join(parts: list[dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    return {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}


def multikey_order(keys: np.ndarray, *ties: np.ndarray) -> np.ndarray:
    """Sorting order by key words, most significant first, then by ``ties``.

    One word at a time, as multikey quicksort goes: only runs that are still equal are
    ordered by the next word.
    """
    columns = [*(keys[:, i] for i in range(keys.shape[1])), *ties]
    order = np.argsort(columns[0], kind="stable")
    first = columns.pop(0)[order]
    equal = np.flatnonzero(first[1:] == first[:-1])
    if not len(equal):
        return order
    tied = np.union1d(equal, equal + 1)
    run = np.cumsum(np.concatenate([[True], first[1:] != first[:-1]]))
    for column in columns:
        chosen = order[tied]
        order[tied] = chosen[np.lexsort((column[chosen], run[tied]))]
        values, group = column[order[tied]], run[tied]
        same = (values[1:] == values[:-1]) & (group[1:] == group[:-1]) & (np.diff(tied) == 1)
        starts = np.concatenate([[True], ~same])
        run[tied] = np.flatnonzero(starts)[np.cumsum(starts) - 1] + len(order)
        inside = np.concatenate([[False], same]) | np.concatenate([same, [False]])
        tied = tied[inside]
        if not len(tied):
            break
    return order


def earliest(records: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, repeat, group number) of the records, sorted by key, content and place."""
    order = multikey_order(records["keys"], records["content"], records["doc"], records["lo"])
    keys, content = records["keys"][order], records["content"][order]
    new = np.ones(len(order), bool)
    new[1:] = (keys[1:] != keys[:-1]).any(axis=1) | (content[1:] != content[:-1])
    group = np.cumsum(new) - 1
    first = np.flatnonzero(new)[group]
    doc, lo = records["doc"][order], records["lo"][order]
    return order, (doc != doc[first]) | (lo != lo[first]), group


def _found(records, select, route: np.ndarray | None = None) -> pa.RecordBatch:
    columns = [pa.array(records[n][select]) for n in ("doc", "th", "lo", "hi")]
    columns.append(pa.nulls(len(columns[0]), pa.int32()) if route is None else pa.array(route.astype(np.int32)))
    return pa.record_batch(columns, schema=_FOUND_TYPES)


def _send(scheme: Scheme, parts: list[dict]) -> Iterator[pa.RecordBatch]:
    """Settle what repeats inside the task, pack the rest by bucket."""
    records = _join(parts)
    order, repeat, _ = earliest(records)
    out = []
    if repeat.any():
        again = np.sort(order[repeat])
        out.append((int(records["doc"][again[0]]) & 1023, None, _pack(records | {"keys": records["keys"][:, :0]}, again)))
    kept = np.sort(order[~repeat])
    bucket = records["route"][kept] if "route" in records else scheme.buckets(records["keys"][kept, 0])
    by = np.argsort(bucket, kind="stable")
    bounds = np.flatnonzero(np.diff(bucket[by], prepend=-1, append=-1))
    for a, b in zip(bounds[:-1], bounds[1:]):
        out.append((int(bucket[by[a]]), _pack(records, kept[by[a:b]]), None))
    yield pa.record_batch([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int32(), pa.binary(), pa.binary()))],
                          names=["bucket", "payload", "settled"])


def _sender(scheme: Scheme, find, limit: int = PIECE_BYTES):
    def run(batches):
        parts, held = [], 0
        for piece in pieces(batches, limit):
            records = find(piece)
            if not records:
                continue
            row = records.pop("row")
            records["doc"] = ids_of(piece.column(0))[row]
            records["th"] = piece.column(1).to_numpy(zero_copy_only=False)[row]
            parts.append(records)
            held += len(row)
            if held >= FLUSH_RECORDS:
                yield from _send(scheme, parts)
                parts, held = [], 0
        if parts:
            yield from _send(scheme, parts)
    return run


def _receiver(scheme: Scheme | None):
    """Meet the records of a partition's buckets: repeats, and stretches to look at closer."""
    def run(batches):
        parts = []
        for batch in batches:
            for payload, settled in zip(batch.column(1), batch.column(2)):
                if settled.is_valid:
                    yield _found(_unpack(settled.as_py()), slice(None))
                if payload.is_valid:
                    parts.append(_unpack(payload.as_py()))
        if not parts:
            return
        records = _join(parts)
        order, repeat, group = earliest(records)
        if repeat.any():
            yield _found(records, order[repeat])
        if scheme is None:
            return
        keys = records["keys"][order]
        new_key = np.ones(len(order), bool)
        new_key[1:] = (keys[1:] != keys[:-1]).any(axis=1)
        of_key = np.cumsum(new_key) - 1
        contents = np.diff(group[np.flatnonzero(new_key)], append=group[-1] + 1)
        closer = ~repeat & (contents[of_key] > 1)
        if closer.any():
            yield _found(records, order[closer], scheme.buckets(keys[closer, 0]))
    return run


def _meet(packed: DataFrame, scheme: Scheme | None) -> DataFrame:
    n = int(packed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return packed.repartition(2 * n, "bucket").mapInArrow(_receiver(scheme), FOUND)


def _ranges(found: DataFrame) -> DataFrame:
    return found.groupBy("doc_id", "th").agg(F.collect_list(F.struct("lo", "hi", "route")).alias("ranges")).select(
        F.col("doc_id").alias("r_doc"), F.col("th").alias("r_th"), "ranges")


def _compressed(batches):
    shrink = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(
            [shrink.compress(t.as_buffer()) for t in batch.column(2).cast(pa.large_binary())], pa.binary())],
            names=["doc_id", "th", "text"])


def inflate(column: pa.Array) -> pa.Array:
    grow = zstandard.ZstdDecompressor()
    return pa.array([grow.decompress(t.as_buffer()) for t in column], pa.large_binary())


def texts_with_id(docs: DataFrame) -> DataFrame:
    """(doc_id, th, text): the id with null as the smallest number, and a text hash.

    Both together name a row; rows equal in both are the same document twice and
    get the same result.
    """
    return id_and_text(docs).select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("doc_id"), F.hash("text").alias("th"), "text")


def flat_ranges(column: pa.Array) -> tuple[np.ndarray, ...]:
    """(row, lo, hi, route) of a list-of-ranges column."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(column.offsets.to_numpy())
    values = column.flatten()
    row = np.repeat(np.arange(len(column)), np.where(column.is_valid().to_numpy(zero_copy_only=False), sizes, 0))
    return row, *(values.field(i).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3))


def repeated_ranges(docs: DataFrame, scheme: Scheme) -> DataFrame:
    """(doc_id, th, lo, hi): all windows starting in lo..hi repeat."""
    texts = texts_with_id(docs)

    def first(piece):
        return stretches(scheme, *flat_bytes(piece.column(2)))

    def second(piece):
        data, offsets = flat_bytes(inflate(piece.column(2)))
        return single_windows(scheme, data, offsets, *flat_ranges(piece.column(3)))

    found = settle(_meet(texts.mapInArrow(_sender(scheme, first), PACKED), scheme), "stretches")
    small = texts.mapInArrow(_compressed, "doc_id bigint, th int, text binary")
    closer = small.join(_ranges(found.where("route is not null")), (F.col("doc_id") == F.col("r_doc")) & (F.col("th") == F.col("r_th")))
    closer = closer.select("doc_id", "th", "text", "ranges")
    singles = _meet(closer.mapInArrow(_sender(scheme, second, ZIPPED_PIECE), PACKED), None)
    return found.where("route is null").unionByName(singles)


def with_ranges(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Every row's (doc_id, compressed text, repeated ranges)."""
    small = texts_with_id(docs).mapInArrow(_compressed, "doc_id bigint, th int, text binary")
    joined = small.join(_ranges(found), (F.col("doc_id") == F.col("r_doc")) & (F.col("th") == F.col("r_th")), "left")
    return joined.select(F.when(F.col("doc_id") != NULL_ID, F.col("doc_id")).alias("doc_id"), "text",
                         F.coalesce("ranges", F.array().cast("array<struct<lo:int,hi:int,route:int>>")).alias("ranges"))


def covered(ranges: pa.Array, units: np.ndarray, width: int) -> np.ndarray:
    """Mask of the units that some repeated window covers."""
    row, lo, hi, _ = flat_ranges(ranges)
    change = np.zeros(int(units[-1]) + 1, np.int64)
    np.add.at(change, units[row] + lo, 1)
    np.add.at(change, units[row] + hi + width, -1)
    return np.cumsum(change[:-1]) > 0
