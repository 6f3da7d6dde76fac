"""Helpers shared by the operators of this folder.

Texts travel to Python in Arrow batches. Work is cut into pieces of a few megabytes
of text (a longer document is a piece of its own), so memory in a task follows the
longest document, never the partition or the table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

PIECE_BYTES = 1 << 19
NULL_ID = np.iinfo(np.int64).min  # a null doc_id sorts before every other id
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_and_text(docs: DataFrame, *more: Column) -> DataFrame:
    """Only the two columns that count, and ``more``; a null text is an empty one."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"),
                       F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def partitions_for(df: DataFrame, per_gb: int = 0) -> int:
    """Shuffle partitions for a shuffle of about the size of the input."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def in_share(key: Column, share: float) -> Column:
    """Rows of a hash sample: exact to 1e-18 of a share, so that no table is too large for it."""
    million = F.pmod(key, F.lit(1_000_000))
    finer = F.pmod(F.shiftright(key, 20), F.lit(10 ** 12)) / F.lit(1e12)
    bound = share * 1e6
    whole = int(bound)
    return (million < whole) | ((million == whole) & (finer < bound - whole))


def free_names(names: list[str], taken: list[str]) -> dict[str, str]:
    """Each of ``names``, with underscores behind it while a column has that name already."""
    used, out = {c.lower() for c in taken}, {}
    for name in names:
        free = name
        while free.lower() in used:
            free += "_"
        used.add(free.lower())
        out[name] = free
    return out


def lower_ascii(column: Column) -> Column:
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def pieces(batches: Iterable[pa.RecordBatch], limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches into runs of rows with about ``limit`` bytes of text.

    The text (or binary) is the column named ``text``.
    """
    for batch in batches:
        if batch.num_rows == 0:
            continue
        ends = np.cumsum(lengths(batch.column(batch.schema.get_field_index("text"))))
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(int(np.searchsorted(ends, before + limit, side="right")), start + 1)
            yield batch.slice(start, stop - start)
            start = stop


def lengths(column: pa.Array) -> np.ndarray:
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64, count=len(column) + 1 + column.offset)
    return np.diff(offsets[column.offset:])


def flat_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column in one array, and the rows' offsets (n + 1)."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64, count=len(column) + 1 + column.offset)[column.offset:]
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)[offsets[0]:offsets[-1]]
    return data, offsets - offsets[0]


def ids_of(column: pa.Array) -> np.ndarray:
    return column.fill_null(NULL_ID).to_numpy(zero_copy_only=False)


def in_pieces(work: Callable[[pa.RecordBatch], pa.RecordBatch], limit: int = PIECE_BYTES):
    """A ``mapInArrow`` function that applies ``work`` to every piece."""
    def run(batches):
        for piece in pieces(batches, limit):
            yield work(piece)
    return run


# --- hashing of byte and word strings -------------------------------------------------

_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mix(x: np.ndarray) -> np.ndarray:
    """Invertible scrambling of 64-bit numbers (the usual xor-shift-multiply finish)."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX[0]
    x ^= x >> np.uint64(27)
    x *= _MIX[1]
    x ^= x >> np.uint64(31)
    return x


class Rolling:
    """Hash of any slice of a sequence of 64-bit symbols in constant time.

    Prefix sums of ``symbol * base**i`` modulo 2**64; a slice's difference of sums is
    brought back to exponent 0 with the inverse powers.
    """

    BASE = 0x9E3779B97F4A7C15 | 1
    _powers: np.ndarray = np.ones(1, np.uint64)
    _inverse: np.ndarray = np.ones(1, np.uint64)

    @classmethod
    def _grow(cls, n: int) -> None:
        if len(cls._powers) < n:
            size = max(n, 1 << 20)
            for name, base in (("_powers", cls.BASE), ("_inverse", pow(cls.BASE, -1, 1 << 64))):
                steps = np.full(size, np.uint64(base & (2 ** 64 - 1)))
                steps[0] = 1
                setattr(cls, name, np.multiply.accumulate(steps))

    def __init__(self, symbols: np.ndarray):
        self._grow(len(symbols) + 1)
        self.sums = np.zeros(len(symbols) + 1, np.uint64)
        np.cumsum(symbols * self._powers[:len(symbols)], out=self.sums[1:])

    def slices(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix((self.sums[stop] - self.sums[start]) * self._inverse[start] + (stop - start).astype(np.uint64))

    def windows(self, width: int) -> np.ndarray:
        """Hashes of all slices of one width."""
        n = len(self.sums) - width
        if n <= 0:
            return np.zeros(0, np.uint64)
        return mix((self.sums[width:] - self.sums[:n]) * self._inverse[:n] + np.uint64(width))


BYTE_SYMBOLS = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and stop of every word of the concatenated texts, and its row.

    Words are maximal runs of bytes other than the six ASCII white spaces; they never
    cross rows.
    """
    ink = ~SPACES[data]
    before = np.zeros(len(data) + 1, bool)
    before[1:] = ink
    before[offsets] = False
    starts = np.flatnonzero(ink & ~before[:-1])
    after = np.zeros(len(data) + 1, bool)
    after[:-1] = ink
    after[offsets] = False
    stops = np.flatnonzero(ink & ~after[1:]) + 1
    return starts, stops, np.searchsorted(offsets, starts, side="right") - 1
