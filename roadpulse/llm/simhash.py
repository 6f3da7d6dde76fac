"""Operator 8: SimHash near-duplicates by deletion-variant signatures.

Two fingerprints that differ in at most two bits agree in the low half but for at most one
bit, or in the whole high half. Every distinct fingerprint is indexed under 33 variants: the
low half with each bit as wildcard, and the high half. An equality shuffle brings sharers of
a variant together; pairs are verified on all 64 bits and each is linked under one variant
only. Where more than ``CROWD`` fingerprints share a variant no pairs are formed: members
also have to agree in one of three pieces of the other half. Where that still leaves a
crowd, its members are indexed under their 2016 two-wildcard variants of the whole
fingerprint. Sharers of such a variant differ
only in the two bits, so they all link, at most four share one, and a chain over them
links them whole. Documents meet their fingerprint's component by a join; equal
fingerprints (exact copies) are one node throughout.

Inputs: rows with doc_id and text; other columns are ignored. A null or wordless text has
fingerprint zero. A null doc_id gets a fingerprint and is linked, but is never a
component's name; a component of null ids only has the name null. Repeated rows give
repeated results. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from roadpulse.llm.common import id_and_text, pieces
from roadpulse.llm.graph import components
from roadpulse.session import settle

CROWD = 64
_SEED = 42
_HALF = np.uint64(0xFFFFFFFF)


def _fingerprints(texts: list[bytes]) -> np.ndarray:
    hashes, counts = [], []
    for text in texts:
        words = text.lower().split()
        n = len(words)
        if n < 3:
            counts.append(1 if n else 0)
            if n:
                hashes.append(xxhash.xxh64_intdigest(b" ".join(words), _SEED))
            continue
        joined = b" ".join(words)
        stops = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
        starts = [0, *stops[:-3].tolist()]
        counts.append(n - 2)
        hashes += [xxhash.xxh64_intdigest(joined[a:b], _SEED) for a, b in zip(starts, (stops[2:] - 1).tolist())]
    bits = np.unpackbits(np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    n = np.array(counts, np.int64)
    out = np.zeros((len(texts), 64), np.uint8)
    some = np.flatnonzero(n)
    if len(some):
        sums = np.add.reduceat(bits, (np.cumsum(n) - n)[some], axis=0, dtype=np.int64)
        out[some] = 2 * sums > n[some, None]
    return np.packbits(out, axis=1, bitorder="little").view(np.uint64).ravel()


def fingerprints(docs: DataFrame, **carried: Column) -> DataFrame:
    """(doc_id, fp, carried string columns): the fingerprint's 64 bits as a signed number."""
    names = ["doc_id", "fp", *carried]

    def run(batches):
        for piece in pieces(batches):
            texts = piece.column(1).cast(pa.large_binary()).to_pylist()
            yield pa.record_batch([piece.column(0), pa.array(_fingerprints(texts).view(np.int64)), *piece.columns[2:]], names=names)
    schema = "doc_id bigint, fp bigint" + "".join(f", {name} string" for name in carried)
    return id_and_text(docs, *[c.alias(name) for name, c in carried.items()]).mapInArrow(run, schema)


def _links(a, b, crowded):
    return pa.record_batch([pa.array(a), pa.array(b), pa.array(np.full(len(a), crowded))], names=["a", "b", "crowded"])


def _variant_of(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The one variant under which a pair within two bits is linked (it may share more)."""
    low = (a ^ b).view(np.uint64) & _HALF
    place = np.bitwise_count((low & (~low + np.uint64(1))) - np.uint64(1)).astype(np.int64)
    return np.where(low == 0, 0, np.where(np.bitwise_count(low) == 1, place, 32))


def _piece_of(a: np.ndarray, b: np.ndarray, free: np.ndarray) -> np.ndarray:
    """The first of the three pieces of the half at bit ``free`` in which the two agree."""
    x = ((a ^ b).view(np.uint64) >> free) & _HALF
    return np.where((x & np.uint64(0x7FF)) == 0, 0, np.where((x >> np.uint64(11) & np.uint64(0x7FF)) == 0, 1, 2))


def _variants(batches):
    """33 keys a fingerprint: the low half under each wildcard bit, and the high half whole."""
    bit = np.uint64(1) << np.arange(32, dtype=np.uint64)
    number = np.arange(33, dtype=np.uint64) << np.uint64(32)
    for batch in batches:
        fps = batch.column(0).to_numpy().view(np.uint64)
        for part in np.array_split(fps, max(1, len(fps) // 20000)):
            key = np.concatenate([part[:, None] & _HALF & ~bit, part[:, None] >> np.uint64(32)], axis=1) | number
            yield pa.record_batch([pa.array(key.ravel().view(np.int64)), pa.array(np.repeat(part, 33).view(np.int64))], names=["key", "fp"])


def _pieces(batches):
    """Three keys for a member of a crowded variant: a piece of the half that is still free."""
    for batch in batches:
        fp, key = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy().view(np.uint64)
        half = (fp >> _free_bit(key)) & _HALF
        # variant (39 bits), piece (2), its value (11)
        keys = [(key << np.uint64(13)) | (np.uint64(i) << np.uint64(11)) | (half >> np.uint64(11 * i) & np.uint64(0x7FF)) for i in range(3)]
        yield pa.record_batch([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.tile(fp, 3).view(np.int64))], names=["key", "fp"])


def _free_bit(key: np.ndarray) -> np.ndarray:
    return np.where(key >> np.uint64(32) == 32, np.uint64(0), np.uint64(32))


def _meet(second: bool):
    """Groups of equal key: the verified links of small ones, the members of crowded ones."""
    def run(batches):
        parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
        if not parts:
            return
        key, fp = (np.concatenate(c) for c in zip(*parts))
        order = np.lexsort((fp, key))
        key, fp = key[order], fp[order]
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(start, append=len(key))
        after = np.repeat(start + size, size) - np.arange(len(key))  # rows left in the group, this one included
        left = np.flatnonzero((after > 1) & np.repeat(size <= CROWD, size))
        step = 1
        while len(left):
            a, b, k = fp[left], fp[left + step], key[left].view(np.uint64)
            variant = (k >> np.uint64(13) if second else k) >> np.uint64(32)
            good = (np.bitwise_count((a ^ b).view(np.uint64)) <= 2) & (a != b) & (_variant_of(a, b) == variant)
            if second:
                good &= _piece_of(a, b, _free_bit(k >> np.uint64(13))) == (k >> np.uint64(11) & np.uint64(3))
            if good.any():
                yield _links(a[good], b[good], False)
            step += 1
            left = left[after[left] > step]
        crowd = np.repeat(size > CROWD, size)
        if crowd.any():
            yield _links(fp[crowd], key[crowd], True)
    return run


def _two_wildcards(batches):
    i, j = np.triu_indices(64, 1)
    mask = (np.uint64(1) << i.astype(np.uint64)) | (np.uint64(1) << j.astype(np.uint64))
    pair = np.arange(len(mask), dtype=np.int64)
    for batch in batches:
        fps = batch.column(0).to_numpy().view(np.uint64)
        for part in np.array_split(fps, max(1, len(fps) // 500)):
            yield pa.record_batch([pa.array((part[:, None] & ~mask).ravel().view(np.int64)), pa.array(np.repeat(part, len(mask)).view(np.int64)),
                                   pa.array(np.tile(pair, len(part)).astype(np.int16))], names=["rest", "fp", "pair"])


def _chains(batches):
    """Sharers of a two-wildcard variant all link: a chain over at most four."""
    parts = [[c.to_numpy() for c in b.columns] for b in batches if b.num_rows]
    if not parts:
        return
    rest, fp, pair = (np.concatenate(c) for c in zip(*parts))
    order = np.lexsort((fp, rest, pair))
    rest, fp, pair = rest[order], fp[order], pair[order]
    same = np.flatnonzero((rest[:-1] == rest[1:]) & (pair[:-1] == pair[1:]) & (fp[:-1] != fp[1:]))
    if len(same):
        yield _links(fp[same], fp[same + 1], False)


def links(fps: DataFrame) -> DataFrame:
    """(a, b): links of distinct fingerprints that connect all within two bits."""
    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema, keyed = "a bigint, b bigint, crowded boolean", "key bigint, fp bigint"
    first = settle(fps.mapInArrow(_variants, keyed).repartition(n, "key").mapInArrow(_meet(False), schema), "links")
    closer = first.where("crowded").select("a", "b").mapInArrow(_pieces, keyed).repartition(n, "key")
    second = settle(closer.mapInArrow(_meet(True), schema), "links")
    crowd = second.where("crowded").select(F.col("a").alias("fp")).distinct()
    two = crowd.mapInArrow(_two_wildcards, "rest bigint, fp bigint, pair smallint").repartition(n, "rest", "pair")
    return first.unionByName(second).where("not crowded").unionByName(two.mapInArrow(_chains, schema)).select("a", "b")


def near_duplicates(docs: DataFrame, **carried: Column) -> DataFrame:
    """(doc_id, fingerprint, component_id, label, carried string columns) for every row.

    ``fingerprint`` is 16 lowercase hex digits, ``component_id`` the smallest doc_id that
    is reachable over links, ``label`` names the component also where ids are null.
    """
    rows = settle(fingerprints(docs, **carried), "fingerprints")
    distinct = rows.groupBy("fp").agg(F.min("doc_id").alias("first"))
    labels = components(links(distinct.select("fp")))
    named = distinct.join(labels, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("label", "fp").alias("label"))
    named = settle(named, "labels")
    least = named.groupBy("label").agg(F.min("first").alias("component_id")).withColumnRenamed("label", "k")
    known = named.join(least, F.col("label") == F.col("k")).select(F.col("fp").alias("k_fp"), "component_id", "label")
    return rows.join(known, F.col("fp") == F.col("k_fp"), "left").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "label", *carried)


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: one row of each component.

    It is the first by doc_id (null after all others), fingerprint, text hash and hash of
    the other columns; rows equal in all of them are one row repeated. Rows that share an
    id but not a component do not compete.
    """
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    text_key = F.md5(F.coalesce("text", F.lit("")))
    rest_key = F.md5(F.to_json(F.struct(*others))) if others else F.lit("")
    rows = near_duplicates(docs, text_key=text_key, rest_key=rest_key)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "fingerprint", "text_key", "rest_key"))
    kept = rows.groupBy("label").agg(first.alias("row")).select(
        F.col("row.doc_id").alias("k_id"), F.col("row.text_key").alias("k_text"), F.col("row.rest_key").alias("k_rest"))
    # the whole row travels as one column, so no name of docs can clash
    keyed = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("bigint").alias("id"),
                        text_key.alias("text_key"), rest_key.alias("rest_key"))
    same = F.col("id").eqNullSafe(F.col("k_id")) & (F.col("text_key") == F.col("k_text")) & (F.col("rest_key") == F.col("k_rest"))
    return keyed.join(kept, same, "left_semi").dropDuplicates(["id", "text_key", "rest_key"]).select("row.*")
