"""Operator 2: approximate nearest neighbours by cross-polytope hashing.

Vectors are scaled to length one and turned by pseudo-rotations: three rounds of random
signs and a fast Hadamard transform. A table's hash is the nearest signed axis, the largest
coordinate with its sign. Every row is indexed in every table; a query probes, in each, its
``PROBES`` nearest axes. Rows and queries meet by (table, axis, salt); a bucket hands on its
best few candidates per query, never its pairs, and these are scored exactly again on the
original vectors in double precision.

Equal vectors are indexed once with their ``k`` + 1 smallest ids, which is exact: ties go
to smaller ids and a query excludes only itself. Vectors that are null, empty, zero, or hold
a null or a non-finite component take no part, nor does a null id; only vectors of the
query's own length are compared. Rows that repeat an id and vector count once. An empty
table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from roadpulse.session import settle

TABLES, PROBES, SALTS, MARGIN, SEED = 18, 4, 4, 4, 11
BLOCK = 4096


def hadamard(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of every row; the width is a power of two."""
    n, step = x.shape[1], 1
    while step < n:
        x = x.reshape(len(x), -1, 2, step)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(len(x), n)
        step *= 2
    return x


def axes(unit: np.ndarray, table: int, probes: int) -> np.ndarray:
    """The ``probes`` nearest signed axes (axis, or axis + width if negative), nearest first."""
    width = 1 << max(unit.shape[1] - 1, 1).bit_length()
    x = np.zeros((len(unit), width))
    x[:, :unit.shape[1]] = unit
    signs = np.random.default_rng([SEED, table]).choice([-1.0, 1.0], (3, width))
    for s in signs:
        x = hadamard(x * s)
    both = np.concatenate([x, -x], axis=1)
    probes = min(probes, both.shape[1])
    return np.argsort(-both, axis=1, kind="stable")[:, :probes]


def usable(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    v = F.col("v")
    rows = rows.select(F.col(vec_id).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return rows.where("id is not null and v is not null").where(F.coalesce(finite, F.lit(False)) & F.exists(v, lambda x: x != 0))


def cosine(a: Column, b: Column) -> Column:
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    norm = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x * x))
    return dot / (norm(a) * norm(b))


def _matrices(batch: pa.RecordBatch, column: int):
    """(row numbers, unit vectors) of the batch, for each vector length."""
    lists = batch.column(column)
    sizes = np.diff(lists.offsets.to_numpy())
    values, starts = lists.flatten().to_numpy(), np.cumsum(sizes) - sizes
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        x = values[starts[rows][:, None] + np.arange(size)]
        x = x / np.abs(x).max(axis=1, keepdims=True)
        yield rows, x / np.linalg.norm(x, axis=1, keepdims=True)


def _keyed(probes: int, as_query: bool, tables: int, salts: int):
    """Rows (key, query, node, width, unit vector) for each bucket a vector goes to or asks."""
    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(at, BLOCK)
                for rows, unit in _matrices(batch, 1):
                    node = batch.column(0).to_numpy()[rows]
                    vectors = pa.FixedSizeListArray.from_arrays(pa.array(unit.astype(np.float32).ravel()), unit.shape[1]).cast(
                        pa.list_(pa.float32()))
                    for table in range(tables):
                        near = axes(unit, table, probes)
                        code = (((unit.shape[1] << 12) + table) << 22) + near
                        salt = np.arange(salts) if as_query else None
                        for i in range(near.shape[1]):
                            for s in (salt if as_query else (node % salts,)):
                                yield pa.record_batch([pa.array(code[:, i] * salts + s), pa.array(np.full(len(node), 0 if as_query else 1, np.int8)),
                                                       pa.array(node), vectors], names=["key", "side", "node", "unit"])
    return run


def _best_of_buckets(keep: int):
    """Rows sorted by bucket, queries first: the best ``keep`` rows of the bucket per query."""
    def matrix(batch, a, b):
        lists = batch.column(3).slice(a, b - a)
        return lists.flatten().to_numpy().reshape(b - a, -1)

    def run(batches):
        key, queries, units, best_s, best_n = None, [], [], None, None

        def result():
            ids = np.concatenate(queries)
            q, r = np.nonzero(best_s > -np.inf)
            return pa.record_batch([pa.array(ids[q]), pa.array(best_n[q, r])], names=["query", "node"])
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, side, node = (batch.column(i).to_numpy() for i in range(3))
            cuts = np.flatnonzero((np.diff(keys, prepend=keys[0] - 1) != 0) | (np.diff(side, prepend=side[0]) != 0)).tolist()
            for a, b in zip(cuts, [*cuts[1:], batch.num_rows]):
                if keys[a] != key:
                    if best_s is not None:
                        yield result()
                    key, queries, units, best_s = keys[a], [], [], None
                if side[a] == 0:
                    queries.append(node[a:b])
                    units.append(matrix(batch, a, b))
                elif queries:
                    q = np.concatenate(units)
                    if best_s is None:
                        best_s, best_n = np.full((len(q), keep), -np.inf), np.zeros((len(q), keep), np.int64)
                    for i in range(a, b, BLOCK):
                        j = min(i + BLOCK, b)
                        s = np.concatenate([best_s, q @ matrix(batch, i, j).T], axis=1)
                        n = np.concatenate([best_n, np.broadcast_to(node[i:j], (len(q), j - i))], axis=1)
                        top = np.argpartition(-s, min(keep, s.shape[1] - 1), axis=1)[:, :keep]
                        best_s, best_n = np.take_along_axis(s, top, 1), np.take_along_axis(n, top, 1)
        if best_s is not None:
            yield result()
    return run


def nearest(rows: DataFrame, queries: Column, k: int = 5, tables: int = TABLES, probes: int = PROBES) -> DataFrame:
    """query_id, rank, vec_id, score: for every row that ``queries`` marks its k nearest found.

    ``rows`` has vec_id and embedding; ``queries`` is a condition on the column id.
    """
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    members = settle(usable(rows).distinct(), "vectors")
    node = F.xxhash64("v")
    nodes = settle(members.select("v").distinct().select(node.alias("node"), "v"), "nodes")
    asking = members.where(queries).select("id", "v")
    asked = settle(asking.select(node.alias("node"), "v").distinct(), "queries")
    schema = "key bigint, side tinyint, node bigint, unit array<float>"
    index = nodes.select("node", "v").mapInArrow(_keyed(1, False, tables, SALTS), schema)
    probing = asked.mapInArrow(_keyed(probes, True, tables, SALTS), schema)
    met = index.unionByName(probing).repartition(n, "key").sortWithinPartitions("key", "side")
    pairs = met.mapInArrow(_best_of_buckets(k + 1 + MARGIN), "query bigint, node bigint").distinct()
    left = asked.select(F.col("node").alias("query"), F.col("v").alias("qv"))
    right = nodes.select("node", "v")
    scored = pairs.join(left, "query").join(right, "node").select("query", "node", cosine(F.col("qv"), F.col("v")).alias("score"))
    # k + 1 nodes hold the k nearest rows beside the query itself; equal scores stay together
    few = scored.withColumn("place", F.rank().over(W.partitionBy("query").orderBy(F.desc("score")))).where(F.col("place") <= k + 1)
    small = members.withColumn("node", node).withColumn("at", F.row_number().over(W.partitionBy("node").orderBy("id"))).where(
        F.col("at") <= k + 1).select("node", "id")
    options = few.join(small, "node").select("query", F.col("id").alias("vec_id"), "score")
    wanted = asking.select(F.col("id").alias("query_id"), node.alias("query")).join(options, "query").where("query_id != vec_id")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return wanted.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
