"""Operator 7: mixing sources to target weights by temperature.

A source with token share p gets weight p**t, normalised. The exponent t is found by
bisection on many exponents at once, so that the weights' entropy reaches a target or the
most repeated source stays within a repetition limit. Weights become integer token budgets;
a source is read in whole epochs and one last partial one. Each epoch is a permutation of
the source's blocks (hash groups of documents) and of the documents in a block. Only where
the last epoch stops is searched for: rows then compare their own keys with that place, so
texts are never shuffled and a source with a third of all rows is spread over its blocks.

Inputs: documents with doc_id, text, source; a null source is a source of its own, a null
or wordless text has no tokens and goes with the first epoch. Repeated rows count
repeatedly and stop together. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from roadpulse.llm.common import WORD, free_names
from roadpulse.session import settle

BLOCKS = 4096
_GRID = 33


def token_count() -> Column:
    return F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("bigint")


def _shares(sources: DataFrame, exponents: list[float]) -> DataFrame:
    """Per exponent the weights' entropy and the rate of the most repeated source.

    Budgets give every source at least one epoch, so that rate is the largest over the
    smallest ratio of weight to share.
    """
    e = F.explode(F.array(*[F.lit(float(x)) for x in exponents])).alias("t")
    rows = sources.where("p > 0").select("p", e).withColumn("w", F.pow("p", F.col("t"))).withColumn("r", F.pow("p", F.col("t") - 1))
    return rows.groupBy("t").agg(F.sum("w").alias("z"), F.sum(F.col("w") * F.ln("p")).alias("s"),
                                 F.max("r").alias("most"), F.min("r").alias("least")).select(
        "t", (F.ln("z") - F.col("t") * F.col("s") / F.col("z")).alias("entropy"), (F.col("most") / F.col("least")).alias("rate"),
        "z", "least")


def find_exponent(sources: DataFrame, target_entropy: float | None, repetition_limit: float | None, rounds: int = 6) -> float:
    """The smallest exponent in 0..1 with entropy at most the target and repetition within the limit.

    Both fall as the exponent grows, so the interval that holds the border shrinks by a
    factor of 32 a round; every round is one aggregation over the table of sources.
    """
    low, high = 0.0, 1.0
    for _ in range(rounds):
        grid = [low + (high - low) * i / (_GRID - 1) for i in range(_GRID)]
        rows = sorted(_shares(sources, grid).collect(), key=lambda r: r["t"])
        if not rows:
            return 1.0
        fits = [r["t"] for r in rows if (target_entropy is None or r["entropy"] <= target_entropy)
                and (repetition_limit is None or r["rate"] <= repetition_limit)]
        high = fits[0] if fits else 1.0
        if high == rows[0]["t"]:
            return high
        low = max(r["t"] for r in rows if r["t"] < high)
    return high


def budgets(docs: DataFrame, target_entropy: float | None = None, repetition_limit: float | None = None) -> DataFrame:
    """(source, tokens, weight, budget, epochs, rest): what every source contributes.

    The total is the smallest that gives every source a whole epoch, so no document is lost.
    """
    totals = settle(docs.groupBy("source").agg(F.sum("tokens").alias("tokens")), "sources")
    whole = totals.agg(F.sum("tokens").alias("t")).first()["t"] or 0
    sources = settle(totals.withColumn("p", F.col("tokens") / F.lit(float(max(whole, 1)))), "shares")
    exponent = find_exponent(sources, target_entropy, repetition_limit)
    z, least = next(((r["z"], r["least"]) for r in _shares(sources, [exponent]).collect()), (1.0, 1.0))
    weight = F.when(F.col("p") > 0, F.pow("p", F.lit(exponent)) / F.lit(z)).otherwise(F.lit(0.0))
    budget = F.greatest(F.round(F.pow("p", F.lit(exponent)) / F.lit(least)* F.lit(float(whole))).cast("bigint"), F.col("tokens"))
    budget = F.when(F.col("tokens") > 0, budget).otherwise(F.lit(0))
    return sources.withColumn("weight", weight).withColumn("budget", budget).withColumn(
        "epochs", F.when(F.col("tokens") > 0, F.expr("budget div tokens")).otherwise(F.lit(1)).cast("int")).withColumn(
        "rest", F.when(F.col("tokens") > 0, F.expr("budget % tokens")).otherwise(F.lit(0)))


def _keys(df: DataFrame, epoch: Column, seed: int) -> DataFrame:
    return df.withColumn("block_key", F.xxhash64(F.lit(seed), epoch, "block")).withColumn(
        "doc_key", F.xxhash64(F.lit(seed), epoch, "doc_id", F.hash("text")))


def mix(docs: DataFrame, target_entropy: float | None = None, repetition_limit: float | None = None, seed: int = 17) -> DataFrame:
    """``docs`` with a row per copy: n_tokens, epoch (from 0), block, block_key and doc_key added.

    Where ``docs`` has such a name itself, its column stays and the added one gets an
    underscore behind its name.
    Reading order is by epoch, block_key, doc_key within a source.
    """
    rows = docs.select("doc_id", "text", "source", token_count().alias("tokens"),
                       F.pmod(F.xxhash64(F.lit(seed), "doc_id", F.hash("text")), F.lit(BLOCKS)).cast("int").alias("block"),
                       F.struct(*[F.col(c) for c in docs.columns]).alias("row"))
    shares = settle(budgets(rows.select("source", "tokens"), target_entropy, repetition_limit).select(
        F.col("source").alias("k"), "epochs", "rest"), "budgets")
    same = F.col("source").eqNullSafe(F.col("k"))
    last = _keys(rows.select("doc_id", "text", "source", "tokens", "block").join(shares, same), F.col("epochs"), seed).select(
        "source", "tokens", "block", "block_key", "doc_key", "rest").where("rest > 0")
    last = settle(last, "keys")
    blocks = last.groupBy("source", "block", "block_key").agg(F.sum("tokens").alias("n")).withColumn(
        "before", F.sum("n").over(W.partitionBy("source").orderBy("block_key", "block")) - F.col("n"))
    blocks = blocks.select(F.col("source").alias("b_source"), F.col("block").alias("b_block"), "before")
    inside = F.sum("tokens").over(W.partitionBy("source", "block").orderBy("doc_key"))
    reached = last.withColumn("inside", inside).join(
        blocks, F.col("source").eqNullSafe(F.col("b_source")) & (F.col("block") == F.col("b_block"))).where("before + inside <= rest")
    stops = reached.groupBy("source").agg(F.max(F.struct("block_key", "block", "doc_key")).alias("stop")).select(
        F.col("source").alias("s"), "stop")
    known = settle(shares.join(stops, F.col("k").eqNullSafe(F.col("s")), "left").select("k", "epochs", "stop"), "stops")
    copies = rows.join(known, same).withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("epochs"))))
    keyed = _keys(copies, F.col("epoch"), seed)
    taken = (F.col("epoch") < F.col("epochs")) | F.coalesce(F.struct("block_key", "block", "doc_key") <= F.col("stop"), F.lit(False))
    added = free_names(["n_tokens", "epoch", "block", "block_key", "doc_key"], docs.columns)
    return keyed.where(taken).withColumnRenamed("tokens", "n_tokens").select(
        "row.*", *[F.col(name).alias(free) for name, free in added.items()])
