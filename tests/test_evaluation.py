"""Exact medians, splits, encoders and metrics against brute force."""

from __future__ import annotations

import math
import random
import statistics

import pytest
from pyspark.sql import Window as W, functions as F

from roadpulse.learning import encoders
from roadpulse.operators import evaluate, medians, ranking, selection, splits


def test_medians_with_a_dominant_group_and_ties(spark):
    draw = random.Random(1)
    rows = [("hot", draw.choice([7.5, draw.uniform(0.5, 4320)])) for _ in range(501)]
    rows += [("even", 1.0), ("even", 2.0), ("one", 3.25), (None, 4.0), (None, 5.0), ("none", None), ("even", math.nan)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r["k"]: r["m"] for r in medians.medians_by(df, ["k"], {"m": "v"}).collect()}
    want = {k: statistics.median([v for g, v in rows if g == k and v is not None and not math.isnan(v)]) for k in ("hot", "even", "one", None)}
    assert got == {**want, "none": None}


def test_median_without_keys(spark):
    df = spark.createDataFrame([(12.61,), (12.97,), (13.01,), (12.97,)], "v double")
    got = medians.medians_by(df, [], {"a": "v", "b": "v"}).first()
    assert got["a"] == got["b"] == 12.97


@pytest.mark.parametrize("sketch", [64, selection.SKETCH])
def test_ranks_through_brackets(spark, monkeypatch, sketch):
    """Groups beyond the sketch size: brackets around several shares, a value with a third of the rows, equal order keys."""
    monkeypatch.setattr(selection, "SKETCH", sketch)
    monkeypatch.setattr(selection, "MARGIN", selection.MARGIN if sketch > 64 else 0.25)
    draw = random.Random(4)
    rows = [("big", draw.choice([5, draw.randint(-10 ** 6, 10 ** 6), draw.randint(-10 ** 6, 10 ** 6)])) for _ in range(9000)]
    rows += [("small", v) for v in range(7)] + [("one", 3), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v bigint").repartition(3)
    shares = [0.2, 0.4, 0.6, 0.8]
    ranks = F.array(*[F.ceil(F.col("_all") * F.lit(s)).cast("bigint") for s in shares])
    groups, found = selection.ranked_values(df, ["k"], F.floor(F.col("v") / 10), F.col("v"), shares, ranks)
    got = {(r["k"], r["i"]): r["value"] for r in found.collect()}
    for name in ("big", "small", "one"):
        own = sorted(v for k, v in rows if k == name)
        assert [got[name, i] for i in range(4)] == [own[math.ceil(len(own) * s) - 1] for s in shares]
    assert {r["k"]: r["_all"] for r in groups.collect()} == {"big": 9000, "small": 7, "one": 1, "none": 0}


def test_group_folds_with_many_groups_and_a_hot_one(spark):
    rows = [("hot",)] * 15_000 + [(None,)] * 300 + [(f"g{i}",) for i in range(20_000) for _ in range(1 + i % 2)]
    df = spark.createDataFrame(rows, "g string")
    folds = splits.group_folds(df, "g").groupBy("g", "fold").count().collect()
    assert len(folds) == 20_002 and sum(r["count"] for r in folds) == len(rows)   # a group has one fold
    load = {}
    for r in folds:
        load[r["fold"]] = load.get(r["fold"], 0) + r["count"]
    alone = next(r["fold"] for r in folds if r["g"] == "hot")
    rest = [n for f, n in load.items() if f != alone]
    assert load[alone] == 15_000 and len(rest) == 4 and max(rest) - min(rest) <= 300


def test_group_folds_with_fewer_groups_than_folds(spark):
    df = spark.createDataFrame([("a",)] * 5 + [("b",)] * 2 + [(None,)], "g string")
    got = {r["g"]: r["fold"] for r in splits.group_folds(df, "g").collect()}
    assert len(set(got.values())) == 3 and set(got.values()) <= set(range(1, 6))
    assert splits.group_folds(df.where("false"), "g").count() == 0


def scored(spark, rows):
    return spark.createDataFrame(rows, "score double, label int")


def brute_auc(rows):
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def brute_ap(rows):
    total, out, last = sum(y for _, y in rows), 0.0, 0.0
    for t in sorted({s for s, _ in rows}, reverse=True):
        hit = [y for s, y in rows if s >= t]
        recall = sum(hit) / total
        out += (recall - last) * sum(hit) / len(hit)
        last = recall
    return out


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_ranking_metrics(spark, seed):
    draw = random.Random(seed)
    rows = [(draw.choice([0.25, round(draw.random(), 2), draw.random() * 1e-9]), draw.randint(0, 1)) for _ in range(300)]
    got = evaluate.ranking_metrics(scored(spark, rows), []).first()
    assert got["roc_auc"] == pytest.approx(brute_auc(rows)) and got["average_precision"] == pytest.approx(brute_ap(rows))


def test_ranking_edges(spark):
    equal = evaluate.ranking_metrics(scored(spark, [(0.5, 1), (0.5, 0), (0.5, 0)]), []).first()
    assert equal["roc_auc"] == 0.5 and equal["average_precision"] == pytest.approx(1 / 3)
    perfect = evaluate.ranking_metrics(scored(spark, [(0.9, 1), (0.1, 0)]), []).first()
    assert perfect["roc_auc"] == 1.0 and perfect["average_precision"] == 1.0
    assert evaluate.ranking_metrics(scored(spark, [(0.9, 1)]), []).first()["roc_auc"] is None


def test_threshold_first_maximum_wins(spark):
    rows = [(0.9, 1), (0.8, 1), (0.2, 0), (0.15, 0)]
    best = evaluate.best_threshold(scored(spark, rows), []).first()
    assert best["f1"] == 1.0 and best["threshold"] == pytest.approx(0.225)


def table(spark, n):
    draw = random.Random(5)
    rows = [(f"e{i}", None if draw.random() < 0.3 else 1_700_000_000 + draw.randint(0, 50), int(draw.random() < 0.2))
            for i in range(n)]
    return spark.createDataFrame(rows, "id string, t long, y int").withColumn(
        "start_datetime", F.timestamp_seconds("t")).drop("t")


def windows(df):
    """The definitions as plain windows."""
    h = lambda seed: ranking.shuffle_key(F.col("id"), seed)
    group = W.partitionBy("y").orderBy(h(42))
    size = F.count(F.lit(1)).over(W.partitionBy("y"))
    time = W.orderBy(F.asc_nulls_last("start_datetime"), h("time"))
    return (df.select("id", F.ntile(5).over(group)), df.select("id", F.ntile(3).over(W.orderBy(h(42)))),
            df.select("id", F.when(F.row_number().over(group) <= F.ceil(size * 0.2), "test").otherwise("train")),
            df.select("id", F.when(F.row_number().over(time) <= F.floor(F.count(F.lit(1)).over(W.partitionBy()) * 0.8), "train").otherwise("test")))


@pytest.mark.parametrize("n", [7, 400])
def test_cut_points_equal_windows(spark, n):
    df = table(spark, n).cache()
    found = (splits.random_folds(df, 5, stratify="y").select("id", "fold"), splits.random_folds(df, 3).select("id", "fold"),
             splits.holdout_split(df, 0.2, stratify="y").select("id", "part"), splits.temporal_split(df, 0.8).select("id", "part"))
    for got, want in zip(found, windows(df)):
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_rows_without_a_key_share_a_fold(spark):
    df = spark.createDataFrame([(None, True)] * 40 + [(f"e{i}", True) for i in range(200)], "id string, y boolean")
    got = splits.random_folds(df, 5)
    assert got.count() == 240 and got.where("id is null").select("fold").distinct().count() == 1
    assert splits.holdout_split(df, 0.2, stratify="y").where("id is null").select("part").distinct().count() == 1


def test_copies_of_one_key_stay_whole(spark):
    df = spark.createDataFrame([("same",)] * 300 + [(f"e{i}",) for i in range(600)], "id string")
    got = splits.random_folds(df, 5)
    assert got.count() == 900
    assert got.where("id = 'same'").select("fold").distinct().count() == 1


def test_group_folds(spark):
    rows = [(f"{g}-{i}", g) for g, n in (("a", 50), ("b", 30), ("c", 25), ("d", 10), ("e", 5)) for i in range(n)]
    got = splits.group_folds(spark.createDataFrame(rows, "id string, g string"), "g", 2)
    folds = {r["g"]: r["fold"] for r in got.select("g", "fold").distinct().collect()}
    # there and back by falling size: no list of groups is held, so the dealing is not greedy any more
    assert folds == {"a": 1, "b": 2, "c": 2, "d": 1, "e": 1} and got.count() == len(rows)
    many = splits.group_folds(spark.createDataFrame(rows, "id string, g string"), "id", 2)   # any number of groups
    assert sorted(r["count"] for r in many.groupBy("fold").count().collect()) == [60, 60]


def brute_encoding(train, key):
    ys = [y for _, y in train]
    mean, var = statistics.fmean(ys), statistics.pvariance(ys)
    mine = [y for k, y in train if k == key]
    if not mine:
        return mean
    m = statistics.pvariance(mine) / var if var else 0.0
    return (sum(mine) + m * mean) / (len(mine) + m)


def test_target_encoding(spark):
    draw = random.Random(3)
    rows = [(i, draw.choice("aabbc"), draw.random(), i % 3) for i in range(60)] + [(60, "once", 1.0, 0)]
    df = spark.createDataFrame(rows, "i int, k string, y double, fold int")
    got = encoders.cross_fitted_target_encoding(df, {"k": "e"}, "y", "fold").collect()
    assert len(got) == len(rows)
    for r in got:
        train = [(k, y) for _, k, y, f in rows if f != r["fold"]]
        assert r["e"] == pytest.approx(brute_encoding(train, r["k"]))
    fitted = encoders.fit_target_encoding(df, ["k"], "y")
    fresh = spark.createDataFrame([("a",), ("unseen",), (None,)], "k string")
    whole = [(k, y) for _, k, y, _ in rows]
    for r in encoders.apply_target_encoding(fresh, fitted, {"k": "e"}).collect():
        assert r["e"] == pytest.approx(brute_encoding(whole, r["k"]))


def test_rare_values_share_a_position(spark):
    df = spark.createDataFrame([("a",)] * 12 + [("b",)] * 10 + [("c",), ("d",), (None,)], "c string")
    table = encoders.fit_dictionary(df, ["c"], 10)
    sizes = encoders.dictionary_sizes(table, ["c", "never"])
    assert sizes == {"c": 3, "never": 1}
    asked = spark.createDataFrame([("a",), ("b",), ("c",), ("d",), ("new",), (None,)], "c string")
    placed = encoders.apply_dictionary(asked, table, {"c": "i"}, {"c": 3})
    hot = encoders.one_hot(spark, {"c": 3}, {"c": "i"}, {"c": "v"}).transform(placed)
    got = {r["c"]: (int(r["i"]), r["v"].toArray().tolist()) for r in hot.collect()}
    assert {got["a"][0], got["b"][0]} == {0, 1} and got["c"][0] == got["d"][0] == 2
    assert all(v[at] == 1 and sum(v) == 1 for at, v in (got[x] for x in "abcd"))
    assert got["new"] == got[None] == (3, [0.0, 0.0, 0.0])


def test_dictionary_of_many_values(spark):
    many = spark.range(20_000).select(F.explode(F.array_repeat(F.concat(F.lit("v"), "id"), 2)).alias("c"))
    table = encoders.fit_dictionary(many.unionByName(spark.range(9).select(F.concat(F.lit("w"), "id").alias("c"))), ["c"], 2)
    own = table.where("NOT rare")
    assert own.agg(F.count("*"), F.countDistinct("position"), F.max("position")).first() == (20_000, 20_000, 19_999)
    assert [r[0] for r in table.where("rare").select("position").distinct().collect()] == [20_000]
    assert encoders.fit_dictionary(many.limit(0), ["c"], 2).count() == 0



def test_regression_metrics(spark):
    pairs = [(10.0, 20.0), (30.0, 31.0), (5.0, 50.0), (7.0, None)]
    got = evaluate.regression_metrics(spark.createDataFrame(pairs, "p double, t double"), [], "p", "t").first()
    known = [(p, t) for p, t in pairs if t is not None]
    assert got["n"] == 3 and got["mae_minutes"] == pytest.approx(statistics.fmean(abs(p - t) for p, t in known))
    assert got["median_ae_minutes"] == 10.0 and got["within_2x"] == pytest.approx(2 / 3)
    assert got["rmsle"] == pytest.approx(math.sqrt(statistics.fmean((math.log1p(p) - math.log1p(t)) ** 2 for p, t in known)))
