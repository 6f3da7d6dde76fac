"""Forecast quality over a scored table, per any grouping columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window as W, functions as F

from roadpulse.functions import numeric
from roadpulse.operators.medians import medians_by
from roadpulse.operators.ranking import running_totals
from roadpulse.operators.selection import same_keys

# Coarse to fine score buckets; each splits its parent into 4096 at most.
SCORE_SCALES = (2.0 ** 12, 2.0 ** 24, 2.0 ** 36)

# Fixed grid of operating thresholds: 0.1, 0.125, ... 0.9.
THRESHOLDS = tuple(0.1 + 0.025 * i for i in range(33))


def _join(frames: list[DataFrame], by: list[str]) -> DataFrame:
    def two(a: DataFrame, b: DataFrame) -> DataFrame:
        if not by:  # one row each
            return a.withColumns({c: b.select(c).scalar() for c in b.columns if c not in a.columns})
        renamed = b.withColumnsRenamed({k: f"_r_{k}" for k in by})
        return a.join(renamed, same_keys([(k, f"_r_{k}") for k in by])).drop(*[f"_r_{k}" for k in by])
    return reduce(two, frames)


def regression_metrics(scored: DataFrame, by: list[str], predicted: str = "predicted",
                       actual: str = "actual", **options) -> DataFrame:
    """Mean and median absolute error (minutes), log error and share within a factor 2."""
    p, t = F.col(predicted), F.col(actual)
    rows = scored.where(p.isNotNull() & t.isNotNull()).select(
        *by, p.alias("_p"), t.alias("_t"), F.abs(p - t).alias("_e"))
    plain = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("_e").alias("mae_minutes"),
        F.sqrt(F.avg(F.pow(F.log1p("_p") - F.log1p("_t"), 2.0))).alias("rmsle"),
        F.avg((numeric.fold_ratio(F.col("_p"), F.col("_t")) <= 2.0).cast("int")).alias("within_2x"))
    middle = medians_by(rows.select(*by, "_e"), by, {"median_ae_minutes": "_e"}, **options)
    return _join([plain, middle], by)


def ranking_metrics(scored: DataFrame, by: list[str], score: str = "score",
                    label: str = "label") -> DataFrame:
    """ROC-AUC (ties averaged) and step-wise average precision.

    Rows collapse to one per distinct score first; the running counts then come
    from bucketed prefix sums, never from one ordered task.
    """
    s = F.col(score).cast("double")
    tally = scored.where(s.isNotNull() & F.col(label).isNotNull()).groupBy(*by, s.alias("_s")).agg(
        F.sum(F.col(label).cast("bigint")).alias("_pos"),
        F.sum((F.lit(1) - F.col(label)).cast("bigint")).alias("_neg"))
    buckets = {f"_b{i}": F.floor(F.col("_s") * F.lit(k)).cast("bigint") for i, k in enumerate(SCORE_SCALES)}
    run = running_totals(tally.withColumns(buckets), by, list(buckets), ["_s"],
                         {"_tp": F.col("_pos"), "_fp": F.col("_neg")})
    below = F.col("_fp") - F.col("_neg")
    above_tp = F.col("_tp_all") - F.col("_tp") + F.col("_pos")
    above_fp = F.col("_fp_all") - F.col("_fp") + F.col("_neg")
    sums = run.groupBy(*by).agg(
        F.sum(F.col("_pos") * (below + F.col("_neg") / 2)).alias("_wins"),
        F.sum(F.col("_pos") * above_tp / (above_tp + above_fp)).alias("_steps"),
        F.first("_tp_all").alias("positives"), F.first("_fp_all").alias("negatives"))
    return sums.select(
        *by, "positives", "negatives",
        F.try_divide(F.col("_wins"), F.col("positives") * F.col("negatives").cast("double")).alias("roc_auc"),
        F.try_divide(F.col("_steps"), F.col("positives").cast("double")).alias("average_precision"))


def accuracy(scored: DataFrame, by: list[str], score: str = "score", label: str = "label",
             cut: float = 0.5) -> DataFrame:
    hit = (F.col(score) >= cut).cast("int") == F.col(label)
    return scored.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col(label)).alias("positive_rate"),
        F.avg(hit.cast("int")).alias("accuracy"))


def classification_metrics(scored: DataFrame, by: list[str], score: str = "score",
                           label: str = "label") -> DataFrame:
    return _join([accuracy(scored, by, score, label),
                  ranking_metrics(scored, by, score, label).drop("positives", "negatives")], by)


def threshold_sweep(scored: DataFrame, by: list[str], score: str = "score",
                    label: str = "label") -> DataFrame:
    """F1 at each of the 33 thresholds.

    A row only needs the number of thresholds it reaches; counting rows per number
    (34 groups) and summing from the top gives every confusion matrix in one pass.
    """
    grid = F.array(*[F.lit(t) for t in THRESHOLDS])
    reached = F.size(F.filter(grid, lambda t: F.col(score) >= t))
    cells = scored.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(
        *by, reached.alias("_k")).agg(
        F.sum(F.col(label).cast("bigint")).alias("_pos"),
        F.sum((F.lit(1) - F.col(label)).cast("bigint")).alias("_neg"))
    # a row reaching k thresholds is predicted positive at thresholds 1..k
    spread = cells.select(
        *by, "_pos", "_neg", "_k",
        F.posexplode(grid).alias("_i", "threshold"))
    hit = F.col("_k") > F.col("_i")
    counts = spread.groupBy(*by, "threshold").agg(
        F.sum(F.when(hit, F.col("_pos")).otherwise(0)).alias("tp"),
        F.sum(F.when(hit, F.col("_neg")).otherwise(0)).alias("fp"),
        F.sum(F.when(hit, F.lit(0)).otherwise(F.col("_pos"))).alias("fn"))
    f1 = F.try_divide(F.col("tp") * 2.0, F.col("tp") * 2 + F.col("fp") + F.col("fn"))
    return counts.withColumn("f1", F.coalesce(f1, F.lit(0.0)))


def best_threshold(scored: DataFrame, by: list[str], score: str = "score",
                   label: str = "label") -> DataFrame:
    """Threshold with the highest F1, the lowest one on a tie."""
    sweep = threshold_sweep(scored, by, score, label)
    key = F.struct(F.bround("f1", 12).alias("f1"), (-F.col("threshold")).alias("t"))
    top = sweep.groupBy(*by).agg(F.max(key).alias("_top"))
    return top.select(*by, (-F.col("_top.t")).alias("threshold"), F.col("_top.f1").alias("f1"))


def classification_report(scored: DataFrame, by: list[str], score: str = "score",
                          label: str = "label", cut: float = 0.5,
                          names: tuple[str, str] = ("Routine", "Major")) -> DataFrame:
    """Precision, recall, F1 and support per class, plus accuracy, macro and weighted rows."""
    y, p = F.col(label), (F.col(score) >= cut).cast("int")
    c = scored.where(F.col(score).isNotNull() & y.isNotNull()).groupBy(*by).agg(
        F.count_if((p == 1) & (y == 1)).alias("tp"), F.count_if((p == 1) & (y == 0)).alias("fp"),
        F.count_if((p == 0) & (y == 1)).alias("fn"), F.count_if((p == 0) & (y == 0)).alias("tn"))
    zero = F.lit(0.0)

    def ratio(a, b):
        return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), zero)

    def per_class(hit: str, wrong: str, missed: str) -> dict:
        h, w, m = F.col(hit), F.col(wrong), F.col(missed)
        return {"precision": ratio(h, h + w), "recall": ratio(h, h + m),
                "f1": ratio(h * 2, h * 2 + w + m), "support": h + m}

    neg, pos = per_class("tn", "fn", "fp"), per_class("tp", "fp", "fn")
    n = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    acc = ratio(F.col("tp") + F.col("tn"), n)
    measures = ("precision", "recall", "f1")
    macro = {m: (neg[m] + pos[m]) / 2 for m in measures}
    weighted = {m: ratio(neg[m] * neg["support"] + pos[m] * pos["support"], n) for m in measures}

    def line(name: str, values: dict, support) -> F.Column:
        return F.struct(F.lit(name).alias("class"), *[values[m].alias(m) for m in measures],
                        support.alias("support"))

    table = F.array(line(names[0], neg, neg["support"]), line(names[1], pos, pos["support"]),
                    line("accuracy", dict.fromkeys(measures, acc), n),
                    line("macro avg", macro, n), line("weighted avg", weighted, n))
    return c.select(*by, F.explode(table).alias("_l")).select(*by, "_l.*")


def fold_summary(per_fold: DataFrame, by: list[str], metrics: list[str], fold: str = "fold") -> DataFrame:
    """Mean, population deviation and the fold values (4 decimals) of each metric."""
    long = per_fold.select(*by, fold, F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"))
        for m in metrics])).alias("_m")).select(*by, fold, "_m.*").where(F.col("value").isNotNull())
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(fold, F.bround("value", 4).alias("v")))),
                          lambda s: s["v"])
    return long.groupBy(*by, "metric").agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), ordered.alias("folds"))


def gains(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """Improvement over an earlier run; ``(model, metric, value)`` tables.

    Error metrics improve downwards, all others upwards.
    """
    side = baseline.withColumnRenamed("value", "before")
    lower_is_better = F.col("metric").isin("median_ae_minutes", "mae_minutes", "rmsle")
    return current.join(side, ["model", "metric"]).select(
        "model", "metric", "before", F.col("value").alias("now"),
        F.when(lower_is_better, F.bround(F.col("before") - F.col("value"), 2))
        .otherwise(F.bround(F.col("value") - F.col("before"), 3)).alias("gain"))


def top_importances(table: DataFrame, n: int = 15) -> DataFrame:
    """The ``n`` most important features of each model."""
    order = W.partitionBy("model").orderBy(F.desc("importance"), "feature")
    return (table.withColumn("position", F.row_number().over(order)).where(F.col("position") <= n)
            .withColumn("importance", F.bround("importance", 5)))
