"""Evaluation, fold and encoding queries over scored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from roadpulse.learning.encoders import cross_fitted_target_encoding, fit_target_encoding
from roadpulse.operators import evaluate, features, lookups, splits
from roadpulse.plans import oracle as o
from roadpulse.plans.base import planned, six, unplaced
from roadpulse.plans.registry import query
from roadpulse.session import prepare

# Scored incidents: stand-in forecasts against the recorded outcome, in five folds.
SCORED = """scored AS MATERIALIZED (SELECT id, CAST(substr(id, 4) AS BIGINT) % 5 + 1 AS fold, p50 AS predicted,
 duration_min AS actual, closure_p AS score, requires_road_closure AS label, event_cause FROM fc)"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planned(spark, sf_dir).select(
        "id", (F.substring("id", 4, 20).cast("bigint") % 5 + 1).alias("fold"), F.col("p50").alias("predicted"),
        F.col("duration_min").alias("actual"), F.col("closure_p").alias("score"),
        F.col("requires_road_closure").alias("label"), "event_cause")


@query("eval_regression", o.with_tables(
    """SELECT fold, count(*) AS n, round(avg(abs(predicted - actual)), 6) AS mae_minutes,
 round(median(abs(predicted - actual)), 6) AS median_ae_minutes,
 round(sqrt(avg(pow(ln(1 + predicted) - ln(1 + actual), 2))), 6) AS rmsle,
 round(avg(CASE WHEN greatest(predicted, actual) / greatest(least(predicted, actual), 1e-9) <= 2 THEN 1 ELSE 0 END), 6)
  AS within_2x FROM scored WHERE actual IS NOT NULL GROUP BY 1""", "fc", extra=SCORED))
def eval_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = evaluate.regression_metrics(scored(spark, sf_dir), ["fold"])
    return table.select("fold", "n", *[six(c).alias(c) for c in (
        "mae_minutes", "median_ae_minutes", "rmsle", "within_2x")])


_AUC = """SELECT {by}round((sum(CASE WHEN label = 1 THEN rk END) - p * (p + 1) / 2E0) / (p * n), 6) AS roc_auc FROM (
 SELECT {by}label, sum(label) OVER ({part}) AS p, sum(1 - label) OVER ({part}) AS n,
 rank() OVER ({part} ORDER BY score) + (count(*) OVER ({part2} score) - 1) / 2E0 AS rk FROM {table}) q
 GROUP BY {by}p, n"""


@query("roc_auc", o.with_tables(_AUC.format(
    by="fold, ", part="PARTITION BY fold", part2="PARTITION BY fold,", table="scored"), "fc", extra=SCORED))
def roc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.ranking_metrics(scored(spark, sf_dir), ["fold"]).select(
        "fold", six("roc_auc").alias("roc_auc"))


_AP = """SELECT {by}round(sum(pos * tp / (tp + fp)) / max(p), 6) AS average_precision FROM (
 SELECT {by}pos, CAST(sum(pos) OVER ({part} ORDER BY score DESC) AS DOUBLE) AS tp,
 CAST(sum(neg) OVER ({part} ORDER BY score DESC) AS DOUBLE) AS fp, CAST(sum(pos) OVER ({part}) AS DOUBLE) AS p
 FROM (SELECT {by}score, sum(label) AS pos, sum(1 - label) AS neg FROM {table} GROUP BY ALL) a) b {group}"""


@query("average_precision", o.with_tables(_AP.format(
    by="fold, ", part="PARTITION BY fold", table="scored", group="GROUP BY fold"), "fc", extra=SCORED))
def average_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.ranking_metrics(scored(spark, sf_dir), ["fold"]).select(
        "fold", six("average_precision").alias("average_precision"))


@query("accuracy", o.with_tables(
    """SELECT fold, count(*) AS n, round(avg(label), 6) AS positive_rate,
 round(avg(CASE WHEN (score >= 0.5E0) = (label = 1) THEN 1 ELSE 0 END), 6) AS accuracy FROM scored GROUP BY 1""",
    "fc", extra=SCORED))
def accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.accuracy(scored(spark, sf_dir), ["fold"]).select(
        "fold", "n", six("positive_rate").alias("positive_rate"), six("accuracy").alias("accuracy"))


_SWEEP = """sweep AS MATERIALIZED (SELECT 0.1E0 + 0.025E0 * i AS threshold,
 count(*) FILTER (WHERE label = 1 AND score >= 0.1E0 + 0.025E0 * i) AS tp,
 count(*) FILTER (WHERE label = 0 AND score >= 0.1E0 + 0.025E0 * i) AS fp,
 count(*) FILTER (WHERE label = 1 AND score < 0.1E0 + 0.025E0 * i) AS fn
 FROM scored, (SELECT unnest(range(33)) AS i) g GROUP BY i)"""


@query("f1_threshold_sweep", o.with_tables(
    """SELECT round(threshold, 6) AS threshold, tp, fp, fn,
 round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2E0 * tp / (2 * tp + fp + fn) END, 6) AS f1 FROM sweep""",
    "fc", extra=SCORED + ", " + _SWEEP))
def f1_threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.threshold_sweep(scored(spark, sf_dir), []).select(
        six("threshold").alias("threshold"), "tp", "fp", "fn", six("f1").alias("f1"))


@query("best_threshold", o.with_tables(
    """SELECT round(threshold, 6) AS threshold, round(2E0 * tp / (2 * tp + fp + fn), 6) AS f1 FROM sweep
 ORDER BY round(2E0 * tp / (2 * tp + fp + fn), 12) DESC, threshold LIMIT 1""",
    "fc", extra=SCORED + ", " + _SWEEP))
def best_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.best_threshold(scored(spark, sf_dir), []).select(
        six("threshold").alias("threshold"), six("f1").alias("f1"))


_REPORT = """c AS (SELECT count(*) FILTER (WHERE label = 1 AND score >= 0.5E0) AS tp,
 count(*) FILTER (WHERE label = 0 AND score >= 0.5E0) AS fp, count(*) FILTER (WHERE label = 1 AND score < 0.5E0) AS fn,
 count(*) FILTER (WHERE label = 0 AND score < 0.5E0) AS tn FROM scored),
 r AS (SELECT 'Routine' AS class, tn / (tn + fn) AS precision, tn / (tn + fp) AS recall,
  2 * tn / (2 * tn + fn + fp) AS f1, tn + fp AS support FROM c
 UNION ALL SELECT 'Major', tp / (tp + fp), tp / (tp + fn), 2 * tp / (2 * tp + fp + fn), tp + fn FROM c)"""


@query("classification_report", o.with_tables(
    """SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM (
 SELECT * FROM r UNION ALL
 SELECT 'accuracy', (tp + tn) / (tp + tn + fp + fn), (tp + tn) / (tp + tn + fp + fn), (tp + tn) / (tp + tn + fp + fn),
  tp + tn + fp + fn FROM c UNION ALL
 SELECT 'macro avg', avg(precision), avg(recall), avg(f1), CAST(sum(support) AS BIGINT) FROM r UNION ALL
 SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
  sum(f1 * support) / sum(support), CAST(sum(support) AS BIGINT) FROM r) q""",
    "fc", extra=SCORED + ", " + _REPORT))
def classification_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.classification_report(scored(spark, sf_dir), []).select(
        "class", *[six(c).alias(c) for c in ("precision", "recall", "f1")], "support")


@query("fold_summary", o.with_tables(
    """SELECT 'mae_minutes' AS metric, round(avg(m), 6) AS mean, round(stddev_pop(m), 6) AS std,
 string_agg(printf('%.4f', round_even(m, 4)), ',' ORDER BY fold) AS folds FROM (
 SELECT fold, avg(abs(predicted - actual)) AS m FROM scored WHERE actual IS NOT NULL GROUP BY 1) q""",
    "fc", extra=SCORED))
def fold_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    per_fold = evaluate.regression_metrics(scored(spark, sf_dir), ["fold"])
    return evaluate.fold_summary(per_fold, [], ["mae_minutes"]).select(
        "metric", six("mean").alias("mean"), six("std").alias("std"),
        F.array_join(F.transform("folds", lambda v: F.format_string("%.4f", v)), ",").alias("folds"))


@query("metric_gains", o.with_tables(
    """SELECT 'duration' AS model, 'mae_minutes' AS metric, round(b, 6) AS before, round(n, 6) AS now,
 round_even(b - n, 2) AS gain FROM (
 SELECT avg(abs(predicted - actual)) FILTER (WHERE fold <= 2) AS b,
  avg(abs(predicted - actual)) FILTER (WHERE fold > 2) AS n FROM scored) q
 UNION ALL SELECT 'closure', 'accuracy', round(b, 6), round(n, 6), round_even(n - b, 3) FROM (
 SELECT avg(CASE WHEN (score >= 0.5E0) = (label = 1) THEN 1 ELSE 0 END) FILTER (WHERE fold <= 2) AS b,
  avg(CASE WHEN (score >= 0.5E0) = (label = 1) THEN 1 ELSE 0 END) FILTER (WHERE fold > 2) AS n FROM scored) q""",
    "fc", extra=SCORED))
def metric_gains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Later folds as the new run, earlier folds as the run it is compared with."""
    def run(rows: DataFrame) -> DataFrame:
        errors = evaluate.regression_metrics(rows, []).select(
            F.lit("duration").alias("model"), F.lit("mae_minutes").alias("metric"),
            F.col("mae_minutes").alias("value"))
        return errors.unionByName(evaluate.accuracy(rows, []).select(
            F.lit("closure").alias("model"), F.lit("accuracy").alias("metric"), F.col("accuracy").alias("value")))

    rows = scored(spark, sf_dir)
    return evaluate.gains(run(rows.where("fold > 2")), run(rows.where("fold <= 2"))).select(
        "model", "metric", six("before").alias("before"), six("now").alias("now"), "gain")


# --- document labels as a second, real binary target --------------------------

_DOCS = """scored AS MATERIALIZED (SELECT toxic AS label, CAST(n_chars AS DOUBLE) / 65536E0 AS score
 FROM labels JOIN documents USING (doc_id))"""


@query("document_label_ranking", "WITH " + _DOCS + "SELECT roc_auc, average_precision FROM ("
       + _AUC.format(by="", part="", part2="PARTITION BY", table="scored") + ") a, ("
       + _AP.format(by="", part="", table="scored", group="") + ") b")
def document_label_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = prepare(spark).read
    rows = read.parquet(f"{sf_dir}/labels.parquet").join(
        read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "n_chars"), "doc_id")
    table = evaluate.ranking_metrics(rows.select(
        F.col("toxic").alias("label"), (F.col("n_chars") / F.lit(65536.0)).alias("score")), [])
    return table.select(six("roc_auc").alias("roc_auc"), six("average_precision").alias("average_precision"))


# --- folds and splits ----------------------------------------------------------

@query("folds_random", o.with_tables(
    "SELECT id, CAST(ntile(5) OVER (ORDER BY md5(concat(id, '#42'))) AS INT) AS fold FROM eng", "eng"))
def folds_random(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.random_folds(unplaced(spark, sf_dir).select("id")).select("id", "fold")


@query("folds_stratified", o.with_tables(
    """SELECT id, requires_road_closure, CAST(ntile(5) OVER (PARTITION BY requires_road_closure
 ORDER BY md5(concat(id, '#42'))) AS INT) AS fold FROM eng""", "eng"))
def folds_stratified(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = unplaced(spark, sf_dir).select("id", "requires_road_closure")
    return splits.random_folds(rows, stratify="requires_road_closure").select(
        "id", "requires_road_closure", "fold")


@query("folds_by_cut_points", o.with_tables(
    """SELECT id, requires_road_closure, CAST(ntile(5) OVER (PARTITION BY requires_road_closure
 ORDER BY md5(concat(id, '#42'))) AS INT) AS fold FROM eng""", "eng"))
def folds_by_cut_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folds from cut points of the hash order (see random_folds)."""
    rows = unplaced(spark, sf_dir).select("id", "requires_road_closure")
    return splits.random_folds(rows, stratify="requires_road_closure").select(
        "id", "requires_road_closure", "fold")


@query("holdout_split", o.with_tables(
    """SELECT id, CASE WHEN rn <= ceil(n * 0.2E0) THEN 'test' ELSE 'train' END AS part FROM (
 SELECT id, row_number() OVER (PARTITION BY requires_road_closure ORDER BY md5(concat(id, '#42'))) AS rn,
 count(*) OVER (PARTITION BY requires_road_closure) AS n FROM eng) q""", "eng"))
def holdout_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = unplaced(spark, sf_dir).select("id", "requires_road_closure")
    return splits.holdout_split(rows).select("id", "part")


@query("fold_temporal", o.with_tables(
    """SELECT id, CASE WHEN rn <= floor(n * 0.8E0) THEN 'train' ELSE 'test' END AS part FROM (
 SELECT id, row_number() OVER (ORDER BY start_datetime NULLS LAST, md5(concat(id, '#time'))) AS rn,
 count(*) OVER () AS n FROM eng) q""", "eng"))
def fold_temporal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.temporal_split(unplaced(spark, sf_dir).select("id", "start_datetime")).select("id", "part")


@query("fold_temporal_by_cut_point", o.with_tables(
    """SELECT id, CASE WHEN rn <= floor(n * 0.8E0) THEN 'train' ELSE 'test' END AS part FROM (
 SELECT id, row_number() OVER (ORDER BY start_datetime NULLS LAST, md5(concat(id, '#time'))) AS rn,
 count(*) OVER () AS n FROM eng) q""", "eng"))
def fold_temporal_by_cut_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.temporal_split(unplaced(spark, sf_dir).select("id", "start_datetime")).select("id", "part")


@query("folds_group", o.with_tables(
    """SELECT e.id, e.junction, CAST(CASE WHEN rn <= alone THEN rn
  WHEN (rn - 1 - alone) % (2 * (5 - alone)) < 5 - alone THEN alone + 1 + (rn - 1 - alone) % (2 * (5 - alone))
  ELSE alone + 2 * (5 - alone) - (rn - 1 - alone) % (2 * (5 - alone)) END AS INT) AS fold
 FROM eng e JOIN (SELECT *, count_if(rn < 5 AND n * (6 - rn) > total - before) OVER () AS alone FROM (
  SELECT *, sum(n) OVER () AS total, sum(n) OVER (ORDER BY rn) - n AS before FROM (
   SELECT junction, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, md5(concat(junction, '#group'))) AS rn
   FROM eng GROUP BY 1) a) b) g ON e.junction = g.junction""", "eng"))
def folds_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = unplaced(spark, sf_dir).select("id", "junction")
    return splits.group_folds(rows, "junction").select("id", "junction", "fold")


@query("exact_medians_by_descent", o.with_tables(
    """SELECT event_cause, round(median(duration_min), 6) AS median_duration FROM eng
 WHERE duration_min IS NOT NULL GROUP BY 1""", "eng"))
def exact_medians_by_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Medians from counted values and two cumulative sums."""
    table = lookups.median_duration_by_cause(unplaced(spark, sf_dir))
    return table.select("event_cause", six("median_duration").alias("median_duration"))


# --- target encoding ------------------------------------------------------------

_ENC = """stat AS MATERIALIZED (SELECT key, fold, count(*) AS n, CAST(sum(y) AS DOUBLE) AS s,
  CAST(sum(y * y) AS DOUBLE) AS q FROM te GROUP BY ALL),
 folds AS (SELECT DISTINCT fold FROM te),
 allk AS MATERIALIZED (SELECT f.fold AS held, s.key, sum(s.n) AS n, sum(s.s) AS s, sum(s.q) AS q
  FROM folds f JOIN stat s ON s.fold <> f.fold GROUP BY ALL),
 tot AS MATERIALIZED (SELECT held, sum(n) AS n, sum(s) AS s, sum(q) AS q FROM allk GROUP BY 1),
 enc AS MATERIALIZED (SELECT k.held, k.key, t.s / t.n AS prior,
  (k.s + m.m * t.s / t.n) / (k.n + m.m) AS encoded FROM allk k JOIN tot t ON k.held = t.held
  JOIN (SELECT a.held, a.key, CASE WHEN b.q / b.n - pow(b.s / b.n, 2) > 0
   THEN greatest(a.q / a.n - pow(a.s / a.n, 2), 0) / (b.q / b.n - pow(b.s / b.n, 2)) ELSE 0 END AS m
   FROM allk a JOIN tot b ON a.held = b.held) m ON m.held = k.held AND m.key = k.key)"""


@query("target_encoding_oof", o.with_tables(
    """SELECT te.id, round(coalesce(encoded, t.s / t.n), 6) AS encoded FROM te JOIN tot t ON te.fold = t.held
 LEFT JOIN enc ON te.fold = enc.held AND te.key = enc.key""", "eng",
    extra="""te AS MATERIALIZED (SELECT id, police_station AS key, requires_road_closure AS y,
 CAST(ntile(3) OVER (PARTITION BY requires_road_closure ORDER BY md5(concat(id, '#42'))) AS INT) AS fold FROM eng), """
    + _ENC))
def target_encoding_oof(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = unplaced(spark, sf_dir).select("id", "police_station", "requires_road_closure")
    folded = splits.random_folds(rows, 3, stratify="requires_road_closure")
    return cross_fitted_target_encoding(
        folded, {"police_station": "encoded"}, "requires_road_closure", "fold").select(
        "id", six("encoded").alias("encoded"))


@query("target_encoding_full", o.with_tables(
    """SELECT key, round((k.s + greatest(k.q / k.n - pow(k.s / k.n, 2), 0) / (t.q / t.n - pow(t.s / t.n, 2)) * t.s / t.n)
  / (k.n + greatest(k.q / k.n - pow(k.s / k.n, 2), 0) / (t.q / t.n - pow(t.s / t.n, 2))), 6) AS encoded FROM (
 SELECT junction AS key, count(*) AS n, sum(ln(1 + duration_min)) AS s, sum(pow(ln(1 + duration_min), 2)) AS q
 FROM eng WHERE duration_min IS NOT NULL GROUP BY 1) k, (
 SELECT count(*) AS n, sum(ln(1 + duration_min)) AS s, sum(pow(ln(1 + duration_min), 2)) AS q
 FROM eng WHERE duration_min IS NOT NULL) t""", "eng"))
def target_encoding_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = unplaced(spark, sf_dir).where(F.col("duration_min").isNotNull()).withColumn(
        "y", F.log1p("duration_min"))
    table = fit_target_encoding(rows, ["junction"], "y")
    return table.where(F.col("value").isNotNull()).select(
        F.col("value").alias("key"), six("encoded").alias("encoded"))
