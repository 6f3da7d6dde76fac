"""Learned features and models.

Held-out runs and cross-validation are whole: default sizes, every model, scheme and fold. The
other queries that fit models show their jobs with small learner sizes (``QUICK``).
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame, SparkSession, functions as F

from roadpulse.learning import encoders, validation
from roadpulse.learning.builder import FeatureBuilder
from roadpulse.learning.calibration import IsotonicMaps
from roadpulse.learning.forecaster import Forecaster
from roadpulse.learning.preprocessor import Preprocessor
from roadpulse.learning.settings import LearnerSettings, QUICK
from roadpulse.learning.targets import LABEL, TARGETS, TargetModel, labelled
from roadpulse.learning.text_vectors import TextVectors, TfIdf, vocabulary
from roadpulse.operators import dispatch, evaluate, features
from roadpulse.plans import oracle as o
from roadpulse.plans.base import engineered, raw_incidents, six
from roadpulse.plans.registry import query
from roadpulse.plans.stream_queries import feed_stream, history_tables, replay
from roadpulse.session import concurrently, prepare, scratch_path, settle, spread
from roadpulse.sources import fixture
from roadpulse.streaming import jobs

_GRAMS = f"""words AS (SELECT doc_id, concat(' ', unnest(regexp_extract_all(lower(text), '{o.BLANK_FREE}')), ' ') AS w
  FROM documents),
 grams AS MATERIALIZED (SELECT doc_id, term, count(*) AS n FROM (SELECT doc_id, unnest(list_concat(
   list_transform(range(1, length(w) - 1), lambda i: substr(w, i, 3)),
   list_transform(range(1, length(w) - 2), lambda i: substr(w, i, 4)))) AS term FROM words) q GROUP BY ALL),
 vocab AS MATERIALIZED (SELECT term, CAST(sum(n) AS BIGINT) AS tf, count(*) AS df FROM grams GROUP BY 1
  HAVING count(*) >= 8 ORDER BY tf DESC, term LIMIT 3000)"""


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


@query("text_vocabulary", "WITH " + _GRAMS + " SELECT term, tf, df FROM vocab")
def text_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocabulary(_documents(spark, sf_dir), "text")


@query("tfidf_vectors", "WITH " + _GRAMS + """,
 weighted AS MATERIALIZED (SELECT doc_id, n * (ln((1 + (SELECT count(*) FROM documents)) / (1 + df)) + 1) AS w
  FROM grams JOIN vocab USING (term))
 SELECT doc_id, coalesce(k, 0) AS terms, round(coalesce(total, 0E0), 5) AS weight_sum,
 round(coalesce(top, 0E0), 5) AS weight_max FROM documents LEFT JOIN (
 SELECT doc_id, count(*) AS k, sum(w) / sqrt(sum(w * w)) AS total, max(w) / sqrt(sum(w * w)) AS top
 FROM weighted GROUP BY 1) q USING (doc_id)""")
def tfidf_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of every document over the learned vocabulary, summed up per document."""
    docs = _documents(spark, sf_dir)
    weights = TfIdf.fit(docs, "text").transform(docs, "text", "v").select(
        "doc_id", F.unwrap_udt("v")["values"].alias("w"))
    return weights.select(
        "doc_id", F.size("w").cast("bigint").alias("terms"),
        F.round(F.aggregate("w", F.lit(0.0), lambda a, x: a + x), 5).alias("weight_sum"),
        F.round(F.coalesce(F.array_max("w"), F.lit(0.0)), 5).alias("weight_max"))


@query("tfidf_svd", None)
def tfidf_svd(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = settle(_documents(spark, sf_dir), "documents")
    vectors = TextVectors.fit(docs, "text")
    return vectors.transform(docs, "text", "scores").select(
        "doc_id", F.transform("scores", lambda x: F.round(x, 4)).alias("scores"))


@query("kmeans_cluster", None)
def kmeans_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Location clusters, their size and the density joined back to the rows."""
    rows = settle(engineered(spark, sf_dir), "engineered")
    builder = FeatureBuilder.fit(rows)
    return builder.transform(rows).groupBy("cluster_id").agg(
        F.count(F.lit(1)).alias("events"), F.max("cluster_density").alias("cluster_density"),
        six(F.avg("latitude")).alias("latitude"), six(F.avg("longitude")).alias("longitude"))


@query("feature_vectors", None)
def feature_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-hot, target-encoded, text and numeric inputs assembled per row."""
    rows = settle(engineered(spark, sf_dir), "engineered")
    built = FeatureBuilder.fit(rows).transform(rows)
    frame = settle(features.model_frame(labelled(built, "closure"), "id", LABEL), "frame")
    prep = Preprocessor.fit(frame, LABEL, False, LearnerSettings())
    return prep.transform(frame, "id").select(
        "id", F.size(vector_to_array("features")).alias("width"))


_LOW = ("event_type", "event_cause", "veh_type", "zone", "is_corridor", "long_lived_cause")


@query("category_vectors", o.with_tables("""SELECT id, sizes.width, string_agg(CAST(base + position AS VARCHAR), ',' ORDER BY no) AS positions
 FROM cells JOIN dict USING (no, value) JOIN bases USING (no), sizes GROUP BY ALL""", "eng", extra="""
 cells AS MATERIALIZED (SELECT id, unnest([1, 2, 3, 4, 5, 6]) AS no, unnest([""" + ", ".join(_LOW) + """]) AS value FROM eng),
 vals AS (SELECT no, value, count(*) AS n FROM cells GROUP BY ALL),
 own AS (SELECT no, value, row_number() OVER (PARTITION BY no ORDER BY md5(value)) - 1 AS position FROM vals WHERE n >= 10),
 dict AS MATERIALIZED (SELECT * FROM own UNION ALL SELECT no, value, (SELECT count(*) FROM own WHERE own.no = vals.no)
  FROM vals WHERE n < 10),
 bases AS MATERIALIZED (SELECT no, w, CAST(sum(w) OVER (ORDER BY no) - w AS BIGINT) AS base
  FROM (SELECT no, max(position) + 1 AS w FROM dict GROUP BY 1) q),
 sizes AS (SELECT CAST(sum(w) AS INT) AS width FROM bases)"""))
def category_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Non-zero positions of the assembled one-hot vectors (all their values are 1)."""
    frame = engineered(spark, sf_dir).select("id", *_LOW)
    table = encoders.fit_dictionary(frame, list(_LOW))
    sizes = encoders.dictionary_sizes(table, list(_LOW))
    index, hot = ({c: f"{c}_{kind}" for c in _LOW} for kind in ("index", "hot"))
    placed = encoders.apply_dictionary(frame, table, index, sizes)
    vectors = VectorAssembler(inputCols=list(hot.values()), outputCol="v").transform(
        encoders.one_hot(spark, sizes, index, hot).transform(placed))
    parts = vectors.select("id", F.unwrap_udt("v").alias("v"))
    # few positions make a dense vector
    dense = F.filter(F.transform("v.values", lambda x, i: F.when(x != 0, i)), lambda i: i.isNotNull())
    return parts.select("id", F.coalesce("v.size", F.size("v.values")).alias("width"),
                        F.array_join(F.coalesce("v.indices", dense), ",").alias("positions"))


@query("calibrated_scores", o.with_tables("""SELECT s AS score, count(*) AS n, CAST(sum(y) AS BIGINT) AS hits,
 round(avg(mean), 6) AS calibrated, round(avg(p), 6) AS held_out
 FROM pts JOIN (SELECT s, avg(p) AS mean FROM iso GROUP BY 1) m USING (s) JOIN iso USING (s, fold) GROUP BY 1""", "fc", extra="""
 pts AS MATERIALIZED (SELECT floor(closure_p * 10E0) / 10E0 AS s, requires_road_closure AS y,
  CAST(concat('0x', substr(md5(id), 1, 4)) AS INT) % 3 + 1 AS fold FROM fc),
 bins AS (SELECT m AS fold, s, sum(y) AS y, count(*) AS n FROM pts, (SELECT unnest([1, 2, 3]) AS m) q WHERE fold <> m GROUP BY ALL),
 cum AS MATERIALIZED (SELECT *, row_number() OVER w AS i, sum(y) OVER w AS cy, sum(n) OVER w AS cn FROM bins
  WINDOW w AS (PARTITION BY fold ORDER BY s)),
 seg AS (SELECT a.fold, a.i AS i, b.i AS j, CAST(b.cy - a.cy + a.y AS DOUBLE) / (b.cn - a.cn + a.n) AS v
  FROM cum a JOIN cum b ON a.fold = b.fold AND a.i <= b.i),
 least AS (SELECT c.fold, c.s, seg.i, min(v) AS v FROM cum c JOIN seg ON seg.fold = c.fold AND c.i BETWEEN seg.i AND seg.j GROUP BY ALL),
 iso AS MATERIALIZED (SELECT fold, s, max(v) AS p FROM least GROUP BY ALL)"""))
def calibrated_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three isotonic maps of stand-in closure scores, averaged, and each row by the map that has not seen it."""
    rows = fixture.pseudo_forecasts(engineered(spark, sf_dir)).select(
        (F.floor(F.col("closure_p") * 10.0) / 10.0).alias("score"), F.col("requires_road_closure").alias("y"),
        (F.conv(F.substring(F.md5("id"), 1, 4), 16, 10).cast("int") % 3 + 1).alias("fold"))
    rows = settle(rows, "stand-in-scores")
    maps = IsotonicMaps.fit(rows, "score", "y", "fold")
    both = maps.held_out(maps.transform(rows, "score", "mean"), "score", "fold", "p")
    return both.groupBy("score").agg(
        F.count(F.lit(1)).alias("n"), F.sum("y").cast("bigint").alias("hits"),
        six(F.avg("mean")).alias("calibrated"), six(F.avg("p")).alias("held_out"))


@query("train_forecast", None)
def train_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out run: fit on 80 %, forecast and plan the rest (predictions table)."""
    return validation.heldout_run(raw_incidents(spark, sf_dir))[0]


@query("heldout_scorecard", None)
def heldout_scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.heldout_run(raw_incidents(spark, sf_dir))[1].withColumn("value", six("value"))


@query("cross_validation", None)
def cross_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three schemes for each of the three models: five folds, the temporal one its single cut."""
    rows = settle(engineered(spark, sf_dir), "engineered")
    parts = []
    for target in TARGETS:      # the schemes of a model overlap, and the folds within them
        parts += concurrently(spark, *[
            lambda s=s: validation.cross_validate(rows, target, s) for s in ("random", "temporal", "group")])
    return reduce(DataFrame.unionByName, parts)


@query("permutation_importance", None)
def permutation_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = settle(engineered(spark, sf_dir), "engineered")
    built = settle(FeatureBuilder.fit(rows, restarts=QUICK.cluster_restarts).transform(rows), "built")
    model = TargetModel.fit(built, "closure", QUICK)
    return evaluate.top_importances(validation.permutation_importance(built, model, repeats=1))


@query("tuned_parameters", None)
def tuned_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeded random search of the ridge penalty on the log duration."""
    rows = settle(engineered(spark, sf_dir), "engineered")
    built = FeatureBuilder.fit(rows, restarts=QUICK.cluster_restarts).transform(rows)
    frame = spread(settle(features.model_frame(labelled(built, "duration"), "id", LABEL), "frame"))
    ready = settle(Preprocessor.fit(frame, LABEL, True, QUICK).transform(frame, LABEL), "features")
    best, score = validation.tune(
        LinearRegression(featuresCol="features", labelCol=LABEL), validation.LINEAR_SPACE,
        RegressionEvaluator(labelCol=LABEL, metricName="mae"), ready, n=4)
    return spark.createDataFrame([(k, float(v), float(score)) for k, v in best.items()],
                                 "parameter string, value double, mae double")


@query("stream_forecasts", None)
def stream_forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A saved and reloaded forecaster scoring new arrivals of a stream."""
    history, rows = history_tables(spark, sf_dir)
    fitted = Forecaster.fit(settle(rows, "engineered"), features.CoordinateMedians.fit(history), QUICK)
    home, path, out, checkpoint = (scratch_path(spark, n) for n in ("forecaster", "feed", "orders", "checkpoint"))
    fitted.save(spark, home)
    forecaster = Forecaster.load(spark, home)
    cells = dispatch.station_cells(dispatch.station_directory(rows))
    arrived = jobs.arrivals(feed_stream(history, path))
    replay(history, path, lambda: jobs.start_orders(
        arrived, forecaster.forecast, lambda: cells, out, checkpoint, per_tick=15), deliveries=1)
    return spark.read.parquet(out).select("order_id", "police_station", "impact_score", "severity_band", "manpower")
