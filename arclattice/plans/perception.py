"""Queries over labels, evaluation and the heuristic segmenter."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import RAW_TO_CLASS
from ..functions import labels
from ..operators import metrics, segment
from ..views import label_words, oracle, view

COLLAPSE_SQL_CASE = "CASE {raw} " + " ".join(f"WHEN {k} THEN {v}" for k, v in RAW_TO_CLASS.items()) + " ELSE -1 END"


def label_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = label_words(spark, sf_dir)
    return rows.groupBy(labels.raw_class().alias("raw_class"), labels.instance().alias("instance")).agg(F.count(F.lit(1)).alias("n"))


LABEL_SPLIT_SQL = oracle("label_words_v") + " SELECT CAST(word & 65535 AS INT) AS raw_class, CAST((word >> 16) & 65535 AS INT) AS instance, count(*) AS n FROM label_words_v GROUP BY ALL"


def class_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = label_words(spark, sf_dir).withColumn("raw_class", labels.raw_class() + F.when(F.col("l_linenumber") == 1, 300).otherwise(0))
    return rows.groupBy("raw_class", labels.collapse().alias("class_id")).agg(F.count(F.lit(1)).alias("n"))


COLLAPSE_SQL = oracle("label_words_v") + f""", r AS (SELECT CAST(word & 65535 AS INT) + CASE WHEN l_linenumber = 1 THEN 300 ELSE 0 END AS raw_class FROM label_words_v)
SELECT raw_class, {COLLAPSE_SQL_CASE.format(raw="raw_class")} AS class_id, count(*) AS n FROM r GROUP BY ALL"""


def scan_label_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points with the label of their place, -1 where a scan has none."""
    key = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    words = label_words(spark, sf_dir).filter("l_linenumber <= 3").groupBy(*key).agg(F.max("word").alias("word"))
    points = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(*key)
    both = points.join(words, key, "left").withColumn("class_id", F.coalesce(labels.collapse(labels.raw_class()), F.lit(-1)))
    both = both.withColumn("class_id", F.when(F.col("word").isNull(), -1).otherwise(F.col("class_id")))
    return both.groupBy("l_linenumber", "class_id").agg(F.count(F.lit(1)).alias("n"))


JOIN_SQL = oracle("label_words_v") + f""", w AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, max(word) AS word FROM label_words_v WHERE l_linenumber <= 3 GROUP BY ALL)
SELECT l_linenumber, CASE WHEN word IS NULL THEN -1 ELSE {COLLAPSE_SQL_CASE.format(raw="(word & 65535)")} END AS class_id, count(*) AS n
FROM lineitem LEFT JOIN w USING (l_orderkey, l_linenumber, l_partkey, l_suppkey) GROUP BY ALL"""


def height_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw classes by height alone; the chance of a car comes from the intensity here."""
    rows = view(spark, sf_dir, "points_v").withColumn("pred_raw", labels.height_band_class(chance=F.col("intensity")))
    return rows.groupBy("seq_id", "frame_id", "pred_raw").agg(F.count(F.lit(1)).alias("n"))


BAND_SQL = oracle("points_v") + """ SELECT seq_id, frame_id, CASE WHEN z >= -1 AND z < 1 AND sqrt(x*x+y*y) > 5 AND sqrt(x*x+y*y) < 30 AND intensity < 0.1::DOUBLE THEN 252
  WHEN z < -1.5 THEN 40 WHEN z >= -1.5 AND z < 3 THEN 50 ELSE 0 END AS pred_raw, count(*) AS n FROM points_v GROUP BY ALL"""


def logit_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best class of an array of scores, the first on ties."""
    scores = F.array(F.col("z"), F.col("intensity") * 0.1, F.lit(0.25), -F.col("z"))
    rows = view(spark, sf_dir, "points_v").select("seq_id", "frame_id", (F.array_position(scores, F.array_max(scores)) - 1).cast("int").alias("best"))
    return rows.groupBy("seq_id", "frame_id", "best").agg(F.count(F.lit(1)).alias("n"))


ARGMAX_SQL = oracle("points_v") + """ SELECT seq_id, frame_id, CAST(list_position(s, list_max(s)) - 1 AS INT) AS best, count(*) AS n
FROM (SELECT *, [z, intensity * 0.1::DOUBLE, 0.25::DOUBLE, -z] AS s FROM points_v) GROUP BY ALL"""


def judged(spark, sf_dir):
    return view(spark, sf_dir, "points_v").withColumnRenamed("class_id", "gt")


def miou(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.miou(judged(spark, sf_dir)).withColumn("iou", F.round("iou", 6))


def miou_by_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.miou_by_distance(judged(spark, sf_dir)).withColumn("iou", F.round("iou", 6))


def miou_by_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.miou(judged(spark, sf_dir), by=["seq_id", "frame_id"]).withColumn("iou", F.round("iou", 6))


def _iou_sql(by: str, n: int, rows: str) -> str:
    group = f"{by}, " if by else ""
    return oracle("points_v") + f""", j AS ({rows}), c AS (SELECT CAST(unnest(range({n})) AS INT) AS class_id),
g AS (SELECT {group}class_id, count(*) FILTER (pred = class_id AND gt = class_id) AS tp, count(*) FILTER (pred = class_id OR gt = class_id) AS un FROM j, c GROUP BY {group}class_id),
i AS (SELECT {group}class_id, CASE WHEN un = 0 THEN 0::DOUBLE ELSE tp / un END AS iou FROM g)
SELECT {group}class_id, round(iou, 6) AS iou FROM i UNION ALL SELECT {group}-1 AS class_id, round(sum(iou ORDER BY class_id) / {n}, 6) AS iou FROM i {"GROUP BY " + by if by else ""}"""


_J = "SELECT seq_id, frame_id, pred, class_id AS gt{more} FROM points_v WHERE class_id <> -1"
_B = _J.format(more=", CASE WHEN sqrt(x*x+y*y) < 10 THEN '0-10m' WHEN sqrt(x*x+y*y) < 30 THEN '10-30m' ELSE '30-100m' END AS bucket") + " AND sqrt(x*x+y*y) < 100"


def class_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.class_histogram(view(spark, sf_dir, "points_v"), ["seq_id"])


HISTOGRAM_SQL = oracle("points_v") + " SELECT seq_id, class_id, count(*) AS n FROM points_v GROUP BY ALL"

#: A plane for the queries, as the fitted one is drawn at random.
PLANE = (0.013, -0.021, 0.9997, 1.5)


def _plane_frames(spark, sf_dir):
    cols = {n: F.lit(v) for n, v in zip("abcd", PLANE, strict=True)}
    return view(spark, sf_dir, "frames_v").select("seq_id", "frame_id").withColumns(cols)


H_SQL = oracle("points_v") + f""", p AS (SELECT *, z + ({PLANE[0]}::DOUBLE * x + {PLANE[1]}::DOUBLE * y + {PLANE[3]}::DOUBLE) / {PLANE[2]}::DOUBLE AS h,
  CAST(least(greatest(floor((atan2(y, x) + pi()) / (2*pi()) * 24), 0), 23) AS INT) AS sector, CAST(least(greatest(floor(sqrt(x*x+y*y) / 2.5::DOUBLE), 0), 40) AS INT) AS r_bin FROM points_v)"""


def plane_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "points_v").join(_plane_frames(spark, sf_dir), ["seq_id", "frame_id"]).withColumn("h", segment.plane_height()).withColumns(segment.sector_and_bin())
    return rows.groupBy("seq_id", "frame_id", "sector").agg(F.count(F.lit(1)).alias("n"), F.round(F.min("h"), 6).alias("least"), F.round(F.avg("h"), 6).alias("mean"), F.max("r_bin").alias("last_bin"))


RESIDUAL_SQL = H_SQL + " SELECT seq_id, frame_id, sector, count(*) AS n, round(min(h), 6) AS least, round(avg(h), 6) AS mean, max(r_bin) AS last_bin FROM p GROUP BY ALL"


def low_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 35th percentile of z by frame and how many points lie at or below it."""
    rows = view(spark, sf_dir, "points_v")
    cut = rows.groupBy("seq_id", "frame_id").agg(F.percentile("z", F.lit(0.35)).alias("cut"))
    return rows.join(cut, ["seq_id", "frame_id"]).groupBy("seq_id", "frame_id").agg(F.round(F.first("cut"), 6).alias("cut"), F.count_if(F.col("z") <= F.col("cut") + 1e-9).alias("low"))


LOW_SQL = oracle("points_v") + """, c AS (SELECT seq_id, frame_id, quantile_cont(z, 0.35) AS cut FROM points_v GROUP BY ALL)
SELECT seq_id, frame_id, round(any_value(cut), 6) AS cut, count(*) FILTER (z <= cut + 1e-9) AS low FROM points_v JOIN c USING (seq_id, frame_id) GROUP BY seq_id, frame_id"""

PROFILE_SQL = H_SQL.replace("WITH ", "WITH RECURSIVE ") + """, n AS (SELECT seq_id, frame_id, sector, r_bin, quantile_cont(h, 0.10) AS low FROM p WHERE h >= -0.6 AND h <= 0.5 GROUP BY ALL HAVING count(*) >= 4),
s AS (SELECT DISTINCT seq_id, frame_id, sector FROM p),
b AS (SELECT s.*, CAST(k.r_bin AS INT) AS r_bin, n.low FROM s CROSS JOIN (SELECT unnest(range(41)) AS r_bin) k LEFT JOIN n ON n.seq_id = s.seq_id AND n.frame_id = s.frame_id AND n.sector = s.sector AND n.r_bin = k.r_bin),
w AS (SELECT seq_id, frame_id, sector, r_bin, CASE WHEN low IS NOT NULL AND abs(low) <= 0.8::DOUBLE THEN low ELSE 0 END AS "offset" FROM b WHERE r_bin = 0
  UNION ALL SELECT b.seq_id, b.frame_id, b.sector, b.r_bin, CASE WHEN b.low IS NOT NULL AND abs(b.low - w."offset") <= 0.8::DOUBLE THEN b.low ELSE w."offset" END
  FROM w JOIN b ON b.seq_id = w.seq_id AND b.frame_id = w.frame_id AND b.sector = w.sector AND b.r_bin = w.r_bin + 1)"""


def ground_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "points_v").join(_plane_frames(spark, sf_dir), ["seq_id", "frame_id"]).withColumn("h", segment.plane_height()).withColumns(segment.sector_and_bin())
    return segment.ground_profile(rows).withColumn("offset", F.round("offset", 6))


GROUND_SQL = PROFILE_SQL + ' SELECT seq_id, frame_id, sector, r_bin, round("offset", 6) AS "offset" FROM w'
LABELLED_SQL = PROFILE_SQL + """, q AS (SELECT p.*, p.h - w."offset" AS height FROM p JOIN w USING (seq_id, frame_id, sector, r_bin)),
t AS (SELECT *, max(height) OVER (PARTITION BY seq_id, frame_id, floor(x / 0.5), floor(y / 0.5)) AS column_top FROM q),
o AS (SELECT *, CASE WHEN height >= -0.28 AND height <= 0.22 AND abs(y) <= 4.2 AND height <= 0.12 THEN 0 WHEN height >= -0.28 AND height <= 0.22 THEN 1
  WHEN sqrt(x*x+y*y) >= 2.5 AND sqrt(x*x+y*y) <= 45 AND abs(y) <= 4.5 AND height >= 0.35 AND height <= 2.2 AND column_top <= 2.30 THEN 3 ELSE 2 END AS label FROM t)"""


def column_height(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = segment.heuristic_labels(view(spark, sf_dir, "points_v"), _plane_frames(spark, sf_dir))
    return rows.groupBy("seq_id", "frame_id", "sector").agg(F.round(F.max("column_top"), 6).alias("top"), F.round(F.avg("column_top"), 6).alias("mean_top"))


COLUMN_SQL = LABELLED_SQL + " SELECT seq_id, frame_id, sector, round(max(column_top), 6) AS top, round(avg(column_top), 6) AS mean_top FROM o GROUP BY ALL"


def heuristic_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = segment.heuristic_labels(view(spark, sf_dir, "points_v"), _plane_frames(spark, sf_dir))
    return rows.groupBy("seq_id", "frame_id", "label").agg(F.count(F.lit(1)).alias("n"))


LABELS_SQL = LABELLED_SQL + " SELECT seq_id, frame_id, label, count(*) AS n FROM o GROUP BY ALL"


def _scan(spark, sf_dir):
    rows = view(spark, sf_dir, "points_v")
    return rows.withColumn("point_id", F.row_number().over(Window.partitionBy("seq_id", "frame_id").orderBy("x", "y", "z", "intensity")).cast("long"))


def ransac_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.ground_planes(_scan(spark, sf_dir), seed=1)


def segmented_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole segmenter with fitted planes."""
    rows = segment.heuristic_labels(_scan(spark, sf_dir), seed=1)
    return rows.groupBy("seq_id", "frame_id", "label").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    "label_split": (label_split, LABEL_SPLIT_SQL),
    "class_collapse": (class_collapse, COLLAPSE_SQL),
    "scan_label_join": (scan_label_join, JOIN_SQL),
    "height_band_classes": (height_band, BAND_SQL),
    "logit_argmax": (logit_argmax, ARGMAX_SQL),
    "miou": (miou, _iou_sql("", 4, _J.format(more=""))),
    "miou_by_distance": (miou_by_distance, _iou_sql("bucket", 3, _B)),
    "miou_by_frame": (miou_by_frame, _iou_sql("seq_id, frame_id", 4, _J.format(more=""))),
    "class_histogram": (class_histogram, HISTOGRAM_SQL),
    "plane_residual": (plane_residual, RESIDUAL_SQL),
    "low_candidates": (low_candidates, LOW_SQL),
    "ground_profile": (ground_profile, GROUND_SQL),
    "column_height": (column_height, COLUMN_SQL),
    "heuristic_labels": (heuristic_labels, LABELS_SQL),
    "ransac_planes": (ransac_planes, None),
    "segmented_points": (segmented_points, None),
}
