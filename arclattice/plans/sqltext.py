"""Queries written as SQL text with the registered functions, and evaluation by grouping sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..config import ROOF
from ..functions.registered import register
from ..operators import metrics, project
from ..views import oracle, view
from .grid import ANGLES, FINE_SQL, POLYLINE_SQL, THREAT_QUERY_SQL, Z_SQL
from .perception import judged


def sql_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heights of the cells, in SQL alone."""
    return register(spark).sql(
        f"""SELECT seq_id, frame_id, tier_idx, ring_idx, angle_idx, round(s.ground, 6) AS elevation_ground, round(s.bottom, 6) AS elevation_obstacle_bottom, round(s.top, 6) AS elevation_obstacle_top FROM (
          SELECT seq_id, frame_id, k.tier_idx AS tier_idx, k.ring_idx AS ring_idx, k.angle_idx AS angle_idx, z_split(z) AS s
          FROM (SELECT *, polar_key(x, y) AS k FROM {{points}} WHERE z <= {ROOF}) GROUP BY ALL)""",
        points=view(spark, sf_dir, "points_v"),
    )


def _frames(spark, sf_dir) -> DataFrame:
    return project.with_lobes(view(spark, sf_dir, "frames_v"), view(spark, sf_dir, "tracks_v"))


def sql_polyline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fine zone's outline of every frame, by a lateral join with a table function."""
    return register(spark).sql(
        "SELECT f.seq_id, f.frame_id, l.k, round(l.x, 6) AS x, round(l.y, 6) AS y FROM {frames} f, LATERAL fovea_polyline(f.speed_mps, f.steering_angle_rad, f.lobes) l", frames=_frames(spark, sf_dir)
    )


def sql_fine_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    return register(spark).sql(
        f"""SELECT seq_id, frame_id, k, round(ellipse_radius(theta, speed_mps, steering_angle_rad, 1D), 6) AS ellipse, round(fine_radius(theta, speed_mps, steering_angle_rad, lobes), 6) AS fine
        FROM (SELECT *, (k + 0.37D) * {2.0 / ANGLES!r}D * pi() - pi() AS theta FROM (SELECT *, explode(sequence(0, {ANGLES - 1})) AS k FROM {{frames}}))""",
        frames=_frames(spark, sf_dir),
    )


def sql_threats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return register(spark).sql(
        "SELECT track_id, t.kind, t.is_threat, round(t.reach, 6) AS reach, round(t.bearing, 6) AS bearing FROM (SELECT track_id, threat(x, y, vx, vy) AS t FROM {tracks})", tracks=view(spark, sf_dir, "tracks_v")
    )


def evaluation_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IoU by frame, by distance and of all points, in one scan; -1 where a level has no frame."""
    return metrics.evaluation(judged(spark, sf_dir)).fillna(-1, ["seq_id", "frame_id"]).fillna("", ["bucket"])


_COUNTS = """, c AS (SELECT CAST(unnest(range(4)) AS INT) AS class_id),
j AS (SELECT seq_id, frame_id, pred, class_id AS gt, CASE WHEN sqrt(x*x+y*y) < 10 THEN '0-10m' WHEN sqrt(x*x+y*y) < 30 THEN '10-30m' WHEN sqrt(x*x+y*y) < 100 THEN '30-100m' END AS bucket FROM points_v WHERE class_id <> -1),
l AS (SELECT 'frame' AS level, seq_id, frame_id, '' AS bucket, pred, gt FROM j UNION ALL SELECT 'distance', -1, -1, bucket, pred, gt FROM j WHERE bucket IS NOT NULL UNION ALL SELECT 'all', -1, -1, '', pred, gt FROM j),
g AS (SELECT level, seq_id, frame_id, bucket, c.class_id, count(*) AS points, count(*) FILTER (pred = c.class_id AND gt = c.class_id) AS tp, count(*) FILTER (pred = c.class_id OR gt = c.class_id) AS un FROM l, c GROUP BY ALL),
i AS (SELECT *, CASE WHEN un = 0 THEN 0::DOUBLE ELSE tp / un END AS iou FROM g)"""
EVALUATION_SQL = oracle("points_v") + _COUNTS + """ SELECT level, seq_id, frame_id, bucket, points, class_id, round(iou, 6) AS iou FROM i
UNION ALL SELECT level, seq_id, frame_id, bucket, points, -1, round(sum(iou ORDER BY class_id) / 4, 6) FROM i GROUP BY level, seq_id, frame_id, bucket, points"""

QUERIES = {
    "sql_cells": (sql_cells, Z_SQL),
    "sql_polyline": (sql_polyline, POLYLINE_SQL),
    "sql_fine_radius": (sql_fine_radius, FINE_SQL),
    "sql_threats": (sql_threats, THREAT_QUERY_SQL),
    "evaluation_sets": (evaluation_sets, EVALUATION_SQL),
}
