"""Queries with state from frame to frame: hysteresis, clusters, tracks, footprints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cluster, hysteresis, project, track
from ..operators.checkpoint import kept
from ..operators.scan import scan
from ..views import oracle, view
from .grid import CENTER_SQL, KEYS, STATIC_CELLS, static_cells


def _sectors(spark, sf_dir):
    return view(spark, sf_dir, "sector_radius_v").withColumn("seq_id", F.lit(0))


def fine_radius_hold(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = hysteresis.radius_hold(_sectors(spark, sf_dir), ["sector"])
    return held.select("sector", "frame_id", F.round("radius", 6).alias("radius"), F.round("held", 6).alias("held"))


NUMBERED = oracle("sector_radius_v").replace("WITH ", "WITH RECURSIVE ") + ", n AS (SELECT *, row_number() OVER (PARTITION BY sector ORDER BY frame_id) AS k FROM sector_radius_v)"
HOLD_SQL = NUMBERED + """, w AS (SELECT sector, frame_id, k, radius, radius AS held FROM n WHERE k = 1
  UNION ALL SELECT n.sector, n.frame_id, n.k, n.radius, CASE WHEN abs(n.radius - w.held) < 0.5::DOUBLE THEN w.held ELSE n.radius END FROM w JOIN n ON n.sector = w.sector AND n.k = w.k + 1)
SELECT sector, frame_id, round(radius, 6) AS radius, round(held, 6) AS held FROM w"""


def contour_ema(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = hysteresis.ema(_sectors(spark, sf_dir), ["sector"], ["radius"])
    return out.select("sector", "frame_id", F.round("radius", 6).alias("radius"))


EMA_SQL = NUMBERED + """, w AS (SELECT sector, frame_id, k, radius FROM n WHERE k = 1
  UNION ALL SELECT n.sector, n.frame_id, n.k, w.radius * 0.35::DOUBLE + n.radius * (1 - 0.35::DOUBLE) FROM w JOIN n ON n.sector = w.sector AND n.k = w.k + 1)
SELECT sector, frame_id, round(radius, 6) AS radius FROM w"""


def tier_schmitt(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _sectors(spark, sf_dir).withColumn("range_m", F.col("radius"))
    out = hysteresis.schmitt_tier(rows, ["sector"], boundary=11.0)
    return out.select("sector", "frame_id", "tier")


SCHMITT_SQL = NUMBERED + """, w AS (SELECT sector, frame_id, k, CASE WHEN radius < 11 THEN 0.05::DOUBLE ELSE 0.15::DOUBLE END AS tier FROM n WHERE k = 1
  UNION ALL SELECT n.sector, n.frame_id, n.k, CASE WHEN w.tier = 0.05::DOUBLE THEN CASE WHEN n.radius > 11.5 THEN 0.15::DOUBLE ELSE 0.05::DOUBLE END
    ELSE CASE WHEN n.radius < 10.5 THEN 0.05::DOUBLE ELSE 0.15::DOUBLE END END FROM w JOIN n ON n.sector = w.sector AND n.k = w.k + 1)
SELECT sector, frame_id, tier FROM w"""


def zclip_hysteresis(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _sectors(spark, sf_dir).withColumn("z_max", F.col("radius") - 8.5)
    return hysteresis.z_clip(rows, ["sector"]).select("sector", "frame_id", "above_frames", "clipped")


ZCLIP_SQL = NUMBERED + """, w AS (SELECT sector, frame_id, k, CAST(radius - 8.5 > 2.5 AS BIGINT) AS above_frames, radius - 8.5 AS z FROM n WHERE k = 1
  UNION ALL SELECT n.sector, n.frame_id, n.k, CASE WHEN n.radius - 8.5 > 2.5 THEN w.above_frames + 1 ELSE 0 END, n.radius - 8.5 FROM w JOIN n ON n.sector = w.sector AND n.k = w.k + 1)
SELECT sector, frame_id, above_frames, z > 2.5::DOUBLE + 0.1::DOUBLE OR (z > 2.5 AND above_frames >= 2) AS clipped FROM w"""


def sensor_degradation(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a coarse lattice, so that places come again
    cells = static_cells(spark, sf_dir).withColumn("ring_idx", F.floor(F.col("ring_idx") / 40)).withColumn("angle_idx", F.floor(F.col("angle_idx") / 40))
    cells = cells.groupBy("seq_id", "frame_id", "tier_idx", "ring_idx", "angle_idx").agg(F.sum("point_count").alias("point_count"), F.round(F.min("confidence"), 6).alias("confidence"), F.min("resolution_tier").alias("resolution_tier"))
    return hysteresis.degraded(cells)


DEGRADED_SQL = STATIC_CELLS.replace("WITH ", "WITH RECURSIVE ") + """, m AS (SELECT seq_id, frame_id, tier_idx, CAST(floor(ring_idx / 40) AS BIGINT) AS ring_idx, CAST(floor(angle_idx / 40) AS BIGINT) AS angle_idx,
  CAST(sum(point_count) AS BIGINT) AS point_count, round(min(confidence), 6) AS confidence, min(resolution_tier) AS resolution_tier FROM cells GROUP BY ALL),
n AS (SELECT *, row_number() OVER (PARTITION BY seq_id, ring_idx, angle_idx ORDER BY frame_id, tier_idx) AS k FROM m),
w AS (SELECT *, CAST(point_count < 3 AS BIGINT) AS low FROM n WHERE k = 1
  UNION ALL SELECT n.*, CASE WHEN n.point_count < 3 THEN w.low + 1 ELSE 0 END FROM w JOIN n ON n.seq_id = w.seq_id AND n.ring_idx = w.ring_idx AND n.angle_idx = w.angle_idx AND n.k = w.k + 1)
SELECT seq_id, frame_id, tier_idx, ring_idx, angle_idx, CASE WHEN low >= 3 THEN 3 ELSE point_count END AS point_count, CASE WHEN low >= 3 THEN 0.3::DOUBLE ELSE confidence END AS confidence,
  CASE WHEN low >= 3 THEN 0.5::DOUBLE ELSE resolution_tier END AS resolution_tier, low >= 3 AS degraded FROM w"""


def _detections(spark, sf_dir):
    return view(spark, sf_dir, "detections_v").withColumn("class_id", F.lit(3))


def cluster_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.near_pairs(_detections(spark, sf_dir), ["frame_id"], "det_id")


PAIRS_SQL = oracle("detections_v") + """ SELECT a.frame_id, a.det_id AS a, b.det_id AS b FROM detections_v a JOIN detections_v b
  ON a.frame_id = b.frame_id AND a.det_id < b.det_id AND (a.x - b.x)*(a.x - b.x) + (a.y - b.y)*(a.y - b.y) <= 6.25"""


def cluster_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.components(_detections(spark, sf_dir), ["frame_id"], "det_id").select("frame_id", "det_id", "component")


COMPONENTS_SQL = oracle("detections_v").replace("WITH ", "WITH RECURSIVE ") + """, p AS (SELECT a.det_id AS a, b.det_id AS b FROM detections_v a JOIN detections_v b
  ON a.frame_id = b.frame_id AND a.det_id <> b.det_id AND (a.x - b.x)*(a.x - b.x) + (a.y - b.y)*(a.y - b.y) <= 6.25),
w AS (SELECT det_id, det_id AS seen FROM detections_v UNION SELECT w.det_id, p.b FROM w JOIN p ON p.a = w.seen),
c AS (SELECT det_id, min(seen) AS component FROM w GROUP BY det_id)"""
COMPONENTS_QUERY_SQL = COMPONENTS_SQL + " SELECT frame_id, det_id, component FROM detections_v JOIN c USING (det_id)"


def cluster_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = cluster.clusters(_detections(spark, sf_dir), ["frame_id"], "det_id")
    return out.withColumns({"x": F.round("x", 6), "y": F.round("y", 6)})


CLUSTERS_SQL = COMPONENTS_SQL + """ SELECT frame_id, component, round(avg(x), 6) AS x, round(avg(y), 6) AS y, 3 AS class_id, count(*) AS cells FROM detections_v JOIN c USING (det_id)
GROUP BY frame_id, component HAVING count(*) <= 200 AND max(x) - min(x) <= 14 AND max(y) - min(y) <= 14"""


def kalman_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One track a sector, whose x is the radius and whose y stays 0: every measurement belongs to it."""

    def step(state, radius):
        new = track.Track(1, 3, radius, 0.0) if state is None else track.corrected(track.predicted(state), radius, 0.0, 3)
        return new, (new.x, new.vx, new.p_pos, new.p_cross, new.p_vel)

    out = scan(_sectors(spark, sf_dir).select("sector", "frame_id", "radius"), ["sector"], ["frame_id"], ["radius"], step, "x double, vx double, p double, c double, v double")
    out = out.drop("radius")
    return out.withColumns({n: F.round(n, 6) for n in ("x", "vx", "p", "c", "v")})


KALMAN_SQL = NUMBERED + """, w AS (SELECT sector, frame_id, k, radius AS x, 0::DOUBLE AS vx, 0.1::DOUBLE AS p, 0::DOUBLE AS c, 100::DOUBLE AS v FROM n WHERE k = 1
  UNION ALL SELECT sector, frame_id, k, x1 + p1 / s * res, vx1 + c1 / s * res, (1 - p1 / s) * p1, (1 - p1 / s) * c1, v1 - c1 / s * c1 FROM (
    SELECT *, p1 + 0.1::DOUBLE AS s, radius - x1 AS res FROM (
      SELECT n.sector, n.frame_id, n.k, n.radius, w.x + w.vx * 0.1::DOUBLE AS x1, w.vx AS vx1, w.p + 2 * 0.1::DOUBLE * w.c + 0.1::DOUBLE * 0.1::DOUBLE * w.v + 0.05::DOUBLE AS p1,
        w.c + 0.1::DOUBLE * w.v AS c1, w.v + 0.5::DOUBLE AS v1 FROM w JOIN n ON n.sector = w.sector AND n.k = w.k + 1)))
SELECT sector, frame_id, round(x, 6) AS x, round(vx, 6) AS vx, round(p, 6) AS p, round(c, 6) AS c, round(v, 6) AS v FROM w"""


def _states(spark, sf_dir):
    t = view(spark, sf_dir, "tracks_v")
    return t.select("track_id", "frame_id", "x", "y", F.when(F.col("track_id") % 2 == 0, "CONFIRMED").otherwise("TENTATIVE").alias("state"), (F.lit(0.15) + (F.col("track_id") % 5) * 0.31).alias("p_pos"))


def assoc_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = track.association_candidates(_states(spark, sf_dir), view(spark, sf_dir, "detections_v"))
    return out.select("track_id", "det_id", F.round("m2", 6).alias("m2"))


GATE_SQL = oracle("tracks_v", "detections_v") + """ SELECT track_id, det_id, round(d2 / (p + 0.1::DOUBLE), 6) AS m2 FROM (
  SELECT track_id, det_id, (d.x - t.x)*(d.x - t.x) + (d.y - t.y)*(d.y - t.y) AS d2, 0.15::DOUBLE + (track_id % 5) * 0.31::DOUBLE AS p FROM tracks_v t JOIN detections_v d ON d.frame_id = t.frame_id)
WHERE d2 / (p + 0.1::DOUBLE) < CASE WHEN track_id % 2 = 0 THEN 13.82::DOUBLE ELSE 9.21::DOUBLE END AND sqrt(d2) <= 5"""


def _sequences(spark, sf_dir):
    """The detections dealt to eight sequences."""
    return _detections(spark, sf_dir).withColumn("seq_id", F.lpad((F.col("det_id") % 8).cast("string"), 2, "0"))


def tracked_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All tracks over the frames of the detections."""
    found = _sequences(spark, sf_dir)
    return track.track(found, found.select("seq_id", "frame_id"))


def confirmed_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _sequences(spark, sf_dir)
    return track.track(found, found.select("seq_id", "frame_id"), confirmed_only=True).groupBy("seq_id", "frame_id").agg(F.count(F.lit(1)).alias("confirmed"))


#: What tracks_v does in three frames, the cells under it and what it leaves behind; `cells` comes before.
GHOSTS_SQL = f"""mt AS (SELECT track_id, seq_id, frame_id + k AS frame_id, k, x + vx * (k * 0.1::DOUBLE) AS x, y + vy * (k * 0.1::DOUBLE) AS y, vx, vy, bbox_l, bbox_w
  FROM tracks_v, (SELECT CAST(unnest(range(3)) AS INT) AS k)), cc AS ({CENTER_SQL.format(cells="cells")}),
fp AS (SELECT seq_id, frame_id, track_id, tier_idx, ring_idx, angle_idx FROM mt JOIN (SELECT * FROM cc WHERE semantic_class = 3) c USING (seq_id, frame_id)
  WHERE (c.cx - mt.x)*(c.cx - mt.x) + (c.cy - mt.y)*(c.cy - mt.y) <= greatest(bbox_l, bbox_w) * greatest(bbox_l, bbox_w)),
nx AS (SELECT seq_id, frame_id, lead(frame_id) OVER (PARTITION BY seq_id ORDER BY frame_id) AS following FROM (SELECT DISTINCT seq_id, frame_id FROM frames_v)),
vc AS (SELECT p.seq_id, f.following AS frame_id, p.track_id, p.tier_idx, p.ring_idx, p.angle_idx FROM fp p
  JOIN nx f ON f.seq_id = p.seq_id AND f.frame_id = p.frame_id AND f.following IS NOT NULL
  ANTI JOIN fp q ON q.seq_id = p.seq_id AND q.frame_id = f.following AND q.track_id = p.track_id AND q.tier_idx = p.tier_idx AND q.ring_idx = p.ring_idx AND q.angle_idx = p.angle_idx),
vo AS (SELECT v.*, CASE WHEN c.semantic_class IS NULL THEN 'gone' WHEN c.semantic_class <> 3 THEN 'other' WHEN c.last_updated_frame < v.frame_id THEN 'stale' ELSE 'kept' END AS outcome
  FROM vc v LEFT JOIN cells c USING (seq_id, frame_id, tier_idx, ring_idx, angle_idx)),
gc AS (SELECT f.seq_id, f.frame_id, coalesce(g.ghosts, 0) AS ghosts FROM frames_v f LEFT JOIN (SELECT seq_id, frame_id, count(*) FILTER (outcome <> 'kept') AS ghosts FROM vo GROUP BY ALL) g USING (seq_id, frame_id))"""
MOVING_SQL = oracle("points_v", "frames_v", "tracks_v") + STATIC_CELLS.split(oracle("points_v"))[1] + ", " + GHOSTS_SQL


def moving_tracks(spark, sf_dir):
    """tracks_v moved on through frames k = 0, 1 and 2."""
    t = view(spark, sf_dir, "tracks_v").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(2))))
    return t.withColumns({"frame_id": F.col("frame_id") + F.col("k"), "x": F.col("x") + F.col("vx") * (F.col("k") * 0.1), "y": F.col("y") + F.col("vy") * (F.col("k") * 0.1)})


def _footprints(spark, sf_dir):
    t = moving_tracks(spark, sf_dir)
    cells = kept(static_cells(spark, sf_dir))  # read for the footprints and for what became of them
    centred = project.with_center(cells).withColumnRenamed("x", "cx").withColumnRenamed("y", "cy")
    return track.footprints(t, centred), cells


def footprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _footprints(spark, sf_dir)[0]


FOOTPRINT_SQL = MOVING_SQL + " SELECT * FROM fp"


def vacated_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    prints, cells = _footprints(spark, sf_dir)
    prints = kept(prints)
    return track.vacated(prints, view(spark, sf_dir, "frames_v"), cells)


VACATED_SQL = MOVING_SQL + f" SELECT seq_id, frame_id, track_id, {KEYS.split(', ', 2)[2]}, outcome, outcome <> 'kept' AS erased FROM vo"


def ghost_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return track.ghost_counts(vacated_cells(spark, sf_dir), view(spark, sf_dir, "frames_v"))


GHOST_SQL = MOVING_SQL + " SELECT * FROM gc"


def ghost_cumulative(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two plays of each sequence: the second starts again from nothing."""
    counts = ghost_count(spark, sf_dir)
    twice = counts.withColumn("play", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("position", F.col("play") * 1000 + F.col("frame_id"))
    return hysteresis.cumulative_ghosts(twice).select("seq_id", "position", "frame_id", "ghosts", "total_ghosts")


CUMULATIVE_SQL = MOVING_SQL + """ SELECT seq_id, play * 1000 + frame_id AS position, frame_id, ghosts, CAST(sum(ghosts) OVER (PARTITION BY seq_id, play ORDER BY frame_id) AS BIGINT) AS total_ghosts
FROM gc, (SELECT CAST(unnest([0, 1]) AS INT) AS play)"""

QUERIES = {
    "fine_radius_hold": (fine_radius_hold, HOLD_SQL),
    "contour_ema": (contour_ema, EMA_SQL),
    "tier_schmitt": (tier_schmitt, SCHMITT_SQL),
    "zclip_hysteresis": (zclip_hysteresis, ZCLIP_SQL),
    "sensor_degradation": (sensor_degradation, DEGRADED_SQL),
    "cluster_pairs": (cluster_pairs, PAIRS_SQL),
    "cluster_components": (cluster_components, COMPONENTS_QUERY_SQL),
    "cluster_detections": (cluster_detections, CLUSTERS_SQL),
    "kalman_single": (kalman_single, KALMAN_SQL),
    "assoc_gate": (assoc_gate, GATE_SQL),
    "tracked_objects": (tracked_objects, None),
    "confirmed_tracks": (confirmed_tracks, None),
    "footprint": (footprint, FOOTPRINT_SQL),
    "vacated_cells": (vacated_cells, VACATED_SQL),
    "ghost_count": (ghost_count, GHOST_SQL),
    "ghost_cumulative": (ghost_cumulative, CUMULATIVE_SQL),
}
