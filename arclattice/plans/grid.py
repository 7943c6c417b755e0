"""Queries over points, tiers, cells and the fine zone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import FOVEA, LEAST_RANGE
from ..functions import fovea, polar
from ..operators import metrics, project
from ..operators.track import moving_objects
from ..views import oracle, view

CELL = project.CELL
#: The cell centre of other engines' text.
CENTER_SQL = f"""SELECT *, cr * cos(ct) AS cx, cr * sin(ct) AS cy FROM (
  SELECT *, (angle_idx + 0.5::DOUBLE) * (resolution_tier / greatest(cr, {LEAST_RANGE}::DOUBLE)) AS ct FROM (
    SELECT *, (ring_idx + 0.5::DOUBLE) * resolution_tier AS cr FROM {{cells}}))"""
WRAP = "({a} + pi()) - 2*pi() * floor(({a} + pi()) / (2*pi())) - pi()"
KEYS = ", ".join(CELL)


def points(spark, sf_dir) -> DataFrame:
    return view(spark, sf_dir, "points_v")


def static_cells(spark, sf_dir) -> DataFrame:
    return project.grid_cells(project.with_key(points(spark, sf_dir)))


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


def polar_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = points(spark, sf_dir).groupBy("seq_id", "frame_id")
    return rounded(rows.agg(F.count(F.lit(1)).alias("n"), F.avg(polar.radius()).alias("mean_r"), F.max(polar.radius()).alias("max_r"), F.avg(polar.bearing()).alias("mean_theta")), "mean_r", "max_r", "mean_theta")


POLAR_SQL = oracle("points_v") + """ SELECT seq_id, frame_id, count(*) AS n, round(avg(sqrt(x*x + y*y)), 6) AS mean_r, round(max(sqrt(x*x + y*y)), 6) AS max_r,
  round(avg(atan2(y, x)), 6) AS mean_theta FROM points_v GROUP BY ALL"""


def tier_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = polar.resolution(polar.radius())
    rows = points(spark, sf_dir).withColumn("resolution_tier", size).withColumn("tier_idx", polar.tier_index(F.col("resolution_tier")))
    return rows.groupBy("seq_id", "frame_id", "tier_idx", "resolution_tier").agg(F.count(F.lit(1)).alias("n"))


TIER_SQL = oracle("points_v") + """ SELECT seq_id, frame_id, CASE WHEN r < 10 THEN 0 WHEN r < 30 THEN 1 ELSE 2 END AS tier_idx,
  CASE WHEN r < 10 THEN 0.05::DOUBLE WHEN r < 30 THEN 0.15::DOUBLE ELSE 0.5::DOUBLE END AS resolution_tier, count(*) AS n
FROM (SELECT *, sqrt(x*x + y*y) AS r FROM points_v) GROUP BY ALL"""


def angular_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = polar.radius()
    rows = points(spark, sf_dir).select("seq_id", "frame_id", polar.angular_step(polar.resolution(r), r).alias("step"))
    return rounded(rows.groupBy("seq_id", "frame_id").agg(F.min("step").alias("least"), F.max("step").alias("most"), F.avg("step").alias("mean")), "least", "most", "mean")


STEP_SQL = oracle("points_v") + f""", k AS ({project.STATIC_KEY_SQL.replace("WHERE z <= 2.5", "")})
SELECT seq_id, frame_id, round(min(s), 6) AS least, round(max(s), 6) AS most, round(avg(s), 6) AS mean FROM
  (SELECT *, resolution_tier / greatest(r, 0.5::DOUBLE) AS s FROM k) GROUP BY ALL"""


def cell_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = project.with_key(points(spark, sf_dir))
    keyed = keyed.withColumn("cell_id", polar.cell_id(F.col("tier_idx"), F.col("ring_idx"), F.col("angle_idx")))
    return keyed.groupBy(*CELL, "cell_id").agg(F.count(F.lit(1)).alias("n"))


KEY_SQL = oracle("points_v") + f""", k AS ({project.STATIC_KEY_SQL})
SELECT {KEYS}, tier_idx * 1000000000000 + ring_idx * 1000000 + angle_idx + 500000 AS cell_id, count(*) AS n FROM k GROUP BY ALL"""


def cell_unpack(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("cell_id")
    parts = {"tier": F.floor(i / 10**12).cast("int"), "ring": F.floor(F.pmod(i, F.lit(10**12)) / 10**6), "angle": F.pmod(i, F.lit(10**6)) - 500_000}
    return cell_key(spark, sf_dir).select("cell_id").distinct().select("cell_id", *[v.alias(k) for k, v in parts.items()])


UNPACK_SQL = KEY_SQL.split("\nSELECT")[0] + """
SELECT DISTINCT tier_idx * 1000000000000 + ring_idx * 1000000 + angle_idx + 500000 AS cell_id, tier_idx AS tier, ring_idx AS ring, angle_idx AS angle FROM k"""


def cell_center(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = project.with_key(points(spark, sf_dir)).select(*CELL, "resolution_tier").distinct()
    out = project.with_center(keyed)
    return rounded(out, "r", "theta", "x", "y").withColumn("resolution_tier", F.col("resolution_tier"))


CENTER_QUERY_SQL = oracle("points_v") + f""", k AS (SELECT DISTINCT {KEYS}, resolution_tier FROM ({project.STATIC_KEY_SQL}))
SELECT {KEYS}, resolution_tier, round(cr, 6) AS r, round(ct, 6) AS theta, round(cx, 6) AS x, round(cy, 6) AS y FROM ({CENTER_SQL.format(cells="k")})"""


def roof_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = points(spark, sf_dir)
    return rows.groupBy("seq_id", "frame_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("z") <= 2.5).alias("below_roof"), F.count_if(F.col("z") <= 4.0).alias("below_bridge_roof"))


ROOF_SQL = oracle("points_v") + """ SELECT seq_id, frame_id, count(*) AS n, count(*) FILTER (z <= 2.5) AS below_roof, count(*) FILTER (z <= 4.0) AS below_bridge_roof
FROM points_v GROUP BY ALL"""

# Two means per cell as in operators.project, a round a common table.
_ROUND = """, r{i} AS (SELECT *, CASE WHEN done OR m1 IS NULL OR m2 IS NULL THEN c1 ELSE m1 END AS n1, CASE WHEN done OR m1 IS NULL OR m2 IS NULL THEN c2 ELSE m2 END AS n2,
    done OR m1 IS NULL OR m2 IS NULL OR greatest(abs(m1 - c1), abs(m2 - c2)) < 1e-4 AS d FROM (
  SELECT *, avg(CASE WHEN abs(z - c1) < abs(z - c2) THEN z END) OVER w AS m1, avg(CASE WHEN abs(z - c1) < abs(z - c2) THEN NULL ELSE z END) OVER w AS m2
  FROM s{j} WINDOW w AS (PARTITION BY {keys}))),
s{i} AS (SELECT {keys}, class_id, r, resolution_tier, z, lo, hi, n1 AS c1, n2 AS c2, d AS done FROM r{i})"""
SPLIT_SQL = (
    ", s0 AS (SELECT {keys}, class_id, r, resolution_tier, z, lo, hi, lo AS c1, hi AS c2, hi - lo < 0.4 AS done FROM (SELECT *, min(z) OVER w AS lo, max(z) OVER w AS hi FROM k WINDOW w AS (PARTITION BY {keys})))"
    + "".join(_ROUND.replace("{i}", str(i)).replace("{j}", str(i - 1)) for i in range(1, 6))
    + """, g AS (SELECT {keys}, min(lo) AS lo, min(hi) AS hi, min(z) FILTER (first) AS lo1, max(z) FILTER (first) AS hi1, avg(z) FILTER (first) AS a1,
  min(z) FILTER (NOT first) AS lo2, max(z) FILTER (NOT first) AS hi2, avg(z) FILTER (NOT first) AS a2,
  count(*) AS point_count, avg(r) AS mean_r, any_value(resolution_tier) AS resolution_tier FROM (SELECT *, abs(z - c1) < abs(z - c2) AS first FROM s5) GROUP BY {keys}),
h AS (SELECT *, CASE WHEN a1 > a2 THEN lo2 ELSE lo1 END AS low_min, CASE WHEN a1 > a2 THEN hi2 ELSE hi1 END AS low_max,
  CASE WHEN a1 > a2 THEN lo1 ELSE lo2 END AS up_min, CASE WHEN a1 > a2 THEN hi1 ELSE hi2 END AS up_max FROM g),
v AS (SELECT {keys}, CAST(arg_max(class_id, n * 100 - class_id) AS INT) AS semantic_class FROM (SELECT {keys}, class_id, count(*) AS n FROM k GROUP BY ALL) GROUP BY {keys}),
cells AS (SELECT {keys}, CASE WHEN over THEN low_min ELSE lo END AS elevation_ground, CASE WHEN over THEN up_min END AS elevation_obstacle_bottom,
  CASE WHEN over THEN up_max END AS elevation_obstacle_top, semantic_class, point_count,
  least(1.0::DOUBLE, point_count / greatest(1.0::DOUBLE, 150.0::DOUBLE / greatest(1.0::DOUBLE, mean_r))) AS confidence, frame_id AS last_updated_frame, resolution_tier
  FROM (SELECT *, coalesce(hi - lo >= 0.4 AND up_min - low_max > 0.4, false) AS over FROM h) JOIN v USING ({keys}))"""
).replace("{keys}", KEYS)
STATIC_CELLS = oracle("points_v") + f", k AS ({project.STATIC_KEY_SQL})" + SPLIT_SQL


def z_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = static_cells(spark, sf_dir)
    return rounded(cells.select(*CELL, "elevation_ground", "elevation_obstacle_bottom", "elevation_obstacle_top"), "elevation_ground", "elevation_obstacle_bottom", "elevation_obstacle_top")


Z_SQL = STATIC_CELLS + f" SELECT {KEYS}, round(elevation_ground, 6) AS elevation_ground, round(elevation_obstacle_bottom, 6) AS elevation_obstacle_bottom, round(elevation_obstacle_top, 6) AS elevation_obstacle_top FROM cells"


def majority_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project.majority_class(project.with_key(points(spark, sf_dir)))


MAJORITY_SQL = STATIC_CELLS + f" SELECT {KEYS}, semantic_class, point_count FROM cells"


def cell_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(static_cells(spark, sf_dir).select(*CELL, "confidence"), "confidence")


CONFIDENCE_SQL = STATIC_CELLS + f" SELECT {KEYS}, round(confidence, 6) AS confidence FROM cells"


def grid_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(static_cells(spark, sf_dir), "elevation_ground", "elevation_obstacle_bottom", "elevation_obstacle_top", "confidence")


_CELLS = f"""SELECT {KEYS}, round(elevation_ground, 6) AS elevation_ground, round(elevation_obstacle_bottom, 6) AS elevation_obstacle_bottom,
  round(elevation_obstacle_top, 6) AS elevation_obstacle_top, semantic_class, point_count, round(confidence, 6) AS confidence, last_updated_frame, resolution_tier FROM cells"""
CELLS_SQL = STATIC_CELLS + " " + _CELLS

# The fine zone.

_STRETCH = f"(1 + {FOVEA.max_stretch - 1}::DOUBLE * least(greatest(speed_mps / {FOVEA.reference_speed}::DOUBLE, 0), 1))"
ELLIPSE_SQL = f"""SELECT *, CASE WHEN abs(d) < pi()/2 THEN (10.0::DOUBLE * {_STRETCH}) * 10.0::DOUBLE
    / sqrt(pow(10.0::DOUBLE * cos(d), 2) + pow((10.0::DOUBLE * {_STRETCH}) * sin(d), 2)) ELSE 10.0::DOUBLE END AS ellipse
FROM (SELECT *, {WRAP.format(a="(theta - steering_angle_rad * {shear}::DOUBLE)")} AS d FROM {{points}})"""
_FAR, _CLOSE = FOVEA.farthest_threat, "(-(x*vx + y*vy) / greatest(r, 0.1::DOUBLE))"
THREAT_SQL = f"""SELECT *, kind IN ('A', 'B', 'C') AS is_threat, CASE WHEN kind IN ('A', 'B') THEN least(r + 5, {_FAR}::DOUBLE) WHEN kind = 'C' THEN least(abs(meet) + 4, {_FAR}::DOUBLE) ELSE 0 END AS reach,
  CASE WHEN kind IN ('A', 'B', 'C') THEN atan2(y, x) ELSE 0 END AS bearing FROM (
  SELECT *, CASE WHEN r > {_FAR} OR r < 0.5 THEN 'out of range'
    WHEN x > 0 AND abs(y) <= 5.5 AND ({_CLOSE} >= 0.5 OR vx <= -0.5) THEN 'A'
    WHEN x > 0 AND abs(y) <= 3.2 AND ({_CLOSE} < -0.5 OR vx > 0.5) THEN 'B rejected'
    WHEN x > 0 AND abs(y) <= 3.2 AND r <= 25 THEN 'B'
    WHEN speed >= 0.8 AND abs(y) > 3.2 AND abs(y) <= 10 AND ((y > 0 AND vy < -0.5) OR (y < 0 AND vy > 0.5)) AND meet >= 0 AND meet <= 25 AND enter <= 3 THEN 'C'
    ELSE 'none' END AS kind
  FROM (SELECT *, x + vx * enter AS meet FROM (SELECT *, sqrt(x*x + y*y) AS r, sqrt(vx*vx + vy*vy) AS speed, (abs(y) - 3.2::DOUBLE) / greatest(abs(vy), 0.1::DOUBLE) AS enter FROM tracks_v)))"""
#: Height of each track's lobe at theta; `a` has theta and the frame.
LOBES_SQL = f"""SELECT a.*, coalesce((SELECT max(CASE WHEN speed >= 0.8 THEN least(s * 1.3::DOUBLE, {_FAR}::DOUBLE) ELSE s END) FROM (
    SELECT t.speed, t.reach * exp(-0.5::DOUBLE * pow(({WRAP.format(a="(a.theta - t.bearing)")}) / greatest(0.35::DOUBLE, greatest(t.bbox_l, t.bbox_w) / greatest(t.r, 1)), 2)) AS s
    FROM threats t WHERE t.seq_id = a.seq_id AND t.frame_id = a.frame_id AND t.is_threat)), 0) AS attention FROM {{points}} a"""
ANGLES = 24


def _angles(spark, sf_dir, p: fovea.Fovea = FOVEA, n: int = ANGLES) -> DataFrame:
    frames = project.with_lobes(view(spark, sf_dir, "frames_v"), view(spark, sf_dir, "tracks_v"), p)
    step = 2.0 / n
    return frames.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("theta", (F.col("k") + 0.37) * step * F.pi() - F.pi())


_ANGLES_SQL = f"a AS (SELECT f.*, k.k, (k.k + 0.37::DOUBLE) * {2.0 / ANGLES!r}::DOUBLE * pi() - pi() AS theta FROM frames_v f, (SELECT CAST(unnest(range({ANGLES})) AS INT) AS k) k)"


def fine_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _angles(spark, sf_dir)
    return rows.select("seq_id", "frame_id", "k", F.round(fovea.fine_radius("theta"), 6).alias("ellipse"), F.round(fovea.fine_radius("theta", lobes=F.col("lobes")), 6).alias("fine"))


FINE_SQL = oracle("frames_v", "tracks_v") + f""", {_ANGLES_SQL}, threats AS ({THREAT_SQL}), l AS ({LOBES_SQL.format(points="a")})
SELECT seq_id, frame_id, k, round(ellipse, 6) AS ellipse, round(greatest(ellipse, attention), 6) AS fine FROM ({ELLIPSE_SQL.format(points="l", shear=1.0)})"""


def attention_lobe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _angles(spark, sf_dir).select("seq_id", "frame_id", "k", F.round(fovea.attention(F.col("theta"), F.col("lobes")), 6).alias("attention"))


LOBE_SQL = FINE_SQL.split("\nSELECT seq_id")[0] + " SELECT seq_id, frame_id, k, round(attention, 6) AS attention FROM l"


def lookahead_lobe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lobes that point to where tracks will be, without regard to threats."""
    p = fovea.Fovea(collision_only=False)
    return _angles(spark, sf_dir, p).select("seq_id", "frame_id", "k", F.round(fovea.attention(F.col("theta"), F.col("lobes")), 6).alias("attention"))


LOOKAHEAD_SQL = oracle("frames_v", "tracks_v") + f""", {_ANGLES_SQL}, m AS (SELECT *, abs(vx) > 1e-3 OR abs(vy) > 1e-3 AS moves, sqrt(x*x + y*y) AS r, sqrt(vx*vx + vy*vy) AS speed,
  sqrt((x + vx)*(x + vx) + (y + vy)*(y + vy)) AS pr, greatest(greatest(bbox_l, bbox_w) / greatest(sqrt(x*x + y*y), 1), 0.2::DOUBLE) AS sigma FROM tracks_v)
SELECT a.seq_id, a.frame_id, a.k, round(coalesce((SELECT max(greatest(0, CASE WHEN moves AND speed >= 0.8 THEN least(s * 1.3::DOUBLE, {_FAR}::DOUBLE) ELSE s END)) FROM (
  SELECT moves, speed, (CASE WHEN moves THEN least(greatest(r, pr) + 4, {_FAR}::DOUBLE) ELSE least(r + 5, {_FAR}::DOUBLE) END)
    * exp(-0.5::DOUBLE * pow(({WRAP.format(a="(a.theta - CASE WHEN moves THEN atan2(y + vy, x + vx) ELSE atan2(y, x) END)")}) / sigma, 2)) AS s
  FROM m WHERE m.seq_id = a.seq_id AND m.frame_id = a.frame_id)), 0), 6) AS attention FROM a"""


def threat_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "tracks_v").withColumn("t", fovea.threat())
    return rows.select("track_id", "t.kind", "t.is_threat", F.round("t.reach", 6).alias("reach"), F.round("t.bearing", 6).alias("bearing"))


THREAT_QUERY_SQL = oracle("tracks_v") + f" SELECT track_id, kind, is_threat, round(reach, 6) AS reach, round(bearing, 6) AS bearing FROM ({THREAT_SQL})"


def threat_hud(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Threats per frame as the display counts them, without crossing traffic, and tracks that move."""
    t = fovea.threat()["kind"]
    rows = view(spark, sf_dir, "tracks_v").groupBy("seq_id", "frame_id")
    return rows.agg(F.count_if(t.isin("A", "B")).alias("threats"), F.count_if(polar.radius("vx", "vy") >= FOVEA.moving_speed).alias("moving"))


HUD_SQL = oracle("tracks_v") + f" SELECT seq_id, frame_id, count(*) FILTER (kind IN ('A', 'B')) AS threats, count(*) FILTER (speed >= 0.8) AS moving FROM ({THREAT_SQL}) GROUP BY ALL"


def moving(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = moving_objects(view(spark, sf_dir, "tracks_v"))
    rows = rows.select("track_id", "speed_mps", "heading_rad", "next_x", "next_y", "is_moving", "is_collision_threat", "threat_reach_m")
    return rounded(rows, "speed_mps", "heading_rad", "next_x", "next_y", "threat_reach_m")


MOVING_SQL = oracle("tracks_v") + f""" SELECT track_id, round(speed, 6) AS speed_mps, round(CASE WHEN speed > 1e-3 THEN atan2(vy, vx) ELSE 0 END, 6) AS heading_rad,
  round(x + vx * 0.1::DOUBLE, 6) AS next_x, round(y + vy * 0.1::DOUBLE, 6) AS next_y, speed >= 0.8 AS is_moving, is_threat AS is_collision_threat, round(reach, 6) AS threat_reach_m FROM ({THREAT_SQL})"""


def fovea_polyline(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = project.with_lobes(view(spark, sf_dir, "frames_v"), view(spark, sf_dir, "tracks_v"))
    line = frames.select("seq_id", "frame_id", F.posexplode(fovea.polyline(lobes=F.col("lobes"), digits=None)).alias("k", "p"))
    return line.select("seq_id", "frame_id", "k", F.round(F.col("p")[0], 6).alias("x"), F.round(F.col("p")[1], 6).alias("y"))


POLYLINE_SQL = oracle("frames_v", "tracks_v") + f""", a AS (SELECT f.*, k.k, k.k * (2*pi() / 119) - pi() AS theta FROM frames_v f, (SELECT CAST(unnest(range(120)) AS INT) AS k) k),
threats AS ({THREAT_SQL}), l AS ({LOBES_SQL.format(points="a")})
SELECT seq_id, frame_id, k, round(r * cos(theta), 6) + 0 AS x, round(r * sin(theta), 6) + 0 AS y FROM (SELECT *, greatest(ellipse, attention) AS r FROM ({ELLIPSE_SQL.format(points="l", shear=FOVEA.drawn_shear)}))"""


def foveated_cells(spark, sf_dir, tracks: bool = True) -> DataFrame:
    frames = view(spark, sf_dir, "frames_v")
    keyed = project.with_foveated_key(points(spark, sf_dir), frames, view(spark, sf_dir, "tracks_v") if tracks else None)
    return project.grid_cells(keyed)


def grid_cells_foveated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(foveated_cells(spark, sf_dir), "elevation_ground", "elevation_obstacle_bottom", "elevation_obstacle_top", "confidence")


FOVEATED = oracle("points_v", "frames_v", "tracks_v") + f""", threats AS ({THREAT_SQL}),
a AS (SELECT p.*, f.speed_mps, f.steering_angle_rad, atan2(p.y, p.x) AS theta FROM points_v p JOIN frames_v f USING (seq_id, frame_id)),
l AS ({LOBES_SQL.format(points="a")}), e AS (SELECT * EXCLUDE (theta, d), greatest(ellipse, attention) AS fine FROM ({ELLIPSE_SQL.format(points="l", shear=1.0)})),
k AS ({project.KEY_SQL.format(fine="fine", points="e")})""" + SPLIT_SQL
FOVEATED_SQL = FOVEATED + " " + _CELLS


def memory_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.memory(foveated_cells(spark, sf_dir, False), ["seq_id", "frame_id"])


MEMORY_SQL = FOVEATED.replace("greatest(ellipse, attention) AS fine", "ellipse AS fine") + """ SELECT seq_id, frame_id, count(*) AS active_cells, count(*) * 40 AS memory_bytes_foveated,
  CAST(greatest(sum(CASE resolution_tier WHEN 0.05::DOUBLE THEN 1 WHEN 0.15::DOUBLE THEN 8 ELSE 100 END), count(*) * 9) * 40 AS BIGINT) AS memory_bytes_uniform_baseline,
  round(least(greatest((1 - CAST(count(*) * 40 AS DOUBLE) / CAST(greatest(sum(CASE resolution_tier WHEN 0.05::DOUBLE THEN 1 WHEN 0.15::DOUBLE THEN 8 ELSE 100 END), count(*) * 9) * 40 AS DOUBLE)) * 100, 0), 99.9::DOUBLE), 1) AS memory_savings_pct
FROM cells GROUP BY ALL"""


def overhang_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.overhang_counts(static_cells(spark, sf_dir), ["seq_id", "frame_id"])


OVERHANG_SQL = STATIC_CELLS + " SELECT seq_id, frame_id, semantic_class, count(*) AS n, count(elevation_obstacle_bottom) AS overhangs FROM cells GROUP BY ALL"


def slab_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.slabs(static_cells(spark, sf_dir)).select(*CELL, "slab_height", "slab_z", "slab_width", "overhang_height", "overhang_z")
    return rounded(out, "slab_height", "slab_z", "slab_width", "overhang_height", "overhang_z")


SLAB_SQL = STATIC_CELLS + f""" SELECT {KEYS}, round(h, 6) AS slab_height, round(elevation_ground + h / 2, 6) AS slab_z, round(resolution_tier * 0.95::DOUBLE, 6) AS slab_width,
  round(o, 6) AS overhang_height, round(elevation_obstacle_bottom + o / 2, 6) AS overhang_z FROM (
  SELECT *, CASE semantic_class WHEN 2 THEN 1.5::DOUBLE WHEN 3 THEN 1.2::DOUBLE ELSE 0.12::DOUBLE END AS h,
    CASE WHEN elevation_obstacle_bottom IS NOT NULL THEN greatest(0.2::DOUBLE, elevation_obstacle_top - elevation_obstacle_bottom) END AS o FROM cells)"""

QUERIES = {
    "polar_project": (polar_project, POLAR_SQL),
    "tier_lookup": (tier_lookup, TIER_SQL),
    "angular_steps": (angular_steps, STEP_SQL),
    "cell_key": (cell_key, KEY_SQL),
    "cell_unpack": (cell_unpack, UNPACK_SQL),
    "cell_center": (cell_center, CENTER_QUERY_SQL),
    "roof_clip": (roof_clip, ROOF_SQL),
    "z_split": (z_split, Z_SQL),
    "majority_class": (majority_class, MAJORITY_SQL),
    "cell_confidence": (cell_confidence, CONFIDENCE_SQL),
    "grid_cells": (grid_cells, CELLS_SQL),
    "fine_radius": (fine_radius, FINE_SQL),
    "attention_lobe": (attention_lobe, LOBE_SQL),
    "lookahead_lobe": (lookahead_lobe, LOOKAHEAD_SQL),
    "threat_tracks": (threat_tracks, THREAT_QUERY_SQL),
    "threat_hud": (threat_hud, HUD_SQL),
    "moving_objects": (moving, MOVING_SQL),
    "fovea_polyline": (fovea_polyline, POLYLINE_SQL),
    "grid_cells_foveated": (grid_cells_foveated, FOVEATED_SQL),
    "memory_metrics": (memory_metrics, MEMORY_SQL),
    "overhang_counts": (overhang_counts, OVERHANG_SQL),
    "slab_geometry": (slab_geometry, SLAB_SQL),
}
