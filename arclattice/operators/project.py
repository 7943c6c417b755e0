"""Points to grid cells: clip, polar key, majority class, confidence and the split of heights."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import FOVEA, LEAST_RANGE, OVERHANG_GAP, ROOF, TIERS, Fovea
from ..functions import polar
from ..functions.fovea import in_fine_zone, lobe, lobes_of_sector, sector_of

CELL = ["seq_id", "frame_id", "tier_idx", "ring_idx", "angle_idx"]
ROUNDS, SETTLED = 5, 1e-4
#: Sectors of a frame, in each of which only the lobes that may be the highest are looked at.
SECTORS = 512


def with_key(points: DataFrame, finest: F.Column | None = None, roof: float | F.Column = ROOF, tiers=TIERS) -> DataFrame:
    """Points at or below the roof with r, theta, resolution_tier and the cell key. finest: whether r and theta lie in the fine zone, or none for static tiers."""
    rows = points.filter(F.col("z") <= roof).withColumn("r", polar.radius()).withColumn("theta", polar.bearing())
    rows = rows.withColumn("resolution_tier", polar.resolution(F.col("r"), finest, tiers))
    size, r = F.col("resolution_tier"), F.col("r")
    return rows.withColumns({"tier_idx": polar.tier_index(size, tiers), "ring_idx": polar.ring(r, size), "angle_idx": polar.angle_cell(F.col("theta"), size, r)})


def with_lobes(frames: DataFrame, tracks: DataFrame | None, p: Fovea = FOVEA) -> DataFrame:
    """frames with the lobes of their tracks as one array column, so that the fine zone is a fold over it and no join with points."""
    if tracks is None:
        return frames.withColumn("lobes", F.array().cast("array<struct<height:double,at:double,sigma:double,factor:double,cap:double>>"))
    one = lobe(F.struct(F.col("class_id").cast("int").alias("class_id"), "x", "y", "vx", "vy", "bbox_l", "bbox_w"), p)
    made = tracks.select("seq_id", "frame_id", one.alias("lobe")).filter("lobe is not null").groupBy("seq_id", "frame_id").agg(F.collect_list("lobe").alias("lobes"))
    return frames.join(made, ["seq_id", "frame_id"], "left")


def with_foveated_key(points: DataFrame, frames: DataFrame, tracks: DataFrame | None = None, roof=ROOF, p: Fovea = FOVEA, tiers=TIERS) -> DataFrame:
    """with_key, the fine radius from the frame's speed, steering and tracks. A point meets the lobes of its sector, so that its work does not grow with the frame's tracks."""
    state = with_lobes(frames, tracks, p).select("seq_id", "frame_id", "speed_mps", "steering_angle_rad", "lobes")
    rows, on = points.filter(F.col("z") <= roof), ["seq_id", "frame_id"]
    if tracks is not None:
        state = state.withColumn("_sector", F.explode(F.sequence(F.lit(0), F.lit(SECTORS - 1)))).withColumn("lobes", lobes_of_sector(F.col("lobes"), F.col("_sector"), SECTORS))
        rows, on = rows.withColumn("_sector", F.coalesce(sector_of(polar.bearing(), SECTORS), F.lit(0))), [*on, "_sector"]
    rows = rows.join(state, on).drop("_sector")
    finest = in_fine_zone(F.col("r"), F.col("theta"), F.col("speed_mps"), F.col("steering_angle_rad"), None if tracks is None else F.col("lobes"), p)
    return with_key(rows, finest, roof, tiers).drop("speed_mps", "steering_angle_rad", "lobes")


def z_split(points: DataFrame, key: list[str] = CELL, gap: float = OVERHANG_GAP, more: tuple = ()) -> DataFrame:
    """One row a cell: elevation_ground, and elevation_obstacle_bottom and _top where heights part in two layers.

    `more` aggregates are computed beside, in the same grouping.

    Two means per cell by at most ROUNDS assignments, all as windows over one sort of the cells. A
    tie goes to the upper cluster; a cell stops when a cluster is empty or both means settle. Heights are
    added up in ascending order, so that a rerun, or rows dealt otherwise, find the same means to the last bit.
    """
    w = Window.partitionBy(*key).orderBy("z").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = points.withColumn("lo", F.min("z").over(w)).withColumn("hi", F.max("z").over(w))
    rows = rows.withColumn("c1", F.col("lo")).withColumn("c2", F.col("hi")).withColumn("done", F.col("hi") - F.col("lo") < gap)
    for _ in range(ROUNDS):
        first = F.abs(F.col("z") - F.col("c1")) < F.abs(F.col("z") - F.col("c2"))
        rows = rows.withColumn("m1", F.avg(F.when(first, F.col("z"))).over(w)).withColumn("m2", F.avg(F.when(~first, F.col("z"))).over(w))
        empty = F.col("m1").isNull() | F.col("m2").isNull()
        moved = F.greatest(F.abs(F.col("m1") - F.col("c1")), F.abs(F.col("m2") - F.col("c2")))
        stop = F.col("done") | empty
        rows = rows.withColumns({"n1": F.when(stop, F.col("c1")).otherwise(F.col("m1")), "n2": F.when(stop, F.col("c2")).otherwise(F.col("m2")), "d": stop | (moved < SETTLED)})
        rows = rows.withColumns({"c1": F.col("n1"), "c2": F.col("n2"), "done": F.col("d")}).drop("n1", "n2", "d", "m1", "m2")
    first = F.abs(F.col("z") - F.col("c1")) < F.abs(F.col("z") - F.col("c2"))
    of = lambda f, part: f(F.when(part, F.col("z")))
    cells = rows.groupBy(*key).agg(
        F.min("lo").alias("lo"), F.min("hi").alias("hi"),
        of(F.min, first).alias("lo1"), of(F.max, first).alias("hi1"), of(F.avg, first).alias("a1"),
        of(F.min, ~first).alias("lo2"), of(F.max, ~first).alias("hi2"), of(F.avg, ~first).alias("a2"), *more,
    )
    swap = F.col("a1") > F.col("a2")
    pick = lambda a, b: F.when(swap, F.col(a)).otherwise(F.col(b))
    cells = cells.withColumns({"low_min": pick("lo2", "lo1"), "low_max": pick("hi2", "hi1"), "up_min": pick("lo1", "lo2"), "up_max": pick("hi1", "hi2")})
    split = F.coalesce((F.col("hi") - F.col("lo") >= gap) & (F.col("up_min") - F.col("low_max") > gap), F.lit(False))
    own = [c for c in cells.columns[len(key) + 8 :] if c not in ("low_min", "low_max", "up_min", "up_max")]
    return cells.select(
        *key, *own, F.when(split, F.col("low_min")).otherwise(F.col("lo")).alias("elevation_ground"),
        F.when(split, F.col("up_min")).alias("elevation_obstacle_bottom"), F.when(split, F.col("up_max")).alias("elevation_obstacle_top"),
    )


def majority_class(points: DataFrame, key: list[str] = CELL) -> DataFrame:
    """Most frequent class of each cell; on ties the lowest id, -1 first."""
    counts = points.groupBy(*key, "class_id").agg(F.count(F.lit(1)).alias("n"))
    best = F.max(F.struct("n", (-F.col("class_id")).alias("neg")))
    return counts.groupBy(*key).agg((-best["neg"]).cast("int").alias("semantic_class"), F.sum("n").alias("point_count"))


def grid_cells(keyed: DataFrame) -> DataFrame:
    """The cells of keyed points. One shuffle on the cell serves the windows and all aggregates."""
    cells = z_split(keyed, more=(
        F.mode("class_id", True).cast("int").alias("semantic_class"), F.count(F.lit(1)).alias("point_count"), F.avg("r").alias("mean_r"), F.first("resolution_tier").alias("resolution_tier"),
    ))
    return cells.select(
        *CELL, "elevation_ground", "elevation_obstacle_bottom", "elevation_obstacle_top", "semantic_class", "point_count",
        polar.confidence(F.col("point_count"), F.col("mean_r")).alias("confidence"), F.col("frame_id").alias("last_updated_frame"), "resolution_tier",
    )


def with_center(cells: DataFrame) -> DataFrame:
    return cells.withColumns(polar.center())


# The same as text for other engines.

KEY_SQL = f"""SELECT *, CASE resolution_tier WHEN CAST({TIERS[0][1]} AS DOUBLE) THEN 0 WHEN CAST({TIERS[1][1]} AS DOUBLE) THEN 1 ELSE 2 END AS tier_idx,
  CAST(trunc(r / resolution_tier) AS BIGINT) AS ring_idx, CAST(trunc(theta / (resolution_tier / greatest(r, {LEAST_RANGE}::DOUBLE))) AS BIGINT) AS angle_idx
FROM (SELECT *, CASE WHEN r < {{fine}} THEN {TIERS[0][1]}::DOUBLE WHEN r < {TIERS[1][0]} THEN {TIERS[1][1]}::DOUBLE ELSE {TIERS[2][1]}::DOUBLE END AS resolution_tier
  FROM (SELECT *, sqrt(x*x + y*y) AS r, atan2(y, x) AS theta FROM {{points}} WHERE z <= {ROOF}))"""
STATIC_KEY_SQL = KEY_SQL.format(fine=TIERS[0][0], points="points_v")
