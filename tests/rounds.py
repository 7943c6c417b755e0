"""The feedback loop as rounds of plans, a frame of all sequences at a time: what operators.loop is compared with."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arclattice.config import HYSTERESIS, Fovea
from arclattice.functions import polar
from arclattice.functions.fovea import fine_radius
from arclattice.operators import cluster, project
from arclattice.operators.checkpoint import kept
from arclattice.operators.track import Track, ghost_counts, footprints, track_step, vacated

FIELDS = list(Track.__dataclass_fields__)
TRACK = (
    "track_id long, class_id int, x double, y double, vx double, vy double, pred_x double, pred_y double, frames_since_seen int, state string, hits int, "
    "bbox_l double, bbox_w double, p_pos double, p_cross double, p_vel double"
)


def held_radii(points: DataFrame, held: DataFrame) -> tuple[DataFrame, DataFrame]:
    """points with fine held by sector, and the new held radii (seq_id, sector, held); sectors without points keep theirs."""
    points = points.withColumn("sector", F.rint(F.col("theta") / HYSTERESIS.sector).cast("long"))
    means = points.groupBy("seq_id", "sector").agg(F.avg("fine").alias("mean"))
    both = means.join(held, ["seq_id", "sector"], "full")
    stay = F.col("mean").isNull() | (F.abs(F.col("mean") - F.col("held")) < HYSTERESIS.radius_margin)
    new = both.select("seq_id", "sector", F.when(stay & F.col("held").isNotNull(), F.col("held")).otherwise(F.col("mean")).alias("held"))
    new = kept(new)
    return points.drop("fine").join(new.withColumnRenamed("held", "fine"), ["seq_id", "sector"]), new


def cells_of(points: DataFrame, frames: DataFrame, tracks: DataFrame, held: DataFrame, p: Fovea) -> tuple[DataFrame, DataFrame]:
    state = project.with_lobes(frames, tracks, p).select("seq_id", "frame_id", "speed_mps", "steering_angle_rad", "lobes", "roof")
    rows = points.join(state, ["seq_id", "frame_id"]).filter("z <= roof").withColumn("theta", polar.bearing())
    rows = rows.withColumn("fine", fine_radius("theta", lobes=F.col("lobes"), p=p)).drop("lobes", "speed_mps", "steering_angle_rad")
    rows, held = held_radii(rows, held)
    return kept(project.grid_cells(project.with_key(rows, F.col("r") < F.col("fine"), F.col("roof")))), held


def next_tracks(tracks: DataFrame, cells: DataFrame, frame_id: int, seq_kind: str) -> DataFrame:
    dynamic = project.with_center(cells.filter("semantic_class = 3")).select("seq_id", "x", "y", F.col("semantic_class").alias("class_id"), polar.cell_id(F.col("tier_idx"), F.col("ring_idx"), F.col("angle_idx")).alias("cell"))
    found = cluster.clusters(dynamic, ["seq_id"], "cell")

    def run(key, old: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
        new = new.sort_values(["x", "y"])
        state = track_step([Track(*r) for r in old[FIELDS].itertuples(index=False)], list(zip(new.x, new.y, new.class_id.astype(int), strict=True)))
        return pd.DataFrame([(key[0], frame_id, *(getattr(t, f) for f in FIELDS)) for t in state], columns=["seq_id", "frame_id", *FIELDS])

    joined = tracks.groupBy("seq_id").cogroup(found.groupBy("seq_id"))
    return kept(joined.applyInPandas(run, f"seq_id {seq_kind}, frame_id int, {TRACK}"))


def closed_loop(points: DataFrame, frames: DataFrame, p: Fovea = Fovea()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(cells, tracks, ghosts) of all frames. frames: seq_id, frame_id, speed_mps, steering_angle_rad and roof.

    The first frame is projected again once its tracks are known, and its sectors are held twice.
    """
    spark = points.sparkSession
    kind = dict(frames.dtypes)["seq_id"]
    tracks = spark.createDataFrame([], f"seq_id {kind}, frame_id int, {TRACK}")
    held = spark.createDataFrame([], f"seq_id {kind}, sector long, held double")
    numbers = [r[0] for r in frames.select("frame_id").distinct().orderBy("frame_id").collect()]
    all_cells, all_tracks = [], []
    for i, f in enumerate(numbers):
        now, state = points.filter(F.col("frame_id") == f), frames.filter(F.col("frame_id") == f)
        seen = lambda t: t.withColumn("frame_id", F.lit(f))  # noqa: B023, E731
        cells, held = cells_of(now, state, seen(tracks), held, p)
        tracks = next_tracks(tracks, cells, f, kind)
        if i == 0:
            cells, held = cells_of(now, state, seen(tracks), held, p)
        all_cells.append(cells)
        all_tracks.append(tracks)
    cells, tracks = all_cells[0], all_tracks[0]
    for c, t in zip(all_cells[1:], all_tracks[1:], strict=True):
        cells, tracks = cells.unionByName(c), tracks.unionByName(t)
    centred = project.with_center(cells).withColumnRenamed("x", "cx").withColumnRenamed("y", "cy")
    prints = footprints(tracks, centred)
    return cells, tracks, ghost_counts(vacated(prints, frames, cells), frames)
