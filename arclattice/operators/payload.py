"""Frame payloads: one nested row a frame, as JSON lines or compressed messages."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import FOVEA, Fovea
from ..functions.fovea import polyline
from .checkpoint import kept
from .metrics import memory
from .project import with_center, with_lobes
from .track import moving_objects

FRAME = ["seq_id", "frame_id"]


def frame_payload(frames: DataFrame, cells: DataFrame, tracks: DataFrame, ghosts: DataFrame, latency_ms: float = 0.0, p: Fovea = FOVEA) -> DataFrame:
    """A row for each frame: vehicle, fovea, cells, tracks and metrics. Cells stay a table of their own elsewhere; this is their last form."""
    cut = lambda c, n: F.bround(c, n)
    placed = with_center(cells)
    cell = F.struct(
        "ring_idx", "angle_idx", *[cut(F.col(c), 3).alias(c) for c in ("elevation_ground", "elevation_obstacle_bottom", "elevation_obstacle_top")],
        "semantic_class", cut(F.col("confidence"), 2).alias("confidence"), cut(F.col("resolution_tier"), 2).alias("resolution_tier"), *[cut(F.col(c), 3).alias(c) for c in ("x", "y", "r", "theta")],
    )
    all_cells = placed.groupBy(*FRAME).agg(F.array_sort(F.collect_list(cell)).alias("cells"))
    pair = lambda a, b: F.array(a, b)
    one = F.struct(
        "track_id", pair("x", "y").alias("position_xy"), pair("vx", "vy").alias("velocity_xy"), pair("pred_x", "pred_y").alias("predicted_next_xy"), "class_id", "frames_since_seen",
        pair("bbox_l", "bbox_w").alias("bbox_size_xy"), "state", "hits",
    )
    all_tracks = tracks.groupBy(*FRAME).agg(F.array_sort(F.collect_list(one)).alias("track_list"))
    moving = moving_objects(tracks).groupBy(*FRAME).agg(F.count_if("is_moving").alias("moving"))
    rows = with_lobes(frames, tracks, p)
    for other in (all_cells, all_tracks, moving, memory(cells, FRAME), ghosts.select(*FRAME, "ghosts")):
        rows = rows.join(other, FRAME, "left")
    count = lambda c: F.coalesce(c, F.lit(0))
    params = {
        "base_fine_radius_m": p.base_radius, "max_stretch": p.max_stretch, "shear_strength": p.drawn_shear, "motion_foveation_enabled": p.enabled, "collision_focus_only": p.collision_only,
        "corridor_half_width_m": p.corridor, "max_threat_distance_m": p.farthest_threat, "motion_speed_threshold_mps": p.moving_speed, "motion_lead_time_s": p.lead_time,
        "motion_buffer_m": p.buffer, "motion_acuity_boost": p.boost,
    }
    metrics = F.struct(
        F.lit(1000 / max(latency_ms, 1e-3)).alias("fps"), F.lit(latency_ms).alias("latency_ms"), count("memory_bytes_foveated").alias("memory_bytes_foveated"),
        count("memory_bytes_uniform_baseline").alias("memory_bytes_uniform_baseline"), count("memory_savings_pct").alias("memory_savings_pct"), count("ghosts").alias("ghosting_cells_erased"),
        count("active_cells").alias("active_cells_count"), count("moving").alias("moving_objects_count"), (count("moving") > 0).alias("motion_foveation_active"),
    )
    return rows.select(
        "seq_id", "frame_id", F.col("timestamp_s").alias("timestamp"), "scenario_name", "description",
        F.struct(cut(F.col("speed_mps"), 2).alias("speed_mps"), cut(F.col("steering_angle_rad"), 4).alias("steering_angle_rad")).alias("vehicle_state"),
        F.struct(*[F.lit(v).alias(k) for k, v in params.items()]).alias("foveation_params"), polyline(lobes=F.col("lobes"), p=p).alias("fovea_polyline"),
        F.coalesce("cells", F.array()).alias("cells"), F.coalesce("track_list", F.array()).alias("tracks"), metrics.alias("metrics"),
    )


def write_payload(payload: DataFrame, path: str, most_frames: int | None = None, again: bool = False) -> None:
    """JSON lines by sequence. An existing table is kept unless `again`."""
    rows = payload if most_frames is None else payload.filter(F.col("frame_id") < most_frames)
    rows.write.mode("overwrite" if again else "ignore").partitionBy("seq_id").json(path)


def written_frames(spark, path: str, like: DataFrame) -> DataFrame:
    """(seq_id, frame_id) that export_missing has written below path, in the types of `like`; files are listed, not read."""
    from pyspark.errors import AnalysisException

    kinds = dict(like.dtypes)
    try:
        found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").load(path).select("path")
        found.schema  # noqa: B018
    except AnalysisException:
        return like.select(*FRAME).limit(0)
    part = lambda name: F.regexp_extract("path", f"{name}=([^/]+)/", 1)
    return found.select(*[part(c).cast(kinds[c]).alias(c) for c in FRAME]).distinct()


def export_missing(frames: DataFrame, compute: Callable[[DataFrame], DataFrame], path: str) -> None:
    """Writes the payloads of those frames that path lacks, a folder each; others are neither computed nor touched.

    compute: the payloads of some frames.
    """
    missing = kept(frames.join(written_frames(frames.sparkSession, path, frames), FRAME, "left_anti"))
    if not missing.isEmpty():
        compute(missing).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*FRAME).json(path)


def read_payload(spark, path: str, schema) -> DataFrame | None:
    """The written frames, or None where there are none."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)
    except AnalysisException:
        return None


def compressed(payload: DataFrame, level: int = 1) -> DataFrame:
    """(seq_id, frame_id, message): the row as JSON, compressed for the wire."""

    def deflate(batches):
        for b in batches:
            sent = pa.array([zlib.compress(t.encode(), level) for t in b.column("text").to_pylist()], pa.binary())
            yield pa.record_batch([b.column("seq_id"), b.column("frame_id"), sent], ["seq_id", "frame_id", "message"])

    kinds = dict(payload.dtypes)
    rows = payload.select("seq_id", "frame_id", F.to_json(F.struct(*payload.columns)).alias("text"))
    return rows.mapInArrow(deflate, f"seq_id {kinds['seq_id']}, frame_id {kinds['frame_id']}, message binary")


def with_stream_metrics(payload: DataFrame, latency_ms: float, stream_ms: float) -> DataFrame:
    """Adds the rates of the pipeline and of the stream to metrics."""
    m = F.col("metrics")
    for name, v in (("pipeline_latency_ms", latency_ms), ("pipeline_fps", 1000 / max(latency_ms, 1e-3)), ("stream_latency_ms", stream_ms), ("stream_fps", 1000 / max(stream_ms, 1e-3))):
        m = m.withField(name, F.lit(float(v)))
    return payload.withColumn("metrics", m)


#: A benchmark export of more bytes is taken for another one and written again.
MOST_BENCHMARK_BYTES = 100 << 20


def written_bytes(spark, path: str) -> int:
    """Bytes of the files below path, 0 where there is none."""
    from pyspark.errors import AnalysisException

    try:
        found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("length")
        return found.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    except AnalysisException:
        return 0


def export_benchmark(payload: DataFrame, path: str, frames: int = 30, again: bool = False) -> bool:
    """Writes the first frames of the benchmark drive unless a file of credible size is there; whether it wrote."""
    there = written_bytes(payload.sparkSession, path)
    if 0 < there < MOST_BENCHMARK_BYTES and not again:
        return False
    payload.filter(F.col("frame_id") < frames).write.mode("overwrite").json(path)
    return True


def export_all(payloads: dict[str, DataFrame], folder: str, frames: int | None = None, again: bool = False) -> dict[str, bool]:
    """Writes the payload of every sequence below folder, each under its name; which ones it wrote."""
    wrote = {}
    for name, payload in payloads.items():
        path = f"{folder}/{name}"
        wrote[name] = again or not written_bytes(payload.sparkSession, path)
        if wrote[name]:
            rows = payload if frames is None else payload.filter(F.col("frame_id") < frames)
            rows.write.mode("overwrite").json(path)
    return wrote
