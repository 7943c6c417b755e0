"""Operators with memory from frame to frame, as windows where rules allow and as scans where not."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import HYSTERESIS, ROOF, TIERS, Hysteresis
from .scan import scan


def hold(previous: float | None, new: float | None, margin: float = HYSTERESIS.radius_margin) -> float | None:
    """The previous value while the new one is less than margin away, or null."""
    return previous if previous is not None and (new is None or abs(new - previous) < margin) else new


def sector_means(points: DataFrame, p: Hysteresis = HYSTERESIS) -> DataFrame:
    """Mean fine radius by frame and angular sector of points (seq_id, frame_id, theta, fine)."""
    sector = F.rint(F.col("theta") / p.sector).cast("long")
    return points.groupBy("seq_id", "frame_id", sector.alias("sector")).agg(F.avg("fine").alias("radius"))


def radius_hold(sectors: DataFrame, keys: list[str] = ["seq_id", "sector"], p: Hysteresis = HYSTERESIS) -> DataFrame:  # noqa: B006
    """sectors (keys, frame_id, radius) with the held radius."""

    def step(held, radius):
        held = hold(held, radius, p.radius_margin)
        return held, (held,)

    return scan(sectors, keys, ["frame_id"], ["radius"], step, "held double")


def smoothed(points: DataFrame, p: Hysteresis = HYSTERESIS) -> DataFrame:
    """points (seq_id, frame_id, theta, fine, ...) with fine replaced by their sector's held mean."""
    held = radius_hold(sector_means(points, p), p=p).select("seq_id", "frame_id", "sector", "held")
    rows = points.withColumn("sector", F.rint(F.col("theta") / p.sector).cast("long"))
    return rows.join(held, ["seq_id", "frame_id", "sector"]).withColumn("fine", F.col("held")).drop("sector", "held")


def schmitt_tier(rows: DataFrame, keys: list[str], boundary: float = TIERS[0][0], p: Hysteresis = HYSTERESIS) -> DataFrame:
    """rows (keys, frame_id, range_m) with the tier size that changes only beyond the margin.

    The first row of a key goes by the boundary itself, so the state is the last decisive event.
    """
    inner, outer = TIERS[0][1], TIERS[1][1]
    w = Window.partitionBy(*keys).orderBy("frame_id")
    r = F.col("range_m")
    event = F.when(r > boundary + p.radius_margin, outer).when(r < boundary - p.radius_margin, inner)
    event = F.when(F.row_number().over(w) == 1, F.when(r < boundary, inner).otherwise(outer)).otherwise(event)
    return rows.withColumn("_event", event).withColumn("tier", F.last("_event", ignorenulls=True).over(w)).drop("_event")


def run_length(rows: DataFrame, keys: list[str], order: list[str], holds: F.Column, name: str) -> DataFrame:
    """rows with how many rows in a row, up to and with this one, the condition has held."""
    w = Window.partitionBy(*keys).orderBy(*order)
    rows = rows.withColumn("_holds", holds).withColumn("_island", F.sum(F.when(F.col("_holds"), 0).otherwise(1)).over(w))
    inside = Window.partitionBy(*keys, "_island").orderBy(*order)
    count = F.sum(F.when(F.col("_holds"), 1).otherwise(0)).over(inside)
    return rows.withColumn(name, count).drop("_holds", "_island")


def degraded(cells: DataFrame, p: Hysteresis = HYSTERESIS) -> DataFrame:
    """cells with sparse ones marked down once their (ring, angle) was sparse in so many appearances in a row.

    The tier is no part of the place: two tiers that share it count in the order of their index.
    """
    rows = run_length(cells, ["seq_id", "ring_idx", "angle_idx"], ["frame_id", "tier_idx"], F.col("point_count") < p.least_points, "_low")
    bad = F.col("_low") >= p.degraded_after
    return rows.withColumns({
        "point_count": F.when(bad, F.lit(3).cast("long")).otherwise(F.col("point_count")), "confidence": F.when(bad, 0.3).otherwise(F.col("confidence")),
        "resolution_tier": F.when(bad, TIERS[-1][1]).otherwise(F.col("resolution_tier")), "degraded": bad,
    }).drop("_low")


def z_clip(rows: DataFrame, keys: list[str], roof: float = ROOF, p: Hysteresis = HYSTERESIS) -> DataFrame:
    """rows (keys, frame_id, z_max) with clipped: beyond the margin at once, within it from the second frame on."""
    above = F.col("z_max") > roof
    rows = run_length(rows, keys, ["frame_id"], above, "above_frames")
    return rows.withColumn("clipped", (F.col("z_max") > roof + p.clip_margin) | (above & (F.col("above_frames") >= p.clip_after)))


def ema(rows: DataFrame, keys: list[str], values: Iterable[str], alpha: float = 0.35) -> DataFrame:
    """rows (keys, frame_id, values) smoothed: alpha of the previous result and the rest of the new value."""
    values = list(values)

    def step(was, *row):
        now = row if was is None else tuple(a * alpha + b * (1 - alpha) for a, b in zip(was, row, strict=True))
        return now, now

    out = scan(rows, keys, ["frame_id"], values, step, ", ".join(f"_{v} double" for v in values))
    return out.select(*keys, "frame_id", *[F.col(f"_{v}").alias(v) for v in values])


def cumulative_ghosts(frames: DataFrame, keys: list[str] = ["seq_id"]) -> DataFrame:  # noqa: B006
    """frames (keys, position, frame_id, ghosts) with a running total that restarts when frame_id is 0 or goes back."""
    w = Window.partitionBy(*keys).orderBy("position")
    back = (F.col("frame_id") == 0) | (F.col("frame_id") < F.lag("frame_id").over(w))
    rows = frames.withColumn("_run", F.sum(F.when(back, 1).otherwise(0)).over(w))
    inside = Window.partitionBy(*keys, "_run").orderBy("position")
    return rows.withColumn("total_ghosts", F.sum("ghosts").over(inside)).drop("_run")
