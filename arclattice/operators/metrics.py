"""Evaluation: IoU overall and by distance, memory, histograms and stage timing."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..config import CELL_BYTES
from ..functions import polar

BUCKETS = ((0.0, 10.0), (10.0, 30.0), (30.0, 100.0))


def miou(rows: DataFrame, classes: int = 4, by: list[str] | None = None) -> DataFrame:
    """IoU of pred against gt for every class from 0, absent ones too, and their mean as class -1. Rows with gt -1 do not count."""
    by = by or []
    return ious(rows.filter("gt <> -1").groupBy(*by).agg(counts(classes)), classes, by)


def counts(classes: int) -> F.Column:
    """Aggregate `all`: an array of the hits and misses of every class."""
    sums = []
    for c in range(classes):
        p, g = F.col("pred") == c, F.col("gt") == c
        sums.append(F.struct(F.lit(c).alias("class_id"), F.count_if(p & g).alias("tp"), F.count_if(p & ~g).alias("fp"), F.count_if(~p & g).alias("fn")))
    return F.array(*sums).alias("all")


def ious(wide: DataFrame, classes: int, by: list[str]) -> DataFrame:
    """(by, class_id, iou) of rows (by, all), the mean as class -1."""
    union = lambda s: s["tp"] + s["fp"] + s["fn"]
    iou = F.transform("all", lambda s: F.struct(s["class_id"].alias("class_id"), F.when(union(s) == 0, 0.0).otherwise(s["tp"] / union(s)).alias("iou")))
    wide = wide.withColumn("iou", iou)
    mean = F.aggregate("iou", F.lit(0.0), lambda a, s: a + s["iou"]) / classes
    long = wide.withColumn("s", F.explode(F.concat("iou", F.array(F.struct(F.lit(-1).alias("class_id"), mean.alias("iou"))))))
    return long.select(*by, "s.class_id", "s.iou")


def evaluation(rows: DataFrame, classes: int = 4) -> DataFrame:
    """miou of rows (seq_id, frame_id, x, y, pred, gt) by frame, by distance and of all, by level: one scan and one exchange.

    Rows beyond all buckets count for their frame and the whole only. points: how many rows with a known class there are.
    """
    known = rows.filter("gt <> -1").select("seq_id", "frame_id", distance_name().alias("bucket"), "pred", "gt")
    sets = known.groupingSets([["seq_id", "frame_id"], ["bucket"], []], "seq_id", "frame_id", "bucket")
    wide = sets.agg(counts(classes), F.count(F.lit(1)).alias("points"), F.grouping_id("seq_id", "frame_id", "bucket").alias("_set"))
    level = F.when(F.col("_set") == 1, "frame").when(F.col("_set") == 6, "distance").otherwise("all")
    wide = wide.withColumn("level", level).filter("level <> 'distance' or bucket is not null")
    return ious(wide, classes, ["level", "seq_id", "frame_id", "bucket", "points"]).withColumn("iou", F.round("iou", 6))


def distance_name(buckets=BUCKETS) -> F.Column:
    """The name of a half-open distance bucket, like 0-10m, or null."""
    r, name = polar.radius(), None
    for lo, hi in buckets:
        here = (r >= lo) & (r < hi)
        label = f"{int(lo)}-{int(hi)}m"
        name = F.when(here, label) if name is None else name.when(here, label)
    return name


def bucketed(rows: DataFrame, buckets=BUCKETS) -> DataFrame:
    """Rows (x, y, ...) in a distance bucket."""
    return rows.withColumn("bucket", distance_name(buckets)).filter("bucket is not null")


def miou_by_distance(rows: DataFrame, classes: int = 3, buckets=BUCKETS) -> DataFrame:
    """miou within every bucket, also an empty one if there are rows at all."""
    found = miou(bucketed(rows, buckets), classes, ["bucket"])
    names = F.array(*[F.lit(f"{int(lo)}-{int(hi)}m") for lo, hi in buckets])
    ids = F.array(*[F.lit(c) for c in [*range(classes), -1]])
    every = rows.limit(1).select(F.explode(names).alias("bucket")).select("bucket", F.explode(ids).alias("class_id"))
    return every.join(found, ["bucket", "class_id"], "left").select("bucket", "class_id", F.coalesce("iou", F.lit(0.0)).alias("iou"))


def memory(cells: DataFrame, by: list[str]) -> DataFrame:
    """Bytes of the cells, of a uniform grid of the finest size over the same area, and the saving in percent."""
    n, uniform = F.count(F.lit(1)), F.sum(polar.fine_cells(F.col("resolution_tier")))
    out = cells.groupBy(*by).agg(n.alias("active_cells"), (n * CELL_BYTES).alias("memory_bytes_foveated"), (F.greatest(uniform, n * 9) * CELL_BYTES).alias("memory_bytes_uniform_baseline"))
    saving = (1.0 - F.col("memory_bytes_foveated") / F.col("memory_bytes_uniform_baseline")) * 100.0
    return out.withColumn("memory_savings_pct", F.round(F.least(F.greatest(saving, F.lit(0.0)), F.lit(99.9)), 1))


def uniform_baseline_bytes(radius_m: float = 100.0, cell_m: float = 0.05) -> int:
    return int(3.141592653589793 * radius_m**2 / cell_m**2) * CELL_BYTES


def class_histogram(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    return rows.groupBy(*(by or []), "class_id").agg(F.count(F.lit(1)).alias("n"))


def overhang_counts(cells: DataFrame, by: list[str]) -> DataFrame:
    both = F.col("elevation_obstacle_bottom").isNotNull() & F.col("elevation_obstacle_top").isNotNull()
    return cells.groupBy(*by, "semantic_class").agg(F.count(F.lit(1)).alias("n"), F.count_if(both).alias("overhangs"))


def slabs(cells: DataFrame) -> DataFrame:
    """Heights and centres of the boxes that show a cell and its overhang."""
    height = F.when(F.col("semantic_class") == 2, 1.5).when(F.col("semantic_class") == 3, 1.2).otherwise(0.12)
    over = F.greatest(F.lit(0.2), F.col("elevation_obstacle_top") - F.col("elevation_obstacle_bottom"))
    return cells.withColumns({
        "slab_height": height, "slab_z": F.col("elevation_ground") + height / 2, "slab_width": F.col("resolution_tier") * 0.95,
        "overhang_height": F.when(F.col("elevation_obstacle_bottom").isNotNull(), over), "overhang_z": F.col("elevation_obstacle_bottom") + over / 2,
    })


def observed(cells: DataFrame) -> tuple[DataFrame, Observation]:
    """cells, and what they will have been when an action has run over them: no job is run for the figures alone."""
    seen = Observation()
    n, uniform = F.count(F.lit(1)), F.sum(polar.fine_cells(F.col("resolution_tier")))
    hangs = F.count_if(F.col("elevation_obstacle_bottom").isNotNull() & F.col("elevation_obstacle_top").isNotNull())
    return cells.observe(seen, n.alias("active_cells"), F.coalesce(uniform, F.lit(0)).alias("fine_cells"), hangs.alias("overhangs"), F.count_if(F.col("semantic_class") == 3).alias("dynamic_cells")), seen


def observed_memory(seen: Observation) -> dict[str, float]:
    """The figures of `memory` for all cells of an observation whose action is over."""
    got = seen.get
    used, uniform = got["active_cells"] * CELL_BYTES, max(got["fine_cells"], got["active_cells"] * 9) * CELL_BYTES
    saved = round(min(max((1 - used / uniform) * 100, 0.0), 99.9), 1) if uniform else 0.0
    return {"active_cells": got["active_cells"], "memory_bytes_foveated": used, "memory_bytes_uniform_baseline": uniform, "memory_savings_pct": saved}


#: Marks of an evaluation: frames a second and percent of memory saved.
LEAST_FPS, LEAST_SAVING = 5.0, 85.0


def report(labels: DataFrame, cells: DataFrame, stages: dict[str, Callable[[], DataFrame]], frames: int, runs: int = 3) -> DataFrame:
    """(part, name, value, passed): quality, times and memory of a run, passed null where there is no mark.

    labels: x, y, gt, pred. Stages are run in full, their milliseconds divided among the frames.
    """
    value = lambda part, name, v, ok=None: F.struct(F.lit(part).alias("part"), name.alias("name"), v.cast("double").alias("value"), F.lit(ok).cast("boolean").alias("passed"))
    spark = labels.sparkSession
    quality = miou(labels).select(value("miou", F.when(F.col("class_id") < 0, "mean").otherwise(F.concat(F.lit("class "), "class_id")), F.col("iou")).alias("s")).select("s.*")
    by = miou_by_distance(labels).filter("class_id = -1").select(value("miou by distance", F.col("bucket"), F.col("iou")).alias("s")).select("s.*")
    took = {n: profile(s, runs)["mean"] / max(1, frames) for n, s in stages.items()}
    total = sum(took.values())
    fps = 1000 / max(total, 1e-3)
    times = [("ms a frame", n, float(t), None) for n, t in took.items()] + [("ms a frame", "total", float(total), None), ("throughput", "frames a second", float(fps), fps >= LEAST_FPS)]
    timed = spark.createDataFrame(times, "part string, name string, value double, passed boolean")
    held = memory(cells, [])
    names = ["active_cells", "memory_bytes_foveated", "memory_bytes_uniform_baseline", "memory_savings_pct"]
    rows = F.array(*[F.struct(F.lit("memory").alias("part"), F.lit(n).alias("name"), F.col(n).cast("double").alias("value"), (F.col(n) >= LEAST_SAVING if n.endswith("pct") else F.lit(None).cast("boolean")).alias("passed")) for n in names])
    return quality.unionByName(by).unionByName(timed).unionByName(held.select(F.inline(rows)))


def profile(stage: Callable[[], DataFrame], runs: int = 3) -> dict[str, float]:
    """mean, min and max milliseconds and runs a second of a stage that is run in full; a warm-up run if runs > 1."""
    if runs <= 0:
        return {}
    took = []
    for i in range(runs + (runs > 1)):
        began = time.perf_counter()
        stage().write.format("noop").mode("overwrite").save()
        if i or runs == 1:
            took.append((time.perf_counter() - began) * 1000)
    mean = sum(took) / len(took)
    return {"mean": mean, "min": min(took), "max": max(took), "fps": 1000 / max(mean, 1e-3)}
