"""python -m arclattice eval|export: a report on the scans of a folder, or their frames as payloads.

    eval   --scans ROOT [--sequence 00 ...] [--frames N] [--config FILE]
    export --scans ROOT --out FOLDER [--sequence 00 ...] [--frames N] [--config FILE] [--again]

Scans without poses move at 10 m/s straight on. An export writes only frames that the folder lacks, or all with --again.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import config
from .functions import labels
from .operators import loop, metrics, payload, segment
from .operators.checkpoint import kept
from .sources import frames


def scans_of(spark: SparkSession, args) -> DataFrame:
    points = frames.load_scans(spark, args.scans)
    points = points.filter(F.col("seq_id").isin(args.sequence)) if args.sequence else points
    return points.filter(F.col("frame_id") < args.frames) if args.frames else points


def states_of(points: DataFrame) -> DataFrame:
    """A vehicle state for each frame."""
    at = points.select("seq_id", "frame_id").distinct()
    return at.withColumns({"speed_mps": F.lit(10.0), "steering_angle_rad": F.lit(0.0), "roof": F.lit(config.ROOF), "timestamp_s": F.col("frame_id") * config.DT, "scenario_name": F.concat(F.lit("sequence "), "seq_id"), "description": F.lit("")})


def payloads(points: DataFrame, states: DataFrame, settings: dict) -> DataFrame:
    cells, tracks, ghosts = loop.closed_loop(kept(segment.classified(points.drop("instance"))), states, settings["fovea"])
    return payload.frame_payload(states, cells, tracks, ghosts, p=settings["fovea"])


def evaluate(spark: SparkSession, args, settings: dict) -> DataFrame:
    """The segmenter against the labels of the scans, and the memory of their cells."""
    points = kept(scans_of(spark, args))
    found = segment.heuristic_labels(points, p=settings["segmentation"])
    judged = kept(found.select("seq_id", "frame_id", "x", "y", labels.collapse("class_id", settings["class_map"]).alias("gt"), F.col("label").alias("pred")))
    states = states_of(points)
    cells, _, _ = loop.closed_loop(kept(segment.classified(points.drop("instance"))), states, settings["fovea"])
    return metrics.report(judged, cells, {"segmentation": lambda: found}, states.count(), runs=1)


def export(spark: SparkSession, args, settings: dict) -> DataFrame:
    """(seq_id, frame_id) of the frames in the folder afterwards."""
    points = scans_of(spark, args)
    states = states_of(points)
    compute = lambda some: payloads(points.join(some.select("seq_id").distinct(), "seq_id", "left_semi"), states.join(some.select("seq_id").distinct(), "seq_id", "left_semi"), settings).join(some.select("seq_id", "frame_id"), ["seq_id", "frame_id"], "left_semi")
    if args.again:
        compute(states).write.mode("overwrite").partitionBy("seq_id", "frame_id").json(args.out)
    else:
        payload.export_missing(states, compute, args.out)
    return payload.written_frames(spark, args.out, states)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> DataFrame:
    parser = argparse.ArgumentParser(prog="arclattice")
    parser.add_argument("what", choices=["eval", "export"])
    parser.add_argument("--scans", required=True)
    parser.add_argument("--out")
    parser.add_argument("--sequence", action="append", type=lambda s: s.zfill(2))
    parser.add_argument("--frames", type=int)
    parser.add_argument("--config", default="")
    parser.add_argument("--again", action="store_true")
    args = parser.parse_args(argv)
    if args.what == "export" and not args.out:
        parser.error("export needs --out")
    spark = spark or SparkSession.builder.appName("arclattice").getOrCreate()
    done = (evaluate if args.what == "eval" else export)(spark, args, config.load(args.config))
    done.orderBy(*done.columns[:2]).show(1000, truncate=False)
    return done


if __name__ == "__main__":
    main()
