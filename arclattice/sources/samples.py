"""Two small made-up recordings with raw labels: a drive of 30 frames and a single test scan.

Parts and draws are as in scenarios, whose hashes they share, but labels are words of the label files:
a raw class and, above 16 bits, an instance.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scenarios import T, _draw, n, u


def at(value):
    """Always the value, a number or an expression of frame_id, x, y and j, the point's number in its part."""
    return u(value, value)


SLOPE = "0.005D * x"
#: Parts (points, raw class, instance, x, y, z, intensity) of a frame of the drive. Numbers are fixed values.
DRIVE = [
    (6000, 40, 0, u(-10, 55), u(-4, 4), n(f"-1.5D + {SLOPE}", 0.02), u(0.1, 0.3)),
    (1500, 48, 0, u(-10, 55), u(4, 7.5), n(f"-1.35D + {SLOPE}", 0.02), u(0.2, 0.4)),
    (1500, 48, 0, u(-10, 55), u(-7.5, -4), n(f"-1.35D + {SLOPE}", 0.02), u(0.2, 0.4)),
    (1250, 50, 0, u(-5, 50), u(8, 8.5), u(-1.3, 2.5), u(0.5, 0.9)),
    (1250, 50, 0, u(-5, 50), u(-8.5, -8), u(-1.3, 2.5), u(0.5, 0.9)),
    *[(80, 80, 0, n(x, 0.05), n(y, 0.05), u(-1.35, 1.5), u(0.7, 1.0)) for x, y in ((10.0, 4.2), (25.0, 4.2), (40.0, 4.2), (15.0, -4.2), (30.0, -4.2))],
    (400, 10, 1, u(f"13.0D + 8 * {T}", f"17.0D + 8 * {T}"), u(0.9, 2.7), u(-1.4, 0.2), u(0.4, 0.8)),
    (350, 10, 2, u(f"43.0D - 10 * {T}", f"47.0D - 10 * {T}"), u(-2.7, -0.9), u(-1.4, 0.2), u(0.4, 0.8)),
    (120, 30, 3, u(7.7, 8.3), u(f"5.2D - 0.8D * {T}", f"5.8D - 0.8D * {T}"), u(-1.35, 0.4), u(0.3, 0.7)),
]
#: The same of the test scan: ground, pole, walker, curb, sign, ground below the sign, far car.
SCAN = [
    (4000, 40, 0, u(-60, 60), u(-60, 60), n(0.0, 0.05), u(0.2, 0.4)),
    (50, 80, 0, n(5.0, 0.02), n(2.0, 0.02), at("3.0D * j / 49"), at(0.8)),
    (100, 30, 0, n(8.0, 0.2), n(-3.0, 0.2), u(0.0, 1.8), u(0.1, 0.3)),
    (200, 40, 0, n(12.0, 0.05), at("20.0D * j / 199 - 10"), n(0.15, 0.02), at(0.5)),
    (80, 81, 0, n(20.0, 0.05), at("3.0D * j / 79 - 1.5D"), n(2.3, 0.1), at(0.9)),
    (80, 40, 0, n(20.0, 0.05), at("3.0D * j / 79 - 1.5D"), n(0.0, 0.02), at(0.3)),
    (300, 10, 0, n(70.0, 1.0), n(5.0, 0.8), u(0.0, 1.5), u(0.4, 0.7)),
]


def _points(spark: SparkSession, name: str, parts: list[tuple], n_frames: int, seed: int) -> DataFrame:
    """(seq_id, frame_id, point_id, x, y, z, intensity, class_id), where class_id is the label word."""
    out, first = [], 0
    for number, (count, raw, instance, x, y, z, i) in enumerate(parts):
        rows = spark.range(n_frames * count).select((F.col("id") / count).cast("int").alias("frame_id"), (F.col("id") % count).alias("j"))
        rows = rows.withColumn("point_id", F.col("j") + first)
        key = [F.lit(seed), F.lit(name), F.col("frame_id"), F.lit(number), F.col("point_id")]
        drawn = lambda c, how: _draw(how, *key, F.lit(c)).cast("float").cast("double")  # noqa: B023, E731
        rows = rows.withColumns({"x": drawn("x", x), "y": drawn("y", y)}).withColumns({"z": drawn("z", z), "intensity": drawn("intensity", i)})
        out.append(rows.select(F.lit(name).alias("seq_id"), "frame_id", "point_id", "x", "y", "z", "intensity", F.lit(raw + (instance << 16)).alias("class_id")))
        first += count
    return reduce(DataFrame.unionByName, out)


def drive(spark: SparkSession, n_frames: int = 30, seed: int = 42) -> DataFrame:
    """The labelled drive, a frame every 0.1 s; scans.write_scans makes the files of it."""
    return _points(spark, "00", DRIVE, n_frames, seed)


def scan(spark: SparkSession, seed: int = 0) -> DataFrame:
    """The test scan in an order drawn from the seed."""
    rows = _points(spark, "test", SCAN, 1, seed)
    return rows.orderBy(F.xxhash64(F.lit(seed), "point_id"), "point_id")
