"""Four synthetic drives as tables, generated by Spark.

A scene is a list of parts: how many points, and how x, y, z and intensity are drawn. Draws are
hashes of (seed, scenario, frame, part, point, coordinate), so any frame can be made alone, on any
executor, again and alike. They follow the original scenes in distribution, not number by number.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

T = "(frame_id * 0.1D)"


def u(lo, hi):
    return ("uniform", lo, hi)


def n(mean, sd):
    return ("normal", mean, sd)


def sides(lo, hi):
    """Uniform in [lo, hi] or, as likely, in [-hi, -lo]."""
    return ("sides", lo, hi)


#: name: (title, text, speed, steering, parts); a part is (points, class, x, y, z, intensity). Numbers are fixed values.
SCENARIOS = {
    "urban_intersection": (
        "Urban Intersection", "A car and a walker cross while the vehicle slows and turns.",
        "greatest(3.0D, 10.0D - 0.35D * frame_id)", "least(0.35D, 0.02D * frame_id)",
        [
            (4000, 0, u(-15, 45), u(-5, 5), n(-1.5, 0.02), u(0.2, 0.4)),
            (3000, 0, u(10, 25), u(-35, 35), n(-1.5, 0.02), u(0.2, 0.4)),
            (2000, 1, u(-15, 8), u(5.5, 12), n(-1.35, 0.02), u(0.3, 0.5)),
            (2000, 2, u(-15, 8), u(12, 14), u(-1.35, 2.5), u(0.6, 0.9)),
            *[(60, 2, n(x, 0.04), n(y, 0.04), u(-1.35, 2.2), u(0.8, 1.0)) for x, y in ((9.0, 5.5), (9.0, -5.5), (26.0, 5.5), (26.0, -5.5))],
            (350, 3, u(17, 19), u(f"-27.2D + 12 * {T}", f"-22.8D + 12 * {T}"), u(-1.4, 0.2), u(0.5, 0.8)),
            (100, 3, u(9.25, 9.75), u(f"4.25D - {T}", f"4.75D - {T}"), u(-1.35, 0.35), u(0.4, 0.7)),
        ],
    ),
    "highway_cruise": (
        "Highway Cruise", "Steady fast driving, the fine zone drawn out ahead.", "22.0D", "0.0D",
        [
            (6000, 0, u(-20, 85), u(-6.5, 6.5), n(-1.5, 0.015), u(0.2, 0.4)),
            (750, 2, u(-20, 85), n(7.0, 0.03), u(-1.4, -0.6), u(0.7, 0.9)),
            (750, 2, u(-20, 85), n(-7.0, 0.03), u(-1.4, -0.6), u(0.7, 0.9)),
            (1200, 1, u(-20, 85), sides(7.2, 12), n(-1.3, 0.05), u(0.1, 0.3)),
            (400, 3, u(f"32.8D + 2 * {T}", f"37.2D + 2 * {T}"), u(-0.9, 0.9), u(-1.4, 0.1), u(0.5, 0.8)),
            (350, 3, u(f"17.8D + 5 * {T}", f"22.2D + 5 * {T}"), u(3.1, 4.9), u(-1.4, 0.1), u(0.5, 0.8)),
        ],
    ),
    "pothole_alley": (
        "Pothole Alley", "A narrow road with holes between rough verges.", "6.0D", "0.0D",
        [
            (5000, 0, u(-10, 50), u(-3.5, 3.5), n(-1.5, 0.02), u(0.2, 0.4)),
            (1500, 1, u(-10, 50), sides(3.5, 5.5), n(-1.42, 0.06), u(0.1, 0.3)),
            (2000, 2, u(-10, 50), sides(5.5, 6.0), u(-1.4, 2.5), u(0.6, 0.9)),
        ],
    ),
    "bridge_overpass": (
        "Bridge Overpass", "A road below a deck: two heights in one place.", "8.0D", "0.0D",
        [
            (5000, 0, u(-10, 50), u(-4.5, 4.5), n(-1.5, 0.02), u(0.2, 0.4)),
            (2500, 2, u(18, 28), u(-15, 15), u(1.8, 3.2), u(0.7, 0.9)),
            *[(150, 2, u(22.4, 23.6), u(y - 0.6, y + 0.6), u(-1.5, 2.5), u(0.8, 1.0)) for y in (5.2, -5.2)],
            (1200, 1, u(-10, 50), sides(4.5, 7.0), n(-1.35, 0.02), u(0.3, 0.5)),
        ],
    ),
}
#: Centres and radii of the potholes, in which road lies 0.18 m lower and is no longer drivable.
POTHOLES = ((12.0, 1.0, 1.2), (25.0, -1.2, 1.5), (38.0, 0.5, 1.0))


def _draw(how, *key) -> F.Column:
    kind, a, b = how
    a, b = (F.expr(v) if isinstance(v, str) else F.lit(float(v)) for v in (a, b))
    chance = lambda i: (F.shiftrightunsigned(F.xxhash64(*key, F.lit(i)), 11).cast("double") + 0.5) / float(1 << 53)
    if kind == "normal":
        return a + b * F.sqrt(-2.0 * F.log(chance(0))) * F.cos(2.0 * F.pi() * chance(1))
    spread = a + (b - a) * chance(0)
    return F.when(chance(2) > 0.5, spread).otherwise(-spread) if kind == "sides" else spread


def frames(spark: SparkSession, n_frames: int = 20) -> DataFrame:
    """(seq_id, frame_id, timestamp_s, speed_mps, steering_angle_rad, scenario_name, description) of all scenarios."""
    base = spark.range(n_frames).select(F.col("id").cast("int").alias("frame_id"))
    out = [
        base.select(F.lit(s).alias("seq_id"), "frame_id", F.expr(T).alias("timestamp_s"), F.expr(v).cast("double").alias("speed_mps"), F.expr(d).cast("double").alias("steering_angle_rad"), F.lit(name).alias("scenario_name"), F.lit(text).alias("description"))
        for s, (name, text, v, d, _) in SCENARIOS.items()
    ]
    return reduce(DataFrame.unionByName, out)


def points(spark: SparkSession, n_frames: int = 20, seed: int = 42, only: list[str] | None = None) -> DataFrame:
    """Points of the scenarios, all or those named."""
    out = []
    for number, (s, spec) in enumerate(SCENARIOS.items()):
        if only and s not in only:
            continue
        first = 0
        for part, (count, class_id, x, y, z, i) in enumerate(spec[4]):
            rows = spark.range(n_frames * count).select((F.col("id") / count).cast("int").alias("frame_id"), (F.col("id") % count + first).alias("point_id"))
            key = [F.lit(seed), F.lit(number), F.col("frame_id"), F.lit(part), F.col("point_id")]
            drawn = [_draw(how, *key, F.lit(c)).cast("float").cast("double").alias(c) for c, how in (("x", x), ("y", y), ("z", z), ("intensity", i))]
            out.append(rows.select(F.lit(s).alias("seq_id"), "frame_id", "point_id", *drawn, F.lit(class_id).alias("class_id")))
            first += count
    rows = reduce(DataFrame.unionByName, out)
    hole = reduce(lambda a, b: a | b, [(F.col("x") - px) * (F.col("x") - px) + (F.col("y") - py) * (F.col("y") - py) <= pr * pr for px, py, pr in POTHOLES])
    hole = hole & (F.col("seq_id") == "pothole_alley") & (F.col("class_id") == 0)
    return rows.withColumn("z", F.when(hole, F.col("z") - 0.18).otherwise(F.col("z"))).withColumn("class_id", F.when(hole, 1).otherwise(F.col("class_id")))


def roof_height(name="scenario_name") -> F.Column:
    return F.when(F.lower(name).contains("bridge"), 4.0).otherwise(2.5)
