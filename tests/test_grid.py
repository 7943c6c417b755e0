from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from arclattice.functions import fovea, polar
from arclattice.functions.registered import split_heights
from arclattice.operators import metrics, project, segment


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def cells(spark, points, roof=2.5):
    """points: (x, y, z, class) of a vehicle at rest."""
    df = spark.createDataFrame([("s", 0, *map(float, p[:3]), p[3]) for p in points], "seq_id string, frame_id int, x double, y double, z double, class_id int")
    return project.grid_cells(project.with_key(df, F.col("r") < 10.0, roof)).collect()


@pytest.mark.parametrize(("r", "size", "tier"), [(5, 0.05, 0), (15, 0.15, 1), (60, 0.50, 2), (500, 0.50, 2), (10, 0.15, 1), (30, 0.5, 2)])
def test_tiers(spark, r, size, tier):
    got = one(spark, polar.resolution(F.lit(float(r))).alias("s"), polar.tier_index(polar.resolution(F.lit(float(r)))).alias("t"))
    assert (got.s, got.t) == (size, tier)


@pytest.mark.parametrize(("size", "r", "step"), [(0.15, 5, 0.03), (0.15, 50, 0.003), (0.05, 0.1, 0.1)])
def test_angular_step(spark, size, r, step):
    assert one(spark, polar.angular_step(F.lit(size), F.lit(float(r))))[0] == pytest.approx(step)


def test_keys_truncate_toward_zero(spark):
    got = one(spark, polar.angle_cell(F.lit(-0.004), F.lit(0.05), F.lit(5.0)).alias("a"), polar.angle_cell(F.lit(-0.024), F.lit(0.05), F.lit(5.0)).alias("b"))
    assert (got.a, got.b) == (0, -2)


def test_fine_cells_of_a_coarse_one(spark):
    assert [one(spark, polar.fine_cells(F.lit(s)))[0] for s in (0.05, 0.15, 0.5)] == [1, 8, 100]


@pytest.mark.parametrize(
    ("points", "roof", "expect"),
    [
        ([(5, 0, 1.2, 1)], 2.5, (1.2, None, None, 1)),
        ([(5, 0, 3.0, 1)], 2.5, None),
        ([(5, 0, 0.0, 0), (5, 0, 1.0, 1)], 2.5, (0.0, 1.0, 1.0, 0)),
        ([(5, 0, 0.0, 0), (5, 0, 0.4, 1)], 2.5, (0.0, None, None, 0)),
        ([(5, 0, 0.0, 1), (5, 0, 0.1, 2), (5, 0, 0.2, 2)], 2.5, (0.0, None, None, 2)),
        ([(5, 0, 0.0, 0), (5, 0, 3.0, 1)], 2.5, (0.0, None, None, 0)),
        ([(5, 0, 0.0, 0), (5, 0, 3.0, 1)], 3.5, (0.0, 3.0, 3.0, 0)),
        ([(5, 0, 0.0, -1), (5, 0, 0.1, 3)], 2.5, (0.0, None, None, -1)),
    ],
)
def test_cells(spark, points, roof, expect):
    got = cells(spark, points, roof)
    if expect is None:
        assert got == []
    else:
        (c,) = got
        assert (c.elevation_ground, c.elevation_obstacle_bottom, c.elevation_obstacle_top, c.semantic_class) == expect


def test_two_layers(spark):
    z = [(-0.05, 0), (0, 0), (0.02, 0), (-0.02, 0), (2.8, 2), (3.0, 2), (3.1, 2), (3.2, 2)]
    (c,) = cells(spark, [(5.01 + 0.003 * i, 0, v, k) for i, (v, k) in enumerate(z)], 4.0)
    assert c.point_count == 8
    assert (c.elevation_ground, c.elevation_obstacle_bottom, c.elevation_obstacle_top) == pytest.approx((-0.05, 2.8, 3.2), abs=1e-3)
    (c,) = cells(spark, [(5.01, 0, -0.05 + 0.35 * i, 1) for i in range(7)], 4.0)
    assert (c.point_count, c.elevation_ground, c.elevation_obstacle_bottom) == (7, -0.05, None)


def radius(spark, theta, v, steer=0.0, tracks=(), shear=None, p=fovea.FOVEA):
    t = F.array(*[F.struct(F.lit(3).alias("class_id"), *[F.lit(float(x)).alias(n) for n, x in zip(("x", "y", "vx", "vy", "bbox_l", "bbox_w"), (*k, 4, 2), strict=True)]) for k in tracks]) if tracks else None
    return one(spark, fovea.fine_radius(F.lit(float(theta)), F.lit(float(v)), F.lit(float(steer)), None if t is None else F.filter(F.transform(t, lambda x: fovea.lobe(x, p)), lambda x: x.isNotNull()), p, shear))[0]


def test_ellipse(spark):
    assert [radius(spark, t, 0) for t in (0, math.pi / 2, math.pi)] == pytest.approx([10, 10, 10])
    assert (radius(spark, 0, 20), radius(spark, math.pi, 20)) == pytest.approx((25, 10))
    assert radius(spark, 0.5, 20, 0.5) == pytest.approx(25)
    assert radius(spark, 0.5, 20, 0.5) > radius(spark, -0.5, 20, 0.5)
    assert radius(spark, 0.4, 20, 0.4) == pytest.approx(25)
    assert radius(spark, 0.2, 20, 0.4, shear=0.5) == pytest.approx(25)


def test_lobes(spark):
    assert radius(spark, 0, 0, tracks=[(20, 0, 0, 0)]) == pytest.approx(25)
    assert radius(spark, math.pi / 2, 0, tracks=[(20, 0, 0, 0)]) == pytest.approx(10)
    assert radius(spark, 0, 0, tracks=[(20, 0, -8, 0)]) == pytest.approx(32.5)
    assert radius(spark, 0, 0, tracks=[(20, 0, 8, 0)]) == pytest.approx(10)
    assert radius(spark, 0, 0, tracks=[(45, 0, -8, 0)]) == pytest.approx(10)
    assert radius(spark, math.atan2(6, 15), 0, tracks=[(15, 6, 0, 0)]) == pytest.approx(10)
    ahead = fovea.Fovea(collision_only=False)
    side = radius(spark, math.atan2(12, 15), 0, tracks=[(15, 0, 0, 12)], p=ahead)
    assert side > 20 and side > radius(spark, math.atan2(12, 15) - math.pi, 0, tracks=[(15, 0, 0, 12)], p=ahead) + 8
    assert radius(spark, 0, 0, tracks=[(20, 0, -8, 0)], p=fovea.Fovea(enabled=False)) == pytest.approx(10)


def test_polyline(spark):
    line = one(spark, fovea.polyline(F.lit(15.0), F.lit(0.2)))[0]
    assert len(line) == 120
    assert all(9.5 <= math.hypot(*p) <= 26 for p in line)


def test_tracks_refine_a_tier(spark):
    points = spark.createDataFrame([("s", 0, x, y, 0.0, 0) for x, y in ((25.0, 0.0), (25.5, 0.2), (24.8, -0.2))], "seq_id string, frame_id int, x double, y double, z double, class_id int")
    frames = spark.createDataFrame([("s", 0, 0.0, 0.0)], "seq_id string, frame_id int, speed_mps double, steering_angle_rad double")

    def tiers(vx):
        tracks = None if vx is None else spark.createDataFrame([("s", 0, 3, 25.0, 0.0, vx, 0.0, 4.0, 2.0)], "seq_id string, frame_id int, class_id int, x double, y double, vx double, vy double, bbox_l double, bbox_w double")
        return {r.resolution_tier for r in project.with_foveated_key(points, frames, tracks).collect()}

    assert (tiers(None), tiers(5.0), tiers(-5.0)) == ({0.15}, {0.15}, {0.05})


def test_miou(spark):
    rows = spark.createDataFrame(list(zip([0, 1, 1, 1, 2, 2, 3, 3, 2], [0, 0, 1, 1, 2, 2, 3, 3, -1], strict=True)), "pred int, gt int")
    got = {r.class_id: r.iou for r in metrics.miou(rows).collect()}
    assert got == pytest.approx({0: 0.5, 1: 2 / 3, 2: 1, 3: 1, -1: (0.5 + 2 / 3 + 2) / 4})


def test_miou_by_distance(spark):
    rows = spark.createDataFrame([(5.0, 0.0, 1, 1), (15.0, 0.0, 2, 1), (40.0, 0.0, 2, 2), (50.0, 50.0, 0, 0)], "x double, y double, pred int, gt int")
    got = {(r.bucket, r.class_id): r.iou for r in metrics.miou_by_distance(rows).collect()}
    assert (got["0-10m", 1], got["10-30m", 1], got["30-100m", 2], got["30-100m", 0]) == (1, 0, 1, 1)
    assert metrics.miou_by_distance(rows.limit(0)).count() == 0


def test_profile(spark):
    got = metrics.profile(lambda: spark.range(10), 2)
    assert set(got) == {"mean", "min", "max", "fps"} and got["min"] <= got["mean"] <= got["max"]
    assert metrics.profile(lambda: spark.range(10), 0) == {}
    assert metrics.uniform_baseline_bytes() == 502654800


def test_pushdown_and_one_exchange(spark, tmp_path):
    spark.createDataFrame([("s", 0, 1.0, 1.0, 0.0, 0)], "seq_id string, frame_id int, x double, y double, z double, class_id int").write.parquet(str(tmp_path / "p"))
    plan = project.grid_cells(project.with_key(spark.read.parquet(str(tmp_path / "p"))))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(z), LessThanOrEqual(z,2.5)]" in plan
    assert plan.count("Exchange hashpartitioning") == 1


def test_order_of_rows_does_not_matter(spark):
    """Heights whose mean lies half way between two of them, but for the last bits, which depend on the order of adding up."""
    z = [0.1 * k - 2.43 for k in (22, 14, 28, 31, 32, 34, 40, 44, 46, 49)]
    orders = [np.random.default_rng(seed).permutation(len(z)) for seed in range(40)]
    rows = spark.createDataFrame([(k, z[i]) for k, order in enumerate(orders) for i in order], "k int, z double").coalesce(1)
    found = {tuple(r[1:]) for r in project.z_split(rows, ["k"]).collect()} | {tuple(split_heights([z[i] for i in order]).values()) for order in orders}
    assert len(found) == 1


def test_profile_rounds_the_percentile_once(spark):
    rng = np.random.default_rng(3)
    given = {k: rng.uniform(-0.5, 0.5, int(rng.integers(4, 30))).tolist() for k in range(120)}
    rows = spark.createDataFrame([("s", k, 0, 0, h) for k, hs in given.items() for h in hs], "seq_id string, frame_id int, sector int, r_bin int, h double")
    got = {r.frame_id: r.offset for r in segment.ground_profile(rows).filter("r_bin = 0").collect()}
    for k, hs in given.items():
        place = (len(hs) - 1) * 0.10
        low, d = sorted(hs)[int(place) : int(place) + 2], place - int(place)
        assert got[k] == float(Fraction(low[0]) * Fraction(1 - d) + Fraction(low[-1] * d))


def test_lobes_of_a_sector(spark):
    """In every sector few of many lobes are left, and they are as high as all of them."""
    rng = np.random.default_rng(5)
    many = [(float(h), float(a), float(s), f, 35.0 if f > 1 else float(h)) for h, a, s, f in zip(rng.uniform(5, 35, 400), rng.uniform(-math.pi, math.pi, 400), rng.uniform(0.35, 2, 400), rng.choice([1.0, 1.3], 400).tolist(), strict=True)]
    rows = spark.createDataFrame([(k, many) for k in range(0, project.SECTORS, 8)], "k int, lobes array<struct<height:double,at:double,sigma:double,factor:double,cap:double>>")
    few = rows.withColumn("few", fovea.lobes_of_sector(F.col("lobes"), F.col("k"), project.SECTORS))
    theta = (F.col("k") + F.col("u")) * (2 * math.pi / project.SECTORS) - math.pi
    seen = few.withColumn("u", F.explode(F.array(*[F.lit(u) for u in (0.001, 0.5, 0.999)]))).select(F.size("few").alias("n"), fovea.sector_of(theta, project.SECTORS).alias("own"), "k", fovea.attention(theta, F.col("lobes")).alias("a"), fovea.attention(theta, F.col("few")).alias("b")).collect()
    assert all(r.own == r.k and r.a == r.b for r in seen)
    assert max(r.n for r in seen) < 40
