"""The stateful feedback loop against rounds of plans, and its stream against its table."""

from __future__ import annotations

import random

import numpy as np
import pytest
import rounds
from pyspark.sql import functions as F

from arclattice.config import Fovea
from arclattice.functions import fovea
from arclattice.operators import loop, track
from arclattice.sources import scenarios
from arclattice.views import view

SF = "/root/testdata/sf0.001"


def rows_of(df, *names):
    return sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.select(*names).collect())


def drives(spark, n=4):
    frames = scenarios.frames(spark, n).filter("seq_id in ('urban_intersection', 'highway_cruise')").withColumn("roof", scenarios.roof_height())
    return scenarios.points(spark, n, only=["urban_intersection", "highway_cruise"]), frames


@pytest.mark.parametrize("tables", [False, True])
def test_equals_the_rounds(spark, tables):
    points, frames = (view(spark, SF, "points_v"), view(spark, SF, "frames_v").withColumn("roof", F.lit(2.5))) if tables else drives(spark)
    points, frames = points.cache(), frames.cache()
    ours, theirs = loop.closed_loop(points, frames), rounds.closed_loop(points, frames)
    cells = ("seq_id", "frame_id", "tier_idx", "ring_idx", "angle_idx", "semantic_class", "point_count", "elevation_ground")
    assert rows_of(ours[0], *cells) == rows_of(theirs[0], *cells)
    tracks = ("seq_id", "frame_id", "track_id", "hits", "state", "x", "y", "vx", "vy", "frames_since_seen")
    assert rows_of(ours[1], *tracks) == rows_of(theirs[1], *tracks) and ours[1].count()
    assert rows_of(ours[2], "seq_id", "frame_id", "ghosts") == rows_of(theirs[2], "seq_id", "frame_id", "ghosts")


def test_lobes_equal_the_columns(spark):
    rng = random.Random(4)
    tracks = [track.Track(i, rng.choice([2, 3, 3, 3]), rng.uniform(-40, 40), rng.uniform(-12, 12), rng.choice([0.0, rng.uniform(-9, 9)]), rng.choice([0.0, rng.uniform(-4, 4)])) for i in range(300)]
    rows = spark.createDataFrame([(t.track_id, t.class_id, t.x, t.y, t.vx, t.vy, t.bbox_l, t.bbox_w) for t in tracks], "id int, class_id int, x double, y double, vx double, vy double, bbox_l double, bbox_w double")
    for p in (Fovea(), Fovea(collision_only=False), Fovea(boost=1.0)):
        one = fovea.lobe(F.struct("class_id", "x", "y", "vx", "vy", "bbox_l", "bbox_w"), p)
        want = {r.id: r.lobe for r in rows.select("id", one.alias("lobe")).collect()}
        for t in tracks:
            got = loop.lobe_of(t, p)
            assert (got is None) == (want[t.track_id] is None)
            assert got is None or got == pytest.approx(tuple(want[t.track_id]))
        assert sum(v is not None for v in want.values()) > 20
        theta = np.linspace(-3.1, 3.1, 60)
        near = [t for t in tracks if want[t.track_id] is not None][:5]
        line = spark.createDataFrame([(float(a),) for a in theta], "theta double")
        lobes = F.array(*[F.struct(*[F.lit(float(v)).alias(n) for n, v in zip(("height", "at", "sigma", "factor", "cap"), loop.lobe_of(t, p))]) for t in near])
        wanted = [r[0] for r in line.select(fovea.fine_radius("theta", F.lit(13.0), F.lit(0.2), lobes, p)).collect()]
        assert loop.fine_of(theta, 13.0, 0.2, near, p) == pytest.approx(np.array(wanted))


def streamed(spark, folder, batches, **more):
    out = []
    for i, b in enumerate(batches):
        b.write.parquet(f"{folder}/in/{i}")
        (next((folder / "in" / str(i)).glob("*.parquet"))).rename(folder / f"in-{i}.parquet")
    (folder / "src").mkdir()
    for i in range(len(batches)):
        (folder / f"in-{i}.parquet").rename(folder / "src" / f"{i}.parquet")
        source = spark.readStream.schema(batches[0].schema).option("maxFilesPerTrigger", 1).parquet(str(folder / "src"))
        query = loop.loop_stream(source, **more).writeStream.foreachBatch(lambda df, n: out.extend(df.collect())).option("checkpointLocation", str(folder / "check")).trigger(availableNow=True).start()
        query.awaitTermination()
    return out


def test_stream_equals_table(spark, tmp_path):
    points, frames = drives(spark, 3)
    rows = loop.loop_rows(points, frames).withColumn("event_time", F.timestamp_seconds(F.col("frame_id").cast("double") * 0.1 + 1_000_000)).cache()
    got = streamed(spark, tmp_path, [rows.filter(F.col("frame_id") == i).coalesce(1) for i in range(3)])
    want = loop.loop_states(points, frames)
    key = lambda r: (r.seq_id, r.frame_id, r.kind, r.sector if r.kind == "sector" else r.track_id)
    value = lambda r: r.held if r.kind == "sector" else (r.x, r.y, r.vx, r.hits)
    ours, theirs = {key(r): value(r) for r in got}, {key(r): value(r) for r in want.collect()}
    assert set(ours) == set(theirs) and len(got) == len(ours)
    assert all(ours[k] == pytest.approx(theirs[k]) for k in ours)


def test_a_sequence_that_is_over_is_forgotten(spark, tmp_path):
    def frame(number, seconds, seq="a"):
        at = F.timestamp_seconds(F.lit(1_000_000.0 + seconds))
        points = spark.range(20).select(F.lit(seq).alias("seq_id"), F.lit(number).alias("frame_id"), F.lit(5.0).alias("speed_mps"), F.lit(0.0).alias("steering_angle_rad"), (F.lit(8.0) + F.col("id") * 0.01).alias("r"), F.lit(0.1).alias("theta"), F.lit(3).alias("class_id"))
        return points.withColumn("event_time", at).coalesce(1)

    # frames 5 and 6 go on; then only another sequence moves time on, and frame 1 is no replay but a new beginning
    got = streamed(spark, tmp_path, [frame(5, 0), frame(6, 1), frame(0, 500, "b"), frame(1, 510, "b"), frame(1, 511)], idle=30_000, delay="1 second")
    hits = {(r.seq_id, r.frame_id): r.hits for r in got if r.kind == "track"}
    assert hits[("a", 5)] == 1 and hits[("a", 6)] == 2 and hits[("a", 1)] == 1


def test_rows_must_come_sorted():
    import pandas as pd

    part = lambda n: pd.DataFrame({"frame_id": [n, n]})
    sorted_, any_order = loop.Loop(Fovea(), ordered=True), loop.Loop(Fovea(), ordered=False)
    assert [(n, len(f)) for n, f in sorted_.frames(iter([part(1), part(1), part(2)]))] == [(1, 4), (2, 2)]
    assert [(n, len(f)) for n, f in any_order.frames(iter([part(2), part(1), part(2)]))] == [(1, 2), (2, 4)]
    with pytest.raises(ValueError, match="sorted"):
        list(sorted_.frames(iter([part(2), part(1)])))


def test_large_boxes_reach_all_their_cells(spark):
    cells = spark.createDataFrame([("s", 1, 0, i, 0, 3, float(i), 0.0) for i in range(40)], "seq_id string, frame_id int, tier_idx int, ring_idx long, angle_idx long, semantic_class int, cx double, cy double")
    tracks = spark.createDataFrame([("s", 1, 7, 5.0, 0.0, 22.5, 1.0), ("s", 1, 8, 5.0, 0.0, 2.0, 1.0)], "seq_id string, frame_id int, track_id long, x double, y double, bbox_l double, bbox_w double")
    out = track.footprints(tracks, cells).collect()
    assert sorted(r.ring_idx for r in out if r.track_id == 7) == list(range(28)) and sorted(r.ring_idx for r in out if r.track_id == 8) == [3, 4, 5, 6, 7]


def test_repeated_points_reach_the_processor_once(spark):
    points, frames = drives(spark, 2)
    points = points.cache()
    often = points.withColumn("_", F.explode(F.sequence(F.lit(1), F.lit(9)))).drop("_")
    once, many = (loop.places(loop.loop_rows(p, frames)) for p in (points, often))
    assert once.count() == many.count() and many.filter("r is not null").agg(F.sum("n")).first()[0] == loop.loop_rows(often, frames).filter("r is not null").count()
    names = ("seq_id", "frame_id", "kind", "sector", "held", "track_id", "x", "y", "vx", "hits")
    ours, theirs = (sorted(map(repr, rows_of(loop.loop_states(p, frames), *names))) for p in (often, points))
    assert ours == theirs


def test_a_row_may_stand_for_several_points():
    import pandas as pd

    rng = random.Random(8)
    rows = pd.DataFrame([(rng.uniform(3, 40), rng.choice([-1.0, 0.2, 0.205, 0.21]), rng.choice([0, 3]), rng.randint(1, 6)) for _ in range(300)], columns=["r", "theta", "class_id", "n"]).assign(speed_mps=12.0, steering_angle_rad=0.1)
    spread = rows.loc[rows.index.repeat(rows["n"])].drop(columns="n")
    tracks = [track.Track(1, 3, 18.0, 3.0, -3.0, 0.0)]
    few, all_ = loop.Frame(rows, Fovea()), loop.Frame(spread, Fovea())
    fine = few.hold(tracks, {})
    assert fine == pytest.approx(all_.hold(tracks, {})) and few.detections(fine) == all_.detections(fine)
    assert fine != pytest.approx(loop.Frame(rows.drop(columns="n"), Fovea()).hold(tracks, {}))


def test_angles_meet_few_lobes():
    rng = random.Random(5)
    tracks = [track.Track(i, 3, rng.uniform(-60, 60), rng.uniform(-60, 60), rng.choice([0.0, rng.uniform(-9, 9)]), rng.uniform(-4, 4), bbox_l=rng.choice([0.5, 4.0, 30.0])) for i in range(3000)]
    theta = np.r_[np.random.default_rng(5).uniform(-np.pi, np.pi, 5000), -np.pi, np.pi, 0.0]
    for p in (Fovea(), Fovea(collision_only=False), Fovea(collision_only=False, boost=1.0, farthest_threat=1000.0)):
        lobes = np.array([v for v in (loop.lobe_of(t, p) for t in tracks) if v]).T
        want = loop.fine_of(theta, 9.0, 0.1, [], p)
        for height, at, sigma, factor, cap in lobes.T:
            want = np.maximum(want, np.minimum(height * np.exp(-0.5 * (loop._wrap(theta - at) / sigma) ** 2) * factor, cap))
        assert (loop.fine_of(theta, 9.0, 0.1, tracks, p) == want).all()
        width = 2 * np.pi / 512
        may = loop.candidates_of(np.zeros(512), (np.arange(512) + 0.5) * width - np.pi, lobes)
        assert may.any(0).all() and may.sum(0).mean() < lobes.shape[1] / 5
        assert lobes.shape[1] > 50
