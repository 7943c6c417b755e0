from __future__ import annotations

import itertools
import math
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from arclattice.operators import cluster, hysteresis, segment, track
from arclattice.streaming import processors

POINTS = "seq_id string, frame_id int, point_id long, x double, y double, z double, intensity double, class_id int"


def test_schmitt(spark):
    rows = spark.createDataFrame([("k", i, r) for i, r in enumerate([9.9, 10.1, 9.9, 10.8, 9.8, 9.2])], "key string, frame_id int, range_m double")
    assert [r.tier for r in hysteresis.schmitt_tier(rows, ["key"]).orderBy("frame_id").collect()] == [0.05, 0.05, 0.05, 0.15, 0.15, 0.05]


def test_degradation(spark):
    rows = spark.createDataFrame([("s", i, 0, 50, 100, n, n / 10, 0.05) for i, n in enumerate([1, 2, 1])], "seq_id string, frame_id int, tier_idx int, ring_idx long, angle_idx long, point_count long, confidence double, resolution_tier double")
    got = hysteresis.degraded(rows).orderBy("frame_id").collect()
    assert [r.confidence for r in got] == [0.1, 0.2, 0.3]
    assert (got[2].resolution_tier, got[2].point_count) == (0.5, 3)


def test_dead_band(spark):
    rows = spark.createDataFrame([("s", 0, i, r) for i, r in enumerate([10.0, 10.4, 10.8, 10.4])], "seq_id string, sector long, frame_id int, radius double")
    assert [r.held for r in hysteresis.radius_hold(rows).orderBy("frame_id").collect()] == [10.0, 10.0, 10.8, 10.8]


def test_z_clip(spark):
    rows = spark.createDataFrame([("a", i, z) for i, z in enumerate([2.55, 2.55, 2.4, 2.52])] + [("b", 0, 3.2)], "key string, frame_id int, z_max double")
    got = {(r.key, r.frame_id): r.clipped for r in hysteresis.z_clip(rows, ["key"]).collect()}
    assert [got["a", i] for i in range(4)] == [False, True, False, False] and got["b", 0]


def run(frames, noise=0.0, seed=0):
    rng, tracks, out = np.random.default_rng(seed), [], []
    for found in frames:
        tracks = track.track_step(tracks, [(x + rng.normal(0, noise), y + rng.normal(0, noise), 3) for x, y in found])
        out.append(tracks)
    return out


def test_prediction_converges():
    out = run([[(0.2 * i, 0.1 * i)] for i in range(5)])
    for i in range(2, 5):
        (t,) = out[i]
        assert t.track_id == 1
        assert math.hypot(t.pred_x - 0.2 * (i + 1), t.pred_y - 0.1 * (i + 1)) < 0.15


def test_occlusion_keeps_the_id():
    out = run([[(0, 0)], [(0.1, 0.1)], [], [], [(0.4, 0.4)]])
    assert [t[0].track_id for t in out] == [1] * 5
    assert [t[0].frames_since_seen for t in out] == [0, 0, 1, 2, 0]


def test_fast_and_occluded_tracks():
    assert all([t.track_id for t in s] == [1] for s in run([[(2.2 * i, 0)] for i in range(20)], 0.12, 3))
    out = run([[] if i in (5, 6) else [(1.0 * i, 2.0)] for i in range(12)], 0.08, 4)
    assert all([t.track_id for t in s] == [1] for s in out[7:])
    out = run([[(1.0 * i, 0)] for i in range(10)], 0.05, 5)
    assert abs(out[-1][0].vx - 10) < 1.5 and all(s[0].state == "CONFIRMED" for s in out[2:])


def test_ids_restart_after_all_are_gone():
    out = run([[(0, 0)], *[[]] * 6, [(50, 50)]])
    assert out[6] == [] and out[7][0].track_id == 1


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 4), st.integers(1, 4), st.integers(0, 10**6))
def test_assignment_is_optimal(n, m, seed):
    rng = np.random.default_rng(seed)
    c = rng.random((n, m))
    c[rng.random((n, m)) < 0.4] = np.inf
    pairs = track.assign(c)
    best = max(
        ((r, -sum(c[i, j] for i, j in zip(a, b, strict=True))) for r in range(min(n, m) + 1) for a in itertools.combinations(range(n), r) for b in itertools.permutations(range(m), r) if all(np.isfinite(c[i, j]) for i, j in zip(a, b, strict=True))),
        default=(0, 0.0),
    )
    assert len(pairs) == best[0] and sum(c[i, j] for i, j in pairs) == pytest.approx(-best[1])


def test_parts_are_solved_apart():
    rng = np.random.default_rng(7)
    crowds = [rng.random((n, m)) for n, m in ((3, 2), (1, 1), (2, 4), (1, 3))]
    cost = np.full((sum(len(c) for c in crowds) + 2, sum(c.shape[1] for c in crowds) + 1), np.inf)  # two rows and a column without any
    i = j = 0
    for c in crowds:
        cost[i : i + c.shape[0], j : j + c.shape[1]] = c
        i, j = i + c.shape[0], j + c.shape[1]
    rows, cols = rng.permutation(cost.shape[0]), rng.permutation(cost.shape[1])
    mixed = cost[np.ix_(rows, cols)]
    assert sorted((len(r), len(c)) for r, c in track.blocks(mixed)) == sorted(c.shape for c in crowds)
    whole, apart = track.assign_block(mixed), track.assign(mixed)
    assert apart == whole and len(apart) == 2 + 1 + 2 + 1
    assert track.assign(np.full((2, 2), np.inf)) == track.assign(np.zeros((0, 3))) == []


DETECTIONS = "seq_id string, frame_id int, x double, y double, class_id int"


def detections(n=8):
    rows = []
    for s in ("a", "b"):
        for f in range(n):
            if f != 4:
                rows += [(s, f, 1.0 * f, 0.0, 3), (s, f, 20.0 - f, 5.0, 3)]
            else:
                rows.append((s, f, None, None, None))
    return rows


def streamed(spark, folder, batches, build):
    """Rows of the stream that build makes of the batches, one file each."""
    for i, b in enumerate(batches):
        b.coalesce(1).write.parquet(str(folder / "in" / f"b{i}"))
    stream = spark.readStream.schema(batches[0].schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(folder / "in"))
    name = f"out_{build.__name__}"
    q = build(stream).writeStream.format("memory").queryName(name).option("checkpointLocation", str(folder / "c")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    return spark.table(name)


def test_stream_equals_batch(spark, tmp_path):
    parts = [spark.createDataFrame([r for r in detections() if r[1] in f], DETECTIONS) for f in (range(3), range(3, 8))]
    batch = spark.createDataFrame(detections(), DETECTIONS)
    key = lambda r: (r.seq_id, r.frame_id, r.track_id)
    want = sorted(track.track(batch, batch).collect(), key=key)
    got = sorted(streamed(spark, tmp_path, parts, processors.track_stream).collect(), key=key)
    assert len(want) == len(got) == 32
    assert [tuple(r) for r in want] == [tuple(r) for r in got]


def footprint_rows(rng):
    """Footprints and cells of frames 0, 1, 3, 4 as one table: null track_id for cells."""
    rows = []
    for f in (0, 1, 3, 4):
        rows += [("a", f, t, 0, int(r), 7, None, None) for t in (1, 2) if (t, f) != (2, 3) for r in rng.choice(12, 5, replace=False)]
        rows += [("a", f, None, 0, r, 7, int(rng.integers(2, 4)), int(rng.choice([f, f - 1]))) for r in range(0, 12, 2) if rng.random() < 0.8]
    return rows


def states(spark):
    """name: (schema and rows, the stream, the same in batch)."""
    rng = np.random.default_rng(8)
    place = "seq_id string, place long, frame_id int, "
    frames = [(s, k, f) for s in ("a", "b") for k in range(3) for f in range(12)]
    cells = [("a", k, 5, t, f, int(rng.integers(1, 4)), 0.9, 0.05) for k in range(3) for f in range(12) for t in (0, 1) if rng.random() < 0.8]
    by = ["seq_id", "place"]

    def vacated(rows):
        return track.vacated(rows.filter("track_id is not null").drop("semantic_class", "last_updated_frame"), rows, rows.filter("track_id is null").drop("track_id"))

    return {
        "radius": ("seq_id string, sector long, frame_id int, radius double", [(*k, float(rng.uniform(9, 11))) for k in frames], processors.radius_stream, lambda d: hysteresis.radius_hold(d)),
        "tier": (place + "range_m double", [(*k, float(rng.uniform(8.8, 11.2))) for k in frames], processors.tier_stream, lambda d: hysteresis.schmitt_tier(d, by)),
        "clip": (place + "z_max double", [(*k, float(rng.uniform(2.3, 2.7))) for k in frames], processors.clip_stream, lambda d: hysteresis.z_clip(d, by)),
        "degraded": (
            "seq_id string, ring_idx long, angle_idx long, tier_idx int, frame_id int, point_count long, confidence double, resolution_tier double",
            cells, processors.degraded_stream, hysteresis.degraded,
        ),
        "vacated": (
            "seq_id string, frame_id int, track_id long, tier_idx int, ring_idx long, angle_idx long, semantic_class int, last_updated_frame int",
            footprint_rows(rng), processors.vacated_stream, vacated,
        ),
    }


@pytest.mark.parametrize("name", ["radius", "tier", "clip", "degraded", "vacated"])
def test_state_streams_equal_batch(spark, tmp_path, name):
    schema, rows, build, batch = states(spark)[name]
    whole = spark.createDataFrame(rows, schema)
    got = streamed(spark, tmp_path, [whole.filter("frame_id < 3"), whole.filter("frame_id >= 3")], build)
    want = batch(whole).select(got.columns).collect()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want)) and len(want) > 5
    last = {len(set(r[-1] for r in want))}
    assert last != {1}, "the case must hold both outcomes"


def test_clusters(spark):
    rows = [("s", i, 2.4 * i, 0.0, 3) for i in range(4)] + [("s", 10, 40.0, 0.0, 3)] + [("s", 20 + i, 100 + 2.0 * i, 0.0, 3) for i in range(9)]
    df = spark.createDataFrame(rows, "seq_id string, cell long, x double, y double, class_id int")
    got = {r.component: (r.x, r.cells) for r in cluster.clusters(df, ["seq_id"], "cell").collect()}
    assert got == {0: (pytest.approx(3.6), 4), 10: (40.0, 1)}  # the last chain is 16 m wide


def prints(spark, rows):
    return spark.createDataFrame([("s", *r) for r in rows], "seq_id string, frame_id int, track_id long, tier_idx int, ring_idx long, angle_idx long")


def grid(spark, rows):
    return spark.createDataFrame([("s", *r) for r in rows], "seq_id string, frame_id int, tier_idx int, ring_idx long, angle_idx long, semantic_class int, last_updated_frame int, elevation_obstacle_top double")


def test_erasure(spark):
    frames = spark.createDataFrame([("s", 1), ("s", 2)], "seq_id string, frame_id int")
    cells = grid(spark, [(2, 0, 200, 314, 3, 1, 1.0), (2, 0, 205, 314, 3, 2, 1.0), (2, 0, 100, 50, 2, 2, 1.0)])
    gone = track.vacated(prints(spark, [(1, 1, 0, 200, 314), (1, 1, 0, 205, 314), (1, 2, 0, 7, 7)]), frames, cells)
    assert {(r.ring_idx, r.outcome, r.erased) for r in gone.collect()} == {(200, "stale", True), (205, "kept", False), (7, "gone", True)}
    after = {r.ring_idx: (r.semantic_class, r.elevation_obstacle_top) for r in track.erased_cells(cells, gone).collect()}
    assert after == {200: (0, None), 205: (3, 1.0), 100: (2, 1.0)}
    assert {r.frame_id: r.ghosts for r in track.ghost_counts(gone, frames).collect()} == {1: 0, 2: 2}


def test_three_ghosts_a_frame(spark):
    rows = [(f, 1, 0, 160 + 10 * f, a) for f in range(15) for a in (-1, 0, 1)]
    frames = spark.createDataFrame([("s", f) for f in range(15)], "seq_id string, frame_id int")
    counts = track.ghost_counts(track.vacated(prints(spark, rows), frames, grid(spark, [(0, 0, 0, 0, 2, 0, None)])), frames)
    total = hysteresis.cumulative_ghosts(counts.withColumn("position", F.col("frame_id"))).orderBy("position").collect()
    assert [r.ghosts for r in total] == [0] + [3] * 14 and total[-1].total_ghosts == 42


def test_segmenter_on_a_flat_road(spark):
    rng = np.random.default_rng(1)
    road = [(x, y, -1.5 + e) for x, y, e in zip(rng.uniform(3, 30, 1500), rng.uniform(-8, 8, 1500), rng.normal(0, 0.01, 1500), strict=True)]
    car = [(10 + a, 1 + b, z) for a, b, z in zip(rng.uniform(-1, 1, 200), rng.uniform(-0.5, 0.5, 200), rng.uniform(-1.0, 0.3, 200), strict=True)]
    wall = [(12 + a, -3.0, z) for a, z in zip(rng.uniform(0, 5, 300), rng.uniform(-1.4, 2.4, 300), strict=True)]
    rows = [("s", 0, i, float(x), float(y), float(z), 0.0, -1) for i, (x, y, z) in enumerate([*road, *car, *wall])]
    df = spark.createDataFrame(rows, POINTS)
    got = segment.heuristic_labels(df, seed=3).orderBy("point_id").collect()
    label = np.array([r.label for r in got])
    side = np.array([abs(r.y) for r in got])
    assert (label[:1500][side[:1500] <= 4.2] == 0).mean() > 0.95
    assert (label[:1500][side[:1500] > 4.3] == 1).mean() > 0.95
    assert (label[1500:1700] == 3).mean() > 0.8
    assert (label[1700:] == 2).mean() > 0.8
    assert [r.label for r in segment.heuristic_labels(df, seed=3).orderBy("point_id").collect()] == label.tolist()
    bare = segment.classified(df, seed=3)
    assert sorted(r.class_id for r in bare.collect()) == sorted(label.tolist())
    raw = df.withColumn("class_id", F.when(F.col("point_id") == 0, 252).otherwise(40))
    assert {r.class_id for r in segment.classified(raw).collect()} == {3, 0}


def test_model_sees_chunks_of_azimuth(spark):
    df = spark.createDataFrame([("s", 0, i, math.cos(a), math.sin(a), 0.0, 0.0, -1) for i, a in enumerate(np.linspace(-math.pi, math.pi, 41))], POINTS)
    load = lambda: lambda xyz: np.stack([xyz[:, 0], xyz[:, 1], np.full(len(xyz), 0.9)], 1)
    got = segment.model_labels(df, load).collect()
    assert len(got) == 41 and all(r.pred == int(np.argmax([r.x, r.y, 0.9])) for r in got)

def test_clusters_across_tiles(spark):
    rng = np.random.default_rng(12)
    # chains that wind through many tiles, blobs on corners, and rows far apart
    line = [(float(i) * 2.4 - 150.0, 0.3 * (i % 2)) for i in range(130)]
    snake = [(40.0 * k + dx, 40.0 + 2.0 * j) for k in range(3) for j in range(20) for dx in (-0.1, 0.1)]
    blob = [tuple(rng.normal(0, 1.5, 2) + c) for c in ((40.0, 40.0), (-40.0, 80.0), (0.0, -40.0)) for _ in range(30)]
    lone = [(500.0 + 10 * i, -500.0) for i in range(5)]
    xy = line + snake + blob + lone
    rows = [(f, 1000 * f + k, float(x), float(y), 3) for f in (1, 2) for k, (x, y) in enumerate(xy[: len(xy) // f])]
    rows += [(1, 900 + i, x, y, 3) for i, (x, y) in enumerate([(None, 1.0), (float("nan"), 2.0), (1.0, float("inf"))])]
    df = spark.createDataFrame(rows, "frame_id int, det_id long, x double, y double, class_id int")
    got = {(r.frame_id, r.det_id): r.component for r in cluster.components(df, ["frame_id"], "det_id").collect()}
    assert len(got) == len(rows)
    for f in (1, 2):
        mine = [r for r in rows if r[0] == f and r[2] is not None and np.isfinite([r[2], r[3]]).all()]
        x, y = np.array([r[2] for r in mine]), np.array([r[3] for r in mine])
        found = cluster.grid_components(x, y)
        assert {r[1]: mine[found[k]][1] for k, r in enumerate(mine)} == {r[1]: got[f, r[1]] for r in mine}
    assert all(got[1, 900 + i] == 900 + i for i in range(3))
    plan = cluster.components(df, ["frame_id"], "det_id")._jdf.queryExecution().executedPlan().toString()
    assert "Existing" in plan  # the tiles are read from their checkpoint
    assert cluster.components(df.limit(0), ["frame_id"], "det_id").count() == 0


def test_a_crowded_frame_makes_no_matrix(monkeypatch):
    """Candidates by squares are those of the whole matrix, and assigning them costs as little; a step asks for no matrix."""
    rng = np.random.default_rng(7)
    for n, m in [(0, 5), (5, 0), (1, 1), (40, 30), (30, 40), (60, 60)]:
        tracks = [track.Track(i, 3, *rng.normal(0, 6, 2), p_pos=rng.random() * 3, state=("CONFIRMED", "TENTATIVE")[i % 2]) for i in range(n)]
        x, y = rng.normal(0, 6, (2, m))
        x[: m // 20] = np.nan
        cost = track.gated_costs(tracks, x, y)
        row, col, m2 = track.candidates(tracks, x, y)
        assert (row.tolist(), col.tolist()) == tuple(v.tolist() for v in np.nonzero(np.isfinite(cost))) and (m2 == cost[row, col]).all()
        if len(row):
            dense, sparse = track.assign_block(cost), track.assign_pairs(row, col, m2)
            assert len(dense) == len(sparse) and sum(cost[p] for p in sparse) == pytest.approx(sum(cost[p] for p in dense))
    monkeypatch.setattr(track, "gated_costs", None)
    spots = [(5.0 * i, 5.0 * j, 3) for i in range(100) for j in range(100)]
    assert {t.hits for t in track.track_step(track.track_step([], spots), spots)} == {2}


def test_planes_are_fitted_without_a_frame_in_python(spark):
    rng = np.random.default_rng(2)
    rows = [("a", f, i, *map(float, rng.uniform(-20, 20, 2)), float(rng.choice([rng.normal(-1.5, 0.1), rng.uniform(-1, 2)]))) for f, n in ((0, 400), (1, 7), (2, 2)) for i in range(n)]
    planes = segment.ground_planes(spark.createDataFrame(rows, "seq_id string, frame_id int, point_id long, x double, y double, z double"), seed=4)
    assert "InPandas" not in planes._jdf.queryExecution().executedPlan().toString()
    got = {r.frame_id: r for r in planes.collect()}
    for f in (0, 1):
        xyz = np.array([r[3:] for r in rows if r[1] == f])
        low = xyz[xyz[:, 2] <= np.percentile(xyz[:, 2], 35)]
        low = low if len(low) >= 10 else xyz
        draws, most, best = np.random.default_rng([4, zlib.crc32(f"a/{f}".encode())]), 0, (0.0, 0.0, 1.0, 1.5)
        for _ in range(50):
            a, b, c = low[draws.choice(len(low), 3, replace=False)]
            normal = np.cross(b - a, c - a)
            normal = normal / np.linalg.norm(normal) * (-1 if normal[2] < 0 else 1)
            near = (abs((low - a) @ normal) < 0.15).sum()
            if normal[2] >= 0.8 and near > most:
                most, best = near, (*normal, -normal @ a)
        assert tuple(got[f])[2:] == pytest.approx(best)
    assert tuple(got[2])[2:] == (0.0, 0.0, 1.0, 1.5)


def test_near_pairs_meet_once_and_stay_spread(spark):
    rng = np.random.default_rng(9)
    at = rng.uniform(-12, 12, (120, 2)).tolist()
    rows = spark.createDataFrame([(i % 2, i, *p) for i, p in enumerate(at)], "f int, k long, x double, y double")
    pairs = cluster.near_pairs(rows, ["f"], "k")
    assert sorted((r.f, r.a, r.b) for r in pairs.collect()) == sorted((i % 2, i, j) for i in range(120) for j in range(i + 1, 120) if i % 2 == j % 2 and math.dist(at[i], at[j]) <= 2.5)
    assert "REPARTITION_BY_NUM" in pairs._jdf.queryExecution().executedPlan().toString()
