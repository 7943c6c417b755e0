"""Settings, layouts, reports, exports and single frames."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from arclattice import config, serving
from arclattice.operators import hysteresis, metrics, payload, track
from arclattice.sources import scans


def test_settings_fall_back(tmp_path):
    assert config.load(str(tmp_path / "none.yaml"))["fovea"] == config.FOVEA
    (tmp_path / "a.yaml").write_text("fovea:\n  base_radius: 12\n  enabled: 3\n  other: 1\nhysteresis: text\n")
    got = config.load(str(tmp_path / "a.yaml"))
    assert got["fovea"].base_radius == 12.0 and got["fovea"].enabled is True and got["hysteresis"] == config.HYSTERESIS
    (tmp_path / "b.yaml").write_text("fovea: [")
    assert config.load(str(tmp_path / "b.yaml"))["tracking"] == config.TRACKING


@pytest.mark.parametrize("layout", scans.LAYOUTS)
def test_layouts_and_range(spark, tmp_path, layout):
    for place in (layout, "velodyne/old/"):
        folder = tmp_path / place.replace("SEQ", "04")
        folder.mkdir(parents=True, exist_ok=True)
        for i in range(3):
            (folder / f"{i:06d}.bin").write_bytes(b"\0" * 16)
    found = scans.discovered(spark, str(tmp_path), "04")
    assert [r.frame_id for r in found.orderBy("path").collect()] == [0, 1, 2]
    assert scans.scan_at(found, 2).first().path.endswith("000002.bin")
    for i in (-1, 3):
        with pytest.raises(IndexError):
            scans.scan_at(found, i)


def test_native_states(spark):
    rows = spark.createDataFrame([(0, i, r) for i, r in enumerate([10.0, 10.4, 10.8, 11.0, 11.31])], "sector int, frame_id int, radius double")
    assert [r.held for r in hysteresis.radius_hold(rows, ["sector"]).orderBy("frame_id").collect()] == [10.0, 10.0, 10.8, 10.8, 11.31]
    want, state = [], None
    for r in rows.orderBy("frame_id").collect():
        state = r.radius if state is None else state * 0.35 + r.radius * 0.65
        want.append(state)
    assert [r.radius for r in hysteresis.ema(rows, ["sector"], ["radius"]).orderBy("frame_id").collect()] == pytest.approx(want)
    points = spark.createDataFrame([("a", 0, 0.0, 10.0), ("a", 0, 0.009, 12.0), ("a", 1, 0.0, 11.2), ("a", 1, 0.02, 9.0)], "seq_id string, frame_id int, theta double, fine double")
    assert sorted((r.frame_id, r.theta, r.fine) for r in hysteresis.smoothed(points).collect()) == [(0, 0.0, 11.0), (0, 0.009, 11.0), (1, 0.0, 11.0), (1, 0.02, 9.0)]


def test_vacated_cells_over_skipped_frames(spark):
    prints = spark.createDataFrame([("a", 0, 1, 0, 5, 5), ("a", 3, 1, 0, 6, 5)], "seq_id string, frame_id int, track_id long, tier_idx int, ring_idx long, angle_idx long")
    frames = spark.createDataFrame([("a", 0), ("a", 3)], "seq_id string, frame_id int")
    cells = spark.createDataFrame([("a", 3, 0, 5, 5, 3, 0)], "seq_id string, frame_id int, tier_idx int, ring_idx long, angle_idx long, semantic_class int, last_updated_frame int")
    assert [(r.frame_id, r.ring_idx, r.outcome) for r in track.vacated(prints, frames, cells).collect()] == [(3, 5, "stale")]


def test_report(spark):
    labels = spark.createDataFrame([(1.0, 0.0, 0, 0), (20.0, 0.0, 1, 1), (50.0, 0.0, 2, 1)], "x double, y double, gt int, pred int")
    cells = spark.createDataFrame([(0.5,), (0.05,)], "resolution_tier double")
    rows = {(r.part, r.name): r for r in metrics.report(labels, cells, {"one": lambda: labels}, 1, runs=1).collect()}
    assert rows["miou", "class 0"].value == 1.0 and rows["miou", "class 1"].value == 0.5 and rows["miou by distance", "0-10m"].value > 0
    assert rows["memory", "memory_savings_pct"].passed is (rows["memory", "memory_savings_pct"].value >= 85)
    assert rows["ms a frame", "total"].value > 0 and rows["throughput", "frames a second"].passed is not None


def test_exports_and_single_frames(spark, tmp_path):
    state = F.struct(F.lit(10.0).alias("speed_mps"), F.lit(0.0).alias("steering_angle_rad")).alias("vehicle_state")
    none = F.array().cast("array<array<double>>").alias("fovea_polyline")
    rows = spark.range(5).select(F.lit("04").alias("seq_id"), F.col("id").cast("int").alias("frame_id"), state, none)
    path = str(tmp_path / "bench")
    assert payload.export_benchmark(rows, path, frames=3) and not payload.export_benchmark(rows, path)
    assert payload.export_all({"a": rows, "b": rows}, str(tmp_path / "all"), frames=2) == {"a": True, "b": True}
    assert payload.export_all({"a": rows}, str(tmp_path / "all")) == {"a": False}
    written = spark.read.schema(rows.schema).json(path)
    assert written.count() == 3
    computed = lambda s, i: spark.createDataFrame([(s, i, "computed")], "seq_id string, frame_id int, how string")
    got = serving.frame(spark, written, "seq_4", 1, computed).first()
    assert got.seq_id == "04" and len(got.fovea_polyline) == 120
    assert serving.frame(spark, written, "4", 9, computed).first().how == "computed"
    assert serving.frame(spark, None, "4", 0, computed).first().how == "computed"
