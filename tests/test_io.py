from __future__ import annotations

import json
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from arclattice import serving
from arclattice.operators import loop, payload
from arclattice.plans import services
from arclattice.sources import samples, scans, scenarios

POINTS = "seq_id string, frame_id int, point_id long, x double, y double, z double, intensity double, class_id int"
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("scans"))
    rows = [(s, f, i, float(i), 0.5, -1.5, 0.25, (40 | (i << 16)) if i % 2 else 252) for s in ("00", "01") for f in range(3) for i in range(4 + f * (s == "01"))]
    scans.write_scans(spark.createDataFrame(rows, POINTS), root).count()
    return root


def test_scan_round_trip(spark, folder):
    got = scans.read_scans(spark, folder).collect()
    assert len(got) == 12 + 15
    assert {(r.x == r.point_id, r.class_id == (40 if r.point_id % 2 else 252)) for r in got} == {(True, True)}
    assert {r.seq_id for r in scans.read_scans(spark, folder, ["01"]).collect()} == {"01"}


def test_no_bytes_are_shuffled(spark, folder):
    plan = scans.read_scans(spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" in plan and "content" not in plan


def test_scans_by_uri_and_without_labels(spark, tmp_path):
    rows = [("00", 0, i, float(i), 0.5, -1.5, 0.25, 40) for i in range(5)]
    root = f"file://{tmp_path}/a b"
    for _ in range(2):  # the second run replaces the files of the first
        assert scans.write_scans(spark.createDataFrame(rows, POINTS), root, with_labels=False).count() == 1
    got = scans.read_scans(spark, root, parts=2).collect()
    assert {(r.point_id, r.class_id) for r in got} == {(i, -1) for i in range(5)}


def test_samples(spark, tmp_path):
    rows = samples.drive(spark, 2)
    assert rows.count() == 2 * 12_770
    scans.write_scans(rows, str(tmp_path)).count()
    back = scans.read_scans(spark, str(tmp_path))
    counts = lambda df, c: {tuple(r) for r in df.groupBy("frame_id", c.alias("raw")).count().collect()}
    assert counts(back, F.col("class_id")) == counts(rows, F.col("class_id").bitwiseAND(0xFFFF))
    car = back.filter("frame_id = 1 and class_id = 10 and y > 0").selectExpr("min(x) lo", "max(x) hi").first()
    assert 13.8 <= car.lo < 14.0 and 17.6 < car.hi <= 17.8
    road = rows.filter("class_id = 40").selectExpr("regr_slope(z, x) slope", "avg(z - 0.005 * x) z").first()
    assert road.slope == pytest.approx(0.005, abs=2e-4) and road.z == pytest.approx(-1.5, abs=2e-3)
    scan = samples.scan(spark).collect()
    assert len(scan) == 4810 and [r.point_id for r in scan] != sorted(r.point_id for r in scan) and scan == samples.scan(spark).collect()
    pole = sorted(r.z for r in scan if r.class_id == 80)
    assert pole == pytest.approx([3 * j / 49 for j in range(50)], abs=1e-6)


def test_scopes(spark):
    rows = spark.createDataFrame([("01", "real", False), ("02", "real", True), ("a", "synthetic", None)], "id string, kind string, precomputed boolean")
    plays = lambda df, scope: sorted(r.id for r in serving.scoped(df, scope).collect())
    assert [plays(rows, s) for s in ("all", "real", "ready")] == [["01", "02", "a"], ["01", "02"], ["02", "a"]]
    assert plays(rows.filter("id = 'a'"), "real") == ["a"] and plays(rows.filter("id = '01'"), "ready") == ["01"]
    assert plays(rows.limit(0), "real") == []


def test_listing(spark, folder):
    listing = scans.files(spark, folder)
    assert {(r.seq_id, r.scans) for r in scans.sequences(listing).collect()} == {("00", 3), ("01", 3)}
    assert {(r.seq_id, r.synthetic) for r in scans.one_size(listing).collect()} == {("00", True), ("01", False)}
    assert scans.playlist(listing, ["1"]).count() == 3


def test_archive(spark, folder, tmp_path):
    import os

    path = str(tmp_path / "scans.zip")
    with zipfile.ZipFile(path, "w") as z:
        for d, _, names in os.walk(folder):
            for n in names:
                z.write(os.path.join(d, n), os.path.relpath(os.path.join(d, n), folder))
    spark.dataSource.register(scans.ScanZip)
    whole = spark.read.format("scanzip").load(path)
    key = lambda r: (r.seq_id, r.frame_id, r.point_id)
    assert sorted(whole.collect(), key=key) == sorted(scans.read_scans(spark, folder).collect(), key=key)
    assert spark.read.format("scanzip").option("sequences", "00").load(path).count() == 12
    out = str(tmp_path / "out")
    assert scans.extract(path, out) == 12
    assert scans.extract(path, out) == 0
    os.remove(f"{out}/.extracted.json")
    os.remove(f"{out}/sequences/00/velodyne/000001.bin")
    assert scans.extract(path, out) == 1


def test_bad_files():
    with pytest.raises(ValueError):
        scans.decode(b"123", None)
    with pytest.raises(ValueError):
        scans.decode(bytes(32), bytes(4))


def test_poses(spark, tmp_path):
    (tmp_path / "03.txt").write_text("1 0 0 0 0 1 0 0 0 0 1 0\n1 0 0 3 0 1 0 4 0 0 1 0\n0 -1 0 3 1 0 0 4 0 0 1 0\n")
    got = scans.kinematics(scans.read_poses(spark, str(tmp_path / "*.txt"))).orderBy("frame_id").collect()
    assert [(r.seq_id, r.speed_mps, r.steering_angle_rad) for r in got] == [("03", 10.0, 0.0), ("03", pytest.approx(50.0), 0.0), ("03", 0.0, 0.8)]


def test_scenarios_are_alike_on_every_run(spark):
    a = scenarios.points(spark, 2, only=["pothole_alley"])
    assert a.count() == 2 * 8500
    total = a.selectExpr("round(sum(x), 3) s", "count_if(class_id = 1) n").first()
    assert total == scenarios.points(spark, 2, only=["pothole_alley"]).repartition(3).selectExpr("round(sum(x), 3) s", "count_if(class_id = 1) n").first()
    assert total.n > 3000
    assert {r.scenario_name for r in scenarios.frames(spark, 1).collect()} == {v[0] for v in scenarios.SCENARIOS.values()}


def test_payload_and_messages(spark, tmp_path):
    df = services.frame_payload(spark, SF)
    payload.write_payload(df, str(tmp_path / "p"), most_frames=3)
    back = payload.read_payload(spark, str(tmp_path / "p"), df.schema)
    assert back.count() == 8 and back.selectExpr("max(size(fovea_polyline)) n").first().n == 120
    payload.write_payload(df, str(tmp_path / "p"))
    assert payload.read_payload(spark, str(tmp_path / "p"), df.schema).count() == 8
    assert payload.read_payload(spark, str(tmp_path / "none"), df.schema) is None
    m = payload.compressed(df).first().message
    frame = json.loads(zlib.decompress(bytes(m)))
    assert frame["metrics"]["active_cells_count"] == len(frame["cells"]) > 0
    assert frame["metrics"]["memory_savings_pct"] > 80


def test_closed_loop_follows_tracks(spark):
    from arclattice.config import Fovea

    frames = scenarios.frames(spark, 3).filter("seq_id = 'highway_cruise'").withColumn("roof", scenarios.roof_height())
    cells, tracks, ghosts = loop.closed_loop(scenarios.points(spark, 3, only=["highway_cruise"]), frames, Fovea())
    last = tracks.filter("frame_id = 2").collect()
    assert any(t.state == "CONFIRMED" for t in last)
    assert cells.select("frame_id").distinct().count() == 3 and ghosts.count() == 3


def test_serving(spark):
    assert serving.health(spark)["status"] == "ok"
    assert serving.settings()["fovea"]["base_radius"] == 10.0
    assert serving.contour(spark, 15.0, 0.2).count() == 120
    state = None
    for command, value, want in [("step", 0, (0, 1)), ("seek", 99, (0, 19)), ("step", 0, (1, 0)), ("set_auto_loop", 0, (1, 0)), ("seek", 19, (1, 19)), ("step", 0, (1, 19)), ("prev_scenario", 0, (0, 0))]:
        state = serving.playback_step(state, command, value, 20, 4)
        assert state[:2] == want


def test_entry_and_names(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
