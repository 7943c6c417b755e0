"""Settings files, registered functions, incremental exports, observed figures and the command line."""

from __future__ import annotations

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from arclattice import __main__ as command
from arclattice import config, serving
from arclattice.functions import fovea, labels, registered
from arclattice.operators import metrics, payload, project
from arclattice.plans import grid, services, sqltext
from arclattice.sources import frames, scenarios
from arclattice.views import view

SF = "/root/testdata/sf0.001"
FILE = """
grid:
  resolution_tiers:
    - [8.0, 0.1]
    - [20, 0.2]
    - [60.0, 0.4]
    - [100.0, 0.8]
  hysteresis_margin_m: 0.7
  min_points_per_ring_sector: 5
foveation:
  base_fine_radius_m: 12
  stretch_speed_ref_mps: 25.0
  shear_strength: 0.4
  motion_foveation_enabled: false
  max_threat_distance_m: 30.0
  corridor_half_width_m: wide
perception:
  names_to_4class:
    40: 0
    10: 3
"""


def test_files_of_the_known_form(tmp_path):
    (tmp_path / "a.yaml").write_text(FILE)
    got = config.load(str(tmp_path / "a.yaml"))
    p = got["fovea"]
    assert (p.base_radius, p.reference_speed, p.drawn_shear, p.enabled, p.farthest_threat) == (12.0, 25.0, 0.4, False, 30.0)
    assert p.corridor == config.FOVEA.corridor and p.shear == config.FOVEA.shear  # of another type, and not in the file
    assert (got["hysteresis"].radius_margin, got["hysteresis"].least_points) == (0.7, 5)
    assert got["tiers"] == ((8.0, 0.1), (20.0, 0.2), (60.0, 0.4), (100.0, 0.8)) and got["class_map"] == {40: 0, 10: 3}
    shown = serving.settings(str(tmp_path / "a.yaml"))
    assert shown["fovea"]["base_radius"] == 12.0 and shown["tiers"][3] == (100.0, 0.8) and serving.settings()["class_map"][252] == 3


@pytest.mark.parametrize("tiers", ["[[10, 0.05], [30, 0.01]]", "[[10, 0.05], [5, 0.15]]", "[10, 0.05]", "[]", "text", "[[10, true]]", "[[-1, 0.1]]"])
def test_tiers_that_make_no_sense(tmp_path, tiers):
    (tmp_path / "a.yaml").write_text(f"resolution_tiers: {tiers}\nclass_map: {{a: b}}\n")
    got = config.load(str(tmp_path / "a.yaml"))
    assert got["tiers"] == config.TIERS and got["class_map"] == config.RAW_TO_CLASS


def test_other_tiers_and_classes_are_used(spark):
    rows = spark.createDataFrame([(float(r), 0.1, 0.0) for r in (1, 9, 25, 70, 200)], "x double, y double, z double")
    tiers = ((8.0, 0.1), (20.0, 0.2), (60.0, 0.4), (100.0, 0.8))
    got = project.with_key(rows, tiers=tiers).orderBy("x").collect()
    assert [(r.resolution_tier, r.tier_idx) for r in got] == [(0.1, 0), (0.2, 1), (0.4, 2), (0.8, 3), (0.8, 3)]
    assert [r.ring_idx for r in project.with_key(rows, tiers=((50.0, 0.5),)).orderBy("x").collect()] == [2, 18, 50, 140, 400]
    raw = spark.createDataFrame([(10,), (40,), (99,)], "raw_class int")
    assert [r[0] for r in raw.select(labels.collapse(classes={40: 0, 10: 2})).collect()] == [2, 0, -1]


def test_registered_functions_follow_settings(spark):
    p = config.Fovea(base_radius=7.0, shear=0.5, farthest_threat=20.0)
    registered.register(spark, p)
    rows = spark.createDataFrame([(float(t), float(v), float(s)) for t in np.linspace(-3.1, 3.1, 9) for v in (0, 9, 40) for s in (-0.4, 0.2)], "theta double, v double, s double")
    both = rows.select(F.expr("fine_radius(theta, v, s, null)").alias("a"), fovea.fine_radius("theta", "v", "s", p=p).alias("b")).collect()
    assert all(r.a == pytest.approx(r.b) for r in both)
    tracks = spark.createDataFrame([(15.0, 1.0, -3.0, 0.0), (22.0, 1.0, -3.0, 0.0), (5.0, 4.0, 0.0, None)], "x double, y double, vx double, vy double")
    got = tracks.select(F.expr("threat(x, y, vx, vy)").alias("a"), fovea.threat(p=p).alias("b")).collect()
    assert [(r.a.kind, r.a.reach, r.a.bearing) for r in got] == [(r.b.kind, pytest.approx(r.b.reach), pytest.approx(r.b.bearing)) for r in got]
    registered.register(spark)


def test_sql_text_is_planned_like_columns(spark):
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    line = plan(sqltext.sql_polyline(spark, SF))
    assert "Python" not in line and "Nested" not in line and "Generate explode" in line  # the table function is inlined
    cells = plan(sqltext.sql_cells(spark, SF))
    assert cells.count("Exchange") == plan(grid.z_split(spark, SF)).count("Exchange") == 1
    sets = plan(metrics.evaluation(view(spark, SF, "points_v").withColumnRenamed("class_id", "gt")))
    assert sets.count("Exchange") == 1 and sets.count("FileScan") == 1


def test_split_of_awkward_heights(spark):
    assert registered.split_heights(np.array([1.0])) == {"ground": 1.0, "bottom": None, "top": None}
    assert registered.split_heights(np.array([0.0, 0.1, 3.0, 3.1])) == {"ground": 0.0, "bottom": 3.0, "top": 3.1}
    registered.register(spark)
    rows = spark.createDataFrame([(1, None), (1, 0.0), (1, 2.0), (2, None)], "k int, z double")
    rows.createOrReplaceTempView("awkward_heights")
    got = {r.k: r.s for r in spark.sql("SELECT k, z_split(z) AS s FROM awkward_heights GROUP BY k").collect()}
    assert got[1].bottom == 2.0 and got[2] is None


def test_exports_write_what_is_missing(spark, tmp_path):
    path, all_frames = str(tmp_path / "out"), view(spark, SF, "frames_v")
    asked = []

    def compute(some):
        asked.append(sorted(map(tuple, some.select("seq_id", "frame_id").collect())))
        return some.withColumn("n", F.lit(len(asked)))

    files = lambda: sorted((d, os.stat(f"{d}/{n}").st_mtime_ns) for d, _, names in os.walk(path) for n in names if n.endswith(".json"))
    payload.export_missing(all_frames, compute, path)
    assert len(asked[0]) == 28
    before = files()
    payload.export_missing(all_frames, compute, path)
    assert len(asked) == 1 and files() == before  # nothing is computed or written again
    for n in os.listdir(f"{path}/seq_id=1/frame_id=3"):
        os.remove(f"{path}/seq_id=1/frame_id=3/{n}")
    payload.export_missing(all_frames, compute, path)
    assert asked[1:] == [[(1, 3)]] and len(files()) == 28 and len(set(files()) & set(before)) == 27
    assert payload.written_frames(spark, str(tmp_path / "none"), all_frames).count() == 0


def test_figures_come_with_the_action(spark, tmp_path):
    cells, seen = metrics.observed(grid.static_cells(spark, SF))
    cells.write.parquet(str(tmp_path / "cells"))
    want = metrics.memory(grid.static_cells(spark, SF), []).first().asDict()
    assert metrics.observed_memory(seen) == want
    counts = metrics.overhang_counts(grid.static_cells(spark, SF), []).selectExpr("sum(overhangs) o", "sum(if(semantic_class = 3, n, 0)) d").first()
    assert (seen.get["overhangs"], seen.get["dynamic_cells"]) == (counts.o, counts.d)


def test_ghosts_and_tracks_of_payloads(spark):
    rows = services.payload_metrics(spark, SF).collect()
    assert sum(r.ghosts for r in rows) > 0 and 0 < sum(r.confirmed for r in rows) < sum(r.tracks for r in rows)


def test_command_line(spark, tmp_path, capsys):
    root, out = str(tmp_path / "scans"), str(tmp_path / "out")
    drive = scenarios.points(spark, 2, only=["highway_cruise"]).withColumn("seq_id", F.lit("07"))
    raw = F.element_at(F.create_map(*[F.lit(x) for kv in {0: 40, 1: 70, 2: 50, 3: 10}.items() for x in kv]), F.col("class_id"))
    frames.save_scans(drive.withColumn("class_id", raw), root)
    (tmp_path / "a.yaml").write_text("foveation:\n  base_fine_radius_m: 9.0\n")
    done = command.main(["export", "--scans", root, "--out", out, "--config", str(tmp_path / "a.yaml")], spark)
    assert sorted(map(tuple, done.collect())) == [("07", 0), ("07", 1)]
    written = spark.read.json(out)
    assert written.select("foveation_params.base_fine_radius_m").distinct().first()[0] == 9.0 and written.selectExpr("min(size(cells)) n").first().n > 100
    report = {(r.part, r.name): r.value for r in command.main(["eval", "--scans", root, "--sequence", "7", "--frames", "1"], spark).collect()}
    assert 0 < report["miou", "mean"] <= 1 and report["memory", "memory_savings_pct"] > 80
    assert "memory_savings_pct" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        command.main(["export", "--scans", root], spark)
