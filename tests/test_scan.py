"""States handed from range to range against a plain loop."""

from __future__ import annotations

import random
import time

import pytest

from arclattice import serving
from arclattice.operators import hysteresis, scan, track

SCHEMA = "key string, frame_id int, v double"


def plain(rows, step):
    out, states = {}, {}
    for key, frame, v in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1])):
        states[key], made = step(states.get(key), v)
        out[key, frame] = made
    return out


def steps():
    """Made within a function, so that workers need not import this file. `total` forgets nothing: every range of a key waits for the one before."""

    def hold(was, v):
        was = hysteresis.hold(was, v, 0.5)
        return was, (was,)

    def total(was, v):
        was = (was or 0.0) + v
        return was, (was,)

    def kalman(was, v):
        was = track.Track(1, 3, v, 0.0) if was is None else track.corrected(track.predicted(was), v, 0.0, 3)
        return was, (was.x,)

    return hold, total, kalman


hold, total, kalman = steps()


def table():
    rng = random.Random(6)
    hot = [("hot", i, round(rng.uniform(0, 4), 2)) for i in range(900)]
    return hot + [(f"k{i % 40}", i, round(rng.uniform(0, 4), 2)) for i in range(400)] + [(None, i, 1.0 * i) for i in range(50)]


@pytest.mark.parametrize("step", [hold, total, kalman])
@pytest.mark.parametrize("ranges", [1, 3, 17])
def test_ranges_cut_keys_anywhere(spark, step, ranges):
    rows = table()
    random.Random(1).shuffle(rows)
    out = scan.scan(spark.createDataFrame(rows, SCHEMA).repartition(5), ["key"], ["frame_id"], ["v"], step, "made double", ranges).collect()
    assert {(r.key, r.frame_id): (r.made,) for r in out} == plain(rows, step) and len(out) == len(rows)


def test_only_states_that_remember_walk_often(spark, monkeypatch):
    rounds = []
    real = scan.settled

    def counted(held, ends, *rest):
        frames = []
        plain_filter = type(held).filter
        monkeypatch.setattr(type(held), "filter", lambda df, c: frames.append(1) or plain_filter(df, c))
        out = real(held, ends, *rest)
        monkeypatch.setattr(type(held), "filter", plain_filter)
        rounds.append(len(frames))
        return out

    monkeypatch.setattr(scan, "settled", counted)
    rows = spark.createDataFrame([("hot", i, float(i % 7)) for i in range(800)], SCHEMA)
    for step in (hold, total):
        scan.scan(rows, ["key"], ["frame_id"], ["v"], step, "made double", 8).collect()
    held, remembered = rounds
    assert held <= 2 < remembered <= 8


def test_awkward_rows(spark):
    assert scan.scan(spark.createDataFrame([], SCHEMA), ["key"], ["frame_id"], ["v"], hold, "made double").collect() == []
    one = scan.scan(spark.createDataFrame([("a", 1, None), ("a", 2, 1.0), ("a", 2, 1.0), (None, None, 3.0)], SCHEMA), ["key"], ["frame_id"], ["v"], hold, "made double", 2).collect()
    assert sorted((r.key or "", r.frame_id or 0, r.made) for r in one if r.made is not None) == [("", 0, 3.0), ("a", 2, 1.0), ("a", 2, 1.0)] and len(one) == 4
    twice = spark.createDataFrame([("a", "b", i, 1.0) for i in range(9)] + [("a", "c", i, 2.0) for i in range(9)], "k string, l string, frame_id int, v double")
    got = scan.scan(twice, ["k", "l"], ["frame_id"], ["v"], total, "made double", 4).groupBy("k", "l").max("made").collect()
    assert sorted(tuple(r) for r in got) == [("a", "b", 9.0), ("a", "c", 18.0)]


def test_time_is_linear(spark):
    def took(n):
        rows = spark.range(n).selectExpr("id % 2 as key", "cast(id as int) as frame_id", "cast(id % 97 as double) as v").cache()
        rows.count()
        best = 1e9
        for _ in range(2):
            began = time.perf_counter()
            scan.scan(rows, ["key"], ["frame_id"], ["v"], hold, "made double", 4).write.format("noop").mode("overwrite").save()
            best = min(best, time.perf_counter() - began)
        return best

    took(1000)
    one, ten = took(30_000), took(300_000)
    assert ten < 14 * one


def test_smoothing_and_playback_over_ranges(spark, monkeypatch):
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        rng = random.Random(3)
        rows = [("s", i, rng.uniform(5, 9), rng.uniform(0, 1)) for i in range(300)]
        out = hysteresis.ema(spark.createDataFrame(rows, "k string, frame_id int, a double, b double"), ["k"], ["a", "b"]).orderBy("frame_id").collect()
        was = rows[0][2:]
        for r, (_, _, a, b) in zip(out, rows, strict=True):
            was = (a, b) if r.frame_id == 0 else (was[0] * 0.35 + a * 0.65, was[1] * 0.35 + b * 0.65)
            assert (r.a, r.b) == pytest.approx(was, abs=1e-9)
        commands = [("c", i, rng.choice(["set_scenario", "next_scenario", "prev_scenario", "set_auto_loop", "play", "pause", "seek", "step", "step"]), rng.randint(0, 30)) for i in range(200)]
        state, want = None, []
        for _, _, c, v in commands:
            state = serving.playback_step(state, c, v, 20, 4)
            want.append(state)
        got = serving.playback(spark.createDataFrame(commands, "c string, position int, command string, value int"), ["c"]).orderBy("position").collect()
        assert [tuple(r)[2:] for r in got] == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
