"""Scan and message sources: pushed filters, commit and abort, streams."""

from __future__ import annotations

import os
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from arclattice.operators import payload
from arclattice.plans import services
from arclattice.sources import frames, scans

POINTS = frames.SCAN
SF = "/root/testdata/sf0.001"


def points(spark, seqs=("00", "01"), n=3, first=0):
    rows = [(s, first + f, i, float(i), 0.5, -1.5, 0.25, 40 if i % 2 else 252, i) for s in seqs for f in range(n) for i in range(4 + f)]
    return spark.createDataFrame(rows, POINTS).orderBy(F.rand(3))


def paths(root):
    return sorted(os.path.relpath(os.path.join(d, n), root) for d, _, names in os.walk(root) for n in names if not n.endswith(".crc"))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("frames") / "a b")
    frames.save_scans(points(spark), root)
    return root


def test_round_trip(spark, folder):
    key = lambda r: (r.seq_id, r.frame_id, r.point_id)
    want = sorted((tuple(r) for r in points(spark).collect()), key=lambda r: r[:3])
    assert [tuple(r) for r in sorted(frames.load_scans(spark, folder).collect(), key=key)] == want
    assert len(paths(folder)) == 12 and not any(p.startswith(".") for p in paths(folder))
    old = scans.read_scans(spark, folder)
    assert sorted(map(tuple, old.collect()), key=lambda r: r[:3]) == [r[:-1] for r in want]
    assert frames.load_scans(spark, f"file://{folder}").count() == len(want)


@pytest.mark.parametrize(("where", "opens"), [("seq_id = '01'", 3), ("seq_id in ('01', '07')", 3), ("frame_id = 1", 2), ("frame_id >= 1 and frame_id < 2 and seq_id = '00'", 1), ("frame_id > 0 and x > 2", 4), ("seq_id = '09'", 0), ("seq_id >= '01'", 6)])
def test_filters_choose_the_files(spark, folder, where, opens):
    df = frames.load_scans(spark, folder).filter(where)
    assert df.rdd.getNumPartitions() == max(1, opens)
    assert df.count() == points(spark).filter(where).count()


def test_other_files_are_not_opened(spark, tmp_path):
    root = str(tmp_path)
    frames.save_scans(points(spark), root)
    for name in paths(root):
        if "sequences/00/" in name or name.endswith("000002.bin"):
            with open(f"{root}/{name}", "wb") as f:
                f.write(b"x")  # no reader gets over this
    assert frames.load_scans(spark, root).filter("seq_id = '01' and frame_id <= 1").count() == 9
    with pytest.raises(Exception, match="whole number of points"):
        frames.load_scans(spark, root).filter("seq_id = '01'").count()


def test_empty_folders(spark, tmp_path):
    assert frames.load_scans(spark, str(tmp_path)).count() == 0 and frames.load_scans(spark, str(tmp_path / "none")).count() == 0
    frames.save_scans(points(spark).limit(0), str(tmp_path / "new"))
    assert paths(str(tmp_path)) == []


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    root = str(tmp_path)
    frames.save_scans(points(spark, n=1), root)
    before = paths(root)
    bad = points(spark, n=3, first=1).withColumn("z", F.when((F.col("seq_id") == "01") & (F.col("frame_id") == 3), F.expr("cast(raise_error('no such point') as double)")).otherwise(F.col("z")))
    with pytest.raises(Exception, match="no such point"):
        frames.save_scans(bad, root)
    assert paths(root) == before and not [d for d in os.listdir(root) if d.startswith(".job")]


def test_modes(spark, tmp_path):
    root = str(tmp_path)
    frames.save_scans(points(spark), root)
    with pytest.raises(Exception, match="there already"):
        frames.save_scans(points(spark, n=1), root)
    assert len(paths(root)) == 12
    frames.save_scans(points(spark, n=1).withColumn("x", F.lit(7.0)), root, mode="overwrite")
    got = frames.load_scans(spark, root)
    assert got.filter("x = 7").count() == 4 + 4 and len(paths(root)) == 12 and got.count() == points(spark).count()
    shared = points(spark, ("05",), 1).repartition(3).sortWithinPartitions("seq_id", "frame_id")
    with pytest.raises(Exception, match="two tasks wrote the same frame"):
        shared.write.format("scans").mode("append").save(root)
    assert len(paths(root)) == 12


def test_a_stream_writes_every_frame_once(spark, tmp_path):
    frames.register(spark)
    source, root = str(tmp_path / "in"), str(tmp_path / "out")

    def run():
        rows = spark.readStream.schema(POINTS).option("maxFilesPerTrigger", 1).parquet(source)
        query = rows.writeStream.format("scans").option("path", root).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        query.awaitTermination()

    points(spark, n=1).sortWithinPartitions("seq_id", "frame_id").coalesce(1).write.mode("append").parquet(source)
    run()
    points(spark, n=1, first=1).sortWithinPartitions("seq_id", "frame_id").coalesce(1).write.mode("append").parquet(source)
    run()
    assert [p for p in paths(root) if p.endswith(".bin")] == [f"sequences/{s}/velodyne/{i:06d}.bin" for s in ("00", "01") for i in range(2)]
    stamps = {p: os.stat(f"{root}/{p}").st_mtime_ns for p in paths(root)}
    # the batch was written but its end was not noted by the query: it comes again, and is dropped
    for name in os.listdir(tmp_path / "check" / "commits"):
        if name.strip(".").startswith("1"):
            os.remove(tmp_path / "check" / "commits" / name)
    run()
    assert {p: os.stat(f"{root}/{p}").st_mtime_ns for p in paths(root)} == stamps
    assert not [d for d in os.listdir(root) if d.startswith(".job")]


def test_message_files(spark, tmp_path):
    frames.register(spark)
    root = str(tmp_path)
    sent = payload.compressed(services.frame_payload(spark, SF)).withColumn("seq_id", frames.sequence_number())
    sent.repartition("seq_id", "frame_id").sortWithinPartitions("seq_id", "frame_id").write.format("frame_messages").mode("append").save(root)
    assert len(paths(root)) == 28
    with open(f"{root}/00/000001.z", "rb") as f:
        assert zlib.decompress(f.read()).startswith(b'{"seq_id":0,"frame_id":1')


def test_newest_scans(spark, folder, tmp_path):
    seen = {}

    def run(check, **options):
        seen.clear()
        stream = frames.newest_scans(spark, folder, **options)

        def batch(df, n):
            seen[n] = sorted((r.seq_id, r.frame_id) for r in df.select("seq_id", "frame_id").distinct().collect())

        query = stream.writeStream.foreachBatch(batch).option("checkpointLocation", str(tmp_path / check)).start()
        query.processAllAvailable()
        query.stop()
        return dict(seen)

    got = run("a", framesPerTrigger=4, keep=2)
    assert got == {0: [("00", 2), ("01", 0)], 1: [("01", 1), ("01", 2)]}
    assert run("a", framesPerTrigger=4, keep=2) == {}  # nothing new
    # a batch that was planned but not finished comes again from its noted offsets, whatever is due now
    for name in os.listdir(tmp_path / "a" / "commits"):
        if name.strip(".").startswith("1"):
            os.remove(tmp_path / "a" / "commits" / name)
    assert run("a", framesPerTrigger=1, keep=2) == {1: got[1]}
    assert set(run("b", framesPerTrigger=1, keep=2, sequences="01").values().__iter__().__next__()) == {("01", 0)}


def test_files_are_decoded_and_gathered_slim(tmp_path, monkeypatch):
    """A scan is decoded batch by batch, and a frame that is written waits without its key, in the files' own width."""
    n = 25
    (tmp_path / "a.bin").write_bytes(np.arange(4 * n, dtype="<f4").tobytes())
    (tmp_path / "a.label").write_bytes((np.arange(n, dtype="<u4") + (7 << 16)).tobytes())
    sizes = []
    monkeypatch.setattr(frames, "ROWS", 10)
    monkeypatch.setattr(frames, "decode", lambda p, w: sizes.append(len(p)) or scans.decode(p, w))
    batches = list(frames.opened(frames.Scan("00", 3, str(tmp_path / "a.bin"), str(tmp_path / "a.label"))))
    assert sizes == [160, 160, 80] and [b.num_rows for b in batches] == [10, 10, 5]
    whole = pa.Table.from_batches(batches).to_pydict()
    assert whole["point_id"] == whole["class_id"] == list(range(n)) and whole["instance"] == [7] * n and whole["y"] == [4.0 * i + 1 for i in range(n)]
    seen = []
    frames.FrameFiles(str(tmp_path / "out"), lambda seq, frame, t: seen.append(t.schema) or [], True).write(iter(batches))
    assert seen[0].names == ["point_id", "x", "y", "z", "intensity", "class_id", "instance"] and seen[0].field("x").type == pa.float32()
