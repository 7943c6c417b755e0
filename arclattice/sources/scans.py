"""Scan folders and archives: point files, label files, poses, listings.

A point file holds little-endian float32 x, y, z, intensity; a label file a uint32 for each point,
the class in its low 16 bits. Frames are numbered in the order of their file names.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zipfile

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.window import Window

from ..config import DT
from ..operators.checkpoint import shared_folder

SEQUENCE = r"sequences/([^/]+)/"
POINT_BYTES = 16


def files(spark: SparkSession, root: str, glob: str = "*.bin") -> DataFrame:
    """(path, length, seq_id, frame_id) of the files below root; only their listing is read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root).select("path", "length")
    found = found.withColumn("seq_id", F.coalesce(F.nullif(F.regexp_extract("path", SEQUENCE, 1), F.lit("")), F.lit("00")))
    return found.withColumn("frame_id", F.row_number().over(Window.partitionBy("seq_id").orderBy("path")) - 1)


def sequences(listing: DataFrame) -> DataFrame:
    """(seq_id, scans), by sequence."""
    return listing.groupBy("seq_id").agg(F.countDistinct("frame_id").alias("scans"))


#: Where a sequence's scans may lie below the root, the first that has any counts; SEQ is its name.
LAYOUTS = ("dataset/sequences/SEQ/velodyne/", "sequences/SEQ/velodyne/", "SEQ/velodyne/", "velodyne/", "")


def discovered(spark: SparkSession, root: str, seq_id: str) -> DataFrame:
    """(path, length, frame_id) of one sequence below root, in the first of LAYOUTS that holds scans."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.bin").load(root).select("path", "length")
    base = re.sub("^[a-z]+:/*", "/", root).rstrip("/") + "/"
    below = F.expr("regexp_replace(path, '^[a-z]+:/*', '/')").substr(F.lit(len(base) + 1), F.lit(1 << 20))
    rank = F.lit(None).cast("int")
    for i, layout in reversed(list(enumerate(LAYOUTS))):
        here = below.rlike("^" + re.escape(layout.replace("SEQ", seq_id)) + "[^/]+$")
        rank = F.when(here, i).otherwise(rank)
    ranked = found.withColumn("_rank", rank).filter("_rank is not null")
    first = ranked.agg(F.min("_rank").alias("_rank"))
    return ranked.join(F.broadcast(first), "_rank").withColumn("frame_id", F.row_number().over(Window.orderBy("path")) - 1).drop("_rank")  # first: one row


def scan_at(listing: DataFrame, index: int) -> DataFrame:
    """The scan of that number; an IndexError where the listing has no such one."""
    n = listing.count()
    if not 0 <= index < n:
        raise IndexError(f"scan {index} of {n}")
    return listing.filter(F.col("frame_id") == index)


def sequence_name(n: int | str) -> str:
    return str(n).zfill(2)


def playlist(listing: DataFrame, only: list[str] | None = None) -> DataFrame:
    rows = listing.select("seq_id", "frame_id")
    return rows if only is None else rows.filter(F.col("seq_id").isin([sequence_name(s) for s in only]))


def one_size(listing: DataFrame, first: int = 10) -> DataFrame:
    """(seq_id, synthetic): whether the first files of a sequence, two at least, all have one size, as no real sensor's have."""
    head = listing.filter(F.col("frame_id") < first).groupBy("seq_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("length").alias("sizes"))
    return head.select("seq_id", ((F.col("n") >= 2) & (F.col("sizes") == 1)).alias("synthetic"))


def counted(points: bytes, labels: bytes | None) -> int:
    """Points of a file; a ValueError where its length, or that of its labels, does not fit."""
    if len(points) % POINT_BYTES:
        raise ValueError(f"a point file of {len(points)} bytes holds no whole number of points")
    n = len(points) // POINT_BYTES
    if labels is not None and len(labels) != 4 * n:
        raise ValueError(f"{len(labels) // 4} labels for {n} points")
    return n


def decode(points: bytes, labels: bytes | None, collapse: bool = False) -> dict[str, np.ndarray]:
    if len(points) % POINT_BYTES:
        raise ValueError(f"a point file of {len(points)} bytes holds no whole number of points")
    xyzi = np.frombuffer(points, "<f4").reshape(-1, 4)
    classes = np.full(len(xyzi), -1, np.int32)
    if labels is not None:
        words = np.frombuffer(labels, "<u4")
        if len(words) != len(xyzi):
            raise ValueError(f"{len(words)} labels for {len(xyzi)} points")
        classes = (words & 0xFFFF).astype(np.int32)
    return {"point_id": np.arange(len(xyzi), dtype=np.int64), **{n: xyzi[:, i].astype(np.float64) for i, n in enumerate(("x", "y", "z", "intensity"))}, "class_id": classes}


POINTS = "seq_id string, frame_id int, point_id long, x double, y double, z double, intensity double, class_id int"


def storage(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI (local, hdfs, s3, gs) and the path in it."""
    if path.startswith(("/", "file:")):
        return fs.LocalFileSystem(), re.sub("^file:/*", "/", path)
    return fs.FileSystem.from_uri(path)


def read_file(path: str | None) -> bytes | None:
    if path is None:
        return None
    system, inner = storage(path)
    with system.open_input_stream(inner) as f:
        return f.read()


def new_folder(spark: SparkSession) -> str:
    """A new folder in the one that all executors share."""
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def read_scans(spark: SparkSession, root: str, seq_ids: list[str] | None = None, parts: int | None = None) -> DataFrame:
    """Points of all scans below root, with the raw class of their label file or -1 without one.

    Only listings are joined; a task reads a scan and its labels itself, one pair at a time. parts: tasks
    that the scans are dealt to, four a core where it is not given.
    """

    def chosen(glob):
        listing = files(spark, root, glob)
        listing = listing.filter(F.col("seq_id").isin(seq_ids)) if seq_ids else listing
        return listing.withColumn("name", F.regexp_extract("path", r"([^/]+)\.[^.]+$", 1))

    scans = chosen("*.bin").select("seq_id", "frame_id", "name", "path")
    labels = chosen("*.label").select("seq_id", "name", F.col("path").alias("labels"))
    both = scans.join(labels, ["seq_id", "name"], "left").select("seq_id", "frame_id", "path", "labels")
    both = both.repartition(parts or 4 * spark.sparkContext.defaultParallelism, "path")  # names only, else a few tasks would read all

    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                t = decode(read_file(row["path"]), read_file(row["labels"]))
                n = len(t["x"])
                yield pa.record_batch([pa.array([row["seq_id"]] * n, pa.string()), pa.array(np.full(n, row["frame_id"], np.int32)), *map(pa.array, t.values())], ["seq_id", "frame_id", *t])

    return both.mapInArrow(run, POINTS)


def write_scans(points: DataFrame, root: str, with_labels: bool = True) -> DataFrame:
    """Writes root/sequences/SEQ/velodyne/FRAME.bin and labels; returns (path, points) of the files when it is run.

    root: a folder that all executors reach, as a path or as a URI that storage knows.
    """

    def run(group):
        group = group.sort_values("point_id")
        base = f"{root}/sequences/{group.seq_id.iloc[0]}"
        name = f"{int(group.frame_id.iloc[0]):06d}"
        out = [(f"{base}/velodyne/{name}.bin", group[["x", "y", "z", "intensity"]].to_numpy("<f4"))]
        if with_labels:
            out.append((f"{base}/labels/{name}.label", group["class_id"].to_numpy().astype("<i8").astype("<u4")))
        for path, data in out:
            system, inner = storage(path)
            system.create_dir(os.path.dirname(inner), recursive=True)
            part = f"{inner}.{uuid.uuid4().hex}.part"
            with system.open_output_stream(part) as f:
                f.write(np.ascontiguousarray(data).tobytes())
            system.move(part, inner)  # a rerun of the task replaces whole files
        import pandas as pd

        return pd.DataFrame([(p, len(group)) for p, _ in out], columns=["path", "points"])

    return points.groupBy("seq_id", "frame_id").applyInPandas(run, "path string, points long")


class _Member(InputPartition):
    def __init__(self, seq_id, frame_id, points, labels):
        self.seq_id, self.frame_id, self.points, self.labels = seq_id, frame_id, points, labels


class _ZipReader(DataSourceReader):
    def __init__(self, path, only):
        self.path, self.only = path, only

    def partitions(self):
        with zipfile.ZipFile(self.path) as z:
            names = sorted(n for n in z.namelist() if n.endswith(".bin"))
            there = set(z.namelist())
        out, count = [], {}
        for n in names:
            m = re.search(SEQUENCE, n)
            seq = m[1] if m else "00"
            frame = count.setdefault(seq, 0)
            count[seq] += 1
            label = n.replace("/velodyne/", "/labels/").replace(".bin", ".label")
            if not self.only or seq in self.only:
                out.append(_Member(seq, frame, n, label if label in there else None))
        return out

    def read(self, part):
        with zipfile.ZipFile(self.path) as z:
            t = decode(z.read(part.points), z.read(part.labels) if part.labels else None)
        n = len(t["x"])
        yield pa.RecordBatch.from_arrays([pa.array([part.seq_id] * n, pa.string()), pa.array(np.full(n, part.frame_id, np.int32)), *map(pa.array, t.values())], ["seq_id", "frame_id", *t])


class ScanZip(DataSource):
    """spark.read.format("scanzip").option("sequences", "00,01").load(zip): one partition for each scan in the archive."""

    @classmethod
    def name(cls):
        return "scanzip"

    def schema(self):
        return POINTS

    def reader(self, schema):
        only = [s for s in self.options.get("sequences", "").split(",") if s]
        return _ZipReader(self.options["path"], only)


def extract(archive: str, folder: str) -> int:
    """Unpacks the members that are missing or differ in size; returns how many. Nothing is opened while the note of the last run fits."""
    note = os.path.join(folder, ".extracted.json")
    stat = os.stat(archive)
    with zipfile.ZipFile(archive) as z:
        members = [i for i in z.infolist() if not i.is_dir()]
        now = {"size": stat.st_size, "mtime": stat.st_mtime, "members": len(members)}
        if os.path.exists(note):
            with open(note) as f:
                old = json.load(f)
            if old["size"] == now["size"] and old["members"] == now["members"] and abs(old["mtime"] - now["mtime"]) <= 1:
                return 0
        missing = [i for i in members if not os.path.exists(p := os.path.join(folder, i.filename)) or os.path.getsize(p) != i.file_size]
        for i in missing:
            z.extract(i, folder)
    os.makedirs(folder, exist_ok=True)
    with open(note, "w") as f:
        json.dump(now, f)
    return len(missing)


def read_poses(spark: SparkSession, path: str) -> DataFrame:
    """(seq_id, frame_id, pose) of pose text files, 12 numbers a line: three rows of four."""
    text = spark.read.text(path, wholetext=True).select("value", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.txt$", 1).alias("file"), F.col("_metadata.file_path").alias("full"))
    seq = F.when(F.col("file") == "poses", F.regexp_extract("full", SEQUENCE, 1)).otherwise(F.col("file"))
    lines = text.select(seq.alias("seq_id"), F.posexplode(F.filter(F.split("value", r"\r?\n"), lambda s: F.trim(s) != "")).alias("frame_id", "line"))
    return lines.select("seq_id", "frame_id", F.transform(F.split(F.trim("line"), r"\s+"), lambda s: s.cast("double")).alias("pose"))


def kinematics(poses: DataFrame, dt: float = DT) -> DataFrame:
    """(seq_id, frame_id, speed_mps, steering_angle_rad) from consecutive poses; the first of a sequence is 10 m/s straight on."""
    w = Window.partitionBy("seq_id").orderBy("frame_id")
    at = lambda i: F.element_at("pose", i)
    rows = poses.select("seq_id", "frame_id", at(4).alias("x"), at(8).alias("y"), F.atan2(at(5), at(1)).alias("yaw"))
    before = lambda c: F.lag(c).over(w)
    dx, dy = F.col("x") - before("x"), F.col("y") - before("y")
    turn = F.pmod(F.col("yaw") - before("yaw") + F.pi(), F.lit(2.0) * F.pi()) - F.pi()
    speed = F.sqrt(dx * dx + dy * dy) / max(dt, 1e-3)
    return rows.select("seq_id", "frame_id", F.coalesce(speed, F.lit(10.0)).alias("speed_mps"), F.when(turn.isNull(), 0.0).otherwise(F.least(F.greatest(turn, F.lit(-0.8)), F.lit(0.8))).alias("steering_angle_rad"))
