"""Scans and frame messages as data sources: reading with pushed filters, writing with commit and abort, streams with offsets.

spark.read.format("scans").load(root)       one partition a scan; filters on seq_id and frame_id are
                                            pushed, so that no other file is opened or, for sequences, listed
points.write.format("scans").save(root)     point and label files (save_scans sorts the rows first)
messages.write.format("frame_messages")     a file for each message
stream.writeStream.format(...)              either, a trigger at a time
spark.readStream.format("scan_listing")     scans as they become due; read_listed opens them in tasks

Writers put files into a folder of their own job. They are moved to their names when all tasks are done, and the folder goes with the
job, so that a failed one leaves nothing. A stream notes its finished batches: one that comes
again is dropped. Files are reached through pyarrow (local, hdfs, s3, gs).
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamArrowWriter, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, SimpleDataSourceStreamReader,
    WriterCommitMessage,
)

from .scans import POINT_BYTES, POINTS, counted, decode, read_file, storage

SCAN = POINTS + ", instance int"
LISTED = "seq_id string, frame_id int, path string, labels string"
MESSAGE = "seq_id string, frame_id int, message binary"
#: Points of a batch.
ROWS = 1 << 16
_COMPARED = {EqualTo: lambda x, v: x == v, In: lambda x, v: x in v, GreaterThan: lambda x, v: x > v, GreaterThanOrEqual: lambda x, v: x >= v, LessThan: lambda x, v: x < v, LessThanOrEqual: lambda x, v: x <= v}


@dataclass
class Scan(InputPartition):
    seq_id: str
    frame_id: int
    path: str
    labels: str | None


def base_of(system: fs.FileSystem, root: str) -> tuple[str, list[str]]:
    """The folder of the sequences below root, and their names."""
    for base in (f"{root}/dataset/sequences", f"{root}/sequences", root):
        found = system.get_file_info(fs.FileSelector(base, allow_not_found=True))
        names = sorted(f.base_name for f in found if f.type == fs.FileType.Directory and not f.base_name.startswith("."))
        if names and (base != root or any(system.get_file_info(f"{base}/{n}/velodyne").type == fs.FileType.Directory for n in names)):
            return base, names
    return root, []


def listed(path: str, wanted=lambda seq_id: True) -> Iterator[Scan]:
    """The scans of the wanted sequences, in the order of sequence and file name; no other folder is listed."""
    system, root = storage(path.rstrip("/"))
    prefix = path.rstrip("/")[: len(path.rstrip("/")) - len(root)] if path.rstrip("/").endswith(root) else ""
    base, names = base_of(system, root)

    def files(folder, end):
        found = system.get_file_info(fs.FileSelector(folder, allow_not_found=True))
        return {f.base_name[: -len(end)]: f.path for f in found if f.type == fs.FileType.File and f.base_name.endswith(end)}

    for name in filter(wanted, names):
        labels = files(f"{base}/{name}/labels", ".label")
        for i, (frame, file) in enumerate(sorted(files(f"{base}/{name}/velodyne", ".bin").items())):
            yield Scan(name, i, prefix + file, prefix + labels[frame] if frame in labels else None)


def opened(s: Scan) -> Iterator[pa.RecordBatch]:
    """The points of one scan, decoded batch by batch."""
    points, words = read_file(s.path), read_file(s.labels)
    n = counted(points, words)
    points, words = memoryview(points), None if words is None else memoryview(words)
    for i in range(0, n, ROWS):
        m = min(ROWS, n - i)
        own = None if words is None else words[4 * i : 4 * (i + m)]
        t = decode(points[POINT_BYTES * i : POINT_BYTES * (i + m)], own)
        t["point_id"] += i
        t["instance"] = np.zeros(m, np.int32) if own is None else (np.frombuffer(own, "<u4") >> 16).astype(np.int32)
        columns = [pa.array([s.seq_id] * m, pa.string()), pa.array(np.full(m, s.frame_id, np.int32)), *map(pa.array, t.values())]
        yield pa.RecordBatch.from_arrays(columns, ["seq_id", "frame_id", *t])


class ScanReader(DataSourceReader):
    def __init__(self, path: str):
        self.path, self.filters = path, []

    def pushFilters(self, filters):  # noqa: N802
        for f in filters:
            if type(f) in _COMPARED and f.attribute in (("seq_id",), ("frame_id",)) and (f.attribute == ("frame_id",) or isinstance(f, EqualTo | In)):
                self.filters.append((f.attribute[0], type(f), f.value))
            else:
                yield f

    def partitions(self):
        holds = lambda column, x: all(_COMPARED[kind](x, value) for c, kind, value in self.filters if c == column)
        return [s for s in listed(self.path, lambda seq_id: holds("seq_id", seq_id)) if holds("frame_id", s.frame_id)]

    def read(self, partition: Scan | None):
        if partition is not None:  # Spark makes one where there is none
            yield from opened(partition)


@dataclass
class Written(WriterCommitMessage):
    #: (where a file is, where it belongs below the root)
    files: list


def slim(b: pa.RecordBatch) -> pa.RecordBatch:
    """What a frame's files need of its rows: its key left out, coordinates as the files hold them."""
    columns = {n: b.column(n) for n in b.schema.names if n not in ("seq_id", "frame_id")}
    return pa.RecordBatch.from_pydict({n: c.cast(pa.float32(), safe=False) if pa.types.is_floating(c.type) else pa.concat_arrays([c]) for n, c in columns.items()})


class FrameFiles:
    """The two steps of writing frames: tasks put files into the job's folder, commit moves them to their names."""

    def __init__(self, path: str, files_of, replace: bool, name: str | None = None):
        self.path, self.files_of, self.replace, self.name = path.rstrip("/"), files_of, replace, name
        self.job = f".job-{name or uuid.uuid4().hex}"  # a stream's batches come one at a time, and Spark makes a writer anew for each step

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        system, root = storage(self.path)
        own, out, parts, key, done = f"{root}/{self.job}/{uuid.uuid4().hex}", [], [], None, set()

        def flush():
            if key in done:
                raise ValueError(f"rows of frame {key} do not come together: sort them by sequence and frame")
            done.add(key)
            for name, data in self.files_of(*key, pa.Table.from_batches(parts)):
                system.create_dir(f"{own}/{name}".rsplit("/", 1)[0], recursive=True)
                with system.open_output_stream(f"{own}/{name}") as f:
                    f.write(data)
                out.append((f"{own}/{name}", name))

        for b in batches:
            seq, frame = b.column("seq_id").to_pylist(), b.column("frame_id").to_pylist()
            cuts = [0, *[i for i in range(1, len(seq)) if (seq[i], frame[i]) != (seq[i - 1], frame[i - 1])], len(seq)]
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                if i < j:
                    if parts and (seq[i], frame[i]) != key:
                        flush()
                        parts = []
                    key = (seq[i], frame[i])
                    parts.append(slim(b.slice(i, j - i)))
        if parts:
            flush()
        return Written(out)

    def move(self, messages) -> None:
        system, root = storage(self.path)
        files = [f for m in messages if m is not None for f in m.files]
        names = [n for _, n in files]
        try:
            if len(set(names)) < len(names):
                raise ValueError("two tasks wrote the same frame: deal the rows by sequence and frame")
            if not self.replace and (there := [n for n in names if system.get_file_info(f"{root}/{n}").type != fs.FileType.NotFound]):
                raise FileExistsError(f"{len(there)} frames are there already, such as {there[0]}")
            for folder in sorted({n.rsplit("/", 1)[0] for n in names}):
                system.create_dir(f"{root}/{folder}", recursive=True)
            for at, name in files:
                system.move(at, f"{root}/{name}")
        finally:
            self.clear()

    def clear(self) -> None:
        system, root = storage(self.path)
        if system.get_file_info(f"{root}/{self.job}").type == fs.FileType.Directory:
            system.delete_dir(f"{root}/{self.job}")

    def move_once(self, messages, batch: int) -> None:
        """move, unless this batch of the stream of that name has been moved before."""
        system, root = storage(self.path)
        note = f"{root}/.batches/{self.name}/{batch}"
        if system.get_file_info(note).type != fs.FileType.NotFound:
            return self.clear()
        self.move(messages)
        system.create_dir(note.rsplit("/", 1)[0], recursive=True)
        system.open_output_stream(note).close()


class FrameWriter(DataSourceArrowWriter):
    def __init__(self, files: FrameFiles):
        self.files = files

    def write(self, iterator):
        return self.files.write(iterator)

    def commit(self, messages):
        self.files.move(messages)

    def abort(self, messages):
        self.files.clear()


class FrameStreamWriter(DataSourceStreamArrowWriter):
    def __init__(self, files: FrameFiles):
        self.files = files

    def write(self, iterator):
        return self.files.write(iterator)

    def commit(self, messages, batchId):  # noqa: N803
        self.files.move_once(messages, batchId)

    def abort(self, messages, batchId):  # noqa: N803
        self.files.clear()


def scan_files(seq_id: str, frame_id: int, rows: pa.Table) -> list[tuple[str, bytes | pa.Buffer]]:
    """The point file of a frame's rows, and the label file if they have classes; class_id is a class or a whole label word."""
    ids = rows.column("point_id").to_numpy()
    if (ids[1:] < ids[:-1]).any():
        rows = rows.sort_by("point_id")
    xyzi = np.empty((len(rows), 4), "<f4")
    for i, c in enumerate(("x", "y", "z", "intensity")):
        xyzi[:, i] = rows.column(c).to_numpy()
    out = [(f"sequences/{seq_id}/velodyne/{frame_id:06d}.bin", pa.py_buffer(xyzi))]
    if "class_id" in rows.column_names and not rows.column("class_id").null_count:
        words = rows.column("class_id").to_numpy().astype("<i8") & 0xFFFFFFFF
        if "instance" in rows.column_names:
            words = (words & 0xFFFF) | (rows.column("instance").to_numpy().astype("<i8") << 16)
        out.append((f"sequences/{seq_id}/labels/{frame_id:06d}.label", words.astype("<u4").tobytes()))
    return out


def message_files(seq_id: str, frame_id: int, rows: pa.Table) -> list[tuple[str, bytes]]:
    if len(rows) > 1:
        raise ValueError(f"{len(rows)} messages of one frame")
    return [(f"{seq_id}/{frame_id:06d}.z", rows.column("message")[0].as_py())]


class _Frames(DataSource):
    def _files(self, files_of, overwrite: bool, stream: bool = False) -> FrameFiles:
        return FrameFiles(self.options["path"], files_of, overwrite or self.options.get("replace") == "true", self.options.get("stream", "stream") if stream else None)


class Scans(_Frames):
    """Option stream: the name of a stream, where several write to one root. Mode append adds frames and fails on those that are there; overwrite, or option replace for streams, replaces them and leaves others."""

    @classmethod
    def name(cls):
        return "scans"

    def schema(self):
        return SCAN

    def reader(self, schema):
        return ScanReader(self.options["path"])

    def writer(self, schema, overwrite):
        return FrameWriter(self._files(scan_files, overwrite))

    def streamWriter(self, schema, overwrite):  # noqa: N802
        return FrameStreamWriter(self._files(scan_files, overwrite, stream=True))


class FrameMessages(_Frames):
    @classmethod
    def name(cls):
        return "frame_messages"

    def schema(self):
        return MESSAGE

    def writer(self, schema, overwrite):
        return FrameWriter(self._files(message_files, overwrite))

    def streamWriter(self, schema, overwrite):  # noqa: N802
        return FrameStreamWriter(self._files(message_files, overwrite, stream=True))


class ListingReader(SimpleDataSourceStreamReader):
    """The offset is a number of scans of the playlist. What is due between two offsets passes a queue that keeps the newest `keep`."""

    def __init__(self, options):
        self.scans = list(listed(options["path"], (lambda s, only=options.get("sequences", ""): not only or s in only.split(","))))
        self.keep, self.due, self.fps = int(options.get("keep", 2)), int(options.get("framespertrigger", 0)), float(options.get("fps", 10.0))
        self.clock = time.monotonic()

    def initialOffset(self):  # noqa: N802
        return {"frames": 0}

    def read(self, start):
        due = self.due
        if not due:  # by the clock; the offsets of a batch are noted, so that a replay does not ask it
            due = int((time.monotonic() - self.clock) * self.fps)
            self.clock += due / self.fps
        end = {"frames": min(len(self.scans), start["frames"] + due)}
        return self.readBetweenOffsets(start, end), end

    def readBetweenOffsets(self, start, end):  # noqa: N802
        return iter([(s.seq_id, s.frame_id, s.path, s.labels) for s in self.scans[max(start["frames"], end["frames"] - self.keep) : end["frames"]]])


class ScanListing(DataSource):
    """Options: framesPerTrigger (scans due at each trigger) or fps (by the clock), keep (the newest of them that are played), sequences."""

    @classmethod
    def name(cls):
        return "scan_listing"

    def schema(self):
        return LISTED

    def simpleStreamReader(self, schema):  # noqa: N802
        return ListingReader(self.options)


def register(spark: SparkSession) -> SparkSession:
    """The formats of this module, and filters pushed into them, in this session."""
    for source in (Scans, FrameMessages, ScanListing):
        spark.dataSource.register(source)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark


def load_scans(spark: SparkSession, root: str) -> DataFrame:
    return register(spark).read.format("scans").load(root)


def save_scans(points: DataFrame, root: str, mode: str = "append") -> None:
    """Writes the frames of points (seq_id, frame_id, point_id, x, y, z, intensity and, for labels, class_id and instance), each in one task."""
    register(points.sparkSession)
    dealt = points.repartition("seq_id", "frame_id").sortWithinPartitions("seq_id", "frame_id", "point_id")
    dealt.write.format("scans").mode(mode).save(root)


def read_listed(listing: DataFrame) -> DataFrame:
    """The points of listed scans (LISTED), of a table or a stream."""

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                yield from opened(Scan(**r))

    return listing.select("seq_id", "frame_id", "path", "labels").mapInArrow(run, SCAN)


def newest_scans(spark: SparkSession, root: str, **options) -> DataFrame:
    """A stream of the points of the newest scans that are due at each trigger."""
    source = register(spark).readStream.format("scan_listing")
    for k, v in options.items():
        source = source.option(k, v)
    return read_listed(source.load(root))


def sequence_number(c: str = "seq_id") -> F.Column:
    """Two digits, as sequence folders are named."""
    return F.lpad(F.col(c).cast("string"), 2, "0")


