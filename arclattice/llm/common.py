"""Shared pieces: staged tables, skew-safe joins, running totals, components."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import shutil
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A key is hot if it has more than 1/HOT_SHARE of all rows, so at most HOT_SHARE keys are.
HOT_SHARE = 500
#: Rows that one task orders, about, and the ranges that they make at most (larger ones beyond, which sorts spill).
RUN, RANGES = 50_000, 20_000

_own: list[str] = []
_stages: list[Stage] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where it is unset, a temporary one (local masters only)."""
    there = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if there:
        return there
    if spark.sparkContext.master.partition("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="arclattice-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return _own[0]


#: The session's setting for the bytes of an Arrow batch, and what holds without it.
BATCH_BYTES, BATCH = "spark.arclattice.batchBytes", "8m"


def bounded_batches(spark: SparkSession) -> SparkSession:
    """Sets the session's Arrow batches to a few MB, so that Python workers and their buffers stay small beside long texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", spark.conf.get(BATCH_BYTES, BATCH))
    return spark


def trim() -> None:
    """Gives memory that a worker no longer uses back to the system: workers outlive their tasks, and a long job has several kinds of them."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


class Stage:
    """Tables written to the shared folder: they cut lineage and outlive executors.

    Results are read lazily, so an operator leaves the tables behind that its result reads. They go
    at the end of the session, or earlier by release().
    """

    def __init__(self, spark: SparkSession):
        self.spark = bounded_batches(spark)
        self.dir = f"{shared_dir(spark)}/stage-{uuid.uuid4().hex}"
        self.n = 0
        self.there: list[str] = []
        _stages.append(self)
        remove_at_exit(spark, self.dir)

    def path(self, name: str) -> str:
        self.n += 1
        return f"{self.dir}/{self.n}-{name}"

    def put(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._stage_path = path
        self.there.append(path)
        return out

    def clear(self, *kept: DataFrame) -> None:
        """Removes all tables but those kept: no plan may read the others any more."""
        keep = {df._stage_path for df in kept}
        for path in self.there:
            if path not in keep:
                remove(self.spark, path)
        self.there = [p for p in self.there if p in keep]

    def drop(self, df: DataFrame) -> None:
        """Removes a staged table that no later plan reads."""
        if path := getattr(df, "_stage_path", None):
            remove(self.spark, path)


def stages() -> list[Stage]:
    """The stages that still have tables, oldest first."""
    return list(_stages)


def release(old: list[Stage]) -> None:
    """Removes these stages' folders: results that read them must have been written or used."""
    for s in old:
        remove(s.spark, s.dir)
        s.there = []
        if s in _stages:
            _stages.remove(s)


def remove_at_exit(spark: SparkSession, path: str) -> None:
    """Makes the folder and has it removed when the driver ends, however it does so in order."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(p)
    fs.deleteOnExit(p)


def remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def key_join(left: DataFrame, right: DataFrame, key: str, stage: Stage, spread: str) -> DataFrame:
    """Left join of many rows to a table with one row per key, whatever the skew of the key.

    Keys with over 1/HOT_SHARE of the left rows, at most HOT_SHARE of them, are joined by
    broadcast. The other rows are shuffled; a hot row gets a key of its own there, made from
    `spread`, so that no task gets them all. Null keys match nothing. `left` should be cheap to
    read twice (a scan); `right` likewise.
    """
    total = left.select(F.count(F.lit(1)).alias("total"))
    hot = (
        left.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
        .crossJoin(F.broadcast(total)).filter(F.col("_n") * HOT_SHARE > F.col("total")).select(key)
    )
    hot = stage.put(hot, "hot").coalesce(1)
    values = [c for c in right.columns if c != key]
    near = right.join(F.broadcast(hot), key, "left_semi")
    near = near.select(F.col(key).alias("_hot"), F.struct(*values).alias("_near"))
    far = right.select(F.col(key).alias("_key"), F.struct(*values).alias("_far"))
    out = left.join(F.broadcast(near), F.col(key) == F.col("_hot"), "left")
    own = F.xxhash64(F.lit("own"), F.col(spread))
    cold = F.when(F.col("_hot").isNull() & F.col(key).isNotNull(), F.col(key))
    # a hot or null row gets a salt of its own and meets no row
    out = out.withColumn("_cold", cold).withColumn("_salt", F.when(cold.isNull(), own).otherwise(F.lit(0)))
    far = far.withColumn("_zero", F.lit(0).cast("long"))
    out = out.join(far, (F.col("_cold").eqNullSafe(F.col("_key"))) & (F.col("_salt") == F.col("_zero")), "left")
    return out.select(*left.columns, *[F.coalesce(F.col(f"_near.{v}"), F.col(f"_far.{v}")).alias(v) for v in values])


def running_total(df: DataFrame, group: list[str], order: list, value: str, out: str, stage: Stage, rows: int) -> DataFrame:
    """Exclusive running sum of `value` within `group`, rows ordered by `order`.

    All rows are sorted by group and order and cut into ranges of about RUN rows, whatever the group, so
    that no task orders a whole group: sums of ranges are added up first, rows within their range
    only. A unique last column of `order` lets ranges cut rows that are equal in the others. `rows`:
    how many there are, about. df is read twice: it should be a staged table.
    """
    ranges = max(partitions(stage.spark), min(RANGES, rows // RUN))
    keys = [*group, *order]
    # a constant or two would send all rows to one range only if their order were equal too
    dealt = df.repartitionByRange(ranges, *keys).withColumn("_range", F.spark_partition_id())
    inside = Window.partitionBy(*group, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    dealt = stage.put(dealt, "dealt")
    sums = dealt.groupBy(*group, "_range").agg(F.sum(value).alias("_sum"))
    w = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(w), F.lit(0))).drop("_sum")
    before = stage.put(before, "before")
    local = dealt.withColumn("_in", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    cond = F.lit(True)
    for c in [*group, "_range"]:
        cond = cond & F.col(f"r.{c}").eqNullSafe(F.col(f"b.{c}"))
    joined = local.alias("r").join(before.alias("b"), cond)
    return joined.select("r.*", "b._before").withColumn(out, F.col("_in") + F.col("_before")).drop("_in", "_before", "_range")


def components(edges: DataFrame, stage: Stage) -> DataFrame:
    """Connected components: pairs (a, b) of longs or of binary digests to (id, component), component the smallest id.

    Longs get the name xxhash64(id), one-to-one and in random order, which keeps chains short;
    digests are random and name themselves. Each round every vertex hooks to its smallest neighbour, parents are jumped
    once, and the edges are contracted to the parents' names until none is left. All joins are
    between staged tables, whose hot keys adaptive execution can split.
    """
    digests = edges.schema["a"].dataType.simpleString() == "binary"
    kind, named = ("binary", F.col) if digests else ("long", F.xxhash64)
    raw = edges.select(F.col("a").cast(kind), F.col("b").cast(kind)).filter("a is not null and b is not null")
    raw = stage.put(raw.distinct(), "edges")
    both = raw.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    name = stage.put(both.select("id", named("id").alias("root")), "names")
    edge = stage.put(raw.filter("a <> b").select(named("a").alias("a"), named("b").alias("b")), "named")
    stage.drop(raw)
    while not edge.isEmpty():
        sides = edge.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e"))
        parent = sides.groupBy(F.col("e.a").alias("v")).agg(F.least(F.min("e.b"), F.first("e.a")).alias("p"))
        parent = stage.put(parent, "parents")
        up = parent.select(F.col("v").alias("p"), F.col("p").alias("pp"))
        jumped = stage.put(parent.join(up, "p").select("v", F.col("pp").alias("p")), "jumped")
        at_a = jumped.select(F.col("v").alias("a"), F.col("p").alias("pa"))
        at_b = jumped.select(F.col("v").alias("b"), F.col("p").alias("pb"))
        half = stage.put(edge.join(at_a, "a").select(F.col("pa").alias("a"), "b").distinct(), "half")
        new = half.join(at_b, "b").filter("a <> pb").select(F.least("a", "pb").alias("a"), F.greatest("a", "pb").alias("b")).distinct()
        new = stage.put(new, "contracted")
        at_r = jumped.select(F.col("v").alias("root"), F.col("p"))
        moved = stage.put(name.join(at_r, "root", "left").select("id", F.coalesce("p", "root").alias("root")), "moved")
        for x in (edge, name, parent, jumped, half):
            stage.drop(x)
        edge, name = new, moved
    least = stage.put(name.groupBy("root").agg(F.min("id").alias("component")), "least")
    return stage.put(name.join(least, "root").select("id", "component"), "components")

#: Bits of an id filter: 512 bitmaps of 4 KB, so 2 MB whatever the number of ids.
FILTER_BITS = 1 << 24


def maybe_in(rows: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """rows with the boolean _maybe: false for most and only for those whose column is not in ids (id).

    The ids become a bitmap of FILTER_BITS bits, so what is broadcast has a fixed bound. It spares
    the other rows a shuffle; those that pass still need an exact join.
    """
    spot = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER_BITS)) + 1
    bits = ids.select(spot("id").alias("_p")).groupBy(F.call_function("bitmap_bucket_number", "_p").alias("_bucket"))
    bits = bits.agg(F.call_function("bitmap_construct_agg", F.call_function("bitmap_bit_position", "_p")).alias("_bits"))
    out = rows.withColumn("_p", spot(column))
    out = out.join(F.broadcast(bits), F.call_function("bitmap_bucket_number", F.col("_p")) == F.col("_bucket"), "left")
    at = F.call_function("bitmap_bit_position", F.col("_p"))
    byte = F.conv(F.hex(F.expr("substring(_bits, int(bitmap_bit_position(_p) div 8) + 1, 1)")), 16, 10).cast("int")
    bit = F.call_function("getbit", byte, (at % 8).cast("int")) == 1
    return out.withColumn("_maybe", F.coalesce(bit, F.lit(False)) & F.col(column).isNotNull()).drop("_p", "_bucket", "_bits")
