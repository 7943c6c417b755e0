"""Shards of equal size that keep linked documents together: balanced label propagation.

Links are given by hubs: rows that name the same hub are linked with each other. Rows start in
hashed shards. In each round every hub counts its rows by shard, every row adds up the counts of
its hubs and asks for the shard with most neighbours, and requests are granted as far as the
capacity of the shard asked for allows: a hub's rows together, the rows of a hub that is large
beside a shard one by one. Capacity counts linked rows only. At last shards above the mean give
rows back, unlinked small ones first, which fill the others. That keeps sizes
within about one document of the mean and cuts a hub only if it is larger than a shard has room.

The driver sees k numbers a round. Sizes are UTF-8 bytes plus 1, null text has 1. Null and empty
texts are linked with nothing. Rows that repeat a doc_id, or have none, are placed one by one, and so
are ties, in the order of their rows. A text longer than a shard's share leaves that shard above the
mean. Other columns are not read, whatever their names; an empty table gives an empty one.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stage, key_join, running_total, table

ROUNDS = 3
#: Linked rows may fill a shard up to its mean less this share; unlinked ones give way.
SLACK = 0.02
#: A hub above this share of a shard moves row by row.
LARGE = 1 / 64


def propagate(rows: DataFrame, k: int, stage: Stage, rounds: int = ROUNDS) -> DataFrame:
    """rows (row, mark, size, hubs, shard) with shard moved towards the neighbours' shards."""
    for turn in range(rounds):
        capacity = (rows.agg(F.sum("size")).first()[0] or 0) / k * (1 - SLACK)
        member = stage.put(rows.select("row", "mark", "size", "shard", F.explode("hubs").alias("hub")), "member")
        counts = [F.count_if(F.col("shard") == s) for s in range(k)]
        hubs = member.groupBy("hub").agg(F.array(*counts).alias("n"), F.count(F.lit(1)).alias("all"), F.sum("size").alias("bytes"))
        hubs = stage.put(hubs.filter(F.col("all") > 1), "hubs")
        seen = key_join(member, hubs, "hub", stage, "row").filter("all > 1")
        votes = seen.groupBy("row", "mark").agg(*[F.sum(F.col("n")[s]).alias(f"v{s}") for s in range(k)], F.min("hub").alias("hub"), F.max("bytes").alias("bytes"))
        name = F.xxhash64("hub", F.lit(turn))
        best = F.greatest(*[F.struct(F.col(f"v{s}").alias("v"), F.pmod(name + s, F.lit(k)).alias("tie"), F.lit(s).alias("to")) for s in range(k)])
        whim = F.when(F.col("bytes") > LARGE * capacity, F.xxhash64("mark", F.lit(turn))).otherwise(name)
        wish = votes.select("row", best["to"].alias("to"), (F.pmod(whim, F.lit(1 << 20)) / (1 << 20)).alias("whim"), (F.col("bytes") > LARGE * capacity).alias("big"))
        rows = stage.put(rows.drop("big").join(wish, "row", "left"), "wishes")
        asked = np.zeros((k, k))
        for r in rows.filter("to is not null").groupBy("shard", "to").agg(F.sum("size").alias("s")).collect():
            asked[r["shard"], r["to"]] = r["s"]
        loads = asked.sum(1)
        np.fill_diagonal(asked, 0)
        room_for = max(capacity, loads.sum() / k * (1 + SLACK))  # where nearly all rows are linked, none give way; levelling evens sizes out
        grant = np.ones(k)
        for _ in range(50):  # what a shard can grant depends on what leaves it
            leaving = asked @ grant
            room = np.maximum(0, room_for - loads + leaving)
            grant = np.minimum(1, room / np.maximum(1, asked.sum(0)))
        allowed = F.element_at(F.array(*[F.lit(float(g)) for g in grant]), F.col("to") + 1)
        moves = F.col("to").isNotNull() & (F.col("whim") < allowed)
        old = rows
        rows = rows.withColumn("shard", F.when(moves, F.col("to")).otherwise(F.col("shard"))).withColumn("linked", F.col("to").isNotNull()).drop("to", "whim")
        rows = stage.put(rows.select("row", "mark", "size", "hubs", "shard", "linked", F.coalesce("big", F.lit(False)).alias("big")), "moved")
        for x in (old, member, hubs):
            stage.drop(x)
        if not asked.any():
            break  # every row is where its neighbours are
    return rows


def levelled(rows: DataFrame, k: int, stage: Stage) -> DataFrame:
    """rows (row, mark, size, hubs, shard, linked, big) with every shard's size near the mean."""
    n, total = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    mean = total / k
    # linked rows, a hub's next to each other, come first, then those of large hubs, then the others, of which the smallest are last
    grade = F.when(F.col("big"), 1).when(F.col("linked"), 0).otherwise(64 - F.floor(F.log2(F.col("size").cast("double")))).cast("long")
    name = F.when(F.col("linked") & ~F.col("big"), F.xxhash64(F.col("hubs")[0])).otherwise(F.xxhash64("mark"))
    rows = stage.put(rows.withColumn("name", name).withColumn("grade", grade).drop("hubs"), "graded")
    order = ["grade", "name", "mark", "row"]
    placed = running_total(rows, ["shard"], order, "size", "before", stage, n)
    placed = stage.put(placed.withColumn("stays", F.col("before") + F.col("size") <= mean), "stays")
    gaps = np.full(k, mean)
    for r in placed.filter("stays").groupBy("shard").agg(F.sum("size").alias("s")).collect():
        gaps[r["shard"]] -= r["s"]
    ends = np.cumsum(np.maximum(gaps, 0))
    moving = stage.put(placed.filter(~F.col("stays")).drop("before").withColumn("one", F.lit(0)), "moving")
    out = running_total(moving, ["one"], order, "size", "before", stage, moving.count())
    middle = F.col("before") + F.col("size") / 2
    to = F.lit(k - 1)
    for s in reversed(range(k - 1)):
        to = F.when(middle < float(ends[s]), s).otherwise(to)
    return placed.filter("stays").select("row", "shard").unionByName(out.select("row", to.alias("shard")))


def sharded(docs: DataFrame, hubs, k: int, stage: Stage, rounds: int = ROUNDS) -> DataFrame:
    """docs (doc_id, text) to (doc_id, size, text_crc32, shard, slot). hubs: an array column of link keys."""
    text = F.coalesce("text", F.lit(""))
    base = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), hubs.alias("hubs"))
    # what is decided by chance goes by the document, so that files that are split otherwise give the same shards; row only tells repeated rows apart
    base = stage.put(base.withColumn("row", F.monotonically_increasing_id()).withColumn("mark", F.xxhash64("doc_id", "text_crc32", "size")), "rows")
    first = F.pmod(F.xxhash64("mark", F.lit("start")), F.lit(k)).cast("int")
    rows = base.select("row", "mark", "size", "hubs", first.alias("shard"), F.lit(False).alias("linked"), F.lit(False).alias("big"))
    rows = stage.put(levelled(propagate(rows, k, stage, rounds), k, stage), "levelled")
    both = stage.put(base.drop("hubs", "mark").join(rows, "row").withColumn("one", F.lit(1)), "sharded")
    return running_total(both, ["shard"], ["doc_id", "row"], "one", "slot", stage, both.count()).select("doc_id", "size", "text_crc32", "shard", "slot")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    same = F.when(F.length("text") > 0, F.array(F.unhex(F.sha2("text", 256)))).otherwise(F.array().cast("array<binary>"))
    out = sharded(docs, same, 8, Stage(spark))
    none = F.lit(None).cast("int").alias("grown_shard")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), none)
