"""Mixing sources to target weights by capped water-filling.

Sources in code-point order, null last, get the weights in turn. Together they share `share` times
all sizes (words); a source's target stops at `max_epochs` times its own size, and the excess goes
to the others by weight until none is above. A source is then taken whole as often as its target
holds it; the rest of the target is taken from its documents in seeded order, the last of them in
part, so that a source's words equal its target rounded to whole words, less what rounding leaves.

Sources may be as many as there are documents and one may hold most of them: their numbering, the
water level and the running sums in seeded order are all computed by Spark, in runs of bounded length.

Null text has size 0. Null is a source of its own. Rows that repeat a doc_id are taken one by one,
the shorter first; of rows that are alike any may be the one taken in part. Texts may be of any
length. Other columns are not read, whatever their names; an empty table gives an empty one.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType

from . import textscan
from .common import Stage, key_join, partitions, running_total, table

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_EPOCHS = 2
SEED = "mix-1:"


@F.arrow_udf(LongType())
def word_count(text: pa.Array) -> pa.Array:
    return pa.array(textscan.word_counts(text))


@F.arrow_udf(StringType())
def head(text: pa.Array, n: pa.Array) -> pa.Array:
    return pa.array([t if t is None or k is None else textscan.head(t, k) for t, k in zip(text.to_pylist(), n.to_pylist(), strict=True)], pa.string())


def source_key(source: str = "source") -> Column:
    """Never null, and in the order of code points with null last."""
    return F.when(F.col(source).isNull(), "1").otherwise(F.concat(F.lit("0"), F.col(source)))


def numbered(sources: DataFrame, stage: Stage) -> DataFrame:
    """sources (key, ...) with their rank from 0 in the order of key."""
    spark = sources.sparkSession
    dealt = sources.repartitionByRange(partitions(spark), "key").sortWithinPartitions("key")
    dealt = stage.put(dealt.withColumn("_at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_at", 33)
    counts = dealt.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect()  # a row a partition
    before, total = {}, 0
    for r in counts:
        before[r["part"]] = total
        total += r["n"]
    if not before:
        return dealt.withColumn("rank", F.col("_at")).drop("_at")
    offsets = spark.createDataFrame(list(before.items()), "_part long, _before long")
    ranked = dealt.withColumn("_part", part.cast("long")).join(F.broadcast(offsets), "_part")  # a row a partition
    return ranked.withColumn("rank", F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_at", "_part", "_before")


def targets(sized: DataFrame, stage: Stage, weights=WEIGHTS, share=SHARE, max_epochs=MAX_EPOCHS) -> DataFrame:
    """(key, source_size, target) of sized (key, size)."""
    sums = sized.groupBy("key").agg(F.sum("size").alias("source_size"))
    ranked = numbered(sums, stage)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("weight", weight).withColumn("cap", F.col("source_size").cast("double") * max_epochs)
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level, capped = 0.0, -1
    while True:  # each round caps at least one source more
        above = F.col("cap") <= F.col("weight") * level if capped >= 0 else F.lit(False)
        r = ranked.agg(
            F.sum(F.when(above, F.col("cap")).otherwise(0.0)).alias("cap"), F.sum(F.when(above, 0.0).otherwise(F.col("weight"))).alias("weight"), F.count_if(above).alias("n")
        ).first()
        if r["n"] == capped or not r["weight"]:
            level = level if r["weight"] else float("inf")
            break
        capped, level = r["n"], (share * total - r["cap"]) / r["weight"]
    target = F.least(F.col("cap"), F.col("weight") * level) if level != float("inf") else F.col("cap")
    return ranked.select("key", "source_size", F.round(target, 6).alias("target"))


def seeded() -> Column:
    """The order in which documents fill the fractional part."""
    return F.md5(F.concat(F.lit(SEED), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))


def taken(docs: DataFrame, stage: Stage, **how) -> DataFrame:
    """docs (doc_id, source, text) to (doc_id, key, size, source_size, target, taken, order, whole, part)."""
    slim = docs.select("doc_id", source_key().alias("key"), word_count("text").alias("size"), seeded().alias("order"))
    slim = stage.put(slim.withColumn("row", F.monotonically_increasing_id()), "sized")
    goals = stage.put(targets(slim, stage, **how), "targets")
    ahead = running_total(slim, ["key"], ["order", "doc_id", "size", "row"], "size", "before", stage, slim.count())
    rows = key_join(stage.put(ahead, "ahead"), goals, "key", stage, "row")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + 1e-9)).otherwise(0)
    rows = rows.withColumn("whole", whole.cast("long"))
    rest = F.round(F.col("target") - F.col("whole") * F.col("source_size")).cast("long")
    part = F.least(F.greatest(rest - F.col("before"), F.lit(0)), F.col("size"))
    return rows.withColumn("part", part).withColumn("taken", F.col("whole") * F.col("size") + F.col("part")).drop("before", "row")


def mixed(docs: DataFrame, stage: Stage, **how) -> DataFrame:
    """The mix itself: every document as often as it is taken, the fractional copy cut after its words.

    In a source's seeded order the documents before one are taken once more, those behind it not, and
    that one in part: so each row compares itself with this bound of its source, and no text moves.
    Rows that repeat a doc_id have the same place in the order and are taken alike.
    """
    rows = taken(docs, stage, **how)
    at = F.struct("order", F.col("part").alias("words"))
    bounds = rows.groupBy("key").agg(F.max("whole").alias("whole"), F.max(F.when(F.col("part") > 0, at)).alias("bound"))
    bounds = stage.put(bounds, "bounds")
    stage.clear(bounds)
    rows = docs.select(F.struct(*docs.columns).alias("doc"), source_key().alias("key"), seeded().alias("order"))  # as one column, their names clash with none
    rows = key_join(rows, bounds, "key", stage, "order")
    more = F.when(F.col("order") < F.col("bound.order"), F.lit(-1).cast("long")).when(F.col("order") == F.col("bound.order"), F.col("bound.words"))
    copies = F.concat(F.array_repeat(F.lit(-1).cast("long"), F.col("whole").cast("int")), F.array_compact(F.array(more)))
    out = rows.select("doc", F.explode(copies).alias("words"))
    text = F.when(F.col("words") < 0, F.col("doc.text")).otherwise(head("doc.text", F.when(F.col("words") >= 0, F.col("words"))))
    out = out.select(*[text.alias(c) if c == "text" else F.col("doc")[c].alias(c) for c in docs.columns])
    return out


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = taken(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), Stage(spark))
    return rows.select("doc_id", "size", "source_size", "target", "taken")


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END AS size,
    md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, 2.0::DOUBLE * CAST(sum(size) AS DOUBLE) AS cap,
    CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w
  FROM d GROUP BY source),
o AS (
  SELECT *, cap / w AS level, sum(cap) OVER p AS caps, sum(w) OVER () - sum(w) OVER p AS open_w,
    lead(cap / w) OVER (ORDER BY cap / w, source NULLS LAST) AS next_level, row_number() OVER (ORDER BY cap / w, source NULLS LAST) AS k
  FROM s WINDOW p AS (ORDER BY cap / w, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
t AS (SELECT 1.5::DOUBLE * CAST(sum(source_size) AS DOUBLE) AS total FROM s),
c AS (
  SELECT 0 AS k, (SELECT total FROM t) / (SELECT sum(w) FROM s) AS water, (SELECT min(level) FROM o) AS next_level
  UNION ALL SELECT k, ((SELECT total FROM t) - caps) / open_w, next_level FROM o WHERE open_w > 0.5),
l AS (SELECT arg_min(water, k) AS water FROM c WHERE next_level IS NULL OR water < next_level),
g AS (SELECT source, source_size, round(least(cap, w * (SELECT water FROM l)), 6) AS target FROM s),
r AS (
  SELECT d.doc_id, d.size, g.source_size, g.target,
    CASE WHEN g.source_size > 0 THEN CAST(floor(g.target / g.source_size + 1e-9) AS BIGINT) ELSE 0 END AS whole,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
  CAST(whole * size + least(greatest(CAST(round(target - whole * source_size) AS BIGINT) - ahead, 0), size) AS BIGINT) AS taken
FROM r
"""
