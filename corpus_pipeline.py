"""Documents to packed training sequences, in five stages.

toxicity      drops documents with a score of 0.3 or more
quality       drops documents with a score below 0.5
near-dedup    keeps one document of each near-duplicate group
mixing        repeats or cuts documents so that sources meet their target weights
packing       places every piece of the tokenised mix in a sequence of 1024 ids
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arclattice.llm import mixing, neardup, packing, quality, toxicity
from arclattice.llm.common import BATCH_BYTES, Stage, release, stages, table


def free_name(docs: DataFrame, name: str = "_score") -> str:
    """A column name that docs does not have."""
    while name in docs.columns:
        name = f"_{name}"
    return name


def small_batches(spark: SparkSession) -> SparkSession:
    """Five stages of Python workers share an executor's memory with it: smaller Arrow batches than an operator alone has."""
    spark.conf.set(BATCH_BYTES, "2m")
    return spark


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows whose toxicity is below 0.3, as they are.

    Null, empty and very long texts are scored like any other, repeated rows alike; rows without doc_id are
    kept or dropped by their score. An empty table gives an empty one.
    """
    small_batches(spark)
    name = free_name(docs)
    scored = toxicity.score(docs, table(spark, sf_dir, "labels"), name=name)
    return scored.filter(F.col(name) < 0.3).select(docs.columns)


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows whose quality is 0.5 or more, as they are; awkward rows as in drop_toxic."""
    small_batches(spark)
    name = free_name(docs)
    scored = quality.score(docs, table(spark, sf_dir, "labels"), name=name)
    return scored.filter(F.col(name) >= 0.5).select(docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, that of the smallest doc_id.

    Rows without words or without doc_id are in no group and stay; of rows that repeat a doc_id one stays. Texts of any
    length are compared whole. Other columns stay, whatever their names; an empty table gives an empty one.
    """
    return neardup.deduplicated(docs, Stage(small_batches(spark)))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them, the last copy cut after its words.

    Rows without words are not taken; a null source is one of its own; rows that repeat a doc_id are taken alike. A text of
    any length is cut after a word. Other columns stay, whatever their names; an empty table gives an empty one.
    """
    return mixing.mixed(docs, Stage(small_batches(spark)))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of each row's ids, with its place; a null text is one piece that holds the end id.

    Rows without doc_id, or that repeat one, are packed one by one, texts of any length cut into pieces. Columns beside doc_id and
    text are not read; an empty table gives an empty one.
    """
    return packing.placements(docs, Stage(small_batches(spark)))


STAGES = [("toxicity", drop_toxic), ("quality", drop_poor), ("near-dedup", drop_copies), ("mixing", mix), ("packing", pack)]

#: The classifiers and the tokenizer have no SQL; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir. What a stage wrote goes as soon as the next one is written."""
    stage = Stage(spark)
    docs, others = table(spark, sf_dir, "documents"), stages()
    for name, step in STAGES[:-1]:
        made = stage.put(step(spark, docs, sf_dir), name)
        release([s for s in stages() if s not in others])
        stage.drop(docs)
        docs = made
    return STAGES[-1][1](spark, docs, sf_dir)
