"""Toxicity scores by FTRL-proximal logistic regression over hashed word features.

Words are runs of ASCII letters, digits and non-ASCII bytes, A-Z lower-cased. A text's features
are its distinct words, word stems (the first bytes), word pairs and skip-grams (pairs with one
word between), hashed into 2**BITS coordinates. FTRL-proximal keeps a rate of its own for each
coordinate, and its L1 term leaves few weights: they go to the executors as two short arrays.

Training reads a bounded sample in one task: at most `sample` labelled ids, those of lowest hash, with
one text each and `most_bytes` together; scoring reads every text whole, however long.

Null text counts as empty. An empty text has no features: its score is the bias alone. Rows
without doc_id are scored, never learned from; repeated rows are scored alike; of repeated labels
the largest holds, null labels are left out. Without both labels the score is 0.5 everywhere. Ties
in hash go by doc_id. Other columns stay as they are, but for one named like the score, which is
replaced; an empty table gives an empty one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textscan
from .common import bounded_batches, table, trim

BITS = 20
#: Word pairs and skip-grams count less than words, as most of them are rare.
PAIR_VALUE = 0.3
BLOCK = 2 << 20


@dataclass(frozen=True)
class Model:
    index: np.ndarray
    weight: np.ndarray
    bias: float


@dataclass(frozen=True)
class Params:
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 4.0
    l2: float = 0.1
    epochs: int = 4
    sample: int = 8192
    most_bytes: int = 64 << 20
    seed: int = 7


def blocks(column: pa.Array):
    """Runs of rows of about BLOCK bytes."""
    _, at = textscan.raw(column)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(at, at[i] + BLOCK, "right")) - 1)
        yield column.slice(i, j - i)
        i = j


def coordinates(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each family of features: row numbers and coordinates, with repeats."""
    word, at = textscan.words(column, textscan.ALNUM)
    stem, _ = textscan.words(column, textscan.ALNUM, 5)
    row = np.repeat(np.arange(len(column)), np.diff(at))
    top = lambda h: (h >> np.uint64(64 - BITS)).astype(np.int32)
    out = [(row, top(word)), (row, top(textscan.mix(stem, 77)))]
    for gap, factor in ((1, 3), (2, 5)):
        same = row[:-gap] == row[gap:]
        pair = textscan.mix(word[:-gap] * np.uint64(factor) + word[gap:])
        out.append((row[:-gap][same], top(pair)[same]))
    return out


def values(family: int) -> float:
    return 1.0 if family < 2 else PAIR_VALUE


def features(column: pa.Array) -> list[tuple[np.ndarray, int]]:
    """Distinct coordinates of each row, and how many of them, which come first, are words or stems."""
    parts: list[list] = [[] for _ in range(len(column))]
    for k, (row, x) in enumerate(coordinates(column)):
        key = np.unique((row.astype(np.int64) << BITS) | x)
        cut = np.searchsorted(key, np.arange(len(column) + 1, dtype=np.int64) << BITS)
        own = (key & ((1 << BITS) - 1)).astype(np.int32)
        for i in range(len(column)):
            parts[i].append(own[cut[i] : cut[i + 1]])
    return [(np.concatenate(p), len(p[0]) + len(p[1])) for p in parts]


def train(rows: list[tuple[np.ndarray, int]], labels: np.ndarray, p: Params) -> Model:
    """FTRL-proximal over the rows in seeded order, once an epoch."""
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    z_bias = n_bias = 0.0
    rng = np.random.default_rng(p.seed)

    def weight(z, n):
        return np.where(np.abs(z) <= p.l1, 0.0, (np.sign(z) * p.l1 - z) / ((p.beta + np.sqrt(n)) / p.alpha + p.l2))

    def bias():
        return -z_bias / ((p.beta + np.sqrt(n_bias)) / p.alpha)

    for _ in range(p.epochs):
        for i in rng.permutation(len(rows)):
            x, full = rows[i]
            v = np.full(len(x), PAIR_VALUE)
            v[:full] = 1.0
            z_x, n_x, b = z[x], n[x], bias()
            w = weight(z_x, n_x)
            g = 1 / (1 + np.exp(-np.clip((w * v).sum() + b, -30, 30))) - labels[i]
            g_x = g * v
            z[x] = z_x + g_x - (np.sqrt(n_x + g_x * g_x) - np.sqrt(n_x)) / p.alpha * w
            n[x] = n_x + g_x * g_x
            z_bias += g - (np.sqrt(n_bias + g * g) - np.sqrt(n_bias)) / p.alpha * b
            n_bias += g * g
    w = weight(z, n)
    index = np.flatnonzero(w)
    return Model(index.astype(np.int32), w[index].astype(np.float32), float(bias()))


def predict(column: pa.Array, model: Model, dense: np.ndarray) -> np.ndarray:
    total = np.full(len(column), model.bias)
    for k, (row, x) in enumerate(coordinates(column)):
        hit = np.flatnonzero(dense[x])
        key = np.unique((row[hit].astype(np.int64) << BITS) | x[hit])
        np.add.at(total, key >> BITS, dense[key & ((1 << BITS) - 1)].astype(np.float64) * values(k))
    return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def known(labels: DataFrame, name: str) -> DataFrame:
    """(doc_id, label): one row for each labelled doc_id."""
    rows = labels.select("doc_id", F.col(name).cast("int").alias("label")).dropna()
    return rows.groupBy("doc_id").agg(F.max("label").alias("label"))


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int, most_bytes: int) -> DataFrame:
    """(doc_id, label, text) of at most `rows` labelled ids and `most_bytes` of text, in one partition.

    Ids come in the order of their hash, each with one text (of several the one of least hash), and
    are taken up to the first that does not fit into what is left of the bytes; a text of more bytes than all is passed over.
    """
    ids = labels.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)  # at most `rows`: may be broadcast
    text = F.coalesce(F.col("text"), F.lit(""))
    there = docs.select("doc_id", text.alias("text")).join(F.broadcast(ids), "doc_id")
    one = F.struct(F.xxhash64("text").alias("hash"), F.octet_length("text").alias("bytes"))
    found = there.groupBy("doc_id").agg(F.min(one).alias("one"), F.xxhash64("doc_id").alias("place")).select("doc_id", "one.*", "place").collect()  # at most `rows`
    left, chosen = most_bytes, []
    for r in sorted(found, key=lambda r: (r["place"], r["doc_id"])):
        if r["bytes"] > most_bytes:
            continue  # it never fits
        if r["bytes"] > left:
            break  # going on would choose short texts
        left -= r["bytes"]
        chosen.append((r["doc_id"], r["hash"]))
    kind = docs.schema["doc_id"].dataType.simpleString()
    chosen = docs.sparkSession.createDataFrame(chosen, f"doc_id {kind}, _hash long")
    whole = there.withColumn("_hash", F.xxhash64("text")).join(F.broadcast(chosen), ["doc_id", "_hash"])
    return whole.groupBy("doc_id").agg(F.first("label").alias("label"), F.first("text").alias("text")).repartition(1)


def fit(docs: DataFrame, labels: DataFrame, p: Params = Params()) -> Model:
    """labels: (doc_id, label). Learns in one task from the bounded sample."""
    bounded_batches(docs.sparkSession)
    sample = labelled_sample(docs, labels, p.sample, p.most_bytes)

    def learn(batches):
        ids, ys, rows = [], [], []
        for b in batches:
            ids.append(b.column("doc_id").to_numpy(zero_copy_only=False))
            ys.append(b.column("label").to_numpy(zero_copy_only=False))
            for part in blocks(b.column("text")):
                rows += features(part)
        y = np.concatenate(ys) if ys else np.zeros(0)
        if len(set(y.tolist())) < 2:
            model = Model(np.zeros(0, np.int32), np.zeros(0, np.float32), 0.0)
        else:
            order = np.lexsort((np.array([len(x) for x, _ in rows]), np.concatenate(ids)))
            model = train([rows[i] for i in order], y[order], p)
        yield pa.record_batch([pa.array([model.index.tobytes()]), pa.array([model.weight.tobytes()]), pa.array([model.bias])], ["i", "w", "b"])
        rows.clear()
        trim()

    got = sample.mapInArrow(learn, "i binary, w binary, b double").collect()
    if not got:
        return Model(np.zeros(0, np.int32), np.zeros(0, np.float32), 0.0)
    return Model(np.frombuffer(bytes(got[0].i), np.int32), np.frombuffer(bytes(got[0].w), np.float32), got[0].b)


def score_column(model: Model, text: str | Column = "text") -> Column:
    cache: list[np.ndarray] = []

    @F.arrow_udf("double")
    def score(column: pa.Array) -> pa.Array:
        if not cache:
            dense = np.zeros(1 << BITS, np.float32)
            dense[model.index] = model.weight
            cache.append(dense)
        found = [predict(part, model, cache[0]) for part in blocks(column)]
        return pa.array(np.concatenate(found) if found else np.zeros(0))

    return score(text)


def held_out(modulus: int, remainder: int) -> Column:
    """Whether a row's labels may not be learned: crc32 of doc_id as text leaves this remainder."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def score(docs: DataFrame, labels: DataFrame, p: Params = Params(), name: str = "score") -> DataFrame:
    """docs with the column `name`, which replaces one of that name; learned from `labels` (doc_id, toxic), held-out rows left out."""
    model = fit(docs, known(labels, "toxic").filter(~held_out(4, 2)), p)
    return docs.withColumn(name, score_column(model))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score(docs, table(spark, sf_dir, "labels"))
    return out.select("doc_id", held_out(4, 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
