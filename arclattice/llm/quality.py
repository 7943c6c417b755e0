"""Quality scores by a byte-level convolutional network written in numpy.

Learned filters of WIDTH bytes run over the UTF-8 bytes of the whole text at every second byte.
Each chunk of two BLOCKs (chunks overlap by one) keeps the largest response of every filter;
tanh of these is combined over the chunks of a document by maximum, mean and minimum; the mean
also counts by how much a text falls short of a whole chunk. A logistic layer makes one probability
of them. Long texts are read in pieces that carry only the
pooled blocks, so memory does not follow their length.

Training reads a bounded sample in one task: at most `sample` labelled ids, those of lowest hash, with
one text each and `most_bytes` together; scoring reads every text whole, however long.

Null text counts as empty; an empty text is one chunk of padding. Rows without doc_id are scored,
never learned from; repeated rows are scored alike; of repeated labels the largest holds, null
labels are left out. Without both labels the score is 0.5 everywhere. Ties in hash go by doc_id;
of equal responses the first counts. Other columns stay as they are, but for one named like the
score, which is replaced; an empty table gives an empty one.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textscan
from .common import bounded_batches, table, trim
from .toxicity import held_out, known, labelled_sample

WIDTH, STRIDE, FILTERS, EMBED = 6, 2, 16, 8
#: Filter positions in a block.
BLOCK = 96
#: Bytes convolved at once.
PIECE = 1 << 17


@dataclass(frozen=True)
class Params:
    sample: int = 6000
    most_bytes: int = 64 << 20
    steps: int = 2000
    batch: int = 24
    rate: float = 0.01
    seed: int = 11


def start(rng: np.random.Generator) -> dict[str, np.ndarray]:
    return {
        "embed": rng.normal(0, 0.5, (256, EMBED)),
        "filter": rng.normal(0, 0.3, (WIDTH, EMBED, FILTERS)),
        "shift": np.zeros(FILTERS),
        "out": np.concatenate([rng.normal(0, 0.1, 3 * FILTERS), np.zeros(FILTERS + 1)]),
        "bias": np.zeros(1),
    }


def tables(w: dict[str, np.ndarray]) -> np.ndarray:
    """Response of each filter to each byte at each place in its window."""
    t = np.einsum("be,jek->jbk", w["embed"], w["filter"])
    t[0] += w["shift"]
    return np.ascontiguousarray(t, np.float32)


def responses(data: np.ndarray, t: np.ndarray) -> np.ndarray:
    """data: padded bytes; one row for each filter position."""
    n = (len(data) - WIDTH) // STRIDE + 1
    end = n * STRIDE
    out = t[0].take(data[0:end:STRIDE], axis=0)
    for j in range(1, WIDTH):
        out += t[j].take(data[j : j + end : STRIDE], axis=0)
    return out


def padded(text: np.ndarray) -> np.ndarray:
    """An even number of bytes, at least one position, with zeros for the last windows."""
    n = max(STRIDE, len(text) + len(text) % STRIDE)
    out = np.zeros(n + WIDTH - STRIDE, np.uint8)
    out[: len(text)] = text
    return out


def pooled(text: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Largest responses in each block of the text."""
    data, step, found = padded(text), PIECE // (BLOCK * STRIDE) * BLOCK * STRIDE, []
    for i in range(0, len(data) - WIDTH + STRIDE, step):
        r = responses(data[i : i + step + WIDTH - STRIDE], t)
        found.append(np.maximum.reduceat(r, np.arange(0, len(r), BLOCK), axis=0))
    return np.concatenate(found)


def chunks(blocks: np.ndarray) -> np.ndarray:
    return np.maximum(blocks[:-1], blocks[1:]) if len(blocks) > 1 else blocks


def shortfall(n_bytes: int) -> float:
    return max(0.0, 1 - n_bytes / (2 * BLOCK * STRIDE))


def combined(chunk: np.ndarray, n_bytes: int) -> np.ndarray:
    act, short = np.tanh(chunk), shortfall(n_bytes)
    mean = act.mean(0)
    return np.concatenate([act.max(0), mean, act.min(0), short * mean, [short]])


def gradient(text: np.ndarray, label: float, w: dict, t: np.ndarray, into: np.ndarray, g: dict) -> None:
    """Adds one document's gradient: to `into` for the tables, to g for the last layer."""
    data = padded(text)
    r = responses(data, t)
    nb = -(-len(r) // BLOCK)
    full = np.full((nb * BLOCK, FILTERS), -np.inf, np.float32)
    full[: len(r)] = r
    full = full.reshape(nb, BLOCK, FILTERS)
    at = full.argmax(1)
    top = np.take_along_axis(full, at[:, None], 1)[:, 0]
    where = at + (np.arange(nb) * BLOCK)[:, None]
    if nb > 1:
        later = top[1:] > top[:-1]
        chunk, where = np.where(later, top[1:], top[:-1]), np.where(later, where[1:], where[:-1])
    else:
        chunk = top
    act = np.tanh(chunk)
    hi, lo, k = act.argmax(0), act.argmin(0), np.arange(FILTERS)
    x, short = combined(chunk, len(text)), shortfall(len(text))
    p = 1 / (1 + np.exp(-np.clip(x @ w["out"] + w["bias"][0], -30, 30)))
    d = p - label
    g["out"] += d * x
    g["bias"] += d
    of_max, of_mean, of_min, of_short = w["out"][:-1].reshape(4, FILTERS)
    back = np.repeat((d * (of_mean + short * of_short) / len(act))[None], len(act), 0)
    np.add.at(back, (hi, k), d * of_max)
    np.add.at(back, (lo, k), d * of_min)
    back *= 1 - act * act
    g["shift"] += back.sum(0)
    cols = np.broadcast_to(k, where.shape)
    for j in range(WIDTH):
        np.add.at(into[j], (data[where * STRIDE + j], cols), back)


def train(texts: list[np.ndarray], labels: np.ndarray, p: Params) -> dict[str, np.ndarray]:
    """Adam on the mean log loss."""
    rng = np.random.default_rng(p.seed)
    w = start(rng)
    m, v = ({k: np.zeros_like(x) for k, x in w.items()} for _ in range(2))
    order = np.zeros(0, np.int64)
    for step in range(1, p.steps + 1):
        if len(order) < p.batch:
            order = np.concatenate([order, rng.permutation(len(texts))])
        batch, order = order[: p.batch], order[p.batch :]
        t = tables(w)
        into, g = np.zeros((WIDTH, 256, FILTERS)), {k: np.zeros_like(x) for k, x in w.items()}
        for i in batch:
            gradient(texts[i], labels[i], w, t, into, g)
        g["embed"] = np.einsum("jbk,jek->be", into, w["filter"])
        g["filter"] = np.einsum("jbk,be->jek", into, w["embed"])
        rate = p.rate * (1 - 0.9 * step / p.steps)
        for k in w:
            x = g[k] / p.batch + 1e-5 * w[k]
            m[k] = 0.9 * m[k] + 0.1 * x
            v[k] = 0.999 * v[k] + 0.001 * x * x
            w[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return w


def predict(column: pa.Array, w: dict, t: np.ndarray) -> np.ndarray:
    data, at = textscan.raw(column)
    x = np.stack([combined(chunks(pooled(data[at[i] : at[i + 1]], t)), int(at[i + 1] - at[i])) for i in range(len(column))])
    # summed row by row: a product of matrix and vector rounds by the batch, and equal texts must score alike
    return 1 / (1 + np.exp(-np.clip((x * w["out"]).sum(1) + w["bias"][0], -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, p: Params = Params()) -> dict[str, np.ndarray] | None:
    """labels: (doc_id, label). Learns in one task from the bounded sample; None without both labels."""
    bounded_batches(docs.sparkSession)
    sample = labelled_sample(docs, labels, p.sample, p.most_bytes)

    def learn(batches):
        texts, keys = [], []
        for b in batches:
            data, at = textscan.raw(b.column("text"))
            texts += [data[at[i] : at[i + 1]].copy() for i in range(b.num_rows)]
            keys += list(zip(b.column("doc_id").to_pylist(), b.column("label").to_pylist(), strict=True))
        order = sorted(range(len(texts)), key=lambda i: (keys[i], len(texts[i])))
        y = np.array([keys[i][1] for i in order], float)
        if 0 < y.sum() < len(y):
            yield pa.record_batch([pa.array([pickle.dumps(train([texts[i] for i in order], y, p))])], ["model"])
        texts.clear()
        trim()

    got = sample.mapInArrow(learn, "model binary").collect()
    return pickle.loads(bytes(got[0].model)) if got else None


def score_column(model: dict | None, text: str | Column = "text") -> Column:
    if model is None:
        return F.lit(0.5)
    cache: list[np.ndarray] = []

    @F.arrow_udf("double")
    def score(column: pa.Array) -> pa.Array:
        if not cache:
            cache.append(tables(model))
        return pa.array(predict(column, model, cache[0]) if len(column) else np.zeros(0))

    return score(text)


def score(docs: DataFrame, labels: DataFrame, p: Params = Params(), name: str = "score") -> DataFrame:
    """docs with the column `name`, which replaces one of that name; learned from `labels` (doc_id, quality), held-out rows left out."""
    model = fit(docs, known(labels, "quality").filter(~held_out(3, 1)), p)
    return docs.withColumn(name, score_column(model))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score(docs, table(spark, sf_dir, "labels"))
    return out.select("doc_id", held_out(3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
