"""Document fingerprints by content-defined chunking.

A gear hash over the last 32 bytes marks boundaries; chunk sizes are normalised: between LEAST and
NORMAL bytes a strict mask must match, from there to MOST a loose one, and at MOST a chunk ends. An
insertion moves only the boundaries near it. A fingerprint is the set of chunk digests (48 bits)
with chunk lengths, ascending, in base64. The likeness of two is the length of the common chunks
over that of the smaller set: how far one text contains the other. Two empty sets are alike (1),
an empty and another one are not (0).

`edits` pairs every text with the next one in ascending doc_id. Rows are dealt into ranges of
doc_id; the first row of each range is also sent to the range before, so that each range finds all
of its successors, and the first range's to the last. Null text counts as empty; texts may be of any
length. Rows without doc_id come first; rows with equal doc_id follow each other in the order of their
texts' hashes, and where there are many of them they take several ranges. Only rows that are equal in
both stay in one range, which reads them one after the other. Other columns are not read, whatever
their names; an empty table gives an empty one.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from . import textscan
from .common import bounded_batches, partitions, table

LEAST, NORMAL, MOST = 12, 32, 128
#: One position in 64, then one in 8, ends a chunk.
STRICT, LOOSE = np.uint32(0x3F << 26), np.uint32(0x07 << 29)
WINDOW = 32
BLOCK = 2 << 20
_GEAR = np.random.default_rng(32).integers(0, 1 << 32, 256, dtype=np.uint32)
_POWER = np.cumprod(np.full(MOST, 0x9E3779B97F4A7C15, np.uint64))
_NONE = -(1 << 63)


def gear(data: np.ndarray, zero: np.ndarray) -> np.ndarray:
    """Sum over the last WINDOW bytes of their values, each shifted by its age; by doubling the span."""
    h = _GEAR[data]
    h[zero] = 0
    span = 1
    while span < WINDOW:
        h[span:] += h[:-span] << np.uint32(span)  # the right side is computed before it is added
        span *= 2
    return h


def chunks(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct chunks of all texts, (digest << 16 | length), and where each text's start, with the end last."""
    sizes = np.array([len(t) for t in texts], np.int64)
    gap = bytes(WINDOW)
    data = np.frombuffer(gap.join([b"", *texts, b""]), np.uint8)
    begin = np.cumsum(sizes + WINDOW) - sizes  # each text follows a gap
    pad = np.ones(len(data), bool)
    inside = np.repeat(begin - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
    pad[inside] = False
    h = gear(data, pad)
    strict, loose = np.flatnonzero((h & STRICT) == 0), np.flatnonzero((h & LOOSE) == 0)
    strict, loose = np.append(strict, len(data) + MOST), np.append(loose, len(data) + MOST)
    text = np.flatnonzero(sizes > 0)
    at, end = begin[text], begin[text] + sizes[text]
    owner, start, stop = [], [], []
    while len(at):
        a = strict[np.searchsorted(strict, at + LEAST - 1)]
        b = loose[np.searchsorted(loose, at + NORMAL - 1)]
        cut = np.where(a < at + NORMAL - 1, a, np.minimum(b, at + MOST - 1)) + 1
        cut = np.minimum(cut, end)
        owner.append(text)
        start.append(at)
        stop.append(cut)
        open_ = cut < end
        text, at, end = text[open_], cut[open_], end[open_]
    if not owner:
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    owner, start, stop = np.concatenate(owner), np.concatenate(start), np.concatenate(stop)
    order = np.argsort(start)
    owner, start, stop = owner[order], start[order], stop[order]
    length = stop - start
    place = inside - np.repeat(start, length)  # of each byte in its chunk
    value = (data[inside].astype(np.uint64) + np.uint64(1)) * _POWER[place]
    digest = textscan.mix(np.add.reduceat(value, np.cumsum(length) - length) + length.astype(np.uint64))
    digest = (digest & ~np.uint64(0xFFFF)) | length.astype(np.uint64)
    parts, bounds = [], np.searchsorted(owner, np.arange(len(texts) + 1))
    for p, q in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        x = np.sort(digest[p:q])
        new = np.ones(len(x), bool)
        new[1:] = x[1:] != x[:-1]
        parts.append(x[new])
    return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])


def written(chunk: np.ndarray) -> str:
    return base64.b64encode(chunk.astype(">u8").tobytes()).decode()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    at = np.searchsorted(b, a)
    common = a[b[np.minimum(at, len(b) - 1)] == a]
    weight = lambda x: int((x & np.uint64(0xFFFF)).sum())
    return weight(common) / min(weight(a), weight(b))


def edited(text: str, following: str) -> str:
    n = len(text) // 2
    return text[: len(text) - n] + following[:n]


def compared(rows: list[tuple[int | None, str, str]], kind: pa.DataType) -> pa.RecordBatch:
    """Rows of (doc_id, text, next text)."""
    new = [edited(t, n) for _, t, n in rows]
    raw = [x.encode("utf-8", "surrogatepass") for x in [*(t for _, t, _ in rows), *new, *(n for _, _, n in rows)]]
    where: dict[bytes, int] = {}
    index = [where.setdefault(x, len(where)) for x in raw]
    chunk, at = chunks(list(where))
    own = [chunk[at[i] : at[i + 1]] for i in range(len(where))]
    k = len(rows)
    a, b, c = index[:k], index[k : 2 * k], index[2 * k :]
    columns = [
        pa.array([r[0] for r in rows], kind),
        pa.array([len(r[1]) for r in rows], pa.int64()),
        pa.array([hashlib.sha256(x).hexdigest() for x in raw[k : 2 * k]], pa.string()),
        pa.array([written(own[i]) for i in a], pa.string()),
        pa.array([written(own[i]) for i in b], pa.string()),
        pa.array([likeness(own[i], own[j]) for i, j in zip(a, b, strict=True)], pa.float64()),
        pa.array([likeness(own[i], own[j]) for i, j in zip(a, c, strict=True)], pa.float64()),
    ]
    return pa.record_batch(columns, ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """docs with the column fingerprint of their text."""

    @F.arrow_udf("string")
    def fingerprint(text: pa.Array) -> pa.Array:
        data, at = textscan.raw(text)
        out, i = [], 0
        while i < len(text):
            j = max(i + 1, int(np.searchsorted(at, at[i] + BLOCK, "right")) - 1)
            chunk, own = chunks([data[at[k] : at[k + 1]].tobytes() for k in range(i, j)])
            out += [written(chunk[own[k] : own[k + 1]]) for k in range(j - i)]
            i = j
        return pa.array(out, pa.string())

    return docs.withColumn("fingerprint", fingerprint("text"))


def edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited text, and how alike they and the next one's are."""
    spark = bounded_batches(docs.sparkSession)
    n = partitions(spark)
    rank = F.coalesce(F.col("doc_id").cast("long"), F.lit(_NONE))
    probes = [i / n for i in range(1, n)]
    cuts = docs.select(F.percentile_approx(rank, probes, 20 * n)).first()[0] if probes else []
    # an id that takes several ranges is cut by the hashes of its texts
    value, times = np.unique(np.array(cuts or [], np.int64), return_counts=True)
    cut_rank = np.repeat(value, times)
    cut_hash = np.array([_NONE + (i << 64) // t for t in times.tolist() for i in range(t)], np.int64)

    @F.arrow_udf(IntegerType())
    def range_of(x: pa.Array, h: pa.Array) -> pa.Array:
        x, h = x.to_numpy(zero_copy_only=False), h.to_numpy(zero_copy_only=False)
        out = np.searchsorted(cut_rank, x, "right")
        for v in value[times > 1]:
            at = np.flatnonzero(x == v)
            first = np.searchsorted(cut_rank, v)
            out[at] = first + np.searchsorted(cut_hash[cut_rank == v], h[at], "right")
        return pa.array(out.astype(np.int32))

    text = F.coalesce("text", F.lit(""))
    ranked = docs.select("doc_id", text.alias("text"), rank.alias("rank"), F.xxhash64(text).alias("hash"))
    # a row for each range, at most n
    least = ranked.select("rank", "hash").groupBy(range_of("rank", "hash").alias("range")).agg(F.min(F.struct("rank", "hash")).alias("least"))
    first = {r["range"]: r["name"] for r in least.select("range", F.xxhash64("least.rank", "least.hash").alias("name")).collect()}
    full = sorted(first)
    before = {b: full[i - 1] for i, b in enumerate(full)}
    to = {first[b]: before[b] for b in full if before[b] is not None}

    @F.arrow_udf(IntegerType())
    def guest_of(name: pa.Array) -> pa.Array:
        return pa.array([to.get(x) for x in name.to_pylist()], pa.int32())

    guest = guest_of(F.xxhash64("rank", "hash"))
    copies = F.array_compact(F.array(F.struct(range_of("rank", "hash").alias("range"), F.lit(False).alias("guest")), F.when(guest.isNotNull(), F.struct(guest.alias("range"), F.lit(True).alias("guest")))))
    dealt = ranked.withColumn("_to", F.explode(copies)).select("doc_id", "text", "rank", "hash", "_to.*")
    dealt = dealt.repartitionById(n, F.col("range")).sortWithinPartitions("range", "guest", "rank", "hash", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        held, size, rows, of = None, 0, [], None
        for b in batches:
            of = b.schema.field("doc_id").type
            for i, text, group, guest in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "range", "guest")), strict=True):
                if held is not None and held[2] == group:
                    rows.append((held[0], held[1], text))
                    size += len(held[1])
                    held = None
                if not guest:
                    held = (i, text, group)
                if size > BLOCK // 2:
                    yield compared(rows, of)
                    rows, size = [], 0
        if rows:
            yield compared(rows, of)

    shape = f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return dealt.select("doc_id", "text", "range", "guest").mapInArrow(run, shape)


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edits(table(spark, sf_dir, "documents").select("doc_id", "text"))
