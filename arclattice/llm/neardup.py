"""Near-duplicate documents by fast similarity sketching, banding and exact verification.

A document's set is its distinct 5-word shingles (the whole sequence if it has fewer words), as
64-bit hashes. Fast similarity sketching fills COORDS coordinates in rounds: in round i every
element drops its value into a hashed bin, in the last COORDS rounds into the bin of that number,
and a bin keeps the least value of the earliest round; so every coordinate fills, and collisions
concentrate as if elements were drawn without replacement. Bands of ROWS coordinates name buckets.

Equal sets are one class, whose smallest doc_id stands for it. A bucket is never expanded into all
pairs: first its members meet the bucket's smallest id only; then, with the components known, pairs
of one bucket that lie in different components are tested, every one, so that no link is lost that
a bucket shows. In buckets of over SMALL members, tasks compare blocks of at most about BLOCK members
outside the largest component with blocks of all members, and emit only links. All tested pairs first need enough equal coordinates (six
standard deviations below the threshold), then the exact inequality on full sets.

Null or wordless texts have no shingles and link with nothing; texts may be of any length. Rows that
repeat a doc_id count as one document; if their texts differ, which of them it stands for is that of
least digest. Rows without doc_id link with nothing: their component_id is null, and they are kept. Of
a group the smallest doc_id is kept. Other columns are not read, whatever their names, and stay in
`deduplicated`; an empty table gives an empty one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from . import textscan
from .common import Stage, components, key_join, maybe_in, table, trim
from .toxicity import blocks

N = 5
COORDS, ROWS = 96, 4
THRESHOLD = 75  # of 100
#: Equal coordinates that a pair needs: COORDS * 0.75, less six standard deviations.
LEAST_EQUAL = 47
#: A bucket of so many members has at most 3.5 pairs for each.
SMALL = 8
#: Strays of a larger bucket, and members, that are compared at once.
BLOCK = 512
_EMPTY = np.uint64(2**64 - 1)
_FACTOR = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def shingle_sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row, ascending, and where each row's start, with the end last."""
    word, at = textscan.words(column)
    n = len(word)
    all_n = np.zeros(max(0, n - N + 1), np.uint64)
    for j in range(N):
        all_n += word[j : j + len(all_n)] * _FACTOR[j]
    all_n = textscan.mix(all_n)
    sets = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= N:
            x = np.sort(all_n[a : b - N + 1])
            new = np.ones(len(x), bool)
            new[1:] = x[1:] != x[:-1]
            x = x[new]
        elif b > a:
            x = textscan.mix((word[a:b] * _FACTOR[: b - a]).sum(keepdims=True, dtype=np.uint64) + np.uint64(b - a))
        else:
            x = all_n[:0]
        sets.append(x)
    sizes = np.array([len(x) for x in sets], np.int64)
    return (np.concatenate(sets) if sets else all_n[:0]), np.concatenate([[0], np.cumsum(sizes)])


def sketches(element: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A row of COORDS values for each set; empty sets keep _EMPTY."""
    n = len(at) - 1
    out = np.full(n * COORDS, _EMPTY)
    row = np.repeat(np.arange(n), np.diff(at))
    low = np.uint64((1 << 40) - 1)
    for i in range(2 * COORDS):
        if not len(element):
            break
        x = textscan.mix(element, 0x51ED2700 + i)
        value = (x & low) | np.uint64(i << 40)
        place = (((x >> np.uint64(40)) * np.uint64(COORDS)) >> np.uint64(24)).astype(np.int64) if i < COORDS else np.full(len(x), i - COORDS)
        np.minimum.at(out, row * COORDS + place, value)
        open_ = (out.reshape(n, COORDS) == _EMPTY).any(1)
        keep = open_[row]
        element, row = element[keep], row[keep]
    return out.reshape(n, COORDS)


def sketch_batch(ids: pa.Array, column: pa.Array) -> pa.RecordBatch:
    element, at = shingle_sets(column)
    size = np.diff(at)
    sketch = sketches(element, at)
    some = np.flatnonzero(size)
    digest = np.zeros((len(size), 2), np.uint64)
    if len(some):
        for k in range(2):
            digest[some, k] = np.add.reduceat(textscan.mix(element, 101 + k), at[:-1][some])
    bands = np.zeros((len(size), COORDS // ROWS), np.uint64)
    for j in range(ROWS):
        bands = textscan.mix(bands + sketch[:, j::ROWS] * _FACTOR[j])
    bands = textscan.mix(bands + np.arange(COORDS // ROWS, dtype=np.uint64))
    low = textscan.mix(sketch).astype(np.uint8)
    fixed = lambda x, w: pa.FixedSizeBinaryArray.from_buffers(pa.binary(w), len(x), [None, pa.py_buffer(np.ascontiguousarray(x))]).cast(pa.binary())
    offsets = pa.array(np.arange(len(size) + 1, dtype=np.int32) * (COORDS // ROWS))
    cols = [ids, pa.array(size), fixed(digest, 16), pa.ListArray.from_arrays(offsets, pa.array(bands.view(np.int64).ravel())), fixed(low, COORDS)]
    return pa.record_batch(cols, ["doc_id", "n_shingles", "digest", "bands", "low"])


def sketch(docs: DataFrame) -> DataFrame:
    def run(batches):
        for b in batches:
            i = 0
            for part in blocks(b.column("text")):
                yield sketch_batch(b.column("doc_id").slice(i, len(part)), part)
                i += len(part)

    rows = docs.select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(run, "doc_id long, n_shingles long, digest binary, bands array<long>, low binary")


def sets_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, shingles) of the documents whose id is in ids (id)."""

    def run(batches):
        for b in batches:
            i = 0
            for part in blocks(b.column("text")):
                element, at = shingle_sets(part)
                sets = pa.LargeListArray.from_arrays(pa.array(at), pa.array(element.view(np.int64))).cast(pa.list_(pa.int64()))
                yield pa.record_batch([b.column("id").slice(i, len(part)), sets], ["id", "shingles"])
                i += len(part)
        trim()

    rows = docs.select(F.col("doc_id").cast("long").alias("id"), "text")
    rows = maybe_in(rows, "id", ids).filter("_maybe").drop("_maybe")
    return rows.join(ids, "id", "left_semi").mapInArrow(run, "id long, shingles array<long>")


@F.arrow_udf(IntegerType())
def equal_coordinates(a: pa.Array, b: pa.Array) -> pa.Array:
    """Of binaries of equal lengths, how many bytes agree."""
    x, y = (textscan.raw(c)[0].reshape(len(c), -1) if len(c) else np.zeros((0, 1)) for c in (a, b))
    return pa.array((x == y).sum(1).astype(np.int32))


def confirmed(pairs: DataFrame, low: DataFrame, docs: DataFrame, stage: Stage) -> DataFrame:
    """Those (a, b) of the pairs that are links. low: (id, low, n)."""
    side = lambda c: low.select(F.col("id").alias(c), F.col("low").alias(f"low_{c}"), F.col("n").alias(f"n_{c}"))
    half = stage.put(pairs.join(side("a"), "a"), "half")
    near = half.join(side("b"), "b").filter("100 * least(n_a, n_b) >= 75 * greatest(n_a, n_b)")
    near = near.filter(equal_coordinates("low_a", "low_b") >= LEAST_EQUAL).select("a", "b")
    near = stage.put(near, "near")
    stage.drop(half)
    ids = stage.put(near.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "ids")
    sets = stage.put(sets_of(docs, ids), "sets")
    of = lambda c: sets.select(F.col("id").alias(c), F.col("shingles").alias(f"s_{c}"))
    half = stage.put(near.join(of("a"), "a"), "with-a")
    both = half.join(of("b"), "b").withColumn("common", F.size(F.array_intersect("s_a", "s_b")))
    links = both.filter(F.col("common") * 100 >= THRESHOLD * (F.size("s_a") + F.size("s_b") - F.col("common")))
    links = stage.put(links.select("a", "b").distinct(), "links")
    for x in (half, sets, near):
        stage.drop(x)
    return links


def tested(low: np.ndarray, bands: np.ndarray, band: int, component: np.ndarray, ids: np.ndarray, stray: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a left and a right row in different components that meet in no earlier band and may be links; of two strays once."""
    a, b = [], []
    for k in range(0, len(left), 64):
        rows = left[k : k + 64]
        able = (component[rows][:, None] != component[right][None]) & (~stray[right][None] | (ids[rows][:, None] < ids[right][None]))
        for e in range(band):
            able &= bands[rows, e][:, None] != bands[right, e][None]
        x, y = np.nonzero(able)
        near = (low[rows[x]] == low[right[y]]).sum(1) >= LEAST_EQUAL
        a.append(rows[x[near]])
        b.append(right[y[near]])
    return (np.concatenate(a), np.concatenate(b)) if a else (left[:0], left[:0])


def common_counts(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the pairs of sets, by products over parts of the shared elements."""
    used, where = np.unique(np.concatenate([a, b]), return_inverse=True)
    at = np.repeat(np.arange(len(used)), [len(sets[u]) for u in used])
    every = np.concatenate([sets[u] for u in used])
    _, number, count = np.unique(every, return_inverse=True, return_counts=True)
    keep = count[number] > 1
    order = np.argsort(number[keep], kind="stable")
    number, at = number[keep][order], at[keep][order]
    number = np.cumsum(np.r_[0, number[1:] != number[:-1]]) if len(number) else number
    out, x, y = np.zeros(len(a)), where[: len(a)], where[len(a) :]
    for k in range(0, int(number[-1]) + 1 if len(number) else 0, 2048):
        lo, hi = np.searchsorted(number, [k, k + 2048])
        m = np.zeros((len(used), 2048), np.float32)
        m[at[lo:hi], number[lo:hi] - k] = 1
        out += (m @ m.T)[x, y]
    return out.astype(np.int64)


def between_blocks(members: DataFrame, reps: DataFrame, docs: DataFrame, stage: Stage) -> DataFrame:
    """Links (a, b) between different components of one bucket. members: (key, id, component, in_major, strays, size).

    Strays, the members outside a bucket's largest component, meet all members: each cell holds a
    block of strays and a block of members, so a bucket of few strays is copied about once.
    """
    blocks_of = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    own = lambda parts: F.pmod(F.xxhash64("id"), F.col(parts).cast("long")).cast("int")
    at = members.withColumns({"rows": blocks_of("strays"), "columns": blocks_of("size")})
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    names = ["key", "id", "component", "in_major"]
    left = at.filter("not in_major").select(*names, own("rows").alias("i"), all_of("columns").alias("j"), F.lit(True).alias("left"))
    right = at.select(*names, own("columns").alias("j"), all_of("rows").alias("i"), F.lit(False).alias("left"))
    cells = stage.put(left.unionByName(right).join(reps.select("id", "n", "bands", "low"), "id"), "cells")

    def read(t: pa.Table):
        low = textscan.raw(t.column("low").combine_chunks())[0].reshape(len(t), COORDS)
        bands = t.column("bands").combine_chunks().flatten().to_numpy().reshape(len(t), -1)
        component, ids = t.column("component").to_numpy(), t.column("id").to_numpy()
        major, left = (t.column(c).to_numpy(zero_copy_only=False) for c in ("in_major", "left"))
        band = int(np.flatnonzero(bands[0] == t.column("key")[0].as_py())[0])
        return tested(low, bands, band, component, ids, ~major, np.flatnonzero(left), np.flatnonzero(~left))

    def may(t: pa.Table) -> pa.Table:
        a, b = read(t)
        some = np.unique(np.concatenate([a, b]))
        return t.select(["key", "i", "j", "id", "left"]).take(pa.array(some))

    def links(t: pa.Table) -> pa.Table:
        a, b = read(t)
        ids, n = t.column("id").to_numpy(), t.column("n").to_numpy()
        if len(a):
            sets = [x.to_numpy() if not isinstance(x, np.ndarray) else x for x in (v.values for v in t.column("shingles"))]
            common = common_counts(sets, a, b)
            good = common * 100 >= THRESHOLD * (n[a] + n[b] - common)
            a, b = a[good], b[good]
        # one link for each pair of components says as much as all
        c = t.column("component").to_numpy()
        _, first = np.unique(np.stack([np.minimum(c[a], c[b]), np.maximum(c[a], c[b])]), axis=1, return_index=True)
        a, b = ids[a[first]], ids[b[first]]
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    cell = ["key", "i", "j"]
    chosen = stage.put(cells.groupBy(*cell).applyInArrow(may, "key long, i int, j int, id long, left boolean"), "chosen")
    sets = stage.put(sets_of(docs, chosen.select("id").distinct()), "block-sets")
    full = cells.join(chosen, [*cell, "id", "left"]).join(sets, "id")
    found = stage.put(full.groupBy(*cell).applyInArrow(links, "a long, b long").distinct(), "block-links")
    for x in (cells, chosen, sets):
        stage.drop(x)
    return found


def groups(docs: DataFrame, stage: Stage) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), a row for each row of docs (doc_id, text)."""
    found = stage.put(sketch(docs), "sketches")
    classes = found.filter("n_shingles > 0 and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("id"))
    classes = stage.put(classes, "classes")
    reps = found.join(classes.select(F.col("id").alias("doc_id"), F.col("digest")), ["doc_id", "digest"], "left_semi")
    reps = reps.groupBy("doc_id").agg(F.min(F.struct("digest", "n_shingles", "bands", "low")).alias("one"))
    reps = reps.select(F.col("doc_id").alias("id"), F.col("one.n_shingles").alias("n"), "one.bands", "one.low")
    reps = stage.put(reps, "representatives")
    low = reps.select("id", "low", "n")
    banded = stage.put(reps.select("id", F.explode("bands").alias("key")), "banded")
    buckets = banded.groupBy("key").agg(F.min("id").alias("center"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    buckets = stage.put(buckets, "buckets")
    members = stage.put(key_join(banded, buckets, "key", stage, "id").filter("center is not null"), "members")
    stage.drop(banded)
    pairs = members.filter("id <> center").select(F.col("center").alias("a"), F.col("id").alias("b")).distinct()
    pairs = stage.put(pairs, "pairs")
    links = confirmed(pairs, low, docs, stage)
    linked = components(links, stage)
    # members of one bucket that are still in different components
    members = stage.put(members.join(linked, "id", "left").select("key", "id", F.coalesce("component", "id").alias("component")), "placed")
    by = members.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
    mixed = by.groupBy("key").agg(F.max(F.struct("n", "component")).alias("top"), F.count(F.lit(1)).alias("parts"), F.sum("n").alias("size"))
    mixed = stage.put(mixed.filter("parts > 1").select("key", F.col("top.component").alias("major"), "size", (F.col("size") - F.col("top.n")).alias("strays")), "mixed")
    there = stage.put(members.join(mixed, "key").select("key", "id", "component", "size", "strays", (F.col("component") == F.col("major")).alias("in_major")), "in-mixed")
    few = there.filter(F.col("size") <= SMALL)
    x = few.filter(~F.col("in_major")).select("key", F.col("id").alias("x"), F.col("component").alias("cx"))
    y = few.select("key", F.col("id").alias("y"), F.col("component").alias("cy"), "in_major")
    rest = x.join(y, "key").filter("cx <> cy and (in_major or x < y)")
    rest = rest.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct().join(pairs, ["a", "b"], "left_anti")
    more = confirmed(stage.put(rest, "rest"), low, docs, stage)
    more = more.unionByName(between_blocks(there.filter(F.col("size") > SMALL), reps, docs, stage))
    more = stage.put(more, "more")
    if not more.isEmpty():
        linked = components(links.unionByName(more), stage)
    named = classes.join(linked, "id", "left").select("digest", F.coalesce("component", "id").alias("component"))
    named = stage.put(named, "named")
    stage.clear(found, named)
    slim = found.select("doc_id", "n_shingles", F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("digest")).alias("digest"))
    out = key_join(slim, named, "digest", stage, "doc_id")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def deduplicated(docs: DataFrame, stage: Stage) -> DataFrame:
    """One document of each group, with all columns; of rows that repeat a doc_id, the one whose text has the least hash.

    Only rows whose doc_id may be among those removed or repeated are shuffled.
    """
    found = stage.put(groups(docs.select("doc_id", "text"), stage), "groups")
    named = found.filter("doc_id is not null").groupBy("doc_id").agg(F.bool_and("kept").alias("kept"), F.count(F.lit(1)).alias("n"))
    named = stage.put(named.filter("not kept or n > 1").select(F.col("doc_id").alias("id"), "kept"), "removed")
    stage.clear(named)
    whole_rows = docs.select(F.struct(*docs.columns).alias("doc"), F.col("doc_id").cast("long").alias("id"))  # as one column, their names clash with none
    flagged = maybe_in(whole_rows, "id", named)
    doubtful = flagged.filter("_maybe").join(named.filter("not kept").select("id"), "id", "left_anti")
    # of rows that repeat an id, the one whose text has the least hash
    doubtful = doubtful.groupBy("id").agg(F.min_by("doc", F.xxhash64("doc.text")).alias("doc"))
    return flagged.filter("not _maybe").select("doc.*").unionByName(doubtful.select("doc.*"))


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(table(spark, sf_dir, "documents").select("doc_id", "text"), Stage(spark))
