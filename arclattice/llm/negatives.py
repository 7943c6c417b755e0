"""Hard negatives by vantage-point trees over norm-augmented vectors.

Components become integers, floor(scale * x); a row's score for an anchor is their inner product. With M the
largest norm, a vector x gets one more component sqrt(M^2 - |x|^2), so that all lie on a sphere, and an
anchor q a zero. The distance on the sphere, the angle between them, has the cosine score / (|q| M): the highest
score is the nearest row, and a window of scores is an annulus of distances. (Straight distances to
anchors that do not lie on the sphere leave out far less.) A tree splits its rows at the median distance from a vantage point. An anchor's
walk keeps the nodes in a heap, nearest first: it leaves out those that the triangle inequality puts
inside the annulus' hole, stops at the first beyond its rim or beyond the k-th row found, and compares
scores of leaves exactly.

Positives are sought among the rows of the anchor's label: labels with few rows share a group, one with more
than CELL is dealt to several. Negatives are sought in the cells of a tree that is fitted on a bounded
sample and holds every row; an anchor is sent to the cells that its annuli meet, and a cell of more than
CELL rows, such as one of equal vectors, is dealt to several groups by vec_id. Anchors come in blocks of at most about ANCHORS, so a
task holds a bounded number of rows and anchors, in a tree of its own. Each group hands on an anchor's
first rows, of which the first are taken in the end.

Rows with a null vec_id, label or vector, or any null or non-finite component, take no part; vectors of
different lengths do not meet. Scaled components are held within 2^24, so that scores of up to 32,767 components fit 64 bits. Equal
scores go by the smaller vec_id. Rows that repeat vec_id, label and vector are one; others that repeat a
vec_id are rows of their own, but never one another's positive or negative. A positive score below zero
has no window. Other columns are not read, whatever their names; an empty table gives an empty one.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Stage, key_join, table

POSITIVES, NEGATIVES = 5, 3
#: The window of negative scores, in percent of the positive's.
LOW, HIGH = 50, 95
SCALE, MOST = 256, 1 << 24
#: Rows and anchors of a group, about.
CELL, ANCHORS = 8192, 2048
#: Rows of a leaf.
LEAF = 512
#: The sample that the cells are fitted on, and how many cells there are at most.
SAMPLE, SAMPLE_BYTES, CELLS = 8192, 32 << 20, 1024
#: A length with fewer sampled vectors has no tree; it shares its cell with others.
FEW = 64
#: What rounding may move a distance by.
SLACK = 2e-6


def valid(v: str = "embedding") -> Column:
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(F.col(v).isNotNull() & ok, F.lit(False))


def integers(vectors: DataFrame, scale: int) -> DataFrame:
    """(vec_id, label, x) of the rows that take part: x as little-endian 32-bit integers."""

    @F.arrow_udf("binary")
    def pack(v: pa.Array) -> pa.Array:
        flat = v.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        x = np.clip(np.floor(flat * scale), -MOST, MOST).astype("<i4")
        at = np.r_[0, np.cumsum(v.value_lengths().to_numpy(zero_copy_only=False))]
        return pa.array([x[at[i] : at[i + 1]].tobytes() for i in range(len(v))], pa.binary())

    rows = vectors.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & valid())
    return rows.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), pack(F.col("embedding")).alias("x"))


def matrix(raw: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(raw), "<i4").reshape(len(raw), -1).astype(np.float64) if raw else np.zeros((0, 0))


def products(rows: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products of integers held as doubles, exact."""
    if not rows.size:
        return np.zeros(len(rows), np.int64)
    if np.abs(rows).max() * np.abs(q).max() * rows.shape[1] < 1 << 53:
        return (rows @ q).astype(np.int64)
    return rows.astype(np.int64) @ q.astype(np.int64)


@dataclass
class Node:
    rows: np.ndarray
    vantage: int = -1
    #: Distances of the rows of each child from the vantage point.
    bounds: tuple = ()
    children: tuple = ()
    #: What lies at this distance or nearer is in the first child.
    cut: float = 0.0
    label: int | None = None  # that of all its rows


def lifted(x: np.ndarray, most: float) -> np.ndarray:
    """Rows on the unit sphere with one more component; most is at least each one's norm."""
    u = x / (most or 1.0)
    return np.concatenate([u, np.sqrt(np.maximum(1 - (u * u).sum(1, keepdims=True), 0.0))], 1)


def turned(q: np.ndarray) -> np.ndarray:
    """Anchors on the unit sphere; those of length zero stay."""
    norm = np.sqrt((q * q).sum(1, keepdims=True))
    return np.concatenate([q / np.where(norm == 0, 1.0, norm), np.zeros((len(q), 1))], 1)


class Tree:
    """Nodes over rows of x, as 64-bit floats that hold integers; most is at least each one's norm."""

    def __init__(self, x: np.ndarray, labels: np.ndarray, most: float, leaf: int = LEAF):
        self.x, self.most = x, most
        self.u = lifted(x, most)
        self.nodes = [Node(np.arange(len(x)))]
        i = 0
        while i < len(self.nodes):
            node = self.nodes[i]
            own = labels[node.rows]
            node.label = int(own[0]) if len(own) and (own == own[0]).all() else None
            if len(node.rows) > leaf:
                self.split(node)
            i += 1
        self.inner = [i for i, n in enumerate(self.nodes) if n.children]
        self.place = {n: k for k, n in enumerate(self.inner)}

    def split(self, node: Node) -> None:
        u = self.u[node.rows]
        far = int(((u - u.mean(0)) ** 2).sum(1).argmax())
        d = np.arccos(np.clip(u @ u[far], -1, 1))
        cut = float(np.median(d))
        if not (d > cut).any():
            cut = float(d[d < cut].max()) if (d < cut).any() else np.pi
        near = d <= cut
        if near.all():
            return  # rows that no distance tells apart
        node.vantage, node.cut = int(node.rows[far]), cut
        node.bounds = tuple((float(d[part].min()), float(d[part].max())) for part in (near, ~near))
        node.children = (len(self.nodes), len(self.nodes) + 1)
        self.nodes += [Node(node.rows[near]), Node(node.rows[~near])]

    def to_vantages(self, u: np.ndarray) -> np.ndarray:
        """Distances of points of the sphere to the vantage points of the inner nodes."""
        return np.arccos(np.clip(u @ self.u[[self.nodes[i].vantage for i in self.inner]].T, -1, 1)) if self.inner else np.zeros((len(u), 0))


def reach(score, norm: float, most: float):
    """Distance of the rows with a score for an anchor of this norm."""
    return np.arccos(np.clip(score / (norm * most), -1, 1))


def child_bounds(d, low, high, bounds):
    """(nearest, farthest) of a child whose rows are so far from a vantage point, at distance d, within those of its parent."""
    return np.maximum(low, np.maximum(d - bounds[1], bounds[0] - d)), np.minimum(high, d + bounds[1])


class Walker:
    """An anchor in a tree. Rows of leaves are looked at once, whatever the number of windows."""

    def __init__(self, tree: Tree, ids: np.ndarray, labels: np.ndarray, q: np.ndarray, own_id: int, own_label: int, to_vantages: np.ndarray, same: bool):
        self.tree, self.ids, self.labels, self.q = tree, ids, labels, q
        self.own_id, self.own_label, self.same, self.d = own_id, own_label, same, to_vantages
        self.norm = float(q @ q) ** 0.5
        self.blind = not self.norm * tree.most  # all scores are 0, distances say nothing
        self.seen: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def leaf(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """(-score, id) of the leaf's rows of the anchor's label, or of others, in order."""
        if i not in self.seen:
            rows = self.tree.nodes[i].rows
            rows = rows[((self.labels[rows] == self.own_label) == self.same) & (self.ids[rows] != self.own_id)]
            score = -products(self.tree.x[rows], self.q)
            order = np.lexsort((self.ids[rows], score))
            self.seen[i] = score[order], self.ids[rows][order]
        return self.seen[i]

    def first(self, k: int, low: int | None = None, high: int | None = None) -> list[tuple[int, int]]:
        """(-score, id) of the first k rows with low <= score <= high."""
        far_as = lambda score, none: none if score is None or self.blind else float(reach(score, self.norm, self.tree.most))
        hole, rim = far_as(high, 0.0), far_as(low, np.pi)
        best: list[tuple[int, int]] = []
        heap = [(0.0, np.pi, 0)]
        while heap:
            near, far, i = heapq.heappop(heap)
            if near > rim + SLACK:
                break
            node = self.tree.nodes[i]
            if far < hole - SLACK or (node.label is not None and (node.label == self.own_label) != self.same):
                continue
            if node.children:
                d = float(self.d[self.tree.place[i]])
                for child, bounds in zip(node.children, node.bounds, strict=True):
                    heapq.heappush(heap, (*map(float, child_bounds(d, near, far, bounds)), child))
                continue
            score, ids = self.leaf(i)
            at = 0 if high is None else int(np.searchsorted(score, -high, "left"))
            end = min(at + k, len(score) if low is None else int(np.searchsorted(score, -low, "right")))
            if end > at:
                best = sorted([*best, *zip(score[at:end].tolist(), ids[at:end].tolist(), strict=True)])[:k]
                if len(best) == k:
                    rim = min(rim, far_as(-best[-1][0], np.pi))
        return best


def groups(rows: pa.Table) -> dict[int, np.ndarray]:
    """The different rows of each length of x, by their places."""
    seen, by = set(), {}
    for i, r in enumerate(zip(rows.column("vec_id").to_pylist(), rows.column("label").to_pylist(), rows.column("x").to_pylist(), strict=True)):
        if r not in seen:
            seen.add(r)
            by.setdefault(len(r[2]), []).append(i)
    return {n: np.array(at) for n, at in by.items()}


def walkers(rows: pa.Table, anchors: pa.Table, most: float, same: bool, apart: bool):
    """(place of an anchor, its Walker). apart: a tree for each label, and anchors only in that of theirs."""
    wanted: dict[int, list[int]] = {}
    for i, x in enumerate(anchors.column("x").to_pylist()):
        wanted.setdefault(len(x), []).append(i)
    if not wanted or not len(rows):
        return
    ids, labels, raw = rows.column("vec_id").to_numpy(), rows.column("label").to_numpy(), rows.column("x").to_pylist()
    own_ids, own_labels, own_raw = anchors.column("vec_id").to_numpy(), anchors.column("label").to_numpy(), anchors.column("x").to_pylist()
    for size, at in groups(rows).items():
        mine = np.array(wanted.get(size, []), np.int64)
        for label in np.unique(own_labels[mine]).tolist() if apart else [None]:
            there = at if label is None else at[labels[at] == label]
            who = mine if label is None else mine[own_labels[mine] == label]
            if not len(there) or not len(who):
                continue
            x, q = matrix([raw[i] for i in there]), matrix([own_raw[i] for i in who])
            tree = Tree(x, labels[there], most)
            d = tree.to_vantages(turned(q))
            for k, i in enumerate(who.tolist()):
                yield i, Walker(tree, ids[there], labels[there], q[k], int(own_ids[i]), int(own_labels[i]), d[k], same)


def dealt(rows: DataFrame, sizes: DataFrame, stage: Stage) -> DataFrame:
    """rows (key, vec_id, ...) with the numbers of parts and blocks of their key: 1 unless sizes (key, rows, anchors) say more."""
    many = lambda c, n: F.greatest(F.lit(1), F.ceil(F.col(c) / n)).cast("int")
    large = sizes.select("key", many("rows", CELL).alias("parts"), many("anchors", ANCHORS).alias("blocks")).filter("parts > 1 or blocks > 1")
    out = key_join(rows, stage.put(large, "large"), "key", stage, "vec_id")
    return out.withColumns({c: F.coalesce(c, F.lit(1)) for c in ("parts", "blocks")})


def counts(rows: DataFrame, anchors: DataFrame) -> DataFrame:
    """(key, rows, anchors): how many of each have a key of the rows."""
    n = lambda df, name: df.groupBy("key").agg(F.count(F.lit(1)).alias(name))
    return n(rows, "rows").join(n(anchors, "anchors"), "key", "left").fillna(0, "anchors")


def of(column: str, n: str) -> Column:
    return F.pmod(F.xxhash64(column), F.col(n).cast("long")).cast("int")


def every(n: str) -> Column:
    return F.explode(F.sequence(F.lit(0), F.col(n) - 1))


GROUP = ["key", "part", "block"]


def met(rows: DataFrame, anchors: DataFrame, find, schema: str) -> DataFrame:
    """find(rows, anchors) of every group; both sides have key, parts and blocks. A row is in one part and all blocks, an anchor the other way round."""
    left = rows.withColumn("part", of("vec_id", "parts")).withColumn("block", every("blocks")).drop("parts", "blocks")
    right = anchors.withColumn("block", of("a", "blocks")).withColumn("part", every("parts")).drop("parts", "blocks")
    return left.groupBy(*GROUP).cogroup(right.groupBy(*GROUP)).applyInArrow(find, schema)


def first_rows(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The k rows of each key with the highest score, equal ones by id."""
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def positives(rows: DataFrame, anchors: DataFrame, stage: Stage, most: float, k: int) -> DataFrame:
    """(a, id, score, rank): the first k other rows of each anchor's label."""

    def find(r: pa.Table, q: pa.Table) -> pa.Table:
        out = [(i, s, n) for i, w in walkers(r, q, most, same=True, apart=True) for s, n in w.first(k)]
        at, s, n = zip(*out, strict=True) if out else ((), (), ())
        return pa.table({"a": q.column("a").take(pa.array(at, pa.int64())), "id": pa.array(n, pa.int64()), "score": pa.array([-x for x in s], pa.int64())})

    kind = F.xxhash64(F.octet_length("x"), F.col("label"))
    sizes = counts(rows.select(kind.alias("key")), anchors.select(kind.alias("key")))
    few = max(1, rows.count() // CELL)  # groups for the labels with few rows
    keyed = lambda df: dealt(df.withColumn("key", kind), sizes, stage).withColumn("key", F.when((F.col("parts") > 1) | (F.col("blocks") > 1), F.col("key")).otherwise(F.pmod("key", F.lit(few).cast("long"))))
    sizes = stage.put(sizes, "labels")
    found = met(keyed(rows), keyed(anchors), find, "a long, id long, score long")
    return first_rows(found, ["a"], k)


class Cells:
    """The cells of all vectors: leaves of trees fitted on a sample, one tree for each length that the sample has enough of."""

    def __init__(self, sample: list[bytes], cells: int, most: float):
        self.trees: dict[int, tuple[Tree, dict[int, int]]] = {}
        self.most, n = most, 0
        for size in sorted({len(x) for x in sample}):
            x = matrix([v for v in sample if len(v) == size])
            if len(x) >= FEW and size:
                tree = Tree(x, np.zeros(len(x), np.int64), most, max(1, len(sample) // cells))
                leaves = [i for i, node in enumerate(tree.nodes) if not node.children]
                self.trees[size] = tree, {leaf: n + k for k, leaf in enumerate(leaves)}
                n += len(leaves)

    def of_rows(self, raw: list[bytes]) -> list[int | None]:
        """The cell of each row; null where its length has no tree."""
        out: list[int | None] = [None] * len(raw)
        for size, (tree, number) in self.trees.items():
            at = np.array([i for i, x in enumerate(raw) if len(x) == size], np.int64)
            if not len(at):
                continue
            node = np.zeros(len(at), np.int64)
            d = tree.to_vantages(lifted(matrix([raw[i] for i in at]), self.most))
            for i, n in enumerate(tree.nodes):  # a child comes after its parent
                here = np.flatnonzero(node == i) if n.children else ()
                if len(here):
                    node[here] = np.where(d[here, tree.place[i]] <= n.cut, *n.children)
            for i, k in zip(at.tolist(), node.tolist(), strict=True):
                out[i] = number[k]
        return out

    def met_by(self, raw: list[bytes], low: np.ndarray, high: np.ndarray) -> list[list[int] | None]:
        """The cells that may hold rows of a score from low to high; null where the length has no tree."""
        out: list[list[int] | None] = [None] * len(raw)
        for size, (tree, number) in self.trees.items():
            at = np.array([i for i, x in enumerate(raw) if len(x) == size], np.int64)
            if not len(at):
                continue
            q = matrix([raw[i] for i in at])
            norm = np.sqrt((q * q).sum(1))
            blind = norm * self.most == 0
            norm[blind] = 1.0
            hole, rim = (reach(s[at].astype(float), norm, self.most or 1.0) for s in (high, low))
            hole[blind], rim[blind] = 0.0, np.pi
            d = tree.to_vantages(turned(q))
            bounds = {0: (np.zeros(len(q)), np.full(len(q), np.pi))}
            found: list[list[int]] = [[] for _ in at]
            for i, n in enumerate(tree.nodes):
                near, far = bounds.pop(i)
                if n.children:
                    # the sample's own bounds need not hold for other rows, but the cut does
                    for child, b in zip(n.children, ((0.0, n.cut), (n.cut, np.pi)), strict=True):
                        bounds[child] = child_bounds(d[:, tree.place[i]], near, far, b)
                else:
                    for k in np.flatnonzero((near <= rim + SLACK) & (far >= hole - SLACK)).tolist():
                        found[k].append(number[i])
            for i, cells in zip(at.tolist(), found, strict=True):
                out[i] = cells
        return out


def fitted(rows: DataFrame, most: float) -> Cells:
    """Cells from at most SAMPLE different vectors, those of lowest hash, and SAMPLE_BYTES; a cell holds about CELL rows or a CELLS-th of all."""
    n, width = rows.agg(F.count(F.lit(1)), F.coalesce(F.max(F.octet_length("x")), F.lit(1))).first()
    many = max(FEW, min(SAMPLE, SAMPLE_BYTES // (2 * max(1, width))))
    share, place = min(1.0, 4 * many / max(1, n)), F.xxhash64("x")
    low = rows.filter(place <= F.lit(min((1 << 63) - 1, int(-(1 << 63) + share * (1 << 64))))).select("x").distinct()
    sample = [bytes(r["x"]) for r in low.orderBy(place, "x").limit(many).collect()]
    return Cells(sample, max(1, min(CELLS, -(-n // CELL))), most)


def negatives(rows: DataFrame, anchors: DataFrame, chosen: DataFrame, stage: Stage, most: float, k: int, low: int, high: int) -> DataFrame:
    """(a, positive_id, positive_score, id, score, rank): the first k rows of other labels in the window of each chosen positive (a, id, score)."""
    # low * p <= 100 n <= high * p in integers; no score here is below zero
    window = F.struct("rank", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"), F.expr(f"(score * {low} + 99) div 100").alias("low"), F.expr(f"(score * {high}) div 100").alias("high"))
    wanted = chosen.filter("score >= 0").withColumn("w", window).groupBy("a").agg(F.array_sort(F.collect_list("w")).alias("windows"))  # at most as many as there are positives of an anchor
    wanted = stage.put(anchors.join(wanted, "a"), "windows")
    cells = fitted(rows, most)
    rare = (F.lit(-1) - F.pmod(F.xxhash64(F.octet_length("x")), F.lit(CELLS).cast("long"))).cast("long")

    @F.arrow_udf("long")
    def cell(x: pa.Array) -> pa.Array:
        return pa.array(cells.of_rows(x.to_pylist()), pa.int64())

    @F.arrow_udf("array<long>")
    def cells_met(x: pa.Array, least: pa.Array, most: pa.Array) -> pa.Array:
        return pa.array(cells.met_by(x.to_pylist(), least.to_numpy(zero_copy_only=False), most.to_numpy(zero_copy_only=False)), pa.list_(pa.int64()))

    there = stage.put(rows.withColumn("key", F.coalesce(cell("x"), rare)), "cells")
    reach = cells_met(F.col("x"), F.array_min(F.transform("windows", lambda w: w["low"])), F.array_max(F.transform("windows", lambda w: w["high"])))
    sent = stage.put(wanted.withColumn("key", F.explode(F.coalesce(reach, F.array(rare)))), "sent")
    sizes = stage.put(counts(there, sent), "sizes")

    def find(r: pa.Table, q: pa.Table) -> pa.Table:
        windows, out = q.column("windows").to_pylist(), []
        for i, w in walkers(r, q, most, same=False, apart=False):
            for x in windows[i]:
                if x["low"] <= x["high"]:
                    out += [(i, x["positive_id"], x["positive_score"], n, -s) for s, n in w.first(k, x["low"], x["high"])]
        at, *columns = zip(*out, strict=True) if out else ((),) * 5
        names = ("positive_id", "positive_score", "id", "score")
        return pa.table({"a": q.column("a").take(pa.array(at, pa.int64()))} | {n: pa.array(c, pa.int64()) for n, c in zip(names, columns, strict=True)})

    found = met(dealt(there, sizes, stage), dealt(sent, sizes, stage), find, "a long, positive_id long, positive_score long, id long, score long")
    return first_rows(found, ["a", "positive_id", "positive_score"], k)


def hard_negatives(vectors: DataFrame, anchor: Column, stage: Stage, scale: int = SCALE, n_positives: int = POSITIVES, n_negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of vectors (vec_id, embedding, label).

    anchor: a condition on vec_id and label. For each of an anchor's first positives, the first negatives whose score is from
    `low` to `high` percent of the positive's.
    """
    rows = stage.put(integers(vectors.select("vec_id", "embedding", "label"), scale), "integers")
    anchors = rows.filter(anchor).dropDuplicates(["vec_id", "label", "x"]).withColumn("a", F.monotonically_increasing_id())
    anchors = stage.put(anchors, "anchors")

    @F.arrow_udf("double")
    def norm(x: pa.Array) -> pa.Array:
        return pa.array([float((v * v).sum()) for v in (np.frombuffer(r, "<i4").astype(np.float64) for r in x.to_pylist())], pa.float64())

    most = (rows.agg(F.max(norm("x"))).first()[0] or 0.0) ** 0.5
    chosen = stage.put(positives(rows, anchors, stage, most, n_positives), "positives")
    out = negatives(rows, anchors, chosen, stage, most, n_negatives, low, high)
    return out.join(anchors.select("a", F.col("vec_id").alias("anchor_id")), "a").select(
        "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )


def op12_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", label.alias("label"))
    return hard_negatives(rows, F.col("vec_id") % 50 == 0, Stage(spark))
