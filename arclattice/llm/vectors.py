"""Near-duplicate embeddings by a pivot-permutation index.

Pivots are a bounded sample of the vectors, those of lowest hash, thinned where it is crowded: a dense
group would own most of a plain sample and its members pick their nearest pivots at random. Vectors and
pivots are taken less the sample's mean: embeddings often share a direction, which says nothing
of who is near whom. Every vector is described by its COUNTED nearest pivots, the nearest first. The first
few of them (`named`) put it into inverted lists, and two vectors are candidates if they share two of these
pivots and, of all COUNTED ones, at least `least_shared`. How many are named and must be shared is
fitted on pairs made from the sample at a cosine of exactly THRESHOLD: the more of a vector lies in the shared direction, the less alike is
the rest of such a pair. Candidates are verified by cosine in double precision.

Lists hold ids and permutations only; vectors are fetched for the list members that have a candidate.
Pivots grow with the square root of the vectors, so that a list of two pivots keeps its length. The
list of a pivot is one cell, read by one task; pairs of pivots that are both crowded have cells of
their own, which are compared block by block. A pair counts only in the list of the two smallest
pivots that it shares. Tasks emit link counts and a spanning forest, never the pairs.

Equal vectors are one class, its smallest vec_id stands for it. Vectors of a length that has few
pivots form one list, compared whole.

Vectors that are null or zero or hold null or non-finite components link with nothing; vectors of
different lengths do not link. Rows that repeat a vec_id with different vectors are one vertex with the
links of all of them; a null vec_id links with nothing, its component_id is null and it is kept. Of
ties between pivots the one of lower number comes first. Other columns are not read, an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import ceil, floor, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stage, components, key_join, maybe_in, partitions, table

THRESHOLD = 0.9
#: Pivots: twice the square root of the number of vectors, within these bounds and MOST_BYTES of vectors.
LEAST_PIVOTS, MOST_PIVOTS, MOST_BYTES = 64, 65_000, 64 << 20
#: A length with fewer pivots has one list.
FEW_PIVOTS = 16
#: Pivots of a vector that are counted.
COUNTED = 32
#: A pivot has at most CROWD earlier ones within a cosine, the first of CLOSE that leaves a share of KEPT of the sample (the last
#: leaves all): well below the named pivots, so that a dense group shares all of its own.
CLOSE, CROWD, KEPT = (0.5, 0.65, 0.8, 0.9, 2.0), 2, 1 / 8
#: Pairs that named and least_shared are fitted on, and the share of them that may be missed by either.
PROBES, MISSED = 512, 0.004
#: A pivot is crowded if its list has over CROWDED vectors and over twice the mean.
CROWDED = 4096
BLOCK = 2048
#: List entries that one task reads at once, about.
ENTRIES = 100_000
#: Lists of so many members are compared in stripes.
STRIPE = 256
_NONE = 65_535
_PAIR = 1 << 16
#: Name of the list of a length without pivots: this less its bytes.
_LENGTH = -(1 << 40)


def named(pivots: int) -> int:
    """How many of the nearest pivots name lists, at least."""
    return max(6, ceil(log2(max(2, pivots))) - 1)


def least_shared(pivots: int) -> int:
    """Shared pivots of COUNTED that a candidate needs, at most: below what all but one in a thousand pairs at a cosine of 0.9 share."""
    return max(4, 28 - floor(1.83 * log2(max(2, pivots))))


def valid(v: str = "embedding"):
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(F.col(v).isNotNull() & ok & F.exists(v, lambda x: x != 0), F.lit(False))


def kind_of(vectors: DataFrame) -> str:
    """numpy type of the components: single precision stays as it is, which loses nothing."""
    return "<f4" if vectors.schema["embedding"].dataType.elementType.simpleString() == "float" else "<f8"


def packed(vectors: DataFrame) -> DataFrame:
    """(vec_id, digest, vector): the vector as bytes of its components, both null if it links with nothing."""
    kind = kind_of(vectors)

    @F.arrow_udf("struct<digest: binary, vector: binary>")
    def pack(v: pa.Array) -> pa.Array:
        there = v.is_valid().to_numpy(zero_copy_only=False)
        flat = v.flatten().to_numpy(zero_copy_only=False).astype(kind) + np.zeros(1, kind)  # -0 is 0
        size = np.where(there, v.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), 0)
        at = np.concatenate([[0], np.cumsum(size)])
        raw = [flat[at[i] : at[i + 1]].tobytes() if ok else None for i, ok in enumerate(there)]
        digest = [None if x is None else hashlib.blake2b(x, digest_size=16).digest() for x in raw]
        return pa.StructArray.from_arrays([pa.array(digest, pa.binary()), pa.array(raw, pa.binary())], ["digest", "vector"])

    element = "float" if kind == "<f4" else "double"
    usable = F.when(valid() & F.col("vec_id").isNotNull(), F.col("embedding").cast(f"array<{element}>"))
    return vectors.select(F.col("vec_id").cast("long"), pack(usable).alias("_p")).select("vec_id", "_p.*")


def unit(raw: list[bytes], kind: str) -> np.ndarray:
    """Rows of unit length in double precision."""
    x = np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)  # keeps the squares finite
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def off_mean(x: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """Unit rows less their mean, of unit length in single precision; a row that is the mean stays zero."""
    x = x - mean
    norm = np.sqrt((x * x).sum(1, keepdims=True))
    return (x / np.where(norm > 1e-9, norm, np.inf)).astype(np.float32)


def thinned(x: np.ndarray) -> list[int]:
    """The places of a sample (unit rows, in their order) without those that over CROWD rows kept before are close to."""
    kept: list[int] = []
    for close in CLOSE:
        kept, near = [], np.empty_like(x)
        for k in range(len(x)):
            if np.count_nonzero(near[: len(kept)] @ x[k] >= close) <= CROWD:
                near[len(kept)] = x[k]
                kept.append(k)
        if len(kept) >= max(KEPT * len(x), min(len(x), 4 * FEW_PIVOTS)):
            break
    return kept


def nearest(x: np.ndarray, pivots: np.ndarray, m: int) -> np.ndarray:
    """The m nearest pivots of each row, the nearest first; ties by number."""
    far = -(x @ pivots.T)
    at = np.sort(np.argpartition(far, m - 1, axis=1)[:, :m], axis=1)
    return np.take_along_axis(at, np.argsort(np.take_along_axis(far, at, 1), axis=1, kind="stable"), 1)


class Pivots:
    """Pivots by the size of their vectors in bytes: their numbers, the mean of the sample, and themselves less it."""

    def __init__(self, sample: list[bytes], kind: str):
        self.of: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        self.total = 0
        fits = []
        for s in sorted({len(v) for v in sample}):
            x = unit([v for v in sample if len(v) == s], kind)
            if len(x) < FEW_PIVOTS:
                continue
            mean = x.mean(0)
            own = off_mean(x, mean)
            kept = thinned(own)
            if len(kept) >= FEW_PIVOTS:
                self.of[s] = np.arange(self.total, self.total + len(kept)), mean, own[kept]
                self.total += len(kept)
                fits.append((len(x), *fit(x, mean, own[kept], kept)))
        # named and shared pivots of the size with most vectors; sizes are looked for alike
        _, self.named, self.least = max(fits, default=(0, named(self.total), least_shared(self.total)))

    def permutations(self, raw: list[bytes], kind: str) -> np.ndarray:
        """The COUNTED nearest pivots of vectors of one size, nearest first, as 16-bit numbers."""
        number, mean, p = self.of[len(raw[0])]
        m = min(COUNTED, len(number))
        out = np.full((len(raw), COUNTED), _NONE, "<u2")
        out[:, :m] = number[nearest(off_mean(unit(raw, kind), mean), p, m)]
        return out


def fit(x: np.ndarray, mean: np.ndarray, pivots: np.ndarray, kept: list[int]) -> tuple[int, int]:
    """(named, least_shared) that pairs at a cosine of THRESHOLD fulfil, but for MISSED of them.

    The partner of a sampled row is turned from it, about the mean, towards the rest of another row, until their cosine is
    THRESHOLD. A row that is a pivot does not count as one of its own.
    """
    rng, m = np.random.default_rng(20240607), min(COUNTED, len(pivots) - 1)
    i = rng.choice(len(x), PROBES)
    w, other = x[i] - mean, x[rng.choice(len(x), PROBES)] - mean
    size = (w * w).sum(1, keepdims=True)
    side = other - (other * w).sum(1, keepdims=True) / np.maximum(size, 1e-12) * w
    norm = np.sqrt((side * side).sum(1, keepdims=True))
    able = (norm > 1e-6)[:, 0] & (size > 1e-12)[:, 0]
    side *= np.sqrt(size) / np.maximum(norm, 1e-12)
    low, high = np.zeros((len(i), 1)), np.full((len(i), 1), np.pi)
    for _ in range(40):
        t = (low + high) / 2
        y = mean + np.cos(t) * w + np.sin(t) * side
        y /= np.sqrt((y * y).sum(1, keepdims=True))
        near = (y * x[i]).sum(1, keepdims=True) >= THRESHOLD
        low, high = np.where(near, t, low), np.where(near, high, t)
    able &= np.abs((y * x[i]).sum(1) - THRESHOLD) < 1e-6  # a row near the mean has no partner so far from it
    if not able.any() or m < 2:
        return named(len(pivots)), least_shared(len(pivots))
    a, b = (nearest(off_mean(v[able], mean), pivots, m + 1) for v in (x[i], y))
    place = np.full(len(x), -1)
    place[kept] = np.arange(len(kept))
    own = place[i[able]]

    def others(rows):
        return np.stack([r[r != k][:m] for r, k in zip(rows, own, strict=True)])

    a, b = others(a), others(b)
    rank = lambda u, v: np.where((same := u[:, :, None] == v[:, None, :]).any(2), np.maximum(np.arange(m)[None], same.argmax(2)), m)
    # a pivot is among the first k of both from the larger of its two ranks on
    ranks = np.sort(rank(a, b), axis=1)
    shared = (ranks < m).sum(1)
    k = int(np.quantile(ranks[:, 1], 1 - MISSED, method="higher")) + 1
    least = int(np.quantile(shared, MISSED, method="lower")) - 1
    return min(m, max(named(len(pivots)), k)), max(2, min(least_shared(len(pivots)), least))


def pivots_of(rows: DataFrame, kind: str) -> Pivots:
    """The pivots of rows (digest, vector): distinct vectors of lowest digest, at most MOST_PIVOTS and MOST_BYTES, thinned."""
    n, width = rows.agg(F.approx_count_distinct("digest"), F.coalesce(F.max(F.octet_length("vector")), F.lit(1))).first()
    many = min(max(LEAST_PIVOTS, int(2 * n**0.5)), MOST_PIVOTS, max(LEAST_PIVOTS, MOST_BYTES // width))
    # a share of the hashes that holds more than enough, so that only few vectors are sorted
    share = min(1.0, 2 * (many + 50) / max(1, n))
    place = F.xxhash64("digest")
    near = rows.filter(place <= F.lit(min((1 << 63) - 1, int(-(1 << 63) + share * (1 << 64))))).groupBy("digest").agg(F.first("vector").alias("vector"))
    return Pivots([bytes(r["vector"]) for r in near.orderBy(place, "digest").limit(many).select("vector").collect()], kind)


def permutation(pivots: Pivots, kind: str):
    """Column function: the COUNTED nearest pivots of a vector, nearest first, as 16-bit numbers; null for lengths of few pivots."""

    @F.arrow_udf("binary")
    def near(v: pa.Array) -> pa.Array:
        raw = v.to_pylist()
        out: list = [None] * len(raw)
        for s in {len(x) for x in raw} & set(pivots.of):
            rows = [i for i, x in enumerate(raw) if len(x) == s]
            for k in range(0, len(rows), 512):
                part = rows[k : k + 512]
                for i, f in zip(part, pivots.permutations([raw[i] for i in part], kind), strict=True):
                    out[i] = f.tobytes()
        return pa.array(out, pa.binary())

    return near


def lists_of(crowded: np.ndarray, k: int):
    """Column function of a permutation: struct<cells: the pivots in whose cells it is, pairs: names of its pairs of crowded pivots>."""

    @F.arrow_udf("struct<cells: array<int>, pairs: array<long>>")
    def lists(permutation: pa.Array) -> pa.Array:
        cells: list = []
        pairs: list = []
        for raw in permutation.to_pylist():
            top = sorted(np.frombuffer(raw, "<u2")[:k].tolist())
            full, free = [x for x in top if crowded[x]], [x for x in top if not crowded[x]]
            cells.append(free if full else free[:-1])
            pairs.append([a * _PAIR + b for i, a in enumerate(full) for b in full[i + 1 :]])
        return pa.StructArray.from_arrays([pa.array(cells, pa.list_(pa.int32())), pa.array(pairs, pa.list_(pa.int64()))], ["cells", "pairs"])

    return lists


class Members:
    """Rows of one task: permutations in the forms that comparing needs."""

    def __init__(self, t: pa.Table, crowded: np.ndarray, k: int, least: int):
        self.ids, self.n = t.column("id").to_numpy(), t.column("n").to_numpy()
        self.key, self.i, self.j, self.block = (t.column(c).to_numpy() for c in ("key", "i", "j", "block"))
        self.least, self.crowded = least, crowded
        self.all = np.frombuffer(b"".join(x or b"\xff" * 2 * COUNTED for x in t.column("permutation").to_pylist()), "<u2").reshape(len(t), COUNTED)
        self.top = np.sort(self.all[:, :k], axis=1)
        self.map = np.zeros((len(t), 4), np.uint64)  # 256 bits: their common ones are at least the shared pivots, up to equal bits
        spot = (self.all.astype(np.uint32) * np.uint32(2654435761)) >> np.uint32(24)
        row = np.arange(len(t))
        for c in range(COUNTED):
            self.map[row, spot[:, c] >> 6] |= np.uint64(1) << (spot[:, c].astype(np.uint64) & np.uint64(63))
        self.lost = COUNTED - np.bitwise_count(self.map).sum(1)  # pivots that share a bit with another one

    def enough(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether pairs of rows share as many of their pivots as candidates do."""
        out = np.zeros(len(a), bool)
        for s in range(0, len(a), 8192):
            x, y = self.all[a[s : s + 8192]], self.all[b[s : s + 8192]]
            out[s : s + 8192] = (x[:, :, None] == y[:, None, :]).any(2).sum(1) >= self.least
        return out

    def small(self, a: np.ndarray, b: np.ndarray, p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of pairs of rows that meet in the lists (p, q), p < q, the candidates that count there."""
        able = (np.bitwise_count(self.map[a] & self.map[b]).sum(1) + np.minimum(self.lost[a], self.lost[b]) >= self.least) & (self.ids[a] != self.ids[b])
        a, b, p, q = a[able], b[able], p[able], q[able]
        able = self.enough(a, b)
        a, b, p, q = a[able], b[able], p[able], q[able]
        shared = (self.top[a][:, :, None] == self.top[b][:, None, :]).any(2)
        able = (shared & (self.top[a] < q[:, None]) & (self.top[a] != p[:, None])).sum(1) == 0
        return a[able], b[able]

    def large(self, left: np.ndarray, right: np.ndarray, p: int, q: int, within: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(rows, rows, mask of candidates) of the list (p, q), stripe by stripe; p < 0: all pairs are candidates."""
        if p >= 0:
            used = np.unique(self.top[left][(self.top[left] < q) & (self.top[left] != p)])
            flags = lambda rows: (self.top[rows][:, :, None] == used[None, None, :]).any(1).astype(np.float32)
            # common smaller pivots give the pair to an earlier list
            lower = np.concatenate([flags(right[s : s + STRIPE]) for s in range(0, len(right), STRIPE)]) if len(used) else None
        for s in range(0, len(left), STRIPE):
            rows = left[s : s + STRIPE]
            mask = self.ids[rows][:, None] != self.ids[right][None]
            if within:
                mask &= np.arange(s, s + len(rows))[:, None] < np.arange(len(right))[None]
            if p >= 0:
                count = np.minimum(self.lost[rows][:, None], self.lost[right][None]).astype(np.uint8)
                for w in range(4):
                    count += np.bitwise_count(self.map[rows, w][:, None] & self.map[right, w][None])
                mask &= count >= self.least
                if lower is not None:
                    mask &= flags(rows) @ lower.T == 0
                # what equal bits alone may have brought above the limit is counted itself
                x, y = np.nonzero(mask & (count < self.least + 10))
                mask[x, y] = self.enough(rows[x], right[y])
            yield rows, right, mask

    def candidates(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray | None]]:
        """(a, b, None): pairs of rows, or (rows, rows, mask of the pairs)."""
        cold = np.flatnonzero((self.key < 0) & (self.key > _LENGTH))
        if len(cold):
            yield from self.in_cells(cold)
        hot = np.flatnonzero((self.key >= 0) | (self.key <= _LENGTH))
        order = hot[np.lexsort((self.j[hot], self.i[hot], self.key[hot]))]
        edge = np.flatnonzero((np.diff(self.key[order]) != 0) | (np.diff(self.i[order]) != 0) | (np.diff(self.j[order]) != 0)) + 1
        for rows in np.split(order, edge) if len(order) else ():
            key, i, j = self.key[rows[0]], self.i[rows[0]], self.j[rows[0]]
            left, right = rows[self.block[rows] == i], rows[self.block[rows] == j]
            p, q = (int(key) // _PAIR, int(key) % _PAIR) if key >= 0 else (-1, -1)
            yield from self.large(left, right, p, q, bool(i == j))

    def in_cells(self, rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray | None]]:
        """Candidates of the lists that the cells of single pivots hold: with each crowded pivot, and each larger other one."""
        own, top = -1 - self.key[rows], self.top[rows].astype(np.int64)
        full = self.crowded[np.minimum(top, len(self.crowded) - 1)]
        x, c = np.nonzero((top != own[:, None]) & (full | (top > own[:, None])))
        name = own[x] * _PAIR + top[x, c]
        order = np.argsort(name, kind="stable")
        at, name = rows[x][order], name[order]
        cut = np.flatnonzero(np.r_[True, np.diff(name) != 0, True])
        size = np.diff(cut)
        for g in np.flatnonzero(size > STRIPE):
            part, both = at[cut[g] : cut[g + 1]], (int(name[cut[g]]) // _PAIR, int(name[cut[g]]) % _PAIR)
            yield from self.large(part, part, min(both), max(both), True)
        group = np.repeat(np.arange(len(size)), size)
        ahead = np.where(size[group] > STRIPE, 0, cut[group + 1] - np.arange(len(at)) - 1)
        total = np.concatenate([[0], np.cumsum(ahead)])
        s = 0
        while s < len(at):
            e = max(s + 1, int(np.searchsorted(total, total[s] + (1 << 18), "right")) - 1)
            k = ahead[s:e]
            first = np.repeat(np.arange(s, e), k)
            second = first + 1 + np.arange(len(first)) - np.repeat(np.cumsum(k) - k, k)
            p, q = name[first] // _PAIR, name[first] % _PAIR
            yield *self.small(at[first], at[second], np.minimum(p, q), np.maximum(p, q)), None
            s = e


def with_candidates(members: Members) -> np.ndarray:
    """Rows that are in a candidate pair."""
    some = np.zeros(len(members.ids), bool)
    for a, b, mask in members.candidates():
        some[a if mask is None else a[mask.any(1)]] = True
        some[b if mask is None else b[mask.any(0)]] = True
    return np.flatnonzero(some)


def joined(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The forest with the edges added: the root of each row is the smallest row reachable."""
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return root
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]


def linked(members: Members, x: dict[int, np.ndarray], where: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(links, root) of the rows. x: unit vectors by their size in bytes; where: (size, place there) of each row."""
    links, root = np.zeros(len(members.ids), np.int64), np.arange(len(members.ids))
    for a, b, mask in members.candidates():
        if not len(a) or not len(b):
            continue
        vectors = x[int(where[a[0], 0])]
        if mask is None:
            for_pair = max(256, (1 << 22) // vectors.shape[1])
            near = np.zeros(len(a), bool)
            for s in np.unique(where[a, 0]):
                at = np.flatnonzero(where[a, 0] == s)
                for e in range(0, len(at), for_pair):
                    k = at[e : e + for_pair]
                    near[k] = np.einsum("ij,ij->i", x[int(s)][where[a[k], 1]], x[int(s)][where[b[k], 1]]) >= THRESHOLD
            a, b = a[near], b[near]
        else:
            u, v = np.nonzero(mask & (vectors[where[a, 1]] @ vectors[where[b, 1]].T >= THRESHOLD))
            a, b = a[u], b[v]
        np.add.at(links, a, members.n[b])
        np.add.at(links, b, members.n[a])
        root = joined(root, a, b)
    return links, root


def near_duplicates(vectors: DataFrame, stage: Stage) -> DataFrame:
    """(vec_id, n_links, component_id, kept), a row for each row of vectors (vec_id, embedding)."""
    kind = kind_of(vectors)
    rows = stage.put(packed(vectors), "packed")
    usable = rows.filter(F.col("digest").isNotNull())
    pivots = pivots_of(usable, kind)
    k, least = pivots.named, pivots.least
    near = usable.select("vec_id", "digest", permutation(pivots, kind)("vector").alias("permutation"), F.octet_length("vector").alias("bytes"))
    classes = near.groupBy("digest").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("n"), F.first("permutation").alias("permutation"), F.first("bytes").alias("bytes"))
    classes = stage.put(classes, "classes")

    @F.arrow_udf("array<int>")
    def top(permutation: pa.Array) -> pa.Array:
        return pa.array([np.frombuffer(x, "<u2")[:k].tolist() for x in permutation.to_pylist()], pa.list_(pa.int32()))

    ordered = classes.filter(F.col("permutation").isNotNull())
    sizes = ordered.select(F.explode(top("permutation")).alias("p")).groupBy("p").count().collect()  # a row a pivot
    crowded = np.zeros(pivots.total + 1, bool)
    limit = max(CROWDED, 2 * sum(r["count"] for r in sizes) / max(1, len(sizes)))
    for r in sizes:
        crowded[min(r["p"], pivots.total)] = r["count"] > limit  # the last place is for missing pivots
    listed = ordered.select("id", "n", "permutation", lists_of(crowded, k)("permutation").alias("in"))
    zero = [F.lit(0).alias(c) for c in ("block", "i", "j")]
    cold = listed.select("id", "n", "permutation", F.explode("in.cells").alias("p")).select("id", (F.lit(-1) - F.col("p")).cast("long").alias("key"), *zero, "n", "permutation")
    pairs = listed.select("id", F.explode("in.pairs").alias("key"))
    whole = classes.filter(F.col("permutation").isNull()).select("id", (F.lit(_LENGTH) - F.col("bytes")).alias("key"))
    hot = stage.put(pairs.unionByName(whole), "hot-lists")
    large = hot.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > BLOCK)
    parts = F.coalesce(F.ceil(F.col("size") / BLOCK), F.lit(1)).cast("int")
    cells = key_join(hot, stage.put(large, "large"), "key", stage, "id").select("id", "key", parts.alias("parts"))
    block = F.pmod(F.xxhash64("id"), F.col("parts").cast("long")).cast("int")
    cells = cells.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    cells = stage.put(cells.select("id", "key", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")), "hot-cells")
    bins = max(partitions(stage.spark), (sum(r["count"] for r in sizes) + cells.count()) // ENTRIES)
    entry = ["key", "i", "j", "block"]
    known = classes.select("id", "digest", "n", "permutation")
    entries = cold.unionByName(cells.join(known.drop("digest"), "id"))

    def binned(entries: DataFrame) -> DataFrame:
        return entries.withColumn("bin", F.pmod(F.xxhash64("key", "i", "j"), F.lit(bins))).groupBy("bin")

    def choose(t: pa.Table) -> pa.Table:
        return t.select([*entry, "id"]).take(pa.array(with_candidates(Members(t, crowded, k, least))))

    def link(t: pa.Table) -> pa.Table:
        m = Members(t, crowded, k, least)
        raw = t.column("vector").to_pylist()
        size = np.array([len(v) for v in raw])
        x, where = {}, np.stack([size, np.zeros_like(size)], 1)
        for s in np.unique(size):
            at = np.flatnonzero(size == s)
            x[int(s)] = unit([raw[i] for i in at], kind)
            where[at, 1] = np.arange(len(at))
        links, root = linked(m, x, where)
        some = np.flatnonzero(links)
        return pa.table({"id": m.ids[some], "links": links[some], "root": m.ids[root[some]]})

    chosen = binned(entries).applyInArrow(choose, "key long, i int, j int, block int, id long")
    chosen = stage.put(chosen.distinct(), "chosen")
    ids = stage.put(chosen.select("id").distinct(), "ids")
    met = maybe_in(rows, "vec_id", ids).filter("_maybe").drop("_maybe").withColumnRenamed("vec_id", "id")
    met = met.join(ids, "id", "left_semi").dropDuplicates(["id", "digest"])
    full = chosen.join(known.join(met, ["id", "digest"]).drop("digest"), "id")
    found = stage.put(binned(full).applyInArrow(link, "id long, links long, root long"), "found")
    tied = components(found.filter("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b")), stage)
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    one = classes.select("digest", "id", "n").join(counts, "id", "left").join(tied, "id", "left")
    one = one.select("digest", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    one = stage.put(one, "named")
    stage.clear(rows, one)
    out = key_join(rows.select("vec_id", "digest"), one, "digest", stage, "vec_id")
    component: Column = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def op4_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), Stage(spark))
