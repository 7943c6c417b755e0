"""Hard negatives against brute force."""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from arclattice.llm import negatives
from arclattice.llm.common import Stage


def plain(rows, anchor, scale=256, k=5, m=3):
    """rows: (vec_id, vector, label), each taken once."""
    good = []
    for r in dict.fromkeys((i, None if v is None else tuple(v), c) for i, v, c in rows):
        i, v, c = r
        if i is not None and c is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            good.append((i, [int(np.floor(scale * x)) for x in v], c))
    by = defaultdict(list)
    for i, v, c in good:
        by[len(v)].append((i, v, c))
    out = Counter()
    for n, group in by.items():
        ids, labels, x = np.array([g[0] for g in group]), np.array([g[2] for g in group]), np.array([g[1] for g in group], np.int64).reshape(len(group), n)
        for a in range(len(group)):
            if not anchor(ids[a]):
                continue
            s = x @ x[a]
            order = np.lexsort((ids, -s))
            same = [j for j in order if labels[j] == labels[a] and ids[j] != ids[a]][:k]
            others = [j for j in order if labels[j] != labels[a] and ids[j] != ids[a]]
            for j in same:
                inside = [o for o in others if 50 * s[j] <= 100 * s[o] <= 95 * s[j]][:m]
                out.update((int(ids[a]), int(ids[j]), rank, int(ids[o]), int(s[j]), int(s[o])) for rank, o in enumerate(inside, 1))
    return out


NAMES = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def found(spark, rows, every=10, **more):
    df = spark.createDataFrame([(*r, 1, "a") for r in rows], "vec_id long, embedding array<double>, label int, score int, x string").repartition(3)
    return Counter(tuple(r[n] for n in NAMES) for r in negatives.hard_negatives(df, F.col("vec_id") % every == 0, Stage(spark), **more).collect())


def clusters(rng, n, d=12):
    centres = rng.normal(size=(6, d))
    return [(i, (centres[i % 6] + 0.6 * rng.normal(size=d)).tolist(), int(rng.integers(4))) for i in range(n)]


@pytest.mark.parametrize("small", [False, True])
def test_awkward_rows(spark, monkeypatch, small):
    if small:  # so that labels and cells are split, anchors come in blocks and trees are deep
        for name, value in (("CELL", 40), ("ANCHORS", 5), ("LEAF", 6), ("FEW", 8)):
            monkeypatch.setattr(negatives, name, value)
    rng = np.random.default_rng(4)
    rows = clusters(rng, 400)
    hot = rows[7][1]
    rows += [(400 + i, hot, i % 2) for i in range(200)]  # a third of all are equal
    rows += [rows[20], rows[20], (30, rows[31][1], 1), (600, None, 1), (610, [float("nan")] + [1.0] * 11, 1), (620, [None] + [1.0] * 11, 1), (630, hot, None), (None, hot, 1)]
    rows += [(700 + i, [float(c) for c in rng.normal(size=2)], i % 2) for i in range(30)] + [(740, [], 1), (750, [], 1), (760, [], 2), (770, [0.0] * 12, 2), (780, [3e9, *[-1e9] * 11], 1)]
    rows += [(800 + i, rng.normal(size=3).tolist(), 1000 + i) for i in range(20)]  # labels of their own
    held = [(i, None if v is None else [x if x is None else float(np.clip(x, -(1 << 16), 1 << 16)) for x in v], c) for i, v, c in rows]
    assert found(spark, rows) == plain(held, lambda i: i % 10 == 0)


def test_ties_and_other_windows(spark):
    rows = [(i, [1.0, float(i % 3)], i % 2) for i in range(60)]
    assert found(spark, rows) == plain(rows, lambda i: i % 10 == 0)
    assert found(spark, rows, every=1, n_positives=2, n_negatives=7) == plain(rows, lambda i: True, k=2, m=7)


def test_empty_tables_and_no_anchors(spark):
    assert not found(spark, []) and not found(spark, [(1, [1.0], 1), (2, [1.0], 2)]) and not found(spark, [(10, [1.0], 1)])


@pytest.mark.parametrize("leaf", [1, 5, 300])
def test_walks_leave_nothing_out(leaf):
    rng = np.random.default_rng(8)
    x = np.floor(256 * rng.normal(size=(300, 3))).astype(float)
    ids, labels = rng.permutation(300), rng.integers(0, 3, 300)
    most = float((x * x).sum(1).max()) ** 0.5
    tree = negatives.Tree(x, labels, most, leaf)
    assert sorted(np.concatenate([n.rows for n in tree.nodes if not n.children]).tolist()) == list(range(300))
    d = tree.to_vantages(negatives.turned(x))
    for a in range(300):
        s = (x @ x[a]).astype(int)
        low, high = sorted(rng.choice(s, 2).tolist())
        w = negatives.Walker(tree, ids, labels, x[a], int(ids[a]), int(labels[a]), d[a], same=False)
        want = sorted((-int(s[j]), int(ids[j])) for j in range(300) if labels[j] != labels[a] and low <= s[j] <= high)
        assert w.first(3, low, high) == want[:3]


def test_walks_leave_out_what_is_far():
    rng = np.random.default_rng(5)
    x = np.floor(256 * (np.repeat(rng.normal(size=(40, 3)), 50, 0) + 0.02 * rng.normal(size=(2000, 3))))
    ids, labels = np.arange(2000), rng.integers(0, 3, 2000)
    tree = negatives.Tree(x, labels, float((x * x).sum(1).max()) ** 0.5, 40)
    d = tree.to_vantages(negatives.turned(x))
    leaves = sum(not n.children for n in tree.nodes)
    for same in (True, False):
        seen = 0
        for a in range(0, 2000, 20):
            w = negatives.Walker(tree, ids, labels, x[a], a, int(labels[a]), d[a], same)
            own = int(x[a] @ x[a])
            w.first(5) if same else w.first(3, own // 2, own * 95 // 100)
            seen += len(w.seen)
        assert seen < 0.6 * 100 * leaves, (same, seen / 100 / leaves)


def test_cells_hold_every_row_and_are_met(spark):
    rng = np.random.default_rng(2)
    x = np.floor(256 * rng.normal(size=(900, 4))).astype("<i4")
    raw = [v.tobytes() for v in x]
    most = float((x.astype(float) ** 2).sum(1).max()) ** 0.5
    cells = negatives.Cells(raw[:200], 10, most)
    own = cells.of_rows(raw)
    assert len(set(own)) >= 8 and None not in own
    q = raw[:50]
    s = x[:50].astype(np.int64) @ x.T.astype(np.int64)
    low, high = np.quantile(s, 0.9, axis=1).astype(np.int64), np.quantile(s, 0.99, axis=1).astype(np.int64)
    met = cells.met_by(q, low, high)
    for a in range(50):
        assert {own[j] for j in np.flatnonzero((s[a] >= low[a]) & (s[a] <= high[a]))} <= set(met[a])
    assert sum(map(len, met)) < 0.9 * 50 * len(set(own))


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.1"])
def test_query(spark, sf):
    rows = [(r.vec_id, r.embedding, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = Counter(tuple(r[n] for n in NAMES) for r in negatives.op12_negatives(spark, sf).collect())
    assert got == plain(rows, lambda i: i % 50 == 0) and got
