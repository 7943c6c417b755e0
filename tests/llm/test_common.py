from __future__ import annotations

import random

import brute
import pyarrow as pa
from pyspark.sql import functions as F

from arclattice.llm import textscan
from arclattice.llm.common import Stage, components, key_join, maybe_in, running_total


def test_words_are_those_of_the_pattern(monkeypatch):
    texts = ["Ab cd\tE\x0bF\x0cG", "", None, " cd  AB\n", "é É x", "a" * 50, "b " * 30, " ", "  Z"]
    for size in (16, 1 << 19):
        monkeypatch.setattr(textscan, "SLICE", size)
        hashes, at = textscan.words(pa.array(texts))
        assert [int(b - a) for a, b in zip(at[:-1], at[1:], strict=True)] == [len(brute.words(t)) for t in texts]
        assert textscan.word_counts(pa.array(texts)).tolist() == [len(brute.words(t)) for t in texts]
        names = {}
        for i, t in enumerate(texts):
            for w, h in zip(brute.words(t), hashes[at[i] : at[i + 1]].tolist(), strict=True):
                assert names.setdefault(w, h) == h
        assert len(set(names.values())) == len(names)
    assert textscan.head(" a  bé c ", 2) == " a  bé" and textscan.head("a b", 9) == "a b" and textscan.head("a", 0) == ""


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 6000 + i) for i in range(200)] + [(7, 7)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), Stage(spark)).collect()}
    assert got == brute.components({x for e in edges for x in e}, edges)
    assert components(spark.createDataFrame([], "a long, b long"), Stage(spark)).count() == 0


def test_key_join_with_hot_and_null_keys(spark):
    left = [(i, "hot" if i % 2 else None if i % 3 == 0 else f"k{i}") for i in range(3000)]
    right = [("hot", 1), *[(f"k{i}", i) for i in range(0, 3000, 4)], ("none", 5)]
    want = {i: dict(right).get(k) for i, k in left}
    got = key_join(spark.createDataFrame(left, "id long, k string"), spark.createDataFrame(right, "k string, v long"), "k", Stage(spark), "id").collect()
    assert len(got) == 3000 and {r.id: r.v for r in got} == want


def test_running_total_and_filter(spark):
    rows = [(g, i % 7, i, i % 5) for g in ("a", None) for i in range(100)]
    out = running_total(spark.createDataFrame(rows, "g string, run long, o long, v long"), ["g"], ["run", "o"], "v", "t", Stage(spark), 200).collect()
    for g in ("a", None):
        total = 0
        for r in sorted((r for r in out if r.g == g), key=lambda r: (r.run, r.o)):
            assert r.t == total
            total += r.v
    ids = spark.range(0, 1000, 3)
    got = maybe_in(spark.range(1000).withColumn("x", F.col("id")), "x", ids).collect()
    assert all(r._maybe for r in got if r.id % 3 == 0) and sum(r._maybe for r in got) < 350
