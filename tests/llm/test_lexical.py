"""Lexical search against a plain version and against SQL."""

from __future__ import annotations

import random
import re
from collections import Counter
from math import floor, log

import duckdb
import numpy as np
import pytest

from arclattice.llm import lexical
from arclattice.llm.common import Stage
from test_operators import DOCS, awkward, prose

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, top=20):
    """item number to its (doc_id, score), highest first; docs and items: (id, text)."""
    held = [(i, Counter(terms(t))) for i, t in docs]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    n, words = len(held), sum(k for _, _, k in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = {}
    for item, (_, text) in enumerate(items):
        want, rows = Counter(terms(text)), []
        for i, c, k in held:
            m = 75 + 25 * k * n // words
            score = sum(r * floor(1000 * log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m)) for t, r in want.items() if t in c)
            if score > 0:
                rows.append((i, score))
        out[item] = sorted(rows, key=lambda r: (-r[1], r[0] is None, r[0] or 0))[:top]
    return out


def found(out):
    got = {}
    for r in sorted(out, key=lambda r: (r.item_id, r["rank"])):
        got.setdefault(r.item_id, []).append((r.doc_id, r.score))
        assert r["rank"] == len(got[r.item_id])
    return got


def test_awkward_rows(spark, monkeypatch):
    rows = awkward()
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    rng = random.Random(1)
    texts = [rows[0][1], rows[0][1].upper() + " zz", "é" * 40 + " ÉÉ one One ONE", None, "", "...", "nowhere-to-be-found", prose(rng, 40), "a", "y-1"]
    items = spark.createDataFrame([(i, t, 1.0, "x") for i, t in enumerate(texts)] + [(0, texts[0], 1.0, "y")], "item_id long, text string, score double, doc_id string")
    want = plain([r[:2] for r in rows], list(enumerate(texts)))
    for triples, posts in ((lexical.TRIPLES, lexical.POSTINGS), (50, 20)):
        monkeypatch.setattr(lexical, "TRIPLES", triples)
        monkeypatch.setattr(lexical, "POSTINGS", posts)
        got = found(lexical.search(docs, items, Stage(spark)).collect())
        assert got == {i: w for i, w in want.items() if w}
    assert lexical.search(spark.createDataFrame([], DOCS), items, Stage(spark)).count() == 0
    assert lexical.search(docs, items.limit(0), Stage(spark)).count() == 0


def test_ties_go_by_id_and_ranges_meet(spark, monkeypatch):
    monkeypatch.setattr(lexical, "WINNERS", 10)
    rows = [(i, "same words here" if i % 3 else "other things") for i in range(400)] + [(None, "same words here")] * 3
    items = spark.createDataFrame([(7, "same here here"), (8, "things")], "item_id long, text string")
    got = found(lexical.search(spark.createDataFrame(rows, "doc_id long, text string").repartition(9), items, Stage(spark)).collect())
    assert [i for i, _ in got[7]] == [i for i in range(400) if i % 3][:20]
    assert [i for i, _ in got[8]] == list(range(0, 60, 3))


def test_an_item_may_repeat_an_id(spark):
    items = spark.createDataFrame([(1, "red"), (1, "blue"), (None, "red")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "red sky"), (2, "blue sky"), (3, "green")], "doc_id long, text string")
    out = lexical.search(docs, items, Stage(spark)).collect()
    assert sorted((r.item_id or 0, r["rank"], r.doc_id) for r in out) == [(0, 1, 1), (1, 1, 1), (1, 1, 2)]


def test_lengths_beyond_64_bits():
    n = np.array([1 << 40, 3], np.int64)
    docs, words = 1 << 30, 1 << 60
    got = lexical.impacts(np.array([5, 1]), n, np.array([10, 1000]), docs, words)
    assert got.tolist() == [w * (10**9 * t // (1000 * t + 12 * (75 + 25 * int(k) * docs // words))) for w, t, k in ((10, 5, n[0]), (1000, 1, n[1]))]


def test_radix_order():
    rng = np.random.default_rng(2)
    for bits in (5, 16, 17, 33, 50):
        keys = rng.integers(0, 1 << bits, 3000)
        assert np.array_equal(lexical.radix_order(keys, bits), np.argsort(keys, kind="stable"))


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_query_against_sql(spark, sf):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    ours = lexical.op11_lexical(spark, sf).select("item_id", "rank", "doc_id", "score").collect()
    assert sorted(map(tuple, ours)) == sorted(con.execute(f"SELECT item_id, rank, doc_id, score FROM ({lexical.OP11_SQL})").fetchall())
