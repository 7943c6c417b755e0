"""Harmonic packing against the rules it states."""

from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from arclattice.llm import harmonic
from test_operators import DOCS, awkward, prose

SF = "/root/testdata/sf0.001"


def plain_bins(sizes, capacity):
    """The members of the bins: class by class, k after k, as many bins as the ids fill."""
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    by = defaultdict(list)
    for i in order:
        by[capacity // sizes[i]].append(i)
    bins = [c[j : j + k] for k, c in sorted(by.items()) for j in range(0, len(c) - k + 1, k)]
    return bins[: sum(sizes) // capacity]


def check(sizes, capacity, found):
    """Every id in one place, sequences without holes; lengths of the sequences."""
    parts, places = defaultdict(list), defaultdict(list)
    for i, s, n, q, o in zip(found.item, found.start, found.length, found.sequence, found.offset, strict=True):
        parts[int(i)].append((int(s), int(n)))
        places[int(q)].append((int(o), int(n), int(i)))
    assert sorted(parts) == list(range(len(sizes)))
    for i, p in parts.items():
        at = 0
        for s, n in sorted(p):
            assert s == at and n > 0
            at += n
        assert at == sizes[i]
    lengths = {}
    for q, p in places.items():
        at = 0
        for o, n, _ in sorted(p):
            assert o == at
            at += n
        lengths[q] = at
    assert sorted(lengths) == list(range(found.sequences))
    return places, lengths


@settings(max_examples=300, deadline=None)
@given(st.sampled_from([8, 64, 1024]), st.data())
def test_places(capacity, data):
    sizes = data.draw(st.lists(st.integers(1, capacity), max_size=60))
    found = harmonic.harmonic(np.array(sizes, np.int64), capacity)
    places, lengths = check(sizes, capacity, found)
    assert all(n == capacity or n & (n - 1) == 0 for n in lengths.values())
    bins = plain_bins(sizes, capacity)
    for q, want in enumerate(bins):
        first = sorted(places[q])[: len(want)]
        assert [i for _, _, i in first] == want and all(n == sizes[i] for _, n, i in first)
        assert lengths[q] == capacity
    assert sum(n < capacity for n in lengths.values()) <= capacity.bit_length()


def test_few_items_are_cut():
    rng = np.random.default_rng(3)
    sizes = np.minimum(rng.lognormal(5, 1, 20_000).astype(np.int64) + 1, 1023)
    found = harmonic.harmonic(sizes, 1024)
    _, lengths = check(sizes.tolist(), 1024, found)
    # at most one cut a bin, and no padding
    assert len(found.item) <= len(sizes) + len(lengths) and sum(lengths.values()) == sizes.sum()


def test_pieces(spark, monkeypatch):
    rows = awkward()
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    encode = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter((r[0], tuple([*encode.encode(r[1] or "", add_special_tokens=False).ids, 0])) for r in rows)
    for group in (harmonic.GROUP, 7):
        monkeypatch.setattr(harmonic, "GROUP", group)
        out = harmonic.pieces(docs).collect()
        seqs, texts = defaultdict(list), Counter()
        for r in out:
            seqs[r.sequence_id].append((r.offset, r.length))
            assert len(r.ids) == 4 * r.length
        for s in seqs.values():
            at = 0
            for o, n in sorted(s):
                assert o == at
                at += n
            assert at == 1024 or at & (at - 1) == 0
        # rows with the same doc_id hold the same ids twice here, so pieces are matched by document and start
        by = defaultdict(list)
        for r in out:
            by[r.doc_id, r.doc_tokens].append((r.start, np.frombuffer(bytes(r.ids), "<u4").tolist()))
        for (doc, n), p in by.items():
            ids = [w for w in want if w[0] == doc and len(w[1]) == n]
            copies = sum(want[w] for w in ids)
            assert sum(len(x) for _, x in p) == n * copies
            assert all(any(list(w[1][s : s + len(x)]) == x for w in ids) for s, x in p)
            texts[doc] += copies
        assert texts == Counter(r[0] for r in rows)
    assert harmonic.pieces(spark.createDataFrame([], DOCS)).count() == 0
    joined = harmonic.sequences(harmonic.pieces(docs)).collect()
    assert all(len(r.ids) == 4 * r.length and (r.length == 1024 or r.length & (r.length - 1) == 0) for r in joined)


def test_a_very_long_document_leaves_only_its_remainder(spark):
    rng = random.Random(1)
    text = prose(rng, 200_000)
    out = harmonic.pieces(spark.createDataFrame([(1, text), (2, "short")], "doc_id long, text string").coalesce(1)).collect()
    whole = [r for r in out if r.length == 1024 and r.offset == 0 and r.doc_id == 1]
    assert len(whole) == out[0].doc_tokens // 1024 and sum(r.length for r in out if r.doc_id == 1) == out[0].doc_tokens


@pytest.mark.parametrize("sf", [SF])
def test_query(spark, sf):
    out = harmonic.op13_harmonic(spark, sf).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    encode = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    by, seqs = defaultdict(list), Counter()
    for r in out:
        by[r.doc_id].append(r)
        seqs[r.sequence_id] += r.length
    assert set(by) == set(docs)
    for i, t in docs.items():
        ids = np.array([*encode.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for r in sorted(by[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    assert all(n <= 1024 and (n == 1024 or n & (n - 1) == 0) for n in seqs.values())
