"""Operators against plain versions, on awkward rows: nulls, empty and long texts, ties, repeats, extra columns."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter

import brute
import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from arclattice.llm import fingerprints, mixing, neardup, packing, quality, sharding, toxicity, urlfilter, vectors
from arclattice.llm.common import Stage

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, score double, shard int, component string, digest string, rank long, key string, _id long"


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


def awkward():
    rng = random.Random(8)
    base = prose(rng, 120)
    near = base.split()
    texts = {0: base, 1: base, 2: " ".join([*near[:60], "new", *near[61:]]), 3: base.upper(), 4: "", 5: None, 6: "one", 7: "One ", 8: "a b c d", 9: "   \n", 10: "é" * 40, 11: prose(rng, 30_000), 12: prose(rng, 3), 13: base + " " + base, 14: "<|endoftext|> x", 15: " " * 5000 + "y"}
    rows = [(i, t, None if i % 4 == 0 else "en", [None, "b", "a", "ä"][i % 4], None if t is None else len(t)) for i, t in texts.items()]
    rows += [(16 + i, prose(rng, rng.randint(1, 300)), "en", "hot", 0) for i in range(60)]
    rows += [rows[0], rows[12], (None, base, None, None, 1), (None, None, None, "a", None)]
    return [(*r, 1, 0.5, 3, "c", "d", 4, "k", 9) for r in rows]


@pytest.fixture(scope="module")
def rows():
    return awkward()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, i % 3 == 0 and 1 or 0) for i in range(80)] + [(1, None, None), (2, 1, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")


def same_shards(text="text"):
    return F.when(F.length(text) > 0, F.array(F.unhex(F.sha2(text, 256)))).otherwise(F.array().cast("array<binary>"))


def test_sharding(spark, docs, none, rows):
    out = sharding.sharded(docs, same_shards(), 4, Stage(spark)).collect()
    size = lambda t: len((t or "").encode()) + 1
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in out) == Counter((r[0], size(r[1]), zlib.crc32((r[1] or "").encode())) for r in rows)
    for s in {r.shard for r in out}:
        slots = sorted(r.slot for r in out if r.shard == s)
        assert slots == list(range(len(slots)))
    assert sharding.sharded(none, same_shards(), 4, Stage(spark)).count() == 0


def test_sharding_keeps_groups_and_sizes_even(spark):
    rng = random.Random(2)
    many = [(i, f"group {i % 40} " * 5 if i < 400 else prose(rng, rng.randint(5, 60))) for i in range(2400)]
    out = sharding.sharded(spark.createDataFrame(many, "doc_id long, text string"), same_shards(), 8, Stage(spark)).collect()
    load = Counter()
    for r in out:
        load[r.shard] += r.size
    mean = sum(load.values()) / 8
    assert len(load) == 8 and all(abs(v - mean) < 600 for v in load.values())
    where = {r.doc_id: r.shard for r in out}
    assert sum(len({where[i] for i in range(g, 400, 40)}) > 1 for g in range(40)) <= 2


def test_shards_do_not_depend_on_the_files(spark, docs):
    place = lambda df: Counter((r.doc_id, r.text_crc32, r.shard) for r in sharding.sharded(df, same_shards(), 4, Stage(spark)).collect())
    assert place(docs) == place(docs.repartition(7, "text")) == place(docs.coalesce(1))


def test_sharding_cuts_few_edges(spark):
    """Documents with several links: against the cut of dealing by hash, and a plain count of it."""
    rng = random.Random(5)
    # 60 communities of 30; each document has two hubs of its own community and now and then one of another
    hubs = lambda i: [f"{i // 30}-{rng.randint(0, 3)}".encode() for _ in range(2)] + ([f"{rng.randint(0, 59)}-0".encode()] if rng.random() < 0.05 else [])
    rows = [(i, prose(rng, rng.randint(20, 60)), [bytearray(h) for h in sorted(set(hubs(i)))]) for i in range(1800)]
    out = sharding.sharded(spark.createDataFrame(rows, "doc_id long, text string, h array<binary>"), F.col("h"), 6, Stage(spark), rounds=5).collect()
    shard = {r.doc_id: r.shard for r in out}

    def cut(where):
        members = {}
        for i, _, h in rows:
            for x in h:
                members.setdefault(bytes(x), []).append(where(i))
        return sum(len(m) - max(Counter(m).values()) for m in members.values())

    load = Counter()
    for r in out:
        load[r.shard] += r.size
    assert max(load.values()) - min(load.values()) < 0.05 * sum(load.values()) / 6
    assert cut(shard.get) < 0.55 * cut(lambda i: hash((i, 3)) % 6)


def plain_places(sizes, capacity):
    """Piece by piece, the bin whose filling makes the sum of the squared counts of open bins per gap smallest; a bin opens where none fits."""
    gaps, where = [], {}
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        def total(b):
            left = Counter(g - sizes[i] if c == b else g for c, g in enumerate(gaps))
            return sum(n * n for g, n in left.items() if g > 0)

        fits = [b for b, g in enumerate(gaps) if g >= sizes[i]]
        if fits:
            best = min(total(b) for b in fits)
            where[i] = {gaps[b] for b in fits if total(b) == best}
            b = min((b for b in fits if total(b) == best), key=lambda b: gaps[b])
        else:
            where[i] = {capacity}
            gaps.append(capacity)
            b = len(gaps) - 1
        where[i] = min(where[i])
        gaps[b] -= sizes[i]
    return [where[i] for i in range(len(sizes))], len(gaps)


def test_sum_of_squares_against_the_plain_rule():
    rng = random.Random(2)
    for capacity, n in ((10, 40), (16, 60), (100, 50)):
        for _ in range(15):
            sizes = [rng.randint(1, capacity) for _ in range(n)]
            bins, offset = packing.sum_of_squares(np.array(sizes), capacity)
            # the gap that each piece found, and the number of bins
            assert plain_places(sizes, capacity) == ([capacity - int(o) for o in offset], len(set(bins.tolist())))


def test_words_and_features_against_a_plain_version():
    import pyarrow as pa

    texts = ["One two, ONE! three_four", "", None, "é ê1 ABCDEFG abcdefg", "a b c d e f g a b c"]
    name, at = toxicity.textscan.words(pa.array(texts), toxicity.textscan.ALNUM)
    stem, _ = toxicity.textscan.words(pa.array(texts), toxicity.textscan.ALNUM, 5)
    word = lambda t: ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in __import__("re").findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t or "")]
    plain = [w for t in texts for w in word(t)]
    assert np.diff(at).tolist() == [len(word(t)) for t in texts]
    for hashes, key in ((name, plain), (stem, [w.encode()[:5] for w in plain])):
        assert [[a == b for b in hashes.tolist()] for a in hashes.tolist()] == [[a == b for b in key] for a in key]
    families = [set() for _ in range(4)]
    for k, (row, x) in enumerate(toxicity.coordinates(pa.array(texts))):
        families[k] |= set(zip(row.tolist(), x.tolist(), strict=True))
    for i, t in enumerate(texts):
        w = word(t)
        want = [len(set(w)), len({v.encode()[:5] for v in w}), len(set(zip(w, w[1:]))), len(set(zip(w, w[2:])))]
        assert [len([1 for r, _ in f if r == i]) for f in families] == want


def plain_chunks(data):
    """Chunks found byte by byte."""
    gear, out, start = fingerprints._GEAR.tolist(), [], 0
    while start < len(data):
        size = 0
        for i in range(start, len(data)):
            size = i - start + 1
            h = sum(gear[data[i - age]] << age for age in range(min(32, i + 1))) % (1 << 32)
            strict, loose = h >> 26 == 0, h >> 29 == 0
            if (fingerprints.LEAST <= size < fingerprints.NORMAL and strict) or (size >= fingerprints.NORMAL and loose) or size == fingerprints.MOST:
                break
        out.append(data[start : start + size])
        start += size
    return out


def plain_digest(chunk):
    top = (1 << 64) - 1
    h = sum((c + 1) * pow(0x9E3779B97F4A7C15, i + 1, 1 << 64) for i, c in enumerate(chunk)) + len(chunk) & top
    h = (h ^ h >> 30) * 0xBF58476D1CE4E5B9 & top
    h = (h ^ h >> 27) * 0x94D049BB133111EB & top
    return (h ^ h >> 31) & ~0xFFFF | len(chunk)


def test_chunks_against_a_plain_version():
    rng = random.Random(11)
    texts = [prose(rng, 300).encode(), b"", b"x", bytes(400), ("é" * 300).encode(), bytes(rng.randrange(256) for _ in range(3000)), b"ab" * 200, prose(rng, 40).encode()]
    found, at = fingerprints.chunks(texts)
    plain = [sorted({plain_digest(c) for c in plain_chunks(t)}) for t in texts]
    for k, want in enumerate(plain):
        assert found[at[k] : at[k + 1]].tolist() == want
    for a in range(len(texts)):
        for b in range(len(texts)):
            weight = lambda x: sum(d & 0xFFFF for d in x)
            x, y = plain[a], plain[b]
            want = weight(set(x) & set(y)) / min(weight(x), weight(y)) if x and y else float(not x and not y)
            assert fingerprints.likeness(found[at[a] : at[a + 1]], found[at[b] : at[b + 1]]) == pytest.approx(want)


def test_every_query_runs(spark):
    from arclattice.llm import queries

    tables = {4: "embeddings", 7: "pages", 8: "pages", 12: None, 6: None, 11: None, 13: None}
    for name, query in queries.queries().items():
        n = int(name[2:].split("_")[0])
        got, of = query(spark, SF).count(), tables.get(n, "documents")
        assert got == spark.read.parquet(f"{SF}/{of}.parquet").count() if of else got > 0, name


def table_of(spark, name):
    return spark.read.parquet(f"{SF.replace('0.001', '0.01')}/{name}.parquet")


def auc(pairs):
    good, bad = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    return sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))


def test_toxicity_on_held_out_rows(spark):
    out = {r.doc_id: r for r in toxicity.op2_toxicity(spark, SF.replace("0.001", "0.01")).collect()}
    truth = {r.doc_id: r.toxic for r in table_of(spark, "labels").collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and r.predicted == (r.score >= 0.3) for i, r in out.items())
    held = [(out[i].score, y) for i, y in truth.items() if out[i].held_out]
    assert auc(held) > 0.85
    assert sum(s >= 0.3 and not y for s, y in held) <= 2


def test_quality_on_held_out_rows(spark):
    out = {r.doc_id: r for r in quality.op10_quality(spark, SF.replace("0.001", "0.01")).collect()}
    truth = {r.doc_id: r.quality for r in table_of(spark, "labels").collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and r.predicted == (r.score >= 0.5) for i, r in out.items())
    held = [(out[i].score, y) for i, y in truth.items() if out[i].held_out]
    assert auc(held) > 0.97 and sum((s >= 0.5) == bool(y) for s, y in held) / len(held) > 0.95


def test_scores_of_awkward_rows(spark, docs, none, labels, rows):
    for module, p in ((toxicity, toxicity.Params(epochs=1)), (quality, quality.Params(steps=5))):
        out = module.score(docs, labels, p).collect()
        assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out) and set(out[0].asDict()) == set(docs.columns)
        by = {}
        for r in out:
            assert by.setdefault(r.text or "", r.score) == r.score
        assert module.score(none, labels, p).count() == 0
        assert {r.score for r in module.score(docs, labels.limit(0), p).collect()} == {0.5}


def test_a_score_does_not_depend_on_its_batch():
    import pyarrow as pa

    rng, w = random.Random(7), quality.start(np.random.default_rng(3))
    t, dense = quality.tables(w), np.random.default_rng(2).normal(size=1 << toxicity.BITS).astype(np.float32)
    model = toxicity.Model(np.zeros(0, np.int32), np.zeros(0, np.float32), 0.1)
    for text in ("One ", "", prose(rng, 300)):
        seen = {"quality": set(), "toxicity": set()}
        for size in range(1, 41):
            others = [prose(rng, rng.randint(1, 30)) for _ in range(size)]
            for at in {0, size // 2, size - 1}:
                batch = pa.array([*others[:at], text, *others[at + 1 :]])
                seen["quality"].add(quality.predict(batch, w, t)[at])
                seen["toxicity"].add(toxicity.predict(batch, model, dense)[at])
        assert all(len(v) == 1 for v in seen.values())


def test_training_sample_is_bounded(spark):
    rows = [(1, f"text {i % 7}") for i in range(100_000)] + [(2, "b" * 50), (3, "c" * 5000), (4, None), (5, "e" * 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 9)], "doc_id long, label int")
    out = toxicity.labelled_sample(docs, labels, 8, 200).collect()
    assert sorted(r.doc_id for r in out) == [1, 2, 4, 5] and sum(len(r.text) for r in out) <= 200
    assert len(toxicity.labelled_sample(docs, labels.filter("doc_id < 3"), 1, 1 << 20).collect()) == 1


def plain_ftrl(rows, labels, p):
    """The same rule row by row and coordinate by coordinate, on dictionaries."""
    from math import exp, sqrt

    z, n, zb, nb = {}, {}, 0.0, 0.0

    def weight(i):
        if abs(z.get(i, 0)) <= p.l1:
            return 0.0
        return ((1 if z[i] > 0 else -1) * p.l1 - z[i]) / ((p.beta + sqrt(n[i])) / p.alpha + p.l2)

    rng = np.random.default_rng(p.seed)
    for _ in range(p.epochs):
        for k in rng.permutation(len(rows)):
            x, full = rows[k]
            v = [1.0 if j < full else toxicity.PAIR_VALUE for j in range(len(x))]
            w = [weight(i) for i in x.tolist()]
            b = -zb / ((p.beta + sqrt(nb)) / p.alpha)
            g = 1 / (1 + exp(-sum(a * c for a, c in zip(w, v)) - b)) - labels[k]
            old = {i: (z.get(i, 0.0), n.get(i, 0.0)) for i in x.tolist()}
            for i, a, c in zip(x.tolist(), v, w):
                zi, ni = old[i]
                z[i] = zi + g * a - (sqrt(ni + g * g * a * a) - sqrt(ni)) / p.alpha * c
                n[i] = ni + g * g * a * a
            zb, nb = zb + g - (sqrt(nb + g * g) - sqrt(nb)) / p.alpha * b, nb + g * g
    return {i: weight(i) for i in z if weight(i)}, -zb / ((p.beta + sqrt(nb)) / p.alpha)


def test_ftrl_against_a_plain_version():
    import pyarrow as pa

    rng = random.Random(4)
    texts = [" ".join(rng.choice(["mean", "nasty", "kind", "sun", "day", "tree", "fool"]) for _ in range(rng.randint(1, 12))) for _ in range(60)]
    y = np.array(["nasty" in t or "fool" in t for t in texts], float)
    p = toxicity.Params(l1=0.5, epochs=3)
    rows = toxicity.features(pa.array(texts))
    # a coordinate that is both word and pair counts twice in one update, which the plain version does not model
    rows = [(x, full) for x, full in rows]
    assert all(len(set(x.tolist())) == len(x) for x, _ in rows)
    model = toxicity.train(rows, y, p)
    want, bias = plain_ftrl(rows, y, p)
    assert dict(zip(model.index.tolist(), model.weight.tolist())) == pytest.approx(want, rel=1e-5) and model.bias == pytest.approx(bias)


def test_gradient_of_the_network():
    rng = np.random.default_rng(5)
    w = quality.start(rng)
    w["out"] = rng.normal(0, 0.5, w["out"].shape)
    for text in ("short", "some words that go on " * 40):
        data = np.frombuffer(text.encode(), np.uint8)

        def loss(w):
            t = np.einsum("be,jek->jbk", w["embed"], w["filter"])
            t[0] += w["shift"]
            # position by position, without blocks of code shared with the operator
            padded = list(data) + [0] * (len(data) % 2) + [0] * 4
            r = np.array([[sum(t[j, padded[i + j], k] for j in range(6)) for k in range(quality.FILTERS)] for i in range(0, len(padded) - 5, 2)])
            blocks = [r[i : i + quality.BLOCK].max(0) for i in range(0, len(r), quality.BLOCK)]
            chunk = [np.maximum(a, b) for a, b in zip(blocks[:-1], blocks[1:])] or blocks
            act = np.tanh(np.array(chunk))
            short = max(0.0, 1 - len(data) / (2 * quality.BLOCK * 2))
            x = np.concatenate([act.max(0), act.mean(0), act.min(0), short * act.mean(0), [short]])
            return np.log1p(np.exp(-(x @ w["out"] + w["bias"][0])))  # of label 1

        into, g = np.zeros((quality.WIDTH, 256, quality.FILTERS)), {k: np.zeros_like(x) for k, x in w.items()}
        quality.gradient(data, 1.0, w, quality.tables(w), into, g)
        g["embed"] = np.einsum("jbk,jek->be", into, w["filter"])
        g["filter"] = np.einsum("jbk,be->jek", into, w["embed"])
        for name, at in (("out", 3), ("out", 20), ("out", 40), ("out", 60), ("bias", 0), ("shift", 2), ("filter", 70), ("embed", ord("o") * quality.EMBED + 1)):
            up, down = ({k: x.copy() for k, x in w.items()} for _ in range(2))
            up[name].flat[at] += 1e-5
            down[name].flat[at] -= 1e-5
            assert g[name].flat[at] == pytest.approx((loss(up) - loss(down)) / 2e-5, rel=2e-2, abs=2e-4), (name, at)
        t = quality.tables(w)
        import pyarrow as pa

        assert quality.predict(pa.array([text]), w, t)[0] == pytest.approx(np.exp(-loss(w)), abs=1e-5)


def test_long_texts_score_as_a_whole():
    import pyarrow as pa

    w = quality.start(np.random.default_rng(1))
    t = quality.tables(w)
    long = np.frombuffer(("x" * 400_000 + "needle!!").encode(), np.uint8)
    whole = np.maximum.reduceat(r := quality.responses(quality.padded(long), t), np.arange(0, len(r), quality.BLOCK), axis=0)
    assert np.array_equal(quality.pooled(long, t), whole)
    model = toxicity.Model(np.array([toxicity.coordinates(pa.array(["needle"]))[0][1][0]], np.int32), np.array([5.0], np.float32), -2.0)
    dense = np.zeros(1 << toxicity.BITS, np.float32)
    dense[model.index] = model.weight
    assert toxicity.predict(pa.array(["x " * 2_000_000 + "needle"]), model, dense)[0] > 0.9


def test_fingerprints(spark, docs, none, rows):
    out = fingerprints.edits(docs).collect()
    hashes = {r.t: r.h for r in docs.select(F.coalesce("text", F.lit("")).alias("t"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()}
    order = sorted(((r[0], r[1] or "") for r in rows), key=lambda r: (r[0] is not None, r[0] or 0, hashes[r[1]]))
    want = Counter()
    for k, (i, t) in enumerate(order):
        n = len(t) // 2
        e = t[: len(t) - n] + order[(k + 1) % len(order)][1][:n]
        want[i, len(t), hashlib.sha256(e.encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in out) == want
    text = {i: t for i, t in order}
    by = {}
    for r in out:
        if r.doc_id is not None:
            assert by.setdefault(text[r.doc_id], r.fingerprint) == r.fingerprint
        assert 0 <= r.near_next <= 1 and 0 <= r.near_edited <= 1
    assert all(r.near_edited > 0.3 for r in out if r.n_chars > 800 and r.doc_id != 15)  # half is kept
    assert fingerprints.edits(none).count() == 0
    assert fingerprints.edits(docs.filter("doc_id = 11")).first().n_chars == len(text[11])


def test_chunks_do_not_depend_on_neighbours_and_survive_shifts():
    rng = random.Random(3)
    a, b = prose(rng, 400).encode(), prose(rng, 300).encode()
    of = lambda x: set(x.tolist())
    alone, _ = fingerprints.chunks([a])
    both, at = fingerprints.chunks([b, b"", a, a])
    assert of(both[at[2] : at[3]]) == of(alone) == of(both[at[3] :])
    shifted, _ = fingerprints.chunks([b"zz" + a])
    assert len(of(alone) & of(shifted)) > 0.9 * len(of(alone))
    assert fingerprints.likeness(alone, shifted) > 0.9


def test_vectors(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(300, 16))
    near = base[:60] + rng.normal(size=(60, 16)) * 0.05
    hub = base[299] + rng.normal(size=(80, 16)) * 0.1
    x = [v.tolist() for v in np.concatenate([base, near, hub])]
    rows = [(i, v) for i, v in enumerate(x)] + [(1000, x[0]), (1001, [2 * c for c in x[0]]), (1002, None), (1003, [0.0] * 16), (1004, [float("nan")] + [1.0] * 15), (1005, [None] + [1.0] * 15), (1006, [1.0, 2.0]), (1007, [2.0, 4.0]), (1008, []), (None, x[1]), (5, x[5])]
    out = vectors.near_duplicates(spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, n int, id int"), Stage(spark)).collect()
    good = [(i, np.array(v)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    links = [(a, b) for k, (a, u) in enumerate(good) for b, v in good[:k] if len(u) == len(v) and u @ v / np.linalg.norm(u) / np.linalg.norm(v) >= 0.9]
    want = Counter(i for p in links for i in p)
    want[5] //= 2  # it has two rows, which are copies of each other
    comp = brute.components({i for i, _ in rows if i is not None}, links)
    assert len(out) == len(rows)
    found = sum(r.n_links for r in out if r.vec_id not in (5, None))
    assert all(r.n_links <= want[r.vec_id] for r in out if r.vec_id is not None) and found >= 0.95 * sum(v for k, v in want.items() if k != 5)
    agree = [r.component_id == comp[r.vec_id] for r in out if r.vec_id is not None]
    assert np.mean(agree) > 0.98 and all(r.kept == (r.vec_id == r.component_id) for r in out if r.vec_id is not None)
    assert [(r.n_links, r.component_id) for r in out if r.vec_id == 1002] == [(0, 1002)]
    assert vectors.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>"), Stage(spark)).count() == 0


@pytest.mark.parametrize(("pivots", "n"), [(632, 1800), (2048, 2400)])
def test_vectors_of_a_dense_group(spark, monkeypatch, pivots, n):
    monkeypatch.setattr(vectors, "LEAST_PIVOTS", pivots)
    rng = np.random.default_rng(9)
    centre, x = rng.normal(size=64), rng.normal(size=(n, 64))
    x[: n // 3] = centre + 0.23 * x[: n // 3]
    out = vectors.near_duplicates(spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<double>"), Stage(spark)).collect()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = (u @ u.T >= 0.9).sum(1) - 1
    got = np.zeros(n, int)
    for r in out:
        got[r.vec_id] = r.n_links
    assert want.sum() > n * n / 10 and (got <= want).all() and got.sum() >= 0.98 * want.sum()


def test_vectors_of_a_rare_length(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(900, 16))
    x = [*base, *(base[:450] + 0.01 * rng.normal(size=(450, 16))), *([1.0, 0.01 * i] for i in range(4))]
    # ids of the rare length in reverse order of their hashes, so that no pivot has it
    ids = [r.id for r in spark.range(20_000).orderBy(F.xxhash64("id")).collect()]
    ids = ids[: len(x) - 4] + ids[-4:]
    out = vectors.near_duplicates(spark.createDataFrame([(i, [float(c) for c in v]) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>"), Stage(spark)).collect()
    found = {r.vec_id: r for r in out}
    assert [(found[i].n_links, found[i].component_id) for i in ids[-4:]] == [(3, min(ids[-4:]))] * 4
    u = np.array(x[:-4])
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    want = (u @ u.T >= 0.9).sum(1) - 1
    assert sum(found[i].n_links for i in ids[:-4]) >= 0.99 * want.sum()


def recall(spark, x, **how):
    """Links found of all links, none of them wrong."""
    n = len(x)
    out = vectors.near_duplicates(spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<double>"), Stage(spark)).collect()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want, got = np.concatenate([(u[i : i + 500] @ u.T >= 0.9).sum(1) - 1 for i in range(0, n, 500)]), np.zeros(n, int)
    for r in out:
        got[r.vec_id] = r.n_links
    assert (got <= want).all()
    return got.sum() / want.sum()


def planted(rng, pairs, others, d):
    """Random vectors with a neighbour each at a cosine of 0.90 to 0.93, and others without."""
    a, o = rng.normal(size=(pairs, d)), rng.normal(size=(pairs, d))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    o -= (o * a).sum(1, keepdims=True) * a
    o /= np.linalg.norm(o, axis=1, keepdims=True)
    c = rng.uniform(0.9001, 0.93, (pairs, 1))
    return np.concatenate([a, c * a + np.sqrt(1 - c * c) * o, rng.normal(size=(others, d))])


@pytest.mark.parametrize("d", [24, 64])
def test_recall_of_planted_pairs(spark, d):
    assert recall(spark, planted(np.random.default_rng(d), 5000, 2000, d)) >= 0.98


def test_recall_with_many_pivots(spark, monkeypatch):
    monkeypatch.setattr(vectors, "LEAST_PIVOTS", 4096)  # as many as 4 million vectors have
    assert recall(spark, planted(np.random.default_rng(7), 1500, 3000, 64)) >= 0.97


def with_direction(rng, pairs, others, d, mean):
    """Vectors whose cosines have this mean, as they share a direction, and a partner at a cosine of 0.90 to 0.91 for the first ones."""
    unit = lambda v: v / np.linalg.norm(v, axis=-1, keepdims=True)
    g = np.sqrt(mean) * unit(rng.normal(size=d))
    x = unit(g + np.sqrt(1 - mean) * unit(rng.normal(size=(pairs + others, d))))
    w, o = x[:pairs] - g, rng.normal(size=(pairs, d))
    o = unit(o - (o * w).sum(1, keepdims=True) / (w * w).sum(1, keepdims=True) * w) * np.linalg.norm(w, axis=1, keepdims=True)
    low, high, goal = np.zeros((pairs, 1)), np.full((pairs, 1), np.pi), rng.uniform(0.9001, 0.91, (pairs, 1))
    for _ in range(40):
        t = (low + high) / 2
        y = unit(g + np.cos(t) * w + np.sin(t) * o)
        near = (y * x[:pairs]).sum(1, keepdims=True) >= goal
        low, high = np.where(near, t, low), np.where(near, high, t)
    return np.concatenate([x, unit(g + np.cos(low) * w + np.sin(low) * o)])


@pytest.mark.parametrize(("d", "mean"), [(384, 0.7), (64, 0.5), (64, 0.85)])
def test_vectors_that_share_a_direction(spark, d, mean):
    x = with_direction(np.random.default_rng(d), 400, 1600, d, mean)
    u = x[:1600]
    assert abs((u @ u.T).mean() - mean) < 0.05
    pivots = vectors.Pivots([v.tobytes() for v in x[::8]], "<f8")
    assert pivots.total > 100 and pivots.named <= vectors.COUNTED
    # no vector is without a permutation, so there is no list of all, and each is in at most so many lists
    rows = spark.createDataFrame([(v.tobytes(),) for v in x], "vector binary")
    lists = rows.select(vectors.permutation(pivots, "<f8")("vector").alias("p")).select(vectors.lists_of(np.zeros(pivots.total + 1, bool), pivots.named)("p").alias("in"))
    assert lists.selectExpr("sum(size(in.cells) + size(in.pairs)) n").first().n <= len(x) * pivots.named
    assert recall(spark, x) >= 0.97


def test_crowded_samples_keep_pivots():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(5, 32))[rng.integers(5, size=800)] + 0.35 * rng.normal(size=(800, 32))  # five groups that are no copies
    assert vectors.Pivots([v.tobytes() for v in x], "<f8").total >= 100
    same = np.repeat(rng.normal(size=(1, 32)), 800, 0) + 1e-3 * rng.normal(size=(800, 32))
    assert vectors.Pivots([v.tobytes() for v in same], "<f8").total >= 64


def test_crowded_pivots_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(vectors, "CROWDED", 40)
    monkeypatch.setattr(vectors, "BLOCK", 100)
    monkeypatch.setattr(vectors, "STRIPE", 16)
    monkeypatch.setattr(vectors, "ENTRIES", 500)
    rng = np.random.default_rng(3)
    x = planted(rng, 300, 300, 16)
    x[-200:] = rng.normal(size=16) + 0.25 * rng.normal(size=(200, 16))
    assert recall(spark, x) >= 0.98


def test_vectors_of_a_length_without_pivot(spark):
    rng = np.random.default_rng(8)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(2000, 16)))] + [(5000, [1.0, 2.0]), (5001, [2.0, 4.01]), (5002, [2.0, 4.02])]
    out = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), Stage(spark)).collect()}
    assert [out[i] for i in (5000, 5001, 5002)] == [(2, 5000)] * 3


def plain_mix(rows, weights=(5, 2, 1), share=1.5, most=2):
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(brute.words(r[1]))
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    target, left, free = {}, share * sum(sizes.values()), set(names)
    while free:
        level = left / sum(w[s] for s in free)
        over = {s for s in free if w[s] * level >= most * sizes[s]}
        if not over:
            target |= {s: w[s] * level for s in free}
            break
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
        free -= over
    return sizes, target


def test_mixing(spark, docs, none, rows):
    out = mixing.taken(docs, Stage(spark)).collect()
    sizes, target = plain_mix(rows)
    source = {r[0]: r[3] for r in rows if r[0] is not None}
    took = Counter()
    for r in out:
        if r.doc_id is not None:
            s = source[r.doc_id]
            assert r.source_size == sizes[s] and r.target == pytest.approx(target[s], abs=1e-5)
        assert 0 <= r.taken <= 2 * r.size
        took[r.key] += r.taken
    assert {k: took["1" if k is None else "0" + k] for k in target} == {k: pytest.approx(v, abs=1) for k, v in target.items()}
    again = mixing.taken(docs.repartition(5), Stage(spark)).collect()
    key = lambda r: (r.doc_id is not None, r.doc_id or 0, r.size)
    assert [r.taken for r in sorted(out, key=key) if r.doc_id not in (0, 12, None)] == [r.taken for r in sorted(again, key=key) if r.doc_id not in (0, 12, None)]
    assert mixing.taken(none, Stage(spark)).count() == 0
    whole = mixing.mixed(docs.filter("doc_id > 12"), Stage(spark))
    want = {r.doc_id: r.taken for r in mixing.taken(docs.filter("doc_id > 12"), Stage(spark)).collect()}
    got = Counter()
    for r in whole.collect():
        got[r.doc_id] += len(brute.words(r.text))
    assert whole.columns == docs.columns and got == {k: v for k, v in want.items() if v}


def test_mixing_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    theirs = con.execute(mixing.OP5_SQL).fetchall()
    ours = [tuple(r) for r in mixing.op5_mixing(spark, SF).collect()]
    assert sorted(ours) == sorted(theirs)


def test_packing(spark, docs, none, rows):
    out = packing.placements(docs, Stage(spark)).collect()
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for r in rows:
        x = np.array([*t.encode(r[1] or "", add_special_tokens=False).ids, 2], "<u4")
        first = (len(x) - 1) % 1024 + 1
        cuts = [0, *range(first, len(x) + 1, 1024)]
        for j, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            want[r[0], j, a, b - a, zlib.crc32(x[a:b].tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == want
    check_bins(out)
    assert packing.placements(none, Stage(spark)).count() == 0
    pieces = Stage(spark).put(packing.tokenised(docs.filter("doc_id < 10 or doc_id = 11")), "pieces")
    whole = packing.sequences(packing.packed(pieces, Stage(spark))).collect()
    assert all(len(r.ids) == 4 * r.length <= 4096 for r in whole) and sum(r.length for r in whole) == pieces.agg(F.sum("length")).first()[0]


def check_bins(out, capacity=1024):
    bins: dict = {}
    for r in out:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        end = 0
        for offset, length in sorted(b):
            assert offset == end
            end += length
        assert end <= capacity
    return len(bins)


def test_groups_of_pieces_are_full(spark, monkeypatch):
    rng = np.random.default_rng(1)
    sizes = np.concatenate([rng.integers(1, 1025, 6000), np.full(500, 1024), rng.integers(1, 80, 6000)])
    b, offset = packing.sum_of_squares(sizes, 1024)
    end = Counter()
    for k in np.lexsort((offset, b)):
        assert end[b[k]] == offset[k]
        end[b[k]] += int(sizes[k])
    assert max(end.values()) <= 1024 and len(end) <= 1.01 * sizes.sum() / 1024 + 3
    monkeypatch.setattr(packing, "GROUP", 2500)
    pieces = spark.createDataFrame([(None, 0, 0, int(n)) for n in sizes], "doc_id long, piece int, start long, length long")
    out = packing.packed(pieces, Stage(spark)).collect()
    assert Counter(r.length for r in out) == Counter(sizes.tolist())
    assert check_bins(out) <= 1.02 * sizes.sum() / 1024 + 3


def test_url_rules(spark):
    urls = ["http://WWW.Example.com/en/1?q#f", "https://a.example.com/en/", "http://example.com/EN/", "ftp://notexample.com/en/x", "http://x.net/es/1", "http://net/fr/", "x.net/es/", None, "http://x.net", "http://x.org/a?b=http://y", "HTTP://É.net/fr/#://", "://com/", "http://com?/"]
    rows = [(i, u, None, 7, "v") for i, u in enumerate(urls)] + [(50, urls[0], "", 7, "v")] * 2
    out = {r.page_id: r for r in urlfilter.judged(spark.createDataFrame(rows, "page_id long, url string, html string, id int, verdict string"), Stage(spark)).collect()}

    def plain(u):
        import re

        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.split(r"[/?#]", rest)[0]
        path = re.split(r"[?#]", rest[len(host) :])[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
        fits = [(len(h + p), h + p, v) for v, h, p in urlfilter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=(0, None, "allow"))
        return host, path, best[1], best[2]

    for i, u in enumerate(urls):
        assert (out[i].host, out[i].path, out[i].rule, out[i].verdict) == plain(u), u


def test_url_aliases(spark):
    canonical = lambda u: f"<html><LINK href='{u}' rel=canonical></html>"
    refresh = lambda u: f'<meta http-equiv="refresh" content="0; url={u}">'
    rows = [
        (1, "http://a.org/1", canonical("https://x.net/es/9")),
        (2, "http://b.org/2", refresh("http://a.org/1#top")),
        (3, "http://c.org/3", canonical("http://d.org/3")),
        (4, "http://e.org/4", canonical("http://x.net/fr/1")),
        (5, "http://e.org/4", refresh("http://shop.com/")),
        (6, "http://f.com/6", canonical("http://x.net/es/9")),
        (7, "http://g.org/7", '<link rel="canonical" href="/8">'),
        (8, "http://g.org/8", refresh("//x.net/es/1?a=1&amp;b=2")),
        (9, "http://x.net/es/9?x", canonical("")),
    ]
    out = {r.page_id: r.verdict for r in urlfilter.judged(spark.createDataFrame(rows, "page_id long, url string, html string"), Stage(spark)).collect()}
    # 6 is allowed by its own rule and so makes the aliases 1 and 2 of the blocked page allowed
    assert out == {1: "allow", 2: "allow", 3: "allow", 4: "allow", 5: "allow", 6: "allow", 7: "block", 8: "block", 9: "block"}
    alone = {r.page_id: r.verdict for r in urlfilter.judged(spark.createDataFrame(rows[:2], "page_id long, url string, html string"), Stage(spark)).collect()}
    assert alone == {1: "block", 2: "block"}
    assert urlfilter.judged(spark.createDataFrame([], "page_id long, url string, html string"), Stage(spark)).count() == 0


def test_pages_of_many_megabytes(spark):
    import time

    link = '<link rel="canonical" href="http://b.net/es/1">'
    pages = [
        (1, "http://a.org/1", "<link " * 900_000),  # no tag ends: 5 MB are one tag, looked at once
        (2, "http://a.org/2", "<link rel='" * 450_000 + link),  # one tag, which names a canonical link at its end
        (3, "http://a.org/3", "<p>text</p>" * 450_000 + link),
        (4, "http://a.org/4", "<base " * 800_000 + link),
        (5, "http://b.net/es/1", None), (6, "http://a.org/6", link * 1000), (7, "http://a.org/" + "x" * 3_000_000, link),
    ]
    began = time.perf_counter()
    out = {r.page_id: r.verdict for r in urlfilter.judged(spark.createDataFrame(pages, "page_id long, url string, html string"), Stage(spark)).collect()}
    assert time.perf_counter() - began < 60
    assert out == {1: "allow", 2: "block", 3: "block", 4: "allow", 5: "block", 6: "block", 7: "block"}


def test_url_aliases_of_ordinary_markup(spark):
    blocked = '<link rel="canonical" href="http://x.net/es/9">'
    refresh = lambda u: f'<meta http-equiv="refresh" content="0; url={u}">'
    pages = [
        # the verdict of 1 depends on the whole query
        ("http://a.org/1", refresh("http://m.org/a?b=1&amp;c=2"), "block"),
        ("http://m.org/a?b=1&c=2", blocked, "block"),
        ("http://m.org/a?b=1", "", "allow"),
        ("http://m.org/a?b=1&amp", "", "allow"),
        ("http://a.org/2", refresh("'http://m.org/b;v=1?x=;y'"), "block"),
        ("http://m.org/b;v=1?x=;y", blocked, "block"),
        # relative targets
        ("http://r.org/d/page1.html?q", "<link rel=canonical href='page2.html'>", "block"),
        ("http://r.org/d/page2.html", blocked, "block"),
        ("http://s.org/d/e?id=1", "<link rel=canonical href='?id=3'>", "block"),
        ("http://s.org/d/e?id=3", blocked, "block"),
        ("http://t.org", "<link rel=canonical href='./x/../u?r=http://v.org/'>", "block"),
        ("http://t.org/u?r=http://v.org/", blocked, "block"),
        ("http://w.org/a/b/c", "<base href='/k/l/'><link data-href='no' rel=canonical href=../m/.>", "block"),
        ("http://w.org/k/m/", blocked, "block"),
        ("http://y.org/1", "<link rel=canonical href='mailto:a@y.org'>", "allow"),
        # not only the first link and redirect
        ("http://z.org/1", '<link rel="canonical" href="http://z.org/5"><LINK rel="canonical" href="http://z.org/6">', "block"),
        ("http://z.org/6", blocked, "block"),
        ("http://z.org/2", refresh("http://z.org/7") + refresh("http://z.org/8"), "block"),
        ("http://z.org/8", blocked, "block"),
    ]
    pages += [
        ("http://o.org/1", '<link href="http://p.org" rel="alternate canonical">', "block"),
        ("http://p.org/", blocked, "block"),
        ("http://q.org/1", "<link rel=canonical href='http:&#x2F;&#47;q.org&sol;a&#38;b'>", "block"),
        ("http://q.org/a&b", blocked, "block"),
    ]
    # components of their own, so that one cannot repair the other
    rows = [(i, u, h.replace("/es/9", f"/es/{i}")) for i, (u, h, _) in enumerate(pages)]
    out = {r.page_id: r.verdict for r in urlfilter.judged(spark.createDataFrame(rows, "page_id long, url string, html string"), Stage(spark)).collect()}
    assert [(u, out[i]) for i, (u, _, _) in enumerate(pages)] == [(u, v) for u, _, v in pages]


def test_aliases_of_random_pages(spark):
    rng = random.Random(12)
    hosts = ["a.org", "b.com", "c.net", "www.d.org"]
    url = lambda: f"http://{rng.choice(hosts)}/{rng.choice(['es', 'fr', 'en', 'x'])}/{rng.randint(1, 60)}"
    pages = []
    for i in range(300):
        to = [url() for _ in range(rng.choice((0, 0, 1, 1, 2)))]
        tags = [f'<link rel="canonical" href="{t}">' if rng.random() < 0.5 else f'<meta http-equiv=refresh content="1;URL={t}">' for t in to]
        pages.append((i, url(), "<p>".join(tags), to))
    links = [(u, t) for _, u, _, to in pages for t in to]
    nodes = sorted({x for p in links for x in p} | {u for _, u, _, _ in pages})
    comp = brute.components(nodes, links)

    def own(u):
        host, path = u.split("://")[1].split("/", 1)
        fits = [(len(h + p), v) for v, h, p in urlfilter.RULES if (host == h or host.endswith("." + h)) and ("/" + path).startswith(p)]
        return max(fits)[1] if fits else None

    said: dict = {}
    for u in nodes:
        said.setdefault(comp[u], set()).add(own(u))
    want = {i: own(u) or ("allow" if "allow" in said[comp[u]] else "block" if "block" in said[comp[u]] else "allow") for i, u, _, _ in pages}
    out = {r.page_id: r.verdict for r in urlfilter.judged(spark.createDataFrame([p[:3] for p in pages], "page_id long, url string, html string"), Stage(spark)).collect()}
    assert out == want and len(set(want.values())) == 2


def plain_groups(rows):
    sets = {r[0]: brute.shingles(r[1]) for r in rows if r[0] is not None}
    links = brute.jaccard_links({i: s for i, s in sets.items() if s})
    same: dict = {}
    links |= {(same.setdefault(s, i), i) for i, s in sorted(sets.items()) if s}
    return sets, brute.components(sets, links)


def check_groups(out, rows):
    sets, comp = plain_groups(rows)
    assert Counter(r.doc_id for r in out) == Counter(r[0] for r in rows)
    for r in out:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), comp[r.doc_id], comp[r.doc_id] == r.doc_id), r


def test_near_duplicates(spark, docs, none, rows):
    check_groups(neardup.groups(docs, Stage(spark)).collect(), rows)
    assert neardup.groups(none, Stage(spark)).count() == 0
    kept = neardup.deduplicated(docs, Stage(spark))
    _, comp = plain_groups(rows)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter({i: 1 for i in comp if comp[i] == i} | {None: 2})


def test_near_duplicates_in_hot_buckets(spark, monkeypatch):
    monkeypatch.setattr(neardup, "SMALL", 2)
    monkeypatch.setattr(neardup, "BLOCK", 20)
    rng = random.Random(6)
    base = prose(rng, 200).split()

    def copy(edits):
        w = list(base)
        for _ in range(edits):
            w[rng.randrange(len(w))] = prose(rng, 1)
        return " ".join(w)

    rows = [(i, copy(rng.choice((0, 2, 4, 6, 8, 10)))) for i in range(150)] + [(200 + i, prose(rng, 40)) for i in range(50)]
    out = neardup.groups(spark.createDataFrame(rows, "doc_id long, text string"), Stage(spark)).collect()
    check_groups(out, rows)


def test_sketches_fill_and_estimate():
    rng = np.random.default_rng(2)
    pool = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    for size in (1, 3, 40, 1000):
        a, b = pool[:size], pool[size // 5 : size + size // 5]
        s = neardup.sketches(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
        assert (s != neardup._EMPTY).all()
        true = len(set(a.tolist()) & set(b.tolist())) / len(set(a.tolist()) | set(b.tolist()))
        assert abs((s[0] == s[1]).mean() - true) < 0.25
