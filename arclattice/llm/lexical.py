"""Ranked lexical search in integers: whole documents scored against a set of queries by sort-based accumulation.

A scan turns every document into the query terms that it holds, with their counts; from these come the
statistics (documents with terms, all terms, document frequencies), and with them each match's impact.
A task then takes its documents in chunks: it concatenates the matched (item, document, impact) triples,
packs item and document into one key, sorts the keys by radix, 16 bits a pass, and adds up each key's
impacts with reduceat. A document is scored whole by the task that reads it, so that nothing is shuffled
but each task's best `top` for each item, held in heaps. Those are dealt by ranges of (item,
score), a heap in each range keeps the best of an item there, and what is left is ranked.

Terms are the maximal runs of ASCII letters and digits and of other characters beyond ASCII, A-Z lower-cased, named
by 64 bits. Queries are taken in blocks of about POSTINGS terms, each of which scans the documents once; an item's terms stay together.

Null texts have no terms. Documents without terms count nowhere. Each row is a document, also one that
repeats a doc_id; of equal scores those without doc_id come last. Rows of items that repeat item_id and
text are one item; other rows with that item_id are items of their own, ranked apart. An item of
which no document holds a term has no rows, and so have empty tables. Texts may be of any
length. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import heapq
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import textscan
from .common import Stage, partitions, table
from .toxicity import blocks

TOP = 20
#: (item, term) pairs that are looked for in one scan, about.
POSTINGS = 1 << 20
#: Triples that are sorted at once, about; a document with more is a chunk of its own.
TRIPLES = 1 << 21
#: Winners that one task of the last ranking reads, about.
WINNERS = 50_000


def counted(column: pa.Array, vocabulary: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(n, row, term, tf): terms of each row, and for each row its different terms, all or the places in `vocabulary` of those there, with counts."""
    name, at = textscan.words(column, textscan.ALNUM)
    row = np.repeat(np.arange(len(column)), np.diff(at))
    if vocabulary is not None:
        place = np.minimum(np.searchsorted(vocabulary, name), len(vocabulary) - 1)
        hit = vocabulary[place] == name
        key, tf = np.unique(row[hit] * len(vocabulary) + place[hit], return_counts=True)
        return np.diff(at), key // len(vocabulary), key % len(vocabulary), tf
    order = np.lexsort((name, row))
    row, name = row[order], name[order]
    first = np.flatnonzero(np.r_[True, (np.diff(row) != 0) | (name[1:] != name[:-1])]) if len(row) else np.zeros(0, np.int64)
    return np.diff(at), row[first], name[first], np.diff(np.r_[first, len(row)])


def binaries(data: np.ndarray, at: np.ndarray) -> pa.Array:
    """A binary value for each run of data between two of the bounds."""
    bounds = (at * data.itemsize).astype("<i4")
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))])


def postings(items: DataFrame) -> DataFrame:
    """(item, item_id, term, repeats) of items (item, item_id, text)."""
    kind = items.schema["item_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            i = 0
            for part in blocks(b.column("text")):
                _, row, term, repeats = counted(part)
                at = pa.array(row + i)
                yield pa.record_batch([b.column("item").take(at), b.column("item_id").take(at), pa.array(term.view(np.int64)), pa.array(repeats)], ["item", "item_id", "term", "repeats"])
                i += len(part)

    return items.mapInArrow(run, f"item long, item_id {kind}, term long, repeats long")


def matches(docs: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """(doc_id, n, terms, counts) of the documents that have terms: how many, and which of the vocabulary how often, as 32-bit numbers."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            i = 0
            for part in blocks(b.column("text")):
                n, row, term, tf = counted(part, vocabulary)
                at = np.searchsorted(row, np.arange(len(part) + 1))
                rows = pa.record_batch([b.column("doc_id").slice(i, len(part)), pa.array(n), binaries(term.astype("<i4"), at), binaries(tf.astype("<i4"), at)], ["doc_id", "n", "terms", "counts"])
                yield rows.filter(pa.array(n > 0))
                i += len(part)

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n long, terms binary, counts binary")


def frequencies(found: DataFrame, terms: int) -> np.ndarray:
    """How many documents hold each of the vocabulary's terms."""

    def run(batches):
        total = np.zeros(terms, np.int64)
        for b in batches:
            total += np.bincount(joined(b.column("terms")), minlength=terms)
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(some), pa.array(total[some])], ["term", "df"])

    out = np.zeros(terms, np.int64)
    for r in found.select("terms").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():  # a row a query term
        out[r["term"]] = r["df"]
    return out


def joined(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i4").astype(np.int64)


def radix_order(keys: np.ndarray, bits: int) -> np.ndarray:
    """A stable order of keys of so many bits, by 16-bit digits from the lowest."""
    order = np.argsort(keys.astype(np.uint16), kind="stable")  # 16-bit numbers are sorted by radix
    for shift in range(16, bits, 16):
        order = order[np.argsort((keys[order] >> shift).astype(np.uint16), kind="stable")]
    return order


def impacts(tf: np.ndarray, n: np.ndarray, weight: np.ndarray, docs: int, words: int) -> np.ndarray:
    """A match's share of the score: weight * ((10^9 tf) div (1000 tf + 12 m))."""
    longest = int(n.max()) if len(n) else 0
    if 25 * longest * docs < 1 << 63:
        m = 75 + (25 * n * docs) // words
    else:
        m = np.array([75 + 25 * x * docs // words for x in n.tolist()], np.int64)
    return weight * ((1_000_000_000 * tf) // (1000 * tf + 12 * m))


class Queries:
    """Items by term, in the order of the vocabulary: of term t those from at[t] to at[t + 1]."""

    def __init__(self, rows: list):
        term = np.array([r["term"] for r in rows], np.int64).view(np.uint64)
        number = {k: i for i, k in enumerate(sorted({r["item"] for r in rows}))}
        self.item_ids: list = [None] * len(number)
        for r in rows:
            self.item_ids[number[r["item"]]] = r["item_id"]
        order = np.argsort(term, kind="stable")
        self.vocabulary, first = np.unique(term[order], return_index=True)
        self.at = np.r_[first, len(term)]
        self.item = np.array([number[r["item"]] for r in rows], np.int64)[order]
        self.repeats = np.array([r["repeats"] for r in rows], np.int64)[order]


def chunk_scores(terms: np.ndarray, tf: np.ndarray, doc: np.ndarray, docs: int, impact: np.ndarray, q: Queries) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(item, document, score) of a chunk's matches; documents count from 0."""
    many = q.at[terms + 1] - q.at[terms]
    match = np.repeat(np.arange(len(terms)), many)
    place = np.arange(len(match)) - np.repeat(np.cumsum(many) - many, many) + q.at[terms[match]]
    key = q.item[place] * docs + doc[match]
    value = impact[match] * q.repeats[place]
    order = radix_order(key, max(1, (len(q.item_ids) * docs).bit_length()))
    key = key[order]
    first = np.flatnonzero(np.r_[True, np.diff(key) != 0])
    return key[first] // docs, key[first] % docs, np.add.reduceat(value[order], first)


class Best:
    """The best `top` documents of each item, in heaps whose root is the worst of them."""

    def __init__(self, top: int):
        self.top = top
        self.heaps: dict[int, list[tuple[int, bool, int]]] = {}

    def add(self, item: np.ndarray, there: np.ndarray, doc: np.ndarray, score: np.ndarray) -> None:
        """Rows; there: whether the document has an id."""
        order = np.lexsort((doc, ~there, -score, item))
        item = item[order]
        first = np.flatnonzero(np.r_[True, np.diff(item) != 0]) if len(item) else np.zeros(0, np.int64)
        rank = np.arange(len(item)) - np.repeat(first, np.diff(np.r_[first, len(item)]))
        near = order[rank < self.top]
        for i, t, d, s in zip(item[rank < self.top].tolist(), there[near].tolist(), doc[near].tolist(), score[near].tolist(), strict=True):
            heap = self.heaps.setdefault(i, [])
            if len(heap) < self.top:
                heapq.heappush(heap, (s, t, -d))
            elif (s, t, -d) > heap[0]:
                heapq.heapreplace(heap, (s, t, -d))

    def batch(self) -> pa.RecordBatch:
        rows = [(i, -d if t else None, s) for i, heap in self.heaps.items() for s, t, d in heap]
        columns = zip(*rows, strict=True) if rows else ((), (), ())
        return pa.record_batch([pa.array(c, pa.int64()) for c in columns], ["item", "doc_id", "score"])


def winners(found: DataFrame, q: Queries, weight: np.ndarray, docs: int, words: int, top: int) -> DataFrame:
    """(item, doc_id, score): each task's best documents of each item; items by their number in q."""

    def run(batches):
        best = Best(top)
        for b in batches:
            size = np.array([len(x) // 4 for x in b.column("terms").to_pylist()], np.int64)
            at = np.r_[0, np.cumsum(size)]
            terms, tf, n = joined(b.column("terms")), joined(b.column("counts")), b.column("n").to_numpy()
            there = b.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
            ids = b.column("doc_id").cast(pa.int64()).fill_null(0).to_numpy()
            row = np.repeat(np.arange(len(n)), size)
            impact = impacts(tf, n[row], weight[terms], docs, words)
            total = np.r_[0, np.cumsum(q.at[terms + 1] - q.at[terms])][at]  # triples before each document
            i = 0
            while i < len(n):
                j = max(i + 1, int(np.searchsorted(total, total[i] + TRIPLES, "right")) - 1)
                part = slice(at[i], at[j])
                if total[j] > total[i]:
                    item, doc, score = chunk_scores(terms[part], tf[part], row[part] - i, j - i, impact[part], q)
                    some = score > 0
                    best.add(item[some], there[i:j][doc[some]], ids[i:j][doc[some]], score[some])
                i = j
        yield best.batch()

    return found.mapInArrow(run, "item long, doc_id long, score long")


def ranked(best: DataFrame, stage: Stage, top: int) -> DataFrame:
    """(item, rank, doc_id, score) of the best rows (item, doc_id, score) of each item."""
    best = stage.put(best, "winners")
    parts = max(partitions(stage.spark), best.count() // WINNERS)

    def run(batches):
        kept = Best(top)
        for b in batches:
            doc = b.column("doc_id")
            kept.add(b.column("item").to_numpy(), doc.is_valid().to_numpy(zero_copy_only=False), doc.fill_null(0).to_numpy(), b.column("score").to_numpy())
        yield kept.batch()

    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    dealt = best.repartitionByRange(parts, "item", *order).mapInArrow(run, "item long, doc_id long, score long")
    w = Window.partitionBy("item").orderBy(*order)
    return dealt.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top).select("item", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, stage: Stage, top: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score): the `top` documents (doc_id, text) of each of the items (item_id, text)."""
    spark = stage.spark
    kind = items.schema["item_id"].dataType.simpleString()
    items = stage.put(items.select("item_id", "text").distinct().withColumn("item", F.monotonically_increasing_id()), "items")
    wanted = stage.put(postings(items.select("item", "item_id", "text")), "postings")
    parts = max(1, -(-wanted.count() // POSTINGS))
    out = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    for k in range(parts):
        rows = wanted.filter(F.pmod(F.xxhash64("item"), F.lit(parts).cast("long")) == k).collect()  # about POSTINGS
        if not rows:
            continue
        q = Queries(rows)
        found = stage.put(matches(docs, q.vocabulary), "matches")
        n, words = found.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not n:
            break
        df = frequencies(found, len(q.vocabulary))
        weight = np.array([floor(1000 * log((2 * n + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
        best = ranked(winners(found, q, weight, n, words, top), stage, top)
        names = spark.createDataFrame(list(enumerate(q.item_ids)), f"item long, item_id {kind}")  # at most POSTINGS, as its items
        out = out.unionByName(best.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))
    return out


def op11_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), Stage(spark))


_TERMS = r"unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term"
OP11_SQL = f"""WITH t AS (SELECT doc_id, {_TERMS} FROM documents), d AS (SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id),
s AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS words FROM d), q AS (SELECT item_id, term, count(*) AS repeats FROM (SELECT item_id, {_TERMS} FROM (SELECT DISTINCT item_id, text FROM benchmark)) GROUP BY ALL),
f AS (SELECT doc_id, term, count(*) AS tf FROM t WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM f GROUP BY term), s),
m AS (SELECT doc_id, 75 + (25 * n * docs) // words AS m FROM d, s),
r AS (SELECT item_id, doc_id, CAST(sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score FROM q JOIN w USING (term) JOIN f USING (term) JOIN m USING (doc_id) GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score FROM r WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 20"""
