"""Harmonic packing: token sequences filled from classes of reciprocal capacity, each task by itself.

Documents become ids of a public byte-level BPE (`path` names its tokenizers file) and an end id. Whole
lengths of a long document are sequences of their own; what is left of it, or a shorter document, is a
remainder. Remainders whose length is in (length / (k + 1), length / k] are class k: a bin of the class
takes exactly k of them. The longest remainders get bins, as many as the ids of a group fill; the
shortest, and those that their class has too few of for a bin, are poured into the gaps of the bins one
after another and cut where a gap ends. What is then left becomes sequences whose lengths are powers of
two, which need no padding; so if `length` is one, nothing is padded.

A task packs what it reads, in groups of at most GROUP remainders: nothing is shuffled, staged or sent to
the driver, a lost task packs the same rows again, and its memory follows neither the table nor
a document's length. A sequence's id holds the task's number.

Null text counts as empty: one piece that holds the end id. Texts may be of any length. Rows are packed
one by one, repeated ones or ones without doc_id too; ties in length go in the order of the rows. Columns
beside doc_id and text are not read; an empty table gives an empty one.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, table
from .packing import encoder
from .toxicity import blocks

LENGTH = 1024
END = 0
#: Remainders packed together at most: 32,768 of under 1,024 ids.
GROUP = 1 << 15
#: Rows of an output batch.
ROWS = 1 << 12
#: Bits of a sequence id below the task's number.
TASK_BITS = 40


@dataclass
class Places:
    """Pieces of remainders: which one, from where in it, how many ids, in which sequence, from where there."""

    item: np.ndarray
    start: np.ndarray
    length: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    sequences: int


def filled(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(order, bin_of, offset, gaps): items longest first; the bin of each (-1: poured) and its place there; what bins have free.

    Bins are as many as the ids can fill to the brim.
    """
    order = np.argsort(-sizes, kind="stable")
    size = sizes[order]
    k = capacity // size
    first = np.flatnonzero(np.r_[True, np.diff(k) != 0])
    count = np.diff(np.r_[first, len(k)])
    rank = np.arange(len(k)) - np.repeat(first, count)
    closes = (rank + 1) % k == 0  # the k-th item of a bin
    number = np.cumsum(closes) - closes
    bins = min(int(closes.sum()), int(size.sum()) // capacity)
    inside = (rank < np.repeat(count // k[first] * k[first], count)) & (number < bins)
    bin_of = np.where(inside, number, -1)
    used = np.bincount(number[inside], weights=size[inside], minlength=bins).astype(np.int64)
    before = np.cumsum(size[inside]) - size[inside]
    offset = np.zeros(len(size), np.int64)
    offset[inside] = before - (np.cumsum(used) - used)[number[inside]]
    return order, bin_of, offset, capacity - used


def powers(n: int, capacity: int) -> list[int]:
    """n as sequences: full ones, then powers of two, the largest first."""
    return [capacity] * (n // capacity) + [1 << b for b in reversed(range(capacity.bit_length())) if n % capacity >> b & 1]


def harmonic(sizes: np.ndarray, capacity: int) -> Places:
    """Places of items of 1 to capacity ids; gaps and left-overs are filled by cutting what has no bin."""
    if not len(sizes):
        none = np.zeros(0, np.int64)
        return Places(none, none, none, none, none, 0)
    sizes = np.asarray(sizes, np.int64)
    order, bin_of, offset, gaps = filled(sizes, capacity)
    whole, loose = np.flatnonzero(bin_of >= 0), np.flatnonzero(bin_of < 0)
    poured = sizes[order[loose]]
    rest = powers(int(poured.sum() - gaps.sum()), capacity)
    room = np.concatenate([gaps, rest]).astype(np.int64)
    at = np.concatenate([capacity - gaps, np.zeros(len(rest), np.int64)]).astype(np.int64)
    ends, filled_to = np.cumsum(poured), np.cumsum(room)
    cuts = np.unique(np.concatenate([ends, filled_to]))
    start = np.concatenate([[0], cuts[:-1]]).astype(np.int64)[: len(cuts)]
    start, cuts = start[cuts > 0], cuts[cuts > 0]
    item, sequence = np.searchsorted(ends, start, "right"), np.searchsorted(filled_to, start, "right")
    return Places(
        np.concatenate([order[whole], order[loose][item]]),
        np.concatenate([np.zeros(len(whole), np.int64), start - (ends - poured)[item]]),
        np.concatenate([sizes[order[whole]], cuts - start]),
        np.concatenate([bin_of[whole], sequence]),
        np.concatenate([offset[whole], at[sequence] + start - (filled_to - room)[sequence]]),
        len(room),
    )


@dataclass
class Packer:
    """What a task holds: remainders that have no place yet, and pieces that wait to be handed on."""

    length: int
    kind: pa.DataType
    task: int
    doc: list = field(default_factory=list)
    ids: list = field(default_factory=list)
    start: list = field(default_factory=list)
    total: list = field(default_factory=list)
    out: list = field(default_factory=list)
    sequences: int = 0

    def add(self, doc, ids: np.ndarray) -> None:
        full = len(ids) // self.length * self.length
        for p in range(0, full, self.length):
            self.place(doc, p, ids[p : p + self.length], len(ids), 0, 0)
            self.sequences += 1
        if full < len(ids):
            self.doc.append(doc)
            self.ids.append(ids[full:].copy())  # not a view, which would keep the whole document
            self.start.append(full)
            self.total.append(len(ids))

    def place(self, doc, start: int, ids: np.ndarray, total: int, sequence: int, offset: int) -> None:
        self.out.append((doc, start, len(ids), ids.tobytes(), total, (self.task << TASK_BITS) + self.sequences + sequence, offset))

    def pack(self) -> None:
        found = harmonic(np.array([len(x) for x in self.ids], np.int64), self.length)
        for i, s, n, q, o in zip(*(x.tolist() for x in (found.item, found.start, found.length, found.sequence, found.offset)), strict=True):
            self.place(self.doc[i], self.start[i] + s, self.ids[i][s : s + n], self.total[i], q, o)
        self.sequences += found.sequences
        self.doc, self.ids, self.start, self.total = [], [], [], []

    def batches(self, all_rows: bool = False):
        while len(self.out) >= ROWS or (all_rows and self.out):
            rows, self.out = self.out[:ROWS], self.out[ROWS:]
            kinds = (self.kind, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], NAMES)


NAMES = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]


def pieces(docs: DataFrame, path: str | None = None, length: int = LENGTH, end: int = END) -> DataFrame:
    """(doc_id, start, length, ids, doc_tokens, sequence_id, offset): ids as little-endian unsigned 32-bit numbers."""
    path = path or public_tokenizers.path("byte_bpe_50k.json")
    bounded_batches(docs.sparkSession)

    def run(batches):
        encode, packer = encoder(path), None
        for b in batches:
            column = b.column("doc_id")
            packer = packer or Packer(length, column.type, TaskContext.get().partitionId())
            i = 0
            for part in blocks(b.column("text")):
                for doc, text in zip(column.slice(i, len(part)).to_pylist(), part.to_pylist(), strict=True):
                    packer.add(doc, np.append(encode(text or ""), np.uint32(end)).astype("<u4"))
                    if len(packer.ids) >= GROUP:
                        packer.pack()
                    yield from packer.batches()
                i += len(part)
        if packer:
            packer.pack()
            yield from packer.batches(all_rows=True)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, length, ids) of pieces."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), joined.alias("ids"))


def op13_harmonic(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pieces(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
