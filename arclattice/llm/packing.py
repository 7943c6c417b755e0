"""Packing token sequences of bounded length by the sum-of-squares rule.

Documents become ids of a public byte-level BPE (`path` names its tokenizers file) and an end id.
Longer ones are cut into pieces of `length` ids, whose first may be shorter. A piece goes where the
sum over residual gaps g of (open bins with gap g) squared becomes smallest, on ties the tightest;
a bin is opened only where none fits, and the longest pieces come first.

Pieces are dealt at random into groups of about GROUP, whatever the corpus, and tasks pack the groups
side by side: their lengths are distributed alike, so that packing them together would only spare the
few bins that each group leaves open at its end.

Null text counts as empty: one piece that holds the end id. Texts may be of any length. Rows are packed
one by one, repeated ones or ones without doc_id too; ties in length go in the order of their rows.
Columns beside doc_id and text are not read; an empty table gives an empty one.
"""

from __future__ import annotations

import json
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stage, table, trim
from .toxicity import blocks

LENGTH = 1024
END = 2
#: Pieces that one task packs, about. A group ends with a handful of bins that could take more.
GROUP = 100_000

_encoders: dict[str, tuple] = {}


def encoder(path: str):
    """Texts to id arrays, the ids of tokenizers' encode(text, add_special_tokens=False).

    Text without an added token is encoded by tiktoken from the same vocabulary, which is faster.
    """
    if path not in _encoders:
        import tiktoken

        slow = []
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        added = [x["content"] for x in spec["added_tokens"]]
        shown = [b for b in range(256) if chr(b).isprintable() and b not in (0x20, 0xAD)]
        byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
        ranks = {bytes(byte[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in added}
        fast = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

        def encode(text: str) -> np.ndarray:
            if not any(a in text for a in added):
                try:
                    return fast.encode_to_numpy(text, disallowed_special=())
                except BaseException as e:  # its regular expressions give up on huge runs of white space
                    if isinstance(e, (KeyboardInterrupt, SystemExit, MemoryError)):
                        raise
            if not slow:
                from tokenizers import Tokenizer

                slow.append(Tokenizer.from_file(path))
            return np.array(slow[0].encode(text, add_special_tokens=False).ids, np.uint32)

        _encoders[path] = encode
    return _encoders[path]


def tokenised(docs: DataFrame, path: str | None = None, length: int = LENGTH) -> DataFrame:
    """(doc_id, piece, start, length, ids): ids as little-endian unsigned 32-bit numbers."""
    path = path or public_tokenizers.path("byte_bpe_50k.json")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        encode = encoder(path)
        for b in batches:
            i = 0
            for part in blocks(b.column("text")):
                rows, piece, start, size, ids = [], [], [], [], []
                for k, text in enumerate(part.to_pylist()):
                    x = np.append(encode(text or ""), np.uint32(END)).astype("<u4")
                    first = (len(x) - 1) % length + 1 if len(x) > length else len(x)
                    cuts = [0, *range(first, len(x) + 1, length)]
                    for j, (p, q) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                        rows.append(i + k)
                        piece.append(j)
                        start.append(p)
                        size.append(q - p)
                        ids.append(x[p:q].tobytes())
                columns = [b.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(ids, pa.binary())]
                yield pa.record_batch(columns, ["doc_id", "piece", "start", "length", "ids"])
                i += len(part)
        trim()

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids binary")


def sum_of_squares(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The bin and the offset of each piece; the longest pieces come first, ties in the order given."""
    n = np.zeros(capacity + 1)  # open bins by gap; a full bin is closed
    at: dict[int, list[int]] = defaultdict(list)
    bin_of, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    bins = 0
    for k in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[k])
        rest = capacity - size
        # change of the sum of squares, halved, when a bin of gap size..capacity takes the piece
        change = np.where(n[size:] > 0, n[: rest + 1] - n[size:] + 1, np.inf)
        change[0] = 0.5 - n[size] if n[size] > 0 else np.inf
        g = int(change.argmin())
        if change[g] < np.inf:
            b = at[g + size].pop()
            n[g + size] -= 1
        else:
            b, g = bins, rest
            bins += 1
        bin_of[k], offset[k] = b, capacity - g - size
        if g:
            at[g].append(b)
            n[g] += 1
    return bin_of, offset


def packed(pieces: DataFrame, stage: Stage, length: int = LENGTH) -> DataFrame:
    """pieces (doc_id, piece, start, length, ...) with sequence_id and offset.

    Rows are dealt at random into groups of about GROUP, each of which a task packs by itself.
    """
    rows = stage.put(pieces.withColumn("_row", F.monotonically_increasing_id()), "pieces")
    groups = max(1, -(-rows.count() // GROUP))

    def place(t: pa.Table) -> pa.Table:
        t = t.sort_by("_row")
        b, offset = sum_of_squares(t.column("length").to_numpy(), length)
        group = t.column("_group").to_numpy()
        return pa.table({"_row": t.column("_row"), "sequence_id": (group << 32) + b, "offset": offset})

    dealt = rows.select("_row", "length", F.pmod(F.xxhash64("_row"), F.lit(groups).cast("long")).alias("_group"))
    places = stage.put(dealt.groupBy("_group").applyInArrow(place, "_row long, sequence_id long, offset long"), "places")
    return rows.join(places, "_row").select(*pieces.columns, "sequence_id", "offset")


def sequences(pieces: DataFrame) -> DataFrame:
    """(sequence_id, length, ids) of packed pieces that carry their ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    return pieces.groupBy("sequence_id").agg(F.sum("length").alias("length"), joined.alias("ids"))


def placements(docs: DataFrame, stage: Stage) -> DataFrame:
    """Every piece's place, its ids as their checksum."""
    pieces = tokenised(docs).select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return packed(pieces, stage)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placements(table(spark, sf_dir, "documents"), Stage(spark))
