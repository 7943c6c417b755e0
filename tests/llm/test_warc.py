from __future__ import annotations

import hashlib
import random

from arclattice.llm import warc
from arclattice.llm.common import Stage

MAGIC = "WARC/1.0\r\n"


def inner(n):
    """A whole record, as text."""
    return f"{MAGIC}WARC-Type: response\r\nWARC-Record-ID: <urn:page:99>\r\nContent-Length: {n}\r\n\r\nHTTP/1.1 200 OK\r\n\r\n" + "x" * n


def pages():
    same = "s" * 120
    return [
        (1, "http://a/", "plain é"),
        (2, None, None),
        (3, "http://a/WARC/1.0", "head" + MAGIC + "tail" + MAGIC),
        (4, "http://b/\r\n", inner(30) + "\r\n\r\n" + inner(0) + "\r\n\r\nmore" + MAGIC),
        (5, "u", inner(11)[: -len("x" * 11)]),
        (6, "u", MAGIC * 3),
        (7, "u", same), (8, "u", same), (8, "u", same), (None, "u", same),
        (9, "u", "short"), (10, "u", "short"), (11, "u", "\r\n\r\n" * 40),
    ]


def test_round_trip_with_magic_lines_in_payloads(spark):
    stage = Stage(spark)
    path = stage.path("archives")
    rows = pages()
    df = spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, payload string")
    warc.write_archives(df, path, stage, records=5)
    got = warc.read_archives(spark, path, stage).collect()
    payload = lambda r: (r[2] or "").encode()
    assert sorted((r.page_id or -1, r.payload_bytes, r.payload_digest) for r in got) == sorted((r[0] or -1, len(payload(r)), hashlib.sha256(payload(r)).hexdigest()) for r in rows)
    responses = {r.page_id: bytes(r.payload) for r in got if r.record_type == "response"}
    for r in rows:
        if r[0] not in (8, None):
            assert responses[r[0]] == payload(r)
    revisits = sorted((r.page_id or -1, r.refers_to) for r in got if r.record_type == "revisit")
    assert revisits == [(-1, 7), (8, 7), (8, 7)]


def test_repeated_smallest_page_has_one_response(spark):
    stage = Stage(spark)
    path = stage.path("archives")
    df = spark.createDataFrame([(1, "u", "t" * 200)] * 3, "page_id long, url string, html string")
    warc.write_archives(df, path, stage)
    assert sorted(r.record_type for r in warc.read_archives(spark, path, stage).collect()) == ["response", "revisit", "revisit"]


def test_empty_table(spark):
    stage = Stage(spark)
    path = stage.path("archives")
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), path, stage)
    assert warc.read_archives(spark, path, stage).count() == 0


def test_a_broken_chain_raises(spark):
    import pytest

    stage = Stage(spark)
    path = stage.path("archives")
    spark.createDataFrame([(inner(30) + "cut",)], "value string").coalesce(1).write.text(path)
    with pytest.raises(ValueError):
        warc.read_archives(spark, path, stage)


def test_chains_across_spans(spark, monkeypatch):
    monkeypatch.setattr(warc, "SPAN", 300)
    rng, rows, want = random.Random(9), [], set()
    for file in range(3):
        at = 0
        while at < 4000 * (file + 1):
            size = rng.choice((40, 90, 700))
            rows.append((file, at, at + size))
            want.add((file, at))
            # candidates inside the payload, some of which point at true records
            for inside in range(at + 7, at + size, 31):
                rows.append((file, inside, rng.choice((inside + 31, at + size, at + size + 5))))
            at += size
    out = [tuple(r) for r in warc.reached(spark.createDataFrame(rows, "file long, at long, next long"), Stage(spark)).collect()]
    assert len(out) == len(set(out)) and set(out) == want
