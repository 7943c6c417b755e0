"""WARC archives written and read back by Spark, with record boundaries verified along their chain.

Writing: one record for each page, its payload the UTF-8 html behind a short HTTP head. Of equal
payloads of at least LEAST bytes the one with the smallest page_id is a response, the others are
revisits that name it and hold no payload. Spark's text writer writes the records, gzipped, at most
`records` to a file.

Reading: the text reader cuts each file at every "WARC/1.0" line, also where a payload holds one.
Each such place is a candidate; its Content-Length says where its successor must start. From the
start of each file, pointer jumping finds the candidates that the chain reaches: the jumps double
within each span of a file, in its task, and from span to span in rounds of joins. The other
candidates are payload bytes and go back into their record. A chain that does not end where its file
ends raises an error.

Null html is an empty payload; html may be of any length and hold magic lines. A null page_id is kept;
it never names a response, so equal payloads that all lack a page_id are responses. Of rows that repeat
the smallest page_id one is the response. Other columns are not read, whatever their names; an
empty table gives an empty one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stage, key_join, maybe_in, running_total, table

#: Fixed values of the format.
MAGIC = "WARC/1.0\r\n"
END = "\r\n\r\n"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8"
LEAST = 100
RECORDS = 1024
#: Bytes of a file whose candidates one task chains.
SPAN = 64 << 20


def typed(pages: DataFrame, stage: Stage) -> DataFrame:
    """pages (page_id, url, html) with payload_bytes, digest, record_type and refers_to; html is null for revisits."""
    html = F.coalesce("html", F.lit(""))
    base = pages.select("page_id", "url", html.alias("html"), F.octet_length(html).cast("long").alias("payload_bytes"), F.sha2(html, 256).alias("digest"))
    groups = base.filter(F.col("payload_bytes") >= LEAST).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    groups = stage.put(groups.filter("n > 1 and first is not null").drop("n"), "groups")
    flagged = maybe_in(base.withColumn("_h", F.xxhash64("digest")), "_h", groups.select(F.xxhash64("digest").alias("id"))).drop("_h")
    maybe = F.col("_maybe") & (F.col("payload_bytes") >= LEAST)
    single = flagged.filter(~maybe).drop("_maybe").withColumn("first", F.lit(None).cast("long")).withColumn("again", F.lit(1))
    several = stage.put(flagged.filter(maybe).drop("_maybe").withColumn("_row", F.monotonically_increasing_id()), "several")
    # of the rows that repeat a page the later ones, without their html; rows without page_id are no responses anyway
    slim = several.filter(F.col("page_id").isNotNull()).select("digest", "page_id", "_row")
    later = slim.join(slim.groupBy("digest", "page_id").agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1"), ["digest", "page_id"])
    later = stage.put(later.filter("_row > _first").select("_row", F.lit(2).alias("again")), "later")
    several = key_join(several, groups, "digest", stage, "_row").join(later, "_row", "left").drop("_row").withColumn("again", F.coalesce("again", F.lit(1)))
    rows = single.unionByName(several)
    response = F.col("first").isNull() | (F.col("page_id").eqNullSafe(F.col("first")) & (F.col("again") == 1))
    rows = rows.withColumn("record_type", F.when(response, "response").otherwise("revisit"))
    return rows.withColumn("refers_to", F.when(~response, F.col("first"))).withColumn("html", F.when(response, F.col("html"))).drop("first", "again")


def write_archives(pages: DataFrame, path: str, stage: Stage, records: int = RECORDS) -> None:
    rows = typed(pages, stage)
    uri = F.regexp_replace(F.regexp_replace("url", "[\r\n]", ""), r"WARC/1\.0$", "WARC/1%2E0")
    response = F.col("record_type") == "response"
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("none")), F.lit(">"))
    content = F.when(response, F.concat(F.lit(HTTP + END), "html")).otherwise("")
    record = F.concat(
        F.lit(MAGIC),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", urn("page_id")),
        F.coalesce(line("WARC-Target-URI", uri), F.lit("")),
        F.when(response, "").otherwise(line("WARC-Refers-To", urn("refers_to"))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "digest")),
        line("X-Payload-Bytes", F.col("payload_bytes").cast("string")),
        F.when(response, line("Content-Type", F.lit("application/http; msgtype=response"))).otherwise(""),
        F.lit("Content-Length: "), F.octet_length("content").cast("string"), F.lit(END), "content",
    )
    out = rows.withColumn("content", content).select(record.alias("value"))
    out.write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", records).text(path)


def header(head: Column, name: str) -> Column:
    return F.regexp_extract(head, rf"(?i)(?:^|\r\n){name}:[ \t]*([^\r\n]*)", 1)


def lines(spark: SparkSession, path: str) -> DataFrame:
    """What lies between the magic lines: (value, file, block, seq), seq ascending within a block."""
    text = spark.read.option("lineSep", MAGIC).text(path)
    return text.select("value", F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("seq"))


def placed(rows: DataFrame, stage: Stage) -> DataFrame:
    """rows (file, block, seq, n, ...) with `at`, the byte of the file where their text starts."""
    rows = stage.put(rows.withColumn("step", F.col("n") + len(MAGIC)), "lines")
    return running_total(rows, ["file"], ["block", "seq"], "step", "at", stage, rows.count()).drop("step")


def fragments(spark: SparkSession, path: str, payload: bool, stage: Stage) -> DataFrame:
    """The parsed lines in order; `whole` if a line is a record up to its last byte."""
    text = lines(spark, path)
    head = F.substring_index("value", END, 1)
    rows = text.withColumn("head", F.when(F.contains("value", F.lit(END)), head))
    rows = rows.withColumn("n", F.octet_length("value").cast("long")).withColumn("h", F.octet_length("head").cast("long"))
    rows = rows.withColumn("content", header(F.col("head"), "Content-Length").try_cast("long"))
    rows = rows.withColumn("whole", F.coalesce(F.col("n") == F.col("h") + F.col("content") + 2 * len(END), F.lit(False)))
    body = payload_of(F.col("value").cast("binary"), F.octet_length(F.substring_index("value", END, 2)), F.col("h"), F.col("content"))
    rows = rows.withColumn("payload", F.when(F.col("whole") & (header(F.col("head"), "WARC-Type") == "response"), body))
    rows = rows.withColumn("read_bytes", F.octet_length("payload").cast("long")).withColumn("read_digest", F.sha2("payload", 256))
    keep = "payload" if payload else F.lit(None).cast("binary").alias("payload")
    rows = rows.select("file", "block", "seq", "n", "h", "content", "whole", "head", "read_bytes", "read_digest", keep)
    return stage.put(placed(stage.put(rows, "fragments"), stage), "placed")


def payload_of(raw: Column, to_http: Column, h: Column, content: Column) -> Column:
    """Bytes after the HTTP head of a record's content."""
    return F.substring(raw, to_http + len(END) + 1, (content - (to_http - h)).cast("int"))


def jumps(at: np.ndarray, after: np.ndarray) -> np.ndarray:
    """For each of the ascending places the index of its successor among them, or its own."""
    k = np.minimum(np.searchsorted(at, after), len(at) - 1)
    return np.where(at[k] == after, k, np.arange(len(at)))


def exits(t: pa.Table) -> pa.Table:
    """Where the chain from each candidate of a span leaves it; by doubled jumps."""
    t = t.sort_by("at")
    after = t.column("next").to_numpy()
    jump = jumps(t.column("at").to_numpy(), after)
    for _ in range(len(jump).bit_length()):
        jump = jump[jump]
    return pa.table({"file": t.column("file"), "at": t.column("at"), "next": after[jump]})


def on_chain(t: pa.Table) -> pa.Table:
    """The candidates of a span that its entry reaches; by doubled jumps."""
    t = t.sort_by("at")
    jump, seen = jumps(t.column("at").to_numpy(), t.column("next").to_numpy()), t.column("entry").to_numpy(zero_copy_only=False).copy()
    for _ in range(len(jump).bit_length()):
        seen[jump[seen]] = True
        jump = jump[jump]
    return t.select(["file", "at"]).filter(pa.array(seen))


def entries(candidates: DataFrame, stage: Stage) -> DataFrame:
    """(file, at) of the candidates where each file's chain starts and where it enters a further span.

    Only files of several spans take rounds, as many as the doubled jumps over their spans need.
    """
    first = candidates.filter("at = 0").select("file", "at")
    long_files = candidates.filter(F.col("at") >= SPAN).select("file").distinct()
    several = candidates.join(long_files, "file", "left_semi")
    left = several.groupBy("file", "span").applyInArrow(exits, "file long, at long, next long")
    # chains that leave a span at a candidate of another one
    jump = left.join(candidates.select("file", F.col("at").alias("next")), ["file", "next"], "left_semi")
    jump = stage.put(jump.select("file", "at", "next"), "jumps")
    seen = stage.put(first, "seen")
    count = seen.count()
    while not jump.isEmpty():
        more = stage.put(seen.unionByName(seen.join(jump, ["file", "at"]).select("file", F.col("next").alias("at"))).distinct(), "seen")
        stage.drop(seen)
        seen, n = more, more.count()
        if n == count:
            break
        count = n
        step = jump.select("file", F.col("at").alias("next"), F.col("next").alias("far"))
        twice = stage.put(jump.join(step, ["file", "next"]).select("file", "at", F.col("far").alias("next")), "jumps")
        stage.drop(jump)
        jump = twice
    return seen


def reached(candidates: DataFrame, stage: Stage) -> DataFrame:
    """(file, at) of the candidates (file, at, next) on the chain from each file's first.

    Files are cut into spans of SPAN bytes; tasks jump within a span, rounds from span to span.
    """
    spans = candidates.withColumn("span", F.floor(F.col("at") / SPAN))
    start = entries(spans, stage).withColumn("entry", F.lit(True))
    marked = spans.join(start, ["file", "at"], "left").withColumn("entry", F.coalesce("entry", F.lit(False)))
    return stage.put(marked.groupBy("file", "span").applyInArrow(on_chain, "file long, at long"), "reached")


def rejoined(spark: SparkSession, path: str, rows: DataFrame, payload: bool, stage: Stage) -> DataFrame:
    """Records that hold magic lines, put together again from all lines up to the next record."""
    own = rows.withColumn("one", F.when(F.coalesce("real", F.lit(False)), 1).otherwise(0))
    own = running_total(own, ["file"], ["block", "seq"], "one", "record", stage, rows.count()).withColumn("record", F.col("record") + F.col("one"))
    parted = stage.put(own.filter("real and not whole").select("file", "record", "head", "h", "content"), "parted")
    pieces = stage.put(own.select("file", "at", "record").join(parted.select("file", "record"), ["file", "record"], "left_semi"), "pieces")
    again = lines(spark, path).join(parted.select("file").distinct(), "file", "left_semi")
    again = again.select("file", "block", "seq", F.octet_length("value").cast("long").alias("n"), F.col("value").cast("binary").alias("raw"))
    found = placed(stage.put(again, "lines"), stage).join(pieces, ["file", "at"])
    parts = F.array_sort(F.collect_list(F.struct("at", "raw")))
    joined = F.aggregate(parts, F.lit(b""), lambda a, x: F.concat(a, F.lit(MAGIC.encode()), x["raw"]))
    made = found.groupBy("file", "record").agg(F.substring(joined, len(MAGIC) + 1, (1 << 31) - 1).alias("raw"))
    both = parted.join(made, ["file", "record"])
    to_http = F.octet_length(F.substring_index(F.col("raw").cast("string"), END, 2))
    body = F.when(header(F.col("head"), "WARC-Type") == "response", payload_of(F.col("raw"), to_http, F.col("h"), F.col("content")))
    keep = "payload" if payload else F.lit(None).cast("binary").alias("payload")
    out = both.withColumn("payload", body).withColumn("read_bytes", F.octet_length("payload").cast("long")).withColumn("read_digest", F.sha2("payload", 256))
    return out.select("head", "read_bytes", "read_digest", keep)


def read_archives(spark: SparkSession, path: str, stage: Stage, payload: bool = True) -> DataFrame:
    """(page_id, target_uri, record_type, refers_to, payload_bytes, payload_digest, payload), a row for each record."""
    parts = fragments(spark, path, payload, stage)
    magic = F.col("at") - len(MAGIC)
    size = F.col("h") + F.col("content") + 2 * len(END)
    able = parts.filter("at > 0 and content >= 0").select("file", magic.alias("at"), (F.col("at") + size).alias("next"))
    able = stage.put(able, "candidates")
    real = reached(able, stage)
    ends = parts.groupBy("file").agg(F.max(F.col("at") + F.col("n")).alias("end"))
    last = able.join(real, ["file", "at"]).groupBy("file").agg(F.max("next").alias("next"))
    broken = ends.join(last, "file", "left").filter("not (next <=> end)").filter("end > 0")
    if not broken.isEmpty():
        raise ValueError(f"{path}: a chain of records does not end with its file")
    rows = parts.withColumn("mark", magic).join(real.withColumnRenamed("at", "mark").withColumn("real", F.lit(True)), ["file", "mark"], "left")
    rows = stage.put(rows, "marked")
    whole = rows.filter("real and whole").select("head", "read_bytes", "read_digest", "payload")
    parted = rows.filter("real and not whole").select("file", "mark")
    if not parted.isEmpty():
        whole = whole.unionByName(rejoined(spark, path, rows, payload, stage))
    records = whole
    get = lambda name: header(F.col("head"), name)
    number = lambda name: F.regexp_extract(get(name), r"<urn:page:(-?\d+)>", 1).try_cast("long")
    return records.select(
        number("WARC-Record-ID").alias("page_id"), F.nullif(get("WARC-Target-URI"), F.lit("")).alias("target_uri"), get("WARC-Type").alias("record_type"), number("WARC-Refers-To").alias("refers_to"),
        F.coalesce("read_bytes", get("X-Payload-Bytes").try_cast("long")).alias("payload_bytes"), F.coalesce("read_digest", F.regexp_extract(get("WARC-Payload-Digest"), "sha256:(.*)", 1)).alias("payload_digest"), "payload",
    )


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    stage = Stage(spark)
    path = stage.path("archives")
    write_archives(table(spark, sf_dir, "pages").select("page_id", "url", "html"), path, stage)
    out = read_archives(spark, path, stage, payload=False)
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
