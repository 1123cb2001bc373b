"""WARC archives: written with Spark's text sink, read back by verified boundary chains.

Writing: a row is one record, and the sink's line separator is the blank line pair that ends a
record, so the part files are WARC files. Equal payloads are stored once; the others are revisit
records. Reading: Spark's text source, split at the magic line, gives the bytes between magic lines,
by byte ranges; tasks emit for each the offset of the record it would be and of that record's
successor. Magic lines inside payloads give candidates too. Pointer jumping from each file's start,
inside ranges and then between them by joins, keeps the reachable ones only.
"""

from __future__ import annotations

import base64
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.scratch import bounded_broadcast, materialize, scratch_path

MAGIC, END = b"WARC/1.1\r\n", b"\r\n\r\n"
RECORD = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
# Bytes of a file for which spanning records and their segments meet in a join.
SPAN = 1 << 20
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_PLAIN, _BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def payload_digest(payload: Column) -> Column:
    """Bare upper-case base32 SHA-1, 20 bits at a time."""
    hexed = F.sha1(payload)
    parts = [F.translate(F.lpad(F.conv(F.substring(hexed, 1 + 5 * k, 5), 16, 32), 4, "0"), _PLAIN, _BASE32) for k in range(8)]
    return F.concat(*parts)


def write_warc(pages: DataFrame, path: str, min_revisit_bytes: int = 0) -> None:
    """Write a record for every row of ``pages`` (page_id, url, html; null html: empty payload).

    Of equal payloads of at least ``min_revisit_bytes`` bytes the row with the largest page_id is
    the response, others are revisits of it; rows that repeat that page_id are responses too. Rows
    whose group has only null ids are responses.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.regexp_replace(F.coalesce(F.col("url").cast("string"), F.lit("")), r"[\r\n]", "").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("digest", payload_digest(F.col("payload")))
    groups = rows.filter(F.col("payload_bytes") >= min_revisit_bytes).groupBy("digest").agg(F.max("page_id").alias("keep"), F.count("*").alias("n"))
    shared = materialize(groups.filter("n > 1").select("digest", "keep"), "payloads")
    rows = rows.join(bounded_broadcast(shared), "digest", "left")
    revisit = F.coalesce(F.col("keep") != F.col("page_id"), F.col("keep").isNotNull() & F.col("page_id").isNull())
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    nothing = F.lit("")
    record = F.concat(
        F.lit(MAGIC.decode()),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", urn(F.col("page_id"))),
        line("WARC-Target-URI", F.col("url")),
        line("WARC-Date", F.lit("2024-01-01T00:00:00Z")),
        F.when(revisit, line("WARC-Refers-To", urn(F.col("keep")))).otherwise(nothing),
        F.when(revisit, line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))).otherwise(nothing),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        line("X-Payload-Length", F.col("payload_bytes")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.lit(len(_HTTP)) + F.when(revisit, 0).otherwise(F.col("payload_bytes"))),
        F.lit("\r\n" + _HTTP),
        F.when(revisit, nothing).otherwise(F.col("payload")),
    )
    rows.select(record.alias("value")).write.option("lineSep", END.decode()).text(path)


def _field(head: bytes, name: bytes, pattern: bytes) -> bytes | None:
    found = re.search(rb"(?m)^" + name + rb": " + pattern + rb"\r?$", head)
    return found[1] if found else None


def _long(digits: bytes | None) -> int | None:
    """A number that fits 64 bits, else none: payloads may hold anything that looks like a field."""
    value = int(digits) if digits is not None and len(digits) <= 20 else None
    return value if value is not None and -(1 << 63) <= value < 1 << 63 else None


def _record(segment: bytes) -> tuple:
    """What a record that begins before ``segment`` would say: bytes to its successor, page_id, payload size, digest, type, refers_to, whole.

    None for the first if it is no record. ``whole``: the segment holds all of it, so a response's
    payload is known here; else size and digest are none.
    """
    end = segment.find(END)
    head = segment[: max(end, 0)]
    length = _long(_field(head, b"Content-Length", rb"([0-9]{1,18})"))
    if end < 0 or length is None:
        return None, None, None, None, None, None, False
    block = end + len(END)
    after = block + length + len(END)
    kind = (_field(head, b"WARC-Type", rb"([a-z]+)") or b"").decode()
    page, refers = (_long(_field(head, name, rb"<urn:page:(-?[0-9]{1,19})>")) for name in (b"WARC-Record-ID", b"WARC-Refers-To"))
    size = digest = None
    whole = after == len(segment)
    if kind == "revisit":
        size, digest = _long(_field(head, b"X-Payload-Length", rb"([0-9]{1,18})")), (_field(head, b"WARC-Payload-Digest", rb"sha1:([A-Z2-7]{32})") or b"").decode()
    elif whole:
        payload = segment[segment.find(END, block) + len(END) : block + length]
        size, digest = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
    return after + len(MAGIC), page, size, digest, kind, refers, whole


def _segments(spark: SparkSession, path: str) -> DataFrame:
    """path, file_size, block, value of the bytes between magic lines: Spark's text source reads byte ranges of large files in several tasks."""
    rows = spark.read.option("lineSep", MAGIC.decode()).option("pathGlobFilter", "part-*").text(path)
    meta = F.col("_metadata")
    return rows.select(meta["file_path"].alias("path"), meta["file_size"].alias("file_size"), meta["file_block_start"].alias("block"), F.col("value").cast("binary").alias("value"))


def _offsets(batch: pa.RecordBatch, state: list) -> list[int]:
    """Bytes of the same block before each segment; ``state`` (block, bytes so far) lives from batch to batch."""
    out = []
    for path, block, value in zip(batch.column("path").to_pylist(), batch.column("block").to_pylist(), batch.column("value"), strict=True):
        if state[0] != (path, block):
            state[:] = [(path, block), 0]
        out.append(state[1])
        state[1] += value.as_buffer().size + len(MAGIC)
    return out


def _candidates(batches):
    """Every place where a record could begin, with its successor and what a record there would say."""
    state: list = [None, 0]
    for batch in batches:
        rel = _offsets(batch, state)
        values = batch.column("value")
        said = list(zip(*[_record(v.as_buffer().to_pybytes()) for v in values], strict=True)) or [()] * 7
        sizes = [v.as_buffer().size + len(MAGIC) for v in values]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_()]
        columns = [batch.column(k) for k in ("path", "file_size", "block")] + [pa.array(rel, pa.int64()), pa.array(sizes, pa.int64())] + [pa.array(list(c), t) for c, t in zip(said, kinds, strict=True)]
        yield pa.RecordBatch.from_arrays(columns, ["path", "file_size", "block", "rel", "bytes", "step", "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "whole"])


def _last_inside(start: np.ndarray, following: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For sorted candidates: the place of each one's successor (n: not among them), and of the last one on its chain, by pointer jumping."""
    n = len(start)
    to = np.searchsorted(start, following)
    to[to < n] = np.where(start[to[to < n]] == following[to < n], to[to < n], n)
    last = np.where(to < n, to, np.arange(n))
    while True:
        further = last[last]
        if (further == last).all():
            return to, last
        last = further


def reachable(start: np.ndarray, following: np.ndarray, entry: np.ndarray) -> np.ndarray:
    """Which of the sorted candidates the chains from the entries reach, by pointer jumping in log(n) rounds."""
    to, _ = _last_inside(start, following)
    jump, kept = np.append(to, len(start)), np.append(entry, False)
    while True:
        kept[jump[kept]] = True
        kept[-1] = False
        further = jump[jump]
        if (further == jump).all():
            return kept[:-1]
        jump = further


def _exits(table: pa.Table) -> pa.Table:
    table = table.sort_by("start")
    start, following = table.column("start").to_numpy(), table.column("next").to_numpy()
    _, last = _last_inside(start, following)
    return pa.table({"path": table.column("path"), "at": start, "exit": following[last]})


def _kept(table: pa.Table) -> pa.Table:
    table = table.sort_by("start")
    keep = reachable(table.column("start").to_numpy(), table.column("next").to_numpy(), table.column("entry").to_numpy(zero_copy_only=False))
    return table.filter(pa.array(keep)).drop_columns(["entry"])


def _entries(found: DataFrame) -> DataFrame:
    """(path, at): where the chain from each file's start enters a block. Between blocks the pointers are doubled by joins."""
    reached = found.filter("start = 0").select("path", F.col("start").alias("at"))
    if found.filter("block > 0").isEmpty():
        return reached
    hops = materialize(found.select("path", "block", "start", "next").groupBy("path", "block").applyInArrow(_exits, "path string, at long, exit long"), "exits")
    ends = hops.select("path", F.col("exit").alias("at")).unionByName(reached).distinct()
    hops = materialize(hops.join(ends, ["path", "at"], "left_semi"), "hops")
    reached = materialize(reached, "reached")
    while not hops.isEmpty():
        reached = materialize(reached.unionByName(reached.join(hops, ["path", "at"]).select("path", F.col("exit").alias("at"))).distinct(), "reached")
        on = hops.select("path", F.col("at").alias("exit"), F.col("exit").alias("beyond"))
        hops = materialize(hops.join(on, ["path", "exit"]).select("path", "at", F.col("beyond").alias("exit")), "hops")
    return reached


def _spanning(spark: SparkSession, path: str, kept: DataFrame, segments: DataFrame) -> DataFrame:
    """payload_bytes and payload_digest of responses whose payload holds magic lines, put together from all their segments."""
    parts = segments.join(kept.select("path", "start", "next", F.explode(F.sequence(F.floor(F.col("start") / SPAN), F.floor(F.col("next") / SPAN))).alias("part")), ["path", "part"])
    parts = parts.filter((F.col("at") >= F.col("start")) & (F.col("at") < F.col("next"))).select("path", "block", "rel", "start", "at")

    def placed(batches):
        state: list = [None, 0]
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("block"), pa.array(_offsets(batch, state), pa.int64()), batch.column("value")], ["path", "block", "rel", "value"])

    bytes_of = _segments(spark, path).mapInArrow(placed, "path string, block long, rel long, value binary").join(parts, ["path", "block", "rel"])

    def digest(table: pa.Table) -> pa.Table:
        table = table.sort_by("at")
        record = MAGIC.join(table.column("value").to_pylist())
        block = record.find(END) + len(END)
        payload = record[record.find(END, block) + len(END) : -len(END)]
        return pa.table({"path": table.column("path")[:1], "start": table.column("start")[:1], "size": [len(payload)], "digest": [base64.b32encode(hashlib.sha1(payload).digest()).decode()]})

    return bytes_of.groupBy("path", "start").applyInArrow(digest, "path string, start long, size long, digest string")


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of the archives under ``path``: page_id, payload_bytes, payload_digest, record_type, refers_to.

    A file is read by byte ranges and no task holds more than one range's offsets and one record. A
    file whose chain of records does not lead from its first byte to its last is an error.
    """
    fields = "path string, file_size long, block long, rel long, bytes long, step long, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, whole boolean"
    rows = materialize(_segments(spark, path).mapInArrow(_candidates, fields), "segments")
    blocks = rows.groupBy("path", "block").agg(F.sum("bytes").alias("bytes"))
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = blocks.select("path", "block", F.coalesce(F.sum("bytes").over(before), F.lit(0).cast("long")).alias("base"))
    rows = rows.join(bounded_broadcast(bases), ["path", "block"]).withColumn("start", F.col("base") + F.col("rel") - len(MAGIC))
    found = rows.filter("start >= 0 and step is not null").withColumn("next", F.col("start") + F.col("step"))
    found = materialize(found.drop("base", "bytes", "step"), "candidates")

    entries = _entries(found).withColumn("entry", F.lit(True)).withColumnRenamed("at", "start")
    flagged = found.join(entries, ["path", "start"], "left").withColumn("entry", F.coalesce("entry", F.lit(False)))
    flagged = flagged.select("path", "block", "start", "next", "entry", *RECORD, "whole")
    schema = ", ".join(f"{k} {t}" for k, t in flagged.dtypes if k != "entry")
    kept = materialize(flagged.groupBy("path", "block").applyInArrow(_kept, schema), "records")

    files = rows.groupBy("path").agg(F.max("file_size").alias("file_size"), F.sum("bytes").alias("bytes"))
    ends = kept.groupBy("path").agg(F.max("next").alias("end"))
    whole = (F.col("bytes") - len(MAGIC) == F.col("file_size")) & (F.coalesce("end", F.lit(-1).cast("long")) == F.col("file_size"))
    if broken := files.join(ends, "path", "left").filter((F.col("file_size") > 0) & ~whole).select("path").head(1):
        raise ValueError(f"the record chain of {broken[0].path} does not lead from the file's start to its end")

    spanning = kept.filter("not whole and record_type <> 'revisit'")
    if spanning.isEmpty():
        return kept.select(*RECORD)
    at = rows.select("path", "block", "rel", (F.col("start")).alias("at")).withColumn("part", F.floor(F.col("at") / SPAN))
    late = materialize(_spanning(spark, path, spanning, at), "payloads")
    out = kept.join(late, ["path", "start"], "left").withColumns({"payload_bytes": F.coalesce("size", "payload_bytes"), "payload_digest": F.coalesce("digest", "payload_digest")})
    return out.select(*RECORD)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages`` as archives in the shared folder and read the records back.

    One row per row of ``pages``; null html is an empty payload, a null page_id comes back as null,
    other columns are ignored, no rows give no rows.
    """
    path = scratch_path(pages.sparkSession, "warc")
    write_warc(pages, path)
    return read_warc(pages.sparkSession, path)
