"""WARC records from a chunked record table.

A payload never needs to be one record: it is cut into chunks of at most `chunk` bytes, rows
(record id, chunk number, bytes) that carry the SHA-256 of the payload up to their end, which
one running hash gives as it passes over the chunks. A chunk becomes one archive record: the
first is the response, the others are `continuation` records with WARC-Segment-Number and
WARC-Segment-Origin-ID, as the standard's record segmentation has it, so the reader
holds a chunk of a record at a time; the writer also holds the cell that it cuts, within the
Arrow batch that brought it. Each segment says the digest so far, which the reader checks.

Archives are written by Spark's text sink, with the two line ends that close a WARC record for
its separator: they go to any store that Spark writes to, in files of at most max_records
records, and a task that is run again replaces its own files. The reader splits files at
record starts and so reads one archive in any number of tasks. No chunk holds the separator
before a record start (a chunk is cut where it would), so this split is exact; a record whose
length is not as its header says is an error, never a silent loss.

Every row is a record of its own. Its key is its id, and from the second row of an id on the
id with the row's number, `id.1`, `id.2`, ...: an id's payloads in the order of their digests,
equal payloads in the order of their URLs. Segments are put together by that key, and a
record whose segments, length or digest are not what its headers say is an error.

Of records with equal payloads of MIN_REVISIT bytes or more, those with the smallest id are
responses and the others are revisit records that name the first of them, with its digest and
length.

Defined results: a null payload is empty; rows without id are left out (there is nothing to
name the record by); rows that repeat an id give a record and a result each, whether their
payloads are equal or not; an empty table gives an empty archive; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillsift.llm.common import arrow_rows, cut

CHUNK, MIN_REVISIT, MAX_RECORDS = 1 << 20, 100, 50_000
#: Bits of the map of rows that are not plain responses, 8 MB for any number of rows, and those of one of its rows.
BITS, PAGE = 1 << 26, 1 << 15
START, END = b"WARC/1.1\r\n", b"\r\n\r\n"
_ID = "urn:quillsift:record:"
_DATE = "2024-01-01T00:00:00Z"


def chunks(payload: bytes, size: int = CHUNK) -> Iterator[tuple[int, bytes, str]]:
    """(number, bytes, digest so far) of the chunks of a payload; one empty chunk for an empty one."""
    view, at, k, running = memoryview(payload), 0, 0, hashlib.sha256()
    mark = END + START
    while True:
        end = min(at + size, len(payload))
        hit = payload.find(mark, at, min(end + len(mark), len(payload)))
        if hit >= 0 and hit < end:  # neither a chunk nor a chunk with what closes its record may hold the mark
            end = hit + len(END) + 1
        if payload.startswith(START, at):  # nor may its header's end make one with its beginning
            end = at + 1
        part = bytes(view[at:end])
        running.update(part)
        yield k, part, running.copy().hexdigest()
        at, k = end, k + 1
        if at >= len(payload):
            return


def payload_table(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html") -> DataFrame:
    """(id, n_bytes, digest) of every record's whole payload; repeated ids give one row each."""
    html = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    return pages.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.octet_length(html).cast("long").alias("n_bytes"), F.sha2(html, 256).alias("digest"))


def record_types(payloads: DataFrame) -> DataFrame:
    """(id, digest, n_bytes, times, start, refers_to, refers_copy), a row per id and payload: how many rows have both, the number of the first of them among the id's rows, and the record that a revisit names; refers_to is null for responses."""
    one = payloads.groupBy("id", "digest", "n_bytes").agg(F.count("*").alias("times"))
    before = Window.partitionBy("id").orderBy("digest").rowsBetween(Window.unboundedPreceding, -1)
    one = cut(one.withColumn("start", F.coalesce(F.sum("times").over(before), F.lit(0))), "numbered")
    first = one.where(F.col("n_bytes") >= MIN_REVISIT).groupBy("digest").agg(F.min(F.struct("id", "start")).alias("first"), F.count("*").alias("m")).where("m > 1").select("digest", "first")
    out = one.join(first, "digest", "left").withColumn("first", F.when((F.col("first.id") < F.col("id")) & (F.col("n_bytes") >= MIN_REVISIT), F.col("first")))
    return out.select("id", "digest", "n_bytes", "times", "start", F.col("first.id").alias("refers_to"), F.col("first.start").alias("refers_copy"))


def _key(record: int, copy: int | None) -> str:
    return f"{record}.{copy}" if copy else f"{record}"


def _header(kind: str, length: int, fields: list[tuple[str, object]]) -> bytes:
    lines = [("WARC-Type", kind), ("WARC-Date", _DATE), *fields, ("Content-Type", "text/html; charset=utf-8"), ("Content-Length", length)]
    return START + "".join(f"{k}: {v}\r\n" for k, v in lines).encode() + b"\r\n"


def _line(url: str | None) -> str:
    return "".join(c if c > " " else "%20" for c in url or "urn:unknown")


def records(key: str, url: str | None, html: bytes, n_bytes: int, digest: str, refers_to: str | None, size: int = CHUNK) -> Iterator[bytes]:
    """The archive records of one page, without the two line ends that close each; key and refers_to are record keys."""
    common = [("WARC-Target-URI", _line(url)), ("WARC-Payload-Digest", f"sha256:{digest}"), ("X-Payload-Length", n_bytes)]
    own = ("WARC-Record-ID", f"<{_ID}{key}>")
    if refers_to is not None:
        yield _header("revisit", 0, [own, ("WARC-Refers-To", f"<{_ID}{refers_to}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), *common])
        return
    held = None  # one chunk behind, for only the last says that it is
    for k, part, running in chunks(html, size):
        if held is not None:
            yield _segment(key, *held, common, last=False)
        held = k, part, running
    yield _segment(key, *held, common, last=True)


def _segment(key: str, k: int, part: bytes, running: str, common: list, last: bool) -> bytes:
    fields = [("WARC-Record-ID", f"<{_ID}{key}>" if not k else f"<{_ID}{key}:{k + 1}>"), *common]
    fields.append(("X-Running-Digest", f"sha256:{running}"))
    if k or not last:
        fields.append(("WARC-Segment-Number", k + 1))
    if k:
        fields.append(("WARC-Segment-Origin-ID", f"<{_ID}{key}>"))
        if last:
            fields.append(("WARC-Segment-Total-Length", dict(common)["X-Payload-Length"]))
    return _header("response" if not k else "continuation", len(part), fields) + part


def _slot() -> Column:
    return F.pmod(F.xxhash64("id", "digest"), F.lit(BITS))


def _marked(special: DataFrame) -> DataFrame:
    """(page, bits): a map of BITS bits in which those of special's (id, digest) are set."""

    def run(batches):
        bits: dict[int, np.ndarray] = {}
        for b in batches:
            for slot in b.column(0).to_pylist():
                bits.setdefault(slot // PAGE, np.zeros(PAGE, bool))[slot % PAGE] = True
        if bits:
            maps = [np.packbits(x, bitorder="little").tobytes() for x in bits.values()]
            yield pa.RecordBatch.from_arrays([pa.array(bits, pa.int64()), pa.array(maps, pa.binary())], names=["page", "bits"])

    slots = special.select(_slot().alias("slot"))
    return cut(slots.repartition(F.expr(f"slot div {PAGE}")).mapInArrow(run, "page long, bits binary"), "marked")


def _parted(rows: DataFrame, marked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows (id, digest, ...) that are not marked, and those that are or share a bit of one that is."""
    found = rows.withColumn("slot", _slot()).withColumn("page", F.expr(f"slot div {PAGE}")).join(F.broadcast(marked), "page", "left")
    byte = F.conv(F.hex(F.expr(f"substring(bits, cast((slot % {PAGE}) div 8 + 1 as int), 1)")), 16, 10).cast("int")
    hit = F.coalesce(byte.bitwiseAND(F.expr("shiftleft(1, cast(slot % 8 as int))")) != 0, F.lit(False))
    found = found.withColumn("hit", hit).drop("slot", "page", "bits")
    return found.where("not hit").drop("hit"), found.where("hit").drop("hit")


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", payload_col: str = "html", url_col: str | None = "url", chunk: int = CHUNK, max_records: int = MAX_RECORDS) -> None:
    """Writes the pages as archives in the folder path; mode overwrite.

    Types are found from ids and digests. Payloads are written where they are read, but for those of revisits and of
    repeated ids, which are joined with what they are; a map of bits of fixed size tells which these are, and a row
    that shares its bit with one of them is only joined for nothing.
    """
    types = record_types(cut(payload_table(pages, id_col, payload_col), "payloads"))
    special = cut(types.where("times > 1 or start > 0 or refers_to is not null"), "types")
    url = F.col(url_col).cast("string") if url_col in pages.columns else F.lit(None).cast("string")
    base = pages.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), url.alias("url"), F.col(payload_col).cast("binary").alias("html"))
    html = F.coalesce("html", F.lit(b""))
    base = base.withColumn("digest", F.sha2(html, 256)).withColumn("n_bytes", F.octet_length(html).cast("long"))
    plain, rest = _parted(base, _marked(special))
    none = F.lit(None).cast("long")
    plain = plain.select("id", F.lit(0).cast("long").alias("copy"), "url", "html", "n_bytes", "digest", none.alias("refers_to"), none.alias("refers_copy"))
    rows = rest.join(special.drop("n_bytes"), ["id", "digest"], "left")
    rows = rows.withColumns({"times": F.coalesce("times", F.lit(1)), "start": F.coalesce("start", F.lit(0))})
    rows = rows.withColumn("html", F.when(F.col("refers_to").isNull(), F.col("html")))
    numbered = rows.where("times = 1").withColumn("copy", F.col("start"))
    if not special.where("times > 1").isEmpty():  # only equal payloads of one id must be counted row by row
        order = Window.partitionBy("id", "digest").orderBy("url")
        numbered = numbered.union(rows.where("times > 1").withColumn("copy", F.col("start") + F.row_number().over(order) - 1))
    base = plain.union(numbered.select("id", "copy", "url", "html", "n_bytes", "digest", "refers_to", "refers_copy"))

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):  # a cell at a time
                page, copy, url, html, n, digest, refers, refers_copy = (c[i].as_py() for c in b.columns)
                to = None if refers is None else _key(refers, refers_copy)
                for record in records(_key(page, copy), url, html or b"", n, digest, to, chunk):
                    yield pa.RecordBatch.from_arrays([pa.array([record], pa.binary())], names=["value"])

    def grouped(batches):
        held, size = [], 0
        for b in run(batches):
            held.append(b)
            size += b.nbytes
            if size >= 1 << 23:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size = [], 0
        if held:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    out = base.mapInArrow(grouped, "value binary").select(F.col("value").cast("string").alias("value"))
    out.write.mode("overwrite").option("lineSep", END.decode()).option("maxRecordsPerFile", max_records).text(path)


def parse(record: bytes) -> dict:
    """Header fields and content of one record that the reader's split gives."""
    head, found, rest = record.removeprefix(START).partition(END)
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n"))
    n = int(fields["Content-Length"])
    content, tail = rest[:n], rest[n:]
    if not found or len(content) != n or tail.strip(b"\r\n"):
        raise ValueError(f"a record's length is not the {n} of its header: {fields.get('WARC-Record-ID')}")
    return fields | {"content": content}


def _number(field: str) -> tuple[int, int]:
    """Id and copy that a record's name holds."""
    page, _, copy = field.strip("<>").removeprefix(_ID).split(":")[0].partition(".")
    return int(page), int(copy or 0)


_TABLE = "id long, copy long, type string, segment long, part binary, refers_to long, refers_copy long, digest string, n_bytes long, running string"


def _parsed(spark: SparkSession, path: str, make_row: Callable, schema: str) -> DataFrame:
    lines = spark.read.option("lineSep", (END + START).decode()).text(path).select(F.col("value").cast("binary"))

    def make(cols):
        for record in cols[0]:
            if not record.strip(b"\r\n"):
                continue
            f = parse(record)
            page, copy = _number(f.get("WARC-Segment-Origin-ID", f["WARC-Record-ID"]))
            refers, refers_copy = _number(f["WARC-Refers-To"]) if "WARC-Refers-To" in f else (None, None)
            segment = int(f.get("WARC-Segment-Number", 1)) - 1
            yield [[x] for x in make_row((page, copy, f["WARC-Type"], segment, f["content"], refers, refers_copy, f["WARC-Payload-Digest"].removeprefix("sha256:"), int(f["X-Payload-Length"]), f.get("X-Running-Digest", "").removeprefix("sha256:") or None))]

    return arrow_rows(lines, schema, make, flush=256)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The record table of the archives in path: id, copy (the row's number among those of the id), type, segment (from 0), part, refers_to, refers_copy, digest and n_bytes (of the payload, as declared), running (the digest up to the segment's end, as declared; null for revisits)."""
    return _parsed(spark, path, lambda row: row, _TABLE)


def _checked(key: str, n: int, digest: str, declared_n: int, declared: str) -> None:
    if (n, digest) != (declared_n, declared):
        raise ValueError(f"record {key} has {n} bytes of sha256:{digest}, not the {declared_n} of sha256:{declared} of its header")


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """Per record: id, payload_bytes, payload_digest, record_type, refers_to, the two computed from what was read; those of a revisit are of the response that it names.

    A record of one segment is hashed where it is read; segments of longer records are dealt by record and
    streamed in order through one running hash, a segment at a time, which each segment's own must equal.
    """

    def hashed(row):
        page, copy, kind, segment, part, refers, refers_copy, digest, n, running = row
        if kind == "response" and len(part) == n:  # whole: its bytes go no further
            _checked(_key(page, copy), len(part), hashlib.sha256(part).hexdigest(), n, digest)
            _checked(_key(page, copy), len(part), digest, n, running)
            part = None
        return page, copy, kind, segment, part, refers, refers_copy, digest, n, running

    table = cut(_parsed(spark, path, hashed, _TABLE), "segments")
    whole = table.where("type = 'response' and part is null").select("id", "copy", F.col("n_bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"))
    pieces = table.where("type <> 'revisit' and part is not null").select("id", "copy", "segment", "part", "digest", "n_bytes", "running")

    def run(batches):
        at = so_far = None
        n = k = 0

        def row():
            _checked(_key(*at[:2]), n, so_far.hexdigest(), at[3], at[2])
            return pa.RecordBatch.from_arrays([pa.array([at[0]], pa.int64()), pa.array([at[1]], pa.int64()), pa.array([n], pa.int64()), pa.array([so_far.hexdigest()])], names=["id", "copy", "payload_bytes", "payload_digest"])

        for b in batches:
            for i in range(b.num_rows):
                page, copy, segment, part, digest, total, running = (c[i].as_py() for c in b.columns)
                if at is None or (page, copy) != at[:2]:
                    if at is not None:
                        yield row()
                    at, n, k, so_far = (page, copy, digest, total), 0, 0, hashlib.sha256()
                so_far.update(part)
                n += len(part)
                if segment != k or so_far.hexdigest() != running:
                    raise ValueError(f"record {_key(page, copy)}: segment {segment} is not the one to follow {k} others")
                k += 1
        if at is not None:
            yield row()

    long = pieces.repartition("id", "copy").sortWithinPartitions("id", "copy", "segment").mapInArrow(run, whole.schema)
    responses = cut(whole.union(long), "responses")
    named = responses.select(F.col("id").alias("refers_to"), F.col("copy").alias("refers_copy"), "payload_bytes", "payload_digest")
    revisit = table.where("type = 'revisit'").select("id", "refers_to", "refers_copy", "n_bytes", "digest").join(named, ["refers_to", "refers_copy"], "left")
    right = F.col("payload_bytes").eqNullSafe(F.col("n_bytes")) & F.col("payload_digest").eqNullSafe(F.col("digest"))
    wrong = F.raise_error(F.concat(F.lit("no response has the payload of revisit record "), F.col("id").cast("string"))).cast("boolean")
    revisit = revisit.where(F.when(right, True).otherwise(wrong))
    out = responses.select("id", "payload_bytes", "payload_digest", F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to"))
    return out.union(revisit.select("id", "payload_bytes", "payload_digest", F.lit("revisit"), "refers_to"))


def page_records(pages: DataFrame, path: str, id_col: str = "page_id", **options) -> DataFrame:
    """Writes the pages to path and reads the archives back: id_col, payload_bytes, payload_digest, record_type, refers_to."""
    write_warc(pages, path, id_col, **options)
    return read_payloads(pages.sparkSession, path).withColumnRenamed("id", id_col)
