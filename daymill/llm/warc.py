"""WARC archives with one dictionary-compressed Zstandard frame per record.

Each task writes archives of a bounded size.  An archive's dictionary is built from all its own records
and stands in a skippable frame at its start; every record is a frame of its own, so one can be
read alone.  Records with equal payloads: the one with the smallest page id is the response, the
others are revisits that refer to it.  Pages meet their payload's first page by an ordinary join,
so payloads with very many copies are split over tasks.

A file's name holds the task attempt, and only files listed in the table that the write returns
count: a lost task is run again and its half-written files are never read.

Rows: a null html is an empty payload; pages that repeat the smallest id of their payload are all
responses; a null id is a revisit where the payload has another page, else a response; a null url leaves
the target out; an empty table writes nothing; extra columns are left out.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from daymill.llm.base import query, table
from daymill.session import staged, work_folder

#: An archive holds about so many bytes of records before compression, or one record.
ARCHIVE_BYTES = 8 << 20
#: Read records leave a task in batches of about so many payload bytes, or one record.
BATCH_BYTES = 1 << 20
DICTIONARY_BYTES = 64 << 10
# Frame mark of dictionaries in archives, and the profile of revisits.
DICTIONARY_FRAME = (0x184D2A5D).to_bytes(4, "little")
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

MANIFEST = T.StructType([T.StructField("path", T.StringType()), T.StructField("records", T.LongType()), T.StructField("bytes", T.LongType())])


def _store(uri: str):
    """The file system of ``uri`` and the path in it."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def record(page, url: str | None, payload: bytes, digest: bytes, refers_to, date: str) -> bytes:
    """A response record, or a revisit record without payload if ``refers_to`` is given."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    revisit = refers_to is not None
    name = lambda i: f"<urn:x-page:{'' if i is None else i}>"
    head = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", name(page)), ("WARC-Date", date)]
    if url is not None:
        head.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)))
    if revisit:
        head += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", name(refers_to))]
    head += [("WARC-Payload-Digest", "sha1:" + base64.b32encode(digest).decode()),
             ("Content-Type", "application/http;msgtype=response"), ("Content-Length", len(http) + (0 if revisit else len(payload)))]
    lines = "".join(f"{k}: {v}\r\n" for k, v in head)
    return b"".join([b"WARC/1.1\r\n", lines.encode(), b"\r\n", http, b"" if revisit else payload, b"\r\n\r\n"])


def build_dictionary(records: list[bytes]):
    """A trained dictionary, or the records' own bytes where there is too little to train on."""
    import zstandard

    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, records, d=8, k=256)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(records)[:DICTIONARY_BYTES] or b"WARC/1.1\r\n", dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def archive(records: list[bytes]) -> bytes:
    """A whole archive: the dictionary's skippable frame, then a frame per record."""
    import zstandard

    dictionary = build_dictionary(records)
    dictionary.precompute_compress(level=3)
    own = dictionary.as_bytes()
    c = zstandard.ZstdCompressor(level=3, dict_data=dictionary, write_checksum=True)
    return b"".join([DICTIONARY_FRAME, len(own).to_bytes(4, "little"), own, *map(c.compress, records)])


def open_archive(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record."""
    import zstandard

    if data[:4] != DICTIONARY_FRAME:
        raise ValueError("no dictionary frame")
    end = 8 + int.from_bytes(data[4:8], "little")
    d = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8:end]))
    with d.stream_reader(memoryview(data)[end:], read_across_frames=True) as stream:
        plain, at = stream.read(), 0
    while at < len(plain):
        stop = plain.index(b"\r\n\r\n", at)
        lines = plain[at:stop].decode().split("\r\n")
        head = dict(x.split(": ", 1) for x in lines[1:])
        size = int(head["Content-Length"])
        yield head, plain[stop + 4:stop + 4 + size]
        at = stop + 4 + size + 4


def write_archives(pages: DataFrame, folder: str, page: str = "page_id", url: str = "url", html: str = "html",
                   least: int = 0, date: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """Write the pages under ``folder`` and return the written archives (path, records, bytes).

    Payloads under ``least`` bytes are always responses.
    """
    rows = pages.select(F.col(page).alias("page"), F.col(url).alias("url"), F.encode(F.coalesce(html, F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("digest", F.unhex(F.sha1("payload")))
    first = rows.where(F.length("payload") >= least).groupBy("digest").agg(F.min("page").alias("first"))
    rows = rows.join(first, "digest", "left").select(
        "page", "url", "payload", "digest", F.when(~F.col("page").eqNullSafe(F.col("first")) & (F.length("payload") >= least), F.col("first")).alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, done, store = TaskContext.get(), 0, None

        def write(records: list[bytes]) -> pa.RecordBatch:
            nonlocal done, store
            if store is None:
                store = _store(folder)
                store[0].create_dir(store[1], recursive=True)
            name = f"part-{task.partitionId():05d}-{done:05d}-{task.taskAttemptId()}.warc.zst"
            data = archive(records)
            with store[0].open_output_stream(f"{store[1]}/{name}") as f:
                f.write(data)
            done += 1
            return pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "records": [len(records)], "bytes": [len(data)]})

        held, size = [], 0
        for b in batches:
            for i in range(b.num_rows):
                p, u, payload, digest, refers = (b.column(c)[i].as_py() for c in range(5))
                held.append(record(p, u, payload, digest, refers, date))
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    yield write(held)
                    held, size = [], 0
        if held:
            yield write(held)

    return staged(rows.mapInArrow(run, MANIFEST), "archives")


def read_archives(archives: DataFrame, id_type: str = "long") -> DataFrame:
    """One row per record of the listed archives; a response whose payload belies its digest is an error."""
    schema = T.StructType([T.StructField(n, t) for n, t in (
        ("page", T.StringType()), ("url", T.StringType()), ("payload_bytes", T.LongType()), ("payload_digest", T.StringType()),
        ("record_type", T.StringType()), ("refers_to", T.StringType()), ("payload", T.BinaryType()))])
    fields = pa.schema([(n, pa.int64() if n == "payload_bytes" else pa.binary() if n == "payload" else pa.string()) for n in schema.names])

    def batch(path: str, records: Iterator[tuple[dict[str, str], bytes]]) -> Iterator[pa.RecordBatch]:
        out: dict[str, list] = {n: [] for n in schema.names}
        held = 0
        for head, block in records:
            http, _, payload = block.partition(b"\r\n\r\n")
            response = head["WARC-Type"] == "response"
            digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
            if response and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                raise ValueError(f"damaged record {head['WARC-Record-ID']} in {path}")
            refers = head.get("WARC-Refers-To")
            row = (head["WARC-Record-ID"][12:-1] or None, head.get("WARC-Target-URI"),
                   int(re.search(rb"Content-Length: (\d+)", http)[1]), digest, head["WARC-Type"],
                   refers and refers[12:-1], payload if response else None)
            for n, v in zip(schema.names, row, strict=True):
                out[n].append(v)
            held += len(payload)
            if held >= BATCH_BYTES:
                yield pa.RecordBatch.from_pydict(out, fields)
                out, held = {n: [] for n in schema.names}, 0
        if out["page"]:
            yield pa.RecordBatch.from_pydict(out, fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column("path").to_pylist():
                store, at = _store(path)
                with store.open_input_stream(at) as f:
                    data = f.read()
                yield from batch(path, open_archive(data))

    spread = archives.select("path").repartition(max(1, min(10_000, archives.count())), "path")
    return spread.mapInArrow(run, schema).withColumns({"page": F.col("page").cast(id_type), "refers_to": F.col("refers_to").cast(id_type)})


_BASE32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (('0x' || substr(h, {5 * g + 1}, 5))::INTEGER >> {s}) % 32 + 1, 1)" for g in range(8) for s in (15, 10, 5, 0))


@query("op3_warc_archives", f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT h, min(page_id) AS first FROM p GROUP BY h)
SELECT page_id, n AS payload_bytes, {_BASE32} AS payload_digest,
  CASE WHEN page_id IS DISTINCT FROM first AND first IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM p JOIN f USING (h)""")
def op3_warc_archives(spark: SparkSession, sf: str) -> DataFrame:
    archives = write_archives(table(spark, sf, "pages"), work_folder(spark, "warc"))
    return read_archives(archives).select(F.col("page").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")
