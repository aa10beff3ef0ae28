"""WARC archives compressed with a dictionary: written by tasks, read back by tasks.

Each archive is a ``.warc.zst`` file: a leading skippable frame holds a Zstandard dictionary built from records of that
archive, then every record follows as a frame of its own, so that a reader can start at any record. Records are WARC/1.1
``response`` records with an HTTP block, or ``revisit`` records that name the response with the same payload.

Tasks write through the file system of the archive folder's address, under an attempt's own name first and then moved to
the name that follows from partition and number; rows are sorted within partitions, so that a repeated attempt writes the
same files again. The manifest is a table committed by Spark.

Defined cases: a null html is an empty payload; payloads under ``LEAST`` bytes are always responses; of equal payloads that
with the smallest page_id is the response, rows that repeat that page_id and payload are responses too; null ids come after
all others, and equal payloads of null ids only are all responses; a null url is left out; an archive with too few records
for a dictionary has none.
"""

from __future__ import annotations

import hashlib
import struct

import pandas as pd
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import HOT, bounded_batches, materialize, scratch_path

LEAST = 100
#: Bytes of records in an archive before compression.
ARCHIVE_BYTES = 64 << 20
DICTIONARY_BYTES, TRAIN_BYTES = 64 << 10, 4 << 20
SKIPPABLE = 0x184D2A5D
LEVEL = 3
DATE = "2024-01-01T00:00:00Z"


def page_roles(pages: DataFrame) -> DataFrame:
    """``pages`` (page_id, url, html) with digest, payload_bytes and refers_to, which is null for responses.

    Payloads that more than one in HOT rows have are at most HOT: their first pages are broadcast, so that a common page is
    not gathered by its digest.
    """
    payload = F.coalesce(F.col("html"), F.lit(""))
    sized = pages.select("page_id", "url", "html", F.sha2(payload, 256).alias("digest"), F.octet_length(payload).cast("long").alias("payload_bytes"))
    firsts = sized.filter(F.col("payload_bytes") >= LEAST).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1")
    firsts = materialize(firsts, "firsts")
    cut = max(100, pages.count() // HOT)
    hot = firsts.filter(F.col("n") > cut).select("digest", F.col("first").alias("hot_first"))
    joined = sized.join(F.broadcast(hot), "digest", "left")
    # Short payloads have no first page and common ones have it already: they do not meet under one digest.
    meets = (F.col("payload_bytes") >= LEAST) & F.col("hot_first").isNull()
    key = F.when(meets, F.col("digest")).otherwise(F.concat_ws(":", "digest", F.pmod(F.xxhash64("page_id", "url"), F.lit(4096))))
    rest = firsts.filter(F.col("n") <= cut).select(F.col("digest").alias("key"), "first")
    joined = joined.withColumn("key", key).join(rest, "key", "left").withColumn("first", F.coalesce("hot_first", "first"))
    refers = F.when(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    return joined.select("page_id", "url", "html", "digest", "payload_bytes", refers.alias("refers_to"))


def _urn(page_id) -> str:
    return f"<urn:page:{'null' if pd.isna(page_id) else int(page_id)}>"


def _page(urn: str):
    text = urn.removeprefix("<urn:page:").removesuffix(">")
    return None if text == "null" else int(text)


def record(page_id, url, html, digest: str, size: int, refers_to) -> bytes:
    head = ["WARC/1.1", f"WARC-Type: {'response' if pd.isna(refers_to) else 'revisit'}", f"WARC-Record-ID: {_urn(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c if c > " " else f"%{ord(c):02X}" for c in url))
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    if pd.isna(refers_to):
        block = http + (html or "").encode("utf-8", "replace")
    else:
        head += [f"WARC-Refers-To: {_urn(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
        block = http
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def dictionary(records: list[bytes]) -> zstandard.ZstdCompressionDict | None:
    """Built from evenly spread records of up to TRAIN_BYTES in all."""
    step = max(1, sum(map(len, records)) // TRAIN_BYTES)
    samples = [r[: 64 << 10] for r in records[::step]]
    size = min(DICTIONARY_BYTES, sum(map(len, samples)) // 16)
    if len(samples) < 16 or size < 1024:
        return None
    try:
        return zstandard.train_dictionary(size, samples, k=512, d=8)
    except zstandard.ZstdError:  # the samples have too little in common
        return None


def archive(records: list[bytes]) -> bytes:
    known = dictionary(records)
    head = b"" if known is None else struct.pack("<II", SKIPPABLE, len(known.as_bytes())) + known.as_bytes()
    compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_checksum=True)
    return head + b"".join(map(compressor.compress, records))


def frames(data: bytes):
    """The records of an archive, one a frame."""
    at, known = 0, None
    if len(data) >= 8 and struct.unpack_from("<I", data)[0] == SKIPPABLE:
        size = struct.unpack_from("<I", data, 4)[0]
        known, at = zstandard.ZstdCompressionDict(data[8 : 8 + size]), 8 + size
    opener = zstandard.ZstdDecompressor(dict_data=known)
    while at < len(data):
        frame, parts = opener.decompressobj(), []
        while not frame.eof:
            piece = data[at : at + (16 << 10)]
            if not piece:
                raise ValueError("an archive ends within a record")
            parts.append(frame.decompress(piece))
            at += len(piece) - (len(frame.unused_data) if frame.eof else 0)
        yield b"".join(parts)


def parse(data: bytes) -> tuple:
    """(page_id, url, payload or None, payload_bytes, digest, type, refers_to) of a record; a payload is held against its digest."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    size = int(http.rpartition(b"Content-Length: ")[2])
    revisit = fields["WARC-Type"] == "revisit"
    if not revisit and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"record {fields['WARC-Record-ID']} does not have the payload it names")
    return _page(fields["WARC-Record-ID"]), fields.get("WARC-Target-URI"), None if revisit else payload, size, digest, fields["WARC-Type"], _page(fields["WARC-Refers-To"]) if revisit else None


def write_warc(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write all of ``pages`` to archives in ``folder``, an address that all executors reach; returns the manifest (archive, n_records, raw_bytes, stored_bytes)."""
    bounded_batches(pages.sparkSession)

    def write(batches):
        files, root = fs.FileSystem.from_uri(folder)
        files.create_dir(root, recursive=True)
        task, records, size, number = TaskContext.get(), [], 0, 0

        def flush() -> pd.DataFrame:
            nonlocal records, size, number
            name, data = f"part-{task.partitionId():06d}-{number:05d}.warc.zst", archive(records)
            own = f"{root}/_{name}.{task.taskAttemptId()}"
            with files.open_output_stream(own) as out:
                out.write(data)
            files.move(own, f"{root}/{name}")
            row = pd.DataFrame({"archive": [name], "n_records": [len(records)], "raw_bytes": [size], "stored_bytes": [len(data)]})
            records, size, number = [], 0, number + 1
            return row

        for batch in batches:
            for row in batch.itertuples(index=False):
                records.append(record(row.page_id, row.url, row.html, row.digest, row.payload_bytes, row.refers_to))
                size += len(records[-1])
                if size >= archive_bytes:
                    yield flush()
        if records:
            yield flush()

    rows = page_roles(pages).sortWithinPartitions("page_id", "digest", "url")
    return materialize(rows.mapInPandas(write, "archive string, n_records long, raw_bytes long, stored_bytes long"), "manifest")


def read_warc(spark: SparkSession, folder: str, payloads: bool = False) -> DataFrame:
    """All records of the archives in ``folder``: page_id, url, payload_bytes, payload_digest, record_type, refers_to and, if asked for, html."""

    def read(batches):
        for batch in batches:
            for data in batch["content"]:
                rows = []
                for i, one in enumerate(frames(data)):
                    page, url, payload, size, digest, kind, refers = parse(one)
                    rows.append((page, url, size, digest, kind, refers, payload.decode() if payloads and payload is not None else None))
                    if i % 1000 == 999:
                        yield table(rows)
                        rows = []
                yield table(rows)

    def table(rows: list) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "html"])
        return out.astype({"page_id": "Int64", "refers_to": "Int64"})

    bounded_batches(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.warc.zst").load(folder).select("content")
    found = files.mapInPandas(read, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, html string")
    return found if payloads else found.drop("html")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "warc")
    write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"), folder)
    return read_warc(spark, folder).drop("url")


OP5_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
s AS (SELECT page_id, octet_length(encode(h))::BIGINT AS payload_bytes, sha256(h) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS f FROM s WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN f IS NOT NULL AND page_id IS DISTINCT FROM f THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN f IS NOT NULL AND page_id IS DISTINCT FROM f THEN f END AS refers_to
FROM s LEFT JOIN f USING (payload_digest)
"""
