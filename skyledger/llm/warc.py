"""Deterministic sharded WARC writer, and a reader of what it wrote.

The same rows give byte-identical archives, whatever their order and partitions: shards are
key ranges cut by exact sums, records are sorted inside a shard, files roll when their
compressed size passes a bound, and record ids, dates, lengths and digests are derived from
the content. Files are written under temporary names and moved; the manifest names all files
of a write and comes last, so a reader never takes a file of an attempt that died.
"""

from __future__ import annotations

import hashlib
import io
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.llm import common

#: Payloads below this many bytes are never written as revisits.
REVISIT_BYTES = 100
DATE = "2000-01-01T00:00:00Z"
MANIFEST = "shard int, file string, records bigint, bytes bigint, sha256 string"
RECORDS = (
    "page_id bigint, target_uri string, record_type string, refers_to bigint, payload_bytes bigint, "
    "payload_digest string, record_id string, file string, position bigint"
)


def revisits(rows: DataFrame, minimum: int = REVISIT_BYTES) -> DataFrame:
    """``page_id, digest, first_id`` of the rows that revisit an equal payload.

    Responses are short payloads and the smallest page_id of each payload. Rows that repeat
    that page_id with that payload are responses too; a row without page_id revisits the
    smallest one. Payloads do not take part, and digests are counted before the join, so a
    payload that a third of all pages share costs one partial sum per task.
    """
    narrow = rows.where(F.octet_length("html") >= minimum).select("page_id", "digest")
    repeated = (
        narrow.groupBy("digest")
        .agg(F.count(F.lit(1)).alias("n"), F.min("page_id").alias("first_id"))
        .where("n > 1 AND first_id IS NOT NULL")
        .drop("n")
    )
    return narrow.join(repeated, "digest").where("NOT page_id <=> first_id").select("page_id", "digest", "first_id").distinct()


def _uri(url: str | None, page_id: int | None) -> str:
    if not url:
        return f"urn:page:{page_id}"
    return "".join(c if 0x20 < ord(c) != 0x7F else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


def _record_id(page_id: int | None, digest: str) -> str:
    h = hashlib.sha256(f"{page_id} {digest}".encode()).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-5{h[13:16]}-8{h[17:20]}-{h[20:32]}>"


def record_bytes(page_id, url, payload: bytes, digest: str, first_id) -> bytes:
    """One record, not compressed. All header fields are made anew from the row."""
    revisit = first_id is not None
    http = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {len(payload)}\r\n\r\n"
    ).encode()
    block = http if revisit else http + payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", _record_id(page_id, digest)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", _uri(url, page_id)),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
        ("X-Page-Id", "" if page_id is None else str(page_id)),
    ]
    if revisit:
        fields += [
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            ("WARC-Refers-To", _record_id(first_id, digest)),
            ("X-Refers-To-Page-Id", str(first_id)),
            ("X-Payload-Length", str(len(payload))),
        ]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def _member(data: bytes, level: int) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def write_archives(
    pages: DataFrame,
    folder: str,
    *,
    shard_bytes: int = 4 << 20,
    file_bytes: int = 16 << 20,
    level: int = 6,
    minimum: int = REVISIT_BYTES,
) -> DataFrame:
    """Write ``page_id, url, html`` as gzipped WARC files below ``folder``; the manifest's rows.

    Null html is an empty payload, a null or empty url becomes an ``urn:page:`` URI, control
    characters in urls are escaped. Rows that repeat are written once each. Pages without
    page_id come first. No rows: no files and an empty manifest. Other columns are ignored.
    A file is closed by the record that takes it past ``file_bytes`` of compressed size, so
    one longer record makes one longer file. A task holds one file in memory.
    """
    rows = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html"), F.lit("")).alias("html"),
    ).withColumn("digest", F.sha2(F.col("html").cast("binary"), 256))
    weight = F.octet_length("html").cast("bigint") + F.lit(400)
    cuts = common.range_cuts(rows, "page_id", weight, shard_bytes)
    common.store(folder)[0].create_dir(common.store(folder)[1], recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("shard", pa.int32()), ("file", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string())])
        fs, base = common.store(folder)
        held, size, records, shard, number, done = [], 0, 0, None, 0, []
        marked, first_id = None, None

        def close():
            nonlocal held, size, records, number
            if records:
                data = b"".join(held)
                name = f"part-{shard:06d}-{number:05d}.warc.gz"
                common.commit_file(fs, f"{base}/{name}", data)
                done.append((shard, name, records, len(data), hashlib.sha256(data).hexdigest()))
                number += 1
            held, size, records = [], 0, 0

        for batch in batches:
            for row in batch.to_pylist():
                if row["first_id"] is not None:
                    # The rows of this page and payload follow.
                    marked, first_id = (row["page_id"], row["digest"]), row["first_id"]
                    continue
                if row["shard"] != shard:
                    close()
                    shard, number = row["shard"], 0
                data = _member(
                    record_bytes(row["page_id"], row["url"], row["html"].encode(), row["digest"],
                                 first_id if marked == (row["page_id"], row["digest"]) else None),
                    level,
                )
                held.append(data)
                size, records = size + len(data), records + 1
                if size >= file_bytes:
                    close()
        close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), schema)], schema=schema)

    # Payloads are shuffled once; the note that a page is a revisit travels to its shard and
    # sorts right before it.
    notes = revisits(rows, minimum).select(
        "page_id", F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"), "digest", "first_id"
    )
    dealt = (
        rows.withColumn("first_id", F.lit(None).cast("bigint"))
        .unionByName(notes)
        .withColumn("shard", common.shard_of("page_id", cuts))
        .repartition(len(cuts) + 1, "shard")
        .sortWithinPartitions("shard", "page_id", "digest", F.col("first_id").desc_nulls_last(), "url")
        .select("shard", "page_id", "url", "html", "digest", "first_id")
    )
    # The manifest is a written table: its own commit is the commit of the whole archive.
    manifest = dealt.mapInArrow(write, MANIFEST)
    manifest.write.parquet(f"{folder}/manifest")
    return manifest.sparkSession.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def _records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record of a gzipped archive, one record in memory."""
    import gzip

    reader = io.BufferedReader(gzip.GzipFile(fileobj=stream), 1 << 16)
    while True:
        line = reader.readline()
        if not line:
            return
        if line != b"WARC/1.1\r\n":
            raise ValueError(f"no record begins here: {line[:40]!r}")
        fields = {}
        while (line := reader.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode().rstrip("\r\n").partition(": ")
            fields[name] = value
        block = reader.read(int(fields["Content-Length"]))
        if reader.read(4) != b"\r\n\r\n" or len(block) != int(fields["Content-Length"]):
            raise ValueError("a record is cut")
        yield fields, block


def read_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """One row per record of the files that the manifest names.

    Lengths and digests of responses are computed from the payload that was read and checked
    against the header fields; those of a revisit are the fields of its record, which has no
    payload. A file that differs from the manifest, or a broken record, fails the job.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in RECORDS.split(", ")]
        kinds = [pa.int64() if " bigint" in c else pa.string() for c in RECORDS.split(", ")]
        schema = pa.schema(list(zip(names, kinds)))
        fs, base = common.store(folder)
        rows = []

        def batch():
            out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], schema=schema)
            rows.clear()
            return out

        for files in batches:
            for file, size in zip(files.column("file").to_pylist(), files.column("bytes").to_pylist()):
                if fs.get_file_info(f"{base}/{file}").size != size:
                    raise ValueError(f"{file} is not the file of the manifest")
                with fs.open_input_file(f"{base}/{file}") as stream:
                    for position, (fields, block) in enumerate(_records(stream)):
                        if f"sha256:{hashlib.sha256(block).hexdigest()}" != fields["WARC-Block-Digest"]:
                            raise ValueError(f"{file}: block digest of record {position}")
                        digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
                        if fields["WARC-Type"] == "response":
                            payload = block.partition(b"\r\n\r\n")[2]
                            length = len(payload)
                            if hashlib.sha256(payload).hexdigest() != digest:
                                raise ValueError(f"{file}: payload digest of record {position}")
                        else:
                            length = int(fields["X-Payload-Length"])
                        page, other = fields["X-Page-Id"], fields.get("X-Refers-To-Page-Id")
                        rows.append((
                            int(page) if page else None, fields["WARC-Target-URI"], fields["WARC-Type"],
                            int(other) if other else None, length, digest, fields["WARC-Record-ID"], file, position,
                        ))
                        if len(rows) >= 5000:
                            yield batch()
        if rows:
            yield batch()

    n = max(1, manifest.count())
    return manifest.repartition(n, "file").mapInArrow(read, RECORDS)
