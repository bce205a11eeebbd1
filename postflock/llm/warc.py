"""A deterministic, sharded WARC writer and its reader.

Records are range-sorted by page, each is a gzip member of its own, and a file
is closed when it has reached a compressed size. HTTP and WARC headers, lengths
and digests are made anew from the payload. Files appear under their final
names by renaming, and the manifest, a table that Spark commits after all tasks
have ended, says which files make up the archive.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import files
from .core import new_folder, partitions, pick, stage

#: Compressed bytes at which a file is closed.
FILE_BYTES = 128 << 20
#: Payloads of fewer bytes are always written in full.
LEAST_REVISIT = 100
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CHUNK = 1 << 18

MANIFEST = pa.schema([("part", pa.int64()), ("seq", pa.int64()), ("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string())])


def header(kind: str, fields: list[tuple[str, str]], length: int) -> bytes:
    lines = [f"{k}: {v}" for k, v in fields]
    return "\r\n".join(["WARC/1.1", f"WARC-Type: {kind}", *lines, f"Content-Length: {length}", "", ""]).encode()


def record_id(page: int | None, digest: str, place: int) -> str:
    """The same for the same page and payload; ``place`` tells repeated rows apart."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page}/{digest}/{place}')}>"


def target_of(url: str | None, page: int | None) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else f"urn:page:{'' if page is None else page}"


def record(page: int | None, place: int, url: str | None, payload: bytes, digest: str, first: tuple[int | None, str | None] | None) -> bytes:
    """One record, compressed; ``first`` is page and url of the response that a
    revisit refers to. A revisit keeps the HTTP headers, and in them the payload's
    length, but not the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if first else http + payload
    fields = [
        ("WARC-Record-ID", record_id(page, digest, place)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", target_of(url, page)),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if page is not None:
        fields.append(("Page-Id", str(page)))
    if first:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(first[0], digest, 0)), ("WARC-Refers-To-Target-URI", target_of(first[1], first[0])), ("WARC-Refers-To-Date", DATE)]
        if first[0] is not None:
            fields.append(("Refers-To-Page-Id", str(first[0])))
    return squeeze(header("revisit" if first else "response", fields, len(block)) + block + b"\r\n\r\n")


def squeeze(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def records(source):
    """(headers, block) of each record of an archive, read as a stream."""
    unpacker, held, data = zlib.decompressobj(31), [], b""
    while True:
        data = data or source.read(CHUNK)
        if not data:
            if held:
                raise ValueError("the archive is cut off")
            return
        held.append(unpacker.decompress(data))
        data = unpacker.unused_data
        if unpacker.eof:
            head, _, rest = b"".join(held).partition(b"\r\n\r\n")
            fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
            length = int(fields["Content-Length"])
            if len(rest) != length + 4:
                raise ValueError("a record has another length than its header says")
            yield fields, rest[:length]
            unpacker, held = zlib.decompressobj(31), []


def write_archive(pages: DataFrame, *, key: str = "page_id", url: str = "url", html: str = "html", file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes a record for each row and returns the manifest: part, seq, path,
    records, bytes, sha256 of each file.

    The payload is the html in UTF-8; null is as empty. Of rows with equal
    payloads of at least ``LEAST_REVISIT`` bytes the one with the smallest key is
    a response, all others are revisits of it; of rows that are equal in key and
    payload the first is taken. Null keys come last and are referred to only if
    no row of the payload has a key; such a revisit names no page. An empty table
    makes no file. Other columns are not looked at, whatever their names. Files are
    written as streams: a task's memory is a batch of rows and one record.
    """
    spark = pages.sparkSession
    own = pick(pages, key=key, url=url, html=html).select(F.col("key").cast("bigint").alias("key"), "url", F.coalesce("html", F.lit("")).alias("html"))
    sums = own.select("key", "url", F.sha2("html", 256).alias("digest"), F.octet_length("html").alias("size")).where(F.col("size") >= LEAST_REVISIT).drop("size")
    # the least page with its least url; without any key, the least url
    keyed, named = F.struct("key", F.col("url").alias("lead")), F.struct(F.lit(None).cast("bigint").alias("key"), F.col("url").alias("lead"))
    first = sums.groupBy("digest").agg(F.min(F.when(F.col("key").isNotNull(), keyed)).alias("a"), F.min(named).alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1")
    # written, so that both sides of the join are dealt out for it alone: Spark can
    # then split the rows of one very common page
    first = stage(first.select("digest", F.coalesce("a", "b").alias("f")).select("digest", F.col("f.key").alias("first"), F.col("f.lead").alias("lead")), "first")
    # what each repeated payload refers to travels to the page's place as a row
    # of its own, so that no page's html is moved for it
    marks = sums.join(first, "digest").groupBy("key", "digest").agg(F.first("first").alias("first"), F.first("lead").alias("lead"))
    marks = marks.select("key", "digest", F.lit(0).alias("kind"), "first", F.col("lead").alias("url"), F.lit(None).cast("string").alias("html"))
    rows = own.select("key", F.sha2("html", 256).alias("digest"), F.lit(1).alias("kind"), F.lit(None).cast("bigint").alias("first"), "url", "html")
    order = [F.asc_nulls_last("key"), F.col("digest")]
    ranged = marks.unionByName(rows).repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order, "kind", "url")
    folder = new_folder(spark, "warc")
    files.make_folder(folder)

    def run(batches):
        part, seq = TaskContext.get().partitionId(), 0
        out, path, count = None, "", 0
        mark, last, place = None, None, 0

        def begin():
            name = f"pages-{part:06d}-{seq:06d}.warc.gz"
            info = b"software: postflock\r\nformat: WARC File Format 1.1\r\n"
            lead = header("warcinfo", [("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"), ("WARC-Date", DATE), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], len(info))
            made = files.Writer(f"{folder}/{name}")
            made.write(squeeze(lead + info + b"\r\n\r\n"))
            return made, f"{folder}/{name}"

        def close():
            out.commit()
            return pa.RecordBatch.from_pylist([{"part": part, "seq": seq, "path": path, "records": count, "bytes": out.size, "sha256": out.sha256.hexdigest()}], schema=MANIFEST)

        for batch in batches:
            for values in zip(*batch.columns):
                page, digest, kind, refers, target, text = (x.as_py() for x in values)
                if kind == 0:
                    mark = (page, digest, refers, target)
                    continue
                # rows equal in key and payload come one after another
                place, last = place + 1 if last == (page, digest) else 0, (page, digest)
                known = mark is not None and mark[:2] == (page, digest)
                first = mark[2:] if known and (place or mark[2] != page) else None
                if out is None:
                    (out, path), count = begin(), 0
                out.write(record(page, place, target, text.encode(), digest, first))
                count += 1
                if out.size >= file_bytes:
                    yield close()
                    out, seq = None, seq + 1
        if out is not None:
            yield close()

    path = f"{folder}/manifest"
    ranged.mapInArrow(run, "part bigint, seq bigint, path string, records bigint, bytes bigint, sha256 string").write.parquet(path)
    return spark.read.parquet(path)


def read_archive(manifest: DataFrame, key: str = "page_id") -> DataFrame:
    """Reads all files of a manifest, a row for each page record: the key,
    payload_bytes, payload_digest, record_type, refers_to. Digests of payloads
    that are there are computed anew and must equal those in the headers."""
    n_files = max(1, manifest.count())

    def run(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, place = files.place(path)
                rows = []
                with store.open_input_stream(place, compression=None) as source:
                    for fields, block in records(source):
                        if fields["WARC-Type"] == "warcinfo":
                            continue
                        http, _, payload = block.partition(b"\r\n\r\n")
                        digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
                        size = int(re.search(rb"\r\nContent-Length: (\d+)", http)[1])
                        if fields["WARC-Type"] == "response":
                            if len(payload) != size or hashlib.sha256(payload).hexdigest() != digest:
                                raise ValueError(f"{path}: a payload differs from its digest")
                        page, refers = fields.get("Page-Id"), fields.get("Refers-To-Page-Id")
                        rows.append({key: page and int(page), "payload_bytes": size, "payload_digest": digest, "record_type": fields["WARC-Type"], "refers_to": refers and int(refers)})
                        if len(rows) == 4096:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows = []
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    schema = pa.schema([(key, pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
    return manifest.select("path").repartition(n_files, "path").mapInArrow(run, f"`{key}` bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint")


ORACLE = """
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> lead THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> lead THEN lead END AS refers_to
FROM (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS lead
      FROM (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages))
"""
