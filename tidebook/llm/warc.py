"""WARC archives, index first.

Tasks write archives of separately gzipped records into the shared folder and return an index
row for each record: file, offset, length, URL and digest. The index is a table of its own; what
is read back is chosen from it. The chosen byte ranges are sorted, neighbours are coalesced into
one read, and the records are parsed from what was read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Hashable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_dir, staged

DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "<urn:page:%s>"
#: Copies of each repeated digest in the join, so that the pages of one digest go to many tasks.
SALT = 16
#: Bytes and records after which a task begins another archive.
ROLL, RECORDS = 256 << 20, 200_000
#: Records of one region of a file are read by one task; ranges with at most GAP bytes between
#: them become one read of at most READ bytes.
REGION, GAP, READ = 2 << 20, 64 << 10, 2 << 20
#: Archive bytes that one task reads, and fewer where there are not as many tasks as three for each core.
TASK_BYTES, LEAST_TASK_BYTES = 64 << 20, 1 << 20

INDEX = "page_id long, url string, payload_digest string, record_type string, path string, offset long, length long"
RESULT = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _clean(url: str | None) -> str:
    return "".join(c if " " < c < "\x7f" else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in url or "")


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> tuple[bytes, str]:
    """The gzipped record and its payload digest. A revisit has the HTTP header but no payload."""
    said = digest(payload)
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {RECORD % ('' if page_id is None else page_id)}",
        f"WARC-Target-URI: {_clean(url)}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{said}",
        "Content-Type: application/http; msgtype=response",
    ]
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {RECORD % ('' if refers_to is None else refers_to)}"]
    else:
        block += payload
    head.append(f"Content-Length: {len(block)}")
    squeeze = zlib.compressobj(1, zlib.DEFLATED, 31)
    return squeeze.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + squeeze.flush(), said


def _page(urn: str | None) -> int | None:
    told = (urn or "")[len("<urn:page:") : -1]
    return int(told) if told else None


def parse(data: bytes) -> tuple[int | None, int, str, str, int | None, bytes | None]:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, payload) of one record."""
    raw = zlib.decompress(data, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"no WARC record: {lines[0][:40]!r}")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(line.split(b":")[1]) for line in http.split(b"\r\n") if line.lower().startswith(b"content-length:"))
    said = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "revisit":
        return _page(fields["WARC-Record-ID"]), size, said, "revisit", _page(fields["WARC-Refers-To"]), None
    if len(payload) != size or digest(payload) != said:
        raise ValueError(f"payload of {fields['WARC-Record-ID']} doesn't match its digest")
    return _page(fields["WARC-Record-ID"]), size, said, "response", None, payload


def write_archives(pages: DataFrame, folder: str | None = None, least_bytes: int = 0, salt: int = SALT, roll: int = ROLL) -> DataFrame:
    """Write a record per row of pages(page_id, url, html) and return the index, itself a table.

    Of rows with equal payloads of at least `least_bytes` bytes, the one with the smallest page_id
    is a response and the others revisit it; rows that repeat that smallest page_id are
    responses too. A null html is an empty payload, a null page_id is larger than all others, a
    null URL is empty. Other columns are not read; an empty table gives an empty index. A task
    that is run again writes another file, and the index names the files of the runs that ended.
    """
    folder = folder or new_dir(pages.sparkSession, "warc")
    lean = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload")
    )
    hashed = lean.withColumn("sha", F.sha1("payload"))
    groups = hashed.filter(F.octet_length("payload") >= least_bytes).groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    repeated = groups.filter("n > 1").select("sha", "first", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))).alias("salt"))
    dealt = hashed.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(salt)).cast("int"))
    known = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    records = dealt.join(repeated, ["sha", "salt"], "left").select("page_id", "url", "payload", "first", F.coalesce(known, F.lit(False)).alias("revisit"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        kinds = [pa.int64(), *[pa.string()] * 4, pa.int64(), pa.int64()]
        names = [f.split()[0] for f in INDEX.split(", ")]
        out, path, at = None, "", 0
        rows: list[tuple] = []

        def told() -> pa.RecordBatch:
            # Index rows are told only once their archive is complete.
            out.close()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

        for batch in batches:
            for page_id, url, payload, first, revisit in zip(*(batch.column(c).to_pylist() for c in batch.schema.names)):
                if out is not None and (at >= roll or len(rows) >= RECORDS):
                    yield told()
                    out, rows = None, []
                if out is None:
                    path, at = f"{root}/{uuid.uuid4().hex}.warc.gz", 0
                    out = store.open_output_stream(path, compression=None)
                data, said = record(page_id, url, payload, first, revisit)
                out.write(data)
                rows.append((page_id, url, said, "revisit" if revisit else "response", path, at, len(data)))
                at += len(data)
        if out is not None:
            yield told()

    return staged(records.mapInArrow(run, INDEX), "warc-index").withColumn("store", F.lit(folder))


def coalesced(rows: list[tuple[Hashable, int, int]], gap: int = GAP, most: int = READ) -> list[tuple[Hashable, int, int, list[tuple[int, int]]]]:
    """Sorted (path, offset, length) as reads: (path, first, last, [(offset, length)...])."""
    out: list[tuple[Hashable, int, int, list[tuple[int, int]]]] = []
    for path, offset, length in rows:
        if out and out[-1][0] == path and offset <= out[-1][2] + gap and offset + length - out[-1][1] <= most:
            _, first, last, held = out[-1]
            held.append((offset, length))
            out[-1] = (path, first, max(last, offset + length), held)
        else:
            out.append((path, offset, offset + length, [(offset, length)]))
    return out


def read_tasks(spark: SparkSession, total: int, task_bytes: int = TASK_BYTES) -> int:
    """How many tasks read `total` bytes: of task_bytes each, or more and smaller ones where that leaves cores idle."""
    return max(1, -(-total // task_bytes), min(3 * spark.sparkContext.defaultParallelism, total // LEAST_TASK_BYTES))


def read_records(spark: SparkSession, index: DataFrame, with_payload: bool = False, region: int = REGION, gap: int = GAP, most: int = READ, task_bytes: int = TASK_BYTES) -> DataFrame:
    """The records that `index` (all of it, or a selection, also of several stores) names, parsed and checked.

    A row per index row; an index row that is repeated is read as often; an empty index gives no rows.
    With payload, revisits have null there. Damaged records raise an error. A record is held whole by
    the task that reads it, however long.
    """
    schema = RESULT + (", payload binary" if with_payload else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        stores: dict[str, fs.FileSystem] = {}
        opened, file = None, None
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()][: 5 + with_payload]
        for batch in batches:
            wanted = list(zip(*(batch.column(c).to_pylist() for c in ("store", "path", "offset", "length"))))
            rows = []
            for (folder, path), first, last, held in coalesced([((folder, path), o, n) for folder, path, o, n in wanted], gap, most):
                if (folder, path) != opened:
                    if file:
                        file.close()
                    if folder not in stores:
                        stores[folder] = fs.FileSystem.from_uri(folder)[0]
                    opened, file = (folder, path), stores[folder].open_input_file(path)
                data = file.read_at(last - first, first)
                rows += [parse(data[o - first : o - first + n])[: 5 + with_payload] for o, n in held]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[f.split()[0] for f in schema.split(", ")])
        if file:
            file.close()

    total = index.agg(F.sum("length")).first()[0] or 0
    chosen = index.select("store", "path", "offset", "length", F.floor(F.col("offset") / region).alias("region"))
    dealt = chosen.repartition(read_tasks(spark, total, task_bytes), "path", "region").sortWithinPartitions("store", "path", "offset")
    return dealt.mapInArrow(run, schema)
