"""WARC archives: writing with an index, and reading selected records by coalesced byte ranges.

Each record is a gzip member of its own. While a task writes, it notes file, offset, length, URL and digest of every
record; this index is the table from which records are selected. An attempt writes files of its own name, and the index, which
holds only attempts that were committed, tells which files count. Reading deals the selected records by file and by
stretch of the file, sorts them by offset, joins ranges that lie close together into one read, and inflates each record
from its own bytes.

Of records with equal payloads of at least `least` bytes, the one with the largest page id holds the payload and the
others revisit it. The groups are counted first, and the payloads are joined to them by digest and salt, so one payload
in a third of all rows does not meet in one task.

Defined cases: a null html is an empty payload; a null URL is written without a target; rows that repeat the largest id
and its payload are all responses, and records of one id have one record id; a null id is smaller than any other. Line breaks in a URL are escaped in the header.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gnomon.llm import common as C

LEAST, SALTS = 1000, 16
FILE_BYTES, STRETCH, GAP = 64 << 20, 4 << 20, 64 << 10
_INDEX = "file string, offset long, length long, page_id long, url string, digest string, record_type string"
_RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
_ID = "urn:gnomon:page:"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, date: str = "1970-01-01T00:00:00Z") -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<{_ID}{'' if page_id is None else page_id}>"), ("WARC-Date", date)]
    if url is not None:
        head.append(("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")))
    head.append(("WARC-Payload-Digest", f"sha1:{digest}"))
    if revisit:
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<{_ID}{'' if refers_to is None else refers_to}>")]
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """A record's fields; raises ValueError where lengths or the digest don't agree."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines)
    size = int(fields["Content-Length"])
    if not version.startswith("WARC/") or rest[size:] != b"\r\n\r\n":
        raise ValueError("not a whole WARC record")
    http, _, payload = rest[:size].partition(b"\r\n\r\n")
    said = int(next(x for x in http.decode().split("\r\n") if x.startswith("Content-Length: "))[16:])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    revisit = fields["WARC-Type"] == "revisit"
    if not revisit and (len(payload) != said or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError("the payload does not agree with its length or digest")
    number = lambda x: int(y) if (y := x.removeprefix(f"<{_ID}").removesuffix(">")) else None
    return {"page_id": number(fields["WARC-Record-ID"]), "url": fields.get("WARC-Target-URI"), "payload_bytes": said, "payload_digest": digest, "record_type": fields["WARC-Type"], "refers_to": number(fields["WARC-Refers-To"]) if revisit else None, "payload": None if revisit else payload}


def write_warc(pages: DataFrame, folder: str, least: int = LEAST, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes every row (page_id, url, html) as a record below folder; returns the index, as written."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload")).withColumn("digest", F.sha1("payload"))
    groups = rows.where(F.octet_length("payload") >= least).groupBy("digest").agg(F.max("page_id").alias("holder"), F.count("*").alias("many")).where("many > 1")
    salted = groups.select("digest", "holder", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    told = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(salted, ["digest", "salt"], "left")
    told = told.select("page_id", "url", "payload", "digest", "holder", (F.col("holder").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("holder"))).alias("revisit"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, top = fs.FileSystem.from_uri(folder)
        store.create_dir(top, recursive=True)
        task, number, sink, name, at = TaskContext.get(), 0, None, "", 0
        notes: list[tuple] = []

        for batch in batches:
            for page_id, url, payload, digest, holder, revisit in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if sink is None:
                    name, at = f"part-{task.partitionId():06d}-{number:04d}-{task.taskAttemptId()}.warc.gz", 0
                    sink, number = store.open_output_stream(f"{top}/{name}", compression=None), number + 1
                deflate = zlib.compressobj(1, zlib.DEFLATED, 31)
                raw = deflate.compress(record(page_id, url, payload, digest, holder, revisit)) + deflate.flush()
                sink.write(raw)
                notes.append((name, at, len(raw), page_id, url, digest, "revisit" if revisit else "response"))
                at += len(raw)
                if at >= file_bytes:
                    sink.close()
                    sink = None
            yield C.batch(_INDEX, notes)
            notes = []
        if sink is not None:
            sink.close()

    return C.written(told.mapInArrow(run, _INDEX), f"{folder.rstrip('/')}-index")


def read_warc(index: DataFrame, folder: str, select: Column | None = None, stretch: int = STRETCH, gap: int = GAP) -> DataFrame:
    """The selected records of an index: page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload (null in a revisit)."""

    def run(group: pa.Table) -> pa.Table:
        from pyarrow import fs

        store, top = fs.FileSystem.from_uri(folder)
        rows = sorted(set(zip(group.column("offset").to_pylist(), group.column("length").to_pylist(), strict=True)))
        out: list[dict] = []
        with store.open_input_file(f"{top}/{group.column('file')[0].as_py()}") as f:
            a = 0
            while a < len(rows):
                b = a + 1
                while b < len(rows) and rows[b][0] - sum(rows[b - 1]) <= gap:
                    b += 1
                f.seek(rows[a][0])
                raw = f.read(sum(rows[b - 1]) - rows[a][0])
                out += [parse(zlib.decompress(raw[o - rows[a][0] : o - rows[a][0] + n], 31)) for o, n in rows[a:b]]
                a = b
        return C.rows(_RECORD, [tuple(x.values()) for x in out])

    chosen = index if select is None else index.where(select)
    # Tasks by the bytes that they read, not by the rows of the index, which are small.
    total = chosen.agg(F.sum("length")).first()[0] or 0
    dealt = chosen.select("file", "offset", "length", F.floor(F.col("offset") / stretch).alias("stretch")).repartition(max(1, -(-int(total) // stretch)), "file", "stretch")
    return dealt.groupBy("file", "stretch").applyInArrow(run, _RECORD)
