"""WARC archives: a writer and a sequential reader.

Writing: every record is one gzip member. Spark's own text writer puts the members into the shared store, so no
file is opened by path. A member ends with its uncompressed length, lowest byte first, so its last byte is zero for
records under 16 MiB; that byte serves as the writer's "line separator". After a larger record stands an empty member,
which readers pass over. Pages are written in classes of size, and the larger a class's pages, the fewer records its files hold, so that a file holds at
most about FILE_BYTES of pages, or one page.

Payloads meet the response they refer to by their digest, over SALTS keys: a payload that a third of all pages share is not one task's.

Reading: each archive is read in order of its bytes and inflated step by step with zlib, one member per record; the header block ends at an empty line,
Content-Length frames the block, and block and payload digests are computed anew. Spark's reader hands a task one compressed archive at a time, which
FILE_BYTES bounds; inflated, one record is held at a time. A record that breaks off, whose
member or framing is damaged, or whose digest differs is returned with `error` set and `verified` false.

Rows: a null payload is written as an empty one, a null page id is written as an empty field and reads as null; it is
never referred to, and pages without a non-null id among equal payloads are all responses. Repeated ids are kept.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, clear, table

FILE_BYTES = 256 << 20
FILE_RECORDS = 2000
SALTS = 16
STEP = 64 << 10


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _header(fields: list[tuple[str, str]]) -> bytes:
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n").encode()


def _clean(value: str | None) -> str:
    return re.sub(r"[\r\n]+", " ", value or "").strip()


def _gzip(raw: bytes, level: int) -> bytes:
    squeeze = zlib.compressobj(level, zlib.DEFLATED, 31)
    return squeeze.compress(raw) + squeeze.flush()


def pack_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, level: int = 6) -> bytes:
    """One record as a gzip member; an empty member follows where the record has 16 MiB or more, so that the last byte is zero."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"),
        ("WARC-Target-URI", _clean(url)),
        ("WARC-Date", "2024-01-01T00:00:00Z"),
        ("WARC-Payload-Digest", f"sha1:{base32_sha1(payload)}"),
        ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if refers_to is not None:
        fields += [("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    raw = _header(fields) + block + b"\r\n\r\n"
    member = _gzip(raw, level)
    return member if member[-1] == 0 else member + _gzip(b"", level)


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = 0) -> None:
    """One record per row. Among equal payloads of at least `least_bytes` the least id is the response, the others revisit it."""
    body = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url).cast("string").alias("url"), body.alias("body"))
    rows = rows.withColumn("digest", F.sha1("body")).withColumn("class", _size_class("body"))
    # One small row for each payload that occurs more than once.
    first = rows.where(F.length("body") >= least_bytes).groupBy("digest", "class").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    first = first.where("n > 1 and first is not null").select("digest", "first", "class", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salt = F.pmod(F.xxhash64("id", "url"), F.lit(SALTS)).cast("int")
    refers = F.when(F.col("id").isNull() | (F.col("id") != F.col("first")), F.col("first")).alias("refers")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                out = [pack_record(i.as_py(), u.as_py(), p.as_py(), r.as_py())[:-1] for i, u, p, r in zip(*(part.column(k) for k in range(4)))]
                yield pa.record_batch([pa.array(out, pa.binary())], ["member"])

    clear(pages.sparkSession, path)
    classes = sorted(r["class"] for r in rows.select("class").distinct().collect()) or [0]  # at most one for each power of SIZE_STEP
    for c in classes:
        # A payload's class follows from its bytes, so equal payloads are in the same one.
        one = rows.where(F.col("class") == c).withColumn("salt", salt).join(first.where(F.col("class") == c).drop("class"), ["digest", "salt"], "left")
        packed = one.select("id", "url", "body", refers).mapInArrow(pack, "member binary")
        text = packed.select(F.col("member").cast("string").alias("value")).write.mode("overwrite").option("lineSep", "\0")
        text.option("maxRecordsPerFile", max(1, FILE_RECORDS // SIZE_STEP**c)).text(f"{path}/size{c}")


SMALL_PAGE, SIZE_STEP = FILE_BYTES // FILE_RECORDS, 8


def _size_class(body: str):
    """0 for pages of up to SMALL_PAGE bytes, one more for each further factor of SIZE_STEP, up to pages that fill a file alone."""
    out, c = F.lit(0), 0
    while FILE_RECORDS // SIZE_STEP**c > 1:
        out, c = F.when(F.length(body) > SMALL_PAGE * SIZE_STEP**c, c + 1).otherwise(out), c + 1
    return out


def members(data: memoryview) -> Iterator[tuple[Iterator[bytes], int]]:
    """Walks the gzip members of an archive: inflated pieces of each, in order."""
    at = 0
    while at < len(data):
        unzip, box = zlib.decompressobj(31), [at]

        def parts(unzip=unzip, box=box) -> Iterator[bytes]:
            while not unzip.eof:
                chunk = data[box[0] : box[0] + STEP]
                if not len(chunk):
                    raise EOFError("the member breaks off")
                box[0] += len(chunk)
                yield unzip.decompress(chunk)
            box[0] -= len(unzip.unused_data)

        yield parts(), at
        at = box[0]


def read_records(data: memoryview) -> Iterator[dict]:
    """Each record of an archive: type, ids, payload, digests and what was found wrong with it."""
    for parts, at in members(data):
        out = {"offset": at, "id": None, "url": None, "record_type": None, "refers": None, "payload": None, "payload_bytes": None, "payload_digest": None, "verified": False, "error": None}
        try:
            held = bytearray()
            parts = iter(parts)
            for x in parts:
                held += x
                if b"\r\n\r\n" in held:
                    break
            if not held:
                continue
            head, _, rest = bytes(held).partition(b"\r\n\r\n")
            lines = head.decode("utf-8", "replace").split("\r\n")
            if not lines[0].startswith("WARC/"):
                raise ValueError("not a WARC record")
            fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
            length, block = int(fields["content-length"]), bytearray(rest)
            for x in parts:
                block += x
            if bytes(block[length:]) != b"\r\n\r\n" or len(block) != length + 4:
                raise ValueError("the block's length differs from Content-Length")
            block = bytes(block[:length])
            http, _, payload = block.partition(b"\r\n\r\n")
            size = int(re.search(rb"(?i)\r\ncontent-length:\s*(\d+)", http)[1])
            number = lambda s: int(m[1]) if (m := re.search(r"urn:page:(-?\d+)", s or "")) else None
            revisit = fields["warc-type"] == "revisit"
            digest = fields["warc-payload-digest"].removeprefix("sha1:")
            out |= {"id": number(fields["warc-record-id"]), "url": fields.get("warc-target-uri"), "record_type": fields["warc-type"], "refers": number(fields.get("warc-refers-to")), "payload": None if revisit else payload, "payload_bytes": size, "payload_digest": digest}
            if f"sha1:{base32_sha1(block)}" != fields["warc-block-digest"]:
                raise ValueError("block digest differs")
            if not revisit and (base32_sha1(payload) != digest or len(payload) != size):
                raise ValueError("payload digest differs")
            out["verified"] = True
        except (ValueError, KeyError, TypeError, EOFError, zlib.error) as e:
            out["error"] = f"{type(e).__name__}: {e}"
        yield out
        if out["error"] and ("breaks off" in out["error"] or "error:" in out["error"]):
            return  # where the next member begins is unknown


SCHEMA = "file string, offset long, page_id long, url string, record_type string, refers_to long, payload binary, payload_bytes long, payload_digest string, verified boolean, error string"


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives in a folder. Archives are files of bounded size, one in memory at a time."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("verified", pa.bool_()), ("error", pa.string())])
        for b in batches:
            for name, content in zip(b.column(0), b.column(1)):
                rows, held = [], 0
                for r in read_records(memoryview(content.as_buffer())):
                    rows.append((name.as_py(), r["offset"], r["id"], r["url"], r["record_type"], r["refers"], r["payload"], r["payload_bytes"], r["payload_digest"], r["verified"], r["error"]))
                    held += len(r["payload"] or b"")
                    if held > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)

    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content").mapInArrow(read, SCHEMA)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), f"{scratch.root}/archive")
    return read_warc(spark, f"{scratch.root}/archive").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "verified")


_B32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Base 32 by groups of five hexadecimal digits, four letters each.
OP5_SQL = f"""
with p as (select page_id, coalesce(html, '') as body from pages),
     q as (select page_id, strlen(body) as n, sha1(body) as d, min(page_id) over (partition by body) as first from p),
     g as (select *, list_transform(range(8), lambda i: cast('0x' || substr(d, cast(5 * i + 1 as integer), 5) as bigint)) as v from q)
select page_id, cast(n as bigint) as payload_bytes,
       array_to_string(list_transform(v, lambda x: substr('{_B32}', cast((x >> 15) & 31 as integer) + 1, 1) || substr('{_B32}', cast((x >> 10) & 31 as integer) + 1, 1)
         || substr('{_B32}', cast((x >> 5) & 31 as integer) + 1, 1) || substr('{_B32}', cast(x & 31 as integer) + 1, 1)), '') as payload_digest,
       case when page_id = first then 'response' else 'revisit' end as record_type, case when page_id <> first then first end as refers_to, true as verified
from g
"""
