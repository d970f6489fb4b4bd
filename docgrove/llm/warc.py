"""WARC archives with revisit records for equal payloads.

``write_archives`` shuffles only headers (page id, digest, length) by payload
digest to choose one response for each group of equal payloads: the largest
page_id. All others become revisit records that refer to it and carry no
payload. Payloads are shuffled once, to meet their roles, and are written as
gzip-per-record WARC/1.1 files of bounded size to the shared folder. A task
writes under a name of its own attempt and the manifest lists what finished
tasks wrote, so a lost or repeated task leaves no half archive in the result.
``read_archives`` streams the records back; ``resolve_revisits`` joins revisit
records to the responses they name.

Scale: the choice of responses is a partial aggregate; its join back is salted,
since one payload may be a third of all pages. Archives roll at ``ROLL_BYTES``.

Defined cases: a null html is an empty payload; a null url leaves the target URI
out; control characters, spaces and non-ASCII in a url are percent-encoded; a
null page_id is smaller than any other and never refers or is referred to, so it
is always a response; rows that repeat a whole (page_id, payload) share the
response's id, the surplus ones being revisits of it; an empty table gives
no records; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import io
import time
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import save, shared_folder

ROLL_BYTES = 256 << 20
SALTS = 16
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_URN = "urn:x-page:"


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, record_id: str, date: str, payload: bytes, payload_digest: str, payload_bytes: int, uri: str | None = None, refers_to: str | None = None, refers_uri: str | None = None) -> bytes:
    """One WARC/1.1 record; a revisit has no block but keeps digest and length of the payload."""
    block = payload if kind == "response" else b""
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {date}"]
    if uri is not None:
        head.append(f"WARC-Target-URI: {uri}")
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{refers_to}>"]
        if refers_uri is not None:
            head.append(f"WARC-Refers-To-Target-URI: {refers_uri}")
    head += [f"WARC-Payload-Digest: sha1:{payload_digest}", f"X-Payload-Length: {payload_bytes}", "Content-Type: text/html; charset=utf-8", f"Content-Length: {len(block)}"]
    return b"WARC/1.1\r\n" + "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def clean_uri(url: str | None) -> str | None:
    return None if url is None else quote(url, safe="%/:?#[]@!$&'()*+,;=-._~")


def _gzip(data: bytes, level: int) -> bytes:
    c = zlib.compressobj(level, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def _headers(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        payloads = [x or b"" for x in batch.column(1).cast(pa.large_binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([digest(x) for x in payloads], pa.string()), pa.array([len(x) for x in payloads], pa.int64())], ["page_id", "payload_digest", "payload_bytes"]
        )


def page_heads(pages: DataFrame) -> DataFrame:
    """(page_id, payload_digest, payload_bytes, n) of each distinct page_id and payload; ``n`` counts repeated rows."""
    heads = pages.select(F.col("page_id").cast("long"), "html").mapInArrow(_headers, "page_id long, payload_digest string, payload_bytes long")
    return save(heads.groupBy("page_id", "payload_digest", "payload_bytes").agg(F.count(F.lit(1)).alias("n")))


def roles(heads: DataFrame, min_bytes: int = 0) -> DataFrame:
    """The heads with ``refers_to``, which is null for the response of a group."""
    chosen = heads.where(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("group"))
    chosen = chosen.where("group > 1").select(F.col("payload_digest").alias("d"), "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("s")).hint("merge")
    salted = heads.withColumn("salt", F.pmod(F.hash("page_id"), F.lit(SALTS)))
    j = salted.join(chosen, (F.col("payload_digest") == F.col("d")) & (F.col("salt") == F.col("s")) & F.col("page_id").isNotNull(), "left")
    return j.select("page_id", "payload_digest", "payload_bytes", "n", F.when(F.col("first") != F.col("page_id"), F.col("first")).alias("refers_to"))


def _writer(folder: str, level: int, roll: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pyarrow.fs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        ctx = TaskContext.get()
        stem = f"{base}/part-{ctx.partitionId() if ctx else 0:06d}-{uuid.uuid4().hex[:12]}"
        date = time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime())
        out, size, n, k = None, 0, 0, 0
        done: list[tuple[str, int]] = []
        written: set[tuple] = set()
        for batch in it:
            c = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            rows = zip(c["page_id"].to_pylist(), c["url"].to_pylist(), c["html"].cast(pa.large_binary()).to_pylist(), c["payload_digest"].to_pylist(), c["refers_to"].to_pylist(), c["n"].to_pylist())
            for page, url, html, d, refers, copies in rows:
                if out is None:
                    path = f"{stem}-{k:04d}.warc.gz"
                    out, size, n, k = fs.open_output_stream(path, compression=None), 0, 0, k + 1
                payload = html or b""
                if refers is None and copies > 1 and page is not None:
                    # of repeated rows one is the response, the surplus revisit it
                    if (page, d) in written:
                        refers = page
                    written.add((page, d))
                kind = "response" if refers is None else "revisit"
                rid = f"{_URN}{'null' if page is None else page}"
                data = _gzip(record(kind, rid, date, payload, d, len(payload), clean_uri(url), None if refers is None else f"{_URN}{refers}"), level)
                out.write(data)
                size += len(data)
                n += 1
                if size >= roll:
                    out.close()
                    done.append((path, n))
                    out = None
        if out is not None:
            out.close()
            done.append((path, n))
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in done], pa.string()), pa.array([x for _, x in done], pa.int64())], ["path", "records"])

    return run


def write_archives(pages: DataFrame, folder: str | None = None, min_bytes: int = 0, level: int = 6) -> tuple[str, DataFrame]:
    """Write one record for each row of ``pages`` (page_id, url, html); the folder's URI and a manifest (path, records)."""
    spark = pages.sparkSession
    folder = folder or f"{shared_folder(spark)}-warc"
    if "://" not in folder and not folder.startswith("file:"):
        folder = f"file://{folder}"
    folder = folder.replace("file:///", "file:/", 1).replace("file:/", "file:///", 1)
    heads = page_heads(pages)
    role = roles(heads, min_bytes).select(F.col("page_id").alias("_p"), F.col("payload_digest").alias("_d"), "refers_to", "n")
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    rows = rows.mapInArrow(_with_digest, "page_id long, url string, html string, payload_digest string")
    told = rows.join(role, F.col("page_id").eqNullSafe(F.col("_p")) & (F.col("payload_digest") == F.col("_d")))
    told = told.select("page_id", "url", "html", "payload_digest", "refers_to", "n")
    if heads.where("n > 1").limit(1).count():  # rows that repeat: one task for each page_id and payload tells the first from the others
        told = told.where("n = 1").union(told.where("n > 1").repartition("page_id", "payload_digest"))
    manifest = save(told.mapInArrow(_writer(folder, level, ROLL_BYTES), "path string, records long"))
    return folder, manifest


def _with_digest(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        d = [digest(x or b"") for x in batch.column(2).cast(pa.large_binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(d, pa.string())], [*batch.schema.names, "payload_digest"])


def parse(stream: io.RawIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and blocks of a gzip-per-record archive, one record in memory at a time."""
    inflate = zlib.decompressobj(31)
    held = bytearray()
    while True:
        data = inflate.unused_data or stream.read(1 << 20)
        if not data:
            if held:
                raise ValueError("the archive ends within a record")
            return
        if inflate.eof:
            inflate = zlib.decompressobj(31)
        held += inflate.decompress(data)
        if inflate.eof:
            yield _record(bytes(held))
            held = bytearray()


def _record(data: bytes) -> tuple[dict[str, str], bytes]:
    head, mark, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.split(b"\r\n")
    if not mark or not version.startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.decode().lower(): v.strip().decode() for k, _, v in (x.partition(b":") for x in lines)}
    n = int(fields["content-length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    return fields, rest[:n]


_READ = "path string, record_id string, record_type string, target_uri string, refers_to string, payload_digest string, payload_length long, payload binary"


def _reader(folder: str, payloads: bool):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pyarrow.fs.FileSystem.from_uri(folder)
        schema = pa.schema([("path", pa.string()), ("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()), ("refers_to", pa.string()), ("payload_digest", pa.string()), ("payload_length", pa.int64()), ("payload", pa.binary())])
        rows: list[tuple] = []
        size = 0
        for batch in it:
            for path in batch.column(0).to_pylist():
                with fs.open_input_stream(path, compression=None) as f:
                    for h, block in parse(f):
                        kind = h["warc-type"]
                        if kind == "response":
                            d = digest(block)
                            if h.get("warc-payload-digest") != f"sha1:{d}":
                                raise ValueError(f"the digest of {h['warc-record-id']} doesn't match its payload")
                            length = len(block)
                        else:
                            d, length = h["warc-payload-digest"].removeprefix("sha1:"), int(h["x-payload-length"])
                        rows.append((path, h["warc-record-id"].strip("<>"), kind, h.get("warc-target-uri"), (h.get("warc-refers-to") or "").strip("<>") or None, d, length, block if payloads else None))
                        size += len(block) if payloads else 200
                        if size > 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*rows), schema)], schema=schema)
                            rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*rows), schema)], schema=schema)

    return run


def read_archives(folder: str, manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """Records of the archives that a manifest lists; a response's digest is computed anew and verified."""
    n = max(1, manifest.rdd.getNumPartitions())
    return manifest.select("path").repartition(n).mapInArrow(_reader(folder, payloads), _READ)


def resolve_revisits(records: DataFrame) -> DataFrame:
    """Each record with ``response_digest`` and ``response_length`` of the response that it is or refers to.

    A revisit whose response is missing or has another digest gets nulls.
    """
    responses = records.where("record_type = 'response'").select(F.col("record_id").alias("_id"), F.col("payload_digest").alias("_d"), F.col("payload_length").alias("_l")).where(f"_id <> '{_URN}null'")
    asked = records.where("record_type = 'revisit'").select(F.col("refers_to").alias("_id")).distinct()
    wanted = responses.join(asked, "_id", "left_semi").select("_id", "_d", "_l", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_s")).hint("merge")
    revisits = records.where("record_type = 'revisit'").withColumn("_salt", F.pmod(F.hash("record_id"), F.lit(SALTS)))
    joined = revisits.join(wanted, (F.col("refers_to") == F.col("_id")) & (F.col("payload_digest") == F.col("_d")) & (F.col("_salt") == F.col("_s")), "left")
    resolved = joined.select(*records.columns, F.col("_d").alias("response_digest"), F.col("_l").alias("response_length"))
    own = records.where("record_type = 'response'").select(*records.columns, F.col("payload_digest").alias("response_digest"), F.col("payload_length").alias("response_length"))
    return own.unionByName(resolved)


def page_of(column: str) -> F.Column:
    return F.substring(F.col(column), len(_URN) + 1, 30).try_cast("long")
