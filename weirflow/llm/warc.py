"""WARC writing, reading and transaction assembly.

Each page becomes one transaction of three records: a request, a response (or a revisit of an equal
payload) and a metadata record, the outer two naming the middle one in WARC-Concurrent-To. Reading
parses the archives into a table of records and joins request and metadata to their response by that
identifier into one nested row per capture.

Equal payloads are found by SHA-256 over a table without payloads; of at least MIN_REVISIT bytes, the
row with the largest page_id holds the payload and the others revisit it: they name its record in
WARC-Refers-To, whose identifier follows from payload and page. Pages whose payload is certainly not
repeated pass straight to the writers; of the others only those that may hold a payload, or may be
unrepeated after all, move with it.
Archives are gzip files with
one member per record, one archive per task, written under a temporary name and moved when complete;
their folder must be shared and open to pyarrow by URI.

Defined cases: null html is an empty payload; a null url is written as an empty target; rows that
share the largest page_id of a group are all responses, and revisits of them name none of their records
but share their digest; CR and LF in a url are left out; a null page_id loses to any other and reads
back as null; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_filter, passing, staged

MIN_REVISIT = 1000
LEVEL = 1
WHEN = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
READ_BYTES = 1 << 20
RECORDS = "kind string, record_id string, concurrent_to string, target_uri string, refers_to string, payload_digest string, payload_bytes long, fields map<string,string>, payload binary"


def decide(pages: DataFrame, page_id: str, html: str) -> DataFrame:
    """Pages as (page_id, url, html, sha, sha1, size, keep_id, keepers, revisit); keep_id is null unless the
    payload is repeated, html is null for a revisit."""
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col(html).cast("binary"), F.lit(b"")).alias("html"))
    rows = rows.select("page_id", "url", "html", F.sha2("html", 256).alias("sha"), F.sha1("html").alias("sha1"), F.octet_length("html").cast("long").alias("size"))
    keys = rows.filter(F.col("size") >= MIN_REVISIT).groupBy("sha", "page_id").agg(F.count("*").alias("rows"))
    payloads = keys.groupBy("sha").agg(F.sum("rows").alias("copies"), F.max(F.struct("page_id", "rows")).alias("keep"))
    payloads = staged(payloads.select("sha", F.col("keep.page_id").alias("keep_id"), F.col("keep.rows").alias("keepers"), "copies"), "payloads")
    groups = payloads.filter("copies > 1").drop("copies")
    may_repeat = passing(id_filter(groups.select(F.xxhash64("sha")), groups.count()))
    # rows that move with their payload: those that hold a group's, and the unrepeated that the filter takes for repeated
    carried = staged(payloads.filter((F.col("copies") > 1) | may_repeat(F.xxhash64("sha"))).select(F.xxhash64("sha", "keep_id").alias("h")), "carried")
    may_carry = passing(id_filter(carried, carried.count()))
    tested = rows.withColumn("maybe", (F.col("size") >= MIN_REVISIT) & may_repeat(F.xxhash64("sha")))
    out = ["page_id", "url", "html", "sha", "sha1", "size", "keep_id", "keepers", "revisit"]
    none = F.lit(None).cast("long")
    clear = tested.filter("NOT maybe").withColumns({"keep_id": none, "keepers": none, "revisit": F.lit(False)})
    light = F.when(may_carry(F.xxhash64("sha", "page_id")), F.col("html"))
    found = tested.filter("maybe").select("page_id", "url", light.alias("html"), "sha", "sha1", "size").join(groups, "sha", "left")
    found = found.withColumn("revisit", F.col("keep_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keep_id")))
    return clear.select(*out).unionByName(found.withColumn("html", F.when(~F.col("revisit"), F.col("html"))).select(*out))


def _record(kind: str, rid: str, url: str, extra: list[tuple[str, str]], body: bytes, content: str) -> bytes:
    head = [("WARC-Type", kind), ("WARC-Record-ID", rid), ("WARC-Date", WHEN), ("WARC-Target-URI", url), *extra, ("Content-Type", content), ("Content-Length", str(len(body)))]
    raw = b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + body + b"\r\n\r\n"
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def _rid(*parts) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(repr(parts).encode()).digest())}>"


def _transaction(part: int, row: int, page_id: int | None, url: str, html: bytes | None, sha: str, sha1: str, size: int, keep_id: int | None, keepers: int | None) -> bytes:
    """The three records of a page; html is None for a revisit."""
    digest = base64.b32encode(bytes.fromhex(sha1)).decode()
    ids = [_rid(kind, part, row, page_id) for kind in ("request", "response", "metadata")]
    kept = _rid("kept", sha, keep_id) if keepers == 1 else None
    if kept and html is not None:
        ids[1] = kept
    url = "".join(c for c in url if c not in "\r\n")
    host, _, path = url.partition("://")[2].partition("/")
    request = f"GET /{path} HTTP/1.1\r\nHost: {host}\r\n\r\n".encode()
    answer = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    extra = [("WARC-Payload-Digest", f"sha1:{digest}")]
    if html is None:
        extra += [("WARC-Profile", PROFILE)] + [("WARC-Refers-To", kept)] * bool(kept)
    facts = f"page-id: {'' if page_id is None else page_id}\r\npayload-length: {size}\r\n".encode()
    link = [("WARC-Concurrent-To", ids[1])]
    return (
        _record("request", ids[0], url, link, request, "application/http; msgtype=request")
        + _record("revisit" if html is None else "response", ids[1], url, extra, answer + (html or b""), "application/http; msgtype=response")
        + _record("metadata", ids[2], url, link, facts, "application/warc-fields")
    )


def write_archives(pages: DataFrame, folder: str, page_id: str = "page_id", html: str = "html") -> list[str]:
    """Write one archive per task; returns the file names, one per task."""

    def run(batches):
        from pyspark import TaskContext

        part, row, out = TaskContext.get().partitionId(), 0, None
        for b in batches:
            for p, u, h, *told in zip(*(b.column(i) for i in range(8)), strict=True):
                if out is None:
                    fs, where = pafs.FileSystem.from_uri(folder)
                    fs.create_dir(where, recursive=True)
                    name = f"part-{part:06d}.warc.gz"
                    tmp = f"{where}/.{name}.{uuid.uuid4().hex}"
                    out = fs.open_output_stream(tmp, compression=None)
                out.write(_transaction(part, row, p.as_py(), u.as_py() or "", h.as_py(), *(x.as_py() for x in told)))
                row += 1
        if out is not None:
            out.close()
            fs.move(tmp, f"{where}/{name}")
            yield pa.RecordBatch.from_pydict({"name": [name]})

    rows = decide(pages, page_id, html).select("page_id", "url", "html", "sha", "sha1", "size", "keep_id", "keepers")
    return sorted(r["name"] for r in rows.mapInArrow(run, "name string").collect())


def _members(f) -> Iterator[bytes]:
    """The decompressed gzip members of a file, one at a time."""
    z, parts, data = zlib.decompressobj(31), [], f.read(READ_BYTES)
    while data:
        parts.append(z.decompress(data))
        if z.eof:
            yield b"".join(parts)
            data, z, parts = z.unused_data or f.read(READ_BYTES), zlib.decompressobj(31), []
        else:
            data = f.read(READ_BYTES)
    if any(parts):
        raise ValueError("archive ends within a record")


def _fields(raw: bytes) -> dict[str, str]:
    pairs = (line.partition(":") for line in raw.decode().split("\r\n") if ":" in line)
    return {k.strip().lower(): v.strip() for k, _, v in pairs}


def parse(raw: bytes, with_payload: bool = True) -> dict:
    """One record as a row of RECORDS. A stored payload is held against its digest."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, _, lines = head.partition(b"\r\n")
    if not version.startswith(b"WARC/"):
        raise ValueError(f"not a WARC record: {version[:40]!r}")
    h = _fields(lines)
    body = rest[: int(h["content-length"])]
    kind, size, digest, payload, facts = h["warc-type"], None, None, None, {}
    if kind in ("response", "revisit"):
        digest = base64.b32decode(h["warc-payload-digest"].removeprefix("sha1:")).hex()
        if kind == "response":
            payload = body.partition(b"\r\n\r\n")[2]
            size = len(payload)
            if hashlib.sha1(payload).hexdigest() != digest:
                raise ValueError(f"payload of {h['warc-record-id']} doesn't match its digest")
    elif kind == "metadata":
        facts = _fields(body)
    else:
        facts = {"request-line": body.partition(b"\r\n")[0].decode()}
    return {
        "kind": kind, "record_id": h["warc-record-id"], "concurrent_to": h.get("warc-concurrent-to"), "target_uri": h.get("warc-target-uri"),
        "refers_to": h.get("warc-refers-to"), "payload_digest": digest, "payload_bytes": size, "fields": list(facts.items()), "payload": payload if with_payload else None,
    }


def read_records(spark: SparkSession, folder: str, names: list[str], with_payload: bool = True) -> DataFrame:
    """The archives' records as a table."""
    schema = pa.schema([
        *[(n, pa.string()) for n in ("kind", "record_id", "concurrent_to", "target_uri", "refers_to", "payload_digest")],
        ("payload_bytes", pa.int64()), ("fields", pa.map_(pa.string(), pa.string())), ("payload", pa.binary()),
    ])

    def run(batches):
        for b in batches:
            for name in b.column(0).to_pylist():
                fs, where = pafs.FileSystem.from_uri(folder)
                rows, size = [], 0
                with fs.open_input_stream(f"{where}/{name}", compression=None) as f:
                    for raw in _members(f):
                        rows.append(parse(raw, with_payload))
                        size += len(raw) if with_payload else 200
                        if size > 4 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    if not names:
        return spark.createDataFrame([], RECORDS)
    files = spark.createDataFrame([(n,) for n in names], "name string").repartitionByRange(len(names), "name")
    return files.mapInArrow(run, RECORDS)


def assemble(records: DataFrame) -> DataFrame:
    """One row per capture: (response, request, metadata) structs; a lacking request or metadata is null.

    `records` is read three times and should be staged: then archives are parsed once, and the sizes that
    decide between join strategies are those of the table, not a guess from the list of files.
    """
    response = records.filter(F.col("kind").isin("response", "revisit"))
    response = response.select(F.col("record_id").alias("id"), F.struct("kind", "record_id", "target_uri", "refers_to", "payload_digest", "payload_bytes", "payload").alias("response"))
    for kind in ("request", "metadata"):
        part = records.filter(F.col("kind") == kind).select(F.col("concurrent_to").alias("id"), F.struct("record_id", "target_uri", "fields").alias(kind))
        response = response.join(part, "id", "left")
    return response.drop("id")


def resolved(captures: DataFrame, key: Column) -> DataFrame:
    """Captures with `original`: for a revisit the key of the response that holds its payload, else null.

    It is found by the record that the revisit names, or, where it names none, by the digest. `captures` is
    read three times and should be staged; a named record is one row, a digest's responses are summed first.
    """
    held = captures.filter("response.kind = 'response'").select(F.col("response.record_id").alias("_id"), F.col("response.payload_digest").alias("_digest"), key.alias("_key"))
    by_digest = held.groupBy("_digest").agg(F.max("_key").alias("_by_digest"))
    named = F.col("response.refers_to") == F.col("_id")
    out = captures.join(held.select("_id", F.col("_key").alias("_by_id")), named, "left")
    unnamed = (F.col("response.kind") == "revisit") & F.col("_id").isNull() & (F.col("response.payload_digest") == F.col("_digest"))
    return out.join(by_digest, unnamed, "left").withColumn("original", F.coalesce("_by_id", "_by_digest")).drop("_id", "_by_id", "_digest", "_by_digest")
