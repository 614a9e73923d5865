"""WARC archives: writing with deduplication, and a sequential reader.

Writing: one gzip member a record.  Of rows with equal payloads (of at least
``least_bytes`` bytes) the one with the smallest identifier becomes a response
record, the others revisit records that refer to it.  Which is which is settled
on a narrow table of identifiers, addresses and digests, with the number of
rows of each, so rows that repeat and payloads that very many rows share make
no hot task; a revisit record has no payload and is written from that table.
Payloads cross the network once, by identifier, address and digest.
Each task writes archives of bounded size under names of its own into a folder
on a file system that all executors share, and returns their names; only
archives that successful tasks named are read.

Reading: archives are decompressed incrementally, member by member; each
record is framed by its Content-Length, must end where its member ends, and
its payload is checked against its digest.  As many tasks read as there are
archives.

Defined cases: a null payload is empty; null identifiers and then null
addresses come last, so they are responses only where no other row has the
payload; repeated rows are separate records, one of them the response; an
empty table gives no archive and an empty result; extra columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.textkit import bounded_batches, map_batches
from tessera.storage import fresh_path, materialise

ARCHIVE_BYTES = 32_000_000
CHUNK = 1 << 16
#: A payload or row is frequent from this many rows, and from this part of all; copies are dealt to tasks by so many.
FREQUENT_ROWS, FREQUENT_PART, COPIES = 1_000, 1_000, 1_000
LEVEL = 5
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
MANIFEST = "path string, records long, bytes long"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _record_id(page_id: int | None, url: str | None, digest: str, copy: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}/{copy}/{url}')}>"


def encode_record(page_id: int | None, url: str | None, payload: bytes, digest: str, copy: int = 0, original: tuple[int | None, str | None] | None = None, size: int | None = None, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """One gzip member: a response, or with ``original`` (its identifier and address) a revisit of a payload of ``size`` bytes."""
    block = _HTTP if original else _HTTP + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if original else 'response'}",
        f"WARC-Record-ID: {_record_id(page_id, url, digest, copy)}",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
        f"X-Payload-Length: {len(payload) if size is None else size}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if original:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {_record_id(*original, digest, 0)}"]
        if original[0] is not None:
            head.append(f"X-Refers-To-Page-ID: {original[0]}")
    squeeze = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return squeeze.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + squeeze.flush()


def read_members(stream) -> Iterator[bytes]:
    """The decompressed gzip members of a file, read in chunks from start to end."""
    inflate, parts, pending = None, [], b""
    while chunk := pending or stream.read(CHUNK):
        pending = b""
        if inflate is None:
            inflate, parts = zlib.decompressobj(31), []
        parts.append(inflate.decompress(chunk))
        if inflate.eof:
            pending = inflate.unused_data
            yield b"".join(parts)
            inflate = None
    if inflate is not None:
        raise ValueError("an archive ends inside a gzip member")


def decode_record(member: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and content block of one record, framed by Content-Length and verified."""
    end = member.find(b"\r\n\r\n")
    lines = member[: max(end, 0)].decode().split("\r\n")
    if end < 0 or not lines[0].startswith("WARC/1."):
        raise ValueError("a gzip member does not start with a WARC record")
    headers = {name.strip().lower(): value.strip() for name, _, value in (line.partition(":") for line in lines[1:])}
    size = int(headers["content-length"])
    block, rest = member[end + 4 : end + 4 + size], member[end + 4 + size :]
    if len(block) != size or rest != b"\r\n\r\n":
        raise ValueError("a record's content length and its gzip member disagree")
    if "warc-block-digest" in headers and headers["warc-block-digest"] != "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode():
        raise ValueError("a block does not match its digest")
    return headers, block


def payload_of(headers: dict[str, str], block: bytes) -> bytes:
    """The payload behind the HTTP header, checked against the payload digest of a response."""
    payload = block.partition(b"\r\n\r\n")[2]
    if headers["warc-type"] == "response" and headers["warc-payload-digest"] != "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode():
        raise ValueError("a payload does not match its digest")
    return payload


def _records(pages: DataFrame, page_id: str, url: str, html: str, least_bytes: int) -> DataFrame:
    """(page_id, url, payload, sha1, copy, revisit, first_page_id, first_url, size) of every record; revisits have no payload."""
    payload = F.coalesce(F.col(html).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("size", F.octet_length("payload").cast("long")).withColumn("sha1", F.unhex(F.sha1("payload")))
    small = rows.where(F.col("size") < least_bytes)
    rows = rows.where(F.col("size") >= least_bytes)
    # one name for equal rows, never null
    name = F.concat_ws("/", F.coalesce(F.col("page_id").cast("string"), F.lit("-")), F.hex("sha1"), F.coalesce(F.concat(F.lit("+"), "url"), F.lit("-")))
    rows = rows.withColumn("key", F.unhex(F.sha1(name.cast("binary"))))
    narrow = materialise(rows.groupBy("key").agg(F.any_value("page_id").alias("page_id"), F.any_value("url").alias("url"), F.any_value("sha1").alias("sha1"), F.any_value("size").alias("size"), F.count("*").alias("rows")), "keys")
    order = F.struct(F.col("page_id").isNull().alias("p"), "page_id", F.col("url").isNull().alias("u"), "url", "key", "rows")
    firsts = narrow.groupBy("sha1").agg(F.min(order).alias("first"), F.count("*").alias("keys"))
    firsts = materialise(firsts.select("sha1", "keys", *[F.col(f"first.{c}").alias(f"first_{c}") for c in ("page_id", "url", "key", "rows")]), "firsts")
    # the few keys of many rows are joined by broadcast: each takes a fixed part of all rows
    most = max(FREQUENT_ROWS, narrow.agg(F.coalesce(F.sum("rows"), F.lit(0))).head()[0] // FREQUENT_PART)
    chosen = firsts.select(F.col("first_key").alias("key"), F.col("first_rows").alias("rows"))
    hot = F.broadcast(narrow.where(F.col("rows") > most).select("key"))
    wanted = rows.join(F.broadcast(chosen.where(F.col("rows") > most).select("key")), "key").unionByName(
        rows.join(hot, "key", "left_anti").join(chosen.where(F.col("rows") <= most).select("key"), "key")
    )
    copy = F.lit(0).cast("long")
    none = [F.lit(None).cast("long").alias("first_page_id"), F.lit(None).cast("string").alias("first_url")]
    responses = wanted.groupBy("key").agg(*[F.any_value(c).alias(c) for c in ("page_id", "url", "payload", "sha1", "size")])
    responses = responses.select("page_id", "url", "payload", "sha1", copy.alias("copy"), F.lit(False).alias("revisit"), *none, "size")
    shared = firsts.where("keys > 1 or first_rows > 1").select("sha1", "first_page_id", "first_url", "first_key", "keys")
    often = F.broadcast(shared.where(F.col("keys") > most))
    others = narrow.join(often.select("sha1"), "sha1", "left_anti").join(shared.where(F.col("keys") <= most), "sha1")
    again = narrow.join(often, "sha1").unionByName(others)
    begin = F.when(F.col("key") == F.col("first_key"), 1).otherwise(0).cast("long")
    again = again.withColumn("begin", begin).where(F.col("begin") < F.col("rows"))
    parts = again.withColumn("part", F.explode(F.sequence("begin", F.col("rows") - 1, F.lit(COPIES).cast("long"))))
    if not again.where(F.col("rows") > COPIES).isEmpty():
        parts = parts.repartition("key", "part")  # the copies of one row go to many tasks
    last = F.least(F.col("part") + COPIES, F.col("rows")) - 1
    revisits = parts.withColumn("copy", F.explode(F.sequence("part", last))).select("page_id", "url", F.lit(None).cast("binary").alias("payload"), "sha1", "copy", F.lit(True).alias("revisit"), "first_page_id", "first_url", "size")
    out = responses.unionByName(revisits)
    if least_bytes > 0:
        out = out.unionByName(small.select("page_id", "url", "payload", "sha1", F.monotonically_increasing_id().alias("copy"), F.lit(False).alias("revisit"), *none, "size"))
    return out


def write_warc(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Archives of all rows under ``folder``; returns their manifest (path, records, bytes)."""
    bounded_batches(pages.sparkSession)
    placed = _records(pages, page_id, url, html, least_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = pafs.FileSystem.from_uri(folder)
        system.create_dir(root, recursive=True)
        out, name, records, written, done = None, "", 0, 0, []

        def close() -> None:
            out.close()
            done.append((name, records, written))

        for batch in batches:
            for i, u, body, sha1, copy, revisit, first, address, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                digest = base64.b32encode(sha1).decode()
                member = encode_record(i, u, body or b"", digest, copy, (first, address) if revisit else None, size, date)
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out, records, written = system.open_output_stream(f"{root}/{name}", compression=None), 0, 0
                out.write(member)
                records, written = records + 1, written + len(member)
                if written >= ARCHIVE_BYTES:
                    close()
                    out = None
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays(
            [pa.array([f"{folder.rstrip('/')}/{d[0]}" for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.int64())],
            ["path", "records", "bytes"],
        )

    return materialise(map_batches(placed, run, MANIFEST), "manifest")


def read_warc(manifest: DataFrame) -> DataFrame:
    """One row for each record of the archives in ``manifest`` (path); a task for each archive."""
    archives = max(1, manifest.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def table(found):
            columns = list(zip(*found, strict=True)) if found else [()] * 6
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [f.split()[0] for f in RECORDS.split(", ")])

        whole = lambda x: None if x is None else int(x)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                system, place = pafs.FileSystem.from_uri(path)
                found = []
                with system.open_input_stream(place, compression=None) as stream:
                    for member in read_members(stream):
                        headers, block = decode_record(member)
                        size = len(payload_of(headers, block)) if headers["warc-type"] == "response" else int(headers["x-payload-length"])
                        found.append((whole(headers.get("x-page-id")), headers.get("warc-target-uri"), size, headers["warc-payload-digest"].removeprefix("sha1:"), headers["warc-type"], whole(headers.get("x-refers-to-page-id"))))
                        if len(found) == 5000:
                            yield table(found)
                            found = []
                yield table(found)

    return map_batches(manifest.select("path").repartition(archives, "path"), run, RECORDS)


def op10_warc(spark, sf_dir: str) -> DataFrame:
    """All pages written to archives and read back."""
    folder = fresh_path(spark, "warc")
    manifest = write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"), folder)
    return read_warc(manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
