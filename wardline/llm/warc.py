"""WARC archives of pages, compressed with a dictionary of their own.

Each archive file starts with a skippable Zstandard frame that holds a dictionary built from some of its records;
every record follows as a frame of its own, so that one can be read without the others. Payloads that repeat are
stored once: the row of the smallest id is a response, the others are revisit records that name it.

Executors write to the shared folder through pyarrow's file systems under a name of the attempt; only the paths that
finished tasks return are read, so an attempt that died leaves nothing in effect.

Defined results: a null html is an empty payload; payloads below ``least`` bytes are always responses; repeated rows of
the smallest id are all responses; a null id is written as an empty field, sorts last and becomes a response only if
all its copies have none; a null url is an empty field; an empty table makes no archive; only the named columns are read.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import maybe_in, not_in, scratch, slots_of, stored, table

#: Fixed values of the formats: magic numbers of the dictionary's skippable frame and of data frames.
SKIPPABLE, FRAME = 0x184D2A5D, 0xFD2FB528
LEAST_REVISIT = 100
#: Raw bytes of records in one archive; bytes of records the dictionary is built from; its size.
ARCHIVE_BYTES, SAMPLE_BYTES, DICT_BYTES = 48 << 20, 4 << 20, 64 << 10
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record(page_id, url: str, payload: bytes, digest: str, size: int, refers_to, date: str) -> bytes:
    """One WARC/1.1 record; a revisit's block ends with the HTTP headers."""
    revisit = refers_to is not None
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size + (b"" if revisit else payload)
    name = lambda i: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{i}')}>"
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {date}",
        "WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"), f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}", f"X-Page-ID: {'' if page_id is None else page_id}", f"X-Payload-Length: {size}",
        *([f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {name(refers_to)}", f"X-Refers-To-Page-ID: {refers_to}"] if revisit else []),
    ]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """Fields of a record and its payload; raises ValueError where lengths or digests do not hold."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    field = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    n = int(field["Content-Length"])
    if lines[0] != "WARC/1.1" or len(rest) != n + 4 or not rest.endswith(b"\r\n\r\n"):
        raise ValueError("not a whole WARC record")
    payload = rest[:n].partition(b"\r\n\r\n")[2]
    kind, digest = field["WARC-Type"], field["WARC-Payload-Digest"].removeprefix("sha256:")
    if kind == "response" and (hashlib.sha256(payload).hexdigest() != digest or len(payload) != int(field["X-Payload-Length"])):
        raise ValueError("payload and digest differ")
    number = lambda k: int(field[k]) if field.get(k) else None
    return {"page_id": number("X-Page-ID"), "url": field["WARC-Target-URI"], "payload_bytes": number("X-Payload-Length"), "payload_digest": digest, "record_type": kind, "refers_to": number("X-Refers-To-Page-ID"), "payload": payload if kind == "response" else None}


def build_dictionary(records: list[bytes]) -> bytes:
    """From evenly spaced records, SAMPLE_BYTES of them at most; empty where there are too few to learn from."""
    total = sum(map(len, records))
    step = max(1, -(-total // SAMPLE_BYTES))
    sample = [r[: SAMPLE_BYTES // 16] for r in records[::step]]
    if len(sample) < 16:
        return b""
    try:
        return zstandard.train_dictionary(min(DICT_BYTES, max(1024, sum(map(len, sample)) // 8)), sample, k=256, d=8).as_bytes()
    except zstandard.ZstdError:  # too few or too even samples
        return b""


def archive(records: list[bytes], level: int = 6) -> Iterator[bytes]:
    """The parts of an archive file: the dictionary's frame, then a frame for each record."""
    words = build_dictionary(records)
    yield struct.pack("<II", SKIPPABLE, len(words)) + words
    made = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(words) if words else None, write_checksum=True, write_content_size=True)
    for r in records:
        yield made.compress(r)


def read_archive(data) -> Iterator[dict]:
    """Records of an archive, from a readable file."""
    magic, n = struct.unpack("<II", data.read(8))
    if magic != SKIPPABLE:
        raise ValueError("no dictionary frame")
    words = data.read(n)
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(words) if words else None)
    rest = b""
    while True:
        if not rest:
            rest = data.read(1 << 20)
            if not rest:
                return
        frame, out = reader.decompressobj(), []
        while True:
            out.append(frame.decompress(rest))
            if frame.eof:
                rest = frame.unused_data
                break
            rest = data.read(1 << 20)
            if not rest:
                raise ValueError("an archive ends inside a record")
        yield parse(b"".join(out))


def plan_records(pages: DataFrame, least: int = LEAST_REVISIT, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, payload, size, digest, refers_to): what each row is stored as. Revisits carry no payload."""
    raw = pages.select(F.col(id_col).cast("long").alias("page_id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"), F.encode(F.coalesce(F.col(html_col).cast("string"), F.lit("")), "utf-8").alias("payload"))
    raw = raw.withColumn("digest", F.sha2("payload", 256)).withColumn("size", F.octet_length("payload").cast("long"))
    first = stored(raw.where(F.col("size") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "first")
    # most payloads stay where they are; those of copies meet their digest's first page without payloads
    slots = stored(slots_of(first, "digest"), "digest_slots")
    doubtful = maybe_in(raw, F.col("digest"), slots)
    refers = F.when((F.col("size") >= least) & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    met = stored(doubtful.drop("payload").join(first, "digest", "left").withColumn("refers_to", refers).drop("first"), "met")
    whole = met.where("refers_to IS NULL").select(F.col("page_id").alias("_page"), F.col("digest").alias("_digest")).distinct()
    kept = doubtful.join(whole, F.expr("page_id <=> _page AND digest = _digest"), "left_semi")
    names, none = ["page_id", "url", "payload", "size", "digest"], F.lit(None)
    out = not_in(raw, F.col("digest"), slots).select(*names).unionByName(kept.select(*names)).withColumn("refers_to", none.cast("long"))
    return out.unionByName(met.where("refers_to IS NOT NULL").withColumn("payload", none.cast("binary")).select(*names, "refers_to"))


def _store(root: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder as executors write to it, under Hadoop's names of schemes too."""
    scheme, colon, rest = root.partition(":")
    return fs.FileSystem.from_uri({"s3a": "s3", "s3n": "s3", "abfss": "abfs"}.get(scheme, scheme) + colon + rest)


def write(records: DataFrame, root: str, date: str = "2024-01-01T00:00:00Z", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write archives below ``root``; one row (path, n_records, n_bytes) for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = _store(root)
        store.create_dir(folder, recursive=True)

        def flush(held: list[bytes]) -> pa.RecordBatch:
            path, n = f"{folder}/{uuid.uuid4().hex}.warc.zst", 0
            with store.open_output_stream(path) as f:
                for part in archive(held):
                    n += f.write(part) or len(part)
            return pa.record_batch([pa.array([path.rsplit("/", 1)[1]]), pa.array([len(held)], pa.int64()), pa.array([n], pa.int64())], ["path", "n_records", "n_bytes"])

        held, size = [], 0
        for b in batches:
            for page_id, url, payload, n, digest, refers_to in zip(*(c.to_pylist() for c in b.columns), strict=True):
                held.append(record(page_id, url, payload or b"", digest, n, refers_to, date))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield flush(held)
                    held, size = [], 0
        if held:
            yield flush(held)

    return records.select("page_id", "url", "payload", "size", "digest", "refers_to").mapInArrow(run, "path string, n_records long, n_bytes long")


def read(archives: DataFrame, root: str, payloads: bool = False) -> DataFrame:
    """Rows of the archives named in ``archives`` (path), which must be as many as were written."""
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", *(["payload"] if payloads else [])]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), *([pa.binary()] if payloads else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = _store(root)
        make = lambda rows: pa.record_batch([pa.array([r[c] for r in rows], k) for c, k in zip(names, kinds, strict=True)], names)
        for b in batches:
            for path, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows, seen = [], 0
                with store.open_input_stream(f"{folder}/{path}") as f:
                    for r in read_archive(f):
                        rows.append(r)
                        seen += 1
                        if len(rows) == 256:
                            yield make(rows)
                            rows = []
                if seen != n:
                    raise ValueError(f"{path} holds {seen} records, not {n}")
                if rows:
                    yield make(rows)

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string" + (", payload binary" if payloads else "")
    return archives.select("path", "n_records").mapInArrow(run, schema)


def op9_query(spark, sf_dir):
    from .common import parts

    root = scratch(spark, "warc")
    written = stored(write(plan_records(table(spark, sf_dir, "pages")), root), "archives")
    return read(written.repartition(parts(spark)), root).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP9_SQL = r"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, CAST(octet_length(b) AS BIGINT) AS payload_bytes, sha256(b) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND first IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND first IS DISTINCT FROM page_id THEN first END AS refers_to
FROM f
"""
