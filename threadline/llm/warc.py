"""WARC archives compressed record by record with a shared Zstandard dictionary.

File layout: one leading skippable frame (magic 0x184D2A5D) that holds the
dictionary, then one Zstandard frame per record. A reader needs the dictionary
and any run of frames, so a file can be read in byte ranges; the writer emits
such ranges as a manifest table.

Defined results: null payloads are empty ones; null ids are written without an
id header and read back as null; rows repeated in the input are records of
their own, and of equal payloads every record with the largest id is the
response; an empty table gives no files and no rows; further columns of the
input are ignored. A frame that fails any check raises ValueError naming it.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch, table

#: Fixed values of the WARC/1.1 and WARC-Zstandard formats.
DICT_MAGIC = 0x184D2A5D
ZSTD_MAGIC = 0xFD2FB528
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"

#: Payloads that the dictionary is fitted on, and how many bytes of each, per file.
DICT_SAMPLES, DICT_SAMPLE_BYTES, DICT_BYTES = 160, 4096, 16384
#: Uncompressed bytes after which a manifest range ends.
RANGE_BYTES = 8 << 20

MANIFEST = "path string, offset long, length long, records long"
RECORD = "record_id string, record_type string, target_uri string, page_id long, refers_to long, payload_bytes long, payload_digest string, payload binary"


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def build_record(page_id, url, payload: bytes, digest: str, refers_to, is_revisit: bool, date: str) -> bytes:
    """One WARC record; a revisit keeps the HTTP head and leaves the payload out."""
    head = HTTP_HEAD % len(payload)
    block = head if is_revisit else head + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if is_revisit else 'response'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}|{url}|{digest}')}>",
        f"WARC-Date: {date}",
        "WARC-Target-URI: " + re.sub(r"[\r\n]", "", url or ""),
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{sha1_base32(block)}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if is_revisit:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"X-Refers-To-Page-ID: {refers_to}"]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes, where: str = "") -> dict:
    """A record's fields, after its version, lengths, digests and end have been checked."""

    def bad(what: str) -> ValueError:
        return ValueError(f"WARC record {where}: {what}")

    end = raw.find(b"\r\n\r\n")
    if end < 0:
        raise bad("the header has no end")
    first, *lines = raw[:end].decode("utf-8").split("\r\n")
    if not re.fullmatch(r"WARC/1\.[01]", first):
        raise bad(f"version {first[:20]!r}")
    heads: dict[str, str] = {}
    for line in lines:
        name, colon, value = line.partition(":")
        if not colon or not name:
            raise bad(f"header line {line[:40]!r}")
        heads[name.lower()] = value.strip()
    for need in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if need not in heads:
            raise bad(f"no {need}")
    if not heads["content-length"].isdigit():
        raise bad("Content-Length is no number")
    n = int(heads["content-length"])
    block, tail = raw[end + 4 : end + 4 + n], raw[end + 4 + n :]
    if len(block) != n or tail != b"\r\n\r\n":
        raise bad(f"Content-Length {n}, but {len(raw) - end - 8} bytes in the frame")
    if (d := heads.get("warc-block-digest")) and d != f"sha1:{sha1_base32(block)}":
        raise bad("block digest")
    kind, payload = heads["warc-type"], None
    digest = heads.get("warc-payload-digest", "").removeprefix("sha1:") or None
    if kind == "response":
        cut = block.find(b"\r\n\r\n")
        if cut < 0:
            raise bad("the HTTP head has no end")
        payload = block[cut + 4 :]
        length = re.search(rb"(?i)\r\ncontent-length: *(\d+)", block[:cut])
        if length and int(length[1]) != len(payload):
            raise bad("HTTP Content-Length")
        if digest and digest != sha1_base32(payload):
            raise bad("payload digest")
    number = lambda k: int(heads[k]) if k in heads else None
    return {
        "record_id": heads["warc-record-id"], "record_type": kind, "target_uri": heads.get("warc-target-uri"),
        "page_id": number("x-page-id"), "refers_to": number("x-refers-to-page-id"),
        "payload_bytes": len(payload) if payload is not None else number("x-payload-length"),
        "payload_digest": digest, "payload": payload,
    }


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def with_revisits(pages: DataFrame, id_col: str, url_col: str, body_col: str) -> DataFrame:
    """page_id, url, payload, digest, refers_to, is_revisit: equal payloads point at the largest id.

    Only digests of payloads that occur more than once are joined back, as a
    hashed build side that has one row per digest; a digest shared by a third
    of all pages is counted map-side first, and its join partition is split by
    adaptive execution.
    """
    body = F.coalesce(F.col(body_col), F.lit("")).cast("binary")
    p = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), body.alias("payload")).withColumn("digest", F.sha1("payload"))
    first: Column = F.max("page_id")
    groups = p.select("digest", "page_id").groupBy("digest").agg(first.alias("first"), F.count("*").alias("n")).filter("n > 1")
    j = p.join(groups.select("digest", "first").hint("shuffle_hash"), "digest", "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return j.select("page_id", "url", "payload", F.when(revisit, F.col("first")).alias("refers_to"), revisit.alias("is_revisit"))


def write_archives(records: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", level: int = 3) -> DataFrame:
    """Write records (page_id, url, payload, refers_to, is_revisit), a file a task, and return the manifest.

    Each attempt writes a file of its own name; only files of attempts that
    were committed are in the manifest, so that lost or repeated tasks leave
    nothing that a reader would see.
    """
    spark = records.sparkSession

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs = out = ctx = None
        ranges: list[tuple] = []
        at = begun = plain = count = 0
        for batch in batches:
            rows = batch.to_pydict()
            if not batch.num_rows:
                continue
            if out is None:
                fs, base = filesystem(path)
                fs.create_dir(base, recursive=True)
                name = f"part-{uuid.uuid4().hex}.warc.zst"
                out = fs.open_output_stream(f"{base}/{name}", compression=None)
                samples = [x[:DICT_SAMPLE_BYTES] for x in rows["payload"][:DICT_SAMPLES] if x]
                try:
                    fitted = zstandard.train_dictionary(DICT_BYTES, samples)
                except zstandard.ZstdError:  # too few samples: what there is serves as it stands
                    fitted = zstandard.ZstdCompressionDict(b"".join(samples)[:DICT_BYTES] or b"\0" * 8, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                body = fitted.as_bytes()
                out.write(struct.pack("<II", DICT_MAGIC, len(body)) + body)
                at = begun = 8 + len(body)
                ctx = zstandard.ZstdCompressor(level=level, dict_data=fitted, write_content_size=True, write_checksum=True)
            for i in range(batch.num_rows):
                payload = rows["payload"][i] or b""
                raw = build_record(rows["page_id"][i], rows["url"][i], payload, sha1_base32(payload), rows["refers_to"][i], rows["is_revisit"][i], date)
                frame = ctx.compress(raw)
                out.write(frame)
                at, plain, count = at + len(frame), plain + len(raw), count + 1
                if plain >= RANGE_BYTES:
                    ranges.append((f"{path}/{name}", begun, at - begun, count))
                    begun, plain, count = at, 0, 0
        if out is not None:
            out.close()
            if count:
                ranges.append((f"{path}/{name}", begun, at - begun, count))
        yield pa.RecordBatch.from_pandas(pd.DataFrame(ranges, columns=["path", "offset", "length", "records"]).astype({"path": str, "offset": "int64", "length": "int64", "records": "int64"}), preserve_index=False)

    manifest = f"{path}/_manifest"
    records.mapInArrow(write, MANIFEST).write.parquet(manifest)
    return spark.read.schema(MANIFEST).parquet(manifest)


def read_dictionary(head: bytes, where: str = "") -> zstandard.ZstdCompressionDict | None:
    """The dictionary in a leading skippable frame (itself compressed or plain); None without one."""
    if len(head) < 8 or struct.unpack("<I", head[:4])[0] != DICT_MAGIC:
        return None
    n = struct.unpack("<I", head[4:8])[0]
    body = head[8 : 8 + n]
    if len(body) != n:
        raise ValueError(f"{where}: the dictionary frame is cut short")
    if body[:4] == struct.pack("<I", ZSTD_MAGIC):
        body = zstandard.ZstdDecompressor().decompress(body)
    return zstandard.ZstdCompressionDict(body)


def frames(read, length: int, dictionary, where: str) -> Iterator[bytes]:
    """Decoded frames, one at a time; read(n) gives the next bytes of the range."""
    ctx = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
    left, rest, at = length, b"", 0
    while left or rest:
        obj, parts = ctx.decompressobj(), []
        used = 0
        while not obj.eof:
            if not rest:
                if not left:
                    raise ValueError(f"{where}: the frame at {at} is cut short")
                rest = read(min(left, 1 << 18))
                if not rest:
                    raise ValueError(f"{where}: the range ends early")
                left -= len(rest)
            parts.append(obj.decompress(rest))
            used += len(rest) - len(obj.unused_data)
            rest = obj.unused_data
        at += used
        yield b"".join(parts)


def read_archives(manifest: DataFrame, keep_payload: bool = True) -> DataFrame:
    """Records of the ranges in a manifest, checked; a task holds one frame at a time."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                fs, path = filesystem(row["path"])
                with fs.open_input_file(path) as f:
                    head = f.read(8)
                    if len(head) == 8 and struct.unpack("<I", head[:4])[0] == DICT_MAGIC:
                        head += f.read(struct.unpack("<I", head[4:])[0])
                    dictionary = read_dictionary(head, path)
                    start = row["offset"] if row["offset"] is not None else (len(head) if dictionary else 0)
                    length = row["length"] if row["length"] is not None else f.size() - start
                    f.seek(start)
                    got, size, seen = [], 0, 0
                    for raw in frames(f.read, length, dictionary, path):
                        rec = parse_record(raw, f"{path}, record {seen}")
                        seen += 1
                        if not keep_payload:
                            rec["payload"] = None
                        got.append(rec)
                        size += len(raw) if keep_payload else 200
                        if size > 4 << 20:
                            yield to_batch(got)
                            got, size = [], 0
                    if row["records"] is not None and seen != row["records"]:
                        raise ValueError(f"{path}: {seen} records at {start}, {row['records']} in the manifest")
                    if got:
                        yield to_batch(got)

    return manifest.mapInArrow(read, RECORD)


ARROW = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()), ("page_id", pa.int64()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])


def to_batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=ARROW)


def read_warc(spark: SparkSession, path: str, keep_payload: bool = True) -> DataFrame:
    """All records of the .warc.zst files in a folder, a task a file."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(path).select(
        "path", F.lit(None).cast("long").alias("offset"), F.lit(None).cast("long").alias("length"), F.lit(None).cast("long").alias("records")
    )
    return read_archives(found, keep_payload)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record per page, written and read back."""
    pages = with_revisits(table(spark, sf_dir, "pages"), "page_id", "url", "html")
    manifest = write_archives(pages, scratch(spark, "warc"))
    n = max(1, min(manifest.count(), 4 * spark.sparkContext.defaultParallelism))
    return read_archives(manifest.repartition(n), keep_payload=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


#: The same rows in SQL: base 32 from the hexadecimal SHA-1, five bits a character.
SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages
), d AS (
  SELECT page_id, payload_bytes, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST((CAST('0x' || substr(h, CAST((i // 8) * 10 + 1 AS INT), 10) AS BIGINT) >> CAST(35 - 5 * (i % 8) AS INT)) & 31 AS INT) + 1, 1)), '') AS payload_digest
  FROM p
), g AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS first FROM d
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS NOT DISTINCT FROM first THEN NULL ELSE first END AS refers_to
FROM g
"""
