"""Zstandard-compressed WARC archives: a writer, and a reader that checks what it reads.

An archive is one file. Its first frame is a skippable frame with the file's dictionary; after it each
record is one Zstandard frame compressed with that dictionary, so a reader can start at any frame.
Pages are dealt over archives by hash, each archive is written by one task to the shared folder under a
temporary name and renamed when whole, so a task that is repeated leaves one good file. The reader
decodes one frame at a time and never holds more than one record and a block of the file.

Which records revisit another is found by Spark before anything is written: the smallest page_id of each
payload digest (combined before the shuffle), joined back to the pages.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paceline.llm.common import bounded_batches, new_folder, partitions, read_table, spread_join, stored

# Fixed values of the format: the skippable frame that holds a dictionary, and the frame and dictionary magic numbers.
DICTIONARY_FRAME = 0x184D2A5D
ZSTD_FRAME = 0xFD2FB528
#: Payloads of an archive that its dictionary is trained on, and their bytes at most; a dictionary's size.
SAMPLES, SAMPLE_BYTES, DICTIONARY_BYTES = 64, 8192, 16384
#: All records carry this date: an archive of the same pages is the same file.
DATE = "2024-01-01T00:00:00Z"
BLOCK = 1 << 18
TYPES = ("response", "revisit")

ROW = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def page_of(urn: str | None) -> int | None:
    if urn is None:
        return None
    if not (urn.startswith("<urn:page:") and urn.endswith(">")):
        raise ValueError(f"unknown record id {urn!r}")
    number = urn[len("<urn:page:") : -1]
    return None if number == "none" else int(number)


def record(page_id: int | None, url: str | None, payload: bytes, kind: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record. A revisit has no payload of its own; its headers give the full payload's digest and length."""
    uri = (url or "").encode("unicode_escape").decode().replace("\r", "").replace("\n", "")
    body = payload if kind == "response" else b""
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        f"X-Payload-Length: {len(payload)}",
        *([f"WARC-Refers-To: {record_id(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"] if kind == "revisit" else []),
        "Content-Type: text/html",
        f"Content-Length: {len(body)}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parsed(data: bytes) -> dict:
    """Check one record's version, headers, length and digest; returns its fields. Raises ValueError where it is damaged."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    if not gap:
        raise ValueError("record without an end of headers")
    version, *lines = head.decode("utf-8").split("\r\n")
    if version != "WARC/1.1":
        raise ValueError(f"unknown version {version[:20]!r}")
    fields: dict[str, str] = {}
    for line in lines:
        name, colon, value = line.partition(":")
        if not colon or not name or name.lower() in fields:
            raise ValueError(f"bad header line {line[:60]!r}")
        fields[name.lower()] = value.strip()
    missing = {"warc-type", "warc-record-id", "warc-date", "warc-payload-digest", "content-length", "x-payload-length"} - fields.keys()
    if missing:
        raise ValueError(f"headers are missing: {sorted(missing)}")
    if fields["warc-type"] not in TYPES:
        raise ValueError(f"unknown type {fields['warc-type']!r}")
    length = int(fields["content-length"])
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise ValueError(f"record of {len(rest) - 4} bytes says {length}")
    body, sha = rest[:length], fields["warc-payload-digest"].removeprefix("sha1:")
    full = int(fields["x-payload-length"])
    if fields["warc-type"] == "response":
        if full != length or digest(body) != sha:
            raise ValueError("payload doesn't match its digest or length")
    elif length or "warc-refers-to" not in fields:
        raise ValueError("a revisit has no body and refers to a response")
    return {
        "page_id": page_of(fields["warc-record-id"]),
        "url": fields.get("warc-target-uri"),
        "record_type": fields["warc-type"],
        "refers_to": page_of(fields.get("warc-refers-to")),
        "payload_digest": sha,
        "payload_bytes": full,
        "payload": body if fields["warc-type"] == "response" else None,
    }


def dictionary(samples: list[bytes]) -> bytes:
    """A dictionary trained on the samples; where they are too few or too small to train on, the samples' bytes themselves."""
    samples = [s[:SAMPLE_BYTES] for s in samples if s]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[-DICTIONARY_BYTES:]


def as_dictionary(data: bytes) -> zstandard.ZstdCompressionDict:
    return zstandard.ZstdCompressionDict(data)


def write_archive(out: io.BufferedIOBase, records: Iterator[bytes], samples: list[bytes], level: int = 3) -> int:
    """Write the dictionary's frame and one frame a record; returns the number of records."""
    data = dictionary(samples)
    packed = zstandard.ZstdCompressor(level=level).compress(data) if data else b""
    out.write(struct.pack("<II", DICTIONARY_FRAME, len(packed)) + packed)
    squeeze = zstandard.ZstdCompressor(level=level, dict_data=as_dictionary(data), write_checksum=True) if data else zstandard.ZstdCompressor(level=level, write_checksum=True)
    n = 0
    for x in records:
        out.write(squeeze.compress(x))
        n += 1
    return n


def read_archive(source: io.BufferedIOBase) -> Iterator[bytes]:
    """The records of an archive, one frame decoded at a time. An archive may lack the dictionary's frame."""
    block = source.read(8)
    if not block:
        return
    unzip = zstandard.ZstdDecompressor()
    if len(block) == 8 and struct.unpack("<I", block[:4])[0] == DICTIONARY_FRAME:
        (size,) = struct.unpack("<I", block[4:])
        packed = source.read(size)
        if len(packed) != size:
            raise ValueError("the dictionary's frame is cut short")
        if size:
            raw = zstandard.ZstdDecompressor().decompress(packed, max_output_size=1 << 26) if packed[:4] == struct.pack("<I", ZSTD_FRAME) else packed
            unzip = zstandard.ZstdDecompressor(dict_data=as_dictionary(raw))
        block = b""
    while True:
        if not block and not (block := source.read(BLOCK)):
            return
        frame, parts = unzip.decompressobj(), []
        while not frame.eof:
            if not block and not (block := source.read(BLOCK)):
                raise ValueError("an archive ends within a frame")
            parts.append(frame.decompress(block))
            block = frame.unused_data if frame.eof else b""
        yield b"".join(parts)


def with_revisits(pages: DataFrame, smallest: int = 0, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """``page_id, url, payload, record_type, refers_to``: of equal payloads of at least ``smallest`` bytes the one with the
    smallest id is the response and the others revisit it; payloads below that are all responses.

    A null html is an empty payload. Rows whose id is null refer to the smallest id that isn't; where a payload has only
    null ids, or the same id in several rows, those rows are all responses. The rows of a very common payload are dealt
    over many tasks, and so over many archives.
    """
    payload = F.coalesce(F.encode(F.col(html_col), "UTF-8"), F.lit(b""))
    base = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload")).withColumn("key", F.sha1("payload"))
    counts = stored(base.groupBy("key").agg(F.min("page_id").alias("first"), F.min(F.octet_length("payload")).alias("size"), F.count("*").alias("n")).where("n > 1"), "payloads")
    first = counts.where((F.col("size") >= smallest) & F.col("first").isNotNull()).select("key", "first")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return spread_join(base, first, "key", counts, pages.count(), "page_id", "left").select("page_id", "url", "payload", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("first")).alias("refers_to"))


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri) if ":/" in uri else (pafs.LocalFileSystem(), uri)


def write(records: DataFrame, folder: str, level: int = 3) -> DataFrame:
    """Write one archive per partition of ``records`` into ``folder`` (any file system that pyarrow knows by URI); returns ``path, records``.

    The result is written down once, so each archive is made once; a partition without rows makes none.
    """
    bounded_batches(records.sparkSession, 256)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        rows = (r for b in batches for r in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True))
        ahead = list(islice(rows, SAMPLES))
        if not ahead:
            return
        every = (r for part in (ahead, rows) for r in part)
        fs, at = file_system(folder)
        fs.create_dir(at)
        name = f"{at}/part-{TaskContext.get().partitionId():06d}.warc.zst"
        draft = f"{name}.{uuid.uuid4().hex}"
        with fs.open_output_stream(draft, compression=None, buffer_size=1 << 20) as out:
            n = write_archive(out, (record(*r) for r in every), [r[2] for r in ahead], level)
        fs.move(draft, name)
        yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name.rpartition('/')[2]}"]), pa.array([n], pa.int64())], ["path", "records"])

    return stored(records.select("page_id", "url", "payload", "record_type", "refers_to").mapInArrow(run, "path string, records long"), "archives")


def read(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of the archives named in column ``path``, checked; ``payloads`` adds the column payload (null for revisits).

    A damaged archive fails the job with its name. If ``archives`` has a column ``records``, the number read must equal it.
    """
    counted = "records" in archives.columns
    schema = ROW + (", payload binary" if payloads else "")
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    arrow = pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in schema.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, told in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fs, at = file_system(path)
                met, held, size = 0, [], 0
                try:
                    with fs.open_input_stream(at, compression=None, buffer_size=BLOCK) as source:
                        for data in read_archive(source):
                            row = parsed(data)
                            held.append({k: row[k] for k in names})
                            met += 1
                            size += len(data) if payloads else 200
                            if size > 4_000_000:
                                yield pa.RecordBatch.from_pylist(held, arrow)
                                held, size = [], 0
                except (ValueError, zstandard.ZstdError) as why:
                    raise ValueError(f"{path}, record {met}: {why}") from why
                if told is not None and told != met:
                    raise ValueError(f"{path} has {met} records, {told} were written")
                if held:
                    yield pa.RecordBatch.from_pylist(held, arrow)

    spark = archives.sparkSession
    listed = archives.select("path", (F.col("records") if counted else F.lit(None)).cast("long").alias("records"))
    return listed.repartition(partitions(spark, 2), "path").mapInArrow(run, schema)


def op6_warc_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages")
    archives = write(with_revisits(pages), new_folder(spark, "warc"))
    return read(archives, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


# SQL's digests are hexadecimal and DuckDB has no base32, so the digits are turned over in groups of five bits.
ORACLE = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
     d AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS h, min(page_id) OVER (PARTITION BY sha1(payload)) AS f FROM p),
     b AS (SELECT *, list_reduce(list_transform(range(40), lambda i: format('{:04b}', instr('0123456789abcdef', substr(h, i + 1, 1)) - 1)), lambda x, y: x || y) AS bits FROM d)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
       list_reduce(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(list_sum(list_transform(range(5), lambda j: CAST(substr(bits, k * 5 + j + 1, 1) AS INTEGER) * CAST(pow(2, 4 - j) AS INTEGER))) AS INTEGER) + 1, 1)), lambda x, y: x || y) AS payload_digest,
       CASE WHEN page_id = f THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> f THEN f END AS refers_to
FROM b
"""
