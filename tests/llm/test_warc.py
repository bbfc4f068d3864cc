import base64
import hashlib
import io
import struct

import pytest
from pyspark.sql import functions as F

from paceline.llm import warc
from paceline.llm.common import new_folder


def archive(records, samples=()):
    out = io.BytesIO()
    warc.write_archive(out, iter(records), list(samples))
    return out.getvalue()


def test_round_trip_and_layout():
    records = [warc.record(k, f"http://x/{k}", f"<p>{k} {'hello ' * k}</p>".encode(), "response", None) for k in range(40)]
    data = archive(records, [r for r in records])
    magic, size = struct.unpack("<II", data[:8])
    assert magic == warc.DICTIONARY_FRAME
    assert list(warc.read_archive(io.BytesIO(data))) == records
    assert data[8 + size : 12 + size] == struct.pack("<I", warc.ZSTD_FRAME)
    bare = data[8 + size :]
    with pytest.raises(Exception):  # noqa: B017  frames can't be read without the dictionary
        list(warc.read_archive(io.BytesIO(bare)))


def test_damage_is_found():
    good = warc.record(1, "u", b"body", "response", None)
    assert warc.parsed(good)["payload"] == b"body"
    for bad in (good[:-1], good.replace(b"body", b"bodx"), good.replace(b"WARC/1.1", b"WARC/9.9"), good.replace(b"Content-Length: 4", b"Content-Length: 3"), good.replace(b"WARC-Date", b"WARC-Fate"), b""):
        with pytest.raises(ValueError):
            warc.parsed(bad)
    data = archive([good, good])
    with pytest.raises(ValueError):
        list(warc.read_archive(io.BytesIO(data[:-5])))
    assert list(warc.read_archive(io.BytesIO(b""))) == []


def test_pages(spark):
    rows = [(1, "a", "same", 1), (2, None, "same", 2), (3, "c\r\nX: y", None, 3), (4, "d", "", 4), (5, "é", "ü" * 100_000, 5), (2, "b", "same", 6), (None, "n", "same", 7)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload int")
    archives = warc.write(warc.with_revisits(pages), new_folder(spark, "warc"))
    got = {(r.page_id, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in warc.read(archives).collect()}
    sha = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    first = {"same": 1, None: 3, "": 3, "ü" * 100_000: 5}
    want = {(i, "response" if i == first[h] else "revisit", None if i == first[h] else first[h], len((h or "").encode()), sha(h)) for i, _, h, _ in rows}
    assert got == want
    assert warc.read(archives).count() == len(rows)
    none = warc.write(warc.with_revisits(pages.limit(0)), new_folder(spark, "warc"))
    assert warc.read(none).count() == 0


def test_smallest_size(spark):
    pages = spark.createDataFrame([(1, "a", "x"), (2, "a", "x")], "page_id long, url string, html string")
    assert [r.record_type for r in warc.with_revisits(pages, smallest=5).collect()] == ["response", "response"]


def test_a_very_common_payload_is_dealt_over_tasks(spark):
    rows = [(i, "u", "same" if i % 3 else f"own {i}") for i in range(2400)] + [(None, "u", "same")]
    got = warc.with_revisits(spark.createDataFrame(rows, "page_id long, url string, html string")).select("page_id", "record_type", "refers_to", F.spark_partition_id().alias("task")).collect()
    assert len(got) == len(rows)
    for r in got:
        common = r.page_id is None or r.page_id % 3
        assert (r.record_type, r.refers_to) == (("revisit", 1) if common and r.page_id != 1 else ("response", None))
    assert len({r.task for r in got if r.record_type == "revisit"}) > 1
