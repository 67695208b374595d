import base64
import gzip
import hashlib
import random
import zlib
from urllib.parse import urlparse

import pytest
from pyspark.sql import functions as F

from fundflow.llm import warc

PAGES = "page_id long, url string, html string"


def plain(pages, least=0):
    rank = lambda i: (i is None, i or 0)
    out = []
    for i, _, html in pages:
        data = (html or "").encode()
        first = min((j for j, _, other in pages if (other or "") == (html or "")), key=rank)
        again = len(data) >= least and rank(i) > rank(first)
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", first if again else None))
    return sorted(out, key=repr)


def back(archives):
    rows = warc.page_records(archives).collect()
    assert all(r.intact is (True if r.record_type == "response" else None) for r in rows)
    return sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows], key=repr)


@pytest.fixture(scope="module")
def pages():
    rng = random.Random(41)
    bodies = ["<p>hi</p>", None, "", "é中😀" * 50, "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n", "x" * 300_000, "\x00\x01\r\n\r\n"]
    rows = [(i, f"http://h/{i}", rng.choice(bodies) if i % 2 else f"<html>{rng.random()}") for i in range(80)]
    return rows + [(-5, "http://h/a b\r\nEvil: 1/é", bodies[0]), (None, None, bodies[0]), (3, "http://h/3", "<p>of one id</p>"), (None, None, "only null")]


def local(address):
    return urlparse(address).path


@pytest.mark.parametrize("least", [0, 8, 100])
def test_pages_come_back(spark, pages, least):
    df = spark.createDataFrame(pages, PAGES).repartition(3)
    assert back(warc.archived(df, least)) == plain(pages, least)


def test_a_shuffle_join_and_small_archives(spark, pages, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST_ROWS", -1)
    monkeypatch.setattr(warc, "CELL_ROWS", 2)
    whole, _ = warc.write_archives(spark.createDataFrame(pages, PAGES).repartition(2), archive_bytes=2_000)
    archives, _ = warc.normalise(whole)
    assert whole.count() > 3 and back(archives) == plain(pages)


def test_the_normaliser_keeps_every_byte(spark, pages):
    """One stream becomes a member a record; each member inflates alone to what
    stood in the stream; the index has the place of each."""
    whole, _ = warc.write_archives(spark.createDataFrame(pages, PAGES).coalesce(1))
    [one] = whole.collect()
    before = gzip.decompress(open(local(one.archive), "rb").read())
    box = zlib.decompressobj(31)
    box.decompress(open(local(one.archive), "rb").read())
    assert box.eof and not box.unused_data  # a single member
    archives, _ = warc.normalise(whole)
    [two] = archives.collect()
    data, places = open(local(two.archive), "rb").read(), warc.entries(archives).collect()
    assert b"".join(gzip.decompress(data[e.offset : e.offset + e.length]) for e in places) == before
    assert sum(e.length for e in places) == len(data) == two.n_bytes and len(places) == two.n_records == len(pages) + 1
    again, _ = warc.normalise(archives)  # members instead of one stream
    assert open(local(again.collect()[0].archive), "rb").read() == data


def test_members_are_read_by_offset(spark, pages):
    archives = warc.archived(spark.createDataFrame(pages, PAGES).repartition(2))
    some = warc.entries(archives).where(warc.page_of(F.col("record_id")).isin(5, -5, 10))
    got = {warc_id: r for r in warc.records(some, payloads=True).collect() for warc_id in [r.record_id.split(":")[2]]}
    html = {str(i): h for i, _, h in pages}
    assert set(got) == {"5", "-5", "10"} and bytes(got["10"].payload).decode() == html["10"] and got["-5"].target_uri == "http://h/a%20b%0D%0AEvil:%201/%C3%A9"
    assert all(r.payload is None for r in got.values() if r.record_type == "revisit")


def test_broken_archives_fail(spark, tmp_path):
    good = gzip.compress(warc.page_record(1, "http://h", b"abc", "D", None))
    for i, bad in enumerate([good[:-9], gzip.compress(b"GET / HTTP/1.1\r\n\r\n"), gzip.compress(warc.page_record(1, None, b"abc", "D", None)[:-6])]):
        path = tmp_path / f"{i}.warc.gz"
        path.write_bytes(bad)
        with pytest.raises(Exception, match="ends before|not a record|two line ends"):
            warc.normalise(spark.createDataFrame([(f"file://{path}",)], "archive string"))


def test_chunks_of_any_size():
    text = b"".join(warc.page_record(i, None, bytes(range(256)) * i, "D", None) for i in range(6))
    for n in (1, 7, 4096):
        packed = gzip.compress(text[:900]) + gzip.compress(text[900:])
        chunks = (packed[i : i + n] for i in range(0, len(packed), n))
        assert [sum(map(len, data.take(length))) - length for _, _, data, length in warc.parsed(warc.inflated(chunks))] == [0] * 6


def test_no_pages_and_clashing_columns(spark):
    assert warc.page_records(warc.archived(spark.createDataFrame([], PAGES))).count() == 0
    df = spark.createDataFrame([(1, "u", "x", "s", 2), (2, "u", "x", "s", 2)], f"{PAGES}, sha1 string, cell int")
    assert [r[3:] for r in back(warc.archived(df))] == [("response", None), ("revisit", 1)]
