"""WARC files against a plain sequential reader, with records planted inside payloads."""

import hashlib
import os
import random
from collections import defaultdict

import pytest

from sigframe.llm import warc
from sigframe.session import shared_path
from tests.llm.conftest import SMALL, clashing

SCHEMA = "page_id long, url string, html string"


def plain_read(path):
    """Every record of the files below `path`, one after the other."""
    out = []
    for name in sorted(os.listdir(path)):
        if not name.startswith("part"):
            continue
        raw, at = open(f"{path}/{name}", "rb").read(), 0
        while at < len(raw):
            cut = raw.index(b"\r\n\r\n", at)
            first, *lines = raw[at:cut].decode().split("\r\n")
            assert first == "WARC/1.1"
            head = dict(x.split(": ", 1) for x in lines)
            n = int(head["Content-Length"])
            body = raw[cut + 4 : cut + 4 + n]
            assert raw[cut + 4 + n : cut + 8 + n] == b"\r\n\r\n"
            out.append((head, body, at))
            at = cut + 8 + n
    return out


def plain(rows):
    body = lambda h: (h or "").encode()
    first = defaultdict(list)
    for i, _, h in rows:
        first[body(h)].append(i)
    out = []
    for i, _, h in rows:
        b = body(h)
        ids = [x for x in first[b] if x is not None]
        f = min(ids) if ids and len(b) >= 100 else None
        again = f is not None and i != f
        out.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", f if again else None))
    return out


def check(spark, df, where=None):
    path = where or shared_path(spark, "warc-test")
    warc.write_archive(df, path)
    key = lambda r: tuple((x is None, x or 0) for x in r[:2]) + r[2:4]
    read = warc.read_archive(spark, path)
    got = read.collect()
    want = plain([tuple(r) for r in df.select("page_id", "url", "html").collect()])
    assert sorted((tuple(r)[:5] for r in got), key=key) == sorted(want, key=key)
    assert all(r.whole for r in got)
    records = plain_read(path.removeprefix("file:"))
    assert sorted(r.offset for r in got) == sorted(at for _, _, at in records)
    return path, got, records


def fake(page, body, length=None):
    return f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{page}>\r\nContent-Length: {len(body) if length is None else length}\r\n\r\n{body}\r\n\r\n"


def planted():
    r = random.Random(4)
    word = lambda n: " ".join(r.choices(["alpha", "beta", "<p>", "ö", "日本", "\n"], k=n))
    long = word(60)
    rows = [(i, f"http://a/{i}", word(r.randint(0, 80))) for i in range(40)]
    rows += [(100 + i, f"http://b/{i}", long) for i in range(30)]
    rows += [(200, "http://c", fake(900, "x" * 50) * 3), (201, None, word(30) + "\n" + fake(901, word(3)) + word(20)), (202, "u", "\n" + fake(902, "y", 40))]
    rows += [(203, "u", "\nWARC/1.1\r\nContent-Length: 99999999\r\n\r\n" + word(50)), (204, "u", "\nWARC/1." * 200), (205, "u", "WARC/1.WARC/1.1\r\n\r\n\nWARC/1.0\r\n"), (206, "u", "\r\n\r\n\nWARC/1.1")]
    rows += [(207, "a b\r\nContent-Length: 3\r\n\r\n\nWARC/1.1\r\n", word(40)), (208, "http://ü/%zz", "z" * 99), (209, "http://ü/%20", "z" * 99), (210, "", "z" * 100), (211, "", "z" * 100)]
    rows += [(212, None, None), (213, None, ""), (None, "u", long), (None, "u", "w" * 120), (None, "u", "w" * 120), (100, "http://b/0", long), (-5, "u", "v" * 300), (214, "u", "v" * 300), (215, "u", "q" * 300_000)]
    return rows + [(300 + i, "u", fake(700 + i, word(10)) + "\n" + fake(800 + i, word(10))) for i in range(20)]


@pytest.fixture
def small_blocks(spark):
    """Files in many blocks."""
    names = {"spark.sql.files.maxPartitionBytes": "2k", "spark.sql.files.openCostInBytes": "0"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_given_pages(spark):
    _, got, records = check(spark, spark.read.parquet(f"{SMALL}/pages.parquet"))
    assert len(got) == len(records) == 50


def test_magic_in_payloads_over_many_blocks(spark, small_blocks):
    df = spark.createDataFrame(planted(), SCHEMA).coalesce(2)
    path, got, records = check(spark, clashing(df, "file", "payload_digest", "first", "head"))
    assert not {r.page_id for r in got} & set(range(700, 1000))
    assert sum(h["WARC-Type"] == "revisit" and not b for h, b, _ in records) == sum(r.record_type == "revisit" for r in got) > 20
    for h, b, _ in records:
        if h["WARC-Type"] == "response":
            assert h["WARC-Payload-Digest"] == "sha256:" + hashlib.sha256(b).hexdigest()
    url = {h["WARC-Record-ID"]: h.get("WARC-Target-URI") for h, _, _ in records}
    assert url["<urn:page:212>"] is None and url["<urn:page:207>"] == "a%20b%0D%0AContent-Length:%203%0D%0A%0D%0A%0AWARC/1.1%0D%0A"
    assert url["<urn:page:208>"] == "http://ü/%25zz" and url["<urn:page:209>"] == "http://ü/%20"
    exits = warc._placed(warc._parsed(warc._pieces(spark, path))).filter("next is not null")
    assert exits.count() > len(records) + 40 and exits.select("file", "block").distinct().count() > 20


def test_one_block_gives_the_same(spark):
    check(spark, spark.createDataFrame(planted(), SCHEMA).repartition(3))


def test_reads_other_writers_and_cut_files(spark):
    path = shared_path(spark, "warc-cut").removeprefix("file:")
    os.makedirs(path)
    body = "ab\nWARC/1.0\r\nContent-Length: 1\r\n\r\nq\r\n\r\n" + "c" * 40
    one = "WARC/1.0\r\ncontent-length:  4 \r\nwarc-record-id: <urn:page:1>\r\nwarc-type: response\r\n\r\nabcd\r\n\r\n"
    two = fake(2, body)
    with open(f"{path}/part-0.warc", "wb") as f:
        f.write((one + two + fake(3, "d" * 50)).encode()[:-30])
    with open(f"{path}/part-1.warc", "wb") as f:
        f.write((fake(4, "e\nWARC/1.1\r\n" * 9, 999) + one).encode())
    got = {r.page_id: r for r in warc.read_archive(spark, path).collect()}
    assert set(got) == {1, 2, 3, 4}
    assert [got[i].whole for i in (1, 2, 3, 4)] == [True, True, False, False]
    assert got[1].payload_digest == hashlib.sha256(b"abcd").hexdigest() and got[2].payload_digest == hashlib.sha256(body.encode()).hexdigest()
    assert got[3].payload_bytes == 24 and got[3].payload_digest == hashlib.sha256(b"d" * 24).hexdigest()


def test_no_pages(spark):
    path = shared_path(spark, "warc-none")
    warc.write_archive(spark.createDataFrame([], SCHEMA), path)
    assert warc.read_archive(spark, path).collect() == []


def test_wrong_digest_is_seen(spark):
    path = shared_path(spark, "warc-bad")
    warc.write_archive(spark.createDataFrame([(1, "u", "a" * 200), (2, "u", "b" * 200)], SCHEMA).coalesce(1), path)
    there, other = path.removeprefix("file:"), shared_path(spark, "warc-bad").removeprefix("file:")
    os.makedirs(other)
    for name in os.listdir(there):
        if name.startswith("part"):
            with open(f"{other}/{name}", "wb") as f:
                f.write(open(f"{there}/{name}", "rb").read().replace(b"bbbb", b"bbbc"))
    assert {r.page_id: r.whole for r in warc.read_archive(spark, other).collect()} == {1: True, 2: False}
