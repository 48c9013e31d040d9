"""Archives: exact round trip, records fetched by their places, revisits, and odd rows."""

from __future__ import annotations

import glob
import hashlib
from collections import Counter

import pytest
import zstandard
from pyspark.sql import functions as F

from creditspark.llm import warc

SCHEMA = "page_id long, url string, html string, record string, digest string, id long"


def _rows():
    same, short = "s" * 100, "t" * 99
    rows = [(5, "http://a/5", same), (3, "http://a/3", same), (9, None, same), (3, "http://a/again", same), (None, "http://a/n", same),
            (10, "http://a/10", short), (11, "http://a/11", short), (12, "http://a/12", None), (13, "http://a/13", ""),
            (14, "http://bad\r\nWARC-Type: forged\r\n\r\n x", "é" * 50), (15, "", "é" * 50), (None, None, None),
            (16, "http://a/16", "\r\n\r\nWARC/1.1\r\nContent-Length: 9\r\n\r\n"), (17, "http://a/17", "\x00" * 150),
            (18, "http://a/18", "long " * 300_000)]
    rows += [(100 + n, f"http://b/{n}", f"page {n} " * (n % 60 + 20)) for n in range(200)]
    rows += [(400 + n, f"http://c/{n}", "many copies " * 20) for n in range(90)]
    return [(*r, "x", "y", 1) for r in rows]


def _expected():
    body = [(r[0], (r[2] or "").encode()) for r in _rows()]
    first = {}
    for i, b in body:
        if len(b) >= 100:
            first[b] = min(first.get(b, (True, 0)), (i is None, i or 0))
    out, taken = [], set()
    for i, b in sorted(body, key=lambda x: (x[0] is None, x[0] or 0)):
        revisit = b in taken
        if len(b) >= 100:
            taken.add(b)
        out.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if revisit else "response",
                    first[b][1] if revisit else None))
    return Counter(out)


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def folder(pages, tmp_path_factory):
    path = f"{tmp_path_factory.mktemp('warc')}/all"
    warc.write_archive(pages, path, frame=4096, bundle=3_000)
    return path


def test_round_trip(spark, folder):
    assert Counter(tuple(r) for r in warc.digests(warc.read_archive(spark, folder)).collect()) == _expected()


def test_revisits_name_their_response(spark, folder):
    found = {r["record_id"]: r for r in warc.read_archive(spark, folder).collect()}
    assert len(found) == len(_rows())
    revisits = [r for r in found.values() if r["type"] == "revisit"]
    assert revisits and all(r["payload"] == b"" for r in revisits)
    for r in revisits:
        named = found[r["headers"]["WARC-Refers-To"]]
        assert named["type"] == "response"
        assert named["headers"]["WARC-Payload-Digest"] == r["headers"]["WARC-Payload-Digest"]
    assert "%0D%0AWARC-Type:%20forged" in next(
        r["headers"]["WARC-Target-URI"] for r in found.values() if r["headers"].get("Source-ID") == "14")


def test_bundles_are_plain_zstandard(folder):
    files = [f for f in glob.glob(f"{folder}/part-*")]
    assert len(files) > 3
    whole, most = 0, 0
    for name in files:
        content = open(name, "rb").read()
        unpacked = zstandard.ZstdDecompressor().stream_reader(content, read_across_frames=True).read()
        table = warc.seek_table(content)
        assert unpacked == b"".join(warc.unpack_frame(content, p) for p in table if p[2])
        most = max(most, len(table))
        whole += unpacked.count(b"WARC-Record-ID: ")
    assert whole == len(_rows()) and most > 2


def test_records_by_place(spark, folder):
    index = warc.read_index(spark, folder)
    assert index.count() == index.select("record_id").distinct().count() == len(_rows())
    every = {r["record_id"]: tuple(r) for r in warc.read_archive(spark, folder).collect()}
    wanted = index.filter(F.crc32("record_id") % 7 == 0)
    ids = {r["record_id"] for r in wanted.collect()}
    assert 3 < len(ids) < 100
    assert {r["record_id"]: tuple(r) for r in warc.read_records(spark, folder, wanted).collect()} == {i: every[i] for i in ids}


def test_damage_is_noticed(folder):
    content = bytearray(open(glob.glob(f"{folder}/part-*")[0], "rb").read())
    place = warc.seek_table(bytes(content))[0]
    with pytest.raises(ValueError):
        warc.unpack_frame(bytes(content), (*place[:3], place[3] ^ 1))
    content[-1] ^= 1
    with pytest.raises(ValueError):
        warc.seek_table(bytes(content))


def test_no_pages(spark, pages, tmp_path):
    warc.write_archive(pages.limit(0), f"{tmp_path}/none")
    assert warc.read_archive(spark, f"{tmp_path}/none").count() == 0
    assert warc.read_index(spark, f"{tmp_path}/none").count() == 0


def test_other_names_of_columns(spark, pages, tmp_path):
    named = pages.select(F.col("page_id").alias("k"), F.col("url").alias("at"), F.col("html").alias("text")).filter("k < 20")
    warc.write_archive(named, f"{tmp_path}/named", key="k", url="at", body="text", minimum=1 << 40)
    found = warc.digests(warc.read_archive(spark, f"{tmp_path}/named"), "k").collect()
    assert len(found) == named.count() and {r["record_type"] for r in found} == {"response"}
