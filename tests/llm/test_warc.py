"""Archives written and read back: exact payloads, revisits, bounded chunks, hard rows."""

from __future__ import annotations

import gzip
import hashlib
from pathlib import Path

import pytest

from modelyard.llm import warc
from modelyard.llm.warc import ArchiveSettings

LONG = "é<p>\r\n\r\nWARC/1.1\r\n" * 30_000
ROWS = [
    (1, "http://a/1", LONG), (2, "http://a/2", "short"), (3, None, "short"), (4, "u", None), (5, "u", ""), (6, "u", LONG),
    (7, "line\r\nbreak: x", "y" * 99), (8, "u", "y" * 99), (9, "u", "z" * 100), (10, "u", "z" * 100), (10, "u", "z" * 100),
    (11, "u", "twice" * 50), (11, "u", "twice" * 50), (12, "u", "same id"), (12, "u", "other text"), (None, "u", "z" * 100),
    (None, "u", "only nobody" * 20), (None, "u", "only nobody" * 20), (-5, "u", "\r\n\r\n" * 100),
]


def expected():
    first = {}
    for page, _, html in ROWS:
        if page is not None and len((html or "").encode()) >= 100:
            first[html] = min(page, first.get(html, page))
    found = []
    for page, _, html in ROWS:
        data = (html or "").encode()
        other = first.get(html) if html in first and first[html] != page else None
        found.append((page, len(data), hashlib.sha256(data).hexdigest(), "response" if other is None else "revisit", other))
    return sorted(found, key=repr)


@pytest.fixture(scope="module")
def pages(spark):
    table = spark.createDataFrame(ROWS, "page_id long, url string, html string")
    return table.selectExpr("*", "1 as chunk", "'x' as digest", "2 as n_bytes", "'y' as data").repartition(3)


@pytest.mark.parametrize("settings", [ArchiveSettings(), ArchiveSettings(chunk=1000, roll=2000), ArchiveSettings(chunk=7 << 10)])
def test_round_trip(spark, pages, tmp_path, settings):
    archives = warc.written(pages, str(tmp_path / "a"), settings)
    chunks = warc.read(archives, settings=settings, payload=True)
    assert sorted(map(tuple, warc.digests(chunks).collect()), key=repr) == expected()
    rows = chunks.collect()
    assert all(len(r["data"]) <= settings.chunk for r in rows)
    whole = {}
    for r in sorted(rows, key=lambda r: r["chunk"]):
        if r["record_type"] == "response" and r["page_id"] in (1, -5):
            whole[r["page_id"]] = whole.get(r["page_id"], b"") + r["data"]
            assert r["digest"] == hashlib.sha256(whole[r["page_id"]]).hexdigest() and r["n_bytes"] == len(whole[r["page_id"]])
    assert whole == {1: LONG.encode(), -5: b"\r\n\r\n" * 100}
    listed = archives.collect()
    assert sum(r["records"] for r in listed) == len(ROWS)
    # Any reader of gzip members sees one record after the other.
    text = b"".join(gzip.decompress(Path(r["path"]).read_bytes()) for r in listed)
    assert text.count(b"WARC-Record-ID: ") == len(ROWS) and b"line  break: x" in text


def test_damage_is_found(spark, pages, tmp_path):
    archives = warc.written(pages, f"file://{tmp_path}/b")
    for path in (tmp_path / "b").glob("*.warc.gz"):
        text = gzip.decompress(path.read_bytes())
        path.write_bytes(gzip.compress(text.replace(b"twice", b"tweak")))
    with pytest.raises(Exception, match="damaged record"):
        warc.digests(warc.read(archives)).collect()


def test_string_ids(spark, tmp_path):
    table = spark.createDataFrame([("a> b\r\n", None, "t" * 200), ("none", "u", "t" * 200), ("é", "u", "x")], "page_id string, url string, html string")
    found = warc.digests(warc.read(warc.written(table, str(tmp_path / "c")), id_type="string")).collect()
    assert {(r["page_id"], r["record_type"], r["refers_to"]) for r in found} == {
        ("a> b\r\n", "response", None), ("none", "revisit", "a> b\r\n"), ("é", "response", None),
    }


@pytest.mark.parametrize("page", [1, None])
def test_repeated_long_response(spark, tmp_path, page):
    settings = ArchiveSettings(chunk=1000)
    urls = ["http://a/1", "http://a/2", "http://a/2"]
    table = spark.createDataFrame([(page, url, LONG) for url in urls], "page_id long, url string, html string")
    chunks = warc.read(warc.written(table.repartition(2), str(tmp_path / "e"), settings), settings=settings, payload=True)
    data = LONG.encode()
    assert [tuple(r) for r in warc.digests(chunks).collect()] == [(page, len(data), hashlib.sha256(data).hexdigest(), "response", None)] * 3
    assert sorted(r["url"] for r in chunks.filter("last").collect()) == urls
    assert sum(len(r["data"]) for r in chunks.collect()) == 3 * len(data)


def test_empty(spark, tmp_path):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    archives = warc.written(none, str(tmp_path / "d"))
    assert archives.count() == 0 and warc.digests(warc.read(archives)).count() == 0
