"""ZIP directories with and without ZIP64, range reads, and revisits."""

import base64
import gzip
import hashlib
import io
import zipfile

import pytest

from factorloom.llm import warc
from factorloom.llm.common import QUERIES
from factorloom.session import new_path

PAGES = "page_id long, url string, html string, k string"


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def read(frame_rows):
    return {(r["record_id"], r["record_type"], r["refers_to"], r["payload_bytes"], r["payload_digest"], r["intact"]) for r in frame_rows}


@pytest.mark.parametrize("limit", [1 << 31, 40])
def test_zip_directories(monkeypatch, limit):
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", limit)
    monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 2 if limit == 40 else 65535)
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        for i in range(5):
            z.writestr(f"archive/{i}.warc", bytes([65 + i]) * (30 + i))
        z.writestr("packed", "x" * 500, zipfile.ZIP_DEFLATED)
        z.comment = b"PK\5\6 in a comment"
    size = raw.getbuffer().nbytes
    assert (b"PK\6\6" in raw.getvalue()) == (limit == 40)
    found = {m["name"]: m for m in warc.members(raw, size)}
    for i in range(5):
        m = found[f"archive/{i}.warc"]
        raw.seek(warc.data_offset(raw, m))
        assert raw.read(m["bytes"]) == bytes([65 + i]) * (30 + i)
    with pytest.raises(ValueError, match="compressed"):
        warc.data_offset(raw, found["packed"])
    with pytest.raises(ValueError, match="no end"):
        warc.members(io.BytesIO(b"nothing here at all, no archive"), 31)


def test_full_size_places_are_taken_from_zip64_fields():
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z, z.open("a", "w", force_zip64=True) as f:
        f.write(b"abc")
    (m,) = warc.members(raw, raw.getbuffer().nbytes)
    raw.seek(warc.data_offset(raw, m))
    assert raw.read(m["bytes"]) == b"abc"


def test_records_and_revisits(spark, frame):
    rows = [(1, "http://a b\n", "x", ""), (2, None, "x", None), (3, "u", None, None), (None, "u", "", None), (5, "u", "x", None), (5, "u", "x", None), (7, "u", "é" * 100_000, None)]
    pages = frame(rows, PAGES)
    for size in (10, 1 << 20):
        manifest = warc.write_archives(pages, "page_id", "url", "html", new_path(spark, "wacz"), archive_bytes=size)
        got = read(warc.read_records(warc.locate(manifest)).collect())
        page = "urn:page:{}".format
        assert got == {
            (page(1), "revisit", page(5), 1, digest("x"), True), (page(2), "revisit", page(5), 1, digest("x"), True), (page(5), "response", None, 1, digest("x"), True),
            (page(3), "response", None, 0, digest(""), True), (page(""), "revisit", page(3), 0, digest(""), True), (page(7), "response", None, 200_000, digest("é" * 100_000), True),
        }
    only = warc.write_archives(pages, "page_id", "url", "html", new_path(spark, "wacz"), min_payload=1)
    assert {r[1] for r in read(warc.read_records(warc.locate(only)).collect()) if r[3] == 0} == {"response"}
    empty = warc.write_archives(pages.where("false"), "page_id", "url", "html", new_path(spark, "wacz"))
    assert warc.read_records(warc.locate(empty)).collect() == []


def test_archives_without_an_index(spark, frame, tmp_path):
    parts = [gzip.compress(warc.make_record(f"urn:page:{i}", "u", b"p" * i, warc.payload_digest(b"p" * i), None)) for i in range(4)]
    with zipfile.ZipFile(tmp_path / "a.wacz", "w") as z:
        z.writestr("archive/only.warc.gz", b"".join(parts))
    got = warc.read_records(warc.locate(frame([(str(tmp_path / "a.wacz"),)], "path string"))).collect()
    assert sorted(r["payload_bytes"] for r in got) == [0, 1, 2, 3] and all(r["intact"] for r in got)


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    last = {digest(h): max(p for p, x in pages.items() if (x or "") == (h or "")) for h in pages.values()}
    for r in QUERIES["op3_warc_zip"](spark, folder).collect():
        html = pages.pop(r["page_id"])
        owner = last[digest(html)]
        assert (r["payload_bytes"], r["payload_digest"]) == (len((html or "").encode()), digest(html))
        assert (r["record_type"], r["refers_to"]) == (("response", None) if owner == r["page_id"] else ("revisit", owner))
    assert not pages
