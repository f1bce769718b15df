"""WARC records inside ZIP-packaged archives: written by tasks, read back by range without extraction.

An archive is a ZIP file with stored (uncompressed) members: `archive/data.warc.gz`, one gzip member per record, and
`indexes/index.cdxj`, one line per record with its offset and length. The reader parses the end-of-directory record
(ZIP64 too), the central directory and the local headers, reads the index, and then fetches single records
by range; whole members are never unpacked. Archives without an index are walked record by record.

Files live in the shared folder and go through pyarrow's file systems, which open local and
remote stores by their address. Every attempt of a task writes files of its own name and reports them in its output
rows; those are written as a table first, so only files of committed attempts are ever read.

Payloads are compared by digest in one grouped aggregate that sums map-side; the table of payloads
that occur twice is broadcast only when it is measured to be small.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize, new_path
from .common import query, sized, store, table

ARCHIVE_BYTES = 32 << 20
#: Bytes of an archive whose records one task reads together.
RANGE_BYTES = 8 << 20
DATE = "2000-01-01T00:00:00Z"
WARC_MEMBER, INDEX_MEMBER = "archive/data.warc.gz", "indexes/index.cdxj"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


# --- records -----------------------------------------------------------------------------------


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def make_record(record_id: str, uri: str, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """One record: a response with its payload, or a revisit with the headers of its response only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{record_id}>", f"WARC-Target-URI: {uri}", f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{refers_to}>"]
    return ("\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def _headers(raw: bytes) -> tuple[str, dict]:
    first, *rest = raw.decode("utf-8", "replace").split("\r\n")
    return first, {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in rest)}


def parse_record(raw: bytes) -> dict:
    """Headers and payload of one record; a revisit has the length its response had, and no payload."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, h = _headers(head)
    if not version.startswith("WARC/"):
        raise ValueError(f"not a WARC record: {version[:40]!r}")
    block = rest[: int(h["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    revisit = h["warc-type"] == "revisit"
    said = h.get("warc-payload-digest", "").removeprefix("sha1:")
    return {
        "record_type": h["warc-type"], "record_id": h["warc-record-id"].strip("<>"), "uri": h.get("warc-target-uri"),
        "refers_to": h["warc-refers-to"].strip("<>") if revisit else None, "payload": None if revisit else payload,
        "payload_bytes": int(_headers(http)[1].get("content-length", 0)) if revisit else len(payload),
        "payload_digest": said if revisit else payload_digest(payload), "intact": revisit or said == payload_digest(payload),
    }


# --- ZIP directories ---------------------------------------------------------------------------

# Signatures of the ZIP format.
END, END64, LOCATOR64, CENTRAL, LOCAL = b"PK\5\6", b"PK\6\6", b"PK\6\7", b"PK\1\2", b"PK\3\4"
FULL16, FULL32 = 0xFFFF, 0xFFFFFFFF


def _directory_place(f, size: int) -> tuple[int, int, int]:
    """Entries, bytes and offset of the central directory."""
    start = max(0, size - 22 - FULL16 - 20)
    f.seek(start)
    last = f.read(size - start)
    at = last.rfind(END)
    while at >= 0 and at + 22 + int.from_bytes(last[at + 20 : at + 22], "little") != len(last):
        at = last.rfind(END, 0, at)
    if at < 0:
        raise ValueError("no end of central directory")
    entries, length, offset = struct.unpack("<HII", last[at + 10 : at + 20])
    if at >= 20 and last[at - 20 : at - 16] == LOCATOR64 and (entries == FULL16 or length == FULL32 or offset == FULL32):
        f.seek(struct.unpack("<Q", last[at - 12 : at - 4])[0])
        end = f.read(56)
        if end[:4] != END64:
            raise ValueError("no ZIP64 end of central directory")
        entries, length, offset = struct.unpack("<QQQ", end[32:56])
    return entries, length, offset


def members(f, size: int) -> list[dict]:
    """name, method, stored bytes and header offset of each member, from the central directory."""
    entries, length, offset = _directory_place(f, size)
    f.seek(offset)
    raw, at, out = f.read(length), 0, []
    for _ in range(entries):
        if raw[at : at + 4] != CENTRAL:
            raise ValueError("broken central directory")
        method, = struct.unpack("<H", raw[at + 10 : at + 12])
        packed, plain, n, extra, comment = struct.unpack("<IIHHH", raw[at + 20 : at + 34])
        header, = struct.unpack("<I", raw[at + 42 : at + 46])
        name = raw[at + 46 : at + 46 + n].decode("utf-8")
        fields, e = raw[at + 46 + n : at + 46 + n + extra], 0
        while e + 4 <= len(fields):
            kind, width = struct.unpack("<HH", fields[e : e + 4])
            if kind == 1:  # ZIP64: only the values that did not fit, in this order
                values = iter(struct.unpack(f"<{width // 8}Q", fields[e + 4 : e + 4 + width // 8 * 8]))
                plain = next(values) if plain == FULL32 else plain
                packed = next(values) if packed == FULL32 else packed
                header = next(values) if header == FULL32 else header
            e += 4 + width
        out.append({"name": name, "method": method, "bytes": packed, "header": header})
        at += 46 + n + extra + comment
    return out


def data_offset(f, member: dict) -> int:
    """Where the bytes of a stored member begin."""
    if member["method"]:
        raise ValueError(f"{member['name']} is compressed; only stored members can be read by range")
    f.seek(member["header"])
    raw = f.read(30)
    if raw[:4] != LOCAL:
        raise ValueError("broken local header")
    n, extra = struct.unpack("<HH", raw[26:30])
    return member["header"] + 30 + n + extra


def walk(f, start: int, length: int) -> Iterator[tuple[int, int]]:
    """Offset and length of each gzip member in a range; for archives without an index."""
    at, end = start, start + length
    while at < end:
        f.seek(at)
        d, used = zlib.decompressobj(31), 0
        while not d.eof:
            chunk = f.read(min(1 << 20, end - at - used))
            if not chunk:
                raise ValueError("record is cut off")
            d.decompress(chunk)
            used += len(chunk)
        used -= len(d.unused_data)
        yield at, used
        at += used


# --- jobs --------------------------------------------------------------------------------------


def _archive(records: list[tuple[str, bytes, str]]) -> bytes:
    """ZIP bytes of (uri, gzipped record, type)."""
    lines, at = [], 0
    for uri, raw, kind in records:
        lines.append(f"{uri} {re.sub('[^0-9]', '', DATE)} " + json.dumps({"type": kind, "offset": str(at), "length": str(len(raw)), "filename": "data.warc.gz"}))
        at += len(raw)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for name, body in ((WARC_MEMBER, b"".join(x[1] for x in records)), (INDEX_MEMBER, ("\n".join(sorted(lines)) + "\n").encode()), ("datapackage.json", b'{"profile": "data-package", "wacz_version": "1.1.1"}')):
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), body)
    return out.getvalue()


def write_archives(pages: DataFrame, key: str, uri: str, body: str, folder: str, min_payload: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write one record per row; returns the manifest (path, bytes, records) of committed files.

    The payload is the body in UTF-8, null counts as empty. Of rows with equal payloads of at least `min_payload` bytes the one with the
    largest key is the response and the others revisit it; repeated rows of that key are responses all. A null key
    is smaller than any other; where a group has null keys only, all are responses. Other columns are not written.
    """
    payload = F.encode(F.coalesce(F.col(body), F.lit("")), "UTF-8")
    rows = pages.select(F.col(key).cast("string").alias("k"), F.col(key).alias("order"), F.col(uri).cast("string").alias("uri"), payload.alias("payload")).withColumn("d", F.sha1("payload"))
    again = rows.where(F.octet_length("payload") >= min_payload).groupBy("d").agg(F.max_by("k", "order").alias("owner"), F.count(F.lit(1)).alias("n")).where("n > 1 AND owner IS NOT NULL")
    again = materialize(again.select("d", "owner"), "payload-owners")
    todo = rows.join(sized(again, 120), "d", "left").select("k", "uri", "payload", F.when(~F.col("owner").eqNullSafe(F.col("k")), F.col("owner")).alias("owner"))

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = store(folder)
        fs.create_dir(base, recursive=True)

        def flush(records):
            raw, name = _archive(records), f"{uuid.uuid4().hex}.wacz"
            with fs.open_output_stream(f"{base}/{name}") as f:
                f.write(raw)
            return pd.DataFrame({"path": [f"{folder}/{name}"], "bytes": [len(raw)], "records": [len(records)]})

        held, size = [], 0
        for batch in batches:
            for k, u, p, owner in zip(batch["k"], batch["uri"], batch["payload"], batch["owner"]):
                u = quote(u, safe=":/?#[]@!$&'()*+,;=%~") if u else "urn:unknown"
                refers = None if pd.isna(owner) else f"urn:page:{owner}"
                raw = gzip.compress(make_record(f"urn:page:{'' if pd.isna(k) else k}", u, p, payload_digest(p), refers), 6, mtime=0)
                held.append((u, raw, "response" if refers is None else "revisit"))
                size += len(raw)
                if size >= archive_bytes:
                    yield flush(held)
                    held, size = [], 0
        if held:
            yield flush(held)

    return materialize(todo.mapInPandas(write, "path string, bytes long, records long"), "archives")


def locate(manifest: DataFrame) -> DataFrame:
    """(path, offset, length) of every record, from the archives' indexes; manifest has the column path."""

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                fs, p = store(path)
                with fs.open_input_file(p) as f:
                    found = {m["name"]: m for m in members(f, f.size())}
                    for name, m in found.items():
                        if name.startswith("archive/"):
                            start, index = data_offset(f, m), found.get(INDEX_MEMBER)
                            if index is None:
                                places = list(walk(f, start, m["bytes"]))
                            else:
                                f.seek(data_offset(f, index))
                                lines = [json.loads(x[x.index("{") :]) for x in f.read(index["bytes"]).decode().splitlines() if x]
                                places = sorted((start + int(x["offset"]), int(x["length"])) for x in lines if x["filename"] == name.removeprefix("archive/"))
                            yield pd.DataFrame({"path": path, "offset": [x[0] for x in places], "length": [x[1] for x in places]})

    return manifest.select("path").mapInPandas(find, "path string, offset long, length long")


RECORD = "record_id string, uri string, record_type string, refers_to string, payload_bytes long, payload_digest string, intact boolean, payload binary"


def read_records(places: DataFrame) -> DataFrame:
    """The records at (path, offset, length); tasks take ranges of about RANGE_BYTES of an archive each."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        path, f = None, None
        for batch in batches:
            held, size = [], 0
            for p, offset, length in zip(batch["path"], batch["offset"], batch["length"]):
                if p != path:
                    if f is not None:
                        f.close()
                    fs, local = store(p)
                    path, f = p, fs.open_input_file(local)
                f.seek(offset)
                held.append(parse_record(gzip.decompress(f.read(length))))
                size += held[-1]["payload_bytes"]
                if size >= RANGE_BYTES:
                    yield pd.DataFrame(held)[[x.split()[0] for x in RECORD.split(", ")]]
                    held, size = [], 0
            if held:
                yield pd.DataFrame(held)[[x.split()[0] for x in RECORD.split(", ")]]
        if f is not None:
            f.close()

    spread = places.withColumn("_part", F.floor(F.col("offset") / RANGE_BYTES)).repartition("path", "_part").sortWithinPartitions("path", "offset")
    return spread.drop("_part").mapInPandas(read, RECORD)


@query("op3_warc_zip")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select("page_id", "url", "html")
    manifest = write_archives(pages, "page_id", "url", "html", new_path(spark, "wacz"))
    found = read_records(locate(manifest))
    number = lambda c: F.regexp_extract(c, "^urn:page:(-?[0-9]+)$", 1).try_cast("long")
    return found.select(number(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", number(F.col("refers_to")).alias("refers_to"), "intact")
