"""WARC records in ZIP packages, read in place.

Writing: every task packs its records into archives of bounded size. An archive is a ZIP file
whose members are stored, not deflated: ``archive/data.warc.gz`` (one gzip member per record,
as WARC asks for) and ``indexes/index.cdxj`` (a line per record with its place). Archives have
a name of their own for each attempt, and only those in the written list of archives count, so
a lost executor leaves no half-read file behind.

Reading: the end of the file gives the central directory (ZIP64 too), that gives the members'
places, every index below ``indexes/`` (plain, gzipped or deflated; JSON, with or without a key and a
time before it) gives the records' members and places, and each record is read as a byte range of
its stored member below ``archive/``. Nothing is extracted and no file is read whole. What can't be
read that way is an error, never left out: a deflated archive member, one that no index mentions, an
index line whose member is missing, a package without an index.

Of records with equal payloads the one with the smallest id is a response, the others are
revisits that refer to it. Nulls: a null html is an empty payload, a null url an empty target,
a null id never is smaller than another; rows repeated under the smallest id are responses too.
An empty table gives no archive and an empty result.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, functions as F

from tabwright.session import scratch_path, ship_with_tasks, staged

ship_with_tasks(__name__)

#: Bytes of records a task gathers before it writes them as one archive.
ARCHIVE_BYTES = 16 << 20
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
_BIG = 0xFFFFFFFF
_EOL = b"\r\n"

ARCHIVES = "archive string, bytes long, records long"
RECORDS = (
    "record_id string, url string, record_type string, refers_to string, payload_bytes long,"
    " payload_digest string, archive string, offset long, length long"
)


# --- ZIP --------------------------------------------------------------------------------------


def zip_bytes(members: list[tuple[str, bytes]], zip64: bool = False) -> bytes:
    """A ZIP file of stored members; ZIP64 records where sizes need them, or always."""
    out, central = bytearray(), bytearray()
    for name, data in members:
        raw, at, crc, size = name.encode(), len(out), zlib.crc32(data), len(data)
        big = zip64 or max(size, at) >= _BIG
        extra = struct.pack("<HHQQ", 1, 16, size, size) if big else b""
        short = _BIG if big else size
        out += struct.pack("<4sHHHHHIIIHH", b"PK\3\4", 45 if big else 20, 0x800, 0, 0, 33, crc, short, short, len(raw), len(extra))
        out += raw + extra + data
        extra = struct.pack("<HHQQQ", 1, 24, size, size, at) if big else b""
        central += struct.pack(
            "<4sHHHHHHIIIHHHHHII", b"PK\1\2", 45, 45 if big else 20, 0x800, 0, 0, 33, crc, short, short,
            len(raw), len(extra), 0, 0, 0, 0, _BIG if big else at,
        )
        central += raw + extra
    at, n, size = len(out), len(members), len(central)
    out += central
    big = zip64 or max(at, size) >= _BIG or n >= 0xFFFF
    if big:
        end = len(out)
        out += struct.pack("<4sQHHIIQQQQ", b"PK\6\6", 44, 45, 45, 0, 0, n, n, size, at)
        out += struct.pack("<4sIQI", b"PK\6\7", 0, end, 1)
    out += struct.pack(
        "<4sHHHHIIH", b"PK\5\6", 0, 0, *[0xFFFF if big else n] * 2, *([_BIG] * 2 if big else (size, at)), 0
    )
    return bytes(out)


class Member(NamedTuple):
    at: int
    size: int  # bytes in the file
    deflated: bool


def members(file, size: int) -> dict[str, Member]:
    """Every member of a ZIP file by name, from the central directory and the members' own headers."""
    tail_at = max(0, size - 65_557)
    tail = file.read_at(size - tail_at, tail_at)
    found = tail.rfind(b"PK\5\6")
    if found < 0:
        raise ValueError("not a ZIP file: no end of central directory")
    n, length, at = struct.unpack_from("<HII", tail, found + 10)
    if n == 0xFFFF or length == _BIG or at == _BIG:
        locator = file.read_at(20, tail_at + found - 20)
        if locator[:4] != b"PK\6\7":
            raise ValueError("ZIP64 end of central directory is missing")
        (end,) = struct.unpack_from("<Q", locator, 8)
        n, length, at = struct.unpack_from("<QQQ", file.read_at(56, end), 32)
    central, p, places = file.read_at(length, at), 0, {}
    for _ in range(n):
        how, = struct.unpack_from("<H", central, p + 10)
        packed, plain, name_len, extra_len, note_len = struct.unpack_from("<IIHHH", central, p + 20)
        (offset,) = struct.unpack_from("<I", central, p + 42)
        name = central[p + 46 : p + 46 + name_len].decode()
        extra, q = central[p + 46 + name_len : p + 46 + name_len + extra_len], 0
        while q + 4 <= len(extra):
            kind, width = struct.unpack_from("<HH", extra, q)
            if kind == 1:
                wide = iter(struct.unpack_from(f"<{width // 8}Q", extra, q + 4))
                plain = next(wide) if plain == _BIG else plain
                packed = next(wide) if packed == _BIG else packed
                offset = next(wide) if offset == _BIG else offset
            q += 4 + width
        if how not in (0, 8):
            raise ValueError(f"{name}: packed by method {how}")
        name_here, extra_here = struct.unpack_from("<HH", file.read_at(30, offset), 26)
        places[name] = Member(offset + 30 + name_here + extra_here, packed, how == 8)
        p += 46 + name_len + extra_len + note_len
    return places


def record_places(file, places: dict[str, Member]) -> Iterator[tuple[int, int]]:
    """(offset in the file, length) of every record that the package's indexes list."""
    archives = {n for n in places if n.startswith("archive/") and n != "archive/"}
    indexes = [n for n in places if n.startswith("indexes/") and n.removesuffix(".gz").endswith((".cdx", ".cdxj"))]
    if archives and not indexes:
        raise ValueError("no index among " + ", ".join(sorted(places)))
    seen = set()
    for name in indexes:
        member = places[name]
        raw = file.read_at(member.size, member.at)
        raw = zlib.decompress(raw, -15) if member.deflated else raw
        raw = gzip.decompress(raw) if name.endswith(".gz") else raw
        for line in raw.decode().splitlines():
            if "{" not in line:
                continue
            fields = json.loads(line[line.index("{") :])
            held = f"archive/{fields['filename'].removeprefix('archive/')}" if "filename" in fields else min(archives) if len(archives) == 1 else None
            if held not in archives:
                raise ValueError(f"{name} names a member that isn't there: {line}")
            if places[held].deflated:
                raise ValueError(f"{held} is deflated, so its records can't be read in place")
            seen.add(held)
            yield places[held].at + int(fields["offset"]), int(fields["length"])
    if archives - seen and any(places[n].size for n in archives - seen):
        raise ValueError("in no index: " + ", ".join(sorted(archives - seen)))


# --- WARC -------------------------------------------------------------------------------------


def base32_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(record_id: str, url: str | None, payload: bytes, refers_to: str | None, date: str) -> bytes:
    """A response record, or a revisit without payload when ``refers_to`` is given."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:x-record:{record_id}>",
        f"WARC-Target-URI: {quote(url or '', safe=':/?#[]@!$&()*+,;=~%')}",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{base32_digest(payload)}",
        "Content-Type: application/http; msgtype=response",
    ]
    if refers_to is not None:
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head.append(f"WARC-Refers-To: <urn:x-record:{refers_to}>")
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + _EOL * 2 + block + _EOL * 2


def parse_record(raw: bytes) -> dict:
    """Headers (lower-case names), HTTP headers and payload of one record."""
    head, _, rest = raw.partition(_EOL * 2)
    lines = head.decode().split("\r\n")
    fields = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(_EOL * 2)
    sent = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in http.decode().split("\r\n")[1:])}
    return {"fields": fields, "http": sent, "payload": payload}


# --- Spark ------------------------------------------------------------------------------------


def with_roles(pages: DataFrame, id: str = "page_id", html: str = "html", least: int = 0) -> DataFrame:
    """The pages with ``refers_to``: for a revisit the id of the response with an equal payload.

    Digests are counted before they are joined, and only repeated ones take part; their list is
    a written table, so that the join may split a digest that holds a large part of all rows.
    """
    body = F.coalesce(F.col(html), F.lit(""))
    named = pages.select(F.col(id).alias("id"), "url", body.alias("html"), F.sha1(body.cast("binary")).alias("digest"))
    long_enough = F.octet_length("html") >= least
    repeated = named.filter(long_enough).groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    repeated = staged(repeated.filter("n > 1").select(F.col("digest").alias("of"), "first"), "warc-repeated")
    joined = named.join(repeated, (F.col("digest") == F.col("of")) & long_enough, "left")
    revisit = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("id"))
    return joined.select("id", "url", "html", F.when(revisit, F.col("first")).alias("refers_to"))


def write_archives(
    pages: DataFrame, folder: str, date: str = "2026-01-01T00:00:00Z", archive_bytes: int = ARCHIVE_BYTES
) -> DataFrame:
    """Write rows of (id, url, html, refers_to) as archives below ``folder``; returns the list of archives.

    ``folder`` is a URI every executor can reach. The list is written by Spark's committer beside
    the archives, so it names each record's archive once however often a task was tried.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pyarrow.fs.FileSystem.from_uri(folder)
        data, index, records = bytearray(), [], 0

        def flush():
            name = f"{uuid.uuid4().hex}.wacz"
            body = zip_bytes([(DATA, bytes(data)), (INDEX, "".join(index).encode())])
            with store.open_output_stream(f"{root}/{name}") as out:
                out.write(body)
            return pa.RecordBatch.from_pydict(
                {"archive": [f"{folder}/{name}"], "bytes": [len(body)], "records": [records]}
            )

        store.create_dir(root, recursive=True)
        for batch in batches:
            for row in zip(*(batch.column(c) for c in ("id", "url", "html", "refers_to"))):
                record_id, url, html, first = (x.as_py() for x in row)
                raw = record_bytes(
                    str(record_id), url, (html or "").encode(), None if first is None else str(first), date
                )
                packed = gzip.compress(raw, 1, mtime=0)
                place = {"offset": len(data), "length": len(packed), "filename": DATA.removeprefix("archive/")}
                index.append(f"{json.dumps(place)}\n")
                data += packed
                records += 1
                if len(data) >= archive_bytes:
                    yield flush()
                    data, index, records = bytearray(), [], 0
        if records:
            yield flush()

    return staged(pages.mapInArrow(pack, ARCHIVES), "warc-archives")


def read_archives(archives: DataFrame, payloads: bool = False) -> DataFrame:
    """A row per record of the archives, each read as a byte range; ``payloads`` adds the payload itself.

    The digest and size of a response are taken from the bytes read, those of a revisit from its headers.
    There is a task for each archive.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("archive").to_pylist():
                store, where = pyarrow.fs.FileSystem.from_uri(path)
                size = store.get_file_info(where).size
                with store.open_input_file(where) as file:
                    rows = []
                    for at, length in record_places(file, members(file, size)):
                        raw = file.read_at(length, at)
                        raw = gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw
                        rows.append(_row(parse_record(raw), path, at, length, payloads))
                        if len(rows) == 2000:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows = []
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)

    fields = [(n, pa.int64() if t == "long" else pa.string()) for n, t in (x.split() for x in RECORDS.split(","))]
    schema = pa.schema(fields + ([("payload", pa.binary())] if payloads else []))
    return archives.repartition(max(1, archives.count())).mapInArrow(read, RECORDS + (", payload binary" if payloads else ""))


def _row(record: dict, path: str, offset: int, length: int, payloads: bool) -> dict:
    fields, payload = record["fields"], record["payload"]
    kind = fields["warc-type"]
    name = lambda key: fields[key].removeprefix("<urn:x-record:").removesuffix(">") if key in fields else None
    row = {
        "record_id": name("warc-record-id"),
        "url": unquote(fields["warc-target-uri"]),
        "record_type": kind,
        "refers_to": name("warc-refers-to"),
        "payload_bytes": len(payload) if kind == "response" else int(record["http"]["content-length"]),
        "payload_digest": base32_digest(payload) if kind == "response" else fields["warc-payload-digest"][5:],
        "archive": path,
        "offset": offset,
        "length": length,
    }
    return row | ({"payload": payload} if payloads else {})


def archive_round_trip(pages: DataFrame, id: str = "page_id", html: str = "html", least: int = 0) -> DataFrame:
    """Write all pages as archives in the shared folder and read the records back."""
    folder = scratch_path(pages.sparkSession, "warc")
    if folder.startswith("file:/") and not folder.startswith("file://"):
        folder = "file://" + folder.removeprefix("file:")
    return read_archives(write_archives(with_roles(pages, id, html, least), folder))
