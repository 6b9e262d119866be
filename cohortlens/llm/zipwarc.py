"""WARC records in ZIP archives: writer, and a reader of byte ranges without extraction."""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote, urlparse

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A member of an archive is closed after so many bytes or records.
MEMBER_BYTES = 4 << 20
MEMBER_RECORDS = 1000
MIN_REVISIT = 1000

# Fixed values of the ZIP format: signatures, sizes and the marks for 64-bit fields.
LOCAL, CENTRAL, END, END64, LOCATOR = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07"
LOCAL_FORM, CENTRAL_FORM, END_FORM = "<4s5H3I2H", "<4s6H3I5H2I", "<4s4H2IH"
END64_FORM, LOCATOR_FORM = "<4sQ2H2I4Q", "<4sIQI"
FULL16, FULL32, EXTRA64, STORED = 0xFFFF, 0xFFFFFFFF, 1, 0
DOS_DATE = 33

SAFE_URL = "!#$&'()*+,/:;=?@[]~-._"


@dataclass
class Member:
    name: str
    offset: int
    size: int
    crc: int
    method: int = STORED


def _local_header(member: Member) -> bytes:
    name = member.name.encode()
    sizes = (member.crc, member.size, member.size)
    return struct.pack(LOCAL_FORM, LOCAL, 45, 0x800, STORED, 0, DOS_DATE, *sizes, len(name), 0) + name


def _central_entry(member: Member) -> bytes:
    """Directory entry with its sizes and offset in a 64-bit extra field."""
    name = member.name.encode()
    extra = struct.pack("<2H3Q", EXTRA64, 24, member.size, member.size, member.offset)
    return (
        struct.pack(
            CENTRAL_FORM, CENTRAL, 45, 45, 0x800, STORED, 0, DOS_DATE, member.crc, FULL32, FULL32,
            len(name), len(extra), 0, 0, 0, 0, FULL32,
        )
        + name
        + extra
    )


def _directory(members: list[Member], at: int, comment: int) -> bytes:
    entries = b"".join(map(_central_entry, members))
    count = len(members)
    end64 = struct.pack(END64_FORM, END64, 44, 45, 45, 0, 0, count, count, len(entries), at)
    locator = struct.pack(LOCATOR_FORM, LOCATOR, 0, at + len(entries), 1)
    end = struct.pack(END_FORM, END, 0, 0, FULL16, FULL16, FULL32, FULL32, comment)
    return entries + end64 + locator + end


def base32_digest(payload: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _page_urn(page_id: int | None) -> str:
    return f"<urn:x-page:{'none' if page_id is None else page_id}>"


def _page_of(urn: str) -> int | None:
    name = urn.strip("<>").rpartition(":")[2]
    return None if name == "none" else int(name)


def warc_record(page_id: int | None, url: str | None, payload: bytes, refers: int | None, revisit: bool) -> bytes:
    """One response, or a revisit that has the response's HTTP head alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    block = http.encode() + (b"" if revisit else payload)
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_page_urn(page_id)}"]
    head.append("WARC-Date: 2020-01-01T00:00:00Z")
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=SAFE_URL)}")
    if revisit:
        head.append(f"WARC-Refers-To: {_page_urn(refers)}")
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    head.append(f"WARC-Payload-Digest: {base32_digest(payload)}")
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class ArchiveWriter:
    """Builds an archive piece by piece; every piece ends where a line feed belongs.

    Pieces are written as lines of a text file, by the job's own committer. So a piece is a
    data member with its index member, whose last line feed is left out, and the last piece is
    the directory, whose archive comment is one line feed.
    """

    def __init__(self):
        self.members: list[Member] = []
        self.at = 0
        self.data = bytearray()
        self.index: list[str] = []

    def add(self, record: bytes, page_id: int | None) -> bytes | None:
        packed = gzip.compress(record, 1, mtime=0)
        self.index.append(json.dumps({"page": page_id, "offset": len(self.data), "length": len(packed)}))
        self.data += packed
        return self._close() if len(self.data) >= MEMBER_BYTES or len(self.index) >= MEMBER_RECORDS else None

    def _close(self) -> bytes:
        number = len(self.members) // 2
        names = f"archive/data-{number:06d}.warc.gz", f"indexes/data-{number:06d}.cdxj"
        piece = b""
        for name, body in zip(names, (bytes(self.data), "".join(f"{line}\n" for line in self.index).encode())):
            member = Member(name, self.at + len(piece), len(body), zlib.crc32(body))
            self.members.append(member)
            piece += _local_header(member) + body
        self.at += len(piece)
        self.data, self.index = bytearray(), []
        return piece[:-1]

    def finish(self) -> Iterator[bytes]:
        if self.index:
            yield self._close()
        yield _directory(self.members, self.at, comment=1)


def _archive_pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    writer = ArchiveWriter()
    some = False
    for batch in batches:
        for page, url, payload, refers, revisit in batch.itertuples(index=False, name=None):
            some = True
            page, refers = (None if pd.isna(v) else int(v) for v in (page, refers))
            if piece := writer.add(warc_record(page, url, bytes(payload), refers, bool(revisit)), page):
                yield pd.DataFrame({"piece": [piece]})
    if some:
        yield pd.DataFrame({"piece": list(writer.finish())})


def with_revisits(pages: DataFrame, min_bytes: int = MIN_REVISIT) -> DataFrame:
    """(page_id, url, payload, refers_to, revisit) of every page.

    Of pages with equal payloads of ``min_bytes`` or more that of the largest id is the
    response, the others revisit it. Payloads are compared by length and SHA-256. A null page
    is empty; a null id is below all others, and rows that tie on the largest id are all
    responses.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long"), "url", payload.alias("payload"))
    own = rows.select("page_id", F.when(F.octet_length("payload") >= min_bytes, F.sha2("payload", 256)).alias("sha"))
    own = own.filter(F.col("sha").isNotNull())
    most = own.groupBy("sha").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    again = own.join(most, "sha").filter(F.col("page_id").isNull() | (F.col("page_id") < F.col("refers_to")))
    again = again.filter(F.col("refers_to").isNotNull()).select(F.struct("page_id", "sha").alias("_of"), "refers_to").distinct()
    sha = F.when(F.octet_length("payload") >= min_bytes, F.sha2("payload", 256))
    marked = rows.withColumn("_row", F.struct("page_id", sha.alias("sha")))
    joined = marked.join(again, marked["_row"].eqNullSafe(again["_of"]), "left")
    return joined.select("page_id", "url", "payload", "refers_to", F.col("refers_to").isNotNull().alias("revisit"))


def write_archives(records: DataFrame, path: str) -> None:
    """One archive per partition below ``path``, in any file system that Spark writes to.

    ``records`` are as ``with_revisits`` gives them. Records come in order of page id; a task
    holds one member at a time, and a task that is run again replaces what it wrote.
    """
    ordered = records.select("page_id", "url", "payload", "refers_to", "revisit").sortWithinPartitions("page_id")
    pieces = ordered.mapInPandas(_archive_pieces, "piece binary")
    pieces.select(F.col("piece").cast("string").alias("value")).write.option("lineSep", "\n").text(path)


def open_range(path: str):
    """A file of a local path or of any store that pyarrow knows, for reading at offsets."""
    parts = urlparse(path)
    if parts.scheme in ("", "file"):
        return open(unquote(parts.path), "rb")
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(path)
    return store.open_input_file(name)


def _read(file, at: int, size: int) -> bytes:
    file.seek(at)
    data = file.read(size)
    if len(data) != size:
        raise ValueError("the archive ends too early")
    return data


def _entries(directory: bytes, count: int, shift: int) -> Iterator[Member]:
    at, fixed = 0, struct.calcsize(CENTRAL_FORM)
    for _ in range(count):
        values = struct.unpack_from(CENTRAL_FORM, directory, at)
        if values[0] != CENTRAL:
            raise ValueError("broken archive directory")
        method, crc, packed, size, n_name, n_extra, n_comment, offset = (values[k] for k in (4, 7, 8, 9, 10, 11, 12, 16))
        name = directory[at + fixed : at + fixed + n_name].decode()
        extra = directory[at + fixed + n_name : at + fixed + n_name + n_extra]
        while len(extra) >= 4:
            kind, length = struct.unpack_from("<2H", extra)
            if kind == EXTRA64:
                wide = iter(struct.unpack(f"<{length // 8}Q", extra[4 : 4 + length // 8 * 8]))
                size = next(wide) if size == FULL32 else size
                packed = next(wide) if packed == FULL32 else packed
                offset = next(wide) if offset == FULL32 else offset
            extra = extra[4 + length :]
        yield Member(name, offset + shift, packed, crc, method)
        at += fixed + n_name + n_extra + n_comment


def read_directory(file, length: int) -> list[Member]:
    """The members of an archive, from its central directory in either size of fields.

    Only the end of the file and the directory are read. Offsets count from the archive's own
    start, which may be behind other bytes.
    """
    fixed = struct.calcsize(END_FORM)
    tail_at = max(0, length - fixed - FULL16)
    tail = _read(file, tail_at, length - tail_at)
    found = tail.rfind(END)
    while found >= 0:
        if found + fixed <= len(tail):
            end = struct.unpack_from(END_FORM, tail, found)
            if found + fixed + end[7] == len(tail):
                break
        found = tail.rfind(END, 0, found)
    if found < 0:
        raise ValueError("no archive directory")
    end_at = tail_at + found
    count, size, offset = end[4], end[5], end[6]
    locator_at = end_at - struct.calcsize(LOCATOR_FORM)
    if locator_at >= 0 and (FULL16 in (count,) or FULL32 in (size, offset)):
        mark, _, end64_at, _ = struct.unpack(LOCATOR_FORM, _read(file, locator_at, end_at - locator_at))
        if mark == LOCATOR:
            wide = struct.calcsize(END64_FORM)
            # Bytes before the archive move its end but not the offset written in the locator.
            for at in (end64_at, locator_at - wide):
                values = struct.unpack(END64_FORM, _read(file, at, wide))
                if values[0] == END64:
                    count, size, offset = values[7], values[8], values[9]
                    end_at = at
                    break
            else:
                raise ValueError("broken 64-bit directory end")
    start = end_at - size
    return list(_entries(_read(file, start, size), count, start - offset))


def stored_range(file, member: Member) -> tuple[int, int]:
    """Where a stored member's bytes are: behind its local header, whose lengths are its own."""
    if member.method != STORED:
        raise ValueError(f"{member.name} is not stored")
    head = struct.unpack(LOCAL_FORM, _read(file, member.offset, struct.calcsize(LOCAL_FORM)))
    if head[0] != LOCAL:
        raise ValueError(f"no member at {member.offset}")
    return member.offset + struct.calcsize(LOCAL_FORM) + head[9] + head[10], member.size


def locate_records(path: str, length: int, open_file: Callable = open_range) -> Iterator[tuple[str, int, list, list]]:
    """(path, start of the data, record offsets, record lengths) of every indexed data member."""
    if not length:
        return
    with open_file(path) as file:
        members = {m.name: m for m in read_directory(file, length)}
        for name, member in sorted(members.items()):
            if not name.startswith("indexes/"):
                continue
            start, size = stored_range(file, member)
            index = _read(file, start, size)
            if zlib.crc32(index) != member.crc:
                raise ValueError(f"{name} is damaged")
            lines = [json.loads(line) for line in index.splitlines()]
            data = members["archive/" + name.removeprefix("indexes/").replace(".cdxj", ".warc.gz")]
            yield path, stored_range(file, data)[0], [x["offset"] for x in lines], [x["length"] for x in lines]


RECORD = (
    "page_id bigint, url string, record_type string, refers_to bigint, payload binary, "
    "payload_bytes bigint, payload_sha1 string"
)


def _headers(block: bytes) -> dict[str, str]:
    return dict(line.split(": ", 1) for line in block.decode().split("\r\n")[1:] if ": " in line)


def parse_record(packed: bytes) -> tuple:
    """A RECORD row; a revisit has no payload, its length and digest are those of its head."""
    head, _, rest = gzip.decompress(packed).partition(b"\r\n\r\n")
    named = _headers(head)
    block = rest[: int(named["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    sha1 = base64.b32decode(named["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    size = int(_headers(http)["Content-Length"])
    revisit = named["WARC-Type"] == "revisit"
    if not revisit and (len(payload) != size or hashlib.sha1(payload).hexdigest() != sha1):
        raise ValueError(f"payload of {named['WARC-Record-ID']} is damaged")
    url = unquote(named["WARC-Target-URI"]) if "WARC-Target-URI" in named else None
    refers = _page_of(named["WARC-Refers-To"]) if revisit else None
    page = _page_of(named["WARC-Record-ID"])
    return page, url, named["WARC-Type"], refers, None if revisit else payload, size, sha1


def read_archives(spark: SparkSession, path: str, open_file: Callable = open_range) -> DataFrame:
    """Every record of the archives below ``path``, by RECORD.

    Spark lists the files; one task per archive reads its directory and indexes; the located
    members are dealt out anew and their records read as byte ranges. Nothing is extracted.
    """
    listed = spark.read.format("binaryFile").load(path).select("path", "length")

    def locate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["path", "start", "offsets", "lengths"]
        for batch in batches:
            for name, length in batch.itertuples(index=False, name=None):
                for row in locate_records(name, length, open_file):
                    yield pd.DataFrame([row], columns=names)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.split()[0] for f in RECORD.split(", ")]
        for batch in batches:
            for name, start, offsets, lengths in batch.itertuples(index=False, name=None):
                with open_file(name) as file:
                    for first in range(0, len(offsets), 200):
                        spans = zip(offsets[first : first + 200], lengths[first : first + 200])
                        rows = [parse_record(_read(file, start + int(o), int(n))) for o, n in spans]
                        yield pd.DataFrame(rows, columns=names, dtype=object)

    members = listed.repartition("path").mapInPandas(
        locate, "path string, start long, offsets array<long>, lengths array<long>"
    )
    # A member is a short row that stands for megabytes to read: a given number of partitions is
    # not merged by their size.
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return members.repartition(tasks, "path", "start").mapInPandas(read, RECORD)
