"""Archives written and read back, and archives of other writers."""

import hashlib
import io
import zipfile

import pytest

from cohortlens.llm import zipwarc

PAGE = "page_id long, url string, html string"


def round_trip(spark, rows, path, extra=""):
    pages = spark.createDataFrame(rows, PAGE + extra)
    zipwarc.write_archives(zipwarc.with_revisits(pages).repartition(3, "page_id"), str(path))
    return zipwarc.read_archives(spark, str(path)).collect()


def test_round_trip(spark, tmp_path):
    big = "ü" * 600
    rows = [(k, f"http://h.example/{k}?q=a b%20é\n", f"<p>{k}</p>\r\n\r\n") for k in range(50)]
    rows += [(100, None, big), (105, "u", big), (103, "u", big), (None, "u", big), (200, "u", None), (201, "u", ""), (202, "u", "x" * 999)]
    rows += [(203, "u", "x" * 999), (204, "u", "z" * 200_000)]
    got = {r.page_id: r for r in round_trip(spark, [(*r, "e") for r in rows], tmp_path / "a", ", payload string")}
    assert set(got) == {r[0] for r in rows}
    for page, url, html in rows:
        data = (html or "").encode()
        assert got[page].payload_bytes == len(data)
        assert got[page].payload_sha1 == hashlib.sha1(data).hexdigest()
        assert got[page].url == url
        revisit = page in (100, 103, None)
        assert got[page].record_type == ("revisit" if revisit else "response")
        assert got[page].refers_to == (105 if revisit else None)
        assert got[page].payload == (None if revisit else data)


def test_repeated_rows_and_empty_table(spark, tmp_path):
    big = "y" * 1500
    got = round_trip(spark, [(1, "u", big), (1, "u", big), (0, "u", big), (0, "u", big)], tmp_path / "a")
    assert sorted((r.page_id, r.record_type) for r in got) == [(0, "revisit")] * 2 + [(1, "response")] * 2
    assert round_trip(spark, [], tmp_path / "b") == []


def test_members_close_by_size(monkeypatch):
    monkeypatch.setattr(zipwarc, "MEMBER_RECORDS", 10)
    writer = zipwarc.ArchiveWriter()
    pieces = [writer.add(zipwarc.warc_record(k, "u", b"%d" % k, None, False), k) for k in range(35)]
    data = b"".join(p + b"\n" for p in [*filter(None, pieces), *writer.finish()])
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        assert archive.testzip() is None and len(archive.namelist()) == 8
        assert all(m.compress_type == zipfile.ZIP_STORED for m in archive.infolist())


@pytest.mark.parametrize("lead", [b"", b"bytes before the archive"])
def test_directories_of_other_writers(lead):
    buffer = io.BytesIO()
    buffer.write(lead)
    with zipfile.ZipFile(buffer, "a") as archive:
        archive.comment = b"a comment PK\x05\x06 with a mark"
        archive.writestr("one", b"first")
        with archive.open("two", "w", force_zip64=True) as member:
            member.write(b"second")
        archive.writestr("packed", b"third" * 50, zipfile.ZIP_DEFLATED)
    data = buffer.getvalue()
    file = io.BytesIO(data)
    members = {m.name: m for m in zipwarc.read_directory(file, len(data))}
    for name, body in (("one", b"first"), ("two", b"second")):
        start, size = zipwarc.stored_range(file, members[name])
        assert data[start : start + size] == body
    with pytest.raises(ValueError):
        zipwarc.stored_range(file, members["packed"])
    with pytest.raises(ValueError):
        zipwarc.read_directory(io.BytesIO(b"no archive at all"), 17)


def test_only_ranges_are_read(tmp_path):
    writer = zipwarc.ArchiveWriter()
    pieces = [writer.add(zipwarc.warc_record(k, "u", bytes(range(256)) * 400, None, False), k) for k in range(40)]
    path = tmp_path / "a.zip"
    path.write_bytes(b"".join(p + b"\n" for p in [*filter(None, pieces), *writer.finish()]))
    reads = []

    class Counted(io.FileIO):
        def read(self, size=-1):
            reads.append(size)
            return super().read(size)

    located = list(zipwarc.locate_records(str(path), path.stat().st_size, Counted))
    assert sum(len(x[2]) for x in located) == 40
    assert min(reads) >= 0 and sum(reads) <= 70_000 + 100 * 40


def test_damage_is_noticed():
    record = zipwarc.gzip.compress(zipwarc.warc_record(1, "u", b"payload", None, False).replace(b"payload", b"paylord"))
    with pytest.raises(ValueError):
        zipwarc.parse_record(record)
