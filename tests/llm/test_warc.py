"""Archives: round trips, the dictionary frame, and what the reader refuses."""

import io
import struct

import pytest
import zstandard

from lantern.llm import warc


def row(i, payload, refers=None, url="http://a.b/"):
    return {"page_id": i, "url": url, "payload": payload, "payload_digest": warc.digest(payload), "refers_to": refers}


def packed(records, archive=warc.Archive()):
    sink = io.BytesIO()
    warc.write_archive(sink, records, archive)
    return sink.getvalue()


def test_dictionary_leads_and_each_record_is_a_frame():
    records = [warc.record(row(i, b"<html>number %d %s</html>" % (i, b"text " * 50)), warc.Archive()) for i in range(300)]
    data = packed(records)
    assert struct.unpack("<I", data[:4])[0] == warc.SKIPPABLE
    assert list(warc.frames(io.BytesIO(data))) == records
    slow = io.BytesIO(data)
    slow.read, whole = (lambda n, r=slow.read: r(7)), records
    assert list(warc.frames(slow)) == whole
    raw = zstandard.ZstdDecompressor().decompress(data[8 : 8 + struct.unpack("<I", data[4:8])[0]])
    assert struct.unpack("<I", raw[:4])[0] == warc.DICTIONARY
    plain = struct.pack("<II", warc.SKIPPABLE, len(raw)) + raw + data[8 + struct.unpack("<I", data[4:8])[0] :]
    assert list(warc.frames(io.BytesIO(plain))) == records


@pytest.mark.parametrize("break_", [
    lambda d: d[:-3],
    lambda d: b"x" + d,
    lambda d: d + b"tail",
    lambda d: d[:-12] + bytes([d[-12] ^ 255]) + d[-11:],
])
def test_broken_archives_are_refused(break_):
    data = packed([warc.record(row(1, b"payload"), warc.Archive())])
    with pytest.raises(warc.WarcError):
        for content in warc.frames(io.BytesIO(break_(data))):
            warc.parse_record(content)


@pytest.mark.parametrize("old, new", [
    (b"WARC/1.1", b"WARC/9.9"), (b"Content-Length: ", b"Content-Length: 1"), (b"WARC-Type", b"WARC-Kind"), (b"payload\r\n", b"PAYLOAD\r\n"),
    (b"sha1:", b"md5:"), (b"WARC-Date", b"WARC-Type"), (b"WARC-Date: 2024-01-01T00:00:00Z", b"WARC-Date"),
])
def test_broken_records_are_refused(old, new):
    content = warc.record(row(1, b"payload"), warc.Archive())
    assert warc.parse_record(content)["payload"] == b"payload"
    with pytest.raises(warc.WarcError):
        warc.parse_record(content.replace(old, new))


def test_round_trip_through_spark(spark):
    html = ["same", "same", None, "", "é" * 100_000, "same", "own\r\n\r\nx"] + [f"page {i} " + "x " * 50 for i in range(100)]
    rows = [(i * 3, None if i == 3 else f"http://h/{i}\r\nEvil: 1", h, "p") for i, h in enumerate(html)] + [(None, "u", "same", "p"), (0, "u", "same", "p")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload string")
    out = warc.round_trip(pages, warc.Archive(target_bytes=3000)).collect()
    assert len(out) == len(rows)
    by = {r.page_id: r for r in out}
    assert (by[3].record_type, by[3].refers_to, by[3].payload_bytes) == ("revisit", 0, 4)
    assert by[None].refers_to == by[15].refers_to == 0 and by[0].record_type == "response" and by[0].refers_to is None
    assert (by[6].record_type, by[9].record_type, by[9].refers_to, by[9].payload_bytes) == ("response", "revisit", 6, 0)
    assert by[12].payload_bytes == 200_000 and by[18].payload_digest == warc.digest(b"own\r\n\r\nx")
    assert warc.round_trip(pages.limit(0)).count() == 0
    payloads = {r.page_id: bytes(r.payload) for r in warc.read_archives(warc.write_archives(pages)).collect() if r.payload is not None}
    assert payloads[12].decode() == "é" * 100_000


def test_a_payload_of_many_pages(spark, monkeypatch):
    """A hot digest takes another way to the same rows."""
    monkeypatch.setattr(warc.shared, "HOT_ROWS", 2)
    pages = spark.createDataFrame([(i, "u", "" if i % 3 else f"own {i}") for i in range(60)] + [(None, "u", None)], "page_id long, url string, html string")
    rows = warc.round_trip(pages).collect()
    assert len(rows) == 61
    assert {(r.page_id, r.record_type, r.refers_to) for r in rows} == {(i, "revisit", 1) if i % 3 and i != 1 else (i, "response", None) for i in range(60)} | {(None, "revisit", 1)}


def test_ids_of_any_type(spark):
    """Ids come back as they were, whatever signs they hold; a text that is no id of the asked type is an error."""
    ids = ["p1", "p 2>", "", "é%3A", None, "p\r\n3"]
    pages = spark.createDataFrame([(i, "u", "same") for i in ids], "page_id string, url string, html string")
    rows = warc.round_trip(pages).collect()
    assert {(r.page_id, r.record_type, r.refers_to) for r in rows} == {(i, "response", None) if i == "" else (i, "revisit", "") for i in ids}
    days = pages.selectExpr("date_add(DATE'2024-01-01', cast(length(page_id) AS int)) AS page_id", "url", "html")
    assert sorted(map(str, (r.page_id for r in warc.round_trip(days).collect()))) == sorted(map(str, (r.page_id for r in days.collect())))
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        warc.read_archives(warc.write_archives(pages)).collect()
