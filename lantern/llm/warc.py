"""WARC archives of Zstandard frames: writer and reader.

An archive begins with a skippable frame that holds its dictionary, raw or compressed; then each
record is one frame of its own, compressed with the dictionary. The reader goes through an archive
frame by frame, with one record in memory, and checks frames, headers, lengths and digests.

Archives are written by tasks straight into the shared folder, each attempt under names of its own,
and a task's rows name what it wrote. Only archives named in that staged list are read, so what a
lost attempt has left behind does no harm.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, LongType

from lantern.llm import arrow, shared

#: Magic numbers of the format: a skippable frame with a dictionary, a dictionary, a frame.
SKIPPABLE, DICTIONARY, FRAME = 0x184D2A5D, 0xEC30A437, 0xFD2FB528
VERSION = b"WARC/1.1\r\n"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_CONTROL = re.compile(r"[\x00-\x20\x7f]")
_CHUNK = 1 << 20
#: Tasks that read archives, at most; each reads several beyond that.
MAX_READERS = 20_000


class WarcError(ValueError):
    """An archive that breaks the format."""


@dataclass(frozen=True)
class Archive:
    target_bytes: int = 32 << 20  # of payloads in an archive
    dictionary_bytes: int = 16 << 10
    sample_records: int = 256  # of the archive's first records, for the dictionary
    sample_bytes: int = 2 << 20
    level: int = 3
    date: str = "2024-01-01T00:00:00Z"
    min_revisit_bytes: int = 0  # shorter payloads are never revisits


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode("ascii")


def page_urn(page_id: object) -> str:
    """The record id of a page, from the text of its id."""
    return "<urn:nopage:>" if page_id is None else f"<urn:page:{quote(str(page_id), safe='', errors='surrogatepass')}>"


def page_of(urn: str | None) -> str | None:
    """The text of the id in a record id; None for the record of a page without one."""
    if urn is None or urn == "<urn:nopage:>":
        return None
    if not (urn.startswith("<urn:page:") and urn.endswith(">")):
        raise WarcError(f"a record id is no page's: {urn[:60]!r}")
    return unquote(urn[10:-1], errors="surrogatepass")


def _header(name: str, value: str) -> str:
    return f"{name}: {_CONTROL.sub(lambda m: f'%{ord(m[0]):02X}', value)}\r\n"


def record(row: dict, archive: Archive) -> bytes:
    """The bytes of one record: page_id, url, payload, payload_digest, refers_to (None: a response)."""
    payload, revisit = row["payload"], row["refers_to"] is not None
    block = _HTTP % len(payload) + (b"" if revisit else payload)
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", page_urn(row["page_id"])),
        ("WARC-Date", archive.date),
        ("WARC-Target-URI", row["url"] or "about:blank"),
        ("WARC-Payload-Digest", f"sha1:{row['payload_digest']}"),
        ("WARC-Block-Digest", f"sha1:{digest(block)}"),
        ("Content-Type", "application/http;msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if revisit:
        fields += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", page_urn(row["refers_to"]))]
    return VERSION + "".join(_header(*f) for f in fields).encode("utf-8", "surrogatepass") + b"\r\n" + block + b"\r\n\r\n"


def trained(samples: list[bytes], archive: Archive) -> bytes:
    """A dictionary for records like `samples`, or b'' where there are too few to train on."""
    if len(samples) < 16:
        return b""
    try:
        return zstandard.train_dictionary(archive.dictionary_bytes, samples, level=archive.level).as_bytes()
    except zstandard.ZstdError:
        return b""


def write_archive(sink, records: Iterable[bytes], archive: Archive) -> int:
    """Write records to the open file `sink`; returns how many."""
    records, samples, size = iter(records), [], 0
    for item in records:
        samples.append(item)
        size += len(item)
        if len(samples) >= archive.sample_records or size >= archive.sample_bytes:
            break
    words = trained(samples, archive)
    if words:
        packed = zstandard.ZstdCompressor(level=archive.level).compress(words)
        sink.write(struct.pack("<II", SKIPPABLE, len(packed)) + packed)
    packer = zstandard.ZstdCompressor(level=archive.level, write_checksum=True, write_content_size=True, dict_data=zstandard.ZstdCompressionDict(words) if words else None)
    n = 0
    for part in (samples, records):
        for item in part:
            sink.write(packer.compress(item))
            n += 1
    return n


class _Input:
    """A file read in chunks, with what has been read ahead."""

    def __init__(self, source) -> None:
        self.source, self.held = source, b""

    def exactly(self, n: int) -> bytes:
        while len(self.held) < n:
            more = self.source.read(max(_CHUNK, n - len(self.held)))
            if not more:
                raise WarcError("the archive ends inside a frame")
            self.held += more
        out, self.held = self.held[:n], self.held[n:]
        return out

    def peek(self, n: int) -> bytes:
        while len(self.held) < n and (more := self.source.read(_CHUNK)):
            self.held += more
        return self.held[:n]


def frames(source) -> Iterator[bytes]:
    """The content of each frame of an archive, decoded with the dictionary that leads it."""
    data, words = _Input(source), None
    head = data.peek(8)
    if len(head) >= 8 and struct.unpack("<I", head[:4])[0] == SKIPPABLE:
        raw = data.exactly(8 + struct.unpack("<I", head[4:])[0])[8:]
        kind = struct.unpack("<I", raw[:4])[0] if len(raw) >= 4 else None
        if kind == FRAME:
            raw = zstandard.ZstdDecompressor().decompressobj().decompress(raw)
            kind = struct.unpack("<I", raw[:4])[0] if len(raw) >= 4 else None
        if kind != DICTIONARY:
            raise WarcError("the leading skippable frame holds no dictionary")
        words = zstandard.ZstdCompressionDict(raw)
    opener = zstandard.ZstdDecompressor(dict_data=words) if words else zstandard.ZstdDecompressor()
    while head := data.peek(4):
        if len(head) < 4 or struct.unpack("<I", head)[0] != FRAME:
            raise WarcError("a record does not begin with a frame")
        reader, parts = opener.decompressobj(), []
        while not reader.eof:
            chunk, data.held = data.held, b""
            if not chunk and not (chunk := data.source.read(_CHUNK)):
                raise WarcError("the archive ends inside a frame")
            try:
                parts.append(reader.decompress(chunk))
            except zstandard.ZstdError as error:
                raise WarcError(f"a frame can't be decoded: {error}") from error
        data.held = reader.unused_data
        yield b"".join(parts)


def parse_record(content: bytes) -> dict:
    """Check one frame's content and take the record apart."""
    head, gap, rest = content.partition(b"\r\n\r\n")
    if not head.startswith(VERSION) or not gap:
        raise WarcError("a record lacks its version or the end of its headers")
    fields: dict[str, str] = {}
    for line in head[len(VERSION) :].decode("utf-8", "surrogatepass").split("\r\n"):
        name, colon, value = line.partition(":")
        if not colon or not name or name.strip() != name:
            raise WarcError(f"a header can't be read: {line[:60]!r}")
        if name.lower() in fields:
            raise WarcError(f"a header comes twice: {name}")
        fields[name.lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if not fields.get(name):
            raise WarcError(f"a record lacks {name}")
    if not fields["content-length"].isdecimal() or int(fields["content-length"]) != len(rest) - 4:
        raise WarcError("a block has another length than its header says")
    block, close = rest[:-4], rest[-4:]
    if close != b"\r\n\r\n":
        raise WarcError("a record does not end with two line ends")
    if "warc-block-digest" in fields and fields["warc-block-digest"] != f"sha1:{digest(block)}":
        raise WarcError("a block has another digest than its header says")
    http, gap, payload = block.partition(b"\r\n\r\n")
    length = re.search(rb"(?i)\r\ncontent-length: *([0-9]+)", http)
    if not gap or not length:
        raise WarcError("a block holds no HTTP response")
    if fields["warc-type"] == "response":
        if int(length[1]) != len(payload):
            raise WarcError("a payload has another length than the response says")
        if fields.get("warc-payload-digest") != f"sha1:{digest(payload)}":
            raise WarcError("a payload has another digest than its header says")
    elif fields["warc-type"] != "revisit" or not fields.get("warc-refers-to") or payload:
        raise WarcError("a record is neither a response nor a revisit without payload")
    return {"headers": fields, "payload": payload, "payload_bytes": int(length[1])}


def _opened(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system and path of a URI; Hadoop's names for S3 are taken for `s3`."""
    return pyarrow.fs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", uri))


def write_archives(pages: DataFrame, archive: Archive = Archive()) -> DataFrame:
    """Write a record for every row of `pages` (page_id, url, html); returns (archive, records), staged.

    Of equal payloads the one with the least page_id is a response, and the others revisit it; rows
    that share that page_id are all responses. A null page_id is never referred to. Ids may be of any
    type that can be cast to text and back.
    """
    folder = f"{shared.shared_folder(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    sha1 = F.sha1(F.col("html").cast("binary"))
    # Who refers to whom is found on digests alone; then only pages that refer to another one are looked up.
    narrow = shared.staged(rows.filter(F.octet_length("html") >= archive.min_revisit_bytes).select("page_id", sha1.alias("_sha1")), "warc-digests")
    equal = narrow.groupBy("_sha1").agg(F.min("page_id").alias("_first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("_sha1", "_first")
    again = shared.join_hot(narrow, equal, "_sha1").filter(~F.col("page_id").eqNullSafe(F.col("_first")))
    again = shared.staged(again.select(F.col("page_id").alias("_id"), F.col("_sha1"), "_first").distinct(), "warc-revisits")
    same = F.col("page_id").eqNullSafe(F.col("_id")) & (sha1 == F.col("_sha1"))
    rows = rows.join(shared.small(again, 200_000), same, "left").select(
        F.col("page_id").cast("string").alias("page_id"), "url", "html", F.col("_first").cast("string").alias("refers_to")
    )

    def run(rows: Iterator[dict]) -> Iterable[dict]:
        files, path = _opened(folder)
        files.create_dir(path, recursive=True)
        size = 0

        def batch(first: dict) -> Iterator[bytes]:
            nonlocal size
            size, row = 0, first
            while row is not None:
                payload = row["html"].encode("utf-8", "surrogatepass")
                size += len(payload)
                yield record(row | {"payload": payload, "payload_digest": digest(payload)}, archive)
                row = next(rows, None) if size < archive.target_bytes else None

        while (row := next(rows, None)) is not None:
            name = f"{path}/{uuid.uuid4().hex}.warc.zst"
            with files.open_output_stream(name) as sink:
                n = write_archive(sink, batch(row), archive)
            yield {"archive": f"{folder}/{name.rpartition('/')[2]}", "records": n}

    return shared.staged(arrow.map_rows(rows, run, "archive string, records long"), "warc-list")


def read_archives(archives: DataFrame, id_type: DataType = LongType()) -> DataFrame:
    """The records of the archives in `archives` (archive: URI of a file).

    Returns page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload (null for
    a revisit). Ids are read as text and cast to `id_type`; one that can't be cast fails the query. An
    archive that breaks the format, or a record that is no page's, raises `WarcError`.
    """
    def run(rows: Iterator[dict]) -> Iterable[dict]:
        for row in rows:
            files, path = _opened(row["archive"])
            with files.open_input_stream(path) as source:
                for content in frames(source):
                    found = parse_record(content)
                    headers, revisit = found["headers"], found["headers"]["warc-type"] == "revisit"
                    yield {
                        "page_id": page_of(headers["warc-record-id"]),
                        "url": headers.get("warc-target-uri"),
                        "payload_bytes": found["payload_bytes"],
                        "payload_digest": headers.get("warc-payload-digest", "").removeprefix("sha1:"),
                        "record_type": headers["warc-type"],
                        "refers_to": page_of(headers.get("warc-refers-to")),
                        "payload": None if revisit else found["payload"],
                    }

    ddl = "page_id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string, payload binary"
    spread = archives.repartition(max(1, min(archives.count(), MAX_READERS)))  # dealt in turn, so evenly
    records = arrow.map_rows(spread, run, ddl, rows=64)
    return records.withColumns({c: F.col(c).cast(id_type) for c in ("page_id", "refers_to")})


def round_trip(pages: DataFrame, archive: Archive = Archive()) -> DataFrame:
    """Write `pages` (page_id, url, html; other columns are ignored) to archives and read those back.

    Returns page_id, payload_bytes, payload_digest (base32 SHA-1; both of the full payload),
    record_type, refers_to, one row for each row of `pages`. A null html is an empty payload. A null
    page_id stays null and is a revisit of an equal payload with an id. An empty table gives an
    empty result.
    """
    rows = read_archives(write_archives(pages, archive), pages.schema["page_id"].dataType)
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(shared.table(spark, sf_dir, "pages"))


def oracle() -> str:
    """DuckDB SQL for `round_trip`, base32 digit by digit from the hexadecimal digest."""
    return """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS h FROM pages
), b AS (
  SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM p
)
SELECT page_id, n::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[
    ((('0x' || substr(h || '0', (i * 5 // 4)::INTEGER + 1, 2))::INTEGER >> (3 - i * 5 % 4)::INTEGER) & 31) + 1]), '') AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM b"""
