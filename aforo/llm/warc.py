"""WARC in Zstandard: a writer, and a reader that loads the dictionary from the leading skippable frame and decodes
one frame a record, validating headers and lengths."""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, only, open_output, read_bytes, scratch_path, table

# Fixed values of the Zstandard and WARC formats.
FRAME, SKIPPABLE, DICTIONARY = 0xFD2FB528, range(0x184D2A50, 0x184D2A60), 0x184D2A5D
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_CONTROL = re.compile(r"[\x00-\x20\x7f-\x9f  ]")


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _page_urn(page_id: int | None) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}>"


def _page_of(urn: str | None) -> int | None:
    m = re.fullmatch(r"<urn:x-page:(-?\d+)>", urn or "")
    return int(m[1]) if m else None


def build_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """A response with its payload, or a revisit whose block has the HTTP headers alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    target = _CONTROL.sub(lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url or "") or _page_urn(page_id)[1:-1]
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_page_urn(page_id)}", f"WARC-Target-URI: {target}", f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{payload_digest(payload)}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {_page_urn(refers_to)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """Header fields and the block of one record; ValueError where the record is malformed."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not gap or not re.fullmatch(r"WARC/1\.[01]", lines[0]):
        raise ValueError("no WARC version line")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or name.lower() in fields:
            raise ValueError(f"bad or repeated header: {line[:80]}")
        fields[name.lower()] = value.strip()
    missing = {"warc-type", "warc-record-id", "warc-date", "content-length"} - fields.keys()
    if missing:
        raise ValueError(f"missing headers: {sorted(missing)}")
    n = int(fields["content-length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise ValueError(f"content length {n}, but {len(rest) - 4} bytes in the block")
    return {"fields": fields, "block": rest[:n]}


def parse_page(raw: bytes) -> tuple[int | None, int, str, str, int | None]:
    """(page_id, payload bytes, payload digest, record type, refers to) of a validated record."""
    record = parse_record(raw)
    fields, block = record["fields"], record["block"]
    http, gap, payload = block.partition(b"\r\n\r\n")
    length = re.search(rb"\r\nContent-Length: (\d+)", http)
    if not gap or not length:
        raise ValueError("the block has no HTTP headers with a length")
    n, digest, kind = int(length[1]), fields["warc-payload-digest"].removeprefix("sha1:"), fields["warc-type"]
    if kind == "response":
        if len(payload) != n or payload_digest(payload) != digest:
            raise ValueError("the payload differs from its length or digest")
    elif kind != "revisit" or payload or _page_of(fields.get("warc-refers-to")) is None:
        raise ValueError(f"unexpected record: {kind}")
    return _page_of(fields["warc-record-id"]), n, digest, kind, _page_of(fields.get("warc-refers-to"))


def frame_length(data: memoryview, at: int) -> int:
    """Bytes of the frame that starts here, from its header and those of its blocks."""
    (magic,) = struct.unpack_from("<I", data, at)
    if magic in SKIPPABLE:
        return 8 + struct.unpack_from("<I", data, at + 4)[0]
    if magic != FRAME:
        raise ValueError(f"no Zstandard frame at byte {at}")
    flags = data[at + 4]
    single = flags >> 5 & 1
    end = at + 5 + (not single) + (0, 1, 2, 4)[flags & 3] + ((1 if single else 0), 2, 4, 8)[flags >> 6]
    last = False
    while not last:
        head = int.from_bytes(data[end : end + 3], "little")
        last, kind, size = bool(head & 1), head >> 1 & 3, head >> 3
        end += 3 + (1 if kind == 1 else size)
    end += 4 * (flags >> 2 & 1)
    if end > len(data):
        raise ValueError("the last frame is cut off")
    return end - at


def write_archive(records: list[bytes], dictionary_bytes: int = 16_384, sample_bytes: int = 600_000, level: int = 3) -> bytes:
    """An archive: the dictionary frame, then a frame a record. The dictionary is trained on the first sample_bytes."""
    import zstandard

    samples, size = [], 0
    for r in records:
        if size >= sample_bytes:
            break
        samples.append(r[:65_536])
        size += len(samples[-1])
    try:
        trained = zstandard.train_dictionary(dictionary_bytes, samples) if len(samples) >= 8 else None
    except zstandard.ZstdError:  # too few or too equal samples: an archive without a dictionary is as valid
        trained = None
    compressor = zstandard.ZstdCompressor(level=level, dict_data=trained, write_checksum=True, write_content_size=True)
    packed = zstandard.ZstdCompressor(level=level).compress(trained.as_bytes()) if trained else b""
    lead = struct.pack("<II", DICTIONARY, len(packed)) + packed if trained else b""
    return lead + b"".join(map(compressor.compress, records))


def read_archive(raw: bytes) -> Iterator[bytes]:
    """The records of an archive. A dictionary in the leading skippable frame may itself be compressed."""
    import zstandard

    data, at, dictionary = memoryview(raw), 0, None
    if len(raw) >= 8 and struct.unpack_from("<I", raw)[0] == DICTIONARY:
        at = frame_length(data, 0)
        own = bytes(data[8:at])
        if own[:4] == struct.pack("<I", FRAME):
            own = zstandard.ZstdDecompressor().decompress(own)
        dictionary = zstandard.ZstdCompressionDict(own)
    decompressor = zstandard.ZstdDecompressor(dict_data=dictionary)
    while at < len(raw):
        n = frame_length(data, at)
        if struct.unpack_from("<I", data, at)[0] == FRAME:
            yield decompressor.decompress(data[at : at + n])
        at += n


_MANIFEST = T.StructType([T.StructField("path", T.StringType()), T.StructField("n_records", T.LongType()), T.StructField("n_bytes", T.LongType())])
_RECORDS = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("payload_bytes", T.LongType()), T.StructField("payload_digest", T.StringType()), T.StructField("record_type", T.StringType()), T.StructField("refers_to", T.LongType())])


def write_warc(pages: DataFrame, folder: str, *, min_bytes: int = 0, archive_bytes: int = 32_000_000, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Archives with a record for each page (page_id, url, html); returns the manifest (path, n_records, n_bytes).

    A null html is an empty payload, a null url becomes the page's URN. Of equal payloads of at least min_bytes the
    smallest page_id is the response and the others revisit it; rows that repeat that page_id with it are responses
    too, as are rows without a page_id. Payload groups are found on digests; the join back to the
    pages reads them from a written table, so AQE splits a payload that a large part of all pages share."""
    from pyspark.sql.pandas.types import to_arrow_schema

    full = pages.select(F.col("page_id").cast("long"), "url", F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8").alias("payload")).withColumn("digest", F.sha1("payload"))
    groups = full.where(F.length("payload") >= min_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").select("digest", "first")
    groups = materialize(groups, "warc-groups")
    told = full.join(groups, "digest", "left").select("page_id", "url", "payload", F.when((F.length("payload") >= min_bytes) & (F.col("page_id") != F.col("first")), F.col("first")).alias("refers_to"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, size
            data, url, n = write_archive(held), f"{folder}/{uuid.uuid4().hex}.warc.zst", len(held)
            with open_output(url) as f:
                f.write(data)
            held, size = [], 0
            return pa.RecordBatch.from_pydict({"path": [url], "n_records": [n], "n_bytes": [len(data)]}, schema=to_arrow_schema(_MANIFEST))

        for batch in batches:
            for page_id, url, payload, first in zip(*(c.to_pylist() for c in batch.columns)):
                held.append(build_record(page_id, url, payload, first, date))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield flush()
        if held:
            yield flush()

    return materialize(told.mapInArrow(write, _MANIFEST), "warc-manifest")


def read_warc(manifest: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every record of the archives, validated."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for url in batch.column(0).to_pylist():
                rows = [parse_page(r) for r in read_archive(read_bytes(url))]
                columns = list(zip(*rows)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()))], names=_RECORDS.names)

    return manifest.select("path").repartition(max(1, manifest.count()), "path").mapInArrow(read, _RECORDS)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A WARC record a row of `pages`, read back from the archives; payloads of 0 bytes revisit each other, too."""
    pages = only(table(spark, sf_dir, "pages"), "page_id", "url", "html")
    return read_warc(write_warc(pages, scratch_path(spark, "warc")))
