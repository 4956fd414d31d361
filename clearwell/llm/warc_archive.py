"""WARC archives in Zstandard: one frame for each record, with a shared dictionary in the leading skippable frame.

Each archive begins with a skippable frame that holds the dictionary; every record is a frame of its own, compressed with
it, so any record can be read alone by its offset. The reader loads the dictionary from that frame, decodes
frame by frame, and checks headers, lengths and digests; a damaged archive is an error, never a shorter result.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clearwell.llm.blocks import stored, text_blocks
from clearwell.session import scratch_path

#: Magic number of the skippable frame that holds a dictionary.
SKIPPABLE = 0x184D2A5D
#: An archive is closed when it has grown to this size; a new one is begun.
ARCHIVE_BYTES = 64 << 20
#: The dictionary is fitted on the first characters of so many pages, those with the smallest hash of their id.
SAMPLE_PAGES, SAMPLE_CHARS, DICTIONARY_BYTES = 512, 8192, 32 << 10
LEVEL = 3
_DATE = "2024-01-01T00:00:00Z"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def _filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


def _qualified(spark: SparkSession, path: str) -> str:
    """A full address of ``path``, found on the driver: tasks would take one without a scheme for a local folder of their own."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    full = place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).makeQualified(place).toString()
    return re.sub("^file:/+", "file:///", full)


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'page/{page_id}')}>"


def fit_dictionary(pages: DataFrame) -> bytes:
    """A dictionary from a bounded sample of ``pages``; empty where the sample is too small to learn from.

    Ids are chosen first, so that a task hands on numbers and not texts; then one text for each of them is fetched.
    """
    full = pages.where("html is not null and page_id is not null")
    ids = [r.page_id for r in full.select("page_id").orderBy(F.xxhash64("page_id"), "page_id").limit(SAMPLE_PAGES).collect()]
    rows = sorted(full.where(F.col("page_id").isin(sorted(set(ids)))).groupBy("page_id").agg(F.min(F.substring("html", 1, SAMPLE_CHARS)).alias("html")).collect()) if ids else []
    samples = [r.html.encode() for r in rows if r.html]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes() if len(samples) >= 32 else b""
    except zstandard.ZstdError:
        return b""


def build_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, is_response: bool) -> bytes:
    """A response with its payload, or a revisit without it, as WARC 1.1 has them."""
    digest = f"sha1:{base32_sha1(payload)}"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if is_response else http
    target = "".join(c for c in url or "" if c >= " ")  # a line break would end the header
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if is_response else 'revisit'}", f"WARC-Record-ID: {_record_id(page_id)}",
        f"WARC-Date: {_DATE}", f"WARC-Target-URI: {target}", f"X-Page-ID: {'' if page_id is None else page_id}",
        "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: {digest}", f"Content-Length: {len(block)}",
    ]
    if not is_response:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                 f"WARC-Refers-To: {_record_id(refers_to)}", f"X-Refers-To-Page: {refers_to}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def leading_frame(dictionary: bytes) -> bytes:
    return struct.pack("<II", SKIPPABLE, len(dictionary)) + dictionary


class _Writer:
    def __init__(self, folder: str, dictionary: bytes) -> None:
        self.folder, self.dictionary = folder, dictionary
        self.codec = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None, write_content_size=True)
        self.out = self.path = None
        self.closed: list[tuple[str, int, int]] = []

    def add(self, record: bytes) -> None:
        if self.out is None:
            self.path = f"{self.folder}/{uuid.uuid4().hex}.warc.zst"  # an attempt that is lost leaves a file that no manifest names
            fs, path = _filesystem(self.path)
            fs.create_dir(path.rpartition("/")[0], recursive=True)
            self.out, self.size, self.records = fs.open_output_stream(path), 0, 0
            self.put(leading_frame(self.dictionary))
        self.put(self.codec.compress(record))
        self.records += 1
        if self.size >= ARCHIVE_BYTES:
            self.close()

    def put(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.closed.append((self.path, self.records, self.size))
            self.out = None


def write_archives(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """A record for each row of ``pages`` (page_id, url, html, ...); returns the manifest (path, records, bytes).

    Of rows with equal payloads, those with the largest page_id become responses and the others revisits of it; null html is an
    empty payload, and a null page_id is smaller than any other. Rows that repeat a page_id and its payload
    are alike: all responses or all revisits. ``folder`` must be seen by all executors; by default it is a new one
    in the shared folder. Other columns are ignored; an empty table writes no archive.
    """
    spark = pages.sparkSession
    folder = _qualified(spark, folder or scratch_path(spark, "warc"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    digest = F.sha1(F.encode("html", "utf-8"))
    first = rows.select("page_id", digest.alias("digest")).groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count("*").alias("copies"))
    # most payloads are alone and need no lookup: only the keepers of repeated ones are joined
    rows = rows.withColumn("digest", digest).join(first.where("copies > 1").select("digest", "keeper"), "digest", "left")
    dictionary = fit_dictionary(pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("html").cast("string").alias("html")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Writer(folder, dictionary)
        for batch in text_blocks(batches, "html"):
            for page, url, html, keeper in zip(*(batch.column(c) for c in ("page_id", "url", "html", "keeper"))):
                page, keeper = page.as_py(), keeper.as_py()
                response = keeper is None or page == keeper
                out.add(build_record(page, url.as_py(), html.as_py().encode("utf-8", "surrogatepass"), keeper, response))
        out.close()
        yield pa.record_batch([pa.array(c, t) for c, t in zip(list(zip(*out.closed)) or [[]] * 3, (pa.string(), pa.int64(), pa.int64()))],
                              names=["path", "records", "bytes"])

    manifest = rows.select("page_id", "url", "html", "keeper").mapInArrow(run, "path string, records long, bytes long")
    return stored(manifest, "manifest")


class ArchiveError(ValueError):
    """An archive that is not what it should be."""


def parse_record(data: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Headers, HTTP head and payload of one record, with versions, lengths and the payload's digest checked."""
    head, found, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not found or lines[0] != "WARC/1.1":
        raise ArchiveError("a record must begin with its version and end its headers with an empty line")
    headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    missing = {"WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length", "WARC-Payload-Digest"} - set(headers)
    if missing:
        raise ArchiveError(f"headers are missing: {sorted(missing)}")
    if not headers["Content-Length"].isdigit() or len(rest) != int(headers["Content-Length"]) + 4 or rest[-4:] != b"\r\n\r\n":
        raise ArchiveError(f"{headers['WARC-Record-ID']}: its block does not have the length that it states")
    http, found, payload = rest[:-4].partition(b"\r\n\r\n")
    if not found or not http.startswith(b"HTTP/"):
        raise ArchiveError(f"{headers['WARC-Record-ID']}: no HTTP head")
    if headers["WARC-Type"] == "response":
        if f"sha1:{base32_sha1(payload)}" != headers["WARC-Payload-Digest"]:
            raise ArchiveError(f"{headers['WARC-Record-ID']}: the payload does not match its digest")
        if len(payload) != _http_length(http):
            raise ArchiveError(f"{headers['WARC-Record-ID']}: the payload does not have the length in its HTTP head")
    elif headers["WARC-Type"] != "revisit" or payload or "WARC-Refers-To" not in headers:
        raise ArchiveError(f"{headers['WARC-Record-ID']}: neither a response nor a revisit without payload")
    return headers, http, payload


def _http_length(http: bytes) -> int:
    return int(next(x for x in http.split(b"\r\n") if x.startswith(b"Content-Length: "))[16:])


def read_records(stream) -> Iterator[bytes]:
    """The records of an archive, one frame at a time; memory is that of the largest record."""
    head = stream.read(8)
    if len(head) < 8 or struct.unpack("<II", head)[0] != SKIPPABLE:
        raise ArchiveError("an archive must begin with the skippable frame of its dictionary")
    dictionary = stream.read(struct.unpack("<II", head)[1])
    if len(dictionary) != struct.unpack("<II", head)[1]:
        raise ArchiveError("the dictionary is cut off")
    codec = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
    pending = b""
    while True:
        pending = pending or stream.read(1 << 20)
        if not pending:
            return
        frame, pieces = codec.decompressobj(), []
        while not frame.eof:
            if not pending and not (pending := stream.read(1 << 20)):
                raise ArchiveError("the last frame is cut off")
            pieces.append(frame.decompress(pending))
            pending = frame.unused_data if frame.eof else b""
        yield b"".join(pieces)


def read_archives(manifest: DataFrame) -> DataFrame:
    """The records of all archives of a manifest: (page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload).

    A revisit's length and digest are those of the full payload, as its headers state them; its payload is null.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, records in zip(batch.column("path").to_pylist(), batch.column("records").to_pylist()):
                fs, inner = _filesystem(path)
                seen, rows, held = 0, [], 0
                with fs.open_input_stream(inner) as stream:
                    for data in read_records(stream):
                        headers, http, payload = parse_record(data)
                        response = headers["WARC-Type"] == "response"
                        seen, held = seen + 1, held + len(payload)
                        rows.append((int(headers["X-Page-ID"]) if headers["X-Page-ID"] else None, headers["WARC-Target-URI"], headers["WARC-Type"],
                                     None if response else int(headers["X-Refers-To-Page"]), _http_length(http),
                                     headers["WARC-Payload-Digest"].removeprefix("sha1:"), payload if response else None))
                        if held >= 8 << 20 or len(rows) >= 10_000:
                            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
                            rows, held = [], 0
                if rows:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
                if seen != records:
                    raise ArchiveError(f"{path} has {seen} records instead of {records}")

    names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"]
    types = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary())
    # an archive is the unit of work
    spread = manifest.select("path", "records").repartition(max(1, manifest.count()), "path")
    return spread.mapInArrow(run, "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary")
