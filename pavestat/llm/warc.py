"""WARC 1.1 archives in Zstandard: a dictionary in the leading skippable frame, then
one frame per record.

``write`` packs pages into archives, marks repeated payloads as revisits and stores the
archives as rows of Spark part files in the shared folder; ``read`` decodes them and
checks every header and length. ``pack`` and ``unpack`` work on one archive's bytes;
``read_files`` reads archives of any writer from files of any store that Spark reads.

``unpack`` takes records of every type: those without an HTTP block give the block as it
is. The digests of payload and block are checked where they are given as SHA-1. Frames
need no content size; skippable frames after the leading one are passed over. An archive
of under eight records, or of records too alike to train on, is written without a
dictionary.

Defined results: a null html is the empty payload, a null url leaves its header out;
of rows with equal payloads all those with the least id are responses, so rows that
repeat an id are written alike; a null id is a response unless its payload has a row
with an id; extra columns are not stored; an empty table writes no archive. Payloads
are held equal by length and SHA-1.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import small_batches
from .common import arrow_map, new_path, sized_broadcast

#: Fixed values of the formats.
SKIPPABLE, DICTIONARY_FRAME = 0x184D2A50, 0x184D2A5D
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payload bytes that close an archive; records and bytes its dictionary is trained on.
ARCHIVE_BYTES, TRAIN_RECORDS, DICTIONARY_BYTES = 8 << 20, 48, 8 << 10
#: Repeated payloads that are broadcast at most; more are joined by a shuffle.
BROADCAST_ROWS = 200_000
DATE = "2024-01-01T00:00:00Z"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _safe(value: str) -> str:
    return "".join(c if c.isprintable() and c != " " else "".join(f"%{b:02X}" for b in c.encode()) for c in value)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC record. A revisit carries the HTTP header alone, with the digest and
    the length of the payload that it stands for."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        "WARC-Type: " + ("response" if refers_to is None else "revisit"),
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + _safe(url))
    if refers_to is not None:
        head += ["WARC-Profile: " + REVISIT_PROFILE, f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def pack(records: list[bytes]) -> bytes:
    """An archive. Records too few or too alike to train on go without a dictionary."""
    trained = None
    try:
        if len(records) >= 8:
            trained = zstandard.train_dictionary(DICTIONARY_BYTES, [r[:8192] for r in records[:TRAIN_RECORDS]], k=128, d=8)
    except zstandard.ZstdError:
        trained = None
    coder = zstandard.ZstdCompressor(level=3, dict_data=trained, write_checksum=True, write_content_size=True)
    out = []
    if trained is not None:
        data = trained.as_bytes()
        out.append(struct.pack("<II", DICTIONARY_FRAME, len(data)) + data)
    return b"".join(out + [coder.compress(r) for r in records])


def frames(data: memoryview) -> Iterator[memoryview]:
    """The Zstandard frames one after another, by their block headers; skippable ones are
    passed over."""
    at = 0
    while at < len(data):
        if len(data) - at >= 8 and SKIPPABLE <= struct.unpack_from("<I", data, at)[0] < SKIPPABLE + 16:
            at += 8 + struct.unpack_from("<I", data, at + 4)[0]
            if at > len(data):
                raise ValueError("skippable frame cut short")
            continue
        if data[at : at + 4] != FRAME_MAGIC:
            raise ValueError("no Zstandard frame where one should begin")
        end = at + zstandard.frame_header_size(data[at : at + 18])
        last = False
        while not last:
            if end + 3 > len(data):
                raise ValueError("frame cut short")
            header = int.from_bytes(data[end : end + 3], "little")
            last, kind, size = bool(header & 1), header >> 1 & 3, header >> 3
            if kind == 3:
                raise ValueError("reserved block type")
            end += 3 + (1 if kind == 1 else size)
        end += 4 * (data[at + 4] >> 2 & 1)
        if end > len(data):
            raise ValueError("frame cut short")
        yield data[at:end]
        at = end


def _check(name: str, stated: str | None, body: bytes) -> None:
    """A digest that is given as SHA-1, in base32 or hexadecimal, must be that of ``body``."""
    kind, _, value = (stated or "").partition(":")
    if kind.strip().lower() in ("sha1", "sha-1"):
        raw = hashlib.sha1(body).digest()
        if value.strip().upper() not in (base64.b32encode(raw).decode(), raw.hex().upper()):
            raise ValueError(f"{name} differs from its digest")


def unpack(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and payload of each record, checked. The payload of an
    HTTP record is what follows the HTTP header; of another it is the whole block."""
    data, trained = memoryview(archive), None
    if len(data) >= 8 and (sized := struct.unpack_from("<II", data))[0] == DICTIONARY_FRAME:
        raw = bytes(data[8 : 8 + sized[1]])
        if len(raw) != sized[1]:
            raise ValueError("dictionary cut short")
        if raw[:4] == FRAME_MAGIC:
            raw = zstandard.ZstdDecompressor().decompressobj().decompress(raw)
        trained, data = zstandard.ZstdCompressionDict(raw), data[8 + sized[1] :]
    decoder = zstandard.ZstdDecompressor(dict_data=trained)
    for frame in frames(data):
        whole = decoder.decompressobj().decompress(frame)
        head, found, rest = whole.partition(b"\r\n\r\n")
        lines = head.decode("utf-8", "replace").split("\r\n")
        if not found or lines[0] not in ("WARC/1.0", "WARC/1.1"):
            raise ValueError("not a WARC record")
        fields: dict[str, str] = {}
        last = ""
        for line in lines[1:]:
            if line[:1] in (" ", "\t") and last:  # a folded header goes on
                fields[last] += " " + line.strip()
                continue
            name, _, value = line.partition(":")
            last = name.strip().lower()
            fields[last] = value.strip()
        missing = {"warc-type", "warc-record-id", "warc-date", "content-length"} - fields.keys()
        if missing:
            raise ValueError(f"record without {sorted(missing)}")
        length = int(fields["content-length"])
        if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
            raise ValueError("record length differs from its header")
        block, kind = rest[:length], fields["warc-type"]
        _check("block", fields.get("warc-block-digest"), block)
        http, found, payload = block.partition(b"\r\n\r\n")
        if not (http.startswith(b"HTTP/") or (kind == "request" and found)):
            payload = block
        elif not found:
            raise ValueError("HTTP header without an end")
        if kind == "revisit":
            if "warc-refers-to" not in fields and "warc-refers-to-target-uri" not in fields and "warc-payload-digest" not in fields:
                raise ValueError("revisit that refers to nothing")
        else:
            _check("payload", fields.get("warc-payload-digest"), payload)
            if "x-payload-length" in fields and len(payload) != int(fields["x-payload-length"]):
                raise ValueError("payload differs from its length")
        yield fields, payload


def marked(df: DataFrame, least_bytes: int = 0, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``page_id, url, html, refers_to``; equal payloads of ``least_bytes`` or more
    refer to the least id among them. Only digests are shuffled, pre-aggregated."""
    rows = df.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    keyed = rows.withColumn("size", F.octet_length("html").cast("long")).withColumn("sha", F.unhex(F.sha1(F.encode("html", "utf-8"))))
    groups = keyed.where(F.col("size") >= least_bytes).groupBy("sha", "size").agg(F.min("page_id").alias("first"), F.count("*").alias("copies"))
    repeated = groups.where("copies > 1 and first is not null").select("sha", "size", "first")
    joined = keyed.join(sized_broadcast(repeated, BROADCAST_ROWS), ["sha", "size"], "left")
    refers = F.when(F.col("page_id").isNull() | (F.col("page_id") > F.col("first")), F.col("first"))
    return joined.select("page_id", "url", "html", refers.alias("refers_to"))


def write(df: DataFrame, path: str, least_bytes: int = 0) -> None:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k, held, size = TaskContext.get().partitionId(), 0, [], 0

        def archive() -> pa.RecordBatch:
            nonlocal k, size
            name, data = f"pages-{part:06d}-{k:06d}.warc.zst", pack(held)
            k, size = k + 1, 0
            held.clear()
            return pa.RecordBatch.from_pydict({"name": [name], "data": [data]}, pa.schema([("name", pa.string()), ("data", pa.binary())]))

        for batch in small_batches(batches):
            for page, url, html, refers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.append(record(page, url, html.encode(), refers))
                size += len(html)
                if size >= ARCHIVE_BYTES:
                    yield archive()
        if held:
            yield archive()

    arrow_map(marked(df, least_bytes), run, "name string, data binary").write.option("compression", "none").parquet(path)


def _id(uri: str) -> int | None:
    number = uri.removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def read(spark: SparkSession, path: str) -> DataFrame:
    """A row per record: ``page_id, payload_bytes, payload_digest, record_type,
    refers_to, url, html``; a revisit's html is null."""
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("html", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 1):
            for data in batch.column(0).to_pylist():
                rows = []
                for f, payload in unpack(data):
                    kind = f["warc-type"]
                    refers = _id(f["warc-refers-to"]) if kind == "revisit" else None
                    html = payload.decode() if kind == "response" else None
                    rows.append((_id(f["warc-record-id"]), int(f["x-payload-length"]), f["warc-payload-digest"].removeprefix("sha1:"), kind, refers, f.get("warc-target-uri"), html))
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    stored = spark.read.schema("name string, data binary").parquet(path)
    return arrow_map(stored.select("data"), run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, html string")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """A row per record of the ``.warc.zst`` files of ``path``: ``file, record_type,
    record_id, date, target_uri, payload_digest, payload``. A file is one task's."""
    names = ["record_type", "record_id", "date", "target_uri", "payload_digest"]
    headers = ["warc-type", "warc-record-id", "warc-date", "warc-target-uri", "warc-payload-digest"]
    schema = pa.schema([("file", pa.string()), *((n, pa.string()) for n in names), ("payload", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 1):
            rows, size = [], 0
            for file, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for f, payload in unpack(data):
                    rows.append((file, *(f.get(h) for h in headers), payload))
                    size += len(payload)
                    if size >= ARCHIVE_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                        rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.warc.zst").load(path)
    return arrow_map(files.select(F.col("path").alias("file"), "content"), run, f"file string, {', '.join(f'{n} string' for n in names)}, payload binary")


def unmatched(records: DataFrame) -> DataFrame:
    """Revisits of ``read`` whose response is not there with the same digest and length."""
    there = records.where("record_type = 'response'").select(F.col("page_id").alias("refers_to"), "payload_digest", "payload_bytes")
    return records.where("record_type = 'revisit'").join(there, ["refers_to", "payload_digest", "payload_bytes"], "left_anti")


def round_trip(df: DataFrame, least_bytes: int = 0) -> DataFrame:
    path = new_path(df.sparkSession, "warc")
    write(df, path, least_bytes)
    return read(df.sparkSession, path)
