"""WARC archives in Zstandard form: one frame per record after a leading dictionary.

An archive begins with a skippable frame (magic 0x184D2A5D) that holds the
dictionary of all later frames; each of these is one record. A writing task
rolls over to a new archive at ``ARCHIVE_BYTES`` and lists what it has written;
archives lie in the shared folder under names of their own for every attempt, so
a task that is run again leaves its first files unlisted. A reading task streams
its archives: it loads the dictionary, decodes frame by frame and checks version,
header lines, lengths and digests.

Equal payloads of at least ``REVISIT_BYTES`` bytes are kept once: the record of
the smallest page_id is the response, the others are revisits that refer to it.
Which page that is comes from digests and ids alone; payloads cross the shuffle
compressed.

The reader takes archives of others too: a dictionary that is itself compressed, any
type of record, digests by other algorithms (checked where hashlib has them), HTTP
messages, whose payload begins after their own headers, and record ids of any form
(page_id is null unless it is one of ours). A header that may stand once must not stand
twice.

Defined results: null html is an empty payload; a null page_id is written as
``null`` and read back as null, and is never referred to while another id is
there; rows that repeat a page_id and payload are records of one type; line
breaks in a url are percent-encoded; an empty table makes no archive.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmerge.llm.common import hash_sample, in_text_batches, materialise, scratch, text_batches

MAGIC = 0x184D2A5D
ARCHIVE_BYTES = 32 << 20
REVISIT_BYTES = 100
#: Pages for the dictionary, the most of each that goes in, and the dictionary's size.
SAMPLE_PAGES = 256
SAMPLE_BYTES = 16384
DICTIONARY_BYTES = 64 << 10
CHUNK = 1 << 20
DATE = "2024-01-01T00:00:00Z"


class WarcError(ValueError):
    """An archive or record that breaks the format."""


def train_dictionary(pages: DataFrame) -> bytes:
    """A dictionary from a bounded sample of pages, or a raw one where they are too few."""
    import zstandard

    filled = pages.filter("html <> ''").select("page_id", "url", F.encode("html", "UTF-8").alias("h"))
    few = hash_sample(filled, SAMPLE_PAGES, pages.count(), "page_id", "url")
    rows = few.select(F.substring("h", 1, SAMPLE_BYTES).alias("h")).collect()
    samples = [bytes(r.h) for r in rows]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:DICTIONARY_BYTES] or b"WARC/1.1\r\nWARC-Type: "


def payload_roles(pages: DataFrame) -> DataFrame:
    """(page_id, digest, first): of payloads that occur more than once and are long enough."""
    ids = pages.select("page_id", digest_of("html").alias("digest"), bytes_of("html").alias("size")).filter(
        F.col("size") >= REVISIT_BYTES
    )
    firsts = ids.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1")
    return ids.join(firsts, "digest").select("page_id", "digest", "first").distinct()


def bytes_of(column: str):
    return F.octet_length(F.coalesce(F.col(column), F.lit("")))


def digest_of(column: str):
    return F.sha2(F.coalesce(F.col(column), F.lit("")).cast("binary"), 256)


def write_archives(pages: DataFrame, dictionary: bytes | None = None, folder: str | None = None) -> DataFrame:
    """Writes every page as a record; returns the list of archives (path, n_records, n_bytes), itself a shared table."""
    spark = pages.sparkSession
    text_batches(spark)
    pages = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", "html")
    shared = spark.sparkContext.broadcast(dictionary or train_dictionary(pages))
    roles = payload_roles(pages).select(
        F.col("page_id").alias("r_page_id"), F.col("digest").alias("r_digest"), F.col("first")
    )
    small = pages.withColumn("digest", digest_of("html")).mapInArrow(
        compressor(shared), "page_id bigint, url string, payload binary, digest string"
    )
    marked = small.join(
        roles, small["page_id"].eqNullSafe(roles["r_page_id"]) & (small["digest"] == roles["r_digest"]), "left"
    ).select("page_id", "url", "payload", "digest", "first")
    to = make_folder(spark, folder or scratch(spark, "warc"))
    return materialise(marked.mapInArrow(writer(shared, to), "path string, n_records bigint, n_bytes bigint"), "warc-list")


def make_folder(spark: SparkSession, folder: str) -> str:
    """Makes the folder and names it in full, with its file system, so that executors use the same one."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(path)
    return system.makeQualified(path).toString()


def filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def compressor(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        z = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(shared.value))
        for batch in batches:
            payloads = [z.compress(h or b"") for h in batch.column("html").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(payloads, pa.binary()), batch.column("digest")],
                ["page_id", "url", "payload", "digest"],
            )

    return run


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, first: int | None, role: str) -> bytes:
    """One WARC record; a revisit keeps the length and digest of the payload it leaves out."""
    clean = "".join(f"%{ord(c):02X}" if c in "\r\n%" else c for c in url or "")
    head = [
        "WARC/1.1",
        f"WARC-Type: {role}",
        f"WARC-Record-ID: <urn:page:{'null' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {clean}",
        "Content-Type: text/html; charset=utf-8",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if role == "revisit":
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head.append(f"WARC-Refers-To: <urn:page:{'null' if first is None else first}>")
    body = b"" if role == "revisit" else payload
    head.append(f"Content-Length: {len(body)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def skippable(dictionary: bytes) -> bytes:
    return struct.pack("<II", MAGIC, len(dictionary)) + dictionary


def writer(shared, folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        d = zstandard.ZstdCompressionDict(shared.value)
        z, un = zstandard.ZstdCompressor(level=3, dict_data=d), zstandard.ZstdDecompressor(dict_data=d)
        fs, root = filesystem(folder)
        out, listed, count, size = None, [], 0, 0

        def finish():
            out.close()
            listed.append((path, count, size))

        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                page_id, url, packed, digest, first = row
                if out is None:
                    name = f"part-{uuid.uuid4().hex}.warc.zst"
                    path, out = f"{folder}/{name}", fs.open_output_stream(f"{root}/{name}", compression=None)
                    lead = skippable(shared.value)
                    out.write(lead)
                    count, size = 0, len(lead)
                role = "response" if first is None or first == page_id else "revisit"
                frame = z.compress(record(page_id, url, un.decompress(packed), digest, first, role))
                out.write(frame)
                count, size = count + 1, size + len(frame)
                if size > ARCHIVE_BYTES:
                    finish()
                    out = None
        if out is not None:
            finish()
        yield pa.RecordBatch.from_pylist(
            [{"path": p, "n_records": n, "n_bytes": b} for p, n, b in listed],
            pa.schema([("path", pa.string()), ("n_records", pa.int64()), ("n_bytes", pa.int64())]),
        )

    return run


def frames(stream) -> Iterator[bytes]:
    """Decoded frames of an archive after its dictionary."""
    import zstandard

    lead = stream.read(8)
    if len(lead) < 8:
        raise WarcError("no leading frame")
    magic, size = struct.unpack("<II", lead)
    if magic != MAGIC:
        raise WarcError("the leading frame is no dictionary")
    dictionary = stream.read(size)
    if len(dictionary) != size:
        raise WarcError("the dictionary is cut short")
    if dictionary[:4] == zstandard.FRAME_HEADER:
        try:
            dictionary = zstandard.ZstdDecompressor().decompressobj().decompress(dictionary)
        except zstandard.ZstdError as e:
            raise WarcError(f"broken dictionary: {e}") from e
    z = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))
    held = b""
    while held := held or stream.read(CHUNK):
        while len(held) < 8 and (more := stream.read(CHUNK)):
            held += more
        if held[3:4] == b"\x18" and held[1:3] == b"\x2a\x4d" and held[0] >> 4 == 5:
            held = skipped(held, stream)
            continue
        frame, parts = z.decompressobj(), []
        while True:
            try:
                parts.append(frame.decompress(held))
            except zstandard.ZstdError as e:
                raise WarcError(f"broken frame: {e}") from e
            if frame.eof:
                held = frame.unused_data
                break
            held = stream.read(CHUNK)
            if not held:
                raise WarcError("the last frame is cut short")
        yield b"".join(parts)


def skipped(held: bytes, stream) -> bytes:
    """What follows a skippable frame, which may stand between any two others."""
    left = 8 + int.from_bytes(held[4:8], "little")
    while len(held) < left:
        left, held = left - len(held), stream.read(CHUNK)
        if not held:
            raise WarcError("a skippable frame is cut short")
    return held[left:]


def count_of(value: str, what: str) -> int:
    """A number of bytes, of 18 digits at most."""
    if not (value.isascii() and value.isdigit() and len(value) <= 18):
        raise WarcError(f"no {what}")
    return int(value)


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and body of one record, checked. Bytes that are no UTF-8 are U+FFFD; a line that begins with white space goes on with the last."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    if not gap:
        raise WarcError("no end of headers")
    version, *rows = re.sub(r"\r\n[ \t]+", " ", head.decode("utf-8", "replace")).split("\r\n")
    if version not in ("WARC/1.0", "WARC/1.1"):
        raise WarcError(f"unknown version {version[:20]!r}")
    headers: dict[str, str] = {}
    for row in rows:
        name, colon, value = row.partition(":")
        if not colon or not name or name.strip() != name:
            raise WarcError(f"no header line: {row[:40]!r}")
        if name.lower() in headers and name.lower() != "warc-concurrent-to":
            raise WarcError(f"{name} twice")
        headers[name.lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in headers:
            raise WarcError(f"no {name}")
    n = count_of(headers["content-length"], "length")
    if rest[n:] != b"\r\n\r\n":
        raise WarcError("content length and record differ")
    return headers, rest[:n]


def page_of(value: str | None) -> int | None:
    inner = (value or "").removeprefix("<urn:page:").removesuffix(">")
    digits = inner.removeprefix("-")
    number = int(inner) if digits.isascii() and digits.isdigit() and len(digits) <= 19 else None
    return number if number is not None and -(2**63) <= number < 2**63 else None


def check_digest(named: str | None, body: bytes, what: str) -> None:
    """Holds a digest header (algorithm:value, in hexadecimal or base 32) against the bytes; unknown algorithms pass."""
    algorithm, colon, value = (named or "").partition(":")
    name = algorithm.lower().replace("sha-", "sha")
    if not colon or name not in ("md5", "sha1", "sha224", "sha256", "sha384", "sha512"):
        return
    found = hashlib.new(name, body, usedforsecurity=False).digest()
    try:
        given = bytes.fromhex(value) if len(value) == 2 * len(found) else base64.b32decode(value.upper() + "=" * (-len(value) % 8))
    except (ValueError, binascii.Error) as e:
        raise WarcError(f"no digest: {value[:80]!r}") from e
    if given != found:
        raise WarcError(f"{what} and digest differ")


def http_payload(h: dict[str, str], body: bytes) -> tuple[bytes, bool]:
    """What an HTTP message carries, and whether it stands as it was digested; other bodies as they are."""
    if not h.get("content-type", "").lower().startswith("application/http"):
        return body, True
    head, _, rest = body.partition(b"\r\n\r\n")
    return rest, b"\r\ntransfer-encoding:" not in head.lower()


def read_record(data: bytes) -> dict:
    """The row of one record; digest and length are those of the payload, which a revisit leaves out."""
    h, body = parse(data)
    kind = h["warc-type"]
    check_digest(h.get("warc-block-digest"), body, "block")
    payload, plain = http_payload(h, body)
    length, named = h.get("x-payload-length"), h.get("warc-payload-digest")
    length = None if length is None else count_of(length, "payload length")
    if kind == "revisit":
        if "warc-refers-to" not in h and "warc-refers-to-target-uri" not in h and named is None:
            raise WarcError("a revisit of nothing")
    else:
        if plain and "warc-segment-number" not in h:
            check_digest(named, payload, "payload")
        if length is not None and length != len(payload):
            raise WarcError("payload and length differ")
    url = h.get("warc-target-uri", "")
    ours = h["warc-record-id"].startswith("<urn:page:")
    if ours:
        url = url.replace("%0D", "\r").replace("%0A", "\n").replace("%25", "%")
    return {
        "page_id": page_of(h["warc-record-id"]) if ours else None,
        "url": url,
        "payload": None if kind == "revisit" else payload,
        "payload_bytes": length if length is not None else len(payload),
        "payload_digest": (named or "").removeprefix("sha256:") or (None if kind == "revisit" else hashlib.sha256(payload).hexdigest()),
        "record_type": kind,
        "refers_to": page_of(h.get("warc-refers-to")) if ours else None,
        "record_id": h["warc-record-id"],
        "refers_to_id": h.get("warc-refers-to"),
    }


RECORDS = (
    "page_id bigint, url string, payload binary, payload_bytes bigint, payload_digest string, record_type string, "
    "refers_to bigint, record_id string, refers_to_id string"
)


def records_of(stream, keep_broken: bool) -> Iterator[tuple[dict, int]]:
    """Rows of an archive's records, with their bytes; a broken one is an error, or a row that names it."""
    found = frames(stream)
    while True:
        try:
            data = next(found, None)
        except WarcError as e:  # what follows cannot be found
            if not keep_broken:
                raise
            yield {"error": str(e)}, 0
            return
        if data is None:
            return
        try:
            row = read_record(data)
        except WarcError as e:
            if not keep_broken:
                raise
            row = {"error": str(e)}
        yield row, len(data)


def read_archives(archives: DataFrame, with_payload: bool = True, keep_broken: bool = False) -> DataFrame:
    """One row per record of the listed archives (column path).

    A broken record or archive is an error; with keep_broken it is a row of nulls but for
    its path and what is wrong (columns path and error), and the records after it are
    read, unless the archive itself ends there.
    """
    n = archives.count()
    schema = RECORDS if with_payload else RECORDS.replace("payload binary, ", "")
    schema += ", path string, error string" if keep_broken else ""
    fields = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = {"page_id": pa.int64(), "payload": pa.binary(), "payload_bytes": pa.int64(), "refers_to": pa.int64()}
        form = pa.schema([(f, types.get(f, pa.string())) for f in fields])
        for batch in batches:
            for path in batch.column("path").to_pylist():
                fs, local = filesystem(path)
                rows, held = [], 0
                with fs.open_input_stream(local, compression=None) as stream:
                    for row, size in records_of(stream, keep_broken):
                        row = row | {"path": path}
                        rows.append({f: row.get(f) for f in fields})
                        held += size
                        if len(rows) >= 1000 or held > 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, form)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, form)

    return in_text_batches(archives.select("path").repartition(max(1, n)), run, schema)


def warc_report(pages: DataFrame) -> DataFrame:
    """Writes archives of pages, reads them back, one row per record."""
    return read_archives(write_archives(pages), with_payload=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"
    )
