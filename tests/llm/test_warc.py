import hashlib
import io
import struct

import pytest
import zstandard

from shelfmerge.llm import warc

SCHEMA = "page_id bigint, url string, html string"


def archive(*records, dictionary=b"some words for a dictionary"):
    z = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))
    return warc.skippable(dictionary) + b"".join(z.compress(r) for r in records)


def rec(payload=b"body", **change):
    args = {"page_id": 1, "url": "http://h/\r\nx%", "payload": payload, "digest": hashlib.sha256(payload).hexdigest(), "first": None, "role": "response"}
    return warc.record(**(args | change))


def foreign(kind, body, *more):
    head = ["WARC/1.0", f"WARC-Type: {kind}", "WARC-Record-ID: <urn:uuid:92283950-ef2f-4d72-b224-f54c6ec90bb0>", "WARC-Date: 2016-01-11T23:29:14Z", *more]
    return "\r\n".join([*head, f"Content-Length: {len(body)}"]).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def test_records_of_others(spark, tmp_path):
    import base64

    page = b"<html>x</html>"
    sha1 = base64.b32encode(hashlib.sha1(page).digest()).decode()
    http = "Content-Type: application/http; msgtype=response"
    message = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n" + page
    records = [
        foreign("warcinfo", b"software: any\r\n", "Content-Type: application/warc-fields"),
        foreign("request", b"GET / HTTP/1.1\r\n\r\n", "WARC-Concurrent-To: <urn:a>", "WARC-Concurrent-To: <urn:b>"),
        foreign("response", message, http, f"WARC-Payload-Digest: sha1:{sha1}", "WARC-Target-URI: http://h/%25", f"WARC-Block-Digest: md5:{hashlib.md5(message).hexdigest()}"),
        foreign("response", message.replace(b"\r\n\r\n", b"\r\nTransfer-Encoding: chunked\r\n\r\n") + b"0", http, f"WARC-Payload-Digest: sha1:{sha1}"),
        foreign("revisit", b"HTTP/1.1 200 OK\r\n\r\n", http, f"WARC-Payload-Digest: blake3:{sha1}", "WARC-Refers-To: <urn:uuid:1>"),
        foreign("metadata", b"k: v"), foreign("other", b""),
    ]
    words = b"WARC/1.0 WARC-Type: response " * 9
    packed = zstandard.ZstdCompressor().compress(words)
    z = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(words))
    (tmp_path / "a.warc.zst").write_bytes(warc.skippable(packed) + b"".join(z.compress(r) for r in records))
    listed = spark.createDataFrame([(f"file://{tmp_path}/a.warc.zst",)], "path string")
    rows = warc.read_archives(listed).collect()
    assert [r.record_type for r in rows] == ["warcinfo", "request", "response", "response", "revisit", "metadata", "other"]
    assert rows[2].payload == page and rows[2].payload_digest == f"sha1:{sha1}" and rows[2].url == "http://h/%25"
    assert rows[4].payload is None and rows[4].refers_to_id == "<urn:uuid:1>" and rows[4].refers_to is None
    assert rows[5].payload_digest == hashlib.sha256(b"k: v").hexdigest()
    assert all(r.page_id is None and r.record_id.startswith("<urn:uuid:9") for r in rows)


def test_reading_back():
    frames = list(warc.frames(io.BytesIO(archive(rec(), rec(b""), rec(b"x" * 3_000_000), rec(role="revisit", first=9)))))
    rows = [warc.read_record(f) for f in frames]
    assert [r["payload_bytes"] for r in rows] == [4, 0, 3_000_000, 4]
    assert rows[0]["url"] == "http://h/\r\nx%" and rows[0]["payload"] == b"body"
    assert rows[3]["record_type"] == "revisit" and rows[3]["refers_to"] == 9 and rows[3]["payload"] is None


@pytest.mark.parametrize(
    "data",
    [
        b"", b"1234", archive(rec())[:-3], b"\x28\xb5\x2f\xfd" + b"0" * 20, struct.pack("<II", warc.MAGIC, 99) + b"short",
        archive(rec()) + b"junk junk junk", archive(rec(), dictionary=b"d" * 40)[:30] + b"\0" * 30,
    ],
)
def test_broken_archives(data):
    with pytest.raises(warc.WarcError):
        list(warc.frames(io.BytesIO(data)))


@pytest.mark.parametrize(
    "data",
    [
        b"no headers", rec().replace(b"WARC/1.1", b"HTTP/1.1"), rec() + b"more", rec()[:-5], rec().replace(b"body", b"bodY"),
        rec().replace(b"Content-Length: 4", b"Content-Length: x"), rec().replace(b"WARC-Date", b"WARC-Day"),
        rec().replace(b"Content-Length: 4", b"Content-Length: 9\r\nContent-Length: 4"), rec().replace(b"WARC-Date:", b"WARC-Date"),
        rec().replace(b"Content-Length: 4", "Content-Length: ٤".encode()), rec().replace(b"sha256:", b"sha256:zz"),
        rec().replace(b"X-Payload-Length: 4", b"X-Payload-Length: -"), foreign("revisit", b""),
        foreign("response", b"body", "WARC-Payload-Digest: sha1:3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ"),
        rec().replace(b"X-Payload-Length: 4", b"X-Payload-Length: 5"),
    ],
)
def test_broken_records(data):
    with pytest.raises(warc.WarcError):
        warc.read_record(data)


def skippable(n, nibble=3):
    return struct.pack("<II", 0x184D2A50 + nibble, n) + b"\x28" * n


def test_foreign_bytes_folded_lines_and_padding():
    odd = rec().replace(b"WARC-Date", b"X-Note: caf\xe9\r\n  and\r\n\tmore\r\nWARC-Date")
    assert warc.read_record(odd)["payload"] == b"body" and warc.parse(odd)[0]["x-note"] == "caf\ufffd and more"
    one = archive(rec())
    lead = 8 + struct.unpack("<I", one[4:8])[0]
    for n in (0, 5, warc.CHUNK - 8, warc.CHUNK + 3):
        padded = one[:lead] + skippable(n) + one[lead:] + skippable(n, 15) + skippable(1)
        assert list(warc.frames(io.BytesIO(padded))) == list(warc.frames(io.BytesIO(one)))
    with pytest.raises(warc.WarcError):
        list(warc.frames(io.BytesIO(one + skippable(9)[:-1])))
    for bad in (b"9" * 5000, b"1" * 19):
        with pytest.raises(warc.WarcError):
            warc.read_record(rec().replace(b"Content-Length: 4", b"Content-Length: " + bad))
    assert warc.page_of("<urn:page:" + "9" * 40 + ">") is None and warc.page_of(f"<urn:page:{2**63}>") is None
    assert warc.page_of(f"<urn:page:{-(2**63)}>") == -(2**63)


def test_broken_records_become_rows(spark, tmp_path):
    good, bad = rec(), rec().replace(b"body", b"bodY")
    files = {"a": archive(good, bad, good), "b": archive(good) + b"junk junk", "c": b"", "d": archive(good)}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    listed = spark.createDataFrame([(str(tmp_path / n),) for n in files], "path string")
    rows = warc.read_archives(listed, keep_broken=True).collect()
    said = sorted((r.path[-1], r.error is None, r.payload and bytes(r.payload)) for r in rows)
    assert said == [("a", False, None), ("a", True, b"body"), ("a", True, b"body"), ("b", False, None), ("b", True, b"body"), ("c", False, None), ("d", True, b"body")]
    with pytest.raises(Exception, match="WarcError"):
        warc.read_archives(listed).collect()


def slow(rows):
    first = {}
    for p, _, h in rows:
        b = (h or "").encode()
        if len(b) >= 100 and p is not None:
            first[b] = min(first.get(b, p), p)
    out = []
    for p, _, h in rows:
        b = (h or "").encode()
        f = first.get(b)
        again = f is not None and f != p and sum(1 for _, _, x in rows if (x or "").encode() == b) > 1
        out.append((p, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", f if again else None))
    return out


def check(spark, rows):
    df = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA + ", digest int").repartition(3)
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.warc_report(df).collect()]
    assert sorted(got, key=str) == sorted(slow(rows), key=str)


def test_odd_pages(spark):
    big = "é" * 200
    check(spark, [(3, "u", big), (1, None, big), (2, "v\nw", big), (4, "a", "short"), (5, "b", "short"), (6, "c", None), (7, "d", ""), (8, "e", "x" * 99), (9, "f", "x" * 99), (None, "g", big), (1, None, big), (10, "h", "y" * 5_000_000)])
    check(spark, [])


def test_many_archives(spark, sf, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 20_000)
    df = spark.read.parquet(f"{sf}/pages.parquet")
    listed = warc.write_archives(df)
    assert listed.count() > 1
    with open(listed.first().path.removeprefix("file:"), "rb") as f:
        assert f.read(4) == struct.pack("<I", warc.MAGIC)  # the file itself begins with the dictionary
    back = warc.read_archives(listed).join(df.select("page_id", "html"), "page_id")
    assert back.count() == df.count()
    assert back.filter("record_type = 'response' and cast(payload as string) <> html").count() == 0


def test_whole_table(spark, sf):
    check(spark, [tuple(r) for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html").collect()])
