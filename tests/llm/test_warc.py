import hashlib

import pytest
import zstandard

from quaestor.llm import warc

BIG = "<p>payload</p>" * 100


def frame(record, **options):
    return zstandard.ZstdCompressor(write_checksum=True, **options).compress(record)


def record(payload=b"abc", page=1, refers_to=None):
    return warc.encode_record(page, "http://h/ü?a b", payload, hashlib.sha1(payload).hexdigest(), refers_to)


def test_pages_round_trip(spark):
    rows = [(1, "http://a/ö x", BIG), (2, "http://b", BIG), (3, None, None), (4, "http://c", ""), (5, "u", "small"), (6, "u", "small"),
            (7, "http://d", BIG + "x"), (7, "http://d", BIG + "x"), (8, "r\r\nWARC-Type: revisit", "é\r\n\r\n" * 300), (None, "n", BIG)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS digest", "'x' AS size")
    out = warc.archive(pages).collect()
    assert len(out) == len(rows) and all(r.problem is None for r in out)
    kinds = {(r.page_id, r.record_type, r.refers_to) for r in out}
    assert ("1", "revisit", "2") in kinds and ("2", "response", None) in kinds
    assert ("5", "response", None) in kinds and ("6", "response", None) in kinds
    assert [r.record_type for r in out if r.page_id == "7"] == ["response", "response"]
    digests = {hashlib.sha1((h or "").encode()).hexdigest() for _, _, h in rows}
    assert {r.payload_digest for r in out} == digests
    assert {r.url for r in out if r.page_id == "1"} == {"http://a/ö x"}
    assert warc.archive(pages.limit(0)).collect() == []


def test_dictionary_frames_decode():
    samples = [(f"<html>{i} common words of every page " * 30).encode() for i in range(500)]
    raw = zstandard.train_dictionary(4096, samples).as_bytes()
    known = zstandard.ZstdCompressionDict(raw)
    for lead in (warc.dictionary_frame(raw), warc.dictionary_frame(zstandard.ZstdCompressor().compress(raw))):
        content = lead + frame(record(samples[0]), dict_data=known) + frame(record(b""), dict_data=known)
        back = [warc.decode_record(r) for r in warc.records(content)]
        assert [b["payload"] for b in back] == [samples[0], b""]


@pytest.mark.parametrize("size", [0, 1, 300, 70_000, 3_000_000])
def test_frame_end(size):
    data = frame(b"x" * size) + frame(bytes(range(256)) * (size // 256))
    first = len(frame(b"x" * size))
    assert warc.frame_end(memoryview(data), 0) == first and warc.frame_end(memoryview(data), first) == len(data)


def test_damage_is_named():
    good = record()
    with pytest.raises(warc.Damaged, match="cut off"):
        list(warc.records(frame(good)[:-3]))
    with pytest.raises(warc.Damaged, match="no frame"):
        list(warc.records(b"nothing of the kind"))
    broken = bytearray(frame(good))
    broken[-1] ^= 1
    with pytest.raises(warc.Damaged, match="decode"):
        list(warc.records(bytes(broken)))
    for change in ((b"WARC/1.1", b"WARC/9"), (b"abc", b"abd"), (b"X-Payload-Length: 3", b"X-Payload-Length: 4"), (b"WARC-Date", b"Date"),
                   (b"Type: response", b"Type: revisit")):
        with pytest.raises(warc.Damaged):
            warc.decode_record(good.replace(*change, 1))
    with pytest.raises(warc.Damaged, match="length"):
        warc.decode_record(good + b"x")


def test_records_before_the_damage_are_kept(spark, tmp_path):
    path = tmp_path / "a.warc.zst"
    path.write_bytes(frame(record(page=1)) + frame(b"no record") + frame(record(page=2)) + b"tail")
    rows = warc.read(spark, [str(path)]).collect()
    assert [r.page_id for r in rows] == ["1", None, "2", None]
    assert [r.problem is None for r in rows] == [True, False, True, False]
    assert bytes(rows[0].payload) == b"abc"


def plain(kind, block, *headers):
    head = ["WARC/1.0", f"WARC-Type: {kind}", "WARC-Record-ID: <urn:uuid:1-2>", "WARC-Date: 2020-01-01T00:00:00Z", f"Content-Length: {len(block)}", *headers]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def test_archives_of_other_writers(spark, tmp_path):
    """No content sizes, all record types, headers that fold or repeat, digests in hex or of other kinds."""
    http = "Content-Type: application/http; msgtype=response"
    hexed = hashlib.sha1(b"body").hexdigest()
    ok = b"HTTP/1.1 200 OK\r\nA: b\r\n\r\nbody"
    given = [
        (plain("warcinfo", b"software: x\r\n", "Content-Type: application/warc-fields"), b"software: x\r\n"),
        (plain("request", b"GET / HTTP/1.1\r\nHost: h\r\n\r\n", "Content-Type: application/http; msgtype=request"), b""),
        (plain("response", ok, http, f"WARC-Payload-Digest: sha1:{hexed}", "WARC-Concurrent-To: <a>", "WARC-Concurrent-To: <b>"), b"body"),
        (plain("response", ok, "Content-Type: application/http;", " msgtype=response", "WARC-Payload-Digest: md5:00"), b"body"),
        (plain("response", b"1 2 3", "Content-Type: text/dns"), b"1 2 3"),
        (plain("metadata", b""), b""),
        (plain("resource", b"x" * 3_000_000, "WARC-Target-URI: file:///a%20b"), b"x" * 3_000_000),
        (plain("revisit", b"", http, "WARC-Refers-To: <urn:uuid:9>"), None),
        (plain("revisit", b"HTTP/1.1 304 Not Modified\r\n\r\n", http, "WARC-Refers-To-Target-URI: http://h/"), None),
        (plain("continuation", b"end", "WARC-Segment-Number: 2", "WARC-Payload-Digest: sha1:" + "0" * 40), b"end"),
    ]
    streamed = b""
    for r, _ in given:
        writer = zstandard.ZstdCompressor(write_content_size=False).compressobj()
        streamed += writer.compress(r) + writer.flush()
    (tmp_path / "other.warc.zst").write_bytes(streamed)
    rows = warc.read(spark, [str(tmp_path)]).collect()
    assert [r.problem for r in rows] == [None] * len(given)
    assert [r.payload and bytes(r.payload) for r in rows] == [p or (b"" if p is not None else None) for _, p in given]
    assert rows[0].page_id == "urn:uuid:1-2" and rows[6].url == "file:///a b" and rows[7].refers_to == "urn:uuid:9"
    assert rows[2].payload_digest == rows[3].payload_digest == hexed and rows[2].payload_bytes == 4
    for bad in (plain("response", ok, http, "WARC-Block-Digest: sha1:" + "0" * 40), plain("response", ok, http, "WARC-Payload-Digest: sha1:?"),
                plain("response", b"no header", http), plain("revisit", b"", http), plain("metadata", b"x", "no colon")):
        with pytest.raises(warc.Damaged):
            warc.decode_record(bad)


def test_own_archives_must_be_whole(spark, tmp_path):
    pages = spark.createDataFrame([(i, "http://h", BIG + str(i)) for i in range(20)], "page_id long, url string, html string")
    manifest = warc.stored(warc.write(warc.plan(pages), f"file://{tmp_path}"), "manifest")
    assert warc.read_manifest(manifest, f"file://{tmp_path}").count() == 20
    with pytest.raises(Exception, match="records, not"):
        warc.read_manifest(manifest.selectExpr("path", "n_records + 1 AS n_records"), f"file://{tmp_path}").count()
    archive = next(tmp_path.glob("*.zst"))
    archive.write_bytes(archive.read_bytes()[:-1])
    with pytest.raises(Exception, match="cut off"):
        warc.read_manifest(manifest, f"file://{tmp_path}").count()
