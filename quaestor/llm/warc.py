"""WARC archives under Zstandard: write, then read back with validation.

An archive is a leading skippable frame with the compression dictionary, then one frame per
record. Tasks write their archives themselves into a shared folder, under names no other
attempt uses, and return a manifest row for each; only archives in the manifest are read, so
a task that ran twice or was lost leaves no trace. Archives are cut by size, which bounds what
one reading task holds (a single larger record has its own archive).

Defined cases: a null payload is empty; a null or odd url is stored percent-encoded; rows
repeated under one page_id are written once each, and all of them are responses where theirs
is the largest page_id of the payload; a null page_id is never referred to; an empty table
gives no archive. `read` takes archives of any writer and all record types; what is damaged gives
rows whose `problem` says what is wrong, and the records before the damage are kept. In own
archives (`archive`, `read_manifest`) damage is an error.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import urllib.parse
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaestor.llm.arrays import BATCH_BYTES, tuned
from quaestor.llm.graph import stored
from quaestor.session import scratch_path

# fixed values of the format
SKIPPABLE_MAGIC = 0x184D2A5D
FRAME_MAGIC = 0xFD2FB528
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

ARCHIVE_BYTES = 8 << 20
REVISIT_FROM = 1_000  # payloads of fewer bytes are always stored
DICTIONARY_BYTES = 64 << 10
SAMPLE_ROWS = 1_000  # bound of the sample that the dictionary is trained on
SAMPLE_BYTES = 16 << 10  # of each sampled payload
LEVEL = 3
ARCHIVES_PER_TASK = 16
REQUIRED = ("warc-type", "warc-record-id", "warc-date", "content-length")


# --- roles of the records -------------------------------------------------------------------


def plan(pages: DataFrame) -> DataFrame:
    """Pages (`page_id`, `url`, `html`) with `digest`, `size` and `refers_to`, which is null for
    responses. Only digests and ids are grouped, never payloads."""
    payload = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", "html", F.sha1(payload).alias("digest"), F.length(payload).alias("size"))
    last = (
        rows.where(F.col("size") >= REVISIT_FROM)
        .groupBy("digest", "size")
        .agg(F.max("page_id").alias("last"), F.count("*").alias("n"))
        .where("n > 1")
        .select("digest", "size", "last")
    )
    small = rows.select("page_id", "digest", "size").join(last, ["digest", "size"])
    # one row per page that revisits another; a unique page never takes part
    revisits = small.where("page_id < last").select("page_id", "digest", F.col("last").alias("refers_to")).distinct()
    return rows.join(revisits, ["page_id", "digest"], "left")


# --- writing --------------------------------------------------------------------------------


def train_dictionary(pages: DataFrame, rows: int = SAMPLE_ROWS) -> bytes:
    """A dictionary from at most about `rows` payloads drawn by a hash of the id; empty where
    there is too little to learn from."""
    total = pages.count()
    share = int(min(1.0, rows / max(total, 1)) * 1_000_000)
    drawn = pages.where(F.pmod(F.xxhash64("page_id"), F.lit(1_000_000)) < share)
    sample = [r[0].encode() for r in drawn.select(F.substring("html", 1, SAMPLE_BYTES)).collect() if r[0]]
    if len(sample) < 16 or sum(map(len, sample)) < 8 * DICTIONARY_BYTES:
        return b""
    return zstandard.train_dictionary(DICTIONARY_BYTES, sorted(sample)).as_bytes()


def urn(page_id) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}>"


def encode_record(page_id, url: str | None, payload: bytes, digest: str, refers_to) -> bytes:
    """One uncompressed record; a revisit has the response's header but not its payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {urn(page_id)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {urllib.parse.quote(url or '', safe=':/?#[]@!$&()*+,;=%~')}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        f"X-Payload-Length: {len(payload)}",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: {urn(refers_to)}", f"WARC-Profile: {REVISIT_PROFILE}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def dictionary_frame(dictionary: bytes) -> bytes:
    return struct.pack("<II", SKIPPABLE_MAGIC, len(dictionary)) + dictionary if dictionary else b""


def write(planned: DataFrame, folder: str, dictionary: bytes = b"") -> DataFrame:
    """Write the archives into `folder` and return the manifest (`path`, `n_records`), lazily."""
    lead = dictionary_frame(dictionary)

    def run(batches):
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        known = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_checksum=True, write_content_size=True)
        frames: list[bytes] = []
        size = 0

        def close():
            path = f"{base}/{uuid.uuid4().hex}.warc.zst"
            with store.open_output_stream(path, compression=None) as out:
                out.write(lead)
                for f in frames:
                    out.write(f)
            row = pa.record_batch([pa.array([path.rsplit("/", 1)[1]]), pa.array([len(frames)], pa.int64())], names=["path", "n_records"])
            frames.clear()
            return row

        for batch in batches:
            for page_id, url, html, digest, refers_to in zip(*(batch.column(i).to_pylist() for i in range(5))):
                frame = packer.compress(encode_record(page_id, url, (html or "").encode(), digest, refers_to))
                if frames and size + len(frame) > ARCHIVE_BYTES:
                    yield close()
                    size = 0
                frames.append(frame)
                size += len(frame)
        if frames:
            yield close()

    rows = tuned(planned).select("page_id", "url", "html", "digest", "refers_to")
    return rows.mapInArrow(run, "path string, n_records long")


# --- reading --------------------------------------------------------------------------------


class Damaged(ValueError):
    """An archive or record that breaks the format."""


def frame_end(data: memoryview, at: int) -> int:
    """Where the Zstandard frame that begins at `at` ends, from its block headers."""
    try:
        (magic,) = struct.unpack_from("<I", data, at)
        if magic != FRAME_MAGIC:
            raise Damaged(f"no frame at byte {at}")
        flags = data[at + 4]
        single, checksum = flags >> 5 & 1, flags >> 2 & 1
        content_size = (single, 2, 4, 8)[flags >> 6]
        end = at + 5 + (1 - single) + (0, 1, 2, 4)[flags & 3] + content_size
        while True:
            header = int.from_bytes(data[end : end + 3], "little")
            if end + 3 > len(data):
                raise Damaged("a frame is cut off")
            end += 3 + (1 if header >> 1 & 3 == 1 else header >> 3)
            if header & 1:
                break
    except (IndexError, struct.error):
        raise Damaged("a frame is cut off") from None
    end += 4 * checksum
    if end > len(data):
        raise Damaged("a frame is cut off")
    return end


def records(content: bytes) -> Iterator[bytes]:
    """The decoded records of an archive, one per frame; the dictionary is loaded from the
    leading skippable frame."""
    data, at, known = memoryview(content), 0, None
    if len(data) >= 8 and struct.unpack_from("<I", data)[0] == SKIPPABLE_MAGIC:
        at = 8 + struct.unpack_from("<I", data, 4)[0]
        if at > len(data):
            raise Damaged("the dictionary is cut off")
        raw = bytes(data[8:at])
        if raw[:4] == struct.pack("<I", FRAME_MAGIC):  # the dictionary may be compressed itself
            raw = zstandard.ZstdDecompressor().decompress(raw)
        known = zstandard.ZstdCompressionDict(raw)
    unpacker = zstandard.ZstdDecompressor(dict_data=known) if known else zstandard.ZstdDecompressor()
    while at < len(data):
        end = frame_end(data, at)
        try:
            # streaming writers leave out the content's size
            frame = unpacker.decompressobj()
            record = frame.decompress(data[at:end])
        except zstandard.ZstdError as e:
            raise Damaged(f"a frame does not decode: {e}") from None
        if not frame.eof:
            raise Damaged("a frame is cut off")
        yield record
        at = end


def _sha1(label: str) -> str | None:
    """Lower-case hex of a SHA-1 label in base 32 or 16; None for other algorithms."""
    algorithm, _, value = label.partition(":")
    if algorithm.lower() != "sha1":
        return None
    try:
        return (bytes.fromhex(value) if len(value) == 40 else base64.b32decode(value.upper())).hex()
    except ValueError:
        raise Damaged("a digest does not parse") from None


def _identifier(uri: str) -> str:
    return uri.removeprefix("<").removesuffix(">").removeprefix("urn:x-page:")


def _headers(head: bytes) -> dict[str, str]:
    """Names in lower case; a line that begins with white space continues the one before."""
    fields: dict[str, str] = {}
    name = None
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and name:
            fields[name] += " " + line.strip()
            continue
        name, colon, value = line.partition(":")
        if not colon:
            raise Damaged("a header does not parse")
        name = name.strip().lower()
        fields[name] = value.strip()
    return fields


def decode_record(record: bytes) -> dict:
    """Headers, lengths and digests checked against each other. The payload is what follows the HTTP
    header in responses, requests and revisits that have one, and the whole block in all others.
    A digest that is not given is computed; that and the size of a revisit's payload are null
    unless the record names them. Digests of other algorithms than SHA-1 are not checked."""
    head, gap, rest = record.partition(b"\r\n\r\n")
    if not gap or head.partition(b"\r\n")[0] not in (b"WARC/1.0", b"WARC/1.1"):
        raise Damaged("no WARC header")
    fields = _headers(head)
    if missing := [f for f in REQUIRED if f not in fields]:
        raise Damaged(f"header {missing[0]} is missing")
    try:
        length = int(fields["content-length"])
        size = int(fields["x-payload-length"]) if "x-payload-length" in fields else None
    except ValueError:
        raise Damaged("a header does not parse") from None
    if length < 0 or len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise Damaged("the record's length differs from its header")
    kind, block = fields["warc-type"].lower(), rest[:length]
    payload = block
    if fields.get("content-type", "").lower().startswith("application/http") and (block or kind != "revisit"):
        http, gap, payload = block.partition(b"\r\n\r\n")
        if not gap or kind != "request" and not http.startswith(b"HTTP/"):
            raise Damaged("no HTTP header")
    whole = _sha1(fields.get("warc-block-digest", ""))
    if whole and hashlib.sha1(block).hexdigest() != whole:
        raise Damaged("the block differs from its digest")
    digest = _sha1(fields.get("warc-payload-digest", ""))
    refers_to = fields.get("warc-refers-to")
    if kind == "revisit":
        if payload or refers_to is None and "warc-refers-to-target-uri" not in fields:
            raise Damaged("a revisit with a payload, or of nothing")
    elif "warc-segment-number" not in fields:  # a segment's digest and size are those of the whole
        found = hashlib.sha1(payload).hexdigest()
        if size is not None and len(payload) != size or digest is not None and found != digest:
            raise Damaged("the payload differs from its digest or length")
        size, digest = len(payload), found
    return {
        "page_id": _identifier(fields["warc-record-id"]),
        "url": urllib.parse.unquote(fields.get("warc-target-uri", "")),
        "payload_bytes": size,
        "payload_digest": digest,
        "record_type": kind,
        "refers_to": _identifier(refers_to) if refers_to else None,
        "payload": payload if kind != "revisit" else None,
    }


FIELDS = ("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload", "problem")


TYPES = (pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary(), pa.string())
SCHEMA = (
    "page_id string, url string, payload_bytes long, payload_digest string, record_type string, "
    "refers_to string, payload binary, problem string"
)


def _rows(content: bytes) -> Iterator[dict]:
    """Records and, with their `problem`, what is damaged. Nothing is found after a broken frame."""
    try:
        for record in records(content):
            try:
                yield decode_record(record) | {"problem": None}
            except Damaged as e:
                yield {"problem": str(e)}
    except Damaged as e:
        yield {"problem": str(e)}


def _batches(rows: Iterator[dict], payloads: bool) -> Iterator[pa.RecordBatch]:
    """Batches of bounded bytes; a larger record is alone."""
    some, size = [], 0

    def close():
        batch = pa.record_batch([pa.array([r.get(f) for r in some], t) for f, t in zip(FIELDS, TYPES)], names=list(FIELDS))
        some.clear()
        return batch

    for row in rows:
        row = row if payloads else row | {"payload": None}
        some.append(row)
        size += len(row.get("payload") or b"") + 500
        if size > BATCH_BYTES:
            yield close()
            size = 0
    if some:
        yield close()


def read(spark: SparkSession, paths: list[str], payloads: bool = True) -> DataFrame:
    """Records of the given archives or folders, one row each: ids as strings, the payload (null for
    revisits or with `payloads=False`), and `problem`, null for a valid record. Archives of other
    writers may hold any record type; see `decode_record`."""

    def run(batches):
        for batch in batches:
            for content in batch.column("content"):
                yield from _batches(_rows(content.as_py()), payloads)

    if not paths:
        return spark.createDataFrame([], SCHEMA)
    # archives are whole rows: one or two to a batch
    files = spark.read.format("binaryFile").load(paths).select("content")
    return tuned(files).mapInArrow(run, SCHEMA)


def read_manifest(manifest: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """Records of the archives that a stored manifest (`path`, `n_records`) names. Tasks open them, so
    the driver knows no names; a damaged record, or an archive of another number, is an error."""
    spark = manifest.sparkSession

    def checked(name: str, content: bytes, want: int) -> Iterator[dict]:
        n = 0
        for row in _rows(content):
            if row["problem"] is not None:
                raise Damaged(f"{name}, record {n}: {row['problem']}")
            n += 1
            yield row
        if n != want:
            raise Damaged(f"{name} has {n} records, not {want}")

    def run(batches):
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, want in zip(batch.column("path").to_pylist(), batch.column("n_records").to_pylist()):
                with store.open_input_stream(f"{base}/{name}", compression=None) as archived:
                    content = archived.read()
                yield from _batches(checked(name, content, want), payloads)

    n = manifest.count()
    tasks = max(1, min(n, max(spark.sparkContext.defaultParallelism, n // ARCHIVES_PER_TASK)))
    return tuned(manifest.select("path", "n_records").repartition(tasks)).mapInArrow(run, SCHEMA)


def archive(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write every page to archives in `folder` (a fresh shared one by default) and read them
    back."""
    folder = folder or scratch_path(pages.sparkSession, "warc")
    dictionary = train_dictionary(pages)
    manifest = stored(write(plan(pages), folder, dictionary), "manifest")
    return read_manifest(manifest, folder, payloads=False)
