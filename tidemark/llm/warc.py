"""WARC archives compressed record by record with a Zstandard dictionary of their own.

An archive begins with a skippable frame that holds its dictionary, built from a sample of its records and compressed
itself; then each record is a frame, so that any of them can be read alone. Tasks write archives into a shared folder
under names of their own attempt and return a row for each; the stored rows are the manifest, and an archive that no
manifest lists (of a task that was repeated) is never read. A payload that an earlier record holds isn't written
again: its record is a revisit that names the earlier one.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import discard, read, shared_dir, sized, slices, stored
from tidemark.llm.compaction import Folder

#: Payload of an archive, a longer one alone; payloads below LEAST_BYTES are always written whole.
ARCHIVE_BYTES, LEAST_BYTES, LEVEL = 32 << 20, 100, 3
#: Of the dictionary, and of the evenly spaced records that it is built from.
DICTIONARY_BYTES, SAMPLE_BYTES = 64 << 10, 4 << 20
# Fixed values of the formats: magic numbers of the dictionary's skippable frame and of a frame, the profile of a revisit.
SKIPPABLE, FRAME = 0x184D2A5D, b"\x28\xb5\x2f\xfd"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
_READ = 1 << 20
_STEP = 8 << 10


def _line(value: str) -> str:
    """A header's value without what would end its line."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def record(kind: str, fields: dict[str, str], block: bytes) -> bytes:
    head = {"WARC-Type": kind, "WARC-Date": DATE, **fields, "Content-Length": str(len(block))}
    return ("WARC/1.1\r\n" + "".join(f"{k}: {_line(v)}\r\n" for k, v in head.items()) + "\r\n").encode() + block + b"\r\n\r\n"


def page_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A response with its payload or, where refers_to is given, a revisit without it."""
    fields = {"WARC-Record-ID": f"<urn:page:{'' if page_id is None else page_id}>", "WARC-Payload-Digest": f"sha256:{digest}", "Content-Type": "application/http; msgtype=response"}
    if url is not None:
        fields["WARC-Target-URI"] = url
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if refers_to is None:
        return record("response", fields, http + payload)
    return record("revisit", fields | {"WARC-Profile": PROFILE, "WARC-Refers-To": f"<urn:page:{refers_to}>"}, http)


def headers(raw: bytes) -> dict[str, str]:
    return dict(line.split(": ", 1) for line in raw.decode().split("\r\n")[1:])


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """(headers, block) of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = headers(head)
    n = int(fields["Content-Length"])
    if not raw.startswith(b"WARC/1.") or rest[n:] != b"\r\n\r\n":
        raise ValueError("not a whole WARC record")
    return fields, rest[:n]


def dictionary(records: list[bytes]) -> zstandard.ZstdCompressionDict | None:
    """A dictionary from evenly spaced records of at most SAMPLE_BYTES together; None if these are too few for one."""
    step = max(1, -(-sum(map(len, records)) // SAMPLE_BYTES))
    sample = [r for r in records[::step] if len(r) <= SAMPLE_BYTES // 16]
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, sum(map(len, sample)) // 8), sample) if len(sample) >= 8 else None
    except zstandard.ZstdError:
        return None  # the records have too little in common, or are too short


def write(out, records: list[bytes]) -> int:
    """Writes records as one archive; returns the bytes of its dictionary, 0 without one."""
    found = dictionary(records)
    if found:
        held = zstandard.ZstdCompressor(level=LEVEL).compress(found.as_bytes())
        out.write(struct.pack("<II", SKIPPABLE, len(held)) + held)
    packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=found, write_checksum=True)
    for r in records:
        out.write(packer.compress(r))
    return len(found.as_bytes()) if found else 0


def frames(stream) -> Iterator[bytes]:
    """The records of an archive, read bit by bit: memory holds one record whatever the archive's size."""
    buf = stream.read(_READ)
    found = None
    if buf[:4] == struct.pack("<I", SKIPPABLE):
        size = struct.unpack("<I", buf[4:8])[0]
        while len(buf) < size + 8 and (more := stream.read(_READ)):
            buf += more
        held, buf = buf[8 : size + 8], buf[size + 8 :]
        found = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(held) if held[:4] == FRAME else held)
    unpacker, at = zstandard.ZstdDecompressor(dict_data=found), 0
    while True:
        if at == len(buf):
            buf, at = stream.read(_READ), 0
            if not buf:
                return
        one, parts = unpacker.decompressobj(), []
        while not one.eof:
            if at == len(buf):
                buf, at = stream.read(_READ), 0
                if not buf:
                    raise ValueError("the archive ends within a record")
            piece = buf[at : at + _STEP]
            parts.append(one.decompress(piece))
            at += len(piece) - len(one.unused_data)
        yield b"".join(parts)


def page_roles(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> tuple[DataFrame, DataFrame]:
    """((page_id, url, html, digest, refers_to), a stored table to discard after use).

    Of pages with equal payloads of at least least_bytes that with the smallest page_id has refers_to null, the others
    have that page_id. Repeated rows with the smallest page_id are all written whole; pages without a page_id refer to
    the smallest there is, and to none if all are without. Null html is an empty payload.

    Only digests meet, folded in each task first; payloads aren't shuffled unless digests with several pages outgrow
    a broadcast.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"), F.sha2(html, 256).alias("digest"))
    shared = pages.filter(F.octet_length("html") >= least_bytes).groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min("page_id").alias("first"))
    shared = stored(shared.filter("n > 1 AND first IS NOT NULL").select("digest", "first"))
    joined = pages.join(sized(shared), "digest", "left")
    return joined.select("page_id", "url", "html", "digest", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to")), shared


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes a record for each page and returns the manifest: (archive, records, payload_bytes, bytes, dictionary_bytes).

    folder is shared by driver and executors, of any file system that pyarrow opens by its address. Each archive begins
    with a warcinfo record. No pages, no archives.
    """
    schema = pa.schema([("archive", pa.string()), ("records", pa.int64()), ("payload_bytes", pa.int64()), ("bytes", pa.int64()), ("dictionary_bytes", pa.int64())])

    def run(batches):
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        for batch in slices(batches, "html", archive_bytes):
            name, total = f"{uuid.uuid4().hex}.warc.zst", 0
            records = [record("warcinfo", {"WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>", "WARC-Filename": name, "Content-Type": "application/warc-fields"}, b"format: WARC File Format 1.1\r\n")]
            for page_id, url, html, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                payload = html.encode()
                records.append(page_record(page_id, url, payload, digest, refers_to))
                total += len(payload)
            with store.open_output_stream(f"{root}/{name}.part", compression=None) as out:
                held = write(out, records)
            store.move(f"{root}/{name}.part", f"{root}/{name}")
            row = name, len(records), total, store.get_file_info(f"{root}/{name}").size, held
            yield pa.record_batch([pa.array([x], f.type) for x, f in zip(row, schema)], schema=schema)

    rows, shared = page_roles(pages)
    made = stored(rows.mapInArrow(run, "archive string, records long, payload_bytes long, bytes long, dictionary_bytes long"))
    discard(shared)
    return made


def read_archives(manifest: DataFrame, folder: str, payload: bool = True) -> DataFrame:
    """(page_id, url, record_type, payload_bytes, payload_digest, refers_to, archive, place, payload) of each page's record.

    payload is null for revisits, and for all if payload is not set; payload_bytes and payload_digest are those of the
    full payload in any case. A response whose payload differs from its digest or length raises ValueError.
    """
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("archive", pa.string()), ("place", pa.int64()), ("payload", pa.binary())])

    def rows(store, root, archive):
        named = lambda x: int(x[10:-1]) if x and x != "<urn:page:>" else None
        with store.open_input_stream(f"{root}/{archive}", compression=None) as stream:
            for place, raw in enumerate(frames(stream)):
                fields, block = parse(raw)
                if fields["WARC-Type"] == "warcinfo":
                    continue
                head, _, body = block.partition(b"\r\n\r\n")
                n, digest = int(headers(head)["Content-Length"]), fields["WARC-Payload-Digest"].removeprefix("sha256:")
                whole = fields["WARC-Type"] == "response"
                if whole and (len(body) != n or hashlib.sha256(body).hexdigest() != digest):
                    raise ValueError(f"record {place} of {archive} differs from its digest")
                yield named(fields["WARC-Record-ID"]), fields.get("WARC-Target-URI"), fields["WARC-Type"], n, digest, named(fields.get("WARC-Refers-To")), archive, place, body if whole and payload else None

    def run(batches):
        store, root = fs.FileSystem.from_uri(folder)
        batch_of = lambda some: pa.record_batch([pa.array(x, f.type) for x, f in zip(zip(*some), schema)], schema=schema)
        for batch in batches:
            for archive in batch.column(0).to_pylist():
                some, size = [], 0
                for row in rows(store, root, archive):
                    some.append(row)
                    size += len(row[-1] or b"") + 200
                    if size > _READ:
                        yield batch_of(some)
                        some, size = [], 0
                if some:
                    yield batch_of(some)

    names = manifest.select("archive").repartition(max(1, manifest.count()), "archive")
    return names.mapInArrow(run, "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, archive string, place long, payload binary")


def op12_warc_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = f"tidemark-{uuid.uuid4().hex}"
    folder = f"{shared_dir(spark)}/{name}"
    manifest = write_archives(read(spark, sf_dir, "pages"), folder)
    found = stored(read_archives(manifest, folder, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))
    discard(manifest)
    Folder(spark, shared_dir(spark)).delete(name)
    return found


OP12_SQL = """
WITH payloads AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
known AS (SELECT *, octet_length(encode(html)) AS n, min(page_id) OVER (PARTITION BY html) AS least FROM payloads)
SELECT page_id, n::BIGINT AS payload_bytes, sha256(html) AS payload_digest,
  CASE WHEN n >= 100 AND page_id IS DISTINCT FROM least AND least IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND page_id IS DISTINCT FROM least THEN least END AS refers_to
FROM known
"""
