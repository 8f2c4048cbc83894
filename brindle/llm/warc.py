"""WARC archives compressed record by record with a Zstandard dictionary.

Each task writes archives of its own rows: the first records are held until they reach `train_bytes`, a
dictionary is built from them, and the file begins with that dictionary in a skippable frame (magic
0x184D2A5D, the dictionary itself compressed), followed by one Zstandard frame a record. A file of too
few records to build a dictionary from starts with its first record. Of rows with equal payloads of
`revisit_bytes` or more one is written in full and the others as revisit records that refer to it.

Files go through pyarrow's filesystems to the shared folder under a name of the writing attempt's own;
only those that a finished task reports are read, so a lost or repeated task leaves nothing behind that counts.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import read_table, shared_dir, staged

REVISIT_BYTES = 1000
TRAIN_BYTES = 1 << 20
DICTIONARY_BYTES = 1 << 15
ARCHIVE_BYTES = 256 << 20
LEVEL = 3
DATE = "2024-01-01T00:00:00Z"
SKIPPABLE = 0x184D2A5D
FRAME = b"\x28\xb5\x2f\xfd"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAMESPACE = uuid.UUID("5a3f1d52-93a8-4f0c-8f46-0d9f1a6f7a11")


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, str(page_id))}>"


def one_line(value: str | None) -> str:
    return " ".join((value or "").split())


def make_record(page_id, url, payload: bytes, sha1_hex: str, refers_to) -> bytes:
    """A response record, or a revisit record if refers_to is given as a 1-tuple."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if refers_to else http + payload
    fields = [
        ("WARC-Type", "revisit" if refers_to else "response"), ("WARC-Record-ID", record_id(page_id)), ("WARC-Date", DATE),
        ("WARC-Target-URI", one_line(url)), ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(sha1_hex)).decode()),
        ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(body))),
    ]
    if page_id is not None:
        fields.append(("X-Page-ID", str(page_id)))
    if refers_to:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to[0])), ("X-Refers-To-Page-ID", str(refers_to[0]))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode() + body + b"\r\n\r\n"


def build_dictionary(records: list[bytes]):
    """A dictionary from the records, or None if they are too few for one."""
    import zstandard

    size = min(DICTIONARY_BYTES, sum(map(len, records)) // 16)
    if len(records) < 16 or size < 1024:
        return None
    try:
        return zstandard.train_dictionary(size, records, k=256, d=8)
    except zstandard.ZstdError:
        return None


def filesystem(uri: str):
    """(file system, path) of a folder or file; the schemes of Hadoop's own S3 clients mean the same store as s3.

    A store that Arrow does not know is an error that names it.
    """
    from pyarrow import fs

    scheme, _, rest = uri.partition(":")
    try:
        return fs.FileSystem.from_uri(f"s3:{rest}" if scheme in ("s3a", "s3n") else uri)
    except (ValueError, NotImplementedError, OSError) as e:
        raise ValueError(f"archives can't be kept under {scheme}: ({e}); give a folder that Arrow reaches too") from e


class ArchiveWriter:
    def __init__(self, folder: str, name: str, train_bytes: int = TRAIN_BYTES):
        self.fs, path = filesystem(folder)
        self.fs.create_dir(path, recursive=True)
        self.uri, self.out = f"{folder}/{name}", self.fs.open_output_stream(f"{path}/{name}", compression=None)
        self.held: list[bytes] | None = []
        self.held_bytes = self.written = self.records = 0
        self.train_bytes = train_bytes

    def add(self, record: bytes) -> None:
        self.records += 1
        if self.held is None:
            self._write(self.compressor.compress(record))
            return
        self.held.append(record)
        self.held_bytes += len(record)
        if self.held_bytes >= self.train_bytes:
            self._begin()

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.written += len(data)

    def _begin(self) -> None:
        import zstandard

        held, self.held, self.held_bytes = self.held, None, 0
        trained = build_dictionary(held)
        options = {"level": LEVEL, "write_checksum": True, "write_content_size": True}
        if trained:
            packed = zstandard.ZstdCompressor(level=19).compress(trained.as_bytes())
            self._write(struct.pack("<II", SKIPPABLE, len(packed)) + packed)
            options["dict_data"] = trained
        self.compressor = zstandard.ZstdCompressor(**options)
        for record in held:
            self._write(self.compressor.compress(record))

    def close(self) -> tuple[str, int, int]:
        if self.held is not None:
            self._begin()
        self.out.close()
        return self.uri, self.records, self.written


def read_archive(uri: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of every record, one record in memory at a time."""
    import zstandard

    store, path = filesystem(uri)
    with store.open_input_stream(path, compression=None) as f:
        data = f.read(8)
        options = {}
        if len(data) == 8 and struct.unpack("<I", data[:4])[0] == SKIPPABLE:
            trained = f.read(struct.unpack("<I", data[4:])[0])
            if trained[:4] == FRAME:
                trained = zstandard.ZstdDecompressor().decompress(trained)
            options["dict_data"] = zstandard.ZstdCompressionDict(trained)
            data = b""
        context = zstandard.ZstdDecompressor(**options)
        while True:
            data = data or f.read(1 << 16)
            if not data:
                return
            frame, out = context.decompressobj(), []
            while True:
                out.append(frame.decompress(data))
                if frame.eof:
                    data = frame.unused_data
                    break
                data = f.read(1 << 16)
                if not data:
                    raise ValueError(f"{uri} ends within a record")
            yield parse_record(b"".join(out))


def parse_record(record: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = record.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if version != "WARC/1.1":
        raise ValueError(f"not a WARC record: {version[:40]!r}")
    fields = dict(x.split(": ", 1) for x in lines)
    size = int(fields["Content-Length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("a record's length is not as its header says")
    return fields, rest[:size]


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", revisit_bytes: int = REVISIT_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write a record for every row; returns the finished archives (uri, records, bytes).

    Null html is an empty payload, a null url an empty target. Rows with the group's largest id are
    responses (all of them, if rows are repeated); null ids are the smallest. An empty table may give no
    archive, or archives without records. A payload of any length is one record, which is held in memory whole
    with its compressed form.
    """
    payload = F.coalesce(F.col(html_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), payload.alias("payload")).withColumn("sha1", F.sha1("payload"))
    groups = rows.filter(F.length("payload") >= revisit_bytes).groupBy("sha1").agg(F.max("id").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    # Written first, so that its size is known and Spark broadcasts it only if it is small.
    marked = rows.join(staged(groups, "copies"), "sha1", "left")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, archive, n = TaskContext.get(), None, 0

        def done(a):
            uri, records, size = a.close()
            return pa.RecordBatch.from_pydict({"uri": [uri], "records": [records], "bytes": [size]})

        for b in batches:
            for at in range(0, b.num_rows, 256):
                for r in b.slice(at, 256).to_pylist():
                    if archive is None:
                        archive = ArchiveWriter(folder, f"pages-{task.partitionId():06d}-{task.taskAttemptId()}-{n:04d}.warc.zst")
                        n += 1
                    refers = (r["first"],) if r["first"] is not None and r["first"] != r["id"] else None
                    archive.add(make_record(r["id"], r["url"], r["payload"], r["sha1"], refers))
                    if archive.written + archive.held_bytes >= archive_bytes:
                        yield done(archive)
                        archive = None
        if archive is not None:
            yield done(archive)

    return staged(marked.mapInArrow(write, "uri string, records long, bytes long"), "archives")


def read_archives(spark, archives: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record, one task an archive.

    A response's digest is that of the payload as read and must be the one in its header.
    """
    uris = [r[0] for r in archives.select("uri").collect()]
    names = spark.createDataFrame([(u,) for u in uris], "uri string").coalesce(1).repartition(max(1, len(uris)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
        for b in batches:
            for uri in b.column(0).to_pylist():
                rows = []
                for fields, block in read_archive(uri):
                    head, _, payload = block.partition(b"\r\n\r\n")
                    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                    size = int(head.rpartition(b"Content-Length: ")[2])
                    kind = fields["WARC-Type"]
                    if kind == "response" and (hashlib.sha1(payload).hexdigest(), len(payload)) != (digest, size):
                        raise ValueError(f"{uri}: the payload of {fields['WARC-Record-ID']} is damaged")
                    own, other = fields.get("X-Page-ID"), fields.get("X-Refers-To-Page-ID")
                    rows.append({"page_id": own and int(own), "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": other and int(other)})
                    if len(rows) == 5000:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return names.mapInArrow(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def op6_warc_zstd(spark, sf_dir: str) -> DataFrame:
    """Write all pages to archives in the shared folder and read the archives back."""
    folder = f"{shared_dir(spark)}-warc"
    return read_archives(spark, write_archives(read_table(spark, sf_dir, "pages"), folder))
