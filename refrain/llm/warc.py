"""WARC archives of pages, compressed record by record with a Zstandard dictionary, and their reader.

Writing: the payload is the html in UTF-8. Of records with equal payloads of at least ``revisit_bytes`` bytes, the one
with the largest id is a response record and the others are revisit records that refer to it; smaller ones are all
responses. Which one that is comes from an aggregate over (digest, length, id); only the digests of repeated payloads
are joined back, salted, because one payload may be that of a third of all pages. Each task then writes its records to
one or more ``.warc.zst`` files: a dictionary is trained on the first SAMPLE_BYTES of the file's own records (a
documented bound; it affects size only), put in a leading skippable frame (magic 0x184D2A5D), and every record is a
Zstandard frame of its own that uses it. Where no dictionary can be trained (few or tiny records) the frame is left
out. A task writes to a temporary name and moves the finished file to its final one, which depends on the
partition only, so a repeated task replaces its own file.

Reading: Spark lists the files; tasks stream each of them (the dictionary, then record after record), so the size of
a file doesn't matter. Payload digests of responses are recomputed and must agree with the header.

Files are written and read through ``pyarrow.fs`` in the folder given by the caller, which must be shared
(``file:``, ``hdfs:``, ``s3:`` ...); pages are read by Spark alone.

Defined cases: null html is an empty payload; a null url is written as ``about:blank``; rows without id are
responses with a null id, and never referred to while a row with an id has that payload; rows that share the id
of the response are responses too; an empty table gives no files and an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refrain.operators.components import salted_join
from refrain.session import ensure_checkpoint_dir, staged

# Fixed values of the formats.
DICTIONARY_FRAME = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

REVISIT_BYTES = 1000
SAMPLE_BYTES = 2 << 20
SAMPLE_RECORD = 64 << 10  # bytes of a record that the training sees
DICTIONARY_BYTES = 64 << 10
ARCHIVE_BYTES = 256 << 20
LEVEL = 3
DATE = "2000-01-01T00:00:00Z"
_URN = "urn:refrain:row:"


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return pafs.FileSystem.from_uri(uri) if "://" in uri else (pafs.LocalFileSystem(), uri)


def record(row_id, url: str | None, payload: bytes | None, n_bytes: int, digest: str, refers_to=None) -> bytes:
    """One WARC record; ``payload`` None makes it a revisit."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
    block = http + (payload or b"")
    fields = {
        "WARC-Type": "response" if payload is not None else "revisit",
        "WARC-Record-ID": f"<{_URN}{'null' if row_id is None else quote(str(row_id), safe='')}>",
        "WARC-Date": DATE,
        "WARC-Target-URI": "about:blank" if url is None else quote(url, safe=":/?#[]@!$&'()*+,;=%~-._"),
        "WARC-Payload-Digest": "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode(),
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
    }
    if payload is None:
        fields |= {"WARC-Profile": PROFILE, "WARC-Refers-To": f"<{_URN}{quote(str(refers_to), safe='')}>"}
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def train_dictionary(records: list[bytes]) -> zstandard.ZstdCompressionDict | None:
    samples = [r[:SAMPLE_RECORD] for r in records]
    size = min(DICTIONARY_BYTES, sum(map(len, samples)) // 10)
    if len(samples) < 8 or size < 1024:
        return None
    try:
        return zstandard.train_dictionary(size, samples, level=LEVEL)
    except zstandard.ZstdError:  # the samples have too little in common
        return None


class Archive:
    """A file being written under a temporary name."""

    def __init__(self, folder: str, name: str, first: list[bytes]):
        self.files, base = file_system(folder)
        self.path, self.temporary = f"{base}/{name}", f"{base}/.{name}.{uuid.uuid4().hex}"
        self.out, self.records, self.bytes = self.files.open_output_stream(self.temporary, compression=None), 0, 0
        words = train_dictionary(first)
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=words, write_checksum=True) if words else zstandard.ZstdCompressor(level=LEVEL, write_checksum=True)
        if words:
            raw = words.as_bytes()
            self._put(struct.pack("<II", DICTIONARY_FRAME, len(raw)) + raw)
        for one in first:
            self.add(one)

    def _put(self, raw: bytes) -> None:
        self.out.write(raw)
        self.bytes += len(raw)

    def add(self, one: bytes) -> None:
        self._put(self.compressor.compress(one))
        self.records += 1

    def finish(self) -> tuple[str, int, int]:
        self.out.close()
        self.files.move(self.temporary, self.path)
        return self.path, self.records, self.bytes


def _write(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, held, size, archive, done = TaskContext.get().partitionId(), 0, [], 0, None, []

        def start() -> Archive:
            return Archive(folder, f"pages-{part:06d}-{number:04d}.warc.zst", held)

        for batch in batches:
            for row in batch.to_pylist():
                one = record(row["id"], row["url"], row["payload"], row["n_bytes"], row["digest"], row["refers_to"])
                if archive is None:
                    held.append(one)
                    size += len(one)
                    if size >= SAMPLE_BYTES:
                        archive, held, size = start(), [], 0
                else:
                    archive.add(one)
                if archive is not None and archive.bytes >= ARCHIVE_BYTES:
                    done.append(archive.finish())
                    archive, number = None, number + 1
        if archive is None and held:
            archive = start()
        if archive is not None:
            done.append(archive.finish())
        columns = list(zip(*done)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64()))], ["path", "records", "bytes"])

    return run


def new_folder(spark: SparkSession) -> str:
    """A fresh folder below the session's shared one."""
    folder = f"{ensure_checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"
    files, path = file_system(folder)
    files.create_dir(path, recursive=True)
    return folder


def write_archives(pages: DataFrame, folder: str, *, id_col: str = "page_id", html_col: str = "html", url_col: str = "url", revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """Write all pages to archives in ``folder``; returns ``path, records, bytes`` of the files."""
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("n_bytes", F.octet_length("payload").cast("long")).withColumn("digest", F.sha1("payload"))
    repeated = rows.filter(F.col("n_bytes") >= revisit_bytes).groupBy("digest").agg(F.max("id").alias("refers_to"), F.count(F.lit(1)).alias("n"))
    repeated = staged(repeated.filter("n > 1 and refers_to is not null").select("digest", "refers_to"), "repeated")
    joined = salted_join(rows, repeated, ["digest"], "left")
    revisit = F.col("refers_to").isNotNull() & F.col("id").isNotNull() & (F.col("id") != F.col("refers_to"))
    typed = joined.withColumn("payload", F.when(~revisit, F.col("payload"))).withColumn("refers_to", F.when(revisit, F.col("refers_to")))
    typed = typed.select("id", "url", "payload", "n_bytes", "digest", "refers_to").sortWithinPartitions("id", "digest")
    return staged(typed.mapInArrow(_write(folder), "path string, records long, bytes long"), "archives")


def records_of(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (lower case names) and block of every record of a WARC stream."""
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            raise ValueError("not the start of a WARC record")
        fields = {}
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            name, _, value = line.decode("utf-8").partition(":")
            fields[name.strip().lower()] = value.strip()
        block = stream.read(int(fields["content-length"]))
        if len(block) != int(fields["content-length"]) or stream.read(4) != b"\r\n\r\n":
            raise ValueError("a WARC record is cut off")
        yield fields, block


def open_archive(path: str):
    """Decompressed stream of a ``.warc.zst`` file."""
    files, name = file_system(path)
    raw = files.open_input_stream(name, compression=None, buffer_size=1 << 20)
    head = raw.read(8)
    words, rest = None, head
    if len(head) == 8:
        magic, size = struct.unpack("<II", head)
        if magic == DICTIONARY_FRAME:
            words, rest = zstandard.ZstdCompressionDict(raw.read(size)), b""
    source = _Chained(rest, raw)
    reader = zstandard.ZstdDecompressor(dict_data=words) if words else zstandard.ZstdDecompressor()
    return io.BufferedReader(reader.stream_reader(source, read_across_frames=True), 1 << 20)


class _Chained(io.RawIOBase):
    """Bytes already read, then the rest of the stream."""

    def __init__(self, first: bytes, rest):
        self.first, self.rest = first, rest

    def readable(self) -> bool:
        return True

    def read(self, size: int = -1) -> bytes:
        if self.first:
            out, self.first = self.first, b""
            return out
        return self.rest.read(size) if size >= 0 else self.rest.read()


def _row_id(value: str) -> str | None:
    return None if (own := value.strip("<>").removeprefix(_URN)) == "null" else own


def _read(with_payload: bool):
    names = ["id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to"] + ["payload"] * with_payload

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()] + [pa.binary()] * with_payload

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out)) or [()] * len(names)
            batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)
            out.clear()
            return batch

        held = 0
        for batch in batches:
            for path in batch.column("path").to_pylist():
                for fields, block in records_of(open_archive(path)):
                    head, _, payload = block.partition(b"\r\n\r\n")
                    http = dict(x.lower().split(": ", 1) for x in head.decode("ascii").split("\r\n")[1:])
                    digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
                    response = fields["warc-type"] == "response"
                    if response and hashlib.sha1(payload).hexdigest() != digest:
                        raise ValueError(f"damaged payload of {fields['warc-record-id']} in {path}")
                    own, to = _row_id(fields["warc-record-id"]), fields.get("warc-refers-to")
                    row = (own and unquote(own), fields["warc-target-uri"], fields["warc-type"], len(payload) if response else int(http["content-length"]), digest, to and unquote(_row_id(to)))
                    out.append(row + ((payload if response else None),) * with_payload)
                    held += len(block) if with_payload else 0
                    if len(out) >= 4096 or held > 16 << 20:
                        yield flush()
                        held = 0
        yield flush()

    return run


def read_archives(spark: SparkSession, folder: str, *, id_col: str = "page_id", id_type: str = "bigint", with_payload: bool = False) -> DataFrame:
    """``id, url, record_type, payload_bytes, payload_digest, refers_to`` (and ``payload``) of every record in ``folder``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder).select("path")
    kinds = "id string, url string, record_type string, payload_bytes long, payload_digest string, refers_to string"
    rows = files.mapInArrow(_read(with_payload), kinds + ", payload binary" * with_payload)
    rest = [c for c in rows.columns if c not in ("id", "refers_to")]
    return rows.select(F.col("id").cast(id_type).alias(id_col), *rest, F.col("refers_to").cast(id_type).alias("refers_to"))
