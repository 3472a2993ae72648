"""Web archives in Zstandard frames: written one record to a frame, and read back with checks.

An archive begins with a skippable frame that holds the dictionary of the frames behind it; each
of these is one record. The reader loads the dictionary, decodes one frame at a time and checks
each record's version, headers, lengths, digest and ending, so it holds one record in memory
whatever the size of the archive.

Tasks write archives of their own under names that no other attempt has, and hand over the names;
the manifest made of them lists finished archives only, so the files of a lost or repeated attempt
are never read. The folder may lie in any store that pyarrow can open by its address.

Defined results: a null payload is empty; equal payloads of at least ``least`` bytes are kept once,
in the record with the largest id, and the others refer to it; records that repeat that id are all
responses; a record with a null id is archived with no id, never kept as the one referred to, and
read back with a null id; a null address becomes the record's own name; no rows give no archive.
Further columns are ignored.
"""

import base64
import hashlib
import struct
import urllib.parse
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotwise.llm.frames import settle, table

# Fixed values of the two public formats.
DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

NAME = "urn:page:"
LEAST = 1000
#: Decoded bytes after which a task begins its next archive.
ARCHIVE_BYTES = 256 << 20
#: A dictionary is trained on the first records of its archive, up to these bounds.
TRAINING_RECORDS, TRAINING_BYTES, DICTIONARY_BYTES = 128, 4 << 20, 32 << 10

RECORDS = (
    "page_id bigint, record_type string, refers_to bigint, payload_bytes bigint, "
    "payload_digest string, target_uri string, archive string, problem string"
)


def revisits(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """``pages`` (id, url, html) with record_type and refers_to.

    Only digests are grouped; the pages themselves meet the groups of two or more in a join.
    """
    body = F.coalesce("html", F.lit(""))
    rows = pages.withColumns({"digest": F.sha1(body), "size": F.octet_length(body)})
    kept = (
        rows.where(F.col("size") >= least)
        .groupBy("digest", "size")
        .agg(F.max("id").alias("response"), F.count(F.lit(1)).alias("copies"))
        .where("copies > 1 and response is not null")
        .select("digest", "size", "response")
    )
    other = F.col("response").isNotNull() & ~F.col("id").eqNullSafe(F.col("response"))
    return rows.join(settle(kept, "repeated-payloads"), ["digest", "size"], "left").select(
        "id",
        "url",
        "html",
        F.when(other, "revisit").otherwise("response").alias("record_type"),
        F.when(other, F.col("response")).alias("refers_to"),
    )


def _name(page_id: int | None) -> str:
    return f"<{NAME}{'none' if page_id is None else page_id}>"


def _page_id(name: str) -> int | None:
    if not (name.startswith(f"<{NAME}") and name.endswith(">")):
        raise ValueError(f"record name {name!r}")
    held = name[len(NAME) + 1 : -1]
    return None if held == "none" else int(held)


def encode_record(page_id, url, html, record_type, refers_to, date: str) -> bytes:
    """One record: version and headers, HTTP headers, payload unless it is a revisit, ending."""
    payload = (html or "").encode()
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = (
        f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {len(payload)}\r\n\r\n"
    ).encode()
    block = http if record_type == "revisit" else http + payload
    uri = _name(page_id)[1:-1] if url is None else urllib.parse.quote(url, safe="!#$%&'()*+,/:;=?@[]~")
    fields = [
        f"WARC-Type: {record_type}",
        f"WARC-Record-ID: {_name(page_id)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if record_type == "revisit":
        fields += [f"WARC-Refers-To: {_name(refers_to)}", f"WARC-Profile: {REVISIT_PROFILE}"]
    head = b"\r\n".join([VERSION, *(f.encode() for f in fields)])
    return head + b"\r\n\r\n" + block + b"\r\n\r\n"


def train(samples: list[bytes]) -> bytes:
    """A dictionary from the first records; too few of them serve as its content instead."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, level=3).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:DICTIONARY_BYTES]


class ArchiveWriter:
    """Writes one archive; the first records wait until the dictionary is trained on them."""

    def __init__(self, folder: str):
        self.name = f"{folder.rstrip('/')}/part-{uuid.uuid4().hex}.warc.zst"
        self.store, path = open_store(self.name)
        self.store.create_dir(path.rsplit("/", 1)[0], recursive=True)
        # the frames are made here, not by the store, which would go by the name's ending
        self.out = self.store.open_output_stream(path, compression=None)
        self.waiting: list[bytes] = []
        self.encode = None
        self.records = self.decoded = 0

    def add(self, record: bytes) -> None:
        self.records += 1
        self.decoded += len(record)
        if self.encode:
            self.out.write(self.encode(record))
            return
        self.waiting.append(record)
        if len(self.waiting) >= TRAINING_RECORDS or self.decoded >= TRAINING_BYTES:
            self._begin()

    def _begin(self) -> None:
        held = train(self.waiting)
        packed = zstandard.ZstdCompressor(level=9).compress(held)
        self.out.write(struct.pack("<II", DICTIONARY_MAGIC, len(packed)) + packed)
        self.encode = zstandard.ZstdCompressor(
            level=3, dict_data=zstandard.ZstdCompressionDict(held), write_checksum=True
        ).compress
        for record in self.waiting:
            self.out.write(self.encode(record))
        self.waiting = []

    def close(self) -> tuple[str, int]:
        if not self.encode:
            self._begin()
        self.out.close()
        return self.name, self.records


def open_store(address: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The store of an address and the path within it."""
    return pyarrow.fs.FileSystem.from_uri(address)


def write_archives(
    rows: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z", archive_bytes: int = ARCHIVE_BYTES
) -> DataFrame:
    """(archive, records): the finished archives of (id, url, html, record_type, refers_to)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, done = None, []
        for batch in batches:
            for i in range(batch.num_rows):
                writer = writer or ArchiveWriter(folder)
                writer.add(encode_record(*(c[i].as_py() for c in batch.columns), date))
                if writer.decoded >= archive_bytes:
                    done.append(writer.close())
                    writer = None
        if writer:
            done.append(writer.close())
        yield pa.RecordBatch.from_arrays(
            [pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64())],
            ["archive", "records"],
        )

    rows = rows.select("id", "url", "html", "record_type", "refers_to")
    return rows.mapInArrow(run, "archive string, records bigint")


def frames(stream, piece: int = 1 << 18) -> Iterator[bytes]:
    """The decoded frames of an archive, one at a time."""
    head = stream.read(8)
    if len(head) < 8:
        raise ValueError("archive is shorter than the head of a frame")
    magic, size = struct.unpack("<II", head)
    if magic != DICTIONARY_MAGIC:
        raise ValueError(f"no dictionary frame but {magic:#x}")
    held = stream.read(size)
    if len(held) != size:
        raise ValueError("dictionary is cut off")
    if held[:4] == FRAME_MAGIC:
        held = zstandard.ZstdDecompressor().decompress(held)
    decoder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(held))
    rest = b""
    while True:
        rest = rest or stream.read(piece)
        if not rest:
            return
        frame, parts = decoder.decompressobj(), []
        while True:
            parts.append(frame.decompress(rest))
            if frame.eof:
                break
            rest = stream.read(piece)
            if not rest:
                raise ValueError("last frame is cut off")
        rest = frame.unused_data
        yield b"".join(parts)


def parse_record(raw: bytes) -> dict:
    """A record's fields and payload; ValueError says what is wrong with it."""
    head, found, rest = raw.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not found or lines[0] != VERSION:
        raise ValueError("no version line")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.decode().partition(":")
        if not colon or name.lower() in fields:
            raise ValueError(f"header {name!r}")
        fields[name.lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "warc-payload-digest", "content-length"):
        if name not in fields:
            raise ValueError(f"header {name} is missing")
    size = int(fields["content-length"])
    block, ending = rest[:size], rest[size:]
    if len(block) != size or ending != b"\r\n\r\n":
        raise ValueError(f"block of {len(rest) - 4} bytes, said to have {size}")
    http, found, payload = block.partition(b"\r\n\r\n")
    said = [x for x in http.split(b"\r\n")[1:] if x.lower().startswith(b"content-length:")]
    if not found or not http.startswith(b"HTTP/") or len(said) != 1:
        raise ValueError("no HTTP headers")
    length = int(said[0].partition(b":")[2])
    kind, coded = fields["warc-payload-digest"].split(":", 1)
    digest = base64.b32decode(coded).hex()
    if kind != "sha1":
        raise ValueError(f"digest {kind}")
    record_type, refers_to = fields["warc-type"], None
    if record_type == "revisit":
        refers_to = _page_id(fields["warc-refers-to"])
        if payload:
            raise ValueError("a revisit with a payload")
    elif record_type == "response":
        if len(payload) != length or hashlib.sha1(payload).hexdigest() != digest:
            raise ValueError("payload is not the one described")
    else:
        raise ValueError(f"type {record_type}")
    return {
        "page_id": _page_id(fields["warc-record-id"]),
        "record_type": record_type,
        "refers_to": refers_to,
        "payload_bytes": length,
        "payload_digest": digest,
        "target_uri": fields.get("warc-target-uri"),
        "payload": payload,
    }


def read_archive(archive: str, expected: int | None = None) -> Iterator[dict]:
    """Every record of an archive; what cannot be read is a row that says so."""
    count = 0
    try:
        store, path = open_store(archive)
        with store.open_input_stream(path, compression=None) as stream:
            for raw in frames(stream):
                count += 1
                try:
                    yield parse_record(raw) | {"archive": archive, "problem": None}
                except (ValueError, KeyError) as wrong:
                    yield {"archive": archive, "problem": f"record {count}: {wrong}"}
        if expected is not None and count != expected:
            yield {"archive": archive, "problem": f"{count} records of {expected}"}
    except (ValueError, zstandard.ZstdError) as wrong:
        yield {"archive": archive, "problem": f"after record {count}: {wrong}"}


def read_archives(manifest: DataFrame, payloads: bool = False) -> DataFrame:
    """The records of all archives of a manifest, with their payloads if asked for."""
    schema = RECORDS + (", payload binary" if payloads else "")
    kinds = pa.schema(
        [
            (name, {"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}[kind])
            for name, kind in (x.split() for x in schema.split(", "))
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, expected in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows, held = [], 0
                for record in read_archive(archive, expected):
                    rows.append(record)
                    held += len(record.get("payload") or b"") if payloads else 256
                    if held > 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, kinds)
                        rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, kinds)

    count = manifest.count()
    rows = manifest.select("archive", "records").repartition(max(1, count))
    return rows.mapInArrow(run, schema)


def resolved(records: DataFrame) -> DataFrame:
    """``records`` with each revisit checked against the response it refers to."""
    sound = records.where("problem is null")
    held = sound.where("record_type = 'response' and page_id is not null").select(
        F.col("page_id").alias("held_id"),
        F.col("payload_digest").alias("held_digest"),
        F.col("payload_bytes").alias("held_bytes"),
    )
    held = held.distinct()
    revisit = sound.where("record_type = 'revisit'").join(
        held,
        (F.col("refers_to") == F.col("held_id")) & (F.col("payload_digest") == F.col("held_digest")),
        "left",
    )
    wrong = F.col("held_bytes").isNull() | (F.col("held_bytes") != F.col("payload_bytes"))
    checked = revisit.withColumn("problem", F.when(wrong, "no such response")).select(*records.columns)
    return (
        records.where("problem is not null or record_type = 'response'")
        .unionByName(checked)
    )


def round_trip(
    pages: DataFrame, folder: str, least: int = LEAST,
    page_id: str = "page_id", url: str = "url", html: str = "html",
) -> DataFrame:
    """Every page written to archives in ``folder`` and read back."""
    rows = revisits(table(pages, id=page_id, url=url, html=html), least)
    manifest = settle(write_archives(rows, folder), "archives")
    return resolved(settle(read_archives(manifest), "records"))
