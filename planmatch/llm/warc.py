"""WARC archives compressed with Zstandard: one frame per record, and the dictionary that
the frames need in a skippable frame at the head of the file.

Archives are files of bounded payload in a folder that all tasks share. A task names its
archives after its number and writes each under a hidden name first, so a task that is run
again puts the same bytes in the same place. They are read back through Spark's binary
file source; a reader takes the dictionary from the leading frame, walks the frames by
their block headers, decodes each by itself and checks headers, lengths and digests.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planmatch.functions.predicates import named
from planmatch.llm.batches import utf8
from planmatch.operators.joins import join_back
from planmatch.sources.storage import materialise

# Payload bytes after which an archive is closed.
ARCHIVE_BYTES = 4_000_000
# Leading records of an archive that its dictionary is trained on.
SAMPLE_BYTES = 400_000
DICTIONARY_BYTES = 16_384
# Equal payloads from this size on are written once and revisited.
REVISIT_BYTES = 100

# Fixed values of the formats.
SKIPPABLE = 0x184D2A5D
FRAME = 0xFD2FB528
VERSION = b"WARC/1.1"
READABLE = (b"WARC/1.0", VERSION)
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
# Kinds of digest that are checked.
DIGESTS = ("md5", "sha1", "sha256", "sha512")
DATE = "2020-01-01T00:00:00Z"


def record_name(page: object) -> str:
    return f"<urn:x-page:{page}>"


def write_record(page: object, url: str | None, payload: bytes, digest: str, refers_to: object) -> bytes:
    """A response with its payload, or a revisit that names the response instead."""
    revisit = refers_to is not None
    block = b"" if revisit else HTTP_HEAD % len(payload) + payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", record_name(page)),
        ("WARC-Date", DATE),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("X-Payload-Length", str(len(payload))),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if url is not None:
        fields.append(("WARC-Target-URI", "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in url)))
    if revisit:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_name(refers_to))]
    head = b"\r\n".join(f"{k}: {v}".encode() for k, v in fields)
    return VERSION + b"\r\n" + head + b"\r\n\r\n" + block + b"\r\n\r\n"


def make_archive(records: list[bytes]) -> bytes:
    """Dictionary frame, then a frame per record."""
    sample, size = [], 0
    for record in records:
        if size > SAMPLE_BYTES:
            break
        # A long record would fill the sample by itself.
        sample.append(record[:20_000])
        size += len(sample[-1])
    try:
        trained = zstandard.train_dictionary(DICTIONARY_BYTES, sample).as_bytes()
    except zstandard.ZstdError:  # too little to train on: the first record serves as it is
        trained = records[0][:DICTIONARY_BYTES]
    packed = zstandard.ZstdCompressor(level=3).compress(trained)
    compressor = zstandard.ZstdCompressor(
        level=3, dict_data=zstandard.ZstdCompressionDict(trained), write_checksum=True, write_content_size=True
    )
    frames = [compressor.compress(record) for record in records]
    return struct.pack("<II", SKIPPABLE, len(packed)) + packed + b"".join(frames)


def _decoded(decoder: zstandard.ZstdDecompressor, frame: bytes) -> bytes:
    """A whole frame, whether or not its header tells the size of its content."""
    stream = decoder.decompressobj()
    content = stream.decompress(frame)
    if not stream.eof:
        raise ValueError("the frame is cut off")
    return content


def read_dictionary(archive: memoryview) -> tuple[zstandard.ZstdCompressionDict | None, int]:
    """The dictionary in the leading skippable frame, plain or compressed, and where the
    records begin. An archive without that frame has none."""
    if len(archive) < 8:
        return None, 0
    magic, size = struct.unpack_from("<II", archive)
    if magic != SKIPPABLE:
        return None, 0
    body = bytes(archive[8 : 8 + size])
    if len(body) != size:
        raise ValueError("the dictionary frame is cut off")
    if body[:4] == struct.pack("<I", FRAME):
        body = _decoded(zstandard.ZstdDecompressor(), body)
    return zstandard.ZstdCompressionDict(body), 8 + size


def frame_end(archive: memoryview, at: int) -> int:
    """Where the frame that begins at `at` ends, from its header and block headers."""
    if len(archive) < at + 5 or struct.unpack_from("<I", archive, at)[0] != FRAME:
        raise ValueError(f"no frame at byte {at}")
    flags = archive[at + 4]
    single, checksum = flags >> 5 & 1, flags >> 2 & 1
    content = (single, 2, 4, 8)[flags >> 6]
    end = at + 5 + (1 - single) + (0, 1, 2, 4)[flags & 3] + content
    last = False
    while not last:
        if len(archive) < end + 3:
            raise ValueError(f"the frame at byte {at} is cut off")
        head = int.from_bytes(archive[end : end + 3], "little")
        last = bool(head & 1)
        end += 3 + (1 if head >> 1 & 3 == 1 else head >> 3)
    end += 4 * checksum
    if len(archive) < end:
        raise ValueError(f"the frame at byte {at} is cut off")
    return end


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (names folded) and block; ValueError where the record is not sound."""
    head, found, rest = raw.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not found or lines[0] not in READABLE:
        raise ValueError("no WARC header")
    fields: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon or not name:
            raise ValueError("a header line without a name")
        fields[name.decode("utf-8").lower()] = value.strip().decode("utf-8")
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in fields:
            raise ValueError(f"no {name}")
    if not fields["content-length"].isdigit():
        raise ValueError("content-length is not a number")
    size = int(fields["content-length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise ValueError("content-length does not fit the block")
    return fields, rest[:size]


def read_archive(content: bytes) -> Iterator[tuple]:
    """(record_type, name, url, refers_to, digest, payload_bytes, payload, error, header) per frame.

    The payload of a record other than a response or a revisit is its block. A record that is not sound has only `error`; if the frames themselves cannot be
    followed, one such row ends the archive.
    """
    archive = memoryview(content)
    try:
        dictionary, at = read_dictionary(archive)
    except (ValueError, zstandard.ZstdError) as error:
        yield (None,) * 7 + (str(error), None)
        return
    decoder = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
    while at < len(archive):
        try:
            end = frame_end(archive, at)
        except ValueError as error:
            yield (None,) * 7 + (str(error), None)
            return
        try:
            yield _sound(_decoded(decoder, bytes(archive[at:end])))
        except (ValueError, zstandard.ZstdError) as error:
            yield (None,) * 7 + (str(error), None)
        at = end


def _fits(payload: bytes, label: str) -> bool:
    """False where a digest of a known kind, in hex or base32, is not the payload's."""
    kind, _, value = label.partition(":")
    if kind.lower() not in DIGESTS:
        return True
    digest = hashlib.new(kind.lower(), payload).digest()
    value = value.rstrip("=")
    coded = base64.b32encode(digest).decode().rstrip("=")
    if len(value) == len(coded):
        return value.upper() == coded
    return len(value) != 2 * len(digest) or value.lower() == digest.hex()


def _sound(raw: bytes) -> tuple:
    fields, block = parse_record(raw)
    kind = fields["warc-type"]
    label = fields.get("warc-payload-digest")
    size = fields.get("x-payload-length")
    if size is not None and not size.isdigit():
        raise ValueError("the payload length is not a number")
    if kind == "response":
        payload, coded = block, False
        if fields.get("content-type", "application/http").lower().startswith("application/http"):
            head, _, payload = block.partition(b"\r\n\r\n")
            # Writers differ in whether they take the digest before or after decoding.
            coded = b"\r\ntransfer-encoding:" in head.lower()
        fits = label is None or coded or _fits(payload, label)
        if not fits or size is not None and int(size) != len(payload):
            raise ValueError("the payload does not fit its digest or length")
    elif kind == "revisit":
        payload = None
        if not {"warc-refers-to", "warc-refers-to-target-uri", "warc-payload-digest"} & set(fields):
            raise ValueError("a revisit that names no response")
    else:
        payload = block
    length = len(payload) if payload is not None else None if size is None else int(size)
    return (
        kind, fields["warc-record-id"], fields.get("warc-target-uri"), fields.get("warc-refers-to"),
        None if label is None else label.removeprefix("sha256:"), length, payload, None,
        raw.partition(b"\r\n\r\n")[0].decode("utf-8"),
    )


def write_archives(
    pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html",
    archive_bytes: int = ARCHIVE_BYTES,
) -> DataFrame:
    """Writes a record per row into archives under `folder`; (archive, records) per file.

    Of the rows with equal payloads of at least REVISIT_BYTES the one with the smallest id
    is a response and rows with other ids revisit it; repeats of that id are responses too.
    Null html is an empty payload. Rows without id revisit a row that has one.
    """
    source = pages.select(
        named(page_id).alias("page_id"), named(url).alias("url"), F.coalesce(named(html), F.lit("")).alias("html")
    ).withColumn("digest", F.sha2("html", 256))
    long_enough = F.octet_length("html") >= REVISIT_BYTES
    # Only payloads that occur twice have anything to revisit.
    copies = (
        source.where(long_enough)
        .groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
        .where("n > 1 AND first IS NOT NULL")
    )
    typed = join_back(source, copies, ["digest"], ["page_id"])
    # Written once: what a task reads, and so its archives, stays the same if it is run again.
    rows = materialise(
        typed.withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))).drop("first"),
        "pages",
    )

    def write(batches):
        system, root = fs.FileSystem.from_uri(folder)
        task = TaskContext.get().partitionId()
        records: list[bytes] = []
        size = number = 0

        def close():
            name = f"{task:06d}-{number:06d}.warc.zst"
            hidden = f"{root}/.{name}-{uuid.uuid4().hex}"
            with system.open_output_stream(hidden) as stream:
                stream.write(make_archive(records))
            system.move(hidden, f"{root}/{name}")
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(records)], pa.int64())], names=["archive", "records"])

        for batch in batches:
            ids, urls, refers = (batch.column(i).to_pylist() for i in (0, 1, 3))
            digests = batch.column(4).to_pylist()
            for row, payload in enumerate(utf8(batch.column(2))):
                records.append(write_record(ids[row], urls[row], payload, digests[row], refers[row]))
                size += len(payload)
                if size >= archive_bytes:
                    yield close()
                    records, size, number = [], 0, number + 1
        if records:
            yield close()

    return rows.select("page_id", "url", "html", "refers_to", "digest").mapInArrow(write, "archive string, records bigint")


RECORD = (
    "record_type string, name string, url string, refers_to string, payload_digest string, "
    "payload_bytes bigint, payload binary, error string, header string"
)


def read_archives(spark: SparkSession, folder: str, payload: bool = True) -> DataFrame:
    """Every record of the archives under `folder`; `error` says what is wrong with one that
    is not sound, and is null otherwise. Any folder that Spark can read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder)

    def read(batches):
        for batch in batches:
            for content in batch.column(0):
                out, size = [], 0
                for row in read_archive(content.as_py()):
                    out.append(row if payload else (*row[:6], None, *row[7:]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(list(zip(*out)) or [()] * 9, kinds)], names=names
                )

    names = [part.split()[0] for part in RECORD.split(", ")]
    kinds = [pa.string()] * 5 + [pa.int64(), pa.binary(), pa.string(), pa.string()]
    return files.select("content").mapInArrow(read, RECORD)
