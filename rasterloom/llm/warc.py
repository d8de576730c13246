"""WARC archives in Zstandard: writing with duplicates as revisits, and reading with checks.

An archive starts with a skippable frame that holds its dictionary; each record is one frame that declares its content
size. The reader takes the dictionary from that frame, decodes one frame at a time, and checks of each record the version
line, the required headers, that Content-Length is what follows, the two closing line ends, and the digests of block and
payload. A broken record raises WarcError with its archive and offset. Archives of others are read too: without a
dictionary, with further skippable frames, all record types, digests in hex or base32 or none, and HTTP messages, whose
payload is their body. Digests of an unknown algorithm aren't checked; a missing payload digest is computed.

Writing: payload digests are aggregated to the largest id of each digest, and joined back to rows by digest; both sides
of that join are plain exchanges, so a digest that a third of all rows share is split like any skewed join. Each task
writes archives of `roll` bytes at most before compression; a task's files carry its attempt in their name and count
only when the task reports them, so a repeated task leaves no half archive behind. Reading: each archive is decoded in one
streaming pass, a task an archive up to 20,000 tasks; revisits are joined to their responses for the payload's length.

Nulls, ties, empties: a null or empty payload is an empty record. Payloads under `least` bytes are never revisits. Rows
that share an id: of equal payloads the first written is the response if ids tie, the others revisit it. Rows with a null id
are written as responses and come back with a null id. An empty table gives an empty table. Columns beyond id, uri and
payload aren't read, whatever their names.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import io
import re
import struct
import uuid
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyarrow import fs

from . import shared

SKIPPABLE = 0x184D2A5D  # magic number of the dictionary's frame, fixed value
FRAME = 0xFD2FB528  # magic number of a Zstandard frame, fixed value
TYPES = ("warcinfo", "response", "resource", "request", "metadata", "revisit", "conversion", "continuation")
SIZES = {"sha1": 20, "md5": 16, "sha256": 32, "sha512": 64}  # bytes of a digest
MOST_TASKS = 20_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "page_id long, record_type string, payload_digest string, refers_to long, uri string, payload binary, block_bytes long, record_id string, refers_to_record string"
LIST = "archive string, n_records long"


class WarcError(ValueError):
    """A record or archive that isn't as it should be."""


def open_store(url: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path in the shared folder, as executors reach it."""
    return fs.FileSystem.from_uri(url) if "://" in url or url.startswith("file:") else (fs.LocalFileSystem(), url)


def response_id(page: int | None, digest: str) -> str:
    """The record id of a page's response; revisits name it without having seen it."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page}/{digest}')}>"


def record_bytes(kind: str, page: int | None, uri: str | None, payload: bytes, digest: str, refers_to: int | None, when: str, named: bool = False) -> bytes:
    """One record: headers, block, closing line ends. A revisit has an empty block. named: revisits may refer to this one."""
    block = b"" if kind == "revisit" else payload
    head = {
        "WARC-Type": kind,
        "WARC-Record-ID": response_id(page, digest) if named else f"<urn:uuid:{uuid.uuid4()}>",
        "WARC-Date": when,
        "WARC-Target-URI": re.sub(r"[\r\n]+", "", uri or "") or "urn:none",
        "WARC-Payload-Digest": f"sha1:{digest}",
        "X-Page-ID": "" if page is None else str(page),
    }
    if kind == "revisit":
        head |= {"WARC-Profile": PROFILE, "WARC-Refers-To": response_id(refers_to, digest), "X-Refers-To-Page-ID": str(refers_to)}
    head |= {"Content-Type": "text/html; charset=utf-8", "Content-Length": str(len(block))}
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items())
    return b"WARC/1.1\r\n" + lines.encode("utf-8", "surrogatepass") + b"\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of one record, checked."""
    head, sep, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not sep or not re.fullmatch(rb"WARC/1\.[01]", lines[0]):
        raise WarcError("no WARC version line or no end of headers")
    headers: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.decode("utf-8", "surrogatepass").partition(":")
        if not colon or not name or name != name.strip():
            raise WarcError(f"bad header line {name[:40]!r}")
        headers[name.lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in headers:
            raise WarcError(f"header {name} is missing")
    if not headers["content-length"].isdigit():
        raise WarcError("Content-Length isn't a number")
    size = int(headers["content-length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise WarcError(f"Content-Length is {size}, the block and its end take {len(rest)}")
    block = rest[:size]
    if headers["warc-type"] not in TYPES:
        raise WarcError(f"unknown record type {headers['warc-type'][:40]!r}")
    if headers["warc-type"] == "revisit" and payloads(headers, block)[0]:
        raise WarcError("a revisit with a payload")
    check_digests(headers, block)
    return headers, block


def hex_digest(value: str) -> tuple[str, str | None]:
    """(algorithm, digest in lower-case hex) of a labelled digest in hex or base32; None if the algorithm is unknown."""
    name, colon, digits = value.strip().partition(":")
    name = name.lower().replace("-", "")
    size = SIZES.get(name)
    if not colon or size is None:
        return name, None
    digits = digits.strip()
    if len(digits) == 2 * size and re.fullmatch(r"[0-9a-fA-F]+", digits):
        return name, digits.lower()
    try:
        raw = base64.b32decode(digits.upper().rstrip("=") + "=" * (-len(digits.rstrip("=")) % 8))
    except binascii.Error:
        raw = b""
    if len(raw) != size:
        raise WarcError(f"bad digest {value[:60]!r}")
    return name, raw.hex()


def unchunked(body: bytes) -> bytes | None:
    """The body of a chunked HTTP message, None if it isn't one."""
    out, pos = [], 0
    while True:
        end = body.find(b"\r\n", pos, pos + 64)
        size = re.match(rb"[0-9a-fA-F]{1,15}", body[pos:end]) if end > 0 else None
        if not size:
            return None
        n, pos = int(size[0], 16), end + 2
        if not n:
            return b"".join(out)
        out.append(body[pos : pos + n])
        pos += n + 2


def payloads(headers: dict[str, str], block: bytes) -> list[bytes]:
    """What may be meant by a record's payload, the stored bytes first: of an HTTP message its body, as sent or put together."""
    if not headers.get("content-type", "").lower().startswith("application/http"):
        return [block]
    head, sep, body = block.partition(b"\r\n\r\n")
    whole = unchunked(body) if re.search(rb"(?im)^transfer-encoding:.*chunked", head) else None
    return [body if sep else b"", *([] if whole is None else [whole])]


def check_digests(headers: dict[str, str], block: bytes) -> None:
    """Digests of the block, and of the payload where the record holds it; a cut-off record has no digest to compare."""
    if "warc-truncated" in headers:
        return
    name, want = hex_digest(headers["warc-block-digest"]) if headers.get("warc-block-digest") else ("", None)
    if want and hashlib.new(name, block).hexdigest() != want:
        raise WarcError("the block doesn't have its digest")
    if headers["warc-type"] == "revisit" or "warc-segment-number" in headers:  # the payload is elsewhere, or partly
        return
    name, want = hex_digest(headers["warc-payload-digest"]) if headers.get("warc-payload-digest") else ("", None)
    if want and all(hashlib.new(name, x).hexdigest() != want for x in payloads(headers, block)):
        raise WarcError("the payload doesn't have its digest")


def payload_sha1(headers: dict[str, str], block: bytes) -> str | None:
    """The payload's SHA-1 in hex: as declared, else computed; None for a revisit that declares none."""
    name, want = hex_digest(headers["warc-payload-digest"]) if headers.get("warc-payload-digest") else ("", None)
    if name == "sha1" and want:
        return want
    return None if headers["warc-type"] == "revisit" else hashlib.sha1(payloads(headers, block)[0]).hexdigest()


def train_dictionary(samples: list[bytes], size: int = 16 * 1024) -> bytes:
    """A dictionary from the first records of an archive; empty if they are too few or too small."""
    if len(samples) < 16:
        return b""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


class ArchiveWriter:
    """Writes records as frames behind the dictionary's frame. The first `sample` records wait for the dictionary."""

    def __init__(self, out, sample: int = 64, level: int = 3):
        self.out, self.sample, self.level = out, sample, level
        self.waiting: list[bytes] = []
        self.compressor: zstandard.ZstdCompressor | None = None
        self.n = self.size = 0

    def add(self, record: bytes) -> None:
        self.n += 1
        self.size += len(record)
        if self.compressor is None:
            self.waiting.append(record)
            if len(self.waiting) >= self.sample:
                self._start()
        else:
            self.out.write(self.compressor.compress(record))

    def _start(self) -> None:
        dictionary = train_dictionary(self.waiting)
        self.out.write(struct.pack("<II", SKIPPABLE, len(dictionary)) + dictionary)
        options = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
        self.compressor = zstandard.ZstdCompressor(level=self.level, write_checksum=True, write_content_size=True, **options)
        for record in self.waiting:
            self.out.write(self.compressor.compress(record))
        self.waiting = []

    def close(self) -> None:
        if self.compressor is None:
            self._start()
        self.out.close()


def other_frame(held: bytes) -> bool:
    """Whether a skippable frame begins here."""
    return struct.unpack_from("<I", held)[0] & 0xFFFFFFF0 == 0x184D2A50


def read_archive(stream: io.RawIOBase, most: int = 1 << 31) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, headers, block) of each record. Holds one compressed and one decoded record at a time."""
    held = b""

    def need(n: int) -> bool:
        """Have n bytes at hand, if the archive has them."""
        nonlocal held
        while len(held) < n:
            more = stream.read(max(1 << 16, n - len(held)))
            if not more:
                return False
            held += more
        return True

    offset, options = 0, {}
    if need(8) and struct.unpack_from("<I", held)[0] == SKIPPABLE:
        size = struct.unpack_from("<I", held, 4)[0]
        if not need(8 + size):
            raise WarcError("the dictionary is cut off")
        dictionary, held, offset = held[8 : 8 + size], held[8 + size :], 8 + size
        if dictionary[:4] == struct.pack("<I", FRAME):  # a dictionary may itself be compressed
            try:
                dictionary = zstandard.ZstdDecompressor().decompress(dictionary, max_output_size=1 << 27)
            except zstandard.ZstdError as broken:
                raise WarcError(f"the dictionary is broken: {broken}") from None
        if dictionary:
            options = {"dict_data": zstandard.ZstdCompressionDict(dictionary)}
    elif len(held) < 8 or struct.unpack_from("<I", held)[0] != FRAME and not other_frame(held):
        raise WarcError("the archive starts with neither a dictionary nor a Zstandard frame")
    decompressor = zstandard.ZstdDecompressor(**options)
    while True:
        if not need(1):
            return
        if need(8) and other_frame(held):
            size = 8 + struct.unpack_from("<I", held, 4)[0]
            if not need(size):
                raise WarcError(f"the skippable frame at {offset} is cut off")
            held, offset = held[size:], offset + size
            continue
        frame, parts, total = decompressor.decompressobj(), [], 0
        used = 0
        while not frame.eof:
            if not held:
                held = stream.read(1 << 16)
                if not held:
                    raise WarcError(f"the frame at {offset} is cut off")
            try:
                part = frame.decompress(held)
            except zstandard.ZstdError as broken:
                raise WarcError(f"the frame at {offset} is broken: {broken}") from None
            used += len(held) - len(frame.unused_data)
            held = frame.unused_data
            total += len(part)
            if total > most:
                raise WarcError(f"the record at {offset} is longer than {most} bytes")
            parts.append(part)
        try:
            headers, block = parse_record(b"".join(parts))
        except WarcError as broken:
            raise WarcError(f"record at {offset}: {broken}") from None
        yield offset, headers, block
        offset += used


def _written(folder: str, roll: int, least: int, when: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = open_store(folder)
        task = TaskContext.get()
        tag = f"{task.partitionId():06d}-{task.taskAttemptId()}" if task else "000000-0"
        writer, names, counts = None, [], []
        for batch in batches:
            for page, uri, html, digest, top in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if writer is None:
                    names.append(f"{path}/part-{tag}-{len(names):04d}.warc.zst")
                    writer = ArchiveWriter(store.open_output_stream(names[-1], compression=None))
                kind = "response" if top is None else "revisit"
                named = kind == "response" and page is not None and len(html) >= least  # the only response of its page and payload
                writer.add(record_bytes(kind, page, uri, html, digest, top, when, named))
                if writer.size >= roll:
                    writer.close()
                    counts.append(writer.n)
                    writer = None
        if writer is not None:
            writer.close()
            counts.append(writer.n)
        if names:
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(counts, pa.int64())], ["archive", "n_records"])

    return run


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html", least: int = 1000, roll: int = 64 << 20) -> DataFrame:
    """Write a record for each row; the written list of archives: archive, n_records. folder must be shared."""
    shared.small_batches(pages.sparkSession)
    open_folder, path = open_store(folder)
    open_folder.create_dir(path, recursive=True)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(uri_col).cast("string").alias("uri"), F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    heavy = rows.where((F.octet_length("payload") >= least) & F.col("page_id").isNotNull())
    tops = heavy.groupBy("digest").agg(F.max("page_id").alias("top"), F.count("*").alias("n")).where("n > 1").select("digest", "top")
    # rows of one id with one payload: one of them responds, by a number among them
    twins = heavy.groupBy("page_id", "digest").agg(F.count("*").alias("m")).where("m > 1").select("page_id", "digest", "m")
    linked = rows.join(tops, "digest", "left")
    if not twins.isEmpty():
        first = F.row_number().over(Window.partitionBy("page_id", "digest").orderBy("uri"))
        linked = linked.withColumn("turn", first)
    else:
        linked = linked.withColumn("turn", F.lit(1))
    alone = F.col("top").isNull() | F.col("page_id").isNull() | ((F.col("page_id") == F.col("top")) & (F.col("turn") == 1))
    ready = linked.select("page_id", "uri", "payload", "digest", F.when(~alone, F.col("top")).alias("top"))
    when = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    return shared.write(ready.mapInArrow(_written(folder, roll, least, when), LIST), "archives")


def number(value: str | None) -> int | None:
    """An id of our own header, None if there is none."""
    return int(value) if value and re.fullmatch(r"-?[0-9]{1,19}", value) else None


def _read(folder: str, with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = open_store(folder)
        for batch in batches:
            for name, expected in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n, rows, held = 0, [], 0
                with store.open_input_stream(name, compression=None) as stream:
                    try:
                        for _, headers, block in read_archive(stream):
                            body = payloads(headers, block)[0]
                            rows.append((
                                number(headers.get("x-page-id")), headers["warc-type"], payload_sha1(headers, block), number(headers.get("x-refers-to-page-id")), headers.get("warc-target-uri"),
                                body if with_payload else None, len(body), headers["warc-record-id"], headers.get("warc-refers-to"),
                            ))
                            n, held = n + 1, held + len(block)
                            if held > 4 << 20 or len(rows) >= 2000:
                                yield _records(rows)
                                rows, held = [], 0
                    except WarcError as broken:
                        raise WarcError(f"{name}: {broken}") from None
                if expected is not None and n != expected:
                    raise WarcError(f"{name}: {n} records, {expected} were written")
                if rows:
                    yield _records(rows)

    return run


def _records(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string()]
    names = ["page_id", "record_type", "payload_digest", "refers_to", "uri", "payload", "block_bytes", "record_id", "refers_to_record"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def read_archives(archives: DataFrame, folder: str, with_payload: bool = False) -> DataFrame:
    """A row for each record: page_id, record_type, payload_digest, refers_to, uri, payload (if asked for), block_bytes (of the
    payload), record_id, refers_to_record.

    archives: archive (its path in folder's file system), n_records (null: not checked). The number of tasks is given, since
    adaptive execution would merge the few short rows of the list into one task that reads everything.
    """
    tasks = max(1, min(MOST_TASKS, archives.count()))
    return archives.select("archive", "n_records").repartition(tasks, "archive").mapInArrow(_read(folder, with_payload), RECORD)


def resolved(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to: a revisit has the length of the response it names.

    records must be written: it is read twice. A revisit whose response is missing, or has another digest, has a null length.
    """
    slim = records.select("page_id", "record_type", "payload_digest", "refers_to", "block_bytes")
    sources = slim.where("record_type = 'response' and page_id is not null").groupBy(F.col("page_id").alias("source_id"), F.col("payload_digest").alias("source_digest")).agg(F.max("block_bytes").alias("source_bytes"))
    joined = slim.join(sources, (F.col("refers_to") == F.col("source_id")) & (F.col("payload_digest") == F.col("source_digest")), "left")
    length = F.when(F.col("record_type") == "revisit", F.col("source_bytes")).otherwise(F.col("block_bytes"))
    return joined.select("page_id", length.alias("payload_bytes"), "payload_digest", "record_type", "refers_to")
