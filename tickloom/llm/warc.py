"""WARC archives compressed with Zstandard: one frame a record, and the dictionary in a leading skippable frame."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.common import bloom_bits, bloom_filter, hot_join, slices
from tickloom.session import BROADCAST_ROWS, pin

# Fixed values of the two formats: magic numbers of the dictionary's frame, of a frame of data and of a dictionary; what every skippable
# frame's magic shares; a skippable frame without content; the revisit profile.
DICTIONARY_FRAME, DATA_FRAME, TRAINED = b"\x5d\x2a\x4d\x18", b"\x28\xb5\x2f\xfd", b"\x37\xa4\x30\xec"
SKIPPABLE = (b"\x2a\x4d\x18", range(0x50, 0x60))
EMPTY_FRAME = "P*M\x18\0\0\0\0"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: An archive ends when its frames have this many bytes; the dictionary's bytes, and the records of a task it is trained on, each cut to so many.
ARCHIVE_BYTES, DICT_BYTES, DICT_RECORDS, DICT_CUT = 16 << 20, 16 << 10, 256, 8 << 10
LEVEL = 3
#: A record's compressed length and its declared lengths may not claim more than this (a guard of the reader).
RECORD_BYTES = 1 << 30
FIELDS = ("path string, frame_offset long, record_id string, record_type string, target_uri string, payload_digest string, payload_bytes long, "
          "refers_to string, payload binary, problem string")


def digest32(sha1_hex: str) -> str:
    return base64.b32encode(bytes.fromhex(sha1_hex)).decode()


def _clean(uri: str) -> str:
    """Control characters and blanks as percent escapes, so that no address can end its header line."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", uri)


def record(name: str, url: str | None, date: str, payload: bytes, digest: str, refers: str | None) -> bytes:
    """A response record with its payload, or a revisit record, which has the HTTP headers only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers is not None else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers is None else 'revisit'}", f"WARC-Record-ID: <{name}>", f"WARC-Date: {date}",
             *([f"WARC-Target-URI: {_clean(url)}"] if url else []), f"WARC-Payload-Digest: sha1:{digest}",
             f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}",
             *([f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{refers}>"] if refers is not None else []),
             "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return b"".join(["\r\n".join(lines).encode(), b"\r\n\r\n", block, b"\r\n\r\n"])


def train(samples: list[bytes]) -> bytes:
    """A dictionary for records like these; where there are too few to train on, their plain bytes."""
    cut = [s[:DICT_CUT] for s in samples if s]
    try:
        return zstandard.train_dictionary(DICT_BYTES, cut).as_bytes()
    except zstandard.ZstdError:
        return b"".join(cut)[:DICT_BYTES]


def leading_frame(dictionary: bytes) -> bytes:
    return DICTIONARY_FRAME + len(dictionary).to_bytes(4, "little") + dictionary


def _dictionary(content: bytes) -> zstandard.ZstdCompressionDict:
    kind = zstandard.DICT_TYPE_FULLDICT if content.startswith(TRAINED) else zstandard.DICT_TYPE_RAWCONTENT
    return zstandard.ZstdCompressionDict(content, dict_type=kind)


def _archives(rows: Iterator[tuple], date: str, limit: int) -> Iterator[bytes]:
    """Whole archives of at most about ``limit`` bytes; the dictionary is trained on the first records of the task."""
    first, samples = [], []
    for row in rows:
        first.append(row)
        samples.append(record(*row[:2], date, *row[2:]))
        if len(first) == DICT_RECORDS or sum(map(len, samples)) > limit:
            break
    if not first:
        return
    content = train(samples)
    head = leading_frame(content)
    squeeze = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(content) if content else None, write_checksum=True)
    parts, size = [head], len(head)

    def records() -> Iterator[bytes]:
        yield from samples
        samples.clear()
        for r in rows:
            yield record(*r[:2], date, *r[2:])

    for r in records():
        frame = squeeze.compress(r)
        parts.append(frame)
        size += len(frame)
        if size >= limit:
            yield b"".join(parts)
            parts, size = [head], len(head)
    if len(parts) > 1:
        yield b"".join(parts)


def mark_revisits(rows: DataFrame) -> DataFrame:
    """Add ``refers``: the smallest id with the same ``digest`` and length, null for that id itself.

    Digests are counted (a shuffle of digests and ids alone); those that occur once need nothing. At
    most ``BROADCAST_ROWS`` repeated ones are broadcast. With more, rows that a Bloom bitmap shows
    not to be among them stay where they are, hot digests are broadcast, and only the rest shuffles.
    """
    same = [F.col("digest"), F.col("size")]
    rows = rows.withColumn("same", F.concat_ws("/", *same))
    groups = pin(rows.groupBy("same").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1"))
    n = groups.count()
    if n <= BROADCAST_ROWS:
        out = rows.join(F.broadcast(groups), "same", "left")
    else:
        test = bloom_filter(groups, "same", bloom_bits(n))
        rows = rows.withColumn("maybe", test(F.col("same")))
        alone = rows.filter(~F.col("maybe")).drop("maybe").withColumns({"first": F.lit(None).cast("long"), "n": F.lit(None).cast("long")})
        out = alone.unionByName(hot_join(rows.filter("maybe").drop("maybe"), groups, "same", "n", "left"))
    return out.withColumn("refers", F.when(~F.col("first").eqNullSafe(F.col("page_id")), F.col("first"))).drop("same", "first", "n")


def write_archives(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html", least_bytes: int = 0,
                   date: str = "1970-01-01T00:00:00Z", archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write a WARC record for each row to archives below ``path``, a folder in any store that Spark writes to.

    Payloads are the texts in UTF-8, null read as empty. Of payloads that are equal and have
    ``least_bytes`` or more, the rows with the smallest id are responses and the others revisits of
    it; smaller payloads are all responses. A null id is larger than any other: such rows are revisits
    unless all rows of their payload have none; then they are all responses. Repeated rows get a
    record each. A null or empty address gets no header line; control characters in it are escaped.
    A record with a very long text is a frame of its own like any other, and ends its archive. No
    rows, no archives. Other columns and their names don't matter.

    Each row that a task hands to Spark's own writer is a whole archive and becomes a file of its
    own, so retried and lost tasks leave no halves. The line end that the writer adds to a row is a
    skippable frame without content, which readers of the format pass over.
    """
    text = F.col(payload).cast("string")
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(text, F.lit("")).alias("html"))
    rows = rows.withColumns({"size": F.octet_length("html"), "digest": F.sha1("html")})
    marked = mark_revisits(rows.filter(F.col("size") >= least_bytes))
    if least_bytes:
        marked = marked.unionByName(rows.filter(F.col("size") < least_bytes).withColumn("refers", F.lit(None).cast("long")))
    name = lambda i: f"urn:x-page:{'' if i is None else i}"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for b in slices(batches, "html"):
                for i, u, h, d, r in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "refers")), strict=True):
                    yield name(i), u, h.encode(), digest32(d), None if r is None else name(r)

        for archive in _archives(rows(), date, archive_bytes):
            yield pa.record_batch([pa.array([archive], pa.binary())], names=["value"])

    archives = marked.select("page_id", "url", "html", "digest", "refers").mapInArrow(write, "value binary")
    archives.select(F.col("value").cast("string")).write.option("lineSep", EMPTY_FRAME).option("maxRecordsPerFile", 1).text(path)


def frame_end(data: memoryview, at: int) -> int:
    """Where the frame that begins at ``at`` ends, by its own headers; an error where the data ends first."""
    if len(data) - at < 8:
        raise ValueError("cut off inside a frame's header")
    if bytes(data[at + 1:at + 4]) == SKIPPABLE[0] and data[at] in SKIPPABLE[1]:
        end = at + 8 + int.from_bytes(data[at + 4:at + 8], "little")
    elif bytes(data[at:at + 4]) == DATA_FRAME:
        flags = data[at + 4]
        single = flags >> 5 & 1
        end = at + 5 + (1 - single) + (0, 1, 2, 4)[flags & 3] + (single, 2, 4, 8)[flags >> 6]
        last = False
        while not last:
            head = int.from_bytes(data[end:end + 3], "little")
            last, kind, size = bool(head & 1), head >> 1 & 3, head >> 3
            if end + 3 > len(data) or kind == 3:
                raise ValueError("cut off or damaged block")
            end += 3 + (1 if kind == 1 else size)
        end += 4 * (flags >> 2 & 1)
    else:
        raise ValueError("no frame begins here")
    if end > len(data):
        raise ValueError("cut off inside a frame")
    return end


def _headers(lines: list[bytes]) -> dict[str, str]:
    found = {}
    for line in lines:
        name, colon, value = line.partition(b":")
        if not colon or not name.strip():
            raise ValueError("a header line without a name")
        found[name.strip().lower().decode()] = value.strip().decode()
    return found


def parse(data: bytes) -> dict:
    """The fields of one record, checked: version, declared lengths, both digests, and what its type asks for."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not gap or lines[0] not in (b"WARC/1.0", b"WARC/1.1"):
        raise ValueError("no WARC header")
    h = _headers(lines[1:])
    for need in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if need not in h:
            raise ValueError(f"no {need}")
    if not h["content-length"].isdigit() or len(rest) != int(h["content-length"]) + 4 or rest[-4:] != b"\r\n\r\n":
        raise ValueError("the block's length is not the declared one")
    block, kind = rest[:-4], h["warc-type"]
    sha1 = lambda b: f"sha1:{base64.b32encode(hashlib.sha1(b).digest()).decode()}"
    if "warc-block-digest" in h and h["warc-block-digest"] != sha1(block):
        raise ValueError("the block's digest is not the declared one")
    bare = lambda v: v[1:-1] if v and v[0] == "<" and v[-1] == ">" else v
    out = {"record_id": bare(h["warc-record-id"]), "record_type": kind, "target_uri": h.get("warc-target-uri"),
           "payload_digest": h.get("warc-payload-digest", "").removeprefix("sha1:") or None, "payload_bytes": None, "refers_to": bare(h.get("warc-refers-to")), "payload": None}
    if kind in ("response", "revisit"):
        http, gap, payload = block.partition(b"\r\n\r\n")
        status, *fields = http.split(b"\r\n")
        declared = _headers(fields).get("content-length", "")
        if not gap or not status.startswith(b"HTTP/") or not declared.isdigit():
            raise ValueError("no HTTP header with a length")
        out["payload_bytes"] = int(declared)
        if kind == "response":
            if len(payload) != int(declared):
                raise ValueError("the payload's length is not the declared one")
            if out["payload_digest"] and f"sha1:{out['payload_digest']}" != sha1(payload):
                raise ValueError("the payload's digest is not the declared one")
            out["payload"] = payload
        elif payload or not out["refers_to"] or not out["payload_digest"]:
            raise ValueError("a revisit with a payload, or without digest or origin")
    return out


def records(content: bytes) -> Iterator[tuple[int, dict]]:
    """The records of one archive as (offset of the frame, fields); what can't be read has its reason in ``problem``.

    A frame that decodes to no valid record is reported and the next one read; where a frame's end
    can't be told, the rest of the archive is one report.
    """
    data, at, made = memoryview(content), 0, None
    while at < len(data):
        try:
            end = frame_end(data, at)
        except (ValueError, IndexError) as e:
            yield at, {"problem": str(e)}
            return
        if bytes(data[at:at + 4]) != DATA_FRAME:
            if at == 0 and bytes(data[:4]) == DICTIONARY_FRAME and end > 8:
                try:
                    inner = bytes(data[8:end])
                    made = _dictionary(zstandard.ZstdDecompressor().decompressobj().decompress(inner) if inner.startswith(DATA_FRAME) else inner)
                except zstandard.ZstdError as e:
                    yield at, {"problem": f"dictionary: {e}"}
                    return
        else:
            try:
                whole = zstandard.ZstdDecompressor(dict_data=made) if made else zstandard.ZstdDecompressor()
                size = zstandard.frame_content_size(data[at:end])
                if size > RECORD_BYTES:
                    raise ValueError("a record of more bytes than the reader takes")
                yield at, parse(whole.decompress(data[at:end]) if size >= 0 else whole.decompressobj().decompress(data[at:end]))
            except (ValueError, zstandard.ZstdError) as e:
                yield at, {"problem": str(e)}
        at = end


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Every record below ``path``: its fields, place, payload (where asked for), and ``problem``, null for valid records.

    Files are read by Spark, so any store will do; a task holds as many archives as
    ``spark.sql.files.maxPartitionBytes`` allows and decodes them one at a time, frame by frame. Damaged frames, wrong lengths or digests and cut-off files give rows with a ``problem``
    and null fields instead of an error. Records other than responses and revisits come without payload.
    """
    names = [f.split()[0] for f in FIELDS.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64() if n in ("frame_offset", "payload_bytes") else pa.binary() if n == "payload" else pa.string() for n in names]

        def batch(rows: list[dict]) -> pa.RecordBatch:
            return pa.record_batch([pa.array([r.get(n) for r in rows], k) for n, k in zip(names, kinds, strict=True)], names=names)

        for b in batches:
            for i in range(b.num_rows):
                rows, size, where = [], 0, b.column("path")[i].as_py()
                for at, found in records(b.column("content")[i].as_py()):
                    size += len(found.get("payload") or b"")
                    if not payloads:
                        found["payload"] = None
                    rows.append(found | {"path": where, "frame_offset": at})
                    if len(rows) == 1000 or payloads and size > 4 << 20:
                        yield batch(rows)
                        rows, size = [], 0
                if rows:
                    yield batch(rows)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInArrow(read, FIELDS)


def page_records(spark: SparkSession, path: str) -> DataFrame:
    """Per valid record of ``write_archives``: ``page_id, payload_bytes, payload_digest, record_type, refers_to``."""
    page = lambda c: F.nullif(F.regexp_extract(c, "^urn:x-page:(-?[0-9]*)$", 1), F.lit("")).cast("long")
    return read_archives(spark, path, payloads=False).filter("problem IS NULL").select(
        page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"))
