"""WARC archives in Zstandard: one frame per record, the dictionary in a leading skippable frame."""

from __future__ import annotations

import base64
import hashlib
import math
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.llm.store import materialize, new_path
from docweave.llm.text import filled

#: Fixed by the formats: the skippable frame that holds a dictionary, and the start of a Zstandard frame.
DICTIONARY_FRAME, ZSTD_FRAME = 0x184D2A5D, b"\x28\xb5\x2f\xfd"
PAGE = "urn:page:"
#: Bytes of an archive that a frame is given at once: what it leaves over is copied.
PIECE = 8192
#: Tasks that write archives at most: up to so many archives each task writes one.
TASKS = 16384
RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _clean(value: object) -> str:
    return " ".join(str(value).split())


def record_bytes(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """A response record, or without its payload a revisit record that refers to another page's."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{PAGE}{'' if page_id is None else page_id}>",
        f"WARC-Date: {date}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
        f"WARC-Payload-Digest: sha1:{digest32(payload)}",
        f"WARC-Block-Digest: sha1:{digest32(block)}",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {_clean(url)}")
    if refers_to is not None:
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head.append(f"WARC-Refers-To: <{PAGE}{refers_to}>")
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict[str, object]:
    """The fields of one record; ValueError if a header, a length or a digest doesn't hold."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not gap or not lines[0].startswith("WARC/1."):
        raise ValueError("no WARC version line")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not name.strip():
            raise ValueError(f"bad header line {line!r}")
        fields[name.strip().lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in fields:
            raise ValueError(f"no {name}")
    size = fields["content-length"]
    if not size.isdigit() or len(rest) != int(size) + 4 or not rest.endswith(b"\r\n\r\n"):
        raise ValueError("the block doesn't have the length of its header")
    block = rest[:-4]
    if (want := fields.get("warc-block-digest")) and want != f"sha1:{digest32(block)}":
        raise ValueError("block digest")
    http, gap, payload = block.partition(b"\r\n\r\n")
    said = [x.split(b":", 1)[1].strip() for x in http.split(b"\r\n")[1:] if x.lower().startswith(b"content-length:")]
    if not gap or len(said) != 1 or not said[0].isdigit():
        raise ValueError("bad HTTP header")
    kind, digest = fields["warc-type"], fields.get("warc-payload-digest", "").removeprefix("sha1:")
    if kind == "response" and (len(payload) != int(said[0]) or digest32(payload) != digest):
        raise ValueError("payload length or digest")
    return {
        "page_id": _page(fields.get("warc-record-id")),
        "url": fields.get("warc-target-uri"),
        "record_type": kind,
        "refers_to": _page(fields.get("warc-refers-to")),
        "payload_bytes": int(said[0]),
        "payload_digest": digest,
        "payload": payload if kind == "response" else None,
    }


def _page(uri: str | None) -> int | None:
    number = (uri or "").strip("<>").removeprefix(PAGE)
    return int(number) if number else None


def dictionary_frame(dictionary: bytes) -> bytes:
    packed = zstandard.ZstdCompressor(level=9).compress(dictionary)
    return struct.pack("<II", DICTIONARY_FRAME, len(packed)) + packed


def records_of(archive: bytes) -> Iterator[bytes]:
    """The decoded records of an archive, one frame each."""
    view, dictionary = memoryview(archive), None
    if len(view) >= 8 and struct.unpack_from("<I", view)[0] == DICTIONARY_FRAME:
        size = struct.unpack_from("<I", view, 4)[0]
        if 8 + size > len(view):
            raise ValueError("the dictionary frame is cut off")
        inside = bytes(view[8 : 8 + size])
        if inside.startswith(ZSTD_FRAME):
            inside = zstandard.ZstdDecompressor().decompress(inside)
        dictionary, view = zstandard.ZstdCompressionDict(inside), view[8 + size :]
    decoder = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
    at = 0
    while at < len(view):
        one, out = decoder.decompressobj(), []
        while not one.eof:
            if at >= len(view):
                raise ValueError("a frame is cut off")
            piece = view[at : at + PIECE]
            out.append(one.decompress(piece))
            at += len(piece)
        at -= len(one.unused_data)
        yield b"".join(out)


def train_dictionary(pages: DataFrame, samples: int, size: int, total: int) -> bytes:
    """A dictionary from at most `samples` of `total` pages, 16 KB of each: a bounded sample, chosen by hash.

    Only pages whose hash lies below a threshold are looked at, about `samples` at any input size.
    """
    share = min(1.0, (samples + 4 * math.sqrt(samples)) / max(1, total))
    order = F.xxhash64("page_id", "html")
    most = min(int(share * (1 << 64)), (1 << 64) - 1) - (1 << 63)
    few = pages.where((F.octet_length("html") > 0) & (order <= F.lit(most)))
    cut = few.groupBy(order.alias("o")).agg(F.any_value(F.encode(F.substring("html", 1, 16384), "utf-8")).alias("x"))
    rows = [bytes(r.x) for r in cut.orderBy("o").limit(samples).collect()]
    try:
        return zstandard.train_dictionary(size, rows).as_bytes()
    except zstandard.ZstdError:  # too few or too small samples
        return b"".join(rows)[:size]


def write_warc(
    pages: DataFrame,
    path: str,
    archive_mb: int = 32,
    samples: int = 256,
    dictionary_size: int = 65536,
    min_bytes: int = 0,
    date: str = "1970-01-01T00:00:00Z",
) -> DataFrame:
    """Write a record per page (page_id, url, html) below the URI path; returns (archive, records, bytes).

    Of pages with equal payloads of at least min_bytes bytes, the smallest page_id is a response
    and the others are revisits that refer to it. Pages are dealt to archives of about archive_mb
    MB of payload by hash. A task writes each of its archives, record by record in order of page_id,
    to a name of its own and then moves it into place, so that a repeated task leaves one whole file.

    Null html is an empty payload. Pages with a null id are responses unless another page has
    their payload; rows that repeat the smallest id are all responses. Very long payloads are one
    record each, held in memory once. Other columns are ignored, whatever their names. No pages, no
    archives.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), filled(F.col("html")).alias("html"))
    keyed = rows.withColumn("size", F.octet_length("html")).withColumn("same", F.unhex(F.sha2("html", 256)))
    groups = keyed.where(F.col("size") >= min_bytes).groupBy("same").agg(F.count(F.lit(1)).alias("n"), F.min("page_id").alias("first"))
    groups = materialize(groups.where("n > 1 and first is not null").select("same", "first"), "warc-groups")
    total, count = keyed.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    archives = max(1, math.ceil(total / (archive_mb << 20)))
    refers = F.when(~F.col("first").eqNullSafe(F.col("page_id")), F.col("first"))
    placed = keyed.join(groups, "same", "left").select(
        F.pmod(F.xxhash64("page_id", "url", "same"), F.lit(archives)).cast("int").alias("archive"),
        "page_id", "url", "html", refers.alias("refers_to"),
    )
    dictionary = train_dictionary(rows, samples, dictionary_size, count)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(path)
        store.create_dir(root, recursive=True)
        known = zstandard.ZstdCompressionDict(dictionary)
        known.precompute_compress(level=3)  # else every frame digests the dictionary anew
        coder = zstandard.ZstdCompressor(level=3, dict_data=known, write_content_size=True)
        at, out, count, size, name, draft = None, None, 0, 0, "", ""

        def done() -> pa.RecordBatch:
            out.close()
            store.move(draft, f"{root}/{name}")
            return pa.RecordBatch.from_pydict(
                {"archive": pa.array([name]), "records": pa.array([count], pa.int64()), "bytes": pa.array([size], pa.int64())}
            )

        for batch in batches:
            for archive, page_id, url, html, refers_to in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if archive != at:
                    if out:
                        yield done()
                    at, count, size, name = archive, 0, 0, f"part-{archive:06d}.warc.zst"
                    draft = f"{root}/_{name}-{uuid.uuid4().hex}"
                    out = store.open_output_stream(draft)
                    out.write(dictionary_frame(dictionary))
                frame = coder.compress(record_bytes(page_id, url, html.encode("utf-8", "surrogatepass"), refers_to, date))
                out.write(frame)
                count, size = count + 1, size + len(frame)
        if out:
            yield done()

    tasks = min(archives, TASKS)
    dealt = placed.repartitionById(tasks, F.pmod("archive", F.lit(tasks)).cast("int")).sortWithinPartitions("archive", "page_id", "url")
    return dealt.mapInArrow(work, "archive string, records long, bytes long")


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the archives below path, with the columns of RECORD; a bad record is an error."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
            + [("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())]
        )
        for batch in batches:
            for content in batch.column("content"):
                held, size = [], 0
                for raw in records_of(content.as_py()):
                    held.append(parse_record(raw))
                    size += len(raw)
                    if size >= 1 << 23:
                        yield pa.RecordBatch.from_pylist(held, schema)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(path)
    return files.select("content").mapInArrow(work, RECORD)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write the pages to archives in the shared folder and read them back, without their payloads."""
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    written = materialize(write_warc(pages, path), "warc-manifest")
    expected, archives = written.agg(F.sum("records"), F.count(F.lit(1))).first()
    if not archives:
        return spark.createDataFrame([], RECORD).drop("payload", "url")
    back = materialize(read_warc(spark, path).drop("payload", "url"), "warc-records")
    if (got := back.count()) != expected:
        raise ValueError(f"{expected} records were written, {got} read")
    return back
