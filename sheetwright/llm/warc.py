"""WARC archives written from a chunked record table, and read back.

A payload becomes rows (record, chunk number, text) of bounded size. Every chunk is written as a WARC record of
its own: the first as ``response`` or ``revisit``, further ones as ``continuation`` segments with
WARC-Segment-Number and WARC-Segment-Origin-ID, the last with WARC-Segment-Total-Length and the digest of the
whole payload. Digests are carried from chunk to chunk by writer and reader, so neither joins a payload. A page's
html is one value of its input row all the same: whole records are avoided from the cut on, and when reading.
Spark's text sink, with CRLF CRLF as its line end, writes the files: any store that Spark writes to will do.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetwright.llm.common import by_key, saved, scratch_path

#: Bytes of a chunk, and chunks of one archive file: what a reader holds of a file is bounded.
CHUNK, FILE_CHUNKS = 128 << 10, 1024
#: Payloads of fewer bytes are never revisits.
LEAST = 100
#: Revisits (a number, a digest and a number each: 30 MB at most) up to which they are broadcast to their pages;
#: beyond, pages are shuffled to them, with the same result.
BROADCAST_ROWS = 200_000
_END = "\r\n\r\n"
_DATE = "2024-01-01T00:00:00Z"
_ROW = "record string, chunk_no int, last boolean, kind string, page_id long, first_page long, url string, payload binary"


def _cut(batches: Iterator[pa.RecordBatch], chunk: int, archive: str) -> Iterator[pa.RecordBatch]:
    """Chunk rows of page rows; a chunk ends between characters. An empty payload is one empty chunk."""
    task, count = TaskContext.get().partitionId(), 0
    names = [x.split()[0] for x in _ROW.split(", ")]
    schema = pa.schema([("record", pa.string()), ("chunk_no", pa.int32()), ("last", pa.bool_()), ("kind", pa.string()), ("page_id", pa.int64()), ("first_page", pa.int64()), ("url", pa.string()), ("payload", pa.binary())])
    for batch in batches:
        rows, held = [], 0
        for page_id, url, html, first in zip(*batch.columns, strict=True):
            data = memoryview(html.as_buffer()) if html.is_valid else memoryview(b"")
            name = f"{archive} {page_id.as_py()} {hashlib.sha256(data).hexdigest()} {task} {count}"  # equal rows are records of their own
            record, count = str(uuid.uuid5(uuid.NAMESPACE_OID, name)), count + 1
            at = number = 0
            while True:
                end = min(len(data), at + chunk)
                while end < len(data) and data[end] & 0xC0 == 0x80:
                    end -= 1
                rows.append((record, number, end == len(data), "revisit" if first.is_valid else "response", page_id.as_py(), first.as_py(), url.as_py(), bytes(data[at:end])))
                held += end - at
                if held > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*rows, strict=True), schema, strict=True)], names)
                    rows, held = [], 0
                at, number = end, number + 1
                if at >= len(data):
                    break
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*rows, strict=True), schema, strict=True)], names)


def _render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The text of a WARC record for each chunk row. Chunks of a record follow each other."""
    digest, size = hashlib.sha256(), 0
    for batch in batches:
        lines = []
        for r in batch.to_pylist():
            if not r["chunk_no"]:
                digest, size = hashlib.sha256(), 0
            digest.update(r["payload"])
            size += len(r["payload"])
            origin, more = uuid.UUID(r["record"]), r["chunk_no"] > 0 or not r["last"]
            head = ["WARC/1.1", f"WARC-Type: {'continuation' if r['chunk_no'] else r['kind']}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(origin, str(r['chunk_no'])) if r['chunk_no'] else origin}>", f"WARC-Date: {_DATE}"]
            head.append(f"WARC-Target-URI: {(r['url'] or '').translate({10: '%0A', 13: '%0D'})}")
            head.append(f"X-Page-ID: {'' if r['page_id'] is None else r['page_id']}")
            if more:
                head.append(f"WARC-Segment-Number: {r['chunk_no'] + 1}")
            if r["chunk_no"]:
                head.append(f"WARC-Segment-Origin-ID: <urn:uuid:{origin}>")
            elif r["kind"] == "revisit":
                head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page-ID: {r['first_page']}"]
            if r["last"]:
                head += [f"WARC-Segment-Total-Length: {size}"] * more + [f"WARC-Payload-Digest: sha256:{digest.hexdigest()}"]
            head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(r['payload'])}"]
            lines.append("\r\n".join(head) + _END + r["payload"].decode())
        yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], ["value"])


def write_warc(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html", chunk: int = CHUNK, compression: str = "gzip") -> None:
    """Write a WARC record for each row of ``pages`` as archive files under ``path``.

    Of records with equal payloads of at least ``LEAST`` bytes, the one with the smallest page_id is a response
    and the others are revisits that refer to it; their payload is written all the same, so that a reader can
    check it. Smaller payloads are all responses. Rows that share the smallest page_id are all responses. A
    null payload is empty. A row with a null page_id revisits the record with the smallest page_id like any other;
    where no record of a payload has an id, all are responses. Columns beside the three are ignored; an empty table
    makes archives without records.
    """
    kept = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html"))
    kept = kept.withColumn("digest", F.sha2(F.coalesce("html", F.lit("")), 256))
    prints = saved(kept.where(F.octet_length("html") >= LEAST).select("page_id", "digest"), "payloads")
    firsts = prints.groupBy("digest").agg(F.min("page_id").alias("first_page"), F.max("page_id").alias("other"), F.count_if(F.col("page_id").isNull()).alias("nameless"))
    firsts = firsts.where("other > first_page or (nameless > 0 and first_page is not null)").select("digest", "first_page")
    later = saved(prints.distinct().join(firsts, "digest").where("page_id is null or page_id <> first_page"), "revisits").alias("r")
    same = (F.col("p.digest") == F.col("r.digest")) & F.col("p.page_id").eqNullSafe(F.col("r.page_id"))
    typed = kept.alias("p").join(F.broadcast(later) if later.count() <= BROADCAST_ROWS else later, same, "left").select("p.page_id", "url", "html", "first_page")
    chunks = typed.mapInArrow(partial(_cut, chunk=chunk, archive=path), _ROW)
    lines = chunks.mapInArrow(_render, "value string")
    lines.write.option("lineSep", _END).option("compression", compression).option("maxRecordsPerFile", FILE_CHUNKS).text(path)


def _inflated(content: pa.Buffer) -> Iterator[bytes]:
    """The bytes of an archive, plain or of one or more gzip members, in pieces."""
    view = memoryview(content)
    if bytes(view[:2]) != b"\x1f\x8b":
        yield from (bytes(view[i : i + (1 << 20)]) for i in range(0, len(view), 1 << 20))
        return
    engine, rest, at = zlib.decompressobj(31), b"", 0
    while at < len(view) or rest:
        if not rest:
            rest, at = bytes(view[at : at + (1 << 18)]), at + (1 << 18)
        yield engine.decompress(rest, 1 << 20)
        rest = engine.unconsumed_tail
        if engine.eof:
            rest, engine = engine.unused_data, zlib.decompressobj(31)


def _records(content: pa.Buffer) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header, block) of each WARC record of an archive, holding one record at a time."""
    pieces, held = _inflated(content), bytearray()

    def fill(n: int) -> bool:
        while len(held) < n:
            piece = next(pieces, None)
            if piece is None:
                return False
            held.extend(piece)
        return True

    end = _END.encode()
    while fill(1):
        while (cut := held.find(end)) < 0:
            if not fill(len(held) + 1):
                raise ValueError("a WARC header has no end")
        header = dict(line.split(": ", 1) for line in held[:cut].decode().split("\r\n")[1:])
        size = int(header["Content-Length"])
        if not fill(cut + 4 + size + 4):
            raise ValueError("a WARC record is cut off")
        yield header, bytes(held[cut + 4 : cut + 4 + size])
        del held[: cut + 4 + size + 4]


def _parse(batches: Iterator[pa.RecordBatch], whole: bool) -> Iterator[pa.RecordBatch]:
    """Chunk rows of archives. Without ``whole``, records of one chunk carry their digest and no payload."""
    number = lambda x: int(x) if x else None
    kinds = [pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
    names = ["record", "chunk_no", "kind", "page_id", "first_page", "bytes", "digest", "declared", "payload"]
    for batch in batches:
        for content in batch.column(0):
            rows, held = [], 0
            for h, block in _records(content.as_buffer()):
                single = "WARC-Segment-Number" not in h
                name = h.get("WARC-Segment-Origin-ID", h["WARC-Record-ID"])[10:-1]
                rows.append((name, int(h.get("WARC-Segment-Number", 1)) - 1, h["WARC-Type"], number(h.get("X-Page-ID")), number(h.get("X-Refers-To-Page-ID")), len(block), hashlib.sha256(block).hexdigest() if single else None, h.get("WARC-Payload-Digest", "")[7:] or None, None if single and not whole else block))
                held += 500 + (0 if single and not whole else len(block))
                if held > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)


_CHUNK_ROW = "record string, chunk_no int, kind string, page_id long, first_page long, bytes long, digest string, declared string, payload binary"


def read_chunks(spark: SparkSession, path: str, whole: bool = True) -> DataFrame:
    """The chunk table of the archives under ``path``: a row for each WARC record, payloads never joined."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.txt*").load(path).select("content").mapInArrow(partial(_parse, whole=whole), _CHUNK_ROW)


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each record of several chunks, in the order of (record, chunk_no); the digest is carried along."""
    now, digest, size, out = None, hashlib.sha256(), 0, []
    for batch in batches:
        for r in batch.to_pylist():
            if now is None or r["record"] != now["record"]:
                if now is not None:
                    out.append(now | {"bytes": size, "digest": digest.hexdigest()})
                now, digest, size = {k: v for k, v in r.items() if k != "payload"}, hashlib.sha256(), 0
            digest.update(r["payload"])
            size += len(r["payload"])
            now["declared"] = r["declared"] or now["declared"]
    if now is not None:
        out.append(now | {"bytes": size, "digest": digest.hexdigest()})
    if out:
        kinds = {"chunk_no": pa.int32(), "page_id": pa.int64(), "first_page": pa.int64(), "bytes": pa.int64()}
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kinds.get(k, pa.string())) for k in out[0]], list(out[0]))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """A row for each payload under ``path``: page_id, payload_bytes, payload_digest, record_type, refers_to, intact.

    Digests are those of what was read; ``intact`` says whether the header's digest agrees. Only records of
    several chunks are shuffled, by record, and their digests are carried from chunk to chunk.
    """
    chunks = saved(read_chunks(spark, path, whole=False), "chunks")
    several = by_key(chunks.where("digest is null"), "record").sortWithinPartitions("record", "chunk_no")
    joined = several.mapInArrow(_chain, _CHUNK_ROW.replace(", payload binary", ""))
    out = chunks.where("digest is not null").drop("payload").unionByName(joined)
    return out.select("page_id", F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("kind").alias("record_type"), F.col("first_page").alias("refers_to"), (F.col("digest") == F.col("declared")).alias("intact"))


def round_trip(pages: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Write ``pages`` as archives in the shared folder and read them back as records."""
    path = scratch_path(pages.sparkSession, "warc")
    write_warc(pages, path, chunk=chunk)
    return read_records(pages.sparkSession, path)
