"""WARC archives of pages, written from and read back into a table of record chunks.

A payload is never put together as a whole on the Python side: it comes as rows
(record, chunk number, bytes) of at most ``CHUNK`` bytes, each record's chunks in
order within one partition. The writer adds a digest chunk by chunk and compares
it with the one in the header; the reader streams the archive and gives each
chunk row the bytes and the digest so far, so the last chunk of a record carries
those of its whole payload. Records are gzip members of their own.

Equal payloads of at least ``min_bytes`` are stored once, under the smallest id;
the others are revisit records that refer to that record and hold no payload. Each
archive begins with a record about itself and ends at about ``ARCHIVE`` bytes. Ids of
records are unique: that of a record which others may refer to is made from its page
and digest, all others from the archive and the record's place in it. Where several
rows have the smallest id of a payload, revisits name its page, address and date only.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomframe.llm.records import opened
from loomframe.llm.shared import new_folder, written

CHUNK = 1 << 20
ARCHIVE = 1 << 30
DATE = "2024-01-01T00:00:00Z"
_CHUNKS = pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("chunk_no", pa.int64()), ("chunk", pa.binary()), ("is_last", pa.bool_()), ("bytes_so_far", pa.int64()), ("digest_so_far", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())])
CHUNK_ROWS = "page_id long, record_type string, refers_to long, url string, chunk_no long, chunk binary, is_last boolean, bytes_so_far long, digest_so_far string, payload_bytes long, payload_digest string"
MANIFEST = "path string, n_records long"
#: A digest is hot when over one of so many rows have it, so hot digests are fewer than this.
HOT = 1000


def record_kinds(pages: DataFrame, min_bytes: int = 100) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pages with byte count and digest; the digests that several pages share; the hot ones among these.

    Shared digests come from counts that are combined before they are shuffled.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload")).withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha2("payload", 256)})
    shared = written(
        rows.filter(F.col("payload_bytes") >= min_bytes)
        .groupBy("payload_digest", "page_id")
        .agg(F.count("*").alias("n"), F.min("url").alias("url"))
        .groupBy("payload_digest")
        .agg(F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "n", "url"))).alias("first"), F.sum("n").alias("copies"))
        .filter("copies > 1")
        .select("payload_digest", "copies", F.col("first.page_id").alias("first_id"), F.struct("first.url", (F.col("first.n") == 1).alias("alone")).alias("first")),
        "warc-shared",
    )
    total = shared.agg(F.sum("copies").alias("n")).first()["n"] or 0
    hot = shared.filter(F.col("copies") > total / HOT)
    return rows, shared, hot


def chunk_rows(pages: DataFrame, min_bytes: int = 100, chunk: int = CHUNK) -> DataFrame:
    """The chunked record table to write: one row a chunk, at least one a record; revisits have one empty chunk.

    Hot digests, fewer than ``HOT`` by definition, are broadcast; all others, of which none has more than that
    share of the rows, are joined by shuffle. So no key gathers in one task.
    """
    rows, shared, hot = record_kinds(pages, min_bytes)
    kept = F.when((F.col("first_id") == F.col("page_id")) | F.col("first_id").isNull() | F.col("page_id").isNull() | (F.col("payload_bytes") < min_bytes), "response").otherwise("revisit")
    hot_ids = F.broadcast(hot.select("payload_digest", F.col("first_id").alias("hot_id"), F.col("first").alias("hot_first")))
    marked = rows.join(hot_ids, "payload_digest", "left")
    cold = shared.join(F.broadcast(hot.select("payload_digest")), "payload_digest", "left_anti").select(F.col("payload_digest").alias("key"), F.col("first_id").alias("cold_id"), F.col("first").alias("cold_first"))
    # hot and short rows get a key of their own, so they are dealt evenly by the same shuffle
    key = F.when(F.col("hot_id").isNull() & (F.col("payload_bytes") >= min_bytes), F.col("payload_digest")).otherwise(F.concat(F.lit("-"), F.coalesce(F.col("page_id").cast("string"), F.lit(""))))
    joined = marked.withColumn("key", key).join(cold, "key", "left").withColumn("first_id", F.coalesce("hot_id", "cold_id"))
    joined = joined.withColumn("first", F.coalesce("hot_first", "cold_first"))
    joined = joined.withColumn("record_type", kept).withColumn("refers_to", F.when(F.col("record_type") == "revisit", F.col("first_id")))
    stored = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b""))
    last = F.greatest(F.ceil(F.octet_length("stored") / chunk) - 1, F.lit(0)).cast("int")
    return (
        joined.withColumn("stored", stored)
        .withColumn("last_no", last)
        .withColumns({"refers_url": F.col("first.url"), "referred": F.coalesce(F.col("first.alone") & ((F.col("first_id") == F.col("page_id")) | (F.col("record_type") == "revisit")), F.lit(False))})
        .select("page_id", "url", "record_type", "refers_to", "refers_url", "referred", "payload_bytes", "payload_digest", "stored", "last_no", F.explode(F.sequence(F.lit(0), F.col("last_no"))).alias("chunk_no"))
        .select("page_id", "url", "record_type", "refers_to", "refers_url", "referred", "payload_bytes", "payload_digest", (F.col("chunk_no") == F.col("last_no")).alias("is_last"), "chunk_no", F.octet_length("stored").cast("long").alias("stored_bytes"), F.substring("stored", F.col("chunk_no") * chunk + 1, F.lit(chunk)).alias("chunk"))
    )


def _one_line(text: str) -> str:
    return text.replace("\r", "%0D").replace("\n", "%0A")


def _name(text: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, text)}>"


def _referred_name(page_id: int, digest: str) -> str:
    return _name(f"page {page_id} {digest}")


def _lines(*lines: str) -> bytes:
    return ("\r\n".join(("WARC/1.1", *lines)) + "\r\n\r\n").encode()


def _head(row: dict, name: str) -> bytes:
    lines = [f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: {name}", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha256:{row['payload_digest']}", f"X-Payload-Bytes: {row['payload_bytes']}"]
    if row["url"] is not None:
        lines.append(f"WARC-Target-URI: {_one_line(row['url'])}")
    if row["page_id"] is not None:
        lines.append(f"X-Page-ID: {row['page_id']}")
    if row["record_type"] == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To-Date: {DATE}", f"X-Refers-To-Page-ID: {row['refers_to']}"]
        if row["referred"]:
            lines.append(f"WARC-Refers-To: {_referred_name(row['refers_to'], row['payload_digest'])}")
        if row["refers_url"] is not None:
            lines.append(f"WARC-Refers-To-Target-URI: {_one_line(row['refers_url'])}")
    return _lines(*lines, "Content-Type: text/html; charset=utf-8", f"Content-Length: {row['stored_bytes']}")


def _packed(*parts: bytes) -> bytes:
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return b"".join((*(packer.compress(p) for p in parts), packer.flush()))


def write_warc(rows: DataFrame, folder: str, archive: int = ARCHIVE) -> DataFrame:
    """Write the chunk rows, each partition to archives of its own of about ``archive`` bytes; returns the manifest (path, n_records)."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        file = packer = digest = path = None
        n = number = 0

        def described() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"path": path, "n_records": n}], schema=pa.schema([("path", pa.string()), ("n_records", pa.int64())]))

        try:
            for row in (row for batch in batches for row in batch.to_pylist()):
                if row["chunk_no"] == 0 and file is not None and file.tell() >= archive:
                    file.close()
                    yield described()
                    file, n = None, 0
                if file is None:
                    path = f"{folder}/part-{context.partitionId():06d}-{number:04d}-{context.taskAttemptId()}.warc.gz"
                    where, at = opened(path)
                    where.create_dir(at.rpartition("/")[0], recursive=True)
                    file, number = where.open_output_stream(at, compression=None, buffer_size=1 << 20), number + 1
                    about = b"format: WARC File Format 1.1\r\n"
                    file.write(_packed(_lines("WARC-Type: warcinfo", f"WARC-Record-ID: {_name(path)}", f"WARC-Date: {DATE}", f"WARC-Filename: {at.rpartition('/')[2]}", "Content-Type: application/warc-fields", f"Content-Length: {len(about)}"), about, b"\r\n\r\n"))
                if row["chunk_no"] == 0:
                    first = row["referred"] and row["record_type"] == "response"
                    packer, digest = zlib.compressobj(1, zlib.DEFLATED, 31), hashlib.sha256()
                    file.write(packer.compress(_head(row, _referred_name(row["page_id"], row["payload_digest"]) if first else _name(f"{path} {n}"))))
                    n += 1
                digest.update(row["chunk"])
                file.write(packer.compress(row["chunk"]))
                if row["is_last"]:
                    if row["record_type"] == "response" and digest.hexdigest() != row["payload_digest"]:
                        raise ValueError(f"page {row['page_id']}: the chunks don't add up to the payload")
                    file.write(packer.compress(b"\r\n\r\n") + packer.flush())
        finally:
            if file is not None:
                file.close()
        if file is not None:
            yield described()

    return written(rows.mapInArrow(write, MANIFEST), "warc-manifest")


class _Stream:
    """Bytes of an archive of gzip members, read as they are asked for."""

    def __init__(self, file, block: int = 1 << 18):
        self.file, self.block, self.buffer, self.unpack, self.raw = file, block, b"", zlib.decompressobj(31), b""

    def _more(self) -> bool:
        while True:
            raw = self.raw or self.file.read(self.block)
            if not raw:
                return False
            if self.unpack.eof:
                self.unpack = zlib.decompressobj(31)
            got = self.unpack.decompress(raw, self.block)
            self.raw = self.unpack.unconsumed_tail or self.unpack.unused_data
            if got:
                self.buffer += got
                return True

    def until(self, mark: bytes) -> bytes | None:
        while (at := self.buffer.find(mark)) < 0:
            if not self._more():
                if self.buffer:
                    raise ValueError("the archive ends within a record")
                return None
        out, self.buffer = self.buffer[: at + len(mark)], self.buffer[at + len(mark) :]
        return out

    def some(self, most: int) -> bytes:
        while len(self.buffer) < most:
            if not self._more():
                raise ValueError("the archive ends within a record")
        out, self.buffer = self.buffer[:most], self.buffer[most:]
        return out


def read_warc(manifest: DataFrame, chunk: int = CHUNK, with_chunks: bool = True) -> DataFrame:
    """The chunked record table read from the archives; without chunks, only each record's last row and no bytes.

    payload_bytes and payload_digest are those of the full payload: measured from the chunks for responses,
    as the header states them for revisits. A response whose chunks differ from its header is an error.
    """

    def rows(path: str) -> Iterator[dict]:
        where, name = opened(path)
        with where.open_input_stream(name, compression=None) as file:
            stream = _Stream(file)
            while (head := stream.until(b"\r\n\r\n")) is not None:
                fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:] if line)
                left, digest, done, number = int(fields["Content-Length"]), hashlib.sha256(), 0, 0
                if fields["WARC-Type"] == "warcinfo":
                    stream.some(left + 4)
                    continue
                revisit = fields["WARC-Type"] == "revisit"
                stated = fields["WARC-Payload-Digest"].partition(":")[2]
                row = {"page_id": int(fields["X-Page-ID"]) if "X-Page-ID" in fields else None, "record_type": fields["WARC-Type"], "refers_to": int(fields["X-Refers-To-Page-ID"]) if revisit else None, "url": fields.get("WARC-Target-URI")}
                while True:
                    data = stream.some(min(chunk, left))
                    left, done = left - len(data), done + len(data)
                    digest.update(data)
                    if not left and not revisit and digest.hexdigest() != stated:
                        raise ValueError(f"page {row['page_id']}: the payload doesn't match its digest")
                    if with_chunks or not left:
                        yield row | {"chunk_no": number, "chunk": data if with_chunks else None, "is_last": not left, "bytes_so_far": done, "digest_so_far": digest.hexdigest(), "payload_bytes": int(fields["X-Payload-Bytes"]) if revisit else done, "payload_digest": stated if revisit else digest.hexdigest()}
                    number += 1
                    if not left:
                        break
                if stream.some(4) != b"\r\n\r\n":
                    raise ValueError("a record has no end")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path in (x for batch in batches for x in batch.column("path").to_pylist()):
            out, size = [], 0
            for row in rows(path):
                out.append(row)
                size += len(row["chunk"] or b"") + 200
                if size > 1 << 22:
                    yield pa.RecordBatch.from_pylist(out, schema=_CHUNKS)
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=_CHUNKS)

    n = max(1, manifest.count())
    return manifest.select("path").repartition(n).mapInArrow(read, CHUNK_ROWS)


def archive_round_trip(spark: SparkSession, pages: DataFrame, min_bytes: int = 100) -> DataFrame:
    """Write a record per row of pages (page_id, url, html), read the archives back: one row per page.

    Null html is an empty payload; payloads under ``min_bytes`` are always responses. Null ids are kept and are
    always responses. Rows that repeat the smallest id of a payload are all responses. Empty table: no rows.
    """
    manifest = write_warc(chunk_rows(pages, min_bytes), new_folder(spark, "warc"))
    return read_warc(manifest, with_chunks=False).filter("is_last").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
