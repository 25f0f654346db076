"""Token ids as length-delimited binary records, with a separate offset index for shuffled reads.

A shard is one file of frames::

    length   8 bytes, little-endian: bytes of the payload
    check    4 bytes: masked CRC-32 of those 8 bytes
    payload  1 byte has-id, 8 bytes doc_id, then the ids (2 bytes each if the vocabulary allows, else 4)
    check    4 bytes: masked CRC-32 of the payload

The mask turns a checksum right by 15 bits and adds 0xA282EAD8, so that the
checksum of data that hold checksums stays sound. ``<shard>.idx`` has one entry a
record: offset, length and the ids of all records before it in the shard. Each
task writes files of its own name and reports them; only files of the manifest,
which has one row for each task that ended well, are ever read, so retried and
repeated tasks do no harm.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomframe.llm.chunks import sliced
from loomframe.llm.shared import new_folder, partitions, written
from loomframe.llm.tokens import word_bpe

_MASK = 0xA282EAD8
_ENTRY = np.dtype([("offset", "<i8"), ("length", "<i8"), ("before", "<i8")])
#: Bytes of text of a shard, on average.
SHARD = 256 << 20
MANIFEST = "shard long, path string, width int, n_records long, n_ids long, n_bytes long"


def masked_crc(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + _MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return b"".join((length, struct.pack("<I", masked_crc(length)), payload, struct.pack("<I", masked_crc(payload))))


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def _read_frame(file, offset: int, length: int) -> bytes:
    file.seek(offset)
    raw = file.read(length + 16)
    head = raw[:8]
    if struct.unpack("<Q", head)[0] != length or struct.unpack("<I", raw[8:12])[0] != masked_crc(head):
        raise ValueError(f"bad record length at {offset}")
    payload = raw[12:-4]
    if struct.unpack("<I", raw[-4:])[0] != masked_crc(payload):
        raise ValueError(f"bad record checksum at {offset}")
    return payload


def in_id_order(df: DataFrame, shards: int, id_column: str = "doc_id") -> DataFrame:
    """Rows dealt to ``shards`` ranges of near-equal size and sorted by id within each; null ids come first.

    Ranges are of the id and a hash of the row, so an id that repeats often, null too, is dealt over several ranges
    without breaking the order. Ids are compared as whole numbers, exact over all of them.
    """
    order = F.col(id_column).asc_nulls_first()
    return df.repartitionByRange(shards, order, F.xxhash64(*df.columns)).sortWithinPartitions(order)


def write_records(df: DataFrame, tokenizer_path: str, folder: str, end_id: int | None = 1, shards: int | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Encode whole texts with the word vocabulary, append ``end_id`` to each, and write them in ascending id order.

    Returns the manifest, one row a shard. Without a given number there are as many shards as shuffle partitions, and
    more if one would have over ``SHARD`` bytes of text on average. Null or empty texts have only the end id. Ids may
    be any whole numbers of 64 bits; null ones come first and repeated ones stand together, in any order. An empty
    table gives an empty manifest.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    if shards is None:
        n_bytes = rows.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
        shards = max(partitions(spark), -(-n_bytes // SHARD))
    rows = in_id_order(rows, shards)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, context = word_bpe(tokenizer_path), TaskContext.get()
        shard = context.partitionId()
        width = 2 if len(bpe.to_id) <= 1 << 16 and int(bpe.to_id.max()) < 1 << 16 and bpe.library.get_vocab_size() <= 1 << 16 else 4
        path = f"{folder}/part-{shard:06d}-{context.taskAttemptId()}"
        where, name = opened(path)
        kind = f"<u{width}"
        tail = np.array([end_id] if end_id is not None else [], kind).tobytes()
        index, offset, ids_before, n_records, file, entries = [], 0, 0, 0, None, None

        def put(doc_id: int | None, parts: list[bytes]) -> None:
            nonlocal offset, ids_before, n_records
            payload = b"".join([struct.pack("<?q", doc_id is not None, doc_id or 0), *parts, tail])
            file.write(frame(payload))
            index.append((offset, len(payload), ids_before))
            offset += len(payload) + 16
            ids_before += (len(payload) - 9) // width
            n_records += 1

        try:
            for batch in sliced(batches):
                if file is None:
                    where.create_dir(name.rpartition("/")[0], recursive=True)
                    file = where.open_output_stream(name, buffer_size=1 << 20)
                    entries = where.open_output_stream(f"{name}.idx", buffer_size=1 << 16)
                doc_ids = batch.column("doc_id").to_pylist()
                long_parts: list[bytes] = []
                open_row = None
                for lo, hi, ids, counts in bpe.encode_windows(batch.column("text")):
                    raw = ids.astype(kind).tobytes()
                    if open_row is not None and open_row != lo:
                        put(doc_ids[open_row], long_parts)
                        long_parts, open_row = [], None
                    if hi == lo + 1:
                        long_parts.append(raw)
                        open_row = lo
                        continue
                    ends = (np.cumsum(counts) * width).tolist()
                    begin = 0
                    for k, end in enumerate(ends, lo):
                        put(doc_ids[k], [raw[begin:end]])
                        begin = end
                if open_row is not None:
                    put(doc_ids[open_row], long_parts)
                entries.write(np.array(index, _ENTRY).tobytes())
                index.clear()
        finally:
            for opened_file in (file, entries):
                if opened_file is not None:
                    opened_file.close()
        if file is not None:
            yield pa.RecordBatch.from_pylist([{"shard": shard, "path": path, "width": width, "n_records": n_records, "n_ids": ids_before, "n_bytes": offset}], schema=pa.schema([("shard", pa.int64()), ("path", pa.string()), ("width", pa.int32()), ("n_records", pa.int64()), ("n_ids", pa.int64()), ("n_bytes", pa.int64())]))

    return written(rows.mapInArrow(write, MANIFEST), "records-manifest")


def _reads(manifest: DataFrame, read_bytes: int) -> DataFrame:
    """One row for each range of records to read: about ``read_bytes`` of a shard; start is the ids of all shards before."""
    shards = manifest.orderBy("shard").collect()  # one row a shard, as many as tasks wrote
    rows, base = [], 0
    for x in shards:
        n = max(1, -(-x["n_bytes"] // read_bytes))
        rows += [(x["path"], x["width"], x["n_records"] * k // n, x["n_records"] * (k + 1) // n, base) for k in range(n)]
        base += x["n_ids"]
    spark = manifest.sparkSession
    return spark.createDataFrame(rows, "path string, width int, first long, last long, base long").repartition(max(1, min(len(rows), 4 * partitions(spark))))


def read_records(manifest: DataFrame, read_bytes: int = 32 << 20, with_ids: bool = False, shuffle_seed: int | None = None) -> DataFrame:
    """Records read back: doc_id, start (ids of all records before), n_tokens, ids_crc32, and with_ids also ids.

    Every frame's checksums are verified. With ``shuffle_seed`` each range is read in a random order through the index.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for task in (row for batch in batches for row in batch.to_pylist()):
            where, name = opened(task["path"])
            with where.open_input_file(f"{name}.idx") as file:
                file.seek(task["first"] * _ENTRY.itemsize)
                index = np.frombuffer(file.read((task["last"] - task["first"]) * _ENTRY.itemsize), _ENTRY)
            if shuffle_seed is not None:
                index = np.random.default_rng([shuffle_seed, zlib.crc32(name.encode()), task["first"]]).permutation(index)
            out: list[dict] = []
            with where.open_input_file(name) as file:
                for offset, length, before in index.tolist():
                    payload = _read_frame(file, offset, length)
                    known, doc_id = struct.unpack("<?q", payload[:9])
                    ids = np.frombuffer(payload, f"<u{task['width']}", offset=9).astype("<u4")
                    row = {"doc_id": doc_id if known else None, "start": task["base"] + before, "n_tokens": len(ids), "ids_crc32": zlib.crc32(ids.tobytes())}
                    out.append(row | ({"ids": ids.astype(np.int32)} if with_ids else {}))
                    if len(out) >= (64 if with_ids else 4096):
                        yield pa.RecordBatch.from_pylist(out, schema=arrow)
                        out = []
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=arrow)

    arrow = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())] + ([("ids", pa.list_(pa.int32()))] if with_ids else []))
    return _reads(manifest, read_bytes).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else ""))


def token_records(spark: SparkSession, df: DataFrame, tokenizer_path: str, **kinds) -> DataFrame:
    """Write all texts as records in the shared folder and read the files back."""
    return read_records(write_records(df, tokenizer_path, new_folder(spark, "records"), **kinds))
