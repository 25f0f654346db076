"""Framed byte formats as tables: MP4 boxes and sample tables, NAL units, ADTS and OBU frames, IVF, EBML, raw planes, PLY.

Files come from Spark's ``binaryFile`` reader, a row a file, and each file's frames
are walked in an Arrow function: rows out, never a driver loop. Truncated or
malformed input ends a walk without an error, as far as it was sound.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomframe.functions import media as M
from loomframe.operators import timeline as T
from loomframe.sources.messages import SAMPLE_RATES

Row = dict[str, object]
#: Boxes that hold boxes.
NESTED = (b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"udta", b"mvex", b"moof", b"traf")


def files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", F.col("content").alias("data"))


def walked_batches(batches: Iterator[pa.RecordBatch], walk: Callable[[bytes], Iterator[Row]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Batches of the frames that ``walk`` finds in (path, data), cut by bytes: many small files share a batch, a large one has several."""
    rows, size = [], 0
    for batch in batches:
        for path, data in zip(batch.column("path"), batch.column("data")):
            path, data = path.as_py(), data.as_py() or b""
            size += 4 * len(data)  # rows may hold tables of any part of the file
            for row in walk(data):
                rows.append({"path": path, **row})
                size += len(row.get("payload") or b"") + 256
                if size > 1 << 22:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)
                    rows, size = [], 0
    if rows:
        yield pa.RecordBatch.from_pylist(rows, schema=schema)


def walked(df: DataFrame, walk: Callable[[bytes], Iterator[Row]], fields: str) -> DataFrame:
    """One row for each frame that ``walk`` finds in ``data``, with the file's path."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    kind = _parse_datatype_string(f"path string, {fields}")
    schema = to_arrow_schema(kind)
    return df.select("path", "data").mapInArrow(lambda batches: walked_batches(batches, walk, schema), kind)


# --- MP4


def boxes(data: bytes, start: int = 0, end: int | None = None, depth: int = 0, within: str = "") -> Iterator[Row]:
    """Boxes in order with their depth and the path of their parents; size 1 has a 64-bit size, size 0 runs to the end."""
    end = len(data) if end is None else end
    while start + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, start)
        head = 8
        if size == 1:
            if start + 16 > end:
                return
            size, head = struct.unpack_from(">Q", data, start + 8)[0], 16
        elif size == 0:
            size = end - start
        if size < head or start + size > end:
            return
        name = kind.decode("latin-1")
        yield {"type": name, "offset": start, "size": size, "header": head, "depth": depth, "within": within}
        if kind in NESTED:
            yield from boxes(data, start + head, start + size, depth + 1, f"{within}/{name}")
        start += size


BOXES = "type string, offset long, size long, header int, depth int, within string"


def _u32s(data: bytes, at: int, n: int, width: int = 1, code: str = "I") -> list[tuple]:
    size = struct.calcsize(f">{code * width}")
    n = max(0, min(n, (len(data) - at) // size))
    return list(struct.iter_unpack(f">{code * width}", data[at : at + n * size]))


def movie_headers(data: bytes) -> Iterator[Row]:
    """The time scale and duration of the first movie box; a file without one is an error."""
    for box in boxes(data):
        if box["type"] == "mvhd" and box["within"] == "/moov":
            body = data[box["offset"] + box["header"] : box["offset"] + box["size"]]
            scale, duration = struct.unpack_from(">IQ", body, 20) if body[0] else struct.unpack_from(">II", body, 12)
            yield {"timescale": scale, "duration": duration}
            return
    raise ValueError("no movie box")


MOVIES = "timescale long, duration long"


def sample_tables(data: bytes) -> Iterator[Row]:
    """One row a track of the first movie box: header fields and its sample tables. Tracks that lack a required table are left out."""
    track: Row | None = None
    number, seen = 0, False
    required = ("timescale", "stts", "sizes", "offsets", "stsc")

    def done(t: Row | None) -> bool:
        return t is not None and all(t.get(k) is not None for k in required) and t.get("track_id") is not None

    for box in boxes(data):
        kind, depth = box["type"], box["depth"]
        if depth == 0:
            if done(track):
                yield track
            track = None
            if kind == "moov" and seen:
                return
            seen = seen or kind == "moov"
        if not seen or "moov" not in f"{box['within']}/{kind}":
            continue
        body = data[box["offset"] + box["header"] : box["offset"] + box["size"]]
        if kind == "trak":
            if done(track):
                yield track
            track, number = {"track_no": number, "sync": None, "fourcc": None, "handler": None, "width": 0, "height": 0}, number + 1
        if track is None or len(body) < 8:
            continue
        version = body[0]
        try:
            if kind == "tkhd":
                track["track_id"] = struct.unpack_from(">I", body, 20 if version else 12)[0]
                track["width"], track["height"] = (x >> 16 for x in struct.unpack_from(">II", body, 88 if version else 76))
            elif kind == "mdhd":
                track["timescale"], track["duration"] = struct.unpack_from(">IQ", body, 20) if version else struct.unpack_from(">II", body, 12)
            elif kind == "hdlr":
                track["handler"] = body[8:12].decode("latin-1")
            elif kind == "stsd" and len(body) >= 16:
                track["fourcc"] = body[12:16].decode("latin-1")
            elif kind == "stts":
                track["stts"] = [{"count": a, "delta": b} for a, b in _u32s(body, 8, struct.unpack_from(">I", body, 4)[0], 2)]
            elif kind == "stss":
                track["sync"] = [a for (a,) in _u32s(body, 8, struct.unpack_from(">I", body, 4)[0])]
            elif kind == "stsz":
                fixed, n = struct.unpack_from(">II", body, 4)
                track["fixed_size"], track["sizes"] = fixed, [] if fixed else [a for (a,) in _u32s(body, 12, n)]
            elif kind in ("stco", "co64"):
                track["offsets"] = [a for (a,) in _u32s(body, 8, struct.unpack_from(">I", body, 4)[0], 1, "Q" if kind == "co64" else "I")]
            elif kind == "stsc":
                track["stsc"] = [{"first_chunk": a, "per_chunk": b} for a, b, _ in _u32s(body, 8, struct.unpack_from(">I", body, 4)[0], 3)]
        except struct.error:
            track = None
    if done(track):
        yield track


TRACKS = "track_no int, track_id long, handler string, fourcc string, width int, height int, timescale long, duration long, fixed_size long, stts array<struct<count:long,delta:long>>, sizes array<long>, sync array<long>, offsets array<long>, stsc array<struct<first_chunk:long,per_chunk:long>>"


def probe(tracks: DataFrame) -> DataFrame:
    """What a file holds: codec, media type, number of samples, seconds (0 without a timescale)."""
    total = F.aggregate("stts", F.lit(0).cast("long"), lambda s, r: s + r["count"])
    samples = F.when(F.col("fixed_size") > 0, total).otherwise(F.size("sizes").cast("long"))
    codec = M.codec_of(F.col("fourcc"))
    return tracks.select("path", "track_id", codec.alias("codec"), M.media_of_handler(F.col("handler")).alias("media"), samples.alias("n_samples"), F.when(F.col("timescale") > 0, F.col("duration") / F.col("timescale")).otherwise(0.0).alias("seconds"), "width", "height")


def samples(tracks: DataFrame) -> DataFrame:
    """The packet table: path, track_id, sample (from 0), pts, size, offset, is_key_frame.

    The tables' entries are taken apart once, and each sample looks back to its run of times, its chunk and the last
    sync sample by windows of its track, so the tables are read once and nothing grows with their product.
    """
    keys = ["path", "track_id"]
    kinds = runs, chunks, sync, sizes = range(4)  # in this order at one sample
    entry = lambda kind, at, of, i, n, v: F.struct(*[F.lit(x).cast("long").alias(c) if x is None or isinstance(x, int) else x.cast("long").alias(c) for c, x in zip(("kind", "at", "of", "i", "n", "v"), (kind, at, of, i, n, v))])
    total = F.aggregate("stts", F.lit(0).cast("long"), lambda s, r: s + r["count"]).cast("int")
    sized = F.when(F.col("fixed_size") > 0, F.array_repeat("fixed_size", total)).otherwise(F.col("sizes"))
    entries = F.concat(
        F.transform("stts", lambda r, i: entry(runs, i, 0, i, r["count"], r["delta"])),
        F.transform("stsc", lambda c, i: entry(chunks, c["first_chunk"], 0, i, c["per_chunk"], None)),
        F.transform("offsets", lambda o, i: entry(chunks, i + 1, 1, i, None, o)),
        F.array(entry(chunks, 0, 1, 0, None, None)),  # a chunk 0 is counted but is nowhere
        F.coalesce(F.transform("sync", lambda k: entry(sync, k - 1, 0, 0, None, None)), F.array().cast("array<struct<kind:long,at:long,of:long,i:long,n:long,v:long>>")),
        F.transform(sized, lambda n, i: entry(sizes, i, 0, i, None, n)),
    )
    rows = tracks.select(*keys, F.col("sync").isNull().alias("every"), F.inline(entries)).repartition("path")
    is_run, is_chunk, is_sync, is_size = (F.col("kind") == k for k in kinds)
    is_place = is_chunk & (F.col("of") == 1)

    w = T.ordered(keys, ["kind", "at", "of", "i"])
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    held = T.last_before(None, keys, ["kind", "at", "of", "i"], F.when(is_chunk & (F.col("of") == 0), F.col("n")))
    rows = rows.withColumn("n", F.when(is_place, held).otherwise(F.col("n")))
    sum_before = lambda value, over: F.coalesce(F.sum(value).over(over), F.lit(0))
    rows = rows.withColumns({"run_at": sum_before(F.when(is_run, F.col("n")), before), "chunk_at": sum_before(F.when(is_place, F.col("n")), before), "base": sum_before(F.when(is_run, F.col("n") * F.col("v")), before)})
    rows = rows.withColumn("at", F.when(is_run, F.col("run_at")).when(is_chunk, F.col("chunk_at")).otherwise(F.col("at")))
    rows = rows.filter(is_sync | is_size | ((is_run | is_place) & (F.col("n") > 0)))

    order = ["at", "kind"]
    back = lambda rule, *columns: T.last_before(None, keys, order, F.when(rule, F.struct(*columns)))
    rows = rows.withColumn("bytes", sum_before(F.when(is_size, F.col("v")), T.ordered(keys, order).rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.withColumns({"run": back(is_run, "at", "n", "v", "base"), "chunk": back(is_place, "at", "n", "v", "bytes"), "key": back(is_sync, "at")})
    inside = lambda c: F.col("at") < F.col(f"{c}.at") + F.col(f"{c}.n")
    found = rows.filter(is_size & inside("run") & inside("chunk") & F.col("chunk.v").isNotNull())
    pts = F.col("run.base") + (F.col("at") - F.col("run.at")) * F.col("run.v")
    offset = F.col("chunk.v") + F.col("bytes") - F.col("chunk.bytes")
    key = F.col("every") | F.coalesce(F.col("key.at") == F.col("at"), F.lit(False))
    return found.select(*keys, F.col("at").alias("sample"), pts.alias("pts"), F.col("v").alias("size"), offset.alias("offset"), key.alias("is_key_frame"))


def packets(index: DataFrame, contents: DataFrame) -> DataFrame:
    """The rows of ``samples`` with their bytes, from files (path, data). Each file meets its index once; a sample beyond the file's end is an error."""
    columns = [c for c in index.columns if c != "path"]
    listed = index.groupBy("path").agg(F.collect_list(F.struct(*columns)).alias("rows"))
    joined = listed.join(contents.select("path", "data"), "path")
    inside = lambda r: F.when(r["offset"] + r["size"] <= F.octet_length("data"), F.substring("data", r["offset"].cast("int") + 1, r["size"].cast("int"))).otherwise(F.raise_error(F.concat(F.lit("a sample beyond the end of "), F.col("path"))).cast("binary"))
    cut = F.transform("rows", lambda r: F.struct(*[r[c].alias(c) for c in columns], inside(r).alias("data")))
    return joined.select("path", F.inline(cut))


# Names of unit types.
NAL_NAMES = {1: "slice", 2: "partition_a", 3: "partition_b", 4: "partition_c", 5: "idr_slice", 6: "sei", 7: "sps", 8: "pps", 9: "delimiter", 10: "end_of_sequence", 11: "end_of_stream", 12: "filler"}


def nal_name(kind: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in NAL_NAMES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, kind), F.concat(F.lit("unknown:"), kind.cast("string")))


def is_coded_picture(kind: Column) -> Column:
    """True for units that hold parts of pictures."""
    return kind.between(1, 5)


# --- elementary streams


def nal_units(data: bytes) -> Iterator[Row]:
    """Units between start codes 00 00 01, without trailing zeros; empty ones are skipped."""
    at = data.find(b"\x00\x00\x01")
    number = 0
    while at >= 0:
        after = data.find(b"\x00\x00\x01", at + 3)
        unit = data[at + 3 : after if after >= 0 else len(data)].rstrip(b"\x00")
        if unit:
            yield {"number": number, "offset": at + 3, "nal_type": unit[0] & 31, "ref_idc": unit[0] >> 5 & 3, "payload": unit}
            number += 1
        at = after


def avcc_units(data: bytes, length_size: int = 4) -> Iterator[Row]:
    at = number = 0
    while at + length_size <= len(data):
        n = int.from_bytes(data[at : at + length_size], "big")
        if at + length_size + n > len(data):
            return
        unit = data[at + length_size : at + length_size + n]
        if unit:
            yield {"number": number, "offset": at + length_size, "nal_type": unit[0] & 31, "ref_idc": unit[0] >> 5 & 3, "payload": unit}
            number += 1
        at += length_size + n


NALS = "number int, offset long, nal_type int, ref_idc int, payload binary"


def without_emulation(payload: bytes) -> bytes:
    """The bytes with each 03 that follows two zeros and stands before 00 to 03 (or the end) taken out."""
    out, zeros = bytearray(), 0
    for k, b in enumerate(payload):
        if zeros >= 2 and b == 3 and (k + 1 == len(payload) or payload[k + 1] <= 3):
            zeros = 0
            continue
        zeros = zeros + 1 if b == 0 else 0
        out.append(b)
    return bytes(out)


def adts_frames(data: bytes) -> Iterator[Row]:
    """Frames of an audio transport stream up to the first bad header."""
    at = number = 0
    while at + 7 <= len(data):
        h = data[at : at + 7]
        if h[0] != 0xFF or h[1] & 0xF6 != 0xF0:
            return
        rate, length = h[2] >> 2 & 15, (h[3] & 3) << 11 | h[4] << 3 | h[5] >> 5
        head = 7 if h[1] & 1 else 9
        if rate >= len(SAMPLE_RATES) or length < head or at + length > len(data):
            return
        yield {"number": number, "offset": at, "size": length, "profile": h[2] >> 6, "sample_rate": SAMPLE_RATES[rate], "channels": (h[2] & 1) << 2 | h[3] >> 6, "payload": data[at + head : at + length]}
        at, number = at + length, number + 1


ADTS = "number int, offset long, size int, profile int, sample_rate int, channels int, payload binary"


def leb128(data: bytes, at: int) -> tuple[int, int] | None:
    """(value, place after it) of a little-endian base-128 number of at most 8 bytes."""
    value = 0
    for k in range(8):
        if at + k >= len(data):
            return None
        value |= (data[at + k] & 127) << 7 * k
        if not data[at + k] & 128:
            return value, at + k + 1
    return None


def obu_units(data: bytes) -> Iterator[Row]:
    at = number = 0
    while at < len(data):
        h = data[at]
        start = at
        at += 2 if h & 4 else 1
        if h & 128 or at > len(data):
            return
        if h & 2:
            found = leb128(data, at)
            if found is None:
                return
            size, at = found
        else:
            size = len(data) - at
        if at + size > len(data):
            return
        yield {"number": number, "offset": start, "obu_type": h >> 3 & 15, "payload": data[at : at + size]}
        at, number = at + size, number + 1


OBUS = "number int, offset long, obu_type int, payload binary"


def ivf_frames(data: bytes) -> Iterator[Row]:
    if data[:4] != b"DKIF" or len(data) < 32:
        return
    at, number = struct.unpack_from("<H", data, 6)[0], 0
    while at + 12 <= len(data):
        size, pts = struct.unpack_from("<IQ", data, at)
        if at + 12 + size > len(data):
            return
        yield {"number": number, "pts": pts if pts < 1 << 63 else None, "payload": data[at + 12 : at + 12 + size]}
        at, number = at + 12 + size, number + 1


IVF = "number int, pts long, payload binary"


def ebml(data: bytes, start: int = 0, end: int | None = None, depth: int = 0) -> Iterator[Row]:
    """Elements of a Matroska file with their depth; sizes beyond the parent, or unknown, are cut to it."""
    end = len(data) if end is None else end
    nested = {0x18538067, 0x1F43B675, 0x1654AE6B, 0xAE, 0xA0, 0x1549A966}
    while start < end:
        n = 9 - data[start].bit_length()
        if n > 4 or start + n >= end:
            return
        ident = int.from_bytes(data[start : start + n], "big")
        at = start + n
        m = 9 - data[at].bit_length()
        if m > 8 or at + m > end:
            return
        size = int.from_bytes(data[at : at + m], "big") & (1 << 7 * m) - 1
        body = at + m
        size = min(size, end - body)
        yield {"id": ident, "offset": start, "size": size, "depth": depth, "payload": None if ident in nested else data[body : body + size]}
        if ident in nested:
            yield from ebml(data, body, body + size, depth + 1)
        start = body + size


EBML = "id long, offset long, size long, depth int, payload binary"


def mkv_blocks(elements: DataFrame) -> DataFrame:
    """Packets of a Matroska file: pts is the cluster's time plus the block's own signed one, in ms; only simple blocks tell key frames."""
    number = F.conv(F.hex("payload"), 16, 10).cast("long")
    timed = elements.withColumn("cluster", T.last_before(None, ["path"], ["offset"], F.when(F.col("id") == 0xE7, number)))
    raw = lambda at, n: F.conv(F.hex(F.substring("payload", at, n)), 16, 10).cast("long")
    relative = F.when(raw(2, 2) >= 32768, raw(2, 2) - 65536).otherwise(raw(2, 2))
    key = (F.col("id") == 0xA3) & (raw(4, 1) >= 128)
    return timed.filter(F.col("id").isin(0xA3, 0xA1) & (F.octet_length("payload") >= 4)).select("path", "offset", (raw(1, 1) - 128).alias("track"), (F.col("cluster") + relative).alias("pts"), key.alias("is_key_frame"), (F.octet_length("payload") - 4).alias("size"))


def raw_frames(df: DataFrame, frame_size: int) -> DataFrame:
    """Frames of fixed size; a file that isn't a whole number of them is an error."""
    n = F.octet_length("data")
    checked = df.withColumn("n", F.when(n % frame_size == 0, n / frame_size).otherwise(F.raise_error(F.concat(F.lit("not a whole number of frames: "), F.col("path")))).cast("int"))
    return checked.filter("n > 0").select("path", "data", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("number")).select("path", "number", F.substring("data", F.col("number") * frame_size + 1, F.lit(frame_size)).alias("payload"))


def ply_points(lines: DataFrame) -> DataFrame:
    """Points of text lines (``value``): those of which the first three fields are numbers."""
    f = F.split(F.trim("value"), r"\s+")
    xyz = [F.get(f, k).try_cast("double").alias(c) for k, c in enumerate("xyz")]
    return lines.select(*xyz).dropna()


def edge_cases(spark: SparkSession) -> DataFrame:
    """Byte patterns (path, data) that every walk must take without failing."""
    cases = {"empty": b"", "zero": b"\0", "ff": b"\xff", "zeros": b"\0" * 64, "ffs": b"\xff" * 64, "one": b"\1", "alternating": b"\0\xff" * 32}
    return spark.createDataFrame([(k, bytearray(v)) for k, v in cases.items()], "path string, data binary")


def synthetic_clip(spark: SparkSession, width: int, height: int, frames: int) -> DataFrame:
    """Luma samples (t, y, x, v) of a moving pattern: (x + 5t) xor (y + 3t), cut to a byte."""
    place = spark.range(frames * height * width).select(F.floor(F.col("id") / (height * width)).alias("t"), (F.floor(F.col("id") / width) % height).alias("y"), (F.col("id") % width).alias("x"))
    return place.withColumn("v", (F.col("x") + F.col("t") * 5).bitwiseXOR(F.col("y") + F.col("t") * 3).bitwiseAND(255))
