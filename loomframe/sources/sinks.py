"""Sinks: playlists and PLY as text, graphs as JSON, samples as an MP4 file."""

from __future__ import annotations

import struct

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomframe.sources import messages


def playlist_text(segments: DataFrame, target: int) -> DataFrame:
    """(stream, m3u8) from rows (stream, media_sequence, index, duration, path); the lines follow the index."""
    line = F.format_string("#EXTINF:%.3f,\n%s", F.col("duration").cast("double"), F.col("path"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("index", line.alias("line")))), lambda s: s["line"]), "\n")
    head = F.format_string(f"#EXTM3U\n#EXT-X-VERSION:3\n#EXT-X-TARGETDURATION:{int(target)}\n#EXT-X-MEDIA-SEQUENCE:%d\n", F.max("media_sequence"))
    return segments.groupBy("stream").agg(F.concat(head, body, F.lit("\n")).alias("m3u8"))


def graph_json(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Node and edge rows as JSON lines, to be written with ``write.text``."""
    return nodes.select(F.to_json(F.struct(F.lit("node").alias("row"), *nodes.columns)).alias("value")).unionByName(edges.select(F.to_json(F.struct(F.lit("edge").alias("row"), *edges.columns)).alias("value")))


def graph_from_json(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, name) and edges (src, dst) of the lines (value) that ``graph_json`` gives."""
    row = lines.select(F.from_json("value", "row string, id long, name string, src long, dst long").alias("r"))
    return row.filter("r.row = 'node'").select("r.id", "r.name"), row.filter("r.row = 'edge'").select("r.src", "r.dst")


def ply_lines(points: DataFrame) -> DataFrame:
    """An ASCII point file's lines (part, value): part 0 is the header, part 1 the points, in no set order."""
    head = points.agg(F.concat(F.lit("ply\nformat ascii 1.0\nelement vertex "), F.count("*").cast("string"), F.lit("\nproperty float x\nproperty float y\nproperty float z\nend_header")).alias("value"))
    return head.select(F.lit(0).alias("part"), "value").unionByName(points.select(F.lit(1).alias("part"), F.concat_ws(" ", *[F.col(c).cast("string") for c in "xyz"]).alias("value")))


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", len(body) + 8, kind) + body


def runs(values: list[int]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for v in values:
        if out and out[-1][1] == v:
            out[-1][0] += 1
        else:
            out.append([1, v])
    return [(n, v) for n, v in out]


def mp4_bytes(samples: list[tuple[bytes, int, bool]], width: int, height: int, timescale: int, fourcc: bytes = b"avc1") -> bytes:
    """A file of one video track, one chunk: samples are (data, duration, is_key). The sync list is left out if none or all are key."""
    data = b"".join(s[0] for s in samples)
    total = sum(s[1] for s in samples)
    full = lambda kind, *parts: _box(kind, b"\0\0\0\0", *parts)
    u32 = lambda *x: struct.pack(f">{len(x)}I", *x)
    ftyp = _box(b"ftyp", b"isom", u32(512), b"isomavc1")
    delta = runs([s[1] for s in samples])
    keys = [k for k, s in enumerate(samples, 1) if s[2]]
    tables = [full(b"stsd", u32(1), _box(fourcc, b"\0" * 6, struct.pack(">H", 1), b"\0" * 16, struct.pack(">HH", width, height), b"\0" * 50)), full(b"stts", u32(len(delta)), *[u32(n, v) for n, v in delta])]
    if 0 < len(keys) < len(samples):
        tables.append(full(b"stss", u32(len(keys), *keys)))
    tables += [full(b"stsz", u32(0, len(samples), *[len(s[0]) for s in samples])), full(b"stsc", u32(1, 1, max(1, len(samples)), 1)), full(b"stco", u32(1, len(ftyp) + 8))]
    matrix = u32(0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    tkhd = full(b"tkhd", u32(0, 0, 1, 0, total), b"\0" * 16, matrix, u32(width << 16, height << 16))
    mdia = _box(b"mdia", full(b"mdhd", u32(0, 0, timescale, total, 0)), full(b"hdlr", u32(0), b"vide", b"\0" * 13), _box(b"minf", _box(b"stbl", *tables)))
    mvhd = full(b"mvhd", u32(0, 0, timescale, total, 0x10000), b"\x01\0" + b"\0" * 10, matrix, b"\0" * 24, u32(2))
    return ftyp + _box(b"mdat", data) + _box(b"moov", mvhd, _box(b"trak", tkhd, mdia))


def muxed(samples: DataFrame, width: int, height: int, timescale: int) -> DataFrame:
    """(stream, file) from rows (stream, seq, data, duration, is_key): a file a stream, its samples in order."""

    def mux(group: pa.Table) -> pa.Table:
        group = group.sort_by("seq")
        rows = list(zip(*[group.column(c).to_pylist() for c in ("data", "duration", "is_key")]))
        return pa.table({"stream": group.column("stream")[:1], "file": pa.array([mp4_bytes(rows, width, height, timescale)], pa.binary())})

    return samples.groupBy("stream").applyInArrow(mux, "stream long, file binary")


def transport_segments(units: DataFrame) -> DataFrame:
    """(segment, file) from rows (segment, seq, data, clock, is_key): a transport stream a segment, its units in order."""

    def mux(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("seq")
        rows = zip(group["data"], group["clock"].astype(int), group["is_key"].astype(bool))
        return pd.DataFrame({"segment": [group["segment"].iloc[0]], "file": [b"".join(messages.transport_stream(rows))]})

    return units.groupBy("segment").applyInPandas(mux, "segment string, file binary")


def write_segments(segments: DataFrame, folder: str, name: str = "playlist.m3u8", keep: int | None = None, target: int = 6) -> None:
    """Segment files (index, duration, file) into a folder, and a playlist of the last ``keep`` that takes the old one's place at once.

    Tasks write the files, each under a name of its own attempt that is then renamed; of the files only their names
    come back. Use it on a batch, or for each batch of a stream by ``foreachBatch``.
    """
    from pyarrow import fs
    from pyspark import TaskContext

    def put(path: str, data: bytes, attempt: str) -> None:
        where, at = fs.FileSystem.from_uri(path)
        where.create_dir(at.rpartition("/")[0], recursive=True)
        with where.open_output_stream(f"{at}.{attempt}.tmp") as out:
            out.write(data)
        where.move(f"{at}.{attempt}.tmp", at)

    def write(frames):
        for frame in frames:
            for index, file in zip(frame["index"], frame["file"]):
                put(f"{folder}/segment{index:05d}.ts", bytes(file), str(TaskContext.get().taskAttemptId()))
            yield frame[["index", "duration"]]

    rows = sorted((r["index"], r["duration"]) for r in segments.select("index", "duration", "file").mapInPandas(write, "index long, duration double").collect())
    gone = max(0, len(rows) - keep) if keep else 0
    if rows:
        spark = segments.sparkSession
        listed = spark.createDataFrame([(0, rows[gone][0], i, d, f"segment{i:05d}.ts") for i, d in rows[gone:]], "stream long, media_sequence long, index long, duration double, path string")
        put(f"{folder}/{name}", playlist_text(listed, target).first()["m3u8"].encode(), "playlist")
