"""Structured Streaming forms of the keyed, stateful operators; each has a batch twin in ``operators`` or ``plans``."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

PACKETS = "stream long, seq long, us long, is_key boolean, data binary"


def assembled(chunks: DataFrame) -> DataFrame:
    """Messages from chunks (conn, chunk_stream, seq, message_length, message_type, ts, payload).

    A stream's buffer grows by its chunks, in order of ``seq`` within each batch, and a message is complete once it
    has ``message_length`` bytes; it carries the last chunk's type and time, and what a chunk holds beyond it begins
    the next message. Batches must come in order: a chunk that arrives after a later one was taken is appended.
    """

    def push(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        buffer = bytes(state.get[0]) if state.exists else b""
        out = []
        rows = pd.concat(list(frames)).sort_values("seq")
        for length, kind, ts, payload in zip(rows["message_length"], rows["message_type"], rows["ts"], rows["payload"]):
            buffer += payload
            if length == 0:
                out.append((key[0], key[1], int(kind), int(ts), b""))
            while len(buffer) >= length > 0:
                out.append((key[0], key[1], int(kind), int(ts), buffer[:length]))
                buffer = buffer[length:]
        state.update((buffer,))
        yield pd.DataFrame(out, columns=["conn", "chunk_stream", "message_type", "ts", "payload"])

    return chunks.groupBy("conn", "chunk_stream").applyInPandasWithState(push, "conn long, chunk_stream long, message_type long, ts long, payload binary", "buffer binary", "append", GroupStateTimeout.NoTimeout)


def playlists(segments: DataFrame, n: int) -> DataFrame:
    """A sliding playlist per stream from segments (stream, index, duration): after each batch the last n and the sequence number of the first."""

    def push(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        index, duration, gone = (list(state.get[0]), list(state.get[1]), state.get[2]) if state.exists else ([], [], 0)
        rows = pd.concat(list(frames)).sort_values("index")
        index, duration = index + rows["index"].tolist(), duration + rows["duration"].tolist()
        over = max(0, len(index) - n)
        index, duration, gone = index[over:], duration[over:], gone + over
        state.update((index, duration, gone))
        yield pd.DataFrame({"stream": key[0], "media_sequence": gone, "index": index, "duration": duration})

    return segments.groupBy("stream").applyInPandasWithState(push, "stream long, media_sequence long, index long, duration double", "index array<long>, duration array<double>, gone long", "update", GroupStateTimeout.NoTimeout)


def field_pairs(fields: DataFrame) -> DataFrame:
    """Frames (stream, frame_num, first_seq, second_seq) of fields (stream, seq, frame_num, bottom).

    One field waits for its mate; a field of another frame takes its place, one of the same parity too.
    """

    def push(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = tuple(state.get) if state.exists else (None, None, None)
        out = []
        rows = pd.concat(list(frames)).sort_values("seq")
        for seq, number, bottom in zip(rows["seq"].tolist(), rows["frame_num"].tolist(), rows["bottom"].tolist()):
            if held[1] == number and held[2] is not None and held[2] != bottom:
                out.append((key[0], number, held[0], seq))
                held = (None, None, None)
            else:
                held = (seq, number, bottom)
        state.update(held)
        yield pd.DataFrame(out, columns=["stream", "frame_num", "first_seq", "second_seq"])

    return fields.groupBy("stream").applyInPandasWithState(push, "stream long, frame_num long, first_seq long, second_seq long", "seq long, frame_num long, bottom boolean", "append", GroupStateTimeout.NoTimeout)


def segment_counts(packets: DataFrame, width: str, late: str) -> DataFrame:
    """Packets and key packets of each stream in windows of event time, with late data up to ``late``: an extension, the batch form has no event time."""
    return packets.withWatermark("ts", late).groupBy(F.window("ts", width), "stream").agg(F.count("*").alias("n_packets"), F.count_if("is_key").alias("n_keys"))


def _frames(buffer: bytes) -> tuple[list[bytes], bytes]:
    """Whole frames behind lengths of four bytes, highest first, and what is left."""
    out = []
    while len(buffer) >= 4 and len(buffer) >= 4 + (n := int.from_bytes(buffer[:4], "big")):
        out.append(buffer[4 : 4 + n])
        buffer = buffer[4 + n :]
    return out, buffer


FRAMES = "conn long, frame long, seq long, payload binary"


def framed(reads: DataFrame) -> DataFrame:
    """Frames (conn, frame, seq, payload) of reads (conn, seq, payload) that cut them anywhere; seq is that of the read that ends one.

    What a read leaves over waits for the next one of its connection. Works on tables and on streams, whose batches
    must come in order.
    """

    def take(key: tuple, rows: pd.DataFrame, buffer: bytes, number: int) -> tuple[pd.DataFrame, bytes, int]:
        out = []
        for seq, payload in rows.sort_values("seq")[["seq", "payload"]].itertuples(index=False):
            whole, buffer = _frames(buffer + bytes(payload))
            for frame in whole:
                out.append((key[0], number, seq, frame))
                number += 1
        return pd.DataFrame(out, columns=["conn", "frame", "seq", "payload"]), buffer, number

    def batch(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return take(key, rows, b"", 0)[0]

    def push(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        buffer, number = (bytes(state.get[0]), state.get[1]) if state.exists else (b"", 0)
        out, buffer, number = take(key, pd.concat(list(frames)), buffer, number)
        state.update((buffer, number))
        yield out

    grouped = reads.groupBy("conn")
    if not reads.isStreaming:
        return grouped.applyInPandas(batch, FRAMES)
    return grouped.applyInPandasWithState(push, FRAMES, "buffer binary, number long", "append", GroupStateTimeout.NoTimeout)


def handled(events: DataFrame, kind: str, handlers: dict[str, Callable[[DataFrame, int], None]], checkpoint: str):
    """A running query that gives each batch's rows of a kind to that kind's handler; kinds without one pass unseen."""

    def dispatch(batch: DataFrame, number: int) -> None:
        kept = batch.persist()
        try:
            for name, handler in handlers.items():
                handler(kept.filter(F.col(kind) == name), number)
        finally:
            kept.unpersist()

    return events.writeStream.foreachBatch(dispatch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
