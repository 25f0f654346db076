"""Live-ingest records: FLV tags and chunk headers as column arithmetic, AMF0 values as rows, transport-stream packets, checksums."""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomframe.functions import layout as L
from loomframe.operators import timeline as T

# Names of FLV codes.
FRAME_TYPES = {1: "key", 2: "inter", 3: "disposable", 4: "generated", 5: "info"}
VIDEO_CODECS = {2: "h263", 3: "screen", 4: "vp6", 5: "vp6a", 6: "screen2", 7: "avc"}
AVC_PACKETS = {0: "sequence_header", 1: "nalu", 2: "end"}
AUDIO_FORMATS = {0: "pcm", 1: "adpcm", 2: "mp3", 10: "aac", 11: "speex"}
AUDIO_RATES = (5500, 11025, 22050, 44100)
# Sampling frequencies by index.
SAMPLE_RATES = (96000, 88200, 64000, 48000, 44100, 32000, 24000, 22050, 16000, 12000, 11025, 8000, 7350)


def byte_at(data: Column | str, k: int) -> Column:
    """The k-th byte (from 0) as a number; null past the end."""
    column = F.col(data) if isinstance(data, str) else data
    return F.when(F.octet_length(column) > k, F.conv(F.hex(F.substring(column, k + 1, 1)), 16, 10).cast("int"))


def _named(code: Column, names: dict[int, str]) -> Column:
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.when(code.isNotNull(), F.coalesce(F.try_element_at(table, code), F.concat(F.lit("unknown:"), code.cast("string"))))


def video_tags(df: DataFrame, data: str = "data") -> DataFrame:
    """frame_type, codec, avc_packet_type, composition_time (signed 24 bits) and payload of video tags; an empty tag has nulls."""
    first = byte_at(data, 0)
    avc = first.bitwiseAND(15) == 7
    raw = byte_at(data, 2) * 65536 + byte_at(data, 3) * 256 + byte_at(data, 4)
    return df.withColumns({
        "frame_type": _named(F.shiftright(first, 4), FRAME_TYPES),
        "codec": _named(first.bitwiseAND(15), VIDEO_CODECS),
        "avc_packet_type": F.when(avc, _named(byte_at(data, 1), AVC_PACKETS)),
        "composition_time": F.when(avc, F.when(raw >= 1 << 23, raw - (1 << 24)).otherwise(raw)).otherwise(F.lit(0)),
        "payload": F.when(avc, F.expr(f"substring({data}, 6)")).otherwise(F.expr(f"substring({data}, 2)")),
    })


def audio_tags(df: DataFrame, data: str = "data") -> DataFrame:
    first = byte_at(data, 0)
    aac = F.shiftright(first, 4) == 10
    return df.withColumns({
        "format": _named(F.shiftright(first, 4), AUDIO_FORMATS),
        "rate": F.get(F.array(*map(F.lit, AUDIO_RATES)), F.shiftright(first, 2).bitwiseAND(3)),
        "bits": F.when(F.shiftright(first, 1).bitwiseAND(1) == 1, 16).otherwise(8),
        "channels": first.bitwiseAND(1) + 1,
        "is_config": F.coalesce(aac & (byte_at(data, 1) == 0), F.lit(False)),
        "payload": F.when(aac, F.expr(f"substring({data}, 3)")).otherwise(F.expr(f"substring({data}, 2)")),
    })


# --- AMF0


def amf_values(data: bytes) -> Iterator[object]:
    """Values in order: float, bool, str, None, list (strict array) or list of pairs behind "object"; ends at the first malformed one."""
    at = 0
    while at < len(data):
        try:
            value, at = _amf(data, at, 0)
        except (struct.error, IndexError, UnicodeDecodeError, ValueError):
            return
        yield value


def _text(data: bytes, at: int, code: str) -> tuple[str, int]:
    size = struct.calcsize(code)
    (n,) = struct.unpack_from(code, data, at)
    if at + size + n > len(data):
        raise ValueError("short string")
    return data[at + size : at + size + n].decode(), at + size + n


def _amf(data: bytes, at: int, depth: int) -> tuple[object, int]:
    if depth > 64:
        raise ValueError("too deep")
    kind, at = data[at], at + 1
    if kind == 0:
        return struct.unpack_from(">d", data, at)[0], at + 8
    if kind == 1:
        return data[at] != 0, at + 1
    if kind == 2:
        return _text(data, at, ">H")
    if kind == 12:
        return _text(data, at, ">I")
    if kind in (5, 6):
        return None, at
    if kind in (3, 8):
        at += 4 if kind == 8 else 0
        pairs = []
        while data[at : at + 3] != b"\0\0\x09":
            name, at = _text(data, at, ">H")
            value, at = _amf(data, at, depth + 1)
            pairs.append((name, value))
        return ("object", pairs), at + 3
    if kind == 10:
        n, at, items = struct.unpack_from(">I", data, at)[0], at + 4, []
        for _ in range(n):
            value, at = _amf(data, at, depth + 1)
            items.append(value)
        return items, at
    raise ValueError("unknown marker")


def amf_bytes(value: object) -> bytes:
    """The encoding of a value; arrays with names come out as objects."""
    if value is None:
        return b"\x05"
    if isinstance(value, bool):
        return b"\x01" + bytes([value])
    if isinstance(value, (int, float)):
        return b"\x00" + struct.pack(">d", value)
    if isinstance(value, str):
        raw = value.encode()
        return (b"\x02" + struct.pack(">H", len(raw)) if len(raw) < 1 << 16 else b"\x0c" + struct.pack(">I", len(raw))) + raw
    if isinstance(value, list):
        return b"\x0a" + struct.pack(">I", len(value)) + b"".join(map(amf_bytes, value))
    _, pairs = value
    return b"\x03" + b"".join(struct.pack(">H", len(k.encode())) + k.encode() + amf_bytes(v) for k, v in pairs) + b"\0\0\x09"


def amf_first(value: object, name: str) -> object:
    """The first value of that name in an object, else None."""
    if isinstance(value, tuple) and value[0] == "object":
        return next((v for k, v in value[1] if k == name), None)
    return None


def amf_json(value: object) -> object:
    """The value as JSON holds it: objects keep the first value of a name."""
    if isinstance(value, tuple):
        out: dict[str, object] = {}
        for name, item in value[1]:
            out.setdefault(name, amf_json(item))
        return out
    return [amf_json(x) for x in value] if isinstance(value, list) else value


def amf_walk(data: bytes) -> Iterator[dict[str, object]]:
    """One row a value, for ``containers.walked``."""
    for number, value in enumerate(amf_values(data)):
        yield {"number": number, "json": json.dumps(amf_json(value), ensure_ascii=False)}


AMF = "number int, json string"
# Names of ingest commands and what they mean.
COMMANDS = {"connect": "connect", "createStream": "create", "publish": "publish_start", "deleteStream": "publish_stop", "FCUnpublish": "publish_stop", "closeStream": "publish_stop", "releaseStream": "acknowledge", "FCPublish": "acknowledge", "_checkbw": "acknowledge"}


def commands(values: DataFrame) -> DataFrame:
    """(path, command, transaction, event, stream_key) of each message's values: the name, its number, what it means, and the key of a publish."""
    at = lambda k, kind: F.max(F.when(F.col("number") == k, F.try_variant_get(F.try_parse_json("json"), "$", kind)))
    named = values.groupBy("path").agg(at(0, "string").alias("command"), F.coalesce(at(1, "double"), F.lit(0.0)).alias("transaction"), at(3, "string").alias("stream_key"))
    table = F.create_map(*[F.lit(x) for pair in COMMANDS.items() for x in pair])
    event = F.coalesce(F.try_element_at(table, F.col("command")), F.lit("unhandled"))
    return named.select("path", "command", "transaction", event.alias("event"), F.when(F.col("command") == "publish", F.coalesce("stream_key", F.lit(""))).alias("stream_key"))


# --- chunk streams


def chunk_headers(data: bytes, chunk_size: int = 128) -> Iterator[dict[str, object]]:
    """Chunks of one connection: chunk_stream, seq, message_length, message_type, ts, payload, for ``streaming.live.assembled``.

    The four header kinds take what they lack from the stream's last header; kinds 1 and 2 add a delta to its time,
    kind 3 keeps it. A set-chunk-size message (type 1) counts from the next chunk on. Ends where bytes are missing.
    """
    last: dict[int, list[int]] = {}
    left: dict[int, int] = {}
    at = seq = 0
    while at < len(data):
        kind, stream = data[at] >> 6, data[at] & 63
        at += 1
        extra = {0: 1, 1: 2}.get(stream, 0)
        need = extra + (11, 7, 3, 0)[kind]
        if at + need > len(data):
            return
        if extra:
            stream = 64 + int.from_bytes(data[at : at + extra], "little")
            at += extra
        ts, length, kind_of = last.get(stream, [0, 0, 0])
        if kind < 3:
            stamp = int.from_bytes(data[at : at + 3], "big")
            if kind < 2:
                length, kind_of = int.from_bytes(data[at + 3 : at + 6], "big"), data[at + 6]
            at += (11, 7, 3)[kind]
            if stamp == 0xFFFFFF:
                if at + 4 > len(data):
                    return
                stamp, at = int.from_bytes(data[at : at + 4], "big"), at + 4
            ts = stamp if kind == 0 else ts + stamp
        remaining = left.get(stream) or length
        starts = not left.get(stream)
        n = min(remaining, chunk_size)
        if at + n > len(data):
            return
        payload = data[at : at + n]
        last[stream], left[stream], at = [ts, length, kind_of], remaining - n, at + n
        yield {"chunk_stream": stream, "seq": seq, "message_length": length, "message_type": kind_of, "ts": ts, "starts": starts, "payload": payload}
        seq += 1
        if kind_of == 1 and not left[stream] and n >= 4:
            chunk_size = max(1, int.from_bytes(payload[:4], "big") & 0x7FFFFFFF)


CHUNKS = "chunk_stream long, seq long, message_length long, message_type long, ts long, starts boolean, payload binary"


def messages_of(chunks: DataFrame) -> DataFrame:
    """Whole messages (path, chunk_stream, message, message_type, ts, payload) of a file's chunks: those with all their bytes.

    The batch form of ``streaming.live.assembled``: a message has its last chunk's type and time.
    """
    keys = ["path", "chunk_stream"]
    cut = T.segments(chunks, keys, ["seq"], F.col("starts")).withColumn("message", F.col("segment") - 1)
    parts = F.array_sort(F.collect_list(F.struct("seq", "message_type", "ts", "payload")))
    whole = cut.groupBy(*keys, "message").agg(parts.alias("parts"), F.max("message_length").alias("message_length"))
    joined = F.unhex(F.array_join(F.transform("parts", lambda p: F.hex(p["payload"])), ""))
    whole = whole.withColumn("payload", joined).withColumn("last", F.element_at("parts", -1))
    return whole.filter(F.octet_length("payload") >= F.col("message_length")).select(*keys, "message", "last.message_type", "last.ts", "payload")


# --- checksums and transport packets


def crc_table(polynomial: int, width: int, reflected: bool) -> list[int]:
    """Remainders of all bytes for a polynomial, by its bits."""
    out, top, mask = [], 1 << width - 1, (1 << width) - 1
    for b in range(256):
        r = b if reflected else b << width - 8
        for _ in range(8):
            if reflected:
                r = r >> 1 ^ (polynomial if r & 1 else 0)
            else:
                r = (r << 1 ^ (polynomial if r & top else 0)) & mask
        out.append(r)
    return out


_MPEG = crc_table(0x04C11DB7, 32, False)
#: The reflected loop with the polynomial not reflected: not the usual CRC-64, hence its name.
_MIXED64 = crc_table(0x42F0E1EBA9EA3693, 64, True)


def mpeg_crc32(data: bytes) -> int:
    r = 0xFFFFFFFF
    for b in data:
        r = (r << 8 & 0xFFFFFFFF) ^ _MPEG[r >> 24 ^ b]
    return r


def mixed_crc64(data: bytes) -> int:
    r = 0xFFFFFFFFFFFFFFFF
    for b in data:
        r = r >> 8 ^ _MIXED64[(r ^ b) & 255]
    return r ^ 0xFFFFFFFFFFFFFFFF


def transport_packets(payload: bytes, pid: int, counter: int = 0, clock: int | None = None, key: bool = False) -> Iterator[bytes]:
    """188-byte packets of one unit: the first has the start flag and, with ``clock``, its 90 kHz time; the last is stuffed."""
    at, first = 0, True
    while at < len(payload) or first:
        field = b""
        if first and clock is not None:
            base = clock & (1 << 33) - 1
            field = bytes([0x50 if key else 0x10]) + struct.pack(">I", base >> 1) + bytes([(base & 1) << 7 | 0x7E, 0])
        room = 184 - (len(field) + 1 if field else 0)
        rest = payload[at : at + room]
        short = room - len(rest)
        if short and not field:
            field = bytes([0]) + b"\xff" * (short - 2) if short > 1 else b""
            adaptation = bytes([short - 1]) + field[: short - 1]
        else:
            adaptation = bytes([len(field) + short]) + field + b"\xff" * short if field else b""
        flags = 0x30 if adaptation else 0x10
        yield bytes([0x47, (0x40 if first else 0) | pid >> 8, pid & 255, flags | counter & 15]) + adaptation + rest
        counter, at, first = counter + 1, at + len(rest), False


# The identifiers of a transport stream's tables and of its video.
TABLES_PID, MAP_PID, VIDEO_PID = 0, 0x1000, 0x100


def table_packet(pid: int, table: int, body: bytes) -> bytes:
    """A program table as one packet: pointer, header, version 0, check, and stuffing."""
    section = struct.pack(">BHHBBB", table, 0xB000 | len(body) + 9, 1, 0xC1, 0, 0) + body
    section += struct.pack(">I", mpeg_crc32(section))
    return struct.pack(">BHBB", 0x47, 0x4000 | pid, 0x10, 0) + section + b"\xff" * (183 - len(section))


def elementary_packet(payload: bytes, clock: int) -> bytes:
    """A video unit behind its header with a time of 33 bits; the length is 0 where 16 bits can't hold it."""
    clock &= (1 << 33) - 1
    stamp = bytes([0x21 | clock >> 29 & 14, clock >> 22 & 255, clock >> 14 & 255 | 1, clock >> 7 & 255, clock << 1 & 255 | 1])
    size = len(payload) + 8
    return b"\0\0\1\xe0" + struct.pack(">H", size if size < 1 << 16 else 0) + b"\x80\x80\x05" + stamp + payload


def transport_stream(units: Iterator[tuple[bytes, int, bool]]) -> Iterator[bytes]:
    """Packets of a segment of (payload, 90 kHz time, is_key): its two tables, then each unit."""
    yield table_packet(TABLES_PID, 0, struct.pack(">HH", 1, 0xE000 | MAP_PID))
    yield table_packet(MAP_PID, 2, struct.pack(">HHBHH", 0xE000 | VIDEO_PID, 0xF000, 0x1B, 0xE000 | VIDEO_PID, 0xF000))
    counter = 0
    for payload, clock, key in units:
        for packet in transport_packets(elementary_packet(payload, clock), VIDEO_PID, counter, clock, key):
            yield packet
            counter += 1


def transport_headers(df: DataFrame, data: str = "data") -> DataFrame:
    """Packets of transport streams (path, data): path, number, pid, start, counter, payload. A wrong sync byte is an error."""
    n = F.floor(F.octet_length(data) / 188).cast("int")
    packets = df.select("path", data, F.explode(F.when(n > 0, F.sequence(F.lit(0), n - 1))).alias("number")).select("path", "number", F.substring(data, F.col("number") * 188 + 1, F.lit(188)).alias("packet"))
    synced = F.when(byte_at("packet", 0) == 0x47, byte_at("packet", 1)).otherwise(F.raise_error(F.concat(F.lit("no sync byte in "), F.col("path"))).cast("int"))
    second, fourth = F.col("second"), byte_at("packet", 3)
    body = F.when(fourth.bitwiseAND(32) == 0, 4).otherwise(5 + byte_at("packet", 4))
    return packets.withColumn("second", synced).select("path", "number", (second.bitwiseAND(31) * 256 + byte_at("packet", 2)).alias("pid"), (second.bitwiseAND(64) > 0).alias("start"), fourth.bitwiseAND(15).alias("counter"), F.substring("packet", body + 1, F.lit(188)).alias("payload"))


class BitReader:
    """Bits from the highest down, with the unsigned and signed exponential codes of parameter sets."""

    def __init__(self, data: bytes):
        self.value, self.left = int.from_bytes(data, "big"), 8 * len(data)

    def bits(self, n: int) -> int:
        if n > self.left:
            raise EOFError("no bits left")
        self.left -= n
        return self.value >> self.left & (1 << n) - 1

    def ue(self) -> int:
        n = min(33, self.left)
        ahead = self.value >> self.left - n & (1 << n) - 1
        if not ahead:
            raise ValueError("code too long") if n == 33 else EOFError("no bits left")
        zeros = n - ahead.bit_length()
        self.left -= zeros + 1
        return (1 << zeros) - 1 + (self.bits(zeros) if zeros else 0)

    def se(self) -> int:
        k = self.ue()
        return (k + 1) // 2 if k & 1 else -(k // 2)


def picture_size(sps: bytes) -> dict[str, int] | None:
    """What pictures need of a sequence parameter set without its emulation bytes: profile, level, ids, sizes of numbers, width and height; None if it isn't sound."""
    try:
        r = BitReader(sps[1:])
        profile, _, level = r.bits(8), r.bits(8), r.bits(8)
        sps_id = r.ue()
        chroma, planes, lists = 1, 0, 0
        if profile in (44, 83, 86, 100, 110, 118, 122, 128, 138, 139, 244):
            chroma = r.ue()
            if chroma == 3:
                planes = r.bits(1)
            r.ue(), r.ue(), r.bits(1)
            if r.bits(1):
                lists = sum(scaling_list(r, 16 if k < 6 else 64) is not None for k in range(8 if chroma != 3 else 12))
        log2_frame = r.ue() + 4
        order, log2_order, delta_always_zero = r.ue(), 0, 0
        if order == 0:
            log2_order = r.ue() + 4
        elif order == 1:
            delta_always_zero = r.bits(1)
            r.se(), r.se()
            for _ in range(r.ue()):
                r.se()
        refs = r.ue()
        r.bits(1)
        wide, high = r.ue() + 1, r.ue() + 1
        frames_only = r.bits(1)
        if not frames_only:
            r.bits(1)
        r.bits(1)
        crop = [r.ue() for _ in range(4)] if r.bits(1) else [0, 0, 0, 0]
        unit_x, unit_y = (2 if chroma in (1, 2) else 1), (2 if chroma == 1 else 1) * (2 - frames_only)
        return {"sps_id": sps_id, "profile": profile, "level": level, "refs": refs, "separate_planes": planes, "scaling_lists": lists, "log2_frame_num": log2_frame, "order_type": order, "log2_order": log2_order, "delta_always_zero": delta_always_zero, "frames_only": frames_only, "width": 16 * wide - unit_x * (crop[0] + crop[1]), "height": 16 * high * (2 - frames_only) - unit_y * (crop[2] + crop[3])}
    except (EOFError, ValueError):
        return None


SPS = "sps_id int, profile int, level int, refs int, separate_planes int, scaling_lists int, log2_frame_num int, order_type int, log2_order int, delta_always_zero int, frames_only int, width int, height int"


def scaling_list(r: BitReader, size: int) -> list[int] | None:
    """A list of scales as steps from one to the next; None if the list isn't sent. A scale of 0 repeats the last one to the end."""
    if not r.bits(1):
        return None
    out, following = [], 8
    for _ in range(size):
        if following:
            following = (out[-1] if out else 8) + r.se() & 255
        out.append(following or (out[-1] if out else 8))
    return out


def picture_parameters(pps: bytes) -> dict[str, int] | None:
    """What slices need of a picture parameter set without its emulation bytes; None if it isn't sound or has slice groups."""
    try:
        r = BitReader(pps[1:])
        out = {"pps_id": r.ue(), "sps_id": r.ue(), "cabac": r.bits(1), "order_present": r.bits(1)}
        if r.ue():
            return None
        out |= {"refs_l0": r.ue() + 1, "refs_l1": r.ue() + 1, "weighted": r.bits(1), "weighted_bi": r.bits(2), "qp": 26 + r.se(), "qs": 26 + r.se(), "chroma_qp_offset": r.se()}
        return out | {"deblocking_control": r.bits(1), "constrained_intra": r.bits(1), "redundant": r.bits(1)}
    except (EOFError, ValueError):
        return None


PPS = "pps_id int, sps_id int, cabac int, order_present int, refs_l0 int, refs_l1 int, weighted int, weighted_bi int, qp int, qs int, chroma_qp_offset int, deblocking_control int, constrained_intra int, redundant int"
#: Slice types by number, modulo five.
SLICES = "PBI" + "pi"


def slice_header(nal: bytes, sps: dict[str, int], pps: dict[str, int]) -> dict[str, object] | None:
    """A slice's header up to its reference marking, by its parameter sets; None if it isn't sound or has a table of weights.

    ``modifications`` and ``marking`` are lists of (operation, number, second number), as ``operators.references`` takes
    them; marking is None for a sliding window.
    """
    try:
        r = BitReader(nal[1:])
        kind, ref = nal[0] & 31, nal[0] >> 5 & 3
        first, of = r.ue(), SLICES[r.ue() % 5]
        out: dict[str, object] = {"first_mb": first, "slice_type": of, "pps_id": r.ue()}
        if sps["separate_planes"]:
            r.bits(2)
        out["frame_num"] = r.bits(sps["log2_frame_num"])
        field = 0 if sps["frames_only"] else r.bits(1)
        out |= {"field": field, "bottom": r.bits(1) if field else 0, "idr_id": r.ue() if kind == 5 else None, "order": None}
        if sps["order_type"] == 0:
            out["order"] = r.bits(sps["log2_order"])
            if pps["order_present"] and not field:
                r.se()
        elif sps["order_type"] == 1 and not sps["delta_always_zero"]:
            r.se()
            if pps["order_present"] and not field:
                r.se()
        if pps["redundant"]:
            r.ue()
        if of == "B":
            r.bits(1)
        l0, l1 = pps["refs_l0"], pps["refs_l1"]
        if of in "PBp" and r.bits(1):
            l0, l1 = r.ue() + 1, r.ue() + 1 if of == "B" else l1
        out |= {"refs_l0": l0 if of in "PBp" else 0, "refs_l1": l1 if of == "B" else 0}
        lists: list[list[tuple[int, int, int]]] = [[], []]
        for k in range({"P": 1, "p": 1, "B": 2}.get(of, 0)):
            while lists[k] == [] and r.bits(1) or lists[k]:
                op = r.ue()
                if op == 3:
                    break
                if op > 3 or len(lists[k]) > 66:
                    return None
                lists[k].append((op, r.ue(), 0))
        out["modifications"] = lists[0]
        if pps["weighted"] and of in "Pp" or pps["weighted_bi"] == 1 and of == "B":
            return None
        out["marking"] = None
        if ref and kind == 5:
            out["marking"] = [(7, r.bits(1), r.bits(1))]
        elif ref and r.bits(1):
            ops: list[tuple[int, int, int]] = []
            while op := r.ue():
                if op > 6 or len(ops) > 66:
                    return None
                ops.append((op, r.ue() if op in (1, 2, 3, 4, 6) else 0, r.ue() if op == 3 else 0))
            out["marking"] = ops
        return out
    except (EOFError, ValueError, IndexError):
        return None


SLICE = "first_mb int, slice_type string, pps_id int, frame_num int, field int, bottom int, idr_id int, order int, refs_l0 int, refs_l1 int, modifications array<struct<op:int,n:int,m:int>>, marking array<struct<op:int,n:int,m:int>>"


def slice_walk(nal: bytes, sps: dict[str, int], pps: dict[str, int]) -> Iterator[dict[str, object]]:
    """The header as a row of ``SLICE``, for ``containers.walked``."""
    found = slice_header(nal, sps, pps) if nal else None
    if found is not None:
        steps = lambda rows: None if rows is None else [dict(zip(("op", "n", "m"), x)) for x in rows]
        yield found | {"modifications": steps(found["modifications"]), "marking": steps(found["marking"])}


def sequence_header(payload: bytes) -> dict[str, int] | None:
    """Profile, level, largest size, bit depth and subsampling of a sequence header unit's payload; None if it isn't sound."""
    try:
        r = BitReader(payload)
        flag = lambda: r.bits(1)
        profile, still, reduced = r.bits(3), flag(), flag()
        level = tier = delays = 0
        if reduced:
            level = r.bits(5)
        else:
            model = 0
            if flag():
                r.bits(32), r.bits(32)
                if flag():
                    r.ue()
                model = flag()
                if model:
                    delays = r.bits(5) + 1
                    r.bits(32), r.bits(5), r.bits(5)
            display = flag()
            for k in range(r.bits(5) + 1):
                r.bits(12)
                this = r.bits(5)
                this_tier = flag() if this > 7 else 0
                if k == 0:
                    level, tier = this, this_tier
                if model and flag():
                    r.bits(delays), r.bits(delays), flag()
                if display and flag():
                    r.bits(4)
        wide, high = r.bits(4) + 1, r.bits(4) + 1
        width, height = r.bits(wide) + 1, r.bits(high) + 1
        if not reduced and flag():
            r.bits(4), r.bits(3)
        large = flag()
        flag(), flag()
        hints = 0
        if not reduced:
            r.bits(4)
            ordered = flag()
            if ordered:
                r.bits(2)
            screen = 2 if flag() else flag()
            if screen and not flag():
                flag()
            hints = r.bits(3) + 1 if ordered else 0
        r.bits(3)
        deep = flag()
        depth = (12 if flag() else 10) if profile == 2 and deep else 10 if deep else 8
        mono = flag() if profile != 1 else 0
        space = r.bits(24) if flag() else 0x020202
        if mono:
            flag()
            across = down = 1
        elif space == 0x010D00:
            across = down = 0
        else:
            flag()
            across, down = {0: (1, 1), 1: (0, 0)}.get(profile, (1, 0))
            if profile == 2 and depth == 12:
                across = flag()
                down = flag() if across else 0
        return {"profile": profile, "still": still, "level": level, "tier": tier, "width": width, "height": height, "large_blocks": large, "order_hint_bits": hints, "bit_depth": depth, "mono": mono, "across": across, "down": down}
    except (EOFError, ValueError):
        return None


SEQUENCE = "profile int, still int, level int, tier int, width int, height int, large_blocks int, order_hint_bits int, bit_depth int, mono int, across int, down int"


def audio_config(data: Column | str) -> Column:
    """object_type, sample_rate and channels of an audio configuration; null where it is cut short or its rate has no meaning."""
    column = F.col(data) if isinstance(data, str) else data
    bits = L.bits_of(column, 7)
    long_type = L.field(bits, 0, 5) == 31
    at = F.when(long_type, 11).otherwise(5)
    kind = F.when(long_type, 32 + L.field(bits, 5, 6)).otherwise(L.field(bits, 0, 5))
    index = L.field(bits, at, 4)
    rate = F.when(index == 15, L.field(bits, at + 4, 24)).otherwise(F.get(F.array(*map(F.lit, SAMPLE_RATES)), index.cast("int")))
    channels = L.field(bits, at + F.when(index == 15, 28).otherwise(4), 4)
    return F.when(kind.isNotNull() & rate.isNotNull() & channels.isNotNull(), F.struct(kind.cast("int").alias("object_type"), rate.cast("int").alias("sample_rate"), channels.cast("int").alias("channels")))
