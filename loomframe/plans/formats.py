"""Queries of sources and sinks: byte streams are built from the tables, read by the library's sources, and compared with the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomframe.functions import layout as L
from loomframe.operators import timeline as T
from loomframe.plans.registry import ORDER, dealt, events, query
from loomframe.sources import containers as C
from loomframe.sources import messages as R
from loomframe.sources import sinks

_NTH = "row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)"
_NAL_TYPES = {"click": 0x65, "view": 0x41, "purchase": 0x06, "signup": 0x67}
_NAL_SQL = f"""SELECT CAST(user_id AS VARCHAR) AS path, CAST({_NTH} - 1 AS INTEGER) AS number, h % 32 AS nal_type, h // 32 % 4 AS ref_idc, length(props) + 1 AS n_bytes,
      CASE h WHEN 101 THEN 'idr_slice' WHEN 65 THEN 'slice' WHEN 6 THEN 'sei' WHEN 103 THEN 'sps' ELSE 'pps' END AS name, h IN (101, 65) AS coded
    FROM (SELECT *, CASE event_type WHEN 'click' THEN 101 WHEN 'view' THEN 65 WHEN 'purchase' THEN 6 WHEN 'signup' THEN 103 ELSE 104 END AS h FROM events)"""


def _mapped(values: dict[str, int], otherwise: int) -> Column:
    out = F.lit(otherwise)
    for name, value in values.items():
        out = F.when(F.col("event_type") == name, F.lit(value)).otherwise(out)
    return out


def _streams(t, piece: Column, head: str | Column = "") -> DataFrame:
    """A file for each user: the head and a piece for each of their events."""
    return L.stream(events(t, "props", "value").withColumn("path", F.col("user_id").cast("string")), ["path"], ORDER, piece, head)


def _units(walked: DataFrame) -> DataFrame:
    return walked.select("path", "number", "nal_type", "ref_idc", F.octet_length("payload").alias("n_bytes"), C.nal_name(F.col("nal_type")).alias("name"), C.is_coded_picture(F.col("nal_type")).alias("coded"))


@query(_NAL_SQL)
def nal_annexb(t):
    unit = F.concat(F.lit("00000001"), L.be(_mapped(_NAL_TYPES, 0x68), 1), F.hex("props"))
    return _units(C.walked(_streams(t, unit), C.nal_units, C.NALS))


@query(_NAL_SQL)
def nal_avcc(t):
    unit = F.concat(L.be(F.octet_length("props") + 1, 4), L.be(_mapped(_NAL_TYPES, 0x68), 1), F.hex("props"))
    return _units(C.walked(_streams(t, unit), C.avcc_units, C.NALS))


@query("""SELECT event_id, CAST(octet_length(encode(props)) AS BIGINT) AS n_bytes, props AS plain FROM events""")
def emulation(t):
    """Payloads with zeros between, written with emulation bytes and read without them; the zeros are taken out to compare."""
    zeros = F.col("props").cast("binary")
    escaped = F.unhex(F.regexp_replace(F.hex(zeros), "(..)", "$1" + "00000300"))
    read = C.walked(dealt(t("events"), "event_id").select(F.col("event_id").cast("string").alias("path"), escaped.alias("data")), _without_emulation, "payload binary")
    plain = F.decode(F.unhex(F.regexp_replace(F.hex("payload"), "(..)000000", "$1")), "UTF-8")
    return read.select(F.col("path").cast("long").alias("event_id"), (F.octet_length("payload") / 4).cast("long").alias("n_bytes"), plain.alias("plain"))


def _without_emulation(data: bytes):
    yield {"payload": C.without_emulation(data)}


_RATES_SQL = "[" + ", ".join(map(str, R.SAMPLE_RATES)) + "]"


@query(f"""SELECT CAST(user_id AS VARCHAR) AS path, CAST({_NTH} - 1 AS INTEGER) AS number, length(props) + 7 AS size, {_RATES_SQL}[event_id % 13 + 1] AS sample_rate, event_id % 7 + 1 AS channels FROM events""")
def adts_frames(t):
    size, channels = F.octet_length("props") + 7, F.col("event_id") % 7 + 1
    head = [F.lit("FFF1"), L.be(F.lit(64).cast("long") + F.col("event_id") % 13 * 4 + F.shiftright(channels, 2), 1), L.be(channels.bitwiseAND(3) * 64 + F.shiftright(size, 11), 1), L.be(F.shiftright(size, 3).bitwiseAND(255), 1), L.be(size.bitwiseAND(7) * 32 + 31, 1), F.lit("FC")]
    return C.walked(_streams(t, F.concat(*head, F.hex("props"))), C.adts_frames, C.ADTS).select("path", "number", "size", "sample_rate", "channels")


@query(f"""SELECT CAST(user_id AS VARCHAR) AS path, CAST({_NTH} - 1 AS INTEGER) AS number, event_id % 8 + 1 AS obu_type, length(props) * (event_id % 30 + 1) AS n_bytes FROM events""")
def obu_units(t):
    body = F.repeat(F.hex("props"), (F.col("event_id") % 30 + 1).cast("int"))
    n = F.length(body) / 2
    size = F.when(n < 128, L.be(n, 1)).otherwise(F.concat(L.be(n.cast("long").bitwiseAND(127) + 128, 1), L.be(F.shiftright(n.cast("long"), 7), 1)))
    unit = F.concat(L.be((F.col("event_id") % 8 + 1) * 8 + 2, 1), size, body)
    return C.walked(_streams(t, unit), C.obu_units, C.OBUS).select("path", "number", "obu_type", F.octet_length("payload").alias("n_bytes"))


@query(f"""SELECT CAST(user_id AS VARCHAR) AS path, CAST({_NTH} - 1 AS INTEGER) AS number, epoch_us(ts) AS pts, props AS payload FROM events""")
def ivf_frames(t):
    frame = F.concat(L.le(F.octet_length("props"), 4), L.le(F.col("us"), 8), F.hex("props"))
    head = b"DKIF\x00\x00\x20\x00AV01".hex() + "00" * 20
    return C.walked(_streams(t, frame, head), C.ivf_frames, C.IVF).select("path", "number", "pts", F.col("payload").cast("string").alias("payload"))


@query(f"""WITH n AS (SELECT *, {_NTH} AS k, min(epoch_us(ts)) OVER (PARTITION BY user_id) // 1000 % 2147483648 AS cluster FROM events)
    SELECT CAST(user_id AS VARCHAR) AS path, 1 AS track, cluster + k * 7 - 100 AS pts, event_type = 'click' AS is_key_frame, length(props) AS size FROM n""")
def mkv_packets(t):
    """A segment of unknown size with a cluster a user; block times are relative to it and may be negative."""
    numbered = events(t, "props").withColumn("k", F.row_number().over(T.ordered(["user_id"], ORDER)))
    key = F.when(F.col("event_type") == "click", "80").otherwise("00")
    n = F.octet_length("props") + 4
    block = F.concat(F.lit("A3"), L.be(n.cast("long").bitwiseOR(0x10000000), 4), F.lit("81"), L.be((F.col("k") * 7 - 100).cast("long").bitwiseAND(0xFFFF), 2), key, F.hex("props"))
    start = F.floor(F.min("us") / 1000) % 2147483648
    head = F.concat(F.lit("1853806701FFFFFFFFFFFFFF" + "1F43B67501FFFFFFFFFFFFFF" + "E784"), L.be(start, 4))
    files = L.stream(numbered.withColumn("path", F.col("user_id").cast("string")), ["path"], ORDER, block, head)
    return C.mkv_blocks(C.walked(files, C.ebml, C.EBML)).select("path", "track", "pts", "is_key_frame", "size")


@query("""SELECT event_id, ['key', 'inter', 'disposable', 'generated', 'info'][event_id % 5 + 1] AS frame_type, 'avc' AS codec, ['sequence_header', 'nalu', 'end'][event_id % 3 + 1] AS avc_packet_type, event_id % 2001 - 1000 AS composition_time, props AS payload FROM events""")
def flv_video(t):
    e = F.col("event_id")
    tag = F.concat(L.be((e % 5 + 1) * 16 + 7, 1), L.be(e % 3, 1), L.be((e % 2001 - 1000).bitwiseAND(0xFFFFFF), 3), F.hex("props"))
    return R.video_tags(t("events").select("event_id", F.unhex(tag).alias("data"))).select("event_id", "frame_type", "codec", "avc_packet_type", "composition_time", F.col("payload").cast("string").alias("payload"))


@query("""SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'aac' ELSE 'mp3' END AS format, [5500, 11025, 22050, 44100][event_id % 4 + 1] AS rate, CASE WHEN event_id % 3 = 0 THEN 16 ELSE 8 END AS bits, CASE WHEN event_id % 5 = 0 THEN 2 ELSE 1 END AS channels, event_id % 2 = 0 AND event_id % 7 = 0 AS is_config, props AS payload FROM events""")
def flv_audio(t):
    e = F.col("event_id")
    flag = lambda rule: F.when(rule, 1).otherwise(0)
    aac = e % 2 == 0
    tag = F.concat(L.be(F.when(aac, 160).otherwise(32) + e % 4 * 4 + flag(e % 3 == 0) * 2 + flag(e % 5 == 0), 1), F.when(aac, F.when(e % 7 == 0, "00").otherwise("01")).otherwise(""), F.hex("props"))
    return R.audio_tags(t("events").select("event_id", F.unhex(tag).alias("data"))).select("event_id", "format", "rate", "bits", "channels", "is_config", F.col("payload").cast("string").alias("payload"))


@query(f"SELECT CAST(user_id AS VARCHAR) AS path, CAST({_NTH} - 1 AS INTEGER) AS number, printf('%016X', event_id) AS payload FROM events")
def raw_frames(t):
    return C.raw_frames(_streams(t, L.be(F.col("event_id"), 8)), 8).select("path", "number", F.hex("payload").alias("payload"))


@query("SELECT CAST(p_size AS DOUBLE) AS x, p_retailprice AS y, p_partkey / 4 AS z FROM part")
def ply_round_trip(t):
    points = t("part").select(F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("y"), (F.col("p_partkey") / 4).alias("z"))
    return C.ply_points(sinks.ply_lines(points).select(F.explode(F.split("value", "\n")).alias("value")))


# --- MP4


def _movies(t) -> DataFrame:
    frames = events(t, "props").withColumn("seq", F.row_number().over(T.ordered(["user_id"], ORDER)).cast("long"))
    rows = frames.select(F.col("user_id").alias("stream"), "seq", F.col("props").cast("binary").alias("data"), (F.col("event_id") % 3 + 1).alias("duration"), (F.col("event_type") == "click").alias("is_key"))
    return sinks.muxed(rows, 320, 240, 30_000).select(F.col("stream").cast("string").alias("path"), F.col("file").alias("data"))


_SAMPLE_SQL = """m AS (SELECT *, row_number() OVER w - 1 AS sample, coalesce(sum(event_id % 3 + 1) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pts,
      32 + coalesce(sum(length(props)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS "offset",
      count(*) FILTER (event_type = 'click') OVER (PARTITION BY user_id) AS keys FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"""


@query(f"""WITH {_SAMPLE_SQL} SELECT CAST(user_id AS VARCHAR) AS path, sample, CAST(pts AS BIGINT) AS pts, length(props) AS size, CAST("offset" AS BIGINT) AS "offset", keys = 0 OR event_type = 'click' AS is_key_frame, props AS data FROM m""")
def mp4_packets(t):
    """Muxed, read back by the sample tables, with the bytes of each sample; without a sync list every sample is a key frame."""
    # one exchange, which the index and the bytes both read: the join's own filter of null paths would part them
    files = dealt(_movies(t).filter("path is not null"), "path")
    index = C.samples(C.walked(files, C.sample_tables, C.TRACKS)).drop("track_id")
    return C.packets(index, files).select("path", "sample", "pts", "size", "offset", "is_key_frame", F.col("data").cast("string").alias("data"))


@query("""WITH u AS (SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'click') AS keys FROM events GROUP BY user_id),
    k AS (SELECT * FROM (VALUES ('ftyp', 0), ('mdat', 0), ('moov', 0), ('mvhd', 1), ('trak', 1), ('tkhd', 2), ('mdia', 2), ('mdhd', 3), ('hdlr', 3), ('minf', 3), ('stbl', 4), ('stsd', 5), ('stts', 5), ('stss', 5), ('stsz', 5), ('stsc', 5), ('stco', 5)) AS v(type, depth))
    SELECT type, depth, count(*) AS n FROM k JOIN u ON type <> 'stss' OR 0 < keys AND keys < n GROUP BY type, depth""")
def mp4_boxes(t):
    return C.walked(_movies(t), C.boxes, C.BOXES).groupBy("type", "depth").agg(F.count("*").alias("n"))


@query("SELECT CAST(user_id AS VARCHAR) AS path, 30000 AS timescale, CAST(sum(event_id % 3 + 1) AS BIGINT) AS duration FROM events GROUP BY user_id")
def mp4_movies(t):
    return C.walked(_movies(t), C.movie_headers, C.MOVIES)


@query("""SELECT json_object('path', CAST(user_id AS VARCHAR), 'track_id', 1, 'codec', 'h264', 'media', 'video', 'n_samples', count(*), 'width', 320, 'height', 240)::VARCHAR AS probe FROM events GROUP BY user_id""")
def probe_json(t):
    found = C.probe(C.walked(_movies(t), C.sample_tables, C.TRACKS))
    return found.select(F.to_json(F.struct("path", "track_id", "codec", "media", "n_samples", "width", "height")).alias("probe"))


# --- parameter sets and headers


@query("""SELECT p_partkey, p_partkey % 32 AS sps_id, 66 AS profile, 30 AS level, p_size % 4 AS refs, (p_size + 1) * 16 - 2 * (p_partkey % 3) AS width, (p_partkey % 50 + 1) * 16 - 2 * (p_partkey % 5) AS height FROM part""")
def sps_parse(t):
    k, s = F.col("p_partkey"), F.col("p_size")
    bits = F.concat(L.binary(66, 8), L.binary(0, 8), L.binary(30, 8), L.exp_golomb(k % 32), L.exp_golomb(0), L.exp_golomb(2), L.exp_golomb(s % 4), F.lit("0"), L.exp_golomb(s), L.exp_golomb(k % 50), F.lit("111"), L.exp_golomb(0), L.exp_golomb(k % 3), L.exp_golomb(0), L.exp_golomb(k % 5), F.lit("01"))
    files = dealt(t("part"), "p_partkey").select(k.cast("string").alias("path"), F.unhex(F.concat(F.lit("67"), F.hex(L.bytes_of_bits(bits)))).alias("data"))
    return C.walked(files, _sps, R.SPS).select(F.col("path").cast("long").alias("p_partkey"), "sps_id", "profile", "level", "refs", "width", "height")


def _sps(data: bytes):
    found = R.picture_size(data)
    if found:
        yield found


@query("""SELECT p_partkey, p_partkey % 7 AS pps_id, p_partkey % 3 AS sps_id, p_size % 2 AS cabac, p_partkey % 4 + 1 AS refs_l0, p_size % 3 + 1 AS refs_l1, 26 + p_size % 25 - 12 AS qp, p_partkey % 9 - 4 AS chroma_qp_offset, p_partkey % 2 AS deblocking_control FROM part""")
def pps_parse(t):
    k, s = F.col("p_partkey"), F.col("p_size")
    bits = F.concat(L.exp_golomb(k % 7), L.exp_golomb(k % 3), L.binary(s % 2, 1), F.lit("0"), L.exp_golomb(0), L.exp_golomb(k % 4), L.exp_golomb(s % 3), F.lit("000"), L.signed_exp_golomb(s % 25 - 12), L.signed_exp_golomb(F.lit(0)), L.signed_exp_golomb(k % 9 - 4), L.binary(k % 2, 1), F.lit("001"))
    files = dealt(t("part"), "p_partkey").select(k.cast("string").alias("path"), F.unhex(F.concat(F.lit("68"), F.hex(L.bytes_of_bits(bits)))).alias("data"))
    return C.walked(files, _pps, R.PPS).select(F.col("path").cast("long").alias("p_partkey"), "pps_id", "sps_id", "cabac", "refs_l0", "refs_l1", "qp", "chroma_qp_offset", "deblocking_control")


def _pps(data: bytes):
    found = R.picture_parameters(data)
    if found:
        yield found


_SLICE_SPS = {"separate_planes": 0, "log2_frame_num": 4, "frames_only": 1, "order_type": 0, "log2_order": 8, "delta_always_zero": 0}
_SLICE_PPS = {"order_present": 0, "redundant": 0, "refs_l0": 2, "refs_l1": 1, "weighted": 0, "weighted_bi": 0}


@query("""SELECT event_id, event_id % 100 AS first_mb, CASE WHEN event_type = 'click' THEN 'I' ELSE 'P' END AS slice_type, user_id % 16 AS frame_num, event_id % 256 AS "order",
      CASE WHEN event_type = 'click' THEN user_id % 5 END AS idr_id, CASE WHEN event_type = 'click' THEN 0 ELSE 2 + event_id % 2 END AS refs_l0,
      CASE WHEN event_type = 'click' THEN '' WHEN event_id % 3 = 0 THEN '0:' || (event_id % 4) || ' 2:' || (event_id % 6) ELSE '' END AS modifications,
      CASE WHEN event_type = 'click' THEN '7:0:1' WHEN event_id % 5 = 0 THEN '3:' || (event_id % 3) || ':' || (event_id % 2) || ' 5:0:0' END AS marking FROM events""")
def slice_headers(t):
    e, key = F.col("event_id"), F.col("event_type") == "click"
    changes = F.when(e % 3 == 0, F.concat(F.lit("1"), L.exp_golomb(0), L.exp_golomb(e % 4), L.exp_golomb(2), L.exp_golomb(e % 6), L.exp_golomb(3))).otherwise(F.lit("0"))
    override = F.when(e % 2 == 1, F.concat(F.lit("1"), L.exp_golomb(2))).otherwise(F.lit("0"))
    marks = F.when(e % 5 == 0, F.concat(F.lit("1"), L.exp_golomb(3), L.exp_golomb(e % 3), L.exp_golomb(e % 2), L.exp_golomb(5), L.exp_golomb(0))).otherwise(F.lit("0"))
    kind = F.when(key, L.exp_golomb(7)).otherwise(L.exp_golomb(5))
    bits = F.concat(L.exp_golomb(e % 100), kind, L.exp_golomb(0), L.binary(F.col("user_id") % 16, 4), F.when(key, L.exp_golomb(F.col("user_id") % 5)).otherwise(""), L.binary(e % 256, 8), F.when(key, F.lit("01")).otherwise(F.concat(override, changes, marks)), F.lit("1"))
    nal = F.unhex(F.concat(F.when(key, "65").otherwise("61"), F.hex(L.bytes_of_bits(bits))))
    found = C.walked(dealt(t("events"), "event_id").select(e.cast("string").alias("path"), nal.alias("data")), _slices, R.SLICE)
    listed = lambda c, text: F.array_join(F.transform(c, text), " ")
    pair, triple = lambda x: F.concat_ws(":", x["op"], x["n"]), lambda x: F.concat_ws(":", x["op"], x["n"], x["m"])
    return found.select(F.col("path").cast("long").alias("event_id"), "first_mb", "slice_type", "frame_num", "order", "idr_id", "refs_l0", listed("modifications", pair).alias("modifications"), listed("marking", triple).alias("marking"))


def _slices(data: bytes):
    return R.slice_walk(data, _SLICE_SPS, _SLICE_PPS)


@query("""SELECT p_partkey, p_partkey % 2 AS profile, p_size % 24 AS level, CASE WHEN p_size % 24 > 7 THEN p_partkey % 2 ELSE 0 END AS tier, p_size * 16 + 1 AS width, p_partkey % 1000 + 1 AS height, CASE WHEN p_size % 3 = 0 THEN 10 ELSE 8 END AS bit_depth, CASE WHEN p_partkey % 2 = 0 THEN p_size % 2 ELSE 0 END AS mono, 7 AS order_hint_bits FROM part""")
def av1_sequence(t):
    k, s = F.col("p_partkey"), F.col("p_size")
    level = s % 24
    operating = F.concat(L.binary(0, 5), L.binary(0, 12), L.binary(level, 5), F.when(level > 7, L.binary(k % 2, 1)).otherwise(""))
    size = F.concat(L.binary(10, 4), L.binary(9, 4), L.binary(s * 16, 11), L.binary(k % 1000, 10))
    colour = F.concat(L.binary(F.when(s % 3 == 0, 1).otherwise(0), 1), F.when(k % 2 == 0, F.concat(L.binary(s % 2, 1), F.lit("0"), F.when(s % 2 == 1, "0").otherwise("000"))).otherwise("000"))
    bits = F.concat(L.binary(k % 2, 3), F.lit("00" + "0" + "0"), operating, size, F.lit("0" + "100" + "0000" + "111" + "11" + "110" + "011"), colour, F.lit("10"))
    found = C.walked(dealt(t("part"), "p_partkey").select(k.cast("string").alias("path"), L.bytes_of_bits(bits).alias("data")), _sequences, R.SEQUENCE)
    return found.select(F.col("path").cast("long").alias("p_partkey"), "profile", "level", "tier", "width", "height", "bit_depth", "mono", "order_hint_bits")


def _sequences(data: bytes):
    found = R.sequence_header(data)
    if found:
        yield found


@query(f"""SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 32 + p_size % 10 ELSE p_size % 30 + 1 END AS object_type, CASE WHEN p_partkey % 3 = 0 THEN p_partkey * 7 ELSE {_RATES_SQL}[p_size % 13 + 1] END AS sample_rate, p_size % 8 AS channels FROM part""")
def audio_configs(t):
    k, s = F.col("p_partkey"), F.col("p_size")
    kind = F.when(k % 4 == 0, F.concat(F.lit("11111"), L.binary(s % 10, 6))).otherwise(L.binary(s % 30 + 1, 5))
    rate = F.when(k % 3 == 0, F.concat(F.lit("1111"), L.binary(k * 7, 24))).otherwise(L.binary(s % 13, 4))
    data = t("part").select("p_partkey", L.bytes_of_bits(F.concat(kind, rate, L.binary(s % 8, 4))).alias("data"))
    return data.select("p_partkey", R.audio_config("data").alias("c")).select("p_partkey", "c.*")


# --- live ingest and segments


@query("SELECT CAST(conv_id AS VARCHAR) AS path, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS message, turn * 20 AS ts, text FROM conversations WHERE text IS NOT NULL")
def chunk_messages(t):
    """Each conversation as one connection of 128-byte chunks, read back as whole messages."""
    turns = t("conversations").filter("text is not null").select(F.col("conv_id").cast("string").alias("path"), "turn", F.hex("text").alias("h"))
    n = F.length("h") / 2
    pieces = F.array_join(F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(n / 128) - 1, F.lit(0)).cast("int")), lambda k: F.substr("h", k * 256 + 1, F.lit(256))), "C3")
    message = F.concat(F.lit("03"), L.be(F.col("turn") * 20, 3), L.be(n, 3), F.lit("0901000000"), pieces)
    found = R.messages_of(C.walked(L.stream(turns, ["path"], ["turn"], message), R.chunk_headers, R.CHUNKS))
    return found.select("path", "message", "ts", F.decode("payload", "UTF-8").alias("text"))


_DOUBLES = ("3FF0000000000000", "4000000000000000", "4008000000000000", "4010000000000000", "4014000000000000")
_COMMANDS = ["connect", "createStream", "publish", "deleteStream", "FCPublish", "play"]


@query("""WITH c AS (SELECT event_id, user_id, ['connect', 'createStream', 'publish', 'deleteStream', 'FCPublish', 'play'][event_id % 6 + 1] AS command FROM events)
    SELECT CAST(event_id AS VARCHAR) AS path, command, CAST(event_id % 5 + 1 AS DOUBLE) AS transaction,
      CASE command WHEN 'connect' THEN 'connect' WHEN 'createStream' THEN 'create' WHEN 'publish' THEN 'publish_start' WHEN 'deleteStream' THEN 'publish_stop' WHEN 'FCPublish' THEN 'acknowledge' ELSE 'unhandled' END AS event,
      CASE WHEN command = 'publish' THEN 'key' || user_id END AS stream_key FROM c""")
def ingest_commands(t):
    e = F.col("event_id")
    text = lambda c: F.concat(F.lit("02"), L.be(F.octet_length(c), 2), F.hex(c))
    name = F.get(F.array(*map(F.lit, _COMMANDS)), (e % 6).cast("int"))
    number = F.concat(F.lit("00"), F.get(F.array(*map(F.lit, _DOUBLES)), (e % 5).cast("int")))
    key = F.concat(F.lit("key"), F.col("user_id").cast("string"))
    files = dealt(t("events"), "event_id").select(e.cast("string").alias("path"), F.unhex(F.concat(text(name), number, F.lit("05"), text(key))).alias("data"))
    return R.commands(C.walked(files, R.amf_walk, R.AMF))


@query(f"""WITH u AS (SELECT user_id, 14 + length(props) * (event_id % 40 + 1) AS n, {_NTH} AS k FROM events),
    p AS (SELECT user_id, 1 + greatest(0, ceil((n - 176) / 184)) AS packets FROM u)
    SELECT CAST(user_id AS VARCHAR) AS path, pid, CAST(CASE WHEN pid = 256 THEN sum(packets) ELSE 1 END AS BIGINT) AS n_packets, CASE WHEN pid = 256 THEN count(*) ELSE 1 END AS n_starts, CASE WHEN pid = 256 THEN CAST(sum(packets) - 1 AS BIGINT) % 16 ELSE 0 END AS last_counter
    FROM p JOIN (VALUES (0), (4096), (256)) AS v(pid) ON true GROUP BY user_id, pid""")
def transport_segments(t):
    units = events(t, "props").withColumn("seq", F.row_number().over(T.ordered(["user_id"], ORDER)).cast("long"))
    body = F.unhex(F.repeat(F.hex("props"), (F.col("event_id") % 40 + 1).cast("int")))
    files = sinks.transport_segments(units.select(F.col("user_id").cast("string").alias("segment"), "seq", body.alias("data"), (F.col("seq") * 3000).alias("clock"), (F.col("event_type") == "click").alias("is_key")))
    packets = R.transport_headers(files.select(F.col("segment").alias("path"), F.col("file").alias("data")))
    return packets.groupBy("path", "pid").agg(F.count("*").alias("n_packets"), F.count_if("start").alias("n_starts"), F.max_by("counter", "number").alias("last_counter"))


@query(f"""SELECT user_id, {_NTH} - 1 AS index, ({_NTH} - 1) * 3000 AS pts, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS config_id FROM events""")
def tag_segments(t):
    """A segment for each tag, with the parameter set that was last seen and times 3000 apart."""
    w = T.ordered(["user_id"], ORDER)
    index = F.row_number().over(w).cast("long") - 1
    return events(t).select("user_id", index.alias("index"), (index * 3000).alias("pts"), T.last_before(None, ["user_id"], ORDER, F.when(F.col("event_type") == "signup", F.col("event_id"))).alias("config_id"))


@query("""WITH s AS (SELECT user_id, sum(CAST(event_type = 'click' AS INTEGER)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS seg FROM events),
    g AS (SELECT user_id, seg, count(*) / 2 AS d FROM s GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY seg DESC) AS r, count(*) OVER (PARTITION BY user_id) AS n FROM g)
    SELECT user_id AS stream, '#EXTM3U' || chr(10) || '#EXT-X-VERSION:3' || chr(10) || '#EXT-X-TARGETDURATION:30' || chr(10) || '#EXT-X-MEDIA-SEQUENCE:' || CAST(max(greatest(n - 5, 0)) AS BIGINT) || chr(10) ||
      string_agg(printf('#EXTINF:%.3f,', CAST(d AS DOUBLE)) || chr(10) || printf('segment%05d.ts', CAST(seg AS BIGINT)), chr(10) ORDER BY seg) || chr(10) AS m3u8 FROM k WHERE r <= 5 GROUP BY user_id""")
def playlist_text(t):
    cut = T.segments(events(t), ["user_id"], ORDER, F.col("event_type") == "click")
    sized = cut.groupBy("user_id", "segment").agg((F.count("*") / 2).alias("duration"))
    kept = T.keep_last(sized, ["user_id"], ["segment"], 5)
    rows = kept.select(F.col("user_id").alias("stream"), "media_sequence", F.col("segment").alias("index"), "duration", F.format_string("segment%05d.ts", "segment").alias("path"))
    return sinks.playlist_text(rows, 30)


@query("SELECT n_regionkey AS src, r_name AS src_name, n_nationkey + 100 AS dst, n_name AS dst_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def graph_json(t):
    """Nodes and edges as JSON lines and back, the edges joined with their nodes."""
    nodes = t("region").select(F.col("r_regionkey").cast("long").alias("id"), F.col("r_name").alias("name")).unionByName(t("nation").select((F.col("n_nationkey") + 100).cast("long").alias("id"), F.col("n_name").alias("name")))
    edges = t("nation").select(F.col("n_regionkey").cast("long").alias("src"), (F.col("n_nationkey") + 100).cast("long").alias("dst"))
    read_nodes, read_edges = sinks.graph_from_json(sinks.graph_json(nodes, edges))
    named = lambda side: read_nodes.select(F.col("id").alias(side), F.col("name").alias(f"{side}_name"))
    return read_edges.join(named("src"), "src").join(named("dst"), "dst")


@query("""WITH c AS (SELECT conv_id, turn, text, sum(octet_length(encode(text)) + 4) OVER (PARTITION BY conv_id ORDER BY turn) AS after FROM conversations WHERE text IS NOT NULL)
    SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS frame, CAST((after - 1) // 100 AS BIGINT) AS complete_at, text FROM c""")
def residual_frames(t):
    """Frames behind their lengths, sent in reads of 100 bytes that cut them anywhere: each with the read that completes it."""
    from loomframe.streaming import live

    turns = t("conversations").filter("text is not null").select("conv_id", "turn", F.concat(L.be(F.octet_length("text"), 4), F.hex("text")).alias("h"))
    whole = L.stream(turns, ["conv_id"], ["turn"], F.col("h"))
    n = F.ceil(F.octet_length("data") / 100).cast("int")
    reads = whole.select("conv_id", "data", F.explode(F.sequence(F.lit(0), n - 1)).alias("k")).select(F.col("conv_id").alias("conn"), F.col("k").cast("long").alias("seq"), F.substring("data", F.col("k") * 100 + 1, F.lit(100)).alias("payload"))
    return live.framed(reads).select(F.col("conn").alias("conv_id"), "frame", F.col("seq").alias("complete_at"), F.decode("payload", "UTF-8").alias("text"))


@query("SELECT name, n_bytes, first_byte, n_ff FROM (VALUES ('empty', 0, NULL, 0), ('zero', 1, 0, 0), ('ff', 1, 255, 1), ('zeros', 64, 0, 0), ('ffs', 64, 255, 64), ('one', 1, 1, 0), ('alternating', 64, 0, 32)) AS v(name, n_bytes, first_byte, n_ff)")
def edge_cases(t):
    """The byte patterns that every source must take; none of the walks fails on one."""
    cases = C.edge_cases(t("region").sparkSession)
    for walk, fields in ((C.boxes, C.BOXES), (C.nal_units, C.NALS), (C.avcc_units, C.NALS), (C.adts_frames, C.ADTS), (C.obu_units, C.OBUS), (C.ivf_frames, C.IVF), (C.ebml, C.EBML)):
        found = C.walked(cases, walk, fields).groupBy("path").agg(F.count("*").alias("found"))
        cases = cases.join(found, "path", "left").drop("found")
    return cases.select(F.col("path").alias("name"), F.octet_length("data").alias("n_bytes"), R.byte_at("data", 0).alias("first_byte"), F.regexp_count(F.hex("data"), F.lit("FF")).alias("n_ff"))


@query("""SELECT t, y, x, xor(x + 5 * t, y + 3 * t) & 255 AS v FROM (SELECT unnest(range(6)) AS t) CROSS JOIN (SELECT unnest(range(24)) AS y) CROSS JOIN (SELECT unnest(range(32)) AS x)""")
def synthetic_clip(t):
    return C.synthetic_clip(t("region").sparkSession, 32, 24, 6)


@query("""WITH s AS (SELECT user_id, count(*) FILTER (event_type = 'error') OVER w AS errors, event_id FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))
    SELECT user_id, count(*) FILTER (errors = 0) AS n_frames, max(errors) > 0 AS failed, max(event_id) FILTER (errors = 0) AS last_id FROM s GROUP BY user_id""")
def in_band_errors(t):
    """A stream's frames up to the first error message in it, and whether there was one."""
    from loomframe.plans.pipeline import until_error

    seen = until_error(events(t), ["user_id"], ORDER, F.col("event_type") == "error")
    return seen.groupBy("user_id").agg(F.count_if("visible").alias("n_frames"), F.bool_or("is_error").alias("failed"), F.max(F.when(F.col("visible"), F.col("event_id"))).alias("last_id"))


_MARKER = "CASE WHEN p_partkey % 5 = 0 THEN '' ELSE '// verify:' END || ' name=T' || p_partkey || CASE WHEN p_size % 3 = 0 THEN '' ELSE ' symbol=s' || p_size END || ' commit=c' || (p_partkey % 9) || ' file=' || p_type || '.c range=' || p_size || ':' || (p_size + 4)"


@query("""SELECT p_partkey, 'T' || p_partkey AS name, 's' || p_size AS symbol, 'c' || (p_partkey % 9) AS "commit", p_type || '.c' AS file, p_size AS first FROM part WHERE p_partkey % 5 <> 0 AND p_size % 3 <> 0""")
def marker_scan(t):
    """Comment lines behind a prefix that name all four of name, symbol, commit and file; others give nothing."""
    from loomframe.functions import media as M

    lines = t("part").select("p_partkey", F.expr(_MARKER).alias("line"))
    return M.markers(lines, "line", "// verify:", ["name", "symbol", "commit", "file"]).select("p_partkey", "name", "symbol", "commit", "file", F.split_part("range", F.lit(":"), F.lit(1)).try_cast("int").alias("first"))


@query(r"""SELECT doc_id, len(n) AS n_numbers, array_to_string(n, ' ') AS numbers FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '-?\b[0-9]+\b') AS n FROM documents)""")
def numeric_literals(t):
    from loomframe.functions import media as M

    found = t("documents").select("doc_id", M.numbers_in(F.coalesce("text", F.lit(""))).alias("n"))
    return found.select("doc_id", F.size("n").cast("long").alias("n_numbers"), F.array_join("n", " ").alias("numbers"))


@query("SELECT p_partkey, p_name AS name FROM part")
def strip_nul(t):
    from loomframe.functions import media as M

    return t("part").select("p_partkey", M.text_of(F.unhex(F.concat(F.hex("p_name"), F.lit("0000")))).alias("name"))


@query("SELECT user_id AS stream, min(event_id) AS config_id, arg_min(props, event_id) AS config FROM events WHERE event_type = 'signup' GROUP BY user_id")
def first_parameters(t):
    """A stream's parameter set of the least id: a set choice where there is none by number."""
    sets = t("events").filter("event_type = 'signup'")
    return sets.groupBy(F.col("user_id").alias("stream")).agg(F.min("event_id").alias("config_id"), F.min_by("props", "event_id").alias("config"))


@query("""SELECT coalesce(a.p_partkey, b.k) AS position, a.p_size AS left_size, b.s AS right_size FROM part a FULL JOIN (SELECT p_partkey + 1 AS k, p_size AS s FROM part) b ON a.p_partkey = b.k WHERE a.p_size IS DISTINCT FROM b.s ORDER BY position LIMIT 10""")
def first_mismatches(t):
    """The report of a comparison: its first ten differences."""
    from loomframe.operators import signal as S

    a, b = t("part").select(F.col("p_partkey").alias("position"), "p_size"), t("part").select((F.col("p_partkey") + 1).alias("position"), "p_size")
    return S.first_mismatches(a, b, "position", "p_size", 10).select("position", F.col("left").alias("left_size"), F.col("right").alias("right_size"))

