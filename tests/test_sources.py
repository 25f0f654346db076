import random
import struct

import pyarrow as pa
from pyspark.sql import functions as F

from loomframe.functions import layout as L
from loomframe.sources import containers as C
from loomframe.sources import sinks


def table(spark, *files):
    return spark.createDataFrame([(f"f{k}", bytearray(d)) for k, d in enumerate(files)], "path string, data binary")


SAMPLES = [(b"abcdefgh", 1000, True), (b"ijklmno", 1000, False), (b"pqrstu", 500, False), (b"v", 500, True)]


def test_mp4_round_trip(spark):
    data = sinks.mp4_bytes(SAMPLES, 320, 240, 30_000)
    tracks = C.walked(table(spark, data, data[:-30], b"", b"\x00\x00\x00\x08free"), C.sample_tables, C.TRACKS)
    info = C.probe(tracks).collect()
    assert [(r.path, r.codec, r.media, r.n_samples, r.seconds, r.width, r.height) for r in info] == [("f0", "h264", "video", 4, 0.1, 320, 240)]
    rows = C.samples(tracks).orderBy("sample").collect()
    assert [r.pts for r in rows] == [0, 1000, 2000, 2500] and [r.is_key_frame for r in rows] == [s[2] for s in SAMPLES]
    assert [data[r.offset : r.offset + r.size] for r in rows] == [s[0] for s in SAMPLES]


def test_all_key_samples_have_no_sync_list(spark):
    data = sinks.mp4_bytes([(b"a", 1, True), (b"b", 1, True)], 2, 2, 10)
    assert b"stss" not in data and all(r.is_key_frame for r in C.samples(C.walked(table(spark, data), C.sample_tables, C.TRACKS)).collect())


def test_muxed_files_are_read_again(spark, tmp_path):
    rows = [(s, k, bytearray(d), n, key) for s in (1, 2) for k, (d, n, key) in enumerate(SAMPLES[: s + 1])]
    for r in sinks.muxed(spark.createDataFrame(rows, "stream long, seq long, data binary, duration long, is_key boolean"), 16, 16, 1000).collect():
        (tmp_path / f"{r.stream}.mp4").write_bytes(bytes(r.file))
    tracks = C.walked(C.files(spark, f"file://{tmp_path}/*.mp4"), C.sample_tables, C.TRACKS)
    assert sorted(r.n_samples for r in C.probe(tracks).collect()) == [2, 3]


def test_elementary_streams(spark):
    nal = b"\0\0\0\1\x67AB\0\0\1\x68C\0\0\0\1\x65D\0\0\3\1"
    rows = C.walked(table(spark, nal), C.nal_units, C.NALS).collect()
    assert [(r.nal_type, bytes(r.payload)) for r in rows] == [(7, b"\x67AB"), (8, b"\x68C"), (5, b"\x65D\0\0\3\1")]
    assert C.without_emulation(b"D\0\0\3\1\0\0\3") == b"D\0\0\1\0\0"
    assert [r["payload"] for r in C.avcc_units(b"\0\0\0\2\x65A\0\0\0\1\x41\0\0\0\x09")] == [b"\x65A", b"\x41"]
    adts = bytes([0xFF, 0xF1, 0x50, 0x80, 0x01, 0x3F, 0xFC]) + b"xy"
    (frame,) = C.adts_frames(adts + b"junk")
    assert (frame["size"], frame["sample_rate"], frame["channels"], frame["payload"]) == (9, 44100, 2, b"xy")
    assert [(r["obu_type"], r["payload"]) for r in C.obu_units(b"\x12\x00\x0a\x02hi")] == [(2, b""), (1, b"hi")]
    ivf = b"DKIF" + struct.pack("<HH", 0, 32) + b"AV01" + b"\0" * 20 + struct.pack("<IQ", 3, 7) + b"abc" + struct.pack("<IQ", 9, 8)
    assert [(r["pts"], r["payload"]) for r in C.ivf_frames(ivf)] == [(7, b"abc")]


def test_matroska_packets(spark):
    block = bytes([0xA3, 0x86, 0x81, 0xFF, 0xFE, 0x80, 0x41, 0x42])
    cluster = bytes([0xE7, 0x82, 0x01, 0x00]) + block
    data = bytes.fromhex("18538067") + b"\xff" + bytes.fromhex("1F43B675") + bytes([0x80 | len(cluster)]) + cluster
    rows = C.mkv_blocks(C.walked(table(spark, data), C.ebml, C.EBML)).collect()
    assert [(r.track, r.pts, r.is_key_frame, r.size) for r in rows] == [(1, 254, True, 2)]


def test_random_bytes_never_fail():
    rng = random.Random(5)
    for _ in range(300):
        data = bytes(rng.choice(b"\0\0\0\1\x08moovtrakstts\xff\xf1\x67") if rng.random() < 0.7 else rng.randrange(256) for _ in range(rng.randrange(400)))
        for walk in (C.boxes, C.sample_tables, C.nal_units, C.avcc_units, C.adts_frames, C.obu_units, C.ivf_frames, C.ebml):
            list(walk(data))


def test_raw_frames_and_points(spark):
    assert [bytes(r.payload) for r in C.raw_frames(table(spark, b"aabbcc"), 2).orderBy("number").collect()] == [b"aa", b"bb", b"cc"]
    lines = spark.createDataFrame([("ply",), ("0.5 1 2 9",), ("x y z",), ("1 2",)], "value string")
    assert [(r.x, r.y, r.z) for r in C.ply_points(lines).collect()] == [(0.5, 1.0, 2.0)]


def test_text_sinks(spark):
    segments = spark.createDataFrame([(1, 2, k, 6.0, f"segment{k:05d}.ts") for k in (4, 2, 3)], "stream long, media_sequence long, index long, duration double, path string")
    text = sinks.playlist_text(segments, 6).first().m3u8
    assert text.splitlines()[:4] == ["#EXTM3U", "#EXT-X-VERSION:3", "#EXT-X-TARGETDURATION:6", "#EXT-X-MEDIA-SEQUENCE:2"] and text.splitlines()[4:6] == ["#EXTINF:6.000,", "segment00002.ts"]
    points = spark.createDataFrame([(0.5, 1.0, 2.0)], "x double, y double, z double")
    assert [r.value for r in sinks.ply_lines(points).orderBy("part").collect()][1] == "0.5 1.0 2.0"
    nodes, edges = spark.createDataFrame([(1, "a")], "id long, name string"), spark.createDataFrame([(1, 1)], "src long, dst long")
    assert sinks.graph_json(nodes, edges).count() == 2


def test_small_files_share_a_batch():
    schema = pa.schema([("path", pa.string()), ("n", pa.int32()), ("payload", pa.binary())])
    files = pa.RecordBatch.from_pydict({"path": [str(k) for k in range(3000)], "data": [bytes([k % 7]) * (k % 7) for k in range(2998)] + [None, b"x" * 9_000_000]})
    walk = lambda data: ({"n": k, "payload": data[k : k + 1_000_000]} for k in range(0, max(1, len(data)), 1_000_000))
    got = list(C.walked_batches(iter([files, files]), walk, schema))
    rows = [r for b in got for r in b.to_pylist()]
    assert len(got) < 40 and len(rows) == 2 * (2999 + 9) and max(b.nbytes for b in got) < 6_000_000
    assert all(r["payload"] == bytes([int(r["path"]) % 7]) * (int(r["path"]) % 7) for r in rows if int(r["path"]) < 2998)


def test_bits_are_evaluated_once(spark):
    bits = [None, ""] + [format(k * 2654435761 % (1 << 60), "b")[:n] for k, n in enumerate((1, 7, 8, 9, 31, 60), 7)] + ["01" * n for n in (31, 32, 33, 64, 65, 500)]
    packed = L.bytes_of_bits(F.col("b"))
    got = spark.createDataFrame([(b,) for b in bits], "b string").select("b", packed.alias("x"))
    whole = lambda b: b.ljust(-(-len(b) // 8) * 8, "0")
    assert all((r.b is None and r.x is None) or bytes(r.x) == bytes(int(whole(r.b)[k : k + 8], 2) for k in range(0, len(r.b), 8)) for r in got.collect())
    plan = spark.range(9).select(L.bytes_of_bits(F.concat(L.binary(F.col("id"), 8), L.exp_golomb(F.col("id")))).alias("x"))
    assert plan._jdf.queryExecution().optimizedPlan().toString().count("id#") < 6


def test_parsed_rows_are_dealt_to_tasks(spark):
    from loomframe.plans import catalogue

    for name in ("pps_parse", "sps_parse", "av1_sequence", "slice_headers"):
        assert "hashpartitioning" in catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()


def test_index_is_built_in_one_pass_from_any_tables(spark):
    rng, tracks, expected = random.Random(5), [], []
    for f in range(40):
        n, fixed = rng.randrange(1, 30), rng.choice([0, 0, 9])
        stts, left = [], n
        while left:
            stts.append((k := rng.randrange(0, left + 1), rng.randrange(5)))
            left -= k
        stsc, counts = [], []
        while sum(counts) < n:
            stsc.append((len(counts) + 1, per := rng.randrange(0, 5)))
            counts += [per] * rng.randrange(1, 4)
        offsets = [1000 * k + rng.randrange(9) for k in range(len(counts) - rng.randrange(2))]
        sizes = [rng.randrange(50) for _ in range(n + rng.randrange(3))]
        sync = rng.choice([None, [], sorted(rng.sample(range(1, n + 1), rng.randrange(1, n + 1)))])
        tracks.append((f"f{f}", 1, fixed, stts, [] if fixed else sizes, sync, offsets, stsc))
        times, at = [], 0
        for k, d in stts:
            times += [at + j * d for j in range(k)]
            at += k * d
        places = [(c, j) for c, k in enumerate(counts[: len(offsets)]) for j in range(k)]
        sizes = [fixed] * n if fixed else sizes
        for i in range(min(len(sizes), len(times), len(places))):
            chunk, j = places[i]
            expected.append((f"f{f}", i, times[i], sizes[i], offsets[chunk] + sum(sizes[i - j : i]), sync is None or i + 1 in sync))
    kind = "path string, track_id long, fixed_size long, stts array<struct<count:long,delta:long>>, sizes array<long>, sync array<long>, offsets array<long>, stsc array<struct<first_chunk:long,per_chunk:long>>"
    found = C.samples(spark.createDataFrame(tracks, kind))
    assert sorted((r.path, r.sample, r.pts, r["size"], r.offset, r.is_key_frame) for r in found.collect()) == sorted(expected)
    plan = C.samples(C.walked(table(spark, b""), C.sample_tables, C.TRACKS))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "array_contains" not in plan
