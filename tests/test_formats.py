import struct
import zlib

import pytest
from pyspark.sql import functions as F

from loomframe.functions import layout as L
from loomframe.functions import media as M
from loomframe.operators import kernels, signal
from loomframe.plans.pipeline import Pipeline, sunk, until_error
from loomframe.sources import containers as C
from loomframe.sources import messages as R
from loomframe.sources import sinks
from loomframe.streaming import live
from tests.test_streaming import run


def table(spark, *files):
    return spark.createDataFrame([(f"f{k}", bytearray(d)) for k, d in enumerate(files)], "path string, data binary")


def bits(*fields):
    """Bytes of (value, width) fields; width 0 is the unsigned exponential code, -1 the signed one."""
    out = ""
    for value, width in fields:
        if width > 0:
            out += format(value, f"0{width}b")
        else:
            code = value if width == 0 else (2 * value - 1 if value > 0 else -2 * value)
            out += "0" * ((code + 1).bit_length() - 1) + format(code + 1, "b")
    out += "1"
    out += "0" * (-len(out) % 8)
    return int(out, 2).to_bytes(len(out) // 8, "big")


def test_layouts_are_the_bytes(spark):
    rows = [(0, 1), (258, -3), (65535, 7)]
    df = spark.createDataFrame(rows, "v long, s long").select("v", "s", L.be(F.col("v"), 4).alias("be"), L.le(F.col("v"), 8).alias("le"), L.bytes_of_bits(F.concat(L.exp_golomb(F.col("v")), L.signed_exp_golomb(F.col("s")), F.lit("1"))).alias("code"))
    for r in df.collect():
        assert bytes.fromhex(r.be) == struct.pack(">I", r.v) and bytes.fromhex(r.le) == struct.pack("<Q", r.v)
        assert bytes(r.code) == bits((r.v, 0), (r.s, -1))


def test_scaling_lists_of_parameter_sets():
    flat = [(1, 1), (0, -1)] + [(0, -1)] * 15
    zero = [(1, 1), (-8, -1)]  # a first step to 0: the default goes on
    sps = b"\x67" + bits((100, 8), (0, 8), (40, 8), (3, 0), (1, 0), (0, 0), (0, 0), (0, 1), (1, 1), *flat, *zero, *[(0, 1)] * 6, (2, 0), (0, 0), (4, 0), (2, 0), (0, 1), (19, 0), (14, 0), (1, 1), (1, 1), (0, 1))
    found = R.picture_size(sps)
    assert found == {"sps_id": 3, "profile": 100, "level": 40, "refs": 2, "separate_planes": 0, "scaling_lists": 2, "log2_frame_num": 6, "order_type": 0, "log2_order": 8, "delta_always_zero": 0, "frames_only": 1, "width": 320, "height": 240}
    assert R.picture_size(sps[:8]) is None
    reader = R.BitReader(bits((1, 1), (2, -1), (-1, -1), (0, -1), (0, -1)))
    assert R.scaling_list(reader, 4) == [10, 9, 9, 9]
    assert R.scaling_list(R.BitReader(bits((1, 1), (2, -1), (-10, -1))), 4) == [10, 10, 10, 10]


def test_slices_of_fields_and_pairs_of_lists():
    sps = {"separate_planes": 0, "log2_frame_num": 5, "frames_only": 0, "order_type": 1, "log2_order": 0, "delta_always_zero": 0}
    pps = {"order_present": 1, "redundant": 1, "refs_l0": 1, "refs_l1": 1, "weighted": 0, "weighted_bi": 0}
    nal = b"\x41" + bits((7, 0), (1, 0), (0, 0), (9, 5), (1, 1), (1, 1), (-4, -1), (0, 0), (1, 1), (1, 1), (2, 0), (3, 0), (0, 1), (1, 1), (1, 0), (6, 0), (3, 0), (1, 1), (2, 0), (5, 0), (6, 0), (1, 0), (0, 0))
    got = R.slice_header(nal, sps, pps)
    assert (got["first_mb"], got["slice_type"], got["frame_num"], got["field"], got["bottom"], got["idr_id"], got["order"]) == (7, "B", 9, 1, 1, None, None)
    assert (got["refs_l0"], got["refs_l1"], got["modifications"], got["marking"]) == (3, 4, [], [(2, 5, 0), (6, 1, 0)])
    assert R.slice_header(nal, sps, pps | {"weighted_bi": 1}) is None and R.slice_header(nal[:3], sps, pps) is None


def test_reduced_sequence_header():
    still = bits((0, 3), (1, 1), (1, 1), (4, 5), (7, 4), (7, 4), (199, 8), (99, 8), (1, 1), (0, 2), (0, 3), (1, 1), (1, 1), (0, 1), (0, 1))
    found = R.sequence_header(still)
    assert (found["still"], found["level"], found["width"], found["height"], found["bit_depth"], found["mono"], found["large_blocks"]) == (1, 4, 200, 100, 10, 1, 1)
    assert R.sequence_header(b"\x00") is None


def test_audio_configs_cut_short_are_null(spark):
    df = spark.createDataFrame([(bytearray(b"\x12\x10"),), (bytearray(b"\x12"),), (bytearray(b"\x17\x00"),), (bytearray(b"\x16\x90"),)], "d binary")
    assert [tuple(r.c) if r.c else None for r in df.select(R.audio_config("d").alias("c")).collect()] == [(2, 44100, 2), None, None, None]


def test_transport_streams_are_read_again(spark):
    units = [(b"u" * n, 90_000 * k, k == 0) for k, n in enumerate((0, 1, 161, 162, 163, 346, 900))]
    data = b"".join(R.transport_stream(iter(units)))
    rows = sorted(R.transport_headers(table(spark, data)).collect(), key=lambda r: r.number)
    assert len(data) == 188 * len(rows) and [r.pid for r in rows[:2]] == [0, 0x1000]
    video = [r for r in rows if r.pid == 0x100]
    assert [r.counter for r in video] == [k % 16 for k in range(len(video))] and sum(r.start for r in video) == len(units)
    joined, packets = b"", []
    for r in video:
        if r.start and joined:
            packets.append(joined)
            joined = b""
        joined += bytes(r.payload)
    packets.append(joined)
    assert [p[14:] for p in packets] == [u[0] for u in units]
    stamp = packets[6][9:14]
    assert (stamp[0] >> 1 & 7) << 30 | stamp[1] << 22 | (stamp[2] >> 1) << 15 | stamp[3] << 7 | stamp[4] >> 1 == 540_000
    sections = [bytes(r.payload)[1 : 4 + struct.unpack(">H", bytes(r.payload)[2:4])[0] % 4096] for r in rows[:2]]
    assert all(R.mpeg_crc32(s) == 0 for s in sections)
    with pytest.raises(Exception, match="sync byte"):
        R.transport_headers(table(spark, b"\x00" * 188)).collect()


def test_checksums_have_their_check_values(spark):
    assert R.mpeg_crc32(b"123456789") == 0x0376E6E7
    r = 2**64 - 1
    for b in b"123456789":
        r ^= b
        for _ in range(8):
            r = r >> 1 ^ (0x42F0E1EBA9EA3693 if r & 1 else 0)
    assert R.mixed_crc64(b"123456789") == r ^ (2**64 - 1) and R.mixed_crc64(b"") == 0
    planes = spark.createDataFrame([(bytearray(b"123456789"), 10), (bytearray(b"123456789"), 16), (None, 8)], "data binary, bit_depth int")
    got = kernels.plane_checksums(planes).collect()
    assert [r.checksum for r in got] == [0xCBF43926, (R.mixed_crc64(b"123456789") + 2**63) % 2**64 - 2**63, None]


def test_crc_of_texts(spark):
    from loomframe.plans import catalogue

    data = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    assert {r.doc_id: r.crc32 for r in catalogue.QUERIES["crc32_plane"](spark, data).collect()} == {k: zlib.crc32(v.encode()) for k, v in texts.items()}


def test_files_without_a_movie_or_with_short_samples_are_errors(spark):
    data = sinks.mp4_bytes([(b"abcd", 10, True), (b"efg", 10, False)], 16, 16, 100)
    with pytest.raises(Exception, match="no movie box"):
        C.walked(table(spark, b"\0\0\0\x08free"), C.movie_headers, C.MOVIES).collect()
    good = table(spark, data)
    index = C.samples(C.walked(good, C.sample_tables, C.TRACKS))
    assert [bytes(r.data) for r in C.packets(index, good).orderBy("sample").collect()] == [b"abcd", b"efg"]
    with pytest.raises(Exception, match="beyond the end"):
        C.packets(index, table(spark, data[:34])).collect()


def test_walks_take_edge_cases(spark):
    cases = [bytes(r.data) for r in C.edge_cases(spark).collect()]
    assert len(cases) == 7
    for data in cases:
        assert R.picture_size(data) is None or data
        R.picture_parameters(data), R.sequence_header(data), list(R.slice_walk(data, {"separate_planes": 0, "log2_frame_num": 4, "frames_only": 1, "order_type": 2}, {"redundant": 0, "refs_l0": 1, "refs_l1": 1, "weighted": 0, "weighted_bi": 0}))
        list(R.amf_walk(data)), list(R.chunk_headers(data))


def test_strict_forms_are_errors(spark):
    sent = spark.createDataFrame([(g, 10 * g + k, 7 * k + g) for g in range(3) for k in range(4)], "grp long, i long, sym long")
    one = sent.filter("i not in (2, 13)")
    assert {(r.i, r.recovered) for r in signal.strictly_recovered(sent, one, ["grp"], "i", "sym").collect()} == {(2, 14), (13, 22)}
    with pytest.raises(Exception, match="more than its parity"):
        signal.strictly_recovered(sent, one.filter("i <> 3"), ["grp"], "i", "sym").collect()
    now, old = spark.createDataFrame([(1, 5), (2, None)], "slot long, v long"), spark.createDataFrame([(1, 1), (2, 2)], "slot long, v long")
    assert {(r.slot, r.v) for r in signal.concealed(now, old, ["slot"], "v").collect()} == {(1, 5), (2, 2)}
    with pytest.raises(Exception, match="different numbers"):
        signal.concealed(now, old.limit(1), ["slot"], "v").collect()
    assert signal.same_length(now, old, "slot", "v").count() == 2
    with pytest.raises(Exception, match="different length"):
        signal.same_length(now, old.limit(1), "slot", "v").collect()


def test_error_messages_end_a_stream(spark):
    rows = [(1, k, "bad" if k == 3 else "frame") for k in range(5)] + [(2, k, "frame") for k in range(2)]
    df = spark.createDataFrame(rows, "s long, k long, kind string")
    seen = until_error(df, ["s"], ["k"], F.col("kind") == "bad")
    assert {(r.s, r.k) for r in seen.filter("visible").collect()} == {(1, 0), (1, 1), (1, 2), (2, 0), (2, 1)}
    with pytest.raises(Exception, match="broken"):
        sunk(df, F.col("kind") == "bad", F.lit("broken")).collect()
    assert sunk(df.filter("s = 2"), F.col("kind") == "bad", F.lit("broken")).count() == 2


def test_stages_are_counted_while_they_run(spark, tmp_path):
    chain = Pipeline([lambda df: df.filter("id % 2 = 0"), lambda df: df.filter("id > 10")])
    out, seen = chain.traced(spark.range(20))
    out.write.parquet(str(tmp_path / "out"))
    assert [s.get["rows"] for s in seen] == [10, 4]


def test_frames_wait_for_their_rest(spark, tmp_path):
    import base64

    data = b"".join(struct.pack(">I", len(x)) + x for x in (b"abc", b"", b"defgh"))
    row = lambda seq, part: '{"conn":1,"seq":%d,"payload":"%s"}' % (seq, base64.b64encode(part).decode())
    got = run(spark, tmp_path, [[row(0, data[:2]), row(1, data[2:9])], [row(2, data[9:14])], [row(3, data[14:])]], "conn long, seq long, payload binary", live.framed, "append")
    assert sorted((r.frame, r.seq, bytes(r.payload)) for r in got) == [(0, 1, b"abc"), (1, 2, b""), (2, 3, b"defgh")]


def test_handlers_get_their_kind(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"kind":"video","n":1}\n{"kind":"audio","n":2}\n{"kind":"video","n":3}\n{"kind":"x","n":4}\n')
    got = {"video": [], "audio": []}
    stream = spark.readStream.schema("kind string, n long").json(str(tmp_path / "in"))
    query = live.handled(stream, "kind", {k: lambda df, _, k=k: got[k].extend(r.n for r in df.collect()) for k in got}, str(tmp_path / "state"))
    query.awaitTermination(120)
    assert sorted(got["video"]) == [1, 3] and got["audio"] == [2]


def test_segments_and_their_playlist(spark, tmp_path):
    rows = [(k, 2.0, bytearray(b"s%d" % k)) for k in range(5)]
    sinks.write_segments(spark.createDataFrame(rows, "index long, duration double, file binary"), f"file://{tmp_path}/out", keep=3, target=2)
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["playlist.m3u8", *[f"segment{k:05d}.ts" for k in range(5)]]
    text = (tmp_path / "out" / "playlist.m3u8").read_text()
    assert "#EXT-X-MEDIA-SEQUENCE:2" in text and text.count("#EXTINF") == 3 and (tmp_path / "out" / "segment00004.ts").read_bytes() == b"s4"


def test_texts_that_are_no_utf8(spark):
    df = spark.createDataFrame([(bytearray(b"ab\0\0"),), (bytearray(b"a\xffb"),), (bytearray(b""),), (None,)], "d binary")
    assert [r.t for r in df.select(M.text_of(F.col("d")).alias("t")).collect()] == ["ab", "a�b", "", None]


def test_frames_and_grids(spark):
    df = spark.createDataFrame([(3, 3, "yuv420p"), (4, 2, "rgb24"), (2**40, 2**40, "rgb24"), (1, 1, "none")], "w long, h long, f string")
    assert [r.n for r in df.select(M.frame_bytes(F.col("w"), F.col("h"), F.col("f")).alias("n")).collect()] == [14, 24, None, None]
    x = spark.createDataFrame([(-1.0,), (0.0,), (0.49,), (0.5,), (1.0,), (9.0,)], "v double")
    assert [r.c for r in x.select(M.grid_coordinate(F.col("v"), 1).alias("c")).collect()] == [0, 0, 0, 1, 1, 1]
    state = 12345
    for _ in range(3):
        state ^= state << 13 & 0xFFFFFFFF
        state ^= state >> 17
        state ^= state << 5 & 0xFFFFFFFF
    assert spark.range(1).select(kernels.xorshift(F.lit(12345), 3).alias("s")).first().s == state
    wide = 2**63 + 12345
    state = wide
    for _ in range(2):
        state ^= state << 13 & 2**64 - 1
        state ^= state >> 7
        state ^= state << 17 & 2**64 - 1
    assert spark.range(1).select(M.xorshift64(F.lit(wide - 2**64), 2).alias("s")).first().s % 2**64 == state


def test_jobs_name_and_run_queries(capsys):
    from loomframe.__main__ import main

    main(["list"])
    assert "gop_segment" in capsys.readouterr().out
    main(["sql", "gop_segment"])
    assert "SELECT" in capsys.readouterr().out
