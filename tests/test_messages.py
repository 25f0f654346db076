import random
import zlib

from loomframe.sources import messages as S


def test_tags(spark):
    rows = [(bytearray(b"\x17\x01\xff\xff\xfeDATA"),), (bytearray(b"\x22xyz"),), (bytearray(b""),)]
    got = S.video_tags(spark.createDataFrame(rows, "data binary")).collect()
    assert (got[0].frame_type, got[0].codec, got[0].avc_packet_type, got[0].composition_time, bytes(got[0].payload)) == ("key", "avc", "nalu", -2, b"DATA")
    assert (got[1].frame_type, got[1].codec, got[1].avc_packet_type, bytes(got[1].payload)) == ("inter", "h263", None, b"xyz") and got[2].codec is None
    a = S.audio_tags(spark.createDataFrame([(bytearray(b"\xaf\x00\x12\x10"),)], "data binary")).first()
    assert (a.format, a["rate"], a.bits, a.channels, a.is_config, bytes(a.payload)) == ("aac", 44100, 16, 2, True, b"\x12\x10")


def test_amf_round_trip():
    values = ["connect", 1.0, ("object", [("app", "live"), ("app", "second"), ("n", [None, True, 2.5])]), None, False]
    assert list(S.amf_values(b"".join(map(S.amf_bytes, values)))) == values
    assert S.amf_first(values[2], "app") == "live" and S.amf_first(values[0], "app") is None
    rng = random.Random(1)
    for _ in range(300):
        list(S.amf_values(bytes(rng.randrange(14) if rng.random() < 0.5 else rng.randrange(256) for _ in range(60))))
        list(S.chunk_headers(bytes(rng.randrange(256) for _ in range(200))))


def test_chunk_headers_take_what_they_lack():
    head = bytes([0x03, 0, 0, 10, 0, 0, 130, 9, 0, 0, 0, 0])
    data = head + b"a" * 128 + b"\xc3" + b"bb" + bytes([0x83, 0, 0, 5]) + b"c" * 128 + b"\xc3dd"
    rows = list(S.chunk_headers(data))
    assert [(r["ts"], len(r["payload"]), r["message_type"]) for r in rows] == [(10, 128, 9), (10, 2, 9), (15, 128, 9), (15, 2, 9)]
    size = bytes([0x02, 0, 0, 0, 0, 0, 4, 1, 0, 0, 0, 0]) + (4096).to_bytes(4, "big")
    assert [len(r["payload"]) for r in S.chunk_headers(size + bytes([0x03, 0, 0, 0, 0, 1, 44, 9, 0, 0, 0, 0]) + b"x" * 300)] == [4, 300]


def test_checksums():
    assert S.mpeg_crc32(b"123456789") == 0x0376E6E7
    table = S.crc_table(0xEDB88320, 32, True)
    r = 0xFFFFFFFF
    for b in b"123456789":
        r = r >> 8 ^ table[(r ^ b) & 255]
    assert r ^ 0xFFFFFFFF == zlib.crc32(b"123456789") and S.mixed_crc64(b"") == 0


def test_transport_packets():
    for n in (0, 1, 170, 175, 176, 177, 182, 183, 184, 185, 1000):
        payload = bytes(k & 255 for k in range(n))
        packets = list(S.transport_packets(payload, 0x101, 14, clock=90_000))
        got = b""
        for k, p in enumerate(packets):
            assert len(p) == 188 and p[0] == 0x47 and p[3] & 15 == (14 + k) & 15 and bool(p[1] & 0x40) == (k == 0)
            got += p[4 + (1 + p[4] if p[3] & 0x20 else 0) :]
        assert got == payload


def test_parameter_set():
    # baseline profile, 320x240: fields written bit by bit
    ue = lambda v: format(v + 1, "b").rjust(2 * (v + 1).bit_length() - 1, "0")
    bits = format(66, "08b") + "00000000" + format(30, "08b") + ue(0) + ue(0) + ue(0) + ue(0) + ue(1) + "0" + ue(19) + ue(14) + "1" + "1" + "0" + "0" + "1"
    bits = bits.ljust(-(-len(bits) // 8) * 8, "0")
    sps = b"\x67" + int(bits, 2).to_bytes(len(bits) // 8, "big")
    assert S.picture_size(sps) == {"profile": 66, "level": 30, "refs": 1, "width": 320, "height": 240} and S.picture_size(b"\x67") is None
