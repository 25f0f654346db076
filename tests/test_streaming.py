import os

from loomframe.streaming import live


def run(spark, tmp_path, batches, schema, transform, mode):
    source, out = tmp_path / "in", []
    source.mkdir()
    stream = transform(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(source)))
    for k, rows in enumerate(batches):
        (file := source / f"{k:03d}.json").write_text("".join(f"{r}\n" for r in rows))
        os.utime(file, (1_700_000_000 + k, 1_700_000_000 + k))  # files are read in the order of their times
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", str(tmp_path / "state")).foreachBatch(lambda df, n: out.extend(df.collect())).trigger(availableNow=True).start()
    query.awaitTermination(180)
    return out


def test_messages_span_batches(spark, tmp_path):
    import base64

    row = lambda seq, data, n, ts: '{"conn":1,"chunk_stream":3,"seq":%d,"message_length":%d,"message_type":9,"ts":%d,"payload":"%s"}' % (seq, n, ts, base64.b64encode(data).decode())
    got = run(spark, tmp_path, [[row(0, b"ab", 5, 10), row(1, b"cd", 5, 10)], [row(2, b"e", 5, 11), row(3, b"xy", 2, 12)]], "conn long, chunk_stream long, seq long, message_length long, message_type long, ts long, payload binary", live.assembled, "append")
    assert sorted((bytes(r.payload), r.ts) for r in got) == [(b"abcde", 11), (b"xy", 12)]


def test_bytes_beyond_a_message_begin_the_next(spark, tmp_path):
    import base64

    row = lambda seq, data, n: '{"conn":1,"chunk_stream":3,"seq":%d,"message_length":%d,"message_type":9,"ts":0,"payload":"%s"}' % (seq, n, base64.b64encode(data).decode())
    got = run(spark, tmp_path, [[row(0, b"abcdeXY", 5)], [row(1, b"Z", 3), row(2, b"", 0)]], "conn long, chunk_stream long, seq long, message_length long, message_type long, ts long, payload binary", live.assembled, "append")
    assert [bytes(r.payload) for r in got] == [b"abcde", b"XYZ", b""]


def test_windows_count_late_packets_until_the_watermark(spark, tmp_path):
    row = lambda second, key: '{"stream":1,"ts":"2024-01-01T00:00:%02d","is_key":%s}' % (second, key)
    got = run(spark, tmp_path, [[row(1, "true"), row(12, "false")], [row(3, "false"), row(40, "true")], [row(45, "false")], [row(2, "true"), row(59, "true")]], "stream long, ts timestamp, is_key boolean", lambda s: live.segment_counts(s, "10 seconds", "20 seconds").select("window.start", "n_packets", "n_keys"), "append")
    assert sorted((r.start.second, r.n_packets, r.n_keys) for r in got) == [(0, 2, 1), (10, 1, 0)]


def test_playlist_keeps_the_last(spark, tmp_path):
    row = lambda k: '{"stream":1,"index":%d,"duration":2.0}' % k
    got = run(spark, tmp_path, [[row(0), row(1)], [row(2), row(3), row(4)]], "stream long, index long, duration double", lambda s: live.playlists(s, 3), "update")
    assert [(r.media_sequence, r["index"]) for r in got][-3:] == [(2, 2), (2, 3), (2, 4)]


def test_fields_wait_for_their_mate(spark, tmp_path):
    row = lambda seq, n, b: '{"stream":1,"seq":%d,"frame_num":%d,"bottom":%s}' % (seq, n, b)
    got = run(spark, tmp_path, [[row(0, 1, "false")], [row(1, 1, "true"), row(2, 2, "false")], [row(3, 3, "true"), row(4, 3, "false")]], "stream long, seq long, frame_num long, bottom boolean", live.field_pairs, "append")
    assert sorted((r.frame_num, r.first_seq, r.second_seq) for r in got) == [(1, 0, 1), (3, 3, 4)]
