import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from loomframe.llm import chunks, records, tokens
from loomframe.llm.shared import new_folder

DOCS = "doc_id long, text string, score double, n_tokens string, row int"
TEXTS = ["", None, " ", "  a  b ", "Plain words, and more words.", "x  y    z\n\n tab\there", "<|endoftext|>a <|endoftext|> b<|startoftext|>", "日本語 テスト、です。" * 40, "a" * 9000 + "é1" * 6000, "Σίσυφος ΟΔΟΣ İ ﬁ é", " ▁ a ▁", "²½ª_ _a's 'S it'll", "   a  b", "same text", "same text", "word " * 30000]


def frame(spark, texts=TEXTS):
    return spark.createDataFrame([(k, t, 0.5, "clash", 1) for k, t in enumerate(texts)] + [(None, "no id", None, None, None)], DOCS)


def test_counts_are_the_librarys(spark):
    model = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    rows = tokens.token_counts(frame(spark), P.path("piece_bpe_32k.model")).collect()
    assert len(rows) == len(TEXTS) + 1
    for row in rows:
        text = "no id" if row.doc_id is None else TEXTS[row.doc_id] or ""
        n = len(model.encode(text))
        assert (row.n_bytes, row.n_tokens, row.over_limit) == (len(text.encode()), n, n > 4096)
    assert tokens.token_counts(frame(spark).limit(0), P.path("piece_bpe_32k.model")).count() == 0


def test_bpe_is_the_librarys_and_round_trips(spark):
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    df = frame(spark)
    ids = {r.doc_id: r.ids for r in tokens.bpe_encode(df, P.path("byte_bpe_50k.json")).collect()}
    for row in tokens.bpe_round_trip(df, P.path("byte_bpe_50k.json"), with_ids=True).collect():
        text = "no id" if row.doc_id is None else TEXTS[row.doc_id] or ""
        want = library.encode(text, add_special_tokens=False).ids
        assert row.ids == want == ids[row.doc_id] and row.n_tokens == len(want) and row.lossless
        assert row.ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(library.decode(want, skip_special_tokens=False).encode()).hexdigest()
    back = {r.doc_id: r.text for r in tokens.bpe_decode(tokens.bpe_encode(df, P.path("byte_bpe_50k.json")), P.path("byte_bpe_50k.json")).collect()}
    assert all(back[k] == (t or "") for k, t in enumerate(TEXTS))


def test_tree_joins_are_exact():
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    bpe = tokens.ByteBPE(P.path("byte_bpe_50k.json"), leaf=7)
    rng = random.Random(3)
    for alphabet in ("ab", "abcdefghijklmnopqrstuvwxyz", "ab1!é", "theraniothing", "ab<|endoftext|>"):
        for n in (8, 15, 60, 400, 3000):
            text = "".join(rng.choice(alphabet) for _ in range(n))
            got = bpe.to_id[bpe.ranks(text)].tolist()
            assert got == library.encode(text, add_special_tokens=False).ids


def test_windows_cover_every_byte():
    text = pa.array(["ab cd " * 50, None, "", "x" * 300, "é è " * 60, "end"])
    data, offsets = chunks.text_bytes(text)
    for words in (True, False):
        got = {}
        for lo, hi, piece, at in chunks.windows(data, offsets, words=words, size=64):
            for k in range(hi - lo):
                got[lo + k] = got.get(lo + k, b"") + piece[at[k] : at[k + 1]].tobytes()
        assert [got.get(k, b"").decode() for k in range(len(text))] == [x or "" for x in text.to_pylist()]


def test_memo_forgets_without_errors():
    calls = []

    def encode(spans):
        calls.append(len(spans))
        return np.array([x for s in spans for x in s], np.uint32), np.array([len(s) for s in spans])

    memo = chunks.SpanMemo(encode, slots=16)
    rng = random.Random(1)
    for _ in range(60):
        words = [bytes(rng.choice(b"abcde") for _ in range(rng.randint(1, 4))) for _ in range(20)]
        data = np.frombuffer(b" ".join(words), np.uint8)
        starts, ends = chunks.word_spans(data, np.array([0, len(data)]))
        ids, counts = memo(data, starts, ends)
        assert ids.tolist() == [x for w in words for x in w] and counts.tolist() == [len(w) for w in words]
    assert len(calls) > 1


@pytest.mark.parametrize("shuffled", [False, True])
def test_records_hold_the_librarys_ids_in_order(spark, shuffled):
    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    folder = new_folder(spark, "test-records")
    manifest = records.write_records(frame(spark).repartition(3), P.path("word_bpe_49k.json"), folder, shards=4)
    rows = records.read_records(manifest, read_bytes=20_000, with_ids=True, shuffle_seed=5 if shuffled else None).collect()
    start = 0
    for row in sorted(rows, key=lambda r: r.start):
        text = "no id" if row.doc_id is None else TEXTS[row.doc_id] or ""
        want = np.array(library.encode(text, add_special_tokens=False).ids + [1], "<u4")
        assert row.ids == want.tolist() and row.start == start and row.n_tokens == len(want) and row.ids_crc32 == zlib.crc32(want.tobytes())
        start += len(want)
    order = [r.doc_id for r in sorted(rows, key=lambda r: r.start)]
    assert order == [None, *range(len(TEXTS))]


def test_records_of_no_documents(spark):
    assert records.token_records(spark, frame(spark).limit(0), P.path("word_bpe_49k.json")).count() == 0


def test_a_damaged_record_is_an_error(spark):
    folder = new_folder(spark, "test-damaged")
    manifest = records.write_records(frame(spark, ["some words here"] * 3), P.path("word_bpe_49k.json"), folder, shards=1)
    path = manifest.first().path.removeprefix("file://")
    raw = bytearray(open(path, "rb").read())
    raw[20] ^= 1
    open(path, "wb").write(raw)
    with pytest.raises(Exception, match="checksum"):
        records.read_records(manifest).collect()


def test_an_id_of_most_rows_is_dealt_over_shards(spark):
    rows = [(7 if k % 4 else k, f"text {k} of many", 0.0, "", 1) for k in range(800)] + [(None, f"no id {k}", 0.0, "", 1) for k in range(300)]
    manifest = records.write_records(spark.createDataFrame(rows, DOCS), P.path("word_bpe_49k.json"), new_folder(spark, "test-hot"), shards=10)
    sizes = [r.n_records for r in manifest.collect()]
    assert sum(sizes) == len(rows) and max(sizes) < 0.3 * len(rows)
    got = records.read_records(manifest).orderBy("start").collect()
    ids = [-1 if r.doc_id is None else r.doc_id for r in got]
    assert ids == sorted(ids) and sorted(ids) == sorted(-1 if r[0] is None else r[0] for r in rows)


def test_ids_of_all_64_bits_keep_their_order(spark):
    ids = [2**60 + k for k in range(300)] + [2**53 + k for k in range(-5, 6)] + [-(2**60) - k for k in range(50)] + [-1, 0, 1, 2**63 - 1, 2**63 - 2, -(2**63), -(2**63) + 1]
    rows = [(x, f"text of {x}", 0.0, "", 1) for x in ids]
    random.Random(4).shuffle(rows)
    manifest = records.write_records(spark.createDataFrame(rows, DOCS).repartition(3), P.path("word_bpe_49k.json"), new_folder(spark, "test-ids"), shards=4)
    got = records.read_records(manifest).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted(ids) and manifest.count() > 1


def test_batches_are_cut_by_bytes():
    batch = pa.record_batch({"text": pa.array(["a" * 10, None, "b" * 95, "c" * 300, "", "d" * 5])})
    parts = list(chunks.sliced(iter([batch, batch.slice(0, 0), batch.slice(3)]), size=100))
    assert [p.num_rows for p in parts] == [2, 1, 1, 2, 1, 2]
    assert [x for p in parts for x in p.column("text").to_pylist()] == batch.column("text").to_pylist() + batch.column("text").to_pylist()[3:]
    data, offsets = chunks.text_bytes(parts[3].column("text"))
    assert data[offsets[0] : offsets[-1]].tobytes() == b"ddddd"


def test_encoders_of_empty_tables_and_repeated_ids(spark):
    path = P.path("byte_bpe_50k.json")
    none = frame(spark).limit(0)
    assert tokens.bpe_round_trip(none, path, with_ids=True).count() == tokens.bpe_encode(none, path).count() == 0
    twice = frame(spark, ["one text"]).unionByName(frame(spark, ["one text"]))
    assert tokens.bpe_round_trip(twice, path).groupBy("doc_id", "ids_sha256").count().filter("count = 2").count() == 2
    assert tokens.token_counts(twice, P.path("piece_bpe_32k.model")).filter("doc_id = 0").count() == 2
