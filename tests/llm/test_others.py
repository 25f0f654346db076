import hashlib
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomframe.llm import langid, licences, mixing, warc
from loomframe.llm.shared import new_folder

DATA = "/root/testdata/sf0.001"
PAGES = "page_id long, url string, html string, payload string, copies int"


def test_archives_round_trip(spark):
    big, same = "<p>é" * 700_000, "x" * 120
    rows = [(5, "http://a/", same), (3, "http://b/\r\nX: y", same), (9, None, same), (4, "u", None), (6, "u", ""), (7, "u", "short"), (8, "u", "short"), (10, "u", big), (11, "u", big), (12, "u", "y" * 100), (13, "u", "y" * 100), (14, "u", "z" * 99), (15, "u", "z" * 99), (None, "u", same), (20, "u", "q" * 200), (20, "u", "q" * 200), (21, "u", "\r\n\r\nWARC/1.1\r\n" * 40)]
    rows += [(1000 + k, "h", "hot payload " * 20) for k in range(300)]
    df = spark.createDataFrame([(*r, "clash", 7) for r in rows], PAGES).repartition(3)
    got = sorted(map(tuple, warc.archive_round_trip(spark, df).collect()), key=str)
    first = {}
    for page, _, html in rows:
        raw = (html or "").encode()
        if page is not None and len(raw) >= 100:
            first[raw] = min(page, first.get(raw, page))
    want = []
    for page, _, html in rows:
        raw = (html or "").encode()
        revisit = page is not None and len(raw) >= 100 and first[raw] != page
        want.append((page, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response", first[raw] if revisit else None))
    assert got == sorted(want, key=str)
    assert warc.archive_round_trip(spark, df.limit(0)).count() == 0


def test_chunks_carry_digests_so_far(spark):
    text = "".join(chr(97 + k % 26) for k in range(10_000))
    df = spark.createDataFrame([(1, "u", text, "", 0), (2, "u", text, "", 0)], PAGES)
    manifest = warc.write_warc(warc.chunk_rows(df, chunk=999), new_folder(spark, "test-warc"))
    rows = [r for r in warc.read_warc(manifest, chunk=777).orderBy("page_id", "chunk_no").collect()]
    whole = b""
    for k, r in enumerate(x for x in rows if x.page_id == 1):
        whole += r.chunk
        assert r.chunk_no == k and r.bytes_so_far == len(whole) and r.digest_so_far == hashlib.sha256(whole).hexdigest() and len(r.chunk) <= 777
    assert whole.decode() == text
    revisit = [r for r in rows if r.page_id == 2]
    assert len(revisit) == 1 and revisit[0].payload_bytes == 10_000 and revisit[0].bytes_so_far == 0


def test_languages_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = langid.language_id(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == docs.count() and 0.15 < len(held) / len(rows) < 0.35
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_languages_of_odd_texts(spark):
    rows = [(k, "the cat and the dog went out with their friends", "en", 1.0, "x") for k in range(40)] + [(100 + k, "der Hund und die Katze gingen mit ihren Freunden", "de", 1.0, "x") for k in range(40)]
    odd = [(200, None, "en", 1.0, "x"), (201, "", "en", 1.0, "x"), (202, "123 !!", "de", 1.0, "x"), (203, "Hund und Katze " * 60_000, None, 1.0, "x"), (None, "der Hund", "de", 1.0, "x"), (204, "the dog", None, 1.0, "x"), (204, "the dog", None, 1.0, "x")]
    schema = "doc_id long, text string, lang string, score double, lang_pred string"
    got = langid.language_id(spark.createDataFrame(rows + odd, schema)).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows) + len(odd)
    assert {by[k].lang_pred for k in (200, 201, 202)} == {"und"} and by[203].lang_pred == "de" and by[204].lang_pred == "en" and not by[None].held_out
    none = langid.language_id(spark.createDataFrame(odd, schema).withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r.lang_pred, r.score) for r in none} == {("und", 0.0)}
    assert langid.language_id(spark.createDataFrame([], schema)).count() == 0
    packed = langid.predict(spark.createDataFrame(rows[:2], schema), None).select("row.*")
    assert packed.columns == ["doc_id", "text", "lang", "score", "lang_pred"]


def test_long_text_has_the_bits_of_its_parts():
    import pyarrow as pa

    from loomframe.llm import chunks

    text = "eins zwei drei vier " * 50_000
    assert len(text) > chunks.WINDOW
    (_, long_bits), = langid.presence(pa.array([text]))
    (_, short_bits), = langid.presence(pa.array(["eins zwei drei vier eins zwei drei vier "]))
    assert (long_bits & ~short_bits).sum() == 0 and (short_bits & ~long_bits).sum() == 0


def test_n_grams_over_a_cut_count(monkeypatch):
    import pyarrow as pa

    from loomframe.llm import chunks

    rng = np.random.default_rng(8)
    text = " ".join("".join(rng.choice(list("abcdefghijklmnop"), 6)) for _ in range(3000))
    (_, whole), = langid.presence(pa.array([text]))
    windows = chunks.windows
    monkeypatch.setattr(langid, "windows", lambda data, offsets: windows(data, offsets, size=64))
    (_, parts), (_, other) = langid.presence(pa.array([text, "abc"]))
    assert (parts == whole).all() and other.sum() == 6


def test_short_texts_have_only_their_own_bits():
    import pyarrow as pa

    for short in ("a", "ok", "é", "abc"):
        (_, alone), = langid.presence(pa.array([short]))
        (_, first), (_, second) = langid.presence(pa.array([short, "several other words of another text"]))
        (_, after), = langid.presence(pa.array(["several other words of another text"]))
        assert (first == alone).all() and (second == after).all()


def dice(a, b):
    return 2 * len(a & b) / (len(a) + len(b)) if a or b else 0.0


def test_licences_are_brute_force(spark):
    mit = licences.TEMPLATES["MIT"]
    texts = ["Prose before.\nReleased under the MIT License.\nMore prose here.", "released UNDER the mit license", mit, " ".join(mit.split()).replace("charge", "cost"), "\n".join(mit.split("\n")) + "\n\nOther words.", "Licensed under CC BY-NC 4.0.", "Licensed under CC BY 4.0", None, "", "one", "\n\n\n", "Released under the MIT License. " * 500, "This work is licensed under the GNU General Public License, version 3.", "A file.\n\n" + mit.replace("conditions: The", "conditions:\n\nThe").replace("Software. THE", "Software.\n\nTHE") + "\n\n" + "other words of the file " * 60, licences.TEMPLATES["BSD-3-Clause"].replace(" 2. ", "\n\n2. ").replace(" THIS", "\n\nTHIS") + "\n\nint main", "long " * 200_000 + "\nReleased under the MIT License."]
    docs = spark.createDataFrame([(k, t, 0.1, "clash") for k, t in enumerate(texts)] + [(None, "Released under the MIT License.", 0.0, "")], "doc_id long, text string, dice double, unit string")
    got = {(r.doc_id, r.unit, r.unit_no, r.licence): r.dice for r in licences.licence_scan(docs).collect()}
    want = {}
    for k, t in [*enumerate(texts), (None, "Released under the MIT License.")]:
        if t is None:
            continue
        import re

        paragraphs = re.split(r"\n[ \t\r]*\n", t)
        units = [("line", n, x) for n, x in enumerate(t.split("\n"))] + [("paragraph", n, x) for n, x in enumerate(paragraphs) if "\n" in x] + ([("text", 0, t)] if len(paragraphs) > 1 else [])
        units += [(f"paragraphs {w}", n, "\n\n".join(paragraphs[n : n + w])) for w in licences.RUNS for n in range(len(paragraphs) - w + 1) if len(paragraphs) > w]
        for kind, n, part in units:
            grams = set(licences.template_bigrams(part))
            for name, template in licences.TEMPLATES.items():
                d = dice(grams, set(licences.template_bigrams(template)))
                if d >= 0.8:
                    want[(k, kind, n, name)] = d
    assert got == pytest.approx(want) and {x[3] for x in want} >= {"MIT", "MIT notice", "CC-BY-NC-4.0 notice", "GPL-3.0 notice", "BSD-3-Clause"} and {x[1] for x in want} >= {"paragraphs 3"}
    assert licences.licence_scan(docs.limit(0)).count() == 0


def test_licences_lower_a_text_once(spark, capsys):
    docs = spark.createDataFrame([(0, "Released under the MIT License.")], "doc_id long, text string")
    licences.licence_scan(docs.repartition(2)).explain("simple")
    plan = capsys.readouterr().out
    assert 1 <= plan.count("lower(") < 20  # not once for each anchor


def test_size_bounds_lose_nothing():
    for n in range(1, 60):
        low, high = licences.size_bounds(n, 0.8)
        reach = [m for m in range(1, 200) if 2 * min(n, m) / (n + m) >= 0.8]
        assert reach and (min(reach), max(reach)) == (low, high)


def test_anchors_are_in_every_match():
    for name, text in licences.TEMPLATES.items():
        grams = licences.template_bigrams(text)
        words = licences.anchors(grams, 0.8)
        assert words and not words & {"the", "of", "and", "to"}
        free = [g for g in grams if g not in words and not words & set(g.split())]
        assert all(2 * len(free) / (len(grams) + n) < 0.8 for n in range(max(1, len(free), licences.size_bounds(len(grams), 0.8)[0]), 2 * len(grams))), name


def test_rates_reach_the_targets(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    rows = mixing.mix(docs, labels).collect()
    assert len(rows) == docs.count()
    words = {r.doc_id: len([w for w in (r.text or "").replace("\x0b", " ").split() if w]) for r in docs.collect()}
    assert all(r.n_tokens == words[r.doc_id] and r.rate >= 0 and math.isclose(sum(r[d] for d in mixing.DOMAINS), 1, abs_tol=1e-9) for r in rows)
    total = sum(r.n_tokens for r in rows)
    for d in mixing.DOMAINS:
        assert sum(r.rate * r.n_tokens * r[d] for r in rows) == pytest.approx(mixing.TARGETS[d] * total, rel=1e-4)


def test_unreachable_targets_end_at_a_least_squares_point(spark):
    rng = np.random.default_rng(2)
    p = rng.dirichlet([0.3, 0.3, 0.3], size=200)
    tokens = rng.integers(1, 500, 200)
    df = spark.createDataFrame([(int(t), *map(float, x)) for t, x in zip(tokens, p)], "_tokens long, _p0 double, _p1 double, _p2 double")
    total = float(tokens.sum())
    for targets in ([0.6 * total, 0.3 * total, 0.1 * total], [total, 0.0, 0.0]):
        steps, start, reached = mixing.solve_rates(df, targets, iterations=60)
        r = np.array([x.r for x in df.withColumn("r", mixing.rate_column(steps, start)).collect()])
        assert (r >= 0).all()
        sums = (r * tokens) @ p
        assert np.allclose(sums, reached, rtol=1e-6)
        # a long brute-force projected gradient descent comes hardly nearer
        b = np.ones(200)
        second = p.T @ (p * tokens[:, None])
        for _ in range(4000):
            miss = (b * tokens) @ p - targets
            b = np.maximum(0, b - (p @ miss) / np.linalg.eigvalsh(second).max())
        assert np.linalg.norm(sums - targets) <= np.linalg.norm((b * tokens) @ p - targets) + 0.03 * total


def least_distance(p, target):
    """Of the target to the sums of rows with weights of 0 or more, by Lawson and Hanson's active sets."""
    used, x = [], np.zeros(len(p))
    while True:
        slope = p @ (target - x @ p)
        slope[used] = 0
        if slope.max() < 1e-12:
            return np.linalg.norm(target - x @ p)
        used.append(int(slope.argmax()))
        while True:
            best = np.linalg.lstsq(p[used].T, target, rcond=None)[0]
            if (best > 0).all():
                x[used] = best
                break
            now = x[used]
            low = best <= 0
            now = now + (now[low] / (now[low] - best[low])).min() * (best - now)
            x[used] = now
            x[x < 1e-15] = 0
            used = [k for k in used if x[k] > 0]


def test_rates_by_default_settings_are_the_nearest(spark):
    rng = np.random.default_rng(2)
    even = rng.dirichlet([0.3, 0.3, 0.3], size=200), rng.integers(1, 500, 200)
    odds = 1 / (1 + np.exp(-rng.normal([2.0, -3.0], [1.0, 1.5], (3000, 2))))
    q, x = odds.T
    skewed = np.stack([q * (1 - x), q * x, (1 - q) * (1 - x), (1 - q) * x], 1), rng.integers(1, 3000, 3000)
    for (p, tokens), shares in ((even, [1, 0, 0]), (skewed, [0.9, 0.03, 0.06, 0.01]), (skewed, [0.03, 0.9, 0.01, 0.06]), (skewed, [0, 0, 0, 1])):
        df = spark.createDataFrame([(int(t), *map(float, x)) for t, x in zip(tokens, p)], ["_tokens", *[f"_p{d}" for d in range(len(shares))]]).coalesce(1).cache()
        total = float(tokens.sum())
        steps, start, reached = mixing.solve_rates(df, [x * total for x in shares])
        r = np.array([x.r for x in df.select(mixing.rate_column(steps, start).alias("r")).collect()])
        sums = (r * tokens) @ p / total
        assert (r >= 0).all() and np.allclose(sums, np.array(reached) / total, atol=1e-7)
        assert np.linalg.norm(sums - shares) <= least_distance(p, np.array(shares, float)) + 1e-5
    with pytest.warns(UserWarning, match="mixing rates"):
        mixing.solve_rates(df, [0.0, 0.0, 0.0, total], iterations=3)


def test_mixing_of_odd_tables(spark):
    schema = "doc_id long, text string, rate double, _tokens long, source string"
    docs = spark.createDataFrame([(1, "good words here", 0.0, 1, "a"), (2, None, 0.0, 1, "a"), (3, "", 0.0, 1, "a"), (None, "bad words", 0.0, 1, "a"), (1, "good words here", 0.0, 1, "a")], schema)
    labels = spark.createDataFrame([(1, 1, 0), (1, None, None), (None, 0, 1), (7, 0, 0)], "doc_id long, quality int, toxic int")
    got = mixing.mix(docs, labels).collect()
    assert len(got) == 5 and all(r.rate >= 0 and not math.isnan(r.rate) for r in got)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert all(abs(r.good_clean - 0.25) < 1e-9 for r in mixing.mix(docs, none).collect())
    assert mixing.mix(docs.limit(0), labels).count() == 0
    assert mixing.mixed(docs, labels).columns == docs.columns


def test_rows_without_an_id_have_chances_of_their_own(spark):
    docs = spark.createDataFrame([(None, f"word{k} word{k % 7} and so on") for k in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    half = {d: 0.125 for d in mixing.DOMAINS}
    taken = mixing.mixed(docs, labels, half)
    assert {r.rate for r in mixing.mix(docs, labels, half).select(F.round("rate", 3).alias("rate")).collect()} == {0.5}
    assert 140 < taken.count() < 260 and taken.distinct().count() == taken.count()


def test_language_stage_without_a_model_keeps_texts_with_letters(spark):
    import corpus_pipeline as pipeline

    docs = spark.createDataFrame([(1, "the dog", None), (2, "der Hund", None), (3, "12 !", None), (4, None, None), (None, "un chien", None)], "doc_id long, text string, lang string")
    kept = pipeline.language_id(spark, docs, DATA)
    assert kept.columns == docs.columns and {r.text for r in kept.collect()} == {"the dog", "der Hund", "un chien"}


def test_pipeline_stages(spark):
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    extra = docs.unionByName(spark.createDataFrame([(10_001, None, "en", "s", 0), (10_002, "123", "en", "s", 3)], docs.schema))
    kept = pipeline.language_id(spark, extra, DATA)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in docs.collect()}
    from tests.llm.test_joins import brute

    one = pipeline.near_duplicates(spark, docs, DATA)
    parts = brute([(r.doc_id, r.text) for r in docs.collect()])
    assert one.columns == docs.columns and {r.doc_id for r in one.collect()} == {k for k, (_, c) in parts.items() if c == k}
    mixed = pipeline.mix(spark, one, DATA)
    rates = {r.doc_id: r.rate for r in mixing.mix(one, spark.read.parquet(f"{DATA}/labels.parquet")).collect()}
    copies = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert mixed.columns == docs.columns and all(math.floor(x) <= copies.get(k, 0) <= math.floor(x) + 1 for k, x in rates.items())
    last = pipeline.run(spark, DATA)
    assert last.filter("not lossless").count() == 0 and last.count() > 100


def test_mixing_takes_very_long_texts(spark):
    docs = spark.createDataFrame([(1, "good words " * 300_000), (2, "poor words"), (3, "good")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(8)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in mixing.mix(docs, labels).collect()}
    assert got[1].n_tokens == 600_000 and all(math.isclose(sum(r[d] for d in mixing.DOMAINS), 1, abs_tol=1e-9) for r in got.values())


def test_kernel_classifier_is_brute_force():
    import pyarrow as pa

    rng = np.random.default_rng(4)
    letters = {"a": "abcdefgh", "b": "efghijklm", "c": "lmnopqrs"}
    texts = [(lang, " ".join("".join(rng.choice(list(alphabet), rng.integers(2, 7))) for _ in range(12))) for lang, alphabet in letters.items() for _ in range(20)]

    def grams(text):
        seen = [2 + ord(c) - 97 if "a" <= c <= "z" else 1 for c in text.lower()]
        out = set()
        for k in range(len(seen)):
            for n in (1, 2, 3, 4):
                if k + n <= len(seen):
                    value = 0
                    for m, code in enumerate(seen[k : k + n], 1):
                        value = (value * 0x165667B1 + code * 2654435761 + m) % 2**32
                    value ^= value >> 15
                    out.add(value * (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F)[n - 1] % 2**32 >> 16)
        return out

    packed, labels, sets = [], [lang for lang, _ in texts], [grams(t) for _, t in texts]
    for row, bits in langid.presence(pa.array([t for _, t in texts])):
        assert set(np.flatnonzero(bits).tolist()) == sets[row]
        packed.append(np.packbits(bits).tobytes())
    model = langid.solve(packed, labels, landmarks=30, ridge=1e-3)
    kernel = lambda a, b: len(a & b) / math.sqrt(len(a) * len(b))
    marks = [sets[g * 20 + k] for k in range(10) for g in range(3)]
    gram = np.array([[kernel(a, b) for b in marks] for a in marks])
    values, vectors = np.linalg.eigh(gram)
    good = values > 1e-8 * values[-1]
    half = vectors[:, good] / np.sqrt(values[good])
    x = np.array([[kernel(a, b) for b in marks] for a in sets]) @ half
    y = np.where(np.array(labels)[:, None] == np.array(["a", "b", "c"]), 1.0, -1.0)
    design = np.hstack([x, np.ones((len(x), 1))])
    free = np.diag([1e-3 * len(x)] * x.shape[1] + [0.0])
    beta = np.linalg.solve(design.T @ design + free, design.T @ y)
    fresh = [" ".join("".join(rng.choice(list(alphabet), 5)) for _ in range(8)) for alphabet in letters.values()]
    want = np.hstack([np.array([[kernel(grams(t), b) for b in marks] for t in fresh]) @ half, np.ones((3, 1))]) @ beta
    rows = np.array([bits for _, bits in langid.presence(pa.array(fresh))]).astype(np.float32)
    got = rows @ model.weights / np.sqrt(rows.sum(axis=1, keepdims=True)) + model.bias
    assert np.allclose(got, want, atol=2e-3) and got.argmax(axis=1).tolist() == [0, 1, 2]


def test_ties_between_languages_go_to_the_first():
    model = langid.Model(["aa", "bb"], np.zeros((1 << langid.BITS, 2), np.float32), np.array([0.5, 0.5], np.float32))
    top, score = langid.scores(model, np.ones((1, 1 << langid.BITS), bool))
    assert top.tolist() == [0] and score.tolist() == [0.5]


def test_other_readers_can_follow_revisits(spark):
    import gzip

    same, hot = "shared payload " * 20, "hot payload " * 20
    rows = [(k, f"http://x/{k}", same if k % 2 else hot, "", 0) for k in range(12)] + [(0, "http://x/again", hot, "", 0), (99, "u", "short", "", 0), (99, "u", "short", "", 0), (None, None, "nobody's", "", 0)]
    manifest = warc.write_warc(warc.chunk_rows(spark.createDataFrame(rows, PAGES).repartition(3)), new_folder(spark, "test-warc"), archive=600)
    heads = []
    for path in [r.path for r in manifest.collect()]:
        data = gzip.open(path.removeprefix("file://")).read()
        assert data.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n")
        while data:
            head, _, data = data.partition(b"\r\n\r\n")
            fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
            data = data[int(fields["Content-Length"]) + 4 :]
            heads.append(fields)
    ids = [h["WARC-Record-ID"] for h in heads]
    responses = {h["WARC-Record-ID"]: h for h in heads if h["WARC-Type"] == "response"}
    revisits = [h for h in heads if h["WARC-Type"] == "revisit"]
    assert len(ids) == len(set(ids)) and len(responses) + len(revisits) == len(rows) and manifest.count() > 3
    assert {h["X-Refers-To-Page-ID"] for h in revisits if "WARC-Refers-To" not in h} == {"0"}
    for h in (h for h in revisits if h["X-Refers-To-Page-ID"] != "0"):
        to = responses[h["WARC-Refers-To"]]
        assert to["WARC-Payload-Digest"] == h["WARC-Payload-Digest"] and to["X-Page-ID"] == h["X-Refers-To-Page-ID"]


def test_pipeline_of_no_documents(spark, tmp_path):
    import corpus_pipeline as pipeline

    for name in ("documents", "labels"):
        spark.read.parquet(f"{DATA}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert pipeline.run(spark, str(tmp_path)).count() == 0


def test_near_duplicate_stage_of_repeated_ids(spark):
    import corpus_pipeline as pipeline

    docs = spark.createDataFrame([(1, "b text", None), (1, "a text", "en"), (2, "other words", "en"), (None, "x", "en"), (None, "x", "en")], "doc_id long, text string, lang string")
    rows = [sorted(map(tuple, pipeline.near_duplicates(spark, docs.repartition(n), DATA).collect()), key=str) for n in (1, 4)]
    assert rows[0] == rows[1] and [r for r in rows[0] if r[0] == 1] == [(1, "a text", "en")] and len(rows[0]) == 4


def test_near_duplicates_shuffle_few_texts(spark):
    import corpus_pipeline as pipeline

    rng = np.random.default_rng(5)
    texts = [" ".join(map(str, rng.integers(0, 2**40, 300))) for _ in range(300)]
    rows = [(k, t) for k, t in enumerate(texts)] + [(1000 + k, texts[k]) for k in range(10)]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as when the ids that go are too many
    try:
        for unique in (True, False):
            docs = spark.createDataFrame(rows if unique else [*rows, (None, texts[20]), (299, texts[0])], "doc_id long, text string")
            out = pipeline.near_duplicates(spark, docs, DATA)
            spark.sparkContext.setJobGroup(f"kept {unique}", "")
            got = sorted(map(tuple, out.collect()), key=str)
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
            tracker, store = spark.sparkContext.statusTracker(), spark.sparkContext._jsc.sc().statusStore()
            stages = {s for j in tracker.getJobIdsForGroup(f"kept {unique}") for s in tracker.getJobInfo(j).stageIds}
            sent = sum(store.lastStageAttempt(s).shuffleWriteBytes() for s in stages)
            assert stages and sent < sum(map(len, texts)) / 5
            if not unique:
                # 299 repeats with the text of 0, and so goes with all its rows
                assert got == sorted([(k, t) for k, t in enumerate(texts[:299])] + [(None, texts[20])], key=str)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
