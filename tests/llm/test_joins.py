import random
import re

import numpy as np
import pytest

from loomframe.llm import ngram_join, near_vectors, topk
from loomframe.llm.components import components

DOCS = "doc_id long, text string, component long, n int, shingles string"


def reached(nodes, links):
    parent = {x: x for x in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in nodes}


def shingles(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode())
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)}


def brute(docs):
    sets = {k: shingles(t) for k, t in docs}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    parts = reached(sets, links)
    return {k: (len(sets[k]), parts[k]) for k in sets}


def corpus(seed, n=160):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 4)))
    passage = [word() for _ in range(40)]
    texts = []
    for _ in range(n):
        kind = rng.random()
        if texts and kind < 0.5:
            words = rng.choice(texts).split()
            for _ in range(rng.randint(0, 1 + len(words) // 12)):
                if words:
                    words[rng.randrange(len(words))] = word()
            texts.append(" ".join(words).upper() if kind < 0.1 else " ".join(words))
        elif kind < 0.7:
            texts.append(" ".join([word() for _ in range(rng.randint(1, 60))] + passage))
        else:
            texts.append(" ".join(word() for _ in range(rng.choice([0, 1, 3, 4, 5, 6, 12, 80, 300]))))
    return texts


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_ngram_join_is_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(ngram_join, "COMMON", 50 if seed == 1 else 1 << 18)
    monkeypatch.setattr(ngram_join, "BLOCK", 2 if seed == 2 else 32)
    docs = [(k, t) for k, t in enumerate(corpus(seed))]
    df = spark.createDataFrame([(k, t, 1, 2, "clash") for k, t in docs], DOCS).repartition(5)
    rows = ngram_join.ngram_join(df).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == brute(docs) and len(rows) == len(docs)


def test_ngram_join_edges(spark):
    copies = "one two three four five six seven eight"
    rows = [(1, None), (2, ""), (3, "a b"), (4, "A  B"), (5, "a b c"), (None, copies), (6, copies), (7, copies.upper()), (7, copies), (8, "\x0b" + copies.replace(" ", "\t"))] + [(100 + k, "hot copy of one text that comes often") for k in range(200)]
    got = ngram_join.ngram_join(spark.createDataFrame([(k, t, 0, 0, "") for k, t in rows], DOCS)).collect()
    parts = {}
    for r in got:
        parts.setdefault(r.doc_id, set()).add((r.n_shingles, r.component_id))
    assert len(got) == len(rows)
    assert parts[1] == {(0, 1)} and parts[2] == {(0, 2)} and parts[3] == {(1, 3)} and parts[4] == {(1, 3)} and parts[5] == {(1, 5)}
    assert parts[None] == {(4, None)} and parts[6] == parts[7] == parts[8] == {(4, 6)}
    assert all(parts[100 + k] == {(4, 100)} for k in range(200))
    assert ngram_join.ngram_join(spark.createDataFrame([], DOCS)).count() == 0


def test_long_text_meets_its_copy(spark):
    rng = random.Random(9)
    words = [str(rng.randrange(10**6)) for _ in range(120_000)]
    near = words[:60_000] + ["x"] + words[60_000:]
    got = ngram_join.ngram_join(spark.createDataFrame([(5, " ".join(words), 0, 0, ""), (9, " ".join(near), 0, 0, ""), (11, " ".join(words[:100]), 0, 0, "")], DOCS)).collect()
    assert {r.doc_id: r.component_id for r in got} == {5: 5, 9: 5, 11: 11}


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(50)] + [(1000, k) for k in range(1001, 1100)] + [(2000, 2000), (None, 3), (7, 6)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long"), "u", "v").collect()}
    assert got == {**{k: 0 for k in range(51)}, **{k: 1000 for k in range(1000, 1100)}}


VECTORS = "vec_id long, embedding array<float>, label int, dist double, cell int"


def vectors(seed, n=300, dim=8):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(12, dim))
    rows = []
    for k in range(n):
        x = base[rng.integers(12)] + rng.normal(size=dim) * rng.choice([0.02, 0.2, 1.0])
        rows.append((k, [float(v) for v in np.float32(x)], int(rng.integers(3)), 0.0, 1))
    rows += [(n + k, rows[4][1], rows[4][2], 0.0, 1) for k in range(20)]
    rows += [(n + 20, None, 1, 0.0, 1), (n + 21, [0.0] * dim, 1, 0.0, 1), (n + 22, [float("nan")] * dim, 1, 0.0, 1), (n + 23, [None] * dim, 1, 0.0, 1), (n + 24, rows[4][1], None, 0.0, 1), (n + 25, [], 1, 0.0, 1), (n + 26, [1.0, 2.0], 1, 0.0, 1), (n + 27, [2.0, 4.0], 1, 0.0, 1), (n + 28, [float("inf")] * dim, 0, 0.0, 1)]
    return rows


def valid(x):
    return bool(x) and all(v is not None and np.isfinite(v) for v in x)


@pytest.mark.parametrize("seed", [1, 2])
def test_near_vectors_are_brute_force(spark, seed, monkeypatch):
    from loomframe.llm import vectors as deal

    if seed == 2:
        monkeypatch.setattr(deal, "BLOCK", 40)
        monkeypatch.setattr(near_vectors, "LEAF", 2)
    rows = vectors(seed)
    links = []
    for i, x, a, *_ in rows:
        for j, y, b, *_ in rows:
            if i < j and a is not None and a == b and valid(x) and valid(y) and len(x) == len(y) and any(x) and any(y):
                x64, y64 = np.array(x), np.array(y)
                if x64 @ y64 / (np.sqrt(x64 @ x64) * np.sqrt(y64 @ y64)) >= 0.93:
                    links.append((i, j))
    parts = reached([r[0] for r in rows], links)
    count = {r[0]: 0 for r in rows}
    for a, b in links:
        count[a] += 1
        count[b] += 1
    got = near_vectors.near_vectors(spark.createDataFrame(rows, VECTORS).repartition(3)).collect()
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got} == {k: (count[k], parts[k], parts[k] == k) for k in parts}
    assert near_vectors.near_vectors(spark.createDataFrame([], VECTORS)).count() == 0


def test_vectors_without_an_id_stand_alone(spark):
    rows = [(None, [1.0, 0.0], 1, 0.0, 0), (3, [1.0, 0.0], 1, 0.0, 0), (3, [1.0, 0.0], 1, 0.0, 0)]
    got = sorted((str(r.vec_id), r.n_links, r.component_id, r.kept) for r in near_vectors.near_vectors(spark.createDataFrame(rows, VECTORS)).collect())
    assert got == [("3", 1, 3, True), ("3", 1, 3, True), ("None", 0, None, True)]


@pytest.mark.parametrize("seed", [1, 2])
def test_top_k_is_brute_force(spark, seed, monkeypatch):
    from loomframe.llm import vectors as deal

    if seed == 2:
        monkeypatch.setattr(deal, "BLOCK", 30)
        monkeypatch.setattr(topk, "STEP", 4)
    rows = vectors(seed)
    whole = {i: np.floor(np.array(x, float) * 1024).astype(int) for i, x, *_ in rows if valid(x)}
    want = {}
    for q in whole:
        if q % 20 == 0:
            scores = sorted((-int(whole[q] @ y), i) for i, y in whole.items() if i != q and len(y) == len(whole[q]))
            want |= {(q, k): (i, -s) for k, (s, i) in enumerate(scores[:10], 1)}
    got = topk.top_k(spark.createDataFrame(rows, VECTORS).repartition(3), every=20).collect()
    assert {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in got} == want and len(got) == len(want)
    assert topk.top_k(spark.createDataFrame([], VECTORS)).count() == 0


@pytest.mark.parametrize("own", [[20], [14, 18, 23, 30]])
def test_templated_pages_ask_few_groups(spark, own):
    rng = random.Random(1)
    word = lambda: str(rng.randrange(10**9))
    shared, n = [word() for _ in range(100)], 300
    rows = [(k, " ".join(shared + [word() for _ in range(rng.choice(own))])) for k in range(n)]
    rows += [(1000 + k, rows[k][1] + " end") for k in range(5)]
    known = ngram_join.prepared(spark.createDataFrame(rows, "id long, text string").repartition(3))
    assert known.queries.count() < n * n / 2 / 20
    got = ngram_join.ngram_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows)


def test_bounds_close_groups_and_opened_ones_are_exact():
    rng = np.random.default_rng(5)
    closed = 0
    for _ in range(300):
        base = rng.integers(0, 2**63, 60, dtype=np.uint64)
        member = lambda: np.unique(np.concatenate([rng.choice(base, rng.integers(1, 60), replace=False), rng.integers(0, 2**63, rng.integers(0, 20), dtype=np.uint64)]))
        members = [(k, member()) for k in range(rng.integers(1, 6))]
        import pyarrow as pa

        rows = pa.RecordBatch.from_pylist([{"block": 4, "id": k, "shingles": v.tobytes()} for k, v in members])
        (stored,) = [b.to_pylist()[0] for b in ngram_join._stored(iter([rows]))]
        group = ngram_join.Group(stored["low"], stored["n_union"], stored["n_members"], stored["bytes"])
        query = member()
        found = group.linked(99, query, 75)
        closed += found is None
        assert (found or []) == [k for k, v in members if 100 * len(np.intersect1d(query, v)) >= 75 * len(np.union1d(query, v))]
    assert 20 < closed < 290


def test_streams_keep_shingles_that_are_met():
    import pyarrow as pa

    rng = random.Random(3)
    for _ in range(200):
        indexed = {(s, k): rng.random() < 0.6 for s in range(6) for k in range(4)}
        cells = {(rng.randrange(6), rng.randrange(4)) for _ in range(rng.randrange(12))}
        rows = sorted((s, not indexed[s, k], k, 5) for s, k in cells for _ in range(rng.choice([1, 1, 2])))
        want = [r for r in sorted(set(rows)) if len({x for x in rows if x[0] == r[0]}) > 1 and not min(x[1] for x in rows if x[0] == r[0])]
        batches, at = [], 0
        while at < len(rows):
            n = rng.randint(1, 4)
            part = rows[at : at + n]
            batches.append(pa.record_batch({"shingle": [r[0] for r in part], "id": [r[2] for r in part], "n": [r[3] for r in part], "indexed": [not r[1] for r in part]}))
            at += n
        got = [(s, not i, k, n) for b in ngram_join._met_only(iter(batches)) for s, k, n, i in zip(*b.to_pydict().values())]
        assert sorted(got) == want


def test_equal_distances_don_t_fill_a_block(spark, monkeypatch):
    from pyspark.sql import functions as F

    from loomframe.llm import vectors as deal

    monkeypatch.setattr(deal, "BLOCK", 64)
    rows = [(k, [float(k % 97 == j) + float(k // 97 % 97 == j) for j in range(97)]) for k in range(1200)]
    df = spark.createDataFrame(rows, "id long, vec array<double>").select("id", "vec", F.lit("g").alias("grp"), F.lit(1).cast("long").alias("copies"))
    dealt, _ = deal.keyed(df)
    sizes = [r["count"] for r in dealt.groupBy("block").count().collect()]
    assert sum(sizes) == 1200 and max(sizes) <= 2 * 64


def test_queries_and_blocks_meet_only_where_bounds_allow(spark, monkeypatch):
    from pyspark.sql import functions as F

    from loomframe.llm import vectors as deal

    monkeypatch.setattr(deal, "BLOCK", 50)
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(40, 6)) * 4
    rows = [(k, [float(v) for v in centres[k % 40] + 0.05 * rng.normal(size=6)], 1, 0.0, 0) for k in range(2000)]
    df = spark.createDataFrame(rows, VECTORS)
    slim = df.select(F.col("vec_id").alias("id"), F.lit(1).cast("long").alias("copies"), F.lit("g").alias("grp"), F.col("embedding").cast("array<double>").alias("vec"))
    dealt, pivots = deal.keyed(slim, "unit")
    trees = dealt.groupBy("block").applyInPandas(near_vectors._trees, "block long, grp string, cell int, high double, centre array<double>, radius double, tree binary").cache()
    n = trees.count()
    assert near_vectors.block_pairs(trees, pivots, 0.93).count() < n * (n - 1) / 2 / 3
    whole = {i: np.floor(np.array(x) * 1024).astype(int) for i, x, *_ in rows}
    want = {}
    for q in range(0, 2000, 100):
        scores = sorted((-int(whole[q] @ y), i) for i, y in whole.items() if i != q)
        want |= {(q, k): (i, -s) for k, (s, i) in enumerate(scores[:10], 1)}
    asked = []
    meets = topk.asked_blocks
    monkeypatch.setattr(topk, "asked_blocks", lambda seeds, blocks, found: asked.append((blocks.count(), seeds.count(), meets(seeds, blocks, found).count())) or meets(seeds, blocks, found))
    got = topk.top_k(df).collect()
    assert {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in got} == want
    ((blocks, queries, sent),) = asked
    assert queries == 20 and sent < blocks * queries / 2


def test_top_k_of_repeated_and_null_queries(spark):
    rows = [(0, [1.0, 0.0], 1, 0.0, 0), (0, [0.5, 0.0], 1, 0.0, 0), (1, [1.0, 1.0], 1, 0.0, 0), (2, [0.0, 1.0], 1, 0.0, 0), (None, [9.0, 9.0], 1, 0.0, 0)]
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(spark.createDataFrame(rows, VECTORS), k=5).orderBy("rank").collect()]
    assert got == [(0, 1, 1, 512 * 1024), (0, 2, 2, 0)]


def _broadcast_rows(spark, since):
    """Rows of the largest broadcast among the queries after the given one, and the last query's number."""
    store, most = spark._jsparkSession.sharedState().statusStore(), 0
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    runs = store.executionsList()
    ids = [runs.apply(n).executionId() for n in range(runs.size())]
    for run in (x for x in ids if x > since):
        nodes, values = store.planGraph(run).allNodes(), store.executionMetrics(run)
        for node in (nodes.apply(n) for n in range(nodes.size())):
            for metric in (node.metrics().apply(n) for n in range(node.metrics().size())):
                if node.name() == "BroadcastExchange" and metric.name() == "number of output rows" and values.contains(metric.accumulatorId()):
                    most = max(most, int(values.apply(metric.accumulatorId()).replace(",", "")))
    return most, max(ids, default=-1)


def test_top_k_broadcasts_no_queries(spark, monkeypatch):
    from loomframe.llm import vectors as deal

    monkeypatch.setattr(deal, "BLOCK", 50)
    rng = np.random.default_rng(8)
    rows = [(k, [float(v) for v in rng.normal(size=16)], 1, 0.0, 0) for k in range(2000)]
    whole = np.floor(np.array([x for _, x, *_ in rows], np.float64) * 1024).astype(int)
    want = {}
    for q in range(0, 2000, 4):
        scores = sorted((-int(s), i) for i, s in enumerate(whole @ whole[q]) if i != q)
        want |= {(q, k): (i, -s) for k, (s, i) in enumerate(scores[:10], 1)}
    before = _broadcast_rows(spark, 1 << 60)[1]
    got = topk.top_k(spark.createDataFrame(rows, VECTORS), every=4).collect()
    assert {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in got} == want
    most, last = _broadcast_rows(spark, before)
    assert last > before and 0 < most < 250  # about 160 pivots; queries by cells would be 500 times as many


def test_regions_are_cut_and_queries_dealt_to_parts(spark, monkeypatch):
    from loomframe.llm import vectors as deal

    monkeypatch.setattr(deal, "BLOCK", 30)
    for name, value in (("REGION_BYTES", 8 * 6 * 100), ("QUERIES", 7), ("TOGETHER", 3), ("STEP", 5)):
        monkeypatch.setattr(topk, name, value)
    rng = np.random.default_rng(9)
    # a fifth of the rows are one vector, which fills a cell beyond a region
    rows = [(k, [0.5] * 6 if k % 5 == 0 else [float(v) for v in rng.normal(size=6)], 1, 0.0, 0) for k in range(1500)]
    whole = np.floor(np.array([x for _, x, *_ in rows], np.float64) * 1024).astype(int)
    want = {}
    for q in range(0, 1500, 30):
        scores = sorted((-int(s), i) for i, s in enumerate(whole @ whole[q]) if i != q)
        want |= {(q, k): (i, -s) for k, (s, i) in enumerate(scores[:10], 1)}
    seen = []
    cut = topk.regions
    monkeypatch.setattr(topk, "regions", lambda *a: seen.append(cut(*a)) or seen[-1])
    got = topk.top_k(spark.createDataFrame(rows, VECTORS).repartition(3), every=30).collect()
    assert {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in got} == want and len(got) == len(want)
    assert max(slices for _, slices in seen[0].values()) > 1 and max(first for first, _ in seen[0].values()) > 10


@pytest.mark.parametrize("size", [3, 1 << 10, 1 << 15, (1 << 26) - 1])
def test_blocks_searched_together_are_brute_force(size):
    rng = np.random.default_rng(size)
    centres = rng.integers(-size // 2, size // 2 + 1, (5, 64))
    blocks, rows = [], []
    for n in range(5):
        x = centres[n] + rng.integers(-max(1, size // 50), max(1, size // 50) + 1, (700, 64))
        ids, dist = np.arange(700 * n, 700 * (n + 1)), np.sqrt(((x - centres[n]) ** 2.0).sum(axis=1))
        order = np.lexsort((ids, dist))
        blocks.append((ids[order], topk.packed(x[order].astype(np.float64)), dist[order], centres[n].astype(np.float64), float((x.astype(np.float64) ** 2).sum(axis=1).max())))
        rows.append(x)
    x = np.concatenate(rows)
    query_ids = np.arange(0, 3500, 50)
    floors = np.where(query_ids % 100 == 0, -np.inf, 0.0)
    scored = []
    plain = topk._scores
    topk._scores = lambda a, b, reach: scored.append(len(a) * len(b)) or plain(a, b, reach)
    try:
        found = topk.search(blocks, query_ids, np.stack([topk.unpacked(topk.packed(x[q].astype(np.float64)).tobytes(), 64) for q in query_ids]), floors, 10)
    finally:
        topk._scores = plain
    for n, q in enumerate(query_ids):
        scores = sorted((-int(s), i) for i, s in enumerate(x @ x[q]) if i != q and s >= floors[n])[:10]
        assert list(zip(found.ids[found.at == n].tolist(), found.scores[found.at == n].tolist())) == [(i, -s) for s, i in scores]
    assert size < 1 << 10 or sum(scored) < 0.7 * len(x) * len(query_ids)
