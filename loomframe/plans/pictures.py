"""Queries of pictures and sound: planes, comparison, prediction, transforms, filters and models."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomframe.functions import media as M
from loomframe.operators import signal as S
from loomframe.plans.registry import LINE_ORDER, events, lines, query

# a picture is 96 samples: 8 x 8 of luma, and two planes of 4 x 4
_FRAME = """p AS (SELECT event_id // 96 AS frame, event_id % 96 AS pos, CAST(round(value * 100) AS BIGINT) % 256 AS v FROM events),
    f AS (SELECT *, CASE WHEN pos < 64 THEN 0 ELSE 1 + (pos - 64) // 16 END AS plane, CASE WHEN pos < 64 THEN pos // 8 ELSE (pos - 64) % 16 // 4 END AS y, CASE WHEN pos < 64 THEN pos % 8 ELSE pos % 4 END AS x FROM p)"""


def _frames(t) -> DataFrame:
    rows = t("events").select(F.floor(F.col("event_id") / 96).alias("frame"), (F.col("event_id") % 96).alias("pos"), (F.round(F.col("value") * 100).cast("long") % 256).alias("v"))
    return rows.withColumn("place", S.plane_place(F.col("pos"), 8, 8)).select("frame", "pos", "place.*", "v")


@query(f"WITH {_FRAME} SELECT frame, plane, y, x, v, pos AS back FROM f")
def plane_split(t):
    return _frames(t).select("frame", "plane", "y", "x", "v", S.plane_position(F.col("plane"), F.col("y"), F.col("x"), 8, 8).alias("back"))


@query("SELECT event_id, event_id // 100 % 2 AS parity, event_id // 200 AS field_row, event_id // 100 AS y FROM events")
def field_split(t):
    """Rows dealt to two fields by parity, and the row that each field row is again."""
    y = F.floor(F.col("event_id") / 100)
    split = t("events").select("event_id", (y % 2).alias("parity"), F.floor(y / 2).alias("field_row"))
    return split.withColumn("y", F.col("field_row") * 2 + F.col("parity"))


@query(f"""WITH {_FRAME}, n AS (SELECT frame, plane, count(*) AS n FROM f GROUP BY ALL),
    j AS (SELECT a.frame, a.plane, avg((a.v - b.v) * (a.v - b.v)) AS mse, bool_and(abs(a.v - b.v) <= 200) AS ok, count(*) FILTER (a.v <> b.v) AS d, max(abs(a.v - b.v)) AS m FROM f a JOIN f b ON b.frame = a.frame + 1 AND b.pos = a.pos GROUP BY ALL),
    s AS (SELECT a.frame, a.plane, coalesce(a.n = b.n, false) AS whole FROM n a LEFT JOIN n b ON b.frame = a.frame + 1 AND b.plane = a.plane)
    SELECT s.frame, s.plane, CASE WHEN whole AND mse > 0 THEN round(10 * log10(65025.0 / mse), 6) END AS psnr, whole AND ok AS within_tol, CASE WHEN whole THEN d ELSE 0 END AS n_diff, CASE WHEN whole THEN m END AS max_abs
    FROM s LEFT JOIN j ON s.frame = j.frame AND s.plane = j.plane""")
def frame_compare(t):
    """Each plane against that of the next frame; the last frames have none of their size."""
    f = _frames(t)
    found = S.compared(f, f.withColumn("frame", F.col("frame") - 1), ["frame", "plane"], ["y", "x"], "v", 200)
    return found.select("frame", "plane", F.round(F.when(F.col("psnr") != float("inf"), F.col("psnr")), 6).alias("psnr"), "within_tol", "n_diff", "max_abs")


@query(f"""WITH {_FRAME}, g AS (SELECT p AS plane, y, x, y * CASE p WHEN 0 THEN 8 ELSE 4 END // CASE p WHEN 0 THEN 3 ELSE 2 END AS sy, x * CASE p WHEN 0 THEN 8 ELSE 4 END // CASE p WHEN 0 THEN 5 ELSE 3 END AS sx
      FROM range(3) a(p), range(3) b(y), range(5) c(x) WHERE y < CASE p WHEN 0 THEN 3 ELSE 2 END AND x < CASE p WHEN 0 THEN 5 ELSE 3 END)
    SELECT f.frame, g.plane, g.y, g.x, f.v FROM f JOIN g ON f.plane = g.plane AND f.y = g.sy AND f.x = g.sx""")
def scale_planes(t):
    return S.scaled_planes(_frames(t).drop("pos"), "frame", "v", (8, 8), (5, 3))


@query(f"WITH {_FRAME} SELECT a.frame, a.pos, a.v - coalesce(b.v, 0) AS residual FROM f a LEFT JOIN f b ON b.frame = a.frame - 1 AND b.pos = a.pos")
def inter_residual(t):
    """What is left of a frame behind the one before, the first one against nothing."""
    f = _frames(t)
    before = f.select((F.col("frame") + 1).alias("frame"), "pos", F.col("v").alias("before"))
    return f.join(before, ["frame", "pos"], "left").select("frame", "pos", (F.col("v") - F.coalesce("before", F.lit(0))).alias("residual"))


@query(f"WITH {_FRAME} SELECT a.frame, a.plane, CAST(sum((a.v - b.v) * (a.v - b.v)) AS BIGINT) AS sse FROM f a JOIN f b ON b.frame = a.frame - 1 AND b.pos = a.pos GROUP BY ALL")
def block_sse(t):
    f = _frames(t)
    joined = f.join(f.select((F.col("frame") + 1).alias("frame"), "pos", F.col("v").alias("before")), ["frame", "pos"])
    return S.residual_error(joined, ["frame", "plane"], F.col("v"), F.col("before"))


_LINES_SQL = "[i + j, i + j // 2, i, 3 + i - j // 2, 7 + i - j, 3 - i // 2 + j, j, i // 2 + j]"


@query(f"""WITH b AS (SELECT event_id // 64 AS block, event_id % 64 // 8 AS i, event_id % 8 AS j, CAST(round(value * 100) AS BIGINT) % 256 - 128 AS v FROM events),
    w AS (SELECT block FROM b GROUP BY block HAVING count(*) = 64), s AS (SELECT block, d, {_LINES_SQL}[d + 1] AS line, sum(v) AS s, count(*) AS k FROM b JOIN w USING (block), range(8) r(d) GROUP BY ALL),
    c AS (SELECT block, d, CAST(sum(s * s * (840 // k)) AS BIGINT) AS cost FROM s GROUP BY ALL), m AS (SELECT block, max(cost) AS best, min(d) AS d FROM c c1 WHERE cost = (SELECT max(cost) FROM c c2 WHERE c2.block = c1.block) GROUP BY block)
    SELECT m.block, m.d AS direction, (m.best - c.cost) // 1024 AS variance FROM m JOIN c ON c.block = m.block AND c.d = (m.d + 4) % 8""")
def edge_direction(t):
    e = F.col("event_id")
    blocks = t("events").select(F.floor(e / 64).alias("block"), F.floor(e % 64 / 8).alias("i"), (e % 8).alias("j"), (F.round(F.col("value") * 100).cast("long") % 256).alias("v"))
    return S.edge_directions(blocks, "block", "i", "j", "v")


@query("SELECT event_id // 64 AS block, count(DISTINCT CAST(round(value) AS BIGINT) % 16) AS n_colours, array_to_string(list_sort(list(DISTINCT CAST(round(value) AS BIGINT) % 16)), ',') AS palette FROM events GROUP BY 1")
def palette(t):
    colours = F.array_sort(F.collect_set(F.round("value").cast("long") % 16))
    found = t("events").groupBy(F.floor(F.col("event_id") / 64).alias("block")).agg(colours.alias("c"))
    return found.select("block", F.size("c").cast("long").alias("n_colours"), F.array_join("c", ",").alias("palette"))


# --- prediction


_NEAR = """g AS (SELECT event_id % 100 AS x, event_id // 100 AS y, CAST(round(value * 100) AS BIGINT) % 256 AS v FROM events),
    h AS (SELECT *, lag(v) OVER (PARTITION BY y ORDER BY x) AS l, lag(v) OVER (PARTITION BY x ORDER BY y) AS u FROM g), n AS (SELECT *, lag(u) OVER (PARTITION BY y ORDER BY x) AS c FROM h)"""


def _neighbours(t) -> DataFrame:
    g = t("events").select((F.col("event_id") % 100).alias("x"), F.floor(F.col("event_id") / 100).alias("y"), (F.round(F.col("value") * 100).cast("long") % 256).alias("v"))
    return S.with_neighbours(g, "x", "y", "v")


@query(f"""WITH {_NEAR}, p AS (SELECT *, abs(u - c) AS a, abs(l - c) AS b, abs(l + u - 2 * c) AS d FROM n WHERE c IS NOT NULL)
    SELECT x, y, CASE WHEN a <= b AND a <= d THEN l WHEN b <= d THEN u ELSE c END AS pred FROM p""")
def nearest_pred(t):
    n = _neighbours(t).filter("corner is not null")
    return n.select("x", "y", M.nearest_predictor(F.col("left"), F.col("up"), F.col("corner")).alias("pred"))


@query(f"""WITH {_NEAR} SELECT x // 4 AS bx, y // 4 AS "by", (sum(CASE WHEN y % 4 = 0 THEN u ELSE 0 END) + sum(CASE WHEN x % 4 = 0 THEN l ELSE 0 END) + 4) // 8 AS dc
    FROM n GROUP BY ALL HAVING count(*) = 16 AND count(CASE WHEN y % 4 = 0 THEN u END) = 4 AND count(CASE WHEN x % 4 = 0 THEN l END) = 4""")
def dc_pred(t):
    """The mean of the samples above and to the left of each 4 x 4 block that has all of them."""
    n = _neighbours(t)
    return S.border_means(n, "x", "y", 4).select("bx", "by", "dc")


@query(f"""WITH {_NEAR} SELECT x, y, greatest(0, least(255, CAST(floor((e1 - 5 * e2 + 20 * v + 20 * e4 - 5 * e5 + e6 + 16) / 32.0) AS BIGINT))) AS half, CAST(floor((v * (8 - x % 8) + e4 * (x % 8) + 4) / 8.0) AS BIGINT) AS between FROM
      (SELECT x, y, v, coalesce(lag(v, 2) OVER w, first_value(v) OVER w) AS e1, coalesce(lag(v, 1) OVER w, v) AS e2, coalesce(lead(v, 1) OVER w, v) AS e4, coalesce(lead(v, 2) OVER w, lead(v, 1) OVER w, v) AS e5, coalesce(lead(v, 3) OVER w, lead(v, 2) OVER w, lead(v, 1) OVER w, v) AS e6 FROM g WINDOW w AS (PARTITION BY y ORDER BY x))""")
def half_samples(t):
    """Six-tap half samples and bilinear ones between a row's neighbours; beyond its ends the last sample goes on."""
    taps = S.row_taps(_neighbours(t), "x", "y", "v", 2, 3)
    return taps.select("x", "y", M.six_tap([F.col(f"tap{k}") for k in range(6)]).alias("half"), M.bilinear(F.col("tap2"), F.col("tap3"), F.col("x") % 8).alias("between"))


_VEC = "SELECT event_id, event_id % 41 - 20 AS a, user_id % 37 - 18 AS b, event_id // 3 % 29 - 14 AS c, event_id % 3 AS ra, user_id % 3 AS rb, event_id // 5 % 3 AS rc, event_id % 11 = 0 AS na, event_id % 4 = 0 AS nb, event_id % 4 < 2 AS nc FROM events"


@query(f"""WITH v AS ({_VEC}), w AS (SELECT event_id, CASE WHEN NOT na THEN a END AS a, CASE WHEN NOT nb THEN b END AS b, CASE WHEN NOT nc THEN c END AS c, NOT na AND ra = 1 AS ha, NOT nb AND rb = 1 AS hb, NOT nc AND rc = 1 AS hc FROM v)
    SELECT event_id, CASE WHEN CAST(ha AS INT) + CAST(hb AS INT) + CAST(hc AS INT) = 1 THEN CASE WHEN ha THEN a WHEN hb THEN b ELSE c END WHEN b IS NULL AND c IS NULL AND a IS NOT NULL THEN a ELSE list_sort([coalesce(a, 0), coalesce(b, 0), coalesce(c, 0)])[2] END AS predicted FROM w""")
def median_vector(t):
    v = t("events").selectExpr(*[c.strip() for c in _VEC.replace("SELECT ", "").replace(" FROM events", "").replace("event_id // 3", "cast(floor(event_id / 3) as bigint)").replace("event_id // 5", "cast(floor(event_id / 5) as bigint)").split(", ")])
    there = lambda c, n: F.when(~F.col(n), F.col(c))
    return v.select("event_id", M.median_vector([there("a", "na"), there("b", "nb"), there("c", "nc")], [there("ra", "na"), there("rb", "nb"), there("rc", "nc")], F.lit(1)).alias("predicted"))


@query("""WITH d AS (SELECT event_id, event_id % 200 - 100 AS v, user_id % 300 - 150 AS tb, event_id // 7 % 300 - 150 AS td FROM events), c AS (SELECT *, greatest(-128, least(127, tb)) AS b, greatest(-128, least(127, td)) AS d FROM d)
    SELECT event_id, CAST(CASE WHEN td = 0 THEN v ELSE floor((v * floor((b * ((16384 + abs(d) // 2) // d) + 32) / 64.0) + 256) / 512.0) END AS BIGINT) AS scaled FROM c""")
def vector_scale(t):
    td = F.floor(F.col("event_id") / 7) % 300 - 150
    return t("events").select("event_id", M.scaled_vector(F.col("event_id") % 200 - 100, F.col("user_id") % 300 - 150, td).cast("long").alias("scaled"))


@query("""WITH d AS (SELECT event_id, event_id % 256 AS p, event_id // 3 % 256 AS q, user_id % 129 - 64 AS w, event_id % 31 - 15 AS o FROM events)
    SELECT event_id, greatest(0, least(255, CAST(floor((p * w + 16) / 32.0) AS BIGINT) + o)) AS one, greatest(0, least(255, CAST(floor((p * w + q * (64 - w) + 32) / 64.0) AS BIGINT) + CAST(floor((o + 3 + 1) / 2.0) AS BIGINT))) AS two, greatest(0, least(255, p * w + o)) AS plain, (p + q + 1) // 2 AS mean FROM d""")
def weighted_pred(t):
    e = F.col("event_id")
    d = t("events").select("event_id", (e % 256).alias("p"), (F.floor(e / 3) % 256).alias("q"), (F.col("user_id") % 129 - 64).alias("w"), (e % 31 - 15).alias("o"))
    p, q, w, o = (F.col(c) for c in "pqwo")
    return d.select("event_id", M.weighted(p, w, o, 5).alias("one"), M.weighted_pair(p, q, w, 64 - w, o, F.lit(3).cast("long"), 5).alias("two"), M.weighted(p, w, o, 0).alias("plain"), M.average_pair(p, q).alias("mean"))


_TABLES = f"[{', '.join(map(str, M.ALPHA))}]", f"[{', '.join(map(str, M.BETA))}]"


@query(f"""WITH d AS (SELECT event_id, greatest(0, least(51, user_id % 60 + 2 * (event_id % 13 - 6))) AS a FROM events) SELECT event_id, {_TABLES[0]}[a + 1] AS alpha, {_TABLES[1]}[a + 1] AS beta FROM d""")
def deblock_thresholds(t):
    qp, offset = F.col("user_id") % 60, F.col("event_id") % 13 - 6
    return t("events").select("event_id", M.threshold(M.ALPHA, qp, offset).alias("alpha"), M.threshold(M.BETA, qp, offset).alias("beta"))


@query("""WITH d AS (SELECT event_id, event_id % 7 = 0 AS intra, event_id % 4 = 0 AS edge, user_id % 5 = 0 AS coded, event_id % 3 <> 0 AS same, event_id % 11 - 5 AS dx, user_id % 9 - 4 AS dy FROM events)
    SELECT event_id, CASE WHEN intra THEN CASE WHEN edge THEN 4 ELSE 3 END WHEN coded THEN 2 WHEN NOT same OR abs(dx) >= 4 OR abs(dy) >= 4 THEN 1 ELSE 0 END AS strength, CASE WHEN intra THEN 4 WHEN NOT same OR abs(dx) >= 4 OR abs(dy) >= 4 THEN 1 ELSE 0 END AS plain FROM d""")
def boundary_strength(t):
    e, u = F.col("event_id"), F.col("user_id")
    intra, same, dx, dy = e % 7 == 0, e % 3 != 0, e % 11 - 5, u % 9 - 4
    return t("events").select("event_id", M.boundary_strength(intra, e % 4 == 0, u % 5 == 0, same, dx, dy).alias("strength"), M.plain_boundary_strength(intra, same, dx, dy).alias("plain"))


# --- transforms, windows and models


def _coefficients(t, n: int) -> DataFrame:
    """(vec_id, block, k, v): the components of each vector in blocks of n."""
    pos = t("embeddings").select("vec_id", F.posexplode(F.col("embedding").cast("array<double>")).alias("pos", "v"))
    return pos.select("vec_id", F.floor(F.col("pos") / n).alias("block"), (F.col("pos") % n).cast("long").alias("k"), "v")


_COEF = "e AS (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS v, unnest(range(len(embedding))) AS pos FROM embeddings), c AS (SELECT vec_id, pos // 16 AS block, pos % 16 AS k, v FROM e)"
_TIME = f"{_COEF}, m AS (SELECT vec_id, block, n, sum(v * cos({pi / 32!r}::DOUBLE * (2 * n + 9) * (2 * k + 1)) / 16) AS v FROM c, range(32) r(n) GROUP BY ALL)"


@query(f"WITH {_TIME} SELECT vec_id, block, n AS out, round(v, 6) + 0.0 AS v FROM m")
def inverse_cosine(t):
    found = S.linear(_coefficients(t, 16), ["vec_id", "block"], "k", "v", S.inverse_cosines(t("embeddings").sparkSession, 16))
    return found.select("vec_id", "block", "out", (F.round("v", 6) + 0.0).alias("v"))


@query(f"""WITH {_TIME} SELECT a.vec_id, a.block, a.n AS out, round(a.v * sin({pi / 32!r}::DOUBLE * (a.n + 0.5)) + coalesce(b.v * sin({pi / 32!r}::DOUBLE * (15 - a.n + 0.5)), 0), 6) + 0.0 AS v FROM m a LEFT JOIN m b ON a.vec_id = b.vec_id AND b.block = a.block - 1 AND b.n = a.n + 16 WHERE a.n < 16""")
def overlap_halves(t):
    """Windowed halves of neighbouring blocks added up."""
    time = S.linear(_coefficients(t, 16), ["vec_id", "block"], "k", "v", S.inverse_cosines(t("embeddings").sparkSession, 16))
    return S.overlapped(time, ["vec_id"], "block", "out", "v", 16).select("vec_id", "block", "out", (F.round("v", 6) + 0.0).alias("v"))


_I0 = "list_sum(list_transform(range(0, 41), lambda k: power(power({x} / 2, k) / gamma(CAST(k + 1 AS DOUBLE)), 2)))"


@query(f"""WITH h AS (SELECT i, {_I0.format(x=f'((i + 0.5) * {4 * pi / 64!r}::DOUBLE)')} AS b FROM range(32) r(i)), s AS (SELECT i, sqrt(sum(b) OVER (ORDER BY i) / sum(b) OVER ()) AS w FROM h)
    SELECT i, round(sin({pi / 64!r}::DOUBLE * (i + 0.5)), 9) AS sine, round((SELECT w FROM s WHERE s.i = least(r.i, 63 - r.i)), 9) AS bessel FROM range(64) r(i)""")
def window_shapes(t):
    shapes = S.bessel_window(t("region").sparkSession, 64, 4.0)
    return shapes.select("i", F.round(S.sine_window(F.col("i"), 64), 9).alias("sine"), F.round("w", 9).alias("bessel"))


def _square_sql() -> tuple[str, str]:
    four = lambda a, b, c, d: [f"({a}) + ({c}) + ({b}) + (({d}) >> 1)", f"({a}) - ({c}) + (({b}) >> 1) - ({d})", f"({a}) - ({c}) - (({b}) >> 1) + ({d})", f"({a}) + ({c}) - ({b}) - (({d}) >> 1)"]
    rows = [x for r in range(4) for x in four(*[f"w[{4 * r + c + 1}]" for c in range(4)])]
    columns = [four(*[f"h[{4 * r + c + 1}]" for r in range(4)]) for c in range(4)]
    return "[" + ", ".join(rows) + "]", "[" + ", ".join(f"({columns[c][r]} + 32) >> 6" for r in range(4) for c in range(4)) + "]"


@query(f"""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(round(CAST(x AS DOUBLE) * 1000) AS BIGINT)) AS v, unnest(range(len(embedding) // 16)) AS block FROM embeddings),
    w AS (SELECT vec_id, block, v[block * 16 + 1 : block * 16 + 16] AS w FROM e), r AS (SELECT vec_id, block, {_square_sql()[0]} AS h FROM w)
    SELECT vec_id, block, array_to_string({_square_sql()[1]}, ',') AS residual FROM r""")
def inverse_square(t):
    whole = t("embeddings").select("vec_id", F.transform("embedding", lambda x: F.round(x.cast("double") * 1000).cast("long")).alias("v"))
    blocks = whole.select("vec_id", "v", F.explode(F.sequence(F.lit(0), F.floor(F.size("v") / 16).cast("int") - 1)).alias("block"))
    w = [F.get("v", F.col("block") * 16 + k) for k in range(16)]
    return blocks.select("vec_id", F.col("block").cast("long").alias("block"), F.array_join(F.array(*S.inverse_four_square(w)), ",").alias("residual"))


_CHANNELS = "v AS (SELECT event_id // 2 AS line, event_id % 2 AS ch, round(value * 100) AS v FROM events)"


@query(f"""WITH {_CHANNELS}, p AS (SELECT l.line, l.v AS l, r.v AS r, l.line // 16 AS band FROM v l JOIN v r ON l.line = r.line AND l.ch = 0 AND r.ch = 1)
    SELECT line, round(CASE WHEN band % 2 = 0 THEN (l + r) * 0.5 ELSE l END, 6) AS l, round(CASE WHEN band % 2 = 0 THEN (l - r) * 0.5 WHEN band % 3 = 0 THEN l * power(2, -0.25 * (band % 7 - 3)) * CASE WHEN band % 7 - 3 < 0 THEN -1 ELSE 1 END ELSE r END, 6) + 0.0 AS r FROM p""")
def stereo_pairs(t):
    e = t("events").select(F.floor(F.col("event_id") / 2).alias("line"), (F.col("event_id") % 2).alias("ch"), F.round(F.col("value") * 100).alias("v"))
    band = F.floor(F.col("line") / 16)
    pairs = S.stereo(e.filter("ch = 0").drop("ch"), e.filter("ch = 1").drop("ch"), ["line"], "v", band % 2 == 0, F.when(band % 3 == 0, band % 7 - 3))
    return pairs.select("line", F.round("l", 6).alias("l"), (F.round("r", 6) + 0.0).alias("r"))


@query("""WITH e AS (SELECT label, CAST(unnest(embedding) AS DOUBLE) AS v, unnest(range(len(embedding))) AS pos FROM embeddings), b AS (SELECT pos, avg(v) AS v FROM e GROUP BY pos), k AS (SELECT label, pos, avg(v) AS v FROM e WHERE label IS NOT NULL GROUP BY ALL),
    w AS (SELECT DISTINCT user_id, label, ((user_id * 3 + label) % 7 - 3) / 10.0::DOUBLE AS weight FROM events, (SELECT DISTINCT label FROM embeddings WHERE label IS NOT NULL))
    SELECT user_id, b.pos, round(any_value(b.v) + sum(w.weight * k.v), 6) + 0.0 AS v FROM w JOIN k USING (label) JOIN b ON b.pos = k.pos GROUP BY user_id, b.pos""")
def model_blend(t):
    """A mean shape and the shapes of each label, blended by each user's weights."""
    e = t("embeddings").select("label", F.posexplode(F.col("embedding").cast("array<double>")).alias("pos", "v"))
    base, basis = e.groupBy("pos").agg(F.avg("v").alias("v")), e.filter("label is not null").groupBy("label", "pos").agg(F.avg("v").alias("v"))
    weights = t("events").select("user_id").distinct().join(F.broadcast(t("embeddings").filter("label is not null").select("label").distinct()), how="cross")
    weights = weights.withColumn("weight", ((F.col("user_id") * 3 + F.col("label")) % 7 - 3) / 10.0)
    return S.blended(base, basis, weights, "user_id", "label", "pos", "v").select("user_id", "pos", (F.round("v", 6) + 0.0).alias("v"))


@query("""WITH p AS (SELECT p_partkey, p_size / 10 AS x, p_retailprice / 1000 AS y, p_partkey / 100 AS z, p_partkey % 7 / 5 AS a, p_size % 5 / 4 AS b, p_partkey % 3 / 2 AS c FROM part),
    q AS (SELECT *, y * cos(a) - z * sin(a) AS y1, y * sin(a) + z * cos(a) AS z1 FROM p), r AS (SELECT *, x * cos(b) + z1 * sin(b) AS x2, z1 * cos(b) - x * sin(b) AS z2 FROM q)
    SELECT p_partkey, round(x2 * cos(c) - y1 * sin(c), 6) + 0.0 AS x, round(x2 * sin(c) + y1 * cos(c), 6) + 0.0 AS y, round(z2, 6) + 0.0 AS z FROM r""")
def pose(t):
    k, s = F.col("p_partkey"), F.col("p_size")
    turned = M.rotated(s / 10, F.col("p_retailprice") / 1000, k / 100, [k % 7 / 5, s % 5 / 4, k % 3 / 2])
    return t("part").select("p_partkey", *[(F.round(v, 6) + 0.0).alias(c) for v, c in zip(turned, "xyz")])


# --- scalars


_MS = "epoch_us(ts) // 1000"


@query(f"""SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE round({_MS} * 0.001::DOUBLE, 6) END AS secs, CASE WHEN event_type = 'error' THEN 'NOPTS' ELSE printf('%.3fs (%d/%d @ %d/%d)', {_MS} * 0.001::DOUBLE, {_MS}, 1000, 1, 1000) END AS shown FROM events""")
def time_display(t):
    ms = F.when(F.col("event_type") != "error", F.floor(F.col("us") / 1000))
    secs = M.seconds(ms, 1, 1000)
    return events(t).select("event_id", F.round(F.when(~F.isnan(secs), secs), 6).alias("secs"), M.display_time(ms, 1, 1000).alias("shown"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT) * 100 // (2 * greatest(l_linenumber - 2, 1)) AS samples FROM lineitem")
def samples_per_channel(t):
    return lines(t).select("l_orderkey", *LINE_ORDER, M.samples_per_channel(F.col("l_quantity").cast("long") * 100, 2, F.col("l_linenumber") - 2).alias("samples"))


@query("""WITH d AS (SELECT event_id, event_id % 101 - 50 AS a, user_id % 13 - 6 AS b FROM events)
    SELECT event_id, a // nullif(b, 0) AS cut, CAST(floor(a / nullif(b, 0)::DOUBLE) AS BIGINT) AS down, CASE WHEN b > 0 THEN CAST(floor(a / b::DOUBLE) AS BIGINT) WHEN b < 0 THEN CAST(ceil(a / b::DOUBLE) AS BIGINT) END AS euclid, CASE WHEN a >= 0 THEN (a + 3) // 7 ELSE (a - 3) // 7 END AS rounded FROM d""")
def division_forms(t):
    d = t("events").select("event_id", (F.col("event_id") % 101 - 50).alias("a"), (F.col("user_id") % 13 - 6).alias("b"))
    a, b = F.col("a"), F.col("b")
    return d.select("event_id", M.int_div(a, F.when(b != 0, b)).alias("cut"), M.floor_div(a, b).alias("down"), M.euclid_div(a, b).alias("euclid"), M.round_div(a, F.lit(7).cast("long")).alias("rounded"))


@query("""WITH d AS (SELECT event_id, value - 50 AS v, CAST(round(value) AS BIGINT) - 50 AS q, event_id % 40 + 80 AS g, user_id % 30 AS sf, event_id % 900 + 4 AS st FROM events)
    SELECT event_id, CAST(sign(v * 32) * floor(abs(v * 32) + 0.5) AS BIGINT) AS q5, sign(v * 32) * floor(abs(v * 32) + 0.5) / 32 + 0.0 AS back, round(sign(q) * power(abs(q), 4.0::DOUBLE / 3) * power(2, (g - 100 - sf) / 4), 6) + 0.0 AS spectral, greatest(-32768, least(32767, CASE WHEN q * st < 0 THEN -(abs(q * st) // 2) ELSE q * st // 2 END)) AS clipped FROM d""")
def dequant_forms(t):
    d = t("events").select("event_id", (F.col("value") - 50).alias("v"), (F.round("value").cast("long") - 50).alias("q"), (F.col("event_id") % 40 + 80).alias("g"), (F.col("user_id") % 30).alias("sf"), (F.col("event_id") % 900 + 4).alias("st"))
    q5 = M.quantize_power(F.col("v"), 3, 2)
    return d.select("event_id", q5.alias("q5"), (M.dequantize_power(q5, 3, 2) + 0.0).alias("back"), (F.round(M.dequantize_spectral(F.col("q"), F.col("g"), F.col("sf")), 6) + 0.0).alias("spectral"), M.dequantize_clipped(F.col("q"), F.col("st"), 1).alias("clipped"))


@query("SELECT p_partkey, CAST(floor(greatest(0, least(1, p_size / 40)) * 32) AS BIGINT) - CASE WHEN p_size >= 40 THEN 1 ELSE 0 END AS cell, (p_partkey >> 4) % 2 + (p_size >> 4) % 2 * 2 + (p_partkey // 32 >> 4) % 2 * 4 AS child FROM part")
def octree_child(t):
    k, s = F.col("p_partkey"), F.col("p_size")
    third = F.floor(k / 32)
    return t("part").select("p_partkey", M.grid_coordinate(s / 40, 5).alias("cell"), M.child_index(k, s, third, 0, 5).cast("long").alias("child"))


@query("SELECT event_id, (user_id % 10 < 8) AND ((user_id % 10 - event_id % 8 * 2 % 8 + 8) % 8 < 2) AS intra FROM events")
def refreshed_rows(t):
    return t("events").select("event_id", M.is_refreshed(F.col("event_id") % 8, F.col("user_id") % 10, 8, 2).alias("intra"))


@query("SELECT event_id, ((event_id % 65536 * 1103515245 + 12345) % 4294967296 * 1103515245 + 12345) % 4294967296 AS state FROM events")
def noise_states(t):
    return t("events").select("event_id", M.linear_congruential(F.col("event_id") % 65536, 2).alias("state"))


_W64 = 2**64


@query(f"""WITH a AS (SELECT event_id, CAST((CAST(event_id + 1 AS HUGEINT) * 8192) % {_W64} AS UBIGINT) AS s, CAST(event_id + 1 AS UBIGINT) AS x FROM events), b AS (SELECT event_id, xor(x, s) AS x FROM a), c AS (SELECT event_id, xor(x, x >> 7) AS x FROM b),
    d AS (SELECT event_id, xor(x, CAST((CAST(x AS HUGEINT) * 131072) % {_W64} AS UBIGINT)) AS x FROM c) SELECT event_id, (x >> 32) < {int(0.3 * 0xFFFFFFFF)} AS lost FROM d""")
def loss_draws(t):
    return t("events").select("event_id", M.is_lost(M.xorshift64(F.col("event_id") + 1, 1), 0.3).alias("lost"))


@query("""SELECT p_partkey, p_size % 7 <= 5 AND p_size % 60 <= 50 AND p_size % 6 <= 4 AND (p_partkey % 3 <> 0 OR p_size % 6 = 0) AS lean,
      p_size % 8 BETWEEN 3 AND 6 AND p_partkey % 9 >= 4 AND p_partkey % 5 >= 1 AND p_size % 5 >= 1 AND p_size + 20 BETWEEN 1 AND 64 AND p_partkey % 4 * 2 + 6 IN (8, 10) AND (CASE WHEN p_partkey % 3 = 0 THEN p_size % 6 = 0 ELSE p_size % 6 >= 1 END) AS screen,
      p_size % 3 = 1 AND p_partkey % 4 = 0 AND p_partkey * 8000 <= 10000000 AND p_size <= 24 AND p_partkey % 3 IN (0, 1) AS volumetric,
      p_size % 8 * 2 IN (10, 12, 16) AND p_partkey % 100 = (p_size % 10) * (p_size % 9) AS lossless,
      CASE WHEN p_partkey % 2 = 0 THEN 'KFCE' ELSE 'XXXX' END = 'KFCE' AND p_size % 4 <= 1 AS face,
      p_size * 300 BETWEEN 1 AND 8192 AND p_partkey * 9 BETWEEN 1 AND 8192 AND ceil(p_size * 300 / 16) * ceil(p_partkey * 9 / 16) <= 36864 AS picture FROM part""")
def family_headers(t):
    """The rules of each coded family's headers, over fields made of a part's numbers."""
    k, s = F.col("p_partkey"), F.col("p_size")
    key, refs = k % 3 == 0, s % 6
    return t("part").select(
        "p_partkey",
        M.lean_header(key, refs, F.lit(4), s % 7, F.lit(5), s % 60, F.lit(50)).alias("lean"),
        M.screen_header(key, refs, s % 8, k % 9, k % 5, s % 5, s + 20, k % 4 * 2 + 6).alias("screen"),
        M.volumetric_header(s % 3, k % 4, k * 8000, s, k % 3).alias("volumetric"),
        M.lossless_header(s % 8 * 2, s % 10, s % 9, k % 100).alias("lossless"),
        M.face_header(F.when(k % 2 == 0, "KFCE").otherwise("XXXX"), s % 4).alias("face"),
        M.picture_limits(s * 300, k * 9).alias("picture"),
    )
