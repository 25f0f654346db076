"""The named queries: operators of the library over whole tables, each with DuckDB SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomframe.functions import media as M
from loomframe.operators import graph as G
from loomframe.operators import signal as S
from loomframe.operators import timeline as T
from loomframe.plans.registry import LINE_ORDER, ORDER, QUERIES, SQL, query
from loomframe.plans.registry import events as _events
from loomframe.plans.registry import lines as _lines

__all__ = ["QUERIES", "SQL"]
_FOURCC = {"click": "avc1", "view": "hvc1", "purchase": "av01", "signup": "mp4a"}


# --- scans, filters, projections


@query("SELECT user_id AS stream_index, epoch_us(ts) AS pts, epoch_us(ts) AS dts, event_type = 'click' AS is_key_frame, CAST(length(props) AS INTEGER) AS n_bytes FROM events")
def scan_packets(t):
    return _events(t, "props").select(F.col("user_id").alias("stream_index"), F.col("us").alias("pts"), F.col("us").alias("dts"), (F.col("event_type") == "click").alias("is_key_frame"), F.length("props").alias("n_bytes"))


@query("""SELECT event_id, f.codec, CASE WHEN f.codec IN ('h264', 'h265', 'av1', 'vp9') THEN 'video' WHEN f.codec = 'aac' THEN 'audio' ELSE 'other' END AS media
    FROM (SELECT event_id, CASE event_type WHEN 'click' THEN 'h264' WHEN 'view' THEN 'h265' WHEN 'purchase' THEN 'av1' WHEN 'signup' THEN 'aac' ELSE 'unknown' END AS codec FROM events) f""")
def codec_map(t):
    table = F.create_map(*[F.lit(x) for pair in _FOURCC.items() for x in pair])
    codec = M.codec_of(F.coalesce(F.try_element_at(table, F.col("event_type")), F.col("event_type")))
    return t("events").select("event_id", codec.alias("codec")).withColumn("media", M.media_type(F.col("codec")))


@query("SELECT event_id, CAST((CAST(epoch_us(ts) AS HUGEINT) * 90000) // 1000000 AS BIGINT) AS pts90k FROM events")
def ts_rescale(t):
    return _events(t).select("event_id", M.rescale(F.col("us"), 1, 1_000_000, 1, 90_000).alias("pts90k"))


@query("SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE epoch_us(ts) // 1000 END AS ms FROM events")
def ts_millis_null(t):
    none = F.when(F.col("event_type") != "error", F.col("us"))
    return _events(t).select("event_id", M.rescale(none, 1, 1_000_000, 1, 1000).alias("ms"))


@query("""SELECT l_linenumber, CASE l_linestatus WHEN 'O' THEN 6 ELSE least(l_linenumber * 3, 10) END AS speed, count(*) AS n FROM lineitem GROUP BY ALL""")
def speed_preset(t):
    name = F.when(F.col("l_linestatus") == "O", "medium").otherwise("custom")
    return _lines(t).groupBy("l_linenumber", M.preset_speed(name, F.col("l_linenumber") * 3).alias("speed")).agg(F.count("*").alias("n"))


@query("SELECT event_id, user_id FROM events WHERE event_type = 'purchase'")
def filter_kind(t):
    return t("events").filter("event_type = 'purchase'").select("event_id", "user_id")


@query("SELECT event_id, event_type FROM events WHERE event_type NOT IN ('error', 'signup')")
def drop_variant(t):
    return t("events").filter(~F.col("event_type").isin("error", "signup")).select("event_id", "event_type")


@query("""SELECT user_id, count(*) AS n_frames, CAST(sum(round(value * 100)) AS BIGINT) AS total_cents FROM events WHERE event_type <> 'error' AND value > 1 GROUP BY user_id""")
def stage_chain(t):
    from loomframe.plans.pipeline import Pipeline

    demux = lambda df: df.filter("event_type <> 'error'")
    decode = lambda df: df.filter("value > 1").withColumn("cents", F.round(F.col("value") * 100).cast("long"))
    sink = lambda df: df.groupBy("user_id").agg(F.count("*").alias("n_frames"), F.sum("cents").alias("total_cents"))
    return Pipeline([demux, decode, sink]).run(t("events"))


@query("""SELECT o_orderkey AS track_id, count(l_orderkey) AS n_samples, coalesce(CAST(sum(l_quantity) AS BIGINT), 0) AS duration,
      CASE WHEN o_custkey % 7 = 0 THEN 0 ELSE coalesce(CAST(sum(l_quantity) AS BIGINT), 0) * 1000 // (o_custkey % 7) END AS duration_ms
    FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey, o_custkey""")
def probe_tracks(t):
    sums = _lines(t).groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sum("l_quantity").cast("long").alias("d"))
    joined = t("orders").join(sums, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    d, scale = F.coalesce("d", F.lit(0).cast("long")), F.col("o_custkey") % 7
    return joined.select(F.col("o_orderkey").alias("track_id"), F.coalesce("n", F.lit(0).cast("long")).alias("n_samples"), d.alias("duration"), F.coalesce(M.int_div(d * 1000, scale), F.lit(0).cast("long")).alias("duration_ms"))


# --- container index


@query("""WITH c AS (SELECT *, CASE WHEN row_number() OVER w = 1 THEN 0 WHEN event_type IS DISTINCT FROM lag(event_type) OVER w THEN 1 ELSE 0 END AS change FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    r AS (SELECT *, sum(change) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM c)
    SELECT user_id, CAST(run AS BIGINT) AS run, min(event_type) AS event_type, count(*) AS run_length FROM r GROUP BY user_id, run""")
def stts_rle(t):
    return T.run_lengths(_events(t), ["user_id"], ORDER, "event_type")


_RUNS = """r AS (SELECT *, CAST(l_quantity AS BIGINT) AS c, CAST(l_linenumber AS BIGINT) AS d FROM lineitem),
    b AS (SELECT *, coalesce(sum(c * d) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM r)"""


@query(f"""WITH {_RUNS}, s AS (SELECT l_orderkey, base + d * unnest(range(c)) AS pts FROM b)
    SELECT l_orderkey, count(*) AS n_samples, CAST(max(pts) AS BIGINT) AS last_pts, CAST(sum(pts) AS BIGINT) AS sum_pts FROM s GROUP BY l_orderkey""")
def stts_expand(t):
    runs = _lines(t).withColumn("c", F.col("l_quantity").cast("long")).withColumn("d", F.col("l_linenumber").cast("long"))
    samples = T.expanded_runs(runs, ["l_orderkey"], LINE_ORDER, "c", "d")
    return samples.groupBy("l_orderkey").agg(F.count("*").alias("n_samples"), F.max("pts").alias("last_pts"), F.sum("pts").alias("sum_pts"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(coalesce(sum(CAST(l_quantity AS BIGINT)) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM lineitem""")
def prefix_offset(t):
    sized = _lines(t).withColumn("size", F.col("l_quantity").cast("long"))
    return T.running_offset(sized, ["l_orderkey"], LINE_ORDER, "size").select("l_orderkey", *LINE_ORDER, "offset")


@query("""WITH m AS (SELECT user_id, event_type = 'click' AS sync, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS position,
      count(*) OVER (PARTITION BY user_id) AS n, count(*) FILTER (event_type = 'click') OVER (PARTITION BY user_id) AS s FROM events)
    SELECT user_id, position FROM m WHERE sync AND s < n""")
def stss_list(t):
    return T.sync_list(_events(t), ["user_id"], ORDER, F.col("event_type") == "click").select("user_id", "position")


@query("""WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT) AS c FROM lineitem),
    b AS (SELECT *, coalesce(sum(c) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first FROM r)
    SELECT o_orderkey, o_custkey % 60 AS sample, l_linenumber AS chunk, CAST(o_custkey % 60 - first AS BIGINT) AS within
    FROM orders JOIN b ON o_orderkey = l_orderkey AND o_custkey % 60 >= first AND o_custkey % 60 < first + c""")
def chunk_lookup(t):
    sized = _lines(t).withColumn("c", F.col("l_quantity").cast("long"))
    runs = T.running_offset(sized, ["l_orderkey"], LINE_ORDER, "c", "first").select(F.col("l_orderkey").alias("o_orderkey"), "first", (F.col("first") + F.col("c")).alias("after"), F.col("l_linenumber").alias("chunk"))
    points = t("orders").select("o_orderkey", (F.col("o_custkey") % 60).alias("sample"))
    return T.interval_lookup(points, runs, ["o_orderkey"], "sample", "first", "after").select("o_orderkey", "sample", "chunk", (F.col("sample") - F.col("first")).alias("within"))


@query("""SELECT event_id, last_value(CASE WHEN event_type = 'click' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS sync_id FROM events""")
def seek_asof(t):
    return _events(t).select("event_id", T.last_before(None, ["user_id"], ORDER, F.when(F.col("event_type") == "click", F.col("event_id"))).alias("sync_id"))


# --- joins


@query("SELECT o_orderkey, o_custkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def key_semi(t):
    return t("orders").join(_lines(t).filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_semi").select("o_orderkey", "o_custkey")


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def missing_anti(t):
    returned = _lines(t).filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return t("orders").join(returned, "o_orderkey", "left_anti").select("o_orderkey")


@query("""SELECT event_id, coalesce(CASE WHEN event_type <> 'error' THEN value END, last_value(CASE WHEN event_type <> 'error' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS shown FROM events""")
def conceal_left(t):
    good = F.when(F.col("event_type") != "error", F.col("value"))
    return _events(t, "value").select("event_id", F.coalesce(good, T.last_before(None, ["user_id"], ORDER, good, inclusive=False), F.lit(0.0)).alias("shown"))


_GRID = "g AS (SELECT event_id % 100 AS x, event_id // 100 AS y, CAST(round(value * 100) AS BIGINT) AS v FROM events)"


def _grid(t) -> DataFrame:
    return t("events").select((F.col("event_id") % 100).alias("x"), F.floor(F.col("event_id") / 100).alias("y"), F.round(F.col("value") * 100).cast("long").alias("v"))


@query(f"WITH {_GRID} SELECT g.x, g.y, g.v, l.v AS left_v, u.v AS up_v FROM g LEFT JOIN g l ON l.x = g.x - 1 AND l.y = g.y LEFT JOIN g u ON u.x = g.x AND u.y = g.y - 1")
def neighbour_self(t):
    g = _grid(t)
    left = g.select((F.col("x") + 1).alias("x"), "y", F.col("v").alias("left_v"))
    up = g.select("x", (F.col("y") + 1).alias("y"), F.col("v").alias("up_v"))
    return g.join(left, ["x", "y"], "left").join(up, ["x", "y"], "left")


@query("""WITH f AS (SELECT p_name, max(p_partkey) AS callee_id FROM part GROUP BY p_name)
    SELECT DISTINCT l_suppkey AS caller, callee_id FROM lineitem JOIN part ON l_partkey = p_partkey JOIN f USING (p_name)""")
def callgraph_join(t):
    calls = _lines(t).select(F.col("l_suppkey").alias("caller"), F.col("l_partkey").alias("p_partkey")).join(t("part").select("p_partkey", F.col("p_name").alias("callee")), "p_partkey")
    return G.resolve_calls(calls.select("caller", "callee").distinct(), t("part"), "callee", "p_name", "p_partkey").select("caller", "callee_id").distinct()


# --- comparison metrics


@query("""SELECT l_returnflag, round(CASE WHEN avg(power(l_extendedprice * l_discount, 2)) = 0 THEN NULL ELSE 10 * log10(255.0 * 255.0 / avg(power(l_extendedprice * l_discount, 2))) END, 6) AS psnr FROM lineitem GROUP BY l_returnflag""")
def psnr(t):
    error = F.col("l_extendedprice") * F.col("l_discount")
    value = S.psnr(F.avg(error * error))
    return _lines(t).groupBy("l_returnflag").agg(F.round(F.when(value != float("inf"), value), 6).alias("psnr"))


@query("SELECT l_suppkey, bool_and(abs(l_extendedprice * l_discount) <= 9000) AS within_tol FROM lineitem GROUP BY l_suppkey")
def within_tol(t):
    return _lines(t).groupBy("l_suppkey").agg(F.bool_and(F.abs(F.col("l_extendedprice") * F.col("l_discount")) <= 9000).alias("within_tol"))


@query("SELECT l_returnflag, l_linestatus, count(*) FILTER (l_discount <> l_tax) AS n_diff FROM lineitem GROUP BY ALL")
def diff_count(t):
    return S.differences(_lines(t), ["l_returnflag", "l_linestatus"], F.col("l_discount"), F.col("l_tax"), 0.0).select("l_returnflag", "l_linestatus", "n_diff")


@query("""SELECT a.vec_id, list_max(list_transform(range(1, len(a.embedding) + 1), lambda i: abs(CAST(a.embedding[i] AS DOUBLE) - CAST(b.embedding[i] AS DOUBLE)))) AS max_abs
    FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def max_abs(t):
    a = t("embeddings").select("vec_id", F.col("embedding").alias("a"))
    b = t("embeddings").select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    return a.join(b, "vec_id").select("vec_id", F.array_max(F.zip_with("a", "b", lambda x, y: F.abs(x.cast("double") - y.cast("double")))).alias("max_abs"))


@query("""SELECT label, round(coalesce(max(sqrt(power(CAST(a.embedding[1] AS DOUBLE) - b.embedding[1], 2) + power(CAST(a.embedding[2] AS DOUBLE) - b.embedding[2], 2) + power(CAST(a.embedding[3] AS DOUBLE) - b.embedding[3], 2))), 0), 6) AS furthest
    FROM (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS embedding FROM embeddings) a JOIN (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS embedding FROM embeddings) b ON b.vec_id = a.vec_id + 1 GROUP BY label""")
def point_dist(t):
    point = lambda alias: F.slice(F.col("embedding").cast("array<double>"), 1, 3).alias(alias)
    a, b = t("embeddings").select("vec_id", "label", point("a")), t("embeddings").select((F.col("vec_id") - 1).alias("vec_id"), point("b"))
    far = F.sqrt(F.aggregate(F.zip_with("a", "b", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v))
    return a.join(b, "vec_id").groupBy("label").agg(F.round(F.coalesce(F.max(far), F.lit(0.0)), 6).alias("furthest"))


@query("SELECT count(*) FILTER (event_type = 'click') AS n_click, count(*) FILTER (event_type = 'view') AS n_view, count(*) FILTER (event_type NOT IN ('click', 'view')) AS n_other, count(DISTINCT user_id) AS n_users FROM events")
def graph_stats(t):
    kind = F.col("event_type")
    return t("events").agg(F.count_if(kind == "click").alias("n_click"), F.count_if(kind == "view").alias("n_view"), F.count_if(~kind.isin("click", "view")).alias("n_other"), F.countDistinct("user_id").alias("n_users"))


@query("""SELECT user_id % 6 AS loss_rate, round(avg(value) FILTER (event_type <> 'error'), 6) AS mean_finite, min(value) FILTER (event_type <> 'error') AS min_finite, round(count(*) FILTER (event_type = 'error') / count(*), 9) AS stall_rate FROM events GROUP BY 1""")
def loss_curve(t):
    finite = F.when(F.col("event_type") != "error", F.col("value"))
    return t("events").groupBy((F.col("user_id") % 6).alias("loss_rate")).agg(F.round(F.avg(finite), 6).alias("mean_finite"), F.min(finite).alias("min_finite"), F.round(F.count_if(F.col("event_type") == "error") / F.count("*"), 9).alias("stall_rate"))


_SYMBOL = "(event_id * 2654435761) % 4294967296"


@query(f"SELECT event_id % 7 AS grp, bit_xor({_SYMBOL}) AS parity, count(*) AS n_symbols FROM events GROUP BY 1")
def xor_parity(t):
    return S.xor_parity(t("events").withColumn("grp", F.col("event_id") % 7), ["grp"], F.expr(_SYMBOL))


@query(f"""WITH s AS (SELECT event_id // 10 AS grp, event_id, {_SYMBOL} AS sym, event_type = 'error' AS lost FROM events),
    g AS (SELECT grp, min(event_id) FILTER (lost) AS event_id, bit_xor(sym) AS p, coalesce(bit_xor(sym) FILTER (NOT lost), 0) AS h FROM s GROUP BY grp HAVING count(*) FILTER (lost) = 1)
    SELECT grp, event_id, xor(p, h) AS recovered FROM g""")
def xor_recover(t):
    sent = t("events").select(F.floor(F.col("event_id") / 10).alias("grp"), "event_id", F.expr(_SYMBOL).alias("sym"), "event_type")
    return S.xor_recover(sent, sent.filter("event_type <> 'error'"), ["grp"], "event_id", "sym")


@query()
def crc32_plane(t):
    return t("documents").select("doc_id", F.crc32(F.coalesce("text", F.lit(""))).alias("crc32"))


@query("SELECT user_id AS cell, CAST(bit_or(1 << CAST(event_id % 8 AS INTEGER)) AS BIGINT) AS occupancy FROM events GROUP BY user_id")
def occupancy(t):
    return t("events").groupBy(F.col("user_id").alias("cell")).agg(F.bit_or(F.pow(F.lit(2.0), F.col("event_id") % 8).cast("long")).alias("occupancy"))


@query("SELECT l_suppkey AS leaf, least(count(*), 255) AS points FROM lineitem GROUP BY l_suppkey")
def leaf_cap(t):
    return _lines(t).groupBy(F.col("l_suppkey").alias("leaf")).agg(F.least(F.count("*"), F.lit(255)).alias("points"))


@query("SELECT DISTINCT l_partkey AS src, l_suppkey AS dst FROM lineitem")
def distinct_edges(t):
    return _lines(t).select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")).distinct()


# --- predictors and windows


def _cents(t) -> DataFrame:
    return _events(t, "value").withColumn("v", F.round(F.col("value") * 100).cast("long"))


_V = "SELECT event_id, user_id, event_type, ts, CAST(round(value * 100) AS BIGINT) AS v FROM events"
_W = "WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"


@query(f"SELECT event_id, list_sort([v, coalesce(lag(v, 1) OVER w, 0), coalesce(lag(v, 2) OVER w, 0)])[2] AS med FROM ({_V}) {_W}")
def median3(t):
    w = T.ordered(["user_id"], ORDER)
    before = lambda n: F.coalesce(F.lag("v", n).over(w), F.lit(0).cast("long"))
    return _cents(t).select("event_id", M.median_of(F.col("v"), before(1), before(2)).alias("med"))


@query(f"""SELECT event_id, CAST(coalesce(s // n, 0) AS BIGINT) AS pred, CAST(v - coalesce(s // n, 0) AS BIGINT) AS residual
    FROM (SELECT event_id, v, sum(v) OVER p AS s, count(v) OVER p AS n FROM ({_V}) WINDOW p AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING))""")
def lift_pred(t):
    w = T.ordered(["user_id"], ORDER).rowsBetween(-3, -1)
    pred = F.coalesce(M.int_div(F.sum("v").over(w), F.count("v").over(w)), F.lit(0).cast("long"))
    return _cents(t).withColumn("pred", pred).select("event_id", "pred", (F.col("v") - F.col("pred")).alias("residual"))


@query(f"""WITH {_GRID}, n AS (SELECT x, y, v, lag(v) OVER (PARTITION BY y ORDER BY x) AS l, lag(v) OVER (PARTITION BY x ORDER BY y) AS u FROM g),
    m AS (SELECT *, lag(u) OVER (PARTITION BY y ORDER BY x) AS c FROM n)
    SELECT x, y, v - CASE WHEN l IS NULL AND u IS NULL THEN 0 WHEN l IS NULL THEN u WHEN u IS NULL THEN l WHEN l + u - c < l THEN l WHEN l + u - c > u THEN u ELSE l + u - c END AS residual FROM m""")
def med_pred(t):
    row, column = Window.partitionBy("y").orderBy("x"), Window.partitionBy("x").orderBy("y")
    g = _grid(t).withColumn("l", F.lag("v").over(row)).withColumn("u", F.lag("v").over(column)).withColumn("c", F.lag("u").over(row))
    return g.select("x", "y", (F.col("v") - M.gradient_predictor(F.col("l"), F.col("u"), F.col("c"))).alias("residual"))


@query(f"""WITH {_GRID}, n AS (SELECT x, y, coalesce(lag(v) OVER (PARTITION BY y ORDER BY x), 0) AS l, coalesce(lag(v) OVER (PARTITION BY x ORDER BY y), 0) AS u FROM g)
    SELECT x, y, CAST(least(((CASE WHEN l <= 0 THEN 0 ELSE length(bin(l)) END) + (CASE WHEN u <= 0 THEN 0 ELSE length(bin(u)) END) + 1) // 2, 15) AS INTEGER) AS k FROM n""")
def rice_ctx(t):
    zero = F.lit(0).cast("long")
    left = F.coalesce(F.lag("v").over(Window.partitionBy("y").orderBy("x")), zero)
    up = F.coalesce(F.lag("v").over(Window.partitionBy("x").orderBy("y")), zero)
    return _grid(t).select("x", "y", M.rice_parameter(left, up).alias("k"))


@query("SELECT * FROM (SELECT conv_id, turn AS src, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS dst FROM conversations) WHERE dst IS NOT NULL")
def enum_chain(t):
    return G.chain(t("conversations"), ["conv_id"], ["turn"], "turn")


@query(f"SELECT event_id, v + coalesce(lag(v) OVER w, 0) AS overlapped FROM ({_V}) {_W}")
def overlap_add(t):
    return _cents(t).select("event_id", (F.col("v") + F.coalesce(F.lag("v").over(T.ordered(["user_id"], ORDER)), F.lit(0).cast("long"))).alias("overlapped"))


@query("""WITH c AS (SELECT event_id, user_id, ts, event_id % 256 AS lsb FROM events),
    d AS (SELECT *, CASE WHEN lsb - lag(lsb) OVER w < -128 THEN 256 WHEN lsb - lag(lsb) OVER w > 128 THEN -256 ELSE 0 END AS jump FROM c WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
    SELECT event_id, CAST(lsb + sum(jump) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS poc FROM d""")
def poc_unwrap(t):
    c = _events(t).withColumn("lsb", F.col("event_id") % 256)
    c = c.withColumn("jump", T.wrapped(c, ["user_id"], ORDER, "lsb", 256))
    return c.select("event_id", (F.col("lsb") + F.sum("jump").over(T.ordered(["user_id"], ORDER).rowsBetween(Window.unboundedPreceding, 0))).alias("poc"))


# --- orders and top-k


_REF = "SELECT o_custkey, o_orderkey, o_orderkey % 64 AS poc, o_orderstatus = 'P' AS is_long FROM orders"


def _references(t) -> DataFrame:
    return t("orders").select("o_custkey", "o_orderkey", (F.col("o_orderkey") % 64).alias("poc"), (F.col("o_orderstatus") == "P").alias("is_long"))


def _list_sql(order: str) -> str:
    return f"""WITH r AS ({_REF}), s AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY {order}) - 1 AS slot FROM r),
    f AS (SELECT o_custkey, o_orderkey, slot, max(slot) OVER (PARTITION BY o_custkey) AS last FROM s WHERE slot < 4)
    SELECT o_custkey, o_orderkey, CAST(unnest(CASE WHEN slot = last THEN range(slot, 4) ELSE [slot] END) AS INTEGER) AS slot FROM f"""


@query(_list_sql("is_long, CASE WHEN NOT is_long THEN -o_orderkey ELSE o_orderkey END"))
def reflist_p(t):
    order = [F.col("is_long"), F.when(~F.col("is_long"), -F.col("o_orderkey")).otherwise(F.col("o_orderkey"))]
    return T.reference_list(_references(t), ["o_custkey"], order, 4).select("o_custkey", "o_orderkey", "slot")


@query(_list_sql("CASE WHEN is_long THEN 2 WHEN poc < 32 THEN 0 ELSE 1 END, CASE WHEN is_long THEN o_orderkey WHEN poc < 32 THEN -poc ELSE poc END, o_orderkey"))
def reflist_b0(t):
    near = F.when(F.col("is_long"), 2).when(F.col("poc") < 32, 0).otherwise(1)
    rank = F.when(F.col("is_long"), F.col("o_orderkey")).when(F.col("poc") < 32, -F.col("poc")).otherwise(F.col("poc"))
    return T.reference_list(_references(t), ["o_custkey"], [near, rank, F.col("o_orderkey")], 4).select("o_custkey", "o_orderkey", "slot")


@query(_list_sql("CASE WHEN is_long THEN 2 WHEN poc > 32 THEN 0 ELSE 1 END, CASE WHEN is_long THEN o_orderkey WHEN poc > 32 THEN poc ELSE -poc END, o_orderkey"))
def reflist_b1(t):
    near = F.when(F.col("is_long"), 2).when(F.col("poc") > 32, 0).otherwise(1)
    rank = F.when(F.col("is_long"), F.col("o_orderkey")).when(F.col("poc") > 32, F.col("poc")).otherwise(-F.col("poc"))
    return T.reference_list(_references(t), ["o_custkey"], [near, rank, F.col("o_orderkey")], 4).select("o_custkey", "o_orderkey", "slot")


@query("SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k > 16")
def evict_oldest(t):
    return T.evict_to(_events(t), ["user_id"], ORDER, 16).select("event_id", "user_id")


@query("""SELECT user_id, event_id, greatest(n - 5, 0) AS media_sequence FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events) WHERE k <= 5""")
def playlist_last_n(t):
    return T.keep_last(_events(t), ["user_id"], ORDER, 5).select("user_id", "event_id", "media_sequence")


def _spread_sql(v: str) -> str:
    for shift, mask in ((16, 0x30000FF), (8, 0x300F00F), (4, 0x30C30C3), (2, 0x9249249)):
        v = f"(({v} | ({v} << {shift})) & {mask})"
    return v


@query(f"""WITH p AS (SELECT p_partkey, CAST(p_partkey % 32 AS BIGINT) AS x, CAST(p_size % 32 AS BIGINT) AS y, CAST(p_partkey // 32 % 32 AS BIGINT) AS z FROM part),
    m AS (SELECT p_partkey, {_spread_sql('x')} | ({_spread_sql('y')} << 1) | ({_spread_sql('z')} << 2) AS morton FROM p)
    SELECT p_partkey, morton, row_number() OVER (ORDER BY morton, p_partkey) AS position FROM m""")
def morton_order(t):
    key = M.morton(F.col("p_partkey") % 32, F.col("p_size") % 32, F.floor(F.col("p_partkey") / 32) % 32)
    keyed = t("part").select("p_partkey", key.alias("morton"))
    return G.positions(keyed, "morton", ["p_partkey"]).withColumn("position", F.col("position") + 1)


# --- sets and graphs


@query("SELECT CAST(r_regionkey AS BIGINT) AS id, r_name AS name FROM region UNION ALL SELECT n_nationkey + (SELECT count(*) FROM region), n_name FROM nation")
def combined_graph(t):
    return G.combined(t("region").select(F.col("r_regionkey").cast("long").alias("id"), F.col("r_name").alias("name")), t("nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name")))


@query("SELECT a.n_regionkey, a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey")
def pair_gen(t):
    return G.parallel_pairs(t("nation"), "n_regionkey", "n_nationkey")


_DAG = """n AS (SELECT 'r' || r_regionkey AS id FROM region UNION ALL SELECT 'n' || n_nationkey FROM nation UNION ALL SELECT 's' || s_suppkey FROM supplier),
    e AS (SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst FROM nation UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier)"""


@query(f"WITH RECURSIVE {_DAG}, l AS (SELECT id, 0 AS level FROM n WHERE id NOT IN (SELECT dst FROM e) UNION SELECT e.dst, l.level + 1 FROM l JOIN e ON e.src = l.id) SELECT id, CAST(max(level) AS BIGINT) AS level FROM l GROUP BY id")
def topo_levels(t):
    named = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    nodes = t("region").select(named("r", "r_regionkey").alias("id")).unionByName(t("nation").select(named("n", "n_nationkey").alias("id"))).unionByName(t("supplier").select(named("s", "s_suppkey").alias("id")))
    edges = t("nation").select(named("r", "n_regionkey").alias("src"), named("n", "n_nationkey").alias("dst")).unionByName(t("supplier").select(named("n", "s_nationkey").alias("src"), named("s", "s_suppkey").alias("dst")))
    return G.levels(nodes, edges)


@query("SELECT 'successor' AS side, l_suppkey AS node FROM lineitem WHERE l_partkey = 7 UNION ALL SELECT 'predecessor', l_partkey FROM lineitem WHERE l_suppkey = 7")
def succ_pred(t):
    edges = _lines(t).select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"))
    return G.successors(edges, 7).select(F.lit("successor").alias("side"), F.col("dst").alias("node")).unionByName(G.predecessors(edges, 7).select(F.lit("predecessor").alias("side"), F.col("src").alias("node")))


# --- scalar rules


@query("""SELECT x, y, CAST(greatest(0, least(51, b + CAST(round(least(1.0::DOUBLE, sqrt(power((x - 3.5::DOUBLE) / 4, 2) + power((y - 2.0::DOUBLE) / 3, 2))) * 18) AS INTEGER))) AS INTEGER) AS qp, count(*) AS n
    FROM (SELECT event_id % 8 AS x, event_id // 8 % 6 AS y, CAST(user_id % 40 AS INTEGER) AS b FROM events) GROUP BY ALL""")
def foveated_qp(t):
    g = t("events").select((F.col("event_id") % 8).alias("x"), (F.floor(F.col("event_id") / 8) % 6).alias("y"), (F.col("user_id") % 40).alias("b"))
    return g.groupBy("x", "y", M.foveated_qp(F.col("b"), F.col("x"), F.col("y"), 8, 6, 3.5, 2.0).alias("qp")).agg(F.count("*").alias("n"))


@query("SELECT event_id, CAST(list_sum(list_transform(range(2), lambda k: 1 << CAST(((event_id % 8) * 2 % 8 + k) % 8 AS INTEGER))) AS BIGINT) AS mask FROM events")
def refresh_mask(t):
    return t("events").select("event_id", M.refresh_mask(F.col("event_id") % 8, 8, 2).alias("mask"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, (CAST(l_quantity AS BIGINT) * 100000 * 5 + l_linenumber * 2000) // 1000000 AS ms FROM lineitem")
def decode_cost(t):
    return _lines(t).select("l_orderkey", *LINE_ORDER, M.decode_ms(F.col("l_quantity").cast("long") * 100_000, F.col("l_linenumber")).alias("ms"))


@query("""WITH d AS (SELECT event_id, user_id % 33 AS e, event_id % 52 AS q FROM events), s AS (SELECT *, least(q + least((e - 8) // 8, 16), 51) - q AS delta FROM d)
    SELECT event_id, CASE WHEN e - 8 <= 0 THEN 'keep' WHEN e - 8 < 8 OR delta <= 0 THEN 'skip_refinement' ELSE 'raise_qp:' || delta END AS action FROM s""")
def deadline_action(t):
    return t("events").select("event_id", M.deadline_action(F.lit(8), F.col("user_id") % 33, F.col("event_id") % 52).alias("action"))


@query("""WITH p AS (SELECT event_id, event_id % 61 AS c, user_id % 17 AS a, event_id // 7 % 17 AS b FROM events),
    q AS (SELECT *, greatest(-128, least(127, b - a)) AS td, greatest(-128, least(127, c - a)) AS tb FROM p),
    r AS (SELECT *, CASE WHEN td = 0 THEN NULL ELSE (16384 + abs(td) // 2) // td END AS tx FROM q),
    s AS (SELECT *, CAST(floor(greatest(-1024, least(1023, floor((tb * tx + 32) / 64.0))) / 4.0) AS BIGINT) AS w FROM r)
    SELECT event_id, CASE WHEN a = b OR w < -64 OR w > 128 THEN 32 ELSE w END AS w1 FROM s""")
def implicit_weights(t):
    return t("events").select("event_id", M.implicit_weight(F.col("event_id") % 61, F.col("user_id") % 17, F.floor(F.col("event_id") / 7) % 17).alias("w1"))


@query("SELECT event_id, CAST((SELECT max(s) FROM range(7) t(s) WHERE s * 150 // 7 <= user_id % 150) AS BIGINT) AS slice FROM events")
def slice_owner(t):
    bounds = [s * 150 // 7 for s in range(7)]
    block = F.col("user_id") % 150
    return t("events").select("event_id", (F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= block)) - 1).cast("long").alias("slice"))


@query(f"SELECT event_id, CASE WHEN v - 5000 >= 0 THEN (v - 5000) * 2 ELSE -(v - 5000) * 2 - 1 END AS code, v - 5000 AS back FROM ({_V})")
def zigzag(t):
    coded = _cents(t).withColumn("code", M.zigzag(F.col("v") - 5000))
    return coded.select("event_id", "code", M.unzigzag(F.col("code")).cast("long").alias("back"))


@query(f"SELECT event_id, CAST(sign(v - 5000) * floor((abs(v - 5000) * 2 + 16) / 32.0) AS BIGINT) AS q, CAST(sign(v - 5000) * floor((abs(v - 5000) * 2 + 16) / 32.0) * 16 AS BIGINT) AS dequantized FROM ({_V})")
def quant_dequant(t):
    q = M.quantize(F.col("v") - 5000, 16)
    return _cents(t).select("event_id", q.alias("q"), (q * 16).alias("dequantized"))


@query("""WITH e AS (SELECT vec_id, list_transform(embedding[1:4], lambda x: CAST(round(CAST(x AS DOUBLE) * 1000) AS BIGINT)) AS v FROM embeddings)
    SELECT vec_id, v[1] + v[2] + v[3] + v[4] AS h0, v[1] - v[2] + v[3] - v[4] AS h1, v[1] + v[2] - v[3] - v[4] AS h2, v[1] - v[2] - v[3] + v[4] AS h3 FROM e""")
def hadamard4(t):
    e = t("embeddings").select("vec_id", *[F.round(F.col("embedding")[k].cast("double") * 1000).cast("long").alias(f"v{k}") for k in range(4)])
    return e.select("vec_id", *[h.alias(f"h{k}") for k, h in enumerate(S.hadamard4([F.col(f"v{k}") for k in range(4)]))])


@query("""WITH g AS (SELECT event_id % 100 AS x, event_id // 100 AS y, CAST(round(value * 100) AS BIGINT) AS v FROM events), h AS (SELECT max(y) + 1 AS h FROM g),
    t AS (SELECT h, unnest(range(CAST(greatest(h * 3 // 10, 1) AS BIGINT))) AS ty, greatest(h * 3 // 10, 1) AS th FROM h)
    SELECT tx, ty, g.v FROM (SELECT unnest(range(40)) AS tx) CROSS JOIN t JOIN g ON g.x = tx * 100 // 40 AND g.y = ty * h // th""")
def scale_nn(t):
    """The whole grid, of whatever height, to two fifths of its width and three tenths of its height."""
    return S.scaled_grid(_grid(t), "x", "y", 100, 40, 3, 10).select("tx", "ty", "v")


@query("SELECT p_partkey, printf('segment%05d.ts', p_partkey) AS name FROM part")
def segment_name(t):
    return t("part").select("p_partkey", M.segment_name(F.col("p_partkey")).alias("name"))


@query("""WITH c AS (SELECT p_partkey, p_brand || ' ' || p_name AS raw, regexp_replace(p_brand || ' ' || p_name, '[^\\p{L}\\p{N}]', '_', 'g') AS s FROM part)
    SELECT p_partkey, regexp_replace(upper(s[1:1]) || s[2:], '^[_0-9]+', '') AS ident FROM c""")
def sanitise_ident(t):
    return t("part").select("p_partkey", M.identifier(F.concat("p_brand", F.lit(" "), "p_name")).alias("ident"))


@query("""SELECT page_id, coalesce(nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), ''), NULL) AS page, coalesce(nullif(regexp_extract(url, '[?&]ref=([^&#]*)', 1), ''), NULL) AS ref FROM pages""")
def kv_parse(t):
    pairs = F.str_to_map(F.regexp_extract("url", r"\?([^#]*)", 1), F.lit("&"), F.lit("="))
    return t("pages").withColumn("kv", pairs).select("page_id", F.nullif(F.try_element_at("kv", F.lit("page")), F.lit("")).alias("page"), F.nullif(F.try_element_at("kv", F.lit("ref")), F.lit("")).alias("ref"))


@query("""WITH p AS (SELECT page_id, split_part(split_part(url, '#', 1), '?', 1) AS plain FROM pages)
    SELECT page_id, plain, regexp_matches(plain, '^https?://[^/]+/[a-z]{2}/[0-9]+$') AS allowed FROM p""")
def url_route(t):
    plain = F.split_part(F.split_part("url", F.lit("#"), F.lit(1)), F.lit("?"), F.lit(1))
    return t("pages").select("page_id", plain.alias("plain")).withColumn("allowed", F.col("plain").rlike("^https?://[^/]+/[a-z]{2}/[0-9]+$"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CAST(json_extract_string(props, '$.absent') AS VARCHAR) AS absent FROM events")
def amf_get(t):
    v = F.try_parse_json("props")
    return t("events").select("event_id", F.try_variant_get(v, "$.k", "long").alias("k"), F.try_variant_get(v, "$.absent", "string").alias("absent"))


@query("SELECT p_partkey, (p_size % 17 IN (8, 10, 12, 16)) AND (p_partkey % 8 BETWEEN 3 AND 6) AND (CASE WHEN p_type = 'ECONOMY' THEN p_size % 3 = 0 ELSE p_size % 3 >= 1 END) AS valid FROM part")
def header_checks(t):
    return t("part").select("p_partkey", M.header_valid(F.col("p_size") % 17, F.col("p_partkey") % 8, F.col("p_size") % 3, F.col("p_type") == "ECONOMY").alias("valid"))


@query("SELECT a.vec_id, round(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 9) AS dot FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def tensor_dot(t):
    a = t("embeddings").select("vec_id", F.col("embedding").alias("a"))
    b = t("embeddings").select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    return a.join(b, "vec_id").select("vec_id", F.round(S.dot(F.col("a"), F.col("b")), 9).alias("dot"))


@query("""SELECT coalesce(a.p_partkey, b.k) AS position, a.p_size AS left_size, b.s AS right_size FROM part a FULL JOIN (SELECT p_partkey + 1 AS k, p_size AS s FROM part) b ON a.p_partkey = b.k WHERE a.p_size IS DISTINCT FROM b.s""")
def table_diff(t):
    a, b = t("part").select(F.col("p_partkey").alias("position"), F.col("p_size").alias("left_size")), t("part").select((F.col("p_partkey") + 1).alias("position"), F.col("p_size").alias("right_size"))
    return a.join(b, "position", "full").filter(~F.col("left_size").eqNullSafe(F.col("right_size"))).select("position", "left_size", "right_size")


# --- streams, as batch twins of loomframe.streaming


@query("""WITH s AS (SELECT *, sum(CAST(event_type = 'click' AS INTEGER)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS segment FROM events),
    g AS (SELECT user_id, CAST(segment AS BIGINT) AS segment, count(*) AS n_packets, max(epoch_us(ts)) - min(epoch_us(ts)) AS duration_us FROM s GROUP BY user_id, segment)
    SELECT user_id, segment, n_packets, duration_us, greatest(n - 5, 0) AS media_sequence FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY segment DESC) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM g) WHERE k <= 5""")
def gop_segment(t):
    cut = T.segments(_events(t), ["user_id"], ORDER, F.col("event_type") == "click")
    groups = cut.groupBy("user_id", "segment").agg(F.count("*").alias("n_packets"), (F.max("us") - F.min("us")).alias("duration_us"))
    return T.keep_last(groups, ["user_id"], ["segment"], 5)


@query("""SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN props END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS config FROM events""")
def param_carry(t):
    return _events(t, "props").select("event_id", T.last_before(None, ["user_id"], ORDER, F.when(F.col("event_type") == "signup", F.col("props"))).alias("config"))


@query("SELECT conv_id, count(*) AS n_chunks, string_agg(text, '' ORDER BY turn) AS message FROM conversations GROUP BY conv_id")
def msg_assemble(t):
    parts = F.array_sort(F.collect_list(F.struct("turn", "text")))
    return t("conversations").groupBy("conv_id").agg(F.count("*").alias("n_chunks"), F.array_join(F.transform(parts, lambda p: p["text"]), "").alias("message"))


@query("""WITH m AS (SELECT user_id, event_id, ts, unnest(range(8)) AS slot FROM events)
    SELECT user_id, CAST(slot AS INTEGER) AS slot, max(event_id) AS event_id FROM m WHERE ((event_id * 37 % 256) >> CAST(slot AS INTEGER)) & 1 = 1 GROUP BY user_id, slot""")
def slot_refresh(t):
    slots = t("events").select("user_id", "event_id", F.explode(F.array(*map(F.lit, range(8)))).alias("slot"))
    return slots.filter(F.floor(F.col("event_id") * 37 % 256 / F.pow(F.lit(2.0), "slot")) % 2 == 1).groupBy("user_id", "slot").agg(F.max("event_id").alias("event_id"))


@query("""SELECT event_id, mate_event_id FROM (SELECT event_id, user_id, event_type, event_id % 2 AS parity, lead(event_id) OVER w AS mate_event_id, lead(event_type) OVER w AS mate_type, lead(event_id % 2) OVER w AS mate_parity FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE event_type = mate_type AND parity <> mate_parity""")
def field_pair(t):
    return T.paired(_events(t), ["user_id"], ORDER, F.col("event_type"), F.col("event_id") % 2).select("event_id", "mate_event_id")


from loomframe.plans import formats, pictures, references  # noqa: E402, F401  they register their queries
