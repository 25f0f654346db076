"""Queries of reference pictures, graphs and their numbering."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomframe.operators import graph as G
from loomframe.operators import references as P
from loomframe.operators import timeline as T
from loomframe.plans.registry import ORDER, events, lines, query

_PART = "sum(CAST(event_type = 'click' AS INTEGER)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)"
_BEFORE = "OVER (PARTITION BY user_id, part ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


@query(f"""WITH s AS (SELECT *, event_id % 256 AS lsb, event_type = 'click' AS idr, event_type IN ('click', 'view', 'purchase') AS ref, {_PART} AS part FROM events),
    l AS (SELECT *, CASE WHEN idr THEN 0 ELSE coalesce(last_value(CASE WHEN ref THEN lsb END IGNORE NULLS) {_BEFORE}, 0) END AS last FROM s),
    j AS (SELECT *, CASE WHEN last - lsb >= 128 THEN 256 WHEN lsb - last > 128 THEN -256 ELSE 0 END AS jump FROM l)
    SELECT event_id, CAST(coalesce(sum(CASE WHEN ref THEN jump END) {_BEFORE}, 0) + jump + lsb AS BIGINT) AS poc FROM j""")
def poc_references(t):
    """Display order of which only reference pictures move the state."""
    rows = events(t).withColumn("lsb", F.col("event_id") % 256)
    kind = F.col("event_type")
    return P.display_order(rows, ["user_id"], ORDER, "lsb", kind == "click", kind.isin("click", "view", "purchase"), 256).select("event_id", "poc")


@query(f"""WITH s AS (SELECT *, event_id % 16 AS n, {_PART} AS part FROM events), w AS (SELECT *, CASE WHEN n < lag(n) OVER (PARTITION BY user_id, part ORDER BY ts, event_id) THEN 16 ELSE 0 END AS wrap FROM s)
    SELECT event_id, CAST((sum(wrap) OVER (PARTITION BY user_id, part ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) + n) * 2 + user_id % 2 AS BIGINT) AS poc FROM w""")
def poc_coding(t):
    rows = events(t).withColumn("n", F.col("event_id") % 16)
    return P.coding_order(rows, ["user_id"], ORDER, "n", F.col("event_type") == "click", F.col("user_id") % 2 == 1, 16).select("event_id", "poc")


_HELD = "h AS (SELECT o_custkey, o_orderkey, o_orderkey % 16 AS frame_num, CASE WHEN o_orderkey % 16 > 9 THEN o_orderkey % 16 - 16 ELSE o_orderkey % 16 END AS num, o_orderstatus = 'P' AS is_long FROM orders)"


def _held(t):
    held = t("orders").select("o_custkey", "o_orderkey", (F.col("o_orderkey") % 16).alias("frame_num"), (F.col("o_orderstatus") == "P").alias("is_long"))
    return held.withColumn("num", P.picture_number(F.col("frame_num"), F.lit(9), 16))


@query(f"""WITH {_HELD}, f AS (SELECT o_custkey, num, min(o_orderkey) AS held FROM h GROUP BY ALL) SELECT c_custkey AS o_custkey, num, held FROM customer JOIN f ON c_custkey = o_custkey AND num = c_custkey % 16 - 6""")
def picture_by_number(t):
    asked = t("customer").select(F.col("c_custkey").alias("o_custkey"), (F.col("c_custkey") % 16 - 6).alias("num"))
    return P.by_number(asked, _held(t).select("o_custkey", "num", F.col("o_orderkey").alias("held")), ["o_custkey"], "num", "held")


@query(f"WITH {_HELD} SELECT o_custkey, count(*) FILTER (NOT is_long) AS n_short, count(*) FILTER (is_long) AS n_long FROM h GROUP BY o_custkey")
def buffer_counts(t):
    return P.counts(_held(t), ["o_custkey"])


@query(f"""WITH {_HELD}, r AS (SELECT *, o_orderkey % 2 AS bottom FROM h), s AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY is_long, bottom <> o_custkey % 2, CASE WHEN is_long THEN frame_num ELSE -(2 * num + bottom) END, o_orderkey) - 1 AS slot FROM r),
    f AS (SELECT o_custkey, o_orderkey, slot, max(slot) OVER (PARTITION BY o_custkey) AS last FROM s WHERE slot < 6)
    SELECT o_custkey, o_orderkey, CAST(unnest(CASE WHEN slot = last THEN range(slot, 6) ELSE [slot] END) AS INTEGER) AS slot FROM f""")
def reflist_fields(t):
    bottom = F.col("o_orderkey") % 2
    number = P.picture_number(F.col("frame_num"), F.lit(9), 16, F.lit(True), bottom == 1)
    ranks = [*P.field_ranks(number, F.col("frame_num"), F.col("is_long"), bottom, F.col("o_custkey") % 2), F.col("o_orderkey")]
    return T.reference_list(_held(t), ["o_custkey"], ranks, 6).select("o_custkey", "o_orderkey", "slot")


@query(f"""WITH RECURSIVE {_HELD}, l AS (SELECT o_custkey, list_sort(list(DISTINCT num), 'DESC') AS init FROM h GROUP BY o_custkey),
    m AS (SELECT o_custkey, init, init AS lst, 0 AS k, CAST(9 AS BIGINT) AS last FROM l
      UNION ALL SELECT o_custkey, init, CASE WHEN list_contains(init, num) THEN lst[1:k] || [num] || list_filter(lst[k + 1:], lambda x: x <> num) END, k + 1, nxt
      FROM (SELECT *, CASE WHEN nxt > 9 THEN nxt - 16 ELSE nxt END AS num FROM (SELECT *, (CASE WHEN (o_custkey + k) % 3 < 2 THEN last - (o_custkey + k) % 5 - 1 ELSE last + (o_custkey + k) % 5 + 1 END + 32) % 16 AS nxt FROM m WHERE k < 2)))
    SELECT o_custkey, array_to_string(lst[1:4], ' ') AS modified FROM m WHERE k = 2""")
def reflist_modified(t):
    """Each customer's list after two steps of modification, in order; null where a step asks for what isn't there."""
    initial = _held(t).groupBy("o_custkey").agg(F.sort_array(F.collect_set("num"), asc=False).alias("init"))
    at = lambda k: F.struct(F.when((F.col("o_custkey") + k) % 3 < 2, 0).otherwise(1).alias("op"), ((F.col("o_custkey") + k) % 5).alias("n"))
    return initial.select("o_custkey", F.array_join(P.modified(F.col("init"), F.array(at(0), at(1)), F.lit(9).cast("long"), 16, 4), " ").alias("modified"))


@query()
def marked_buffers(t):
    """Reference buffers of each user's events as pictures with marking commands."""
    e = F.col("event_id")
    step = lambda op, n, m: F.struct(F.lit(op).alias("op"), F.lit(n).alias("n"), F.lit(m).alias("m"))
    ops = F.when(e % 11 == 3, F.array(step(1, 0, 0))).when(e % 11 == 5, F.array(step(3, 0, 1))).when(e % 11 == 7, F.array(step(4, 1, 0), step(6, 0, 0))).when(e % 97 == 0, F.array(step(5, 0, 0)))
    numbered = events(t).withColumn("seq", F.row_number().over(T.ordered(["user_id"], ORDER)).cast("long"))
    pictures = numbered.select(F.col("user_id").alias("stream"), "seq", (F.col("seq") % 16).alias("frame_num"), (F.col("event_type") == "signup").alias("is_idr"), (F.col("event_type") != "error").alias("is_ref"), ops.alias("ops"))
    return P.marked_buffers(pictures, 4)


# --- graphs


@query("SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) + 99 AS id FROM supplier")
def dense_ids(t):
    return G.added(t("supplier").select("s_suppkey"), "s_suppkey", 100)


@query("SELECT p_partkey, row_number() OVER (ORDER BY p_retailprice, p_partkey) - 1 AS position FROM part")
def sorted_positions(t):
    return G.positions(t("part").select("p_partkey", "p_retailprice"), "p_retailprice", ["p_partkey"]).select("p_partkey", "position")


@query("SELECT src, dst, a.n_name AS src_name, b.n_name AS dst_name FROM (SELECT DISTINCT l_partkey % 30 AS src, l_suppkey % 30 AS dst FROM lineitem) LEFT JOIN nation a ON a.n_nationkey = src LEFT JOIN nation b ON b.n_nationkey = dst")
def named_edges(t):
    edges = lines(t).select((F.col("l_partkey") % 30).alias("src"), (F.col("l_suppkey") % 30).alias("dst")).distinct()
    return G.named_edges(edges, t("nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"))).select("src", "dst", "src_name", "dst_name")


@query("SELECT s_nationkey AS level, count(*) AS n, array_to_string(list_sort(list(s_suppkey)), ' ') AS ids FROM supplier GROUP BY s_nationkey")
def independent_sets(t):
    found = G.independent_sets(t("supplier").select(F.col("s_nationkey").alias("level"), F.col("s_suppkey").alias("id")))
    return found.select("level", "n", F.array_join("ids", " ").alias("ids"))


@query("SELECT s_nationkey AS region, printf('Parallel region #%d: %d nodes', CAST(s_nationkey AS BIGINT), n) AS description, s_suppkey AS member FROM supplier JOIN (SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY s_nationkey HAVING count(*) >= 2) USING (s_nationkey)")
def region_rows(t):
    return G.regions(t("supplier"), "s_nationkey", "s_suppkey")
