"""The registered queries of the core engine and their SQL."""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schema as S
from .functions import dates, numeric, predicates
from .functions.aggregates import Count, First, Last, Mean, StringJoin, Sum
from .functions.expr import and_, not_, or_, quoted
from .functions.values import number
from .plans import factories as step
from .plans.pipeline import ErrorLog, concat_pipelines, from_table
from .storage import shared_dir
from .table import BinDef, Case, JSONOptions, Table, asc, cartesian_product, concat, desc, from_frame, union

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its name, with the SQL for its rows where SQL can express it."""

    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _table(spark, sf_dir, name, order, *cols) -> Table:
    return from_frame(_t(spark, sf_dir, name).select(*cols) if cols else _t(spark, sf_dir, name), order)


def _out(table: Table, **kinds: str) -> DataFrame:
    """The rows with some columns as numbers (empty: null)."""
    env = table._env()

    def typed(c: str, kind: str):
        if kind.startswith("round"):
            return F.round(env.number(c), int(kind[5:]))
        return env.number(c) if kind == "double" else F.nullif(quoted(c), F.lit("")).cast(kind)

    return table._df.select(*(typed(c, kinds[c]).alias(c) if c in kinds else quoted(c) for c in table.headers))


# -- projections and filters ----------------------------------------------------------------------


@query("""
SELECT n_name, round(sum(o_totalprice), 2) AS revenue, round(avg(o_totalprice), 2) AS mean_price, count(o_orderkey) AS n_orders
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
WHERE o_orderdate >= TIMESTAMP '1996-01-01' GROUP BY n_name""")
def flagship_etl_chain(spark, sf_dir):
    orders, customer, nation = (_t(spark, sf_dir, n) for n in ("orders", "customer", "nation"))
    return (
        orders.filter(F.col("o_orderdate") >= "1996-01-01")
        .join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .groupBy("n_name")
        .agg(F.round(F.sum("o_totalprice"), 2).alias("revenue"), F.round(F.avg("o_totalprice"), 2).alias("mean_price"), F.count("o_orderkey").alias("n_orders"))
    )


@query("""
SELECT CASE WHEN segment = '' THEN 'none' ELSE segment END AS segment, CASE WHEN price >= 150000 THEN 'high' ELSE 'low' END AS label,
  CAST(count(*) AS BIGINT) AS n, round(sum(price), 2) AS revenue, round(avg(price), 2) AS mean_price FROM
  (SELECT o_totalprice AS price, CASE WHEN c_mktsegment = 'MACHINERY' THEN '' ELSE c_mktsegment END AS segment FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus <> 'P')
GROUP BY 1, 2""")
def table_etl_chain(spark, sf_dir):
    orders = _table(spark, sf_dir, "orders", "o_orderkey", "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    people = _table(spark, sf_dir, "customer", "c_custkey", "c_custkey", "c_mktsegment").map_expr("c_mktsegment", lambda c: F.when(c == "MACHINERY", "").otherwise(c))
    label = F.when(number(quoted("o_totalprice")) >= 150000, "high").otherwise("low")
    chain = (
        orders.drop_empty("o_totalprice").where(predicates.ne("o_orderstatus", "P")).join(people, "o_custkey", "c_custkey")
        .fill_empty("c_mktsegment", "none").rename("c_mktsegment", "segment").add_col("label", label).sort_multi(asc("segment"), desc("label"))
        .group_by_agg(["segment", "label"], [("n", Count("o_orderkey")), ("revenue", Sum("o_totalprice")), ("mean_price", Mean("o_totalprice"))])
    )
    return _out(chain, n="bigint", revenue="round2", mean_price="round2")


@query("SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS title, p_brand AS title_2 FROM part")
def select_rename_drop(spark, sf_dir):
    part = _table(spark, sf_dir, "part", "p_partkey").select("p_partkey", "p_name", "p_brand", "p_type").drop("p_type", "nothing")
    return part.rename("p_partkey", "id").rename_many({"p_name": "title", "p_brand": "title"})._df.drop("__ord")


@query("""
SELECT o_orderkey, lower(o_orderpriority) AS o_orderpriority, o_orderstatus || '/' || o_orderpriority AS tag, o_totalprice * 2 AS twice, o_orderkey + 1 AS following,
  CASE WHEN o_orderstatus = 'F' THEN 'done' WHEN o_orderstatus = 'O' THEN 'open' ELSE 'other' END AS state,
  CASE WHEN o_orderstatus = 'F' THEN lower(o_orderpriority) ELSE o_orderstatus END AS first_of,
  CASE WHEN o_totalprice < 100000 THEN 'small' WHEN o_totalprice < 200000 THEN 'medium' ELSE 'large' END AS size FROM orders""")
def map_addcol_switch(spark, sf_dir):
    orders = _table(spark, sf_dir, "orders", "o_orderkey", "o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice")
    made = (
        orders.add_col("tag", F.concat_ws("/", "o_orderstatus", "o_orderpriority")).map_expr("o_orderpriority", F.lower).add_col_float("twice", numeric.mul_const("o_totalprice", 2))
        .add_col_int("following", F.col("o_orderkey").cast("bigint") + 1)
        .add_col_switch("state", [Case(predicates.eq("o_orderstatus", "F"), F.lit("done")), Case(predicates.eq("o_orderstatus", "O"), F.lit("open"))], F.lit("other"))
        .add_col("not_done", F.when(F.col("o_orderstatus") == "F", "").otherwise(F.col("o_orderstatus"))).coalesce("first_of", "nothing", "not_done", "o_orderpriority")
        .bin("o_totalprice", "size", [BinDef(100000, "small"), BinDef(200000, "medium"), BinDef(float("inf"), "large")]).drop("not_done", "o_orderstatus", "o_totalprice")
    )
    return _out(made, o_orderkey="bigint", twice="double", following="bigint")


@query("""
SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'none' ELSE o_orderstatus END AS o_orderstatus, printf('%.1f', o_totalprice) AS o_totalprice FROM orders""")
def fill_format(spark, sf_dir):
    orders = _table(spark, sf_dir, "orders", "o_orderkey", "o_orderkey", "o_orderstatus", "o_totalprice").map_expr("o_orderstatus", lambda c: F.when(c == "F", "").otherwise(c))
    return _out(orders.fill_empty("o_orderstatus", "none").format_col("o_totalprice", 1), o_orderkey="bigint")


@query("""
SELECT p_partkey FROM part WHERE (p_brand = 'Brand#11' OR p_type LIKE '%BRASS%' OR regexp_matches(p_name, '^[a-m].*e')) AND p_name <> 'x'
  AND NOT (p_brand LIKE 'Brand#5%' OR p_type LIKE '%STEEL') AND p_name <> ''""")
def predicates_all(spark, sf_dir):
    part = _table(spark, sf_dir, "part", "p_partkey")
    kept = part.where(
        and_(
            or_(part.eq("p_brand", "Brand#11"), part.contains("p_type", "BRASS"), part.matches("p_name", "^[a-m].*e")),
            part.ne("p_name", "x"),
            not_(or_(part.prefix("p_brand", "Brand#5"), part.suffix("p_type", "STEEL"))),
            part.not_empty("p_name"),
            part.empty("nothing"),
        )
    )
    return _out(kept.select("p_partkey"), p_partkey="bigint")


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderstatus <> 'F'")
def drop_empty(spark, sf_dir):
    orders = _table(spark, sf_dir, "orders", "o_orderkey", "o_orderkey", "o_orderstatus", "o_orderpriority").map_expr("o_orderstatus", lambda c: F.when(c == "F", "").otherwise(c))
    return _out(orders.drop_empty("o_orderstatus").drop("o_orderstatus"), o_orderkey="bigint")


@query("SELECT CASE WHEN o_totalprice > 100000 THEN 'matched' ELSE 'rest' END AS side, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY 1")
def partition_rows(spark, sf_dir):
    matched, rest = _table(spark, sf_dir, "orders", "o_orderkey", "o_orderkey", "o_totalprice").partition(number(F.col("o_totalprice")) > 100000)
    sides = matched.add_col("side", F.lit("matched")).append(rest.add_col("side", F.lit("rest")))
    return _out(sides.group_by_agg(["side"], [("n", Count("o_orderkey"))]), n="bigint")


# -- joins ----------------------------------------------------------------------------------------


def _join_sides(spark, sf_dir):
    """All customers and orders; keys that a side lacks are rewritten, so that both sides have rows without a partner."""
    key = F.when(F.col("c_custkey") % 3 == 0, -F.col("c_custkey")).otherwise(F.col("c_custkey"))
    people = from_frame(_t(spark, sf_dir, "customer").select("c_custkey", key.alias("key"), "c_name"), "c_custkey").drop("c_custkey").rename("key", "c_custkey")
    orders = from_frame(_t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_orderpriority").alias("c_name")), "o_orderkey")
    return people, orders


_SIDES = "WITH c AS (SELECT CASE WHEN c_custkey % 3 = 0 THEN -c_custkey ELSE c_custkey END AS c_custkey, c_name FROM customer), o AS (SELECT o_orderkey, o_custkey, o_orderpriority FROM orders) "
_PICK = "CAST(coalesce(c_custkey, o_custkey) AS VARCHAR) AS c_custkey, coalesce(c_name, '') AS c_name, o_orderkey, coalesce(o_orderpriority, '') AS c_name_2 FROM c"


@query(_SIDES + f"SELECT {_PICK} JOIN o ON c_custkey = o_custkey")
def join_inner(spark, sf_dir):
    people, orders = _join_sides(spark, sf_dir)
    return _out(people.join(orders, "c_custkey", "o_custkey"), o_orderkey="bigint")


@query(_SIDES + f"SELECT {_PICK} LEFT JOIN o ON c_custkey = o_custkey")
def join_left(spark, sf_dir):
    people, orders = _join_sides(spark, sf_dir)
    return _out(people.left_join(orders, "c_custkey", "o_custkey"), o_orderkey="bigint")


@query(_SIDES + f"SELECT {_PICK} RIGHT JOIN o ON c_custkey = o_custkey")
def join_right(spark, sf_dir):
    people, orders = _join_sides(spark, sf_dir)
    return _out(people.right_join(orders, "c_custkey", "o_custkey"), o_orderkey="bigint")


@query(_SIDES + f"SELECT {_PICK} FULL JOIN o ON c_custkey = o_custkey")
def join_outer(spark, sf_dir):
    people, orders = _join_sides(spark, sf_dir)
    return _out(people.outer_join(orders, "c_custkey", "o_custkey"), o_orderkey="bigint")


@query(_SIDES + "SELECT c_custkey, c_name FROM c WHERE c_custkey NOT IN (SELECT o_custkey FROM o)")
def join_anti(spark, sf_dir):
    people, orders = _join_sides(spark, sf_dir)
    return _out(people.anti_join(orders, "c_custkey", "o_custkey"), c_custkey="bigint")


@query("""
WITH l AS (SELECT o_custkey, arg_max(o_orderpriority, o_orderkey) AS v FROM orders GROUP BY 1)
SELECT c_custkey, coalesce(v, '') AS last_priority FROM customer LEFT JOIN l ON c_custkey = o_custkey""")
def lookup_last(spark, sf_dir):
    _, orders = _join_sides(spark, sf_dir)
    people = _table(spark, sf_dir, "customer", "c_custkey", "c_custkey")
    return _out(people.lookup("c_custkey", "last_priority", orders, "o_custkey", "c_name"), c_custkey="bigint")


@query("SELECT r_name, n_name FROM region CROSS JOIN nation")
def cartesian(spark, sf_dir):
    return _out(cartesian_product(_table(spark, sf_dir, "region", "r_regionkey", "r_regionkey", "r_name").drop("r_regionkey"), _table(spark, sf_dir, "nation", "n_nationkey", "n_nationkey", "n_name").drop("n_nationkey")))


# -- aggregates -----------------------------------------------------------------------------------


@query("""
SELECT event_type, round(sum(value), 2) AS total, round(avg(value), 4) AS mean_value, CAST(count(*) AS BIGINT) AS n, string_agg(CAST(user_id AS VARCHAR), '|' ORDER BY event_id) AS users,
  CAST(arg_min(user_id, event_id) AS VARCHAR) AS first_user, CAST(arg_max(user_id, event_id) AS VARCHAR) AS last_user FROM events GROUP BY event_type""")
def groupby_aggs(spark, sf_dir):
    events = _table(spark, sf_dir, "events", "event_id", "event_id", "event_type", "user_id", "value")
    aggs = [("total", Sum("value")), ("mean_value", Mean("value")), ("n", Count("value")), ("users", StringJoin("user_id", "|")), ("first_user", First("user_id")), ("last_user", Last("user_id"))]
    return _out(events.group_by_agg(["event_type"], aggs), total="round2", mean_value="round4", n="bigint")


@query("SELECT event_type AS value, CAST(count(*) AS BIGINT) AS count FROM events GROUP BY 1")
def value_counts(spark, sf_dir):
    return _out(_table(spark, sf_dir, "events", "event_id", "event_id", "event_type").value_counts("event_type"), count="bigint")


@query("SELECT event_type, CAST(count(*) AS BIGINT) AS n, CAST((SELECT count(*) FROM events WHERE event_type = 'click') AS BIGINT) AS clicks FROM events GROUP BY 1")
def freq_map_count_where(spark, sf_dir):
    events = _table(spark, sf_dir, "events", "event_id", "event_id", "event_type")
    clicks = S.count_where(events, "event_type", "click")
    return spark.createDataFrame([(k, n, clicks) for k, n in S.freq_map(events, "event_type").items()], "event_type string, n long, clicks long")


_STATS = "CAST(count({0}) AS BIGINT) AS count, min({0}) AS min, max({0}) AS max, round(avg({0}), 6) AS mean, round(stddev_pop({0}), 6) AS std, median({0}) AS median FROM lineitem"


@query("SELECT 'l_quantity' AS column, " + _STATS.format("l_quantity") + " UNION ALL SELECT 'l_extendedprice' AS column, " + _STATS.format("l_extendedprice") + " UNION ALL SELECT 'l_returnflag', 0, NULL, NULL, NULL, NULL, NULL")
def describe(spark, sf_dir):
    lines = from_frame(_t(spark, sf_dir, "lineitem").select("l_quantity", "l_extendedprice", "l_returnflag"))
    return _out(S.describe(lines), count="bigint", min="double", max="double", mean="round6", std="round6", median="double")


@query("""
SELECT round(sum(l_quantity), 2) AS total, round(avg(l_quantity), 6) AS mean_value, min(l_tax) AS low, max(l_tax) AS high, CAST(count(l_tax) AS BIGINT) AS n,
  round(stddev_pop(l_quantity), 6) AS deviation, median(l_extendedprice) AS middle, 0.0::DOUBLE AS unknown FROM lineitem""")
def column_statistics(spark, sf_dir):
    lines = from_frame(_t(spark, sf_dir, "lineitem").select("l_quantity", "l_extendedprice", "l_tax"))
    row = (round(S.sum_col(lines, "l_quantity"), 2), round(S.mean_col(lines, "l_quantity"), 6), S.min_col(lines, "l_tax"), S.max_col(lines, "l_tax"), S.count_col(lines, "l_tax"), round(S.std_dev_col(lines, "l_quantity"), 6), S.median_col(lines, "l_extendedprice"), S.sum_col(lines, "nothing"))
    return spark.createDataFrame([row], "total double, mean_value double, low double, high double, n long, deviation double, middle double, unknown double")


@query("SELECT event_id, round((value - (SELECT min(value) FROM events)) / ((SELECT max(value) FROM events) - (SELECT min(value) FROM events)), 9) AS value FROM events")
def minmax_norm(spark, sf_dir):
    return _out(S.min_max_norm(_table(spark, sf_dir, "events", "event_id", "event_id", "value"), "value"), event_id="bigint", value="round9")


# -- row order ------------------------------------------------------------------------------------


def _events(spark, sf_dir, *more):
    return _table(spark, sf_dir, "events", "event_id", "event_id", *more)


@query("""
SELECT event_id, coalesce(lag(event_type, 2) OVER w, '') AS before, coalesce(lead(event_type, 3) OVER w, '') AS after FROM events WINDOW w AS (ORDER BY event_id)""")
def lag_lead(spark, sf_dir):
    return _out(_events(spark, sf_dir, "event_type").lag("event_type", "before", 2).lead("event_type", "after", 3).drop("event_type"), event_id="bigint")


@query("SELECT event_id, CAST(sum(user_id) OVER (ORDER BY event_id) AS BIGINT) AS ids, round(sum(value) OVER (ORDER BY event_id), 2) AS running FROM events")
def cumsum(spark, sf_dir):
    return _out(_events(spark, sf_dir, "user_id", "value").cum_sum("user_id", "ids").cum_sum("value", "running").drop("user_id", "value"), event_id="bigint", ids="bigint", running="round2")


@query("SELECT event_id, dense_rank() OVER (ORDER BY user_id) AS up, dense_rank() OVER (ORDER BY value DESC) AS down FROM events")
def rank_dense(spark, sf_dir):
    return _out(_events(spark, sf_dir, "user_id", "value").rank("user_id", "up").rank("value", "down", False).drop("user_id", "value"), event_id="bigint", up="bigint", down="bigint")


@query("""
SELECT event_id, round(sum(value) OVER w, 4) AS total, round(avg(value) OVER w, 6) AS mean_value, CAST(count(value) OVER w AS BIGINT) AS n, string_agg(event_type, ',') OVER w AS types,
  first_value(event_type) OVER w AS opening FROM events WINDOW w AS (ORDER BY event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""")
def rolling(spark, sf_dir):
    t = _events(spark, sf_dir, "event_type", "value")
    for name, agg in (("total", Sum("value")), ("mean_value", Mean("value")), ("n", Count("value")), ("types", StringJoin("event_type", ",")), ("opening", First("event_type"))):
        t = t.rolling_agg(name, 5, agg)
    return _out(t.drop("event_type", "value"), event_id="bigint", total="round4", mean_value="round6", n="bigint")


_BLANK = "CASE WHEN event_id % 4 = 0 THEN event_type END"


@query(f"""
SELECT event_id, coalesce(last_value({_BLANK} IGNORE NULLS) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING), '') AS forward,
  coalesce(first_value({_BLANK} IGNORE NULLS) OVER (ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), '') AS backward FROM events""")
def fill_forward_backward(spark, sf_dir):
    df = _t(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 4 == 0, F.col("event_type")).alias("forward")).withColumn("backward", F.col("forward"))
    return _out(from_frame(df, "event_id").fill_forward("forward").fill_backward("backward"), event_id="bigint")


@query("SELECT row_number() OVER (ORDER BY o_orderpriority DESC, o_orderstatus, o_orderkey) - 1 AS place, o_orderkey FROM orders")
def sort_multi_row_index(spark, sf_dir):
    orders = _table(spark, sf_dir, "orders", "o_orderkey", "o_orderkey", "o_orderstatus", "o_orderpriority")
    return _out(orders.sort_multi(desc("o_orderpriority"), asc("o_orderstatus")).add_row_index("place").select("place", "o_orderkey"), place="bigint", o_orderkey="bigint")


@query("(SELECT o_orderkey, 'head' AS part FROM orders ORDER BY o_orderstatus DESC, o_orderkey LIMIT 7) UNION ALL (SELECT o_orderkey, 'tail' AS part FROM orders ORDER BY o_orderkey DESC LIMIT 5)")
def sort_head_tail(spark, sf_dir):
    orders = _table(spark, sf_dir, "orders", "o_orderkey", "o_orderkey", "o_orderstatus")
    head = orders.sort("o_orderstatus", False).head(7).add_col("part", F.lit("head"))
    return _out(head.append(orders.tail(5).add_col("part", F.lit("tail"))).drop("o_orderstatus"), o_orderkey="bigint")


@query("SELECT CAST((row_number() OVER (ORDER BY n_nationkey) - 1) // 10 AS INTEGER) AS chunk, n_name FROM nation")
def chunks(spark, sf_dir):
    parts = _table(spark, sf_dir, "nation", "n_nationkey", "n_nationkey", "n_name").chunk(10)
    return _out(concat(*(p.add_col("chunk", F.lit(str(i))) for i, p in enumerate(parts))).select("chunk", "n_name"), chunk="int")


@query()
def sample_n(spark, sf_dir):
    return _out(_events(spark, sf_dir, "event_type").sample(100, seed=7))


# -- sets -----------------------------------------------------------------------------------------


@query("SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderstatus, o_orderpriority ORDER BY o_orderkey) = 1")
def distinct_first(spark, sf_dir):
    return _out(_table(spark, sf_dir, "orders", "o_orderkey", "o_orderkey", "o_orderstatus", "o_orderpriority").distinct("o_orderstatus", "o_orderpriority"), o_orderkey="bigint")


@query("SELECT n_name, '' AS extra FROM nation WHERE n_regionkey <= 2 UNION ALL SELECT n_name, '' FROM nation WHERE n_regionkey >= 2")
def append_rows(spark, sf_dir):
    a, b = _halves(spark, sf_dir)
    return _out(a.add_col("extra", F.lit("")).append(b.add_col("other", F.lit("x"))))


@query("SELECT DISTINCT n_name FROM nation")
def union_distinct(spark, sf_dir):
    return _out(union(*_halves(spark, sf_dir), "n_name"))


def _halves(spark, sf_dir):
    nation = _t(spark, sf_dir, "nation")
    return tuple(from_frame(nation.filter(c).select("n_nationkey", "n_name"), "n_nationkey").drop("n_nationkey") for c in ("n_regionkey <= 2", "n_regionkey >= 2"))


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN (SELECT o_orderpriority FROM orders WHERE o_orderkey < 3)")
def intersect_semi(spark, sf_dir):
    orders = _table(spark, sf_dir, "orders", "o_orderkey", "o_orderkey", "o_orderpriority")
    return _out(orders.intersect(orders.where(F.col("o_orderkey").cast("bigint") < 3), "o_orderpriority"), o_orderkey="bigint")


# -- reshape --------------------------------------------------------------------------------------


@query("SELECT p_partkey, unnest(string_split(p_name, ' ')) AS p_name FROM part")
def explode_words(spark, sf_dir):
    return _out(_table(spark, sf_dir, "part", "p_partkey", "p_partkey", "p_name").explode("p_name", " "), p_partkey="bigint")


@query("SELECT n_nationkey, 'n_name' AS field, n_name AS cell FROM nation UNION ALL SELECT n_nationkey, 'n_regionkey', CAST(n_regionkey AS VARCHAR) FROM nation")
def melt_columns(spark, sf_dir):
    return _out(_table(spark, sf_dir, "nation", "n_nationkey").melt(["n_nationkey"], "field", "cell"), n_nationkey="int")


@query("""
SELECT CAST(user_id AS VARCHAR) AS user_id, coalesce(arg_max(event_id, event_id) FILTER (event_type = 'click'), -1) AS click, coalesce(arg_max(event_id, event_id) FILTER (event_type = 'purchase'), -1) AS purchase
FROM events WHERE event_type IN ('click', 'purchase') GROUP BY user_id""")
def pivot_last(spark, sf_dir):
    events = _events(spark, sf_dir, "user_id", "event_type").where(or_(predicates.eq("event_type", "click"), predicates.eq("event_type", "purchase")))
    wide = events.pivot("user_id", "event_type", "event_id")
    for name in ("click", "purchase"):
        wide = wide.fill_empty(name, "-1") if name in wide.headers else wide.add_col(name, F.lit("-1"))
    return _out(wide.select("user_id", "click", "purchase"), click="bigint", purchase="bigint")


@query("SELECT * FROM (SELECT 'r_regionkey' AS column, " + ", ".join(f"(SELECT CAST(r_regionkey AS VARCHAR) FROM region WHERE r_regionkey = {i}) AS \"{i}\"" for i in range(5)) + ") UNION ALL SELECT 'r_name', " + ", ".join(f"(SELECT r_name FROM region WHERE r_regionkey = {i})" for i in range(5)))
def transpose_region(spark, sf_dir):
    return _out(_table(spark, sf_dir, "region", "r_regionkey").transpose())


# -- JSON -----------------------------------------------------------------------------------------


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS \"props.k\" FROM events")
def expand_json(spark, sf_dir):
    return _out(_events(spark, sf_dir, "props").expand_json("props"), **{"event_id": "bigint", "props.k": "bigint"})


@query("""SELECT event_id, json_extract_string(props, '$.k') AS value, '{"key":' || json_extract_string(props, '$.k') || '}' AS rebuilt, json_extract_string(props, '$.k') AS mapped, '' AS missing FROM events""")
def map_json(spark, sf_dir):
    t = _events(spark, sf_dir, "props").add_col("value", F.col("props")).add_col("rebuilt", F.col("props")).map_json("value", ".k").map_json("rebuilt", mapping={"key": ".k", "no": ".x"})
    return _out(t.expand_json("props", JSONOptions(mapping={"mapped": ".k", "missing": ".a.b[0]"})), event_id="bigint")


# -- scalars --------------------------------------------------------------------------------------


@query("""
SELECT event_id, round(value + user_id, 6) AS plus, round(value - user_id, 6) AS minus, round(value * user_id, 4) AS times, round(CASE WHEN user_id % 7 = 0 THEN 0 ELSE value / (user_id % 7) END, 6) AS ratio,
  CASE WHEN user_id % 7 = 0 THEN 0 ELSE event_id % (user_id % 7) END::DOUBLE AS rest, abs(value - 50) AS size, -value AS negative, value + 1.5 AS more, value * 3 AS thrice, least(value, user_id) AS low, greatest(value, user_id) AS high,
  least(greatest(value, 10), 90) AS clamped, round(CASE WHEN user_id % 7 = 0 THEN 0 ELSE value / (user_id % 7) * 100 END, 4) AS percent, floor(abs(value) * 10 + 0.5) / 10 * sign(value) AS rounded FROM events""")
def numeric_scalars(spark, sf_dir):
    df = _t(spark, sf_dir, "events").select("event_id", "value", "user_id", (F.col("user_id") % 7).alias("seven"), (F.col("value") - 50).alias("off"))
    t = from_frame(df, "event_id")
    made = {
        "plus": numeric.add("value", "user_id"), "minus": numeric.sub("value", "user_id"), "times": numeric.mul("value", "user_id"), "ratio": numeric.div("value", "seven"), "rest": numeric.mod("event_id", "seven"),
        "size": numeric.abs_("off"), "negative": numeric.neg("value"), "more": numeric.add_const("value", 1.5), "thrice": numeric.mul_const("value", 3), "low": numeric.min2("value", "user_id"), "high": numeric.max2("value", "user_id"),
        "clamped": numeric.clamp("value", 10, 90), "percent": numeric.pct("value", "seven"), "rounded": numeric.round_("value", 1),
    }
    for name, fn in made.items():
        t = t.add_col_float(name, fn)
    kinds = dict.fromkeys(made, "double") | {"event_id": "bigint", "plus": "round6", "minus": "round6", "times": "round4", "ratio": "round6", "percent": "round4"}
    return _out(t.drop("value", "user_id", "seven", "off"), **kinds)


@query("""
WITH d AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)
SELECT o_orderkey, CAST(d - DATE '1998-03-15' AS DOUBLE) AS days, round((d - DATE '1998-03-15') / 30.44, 6) AS months, round((d - DATE '1998-03-15') / 365.25, 6) AS years, strftime(d + 40, '%Y-%m-%d') AS later,
  strftime(CAST(date_trunc('month', d) + INTERVAL 1 MONTH AS DATE) + CAST(day(d) - 1 AS INTEGER), '%Y-%m-%d') AS next_month, CAST(year(d) AS VARCHAR) AS y, CAST(month(d) AS VARCHAR) AS m, CAST(day(d) AS VARCHAR) AS dd, CAST(weekofyear(d) AS VARCHAR) AS w,
  dayname(d) AS name, CAST(quarter(d) AS VARCHAR) AS q, strftime(date_trunc('month', d), '%Y-%m-%d') AS opens, strftime(last_day(d), '%Y-%m-%d') AS closes, strftime(date_trunc('year', d), '%Y-%m-%d') AS new_year, strftime(d, '%d.%m.%Y') AS german,
  CAST(2020 - year(d) - CASE WHEN dayofyear(DATE '2020-06-15') < dayofyear(d) THEN 1 ELSE 0 END AS VARCHAR) AS age FROM d WHERE d BETWEEN DATE '1996-02-01' AND DATE '1998-03-15'""")
def date_scalars(spark, sf_dir):
    df = _t(spark, sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("d"), F.lit("15.03.1998").alias("ref"), F.lit("02/01/1996").alias("start"))
    t = from_frame(df, "o_orderkey").where(dates.between("d", "start", "ref"))
    for name, fn in (("days", dates.diff_days("d", "ref")), ("months", dates.diff_months("d", "ref")), ("years", dates.diff_years("d", "ref"))):
        t = t.add_col_float(name, fn)
    texts = {
        "later": dates.add_days("d", 40), "next_month": dates.add_months("d", 1), "y": dates.year("d"), "m": dates.month("d"), "dd": dates.day("d"), "w": dates.week("d"), "name": dates.weekday("d"), "q": dates.quarter("d"),
        "opens": dates.start_of_month("d"), "closes": dates.end_of_month("d"), "new_year": dates.trunc("d", "year"), "german": dates.format_("d", "02.01.2006"), "age": dates.age("d", datetime.date(2020, 6, 15)),
    }
    for name, fn in texts.items():
        t = t.add_col(name, fn)
    return _out(t.drop("d", "ref", "start"), o_orderkey="bigint", days="double", months="round6", years="round6")


# -- schema, validation, pipelines ----------------------------------------------------------------


@query("SELECT * FROM (VALUES ('c_custkey', 'INT'), ('c_name', 'STRING'), ('c_acctbal', 'FLOAT'), ('flag', 'BOOL'), ('day', 'DATE'), ('none', 'STRING')) t(name, kind)")
def infer_types(spark, sf_dir):
    df = _t(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal", F.when(F.col("c_custkey") % 2 == 0, "yes").otherwise("no").alias("flag"), F.lit("15.01.2024").alias("day"), F.lit("").alias("none"))
    found = S.infer(from_frame(df, "c_custkey"))
    return spark.createDataFrame([(n, k.name) for n, k in found.cols().items()], "name string, kind string")


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'true' ELSE 'false' END AS flag, '2024-01-15' AS day, c_acctbal FROM customer")
def apply_schema(spark, sf_dir):
    df = _t(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, "Yes").otherwise("0").alias("flag"), F.lit(" 15.01.2024").alias("day"), "c_acctbal")
    schema = S.Schema({"c_custkey": S.ColType.INT, "flag": S.ColType.BOOL, "day": S.ColType.DATE, "c_acctbal": S.ColType.FLOAT})
    return _out(from_frame(df, "c_custkey").assert_no_empty() or schema.apply_strict(from_frame(df, "c_custkey")).unwrap(), c_custkey="bigint", c_acctbal="double")


@query("""
SELECT 'good' AS kind, CAST(count(*) AS BIGINT) AS n, CAST(sum(event_id) AS BIGINT) AS total FROM events WHERE event_id % 10 <> 3
UNION ALL SELECT 'bad', count(*), CAST(sum(event_id) AS BIGINT) FROM events WHERE event_id % 10 = 3""")
def try_map_reject(spark, sf_dir):
    df = _t(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 10 == 3, "bad").otherwise(F.col("user_id").cast("string")).alias("n"))
    log = ErrorLog()
    good = from_table(from_frame(df, "event_id")).with_error_log(log).try_map("n", lambda v: str(int(v) + 1)).unwrap()
    bad = log.to_table()
    both = good.select("event_id").add_col("kind", F.lit("good")).append(bad.select("event_id").add_col("kind", F.lit("bad")))
    return _out(both.group_by_agg(["kind"], [("n", Count("event_id")), ("total", Sum("event_id"))]), n="bigint", total="bigint")


@query("SELECT o_orderpriority, CAST(count(*) AS BIGINT) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1")
def pipeline_steps(spark, sf_dir):
    """fan_out, group_by, factories and concat_pipelines in one flow."""
    orders = _table(spark, sf_dir, "orders", "o_orderkey", "o_orderkey", "o_orderstatus", "o_orderpriority")
    done = from_table(orders).assert_columns("o_orderkey").then(step.where(predicates.eq("o_orderstatus", "F"))).if_then(True, step.drop("o_orderstatus"))
    low, high = done.fan_out(step.where(F.col("o_orderkey").cast("bigint") % 2 == 0), step.where(F.col("o_orderkey").cast("bigint") % 2 == 1))
    return _out(concat_pipelines(low, high).then(step.group_by_agg(["o_orderpriority"], [("n", Count("o_orderkey"))])).unwrap(), n="bigint")


@query("SELECT 'keep' AS name, CAST(count(*) AS BIGINT) AS input_rows, CAST(count(*) FILTER (event_type = 'click') AS BIGINT) AS output_rows FROM events UNION ALL SELECT 'top', CAST(count(*) FILTER (event_type = 'click') AS BIGINT), 3 FROM events")
def trace_steps(spark, sf_dir):
    flow = from_table(_events(spark, sf_dir, "event_type")).with_tracing().step("keep", step.where(predicates.eq("event_type", "click"))).step("top", step.head(3))
    return spark.createDataFrame([(r.name, r.input_rows, r.output_rows) for r in flow.trace()], "name string, input_rows long, output_rows long")


# -- sources and sinks ----------------------------------------------------------------------------


def _folder(spark, name):
    import uuid

    return f"{shared_dir(spark)}/tabloom/{name}-{uuid.uuid4().hex}"


@query("SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name || ', \"' || n_name || '\"' AS n_name, '' AS note FROM nation")
def csv_roundtrip(spark, sf_dir):
    from .sources.delimited import CSVReader, CSVWriter

    at = _folder(spark, "csv")
    nation = _table(spark, sf_dir, "nation", "n_nationkey", "n_nationkey", "n_name").map_expr("n_name", lambda c: F.concat(c, F.lit(', "'), c, F.lit('"'))).add_col("note", F.lit(""))
    CSVWriter(separator=";").write_folder(at, nation)
    return _out(CSVReader(separator=";").read_file(at).unwrap())


@query("SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name FROM nation")
def ndjson_roundtrip(spark, sf_dir):
    from .sources.jsonfiles import JSONReader, JSONWriter

    at = _folder(spark, "json")
    JSONWriter(ndjson=True).write_folder(at, _table(spark, sf_dir, "nation", "n_nationkey", "n_nationkey", "n_name"))
    return _out(JSONReader(ndjson=True).read_file(at, lines=True).unwrap())
