"""More registered queries of the core engine: Python row functions, rejects, pipeline control, mutable tables, options of sources and sinks, and the row order itself."""

from __future__ import annotations

import io
import uuid
import zipfile

from pyspark.sql import functions as F

from . import schema as S
from .catalog import _events, _out, _t, _table, query
from .functions import predicates
from .functions.aggregates import Count, First, Last, Sum
from .plans import factories as step
from .plans.pipeline import ErrorLog, Transform, compose, concat_pipelines, from_mutable, from_result, from_table
from .plans.result import Err, Ok
from .storage import materialise, open_output, shared_dir
from .table import JSONOptions, MutableTable, Row, Table, concat, desc, from_frame, new, new_from_rows, new_mutable


def _at(spark, name: str) -> str:
    return f"{shared_dir(spark)}/tabloom/{name}-{uuid.uuid4().hex}"


def _facts(spark, **values):
    """One row of facts."""
    kinds = {bool: "boolean", int: "long", float: "double", str: "string"}
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {kinds[type(v)]}" for k, v in values.items()))


# -- Python functions of rows ---------------------------------------------------------------------


def _day(spark, sf_dir) -> Table:
    df = _t(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", F.date_format("ts", "yyyy-MM-dd").alias("day"), F.when(F.col("event_id") % 2 == 0, "Yes").otherwise("0").alias("flag"))
    return from_frame(df, "event_id")


@query("""
SELECT event_id, upper(event_type) AS event_type, CAST(event_id AS VARCHAR) || '/' || event_type AS user_id, CAST(user_id * 2 AS BIGINT) AS twice_id, value * 2 AS twice, CASE WHEN event_id % 2 = 0 THEN 'even' ELSE 'odd' END AS parity,
  CAST(year(ts) AS VARCHAR) AS y, 'event_type' AS third, CAST(event_id AS VARCHAR) AS opening, '6' AS width FROM events""")
def row_functions(spark, sf_dir):
    """transform, add_col_of and typed access with Python functions of a row (Row.get, at, headers, values, to_map)."""
    t = _day(spark, sf_dir)
    t = t.add_col_of("twice_id", lambda r: S.int_(r, "user_id") * 2, str).add_col_float("twice", lambda r: S.float_(r, "value") * 2)
    t = t.add_col("parity", lambda r: "even" if S.bool_(r, "flag") else "odd").add_col("y", lambda r: str(S.time_(r, "day").year))
    t = t.add_col("third", lambda r: r.headers()[2]).add_col("opening", lambda r: r.at(0)).add_col("width", lambda r: str(len(r.values()[:6])))
    t = t.transform(lambda r: {"event_type": r.get("event_type").upper(), "user_id": r.to_map()["event_id"] + "/" + r["event_type"], "nothing": "x"})
    return _out(t.drop("value", "day", "flag"), event_id="bigint", twice_id="bigint", twice="double")


@query("SELECT event_id, reverse(event_type) AS event_type, 'u' || CAST(user_id AS VARCHAR) AS user_id FROM events")
def row_functions_parallel(spark, sf_dir):
    t = _events(spark, sf_dir, "event_type", "user_id").map_parallel("event_type", lambda c: c[::-1])
    return _out(t.transform_parallel(lambda r: {"user_id": "u" + r["user_id"]}), event_id="bigint")


def _strict(r: Row) -> dict[str, str]:
    if int(r["event_id"]) % 10 == 3:
        raise ValueError("bad " + r["event_id"])
    return {"event_type": r["event_type"].upper()}


@query("""
SELECT event_id, upper(event_type) AS event_type, user_id + 1 AS user_id, (SELECT 'bad ' || CAST(min(event_id) AS VARCHAR) FROM events WHERE event_id % 10 = 3) AS error,
  'TryMap: unknown column "nothing"' AS unknown FROM events""")
def try_steps(spark, sf_dir):
    """try_map and try_transform, good and failing."""
    t = _events(spark, sf_dir, "event_type", "user_id")
    good = t.try_transform(lambda r: {"event_type": r["event_type"].upper()}).unwrap().try_map("user_id", lambda c: str(int(c) + 1)).unwrap()
    failed, unknown = t.try_transform(_strict), t.try_map("nothing", str.upper)
    return _out(good.add_col("error", F.lit(str(failed.error))).add_col("unknown", F.lit(str(unknown.error))), event_id="bigint", user_id="bigint")


@query("""
SELECT event_id, json_extract_string(props, '$.k') AS props, '{"key":' || json_extract_string(props, '$.k') || '}' AS rebuilt, true AS failed, true AS refused FROM events""")
def try_map_json(spark, sf_dir):
    t = _events(spark, sf_dir, "props").add_col("rebuilt", F.col("props"))
    good = t.try_map_json("props", ".k").unwrap().try_map_json("rebuilt", mapping={"key": ".k"}).unwrap()
    broken = t.map_expr("props", lambda c: F.when(F.col("event_id").cast("bigint") % 10 == 3, "no json").otherwise(c)).try_map_json("props", ".k")
    return _out(good, event_id="bigint").withColumns({"failed": F.lit(broken.is_err()), "refused": F.lit(t.try_map_json("props", ".a[").is_err())})


@query("""
WITH b AS (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS place FROM events)
SELECT event_id, place AS row, 'bad ' || CAST(event_id AS VARCHAR) AS error, 'TryTransform' AS step, 'events' AS source, (SELECT CAST(count(*) AS BIGINT) FROM b WHERE event_id % 10 = 3) AS n, true AS some,
  (SELECT min(place) FROM b WHERE event_id % 10 = 3) AS earliest, (SELECT CAST(count(*) AS BIGINT) FROM b WHERE event_id % 10 <> 3) AS kept FROM b WHERE event_id % 10 = 3""")
def pipeline_reject_log(spark, sf_dir):
    """The rejected rows of a pipeline's try_transform, and the log's own numbers."""
    log = ErrorLog()
    good = from_table(_events(spark, sf_dir, "event_type").with_source("events")).with_error_log(log).try_transform(_strict).unwrap()
    bad = log.to_table().rename_many({"_row": "row", "_error": "error", "_step": "step", "_source": "source"}).drop("event_type")
    first = log.entries()[0].row if log.has_errors() else -1
    return _out(bad, event_id="bigint", row="bigint").withColumns({"n": F.lit(log.len()).cast("bigint"), "some": F.lit(log.has_errors()), "earliest": F.lit(first).cast("bigint"), "kept": F.lit(good.len()).cast("bigint")})


# -- pipelines ------------------------------------------------------------------------------------


def _orders(spark, sf_dir) -> Table:
    return _table(spark, sf_dir, "orders", "o_orderkey", "o_orderkey", "o_orderstatus", "o_orderpriority")


def _tagged(name: str):
    return step.add_col("branch", F.lit(name))


@query("""
SELECT branch, CAST(count(*) AS BIGINT) AS n, CAST(sum(o_orderkey) AS BIGINT) AS total FROM (
  SELECT 'then_err' AS branch, o_orderkey FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 'recovered', o_orderkey FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT 'AssertColumns: unknown column "nothing"', o_orderkey FROM orders
  UNION ALL SELECT 'if_then_err', o_orderkey FROM orders UNION ALL SELECT 'wrapped', o_orderkey FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT 'empty', o_orderkey FROM orders) GROUP BY 1""")
def pipeline_control(spark, sf_dir):
    """then_err, if_then_err, recover_with, on_error, map_err, assert_no_empty, concat_with, result, is_ok and is_err."""
    t = _orders(spark, sf_dir)
    only = lambda v: t.where(predicates.eq("o_orderstatus", v))
    base, bad = from_table(t), from_result(Ok(t)).assert_columns("nothing")
    flows = [
        base.then_err(lambda x: Ok(x.where(predicates.eq("o_orderstatus", "F")))).then(_tagged("then_err")),
        bad.recover_with(only("P")).then(_tagged("recovered")),
        bad.on_error(lambda e: t.add_col("branch", F.lit(str(e)))),
        base.if_then_err(bad.is_err(), lambda x: Ok(x.add_col("branch", F.lit("if_then_err")))).if_then_err(False, lambda x: Err(ValueError("not reached"))),
        bad.map_err(lambda e: ValueError("wrapped")).on_error(lambda e: only("O").add_col("branch", F.lit(str(e)))),
        from_table(t.map_expr("o_orderstatus", lambda c: F.when(c == "P", "").otherwise(c))).assert_no_empty().recover_with(t).then(_tagged("empty")),
    ]
    out = flows[0]
    for f in flows[1:]:
        out = out.concat_with(f)
    if out.is_err() or not out.result().is_ok() or concat_pipelines(base, bad).is_ok():
        raise AssertionError("a pipeline lost its state")
    return _out(out.then(step.group_by_agg(["branch"], [("n", Count("o_orderkey")), ("total", Sum("o_orderkey"))])).unwrap(), n="bigint", total="bigint")


@query("""
SELECT 'group' AS kind, o_orderstatus AS name, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'side', CASE WHEN o_orderstatus = 'F' THEN 'in' ELSE 'out' END, CAST(count(*) AS BIGINT) FROM orders GROUP BY 2
UNION ALL SELECT 'chunk', CAST((n_nationkey // 10) AS VARCHAR), CAST(count(*) AS BIGINT) FROM nation GROUP BY 2 UNION ALL SELECT 'table', o_orderpriority, CAST(count(*) AS BIGINT) FROM orders GROUP BY 2
UNION ALL SELECT 'peek', 'rows', CAST(count(*) AS BIGINT) FROM orders""")
def pipeline_groups(spark, sf_dir):
    """group_by, partition, chunk and peek of a pipeline, group_by of a table."""
    t, seen = _orders(spark, sf_dir), []
    flow = from_table(t).peek(lambda x: seen.append(x.len()))
    inside, outside = flow.partition(predicates.eq("o_orderstatus", "F"))
    nation = from_table(_table(spark, sf_dir, "nation", "n_nationkey", "n_nationkey", "n_name"))
    rows = [("group", k, p.unwrap().len()) for k, p in flow.group_by("o_orderstatus").items()]
    rows += [("side", "in", inside.unwrap().len()), ("side", "out", outside.unwrap().len())]
    rows += [("chunk", str(i), p.unwrap().len()) for i, p in enumerate(nation.chunk(10))]
    rows += [("table", k, x.len()) for k, x in t.group_by("o_orderpriority").items()] + [("peek", "rows", n) for n in seen]
    return spark.createDataFrame(rows, "kind string, name string, n long")


@query("""
SELECT o_orderkey, lower(o_orderpriority) AS p, 'F' AS state, (SELECT CAST(count(*) AS BIGINT) FROM orders) AS before, (SELECT CAST(count(*) AS BIGINT) FROM orders WHERE o_orderstatus = 'F') AS after, 'done' AS name FROM orders WHERE o_orderstatus = 'F'""")
def pipeline_transforms(spark, sf_dir):
    """Transform and apply under tracing, compose for tables and mutable tables, from_mutable and frozen."""
    done = Transform("done", lambda p: p.then(step.where(predicates.eq("o_orderstatus", "F"))))
    flow = from_table(_orders(spark, sf_dir)).with_tracing().apply(done)
    record = flow.trace()[0]
    lower = compose(step.map_expr("o_orderpriority", F.lower), step.rename("o_orderpriority", "p"))
    named = compose(step.rename("o_orderstatus", "state"), step.sort("p"))
    out = from_mutable(MutableTable(flow.then(lower).unwrap())).then(named).frozen().unwrap()
    return _out(out, o_orderkey="bigint").withColumns({"before": F.lit(record.input_rows).cast("bigint"), "after": F.lit(record.output_rows).cast("bigint"), "name": F.lit(record.name)})


@query("""
SELECT event_id, upper(event_type) AS kind, user_id AS who, lag(event_id) OVER (ORDER BY event_id DESC) AS later, CASE WHEN user_id >= 50 THEN 'high' ELSE 'low' END AS half, row_number() OVER (ORDER BY event_id DESC) - 1 AS place
FROM events WHERE event_type <> 'click'""")
def step_factories(spark, sf_dir):
    """A chain made of step factories only."""
    from .table import BinDef

    steps = [
        step.where(predicates.ne("event_type", "click")), step.map_expr("event_type", F.upper), step.rename("event_type", "kind"), step.add_col_int("who", F.col("user_id").cast("bigint")), step.sort_multi(desc("n")),
        step.lag("event_id", "later", 1), step.bin("user_id", "half", [BinDef(50, "low"), BinDef(float("inf"), "high")]), step.add_row_index("place"), step.drop("user_id", "n"), step.fill_empty("kind", "none"), step.with_source("events"),
    ]
    t = _events(spark, sf_dir, "event_type", "user_id").add_col("n", F.lpad(F.col("event_id"), 18, "0"))
    return _out(compose(*steps)(t), event_id="bigint", who="bigint", later="bigint", place="bigint")


# -- states and small tables ----------------------------------------------------------------------


@query("""
SELECT CAST(count(*) AS BIGINT) AS n, CAST(3 AS BIGINT) AS width, CAST(1 AS BIGINT) AS place, CAST(-1 AS BIGINT) AS nowhere, 'orders' AS source, CAST(2 AS BIGINT) AS errors, '[orders] Select: unknown column "a"' AS message, true AS has, CAST(2 AS BIGINT) AS copied,
  'AssertColumns: unknown column "b"' AS asserted, '' AS fine FROM orders""")
def table_state(spark, sf_dir):
    """errs, has_errs, with_source, source, col_index, len, shape, copy_errs_from, assert_columns, freeze and headers."""
    t = _orders(spark, sf_dir).with_source("orders").select("a", "o_orderkey", "o_orderstatus", "o_orderpriority").rename("x", "y").freeze()
    other = _orders(spark, sf_dir).copy_errs_from(t)
    n, width = t.shape()
    if n != t.len() or width != len(t.headers) or _orders(spark, sf_dir).has_errs():
        raise AssertionError("shape, len and headers differ")
    return _facts(
        spark, n=n, width=width, place=t.col_index("o_orderstatus"), nowhere=t.col_index("nothing"), source=t.source(), errors=len(t.errs()), message=str(t.errs()[0]), has=t.has_errs(), copied=len(other.errs()),
        asserted=str(t.assert_columns("b")), fine="" if t.assert_columns("o_orderkey") is None else "failed",
    )


@query("""
SELECT n_nationkey, lower(n_name) AS lowered, n_nationkey * 2 AS twice, row_number() OVER (ORDER BY n_nationkey) - 1 AS seen, (SELECT n_name FROM nation ORDER BY n_nationkey LIMIT 1 OFFSET 3) AS fourth,
  CAST((SELECT count(*) FROM nation WHERE n_nationkey % 2 = 1) AS BIGINT) AS odd FROM nation""")
def column_values(spark, sf_dir):
    """col, col_as, map_col_to, for_each, row and rows: what a driver program reads of a small table."""
    t, seen = _table(spark, sf_dir, "nation", "n_nationkey", "n_nationkey", "n_name"), {}
    t.for_each(lambda i, r: seen.setdefault(r["n_nationkey"], i))

    def odd(cell: str) -> int:
        if int(cell) % 2 == 0:
            raise ValueError(cell)
        return int(cell)

    rows = zip(t.col_as("n_nationkey", int), t.map_col_to("n_name", str.lower), [int(r["n_nationkey"]) * 2 for r in t.rows()], [seen[c] for c in t.col("n_nationkey")], strict=True)
    made = [(*r, t.row(3).get("n_name"), len(t.col_as("n_nationkey", odd))) for r in rows]
    return spark.createDataFrame(made, "n_nationkey int, lowered string, twice int, seen long, fourth string, odd long")


@query("""
SELECT CAST(r_regionkey AS VARCHAR) AS a, r_name AS a_2, '' AS b, 'new' AS made FROM region UNION ALL SELECT CAST(r_regionkey AS VARCHAR), r_name, '', 'rows' FROM region UNION ALL SELECT CAST(r_regionkey AS VARCHAR), upper(r_name), '', 'mutable' FROM region""")
def tables_from_records(spark, sf_dir):
    """new, new_from_rows, new_mutable and Row: names made unique, short records padded, long ones cut."""
    records = _table(spark, sf_dir, "region", "r_regionkey").records()
    names = ["a", "a", "b"]
    tables = [new(names, records), new_from_rows(names, [Row(["x", "y", "z", "over"], [*r, "", "cut"]) for r in records]), new_mutable(names, records).map_expr("a_2", F.upper).freeze()]
    return _out(concat(*(t.add_col("made", F.lit(m)) for t, m in zip(tables, ("new", "rows", "mutable"), strict=True))))


@query("""
SELECT n_nationkey, CASE WHEN n_nationkey = 2 THEN 'changed' ELSE lower(n_name) END AS name, 'in place' AS kind, CAST(2 AS BIGINT) AS errors, CAST(0 AS BIGINT) AS reset FROM nation
UNION ALL SELECT 99, 'added', 'in place', 2, 0 UNION ALL SELECT n_nationkey, n_name, 'view', 2, 0 FROM nation UNION ALL SELECT n_nationkey, lower(n_name), 'appended', 2, 0 FROM nation""")
def mutable_tables(spark, sf_dir):
    """A table changed in place: operators, set, append_row, append_mutable, errors, views and frozen copies."""
    base = _table(spark, sf_dir, "nation", "n_nationkey", "n_nationkey", "n_name").rename("n_name", "name")
    m = base.thaw()
    view = m.freeze_view()
    m.map_expr("name", F.lower).add_col("kind", F.lit("in place"))
    lowered = m.table()
    m.set(2, "name", "changed").append_row(["99", "added", "in place"])
    m.set(0, "nothing", "x").assert_columns("nothing")
    errors = len(m.errs())
    m.reset_errs()
    if base.headers != ["n_nationkey", "name"] or m.headers != ["n_nationkey", "name", "kind"] or m.row(2).get("name") != "changed":
        raise AssertionError("the copies share their state")
    m.append_mutable(view.add_col("kind", F.lit("view")).thaw()).append(lowered.drop("kind").add_col("kind", F.lit("appended")))
    return _out(m.freeze(), n_nationkey="int").withColumns({"errors": F.lit(errors).cast("bigint"), "reset": F.lit(len(m.errs())).cast("bigint")})


@query("""
SELECT CAST(100 AS BIGINT) AS n, CAST(100 AS BIGINT) AS different, CAST(100 AS BIGINT) AS known, CAST(floor(count(*) * 0.25) AS BIGINT) AS quarter, CAST(floor(count(*) * 0.25) AS BIGINT) AS quarter_known, true AS again, CAST(count(*) AS BIGINT) AS whole FROM events""")
def samples(spark, sf_dir):
    """sample and sample_frac: so many rows, all of the table's, none twice; a seed gives the same rows again."""
    t = _events(spark, sf_dir, "event_type")
    ids = lambda x: [r[0] for r in x._df.select("event_id").collect()]
    known = lambda x: x._df.join(t._df.select("event_id"), "event_id", "left_semi").count()
    drawn, part = t.sample(100, seed=7), materialised(t.sample_frac(0.25, seed=3))
    found = ids(drawn)
    return _facts(
        spark, n=len(found), different=len(set(found)), known=known(drawn), quarter=part._df.distinct().count(), quarter_known=known(part), again=sorted(ids(t.sample(100, seed=7))) == sorted(found), whole=t.sample(1 << 40).len(),
    )


def materialised(t: Table) -> Table:
    return Table(materialise(t._df), stable=True)


@query("""
SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'true' END AS flag, c_acctbal, 'BOOL' AS was, 'STRING' AS other, 'INT' AS now, true AS refused,
  (SELECT 'column "flag" row ' || CAST(min(place) AS VARCHAR) || ': cannot parse "" as bool' FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS place FROM customer) WHERE c_custkey % 3 = 0) AS strict FROM customer""")
def schema_steps(spark, sf_dir):
    """Schema.col, cast and apply, and a pipeline's apply_schema and apply_schema_strict."""
    df = _t(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, "").otherwise(" YES ").alias("flag"), "c_acctbal")
    t = from_frame(df, "c_custkey")
    schema = S.Schema({"flag": S.ColType.BOOL, "c_acctbal": S.ColType.FLOAT})
    wide = schema.cast("c_custkey", S.ColType.INT)
    good = from_table(schema.apply(t).unwrap()).apply_schema(wide).unwrap()
    refused, strict = schema.cast("flag", S.ColType.DATE).apply(t), from_table(t).apply_schema_strict(wide)
    out = {"was": F.lit(schema.col("flag").name), "other": F.lit(schema.col("c_custkey").name), "now": F.lit(wide.col("c_custkey").name), "refused": F.lit(refused.is_err()), "strict": F.lit(str(strict.result().error))}
    return _out(good, c_custkey="bigint", c_acctbal="double").withColumns(out).withColumn("flag", F.coalesce("flag", F.lit("")))


# -- the row order --------------------------------------------------------------------------------


def _numbered(t: Table, name: str) -> Table:
    return t.add_row_index("place").add_col("kind", F.lit(name))


@query("""
WITH c AS (SELECT c_custkey, c_nationkey FROM customer), n AS (SELECT CASE WHEN n_nationkey < 5 THEN n_nationkey + 100 ELSE n_nationkey END AS k, n_name, n_nationkey FROM nation)
SELECT 'inner' AS kind, row_number() OVER (ORDER BY c_custkey) - 1 AS place, c_custkey, n_name FROM c JOIN n ON c_nationkey = k
UNION ALL SELECT 'left', row_number() OVER (ORDER BY c_custkey) - 1, c_custkey, coalesce(n_name, '') FROM c LEFT JOIN n ON c_nationkey = k
UNION ALL SELECT 'right', row_number() OVER (ORDER BY n_nationkey, c_custkey) - 1, c_custkey, n_name FROM c RIGHT JOIN n ON c_nationkey = k
UNION ALL SELECT 'outer', row_number() OVER (ORDER BY c_custkey IS NULL, c_custkey, n_nationkey) - 1, c_custkey, coalesce(n_name, '') FROM c FULL JOIN n ON c_nationkey = k
UNION ALL SELECT 'anti', row_number() OVER (ORDER BY c_custkey) - 1, c_custkey, '' FROM c WHERE c_nationkey NOT IN (SELECT k FROM n)""")
def order_of_joins(spark, sf_dir):
    people = _table(spark, sf_dir, "customer", "c_custkey", "c_custkey", "c_nationkey")
    key = F.when(F.col("n_nationkey") < 5, F.col("n_nationkey") + 100).otherwise(F.col("n_nationkey"))
    nation = from_frame(_t(spark, sf_dir, "nation").select(key.alias("k"), "n_name", "n_nationkey"), "n_nationkey").drop("n_nationkey")
    joins = {"inner": people.join, "left": people.left_join, "right": people.right_join, "outer": people.outer_join}
    made = [_numbered(join(nation, "c_nationkey", "k"), name) for name, join in joins.items()]
    made.append(_numbered(people.anti_join(nation, "c_nationkey", "k").add_col("n_name", F.lit("")), "anti"))
    out = concat(*(t.select("kind", "place", "c_custkey", "n_name") for t in made))
    return _out(out, place="bigint", c_custkey="bigint").withColumn("n_name", F.coalesce("n_name", F.lit("")))


@query("""
WITH g AS (SELECT o_orderpriority AS p, o_orderstatus AS s, count(*) AS n, min(o_orderkey) AS o, max(o_orderkey) AS z FROM orders GROUP BY 1, 2), v AS (SELECT o_orderpriority AS p, count(*) AS n, min(o_orderkey) AS o FROM orders GROUP BY 1)
SELECT 'group' AS kind, row_number() OVER (ORDER BY o) - 1 AS place, p || '/' || s AS name, CAST(n AS BIGINT) AS n, o AS opening, z AS closing FROM g
UNION ALL SELECT 'distinct', row_number() OVER (ORDER BY o) - 1, p || '/' || s, 1, o, o FROM g
UNION ALL SELECT 'count', row_number() OVER (ORDER BY n DESC, o) - 1, p, n, 0, 0 FROM v
UNION ALL SELECT 'sort', row_number() OVER (ORDER BY o_orderpriority DESC, o_orderkey) - 1, o_orderpriority, 1, o_orderkey, 0 FROM orders
UNION ALL SELECT 'tail', row_number() OVER (ORDER BY o_orderkey) - 1, o_orderpriority, 1, o_orderkey, 0 FROM (SELECT * FROM orders ORDER BY o_orderkey DESC LIMIT 9)""")
def order_of_groups(spark, sf_dir):
    t = _orders(spark, sf_dir)
    both = F.concat_ws("/", "o_orderpriority", "o_orderstatus")
    grouped = t.group_by_agg(["o_orderpriority", "o_orderstatus"], [("n", Count("o_orderkey")), ("opening", First("o_orderkey")), ("closing", Last("o_orderkey"))]).add_col("name", both)
    one = {"n": "1", "closing": "0"}

    def named(x: Table, name, **cells) -> Table:
        x = x.add_col("name", name)
        for k, v in cells.items():
            x = x.add_col(k, F.lit(v) if isinstance(v, str) else v)
        return x

    made = {
        "group": grouped, "distinct": named(t.distinct("o_orderpriority", "o_orderstatus"), both, n="1", opening=F.col("o_orderkey"), closing=F.col("o_orderkey")),
        "count": t.value_counts("o_orderpriority").rename_many({"value": "name", "count": "n"}).add_col("opening", F.lit("0")).add_col("closing", F.lit("0")),
        "sort": named(t.sort("o_orderpriority", False), F.col("o_orderpriority"), opening=F.col("o_orderkey"), **one), "tail": named(t.tail(9), F.col("o_orderpriority"), opening=F.col("o_orderkey"), **one),
    }
    out = concat(*(_numbered(x, k).select("kind", "place", "name", "n", "opening", "closing") for k, x in made.items()))
    return _out(out, place="bigint", n="bigint", opening="bigint", closing="bigint")


# -- JSON -----------------------------------------------------------------------------------------


@query("""
SELECT event_id, json_extract_string(props, '$.k') AS "p/in/k", CAST(user_id AS VARCHAR) AS "p/in/deep", event_type AS "p/a", CAST(user_id AS VARCHAR) AS "q.in.deep", json_extract_string(props, '$.k') AS "q.in.k", '{"b":1}' AS "q.in.at", event_type AS "q.a" FROM events""")
def expand_json_options(spark, sf_dir):
    """expand_json flattened with a separator and sorted headers, and to a depth: what lies below stays JSON."""
    cell = lambda more: F.concat(F.lit('{"in":{"k":'), F.get_json_object("props", "$.k"), F.lit(',"deep":'), F.col("user_id"), F.lit(more + '},"a":"'), F.col("event_type"), F.lit('"}'))
    t = from_frame(_t(spark, sf_dir, "events").select("event_id", cell("").alias("p"), cell(',"at":{"b":1}').alias("q")), "event_id")
    t = t.expand_json("p", JSONOptions(flatten=True, separator="/", sorted_headers=True)).expand_json("q", JSONOptions(flatten=True, max_depth=1))
    if t.headers != ["event_id", "p/a", "p/in/deep", "p/in/k", "q.in.k", "q.in.deep", "q.in.at", "q.a"]:
        raise AssertionError(f"headers {t.headers}")
    return _out(t, event_id="bigint")


@query("""
SELECT CAST(n_nationkey AS VARCHAR) AS id, n_name AS name, kind FROM nation CROSS JOIN (VALUES ('flat'), ('mapped'), ('sorted'), ('pretty'), ('string'), ('bytes'), ('handle')) t(kind)""")
def json_options(spark, sf_dir):
    """JSON read flattened, mapped, with sorted headers, from a string, bytes and a handle; written indented and to a handle."""
    from .sources.jsonfiles import JSONReader, JSONWriter, to_string

    nation = _table(spark, sf_dir, "nation", "n_nationkey", "n_nationkey", "n_name").rename_many({"n_nationkey": "id", "n_name": "name"})
    at, file = _at(spark, "json"), _at(spark, "json") + ".json"
    nested = F.to_json(F.struct(F.struct(F.col("id"), F.struct(F.col("name")).alias("in")).alias("at")))
    nation._df.orderBy("__ord").select(nested).write.text(at)
    JSONWriter(indent="  ").write_file(file, nation)
    text, out = to_string(nation), io.StringIO()
    JSONWriter(ndjson=True).write(out, nation)
    lines = out.getvalue()
    made = {
        "flat": JSONReader(ndjson=True, flatten=True, separator="_").read_file(at, lines=True).unwrap().rename_many({"at_id": "id", "at_in_name": "name"}),
        "mapped": JSONReader(ndjson=True, mapping={"name": ".at.in.name", "id": ".at.id"}).read_file(at, lines=True).unwrap(),
        "sorted": JSONReader(ndjson=True, sorted_headers=True).read_string(lines).unwrap(), "pretty": JSONReader().read_file(file).unwrap(), "string": JSONReader().read_string(text).unwrap(),
        "bytes": JSONReader().read_bytes(text.encode()).unwrap(), "handle": JSONReader(ndjson=True).read(io.StringIO(lines)).unwrap(),
    }
    deep = JSONReader(ndjson=True, flatten=True, max_depth=1).read_file(at, lines=True).unwrap()
    if made["sorted"].headers != ["id", "name"] or deep.headers != ["at.id", "at.in"]:
        raise AssertionError(f"headers {made['sorted'].headers}, {deep.headers}")
    return _out(concat(*(t.select("id", "name").add_col("kind", F.lit(k)) for k, t in made.items())))


# -- CSV and workbooks ----------------------------------------------------------------------------


@query("""
SELECT CAST(n_nationkey AS VARCHAR) AS id, n_name AS name, kind FROM nation CROSS JOIN (VALUES ('named'), ('plain'), ('string'), ('stream'), ('handle'), ('handle stream')) t(kind)""")
def csv_options(spark, sf_dir):
    """CSV without a header, with given names, from strings, handles and in chunks; written to a file, a handle and a string."""
    from .sources.delimited import CSVReader, CSVWriter, to_string

    nation = _table(spark, sf_dir, "nation", "n_nationkey", "n_nationkey", "n_name").rename_many({"n_nationkey": "id", "n_name": "name"})
    bare, full = _at(spark, "csv") + ".csv", _at(spark, "csv") + ".csv"
    CSVWriter(header=False).write_file(bare, nation)
    CSVWriter(separator="\t").write_file(full, nation)
    text, out = to_string(nation), io.StringIO()
    CSVWriter(separator="|").write(out, nation)
    made = {
        "named": CSVReader().with_header_names("id", "name").read_file(bare).unwrap(), "plain": CSVReader(header=False).read_file(bare).unwrap().rename_many({"col_0": "id", "col_1": "name"}),
        "string": CSVReader().read_string(text).unwrap(), "stream": concat(*CSVReader(separator="\t").read_file_stream(full, 10)), "handle": CSVReader(separator="|").read(io.StringIO(out.getvalue())).unwrap(),
        "handle stream": concat(*CSVReader().read_stream(io.StringIO(text), 7)),
    }
    return _out(concat(*(t.select("id", "name").add_col("kind", F.lit(k)) for k, t in made.items())))


def workbook(sheets: dict[str, list[list[str]]]) -> bytes:
    """A workbook of text cells."""
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    safe = lambda c: c.replace("&", "&amp;").replace("<", "&lt;")
    cell = lambda c: f'<c t="inlineStr"><is><t>{safe(c)}</t></is></c>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        names = "".join(f'<sheet name="{safe(n)}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(sheets, 1))
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>{names}</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="r{i}" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1)) + "</Relationships>")
        for i, rows in enumerate(sheets.values(), 1):
            body = "".join(f'<row r="{k}">{"".join(map(cell, r))}</row>' for k, r in enumerate(rows, 1))
            z.writestr(f"xl/worksheets/sheet{i}.xml", f'<worksheet xmlns="{main}"><sheetData>{body}</sheetData></worksheet>')
    return out.getvalue()


@query("""
SELECT CAST(n_nationkey AS VARCHAR) AS id, n_name AS name, kind, 'nation,region' AS sheets, true AS refused FROM nation CROSS JOIN (VALUES ('first'), ('names'), ('bare'), ('bytes'), ('stream'), ('handle stream')) t(kind)
UNION ALL SELECT CAST(r_regionkey AS VARCHAR), r_name, kind, 'nation,region', true FROM region CROSS JOIN (VALUES ('sheet'), ('index')) t(kind)""")
def excel_options(spark, sf_dir):
    """Sheets by name and index, with and without headers, as a stream, from a path, bytes and a handle."""
    from .sources.workbook import ExcelReader, sheet_names

    nation, region = (_table(spark, sf_dir, n, k, k, v).records() for n, k, v in (("nation", "n_nationkey", "n_name"), ("region", "r_regionkey", "r_name")))
    data = workbook({"nation": [["id", "name"], *nation], "region": [["id", "name"], *region]})
    at = _at(spark, "book") + ".xlsx"
    with open_output(at) as f:
        f.write(data)
    bare = ExcelReader(header=False).read_file(at).unwrap().rename_many({"col_0": "id", "col_1": "name"}).where(predicates.ne("id", "id"))
    made = {
        "first": ExcelReader().read_file(at).unwrap(), "names": ExcelReader(names=("id", "name")).read_file(at).unwrap().where(predicates.ne("id", "id")), "bare": bare, "bytes": ExcelReader().read_bytes(data).unwrap(),
        "stream": concat(*ExcelReader().read_file_stream(at, 10)), "handle stream": concat(*ExcelReader().read_stream(io.BytesIO(data), 10)), "sheet": ExcelReader(sheet="region").read_file(at).unwrap(), "index": ExcelReader(sheet_index=1).read(io.BytesIO(data)).unwrap(),
    }
    sheets = ",".join(sheet_names(at))
    refused = ExcelReader(sheet="nothing").read_file(at).is_err() and sheet_names(data) == sheet_names(at) == sheet_names(io.BytesIO(data))
    out = _out(concat(*(t.select("id", "name").add_col("kind", F.lit(k)) for k, t in made.items())))
    return out.withColumns({"sheets": F.lit(sheets), "refused": F.lit(refused)})


# -- streaming ------------------------------------------------------------------------------------


@query("SELECT event_type, CAST(count(*) AS BIGINT) AS n, CAST(sum(event_id) AS BIGINT) AS total FROM events WHERE event_type <> 'click' GROUP BY 1")
def stream_batches(spark, sf_dir):
    """Each micro-batch of a file stream goes through a table step into the shared folder."""
    from .streaming.chunks import file_stream, for_each_batch

    schema = ", ".join(f"{n} {k}" for n, k in _t(spark, sf_dir, "events").dtypes)
    at = _at(spark, "stream")
    stream = file_stream(f"{sf_dir}/events.parquet*", schema).select("event_id", "event_type")
    for_each_batch(stream, step.where(predicates.ne("event_type", "click")), lambda t, i: t.df.write.mode("overwrite").parquet(f"{at}/batch={i}"), at + "-checkpoint", "event_id").awaitTermination()
    done = from_frame(spark.read.parquet(at).select(F.col("event_id").cast("bigint"), "event_type"), "event_id")
    return _out(done.group_by_agg(["event_type"], [("n", Count("event_id")), ("total", Sum("event_id"))]), n="bigint", total="bigint")


@query("SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS opens, event_type, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1, 2")
def stream_windows(spark, sf_dir):
    """Rows an hour and kind over a file stream."""
    from .streaming.chunks import file_stream, windowed_counts

    schema = ", ".join(f"{n} {k}" for n, k in _t(spark, sf_dir, "events").dtypes)
    at = _at(spark, "stream")
    stream = file_stream(f"{sf_dir}/events.parquet*", schema).withColumn("ts", F.col("ts").cast("timestamp"))
    counts = windowed_counts(stream, "ts", "event_type", "1 hour", "0 seconds")
    flow = counts.writeStream.outputMode("complete").foreachBatch(lambda df, i: df.write.mode("overwrite").parquet(f"{at}/batch={i}")).option("checkpointLocation", at + "-checkpoint").trigger(availableNow=True).start()
    flow.awaitTermination()
    rows = spark.read.parquet(at)
    last = rows.agg(F.max("batch")).first()[0]
    return rows.filter(F.col("batch") == last).select(F.date_format("window.start", "yyyy-MM-dd HH").alias("opens"), "event_type", "n")
