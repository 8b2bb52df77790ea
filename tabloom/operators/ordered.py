"""Operators over the row order of a whole table, without a single task for it.

A table's order is a column of unique long numbers.  Every operator cuts that order
into slices, works within them, and carries what crosses a border (a count, a sum,
the last value, or some rows) through a table with one row a slice.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialise

#: Numbers of the order in one slice, as a power of two.
SLICE = 16


#: Slices in one group of slices, as a power of two; groups are as few as 1 in 2 ** 28 rows.
GROUP = 12


def _before(slices: DataFrame, by: str, sums: dict[str, str] | None = None, lasts: dict[str, str] | None = None) -> DataFrame:
    """by, and for each slice the sum (the last value that isn't null) of a column over all slices before it; new name: column.

    Slices are taken in groups, and what crosses a group's border comes from a table with one row a group."""
    sums, lasts = sums or {}, lasts or {}
    cut = slices.withColumn("__g", F.shiftright(F.col(by), GROUP))
    ends = [F.sum(c).alias(n) for n, c in sums.items()] + [F.max_by(c, F.when(F.col(c).isNotNull(), F.col(by))).alias(n) for n, c in lasts.items()]
    w = Window.orderBy("__g").rowsBetween(Window.unboundedPreceding, -1)
    groups = cut.groupBy("__g").agg(*ends)
    groups = groups.select("__g", *(F.sum(n).over(w).alias(f"__u_{n}") for n in sums), *(F.last(n, ignorenulls=True).over(w).alias(f"__u_{n}") for n in lasts))
    w = Window.partitionBy("__g").orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    cut = cut.select(by, "__g", *(F.sum(c).over(w).alias(n) for n, c in sums.items()), *(F.last(c, ignorenulls=True).over(w).alias(n) for n, c in lasts.items()))
    both = cut.join(groups, "__g")
    zero = lambda c: F.coalesce(c, F.lit(0))
    made = [F.when(F.col(n).isNull() & F.col(f"__u_{n}").isNull(), None).otherwise(zero(F.col(n)) + zero(F.col(f"__u_{n}"))).alias(n) for n in sums]
    return both.select(by, *made, *(F.coalesce(n, f"__u_{n}").alias(n) for n in lasts))


def dense_index(df: DataFrame, order: str, out: str = "__i") -> DataFrame:
    """df with out: 0, 1, 2, ... in the order of a unique long column."""
    cut = df.withColumn("__s", F.shiftright(F.col(order), SLICE))
    sizes = _before(cut.groupBy("__s").agg(F.count("*").alias("n")), "__s", {"__before": "n"})
    own = F.row_number().over(Window.partitionBy("__s").orderBy(order)) - 1
    return cut.withColumn(out, own).join(sizes, "__s").withColumn(out, F.col(out) + F.coalesce("__before", F.lit(0))).drop("__s", "__before")


def over_rows(df: DataFrame, index: str, behind: int, ahead: int, cols) -> DataFrame:
    """df with columns over frames that reach so many rows behind and ahead.

    cols takes the window (partitioned and ordered) and gives {name: Column}.  Each
    slice of the dense index gets the rows just beyond its borders as well."""
    width = max(1 << SLICE, behind + ahead, 1)
    home = F.floor(F.col(index) / width).cast("long")
    place = F.pmod(F.col(index), F.lit(width))
    also = F.array(home, *([F.when(place >= width - behind, home + 1)] if behind else []), *([F.when(place < ahead, home - 1)] if ahead else []))
    spread = df.withColumn("__home", home).withColumn("__s", F.explode(F.filter(also, lambda x: x.isNotNull())) if behind or ahead else home)
    w = Window.partitionBy("__s").orderBy(index)
    made = spread.select("*", *(c.alias(n) for n, c in cols(w).items()))
    return made.filter(F.col("__home") == F.col("__s")).drop("__home", "__s")


def running_sums(df: DataFrame, order: str, cols: dict[str, Column]) -> DataFrame:
    """df with the running sum of each column (nulls count as nothing) in the order of a unique long column."""
    cut = df.withColumn("__s", F.shiftright(F.col(order), SLICE)).withColumns({f"__x_{n}": c for n, c in cols.items()})
    sums = cut.groupBy("__s").agg(*(F.sum(f"__x_{n}").alias(f"__t_{n}") for n in cols))
    before = _before(sums, "__s", {f"__b_{n}": f"__t_{n}" for n in cols})
    w = Window.partitionBy("__s").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    cut = cut.select("*", *(F.sum(f"__x_{n}").over(w).alias(f"__o_{n}") for n in cols)).join(before, "__s")
    zero = lambda c: F.coalesce(c, F.lit(0))
    cut = cut.withColumns({n: zero(F.col(f"__o_{n}")) + zero(F.col(f"__b_{n}")) for n in cols})
    return cut.drop("__s", *(f"__{k}_{n}" for k in "xob" for n in cols))


def fill(df: DataFrame, order: str, value: Column, out: str, forward: bool = True) -> DataFrame:
    """df with out: value, or where it is null the last one before (the next one after)."""
    way = F.col(order) if forward else -F.col(order)
    cut = df.withColumn("__x", value).withColumn("__w", way).withColumn("__s", F.shiftright("__w", SLICE))
    ends = cut.filter(F.col("__x").isNotNull()).groupBy("__s").agg(F.max_by("__x", "__w").alias("v"))
    slices = cut.select("__s").distinct().join(ends, "__s", "left")
    carried = _before(slices, "__s", lasts={"__c": "v"})
    w = Window.partitionBy("__s").orderBy("__w").rowsBetween(Window.unboundedPreceding, 0)
    cut = cut.withColumn("__y", F.last("__x", ignorenulls=True).over(w)).join(carried, "__s")
    return cut.withColumn(out, F.coalesce("__y", "__c")).drop("__x", "__w", "__s", "__y", "__c")


def dense_rank(df: DataFrame, value: str, out: str, ascending: bool = True, rows: int = 500_000) -> DataFrame:
    """df with out: the dense rank of a numeric column, null where it is null.

    Distinct values are dealt by range into cells of about ``rows``, ranked within, and shifted by the counts of the cells before."""
    way = F.col("__v").asc() if ascending else F.col("__v").desc()
    values = materialise(df.select(F.col(value).alias("__v")).filter(F.col("__v").isNotNull()).distinct())
    cells = max(1, -(-values.count() // rows))
    values = materialise(values.repartitionByRange(cells, way).withColumn("__s", F.spark_partition_id().cast("long"))) if cells > 1 else values.withColumn("__s", F.lit(0).cast("long"))
    sizes = _before(values.groupBy("__s").agg(F.count("*").alias("n")), "__s", {"__before": "n"})
    own = F.row_number().over(Window.partitionBy("__s").orderBy(way))
    ranks = values.withColumn("__r", own).join(sizes, "__s").select("__v", (F.col("__r") + F.coalesce("__before", F.lit(0))).alias(out))
    return df.join(ranks, F.col(value) == F.col("__v"), "left").drop("__v")


#: Values about the middle that the driver takes at most.
MIDDLE = 65_536


def _kth(values: DataFrame, places: list[int]) -> list[float]:
    """The values at places (from 0) of a table of values x that stand n times each, in order."""
    cells = max(1, -(-values.count() // MIDDLE))
    cut = materialise(values.repartitionByRange(cells, "x").withColumn("s", F.spark_partition_id()))
    sizes = sorted((r["s"], r["n"]) for r in cut.groupBy("s").agg(F.sum("n").alias("n")).collect())
    out = []
    for place in places:
        for s, n in sizes:
            if place < n:
                break
            place -= n
        w = Window.orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
        one = cut.filter(F.col("s") == s).withColumn("upto", F.sum("n").over(w))
        out.append(one.filter(F.col("upto") > place).orderBy("x").first()["x"])
    return out


def around_middle(c: Column) -> Column:
    """Two values with the middle between them, by a sketch of bounded size."""
    return F.percentile_approx(c, [0.4998, 0.5002], 10_000)


def medians(df: DataFrame, cols: dict[str, Column], known: dict[str, tuple[int, list[float] | None]] | None = None) -> dict[str, float | None]:
    """Exact medians of numeric columns without nulls; known: the count and around_middle of each, where an aggregate has them.

    Only values between the two are counted one by one, a few in ten thousand rows unless they repeat."""
    if known is None:
        row = df.agg(*(x for i, c in enumerate(cols.values()) for x in (F.count(c).alias(f"n{i}"), around_middle(c).alias(f"m{i}")))).first()
        known = {name: (row[f"n{i}"], row[f"m{i}"]) for i, name in enumerate(cols)}
    out: dict[str, float | None] = {name: None for name in cols}
    live = [name for name in cols if known[name][0]]
    if not live:
        return out
    ends = {name: known[name][1] for name in live}
    base = df.select(*(cols[name].cast("double").alias(f"c{i}") for i, name in enumerate(live)))
    inside = F.array(*(F.struct(F.lit(i).alias("i"), F.when((F.col(f"c{i}") >= ends[n][0]) & (F.col(f"c{i}") <= ends[n][1]), F.col(f"c{i}")).alias("x"), F.when(F.col(f"c{i}") < ends[n][0], 1).alias("low")) for i, n in enumerate(live)))
    rows = base.select(F.explode(inside).alias("e")).filter("e.x IS NOT NULL OR e.low IS NOT NULL")
    found = materialise(rows.groupBy("e.i", "e.x").agg(F.count("*").alias("n")))
    low = {r["i"]: r["n"] for r in found.filter("x IS NULL").collect()}
    sizes = {r["i"]: r["n"] for r in found.filter("x IS NOT NULL").groupBy("i").agg(F.count("*").alias("n")).collect()}
    few = {i: [] for i, n in sizes.items() if n <= MIDDLE // len(live)}
    for r in found.filter(F.col("x").isNotNull() & F.col("i").isin(list(few))).collect():  # MIDDLE rows at most
        few[r["i"]].append((r["x"], r["n"]))
    for i, name in enumerate(live):
        n = known[name][0]
        places = [(n - 1) // 2 - low.get(i, 0), n // 2 - low.get(i, 0)]
        if i in few:
            got, upto = [], 0
            for x, k in sorted(few[i], key=lambda r: (r[0] != r[0], r[0])):
                got += [x for p in places if upto <= p < upto + k]
                upto += k
        else:
            got = _kth(found.filter((F.col("i") == i) & F.col("x").isNotNull()).select("x", "n"), places)
        out[name] = (got[0] + got[1]) / 2 if got[0] != got[1] else got[0]
    return out


#: Rows that a draw takes by a limit at most; its one task gets up to as many from each partition.
DRAWN = 1_000


def drawn(df: DataFrame, order: str, by: Column, n: int, total: int) -> DataFrame:
    """The n of total rows with the least numbers by, random ones from 0 to 1 (1 excluded), and those numbers as __u.

    Of many rows, those up to a bound that surely holds n are written; only the numbers about the n-th are ranked."""
    rows = df.withColumn("__u", by)
    if n <= DRAWN:
        return rows.orderBy("__u").limit(n)
    spread = (8 * math.sqrt(n * max(1 - n / total, 0)) + 64) / total
    low = n / total - spread
    for high in (n / total + spread, 1.0):  # all rows, should the first bound hold too few
        held = materialise(rows.filter(F.col("__u") < high))
        below, upto = held.agg(F.count_if(F.col("__u") < low), F.count("*")).first()
        if upto >= n:
            break
    if upto <= n:
        return held
    if below >= n:
        low, below = 0.0, 0
    edge = _kth(held.filter(F.col("__u") >= low).groupBy(F.col("__u").alias("x")).agg(F.count("*").alias("n")), [n - below - 1])[0]
    under, upto = held.agg(F.count_if(F.col("__u") < edge), F.count_if(F.col("__u") <= edge)).first()
    if upto == n:
        return held.filter(F.col("__u") <= edge)
    equal = held.filter(F.col("__u") == edge).orderBy(order).limit(n - under)
    return held.filter(F.col("__u") < edge).unionByName(equal)


def head(df: DataFrame, order: str, n: int) -> DataFrame:
    return df.orderBy(order).limit(max(n, 0))


def tail(df: DataFrame, order: str, n: int) -> DataFrame:
    return df.orderBy(F.col(order).desc()).limit(max(n, 0))
