"""Running totals, positions and quantiles over a global order without one task seeing all rows.

Rows are cut into cells of the ordering value.  Totals of whole cells are few
and get their running sums on their own; inside a cell a window adds the rest.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

#: Cells in each doubling of a value's size, and the powers of two between which sizes have cells of their own.
STEPS, LOW, HIGH = 256, -40, 24
#: Cells on either side of zero.
CELLS = (HIGH - LOW) * STEPS + 1


def local_table(df: DataFrame, most: int = 50_000) -> DataFrame:
    """A small result, computed once and held as literal rows, so that later plans don't run its inputs again.

    For tables bounded by parameters (thresholds, grids, single rows); more than ``most`` rows are an error.
    """
    rows = df.limit(most + 1).toArrow()
    if rows.num_rows > most:
        raise ValueError(f"more than {most} rows")
    return df.sparkSession.createDataFrame(rows, df.schema)


def together(*jobs: Callable[[], object]) -> list:
    """The results of independent small jobs, run at the same time: alone, each would leave most of a cluster idle."""
    inherit = inheritable_thread_target(SparkSession.active())
    with ThreadPoolExecutor(len(jobs)) as pool:
        return [f.result() for f in [pool.submit(inherit(j)) for j in jobs]]


def local_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few given rows, as a relation the optimiser knows the size of."""
    kind = to_arrow_schema(_parse_datatype_string(schema))
    return spark.createDataFrame(pa.Table.from_pylist([dict(zip(kind.names, r, strict=True)) for r in rows], kind))


def score_cell(value) -> Column:
    """Cell of a number, in its order.  Cells are even by size of number, since scores of rare events crowd near 0, and margins and amounts have no bounds."""
    value = F.col(value) if isinstance(value, str) else value
    size = F.floor(F.least(F.greatest(F.log2(F.abs(value)) * STEPS, F.lit(LOW * STEPS - 1.0)), F.lit(float(HIGH * STEPS))))
    return F.when(value == 0, 0).otherwise(F.signum(value) * (size - LOW * STEPS + 1)).cast("int")


def time_cell(dt, seconds: int = 86_400) -> Column:
    return F.floor((F.col(dt) if isinstance(dt, str) else dt) / seconds)


def running(df: DataFrame, cell: Column, order: list[Column], sums: dict[str, Column], descending: bool = False, keys: list[str] | None = None) -> DataFrame:
    """``df`` with columns of inclusive running sums by (cell, order) in each group of ``keys``; ``order`` must agree with the cell."""
    keys = keys or []
    df = df.withColumn("__cell", cell)
    for name, value in sums.items():
        df = df.withColumn(f"__v_{name}", value)
    totals = df.groupBy(*keys, "__cell").agg(*[F.sum(f"__v_{n}").alias(f"__t_{n}") for n in sums])
    by = F.col("__cell").desc() if descending else F.col("__cell").asc()
    # One row a cell: at most a few thousand in each group.
    before = Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select(*keys, "__cell", *[F.coalesce(F.sum(f"__t_{n}").over(before), F.lit(0)).alias(f"__b_{n}") for n in sums])
    inside = Window.partitionBy(*keys, "__cell").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = df.join(base, [*keys, "__cell"]).withColumns({n: F.col(f"__b_{n}") + F.sum(f"__v_{n}").over(inside) for n in sums})
    return out.drop("__cell", *[f"__{k}_{n}" for n in sums for k in "vb"])


def position(df: DataFrame, dt: str, row_id: str, name: str = "position") -> DataFrame:
    """0-based place of each row by (dt, row_id)."""
    out = running(df, time_cell(dt), [F.col(dt), F.col(row_id)], {name: F.lit(1)})
    return out.withColumn(name, F.col(name) - 1)


def score_table(df: DataFrame, score: str, y: str, amount: str | None = None, keys: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """One row per distinct score (and key): counts and money of both classes."""
    w = F.col(weight) if weight else F.lit(1)
    aggs = [F.sum(F.when(F.col(y) == 1, w).otherwise(0)).alias("pos"), F.sum(w).alias("n")]
    if amount:
        aggs += [F.sum(F.when(F.col(y) == 1, w * F.col(amount)).otherwise(0.0)).alias("pos_amt"), F.sum(F.when(F.col(y) == 0, w * F.col(amount)).otherwise(0.0)).alias("neg_amt")]
    return df.groupBy(*(keys or []), score).agg(*aggs)


def quantiles(df: DataFrame, value: str, probs: list[float], keys: list[str] | None = None) -> DataFrame:
    """(keys, i, q): the exact quantile of each of ``probs`` (its place is i) among non-null values, between neighbours by linear interpolation.

    Values are counted, the counts run through cells, and each wanted rank
    meets the value that holds it by a bucket of ranks: no task holds all
    values of a group, as ``percentile`` would.
    """
    keys = keys or []
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("__q")).agg(F.count("*").alias("__c"))
    cum = running(counts, score_cell("__q"), [F.col("__q")], {"__k": F.col("__c")}, keys=keys)
    total = counts.groupBy(*keys).agg(F.sum("__c").alias("__n"))
    total = total.where("__n > 0").withColumn("__b", F.ceil(F.col("__n") / 1024))
    wanted = local_rows(df.sparkSession, [(i, float(p)) for i, p in enumerate(probs)], "i int, __p double")
    at = (F.col("__n") - 1) * F.col("__p")
    marks = total.join(F.broadcast(wanted)).select(*keys, "i", "__b", (at - F.floor(at)).alias("__f"), F.explode(F.array(F.floor(at), F.ceil(at))).alias("__r"))
    marks = marks.withColumn("__g", F.floor(F.col("__r") / F.col("__b")))
    held = cum.join(total.select(*keys, "__b"), keys) if keys else cum.join(F.broadcast(total.select("__b")))
    first, last = F.col("__k") - F.col("__c"), F.col("__k") - 1
    held = held.select(*keys, "__q", first.alias("__first"), last.alias("__last"), F.explode(F.sequence(F.floor(first / F.col("__b")), F.floor(last / F.col("__b")))).alias("__g"))
    met = held.join(marks, [*keys, "__g"]).where(F.col("__r").between(F.col("__first"), F.col("__last")))
    low, high = F.min("__q"), F.max("__q")
    return met.groupBy(*keys, "i").agg((low + F.max("__f") * (high - low)).alias("q"))


def quantile_array(df: DataFrame, value: str, probs: list[float], keys: list[str] | None = None, name: str = "q") -> DataFrame:
    """(keys, array of the quantiles), for a few probabilities."""
    some = F.array_sort(F.collect_list(F.struct("i", "q")))
    return quantiles(df, value, probs, keys).groupBy(*(keys or [])).agg(F.transform(some, lambda x: x["q"]).alias(name))
