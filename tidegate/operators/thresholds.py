"""Cumulative statistics at thresholds, sweeps and threshold search.

A grid of thresholds is small by its parameters.  Rows find their place in it
through a cell join (a score shares its cell with few thresholds), are summed
per place, and the running sums are over the grid alone.
"""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegate.functions.costs import CostParams
from tidegate.operators.ordered import CELLS, local_rows, local_table, quantiles, score_cell

INF = float("inf")


def literal_grid(spark, values: list[float]) -> DataFrame:
    return local_rows(spark, [(float(v),) for v in sorted(set(values))], "t double")


def _probabilities(n: int) -> list[float]:
    """Even ones, and ones dense in the upper tail."""
    return np.linspace(0, 1, n).tolist() + np.clip(1 - np.geomspace(1e-5, 1, n), 0, 1).tolist() if n else []


def threshold_grids(df: DataFrame, wanted: dict[str, tuple[str, int, int]], digits: int | None = None) -> dict[str, DataFrame]:
    """Several grids in one pass: name -> (score column, n_quantiles, n_linear).

    A grid's distinct thresholds are even quantiles, quantiles dense in the
    upper tail, an even grid on [0, 1], and infinity; ``digits`` rounds them,
    for results that another engine must reproduce.  Their number is bounded
    by the parameters, so they are held as literal rows.
    """
    spark = df.sparkSession
    scores = sorted({s for s, n, _ in wanted.values() if n})
    sizes = sorted({n for _, n, _ in wanted.values() if n})
    got: dict[tuple[str, int], list[float]] = {}
    if scores:
        long = df.select(*[F.col(s).cast("double").alias(s) for s in scores]).unpivot([], scores, "score", "value")
        probs = [p for n in sizes for p in _probabilities(n)]
        begin = dict(zip(sizes, np.cumsum([0, *(2 * n for n in sizes[:-1])]).tolist(), strict=True))
        for r in quantiles(long, "value", probs, ["score"]).toArrow().to_pylist():
            got[r["score"], r["i"]] = r["q"]
    out = {}
    for name, (score, n, n_linear) in wanted.items():
        values = [got[score, begin[n] + i] for i in range(2 * n) if (score, begin[n] + i) in got] if n else []
        values += np.linspace(0, 1, n_linear).tolist() if n_linear else []
        out[name] = literal_grid(spark, [*(values if digits is None else _rounded(values, digits)), INF])
    return out


def _rounded(values: list[float], digits: int) -> list[float]:
    """Halves go up by their decimal text, as in Spark's ``round``."""
    unit = Decimal(1).scaleb(-digits)
    return [float(Decimal(repr(v)).quantize(unit, ROUND_HALF_UP)) for v in values]


def threshold_grid(df: DataFrame, n_quantiles: int = 2000, n_linear: int = 1001, score: str = "score", digits: int | None = None) -> DataFrame:
    """One of ``threshold_grids``."""
    return threshold_grids(df, {"one": (score, n_quantiles, n_linear)}, digits)["one"]


def _ranked(grid: DataFrame) -> tuple[pa.Table, np.ndarray]:
    """The distinct thresholds in order, each with its cell."""
    rows = grid.select("t", score_cell("t").alias("cell")).distinct().toArrow().sort_by("t")
    return rows, rows.column("cell").to_numpy()


def place(df: DataFrame, grid: DataFrame, score: str = "score", name: str = "place") -> DataFrame:
    """``df`` with the number of thresholds t of ``grid`` that are at or below the score."""
    rows, cell = _ranked(grid)
    every = np.arange(-CELLS, CELLS + 1)
    cuts = np.searchsorted(cell, np.append(every, CELLS + 1)).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(cuts), rows.column("t").combine_chunks())
    # One row for each cell, whatever the input: thresholds in lower cells, and those inside.
    cells = df.sparkSession.createDataFrame(pa.table({"__g": pa.array(every, pa.int32()), "__base": pa.array(cuts[:-1]), "__ts": lists}))
    out = df.withColumn("__g", score_cell(score)).join(F.broadcast(cells), "__g")
    inside = F.size(F.filter("__ts", lambda t: t <= F.col(score)))
    return out.withColumn(name, (F.col("__base") + inside).cast("int")).drop("__g", "__ts", "__base")


def cum_stats(df: DataFrame, grid: DataFrame, score: str = "score", y: str = "y", amount: str = "amount", keys: list[str] | None = None) -> DataFrame:
    """Per threshold t: rows at or above it (k), their fraud and legitimate counts and money, and the totals of all rows."""
    keys = keys or []
    ok = F.col(score).isNotNull() & ~F.isnan(score)
    df = df.withColumn(score, F.when(ok, F.col(score)).otherwise(F.raise_error(F.lit("score is missing")).cast("double")))
    fraud = F.col(y) == 1
    sums = place(df, grid, score).groupBy(*keys, "place").agg(
        F.count("*").alias("k"), F.count_if(fraud).alias("fraud_cnt"), F.count_if(~fraud).alias("legit_cnt"),
        F.sum(F.when(fraud, F.col(amount)).otherwise(0.0)).alias("fraud_amt"), F.sum(F.when(~fraud, F.col(amount)).otherwise(0.0)).alias("legit_amt"),
    )
    names = ["k", "fraud_cnt", "legit_cnt", "fraud_amt", "legit_amt"]
    rows, _ = _ranked(grid)
    ranked = df.sparkSession.createDataFrame(rows.drop_columns("cell").append_column("place", pa.array(np.arange(1, rows.num_rows + 1), pa.int32())))
    if keys:
        ranked = sums.select(*keys).distinct().join(F.broadcast(ranked))
    marks = ranked.select(*keys, "place", "t").join(sums, [*keys, "place"], "full")
    down = Window.partitionBy(*keys).orderBy(F.col("place").desc()).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    out = marks.select(*keys, "t", *[F.coalesce(F.sum(n).over(down), F.lit(0)).alias(n) for n in names], *[F.coalesce(F.sum(n).over(whole), F.lit(0)).alias(f"all_{n}") for n in names])
    return out.where("t is not null")


def local_stats(df: DataFrame, grids: dict[str, DataFrame], score: str = "score") -> dict[str, DataFrame]:
    """``cum_stats`` on several small grids from one pass over the rows, each as literal rows."""
    spark = df.sparkSession
    thresholds = {name: g.toArrow().column("t") for name, g in grids.items()}
    every = sorted({t for c in thresholds.values() for t in c.to_pylist()})
    got = local_table(cum_stats(df, literal_grid(spark, every), score)).toArrow()
    return {name: spark.createDataFrame(got.filter(pc.is_in(got.column("t"), c.combine_chunks()))) for name, c in thresholds.items()}


def _cost(p, kr: str = "", kd: str = ""):
    """Net benefit of declining the rows of ``kd`` and reviewing those of ``kr`` beyond them."""
    f = lambda side, n: F.col(f"{side}{n}")
    get = (lambda n: F.col(n)) if isinstance(p, str) else (lambda n: F.lit(getattr(p, n)))
    return f(kd, "fraud_amt") + get("review_catch_rate") * (f(kr, "fraud_amt") - f(kd, "fraud_amt")) - get("margin_rate") * f(kd, "legit_amt") - get("churn_penalty") * f(kd, "legit_cnt") - get("review_cost") * (f(kr, "k") - f(kd, "k"))


def single_sweep(stats: DataFrame, p: CostParams) -> DataFrame:
    """Per threshold of ``cum_stats``: what declining from it on costs and saves."""
    nb = F.col("fraud_amt") - F.lit(p.margin_rate) * F.col("legit_amt") - F.lit(p.churn_penalty) * F.col("legit_cnt")
    return stats.select(
        "t", F.col("k").alias("n_declined"), F.try_divide("k", "all_k").alias("decline_rate"),
        (F.col("all_fraud_amt") - nb).alias("cost"), nb.alias("net_benefit"), F.try_divide(nb * 1000, F.col("all_k")).alias("net_benefit_per_1000"),
        F.try_divide("fraud_cnt", "all_fraud_cnt").alias("tpr"), F.try_divide("legit_cnt", "all_legit_cnt").alias("fpr"), F.try_divide("fraud_amt", "all_fraud_amt").alias("fraud_capture_dollars"),
    )


def profit_optimal(sweep: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """One row (t_profit): the best net benefit; of those within the tolerance the highest threshold."""
    best = sweep.agg(F.max("net_benefit").alias("__best"))
    return sweep.join(F.broadcast(best)).where(F.col("net_benefit") >= F.col("__best") - tolerance).agg(F.max("t").alias("t_profit"))


def pair_table(stats: DataFrame, max_reviews=None) -> DataFrame:
    """All feasible pairs t_review <= t_decline with the sums that any cost parameters need.

    The pairs are of the grid alone; capacity doesn't depend on costs and prunes first.
    """
    names = ["t", "k", "fraud_amt", "legit_amt", "legit_cnt"]
    r = stats.select(*[F.col(n).alias(f"r_{n}") for n in names])
    d = stats.select(*[F.col(n).alias(f"d_{n}") for n in names], "all_k")
    ok = (F.col("r_t") <= F.col("d_t")) & (F.col("r_k") >= F.col("d_k"))
    pairs = d.join(F.broadcast(r), ok)
    if max_reviews is not None:
        if isinstance(max_reviews, DataFrame):
            pairs = pairs.join(F.broadcast(max_reviews.toDF("__cap"))).where(F.col("r_k") - F.col("d_k") <= F.col("__cap")).drop("__cap")
        else:
            pairs = pairs.where(F.col("r_k") - F.col("d_k") <= F.lit(float(max_reviews)))
    return pairs


def three_way(stats: DataFrame, p: CostParams, max_reviews=None, tolerance: float = 1e-9) -> DataFrame:
    """One row: the best pair; ties go to fewest reviews, then highest t_decline, then lowest t_review."""
    nb = pair_table(stats, max_reviews).withColumn("net_benefit", _cost(p, "r_", "d_"))
    best = nb.agg(F.max("net_benefit").alias("__best"))
    near = nb.join(F.broadcast(best)).where(F.col("net_benefit") >= F.col("__best") - tolerance)
    pick = F.struct((F.col("d_k") - F.col("r_k")).alias("a"), F.col("d_t").alias("b"), (-F.col("r_t")).alias("c"))
    one = near.agg(F.max_by(F.struct("r_t", "d_t", "net_benefit", "r_k", "d_k", "all_k"), pick).alias("x"))
    return one.select(F.col("x.r_t").alias("t_review"), F.col("x.d_t").alias("t_decline"), F.col("x.net_benefit").alias("net_benefit"), (F.col("x.r_k") - F.col("x.d_k")).alias("n_reviews"), F.col("x.d_k").alias("n_declined"), F.try_divide(F.col("x.net_benefit") * 1000, F.col("x.all_k")).alias("net_benefit_per_1000"))


def pair_net_benefit(df: DataFrame, t_review: float, t_decline: float, p: CostParams, score: str = "score", y: str = "y", amount: str = "amount") -> DataFrame:
    """One row (net_benefit) of a given pair on given rows."""
    from tidegate.functions.costs import decide, row_benefit

    d = decide(F.col(score), t_decline, t_review)
    return df.agg(F.sum(row_benefit(d, y, amount, p)).alias("net_benefit"))
