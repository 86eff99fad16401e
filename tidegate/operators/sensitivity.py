"""Cost sensitivity: every cell of a parameter grid in one plan.

Net benefit is linear in the cost parameters, so thresholds carry their sums
and each cell only weighs them: no data are read again per cell.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegate.operators import thresholds as th
from tidegate.operators.ordered import local_table, together

PARAMS = ("margin_rate", "churn_penalty", "review_cost", "review_catch_rate")
GRID = {"margin_rate": [0.005, 0.01, 0.02, 0.035, 0.05], "churn_penalty": [0.0, 5.0, 10.0, 25.0, 50.0], "review_cost": [1.0, 2.5, 5.0, 10.0, 20.0], "review_catch_rate": [0.5, 0.65, 0.8, 0.85, 0.95, 0.98]}


def cost_cells(spark, grid: dict[str, list[float]] = GRID) -> DataFrame:
    """One row per combination; the lists are parameters, the product is small."""
    one = spark.range(1).select(*[F.array(*[F.lit(float(v)) for v in grid[k]]).alias(k) for k in PARAMS])
    return reduce(lambda d, k: d.withColumn(k, F.explode(k)), PARAMS, one)


def _pair(side_r: str, side_d: str) -> Column:
    c = F.col
    fr, fd = c(f"{side_r}fraud_amt"), c(f"{side_d}fraud_amt")
    return fd + c("review_catch_rate") * (fr - fd) - c("margin_rate") * c(f"{side_d}legit_amt") - c("churn_penalty") * c(f"{side_d}legit_cnt") - c("review_cost") * (c(f"{side_r}k") - c(f"{side_d}k"))


def choose(cells: DataFrame, valid_single: DataFrame, valid_pairs: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """Per cell: t_profit_single, and the pair (t_review, t_decline), best on validation sums."""
    nb = F.col("fraud_amt") - F.col("margin_rate") * F.col("legit_amt") - F.col("churn_penalty") * F.col("legit_cnt")
    two = ["margin_rate", "churn_penalty"]  # a single threshold's worth depends on these alone
    single = valid_single.join(F.broadcast(cells.select(*two).distinct())).withColumn("nb", nb)
    best = single.groupBy(*two).agg(F.max("nb").alias("best"))
    single = single.join(F.broadcast(best), two).where(F.col("nb") >= F.col("best") - tolerance).groupBy(*two).agg(F.max("t").alias("t_profit_single"))
    pairs = valid_pairs.join(F.broadcast(cells)).withColumn("nb", _pair("r_", "d_"))
    best = pairs.groupBy(*PARAMS).agg(F.max("nb").alias("best"))
    pick = F.struct((F.col("d_k") - F.col("r_k")).alias("a"), F.col("d_t").alias("b"), (-F.col("r_t")).alias("c"))
    near = pairs.join(F.broadcast(best), list(PARAMS)).where(F.col("nb") >= F.col("best") - tolerance)
    pair = near.groupBy(*PARAMS).agg(F.max_by(F.struct("r_t", "d_t"), pick).alias("x"))
    return single.join(pair.select(*PARAMS, F.col("x.r_t").alias("t_review"), F.col("x.d_t").alias("t_decline")), two)


def run(cells: DataFrame, valid: DataFrame, test: DataFrame, single_grid: DataFrame, pair_grid: DataFrame, max_reviews, t_youden: DataFrame, rules: str | None = None) -> DataFrame:
    """Per cell: thresholds chosen on ``valid`` and net benefit per 1,000 on ``test`` of four policies."""
    cells, t_youden = local_table(cells), local_table(t_youden)
    limit = (lambda: local_table(max_reviews)) if isinstance(max_reviews, DataFrame) else (lambda: max_reviews)
    every = local_table(single_grid.union(pair_grid).union(t_youden.toDF("t")).distinct())
    sums, max_reviews, stats = together(lambda: th.local_stats(valid, {"single": single_grid, "pair": pair_grid}), limit, lambda: local_table(th.cum_stats(test, every).select("t", "k", "fraud_amt", "legit_amt", "legit_cnt", "all_k")))
    chosen = local_table(choose(cells, sums["single"], local_table(th.pair_table(sums["pair"], max_reviews), 1_000_000)))
    out = chosen.join(F.broadcast(t_youden.toDF("t_youden")))

    def at(side: str, t: str, df: DataFrame) -> DataFrame:
        s = stats.select(*[F.col(c).alias(f"{side}{c}") for c in stats.columns])
        return df.join(F.broadcast(s), F.col(t) == F.col(f"{side}t"))

    for side, t in (("r_", "t_review"), ("d_", "t_decline"), ("s_", "t_profit_single"), ("y_", "t_youden")):
        out = at(side, t, out)
    n = F.col("d_all_k")
    cols = {"nb1000_profit_three_way": _pair("r_", "d_") / n * 1000, "nb1000_profit_single": _pair("s_", "s_") / n * 1000, "nb1000_youden_single": _pair("y_", "y_") / n * 1000}
    if rules:
        flag = F.col(rules)
        sums = test.agg(*[F.sum(F.when(c, v).otherwise(0.0)).alias(k) for k, c, v in (("ru_fraud_amt", flag & (F.col("y") == 1), F.col("amount")), ("ru_legit_amt", flag & (F.col("y") == 0), F.col("amount")), ("ru_legit_cnt", flag & (F.col("y") == 0), F.lit(1.0)))], F.lit(0).alias("ru_k"))
        out = out.join(F.broadcast(sums))
        cols["nb1000_rules"] = _pair("ru_", "ru_") / n * 1000
    return out.select(*PARAMS, "t_profit_single", "t_review", "t_decline", *[c.alias(k) for k, c in cols.items()])


#: Orderings of policies that the conclusions rest on: (name, better, worse, whether level counts).
ORDERINGS = (("three_way_ge_single", "profit_three_way", "profit_single", True), ("single_gt_youden", "profit_single", "youden_single", False), ("model_gt_rules", "profit_three_way", "rules", False))


def ranking_stability(cells: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """One row: in which shares of the cells each ordering holds, all of them hold, and a policy makes money at all."""
    worth = lambda k: F.col(f"nb1000_{k}")
    tests = {name: worth(hi) - worth(lo) >= -tolerance if level else worth(hi) > worth(lo) for name, hi, lo, level in ORDERINGS}
    tests["all_orderings"] = reduce(lambda x, y: x & y, tests.values())
    tests |= {f"{k.removeprefix('profit_').removesuffix('_single')}_positive": worth(k) > 0 for k in ("profit_three_way", "youden_single")}
    return cells.agg(F.count("*").alias("n_cells"), *[F.try_divide(F.count_if(t), F.count("*")).alias(f"share_{k}") for k, t in tests.items()])


def ranges(cells: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """(measure, least, most): what each measure spans over the grid."""
    long = cells.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], list(columns), "measure", "value")
    return long.groupBy("measure").agg(F.min("value").alias("least"), F.max("value").alias("most"))


def pivot(cells: DataFrame, row: str, col: str, value: Column, values: list[float], agg=F.avg) -> DataFrame:
    """``agg`` of a value by one parameter down and another across; columns are named c0, c1, ..."""
    return cells.groupBy(row).agg(*[agg(F.when(F.col(col) == v, value)).alias(f"c{i}") for i, v in enumerate(values)])
