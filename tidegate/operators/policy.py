"""Selecting policies on one split and judging them on another."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegate.functions.costs import CostParams, decide, row_benefit, rules_decline, summary_columns
from tidegate.operators import metrics
from tidegate.operators import thresholds as th
from tidegate.operators.ordered import local_table, quantiles, together

POLICIES = ("approve_all", "rules", "youden_single", "profit_single", "profit_three_way")


def split_days(df: DataFrame, dt: str = "dt") -> DataFrame:
    """One row (days): length in days of relative time."""
    return df.agg(((F.max(dt) - F.min(dt)) / 86_400).alias("days"))


def max_reviews_per_day(train: DataFrame, share: float = 0.01, explicit: float | None = None, default_share: float = 0.01, dt: str = "dt") -> DataFrame:
    """One row (cap): the explicit figure, unless a share other than the default asks for share * mean daily rows."""
    if explicit is not None and share == default_share:
        return train.sparkSession.createDataFrame([(float(explicit),)], "cap double")
    return train.agg(F.try_divide(F.lit(share) * F.count("*"), (F.max(dt) - F.min(dt)) / 86_400).alias("cap"))


def amount_threshold(train: DataFrame, percentile: float = 90, amount: str = "amount") -> DataFrame:
    """One row (amount_threshold): a percentile of non-null amounts; none at all: error."""
    got = quantiles(train, amount, [percentile / 100]).agg(F.first("q").alias("q"))
    return got.select(F.when(F.col("q").isNotNull(), F.col("q")).otherwise(F.raise_error(F.lit("no amounts")).cast("double")).alias("amount_threshold"))


def select_policies(valid: DataFrame, train: DataFrame, p: CostParams, n_quantiles: int = 2000, n_linear: int = 1001, n_policy: int = 400, share: float = 0.01, grid: DataFrame | None = None, pair_grid: DataFrame | None = None, digits: int | None = None) -> DataFrame:
    """One row (t_youden, t_profit, t_review, t_decline, cap), chosen on ``valid`` alone; capacity comes from ``train``."""
    grid = grid if grid is not None else th.threshold_grid(valid, n_quantiles, n_linear, digits=digits)
    pair_grid = pair_grid if pair_grid is not None else th.threshold_grid(valid, n_policy // 2, 0, digits=digits)
    stats, cap, youden = together(lambda: th.local_stats(valid, {"single": grid, "pair": pair_grid}), lambda: local_table(max_reviews_per_day(train, share)), lambda: local_table(metrics.youden_threshold(valid)))
    profit, pair = together(lambda: local_table(th.profit_optimal(th.single_sweep(stats["single"], p))), lambda: local_table(select_pair(valid, p, cap, pair_grid, stats=stats["pair"])))
    out = youden
    for one in (profit, pair, cap):
        out = out.join(F.broadcast(one))
    return out


def select_pair(valid: DataFrame, p: CostParams, cap: DataFrame, pair_grid: DataFrame, score: str = "score", stats: DataFrame | None = None) -> DataFrame:
    """One row (t_review, t_decline): the best pair on ``valid`` within ``cap`` reviews a day."""
    stats = stats if stats is not None else local_table(th.cum_stats(valid, local_table(pair_grid), score))
    limit = cap.join(F.broadcast(split_days(valid))).select((F.col("cap") * F.col("days")).alias("limit"))
    return th.three_way(stats, p, local_table(limit)).select("t_review", "t_decline")


def decisions(df: DataFrame, chosen: DataFrame, rules: str | None = None) -> DataFrame:
    """One dec_<policy> column per policy on every row; ``rules`` names a yes/no column."""
    out = df.join(F.broadcast(chosen))
    cols = {"dec_approve_all": F.lit(0).cast("tinyint"), "dec_youden_single": decide("score", F.col("t_youden")), "dec_profit_single": decide("score", F.col("t_profit")), "dec_profit_three_way": decide("score", F.col("t_decline"), F.col("t_review"))}
    if rules:
        cols["dec_rules"] = F.when(F.col(rules), 2).otherwise(0).cast("tinyint")
    return out.withColumns(cols)


def policy_summary(df: DataFrame, decision: str, p: CostParams, keys: list[str] | None = None, y: str = "y", amount: str = "amount", dt: str = "dt") -> DataFrame:
    """Money and customer impact of one decision column; days are those of all rows."""
    days = split_days(df, dt).toDF("__days")
    return df.join(F.broadcast(days)).groupBy(*(keys or [])).agg(*summary_columns(decision, y, amount, p, F.col("__days")))


def evaluate_policies(df: DataFrame, p: CostParams, policies: tuple[str, ...] = POLICIES) -> DataFrame:
    """One summary row per policy from one pass over the dec_<policy> columns."""
    keep = df.select("dt", "y", "amount", *[F.col(f"dec_{c}") for c in policies])
    long = keep.unpivot(["dt", "y", "amount"], [f"dec_{c}" for c in policies], "policy", "decision")
    out = policy_summary(long.withColumn("policy", F.expr("substr(policy, 5)")), "decision", p, ["policy"])
    order = F.array_position(F.array(*[F.lit(c) for c in policies]), F.col("policy"))
    return out.withColumn("ord", order.cast("int"))


def benefits(df: DataFrame, p: CostParams, policies: tuple[str, ...] = POLICIES) -> DataFrame:
    """ben_<policy>: what each row's decision saves."""
    return df.withColumns({f"ben_{c}": row_benefit(F.col(f"dec_{c}"), "y", "amount", p) for c in policies})


def with_rules(df: DataFrame, threshold: DataFrame, prior_count: str) -> DataFrame:
    """``df`` with yes/no column rules; ``threshold`` is the row of ``amount_threshold``."""
    return df.join(F.broadcast(threshold)).withColumn("rules", rules_decline("amount", prior_count, F.col("amount_threshold")))


def reviews_per_day(df: DataFrame, decision: str, dt: str = "dt") -> DataFrame:
    """(day, reviews) for each relative day with rows."""
    start = df.agg(F.min(dt).alias("__t0"))
    day = F.floor((F.col(dt) - F.col("__t0")) / 86_400)
    return df.join(F.broadcast(start)).groupBy(day.alias("day")).agg(F.count_if(F.col(decision) == 1).alias("reviews"))


def review_load(daily: DataFrame, cap: DataFrame) -> DataFrame:
    """One row: highest and 95th percentile of daily reviews, days over capacity, days with rows."""
    return daily.join(F.broadcast(cap)).agg(F.max("reviews").alias("reviews_max"), F.percentile("reviews", F.lit(0.95)).alias("reviews_p95"), F.count_if(F.col("reviews") > F.col("cap")).alias("days_over_capacity"), F.count("*").alias("n_days"))


def capacity_sensitivity(valid: DataFrame, train: DataFrame, test: DataFrame, p: CostParams, shares: list[float], pair_grid: DataFrame) -> DataFrame:
    """Per capacity share: the pair chosen on validation and its net benefit on test, all shares in one pass over test."""
    stats = local_table(th.cum_stats(valid, pair_grid))
    days = local_table(split_days(valid))
    chosen = None
    for s in shares:  # each search is over the small table of sums
        limit = max_reviews_per_day(train, s).join(F.broadcast(days)).select((F.col("cap") * F.col("days")).alias("limit"))
        pair = th.three_way(stats, p, local_table(limit)).select(F.lit(s).alias("share"), "t_review", "t_decline", F.col("net_benefit").alias("valid_net_benefit"))
        chosen = pair if chosen is None else chosen.union(pair)
    d = decide("score", F.col("t_decline"), F.col("t_review"))
    return test.join(F.broadcast(local_table(chosen))).groupBy("share", "t_review", "t_decline", "valid_net_benefit").agg(F.sum(row_benefit(d, "y", "amount", p)).alias("test_net_benefit"), F.count_if(d == 1).alias("n_reviewed"))


def auc_versus_profit(evaluated: DataFrame, chosen: DataFrame, test: DataFrame, p: CostParams, grid: DataFrame, days: DataFrame) -> DataFrame:
    """One row: what choosing the cutoff by Youden's J instead of money leaves on the table."""
    one = evaluated.agg(*[F.max(F.when(F.col("policy") == q, F.col(c))).alias(f"{q}_{c}") for q in ("profit_single", "youden_single") for c in ("net_benefit", "net_benefit_per_1000", "decline_rate", "n_false_declines")])
    sweep = local_table(th.single_sweep(th.cum_stats(test, grid), p))
    oracle = th.profit_optimal(sweep).toDF("t_oracle").join(F.broadcast(sweep), F.col("t") == F.col("t_oracle")).select("t_oracle", F.col("net_benefit_per_1000").alias("oracle_net_benefit_per_1000"))
    both = one.join(F.broadcast(oracle)).join(F.broadcast(chosen.select("t_profit", "t_youden"))).join(F.broadcast(days))
    left = F.col("profit_single_net_benefit") - F.col("youden_single_net_benefit")
    return both.select(
        (F.col("t_profit") - F.col("t_youden")).alias("threshold_gap"), "t_oracle", "oracle_net_benefit_per_1000",
        (F.col("profit_single_net_benefit_per_1000") - F.col("youden_single_net_benefit_per_1000")).alias("left_on_table_per_1000"),
        left.alias("left_on_table_total"), F.try_divide(left, F.col("days")).alias("left_on_table_per_day"),
        F.try_divide("youden_single_decline_rate", F.greatest("profit_single_decline_rate", F.lit(1e-12))).alias("decline_rate_ratio"),
        (F.col("youden_single_n_false_declines") - F.col("profit_single_n_false_declines")).alias("false_declines_avoided"),
    )
