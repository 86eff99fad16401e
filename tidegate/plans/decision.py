"""The decision query: features, split, selection on validation, evaluation on test."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegate.functions.costs import CostParams, decide
from tidegate.operators import bootstrap, metrics, policy
from tidegate.operators import thresholds as th
from tidegate.operators.ordered import local_table, together
from tidegate.operators.split import time_split
from tidegate.plans import views
from tidegate.sources.tables import staged

#: Thresholds are rounded, so that SQL has the same ones.
DIGITS = 9
#: Quantiles each way of the grid of pairs.
PAIR_QUANTILES = 200
#: The headline table: the policies of one model, and the three-way policy of a model without velocity features before the last.
POLICIES = (*policy.POLICIES[:-1], "no_velocity_three_way", policy.POLICIES[-1])


def parts(df: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    return tuple(df.where(F.col("split") == s) for s in ("train", "valid", "test"))


def full_grid(df: DataFrame) -> DataFrame:
    return th.threshold_grid(df, digits=DIGITS)


def full_pair_grid(df: DataFrame) -> DataFrame:
    return th.threshold_grid(df, PAIR_QUANTILES, 0, digits=DIGITS)


def split_table(spark: SparkSession, sf_dir: str, history: bool = True) -> DataFrame:
    """Transactions with their split (and account history), written once: each of the many aggregates after it reads the columns it needs."""
    df = views.txn(spark, sf_dir)
    return staged(time_split(views.with_history(df) if history else df), "split")


@dataclass
class Decided:
    test: DataFrame  # with dec_ columns
    chosen: DataFrame  # one row: thresholds and capacity
    train: DataFrame
    valid: DataFrame
    grid: DataFrame
    pair_grid: DataFrame


def choose(train: DataFrame, valid: DataFrame, test: DataFrame, p: CostParams) -> Decided:
    """Policies chosen on validation over the operators' own grids, for both scores, and every policy's decision on test."""
    grids = th.threshold_grids(valid, {"single": ("score", 2000, 1001), "pair": ("score", PAIR_QUANTILES, 0), "second": ("score_b", PAIR_QUANTILES, 0)}, DIGITS)
    cap = local_table(policy.max_reviews_per_day(train))
    chosen, second, amount = together(
        lambda: local_table(policy.select_policies(valid, train, p, grid=grids["single"], pair_grid=grids["pair"])),
        lambda: local_table(policy.select_pair(valid, p, cap, grids["second"], "score_b")),
        lambda: local_table(policy.amount_threshold(train)),
    )
    test = policy.decisions(policy.with_rules(test, amount, "prior_cnt"), chosen, "rules")
    other = second.select(F.col("t_review").alias("__r"), F.col("t_decline").alias("__d"))
    test = test.join(F.broadcast(other)).withColumn("dec_no_velocity_three_way", decide("score_b", F.col("__d"), F.col("__r"))).drop("__r", "__d")
    return Decided(test, chosen, train, valid, grids["single"], grids["pair"])


def decided(spark: SparkSession, sf_dir: str) -> Decided:
    """``choose`` on the driver's events."""
    return choose(*parts(split_table(spark, sf_dir)), CostParams())


#: Comparisons of policies' money that the hypotheses rest on: (name, better, worse).
MONEY_PAIRS = (("profit_minus_youden", "profit_single", "youden_single"), ("three_way_minus_rules", "profit_three_way", "rules"))


def comparisons(benefits: DataFrame, n_boot: int = 1000, seed: int = 20240917) -> DataFrame:
    """(name, point, ci_low, ci_high, n_boot_valid, excludes_zero) of the comparisons that the hypotheses rest on, money per 1,000 rows."""
    own = benefits.select("id", "y", "score", "score_b", *[f"ben_{x}" for _, *pair in MONEY_PAIRS for x in pair])
    weighted = bootstrap.poisson_weights(own, n_boot, seed)
    out = None
    # All differences of money share one pass over rows times replicates.
    mean = lambda a, b, w: F.lit(1000.0) * F.sum((F.col(f"ben_{a}") - F.col(f"ben_{b}")) * w) / F.sum(w)
    each = local_table(weighted.groupBy("b").agg(*[mean(a, b, F.col("w")).alias(n) for n, a, b in MONEY_PAIRS]))
    point = own.agg(*[mean(a, b, F.lit(1)).alias(n) for n, a, b in MONEY_PAIRS])
    for n, _, _ in MONEY_PAIRS:
        ci = bootstrap.interval(each.select("b", F.col(n).alias("value")), "value", n_boot)
        one = point.select(F.lit(n).alias("name"), F.col(n).alias("point")).join(F.broadcast(ci))
        out = one if out is None else out.union(one)
    a, b = (metrics.ranking_scores(own, s).select(F.col("pr_auc").alias(n)) for s, n in (("score", "__a"), ("score_b", "__b")))
    ap = a.join(F.broadcast(b)).select(F.lit("pr_auc_with_minus_without_velocity").alias("name"), (F.col("__a") - F.col("__b")).alias("point"))
    return out.union(ap.join(F.broadcast(bootstrap.interval(bootstrap.metric_diff(own, "score", "score_b", "pr_auc", n_boot, seed), "value", n_boot))))
