"""The data behind the figures, each as a small table; drawing is left to the reader's tools."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegate.functions.costs import CostParams
from tidegate.operators import metrics, swap
from tidegate.operators import thresholds as th
from tidegate.operators.ordered import running, score_cell


def profit_curve(valid: DataFrame, test: DataFrame, grid: DataFrame, p: CostParams) -> DataFrame:
    """(part, decline_rate, net_benefit_per_1000): what declining from each threshold on is worth."""
    parts = [th.single_sweep(th.cum_stats(df, grid), p).select(F.lit(name).alias("part"), "decline_rate", "net_benefit_per_1000") for name, df in (("valid", valid), ("test", test))]
    return parts[0].union(parts[1]).where("decline_rate > 0").distinct()


def cutoffs_on_roc(test: DataFrame, decisions: list[str], y: str = "y") -> DataFrame:
    """(policy, fpr, tpr): where each policy's declines sit on the curve."""
    long = test.select(y, *decisions).unpivot([y], decisions, "policy", "decision")
    rate = lambda v: F.try_divide(F.count_if((F.col("decision") == 2) & (F.col(y) == v)), F.count_if(F.col(y) == v))
    return long.groupBy("policy").agg(rate(0).alias("fpr"), rate(1).alias("tpr"))


def thinned(curve: DataFrame, x: str, points: int = 500) -> DataFrame:
    """A curve of as many points as there are scores, cut to about ``points`` by even steps of x, ends included."""
    step = F.floor(F.col(x) * points)
    return curve.groupBy(step.alias("__step")).agg(F.min_by(F.struct(*curve.columns), F.struct(x, *curve.columns)).alias("r")).select("r.*")


def policy_surface(stats: DataFrame, p: CostParams, max_reviews, least: float) -> DataFrame:
    """(t_review, t_decline, net_benefit_per_1000) of the feasible pairs whose thresholds are ``least`` or more, and finite."""
    pairs = th.pair_table(stats, max_reviews).where((F.col("r_t") >= least) & (F.col("d_t") < F.lit(th.INF)))
    nb = th._cost(p, "r_", "d_")
    return pairs.select(F.col("r_t").alias("t_review"), F.col("d_t").alias("t_decline"), F.try_divide(nb * 1000, F.col("all_k")).alias("net_benefit_per_1000"))


def swap_amounts(df: DataFrame, a: str, b: str, amount: str = "amount", per_doubling: int = 2) -> DataFrame:
    """(set, low, n, share): amounts of each swap set by steps of size, ``per_doubling`` of them in each doubling."""
    step = F.floor(F.log2(F.greatest(F.col(amount), F.lit(0.01))) * per_doubling)
    own = df.withColumn("set", swap.swap_label(a, b)).where("set is not null").groupBy("set", step.alias("step")).agg(F.count("*").alias("n"))
    total = own.groupBy("set").agg(F.sum("n").alias("all"))
    return own.join(total, "set").select("set", F.pow(F.lit(2.0), F.col("step") / per_doubling).alias("low"), "n", (F.col("n") / F.col("all")).alias("share"))


def psi_bars(features: DataFrame, most: int = 25) -> DataFrame:
    """The features that moved most."""
    return features.orderBy(F.col("psi").desc_nulls_last(), "feature").limit(most)


def gains(df: DataFrame, score: str = "score", y: str = "y", points: int = 100) -> DataFrame:
    """(flagged, captured): share of frauds among each share of the highest scores, thinned."""
    c = metrics.score_curve(df, score, y)
    return thinned(c.select(F.try_divide("k", "n_all").alias("flagged"), F.try_divide("tp", "p_all").alias("captured")), "flagged", points)


def cumulative_amounts(df: DataFrame, amount: str = "amount") -> DataFrame:
    """(amount, share): share of all money in transactions up to each amount."""
    one = df.groupBy(amount).agg(F.sum(amount).alias("s"))
    cum = running(one, score_cell(amount), [F.col(amount)], {"upto": F.col("s")})
    total = one.agg(F.sum("s").alias("all"))
    return cum.join(F.broadcast(total)).select(amount, F.try_divide("upto", "all").alias("share"))
