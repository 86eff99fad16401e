"""Swap sets: rows that two policies treat differently."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegate.operators.ordered import local_rows, quantiles

#: Product columns made without being named.
MOST_PRODUCTS = 1000
SETS = ("a_approves_b_declines", "a_declines_b_approves", "both_decline", "both_approve")


def swap_label(a: str, b: str) -> Column:
    """Which set a row belongs to; rows under review belong to none."""
    a_, b_ = F.col(a), F.col(b)
    return F.when((a_ == 0) & (b_ == 2), SETS[0]).when((a_ == 2) & (b_ == 0), SETS[1]).when((a_ == 2) & (b_ == 2), SETS[2]).when((a_ == 0) & (b_ == 0), SETS[3])


def characterise(df: DataFrame, a: str, b: str, y: str = "y", amount: str = "amount", tenure: str = "tenure", prior: str = "prior_cnt", product: str = "product", products: list[str] | None = None) -> DataFrame:
    """One row per set, empty ones with n = 0 and nulls: counts, fraud, amount quantiles, tenure, new accounts, product shares.

    ``products`` are the columns wanted; without them, all products (at most ``MOST_PRODUCTS``, as each is a column).
    """
    df = df.withColumn("set", swap_label(a, b)).where("set is not null")
    name = F.coalesce(F.col(product), F.lit("nan"))
    if products is None:
        products = [r[0] for r in df.groupBy(name.alias("p")).agg(F.lit(1)).orderBy("p").limit(MOST_PRODUCTS + 1).collect()]
        if len(products) > MOST_PRODUCTS:
            raise ValueError(f"more than {MOST_PRODUCTS} products: name those wanted")
    got = df.groupBy("set").agg(
        F.count("*").alias("n"), F.avg(y).alias("fraud_rate"), F.sum(y).cast("long").alias("n_fraud"), F.sum(amount).alias("amount_total"), F.avg((F.col(prior) == 0).cast("double")).alias("share_new_card"),
        *[F.avg((name == v).cast("double")).alias(f"product_{v}") for v in products],
    )
    # Quantiles of both measures in one pass over (set, measure).
    long = df.select("set", F.col(amount).cast("double").alias("amount"), F.col(tenure).cast("double").alias("tenure")).unpivot(["set"], ["amount", "tenure"], "measure", "value")
    shares = (0.25, 0.5, 0.75, 0.95)
    at = quantiles(long, "value", list(shares), ["set", "measure"])
    pick = lambda m, i: F.max(F.when((F.col("measure") == m) & (F.col("i") == i), F.col("q")))
    at = at.groupBy("set").agg(*[pick("amount", i).alias(c) for i, c in enumerate(("amount_p25", "amount_median", "amount_p75", "amount_p95"))], pick("tenure", 1).alias("tenure_days_median"))
    names = local_rows(df.sparkSession, [(s,) for s in SETS], "set string")
    cols = ["fraud_rate", "n_fraud", "amount_total", "amount_p25", "amount_median", "amount_p75", "amount_p95", "tenure_days_median", "share_new_card", *[f"product_{v}" for v in products]]
    return names.join(got, "set", "left").join(at, "set", "left").select("set", F.coalesce("n", F.lit(0)).alias("n"), *cols)
