"""Time-ordered splits and folds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegate.operators.ordered import position, running, time_cell


def split_bounds(df: DataFrame, train: float = 0.70, valid: float = 0.15, dt: str = "dt") -> DataFrame:
    """One row (t1, t2): the last times of the training and validation splits.

    A cut that would fall inside a group of equal times moves forward past it.
    """
    if not (0 < train < 1 and 0 < valid < 1 and train + valid < 1):
        raise ValueError("fractions must lie in (0, 1) and sum to less than 1")
    times = df.groupBy(dt).agg(F.count("*").alias("c"))
    cum = running(times, time_cell(dt), [F.col(dt)], {"k": F.col("c")})
    n = df.agg(F.count("*").alias("n"), F.count_if(F.col(dt).isNull()).alias("nulls"))
    n = n.select(F.when(F.col("nulls") == 0, F.col("n")).otherwise(F.raise_error(F.lit("null time")).cast("long")).alias("n"))
    # The first time whose running count reaches a rank holds that rank's row.
    marks = n.select("n", F.bround(F.col("n") * F.lit(train)).cast("long").alias("r1"), F.bround(F.col("n") * F.lit(train + valid)).cast("long").alias("r2"))
    all_ = cum.join(F.broadcast(marks))
    one = all_.agg(F.min(F.when(F.col("k") >= F.greatest("r1", F.lit(1)), F.col(dt))).alias("t1"), F.min(F.when(F.col("k") >= F.greatest("r2", F.lit(1)), F.col(dt))).alias("t2"), F.max("r1").alias("r1"), F.max("r2").alias("r2"), F.min(dt).alias("t0"))
    t1 = F.when(F.col("r1") >= 1, F.col("t1")).otherwise(F.col("t0") - 1)
    return one.select(t1.alias("t1"), F.greatest(F.when(F.col("r2") >= 1, F.col("t2")).otherwise(F.col("t0") - 1), t1).alias("t2"))


def time_split(df: DataFrame, train: float = 0.70, valid: float = 0.15, dt: str = "dt") -> DataFrame:
    """``df`` with column split: train, valid or test; rows of one time share a split."""
    bounds = split_bounds(df, train, valid, dt)
    label = F.when(F.col(dt) <= F.col("t1"), "train").when(F.col(dt) <= F.col("t2"), "valid").otherwise("test")
    return df.join(F.broadcast(bounds)).withColumn("split", label).drop("t1", "t2")


def split_summary(df: DataFrame, dt: str = "dt", y: str = "y", amount: str = "amount") -> DataFrame:
    fraud = F.when(F.col(y) == 1, F.col(amount)).otherwise(0.0)
    out = df.groupBy("split").agg(F.count("*").alias("n"), F.sum(y).cast("long").alias("n_fraud"), F.avg(y).alias("fraud_rate"), F.min(dt).alias("dt_min"), F.max(dt).alias("dt_max"), F.sum(fraud).alias("fraud_amount"), F.sum(amount).alias("amount"))
    order = F.when(F.col("split") == "train", 0).when(F.col("split") == "valid", 1).otherwise(2)
    return out.withColumn("days", (F.col("dt_max") - F.col("dt_min")) / 86_400).withColumn("ord", order)


def check_split(df: DataFrame, dt: str = "dt") -> None:
    """Raise unless all three splits have rows and follow each other in time."""
    got = {r.split: r for r in df.groupBy("split").agg(F.min(dt).alias("a"), F.max(dt).alias("b")).collect()}
    for name in ("train", "valid", "test"):
        if name not in got:
            raise ValueError(f"split {name} is empty")
    if not (got["train"].b < got["valid"].a and got["valid"].b < got["test"].a):
        raise ValueError("splits overlap in time")


def out_of_fold_blocks(df: DataFrame, folds: int, dt: str = "dt", row_id: str = "id", name: str = "fold") -> DataFrame:
    """Contiguous blocks in time order: row i of n lies in block ceil((i + 1) * folds / n) - 1."""
    n = df.agg(F.count("*").alias("__n"))
    out = position(df, dt, row_id, "__i").join(F.broadcast(n))
    return out.withColumn(name, (F.floor(((F.col("__i") + 1) * folds - 1) / F.col("__n"))).cast("int")).drop("__i", "__n")


def expanding_folds(df: DataFrame, folds: int = 5, dt: str = "dt", row_id: str = "id") -> DataFrame:
    """(fold, train_n, valid_n, train_last, valid_first, valid_last): fold i learns from all before its block."""
    blocks = out_of_fold_blocks(df, folds + 1, dt, row_id, "b")
    per = blocks.groupBy("b").agg(F.count("*").alias("c"), F.min(dt).alias("first"), F.max(dt).alias("last"))
    a, b = per.alias("a"), per.alias("b")
    both = b.join(a, F.col("a.b") < F.col("b.b")).groupBy(F.col("b.b").alias("b"), F.col("b.c").alias("c"), F.col("b.first").alias("first"), F.col("b.last").alias("last"))
    out = both.agg(F.sum("a.c").alias("train_n"), F.max("a.last").alias("train_last"))
    return out.select((F.col("b") - 1).alias("fold"), "train_n", F.col("c").alias("valid_n"), "train_last", F.col("first").alias("valid_first"), F.col("last").alias("valid_last"))


def ordered_sample(df: DataFrame, k: int, seed: int = 0, row_id: str = "id") -> DataFrame:
    """k rows without replacement, the same under any partitioning: those with the smallest hashes.

    Counts by the hashes' leading bits show which can be among them, so no
    task sends on many more rows than are wanted.
    """
    h = F.xxhash64(F.lit(seed), row_id)
    lead = F.shiftright(h, 48)
    cells = df.groupBy(lead.alias("cell")).agg(F.count("*").alias("n")).orderBy("cell").collect()  # at most 65,536
    total, last = 0, None
    for c in cells:
        total, last = total + c.n, c.cell
        if total >= k:
            break
    if last is None:
        return df.limit(0)
    return df.where(lead <= last).orderBy(h, row_id).limit(k)
