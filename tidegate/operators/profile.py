"""Dataset profile: scalars, class balance, missing values, distinct counts, column families."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# What column names, or their part before a number, stand for in the transaction schema.
MEANING = {
    "TransactionID": "identifier", "TransactionDT": "time", "TransactionAmt": "amount", "isFraud": "label", "ProductCD": "product",
    "P_emaildomain": "email", "R_emaildomain": "email", "DeviceType": "device", "DeviceInfo": "device",
    "card#": "card", "addr#": "address", "dist#": "distance", "C#": "counts", "D#": "time deltas", "M#": "match flags", "V#": "vendor features", "id_#": "identity",
}


def family(column: str) -> str:
    """What a column stands for, by its name and then by its name with the number left out."""
    return MEANING.get(column) or MEANING.get(re.sub(r"\d+$", "#", column), "Unknown")


def class_balance_by_period(df: DataFrame, days: int = 30, dt: str = "dt", y: str = "y") -> DataFrame:
    """Per period of ``days`` since the first day: rows, fraud rate, first and last time."""
    start = df.agg(F.floor(F.min(dt) / 86_400).alias("__d0"))
    period = F.floor((F.floor(F.col(dt) / 86_400) - F.col("__d0")) / days)
    return df.join(F.broadcast(start)).groupBy(period.alias("period")).agg(F.count("*").alias("n"), F.avg(y).alias("fraud_rate"), F.min(dt).alias("dt_min"), F.max(dt).alias("dt_max"))


def scalars(df: DataFrame, dt: str = "dt", y: str = "y", identity: str | None = None) -> DataFrame:
    """One row: rows, columns, fraud, span in days, share of rows with an identity."""
    match = F.avg(F.col(identity).isNotNull().cast("double")) if identity else F.lit(None).cast("double")
    return df.agg(F.count("*").alias("n_rows"), F.lit(len(df.columns)).alias("n_cols"), F.sum(y).cast("long").alias("n_fraud"), F.avg(y).alias("fraud_rate"), ((F.max(dt) - F.min(dt)) / 86_400).alias("span_days"), match.alias("identity_match_rate"))


def missingness(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, missing_rate), all columns in one aggregate."""
    columns = columns or df.columns
    one = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns])
    return one.unpivot([], columns, "column", "missing_rate")


def cardinality(df: DataFrame, columns: list[str], approximate: bool = False) -> DataFrame:
    """(column, n_distinct) of non-null values: exact by one two-level count over (column, value) pairs, or sketched."""
    if approximate:
        return df.agg(*[F.approx_count_distinct(c).alias(c) for c in columns]).unpivot([], columns, "column", "n_distinct")
    long = df.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot([], columns, "column", "value")
    seen = long.where("value is not null").groupBy("column", "value").agg(F.lit(1).alias("one"))
    names = df.sparkSession.createDataFrame([(c,) for c in columns], "column string")
    return names.join(seen.groupBy("column").agg(F.count("*").alias("n")), "column", "left").select("column", F.coalesce("n", F.lit(0)).alias("n_distinct"))


def data_dictionary(df: DataFrame) -> list[tuple[str, str, str, float, int | None]]:
    """(column, type, family, missing rate, distinct values of text columns) as a small driver-side table."""
    miss = {r["column"]: r["missing_rate"] for r in missingness(df).collect()}
    text = [c for c, t in df.dtypes if t == "string"]
    distinct = {r["column"]: r["n_distinct"] for r in cardinality(df, text).collect()} if text else {}
    return [(c, t, family(c), miss[c], distinct.get(c)) for c, t in df.dtypes]


def dictionary_text(rows) -> str:
    """The data dictionary as a table in Markdown."""
    lines = ["| column | type | family | missing | distinct |", "|---|---|---|---|---|"]
    lines += [f"| {c} | {t} | {f} | {m:.1%} | {'' if d is None else d} |" for c, t, f, m, d in rows]
    return "\n".join(lines) + "\n"


def counts_by(df: DataFrame, *columns: str) -> DataFrame:
    """(columns, n), most frequent first."""
    return df.groupBy(*columns).agg(F.count("*").alias("n")).orderBy(F.desc("n"), *columns)


def share_by(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, share): each group's part of the sum of all values."""
    total = df.agg(F.sum(value).alias("__all"))
    return df.groupBy(key).agg(F.sum(value).alias("__own")).join(F.broadcast(total)).select(key, F.try_divide("__own", "__all").alias("share"))
