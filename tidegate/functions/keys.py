"""Entity keys and derived scalar columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MISSING = "nan"


def token(c: Column | str, missing: str = MISSING, whole: bool = False) -> Column:
    """Text of a value; ``whole``: an integer-coded number, shown without fraction whatever its type."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce((c.cast("long") if whole else c).cast("string"), F.lit(missing))


def whole_columns(df: DataFrame, names: list[str]) -> dict[str, bool]:
    """Which numeric columns hold integers only: one aggregate for all of them."""
    numeric = {n for n, t in df.dtypes if t in ("float", "double")}
    exact = {n for n, t in df.dtypes if t in ("tinyint", "smallint", "int", "bigint")}
    test = [F.coalesce(F.bool_and(F.col(n) == F.floor(n)), F.lit(True)).alias(n) for n in names if n in numeric]
    row = df.agg(*test).first().asDict() if test else {}
    return {n: n in exact or bool(row.get(n, False)) for n in names}


def add_keys(df: DataFrame, whole: dict[str, bool] | None = None, dt: str = "TransactionDT") -> DataFrame:
    """card_key, D1n (day the account began) and uid.

    Whether a number is a code, shown without fraction, goes by its whole
    column (``whole_columns``, one aggregate); ``whole`` states it for tables
    whose codes are known.
    """
    cards = [f"card{i}" for i in range(1, 7)]
    df = df.withColumn("D1n", (F.floor(F.col(dt) / 86_400) - F.col("D1")).cast("float"))
    whole = {**(whole_columns(df, [*cards, "addr1", "D1n"]) if whole is None else {"D1n": True}), **(whole or {})}
    card_key = F.concat_ws("|", *[token(c, whole=whole[c]) for c in cards])
    df = df.withColumn("card_key", card_key)
    return df.withColumn("uid", F.concat_ws("|", "card_key", *[token(c, whole=whole[c]) for c in ("addr1", "D1n")]))


def device_fingerprint(info: str = "DeviceInfo", parts: tuple[str, ...] = ("id_30", "id_31", "id_33")) -> Column:
    """Null where the device is unknown; other unknown parts read as missing."""
    pieces: list[Column] = [F.col(info)]
    for p in parts:
        pieces += [F.lit("|"), token(p)]
    return F.concat(*pieces)


def amount_fraction(amount: str) -> Column:
    """Fractional dollars at mill precision."""
    return (F.pmod(F.bround(F.col(amount) * 1000), F.lit(1000.0)) / 1000).cast("float")


def hour_of_day(dt: str) -> Column:
    return F.pmod(F.floor(F.col(dt) / 3600), F.lit(24)).cast("int")


def relative_day(dt: str) -> Column:
    return F.floor(F.col(dt) / 86_400)
