"""A synthetic source: two tables of the transaction schema from hashes of row numbers.

Every value is a function of (seed, column, row) by integer mixing rounds, so
results don't depend on partitioning, any range of rows can be made alone, and
SQL engines can make the same tables.

What the tables hold: accounts trade at rates and hours of their own; risk
differs smoothly between accounts, and rises for rows made soon after an
account's first day; frauds tend to be larger.  Columns without a story of
their own follow their kind: counters, day offsets, flags, codes, measures.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegate.operators.bootstrap import ROUND, WORD

#: A multiplier whose product with a 32-bit word fits 63 bits.
SPREAD, DAY = 1_540_483_477, 86_400


def uniform(seed: int, stream: int, row: Column) -> Column:
    """A number in [0, 1) for each (seed, stream, row)."""
    h = (F.pmod(row.cast("long"), F.lit(WORD)) * SPREAD + F.lit((stream * 7919 + seed * 104_729) % WORD)) % WORD
    fold = lambda x: F.shiftright(x, 16).bitwiseXOR(x)
    rounds = F.array(*[F.lit(i) for i in range(3)])  # a loop, as the word occurs twice in each round
    return F.aggregate(rounds, h, lambda x, _: (fold(x) * ROUND) % WORD, lambda x: fold(x) / F.lit(float(WORD)))


def uniform_sql(seed: int, stream: int, row: str) -> str:
    """``uniform`` for engines with 64-bit integers, xor() and >>."""
    h = f"(({row})::BIGINT % {WORD} * {SPREAD} + {(stream * 7919 + seed * 104_729) % WORD}) % {WORD}"
    for _ in range(3):
        h = f"list_transform([{h}], lambda h: (xor(h >> 16, h) * {ROUND}) % {WORD})[1]"
    return f"list_transform([{h}], lambda h: xor(h >> 16, h) / {float(WORD)!r}::DOUBLE)[1]"


@dataclass
class Source:
    """Columns by kind, each with a stream of its own."""

    seed: int
    row: Column
    streams: int = 100

    def u(self) -> Column:
        self.streams += 1
        return uniform(self.seed, self.streams, self.row)

    def gap(self, share: float, value: Column) -> Column:
        """``value``, missing in a share of rows."""
        return F.when(self.u() >= share, value)

    def one_of(self, *values) -> Column:
        return F.get(F.array(*[F.lit(v) for v in values]), F.floor(self.u() * len(values)).cast("int"))

    def measure(self, scale: float) -> Column:
        """About normal: the sum of three uniforms, centred."""
        return (self.u() + self.u() + self.u() - 1.5) * (2 * scale)


#: Share of transactions that have an identity row.
IDENTIFIED = 0.3


def accounts(seed: int, rows: int) -> tuple[Column, Column, Column]:
    """Account of a row (few trade much: the square of a uniform), its risk, and its first day before the first transaction."""
    n = max(rows // 12, 20)
    account = F.floor(F.pow(uniform(seed, 1, F.col("id")), 2) * n).cast("long")
    risk = F.pow(uniform(seed, 2, account), 8)
    return account, risk, F.floor(uniform(seed, 3, account) * 300).cast("int")


def core(spark: SparkSession, rows: int, seed: int, days: int = 90) -> DataFrame:
    """(id, account, dt, y, amount): the part of a transaction that has a story."""
    account, risk, age = accounts(seed, rows)
    df = spark.range(rows).select("id", account.alias("account"), risk.alias("risk"), age.alias("age"))
    u = lambda k: uniform(seed, k, F.col("id"))
    day = F.floor(F.col("id") * F.lit(days / max(rows, 1))).cast("long")
    second = F.floor(DAY * (u(4) + u(5)) / 2).cast("long")  # most at noon
    young = F.when(F.col("age") < 30, 2.0).otherwise(1.0)
    df = df.withColumns({"dt": DAY + day * DAY + second, "y": (u(6) < F.least(F.lit(0.6), (0.005 + 0.25 * F.col("risk")) * young)).cast("tinyint")})
    cents = F.round(100 * F.exp(2.0 + 3.5 * u(7) + F.when(F.col("y") == 1, 0.5 * u(8)).otherwise(0.0)))
    return df.withColumn("amount", cents / 100)


def core_sql(rows: int, seed: int, days: int = 90) -> str:
    """The statements of ``core`` as a list of common table expressions ending in ``core``."""
    u = lambda k, r="id": uniform_sql(seed, k, r)
    n = max(rows // 12, 20)
    return f"""a0 AS (SELECT range AS id, floor(pow({u(1, 'range')}, 2) * {n})::BIGINT AS account FROM range(0, {rows})),
a1 AS (SELECT *, pow({u(2, 'account')}, 8) AS risk, floor({u(3, 'account')} * 300)::INTEGER AS age,
  {DAY} + floor(id * {days / max(rows, 1)!r}::DOUBLE)::BIGINT * {DAY} + floor({DAY} * ({u(4)} + {u(5)}) / 2)::BIGINT AS dt FROM a0),
a2 AS (SELECT *, ({u(6)} < least(6e-1, (5e-3 + 25e-2 * risk) * CASE WHEN age < 30 THEN 2e0 ELSE 1e0 END))::INTEGER AS y FROM a1),
core AS (SELECT id, account, dt, y, round(100 * exp(2e0 + 35e-1 * {u(7)} + CASE WHEN y = 1 THEN 5e-1 * {u(8)} ELSE 0 END)) / 100 AS amount FROM a2)"""


def synthetic_tables(spark: SparkSession, rows: int = 20_000, seed: int = 1, vendor: int = 24) -> tuple[DataFrame, DataFrame]:
    """(transactions, identities) of the schema, with ``vendor`` columns V1, V2, ..."""
    df = core(spark, rows, seed)
    s = Source(seed, F.col("id"))
    acc, y = F.col("account"), F.col("y")
    own = lambda k, n: F.floor(uniform(seed, k, acc) * n)  # noqa: E731  # the same for all rows of an account
    tx = {"TransactionID": F.col("id") + 1, "isFraud": y, "TransactionDT": F.col("dt"), "TransactionAmt": F.col("amount"), "ProductCD": s.one_of("W", "W", "W", "C", "R", "H", "S")}
    tx |= {"card1": (acc + 1).cast("int"), "card2": own(11, 500).cast("double"), "card3": (100 + own(12, 4)).cast("double"), "card5": (10 * own(13, 12)).cast("double")}
    tx |= {"card4": F.when(own(14, 5) < 3, "blue").otherwise("red"), "card6": F.when(own(15, 3) < 1, "charge").otherwise("prepaid")}
    tx |= {"addr1": (own(16, 90) + 1).cast("double"), "addr2": F.lit(1.0)}
    tx |= {f"dist{i}": s.gap(0.5 + 0.2 * i, F.floor(s.u() * 1000).cast("double")) for i in (1, 2)}
    tx |= {"P_emaildomain": s.gap(0.15, s.one_of("a.example", "b.example", "c.example")), "R_emaildomain": s.gap(0.6, s.one_of("a.example", "d.example"))}
    tx |= {f"C{i}": F.floor(F.pow(s.u(), 3) * (4 + 3 * i) * (1 + y)).cast("double") for i in range(1, 15)}
    tx["D1"] = (F.floor(F.col("dt") / DAY) + F.col("age")).cast("double")
    tx |= {f"D{i}": s.gap(0.05 * i, F.floor(s.u() * 40 * i).cast("double")) for i in range(2, 16)}
    tx |= {f"M{i}": s.gap(0.25, F.when(s.u() < 0.6, "T").otherwise("F")) for i in range(1, 10)}
    shared = [s.measure(1.0) for _ in range(3)]  # vendor columns come in three families that move together
    tx |= {f"V{i}": s.gap(0.2 * (i % 3), shared[i % 3] + s.measure(0.2 * (1 + i % 4)) + 0.1 * (i % 5) * y) for i in range(1, vendor + 1)}
    ids = {"TransactionID": F.col("id") + 1, "DeviceType": s.one_of("phone", "laptop"), "DeviceInfo": s.gap(0.1, F.concat(F.lit("model "), own(17, 9).cast("string")))}
    text = {12, 15, 16, 23, 27, 28, 29, 30, 31, 33, 34, 35, 36, 37, 38}
    for i in range(1, 39):
        name = f"id_{i:02d}"
        if i == 7:
            ids[name] = F.lit(None).cast("double")  # a column without a value, which selection must drop
        elif i in text:
            ids[name] = s.gap(0.1 * (i % 3), F.concat(F.lit(f"{name} "), F.floor(s.u() * (2 + i % 4)).cast("string")))
        else:
            ids[name] = s.gap(0.1 * (i % 4), F.floor(s.u() * 10 * i).cast("double"))
    return df.select(*[c.alias(k) for k, c in tx.items()]), df.where(uniform(seed, 9, F.col("id")) < IDENTIFIED).select(*[c.alias(k) for k, c in ids.items()])
