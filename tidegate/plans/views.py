"""The driver tables under the logical schema of transactions, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegate.operators.windows import velocity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seconds(ts: str) -> Column:
    """Whole seconds of a time without zone, whatever the session's zone."""
    return F.expr(f"timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', {ts})")


def uniform(text: Column) -> Column:
    """A number in [0, 1) from the digest of a text; the same in SQL."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def txn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as transactions: id, dt, amount, y, card, product, addr, email (some null), the account uid, and two scores."""
    e = table(spark, sf_dir, "events")
    k = F.regexp_extract("props", r'"k": *(-?\d+)', 1).cast("int")
    df = e.select(F.col("event_id").alias("id"), seconds("ts").alias("dt"), F.col("value").alias("amount"), F.when(k < 4, 1).otherwise(0).alias("y"), F.col("user_id").alias("card"), F.col("event_type").alias("product"), (F.col("user_id") % 7).alias("addr"), F.when(k % 5 != 0, F.concat(F.lit("d"), (k % 5).cast("string"))).alias("email"))
    key = F.col("id").cast("string")
    score = F.lit(0.7) * uniform(key) + F.lit(0.3) * F.col("y")
    other = F.lit(0.8) * uniform(F.concat(F.lit("b"), key)) + F.lit(0.2) * F.col("y")
    uid = F.concat_ws("|", "card", "product", F.coalesce("email", F.lit("nan")))
    return df.withColumns({"uid": uid, "score": score, "score_b": other})


def raw_columns(df: DataFrame) -> DataFrame:
    """``txn`` with the raw columns that entity keys, linkage and the feature plan read, made from what it has."""
    c = F.col
    return df.withColumns({
        "card1": c("card").cast("int"), "card2": (c("card") % 40 + 100).cast("double"), "card3": F.lit(150.0), "card4": c("product"), "card5": (c("card") % 3 + 200).cast("float"),
        "card6": F.when(c("card") % 4 == 0, "credit").otherwise("debit"), "addr1": F.when(c("addr") != 3, c("addr").cast("double")), "D1": F.when(c("id") % 5 != 0, (c("card") % 9).cast("double")),
        "DeviceInfo": c("email"), "id_30": F.when(c("addr") != 3, c("addr").cast("string")), "id_31": F.concat(F.lit("b"), (c("card") % 3).cast("string")), "id_33": c("product"),
        "P_emaildomain": F.when(c("id") % 4 != 0, F.concat(F.lit("p"), (c("id") % 6).cast("string"))), "R_emaildomain": c("email"),
    })


RAW = """
raw AS (
  SELECT *, card || '|' || (100 + card % 40) || '|150|' || product || '|' || (200 + card % 3) || '|' || CASE WHEN card % 4 = 0 THEN 'credit' ELSE 'debit' END AS card_key,
         CASE WHEN addr <> 3 THEN addr END AS addr1, CASE WHEN id % 5 <> 0 THEN (floor(dt / 86400) - card % 9)::BIGINT END AS d1n, email AS device_info,
         CASE WHEN addr <> 3 THEN addr::VARCHAR END AS id_30, 'b' || (card % 3) AS id_31, CASE WHEN id % 4 <> 0 THEN 'p' || (id % 6) END AS p_email, email AS r_email,
         CASE WHEN email IS NOT NULL THEN email || '|' || CASE WHEN addr = 3 THEN 'nan' ELSE addr::VARCHAR END || '|b' || (card % 3) || '|' || product END AS device_fp
  FROM txn
)"""


def with_history(df: DataFrame) -> DataFrame:
    """``df`` with prior_cnt and tenure of its account."""
    return velocity(df, "uid", windows={"24h": 86_400}, prefix="").select(*df.columns, "prior_cnt", F.col("tenure_days").alias("tenure"))


TXN = r"""
txn AS (
  SELECT *, card || '|' || product || '|' || coalesce(email, 'nan') AS uid, 7e-1 * (('0x' || substr(md5(id::VARCHAR), 1, 8))::BIGINT / 4294967296e0) + 3e-1 * y AS score,
         8e-1 * (('0x' || substr(md5('b' || id::VARCHAR), 1, 8))::BIGINT / 4294967296e0) + 2e-1 * y AS score_b
  FROM (
    SELECT event_id AS id, floor(epoch(ts))::BIGINT AS dt, value AS amount, CASE WHEN k < 4 THEN 1 ELSE 0 END AS y, user_id AS card,
           event_type AS product, user_id % 7 AS addr, CASE WHEN k % 5 <> 0 THEN 'd' || (k % 5)::VARCHAR END AS email
    FROM (SELECT *, regexp_extract(props, '"k": *(-?[0-9]+)', 1)::INTEGER AS k FROM events)
  )
)"""

#: txn with split, and its parts.
SPLIT = TXN + r""",
pos AS (SELECT *, row_number() OVER (ORDER BY dt, id) AS rn, count(*) OVER () AS n FROM txn),
cut AS (SELECT max(CASE WHEN rn = round(n * 7e-1) THEN dt END) AS t1, max(CASE WHEN rn = round(n * 85e-2) THEN dt END) AS t2 FROM pos),
s AS (SELECT pos.*, CASE WHEN dt <= t1 THEN 'train' WHEN dt <= greatest(t1, t2) THEN 'valid' ELSE 'test' END AS split FROM pos, cut),
tr AS (SELECT * FROM s WHERE split = 'train'), va AS (SELECT * FROM s WHERE split = 'valid'), te AS (SELECT * FROM s WHERE split = 'test')"""



def stats_sql(name: str, grid: str, rows: str, score: str = "score") -> str:
    """Per threshold of ``grid``: rows at or above it and their sums."""
    return f"""
{name} AS (
  SELECT t, count(id) AS k, count(CASE WHEN y = 1 THEN 1 END) AS fc, count(CASE WHEN y = 0 THEN 1 END) AS lc,
         coalesce(sum(CASE WHEN y = 1 THEN amount END), 0) AS fa, coalesce(sum(CASE WHEN y = 0 THEN amount END), 0) AS la
  FROM {grid} LEFT JOIN {rows} ON {score} >= t GROUP BY t
)"""


def grid_sql(rows: str, name: str, n_quantiles: int = 2000, n_linear: int = 1001, score: str = "score") -> str:
    """The thresholds of ``threshold_grid`` rounded to 9 digits."""
    even = f" UNION ALL SELECT i / {n_linear - 1}e0 FROM range(0, {n_linear}) AS r3(i)" if n_linear else ""
    return f"""
{name}o AS (SELECT {score} AS score, row_number() OVER (ORDER BY {score}) - 1 AS i FROM {rows}),
{name}p AS (
  SELECT p * ((SELECT count(*) FROM {rows}) - 1) AS pos FROM (
    SELECT i / {n_quantiles - 1}e0 AS p FROM range(0, {n_quantiles}) AS r1(i)
    UNION ALL SELECT greatest(0e0, least(1e0, 1e0 - pow(10e0, 5e0 * i / {n_quantiles - 1}e0 - 5e0))) FROM range(0, {n_quantiles}) AS r2(i)
  )
),
{name} AS (
  SELECT DISTINCT round(t, 9) AS t FROM (
    SELECT lo.score + (pos - floor(pos)) * (hi.score - lo.score) AS t FROM {name}p JOIN {name}o lo ON lo.i = floor(pos)::BIGINT JOIN {name}o hi ON hi.i = ceil(pos)::BIGINT
    UNION ALL SELECT 'infinity'::DOUBLE{even}
  )
)"""


def pair_sql(stats: str, pairs: str, best: str) -> str:
    """Feasible pairs within the capacity, and the best of them."""
    return f"""
{pairs} AS (
  SELECT r.t AS rt, d.t AS dt, r.k - d.k AS rev, d.fa + 85e-2 * (r.fa - d.fa) - 2e-2 * d.la - 10e0 * d.lc - 5e0 * (r.k - d.k) AS nb
  FROM {stats} r, {stats} d, lim WHERE r.t <= d.t AND r.k >= d.k AND r.k - d.k <= lim
),
{best} AS (SELECT rt AS t_review, dt AS t_decline, rev, nb FROM {pairs} WHERE nb >= (SELECT max(nb) FROM {pairs}) - 1e-9 ORDER BY rev, dt DESC, rt LIMIT 1)"""


#: Thresholds of the validation split (grid, pgrid; bgrid of the second score) and of the test split (tgrid), and their sums.
GRIDS = SPLIT + "," + grid_sql("va", "grid") + "," + stats_sql("st", "grid", "va") + "," + grid_sql("va", "pgrid", 200, 0) + "," + stats_sql("sp", "pgrid", "va") + "," + grid_sql("va", "bgrid", 200, 0, "score_b") + "," + stats_sql("sb", "bgrid", "va", "score_b") + "," + grid_sql("te", "tgrid")

#: The policies chosen on validation, and the decisions on test.
CHOSEN = GRIDS + r""",
nb AS (SELECT *, fa - 2e-2 * la - 10e0 * lc AS nb FROM st),
prof AS (SELECT max(t) AS t_profit FROM nb WHERE nb >= (SELECT max(nb) FROM nb) - 1e-9),
sc AS (SELECT score, sum(y) AS p, count(*) AS c FROM va GROUP BY score),
cu AS (SELECT score, sum(p) OVER w AS tp, sum(c) OVER w AS k, sum(p) OVER () AS pa, sum(c) OVER () AS na FROM sc WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
you AS (SELECT score AS t_youden FROM cu ORDER BY tp * (na - pa) - (k - tp) * pa DESC, score LIMIT 1),
cap AS (SELECT 1e-2 * count(*) / ((max(dt) - min(dt)) / 86400e0) AS cap FROM tr),
lim AS (SELECT cap * (max(dt) - min(dt)) / 86400e0 AS lim FROM va, cap GROUP BY cap),""" + pair_sql("sp", "pr", "pair") + "," + pair_sql("sb", "prb", "pairb") + r""",
past AS (SELECT id, count(*) OVER w AS prior_cnt, min(dt) OVER w AS first_dt FROM s WINDOW w AS (PARTITION BY uid ORDER BY dt RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
hist AS (SELECT te.*, prior_cnt, coalesce((dt - first_dt) / 86400e0, 0) AS tenure FROM te JOIN past USING (id)),
p90 AS (SELECT quantile_cont(amount, 0.9) AS thr FROM tr),
dec AS (
  SELECT hist.*, CASE WHEN amount > thr AND prior_cnt = 0 THEN 2 ELSE 0 END AS d_rules, 0 AS d_approve_all, CASE WHEN score >= t_youden THEN 2 ELSE 0 END AS d_youden_single,
         CASE WHEN score >= t_profit THEN 2 ELSE 0 END AS d_profit_single,
         CASE WHEN score >= pair.t_decline THEN 2 WHEN score >= pair.t_review THEN 1 ELSE 0 END AS d_profit_three_way,
         CASE WHEN score_b >= pairb.t_decline THEN 2 WHEN score_b >= pairb.t_review THEN 1 ELSE 0 END AS d_no_velocity_three_way
  FROM hist, p90, prof, you, pair, pairb
)"""
