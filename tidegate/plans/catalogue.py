"""The registered queries of the decision engine and their SQL.

Doubles are rounded on both sides, since sums depend on their order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegate.functions import keys
from tidegate.functions.costs import CostParams, decide, row_benefit, row_cost
from tidegate.models import gbt, trees
from tidegate.operators import bootstrap, drift, encoding, metrics, ordered, policy, profile, selection, sensitivity, split, swap, windows
from tidegate.operators import thresholds as th
from tidegate.plans import decision, features, views
from tidegate.plans.views import CHOSEN, RAW, SPLIT, TXN, grid_sql, pair_sql, raw_columns, stats_sql, table, txn
from tidegate.reporting import figures
from tidegate.sources import synthetic
from tidegate.sources.tables import enrich

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
P = CostParams()


def query(sql: str | None = None, digits: int = 6, money: int = 4):
    """Register a query and its SQL; doubles are rounded, money (columns named for it) to hundredths of a cent, beyond which margins of cents don't reach, and thresholds as their grids are.  An infinite threshold shows as null."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return rounded(f(spark, sf_dir), digits, money)

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__] = run
        if sql is not None:
            ORACLES[f.__name__] = sql.strip()
        return f

    return add


MONEY = ("amount", "cost", "benefit", "loss", "amt_1h", "amt_24h", "amt_7d", "amount_total")


def rounded(df: DataFrame, digits: int, money: int) -> DataFrame:
    out = {}
    for name, kind in df.dtypes:
        if kind in ("double", "float"):
            cents = any(w in name for w in MONEY) and "rate" not in name and "share" not in name
            value = F.col(name).cast("double")
            places = 8 if name.endswith("tenure_days") else money if cents else digits
            if name == "t" or name.startswith("t_"):
                places, value = decision.DIGITS, F.when(value < F.lit(th.INF), value)
            out[name] = F.round(value, places) + F.lit(0.0)
    return df.withColumns(out)


# ---- splits, keys, windows ------------------------------------------------


@query("WITH" + SPLIT + " SELECT id, split FROM s")
def time_split(spark, d):
    return split.time_split(txn(spark, d)).select("id", "split")


@query("WITH" + SPLIT + """ SELECT split, count(*) AS n, sum(y)::BIGINT AS n_fraud, round(avg(y), 6) AS fraud_rate, min(dt) AS dt_min, max(dt) AS dt_max,
round(sum(CASE WHEN y = 1 THEN amount ELSE 0 END), 4) AS fraud_amount, round(sum(amount), 4) AS amount, round((max(dt) - min(dt)) / 86400e0, 6) AS days,
CASE split WHEN 'train' THEN 0 WHEN 'valid' THEN 1 ELSE 2 END AS ord FROM s GROUP BY split""")
def split_summary(spark, d):
    return split.split_summary(split.time_split(txn(spark, d)))


_VEL = """ SELECT id, count(*) OVER h AS vel_cnt_1h, round(coalesce(sum(amount) OVER h, 0), 4) AS vel_amt_1h, count(*) OVER e AS vel_cnt_24h, round(coalesce(sum(amount) OVER e, 0), 4) AS vel_amt_24h,
count(*) OVER w AS vel_cnt_7d, round(coalesce(sum(amount) OVER w, 0), 4) AS vel_amt_7d, dt - max(dt) OVER p AS vel_secs_since_prev, count(*) OVER p AS vel_prior_cnt,
round(coalesce((dt - min(dt) OVER p) / 86400e0, 0), 8) AS vel_tenure_days,
CASE WHEN count(*) OVER w > 0 THEN round(amount / nullif(sum(amount) OVER w / count(*) OVER w, 0), 6) END AS vel_amt_vs_mean_7d
FROM txn WINDOW h AS (PARTITION BY card ORDER BY dt RANGE BETWEEN 3600 PRECEDING AND 1 PRECEDING), e AS (PARTITION BY card ORDER BY dt RANGE BETWEEN 86400 PRECEDING AND 1 PRECEDING),
w AS (PARTITION BY card ORDER BY dt RANGE BETWEEN 604800 PRECEDING AND 1 PRECEDING), p AS (PARTITION BY card ORDER BY dt RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""
_VEL_COLS = ["id", *[f"vel_{k}_{w}" for w in windows.WINDOWS for k in ("cnt", "amt")], "vel_secs_since_prev", "vel_prior_cnt", "vel_tenure_days", "vel_amt_vs_mean_7d"]


@query("WITH" + TXN + _VEL)
def velocity_full(spark, d):
    return windows.velocity(txn(spark, d), "card").select(*_VEL_COLS)


@query("WITH" + TXN + _VEL)
def velocity_split_keys(spark, d):
    """The form for keys with too many rows for one task."""
    return windows.velocity_split(txn(spark, d), "card").select(*_VEL_COLS)


_ORDERS = "WITH txn AS (SELECT o_orderkey AS id, floor(epoch(o_orderdate))::BIGINT AS dt, o_totalprice AS amount, o_custkey AS card FROM orders)"


@query(_ORDERS + _VEL)
def velocity_orders_ties(spark, d):
    """Day-grain times: many rows share a second."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), views.seconds("o_orderdate").alias("dt"), F.col("o_totalprice").alias("amount"), F.col("o_custkey").alias("card"))
    return windows.velocity(o, "card").select(*_VEL_COLS)


def _linkage_sql(specs) -> str:
    """Different values seen with a key strictly before, plus one if the row's own is new."""
    pairs = ", ".join(f"min(dt) OVER (PARTITION BY {k}, {o}) AS f{i}, row_number() OVER (PARTITION BY {k}, {o} ORDER BY dt, id) AS n{i}" for i, (_, k, o) in enumerate(specs))
    cols = ", ".join(
        f"CASE WHEN {k} IS NOT NULL THEN (coalesce(sum(CASE WHEN n{i} = 1 AND {o} IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY {k} ORDER BY dt RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + CASE WHEN {o} IS NOT NULL AND f{i} >= dt THEN 1 ELSE 0 END)::BIGINT END AS {name}"
        for i, (name, k, o) in enumerate(specs)
    )
    return f"WITH{TXN},{RAW}, f AS (SELECT *, {pairs} FROM raw) SELECT id, {cols} FROM f"


_SQL_NAMES = {"DeviceInfo": "device_info", "P_emaildomain": "p_email", "R_emaildomain": "r_email"}


def _raw_keys(spark, d):
    """Transactions with the raw columns, their keys and the device's fingerprint."""
    return keys.add_keys(raw_columns(txn(spark, d)).drop("uid"), dt="dt").withColumn("device_fp", keys.device_fingerprint())


@query(_linkage_sql([(n, *[_SQL_NAMES.get(c, c) for c in (k, o)]) for n, k, o in windows.LINKAGE]))
def linkage(spark, d):
    """The default list of linkage features."""
    out = windows.linkage_features(_raw_keys(spark, d))
    return out.select("id", *[n for n, *_ in windows.LINKAGE])


@query("WITH" + TXN + """, f AS (SELECT *, min(dt) OVER (PARTITION BY addr, card) AS f1, row_number() OVER (PARTITION BY addr, card ORDER BY dt, id) AS n1 FROM txn)
SELECT id, (coalesce(sum(CASE WHEN n1 = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY addr ORDER BY dt RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + CASE WHEN f1 >= dt THEN 1 ELSE 0 END)::BIGINT AS cards_per_addr FROM f""")
def linkage_split_keys(spark, d):
    """The form for keys with too many rows for one task."""
    return windows.distinct_before_split(txn(spark, d), "addr", "card", name="cards_per_addr").select("id", "cards_per_addr")


@query("WITH" + TXN + "," + RAW + " SELECT id, card_key, card_key || '|' || coalesce(addr1::VARCHAR, 'nan') || '|' || coalesce(d1n::VARCHAR, 'nan') AS uid, device_fp FROM raw")
def card_key_uid(spark, d):
    return _raw_keys(spark, d).select("id", "card_key", "uid", "device_fp")


@query("WITH" + TXN + """, f AS (SELECT *, CASE WHEN card % 10 = 0 THEN card + 5e-1 ELSE card END AS card2 FROM txn),
g AS (SELECT id, CASE WHEN (SELECT bool_and(card2 = floor(card2)) FROM f) THEN card2::BIGINT::VARCHAR ELSE card2::VARCHAR END AS token2, addr FROM f)
SELECT id, '1|' || token2 || '|150|a|2|b' AS card_key, '1|' || token2 || '|150|a|2|b|' || addr || '|0' AS uid FROM g""")
def keys_of_fractions(spark, d):
    """One fraction in a column makes all its tokens show theirs: 12.0 and 12.5, not 12 twice."""
    c = F.col("card")
    t = txn(spark, d).drop("uid").withColumns({"card1": F.lit(1), "card2": F.when(c % 10 == 0, c + 0.5).otherwise(c.cast("double")), "card3": F.lit(150.0), "card4": F.lit("a"), "card5": F.lit(2.0), "card6": F.lit("b"), "addr1": F.col("addr").cast("double"), "D1": F.floor(F.col("dt") / 86_400).cast("double")})
    return keys.add_keys(t, dt="dt").select("id", "card_key", "uid")


@query("WITH" + TXN + """ SELECT id, round(((round_even(amount * 1000, 0) % 1000) / 1000e0)::FLOAT::DOUBLE, 4) AS cents, (floor(dt / 3600)::BIGINT % 24)::INTEGER AS hour_proxy, floor(dt / 86400)::BIGINT AS day FROM txn""")
def derived_scalars(spark, d):
    return txn(spark, d).select("id", F.round(keys.amount_fraction("amount").cast("double"), 4).alias("cents"), keys.hour_of_day("dt").alias("hour_proxy"), keys.relative_day("dt").alias("day"))


# ---- encoding and folds ---------------------------------------------------


@query("WITH" + SPLIT + """, i AS (SELECT *, coalesce(email, '__nan__') AS x, ceil(rn * 5e0 / (SELECT count(*) FROM tr))::INTEGER - 1 AS f FROM tr),
pf AS (SELECT a.f, (sum(b.y) * 1e0) / count(*) AS p FROM (SELECT DISTINCT f FROM i) a JOIN i b ON a.f <> b.f GROUP BY a.f),
cf AS (SELECT a.f, b.x, sum(b.y) AS s, count(*) AS n FROM (SELECT DISTINCT f FROM i) a JOIN i b ON a.f <> b.f GROUP BY 1, 2),
pp AS (SELECT avg(y) AS p FROM tr), cc AS (SELECT coalesce(email, '__nan__') AS x, sum(y) AS s, count(*) AS n FROM tr GROUP BY 1)
SELECT i.id, i.split, round(CASE WHEN cf.n IS NULL THEN pf.p ELSE (cf.s + 50 * pf.p) / (cf.n + 50) END, 6) AS te_email FROM i JOIN pf ON pf.f = i.f LEFT JOIN cf ON cf.f = i.f AND cf.x = i.x
UNION ALL SELECT s.id, s.split, round(CASE WHEN cc.n IS NULL THEN pp.p ELSE (cc.s + 50 * pp.p) / (cc.n + 50) END, 6) FROM s JOIN pp ON true LEFT JOIN cc ON cc.x = coalesce(s.email, '__nan__') WHERE s.split <> 'train'""")
def target_encoding(spark, d):
    """Training rows out of fold, others by all training rows; missing is a category."""
    out = encoding.target_encode(split.time_split(txn(spark, d)), {"email": encoding.category("email")})
    return out.select("id", "split", "te_email")


@query("WITH" + SPLIT + ", v AS (SELECT card FROM tr GROUP BY card HAVING count(*) >= 20) SELECT s.id, CASE WHEN s.card % 10 = 0 THEN NULL WHEN v.card IS NULL THEN '__other__' ELSE s.card::VARCHAR END AS card_cat FROM s LEFT JOIN v ON v.card = s.card AND s.card % 10 <> 0")
def vocabulary(spark, d):
    t = split.time_split(txn(spark, d)).withColumn("c", F.when(F.col("card") % 10 != 0, F.col("card").cast("string")))
    return encoding.apply_vocabulary(t, "c", encoding.fit_vocabulary(t.where("split = 'train'"), "c"), "card_cat").select("id", "card_cat")


@query("WITH" + TXN + """, p AS (SELECT *, row_number() OVER (ORDER BY dt, id) - 1 AS i, count(*) OVER () AS n FROM txn), b AS (SELECT *, ceil((i + 1) * 6e0 / n)::INTEGER - 1 AS b FROM p)
SELECT (v.b - 1) AS fold, (SELECT count(*) FROM b t WHERE t.b < v.b) AS train_n, count(*) AS valid_n, (SELECT max(dt) FROM b t WHERE t.b < v.b) AS train_last, min(dt) AS valid_first, max(dt) AS valid_last FROM b v WHERE v.b >= 1 GROUP BY v.b""")
def expanding_folds(spark, d):
    return split.expanding_folds(txn(spark, d))


# ---- profile --------------------------------------------------------------

_ENRICHED = "WITH e AS (SELECT d.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id))"


def _enriched(spark, d, check: bool = True):
    docs = table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")
    return enrich(docs, table(spark, d, "labels"), "doc_id", check)


@query(_ENRICHED + " SELECT * FROM e")
def identity_join(spark, d):
    return _enriched(spark, d).select("doc_id", "lang", "source", "n_chars", "quality", "toxic")


@query(_ENRICHED + " " + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", round(avg(CASE WHEN {c} IS NULL THEN 1e0 ELSE 0 END), 6) AS missing_rate FROM e" for c in ("doc_id", "lang", "source", "n_chars", "quality", "toxic")))
def missingness(spark, d):
    return profile.missingness(_enriched(spark, d), ["doc_id", "lang", "source", "n_chars", "quality", "toxic"])


@query(_ENRICHED + " " + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS n_distinct FROM e" for c in ("doc_id", "lang", "source", "n_chars", "quality", "toxic")))
def cardinality(spark, d):
    return profile.cardinality(_enriched(spark, d), ["doc_id", "lang", "source", "n_chars", "quality", "toxic"])


@query("WITH" + TXN + ", m AS (SELECT min(floor(dt / 86400)) AS d0 FROM txn) SELECT floor((floor(dt / 86400) - d0) / 30)::BIGINT AS period, count(*) AS n, round(avg(y), 6) AS fraud_rate, min(dt) AS dt_min, max(dt) AS dt_max FROM txn, m GROUP BY 1")
def class_balance_period(spark, d):
    return profile.class_balance_by_period(txn(spark, d))


@query("WITH" + TXN + " SELECT count(*) AS n_rows, 11 AS n_cols, sum(y)::BIGINT AS n_fraud, round(avg(y), 6) AS fraud_rate, round((max(dt) - min(dt)) / 86400e0, 6) AS span_days, round(avg(CASE WHEN email IS NOT NULL THEN 1e0 ELSE 0 END), 6) AS identity_match_rate FROM txn")
def dataset_scalars(spark, d):
    return profile.scalars(txn(spark, d), identity="email")


# ---- selection ------------------------------------------------------------

_LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("WITH l AS (SELECT *, CASE WHEN l_linenumber <> 3 THEN l_tax END AS tax_n, 1e0 AS one FROM lineitem) " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round({'max(NULL::DOUBLE)' if b == 'one' else f'corr({a}, {b})'}, 6) AS corr FROM l" for a, b in (("l_quantity", "l_extendedprice"), ("l_quantity", "l_discount"), ("l_extendedprice", "tax_n"), ("l_quantity", "one"))))
def correlation_pairs(spark, d):
    li = table(spark, d, "lineitem").withColumns({"tax_n": F.when(F.col("l_linenumber") != 3, F.col("l_tax")), "one": F.lit(1.0)})
    return selection.correlations(li, [("l_quantity", "l_extendedprice"), ("l_quantity", "l_discount"), ("l_extendedprice", "tax_n"), ("l_quantity", "one")])


def _auc_sql(col: str) -> str:
    return f"""SELECT '{col}' AS "column", round(abs((sum(CASE WHEN y = 1 THEN r END) - sum(y) * (sum(y) + 1) / 2e0) / (sum(y) * (count(*) - sum(y)) * 1e0) - 5e-1), 6) AS strength
FROM (SELECT y, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2e0 AS r FROM (SELECT CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y, coalesce({col}, -999) AS v FROM lineitem))"""


@query(" UNION ALL ".join(_auc_sql(c) for c in _LINE))
def auc_screen(spark, d):
    li = table(spark, d, "lineitem").withColumn("y", F.when(F.col("l_returnflag") == "R", 1).otherwise(0))
    return selection.auc_screen(li, _LINE)


# ---- ranking metrics ------------------------------------------------------

_CURVE = "WITH" + TXN + """, sc AS (SELECT {by}score, sum(y) AS p, count(*) AS c FROM {rows} GROUP BY {by}score),
cu AS (SELECT *, sum(p) OVER w AS tp, sum(c) OVER w AS k, sum(p) OVER () AS pa, sum(c) OVER () AS na FROM sc WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING))"""
_COARSE = "(SELECT id, dt, y, round(score, 2) AS score FROM txn)"


def _coarse(spark, d):
    """Scores of two decimals, so that many are tied."""
    return txn(spark, d).withColumn("score", F.round("score", 2))


_AUC = "round(sum((c - p) * (tp - p / 2e0)) / (max(pa) * (max(na) - max(pa)) * 1e0), 6) AS roc_auc, round(sum(p * tp / k::DOUBLE) / max(pa), 6) AS pr_auc"


@query(_CURVE.format(by="", rows=_COARSE) + f" SELECT max(na)::BIGINT AS n, max(pa)::BIGINT AS n_pos, {_AUC} FROM cu")
def ranking_scores(spark, d):
    return metrics.ranking_scores(_coarse(spark, d))


@query(_CURVE.format(by="", rows="txn") + ", o AS (SELECT y, row_number() OVER (ORDER BY score DESC, dt, id) AS r, count(*) OVER () AS n FROM txn), " + ", ".join(f"t{i} AS (SELECT sum(CASE WHEN r <= ceil(n * {f}) THEN y END) / max(ceil(n * {f})) AS p, sum(CASE WHEN r <= ceil(n * {f}) THEN y END) / (sum(y) * 1e0) AS q FROM o)" for i, f in ((1, "1e-2"), (5, "5e-2"))) + f" SELECT max(na)::BIGINT AS n, max(pa)::BIGINT AS n_pos, {_AUC}, " + ", ".join(f"round((SELECT p FROM t{i}), 6) AS precision_at_{i}pct, round((SELECT q FROM t{i}), 6) AS recall_at_{i}pct" for i in (1, 5)) + " FROM cu")
def ranking_metrics(spark, d):
    return metrics.ranking_metrics(txn(spark, d))


@query("WITH" + TXN + ", o AS (SELECT id, y, row_number() OVER (ORDER BY round(score, 2) DESC, dt, id) AS r FROM txn) SELECT 250::BIGINT AS k, round(sum(y) / 250e0, 6) AS precision, round(sum(y) / ((SELECT sum(y) FROM txn) * 1e0), 6) AS recall FROM o WHERE r <= 250")
def precision_recall_topk(spark, d):
    return metrics.precision_recall_at(_coarse(spark, d), k=250)


@query(_CURVE.format(by="", rows=_COARSE) + " SELECT score AS threshold, round(tp / (pa * 1e0), 6) AS tpr, round((k - tp) / ((na - pa) * 1e0), 6) AS fpr FROM cu")
def roc_curve(spark, d):
    return metrics.roc_curve(_coarse(spark, d))


@query(_CURVE.format(by="", rows=_COARSE) + " SELECT score AS threshold, round(tp / (k * 1e0), 6) AS precision, round(tp / (pa * 1e0), 6) AS recall FROM cu")
def pr_curve(spark, d):
    return metrics.pr_curve(_coarse(spark, d))


@query(_CURVE.format(by="", rows=_COARSE) + " SELECT score AS t_youden FROM cu ORDER BY tp * (na - pa) - (k - tp) * pa DESC, score LIMIT 1")
def youden(spark, d):
    return metrics.youden_threshold(_coarse(spark, d))


# ---- thresholds and policies ----------------------------------------------

_COST = "CASE WHEN {d} = 1 THEN 5e0 + CASE WHEN y = 1 THEN (1 - 85e-2) * amount ELSE 0 END WHEN {d} = 0 AND y = 1 THEN amount WHEN {d} = 2 AND y = 0 THEN 2e-2 * amount + 10e0 ELSE 0 END"


_T = "CASE WHEN t < 'infinity'::DOUBLE THEN t END AS t"


@query("WITH" + TXN + "," + grid_sql("txn", "grid") + "," + stats_sql("st", "grid", "txn") + f""", a AS (SELECT count(*) AS n, sum(y) AS p, sum(CASE WHEN y = 1 THEN amount ELSE 0 END) AS fa FROM txn)
SELECT {_T}, k AS n_declined, round(k / (n * 1e0), 8) AS decline_rate, round(a.fa - (st.fa - 2e-2 * la - 10e0 * lc), 4) AS cost, round(st.fa - 2e-2 * la - 10e0 * lc, 4) AS net_benefit, round((st.fa - 2e-2 * la - 10e0 * lc) * 1000 / n, 4) AS net_benefit_per_1000,
round(fc / (p * 1e0), 8) AS tpr, round(lc / ((n - p) * 1e0), 8) AS fpr, round(st.fa / a.fa, 8) AS fraud_capture_dollars FROM st, a""", digits=8)
def single_sweep(spark, d):
    t = txn(spark, d)
    return th.single_sweep(th.cum_stats(t, decision.full_grid(t)), P)


@query("WITH" + TXN + "," + grid_sql("txn", "grid") + "," + stats_sql("st", "grid", "txn") + ", nb AS (SELECT t, fa - 2e-2 * la - 10e0 * lc AS nb FROM st) SELECT max(t) AS t_profit FROM nb WHERE nb >= (SELECT max(nb) FROM nb) - 1e-9")
def profit_optimal(spark, d):
    t = txn(spark, d)
    return th.profit_optimal(th.single_sweep(th.cum_stats(t, decision.full_grid(t)), P))


@query("WITH" + TXN + "," + grid_sql("txn", "grid") + f" SELECT {_T} FROM grid")
def threshold_grid(spark, d):
    """Even and upper-tail quantiles, the even grid, and infinity."""
    return th.threshold_grid(txn(spark, d), digits=decision.DIGITS)


@query("WITH" + TXN + f" SELECT unnest(range(0, 101))::INTEGER AS i, round(unnest(quantile_cont(score, {[i / 100 for i in range(101)]})), 6) AS q FROM txn")
def score_quantiles(spark, d):
    return ordered.quantiles(txn(spark, d), "score", [i / 100 for i in range(101)])


@query("WITH" + CHOSEN + " SELECT t_review, t_decline, round(nb, 4) AS net_benefit, rev AS n_reviews FROM pair")
def three_way(spark, d):
    train, valid, _ = decision.parts(decision.split_table(spark, d, False))
    limit = policy.max_reviews_per_day(train).join(F.broadcast(policy.split_days(valid))).select(F.col("cap") * F.col("days"))
    return th.three_way(th.cum_stats(valid, decision.full_pair_grid(valid)), P, limit).select("t_review", "t_decline", "net_benefit", "n_reviews")


@query("WITH" + SPLIT + f", b AS (SELECT CASE WHEN score >= 8e-1 THEN 2 WHEN score >= 6e-1 THEN 1 ELSE 0 END AS d, y, amount FROM te) SELECT round(sum(CASE WHEN y = 1 THEN amount ELSE 0 END - {_COST.format(d='d')}), 4) AS net_benefit FROM b")
def pair_net_benefit(spark, d):
    return th.pair_net_benefit(decision.parts(split.time_split(txn(spark, d)))[2], 0.6, 0.8, P)


@query("WITH" + CHOSEN + " SELECT round(t_youden, 9) AS t_youden, t_profit, t_review, t_decline, round(cap, 6) AS cap FROM you, prof, pair, cap")
def select_policies(spark, d):
    return decision.decided(spark, d).chosen

@query("WITH" + CHOSEN + f" SELECT id, d_profit_three_way AS decision, round({_COST.format(d='d_profit_three_way')}, 4) AS cost, round(CASE WHEN y = 1 THEN amount ELSE 0 END - {_COST.format(d='d_profit_three_way')}, 4) AS benefit FROM dec")
def row_costs(spark, d):
    t = decision.decided(spark, d).test
    return t.select("id", F.col("dec_profit_three_way").cast("int").alias("decision"), row_cost("dec_profit_three_way", "y", "amount", P).alias("cost"), row_benefit("dec_profit_three_way", "y", "amount", P).alias("benefit"))


def _summary_sql(name: str, i: int) -> str:
    d = f"d_{name}"
    return f"""SELECT '{name}' AS policy, count(*) AS n, round(sum(c), 4) AS total_cost, round(sum(CASE WHEN y = 1 THEN amount ELSE 0 END), 4) AS approve_all_cost,
round(sum(CASE WHEN y = 1 THEN amount ELSE 0 END - c), 4) AS net_benefit, round(sum(CASE WHEN y = 1 THEN amount ELSE 0 END - c) * 1000 / count(*), 4) AS net_benefit_per_1000,
round(avg(CASE WHEN d = 2 THEN 1e0 ELSE 0 END), 6) AS decline_rate, round(avg(CASE WHEN d = 1 THEN 1e0 ELSE 0 END), 6) AS review_rate,
round(avg(CASE WHEN y = 0 THEN CASE WHEN d = 2 THEN 1e0 ELSE 0 END END), 6) AS good_customer_disruption_rate, round(avg(CASE WHEN y = 0 THEN CASE WHEN d = 1 THEN 1e0 ELSE 0 END END), 6) AS good_customer_review_rate,
round(avg(CASE WHEN y = 1 THEN w END), 6) AS fraud_capture_rate_count, round(sum(CASE WHEN y = 1 THEN w * amount END) / sum(CASE WHEN y = 1 THEN amount END), 6) AS fraud_capture_rate_dollars,
round(sum(CASE WHEN y = 1 THEN c ELSE 0 END), 4) AS fraud_loss_remaining, round(sum(CASE WHEN y = 0 AND d = 2 THEN c ELSE 0 END), 4) AS false_decline_cost, round(count(CASE WHEN d = 1 THEN 1 END) * 5e0, 4) AS review_cost_total,
count(CASE WHEN d = 2 THEN 1 END) AS n_declined, count(CASE WHEN d = 1 THEN 1 END) AS n_reviewed, count(CASE WHEN d = 2 AND y = 0 THEN 1 END) AS n_false_declines,
round(count(CASE WHEN d = 1 THEN 1 END) / ((max(dt) - min(dt)) / 86400e0), 6) AS reviews_per_day, {i} AS ord
FROM (SELECT *, {d} AS d, {_COST.format(d=d)} AS c, CASE {d} WHEN 2 THEN 1e0 WHEN 1 THEN 85e-2 ELSE 0e0 END AS w FROM dec)"""


@query("WITH" + CHOSEN + " " + " UNION ALL ".join(_summary_sql(n, i + 1) for i, n in enumerate(decision.POLICIES)))
def headline_policies(spark, d):
    """Six policies in fixed order, one of them of a model without velocity features (here the second score)."""
    return policy.evaluate_policies(decision.decided(spark, d).test, P, decision.POLICIES)


@query("WITH" + CHOSEN + ", f AS (SELECT y, d_rules = 2 AS flag FROM dec), sc AS (SELECT flag::INTEGER AS score, sum(y) AS p, count(*) AS c FROM f GROUP BY 1), cv AS (SELECT *, sum(p) OVER w AS tp, sum(c) OVER w AS k, sum(p) OVER () AS pa, sum(c) OVER () AS na FROM sc WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING)) SELECT (SELECT count(*) FROM f WHERE flag) AS n_flagged, round((SELECT avg(flag::INTEGER) FROM f), 6) AS flag_rate, round((SELECT avg(y) FROM f WHERE flag), 6) AS precision, round((SELECT sum(y) FROM f WHERE flag) / (SELECT sum(y) * 1e0 FROM f), 6) AS recall, ".replace(", sc AS", ", sc2 AS").replace("FROM sc WINDOW", "FROM sc2 WINDOW") + _AUC.replace("AS roc_auc", "AS roc_auc_degenerate").replace("AS pr_auc", "AS pr_auc_degenerate") + " FROM cv")
def rules_baseline(spark, d):
    return metrics.rule_metrics(decision.decided(spark, d).test, "rules")


@query("WITH" + CHOSEN + ", o AS (SELECT y, row_number() OVER (ORDER BY score DESC, dt, id) AS r FROM dec), k AS (SELECT count(*) AS k FROM dec WHERE d_rules = 2) SELECT count(*) AS k, round(avg(y), 6) AS precision, round(sum(y) / (SELECT sum(y) * 1e0 FROM dec), 6) AS recall FROM o, k WHERE r <= k.k")
def model_at_rule_volume(spark, d):
    """The model's precision and recall at as many flags as the rules raise."""
    return metrics.at_rule_volume(decision.decided(spark, d).test, "rules")


_DAILY = ", dd AS (SELECT floor((dt - (SELECT min(dt) FROM dec)) / 86400e0)::BIGINT AS day, count(CASE WHEN d_profit_three_way = 1 THEN 1 END) AS reviews FROM dec GROUP BY 1)"


@query("WITH" + CHOSEN + _DAILY + " SELECT day, reviews FROM dd")
def reviews_per_day(spark, d):
    return policy.reviews_per_day(decision.decided(spark, d).test, "dec_profit_three_way")


@query("WITH" + CHOSEN + _DAILY + " SELECT max(reviews) AS reviews_max, round(quantile_cont(reviews, 0.95), 6) AS reviews_p95, count(CASE WHEN reviews > cap THEN 1 END) AS days_over_capacity, count(*) AS n_days FROM dd, cap")
def review_load(spark, d):
    got = decision.decided(spark, d)
    return policy.review_load(policy.reviews_per_day(got.test, "dec_profit_three_way"), got.chosen.select("cap"))


@query("WITH" + SPLIT + """, cap AS (SELECT 14e-2 * count(*) / ((max(dt) - min(dt)) / 86400e0) AS cap FROM tr), dd AS (SELECT floor((dt - (SELECT min(dt) FROM te)) / 86400e0)::BIGINT AS day, count(CASE WHEN score >= 6e-1 AND score < 8e-1 THEN 1 END) AS reviews FROM te GROUP BY 1),
o AS (SELECT day, day - row_number() OVER (ORDER BY day) AS g FROM dd, cap WHERE reviews > cap) SELECT min(day) AS first_day, max(day) AS last_day, count(*) AS length FROM o GROUP BY g HAVING count(*) >= 1""")
def capacity_breach_runs(spark, d):
    """Runs of days on which a fixed band of scores needs more reviews than 14 % of daily transactions."""
    train, _, test = decision.parts(split.time_split(txn(spark, d)))
    daily = policy.reviews_per_day(test.withColumn("dec", decide("score", 0.8, 0.6)), "dec")
    return drift.breach_runs(daily, policy.max_reviews_per_day(train, 0.14), 1)


_SHARES = ((0.005, "5e-3"), (0.01, "1e-2"), (0.02, "2e-2"))


def _capacity_sql(sh: str) -> str:
    return f"""SELECT {sh} AS share, rt AS t_review, dt_ AS t_decline, round(nb, 4) AS valid_net_benefit, round(sum(CASE WHEN y = 1 THEN amount ELSE 0 END - {_COST.format(d='d')}), 4) AS test_net_benefit, count(CASE WHEN d = 1 THEN 1 END) AS n_reviewed
FROM (SELECT te.y, te.amount, b.*, CASE WHEN score >= dt_ THEN 2 WHEN score >= rt THEN 1 ELSE 0 END AS d FROM te, (SELECT rt, dt AS dt_, nb FROM pall, lim WHERE rev <= lim * {sh} / 1e-2 AND nb >= (SELECT max(nb) FROM pall, lim WHERE rev <= lim * {sh} / 1e-2) - 1e-9 ORDER BY rev, dt DESC, rt LIMIT 1) b) GROUP BY rt, dt_, nb"""


_PALL = """, pall AS (SELECT r.t AS rt, d.t AS dt, r.k - d.k AS rev, d.fa + 85e-2 * (r.fa - d.fa) - 2e-2 * d.la - 10e0 * d.lc - 5e0 * (r.k - d.k) AS nb FROM sp r, sp d WHERE r.t <= d.t AND r.k >= d.k)"""


@query("WITH" + CHOSEN + _PALL + " " + " UNION ALL ".join(f"SELECT * FROM ({_capacity_sql(s)})" for _, s in _SHARES))
def capacity_sensitivity(spark, d):
    train, valid, test = decision.parts(decision.split_table(spark, d, False))
    return policy.capacity_sensitivity(valid, train, test, P, [s for s, _ in _SHARES], decision.full_pair_grid(valid))


def _swap_sql(name: str, cond: str) -> str:
    prods = ", ".join(f"round(avg(CASE WHEN product = '{v}' THEN 1e0 ELSE 0 END), 6) AS product_{v}" for v in ("click", "error", "purchase", "signup", "view"))
    return f"""SELECT '{name}' AS "set", count(*) AS n, round(avg(y), 6) AS fraud_rate, sum(y)::BIGINT AS n_fraud, round(sum(amount), 4) AS amount_total, round(quantile_cont(amount, 0.25), 4) AS amount_p25, round(median(amount), 4) AS amount_median,
round(quantile_cont(amount, 0.75), 4) AS amount_p75, round(quantile_cont(amount, 0.95), 4) AS amount_p95, round(median(tenure), 6) AS tenure_days_median, round(avg(CASE WHEN prior_cnt = 0 THEN 1e0 ELSE 0 END), 6) AS share_new_card, {prods} FROM dec WHERE {cond}"""


@query("WITH" + CHOSEN + " " + " UNION ALL ".join(_swap_sql(n, f"d_profit_single = {a} AND d_youden_single = {b}") for n, a, b in zip(swap.SETS, (0, 2, 2, 0), (2, 0, 2, 0), strict=True)), money=4)
def swap_sets(spark, d):
    return swap.characterise(decision.decided(spark, d).test, "dec_profit_single", "dec_youden_single")


@query("WITH" + CHOSEN + f""", b AS (SELECT y, CASE WHEN y = 1 THEN amount ELSE 0 END - {_COST.format(d='d_profit_single')} AS bp, CASE WHEN y = 1 THEN amount ELSE 0 END - {_COST.format(d='d_youden_single')} AS by_, d_profit_single AS dp, d_youden_single AS dy, dt FROM dec),
s2 AS (SELECT t, coalesce(sum(CASE WHEN y = 1 THEN amount END), 0) - 2e-2 * coalesce(sum(CASE WHEN y = 0 THEN amount END), 0) - 10e0 * count(CASE WHEN y = 0 THEN 1 END) AS nb FROM tgrid LEFT JOIN te ON score >= t GROUP BY t),
orc AS (SELECT t, nb FROM s2 WHERE nb >= (SELECT max(nb) FROM s2) - 1e-9 ORDER BY t DESC LIMIT 1)
SELECT round(max(t_profit) - max(t_youden), 6) AS threshold_gap, max(CASE WHEN orc.t < 'infinity'::DOUBLE THEN orc.t END) AS t_oracle, round(max(orc.nb) * 1000 / count(*), 4) AS oracle_net_benefit_per_1000, round(avg(bp - by_) * 1000, 4) AS left_on_table_per_1000, round(sum(bp - by_), 4) AS left_on_table_total,
round(sum(bp - by_) / ((max(dt) - min(dt)) / 86400e0), 4) AS left_on_table_per_day, round(avg(CASE WHEN dy = 2 THEN 1e0 ELSE 0 END) / greatest(avg(CASE WHEN dp = 2 THEN 1e0 ELSE 0 END), 1e-12), 6) AS decline_rate_ratio,
count(CASE WHEN dy = 2 AND y = 0 THEN 1 END) - count(CASE WHEN dp = 2 AND y = 0 THEN 1 END) AS false_declines_avoided FROM b, prof, you, orc""")
def auc_versus_profit(spark, d):
    got = decision.decided(spark, d)
    t = got.test
    out = policy.auc_versus_profit(policy.evaluate_policies(t, P), got.chosen, t, P, decision.full_grid(t), policy.split_days(t))
    return out.withColumns({c: F.round(c, 4) for c in ("left_on_table_per_1000", "left_on_table_total", "left_on_table_per_day")})


# ---- sensitivity ----------------------------------------------------------

_PARAMS = ", ".join(sensitivity.PARAMS)
_SENS = CHOSEN + ", " + ", ".join(f"c{i} AS (SELECT unnest({sensitivity.GRID[k]!r})::DOUBLE AS {k})" for i, k in enumerate(sensitivity.PARAMS)) + f""",
cells AS (SELECT * FROM c0, c1, c2, c3),
vs AS (SELECT margin_rate, churn_penalty, t, fa - margin_rate * la - churn_penalty * lc AS nb FROM st, c0, c1),
vm AS (SELECT margin_rate, churn_penalty, max(nb) AS m FROM vs GROUP BY 1, 2),
ps AS (SELECT margin_rate, churn_penalty, max(t) AS t_profit_single FROM vs JOIN vm USING (margin_rate, churn_penalty) WHERE nb >= m - 1e-9 GROUP BY 1, 2),
feas AS (SELECT r.t AS rt, d.t AS dt, r.k - d.k AS rev, d.fa AS fa_d, r.fa - d.fa AS fa_r, d.la, d.lc FROM sp r, sp d, lim WHERE r.t <= d.t AND r.k >= d.k AND r.k - d.k <= lim),
pv AS (SELECT cells.*, rt, dt, rev, fa_d + review_catch_rate * fa_r - margin_rate * la - churn_penalty * lc - review_cost * rev AS nb FROM feas, cells),
pm AS (SELECT {_PARAMS}, max(nb) AS m FROM pv GROUP BY ALL),
pb AS (SELECT *, row_number() OVER (PARTITION BY {_PARAMS} ORDER BY rev, dt DESC, rt) AS o FROM pv JOIN pm USING ({_PARAMS}) WHERE nb >= m - 1e-9),
ts AS (SELECT t, count(id) AS k, count(CASE WHEN y = 0 THEN 1 END) AS lc, coalesce(sum(CASE WHEN y = 1 THEN amount END), 0) AS fa, coalesce(sum(CASE WHEN y = 0 THEN amount END), 0) AS la FROM (SELECT t FROM grid UNION SELECT t FROM pgrid UNION SELECT t_youden FROM you) g LEFT JOIN te ON score >= t GROUP BY t),
ru AS (SELECT coalesce(sum(CASE WHEN y = 1 THEN amount END), 0) AS fa, coalesce(sum(CASE WHEN y = 0 THEN amount END), 0) AS la, count(CASE WHEN y = 0 THEN 1 END) AS lc FROM dec WHERE d_rules = 2),
nn AS (SELECT count(*) AS n FROM te),
sens AS (
  SELECT {", ".join("pb." + k for k in sensitivity.PARAMS)}, t_profit_single, rt AS t_review, pb.dt AS t_decline,
    (d.fa + pb.review_catch_rate * (r.fa - d.fa) - pb.margin_rate * d.la - pb.churn_penalty * d.lc - pb.review_cost * (r.k - d.k)) / n * 1000 AS nb1000_profit_three_way,
    (s1.fa - pb.margin_rate * s1.la - pb.churn_penalty * s1.lc) / n * 1000 AS nb1000_profit_single, (yy.fa - pb.margin_rate * yy.la - pb.churn_penalty * yy.lc) / n * 1000 AS nb1000_youden_single,
    (ru.fa - pb.margin_rate * ru.la - pb.churn_penalty * ru.lc) / n * 1000 AS nb1000_rules
  FROM pb JOIN ps USING (margin_rate, churn_penalty) JOIN ts r ON r.t = rt JOIN ts d ON d.t = pb.dt JOIN ts s1 ON s1.t = t_profit_single, you JOIN ts yy ON yy.t = t_youden, ru, nn WHERE o = 1
)"""


def _sensitivity(spark, d):
    """All 750 cells of the default grid."""
    got = decision.decided(spark, d)
    limit = got.chosen.select("cap").join(F.broadcast(policy.split_days(got.valid))).select(F.col("cap") * F.col("days"))
    return sensitivity.run(sensitivity.cost_cells(spark), got.valid, got.test, got.grid, got.pair_grid, limit, got.chosen.select("t_youden"), "rules")


def _shown(t: str) -> str:
    return f"CASE WHEN {t} < 'infinity'::DOUBLE THEN {t} END AS {t}"


@query("WITH" + _SENS + " SELECT margin_rate, churn_penalty, review_cost, review_catch_rate, " + ", ".join(map(_shown, ("t_profit_single", "t_review", "t_decline"))) + ", round(nb1000_profit_three_way, 4) AS nb1000_profit_three_way, round(nb1000_profit_single, 4) AS nb1000_profit_single, round(nb1000_youden_single, 4) AS nb1000_youden_single, round(nb1000_rules, 4) AS nb1000_rules FROM sens")
def sensitivity_grid(spark, d):
    out = _sensitivity(spark, d)
    return out.withColumns({c: F.round(c, 4) for c in out.columns if c.startswith("nb1000")})


@query("WITH" + _SENS + """, f AS (SELECT nb1000_profit_three_way >= nb1000_profit_single - 1e-9 AS a, nb1000_profit_single > nb1000_youden_single AS b, nb1000_profit_three_way > nb1000_rules AS c, nb1000_profit_three_way > 0 AS p, nb1000_youden_single > 0 AS q FROM sens)
SELECT count(*) AS n_cells, round(avg(a::INTEGER), 6) AS share_three_way_ge_single, round(avg(b::INTEGER), 6) AS share_single_gt_youden, round(avg(c::INTEGER), 6) AS share_model_gt_rules, round(avg((a AND b AND c)::INTEGER), 6) AS share_all_orderings, round(avg(p::INTEGER), 6) AS share_three_way_positive, round(avg(q::INTEGER), 6) AS share_youden_positive FROM f""")
def ranking_stability(spark, d):
    return sensitivity.ranking_stability(_sensitivity(spark, d))


def _pivot_sql(agg: str) -> str:
    return ", ".join(f"round({agg}(CASE WHEN margin_rate = {v} THEN nb1000_profit_three_way END), 4) AS c{i}" for i, v in enumerate(sensitivity.GRID["margin_rate"]))


def _pivoted(spark, d, agg):
    out = sensitivity.pivot(_sensitivity(spark, d), "churn_penalty", "margin_rate", F.col("nb1000_profit_three_way"), sensitivity.GRID["margin_rate"], agg)
    return out.withColumns({c: F.round(c, 4) for c in out.columns[1:]})


@query("WITH" + _SENS + f" SELECT churn_penalty, {_pivot_sql('avg')} FROM sens GROUP BY 1")
def sensitivity_pivot(spark, d):
    return _pivoted(spark, d, F.avg)


@query("WITH" + _SENS + f" SELECT churn_penalty, {_pivot_sql('min')} FROM sens GROUP BY 1")
def sensitivity_pivot_min(spark, d):
    return _pivoted(spark, d, F.min)


_RANGED = ("t_profit_single", "nb1000_profit_three_way", "nb1000_profit_single", "nb1000_youden_single", "nb1000_rules")


@query("WITH" + _SENS + " " + " UNION ALL ".join(f"SELECT '{c}' AS measure, round(min({c}), 4) AS least, round(max({c}), 4) AS most FROM (SELECT CASE WHEN {c} < 'infinity'::DOUBLE THEN {c} END AS {c} FROM sens)" for c in _RANGED))
def sensitivity_ranges(spark, d):
    out = _sensitivity(spark, d).withColumn("t_profit_single", F.when(F.col("t_profit_single") < F.lit(th.INF), F.col("t_profit_single")))
    return sensitivity.ranges(out, _RANGED).withColumns({c: F.round(c, 4) for c in ("least", "most")})


# ---- bootstrap ------------------------------------------------------------

_BOOT, _SEED = 1000, 7


def _weights_sql(rows: str, n: int = _BOOT) -> str:
    """(id, b, w) by the mixing rounds of ``bootstrap.poisson``."""
    word, mult = bootstrap.WORD, bootstrap.ROUND
    h = f"xor(id % {word}, ((b + 1) * {bootstrap.SPREAD} + {_SEED * bootstrap.SEEDS}) % {word})"
    w = " + ".join(f"(u >= {c!r}::DOUBLE)::INTEGER" for c in bootstrap.CUTS)
    return f""",
h0 AS (SELECT id, b, {h} AS h FROM {rows}, range(0, {n}) AS r(b)), h1 AS (SELECT id, b, xor(h >> 16, h) * {mult} % {word} AS h FROM h0), h2 AS (SELECT id, b, xor(h >> 16, h) * {mult} % {word} AS h FROM h1),
h3 AS (SELECT id, b, xor(h >> 16, h) / {float(word)!r}::DOUBLE AS u FROM h2), wt AS (SELECT id, b, {w} AS w FROM h3),
bi AS (SELECT * FROM {rows} JOIN wt USING (id) WHERE w > 0)"""


_CI = "SELECT round(quantile_cont(value, 0.025), {r}) AS ci_low, round(quantile_cont(value, 0.975), {r}) AS ci_high, count(value) AS n_boot_valid, quantile_cont(value, 0.025) > 0 OR quantile_cont(value, 0.975) < 0 AS excludes_zero FROM v"


@query("WITH" + CHOSEN + _weights_sql("dec") + f", v AS (SELECT b, 1000e0 * sum(({_COST.format(d='d_youden_single')} - ({_COST.format(d='d_profit_single')})) * w) / sum(w) AS value FROM bi GROUP BY b) " + _CI.format(r=4), digits=4)
def bootstrap_mean_diff(spark, d):
    t = policy.benefits(decision.decided(spark, d).test, P).select("id", "ben_profit_single", "ben_youden_single")
    return bootstrap.paired_bootstrap(t, lambda w: bootstrap.mean_diff(w, "ben_profit_single", "ben_youden_single", 1000), _BOOT, _SEED)


@query("WITH" + SPLIT + _weights_sql("te") + ", v AS (SELECT b, sum(CASE WHEN score >= 5e-1 THEN y * w END) / sum(CASE WHEN score >= 5e-1 THEN w END)::DOUBLE - sum(CASE WHEN score_b >= 5e-1 THEN y * w END) / sum(CASE WHEN score_b >= 5e-1 THEN w END)::DOUBLE AS value FROM bi GROUP BY b) " + _CI.format(r=6))
def bootstrap_ratio_diff(spark, d):
    t = decision.parts(split.time_split(txn(spark, d)))[2].select("id", "y", (F.col("score") >= 0.5).alias("fa"), (F.col("score_b") >= 0.5).alias("fb"))
    return bootstrap.paired_bootstrap(t, lambda w: bootstrap.ratio_diff(w, "fa", "fb", "precision"), _BOOT, _SEED)


def _weighted_ap(score: str, name: str) -> str:
    return f"""{name}s AS (SELECT b, {score} AS s, sum(y * w) AS p, sum(w) AS c FROM bi GROUP BY 1, 2),
{name}c AS (SELECT *, sum(p) OVER x AS tp, sum(c) OVER x AS k FROM {name}s WINDOW x AS (PARTITION BY b ORDER BY s DESC ROWS UNBOUNDED PRECEDING)), {name} AS (SELECT b, CASE WHEN sum(p) > 0 AND sum(c) > sum(p) THEN sum(p * tp / k::DOUBLE) / sum(p) END AS ap FROM {name}c GROUP BY b)"""


@query("WITH" + SPLIT + _weights_sql("te") + f", {_weighted_ap('score', 'wa')}, {_weighted_ap('score_b', 'wb')}, v AS (SELECT wa.ap - wb.ap AS value FROM wa JOIN wb USING (b)) " + _CI.format(r=6))
def bootstrap_metric_diff(spark, d):
    t = decision.parts(decision.split_table(spark, d, False))[2].select("id", "y", "score", "score_b")
    return bootstrap.interval(bootstrap.metric_diff(t, "score", "score_b", "pr_auc", _BOOT, _SEED), "value", _BOOT)


def _mean_ci(name: str, a: str, b: str) -> str:
    value = f"1000e0 * sum(({_COST.format(d='d_' + b)} - ({_COST.format(d='d_' + a)})) * w) / sum(w)"
    return f"""{name}v AS (SELECT b, {value} AS value FROM bi GROUP BY b),
{name} AS (SELECT (SELECT avg({_COST.format(d='d_' + b)} - ({_COST.format(d='d_' + a)})) FROM dec) > 0 AND (quantile_cont(value, 0.025) > 0 OR quantile_cont(value, 0.975) < 0) AS held FROM {name}v)"""


def _ap_sql(score: str, name: str) -> str:
    return f"""{name}s AS (SELECT {score} AS s, sum(y) AS p, count(*) AS c FROM te GROUP BY 1), {name}c AS (SELECT *, sum(p) OVER x AS tp, sum(c) OVER x AS k FROM {name}s WINDOW x AS (ORDER BY s DESC ROWS UNBOUNDED PRECEDING)), {name} AS (SELECT sum(p * tp / k::DOUBLE) / sum(p) AS ap FROM {name}c)"""


@query("WITH" + _SENS + _weights_sql("dec") + ", " + ", ".join(_mean_ci(f"c{i}x", a, b) for i, (_, a, b) in enumerate(decision.MONEY_PAIRS)) + f""", {_weighted_ap('score', 'wa')}, {_weighted_ap('score_b', 'wb')}, {_ap_sql('score', 'pa')}, {_ap_sql('score_b', 'pb2')},
v3 AS (SELECT wa.ap - wb.ap AS value FROM wa JOIN wb USING (b)),
hy3 AS (SELECT (SELECT pa.ap - pb2.ap FROM pa, pb2) > 0 AND (quantile_cont(value, 0.025) > 0 OR quantile_cont(value, 0.975) < 0) AS held FROM v3),
hy4 AS (SELECT avg((nb1000_profit_three_way >= nb1000_profit_single - 1e-9 AND nb1000_profit_single > nb1000_youden_single AND nb1000_profit_three_way > nb1000_rules)::INTEGER) >= 8e-1 AS held FROM sens)
SELECT c0x.held AS h1, c1x.held AS h2, hy3.held AS h3, hy4.held AS h4, c0x.held AND c1x.held AS success FROM c0x, c1x, hy3, hy4""")
def hypotheses(spark, d):
    """Four hypotheses and what success means, from 1,000 paired resamples and 750 cost cells."""
    got = decision.decided(spark, d)
    limit = got.chosen.select("cap").join(F.broadcast(policy.split_days(got.valid))).select(F.col("cap") * F.col("days"))
    cells = sensitivity.run(sensitivity.cost_cells(spark), got.valid, got.test, got.grid, got.pair_grid, limit, got.chosen.select("t_youden"), "rules")
    return bootstrap.hypotheses(decision.comparisons(policy.benefits(got.test, P), _BOOT, _SEED), sensitivity.ranking_stability(cells))


# ---- drift ----------------------------------------------------------------


def _psi_sql(name: str, col: str) -> str:
    return f"""{name}e AS (SELECT list_sort(list_distinct(list_transform(quantile_cont({col}, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]), lambda x: round(x, 3)))) AS e FROM tr),
{name}b AS (SELECT split, CASE WHEN {col} IS NULL THEN len(e) + 1 ELSE len(list_filter(e, lambda x: x <= {col})) END AS bin FROM s, {name}e WHERE split <> 'valid'),
{name}n AS (SELECT sum((split = 'train')::INTEGER) AS r, sum((split = 'test')::INTEGER) AS c FROM {name}b),
{name}q AS (SELECT greatest(count(CASE WHEN split = 'train' THEN 1 END) / (SELECT r FROM {name}n)::DOUBLE, 1e-4) AS e, greatest(count(CASE WHEN split = 'test' THEN 1 END) / (SELECT c FROM {name}n)::DOUBLE, 1e-4) AS a
  FROM (SELECT unnest(range(0, len(e) + 2)) AS g FROM {name}e) LEFT JOIN {name}b ON bin = g GROUP BY g)"""


_BAND = "CASE WHEN psi >= 25e-2 THEN 'significant' WHEN psi >= 1e-1 THEN 'moderate' ELSE 'stable' END"
_PSI = SPLIT + ", " + ", ".join(_psi_sql(n, c) for n, c in (("x1", "amount"), ("x2", "dt"), ("x3", "addr_n"))) + """,
cat AS (SELECT CASE WHEN email IS NULL THEN 'm' WHEN NOT EXISTS (SELECT 1 FROM tr WHERE tr.email = s.email) THEN 'u' ELSE 'v' || email END AS bin, split FROM s WHERE split <> 'valid'),
x4q AS (SELECT greatest(count(CASE WHEN split = 'train' THEN 1 END) / (SELECT count(*) FROM tr)::DOUBLE, 1e-4) AS e, greatest(count(CASE WHEN split = 'test' THEN 1 END) / (SELECT count(*) FROM te)::DOUBLE, 1e-4) AS a FROM cat GROUP BY bin),
fp AS (""" + " UNION ALL ".join(f"SELECT '{f}' AS feature, sum((a - e) * ln(a / e)) AS psi FROM {n}q" for n, f in (("x1", "amount"), ("x2", "dt"), ("x3", "addr_n"), ("x4", "email"))) + ")"
_PSI = _PSI.replace("tr AS (SELECT * FROM s", "s0 AS (SELECT 1), tr AS (SELECT * FROM s").replace("AS split FROM pos, cut)", "AS split, CASE WHEN addr <> 2 THEN addr::DOUBLE END AS addr_n FROM pos, cut)")


def _feature_psi(spark, d):
    t = split.time_split(txn(spark, d)).withColumn("addr_n", F.when(F.col("addr") != 2, F.col("addr").cast("double")))
    train, _, test = decision.parts(t)
    return drift.feature_psi(train, test, ["amount", "dt", "addr_n"], ["email"], digits=3)


@query("WITH" + _PSI + f" SELECT feature, round(psi, 6) AS psi, {_BAND} AS band FROM fp")
def feature_psi(spark, d):
    return _feature_psi(spark, d)


@query("WITH" + _PSI + f", bb AS (SELECT psi, {_BAND} AS band FROM fp) SELECT count(*) AS n_features, count(CASE WHEN band = 'significant' THEN 1 END) AS n_significant, count(CASE WHEN band = 'moderate' THEN 1 END) AS n_moderate, count(CASE WHEN band = 'stable' THEN 1 END) AS n_stable, round(max(psi), 6) AS max_psi FROM bb")
def monitor_rollup(spark, d):
    return drift.monitor_rollup(_feature_psi(spark, d))


_FAMILIES = {"amount": "money", "dt": "time", "addr_n": "place"}
_FAMILY_SQL = "CASE feature " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _FAMILIES.items()) + " ELSE 'Unknown' END"


@query("WITH" + _PSI + f", bb AS (SELECT feature, {_FAMILY_SQL} AS family, psi, {_BAND} AS band FROM fp) SELECT family, count(*) AS n, coalesce(string_agg(CASE WHEN band = 'significant' THEN feature END, ',' ORDER BY psi DESC), '') AS drifted, round(max(psi), 6) AS max_psi FROM bb GROUP BY 1")
def drift_by_family(spark, d):
    """Which features of each family drifted, worst first."""
    named = local_families(spark, _FAMILIES)
    psi = ordered.local_table(_feature_psi(spark, d))  # a row for each feature, used three times
    rolled = drift.monitor_rollup(psi, named).select(F.explode_outer("significant_features").alias("x")).select("x.feature", "x.family", "x.psi")
    lists = rolled.groupBy("family").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("psi")).alias("k"), "feature"))), lambda x: x["feature"]), ",").alias("drifted"))
    every = drift.band_by_family(psi, named).groupBy("family").agg(F.sum("n").alias("n"))
    top = psi.join(named, "feature", "left").groupBy(F.coalesce("family", F.lit("Unknown")).alias("family")).agg(F.max("psi").alias("max_psi"))
    return every.join(top, "family").join(lists, "family", "left").select("family", "n", F.coalesce("drifted", F.lit("")).alias("drifted"), "max_psi")


def local_families(spark, families):
    return ordered.local_rows(spark, list(families.items()), "feature string, family string")


@query("WITH" + SPLIT + """, ee AS (SELECT list_sort(list_distinct(list_transform(quantile_cont(score, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]), lambda x: round(x, 3)))) AS e FROM va),
w AS (SELECT te.*, floor((dt - (SELECT min(dt) FROM te)) / 86400e0)::BIGINT AS win FROM te),
rb AS (SELECT len(list_filter(e, lambda x: x <= score)) AS bin, count(*) AS n FROM va, ee GROUP BY 1), cb AS (SELECT win, len(list_filter(e, lambda x: x <= score)) AS bin, count(*) AS n FROM w, ee GROUP BY 1, 2),
sp AS (SELECT DISTINCT win, g FROM w, (SELECT unnest(range(0, len(e) + 2)) AS g FROM ee)), wn AS (SELECT win, count(*) AS n FROM w GROUP BY 1),
q AS (SELECT sp.win, greatest(coalesce(rb.n, 0) / (SELECT count(*) FROM va)::DOUBLE, 1e-4) AS e, greatest(coalesce(cb.n, 0) / wn.n::DOUBLE, 1e-4) AS a FROM sp JOIN wn ON wn.win = sp.win LEFT JOIN rb ON rb.bin = g LEFT JOIN cb ON cb.bin = g AND cb.win = sp.win),
ps AS (SELECT win, sum((a - e) * ln(a / e)) AS psi FROM q GROUP BY win),
sc AS (SELECT win, score, sum(y) AS p, count(*) AS c FROM w GROUP BY 1, 2), cu AS (SELECT *, sum(p) OVER x AS tp, sum(c) OVER x AS k FROM sc WINDOW x AS (PARTITION BY win ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
ap AS (SELECT win, CASE WHEN sum(p) > 0 AND sum(c) > sum(p) THEN sum(p * tp / k::DOUBLE) / sum(p) END AS ap FROM cu GROUP BY win)
SELECT w.win AS "window", count(*) AS n, round((min(dt) - (SELECT min(dt) FROM te)) / 86400e0, 8) AS days_from_start, round(avg(score), 8) AS mean_score, round(quantile_cont(score, 0.99), 8) AS p99_score, round(avg(CASE WHEN score >= 8e-1 THEN 1e0 ELSE 0 END), 8) AS decline_rate,
round(avg(CASE WHEN score >= 6e-1 AND score < 8e-1 THEN 1e0 ELSE 0 END), 8) AS review_rate, round(avg(y), 8) AS fraud_rate, round(max(ap.ap), 8) AS pr_auc, round(max(ps.psi), 8) AS psi, CASE WHEN max(ps.psi) >= 25e-2 THEN 'significant' WHEN max(ps.psi) >= 1e-1 THEN 'moderate' ELSE 'stable' END AS band
FROM w JOIN ap ON ap.win = w.win JOIN ps ON ps.win = w.win GROUP BY w.win""", digits=8)
def score_stability(spark, d):
    _, valid, test = decision.parts(split.time_split(txn(spark, d)))
    return drift.score_stability(valid, test, 0.8, 0.6, days=1, digits=3)


_CAP = CHOSEN + _DAILY


@query("WITH" + _CAP + """, ru AS (SELECT count(*) AS runs FROM (SELECT day - row_number() OVER (ORDER BY day) AS g FROM dd, cap WHERE reviews > cap / 2) GROUP BY g HAVING count(*) >= 2),
n AS (SELECT count(*) AS runs FROM ru), w AS (SELECT floor((dt - (SELECT min(dt) FROM te)) / 86400e0) AS win, avg((score >= 8e-1)::INTEGER) AS r FROM te GROUP BY 1)
SELECT max(abs(r - 5e-2)) > 25e-3 AS declines_moved, max(n.runs) > 0 AS over_capacity, true AS labels_young FROM w, n""")
def operating_triggers(spark, d):
    """Yes/no triggers over a day's windows, half the capacity and runs of two days."""
    got = decision.decided(spark, d)
    windows_ = drift.score_stability(got.valid, got.test, 0.8, 0.6, days=1, digits=3)
    half = got.chosen.select((F.col("cap") / 2).alias("cap"))
    runs = drift.breach_runs(policy.reviews_per_day(got.test, "dec_profit_three_way"), half, 2)
    return drift.triggers(drift.monitor_rollup(_feature_psi(spark, d)), windows_, runs, 0.05, 30).select("declines_moved", "over_capacity", "labels_young")


# ---- figures --------------------------------------------------------------


@query("WITH" + CHOSEN + ", " + stats_sql("stt", "grid", "te").strip() + """, b AS (SELECT 'valid' AS part, k / (SELECT count(*) * 1e0 FROM va) AS r, (fa - 2e-2 * la - 10e0 * lc) * 1000 / (SELECT count(*) FROM va) AS nb FROM st UNION ALL SELECT 'test', k / (SELECT count(*) * 1e0 FROM te), (fa - 2e-2 * la - 10e0 * lc) * 1000 / (SELECT count(*) FROM te) FROM stt)
SELECT DISTINCT part, round(r, 6) AS decline_rate, round(nb, 4) AS net_benefit_per_1000 FROM b WHERE r > 0""")
def figure_profit_curve(spark, d):
    _, valid, test = decision.parts(decision.split_table(spark, d, False))
    out = figures.profit_curve(valid, test, decision.full_grid(valid), P)
    return out.select("part", F.round("decline_rate", 6).alias("decline_rate"), F.round("net_benefit_per_1000", 4).alias("net_benefit_per_1000")).distinct()


@query("WITH" + CHOSEN + " " + " UNION ALL ".join(f"SELECT 'dec_{n}' AS policy, round(count(CASE WHEN y = 0 AND d_{n} = 2 THEN 1 END) / (count(CASE WHEN y = 0 THEN 1 END) * 1e0), 6) AS fpr, round(count(CASE WHEN y = 1 AND d_{n} = 2 THEN 1 END) / (count(CASE WHEN y = 1 THEN 1 END) * 1e0), 6) AS tpr FROM dec" for n in ("youden_single", "profit_single", "profit_three_way")))
def figure_cutoffs(spark, d):
    return figures.cutoffs_on_roc(decision.decided(spark, d).test, ["dec_youden_single", "dec_profit_single", "dec_profit_three_way"])


@query("WITH" + CHOSEN + """, sw AS (SELECT *, CASE WHEN d_profit_single = 0 AND d_youden_single = 2 THEN 'a_approves_b_declines' WHEN d_profit_single = 2 AND d_youden_single = 0 THEN 'a_declines_b_approves' WHEN d_profit_single = 2 AND d_youden_single = 2 THEN 'both_decline' WHEN d_profit_single = 0 AND d_youden_single = 0 THEN 'both_approve' END AS "set" FROM dec),
g AS (SELECT "set", floor(log2(greatest(amount, 1e-2)) * 2) AS step, count(*) AS n FROM sw WHERE "set" IS NOT NULL GROUP BY 1, 2)
SELECT "set", round(pow(2e0, step / 2), 6) AS low, n, round(n / sum(n) OVER (PARTITION BY "set"), 6) AS share FROM g""")
def figure_swap_amounts(spark, d):
    return figures.swap_amounts(decision.decided(spark, d).test, "dec_profit_single", "dec_youden_single")


@query("WITH" + CHOSEN + " SELECT rt AS t_review, dt AS t_decline, round(nb * 1000 / (SELECT count(*) FROM va), 4) AS net_benefit_per_1000 FROM pr WHERE rt >= 8e-1 AND dt < 'infinity'::DOUBLE")
def figure_policy_surface(spark, d):
    train, valid, _ = decision.parts(decision.split_table(spark, d, False))
    limit = policy.max_reviews_per_day(train).join(F.broadcast(policy.split_days(valid))).select(F.col("cap") * F.col("days"))
    out = figures.policy_surface(th.cum_stats(valid, decision.full_pair_grid(valid)), P, limit, 0.8)
    return out.withColumn("net_benefit_per_1000", F.round("net_benefit_per_1000", 4))


# ---- the feature plan -----------------------------------------------------

_RENAMED = {"id": "TransactionID", "dt": "TransactionDT", "amount": "TransactionAmt", "y": "isFraud", "product": "ProductCD"}
_FEATURES = {"TransactionAmt": "amount", "card1": "card", "card2": "100 + card % 40", "card3": "150", "card5": "200 + card % 3", "addr1": "addr1", "D1": "CASE WHEN id % 5 <> 0 THEN card % 9 END"}
_CLASSES = {"ProductCD": "product", "card4": "product", "card6": "CASE WHEN card % 4 = 0 THEN 'credit' ELSE 'debit' END", "P_emaildomain": "p_email", "R_emaildomain": "r_email", "DeviceInfo": "device_info", "id_30": "id_30", "id_31": "id_31", "id_33": "product"}


def _velocity_columns(key: str, col: str, w: str) -> list[str]:
    out = []
    for name, span in windows.WINDOWS.items():
        out += [f"count(*) OVER {w}{name} AS vel_{key}_cnt_{name}", f"coalesce(sum(amount) OVER {w}{name}, 0) AS vel_{key}_amt_{name}"]
    out += [f"dt - max(dt) OVER {w}p AS vel_{key}_secs_since_prev", f"count(*) OVER {w}p AS vel_{key}_prior_cnt", f"coalesce((dt - min(dt) OVER {w}p) / 86400e0, 0) AS vel_{key}_tenure_days"]
    return [*out, f"CASE WHEN count(*) OVER {w}7d > 0 THEN amount / nullif(sum(amount) OVER {w}7d / count(*) OVER {w}7d, 0) END AS vel_{key}_amt_vs_mean_7d"]


def _windows_sql(col: str, w: str) -> str:
    spans = {name: f"{span} PRECEDING" for name, span in windows.WINDOWS.items()} | {"p": "UNBOUNDED PRECEDING"}
    return ", ".join(f"{w}{n} AS (PARTITION BY {col} ORDER BY dt RANGE BETWEEN {s} AND 1 PRECEDING)" for n, s in spans.items())


def _encoded_sql(name: str, col: str) -> str:
    x = f"coalesce({col}::VARCHAR, '__nan__')"
    return f"""
{name}i AS (SELECT id, y, {x} AS x, ceil(rn * 5e0 / (SELECT count(*) FROM tr))::INTEGER - 1 AS f FROM f1 WHERE split = 'train'),
{name}f AS (SELECT f, sum(y) AS s, count(*) AS n FROM {name}i GROUP BY 1), {name}a AS (SELECT sum(s) AS s, sum(n) AS n FROM {name}f),
{name}c AS (SELECT x, f, sum(y) AS s, count(*) AS n FROM {name}i GROUP BY 1, 2), {name}t AS (SELECT x, sum(s) AS s, sum(n) AS n FROM {name}c GROUP BY 1),
{name}e AS (
  SELECT i.id, CASE WHEN t.n = c.n THEN (a.s - f.s) / (a.n - f.n) ELSE ((t.s - c.s) + 50e0 * ((a.s - f.s) / (a.n - f.n))) / (t.n - c.n + 50e0) END AS te
  FROM {name}i i JOIN {name}c c USING (x, f) JOIN {name}t t USING (x) JOIN {name}f f ON f.f = i.f, {name}a a
  UNION ALL SELECT f1.id, coalesce((t.s + 50e0 * (a.s / a.n)) / (t.n + 50e0), a.s / a.n) FROM f1 LEFT JOIN {name}t t ON t.x = {x}, {name}a a WHERE split <> 'train'
)"""


def _feature_sql() -> str:
    raw = RAW.replace("FROM txn", "FROM s")
    pairs = ", ".join(f"min(dt) OVER (PARTITION BY {k}, {o}) AS f{i}, row_number() OVER (PARTITION BY {k}, {o} ORDER BY dt, id) AS n{i}" for i, (_, k, o) in enumerate(_LINKED))
    links = ", ".join(
        f"CASE WHEN {k} IS NOT NULL THEN coalesce(sum(CASE WHEN n{i} = 1 AND {o} IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY {k} ORDER BY dt RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + CASE WHEN {o} IS NOT NULL AND f{i} >= dt THEN 1 ELSE 0 END END AS {n}"
        for i, (n, k, o) in enumerate(_LINKED)
    )
    speed = ", ".join([*_velocity_columns("card1", "card", "a"), *_velocity_columns("uid", "uid2", "u")])
    te = {"ProductCD": "product", "addr1": "addr1", "P_emaildomain": "p_email", "R_emaildomain": "r_email"}
    vocab = {c: f"(SELECT {e} AS v FROM f1 WHERE split = 'train' AND {e} IS NOT NULL GROUP BY 1 HAVING count(*) >= 20)" for c, e in _CLASSES.items()}
    numbers = [f"round(({e})::FLOAT::DOUBLE, 6) AS {c}" for c, e in _FEATURES.items()]
    classes = [f"CASE WHEN {e} IS NULL THEN NULL WHEN {e} IN {vocab[c]} THEN {e} ELSE '__other__' END AS {c}" for c, e in _CLASSES.items()]
    names = [f"vel_{k}_{n}" for k in ("card1", "uid") for n in ("cnt_1h", "amt_1h", "cnt_24h", "amt_24h", "cnt_7d", "amt_7d", "secs_since_prev", "prior_cnt", "tenure_days", "amt_vs_mean_7d")] + [n for n, *_ in _LINKED]
    places = lambda n: 8 if n.endswith("tenure_days") else 4 if "amt_1h" in n or "amt_24h" in n or "amt_7d" in n else 6
    engineered = [f"round(({n})::FLOAT::DOUBLE, {places(n)}) AS {n}" for n in names]
    cents = "round(((round_even(amount * 1000, 0) % 1000) / 1000e0)::FLOAT::DOUBLE, 6) AS amt_cents"
    encoded = [f"round(e{i}e.te::FLOAT::DOUBLE, 6) AS te_{c}" for i, c in enumerate(te)]
    cols = ", ".join(["id AS meta_TransactionID", "split AS meta_split", *numbers, *classes, cents, "(floor(dt / 3600)::BIGINT % 24)::DOUBLE AS hour_proxy", *engineered, *encoded])
    return f"""WITH{SPLIT},{raw}, f0 AS (SELECT *, card_key || '|' || coalesce(addr1::VARCHAR, 'nan') || '|' || coalesce(d1n::VARCHAR, 'nan') AS uid2, {pairs} FROM raw),
f1 AS (SELECT *, {speed}, {links} FROM f0 WINDOW {_windows_sql("card", "a")}, {_windows_sql("uid2", "u")}), {", ".join(_encoded_sql(f"e{i}", e) for i, e in enumerate(te.values()))}
SELECT {cols} FROM f1 {" ".join(f"JOIN e{i}e USING (id)" for i in range(len(te)))}"""


_LINKED = [(n, *[_SQL_NAMES.get(c, c) for c in (k, o)]) for n, k, o in windows.LINKAGE]


def _built(spark, d, **options):
    df = raw_columns(split.time_split(txn(spark, d))).drop("uid", "card", "addr", "email", "score", "score_b").withColumnsRenamed(_RENAMED)
    return features.build_features(df, features.Options(**options))


@query(_feature_sql())
def build_features(spark, d):
    """Every feature of every row by the whole feature plan."""
    out, manifest = _built(spark, d)
    return out.select("meta_TransactionID", "meta_split", *manifest.features)


def _kept_sql() -> str:
    rows = [(c, "raw", False) for c in [*_FEATURES, "amt_cents", "hour_proxy"]] + [(c, "raw", True) for c in _CLASSES]
    rows += [(f"vel_{k}_{n}", "velocity", False) for k in ("card1", "uid") for n in ("cnt_1h", "amt_1h", "cnt_24h", "amt_24h", "cnt_7d", "amt_7d", "secs_since_prev", "prior_cnt", "tenure_days", "amt_vs_mean_7d")]
    rows += [(f"te_{c}", "entity_risk", False) for c in features.ENCODED] + [(n, "linkage", False) for n, *_ in windows.LINKAGE]
    return f"SELECT * FROM (VALUES {', '.join(f'({a!r}, {b!r}, {str(c).lower()})' for a, b, c in rows)}) AS v(feature, family, categorical)"


@query(_kept_sql())
def feature_manifest(spark, d):
    return features.manifest_tables(spark, _built(spark, d)[1])[0]


@query(_kept_sql().replace("SELECT * FROM", "SELECT family, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM") + " WHERE family <> 'velocity' GROUP BY 1")
def features_without_velocity(spark, d):
    """Features by family, and their shares, of the plan without the velocity family."""
    kept = features.manifest_tables(spark, _built(spark, d, without=("velocity",))[1])[0].withColumn("one", F.lit(1))
    return profile.counts_by(kept, "family").join(profile.share_by(kept, "family", "one"), "family")


@query("SELECT * FROM (VALUES ('TransactionID'), ('TransactionDT'), ('isFraud'), ('split'), ('D1n'), ('card_key'), ('uid')) AS v(\"column\")")
def columns_except_features(spark, d):
    """Columns of the input and its keys that became no feature."""
    _, m = _built(spark, d)
    kept, dropped = features.manifest_tables(spark, m)
    return dropped.select("column").exceptAll(kept.select("feature"))


# ---- models and synthetic source (no SQL form) ----------------------------


#: A small ensemble written by hand, in the form that ``export_trees`` gives.
TREES = [
    (1.0, {"column": "vel_cnt_24h", "at": 0.5, "low": {"column": "amount", "at": 120.0, "low": -0.6, "high": 0.1}, "high": {"column": "product", "values": ["purchase", "signup"], "known": ["click", "error", "purchase", "signup", "view"], "low": 0.4, "high": -0.3}}),
    (0.5, {"column": "vel_secs_since_prev", "at": 0.5, "missing": True, "low": {"column": "vel_secs_since_prev", "at": 3600.0, "low": 0.7, "high": -0.2}, "high": 0.25}),
    (0.25, {"column": "email", "values": ["d1"], "known": ["d1", "d2", "d3"], "rest": True, "low": 0.3, "high": {"column": "vel_amt_7d", "at": 900.0, "low": -0.4, "high": 0.2}}),
]


@query("WITH" + TXN + ", v AS (SELECT *, count(*) OVER e AS vel_cnt_24h, coalesce(sum(amount) OVER w, 0) AS vel_amt_7d, dt - max(dt) OVER p AS vel_secs_since_prev FROM txn WINDOW e AS (PARTITION BY card ORDER BY dt RANGE BETWEEN 86400 PRECEDING AND 1 PRECEDING), w AS (PARTITION BY card ORDER BY dt RANGE BETWEEN 604800 PRECEDING AND 1 PRECEDING), p AS (PARTITION BY card ORDER BY dt RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))" + f" SELECT id, round(1 / (1 + exp(-2 * ({trees.margin_sql(TREES)}))), 6) AS model_score FROM v")
def tree_scores(spark, d):
    """Exported trees scored by column expressions."""
    return windows.velocity(txn(spark, d), "card").select("id", trees.probability(TREES).alias("model_score"))


@query()
def gbt_scores(spark, d):
    """Test scores of a boosted model on velocity features, with the learner's defaults, through its exported trees."""
    t = split.time_split(windows.velocity(txn(spark, d), "card"))
    spec = gbt.Spec(["amount", "vel_cnt_24h", "vel_amt_7d", "vel_secs_since_prev", "vel_tenure_days"], ["product"])
    train, _, test = decision.parts(t.select("id", "y", "split", *spec.numeric, *spec.categorical))
    model = gbt.fit(train, spec)
    return test.select("id", "y", trees.probability(trees.export_trees(model, spec)).alias("model_score"))


_ROWS, _SEED_S = 20_000, 1


@query(f"""WITH {synthetic.core_sql(_ROWS, _SEED_S)},
pos AS (SELECT *, row_number() OVER (ORDER BY dt, id) AS rn, {synthetic.uniform_sql(_SEED_S, 9, 'id')} < {synthetic.IDENTIFIED} AS known FROM core),
cut AS (SELECT max(CASE WHEN rn = round({_ROWS} * 7e-1) THEN dt END) AS t1, max(CASE WHEN rn = round({_ROWS} * 85e-2) THEN dt END) AS t2 FROM pos),
s AS (SELECT *, CASE WHEN dt <= t1 THEN 'train' WHEN dt <= greatest(t1, t2) THEN 'valid' ELSE 'test' END AS split FROM pos, cut)
SELECT split, count(*) AS n, sum(y)::BIGINT AS n_fraud, count(DISTINCT account) AS n_cards, count(CASE WHEN known THEN 1 END) AS n_identified, min(dt) AS dt_min, max(dt) AS dt_max, round(sum(amount), 4) AS amount, round(sum(CASE WHEN y = 1 THEN amount ELSE 0 END), 4) AS fraud_amount FROM s GROUP BY 1""")
def synthetic_source(spark, d):
    """The synthetic tables by default size, joined as the real ones are, and summed by split."""
    tx, ids = synthetic.synthetic_tables(spark, _ROWS, _SEED_S)
    t = split.time_split(enrich(tx, ids.withColumn("known", F.lit(1)), "TransactionID"), dt="TransactionDT")
    fraud = F.when(F.col("isFraud") == 1, F.col("TransactionAmt")).otherwise(0.0)
    return t.groupBy("split").agg(F.count("*").alias("n"), F.sum("isFraud").alias("n_fraud"), F.count_distinct("card1").alias("n_cards"), F.count("known").alias("n_identified"), F.min("TransactionDT").alias("dt_min"), F.max("TransactionDT").alias("dt_max"), F.sum("TransactionAmt").alias("amount"), F.sum(fraud).alias("fraud_amount"))
