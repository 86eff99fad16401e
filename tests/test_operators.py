"""Decision operators against small tables worked out here and against brute force in plain Python."""

import math
import random
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidegate.functions import keys
from tidegate.functions.costs import CostParams, checked, decide, row_benefit, row_cost, rules_decline
from tidegate.models import gbt, trees
from tidegate.operators import bootstrap, drift, encoding, metrics, ordered, policy, profile, selection, sensitivity, split, swap, windows
from tidegate.operators import thresholds as th
from tidegate.plans import features
from tidegate.reporting import figures, record, text
from tidegate.sources import synthetic, tables

INF = math.inf


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


# ---- windows --------------------------------------------------------------


def trades(n=240, seed=2):
    """Rows of a few accounts, some without one, with many shared seconds and times at the edges of windows."""
    rng = random.Random(seed)
    step = [0, 0, 1, 59, 3600, 86_400, 604_800, 7]
    t, out = 0, []
    for i in range(n):
        t += rng.choice(step)
        out.append((i, t, round(rng.uniform(1, 90), 2), rng.choice(["k", "l", "m", None]), rng.choice(["u", "v", "w", "x", None])))
    rng.shuffle(out)
    return out


def velocity_by_force(rows):
    out = {}
    for i, t, a, k, _ in rows:
        past = [(u, b) for _, u, b, other, _ in rows if k is not None and other == k and u < t]
        got = {}
        for name, span in windows.WINDOWS.items():
            own = [b for u, b in past if u >= t - span]
            got[f"vel_cnt_{name}"], got[f"vel_amt_{name}"] = len(own), sum(own)
        got["vel_secs_since_prev"] = t - max(u for u, _ in past) if past else None
        got["vel_prior_cnt"] = len(past)
        got["vel_tenure_days"] = (t - min(u for u, _ in past)) / 86_400 if past else 0
        got["vel_amt_vs_mean_7d"] = a * got["vel_cnt_7d"] / got["vel_amt_7d"] if got["vel_cnt_7d"] else None
        out[i] = got if k is not None else dict.fromkeys(got)
    return out


@pytest.mark.parametrize("form", [windows.velocity, windows.velocity_split])
def test_velocity(spark, form):
    rows = trades()
    df = table(spark, rows, "id int, dt long, amount double, key string, other string").repartition(5)
    want = velocity_by_force(rows)
    for r in form(df, "key").collect():
        for name, v in want[r.id].items():
            assert r[name] is None if v is None else r[name] == pytest.approx(v), (r.id, name)


@pytest.mark.parametrize("form", [windows.distinct_before, windows.distinct_before_split])
def test_distinct_before(spark, form):
    rows = trades(300, 5)
    df = table(spark, rows, "id int, dt long, amount double, key string, other string").repartition(5)
    got = {r.id: r.linked for r in form(df, "key", "other").collect()}
    for i, t, _, k, o in rows:
        seen = {other for _, u, _, key, other in rows if key == k and u < t and other is not None}
        assert got[i] == (None if k is None else len(seen) + (o is not None and o not in seen))


def test_linkage_list_covers_both_directions():
    assert len(windows.LINKAGE) == len({n for n, *_ in windows.LINKAGE}) == 7
    assert sum(k == "card_key" for _, k, _ in windows.LINKAGE) == 3


# ---- keys and encodings ---------------------------------------------------

CARD = "TransactionDT long, D1 double, card1 int, card2 double, card3 double, card4 string, card5 float, card6 string, addr1 double"


def test_keys(spark):
    rows = [(5 * 86_400 + 7, 3.0, 41, 12.0, None, "m", 9.0, "", 77.0), (86_400, None, 42, 13.0, 5.0, None, 9.0, "z", None)]
    got = keys.add_keys(table(spark, rows, CARD)).orderBy("card1").collect()
    assert [r.uid for r in got] == ["41|12|nan|m|9||77|2", "42|13|5|nan|9|z|nan|nan"]
    # One fraction makes the whole column show its fractions, so that 12.25 and 12.5 stay apart.
    mixed = keys.add_keys(table(spark, [*rows, (0, 0.0, 43, 12.25, 1.0, "m", 9.0, "z", 1.0), (0, 0.0, 44, 12.5, 1.0, "m", 9.0, "z", 1.0)], CARD))
    assert [r.card_key.split("|")[1] for r in mixed.orderBy("card1").collect()] == ["12.0", "13.0", "12.25", "12.5"]
    assert keys.add_keys(table(spark, rows, CARD), {c: True for c in ("card1", "card2", "card3", "card4", "card5", "card6", "addr1")} | {"card4": False, "card6": False}).count() == 2


def encoded_by_force(rows, folds, m):
    """Rows are (id, dt, category, label, split), in order of time."""
    train = [r for r in rows if r[4] == "train"]
    block = {r[0]: math.ceil((i + 1) * folds / len(train)) - 1 for i, r in enumerate(train)}
    out = {}
    for i, _, c, _, s in rows:
        pool = [r for r in train if s != "train" or block[r[0]] != block[i]]
        prior = sum(r[3] for r in pool) / len(pool)
        own = [r[3] for r in pool if r[2] == c]
        out[i] = (sum(own) + m * prior) / (len(own) + m) if own else prior
    return out


def test_target_encode(spark):
    rng = random.Random(6)
    rows = [(i, 10 * i, rng.choice(["p", "q", "r", None]) if i < 70 else rng.choice(["p", "new", None]), int(rng.random() < 0.3), "train" if i < 70 else "test") for i in range(100)]
    df = table(spark, rows, "id int, dt long, c string, y int, split string").repartition(4)
    got = encoding.target_encode(df, {"c": encoding.category("c"), "d": F.lit("one")}, folds=4, smoothing=7).collect()
    assert {r.id: r.te_c for r in got} == pytest.approx(encoded_by_force(rows, 4, 7))
    flat = [(i, t, "one", y, s) for i, t, _, y, s in rows]
    assert {r.id: r.te_d for r in got} == pytest.approx(encoded_by_force(flat, 4, 7))
    flipped = df.withColumn("y", F.when(F.col("split") == "test", 1 - F.col("y")).otherwise(F.col("y")))
    assert {r.id: r.te_c for r in encoding.target_encode(flipped, {"c": encoding.category("c")}, folds=4, smoothing=7).collect()} == {r.id: r.te_c for r in got}
    with pytest.raises(Exception, match="null labels"):
        encoding.target_encode(df.withColumn("y", F.lit(None).cast("int")), {"c": F.col("c")}).collect()


def test_mapping_and_vocabulary(spark):
    df = table(spark, [("s", 1), ("s", 0), ("s", 0), ("t", 1), (None, 1)], "c string, y int")
    mapping, prior = encoding.fit_mapping(df, encoding.category("c"), "y", 2)
    assert prior.first().prior == pytest.approx(0.6)
    assert {r.category: r.enc for r in mapping.collect()} == pytest.approx({"s": 2.2 / 5, "t": 2.2 / 3, "__nan__": 2.2 / 3})
    seen = encoding.apply_mapping(table(spark, [("t",), ("else",)], "c string"), encoding.category("c"), mapping, prior, "e")
    assert {r.c: r.e for r in seen.collect()} == pytest.approx({"t": 2.2 / 3, "else": 0.6})
    many = table(spark, [("often",)] * 5 + [("rare",), (None,)], "c string")
    got = encoding.apply_vocabulary(many, "c", encoding.fit_vocabulary(many, "c", 5), "v").collect()
    assert {(r.c, r.v) for r in got} == {("often", "often"), ("rare", encoding.OTHER), (None, None)}
    fold = split.out_of_fold_blocks(many.withColumns({"id": F.monotonically_increasing_id(), "dt": F.lit(0), "y": F.lit(1)}), 3)
    assert {r.te for r in encoding.out_of_fold(fold, F.col("c"), smoothing=0).collect()} == {1.0}


# ---- splits ---------------------------------------------------------------


def test_time_split(spark):
    for times in ([*range(0, 400, 2)], [0] * 30 + [5] * 70, [1, 2, 2, 2, 2, 2, 9, 9, 9, 10], [4]):
        n = len(times)
        t1 = sorted(times)[round(n * 0.7) - 1]
        t2 = max(sorted(times)[round(n * 0.85) - 1], t1)
        want = ["train" if t <= t1 else "valid" if t <= t2 else "test" for t in times]
        df = table(spark, list(enumerate(times)), "id int, dt long").repartition(3)
        assert [r.split for r in split.time_split(df).orderBy("id").collect()] == want
    even = split.time_split(table(spark, [(i, i) for i in range(100)], "id int, dt long"))
    split.check_split(even)
    with pytest.raises(ValueError, match="empty"):
        split.check_split(even.where("split <> 'valid'"))
    for a, b in ((0.8, 0.2), (0, 0.5), (0.5, 1.1)):
        with pytest.raises(ValueError):
            split.time_split(even, a, b)
    with pytest.raises(Exception, match="null time"):
        split.time_split(table(spark, [(0, 3), (1, None)], "id int, dt long")).collect()


def test_folds_and_sample(spark):
    df = spark.range(53).select("id", (F.col("id") * 60).alias("dt"))
    got = split.expanding_folds(df, 4).orderBy("fold").collect()
    cuts = [int(x) for x in np.linspace(0, 53, 6)]
    assert [(r.train_n, r.valid_n) for r in got] == [(cuts[i + 1], cuts[i + 2] - cuts[i + 1]) for i in range(4)]
    assert all(r.train_last < r.valid_first <= r.valid_last for r in got)
    some = [r.id for r in split.ordered_sample(df, 9, 3).collect()]
    assert len(set(some)) == 9 and some == [r.id for r in split.ordered_sample(df.repartition(7), 9, 3).collect()]
    assert set(some) == {r.id for r in df.orderBy(F.xxhash64(F.lit(3), "id"), "id").limit(9).collect()}
    assert split.ordered_sample(df, 99).count() == 53 and split.ordered_sample(df.limit(0), 5).count() == 0


# ---- order statistics -----------------------------------------------------


def test_quantiles(spark):
    rng = np.random.default_rng(8)
    values = np.concatenate((rng.standard_normal(300) * 10.0 ** rng.integers(-9, 6, 300), [0.0] * 40, [-2.5] * 40))
    rows = [(int(i % 3), float(v)) for i, v in enumerate(values)] + [(0, None), (9, None)]
    df = table(spark, rows, "k int, v double").repartition(6)
    probs = [0, 0.01, 0.25, 0.5, 0.77, 0.999, 1]
    got = {r.k: r.q for r in ordered.quantile_array(df, "v", probs, ["k"]).collect()}
    assert sorted(got) == [0, 1, 2]
    for k in got:
        assert got[k] == pytest.approx(np.quantile([v for i, v in rows if i == k and v is not None], probs).tolist(), rel=1e-12)
    assert ordered.quantile_array(df, "v", probs).first().q == pytest.approx(np.quantile(values, probs).tolist(), rel=1e-12)
    assert ordered.quantiles(df.limit(0), "v", [0.5]).count() == 0


def test_score_cells_follow_the_order(spark):
    rng = np.random.default_rng(1)
    v = sorted([*(rng.standard_normal(2000) * 10.0 ** rng.integers(-20, 20, 2000)).tolist(), 0.0, -0.0, 1e300, -1e300, INF])
    cells = [r.c for r in table(spark, list(enumerate(v)), "i int, v double").coalesce(1).select(ordered.score_cell("v").alias("c")).collect()]
    assert cells == sorted(cells) and cells[0] >= -ordered.CELLS and cells[-1] <= ordered.CELLS and len(set(cells)) > 500


def test_running_and_position(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice("ab"), rng.choice([0.1, 0.2, 0.35, 7.0, -3.0, 0.0]) + i * 1e-7, rng.randint(1, 9)) for i in range(80)]
    df = table(spark, rows, "id int, k string, v double, w int").repartition(4)
    got = {r.id: r.s for r in ordered.running(df, ordered.score_cell("v"), [F.col("v")], {"s": F.col("w")}, keys=["k"]).collect()}
    assert got == {i: sum(w2 for _, k2, v2, w2 in rows if k2 == k and v2 <= v) for i, k, v, _ in rows}
    place = {r.id: r.position for r in ordered.position(df.withColumn("dt", (F.col("w") * 50_000).cast("long")), "dt", "id").collect()}
    assert place == {i: n for n, (i, *_) in enumerate(sorted(rows, key=lambda r: (r[3], r[0])))}


def test_local_tables(spark):
    assert ordered.local_rows(spark, [(1, None), (2, "x")], "a int, b string").collect()[1].b == "x"
    with pytest.raises(ValueError, match="more than 3"):
        ordered.local_table(spark.range(9), 3)


# ---- costs and thresholds -------------------------------------------------

P = CostParams(0.1, 2, 1, 0.5)
SCORED = [(0, 1, 40.0, 0.95), (1, 0, 30.0, 0.9), (2, 1, 10.0, 0.6), (3, 1, 60.0, 0.6), (4, 0, 20.0, 0.4), (5, 0, 5.0, 0.4), (6, 1, 8.0, 0.05)]


def cost_by_force(y, a, d, p=P):
    if d == 1:
        return p.review_cost + (1 - p.review_catch_rate) * a * y
    return a * y if d == 0 else (1 - y) * (p.margin_rate * a + p.churn_penalty)


def worth(t_review, t_decline, rows=SCORED, p=P):
    decision = lambda s: 2 if s >= t_decline else 1 if s >= t_review else 0
    return sum(a * y - cost_by_force(y, a, decision(s), p) for _, y, a, s in rows)


@pytest.fixture
def scored(spark):
    return table(spark, SCORED, "id int, y int, amount double, score double").withColumn("dt", (F.col("id") * 43_200).cast("long"))


def test_row_costs(spark, scored):
    for r, d in ((0.4, 0.9), (0.6, 0.6), (INF, INF), (0.0, 0.0), (0.0, INF)):
        got = scored.select("id", "y", "amount", "score", decide("score", d, r).alias("d")).withColumns({"c": row_cost("d", "y", "amount", P), "b": row_benefit("d", "y", "amount", P)}).collect()
        assert [x.c for x in got] == pytest.approx([cost_by_force(x.y, x.amount, x.d) for x in got])
        assert sum(x.b for x in got) == pytest.approx(worth(r, d)) == pytest.approx(th.pair_net_benefit(scored, r, d, P).first().net_benefit)


def test_bad_values_are_errors(spark, scored):
    bad = [scored.withColumn("y", F.lit(2)), scored.withColumn("y", F.lit(None).cast("int")), scored.withColumn("amount", F.lit(-0.5)), scored.withColumn("amount", F.lit(None).cast("double")), scored.withColumn("d", F.lit(3))]
    for df in bad:
        df = df if "d" in df.columns else df.withColumn("d", F.lit(0))
        for total in (F.sum(row_cost("d", "y", "amount", P)), F.sum(checked("y", "amount", "d"))):
            with pytest.raises(Exception, match="bad label"):
                df.agg(total).collect()
        with pytest.raises(Exception, match="bad label"):
            policy.policy_summary(df, "d", P).collect()
    for kw in ({"review_catch_rate": 1.5}, {"margin_rate": -0.1}, {"churn_penalty": -1}, {"review_cost": math.nan}):
        with pytest.raises(ValueError, match="out of range"):
            CostParams().with_(**kw)
    with pytest.raises(ValueError):
        decide("score", 0.3, 0.7)
    with pytest.raises(Exception, match="must not exceed"):
        scored.select(decide("score", F.lit(0.3), F.lit(0.7))).collect()
    with pytest.raises(Exception, match="score is missing"):
        th.cum_stats(scored.withColumn("score", F.lit(None).cast("double")), th.literal_grid(spark, [0.5])).collect()


def test_sweeps_and_pairs(spark, scored):
    values = [0.0, 0.05, 0.2, 0.4, 0.6, 0.7, 0.95, 1.0, INF]
    grid = th.literal_grid(spark, values)
    stats = ordered.local_table(th.cum_stats(scored, grid))
    assert {r.t: r.k for r in stats.collect()} == {t: sum(s >= t for *_, s in SCORED) for t in values}
    sweep = {r.t: r for r in th.single_sweep(stats, P).collect()}
    assert {t: r.net_benefit for t, r in sweep.items()} == pytest.approx({t: worth(t, t) for t in values})
    assert {t: r.cost for t, r in sweep.items()} == pytest.approx({t: 118 - worth(t, t) for t in values})
    best = max(worth(t, t) for t in values)
    assert th.profit_optimal(th.single_sweep(stats, P)).first().t_profit == max(t for t in values if worth(t, t) >= best - 1e-9)
    for cap in (None, 0, 1, 3):
        pairs = [(r, d) for r in values for d in values if r <= d]
        reviews = lambda x: sum(x[0] <= s < x[1] for *_, s in SCORED)
        open_ = [x for x in pairs if cap is None or reviews(x) <= cap]
        top = max(worth(*x) for x in open_)
        want = min((x for x in open_ if worth(*x) >= top - 1e-9), key=lambda x: (reviews(x), -x[1], x[0]))
        got = th.three_way(stats, P, cap).first()
        assert (got.t_review, got.t_decline) == want and got.net_benefit == pytest.approx(top) and got.n_reviews == reviews(want)
    two = th.local_stats(scored, {"a": grid, "b": th.literal_grid(spark, [0.4, 0.55])})
    assert {r.t: r.k for r in two["b"].collect()} == {0.4: 6, 0.55: 4} and two["a"].count() == len(values)
    keyed = th.cum_stats(scored.withColumn("g", F.col("y")), grid, keys=["g"])
    assert {(r.g, r.t): r.k for r in keyed.collect()} == {(g, t): sum(s >= t and y == g for _, y, _, s in SCORED) for g in (0, 1) for t in values}


def test_threshold_grid(spark):
    scores = [((i * 29) % 83) ** 3 / 83**3 for i in range(70)]
    df = table(spark, [(x, 1 - x) for x in scores], "score double, other double")
    tail = np.clip(1 - np.geomspace(1e-5, 1, 2000), 0, 1)
    want = np.concatenate([np.quantile(scores, np.linspace(0, 1, 2000)), np.quantile(scores, tail), np.linspace(0, 1, 1001), [np.inf]])
    assert sorted(r.t for r in th.threshold_grid(df, digits=9).collect()) == pytest.approx(sorted(set(np.round(want, 9).tolist())), abs=2e-9)
    got = th.threshold_grids(df, {"a": ("score", 3, 0), "b": ("other", 5, 0), "c": ("score", 0, 3)}, 9)
    assert sorted(r.t for r in got["b"].collect()) == pytest.approx(sorted({*np.round(np.quantile([1 - x for x in scores], [*np.linspace(0, 1, 5), *np.clip(1 - np.geomspace(1e-5, 1, 5), 0, 1)]), 9), INF}))
    assert sorted(r.t for r in got["c"].collect()) == [0.0, 0.5, 1.0, INF]


def test_policies(spark, scored):
    train = scored.withColumn("dt", (F.col("id") * 86_400).cast("long"))
    grid = th.literal_grid(spark, [0.0, 0.4, 0.6, 0.95, INF])
    chosen = policy.select_policies(scored, train, P, grid=grid, pair_grid=grid, share=0.9)
    row = chosen.first()
    assert row.cap == pytest.approx(0.9 * 7 / 6)
    decided = policy.decisions(policy.with_rules(scored.withColumn("prior", F.when(F.col("id") != 0, 0)), policy.amount_threshold(train, 50), "prior"), chosen, "rules")
    by = {r.policy: r for r in policy.evaluate_policies(decided, P).collect()}
    assert list(by) == list(by) and set(by) == set(policy.POLICIES)
    assert by["approve_all"].net_benefit == 0 and by["profit_single"].net_benefit == pytest.approx(worth(row.t_profit, row.t_profit))
    assert by["profit_three_way"].net_benefit == pytest.approx(worth(row.t_review, row.t_decline))
    assert by["rules"].n_declined == 2  # above the median of 20, with no earlier row, known to be so
    load = policy.review_load(policy.reviews_per_day(decided, "dec_profit_three_way"), table(spark, [(0.5,)], "cap double")).first()
    assert load.n_days == 4 and load.reviews_max >= load.reviews_p95
    shares = policy.capacity_sensitivity(scored, train, scored, P, [0.1, 3.0], grid).collect()
    assert sorted(r.share for r in shares) == [0.1, 3.0] and max(shares, key=lambda r: r.share).test_net_benefit == pytest.approx(max(worth(r, d) for r in (0, 0.4, 0.6, 0.95, INF) for d in (0, 0.4, 0.6, 0.95, INF) if r <= d))
    assert policy.max_reviews_per_day(train, 0.01, 8.0).first().cap == 8.0 and policy.max_reviews_per_day(train, 0.5, 8.0).first().cap != 8.0


def test_rules(spark):
    amounts = table(spark, [(float(x),) for x in (2, 4, 4, 6, 10)] + [(None,)], "amount double")
    assert policy.amount_threshold(amounts, 75).first()[0] == 6.0
    df = table(spark, [(7.0, 0), (7.0, 1), (6.0, 0), (7.0, None)], "amount double, prior int")
    assert [r[0] for r in df.select(rules_decline("amount", "prior", 6.0)).collect()] == [True, False, False, False]
    with pytest.raises(Exception, match="no amounts"):
        policy.amount_threshold(amounts.where("amount is null")).collect()


# ---- metrics --------------------------------------------------------------


def ap_by_force(rows):
    total, tp, n, out = sum(y for y, _ in rows), 0, 0, 0.0
    for s in sorted({s for _, s in rows}, reverse=True):
        own = [y for y, x in rows if x == s]
        tp, n = tp + sum(own), n + len(own)
        out += sum(own) / total * tp / n
    return out


def auc_by_force(rows):
    pairs = [(a, b) for y, a in rows if y for z, b in rows if not z]
    return sum((a > b) + (a == b) / 2 for a, b in pairs) / len(pairs)


def test_ranking_scores(spark):
    rng = random.Random(4)
    rows = [(g, int(rng.random() < 0.4), rng.choice([-3.5, 0.0, 1e-6, 2e-6, 0.3, 0.3001, 40.0])) for g in "abc" for _ in range(60)] + [("one", 1, 0.5)]
    df = table(spark, rows, "g string, y int, score double").repartition(5)
    got = {r.g: r for r in metrics.ranking_scores(df, keys=["g"]).collect()}
    for g in "abc":
        own = [(y, s) for k, y, s in rows if k == g]
        assert got[g].roc_auc == pytest.approx(auc_by_force(own)) and got[g].pr_auc == pytest.approx(ap_by_force(own))
    assert got["one"].roc_auc is None and got["one"].pr_auc is None
    own = [(y, s) for _, y, s in rows]
    j = lambda t: sum(y for y, s in own if s >= t) / sum(y for y, _ in own) - sum(1 - y for y, s in own if s >= t) / sum(1 - y for y, _ in own)
    assert metrics.youden_threshold(df).first()[0] == min(s for s in {s for _, s in own} if j(s) >= max(j(t) for t in {s for _, s in own}) - 1e-12)
    curve = {r.threshold: (r.tpr, r.fpr) for r in metrics.roc_curve(df).collect()}
    assert curve[-3.5] == (1.0, 1.0) and len(curve) == 8


def test_top_k(spark):
    rows = [(i, i // 2, int(i in (1, 4, 5)), [0.9, 0.4, 0.4, 0.4, 0.4, 0.1][i]) for i in range(6)]
    df = table(spark, rows, "id int, dt long, y int, score double").repartition(3)
    assert sorted(r.id for r in metrics.top_k_flag(df, k=3).where("top").collect()) == [0, 1, 2]
    r = metrics.precision_recall_at(df, 0.5).first()
    assert (r.k, r.precision, r.recall) == (3, pytest.approx(1 / 3), pytest.approx(1 / 3))
    rule = df.withColumn("flag", F.col("id") < 2)
    assert metrics.at_rule_volume(rule, "flag").first().precision == 0.5
    m = metrics.rule_metrics(rule, "flag").first()
    assert (m.n_flagged, m.flag_rate, m.precision, m.recall) == (2, pytest.approx(1 / 3), 0.5, pytest.approx(1 / 3))


# ---- swap sets, sensitivity, drift ----------------------------------------


def test_swap_sets(spark):
    rows = [(i, i % 2, 10.0 * (i + 1), i % 3, float(i), "pq"[i % 2], a, b) for i, (a, b) in enumerate([(0, 2), (0, 2), (2, 2), (0, 0), (0, 0), (1, 2), (0, 0)])]
    df = table(spark, rows, "id int, y int, amount double, prior_cnt int, tenure double, product string, a int, b int")
    got = {r["set"]: r for r in swap.characterise(df, "a", "b").collect()}
    assert {k: r.n for k, r in got.items()} == {"a_approves_b_declines": 2, "a_declines_b_approves": 0, "both_decline": 1, "both_approve": 3}
    own = [r for r in rows if (r[6], r[7]) == (0, 0)]
    assert got["both_approve"].amount_median == np.median([r[2] for r in own]) and got["both_approve"].tenure_days_median == np.median([r[4] for r in own])
    assert got["both_approve"].amount_p95 == pytest.approx(np.quantile([r[2] for r in own], 0.95)) and got["both_approve"].product_p == pytest.approx(2 / 3)
    assert got["a_declines_b_approves"].amount_median is None
    with pytest.raises(ValueError, match="more than"):
        swap.characterise(spark.range(1200).select(F.col("id").cast("string").alias("product"), *[F.lit(0).alias(c) for c in ("a", "b", "y", "amount", "prior_cnt", "tenure")]), "a", "b")


def test_sensitivity(spark, scored):
    grid = th.literal_grid(spark, [0.0, 0.4, 0.6, 0.95, INF])
    params = {"margin_rate": [0.0, 0.1], "churn_penalty": [0.0, 9.0], "review_cost": [0.5, 20.0], "review_catch_rate": [0.5, 0.9]}
    test = scored.withColumn("rules", F.col("id") == 1)
    cells = sensitivity.run(sensitivity.cost_cells(spark, params), scored, test, grid, grid, 3, table(spark, [(0.6,)], "t double"), "rules")
    values = [0.0, 0.4, 0.6, 0.95, INF]
    for c in cells.collect():
        p = CostParams(*[c[k] for k in sensitivity.PARAMS])
        fit = [(r, d) for r in values for d in values if r <= d and sum(r <= s < d for *_, s in SCORED) <= 3]
        assert c.nb1000_profit_three_way == pytest.approx(1000 / 7 * max(worth(r, d, p=p) for r, d in fit))
        assert c.nb1000_profit_single == pytest.approx(1000 / 7 * max(worth(t, t, p=p) for t in values))
        assert c.nb1000_youden_single == pytest.approx(1000 / 7 * worth(0.6, 0.6, p=p)) and c.nb1000_rules == pytest.approx(-1000 / 7 * (p.margin_rate * 30 + p.churn_penalty))
    assert cells.count() == 16
    rows = [(4.0, 4.0, -1.0, 3.0), (2.0, 3.0, 1.0, 1.0), (9.0, 1.0, 1.0, 9.5), (7.0, 6.0, 5.0, -2.0), (-1.0, -1.5, -2.0, -3.0)]
    s = sensitivity.ranking_stability(table(spark, rows, ", ".join(f"nb1000_{k} double" for k in ("profit_three_way", "profit_single", "youden_single", "rules")))).first()
    assert (s.n_cells, s.share_three_way_ge_single, s.share_single_gt_youden, s.share_model_gt_rules, s.share_all_orderings) == (5, 0.8, 0.8, 0.8, 0.6)
    assert (s.share_three_way_positive, s.share_youden_positive) == (0.8, 0.6)
    span = {r.measure: (r.least, r.most) for r in sensitivity.ranges(cells, ("review_cost", "margin_rate")).collect()}
    assert span == {"review_cost": (0.5, 20.0), "margin_rate": (0.0, 0.1)}


def psi_by_force(ref, cur, bins=10):
    known = [x for x in ref if x is not None]
    edges = sorted(set(np.quantile(known, np.arange(1, bins) / bins))) if known else []
    place = lambda x: len(edges) + 1 if x is None else sum(e <= x for e in edges)
    out = 0.0
    for b in range(len(edges) + 2):
        e, a = (max(sum(place(x) == b for x in side) / len(side), 1e-4) for side in (ref, cur))
        out += (a - e) * math.log(a / e)
    return out


def test_drift(spark):
    rng = random.Random(12)
    ref = [round(rng.gauss(5, 2), 1) if rng.random() > 0.1 else None for _ in range(400)]
    cur = [round(rng.gauss(6, 3), 1) if rng.random() > 0.3 else None for _ in range(300)]
    kinds = "x double, c string, e double"
    one = lambda side, c: table(spark, [(x, c(i), None) for i, x in enumerate(side)], kinds)
    a, b = one(ref, lambda i: "uv"[i % 2]), one(cur, lambda i: ["u", "w", None][i % 3])
    got = {r.feature: r for r in drift.feature_psi(a, b, ["x", "e"], ["c"]).collect()}
    assert got["x"].psi == pytest.approx(psi_by_force(ref, cur)) and got["e"].psi == pytest.approx(0) and got["c"].band == "significant"
    same = {r.feature: r.psi for r in drift.feature_psi(a, a, ["x"], ["c"]).collect()}
    assert same == pytest.approx({"x": 0, "c": 0})
    families = table(spark, [("x", "f"), ("c", "f")], "feature string, family string")
    roll = drift.monitor_rollup(drift.feature_psi(a, b, ["x", "e"], ["c"]), families).first()
    assert roll.n_features == 3 and [x.feature for x in roll.significant_features][0] == max(("x", "c"), key=lambda f: got[f].psi) and roll.significant_by_family["f"] >= 1
    days = table(spark, [(d, r) for d, r in enumerate([4, 9, 9, 1, 9, 9, 9, 9, 0, 9])], "day long, reviews long")
    runs = drift.breach_runs(days, table(spark, [(5.0,)], "cap double"), 2)
    assert sorted(tuple(r) for r in runs.collect()) == [(1, 2, 2), (4, 7, 4)]
    score = lambda n, seed: table(spark, [(i, i * 3600, int(i % 7 == 0), random.Random(seed + i).random()) for i in range(n)], "id int, dt long, y int, score double")
    windows_ = drift.score_stability(score(200, 1), score(100, 5), 0.8, 0.6, days=1)
    assert sorted(r.n for r in windows_.collect()) == [4, 24, 24, 24, 24]
    fired = drift.triggers(drift.monitor_rollup(drift.feature_psi(a, b, ["x", "e"], ["c"])), windows_, runs, 0.2, 10, most_features=9).first()
    assert (fired.features_drifted, fired.over_capacity, fired.labels_young) == (False, True, True)


# ---- bootstrap ------------------------------------------------------------


def test_bootstrap_weights(spark):
    df = spark.range(40).select("id")
    got = {(r.b, r.id): r.w for r in bootstrap.poisson_weights(df, 30, 4).collect()}
    want = bootstrap.poisson_matrix(np.arange(40), np.arange(30), 4)
    assert {(b, i): int(want[i, b]) for i in range(40) for b in range(30) if want[i, b]} == got
    many = bootstrap.poisson_matrix(np.arange(4000), np.arange(200), 1)
    assert abs(many.mean() - 1) < 0.01 and abs(many.var() - 1) < 0.02 and abs(np.corrcoef(many[:, 0], many[:, 1])[0, 1]) < 0.05
    exact = bootstrap.draws(df.withColumn("dt", F.col("id")), 5, 3)
    assert [r.w for r in exact.groupBy("b").agg(F.sum("w").alias("w")).collect()] == [40] * 5


def test_ranking_replicates(spark, monkeypatch):
    monkeypatch.setattr(bootstrap, "CHUNK", 7)
    rng = random.Random(2)
    rows = [(i, int(rng.random() < 0.2), rng.choice([0.1, 0.2, 0.21, 0.9, 3.0]) if i % 2 else rng.random()) for i in range(60)]
    df = table(spark, rows, "id int, y int, score double").repartition(4)
    w = bootstrap.poisson_matrix(np.arange(60), np.arange(25), 9)
    got = {r.b: r for r in bootstrap.ranking_replicates(df, "score", 25, 9, cells=6).collect()}
    for b in range(25):
        own = [(y, s) for i, y, s in rows for _ in range(w[i, b])]
        if 0 < sum(y for y, _ in own) < len(own):
            assert got[b].pr_auc == pytest.approx(ap_by_force(own)) and got[b].roc_auc == pytest.approx(auc_by_force(own))
        else:
            assert got[b].pr_auc is None


def test_intervals_and_hypotheses(spark):
    df = spark.range(300).select("id", (F.col("id") % 3).cast("double").alias("a"), F.lit(0.5).alias("b_"), (F.col("id") % 5 == 0).alias("f"), (F.col("id") % 2 == 0).alias("g"), (F.col("id") % 4 == 0).cast("int").alias("y"))
    stat = lambda w: bootstrap.mean_diff(w, "a", "b_", 10)
    ci = bootstrap.paired_bootstrap(df, stat, 60, 1).first()
    assert ci.ci_low < 5 < ci.ci_high and ci.excludes_zero and ci.n_boot_valid == 60
    assert ci == bootstrap.paired_bootstrap(df.repartition(5), stat, 60, 1).first()
    p = bootstrap.paired_bootstrap(df, lambda w: bootstrap.ratio_diff(w, "g", "f", "precision"), 60, 1).first()
    assert p.ci_low < 0.25 < p.ci_high
    none = bootstrap.interval(table(spark, [(0, float("nan")), (1, None)], "b int, value double"), "value", 2).first()
    assert (none.n_boot_valid, none.ci_low, none.excludes_zero) == (0, None, False)
    rows = [("profit_minus_youden", 3.0, True), ("three_way_minus_rules", 2.0, True), ("pr_auc_with_minus_without_velocity", -1.0, True)]
    held = lambda share, r=rows: tuple(bootstrap.hypotheses(table(spark, r, "name string, point double, excludes_zero boolean"), table(spark, [(share,)], "share_all_orderings double")).first())
    assert held(0.8) == (True, True, False, True, True) and held(0.79)[3] is False
    assert held(0.9, [(n, x, False) for n, x, _ in rows]) == (False, False, False, True, False)


# ---- selection, profile, sources ------------------------------------------


def test_selection(spark):
    rng = random.Random(7)
    rows = []
    for i in range(400):
        y, u = i % 2, rng.random()
        rows.append((i, y, u + y, 2 * u + 2 * y + 0.01 * rng.random(), None if i % 50 else 1.0, rng.random(), rng.random() if i % 4 else None, 3.0, u))
    df = table(spark, rows, "id int, y int, V1 double, V2 double, V3 double, V10 double, V4 double, V5 double, V6 double")
    kept, why = selection.select_columns(df, ["V10", "V2", "V1", "V3", "V4", "V5", "V6"], keep=2)
    assert kept == ["V1", "V4"] or (kept[0] == "V1" and len(kept) == 2)
    assert set(kept) | set(why) == {"V1", "V2", "V3", "V4", "V5", "V6", "V10"} and not set(kept) & set(why)
    assert "V1" in why["V2"] and "lack" in why["V3"] and "weaker" in why["V5"]
    pruned, reasons = selection.prune_correlated(df, ["V2", "V1", "V6"], 0.99)
    assert pruned == ["V2", "V6"] and "V2" in reasons["V1"]
    with pytest.raises(ValueError):
        selection.require_cap(list("abc"), 2)


def test_profile(spark):
    df = table(spark, [(0, 1, "a"), (40 * 86_400, 0, None), (41 * 86_400, 1, "a")], "dt long, y int, c string")
    assert {r.period: r.n for r in profile.class_balance_by_period(df).collect()} == {0: 1, 1: 2}
    assert {r["column"]: r.n_distinct for r in profile.cardinality(df, ["dt", "c"]).collect()} == {"dt": 3, "c": 1}
    assert profile.family("card3") == "card" and profile.family("V201") == "vendor features" and profile.family("D1n") == "Unknown"
    rows = profile.data_dictionary(df)
    assert profile.dictionary_text(rows).count("\n") == 5 and rows[2][3] == pytest.approx(1 / 3)
    assert [(r.c, r.n) for r in profile.counts_by(df, "c").collect()] == [("a", 2), (None, 1)]
    assert {r.c: r.share for r in profile.share_by(df, "c", "y").collect()} == {"a": 1.0, None: 0.0}


def test_csv_and_files(spark, tmp_path):
    (tmp_path / "x.csv").write_text('TransactionID,card4,"dist1",id-01\n7,,,0.5\n8,"k, l",2.5,\n')
    df = tables.scan_csv(spark, str(tmp_path / "x.csv"))
    assert dict(df.dtypes) == {"TransactionID": "bigint", "card4": "string", "dist1": "float", "id_01": "float"}
    a, b = df.orderBy("TransactionID").collect()
    assert (a.card4, a.dist1, a.id_01, b.card4, b.dist1, b.id_01) == ("", None, 0.5, "k, l", 2.5, None)
    size = (tmp_path / "x.csv").stat().st_size
    tables.require_files(spark, str(tmp_path), {"x.csv": size})
    import hashlib

    assert tables.verify_files(spark, str(tmp_path), {"x.csv": size}).first().sha256 == hashlib.sha256((tmp_path / "x.csv").read_bytes()).hexdigest()
    with pytest.raises(ValueError, match="x.csv: size.*y.csv: missing"):
        tables.require_files(spark, str(tmp_path), {"x.csv": size + 1, "y.csv": 1})
    with pytest.raises(ValueError, match="repeats"):
        tables.enrich(df, df.union(df), "TransactionID")
    with pytest.raises(ValueError, match="2 rows"):
        tables.require_rows(df, 3)
    made = []
    for _ in range(2):
        tables.cached_table(spark, str(tmp_path / "cache"), lambda: made.append(1) or df)
    assert made == [1]
    tables.write_csv(df, str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).count() == 2
    value = {"b": [math.nan, 1, "line\nbreak"], "a": {"c": None, "d": math.inf}}
    tables.save_json(value, spark, str(tmp_path / "r.json"))
    assert tables.load_json(spark, str(tmp_path / "r.json")) == {"a": {"c": None, "d": None}, "b": [None, 1, "line\nbreak"]}


def test_synthetic_tables(spark):
    tx, ids = synthetic.synthetic_tables(spark, 600, 3, 7)
    assert set(tx.columns) >= {"TransactionID", "isFraud", "TransactionDT", "ProductCD", "card6", "D15", "M9", "C14", "V7"} and "V8" not in tx.columns
    a = tx.toPandas()
    again = synthetic.synthetic_tables(spark, 600, 3, 7)[0].repartition(7).orderBy("TransactionID").toPandas()
    pd.testing.assert_frame_equal(a.sort_values("TransactionID").reset_index(drop=True), again)
    assert 0 < a.isFraud.mean() < 0.3 and (a.TransactionAmt > 0).all() and a.card1.nunique() > 20 and a.V2.isna().any()
    i = ids.toPandas()
    assert 0.2 < len(i) / 600 < 0.4 and i.id_07.isna().all() and i.TransactionID.is_unique


# ---- text -----------------------------------------------------------------


def test_text(spark):
    assert [text.shown(v, k, d) for v, k, d in ((-2500.4, "usd", None), (-0.004, "usd", 2), (0.0714, "pct", None), (12.34567, "num", None), (1999.6, "int", None), (-0.0214, "pp", None))] == ["-$2,500", "$0.00", "7.1%", "12.346", "2,000", "-2.1 pp"]
    with pytest.raises(ValueError):
        text.shown(None)
    df = table(spark, [(-2500.4, 0.0714), (-0.2, -0.0001)], "a double, b double")
    got = df.select(text.shown_column(F.col("a"), "usd").alias("a"), text.shown_column(F.col("b"), "pct").alias("b")).collect()
    assert [(r.a, r.b) for r in got] == [("-$2,500", "7.1%"), ("$0", "0.0%")]
    ci = {"point": 0.03, "ci_low": 0.01, "ci_high": 0.05, "excludes_zero": True}
    assert text.shown_interval(ci, "pp") == "3.0 pp (95% CI 1.0 to 5.0 pp)" and text.shown_interval(ci) == "0.0300 (95% CI 0.0100 to 0.0500)" and text.shown_interval({"point": 1}) == "n/a"
    assert text.finding(ci) == "interval excludes zero" and "unfavourable" in text.finding(ci | {"point": -1}) and "includes" in text.finding(ci | {"excludes_zero": False}) and text.finding({"n_boot_valid": 0}) == "undefined"
    with pytest.raises(KeyError):
        text.render("$here $gone", {"here": "1"})
    docs = table(spark, [("one", "Of 40 rows 62.5% held; $7,310 came in, `99` did not, and 3.8 is wrong")], "name string, text string")
    leaves = table(spark, [(v,) for v in text.computed_numbers({"a": [40, True, None], "b": {"c": 0.625, "d": " 7310.2 ", "e": "text"}})], "value double")
    assert sorted(text.computed_numbers([True, "1e3", {"x": (2,)}])) == [2.0, 1000.0]
    assert [r.token for r in text.unsupported_numbers(docs, leaves).collect()] == ["3.8"]


def test_record():
    xml = '<testsuites><testsuite><testcase classname="tests.a" name="x"/><testcase classname="tests.a" name="y"><failure/></testcase><testcase classname="tests.b" name="z"><skipped/></testcase></testsuite></testsuites>'
    assert record.read_junit(xml) == {"total": 3, "passed": 1, "failed": 1, "skipped": 1, "files": 2}


def test_figures(spark, scored):
    grid = th.literal_grid(spark, [0.0, 0.4, 0.6, INF])
    curve = figures.profit_curve(scored, scored, grid, P).collect()
    assert len(curve) == 6 and {r.part for r in curve} == {"valid", "test"}
    d = scored.withColumns({"a": decide("score", 0.6), "b": decide("score", 0.9)})
    assert {r.policy: r.tpr for r in figures.cutoffs_on_roc(d, ["a", "b"]).collect()} == {"a": 0.75, "b": 0.25}
    assert sum(r.share for r in figures.swap_amounts(d, "a", "b").where("set = 'both_approve'").collect()) == pytest.approx(1)
    assert figures.gains(scored).count() == 5 and max(r.share for r in figures.cumulative_amounts(scored).collect()) == pytest.approx(1)
    assert figures.policy_surface(th.cum_stats(scored, grid), P, 2, 0.4).count() >= 2
    assert len(figures.thinned(scored.select("score", "amount"), "score", 2).collect()) <= 3


# ---- models, features, the whole job --------------------------------------


def test_exported_trees_score_as_the_model_does(spark):
    rng = random.Random(5)
    rows = [(i, i, None if i % 9 == 0 else rng.random(), rng.choice(["p", "q", "r", None]), 0) for i in range(240)]
    rows = [(i, d, x, c, int((x or 0) + (c == "p") * 0.5 + rng.gauss(0, 0.3) > 0.6)) for i, d, x, c, _ in rows]
    df = table(spark, rows, "id int, dt long, x double, c string, y int")
    spec = gbt.Spec(["x"], ["c"])
    model = gbt.fit(df.where("c is null or c <> 'r'"), spec, rounds=4, depth=3, least_rows=5, feature_share=1.0)
    exported = trees.export_trees(model, spec)
    both = gbt.predict(model, df, spec, "p").withColumn("q", trees.probability(exported)).collect()
    assert all(r.p == pytest.approx(r.q) for r in both) and len({round(r.p, 6) for r in both}) > 3
    after = gbt.prefix_scores(model, df, spec)
    last = metrics.ranking_scores(df.withColumn("s", trees.margin(exported)), "s").first().pr_auc
    assert len(after) == 4 and after[-1] == pytest.approx(last)
    assert sum(s for _, s, _ in gbt.importance(model, spec)) == pytest.approx(1)
    assert gbt.share_by_family([("a", 0.2, "f"), ("b", 0.6, "g"), ("c", 0.2, "f")]) == {"g": 0.6, "f": 0.4}
    assert gbt.best_round([0.1, 0.3, 0.2, 0.2, 0.9], 2) == 2


def test_model_archive_and_tuning(spark, tmp_path):
    df = spark.range(160).select("id", F.col("id").alias("dt"), (F.col("id") % 10).cast("double").alias("x"), (F.col("id") % 10 > 6).cast("int").alias("y"))
    spec = gbt.Spec(["x"])
    model = gbt.fit(df, spec, rounds=2, depth=2, least_rows=2, feature_share=1.0)
    gbt.save(model, str(tmp_path / "m"), spec)
    again, spec2 = gbt.load(str(tmp_path / "m"))
    assert spec2 == spec and [r.score for r in gbt.predict(again, df, spec).collect()] == [r.score for r in gbt.predict(model, df, spec).collect()]
    tried = gbt.cross_validate(df, spec, [{"depth": 1, "least_rows": 2, "feature_share": 1.0}, {"depth": 2, "least_rows": 2, "feature_share": 1.0}], folds=2, rounds=2)
    assert len(tried) == 2 and tried[0]["pr_auc_mean"] >= tried[1]["pr_auc_mean"] and 1 <= tried[0]["rounds"] <= 2


def test_the_whole_job(spark, tmp_path):
    from tidegate import run

    job = run.Job(spark, f"file://{tmp_path}/out", rows=1500, rounds=2, n_boot=20)
    said = []
    run.run(job, say=said.append)
    assert [s.split(":")[0] for s in said] == list(run.STAGES)
    kept = {r.feature: r.family for r in job.read("features_kept").collect()}
    assert set(kept.values()) == {"raw", "vesta", "velocity", "entity_risk", "linkage"} and len([f for f in kept.values() if f == "velocity"]) == 20
    dropped = {r.column: r.reason for r in job.read("columns_dropped").collect()}
    assert dropped["id_07"].startswith("100.00%") and "label" in dropped["isFraud"] and not set(kept) & set(dropped)
    frame = job.read("features")
    assert frame.count() == 1500 and dict(frame.dtypes)["vel_card1_cnt_1h"] == "float"
    assert job.read("headline_policies").count() == 6 and job.read("sensitivity_grid").count() == 750
    assert set(job.load("decide.json")["hypotheses"]) == {"h1", "h2", "h3", "h4", "success"}
    assert job.load("monitor.json")["rollup"]["n_features"] == len(kept)
    less, m = features.build_features(job.read("base"), features.Options(without=("velocity", "linkage")))
    assert set(m.families.values()) == {"raw", "vesta", "entity_risk"} and less.count() == 1500
    with pytest.raises(ValueError, match="cap"):
        features.build_features(job.read("base"), features.Options(most_features=10))


# ---- streaming ------------------------------------------------------------


def streamed(spark, tmp_path, parts, schema, build, name):
    """Run a streaming form over files that arrive one after another."""
    folder = tmp_path / name
    for i, rows in enumerate(parts):
        table(spark, rows, schema).coalesce(1).write.parquet(str(folder / f"{i}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder / "*"))
    query = build(stream).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"c{name}")).start()
    query.processAllAvailable()
    query.stop()
    return spark.table(name).collect()


def test_velocity_stream(spark, tmp_path):
    rows = [(i, 40 * i, 2.0 + i, "ab"[i % 2]) for i in range(24)]
    parts = [rows[:10], rows[10:12] + [(50, 390, None, "a"), (51, 10, 1.0, "a"), (52, 100, 5.0, None)], rows[12:]]
    got = {r.id: r for r in streamed(spark, tmp_path, parts, "id long, dt long, amount double, card string", lambda s: windows_of(s), "vel")}
    assert 52 not in got and len(got) == 26
    seen: list[tuple] = []
    for part in parts:
        fresh = [(i, t, a or 0.0, k) for i, t, a, k in part if k]
        before = {k: max((t for _, t, _, c in seen if c == k), default=None) for k in "ab"}
        kept = [r for r in fresh if before[r[3]] is None or r[1] >= before[r[3]] - 300]
        state = [r for r in seen if before[r[3]] is None or r[1] >= before[r[3]] - 300] + kept
        for i, t, _, k in fresh:
            own = [a for _, u, a, c in state if c == k and t - 300 <= u < t]
            assert got[i].late == (i == 51)
            assert (got[i].cnt_5m, got[i].amt_5m) == (len(own), pytest.approx(sum(own)))
        seen += kept


def windows_of(stream):
    from tidegate.streaming import monitor

    return monitor.velocity_stream(stream, "card", {"1m": 60, "5m": 300}).select("id", "late", "cnt_5m", "amt_5m")


def test_window_stats_stream(spark, tmp_path):
    from tidegate.streaming import monitor

    rows = [(datetime(2024, 3, 1) + timedelta(hours=7 * i), (i % 10) / 10, i % 2) for i in range(60)]
    parts = [rows, [(datetime(2024, 6, 1), 0.5, 0)]]  # the second moves the watermark beyond all windows
    got = streamed(spark, tmp_path, parts, "ts timestamp, score double, y int", lambda s: monitor.window_stats(s, 0.8, 0.5, days=7), "stats")
    assert sum(r.n for r in got) == 60 and sum(r.n * r.decline_rate for r in got) == pytest.approx(12) and sum(r.n * r.review_rate for r in got) == pytest.approx(18)
    bins = streamed(spark, tmp_path, parts, "ts timestamp, score double, y int", lambda s: monitor.score_bins(s, [0.25, 0.75], days=7), "bins")
    assert {b: sum(r.n for r in bins if r.bin == b) for b in (0, 1, 2)} == {0: 18, 1: 30, 2: 12}
