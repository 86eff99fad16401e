"""Paired bootstrap intervals.

Each row has a Poisson(1) weight in each replicate, from a hash of (seed,
replicate, row): the same for both sides of a comparison, under any
partitioning, and without drawing or joining anything.  ``draws`` is the exact
resampling form.

Linear statistics sum (row, replicate) weights inside each partition.  Ranking
metrics need an order: rows are cut into cells of the score, each cell sums
its weights for all replicates at once, and a second pass adds what lies in
higher cells; what is shuffled is rows once and sums of cells, never rows times
replicates.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegate.operators.ordered import position

#: 32-bit words, and the multiplier of the mixing rounds (their product fits 63 bits, so SQL engines agree).
WORD, ROUND, SPREAD, SEEDS = 1 << 32, 73_244_475, 2_654_435_761, 40_503
#: Upper bounds of a Poisson(1) variable's cumulative probabilities.
CUTS = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)]).tolist()


def _uniform(b: Column, row: Column, seed: int) -> Column:
    h = F.pmod(row.cast("long"), F.lit(WORD)).bitwiseXOR(((b.cast("long") + 1) * SPREAD + F.lit(seed * SEEDS)) % WORD)
    for _ in range(2):
        h = (F.shiftright(h, 16).bitwiseXOR(h) * ROUND) % WORD
    return F.shiftright(h, 16).bitwiseXOR(h) / F.lit(float(WORD))


def poisson(u: Column) -> Column:
    """Times a row is drawn, from a uniform number."""
    return sum((F.when(u >= c, 1).otherwise(0) for c in CUTS), F.lit(0))


def poisson_matrix(rows: np.ndarray, replicates: np.ndarray, seed: int) -> np.ndarray:
    """``poisson_weights`` of every (row, replicate), in numpy."""
    word = np.uint64(WORD - 1)
    own = ((replicates.astype(np.uint64) + np.uint64(1)) * np.uint64(SPREAD) + np.uint64(seed * SEEDS)) & word
    h = (rows.astype(np.int64).view(np.uint64) & word)[:, None] ^ own
    for _ in range(2):
        h = ((h >> np.uint64(16)) ^ h) * np.uint64(ROUND) & word
    u = ((h >> np.uint64(16)) ^ h) / float(WORD)
    return np.searchsorted(CUTS, u, side="right").astype(np.int16)


def poisson_weights(df: DataFrame, n_boot: int, seed: int, row_id: str = "id") -> DataFrame:
    """Rows of ``df`` with (b, w): replicate and times drawn, w > 0."""
    every = df.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))))
    every = every.withColumn("__u", _uniform(F.col("b"), F.col(row_id), seed))
    return every.where(F.col("__u") >= CUTS[0]).withColumn("w", poisson(F.col("__u"))).drop("__u")


def draws(df: DataFrame, n_boot: int, seed: int, dt: str = "dt", row_id: str = "id") -> DataFrame:
    """As ``poisson_weights`` with exactly as many draws as rows in each replicate: draw j is a row by hash.

    Draws are made in blocks of a range, and reduced to (replicate, row, times) before they meet the rows.
    """
    spark = df.sparkSession
    rows = position(df, dt, row_id, "__i")
    n = df.count()
    if not n:
        return df.withColumns({"b": F.lit(0), "w": F.lit(0).cast("long")})
    text = F.concat_ws(":", F.lit(str(seed)), F.col("b").cast("string"), F.col("j").cast("string"))
    pick = F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")
    if n > WORD:
        raise ValueError("too many rows for 32-bit draws: use Poisson weights")
    d = spark.range(n * n_boot).select((F.col("id") / F.lit(n)).cast("int").alias("b"), (F.col("id") % n).alias("j"))
    d = d.select("b", (pick % n).alias("__i")).groupBy("b", "__i").agg(F.count("*").alias("w"))
    return rows.join(d, "__i").drop("__i")


def interval(stats: DataFrame, value: str, n_boot: int, level: float = 0.95) -> DataFrame:
    """One row: percentile interval over the replicates (as many as the parameter says) with a defined value, and whether it excludes zero."""
    lo, hi = (1 - level) / 2, 1 - (1 - level) / 2
    v = F.when(~F.isnan(value), F.col(value))
    one = stats.agg(F.percentile(v, F.array(F.lit(lo), F.lit(hi))).alias("q"), F.count(v).alias("n_boot_valid"))
    low, high = F.get("q", F.lit(0)), F.get("q", F.lit(1))
    return one.select(low.alias("ci_low"), high.alias("ci_high"), "n_boot_valid", F.coalesce((low > 0) | (high < 0), F.lit(False)).alias("excludes_zero"))


def mean_diff(weighted: DataFrame, a: str, b: str, scale: float = 1.0) -> DataFrame:
    """(b, value) per replicate: scale times the weighted mean of a less b."""
    return weighted.groupBy("b").agg((F.lit(scale) * F.sum((F.col(a) - F.col(b)) * F.col("w")) / F.sum("w")).alias("value"))


def ratio_diff(weighted: DataFrame, flag_a: str, flag_b: str, kind: str, y: str = "y") -> DataFrame:
    """(b, value) per replicate: difference of precision or recall of two fixed flags; null where undefined."""

    def one(flag: str) -> Column:
        hit = F.sum(F.when(F.col(flag), F.col(y) * F.col("w")).otherwise(0))
        return F.try_divide(hit, F.sum(F.when(F.col(flag), F.col("w")).otherwise(0)) if kind == "precision" else F.sum(F.col(y) * F.col("w")))

    return weighted.groupBy("b").agg((one(flag_a) - one(flag_b)).alias("value"))


#: Replicates whose weights a task holds at once, and rows of a cell it weighs at once.
TOGETHER, CHUNK = 250, 20_000


def _cell_sums(n_boot: int, seed: int):
    def run(parts):
        for pdf in parts:
            for cell, own in pdf.groupby("cell", sort=False):
                pos, n = np.zeros(n_boot, np.int64), np.zeros(n_boot, np.int64)
                for a in range(0, len(own), CHUNK):
                    part = own.iloc[a : a + CHUNK]
                    for b in range(0, n_boot, TOGETHER):
                        w = poisson_matrix(part["id"].to_numpy(), np.arange(b, min(n_boot, b + TOGETHER)), seed)
                        n[b : b + TOGETHER] += w.sum(axis=0)
                        pos[b : b + TOGETHER] += w[part["y"].to_numpy() == 1].sum(axis=0)
                yield pd.DataFrame({"cell": cell, "b": np.arange(n_boot, dtype=np.int32), "pos": pos, "n": n})

    return run


def _cell_parts(n_boot: int, seed: int):
    def run(key, rows: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        above = above.sort_values("b")
        rows = rows.sort_values("s", ascending=False, kind="stable")
        ap, wins = np.zeros(n_boot), np.zeros(n_boot)
        ids, y, s = rows["id"].to_numpy(), rows["y"].to_numpy() == 1, rows["s"].to_numpy()
        head = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1]))) if len(s) else np.zeros(0, int)
        # Chunks end where a score ends, so that ties stay together.
        cuts = [0]
        for h in [*head[1:].tolist(), len(s)]:
            if h - cuts[-1] >= CHUNK or h == len(s):
                cuts.append(h)
        for b in range(0, n_boot, TOGETHER):
            base = above.iloc[b : b + TOGETHER]
            tp, k = base["pos"].to_numpy().copy(), base["n"].to_numpy().copy()
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if hi == lo:
                    continue
                w = poisson_matrix(ids[lo:hi], np.arange(b, min(n_boot, b + TOGETHER)), seed).astype(np.int64)
                at = head[(head >= lo) & (head < hi)] - lo
                p, c = np.add.reduceat(w * y[lo:hi, None], at), np.add.reduceat(w, at)
                up, uk = tp + np.cumsum(p, axis=0), k + np.cumsum(c, axis=0)
                ap[b : b + TOGETHER] += (p * up / np.maximum(uk, 1)).sum(axis=0)
                wins[b : b + TOGETHER] += ((c - p) * (up - p / 2)).sum(axis=0)
                tp, k = up[-1], uk[-1]
        return pd.DataFrame({"b": np.arange(n_boot, dtype=np.int32), "ap": ap, "wins": wins})

    return run


def ranking_replicates(df: DataFrame, score: str, n_boot: int, seed: int, y: str = "y", row_id: str = "id", cells: int = 256) -> DataFrame:
    """(b, roc_auc, pr_auc) of each replicate; null where it has one class."""
    rows = df.select(F.col(row_id).cast("long").alias("id"), F.col(y).cast("int").alias("y"), F.col(score).cast("double").alias("s"))
    # Cells of about even size; equal scores share one, whichever bounds are found.
    bounds = rows.agg(F.percentile_approx("s", [i / cells for i in range(1, cells)], 4 * cells).alias("q")).first()[0] or []
    edges = F.array(*[F.lit(float(x)) for x in sorted(set(bounds))]) if bounds else F.expr("cast(array() as array<double>)")
    rows = rows.withColumn("cell", F.size(F.filter(edges, lambda e: e <= F.col("s"))))
    sums = rows.mapInPandas(_cell_sums(n_boot, seed), "cell int, b int, pos long, n long").groupBy("cell", "b").agg(F.sum("pos").alias("pos"), F.sum("n").alias("n"))
    higher = Window.partitionBy("b").orderBy(F.desc("cell")).rowsBetween(Window.unboundedPreceding, -1)
    above = sums.select("cell", "b", *[F.coalesce(F.sum(c).over(higher), F.lit(0)).alias(c) for c in ("pos", "n")])
    parts = rows.groupBy("cell").cogroup(above.groupBy("cell")).applyInPandas(_cell_parts(n_boot, seed), "b int, ap double, wins double")
    total = sums.groupBy("b").agg(F.sum("pos").alias("p"), F.sum("n").alias("n"))
    out = parts.groupBy("b").agg(F.sum("ap").alias("ap"), F.sum("wins").alias("wins")).join(total, "b")
    both = (F.col("p") > 0) & (F.col("n") > F.col("p"))
    return out.select("b", F.when(both, F.col("wins") / (F.col("p") * (F.col("n") - F.col("p")))).alias("roc_auc"), F.when(both, F.col("ap") / F.col("p")).alias("pr_auc"))


def metric_diff(df: DataFrame, score_a: str, score_b: str, metric: str = "pr_auc", n_boot: int = 1000, seed: int = 20240917, y: str = "y", row_id: str = "id") -> DataFrame:
    """(b, value) per replicate: difference of a ranking metric of two scores; null where a replicate has one class."""
    a, b = (ranking_replicates(df, s, n_boot, seed, y, row_id).select("b", F.col(metric).alias(n)) for s, n in ((score_a, "__a"), (score_b, "__b")))
    return a.join(b, "b").select("b", (F.col("__a") - F.col("__b")).alias("value"))


def paired_bootstrap(df: DataFrame, stat, n_boot: int = 1000, seed: int = 20240917, level: float = 0.95, exact: bool = False, dt: str = "dt", row_id: str = "id") -> DataFrame:
    """``interval`` of any statistic: a function from weighted rows (b, w) to (b, value)."""
    weighted = draws(df, n_boot, seed, dt, row_id) if exact else poisson_weights(df, n_boot, seed, row_id)
    return interval(stat(weighted), "value", n_boot, level)


def hypothesis(point: Column, excludes_zero: Column) -> Column:
    """Holds if the point estimate is positive and its interval excludes zero."""
    return (point > 0) & excludes_zero


def hypotheses(comparisons: DataFrame, all_orderings: DataFrame, share: float = 0.8) -> DataFrame:
    """One row (h1 .. h4, success) from comparisons(name, point, excludes_zero) and the share of cost cells where all orderings hold.

    h1: money against the best cutoff by Youden's J; h2: three-way against
    rules; h3: average precision with velocity against without; h4: orderings
    hold in at least ``share`` of cells; success: h1 and h2.
    """
    held = lambda n: F.coalesce(F.bool_or(hypothesis(F.col("point"), F.col("excludes_zero")) & (F.col("name") == n)), F.lit(False))
    one = comparisons.agg(held("profit_minus_youden").alias("h1"), held("three_way_minus_rules").alias("h2"), held("pr_auc_with_minus_without_velocity").alias("h3"))
    fourth = all_orderings.agg(F.coalesce(F.max("share_all_orderings") >= share, F.lit(False)).alias("h4"))
    return one.join(F.broadcast(fourth)).withColumn("success", F.col("h1") & F.col("h2"))
