"""Population stability: features and scores against a reference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegate.functions.costs import decide
from tidegate.operators.metrics import ranking_scores
from tidegate.operators.ordered import quantile_array, quantiles

FLOOR = 1e-4


def band(psi: Column | str, warn: float = 0.10, alert: float = 0.25) -> Column:
    psi = F.col(psi) if isinstance(psi, str) else psi
    return F.when(psi.isNull() | F.isnan(psi), "n/a").when(psi >= alert, "significant").when(psi >= warn, "moderate").otherwise("stable")


def _index(keys: list[str], bins: DataFrame) -> DataFrame:
    """PSI per key of (keys, bin, ref, cur) counts over a complete spine; null where either side is empty."""
    whole = Window.partitionBy(*keys)
    e = F.greatest(F.try_divide("ref", F.sum("ref").over(whole)), F.lit(FLOOR))
    a = F.greatest(F.try_divide("cur", F.sum("cur").over(whole)), F.lit(FLOOR))
    part = bins.select(*keys, ((a - e) * F.log(a / e)).alias("part"), F.sum("ref").over(whole).alias("n_ref"), F.sum("cur").over(whole).alias("n_cur"))
    return part.groupBy(*keys).agg(F.when((F.max("n_ref") > 0) & (F.max("n_cur") > 0), F.sum("part")).alias("psi"))


def quantile_edges(ref: DataFrame, value: str, keys: list[str] | None = None, n_bins: int = 10, digits: int | None = None) -> DataFrame:
    """(keys, edges): distinct interior quantiles of the reference; ``digits`` rounds them off the data."""
    keys = keys or []
    q = F.col("q") if digits is None else F.transform("q", lambda x: F.round(x, digits))
    edges = quantile_array(ref, value, [i / n_bins for i in range(1, n_bins)], keys).select(*keys, F.array_sort(F.array_distinct(q)).alias("edges"))
    none = F.coalesce("edges", F.expr("cast(array() as array<double>)")).alias("edges")
    groups = ref.select(*keys).distinct() if keys else ref.sparkSession.range(1).select()
    return groups.join(edges, keys, "left").select(*keys, none) if keys else groups.join(edges, how="left").select(none)


def numeric_bin(value: str, edges: str = "edges") -> Column:
    """Number of edges at or below the value; one past the last bin for a missing value."""
    return F.when(F.col(value).isNull(), F.size(edges) + 1).otherwise(F.size(F.filter(edges, lambda e: e <= F.col(value))))


def psi_numeric(ref: DataFrame, cur: DataFrame, value: str, keys: list[str] | None = None, n_bins: int = 10, digits: int | None = None, cur_keys: list[str] | None = None) -> DataFrame:
    """(keys, psi) of a column; ``keys`` group both sides, ``cur_keys`` only the current one (one shared reference)."""
    keys, cur_keys = keys or [], cur_keys or []
    edges = quantile_edges(ref, value, keys, n_bins, digits)

    def counts(df: DataFrame, by: list[str], name: str) -> DataFrame:
        df = df.join(edges, keys) if keys else df.join(F.broadcast(edges))  # one row
        return df.groupBy(*by, numeric_bin(value).alias("bin")).agg(F.count("*").alias(name))

    have_r, have_c = counts(ref, keys, "ref"), counts(cur, [*keys, *cur_keys], "cur")
    spine = edges.select(*keys, F.explode(F.sequence(F.lit(0), F.size("edges") + 1)).alias("bin"))
    if cur_keys:
        groups = cur.select(*keys, *cur_keys).distinct()
        spine = groups.join(spine, keys) if keys else groups.join(F.broadcast(spine))  # a row for each bin
    out = spine.join(have_r, [*keys, "bin"], "left").join(have_c, [*keys, *cur_keys, "bin"], "left")
    return _index([*keys, *cur_keys], out.fillna(0, ["ref", "cur"]))


def psi_categorical(ref: DataFrame, cur: DataFrame, value: str, keys: list[str] | None = None) -> DataFrame:
    """(keys, psi) over the reference's categories, one bin for unseen and one for missing values."""
    keys = keys or []
    missing = F.when(F.col(value).isNull(), 1).otherwise(0)
    r = ref.groupBy(*keys, F.coalesce(F.col(value).cast("string"), F.lit("")).alias("v"), missing.alias("m")).agg(F.count("*").alias("ref"))
    c = cur.groupBy(*keys, F.coalesce(F.col(value).cast("string"), F.lit("")).alias("v"), missing.alias("m")).agg(F.count("*").alias("cur"))
    both = r.join(c, [*keys, "v", "m"], "full").fillna(0, ["ref", "cur"])
    unseen = (F.col("ref") == 0) & (F.col("m") == 0)
    bins = both.groupBy(*keys, F.when(unseen, 2).otherwise(F.col("m")).alias("k"), F.when(unseen, "").otherwise(F.col("v")).alias("bin")).agg(F.sum("ref").alias("ref"), F.sum("cur").alias("cur"))
    return _index(keys, bins)


def feature_psi(ref: DataFrame, cur: DataFrame, numeric: list[str], categorical: list[str] = (), n_bins: int = 10, warn: float = 0.10, alert: float = 0.25, digits: int | None = None) -> DataFrame:
    """(feature, psi, band) for all features: one unpivoted pass for numbers, one for categories."""

    def long(df: DataFrame, cols: list[str], kind: str) -> DataFrame:
        return df.select(*[F.col(c).cast(kind).alias(c) for c in cols]).unpivot([], cols, "feature", "value")

    out = None
    if numeric:
        out = psi_numeric(long(ref, numeric, "double"), long(cur, numeric, "double"), "value", ["feature"], n_bins, digits)
    if categorical:
        c = psi_categorical(long(ref, list(categorical), "string"), long(cur, list(categorical), "string"), "value", ["feature"])
        out = c if out is None else out.union(c)
    return out.withColumn("band", band("psi", warn, alert)).orderBy(F.col("psi").desc_nulls_last(), "feature")


def score_stability(ref: DataFrame, cur: DataFrame, t_decline, t_review, days: int = 7, n_bins: int = 10, warn: float = 0.10, alert: float = 0.25, digits: int | None = None, score: str = "score", y: str = "y", dt: str = "dt") -> DataFrame:
    """One row per window of ``days``: size, start, scores, flag rates, fraud, average precision and PSI against the reference."""
    start = cur.agg(F.min(dt).alias("__t0"))
    cur = cur.join(F.broadcast(start)).withColumn("window", F.floor((F.col(dt) - F.col("__t0")) / (days * 86_400)))
    d = decide(score, t_decline, t_review)
    rate = lambda c: F.avg(c.cast("double"))
    base = cur.groupBy("window").agg(F.count("*").alias("n"), ((F.min(dt) - F.first("__t0")) / 86_400).alias("days_from_start"), F.avg(score).alias("mean_score"), rate(d == 2).alias("decline_rate"), rate(d == 1).alias("review_rate"), F.avg(y).alias("fraud_rate"))
    high = quantiles(cur, score, [0.99], ["window"]).select("window", F.col("q").alias("p99_score"))
    ap = ranking_scores(cur, score, y, ["window"]).select("window", "pr_auc")
    psi = psi_numeric(ref.select(score), cur.select("window", score), score, n_bins=n_bins, digits=digits, cur_keys=["window"])
    out = base.join(high, "window", "left").join(ap, "window").join(psi, "window")
    return out.select("window", "n", "days_from_start", "mean_score", "p99_score", "decline_rate", "review_rate", "fraud_rate", "pr_auc", "psi").withColumn("band", band("psi", warn, alert))


def monitor_rollup(features: DataFrame, families: DataFrame | None = None) -> DataFrame:
    """One row: how many features lie in each band, and the largest index; with families(feature, family) also the drifted features by name, worst first, and their count by family."""
    count = [F.count("*").alias("n_features"), *[F.count_if(F.col("band") == b).alias(f"n_{b}") for b in ("significant", "moderate", "stable")], F.max("psi").alias("max_psi")]
    if families is None:
        return features.agg(*count)
    named = features.join(families, "feature", "left").withColumn("family", F.coalesce("family", F.lit("Unknown")))
    worst = lambda b: F.array_sort(F.collect_list(F.when(F.col("band") == b, F.struct((-F.col("psi")).alias("k"), "feature", "family", "psi"))))
    lists = [F.transform(worst(b), lambda x: F.struct(x["feature"].alias("feature"), x["family"].alias("family"), x["psi"].alias("psi"))).alias(f"{b}_features") for b in ("significant", "moderate")]
    out = named.agg(*count, *lists)
    per = named.where("band = 'significant'").groupBy("family").agg(F.count("*").alias("n"))
    by = per.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("family", "n")))).alias("significant_by_family"))
    return out.join(F.broadcast(by))


def band_by_family(features: DataFrame, families: DataFrame) -> DataFrame:
    """(family, band, n); families(feature, family)."""
    return features.join(families, "feature", "left").groupBy(F.coalesce("family", F.lit("Unknown")).alias("family"), "band").agg(F.count("*").alias("n"))


def breach_runs(daily: DataFrame, cap: DataFrame, least: int = 3) -> DataFrame:
    """(first_day, last_day, length) of at least ``least`` consecutive days over capacity: gaps and islands over days."""
    over = daily.join(F.broadcast(cap)).where(F.col("reviews") > F.col("cap")).select("day")
    island = over.withColumn("g", F.col("day") - F.row_number().over(Window.orderBy("day")))
    return island.groupBy("g").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count("*").alias("length")).where(F.col("length") >= least).drop("g")


def triggers(rollup: DataFrame, windows: DataFrame, runs: DataFrame, decline_rate: float, label_age_days: float, most_features: int = 5, alert: float = 0.25, swing: float = 0.5, mature_days: float = 90) -> DataFrame:
    """One row of yes/no operating triggers.

    Features beyond the alert; the score's index beyond it in any window of
    ``score_stability``; a window's decline rate more than ``swing`` away from
    the chosen one; runs of days over capacity; labels younger than they need
    to be for judging a model.
    """
    w = windows.agg(F.max("psi").alias("score_psi_max"), F.max(F.abs(F.col("decline_rate") - decline_rate)).alias("__away"))
    r = runs.agg(F.count("*").alias("capacity_runs"))
    both = rollup.join(F.broadcast(w)).join(F.broadcast(r))
    return both.select(
        (F.col("n_significant") >= most_features).alias("features_drifted"), (F.coalesce("score_psi_max", F.lit(0.0)) > alert).alias("scores_drifted"),
        (F.coalesce("__away", F.lit(0.0)) > swing * decline_rate).alias("declines_moved"), (F.col("capacity_runs") > 0).alias("over_capacity"), F.lit(label_age_days < mature_days).alias("labels_young"),
    )
