"""Column selection: missing values, correlation pruning, univariate screening, feature cap."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegate.operators.metrics import ranking_scores
from tidegate.operators.profile import missingness
from tidegate.operators.split import ordered_sample

ABSENT = -999.0


def drop_missing(train: DataFrame, columns: list[str], limit: float = 0.95) -> tuple[list[str], dict[str, str]]:
    """(kept, reasons): columns missing in more than ``limit`` of training rows go."""
    rate = {r["column"]: r["missing_rate"] for r in missingness(train, columns).collect()} if columns else {}
    gone = {c: f"{rate[c]:.2%} of training rows lack it (limit {limit:.0%})" for c in columns if rate[c] > limit}
    return [c for c in columns if c not in gone], gone


def correlations(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """(a, b, corr): Pearson over rows where both are present, in one pass; null where one is constant."""

    def one(a: str, b: str):
        both = F.col(a).isNotNull() & F.col(b).isNotNull()
        x, y = F.when(both, F.col(a).cast("double")), F.when(both, F.col(b).cast("double"))
        return F.try_divide(F.covar_pop(x, y), F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0)))

    if not pairs:
        return df.sparkSession.createDataFrame([], "a string, b string, corr double")
    row = df.agg(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), one(a, b).alias("corr")) for a, b in pairs]).alias("x"))
    return row.select(F.explode("x").alias("x")).select("x.a", "x.b", "x.corr")


def prune_correlated(df: DataFrame, columns: list[str], limit: float = 0.90) -> tuple[list[str], dict[str, str]]:
    """Among columns of equal missing rate (to four places), each goes that correlates above ``limit`` with an earlier one that stays.

    One distributed pass finds the pairs beyond the limit; each column that
    stays then strikes out its later partners.
    """
    if not columns:
        return [], {}
    rate = {r["column"]: round(r["missing_rate"], 4) for r in missingness(df, columns).collect()}
    level = sorted(columns, key=lambda c: rate[c])  # equal rates keep their order
    alike = [(a, b) for i, a in enumerate(level) for b in level[i + 1 :] if rate[a] == rate[b]]
    close = correlations(df, alike).where(F.abs("corr") > limit)
    partners: dict[str, list[str]] = {}
    for r in close.collect():
        partners.setdefault(r.a, []).append(r.b)
    struck: dict[str, str] = {}
    for c in level:
        if c not in struck:
            for later in partners.get(c, ()):
                struck.setdefault(later, c)
    return [c for c in level if c not in struck], {c: f"follows {by}: correlation beyond {limit} where both have values" for c, by in struck.items()}


def auc_screen(df: DataFrame, columns: list[str], y: str = "y") -> DataFrame:
    """(column, strength): |AUC - 0.5| of each column alone, missing read as a value below all; constant columns have 0."""
    cols = [F.coalesce(F.col(c).cast("double"), F.lit(ABSENT)).alias(c) for c in columns]
    long = df.select(F.col(y).alias("y"), *cols).unpivot(["y"], columns, "column", "value")
    return ranking_scores(long, "value", "y", ["column"]).select("column", F.coalesce(F.abs(F.col("roc_auc") - 0.5), F.lit(0.0)).alias("strength"))


def _place(column: str) -> tuple[int, str]:
    """Order of numbered columns: V2 before V10."""
    digits = re.search(r"\d+", column)
    return int(digits.group()) if digits else 0, column


def select_columns(train: DataFrame, columns: list[str], y: str = "y", corr_limit: float = 0.90, keep: int = 35, sample_rows: int = 150_000, missing_limit: float = 0.95, seed: int = 0, row_id: str = "id") -> tuple[list[str], dict[str, str]]:
    """(kept in column order, reason per dropped column), judged on a sample of training rows."""
    sample = ordered_sample(train.select(row_id, y, *columns), sample_rows, seed, row_id).cache()
    try:
        left, reasons = sorted(columns, key=_place), {}
        for step in (lambda c: drop_missing(sample, c, missing_limit), lambda c: prune_correlated(sample, c, corr_limit)):
            left, why = step(left)
            reasons |= why
        screened = auc_screen(sample, left, y).orderBy(F.desc("strength")).collect() if left else []
    finally:
        sample.unpersist()
    best = sorted(((-r["strength"], _place(r["column"])) for r in screened))[:keep]
    kept = [c for _, (_, c) in sorted(best, key=lambda r: r[1])]
    return kept, reasons | {c: f"weaker alone than the {keep} columns kept" for c in left if c not in kept}


def require_cap(features: list[str], cap: int = 150) -> list[str]:
    if len(features) > cap:
        raise ValueError(f"{len(features)} features; the cap is {cap}")
    return features
