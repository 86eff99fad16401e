"""Ranking metrics by their textbook definitions, ties included, from one row per distinct score."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegate.operators.ordered import running, score_cell, score_table


def score_curve(df: DataFrame, score: str = "score", y: str = "y", amount: str | None = None) -> DataFrame:
    """Per distinct score: rows and positives at or above it (k, tp), with totals n_all and p_all."""
    t = score_table(df, score, y, amount)
    sums = {"tp": F.col("pos"), "k": F.col("n")}
    if amount:
        sums |= {"fraud_amt": F.col("pos_amt"), "legit_amt": F.col("neg_amt")}
    cum = running(t, score_cell(score), [F.col(score).desc()], sums, descending=True)
    total = t.agg(F.sum("n").alias("n_all"), F.sum("pos").alias("p_all"), *([F.sum("pos_amt").alias("fraud_amt_all")] if amount else []))
    return cum.join(F.broadcast(total))


def ranking_scores(df: DataFrame, score: str = "score", y: str = "y", keys: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """(keys, n, n_pos, roc_auc, pr_auc); null where only one class occurs.

    Average precision is the step-wise sum over distinct scores of recall
    gained times precision; the area under ROC counts ties by half.
    """
    keys = keys or []
    t = score_table(df, score, y, keys=keys, weight=weight)
    cum = running(t, score_cell(score), [F.col(score).desc()], {"tp": F.col("pos"), "k": F.col("n")}, descending=True, keys=keys)
    p, n = F.sum("pos"), F.sum("n")
    # Each negative of a score is beaten by all positives above, and half by those level with it.
    wins = F.sum((F.col("n") - F.col("pos")) * (F.col("tp") - F.col("pos") / 2.0))
    ap = F.sum(F.try_divide(F.col("pos") * F.col("tp"), F.col("k").cast("double")))
    both = (p > 0) & (n > p)
    return cum.groupBy(*keys).agg(n.alias("n"), p.alias("n_pos"), F.when(both, F.try_divide(wins, p * (n - p))).alias("roc_auc"), F.when(both, F.try_divide(ap, p)).alias("pr_auc"))


def top_k_flag(df: DataFrame, frac: float | None = None, k=None, score: str = "score", dt: str = "dt", row_id: str = "id", name: str = "top") -> DataFrame:
    """Flag of the ceil(frac * n) (or k) highest scores; ties go to earlier rows."""
    order = [F.col(score).desc(), F.col(dt), F.col(row_id)]
    pos = running(df, score_cell(score), order, {"__pos": F.lit(1)}, descending=True)
    if k is None:
        n = df.agg(F.ceil(F.count("*") * F.lit(frac)).alias("__k"))
    elif isinstance(k, DataFrame):
        n = k.toDF("__k")
    else:
        n = df.sparkSession.createDataFrame([(int(k),)], "__k long")
    return pos.join(F.broadcast(n)).withColumn(name, F.col("__pos") <= F.col("__k")).drop("__pos", "__k")


def precision_recall_at(df: DataFrame, frac: float | None = None, k=None, score: str = "score", y: str = "y", dt: str = "dt", row_id: str = "id") -> DataFrame:
    """One row (k, precision, recall)."""
    flagged = top_k_flag(df, frac, k, score, dt, row_id, "__top")
    tp = F.sum(F.when(F.col("__top"), F.col(y)).otherwise(0))
    n = F.count_if(F.col("__top"))
    return flagged.agg(n.alias("k"), F.try_divide(tp, n).alias("precision"), F.try_divide(tp, F.sum(y)).alias("recall"))


def ranking_metrics(df: DataFrame, fracs: tuple[float, ...] = (0.01, 0.05), score: str = "score", y: str = "y", dt: str = "dt", row_id: str = "id") -> DataFrame:
    """One row: n, n_pos, roc_auc, pr_auc, and precision and recall at each share."""
    out = ranking_scores(df, score, y)
    for f in fracs:
        tag = f"{f * 100:g}pct"
        one = precision_recall_at(df, f, None, score, y, dt, row_id)
        out = out.join(F.broadcast(one.select(F.col("precision").alias(f"precision_at_{tag}"), F.col("recall").alias(f"recall_at_{tag}"))))
    return out


def roc_curve(df: DataFrame, score: str = "score", y: str = "y") -> DataFrame:
    c = score_curve(df, score, y)
    return c.select(F.col(score).alias("threshold"), F.try_divide("tp", "p_all").alias("tpr"), F.try_divide(F.col("k") - F.col("tp"), F.col("n_all") - F.col("p_all")).alias("fpr"))


def pr_curve(df: DataFrame, score: str = "score", y: str = "y") -> DataFrame:
    c = score_curve(df, score, y)
    return c.select(F.col(score).alias("threshold"), F.try_divide("tp", "k").alias("precision"), F.try_divide("tp", "p_all").alias("recall"))


def youden_threshold(df: DataFrame, score: str = "score", y: str = "y") -> DataFrame:
    """One row (t_youden): the largest true less false positive rate, compared as integers; of equals the lowest score."""
    c = score_curve(df, score, y)
    j = F.col("tp") * (F.col("n_all") - F.col("p_all")) - (F.col("k") - F.col("tp")) * F.col("p_all")
    return c.agg(F.max_by(F.col(score), F.struct(j, -F.col(score))).alias("t_youden"))


def rule_metrics(df: DataFrame, flag: str, y: str = "y") -> DataFrame:
    """Degenerate metrics of a yes/no rule."""
    base = ranking_scores(df.withColumn("__s", F.col(flag).cast("double")), "__s", y).select(F.col("roc_auc").alias("roc_auc_degenerate"), F.col("pr_auc").alias("pr_auc_degenerate"))
    n, tp = F.count_if(F.col(flag)), F.sum(F.when(F.col(flag), F.col(y)).otherwise(0))
    return df.agg(n.alias("n_flagged"), F.try_divide(n, F.count("*")).alias("flag_rate"), F.try_divide(tp, n).alias("precision"), F.try_divide(tp, F.sum(y)).alias("recall")).join(F.broadcast(base))


def at_rule_volume(df: DataFrame, flag: str, score: str = "score", y: str = "y", dt: str = "dt", row_id: str = "id") -> DataFrame:
    """One row (k, precision, recall): the model at as many flags as the rule raises."""
    k = df.agg(F.count_if(F.col(flag)).alias("k"))
    return precision_recall_at(df, k=k, score=score, y=y, dt=dt, row_id=row_id)
