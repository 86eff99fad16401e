"""The expected-cost model as column expressions."""

from __future__ import annotations

import math
from dataclasses import dataclass, fields, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

APPROVE, REVIEW, DECLINE = 0, 1, 2


@dataclass(frozen=True)
class CostParams:
    margin_rate: float = 0.02
    churn_penalty: float = 10.0
    review_cost: float = 5.0
    review_catch_rate: float = 0.85

    def __post_init__(self) -> None:
        values = {f.name: getattr(self, f.name) for f in fields(self)}
        bad = [n for n, v in values.items() if not (math.isfinite(v) and v >= 0)]
        bad += ["review_catch_rate"] if values["review_catch_rate"] > 1 and not bad else []
        if bad:
            raise ValueError(f"out of range: {', '.join(f'{n} = {values[n]}' for n in bad)}")

    def with_(self, **changes) -> CostParams:
        return replace(self, **changes)


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _guarded(value: Column, y, amount, decision=None) -> Column:
    """``value``, or an error for a label that isn't 0 or 1, a null or negative amount, or an unknown decision."""
    ok = _c(y).isin(0, 1) & (_c(amount) >= 0)
    if decision is not None:
        ok = ok & _c(decision).isin(APPROVE, REVIEW, DECLINE)
    return F.when(F.coalesce(ok, F.lit(False)), value).otherwise(F.raise_error(F.lit("bad label, amount or decision")).cast("double"))


def checked(y, amount, decision=None) -> Column:
    """``amount`` under the checks."""
    return _guarded(_c(amount), y, amount, decision)


def decide(score, t_decline, t_review=None) -> Column:
    """2 from t_decline on, 1 from t_review on, else 0.  Infinity never triggers; thresholds out of order are an error."""
    given = [t for t in (t_review, t_decline) if t is not None and not isinstance(t, Column)]
    if given != sorted(given):
        raise ValueError("t_review must not exceed t_decline")
    score, t_decline = _c(score), t_decline if isinstance(t_decline, Column) else F.lit(float(t_decline))
    out = F.when(score >= t_decline, DECLINE)
    if t_review is None:
        return out.otherwise(APPROVE).cast("tinyint")
    t_review = t_review if isinstance(t_review, Column) else F.lit(float(t_review))
    out = out.when(score >= t_review, REVIEW).otherwise(APPROVE)
    if len(given) < 2:
        out = F.when(t_review > t_decline, F.raise_error(F.lit("t_review must not exceed t_decline")).cast("int")).otherwise(out)
    return out.cast("tinyint")


def false_decline_cost(amount, p: CostParams) -> Column:
    return F.lit(p.margin_rate) * _c(amount) + F.lit(p.churn_penalty)


def row_cost(decision, y, amount, p: CostParams) -> Column:
    """What a decision costs against perfect knowledge.  A label other than 0 or 1, a null or negative amount and an unknown decision are errors."""
    decision, y, amount = _c(decision), _c(y), _c(amount)
    review = F.lit(p.review_cost) + F.when(y == 1, F.lit(1 - p.review_catch_rate) * amount).otherwise(0.0)
    cost = F.when(decision == REVIEW, review).when((decision == APPROVE) & (y == 1), amount).when((decision == DECLINE) & (y == 0), false_decline_cost(amount, p)).otherwise(0.0)
    return _guarded(cost, y, amount, decision)


def row_benefit(decision, y, amount, p: CostParams) -> Column:
    """Cost saved against approving everything."""
    return F.when(_c(y) == 1, _c(amount)).otherwise(0.0) - row_cost(decision, y, amount, p)


def rules_decline(amount, prior_count, threshold) -> Column:
    """A large amount on an account without history; unknown history is not new."""
    threshold = threshold if isinstance(threshold, Column) else F.lit(threshold)
    return (_c(amount) > threshold) & F.coalesce(_c(prior_count) == 0, F.lit(False))


def summary_columns(decision, y, amount, p: CostParams, days) -> list[Column]:
    """The measures of one policy, for one aggregate."""
    d, y, a = _c(decision), _c(y), _c(amount)
    cost, fraud, legit = row_cost(d, y, a, p), y == 1, y == 0  # row_cost checks all three
    caught = F.when(d == DECLINE, 1.0).when(d == REVIEW, p.review_catch_rate).otherwise(0.0)

    def total(cond, value=None):
        return F.sum(F.when(cond, value if value is not None else F.lit(1)).otherwise(0))

    n, n_rev = F.count("*"), total(d == REVIEW)
    net = F.sum(F.when(fraud, a).otherwise(0.0) - cost)
    days = days if isinstance(days, Column) else F.lit(float(days))
    return [
        n.alias("n"), F.sum(cost).alias("total_cost"), total(fraud, a).alias("approve_all_cost"), net.alias("net_benefit"),
        F.try_divide(net * 1000, n).alias("net_benefit_per_1000"),
        F.try_divide(total(d == DECLINE), n).alias("decline_rate"), F.try_divide(n_rev, n).alias("review_rate"),
        F.try_divide(total(legit & (d == DECLINE)), total(legit)).alias("good_customer_disruption_rate"),
        F.try_divide(total(legit & (d == REVIEW)), total(legit)).alias("good_customer_review_rate"),
        F.try_divide(total(fraud, caught), total(fraud)).alias("fraud_capture_rate_count"),
        F.try_divide(total(fraud, caught * a), total(fraud, a)).alias("fraud_capture_rate_dollars"),
        total(fraud, cost).alias("fraud_loss_remaining"),
        total(legit & (d == DECLINE), cost).alias("false_decline_cost"),
        (n_rev * p.review_cost).alias("review_cost_total"),
        total(d == DECLINE).alias("n_declined"), n_rev.alias("n_reviewed"), total(legit & (d == DECLINE)).alias("n_false_declines"),
        F.when(F.max(days) > 0, n_rev / F.max(days)).alias("reviews_per_day"),
    ]
