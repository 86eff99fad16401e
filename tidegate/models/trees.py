"""Boosted trees as data: exported from a fitted model, scored by plain column expressions or SQL.

A tree is a nested dict: a leaf is a number; a split on a number holds
``column``, ``at`` and the subtrees ``low`` (value <= at) and ``high``; one on
a category holds ``column``, ``values`` and ``low`` (value among them) and
``high``.  Scoring needs no model object on the executors and stays inside
generated code.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.sql import Column
from pyspark.sql import functions as F

from tidegate.models.gbt import SENTINEL, Spec


def export_trees(model: PipelineModel, spec: Spec) -> list[tuple[float, dict | float]]:
    """(weight, tree) of each boosting round of a fitted model."""
    gbt = model.stages[-1]
    labels = model.stages[0].labelsArray if spec.categorical else []
    n = len(spec.numeric)

    def split(s) -> dict:
        i = s.featureIndex()
        if i >= 2 * n:
            own = labels[i - 2 * n]
            left = {int(x) for x in s.leftCategories()}
            return {"column": spec.categorical[i - 2 * n], "values": [v for k, v in enumerate(own) if k in left], "rest": len(own) in left, "known": list(own)}
        return {"column": spec.numeric[i % n], "at": float(s.threshold()), "missing": i >= n}

    def node(x):
        if not hasattr(x, "split"):
            return float(x.prediction())
        if x.getClass().getSimpleName() == "LeafNode":
            return float(x.prediction())
        return split(x.split()) | {"low": node(x.leftChild()), "high": node(x.rightChild())}

    def root(tree):
        top = tree._call_java("rootNode")
        return node(top)

    return [(float(w), root(t)) for w, t in zip(gbt.treeWeights, gbt.trees, strict=True)]


def _fold(tree, test: Callable[[dict], object], choose: Callable[[object, object, object], object], leaf: Callable[[float], object]):
    if not isinstance(tree, dict):
        return leaf(tree)
    return choose(test(tree), _fold(tree["low"], test, choose, leaf), _fold(tree["high"], test, choose, leaf))


def margin(trees: list[tuple[float, dict | float]]) -> Column:
    """The weighted sum of the trees' leaves."""

    def test(t: dict) -> Column:
        if "at" in t:
            value = F.col(t["column"])
            value = value.isNull().cast("double") if t.get("missing") else F.coalesce(value.cast("double"), F.lit(SENTINEL))
            return value <= F.lit(t["at"])
        value = F.coalesce(F.col(t["column"]).cast("string"), F.lit("__nan__"))
        low = value.isin(t["values"]) if t["values"] else F.lit(False)
        return low | ~value.isin(t["known"]) if t.get("rest") else low

    one = lambda tree: _fold(tree, test, lambda c, low, high: F.when(c, low).otherwise(high), F.lit)
    return reduce(lambda x, y: x + y, (F.lit(w) * one(t) for w, t in trees))


def probability(trees: list[tuple[float, dict | float]]) -> Column:
    """Probability of class 1 from the margin of logistic loss with labels -1 and 1."""
    return 1 / (1 + F.exp(-2 * margin(trees)))


def margin_sql(trees: list[tuple[float, dict | float]]) -> str:
    """``margin`` as an SQL expression."""

    def test(t: dict) -> str:
        c = t["column"]
        if "at" in t:
            return f"{f'({c} IS NULL)::INTEGER' if t.get('missing') else f'coalesce({c}, {SENTINEL})'} <= {t['at']!r}::DOUBLE"
        quoted = lambda v: "(" + ", ".join("'" + x.replace("'", "''") + "'" for x in v) + ")"
        value = f"coalesce({c}::VARCHAR, '__nan__')"
        low = f"{value} IN {quoted(t['values'])}" if t["values"] else "false"
        return f"({low} OR {value} NOT IN {quoted(t['known'])})" if t.get("rest") else low

    one = lambda tree: _fold(tree, test, lambda c, low, high: f"CASE WHEN {c} THEN {low} ELSE {high} END", lambda v: f"{v!r}::DOUBLE")
    return " + ".join(f"{w!r}::DOUBLE * ({one(t)})" for w, t in trees)
