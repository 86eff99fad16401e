"""Gradient-boosted trees over expanding time folds.

The learner is Spark ML's: depth-wise trees instead of leaf-wise ones, so
numbers differ from other libraries; roles, folds and selection are the same.
Missing numbers get a sentinel and an indicator; categories are indexed with
unknown ones kept.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegate.operators.metrics import ranking_scores
from tidegate.operators.split import out_of_fold_blocks

SENTINEL = -999.0


@dataclass
class Spec:
    numeric: list[str]
    categorical: list[str] = field(default_factory=list)
    y: str = "y"


def prepare(df: DataFrame, spec: Spec) -> DataFrame:
    cols = {f"num_{c}": F.coalesce(F.col(c).cast("double"), F.lit(SENTINEL)) for c in spec.numeric}
    cols |= {f"abs_{c}": F.col(c).isNull().cast("double") for c in spec.numeric}
    cols |= {f"str_{c}": F.coalesce(F.col(c).cast("string"), F.lit("__nan__")) for c in spec.categorical}
    return df.withColumns(cols | {"label": F.col(spec.y).cast("double")})


def pipeline(spec: Spec, rounds: int, depth: int, least_rows: int, feature_share: float, step: float, seed: int) -> Pipeline:
    stages = []
    if spec.categorical:
        stages.append(StringIndexer(inputCols=[f"str_{c}" for c in spec.categorical], outputCols=[f"idx_{c}" for c in spec.categorical], handleInvalid="keep", stringOrderType="frequencyDesc"))
    inputs = [f"num_{c}" for c in spec.numeric] + [f"abs_{c}" for c in spec.numeric] + [f"idx_{c}" for c in spec.categorical]
    stages.append(VectorAssembler(inputCols=inputs, outputCol="features"))
    stages.append(GBTClassifier(maxIter=rounds, maxDepth=depth, minInstancesPerNode=least_rows, featureSubsetStrategy=str(feature_share), stepSize=step, seed=seed, maxBins=256))
    return Pipeline(stages=stages)


def fit(df: DataFrame, spec: Spec, rounds: int = 20, depth: int = 4, least_rows: int = 20, feature_share: float = 0.5, step: float = 0.1, seed: int = 20240917) -> PipelineModel:
    return pipeline(spec, rounds, depth, least_rows, feature_share, step, seed).fit(prepare(df, spec))


def predict(model: PipelineModel, df: DataFrame, spec: Spec, name: str = "score") -> DataFrame:
    keep = df.columns
    out = model.transform(prepare(df, spec))
    return out.select(*keep, F.get(vector_to_array("probability"), F.lit(1)).alias(name))


def prefix_scores(model: PipelineModel, df: DataFrame, spec: Spec) -> list[float]:
    """Average precision after each boosting round, for early stopping by any patience: one pass in which each row tells its margin after every round."""
    from tidegate.models.trees import export_trees, margin

    trees = export_trees(model, spec)
    each = F.array(*[margin([t]) for t in trees])
    upto = F.transform(F.sequence(F.lit(1), F.lit(len(trees))), lambda n: F.aggregate(F.slice("__each", F.lit(1), n), F.lit(0.0), lambda a, x: a + x))
    rows = df.select(F.col(spec.y).alias("y"), each.alias("__each")).select("y", F.posexplode(upto).alias("round", "score"))
    got = {r["round"]: r["pr_auc"] for r in ranking_scores(rows, "score", "y", ["round"]).collect()}
    return [got.get(i) or 0.0 for i in range(len(trees))]


def best_round(scores: list[float], patience: int = 100) -> int:
    best = 0
    for i, s in enumerate(scores):
        if s > scores[best]:
            best = i
        elif i - best >= patience:
            break
    return best + 1


def cross_validate(df: DataFrame, spec: Spec, grid: list[dict], folds: int = 5, dt: str = "dt", row_id: str = "id", rounds: int = 20, patience: int = 100, seed: int = 20240917) -> list[dict]:
    """Mean and sample deviation of average precision over expanding folds for each grid point, best first; ties by parameters."""
    blocks = out_of_fold_blocks(df, folds + 1, dt, row_id, "__block").cache()
    rows = []
    try:
        for combo in grid:
            ap, stop = [], []
            for i in range(folds):
                model = fit(blocks.where(F.col("__block") <= i), spec, rounds=rounds, seed=seed, **combo)
                scores = prefix_scores(model, blocks.where(F.col("__block") == i + 1), spec)
                best = best_round(scores, patience)
                ap.append(scores[best - 1])
                stop.append(best)
            mean = sum(ap) / folds
            dev = (sum((a - mean) ** 2 for a in ap) / (folds - 1)) ** 0.5 if folds > 1 else None
            rows.append({**combo, "pr_auc_mean": mean, "pr_auc_std": dev, "rounds": round(sum(stop) / folds)})
    finally:
        blocks.unpersist()
    return sorted(rows, key=lambda r: (-r["pr_auc_mean"], json.dumps({k: v for k, v in r.items() if k not in ("pr_auc_mean", "pr_auc_std", "rounds")}, sort_keys=True)))


def cv_rounds(df: DataFrame, spec: Spec, params: dict, **options) -> int:
    return cross_validate(df, spec, [params], **options)[0]["rounds"]


def importance(model: PipelineModel, spec: Spec, families: dict[str, str] | None = None) -> list[tuple[str, float, str]]:
    """(feature, share, family), largest first; a number and its indicator count together."""
    v = model.stages[-1].featureImportances.toArray()
    n = len(spec.numeric)
    share = {c: float(v[i] + v[n + i]) for i, c in enumerate(spec.numeric)} | {c: float(v[2 * n + i]) for i, c in enumerate(spec.categorical)}
    return sorted(((c, s, (families or {}).get(c, "raw")) for c, s in share.items()), key=lambda r: (-r[1], r[0]))


def share_by_family(rows: list[tuple[str, float, str]]) -> dict[str, float]:
    """The parts of all importance that families have, largest first."""
    total = sum(s for _, s, _ in rows) or 1.0
    out: dict[str, float] = {}
    for _, s, f in rows:
        out[f] = out.get(f, 0.0) + s / total
    return dict(sorted(out.items(), key=lambda r: (-r[1], r[0])))


def ablate(train: DataFrame, rest: DataFrame, spec: Spec, families: dict[str, str], family: str = "velocity", names: tuple[str, str] = ("score", "score_b"), **params) -> tuple[DataFrame, PipelineModel, PipelineModel]:
    """``rest`` scored by a model of all features and by one, of the same parameters, without a family; and both models."""
    less = Spec([c for c in spec.numeric if families.get(c) != family], [c for c in spec.categorical if families.get(c) != family], spec.y)
    full, part = fit(train, spec, **params), fit(train, less, **params)
    return predict(part, predict(full, rest, spec, names[0]), less, names[1]), full, part


def save(model: PipelineModel, path: str, spec: Spec) -> None:
    """Spark's own model format, with the columns beside it."""
    model.write().overwrite().save(path)
    rows = [(json.dumps({"numeric": spec.numeric, "categorical": spec.categorical, "y": spec.y}),)]
    from pyspark.sql import SparkSession

    SparkSession.active().createDataFrame(rows, "spec string").coalesce(1).write.mode("overwrite").text(f"{path}/spec")


def load(path: str) -> tuple[PipelineModel, Spec]:
    from pyspark.sql import SparkSession

    spec = json.loads(SparkSession.active().read.text(f"{path}/spec").first()[0])
    if set(spec) != {"numeric", "categorical", "y"}:
        raise ValueError("not a model of this library")
    return PipelineModel.load(path), Spec(**spec)
