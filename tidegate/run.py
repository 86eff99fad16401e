"""The whole job in stages, each from the tables of the one before: python -m tidegate.run --out FOLDER [--stage NAME ...] [--transactions FILE --identities FILE].

Without input files the synthetic source is used.  All tables and results go
to ``--out``, any folder Spark can write.
"""

from __future__ import annotations

import argparse
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegate.functions.costs import CostParams
from tidegate.models import gbt
from tidegate.operators import bootstrap, drift, metrics, policy, profile, sensitivity, split, swap
from tidegate.operators import thresholds as th
from tidegate.operators.ordered import local_table
from tidegate.plans import decision
from tidegate.plans.features import Manifest, Options, build_features, manifest_tables
from tidegate.reporting import text
from tidegate.sources import tables
from tidegate.sources.synthetic import synthetic_tables

COLUMNS = {"meta_TransactionID": "id", "meta_TransactionDT": "dt", "meta_TransactionAmt": "amount", "meta_isFraud": "y", "meta_split": "split", "meta_ProductCD": "product", "meta_card_tenure_days": "tenure", "meta_uid_prior_cnt": "prior_cnt"}


class Job:
    def __init__(self, spark: SparkSession, out: str, transactions: str | None = None, identities: str | None = None, rows: int = 20_000, rounds: int = 20, n_boot: int = 1000):
        self.spark, self.out, self.files, self.rows, self.rounds, self.n_boot = spark, out.rstrip("/"), (transactions, identities), rows, rounds, n_boot

    def write(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.out}/{name}")
        return self.read(name)

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.out}/{name}")

    def save(self, value, name: str) -> None:
        tables.save_json(value, self.spark, f"{self.out}/{name}")

    def load(self, name: str):
        return tables.load_json(self.spark, f"{self.out}/{name}")

    def data(self) -> None:
        """Scan, enrich, split; profile of the columns."""
        if self.files[0]:
            tx, ids = (tables.scan_csv(self.spark, f) for f in self.files)
        else:
            tx, ids = synthetic_tables(self.spark, self.rows)
        base = split.time_split(tables.enrich(tx, ids, "TransactionID"), dt="TransactionDT")
        base = self.write(base, "base")
        split.check_split(base, "TransactionDT")
        plain = base.select(F.col("TransactionDT").alias("dt"), F.col("isFraud").alias("y"), "DeviceType")
        self.save({"scalars": profile.scalars(plain, identity="DeviceType").first().asDict(), "dictionary": profile.data_dictionary(base)}, "data.json")

    def features(self) -> None:
        frame, manifest = build_features(self.read("base"), Options())
        self.write(frame, "features")
        for df, name in zip(manifest_tables(self.spark, manifest), ("features_kept", "columns_dropped"), strict=True):
            self.write(df, name)
        self.save(manifest.to_json(), "manifest.json")

    def _manifest(self) -> Manifest:
        got = self.load("manifest.json")
        kept = {r.feature: r.family for r in self.read("features_kept").collect()}
        return Manifest({f: kept[f] for f in got["families"]}, got["vocabularies"], got["dropped"])

    def train(self) -> None:
        """A model of all features and one without the velocity family, scored on validation and test rows."""
        m = self._manifest()
        frame = self.read("features")
        frame = frame.withColumnsRenamed({k: v for k, v in COLUMNS.items() if k in frame.columns})
        spec = gbt.Spec(m.numeric(), list(m.vocabularies))
        scored, full, _ = gbt.ablate(frame.where("split = 'train'"), frame.where("split <> 'train'"), spec, m.families, rounds=self.rounds)
        self.write(scored.select(*COLUMNS.values(), "score", "score_b"), "predictions")
        self.write(frame.where("split = 'train'").select(*COLUMNS.values()), "training_meta")
        gbt.save(full, f"{self.out}/model", spec)
        rows = gbt.importance(full, spec, m.families)
        self.save({"importance": rows, "by_family": gbt.share_by_family(rows)}, "model.json")

    def decide(self) -> None:
        """Policies chosen on validation, judged on test; bootstrap, sensitivity, hypotheses."""
        preds, train, p = self.read("predictions"), self.read("training_meta"), CostParams()
        valid, test = (preds.where(F.col("split") == s) for s in ("valid", "test"))
        got = decision.choose(train, valid, test, p)
        t = policy.benefits(got.test, p, decision.POLICIES)
        self.write(policy.evaluate_policies(got.test, p, decision.POLICIES), "headline_policies")
        self.write(swap.characterise(got.test, "dec_profit_single", "dec_youden_single"), "swap_sets")
        self.write(got.chosen, "chosen")
        self.write(policy.reviews_per_day(got.test, "dec_profit_three_way"), "reviews_per_day")
        limit = got.chosen.select("cap").join(F.broadcast(policy.split_days(valid))).select(F.col("cap") * F.col("days"))
        cells = sensitivity.run(sensitivity.cost_cells(self.spark), valid, got.test, got.grid, got.pair_grid, limit, got.chosen.select("t_youden"), "rules")
        cells = self.write(cells, "sensitivity_grid")
        stable = local_table(sensitivity.ranking_stability(cells))
        comparisons = self.write(decision.comparisons(t, self.n_boot), "comparisons")
        held = bootstrap.hypotheses(comparisons, stable).first().asDict()
        self.save({"hypotheses": held, "stability": stable.first().asDict(), "ranking": metrics.ranking_metrics(got.test).first().asDict(), "rules": metrics.rule_metrics(got.test, "rules").first().asDict(), "ranges": [r.asDict() for r in sensitivity.ranges(cells, tuple(c for c in cells.columns if c.startswith("nb1000_"))).collect()]}, "decide.json")

    def monitor(self) -> None:
        m, frame, preds = self._manifest(), self.read("features"), self.read("predictions")
        train, test = (frame.where(F.col("meta_split") == s) for s in ("train", "test"))
        chosen = self.read("chosen").first()
        psi = self.write(drift.feature_psi(train, test, m.numeric(), list(m.vocabularies)), "feature_psi")
        windows = drift.score_stability(preds.where("split = 'valid'"), preds.where("split = 'test'"), chosen.t_decline, chosen.t_review)
        windows = self.write(windows, "score_stability")
        rollup = drift.monitor_rollup(psi, self.read("features_kept").select("feature", "family"))
        runs = drift.breach_runs(self.read("reviews_per_day"), self.read("chosen").select("cap"))
        usual = preds.where("split = 'valid'").agg(F.avg((F.col("score") >= chosen.t_decline).cast("double"))).first()[0]
        fired = drift.triggers(rollup, windows, runs, usual, 0.0).first().asDict()
        self.save({"rollup": rollup.first().asDict(True), "triggers": fired}, "monitor.json")

    def report(self) -> None:
        """A short text whose numbers all come from the results, which is checked."""
        decide, rows = self.load("decide.json"), {r.policy: r for r in self.read("headline_policies").collect()}
        results = {"decide": decide, "headline": {k: r.asDict() for k, r in rows.items()}}
        line = "$policy saves $value per $thousand transactions.\n"
        body = "".join(text.render(line, {"policy": k.replace("_", " "), "value": text.shown(r.net_benefit_per_1000, "usd", 2), "thousand": text.shown(1000, "int")}) for k, r in sorted(rows.items(), key=lambda x: x[1].ord))
        body += text.render("All orderings hold in $share of cost settings.\n", {"share": text.shown(decide["stability"]["share_all_orderings"], "pct")})
        leaves = self.spark.createDataFrame([(v,) for v in [*text.computed_numbers(results), 1000.0]], "value double")
        wrong = text.unsupported_numbers(self.spark.createDataFrame([(body,)], "text string"), leaves).collect()
        if wrong:
            raise ValueError(f"numbers that no result equals: {[r.token for r in wrong]}")
        self.spark.createDataFrame([(body,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.out}/report.txt")


STAGES: dict[str, Callable[[Job], None]] = {"data": Job.data, "features": Job.features, "train": Job.train, "decide": Job.decide, "monitor": Job.monitor, "report": Job.report}


def run(job: Job, stages: list[str] | None = None, say: Callable[[str], None] = print) -> None:
    for name in stages or list(STAGES):
        began = time.perf_counter()
        STAGES[name](job)
        say(f"{name}: {time.perf_counter() - began:.1f} s")


def main(args: list[str] | None = None) -> None:
    a = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    a.add_argument("--out", required=True)
    a.add_argument("--stage", choices=list(STAGES), action="append")
    a.add_argument("--transactions")
    a.add_argument("--identities")
    a.add_argument("--rows", type=int, default=20_000, help="rows of the synthetic source")
    a.add_argument("--rounds", type=int, default=20)
    a.add_argument("--bootstrap", type=int, default=1000)
    o = a.parse_args(args)
    if bool(o.transactions) != bool(o.identities):
        a.error("give both input files or none")
    spark = SparkSession.builder.appName("tidegate").getOrCreate()
    run(Job(spark, o.out, o.transactions, o.identities, o.rows, o.rounds, o.bootstrap), o.stage)


if __name__ == "__main__":
    main()
