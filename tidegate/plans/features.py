"""The feature plan: a table of features from split transactions, and the manifest that says what became of every column.

Only training rows are fitted on: which columns are too empty, which
vocabularies and vendor columns stay, and what categories are worth.  Windows
look strictly backward.  Fits are single aggregates over all columns of a
kind; their small results are the manifest.  The rest is two plans with a written table
between: windows, those of one key sharing a partitioning, and encodings.
"""

from __future__ import annotations

import re
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegate.functions import keys
from tidegate.operators import encoding, selection, windows
from tidegate.operators.ordered import local_rows
from tidegate.operators.profile import missingness
from tidegate.sources.tables import staged

# The columns of the transaction schema that may become features, and why others never do.
NUMBERS = ["TransactionAmt", "card1", "card2", "card3", "card5", "addr1", "addr2", "dist1", "dist2", *[f"C{i}" for i in range(1, 15)], *[f"D{i}" for i in range(1, 16)], *[f"id_{i:02d}" for i in (1, 2, 3, 5, 6, 9, 11, 13, 14, 17, 19, 20, 32)]]
CATEGORIES = ["ProductCD", "card4", "card6", "P_emaildomain", "R_emaildomain", *[f"M{i}" for i in range(1, 10)], "DeviceType", "DeviceInfo", *[f"id_{i}" for i in (12, 15, 16, 28, 29, 30, 31, 33, 34, 35, 36, 37, 38)]]
NEVER = {"TransactionID": "row identifier", "TransactionDT": "orders rows; its value would not carry over to later ones", "isFraud": "label", "split": "split marker", "card_key": "identity key", "uid": "identity key", "D1n": "part of an identity key"}
ENCODED = ["ProductCD", "addr1", "P_emaildomain", "R_emaildomain"]
META = ["TransactionID", "TransactionDT", "TransactionAmt", "isFraud", "split", "ProductCD"]
VELOCITY_KEYS = ["card1", "uid"]


@dataclass
class Options:
    missing_limit: float = 0.95
    category_floor: int = 20
    corr_limit: float = 0.90
    vendor_keep: int = 35
    sample_rows: int = 150_000
    smoothing: float = 50.0
    folds: int = 5
    most_features: int = 150
    most_categories: int = 100_000  # a vocabulary is held by the manifest; more are an error
    seed: int = 20240917
    windows: dict[str, int] = field(default_factory=lambda: dict(windows.WINDOWS))
    without: tuple[str, ...] = ()  # families left out, for ablation


@dataclass
class Manifest:
    families: dict[str, str] = field(default_factory=dict)  # features in order
    vocabularies: dict[str, list[str]] = field(default_factory=dict)
    dropped: dict[str, str] = field(default_factory=dict)

    @property
    def features(self) -> list[str]:
        return list(self.families)

    def numeric(self) -> list[str]:
        return [f for f in self.families if f not in self.vocabularies]

    def to_json(self) -> dict:
        return asdict(self) | {"n_features": len(self.families)}


def vocabularies(train: DataFrame, columns: list[str], floor: int, most: int) -> dict[str, list[str]]:
    """Per column, its non-null values seen at least ``floor`` times: one aggregate for all columns."""
    if not columns:
        return {}
    long = train.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot([], columns, "column", "value").where("value is not null")
    rows = long.groupBy("column", "value").agg(F.count("*").alias("n")).where(F.col("n") >= floor).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} categories: raise the floor")
    out: dict[str, list[str]] = {c: [] for c in columns}
    for r in rows:
        out[r["column"]].append(r["value"])
    return {c: sorted(v) for c, v in out.items()}


def in_vocabulary(column: str, values: list[str]):
    """Null stays null; what is not in the vocabulary reads as other."""
    c = F.col(column).cast("string")
    return F.when(c.isNull() | c.isin(values), c).otherwise(encoding.OTHER)


def build_features(df: DataFrame, options: Options | None = None) -> tuple[DataFrame, Manifest]:
    """(meta_ columns and features of every row, manifest) from transactions with split; ``df`` has the schema's columns, not all of them needed."""
    o, m = options or Options(), Manifest()
    have = set(df.columns)
    df = staged(keys.add_keys(df), "keyed")  # read by every fit, with the columns it needs
    train = df.where("split = 'train'")
    vendor = [c for c in df.columns if re.fullmatch(r"V\d+", c)]
    listed = [c for c in [*NUMBERS, *CATEGORIES] if c in have]
    others = [c for c in df.columns if c not in {*listed, *vendor, *NEVER}]
    rate = {r["column"]: r["missing_rate"] for r in missingness(train, [*listed, *others]).collect()}
    m.dropped = {c: f"{rate[c]:.2%} of training rows lack it (limit {o.missing_limit:.0%})" for c in rate if rate[c] > o.missing_limit}
    m.dropped |= {c: "not listed as a feature" for c in others if c not in m.dropped} | {c: why for c, why in NEVER.items() if c in df.columns}
    numbers = [c for c in NUMBERS if c in have and c not in m.dropped]
    m.vocabularies = vocabularies(train, [c for c in CATEGORIES if c in have and c not in m.dropped], o.category_floor, o.most_categories)
    kept, why = selection.select_columns(train, vendor, "isFraud", o.corr_limit, o.vendor_keep, o.sample_rows, o.missing_limit, o.seed, "TransactionID") if vendor else ([], {})
    m.dropped |= why

    # Windows, keys of equal partitioning one after another.
    velocity = {}
    if "velocity" not in o.without:
        for key in VELOCITY_KEYS:
            before = set(df.columns)
            df = windows.velocity(df, key, "TransactionDT", "TransactionAmt", o.windows, f"vel_{key}_")
            velocity |= {c: "velocity" for c in df.columns if c not in before}
        tenure, prior = F.col("vel_uid_tenure_days"), F.col("vel_uid_prior_cnt")
    else:
        history = windows.velocity(df, "uid", "TransactionDT", "TransactionAmt", {"24h": 86_400}, "__")
        df = history.select(*df.columns, F.col("__tenure_days").alias("__tenure"), F.col("__prior_cnt").alias("__prior"))
        tenure, prior = F.col("__tenure"), F.col("__prior")
    df = df.withColumn("device_fp", keys.device_fingerprint()) if {"DeviceInfo", "id_30", "id_31", "id_33"} <= have else df
    specs = [s for s in windows.LINKAGE if {s[1], s[2]} <= set(df.columns)] if "linkage" not in o.without else []
    df = windows.linkage_features(df, specs, "TransactionDT", "TransactionID")
    df = staged(df, "windowed")
    encoded = [c for c in ENCODED if c in have] if "entity_risk" not in o.without else []
    if encoded:
        whole = keys.whole_columns(train, encoded)
        df = encoding.target_encode(df, {c: encoding.category(c, whole[c]) for c in encoded}, "isFraud", o.folds, o.smoothing, "TransactionDT", "TransactionID")

    raw = {c: F.col(c).cast("float") for c in numbers} | {c: in_vocabulary(c, v) for c, v in m.vocabularies.items()}
    raw |= {"amt_cents": keys.amount_fraction("TransactionAmt"), "hour_proxy": keys.hour_of_day("TransactionDT").cast("float")}
    every = dict.fromkeys(raw, "raw") | dict.fromkeys(kept, "vesta") | velocity | {f"te_{c}": "entity_risk" for c in encoded} | {n: "linkage" for n, *_ in specs}
    m.families = {c: f for c, f in every.items() if f not in o.without}
    m.vocabularies = {c: v for c, v in m.vocabularies.items() if c in m.families}
    selection.require_cap(m.features, o.most_features)
    cols = [raw.get(c, F.col(c).cast("float")).alias(c) for c in m.features]
    meta = [F.col(c).alias(f"meta_{c}") for c in META if c in df.columns]
    return df.select(*meta, tenure.alias("meta_card_tenure_days"), prior.alias("meta_uid_prior_cnt"), *cols), m


def manifest_tables(spark, m: Manifest) -> tuple[DataFrame, DataFrame]:
    """((feature, family, categorical), (column, reason))."""
    kept = local_rows(spark, [(f, fam, f in m.vocabularies) for f, fam in m.families.items()], "feature string, family string, categorical boolean")
    return kept, local_rows(spark, sorted(m.dropped.items()), "column string, reason string")
