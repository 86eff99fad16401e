"""Backward-looking features per entity: velocity windows and linkage counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WINDOWS = {"1h": 3600, "24h": 86_400, "7d": 604_800}
# Fixed values: (feature, key, what is counted for it).
LINKAGE = [
    ("lnk_cards_per_deviceinfo", "DeviceInfo", "card_key"),
    ("lnk_cards_per_id30", "id_30", "card_key"),
    ("lnk_cards_per_id31", "id_31", "card_key"),
    ("lnk_cards_per_device_fp", "device_fp", "card_key"),
    ("lnk_pemails_per_card", "card_key", "P_emaildomain"),
    ("lnk_remails_per_card", "card_key", "R_emaildomain"),
    ("lnk_addr1_per_card", "card_key", "addr1"),
]


def _features(key: str, dt: str, amount: str, windows: dict[str, int], prefix: str, count, total, prev, prior, first) -> dict[str, Column]:
    out: dict[str, Column] = {}
    for name in windows:
        out[f"{prefix}cnt_{name}"], out[f"{prefix}amt_{name}"] = count(name), F.coalesce(total(name), F.lit(0.0))
    longest = max(windows, key=windows.get)
    mean = F.try_divide(out[f"{prefix}amt_{longest}"], out[f"{prefix}cnt_{longest}"])
    out[f"{prefix}secs_since_prev"] = F.col(dt) - prev
    out[f"{prefix}prior_cnt"] = prior
    out[f"{prefix}tenure_days"] = F.coalesce((F.col(dt) - first) / 86_400, F.lit(0.0))
    out[f"{prefix}amt_vs_mean_{longest}"] = F.try_divide(F.col(amount), mean)
    return {k: F.when(F.col(key).isNotNull(), v) for k, v in out.items()}


def velocity(df: DataFrame, key: str, dt: str = "dt", amount: str = "amount", windows: dict[str, int] = WINDOWS, prefix: str = "vel_") -> DataFrame:
    """Counts and sums over rows of the key in [dt - w, dt), the time since the last earlier row, earlier rows, and age.

    A row sees neither itself nor rows of its own second.  Null keys get nulls.
    One shuffle by key serves all features.
    """
    by = Window.partitionBy(key).orderBy(dt)
    past = by.rangeBetween(Window.unboundedPreceding, -1)
    frame = {n: by.rangeBetween(-w, -1) for n, w in windows.items()}
    return df.withColumns(_features(key, dt, amount, windows, prefix, lambda n: F.count("*").over(frame[n]), lambda n: F.sum(amount).over(frame[n]), F.max(dt).over(past), F.count("*").over(past), F.min(dt).over(past)))


def velocity_split(df: DataFrame, key: str, dt: str = "dt", amount: str = "amount", windows: dict[str, int] = WINDOWS, prefix: str = "vel_") -> DataFrame:
    """As ``velocity``, for keys with too many rows for one task.

    Time is cut into cells of the longest window.  Each row also goes to the
    next cell as context, so every window of a row is complete inside its own
    (key, cell); what lies further back comes from running totals of cells.
    """
    span = max(windows.values())
    df = df.withColumn("__cell", F.floor(F.col(dt) / span))
    cells = df.where(F.col(key).isNotNull()).groupBy(key, "__cell").agg(F.count("*").alias("__c"), F.min(dt).alias("__a"), F.max(dt).alias("__z"))
    before = Window.partitionBy(key).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select(key, "__cell", F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__before"), F.min("__a").over(before).alias("__first"), F.max("__z").over(before).alias("__last"))
    row = F.struct(*[F.col(c) for c in df.columns])
    both = df.select(row.alias("r"), F.explode(F.array(F.lit(0), F.lit(1))).alias("__late"))
    both = both.where((F.col("__late") == 0) | F.col(f"r.{key}").isNotNull())
    flat = both.select(F.col("r.*"), "__late").withColumn("__at", F.col("__cell") + F.col("__late"))
    # A null key has no history: its rows are dealt by time alone.
    by = Window.partitionBy(key, "__at").orderBy(dt)
    past = by.rangeBetween(Window.unboundedPreceding, -1)
    own = F.when(F.col("__late") == 0, 1)
    frame = {n: by.rangeBetween(-w, -1) for n, w in windows.items()}
    flat = flat.withColumns({"__n": F.count(own).over(past), "__p": F.max(F.when(own == 1, F.col(dt))).over(past), "__f": F.min(F.when(own == 1, F.col(dt))).over(past)} | {f"__c{n}": F.count("*").over(w) for n, w in frame.items()} | {f"__s{n}": F.sum(amount).over(w) for n, w in frame.items()})
    flat = flat.where("__late = 0").join(cells, [key, "__cell"], "left")
    feats = _features(key, dt, amount, windows, prefix, lambda n: F.col(f"__c{n}"), lambda n: F.col(f"__s{n}"), F.coalesce("__p", "__last"), F.coalesce("__before", F.lit(0)) + F.col("__n"), F.coalesce("__first", "__f"))
    return flat.withColumns(feats).select(*[c for c in df.columns if c != "__cell"], *feats)


def distinct_before(df: DataFrame, key: str, other: str, dt: str = "dt", row_id: str = "id", name: str = "linked") -> DataFrame:
    """Different non-null ``other`` values seen with the key strictly before, plus one if this row's is new then.

    Null key: null.  Null ``other``: the earlier count alone.
    """
    pair = Window.partitionBy(key, other)
    df = df.withColumns({"__ft": F.min(dt).over(pair), "__new": F.when(F.col(other).isNotNull() & (F.row_number().over(pair.orderBy(dt, row_id)) == 1), 1).otherwise(0)})
    past = Window.partitionBy(key).orderBy(dt).rangeBetween(Window.unboundedPreceding, -1)
    count = F.coalesce(F.sum("__new").over(past), F.lit(0)) + F.when(F.col(other).isNotNull() & (F.col("__ft") >= F.col(dt)), 1).otherwise(0)
    return df.withColumn(name, F.when(F.col(key).isNotNull(), count)).drop("__ft", "__new")


def distinct_before_split(df: DataFrame, key: str, other: str, dt: str = "dt", row_id: str = "id", name: str = "linked", seconds: int = 604_800) -> DataFrame:
    """As ``distinct_before``, for keys with too many rows for one task (a device that half of all cards use).

    First times of (key, other) pairs are one aggregate.  They are counted by
    time cell, running totals of cells give what lies in earlier cells, and a
    window adds the rest inside each (key, cell).
    """
    cell = F.floor(F.col(dt) / seconds)
    first = df.where(F.col(key).isNotNull() & F.col(other).isNotNull()).groupBy(key, other).agg(F.min(dt).alias("__ft"))
    new = first.groupBy(key, F.floor(F.col("__ft") / seconds).alias("__cell"), F.col("__ft").alias("__at")).agg(F.count("*").alias("__n"))
    totals = new.groupBy(key, "__cell").agg(F.sum("__n").alias("__c"))
    have = df.where(F.col(key).isNotNull()).select(key, cell.alias("__cell")).distinct()
    before = Window.partitionBy(key).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    base = have.join(totals, [key, "__cell"], "left").select(key, "__cell", F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__base"))
    # New pairs and rows of a (key, cell) in one order of time; a row sees pairs of strictly earlier seconds.
    row = F.struct(*[F.col(c) for c in df.columns])
    rows = df.select(row.alias("__r"), F.col(key).alias("__key"), cell.alias("__cell"), F.col(dt).alias("__at"), F.lit(0).cast("long").alias("__n"))
    marks = new.select(F.lit(None).cast(dict(rows.dtypes)["__r"]).alias("__r"), F.col(key).alias("__key"), "__cell", "__at", "__n")
    past = Window.partitionBy("__key", "__cell").orderBy("__at").rangeBetween(Window.unboundedPreceding, -1)
    seen = rows.union(marks).withColumn("__seen", F.coalesce(F.sum("__n").over(past), F.lit(0))).where("__r is not null").select("__r.*", "__cell", "__seen")
    out = seen.join(base, [key, "__cell"], "left").join(first, [key, other], "left")
    own = F.when(F.col("__ft") >= F.col(dt), 1).otherwise(0)
    return out.select(*df.columns, F.when(F.col(key).isNotNull(), F.col("__base") + F.col("__seen") + own).alias(name))


def linkage_features(df: DataFrame, specs: list[tuple[str, str, str]] = LINKAGE, dt: str = "dt", row_id: str = "id") -> DataFrame:
    """One ``distinct_before`` column for each (name, key, other).

    Specs of one key follow each other, so that their windows share its
    partitioning.
    """
    for name, key, other in sorted(specs, key=lambda s: s[1]):
        df = distinct_before(df, key, other, dt, row_id, name)
    return df
