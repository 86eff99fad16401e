"""Target encoding and category vocabularies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegate.functions.keys import token
from tidegate.operators.split import out_of_fold_blocks
from tidegate.sources.tables import staged

MISSING, OTHER = "__nan__", "__other__"


def category(c: str, whole: bool = False) -> Column:
    """Text of a category; missing is one of its own."""
    return token(c, MISSING, whole)


def fit_mapping(df: DataFrame, x: Column, y: str = "y", smoothing: float = 50.0) -> tuple[DataFrame, DataFrame]:
    """((category, enc), one row (prior)): rates pulled to the mean by ``smoothing`` rows.  Null or no labels: error."""
    prior = df.agg(F.when((F.count("*") > 0) & (F.count(y) == F.count("*")), F.avg(y)).otherwise(F.raise_error(F.lit("no labels or null labels")).cast("double")).alias("prior"))
    stats = df.groupBy(x.alias("category")).agg(F.sum(y).alias("s"), F.count("*").alias("n"))
    enc = (F.col("s") + F.lit(smoothing) * F.col("prior")) / (F.col("n") + F.lit(smoothing))
    return stats.join(F.broadcast(prior)).select("category", enc.alias("enc")), prior


def apply_mapping(df: DataFrame, x: Column, mapping: DataFrame, prior: DataFrame, name: str) -> DataFrame:
    """Left join on the category; unseen ones get the prior.  Spark chooses the join by the mapping's size."""
    out = df.withColumn("__x", x).join(mapping.select(F.col("category").alias("__x"), F.col("enc").alias("__e")), "__x", "left")
    return out.join(F.broadcast(prior.select(F.col("prior").alias("__p")))).withColumn(name, F.coalesce("__e", "__p")).drop("__x", "__e", "__p")


def out_of_fold(df: DataFrame, x: Column, y: str = "y", smoothing: float = 50.0, fold: str = "fold", name: str = "te") -> DataFrame:
    """Each row encoded from the other folds alone: totals less the own fold's, per category and overall."""
    df = df.withColumn("__x", x)
    own = df.groupBy("__x", fold).agg(F.sum(y).alias("__sf"), F.count("*").alias("__nf"))
    cat = own.groupBy("__x").agg(F.sum("__sf").alias("__s"), F.sum("__nf").alias("__n"))
    per = df.groupBy(fold).agg(F.sum(y).alias("__s"), F.count("*").alias("__n"))
    both = per.agg(F.sum("__s").alias("__all_s"), F.sum("__n").alias("__all_n"))
    prior = per.join(F.broadcast(both)).select(fold, F.try_divide(F.col("__all_s") - F.col("__s"), F.col("__all_n") - F.col("__n")).alias("__p"))
    n, s = F.col("__n") - F.col("__nf"), F.col("__s") - F.col("__sf")
    enc = own.join(cat, "__x").join(F.broadcast(prior), fold).select("__x", fold, F.when(n == 0, F.col("__p")).otherwise((s + F.lit(smoothing) * F.col("__p")) / (n + F.lit(smoothing))).alias(name))
    return df.join(enc, ["__x", fold]).drop("__x")


def target_encode(df: DataFrame, columns: dict[str, Column], y: str = "y", folds: int = 5, smoothing: float = 50.0, dt: str = "dt", row_id: str = "id") -> DataFrame:
    """te_<name> for each column of a split frame: training rows out of fold, others by all training rows.

    One pass over (column, category, fold) gives the sums of all columns; what
    a category is worth to each fold, and to the rest, is a table written
    once, which the rows then meet column by column.
    """
    names = list(columns)
    fold = out_of_fold_blocks(df.where("split = 'train'").select(row_id, dt), folds, dt, row_id, "__fold").select(row_id, "__fold")
    df = df.join(fold, row_id, "left").withColumns({f"__x{i}": x for i, x in enumerate(columns.values())})
    df = df.withColumn("__fold", F.coalesce("__fold", F.lit(-1)))
    labels = F.when(F.col(y).isNotNull(), F.col(y).cast("double")).otherwise(F.raise_error(F.lit("null labels")).cast("double"))
    long = df.where("__fold >= 0").select("__fold", labels.alias("__y"), *[F.col(f"__x{i}").cast("string").alias(f"__x{i}") for i in range(len(names))])
    own = long.unpivot(["__fold", "__y"], [f"__x{i}" for i in range(len(names))], "__c", "__v").groupBy("__c", "__v", "__fold").agg(F.sum("__y").alias("s"), F.count("*").alias("n"))
    own = staged(own, "encoding")
    whole = own.groupBy("__c", "__v").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    per = own.where("__c = '__x0'").groupBy("__fold").agg(F.sum("s").alias("sf"), F.sum("n").alias("nf"))
    total = per.agg(F.sum("sf").alias("sa"), F.sum("nf").alias("na"))
    m = F.lit(float(smoothing))
    # As many rows as there are folds.
    prior = per.join(F.broadcast(total)).select("__fold", F.try_divide(F.col("sa") - F.col("sf"), F.col("na") - F.col("nf")).alias("p"))
    mine = own.join(whole.withColumnsRenamed({"s": "sc", "n": "nc"}), ["__c", "__v"]).join(F.broadcast(prior), "__fold")
    n, s = F.col("nc") - F.col("n"), F.col("sc") - F.col("s")
    mine = mine.select("__c", "__v", "__fold", F.when(n == 0, F.col("p")).otherwise((s + m * F.col("p")) / (n + m)).alias("e"))
    all_ = total.select((F.col("sa") / F.col("na")).alias("p"))
    rest = whole.join(F.broadcast(all_)).select("__c", "__v", F.lit(-1).alias("__fold"), ((F.col("s") + m * F.col("p")) / (F.col("n") + m)).alias("e"))
    worth = staged(mine.union(rest), "worth")
    out = df.join(F.broadcast(all_.toDF("__p")), how="left")
    for i, name in enumerate(names):
        part = worth.where(F.col("__c") == f"__x{i}").select(F.col("__v").alias(f"__x{i}"), "__fold", F.col("e").alias("__e"))
        out = out.join(part, [f"__x{i}", "__fold"], "left").withColumn(f"te_{name}", F.coalesce("__e", "__p")).drop("__e")
    return out.drop("__fold", "__p", *[f"__x{i}" for i in range(len(names))])


def fit_vocabulary(df: DataFrame, column: str, floor: int = 20) -> DataFrame:
    """(category, n) of non-null values seen at least ``floor`` times."""
    return df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("category")).agg(F.count("*").alias("n")).where(F.col("n") >= floor)


def apply_vocabulary(df: DataFrame, column: str, vocabulary: DataFrame, name: str) -> DataFrame:
    """Null stays null; a value outside the vocabulary reads as other."""
    v = vocabulary.select(F.col("category").alias(column), F.lit(True).alias("__in"))
    value = F.when(F.col(column).isNull(), None).when(F.col("__in"), F.col(column)).otherwise(OTHER)
    return df.join(v, column, "left").withColumn(name, value).drop("__in")
