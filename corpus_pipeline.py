"""A corpus pipeline over the training-data operators: language, near duplicates, repeated passages, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegate.llm import _base, jaccard_join, language_id, packing, queries, suffix_dedup


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language model rejects go: those without a letter, and scores below its calibrated bound."""
    got = language_id.identify(docs, language_id.fit(docs))
    return got.where(F.col("accepted") & (F.col("lang_pred") != language_id.UNKNOWN)).select("__row.*")


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents joined by 5-word Jaccard similarity of 0.8 or more, the one of smallest doc_id stays.

    Rows with the same doc_id and text are one document: one stays, the least by its other columns.  Rows with null
    doc_id link with nothing; of those with the same text one stays, whether or not a document with an id has that text.
    """
    gone = jaccard_join.jaccard_join(docs).where("doc_id <> class_id").select("doc_id")
    again = _base.staged(docs.groupBy("doc_id").count().where("count > 1 and doc_id is not null").select("doc_id"), "again")
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    fold = docs.join(again, "doc_id", "left_semi").select(*docs.columns).union(docs.where("doc_id is null"))
    fold = fold.groupBy("doc_id", "text").agg(F.min(F.struct(*rest)).alias("r")).select(*[F.col(f"r.`{c}`") if c in rest else F.col(c) for c in docs.columns])
    once = docs.where("doc_id is not null").join(again, "doc_id", "left_anti").select(*docs.columns)
    return once.union(fold).join(_base.staged(gone, "gone"), "doc_id", "left_anti").select(*docs.columns)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """100-byte strings that occur earlier are cut; documents with nothing left go."""
    got = suffix_dedup.suffix_dedup(docs).where("n_removed = 0 or kept_text <> ''")
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("__row.text"))
    chars = F.when(F.col("n_removed") > 0, F.length("kept_text").cast("long")).otherwise(F.col("__row.n_chars"))
    new = {"text": text, "n_chars": chars}
    return got.select(*[new.get(c, F.col(f"__row.`{c}`")).alias(c) for c in docs.columns])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 tokens by bounded-space best-fit."""
    return packing.pack(docs, queries.BYTE_BPE)


STAGES = [("language_id", known_language), ("jaccard_join", one_of_each_group), ("suffix_dedup", without_repeats), ("packing", packed)]
#: SQL can express neither the language model nor the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written; a stage's table is deleted once the next one's is there."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        done = _base.staged(stage(spark, docs, sf_dir), name)
        if k:
            _base.drop_staged(docs)
        docs = done
    return docs
