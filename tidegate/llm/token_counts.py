"""Operator 10: token counts through a digest cache.

A text's key is a digest of its normalised content and one of the tokenizer
file.  Keys join the counts stored by earlier runs; each distinct miss is
encoded once and appended to the store; all rows then take their counts by
key.  The store is Parquet in a folder that all nodes share, each run's
additions a write of their own, so a lost executor repeats tasks and no more.

Normalisation only folds what the tokenizer ignores by default: runs of
spaces and line breaks.  Null text counts as empty (no tokens).
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegate.llm import _base, _bytes
from tidegate.llm.packing import LONGEST


def tokenizer_version(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()[:32]


class WordCounter:
    """Token counts by a file of the tokenizers library whose pre-tokenizer drops white space, summed over words with a bounded cache."""

    def __init__(self, path: str, limit: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library, self.limit, self.known = Tokenizer.from_file(path), limit, {}

    def _words(self, words: list[str]) -> list[int]:
        """Counts of single words, many in one call with a word of one token between that no counted word's characters can make."""
        between = self.library.encode("~", add_special_tokens=False).ids
        out = np.zeros(len(words), np.int64)
        plain = [i for i, w in enumerate(words) if "~" not in w and len(between) == 1]
        for a in range(0, len(plain), 256):
            own = plain[a : a + 256]
            ids = np.array(self.library.encode(" ~ ".join([words[i] for i in own]), add_special_tokens=False).ids)
            cut = np.concatenate(([-1], np.flatnonzero(ids == between[0]), [len(ids)]))
            out[own] = np.diff(cut) - 1
        rest = [i for i, w in enumerate(words) if "~" in w or len(between) != 1]
        out[rest] = list(map(len, self.library.encode_batch([words[i] for i in rest], add_special_tokens=False)))
        return out.tolist()

    def count(self, texts: list[str]) -> list[int]:
        if len(self.known) > self.limit:
            self.known = dict(islice(self.known.items(), self.limit // 2))  # frequent words came first
        known = self.known
        words = [t.replace("\n", " ").split(" ") for t in texts]
        new = list(set().union(*words) - known.keys())
        known |= dict(zip(new, self._words(new), strict=True))
        out = [sum(map(known.__getitem__, w)) for w in words]
        for w in new:  # texts without spaces would otherwise fill the cache with themselves
            if len(w) > LONGEST:
                del known[w]
        return out


class TextCounter:
    """Counts of whole texts, for any file: tokenizers for .json, sentencepiece for .model."""

    def __init__(self, path: str):
        if path.endswith(".model"):
            import sentencepiece

            sp = sentencepiece.SentencePieceProcessor(model_file=path)
            self.count = lambda texts: list(map(len, sp.encode(texts, num_threads=1)))
        else:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            tok = Tokenizer.from_file(path)
            self.count = lambda texts: list(map(len, tok.encode_batch(texts, add_special_tokens=False)))


@functools.lru_cache(maxsize=8)
def drops_white_space(path: str) -> bool:
    """Whether a file of the tokenizers library makes of any text the tokens of its words, one after another, whatever white space is between."""
    if path.endswith(".model"):
        return False
    with open(path, encoding="utf-8") as f:
        before = json.load(f).get("pre_tokenizer")
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    ids = lambda t: tok.encode(t, add_special_tokens=False).ids
    probes = ["a b", "  Ab,  12\nc's ", "\n\n", "x \n y", "don't 3.5 \u00e9t\u00e9 \u6f22 z"]
    return before is not None and all(ids(p) == [i for w in p.replace("\n", " ").split(" ") for i in ids(w)] for p in probes)


@functools.lru_cache(maxsize=1)
def _counter(path: str, by_word: bool):
    """One per worker process, so that tasks after the first find its cache warm."""
    return (WordCounter if by_word else TextCounter)(path)


def _count(path: str, by_word: bool):
    def run(batches):
        counter = _counter(path, by_word)
        for t in _bytes.slices(batches, 1 << 20):
            n = counter.count([x or "" for x in t.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([t.column(0), pa.array(np.array(n, np.int64))], names=["digest", "n_tokens"])

    return run


def token_counts(docs: DataFrame, tokenizer: str, store: str, limit: int = 2048, by_word: bool | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row; new counts are appended to the Parquet folder ``store``.

    ``by_word``: the file's pre-tokenizer drops white space and never joins
    across it, so spaces fold in the key and words count on their own.  It is
    found out from the file; to ask for it where that does not hold is an error.
    """
    spark = docs.sparkSession
    apart = drops_white_space(tokenizer)
    if by_word and not apart:
        raise ValueError("this tokenizer's counts are not those of its words")
    by_word = apart if by_word is None else by_word
    _base.ready(spark)
    version = tokenizer_version(tokenizer)
    text = F.coalesce("text", F.lit(""))
    folded = F.regexp_replace(text, "[ \n]+", " ") if by_word else text
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), F.unhex(F.sha2(folded, 256)).alias("digest"))
    keyed = keyed.withColumn("id", F.coalesce("doc_id", F.lit(0)))
    tasks = _base.tasks_for(spark, _base.text_bytes(docs))
    keys = _base.staged(keyed.select("doc_id", "digest", F.octet_length(text).cast("long").alias("n_bytes")), "digests", tasks)
    shape = "digest binary, version string, n_tokens long"
    spark.createDataFrame([], shape).write.mode("append").parquet(store)
    stored = spark.read.schema(shape).parquet(store).where(F.col("version") == version).select("digest", "n_tokens")
    distinct = keys.groupBy("digest").agg(F.min(F.coalesce("doc_id", F.lit(0))).alias("id"))
    misses = distinct.join(stored, "digest", "left_anti")
    # Only the first document of a missed key brings its text.  Rows meet by key and id, so that a text of many documents is
    # not in one task.  (An inner join: a semi-join would be pushed below the repartitioning, and texts shuffled twice.)
    asked = keyed.repartition(tasks, "digest", "id").join(misses.repartition(tasks, "digest", "id"), ["digest", "id"]).select("digest", "text")
    new = asked.mapInArrow(_count(tokenizer, by_word), "digest binary, n_tokens long")
    new.select("digest", F.lit(version).alias("version"), "n_tokens").write.mode("append").parquet(store)
    known = spark.read.schema(shape).parquet(store).where(F.col("version") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    out = keys.join(known, "digest", "left").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
    return _base.finished(out.coalesce(tasks), "counts", keys)
