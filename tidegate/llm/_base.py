"""Shared plumbing: session settings, staged tables, packed spans, components."""

from __future__ import annotations

import atexit
import math
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = Path(__file__).resolve().parents[2]


def ready(spark: SparkSession) -> None:
    """Bound Arrow batches and let Python workers import this library."""
    sc = spark.sparkContext
    if sc.master.startswith("local"):
        have = sc.environment.get("PYTHONPATH", "")
        if str(ROOT) not in have.split(os.pathsep):
            sc.environment["PYTHONPATH"] = os.pathsep.join(x for x in (str(ROOT), have) if x)
    elif not getattr(sc, "_tidegate_sent", False):
        sc.addPyFile(_archive())
        sc._tidegate_sent = True
    # Workers give freed memory back instead of keeping pools of their own.
    sc.environment |= {"ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_ARENA_MAX": "2"}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")


def _archive() -> str:
    """The package as a compiled archive, which Spark's file server hands to the executors."""
    folder = tempfile.mkdtemp(prefix="tidegate-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = os.path.join(folder, "tidegate.zip")
    with zipfile.PyZipFile(path, "w", optimize=0) as z:
        z.writepy(str(Path(__file__).resolve().parents[1]))
    return path


def shared_dir(spark: SparkSession) -> str:
    """The folder all nodes share: spark.checkpoint.dir; on a single machine, as in tests, one of our own where it is unset."""
    got = spark.conf.get("spark.checkpoint.dir", None)
    if not got:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all nodes share")
        got = "file://" + tempfile.mkdtemp(prefix="tidegate-")
        atexit.register(shutil.rmtree, got[7:], ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", got)
    return got


def tasks_for(spark: SparkSession, total: int) -> int:
    """Tasks for ``total`` bytes of text: 32 MB each, but enough to keep all cores busy."""
    return parts_for(total, 32 << 20, 4 * spark.sparkContext.defaultParallelism)


def staged(df: DataFrame, name: str, tasks: int | None = None) -> DataFrame:
    """Cut lineage: write ``df`` to the shared folder, in at most ``tasks`` files, and read it back.

    Each file costs a process on the executor (permissions) besides the file
    system's work, so small partitions are written together, one after another.
    """
    spark = df.sparkSession
    df = df if tasks is None else df.coalesce(tasks)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def finished(df: DataFrame, name: str, *used: DataFrame, tasks: int | None = None) -> DataFrame:
    """A result, staged, and the staged tables it was made from deleted."""
    out = staged(df, name, tasks)
    for t in used:
        drop_staged(t)
    return out


def drop_staged(df: DataFrame) -> None:
    """Delete a staged table that no later plan reads."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for f in {x.rpartition("/")[0] for x in df.inputFiles()}:
        p = jvm.org.apache.hadoop.fs.Path(f)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def text_bytes(docs: DataFrame) -> int:
    """About how many bytes the texts of a table have: twice its compressed files, by their listing.  Only task counts go by it, never a result."""
    return 2 * stored_bytes(docs)


def stored_bytes(df: DataFrame) -> int:
    """Bytes of the files a plan reads, from their listing alone; of tables that are not in files, what Spark holds or 64 bytes a row."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return sum(sizes) if max(sizes, default=0) < 1 << 60 else 64 * df.count()


def parts_for(total: int, each: int, least: int = 1) -> int:
    return max(least, math.ceil(total / each))


def carried(df: DataFrame, keep: dict[str, Column]) -> DataFrame:
    """The whole row as one struct beside the columns an operator works on, so that no extra column can clash."""
    return df.select(F.struct("*").alias("__row"), *[c.alias(k) for k, c in keep.items()])


def components(edges: DataFrame, tasks: int | None = None) -> DataFrame:
    """(node, root) for each node of ``edges(a, b)`` but the roots: root is the least node reachable.

    Alternating large-star and small-star contraction; each round is staged in
    the shared folder, only a count and a checksum reach the driver.  Rounds
    grow with the logarithm of the largest component.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = staged(e, "edges", tasks)
    seen = None
    while True:
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.select(F.col("a"), F.col("m").alias("b")).union(small.where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b")))
        nxt = staged(small.distinct(), "edges", tasks)
        mark = nxt.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        drop_staged(e)
        e = nxt
        if mark == seen:
            return e.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root")
        seen = mark


def local_roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (node, least node) of the components of the given links."""
    ids, inv = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = inv[: len(a)], inv[len(a) :]
    root = np.arange(len(ids))
    while True:
        low = np.minimum(root[x], root[y])
        nxt = root.copy()
        np.minimum.at(nxt, x, low)
        np.minimum.at(nxt, y, low)
        np.minimum.at(nxt, root[x], low)
        np.minimum.at(nxt, root[y], low)
        nxt = nxt[nxt]
        if (nxt == root).all():
            return ids, ids[root]
        root = nxt
