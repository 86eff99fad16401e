"""Typed scans, sinks, integrity checks and contracts."""

from __future__ import annotations

import atexit
import csv
import json
import math
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The column typing of the transaction and identity files.
INTEGER_COLUMNS = {"TransactionID": T.LongType(), "TransactionDT": T.LongType(), "isFraud": T.ByteType(), "card1": T.IntegerType()}
DOUBLE_COLUMNS = {"TransactionAmt"}
STRING_NAMES = re.compile(r"ProductCD|card4|card6|P_emaildomain|R_emaildomain|M\d+|DeviceType|DeviceInfo|id_(12|15|16|23|27|28|29|30|31|33|34|35|36|37|38)")


def schema_for(header: list[str]) -> T.StructType:
    """The schema that the column names imply, in the order of the header; '-' in names reads as '_'."""
    out = T.StructType()
    for name in (h.replace("-", "_") for h in header):
        if name in INTEGER_COLUMNS:
            out.add(name, INTEGER_COLUMNS[name])
        elif name in DOUBLE_COLUMNS:
            out.add(name, T.DoubleType())
        elif STRING_NAMES.fullmatch(name):
            out.add(name, T.StringType())
        else:
            out.add(name, T.FloatType())
    return out


def scan_csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A CSV file with a header, typed by name.  An empty string is a value, not missing; empty numbers are null."""
    if schema is None:
        schema = schema_for(next(csv.reader([spark.read.text(path).first()[0]])))
    df = spark.read.schema(schema).option("header", True).option("enforceSchema", True).csv(path)
    return df.withColumns({f.name: F.coalesce(f.name, F.lit("")) for f in schema if isinstance(f.dataType, T.StringType)})


def write_csv(df: DataFrame, path: str) -> None:
    """A small result table as one CSV part."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def verify_files(spark: SparkSession, folder: str, expected: dict[str, int]) -> DataFrame:
    """(name, expected_bytes, bytes, sha256, status) of each expected file; status ok, missing or size."""
    want = spark.createDataFrame(sorted(expected.items()), "name string, expected_bytes long")
    have = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", F.col("length").alias("bytes"))
    have = have.mapInPandas(_digests, "name string, bytes long, sha256 string")
    status = F.when(F.col("bytes").isNull(), "missing").when(F.col("bytes") != F.col("expected_bytes"), "size").otherwise("ok")
    return want.join(have, "name", "left").withColumn("status", status)


def _digests(parts):
    """SHA-256 of files of any size, read in pieces through Arrow's file systems; null where a path can't be opened there."""
    import hashlib

    from pyarrow import fs

    for part in parts:
        out = []
        for path in part["path"]:
            try:
                system, at = fs.FileSystem.from_uri(path if "://" in path else path.replace("file:/", "file:///"))
                digest = hashlib.sha256()
                with system.open_input_stream(at) as f:
                    while piece := f.read(1 << 24):
                        digest.update(piece)
                out.append(digest.hexdigest())
            except (OSError, ValueError):
                out.append(None)
        yield part.assign(name=part["path"].str.rsplit("/", n=1).str[-1], sha256=out)[["name", "bytes", "sha256"]]


def require_files(spark: SparkSession, folder: str, expected: dict[str, int]) -> None:
    bad = verify_files(spark, folder, expected).where("status <> 'ok'").orderBy("name").collect()
    if bad:
        raise ValueError("; ".join(f"{r.name}: {r.status} ({r.bytes} of {r.expected_bytes} bytes)" for r in bad))


def require_rows(df: DataFrame, expected: int) -> DataFrame:
    """``df`` itself if it has the expected number of rows."""
    n = df.count()
    if n != expected:
        raise ValueError(f"{n} rows where {expected} were expected")
    return df


def cached_table(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The Parquet table at ``path``, built first if it is not there."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        build().write.parquet(path)
    return spark.read.parquet(path)


def enrich(left: DataFrame, right: DataFrame, key: str, check: bool = True) -> DataFrame:
    """Left join on a key that must be unique on both sides, so the row count stays."""
    if check:
        for side, df in (("left", left), ("right", right)):
            if df.groupBy(key).count().where("count > 1").limit(1).count():
                raise ValueError(f"{key} repeats on the {side} side")
    return left.join(right, key, "left")


def clean_json(value):
    """Numbers that JSON can't hold become null; keys become text."""
    if isinstance(value, dict):
        return {str(k): clean_json(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [clean_json(v) for v in value]
    if isinstance(value, float) and not math.isfinite(value):
        return None
    return value


def save_json(value, spark: SparkSession, path: str) -> None:
    """Nested results as one JSON text with sorted keys, wherever Spark writes."""
    text = json.dumps(clean_json(value), indent=2, sort_keys=True)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").option("lineSep", "\0").text(path)


def load_json(spark: SparkSession, path: str):
    return json.loads(spark.read.text(path, wholetext=True).first()[0].rstrip("\0"))


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the folder of spark.checkpoint.dir and read back, for plans that use it several times.

    Where the setting is missing (tests, one machine), a temporary folder of this process is set.
    """
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all nodes share")
        own = tempfile.mkdtemp(prefix="tidegate-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        folder = f"file://{own}"
        spark.conf.set("spark.checkpoint.dir", folder)
    path = f"{folder}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
