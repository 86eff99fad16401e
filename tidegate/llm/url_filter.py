"""Operator 1: URL filters by a sorted digest array.

Rules (action, host, path) are stored as sorted 64-bit xxhash keys beside
their full strings in one file, which Spark hands to each node and every
worker memory-maps.  A URL is probed for each of its host suffixes and path
prefixes of the lengths that rules have, by one vectorised binary search per
batch, and a hit counts only if the stored string is equal.

A rule fits its host and all subdomains if the path starts with the rule's.
Of several, the longest string wins, then the longer host; of equal strings,
block.  URLs without a rule, null ones included, are allowed.  Repeated rows
give repeated results; other columns stay as they are.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegate.llm import _base

ACTIONS = ("allow", "block")
_HEAD = 4  # 64-bit words before the keys: rules, host label counts, path lengths, string bytes


def write_index(rules: list[tuple[str, str, str]], path: str) -> None:
    best: dict[str, tuple[int, int, int]] = {}
    for action, host, start in rules:
        host = host.translate(str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}))
        got = (ACTIONS.index(action), len(host), len(start))
        best[host + start] = max(best.get(host + start, got), got)
    names = sorted(best, key=lambda s: (xxhash.xxh64_intdigest(s), s))
    raw = [s.encode("utf-8", "surrogatepass") for s in names]
    labels = sorted({s[: best[s][1]].count(".") + 1 for s in names})
    lengths = sorted({best[s][2] for s in names})
    with open(path, "wb") as f:
        words = [len(names), len(labels), len(lengths), sum(map(len, raw))]
        f.write(np.array(words + labels + lengths, "<i8").tobytes())
        f.write(np.array([xxhash.xxh64_intdigest(s) for s in names], "<u8").tobytes())
        f.write(np.cumsum([0, *map(len, raw)]).astype("<i8").tobytes())
        f.write(np.array([best[s][1] for s in names], "<i8").tobytes())
        f.write(np.array([best[s][0] for s in names], "<i8").tobytes())
        f.write(b"".join(raw))


class Index:
    """A memory-mapped rule file."""

    def __init__(self, path: str):
        head = np.memmap(path, "<i8", "r", 0, _HEAD)
        n, k, m, _ = (int(x) for x in head)
        at = 8 * _HEAD
        self.labels = np.fromfile(path, "<i8", k, offset=at).tolist()
        self.lengths = np.fromfile(path, "<i8", m, offset=at + 8 * k).tolist()
        at += 8 * (k + m)

        def part(kind, count):
            nonlocal at
            got = np.memmap(path, kind, "r", at, count) if count else np.zeros(0, kind)
            at += got.nbytes
            return got

        self.keys, self.offs, self.hosts, self.actions = part("<u8", n), part("<i8", n + 1), part("<i8", n), part("<i8", n)
        self.strings = part(np.uint8, int(self.offs[-1]) if n else 0)

    def find(self, hosts: list[str], paths: list[str]) -> list[tuple[str, str] | None]:
        """(rule, action) of each URL."""
        own, text = [], []
        for i, (host, path) in enumerate(zip(hosts, paths, strict=True)):
            ends = self._suffixes(host)
            for n in self.lengths:
                if n <= len(path):
                    own += [i] * len(ends)
                    text += [e + path[:n] for e in ends]
        out: list[tuple[str, str] | None] = [None] * len(hosts)
        if not text or not len(self.keys):
            return out
        key = np.fromiter((xxhash.xxh64_intdigest(s.encode("utf-8", "surrogatepass")) for s in text), np.uint64, len(text))
        at = np.searchsorted(self.keys, key)
        live = np.arange(len(key))
        best: list[tuple[int, int] | None] = [None] * len(hosts)
        while len(live):  # once more for each further rule with an equal key
            live = live[at[live] < len(self.keys)]
            live = live[self.keys[at[live]] == key[live]]
            for c in live.tolist():
                r = int(at[c])
                if self.strings[self.offs[r] : self.offs[r + 1]].tobytes() == text[c].encode("utf-8", "surrogatepass"):
                    rank, i = (len(text[c]), int(self.hosts[r])), own[c]
                    if best[i] is None or rank > best[i]:
                        best[i], out[i] = rank, (text[c], ACTIONS[int(self.actions[r])])
            at[live] += 1
        return out

    def _suffixes(self, host: str) -> list[str]:
        if not host:
            return []
        cut, out, end = [], [], len(host)
        while len(cut) < self.labels[-1] if self.labels else False:
            end = host.rfind(".", 0, end)
            cut.append(end + 1)
            if end < 0:
                break
        for n in self.labels:
            if n <= len(cut):
                out.append(host[cut[n - 1] :])
        return out


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to /, ?, # or the end, A-Z lower-cased; path: then up to ? or #."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substr(__url, instr(__url, '://') + 3)"))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def _probe(name: str):
    def run(batches):
        index = Index(SparkFiles.get(name))
        for t in batches:
            got = index.find(t.column(1).to_pylist(), t.column(2).to_pylist())
            rule = pa.array([g and g[0] for g in got], pa.string())
            verdict = pa.array([g and g[1] for g in got], pa.string())
            yield pa.RecordBatch.from_arrays([*t.columns, rule, verdict], names=["__row", "host", "path", "rule", "verdict"])

    return run


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]], default: str = "allow") -> DataFrame:
    """Every row as struct ``__row`` beside host, path, rule (null: none fits) and verdict."""
    spark = pages.sparkSession
    _base.ready(spark)
    name = f"urls-{uuid.uuid4().hex}.bin"
    folder = tempfile.mkdtemp(prefix="tidegate-")  # the driver's: its file server sends the index to each node that asks
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    write_index(rules, os.path.join(folder, name))
    spark.sparkContext.addFile(os.path.join(folder, name))
    tasks = _base.tasks_for(spark, _base.text_bytes(pages))
    rows = _base.carried(pages, {"__url": F.col("url")}).coalesce(tasks)
    host, path = host_and_path(F.col("__url"))
    got = rows.select("__row", host.alias("host"), path.alias("path")).mapInArrow(_probe(name), f"__row {pages.schema.simpleString()}, host string, path string, rule string, verdict string")
    return got.withColumn("verdict", F.coalesce("verdict", F.lit(default)))
