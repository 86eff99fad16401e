"""Operator 9: exact top-k by inner product with vector-approximation files.

Components become integers floor(scale * x).  Plan:

 1. Vectors are written once, in blocks of two parts: the approximation file
    (a byte for each component, 256 cells between a block's least and greatest
    value) and the exact vectors.  Columns are read singly, so what follows
    reads one or the other.
 2. Only the cells travel to the queries.  Cells bound every score from both
    sides; a group of query blocks and vector blocks keeps the candidates that
    k others don't certainly beat.
 3. Exact vectors are read in the order of the bounds: first those of each
    query's k best bounds, then only those whose bound is not below the kth
    score then known.  Candidates go to the blocks that hold their vectors,
    split where one block is wanted by very many.

Vectors that are null, or hold null or non-finite components, take no part,
nor do rows with null vec_id; vectors meet only others of their own length.
Ties go to the smaller id; a query never finds its own id, and repeated rows
of one id count once: an id stands once, with the best score of any of its
rows.  An id with different vectors, as a query too, therefore has the score
of its best pair.  (The registered SQL counts each row; the two differ on such
tables.)  Of equal vectors in a block only the k + 1 smallest ids are kept,
since no other can be among the k best.  Integer components beyond 64 bits
count as the nearest 64-bit integer, and so do scores.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegate.llm import _base

#: Queries and vectors of a block, blocks of each kind in one search, candidates that read a block in one task.
QUERY_BLOCK, VECTOR_BLOCK, TOGETHER, READERS = 4096, 8192, 8, 2048
CELLS = 256
LEAST, MOST = -(2.0**63), 2.0**63


def whole(vec: Column, scale: int) -> Column:
    """floor(scale * x) for every component, or null where the vector takes no part."""
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(vec.isNotNull() & ~bad, F.transform(vec, lambda x: F.floor(x.cast("double") * scale)))


def narrow(v: np.ndarray) -> np.ndarray:
    """The same integers in as few bytes as hold them all."""
    for kind in ("<i2", "<i4"):
        if not v.size or (np.iinfo(kind).min <= v.min() and v.max() <= np.iinfo(kind).max):
            return v.astype(kind)
    return v.astype("<i8")


def few_copies(ids: np.ndarray, v: np.ndarray, k: int) -> np.ndarray:
    """Places, in the order of ids, of the k + 1 smallest ids of each distinct vector."""
    rows = np.ascontiguousarray(v).view(np.dtype((np.void, v.shape[1] * v.itemsize))).ravel()
    _, kind = np.unique(rows, return_inverse=True)
    o = np.lexsort((ids, kind))
    new = np.ones(len(o), bool)
    new[1:] = (ids[o][1:] != ids[o][:-1]) | (kind[o][1:] != kind[o][:-1])
    o = o[new]
    head = np.searchsorted(kind[o], kind[o])
    o = o[np.arange(len(o)) - head <= k]
    return o[np.argsort(ids[o], kind="stable")]


def quantised(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(least value, width of a cell, cell of each component) by column."""
    low = v.min(axis=0).astype("<i8")
    span = v.max(axis=0).astype(np.int64).view(np.uint64) - low.view(np.uint64)
    step = span // np.uint64(CELLS) + np.uint64(1)
    return low, step.astype("<u8"), ((v.astype(np.int64).view(np.uint64) - low.view(np.uint64)) // step).astype(np.uint8)


class Nearest:
    """Candidates of a block of queries: those that k distinct ids don't certainly beat."""

    def __init__(self, qid: np.ndarray, q: np.ndarray, k: int):
        self.qid, self.q, self.k = qid, q.astype(np.float64), k
        self.kth, self.kth_id = np.full(len(qid), -np.inf), np.full(len(qid), np.iinfo(np.int64).max)
        self.rows: list[np.ndarray] = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0)]

    def scan(self, no: int, ids: np.ndarray, low: np.ndarray, step: np.ndarray, code: np.ndarray) -> None:
        """One block of the approximation file; ids are in order."""
        mid = low.astype(np.float64) + code * step.astype(np.float64) + (step.astype(np.float64) - 1) / 2
        half = (step.astype(np.float64) - 1) / 2
        size = np.abs(self.q) @ np.abs(mid).max(axis=0)
        slack = np.abs(self.q) @ half + np.where(size < 2.0**50, 0, size * 2.0**-44)  # whole and half numbers below that are exact
        first = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))
        uid = ids[first]
        own = np.searchsorted(uid, self.qid)
        found = []
        for a in range(0, len(self.q), 256):
            est = self.q[a : a + 256] @ mid.T
            if len(uid) < len(ids):
                est = np.maximum.reduceat(est, first, axis=1)
            s = slack[a : a + 256, None]
            at = own[a : a + 256]
            is_own = np.flatnonzero((at < len(uid)) & (uid[np.minimum(at, len(uid) - 1)] == self.qid[a : a + 256]))
            est[is_own, at[is_own]] = -np.inf
            floor = self.kth[a : a + 256]
            if len(uid) > self.k:
                fresh = np.flatnonzero(np.isneginf(floor))
                if len(fresh):
                    floor = floor.copy()
                    floor[fresh] = np.partition(est[fresh], len(uid) - self.k, axis=1)[:, len(uid) - self.k] - s[fresh, 0]
            r, c = np.nonzero((est + s >= np.maximum(floor, -1e300)[:, None]))
            e, s = est[r, c], s[r, 0]
            found.append((a + r, uid[c], np.full(len(r), no), np.clip(e - s, LEAST, MOST), np.clip(e + s, LEAST, MOST)))
        self.rows = [np.concatenate((mine, *new)) for mine, new in zip(self.rows, zip(*found, strict=True), strict=True)]
        self._cut()

    def _cut(self) -> None:
        r, i, no, low, up = self.rows
        o = np.lexsort((-low, i, r))
        new = np.ones(len(o), bool)
        new[1:] = (r[o][1:] != r[o][:-1]) | (i[o][1:] != i[o][:-1])
        o = o[new]
        o = o[np.lexsort((i[o], -low[o], r[o]))]
        head = np.searchsorted(r[o], np.arange(len(self.q)))
        full = np.flatnonzero(np.diff(np.append(head, len(o))) >= self.k)
        at = o[head[full] + self.k - 1]
        self.kth[full], self.kth_id[full] = low[at], i[at]
        keep = (up > self.kth[r]) | ((up == self.kth[r]) & (i <= self.kth_id[r]))
        self.rows = [x[keep] for x in self.rows]


_FOUND = "query_id long, vec_id long, no long, up double"
_KINDS = {1: "<i8", 2: "<i2", 4: "<i4", 8: "<i8"}


def _exact(raw: bytes, n: int, dim: int) -> np.ndarray:
    return np.frombuffer(raw, _KINDS[len(raw) // max(1, n * dim)]).reshape(n, dim)


def _search(k: int):
    def run(key, table):
        rows = table.to_pylist()
        out = [], [], [], []
        for x in rows:
            if x["kind"] == 0:
                qid = np.frombuffer(x["ids"], "<i8")
                best = Nearest(qid, _exact(x["exact"], len(qid), x["dim"]), k)
                for y in rows:
                    if y["kind"] == 1 and y["dim"] == x["dim"]:
                        ids = np.frombuffer(y["ids"], "<i8")
                        best.scan(y["no"], ids, np.frombuffer(y["low"], "<i8"), np.frombuffer(y["step"], "<u8"), np.frombuffer(y["code"], np.uint8).reshape(len(ids), -1))
                r, i, no, _, up = best.rows
                for col, v in zip(out, (qid[r], i, no, up), strict=True):
                    col.append(v)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64())
        return pa.Table.from_arrays([pa.array(np.concatenate(c) if c else [], t) for c, t in zip(out, kinds, strict=True)], names=["query_id", "vec_id", "no", "up"])

    return run


def _products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Exact inner products by row, beyond 64 bits the nearest 64-bit integer."""
    if not len(q):
        return np.zeros(0, np.int64)
    large = float(np.abs(q.astype(np.float64)).max()) * float(np.abs(v.astype(np.float64)).max()) * q.shape[1] >= 2.0**62
    if not large:
        return np.einsum("nd,nd->n", q.astype(np.int64), v.astype(np.int64))
    true = [sum(x * y for x, y in zip(a, b, strict=True)) for a, b in zip(q.tolist(), v.tolist(), strict=True)]
    return np.array([min(max(x, -(1 << 63)), (1 << 63) - 1) for x in true], np.int64)


def _read(key, wanted, block):
    """Exact scores of the candidates of one block."""
    names, kinds = ["query_id", "vec_id", "score", "reads"], (pa.int64(),) * 4
    if not block.num_rows or not wanted.num_rows:
        return pa.Table.from_arrays([pa.array([], t) for t in kinds], names=names)
    x = block.to_pylist()[0]
    ids, dim = np.frombuffer(x["ids"], "<i8"), x["dim"]
    v = _exact(x["exact"], len(ids), dim)
    col = wanted.column("qv").combine_chunks()
    wanted = wanted.filter(pa.array(np.diff(np.asarray(col.offsets)) == dim))
    q = wanted.column("qv").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
    vec = wanted.column("vec_id").to_numpy()
    head = np.searchsorted(ids, vec)
    many = np.searchsorted(ids, vec, side="right") - head
    row = np.repeat(np.arange(len(vec)), many)
    at = np.repeat(head, many) + np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
    score = np.concatenate([np.zeros(0, np.int64), *(_products(q[row[i : i + 50_000]], v[at[i : i + 50_000]]) for i in range(0, len(row), 50_000))])
    some = many > 0
    best = np.maximum.reduceat(score, (np.cumsum(many) - many)[some]) if len(score) else score
    cols = wanted.column("query_id").to_numpy()[some], vec[some], best, many[some]
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)


_BLOCK = pa.schema([("kind", pa.int32()), ("dim", pa.int32()), ("ids", pa.binary()), ("exact", pa.binary()), ("low", pa.binary()), ("step", pa.binary()), ("code", pa.binary())])


def _packer(kind: int, size: int, k: int):
    def run(batches):
        held: dict[int, list] = {}  # by length of vector
        count: dict[int, int] = {}

        def out(d):
            ids = np.concatenate([x for x, _ in held[d]])
            v = narrow(np.concatenate([x for _, x in held[d]]).reshape(-1, d))
            held[d], count[d] = [], 0
            o = few_copies(ids, v, k) if kind else np.argsort(ids, kind="stable")
            ids, v = ids[o].astype("<i8"), v[o]
            cells = [x.tobytes() for x in quantised(v)] if kind else [None] * 3
            return pa.RecordBatch.from_pylist([dict(zip(_BLOCK.names, (kind, d, ids.tobytes(), v.tobytes(), *cells), strict=True))], _BLOCK)

        for t in batches:
            ids = t.column(0).to_numpy(zero_copy_only=False)
            vec = t.column(1)
            flat, offs = vec.flatten().to_numpy(zero_copy_only=False), np.asarray(vec.offsets)
            offs = offs - offs[0] if len(offs) else offs
            n = np.diff(offs)
            for d in np.unique(n[n > 0]).tolist():
                own = np.flatnonzero(n == d)
                at = 0
                while at < len(own):
                    take = own[at : at + size - count.get(d, 0)]
                    at += len(take)
                    held.setdefault(d, []).append((ids[take].astype("<i8"), flat[(offs[take][:, None] + np.arange(d)).ravel()].astype("<i8")))
                    count[d] = count.get(d, 0) + len(take)
                    if count[d] >= size:
                        yield out(d)
        for d in list(held):
            if held[d]:
                yield out(d)

    return run


def _best(scores: DataFrame, k: int) -> DataFrame:
    """Each query's k best ids with rank; reads are the exact vectors read for the query."""
    once = scores.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"), F.sum("reads").alias("reads"))
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    once = once.select("*", F.row_number().over(by).alias("rank"), F.sum("reads").over(Window.partitionBy("query_id")).alias("exact_reads"))
    return once.where(F.col("rank") <= k)


def topk(vectors: DataFrame, is_query: Column, k: int = 20, scale: int = 64) -> DataFrame:
    """(query_id, rank, vec_id, score, exact_reads) for each row where ``is_query`` holds; vec_id is a row's id, embedding its vector."""
    spark = vectors.sparkSession
    _base.ready(spark)
    cores = spark.sparkContext.defaultParallelism
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), whole(F.col("embedding"), scale).alias("v"), is_query.alias("q")).where("v is not null and vec_id is not null")
    shape = "kind int, dim int, ids binary, exact binary, low binary, step binary, code binary"
    tasks = _base.parts_for(_base.stored_bytes(vectors), 4 << 20)
    asked = rows.where("q").select("vec_id", "v").distinct()
    blocks = rows.select("vec_id", "v").coalesce(tasks).mapInArrow(_packer(1, VECTOR_BLOCK, k), shape)
    queries = asked.coalesce(max(1, tasks // 4)).mapInArrow(_packer(0, QUERY_BLOCK, k), shape)
    packed = _base.staged(blocks.union(queries).select(F.monotonically_increasing_id().alias("no"), "*"), "blocks")
    count = {r.kind: r["count"] for r in packed.groupBy("kind").count().collect()}
    if len(count) < 2:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long, exact_reads long")
    qgroups = _base.parts_for(count[0], TOGETHER)
    vgroups = max(_base.parts_for(count[1], TOGETHER), min(2 * count[1], _base.parts_for(2 * cores, qgroups)))
    own, other = (F.pmod(F.xxhash64("no"), F.lit(n)).cast("int") for n in (qgroups, vgroups))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    cells = packed.where("kind = 1").select(every(qgroups).alias("qg"), other.alias("vg"), "kind", "no", "dim", "ids", F.lit(None).cast("binary").alias("exact"), "low", "step", "code")
    asking = packed.where("kind = 0").select(own.alias("qg"), every(vgroups).alias("vg"), "kind", "no", "dim", "ids", "exact", "low", "step", "code")
    found = cells.union(asking).groupBy("qg", "vg").applyInArrow(_search(k), _FOUND)
    by_bound = Window.partitionBy("query_id").orderBy(F.desc("up"), "vec_id", "no")
    cand = _base.staged(found.withColumn("n", F.row_number().over(by_bound)), "candidates")
    exact = packed.where("kind = 1").select("no", "dim", "ids", "exact")

    def read(some: DataFrame) -> DataFrame:
        parts = some.groupBy("no").agg(F.ceil(F.count("*") / READERS).cast("int").alias("parts"))
        want = some.join(asked.select(F.col("vec_id").alias("query_id"), F.col("v").alias("qv")), "query_id").join(parts, "no")
        want = want.select("no", F.pmod(F.xxhash64("query_id"), F.col("parts")).cast("int").alias("part"), "query_id", "vec_id", "qv")
        have = exact.join(parts, "no").select("no", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "dim", "ids", "exact")
        return want.groupBy("no", "part").cogroup(have.groupBy("no", "part")).applyInArrow(_read, "query_id long, vec_id long, score long, reads long")

    first = _base.staged(read(cand.where(F.col("n") <= k)), "scores")
    kth = _best(first, k).where(F.col("rank") == k).select("query_id", F.col("score").alias("kth"), F.col("vec_id").alias("kth_id"))
    rest = cand.where(F.col("n") > k).join(kth, "query_id", "left")
    rest = rest.where("kth is null or up > kth or (up = kth and vec_id < kth_id)").select("query_id", "vec_id", "no")
    rest = _base.staged(rest, "rest")
    scores = first.union(read(rest)) if rest.head(1) else first
    out = _best(scores, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score", "exact_reads")
    return _base.finished(out, "nearest", packed, cand, first, rest, tasks=4 * cores)
