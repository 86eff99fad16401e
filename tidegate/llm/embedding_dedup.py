"""Operator 8: near-duplicate embeddings by hierarchical navigable small worlds.

Vectors compare only under equal, non-null labels of any type.  Equal vectors
of a label collapse first.  Each label's vectors are dealt into shards of
bounded size by a hash of their id; each shard gets one graph, stored in the
shared folder, and every two shards of a label meet in one of the two graphs.
A query whose whole beam lies above the threshold goes on along the edges of
all it finds above it.  Audits compare sampled queries with brute force; one
that fails widens the beam, and the vectors it lost get new edges.  Found
pairs are verified by their cosine in double precision; links join components.

Vectors that are null, zero, or hold null or non-finite components link with
nothing, like rows with null label or null vec_id.  Repeated rows count as
copies.  A cosine equal to the threshold links.  Columns other than vec_id,
embedding and label are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegate.llm import _base, _bytes

SHARD, DEGREE, BUILD_BEAM = 16_384, 16, 48
#: Beams in the order tried, queries of an audit, the recall it wants, shards that query a graph in one task.
BEAMS, AUDIT, RECALL, TOGETHER = (32, 64, 128, 256), 512, 0.99, 8


class Graph:
    """A navigable small world over unit vectors, built and searched many vectors at a time."""

    def __init__(self, unit: np.ndarray, layers: list[np.ndarray] | None = None):
        self.x = np.ascontiguousarray(unit, np.float32)
        n = len(unit)
        if layers is not None:
            self.layers = layers
            return
        u = (_bytes.mix(np.arange(1, n + 1, dtype=np.uint64)) >> np.uint64(11)).astype(np.float64) / (1 << 53)
        level = np.minimum((-np.log(np.maximum(u, 1e-12)) / np.log(DEGREE)).astype(int), 4)
        level[0] = level.max()
        self.layers = [np.full((n, 2 * DEGREE if lv == 0 else DEGREE), -1, np.int32) for lv in range(level.max() + 1)]
        at = 1
        while at < n:
            new = np.arange(at, min(n, at + max(1, min(at // 2, 256))))
            near = np.zeros((len(new), 1), np.int32)
            for lv in range(len(self.layers) - 1, -1, -1):
                own = level[new] >= lv
                got, sim = self.search(self.x[new], near, BUILD_BEAM if own.any() else 1, lv)
                near = got[:, :1]
                if not own.any():
                    continue
                w = new[own]  # those of the same batch are seen directly
                among = self.x[w] @ self.x[w].T
                np.fill_diagonal(among, -np.inf)
                ids = np.concatenate((got[own], np.broadcast_to(w.astype(np.int32), (len(w), len(w)))), 1)
                sims = np.concatenate((sim[own], among), 1)
                k = min(DEGREE, ids.shape[1])
                top = np.argsort(-sims, axis=1, kind="stable")[:, :k]
                ids, sims = np.take_along_axis(ids, top, 1), np.take_along_axis(sims, top, 1)
                ids[~np.isfinite(sims)] = -1
                self._link(lv, w, ids)
            at += len(new)
        self._reach_all()

    def _reach_all(self) -> None:
        """Give vectors that no edges lead to, as links were trimmed, a way from the nearest reachable one, in two columns more: to its first, and on to its next."""
        x, n = self.x, len(self.x)
        adj = self.layers[0] = np.concatenate((self.layers[0], np.full((n, 2), -1, np.int32)), 1)
        got = np.zeros(n, bool)
        wave = np.zeros(1, np.int64)
        while True:
            while len(wave):
                got[wave] = True
                wave = np.unique(adj[wave])
                wave = wave[wave >= 0]
                wave = wave[~got[wave]]
            lost = np.flatnonzero(~got)
            if not len(lost):
                return
            out = np.where((adj[lost] >= 0) & got[adj[lost]], adj[lost], -1)
            ok = (out >= 0).any(axis=1)
            if ok.any():
                lost, out = lost[ok], out[ok]
                sims = np.where(out >= 0, np.einsum("lkd,ld->lk", x[out], x[lost]), -np.inf)
                near = np.take_along_axis(out, sims.argmax(axis=1)[:, None], 1)[:, 0]
            else:
                lost = lost[:1]
                have = np.flatnonzero(got)
                near = have[[int((x[have] @ x[lost[0]]).argmax())]]
            for u, v in zip(lost.tolist(), near.tolist(), strict=True):
                adj[u, -1], adj[v, -2] = adj[v, -2], u
            wave = lost

    def _link(self, lv: int, new: np.ndarray, ids: np.ndarray) -> None:
        adj = self.layers[lv]
        width = adj.shape[1]
        adj[new, : ids.shape[1]] = ids
        src, dst = np.repeat(new, ids.shape[1]), ids.ravel()
        ok = dst >= 0
        src, dst = src[ok], dst[ok]
        o = np.argsort(dst, kind="stable")
        src, dst = src[o], dst[o]
        head = np.flatnonzero(np.concatenate(([True], dst[1:] != dst[:-1]))) if len(dst) else []
        for a, b in zip(head, np.append(head[1:], len(dst)) if len(dst) else [], strict=True):
            t = int(dst[a])
            have = adj[t][adj[t] >= 0]
            every = np.unique(np.concatenate((have, src[a:b])))
            every = every[every != t]
            if len(every) > width:  # keep the nearest, and the last few by a spread of ids so that clusters stay joined
                s = self.x[every] @ self.x[t]
                by = np.argsort(-s, kind="stable")
                near = by[: width - 4]
                far = by[width - 4 :][np.linspace(0, len(by) - width + 3, 4).astype(int)]
                every = every[np.concatenate((near, far))]
            adj[t] = -1
            adj[t, : len(every)] = every

    def relink(self, q: np.ndarray, asked: np.ndarray, lost: np.ndarray) -> None:
        """Edges both ways, in two columns more, between each lost vector and the nearest one that its query reaches."""
        if not len(lost):
            return
        lost, first = np.unique(lost, return_index=True)
        part = q[asked[first]]
        near = self.search(part, self.descend(part), min(BEAMS[0], len(self.x)))[0][:, 0].astype(np.int64)
        adj = self.layers[0] = np.concatenate((self.layers[0], np.full((len(self.x), 2), -1, np.int32)), 1)
        adj[near, -1] = lost
        adj[lost, -2] = near

    def search(self, q: np.ndarray, entry: np.ndarray, beam: int, lv: int = 0, step: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """Ids and similarities of the best ``beam`` found per query, best first (-1 and -inf where fewer)."""
        adj, n = self.layers[lv], len(self.x)
        b = len(q)
        row = np.arange(b)[:, None]
        seen = np.zeros((b, n), bool)
        ids = np.full((b, beam), -1, np.int32)
        sims = np.full((b, beam), -np.inf, np.float32)
        width = min(beam, entry.shape[1])
        ids[:, :width] = entry[:, :width]
        sims[:, :width] = np.einsum("bkd,bd->bk", self.x[ids[:, :width]], q)
        seen[row, ids[:, :width]] = True
        open_ = ids >= 0
        step = min(step, beam)
        while True:
            s = np.where(open_, sims, -np.inf)
            pick = np.argsort(-s, axis=1, kind="stable")[:, :step] if step > 1 else s.argmax(axis=1)[:, None]
            good = np.take_along_axis(s, pick, 1) > -np.inf
            live = good.any(axis=1)
            if not live.any():
                break
            np.put_along_axis(open_, pick, False, 1)
            r = np.flatnonzero(live)
            cur = np.where(good[r], np.take_along_axis(ids[r], pick[r], 1), -1)
            nb = np.where(cur[:, :, None] >= 0, adj[cur], -1).reshape(len(r), -1)
            nb.sort(axis=1)
            ok = nb >= 0
            ok[:, 1:] &= nb[:, 1:] != nb[:, :-1]
            ok &= ~seen[r[:, None], nb]
            rr, cc = np.nonzero(ok)
            at = nb[rr, cc]
            seen[r[rr], at] = True
            sim = np.full(nb.shape, -np.inf, np.float32)
            sim[rr, cc] = np.einsum("nd,nd->n", self.x[at], q[r[rr]])
            all_i = np.concatenate((ids[r], np.where(ok, nb, -1)), 1)
            all_s = np.concatenate((sims[r], sim), 1)
            all_o = np.concatenate((open_[r], ok), 1)
            top = np.argpartition(-all_s, beam - 1, axis=1)[:, :beam] if all_s.shape[1] > beam else np.broadcast_to(np.arange(beam), (len(r), beam))
            ids[r], sims[r], open_[r] = (np.take_along_axis(z, top, 1) for z in (all_i, all_s, all_o))
        o = np.argsort(-sims, axis=1, kind="stable")
        return np.take_along_axis(ids, o, 1), np.take_along_axis(sims, o, 1)

    def descend(self, q: np.ndarray) -> np.ndarray:
        near = np.zeros((len(q), 1), np.int32)
        for lv in range(len(self.layers) - 1, 0, -1):
            near = self.search(q, near, 1, lv, 1)[0][:, :1]
        return near

    def within(self, q: np.ndarray, threshold: float, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, vector) pairs found with similarity of about the threshold or more; where the whole beam lies above it, the search goes on along the edges."""
        left, right = [], []
        n, low = len(self.x), threshold - 1e-4
        beam = min(beam, n)
        size = max(8, min(256, 2_000_000 // max(beam, n // 8)))
        for a in range(0, len(q), size):
            part = q[a : a + size]
            got, sims = self.search(part, self.descend(part), beam)
            full = sims[:, -1] >= low
            r, c = np.nonzero((sims >= low) & ~full[:, None])
            left.append(a + r)
            right.append(got[r, c])
            own = np.flatnonzero(full)
            step = max(1, 1_000_000 // n)
            for b in range(0, len(own), step):
                r, ids = self._spread(part[own[b : b + step]], got[own[b : b + step]], low)
                left.append(a + own[b + r])
                right.append(ids)
        return np.concatenate(left), np.concatenate(right).astype(np.int64)

    def _spread(self, q: np.ndarray, found: np.ndarray, low: float) -> tuple[np.ndarray, np.ndarray]:
        """All (query, vector) pairs with similarity of ``low`` or more that edges between such vectors reach from the found ones."""
        n, adj = len(self.x), self.layers[0]
        seen = np.zeros(len(q) * n, bool)
        key = (np.arange(len(q))[:, None] * n + found).ravel()
        seen[key] = True
        out, todo = [key], [key]
        while todo:
            key = todo.pop()
            if len(key) > 50_000:
                todo.append(key[50_000:])
                key = key[:50_000]
            r, nb = key // n, adj[key % n]
            nxt = (r[:, None] * n + nb)[nb >= 0]
            nxt = np.unique(nxt[~seen[nxt]])
            seen[nxt] = True
            nxt = nxt[np.einsum("nd,nd->n", self.x[nxt % n], q[nxt // n]) >= low]
            if len(nxt):
                out.append(nxt)
                todo.append(nxt)
        key = np.concatenate(out)
        return key // n, key % n


def audit(graph: Graph, q: np.ndarray, some: np.ndarray, threshold: float, own: bool, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(query, vector) of the pairs that queries ``some`` lack among the found (a, b), and the number of pairs they have by brute force."""
    truth = q[some] @ graph.x.T >= threshold
    if own:
        truth[np.arange(len(some)), some] = False
    all_ = int(truth.sum())
    place = np.full(len(q), -1)
    place[some] = np.arange(len(some))
    asked = place[a] >= 0
    truth[place[a[asked]], b[asked]] = False
    r, c = np.nonzero(truth)
    return some[r], c, all_


def _spread_over(items: np.ndarray, many: int) -> np.ndarray:
    return items[np.unique(np.linspace(0, len(items) - 1, min(many, len(items))).astype(int))] if len(items) else items


def links_between(graph: Graph, q: np.ndarray, threshold: float, own: bool = False) -> tuple[np.ndarray, np.ndarray, int, float]:
    """Found (query, vector) pairs, the beam that passed its audits and the recall of the last audit.

    ``own``: the queries are the graph's vectors; a pair then counts from both
    sides once either side finds it.  Two audits against brute force must pass:
    one of queries spread over all, before the others are asked, and one of
    queries that have links.  A failed audit doubles the beam and gives the
    vectors it lost edges from what their queries found.  Should the widest
    beam fail, this pair of shards is compared in full (beam 0).
    """
    every = np.arange(len(q))
    for beam in BEAMS:
        some = _spread_over(every, AUDIT)
        r, found = graph.within(q[some], threshold, beam)
        lost_q, lost, have = audit(graph, q, some, threshold, own, some[r], found)
        if len(lost) <= (1 - RECALL) * have:
            a, b = graph.within(q, threshold, beam)
            if own:
                key = np.unique(np.concatenate((a * len(q) + b, b * len(q) + a)))
                a, b = key // len(q), key % len(q)
            linked = np.unique(a[a != b] if own else a)
            lost_q, lost, have = audit(graph, q, _spread_over(linked, AUDIT), threshold, own, a, b)
            if len(lost) <= (1 - RECALL) * have:
                return a, b, beam, 1 - len(lost) / max(have, 1)
        graph.relink(q, lost_q, lost)
    left, right = [], []
    for at in range(0, len(q), 256):
        r, c = np.nonzero(q[at : at + 256] @ graph.x.T >= threshold - 1e-4)
        left.append(at + r)
        right.append(c)
    return np.concatenate(left), np.concatenate(right), 0, 1.0


def scaled(v: np.ndarray) -> np.ndarray:
    """Vectors in double precision by powers of two, which are exact, so that no square overflows."""
    _, e = np.frexp(np.abs(v).max(axis=1, keepdims=True))
    return np.ldexp(v.astype(np.float64), -e)


def verified(a: np.ndarray, b: np.ndarray, va: np.ndarray, vb: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs' cosines in double precision reach the threshold."""
    keep = np.zeros(len(a), bool)
    va, vb = scaled(va), scaled(vb)
    na, nb = np.sqrt((va * va).sum(axis=1)), np.sqrt((vb * vb).sum(axis=1))
    for i in range(0, len(a), 100_000):
        x, y = a[i : i + 100_000], b[i : i + 100_000]
        keep[i : i + 100_000] = np.einsum("nd,nd->n", va[x], vb[y]) / (na[x] * nb[y]) >= threshold
    return keep


def _vectors(table) -> np.ndarray:
    col = table.column("v").combine_chunks()
    flat = (pa.concat_arrays(col.chunks) if isinstance(col, pa.ChunkedArray) else col).flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(table.num_rows, -1)


def _unit(v: np.ndarray) -> np.ndarray:
    v = scaled(v)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


_GRAPHS = "grp string, dim int, shard int, shards int, ids binary, vecs binary, layers binary"


def _build(key, table):
    # In an order of their own, so that neighbouring ids that resemble each other don't come one after another.
    rep = table.column("rep").to_numpy()
    table = table.take(np.lexsort((rep, _bytes.mix(rep.astype(np.int64).view(np.uint64)))))
    v = _vectors(table)
    graph = Graph(_unit(v))
    short = v.astype("<f4")  # single precision where it loses nothing
    vecs = (short if (short.astype(np.float64) == v).all() else v.astype("<f8")).tobytes()
    ids = table.column("rep").to_numpy().astype("<i8").tobytes() + table.column("copies").to_numpy().astype("<i8").tobytes()
    layers = b"".join(layer.astype("<i4").tobytes() for layer in graph.layers)
    grp, dim, shard, shards = (k.as_py() for k in key)
    row = {"grp": grp, "dim": dim, "shard": shard, "shards": shards, "ids": ids, "vecs": vecs, "layers": np.array([len(graph.layers)], "<i8").tobytes() + layers}
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    return pa.Table.from_pylist([row], pa.schema(list(zip(row, kinds, strict=True))))


def _load(ids: bytes, vecs: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    both = np.frombuffer(ids, "<i8")
    n, dim_bytes = len(both) // 2, len(vecs) // (len(both) // 2)
    return both[:n], both[n:], np.frombuffer(vecs, np.uint8).reshape(n, dim_bytes)


def _numbers(raw: np.ndarray, dim: int) -> np.ndarray:
    return raw.view("<f4" if raw.shape[1] == 4 * dim else "<f8")


def _layers(raw: bytes, n: int) -> list[np.ndarray]:
    layers, at = [], 8
    for lv in range(int(np.frombuffer(raw, "<i8", 1)[0])):
        w = 2 * DEGREE + 2 if lv == 0 else DEGREE
        layers.append(np.frombuffer(raw, "<i4", n * w, at).reshape(n, w))
        at += 4 * n * w
    return layers


_LINKS = pa.schema([("rep", pa.int64()), ("peer", pa.int64()), ("links", pa.int64()), ("beam", pa.int32()), ("recall", pa.float64())])


def _query(threshold: float):
    """One graph and a bounded number of shards that query it; a row with null ``rep`` tells each audit."""

    def met(graph, own, ids_a, copies_a, va, ids_b, copies_b, vb):
        a, b, beam, recall = links_between(graph, _unit(va).astype(np.float32), threshold, own)
        if own:
            up = a < b
            a, b = a[up], b[up]
        ok = verified(a, b, va, vb, threshold)
        a, b = a[ok], b[ok]
        ids = np.concatenate((ids_a, ids_b))
        adds = np.concatenate((np.bincount(a, copies_b[b], len(ids_a)), np.bincount(b, copies_a[a], len(ids_b)))).astype(np.int64)
        o = np.argsort(ids, kind="stable")
        node, root = _base.local_roots(ids_a[a], ids_b[b])
        head = np.searchsorted(ids[o], node)
        total = np.append(np.cumsum(adds[o]), 0)
        tail = np.searchsorted(ids[o], node, side="right")
        links = total[tail - 1] - np.where(head > 0, total[head - 1], 0)
        n = len(node) + 1
        cols = [pa.array(np.append(node, 0), pa.int64(), mask=np.arange(n) == n - 1), pa.array(np.append(root, 0), pa.int64()), pa.array(np.append(links, 0), pa.int64()), pa.array(np.full(n, beam, np.int32)), pa.array(np.full(n, recall))]
        return pa.Table.from_arrays(cols, schema=_LINKS)

    def run(key, table):
        dim = key[1].as_py()
        out = []
        blobs = table.select(["ids", "vecs", "layers"]).to_pylist()
        own = next(r for r in blobs if r["layers"] is not None)
        ids_b, copies_b, raw = _load(own["ids"], own["vecs"])
        vb = _numbers(raw, dim)
        graph = Graph(_unit(vb), _layers(own["layers"], len(vb)))
        if table.column("itself").to_pylist()[blobs.index(own)]:
            out.append(met(graph, True, ids_b, copies_b, vb, ids_b, copies_b, vb))
        for r in blobs:
            if r["layers"] is None:
                ids_a, copies_a, raw = _load(r["ids"], r["vecs"])
                out.append(met(graph, False, ids_a, copies_a, _numbers(raw, dim), ids_b, copies_b, vb))
        return pa.concat_tables(out) if out else _LINKS.empty_table()

    return run


def usable(vec: Column) -> Column:
    """The vector in double precision, or null where it can link with nothing."""
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    zero = ~F.exists(vec, lambda x: x != 0)
    return F.when(vec.isNotNull() & ~bad & ~zero, F.transform(vec, lambda x: x.cast("double")))


def found_links(reps: DataFrame, threshold: float, tasks: int) -> DataFrame:
    """(rep, peer, links, beam, recall) from staged reps(grp, dim, v, rep, copies): what each rep links with, and a row with null rep for each pair of shards."""
    sizes = reps.groupBy("grp", "dim").agg(F.ceil(F.count("*") / SHARD).cast("int").alias("shards"))
    dealt = reps.join(sizes, ["grp", "dim"]).withColumn("shard", F.pmod(F.xxhash64("rep"), F.col("shards")).cast("int"))
    built = dealt.select("grp", "dim", "shard", "shards", "rep", "copies", "v").groupBy("grp", "dim", "shard", "shards").applyInArrow(_build, _GRAPHS)
    graphs = _base.staged(built, "graphs", tasks)
    # Each pair of shards of a label meets once: the vectors of the lower shard go to the graph of the higher one, TOGETHER shards a task.
    last = F.floor(F.col("shard") / TOGETHER).cast("int")
    chunk = F.explode(F.sequence(F.lit(0), last))
    whole = graphs.select("grp", "dim", F.col("shard").alias("t"), chunk.alias("chunk"), last.alias("last"), "ids", "vecs", "layers")
    whole = whole.select("grp", "dim", "t", "chunk", (F.col("chunk") == F.col("last")).alias("itself"), "ids", "vecs", "layers")
    asking = graphs.where("shard + 1 < shards").select("grp", "dim", F.explode(F.sequence(F.col("shard") + 1, F.col("shards") - 1)).alias("t"), last.alias("chunk"), F.lit(False).alias("itself"), "ids", "vecs", F.lit(None).cast("binary").alias("layers"))
    # A group without a graph (an empty shard) has nothing to meet.
    have = graphs.select("grp", "dim", F.col("shard").alias("t"))
    met = whole.union(asking.join(have, ["grp", "dim", "t"], "left_semi")).groupBy("grp", "dim", "t", "chunk")
    found = _base.staged(met.applyInArrow(_query(threshold), "rep long, peer long, links long, beam int, recall double"), "links", tasks)
    _base.drop_staged(graphs)
    return found


def near_duplicates(vectors: DataFrame, threshold: float = 0.93) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of vectors(vec_id, embedding, label)."""
    spark = vectors.sparkSession
    _base.ready(spark)
    label = F.col("label")
    if dict(vectors.dtypes)["label"] in ("float", "double"):
        label = label + F.lit(0.0)  # one zero
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(label.isNotNull() & F.col("vec_id").isNotNull(), usable(F.col("embedding"))).alias("v"), label.cast("string").alias("grp"))
    # A vector takes up to four times its stored size with its links.
    tasks = _base.tasks_for(spark, 4 * _base.stored_bytes(vectors))
    some = rows.where("v is not null").withColumn("dim", F.size("v"))
    reps = _base.staged(some.groupBy("grp", "dim", "v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")), "vectors", tasks)
    links = found_links(reps, threshold, tasks)
    found = links.where("rep is not null")
    roots = _base.components(found.select(F.col("rep").alias("a"), F.col("peer").alias("b")), tasks)
    per = found.groupBy("rep").agg(F.sum("links").alias("links")).join(roots.withColumnRenamed("node", "rep"), "rep", "left")
    own = reps.select("grp", "v", "rep", "copies").join(per, "rep", "left")
    own = own.select("grp", "v", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "rep").alias("component_id"))
    out = rows.join(own, ["grp", "v"], "left").coalesce(tasks)
    root = F.coalesce("component_id", "vec_id")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), root.alias("component_id"), (F.col("vec_id").eqNullSafe(root)).alias("kept"))
    return _base.finished(out, "near", reps, links, roots)
