"""Operator 5: n-gram Jaccard self-join by MinHash banding.

Two documents are linked if the Jaccard similarity of their sets of n-word
shingles reaches ``threshold``.  Band and row counts follow from the recall
wanted at the threshold; documents meet by band hashes, and every candidate
pair is verified on the full shingle sets.

Documents with equal sets form one class and only its representative takes
part, so groups of copies are never expanded.  A pair is verified once, in
the first band that both share.  Buckets of more than ``BLOCK`` documents, or
of more than ``GRAMS`` shingles, are split into blocks, and each pair of blocks
is a group of its own: no pair is lost and no group grows with the data.
Groups return sums and star edges, never pairs.

A document without words (or with null text) has an empty set and links with
nothing, other empty documents included.  Null doc_ids link with nothing and
keep a null class_id.  Repeated rows count as copies of each other.  Where one
doc_id has several texts, it has the links and the class of all of them.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegate.llm import _base, _bytes
from tidegate.llm._bytes import U64

#: Documents and shingles of a block.
BLOCK, GRAMS = 256, 1 << 20


def plan_bands(threshold: float, recall: float = 0.9999, most: int = 128) -> tuple[int, int]:
    """(bands, rows): the most rows, so the fewest false candidates, with which the wanted recall at the threshold takes at most ``most`` hashes."""
    for rows in range(12, 0, -1):
        hit = threshold**rows
        bands = 1 if hit >= 1 else math.ceil(math.log(1 - recall) / math.log(1 - hit))
        if bands * rows <= most:
            return bands, rows
    return most, 1


def _coefficients(count: int) -> tuple[np.ndarray, np.ndarray]:
    seed = np.arange(1, count + 1, dtype=U64)
    return _bytes.mix(seed * U64(0xA24BAED4963EE407)) | U64(1), _bytes.mix(seed * U64(0x9FB21C651E98DF25))


def band_hashes(grams: np.ndarray, bands: int, rows: int) -> np.ndarray:
    a, b = _coefficients(bands * rows)
    low = np.full(bands * rows, ~U64(0))
    for i in range(0, len(grams), 4096):
        part = grams[i : i + 4096]
        np.minimum(low, (a[:, None] * part + b[:, None]).min(axis=1), out=low)
    low = low.reshape(bands, rows)
    h = np.arange(1, bands + 1, dtype=U64)
    for r in range(rows):
        h = _bytes.mix(h * U64(0x9E3779B97F4A7C15) + low[:, r])
    return h


def _digest(grams: np.ndarray) -> bytes:
    return hashlib.blake2b(grams.tobytes(), digest_size=16).digest()


def _sign(n: int, bands: int, rows: int):
    def run(batches):
        for part in _bytes.slices(batches, 1 << 19):
            sets = _bytes.shingle_sets(part.column(1), n)
            digest = [_digest(s) if len(s) else None for s in sets]
            sig = [band_hashes(s, bands, rows).view(np.int64) if len(s) else None for s in sets]
            grams = pa.array([len(s) for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(digest, pa.binary()), grams, pa.array(sig, pa.list_(pa.int64()))], names=["doc_id", "digest", "grams", "bands"])

    return run


def _groups(batches):
    """Rows sorted by group, cut at changes of (gid, i, j); each as a table."""
    held = []
    for t in batches:
        if not t.num_rows:
            continue
        keys = np.stack([t.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("gid", "i", "j")], 1)
        cut = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
        bounds = [0, *cut, t.num_rows]
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            key = tuple(keys[a])
            if held and held[0] != key:
                yield held[1]
                held = []
            if held:
                held[1].append(t.slice(a, b - a))
            else:
                held = [key, [t.slice(a, b - a)]]
    if held:
        yield held[1]


def _column(parts, name):
    return np.concatenate([p.column(name).to_numpy(zero_copy_only=False) for p in parts])


def _first_pairs(sig: np.ndarray, gid: int, block: np.ndarray, i: int, j: int) -> np.ndarray:
    """Matrix of the pairs a < b that this group owns: their first shared band is its band."""
    same = sig[:, None, :] == sig[None, :, :] if len(sig) <= 64 else None
    if same is not None:
        first = np.take_along_axis(np.broadcast_to(sig[:, None, :], same.shape), same.argmax(axis=2)[:, :, None], 2)[:, :, 0]
        own = same.any(axis=2) & (first == gid)
    else:
        own = np.zeros((len(sig), len(sig)), bool)
        seen = np.zeros_like(own)
        for band in range(sig.shape[1]):
            eq = sig[:, None, band] == sig[None, :, band]
            own |= eq & ~seen & (sig[:, None, band] == gid)
            seen |= eq
    own &= np.triu(np.ones_like(own), 1) if i == j else (block[:, None] == i) & (block[None, :] == j)
    return own


def _sigs(parts):
    width = None
    out = []
    for p in parts:
        col = p.column("bands")
        flat = col.flatten().to_numpy(zero_copy_only=False)
        width = len(flat) // p.num_rows
        out.append(flat.reshape(p.num_rows, width))
    return np.concatenate(out)


def _candidates(batches):
    """The members of each group that have a pair to verify there."""
    kinds = {"gid": pa.int64(), "i": pa.int32(), "j": pa.int32(), "block": pa.int32(), "digest": pa.binary()}
    out: list[pa.RecordBatch] = []
    size = 0

    def told():
        return pa.Table.from_batches(out).combine_chunks().to_batches()

    for parts in _groups(batches):
        block, digest = _column(parts, "block"), pa.concat_arrays([p.column("digest") for p in parts])
        gid, i, j = (int(_column(parts[:1], c)[0]) for c in ("gid", "i", "j"))
        own = _first_pairs(_sigs(parts), gid, block, i, j)
        need = own.any(axis=0) | own.any(axis=1)
        k = int(need.sum())
        if k:
            cols = (np.full(k, gid), np.full(k, i), np.full(k, j), block[need], digest.filter(pa.array(need)))
            out.append(pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(cols, kinds.values(), strict=True)], names=list(kinds)))
            size += k
        if size > 20_000:
            yield from told()
            out, size = [], 0
    if size:
        yield from told()


def links_in(sets: list[np.ndarray], own: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The owned pairs whose Jaccard similarity reaches the threshold, by counting shared shingles over postings."""
    size = np.array([len(s) for s in sets])
    grams = np.concatenate(sets)
    doc = np.repeat(np.arange(len(sets)), size)
    o = np.argsort(grams, kind="stable")
    g = grams[o]
    new = np.ones(len(g), bool)
    new[1:] = g[1:] != g[:-1]
    head = np.flatnonzero(new)
    many = np.diff(np.append(head, len(g)))
    term = np.cumsum(new) - 1
    shared = many[term] > 1
    posting = doc[o][shared]  # documents by term, terms in order
    many = many[many > 1]
    begin = np.concatenate(([0], np.cumsum(many)))
    of_term = np.repeat(np.arange(len(many)), many)
    by_doc = np.argsort(posting, kind="stable")
    doc_terms, doc_cut = of_term[by_doc], np.searchsorted(posting[by_doc], np.arange(len(sets) + 1))
    left, right = [], []
    for a in np.flatnonzero(own.any(axis=1)):
        terms = doc_terms[doc_cut[a] : doc_cut[a + 1]]
        ln = many[terms]
        total = int(ln.sum())
        if not total:
            continue
        at = np.repeat(begin[terms] - np.concatenate(([0], np.cumsum(ln)[:-1])), ln) + np.arange(total)
        both = np.bincount(posting[at], minlength=len(sets))
        hit = own[a] & (both >= threshold * (size[a] + size - both) - 1e-9) & (both > 0)
        b = np.flatnonzero(hit)
        left.append(np.full(len(b), a))
        right.append(b)
    none = np.zeros(0, np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def _verify(n: int, threshold: float):
    def run(batches):
        for parts in _groups(batches):
            gid, i, j = (int(_column(parts[:1], c)[0]) for c in ("gid", "i", "j"))
            sets = [s for p in parts for q in _bytes.slices([p], 1 << 19) for s in _bytes.shingle_sets(q.column(q.schema.get_field_index("text")), n)]
            rep, block, size, sigs = _column(parts, "rep"), _column(parts, "block"), _column(parts, "size"), _sigs(parts)
            # Of several texts of one doc_id, each set takes its own.
            own = [k for k, (s, d) in enumerate(zip(sets, (x for p in parts for x in p.column("digest").to_pylist()), strict=True)) if _digest(s) == d]
            sets, rep, block, size, sigs = [sets[k] for k in own], rep[own], block[own], size[own], sigs[own]
            a, b = links_in(sets, _first_pairs(sigs, gid, block, i, j), threshold)
            if not len(a):
                continue
            add = np.bincount(a, size[b], len(rep)) + np.bincount(b, size[a], len(rep))
            node, root = _base.local_roots(rep[a], rep[b])
            total: dict[int, int] = {}
            for r, x in zip(rep.tolist(), add.astype(np.int64).tolist(), strict=True):
                total[r] = total.get(r, 0) + x
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(root), pa.array([total[x] for x in node.tolist()], pa.int64())], names=["rep", "peer", "links"])

    return run


def jaccard_join(docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.9999) -> DataFrame:
    """(doc_id, copy_id, n_links, class_id) for every row of ``docs``.

    copy_id: smallest doc_id with the same set; n_links: other documents with
    similarity of the threshold or more, copies included; class_id: smallest
    doc_id reachable by links.
    """
    spark = docs.sparkSession
    _base.ready(spark)
    bands, rows = plan_bands(threshold, recall)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    tasks = _base.tasks_for(spark, _base.text_bytes(docs))
    signed = _base.staged(docs.mapInArrow(_sign(n, bands, rows), "doc_id long, digest binary, grams long, bands array<long>"), "signed", tasks)
    some = signed.where("digest is not null and doc_id is not null")
    # One row for each set: the signature of its representative.
    one = some.groupBy("digest").agg(F.min_by(F.struct("doc_id", "grams", "bands"), "doc_id").alias("r"), F.count("*").alias("size"))
    one = _base.staged(one.select("digest", F.col("r.doc_id").alias("rep"), "r.grams", "r.bands", "size"), "sets", tasks)
    keyed = one.select("digest", "grams", F.explode("bands").alias("gid"))
    crowd = keyed.groupBy("gid").agg(F.count("*").alias("members"), F.sum("grams").alias("all_grams")).where("members > 1")
    met = keyed.join(crowd, "gid")
    nb = F.greatest(F.ceil(F.col("members") / BLOCK), F.ceil(F.col("all_grams") / GRAMS)).cast("int")
    met = met.select("gid", "digest", nb.alias("nb"), F.pmod(F.xxhash64("digest"), nb).cast("int").alias("block"))
    met = met.select("gid", "digest", "block", F.explode(F.expr("sequence(0, nb - 1)")).alias("other"))
    met = met.select("gid", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "digest")
    grouped = met.join(one.select("digest", "bands"), "digest").repartition("gid", "i", "j").sortWithinPartitions("gid", "i", "j")
    cands = _base.staged(grouped.mapInArrow(_candidates, "gid long, i int, j int, block int, digest binary"), "cands", tasks)
    # Texts of the documents that have a candidate, once, then to their groups.
    sig = one.select("digest", "rep", "bands", "size")
    asked = cands.select("digest").distinct().join(sig.select("digest", "rep"), "digest").select(F.col("rep").alias("doc_id")).distinct()
    texts = docs.join(asked.hint("shuffle_hash"), "doc_id").groupBy(F.col("doc_id").alias("rep")).agg(F.collect_set("text").alias("texts"))
    full = cands.join(sig, "digest").join(texts.select("rep", F.explode("texts").alias("text")), "rep").repartition("gid", "i", "j").sortWithinPartitions("gid", "i", "j")
    found = _base.staged(full.mapInArrow(_verify(n, threshold), "rep long, peer long, links long"), "links", tasks)
    roots = _base.components(found.select(F.col("rep").alias("a"), F.col("peer").alias("b")), tasks)
    per = found.groupBy("rep").agg(F.sum("links").alias("links")).join(roots.withColumnRenamed("node", "rep"), "rep", "left")
    classes = one.select("digest", "rep", "size").join(per, "rep", "left").select("digest", F.col("rep").alias("copy_id"), (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "rep").alias("class_id"))
    alone = F.col("digest").isNull() | F.col("doc_id").isNull()
    out = signed.select("doc_id", F.when(~alone, F.col("digest")).alias("digest")).join(classes, "digest", "left")
    out = out.select("doc_id", F.coalesce("copy_id", "doc_id").alias("copy_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("class_id", "doc_id").alias("class_id"))
    return _base.finished(out.coalesce(tasks), "classes", signed, one, cands, found, roots)
