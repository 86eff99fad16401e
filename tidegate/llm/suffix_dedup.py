"""Operator 7: exact removal of repeated byte strings by suffix arrays.

A byte goes if some ``width``-byte string over it also starts earlier (in a
smaller doc_id, or earlier in the same document).  Strings never cross
documents and are judged on the input.

Plan
 1. Windows are cut into runs that share a minimizer; equal windows always lie
    in runs of equal minimizer hash.  Minimizers with very many contexts are
    counted first; their runs are cut finer, by where the minimizer lies in a
    window, and are known by the bytes that all windows of a cut have in
    common, so no group grows with the number of texts around a passage.
 2. A task settles the repeats inside small chunks of its documents: the text
    of runs that look alike gets a suffix array, and windows it finds earlier
    in the chunk go.  Of the runs left, only places and hashes are sent.
 3. Runs whose hash occurs at several places send their bytes, dealt by it.
 4. Bounded chunks of these get a suffix array by two-stage sorting, and
    neighbours whose common prefix reaches ``width`` are repeats.
 5. Spans meet their documents again and the bytes are cut.

Hashes only choose what is compared: every removal comes from common prefixes
in a suffix array over bytes, so colliding hashes cost time, never a byte.

Null text counts as empty.  A row with null doc_id is compared with nothing
and kept whole.  Repeated rows of a document are one place and give repeated
results; where one doc_id has several texts, what repeats at a place of one
of them goes from that place of all.  Very long texts are read in pieces.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegate.llm import _base, _bytes
from tidegate.llm._bytes import U64

#: Bytes of the k-gram that places a window, and the longest piece of a text read at once.
K, PIECE = 20, 1 << 20
#: Runs whose repeats a task settles at once, runs it holds before it deals them out, bytes of a suffix array's text, bytes a task holds to compare.
LOCAL_RUNS, FLUSH_RUNS, CHUNK, HELD = 64_000, 500_000, 1 << 20, 64 << 20
#: Contents from which a minimizer counts as frequent, contents in a task's batch from which it is counted, minimizers so treated (results depend on none of them), windows of a finer cut.
FREQUENT, COUNTED, MOST_FREQUENT, FINE = 1000, 4, 1 << 16, 3


def two_stage(text: np.ndarray, depth: int, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of ``text`` (separators are 0) by its first ``depth`` bytes at least, and the ranks of 16-byte blocks.

    Suffixes smaller than their successors are sorted directly, block by
    block; the others are induced by scanning the buckets of first bytes in
    ascending order, each scan a few array operations.  Of the suffixes that
    are not ``wanted`` only those that wanted ones are induced from take part.
    """
    n = len(text)
    pad = np.zeros(n + 40, np.uint8)
    pad[:n] = text
    key = np.empty(n + 16, U64)
    for j in range(8):  # eight bytes from each place on
        own = key[j::8]
        own[:] = np.frombuffer(pad, ">u8", len(own), j)
    r8 = _dense(key)
    block = np.zeros(n + depth + 16, np.int32)
    block[:n] = _dense((r8[:n].astype(np.int64) << 32) | r8[8 : n + 8])
    # Which suffixes are smaller than their successors: by the next place where neighbours differ.
    nxt = np.append(text[1:], np.uint8(0))
    differ = np.flatnonzero(text != nxt)
    smaller = text[differ] < nxt[differ]
    direct = np.zeros(n, bool)
    direct[: differ[-1] + 1 if len(differ) else 0] = np.repeat(smaller, np.diff(differ, prepend=-1))
    direct |= text == 0
    part = np.ones(n, bool) if wanted is None else wanted.copy()
    new = np.flatnonzero(part & ~direct)
    while len(new):
        new = new[new + 1 < n] + 1
        new = new[~part[new]]
        part[new] = True
        new = new[~direct[new]]
    rest = part & ~direct
    pos = np.flatnonzero(direct & part).astype(np.int32)
    order = pos[np.argsort(block[pos])]
    group = _ranks(block[order])
    for at in range(16, depth, 16):
        tied = np.zeros(len(order), bool)
        same = group[1:] == group[:-1]
        tied[1:] |= same
        tied[:-1] |= same
        live = np.flatnonzero(tied)
        if not len(live):
            break
        k = (group[live].astype(np.int64) << 32) | block[order[live] + at]
        by = np.argsort(k)
        order[live] = order[live][by]
        k = k[by]
        new = np.ones(len(k), bool)
        new[1:] = k[1:] != k[:-1]
        head = np.flatnonzero(new)  # a tied group's members are renumbered by their places in the array
        group[live] = live[head][np.cumsum(new) - 1].astype(np.int32)
    # Induce the rest.
    first = text[order]
    size = np.bincount(text[part], minlength=256)
    begin = np.concatenate(([0], np.cumsum(size)))
    front = begin[:-1].copy()
    sa = np.empty(begin[-1], np.int32)
    cut = np.searchsorted(first, np.arange(257))
    for c in range(256):
        if not size[c]:
            continue
        own = order[cut[c] : cut[c + 1]]
        sa[begin[c + 1] - len(own) : begin[c + 1]] = own
        done = begin[c]
        while done < front[c]:  # a run of equal bytes grows its own bucket
            wave = sa[done : front[c]] - 1
            done = front[c]
            wave = wave[(wave >= 0)]
            wave = wave[(text[wave] == c) & rest[wave]]
            sa[front[c] : front[c] + len(wave)] = wave
            front[c] += len(wave)
        prev = sa[begin[c] : begin[c + 1]] - 1
        prev = prev[prev >= 0]
        ch = text[prev]
        ok = (ch > c) & rest[prev]
        prev, ch = prev[ok], ch[ok]
        by = np.argsort(ch, kind="stable")
        prev, ch = prev[by], ch[by]
        many = np.bincount(ch, minlength=256)
        off = np.concatenate(([0], np.cumsum(many)))[:-1]
        sa[front[ch] + np.arange(len(ch)) - off[ch]] = prev
        front += many
    return sa, block


def _dense(key: np.ndarray) -> np.ndarray:
    """The rank of each key among the distinct ones."""
    o = np.argsort(key)
    own = key[o]
    new = np.zeros(len(o), np.int32)
    new[1:] = own[1:] != own[:-1]
    out = np.empty(len(o), np.int32)
    out[o] = np.cumsum(new, dtype=np.int32)
    return out


def _ranks(sorted_keys: np.ndarray) -> np.ndarray:
    new = np.ones(len(sorted_keys), bool)
    new[1:] = sorted_keys[1:] != sorted_keys[:-1]
    return np.flatnonzero(new).astype(np.int32)[np.cumsum(new) - 1] if len(new) else np.zeros(0, np.int32)


def repeated_windows(segments: list[bytes], width: int) -> np.ndarray:
    """For segments in order of place: the positions, in their concatenation with one separator after each, of windows that occur earlier."""
    lens = np.fromiter(map(len, segments), np.int64, len(segments))
    text = np.frombuffer(b"\0".join(segments) + b"\0", np.uint8)
    if (text[: len(text) - 1] == 0).sum() >= len(segments):  # real zero bytes: shift the alphabet out of the separator's way
        return _repeated_with_zeros(segments, lens, width)
    return _repeated(text, lens, width)


def _repeated_with_zeros(segments, lens, width):
    """Zero bytes become 1 and ones 2; windows that then look equal are confirmed on the true bytes."""
    raw = b"\0".join(segments) + b"\0"
    text = np.frombuffer(raw, np.uint8).copy()
    seps = np.cumsum(lens + 1) - 1
    text[text < 255] += 1
    text[seps] = 0
    hit, first = _repeated(text, lens, width, with_first=True)
    if len(hit) and (np.frombuffer(raw, np.uint8) >= 254).any():
        seen: dict[bytes, int] = {}
        ends = np.cumsum(lens + 1)
        good = []
        for p in range(len(raw) - width + 1):
            if p + width <= ends[np.searchsorted(ends, p, side="right")] - 1 and seen.setdefault(raw[p : p + width], p) != p:
                good.append(p)
        return np.array(good, np.int64)
    return hit


def _repeated(text, lens, width, with_first=False):
    wins = np.maximum(lens - width + 1, 0)  # every segment: so many places where a window begins, then the rest and a separator
    ok = np.repeat(np.tile(np.array([True, False]), len(lens)), np.stack((wins, lens + 1 - wins), 1).ravel())
    sa, block = two_stage(text, width + 12, ok)
    sa = sa[ok[sa]]
    if not len(sa):
        return (sa, sa) if with_first else sa
    a, b = sa[:-1], sa[1:]
    same = np.ones(len(a), bool)  # the common prefix of neighbours reaches the width
    for at in [*range(0, width - 16, 16), width - 16]:
        same &= block[a + at] == block[b + at]
    head = np.flatnonzero(np.concatenate(([True], ~same)))
    least = np.minimum.reduceat(sa, head)
    least = np.repeat(least, np.diff(np.append(head, len(sa))))
    gone = sa != least
    hit = sa[gone]
    by = np.argsort(hit)
    hit = hit[by].astype(np.int64)
    return (hit, least[gone][by].astype(np.int64)) if with_first else hit


_DEALT = "bucket int, doc_id long, span long, blob binary"
_SENT = pa.schema([("bucket", pa.int32()), ("doc_id", pa.int64()), ("span", pa.int64()), ("blob", pa.binary())])
_FOUND = pa.schema([("doc_id", pa.int64()), ("span", pa.int64())])
_WANTED = pa.schema([("doc_id", pa.int64()), ("span", pa.int64()), ("anchor", pa.int64())])
#: A span is start << 24 | length, lengths below 2**24.
_BITS = 24


def _spans(doc, ws, ln):
    """Adjacent or overlapping spans merged; (doc, packed span)."""
    o = np.lexsort((ws, doc))
    doc, s, e = doc[o], ws[o], ws[o] + ln[o]
    if not len(o):
        return doc, s
    out_d, out_s = [], []
    _, g = np.unique(doc, return_inverse=True)
    base = g.astype(np.int64) << 40
    reach = np.maximum.accumulate(base + e)
    new = np.ones(len(o), bool)
    new[1:] = base[1:] + s[1:] > reach[:-1]
    h = np.flatnonzero(new)
    d, s, e = doc[h], s[h], reach[np.append(h[1:], len(o)) - 1] - base[h]
    limit = (1 << _BITS) - 1
    while len(d):  # very long spans travel in pieces
        ln = np.minimum(e - s, limit)
        out_d.append(d)
        out_s.append((s << _BITS) | ln)
        more = e - s > limit
        d, s, e = d[more], s[more] + ln[more], e[more]
    return np.concatenate(out_d), np.concatenate(out_s)


def _rows(doc, span, bucket=0):
    n = len(doc)
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, bucket, np.int32)), pa.array(doc), pa.array(span), pa.nulls(n, pa.binary())], schema=_SENT)


def _packed(*cols: np.ndarray) -> bytes:
    """Columns of numbers, low bytes first and each byte's place together, compressed."""
    n = len(cols[0])
    raw = np.array([n], "<i8").tobytes() + b"".join(np.ascontiguousarray(c).view(np.uint8).reshape(n, -1).T.tobytes() for c in cols)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpacked(blob: bytes, kinds: list[str]) -> list[np.ndarray]:
    raw = pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True)
    n, at, out = int.from_bytes(raw[:8], "little"), 8, []
    for k in map(np.dtype, kinds):
        cut = np.frombuffer(raw, np.uint8, n * k.itemsize, at).reshape(k.itemsize, n)
        out.append(np.ascontiguousarray(cut.T).view(k).ravel())
        at += n * k.itemsize
    return out


def _texts(batches, width: int):
    """(document ids, where each text begins in its document, bytes, offsets) of a few documents, or of a piece of a very long one; pieces overlap by width - 1 bytes, so each window is in one."""
    for part in _bytes.slices(batches, 1 << 19):
        buf, offs = _bytes.buffers(part.column(1))
        ids = part.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        if len(buf) <= PIECE:
            yield ids, np.zeros(len(ids), np.int64), buf, offs
            continue
        for i in range(len(ids)):
            own = buf[offs[i] : offs[i + 1]]
            for at in range(0, max(1, len(own) - width + 1), PIECE):
                piece = own[at : at + PIECE + width - 1]
                yield ids[i : i + 1], np.array([at]), piece, np.array([0, len(piece)])


def _frequent(width: int):
    """(anchor, contents) of the anchors with several contents in a batch of a task."""

    def run(batches):
        held, count = [], 0

        def counted():
            anchor, content = (np.concatenate(x) for x in zip(*held, strict=True))
            o = np.lexsort((content, anchor))
            anchor, content = anchor[o], content[o]
            new = np.ones(len(o), bool)
            new[1:] = (anchor[1:] != anchor[:-1]) | (content[1:] != content[:-1])
            own, many = np.unique(anchor[new], return_counts=True)
            keep = many >= COUNTED
            return pa.RecordBatch.from_arrays([pa.array(own[keep].view(np.int64)), pa.array(many[keep])], names=["anchor", "contents"])

        for _, _, buf, offs in _texts(batches, width):
            pre = _bytes.prefix_hash(buf)
            _, a, b, h, _ = _bytes.anchor_runs(buf, offs, width, K, pre)
            held.append((h, _bytes.span_hash(pre, a, b + width)))
            count += len(h)
            if count >= FLUSH_RUNS // 2:
                yield counted()
                held, count = [], 0
        if held:
            yield counted()

    return run


def frequent_anchors(ids: DataFrame, width: int, most: int) -> np.ndarray:
    """Sorted hashes of the anchors with the most contents, from ``FREQUENT`` on; ``most`` bounds what is held, not what is compared."""
    many = ids.mapInArrow(_frequent(width), "anchor long, contents long").groupBy("anchor").agg(F.sum("contents").alias("contents"))
    got = many.where(F.col("contents") >= FREQUENT).orderBy(F.desc("contents"), "anchor").limit(most).select("anchor").collect()
    return np.sort(np.array([r.anchor for r in got], np.int64).view(U64))


def _finer(pre, width: int, d, a, b, h, place, hot):
    """Runs of the frequent anchors cut by the anchor's place in the window, each keyed by the bytes common to the windows of its cut."""
    is_hot = hot[np.minimum(np.searchsorted(hot, h), len(hot) - 1)] == h if len(hot) else np.zeros(len(h), bool)
    if not is_hot.any():
        return d, a, b, h
    x = np.flatnonzero(is_hot)
    low, high = (place[x] - b[x]) // FINE, (place[x] - a[x]) // FINE  # cuts from the last window to the first
    many = high - low + 1
    x = np.repeat(x, many)
    cut = np.repeat(low, many) + np.arange(len(x)) - np.repeat(np.cumsum(many) - many, many)
    first = np.maximum(a[x], place[x] - cut * FINE - FINE + 1)
    last = np.minimum(b[x], place[x] - cut * FINE)
    core = place[x] - cut * FINE
    key = _bytes.span_hash(pre, core, core + width - FINE + 1)
    key = _bytes.mix(key + (cut + 1).astype(U64))
    rest = ~is_hot
    return tuple(np.concatenate((p, q)) for p, q in ((d[rest], d[x]), (a[rest], first), (b[rest], last), (h[rest], key)))


def _settled(texts, width: int):
    """What repeats inside one chunk of texts: (document, span) that go, and (anchor, document, first window, windows) of the runs that don't go whole."""
    base = np.cumsum([0, *(len(t[2]) for t in texts)])
    buf = np.concatenate([t[2] for t in texts])
    row, a, b, h, content = (np.concatenate(x) for x in zip(*(t[4] for t in texts), strict=True))
    many = np.array([len(t[0]) for t in texts])
    shift = np.repeat(base[:-1], [len(t[4][0]) for t in texts])
    row += np.repeat(np.cumsum(many) - many, [len(t[4][0]) for t in texts])
    ids = np.concatenate([t[0] for t in texts])
    origin = np.concatenate([t[1] - t[3][:-1] - x for t, x in zip(texts, base, strict=False)])  # from the buffer to the document
    a, b = a + shift, b + shift
    doc, ws = ids[row], a + origin[row]
    if len(np.unique(ids)) < len(ids):  # repeated rows: a place stands once
        o = np.lexsort((content, b - a, ws, doc))
        new = np.ones(len(o), bool)
        for k, x in enumerate((content, b - a, ws, doc)):
            new[1:] = (x[o][1:] != x[o][:-1]) | (new[1:] if k else False)
        o = np.sort(o[new])
        row, a, b, h, content, doc, ws = (x[o] for x in (row, a, b, h, content, doc, ws))
    o = np.argsort(content)
    same = content[o][1:] == content[o][:-1]
    alike = np.zeros(len(o), bool)
    alike[o[1:][same]] = alike[o[:-1][same]] = True
    x = np.flatnonzero(alike)
    if not len(x):
        return doc[:0], ws[:0], (h, doc, ws, b - a + 1)
    x = x[np.lexsort((a[x], row[x]))]
    # Runs of one text that touch are one segment.
    reach = np.maximum.accumulate(b[x] + width)
    new = np.ones(len(x), bool)
    new[1:] = (row[x][1:] != row[x][:-1]) | (a[x][1:] >= reach[:-1])
    head = np.flatnonzero(new)
    seg_row, seg_a, seg_e = row[x][head], a[x][head], reach[np.append(head[1:], len(x)) - 1]
    o = np.lexsort((seg_a + origin[seg_row], ids[seg_row]))
    seg_row, seg_a, seg_e = seg_row[o], seg_a[o], seg_e[o]
    hit = repeated_windows([buf[p:q].tobytes() for p, q in zip(seg_a.tolist(), seg_e.tolist(), strict=True)], width)
    begin = np.cumsum(seg_e - seg_a + 1) - (seg_e - seg_a + 1)
    seg = np.searchsorted(begin, hit, side="right") - 1
    at = seg_a[seg] + hit - begin[seg]
    gone = np.zeros(len(buf) + 1, np.int64)
    gone[at + 1] = 1
    gone = np.cumsum(gone)
    left = gone[b + 1] - gone[a] < b - a + 1
    d, sp = _spans(ids[seg_row][seg], at + origin[seg_row][seg], np.full(len(at), width))
    return d, sp, tuple(v[left] for v in (h, doc, ws, b - a + 1))


_ENTRY = ["<u8", "<i8", "<u4", "<u2"]


def _deal(width: int, buckets: int, hot: np.ndarray):
    def run(batches):
        held, count = [], 0
        texts, runs = [], 0

        def settle():
            d, sp, rest = _settled(texts, width)
            if len(d):
                yield _rows(d, sp, int(d[0] % buckets))
            held.append(rest)

        def deal():
            h, doc, ws, wl = (np.concatenate(x) for x in zip(*held, strict=True))
            b = (_bytes.mix(h.copy()) % U64(buckets)).astype(np.int32)
            o = np.argsort(b, kind="stable")
            b, h, doc, ws, wl = b[o], h[o] >> U64(16), doc[o], ws[o].astype("<u4"), wl[o].astype("<u2")
            cut = np.flatnonzero(np.concatenate(([True], b[1:] != b[:-1]))) if len(b) else np.zeros(0, np.int64)
            blobs = [_packed(h[x:y], doc[x:y], ws[x:y], wl[x:y]) for x, y in zip(cut, np.append(cut[1:], len(b)), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(b[cut]), pa.nulls(len(cut), pa.int64()), pa.nulls(len(cut), pa.int64()), pa.array(blobs, pa.binary())], schema=_SENT)

        for ids, begins, buf, offs in _texts(batches, width):
            pre = _bytes.prefix_hash(buf)
            d, a, b, h = _finer(pre, width, *_bytes.anchor_runs(buf, offs, width, K, pre), hot)
            if not len(d):
                continue
            texts.append((ids, begins, buf, offs, (d, a, b, h, _bytes.span_hash(pre, a, b + width))))
            runs += len(d)
            if runs >= LOCAL_RUNS:
                yield from settle()
                count, texts, runs = count + runs, [], 0
                if count >= FLUSH_RUNS:
                    yield from deal()
                    held, count = [], 0
        if texts:
            yield from settle()
        if held:
            yield from deal()
        held, texts = [], []
        _bytes.give_back()

    return run


def _meet():
    """One part of the anchors: (doc_id, span = start << 24 | windows, anchor) of runs whose anchor is at several places; other rows pass."""

    def run(batches):
        held, count, room, known = [], 0, 6 * FLUSH_RUNS, np.zeros(0, U64)

        def told(doc, span, anchor):
            for x in range(0, len(doc), 100_000):
                y = slice(x, x + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(doc[y]), pa.array(span[y]), pa.array(anchor[y].view(np.int64))], schema=_WANTED)

        def several():
            nonlocal held, known
            anchor, doc, ws, wl = (np.concatenate(x) for x in zip(*held, strict=True))
            o = np.lexsort((wl, ws, doc, anchor))
            anchor, doc, ws, wl = anchor[o], doc[o], ws[o], wl[o]
            new = np.ones(len(o), bool)  # repeated rows of a document are one place
            new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1]) | (ws[1:] != ws[:-1]) | (wl[1:] != wl[:-1])
            anchor, doc, ws, wl = anchor[new], doc[new], ws[new], wl[new]
            more = np.zeros(len(anchor), bool)
            more[1:] = anchor[1:] == anchor[:-1]
            more[:-1] |= more[1:]
            more |= np.isin(anchor, known)
            known = np.union1d(known, anchor[more])
            held = [tuple(x[~more] for x in (anchor, doc, ws, wl))]
            yield from told(doc[more], (ws[more].astype(np.int64) << _BITS) | wl[more], anchor[more])

        for t in batches:
            plain = t.filter(t.column("blob").is_null())
            if plain.num_rows:
                yield pa.RecordBatch.from_arrays([plain.column("doc_id"), plain.column("span"), pa.nulls(plain.num_rows, pa.int64())], schema=_WANTED)
            for blob in t.column("blob").drop_null():
                cols = _unpacked(blob.as_py(), _ENTRY)
                held.append(cols)
                count += len(cols[0])
                if count >= room:  # only anchors stay that have been at one place so far
                    yield from several()
                    count = len(held[0][0])
                    room = max(room, 2 * count)
        if held:
            yield from several()
        held = []
        _bytes.give_back()

    return run


def _cut(width: int, buckets: int):
    """The bytes of the runs that need comparing, packed by bucket of their anchors."""

    def run(batches):
        held, size = [], 0

        def deal():
            anchor, doc, start, ln = (np.concatenate([h[k] for h in held]) for k in range(4))
            body = b"".join(h[4] for h in held)
            at = np.concatenate([h[5] + x for h, x in zip(held, np.cumsum([0, *(len(h[4]) for h in held)]), strict=False)])
            b = (_bytes.mix(anchor.view(U64) + U64(1)) % U64(buckets)).astype(np.int32)
            o = np.lexsort((anchor, b))
            b, anchor, doc, start, ln, at = b[o], anchor[o], doc[o], start[o].astype("<u4"), ln[o].astype("<u4"), at[o]
            cut = np.flatnonzero(np.concatenate(([True], b[1:] != b[:-1])))
            blobs = []
            for x, y in zip(cut.tolist(), [*cut[1:].tolist(), len(b)], strict=True):
                head = _packed(anchor[x:y], doc[x:y], start[x:y], ln[x:y])
                raw = b"".join([body[p : p + n] for p, n in zip(at[x:y].tolist(), ln[x:y].tolist(), strict=True)])
                blobs.append(len(head).to_bytes(4, "little") + head + len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True))
            return pa.RecordBatch.from_arrays([pa.array(b[cut]), pa.array(blobs, pa.binary())], names=["bucket", "blob"])

        for t in batches:
            buf, offs = _bytes.buffers(t.column(1))
            runs = t.column(2)
            each = np.diff(np.asarray(runs.offsets))
            flat = runs.flatten()
            span, anchor = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(2))
            row = np.repeat(np.arange(len(each)), each)
            start, ln = span >> _BITS, (span & ((1 << _BITS) - 1)) + width - 1
            ln = np.clip(np.minimum(ln, np.diff(offs)[row] - start), 0, None)  # several texts of one doc_id
            held.append((anchor, t.column(0).to_numpy(zero_copy_only=False)[row], start, ln, buf.tobytes(), offs[row] + start))
            size += int(ln.sum()) + len(buf)
            if size >= FLUSH_RUNS << 5:
                yield deal()
                held, size = [], 0
        if held:
            yield deal()
        held = []
        _bytes.give_back()

    return run


def _compare(width: int):
    """Suffix arrays over chunks of whole anchors.  Beyond ``HELD`` bytes a task compares what it has, and of each anchor keeps the segments with a window that is not gone yet."""

    def run(batches):
        held, size, limit = [], 0, HELD

        def settle():
            nonlocal held, size
            anchor, doc, start, ln = (np.concatenate(x) for x in zip(*(h[:4] for h in held), strict=True))
            body = b"".join(h[4] for h in held)
            at = np.cumsum(ln.astype(np.int64)) - ln
            held, size = [], 0
            o = np.lexsort((ln, start, doc, anchor))
            new = np.ones(len(o), bool)  # repeated rows of a document
            new[1:] = (anchor[o][1:] != anchor[o][:-1]) | (doc[o][1:] != doc[o][:-1]) | (start[o][1:] != start[o][:-1]) | (ln[o][1:] != ln[o][:-1])
            o = o[new]
            anchor, doc, start, ln, at = anchor[o], doc[o], start[o].astype(np.int64), ln[o].astype(np.int64), at[o]
            head = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
            tail = np.append(head[1:], len(anchor))
            upto = np.cumsum(ln)
            left, x = [], 0
            while x < len(head):  # whole anchors, about a chunk of bytes
                y = max(x + 1, int(np.searchsorted(upto[tail - 1], upto[head[x]] - ln[head[x]] + CHUNK)))
                rows = np.arange(head[x], tail[y - 1])
                rows = rows[np.lexsort((start[rows], doc[rows]))]
                segs = [body[p : p + n] for p, n in zip(at[rows].tolist(), ln[rows].tolist(), strict=True)]
                x = y
                hit = repeated_windows(segs, width)
                begin = np.cumsum(ln[rows] + 1) - (ln[rows] + 1)
                seg = np.searchsorted(begin, hit, side="right") - 1
                d, sp = _spans(doc[rows][seg], start[rows][seg] + hit - begin[seg], np.full(len(hit), width))
                yield pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(sp, pa.int64())], schema=_FOUND)
                left.append(rows[np.bincount(seg, minlength=len(rows)) < ln[rows] - width + 1])
            left = np.concatenate(left)
            held = [(anchor[left], doc[left], start[left], ln[left], b"".join(body[p : p + n] for p, n in zip(at[left].tolist(), ln[left].tolist(), strict=True)))]
            size = int(ln[left].sum())

        for t in batches:
            for blob in t.column(1):
                raw = blob.as_py()
                n = 4 + int.from_bytes(raw[:4], "little")
                body = pa.decompress(raw[n + 8 :], int.from_bytes(raw[n : n + 8], "little"), codec="zstd", asbytes=True)
                held.append((*_unpacked(raw[4:n], ["<i8", "<i8", "<u4", "<u4"]), body))
                size += len(body)
                if size >= limit:
                    yield from settle()
                    limit = max(HELD, 2 * size)
        if held:
            yield from settle()
        held = []
        _bytes.give_back()

    return run


def _remove(batches):
    limit = (1 << _BITS) - 1
    for t in batches:
        n_bytes, n_removed, n_spans, kept = [], [], [], []
        for text, spans in zip(t.column(1), t.column(2).to_pylist(), strict=True):
            raw = text.as_buffer().to_pybytes() if text.is_valid else b""
            n_bytes.append(len(raw))
            if not spans:
                n_removed.append(0)
                n_spans.append(0)
                kept.append(raw)
                continue
            x = np.array(sorted(spans), np.int64)
            s, e = x >> _BITS, (x >> _BITS) + (x & limit)
            reach = np.maximum.accumulate(e)
            new = np.ones(len(x), bool)
            new[1:] = s[1:] > reach[:-1]
            h = np.flatnonzero(new)
            s, e = s[h], reach[np.append(h[1:], len(x)) - 1]
            n_removed.append(int((e - s).sum()))
            n_spans.append(len(s))
            kept.append(b"".join(raw[p:q] for p, q in zip([0, *e], [*s, len(raw)], strict=True)))
        digest = [hashlib.sha256(k).hexdigest() for k in kept]
        yield pa.RecordBatch.from_arrays([t.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(digest, pa.string()), pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string())], names=["__row", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"])


def removed_spans(docs: DataFrame, width: int = 100) -> DataFrame:
    """(doc_id, spans) of all bytes that go; spans may overlap."""
    spark = docs.sparkSession
    _base.ready(spark)
    ids = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    total = _base.text_bytes(ids)
    tasks = _base.tasks_for(spark, total)
    long = ids.where(F.octet_length("text") >= width)
    # Several buckets a task even out their hashes.
    meeting = _base.parts_for(total, 16 << 20, 2)
    dealt = long.mapInArrow(_deal(width, 4 * meeting, frequent_anchors(long, width, MOST_FREQUENT)), _DEALT)
    met = _base.staged(dealt.repartition(meeting, "bucket").mapInArrow(_meet(), "doc_id long, span long, anchor long"), "repeats", tasks)
    # Texts meet by document in tasks of bounded bytes.
    need = met.where("anchor is not null").repartition(tasks, "doc_id").groupBy("doc_id").agg(F.collect_list(F.struct("span", "anchor")).alias("runs"))
    parts = _base.parts_for(total, 24 << 20, spark.sparkContext.defaultParallelism)
    cut = long.repartition(tasks, "doc_id").join(need.hint("shuffle_hash"), "doc_id").select("doc_id", "text", "runs").mapInArrow(_cut(width, 4 * parts), "bucket int, blob binary")
    found = cut.repartition(parts, "bucket").mapInArrow(_compare(width), "doc_id long, span long")
    spans = met.where("anchor is null").select("doc_id", "span").union(found)
    out = _base.staged(spans.groupBy("doc_id").agg(F.collect_list("span").alias("spans")), "spans", tasks)
    _base.drop_staged(met)
    return out


def suffix_dedup(docs: DataFrame, width: int = 100) -> DataFrame:
    """Every row of ``docs`` as struct ``__row`` beside n_bytes, n_removed, n_spans, kept_sha256 and kept_text.

    kept_sha256 is over the exact remaining bytes; kept_text leaves out what
    is no longer valid UTF-8 where a cut went through a character.
    """
    tasks = _base.tasks_for(docs.sparkSession, _base.text_bytes(docs))
    spans = removed_spans(docs, width).withColumnRenamed("doc_id", "__id").repartition(tasks, "__id")
    rows = _base.carried(docs, {"__id": F.col("doc_id").cast("long"), "__text": F.col("text")})
    known = rows.where("__id is not null").repartition(tasks, "__id").join(spans, "__id", "left").select("__row", "__text", "spans")
    # Rows without an id have no spans and need not meet anything.
    alone = rows.where("__id is null").select("__row", "__text", F.lit(None).cast("array<bigint>").alias("spans"))
    row = docs.schema.simpleString()
    return known.union(alone).mapInArrow(_remove, f"__row {row}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string")
