"""Vectorised kernels over UTF-8 buffers: rolling hashes, word shingles, minimizers.

All hashing is arithmetic modulo 2**64 on numpy arrays; nothing depends on
process-local hash seeds, so every executor computes the same values.
"""

from __future__ import annotations

import ctypes
import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_ODD = 0x9E3779B97F4A7C15
_tables: dict[str, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser that spreads every input bit over the word."""
    h = h ^ (h >> U64(32))
    h = h * U64(0xD6E8FEB86659FD93)
    h ^= h >> U64(29)
    h *= U64(0xCA9B0C7EBA1DA115)
    h ^= h >> U64(32)
    return h


def _powers(name: str, base: int, n: int) -> np.ndarray:
    got = _tables.get(name)
    if got is None or len(got) < n:
        seq = np.full(max(n, 1 << 16), base, U64)
        seq[0] = 1
        got = _tables[name] = np.multiply.accumulate(seq)
    return got[:n]


def _letters() -> np.ndarray:
    if "letters" not in _tables:
        _tables["letters"] = mix(np.arange(1, 257, dtype=U64) * U64(_ODD))
    return _tables["letters"]


def prefix_hash(buf: np.ndarray) -> np.ndarray:
    """C with C[e] - C[s] = sum of letter(b[i]) * ODD**i for s <= i < e."""
    out = np.zeros(len(buf) + 1, U64)
    np.cumsum(_letters()[buf] * _powers("up", _ODD, len(buf)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Position-independent 64-bit hashes of the spans [start, end)."""
    down = _powers("down", pow(_ODD, -1, 1 << 64), len(prefix))
    return mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(U64))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, document offsets) of a string array; nulls count as empty."""
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    _, offs, data = texts.buffers()
    offs = np.frombuffer(offs, np.int64, len(texts) + 1, texts.offset * 8) if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def slices(batches, limit: int):
    """Record batches cut into runs of whole rows of about ``limit`` text bytes ('text' column)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index("text"))
        size = pc.binary_length(col).fill_null(0).to_numpy(zero_copy_only=False)
        part = np.cumsum(size) // limit
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield batch.slice(a, b - a)


def shingle_sets(texts: pa.Array, n: int = 5) -> list[np.ndarray]:
    """Per document, the sorted distinct hashes of its n-word shingles.

    Words are runs of non-white-space in the lower-cased text.  A document of
    1 to n-1 words has one shingle, all its words; one without words has none.
    """
    low = pc.utf8_lower(texts)
    buf, offs = buffers(low)
    ndoc = len(offs) - 1
    if not len(buf):
        return [np.zeros(0, U64)] * ndoc
    solid = buf > 32
    edge = np.zeros(len(buf) + 1, bool)
    edge[offs] = True
    before = np.concatenate(([False], solid[:-1]))
    after = np.concatenate((solid[1:], [False]))
    start = np.flatnonzero(solid & (~before | edge[:-1]))
    end = np.flatnonzero(solid & (~after | edge[1:])) + 1
    word = span_hash(prefix_hash(buf), start, end)
    first = np.searchsorted(start, offs)  # word index where each document begins
    nwin = len(word) - n + 1
    if nwin > 0:
        grams = np.zeros(nwin, U64)
        for j in range(n):
            grams = grams * U64(_ODD) + word[j : j + nwin]
        grams = mix(grams)
    out = []
    for d in range(ndoc):
        a, b = int(first[d]), int(first[d + 1])
        if b - a >= n:
            own = np.sort(grams[a : b - n + 1])
            keep = np.ones(len(own), bool)
            np.not_equal(own[1:], own[:-1], out=keep[1:])
            out.append(own[keep])
        elif b > a:
            h = np.zeros(1, U64) + U64(b - a)
            for w in word[a:b]:
                h = h * U64(_ODD) + w
            out.append(mix(h))
        else:
            out.append(np.zeros(0, U64))
    return out


def sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every run of ``width`` neighbours, by doubling."""
    got, have = v, 1
    while have * 2 <= width:
        got = np.minimum(got[:-have], got[have:])
        have *= 2
    rest = width - have
    return np.minimum(got[: len(got) - rest], got[rest:]) if rest else got


def anchor_runs(buf: np.ndarray, offs: np.ndarray, width: int, k: int, pre: np.ndarray | None = None):
    """Runs of neighbouring ``width``-byte windows that share a minimizer.

    Equal windows have their minimizer (least hashed k-gram, the leftmost of
    equals) at the same place inside, so equal windows always fall under equal
    anchor hashes.  ``pre`` is the buffer's prefix hash.  Returns (doc index, first window, last window, anchor hash,
    place of the anchor).
    """
    n = len(buf)
    none = np.zeros(0, np.int64)
    if n < width:
        return none, none, none, np.zeros(0, U64), none
    pre = prefix_hash(buf) if pre is None else pre
    at = np.arange(n - k + 1)
    full = span_hash(pre, at, at + k)
    bits = max(24, int(n).bit_length())
    low = U64((1 << bits) - 1)
    least = sliding_min((full & ~low) | at.astype(U64), width - k + 1)
    place = (least & low).astype(np.int64)  # one for each window start 0 .. n-width
    doc = np.searchsorted(offs, np.arange(n - width + 1), side="right") - 1
    valid = np.arange(n - width + 1) + width <= offs[doc + 1]
    w = np.flatnonzero(valid)
    if not len(w):
        return none, none, none, np.zeros(0, U64), none
    new = np.ones(len(w), bool)
    new[1:] = (place[w][1:] != place[w][:-1]) | (doc[w][1:] != doc[w][:-1])
    s = np.flatnonzero(new)
    e = np.append(s[1:], len(w)) - 1
    return doc[w[s]], w[s], w[e], full[place[w[s]]], place[w[s]]


def digest64(raw: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "little")


def give_back() -> None:
    """Freed memory goes back to the system (where the C library can), since idle workers keep what they have."""
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
