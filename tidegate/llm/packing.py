"""Operator 3: best-fit packing of tokenized documents into sequences.

Bounded-space online best-fit: a fixed number of open sequences, found
through a bitset keyed by free space.  A piece goes where the least space
stays free; if it fits nowhere and all places are taken, the fullest closes.
Each task packs its own rows in their order, so nothing is shuffled; a task
holds one batch of texts and the free spaces of its open sequences.

Null text counts as empty (one piece, the end id alone).  Null or repeated
doc_ids are packed like any others.  Every row's pieces come back once.
"""

from __future__ import annotations

import functools
import json
import os
from array import array
from collections.abc import Iterable
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegate.llm import _base, _bytes


class UnsafeError(Exception):
    """A text that can't be encoded in parts."""


#: Longer parts are encoded anew each time: texts without spaces would otherwise fill the caches with themselves.
LONGEST = 64


class Cache(dict):
    """A dict that makes missing values by a function of the key, and keeps those of keys of at most ``LONGEST`` characters."""

    def __init__(self, make, items=()):
        super().__init__(items)
        self.make = make

    def __missing__(self, key):
        got = self.make(key)
        if len(key) <= LONGEST:
            self[key] = got
        return got


class WordEncoder:
    """Ids of whole texts by a byte-level BPE file of the tokenizers library, through a bounded cache of words.

    The file's pattern starts a pre-token at each single space (or line
    break) between two characters that are not white space, so the parts
    between are encoded one by one and remembered: by tiktoken over the
    file's own vocabulary (the same ids, several times faster on short
    strings) unless a special token's text may be inside.  Any other text
    goes to the tokenizers library whole, and so do all texts where the file
    has a normaliser or another pre-tokenizer than the byte-level one.
    """

    def __init__(self, path: str, limit: int = 250_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.limit, self.known = limit, Cache(self._part)
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        before = file.get("pre_tokenizer") or {}
        # The pattern of the byte-level pre-tokenizer is fixed in the library; what a file may change is looked at here.
        self.by_parts = not file.get("normalizer") and before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
        self.short = self._byte_level(file) if self.by_parts else None

    @staticmethod
    def _byte_level(file: dict):
        import public_tokenizers
        import tiktoken

        plain = [b for b in range(256) if chr(b).isprintable() and b not in (32, 173)]
        letter = {chr(b): b for b in plain}
        letter |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
        special = {t["content"] for t in file["added_tokens"]}
        ranks = {bytes(letter[c] for c in w): i for w, i in file["model"]["vocab"].items() if w not in special}
        made = {tuple(m) if isinstance(m, list) else tuple(m.split(" ")): k for k, m in enumerate(file["model"]["merges"])}
        order = [file["model"]["vocab"]["".join(m)] for m in made]
        if order != sorted(order):  # ids that don't follow the merges: the library does all
            return None
        return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _part(self, word: str) -> bytes:
        """Ids of the text between two single spaces; unsafe if white space at its ends could join what is beside it."""
        if not word or word[-1].isspace() or word[word[0] == "\n"].isspace():
            raise UnsafeError
        word = word if word[0] == "\n" else " " + word
        if self.short is None or "<|" in word:
            return self._whole([word])[0]
        return array("I", self.short.encode_ordinary(word)).tobytes()

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        if len(self.known) > self.limit:
            self.known = Cache(self._part, islice(self.known.items(), self.limit * 3 // 4))  # frequent words came first
        if not self.by_parts:
            return self._whole(texts)
        words = [t.replace("\n", " \n").split(" ") for t in texts]
        get = self.known.__getitem__
        out = []
        for text, w, head in zip(texts, words, self._whole([w[0] for w in words]), strict=True):
            try:
                if not w[0] or w[0][-1].isspace():
                    raise UnsafeError
                out.append(head + b"".join(map(get, w[1:])))
            except UnsafeError:
                out.append(self._whole([text])[0])
        return out


class BestFit:
    """Places for pieces, one after another."""

    def __init__(self, size: int, bins: int):
        self.size, self.bins = size, bins
        self.bits, self.open, self.count, self.next = 0, [[] for _ in range(size + 1)], 0, 0

    def place(self, length: int) -> tuple[int, int]:
        """(sequence, offset) of a piece of 1 to ``size`` tokens."""
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            seq = self._take(free)
        else:
            if self.count == self.bins:
                self._take((self.bits & -self.bits).bit_length() - 1)
            free, seq = self.size, self.next
            self.next += 1
        if free > length:
            self.open[free - length].append(seq)
            self.bits |= 1 << (free - length)
            self.count += 1
        return seq, self.size - free

    def _take(self, free: int) -> int:
        seq = self.open[free].pop()
        self.count -= 1
        if not self.open[free]:
            self.bits &= ~(1 << free)
        return seq


def pieces(total: int, size: int) -> Iterable[tuple[int, int]]:
    """(start, length) of a document's pieces: the first may be shorter, all others are full."""
    at = total % size or min(size, total)
    yield 0, at
    while at < total:
        yield at, size
        at += size


@functools.lru_cache(maxsize=1)
def _encoder(path: str, limit: int) -> WordEncoder:
    """One per worker process, so that tasks after the first find its cache warm."""
    return WordEncoder(path, limit)


def _pack(path: str, size: int, bins: int, end_id: int, cache_words: int):
    def run(batches):
        encoder, fit = _encoder(path, cache_words), BestFit(size, bins)
        own = TaskContext.get().partitionId() << 40
        tail = np.array([end_id], "<u4").tobytes()
        for t in _bytes.slices(batches, 1 << 20):
            cols: list[list] = [[] for _ in range(7)]
            for doc, ids in zip(t.column(0).to_pylist(), encoder.encode([x or "" for x in t.column(1).to_pylist()]), strict=True):
                ids += tail
                for k, (start, length) in enumerate(pieces(len(ids) // 4, size)):
                    seq, off = fit.place(length)
                    for c, v in zip(cols, (doc, k, start, length, ids[4 * start : 4 * (start + length)], own + seq, off), strict=True):
                        c.append(v)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids", "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer: str, size: int = 1024, bins: int = 1024, end_id: int = 2, cache_words: int = 250_000) -> DataFrame:
    """(doc_id, piece, start, length, ids, sequence_id, offset); ids are little-endian unsigned 32-bit.

    Small inputs are read by fewer tasks, since each task's last sequences stay part empty.
    """
    spark = docs.sparkSession
    _base.ready(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    tasks = _base.tasks_for(spark, _base.text_bytes(docs))
    return docs.coalesce(tasks).mapInArrow(_pack(tokenizer, size, bins, end_id, cache_words), "doc_id long, piece int, start long, length long, ids binary, sequence_id long, offset long")
