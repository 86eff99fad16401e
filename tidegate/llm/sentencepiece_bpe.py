"""Operator 6: exact SentencePiece BPE encoding and decoding by backtracking.

For each part of a text an Aho-Corasick pass lists the pieces that start at
every character.  The encoder takes the longest, checks it against the piece
before by merging the two pieces' characters anew, falls back to shorter
ones, and marks in a bitfield the places from which nothing leads on: since
a prefix has only one merge encoding, such a place never needs another look.

No piece holds a space mark after another character, so texts fall into
parts that start at runs of spaces; encoded parts are kept in a bounded cache.

Null text counts as empty (the end id alone).  Other columns stay as they are,
and repeated rows give repeated results.
"""

from __future__ import annotations

import functools
import re
from array import array
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegate.llm import _base, _bytes
from tidegate.llm.packing import LONGEST, Cache

MARK = "▁"


class BacktrackingBpe:
    def __init__(self, path: str, limit: int = 600_000):
        import ahocorasick
        import sentencepiece

        sp = self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.ids, self.score, self.piece = {}, {}, {}
        self.byte = [0] * 256
        trie = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for i in range(sp.vocab_size()):
            p = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte[int(p[3:5], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.ids[p], self.score[p], self.piece[i] = i, sp.get_score(i), p
                if len(p) > 1:
                    trie.add_word(p, i)
        trie.make_automaton()
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece spans a space after another character")
        self.size = [len(self.piece.get(i, "")) for i in range(sp.vocab_size())]
        self.single = {p: i for p, i in self.ids.items() if len(p) == 1}
        self.trie, self.pairs, self.limit, self.parts, self.words = trie, {}, limit, {}, Cache(self._word)
        self.from_byte = {i: b for b, i in enumerate(self.byte)}
        self.end = sp.eos_id()

    def merged(self, chars: str) -> list[str]:
        """The pieces that merging makes of a short string: best score first, leftmost of equals."""
        parts = list(chars)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def compatible(self, a: int, b: int) -> bool:
        x, y = self.piece[a], self.piece[b]
        got = self.pairs[a << 20 | b] = self.merged(x + y) == [x, y]
        return got

    def encode_part(self, part: str) -> list[int]:
        size, single = self.size, self.single
        known = True
        try:
            starts = [[single[c]] for c in part]
        except KeyError:
            known = False
            starts = [[single[c]] if c in single else [] for c in part]
        starts.append([])
        for last, i in self.trie.iter(part):
            starts[last + 1 - size[i]].append(i)  # shorter ones come first
        if known:
            return self._backtrack(starts, 0, len(part))
        out: list[int] = []
        begin = 0
        for at in range(len(part) + 1):  # characters without a piece stand alone, as bytes
            if at == len(part) or not starts[at] and part[at] not in self.ids:
                if at > begin:
                    out += self._backtrack(starts, begin, at)
                if at < len(part):
                    out += [self.byte[b] for b in part[at].encode()]
                begin = at + 1
        return out

    def _backtrack(self, starts, begin: int, end: int) -> list[int]:
        path: list[int] = []
        tried: list[int] = []  # index of the next shorter choice at each step
        size, pairs = self.size, self.pairs
        failed: dict[int, int] = {}  # a bit for each place from which nothing leads on, in words of 256
        pos, k = begin, len(starts[begin]) - 1
        while pos < end:
            here = starts[pos]
            while k >= 0:
                nxt = pos + size[here[k]]
                if nxt <= end and not (failed and failed.get(nxt >> 8, 0) >> (nxt & 255) & 1):
                    if not path:
                        break
                    ok = pairs.get(path[-1] << 20 | here[k])
                    if self.compatible(path[-1], here[k]) if ok is None else ok:
                        break
                k -= 1
            if k >= 0:
                path.append(here[k])
                tried.append(k - 1)
                pos = nxt
                k = len(starts[pos]) - 1
            else:
                failed[pos >> 8] = failed.get(pos >> 8, 0) | 1 << (pos & 255)
                pos -= size[path.pop()]
                k = tried.pop()
        return path

    def decode_bytes(self, ids) -> bytes:
        out = bytearray()
        for i in ids:
            if i in self.from_byte:
                out.append(self.from_byte[i])
            elif i in self.piece:
                out += self.piece[i].replace(MARK, " ").encode()
        return bytes(out)

    def decode(self, ids) -> str:
        """What the library's decode makes of ids: the first space of the text is the encoder's own."""
        text = self.decode_bytes(ids).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text

    def _part(self, part: str) -> bytes:
        got = self.parts.get(part)
        if got is None:
            got = np.array(self.encode_part(part), "<i4").tobytes()
            if len(part) <= LONGEST:
                self.parts[part] = got
        return got

    def _word(self, word: str) -> bytes:
        return array("i", self.encode_part(word if word[0] == "\n" else MARK + word)).tobytes()

    def encode(self, text: str) -> bytes:
        """Little-endian ids of one text, without the end id."""
        if len(self.parts) > self.limit:
            self.parts = dict(islice(self.parts.items(), self.limit // 2))  # frequent parts came first
        if len(self.pairs) > self.limit:
            self.pairs.clear()
        if not text:
            return b""
        # Mostly words after one space each; a part that starts with a line break has no space before it.
        if "  " in text or " \n" in text or MARK in text or text[0] in " \n" or text[-1] == " ":
            return b"".join(map(self._part, re.findall(f"{MARK}+[^{MARK}]*|[^{MARK}]+", MARK + text.replace(" ", MARK))))
        if len(self.words) > self.limit:
            self.words = Cache(self._word, islice(self.words.items(), self.limit * 3 // 4))
        return b"".join(map(self.words.__getitem__, text.replace("\n", " \n").split(" ")))


@functools.lru_cache(maxsize=1)
def _coder(path: str) -> BacktrackingBpe:
    """One per worker process, so that tasks after the first find its cache warm."""
    return BacktrackingBpe(path)


def _encode(path: str, end: bool):
    def run(batches):
        coder = _coder(path)
        tail = np.array([coder.end], "<i4").tobytes() if end else b""
        for t in _bytes.slices(batches, 1 << 20):
            raw = [coder.encode(x or "") + tail for x in t.column(1).to_pylist()]
            offs = np.concatenate(([0], np.cumsum([len(r) // 4 for r in raw]))).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offs), pa.array(np.frombuffer(b"".join(raw), "<i4")))
            yield pa.RecordBatch.from_arrays([t.column(0), ids], names=["__row", "ids"])

    return run


def _decode(path: str):
    def run(batches):
        coder = _coder(path)
        piece = [b""] * coder.library.vocab_size()
        for i, p in coder.piece.items():
            piece[i] = p.replace(MARK, " ").encode()
        for i, b in coder.from_byte.items():
            piece[i] = bytes([b])
        for t in batches:
            ids = t.column(1)
            flat, offs = ids.flatten().to_numpy(zero_copy_only=False).tolist(), np.asarray(ids.offsets) - (ids.offsets[0].as_py() if len(ids) else 0)
            text = []
            for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True):
                s = b"".join(map(piece.__getitem__, flat[a:b]))
                text.append((s[1:] if s[:1] == b" " else s).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([t.column(0), ids, pa.array(text, pa.string())], names=["__row", "ids", "decoded"])

    return run


def encode(docs: DataFrame, model: str, end: bool = True) -> DataFrame:
    """Every row as struct ``__row`` beside ids array<int>."""
    _base.ready(docs.sparkSession)
    tasks = _base.tasks_for(docs.sparkSession, _base.text_bytes(docs))
    rows = _base.carried(docs, {"text": F.col("text")}).coalesce(tasks)
    return rows.mapInArrow(_encode(model, end), f"__row {docs.schema.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """The rows of ``encode`` with a column decoded: the text the library's decode(ids) gives."""
    kind = encoded.schema["__row"].dataType.simpleString()
    return encoded.select("__row", "ids").mapInArrow(_decode(model), f"__row {kind}, ids array<int>, decoded string")
