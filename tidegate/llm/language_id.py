"""Operator 4: language identification.

Averaged hashed subword embeddings with a linear softmax, trained by
stochastic gradient descent in numpy on a bounded sample of labelled rows.
As averaging is linear, embeddings and classifier fold into one table of
class scores per hash bucket, and a text of any length is scored by sums over
its bytes.  Scores are calibrated by a temperature on rows held back from
training.

A softmax always prefers some class, so rejection also asks how familiar a
text's subwords are: their mean log frequency in the training rows of all
classes.  A text is rejected if it is unfamiliar and not scored well either.
Both bounds go by the text's length and are calibrated on held-back rows and
their parts, which stay above the first, and on foreign texts: shuffled
letters, and each language scored by a model of the others.  ``Rejection``
tells which shares of these are kept and caught.

Subwords are runs of 2 to 4 bytes of the lower-cased text in which everything
but letters and bytes beyond ASCII reads as a word boundary.  A text that is
null or has no letter is ``und`` with score 0 and not accepted.  Only texts
are looked at: repeated rows get equal results, ties between classes go to the
first in order of names, and texts of any length are read whole.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegate.llm import _base, _bytes

UNKNOWN = "und"
_GRAMS = (2, 3, 4)
_SALT = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)


def _word_bytes() -> np.ndarray:
    table = np.full(256, 32, np.uint8)
    for b in range(256):
        if chr(b).isascii() and chr(b).isalpha() or b >= 128:
            table[b] = b
    return table


_TABLE = _word_bytes()


def _buckets(buf: np.ndarray, offs: np.ndarray, bits: int):
    """For each subword length: bucket and document of every subword inside one document."""
    w = _TABLE[buf].astype(np.uint32)
    for n, salt in zip(_GRAMS, _SALT, strict=True):
        m = len(w) - n + 1
        if m <= 0:
            continue
        v = np.zeros(m, np.uint32)
        for j in range(n):
            v = (v << np.uint32(8)) | w[j : j + m]
        h = v * np.uint32(salt)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        h >>= np.uint32(32 - bits)
        ok = (w[:m] != 32) | (w[1 : m + 1] != 32)
        for c in offs[1:-1]:  # subwords across document borders count for neither
            ok[max(0, c - n + 1) : c] = False
        yield h, ok


@dataclass
class Rejection:
    """Shares of calibration texts: of known languages kept, and of shuffled and left-out ones caught."""

    kept: float = 1.0
    shuffled_caught: float = 0.0
    left_out_caught: float = 0.0


#: Subwords up to which a floor of familiarity holds; the last holds for all longer texts.
_LENGTHS = (16, 64, 256, 1024, 1 << 62)


@dataclass
class LanguageModel:
    langs: list[str]
    scores: np.ndarray  # one row per bucket: class scores, and the log frequency in training
    bias: np.ndarray
    temperature: float
    reject_below: float
    bits: int
    floors: np.ndarray = field(default_factory=lambda: np.full(len(_LENGTHS), -np.inf))  # least familiarity, by number of subwords
    sure: np.ndarray = field(default_factory=lambda: np.zeros(len(_LENGTHS)))  # scores from which an unfamiliar text is kept
    rejection: Rejection = field(default_factory=Rejection)

    def sums(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Mean class scores and log frequency per document, and its number of subwords."""
        ndoc, k = len(offs) - 1, len(self.langs) + 1
        total, count = np.zeros((ndoc, k)), np.zeros(ndoc)
        at = np.minimum(offs[:-1], max(len(buf) - 1, 0))
        full = offs[1:] > offs[:-1]
        for h, ok in _buckets(buf, offs, self.bits):
            pad = len(buf) - len(h)
            one = np.concatenate((ok, np.zeros(pad, bool)))
            count += np.where(full, np.add.reduceat(one.astype(np.int64), at), 0)
            for c in range(k):
                v = self.scores[:, c][h]
                v[~ok] = 0
                v = np.concatenate((v, np.zeros(pad, v.dtype)))
                total[:, c] += np.where(full, np.add.reduceat(v, at, dtype=np.float64), 0)
        return total / np.maximum(count, 1)[:, None], count

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and acceptance of each text."""
        buf, offs = _bytes.buffers(pc.utf8_lower(texts))
        mean, count = np.zeros((len(offs) - 1, len(self.langs) + 1)), np.zeros(len(offs) - 1)
        if len(buf):
            mean, count = self.sums(buf, offs)
        z = (mean[:, :-1] + self.bias) * self.temperature
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        best = p.argmax(axis=1)
        score = p[np.arange(len(p)), best]
        lang = [self.langs[b] for b in best]
        ascii_letter = np.concatenate(([0], np.cumsum((_TABLE[buf] != 32) & (buf < 128))))
        for d in np.flatnonzero(ascii_letter[offs[1:]] == ascii_letter[offs[:-1]]):
            if not any(c.isalpha() for c in bytes(buf[offs[d] : offs[d + 1]]).decode("utf-8", "ignore")):
                lang[d], score[d] = UNKNOWN, 0.0
        size = np.searchsorted(_LENGTHS, count)
        known = (mean[:, -1] >= self.floors[size]) | (score >= self.sure[size])
        return lang, score, (score >= self.reject_below) & known & (score > 0)


def _subwords(text: str, bits: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(buckets, their shares of the text, number of subwords)."""
    buf, offs = _bytes.buffers(pa.array([text.lower()]))
    hs = [h[ok] for h, ok in _buckets(buf, offs, bits)]
    u, c = np.unique(np.concatenate(hs) if hs else np.zeros(0, np.uint32), return_counts=True)
    return u, (c / max(1, c.sum())).astype(np.float32), int(c.sum())


def _frequencies(fit, classes, bits: int) -> np.ndarray:
    """Log of each bucket's mean share in the texts of each class, classes weighing the same; unseen ones count as a tenth of the rarest."""
    per = []
    for c in classes:
        own = [d for d in fit if d[2] == c]
        share = np.zeros(1 << bits)
        for u, w, _ in own:
            share[u] += w / len(own)
        per.append(share)
    mean = np.mean(per, axis=0) if per else np.zeros(1 << bits)
    return np.log(np.maximum(mean, 0.1 * mean[mean > 0].min() if (mean > 0).any() else 1.0)).astype(np.float32)


def _parts(text: str, rng) -> list[str]:
    """The text and runs of its words of several lengths."""
    words = text.split()
    out = [text]
    for n in (3, 10, 30, 100):
        if len(words) > n:
            at = int(rng.integers(0, len(words) - n))
            out.append(" ".join(words[at : at + n]))
    return out


def _descend(data, k: int, bits: int, dim: int, epochs: int, rate: float, rng) -> tuple[np.ndarray, np.ndarray]:
    """(class scores by bucket, bias) after stochastic gradient descent over (buckets, shares, class)."""
    emb = (rng.standard_normal((1 << bits, dim)) * 0.1).astype(np.float32)
    out, bias = np.zeros((dim, k), np.float32), np.zeros(k, np.float32)
    for epoch in range(epochs):
        lr = rate * (1 - epoch / epochs)
        for i in rng.permutation(len(data)):
            u, w, y = data[i]
            e = emb[u]
            x = w @ e
            z = x @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            gx = out @ p
            out -= lr * np.outer(x, p)
            bias -= 0.1 * lr * p
            emb[u] = e - (lr * 20) * w[:, None] * gx
    return (emb @ out).astype(np.float32), bias.astype(np.float64)


def _calibrate(model: LanguageModel, fit, check: list[tuple[str, int]], descend, rng) -> None:
    """Set the floors of familiarity and the scores that make up for it, by length, and tell what they keep and catch."""
    classes = sorted({y for *_, y in fit})

    def shown(texts, table, bias):
        """(length range, familiarity, score) of each text."""
        got = [(n, w @ table[u]) for u, w, n in (_subwords(t, model.bits) for t in texts) if n]
        z = np.array([x[:-1] + bias for _, x in got]).reshape(len(got), -1) * model.temperature
        p = np.exp(z - z.max(axis=1, keepdims=True)) if len(got) else z
        return np.searchsorted(_LENGTHS, [n for n, _ in got]), np.array([x[-1] for _, x in got]), p.max(axis=1, initial=0) / np.maximum(p.sum(axis=1), 1)

    known = shown([p for t, _ in check for p in _parts(t, rng)], model.scores, model.bias)
    foreign = {"shuffled_caught": [shown([p for t, _ in check for p in _parts("".join(rng.permutation(list(t))), rng)], model.scores, model.bias)], "left_out_caught": []}
    for c in classes if len(classes) > 2 else []:
        scores, bias = descend([d for d in fit if d[2] != c])
        rest = [x for x in classes if x != c]
        table = np.concatenate((scores[:, rest], _frequencies(fit, rest, model.bits)[:, None]), 1)
        foreign["left_out_caught"].append(shown([p for t, y in check if y == c for p in _parts(t, rng)], table, bias[rest]))
    every = [np.concatenate(x) for x in zip(*(x for k in foreign.values() for x in k), strict=True)]
    for i in range(len(_LENGTHS)):
        own, far = known[1][known[0] == i], every[1][every[0] == i]
        if len(own) < 50 or not len(far):  # with fewer, no text of that length is rejected for being unfamiliar
            continue
        low, high = float(own.min()), float(np.quantile(far, 0.95))
        model.floors[i] = (low + high) / 2 if high < low else low - 0.05 * (float(np.median(own)) - low)
        model.sure[i] = float(np.quantile(every[2][every[0] == i], 0.9))

    def kept(x):
        return (x[2] >= model.reject_below) & ((x[1] >= model.floors[x[0]]) | (x[2] >= model.sure[x[0]]))

    model.rejection = Rejection(*(float(v.mean()) if len(v) else 0.0 for v in (kept(known), *(~np.concatenate([kept(x) for x in k] or [np.zeros(0, bool)]) for k in foreign.values()))))


def train(rows: list[tuple[str, str]], bits: int = 16, dim: int = 16, epochs: int = 4, rate: float = 1.0, seed: int = 5) -> LanguageModel:
    """Fit on (text, lang) rows; every fifth row calibrates."""
    langs = sorted({lang for _, lang in rows}) or [UNKNOWN]
    rng = np.random.default_rng(seed)
    data, texts = [], []
    for text, lang in rows:
        u, w, n = _subwords(text, bits)
        if n:
            data.append((u, w, langs.index(lang)))
            texts.append((text, langs.index(lang)))
    fit = [d for i, d in enumerate(data) if i % 5] or data
    check = data[::5] or data
    scores, bias = _descend(fit, len(langs), bits, dim, epochs, rate, rng)
    freq = _frequencies(fit, sorted({y for *_, y in fit}), bits)
    model = LanguageModel(langs, np.concatenate((scores, freq[:, None]), 1).astype(np.float32), bias, 1.0, 0.0, bits)
    if check:
        z = np.array([w @ model.scores[u, :-1] + bias for u, w, _ in check], np.float64)
        y = np.array([t for _, _, t in check])

        def loss(t):
            s = z * t
            top = s.max(axis=1)
            logp = s - top[:, None] - np.log(np.exp(s - top[:, None]).sum(axis=1))[:, None]
            # Labels are taken as right in 99 of 100 rows, so that separable rows don't make every score 1.
            return float(-(0.99 * logp[np.arange(len(y)), y] + 0.01 * logp.mean(axis=1)).mean())

        model.temperature = float(min(np.geomspace(0.05, 5, 60), key=loss))
        s = z * model.temperature
        p = np.exp(s - s.max(axis=1, keepdims=True))
        score = (p / p.sum(axis=1, keepdims=True)).max(axis=1)
        model.reject_below = float(min(np.quantile(score, 0.001), 0.4))
        _calibrate(model, fit, texts[::5] or texts, lambda part: _descend(part, len(langs), bits, dim, 2, rate, rng), rng)
    return model


def held_out(doc_id: Column) -> Column:
    """Rows that no model learns from: crc32 of the id's text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, sample: int = 2000, longest: int = 20_000) -> LanguageModel:
    """Train on at most ``sample`` labelled rows of at most ``longest`` characters, chosen by a hash of doc_id, none of them held out."""
    ok = F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & (F.length("text") <= longest) & F.col("text").rlike(r"\p{L}") & ~held_out(F.col("doc_id"))
    h = F.xxhash64(F.col("doc_id").cast("long"))
    # First the bound on the hash alone, then the few texts below it: no task sends more than the sample.
    bound = docs.where(ok).select(h.alias("h")).orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    rows = docs.where(ok & (h <= F.lit(bound))).select("text", "lang", h.alias("h")).limit(2 * sample).collect() if bound is not None else []
    rows = sorted(rows, key=lambda r: (r.h, r.text, r.lang))[:sample]
    return train([(r.text, r.lang) for r in rows])


def _predict(model: LanguageModel):
    def run(batches):
        for t in _bytes.slices(batches, 1 << 19):
            lang, score, accepted = model.predict(t.column(1))
            yield pa.RecordBatch.from_arrays([t.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(accepted)], names=["__row", "lang_pred", "score", "accepted"])

    return run


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """Every row as struct ``__row`` beside lang_pred, score and accepted (false: rejected as no known language)."""
    _base.ready(docs.sparkSession)
    tasks = _base.tasks_for(docs.sparkSession, _base.text_bytes(docs))
    rows = _base.carried(docs, {"text": F.col("text")}).coalesce(tasks)
    return rows.mapInArrow(_predict(model), f"__row {docs.schema.simpleString()}, lang_pred string, score double, accepted boolean")
