"""The training-data operators against brute force, and their edge cases: nulls, empty and long texts, ties, repeats, empty tables, clashing names."""

import hashlib
import math
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidegate.llm import _base, _bytes, chat_format, embedding_dedup, jaccard_join, language_id, packing, queries, sentencepiece_bpe, suffix_dedup, token_counts, topk_search, url_filter

repeated = suffix_dedup.repeated_windows
DOCS = "doc_id long, text string, lang string, source string, n_chars long, ids string, text_ string, kept_text string, digest string, bands string"


def docs_of(spark, texts, ids=None):
    """A documents table with extra columns whose names operators use inside."""
    ids = ids if ids is not None else range(len(texts))
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", "x", "x", "x", "x") for i, t in zip(ids, texts)], DOCS)


@pytest.fixture(scope="module")
def prose():
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdeéß漢") for _ in range(rng.randint(1, 6))) for _ in range(200)]
    make = lambda n: " ".join(rng.choice(words) for _ in range(n))
    texts = [make(rng.randint(5, 120)) for _ in range(40)]
    texts += [texts[0], texts[0], texts[1] + " tail of it", "start " + texts[2], make(30) + texts[3][:300] + make(20), None, "", "one two", "a" * 500, "  two  spaces\n\n", make(8000)]
    return texts


def spans_by_force(rows, width):
    seen, out = set(), {}
    for i, t in sorted(rows):
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - width + 1):
            if raw[p : p + width] in seen:
                gone[p : p + width] = b"\1" * width
            seen.add(raw[p : p + width])
        kept = bytes(c for c, g in zip(raw, gone) if not g)
        out[i] = (len(raw), sum(gone), sum(1 for k in range(len(gone)) if gone[k] and not (k and gone[k - 1])), hashlib.sha256(kept).hexdigest())
    return out


def test_suffix_dedup(spark, prose):
    df = docs_of(spark, prose)
    got = suffix_dedup.suffix_dedup(df, 100).select("__row.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "__row.kept_text").collect()
    want = spans_by_force(list(enumerate(prose)), 100)
    assert {r.doc_id: tuple(r)[1:5] for r in got} == want and sum(w[1] for w in want.values()) > 1000
    assert all(r.kept_text == "x" for r in got)
    assert suffix_dedup.suffix_dedup(df.limit(0)).count() == 0
    null = docs_of(spark, [prose[0], prose[0], prose[0]], [None, 1, 1])
    assert {r.n_removed for r in suffix_dedup.suffix_dedup(null).collect()} == {0}


def test_suffix_dedup_cuts_frequent_minimizers_finer(spark, monkeypatch):
    rng = random.Random(3)
    noise = lambda n: "".join(rng.choice("abcdefgh é") for _ in range(n))
    lines = [noise(k) for k in (70, 99, 101, 150, 260)]
    texts = [noise(rng.randint(0, 90)) + rng.choice(lines) + noise(rng.randint(0, 90)) for _ in range(150)]
    texts += [rng.choice("xy") + lines[3] + rng.choice("xy") + noise(40) for _ in range(40)] + [texts[5], None, ""]
    df = docs_of(spark, texts).coalesce(1)
    monkeypatch.setattr(suffix_dedup, "FREQUENT", 20)
    assert len(suffix_dedup.frequent_anchors(df.select("doc_id", "text"), 100, 1000)) >= 3
    want = spans_by_force(list(enumerate(texts)), 100)
    for most in (0, 2, 1000):  # which minimizers are cut finer changes no result
        monkeypatch.setattr(suffix_dedup, "MOST_FREQUENT", most)
        got = suffix_dedup.suffix_dedup(df).select("__row.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
        assert {r.doc_id: tuple(r)[1:] for r in got} == want


def removed_in_process(rows, width, tasks=3, hot=()):
    """The operator's steps without Spark, so that patches reach them."""
    hot = np.sort(np.array(hot, np.uint64))
    batch = lambda part: pa.RecordBatch.from_arrays([pa.array([i for i, _ in part], pa.int64()), pa.array([t for _, t in part], pa.string())], names=["doc_id", "text"])
    dealt = [b for k in range(tasks) for b in suffix_dedup._deal(width, 4, hot)(iter([batch(rows[k::tasks])]))]
    gone, want = [], {}
    for b in suffix_dedup._meet()(iter(dealt)):
        for d, sp, an in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if an is None:
                gone.append((d, sp))
            else:
                want.setdefault(d, []).append({"span": sp, "anchor": an})
    have = [(d, t, want[d]) for d, t in rows if d in want]
    kind = pa.list_(pa.struct([("span", pa.int64()), ("anchor", pa.int64())]))
    joined = pa.RecordBatch.from_arrays([pa.array([d for d, *_ in have], pa.int64()), pa.array([t for _, t, _ in have], pa.string()), pa.array([w for *_, w in have], kind)], names=["doc_id", "text", "runs"])
    cut = list(suffix_dedup._cut(width, 3)(iter([joined]))) if have else []
    gone += [x for b in suffix_dedup._compare(width)(iter(cut)) for x in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    out = {d: bytearray(len((t or "").encode())) for d, t in rows}
    for d, sp in gone:
        out[d][sp >> 24 : (sp >> 24) + (sp & 0xFFFFFF)] = b"\1" * (sp & 0xFFFFFF)
    return {d: (len(g), sum(g), sum(1 for k in range(len(g)) if g[k] and not (k and g[k - 1]))) for d, g in out.items()}


@pytest.mark.parametrize("hashes", [1 << 64, 7, 1])
@pytest.mark.parametrize("small", [False, True])
def test_suffix_dedup_is_exact_under_collisions(prose, monkeypatch, hashes, small):
    true = _bytes.span_hash
    monkeypatch.setattr(_bytes, "span_hash", lambda *a: true(*a) % np.uint64(hashes) if hashes < 1 << 64 else true(*a))
    if small:  # every bound is reached: pieces of texts, batches, chunks, what tasks hold
        for k, v in {"PIECE": 3000, "LOCAL_RUNS": 40, "FLUSH_RUNS": 60, "CHUNK": 500, "HELD": 2000}.items():
            monkeypatch.setattr(suffix_dedup, k, v)
    rows = list(enumerate(prose[:54])) + [(7, prose[7]), (40, prose[40])]
    rows = [(i, t[:4000] if t else t) for i, t in rows]
    want = {i: w[:3] for i, w in spans_by_force(list(dict(rows).items()), 100).items()}
    assert sum(w[1] for w in want.values()) > 1000
    assert removed_in_process(rows, 100) == want
    assert removed_in_process(rows[::-1], 100, 1) == want


def test_suffix_dedup_splits_one_minimizer_of_many_tasks(monkeypatch):
    """A minimizer with few contents in each of many tasks is found and cut finer; no group of texts to compare keeps all its contexts."""
    rng = random.Random(1)
    noise = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    line = noise(60)
    rows = [(i, noise(90) + line + noise(90)) for i in range(300)] + [(300 + i, "x" + noise(39) + line + "y" * 40) for i in range(3)]
    rows += [(400, rows[7][1][20:220]), (401, rows[301][1])]
    monkeypatch.setattr(suffix_dedup, "CHUNK", 1)  # one anchor a suffix array
    batch = lambda part: pa.RecordBatch.from_arrays([pa.array([i for i, _ in part], pa.int64()), pa.array([t for _, t in part], pa.string())], names=["doc_id", "text"])
    seen = {}
    for k in range(20):
        for b in suffix_dedup._frequent(100)(iter([batch(rows[k::20])])):
            for anchor, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                seen[anchor] = seen.get(anchor, 0) + n
    hot = [np.int64(k).view(np.uint64) for k, n in seen.items() if n > 60]
    assert hot
    want = {i: w[:3] for i, w in spans_by_force(rows, 100).items()}
    groups = {}
    for h in ((), hot):
        known = {}
        monkeypatch.setattr(suffix_dedup, "repeated_windows", lambda segs, width, f=repeated, k=known: (k.update(n=max(k.get("n", 0), len(segs))), f(segs, width))[1])
        assert removed_in_process(rows, 100, 20, h) == want
        groups[bool(h)] = known["n"]
    assert groups[True] < groups[False] / 3


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=40), min_size=1, max_size=6), st.integers(17, 24))
def test_repeated_windows(parts, width):
    parts = [p + b"abcabcabcabcabcabcabcabc" * 2 for p in parts]
    seen, want, at = set(), [], 0
    for p in parts:
        for i in range(len(p) - width + 1):
            if p[i : i + width] in seen:
                want.append(at + i)
            seen.add(p[i : i + width])
        at += len(p) + 1
    assert suffix_dedup.repeated_windows(parts, width).tolist() == want


@settings(max_examples=60, deadline=None)
@given(st.binary(min_size=1, max_size=80), st.integers(1, 4), st.randoms())
def test_two_stage(raw, spread, rng):
    text = np.frombuffer(raw, np.uint8) % (spread + 1)
    text = np.append(text, 0).astype(np.uint8)
    wanted = np.array([rng.random() < 0.4 for _ in text])
    for want in (None, wanted):
        sa, _ = suffix_dedup.two_stage(text, 96, want)
        have = np.arange(len(text)) if want is None else np.flatnonzero(want)
        assert set(have.tolist()) <= set(sa.tolist()) and len(set(sa.tolist())) == len(sa)
        suffixes = [(bytes(text[p:]) + b"\0" * 200)[:100] for p in sa.tolist()]
        assert suffixes == sorted(suffixes)


def links_by_force(rows, n=5, threshold=0.8):
    sets = {}
    for i, t in rows:
        w = (t or "").lower().split()
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    count = dict.fromkeys(sets, 0)
    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]):
                count[i] += 1
                count[j] += 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (count[i], find(i)) for i in sets}


def test_jaccard_join(spark, prose, monkeypatch):
    rng = random.Random(1)
    base = prose[10].split()
    near = []
    for _ in range(40):  # a group beyond one block
        w = list(base)
        w[rng.randrange(len(w))] = "changed"
        near.append(" ".join(w))
    monkeypatch.setattr(jaccard_join, "BLOCK", 7)
    texts = [*prose, *near, "", None, prose[5].upper()]
    want = links_by_force(list(enumerate(texts)))
    got = jaccard_join.jaccard_join(docs_of(spark, texts)).collect()
    assert {r.doc_id: (r.n_links, r.class_id) for r in got} == want
    assert jaccard_join.jaccard_join(docs_of(spark, [])).count() == 0
    odd = jaccard_join.jaccard_join(docs_of(spark, ["a b c d e f", "a b c d e f", None], [None, 3, None])).collect()
    assert {(r.doc_id, r.n_links) for r in odd} == {(None, 0), (3, 0)} and len(odd) == 3
    # One doc_id with two texts has the links of both, whatever the order.
    two = [prose[10], prose[11], prose[10] + " more", prose[11] + " more", prose[12]]
    got = jaccard_join.jaccard_join(docs_of(spark, two, [1, 1, 2, 3, 4])).collect()
    assert sorted((r.doc_id, r.class_id) for r in got) == [(1, 1), (1, 1), (2, 1), (3, 1), (4, 4)]


def test_jaccard_join_blocks_by_shingles(spark, prose, monkeypatch):
    monkeypatch.setattr(jaccard_join, "GRAMS", 50)
    texts = [prose[10] + f" tail{i}" for i in range(12)] + prose[:5]
    want = links_by_force(list(enumerate(texts)))
    assert {r.doc_id: (r.n_links, r.class_id) for r in jaccard_join.jaccard_join(docs_of(spark, texts)).collect()} == want


def test_bands_reach_recall():
    for t in (0.5, 0.8, 0.95):
        bands, rows = jaccard_join.plan_bands(t, 0.999)
        assert 1 - (1 - t**rows) ** bands >= 0.999 or bands * rows == 128


def test_packing(spark, prose):
    path = public_tokenizers.path("byte_bpe_50k.json")
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(path)
    texts = [*prose, *EDGE]
    rows = packing.pack(docs_of(spark, texts), path, 64, 8).collect()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    for i, t in enumerate(texts):
        own = sorted(by[i], key=lambda r: r.piece)
        ids = np.concatenate([np.frombuffer(r.ids, "<u4") for r in own]).tolist()
        assert ids == lib.encode(t or "", add_special_tokens=False).ids + [2]
        assert [r.start for r in own] == np.cumsum([0, *(r.length for r in own[:-1])]).tolist() and all(r.length == 64 for r in own[1:])
    seqs = {}
    for r in rows:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in seqs.values():
        at = 0
        for off, ln in sorted(s):
            assert off == at
            at += ln
        assert at <= 64
    assert packing.pack(docs_of(spark, []), path).count() == 0


def test_caches_keep_no_long_parts():
    long = ["漢字" * 200, "x" * 300, "short words here"]
    byte = packing.WordEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    byte.encode([f"a {t} b" for t in long])
    piece = sentencepiece_bpe.BacktrackingBpe(public_tokenizers.path("piece_bpe_32k.model"))
    for t in long:
        piece.encode(t), piece.encode(f"  {t}")
    word = token_counts.WordCounter(public_tokenizers.path("word_bpe_49k.json"))
    word.count(long)
    for cache in (byte.known, piece.words, piece.parts, word.known):
        assert cache and max(map(len, cache)) <= packing.LONGEST + 1


def test_encoders_look_at_the_file(tmp_path):
    import json

    from tokenizers import Tokenizer

    file = json.load(open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8"))
    file["normalizer"] = {"type": "Lowercase"}
    path = str(tmp_path / "lower.json")
    json.dump(file, open(path, "w", encoding="utf-8"))
    encoder, lib = packing.WordEncoder(path), Tokenizer.from_file(path)
    for t in ("Hello World ABC", " A  B\n"):
        assert np.frombuffer(encoder.encode([t])[0], "<u4").tolist() == lib.encode(t, add_special_tokens=False).ids
    assert not encoder.by_parts
    assert token_counts.drops_white_space(public_tokenizers.path("word_bpe_49k.json")) and not token_counts.drops_white_space(path)


def test_token_counts_of_files_that_join_words(spark, prose, tmp_path):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    lib, texts = Tokenizer.from_file(path), [*prose[:5], *EDGE]
    got = token_counts.token_counts(docs_of(spark, texts), path, f"file://{tmp_path}/s").collect()
    assert {r.doc_id: r.n_tokens for r in got} == {i: len(lib.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(texts)}
    with pytest.raises(ValueError):
        token_counts.token_counts(docs_of(spark, texts), path, f"file://{tmp_path}/s", by_word=True)


def test_sentencepiece_long_text_without_spaces():
    coder = sentencepiece_bpe._coder(public_tokenizers.path("piece_bpe_32k.model"))
    text = "".join(random.Random(4).choice("abcdefgheiouy漢") for _ in range(60_000))
    assert np.frombuffer(coder.encode(text), "<i4").tolist() == coder.library.encode(text)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=200), st.integers(1, 9))
def test_best_fit(lengths, bins):
    fit, used = packing.BestFit(50, bins), {}
    for n in lengths:
        seq, off = fit.place(n)
        assert off == used.get(seq, 0) and off + n <= 50
        used[seq] = off + n
        assert fit.count <= bins


EDGE = ["", " ", "  a", "a  ", "\n", "a\n\nb", " \n x", "<|endoftext|>", "x<|startoftext|> y", "▁▁a ▁b", "é́漢😀", "'S don't ~ a~b", "\x1c\x85\u00a0z", "</s><0x0A>", "Σas ΟΔΟΣ", "a" * 3000]


def test_sentencepiece(spark, prose):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = [*prose, *EDGE]
    got = sentencepiece_bpe.decode(sentencepiece_bpe.encode(docs_of(spark, texts), path), path).select("__row.doc_id", "ids", "decoded", "__row.ids").collect()
    for i, ids, decoded, other in got:
        want = sp.encode(texts[i] or "") + [sp.eos_id()]
        assert ids == want and decoded == sp.decode(want) and other == "x"


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=40))
def test_backtracking_matches_library(text):
    coder = sentencepiece_bpe._coder(public_tokenizers.path("piece_bpe_32k.model"))
    text = text.encode("utf-8", "ignore").decode()
    want = coder.library.encode(text)
    assert np.frombuffer(coder.encode(text), "<i4").tolist() == want and coder.decode(want) == coder.library.decode(want)


def test_token_counts(spark, prose, tmp_path):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    texts = [*prose, *EDGE, *prose[:5]]
    df, store = docs_of(spark, texts), f"file://{tmp_path}/store"
    for _ in range(2):  # the second run finds all counts stored
        got = token_counts.token_counts(df, path, store, 50).collect()
        want = {i: (len((t or "").encode()), len(lib.encode(t or "", add_special_tokens=False).ids)) for i, t in enumerate(texts)}
        assert {r.doc_id: (r.n_bytes, r.n_tokens) for r in got} == want and all(r.over_limit == (r.n_tokens > 50) for r in got)
        stored = spark.read.parquet(store)
        assert stored.count() == stored.select("digest").distinct().count() == len({" ".join(x for x in (t or "").replace("\n", " ").split(" ")) if "  " not in (t or "").replace("\n", " ") else __import__("re").sub("[ \n]+", " ", t) for t in texts})
    assert token_counts.token_counts(docs_of(spark, []), path, store).count() == 0
    odd = token_counts.token_counts(docs_of(spark, ["new text here", "new text here"], [None, None]), path, store).collect()
    assert len(odd) == 2 and all(r.n_tokens == 3 for r in odd)


def test_language_id(spark):
    rng = random.Random(3)
    syl = {"xx": ["ka", "tu", "lo"], "yy": ["sch", "ei", "ung"], "zz": ["ñó", "ción", "que"]}
    rows = []
    for i in range(400):
        lang = rng.choice(list(syl))
        rows.append((i, " ".join("".join(rng.choice(syl[lang]) for _ in range(3)) for _ in range(rng.randint(2, 40))), lang))
    rows += [(1000, None, "xx"), (1001, "", "xx"), (1002, "123 -- 456", None), (1003, "…!", "yy"), (None, "kakatu lolo", "xx")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(df, 300)
    got = language_id.identify(df.select("doc_id", "text"), model).select("__row.doc_id", "lang_pred", "score", language_id.held_out(F.col("__row.doc_id")).alias("h")).collect()
    truth = {i: lang for i, _, lang in rows[:400]}
    held = [r for r in got if r.h and r.doc_id in truth]
    assert sum(truth[r.doc_id] == r.lang_pred for r in held) / len(held) > 0.98
    assert {r.doc_id: r.lang_pred for r in got if r.doc_id and r.doc_id >= 1000} == dict.fromkeys((1000, 1001, 1002, 1003), "und")
    assert all(0 <= r.score <= 1 for r in got) and len(got) == len(rows)
    assert language_id.identify(df.limit(0), model).count() == 0
    assert language_id.fit(df.limit(0)).langs == ["und"]


def invented(seed, letters, n=260):
    rng = random.Random(seed)
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(2, 8))) for _ in range(300)]
    return [" ".join(rng.choice(words) for _ in range(rng.randint(5, 80))) for _ in range(n)]


def score_by_force(model, text):
    raw = [b if b >= 128 or chr(b).isalpha() else 32 for b in text.lower().encode()]
    total, n = np.zeros(len(model.langs) + 1), 0
    for size, salt in zip(language_id._GRAMS, language_id._SALT):
        for p in range(len(raw) - size + 1):
            if raw[p] == raw[p + 1] == 32:
                continue
            h = int.from_bytes(bytes(raw[p : p + size]), "big") * salt & 0xFFFFFFFF
            h = (h ^ h >> 15) * 0x2C1B3C6D & 0xFFFFFFFF
            total += model.scores[h >> 32 - model.bits]
            n += 1
    z = (total[:-1] / max(n, 1) + model.bias) * model.temperature
    p = np.exp(z - z.max())
    return model.langs[int(z.argmax())], float((p / p.sum()).max())


def test_language_id_by_force_and_rejection():
    alphabets = {"a": "abcdefgh", "b": "ghijklmn", "c": "mnopqrst"}
    rows = [(t, lang) for k, (lang, letters) in enumerate(alphabets.items()) for t in invented(k, letters)]
    random.Random(0).shuffle(rows)
    model = language_id.train(rows[:600])
    texts = [t for t, _ in rows[600:]] + ["x", "a b", "É漢字 mixed 12", "ab" * 30_000, " ", "gh gh", "gh gh"]
    lang, score, accepted = model.predict(pa.array(texts))
    for t, got, s in zip(texts, lang, score):
        want, p = score_by_force(model, t)
        if any(c.isalpha() for c in t):
            assert got == want and abs(p - s) < 1e-4
        else:
            assert (got, s) == ("und", 0.0)
    assert lang[-1] == lang[-2] and score[-1] == score[-2]
    assert accepted[: len(rows) - 600].mean() > 0.97 and not accepted[texts.index(" ")]
    other = [t for t in invented(9, "uvwxyzéß漢") if len(t) > 60]
    caught = ~model.predict(pa.array(other))[2]
    assert caught.mean() > 0.9
    assert model.rejection.kept > 0.97 and model.rejection.left_out_caught > 0.5


def test_url_filter(spark):
    urls = ["http://A.Example.com/en/7?x", "https://b.com/en/", "x://shop.example.net/de/88#t", "u://net/de/", "u://xnet/de/", None, "", "no scheme", "http://com", "http://org/es/a", "http://a..org/es/", "://com/en/", "http://" + "a." * 5000 + "com/en/" + "x" * 5000, "ht://com/en"]
    df = spark.createDataFrame([(i, u, "h", "p") for i, u in enumerate(urls)], "page_id long, url string, host string, path string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.filter_urls(df, queries.RULES).select("__row.page_id", "rule", "verdict").collect()}
    a = (None, "allow")
    assert [got[i] for i in range(len(urls))] == [("example.com/en/7", "allow"), ("com/en/", "block"), ("example.net/de/8", "block"), ("net/de/", "allow"), a, a, a, a, a, ("org/es/", "block"), ("org/es/", "block"), ("com/en/", "block"), ("com/en/", "block"), a]
    twice = url_filter.filter_urls(df.union(df), queries.RULES).groupBy("__row.page_id").agg(F.count("*").alias("n"), F.min("verdict").alias("a"), F.max("verdict").alias("b")).collect()
    assert all(r.n == 2 and r.a == r.b == got[r.page_id][1] for r in twice)
    assert url_filter.filter_urls(df, []).where("verdict <> 'allow'").count() == 0 and url_filter.filter_urls(df.limit(0), queries.RULES).count() == 0


def test_url_index_confirms_strings(tmp_path, monkeypatch):
    monkeypatch.setattr(url_filter.xxhash, "xxh64_intdigest", lambda s: 7)  # every key collides
    url_filter.write_index([("block", "a.com", "/x"), ("allow", "b.com", "/x"), ("block", "com", "")], str(tmp_path / "i"))
    index = url_filter.Index(str(tmp_path / "i"))
    assert index.find(["a.com", "b.com", "c.com", "d.org"], ["/xy", "/x", "/", "/x"]) == [("a.com/x", "block"), ("b.com/x", "allow"), ("com", "block"), None]


def test_chat_format(spark):
    rows = [(1, 0, "user", "a<b & </turn>\n"), (1, 1, "user", "more"), (1, 2, "assistant", "x"), (1, 3, "assistant", "<and>y"), (2, 0, None, None), (2, None, "assistant", "first"), (3, 0, "we>ird<&", "&lt;"), (4, 0, "assistant", "s"), (4, 0, "assistant", "s")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat_format.parse_chats(chat_format.format_chats(df)).withColumn("loss", chat_format.loss_text(F.col("turns"))).collect()}
    assert [(t.role, list(t.texts)) for t in got[1].turns] == [("user", ["a<b & </turn>\n", "more"]), ("assistant", ["x", "<and>y"])] and got[1].loss == "x<and>y"
    assert [(t.role, list(t.texts)) for t in got[2].turns] == [("assistant", ["first"]), ("", [""])]
    assert got[3].turns[0].role == "we>ird<&" and got[3].turns[0].texts == ["&lt;"] and got[4].loss == "ss"
    assert chat_format.format_chats(df.limit(0)).count() == 0
    long = "<&" * 30_000
    wide = spark.createDataFrame([(1, 0, "user", long, "x", 1), (1, 1, "user", None, "y", 2)], "conv_id long, turn long, role string, text string, formatted string, t int")
    row = chat_format.parse_chats(chat_format.format_chats(wide)).first()
    assert [list(t.texts) for t in row.turns] == [[long, ""]]


def vectors(spark, n=300, d=16):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((n, d)).astype(np.float32)
    for i in range(100, 180):
        base[i] = base[i % 5] + 0.15 * rng.standard_normal(d)
    base[190] = base[191]
    rows = [(i, [float(x) for x in v], int(i % 3 == 0)) for i, v in enumerate(base)]
    rows += [(900, None, 1), (901, [0.0] * d, 1), (902, [math.nan] * d, 1), (903, [None] * d, 0), (904, rows[0][1], None), (905, rows[0][1], rows[0][2]), (906, [1.0, 2.0], 1)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), rows


def test_topk(spark):
    df, rows = vectors(spark)
    whole = {i: np.floor(np.array(v, np.float64) * 64).astype(int) for i, v, _ in rows if v and all(x is not None and math.isfinite(x) for x in v)}
    got = {}
    for r in topk_search.topk(df, F.col("vec_id") % 20 == 0, 7).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    for q in (i for i in whole if i % 20 == 0):
        best = sorted((-int(whole[q] @ v), i) for i, v in whole.items() if i != q and len(v) == len(whole[q]))[:7]
        assert sorted(got[q]) == [(k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert topk_search.topk(df.limit(0), F.lit(True)).count() == 0


@pytest.mark.parametrize("block", [8192, 50])
def test_topk_repeated_ids(spark, monkeypatch, block):
    monkeypatch.setattr(topk_search, "VECTOR_BLOCK", block)
    rng = np.random.default_rng(9)
    rows = [(i, [float(x) for x in rng.standard_normal(8)]) for i in range(120)]
    rows += rows + [(3, [9 * x for x in rows[0][1]])] * 60 + [(20, rows[7][1]), (5, rows[0][1])]  # 3, 5 and 20: different vectors
    score, at = {}, [(i, np.floor(np.array(v) * 64).astype(int)) for i, v in rows]
    for q, x in at:
        for i, y in at if q % 20 == 0 else []:
            if i != q:
                score[q, i] = max(score.get((q, i), -(10**9)), int(x @ y))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1)
    got = {}
    for r in topk_search.topk(df, F.col("vec_id") % 20 == 0, 20).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    for q in range(0, 120, 20):
        best = sorted((-s, i) for (own, i), s in score.items() if own == q)[:20]
        assert sorted(got[q]) == [(k + 1, i, -s) for k, (s, i) in enumerate(best)]


@pytest.mark.parametrize("scale", [1, 50, 10**7])
def test_cells_keep_what_may_be_among_the_best(scale):
    rng = np.random.default_rng(0)
    v, q = rng.integers(-40, 40, (500, 8)) * scale + rng.integers(0, scale, (500, 8)), rng.integers(-40, 40, (20, 8))
    v[100:200] = v[0]
    ids = np.sort(rng.integers(0, 400, 500))  # some ids have several vectors
    best = topk_search.Nearest(np.arange(20), q, 9)
    for no, part in enumerate(np.array_split(np.arange(500), 3)):
        best.scan(no, ids[part], *topk_search.quantised(v[part]))
    r, i, no, low, up = best.rows
    for own in range(20):
        score = {}
        for x, s in zip(ids.tolist(), (v @ q[own]).tolist(), strict=True):
            score[x] = max(s, score.get(x, s))
        score.pop(own, None)
        want = sorted(score, key=lambda x: (-score[x], x))[:9]
        have = set(i[r == own].tolist())
        assert set(want) <= have and own not in have
        assert scale > 1 or have == set(want)  # cells of one value bound exactly
    assert len(r) < 20 * 500 / 2


def test_topk_large_components_copies_and_extra_columns(spark, monkeypatch):
    monkeypatch.setattr(topk_search, "READERS", 7)
    rows = [(i, [1.0, 2.0]) for i in range(60)] + [(100, [1e30, 0.0]), (101, [-1e30, 1.0]), (102, [1e17, 1e17]), (40, None), (None, [1.0, 2.0])]
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "vec_id long, embedding array<double>, no int, ids string, kind int")
    got = {}
    for r in topk_search.topk(df, F.col("vec_id") % 20 == 0, 5).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    most, big = (1 << 63) - 1, lambda x: max(-(1 << 63), min((1 << 63) - 1, int(x * 64)))
    whole = {i: [big(x) for x in v] for i, v in rows if i is not None and v}
    for q in (0, 20, 40, 100):
        score = {i: max(-most - 1, min(most, sum(a * b for a, b in zip(whole[q], v, strict=True)))) for i, v in whole.items() if i != q}
        want = sorted(score, key=lambda i: (-score[i], i))[:5]
        assert sorted(got[q]) == [(k + 1, i, score[i]) for k, i in enumerate(want)]


def test_topk_reads_few_exact_vectors(spark):
    df = spark.range(3000).select(F.col("id").alias("vec_id"), F.transform(F.sequence(F.lit(1), F.lit(16)), lambda j: F.rand(5) * 0 + F.cos(F.col("id") * j * j * 0.7)).alias("embedding"))
    reads = [r.exact_reads for r in topk_search.topk(df, F.col("vec_id") % 100 == 0, 10, 10**6).collect()]
    assert len(reads) == 300 and 10 <= min(reads) and max(reads) < 300


@pytest.mark.parametrize("shard", [16_384, 40])
def test_embedding_dedup(spark, monkeypatch, shard):
    monkeypatch.setattr(embedding_dedup, "SHARD", shard)
    df, rows = vectors(spark)
    ok = [(i, np.array(v, np.float64), g) for i, v, g in rows if v and g is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    links, root = {i: 0 for i, *_ in rows}, {i: i for i, *_ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, v, g in ok:
        for j, w, h in ok:
            if i < j and g == h and len(v) == len(w) and v @ w / (np.linalg.norm(v) * np.linalg.norm(w)) >= 0.93:
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    named = df.withColumnRenamed("label", "n").select("*", F.concat(F.lit("l "), "n").alias("label"), F.lit(1).alias("grp"), F.lit(1).alias("rep"), F.lit(1).alias("v"))
    for table in (df, named.drop("n")):  # labels of any type, extra columns whose names are used inside
        got = {r.vec_id: r for r in embedding_dedup.near_duplicates(table).collect()}
        assert len(got) == len(rows) and sum(links.values()) > 100
        assert {i: r.n_links for i, r in got.items()} == links
        assert all(got[i].component_id == find(i) and got[i].kept == (find(i) == i) for i in links)
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_embedding_dedup_ties_and_large_components(spark):
    rows = [(1, [1.0, 0.0], 0), (2, [0.6, 0.8], 0), (3, [1e200, 0.0], 0), (None, [1.0, 0.0], 0), (4, [0.0, 1e-300], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(df, 0.6).collect()}
    assert got == {1: (2, 1), 2: (3, 1), 3: (2, 1), 4: (1, 1), None: (0, None)}  # cosines of 0.6 and 0.8 both reach 0.6


def clusters():
    rng = np.random.default_rng(3)
    heart = np.repeat(rng.standard_normal((12, 24)), 60, axis=0) + 0.12 * rng.standard_normal((720, 24))
    return embedding_dedup._unit(np.concatenate((heart, rng.standard_normal((300, 24))))).astype(np.float32)  # in the clusters' order


@pytest.mark.parametrize("broken", [False, True])
def test_links_between_passes_its_audits(monkeypatch, broken):
    x = clusters()
    truth = x @ x.T >= 0.93
    graph = embedding_dedup.Graph(x)
    if broken:  # edges lead nowhere: every audit fails, and the shard is compared in full
        graph.layers = [np.full_like(layer, -1) for layer in graph.layers]
        monkeypatch.setattr(embedding_dedup.Graph, "relink", lambda *a: None)
    a, b, beam, recall = embedding_dedup.links_between(graph, x, 0.93, True)
    got = np.zeros_like(truth)
    got[a, b] = True
    np.fill_diagonal(truth, False)
    assert (beam == 0) == broken and recall >= 0.99 and (got & truth).sum() >= 0.995 * truth.sum() > 10_000


def test_relink_finds_lost_vectors():
    x = clusters()
    graph = embedding_dedup.Graph(x)
    base = graph.layers[0]
    base[base == 30] = -1  # no edge leads to vector 30
    some = np.array([29])
    r, found = graph.within(x[some], 0.93, 64)
    lost_q, lost, _ = embedding_dedup.audit(graph, x, some, 0.93, True, some[r], found)
    assert lost.tolist() == [30]
    graph.relink(x, lost_q, lost)
    assert 30 in graph.within(x[some], 0.93, 64)[1]


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(180)] + [(i, i + 1) for i in range(500, 560)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in _base.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root if find(x) != x}
    ids, roots = _base.local_roots(np.array([e[0] for e in edges]), np.array([e[1] for e in edges]))
    assert dict(zip(ids.tolist(), roots.tolist())) == {x: find(x) for x in root}


def test_pipeline(spark, prose):
    import corpus_pipeline as c

    docs = docs_of(spark, [*prose, "1 2 3", prose[4]]).select("doc_id", "text", "lang", "source", "n_chars")
    docs = _base.staged(docs, "docs")
    assert [n for n, _ in c.STAGES] == ["language_id", "jaccard_join", "suffix_dedup", "packing"]
    for _, stage in c.STAGES[:-1]:
        out = _base.staged(stage(spark, docs, ""), "stage")
        assert out.columns == docs.columns and out.count() < docs.count() or stage is c.without_repeats
        docs = out
    kept = {r.doc_id: r.text for r in docs.collect()}
    assert 0 in kept and not {40, 41, 45, 46, 51, 52} & set(kept) and kept[1] == prose[1]
    assert c.packed(spark, docs, "").select("doc_id").distinct().count() == len(kept)


def test_pipeline_repeated_rows(spark, prose):
    import corpus_pipeline as c

    texts, ids = [prose[0], prose[0], prose[0], prose[5], prose[5], prose[5], prose[6], prose[7]], [1, 1, 2, None, None, 3, None, 4]
    docs = _base.staged(docs_of(spark, texts, ids).select("doc_id", "text", "lang", "source", "n_chars"), "docs")
    got = [(r.doc_id, r.text) for r in c.one_of_each_group(spark, docs, "").collect()]
    assert sorted(got, key=str) == sorted([(1, prose[0]), (None, prose[5]), (3, prose[5]), (None, prose[6]), (4, prose[7])], key=str)
