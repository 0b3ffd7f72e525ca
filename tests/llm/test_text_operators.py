"""Operators on texts against brute force, with nulls, empty and long texts, ties, repeated rows and empty tables."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from clickloom.llm import decontaminate, language_id, language_model, ngram_join, suffix_dedup, toxicity
from clickloom.llm.suffixes import sort_windows
from clickloom.llm.textbytes import ALNUM, SPACED, buffers

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, part int, chunk string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def spaced(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def corpus(seed=1):
    """Texts with copies, near copies, shared passages, odd bytes, nulls and a long one."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdeé", k=rng.randint(1, 5))) for _ in range(60)]
    text = lambda n: " ".join(rng.choices(vocabulary, k=n))
    out = [text(rng.randint(1, 60)) for _ in range(40)]
    passage = text(20)
    out += [text(5) + " " + passage + " " + text(rng.randint(0, 5)) for _ in range(8)]
    base = text(50).split()
    for _ in range(12):
        some = list(base)
        for _ in range(rng.randint(0, 6)):
            some[rng.randrange(len(some))] = rng.choice(vocabulary)
        out.append(" ".join(some))
    out += [out[3]] * 6 + [None, "", " \n\t ", "a", "A", "x" * 500, "x" * 500 + "y", "日本語 テキスト " * 20, text(4000), "é" * 120, "a" + "é" * 119]
    return [(i, t) for i, t in enumerate(out)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), 1, "c") for i, t in rows], DOCS)


def test_words_match_regex():
    texts = [t for _, t in corpus()] + ["a--b\x1c9ß_Z", "\x00q\x7f"]
    import pyarrow as pa

    data, offsets = buffers(pa.array(texts, pa.string()))
    for words, pattern in ((SPACED, r"[^\x20\x09-\x0D]+"), (ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        hashes, at = words.hashes(data, offsets)
        names = {}
        for i, t in enumerate(texts):
            found = re.findall(pattern, (t or "").translate(LOWER))
            assert len(found) == at[i + 1] - at[i]
            for w, h in zip(found, hashes[at[i] : at[i + 1]].tolist()):
                assert names.setdefault(w, h) == h
        assert len(set(names.values())) == len(names)


def test_words_in_blocks(monkeypatch):
    import pyarrow as pa

    from clickloom.llm import textbytes

    data, offsets = buffers(pa.array([t for _, t in corpus()], pa.string()))
    whole = SPACED.hashes(data, offsets)
    monkeypatch.setattr(textbytes, "BLOCK", 64)
    parts = SPACED.hashes(data, offsets)
    assert all((a == b).all() for a, b in zip(whole, parts))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab", max_size=20), max_size=6), st.integers(1, 9))
def test_two_stage_sort(pieces, depth):
    text = np.frombuffer("".join(pieces).encode(), np.uint8)
    ends = np.cumsum([len(p) for p in pieces]).astype(np.int64) if pieces else np.zeros(0, np.int64)
    starts = ends - np.array([len(p) for p in pieces], np.int64)
    order, same = sort_windows(text, starts, ends, depth)
    found = [text[i : i + depth].tobytes() for i in order]
    assert sorted(order.tolist()) == [i for a, b in zip(starts, ends) for i in range(a, b - depth + 1)]
    assert found == sorted(found)
    assert same.tolist() == [i > 0 and found[i] == found[i - 1] for i in range(len(found))]


def removed(rows, length):
    first = {}
    for i, t in rows:
        raw = (t or "").encode()
        for j in range(len(raw) - length + 1):
            w = raw[j : j + length]
            first[w] = min(first.get(w, i), i)
    out = []
    for i, t in rows:
        raw = (t or "").encode()
        cover = bytearray(len(raw))
        for j in range(len(raw) - length + 1):
            if first[raw[j : j + length]] < i:
                cover[j : j + length] = b"\x01" * length
        kept = bytes(b for b, c in zip(raw, cover) if not c)
        runs = sum(1 for j in range(len(cover)) if cover[j] and (j == 0 or not cover[j - 1]))
        out.append((i, len(raw), sum(cover), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("hot_docs", [2, 1000])
def test_suffix_dedup(spark, hot_docs):
    rows = corpus() + [(3, corpus()[3][1]), (3, "once more " * 20)]
    found = suffix_dedup.repeated_spans(frame(spark, rows), 32, hot_docs, 2000, 3000)
    found = sorted(tuple(r) for r in found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect())
    assert found == removed(rows, 32)


def test_suffix_dedup_texts(spark):
    rows = corpus()
    docs = frame(spark, rows)
    kept = {r["doc_id"]: r for r in suffix_dedup.remove_repeats(docs, 32).collect()}
    assert len(kept) == len(rows)
    assert suffix_dedup.remove_repeats(docs, 32).columns == docs.columns
    for i, t in rows:
        assert (kept[i]["text"] is None) == (t is None)
        assert t is None or kept[i]["n_chars"] == len(kept[i]["text"])
    assert kept[rows[-1][0]]["text"].startswith("a")


def components(rows, words, num, den):
    sets = {}
    for i, t in rows:
        w = spaced(t)
        sets[i] = {tuple(w[j : j + words]) for j in range(len(w) - words + 1)} or ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and den * both >= num * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
    return sorted((i, len(sets[i]), top(i)) for i in sets)


@pytest.mark.parametrize(("words", "num", "den", "block"), [(4, 85, 100, 1024), (2, 7, 10, 3), (1, 4, 5, 2)])
def test_ngram_join(spark, words, num, den, block):
    rows = corpus(2)
    found = ngram_join.near_duplicates(frame(spark, rows), words, num, den, block, 2000, 3000)
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found.collect()) == components(rows, words, num, den)


def test_ngram_join_in_many_rounds(spark, monkeypatch):
    """A large group of near copies, of which few pairs are links, verified one by one, in small blocks."""
    monkeypatch.setattr(ngram_join, "AT_ONCE", 1)
    monkeypatch.setattr(ngram_join, "BLOCK_GRAMS", 600)
    monkeypatch.setattr(ngram_join, "GROUP_BYTES", 2000)
    rng = random.Random(9)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(90):
        some = list(base)
        for _ in range(rng.randint(0, 14)):
            some[rng.randrange(len(some))] = f"x{rng.randrange(40)}"
        rows.append((i, " ".join(some)))
    found = ngram_join.near_duplicates(frame(spark, rows), 2, 4, 5, 16, 2000, 3000)
    expected = components(rows, 2, 4, 5)
    assert len({top for _, _, top in expected}) > 3
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found.collect()) == expected


def test_tree_links_are_a_forest():
    """Each set of a large group asks; no more links leave the block than connect it."""
    rng = np.random.default_rng(4)
    grams = rng.integers(0, 1 << 63, 5000).astype(np.uint64)
    sets = [np.unique(np.append(grams[:200][rng.random(200) < 0.93], grams[rng.integers(200, 5000, 3)])) if i % 5 else np.unique(rng.choice(grams, 200)) for i in range(150)]
    names = list(range(150))
    rows = [(r, n) for n in names for r in (0, 1)]
    table = pa.table({
        "bucket": [1] * 300, "i": [0] * 300, "j": [0] * 300, "role": [r for r, _ in rows], "set_id": [n for _, n in rows], "n_shingles": [len(sets[n]) for _, n in rows],
        "component": [n for _, n in rows], "asks": pa.array([True] * 300), "point": [ngram_join._point(sets[n]) for _, n in rows], "shingles": [sets[n].tobytes() for _, n in rows]})
    found = ngram_join._tree_links(4, 5)(table).to_pylist()
    alike = lambda a, b: 5 * len(both := set(a.tolist()) & set(b.tolist())) >= 4 * (len(a) + len(b) - len(both))
    assert all(alike(sets[r["a"]], sets[r["b"]]) for r in found)
    up = {n: n for n in names}

    def top(n):
        return n if up[n] == n else top(up[n])

    for r in found:
        assert top(r["a"]) != top(r["b"])  # none closes a circle
        up[top(r["a"])] = top(r["b"])
    assert len(found) > 20
    assert not any(top(a) != top(b) and alike(sets[a], sets[b]) for a in names for b in names[:a])


def test_ngram_join_odd_rows(spark):
    rows = [(1, "a b c d e"), (1, "a b c d e"), (None, "a b c d e"), (2, "A b\tc d e"), (5, None), (6, ""), (7, "z")]
    found = ngram_join.near_duplicates(frame(spark, rows), 4, 85, 100).collect()
    assert sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"]) for r in found) == [
        (0, 2, None), (1, 2, 1), (1, 2, 1), (2, 2, 1), (5, 0, 5), (6, 0, 6), (7, 1, 7)]


def test_ngram_join_null_id_near_copies(spark):
    """Sets that only rows without id have, near copies of others and of each other, link nothing and stop nothing."""
    base = [f"w{i}" for i in range(40)]
    near = [" ".join([*base[:-1], f"x{i}"]) for i in range(12)]
    rows = [(1, " ".join(base)), (2, near[0]), *((None, t) for t in near[1:])]
    found = ngram_join.near_duplicates(frame(spark, rows), 4, 85, 100).collect()
    assert sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"]) for r in found) == [(0, 37, None)] * 11 + [(1, 37, 1), (2, 37, 1)]


def hits(rows, items, window):
    word = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    windows = defaultdict(set)
    for name, t in items:
        w = word(t)
        size = min(window, len(w))
        for j in range(len(w) - size + 1 if w else 0):
            windows[tuple(w[j : j + size])].add(str(name))
    out = []
    for i, t in rows:
        w, hit, found = word(t), set(), set()
        for size in {len(x) for x in windows}:
            for j in range(len(w) - size + 1):
                if tuple(w[j : j + size]) in windows:
                    hit |= set(range(j, j + size))
                    found |= windows[tuple(w[j : j + size])]
        ids = ",".join(sorted(found))
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out)


@pytest.mark.parametrize("block_words", [500_000, 40])
def test_contamination(spark, block_words):
    rows = corpus(3) + [(3, corpus(3)[3][1])]
    items = [(n, " ".join(spaced(corpus(3)[n][1])[:k])) for n, k in ((0, 9), (1, 3), (41, 12), (44, 15), (50, 40), (10, 1))] + [(70, None), (71, ""), (9, "a")]
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    found = decontaminate.contamination(frame(spark, rows), benchmark, 5, block_words)
    found = found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    expected = hits(rows, items, 5)
    assert sorted(tuple(r) for r in found.collect()) == expected
    kept = decontaminate.decontaminate(frame(spark, rows), benchmark, 5, block_words=block_words)
    assert sorted(r["doc_id"] for r in kept.collect()) == [r[0] for r in expected if not r[5]]


def test_contamination_cut(spark):
    docs = frame(spark, [(1, "Öl one two three four five. And more of it, é"), (2, "one two three four five"), (3, None)])
    benchmark = spark.createDataFrame([(1, "one two three four five")], "item_id bigint, text string")
    kept = {r["doc_id"]: r for r in decontaminate.decontaminate(docs, benchmark, 5, cut_below=0.9).collect()}
    assert kept[1]["text"] == "Öl . And more of it, é"
    assert kept[1]["n_chars"] == len(kept[1]["text"])
    assert sorted(kept) == [1, 3]


def model_scores(rows, discount):
    import zlib

    held = {i: zlib.crc32(b"" if i is None else str(i).encode()) % 5 == 1 for i, _ in rows}
    uni, bi, after = Counter(), Counter(), defaultdict(set)
    state = Counter()
    for i, t in rows:
        seq = [*spaced(t), None]
        if not held[i]:
            for h, w in zip(["\n", *seq], seq):
                uni[w] += 1
                bi[h, w] += 1
                after[h].add(w)
                state[h] += 1
    n, kinds = sum(uni.values()), len(uni)
    out = []
    for i, t in rows:
        seq = [*spaced(t), None]
        base = [(uni[w] + 0.5) / (n + 0.5 * (kinds + 1)) for w in seq]
        full = [p if not state[h] else (max(bi[h, w] - discount, 0) + discount * len(after[h]) * p) / state[h] for h, w, p in zip(["\n", *seq], seq, base)]
        out.append((i, held[i], len(seq), sum(w in uni for w in seq), n, sum(map(math.log10, base)), sum(map(math.log10, full))))
    return sorted(out, key=str)


def test_language_model(spark):
    rows = corpus(4) + [(None, "a b"), (7, "a b")]
    found = sorted((tuple(r) for r in language_model.scores(frame(spark, rows), 0.75, 2000, 3000).collect()), key=str)
    for a, b in zip(found, model_scores(rows, 0.75), strict=True):
        assert a[:5] == b[:5]
        assert a[5:] == pytest.approx(b[5:], abs=1e-8)


def test_language_id_odd_rows(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("the cat and the dog", "en"), ("der Hund und die Katze", "de"), ("the house is with them", "en"), ("das Haus ist bei ihnen", "de")] * 5)]
    rows += [(100, None, "en"), (101, "", "de"), (102, "123 !!", "en"), (103, "und der Hund", None), (104, "日本語", "en"), (None, "the dog", "en"), (0, "the dog", "en")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").selectExpr("*", "1 as letters", "2 as held_out")
    found = [(r["doc_id"], r["lang_pred"]) for r in language_id.identify(docs).collect()]
    assert len(found) == len(rows)
    known = dict(found)
    assert [known[i] for i in (100, 101, 102)] == ["und"] * 3
    assert known[103] == "de" and known[0] == "en"
    assert known[104] in ("de", "en")
    assert {r["lang_pred"] for r in language_id.identify(docs, reject=0.1).filter("doc_id = 104").collect()} == {"und"}
    bare = language_id.identify(docs.withColumn("lang", docs.lang.substr(1, 0)).filter("lang is null")).collect()
    assert {r["lang_pred"] for r in bare} <= {"und", ""}


def test_subsequence_kernel():
    words = toxicity.matrix([b"moron", b"table", b"mooron", b"ab"])
    own = np.sqrt(toxicity.own_kernel(words))
    like = lambda i, j: toxicity.kernel(words[[i]], words[[j]])[0] / max(own[i] * own[j], 1e-9)
    assert like(0, 0) == pytest.approx(1)
    assert like(0, 1) == pytest.approx(0, abs=1e-6)
    assert 0.5 < like(0, 2) < 1

    def plain(s, t):
        total = 0.0
        from itertools import combinations

        for a in combinations(range(len(s)), toxicity.ORDER):
            for b in combinations(range(len(t)), toxicity.ORDER):
                if [s[i] for i in a] == [t[i] for i in b]:
                    total += toxicity.DECAY ** (a[-1] - a[0] + 1 + b[-1] - b[0] + 1)
        return total

    for s, t in ((b"moron", b"mooron"), (b"banana", b"bandana"), (b"abc", b"abc")):
        assert toxicity.kernel(toxicity.matrix([s]), toxicity.matrix([t]))[0] == pytest.approx(plain(s, t), rel=1e-5)


def test_every_similarity_is_the_kernel():
    """Masked, dropped, replaced and multiply inserted letters keep what the kernel gives them."""
    marks = toxicity.Marks([b"stupid", b"loser", b"banana"])
    spelled = [b"stpid", b"lser", b"loxer", b"sxtxuxpid", b"lxxoxxsxer", b"bandana", b"table", b"zzz", b"stupidstupidstupidstupid"]
    rows = toxicity.matrix(spelled)
    some, value = marks.like(rows)
    dense = np.zeros((len(rows), 3), np.float32)
    dense[some] = value
    for i in range(len(rows)):
        for m in range(3):
            mark = marks.rows[[m]]
            plain = toxicity.kernel(rows[[i]], mark)[0] / np.sqrt(toxicity.own_kernel(rows[[i]])[0] * toxicity.own_kernel(mark)[0] or 1)
            assert dense[i, m] == pytest.approx(plain, abs=1e-5)
    assert dense[0, 0] > 0.5 and dense[1, 1] > 0.5 and dense[3, 0] > 0.2


def test_toxicity_odd_rows(spark):
    rows, labels = [], []
    rng = random.Random(5)
    plain = ["the", "house", "garden", "water", "walking", "slowly", "under", "bright", "skies"]
    for i in range(400):
        bad = i % 5 == 2
        words = rng.choices(plain, k=12)
        if bad:
            words[rng.randrange(12)] = rng.choice(["blockhead", "nitwit"])
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    rows += [(1000, None), (1001, ""), (1002, "a n i t w i t here"), (1003, "such a blockkhead"), (1004, "block-head"), (1005, "n i t w i t"), (None, "nitwit"), (0, "nitwit " * 3000)]
    labels += [(2, 1), (3, None), (None, 1)]
    labels = spark.createDataFrame(labels, "doc_id bigint, toxic int").selectExpr("*", "0 as text", "1 as quality")
    found = toxicity.score(frame(spark, rows), labels).collect()
    assert len(found) == len(rows)
    known = {r["doc_id"]: r["predicted"] for r in found if r["doc_id"] != 0}
    assert [known[i] for i in (1000, 1001)] == [0, 0]
    assert [known[i] for i in (1003, 1004, 1005, None)] == [1, 1, 1, 1]
    assert sum(known[i] != (i % 5 == 2) for i in range(1, 400)) == 0
    clean = toxicity.keep_clean(frame(spark, rows), labels)
    assert clean.columns == frame(spark, rows).columns
    assert 2 not in {r["doc_id"] for r in clean.select("doc_id").collect()}
    none = toxicity.score(frame(spark, rows[:5]), labels.limit(0)).collect()
    assert [r["score"] for r in none] == [0.0] * 5


@pytest.mark.parametrize("run", [
    lambda d, s: suffix_dedup.repeated_spans(d), lambda d, s: suffix_dedup.remove_repeats(d), lambda d, s: ngram_join.near_duplicates(d),
    lambda d, s: decontaminate.contamination(d, s.createDataFrame([], "item_id bigint, text string")),
    lambda d, s: decontaminate.decontaminate(d, s.createDataFrame([], "item_id bigint, text string")), lambda d, s: language_model.scores(d),
    lambda d, s: language_id.identify(d), lambda d, s: toxicity.score(d, s.createDataFrame([], "doc_id bigint, toxic int")),
])
def test_empty_tables(spark, run):
    assert run(frame(spark, []), spark).count() == 0
