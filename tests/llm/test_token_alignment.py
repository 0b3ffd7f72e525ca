"""Token alignment against brute force with the tokenizers' own libraries, and odd rows."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import sentencepiece
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from clickloom.llm import queries, token_alignment as T

DOCS = "doc_id bigint, text string, n_a string, chunk int, pairs int, n int"
HUGGING = Tokenizer.from_file(f"{T.FOLDER}/{T.BYTE_BPE}")
HUGGING.encode_special_tokens = True
PIECES = sentencepiece.SentencePieceProcessor(model_file=f"{T.FOLDER}/{T.PIECES}")


def a_tokens(text):
    letters = T.byte_letters()
    ids = HUGGING.encode(" " + text, add_special_tokens=False).ids
    return [(i, bytes(letters[c] for c in HUGGING.id_to_token(i))) for i in ids]


def b_tokens(text):
    piece = lambda i: bytes([int(PIECES.id_to_piece(i)[3:5], 16)]) if PIECES.is_byte(i) else PIECES.id_to_piece(i).replace("▁", " ").encode()
    return [(i, piece(i)) for i in PIECES.encode(text)]


def groups(text):
    """Ids of A and B by group, from the sets of ends."""
    if not text:
        return []
    a, b = a_tokens(text), b_tokens(text)
    if {b"".join(x for _, x in t) for t in (a, b)} != {(" " + text).encode()}:
        return []
    ends = [np.cumsum([len(x) for _, x in t]).tolist() for t in (a, b)]
    common = sorted(set(ends[0]) & set(ends[1]))
    out = [([], []) for _ in common]
    for side, tokens in enumerate((a, b)):
        for (i, _), end in zip(tokens, ends[side]):
            out[next(k for k, c in enumerate(common) if c >= end) if len(common) < 50 else int(np.searchsorted(common, end))][side].append(i)
    return out


def expected(rows):
    cut = [groups(t) for _, t in rows]
    links = [Counter((a, b) for ga, gb in g for a in ga for b in gb) for g in cut]
    counts = Counter(pair for x in links for pair in x)
    best = defaultdict(int)
    for (a, _), n in counts.items():
        best[a] = max(best[a], n)
    out = []
    for (i, _), g, x in zip(rows, cut, links):
        text = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in g)
        out.append((i, sum(len(ga) for ga, _ in g), sum(len(gb) for _, gb in g), len(g), sum(x.values()), sum(n for p, n in x.items() if counts[p] == best[p[0]]),
                    sum(n * counts[p] for p, n in x.items()), hashlib.sha256(text.encode()).hexdigest() if g else ""))
    return sorted(out, key=lambda r: tuple(map(str, r)))


def result(df):
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return sorted(map(tuple, df.select(*columns).collect()), key=lambda r: tuple(map(str, r)))


@settings(max_examples=300, deadline=None)
@given(st.sets(st.integers(1, 120)), st.sets(st.integers(1, 120)), st.sets(st.integers(1, 120)), st.integers(1, 30))
def test_common_ends(shared, a, b, lane):
    a, b = (np.array(sorted(shared | x | {121}), np.int64) for x in (a, b))
    in_a, in_b = T.common_ends(a, b, lane)
    assert (in_a == np.isin(a, b)).all() and (in_b == np.isin(b, a)).all()


def test_no_ends():
    assert [len(x) for x in T.common_ends(np.zeros(0, np.int64), np.zeros(0, np.int64))] == [0, 0]


def test_every_entry_and_odd_strings_encode_alike():
    ours = T.Tokenizers(*T.load(T.FOLDER))
    texts = [b.decode() for b in ours.a_bytes if b and b.decode(errors="ignore").encode() == b]
    texts += ["<|endoftext|>", "  two  \n\n x\u0085y z　 \t", "it's we'LL ١٢३ ⅷ²", "😀👍🏽 ﬁ ǅ ß", "\x00\x01\x7f\xad", "漢字かな한글", "áé", "x" * 3000, " " * 3000]
    assert len(texts) > 45_000
    assert ours.a(texts) == [e.ids for e in HUGGING.encode_batch([" " + t for t in texts], add_special_tokens=False)]


def test_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert result(queries.queries()["op11_token_alignment"](spark, sf)) == expected([tuple(d) for d in docs])


def odd_rows():
    texts = [None, "", " ", "a", "é", "a▁b", "▁", "<s>x</s> <unk> <0x41> <|endoftext|>", "\x00", "  two  blanks\n\n", "日本語😀 ﬁ ſ", "hello world", "hello world", "hello world",
             "the cat sat. " * 4000, "z" * 5000, "12345 67 8" * 50, " \u0085﻿", "Ünïcödé tëxt"]
    return [(i if i % 5 else None, t) for i, t in enumerate(texts)] + [(11, "hello world")]


def test_odd_rows(spark):
    rows = odd_rows()
    docs = spark.createDataFrame([(i, t, "s", 1, 2, 3) for i, t in rows], DOCS).repartition(3)
    got = result(T.align_tokens(docs))
    assert got == expected(rows)
    assert T.align_tokens(docs.limit(0)).collect() == []
    assert result(T.align_tokens(docs, block=30, chunk=100, lane=2)) == got


def test_large_groups_are_cut(spark, monkeypatch):
    rows = odd_rows()
    whole = T.Aligner(T.Tokenizers(*T.load(T.FOLDER)))
    texts = [t or "" for _, t in rows]
    before = whole(texts)
    monkeypatch.setattr(T, "PAIRS", 3)
    after = whole(texts)
    assert all(np.array_equal(before[k], after[k]) for k in before)


def test_only_null_ids(spark):
    docs = spark.createDataFrame([(None, "some words"), (None, "")], "doc_id bigint, text string")
    assert [r[0] for r in result(T.align_tokens(docs))] == [None, None]
