"""Periodic runs against brute force, with nulls, empty and long texts, repeated rows and empty tables."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from clickloom.llm import periodic_runs, queries
from clickloom.llm.periodic_runs import find_runs

DOCS = "doc_id bigint, text string, runs string, collapsed int, _w int, n_words int"


def brute(words, least=6):
    """Every maximal stretch of four periods or more, by its smallest period."""
    names = {}
    w = np.array([names.setdefault(x, len(names)) for x in words])
    found = {}
    for q in range(1, len(w) // 4 + 1):
        same = np.concatenate([[0], w[q:] == w[:-q], [0]]).astype(int)
        for b, stop in zip(np.flatnonzero(np.diff(same) == 1), np.flatnonzero(np.diff(same) == -1)):
            if stop + q - b >= max(4 * q, least):
                found.setdefault((int(b), int(stop) + q), q)
    return sorted((b, e - b, q) for (b, e), q in found.items())


def digests(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(w), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute(w)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *best, best[1] and 1000 * best[1] // best[2], sha("".join(f"{s},{x},{q}\n" for s, x, q in runs)),
            sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def result(spark, docs):
    return periodic_runs.run_digests(periodic_runs.periodic_runs(periodic_runs.repeat_tails(docs)))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=12), st.integers(1, 9)), max_size=6))
def test_runs_of_words(pieces):
    words = [x for unit, times in pieces for x in (unit * times)]
    names = periodic_runs.mix(np.array(words, np.uint64) + np.uint64(1) << np.uint64(20))
    start, end, period = find_runs(names, len(words))
    assert sorted(zip(start.tolist(), (end - start).tolist(), period.tolist())) == brute(words, 4)


def test_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = sorted(map(tuple, queries.queries()["op12_periodic_runs"](spark, sf).collect()))
    assert got == sorted(digests(*r) for r in docs)
    assert sum(r[1] > 0 for r in got) > 5


def test_odd_rows(spark):
    planted = [i for i in range(400) if zlib.crc32(str(i).encode()) % 10 == 0]
    rows = [(planted[0], None), (planted[1], ""), (planted[2], " \n\t "), (planted[3], "a"), (planted[4], "é ü " * 40), (planted[4], "é ü " * 40),
            (None, "a b " * 9), (None, "a b " * 9), (1, "x" * 3000), (2, "a A " * 3 + "a a a a a a"), (3, "  \x1c\x1c b\x0bb\x0cb\rb b  b"),
            (4, "ab " * 30_000 + "c " + "a b c d e " * 10_000), (5, " ".join(map(str, range(5000)))), (planted[5], " ".join(map(str, range(7001))))]
    docs = spark.createDataFrame([(i, t, "r", 1, 2, 3) for i, t in rows], DOCS)
    key = lambda r: tuple(map(str, r))
    quick = [r for r in rows if len(r[1] or "") < 60_000]
    got = sorted(map(tuple, result(spark, docs).collect()), key=key)
    assert len(got) == len(rows)
    assert [r for r in got if r[0] != 4] == sorted((digests(*r) for r in quick), key=key)
    long = next(r for r in got if r[0] == 4)
    assert long[1:6] == (2, 30_001, 50_000, 5, 10_000_000)
    assert result(spark, docs.limit(0)).collect() == []


def test_blocks_change_nothing(spark):
    docs = spark.createDataFrame([(i, "a b c " * (i % 9) + str(i) + " x" * i) for i in range(60)], "doc_id bigint, text string")
    whole, cut = (sorted(map(str, periodic_runs.periodic_runs(docs, block=b).collect())) for b in (1 << 20, 40))
    assert whole == cut


def test_fewer_periods_are_refused(spark):
    with pytest.raises(ValueError):
        periodic_runs.periodic_runs(spark.range(1).selectExpr("id as doc_id", "'' as text"), times=2)
