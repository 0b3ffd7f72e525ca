"""The limiter against a direct replay of its rule."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from clickloom.operators import limiter as M

START = datetime(2024, 1, 1)


def replay(requests, limit, window):
    """requests: (id, client, microseconds) -> allowed ids."""
    logs, allowed = {}, set()
    for rid, client, us in sorted(requests, key=lambda r: (r[2], r[0])):
        log = {a for a in logs.get(client, ()) if a > us - window}
        if len(log) < limit:
            log.add(us)
            allowed.add(rid)
        logs[client] = log
    return allowed


def frame(spark, requests):
    rows = [(i, c, START + timedelta(microseconds=us)) for i, c, us in requests]
    return spark.createDataFrame(rows, "request_id bigint, client_key string, requested_at timestamp_ntz")


def run(spark, requests, limit, window_us, **options):
    out = M.rate_limit(frame(spark, requests), limit, window_us / 1e6, **options).collect()
    assert sorted(r.request_id for r in out) == sorted(r[0] for r in requests)
    return {r.request_id for r in out if r.allowed}


def split_decisions(times, limit, window, target):
    """The split path in plain calls, as the jobs chain it."""
    instants = np.unique(np.array(times, dtype=np.int64))
    spans = instants // window
    names, sizes = np.unique(spans, return_counts=True)
    chunk_of = (np.cumsum(sizes) - sizes) // target
    log, held = np.empty(0, dtype=np.int64), {}
    for chunk in np.unique(chunk_of):
        own_spans = names[chunk_of == chunk]
        start = own_spans.min() * window
        own = instants[np.isin(spans, own_spans)]
        before = instants[(spans == own_spans.min() - 1) & (instants > start - window)]
        log = log[log > start - window]
        held.update(zip(own.tolist(), M._recorded_before(own, log, limit, window).tolist()))
        log = M._leave(M._transfer_table(before, own, limit, window, 2 * limit), log, limit)
    seen, out = set(), []
    for t in times:
        out.append(held[t] + (t in seen) < limit)
        seen.add(t)
    return out


def composed_log(times, limit, window, target, fan):
    """The log at the end, by tables composed in rounds."""
    instants = np.unique(np.array(times, dtype=np.int64))
    spans = instants // window
    names, sizes = np.unique(spans, return_counts=True)
    chunk_of = (np.cumsum(sizes) - sizes) // target
    rounds, n = 0, len(names)
    while n > 1:
        rounds, n = rounds + 1, -(-n // fan)
    keep, tables = (2 + rounds) * limit, []
    for chunk in np.unique(chunk_of):
        first = names[chunk_of == chunk].min()
        own = instants[np.isin(spans, names[chunk_of == chunk])]
        before = instants[(spans == first - 1) & (instants > (first - 1) * window)]
        tables.append((M._transfer_table(before, own, limit, window, keep), int(first * window)))
    while len(tables) > 1:
        keep -= limit
        groups = [tables[i : i + fan] for i in range(0, len(tables), fan)]
        tables = [(M._compose([t for t, _ in g], [s for _, s in g], limit, window, keep), g[0][1]) for g in groups]
    return M._leave(tables[0][0], np.empty(0, dtype=np.int64), limit)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 900), min_size=1, max_size=150), st.integers(1, 5), st.integers(1, 60), st.integers(1, 20), st.integers(2, 4))
def test_composed_tables_equal_replay(times, limit, window, target, fan):
    allowed = replay([(i, "c", t) for i, t in enumerate(sorted(times))], limit, window)
    want = sorted({sorted(times)[i] for i in allowed})[-limit:]
    assert composed_log(times, limit, window, target, fan).tolist() == want


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 600), min_size=1, max_size=80), st.integers(1, 5), st.integers(1, 60), st.integers(0, 80))
def test_log_carried_over(times, limit, window, cut):
    times = sorted(times)
    allowed = replay([(i, "c", t) for i, t in enumerate(times)], limit, window)
    log, got = np.empty(0, dtype=np.int64), []
    for part in (times[:cut], times[cut:]):
        part = np.array(part, dtype=np.int64)
        got += M.decide(part, log, limit, window).tolist()
        log = M.log_after(part, log, limit, window)
    assert got == [i in allowed for i in range(len(times))]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 600), min_size=1, max_size=150), st.integers(1, 6), st.integers(1, 60), st.integers(1, 40))
def test_split_equals_replay(times, limit, window, target):
    times = sorted(times)
    allowed = replay([(i, "c", t) for i, t in enumerate(times)], limit, window)
    want = [i in allowed for i in range(len(times))]
    whole = M.decide(np.array(times, dtype=np.int64), np.empty(0, dtype=np.int64), limit, window)
    assert whole.tolist() == want
    assert split_decisions(times, limit, window, target) == want


def test_boundaries(spark):
    second = 1_000_000
    requests = [(i, "a", i * second) for i in range(10)]
    requests += [(10, "a", 60 * second - 1), (11, "a", 60 * second), (12, "a", 60 * second + 1)]
    # At 60 s the first instant has expired; only accepted requests are recorded.
    assert run(spark, requests, 10, 60 * second) == {*range(10), 11}


def test_equal_instants_share_a_record(spark):
    requests = [(i, "a", 5) for i in range(4)] + [(9, "a", 6), (10, "a", 7)]
    want = replay(requests, 2, 100)
    assert want == {0, 1, 2, 3, 9}
    assert run(spark, requests, 2, 100) == want
    assert run(spark, requests, 2, 100, chunk_rows=1) == want


@pytest.mark.parametrize("chunk_rows", [10**9, 200, 30])
def test_tables(spark, chunk_rows):
    """Mixed clients, one with a third of the rows, crossing Arrow batches and chunks."""
    rng = random.Random(7)
    requests = []
    for i in range(3000):
        client = "hot" if i % 3 == 0 else f"c{rng.randrange(12)}"
        requests.append((i, client, rng.randrange(4_000) * rng.choice([1, 25])))
    assert run(spark, requests, 4, 700, chunk_rows=chunk_rows) == replay(requests, 4, 700)


def test_thousands_of_chunks(spark):
    """One client of 2,400 chunks, four tables of it in a task at most."""
    rng = random.Random(3)
    requests = [(i, "hot" if i % 4 else "cold", t) for i, t in enumerate(sorted(rng.randrange(60_000) for _ in range(12_000)))]
    assert run(spark, requests, 2, 25, chunk_rows=3, fan=4) == replay(requests, 2, 25)


@pytest.mark.parametrize("chunk_rows", [10**9, 40])
def test_batches_with_a_log_equal_one_batch(spark, chunk_rows):
    """Cut at equal instants too; the log is small, and an idle client leaves it."""
    rng = random.Random(9)
    times = sorted(rng.randrange(3_000) for _ in range(1_500))
    requests = [(i, "hot" if i % 3 else f"c{i % 7}", t) for i, t in enumerate(times)]
    requests = [(-1, "gone", 0), *requests]
    log, allowed = None, set()
    for part in (requests[:500], requests[500:503], requests[503:1100], requests[1100:]):
        out, log = M.rate_limit_after(frame(spark, part), log, 3, 200 / 1e6, chunk_rows=chunk_rows, fan=3, idle_seconds=1_500 / 1e6)
        allowed |= {r.request_id for r in out.collect() if r.allowed}
    assert allowed == replay(requests, 3, 200)
    kept = log.groupBy("client_key").count().collect()
    assert all(r["count"] <= 3 for r in kept) and {r.client_key for r in kept} == {"hot", *(f"c{i}" for i in range(7))}


def test_late_request_is_decided_as_of_the_log(spark):
    log = M.rate_limit_after(frame(spark, [(1, "a", 100), (2, "a", 150)]), None, 3, 100 / 1e6)[1]
    out, after = M.rate_limit_after(frame(spark, [(3, "a", 20), (4, "a", 160), (5, "a", 170)]), log, 3, 100 / 1e6)
    assert {r.request_id: r.allowed for r in out.collect()} == {3: True, 4: True, 5: False}
    assert after.count() == 3


def test_null_client_and_zero_limit(spark):
    requests = [(0, None, 1), (1, None, 2), (2, "x", 3)]
    assert run(spark, requests, 1, 100) == {0, 2}
    assert run(spark, requests, 0, 100) == set()


@pytest.mark.parametrize("chunk_rows", [10**9, 3])
def test_repeated_ids_and_null_times(spark, chunk_rows):
    """An id that occurs twice is two requests; one without time is undecided and kept."""
    rows = [(i, "a", START + timedelta(microseconds=us)) for i, us in ((1, 1), (1, 1), (1, 1), (2, 2), (2, 40), (3, 41), (4, 41), (5, 300))]
    rows += [(6, "a", None), (7, None, None)]
    requests = spark.createDataFrame(rows, "request_id bigint, client_key string, requested_at timestamp_ntz")
    out = sorted(((r.request_id, r.allowed) for r in M.rate_limit(requests, 2, 100 / 1e6, chunk_rows=chunk_rows).collect()), key=str)
    assert out == sorted([(1, True)] * 3 + [(2, True), (2, False), (3, False), (4, False), (5, True), (6, None), (7, None)], key=str)


def test_tables_are_read_one_by_one(monkeypatch):
    """However many tables a client has, no more rows are read than those of one and the start of the next."""
    monkeypatch.setattr(M, "ENTRIES", 3)  # tables are advanced and written in pieces
    rng, limit, window, keep = random.Random(3), 2, 50, 6
    instants = np.unique([rng.randrange(1_000) for _ in range(300)])
    found = []
    for start in range(0, 1_000, window):
        before = instants[(instants > start - window) & (instants < start)]
        own = instants[(instants >= start) & (instants < start + window)]
        found.append(("c", start // window, M._transfer_table(before, own, limit, window, keep), start))
    frames = [f.assign(_group=f["_chunk"] // 64) for f in M._as_frames(iter(found))]
    assert max(map(len, frames)) < 6
    taken = []
    tables = M._tables(taken.append(i) or f for i, f in enumerate(frames))
    for client, number, table, start in found:
        c, group, chunk, got, at, log = next(tables)
        assert (c, group, chunk, at, len(log)) == (client, 0, number, start, 0)
        assert all((a == b).all() for a, b in zip(got, table))
        assert sum(len(f) for f in frames[: len(taken)]) <= sum(len(t.entry) for _, _, t, _ in found[: number + 2])
    whole = list(M._compose_groups(limit, window, limit * 2)(iter(frames)))
    wanted = M._compose([t for _, _, t, _ in found], [s for _, _, _, s in found], limit, window, limit * 2)
    assert [x for f in whole for x in f["steps"]] == wanted.steps.tolist()
    log = M._leave(wanted, np.empty(0, dtype=np.int64), limit)
    allowed = replay([(int(us), "c", int(us)) for us in instants], limit, window)
    assert log.tolist() == sorted(allowed)[-limit:]
