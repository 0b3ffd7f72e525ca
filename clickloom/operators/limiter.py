"""Sliding-log rate limiter over a table of requests.

A request at ``t`` is allowed when fewer than ``limit`` accepted instants lie in
``(t - window, t)``; only accepted requests are recorded, and requests of one
client at one instant share a single record. This feedback makes it a
sequential rule per client, not a window function.

All clients go one way, whatever their size:

1. requests shrink to distinct instants per client; those of a client with very
   many are cut into chunks of whole windows (``_large_clients``);
2. for each chunk of such a client, all in parallel, ``_transfer_table``
   tabulates what any single accepted instant of the preceding window leads to
   at the chunk's end. The k-th accepted instant after several recorded ones is
   the latest of the k-th instants that each recorded one alone would lead to,
   because the step "next instant at or after a + window, and after the last
   accepted" is monotone; so the tables answer for every possible log;
3. neighbouring tables are composed into one, ``fan`` at a time, round by round,
   until a client has no more than ``fan`` (``_extend``). The real log is then
   found from the top down: at the start of each composed table, then at the
   start of each table that it is made of (``_walk``). A task goes through no
   more than ``fan`` tables of one client, and holds the composed one and the next;
4. each chunk is decided on its own from that log, and the answers are joined
   back to the requests. Only clients, instants and answers pass through Python.

The log outlives a batch: ``rate_limit_after`` starts from the accepted instants
of earlier batches and returns those that the next one needs.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from itertools import groupby
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from clickloom.functions.timeutil import epoch_micros, floor_micros, from_epoch_micros
from clickloom.schemas import RATE_LIMIT, RATE_WINDOW_SECONDS
from clickloom.session import materialize

UNKNOWN_CLIENT = "unknown_client"
#: Instants in a chunk, about; a chunk never ends within a window.
CHUNK_ROWS = 4_000_000
#: Tables of one client that a task takes at once.
FAN = 64
#: Entries of a table that are advanced, or handed to Spark, at once.
ENTRIES = 10_000
#: A client that was silent for so long is forgotten between batches.
IDLE_SECONDS = 86_400

LOG = "client_key string, accepted_at timestamp_ntz"


def client_key(api_key: Column, ip: Column) -> Column:
    """The API key when the header is present, even empty; else the address."""
    return F.coalesce(api_key, ip, F.lit(UNKNOWN_CLIENT))


# -- one client in memory: sorted int64 microseconds -------------------------------------


def _accept(instants: np.ndarray, log: np.ndarray, limit: int, window: int) -> np.ndarray:
    """Accepted positions among distinct sorted instants, given the prior log."""
    free_at = np.searchsorted(instants, instants + window).tolist()
    busy = deque(np.searchsorted(instants, log[-limit:] + window).tolist())
    taken: list[int] = []
    following = 0
    while True:
        at = following if len(busy) < limit else max(following, busy.popleft())
        if at >= len(free_at):
            return np.array(taken, dtype=np.int64)
        taken.append(at)
        busy.append(free_at[at])
        following = at + 1


def _recorded_before(instants: np.ndarray, log: np.ndarray, limit: int, window: int) -> np.ndarray:
    """Accepted instants within the window before each instant."""
    accepted = np.concatenate([log, instants[_accept(instants, log, limit, window)]])
    return np.searchsorted(accepted, instants) - np.searchsorted(accepted, instants - window, side="right")


def decide(instants: np.ndarray, log: np.ndarray, limit: int, window: int) -> np.ndarray:
    """Allowed flag per request of one client; ``instants`` sorted, repeats allowed.

    A request at the last recorded instant shares its record.
    """
    distinct, first, which = np.unique(instants, return_index=True, return_inverse=True)
    repeat = np.ones(len(instants), dtype=np.int64)
    if len(log) and len(distinct) and distinct[0] == log[-1]:
        log, first = log[:-1], first[1:]
    held = _recorded_before(distinct, log, limit, window)[which]
    repeat[first] = 0
    return held + repeat < limit


def log_after(instants: np.ndarray, log: np.ndarray, limit: int, window: int) -> np.ndarray:
    """The last ``limit`` recorded instants, once ``instants`` (sorted, repeats allowed) are decided."""
    distinct = np.unique(instants)
    if len(log) and len(distinct) and distinct[0] == log[-1]:
        log = log[:-1]
    return np.concatenate([log, distinct[_accept(distinct, log, limit, window)]])[-limit:]


class Table(NamedTuple):
    """Where single accepted instants lead: ``entry``, the number ``steps`` of instants accepted after it, and the last of them.

    ``tail`` (a row for each entry) ends with the last accepted instant and
    holds the entry itself where it is long enough, -1 before that. The last
    entry is the first own instant; it stands for "nothing recorded".
    """

    entry: np.ndarray
    steps: np.ndarray
    tail: np.ndarray


def _transfer_table(before: np.ndarray, own: np.ndarray, limit: int, window: int, keep: int) -> Table:
    """Where each instant of the preceding window, accepted alone, leads up to the chunk's end, with tails of ``keep``.

    Runs of entries with equal outcome give one row.
    """
    line = np.concatenate([before, own])
    n, entries = len(line), len(before) + 1
    free_at = np.append(np.searchsorted(line, line + window), n)
    line = np.append(line, 0)
    steps = np.full(entries, -1)
    tails = np.full((entries, keep), -1, dtype=np.int64)
    for lo in range(0, entries, ENTRIES):
        at = np.arange(lo, min(lo + ENTRIES, entries))
        _follow(at, line, free_at, limit, steps[lo : lo + ENTRIES], tails[lo : lo + ENTRIES])
    return _rows(line[:entries], steps, tails)


def _follow(at: np.ndarray, line: np.ndarray, free_at: np.ndarray, limit: int, steps: np.ndarray, tails: np.ndarray) -> None:
    """Fill ``steps`` and ``tails`` for entries at these positions of ``line``."""
    n, keep = len(line) - 1, tails.shape[1]
    ring = np.full((keep, len(at)), n)
    ring[0] = at
    step = 0
    while (steps < 0).any():
        step += 1
        at = np.minimum(at + 1, n)
        if step >= limit:
            at = np.maximum(at, free_at[ring[(step - limit) % keep]])
        ended = np.flatnonzero((at >= n) & (steps < 0))
        if len(ended):
            steps[ended] = step - 1
            have = min(step, keep)
            order = np.arange(step - have, step) % keep
            tails[ended, keep - have:] = line[ring[order][:, ended]].T
        ring[step % keep] = at


def _rows(entries: np.ndarray, steps: np.ndarray, tails: np.ndarray) -> Table:
    """A table with one row for each run of entries of equal outcome; the last entry stays apart."""
    new = np.ones(len(entries), dtype=bool)
    new[1:-1] = (steps[1:-1] != steps[:-2]) | (tails[1:-1] != tails[:-2]).any(axis=1)
    return Table(entries[new], steps[new], tails[new])


def _advance(table: Table, logs: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each log (a row; sorted, -1 before shorter ones) leads: how many instants are accepted, and the last ``keep``.

    What the log itself holds counts to these when fewer are accepted. The
    tails of ``table`` must be as long as ``keep`` and a log together.
    """
    entries, steps, tails = table
    n, width = logs.shape
    missing = (logs < 0).sum(axis=1)
    rows = np.full((n, width + 1), len(entries) - 1)
    rows[:, :width] = np.maximum(np.searchsorted(entries[:-1], logs, side="right") - 1, 0)
    # Numbered from each log's first instant; the last column stands for the next one if nothing hinders it.
    offset = np.arange(width + 1) - missing[:, None]
    ends = np.where(offset >= 0, offset + steps[rows], np.iinfo(np.int64).max)
    last = ends.min(axis=1)
    own = np.append(logs, np.full((n, 1), -1), axis=1)
    out = np.full((n, keep), -1, dtype=np.int64)
    for back in range(keep):
        index = (last - back)[:, None]
        place = tails.shape[1] - 1 - (ends - index)
        reached = (offset >= 0) & (index >= offset)
        if (reached & (place < 0)).any():
            raise ValueError("transfer table too short for this log")
        value = np.where((index == offset) & (own >= 0), own, tails[rows, np.clip(place, 0, tails.shape[1] - 1)])
        out[:, keep - 1 - back] = np.where(reached, value, -1).max(axis=1)
    return last - (width - missing) + 1, out


def _leave(table: Table, log: np.ndarray, limit: int) -> np.ndarray:
    """Last ``limit`` accepted instants at a chunk's end, given the log at its start."""
    out = _advance(table, log[None, -limit:], limit)[1][0]
    return out[out >= 0]


def _extend(whole: Table | None, table: Table, start: int, limit: int, window: int, keep: int) -> Table:
    """A table with the one after it, which begins at ``start``: the entries of the first, their outcome at the end of the second."""
    if whole is None:
        return Table(table.entry, table.steps, table.tail[:, -keep:])
    entries, steps, tails = whole
    more, out = np.empty(len(entries), dtype=np.int64), np.empty((len(entries), keep), dtype=np.int64)
    for lo in range(0, len(entries), ENTRIES):
        some = slice(lo, lo + ENTRIES)
        logs = np.where(tails[some, -limit:] > start - window, tails[some, -limit:], -1)
        more[some], out[some] = _advance(table, logs, keep)
    # Instants that have left the log are still among the last ones.
    for back in range(1, keep):
        short = np.flatnonzero(more == back)
        out[short, : keep - back] = tails[short, back:]
    none = more == 0
    out[none] = tails[none]
    return Table(entries, steps + more, out)


def _compose(tables: list[Table], starts: list[int], limit: int, window: int, keep: int) -> Table:
    """One table for neighbouring ones."""
    whole = None
    for table, start in zip(tables, starts):
        whole = _extend(whole, table, start, limit, window, keep)
    return _rows(*whole)


# -- frames ------------------------------------------------------------------------------


def _whole_groups(frames: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Re-cut sorted frames so that no key is spread over two of them."""
    held: list[pd.DataFrame] = []
    for frame in frames:
        if frame.empty:
            continue
        is_last = (frame[keys] == frame[keys].iloc[-1]).all(axis=1).to_numpy()
        cut = int(is_last.argmax())
        if cut == 0:
            if held and not (held[-1][keys].iloc[-1] == frame[keys].iloc[0]).all():
                yield pd.concat(held, ignore_index=True)
                held = []
            held.append(frame)
        else:
            yield pd.concat([*held, frame.iloc[:cut]], ignore_index=True)
            held = [frame.iloc[cut:]]
    if held:
        yield pd.concat(held, ignore_index=True)


def _starts(frame: pd.DataFrame, keys: list[str]) -> np.ndarray:
    """First row of each group in a sorted frame."""
    changed = (frame[keys] != frame[keys].shift()).any(axis=1).to_numpy()
    return np.flatnonzero(changed)


def _groups(frame: pd.DataFrame, keys: list[str]) -> Iterator[slice]:
    starts = _starts(frame, keys)
    for begin, end in zip(starts.tolist(), np.append(starts[1:], len(frame)).tolist()):
        yield slice(begin, end)


def _chunks(frame: pd.DataFrame) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First row, preceding instants and own ones of each chunk."""
    own, us = frame["_own"].to_numpy(), frame["_us"].to_numpy()
    for rows in _groups(frame, ["client_key", "_chunk"]):
        at, mine = us[rows], own[rows]
        yield rows.start, at[~mine], at[mine]


def _as_frame(clients: list[str], chunks: list[int], tables: list[Table], starts: list[int]) -> pd.DataFrame:
    sizes = [len(t.entry) for t in tables]
    repeated = lambda x: np.repeat(np.array(x, dtype=np.int64), sizes)
    return pd.DataFrame(
        {
            "client_key": np.repeat(np.array(clients, dtype=object), sizes), "_chunk": repeated(chunks),
            "entry": np.concatenate([t.entry for t in tables]), "steps": np.concatenate([t.steps for t in tables]),
            "tail": [row for t in tables for row in t.tail], "start": repeated(starts),
        }
    )


def _as_frames(found: Iterator[tuple[str, int, Table, int]]) -> Iterator[pd.DataFrame]:
    """The rows of tables (client, number, table, start), about ``ENTRIES`` in a frame."""
    held, rows = [], 0
    for client, chunk, table, start in found:
        for lo in range(0, len(table.entry), ENTRIES):
            part = Table(*(column[lo : lo + ENTRIES] for column in table))
            held.append((client, chunk, part, start))
            rows += len(part.entry)
            if rows >= ENTRIES:
                yield _as_frame(*map(list, zip(*held)))
                held, rows = [], 0
    if held:
        yield _as_frame(*map(list, zip(*held)))


def _tables(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[str, int, int, Table, int, np.ndarray]]:
    """Client, group, number, table, start and known log of each chunk in sorted rows, one at a time.

    Rows that are ``_known`` belong to no table; they are the log at the start
    of their group, whose tables come after them.
    """
    held, place, known_of, known = [], None, None, []

    def whole():
        log = np.concatenate(known) if known and known_of == place[:2] else np.empty(0, dtype=np.int64)
        return *place[:3], Table(*(np.concatenate(c) for c in zip(*held))), place[3], log

    for frame in frames:
        if frame.empty:
            continue
        names, group, chunk, start, entry, steps = (frame[c].to_numpy() for c in ("client_key", "_group", "_chunk", "start", "entry", "steps"))
        tails = frame["tail"].to_numpy()
        given = frame["_known"].to_numpy() if "_known" in frame else np.zeros(len(frame), dtype=bool)
        for rows in _groups(frame, ["client_key", "_group", "_chunk"]):
            at = names[rows.start], int(group[rows.start]), int(chunk[rows.start]), int(start[rows.start])
            if held and place != at:
                yield whole()
                held = []
            if given[rows.start]:
                known_of, known = at[:2], [*(known if known_of == at[:2] else []), entry[rows]]
            else:
                place = at
                held.append((entry[rows], steps[rows], np.stack(tails[rows])))
    if held:
        yield whole()


def _tabulate(limit: int, window: int, keep: int):
    def each(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[str, int, Table, int]]:
        for frame in _whole_groups(frames, ["client_key", "_chunk"]):
            for row, before, own in _chunks(frame):
                start = int(own[0]) // window * window
                table = _transfer_table(before[(before > start - window) & (before < own[0])], own, limit, window, keep)
                yield frame["client_key"].iat[row], frame["_chunk"].iat[row], table, start

    return lambda frames: _as_frames(each(frames))


def _compose_groups(limit: int, window: int, keep: int):
    def each(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[str, int, Table, int]]:
        for (client, group), tables in groupby(_tables(frames), key=lambda t: t[:2]):
            whole = first = None
            for _, _, _, table, start, _ in tables:
                first = start if whole is None else first
                whole = _extend(whole, table, start, limit, window, keep)
            yield client, group, _rows(*whole), first

    return lambda frames: _as_frames(each(frames))


def _walk(limit: int, window: int):
    """The log at each table's start, from that at the start of its group (``_known`` rows, which come first)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for (client, _), tables in groupby(_tables(frames), key=lambda t: t[:2]):
            chunks, logs, log = [], [], None
            for _, _, chunk, table, start, known in tables:
                log = known[-limit:] if log is None else log
                log = log[log > start - window]
                chunks.append(chunk)
                logs.append(log)
                # A table's last entry is its first own instant, which an earlier batch may have recorded.
                log = _leave(table, log[log < table.entry[-1]], limit)
            yield pd.DataFrame({
                "client_key": client, "_chunk": np.repeat(np.array(chunks, dtype=np.int64), [len(x) for x in logs]), "_us": np.concatenate(logs),
            })

    return run


def _decide_chunks(limit: int, window: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in _whole_groups(frames, ["client_key", "_chunk"]):
            own = frame["_own"].to_numpy()
            held, shared = np.zeros(len(frame), dtype=np.int64), np.zeros(len(frame), dtype=bool)
            for row, log, instants in _chunks(frame):
                if not len(instants):
                    continue
                at = slice(row + len(log), row + len(log) + len(instants))
                if len(log) and log[-1] == instants[0]:
                    log, shared[at.start] = log[:-1], True
                # Where no window has more than `limit` instants, all are recorded and no walk is needed.
                if len(log) or (len(instants) > limit and (instants[limit:] - instants[:-limit] < window).any()):
                    held[at] = _recorded_before(instants, log, limit, window)
                else:
                    held[at] = np.arange(len(instants)) - np.searchsorted(instants, instants - window, side="right")
            yield pd.DataFrame({"client_key": frame["client_key"][own], "_us": frame["_us"][own], "_held": held[own], "_shared": shared[own]})

    return run


# -- tables ------------------------------------------------------------------------------


def _span(window: int) -> Column:
    return F.call_function("div", floor_micros(F.col("_us"), window), F.lit(window).cast("bigint"))


def _large_clients(asked: DataFrame, window: int, chunk_rows: int) -> DataFrame:
    """The chunk of every window of a client with more than one, and the chunk that the window leads to.

    A chunk is a run of whole windows with about ``chunk_rows`` requests. One
    window pass sees a row per client and window, however many requests.
    """
    by_client = Window.partitionBy("client_key").orderBy("_span")
    upto = F.sum("_n").over(by_client)
    spans = (
        asked.groupBy("client_key", _span(window).alias("_span"))
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(
            "client_key", "_span",
            F.floor((upto - F.col("_n")) / chunk_rows).alias("_chunk"),
            F.floor(upto / chunk_rows).alias("_next"),
            F.lead("_span").over(by_client).alias("_next_span"),
            F.sum("_n").over(by_client.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_total"),
        )
    )
    leads_to = F.when((F.col("_next_span") == F.col("_span") + 1) & (F.col("_next") != F.col("_chunk")), F.col("_next"))
    return spans.filter(F.col("_total") > chunk_rows).select("client_key", "_span", "_chunk", leads_to.alias("_leads_to"))


def _in_chunks(rows: DataFrame) -> DataFrame:
    return rows.repartition("client_key", "_chunk").sortWithinPartitions("client_key", "_chunk", "_own", "_us")


def _entry_logs(chunked: DataFrame, first: DataFrame, last_chunk: int, limit: int, window: int, fan: int) -> DataFrame:
    """The log at the start of each chunk, up the tree of tables and down again."""
    rounds, n = 0, last_chunk + 1
    while n > fan:
        rounds, n = rounds + 1, -(-n // fan)
    schema = "client_key string, _chunk bigint, entry bigint, steps bigint, tail array<bigint>, start bigint"
    group = F.call_function("div", F.col("_chunk"), F.lit(fan).cast("bigint"))
    keep = (2 + rounds) * limit
    levels = [materialize(_in_chunks(chunked).mapInPandas(_tabulate(limit, window, keep), schema), "limiter-tables")]
    for _ in range(rounds):
        keep -= limit
        grouped = levels[-1].withColumn("_group", group).repartition("client_key", "_group")
        above = grouped.sortWithinPartitions("client_key", "_group", "_chunk", "entry").mapInPandas(_compose_groups(limit, window, keep), schema)
        levels.append(materialize(above, "limiter-tables"))
    zero = F.lit(0).cast("bigint")
    logs = first.select("client_key", zero.alias("_chunk"), "_us")
    for level in reversed(levels):
        known = logs.select(
            "client_key", F.lit(-1).cast("bigint").alias("_chunk"), F.col("_us").alias("entry"), zero.alias("steps"), F.array().cast("array<bigint>").alias("tail"),
            zero.alias("start"), F.col("_chunk").alias("_group"), F.lit(True).alias("_known"),
        )
        rows = level.withColumns({"_group": group, "_known": F.lit(False)}).unionByName(known)
        ordered = rows.repartition("client_key", "_group").sortWithinPartitions("client_key", "_group", F.desc("_known"), "_chunk", "entry")
        logs = ordered.mapInPandas(_walk(limit, window), "client_key string, _chunk bigint, _us bigint")
    return logs


def _held(asked: DataFrame, before: DataFrame, limit: int, window: int, chunk_rows: int, fan: int) -> DataFrame:
    """``client_key``, ``_us``, the number ``_held`` of records in the window before it, and whether an earlier batch recorded it."""
    large = _large_clients(asked, window, chunk_rows)
    last_chunk = large.agg(F.max("_chunk")).first()[0]
    instants = asked.select("client_key", "_us").distinct()
    zero = F.lit(0).cast("bigint")
    earlier = before.select("client_key", zero.alias("_chunk"), F.lit(False).alias("_own"), "_us")
    if last_chunk is None:
        own = instants.select("client_key", zero.alias("_chunk"), F.lit(True).alias("_own"), "_us")
        rows = own.unionByName(earlier)
    else:
        large = materialize(large, "limiter-chunks")
        placed = materialize(instants.withColumn("_span", _span(window)).join(large, ["client_key", "_span"], "left"), "limiter-instants")
        own = placed.select("client_key", F.coalesce("_chunk", zero).alias("_chunk"), F.lit(True).alias("_own"), "_us")
        # An instant exactly one window before a chunk has expired when it starts.
        led = placed.filter(F.col("_leads_to").isNotNull() & (F.col("_us") != F.col("_span") * window))
        led = led.select("client_key", F.col("_leads_to").alias("_chunk"), F.lit(False).alias("_own"), "_us")
        clients = large.select("client_key").distinct()
        of_large = own.join(clients, "client_key", "left_semi").unionByName(led)
        first = earlier.join(clients, "client_key", "left_semi")
        logs = _entry_logs(of_large.unionByName(first), first, last_chunk, limit, window, fan)
        # The walk gives the first chunk of a large client its log too.
        small = earlier.join(clients, "client_key", "left_anti")
        rows = own.unionByName(small).unionByName(logs.withColumn("_own", F.lit(False)))
    return _in_chunks(rows).mapInPandas(_decide_chunks(limit, window), "client_key string, _us bigint, _held bigint, _shared boolean")


def _asked(requests: DataFrame, before: DataFrame) -> DataFrame:
    """Requests with client, instant and a row number, written, so that a row keeps its number when it is read again."""
    asked = requests.withColumns(
        {
            "client_key": F.coalesce("client_key", F.lit(UNKNOWN_CLIENT)),
            "_us": epoch_micros(F.col("requested_at")),
            "_row": F.monotonically_increasing_id(),
        }
    )
    latest = before.groupBy("client_key").agg(F.max("_us").alias("_latest"))
    known = F.when(F.col("_us").isNotNull(), F.greatest("_us", "_latest"))
    return materialize(asked.join(latest, "client_key", "left").withColumn("_us", known).drop("_latest"), "limiter-requests")


def _answers(asked: DataFrame, held: DataFrame, limit: int, id_col: str, columns: list[str]) -> DataFrame:
    firsts = asked.filter("_us IS NOT NULL").groupBy("client_key", "_us").agg(F.min(F.struct(id_col, "_row"))["_row"].alias("_first"))
    decided = held.join(firsts, ["client_key", "_us"])
    is_repeat = (F.col("_shared") | (F.col("_row") != F.col("_first"))).cast("bigint")
    return (
        asked.join(decided, ["client_key", "_us"], "left")
        .withColumn("allowed", F.col("_held") + is_repeat < limit)
        .select(*columns, "allowed")
    )


def _none_allowed(requests: DataFrame) -> DataFrame:
    return requests.withColumn("allowed", F.when(F.col("requested_at").isNotNull(), F.lit(False)))


def empty_log(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], LOG)


def rate_limit_after(requests: DataFrame, log: DataFrame | None, limit: int = RATE_LIMIT, window_seconds: float = RATE_WINDOW_SECONDS,
                     id_col: str = "request_id", chunk_rows: int = CHUNK_ROWS, fan: int = FAN,
                     idle_seconds: float = IDLE_SECONDS) -> tuple[DataFrame, DataFrame]:
    """(requests with ``allowed``, the log for the next batch), starting from an earlier batch's ``log``.

    A log has at most ``limit`` accepted instants per client (``client_key``,
    ``accepted_at``); a client whose last one is ``idle_seconds`` (a window at
    least) before the batch's latest request leaves it. Batches come one after
    the other: a request before its client's last accepted instant is decided as
    of that instant, as a service does that goes by its own clock.
    """
    log = empty_log(requests.sparkSession) if log is None else log
    if limit < 1:
        return _none_allowed(requests), log
    window = int(window_seconds * 1_000_000)
    before = log.select("client_key", epoch_micros(F.col("accepted_at")).alias("_us"))
    asked = _asked(requests, before)
    timed = asked.filter("_us IS NOT NULL")
    held = materialize(_held(timed, before, limit, window, chunk_rows, fan), "limiter-held")
    accepted = held.filter(F.col("_held") < limit).select("client_key", "_us").union(before).distinct()
    idle = int(max(idle_seconds, window_seconds) * 1_000_000)
    as_of = timed.agg(F.max("_us")).first()[0] or 0
    latest = accepted.groupBy("client_key").agg(F.max("_us").alias("_latest")).filter(F.col("_latest") > as_of - idle)
    kept = accepted.join(latest, "client_key").filter(F.col("_us") > F.col("_latest") - window)
    newest = F.row_number().over(Window.partitionBy("client_key").orderBy(F.desc("_us")))
    kept = kept.withColumn("_n", newest).filter(F.col("_n") <= limit)
    return _answers(asked, held, limit, id_col, requests.columns), kept.select("client_key", from_epoch_micros(F.col("_us")).alias("accepted_at"))


def rate_limit(requests: DataFrame, limit: int = RATE_LIMIT, window_seconds: float = RATE_WINDOW_SECONDS,
               id_col: str = "request_id", chunk_rows: int = CHUNK_ROWS, fan: int = FAN) -> DataFrame:
    """Add ``allowed`` to requests (``client_key``, ``requested_at``, ``id_col``).

    Requests are decided in order of time, then id, then row; a request id that
    occurs twice is two requests. A request without time cannot be placed and
    gets a NULL ``allowed``; it uses no quota. ``chunk_rows`` and ``fan`` change
    how the work is split and no decision. Memory: a task holds one chunk's
    instants and, for a client with several chunks, two tables: some ``4 * limit``
    numbers for each instant of one window, ``limit`` more for each round of
    composing. Their number does not count, as they are read one after the other.
    """
    if limit < 1:
        return _none_allowed(requests)
    window = int(window_seconds * 1_000_000)
    before = empty_log(requests.sparkSession).select("client_key", epoch_micros(F.col("accepted_at")).alias("_us"))
    asked = _asked(requests, before)
    held = _held(asked.filter("_us IS NOT NULL"), before, limit, window, chunk_rows, fan)
    return _answers(asked, held, limit, id_col, requests.columns)


def limit_by_client(decisions: DataFrame) -> DataFrame:
    return decisions.groupBy("client_key").agg(
        F.count(F.lit(1)).alias("requests"),
        F.count_if("allowed").alias("allowed"),
        F.count_if(~F.col("allowed")).alias("throttled"),
    )
