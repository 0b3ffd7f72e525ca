"""Periodic runs of words by string synchronising sets.

A run is a maximal stretch of words that repeats with its smallest period at
least ``TIMES`` times. Scales t = 1, 2, 4, ... find the periods in [t, 2t):

1. every window of t words has a name (a hash, doubled from scale to scale).
   Position i is *synchronising* when the smallest name among the windows at
   i ... i + t is that of its first or its last window. This depends on the 2t
   words from i alone, so equal contexts of 2t words are chosen alike, and
   about 2 / t of all positions are;
2. windows inside a stretch of period t / 4 or less do not count, for there all
   positions would be alike. These stretches are the runs of small period that
   smaller scales have found already, so each scale passes them on;
3. within a run of period p in [t, 2t), any t neighbouring positions hold a
   synchronising one, and the next position with its context is p further on.
   So neighbouring equal contexts at a distance in [t, 2t) propose all periods,
   and the proposals of one run overlap: they are merged and then grown word by
   word to the run's ends, which are less than 2t words away.

All proposals of a scale are linear in n / t, so a text takes O(n log n).

A document is handled whole by one task, in about 100 bytes a word. A null, an
empty text or one without words has no runs and an empty collapsed text.
Repeated rows, null ids and equal ids are rows of their own; an empty table
gives an empty result. Words are compared by 64-bit hashes, case by case.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from clickloom.llm.blocks import blocks
from clickloom.llm.textbytes import SPACED, U64, Words, _stream, mix

#: A run has at least so many words, and so many times its period.
LEAST, TIMES = 6, 4
#: Bytes of text handled at once; a longer text is handled alone.
BLOCK = 1 << 20
#: Growing steps that all proposals take together, before the few longer ones go alone.
STEPS = 16


class _Cased(Words):
    """Words between blanks, A apart from a."""

    def __init__(self) -> None:
        super().__init__(SPACED.word)
        self.lower = np.arange(256, dtype=np.uint8)
        self.value = np.where(self.word, _stream(11, 256), U64(0))


CASED = _Cased()


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest of each ``width`` neighbours."""
    out, size = values, 1
    while 2 * size <= width:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    return np.minimum(out[: len(values) - width + 1], out[width - size :])


def synchronising(names: np.ndarray, t: int, small: np.ndarray) -> np.ndarray:
    """Synchronising positions, from the names of all windows of t words; ``small`` windows do not count."""
    none = np.iinfo(np.uint64).max
    key = np.where(small, none, names)
    least = _sliding_min(key, t + 1)
    return np.flatnonzero((least != none) & ((least == key[: len(least)]) | (least == key[t:])))


def _proposals(at: np.ndarray, context: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
    """Neighbours with equal context at a distance in [t, 2t): position and distance."""
    order = np.argsort(context[at], kind="stable")
    at = at[order]
    apart = np.diff(at)
    alike = (np.diff(context[at]) == 0) & (apart >= t) & (apart < 2 * t)
    return at[:-1][alike], apart[alike]


def _merged(at: np.ndarray, period: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Proposals of one period whose contexts touch, as stretches that equal themselves ``period`` further on."""
    order = np.lexsort((at, period))
    at, period = at[order], period[order]
    new = np.ones(len(at), bool)
    new[1:] = (period[1:] != period[:-1]) | (at[1:] > at[:-1] + 2 * t)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    return at[first], at[last] + 2 * t, period[first]


def _alone(text: np.ndarray, at: int, period: int) -> int:
    """How far the text equals itself ``period`` further on, from ``at``."""
    size = 64
    while True:
        further = text[at + period : at + period + size]
        wrong = np.flatnonzero(text[at : at + len(further)] != further)
        if len(wrong):
            return at + int(wrong[0])
        at += len(further)
        if len(further) < size:
            return at
        size *= 2


def _grown(text: np.ndarray, end: np.ndarray, period: np.ndarray) -> np.ndarray:
    """The ends of stretches that equal themselves ``period`` further on, moved right as far as this holds."""
    end, open_ = end.copy(), np.arange(len(end))
    for _ in range(STEPS):
        open_ = open_[end[open_] + period[open_] < len(text)]
        open_ = open_[text[end[open_]] == text[end[open_] + period[open_]]]
        if not len(open_):
            return end
        end[open_] += 1
    for i in open_:
        end[i] = _alone(text, int(end[i]), int(period[i]))
    return end


def find_runs(text: np.ndarray, longest: int, times: int = TIMES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and smallest period of each run of ``times`` periods or more, by start.

    ``text``: word names; no run is longer than ``longest`` words. ``times`` is 4 or more.
    """
    none = np.zeros(0, np.int64)
    start, end, period = none, none, none
    names, t = text, 1
    while times * t <= longest and len(text) >= 2 * t:
        small = np.zeros(len(names) + 1, np.int32)
        passed = (4 * period <= t) & (end - start >= t)
        np.add.at(small, start[passed], 1)
        np.add.at(small, end[passed] - t + 1, -1)
        at = synchronising(names, t, np.cumsum(small[:-1]) > 0)
        names = mix(names[:-t] * U64(0x9E3779B97F4A7C15) + names[t:])
        at, apart = _proposals(at, names, t)
        if len(at):
            low, high, q = _merged(at, apart, t)
            e = _grown(text, high, q) + q
            # The same to the left, on the text read backwards.
            b = len(text) - _grown(text[::-1], len(text) - low - q, q) - q
            kept = e - b >= times * q
            start, end, period = (np.concatenate(x) for x in ((start, b[kept]), (end, e[kept]), (period, q[kept])))
            order = np.lexsort((period, end, start))
            start, end, period = start[order], end[order], period[order]
            new = np.ones(len(start), bool)
            new[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
            start, end, period = start[new], end[new], period[new]
        t *= 2
    return start, end, period


def _rows(ids: pa.Array, data: np.ndarray, offsets: np.ndarray, least: int, times: int) -> pa.RecordBatch:
    n = len(ids)
    words, at = CASED.hashes(data, offsets)
    # A name of its own after each document: nothing repeats across it.
    text = np.empty(len(words) + n, np.uint64)
    stops = at[1:] + np.arange(n)
    held = np.ones(len(text), bool)
    held[stops] = False
    text[held] = words
    text[stops] = _stream(41, n)
    counts = np.diff(at)
    start, end, period = find_runs(text, int(counts.max(initial=0)), times)
    kept = end - start >= least
    start, end, period = start[kept], end[kept], period[kept]
    doc = np.searchsorted(stops, start)
    first = stops - counts
    order = np.lexsort((period, start))
    start, end, period, doc = start[order], end[order], period[order], doc[order]
    starts = np.searchsorted(doc, np.arange(n + 1))
    raw = data.tobytes()
    texts = []
    for i in range(n):
        own = raw[offsets[i] : offsets[i + 1]].split()
        if starts[i] < starts[i + 1]:
            dropped = np.zeros(len(own), bool)
            for r in range(starts[i], starts[i + 1]):
                dropped[start[r] + period[r] - first[i] : end[r] - first[i]] = True
            own = [w for w, gone in zip(own, dropped.tolist()) if not gone]
        texts.append(b" ".join(own))
    runs = pa.StructArray.from_arrays([pa.array(start - first[doc]), pa.array(end - start), pa.array(period)], ["start", "length", "period"])
    return pa.RecordBatch.from_arrays(
        [ids, pa.array(counts), pa.ListArray.from_arrays(pa.array(starts, pa.int32()), runs), pa.array(texts, pa.binary()).cast(pa.string())],
        ["doc_id", "n_words", "runs", "collapsed"],
    )


def periodic_runs(docs: DataFrame, least: int = LEAST, times: int = TIMES, block: int = BLOCK) -> DataFrame:
    """``doc_id``, ``n_words``, ``runs`` and ``collapsed`` of each row.

    ``runs``: start (word number), length and period of every run of at least
    ``least`` words and ``times`` periods (4 or more), by start, then period.
    ``collapsed``: the words joined by one blank, of each run only what no run
    repeats: a word goes if any run holds it after that run's first period.
    """
    if times < 4:
        raise ValueError("runs of less than four periods are not found by these scales")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in blocks(batch, "text", block):
                yield _rows(part.column("doc_id"), data, offsets, least, times)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"
    )


def repeat_tails(docs: DataFrame) -> DataFrame:
    """The documents, a tenth of them (by a hash of the id) with a tail that repeats itself.

    With h the crc32 of the id's digits and g = h div 10, a text of n words with
    h % 10 = 0 keeps its words before a = g % n; from there the first
    p = 1 + (n - a) div (3 + g % 8) words repeat to the end. Other texts, and
    those without id or words, stay as they are.
    """
    h = F.crc32(F.col("doc_id").cast("string"))
    g, n = F.expr("_h div 10"), F.size("_w")
    tail = F.expr("transform(sequence(0, size(_w) - 1), i -> element_at(_w, 1 + int(if(i < _a, i, _a + (i - _a) % _p))))")
    words = F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    return (
        docs.select("doc_id", "text", h.alias("_h"))
        .withColumn("_w", F.when(F.col("_h") % 10 == 0, words))
        .withColumn("_a", F.when(n > 0, g % n))
        .withColumn("_p", 1 + F.call_function("div", n - F.col("_a"), 3 + g % 8))
        .select("doc_id", F.when(n > 0, F.array_join(tail, " ")).otherwise(F.col("text")).alias("text"))
    )


def run_digests(found: DataFrame) -> DataFrame:
    """Per row of ``periodic_runs``: the number of runs, the longest, and digests of all runs and of what is left."""
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    digest: Column = F.sha2(F.concat_ws("", F.transform("runs", lambda r: F.concat(line(r), F.lit("\n")))), 256)
    return found.withColumn("_best", longest).select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        (-F.col("_best.start")).alias("start"),
        F.col("_best.length").alias("length"),
        (-F.col("_best.period")).alias("period"),
        F.expr("1000 * _best.length div -_best.period").alias("exponent_milli"),
        digest.alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
