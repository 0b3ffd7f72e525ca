"""Secrets in texts: fixed patterns, and values in a credential context that are hard to guess.

1. Texts that a cheap test of the whole batch lets through are searched for the
   three fixed patterns (``assign``, ``access``, ``hex``) and for values that
   stand where a credential does: after a word for one and ``:``, ``=`` or
   ``is``, after ``bearer``, or before the ``@`` of an address.
2. Each distinct value gets its guess cost: the cheapest cut into dictionary
   words, dates, repeats, keyboard walks and single characters (``guess_cost``).
   The dictionary is the corpus itself: runs of letters in all texts, with their
   counts; what stands in the values is taken off again, so that no secret
   makes itself a word. Words are counted and looked up as 64-bit hashes by
   shuffles of (word, number) rows, and only readings of values are looked up.
3. A value that takes ``10 ** GUESSES`` guesses or more is a ``guess`` span of
   its own, beside whatever fixed pattern it stands in. A value that is easier
   (``password: password1``, ``the secret is wonderful``) adds nothing.

Only texts with values take part in a shuffle, without their text. A value that
occurs in many texts is judged once.

A null or empty text has no spans. Repeated rows, null ids and equal ids are
rows of their own; an empty table gives an empty result. A text is searched
whole by one task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from clickloom.llm import guess_cost
from clickloom.llm.blocks import blocks
from clickloom.llm.textbytes import Words, buffers
from clickloom.session import materialize

#: Kinds of spans, in the order in which spans with one start are listed.
KINDS = ("assign", "access", "hex", "guess")
#: Values that take fewer than 10 to this power guesses are no secrets.
GUESSES = 10.0
#: Values of fewer characters are not judged.
SHORTEST = 6
#: Bytes of text whose words are counted at once.
BLOCK = 1 << 20
#: Readings of values sent on at once.
READINGS = 20_000

# The patterns of the three kinds. A-Z and a-z only are alike.
_ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")

_NAMES = r"(?:pass(?:word|wd|phrase|code)?|pwd|secret|credentials?|(?:api|access|auth|private|secret)[_-]?(?:key|token)|token|login|pin)"
_AFTER = r"""["']?[\x20\t]*(?::=|=>|[:=]|(?<=[\x20\t])is(?=[\x20\t]))[\x20\t]*"""
_VALUE = r"""(?:"(?P<double>[^"\r\n]*)"|'(?P<single>[^'\r\n]*)'|["']?(?P<bare>[^\x20\x09-\x0D"'<>]+))"""
_CONTEXT = re.compile(rf"(?:(?<![A-Za-z]){_NAMES}{_AFTER}|(?<![A-Za-z])bearer[\x20\t]+){_VALUE}|://[^\x20\x09-\x0D/:@]*:(?P<address>[^\x20\x09-\x0D/@]+)@", re.I | re.A)
#: What any text with a span holds.
_HINT = (
    r"""AKIA[A-Z0-9]{16}|[0-9a-f]{24}|://[^\x20\x09-\x0D/:@]*:|(?i:bearer)[\x20\t]"""
    r"""|(?i:pass|word|wd|phrase|code|pwd|secret|credentials?|key|token|login|pin)["']?[\x20\t]*(?:[:=]|(?i:is)[\x20\t])"""
)
_TRAILING = ".,;:!?)]}"

_SPAN = "array<struct<start:bigint,kind:int,end:bigint>>"
_FOUND = "array<struct<start:bigint,end:bigint,value:string>>"


def _letters() -> np.ndarray:
    word = np.zeros(256, bool)
    word[0x61:0x7B] = word[0x80:] = True
    return word


LETTERS = Words(_letters())


def fixed_spans(text: str) -> list[tuple[int, int, int]]:
    """Start, kind and end of the spans of the three fixed patterns, by start, then kind."""
    found = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m.group(1)) >= SHORTEST]
    found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    return sorted(found + [(m.start(), 2, m.end()) for m in _HEX.finditer(text)])


def credential_values(text: str) -> list[tuple[int, int, str]]:
    """Start, end and text of the values in a credential context."""
    found = []
    for m in _CONTEXT.finditer(text):
        value = m.group(m.lastgroup)
        if m.lastgroup in ("bare", "address"):
            value = value.rstrip(_TRAILING)
        if len(value) >= SHORTEST:
            start = m.start(m.lastgroup)
            found.append((start, start + len(value), value))
    return found


def _lists(rows: list[list[tuple]], which: np.ndarray, n: int, names: list[str], kinds: list[pa.DataType]) -> pa.Array:
    """A list for each of n rows: that of row ``which[i]`` is ``rows[i]``, all others are empty."""
    sizes = np.zeros(n + 1, np.int32)
    sizes[which + 1] = [len(r) for r in rows]
    flat = [x for r in rows for x in r]
    columns = [pa.array([x[i] for x in flat], kind) for i, kind in enumerate(kinds)]
    return pa.ListArray.from_arrays(pa.array(np.cumsum(sizes, dtype=np.int32)), pa.StructArray.from_arrays(columns, names))


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    long = pa.int64()
    for batch in batches:
        texts = batch.column("text").fill_null("")
        which = np.flatnonzero(pc.match_substring_regex(texts, _HINT).to_numpy(zero_copy_only=False))
        hits = [texts[int(i)].as_py() for i in which]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                _lists([fixed_spans(t) for t in hits], which, len(batch), ["start", "kind", "end"], [long, pa.int32(), long]),
                _lists([credential_values(t) for t in hits], which, len(batch), ["start", "end", "value"], [long, long, pa.string()]),
            ],
            ["doc_id", "_fixed", "_values"],
        )


def _hashes(words: list[str]) -> np.ndarray:
    return LETTERS.hashes(*buffers(pa.array(words, pa.string())))[0].view(np.int64)


def _count(block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, counts = [], []
            for _, data, offsets in blocks(batch, "text", block):
                for lo, hi, inner in LETTERS._blocks(data, offsets):
                    starts, ends = LETTERS.spans(data[lo:hi], inner)
                    fit = (ends - starts >= guess_cost.SHORTEST) & (ends - starts <= 4 * guess_cost.LONGEST)
                    name, n = np.unique(LETTERS._hashes(data[lo:hi], starts, ends)[fit], return_counts=True)
                    names.append(name)
                    counts.append(n)
            if names:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(names).view(np.int64)), pa.array(np.concatenate(counts))], ["word", "n"])

    return run


def _own_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(w, -n) for v, n in zip(batch.column("value").to_pylist(), batch.column("n").to_pylist()) for w in guess_cost.letter_runs(v)]
        yield pa.RecordBatch.from_arrays([pa.array(_hashes([w for w, _ in rows])), pa.array([n for _, n in rows], pa.int64())], ["word", "n"])


def _readings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = zip(batch.column("_id").to_pylist(), batch.column("value").to_pylist())
        rows = ((i, *reading) for i, value in values for reading in guess_cost.readings(value))
        while some := list(islice(rows, READINGS)):
            ids, starts, ends, words = zip(*some)
            arrays = [pa.array(x, pa.int64()) for x in (ids, starts, ends)] + [pa.array(words, pa.string()), pa.array(_hashes(list(words)))]
            yield pa.RecordBatch.from_arrays(arrays, ["_id", "start", "end", "read", "word"])


def _judge(total: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cost = []
            for value, words in zip(batch.column("value").to_pylist(), batch.column("words").to_pylist()):
                words = sorted((w["start"], w["end"], w["read"], w["n"] / total) for w in words or [])
                cost.append(guess_cost.guesses(value, words))
            yield pa.RecordBatch.from_arrays([batch.column("value"), pa.array(cost, pa.float64())], ["value", "cost"])

    return run


def guess_costs(docs: DataFrame, values: DataFrame, block: int = BLOCK) -> DataFrame:
    """``value`` and ``cost``, the base-10 logarithm of its guesses, of distinct ``values`` (``value``, ``n`` occurrences)."""
    values = materialize(values.withColumn("_id", F.monotonically_increasing_id()), "secret-values")
    counted = docs.select("text").mapInArrow(_count(block), "word bigint, n bigint")
    own = values.select("value", "n").mapInArrow(_own_words, "word bigint, n bigint")
    counted = counted.unionByName(own).groupBy("word").agg(F.sum("n").alias("n")).filter("n > 0")
    dictionary = materialize(counted, "secret-words")
    total = dictionary.agg(F.sum("n")).first()[0] or 1
    read = values.select("_id", "value").mapInArrow(_readings, "_id bigint, start bigint, end bigint, read string, word bigint")
    words = read.join(dictionary, "word").groupBy("_id").agg(F.collect_list(F.struct("start", "end", "read", "n")).alias("words"))
    return values.join(words, "_id", "left").select("value", "words").mapInArrow(_judge(total), "value string, cost double")


def secrets(docs: DataFrame, guesses: float = GUESSES, block: int = BLOCK) -> DataFrame:
    """``doc_id``, ``spans`` (start, kind as a place in ``KINDS``, end; code points, end exclusive) and ``values`` of each row.

    ``values``: start, end and guess cost of every value in a credential context, those that are easily guessed too.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = docs.select("doc_id", "text").mapInArrow(_search, f"doc_id {kind}, _fixed {_SPAN}, _values {_FOUND}")
    found = materialize(found.withColumn("_row", F.monotonically_increasing_id()), "secret-spans")
    some = found.filter(F.size("_values") > 0).select("_row", "doc_id", "_fixed", F.explode("_values").alias("_v"))
    costs = guess_costs(docs, some.groupBy(F.col("_v.value").alias("value")).agg(F.count(F.lit(1)).alias("n")), block)
    judged = some.withColumn("value", F.col("_v.value")).join(costs, "value").select(
        "_row", "doc_id", "_fixed", F.struct(F.col("_v.start").alias("start"), F.col("_v.end").alias("end"), "cost").alias("_v")
    )
    judged = judged.groupBy("_row").agg(F.any_value("doc_id").alias("doc_id"), F.any_value("_fixed").alias("_fixed"), F.array_sort(F.collect_list("_v")).alias("values"))
    none = found.filter(F.size("_values") == 0).select(
        "_row", "doc_id", "_fixed", F.array().cast("array<struct<start:bigint,end:bigint,cost:double>>").alias("values")
    )
    hard = F.transform(
        F.filter("values", lambda v: v["cost"] >= guesses),
        lambda v: F.struct(v["start"].alias("start"), F.lit(KINDS.index("guess")).alias("kind"), v["end"].alias("end")),
    )
    return judged.unionByName(none).select("doc_id", F.array_sort(F.array_distinct(F.concat("_fixed", hard))).alias("spans"), "values")


def secret_digests(found: DataFrame, guesses: float = GUESSES) -> DataFrame:
    """Per row of ``secrets``: numbers by kind, a digest of the fixed patterns' spans, and all spans as text."""
    names = F.array(*map(F.lit, KINDS))

    def text(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")

    def number(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == KINDS.index(kind))).cast("bigint").alias(f"n_{kind}")

    fixed = F.filter("spans", lambda s: s["kind"] != KINDS.index("guess"))
    return found.select(
        "doc_id", *map(number, KINDS),
        F.size(F.filter("values", lambda v: v["cost"] < guesses)).cast("bigint").alias("n_easy"),
        F.sha2(text(fixed), 256).alias("base_sha256"),
        text(F.col("spans")).alias("spans"),
    )
