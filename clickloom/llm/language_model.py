"""Scores of texts under a bigram model, held as a weighted backoff automaton.

A state is a history that training saw (one token, or the start of a text); its
arcs are the tokens seen after it, weighted with their smoothed probability. A
token without arc takes the failure arc, whose weight is the mass that
discounting left to the history, to the state without history, where every
token has an arc. One pass over a text carries the state and adds up.

The whole automaton is nowhere in one piece. A chunk of documents asks the parts
of the hash space for the counts of its own bigrams and tokens, which are all
arcs that its texts can take, and walks the automaton made of those.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from clickloom.llm import exchange as X
from clickloom.llm.textbytes import SPACED, buffers, mix

DISCOUNT = 0.75
FOLDS, HELD_OUT = 5, 1

U64 = np.uint64
START, END = U64(0x51A27), U64(0xE2D)


class _Chunk:
    """A chunk's tokens: each with the state before it, and the distinct arcs and tokens among them."""

    def __init__(self, table: pa.Table) -> None:
        table = X.ordered(table)
        self.ids = table["doc_id"]
        self.number = table["chunk"][0].as_py()
        self.held_out = np.array([zlib.crc32(b"" if i is None else str(i).encode()) % FOLDS == HELD_OUT for i in self.ids.to_pylist()])
        words, at = SPACED.hashes(*buffers(table["text"]))
        self.tokens = np.insert(words, at[1:], END)
        self.history = np.insert(words, at[:-1], START)
        self.sizes = np.diff(at) + 1
        learned = np.repeat(~self.held_out, self.sizes)
        self.arcs, first, self.arc_of = np.unique(mix(mix(self.history) + self.tokens), return_index=True, return_inverse=True)
        self.arc_count = np.bincount(self.arc_of[learned], minlength=len(self.arcs)).astype(U64)
        self.states = np.unique(np.append(self.tokens, START))
        self.token_of = np.searchsorted(self.states, self.tokens)
        self.history_of = np.searchsorted(self.states, self.history)
        self.count = np.bincount(self.token_of[learned], minlength=len(self.states)).astype(U64)
        self.count[np.searchsorted(self.states, START)] = (~self.held_out).sum()
        self.from_state = self.history_of[first]


def _ask(chunk: int, keys: np.ndarray, values: list[np.ndarray], parts: int) -> pa.Table:
    """One row for each part, also where it is asked nothing: each answer brings the part's totals."""
    edges = np.searchsorted(X.part_of(keys, parts), np.arange(parts + 1))
    cut = [slice(a, b) for a, b in zip(edges[:-1], edges[1:])]
    columns = {"part": pa.array(range(parts), pa.int32()), "chunk": pa.array([chunk] * parts, pa.int32()),
               "keys": pa.array([X.pack_sorted(keys[s]) for s in cut], pa.binary())}
    for i, value in enumerate(values):
        columns[f"v{i}"] = pa.array([X.pack(value[s]) for s in cut], pa.binary())
    return pa.table(columns)


def _arcs(parts: int):
    def ask(table: pa.Table) -> pa.Table:
        own = _Chunk(table)
        return _ask(own.number, own.arcs, [own.arc_count], parts)

    return ask


_ANSWER = "kind int, chunk int, part int, a binary, b binary, tokens bigint, kinds bigint"
_ANSWER_SCHEMA = pa.schema([("kind", pa.int32()), ("chunk", pa.int32()), ("part", pa.int32()), ("a", pa.binary()), ("b", pa.binary()),
                            ("tokens", pa.int64()), ("kinds", pa.int64())])


def _gathered(table: pa.Table):
    """All chunks' keys and values, smallest chunk first, with each entry's distinct key."""
    table = table.sort_by("chunk")
    keys = [X.unpack_sorted(v) for v in table["keys"]]
    cuts = np.cumsum([len(k) for k in keys])[:-1]
    distinct, which = np.unique(np.concatenate(keys), return_inverse=True)
    return table, cuts, distinct, which


def _answer_arcs(table: pa.Table) -> pa.Table:
    """Each arc's count in training, and one chunk that had it there, which is to report it."""
    table, cuts, distinct, which = _gathered(table)
    count = np.concatenate([X.unpack(v, U64) for v in table["v0"]])
    total = np.bincount(which, count.astype(np.float64), len(distinct)).astype(U64)
    reports = np.full(len(distinct), len(which))
    seen = np.flatnonzero(count)
    np.minimum.at(reports, which[seen], seen)
    mine = reports[which] == np.arange(len(which))
    return pa.table({
        "kind": pa.array([0] * len(table), pa.int32()), "chunk": table["chunk"], "part": table["part"],
        "a": pa.array([X.pack(x) for x in np.split(total[which], cuts)], pa.binary()),
        "b": pa.array([X.pack(x) for x in np.split(mine, cuts)], pa.binary()),
        "tokens": pa.array([0] * len(table), pa.int64()), "kinds": pa.array([0] * len(table), pa.int64()),
    }, _ANSWER_SCHEMA)


def _joined(answers: pa.Table, kind: int, column: str, of) -> np.ndarray:
    rows = [(p, i) for i, (k, p) in enumerate(zip(answers["kind"].to_pylist(), answers["part"].to_pylist())) if k == kind]
    return np.concatenate([np.zeros(0, of), *(X.unpack(answers[column][i], of) for _, i in sorted(rows))])


def _states(parts: int):
    def ask(docs: pa.Table, answers: pa.Table) -> pa.Table:
        """The chunk's tokens, with their counts and how many arcs it reports for each as a state."""
        own = _Chunk(docs)
        mine = _joined(answers, 0, "b", bool)
        followers = np.bincount(own.from_state[mine], minlength=len(own.states)).astype(U64)
        return _ask(own.number, own.states, [own.count, followers], parts)

    return ask


def _answer_states(table: pa.Table) -> pa.Table:
    table, cuts, distinct, which = _gathered(table)
    both = []
    for column in ("v0", "v1"):
        value = np.concatenate([X.unpack(v, U64) for v in table[column]])
        both.append(np.bincount(which, value.astype(np.float64), len(distinct)).astype(U64))
    token = distinct != START
    n, kinds = int(both[0][token].sum()), int((both[0][token] > 0).sum())
    return pa.table({
        "kind": pa.array([1] * len(table), pa.int32()), "chunk": table["chunk"], "part": table["part"],
        "a": pa.array([X.pack(x) for x in np.split(both[0][which], cuts)], pa.binary()),
        "b": pa.array([X.pack(x) for x in np.split(both[1][which], cuts)], pa.binary()),
        "tokens": pa.array([n] * len(table), pa.int64()), "kinds": pa.array([kinds] * len(table), pa.int64()),
    }, _ANSWER_SCHEMA)


def _walk(discount: float):
    def walk(docs: pa.Table, answers: pa.Table) -> pa.Table:
        own = _Chunk(docs)
        n, kinds = (sum(x or 0 for x in answers[c].to_pylist()) for c in ("tokens", "kinds"))
        count, followers = _joined(answers, 1, "a", U64).astype(np.float64), _joined(answers, 1, "b", U64).astype(np.float64)
        arc_count = _joined(answers, 0, "a", U64).astype(np.float64)
        base = np.log10((count + 0.5) / (n + 0.5 * (kinds + 1)))  # arcs of the state without history
        known = count > 0
        with np.errstate(divide="ignore", invalid="ignore"):
            fail = np.where(known, np.log10(discount * followers / count), 0.0)  # failure arcs; an unknown state is the one without history
            through = np.maximum(arc_count - discount, 0) / count[own.from_state]
        # An arc weighs what it was seen and its share of what the failure arc leads to.
        base_of, fail_of = base[own.token_of], fail[own.history_of]
        behind = fail_of + base_of
        seen = (arc_count > 0)[own.arc_of]
        weight = behind.copy()
        weight[seen] = np.log10(through[own.arc_of[seen]] + 10 ** behind[seen])
        at = np.cumsum(own.sizes) - own.sizes
        return pa.table({
            "doc_id": own.ids.cast(pa.int64()), "held_out": pa.array(own.held_out, pa.bool_()),
            "n_tokens": pa.array(own.sizes, pa.int64()),
            "n_known": pa.array(np.add.reduceat(known[own.token_of].astype(np.int64), at), pa.int64()),
            "train_tokens": pa.array([n] * len(own.sizes), pa.int64()),
            "base_score": pa.array(np.add.reduceat(base_of, at), pa.float64()), "score": pa.array(np.add.reduceat(weight, at), pa.float64()),
        })

    return walk


def scores(docs: DataFrame, discount: float = DISCOUNT, chunk_bytes: int = X.CHUNK_BYTES, part_bytes: int = X.PART_BYTES) -> DataFrame:
    """The log10 probability of each text under a bigram model of the training texts.

    Reads ``doc_id`` and ``text``; other columns play no part. Training texts
    are those with crc32 of the id's digits mod 5 other than 1. Tokens are words
    between blanks (A-Z lowered) and one end. p(w) = (c + 0.5) / (N + 0.5 (V +
    1)); after a history h that training saw, p(w | h) = (max(c(h w) - discount,
    0) + discount * followers(h) * p(w)) / c(h), which sums to 1. Each row gives
    one: doc_id, held_out, n_tokens, n_known (tokens that training saw),
    train_tokens (N), base_score (by p(w) alone) and score. A null or blank
    text is an end only. A null id counts as an empty one, whose remainder is
    0. Rows with one id are texts of their own. An empty table gives none, one
    without training texts scores by p(w) = 1. Counts are exact below 2**53.
    """
    chunks, parts = X.counts(X.text_bytes(docs), chunk_bytes, part_bytes)
    by_chunk = X.chunked(docs, chunks).groupBy("chunk")
    arcs = by_chunk.applyInArrow(_arcs(parts), "part int, chunk int, keys binary, v0 binary")
    arc_answers = arcs.groupBy("part").applyInArrow(_answer_arcs, _ANSWER)
    states = by_chunk.cogroup(arc_answers.groupBy("chunk")).applyInArrow(_states(parts), "part int, chunk int, keys binary, v0 binary, v1 binary")
    state_answers = states.groupBy("part").applyInArrow(_answer_states, _ANSWER)
    answers = arc_answers.union(state_answers)
    return by_chunk.cogroup(answers.groupBy("chunk")).applyInArrow(
        _walk(discount),
        "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
