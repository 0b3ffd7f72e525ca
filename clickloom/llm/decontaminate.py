"""Benchmark passages in documents, found by a suffix automaton of all items.

The automaton of a block of items accepts every run of words in any of them. A
document's words are read once, left to right, keeping the state and the length
of the longest suffix that some item has. Where this length reaches a window,
the words of the match are hit.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from clickloom.llm.textbytes import ALNUM, buffers
from clickloom.session import materialize

WINDOW = 13
#: A document is contaminated if one word in so many, or more, is hit.
ONE_IN = 20
#: Words of benchmark items in one automaton, which is what is broadcast (some 400 bytes a word); more items make more passes.
BLOCK_WORDS = 100_000

U64 = np.uint64


class Automaton:
    """A generalised suffix automaton over items given as lists of word codes."""

    def __init__(self, items: list[list[int]], names: list, window: int) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends = []
        for words in items:
            last, path = 0, []
            for w in words:
                last = self._extend(last, w)
                path.append(last)
            ends.append(path)
        # Windows by the state that holds them, each with the items that have it.
        self.window_items: dict[int, set] = {}
        self.short: dict[int, list[tuple[int, object]]] = {}
        for words, path, name in zip(items, ends, names):
            if not words:
                continue
            size = min(window, len(words))
            for i in range(size - 1, len(words)):
                at = self._holder(self._walk(words[i - size + 1 : i + 1]), size)
                if size == window:
                    self.window_items.setdefault(at, set()).add(name)
                else:
                    self.short.setdefault(at, []).append((size, name))
        self.window = window
        # The nearest state up the failure links that ends a short item, itself included.
        order = np.argsort(self.length, kind="stable")
        self.ending = [-1] * len(self.next)
        for v in order.tolist():
            if v:
                self.ending[v] = v if v in self.short else self.ending[self.link[v]]

    def _extend(self, last: int, w: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if w in nxt[last]:
            q = nxt[last][w]
            return q if length[q] == length[last] + 1 else self._clone(last, q, w)
        new = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and w not in nxt[p]:
            nxt[p][w] = new
            p = link[p]
        if p >= 0:
            q = nxt[p][w]
            link[new] = q if length[q] == length[p] + 1 else self._clone(p, q, w)
        return new

    def _clone(self, p: int, q: int, w: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        twin = len(nxt)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        while p >= 0 and nxt[p].get(w) == q:
            nxt[p][w] = twin
            p = link[p]
        link[q] = twin
        return twin

    def _walk(self, words: list[int]) -> int:
        at = 0
        for w in words:
            at = self.next[at][w]
        return at

    def _holder(self, at: int, size: int) -> int:
        """The state of the suffix of that size."""
        while self.length[self.link[at]] >= size:
            at = self.link[at]
        return at

    def read(self, words: list[int], hit: np.ndarray, base: int, items: set) -> None:
        """Mark in ``hit`` the words of all window occurrences, from ``base`` on, and gather their items."""
        nxt, link, length, window, ending = self.next, self.link, self.length, self.window, self.ending
        state = matched = 0
        for i, w in enumerate(words):
            while state and w not in nxt[state]:
                state = link[state]
                matched = length[state]
            state = nxt[state].get(w, 0)
            matched = matched + 1 if state else 0
            if matched >= window:
                hit[base + i + 1 - matched : base + i + 1] = True
                items |= self.window_items.get(self._holder(state, window), set())
            at = ending[state] if state else -1
            while at > 0:
                for size, name in self.short[at]:
                    if size <= matched:
                        hit[base + i + 1 - size : base + i + 1] = True
                        items.add(name)
                at = ending[link[at]] if link[at] > 0 else -1


def _build(texts: list[str | None], names: list, window: int) -> tuple[Automaton, np.ndarray, int]:
    """The automaton, the sorted hashes of its words (their places are the codes) and the least window."""
    hashes, at = ALNUM.hashes(*buffers(pa.array(texts, pa.string())))
    known = np.unique(hashes)
    codes = np.searchsorted(known, hashes).tolist()
    items = [codes[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
    least = min((min(window, len(x)) for x in items if x), default=window)
    return Automaton(items, names, window), known, least


def _hits(automaton: Automaton, known: np.ndarray, least: int, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[set]]:
    """Which words of the texts are hit, where each text's words start, and the items found in each."""
    hashes, at = ALNUM.hashes(*buffers(texts))
    code = np.minimum(np.searchsorted(known, hashes), max(len(known) - 1, 0))
    inside = known[code] == hashes if len(known) else np.zeros(len(hashes), bool)
    # Only runs of known words as long as the shortest window can hold one.
    begins = np.zeros(len(hashes) + 1, bool)
    begins[at] = True
    before, after = np.append(False, inside[:-1])[: len(inside)], np.append(inside[1:], False)[: len(inside)]
    starts = np.flatnonzero(inside & (~before | begins[:-1]))
    stops = np.flatnonzero(inside & (~after | begins[1:])) + 1
    long = stops - starts >= least
    hit = np.zeros(len(hashes), bool)
    items: list[set] = [set() for _ in range(len(texts))]
    doc = np.searchsorted(at, starts[long], "right") - 1
    for i, a, b in zip(doc.tolist(), starts[long].tolist(), stops[long].tolist()):
        automaton.read(code[a:b].tolist(), hit, a, items[i])
    return hit, at, items


def _reader(automaton: Automaton, known: np.ndarray, least: int):
    def read(batches):
        for batch in batches:
            for lo in range(0, len(batch), 256):
                part = batch.slice(lo, 256)
                hit, at, items = _hits(automaton, known, least, part["text"])
                spans = []
                for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit[a:b].view(np.int8), [0]])))
                    spans.append([{"start": int(x), "stop": int(y)} for x, y in zip(edge[::2], edge[1::2])])
                yield pa.RecordBatch.from_arrays([
                    part["text_id"], part["doc_id"], pa.array(np.diff(at), pa.int64()),
                    pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))),
                    pa.array([sorted(x) for x in items], pa.list_(pa.string())),
                ], names=["text_id", "doc_id", "n_words", "spans", "items"])

    return read


_FOUND = "text_id bigint, doc_id bigint, n_words bigint, spans array<struct<start: bigint, stop: bigint>>, items array<string>"


def _joined(batches):
    """One row per distinct document of what the passes over several blocks found."""
    for batch in batches:
        spans, items = [], []
        for many in batch["found"].to_pylist():
            out: list[list[int]] = []
            for a, b in sorted((s["start"], s["stop"]) for one in many for s in one["spans"]):
                if out and a <= out[-1][1]:
                    out[-1][1] = max(out[-1][1], b)
                else:
                    out.append([a, b])
            spans.append([{"start": a, "stop": b} for a, b in out])
            items.append(sorted({x for one in many for x in one["items"]}))
        yield pa.RecordBatch.from_arrays([
            batch["times"], batch["text_id"], batch["doc_id"], batch["n_words"],
            pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), pa.array(items, pa.list_(pa.string())),
        ], names=["times", "text_id", "doc_id", "n_words", "spans", "items"])


def _automata(benchmark: DataFrame, window: int, block_words: int):
    """Broadcasts of the automata of all blocks of items."""
    items = benchmark.filter("item_id is not null").select(F.col("item_id").cast("string").alias("item"), "text")
    # A word needs a byte and a gap, so half the bytes bound the words.
    size = items.select(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    blocks = max(1, math.ceil(size / 2 / block_words))
    dealt = items.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks)))
    for block in range(blocks):
        rows = dealt.filter(F.col("block") == block).select("item", "text").collect()
        yield benchmark.sparkSession.sparkContext.broadcast(_build([r["text"] for r in rows], [r["item"] for r in rows], window))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """What of each document is in a benchmark item.

    Reads ``doc_id`` and ``text`` of ``docs``, ``item_id`` and ``text`` of
    ``benchmark``; other columns play no part. Words are runs of ASCII digits
    and letters (A-Z lowered) and of all characters beyond ASCII. A window is a
    run of ``window`` words of an item, or all words of a shorter one; a null
    text has no words. Each row of ``docs`` gives one: doc_id, n_words, spans
    (starts and stops, in words, of the maximal hit runs), n_hit, items (ids as
    text, sorted as text), n_items, items_sha256 (of the ids, comma-joined) and
    contaminated (a hit, and 20 * n_hit >= n_words). Items without id are
    left out. Empty tables give no rows or no hits.

    Items are cut into blocks of ``block_words`` words, so that an automaton
    has a bounded size (an item of more words is a block of its own); each
    block is one pass over the documents, and the passes are joined per document.
    """
    own = docs.select(F.xxhash64("text").alias("text_id"), "doc_id", "text")
    passes, blocks = None, 0
    for shared in _automata(benchmark, window, block_words):
        found = own.mapInArrow(_shared_reader(shared), _FOUND)
        passes, blocks = found if passes is None else passes.union(found), blocks + 1
    if blocks > 1:
        # Equal rows have equal findings, so a set of them has one per block.
        passes = passes.groupBy("text_id", "doc_id", "n_words").agg(
            F.collect_set(F.struct("spans", "items")).alias("found"), (F.count("*") / blocks).cast("int").alias("times"))
        passes = passes.mapInArrow(_joined, "times int, " + _FOUND)
        passes = passes.withColumn("times", F.explode(F.sequence(F.lit(1), "times")))
    hits = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["stop"] - s["start"])
    return passes.select(
        "doc_id", "n_words", "spans", hits.alias("n_hit"), "items", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((hits > 0) & (ONE_IN * hits >= F.col("n_words"))).alias("contaminated"),
    )


def _shared_reader(shared):
    def read(batches):
        yield from _reader(*shared.value)(batches)

    return read


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, one_in: int = ONE_IN, cut_below: float | None = None,
                  block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of ``docs``, all columns, without those of whose words one in ``one_in`` or more is hit.

    With ``cut_below``, a row over this but under that share stays, and
    its hit spans are cut out of ``text`` instead (``n_chars`` follows, if there
    is one). Rows with fewer hits stay as they are. The hits of all blocks of
    items count together (see ``contamination``); between the passes over
    several blocks the rows are written with their hits. Moves no row.
    """
    schema = docs.schema
    automata = list(_automata(benchmark, window, block_words))
    for shared in automata[:-1]:
        fields = [f for f in docs.schema.fields if f.name != HITS]
        docs = materialize(docs.mapInArrow(_mark(shared), T.StructType([*fields, T.StructField(HITS, T.BinaryType())])), "marked")

    def clean(batches):
        for part, hit, at in _all_hits(batches, automata[-1]):
            total = np.concatenate([[0], np.cumsum(hit)])
            n_hit, n_words = total[at[1:]] - total[at[:-1]], np.diff(at)
            over = (n_hit > 0) & (one_in * n_hit >= n_words)
            cut = over & (n_hit < cut_below * n_words) if cut_below is not None else np.zeros(len(part), bool)
            if cut.any():
                part = _cut(part, hit, at, np.flatnonzero(cut))
            yield part.filter(pa.array(~over | cut))

    return docs.mapInArrow(clean, schema)


#: The column that carries earlier passes' hits, one bit a word.
HITS = "_benchmark_hits"


def _all_hits(batches, shared):
    """Parts of the batches without the column of earlier hits, all hits, and where each text's words start."""
    for batch in batches:
        for lo in range(0, len(batch), 256):
            part = batch.slice(lo, 256)
            hit, at, _ = _hits(*shared.value, part["text"])
            if HITS in part.schema.names:
                sizes = np.diff(at).tolist()
                earlier = [np.unpackbits(np.frombuffer(h, np.uint8), count=n).astype(bool) for h, n in zip(part[HITS].to_pylist(), sizes)]
                hit = hit | np.concatenate([np.zeros(0, bool), *earlier])
                part = part.drop_columns([HITS])
            yield part, hit, at


def _mark(shared):
    def mark(batches):
        for part, hit, at in _all_hits(batches, shared):
            bits = [np.packbits(hit[a:b]).tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(bits, pa.binary())], names=[*part.schema.names, HITS])

    return mark


def _cut(part: pa.RecordBatch, hit: np.ndarray, at: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
    """The batch with the hit words of some rows, and what stands between them, taken out."""
    texts = part["text"].to_pylist()
    for i in rows.tolist():
        raw = texts[i].encode()
        starts, ends = ALNUM.spans(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        edge = np.flatnonzero(np.diff(np.concatenate([[0], hit[at[i] : at[i + 1]].view(np.int8), [0]])))
        out, done = [], 0
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
            out.append(raw[done : starts[a]])
            done = int(ends[b - 1])
        texts[i] = b"".join([*out, raw[done:]]).decode()
    part = part.set_column(part.schema.get_field_index("text"), part.schema.field("text"), pa.array(texts, part.schema.field("text").type))
    if "n_chars" in part.schema.names:
        field = part.schema.field("n_chars")
        sizes = [None if t is None else len(t) for t in texts]
        old = part["n_chars"].to_pylist()
        changed = set(rows.tolist())
        part = part.set_column(part.schema.get_field_index("n_chars"), field, pa.array([s if i in changed else o for i, (s, o) in enumerate(zip(sizes, old))], field.type))
    return part
