"""Removal of byte strings that also start in a document with a smaller id.

Every string of ``length`` bytes belongs to the 16 bytes in it with the least
hash (the leftmost at ties), its anchor. Equal strings have equal anchors, so:
chunks of documents ask which anchors other documents have too; for those they
send the distinct pieces of text around the anchors, each with its smallest
document; parts sort the starts in these pieces by two-stage suffix sorting,
find runs with a common prefix of ``length`` bytes, and answer which of them a
smaller document has.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from clickloom.llm import exchange as X
from clickloom.llm.suffixes import sort_windows
from clickloom.llm.textbytes import BLOCK, buffers, mix

LENGTH = 50
GRAM = 16
#: An anchor that more documents hold is dealt out by its single strings.
HOT_DOCS = 20_000
#: Bytes of text that a part sorts at once.
SORT_BYTES = 1 << 19

U64 = np.uint64
_PLACE = U64((1 << 22) - 1)
#: The bits of an anchor's hash that are kept. Anchors whose hashes agree go together, which costs a piece sent in vain; fewer bits are fewer bytes.
_KEPT = ~U64((1 << 16) - 1)


def anchors(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH):
    """(anchor, document, first start, last start) of each run of starts with one anchor.

    Starts are byte positions within the document. Blocks of many documents or
    of parts of a long one are handled at a time.
    """
    found = []
    window = length - GRAM + 1
    doc, n = 0, len(offsets) - 1
    while doc < n:
        to = max(doc + 1, int(np.searchsorted(offsets, offsets[doc] + BLOCK, "right")) - 1)
        lo, end = int(offsets[doc]), int(offsets[to])
        while end - lo >= length:
            hi = min(end, lo + BLOCK + length - 1)  # the starts of a block reach into the next one
            piece = np.concatenate([data[lo:hi], np.zeros(GRAM, np.uint8)])
            pair = np.lib.stride_tricks.as_strided(piece, (hi - lo + GRAM - 7, 8), (1, 1)).reshape(-1).view("<u8")
            m = hi - lo - GRAM + 1
            key = mix(pair[:m] * U64(0x9E3779B97F4A7C15) + mix(pair[8 : m + 8] + U64(GRAM)))
            least = (key & ~_PLACE) | np.arange(m, dtype=U64)
            span = 1
            while span < window:
                step = min(span, window - span)
                least = np.minimum(least[: len(least) - step], least[step:])
                span += step
            at = (least & _PLACE).astype(np.int64)
            inner = np.clip(offsets[doc : to + 1] - lo, 0, hi - lo)
            of = np.repeat(np.arange(doc, to), np.diff(inner))[: len(at)]
            start = np.arange(len(at))
            whole = start + length <= inner[of - doc + 1]
            run = np.flatnonzero(np.append(True, (at[1:] != at[:-1]) | (of[1:] != of[:-1]) | (whole[1:] != whole[:-1])))
            stop = np.append(run[1:], len(at)) - 1
            run, stop = run[whole[run]], stop[whole[run]]
            base = lo - offsets[of[run]]
            # Anchors are small hashes; scrambled once more they spread evenly.
            found.append((mix(key[at[run]] + U64(GRAM)) & _KEPT, of[run], run + base, stop + base))
            if hi == end:
                break
            lo += BLOCK
        doc = to
    if not found:
        none = np.zeros(0, np.int64)
        return none.astype(U64), none, none, none
    return tuple(np.concatenate(x) for x in zip(*found))


def _questions(length: int, parts: int):
    def ask(table: pa.Table) -> pa.Table:
        """Per part the chunk's distinct anchors and how many of its documents hold each."""
        chunk = table["chunk"][0].as_py()
        data, offsets = buffers(X.ordered(table)["text"])
        key, doc, _, _ = anchors(data, offsets, length)
        by = np.lexsort((doc, key))
        key, doc = key[by], doc[by]
        new = np.append(True, key[1:] != key[:-1])[: len(key)]
        fresh = new | np.append(True, doc[1:] != doc[:-1])[: len(key)]
        heads = np.flatnonzero(new)
        docs = np.add.reduceat(fresh.astype(np.uint32), heads).astype(np.uint32) if len(heads) else np.zeros(0, np.uint32)
        key = key[heads]
        pieces = X.split(key, parts)
        return pa.table({
            "part": pa.array([p for p, _ in pieces], pa.int32()), "chunk": pa.array([chunk] * len(pieces), pa.int32()),
            "keys": pa.array([X.pack_sorted(key[s]) for _, s in pieces], pa.binary()),
            "docs": pa.array([X.pack(docs[s]) for _, s in pieces], pa.binary()),
        })

    return ask


def _answers(hot_docs: int):
    def answer(table: pa.Table) -> pa.Table:
        """For each anchor asked about: 0 in one document only, 1 in more, 2 in very many."""
        keys = [X.unpack_sorted(v) for v in table["keys"]]
        docs = [X.unpack(v, np.uint32) for v in table["docs"]]
        all_keys = np.concatenate(keys)
        distinct, which = np.unique(all_keys, return_inverse=True)
        total = np.bincount(which, np.concatenate(docs), len(distinct))
        state = ((total > 1).astype(np.uint8) + (total > hot_docs))[which].astype(np.uint8)
        cuts = np.cumsum([len(k) for k in keys])[:-1]
        return pa.table({
            "chunk": table["chunk"], "part": table["part"],
            "state": pa.array([X.pack(s) for s in np.split(state, cuts)], pa.binary()),
        })

    return answer


def _pieces(length: int, parts: int):
    def send(docs: pa.Table, states: pa.Table) -> pa.Table:
        """Per part the distinct pieces of text around shared anchors, and where the chunk has them."""
        out = {"part": [], "chunk": [], "text": [], "sizes": [], "keys": [], "least": [], "of": [], "doc": [], "start": []}
        if len(docs) and len(states):
            chunk = docs["chunk"][0].as_py()
            docs = X.ordered(docs)
            data, offsets = buffers(docs["text"])
            ids = _ids(docs)
            key, doc, first, last = anchors(data, offsets, length)
            asked = np.unique(key)
            order = np.argsort(np.array(states["part"]))
            state = np.concatenate([X.unpack(states["state"][int(i)]) for i in order])
            state = state[np.searchsorted(asked, key)]
            shared = np.flatnonzero(state == 1)
            key1, doc1, a1, b1 = key[shared], doc[shared], first[shared], last[shared]
            hot = np.flatnonzero(state == 2)
            if len(hot):  # one piece per start, dealt by its own bytes
                many = last[hot] - first[hot] + 1
                doc2 = np.repeat(doc[hot], many)
                a2 = np.repeat(first[hot], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                at = offsets[doc2] + a2
                key2 = np.full(len(at), U64(length))
                for j in range(length):
                    key2 = mix(key2 * U64(31) + data[at + j])
                key1, doc1 = np.concatenate([key1, key2]), np.concatenate([doc1, doc2])
                a1, b1 = np.concatenate([a1, a2]), np.concatenate([b1, a2])
            part = X.part_of(key1, parts)
            by = np.lexsort((a1, doc1, key1))
            raw = data.tobytes()
            lo = (offsets[doc1] + a1)[by].tolist()
            hi = (offsets[doc1] + b1 + length)[by].tolist()
            doc1, a1, part, key1 = doc1[by], a1[by], part[by], key1[by]
            edges = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else []
            for s, e in zip(edges, np.append(edges[1:], len(part)) if len(part) else []):
                seen: dict[bytes, int] = {}
                of = [seen.setdefault(raw[i:j], len(seen)) for i, j in zip(lo[s:e], hi[s:e])]
                of = np.array(of, np.int32)
                here = ids[doc1[s:e]]
                least = np.full(len(seen), np.iinfo(np.int64).max)
                np.minimum.at(least, of, here)
                keys = np.zeros(len(seen), U64)
                keys[of] = key1[s:e]
                out["part"].append(int(part[s]))
                out["chunk"].append(chunk)
                out["text"].append(X.pack(b"".join(seen)))
                out["sizes"].append(X.pack(np.array([len(x) for x in seen], np.uint16)))
                out["keys"].append(X.pack_sorted(keys))
                out["least"].append(X.pack(least))
                out["of"].append(X.pack(np.where(here > least[of], ~of, of).astype(np.int32)))
                out["doc"].append(X.pack(doc1[s:e].astype(np.int32)))
                out["start"].append(X.pack(a1[s:e].astype(np.int32)))
        return pa.table(out, _PIECES)

    return send


_PIECES = pa.schema([("part", pa.int32()), ("chunk", pa.int32()), *((k, pa.binary()) for k in ("text", "sizes", "keys", "least", "of", "doc", "start"))])
_SPANS = pa.schema([("chunk", pa.int32()), ("doc", pa.binary()), ("start", pa.binary()), ("stop", pa.binary())])


def _ids(docs: pa.Table) -> np.ndarray:
    """Document ids; a null counts as larger than all."""
    return docs["doc_id"].cast(pa.int64()).fill_null(np.iinfo(np.int64).max).to_numpy()


def _matches(length: int):
    def match(table: pa.Table) -> pa.Table:
        """Sort the pieces of a part and answer each chunk with the spans that smaller documents have too."""
        sizes = [X.unpack(v, np.uint16).astype(np.int64) for v in table["sizes"]]
        owner = np.repeat(np.arange(len(sizes)), [len(s) for s in sizes])
        size = np.concatenate(sizes)
        key = np.concatenate([X.unpack_sorted(v) for v in table["keys"]])
        least = np.concatenate([X.unpack(v, np.int64) for v in table["least"]])
        text = np.concatenate([X.unpack(v) for v in table["text"]])
        at = np.cumsum(size) - size
        starts = size - length + 1
        answer_at = np.cumsum(starts) - starts
        least_at = np.zeros(int(starts.sum()), np.int64)  # the smallest document of each start of each piece
        by = np.argsort(key, kind="stable")
        for batch in _batches(key[by], size[by]):
            some = by[batch]
            piece_size = size[some]
            ends = np.cumsum(piece_size)
            begin = ends - piece_size
            local = np.repeat(at[some] - begin, piece_size) + np.arange(ends[-1])
            order, same = sort_windows(text[local], begin, ends, length)
            piece = np.searchsorted(ends, order, "right")
            runs = np.flatnonzero(~same)
            smallest = np.minimum.reduceat(least[some][piece], runs)
            smallest = np.repeat(smallest, np.diff(np.append(runs, len(order))))
            least_at[answer_at[some][piece] + order - begin[piece]] = smallest
        taken = least_at < np.repeat(least, starts)  # also in a document before the chunk's first with this piece
        first = np.searchsorted(owner, np.arange(len(sizes)))
        rows = {"chunk": [], "doc": [], "start": [], "stop": []}
        for i in range(len(sizes)):
            of, doc, start = (X.unpack(table[c][i], np.int32) for c in ("of", "doc", "start"))
            later = of < 0
            piece = np.where(later, ~of, of) + first[i]
            whole = np.flatnonzero(later)
            spans = [(doc[whole], start[whole], start[whole] + size[piece[whole]])]
            rest = np.flatnonzero(~later)
            many = starts[piece[rest]]
            row = np.repeat(rest, many)
            inner = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
            hit = taken[np.repeat(answer_at[piece[rest]], many) + inner]
            row, inner = row[hit], inner[hit]
            edge = np.append(True, (row[1:] != row[:-1]) | (inner[1:] != inner[:-1] + 1))[: len(row)]
            head = np.flatnonzero(edge)
            tail = np.append(head[1:], len(row)) - 1
            spans.append((doc[row[head]], start[row[head]] + inner[head], start[row[head]] + inner[tail[: len(head)]] + length))
            doc, start, stop = (np.concatenate(x).astype(np.int32) for x in zip(*spans))
            if len(doc):
                rows["chunk"].append(table["chunk"][i].as_py())
                for name, value in (("doc", doc), ("start", start), ("stop", stop)):
                    rows[name].append(value.tobytes())
        return pa.table(rows, _SPANS)

    return match


def _batches(key: np.ndarray, size: np.ndarray):
    """Slices of up to SORT_BYTES that keep an anchor's pieces together."""
    total = np.cumsum(size)
    heads = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    before = total[heads] - size[heads]
    begin = 0
    while begin < len(heads):
        to = max(begin + 1, int(np.searchsorted(before, before[begin] + SORT_BYTES)))
        yield slice(int(heads[begin]), int(heads[to]) if to < len(heads) else len(key))
        begin = to


def merge(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs covered by the spans; touching spans are one run."""
    by = np.argsort(start, kind="stable")
    start, stop = start[by], np.maximum.accumulate(stop[by]) if len(by) else stop[by]
    new = np.append(True, start[1:] > stop[:-1])[: len(start)]
    heads = np.flatnonzero(new)
    return start[heads], stop[np.append(heads[1:], len(stop))[: len(heads)] - 1] if len(heads) else stop


def _without(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    edges = [0, *(x for span in spans for x in span), len(raw)]
    return b"".join(raw[edges[j] : edges[j + 1]] for j in range(0, len(edges), 2))


def _whole(raw: bytes, start: int, stop: int) -> tuple[int, int]:
    """The part of a span that consists of whole characters."""
    while start < stop and raw[start] & 0xC0 == 0x80:
        start += 1
    while stop > start and stop < len(raw) and raw[stop] & 0xC0 == 0x80:
        stop -= 1
    return start, stop


def _kept(docs: pa.Table, spans: pa.Table):
    """The chunk's rows in order, and for each its bytes and the maximal removed runs."""
    docs = X.ordered(docs)
    data, offsets = buffers(docs["text"])
    raw = data.tobytes()
    parts = [[X.unblob(v, np.int32) for v in spans[c]] for c in ("doc", "start", "stop")]
    doc, start, stop = (np.concatenate(p) if p else np.zeros(0, np.int32) for p in parts)
    by = np.argsort(doc, kind="stable")
    doc, start, stop = doc[by], start[by].astype(np.int64), stop[by].astype(np.int64)
    at = np.searchsorted(doc, np.arange(len(docs) + 1))
    found = []
    for i in range(len(docs)):
        a, b = merge(start[at[i] : at[i + 1]], stop[at[i] : at[i + 1]])
        found.append((raw[offsets[i] : offsets[i + 1]], list(zip(a.tolist(), b.tolist()))))
    return docs, found


def _described(docs: pa.Table, spans: pa.Table) -> pa.Table:
    docs, found = _kept(docs, spans)
    kept = [_without(raw, runs) for raw, runs in found]
    return pa.table({
        "doc_id": docs["doc_id"].cast(pa.int64()),
        "n_bytes": pa.array([len(raw) for raw, _ in found], pa.int64()),
        "n_removed": pa.array([sum(b - a for a, b in runs) for _, runs in found], pa.int64()),
        "n_spans": pa.array([len(runs) for _, runs in found], pa.int64()),
        "kept_sha256": pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()),
        "spans": pa.array([[{"start": a, "stop": b} for a, b in runs] for _, runs in found], pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))),
        "kept": pa.array(kept, pa.binary()),
    })


def _cut(docs: pa.Table, spans: pa.Table) -> pa.Table:
    """The rows with repeated spans cut out of the text, at whole characters, and its new length."""
    docs, found = _kept(docs, spans)
    kept = [None if old is None else _without(raw, [_whole(raw, *x) for x in runs]) for old, (raw, runs) in zip(docs["text"].to_pylist(), found)]
    text = pa.array(kept, pa.binary()).cast(pa.string())
    docs = docs.set_column(docs.schema.get_field_index("text"), "text", text)
    return docs.append_column("cut", pa.array([bool(runs) for _, runs in found], pa.bool_()))


def repeated_spans(docs: DataFrame, length: int = LENGTH, hot_docs: int = HOT_DOCS,
                   chunk_bytes: int = X.CHUNK_BYTES, part_bytes: int = X.PART_BYTES) -> DataFrame:
    """Per document what remains without the byte strings that a document with a smaller id has too.

    Reads ``doc_id`` and ``text`` of ``docs``; other columns play no part. Each
    row gives one: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (byte
    starts and ends of the maximal removed runs) and kept (the remaining bytes).
    A null text is empty and keeps nothing back. A null id counts as larger than
    all others. Rows with one id do not count as smaller than each other. An
    empty table gives none. A chunk of documents, and the pieces sent to a part,
    must fit in a task's memory; both have a set size.
    """
    return _deal(docs.select("doc_id", "text"), length, hot_docs, chunk_bytes, part_bytes, _described,
                 "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, "
                 "spans array<struct<start: bigint, stop: bigint>>, kept binary")


def _deal(docs: DataFrame, length: int, hot_docs: int, chunk_bytes: int, part_bytes: int, last, schema) -> DataFrame:
    """Find the spans of rows with ``doc_id`` and ``text`` and give each chunk's rows and spans to ``last``."""
    if length < 2 * GRAM:
        raise ValueError(f"length must be at least {2 * GRAM}")
    chunks, parts = X.counts(X.text_bytes(docs), chunk_bytes, part_bytes)
    by_chunk = docs.withColumn("chunk", X.chunk_of(chunks)).groupBy("chunk")
    asked = by_chunk.applyInArrow(_questions(length, parts), "part int, chunk int, keys binary, docs binary")
    states = asked.groupBy("part").applyInArrow(_answers(hot_docs), "chunk int, part int, state binary")
    sent = by_chunk.cogroup(states.groupBy("chunk")).applyInArrow(
        _pieces(length, 2 * parts),
        "part int, chunk int, text binary, sizes binary, keys binary, least binary, of binary, doc binary, start binary")
    spans = sent.groupBy("part").applyInArrow(_matches(length), "chunk int, doc binary, start binary, stop binary")
    return by_chunk.cogroup(spans.groupBy("chunk")).applyInArrow(last, schema)


def remove_repeats(docs: DataFrame, length: int = LENGTH, hot_docs: int = HOT_DOCS,
                   chunk_bytes: int = X.CHUNK_BYTES, part_bytes: int = X.PART_BYTES) -> DataFrame:
    """The documents with repeated spans cut out of ``text`` and the new ``n_chars``, columns as given.

    Cuts end at whole characters: one of which only a part is repeated stays.
    Rows that lose nothing stay as they are.
    """
    # Other columns travel under names of their own, so that none clashes.
    names = {name: name if name in ("doc_id", "text") else f"x{i}" for i, name in enumerate(docs.columns)}
    plain = docs.select(*(F.col(f"`{name}`").alias(short) for name, short in names.items()))
    fields = T.StructType([*plain.schema.fields, T.StructField("chunk", T.IntegerType()), T.StructField("cut", T.BooleanType())])
    out = _deal(plain, length, hot_docs, chunk_bytes, part_bytes, _cut, fields)
    if "n_chars" in names:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn(names["n_chars"], F.when(F.col("cut"), F.char_length("text").cast(kind)).otherwise(F.col(names["n_chars"])))
    return out.select(*(F.col(short).alias(name) for name, short in names.items()))
