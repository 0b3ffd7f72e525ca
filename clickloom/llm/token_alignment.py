"""Two tokenizers over one corpus: where their tokens end together, and which ids stand for each other.

1. Each text is encoded by both. The bytes at which a token of A and one of B
   both end cut the text into groups. They are found by skipping along the
   diagonal: as long as tokens go one to one, the end arrays agree at the
   current shift of the index, and probes of 1, 2, 4, ... ends jump that
   stretch. Where a probe fails, the two arrays are walked to the next common
   end, which gives one irregular group and the new shift. Many places of a
   block of texts are walked at once, each from a common end to the next.
2. Tokens of one group are linked. A chunk of texts keeps its distinct id pairs
   once, and for each text the places of its own among them.
3. (pair, chunk, texts of the chunk that hold it) rows are shuffled and summed,
   and each pair gets its count and whether it is the highest of its A id.
4. Each chunk's rows get their counts back, and texts are summed up.

The text is encoded once, where it is read, and is never shuffled; the counts
are never gathered. A hot pair has one row per chunk. Only the vocabularies are
broadcast, whose size does not grow with the data.

A text that is null or empty, or whose tokens do not give its bytes back, has no
tokens: zeros, and an empty digest. Repeated rows, null ids and equal ids are
texts of their own; an empty table gives an empty result. A text is handled
whole by one task.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from clickloom.llm.blocks import blocks
from clickloom.llm.exchange import pack, unpacked
from clickloom.session import materialize

FOLDER = "/opt/tokenizers"
BYTE_BPE, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Bytes of text that are encoded and aligned at once, and that share a chunk; a longer text is one of its own.
BLOCK, CHUNK = 1 << 20, 16 << 20
#: Tokens between the places that are walked at once.
LANE = 256
#: Ends that a probe compares at most, and pairs that are made at once.
PROBE, PAIRS = 256, 1 << 22

# Fixed value: the pattern that cuts a text before the merges of the byte-level vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


# -- tokenizers --------------------------------------------------------------------------


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones for themselves, the others from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@dataclass
class Tokenizers:
    """A, byte-level merges from a JSON file, over blank + text; B, pieces with byte fallback, over text."""

    merges: bytes
    pieces: bytes

    def __post_init__(self) -> None:
        import sentencepiece
        import tiktoken

        model, letters = json.loads(self.merges)["model"], byte_letters()
        ids = {bytes(letters[c] for c in piece): i for piece, i in model["vocab"].items()}
        for k, pair in enumerate(model["merges"]):
            if model["vocab"]["".join(pair if isinstance(pair, list) else pair.split(" "))] != 256 + k:
                raise ValueError("the ids of the byte-level vocabulary do not follow its merges")
        self._a = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ids, special_tokens={})
        self._b = sentencepiece.SentencePieceProcessor(model_proto=self.pieces)
        self.a_bytes = _table({i: b for b, i in ids.items()})
        self.b_bytes = _table({i: self._piece(i) for i in range(self._b.get_piece_size())})

    def _piece(self, i: int) -> bytes:
        piece = self._b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self._b.is_byte(i) else piece.replace("▁", " ").encode()

    def a(self, texts: list[str]) -> list[list[int]]:
        return [self._a.encode_ordinary(" " + t) for t in texts]

    def b(self, texts: list[str]) -> list[list[int]]:
        return self._b.encode(texts, num_threads=1) if texts else []


def _table(entries: dict[int, bytes]) -> np.ndarray:
    out = np.full(max(entries, default=-1) + 1, b"", object)
    for i, b in entries.items():
        out[i] = b
    return out


def load(folder: str) -> tuple[bytes, bytes]:
    return tuple(open(f"{folder}/{name}", "rb").read() for name in (BYTE_BPE, PIECES))


# -- groups ------------------------------------------------------------------------------


def _next_common(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """From each (i, j) the places of the next end that both arrays have."""
    i, j, open_ = i.copy(), j.copy(), np.arange(len(i))
    while len(open_):
        x, y = a[i[open_]], b[j[open_]]
        i[open_] += x < y
        j[open_] += y < x
        open_ = open_[x != y]
    return i, j


def common_ends(a: np.ndarray, b: np.ndarray, lane: int = LANE) -> tuple[np.ndarray, np.ndarray]:
    """Flags of the ends that both rising arrays have; their last ends are equal."""
    in_a, in_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
    if not len(a):
        return in_a, in_b
    # Lanes start after common ends, and each walks up to where the next one starts.
    i = np.arange(lane, len(a), lane)
    i, j = _next_common(a, b, i, np.searchsorted(b, a[i]))
    i, first = np.unique(np.append(0, i + 1), return_index=True)
    j = np.append(0, j + 1)[first]
    stop = np.append(i[1:], len(a))
    width = np.ones(len(i), np.int64)
    while len(i):
        regular = np.zeros(len(i), bool)
        for w in np.unique(width):
            rows = np.flatnonzero(width == w)
            reach = np.arange(w)
            x, y = i[rows, None] + reach, j[rows, None] + reach
            same = (a[np.minimum(x, len(a) - 1)] == b[np.minimum(y, len(b) - 1)]) & (x < stop[rows, None])
            run = np.where(same.all(axis=1), w, same.argmin(axis=1))
            same = reach < run[:, None]
            in_a[x[same]] = in_b[y[same]] = True
            i[rows] += run
            j[rows] += run
            regular[rows] = run == w
        width = np.where(regular, np.minimum(2 * width, PROBE), 1)
        rows = np.flatnonzero(~regular & (i < stop))
        x, y = _next_common(a, b, i[rows], j[rows])
        in_a[x] = in_b[y] = True
        i[rows], j[rows] = x + 1, y + 1
        on = i < stop
        i, j, stop, width = i[on], j[on], stop[on], width[on]
    return in_a, in_b


def _counted(group: np.ndarray, ids: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (group, id), and how often each occurs."""
    keys, n = np.unique(group * size + ids, return_counts=True)
    return keys // size, keys % size, n


def _starts(sizes: np.ndarray) -> np.ndarray:
    return np.append(0, np.cumsum(sizes))


def links(a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, sizes: tuple[int, int]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Group, pair (``a * sizes[1] + b``) and number of the links of each group; a pair of a group comes once."""
    n = int(group_a[-1]) + 1 if len(group_a) else 0
    single = (np.bincount(group_a, minlength=n) == 1) & (np.bincount(group_b, minlength=n) == 1)
    one_a, one_b = single[group_a], single[group_b]
    group = group_a[one_a]
    yield group, a[one_a] * sizes[1] + b[one_b], np.ones(len(group), np.int64)
    ga, ia, na = _counted(group_a[~one_a], a[~one_a], sizes[0])
    gb, ib, nb = _counted(group_b[~one_b], b[~one_b], sizes[1])
    begin = np.searchsorted(gb, ga)
    many = np.searchsorted(gb, ga, "right") - begin
    filled = np.cumsum(many)
    at = 0
    while at < len(ga):
        to = max(at + 1, int(np.searchsorted(filled, (filled[at - 1] if at else 0) + PAIRS, "right")))
        rows = np.repeat(np.arange(at, to), many[at:to])
        other = np.arange(len(rows)) - np.repeat(_starts(many[at:to])[:-1], many[at:to]) + begin[rows]
        yield ga[rows], ia[rows] * sizes[1] + ib[other], na[rows] * nb[other]
        at = to


# -- blocks and chunks -------------------------------------------------------------------


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return keys, n
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[first], np.add.reduceat(n[order], first)


class Aligner:
    """Encodes and aligns blocks of texts."""

    def __init__(self, tokenizers: Tokenizers, lane: int = LANE) -> None:
        self.tokenizers, self.lane = tokenizers, lane
        self.sizes = len(tokenizers.a_bytes), len(tokenizers.b_bytes)
        self.lengths = [np.array([len(x) for x in t]) for t in (tokenizers.a_bytes, tokenizers.b_bytes)]
        numbers = [str(i).encode() for i in range(max(self.sizes))]
        self.written = np.array([n + mark for mark in (b",", b"|", b";", b"") for n in numbers], object)

    def _flat(self, ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.array([len(x) for x in ids], np.int64)
        return np.concatenate([np.zeros(0, np.int64), *(np.array(x, np.int64) for x in ids if x)]), _starts(sizes)

    def _gives_back(self, ids: np.ndarray, starts: np.ndarray, table: np.ndarray, texts: list[bytes]) -> np.ndarray:
        pieces = table[ids].tolist()
        return np.array([b"".join(pieces[starts[k] : starts[k + 1]]) == text for k, text in enumerate(texts)], bool)

    def __call__(self, texts: list[str]) -> dict[str, np.ndarray | list[str]]:
        """Of each text n_a, n_b, n_groups, n_links and groups; and its distinct pairs with their numbers, by text."""
        raw = [b" " + t.encode() for t in texts]
        (a, at_a), (b, at_b) = self._flat(self.tokenizers.a(texts)), self._flat(self.tokenizers.b(texts))
        right = self._gives_back(a, at_a, self.tokenizers.a_bytes, raw) & self._gives_back(b, at_b, self.tokenizers.b_bytes, raw)
        right &= np.array([bool(t) for t in texts], bool)
        n_a, n_b = np.where(right, np.diff(at_a), 0), np.where(right, np.diff(at_b), 0)
        a, b = a[np.repeat(right, np.diff(at_a))], b[np.repeat(right, np.diff(at_b))]
        # Texts follow one another, and each ends in a common end: all are aligned as one.
        in_a, in_b = common_ends(np.cumsum(self.lengths[0][a]), np.cumsum(self.lengths[1][b]), self.lane)
        group_a, group_b = np.cumsum(in_a) - in_a, np.cumsum(in_b) - in_b
        at_a, at_b = _starts(n_a), _starts(n_b)
        up_to = _starts(in_a.astype(np.int64))[at_a]
        text_of = np.repeat(np.arange(len(texts)), np.diff(up_to))
        space = self.sizes[0] * self.sizes[1]
        n_links, keys, numbers = np.zeros(len(texts), np.int64), [], []
        for group, pair, n in links(a, b, group_a, group_b, self.sizes):
            text = text_of[group]
            np.add.at(n_links, text, n)
            key, n = _summed(text * space + pair, n)
            keys.append(key)
            numbers.append(n)
        key, n = _summed(np.concatenate(keys), np.concatenate(numbers))
        return {
            "n_a": n_a, "n_b": n_b, "n_groups": np.diff(up_to), "n_links": n_links,
            "groups_sha256": self._digests(a, b, in_a, in_b, group_a, group_b, at_a, at_b),
            "text": key // space, "pair": key % space, "n": n,
        }

    def _digests(self, a, b, in_a, in_b, group_a, group_b, at_a, at_b) -> list[str]:
        """Ids of A and B by groups, as text: each group's A tokens stand before its B tokens."""
        size = len(self.written) // 4
        mark = np.where(in_b, 2, 0)
        ends = at_b[1:][np.diff(at_b) > 0] - 1
        mark[ends] = 3
        code = np.empty(len(a) + len(b), np.int64)
        groups = int(in_a.sum())
        before_b = _starts(np.bincount(group_b, minlength=groups))
        before_a = _starts(np.bincount(group_a, minlength=groups))
        code[np.arange(len(a)) + before_b[group_a]] = a + size * in_a
        code[np.arange(len(b)) + before_a[group_b + 1]] = b + size * mark
        parts = self.written[code].tolist()
        starts = at_a + at_b
        return [sha256(b"".join(parts[x:y])).hexdigest() if y > x else "" for x, y in zip(starts[:-1], starts[1:])]


_COUNTS = ["n_a", "n_b", "n_groups", "n_links"]


def _chunk(ids: list[pa.Array], found: list[dict]) -> pa.RecordBatch:
    """Aligned blocks as one row: columns of texts, the distinct pairs, and each text's places among them."""
    pairs = np.unique(np.concatenate([f["pair"] for f in found]))
    texts = np.cumsum([0] + [len(f["n_a"]) for f in found])
    text = np.concatenate([f["text"] + start for f, start in zip(found, texts)])
    place = np.searchsorted(pairs, np.concatenate([f["pair"] for f in found]))
    # Within a text the places rise; their steps take fewer bytes.
    step = np.diff(place, prepend=0)
    new = np.append(True, text[1:] != text[:-1]) if len(text) else np.zeros(0, bool)
    step[new] = place[new]
    blob = {
        "sizes": np.bincount(text, minlength=texts[-1]).astype(np.uint32), "step": step.astype(np.uint32),
        "n": np.concatenate([f["n"] for f in found]).astype(np.uint64),
    }
    row = {"doc_id": pa.ListArray.from_arrays(pa.array([0, texts[-1]], pa.int32()), pa.concat_arrays(ids))}
    row |= {c: [np.concatenate([f[c] for f in found])] for c in _COUNTS}
    row["groups_sha256"] = [[d for f in found for d in f["groups_sha256"]]]
    row |= {c: [pack(v)] for c, v in blob.items()}
    row |= {"pairs": [pairs], "texts": [np.bincount(place, minlength=len(pairs))]}
    return pa.RecordBatch.from_pydict(row)


def _align(folder_bytes, block: int, chunk: int, lane: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        align = None
        for batch in batches:
            align = align or Aligner(Tokenizers(*folder_bytes.value), lane)
            ids, found, filled = [], [], 0
            for part, data, _ in blocks(batch, "text", block):
                if found and filled + len(data) > chunk:
                    yield _chunk(ids, found)
                    ids, found, filled = [], [], 0
                ids.append(part.column("doc_id"))
                found.append(align(part.column("text").fill_null("").to_pylist()))
                filled += len(data)
            if found:
                yield _chunk(ids, found)

    return run


def _sum_up(kind: pa.DataType):
    def run(chunks: pa.Table, answers: pa.Table) -> pa.Table:
        out = []
        answers = answers.take(np.argsort(answers.column("pair").to_numpy(), kind="stable"))
        counts, best = answers.column("count").to_numpy(), answers.column("best").to_numpy()
        for row in chunks.to_pylist():  # one
            sizes = unpacked(row["sizes"], np.uint32).astype(np.int64)
            n, starts = unpacked(row["n"], np.uint64).astype(np.int64), _starts(sizes)
            step = unpacked(row["step"], np.uint32).astype(np.int64)
            place = _starts(step)
            place = place[1:] - np.repeat(place[starts[:-1]], sizes)
            total = lambda x: np.diff(_starts(x)[starts])
            columns = {"doc_id": pa.array(row["doc_id"], kind)} | {c: pa.array(row[c], pa.int64()) for c in _COUNTS}
            columns |= {"n_best": pa.array(total(n * best[place])), "count_sum": pa.array(total(n * counts[place])), "groups_sha256": pa.array(row["groups_sha256"], pa.string())}
            out.append(pa.table(columns))
        return pa.concat_tables(out)

    return run


def align_tokens(docs: DataFrame, folder: str = FOLDER, block: int = BLOCK, chunk: int = CHUNK, lane: int = LANE) -> DataFrame:
    """Per row ``doc_id``, ``n_a``, ``n_b`` tokens, ``n_groups``, ``n_links``, ``n_best``, ``count_sum`` and ``groups_sha256``.

    A pair's count: how many texts hold it linked. ``n_best``: links whose pair
    has the highest count of its A id; ``count_sum``: the sum over all links.
    ``folder`` is read on the driver. ``block``, ``chunk`` and ``lane`` change
    how the work is cut and no result.
    """
    spark = docs.sparkSession
    files = load(folder)
    size = len(Tokenizers(*files).b_bytes)
    kind = docs.schema["doc_id"].dataType
    numbers = ", ".join(f"{c} array<bigint>" for c in _COUNTS)
    columns = f"doc_id array<{kind.simpleString()}>, {numbers}, groups_sha256 array<string>, sizes binary, step binary, n binary, pairs array<bigint>, texts array<bigint>"
    aligned = docs.select("doc_id", "text").mapInArrow(_align(spark.sparkContext.broadcast(files), block, chunk, lane), columns)
    chunks = materialize(aligned.withColumn("chunk", F.monotonically_increasing_id()), "aligned")
    asked = chunks.select("chunk", F.explode(F.arrays_zip("pairs", "texts")).alias("_p")).select("chunk", F.col("_p.pairs").alias("pair"), F.col("_p.texts").alias("texts"))
    counts = materialize(asked.groupBy("pair").agg(F.sum("texts").alias("count")), "pair-counts")
    a = F.call_function("div", F.col("pair"), F.lit(size))
    most = counts.groupBy(a.alias("a")).agg(F.max("count").alias("most"))
    counts = counts.withColumn("a", a).join(most, "a").select("pair", "count", (F.col("count") == F.col("most")).cast("bigint").alias("best"))
    answers = asked.select("chunk", "pair").join(counts, "pair").select("chunk", "pair", "count", "best")
    kept = chunks.drop("pairs", "texts").withColumn("of", F.col("chunk")).drop("chunk")
    result = f"doc_id {kind.simpleString()}, {', '.join(c + ' bigint' for c in _COUNTS)}, n_best bigint, count_sum bigint, groups_sha256 string"
    return kept.groupBy("of").cogroup(answers.groupBy("chunk")).applyInArrow(_sum_up(to_arrow_type(kind)), result)
