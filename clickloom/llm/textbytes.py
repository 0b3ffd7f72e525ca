"""Arrow text columns as flat bytes: words, word hashes and shingles of many documents at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Bytes handled at once; longer documents are cut between words.
BLOCK = 1 << 20

U64 = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit scrambler."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _stream(seed: int, n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed))


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all values, and where each starts (one more than values). A null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if not pa.types.is_large_binary(column.type):
        column = column.cast(pa.binary()).cast(pa.large_binary())
    column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    data = column.buffers()[2]
    flat = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return flat[offsets[0] : offsets[-1]], offsets - offsets[0]


class Words:
    """How text is cut into words: ``word[b]`` says whether byte b, lower-cased, belongs to one."""

    def __init__(self, word: np.ndarray) -> None:
        self.lower = np.arange(256, dtype=np.uint8)
        self.lower[65:91] += 32
        self.word = word[self.lower]
        values = _stream(11, 256)
        self.value = np.where(self.word, values[self.lower], U64(0))
        self.power = _stream(23, 64) | U64(1)

    def _powers(self, n: int) -> np.ndarray:
        if n > len(self.power):
            self.power = _stream(23, 2 * n) | U64(1)
        return self.power

    def spans(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte starts and ends of all words; none crosses a document's end."""
        inside = self.word[data]
        if not len(inside):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        cuts = offsets[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < len(data))]
        first[cuts] = inside[cuts]
        last[cuts - 1] = inside[cuts - 1]
        return np.flatnonzero(first), np.flatnonzero(last) + 1

    def _hashes(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if not len(starts):
            return np.zeros(0, U64)
        lengths = np.diff(np.append(starts, len(data)))
        place = np.arange(starts[0], len(data)) - np.repeat(starts, lengths)
        powers = self._powers(int((ends - starts).max()))
        np.minimum(place, len(powers) - 1, out=place)  # beyond a word's end the value is 0
        terms = self.value[data[starts[0] :]] * powers[place]
        return mix(np.add.reduceat(terms, starts - starts[0]) + (ends - starts).astype(U64))

    def _blocks(self, data: np.ndarray, offsets: np.ndarray):
        """Runs of documents up to BLOCK bytes; longer documents in parts cut at separators."""
        doc, n = 0, len(offsets) - 1
        while doc < n:
            to = max(doc + 1, int(np.searchsorted(offsets, offsets[doc] + BLOCK, "right")) - 1)
            if to > doc + 1 or offsets[to] - offsets[doc] <= BLOCK:
                yield offsets[doc], offsets[to], offsets[doc : to + 1] - offsets[doc]
            else:
                lo, hi = int(offsets[doc]), int(offsets[to])
                while lo < hi:
                    cut = min(lo + BLOCK, hi)
                    while cut < hi:
                        gap = np.flatnonzero(~self.word[data[cut : min(cut + BLOCK, hi)]])
                        if len(gap):
                            cut += int(gap[0])
                            break
                        cut = min(cut + BLOCK, hi)
                    yield lo, cut, np.array([0, cut - lo])
                    lo = cut
            doc = to

    def hashes(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The 64-bit hashes of all words, and where each document's start among them."""
        parts, at = [], []
        for lo, hi, inner in self._blocks(data, offsets):
            piece = data[lo:hi]
            starts, ends = self.spans(piece, inner)
            parts.append(self._hashes(piece, starts, ends))
            at.append(starts + lo)
        found = np.concatenate(at) if at else np.zeros(0, np.int64)
        return (np.concatenate(parts) if parts else np.zeros(0, U64)), np.searchsorted(found, offsets)


def _spaced() -> np.ndarray:
    word = np.ones(256, bool)
    word[[0x20, *range(0x09, 0x0E)]] = False
    return word


def _alnum() -> np.ndarray:
    word = np.zeros(256, bool)
    word[0x30:0x3A] = word[0x61:0x7B] = word[0x80:] = True
    return word


#: Words between blanks, and runs of ASCII digits, letters and all other characters beyond ASCII.
SPACED, ALNUM = Words(_spaced()), Words(_alnum())


def fold(words: np.ndarray, k: int) -> np.ndarray:
    """A hash for each run of k words; empty if there are fewer."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = words[:n] + U64(k)
    for j in range(1, k):
        out = mix(out) * U64(0x9E3779B97F4A7C15) + words[j : j + n]
    return mix(out)


def shingle_set(words: np.ndarray, k: int) -> np.ndarray:
    """The sorted distinct hashes of a document's runs of k words; all words as one if there are fewer."""
    if not len(words):
        return words
    return np.unique(fold(words, min(k, len(words))))
