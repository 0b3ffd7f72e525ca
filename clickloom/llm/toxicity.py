"""Toxicity of texts by a support vector machine on gapped subsequences.

The string kernel of two words counts the subsequences of a few bytes that both
have, each discounted by the stretch it spans, so that inserted characters cost
a little and not all. Words are compared with landmark words only (Nyström): a
sentence is represented by its best kernel value per landmark, turned by the
inverse root of the landmarks' own kernel matrix, and a linear machine learned
on sentences of labelled texts decides. A text is as toxic as its worst
sentence; the score is a logistic curve through training texts.
"""

from __future__ import annotations

from collections import Counter
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from clickloom.llm.textbytes import BLOCK, SPACED, buffers, mix

LANDMARKS = 64
#: Labelled texts that the machine is trained on, at most about.
SAMPLE = 6000
ORDER, DECAY = 3, 0.6
#: Bytes of a word that are compared at once; longer words are compared in overlapping stretches.
WIDTH = 24
#: What inserted characters leave of a word's similarity, in the copies of toxic sentences that training adds.
INSERTED = 0.75
#: The machine sees this power of the kernel (a kernel as well), so that the little all words have in common says little.
POWER = 3
#: From this similarity a word counts as the landmark itself.
CLOSE = 0.95
#: Words shorter than this say nothing.
LEAST = 3
FOLDS, HELD_OUT = 5, 0

U64 = np.uint64
_PUNCT = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def fold_case(data: np.ndarray) -> np.ndarray:
    """Lower case of ASCII and of the accented Latin letters behind a 0xC3 byte."""
    out = data.copy()
    out[(data >= 65) & (data <= 90)] += 32
    lead = np.concatenate([[False], data[:-1] == 0xC3]) if len(data) else np.zeros(0, bool)
    out[lead & (data >= 0x80) & (data <= 0x9E) & (data != 0x97)] += 0x20
    return out


def kernel(words: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Subsequence kernels of pairs of words, both as rows of bytes filled up with zeros."""
    n, length = marks.shape
    decay = np.float32(DECAY)
    j = np.arange(length)
    spread = np.where(j[None, :] >= j[:, None], decay ** (j[None, :] - j[:, None]).clip(0), 0).astype(np.float32)
    total = np.zeros(n, np.float32)
    ahead = [np.ones((n, length), np.float32), *(np.zeros((n, length), np.float32) for _ in range(ORDER - 1))]
    for i in range(words.shape[1]):
        letter = words[:, i : i + 1]
        match = ((marks == letter) & (letter != 0)).astype(np.float32) * (decay * decay)
        last = ahead[ORDER - 1]
        total += (match[:, 1:] * last[:, :-1]).sum(axis=1)
        for level in range(ORDER - 1, 0, -1):
            below = ahead[level - 1]
            step = match.copy()
            if level > 1:
                step[:, 1:] *= below[:, :-1]
                step[:, 0] = 0
            ahead[level] = decay * ahead[level] + step @ spread
    return total


def by_length(words: np.ndarray, step: int):
    """Runs of up to ``step`` places of rows about as long as each other, with that length."""
    size = (words != 0).sum(axis=1)
    order = np.argsort(size, kind="stable")
    for lo in range(0, len(order), step):
        some = order[lo : lo + step]
        yield some, max(int(size[some[-1]]), 1)


def own_kernel(words: np.ndarray) -> np.ndarray:
    out = np.zeros(len(words), np.float32)
    for some, size in by_length(words, 1024):
        rows = words[some, :size]
        out[some] = kernel(rows, rows)
    return out


@lru_cache(maxsize=None)
def _places(size: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of all subsequences of ORDER bytes in a word of ``size`` bytes, and the discount of each."""
    at = np.array(list(combinations(range(size), ORDER)), np.int64).reshape(-1, ORDER)
    return at, (DECAY ** (at[:, -1] - at[:, 0] + 1)).astype(np.float32)


def matrix(words: list[bytes], width: int = WIDTH) -> np.ndarray:
    out = np.zeros((len(words), width), np.uint8)
    for i, w in enumerate(words):
        out[i, : len(w)] = np.frombuffer(w, np.uint8)
    return out


class Marks:
    """Landmark words and the similarity of words to them: the kernel of every pair, by a list of the landmarks' subsequences."""

    def __init__(self, words: list[bytes]) -> None:
        self.words = words
        width = max((len(w) for w in words), default=1)
        self.rows = matrix(words, width)
        self.norm = np.sqrt(own_kernel(self.rows))
        letters = np.unique(self.rows[self.rows != 0])
        self.letter = np.zeros(256, np.int32)  # 0 stands for all bytes that no landmark has
        self.letter[letters] = np.arange(1, len(letters) + 1)
        self.base = len(letters) + 1
        codes, marks, weights = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], [np.zeros(0, np.float32)]
        for m, w in enumerate(words):
            at, discount = _places(len(w))
            codes.append(self._codes(self.rows[m : m + 1], at)[0])
            marks.append(np.full(len(at), m))
            weights.append(discount)
        codes, marks, weights = map(np.concatenate, (codes, marks, weights))
        # Per distinct subsequence the landmarks that have it, with their summed discounts.
        both, of = np.unique(codes.astype(np.int64) * max(len(words), 1) + marks, return_inverse=True)
        code, self.mark = np.divmod(both, max(len(words), 1))
        self.weight = np.bincount(of, weights, len(both))
        distinct, self.start, self.many = np.unique(code, return_index=True, return_counts=True)
        self.slot = np.full(self.base**ORDER, -1, np.int32)
        self.slot[distinct] = np.arange(len(distinct))

    def _codes(self, words: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The subsequences at these places of each word as numbers."""
        letter = self.letter[words]
        code = letter[:, at[:, 0]]
        for k in range(1, ORDER):
            code = code * np.int32(self.base) + letter[:, at[:, k]]
        return code

    def like(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The words that share a subsequence with a landmark, rising, and their similarity to each landmark; that of all others is 0."""
        size = ((words != 0) * np.arange(1, words.shape[1] + 1)).max(axis=1, initial=0)
        found, values = [np.zeros(0, np.int64)], [np.zeros((0, len(self.words)), np.float32)]
        for length in range(ORDER, words.shape[1] + 1) if self.words else ():
            rows = np.flatnonzero(size == length)
            at, discount = _places(length)
            step = max(1, (1 << 18) // len(at))
            for lo in range(0, len(rows), step):
                some = rows[lo : lo + step]
                slot = self.slot[self._codes(words[some], at)].reshape(-1)
                hit = np.flatnonzero(slot >= 0)
                slot, (word, place) = slot[hit], np.divmod(hit, len(at))
                many = self.many[slot]
                entry = np.repeat(self.start[slot] - np.cumsum(many) + many, many) + np.arange(many.sum())
                cell = np.repeat(word * len(self.words), many) + self.mark[entry]
                value = np.bincount(cell, np.repeat(discount[place], many) * self.weight[entry], len(some) * len(self.words))
                value = value.reshape(len(some), -1)
                has = np.flatnonzero(value.any(axis=1))
                found.append(some[has])
                values.append(value[has].astype(np.float32))
        found, value = np.concatenate(found), np.concatenate(values)
        order = np.argsort(found)
        found, value = found[order], value[order]
        return found, value / np.maximum(np.sqrt(own_kernel(words[found]))[:, None] * self.norm, 1e-12)


class Sentences:
    """The words of some texts: which distinct word stands in which sentence of which text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        low = fold_case(data)
        hashes, at = SPACED.hashes(low, offsets)
        starts, ends = SPACED.spans(low, offsets)
        starts, ends, hashes = self._spelled(low, starts, ends, hashes, np.repeat(np.arange(len(at) - 1), np.diff(at)))
        self.texts = len(offsets) - 1
        _, first, self.word = np.unique(hashes, return_index=True, return_inverse=True)
        self.words = []
        stops = np.flatnonzero((low == 46) | (low == 33) | (low == 63) | (low == 10))
        self.text = np.searchsorted(offsets, starts, "right") - 1
        sentence = np.searchsorted(stops, starts)
        new = np.append(True, (sentence[1:] != sentence[:-1]) | (self.text[1:] != self.text[:-1]))[: len(starts)]
        self.sentence = np.cumsum(new) - 1
        self.text_of = self.text[new]
        a, b = starts[first], ends[first]
        for _ in range(WIDTH):
            trim = (a < b) & _PUNCT[low[np.minimum(a, max(len(low) - 1, 0))]]
            a = a + trim
            cut = (a < b) & _PUNCT[low[b - 1]]
            b = b - cut
            if not (trim.any() or cut.any()):
                break
        # Long words in overlapping stretches; rows of bytes, and the word of each row.
        size = b - a
        many = np.where(size < LEAST, 0, 1 + np.maximum(0, -(-(size - WIDTH) // (WIDTH // 2))))
        self.row_word = np.repeat(np.arange(len(a)), many)
        shift = (np.arange(len(self.row_word)) - np.repeat(np.cumsum(many) - many, many)) * (WIDTH // 2)
        begin = a[self.row_word] + shift
        place = begin[:, None] + np.arange(WIDTH)
        inside = place < b[self.row_word][:, None]
        self.rows = np.where(inside, low[np.minimum(place, max(len(low) - 1, 0))], 0).astype(np.uint8) if len(low) else np.zeros((0, WIDTH), np.uint8)
        # Blanks and signs inside a word go, so that spelled-out words close up.
        odd = np.flatnonzero((_PUNCT[self.rows] & (self.rows != 0)).any(axis=1))
        if len(odd):
            some = self.rows[odd]
            some[_PUNCT[some]] = 0
            self.rows[odd] = np.take_along_axis(some, np.argsort(some == 0, axis=1, kind="stable"), axis=1)

    @staticmethod
    def _spelled(low, starts, ends, hashes, text):
        """Three or more single letters in a row are one word."""
        single = (ends - starts == 1)
        if single.any():
            single &= ~_PUNCT[low[starts]]
            edge = np.flatnonzero(np.diff(np.concatenate([[0], single.astype(np.int8), [0]])))
            keep = np.ones(len(starts), bool)
            ends, hashes = ends.copy(), hashes.copy()
            for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
                if b - a >= 3 and text[a] == text[b - 1]:
                    ends[a] = ends[b - 1]
                    hashes[a] = mix(hashes[a:b] * (np.arange(b - a, dtype=U64) * U64(2) + U64(3))).sum()
                    keep[a + 1 : b] = False
            starts, ends, hashes = starts[keep], ends[keep], hashes[keep]
        return starts, ends, hashes

    def best(self, marks: Marks) -> tuple[np.ndarray, np.ndarray]:
        """Sentences that have words that share a subsequence with a landmark, and their best similarity per landmark."""
        known, like = marks.like(self.rows)
        if not len(known):
            return known, like
        distinct, first = np.unique(self.row_word[known], return_index=True)
        best = np.maximum.reduceat(like, first, axis=0)
        have = np.full(int(self.word.max()) + 1, -1)
        have[distinct] = np.arange(len(distinct))
        hit = np.flatnonzero(have[self.word] >= 0)
        sentence, first = np.unique(self.sentence[hit], return_index=True)
        return sentence, np.maximum.reduceat(best[have[self.word[hit]]], first, axis=0)


def _blocks(data: np.ndarray, offsets: np.ndarray):
    """Texts in groups of up to BLOCK bytes; a longer text in parts cut at blanks, all with its number."""
    for lo, hi, inner in SPACED._blocks(data, offsets):
        first = int(np.searchsorted(offsets, lo, "right")) - 1 if len(inner) == 2 else int(np.searchsorted(offsets, lo, "left"))
        yield first, data[lo:hi], inner


class Model:
    """What training found; without labels of both kinds, the share of toxic ones for all."""

    def __init__(self, share: float) -> None:
        self.marks, self.turn, self.weights, self.bias = Marks([]), np.zeros((0, 0)), np.zeros(0), 0.0
        self.slope, self.shift, self.share = 0.0, 0.0, share

    def worst(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The largest decision value over each text's sentences."""
        out = np.full(len(offsets) - 1, self.bias)
        if self.marks.words:
            for first, piece, inner in _blocks(data, offsets):
                some = Sentences(piece, inner)
                sentence, best = some.best(self.marks)
                if len(sentence):
                    np.maximum.at(out, first + some.text_of[sentence], best**POWER @ self.turn @ self.weights + self.bias)
        return out

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if not self.marks.words:
            return np.full(len(offsets) - 1, self.share)
        return 1 / (1 + np.exp(-np.clip(self.slope * self.worst(data, offsets) + self.shift, -50, 50)))


def _texts_with(data: np.ndarray, offsets: np.ndarray, toxic: np.ndarray) -> tuple[Counter, Counter]:
    """In how many toxic and how many other texts each word occurs, block by block."""
    inside, outside = Counter(), Counter()
    last, held = -1, set()  # a long text comes in parts
    for first, piece, inner in _blocks(data, offsets):
        some = Sentences(piece, inner)
        for t in np.unique(some.text).tolist():
            here = np.zeros(int(some.word.max()) + 1, bool)
            here[some.word[some.text == t]] = True
            if first + t != last:
                (inside if last >= 0 and toxic[last] else outside).update(held)
                last, held = first + t, set()
            held.update(bytes(r[r != 0]) for r in some.rows[here[some.row_word]])
    (inside if last >= 0 and toxic[last] else outside).update(held)
    return inside, outside


def _landmarks(inside: Counter, outside: Counter, toxic: np.ndarray, count: int) -> list[bytes]:
    """Words that toxic texts have most significantly more often, none much like one taken before."""
    n, m = toxic.sum(), (~toxic).sum()
    some = [w for w, k in inside.items() if k >= 2]
    k, l = np.array([inside[w] for w in some], float), np.array([outside[w] for w in some], float)
    mean = (k + l) / (n + m)
    z = (k / n - l / m) / np.sqrt(np.maximum(mean * (1 - mean) * (1 / n + 1 / m), 1e-12)) if some else k
    order = sorted((i for i in range(len(some)) if z[i] > 3), key=lambda i: (-z[i], some[i]))
    taken: list[bytes] = []
    for i in order[: 8 * count]:
        if len(taken) == count:
            break
        known = Marks(taken)
        if not taken or known.like(matrix([some[i]]))[1].max(initial=0) < 0.9:
            taken.append(some[i])
    return taken


def _svm(x: np.ndarray, of: np.ndarray, times: np.ndarray, y: np.ndarray, rounds: int = 60, block: int = 8192) -> tuple[np.ndarray, float]:
    """A linear machine under the squared hinge loss, both classes weighing the same, by Newton steps on the rows within the margin.

    The rows are ``times`` the rows ``of`` x, which are never copied as a whole.
    """
    weight = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1))
    width = x.shape[1] + 1
    ridge = np.full(width, 1e-4)
    ridge[-1] = 1e-9

    def margin(w):
        return y * (times * (x @ w[:-1])[of] + w[-1])

    def loss(w, margins):
        return (weight * np.maximum(0, 1 - margins) ** 2).sum() + 0.5 * (ridge * w * w).sum()

    w = np.zeros(width)
    margins = margin(w)
    now = loss(w, margins)
    for _ in range(rounds):
        inside = np.flatnonzero(margins < 1)
        square, goal = np.diag(ridge), np.zeros(width)
        for lo in range(0, len(inside), block):
            at = inside[lo : lo + block]
            rows = np.append(times[at, None] * x[of[at]], np.ones((len(at), 1)), axis=1)
            heavy = 2 * weight[at, None] * rows
            square, goal = square + heavy.T @ rows, goal + heavy.T @ y[at]
        goal = np.linalg.solve(square, goal)
        step = 1.0
        while step > 1e-4 and loss(w + step * (goal - w), margin(w + step * (goal - w))) > now:
            step /= 2
        w = w + step * (goal - w)
        margins = margin(w)
        before, now = now, loss(w, margins)
        if before - now <= 1e-9:
            break
    return w[:-1], float(w[-1])


def train(texts: pa.Array, toxic: np.ndarray, landmarks: int = LANDMARKS) -> Model:
    model = Model(float(toxic.mean()) if len(toxic) else 0.0)
    if not toxic.any() or toxic.all():
        return model
    data, offsets = buffers(texts)
    # The blocks are gone through twice, once for the landmarks and once for the sentences, so that one is held at a time.
    marks = Marks(_landmarks(*_texts_with(data, offsets, toxic), toxic, landmarks))
    if not marks.words:
        return model
    own = np.array([[0.0]])
    rows = matrix(marks.words)
    m = len(marks.words)
    a, b = np.divmod(np.arange(m * m), m)
    own = (kernel(rows[a], marks.rows[b]) / (marks.norm[a] * marks.norm[b])).reshape(m, m).astype(float) ** POWER
    value, vector = np.linalg.eigh((own + own.T) / 2)
    turn = vector / np.sqrt(np.maximum(value, 1e-2)) @ vector.T
    x, text, closest = [], [], []
    for first, piece, inner in _blocks(data, offsets):
        some = Sentences(piece, inner)
        sentence, best = some.best(marks)
        if len(sentence):
            x.append(best**POWER @ turn)
            text.append(first + some.text_of[sentence])
            closest.append(best.max(axis=1, initial=0))
    x, text = np.concatenate([*x, np.zeros((1, m))]), np.concatenate([np.zeros(0, np.int64), *text])
    none = len(x) - 1  # the row of a sentence with no word like a landmark
    strength = closest = np.concatenate([np.zeros(0, np.float32), *closest])
    # A toxic text is known by its worst sentence, which training itself has to find, and by those with a landmark
    # as it stands; all of a clean text's are clean.
    for _ in range(3):
        order = np.lexsort((-strength, text))
        head = order[np.append(True, text[order][1:] != text[order][:-1])] if len(order) else order
        telling = np.flatnonzero(toxic[text] & (closest >= CLOSE))
        positive = np.union1d(head[toxic[text[head]]], telling)
        negative = np.flatnonzero(~toxic[text])
        empty = np.full(max(1, int((~toxic).sum())), none)
        of = np.concatenate([positive, positive, negative, empty])
        times = np.repeat([1.0, INSERTED**POWER, 1.0], [len(positive), len(positive), len(negative) + len(empty)])
        w, c = _svm(x, of, times, np.repeat([1.0, -1.0], [2 * len(positive), len(negative) + len(empty)]))
        strength = x[:none] @ w + c
    model.marks, model.turn, model.weights, model.bias = marks, turn, w, c
    worst = np.full(len(toxic), c)
    np.maximum.at(worst, text, strength)
    # A logistic curve through the training texts.
    slope, shift = 1.0, 0.0
    share = np.full(len(toxic), 1 / len(toxic))
    for _ in range(2000):
        p = 1 / (1 + np.exp(-np.clip(slope * worst + shift, -50, 50)))
        error = (toxic - p) * share
        slope, shift = slope + 2.0 * ((error * worst).sum() - 1e-3 * slope), shift + 2.0 * error.sum()
    model.slope, model.shift = max(float(slope), 1e-3), float(shift)
    return model


def _remainder():
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % FOLDS


def learn(docs: DataFrame, labels: DataFrame, landmarks: int = LANDMARKS, sample: int = SAMPLE) -> Model:
    """Train in one task on about ``sample`` labelled rows that are not held out, chosen by a hash of their id."""
    import pickle

    marked = labels.filter("doc_id is not null and toxic is not null").filter(_remainder() != HELD_OUT)
    marked = marked.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    many = marked.count()
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    marked = marked.filter(place < min(1.0, sample / max(many, 1)))
    some = docs.select("doc_id", "text").join(F.broadcast(marked), "doc_id").select("doc_id", "text", "toxic")

    def fit(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        model = train(table["text"], np.array(table["toxic"].to_pylist()) > 0, landmarks)
        return pa.table({"model": pa.array([pickle.dumps(model)], pa.binary())})

    found = some.groupBy(F.lit(0).alias("all")).applyInArrow(fit, "model binary").collect()
    return pickle.loads(found[0]["model"]) if found else Model(0.0)


def _score(shared):
    def read(batches):
        model = shared.value
        for batch in batches:
            for lo in range(0, len(batch), 512):
                part = batch.slice(lo, 512)
                score = model.scores(*buffers(part["text"]))
                yield pa.RecordBatch.from_arrays(
                    [part["doc_id"], part["held_out"], pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32))],
                    names=["doc_id", "held_out", "score", "predicted"])

    return read


def score(docs: DataFrame, labels: DataFrame, landmarks: int = LANDMARKS, sample: int = SAMPLE) -> DataFrame:
    """How toxic each text is, as the labels have it.

    Reads ``doc_id`` and ``text`` of ``docs``, ``doc_id`` and ``toxic`` of
    ``labels``; other columns play no part. Learns from about ``sample``
    labelled rows with a crc32 of the id's digits whose remainder by 5 is not 0.
    Each row gives one: doc_id, held_out (remainder 0; a null id counts as an
    empty one), score (0 to 1) and predicted (1 from 0.5). A null text is
    empty; a text with no telling word gets the score of the bare bias. A
    document labelled more than once is toxic if one label says so; null labels
    teach nothing. With labels of one kind only, or none, all get the share of
    toxic ones.
    """
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, landmarks, sample))
    own = docs.select("doc_id", "text", (_remainder() == HELD_OUT).alias("held_out"))
    return own.mapInArrow(_score(shared), "doc_id bigint, held_out boolean, score double, predicted int")


def keep_clean(docs: DataFrame, labels: DataFrame, landmarks: int = LANDMARKS, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs``, all columns, whose text is not predicted toxic (see ``score``). Moves no row."""
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, landmarks, sample))

    def keep(batches):
        for batch in batches:
            for lo in range(0, len(batch), 512):
                part = batch.slice(lo, 512)
                yield part.filter(pa.array(shared.value.scores(*buffers(part["text"])) < 0.5))

    return docs.mapInArrow(keep, docs.schema)
