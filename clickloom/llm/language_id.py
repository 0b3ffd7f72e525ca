"""Language of a text by the nearest centroid of its TF-IDF vector.

A text's vector counts its hashed byte trigrams (lower case, all but letters as
blanks), weighted with log(1 + count) and the inverse document frequency over
all training texts, at length 1. Each language has a few centroids, clustered
on a bounded sample; the nearest by cosine gives the language.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from clickloom.llm.textbytes import BLOCK, buffers

DIMS = 4096
CLUSTERS = 4
#: Texts of a language that its centroids are clustered on.
SAMPLE = 1000
LANGUAGES = 2000
FOLDS, HELD_OUT = 5, 0
UNKNOWN = "und"


def _letters() -> np.ndarray:
    table = np.full(256, 32, np.uint8)
    table[97:123] = np.arange(97, 123)
    table[65:91] = np.arange(97, 123)
    table[128:] = np.arange(128, 256)
    return table


_LETTERS = _letters()


def counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Documents by hashed trigrams, as whole counts; long texts in blocks."""
    out = np.zeros((len(offsets) - 1, DIMS), np.float32)
    doc, n = 0, len(out)
    while doc < n:
        to = max(doc + 1, int(np.searchsorted(offsets, offsets[doc] + BLOCK, "right")) - 1)
        for lo in range(int(offsets[doc]), int(offsets[to]), BLOCK):
            hi = min(int(offsets[to]), lo + BLOCK + 2)  # a trigram may reach into the next block
            text = _LETTERS[data[lo:hi]]
            lead = np.concatenate([[False], text[:-1] == 0xC3])
            text[lead & (text >= 0x80) & (text <= 0x9E) & (text != 0x97)] += 0x20  # accented capitals
            if len(text) < 3:
                continue
            wide = text.astype(np.uint32)
            key = (wide[:-2] << 16 | wide[1:-1] << 8 | wide[2:]) * np.uint32(0x9E3779B1)
            at = np.repeat(np.arange(doc, to), np.diff(np.clip(offsets[doc : to + 1] - lo, 0, hi - lo)))
            whole = (at[:-2] == at[2:]) & (text[1:-1] != 32)
            flat = (at[:-2][whole] - doc) * DIMS + (key[whole] >> np.uint32(20)).astype(np.int64)
            out[doc:to] += np.bincount(flat, minlength=(to - doc) * DIMS).reshape(to - doc, DIMS)
        doc = to
    return out


def vectors(found: np.ndarray, idf: np.ndarray) -> np.ndarray:
    out = np.log1p(found) * idf
    size = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, size, out=np.zeros_like(out), where=size > 0)


def _frequencies(batches):
    """For each trigram the number of texts with it, and at DIMS that of all texts."""
    total = np.zeros(DIMS + 1, np.int64)
    for batch in batches:
        for lo in range(0, len(batch), 256):
            part = batch.slice(lo, 256)
            total[:DIMS] += (counts(*buffers(part["text"])) > 0).sum(axis=0)
            total[DIMS] += len(part)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(DIMS + 1), pa.int32()), pa.array(total, pa.int64())], names=["dim", "n"])


def _cluster(idf: np.ndarray, clusters: int):
    def fit(table: pa.Table) -> pa.Table:
        """Spherical k-means from evenly spaced rows in the order of ids."""
        table = table.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        points = np.concatenate([vectors(counts(*buffers(table.slice(lo, 256)["text"])), idf) for lo in range(0, len(table), 256)])
        points = points[np.linalg.norm(points, axis=1) > 0]
        k = min(clusters, len(points))
        centres = points[np.arange(k) * len(points) // max(k, 1)]
        for _ in range(12):
            near = (points @ centres.T).argmax(axis=1) if k else np.zeros(0, int)
            for c in range(k):
                own = points[near == c]
                if len(own):
                    mean = own.mean(axis=0)
                    centres[c] = mean / np.linalg.norm(mean)
        return pa.table({"lang": pa.array([table["lang"][0].as_py()] * k, pa.string()), "cluster": pa.array(range(k), pa.int32()),
                         "centre": pa.array([c.astype(np.float32).tobytes() for c in centres], pa.binary())})

    return fit


class Model:
    def __init__(self, idf: np.ndarray, langs: list[str], centres: np.ndarray) -> None:
        self.idf, self.langs, self.centres = idf, langs, centres


def learn(docs: DataFrame, clusters: int = CLUSTERS, sample: int = SAMPLE) -> Model:
    """Document frequencies over all given rows (doc_id, text, lang), centroids on about ``sample`` texts a language."""
    rows = docs.select("text").mapInArrow(_frequencies, "dim int, n bigint").groupBy("dim").agg(F.sum("n").alias("n")).collect()
    seen = np.zeros(DIMS + 1)
    for r in rows:
        seen[r["dim"]] = r["n"]
    idf = (np.log((1 + seen[DIMS]) / (1 + seen[:DIMS])) + 1).astype(np.float32)
    many = docs.groupBy("lang").agg(F.count("*").alias("n")).limit(LANGUAGES + 1).collect()
    if len(many) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    if not many:
        return Model(idf, [], np.zeros((0, DIMS), np.float32))
    shares = docs.sparkSession.createDataFrame([(r["lang"], min(1.0, sample / r["n"])) for r in many], "lang string, share double")
    place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)
    some = docs.select("doc_id", "text", "lang").join(F.broadcast(shares), "lang").filter(place < F.col("share")).drop("share")
    found = some.groupBy("lang").applyInArrow(_cluster(idf, clusters), "lang string, cluster int, centre binary").collect()
    found = sorted(found, key=lambda r: (r["lang"], r["cluster"]))
    return Model(idf, [r["lang"] for r in found], np.array([np.frombuffer(r["centre"], np.float32) for r in found]).reshape(-1, DIMS))


def _nearest(shared, reject: float | None):
    def read(batches):
        model = shared.value
        for batch in batches:
            for lo in range(0, len(batch), 256):
                part = batch.slice(lo, 256)
                close = vectors(counts(*buffers(part["text"])), model.idf) @ model.centres.T
                best = close.argmax(axis=1) if model.langs else np.zeros(len(part), int)
                score = np.clip(close[np.arange(len(part)), best], 0, 1) if model.langs else np.zeros(len(part))
                known = np.array(part["letters"].to_pylist(), bool)
                if reject is not None:
                    known &= 1 - score <= reject
                lang = [model.langs[b] if k and model.langs else UNKNOWN for b, k in zip(best.tolist(), known.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [part["doc_id"], part["held_out"], pa.array(lang, pa.string()), pa.array(np.where(known, score, 0.0), pa.float64())],
                    names=["doc_id", "held_out", "lang_pred", "score"])

    return read


def _remainder():
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % FOLDS


def identify(docs: DataFrame, reject: float | None = None, clusters: int = CLUSTERS, sample: int = SAMPLE) -> DataFrame:
    """The language of each text.

    Reads ``doc_id``, ``text`` and, of training rows only, ``lang``; other
    columns play no part. Training rows have a lang, a text and a crc32 of the
    id's digits whose remainder by 5 is not 0; a null id counts as an empty
    one. Each row gives one: doc_id, held_out (remainder 0), lang_pred and
    score (the cosine to the nearest centroid, 0 to 1). A text that is null or
    has no letter gives ``und`` and 0, as does, where ``reject`` is set, one
    with a cosine distance above it. Ties go to the lang that sorts first. With
    no training rows all are ``und``. At most LANGUAGES langs are learned.
    """
    fold = _remainder()
    model = learn(docs.filter("lang is not null and text is not null").filter(fold != HELD_OUT), clusters, sample)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    own = docs.select("doc_id", "text", (fold == HELD_OUT).alias("held_out"), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    return own.mapInArrow(_nearest(shared, reject), "doc_id bigint, held_out boolean, lang_pred string, score double")
