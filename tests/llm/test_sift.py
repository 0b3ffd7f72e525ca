"""Documents that are not asked for stay where they are, and what is sent is named once."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from clickloom.llm import exchange as X, ngram_join, suffix_dedup
from clickloom.llm.sift import maybe_among


@pytest.mark.parametrize("most_bits, few", [(1 << 26, True), (1 << 16, False)])
def test_no_wanted_row_is_left_out(spark, most_bits, few):
    """However small the table: fewer bits flag more rows, never fewer."""
    rows = spark.range(-3000, 60000).select(F.when(F.col("id") != 7, F.col("id")).alias("id"))
    wanted = spark.range(-20000, 3000).union(spark.range(5))
    key = F.xxhash64("id")
    found = maybe_among(rows, key, wanted, key, "maybe", most_bits)
    assert found.columns == ["id", "maybe"] and found.count() == 63000
    held = found.filter("maybe")
    assert held.filter("id < 3000").count() == 5999
    assert (held.count() < 6000 + 0.08 * 57000) == few
    none = maybe_among(rows, key, wanted.limit(0), key, "maybe")
    assert none.filter("not maybe").count() == 63000


def test_other_documents_are_not_moved(spark, monkeypatch):
    """Before, each time texts were needed all documents were dealt anew."""
    rng = random.Random(3)
    texts = [" ".join(f"w{rng.randrange(5000)}" for _ in range(60)) for _ in range(400)]
    near = [t.replace(" ", " new ", 1) for t in texts[:9]] + texts[9:12]
    rows = [(i, t) for i, t in enumerate([*texts, *near])]
    docs, moved = spark.createDataFrame(rows, "doc_id int, text string").selectExpr("cast(doc_id as bigint) doc_id", "text"), []

    def seen(*args):
        out = maybe_among(*args)
        moved.append(out.filter(args[4]).count())
        return out

    monkeypatch.setattr(ngram_join, "maybe_among", seen)
    kept = ngram_join.keep_first(docs)
    assert sorted(r.doc_id for r in kept.collect()) == list(range(400))
    assert len(moved) > 1 and max(moved) < 40


def test_blocks_with_the_same_rows_have_one_name():
    """Two sets that meet in many buckets go on once."""
    rng = np.random.default_rng(2)
    a = np.unique(rng.integers(0, 1 << 63, 100).astype(np.uint64))
    sets = {1: a, 2: np.append(a[:-1], a[-1] + np.uint64(5)), 3: np.unique(rng.integers(0, 1 << 63, 100).astype(np.uint64))}
    rows = [(bucket, role, name) for bucket in (5, 6, 7, 8) for role in (0, 1) for name in ((1, 2, 3) if bucket < 8 else (1, 3))]
    table = pa.table({
        "bucket": [r[0] for r in rows], "i": [0] * len(rows), "j": [r[0] % 2 for r in rows], "role": pa.array([r[1] for r in rows], pa.int32()), "set_id": [r[2] for r in rows],
        "n_shingles": [len(sets[r[2]]) for r in rows], "component": [r[2] for r in rows], "asks": pa.array([True] * len(rows)), "point": [ngram_join._point(sets[r[2]]) for r in rows]})
    found = ngram_join._tree_near(4, 5)(table).to_pylist()
    assert len({(r["bucket"], r["i"], r["j"]) for r in found}) == 1 and len(found) > 3
    assert {r["set_id"] for r in found} == {1, 2}


def test_anchors_are_short():
    """Rising anchors of a chunk take fewer bytes than whole hashes do."""
    data = np.random.default_rng(1).integers(97, 123, 200_000).astype(np.uint8)
    keys = np.unique(suffix_dedup.anchors(data, np.array([0, 100_000, 200_000]))[0])
    assert len(X.pack_sorted(keys)) < 5.5 * len(keys)
