"""The pipeline's stages keep to their contracts."""

import corpus_pipeline
from clickloom.session import materialize
from test_text_operators import components, hits

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = materialize(stage(spark, docs, SF), name)
        assert after.columns == columns
        assert after.select("doc_id").subtract(docs.select("doc_id")).count() == 0
        docs = after
    mixed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert mixed.count() == docs.count()
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(map(tuple, mixed.collect()))


def test_empty(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0


def _cut(rows, length):
    """Texts without the bytes of strings that start in a row with a smaller id; characters cut in part stay."""
    first = {}
    for i, t in rows:
        raw = t.encode()
        for j in range(len(raw) - length + 1):
            first[raw[j : j + length]] = min(first.get(raw[j : j + length], i), i)
    out = {}
    for i, t in rows:
        raw = t.encode()
        cover = bytearray(len(raw))
        for j in range(len(raw) - length + 1):
            if first[raw[j : j + length]] < i:
                cover[j : j + length] = b"\x01" * length
        kept, at = [], 0
        for char in t:
            size = len(char.encode())
            if not all(cover[at : at + size]):
                kept.append(char)
            at += size
        out[i] = "".join(kept)
    return out


def test_stages_match_brute_force(spark):
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    kept = {r["doc_id"] for r in stages["ngram_jaccard"](spark, docs, SF).collect()}
    assert kept == {i for i, _, top in components(rows, 5, 4, 5) if i == top}
    cut = {r["doc_id"]: (r["text"], r["n_chars"]) for r in stages["suffix_dedup"](spark, docs, SF).collect()}
    expected = _cut(rows, 50)
    old = {r["doc_id"]: r["n_chars"] for r in docs.collect()}
    assert cut == {i: (t, len(t) if t != dict(rows)[i] else old[i]) for i, t in expected.items()}
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    clean = {r["doc_id"] for r in stages["decontaminate"](spark, docs, SF).collect()}
    assert clean == {r[0] for r in hits(rows, items, 13) if not r[5]}


def test_near_duplicates_go_row_by_row(spark):
    """Rows that share an id go for their own text; repeated rows leave one; rows without id or words stay."""
    text = " ".join(f"w{i}" for i in range(60))
    near, other = text + " end", " ".join(f"v{i}" for i in range(60))
    rows = [(1, text), (2, near), (2, other), (3, other), (4, "alone"), (4, "alone"), (None, text), (None, text), (5, ""), (5, ""), (6, None), (7, "kept here"), (7, "and there")]
    docs = spark.createDataFrame([(i, t, f"s{n}") for n, (i, t) in enumerate(rows)], "doc_id bigint, text string, source string").selectExpr("*", "1 as first", "2 as _first", "3 as text_id")
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, SF)
    assert kept.columns == docs.columns
    found = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    assert found == sorted([(1, text), (2, other), (4, "alone"), (None, text), (None, text), (5, ""), (5, ""), (6, None), (7, "kept here"), (7, "and there")], key=str)
