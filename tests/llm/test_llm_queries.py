"""Every query of the package against SQL, where there is SQL, and by its contract otherwise."""

import sys
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from compare import connect  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from clickloom.llm import oracles, queries  # noqa: E402

SF = "/root/testdata/sf0.001"


def _rows(cursor_rows, columns, names):
    plain = [tuple(round(r[names.index(c)], 6) if isinstance(r[names.index(c)], float) else r[names.index(c)] for c in columns) for r in cursor_rows]
    return sorted(plain, key=str)


@pytest.mark.parametrize("name", list(oracles.oracle_sql()))
def test_matches_sql(spark, name):
    found = queries.queries()[name](spark, SF)
    cursor = connect(SF).execute(oracles.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    columns = sorted(found.columns)
    assert sorted(names) == columns
    assert _rows(found.collect(), columns, found.columns) == _rows(cursor.fetchall(), columns, names)


def test_all_are_registered():
    assert set(queries.queries()) < set(entry.queries())
    assert "pipeline" in entry.queries()
    assert {int(n[2:].split("_")[0]) for n in queries.queries()} == set(range(1, 14))


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang", "text")
    found = queries.queries()["op10_language_id"](spark, "/root/testdata/sf0.01").filter("held_out").join(docs, "doc_id").toPandas()
    assert len(found) > 100
    assert (found.lang == found.lang_pred).mean() > 0.97
    assert found.score.between(0, 1).all()


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    found = queries.queries()["op6_toxicity"](spark, sf).filter("held_out")
    found = found.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    assert (found.toxic == found.predicted).mean() > 0.93
    assert found.score.between(0, 1).all()
    toxic, clean = found[found.toxic == 1].score.to_numpy(), found[found.toxic == 0].score.to_numpy()
    assert (toxic[:, None] > clean[None, :]).mean() > 0.93


def test_nearest_recall(spark):
    sf = "/root/testdata/sf0.1"
    found = queries.queries()["op9_nearest"](spark, sf).toPandas()
    table = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas()
    rows, ids = np.array(table.embedding.tolist(), float), table.vec_id.to_numpy()
    hits = total = 0
    for query, group in found.groupby("query_id"):
        apart = np.sqrt(((rows - rows[ids == query][0]) ** 2).sum(axis=1))
        apart[ids == query] = np.inf
        best = np.lexsort((ids, apart))[:10]
        hits += len(set(ids[best]) & set(group.vec_id))
        total += 10
        group = group.sort_values("rank")
        assert group["rank"].tolist() == list(range(1, 11))
        assert np.allclose(group.score, [apart[ids == v][0] for v in group.vec_id], rtol=0, atol=1e-12)
    assert total and hits >= 0.9 * total
