"""Nearest neighbours by cross-polytope hashing.

A pseudo-rotation (three rounds of random signs and a Hadamard transform) sends
a unit vector near a signed axis, which is its bucket in one table. Several
tables have rotations of their own. A query looks into the buckets of its
nearest few signed axes per table; all rows found are ranked exactly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from clickloom.llm.textbytes import _stream
from clickloom.session import materialize

TABLES, PROBES = 12, 12
NEIGHBOURS = 10
#: Rows of a bucket ranked at once, and queries put to them at once.
ROWS, ASKERS = 4096, 256


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of each row; their length is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(n, d)
        h *= 2
    return x


def rotate(units: np.ndarray, table: int) -> np.ndarray:
    """Unit vectors, filled up to a power of two, under the table's pseudo-rotation."""
    n, dims = units.shape
    full = max(2, 1 << (dims - 1).bit_length())
    x = np.zeros((n, full), np.float64)
    x[:, :dims] = units
    for turn in range(3):
        signs = np.where(_stream(1000 * table + turn + 7, full) >> np.uint64(63) == 0, 1.0, -1.0)
        x = hadamard(x * signs)
    return x


def axes(units: np.ndarray, table: int, probes: int) -> np.ndarray:
    """The nearest signed axes of each vector, nearest first; axis a and its opposite are 2a and 2a + 1."""
    turned = rotate(units, table)
    both = np.stack([turned, -turned], axis=2).reshape(len(turned), -1)
    return np.argsort(-both, axis=1, kind="stable")[:, :probes]


def _unit(batch: pa.RecordBatch) -> np.ndarray:
    rows = np.array(batch["embedding"].to_pylist(), np.float64).reshape(len(batch), -1)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _buckets(tables: int, probes: int):
    """(bucket, vec_id, embedding) of each vector in each table."""
    def deal(batches):
        for batch in batches:
            for lo in range(0, len(batch), 1024):
                part = batch.slice(lo, 1024)
                dims = part["dims"].to_numpy()
                for d in np.unique(dims):
                    some = part.filter(pa.array(dims == d))
                    units = _unit(some)
                    for table in range(tables):
                        found = axes(units, table, probes)
                        bucket = ((int(d) * tables + table) * (4 * int(d) + 8) + found).reshape(-1)
                        rows = some.take(pa.array(np.repeat(np.arange(len(some)), found.shape[1])))
                        yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int64()), rows["vec_id"], rows["embedding"]], names=["bucket", "vec_id", "embedding"])

    return deal


def nearest(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int):
    """For each query (its place, the vec_id and the distance of) the k nearest rows but itself, exactly; ties to smaller ids."""
    out = []
    for lo in range(0, len(queries), ASKERS):
        asked = queries[lo : lo + ASKERS]
        best: list[list[tuple[float, int]]] = [[] for _ in range(len(asked))]
        for at in range(0, len(rows), ROWS):
            part, part_ids = rows[at : at + ROWS], ids[at : at + ROWS]
            rough = (asked * asked).sum(axis=1)[:, None] + (part * part).sum(axis=1)[None, :] - 2 * asked @ part.T
            rough[query_ids[lo : lo + ASKERS][:, None] == part_ids[None, :]] = np.inf
            kth = np.partition(rough, min(k, rough.shape[1]) - 1, axis=1)[:, min(k, rough.shape[1]) - 1]
            slack = 1e-9 * (1 + np.abs(kth))  # what rounding may have moved
            for i in range(len(asked)):
                near = np.flatnonzero((rough[i] <= kth[i] + slack[i]) & np.isfinite(rough[i]))
                score = np.sqrt(((part[near] - asked[i]) ** 2).sum(axis=1))
                best[i] = sorted(best[i] + list(zip(score.tolist(), part_ids[near].tolist())))[:k]
        out += [(lo + i, vec, score) for i, found in enumerate(best) for score, vec in found]
    return out


def _rank(k: int):
    def rank(rows: pa.Table, asked: pa.Table) -> pa.Table:
        found = []
        if len(rows) and len(asked):
            r = pc.list_flatten(rows["embedding"]).to_numpy().reshape(len(rows), -1)
            q = pc.list_flatten(asked["embedding"]).to_numpy().reshape(len(asked), -1)
            names = asked["vec_id"].to_numpy()
            found = [(int(names[i]), vec, score) for i, vec, score in nearest(q, names, r, rows["vec_id"].to_numpy(), k)]
        a, b, c = zip(*found) if found else ((), (), ())
        return pa.table({"query_id": pa.array(a, pa.int64()), "vec_id": pa.array(b, pa.int64()), "score": pa.array(c, pa.float64())})

    return rank


def search(vectors: DataFrame, queries: DataFrame, neighbours: int = NEIGHBOURS, tables: int = TABLES, probes: int = PROBES,
           block_rows: int = 50_000) -> DataFrame:
    """The nearest rows of ``vectors`` to each row of ``queries`` by Euclidean distance, its own row excepted.

    Reads ``vec_id`` and ``embedding`` of both; other columns play no part.
    Returns query_id, rank (from 1), vec_id and score (the distance in double
    precision). Ties go to the smaller vec_id. Rows without id, and vectors that
    are null, empty, zero or hold a null or non-finite component, take no part,
    and vectors are only compared with those of their length. Rows that repeat
    an id count once per distinct vector. Of equal vectors those with the
    smallest ids, one more than asked for, are indexed, as the others cannot be
    among the nearest. A task compares about ``block_rows`` rows of a bucket; a
    bucket of more is dealt out. A query that finds fewer rows in its buckets
    than asked for is compared with all rows. Empty tables give none.
    """
    def usable(df: DataFrame) -> DataFrame:
        e = F.col("embedding").cast("array<double>")
        fine = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0)
        return df.select("vec_id", e.alias("embedding"), F.size(e).alias("dims")).filter("vec_id is not null").filter(F.coalesce(fine, F.lit(False)))

    rows = usable(vectors).dropDuplicates(["vec_id", "embedding"])
    first = F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))
    rows = rows.withColumn("copy", first).filter(F.col("copy") <= neighbours + 1).drop("copy")
    asked = usable(queries).dropDuplicates(["vec_id", "embedding"])
    schema = "bucket bigint, vec_id bigint, embedding array<double>"
    index = rows.mapInArrow(_buckets(tables, 1), schema)
    probing = asked.mapInArrow(_buckets(tables, probes), schema)
    # A bucket of many rows is dealt out in blocks, each of which all its queries are put to. There are few buckets in all, a multiple of the dimensions.
    full = index.groupBy("bucket").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("blocks")).filter("blocks > 1")
    full = F.broadcast(materialize(full, "full"))
    index = index.join(full, "bucket", "left").withColumn("block", F.pmod(F.xxhash64("vec_id", "embedding"), F.coalesce("blocks", F.lit(1))).cast("int"))
    probing = probing.join(full, "bucket", "left").withColumn("block", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)))
    columns = ["bucket", "block", "vec_id", "embedding"]
    both = index.select(columns).groupBy("bucket", "block").cogroup(probing.select(columns).groupBy("bucket", "block"))
    found = both.applyInArrow(_rank(neighbours), "query_id bigint, vec_id bigint, score double")
    found = materialize(found.distinct(), "found")
    enough = found.groupBy(F.col("query_id").alias("vec_id")).agg(F.count("*").alias("n")).filter(F.col("n") >= neighbours)
    few = materialize(asked.join(enough, "vec_id", "left_anti"), "few")
    blocks = max(1, -(-rows.count() // block_rows))
    every = rows.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
    few = few.select(F.col("vec_id"), "embedding", "dims", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    rest = every.groupBy("block", "dims").cogroup(few.groupBy("block", "dims")).applyInArrow(_rank(neighbours), "query_id bigint, vec_id bigint, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    best = found.union(rest).distinct().withColumn("rank", F.row_number().over(order))
    return best.filter(F.col("rank") <= neighbours).select("query_id", "rank", "vec_id", "score")
