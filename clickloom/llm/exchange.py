"""Keyed questions in bulk: chunks of documents ask about hashes, parts of the hash space answer.

A chunk is the set of documents with one hash of their id, a few megabytes of
text. It sends each part one row with all its distinct hashes as bytes, so a
hash that a third of all documents hold reaches a part once per chunk and not
once per document, and Spark moves few rows. The part gathers what all chunks
sent and answers each in the order of its question.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

CHUNK_BYTES = 4 << 20
PART_BYTES = 10 << 20


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    return docs.select(F.sum(F.octet_length(column)).alias("n")).first()["n"] or 0


def counts(total: int, chunk_bytes: int = CHUNK_BYTES, part_bytes: int = PART_BYTES) -> tuple[int, int]:
    """How many chunks and parts so many bytes of text get."""
    return max(1, math.ceil(total / chunk_bytes)), max(1, math.ceil(total / part_bytes))


def chunk_of(n: int) -> Column:
    """The chunk of a document. Reruns agree: it follows from the id alone."""
    return F.pmod(F.xxhash64("doc_id"), F.lit(n)).cast("int")


def chunked(docs: DataFrame, n: int) -> DataFrame:
    return docs.select("doc_id", "text", chunk_of(n).alias("chunk"))


def ordered(table: pa.Table) -> pa.Table:
    """A chunk's rows in an order that does not depend on how they arrived."""
    return table.take(pc.sort_indices(table, [("doc_id", "ascending"), ("text", "ascending")])) if len(table) > 1 else table


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """The part of each hash; grows with the hash, so sorted hashes keep their order."""
    return ((keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def split(keys: np.ndarray, parts: int) -> list[tuple[int, slice]]:
    """The parts that sorted hashes fall into, with the slice of each."""
    if not len(keys):
        return []
    at = part_of(keys, parts)
    edges = np.flatnonzero(np.diff(at)) + 1
    starts = np.concatenate([[0], edges])
    return [(int(at[a]), slice(int(a), int(b))) for a, b in zip(starts, np.append(edges, len(keys)))]


def pack(data: bytes | np.ndarray) -> bytes:
    """Compressed, with the size before it."""
    data = data if isinstance(data, bytes) else np.ascontiguousarray(data).tobytes()
    return len(data).to_bytes(8, "little") + pa.compress(data, "zstd", asbytes=True)


def unpack(value: pa.Scalar, kind=np.uint8) -> np.ndarray:
    return unpacked(value.as_py(), kind)


def unpacked(raw: bytes, kind=np.uint8) -> np.ndarray:
    return np.frombuffer(pa.decompress(raw[8:], int.from_bytes(raw[:8], "little"), "zstd"), kind)


def blobs(arrays: list[np.ndarray]) -> pa.Array:
    return pa.array([a.tobytes() for a in arrays], pa.binary())


def unblob(value: pa.Scalar, kind) -> np.ndarray:
    return np.frombuffer(value.as_py(), kind)


def pack_sorted(keys: np.ndarray) -> bytes:
    """Rising hashes by their differences, byte by byte."""
    return pack(np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T)


def unpack_sorted(value: pa.Scalar) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(unpack(value).reshape(8, -1).T).view(np.uint64).reshape(-1), dtype=np.uint64)
