"""Jaccard join of documents on sets of word n-grams, by count vectors.

A set's hashed n-grams fall into groups; the counts per group are its point.
Two sets with similarity s or more differ in at most t n-grams, t following
from their sizes, and each n-gram they do not share changes one group. So of
more than t fine groups they agree in all but t. Each set lists the groups in
which it counts most, t + 1 of them (by falling count, then hash); two linked
sets have one listed group in common. These agreements deal sets to buckets.

Every member of a bucket is compared with the bucket's first. Buckets whose
members are not all connected by then get an R-tree over coarse count vectors,
in which each member looks for partners of other components. A pair counts as
candidate only while the sum of the smaller counts allows enough overlap, and
as link when the sets themselves, built from the whole texts, say so; sets
with a candidate in a block meet there once more with their hashes, the
likeliest pairs are verified first, and only links that connect something leave
the block. At first a set asks in one bucket, then what is still not connected
asks in all.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from clickloom.llm import exchange as X
from clickloom.llm.components import components
from clickloom.llm.count_rtree import CountTree
from clickloom.llm.sift import maybe_among
from clickloom.llm.textbytes import SPACED, buffers, mix, shingle_set
from clickloom.session import materialize

WORDS, NUM, DEN = 5, 4, 5
#: Coordinates of the count vectors under the trees: a power of two about as large as the set, within these.
LEAST_GROUPS, MOST_GROUPS = 64, 8192
#: Members of a bucket, or of a star around its first, that one task takes.
BLOCK = 1024
#: N-grams of the members of a block of a bucket, if these are long; a longer set is a block of its own or shares one.
BLOCK_GRAMS = 1 << 20
#: Bytes of counts or hashes that a group of blocks gets on average.
GROUP_BYTES = 8 << 20
#: Candidates of a set that are verified in one step, the likeliest first.
AT_ONCE = 32

U64 = np.uint64


def set_id(shingles: np.ndarray) -> int:
    """A 64-bit name of a set (signed, as Spark has it)."""
    if not len(shingles):
        return 0
    return int(mix(mix(shingles).sum(keepdims=True) + U64(len(shingles))).view(np.int64)[0])


def counts(shingles: np.ndarray, groups: int = LEAST_GROUPS) -> np.ndarray:
    """How many n-grams fall into each group; neighbouring groups add up to those of half as many."""
    return np.bincount((shingles >> U64(65 - groups.bit_length())).astype(np.int64), minlength=groups).astype(np.uint32)


def _point(shingles: np.ndarray) -> bytes:
    found = counts(shingles, min(max(1 << len(shingles).bit_length(), LEAST_GROUPS), MOST_GROUPS))
    kind = np.uint8 if found.max() < 256 else np.uint32
    return bytes([np.dtype(kind).itemsize]) + X.pack(found.astype(kind))


def _points(values: list[bytes]) -> np.ndarray:
    """Vectors of one length, that of the shortest."""
    found = [X.unpacked(v[1:], np.uint8 if v[0] == 1 else np.uint32) for v in values]
    groups = min(map(len, found))
    return np.stack([f.reshape(groups, -1).sum(axis=1, dtype=np.uint32) for f in found])


def _most_apart(total: int, num: int, den: int) -> int:
    """How many n-grams may be in one only of two sets with so many in all."""
    return (den - num) * total // (num + den)


def _sizes(size: int, num: int, den: int) -> list[tuple[int, int, int]]:
    """(scheme, fine groups, listed groups) for a set: its own power of two, and the next if a partner may be there."""
    out, own, most = [], size.bit_length() - 1, den * size // num
    for scheme in {own, most.bit_length() - 1}:
        top = (2 << scheme) - 1
        apart = _most_apart(2 * top, num, den)
        listed = _most_apart(size + min(most, top), num, den) + 1
        out.append((scheme, max(math.ceil(1.25 * (apart + 1)), listed), listed))
    return out


def listed_groups(shingles: np.ndarray, num: int, den: int) -> np.ndarray:
    """The set's listed groups, each as a hash of scheme, group, count and what is in it."""
    out = []
    content = mix(shingles ^ U64(0x5BF03635))
    for scheme, groups, listed in _sizes(len(shingles), num, den):
        group = ((shingles & U64(0xFFFFFFFF)) * U64(groups) >> U64(32)).astype(np.int64)
        by = np.argsort(group, kind="stable")
        at = np.searchsorted(group[by], np.arange(groups))
        full = np.diff(np.append(at, len(group)))
        total = np.zeros(groups, U64)
        some = np.flatnonzero(full)
        total[some] = np.add.reduceat(content[by], at[some])
        sign = mix(total + mix(np.arange(groups, dtype=U64) * U64(1 << 8) + U64(scheme)) + full.astype(U64))
        out.append(sign[np.lexsort((sign, -full))[:listed]])
    return mix(np.concatenate(out))  # of equal counts small hashes were listed; scrambled once more they spread evenly


def _sets(words: int):
    def read(batches):
        for batch in batches:
            for lo in range(0, len(batch), 512):
                part = batch.slice(lo, 512)
                data, offsets = buffers(part["text"])
                hashes, at = SPACED.hashes(data, offsets)
                found = [shingle_set(hashes[at[i] : at[i + 1]], words) for i in range(len(part))]
                yield pa.RecordBatch.from_arrays(
                    [part["doc_id"], part["text_id"], pa.array([len(s) for s in found], pa.int64()), pa.array([set_id(s) for s in found], pa.int64())],
                    names=["doc_id", "text_id", "n_shingles", "set_id"])

    return read


def _buckets(words: int, num: int, den: int, parts: int, chunk_bytes: int):
    def message(sets: dict[int, np.ndarray]) -> pa.RecordBatch:
        keys = np.concatenate([*sets.values(), np.zeros(0, U64)])
        names = np.repeat(np.array([*sets], np.int64), [len(k) for k in sets.values()])
        by = np.argsort(keys)
        keys, names = keys[by], names[by]
        pieces = X.split(keys, parts)
        return pa.RecordBatch.from_arrays(
            [pa.array([p for p, _ in pieces], pa.int32()), X.blobs([keys[s] for _, s in pieces]), X.blobs([names[s] for _, s in pieces])],
            names=["part", "keys", "sets"])

    def ask(batches):
        """Per part the listed groups of the distinct sets, after every few megabytes of text."""
        sets, held = {}, 0
        for batch in batches:
            for lo in range(0, len(batch), 512):
                part = batch.slice(lo, 512)
                data, offsets = buffers(part["text"])
                hashes, at = SPACED.hashes(data, offsets)
                for i in range(len(part)):
                    found = shingle_set(hashes[at[i] : at[i + 1]], words)
                    if len(found) and (name := set_id(found)) not in sets:
                        sets[name] = listed_groups(found, num, den)
                held += int(offsets[-1])
                if held >= chunk_bytes:
                    yield message(sets)
                    sets, held = {}, 0
        if sets:
            yield message(sets)

    return ask


def _stars(table: pa.Table) -> pa.Table:
    """(bucket, first, member) of all buckets with several sets; buckets with the same members are one.

    Buckets of two need no name, as comparing the two settles them.
    """
    keys = np.concatenate([X.unblob(v, U64) for v in table["keys"]])
    sets = np.concatenate([X.unblob(v, np.int64) for v in table["sets"]])
    by = np.lexsort((sets, keys))
    keys, sets = keys[by], sets[by]
    fresh = np.append(True, (keys[1:] != keys[:-1]) | (sets[1:] != sets[:-1]))[: len(keys)]
    keys, sets = keys[fresh], sets[fresh]
    heads = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
    sizes = np.diff(np.append(heads, len(keys)))
    heads, sizes = heads[sizes > 1], sizes[sizes > 1]
    member = np.repeat(heads, sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    hashed = mix(sets[member].view(U64))
    alike = mix(np.add.reduceat(hashed, np.cumsum(sizes) - sizes) + sizes.astype(U64)) if len(sizes) else np.zeros(0, U64)
    _, one = np.unique(alike, return_index=True)
    heads, sizes, alike = heads[one], sizes[one], alike[one].view(np.int64)
    alike = np.where(sizes > 2, alike, 0)
    rest = sizes - 1
    member = np.repeat(heads, rest) + 1 + np.arange(rest.sum()) - np.repeat(np.cumsum(rest) - rest, rest)
    return pa.table({
        "bucket": pa.array(np.repeat(alike, rest), pa.int64()), "first": pa.array(sets[np.repeat(heads, rest)], pa.int64()),
        "member": pa.array(sets[member], pa.int64()),
    })


def _verify(words: int, num: int, den: int):
    def check(pairs: pa.Table, firsts: pa.Table) -> pa.Table:
        """The pairs whose sets, built anew from the texts, are similar enough."""
        linked = ([], [])


        def sets(table, column, text):
            for lo in range(0, len(table), 256):
                part = table.slice(lo, 256)
                data, offsets = buffers(part[text])
                hashes, at = SPACED.hashes(data, offsets)
                for i, name in enumerate(part[column].to_pylist()):
                    yield lo + i, name, shingle_set(hashes[at[i] : at[i + 1]], words)
        known = {name: (found, counts(found)) for _, name, found in sets(firsts, "set_id", "first_text")}
        first = pairs["a"].to_pylist()
        for i, name, found in sets(pairs, "b", "text"):
            other, point = known[first[i]]
            need = -(-num * (len(found) + len(other)) // (num + den))
            if np.minimum(point, counts(found)).sum() < need:
                continue
            if len(np.intersect1d(found, other, assume_unique=True)) >= need:
                linked[0].append(first[i])
                linked[1].append(name)
        return pa.table({"a": pa.array(linked[0], pa.int64()), "b": pa.array(linked[1], pa.int64())})

    return check


def _vectors(words: int, whole: bool):
    """The count vector of each set; with ``whole``, its hashes too."""

    def read(batches):
        for batch in batches:
            for lo in range(0, len(batch), 512):
                part = batch.slice(lo, 512)
                data, offsets = buffers(part["text"])
                hashes, at = SPACED.hashes(data, offsets)
                found = [shingle_set(hashes[at[i] : at[i + 1]], words) for i in range(len(part))]
                columns, names = [part["set_id"], pa.array([_point(f) for f in found], pa.binary())], ["set_id", "point"]
                yield pa.RecordBatch.from_arrays([*columns, X.blobs(found)] if whole else columns, names=[*names, "shingles"] if whole else names)

    return read


PLACE = ["bucket", "i", "j", "role", "set_id"]


def _blocks(table: pa.Table, num: int, den: int):
    """The table by blocks; of each block with askers where it starts and a search: row -> candidates in the block, by the bound.

    Of two askers only the one with the larger name finds the other.
    """
    table = table.sort_by([(c, "ascending") for c in PLACE])
    block = np.stack([table[c].to_numpy() for c in ("bucket", "i", "j")], 1)
    edges = np.flatnonzero(np.append(True, (block[1:] != block[:-1]).any(axis=1)))
    role, names, sizes, asks = (table[c].to_numpy() for c in ("role", "set_id", "n_shingles", "asks"))
    point = table["point"].to_pylist()

    def each():
        for lo, hi in zip(edges.tolist(), [*edges[1:].tolist(), len(table)]):
            ask = lo + int(np.searchsorted(role[lo:hi], 1))
            if lo < ask < hi:
                points = _points(point[lo:hi])
                tree = CountTree(points[: ask - lo], sizes[lo:ask])

                def search(k: int, lo=lo, points=points, tree=tree) -> np.ndarray:
                    hit, bound = tree.search(points[k - lo], int(sizes[k]), num, den)
                    once = ~asks[lo + hit] | (names[lo + hit] < names[k])
                    hit, bound = hit[once], bound[once]
                    return hit[np.lexsort((names[lo + hit], -bound))]

                yield lo, ask, hi, search

    return table, each()


def _tree_near(num: int, den: int):
    def near(table: pa.Table) -> pa.Table:
        """The rows whose set has a candidate of another component in its block, or is one; blocks with the same rows get one name."""
        table, blocks = _blocks(table, num, den)
        comps, kept, names = table["component"].to_numpy(), np.zeros(len(table), bool), np.zeros(len(table), U64)
        row = mix(table["set_id"].to_numpy().view(U64) ^ mix(table["role"].to_numpy().astype(U64) * U64(2) + table["asks"].to_numpy().astype(U64)))
        for lo, ask, hi, search in blocks:
            for k in range(ask, hi):
                hit = search(k) + lo
                hit = hit[comps[hit] != comps[k]]
                kept[hit] = True
                kept[k] = len(hit) > 0
            own = row[lo:hi][kept[lo:hi]]
            names[lo:hi] = mix(own.sum(keepdims=True) + U64(len(own)))
        none = pa.array(np.zeros(len(table), np.int64))
        for c, value in (("bucket", pa.array(names.view(np.int64))), ("i", none), ("j", none)):
            table = table.set_column(table.schema.get_field_index(c), c, value)
        return table.filter(pa.array(kept)).select([*PLACE, "n_shingles", "component", "asks"])

    return near


def _tree_links(num: int, den: int):
    def search(table: pa.Table) -> pa.Table:
        """Links (a, b) that connect each block's askers with members of other components as far as any does: a forest."""
        table, blocks = _blocks(table, num, den)
        names, sizes, comps = (table[c].to_numpy() for c in ("set_id", "n_shingles", "component"))
        data, offsets = buffers(table["shingles"])
        flat, at = np.ascontiguousarray(data).view(U64), offsets // 8
        above: dict[int, int] = {}

        def top(c: int) -> int:
            while (up := above.get(c, c)) != c:
                above[c] = above.get(up, up)
                c = up
            return c

        linked = ([], [])
        for lo, ask, hi, search in blocks:
            root = np.array([top(c) for c in comps[lo:hi].tolist()])
            for k in range(ask, hi):
                hit = search(k)
                own = flat[at[k] : at[k + 1]]
                while len(hit := hit[root[hit] != root[k - lo]]):
                    some, hit = hit[:AT_ONCE], hit[AT_ONCE:]
                    theirs = [flat[at[lo + o] : at[lo + o + 1]] for o in some.tolist()]
                    both = np.concatenate(theirs)
                    same = own[np.minimum(np.searchsorted(own, both), len(own) - 1)] == both
                    shared = np.add.reduceat(same.astype(np.int64), np.cumsum([0, *map(len, theirs[:-1])]))
                    for o in some[(num + den) * shared >= num * (sizes[lo + some] + sizes[k])].tolist():
                        a, b = int(root[k - lo]), int(root[o])
                        if a != b:
                            above[max(a, b)] = min(a, b)
                            root[root == max(a, b)] = min(a, b)
                            linked[0].append(int(names[k]))
                            linked[1].append(int(names[lo + o]))
        return pa.table({"a": pa.array(linked[0], pa.int64()), "b": pa.array(linked[1], pa.int64())})

    return search


class _Join:
    def __init__(self, docs: DataFrame, words: int, num: int, den: int, chunk_bytes: int, part_bytes: int, block: int) -> None:
        self.words, self.num, self.den, self.block = words, num, den, block
        self.docs = docs.select("doc_id", "text", F.xxhash64("text").alias("text_id"))
        self.total, self.chunk_bytes = X.text_bytes(docs), chunk_bytes
        self.parts = X.counts(self.total, chunk_bytes, part_bytes)[1]
        sets = self.docs.mapInArrow(_sets(words), "doc_id bigint, text_id bigint, n_shingles bigint, set_id bigint")
        self.sets = materialize(sets, "sets")
        self.named = materialize(
            self.sets.filter("n_shingles > 0 and doc_id is not null").groupBy("set_id").agg(
                F.min(F.struct("doc_id", "text_id")).alias("rep"), F.first("n_shingles").alias("n_shingles"), F.count("*").alias("copies")), "named")

    def reps(self, names: DataFrame) -> DataFrame:
        """(set_id, doc_id, text_id) of the named sets: the document that stands for each."""
        return materialize(names.join(self.named, "set_id").select("set_id", "rep.*"), "reps")

    def found(self, reps: DataFrame) -> DataFrame:
        """(doc_id, text_id, text) of these documents, one row each, and of a few others; the rest of the documents is not moved."""
        key = F.xxhash64(F.col("doc_id").cast("bigint"), "text_id")
        return maybe_among(self.docs, key, reps, key, "_marked_maybe").filter("_marked_maybe").drop("_marked_maybe").dropDuplicates(["doc_id", "text_id"])

    def texts(self, names: DataFrame) -> DataFrame:
        """(set_id, text) of the named sets, one text each."""
        reps = self.reps(names)
        return self.found(reps).join(reps, ["doc_id", "text_id"]).select("set_id", "text")

    def links(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that are links, by their texts; a star around one set is split among tasks."""
        names = pairs.select(F.col("a").alias("set_id")).union(pairs.select(F.col("b").alias("set_id"))).distinct()
        reps = self.reps(names)
        found = self.found(reps)
        many = pairs.groupBy("a").agg(F.ceil(F.count("*") / self.block).alias("slots"))
        groups = max(8, math.ceil(2 * self.total / X.PART_BYTES))
        slotted = pairs.join(many, "a").withColumn("slot", F.pmod(F.xxhash64("b"), "slots"))
        slotted = slotted.withColumn("grp", F.pmod(F.xxhash64("a", "slot"), F.lit(groups))).select("grp", "a", "b")
        slotted = materialize(slotted, "slotted")  # read twice below
        left = slotted.join(reps.withColumnRenamed("set_id", "b"), "b")
        left = found.join(left, ["doc_id", "text_id"]).select("grp", "a", "b", "text")
        right = slotted.select("grp", "a").distinct().join(reps.withColumnRenamed("set_id", "a"), "a")
        right = found.join(right, ["doc_id", "text_id"]).select(F.col("grp").alias("first_grp"), F.col("a").alias("set_id"), F.col("text").alias("first_text"))
        return left.groupBy("grp").cogroup(right.groupBy("first_grp")).applyInArrow(
            _verify(self.words, self.num, self.den), "a bigint, b bigint")

    def labels(self, links: DataFrame, known: DataFrame | None = None) -> DataFrame:
        """(node, component) of all linked sets; with known ones, of these and the new links between their components."""
        links = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
        if known is None:
            return materialize(components(links), "labels")
        of = known.select("node", "component")
        joined = links.join(of.toDF("u", "cu"), "u", "left").join(of.toDF("v", "cv"), "v", "left")
        joined = joined.select("u", "v", F.coalesce("cu", "u").alias("cu"), F.coalesce("cv", "v").alias("cv"))
        joined = materialize(joined, "links")
        merged = components(joined.select(F.col("cu").alias("u"), F.col("cv").alias("v")))
        nodes = known.union(joined.select("u", "cu")).union(joined.select("v", "cv")).distinct()
        merged = merged.select(F.col("node").alias("component"), F.col("component").alias("least"))
        return materialize(nodes.join(merged, "component", "left").select("node", F.coalesce("least", "component").alias("component")), "labels")

    def rest(self, members: DataFrame, labels: DataFrame, once: bool) -> DataFrame:
        """Links (a, b) between sets that share a bucket and are not connected yet: as many as connect those that any do.

        All ask that are not in their bucket's largest component; with ``once``, each in the largest such bucket only.
        """
        known = labels.select(F.col("node").alias("set_id"), "component")
        member = members.join(known, "set_id", "left").withColumn("component", F.coalesce("component", "set_id"))
        member = materialize(member.join(self.named.select("set_id", "n_shingles"), "set_id"), "members")
        split = member.groupBy("bucket", "component").agg(F.count("*").alias("n"))
        split = split.groupBy("bucket").agg(F.sum("n").alias("n"), F.count("*").alias("parts"), F.max_by("component", F.struct("n", "component")).alias("main"))
        some = member.join(split.filter("parts > 1").drop("parts"), "bucket").withColumn("asks", F.col("component") != F.col("main")).drop("main")
        if once:
            own = some.filter("asks").groupBy("set_id").agg(F.max_by("bucket", F.struct("n", "bucket")).alias("own"))
            some = some.join(own, "set_id", "left").withColumn("asks", F.col("asks") & (F.col("own") == F.col("bucket"))).drop("own")
        some = materialize(some.drop("n"), "open")

        def blocks(rows: str):
            held = F.sum(F.when(F.expr(rows), F.col("n_shingles")))
            return F.ceil(F.greatest(F.count_if(F.expr(rows)) / self.block, held / BLOCK_GRAMS, F.lit(1)))

        bounds = some.groupBy("bucket").agg(
            blocks("true").alias("blocks"), blocks("asks").alias("ask_blocks"),
            F.sum("n_shingles").alias("all"), F.sum(F.when(F.col("asks"), F.col("n_shingles")).otherwise(0)).alias("asking")).filter("asking > 0")
        bounds = materialize(bounds, "bounds")
        moved = bounds.agg(F.sum(F.expr("all * ask_blocks + asking * blocks"))).first()[0] or 0
        some = some.join(bounds.select("bucket", "blocks", "ask_blocks"), "bucket")
        points = self.texts(some.select("set_id").distinct()).mapInArrow(_vectors(self.words, False), "set_id bigint, point binary")
        some = materialize(some.join(points, "set_id"), "points")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        dealt = lambda n: F.pmod(F.xxhash64("set_id"), n)
        inside = some.withColumn("i", dealt("blocks")).withColumn("j", every("ask_blocks")).withColumn("role", F.lit(0))
        asking = some.filter("asks").withColumn("j", dealt("ask_blocks")).withColumn("i", every("blocks")).withColumn("role", F.lit(1))
        columns = [*PLACE, "n_shingles", "component", "asks", "point"]
        both = inside.select(columns).union(asking.select(columns))
        grouped = lambda rows, moved: rows.groupBy(F.pmod(F.xxhash64("bucket", "i", "j"), F.lit(max(8, math.ceil(moved / GROUP_BYTES)))))
        near = grouped(both, 2 * moved).applyInArrow(_tree_near(self.num, self.den), "bucket bigint, i bigint, j bigint, role int, set_id bigint, n_shingles bigint, component bigint, asks boolean")
        near = materialize(near.distinct(), "near")  # two sets may meet in many buckets
        moved = 8 * (near.agg(F.sum("n_shingles")).first()[0] or 0)
        whole = self.texts(near.select("set_id").distinct()).mapInArrow(
            _vectors(self.words, True), "set_id bigint, point binary, shingles binary")
        return grouped(near.join(whole, "set_id"), moved).applyInArrow(_tree_links(self.num, self.den), "a bigint, b bigint")

    def run(self) -> DataFrame:
        known = self.docs.filter("doc_id is not null").select("text")  # the sets of ``named`` and no others
        asked = known.mapInArrow(_buckets(self.words, self.num, self.den, self.parts, self.chunk_bytes), "part int, keys binary, sets binary")
        stars = materialize(asked.groupBy("part").applyInArrow(_stars, "bucket bigint, first bigint, member bigint"), "stars")
        tried = materialize(stars.select(F.least("first", "member").alias("a"), F.greatest("first", "member").alias("b")).distinct(), "pairs")
        links = materialize(self.links(tried), "links")
        labels = self.labels(links)
        buckets = stars.filter("bucket <> 0")
        members = buckets.select("bucket", F.col("member").alias("set_id")).union(buckets.select("bucket", F.col("first").alias("set_id")))
        members = materialize(members.distinct(), "members")
        for once in (True, False):  # a set needs one link only to be connected; few are left to ask everywhere
            new = materialize(self.rest(members, labels, once), "links")
            if not new.isEmpty():
                links, labels = links.union(new), self.labels(new, labels)
        return self.describe(links, labels)

    def describe(self, links: DataFrame, labels: DataFrame) -> DataFrame:
        """Per document its component's smallest id and how many links between different sets were needed to find it."""
        degree = links.select(F.col("a").alias("set_id")).union(links.select(F.col("b").alias("set_id"))).groupBy("set_id").agg(F.count("*").alias("n_links"))
        known = self.named.join(labels.select(F.col("node").alias("set_id"), "component"), "set_id", "left")
        known = known.withColumn("component", F.coalesce("component", "set_id"))
        least = known.groupBy("component").agg(F.min("rep").alias("least"))
        known = known.join(least, "component").join(degree, "set_id", "left")
        known = known.select("set_id", F.col("least.doc_id").alias("component_id"), F.col("least.text_id").alias("least_text"), "n_links", "copies")
        out = self.sets.join(known, "set_id", "left")
        alone = F.col("n_shingles") == 0
        first = (F.col("doc_id") == F.col("component_id")) & (F.col("text_id") == F.col("least_text"))
        return out.select(
            "doc_id", "text_id", "n_shingles",
            F.when(F.col("doc_id").isNull(), None).when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
            F.coalesce("n_links", F.lit(0)).alias("n_links"), F.when(alone, 1).otherwise(F.coalesce("copies", F.lit(1))).alias("n_copies"),
            (alone | F.col("doc_id").isNull() | first).alias("first"),
        )


def near_duplicates(docs: DataFrame, words: int = WORDS, num: int = NUM, den: int = DEN, block: int = BLOCK,
                    chunk_bytes: int = X.CHUNK_BYTES, part_bytes: int = X.PART_BYTES) -> DataFrame:
    """The class of each document under links of Jaccard similarity num/den or more.

    Reads ``doc_id`` and ``text``; other columns play no part. A document's set
    holds its distinct runs of ``words`` words (blanks between, A-Z lowered),
    all words as one if there are fewer. Per row: doc_id, text_id (a hash of the text), n_shingles,
    component_id (the smallest doc_id reachable by links, its own included),
    n_links (links of its set that were verified on the way), n_copies
    (documents with the same set) and first (whether it is its class's document
    with the smallest doc_id, or text_id among those of that id). A null, empty or blank text has no set and
    is linked with nothing. A row without id gets no component and links
    nothing. Rows with one id are documents of their own, with equal classes
    if their texts are linked. An empty table gives none.

    Sets and n-grams are known by 64-bit hashes. Links left unverified are only
    such between sets already connected. A bucket is worked on in blocks of
    ``block`` members.
    """
    return _Join(docs, words, num, den, chunk_bytes, part_bytes, block).run()


def keep_first(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each class, one row of its first document.

    Rows are told apart by doc_id and text, so a row whose id another row has
    too goes only for its own text; of rows that are equal in both one stays.
    Rows without id, and with texts that have no word, all stay. ``options`` as for ``near_duplicates``.
    """
    rows = near_duplicates(docs, **options).groupBy("doc_id", "text_id").agg(
        F.every(F.col("first")).alias("_first"), (F.count("*") > 1).alias("_repeated"), F.max("n_shingles").alias("_n"))
    marked = rows.filter("doc_id is not null and _n > 0 and (not _first or _repeated)")
    marked = materialize(marked.select(F.col("doc_id").alias("_marked_id"), F.col("text_id").alias("_marked_text"), "_first"), "marked")
    rows_key, marked_key = F.xxhash64(F.col("doc_id").cast("bigint"), F.xxhash64("text")), F.xxhash64("_marked_id", "_marked_text")
    found = maybe_among(docs, rows_key, marked, marked_key, "_marked_maybe")  # the others stay without being moved
    same = (F.col("doc_id") == F.col("_marked_id")) & (F.xxhash64("text") == F.col("_marked_text"))
    some = found.filter("_marked_maybe")
    repeated = some.join(marked.filter("_first").drop("_first"), same).dropDuplicates(["_marked_id", "_marked_text"])
    kept = found.filter("not _marked_maybe").union(some.join(marked.drop("_first"), same, "left_anti"))
    return kept.select(docs.columns).union(repeated.select(docs.columns))
