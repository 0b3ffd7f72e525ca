"""Mixing sources to target weights by entropy balancing, with DataFrame functions only.

Each document gets a rate, the number of times the mix takes it, 0 to 2. Among
all rates that meet the sources' token targets, those are wanted that are
nearest to 1 in (two-sided) entropy. Their dual has one number per source: a
document of size s, in units of its source's mean, has the rate 2 / (1 +
exp(-number * s)), an exponential tilt of its odds. Newton iterations over the
counts of sizes per source find the numbers. Rates are then rounded into whole
copies, so that each source meets its target as nearly as its sizes allow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from clickloom.session import materialize

WEIGHTS = (3, 1, 2)
SHARE, MOST = 1.5, 2
#: Newton iterations, and the relative error of a source's words at which they end.
ROUNDS, EXACT = 60, 1e-9
#: Parts that the documents of one source and size are ranked in.
SLICES = 64

WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, words, target) of each source, from (source, words); weights repeat in the order of sources.

    A target is weight times one level for all sources, but at most ``most``
    times the source's words; the level is such that targets share ``share``
    times all words. Sources are few beside documents, so that one task orders
    them; nothing but these sums gets there.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    place = F.row_number().over(order) - 1
    ranked = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int")))
    # Sources reach their limit in the order of limit by weight; the level is set by those that do not.
    by_limit = Window.orderBy(F.col("words") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    full_before = F.coalesce(F.sum("words").over(by_limit.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    open_weight = F.sum("weight").over(by_limit.rowsBetween(0, Window.unboundedFollowing))
    level = (F.lit(share) * F.sum("words").over(everything) - most * full_before) / open_weight
    found = ranked.withColumn("level", level).withColumn("open", F.col("weight") * F.col("level") <= most * F.col("words"))
    found = found.withColumn("first", F.min(F.when(F.col("open"), F.struct(F.col("words") / F.col("weight"), "level"))).over(everything)["level"])
    limit = (most * F.col("words")).cast("double")
    return found.select("source", "words", F.least(limit, F.coalesce(F.col("weight") * F.col("first"), limit)).alias("target"))


def _rate(number: Column, size: Column, mean: Column) -> Column:
    return F.lit(float(MOST)) / (1 + F.exp(-F.greatest(F.lit(-700.0), F.least(F.lit(700.0), number * size / mean))))


def _exact(x: Column) -> Column:
    """A sum of these does not depend on its order."""
    return F.round(x, 6).cast("decimal(38,6)")


def _rates(counted: DataFrame, sources: DataFrame) -> DataFrame:
    """(source, number) solving the dual; each round halves the bracket where a Newton step would leave it."""
    table = materialize(counted.filter("size > 0").join(sources.withColumnRenamed("source", "name"), F.col("source").eqNullSafe(F.col("name"))).select(
        "source", "size", "n", "target", (F.col("words") / F.col("docs")).alias("mean"), "words"), "sizes")
    state = sources.filter("words > 0").select(
        "source", F.lit(0.0).alias("number"), F.lit(-1e6).alias("low"), F.lit(1e6).alias("high"), (F.col("target") >= MOST * F.col("words")).alias("done"))
    state = materialize(state, "state")
    for _ in range(ROUNDS):
        now = state.withColumnRenamed("source", "name")
        joined = table.join(now.filter("not done"), F.col("source").eqNullSafe(F.col("name")))
        rate = _rate(F.col("number"), F.col("size"), F.col("mean"))
        slope = rate * (1 - rate / MOST) * F.col("size") / F.col("mean")
        mass = F.col("size") * F.col("n")
        step = joined.groupBy("source").agg(
            F.first("target").alias("target"), F.sum(_exact(rate * mass)).cast("double").alias("got"), F.sum(_exact(slope * mass)).cast("double").alias("slope"))
        step = now.join(step, F.col("source").eqNullSafe(F.col("name")), "left")
        over = F.col("got") > F.col("target")
        low, high = F.when(over, F.col("low")).otherwise(F.col("number")), F.when(over, F.col("number")).otherwise(F.col("high"))
        newton = F.col("number") - (F.col("got") - F.col("target")) / F.greatest(F.col("slope"), F.lit(1e-300))
        inside = (newton > low) & (newton < high)
        near = F.abs(F.col("got") - F.col("target")) <= EXACT * F.col("target")
        move = ~F.col("done") & ~near
        state = materialize(step.select(
            F.col("name").alias("source"),
            F.when(move, F.when(inside, newton).otherwise((low + high) / 2)).otherwise(F.col("number")).alias("number"),
            F.when(move, low).otherwise(F.col("low")).alias("low"), F.when(move, high).otherwise(F.col("high")).alias("high"),
            (F.col("done") | near).alias("done")), "state")
        if state.filter("not done").isEmpty():
            break
    return state.select("source", "number")


def _copies(counted: DataFrame, sources: DataFrame, numbers: DataFrame) -> DataFrame:
    """(source, size, copies): how often the documents of one source and size are taken, all together.

    Counts are rounded along falling sizes, carrying the remainder on, so that
    a source misses its words by half its largest document at most. What it
    then misses is made up by single copies, largest sizes first. One task
    holds a source's distinct sizes, not its documents.
    """
    s = sources.select(F.col("source").alias("name"), "words", "docs", "target")
    t = numbers.select(F.col("source").alias("of"), "number")
    base = counted.filter("size > 0").join(s, F.col("source").eqNullSafe(F.col("name"))).join(t, F.col("source").eqNullSafe(F.col("of")))
    full = F.col("target") >= MOST * F.col("words")
    rate = F.when(full, F.lit(float(MOST))).otherwise(_rate(F.col("number"), F.col("size"), F.col("words") / F.col("docs")))
    along = Window.partitionBy("source").orderBy(F.col("size").desc())
    total = F.sum(_exact(rate * F.col("n"))).over(along.rowsBetween(Window.unboundedPreceding, 0))
    upto = F.floor(total + F.lit(0.5)).cast("bigint")
    rounded = base.withColumn("upto", upto)
    copies = F.greatest(F.lit(0), F.least(F.col("upto") - F.coalesce(F.lag("upto").over(along), F.lit(0)), MOST * F.col("n")))
    rounded = rounded.withColumn("copies", copies)
    gap = (F.round(F.first("target")) - F.sum(F.col("copies") * F.col("size"))).cast("bigint").alias("gap")
    room = F.sort_array(F.collect_list(F.struct("size", "n", "copies")), asc=False)

    def fill(state: Column, x: Column) -> Column:
        # More copies of this size while some words are missing, or fewer while there are too many.
        more = F.least(F.floor(state["gap"] / x["size"]), MOST * x["n"] - x["copies"])
        less = F.least(F.floor(-state["gap"] / x["size"]), x["copies"])
        change = F.when(state["gap"] > 0, more).otherwise(-less).cast("bigint")
        return F.struct((state["gap"] - change * x["size"]).alias("gap"),
                        F.when(change != 0, F.concat(state["changes"], F.array(F.struct(x["size"].alias("size"), change.alias("change"))))).otherwise(state["changes"]).alias("changes"))

    start = F.struct(F.col("gap").alias("gap"), F.expr("cast(array() as array<struct<size: bigint, change: bigint>>)").alias("changes"))
    changes = rounded.groupBy("source").agg(gap, room.alias("room")).select(F.col("source").alias("in"), F.explode(F.aggregate("room", start, fill)["changes"]).alias("c"))
    changes = changes.select("in", F.col("c.size").alias("of_size"), F.col("c.change").alias("change"))
    out = rounded.select("source", "size", "n", "copies").join(changes, F.col("source").eqNullSafe(F.col("in")) & (F.col("size") == F.col("of_size")), "left")
    return out.select("source", "size", "n", (F.col("copies") + F.coalesce("change", F.lit(0))).alias("copies"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE) -> DataFrame:
    """How much of each document the mix takes.

    Reads ``doc_id``, ``text`` and ``source``; other columns play no part. A
    document's size is its words between blanks, 0 for a null text. Sources, by
    code point and a null one last, weigh ``weights`` in turn and share
    ``share`` times all words; none gets more than twice its own, and what is
    over is shared by the others by weight. Each row gives one: doc_id, size,
    source_size, target, copies (0, 1 or 2) and taken (words, copies times
    size). Reruns agree: sums do not depend on order, and which documents of
    one source and size get a copy more follows from a hash of id and text.
    Rows that repeat an id are documents of their own; between rows equal in id
    and text it does not matter which is taken. A document of no words has one
    copy and takes none. An empty table gives none.
    """
    own = docs.select("doc_id", "source", words(F.col("text")).alias("size"), F.xxhash64("doc_id", "text").alias("hash"))
    own = materialize(own, "own")
    counted = materialize(own.groupBy("source", "size").agg(F.count("*").alias("n")), "counted")
    sums = counted.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("words"), F.sum(F.when(F.col("size") > 0, F.col("n")).otherwise(0)).alias("docs"))
    wanted = targets(sums.select("source", "words"), weights, share)
    sources = sums.select(F.col("source").alias("key"), "docs").join(wanted, F.col("key").eqNullSafe(F.col("source"))).drop("key")
    sources = materialize(sources, "sources")
    copies = materialize(_copies(counted, sources, _rates(counted, sources)), "copies")
    # The rank of a document among those of its source and size, counted in slices of the hash.
    key = ["source", "size", "slice"]
    sliced = own.withColumn("slice", F.pmod("hash", F.lit(SLICES)))
    ahead = Window.partitionBy("source", "size").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    before = sliced.groupBy(*key).agg(F.count("*").alias("m")).withColumn("before", F.coalesce(F.sum("m").over(ahead), F.lit(0)))
    info = copies.select(F.col("source").alias("s1"), F.col("size").alias("z1"), "n", "copies")
    before = before.join(info, F.col("source").eqNullSafe(F.col("s1")) & (F.col("size") == F.col("z1")), "left").select(
        F.col("source").alias("s2"), F.col("size").alias("z2"), F.col("slice").alias("l2"), "before", "n", "copies")
    within = F.row_number().over(Window.partitionBy(*key).orderBy("hash"))
    ranked = sliced.withColumn("within", within).join(
        before, F.col("source").eqNullSafe(F.col("s2")) & (F.col("size") == F.col("z2")) & (F.col("slice") == F.col("l2")))
    rank = F.col("before") + F.col("within")
    each = F.floor(F.col("copies") / F.col("n"))
    taken = F.when(F.col("size") == 0, 1).otherwise(each + F.when(rank <= F.col("copies") - each * F.col("n"), 1).otherwise(0)).cast("int")
    told = sources.select(F.col("source").alias("s3"), F.col("words").alias("source_size"), "target")
    return ranked.withColumn("copies", taken).join(told, F.col("source").eqNullSafe(F.col("s3"))).select(
        "doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
