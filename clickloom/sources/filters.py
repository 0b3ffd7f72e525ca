"""A stored Bloom filter that follows the registry batch by batch and grows by layers.

Each batch writes the bits it adds as a folder of its own, which a repeated run
replaces, and how full the newest layer is then; so a replay changes nothing and
no token is ever lost. A layer that a batch would overfill gets a successor for
twice as many tokens and half the rate of false positives, so the rates of all
layers together stay below the one asked for, however many tokens come. A probe
asks every layer; their number grows with the logarithm of the tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from clickloom.operators import bloom
from clickloom.sources.batches import BATCH, last_batch, read_batches, replace_batch, ungathered

STORED = T.StructType([
    T.StructField("layer", T.IntegerType()), T.StructField("bucket", T.LongType()), T.StructField("bits", T.BinaryType()),
    T.StructField("size", T.LongType()), T.StructField("salts", T.StringType()), BATCH,
])
STATE = "layer int, tokens bigint"


def layer_bits(layer: int, capacity: int, rate: float) -> int:
    return bloom.bits_for(capacity << layer, rate / 2 ** (layer + 1))


def _merged(rows: DataFrame) -> DataFrame:
    return rows.groupBy("layer", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"), F.min("size").alias("size"), F.min("salts").alias("salts"))


def read_filter(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """The bits of all layers; with ``before``, as they were before that batch."""
    return _merged(read_batches(spark, path, STORED, before))


def probe_layers(tokens: DataFrame, stored: DataFrame, token_col: str = "short_token") -> DataFrame:
    """Add ``maybe``: False means the token was certainly never added. NULL tokens never were."""
    layers = stored.agg(F.sort_array(F.collect_set("layer"))).first()[0]  # log-many
    found, names = tokens, [f"_maybe_{layer}" for layer in layers]
    for layer, name in zip(layers, names):
        found = bloom.probe(found, stored.filter(F.col("layer") == layer).drop("layer"), token_col).withColumnRenamed("maybe", name)
    maybe = F.lit(False)
    for name in names:
        maybe = maybe | F.coalesce(name, F.lit(False))
    return found.withColumn("maybe", maybe).select(*tokens.columns, "maybe")


def add_tokens(spark: SparkSession, path: str, batch_id: int, tokens: DataFrame, capacity: int, rate: float = 0.01) -> None:
    """Add a batch's ``short_token`` values; ``capacity`` tokens are planned for the first layer.

    Batches are numbered from 0 and run one after the other; a batch can be run
    again until the next one has been. Tokens that the filter already answers for are not added.
    """
    layer, held = 0, 0
    if batch_id:
        if last_batch(spark, f"{path}_state") < batch_id - 1:
            raise ValueError(f"batch {batch_id - 1} is not finished")
        layer, held = spark.read.schema(STATE).parquet(f"{path}_state/batch_id={batch_id - 1}").first()
    known = read_filter(spark, path, batch_id)
    fresh = probe_layers(tokens.filter("short_token IS NOT NULL").select("short_token").distinct(), known).filter("NOT maybe")
    many = fresh.count()
    while held + many > capacity << layer and (held or many > capacity << layer):
        layer, held = layer + 1, 0
    bits = bloom.build(fresh, layer_bits(layer, capacity, rate)).select(F.lit(layer).alias("layer"), "bucket", "bits", "size", "salts")
    replace_batch(bits, path, batch_id, [])
    replace_batch(spark.createDataFrame([(layer, held + many)], STATE), f"{path}_state", batch_id, [])


def compact_filter(spark: SparkSession, path: str, upto: int) -> None:
    """OR the batches up to ``upto``, which must not be run again, into one folder."""
    fresh = ungathered(spark, path, STORED, upto)
    if fresh is not None:
        replace_batch(_merged(fresh), f"{path}_gathered", upto, [])
