"""Tables kept as a log of batches: a folder per batch, replaced as a whole, gathered into larger ones later.

``path/batch_id=n`` holds what batch n added. ``path_gathered/batch_id=n`` holds
all batches after the gathered ones before it, up to n. Readers take what is
gathered and the batches after it. Every write is one folder that a repeated run
replaces, and is finished once Spark has committed it; what is written per batch
does not grow with the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

BATCH = T.StructField("batch_id", T.LongType(), True)


def replace_batch(rows: DataFrame, path: str, batch_id: int, folders: list[str], options: dict[str, str] | None = None) -> None:
    """Write a batch's rows in the place of all that an earlier attempt wrote."""
    writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "static").options(**(options or {}))
    writer.partitionBy(*folders).parquet(f"{path}/batch_id={batch_id}")


def finished(spark: SparkSession, path: str, batch_id: int) -> bool:
    """Whether Spark has committed a batch's folder."""
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/batch_id={batch_id}", "_SUCCESS")
    return mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark)


def last_batch(spark: SparkSession, path: str) -> int:
    """The largest number among the finished batches below ``path``, or -1."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(folder):
        return -1
    names = [f.getPath().getName() for f in files.listStatus(folder) if files.exists(spark._jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS"))]
    return max((int(n.split("=")[1]) for n in names if n.startswith("batch_id=")), default=-1)


def _below(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """All batches below a path that may not be there yet."""
    return spark.read.schema(schema).parquet(path) if last_batch(spark, path) >= 0 else spark.createDataFrame([], schema)


def read_batches(spark: SparkSession, path: str, schema: T.StructType, before: int | None = None) -> DataFrame:
    """What is gathered and the batches after it; with ``before``, only batches before that one. ``schema`` ends with ``BATCH``."""
    done = last_batch(spark, f"{path}_gathered")
    if before is not None and done >= before:
        raise ValueError(f"batch {before} is gathered already and cannot be run again")
    fresh = _below(spark, path, schema).filter(F.col("batch_id") > done)
    fresh = fresh if before is None else fresh.filter(F.col("batch_id") < before)
    return fresh if done < 0 else _below(spark, f"{path}_gathered", schema).unionByName(fresh)


def ungathered(spark: SparkSession, path: str, schema: T.StructType, upto: int) -> DataFrame | None:
    """The batches up to ``upto`` that are not gathered yet; None if all are."""
    done = last_batch(spark, f"{path}_gathered")
    if done >= upto:
        return None
    return read_batches(spark, path, schema).filter((F.col("batch_id") > done) & (F.col("batch_id") <= upto))
