"""A stored click table whose links can be removed: files are copied on write, and a manifest names the live ones.

``path/generation=n`` holds what change n wrote, by month and sorted by token;
``path/_manifest/batch_id=n`` lists the files that make up the table after it.
A reader takes the newest finished manifest, so a change is seen as a whole or
not at all, and a change that died is replaced when it is run again. Files that
a purge does not touch keep their names; the files before it stay until they
are removed by hand, as readers may still use them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from clickloom.operators.clicks import cascade_purge
from clickloom.schemas import CLICKS
from clickloom.session import materialize
from clickloom.sources.batches import last_batch, replace_batch
from clickloom.sources.tables import PARTITIONS, with_month

STORED = T.StructType([*CLICKS.fields, *(T.StructField(c, T.IntegerType()) for c in PARTITIONS), T.StructField("generation", T.LongType())])
MANIFEST = "file string"
_FILE = "_metadata.file_path as file"


def _write(clicks: DataFrame, path: str, generation: int) -> DataFrame:
    """Write the rows of one generation, and list its files."""
    rows = with_month(clicks.select(*CLICKS.fieldNames())).hint("rebalance", *PARTITIONS).sortWithinPartitions(*PARTITIONS, "short_token", "clicked_at")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(*PARTITIONS).parquet(f"{path}/generation={generation}")
    return clicks.sparkSession.read.schema(STORED).parquet(f"{path}/generation={generation}").selectExpr(_FILE).distinct()


def live_files(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    version = last_batch(spark, f"{path}/_manifest") if version is None else version
    return spark.read.schema(MANIFEST).parquet(f"{path}/_manifest/batch_id={version}")


def create(clicks: DataFrame, path: str) -> None:
    replace_batch(_write(clicks, path, 0), f"{path}/_manifest", 0, [])


def read_version(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The clicks, with year, month and generation; by default the newest version. The driver holds the file names, as for each scan."""
    # A file's name in the metadata is escaped as in a URI.
    name = F.try_url_decode(F.replace("file", F.lit("+"), F.lit("%2B")))
    names = live_files(spark, path, version).agg(F.collect_list(name)).first()[0]
    if not names:
        return spark.createDataFrame([], STORED)
    return spark.read.schema(STORED).option("basePath", path).parquet(*names)


def purge(spark: SparkSession, path: str, version: int, removed: DataFrame) -> None:
    """Make ``version`` of the table: without the clicks of the links in ``removed`` (``short_token``).

    Tokens alone are read to find the files that hold such clicks; only these are
    read whole and written anew. Versions follow each other by one; the newest
    can be made again. NULL tokens remove nothing.
    """
    if last_batch(spark, f"{path}/_manifest") not in (version - 1, version) or version < 1:
        raise ValueError(f"version {version} does not follow the newest one")
    listed = live_files(spark, path, version - 1)
    if listed.isEmpty():
        return replace_batch(listed, f"{path}/_manifest", version, [])
    before = read_version(spark, path, version - 1)
    gone = removed.select("short_token").filter("short_token is not null").distinct()
    hit = materialize(before.selectExpr("short_token", _FILE).join(gone, "short_token", "left_semi").select("file").distinct(), "hit")
    touched = before.selectExpr(*CLICKS.fieldNames(), _FILE).join(hit, "file", "left_semi")
    written = _write(cascade_purge(touched, gone), path, version)
    live = listed.join(hit, "file", "left_anti").union(written)
    replace_batch(live, f"{path}/_manifest", version, [])
