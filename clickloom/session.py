"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# Adaptive execution does the run-time work: it coalesces small shuffle
# partitions, splits skewed join partitions and turns a join into a broadcast
# join when the measured side is small enough.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    # Building wide expressions is several times faster without call-site capture.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}

# Settings the jobs rely on for speed or exactness, changeable at run time.
RUNTIME = {
    # The JVM never compiles a method over 8,000 bytes; wide expressions run
    # faster split into small methods than in one interpreted stage.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # A JSON object with a repeated key keeps the last value.
    "spark.sql.variant.allowDuplicateKeys": "true",
}


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors, once per application."""
    context = spark.sparkContext
    if getattr(context, "_clickloom_shipped", False):
        return spark
    package = Path(__file__).resolve().parent
    archive = os.path.join(tempfile.mkdtemp(prefix="clickloom-"), "clickloom.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(package.rglob("*.py")):
            out.write(path, path.relative_to(package.parent).as_posix())
    context.addPyFile(archive)
    context._clickloom_shipped = True
    return spark


def tune(spark: SparkSession) -> SparkSession:
    """Apply the run-time settings to an existing session, and send it the package."""
    for key, value in RUNTIME.items():
        spark.conf.set(key, value)
    return ship(spark)


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app: str = "clickloom", extra: dict[str, str] | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {**DEFAULTS, **RUNTIME}
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    settings.update(extra or {})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return ship(builder.getOrCreate())


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """The session with other settings for a while."""
    before = {key: spark.conf.get(key, None) for key in values}
    try:
        for key, value in values.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, from ``spark.checkpoint.dir``.

    A machine-local folder is used only when Spark itself runs on one machine
    and nothing is configured.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    return os.path.join(tempfile.gettempdir(), "clickloom-shared")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage: later passes all see the same rows, and a lost executor
    costs a re-read, not a recomputation.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
