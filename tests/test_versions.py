"""Removal of links from a stored click table."""

import pytest
from pyspark.sql import functions as F

from clickloom.operators import clicks as C
from clickloom.session import scratch_path
from clickloom.sources import testdata as D, versions

SF = "/root/testdata/sf0.001"


def names(spark, path, version):
    return {r.file for r in versions.live_files(spark, path, version).collect()}


def rows(df):
    return sorted(map(str, df.drop("id", "generation", "year", "month").collect()))


def test_purge_rewrites_only_files_with_purged_tokens(spark):
    clicks, path = D.clicks_over_months(spark, SF), scratch_path(spark, "my clicks+")
    clicks = clicks.withColumn("short_token", F.concat("short_token", F.lit("-"), F.month("clicked_at")))
    versions.create(clicks, path)
    first = names(spark, path, 0)
    only = clicks.filter(F.month("clicked_at") == 1).select("short_token").distinct().orderBy("short_token").limit(3)
    versions.purge(spark, path, 1, only)
    second = names(spark, path, 1)
    assert len(first) > 1 and {f for f in first if "month=1/" not in f} == first & second
    assert rows(versions.read_version(spark, path)) == rows(C.cascade_purge(clicks, only))
    assert rows(versions.read_version(spark, path, 0)) == rows(clicks)
    nothing = spark.createDataFrame([("no such",), (None,)], "short_token string")
    versions.purge(spark, path, 2, nothing)
    assert names(spark, path, 2) == second
    with pytest.raises(ValueError):
        versions.purge(spark, path, 4, nothing)
    versions.purge(spark, path, 3, clicks)
    assert versions.read_version(spark, path).count() == 0
    versions.purge(spark, path, 4, clicks)
    assert versions.read_version(spark, path).count() == 0


def test_a_purge_that_died_is_made_again(spark):
    clicks, path = D.clicks(spark, SF), scratch_path(spark, "clicks")
    versions.create(clicks, path)
    some, others = (clicks.filter(F.col("id") % 5 == i).select("short_token").distinct().limit(3) for i in (0, 1))
    # What was written before the manifest is not seen, and the next run takes its place.
    versions._write(clicks.limit(7), path, 1)
    assert rows(versions.read_version(spark, path)) == rows(clicks)
    for removed in (others, some):
        versions.purge(spark, path, 1, removed)
    assert rows(versions.read_version(spark, path)) == rows(C.cascade_purge(clicks, some))


def test_empty_table(spark):
    path = scratch_path(spark, "clicks")
    versions.create(D.clicks(spark, SF).limit(0), path)
    versions.purge(spark, path, 1, D.links(spark, SF))
    assert versions.read_version(spark, path).count() == 0
