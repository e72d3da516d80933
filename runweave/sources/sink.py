"""Writing and reading of datasets.

A dataset's rows lie in `<path>/<name>/version=<v>/wa_path=<run>/`, one version a call. Which version holds a run is said by
manifests, small tables `<path>/manifests/<name>/number=<n>` that are only ever added: a call writes its version first and its
manifest last. Readers take the manifest with the greatest number, so they see all of a call or nothing of it, and a
call that fails changes nothing for them. Versions that no manifest in use names are left on disk (`replaced_versions`).
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "wa_path string, version string"


def write_dataset(
    df: DataFrame, path: str, name: str, gather: bool = True, runs: Sequence[str] = ()
) -> dict[str, int]:
    """Write a dataset of one or more runs; a rerun replaces the runs it holds and leaves the others.

    Returns the number of rows written of each of ``runs``. Rows that an earlier call left of a run
    that has none now are no longer read, so the dataset never shows stale results of a run in hand.
    Of two calls for one dataset at a time, the one that ends last fails.

    ``gather`` brings a run's rows together in files of even size, large runs in several. Leave it
    out for rows straight from a scan: their splits hold one run each already.
    """
    spark = df.sparkSession
    number, live = manifest(spark, path, name)
    rows = df.hint("rebalance", "wa_path") if gather else df
    version = uuid.uuid4().hex
    folder = f"{path}/{name}/version={version}"
    rows.write.partitionBy("wa_path").parquet(folder)
    counts = {r.wa_path: r["count"] for r in spark.read.schema(df.schema).parquet(folder).groupBy("wa_path").count().collect()}
    held = {run: v for run, v in live.items() if run not in counts and run not in runs} | dict.fromkeys(counts, version)
    # one file, so that it appears at once; a null row keeps a dataset without runs apart from one never written
    told = spark.createDataFrame([*held.items(), (None, None)], MANIFEST).coalesce(1)
    told.write.parquet(f"{path}/manifests/{name}/number={number + 1}")
    return {run: counts.get(run, 0) for run in runs}


def manifest(spark: SparkSession, path: str, name: str) -> tuple[int, dict[str, str]]:
    """The number of the manifest in use, 0 for none, and each run's version."""
    try:
        told = spark.read.parquet(f"{path}/manifests/{name}")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return 0, {}
    last = told.agg(F.max("number")).first()[0]
    return last, {r.wa_path: r.version for r in told.filter(F.col("number") == last).collect() if r.wa_path is not None}


def read_dataset(spark: SparkSession, path: str, name: str, runs: Sequence[str] | None = None) -> DataFrame | None:
    """The rows of a dataset, of all runs or of ``runs``; None where none of them has any."""
    _, live = manifest(spark, path, name)
    by_version: dict[str, list[str]] = {}
    for run, version in live.items():
        if runs is None or run in runs:
            by_version.setdefault(version, []).append(run)
    if not by_version:
        return None
    root = f"{path}/{name}"
    stored = spark.read.option("basePath", root).parquet(*[f"{root}/version={v}" for v in by_version])
    held = F.lit(False)
    for version, kept in by_version.items():
        held |= (F.col("version") == version) & F.col("wa_path").isin(kept)
    return stored.filter(held).drop("version")


def replaced_versions(spark: SparkSession, path: str, name: str) -> DataFrame:
    """version: those that earlier manifests name and the one in use does not. Their folders may go when nobody reads them."""
    _, live = manifest(spark, path, name)
    told = spark.read.parquet(f"{path}/manifests/{name}")
    return told.filter("version IS NOT NULL").filter(~F.col("version").isin(list(set(live.values())))).select("version").distinct()


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
