"""A store of events laid out for ordered work: bucketed by run, iteration and time slice, sorted by time within.

Writing it deals every event out once. From then on windows, groups and joins by run, iteration and slice read their
rows where they are: ordered operators need no exchange of events and no look at the windows. Beside the events stand the
windows with the borders of all slices, the runs, the side files, and a timeline of state changes whose slices carry what they
inherit (see ``operators.sweep``).

A slice has about ``rows_per_slice`` rows, so no bucket is one hot run; the number of buckets follows the number of rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Collection
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runweave.config import Options
from runweave.operators import sweep
from runweave.trace import PLACED, Tables, Trace

ORDER = ("t_ns", "seq")
SWEPT = {"cpu_idle", "cpu_frequency", "sched_switch"}
MAX_BUCKETS = 20_000


def _name(folder: str, table: str) -> str:
    return f"store_{hashlib.md5(folder.encode()).hexdigest()[:16]}_{table}".replace("-", "_")


def _write(df: DataFrame, folder: str, table: str, buckets: int, mode: str = "overwrite") -> tuple[str, int, str]:
    """Write a table in buckets, one file each (and one more if appended to), and return what is needed to find it again."""
    spark, name = df.sparkSession, _name(folder, table)
    if mode == "overwrite":
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    # the writer itself sorts what it is given by bucket and by these columns
    (df.repartition(buckets, *PLACED).write.format("parquet").mode(mode).option("path", f"{folder}/{table}")
     .bucketBy(buckets, *PLACED).sortBy(*PLACED, *ORDER).saveAsTable(name))
    return table, buckets, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def write_store(trace: Trace, folder: str, buckets: int | None = None, tables: Collection[str] | None = None) -> None:
    """Lay the events of a trace out below ``folder``; an earlier store there is replaced.

    ``tables`` names the events a caller is going to read, and ``timeline``; all of them otherwise. `add_tables` brings others later.
    The layout table is written last: a store that was not finished cannot be opened.
    """
    spark = trace.spark
    trace.slices.write.mode("overwrite").parquet(f"{folder}/slices")
    trace.runs.write.mode("overwrite").parquet(f"{folder}/runs")
    if buckets is None:
        rows = trace.slices.agg(F.sum("events")).first()[0] or 0
        buckets = min(MAX_BUCKETS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows // trace.options.rows_per_slice))
    if tables is None:
        tables = [*trace.tables, *(["timeline"] if SWEPT & set(trace.tables) else [])]
    _lay_out(trace, folder, buckets, tables, "overwrite")


def add_tables(trace: Trace, folder: str, tables: Collection[str]) -> None:
    """Further tables of the trace in a store that has been written: with its slices and its number of buckets."""
    spark = trace.spark
    known = {r["name"]: r["dealt"] for r in spark.read.parquet(f"{folder}/layout").collect()}  # a row per event
    missing = [t for t in tables if t not in known]
    if missing:
        sliced = replace(trace, prepared={**trace.prepared, "slices": spark.read.parquet(f"{folder}/slices")})
        _lay_out(sliced, folder, max(known.values()), missing, "append")


def _lay_out(trace: Trace, folder: str, buckets: int, tables: Collection[str], mode: str) -> None:
    spark, found = trace.spark, []
    for name in tables:
        if name == "timeline":
            found.append(_write(sweep.changes(trace), folder, name, buckets))
            _write(sweep.carried(trace, spark.table(_name(folder, name))), folder, name, buckets, "append")
        elif "t_ns" in trace.event(name).columns:
            found.append(_write(trace.cut(trace.event(name)), folder, name, buckets))
        else:
            trace.event(name).write.mode("overwrite").parquet(f"{folder}/{name}")
            found.append((name, 0, ""))
    spark.createDataFrame([(*row, buckets) for row in found], "name string, buckets int, columns string, dealt int").write.mode(mode).parquet(f"{folder}/layout")


def open_store(spark: SparkSession, folder: str, options: Options | None = None, iterations: int | None = None) -> Trace:
    """The trace of a store.

    Joins of events with a slice's few rows keep the events where they are: the session setting that asks both sides to be
    dealt by all columns of a join is turned off.
    """
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    layout = spark.read.parquet(f"{folder}/layout").collect()  # a row per event

    def table(name: str, buckets: int, columns: str) -> DataFrame:
        if not buckets:
            return spark.read.parquet(f"{folder}/{name}")
        known = _name(folder, name)
        by, order = ", ".join(PLACED), ", ".join((*PLACED, *ORDER))
        spark.sql(f"CREATE TABLE IF NOT EXISTS {known} ({columns}) USING parquet CLUSTERED BY ({by}) SORTED BY ({order}) INTO {buckets} BUCKETS LOCATION '{folder}/{name}'")
        return spark.table(known)

    layout = [(r["name"], r["buckets"], r["columns"]) for r in layout]
    makers = {r[0]: (lambda r=r: table(*r)) for r in layout if r[0] != "timeline"}
    prepared = {"slices": spark.read.parquet(f"{folder}/slices")}
    prepared |= {"timeline": table(*r) for r in layout if r[0] == "timeline"}
    runs = spark.read.parquet(f"{folder}/runs")
    return Trace(spark, Tables(makers), runs, options or Options(), iterations=iterations, prepared=prepared)
