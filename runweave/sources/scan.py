"""Run directories read as one trace of all runs and iterations.

``<root>/<run>/<job>-<label>-<iteration>/trace-events/<event>.pq`` with the side files as CSV in the
job's directory. One scan per event reads that event of every run; run and iteration come from the
file's path and the order of rows from its row index.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runweave.config import Options, local_table
from runweave.errors import MissingRuns
from runweave.functions.text import UNKNOWN, event_name, run_tag
from runweave.operators.ordered import cut_by, follow
from runweave.sources.schema import EVENT_FIELDS, HEADER, PROJECTIONS, RENAMED, SIDE_FILES
from runweave.sources.sink import read_table
from runweave.trace import RUN_KEYS, Tables, Trace

JOB = r"/([^/]+)/[^/-]+-([^/]+)-(\d+)/(?:trace-events/)?([^/]+)$"
EVENT_DIR = "trace-events"


@dataclass(frozen=True)
class Runs:
    """What a listing of the run directories found.

    ``files`` has a row per file: ``path, wa_path, label, iteration, file, event`` (``event`` is
    null for a side file). ``iterations`` has the distinct runs and iterations.
    """

    root: str
    names: list[str]
    files: DataFrame
    iterations: DataFrame


def _path_keys(path: Column) -> list[Column]:
    return [
        F.regexp_extract(path, JOB, 1).alias("wa_path"),
        F.regexp_extract(path, JOB, 2).alias("label"),
        F.regexp_extract(path, JOB, 3).cast("int").alias("iteration"),
    ]


def list_runs(spark: SparkSession, root: str, names: Sequence[str] | None = None) -> Runs:
    """List the files of the named runs, or of all below ``root``; an error when there is no iteration."""
    paths = [f"{root}/{name}" for name in names] if names else [root]
    try:
        listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths).select("path")
    except AnalysisException as error:
        raise MissingRuns(f"no run found below {root}") from error
    found = listed.filter(F.col("path").rlike(JOB))
    file = F.regexp_extract("path", JOB, 4)
    is_event = F.col("path").contains(f"/{EVENT_DIR}/") & file.endswith(".pq")
    files = found.select(
        "path", *_path_keys(F.col("path")), file.alias("file"), F.when(is_event, event_name(file)).alias("event")
    )
    iterations = files.select("wa_path", "label", "iteration").distinct()
    present = [r.wa_path for r in files.select("wa_path").distinct().orderBy("wa_path").collect()]
    absent = [name for name in names or () if name not in present]
    if absent or not present:
        raise MissingRuns(f"no iteration found for: {', '.join(absent) or root}")
    return Runs(root, list(names or present), files, iterations)


def kernel_releases(spark: SparkSession, runs: Runs) -> dict[str, str]:
    """Kernel release of each run that says so."""
    try:
        told = spark.read.text(f"{runs.root}/{{{','.join(runs.names)}}}/__meta/target_info.json", wholetext=True)
    except AnalysisException:
        return {}
    run = F.regexp_extract(F.col("_metadata.file_path"), r"/([^/]+)/__meta/[^/]+$", 1)
    rows = told.select(run.alias("run"), F.get_json_object("value", "$.kernel_version.release").alias("release"))
    return {r.run: r.release for r in rows.filter("release is not null").collect()}


def runs_table(spark: SparkSession, runs: Runs, kernels: Mapping[str, str] | None = None) -> DataFrame:
    """A row per run: kernel, label, tag and order.

    The kernel is the one given, or else that of the run's own ``__meta/target_info.json``, or ``<unknown>``.
    """
    kernels = {**kernel_releases(spark, runs), **(kernels or {})}
    labels = {r.wa_path: r.label for r in runs.iterations.groupBy("wa_path").agg(F.min("label").alias("label")).collect()}
    rows = [(n, kernels.get(n), labels[n], i) for i, n in enumerate(runs.names)]
    table = local_table(spark, rows, "wa_path string, kernel string, label string, run_order int")
    return table.withColumns({"kernel": F.coalesce("kernel", F.lit(UNKNOWN)), "tag": run_tag("wa_path")})


def scan_event(spark: SparkSession, runs: Runs, event: str, skip_unreadable: bool = False) -> DataFrame:
    """All rows of an event. A file that cannot be read is an error, or is left out if asked (see ``quality.unread_files``)."""
    rows = (
        spark.read.schema(f"{HEADER}, {EVENT_FIELDS[event]}")
        .option("pathGlobFilter", f"{{lisa__,}}{event}.pq").option("ignoreCorruptFiles", skip_unreadable)
        .parquet(*[f"{runs.root}/{name}/*/{EVENT_DIR}" for name in runs.names])
    )
    run, _, iteration = _path_keys(F.col("_metadata.file_path"))
    kept = rows.select(
        run, iteration, F.col("common_ts").alias("t_ns"), F.col("_metadata.row_index").alias("seq"), "*"
    )
    return kept.selectExpr(
        *RUN_KEYS, "t_ns", "seq", *PROJECTIONS[event],
        "common_cpu as __cpu", "common_pid as __pid", "common_comm as __comm",
    )


def scan_side_file(spark: SparkSession, runs: Runs, kind: str) -> DataFrame:
    """CSV rows of all iterations, columns by header name; a file with another header is an error."""
    pattern, typed, default = SIDE_FILES[kind]
    rows = (
        spark.read.option("header", True).option("enforceSchema", False).option("pathGlobFilter", pattern)
        .csv([f"{runs.root}/{name}/*" for name in runs.names])
    )
    run, _, iteration = _path_keys(F.col("_metadata.file_path"))
    columns = [
        F.col(f"`{c}`").cast(typed.get(RENAMED.get(c, c), default)).alias(RENAMED.get(c, c)) for c in rows.columns
    ]
    return rows.select(run, iteration, *columns)


def scan_trace(
    spark: SparkSession, runs: Runs, options: Options | None = None, kernels: Mapping[str, str] | None = None,
    skip_unreadable: bool = False,
) -> Trace:
    """The trace of the listed runs; an event or side file no run has is absent from it.

    An event file that cannot be read stops whatever uses it. With ``skip_unreadable`` it is left out:
    ``quality.unread_files`` lists such files.
    """
    kinds = {r.event for r in runs.files.select("event").distinct().collect()} & set(EVENT_FIELDS)
    makers = {event: (lambda e=event: scan_event(spark, runs, e, skip_unreadable)) for event in sorted(kinds)}
    sides = runs.files.filter("event is null").agg(*[
        F.coalesce(F.bool_or(F.col("file").like(pattern.replace("*", "%"))), F.lit(False)).alias(kind)
        for kind, (pattern, _, _) in SIDE_FILES.items()
    ]).first()
    makers |= {kind: (lambda k=kind: scan_side_file(spark, runs, k)) for kind in SIDE_FILES if sides[kind]}
    return Trace(
        spark, Tables(makers), runs_table(spark, runs, kernels), options or Options(),
        iterations=runs.iterations.count(),
    )


def write_events(trace: Trace, path: str) -> None:
    """Rewrite the event tables once as ``event=<name>/wa_path=<run>``, sorted by time within files."""
    for name, table in trace.tables.items():
        if "t_ns" in table.columns:
            table.sortWithinPartitions(*RUN_KEYS, "t_ns").write.mode("overwrite").option(
                "partitionOverwriteMode", "dynamic"
            ).partitionBy("wa_path").parquet(f"{path}/event={name}")


def with_events_at(trace: Trace, path: str) -> Trace:
    """The trace reading its events from where ``write_events`` put them."""
    makers = {
        name: (lambda n=name: read_table(trace.spark, f"{path}/event={n}"))
        if "t_ns" in table.columns else (lambda t=table: t)
        for name, table in trace.tables.items()
    }
    return replace(trace, tables=Tables(makers))


def unique_times(df: DataFrame, options: Options | None = None) -> DataFrame:
    """Events of one instant get one ns more each, in file order, so times are unique."""
    options = options or Options()
    cut, part = cut_by(df, F.floor(F.col("seq") / options.rows_per_slice))
    numbered = follow(cut, [*RUN_KEYS, "t_ns"], ["seq"], slice_col=part, number="nth")
    return numbered.withColumn("t_ns", F.col("t_ns") + F.col("nth") - 1).drop("nth", "piece")


COLUMNAR = (".parquet", ".pqt", ".pq")
RESULT_FILES, FRAME_FILES = "results*", "*jankbench*"


def files_of(spark: SparkSession, runs: Runs, pattern: str) -> list[str]:
    """Paths of a run's own tables, at any depth below the runs' directories. Only names are listed."""
    roots = [f"{runs.root}/{name}" for name in runs.names]
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).option(
        "pathGlobFilter", f"{pattern}.{{csv,{','.join(e[1:] for e in COLUMNAR)}}}").load(roots)
    return sorted(r["path"] for r in listed.select("path").collect())


def _tables(spark: SparkSession, paths: Sequence[str], named: Sequence[str]) -> DataFrame:
    """Files of several schemas as one table; a column some lack is null there. One scan for all CSV files of one header.

    A CSV file's header is the line that has all of ``named`` among its fields: lines are read one by one, no file is held.
    """
    columnar = [p for p in paths if p.endswith(COLUMNAR)]
    tables = [spark.read.option("mergeSchema", True).parquet(*columnar).select("*", F.col("_metadata.file_path").alias("_path"))] if columnar else []
    if lines := [p for p in paths if p not in columnar]:
        fields = F.transform(F.split(F.trim("value"), ","), lambda c: F.trim(F.regexp_replace(c, '"', "")))
        heads = spark.read.text(lines).filter(reduce(lambda a, b: a & b, [F.array_contains(fields, n) for n in named])).select(
            F.col("_metadata.file_path").alias("path"), F.trim("value").alias("head")).distinct()
        of_head = heads.groupBy("head").agg(F.collect_set("path").alias("paths")).orderBy("head").collect()  # as many as files
        if without := len(lines) - sum(len(r["paths"]) for r in of_head):
            raise MissingRuns(f"{without} files have no header with {', '.join(named)}")
        for r in of_head:
            table = spark.read.option("header", True).option("enforceSchema", False).csv(r["paths"])
            tables.append(table.select("*", F.col("_metadata.file_path").alias("_path")))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def _with_run(table: DataFrame, runs: Runs | None) -> DataFrame:
    """The run and iteration of each row: its own columns, or else those of the file's path."""
    if runs is not None:
        root = runs.root.rstrip("/").rpartition("/")[2]
        run = F.nullif(F.regexp_extract("_path", f"/{re.escape(root)}/([^/]+)/", 1), F.lit(""))
        iteration = F.nullif(F.regexp_extract("_path", r"/[^/-]+-[^/]+-(\d+)/[^/]+$", 1), F.lit(""))
        own = lambda c: F.col(c).cast("string") if c in table.columns else F.lit(None).cast("string")
        table = table.withColumns({"wa_path": F.coalesce(own("wa_path"), run), "iteration": F.coalesce(own("iteration"), iteration)})
    return table.withColumns({"value": F.col("value").cast("double"), "iteration": F.col("iteration").cast("int")}).drop("_path")


def read_results(spark: SparkSession, runs: Runs | Sequence[str]) -> DataFrame:
    """Benchmark results of the listed runs (or of given files) in one table; a column some lack is null there."""
    paths = files_of(spark, runs, RESULT_FILES) if isinstance(runs, Runs) else list(runs)
    if not paths:
        raise MissingRuns("no results given")
    return _with_run(_tables(spark, paths, ("metric", "value")), runs if isinstance(runs, Runs) else None)


def read_frames(spark: SparkSession, runs: Runs) -> DataFrame:
    """The per-frame table of the listed runs in long form: ``wa_path, iteration, variable, value``."""
    paths = files_of(spark, runs, FRAME_FILES)
    if not paths:
        raise MissingRuns("no run has a table of frames")
    return _with_run(_tables(spark, paths, ("variable", "value")), runs).select(*RUN_KEYS, "variable", "value")
