"""Refreshes whose tables become visible together.

A run writes every table to a folder of its own, ``<table>/run=<run>``, and its one-row marker last; Spark moves that file into place with one rename. Readers see the rows
of marked runs only, so a run that was killed between two tables shows nothing, and repeating it overwrites what it left.
"""

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskfabric.operators import store, tracker
from riskfabric.operators.tracker import LIFE
from riskfabric.session import cut

MARKERS = "committed"


def _named(run: str) -> str:
    """Partition value of a run; the prefix keeps numbers from being read as such."""
    return f"run-{run}"


def committed(spark: SparkSession, folder: str) -> DataFrame | None:
    """``run`` and ``collected_at`` of the visible runs, None before the first."""
    try:
        return spark.read.parquet(f"{folder}/{MARKERS}")
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def is_committed(spark: SparkSession, folder: str, run: str) -> bool:
    runs = committed(spark, folder)
    return runs is not None and not runs.filter(F.col("run") == _named(run)).isEmpty()


def commit(spark: SparkSession, folder: str, run: str, tables: dict[str, DataFrame], collected_at: Column) -> bool:
    """Write all tables of a run and make them visible; False if the run is visible already, which changes nothing."""
    if is_committed(spark, folder, run):
        return False
    for name, rows in tables.items():
        rows.write.mode("overwrite").parquet(f"{folder}/{name}/run={_named(run)}")
    spark.range(1, numPartitions=1).select(collected_at.alias("collected_at")).write.mode("overwrite").parquet(f"{folder}/{MARKERS}/run={_named(run)}")
    return True


def table(spark: SparkSession, folder: str, name: str) -> DataFrame | None:
    """Rows of a table in all visible runs with their ``run``, None before the first. The join prunes the folders of other runs."""
    runs = committed(spark, folder)
    return None if runs is None else spark.read.parquet(f"{folder}/{name}").join(runs.select("run"), "run", "left_semi")


def current(spark: SparkSession, folder: str, name: str, groups=("country",)) -> DataFrame | None:
    """Snapshot of a table: every group as the newest run that has rows of it left it (see ``store.replace_groups``)."""
    rows, runs = table(spark, folder, name), committed(spark, folder)
    if rows is None:
        return None
    moments = rows.select("run", *groups).distinct().join(runs.withColumnRenamed("collected_at", "__at"), "run")
    newest = moments.groupBy(*groups).agg(F.max_by("run", F.struct("__at", "run")).alias("run"))
    return rows.join(newest, [*groups, "run"], "left_semi").drop("run")


def patterns(spark: SparkSession, folder: str) -> DataFrame | None:
    """Current row of every pattern."""
    rows = table(spark, folder, "patterns")
    return None if rows is None else tracker.latest_patterns(rows)


def collect(spark: SparkSession, folder: str, run: str, job: Callable, collected_at: Column) -> bool:
    """A whole refresh: ``job`` gets the patterns stored so far and returns (articles, touches, volume windows, refresh rows); warnings compare the new windows with the stored ones.

    All tables are committed together. A run that is visible already is not computed again; one that died is repeated from the same stored state.
    """
    if is_committed(spark, folder, run):
        return False
    known, volumes = table(spark, folder, "patterns"), table(spark, folder, "windows")
    if known is not None:  # only these can still be matched
        known = cut(tracker.latest_patterns(known.filter(F.col("collected_at") >= collected_at - F.make_dt_interval(F.lit(LIFE.days)))))
    articles, touches, windows, refreshes = job(known)
    windows = cut(windows)
    series = windows if volumes is None else volumes.drop("run").unionByName(windows)
    return commit(spark, folder, run, {"articles": articles, "patterns": tracker.score_patterns(touches, series), "windows": windows, "refreshes": refreshes}, collected_at)
