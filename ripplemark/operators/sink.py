"""Results of runs: rows and metrics that count together or not at all; a repeated run replaces itself and nothing else."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_run(rows: DataFrame, metrics: DataFrame, folder: str, run: str) -> str:
    """Write a run's rows and its metrics (one row) to a folder that all executors share; returns the attempt's name.

    Rows go to rows/<run>/<attempt>, a name of their own. One appended file of commits then names the attempt and
    holds the metrics, so both count from the same moment on. What a broken run has left is never read, and a later
    commit of the same run takes the place of an earlier one, whose rows are deleted afterwards.
    """
    spark, attempt = rows.sparkSession, uuid.uuid4().hex
    before = _attempts(spark, folder, run)
    rows.withColumn("run", F.lit(run)).write.parquet(f"{folder}/rows/{run}/{attempt}")
    commit = metrics.limit(2)
    found = commit.count()
    if found != 1:
        raise ValueError(f"metrics of {run} are {'no' if not found else 'more than one'} row")
    named = [F.lit(run).alias("run"), F.lit(attempt).alias("attempt"), F.current_timestamp().alias("committed_at"), F.lit(len(before)).cast("long").alias("nth")]
    commit.select(*named, F.struct(*metrics.columns).alias("metrics")).coalesce(1).write.mode("append").parquet(f"{folder}/commits")
    _delete(spark, [f"{folder}/rows/{run}/{old}" for old in before])
    return attempt


def commits(spark: SparkSession, folder: str) -> DataFrame:
    """(run, attempt, committed_at, nth, metrics' columns) of the attempt of each run that counts: the last one committed."""
    rows = spark.read.option("mergeSchema", True).parquet(f"{folder}/commits")
    last = F.max_by(F.struct("attempt", "committed_at", "nth", "metrics"), F.struct("nth", "committed_at", "attempt")).alias("c")
    return rows.groupBy("run").agg(last).select("run", "c.attempt", "c.committed_at", "c.nth", "c.metrics.*")


def read_runs(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of all runs that count, with run. Only those are opened; their names, one for each run, go through the driver."""
    kept = [f"{folder}/rows/{r.run}/{r.attempt}" for r in commits(spark, folder).select("run", "attempt").collect()]
    return spark.read.option("mergeSchema", True).parquet(*kept)


def _attempts(spark: SparkSession, folder: str, run: str) -> list[str]:
    """Committed attempts of a run: as many as it was repeated."""
    try:
        return [r.attempt for r in spark.read.parquet(f"{folder}/commits").where(F.col("run") == run).select("attempt").collect()]
    except AnalysisException:  # nothing was ever committed
        return []


def _delete(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
