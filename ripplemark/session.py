"""A session with the settings the tests and the bench run under, and the package for workers."""

from __future__ import annotations

import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

PACKAGE = Path(__file__).resolve().parent


def ship(spark: SparkSession) -> None:
    """Give the package to Python workers that can't import it: unless its folder is the working directory or on
    PYTHONPATH, it is sent along once for each application."""
    known = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    if any(p and Path(p).resolve() == PACKAGE.parent for p in known):
        return
    context = spark.sparkContext
    name = f"{PACKAGE.name}-package.zip"
    if any(name in str(p) for p in context._python_includes):
        return
    folder = tempfile.mkdtemp(prefix="spark-ripplemark-")
    context.addPyFile(shutil.make_archive(f"{folder}/{name.removesuffix('.zip')}", "zip", PACKAGE.parent, PACKAGE.name))


def local_session(app: str = "ripplemark", cpus: int | None = None, partitions: int | None = None) -> SparkSession:
    """Local session; on a cluster the caller brings its own and nothing here is used."""
    cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", os.environ.get("RIPPLEMARK_DRIVER_MEMORY", "8g"))
        .config("spark.sql.shuffle.partitions", str(partitions or cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
