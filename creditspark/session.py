"""Session settings and lineage cuts shared by every operator."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterable
from functools import partial
from multiprocessing.pool import ThreadPool
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.util import inheritable_thread_target


def build_session(app: str = "creditspark", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators rely on; cluster values win when already set."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        **conf,
    }
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: the one named by ``spark.checkpoint.dir``.

    Only a local session may leave it unset; it then gets a temporary folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if named:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(named)
        return named
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="creditspark-"))
    return context.getCheckpointDir()


def materialize(df: DataFrame) -> DataFrame:
    """Compute ``df`` once into reliable storage, so later branches and lost executors re-read it."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def in_threads(spark: SparkSession, work: Callable, jobs: Iterable, parallelism: int = 8) -> list[Any]:
    """``work`` of every job, in order, several at a time.

    Every job has its own copy of the caller's local properties: in a shared one a query that ends takes away the
    execution id that another is about to read.
    """
    runs = [inheritable_thread_target(spark)(partial(work, job)) for job in jobs]
    with ThreadPool(max(1, min(parallelism, len(runs)))) as pool:
        return pool.map(lambda run: run(), runs, chunksize=1)
