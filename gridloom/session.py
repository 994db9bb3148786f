"""Session settings and the shared folder used to cut lineage and exchange files."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_fallback_dirs: dict[str, str] = {}


def build_session(app: str = "gridloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC; cluster settings given by the caller win."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.serializer": "org.apache.spark.serializer.KryoSerializer",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def _local_only(master: str) -> None:
    if not re.fullmatch(r"local(\[.*\])?", master):
        raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, named by ``spark.checkpoint.dir``.

    The setting belongs to the cluster. Only where it is unset and the master is local a fresh local
    folder is created, once per application, so all callers agree on it. Executors elsewhere would
    not see such a folder, so that any other master without the setting is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    _local_only(spark.sparkContext.master)
    app = spark.sparkContext.applicationId
    if app not in _fallback_dirs:
        _fallback_dirs[app] = tempfile.mkdtemp(prefix="gridloom-", dir=os.environ.get("TMPDIR"))
    return _fallback_dirs[app]


def scratch(spark: SparkSession, label: str) -> str:
    """A new, never reused path below the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


@contextmanager
def small_batches(spark: SparkSession, size: str = "8m") -> Iterator[None]:
    """Jobs run inside send rows to Python workers in batches of about ``size``, for rows of MB each.

    A batch is one buffer outside the heap that doubles as it grows. Batches never change results; other jobs of the
    session that start meanwhile get them too.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, size)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def cut(df: DataFrame, label: str = "cut", **options: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Iterative operators use it instead of a local checkpoint: the rows live in the shared folder,
    so a lost executor costs a re-read and not the whole lineage. ``options`` are those of the Parquet writer.
    """
    path = scratch(df.sparkSession, label)
    schema = df.schema
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)
