"""Session helpers: a builder with the settings the operators expect, and shared scratch space."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_local_base: dict[str, str] = {}


def build_session(app: str = "docketry", master: str | None = None, **conf: str) -> SparkSession:
    """A session with AQE (coalescing and skew joins) on and UTC as the session zone.

    On a cluster leave ``master`` empty and set ``spark.sql.shuffle.partitions`` to two or three
    times the core count; AQE folds small partitions back together.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.sources.partitionOverwriteMode", "dynamic")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_base(spark: SparkSession) -> str:
    """The folder every executor can reach, named by ``spark.checkpoint.dir``.

    Without the setting a temporary folder is used, but only on a local master: on a cluster a
    driver-local folder is invisible to executors, so that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    app = spark.sparkContext.applicationId
    if app not in _local_base:
        _local_base[app] = tempfile.mkdtemp(prefix="docketry-")
    return _local_base[app]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_base(spark)}/docketry/{label}-{uuid.uuid4().hex}"


def cut_lineage(df, label: str):
    """Materialise ``df`` as a table in the shared folder and read it back.

    The copy survives executor loss, so a job that reuses it never recomputes its inputs.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)
