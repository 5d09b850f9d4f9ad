"""Session helpers: a tuned session for local runs, and the shared scratch area.

Intermediate results that several jobs read (a deduplicated table that feeds three
fits, a group table that is measured and then joined) are written once as Parquet to
the shared folder the cluster names in ``spark.checkpoint.dir``. That cuts the lineage,
survives the loss of executors, and later reads prune columns, which an RDD checkpoint
cannot do.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import cache

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_SETTING = "spark.checkpoint.dir"
_run_folder: ContextVar[str | None] = ContextVar("run_folder", default=None)


def build_session(master: str = "local[8]", app_name: str = "lustra", **conf: str) -> SparkSession:
    """Session for tests and benchmarks. On a cluster use the session you already have."""
    builder = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        # HotSpot leaves methods beyond this size to the interpreter; plans that would
        # generate one run faster without whole-stage code.
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    The session's own setting wins. Only a local master may fall back to a temporary
    folder of the machine; anywhere else a missing setting is an error.
    """
    context = spark.sparkContext
    configured = spark.conf.get(CHECKPOINT_SETTING, None) or context.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_SETTING} to a folder all executors can reach")
    return _local_folder(context.applicationId)


@cache
def _local_folder(application_id: str) -> str:
    return tempfile.mkdtemp(prefix=f"lustra-{application_id}-")


@contextmanager
def run_folder(spark: SparkSession) -> Iterator[str]:
    """One folder for all tables written inside, so that they can be dropped together.

    A run inside a run shares its folder. If the run fails, the folder is dropped at once.
    """
    outer = _run_folder.get()
    if outer:
        yield outer
        return
    path = new_scratch_path(spark, "run")
    token = _run_folder.set(path)
    try:
        yield path
    except BaseException:
        drop_folder(spark, path)
        raise
    finally:
        _run_folder.reset(token)


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever store it lies; one that does not exist is no error."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def new_scratch_path(spark: SparkSession, label: str) -> str:
    """A path below the shared folder, or below that of the run, that nothing else uses."""
    return f"{_run_folder.get() or scratch_dir(spark)}/lustra-{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return a scan of the written table."""
    spark = df.sparkSession
    path = new_scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
