"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Mapping
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Settings every job of this library expects. Sizes suit a cluster; tests override the
#: partition counts. Joins carry no broadcast hints: the planner's size check and adaptive
#: execution choose, and fall back to a shuffle join when a side is large.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    # Ten thousand long texts or sets in one Arrow batch would be held several times over, by Spark and Python.
    "spark.sql.execution.arrow.maxBytesPerBatch": "4m",
}


#: Open ``scratch`` blocks of this thread, innermost last.
_BLOCKS: ContextVar[tuple[Scratch, ...]] = ContextVar("scratch_blocks", default=())


def apply_settings(spark: SparkSession) -> SparkSession:
    """Set the runtime settings on an existing session."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def bound_batches(spark: SparkSession) -> None:
    """Bound the bytes of Arrow batches, also in a session without the library's other settings."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.set(key, SETTINGS[key])


def build_session(
    app: str = "sparkmeter", master: str | None = None, conf: Mapping[str, str] | None = None
) -> SparkSession:
    """A session with the library's settings, overridden by ``conf``."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **(conf or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder: on a cluster other executors
    could not see it, and it would be lost with its machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    root = tempfile.mkdtemp(prefix="sparkmeter-")
    spark.sparkContext.setCheckpointDir(root)
    return root


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new, unused path under the scratch folder."""
    return f"{scratch_root(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def settle(df: DataFrame, label: str = "settled", **options: str) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back.

    Cuts the lineage and fixes the values, so that a lost executor re-reads files instead of
    recomputing (a step that follows may rely on row positions or overwrite its own source).
    Inside a ``scratch`` block the files go when the block ends, or earlier by ``Scratch.drop``.
    """
    blocks = _BLOCKS.get()
    return (blocks[-1] if blocks else Scratch(df.sparkSession)).settle(df, label, **options)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or folder in any file system that Spark can reach."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


class Scratch:
    """Settled tables of one job."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.paths: list[str] = []

    def settle(self, df: DataFrame, label: str = "settled", **options: str) -> DataFrame:
        """``settle``, held by this job."""
        path = scratch_path(self.spark, label)
        self.paths.append(path)
        with shuffles_removed(df.sparkSession):
            df.write.mode("errorifexists").options(**options).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, kept: int = 0) -> None:
        """Remove all settled tables but the ``kept`` latest."""
        stale, self.paths = self.paths[: len(self.paths) - kept], self.paths[len(self.paths) - kept :]
        for path in stale:
            remove(self.spark, path)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Queries made and run inside leave no shuffle files when they end.

    Else these stay until the driver happens to collect its garbage, those of all earlier steps of a
    job beside those of the step that runs. A DataFrame that is run again makes its shuffles again.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Scratch]:
    """Remove what is settled inside the block when it ends, also after a failure.

    For jobs that end with a committed table. A job that returns a DataFrame over settled tables
    must not be wrapped, as its files are still to be read. Blocks may be nested.
    """
    block = Scratch(spark)
    token = _BLOCKS.set((*_BLOCKS.get(), block))
    try:
        yield block
    finally:
        _BLOCKS.reset(token)
        block.drop()
