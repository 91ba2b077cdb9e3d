"""Session helpers: building a local session for tests/bench and resolving the
shared checkpoint folder that lineage cuts (surrogate keys, exact quantiles)
write to."""

from __future__ import annotations

import contextvars
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_LOCAL_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app_name: str = "strata", extra: dict | None = None) -> SparkSession:
    """A local session for tests and the bench; on a cluster the caller's
    session (and its settings) are used as they are."""
    builder = (SparkSession.builder.master(f"local[{cores}]").appName(app_name)
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
               .config("spark.driver.memory", "8g"))
    for k, v in {**_LOCAL_DEFAULTS, **(extra or {})}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint folder from the session (``spark.checkpoint.dir``).

    Only a local-mode session without the setting gets a fresh private
    folder (tests); a cluster session without it is a configuration error,
    since a machine-local folder would not survive the loss of an executor.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get(
        "spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir is not set: point it at a shared folder "
            "(HDFS/object store) before running jobs that cut lineage")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="strata-ckpt-"))
    return sc.getCheckpointDir()


_SCRATCH: contextvars.ContextVar[str | None] = contextvars.ContextVar("strata_scratch", default=None)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """Tables staged inside the block lie in one folder of the checkpoint
    folder, which is deleted when the block ends. So whatever leaves the block
    must have been written elsewhere or computed before it ends."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/scratch-{uuid.uuid4().hex}"
    token = _SCRATCH.set(path)
    try:
        yield path
    finally:
        _SCRATCH.reset(token)
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)  # noqa: SLF001
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)  # noqa: SLF001


def stage_path(spark: SparkSession, prefix: str = "stage") -> str:
    """A fresh path in the session's checkpoint folder."""
    folder = _SCRATCH.get() or ensure_checkpoint_dir(spark)
    return f"{folder.rstrip('/')}/{prefix}-{uuid.uuid4().hex}"


def stage_table(df: DataFrame, prefix: str = "stage") -> DataFrame:
    """Write ``df`` once as a Parquet table in the checkpoint folder and read
    it back: later plans that use the result more than once scan the table
    instead of recomputing it, and a lost executor re-reads the table
    rather than re-running the lineage."""
    spark = df.sparkSession
    path = stage_path(spark, prefix)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def map_jobs(spark: SparkSession, fn, items, parallel: int = 4) -> list:
    """``[fn(x) for x in items]`` with up to ``parallel`` calls at once, for
    independent per-table jobs. Each call runs with the caller's local
    properties and job tags (job group, scheduler pool), so its jobs are
    accounted to the caller."""
    from concurrent.futures import ThreadPoolExecutor
    from pyspark.util import inheritable_thread_target
    items = list(items)
    if parallel <= 1 or len(items) <= 1:
        return [fn(x) for x in items]
    target = inheritable_thread_target(spark)(fn)
    with ThreadPoolExecutor(max_workers=min(parallel, len(items))) as pool:
        # each call sees the caller's scratch folder
        jobs = [pool.submit(contextvars.copy_context().run, target, x) for x in items]
        return [job.result() for job in jobs]
