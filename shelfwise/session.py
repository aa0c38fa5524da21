"""Session construction and the shared checkpoint folder.

On a cluster the session already exists and ``spark.checkpoint.dir`` names a
shared folder; we only read it.  A folder of our own is created only where the
setting is unset (local tests, the bench).
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings that matter at scale; every one of them is a plain Spark option.
SCALE_DEFAULTS = {
    # Runtime re-planning: coalesce small shuffle partitions, split skewed join
    # partitions, turn a sort-merge join into a broadcast when the real size is small.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Static broadcast decisions compare an *estimated* size with this limit.  Parquet
    # sizes are compressed sizes; the factor inflates the estimate so that a table that
    # is small on disk but large in memory is not broadcast by mistake.
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    "spark.sql.sources.fileCompressionFactor": "4.0",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


LOCAL_DRIVER_MEMORY = "8g"


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "shelfwise", extra: dict | None = None) -> SparkSession:
    """Create (or reuse) a session with the settings above."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(SCALE_DEFAULTS)
    if master and master.startswith("local"):
        # In local mode the driver JVM does all the work; its default 1 GB heap is
        # too small.  On a cluster the deployment sizes driver and executors.
        conf["spark.driver.memory"] = LOCAL_DRIVER_MEMORY
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session, set up only when unset."""
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        # One machine (tests, local bench runs): a folder of its own will do.
        configured = tempfile.mkdtemp(prefix="shelfwise-ckpt-")
    spark.sparkContext.setCheckpointDir(configured)
    return spark.sparkContext.getCheckpointDir() or configured


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh sub-folder of the shared checkpoint folder for one job's output."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


#: Rows of a fact table that one task of a join is planned for.
TASK_ROWS = 500_000


def dealt(rows: DataFrame, n_rows: int, key: str) -> DataFrame:
    """``rows`` dealt by ``key`` into as many partitions as ``n_rows`` rows need, so that a task's share does not grow with the input.

    Runtime re-planning merges shuffle partitions up to a number of compressed bytes, which may hold many millions of narrow rows.
    Small inputs stay as they are.
    """
    tasks = n_rows // TASK_ROWS
    return rows if tasks < 2 else rows.repartition(max(tasks, rows.sparkSession.sparkContext.defaultParallelism), key)
