"""Session construction and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


_scratch: tempfile.TemporaryDirectory | None = None


def get_session(master: str | None = None, app: str = "quire",
                shuffle_partitions: int | None = None,
                extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the settings the jobs assume.

    AQE stays on: it coalesces small shuffle partitions, splits skewed join
    partitions, and turns sort-merge joins into broadcast joins when a side
    turns out small at run time (that runtime measurement is the size check
    for data-dependent join sides).
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = {
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


# Bytes one reduce task takes at 100 TB, and the most reduce partitions a run
# asks for: the driver keeps a size for every (map task, partition) block.
REDUCE_BYTES = 1 << 30
MAX_PARTITIONS = 50_000
MAX_MAP_TASKS = 200_000


def scale_settings(input_bytes: int, executor_cores_total: int, expansion: float = 3.0) -> dict:
    """Settings for a cluster run over ``input_bytes`` of (compressed) input.

    - scan splits of 128 MB, larger once that would make more than
      ``MAX_MAP_TASKS`` of them;
    - the shuffle carries about ``expansion`` x the input (token rows are larger
      than the compressed text) in partitions of ``REDUCE_BYTES``, at least
      two waves of the cluster's cores and at most ``MAX_PARTITIONS``; AQE
      coalesces what turns out small and splits what is skewed, so a partition
      beyond the bound is spilled and read in pieces, not held;
    - runtime broadcast conversion stays at the AQE default threshold.
    """
    split = max(128 << 20, -(-input_bytes // MAX_MAP_TASKS))
    wanted = max(2 * executor_cores_total, int(input_bytes * expansion // REDUCE_BYTES) + 1)
    return {
        "spark.sql.files.maxPartitionBytes": str(split),
        "spark.sql.shuffle.partitions": str(min(MAX_PARTITIONS, wanted)),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(256 << 20),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(1 << 30),
        "spark.sql.parquet.filterPushdown": "true",
    }


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and intermediate tables.

    Read from the session (``spark.checkpoint.dir``, as a cluster sets it).
    Only a local-mode session without one (tests) gets a scratch folder of this
    process, which is removed when the process ends; a cluster session without
    one is an error, because a machine-local folder would not survive the loss
    of an executor.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        global _scratch
        _scratch = _scratch or tempfile.TemporaryDirectory(prefix="quire-ckpt-", ignore_cleanup_errors=True)
        conf_dir = _scratch.name
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder for a written table."""
    base = checkpoint_dir(spark)
    return os.path.join(base, "tables", f"{name}-{uuid.uuid4().hex}")
