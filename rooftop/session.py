"""Session helpers: a local session for tests and the bench, and shared scratch paths.

Library code never builds a session of its own; it takes the caller's.  Paths
for intermediate tables come from the session's checkpoint directory, which on
a cluster is the shared folder named by ``spark.checkpoint.dir``.  Only on a
local master, where all tasks see the same disk, is one created under the
system temp folder when that is unset; a cluster without one is an error.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = 8, shuffle_partitions: int = 8, app: str = "rooftop") -> SparkSession:
    """Session for tests and the bench: local mode, AQE on, UI off, UTC."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        # checkpoint files of unreferenced RDDs are removed (bench and tests only)
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint directory; on a local master a temp one is set if there is none."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not is_local(sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="rooftop-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def is_local(master: str) -> bool:
    """Whether the master runs all tasks in the driver's own process."""
    return master == "local" or master.startswith("local[")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint directory for an intermediate table."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base.rstrip("/"), "rooftop", f"{name}-{uuid.uuid4().hex}")


def materialized(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as a Parquet table in the scratch folder and read it back (lineage is cut)."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear_scratch(spark: SparkSession) -> None:
    """Remove every scratch table of this session; results that still read one must be written first."""
    base = spark._jvm.org.apache.hadoop.fs.Path(os.path.join(ensure_checkpoint_dir(spark).rstrip("/"), "rooftop"))
    base.getFileSystem(spark._jsc.hadoopConfiguration()).delete(base, True)


def cluster_conf(input_bytes: int, partition_bytes: int = 256 << 20) -> dict[str, str]:
    """Settings we use for a large run, sized from the bytes the jobs read.

    Shuffle partitions are an upper bound of ``input_bytes / partition_bytes``
    (AQE coalesces down at run time); scans are split at ``partition_bytes``.
    Skewed joins are split even where that costs another exchange above them.
    Apply them when building the session (``builder.config(k, v)``).
    """
    parts = max(1, -(-int(input_bytes) // int(partition_bytes)))
    return {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(partition_bytes),
        "spark.sql.files.maxPartitionBytes": str(partition_bytes),
        "spark.sql.shuffle.partitions": str(parts),
    }
