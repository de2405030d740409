"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings a cluster session should carry. AQE sizes shuffle partitions from the data, splits
# skewed ones and turns measured-small joins into broadcasts. The method limit is the JVM's own:
# longer generated methods are never compiled, so the wide cleaning projections do better split.
CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.files.maxPartitionBytes": "134217728",
}


def local_session(
    cores: str = "*", memory: str = "8g", partitions: int = 8, conf: dict[str, str] | None = None
) -> SparkSession:
    """Session for tests and single-machine runs."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("crashgrid")
    for key, value in (CONF | (conf or {})).items():
        builder = builder.config(key, value)
    return (
        builder.config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it.

    A machine-local folder is used only where the master itself is local.
    """
    configured = (
        spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    )
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
    return tempfile.gettempdir()


def new_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh path under the shared folder; Spark creates it on first write."""
    return f"{shared_folder(spark)}/crashgrid/{purpose}-{uuid.uuid4().hex}"
