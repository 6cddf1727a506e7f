"""Spark session and shared-folder helpers.

Every job in this package is a lazy DataFrame plan; the only state written
outside a sink is the lineage cut of iterative operators and the file sinks of
the streaming/round-trip operators. Those always live under the cluster's
shared ``spark.checkpoint.dir``. A private folder is created only when the
setting is unset *and* the master is local (tests, laptops).
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Fixed configuration for scale: AQE re-plans shuffles at runtime, coalesces
# small partitions and splits skewed join partitions (a hot word or a hot
# shard is split across tasks instead of landing in one).
SCALE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.files.maxPartitionBytes": "128m",
    "spark.sql.session.timeZone": "UTC",
}


def build_session(master: str = "local[*]", shuffle_partitions: int = 8,
                  app_name: str = "wordmine", extra: dict | None = None) -> SparkSession:
    builder = (SparkSession.builder.master(master).appName(app_name)
               .config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false")
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
               .config("spark.driver.memory", "8g"))
    for k, v in {**SCALE_CONF, **(extra or {})}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Read from the session; set only where unset and the master is local.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if current:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(current)
        return current.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    path = tempfile.mkdtemp(prefix="wordmine-ckpt-")
    sc.setCheckpointDir(path)
    return path


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new, unused folder below the shared folder (one per run)."""
    base = shared_dir(spark)
    if base.startswith("file:"):
        base = base[len("file:"):]
    return os.path.join(base, f"{name}-{uuid.uuid4().hex[:12]}")


def materialise(df, name: str = "table"):
    """Write ``df`` once as Parquet under the shared folder and read it back.

    Used where a table is complete and read several times (the extraction
    table, the audited rows, lexicons): everything after it reads the written
    files instead of re-running the upstream plan, the lineage is cut, and a
    lost executor re-reads files instead of recomputing. One job computes
    ``df`` (an eager ``checkpoint()`` would compute it twice unless cached).
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
