"""Spark session helpers.

The library never creates cluster-specific settings on its own: it reads what the
session already carries (``spark.checkpoint.dir`` in particular) and only fills
gaps when running locally (tests, bench).
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # joins on (symbol, block, row) between frames already hash-partitioned on
    # (symbol, block) need no new shuffle: blocks are bounded, so no skew risk
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Per-(symbol, block) pandas groups are bounded by the block size; keep the
    # Arrow batches moderate so one group never needs one huge buffer.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "65536",
    # Python call-site capture on every Column call triples plan-building time; the
    # library builds hundreds of expressions per query (static: builder only).
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "candleframe") -> SparkSession:
    """Session for tests and the local bench (``local[cores]``)."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for k, v in DEFAULT_CONF.items():
        builder = builder.config(k, v)
    builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = builder.config("spark.driver.memory", os.environ.get("CANDLEFRAME_DRIVER_MEMORY", "16g"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint folder the session names; set a local one only when unset.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and is used as is.
    """
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if conf_dir:
        if not current:
            sc.setCheckpointDir(conf_dir)
        return conf_dir
    if current:
        return current
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    local = tempfile.mkdtemp(prefix="candleframe-ckpt-")
    sc.setCheckpointDir(local)
    return local
