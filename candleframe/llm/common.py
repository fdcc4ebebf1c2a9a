"""Helpers shared by the operators: shared scratch folders, code shipping, free column names."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
import zipfile

from pyspark import SparkContext
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SHIPPED: dict[str, str] = {}


def ship(spark: SparkSession) -> None:
    """Send this package's code to the Python workers, once for each application.

    The same as ``--py-files`` on submit; only source files travel, never data.
    """
    sc: SparkContext = spark.sparkContext
    # Batches of texts between the JVM and Python hold so many bytes at once, in each of several buffers.
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")
    if sc.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if root.endswith(".zip") or ".zip/" in root:
        return
    target = os.path.join(tempfile.mkdtemp(prefix="code-"), "llm_code.zip")
    package = os.path.basename(root)
    with zipfile.ZipFile(target, "w") as z:
        z.write(os.path.join(root, "__init__.py"), f"{package}/__init__.py")
        here = os.path.join(root, "llm")
        for name in sorted(os.listdir(here)):
            if name.endswith(".py"):
                z.write(os.path.join(here, name), f"{package}/llm/{name}")
    sc.addPyFile(target)
    _SHIPPED[sc.applicationId] = target


def shared_dir(spark: SparkSession, what: str) -> str:
    """A new folder for intermediate tables under the one that ``spark.checkpoint.dir`` names.

    Only a local session may leave the setting out; it then gets a folder of its own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="llm-shared-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/llm/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read it back: the lineage ends there."""
    path = shared_dir(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of steps that are written and no longer referred to.

    Its cleaner acts when the driver collects garbage, which a small driver heap does often
    and a large one hardly ever; until then the files of finished steps fill the disks.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def free_name(df: DataFrame, base: str) -> str:
    """``base``, with underscores added until no column of ``df`` has that name (in any case)."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The Parquet table at ``path``, or no rows if nothing has been written there yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def distinct_misses(df: DataFrame, digest: str, content: str, known: DataFrame) -> DataFrame:
    """One row for each digest of ``df`` that ``known`` (a column of the same name) lacks.

    Copies meet in the map tasks first (partial aggregation), so a content that fills a third
    of all rows reaches its reducer once for each map task.
    """
    one = df.groupBy(digest).agg(F.first(content).alias(content))
    return one.join(known.select(digest).distinct(), digest, "left_anti")
