"""Where intermediate tables go: the shared folder that the cluster names."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"
_local_root: str | None = None
#: The folder under the scratch root that this process writes to.
_OWN = f"mendline-{uuid.uuid4().hex}"


def scratch_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only a session whose tasks run in the driver may do without it.

    The folder must be absolute or a URI, as executors may have another working folder.
    """
    global _local_root
    shared = spark.conf.get(CHECKPOINT_DIR, None)
    if shared:
        if not (shared.startswith("/") or ":/" in shared):
            raise ValueError(f"{CHECKPOINT_DIR} must be an absolute path or a URI, not {shared!r}")
        return shared.rstrip("/")
    if not re.fullmatch(r"local(\[[^]]*\])?", spark.conf.get("spark.master", "")):
        raise ValueError(f"{CHECKPOINT_DIR} must name a folder that all executors share")
    if _local_root is None:
        _local_root = tempfile.mkdtemp(prefix="mendline-")
        atexit.register(shutil.rmtree, _local_root, ignore_errors=True)
    return _local_root


def scratch_path(spark: SparkSession, label: str) -> str:
    """A path under the scratch root that nothing has used before."""
    return f"{scratch_root(spark)}/{_OWN}/{label}-{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> None:
    """Delete all that this process has written to the scratch root, and nothing else.

    For the end of a session: DataFrames that queries or syncs returned before may read it.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{scratch_root(spark)}/{_OWN}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialise(df: DataFrame, label: str, spark: SparkSession | None = None) -> DataFrame:
    """Write ``df`` as a scratch table and read it back, in another session if one is given.

    This cuts the lineage, survives the loss of executors, and gives later joins the
    true size of the data, so that Spark broadcasts it only when it is small. Adaptive
    execution chooses the number of files: one for a usual plan, more for a long one.
    """
    spark = spark or df.sparkSession
    path = scratch_path(spark, label)
    df.hint("rebalance").write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
