"""Stage materialisation that survives the loss of executors.

Iterative operators cut their lineage by writing a table below the shared
folder that the cluster names in ``spark.checkpoint.dir``.  A written table is
computed once, is columnar, and can be read again after an executor is lost.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables; a machine-local one only where none is set (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="charterloom-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def materialize(df: DataFrame, tag: str, rows: int = 0) -> DataFrame:
    """Write ``df`` as a table in the shared folder, with at most ``rows`` of them in a file if given, and return a scan of it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/charterloom-{uuid.uuid4().hex}/{tag}"
    if not _written:
        atexit.register(_drop_all, spark)
    _written.add(path)
    df.write.mode("overwrite").option("maxRecordsPerFile", rows).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._charterloom_path = path
    return out


def discard(df: DataFrame | None) -> None:
    """Delete a materialised table that no later plan reads."""
    path = getattr(df, "_charterloom_path", None)
    if path in _written:
        _written.discard(path)
        _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path.rsplit("/", 1)[0])
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _drop_all(spark: SparkSession) -> None:
    try:
        for path in list(_written):
            _delete(spark, path)
    except Exception:  # the session may have ended already
        pass
