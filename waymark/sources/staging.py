"""Cut lineage through Parquet tables in the folder that all executors share.

The folder is the one the session names in ``spark.checkpoint.dir``. Only a local
session without that setting gets a temporary folder of its own.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_folder: str | None = None
_written: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables; raises on a cluster that names none."""
    global _local_folder
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if _local_folder is None:
        _local_folder = tempfile.mkdtemp(prefix="waymark-")
    return f"file://{_local_folder}"


def folder(spark: SparkSession, label: str) -> str:
    """Path of a new folder in the shared one, deleted like a staged table."""
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def stage(df: DataFrame, label: str = "table") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    An executor lost later costs nothing: the files are the only lineage left.
    """
    spark = df.sparkSession
    path = folder(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_staged() -> None:
    """Delete every staged table written so far by this process."""
    while _written:
        spark, path = _written.pop()
        try:
            jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(conf).delete(target, True)
        except Exception:  # the session may be gone at exit
            pass


@atexit.register
def _clean_up() -> None:
    drop_staged()
    if _local_folder is not None:
        import shutil

        shutil.rmtree(_local_folder, ignore_errors=True)
