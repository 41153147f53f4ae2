"""Tables that end a lineage: written to the folder that driver and executors share, so that they survive lost executors."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, a temporary folder, if all runs in one local process; on a cluster there is none to take."""
    sc = spark.sparkContext
    at = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not at:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="tallyloom-")
        sc.setCheckpointDir(at)
    return at


def new_path(spark: SparkSession) -> str:
    """A path in the shared folder where nothing is yet; what is there at exit is deleted."""
    path = f"{shared_folder(spark)}/tallyloom/{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def written(df: DataFrame) -> DataFrame:
    """df as Parquet in the shared folder, read back. It is deleted at exit."""
    spark = df.sparkSession
    path = new_path(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@atexit.register
def _delete() -> None:
    for spark, path in _written:
        try:
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001  the session is gone; the folder's owner cleans up
            return
