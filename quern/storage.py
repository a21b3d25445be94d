"""Tables written to the folder that the driver and all executors share.

A written table cuts lineage: a lost executor costs a re-read, not a recomputation.
The folder is the session's ``spark.checkpoint.dir``, or the one given to
``setCheckpointDir``. Only a local session without either gets a temporary folder; on a
cluster that would be each machine's own, so there its lack is an error.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """URI or path of the shared folder."""
    given = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if given:
        return given.rstrip("/")
    app, context = spark.sparkContext.applicationId, spark.sparkContext
    if app not in _own and (set_ := context.getCheckpointDir()):
        return set_.rstrip("/")
    if app not in _own:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        _own[app] = tempfile.mkdtemp(prefix="quern-")
        spark.sparkContext.setCheckpointDir(_own[app])
        atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
    return _own[app]


def new_folder(spark: SparkSession, label: str) -> str:
    """A path below the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/quern/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str, codec: str = "zstd") -> DataFrame:
    """``df`` written once to the shared folder and read back."""
    path = new_folder(df.sparkSession, label)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder of any file system that Spark knows."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def clear(spark: SparkSession) -> None:
    """Remove all tables that this application wrote to the shared folder.

    Results read them when they are computed: call this after their last use."""
    delete(spark, f"{shared_dir(spark)}/quern/{spark.sparkContext.applicationId}")
