"""Session factory and table loader."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def local_session(cores: int = 8, partitions: int | None = None, **conf: str) -> SparkSession:
    """A session for tests and benchmarks; on a cluster the caller brings its own."""
    settings = {
        "spark.sql.shuffle.partitions": str(partitions or cores),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
    } | conf
    builder = SparkSession.builder.master(f"local[{cores}]").appName("quern")
    spark = builder.config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One input table; zone-less timestamps become TIMESTAMP, which watermarks need."""
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    zoneless = [f.name for f in df.schema.fields if isinstance(f.dataType, T.TimestampNTZType)]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in zoneless}) if zoneless else df


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Lets Arrow batches of the session hold at most ``rows`` rows, for queries over long texts,
    whose batches would otherwise take hundreds of megabytes in the JVM and in each Python
    worker. The setting is read when a result is computed, so it stays; a smaller one of the
    caller's is kept."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name, "10000"))
    if now <= 0 or now > rows:
        spark.conf.set(name, rows)


def small_tasks(spark: SparkSession, size: int = 8 << 20) -> None:
    """Lets adaptive execution join shuffle partitions up to ``size`` bytes only, for queries whose
    short rows are compressed to a tenth and less of what they take when sorted or hashed: 64 MB,
    Spark's default, are gigabytes of a task's memory there. As ``small_batches``, the
    setting stays and a smaller one of the caller's is kept."""
    name = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    units = {"": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30, "t": 1 << 40}
    now = spark.conf.get(name, "64m").strip().lower().removesuffix("b")
    number = now.rstrip("kmgt")
    if int(number) * units[now[len(number) :]] > size:
        spark.conf.set(name, str(size))
