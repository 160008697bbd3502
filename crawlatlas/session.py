"""Session settings and the shared scratch area that jobs cut lineage through."""

from __future__ import annotations

import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, app: str = "crawlatlas", **conf: str) -> SparkSession:
    """A session with the settings the jobs expect; cluster values win where given."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return configure(builder.getOrCreate())


#: Bytes of an Arrow batch between the JVM and Python. The default counts rows first and lets a batch of
#: long texts grow to 64 MB, which each task then holds several times outside the heap.
BATCH_BYTES = "4m"


def configure(spark: SparkSession) -> SparkSession:
    """Runtime settings that results, or the memory of a task, depend on."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only where a session names none (tests, a laptop) is a local folder made and
    registered, so that a cluster run never falls back to a machine-local path.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    made = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    spark.sparkContext.setCheckpointDir(made)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/crawlatlas/{label}-{uuid.uuid4().hex}"


_WRITTEN: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Cut lineage through a written table, which outlives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    _WRITTEN[table] = path
    return table


def discard(*tables: DataFrame) -> None:
    """Remove tables that ``materialize`` wrote, once all that was to be read from them is written itself."""
    for table in tables:
        path = _WRITTEN.pop(table, None)
        if path is not None:
            remove(table.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    """Remove a folder from whatever file system it is on."""
    location = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    location.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(location, True)
