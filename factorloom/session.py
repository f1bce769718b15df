"""Session hygiene: the SQL settings every plan relies on, and the shared work folder."""

from __future__ import annotations

import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

# AQE splits a skewed shuffle partition at run time, and broadcasts a join side only after
# measuring it; forceOptimizeSkewedJoin keeps the split even when it costs one more exchange.
SQL_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "32MB",
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings above; static and resource settings stay with the cluster."""
    for key, value in SQL_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as named by the cluster.

    Only a local-mode session without that setting falls back to a folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    own = tempfile.mkdtemp(prefix="factorloom-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


_WRITTEN: dict[str, list[str]] = {}


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder for one written table; drop_tables() knows it."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def _files(spark: SparkSession, path: str):
    """Spark's own file system for a path, and the path as it wants it."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def version(spark: SparkSession, folder: str) -> int:
    """Newest change of what lies directly in a folder: a file's own time, or that of a folder of part files."""
    fs, where = _files(spark, folder)
    return max((s.getModificationTime() for s in fs.listStatus(where)), default=0)


def names_below(spark: SparkSession, path: str) -> list[str]:
    """Names directly below a folder; none if it is not there."""
    fs, where = _files(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []


def delete(spark: SparkSession, path: str) -> None:
    fs, where = _files(spark, path)
    fs.delete(where, True)


def put_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small file unless there is one already; its whole content appears at once. Says whether it was written."""
    fs, where = _files(spark, path)
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    aside = jvm.org.apache.hadoop.fs.Path(where.getParent(), f".{where.getName()}.{uuid.uuid4().hex}")
    out = fs.create(aside, False)
    out.write(bytearray(text.encode()))
    out.close()
    try:
        # without options a rename never replaces
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(where.toUri() if where.toUri().getScheme() else fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
        context.rename(aside, where, gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
        return True
    except Py4JJavaError as e:
        if "FileAlreadyExistsException" not in str(e.java_exception.getClass().getName()):
            raise
        fs.delete(aside, False)
        return False


def drop_tables(spark: SparkSession) -> int:
    """Delete every table that this application wrote through new_path, and its catalog entries; returns how many.

    Results that still read them must have been used up.
    """
    paths = _WRITTEN.pop(spark.sparkContext.applicationId, [])
    for t in spark.catalog.listTables():
        if t.name.startswith("factorloom_"):
            spark.sql(f"DROP TABLE IF EXISTS {t.name}")
    for path in paths:
        fs, where = _files(spark, path)
        fs.delete(where, True)
    return len(paths)


def materialize(df, label: str):
    """Cut lineage by writing a table to the shared folder and reading it back."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
