"""Registry and small helpers shared by the corpus operators."""

from __future__ import annotations

import io
import re
import string
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import configure, new_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: A table of at most so many bytes (measured, see `sized`) may be broadcast.
BROADCAST_BYTES = 16 << 20
#: Texts are long, so Arrow batches are kept short, and broadcasts below a fraction of what a small driver holds.
SQL_SETTINGS = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "16m",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "16MB",
}


_shipped: set[str] = set()


def store(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of an address; a path without scheme is local or mounted."""
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), re.sub("^file:", "", path))


def prepare(spark: SparkSession) -> SparkSession:
    """Settings, and this package as a zip for the Python workers, once per application.

    Executors need not have the package installed; the zip lies in the shared folder.
    """
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        root, raw = Path(__file__).resolve().parents[1], io.BytesIO()
        with zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent))
        path = f"{new_path(spark, 'package')}.zip"
        fs, at = store(path)
        fs.create_dir(at.rpartition("/")[0], recursive=True)
        with fs.open_output_stream(at) as f:
            f.write(raw.getvalue())
        spark.sparkContext.addPyFile(path)
        _shipped.add(app)
    configure(spark)
    for key, value in SQL_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def query(name: str, sql: str | None = None):
    """Register a function of (spark, folder) under a name, with its statement where SQL can say it."""

    def wrap(fn: Callable[[SparkSession, str], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, folder: fn(prepare(spark), folder)
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def ascii_lower(x) -> Column:
    """Lower-case A-Z only; every other character stays."""
    c = F.col(x) if isinstance(x, str) else x
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def sized(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Mark a written table for broadcast if its counted rows times `row_bytes` stay below the limit.

    Beyond the limit the table comes back unmarked and the join shuffles; both ways give the same rows.
    """
    return F.broadcast(df) if df.count() * row_bytes <= limit else df


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names starting with the given ones that clash with none of df's columns, whatever their case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
