"""Sinks: dated snapshots, append logs, ledgers, reports, explain records."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import delete, names_below, put_if_absent


def write_snapshot(df: DataFrame, path: str, day: str = "snapshot_date") -> list[str]:
    """Dated snapshots of which the first write of a date stays; returns the dates that this call committed.

    All rows are written aside first, a folder per run and date. A date then becomes visible by one small file that names its run and is put in place only if
    there is none yet, in one step of the file system; `readers.committed` reads what such files name. So a date is never replaced or mixed, two writers at
    once leave one of their versions, and a write that was killed leaves nothing to see. The driver handles dates, never rows.
    """
    spark, run = df.sparkSession, uuid.uuid4().hex
    parts = f"{path}/parts/run={run}"
    # dealt by date, where Spark splits a large date and puts small ones together
    df.hint("rebalance", day).write.partitionBy(day).parquet(parts)
    won = []
    for folder in sorted(x for x in names_below(spark, parts) if x.startswith(f"{day}=")):
        if put_if_absent(spark, f"{path}/commits/{folder}", run):
            won.append(folder.partition("=")[2])
        else:
            delete(spark, f"{parts}/{folder}")
    return won


#: Filings in one XML file; a reader takes such a file whole, in one task.
FILE_FILINGS = 20_000


def write_filings_xml(df: DataFrame, path: str, per_file: int = FILE_FILINGS) -> None:
    """Ownership filings as XML, in files of at most `per_file`: a task that writes more begins further files."""
    df.write.format("xml").option("rootTag", "filings").option("rowTag", "filing").option("maxRecordsPerFile", per_file).save(path)


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_ledger(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").option("header", True).csv(path)


def write_report(df: DataFrame, path: str) -> None:
    """One JSON document per row, nested as built."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("errorifexists").text(path)


def contribution_map(factors: dict[str, float]) -> Column:
    """factor -> weight x score for the factors present."""
    pairs = F.array(*[F.struct(F.lit(f).alias("key"), (F.col(f) * w).alias("value")) for f, w in factors.items()])
    return F.map_from_entries(F.filter(pairs, lambda p: p["value"].isNotNull()))


def write_explain(df: DataFrame, factors: dict[str, float], path: str) -> None:
    """Explain records keyed by ticker."""
    df.select("ticker", "final_score", contribution_map(factors).alias("contributions")).write.mode("errorifexists").parquet(path)
