"""Keyed state over rows that arrive in any order: state-store buffers with event-time timers, and tables by closed period.

`in_order` keeps the rows of a key in the state store until the watermark has passed them, then folds them in event-time order into the key's carried
state. The store writes changed keys only and is checkpointed in the shared folder. `in_periods` does the same for steps that need a whole
period at a time, such as a ranking: rows wait in a table until their period is closed, and the state is a log of changed keys.

Both wait for stragglers up to a stated lateness. A row later than that would have to change what is already out, so it stops the run with an error instead of being left out.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..session import new_path

# executors need not have this package installed
register_pickle_by_value(sys.modules[__name__])


class Ordered(StatefulProcessor):
    """Rows (at: microseconds, tie, values) of a key, folded in order once the watermark is past them."""

    def __init__(self, row: T.StructType, state: T.StructType, out: T.StructType, fold: Callable):
        self.row, self.state, self.out, self.fold = row, state, out, fold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.carry = handle.getValueState("carry", self.state)
        self.waiting = handle.getListState("waiting", self.row)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        newest = 0
        for some in rows:
            self.waiting.appendList([_plain(r) for r in some[self.row.names].itertuples(index=False, name=None)])
            newest = max(newest, int(some["at"].max()))
        self.handle.registerTimer(newest // 1000 + 1)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed, due, rest = timerValues.getCurrentWatermarkInMs() * 1000, [], []
        for r in self.waiting.get():
            r = tuple(r)
            (due if r[0] <= passed else rest).append(r)
        if rest:
            self.waiting.put(rest)
        else:
            self.waiting.clear()
        state, found = self.carry.get() if self.carry.exists() else None, []
        for r in sorted(due, key=lambda r: r[:2]):
            state, more = self.fold(tuple(key), None if state is None else tuple(state), r)
            found += more
        if due:
            self.carry.update(tuple(state))
        return iter([pd.DataFrame(found, columns=self.out.names)] if found else [])

    def close(self) -> None:
        pass


def _plain(row: tuple) -> tuple:
    """Python values instead of numpy's; missing ones are None."""
    return tuple(None if x is None or x is pd.NaT or x != x else x.item() if hasattr(x, "item") else x for x in row)


def _finished(query) -> None:
    query.awaitTermination()
    late = sum(s.numRowsDroppedByWatermark for p in query.recentProgress for s in p.stateOperators)
    if late:
        raise RuntimeError(f"{late} rows came later than the stated lateness")


def in_order(make_stream: Callable[[], DataFrame], key: str, ts: str, tie: str, values: list[str], lateness: str | None, state: str, out: str, fold: Callable, label: str,
             deliveries: Iterable[Callable[[], None]] = (lambda: None,)) -> DataFrame:
    """Fold the rows of each key in the order of (ts, tie); fold(key, state or None, (at, tie, *values)) -> (state, list of out rows).

    `lateness` is how far behind the newest row a row may be; without it make_stream sets the watermark of ts itself. Each delivery brings files and is followed by one
    run on the same checkpoint. Rows nearer to the newest than `lateness` stay in the store for the next run, so a feed ends with a row far
    ahead, whose key may be null (`heartbeat`).
    """
    base = spark = None
    for deliver in deliveries:
        deliver()
        stream = make_stream()
        spark = stream.sparkSession
        base = base or new_path(spark, label)
        rows = (stream.withWatermark(ts, lateness) if lateness else stream).select(key, ts, F.unix_micros(ts).alias("at"), F.col(tie).alias("tie"), *values)
        row = T.StructType([rows.schema[n] for n in ("at", "tie", *values)])
        schema = _schema(spark, out)
        folded = rows.groupBy(key).transformWithStateInPandas(Ordered(row, _schema(spark, state), schema, fold), schema, "Append", "EventTime")
        run = folded.writeStream.option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).outputMode("append").format("parquet").option("path", f"{base}/out").start()
        _finished(run)
    return spark.read.schema(out).parquet(f"{base}/out")


def _schema(spark: SparkSession, ddl: str) -> T.StructType:
    return spark.createDataFrame([], ddl).schema


def heartbeat(df: DataFrame, ts: str, ahead: str) -> DataFrame:
    """One row of df's columns, all null but ts, which is `ahead` of the newest."""
    newest = df.agg((F.max(ts) + F.expr(f"INTERVAL {ahead}")).alias(ts))
    return newest.select(*[F.col(f.name) if f.name == ts else F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema.fields])


def newest_state(spark: SparkSession, log: str, schema: T.StructType, keys: list[str], steps: int) -> DataFrame:
    """State after so many steps, from the log of changed keys: the last entry of each."""
    if not steps:
        return spark.createDataFrame([], schema)
    logged = spark.read.schema(T.StructType([*schema.fields, T.StructField("gone", T.BooleanType()), T.StructField("step", T.LongType())])).option("basePath", log)
    rows = logged.parquet(*[f"{log}/step={i}" for i in range(steps)])
    ranked = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("step")))).where("_n = 1 AND NOT gone")
    return ranked.select(*schema.names)


def in_periods(make_stream: Callable[[], DataFrame], rows: T.StructType, period: Column, lateness: int, state: T.StructType, keys: list[str], out: T.StructType, label: str,
               step: Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame]], deliveries: Iterable[Callable[[], None]] = (lambda: None,)) -> DataFrame:
    """step(rows of one period, state) -> (state rows of that period's keys, output), period by period in their order, whatever order rows come in.

    `period` numbers the periods; one is closed when a row of a period more than `lateness` later has come, or the feed has ended. Only keys whose state changed, or
    which have none any more, are written. Each delivery is followed by one run on the same checkpoint.
    """
    base, done, spark = None, [], None
    whole = T.StructType([*rows.fields, T.StructField("batch", T.LongType()), T.StructField("period", T.LongType())])

    def close(session: SparkSession, upto: int | None) -> None:
        waiting = session.read.schema(whole).option("basePath", f"{base}/waiting").parquet(f"{base}/waiting")
        there = [r[0] for r in waiting.select("period").distinct().collect()]
        for p in sorted(x for x in there if x not in done and (upto is None or x <= upto)):
            before = newest_state(session, f"{base}/state", state, keys, len(done))
            after, found = step(waiting.where(F.col("period") == p).drop("batch", "period"), before)
            _log(before, after, state, keys).write.mode("overwrite").parquet(f"{base}/state/step={len(done)}")
            found.write.mode("overwrite").parquet(f"{base}/out/step={len(done)}")
            done.append(p)

    def save(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        dealt = batch.withColumn("period", period.cast("long"))
        dealt.write.mode("overwrite").partitionBy("period").parquet(f"{base}/waiting/batch={batch_id}")
        waiting = session.read.schema(whole).option("basePath", f"{base}/waiting").parquet(f"{base}/waiting")
        came = waiting.where(F.col("batch") == batch_id).agg(F.min("period"), F.max("period")).first()
        if came[0] is not None and done and came[0] <= max(done):
            raise RuntimeError(f"rows of period {came[0]} came after it was closed")
        if came[1] is not None:
            close(session, came[1] - lateness - 1)

    for deliver in deliveries:
        deliver()
        stream = make_stream()
        spark = stream.sparkSession
        base = base or new_path(spark, label)
        stream.writeStream.option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).foreachBatch(save).start().awaitTermination()
    close(spark, None)
    return spark.read.schema(T.StructType([*out.fields, T.StructField("step", T.LongType())])).option("basePath", f"{base}/out").parquet(f"{base}/out").drop("step")


def _log(before: DataFrame, after: DataFrame, state: T.StructType, keys: list[str]) -> DataFrame:
    """The keys that are new, changed or gone, with their new state."""
    old = before.select(*[F.col(k).alias(f"_{k}") for k in keys], F.struct(*state.names).alias("_old"))
    j = after.select(*state.names).join(old, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], "full")
    gone = F.coalesce(*[F.col(n).isNotNull().cast("int") for n in keys]) == 0
    now = F.struct(*state.names)
    changed = j.where(~now.eqNullSafe(F.col("_old")))
    return changed.select(*[F.when(gone, F.col(f"_old.{n}")).otherwise(F.col(n)).alias(n) for n in state.names], gone.alias("gone"))
