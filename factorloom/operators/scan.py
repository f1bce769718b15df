"""Ordered passes along keys of any length: previous row, newest known value, running total.

A window over one key sorts that key in one task, which a key with a third of all rows does not stand. Here rows are dealt out by range of
(keys, order), so a long key simply covers several parts. Each part is scanned by itself; a border table holds one row per key and part with what
the part leaves behind, and a pass over these rows says what is carried into a part. As parts are ranges of (keys, order), only the first key of a part
can have begun before it: the carried table has at most one row per part, and is broadcast. Parts are written once, so a recomputed task
sees the same ones.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.common import col
from ..session import materialize

#: Rows of one part.
PART_ROWS = 1_000_000
PART = "_part"


class Scan:
    """Rows in the order of `order` within `keys`; each method adds a column, `rows` has them all and PART.

    Null keys are a key of their own. Order columns should tell the rows of a key apart: rows that are equal there come in any order, but always together.
    """

    def __init__(self, df: DataFrame, keys: list[str], order: list[str], part_rows: int = PART_ROWS):
        parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(df.count() / part_rows))
        dealt = df.repartitionByRange(parts, *keys, *order).withColumn(PART, F.spark_partition_id())
        self.keys, self.order, self.rows = keys, order, materialize(dealt, "scan-parts")
        self.here = Window.partitionBy(*keys, PART).orderBy(*order)
        self.at = F.struct(*order)

    def _add(self, name: str, inside: Column, left: Column, carry: Callable, both: Callable) -> Scan:
        along = Window.partitionBy(*self.keys).orderBy(PART)
        ends = self.rows.groupBy(*self.keys, PART).agg(left.alias("_left"))
        carried = ends.select(*[F.col(k).alias(f"_on_{k}") for k in [*self.keys, PART]], carry(F.col("_left"), along).alias("_carried")).where("_carried IS NOT NULL")
        on = [F.col(k).eqNullSafe(F.col(f"_on_{k}")) for k in [*self.keys, PART]]
        j = self.rows.withColumn("_inside", inside).join(F.broadcast(carried), on, "left")
        self.rows = j.withColumn(name, both(F.col("_inside"), F.col("_carried"))).drop("_inside", "_carried", *[f"_on_{k}" for k in [*self.keys, PART]])
        return self

    def previous(self, value, name: str) -> Scan:
        """The value of the row before, null for the first row of a key."""
        v = F.struct(col(value).alias("x"))
        return self._add(name, F.lag(v).over(self.here), F.max_by(v, self.at), lambda x, w: F.lag(x).over(w), lambda a, b: F.coalesce(a, b)["x"])

    def latest(self, value, name: str) -> Scan:
        """The newest value that is not null, up to and with this row."""
        v = F.when(col(value).isNotNull(), F.struct(col(value).alias("x")))
        sofar = self.here.rowsBetween(Window.unboundedPreceding, 0)
        return self._add(
            name, F.last(v, ignorenulls=True).over(sofar), F.max_by(v, F.when(v.isNotNull(), self.at)),
            lambda x, w: F.last(x, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)), lambda a, b: F.coalesce(a, b)["x"])

    def total(self, value, name: str) -> Scan:
        """Sum of the values up to and with this row; null counts as 0."""
        v = F.coalesce(col(value), F.lit(0))
        sofar = self.here.rowsBetween(Window.unboundedPreceding, 0)
        return self._add(name, F.sum(v).over(sofar), F.sum(v), lambda x, w: F.sum(x).over(w.rowsBetween(Window.unboundedPreceding, -1)), lambda a, b: a + F.coalesce(b, F.lit(0)))

    def done(self) -> DataFrame:
        return self.rows.drop(PART)


def asof_scan(left: DataFrame, right: DataFrame, key: str, left_ts: str, right_ts: str, values: list[str], tie: str | None = None) -> DataFrame:
    """Every row of left with the values and time of the newest right row of its key at or before its time stamp.

    Time stamps may be of any grain and a key of any length. Of right rows of one instant the one with the largest `tie` counts. Names of right's columns
    must not be those of left's. Left rows with a null time find nothing.
    """
    found = F.struct(F.col(right_ts), *values)
    least = F.lit(None).cast(right.schema[tie].dataType if tie else "int")
    probes = left.select(F.col(key), F.col(left_ts).alias("_ts"), F.lit(1).alias("_side"), least.alias("_tie"), F.struct(*left.columns).alias("_row"))
    facts = right.where(F.col(right_ts).isNotNull()).select(F.col(key), F.col(right_ts).alias("_ts"), F.lit(0).alias("_side"), (F.col(tie) if tie else least).alias("_tie"), found.alias("_fact"))
    both = probes.unionByName(facts, allowMissingColumns=True)
    hit = Scan(both, [key], ["_ts", "_side", "_tie"]).latest("_fact", "_hit").done().where("_side = 1")
    return hit.select("_row.*", *[F.col(f"_hit.{n}").alias(n) for n in [right_ts, *values]])


def nth_after(anchors: DataFrame, ticks: DataFrame, offsets: list[int], key: str, anchor: str, ts: str, tie: str, value: str) -> DataFrame:
    """Value of the k-th tick after the first one at or after each anchor, for each k; missing past a key's last tick.

    Ticks are numbered by running counts, and an anchor's first tick is one more than the ticks before it, so no key is ever sorted in one task.
    """
    facts = ticks.select(F.col(key), F.col(ts).alias("_ts"), F.lit(1).alias("_side"), F.col(tie).alias("_tie"), F.col(value).alias("_v"))
    probes = anchors.select(F.col(key), F.col(anchor).alias("_ts"), F.lit(0).alias("_side")).distinct()
    s = Scan(facts.unionByName(probes, allowMissingColumns=True), [key], ["_ts", "_side", "_tie"]).total("_side", "_no").done()
    first = s.where("_side = 0").select(key, F.col("_ts").alias(anchor), (F.col("_no") + 1).alias("_first"))
    numbered = s.where("_side = 1").select(F.col(key).alias("_k"), F.col("_no").alias("_n"), F.col("_v").alias(value))
    wanted = anchors.join(first, [key, anchor]).withColumn("k", F.explode(F.array(*map(F.lit, offsets)))).withColumn("_at", F.col("_first") + F.col("k"))
    return wanted.join(numbered, (F.col(key) == F.col("_k")) & (F.col("_at") == F.col("_n")), "left").drop("_first", "_at", "_k", "_n")
