"""Input views over the driver tables: universes, bars, transactions, statements, articles.

Every per-key view is pre-aggregated to (key, period) before any window runs on it, so the window
of one key holds at most one row per calendar period however many raw rows that key has.
Money is summed in whole cents and quantities in whole units, which keeps sums exact.
"""

from __future__ import annotations

import datetime as dt
import math
from functools import cached_property, reduce
from operator import add

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .config import WEIGHTS
from .functions import consensus, fundamentals, ownership, price, regime, text
from .functions.common import r6, ratio, unit
from .operators import ts
from .session import configure, new_path, version

AS_OF = dt.date(2001, 11, 5)
NEWS_AS_OF = dt.date(2024, 1, 31)
US_FACTORS = tuple(WEIGHTS["US"])
SNAP_FACTORS = ("mom", "vz", "rev", "val")
_STORED: dict = {}

_S = {"l": T.LongType(), "i": T.IntegerType(), "d": T.DoubleType(), "s": T.StringType(), "t": T.TimestampType()}


def _schema(spec: str) -> T.StructType:
    return T.StructType([T.StructField(n, _S[k]) for n, k in (f.split(":") for f in spec.split())])


SCHEMAS = {
    "region": _schema("r_regionkey:i r_name:s"),
    "nation": _schema("n_nationkey:i n_name:s n_regionkey:i"),
    "supplier": _schema("s_suppkey:l s_name:s s_nationkey:i s_acctbal:d"),
    "customer": _schema("c_custkey:l c_name:s c_nationkey:i c_acctbal:d c_mktsegment:s"),
    "part": _schema("p_partkey:l p_name:s p_brand:s p_type:s p_size:i p_retailprice:d"),
    "orders": _schema("o_orderkey:l o_custkey:l o_orderstatus:s o_totalprice:d o_orderdate:t o_orderpriority:s"),
    "lineitem": _schema(
        "l_orderkey:l l_partkey:l l_suppkey:l l_linenumber:i l_quantity:d l_extendedprice:d l_discount:d "
        "l_tax:d l_returnflag:s l_linestatus:s l_shipdate:t"
    ),
    "events": _schema("event_id:l ts:t user_id:l event_type:s value:d props:s"),
    "documents": _schema("doc_id:l text:s lang:s source:s n_chars:l"),
    "conversations": _schema("conv_id:l turn:l role:s text:s"),
}


def cents(x) -> Column:
    return F.round(F.col(x) * 100).cast("long")


def days_before(as_of: dt.date, when) -> Column:
    return F.datediff(F.lit(as_of), F.to_date(F.col(when)))


def midnight(as_of: dt.date, days: int) -> dt.datetime:
    """Start of the day `days` before as_of."""
    return dt.datetime.combine(as_of - dt.timedelta(days=days), dt.time())


def count_when(cond) -> Column:
    return F.sum(F.when(cond, 1).otherwise(0)).cast("long")


def sum_when(cond, value) -> Column:
    return F.coalesce(F.sum(F.when(cond, value)), F.lit(0).cast("long"))


class Tables:
    """Lazy access to the parquet tables of one folder and the views derived from them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = configure(spark)
        self.folder = folder

    def table(self, name: str) -> DataFrame:
        reader = self.spark.read
        if name in SCHEMAS:
            reader = reader.schema(SCHEMAS[name])
        return reader.parquet(f"{self.folder}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name in SCHEMAS:
            return self.table(name)
        raise AttributeError(name)

    # --- universes ---------------------------------------------------------------------

    @cached_property
    def universe(self) -> DataFrame:
        """One row per supplier: sid, ticker, market, sector, cap_tier, market_cap."""
        where = self.nation.join(self.region, F.col("n_regionkey") == F.col("r_regionkey")).select(
            "n_nationkey",
            F.when(F.col("r_name").isin("AMERICA", "AFRICA"), "USA")
            .when(F.col("r_name") == "EUROPE", "EUROPE").otherwise("ASIA").alias("market"),
        )
        k = F.col("n_nationkey") % 3
        suffix = (
            F.when(F.col("market") == "EUROPE", F.element_at(F.array(*map(F.lit, (".PA", ".DE", ".L"))), k + 1))
            .when(F.col("market") == "ASIA", F.element_at(F.array(*map(F.lit, (".T", ".HK", ".KS"))), k + 1))
            .otherwise("")
        )
        sectors = F.array(*map(F.lit, ("Technology", "Energy", "Healthcare", "Utilities")))
        cap = (F.col("s_acctbal") + 1000.0) * 2000000.0
        return self.supplier.join(where, F.col("s_nationkey") == F.col("n_nationkey")).select(
            F.col("s_suppkey").alias("sid"),
            F.concat(F.lit("S"), F.col("s_suppkey").cast("string"), suffix).alias("ticker"),
            "market",
            F.element_at(sectors, (F.col("s_suppkey") % 4 + 1).cast("int")).alias("sector"),
            regime.cap_tier(cap).alias("cap_tier"),
            cap.alias("market_cap"),
        )

    @cached_property
    def parts(self) -> DataFrame:
        """One row per part: pid, ticker, market, region, sector, cap_tier, market_cap."""
        m = F.col("p_partkey") % 3
        size = F.col("p_size")
        return self.part.select(
            F.col("p_partkey").alias("pid"),
            F.concat(
                F.lit("P"), F.col("p_partkey").cast("string"), F.when(m == 0, "").when(m == 1, ".PA").otherwise(".T")
            ).alias("ticker"),
            F.when(m == 0, "USA").when(m == 1, "EUROPE").otherwise("ASIA").alias("market"),
            F.when(m == 0, "US").when(m == 1, "EU").otherwise("ASIA").alias("region"),
            F.col("p_type").alias("sector"),
            F.when(size >= 35, "large").when(size >= 15, "mid").otherwise("small").alias("cap_tier"),
            (F.col("p_retailprice") * size * 250000.0).alias("market_cap"),
        )

    # --- bars --------------------------------------------------------------------------

    @cached_property
    def bars(self) -> DataFrame:
        """The bars table: written once, bucketed and sorted by name, so that every window over a
        name's bars and every join on the name starts without a shuffle."""
        return self.stored("bars", lambda: self.bars_plan, bucket="sid", order="d", source=self.lineitem)

    @cached_property
    def bars_plan(self) -> DataFrame:
        """Monthly bars per supplier: sid, d, close (volume-weighted), high, low, volume, cents traded."""
        unit_price = F.col("l_extendedprice") / F.col("l_quantity")
        return (
            self.lineitem.groupBy(
                F.col("l_suppkey").alias("sid"), F.to_date(F.date_trunc("month", "l_shipdate")).alias("d")
            )
            .agg(
                F.sum(cents("l_extendedprice")).alias("c"),
                F.sum(F.col("l_quantity").cast("long")).alias("volume"),
                F.max(unit_price).alias("high"),
                F.min(unit_price).alias("low"),
            )
            .select("sid", "d", (F.col("c") / F.col("volume") / 100.0).alias("close"), "high", "low", "volume", F.col("c").alias("traded_c"))
        )

    @cached_property
    def bench_bars(self) -> DataFrame:
        """Monthly bars of the whole market: d, bench (volume-weighted price of all suppliers)."""
        total = self.bars.groupBy("d").agg(F.sum("traded_c").alias("c"), F.sum("volume").alias("q"))
        return total.select("d", (F.col("c") / F.col("q") / 100.0).alias("bench"))

    @cached_property
    def daily_bars(self) -> DataFrame:
        """Daily bars per user: uid, d, close (mean value), volume (events)."""
        return (
            self.events.groupBy(F.col("user_id").alias("uid"), F.to_date("ts").alias("d"))
            .agg(F.sum(cents("value")).alias("c"), F.count(F.lit(1)).alias("volume"))
            .select("uid", "d", (F.col("c") / F.col("volume") / 100.0).alias("close"), "volume")
        )

    # --- transactions, filings, estimates ------------------------------------------------

    @property
    def insider_tx(self) -> DataFrame:
        return self.insider_rows()

    def insider_rows(self, max_age: int | None = None, code: str | None = None) -> DataFrame:
        """Insider transactions: pid, insider_id, code P/S/O, shares, value_c, d, age, is_ceo.

        Age and side are filtered on the raw columns, so they reach the scan.
        """
        rows = self.lineitem
        if max_age is not None:
            rows = rows.where(F.col("l_shipdate") >= F.lit(midnight(AS_OF, max_age)))
        if code is not None:
            rows = rows.where(F.col("l_returnflag") == {"P": "A", "S": "R"}[code])
        return rows.select(
            F.col("l_partkey").alias("pid"),
            F.col("l_suppkey").alias("insider_id"),
            F.when(F.col("l_returnflag") == "A", "P").when(F.col("l_returnflag") == "R", "S").otherwise("O").alias("code"),
            F.col("l_quantity").cast("long").alias("shares"),
            cents("l_extendedprice").alias("value_c"),
            F.to_date("l_shipdate").alias("d"),
            days_before(AS_OF, "l_shipdate").alias("age"),
            (F.col("l_linenumber") == 1).alias("is_ceo"),
        )

    @property
    def congress_tx(self) -> DataFrame:
        return self.congress_rows()

    def congress_rows(self, max_age: int | None = None) -> DataFrame:
        """Politicians' trades: cid, ticker, member, type, d, age."""
        status = F.col("o_orderstatus")
        rows = self.orders
        if max_age is not None:
            rows = rows.where(F.col("o_orderdate") >= F.lit(midnight(AS_OF, max_age)))
        return rows.select(
            F.col("o_custkey").alias("cid"),
            F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("ticker"),
            (F.col("o_orderkey") % 50).alias("member"),
            F.when(status == "F", "Purchase").when(status == "O", "Sale (Full)").otherwise("Exchange").alias("type"),
            F.to_date("o_orderdate").alias("d"),
            days_before(AS_OF, "o_orderdate").alias("age"),
        )

    @cached_property
    def statements(self) -> DataFrame:
        """Quarterly statements per market segment: ticker, d (quarter end), filing_date, revenue, op_income, assets."""
        q = F.date_trunc("quarter", "o_orderdate")
        return (
            self.orders.join(self.customer, F.col("o_custkey") == F.col("c_custkey"))
            .groupBy(F.col("c_mktsegment").alias("ticker"), F.to_date(q).alias("qs"), (F.col("o_orderkey") % 4).alias("slice"))
            .agg(
                F.sum(cents("o_totalprice")).alias("c"),
                F.sum(F.when(F.col("o_orderstatus") == "F", cents("o_totalprice")).otherwise(0)).alias("f"),
                F.count(F.lit(1)).alias("n"),
            )
            .groupBy("ticker", "qs")
            .agg(F.sum("c").alias("c"), F.sum("f").alias("f"), F.sum("n").alias("n"))
            .select(
                "ticker",
                F.date_sub(F.to_date(F.add_months("qs", 3)), 1).alias("d"),
                F.date_add(F.to_date(F.add_months("qs", 3)), 40).alias("filing_date"),
                (F.col("c") / 100.0).alias("revenue"),
                (F.col("f") / 100.0).alias("op_income"),
                F.col("n"),
            )
        )

    @cached_property
    def estimates(self) -> DataFrame:
        """Yearly estimates per part: pid, yr, est, n."""
        return (
            self.lineitem.groupBy(F.col("l_partkey").alias("pid"), F.year("l_shipdate").alias("yr"))
            .agg(
                F.sum(cents("l_extendedprice")).alias("c"), F.sum(F.col("l_quantity").cast("long")).alias("q"),
                F.count(F.lit(1)).alias("n"),
            )
            .select("pid", "yr", (F.col("c") / F.col("q") / 100.0).alias("est"), "n")
        )

    @cached_property
    def articles(self) -> DataFrame:
        """Articles: uid, sentiment, d, age (days before the news date)."""
        kind = F.col("event_type")
        return self.events.select(
            F.col("user_id").alias("uid"),
            F.when(kind.isin("purchase", "signup"), "Positive").when(kind == "error", "Negative").otherwise("Neutral").alias("sentiment"),
            F.to_date("ts").alias("d"),
            days_before(NEWS_AS_OF, "ts").alias("age"),
        )

    # --- scored universe -----------------------------------------------------------------

    @cached_property
    def part_stats(self) -> DataFrame:
        """All per-part aggregates: one grouped sum by part, which combines map-side however hot a part is.

        Distinct traders come from a narrow second pass over one year: the distinct (part, trader, side), then counts.
        """
        flag, age, line = F.col("l_returnflag"), F.col("age"), F.col("l_linenumber")
        c, q = F.col("c"), F.col("q")
        buy, sell, pid = flag == "A", flag == "R", F.col("l_partkey").alias("pid")
        src = self.lineitem.select(
            "l_partkey", "l_suppkey", "l_returnflag", "l_linenumber",
            cents("l_extendedprice").alias("c"), F.col("l_quantity").cast("long").alias("q"),
            F.round(F.col("l_discount") * 100).cast("long").alias("disc"),
            F.round(F.col("l_tax") * 100).cast("long").alias("tax"),
            days_before(AS_OF, "l_shipdate").alias("age"),
            (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit_price"),
        )
        year1, year0 = age <= 365, (age > 365) & (age <= 730)
        sums = {
            "n_lines": F.count(F.lit(1)), "q_all": F.sum(q), "c_all": F.sum(c), "disc": F.sum("disc"), "tax": F.sum("tax"),
            "q_1y": sum_when(year1, q), "c_1y": sum_when(year1, c), "n_1y": count_when(year1),
            "q_0y": sum_when(year0, q), "c_0y": sum_when(year0, c), "n_0y": count_when(year0),
            "q_4y": sum_when((age > 365) & (age <= 1826), q),
            "buy30": count_when(buy & (age <= 30)), "buy180": count_when(buy & (age > 30) & (age <= 180)),
            "buy_c": sum_when(buy & (age <= 180), c), "ceo_c": sum_when(buy & (age <= 180) & (line == 1), c),
            "n_a": count_when(buy), "n_r": count_when(sell), "n_n": count_when(flag == "N"),
            "r1": count_when(line == 1), "r2": count_when(line == 2), "r3": count_when(line.isin(3, 4)),
            "r4": count_when(line.isin(5, 6)), "r5": count_when(line == 7),
            "buys_1y": count_when(buy & year1), "sells_1y": count_when(sell & year1),
        }
        total = src.groupBy(pid).agg(
            *[e.alias(k) for k, e in sums.items()],
            F.min(F.when(buy & year1, age)).alias("buy_age"),
            F.max("unit_price").alias("px_high"), F.min("unit_price").alias("px_low"),
        )
        since = F.col("l_shipdate") >= F.lit(midnight(AS_OF, 365))
        traders = self.lineitem.where(since & flag.isin("A", "R")).select(pid, "l_suppkey", "l_returnflag").distinct()
        both = traders.groupBy("pid").agg(count_when(buy).alias("buyers"), count_when(sell).alias("sellers"))
        zero = F.lit(0).cast("long")
        return total.join(both, "pid", "left").withColumns({"buyers": F.coalesce("buyers", zero), "sellers": F.coalesce("sellers", zero)})

    @cached_property
    def news_by_part(self) -> DataFrame:
        """Article counts and decayed sentiment sums per ticker id."""
        w = F.exp(-F.col("age") * F.log(F.lit(2.0)) / 5.0)
        v = F.when(F.col("sentiment") == "Positive", 1.0).when(F.col("sentiment") == "Negative", -1.0).otherwise(0.0)
        return (
            self.articles.groupBy(F.col("uid").alias("pid"), "age", "sentiment").agg(F.count(F.lit(1)).alias("k"))
            .groupBy("pid").agg(
                F.sum(v * w * F.col("k")).alias("vw"), F.sum(w * F.col("k")).alias("ww"),
                F.sum(F.when(F.col("age") <= 7, F.col("k")).otherwise(0)).alias("n_recent"),
                F.sum("k").alias("n_articles"),
                F.max(F.when(F.col("sentiment") != "Neutral", 1).otherwise(0)).alias("directional"),
            )
        )

    @cached_property
    def gathered(self) -> DataFrame:
        """Wide factor rows per part: the left-join gather of all inputs, then pure expressions."""
        wide = (
            self.parts.join(self.part_stats, "pid", "left").join(self.news_by_part, "pid", "left")
        )
        us = F.col("market") == "USA"
        px = F.col("c_all") / F.col("q_all") / 100.0
        px1 = ratio("c_1y", "q_1y") / 100.0
        px0 = ratio("c_0y", "q_0y") / 100.0
        wide = wide.withColumns({
            "px": px, "px1": px1, "px0": px0,
            "mom_ret": ratio(px1, px0) - 1.0,
            "volume_spike": ratio(F.col("q_1y") * 4.0, "q_4y"),
            "npm": F.col("tax") / F.col("n_lines") / 100.0 - 0.02,
            "gpm": 0.2 + F.col("disc") / F.col("n_lines") / 100.0 * 2.5,
            "opm": (F.col("tax") - F.col("disc")) / F.col("n_lines") / 100.0,
            "de": ratio("n_r", "n_a") - 0.4,
            "cr": ratio("n_n", "n_r") + 0.5,
            "turnover": ratio("q_1y", "q_0y"),
            "sent_raw": F.when(F.col("directional") == 1, (ratio("vw", "ww") + 1.0) / 2.0).when(F.col("directional") == 0, 0.0),
        })
        return wide.withColumn(
            "quality_raw",
            F.when(F.col("n_lines").isNotNull(), fundamentals.quality_points(None_(), "opm", "de", "cr", "gpm", "npm", "turnover")),
        ).withColumns({
            "insider_conviction": ownership.conviction(F.col("buy_c") / 100.0, "market_cap", "buy_age", F.col("ceo_c") / 100.0),
            "insider_breadth": ownership.breadth("buyers", "sellers", "buy_age"),
            "congress": F.when(us, ownership.congress("buys_1y", "sells_1y", "buy_age")),
            "news_sentiment": F.col("sent_raw"),
            "news_buzz": F.when(F.col("n_articles").isNotNull(), text.buzz("n_recent")),
            "momentum_long": price.momentum("mom_ret"),
            "volume_attention": price.volume_attention("volume_spike"),
            "analyst_consensus": F.when(F.col("n_lines").isNotNull(), consensus.consensus_score(F.lit(None).cast("string"), ["r1", "r2", "r3", "r4", "r5"])),
            "quality_piotroski": fundamentals.quality_score("quality_raw"),
            "transcript_tone": F.when(us, text.tone("n_a", "n_r", "n_n")),
            "revenue_revision": consensus.revenue_revision("px1", "px0", "n_1y"),
            "inst_flow_13f": F.when(
                us, ownership.flow_13f("n_lines", F.col("n_1y") - F.col("n_0y"), "buys_1y", "sells_1y", (F.col("n_1y") - F.col("n_0y")) / 2.0)
            ),
        })

    def stored(self, label: str, build, bucket: str | None = None, order: str | None = None,
               source: DataFrame | None = None) -> DataFrame:
        """A view written once per session, folder and version of it to the shared folder, then read as a table.

        Scoring and ranking are separate steps: the second reads the first one's table, so a
        many-pass ranking never repeats the scan of the raw tables, and a lost executor costs a
        re-read instead of a recomputation. With `bucket` the table is bucketed on that key, into as
        many buckets as there are cores, or one per 32 million source rows where that is more.
        """
        key = (self.spark.sparkContext.applicationId, self.folder, version(self.spark, self.folder), label)
        if key not in _STORED:
            df, path = build(), new_path(self.spark, label)
            if bucket is None:
                df.write.parquet(path)
                _STORED[key] = (path, df.schema)
            else:
                n = max(self.spark.sparkContext.defaultParallelism, math.ceil(source.count() / 32e6))
                table = "factorloom_" + path.rsplit("/", 1)[-1].replace("-", "_")
                sorted_rows = df.repartition(n, bucket).sortWithinPartitions(bucket, order)
                sorted_rows.write.bucketBy(n, bucket).sortBy(bucket, order).option("path", path).format("parquet").saveAsTable(table)
                _STORED[key] = (table, None)
        where, schema = _STORED[key]
        return self.spark.table(where) if schema is None else self.spark.read.schema(schema).parquet(where)

    @cached_property
    def entries(self) -> DataFrame:
        return self.stored("entries", lambda: self.entries_plan)

    @cached_property
    def scored(self) -> DataFrame:
        return self.entries

    @cached_property
    def entries_plan(self) -> DataFrame:
        """Ranked-list entries: gathered rows with final_score, badge and the display inputs."""
        w = WEIGHTS["US"]
        present = reduce(add, [F.when(F.col(f).isNotNull(), v).otherwise(0.0) for f, v in w.items()])
        total = reduce(add, [F.coalesce(F.col(f), F.lit(0.0)) * v for f, v in w.items()])
        score = F.coalesce(r6(F.try_divide(total, present) * 1.25), F.lit(0.0))
        return self.gathered.withColumn("final_score", F.least(F.lit(1.0), score)).withColumns({
            "badge": regime.badge("final_score"),
            "pipeline": F.when(F.col("market") == "USA", "US").otherwise("INTL"),
            "coverage": present,
            "target_price": F.col("px1"),
            "return_5d": F.col("mom_ret") / 2.0,
            "return_21d": F.col("mom_ret"),
            "surprise_pct": ratio(F.col("n_1y") - F.col("n_0y"), F.col("n_0y")),
            "surprise_days": F.col("buy_age"),
            "npr_spike": ratio("buys_1y", F.col("buys_1y") + F.col("sells_1y")) - ratio("n_a", F.col("n_a") + F.col("n_r")),
            "beta": ratio("q_1y", "q_0y"),
            "atr": (F.col("px_high") - F.col("px_low")) / 20.0,
            "rsi": 100.0 * ratio("n_a", F.col("n_a") + F.col("n_r")),
            "vwap_ratio": ratio("px1", "px"),
            "adv_usd": F.col("c_1y") / 100.0,
        })

    @cached_property
    def long_scores(self) -> DataFrame:
        """(pid, ticker, market, sector, cap_tier, factor, score): one row per ticker and US factor."""
        return unpivot_scores(self.scored)

    # --- snapshots -----------------------------------------------------------------------

    @cached_property
    def snaps(self) -> DataFrame:
        return self.stored("snaps", lambda: self.snaps_plan)

    @cached_property
    def snaps_plan(self) -> DataFrame:
        """Monthly snapshots per supplier: point-in-time factors, a score and the 3-bar forward label."""
        w = ts.by_key()
        lag = lambda c, n: F.lag(c, n).over(w)
        rows = ts.volume_zscore(ts.with_bench(self.bars, self.bench_bars), 20).withColumns({
            "mom": ts.change(lag("close", 1), lag("close", 12)) - ts.change(lag("bench", 1), lag("bench", 12)),
            "rev": -ts.change("close", lag("close", 1)),
            "val": ratio("bench", "close"),
            "fwd": ts.change(F.lead("close", 3).over(w), "close"),
            "bench_fwd": ts.change(F.lead("bench", 3).over(w), "bench"),
        }).withColumnRenamed("volume_z", "vz").where("mom IS NOT NULL")
        score = (
            0.5 * price.momentum("mom") + 0.3 * unit((F.coalesce("vz", F.lit(0.0)) + 3.0) / 6.0) + 0.2 * unit(F.col("val") / 2.0)
        )
        u = self.universe.select("sid", "ticker", "market", "sector", "cap_tier")
        return rows.withColumn("score", F.round(score, 6)).join(u, "sid").select(
            "sid", "ticker", "d", "market", "sector", "cap_tier", *SNAP_FACTORS, "score", "fwd", "bench_fwd",
            (F.col("fwd") - F.col("bench_fwd")).alias("fwd_x"),
        )

    @cached_property
    def snaps_long(self) -> DataFrame:
        ids = ["sid", "d", "market", "fwd_x"]
        return self.snaps.select(*ids, *SNAP_FACTORS).unpivot(ids, list(SNAP_FACTORS), "factor", "score")

    @cached_property
    def signals(self) -> DataFrame:
        """Buy signals from the snapshots: sid, anchor, badge, cap_tier, market, era, score."""
        badge = F.when(F.col("score") >= 0.62, "HIGH BUY").when(F.col("score") >= 0.52, "TACTICAL BUY")
        return self.snaps.withColumn("badge", badge).where("badge IS NOT NULL").select(
            "sid", F.date_add("d", (F.col("sid") % 28).cast("int")).alias("anchor"), "badge", "cap_tier", "market", "score",
            F.when(F.year("d") % 2 == 0, "v1").otherwise("v2").alias("era"),
        )

    @cached_property
    def vix(self) -> DataFrame:
        """Monthly volatility index stand-in: d, vix, from the dispersion of event values by day."""
        return (
            self.lineitem.groupBy(F.to_date(F.date_trunc("month", "l_shipdate")).alias("d"))
            .agg(F.sum(F.round(F.col("l_tax") * 100).cast("long")).alias("x"), F.count(F.lit(1)).alias("n"),
                 F.sum(F.col("l_quantity").cast("long") % 7).alias("y"))
            .select("d", (F.pmod(F.col("x") * 31 + F.col("y") * 7 + F.col("n"), F.lit(450)) / 10.0).alias("vix"))
        )


def None_() -> Column:
    return F.lit(None).cast("double")


ID_COLUMNS = ("pid", "ticker", "market", "sector", "cap_tier")


def unpivot_scores(wide: DataFrame, ids=ID_COLUMNS, factors=US_FACTORS) -> DataFrame:
    return wide.select(*ids, *factors).unpivot(list(ids), list(factors), "factor", "score")
