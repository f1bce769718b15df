"""The flagship: bars to factors to neutral scores to composite to the top names per market."""

from pyspark.sql import functions as F

from ..functions import price
from ..functions.common import r6, unit
from ..operators import composite, ranking, ts, xs
from ..oracles.base import clip, statement
from ..session import materialize
from .registry import query
from .windows import NEUTRAL_VIEW

WEIGHTS = {"momentum_long": 0.6, "volume_attention": 0.25, "reversal": 0.15}


def bar_scores(t):
    """Newest bar of every name with its three price factors, long."""
    bars = ts.volume_zscore(ts.price_features(ts.momentum_excess(t.bars, t.bench_bars, 12, 1), 12, 1, 1, 3, 3, 12), 20)
    last = ranking.top_per(bars.withColumn("k", F.lit(1)).withColumnRenamed("sid", "ticker"), ["ticker"], 1, "d").withColumnRenamed("ticker", "sid")
    u = t.universe.select("sid", "ticker", "market", "sector", "cap_tier")
    wide = last.join(u, "sid").select(
        "ticker", "market", "sector", "cap_tier",
        F.when(F.col("mom_excess").isNotNull(), price.momentum("mom_excess")).alias("momentum_long"),
        price.volume_attention("volume_spike").alias("volume_attention"),
        unit(0.5 - F.col("volume_z") / 6.0).alias("reversal"),
    )
    ids = ["ticker", "market", "sector", "cap_tier"]
    return wide.unpivot(ids, list(WEIGHTS), "factor", "score")


FLAG = {
    "lastbar": (("bars", "bench"), """SELECT * FROM (SELECT sid, d, (lag(close, 1) OVER w / lag(close, 12) OVER w - 1) - (lag(bench, 1) OVER w / lag(bench, 12) OVER w - 1) AS mom,
        CASE WHEN count(*) OVER b = 12 AND avg(volume) OVER b > 0 THEN least(20.0, avg(volume) OVER (PARTITION BY sid ORDER BY d ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) / avg(volume) OVER b) ELSE 1.0 END AS spike,
        CASE WHEN count(*) OVER f < 20 THEN NULL WHEN stddev_pop(volume) OVER f <= 1e-12 THEN 0.0 ELSE (volume - avg(volume) OVER f) / stddev_pop(volume) OVER f END AS vz, row_number() OVER (PARTITION BY sid ORDER BY d DESC) AS rn
        FROM bars JOIN bench USING (d) WINDOW w AS (PARTITION BY sid ORDER BY d), b AS (PARTITION BY sid ORDER BY d ROWS BETWEEN 14 PRECEDING AND 3 PRECEDING), f AS (PARTITION BY sid ORDER BY d ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)) z WHERE rn = 1"""),
    "fw": (("lastbar", "uni"), f"""SELECT ticker, market, sector, cap_tier, ({clip('mom', -0.6, 0.6)} + 0.6) / 1.2 AS momentum_long, coalesce({clip('(spike - 1) / 4', 0.0, 1.0)}, 0.0) AS volume_attention, {clip('0.5 - vz / 6.0', 0.0, 1.0)} AS reversal FROM lastbar JOIN uni USING (sid)"""),
    "fs": (("fw",), " UNION ALL ".join(f"SELECT ticker, market, sector, cap_tier, '{f}' AS factor, {f} AS score FROM fw" for f in WEIGHTS)),
    "fneu": (("fs",), NEUTRAL_VIEW["neu"][1].replace("FROM ls", "FROM fs")),
    "fcomp": (("fneu",), "SELECT ticker, market, round(sum(neutral * w) / nullif(sum(CASE WHEN neutral IS NOT NULL THEN w END), 0), 6) AS final_score FROM fneu JOIN (VALUES " + ", ".join(f"('{f}', {w}::DOUBLE)" for f, w in WEIGHTS.items()) + ") v(factor, w) USING (factor) GROUP BY 1, 2"),
}


@query("flagship_top_by_market", statement("fcomp", "SELECT market, pos, ticker, final_score FROM (SELECT *, row_number() OVER (PARTITION BY market ORDER BY final_score DESC, ticker) AS pos FROM fcomp) z WHERE pos <= 5", extra=FLAG))
def _(t):
    neutral = xs.neutralise(materialize(bar_scores(t), "bar-scores"))
    weights = F.create_map(*[F.lit(x) for kv in WEIGHTS.items() for x in kv])
    m = composite.weighted_mean(neutral.withColumn("weight", weights[F.col("factor")]), ["ticker", "market"], "neutral")
    ranked = ranking.top_per(m.withColumn("final_score", r6("composite")), ["market"], 5)
    return ranked.select("market", F.col("pos").cast("long"), "ticker", "final_score")
