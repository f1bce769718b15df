"""Back-test and information-coefficient operators over dated snapshots."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.common import ratio
from ..session import materialize
from . import joins, xs
from .distribution import attach, counted_ranks, interpolated, join_on, percentiles, with_average_rank


def snapshot_ic(long: DataFrame, label: str = "fwd", keys=("d", "factor"), score: str = "score") -> DataFrame:
    """Rank correlation of score and forward label per (date, factor); pairs with a missing side drop out."""
    return xs.spearman(long, list(keys), score, label, "ic").where("ic IS NOT NULL")


def effective_breadth(dates: Column, horizon_days: int) -> Column:
    """Greedy count of dates at least `horizon_days` apart; the array holds distinct calendar dates."""
    start = F.struct(F.lit(None).cast("date").alias("anchor"), F.lit(0).cast("long").alias("n"))

    def step(acc, d):
        keep = acc["anchor"].isNull() | (F.datediff(d, acc["anchor"]) >= horizon_days)
        return F.struct(F.when(keep, d).otherwise(acc["anchor"]).alias("anchor"), (acc["n"] + F.when(keep, 1).otherwise(0)).alias("n"))

    return F.aggregate(F.array_sort(dates), start, step, lambda acc: acc["n"])


def aggregate_ic(ic: DataFrame, horizon_days: int, key: str = "factor") -> DataFrame:
    """Mean, sample deviation, ratio, hit rate, counts and t-statistic per factor."""
    s = ic.groupBy(key).agg(
        F.avg("ic").alias("mean_ic"), F.coalesce(F.stddev_samp("ic"), F.lit(0.0)).alias("ic_std"),
        F.avg((F.col("ic") > 0).cast("int")).alias("hit_rate"), F.count(F.lit(1)).alias("n_snapshots"),
        effective_breadth(F.collect_set("d"), horizon_days).alias("n_effective"),
    )
    ir = F.when(F.col("ic_std") > 0, ratio("mean_ic", "ic_std")).otherwise(0.0)
    return s.withColumn("ic_ir", ir).withColumn("t_stat", F.col("ic_ir") * F.sqrt("n_effective"))


def recommendation() -> Column:
    return (
        F.when(F.coalesce("n_snapshots", F.lit(0)) == 0, "investigate").when(F.col("mean_ic") < 0, "investigate")
        .when((F.col("ic_ir") > 0.5) & (F.col("hit_rate") >= 0.60), "increase").when(F.col("ic_ir") >= 0.3, "hold").otherwise("decrease")
    )


def backtest(signals: DataFrame, bars: DataFrame, bench: DataFrame, horizons: list[int], cost: Column) -> DataFrame:
    """(signal, horizon) rows with net return, benchmark return and alpha.

    signals: sid, anchor, market and any labels. Returns are missing when the exit bar is; alpha is
    for US names only.
    """
    nb = joins.numbered_bars(bars).select("sid", "bar_no", "close")
    at = joins.entry_bar(signals, bars)
    own = signals.join(at, ["sid", "anchor"]).join(nb.withColumnRenamed("close", "entry_price"), ["sid", "bar_no"], "left")
    legs = own.withColumn("horizon", F.explode(F.array(*map(F.lit, horizons)))).withColumn("exit_no", F.col("bar_no") + F.col("horizon")).drop("bar_no")
    exits = legs.join(nb.select("sid", F.col("bar_no").alias("exit_no"), F.col("close").alias("exit_price")), ["sid", "exit_no"], "left").drop("exit_no")
    days = signals.select(F.lit(0).cast("long").alias("sid"), "anchor").distinct()
    ref_bars = bench.select(F.lit(0).cast("long").alias("sid"), "d", F.col("bench").alias("close"))
    priced = joins.offset_prices(days, ref_bars, [0, *horizons])  # one row per calendar day and horizon
    ref = priced.groupBy("anchor").agg(*[F.max(F.when(F.col("k") == h, F.col("price"))).alias(f"p{h}") for h in (0, *horizons)])
    p = F.coalesce(*[F.when(F.col("horizon") == h, F.col(f"p{h}")) for h in horizons])
    j = exits.join(ref, "anchor", "left").withColumn("p", p)
    net = ratio("exit_price", "entry_price") - 1.0 - cost
    bench_ret = F.when((F.col("market") == "USA") & F.col("exit_price").isNotNull(), ratio("p", "p0") - 1.0)
    return j.withColumns({"ret": net, "bench_ret": bench_ret}).withColumn("alpha", F.col("ret") - F.col("bench_ret")).drop("p", "p0", *[f"p{h}" for h in horizons])


def horizon_stats(trades: DataFrame, keys: list[str], ret: str = "ret") -> DataFrame:
    """Count, win rate, mean, median, worst, profit factor (missing without losses) and mean alpha."""
    rows = trades.where(F.col(ret).isNotNull())
    r = F.col(ret)
    s = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg((r > 0).cast("int")).alias("win_rate"), F.avg(r).alias("avg_return"),
        F.min(r).alias("worst_return"), ratio(F.sum(F.when(r > 0, r)), F.abs(F.sum(F.when(r < 0, r)))).alias("profit_factor"),
        F.coalesce(F.avg("alpha"), F.lit(0.0)).alias("avg_alpha"),
    )
    return s.join(percentiles(rows, keys, ret, {"median_return": 0.5}), keys)


def horizon_stats_by(trades: DataFrame, kinds: list[str], horizon: str = "horizon", ret: str = "ret") -> DataFrame:
    """(kind, label, horizon, ...): horizon_stats for every one of several groupings, from one look at the trades.

    GROUPING SETS reduce the trades to counts per (grouping, label, horizon, return), map-side first. All figures, exact medians included, come from that table, and the
    grouping id tells a missing label from a column that is not grouped by.
    """
    columns = [*kinds, horizon, ret]
    sets = [[k, horizon, ret] for k in kinds]
    # bit i of the id, from the left, is 1 where column i is not in the set
    ids = {k: sum(1 << (len(columns) - 1 - i) for i, x in enumerate(columns) if x not in s) for k, s in zip(kinds, sets)}
    known = trades.where(F.col(ret).isNotNull())
    grouped = known.groupingSets([[F.col(x) for x in s] for s in sets], *map(F.col, columns)).agg(
        F.grouping_id().alias("_id"), F.count(F.lit(1)).alias("cnt"), F.sum("alpha").alias("_alpha"), F.count("alpha").alias("_alphas"))
    kind, label = F.lit(None).cast("string"), F.lit(None).cast("string")
    for k, i in ids.items():
        kind, label = F.when(F.col("_id") == i, F.lit(k)).otherwise(kind), F.when(F.col("_id") == i, F.col(k)).otherwise(label)
    keys = ["kind", "label", horizon]
    counts = materialize(grouped.select(kind.alias("kind"), label.alias("label"), horizon, ret, "cnt", "_alpha", "_alphas"), "return-counts")
    r, k = F.col(ret), F.col("cnt")
    s = counts.groupBy(*keys).agg(
        F.sum(k).alias("n"), (F.sum(F.when(r > 0, k).otherwise(0)) / F.sum(k)).alias("win_rate"), (F.sum(r * k) / F.sum(k)).alias("avg_return"),
        F.min(r).alias("worst_return"), ratio(F.sum(F.when(r > 0, r * k)), F.abs(F.sum(F.when(r < 0, r * k)))).alias("profit_factor"),
        F.coalesce(F.try_divide(F.sum("_alpha"), F.sum("_alphas")), F.lit(0.0)).alias("avg_alpha"),
    )
    return join_on(s, interpolated(counted_ranks(counts.select(*keys, ret, "cnt"), keys, ret), keys, ret, {"median_return": 0.5}), keys)


def factor_correlations(long: DataFrame, factors: list[str], max_null: float = 0.5, sparse: float = 0.20) -> DataFrame:
    """Rank correlation of each factor pair per market, with densities and flags.

    Mostly missing factors are skipped, gaps are filled with the median; the pairs are columns of
    one grouped aggregate over names, so no name meets another.
    """
    stats = long.groupBy("market", "factor").agg(F.avg(F.col("score").isNull().cast("int")).alias("none_rate"))
    median = percentiles(long, ["market", "factor"], "score", {"med": 0.5})
    known = stats.where(F.col("none_rate") <= max_null).join(median, ["market", "factor"]).select("market", "factor", "none_rate", "med")
    filled = attach(long, known, ["market", "factor"]).where("none_rate IS NOT NULL").withColumn("score", F.round(F.coalesce("score", "med"), 9))
    ranked = with_average_rank(filled.select("ticker", "market", "factor", "score"), ["market", "factor"], "score", "r")
    wide = ranked.groupBy("market", "ticker").agg(
        *[F.max(F.when(F.col("factor") == f, F.col("r"))).alias(f) for f in factors],
        *[F.max(F.when(F.col("factor") == f, (F.col("score") != 0).cast("int"))).alias(f"nz_{f}") for f in factors],
    )
    pairs = list(combinations(sorted(factors), 2))
    agg = wide.groupBy("market").agg(
        *[F.covar_pop(a, b).alias(f"c_{i}") for i, (a, b) in enumerate(pairs)],
        *[F.stddev_pop(f).alias(f"s_{f}") for f in factors], *[F.avg(f"nz_{f}").alias(f"d_{f}") for f in factors],
    )
    rows = F.array(*[
        F.struct(
            F.lit(a).alias("factor_a"), F.lit(b).alias("factor_b"),
            F.when((F.col(f"s_{a}") > 1e-12) & (F.col(f"s_{b}") > 1e-12), F.try_divide(F.col(f"c_{i}"), F.col(f"s_{a}") * F.col(f"s_{b}"))).alias("rho"),
            F.col(f"d_{a}").alias("density_a"), F.col(f"d_{b}").alias("density_b"),
        )
        for i, (a, b) in enumerate(pairs)
    ])
    out = agg.select("market", F.inline(rows)).where("density_a IS NOT NULL AND density_b IS NOT NULL")
    thin = (F.col("density_a") < sparse) | (F.col("density_b") < sparse)
    level = F.when(thin, "sparse").when(F.abs("rho") >= 0.75, "error").when(F.abs("rho") >= 0.50, "warn").otherwise("ok")
    return out.withColumn("level", level)


def turnover(prev_curr: DataFrame, keys: list[str], prev: str, curr: str, n: int) -> DataFrame:
    """Rank autocorrelation and top-n churn per key over names present in both snapshots."""
    both = materialize(prev_curr.where(F.col(prev).isNotNull() & F.col(curr).isNotNull()), "turnover-pairs")
    rho = xs.spearman(both, keys, prev, curr, "autocorrelation")

    def top(score):
        w = Window.partitionBy(*keys).orderBy(F.desc(score), "ticker")
        return both.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).select(*keys, "ticker")

    kept = top(prev).join(top(curr), [*keys, "ticker"]).groupBy(*keys).agg(F.count(F.lit(1)).alias("kept"))
    k = F.least(F.lit(n), F.col("n"))
    return rho.join(kept, keys, "left").select(*keys, F.col("n").alias("common"), "autocorrelation", (1.0 - F.coalesce("kept", F.lit(0)) / k).alias("churn"))


def two_bar_returns(bars: DataFrame, pools: DataFrame, min_obs: int = 10) -> DataFrame:
    """(pool, slot, obs, r): centred non-overlapping two-bar log returns on each pool's common tail."""
    b = bars.join(pools, "sid")
    newest = Window.partitionBy("pool", "sid").orderBy(F.desc("d"))
    b = b.withColumn("rn", F.row_number().over(newest))
    length = b.groupBy("pool", "sid").agg(F.max("rn").alias("n")).groupBy("pool").agg(F.min("n").alias("len"))
    b = b.join(length, "pool").where((F.col("len") >= 2 * min_obs + 1) & (F.col("rn") <= F.col("len")))
    b = b.withColumn("j", F.col("len") - F.col("rn"))
    nxt = F.lead("close", 2).over(Window.partitionBy("pool", "sid").orderBy("j"))
    r = b.withColumn("r", F.log(ratio(nxt, "close") + 1e-10)).where("j % 2 = 0 AND j <= len - 3")
    mean = r.groupBy("pool", "slot").agg(F.avg("r").alias("m"))
    return r.join(mean, ["pool", "slot"]).select("pool", "slot", (F.col("j") / 2).cast("int").alias("obs"), (F.col("r") - F.col("m")).alias("r"))


def gram(values: DataFrame, pool: str, slot: str, obs: str, value: str, obs_block: int = 256, name_block: int = 32) -> DataFrame:
    """(pool, i, j, xy), i <= j: sums of products over the observations of a pool, for any number of names.

    Values are packed to blocks of names by blocks of observations. Only blocks meet, each pair of name blocks once per block of observations, so
    what is shuffled are packed blocks, and an observation never yields a row per pair; sums of a pair over blocks combine map-side. An observation that a name
    lacks counts as 0.
    """
    cell = values.withColumns({"_b": F.floor(F.col(obs) / obs_block), "_o": F.pmod(F.col(obs), F.lit(obs_block)).cast("int"), "_p": F.floor(F.col(slot) / name_block)})
    line = cell.groupBy(pool, "_b", "_p", slot).agg(F.map_from_entries(F.collect_list(F.struct("_o", F.col(value).cast("double")))).alias("m"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(obs_block - 1)), lambda k: F.coalesce(F.try_element_at("m", k), F.lit(0.0)))
    packs = materialize(line.groupBy(pool, "_b", "_p").agg(F.collect_list(F.struct(F.col(slot).alias("s"), dense.alias("r"))).alias("names")), "return-blocks")
    other = packs.select(F.col(pool).alias("_pool"), F.col("_b").alias("_block"), F.col("_p").alias("_q"), F.col("names").alias("others"))
    met = packs.join(other, F.col(pool).eqNullSafe(F.col("_pool")) & (F.col("_b") == F.col("_block")) & (F.col("_p") <= F.col("_q")))
    each = met.select(pool, F.explode("names").alias("a"), "others").select(pool, "a", F.explode("others").alias("b")).where("a.s <= b.s")
    dot = F.aggregate(F.zip_with("a.r", "b.r", lambda x, y: x * y), F.lit(0.0), lambda acc, v: acc + v)
    return each.groupBy(pool, F.col("a.s").alias("i"), F.col("b.s").alias("j")).agg(F.sum(dot).alias("xy"))


def shrunk_covariance(returns: DataFrame) -> DataFrame:
    """(pool, i, j, cov): covariance shrunk towards a scaled identity (Ledoit and Wolf 2004), for pools of any number of names.

    returns: (pool, slot, obs, r), centred, every slot of a pool with the same observations. All that the shrinkage needs follows from the blocked sums of products and from one
    sum per observation.
    """
    per_obs = returns.groupBy("pool", "obs").agg(F.sum(F.col("r") * F.col("r")).alias("q"), F.count(F.lit(1)).alias("p"))
    per_obs = per_obs.groupBy("pool").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("q") * F.col("q")).alias("beta_sum"), F.max("p").alias("p"))
    upper = attach(gram(returns, "pool", "slot", "obs", "r"), per_obs, ["pool"], "inner").withColumn("s", F.col("xy") / F.col("n"))
    s = upper.unionByName(upper.where("i <> j").withColumns({"i": F.col("j"), "j": F.col("i")}))
    s = materialize(s, "covariances")
    tot = s.groupBy("pool").agg(
        F.sum(F.col("s") * F.col("s")).alias("delta_sum"), F.sum(F.when(F.col("i") == F.col("j"), F.col("s"))).alias("trace"),
        F.max("n").alias("n"), F.max("p").alias("p"), F.max("beta_sum").alias("beta_sum"),
    )
    mu = F.col("trace") / F.col("p")
    beta = (F.col("beta_sum") / F.col("n") - F.col("delta_sum")) / (F.col("p") * F.col("n"))
    delta = (F.col("delta_sum") - 2.0 * mu * F.col("trace") + F.col("p") * mu * mu) / F.col("p")
    shrink = tot.select("pool", mu.alias("mu"), F.coalesce(F.try_divide(F.least(beta, delta), delta), F.lit(0.0)).alias("shrink"))
    return attach(s.select("pool", "i", "j", "s"), shrink, ["pool"], "inner").select(
        "pool", "i", "j", ((1.0 - F.col("shrink")) * F.col("s") + F.when(F.col("i") == F.col("j"), F.col("shrink") * F.col("mu")).otherwise(0.0)).alias("cov")
    )
