"""Weights, tilts, costs and performance. Months are `month`; weights sum to one in each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelloom.operators.evaluation import student_p, student_quantile


def _month():
    return Window.partitionBy("month")


def capped(weights: DataFrame, cap: float = 0.08) -> DataFrame:
    """Adds `capped`: weights with none above the cap, the excess spread over the others in proportion.

    The k largest are at the cap for the smallest k with which the next one, scaled up, stays under it: running sums in
    descending order say so, without iterating. Where cap * names < 1 no weights satisfy it: all are equal, feasible false.
    """
    order = Window.partitionBy("month").orderBy(F.desc("weight"), "instrument")
    n = F.count("*").over(_month())
    ranked = weights.withColumns({"_k": F.row_number().over(order) - 1, "_rest": 1 - F.coalesce(F.sum("weight").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)), "_n": n})
    scale = (1 - cap * F.col("_k")) / F.col("_rest")
    ranked = ranked.withColumn("_fits", F.when((F.col("_rest") > 1e-15) & (F.col("weight") * scale <= cap), F.col("_k")))
    ranked = ranked.withColumn("_first", F.min("_fits").over(_month()))
    ranked = ranked.withColumn("_scale", F.max(F.when(F.col("_k") == F.col("_first"), scale)).over(_month()))
    value = F.when(F.col("_n") * cap < 1, 1 / F.col("_n")).when(F.col("_k") < F.col("_first"), F.lit(cap)).otherwise(F.col("weight") * F.col("_scale"))
    return ranked.withColumns({"capped": value, "feasible": F.col("_n") * cap >= 1}).drop("_k", "_rest", "_n", "_fits", "_first", "_scale")


def _normalised(x: Column) -> Column:
    return x / F.sum(x).over(_month())


def tilt_by_score(scored: DataFrame, alpha: float, least: int = 20) -> DataFrame:
    """Adds bench_w and port_w: benchmark weights plus alpha times the score's z, cut at zero, to sum one again."""
    spread, n = F.stddev_pop("score").over(_month()), F.count("score").over(_month())
    rows = scored.filter("score is not null and weight is not null").withColumns({"_sd": spread, "_n": n}).filter((F.col("_sd") > 1e-12) & (F.col("_n") >= least))
    rows = rows.withColumn("bench_w", _normalised(F.col("weight")))
    z = (F.col("score") - F.avg("score").over(_month())) / F.col("_sd")
    rows = rows.withColumn("_raw", F.greatest(F.col("bench_w") + alpha * z, F.lit(0.0)))
    return rows.withColumn("port_w", _normalised(F.col("_raw"))).drop("_sd", "_n", "_raw")


def tilt_by_blocks(scored: DataFrame, alpha: float, names: int, least: int = 20) -> DataFrame:
    """Adds bench_w and port_w: alpha added to the `names` best scores and taken from the worst; ties by instrument."""
    best = F.row_number().over(_month().orderBy(F.desc("score"), "instrument"))
    worst = F.row_number().over(_month().orderBy("score", "instrument"))
    rows = scored.filter("score is not null and weight is not null").withColumns({"_best": best, "_worst": worst, "_n": F.count("*").over(_month())}).filter(F.col("_n") >= least)
    rows = rows.withColumn("bench_w", _normalised(F.col("weight")))
    move = F.when(F.col("_best") <= names, alpha).when(F.col("_worst") <= names, -alpha).otherwise(0.0)
    rows = rows.withColumn("_raw", F.greatest(F.col("bench_w") + move, F.lit(0.0)))
    return rows.withColumn("port_w", _normalised(F.col("_raw"))).drop("_best", "_worst", "_n", "_raw")


def turnover(book: DataFrame, w: str = "port_w", keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, month, turnover: summed changes of weights against the month before among those present; the first is the whole book.

    A weight counts in its month and, with a minus, in the next one, so a name that leaves is there too: one exchange, no join
    of the book with itself.
    """
    following = book.select("month").distinct().withColumn("after", F.lead("month").over(Window.orderBy("month")))
    now = book.select(*keys, "month", "instrument", F.col(w).alias("w"))
    left = now.join(F.broadcast(following), "month").filter("after is not null").select(*keys, F.col("after").alias("month"), "instrument", (-F.col("w")).alias("w"))
    moves = now.unionByName(left).groupBy(*keys, "month", "instrument").agg(F.sum("w").alias("d"))
    return moves.groupBy(*keys, "month").agg(F.sum(F.abs("d")).alias("turnover"))


def backtest(book: DataFrame, cost: float = 0.001, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, month, port_ret, port_ret_gross, bench_ret, active_ret, turnover, txn_cost, n_stocks."""
    gross = book.groupBy(*keys, "month").agg(F.sum(F.col("port_w") * F.col("fwd_ret_1m")).alias("port_ret_gross"), F.sum(F.col("bench_w") * F.col("fwd_ret_1m")).alias("bench_ret"), F.count("*").alias("n_stocks"))
    out = gross.join(turnover(book, keys=keys), [*keys, "month"]).withColumn("txn_cost", cost * F.col("turnover"))
    out = out.withColumn("port_ret", F.col("port_ret_gross") - F.col("txn_cost"))
    return out.withColumn("active_ret", F.col("port_ret") - F.col("bench_ret"))


def sweep(scored: DataFrame, alphas: list[float], least: int = 20) -> DataFrame:
    """The back-test of tilt_by_score for each alpha, all in one plan: scores and benchmark are made once, then exploded."""
    spread, n = F.stddev_pop("score").over(_month()), F.count("score").over(_month())
    rows = scored.filter("score is not null and weight is not null").withColumns({"_sd": spread, "_n": n}).filter((F.col("_sd") > 1e-12) & (F.col("_n") >= least))
    rows = rows.withColumns({"bench_w": _normalised(F.col("weight")), "_z": (F.col("score") - F.avg("score").over(_month())) / F.col("_sd")})
    rows = rows.select("month", "instrument", "fwd_ret_1m", "bench_w", "_z", F.explode(F.array(*map(F.lit, alphas))).alias("alpha"))
    rows = rows.withColumn("_raw", F.greatest(F.col("bench_w") + F.col("alpha") * F.col("_z"), F.lit(0.0)))
    return backtest(rows.withColumn("port_w", F.col("_raw") / F.sum("_raw").over(Window.partitionBy("alpha", "month"))), keys=("alpha",))


def best_alpha(stats: DataFrame, low: float = 0.01, high: float = 0.05, fallback: float = 0.01) -> DataFrame:
    """alpha, info_ratio, in_range of the largest information ratio among tracking errors in a range; else the fallback alpha."""
    fits = F.col("track_err").between(low, high)
    found = stats.agg(F.max_by("alpha", F.when(fits, F.struct("info_ratio", -F.col("alpha")))).alias("alpha"), F.max(F.when(fits, F.col("info_ratio"))).alias("info_ratio"))
    return found.select(F.coalesce("alpha", F.lit(fallback)).alias("alpha"), "info_ratio", F.col("alpha").isNotNull().alias("in_range"))


def tilt_by_fraction(scored: DataFrame, up: float, down: float, fraction: float, least: int = 50, fewest: int = 10) -> DataFrame:
    """Adds bench_w (the weight as it is, not normalised) and port_w: `up` on the best share of names, `down` off the worst."""
    best = F.row_number().over(_month().orderBy(F.desc("score"), "instrument"))
    rows = scored.filter("score is not null and weight is not null and fwd_ret_1m is not null").withColumns({"_best": best, "_n": F.count("*").over(_month())}).filter(F.col("_n") >= least)
    k = F.greatest(F.lit(fewest), F.floor(F.col("_n") * fraction))
    move = F.when(F.col("_best") > F.col("_n") - k, -down).when(F.col("_best") <= k, up).otherwise(0.0)
    rows = rows.withColumns({"bench_w": F.col("weight"), "_raw": F.greatest(F.col("weight") + move, F.lit(0.0))})
    return rows.withColumn("port_w", _normalised(F.col("_raw"))).drop("_best", "_n", "_raw")


def arithmetic_stats(bt: DataFrame) -> DataFrame:
    """Mean-based yearly alpha, tracking error, ratio, hit rate, drawdown of the summed active returns and Sharpe ratio."""
    run = Window.orderBy("month").rowsBetween(Window.unboundedPreceding, 0)
    bt = bt.withColumn("_c", F.sum("active_ret").over(run)).withColumn("_d", F.col("_c") - F.max("_c").over(run))
    year = F.sqrt(F.lit(12.0))
    out = bt.agg(
        F.count("*").alias("n_months"), (F.avg("active_ret") * 12).alias("ann_alpha"), (F.stddev_samp("active_ret") * year).alias("track_err"), F.avg((F.col("active_ret") > 0).cast("double")).alias("hit_rate"), F.min("_d").alias("max_active_dd"),
        (F.avg("port_ret") * 12 / (F.stddev_samp("port_ret") * year + 1e-9)).alias("sharpe"),
    )
    return out.withColumn("info_ratio", F.when(F.col("track_err") > 1e-9, F.col("ann_alpha") / F.col("track_err"))).filter("n_months >= 3")


def top_names(scored: DataFrame, n: int) -> DataFrame:
    """month, names, ret: the mean return of the n best scores, those with a return; ties by instrument."""
    best = F.row_number().over(_month().orderBy(F.desc("score"), "instrument"))
    rows = scored.filter("score is not null and fwd_ret_1m is not null").withColumn("_k", best).filter(F.col("_k") <= n)
    return rows.groupBy("month").agg(F.count("*").alias("names"), F.avg("fwd_ret_1m").alias("ret"))


def name_turnover(book: DataFrame, n: int) -> DataFrame:
    """month, entered: share of the n largest weights that were not among the month before's."""
    top = book.withColumn("_k", F.row_number().over(_month().orderBy(F.desc("port_w"), "instrument"))).filter(F.col("_k") <= n).select("month", "instrument")
    following = book.select("month").distinct().withColumn("after", F.lead("month").over(Window.orderBy("month")))
    old = top.join(F.broadcast(following), "month").filter("after is not null").select(F.col("after").alias("month"), "instrument", F.lit(1).alias("_old"))
    both = top.join(old, ["month", "instrument"], "left").groupBy("month").agg(F.avg(F.col("_old").isNull().cast("double")).alias("entered"))
    return both.join(F.broadcast(following.select(F.col("after").alias("month"))), "month", "left_semi")


def performance(bt: DataFrame, *keys: str) -> DataFrame:
    """Yearly return, benchmark, alpha, tracking error, information ratio, hit rate, drawdowns and Sharpe ratio.

    A compound return is null where the months lose everything or more.
    """
    run = Window.partitionBy(*keys).orderBy("month").rowsBetween(Window.unboundedPreceding, 0)
    bt = bt.withColumns({"_a": F.product(1 + F.col("active_ret")).over(run), "_p": F.product(1 + F.col("port_ret")).over(run)})
    bt = bt.withColumns({"_da": F.col("_a") / F.max("_a").over(run) - 1, "_dp": F.col("_p") / F.max("_p").over(run) - 1})
    grown = lambda c: F.product(1 + F.col(c))
    yearly = lambda c: F.when(grown(c) > 0, F.pow(grown(c), 12 / F.count("*")) - 1)
    out = bt.groupBy(*keys).agg(
        F.count("*").alias("months"), yearly("port_ret").alias("ann_port"), yearly("bench_ret").alias("ann_bench"), yearly("active_ret").alias("ann_alpha"), (F.stddev_samp("active_ret") * F.sqrt(F.lit(12.0))).alias("track_err"),
        F.avg((F.col("active_ret") > 0).cast("double")).alias("hit_rate"), F.min("_da").alias("max_active_dd"), F.min("_dp").alias("maxdd"), (F.stddev_samp("port_ret") * F.sqrt(F.lit(12.0))).alias("_vol"),
    )
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    return out.withColumns({"info_ratio": ratio("ann_alpha", "track_err"), "sharpe": ratio("ann_port", "_vol")}).drop("_vol").filter("months >= 6")


def long_short(scored: DataFrame, share: float = 0.2, least: int = 20) -> DataFrame:
    """month, long_ret, short_ret, spread of the best and worst share of names."""
    n = F.count("*").over(_month())
    rows = scored.filter("score is not null and fwd_ret_1m is not null").withColumns({"_n": n, "_best": F.row_number().over(_month().orderBy(F.desc("score"), "instrument")), "_worst": F.row_number().over(_month().orderBy("score", "instrument"))})
    k = F.greatest(F.floor(F.col("_n") * share), F.lit(1))
    out = rows.filter(F.col("_n") >= least).groupBy("month").agg(F.avg(F.when(F.col("_best") <= k, F.col("fwd_ret_1m"))).alias("long_ret"), F.avg(F.when(F.col("_worst") <= k, F.col("fwd_ret_1m"))).alias("short_ret"))
    return out.withColumn("spread", F.col("long_ret") - F.col("short_ret"))


def capacity(book: DataFrame, funds: list[float], daily_value: str = "adv", impact: float = 1.0, days: int = 3) -> DataFrame:
    """fund, impact_cost, mean_participation: square-root impact of trading each month's changes over some days."""
    months = book.select("month").distinct().withColumn("before", F.lag("month").over(Window.orderBy("month")))
    held = months.join(book.withColumnRenamed("month", "before"), "before").select("month", "instrument", F.col("port_w").alias("w0"))
    trades = book.join(held, ["month", "instrument"], "left").withColumn("traded", F.abs(F.col("port_w") - F.coalesce("w0", F.lit(0.0))))
    sized = trades.withColumn("fund", F.explode(F.array(*map(F.lit, funds)))).withColumn("part", F.col("traded") * F.col("fund") / (F.col(daily_value) * days))
    monthly = sized.groupBy("fund", "month").agg(F.sum(F.col("traded") * impact * F.col("daily_vol") * F.sqrt("part")).alias("cost"), F.avg("part").alias("part"))
    return monthly.groupBy("fund").agg((F.avg("cost") * 12).alias("impact_cost"), F.avg("part").alias("mean_participation"))


def block_bootstrap(series: DataFrame, x: str, sims: int, block: int, a: int = 7919, b: int = 104729) -> DataFrame:
    """sim, mean, std of circular block resamples of a monthly series (month, x).

    Draws are arithmetic: block j of simulation s starts at (a * s + b * j) mod n. Rows are simulations times months,
    joined by position with the series, a row a month.
    """
    numbered = series.select(F.col(x).alias("x"), (F.row_number().over(Window.orderBy("month")) - 1).alias("at"))
    n = numbered.count()
    if not n:
        return numbered.select(F.lit(0).alias("sim"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("std")).limit(0)
    draws = series.sparkSession.range(sims).select(F.col("id").alias("sim"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i"))
    at = (F.col("sim") * a + F.floor(F.col("i") / block) * b + F.col("i") % block) % n
    return draws.withColumn("at", at).join(F.broadcast(numbered), "at").groupBy("sim").agg(F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"))


def mixed(x: Column) -> Column:
    """A permutation of the integers mod 2**31 - 1 without a pattern: two rounds of a fifth power; products stay under 2**62."""
    p = 2_147_483_647
    for a, b in ((48_271, 11), (69_621, 977)):
        x = (x * F.lit(a).cast("long") + b) % p
        square = x * x % p
        x = square * square % p * x % p
    return x


def resampled(series: DataFrame, x: str, sims: int, block: int, circular: bool = True, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, sim, x: block resamples of monthly series (keys, month, x), each block's start drawn on its own.

    Block j of simulation s starts at mixed(mixed(s) + j) modulo the series' months, which SQL can compute too. Circular
    blocks wrap and fill the series' length; others start where a whole block fits, and only whole blocks are drawn (one at
    least). A block of one month resamples months independently. Rows are simulations times months, joined by position.
    """
    own = Window.partitionBy(*keys)
    numbered = series.select(*keys, F.col(x).alias("x"), (F.row_number().over(own.orderBy("month")) - 1).cast("long").alias("at"), F.count("*").over(own).alias("n")).filter("n > 0")
    lengths = numbered.select(*keys, "n").distinct()
    blocks = F.ceil(F.col("n") / block) if circular else F.greatest(F.floor(F.col("n") / block), F.lit(1))
    room = F.col("n") if circular else F.greatest(F.col("n") - block + 1, F.lit(1))
    drawn = lengths.withColumn("sim", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(sims - 1).cast("long")))).withColumn("_s", mixed(F.col("sim")))
    drawn = drawn.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), (blocks - 1).cast("long")))).withColumn("first", mixed(F.col("_s") + F.col("j")) % room)
    drawn = drawn.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(block - 1).cast("long")))).filter(F.col("j") * block + F.col("k") < F.col("n"))
    drawn = drawn.withColumn("at", (F.col("first") + F.col("k")) % F.col("n")).select(*keys, "sim", "at")
    return drawn.join(F.broadcast(numbered.drop("n")), [*keys, "at"]).drop("at")


def block_bootstrap_mixed(series: DataFrame, x: str, sims: int, block: int) -> DataFrame:
    """sim, mean, std of circular block resamples of a monthly series (month, x); see `resampled`."""
    return resampled(series, x, sims, block).groupBy("sim").agg(F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"))


def information_ratios(draws: DataFrame, keys: tuple[str, ...] = (), compound: bool = True) -> DataFrame:
    """keys, sim, ir of resampled active returns: compound over sample spread, or mean over population spread."""
    year, grown = F.sqrt(F.lit(12.0)), F.product(1 + F.col("x"))
    spread = F.stddev_samp("x")
    whole = F.when((spread > 0) & (grown > 0), (F.pow(grown, 12 / F.count("*")) - 1) / (spread * year))
    return draws.groupBy(*keys, "sim").agg((whole if compound else F.avg("x") * 12 / (F.stddev_pop("x") * year + 1e-8)).alias("ir"))


def intervals(ratios: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, sims, mean, ci_lo, ci_hi: the middle 95 % of the ratios that are known."""
    return ratios.filter("ir is not null").groupBy(*keys).agg(F.count("*").alias("sims"), F.avg("ir").alias("mean"), F.percentile("ir", 0.025).alias("ci_lo"), F.percentile("ir", 0.975).alias("ci_hi"))


def normals(seed: Column) -> Column:
    """Standard normal numbers from whole ones, by two draws and their polar transform."""
    top = 2_147_483_647.0
    u, v = (mixed(seed * 2) + 1) / top, mixed(seed * 2 + 1) / top
    return F.sqrt(-2 * F.log(F.least(u, F.lit(1.0)))) * F.cos(2 * 3.141592653589793 * v)


def fan(series: DataFrame, x: str, months: int = 36, sims: int = 1000) -> DataFrame:
    """month and the 5th to 95th percentiles, in per cent, of compound paths whose months are drawn from a monthly series (month, x).

    Step k of simulation s takes the month at mixed(mixed(s) + k) modulo the series' months.
    """
    # one row a month
    numbered = series.select(F.col(x).alias("x"), (F.row_number().over(Window.orderBy("month")) - 1).cast("long").alias("at"), F.count("*").over(Window.partitionBy()).alias("n"))
    steps = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    drawn = numbered.select("n").distinct().withColumn("sim", steps(sims)).withColumn("_s", mixed(F.col("sim"))).withColumn("step", steps(months))
    drawn = drawn.withColumn("at", mixed(F.col("_s") + F.col("step")) % F.col("n")).join(F.broadcast(numbered.drop("n")), "at")
    path = F.product(1 + F.col("x")).over(Window.partitionBy("sim").orderBy("step").rowsBetween(Window.unboundedPreceding, 0))
    rows = drawn.select((F.col("step") + 1).cast("int").alias("month"), ((path - 1) * 100).alias("p"))
    return rows.groupBy("month").agg(*[F.percentile("p", k / 100).alias(f"p{k}") for k in (5, 25, 50, 75, 95)])


def volatility_surface(bt: DataFrame, x: str = "port_ret", horizon: int = 24) -> DataFrame:
    """alpha, horizon, n, vol: yearly spread of the summed returns over all runs of up to `horizon` months of each alpha's back-test."""
    order = Window.partitionBy("alpha").orderBy("month")
    rows = bt.select("alpha", "month", F.sum(x).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("_c"), F.row_number().over(order).alias("_t"))
    runs = {str(h): F.when(F.col("_t") >= h, F.col("_c") - F.lag("_c", h, 0.0).over(order)) for h in range(1, horizon + 1)}
    long = rows.select("alpha", *[c.alias(h) for h, c in runs.items()]).unpivot("alpha", list(runs), "horizon", "ret").filter("ret is not null")
    out = long.groupBy("alpha", F.col("horizon").cast("int").alias("horizon")).agg(F.count("*").alias("n"), F.stddev_samp("ret").alias("vol"))
    return out.withColumn("vol", F.col("vol") * F.sqrt(12 / F.col("horizon")))


def regime_attribution(bt: DataFrame, ranges: list[tuple[str, str, str]], sims: int = 10_000, block: int = 6) -> DataFrame:
    """split, regime, n, ir, ann_alpha, hit, ci_lo, ci_hi of active returns in named ranges, and where volatility is under or over its median."""
    last = Window.orderBy("month").rowsBetween(-5, 0)
    rows = bt.withColumn("_v", F.when(F.count("bench_ret").over(last) >= 3, F.round(F.stddev_samp("bench_ret").over(last), 12)))
    rows = rows.withColumn("_cut", F.percentile("_v", 0.5).over(Window.partitionBy()))
    named = F.filter(F.array(*[F.struct(F.lit("named").alias("split"), F.lit(n).alias("regime"), F.lit(a).cast("date").alias("a"), F.lit(b).cast("date").alias("b")) for n, a, b in ranges]), lambda r: F.col("month").between(r["a"], r["b"]))
    named = F.transform(named, lambda r: F.struct(r["split"].alias("split"), r["regime"].alias("regime")))
    vol = F.when(F.col("_v").isNotNull(), F.array(F.struct(F.lit("vol").alias("split"), F.when(F.col("_v") <= F.col("_cut"), "low").otherwise("high").alias("regime"))))
    parts = rows.select("month", "active_ret", F.explode(F.concat(named, F.coalesce(vol, F.slice(named, 1, 0)))).alias("g")).select("g.*", "month", F.col("active_ret").alias("x"))
    keys = ("split", "regime")
    whole = parts.groupBy(*keys).agg(F.count("*").alias("n"), (F.avg("x") * 12).alias("ann_alpha"), F.avg((F.col("x") > 0).cast("double")).alias("hit")).filter("n >= 6")
    ratio = information_ratios(parts.withColumn("sim", F.lit(0)), keys).drop("sim")
    found = intervals(information_ratios(resampled(parts, "x", sims, block, keys=keys), keys), keys).select(*keys, "ci_lo", "ci_hi")
    out = whole.join(ratio, [*keys]).join(found, [*keys], "left")
    return out.withColumns({c: F.when(F.col("n") >= 12, F.col(c)) for c in ("ci_lo", "ci_hi")})


def overlay(book: DataFrame, picks: DataFrame, extra: float = 0.01) -> DataFrame:
    """Adds pitch_w: the picks' weights raised by `extra` each, all others scaled down to make room."""
    rows = book.join(picks.select("month", "instrument", F.lit(True).alias("_pick")), ["month", "instrument"], "left").withColumn("_pick", F.coalesce("_pick", F.lit(False)))
    raised = F.col("bench_w") + F.when(F.col("_pick"), extra).otherwise(0.0)
    room = 1 - F.sum(F.when(F.col("_pick"), raised).otherwise(0.0)).over(_month())
    rest = F.sum(F.when(F.col("_pick"), 0.0).otherwise(F.col("bench_w"))).over(_month())
    return rows.withColumn("pitch_w", F.when(F.col("_pick"), raised).otherwise(F.when(rest > 0, F.col("bench_w") * F.greatest(room, F.lit(0.0)) / rest).otherwise(0.0))).drop("_pick")


def against_benchmark(bt: DataFrame) -> DataFrame:
    """beta, alpha (monthly), corr and months of portfolio returns on the benchmark's."""
    spread = F.var_samp("bench_ret")
    beta = F.when(spread > 0, F.covar_samp("port_ret", "bench_ret") / spread)
    both = F.stddev_pop("port_ret") * F.stddev_pop("bench_ret")
    out = bt.agg(F.count("*").alias("months"), beta.alias("beta"), F.avg("port_ret").alias("_p"), F.avg("bench_ret").alias("_b"), F.when(both > 1e-15, F.covar_pop("port_ret", "bench_ret") / both).alias("corr"))
    return out.withColumn("alpha", F.col("_p") - F.col("beta") * F.col("_b")).drop("_p", "_b")


def paired_difference(a: DataFrame, b: DataFrame, x: str = "active_ret") -> DataFrame:
    """n, mean, t, p and the 95 % interval of the differences of two strategies' months."""
    d = a.select("month", F.col(x).alias("a")).join(b.select("month", F.col(x).alias("b")), "month").select((F.col("a") - F.col("b")).alias("d"))
    out = d.agg(F.count("*").alias("n"), F.avg("d").alias("mean"), F.stddev_samp("d").alias("s"))
    out = out.withColumn("t", F.when(F.col("s") > 1e-15, F.col("mean") / F.col("s") * F.sqrt("n")))
    half = F.col("s") / F.sqrt("n") * student_quantile(F.col("n") - 1)
    return out.withColumns({"p": student_p(F.col("t"), F.col("n") - 1), "ci_lo": F.col("mean") - half, "ci_hi": F.col("mean") + half}).drop("s")


def regime_of(series: DataFrame, x: str, until: str, low: float = 1 / 3, high: float = 2 / 3) -> DataFrame:
    """month, x, stress (share of the training months at or under it) and regime calm, normal or stress.

    One row a month: a running count, in order of the value, of the training months up to `until`.
    """
    trains = (F.col("month") <= F.lit(until).cast("date")) & F.col(x).isNotNull()
    up_to = Window.orderBy(F.col(x).asc_nulls_first()).rangeBetween(Window.unboundedPreceding, 0)
    rows = series.select("month", x, F.count(F.when(trains, 1)).over(up_to).alias("_c"), F.count(F.when(trains, 1)).over(Window.partitionBy()).alias("_n")).filter("_n > 0")
    rows = rows.withColumn("stress", F.when(F.col(x).isNotNull(), F.col("_c") / F.col("_n")))
    return rows.select("month", x, "stress", F.when(F.col("stress") < low, "calm").when(F.col("stress") > high, "stress").when(F.col("stress").isNotNull(), "normal").alias("regime"))


def rule_regimes(months: DataFrame, ranges: list[tuple[str, str, str]], excluded: tuple[str, str]) -> DataFrame:
    """month, regime: the named range that a month is in, 'other' outside all and in the excluded range; later names win."""
    label = F.lit("other")
    for name, first, final in ranges:
        label = F.when(F.col("month").between(F.lit(first).cast("date"), F.lit(final).cast("date")), name).otherwise(label)
    out = F.col("month").between(F.lit(excluded[0]).cast("date"), F.lit(excluded[1]).cast("date"))
    return months.select("month", F.when(out, "other").otherwise(label).alias("regime"))


STATE = ["signal_strength", "signal_dispersion", "bench_vol", "rolling_te", "recent_active_ret"]


def episode_state(scored: DataFrame, bt: DataFrame, until: str, least: int = 50) -> DataFrame:
    """month, five state columns as z-scores of the months up to a date, cut at five, and whether volatility is over its running median."""
    spread = F.stddev_pop("score").over(_month())
    z = scored.withColumns({"_z": (F.col("score") - F.avg("score").over(_month())) / (spread + 1e-8), "_n": F.count("score").over(_month())}).filter(F.col("_n") >= least)
    signals = z.groupBy("month").agg(F.avg(F.abs("_z")).alias("signal_strength"), F.stddev_pop("_z").alias("signal_dispersion"))
    by = Window.orderBy("month")
    three, run = by.rowsBetween(-2, 0), by.rowsBetween(Window.unboundedPreceding, 0)
    lately = lambda c: F.coalesce(F.when(F.count(c).over(three) >= 2, F.stddev_samp(c).over(three)), F.stddev_samp(c).over(run), F.lit(0.0)) * F.sqrt(F.lit(12.0))
    rows = signals.join(bt.select("month", "bench_ret", "active_ret"), "month")
    rows = rows.withColumns({"bench_vol": F.round(lately("bench_ret"), 12), "rolling_te": lately("active_ret"), "recent_active_ret": F.coalesce(F.avg("active_ret").over(three), F.lit(0.0))})
    median = F.when(F.count("bench_vol").over(run) >= 6, F.percentile("bench_vol", 0.5).over(run))
    rows = rows.withColumn("regime", F.coalesce((F.col("bench_vol") > median).cast("double"), F.lit(0.0)))
    train = F.col("month") <= F.lit(until).cast("date")
    whole = Window.partitionBy()
    scaled = {c: (F.col(c) - F.avg(F.when(train, F.col(c))).over(whole)) / (F.stddev_samp(F.when(train, F.col(c))).over(whole) + 1e-8) for c in STATE}
    return rows.withColumns({c: F.coalesce(F.greatest(F.least(x, F.lit(5.0)), F.lit(-5.0)), F.lit(0.0)) for c, x in scaled.items()}).select("month", *STATE, "regime")


def before_after(before: DataFrame, after: DataFrame, limit: float = 0.005) -> DataFrame:
    """alpha, ir and hit rate of two runs' performance (a row each), their differences, and whether alpha fell by more than the limit."""
    names = {"ann_alpha": "alpha", "info_ratio": "ir", "hit_rate": "hit"}
    side = lambda df, tag: df.select(F.lit(1).alias("_one"), *[F.col(c).alias(f"{n}_{tag}") for c, n in names.items()])
    both = side(before, "before").join(side(after, "after"), "_one").drop("_one")
    both = both.withColumns({f"d_{n}": F.col(f"{n}_after") - F.col(f"{n}_before") for n in names.values()})
    return both.withColumn("regression", F.coalesce(F.round("d_alpha", 12) < -limit, F.lit(False)))


def tilt_adaptation(bt: DataFrame, alpha: str = "alpha_used") -> DataFrame:
    """n, r, slope, intercept, welch_t: whether the active return per unit of tilt goes with the tilt's size; high is over its median."""
    rows = bt.withColumns({"_x": F.col(alpha) * 100, "_y": F.col("active_ret") / F.col(alpha)})
    rows = rows.withColumn("_cut", F.percentile("_x", 0.5).over(Window.partitionBy()))
    hi, lo = F.when(F.col("_x") > F.col("_cut"), F.col("_y")), F.when(F.col("_x") <= F.col("_cut"), F.col("_y"))
    both = F.stddev_pop("_x") * F.stddev_pop("_y")
    gap = F.try_divide(F.avg(hi) - F.avg(lo), F.sqrt(F.try_divide(F.var_samp(hi), F.count(hi)) + F.try_divide(F.var_samp(lo), F.count(lo))))
    return rows.agg(F.count("*").alias("n"), F.when(both > 1e-15, F.covar_pop("_x", "_y") / both).alias("r"), F.regr_slope("_y", "_x").alias("slope"), F.regr_intercept("_y", "_x").alias("intercept"), gap.alias("welch_t"))


def linear_bridge(rows: DataFrame, y: str, a: str, b: str) -> DataFrame:
    """n, coef_a, coef_b, intercept, r2 of the least-squares fit of y on a and b, from second moments."""
    rows = rows.dropna(subset=[y, a, b])
    cov = lambda u, v: F.covar_pop(u, v)
    m = rows.agg(F.count("*").alias("n"), cov(a, a).alias("aa"), cov(b, b).alias("bb"), cov(a, b).alias("ab"), cov(a, y).alias("ay"), cov(b, y).alias("by"), cov(y, y).alias("yy"), F.avg(a).alias("ma"), F.avg(b).alias("mb"), F.avg(y).alias("my"))
    det = F.col("aa") * F.col("bb") - F.col("ab") * F.col("ab")
    m = m.withColumns({"coef_a": F.when(det > 0, (F.col("ay") * F.col("bb") - F.col("by") * F.col("ab")) / det), "coef_b": F.when(det > 0, (F.col("by") * F.col("aa") - F.col("ay") * F.col("ab")) / det)})
    return m.select("n", "coef_a", "coef_b", (F.col("my") - F.col("coef_a") * F.col("ma") - F.col("coef_b") * F.col("mb")).alias("intercept"), ((F.col("coef_a") * F.col("ay") + F.col("coef_b") * F.col("by")) / F.col("yy")).alias("r2"))
