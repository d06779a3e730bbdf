"""Side tables that are known only from a date on: filings, short positions, holdings, macro series, filings and headlines.

Facts come in long form: instrument, field, end (of the period), filed, val.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelloom.functions.frames import safe_div
from panelloom.operators.asof import asof_join, keep_last


def normal_cdf(x: Column, terms: int = 120) -> Column:
    """The normal distribution function, by its odd series: each term is the one before times x*x over the next odd number."""

    def step(a, k):
        term = a["term"] * x * x / (2 * k + 1)
        return F.struct(term.alias("term"), (a["sum"] + term).alias("sum"))

    series = F.aggregate(F.sequence(F.lit(1), F.lit(terms)), F.struct(x.cast("double").alias("term"), x.cast("double").alias("sum")), step)["sum"]
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.5 + F.exp(-x * x / 2) / math.sqrt(2 * math.pi) * series))


def periods(facts: DataFrame, fields: list[str], flows: list[str], quarters: int = 4, least: int = 4) -> DataFrame:
    """instrument, end, filed and a column for each field; flows are sums over the last quarters, of `least` of them at least.

    Fields are joined on the period, and a period counts as filed when its last field is: nothing is known too early.
    """
    last = Window.partitionBy("instrument", "field").orderBy("end").rowsBetween(-(quarters - 1), 0)
    summed = F.when(F.count("val").over(last) >= least, F.sum("val").over(last))
    rows = facts.withColumn("val", F.when(F.col("field").isin(flows), summed).otherwise(F.col("val")))
    columns = [F.max(F.when(F.col("field") == f, F.col("val"))).alias(f) for f in fields]
    return rows.groupBy("instrument", "end").agg(F.max("filed").alias("filed"), *columns).filter("filed is not null")


def known_at(rows: DataFrame, found: DataFrame, fields: list[str], days: int, filed: str = "filed") -> DataFrame:
    """rows (instrument, date, ..) with the fields of the last table row filed at or before the date, not older than `days`.

    Of several periods filed on one day the latest is taken.
    """
    order = [c for c in ("end",) if c in found.columns]
    one = keep_last(found, ["instrument", filed], order) if order else found
    return asof_join(rows, one.select("instrument", F.col(filed).alias("date"), *fields), columns=tuple(fields), days=days)


def quantile_pair(df: DataFrame, columns: list[str], low: float, high: float, small: int = 100_000, around: float = 5e-4) -> DataFrame:
    """One row: _<column>_lo and _<column>_hi, the exact interpolated quantiles of a column's values.

    Approximate quantiles on either side of the wanted ones tell which values matter: only these (`around` either side; all of up to
    `small` values) are told apart, the others are counted. No task holds a column's values.
    """
    shares = [max(low - around, 0.0), low + around, high - around, min(high + around, 1.0)]
    told = df.agg(*[F.percentile_approx(F.col(c).cast("double"), shares, 20_000).alias(f"_cut_{c}") for c in columns], *[F.count(c).alias(f"_n_{c}") for c in columns])
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).cast("double").alias("v"), F.col(f"_cut_{c}").alias("cut"), F.col(f"_n_{c}").alias("n")) for c in columns]))
    v, cut = F.col("x.v"), F.col("x.cut")
    # below, within and above the neighbourhoods of both quantiles; the values of a small table are all within
    place = F.when(F.col("x.n") <= small, 1).when(v < cut[0], 0).when(v <= cut[1], 1).when(v < cut[2], 2).when(v <= cut[3], 3).otherwise(4)
    rows = df.join(F.broadcast(told)).select(each.alias("x")).filter("x.v is not null").select("x.variable", "x.n", v.alias("v"), place.alias("place"))
    counted = rows.groupBy("variable", "n", "place", F.when(F.col("place").isin(1, 3), F.col("v")).alias("v")).agg(F.count("*").alias("k"))
    counted = counted.withColumn("upto", F.sum("k").over(Window.partitionBy("variable").orderBy("place", "v").rowsBetween(Window.unboundedPreceding, 0)))
    at = {"lo": F.lit(low) * (F.col("n") - 1), "hi": F.lit(high) * (F.col("n") - 1)}
    value = lambda place: F.max(F.when((F.col("upto") > place) & (F.col("upto") - F.col("k") <= place), F.coalesce("v", F.raise_error(F.lit("a quantile lies outside its neighbourhood")).cast("double"))))
    ends = counted.groupBy("variable", "n").agg(*[value(f(x)).alias(f"{name}{i}") for name, x in at.items() for i, f in enumerate((F.floor, F.ceil))])
    between = lambda name: F.when(F.col(f"{name}0") == F.col(f"{name}1"), F.col(f"{name}0")).otherwise((F.ceil(at[name]) - at[name]) * F.col(f"{name}0") + (at[name] - F.floor(at[name])) * F.col(f"{name}1"))
    ends = ends.select("variable", *[between(name).alias(name) for name in at])
    return ends.agg(*[F.max(F.when(F.col("variable") == c, F.col(name))).alias(f"_{c}_{name}") for c in columns for name in at])


def clipped(df: DataFrame, columns: list[str], low: float = 0.005, high: float = 0.995) -> DataFrame:
    """Columns cut at quantiles of all their values, a row that is broadcast."""
    bounds = quantile_pair(df, columns, low, high)
    cut = {c: F.when(F.col(c).isNotNull(), F.greatest(F.least(F.col(c), F.col(f"_{c}_hi")), F.col(f"_{c}_lo"))) for c in columns}
    return df.withColumn("_one", F.lit(1)).join(F.broadcast(bounds.withColumn("_one", F.lit(1))), "_one").withColumns(cut).drop(*bounds.columns, "_one")


RATIOS = ["pe_ratio", "pb_ratio", "ps_ratio", "ev_ebitda", "roe", "roa", "gross_margin", "debt_to_equity", "earnings_quality", "buyback_yield", "revenue_growth_yoy", "eps_growth_yoy"]


def ratios(known: DataFrame) -> DataFrame:
    """instrument, month, date and the twelve ratios of rows with mktcap and the fields; growth is over twelve monthly rows."""
    c = {n: F.col(n) for n in ("mktcap", "net_income", "equity", "revenue", "op_income", "dep_amort", "liabilities", "assets", "gross_profit", "cfo", "buybacks")}
    by = Window.partitionBy("instrument").orderBy("month")
    over = lambda a, b: F.when(b != 0, a / b)
    grown = lambda x: F.when(F.lag(x, 12).over(by) != 0, F.col(x) / F.lag(x, 12).over(by) - 1)
    out = known.select("instrument", "month", "date", *[x.alias(n) for n, x in {
        "pe_ratio": over(c["mktcap"], c["net_income"]), "pb_ratio": over(c["mktcap"], c["equity"]), "ps_ratio": over(c["mktcap"], c["revenue"]), "ev_ebitda": over(c["mktcap"] + c["liabilities"], c["op_income"] + c["dep_amort"]),
        "roe": over(c["net_income"], c["equity"]), "roa": over(c["net_income"], c["assets"]), "gross_margin": over(c["gross_profit"], c["revenue"]), "debt_to_equity": over(c["liabilities"], c["equity"]),
        "earnings_quality": over(c["cfo"] - c["net_income"], c["assets"]), "buyback_yield": over(c["buybacks"], c["mktcap"]), "revenue_growth_yoy": grown("revenue"), "eps_growth_yoy": grown("eps"),
    }.items()])
    return clipped(out, RATIOS)


def vendor_ratios(table: DataFrame, guard: float = 1e6, lag_days: int = 45) -> DataFrame:
    """instrument, month, ttm ratios of a quarterly table, known lag_days after the quarter's end; a month keeps its last.

    Trailing sums need three of four quarters, growth is over four rows, denominators under the guard give null.
    """
    by = Window.partitionBy("instrument").orderBy("end")
    four = by.rowsBetween(-3, 0)
    ttm = lambda x: F.when(F.count(x).over(four) >= 3, F.sum(x).over(four))
    rows = table.withColumns({f"_{x}": ttm(x) for x in ("revenue", "net_income")})
    over = lambda a, b: F.when(F.abs(b) > guard, a / b)
    before = F.lag("_revenue", 4).over(by)
    rows = rows.select("instrument", "end", F.date_add("end", lag_days).alias("known"), over(F.col("_net_income"), F.col("_revenue")).alias("net_margin"), over(F.col("_revenue"), F.col("assets")).alias("turnover"), over(F.col("_revenue") - before, F.abs(before)).alias("revenue_growth"))
    return keep_last(rows.withColumn("month", F.trunc("known", "month")), ["instrument", "month"], ["known", "end"]).select("instrument", "month", "net_margin", "turnover", "revenue_growth")


def macro_features(raw: DataFrame, market: DataFrame) -> DataFrame:
    """date and the macro columns of a daily table (date, vix, y10, y3m, dollar, hyg) and the market's level; one row a date."""
    by = Window.orderBy("date")
    ago = lambda c: F.lag(c, 21).over(by)
    last = by.rowsBetween(-199, 0)
    trend = market.select("date", F.when(F.count("level").over(last) >= 100, F.col("level") / (F.avg("level").over(last) + 1e-9) - 1).alias("market_trend_spx"))
    return raw.select(
        "date", F.col("vix").alias("vix_level"), safe_div(F.col("vix"), ago("vix")).alias("_v"), (F.col("vix") / 20).alias("market_vol_regime"), (F.col("y10") / 100).alias("yield_10y"), ((F.col("y10") - ago("y10")) / 100).alias("yield_change_21d"),
        ((F.col("y10") - F.col("y3m")) / 100).alias("yield_spread_10y2y"), F.col("dollar").alias("dollar_index"), (safe_div(F.col("hyg"), ago("hyg")) - 1).alias("credit_proxy_change"),
    ).withColumn("vix_change_21d", F.col("_v") - 1).drop("_v").join(trend, "date", "left")


def by_date_only(rows: DataFrame, macro: DataFrame, columns: list[str], days: int = 35) -> DataFrame:
    """rows with macro columns of the last macro date at or before theirs: found once for each different date, then broadcast."""
    dates = rows.select("date").distinct().withColumn("_all", F.lit(1))
    known = asof_join(dates, macro.withColumn("_all", F.lit(1)), by="_all", columns=tuple(columns), days=days).drop("_all")
    return rows.join(F.broadcast(known), "date", "left")


def rate_expectations(raw: DataFrame) -> DataFrame:
    """date, fed_hike_prob, fed_cut_prob, recession_prob, policy_uncertainty, vix_term_structure, pred_market_sentiment; one row a date.

    The change of the short rate over 21 rows stands for what is expected; recession is a probit of the curve's slope; the
    sentiment is the mean of what is known of three z-scores against all rows before, of 21 at least.
    """
    by = Window.orderBy("date")
    before = by.rowsBetween(Window.unboundedPreceding, 0)
    rows = raw.withColumn("change", F.col("y3m") - F.lag("y3m", 21).over(by))
    held = F.greatest(F.least(F.col("change"), F.lit(2.0)), F.lit(-2.0))
    held = F.when(F.col("change").isNotNull(), held)
    rows = rows.withColumns({
        "fed_hike_prob": F.when(held.isNotNull(), F.greatest(held, F.lit(0.0)) / 2), "fed_cut_prob": F.when(held.isNotNull(), F.greatest(-held, F.lit(0.0)) / 2), "recession_prob": normal_cdf(-0.57 - 0.83 * (F.col("y10") - F.col("y3m"))),
        "vix_term_structure": F.when(F.col("vix") != 0, F.col("dollar") / F.col("vix")),
    }).withColumn("policy_uncertainty", F.greatest("fed_hike_prob", "fed_cut_prob"))
    z = lambda c: F.when(F.count(c).over(before) >= 21, F.try_divide(F.col(c) - F.avg(c).over(before), F.stddev_samp(c).over(before)))
    rows = rows.withColumns({f"_z{i}": z(c) for i, c in enumerate(("change", "recession_prob", "vix_term_structure"))})
    known = F.array_compact(F.array("_z0", "_z1", "_z2"))
    mean = F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda a, x: a + x) / F.size(known))
    return rows.withColumn("pred_market_sentiment", mean).select("date", "fed_hike_prob", "fed_cut_prob", "recession_prob", "policy_uncertainty", "vix_term_structure", "pred_market_sentiment")


def short_features(rows: DataFrame, positions: DataFrame, days: int = 75, publication_days: int = 8) -> DataFrame:
    """instrument, month and four ratios of the last short position published at or before each row's date.

    rows: instrument, month, date, shares_out. positions: instrument, settled, position, previous, days_to_cover.
    """
    found = positions.withColumn("known", F.date_add("settled", publication_days))
    known = known_at(rows, found, ["position", "previous", "days_to_cover"], days, "known")
    share = F.when(F.col("shares_out") != 0, F.col("position") / F.col("shares_out"))
    out = known.select(
        "instrument", "month", share.alias("short_pct_float"), F.col("days_to_cover").alias("short_interest_ratio"), F.when(F.col("previous") != 0, (F.col("position") - F.col("previous")) / F.col("previous")).alias("short_change_2w"),
        (share * F.col("days_to_cover")).alias("short_squeeze_risk"),
    )
    return clipped(out, ["short_pct_float", "short_interest_ratio", "short_change_2w", "short_squeeze_risk"])


def holdings(trades: DataFrame) -> DataFrame:
    """instrument, end and four columns of who holds how much, of a table (instrument, end, holder, amount)."""
    each = trades.groupBy("instrument", "end", "holder").agg(F.sum("amount").alias("a"))
    out = each.groupBy("instrument", "end").agg(F.sum("a").alias("_t"), F.sum(F.col("a") * F.col("a")).alias("_q"), F.count("*").alias("num_institutions"))
    whole = F.sum("_t").over(Window.partitionBy("end"))
    out = out.withColumns({"inst_own_pct": F.col("_t") / whole, "inst_concentration": F.col("_q") / (F.col("_t") * F.col("_t"))})
    change = F.col("inst_own_pct") - F.lag("inst_own_pct").over(Window.partitionBy("instrument").orderBy("end"))
    return out.withColumn("inst_own_change", change).drop("_t", "_q")


def _month_ends_after(day: Column, days: int) -> Column:
    """The month ends from a day to `days` later."""
    return F.filter(F.transform(F.sequence(F.trunc(day, "month"), F.trunc(F.date_add(day, days), "month"), F.expr("interval 1 month")), lambda m: F.last_day(m)), lambda e: e <= F.date_add(day, days))


def filing_counts(filings: DataFrame) -> DataFrame:
    """instrument, date (month end), filings and log activity of the 30 and 90 days up to it, for months from the first filing on.

    A filing is dealt to the few month ends that it counts for, so that no range is joined.
    """
    counted = filings.select("instrument", "day", F.explode(_month_ends_after(F.col("day"), 90)).alias("date"))
    sums = counted.groupBy("instrument", "date").agg(F.count(F.when(F.datediff("date", "day") <= 30, 1)).alias("n30"), F.count("*").alias("n90"))
    final = F.lit(filings.agg(F.max("day")).first()[0]).cast("date")
    months = filings.groupBy("instrument").agg(F.trunc(F.min("day"), "month").alias("first"))
    months = months.select("instrument", F.explode(F.sequence("first", F.trunc(final, "month"), F.expr("interval 1 month"))).alias("m")).select("instrument", F.last_day("m").alias("date"))
    rows = months.join(sums, ["instrument", "date"], "left").select("instrument", "date", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n30", "n90")])
    return rows.select("instrument", "date", F.col("n30").alias("insider_filings_30d"), F.col("n90").alias("insider_filings_90d"), F.log1p(F.col("n30").cast("double")).alias("insider_activity_30d"), F.log1p(F.col("n90").cast("double")).alias("insider_activity_90d"))


def tone_windows(headlines: DataFrame) -> DataFrame:
    """instrument, date (month end), mean, spread, momentum against the 30 days before, and log volume of 30 days of tones."""
    dealt = headlines.select("instrument", "day", "tone", F.explode(_month_ends_after(F.col("day"), 60)).alias("date")).withColumn("age", F.datediff("date", "day"))
    now, old = F.when(F.col("age") <= 30, F.col("tone")), F.when((F.col("age") > 30) & (F.col("age") <= 60), F.col("tone"))
    sums = dealt.groupBy("instrument", "date").agg(F.avg(now).alias("m"), F.stddev_samp(now).alias("s"), F.count(now).alias("n"), F.avg(old).alias("o")).filter("n > 0")
    return sums.select("instrument", "date", F.col("m").alias("sentiment_mean_30d"), F.when(F.col("n") > 1, F.col("s")).otherwise(0.0).alias("sentiment_std_30d"), (F.col("m") - F.coalesce("o", "m")).alias("sentiment_momentum_30d"), F.log1p(F.col("n").cast("double")).alias("news_volume_30d"))


def first_by(table: DataFrame, base: str, name: str) -> DataFrame:
    """base, name: the first name of each base wins."""
    return table.groupBy(base).agg(F.min(name).alias(name))


def with_gaps(monthly: DataFrame, x: str) -> DataFrame:
    """instrument, month, x and its change: every month from an instrument's first to its last, null where it has no row.

    The change is of the last known value over the month before, so a gap gives zero and then the whole move.
    """
    span = monthly.groupBy("instrument").agg(F.min("month").alias("a"), F.max("month").alias("b"))
    months = span.select("instrument", F.explode(F.sequence("a", "b", F.expr("interval 1 month"))).alias("month"))
    rows = months.join(monthly.select("instrument", "month", x), ["instrument", "month"], "left")
    by = Window.partitionBy("instrument").orderBy("month")
    rows = rows.withColumn("_known", F.last(x, ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    old = F.lag("_known").over(by)
    return rows.withColumn("change", F.when(old != 0, F.col("_known") / old - 1)).drop("_known")


def first_names(panel: DataFrame, most: int = 520) -> DataFrame:
    """At most `most` rows of each month, by instrument."""
    return panel.withColumn("_k", F.row_number().over(Window.partitionBy("month").orderBy("instrument"))).filter(F.col("_k") <= most).drop("_k")


def attrition(df: DataFrame, steps: list[tuple[str, Column]]) -> DataFrame:
    """step, n_in, n_out, dropped of filters one after the other, in one pass."""
    flags, whole = [], F.lit(True)
    for _, condition in steps:
        whole = whole & F.coalesce(condition, F.lit(False))
        flags.append(whole)
    counts = df.agg(F.count("*").alias("n0"), *[F.count(F.when(f, 1)).alias(f"n{i + 1}") for i, f in enumerate(flags)])
    rows = F.array(*[F.struct(F.lit(name).alias("step"), F.col(f"n{i}").alias("n_in"), F.col(f"n{i + 1}").alias("n_out")) for i, (name, _) in enumerate(steps)])
    return counts.select(F.explode(rows).alias("x")).select("x.*").withColumn("dropped", F.col("n_in") - F.col("n_out"))


def pillar_votes(table: DataFrame) -> DataFrame:
    """Rows (instrument, month and ratios) with the votes of four pillars and their sum's z in the month.

    A pillar with several ratios is the mean vote of those that are known, 0 if none is.
    """
    vote = lambda c, up, down: F.when(F.col(c).isNotNull(), F.when(F.col(c) > up, 1.0).when(F.col(c) < down, -1.0).otherwise(0.0))

    def mean_of(*votes: Column) -> Column:
        known = F.array_compact(F.array(*votes))
        return F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda a, x: a + x) / F.size(known)).otherwise(0.0)

    debt, pe = F.col("debt_to_equity"), F.col("pe_ratio")
    rows = table.withColumns({
        "profit": mean_of(vote("roe", 0.15, 0.05), vote("gross_margin", 0.40, 0.20), vote("roa", 0.08, 0.02)), "growth": mean_of(vote("revenue_growth_yoy", 0.10, 0.0), vote("eps_growth_yoy", 0.10, 0.0)),
        "health": F.when(debt < 0.5, 1.0).when(debt > 2.0, -1.0).otherwise(0.0), "value": F.when(pe.between(10, 25), 1.0).when((pe < 0) | (pe > 40), -1.0).otherwise(0.0),
    })
    rows = rows.withColumn("raw", F.round(F.col("profit") + F.col("growth") + F.col("health") + F.col("value"), 9))
    month = Window.partitionBy("month")
    z = (F.col("raw") - F.avg("raw").over(month)) / (F.stddev_pop("raw").over(month) + 1e-8)
    return rows.select("instrument", "month", "profit", "growth", "health", "value", z.alias("fund_score"))


#: How each rule moves groups of sectors where its series is in the top or the bottom quarter of its history.
SECTOR_RULES = [
    ("vix", {"defensive": (1, -1), "cyclical": (-1, 1), "growth": (-1, 1)}), ("spread", {"financial": (1, -1)}), ("rates", {"rate_sensitive": (-1, 1), "financial": (1, -1)}),
    ("recession", {"defensive": (1, 0), "cyclical": (-1, 1)}), ("momentum", {"growth": (1, -1), "cyclical": (0.5, 0), "defensive": (0, 1)}),
]


def sector_votes(macro: DataFrame, sectors: dict[str, list[str]]) -> DataFrame:
    """month, sector, raw, macro_sector_score: votes of five rules on a month's macro state, as a z over the sectors.

    macro: a row a month with the rules' series; sectors: the groups that each sector belongs to.
    """
    order = lambda c: Window.orderBy(F.col(c).asc_nulls_last())
    whole = Window.partitionBy()
    # a row a month: average ranks as shares
    shares = {f"_p_{c}": F.when(F.col(c).isNotNull(), (F.rank().over(order(c)) + (F.count(F.lit(1)).over(Window.partitionBy(c)) - 1) / 2) / F.count(c).over(whole)) for c, _ in SECTOR_RULES}
    votes = []
    for c, moves in SECTOR_RULES:
        for group, (up, down) in moves.items():
            votes.append(F.struct(F.lit(group).alias("g"), F.when(F.col(f"_p_{c}") > 0.75, float(up)).when(F.col(f"_p_{c}") < 0.25, float(down)).otherwise(0.0).alias("v")))
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("sector"), F.array(*map(F.lit, g)).alias("groups")) for s, g in sorted(sectors.items())]))
    rows = macro.withColumns(shares).select("month", F.array(*votes).alias("votes"), each.alias("s"))
    score = F.aggregate(F.filter("votes", lambda v: F.array_contains(F.col("s.groups"), v["g"])), F.lit(0.0), lambda a, v: a + v["v"])
    rows = rows.select("month", "s.sector", score.alias("raw"))
    month = Window.partitionBy("month")
    return rows.select("month", "sector", "raw", ((F.col("raw") - F.avg("raw").over(month)) / (F.stddev_pop("raw").over(month) + 1e-8)).alias("macro_sector_score"))
