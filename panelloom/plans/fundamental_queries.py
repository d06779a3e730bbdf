"""Queries of side tables that are known from a date on, on tables derived from orders, lines and events, and their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelloom.operators import fundamentals as fu
from panelloom.plans import oracle as q, panel_queries as p
from panelloom.plans.factor_queries import rounded
from panelloom.sources import bars as src, landing

FLOWS = ["revenue", "net_income", "op_income", "dep_amort", "gross_profit", "cfo", "buybacks", "eps"]
STOCKS = ["equity", "liabilities", "assets"]
SECTORS = {"AFRICA": ["cyclical", "growth"], "AMERICA": ["financial", "cyclical"], "ASIA": ["growth", "rate_sensitive"], "EUROPE": ["defensive"], "MIDDLE EAST": ["financial", "rate_sensitive"]}


def _instrument(s: SparkSession, d: str, key: str):
    return F.pmod(F.col(key), F.lit(src.table(s, d, "supplier").count())) + 1


def _money(condition=None):
    value = F.col("o_totalprice") if condition is None else F.when(condition, F.col("o_totalprice"))
    return F.coalesce(F.sum(value.cast("decimal(18,2)")).cast("double"), F.lit(0.0))


def facts(s: SparkSession, d: str) -> DataFrame:
    """Facts in long form of each instrument's orders by quarter; flows are filed 45 days after it, stocks 60."""
    status, urgent = F.col("o_orderstatus"), F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
    end = F.last_day(F.add_months(F.trunc("o_orderdate", "quarter"), 2))
    rows = src.table(s, d, "orders").groupBy(_instrument(s, d, "o_custkey").alias("instrument"), end.alias("end"))
    wide = rows.agg(
        _money().alias("revenue"), _money(status == "F").alias("net_income"), _money(status == "O").alias("op_income"), _money(status == "P").alias("dep_amort"), _money(urgent).alias("gross_profit"), _money(~urgent).alias("cfo"),
        (F.count("*") * 1000.0).alias("buybacks"), (_money() / F.count("*")).alias("eps"), (F.max("o_totalprice") * 10).alias("equity"), (F.count("*") * 50000.0).alias("liabilities"), (_money() + F.count("*") * 100000.0).alias("assets"),
    )
    long = wide.unpivot(["instrument", "end"], [*FLOWS, *STOCKS], "field", "val")
    return long.withColumn("filed", F.date_add("end", F.when(F.col("field").isin(*STOCKS), 60).otherwise(45).cast("int")))


def _ends(s, d) -> DataFrame:
    """instrument, month, date (the calendar month's end) and mktcap of the panel's rows."""
    return p.weights(s, d).select("instrument", "month", F.last_day("month").alias("date"), F.col("value").alias("mktcap"))


def _ratios(s, d) -> DataFrame:
    fields = [*FLOWS, *STOCKS]
    return fu.ratios(fu.known_at(_ends(s, d), fu.periods(facts(s, d), fields, FLOWS), fields, 550))


def pit_fundamentals(s, d):
    return rounded(_ratios(s, d), 4)


def pillar_votes(s, d):
    return rounded(fu.pillar_votes(_ratios(s, d)), 4)


def vendor_ratios(s, d):
    wide = facts(s, d).groupBy("instrument", "end").agg(*[F.max(F.when(F.col("field") == f, F.col("val"))).alias(f) for f in ("revenue", "net_income", "assets")])
    return rounded(fu.vendor_ratios(wide), 5)


def _macro(s, d) -> DataFrame:
    o = src.table(s, d, "orders").groupBy(F.col("o_orderdate").cast("date").alias("date"))
    return o.agg((_money() / F.count("*") / 9973).alias("vix"), (F.count("*") / 2).alias("y10"), (F.count(F.when(F.col("o_orderstatus") == "F", 1)) / 2).alias("y3m"), (F.max("o_totalprice") / 1000).alias("dollar"), F.min("o_totalprice").alias("hyg"))


MACRO = ["vix_level", "vix_change_21d", "market_vol_regime", "yield_10y", "yield_change_21d", "yield_spread_10y2y", "dollar_index", "credit_proxy_change", "market_trend_spx"]
EXPECTED = ["fed_hike_prob", "fed_cut_prob", "recession_prob", "policy_uncertainty", "vix_term_structure", "pred_market_sentiment"]


def macro_panel(s, d):
    macro = fu.macro_features(_macro(s, d), src.market(src.daily_bars(src.table(s, d, "lineitem"))))
    return rounded(fu.by_date_only(_ends(s, d).drop("mktcap"), macro, MACRO), 5)


def rate_expectations(s, d):
    return rounded(fu.rate_expectations(_macro(s, d)), 5)


def sector_votes(s, d):
    macro = fu.macro_features(_macro(s, d), src.market(src.daily_bars(src.table(s, d, "lineitem")))).join(fu.rate_expectations(_macro(s, d)).select("date", "recession_prob"), "date")
    pick = lambda c: F.max_by(F.round(c, 8), "date")
    months = macro.groupBy(F.trunc("date", "month").alias("month")).agg(pick("vix_level").alias("vix"), pick("yield_spread_10y2y").alias("spread"), pick("yield_change_21d").alias("rates"), pick("recession_prob").alias("recession"), pick("market_trend_spx").alias("momentum"))
    return rounded(fu.sector_votes(months, SECTORS), 5)


def short_interest(s, d):
    """Positions of half-months from the lines shipped in them, against the month's shares out."""
    day = F.col("l_shipdate").cast("date")
    settled = F.when(F.dayofmonth(day) <= 15, F.date_add(F.trunc(day, "month"), 14)).otherwise(F.last_day(day))
    half = src.table(s, d, "lineitem").groupBy(F.col("l_suppkey").alias("instrument"), settled.alias("settled")).agg(F.sum("l_quantity").alias("position"), (F.sum("l_quantity") / F.countDistinct(day)).alias("per_day"))
    half = half.select("instrument", "settled", "position", F.lag("position").over(Window.partitionBy("instrument").orderBy("settled")).alias("previous"), (F.col("position") / F.col("per_day")).alias("days_to_cover"))
    ends = p.panel(s, d).select("instrument", "month", "close").join(_ends(s, d), ["instrument", "month"]).select("instrument", "month", "date", F.when(F.col("close") != 0, F.col("mktcap") / F.col("close")).alias("shares_out"))
    return rounded(fu.short_features(ends, half), 5)


def institutional(s, d):
    """Quarterly holdings by order, known for 185 days."""
    end = F.last_day(F.add_months(F.trunc("l_shipdate", "quarter"), 2))
    trades = src.table(s, d, "lineitem").select(F.col("l_suppkey").alias("instrument"), end.alias("end"), F.col("l_orderkey").alias("holder"), F.col("l_quantity").alias("amount"))
    table = fu.holdings(trades).withColumn("filed", F.col("end"))
    return rounded(fu.known_at(_ends(s, d).drop("mktcap"), table, ["inst_own_pct", "inst_own_change", "num_institutions", "inst_concentration"], 185))


def _events(s, d):
    return src.table(s, d, "events").select(_instrument(s, d, "user_id").alias("instrument"), F.col("ts").cast("date").alias("day"), (F.col("value") / 7).alias("tone"), "event_type")


def insider_counts(s, d):
    return rounded(fu.filing_counts(_events(s, d)))


def tone_windows(s, d):
    return rounded(fu.tone_windows(_events(s, d)))


def filing_index(s, d):
    """Filings by form and day, landed as parallel arrays in JSON, as a filing index gives them."""
    rows = _events(s, d).groupBy("instrument").agg(F.sort_array(F.collect_list(F.struct("day", "event_type"))).alias("x"))
    landed = rows.select("instrument", F.to_json(F.struct(F.col("x.event_type").alias("form"), F.col("x.day").alias("filingDate"))).alias("json"))
    return landing.filing_index(landed, ["click", "purchase"], "2000-01-01").groupBy("instrument", "form", "filed").agg(F.count("*").alias("n"))


def first_in_nation(s, d):
    """Customers' balances by the first supplier of their nation; nations without one are dropped."""
    first = fu.first_by(src.table(s, d, "supplier"), "s_nationkey", "s_suppkey")
    rows = src.table(s, d, "customer").join(F.broadcast(first), F.col("c_nationkey") == F.col("s_nationkey"))
    return rows.groupBy(F.col("s_suppkey").alias("instrument")).agg(F.count("*").alias("customers"), F.sum(F.col("c_acctbal").cast("decimal(18,2)")).cast("double").alias("balance"))


def gap_months(s, d):
    return rounded(fu.with_gaps(p.panel(s, d).select("instrument", "month", "close"), "close"))


def first_names(s, d):
    return rounded(fu.first_names(p.panel(s, d), 40).select("month", "instrument", "ret_1m"))


def largest_moves(s, d):
    """The fifty largest moves of a month, up or down, largest first; ties by month and instrument."""
    rows = p.panel(s, d).filter("ret_1m is not null").select("month", "instrument", (F.round("ret_1m", 6) + 0).alias("ret_1m"))
    return rows.orderBy(F.abs("ret_1m").desc(), "month", "instrument").limit(50)


def attrition(s, d):
    rows = p.panel(s, d).join(p.weights(s, d), ["month", "instrument"], "left")
    return fu.attrition(rows, [("has a weight", F.col("weight").isNotNull()), ("weight", F.col("weight") >= 0.003), ("target", F.col("fwd_ret_1m").isNotNull()), ("size", F.abs("fwd_ret_1m") <= 1)])


def column_roles(s, d):
    """What the prefix of each column of the panel says of its treatment."""
    names = p.panel(s, d).columns
    role = F.when(F.col("column").isin("instrument", "month", "date"), "key").when(F.col("column").startswith("fwd_"), "target").when(F.col("column").rlike("^(ret|mom|rev|ir)_"), "ranked").when(F.col("column").rlike("^vol_"), "risk").otherwise("other")
    return s.createDataFrame([(c,) for c in names], "column string").withColumn("role", role)


QUERIES = {f.__name__: f for f in (
    pit_fundamentals, pillar_votes, vendor_ratios, macro_panel, rate_expectations, sector_votes, short_interest, institutional, insider_counts, tone_windows, filing_index, first_in_nation, gap_months, first_names, largest_moves, attrition, column_roles,
)}

_N = "(select count(*) from supplier)"
_OW = f"""ow as (select o_custkey % {_N} + 1 as instrument, last_day(date_trunc('quarter', o_orderdate)::date + interval 2 month)::date as "end", coalesce(sum(o_totalprice::decimal(18,2))::double, 0) as revenue,
  {', '.join(f"coalesce(sum(o_totalprice::decimal(18,2)) filter (where {c})::double, 0) as {n}" for n, c in (('net_income', "o_orderstatus = 'F'"), ('op_income', "o_orderstatus = 'O'"), ('dep_amort', "o_orderstatus = 'P'"), ('gross_profit', "o_orderpriority in ('1-URGENT', '2-HIGH')"), ('cfo', "o_orderpriority not in ('1-URGENT', '2-HIGH')")))},
  count(*) * 1000.0::double as buybacks, sum(o_totalprice::decimal(18,2))::double / count(*) as eps, max(o_totalprice) * 10 as equity, count(*) * 50000.0::double as liabilities, sum(o_totalprice::decimal(18,2))::double + count(*) * 100000.0::double as assets from orders group by 1, 2)"""
_ENDS = f"{p._W}, en as (select instrument, month, last_day(month) as date, value as mktcap from wt)"
_known = lambda c: f"case when date_diff('day', filed, date) <= 550 then {c} end as {c}"
_clip = lambda t, cols: ", ".join(f"case when {c} is not null then greatest(least({c}, (select quantile_cont({c}, 0.995) from {t})), (select quantile_cont({c}, 0.005) from {t})) end as {c}" for c in cols)
_over = lambda a, b: f"case when {b} <> 0 then {a} / {b} end"
_lag12 = lambda c: f"lag({c}, 12) over (partition by instrument order by month)"
_FUND = f"""{q.BARS}, {_ENDS}, {_OW},
ttm as (select instrument, "end", ("end" + interval 60 day)::date as filed, {', '.join(f'case when count({f}) over w >= 4 then sum({f}) over w end as {f}' for f in FLOWS)}, equity, liabilities, assets from ow window w as (partition by instrument order by "end" rows between 3 preceding and current row)),
kn as (select en.instrument, month, date, mktcap, {', '.join(_known(f) for f in [*FLOWS, *STOCKS])} from en asof left join ttm on en.instrument = ttm.instrument and en.date >= ttm.filed),
ra as (select instrument, month, date, {_over('mktcap', 'net_income')} as pe_ratio, {_over('mktcap', 'equity')} as pb_ratio, {_over('mktcap', 'revenue')} as ps_ratio, {_over('(mktcap + liabilities)', '(op_income + dep_amort)')} as ev_ebitda, {_over('net_income', 'equity')} as roe,
  {_over('net_income', 'assets')} as roa, {_over('gross_profit', 'revenue')} as gross_margin, {_over('liabilities', 'equity')} as debt_to_equity, {_over('(cfo - net_income)', 'assets')} as earnings_quality, {_over('buybacks', 'mktcap')} as buyback_yield,
  case when {_lag12('revenue')} <> 0 then revenue / {_lag12('revenue')} - 1 end as revenue_growth_yoy, case when {_lag12('eps')} <> 0 then eps / {_lag12('eps')} - 1 end as eps_growth_yoy from kn),
rc as (select instrument, month, date, {_clip('ra', fu.RATIOS)} from ra)"""
_vote = lambda c, up, dn: f"case when {c} is not null then case when {c} > {up} then 1.0 when {c} < {dn} then -1.0 else 0.0 end end"
_mean = lambda *v: f"coalesce(list_avg(list_filter([{', '.join(v)}], lambda x: x is not null)), 0)"
_MAC = """ma as (select o_orderdate::date as date, sum(o_totalprice::decimal(18,2))::double / count(*) / 9973 as vix, count(*) / 2 as y10, count(*) filter (where o_orderstatus = 'F') / 2 as y3m, max(o_totalprice) / 1000 as dollar, min(o_totalprice) as hyg from orders group by 1)"""
_MF = f"""{q.BARS}, {q.MARKET}, {_MAC}, tr as (select date, case when count(level) over w >= 100 then level / (avg(level) over w + 1e-9) - 1 end as market_trend_spx from market window w as (order by date rows between 199 preceding and current row)),
mf as (select date, vix as vix_level, vix / lag(vix, 21) over o - 1 as vix_change_21d, vix / 20 as market_vol_regime, y10 / 100 as yield_10y, (y10 - lag(y10, 21) over o) / 100 as yield_change_21d, (y10 - y3m) / 100 as yield_spread_10y2y, dollar as dollar_index, hyg / lag(hyg, 21) over o - 1 as credit_proxy_change, market_trend_spx
  from ma left join tr using (date) window o as (order by date))"""
_phi = lambda x: f"""greatest(0, least(1, 0.5 + exp(-pow({x}, 2) / 2) / sqrt(2 * pi()) * list_sum(list_transform(range(0, 121), lambda k: sign({x}) * case when {x} = 0 then 0 else exp((2 * k + 1) * ln(abs({x})) - (lgamma(2 * k + 2) - k * ln(2) - lgamma(k + 1))) end))))"""
_zz = lambda c: f"case when count({c}) over w >= 21 and stddev_samp({c}) over w <> 0 then ({c} - avg({c}) over w) / stddev_samp({c}) over w end"
_RE = f"""r0 as (select date, y10, y3m, vix, dollar, y3m - lag(y3m, 21) over (order by date) as change, -0.57 - 0.83 * (y10 - y3m) as x from ma),
r1 as (select date, change, case when change is not null then greatest(greatest(least(change, 2), -2), 0) / 2 end as fed_hike_prob, case when change is not null then greatest(-greatest(least(change, 2), -2), 0) / 2 end as fed_cut_prob, {_phi('x')} as recession_prob, case when vix <> 0 then dollar / vix end as vix_term_structure from r0),
r2 as (select *, greatest(fed_hike_prob, fed_cut_prob) as policy_uncertainty, {_zz('change')} as z0, {_zz('recession_prob')} as z1, {_zz('vix_term_structure')} as z2 from r1 window w as (order by date rows between unbounded preceding and current row)),
re as (select *, list_avg(list_filter([z0, z1, z2], lambda z: z is not null)) as pred_market_sentiment from r2)"""
_EV = f"ev as (select user_id % {_N} + 1 as instrument, ts::date as day, value / 7 as tone, event_type from events)"
_SHORT = ["short_pct_float", "short_interest_ratio", "short_change_2w", "short_squeeze_risk"]
_pr = lambda c: f"case when {c} is not null then (rank() over (order by {c} nulls last) + (count(*) over (partition by {c}) - 1) / 2.0) / count({c}) over () end as p_{c}"


def _sector_sql() -> str:
    rows = []
    for sector, groups in sorted(SECTORS.items()):
        terms = [f"case when p_{c} > 0.75 then {up} when p_{c} < 0.25 then {down} else 0 end" for c, moves in fu.SECTOR_RULES for g, (up, down) in moves.items() if g in groups]
        rows.append(f"select month, '{sector}' as sector, ({' + '.join(terms)})::double as raw from sq")
    return " union all ".join(rows)


ORACLES = {
    "pit_fundamentals": f"with {_FUND} select instrument, month, date, {q.rounded(fu.RATIOS, 4)} from rc",
    "pillar_votes": f"""with {_FUND}, v as (select instrument, month, {_mean(_vote('roe', 0.15, 0.05), _vote('gross_margin', 0.40, 0.20), _vote('roa', 0.08, 0.02))} as profit, {_mean(_vote('revenue_growth_yoy', 0.10, 0.0), _vote('eps_growth_yoy', 0.10, 0.0))} as growth,
  (case when debt_to_equity < 0.5 then 1.0 when debt_to_equity > 2.0 then -1.0 else 0.0 end)::double as health, (case when pe_ratio between 10 and 25 then 1.0 when pe_ratio < 0 or pe_ratio > 40 then -1.0 else 0.0 end)::double as value from rc),
w as (select *, round(profit + growth + health + value, 9) as raw from v)
select instrument, month, {q.rounded(['profit', 'growth', 'health', 'value'], 4)}, round((raw - avg(raw) over m) / (stddev_pop(raw) over m + 1e-8), 4) + 0 as fund_score from w window m as (partition by month)""",
    "vendor_ratios": f"""with {_OW}, t as (select instrument, "end", assets, case when count(*) over w >= 3 then sum(revenue) over w end as r, case when count(*) over w >= 3 then sum(net_income) over w end as n from ow window w as (partition by instrument order by "end" rows between 3 preceding and current row)),
x as (select instrument, "end", ("end" + interval 45 day)::date as known, case when abs(r) > 1e6 then n / r end as net_margin, case when abs(assets) > 1e6 then r / assets end as turnover, lag(r, 4) over (partition by instrument order by "end") as r4, r from t),
y as (select *, date_trunc('month', known)::date as month, case when abs(r4) > 1e6 then (r - r4) / abs(r4) end as revenue_growth from x)
select instrument, month, {q.rounded(['net_margin', 'turnover', 'revenue_growth'], 5)} from y qualify row_number() over (partition by instrument, month order by known desc, "end" desc) = 1""",
    "macro_panel": f"""with {_MF}, {_ENDS}, dd as (select distinct date from en), mk as (select dd.date, {', '.join(f"case when date_diff('day', mf.date, dd.date) <= 35 then {c} end as {c}" for c in MACRO)} from dd asof left join mf on dd.date >= mf.date)
select instrument, month, date, {q.rounded(MACRO, 5)} from en left join mk using (date)""",
    "rate_expectations": f"with {_MAC}, {_RE} select date, {q.rounded(EXPECTED, 5)} from re",
    "sector_votes": f"""with {_MF}, {_RE}, sm as (select date_trunc('month', date)::date as month, arg_max_null(round(vix_level, 8), date) as vix, arg_max_null(round(yield_spread_10y2y, 8), date) as spread, arg_max_null(round(yield_change_21d, 8), date) as rates, arg_max_null(round(recession_prob, 8), date) as recession,
  arg_max_null(round(market_trend_spx, 8), date) as momentum from mf join re using (date) group by 1), sq as (select month, {', '.join(_pr(c) for c, _ in fu.SECTOR_RULES)} from sm), sv as ({_sector_sql()})
select month, sector, raw, round((raw - avg(raw) over m) / (stddev_pop(raw) over m + 1e-8), 5) + 0 as macro_sector_score from sv window m as (partition by month)""",
    "short_interest": f"""with {p._P}, {_ENDS}, h0 as (select l_suppkey as instrument, (case when day(l_shipdate) <= 15 then date_trunc('month', l_shipdate) + interval 14 day else last_day(l_shipdate) end)::date as settled, sum(l_quantity) as position, sum(l_quantity) / count(distinct l_shipdate::date) as per_day from lineitem group by 1, 2),
h as (select *, lag(position) over (partition by instrument order by settled) as previous, position / per_day as cover, (settled + interval 8 day)::date as known from h0),
e as (select en.instrument, en.month, en.date, case when close <> 0 then mktcap / close end as shares from en join panel on panel.instrument = en.instrument and panel.month = en.month),
k as (select e.instrument, month, shares, {', '.join(f"case when date_diff('day', known, date) <= 75 then {c} end as {c}" for c in ('position', 'previous', 'cover'))} from e asof left join h on e.instrument = h.instrument and e.date >= h.known),
x as (select instrument, month, {_over('position', 'shares')} as short_pct_float, cover as short_interest_ratio, {_over('(position - previous)', 'previous')} as short_change_2w, {_over('position', 'shares')} * cover as short_squeeze_risk from k),
y as (select instrument, month, {_clip('x', _SHORT)} from x) select instrument, month, {q.rounded(_SHORT, 5)} from y""",
    "institutional": f"""with {q.BARS}, {_ENDS}, a as (select l_suppkey as instrument, last_day(date_trunc('quarter', l_shipdate)::date + interval 2 month)::date as "end", l_orderkey, sum(l_quantity) as a from lineitem group by 1, 2, 3),
t as (select instrument, "end", sum(a) as t, sum(a * a) as s2, count(*) as num_institutions from a group by 1, 2), u as (select *, t / sum(t) over (partition by "end") as inst_own_pct, s2 / (t * t) as inst_concentration from t),
v as (select *, inst_own_pct - lag(inst_own_pct) over (partition by instrument order by "end") as inst_own_change from u),
k as (select en.instrument, month, date, {', '.join(f"case when date_diff('day', v.end, date) <= 185 then {c} end as {c}" for c in ('inst_own_pct', 'inst_own_change', 'num_institutions', 'inst_concentration'))} from en asof left join v on en.instrument = v.instrument and en.date >= v.end)
select instrument, month, date, num_institutions, {q.rounded(['inst_own_pct', 'inst_own_change', 'inst_concentration'])} from k""",
    "insider_counts": f"""with {_EV}, g as (select instrument, last_day(unnest(generate_series(date_trunc('month', min(day)), date_trunc('month', (select max(day) from ev)), interval 1 month)))::date as date from ev group by instrument),
c as (select g.instrument, g.date, count(*) filter (where date_diff('day', day, g.date) <= 30 and day is not null) as a, count(day) as b from g left join ev on ev.instrument = g.instrument and day <= g.date and day >= g.date - interval 90 day group by all)
select instrument, date, a as insider_filings_30d, b as insider_filings_90d, round(ln(1 + a), 6) + 0 as insider_activity_30d, round(ln(1 + b), 6) + 0 as insider_activity_90d from c""",
    "tone_windows": f"""with {_EV}, g as (select distinct instrument, last_day(m)::date as date from (select instrument, unnest(generate_series(date_trunc('month', day), date_trunc('month', day) + interval 2 month, interval 1 month)) as m from ev)),
c as (select g.instrument, g.date, avg(tone) filter (where date_diff('day', day, g.date) <= 30) as m, stddev_samp(tone) filter (where date_diff('day', day, g.date) <= 30) as s, count(tone) filter (where date_diff('day', day, g.date) <= 30) as n, avg(tone) filter (where date_diff('day', day, g.date) > 30) as o
  from g join ev on ev.instrument = g.instrument and day <= g.date and day >= g.date - interval 60 day group by all)
select instrument, date, round(m, 6) + 0 as sentiment_mean_30d, round(case when n > 1 then s else 0 end, 6) + 0 as sentiment_std_30d, round(m - coalesce(o, m), 6) + 0 as sentiment_momentum_30d, round(ln(1 + n), 6) + 0 as news_volume_30d from c where n > 0""",
    "filing_index": f"with {_EV} select instrument, event_type as form, day as filed, count(*) as n from ev where event_type in ('click', 'purchase') and day >= date '2000-01-01' group by all",
    "first_in_nation": "with f as (select s_nationkey, min(s_suppkey) as instrument from supplier group by 1) select instrument, count(*) as customers, sum(c_acctbal::decimal(18,2))::double as balance from customer join f on c_nationkey = s_nationkey group by 1",
    "gap_months": f"""with {p._P}, g as (select instrument, unnest(generate_series(min(month), max(month), interval 1 month))::date as month from panel group by instrument), x as (select g.instrument, g.month, close, last_value(close ignore nulls) over (partition by g.instrument order by g.month) as known from g left join panel on panel.instrument = g.instrument and panel.month = g.month)
select instrument, month, round(close, 6) + 0 as close, round(known / lag(known) over (partition by instrument order by month) - 1, 6) + 0 as change from x""",
    "first_names": f"with {p._P} select month, instrument, round(ret_1m, 6) + 0 as ret_1m from panel qualify row_number() over (partition by month order by instrument) <= 40",
    "largest_moves": f"with {p._P} select month, instrument, round(ret_1m, 6) + 0 as ret_1m from panel where ret_1m is not null order by abs(round(ret_1m, 6)) desc, month, instrument limit 50",
    "attrition": f"""with {p._P}, {p._W}, r as (select panel.*, weight from panel left join wt using (month, instrument)), c as (select count(*) as n0, count(*) filter (where weight is not null) as n1, count(*) filter (where weight >= 0.003) as n2, count(*) filter (where weight >= 0.003 and fwd_ret_1m is not null) as n3, count(*) filter (where weight >= 0.003 and abs(fwd_ret_1m) <= 1) as n4 from r)
select 'has a weight' as step, n0 as n_in, n1 as n_out, n0 - n1 as dropped from c union all select 'weight', n1, n2, n1 - n2 from c union all select 'target', n2, n3, n2 - n3 from c union all select 'size', n3, n4, n3 - n4 from c""",
    "column_roles": """select * from (values ('instrument', 'key'), ('month', 'key'), ('date', 'key'), ('fwd_ret_1m', 'target'), ('ret_1m', 'ranked'), ('ret_3m', 'ranked'), ('ret_6m', 'ranked'), ('ret_12m', 'ranked'), ('rev_1m', 'ranked'), ('mom_2_12', 'ranked'), ('mom_accel', 'ranked'), ('mom_decel', 'ranked'),
  ('ir_12m', 'ranked'), ('ir_3m', 'ranked'), ('vol_20d', 'risk'), ('vol_60d', 'risk'), ('vol_252d', 'risk'), ('close', 'other'), ('hl_range', 'other')) t("column", role)""",
}
