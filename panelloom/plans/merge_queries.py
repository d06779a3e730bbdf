"""Queries that merge landed side tables with the panel, and their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelloom.operators import merging
from panelloom.operators.asof import asof_join
from panelloom.plans import fundamental_queries as fq, oracle as q, panel_queries as p
from panelloom.plans.factor_queries import rounded
from panelloom.sources import bars as src

#: Shares of a quarter are filed so many days after it.
FILED = 45


def _ends(s: SparkSession, d: str) -> DataFrame:
    return p.panel(s, d).select("instrument", "month", F.last_day("month").alias("date"), "close")


def _shares(s: SparkSession, d: str) -> DataFrame:
    """instrument, date, shares: a quarter's lines, known FILED days after it."""
    end = F.last_day(F.add_months(F.trunc("l_shipdate", "quarter"), 2))
    rows = src.table(s, d, "lineitem").groupBy(F.col("l_suppkey").alias("instrument"), end.alias("end")).agg(F.sum("l_quantity").alias("shares"))
    return rows.select("instrument", F.date_add("end", FILED).alias("date"), "shares")


def side_merge(s: SparkSession, d: str) -> DataFrame:
    """The panel under tickers with suffixes, with the tone and number of a day's orders, landed by day under bare tickers."""
    nation = src.table(s, d, "supplier").join(src.table(s, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    names = nation.select(F.col("s_suppkey").alias("instrument"), F.concat(F.lit("S"), F.col("s_suppkey").cast("string"), F.lit("."), F.substring("n_name", 1, 2)).alias("ticker"))
    panel = p.panel(s, d).select("instrument", "month", "ret_1m").join(names, "instrument").drop("instrument")
    day = src.table(s, d, "orders").groupBy(F.concat(F.lit("S"), fq._instrument(s, d, "o_custkey").cast("string")).alias("base"), F.col("o_orderdate").cast("date").alias("date"))
    side = day.agg(F.avg(F.when(F.col("o_orderpriority") == "1-URGENT", 1.0).when(F.col("o_orderpriority") == "5-LOW", -1.0).otherwise(0.0)).alias("order_tone"), F.log1p(F.count("*")).alias("order_volume"))
    return rounded(merging.merge_by_base(panel, side, ["order_tone", "order_volume"]))


def size_with_fallback(s: SparkSession, d: str) -> DataFrame:
    """Sizes by caps, which are known of names with four fifths of a mean weight, and by filed shares of the others."""
    members = p.weights(s, d).join(p.weights(s, d).groupBy("month").agg(F.count("*").alias("names")), "month").filter(F.round(F.col("weight") * F.col("names"), 9) >= 0.8)
    sizes = merging.log_size(_ends(s, d), members.select("instrument", "month", F.col("value").alias("mktcap")), _shares(s, d))
    return rounded(sizes.select("instrument", "month", "log_mktcap", "origin"))


def landed_blocks(s: SparkSession, d: str) -> DataFrame:
    """Month ends with the last filed shares of 185 days and the last short position of 60 days, and their ages."""
    day = F.col("l_shipdate").cast("date")
    settled = F.when(F.dayofmonth(day) <= 15, F.date_add(F.trunc(day, "month"), 14)).otherwise(F.last_day(day))
    short = src.table(s, d, "lineitem").groupBy(F.col("l_suppkey").alias("instrument"), settled.alias("date")).agg(F.sum("l_quantity").alias("short_position"))
    with_shares = asof_join(_ends(s, d).drop("close"), _shares(s, d), columns=("shares",), days=185, days_old="shares_age")
    both = asof_join(with_shares, short, columns=("short_position",), days=60, days_old="short_age")
    return rounded(both.withColumn("short_share", F.when(F.col("shares") > 0, F.col("short_position") / F.col("shares"))))


QUERIES = {f.__name__: f for f in (side_merge, size_with_fallback, landed_blocks)}

_SHARES = f"""sr as (select l_suppkey as instrument, (last_day(date_trunc('quarter', l_shipdate)::date + interval 2 month) + interval {FILED} day)::date as known, sum(l_quantity) as shares from lineitem group by 1, 2)"""
_MONTHS = "pm as (select instrument, month, last_day(month) as date, close from panel)"

ORACLES = {
    "side_merge": f"""with {p._P}, sd as (select 'S' || (o_custkey % (select count(*) from supplier) + 1) as base, o_orderdate::date as date, avg(case o_orderpriority when '1-URGENT' then 1.0 when '5-LOW' then -1.0 else 0.0 end) as order_tone, ln(1 + count(*)) as order_volume from orders group by 1, 2),
ls as (select base, date_trunc('month', date)::date as month, arg_max(order_tone, date) as order_tone, arg_max(order_volume, date) as order_volume from sd group by 1, 2),
tk as (select s_suppkey as instrument, 'S' || s_suppkey as base, 'S' || s_suppkey || '.' || n_name[1:2] as ticker from supplier join nation on s_nationkey = n_nationkey),
j as (select ticker, panel.month, ret_1m, order_tone, order_volume from panel join tk using (instrument) left join ls on ls.base = tk.base and ls.month = panel.month)
select ticker, month, round(ret_1m, 6) + 0 as ret_1m, {', '.join(f"round(coalesce(last_value({c} ignore nulls) over w, 0), 6) + 0 as {c}" for c in ('order_tone', 'order_volume'))} from j window w as (partition by ticker order by month rows between unbounded preceding and current row)""",
    "size_with_fallback": f"""with {p._P}, {p._W}, {_SHARES}, {_MONTHS}, cp as (select instrument, month, value from (select *, count(*) over (partition by month) as names from wt) where round(weight * names, 9) >= 0.8),
k as (select pm.instrument, pm.month, close, case when date_diff('day', known, date) <= 185 then shares end as shares from pm asof left join sr on pm.instrument = sr.instrument and pm.date >= sr.known),
x as (select k.instrument, k.month, case when value > 0 then ln(value) end as cap, case when shares > 0 and close > 0 then ln(shares * close) end as made from k left join cp on cp.instrument = k.instrument and cp.month = k.month)
select instrument, month, round(coalesce(cap, made), 6) + 0 as log_mktcap, case when cap is not null then 'cap' when made is not null then 'shares' end as origin from x""",
    "landed_blocks": f"""with {p._P}, {_SHARES}, {_MONTHS}, st as (select l_suppkey as instrument, (case when day(l_shipdate) <= 15 then date_trunc('month', l_shipdate) + interval 14 day else last_day(l_shipdate) end)::date as settled, sum(l_quantity) as short_position from lineitem group by 1, 2),
k as (select pm.instrument, pm.month, pm.date, case when date_diff('day', known, date) <= 185 then shares end as shares, case when date_diff('day', known, date) <= 185 then date_diff('day', known, date) end::int as shares_age from pm asof left join sr on pm.instrument = sr.instrument and pm.date >= sr.known),
x as (select k.*, case when date_diff('day', settled, date) <= 60 then short_position end as short_position, case when date_diff('day', settled, date) <= 60 then date_diff('day', settled, date) end::int as short_age from k asof left join st on k.instrument = st.instrument and k.date >= st.settled)
select instrument, month, date, shares_age, short_age, {q.rounded(['shares', 'short_position'])}, case when shares > 0 then round(short_position / shares, 6) + 0 end as short_share from x""",
}
