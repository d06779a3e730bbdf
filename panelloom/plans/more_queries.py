"""Queries of recursions, audits, landed text and JSON, models and streams, and the oracles SQL can give."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelloom.operators import linear, panel as pan, portfolio as pf, quality, series, tones
from panelloom.plans import oracle as q
from panelloom.plans import panel_queries as p
from panelloom.plans.factor_queries import prepared, rounded
from panelloom.sources import bars as src
from panelloom.streaming import events

FACTORS = p.FACTORS
#: A small lexicon of tones.
LEXICON = {"error": -1.0, "and": 0.1, "the": 0.0, "une": 0.2, "der": -0.1, "que": 0.3, "for": 0.05}


def oscillators(s: SparkSession, d: str) -> DataFrame:
    return rounded(series.oscillators(prepared(s, d)), 4)


def _series(f, column):
    def query(s: SparkSession, d: str) -> DataFrame:
        names = column if isinstance(column, list) else [column]
        return rounded(f(prepared(s, d)).select("instrument", "date", *names))

    return query


def audit_report(s, d):
    return rounded(quality.audit(src.daily_bars(src.table(s, d, "lineitem")), p.weights(s, d), p.panel(s, d)), 6)


def refetch_gate(s, d):
    """The panel's returns, of closes weighted by quantity, against those of closes that are plain means of the same lines."""
    lines = src.table(s, d, "lineitem").filter("l_quantity > 0")
    plain = lines.groupBy(F.col("l_suppkey").alias("instrument"), F.col("l_shipdate").cast("date").alias("date")).agg(F.avg(F.col("l_extendedprice") / F.col("l_quantity")).alias("close"))
    ends = src.month_ends(plain)
    new = ends.withColumn("ret_1m", F.col("close") / F.lag("close").over(pan.by_month()) - 1)
    return rounded(quality.refetch_gate(p.panel(s, d), new))


def survivorship(s, d):
    """Instruments are in the index in months in which their weight is four fifths of a mean one; they leave with the last of these."""
    index = p.weights(s, d).withColumn("n", F.count("*").over(pan.cross_section())).filter(F.col("weight") * F.col("n") >= 0.8)
    return rounded(quality.survivorship(p.panel(s, d).join(index.select("month", "instrument"), ["month", "instrument"])))


def lexicon_sentiment(s, d):
    """Mean tone and number of lexicon words per source."""
    words = src.table(s, d, "documents").select("source", F.explode(F.split(F.lower("text"), r"\s+")).alias("word"))
    tone = F.element_at(F.create_map(*[F.lit(x) for kv in LEXICON.items() for x in kv]), F.col("word"))
    hits = words.filter(F.col("word").isin(*LEXICON)).withColumn("tone", tone)
    return rounded(hits.groupBy("source").agg(F.count("*").alias("n"), F.avg(F.col("tone").cast("decimal(9,4)")).cast("double").alias("tone")), 5)


def learned_sentiment(s, d):
    """Mean tone of each source's words, by a lexicon learned from the labelled documents: tones.learned_lexicon."""
    docs, labels = src.table(s, d, "documents"), src.table(s, d, "labels")
    lexicon = tones.learned_lexicon(docs.join(labels.select("doc_id", F.col("quality").alias("good")), "doc_id"), 5)
    return rounded(tones.mean_tones(docs, lexicon, "source"), 5)


def json_props(s, d):
    """A number out of each event's JSON, by type."""
    k = F.from_json("props", "k long")["k"]
    return src.table(s, d, "events").select("event_type", k.alias("k")).groupBy("event_type").agg(F.count("k").alias("n"), F.sum("k").alias("k_sum"), F.max("k").alias("k_max"))


def event_windows(s, d):
    """Daily counts and sums, by running the file stream over what is there."""
    stream = events.windowed_counts(events.read_stream(s, f"{d}/events.parquet*"))
    return rounded(events.run_available(stream, f"{shared_folder(s)}/event_windows-{uuid.uuid4().hex}"), 3).withColumn("start", F.col("start").cast("timestamp_ntz"))


def event_sessions(s, d):
    rows = events.sessions(events.with_time(src.table(s, d, "events")))
    return rows.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


def shared_folder(s: SparkSession) -> str:
    """Where streams keep their state, and fitted folds their rows: under spark.checkpoint.dir. Only a session in one JVM may do without."""
    root = s.conf.get("spark.checkpoint.dir", None) or s.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        master = s.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="panelloom-")
    return f"{root}/panelloom-streams"


def written(s: SparkSession, rows: DataFrame, name: str) -> DataFrame:
    """rows as a table under the shared folder: what is much work and read several times is made once, and outlives lost executors."""
    folder = f"{shared_folder(s)}/{name}-{s.sparkContext.applicationId}-{uuid.uuid4().hex}"
    rows.write.parquet(folder)
    return s.read.parquet(folder)


def _complete(s, d):
    return p.panel(s, d).dropna(subset=[*FACTORS, "fwd_ret_1m"])


def factor_noise(s, d):
    """Edges of the noise band, signals, inflation factors and clusters of the factors' rank correlations."""
    m, n = linear.rank_correlations(_complete(s, d), FACTORS, keep=lambda rows: written(s, rows, "factor-noise"))
    if n < 3:
        return s.createDataFrame([], "factor string, vif double, cluster int, signals int, noise_high double")
    edge = linear.marchenko_pastur(m, n)
    vif, clusters = linear.variance_inflation(m), linear.ward_clusters(m)
    table = [(c, float(round(v, 6)) if np.isfinite(v) else None, int(k), edge["signals"], float(round(edge["high"], 6))) for c, v, k in zip(FACTORS, vif, clusters)]
    return s.createDataFrame(table, "factor string, vif double, cluster int, signals int, noise_high double")


def pca_residuals(s, d):
    return rounded(linear.pca_residuals(_complete(s, d), FACTORS).select("month", "instrument", *FACTORS))


def _walk(model):
    def query(s: SparkSession, d: str) -> DataFrame:
        folds = [(f"{y}-12-31", f"{y + 1}-01-01", f"{y + 1}-12-31") for y in (1997, 1998, 1999)]
        return rounded(linear.walk_forward(_complete(s, d), FACTORS, "fwd_ret_1m", folds, model))

    return query


def walk_forward_backtest(s, d):
    """Scores of the linear model, tilted on the index and costed."""
    scores = _walk("linear")(s, d).join(p.weights(s, d), ["month", "instrument"])
    return rounded(pf.backtest(pf.tilt_by_score(scores, 0.004, p.LEAST)))


def purged_search(s, d):
    """Elastic nets over a small grid, on five folds of months with a month left out on either side."""
    return rounded(linear.purged_search(_complete(s, d), FACTORS, "fwd_ret_1m", [(0.001, 0.5), (0.1, 0.5), (0.1, 1.0)]))


def permutation_importance(s, d):
    return rounded(linear.permutation_importance(_complete(s, d), FACTORS, "fwd_ret_1m", "1998-12-31", keep=lambda rows: written(s, rows, "importance")))


def panel_components(s, d):
    return rounded(linear.components(_complete(s, d), FACTORS, 2, keep=lambda rows: written(s, rows, "components")))


def residual_noise(s, d):
    """The noise-cleaned correlations of the factors, a row a pair."""
    m, n = linear.rank_correlations(_complete(s, d), FACTORS, keep=lambda rows: written(s, rows, "residual-noise"))
    if n < 3:
        return s.createDataFrame([], "a string, b string, rho double")
    m = linear.denoised(m, n)
    return s.createDataFrame([(a, b, float(round(m[i, j], 6))) for i, a in enumerate(FACTORS) for j, b in enumerate(FACTORS) if i < j], "a string, b string, rho double")


QUERIES = {f.__name__: f for f in (purged_search, permutation_importance, panel_components, residual_noise, oscillators, audit_report, refetch_gate, survivorship, lexicon_sentiment, learned_sentiment, json_props, event_windows, event_sessions, factor_noise, pca_residuals, walk_forward_backtest)} | {
    "factor_runs": _series(series.longest_runs, ["cand_max_consec_up_63d", "cand_max_consec_down_63d"]),
    "factor_entropy": _series(series.entropy, "cand_return_entropy_21d"),
    "factor_hurst": _series(series.hurst, "hurst_63d"),
    "factor_volume_rank": _series(series.volume_rank_momentum, "cand_volume_return_mom_21d"),
    "factor_fractal": _series(series.fractal_dimension, "cand_fractal_dim_63d"),
    "walk_forward_linear": _walk("linear"), "walk_forward_forest": _walk("forest"), "walk_forward_boosted": _walk("boosted"), "walk_forward_boosted_ic": _walk("boosted_ic"),
}


def _ewm(x: str, alpha: str, first: int) -> str:
    """Started at row `first`: the closed form of the recursion, a running sum of values over powers."""
    inner = f"case when t > {first} then {alpha} * {x} * pow(1 - {alpha}, -(t - {first})) when t = {first} then {x} end"
    return f"(pow(1 - {alpha}, t - {first}) * sum({inner}) over {q.RUN})"


def _list(n: int) -> str:
    return f"list(r) filter (where r is not null) over {q.last(n)}"


_run_of = lambda op: f"list_reduce(list_prepend({{'n': 0.0, 'm': 0.0}}, list_transform(_w, lambda x: {{'n': case when x {op} 0 then 1.0 else 0.0 end, 'm': 0.0}})), lambda a, b: {{'n': case when b.n > 0 then a.n + 1 else 0.0 end, 'm': greatest(a.m, case when b.n > 0 then a.n + 1 else 0.0 end)}}).m"
_bin = "least(floor((x - list_min(_w)) / (list_max(_w) - list_min(_w)) * 5), 4)"
ORACLES = {
    "oscillators": f"""with {q.RETURNS}, a as (select *, close - {q.lag('close')} as d, greatest(high - low, coalesce(abs(high - {q.lag('close')}), 0), coalesce(abs(low - {q.lag('close')}), 0)) as tr from base),
b as (select *, case when t >= 15 then {_ewm('greatest(d, 0)', '(1/14)', 2)} end as g, case when t >= 15 then {_ewm('greatest(-d, 0)', '(1/14)', 2)} end as l, ({_ewm('close', '(2/13)', 1)} - {_ewm('close', '(2/27)', 1)}) / (close + 1e-9) as macd, {_ewm('tr', '(2/15)', 1)} as atr from a),
c as (select *, {_ewm('macd', '(2/10)', 1)} as sig from b)
select instrument, date, round(100 - 100 / (1 + g / (l + 1e-9)), 4) + 0 as rsi_14, round(macd, 4) + 0 as macd_signal, round(macd - sig, 4) + 0 as macd_hist, round(atr / (close + 1e-9), 4) + 0 as atr_21d_norm from c""",
    "factor_runs": q.staged({"_w": _list(63)}, {"cand_max_consec_up_63d": f"case when len(_w) >= 21 then {_run_of('>')} end", "cand_max_consec_down_63d": f"case when len(_w) >= 21 then {_run_of('<')} end"}),
    "factor_entropy": q.staged(
        {"_w": _list(21)},
        {"_b": f"list_transform(range(5), lambda k: len(list_filter(_w, lambda x: {_bin} = k)) / len(_w))"},
        {"cand_return_entropy_21d": "case when len(_w) >= 10 and list_max(_w) > list_min(_w) then -list_sum(list_transform(list_filter(_b, lambda s: s > 0), lambda s: s * ln(s))) end"},
    ),
    "factor_hurst": q.staged(
        {"_w": _list(63)},
        {"_n": "len(_w)", "_a": "list_avg(_w)"},
        {"_s": "list_transform(range(1, _n + 1), lambda i: list_sum(list_transform(_w[1:i], lambda x: x - _a)))", "_sd": "sqrt(list_avg(list_transform(_w, lambda x: (x - _a) * (x - _a))))"},
        {"hurst_63d": "case when _n >= 20 and _sd > 1e-12 and list_max(_s) > list_min(_s) then ln((list_max(_s) - list_min(_s)) / _sd) / ln(_n) end"},
    ),
    "factor_volume_rank": q.staged(
        {"_v": f"list(volume) over {q.last(21)}"},
        {"_x": "case when len(_v) >= 10 then r * (len(list_filter(_v, lambda x: x < volume)) + (len(list_filter(_v, lambda x: x = volume)) + 1) / 2) / len(_v) end"},
        {"cand_volume_return_mom_21d": q.tot("_x", 21, 10)},
    ),
    "factor_fractal": q.staged(
        {"_w": _list(63)},
        {"_l": "list_sum(list_transform(range(2, len(_w) + 1), lambda i: abs(_w[i] - _w[i - 1])))"},
        {"cand_fractal_dim_63d": "case when len(_w) >= 20 and _l > 0 then 1 + ln(_l / (abs(_w[len(_w)] - _w[1]) + 1e-10)) / ln(len(_w)) end"},
    ),
    "audit_report": f"""with {p._P}, {p._W}, k as (select instrument, date, count(*) as n from bars group by all), m as (select month, sum(weight) as s, max(weight) as w, count(*) as n from wt group by month)
select "check", round(value, 6) + 0 as value, ok from (
select 'repeated bar keys' as "check", count(*) filter (where n > 1)::double as value, count(*) filter (where n > 1) = 0 as ok from k
union all select 'closes not positive', count(*) filter (where close <= 0)::double, count(*) filter (where close <= 0) = 0 from bars
union all select 'closes outside low and high', count(*) filter (where close > high * (1 + 1e-9) or close < low * (1 - 1e-9))::double, count(*) filter (where close > high * (1 + 1e-9) or close < low * (1 - 1e-9)) = 0 from bars
union all select 'volume coverage', avg(case when volume > 0 then 1.0 else 0.0 end), avg(case when volume > 0 then 1.0 else 0.0 end) > 0.95 from bars
union all select 'largest error of a month''s weights', max(round(abs(s - 1), 9)), max(abs(s - 1)) <= 1e-3 from m
union all select 'largest weight', max(round(w, 9)), max(w) <= 0.0801 from m
union all select 'fewest names in a month', min(n)::double, min(n) >= 5 from m
union all select 'missing targets', avg(case when fwd_ret_1m is null then 1.0 else 0.0 end), avg(case when fwd_ret_1m is null then 1.0 else 0.0 end) < 0.1 from panel)""",
    "refetch_gate": f"""with {p._P}, d0 as (select l_suppkey as instrument, l_shipdate::date as date, avg(l_extendedprice / l_quantity) as close from lineitem where l_quantity > 0 group by all),
d1 as (select instrument, date_trunc('month', date)::date as month, arg_max(close, date) as close from d0 group by all), d2 as (select *, close / lag(close) over (partition by instrument order by month) - 1 as b from d1),
e as (select instrument, case when count(*) >= 6 and stddev_pop(ret_1m) * stddev_pop(b) > 1e-15 then corr(ret_1m, b) end as c from panel join d2 using (instrument, month) where ret_1m is not null and b is not null group by instrument)
select count(*) as instruments, round(avg(c), 6) + 0 as mean_corr, round(avg(case when c < 0.95 then 1.0 else 0.0 end), 6) + 0 as share_low, avg(c) > 0.98 and avg(case when c < 0.95 then 1.0 else 0.0 end) < 0.05 as ok from e where c is not null""",
    "survivorship": f"""with {p._P}, {p._W}, ix as (select month, instrument from wt qualify weight * count(*) over (partition by month) >= 0.8), f as (select instrument, month, ret_1m from panel join ix using (instrument, month)),
r as (select *, max(month) over (partition by instrument) as e, max(month) over () as final, row_number() over (partition by instrument order by month desc) as back from f)
select count(distinct instrument) filter (where e < final - interval 1 month) as leavers, count(distinct instrument) filter (where e >= final - interval 1 month) as stayers, round(avg(ret_1m) filter (where e < final - interval 1 month), 6) + 0 as leaver_ret, round(avg(ret_1m) filter (where e >= final - interval 1 month), 6) + 0 as stayer_ret from r where back between 2 and 7""",
    "lexicon_sentiment": f"""with w as (select source, unnest(regexp_split_to_array(lower(text), '\\s+')) as word from documents), l as (select * from (values {', '.join(f"('{k}', {v}::decimal(9,4))" for k, v in LEXICON.items())}) t(word, tone))
select source, count(*) as n, round(sum(tone)::double / count(*), 5) + 0 as tone from w join l using (word) group by source""",
    "learned_sentiment": f"""with w as (select doc_id, source, unnest(regexp_extract_all(lower(text), '[a-z]+')) as word from documents), u as (select distinct w.doc_id, word, quality from w join labels l on l.doc_id = w.doc_id where quality is not null),
t as (select count(*) filter (where quality = 1) as g, count(*) filter (where quality <> 1) as b from labels where quality is not null and doc_id in (select doc_id from documents)),
x as (select word, round(ln((count(*) filter (where quality = 1) + 1.0) / (any_value(g) + 2.0)) - ln((count(*) filter (where quality <> 1) + 1.0) / (any_value(b) + 2.0)), 9) as tone from u cross join t group by word having count(*) >= 5)
select source, count(*) as n, round(avg(tone), 5) + 0 as tone from w join x using (word) group by source""",
    "json_props": "select event_type, count(k) as n, sum(k)::bigint as k_sum, max(k) as k_max from (select event_type, (props->>'k')::bigint as k from events) group by event_type",
    "event_windows": "select date_trunc('day', ts)::timestamp as start, event_type, count(*) as n, round(sum(value::decimal(18,6))::double, 3) + 0 as total from events group by all",
    "event_sessions": """with g as (select user_id, ts, case when ts - lag(ts) over w < interval 12 hours then 0 else 1 end as new from events window w as (partition by user_id order by ts)),
s as (select *, sum(new) over (partition by user_id order by ts rows unbounded preceding) as k from g) select user_id, min(ts) as start, count(*) as n from s group by user_id, k""",
}
