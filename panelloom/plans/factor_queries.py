"""Queries of the daily feature families, and their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelloom.operators import factors
from panelloom.plans import oracle as q
from panelloom.sources import bars as src

E = "1e-9"


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[(F.round(c, digits) + 0).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = src.table(spark, sf_dir, "lineitem")
    return src.with_returns(src.daily_bars(lines), src.market_of(lines))


def _family(name: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        base = prepared(spark, sf_dir)
        out = factors.FAMILIES[name](base)
        return rounded(out.select("instrument", "date", *[c for c in out.columns if c not in base.columns and c != "nav"]))

    return query


def daily_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(prepared(spark, sf_dir).drop("t"))


def factor_seasonality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(factors.seasonality(src.month_ends(src.daily_bars(src.table(spark, sf_dir, "lineitem")))))


QUERIES = {"daily_bars": daily_bars, "factor_seasonality": factor_seasonality} | {f"factor_{name}": _family(name) for name in factors.FAMILIES}

up, dn = "(case when r is not null then greatest(r, 0) end)", "(case when r is not null then greatest(-r, 0) end)"
sp = lambda n: q.last(n)
_ma = {f"_ma{n}": q.avg("close", n, max(5, n // 2)) for n in (10, 20, 50, 100, 200)}
_slope = lambda n: f"(case when count(close) over {sp(n)} >= {n} then regr_slope(close, t) over {sp(n)} end / ({q.avg('close', n)} + {E}))"
_r2 = lambda n: f"(case when count(close) over {sp(n)} >= {n} then case when var_pop(close) over {sp(n)} * {n} < 1e-14 then 1 else regr_r2(close, t) over {sp(n)} end end)"
_hi, _lo = q.roll("max", "close", 252, 126), q.roll("min", "close", 252, 120)

ORACLES = {
    "daily_bars": f"with {q.RETURNS} select instrument, date, {q.rounded(['open', 'high', 'low', 'close', 'volume', 'dollar_vol', 'r', 'm'])} from base",
    "factor_momentum": q.staged({f"ret_{n}": q.change(k) for n, k in {"1w": 5, "2w": 10, "1m": 21, "6m": 126, "9m": 189, "12m": 252, "18m": 378, "24m": 504, "36m": 756}.items()}),
    "factor_volatility": q.staged(
        {f"vol_{n}d": q.std("r", n, max(3, n // 3)) for n in (5, 21, 63, 126)},
        {
            "vol_ratio_st": f"vol_5d / (vol_21d + {E})", "vol_trend": f"vol_21d / (vol_63d + {E})", "downvol_21d": q.std("case when r is not null then least(r, 0) end", 21, 10),
            "vol_of_vol_63d": q.std("vol_21d", 63, 30), "vol_contraction_signal": q.flag("vol_21d < 0.85 * vol_63d"), "cand_vol_term_slope": f"vol_5d / (vol_126d + {E})",
        },
    ),
    "factor_tails": q.staged(
        {"_nav": f"product(1 + coalesce(r, 0)) over {q.RUN}"},
        {f"_dd{n}": f"_nav / {q.roll('max', '_nav', n, max(5, n // 3))} - 1" for n in (21, 126)} | {"_cut": q.roll("quantile_cont(X, 0.05)", "r", 21, 5), "_l": f"list(r) filter (where r is not null) over {sp(21)}"},
        {f"maxdd_{n}d": q.roll("min", f"_dd{n}", n, max(5, n // 3)) for n in (21, 126)}
        | {
            "kurt_60d": q.moment("kurtosis", "r", 60, 20), "skew_60d": q.moment("skewness", "r", 60, 20), "var_95_21d": q.roll("quantile_cont(X, 0.05)", "r", 21, 10), "max_ret_21d": q.roll("max", "r", 21, 10),
            "cvar_95_21d": "case when t >= 21 and len(_l) >= 5 then list_avg(list_filter(_l, lambda x: x <= _cut)) end",
            "omega_ratio_21d": f"{q.tot(up, 21, 10)} / ({q.tot(dn, 21, 10)} + {E})", "up_down_vol_ratio": f"{q.std(up, 63, 21)} / ({q.std(dn, 63, 21)} + {E})",
        },
    ),
    "factor_trend": q.staged(
        _ma | {"_hi": _hi, "_lo": _lo, "_sd": q.std("close", 20), "_mu": q.avg("close", 20)},
        {f"price_to_ma{n}": f"close / (_ma{n} + {E}) - 1" for n in (10, 20, 50, 100, 200)}
        | {
            "ma_cross_10_50": f"_ma10 / (_ma50 + {E}) - 1", "ma_cross_50_200": f"_ma50 / (_ma200 + {E}) - 1", "nearness_52w_low": f"close / (_lo + {E}) - 1", "nearness_52w_high": "close / _hi",
            "drawdown_pct_252d": f"close / (_hi + {E}) - 1", "bollinger_pct": f"(close - (_mu - 2 * _sd)) / (4 * _sd + {E})", "trend_slope_21d": _slope(21), "trend_slope_63d": _slope(63), "trend_r2_21d": _r2(21), "trend_r2_126d": _r2(126),
            "price_range_ratio": "(_hi - _lo) / close", "ret_since_52w_low": "(close - _lo) / (_lo + 1e-10)", "above_ma_200": q.flag("close > _ma200"), "above_ma_50": q.flag("close > _ma50"), "price_pct_above_ma200": "(close - _ma200) / _ma200",
            "new_52w_high": q.flag("close >= 0.98 * _hi"), "new_52w_low": q.flag("close <= 1.02 * _lo"),
        },
        {"cand_trend_acceleration": f"trend_slope_21d - {q.lag('trend_slope_21d', 21)}"},
    ),
    "factor_liquidity": q.staged(
        {"dollar_vol_21d": q.avg("close * volume", 21, 10), "dollar_vol_63d": q.avg("close * volume", 63, 21), "_v5": q.avg("volume", 5, 3), "_v21": q.avg("volume", 21, 10), "_v63": q.avg("volume", 63, 21), "_obv": f"sum(sign(coalesce(r, 0)) * volume) over {q.RUN}"},
        {
            "vol_momentum_21d": f"volume / (_v21 + {E}) - 1", "vol_trend_ratio": f"_v21 / (_v63 + {E})", "obv_signal": f"(_obv - {q.lag('_obv', 21)}) / (abs({q.lag('_obv', 21)}) + {E})",
            "amihud_illiq_21d": f"{q.avg(f'abs(r) / (close * volume + {E})', 21, 10)} * 1e6", "size_proxy": "ln(greatest(dollar_vol_63d, case when dollar_vol_63d is null then 0 else 0 end) + 1)", "vol_above_avg": q.flag("volume > 1.5 * _v63"), "high_vol_week": q.flag("_v5 > _v21"),
        },
    ),
    "factor_market_beta": q.staged(
        {
            "beta_21d": q.beta("r", "m", 21, 10), "beta_63d": q.beta("r", "m", 63, 31), "beta_252d": q.beta("r", "m", 252, 126), "corr_spx_21d": q.corr("r", "m", 21, 10), "corr_spx_63d": q.corr("r", "m", 63, 31),
            "up_beta_63d": q.beta("case when r is not null then case when m > 0 then r else 0 end end", "case when m is not null then greatest(m, 0) end", 63, 21),
            "down_beta_63d": q.beta("case when r is not null then case when m < 0 then r else 0 end end", "case when m is not null then least(m, 0) end", 63, 21),
            "_m126": q.tot("m", 126, 60), "_m252": q.tot("m", 252, 120),
        },
        {
            "beta_stability_63d": q.std("beta_21d", 63, 30), "idio_vol_252d": q.std("r - beta_252d * m", 252, 126), "residual_mom_6m": f"{q.change(126)} - coalesce(beta_63d, 1) * _m126", "residual_mom_12m": f"{q.change(252)} - coalesce(beta_63d, 1) * _m252",
        },
    ),
    "factor_co_skewness": q.staged(
        {"_dr": f"r - {q.avg('r', 63, 21)}", "_dm": f"m - {q.avg('m', 63, 21)}"},
        {"co_skewness_63d": f"{q.avg('_dr * _dm * _dm', 63, 21)} / ({q.std('r', 63, 21)} * {q.avg('_dm * _dm', 63, 21)} + 1e-12)"},
    ),
    "factor_microstructure": q.staged(
        {"_range": f"(high - low) / (close + {E})", "_gap": f"open / ({q.lag('close')} + {E}) - 1", "_in": f"(close - open) / (open + {E})", "_oc": "close / open - 1"},
        {
            "avg_hl_range_21d": q.avg("_range", 21, 10), "avg_gap_21d": q.avg("abs(_gap)", 21, 10), "open_to_close_21d": q.avg("_in", 21, 10), "intraday_vol_21d": q.std("_in", 21, 10),
            "earnings_gap": f"case when count(_gap) over {sp(63)} >= 21 then (max({{'a': abs(_gap), 't': t, 'g': _gap}}) filter (where _gap is not null) over {sp(63)}).g end",
            "cand_cum_gap_ret_21d": q.tot("_gap", 21, 10), "cand_cum_intraday_ret_21d": q.tot("_oc", 21, 10), "cand_gap_reversal_21d": q.corr("_gap", "_oc", 21, 10),
            "cand_overnight_vs_intra": f"abs({q.tot('_gap', 21, 10)}) / (abs({q.tot('_gap', 21, 10)}) + abs({q.tot('_oc', 21, 10)}) + {E})", "cand_large_gap_count_63d": q.tot(q.flag("abs(_gap) > 0.02"), 63, 21),
        },
    ),
    "factor_time_signals": q.staged(
        {"_r126": q.change(126), "_r252": q.change(252), "_sd": q.std("r", 126, 42), "_sd252": q.std("r", 252, 84), "_n": f"count(r) over {sp(252)}", "_pos": f"avg({q.flag('r > 0')}) over {sp(252)}", "_r1": q.lag("r")},
        {
            "ir_6m": f"_r126 / (_sd + {E})", "ret_consistency_12m": "case when _n >= 120 then _pos end", "risk_adj_mom_6m": "case when abs(_sd * sqrt(252)) > 1e-10 then _r126 / (_sd * sqrt(252)) end", "risk_adj_mom_12m": "case when abs(_sd252 * sqrt(252)) > 1e-10 then _r252 / (_sd252 * sqrt(252)) end",
            "tsmom_sign_12m": "sign(_r252)::double", "tsmom_sign_6m": "sign(_r126)::double", "tsmom_magnitude": "abs(_r252)", "mom_quality": "_r252 * case when _n >= 120 then _pos end", "post_earnings_drift": q.change(20),
            "serial_corr_sign": f"case when count(r) over {sp(21)} >= 10 then sign({q.corr('r', '_r1', 20, 3)})::double end", "cand_neg_mom_6m": "-_r126", "cand_momentum_gap": f"_r252 - {q.change(21)}", "cand_mom_acceleration_63d": f"{q.change(21)} - {q.change(42)} / 2",
        },
    ),
    "factor_paths": q.staged(
        {"_d": f"abs(close - {q.lag('close')})", "_r1": q.lag("r")},
        {f"cand_path_efficiency_{n}d": f"abs({q.tot('r', n, n // 2)}) / ({q.tot('abs(r)', n, n // 2)} + {E})" for n in (21, 63)}
        | {f"cand_kaufman_er_{n}d": f"abs(close - {q.lag('close', n)}) / ({q.tot('_d', n, n // 2)} + {E})" for n in (21, 63)}
        | {
            "cand_up_path_ratio_21d": f"{q.tot(up, 21, 10)} / ({q.tot('abs(r)', 21, 10)} + {E})", "cand_signed_path_21d": f"{q.tot('abs(r)', 21, 10)} * sign({q.tot('r', 21, 10)})", "cand_return_dispersion_21d": f"{q.std('r', 21, 10)} / ({q.avg('abs(r)', 21, 10)} + {E})",
            "cand_path_skew_21d": q.moment("skewness", "r", 21, 10), "cand_realized_skew_21d": q.moment("skewness", "r", 21, 10), "cand_realized_skew_63d": q.moment("skewness", "r", 63, 21), "cand_directional_persist": q.avg(q.flag("sign(r) = sign(_r1)"), 63, 21), "cand_mom_breadth_63d": q.avg(q.flag("r > 0"), 63, 21),
            "cand_realized_var_ratio": f"{q.avg('r * r', 21, 10)} / (pow({q.std('r', 21, 10)}, 2) + {E})", "cand_frog_in_pan_6m": f"sign({q.change(126)}) * {q.avg(q.flag('r > 0'), 126, 63)}",
        },
    ),
    "factor_volume_price": q.staged(
        {"_clv": "(case when high > low then (2 * close - high - low) / (high - low) else 0 end) * volume", "_smart": "sign(close - (high + low) / 2) * volume"},
        {
            "cand_price_vol_corr_21d": q.corr("r", "volume", 21, 10), "cand_price_vol_corr_63d": q.corr("r", "volume", 63, 21), "cand_vwap_deviation_21d": f"close / ({q.tot('close * volume', 21, 10)} / ({q.tot('volume', 21, 10)} + {E}) + {E}) - 1",
            "cand_volume_at_highs": f"case when count(volume) over {sp(63)} >= 15 then avg(case when r > 0 then volume end) over {sp(63)} / (avg(case when coalesce(r, 0) <= 0 then volume end) over {sp(63)} + {E}) end",
            "cand_accumulation_21d": q.tot("_clv", 21, 10), "cand_smart_money_flow_21d": q.tot("_smart", 21, 10), "cand_kyle_lambda_21d": q.avg("abs(r) / sqrt(greatest(volume, 1))", 21, 10),
        },
    ),
    "factor_drawdowns": q.staged(
        {"_dd": f"close / max(close) over {q.RUN} - 1"},
        {"_u": "_dd < -0.005", "_i": f"sum(case when _dd < -0.005 then 0 else 1 end) over {q.RUN}"},
        {
            "cand_recovery_speed_63d": f"case when count(case when _u and r > 0 then 1 end) over {sp(63)} >= 10 then avg(case when _u and r > 0 then r end) over {sp(63)} end", "cand_time_underwater_126d": q.avg(q.flag("_u"), 126, 63),
            "cand_bounce_from_low_21d": f"close / ({q.roll('min', 'close', 21, 10)} + {E}) - 1", "cand_recovery_ratio_63d": f"(close - {q.roll('min', 'close', 63, 21)}) / ({q.roll('max', 'close', 63, 21)} - {q.roll('min', 'close', 63, 21)} + {E})",
            "cand_pain_index_63d": q.avg("_dd", 63, 21), "cand_drawdown_duration": "sum(case when _u then 1.0 else 0.0 end) over (partition by instrument, _i order by date)::double",
        },
    ),
    "factor_directions": q.staged(
        {
            "_tr": f"case when t > 1 then greatest(high - low, abs(high - {q.lag('close')}), abs(low - {q.lag('close')})) else high - low end", "_u0": f"high - {q.lag('high')}", "_d0": f"{q.lag('low')} - low", "_side": f"sign({q.avg('close', 10, 5)} - {q.avg('close', 50, 25)})", "_ma": q.avg("close", 200, 100),
            "_lv": "ln(greatest(volume, 1))", "_hi": q.roll("max", "close", 252, 126), "_dd": f"close / max(close) over {q.RUN} - 1", "_k": q.moment("kurtosis", "r", 63, 21),
        },
        {"_up": "case when _u0 > _d0 and _u0 > 0 then _u0 else 0.0 end", "_down": "case when _d0 > _u0 and _d0 > 0 then _d0 else 0.0 end"},
        {"_p": f"{q.avg('_up', 14, 7)} / ({q.avg('_tr', 14, 7)} + {E})", "_m": f"{q.avg('_down', 14, 7)} / ({q.avg('_tr', 14, 7)} + {E})"},
        {
            "cand_choppiness_14d": f"100 * log10({q.tot('_tr', 14, 7)} / ({q.roll('max', 'high', 14, 7)} - {q.roll('min', 'low', 14, 7)} + {E})) / log10(14)", "_dx": f"abs(_p - _m) / (_p + _m + {E})", "_turn": q.flag(f"_side <> {q.lag('_side')}"),
            "_mt": f"case when count(_ma) over {sp(63)} >= 32 then regr_slope(_ma, t) over {sp(63)} end", "_lvd": f"_lv - {q.avg('_lv', 63, 21)}", "cand_kurt_change_63d": f"_k - {q.lag('_k', 21)}",
            "_fresh": f"sum(case when coalesce(close >= 0.995 * _hi, true) then 1 else 0 end) over {q.RUN}", "_isle": f"sum(case when _dd < -0.005 then 0 else 1 end) over {q.RUN}",
        },
        {
            "cand_adx_proxy_14d": q.avg("_dx", 14, 7), "cand_trend_break_63d": q.tot("_turn", 63, 21), "ma_200_slope": f"_mt / (avg(abs(_ma)) over {sp(63)} + 1e-10)", "volume_trend": q.avg("_lvd", 21, 10),
            "cand_time_since_high_252d": "case when _fresh > 0 then (row_number() over (partition by instrument, _fresh order by date) - 1)::double end", "_dur": "sum(case when _dd < -0.005 then 1.0 else 0.0 end) over (partition by instrument, _isle order by date)::double",
        },
        {"cand_drawdown_depth_speed": f"{q.roll('min', '_dd', 21, 10)} / greatest({q.roll('max', '_dur', 21, 10)}, 1)"},
    ),
    "factor_shapes": q.staged(
        {
            "_s21": q.std("r", 21, 7), "_s63": q.std("r", 63, 21), "_r21": q.change(21), "_r252": q.change(252), "_v21": q.avg("volume", 21, 10), "_gap": f"open / ({q.lag('close')} + {E}) - 1", "_r1": q.lag("r"), "_cut": q.roll("quantile_cont(X, 0.1)", "r", 126, 42),
            "_w": f"list(r) filter (where r is not null) over {sp(126)}", "_imp": "abs(r) / sqrt(greatest(volume, 1))", "_beta": f"pow(ln(high / low), 2) + pow(ln({q.lag('high')} / {q.lag('low')}), 2)",
            "_gamma": f"pow(ln(greatest(high, {q.lag('high')}) / least(low, {q.lag('low')})), 2)", "_dv": q.avg("close * volume", 21, 10), "_vp": f"var_pop(r) over {sp(21)}",
        },
        {
            "_jump": q.flag("abs(r) > 3 * _s63"), "_gs": "sign(_gap)", "_alpha": "greatest((sqrt(2 * _beta) - sqrt(_beta)) / (3 - 2 * sqrt(2)) - sqrt(_gamma / (3 - 2 * sqrt(2))), case when _beta is not null then 0 end)", "_auto": q.corr("r", "_r1", 21, 10),
            "_dv21": f"_v21 - {q.lag('_v21', 21)}", "_fall": "case when r < 0 then _imp end", "_rise": "case when r > 0 then _imp end",
        },
        {"_gs1": q.lag("_gs"), "_spread": "case when _alpha is null then 0.0 else 2 * (exp(_alpha) - 1) / (1 + exp(_alpha)) end"},
        {
            "cand_jump_intensity_63d": q.tot("_jump", 63, 21), "cand_vol_asymmetry_63d": f"({q.std(up, 63, 21)} - {q.std(dn, 63, 21)}) / ({q.std(up, 63, 21)} + {q.std(dn, 63, 21)} + {E})", "cand_vol_price_divergence": "case when sign(_r21) = sign(_dv21) then 0.0 else 1.0 end::double",
            "cand_gap_persistence_21d": q.corr("_gs", "_gs1", 20, 10), "cand_expected_shortfall_mom": "case when _cut is not null then list_avg(list_filter(_w, lambda x: x <= _cut)) end", "cand_mom_vol_interaction": f"_r252 * {q.flag('_s21 < 0.85 * _s63')}",
            "cand_corwin_schultz_21d": q.avg("_spread", 21, 10), "cand_roll_spread_21d": "sqrt(greatest(-2 * coalesce(_auto, 0) * coalesce(_vp, 0), 0))",
            "cand_price_impact_asym_21d": f"case when count(_fall) over {sp(21)} >= 5 then avg(_fall) over {sp(21)} end / (case when count(_rise) over {sp(21)} >= 5 then avg(_rise) over {sp(21)} end + {E})", "reversal_size": "-_r21 * ln(1 + greatest(_dv, 1e3))",
        },
    ),
    "factor_interactions": q.staged(
        {
            "_r21": q.change(21), "_r126": q.change(126), "_r252": q.change(252), "_v5": q.std("r", 5, 3), "_v21": q.std("r", 21, 7), "_pe": f"abs({q.tot('r', 63, 31)}) / ({q.tot('abs(r)', 63, 31)} + {E})", "_b": q.beta("r", "m", 63, 31), "_c": q.corr("r", "m", 63, 31),
            "_vm": f"volume / ({q.avg('volume', 21, 10)} + {E}) - 1", "_gap": f"open / ({q.lag('close')} + {E}) - 1", "_sk": q.moment("skewness", "r", 60, 20), "_nav": f"product(1 + coalesce(r, 0)) over {q.RUN}", "_dd": f"close / max(close) over {q.RUN} - 1",
            "_hl": f"case when count(r) over {sp(63)} >= 20 then list(r) filter (where r is not null) over {sp(63)} end",
        },
        {
            "_vr": f"_v5 / (_v21 + {E})", "_vov": q.std("_v21", 63, 30), "_ag": q.avg("abs(_gap)", 21, 10), "_ndd": f"_nav / {q.roll('max', '_nav', 21, 7)} - 1", "_u": "_dd < -0.005",
            "_hd": "list_transform(_hl, lambda x: x - list_sum(_hl) / len(_hl))",
        },
        {
            "_mdd": q.roll("min", "_ndd", 21, 7), "_rs": f"case when count(case when _u and r > 0 then 1 end) over {sp(63)} >= 10 then avg(case when _u and r > 0 then r end) over {sp(63)} end",
            "_cum": "list_transform(range(1, len(_hd) + 1), lambda i: list_sum(_hd[1:i]))", "_sd": "sqrt(list_sum(list_transform(_hd, lambda x: x * x)) / len(_hd))",
        },
        {"_h": "case when _sd > 1e-12 and (list_max(_cum) - list_min(_cum)) / _sd > 0 then ln((list_max(_cum) - list_min(_cum)) / _sd) / ln(len(_hd)) end"},
        {
            "cand_mom_x_vol_regime": f"_r252 * {q.flag('_vr > 1.5')}", "cand_reversal_x_vol_spike": f"-_r21 * {q.flag('_vm > 1.0')}", "cand_trend_eff_x_mom_sign": "_pe * sign(_r126)", "cand_beta_change_x_vol": f"(_b - {q.lag('_b', 21)}) * _v21", "cand_hurst_x_mom": "_h * _r252",
            "cand_gap_x_volume": "_ag * _vm", "cand_skew_x_mom": "_sk * _r126", "cand_drawdown_x_recovery": "_mdd * _rs", "cand_vol_of_vol_x_mom": "_vov * abs(_r252)", "cand_corr_change_x_ret": f"(_c - {q.lag('_c', 21)}) * _r21",
        },
    ),
    "factor_seasonality": f"""with {q.BARS}, {q.MONTH_ENDS},
rets as (select instrument, date, month, close / lag(close) over (partition by instrument order by month) - 1 as ret_1m from ends)
select a.instrument, a.date, a.month, round(a.ret_1m, 6) as ret_1m, round(b.ret_1m, 6) as ret_same_month_1y, round(c.ret_1m, 6) as ret_same_month_2y,
  round(case when count(a.ret_1m) over w >= 2 then avg(a.ret_1m) over w end, 6) as ret_same_month_avg,
  {q.flag('day(a.date) <= 3 or a.date = last_day(a.date)')} as turn_of_month, {q.flag('month(a.date) = 1')} as january_dummy
from rets a left join rets b on a.instrument = b.instrument and b.month = a.month - interval 1 year left join rets c on a.instrument = c.instrument and c.month = a.month - interval 2 year
window w as (partition by a.instrument, month(a.month) order by a.month rows between 5 preceding and 1 preceding)""",
}
