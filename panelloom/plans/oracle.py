"""Pieces of DuckDB SQL that the oracles share: the bars and window phrases, written apart from the DataFrame code."""

from __future__ import annotations

BARS = """bars as (
  select l_suppkey as instrument, l_shipdate::date as date,
    arg_min(l_extendedprice / l_quantity, {'o': l_orderkey, 'n': l_linenumber, 'p': l_partkey, 'e': l_extendedprice, 'q': l_quantity}) as open,
    max(l_extendedprice / l_quantity) as high, min(l_extendedprice / l_quantity) as low,
    sum(l_extendedprice::decimal(18,2))::double / sum(l_quantity) as close, sum(l_quantity) as volume, sum(l_extendedprice::decimal(18,2))::double as dollar_vol
  from lineitem where l_quantity > 0 group by all)"""
MARKET = """market as (select date, level, level / lag(level) over (order by date) - 1 as m
  from (select date, sum(dollar_vol::decimal(18,2))::double / sum(volume) as level from bars group by date))"""
RETURNS = f"""{BARS}, {MARKET}, base as (
  select b.*, m, row_number() over (partition by instrument order by date)::double as t, close / lag(close) over (partition by instrument order by date) - 1 as r
  from bars b left join market using (date))"""
MONTH_ENDS = "ends as (select * from (select *, date_trunc('month', date)::date as month from bars) qualify row_number() over (partition by instrument, month order by date desc) = 1)"
RUN = "(partition by instrument order by date rows between unbounded preceding and current row)"


def last(n: int) -> str:
    return f"(partition by instrument order by date rows between {n - 1} preceding and current row)"


def lag(x: str, k: int = 1) -> str:
    return f"lag({x}, {k}) over (partition by instrument order by date)"


def roll(f: str, x: str, n: int, least: int | None = None) -> str:
    """f is a function's name, or a phrase with X for the value."""
    call = f.replace("X", x) if "X" in f else f"{f}({x})"
    return f"(case when count({x}) over {last(n)} >= {n if least is None else least} then {call} over {last(n)} end)"


def avg(x: str, n: int, least: int | None = None) -> str:
    return roll("avg", x, n, least)


def tot(x: str, n: int, least: int | None = None) -> str:
    return roll("sum", x, n, least)


def std(x: str, n: int, least: int | None = None) -> str:
    return roll("stddev_samp", x, n, least)


def change(k: int) -> str:
    return f"(close / {lag('close', k)} - 1)"


def beta(y: str, x: str, n: int, least: int) -> str:
    return f"(case when count(case when ({y}) is not null and ({x}) is not null then 1 end) over {last(n)} >= {least} then covar_samp({y}, {x}) over {last(n)} end / (var_samp({x}) over {last(n)} + 1e-12))"


def corr(x: str, y: str, n: int, least: int) -> str:
    a, b = f"(case when ({y}) is not null then {x} end)", f"(case when ({x}) is not null then {y} end)"
    flat = f"stddev_pop({a}) over {last(n)} * stddev_pop({b}) over {last(n)} <= 1e-15"
    return f"(case when count({a}) over {last(n)} >= {least} and not ({flat}) then corr({a}, {b}) over {last(n)} end)"


def moment(f: str, x: str, n: int, least: int) -> str:
    return f"(case when count({x}) over {last(n)} >= {least} and stddev_pop({x}) over {last(n)} > 0 then {f}({x}) over {last(n)} end)"


def flag(condition: str) -> str:
    return f"(case when {condition} then 1.0 else 0.0 end)::double"


def rounded(names: list[str], digits: int = 6) -> str:
    return ", ".join(f"round({n}, {digits}) + 0 as {n}" for n in names)


def student_p(t: str, v: str) -> str:
    """Two-sided p-value of Student's t with whole degrees of freedom, by gamma functions."""
    angle = f"atan(abs({t}) / sqrt({v}))"
    even = f"sin({angle}) * list_sum(list_transform(range(0, {v} // 2), lambda k: exp(lgamma(k + 0.5) - lgamma(k + 1.0)) / sqrt(pi()) * pow(cos({angle}), 2 * k)))"
    odd = f"2 / pi() * ({angle} + sin({angle}) * coalesce(list_sum(list_transform(range(0, ({v} - 1) // 2), lambda k: sqrt(pi()) / 2 * exp(lgamma(k + 1.0) - lgamma(k + 1.5)) * pow(cos({angle}), 2 * k + 1))), 0))"
    return f"(case when {t} is not null and {v} >= 1 then 1 - case when {v} % 2 = 0 then {even} else {odd} end end)"


def staged(*stages: dict[str, str], start: str = RETURNS, source: str = "base") -> str:
    """A chain of common tables, each adding its columns; columns that don't begin with _ come out."""
    out, names = start, []
    for i, stage in enumerate(stages):
        out += f",\ns{i} as (select *, {', '.join(f'{e} as {n}' for n, e in stage.items())} from {source})"
        names += [n for n in stage if n[0] != "_"]
        source = f"s{i}"
    return f"with {out}\nselect instrument, date, {rounded(names)} from {source}"
