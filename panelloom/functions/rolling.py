"""Rolling statistics over an instrument's rows in date order, as vectors of numpy: what `frames` says in columns, for use inside tasks.

The last axis is time. Several instruments may lie side by side, one a row, filled up with NaN at the end: each one's values are as alone, up to the last bits.
NaN is a missing value, and so is what isn't finite. Sums are differences of running ones in extended precision, extremes join two
running ones, so a row costs the same for any window; moments and quantiles look at each window whole, and only at the places `at`
(as numpy indexes them) where they are asked for (elsewhere they are NaN). While `remembering`, what several statistics need of an array is made once.
"""

from __future__ import annotations

from contextlib import contextmanager
from decimal import ROUND_HALF_UP, Context, Decimal

import numpy as np
from numpy.lib.stride_tricks import sliding_window_view


#: While `remembering`: arrays by their id (holding them keeps it theirs) with what has been made of them.
_SEEN: dict[int, tuple[np.ndarray, dict]] | None = None


@contextmanager
def remembering():
    """Until the block ends, running sums and the like of an array are made once. Arrays must not change in it."""
    global _SEEN
    before, _SEEN = _SEEN, {}
    try:
        yield
    finally:
        _SEEN = before


def _once(x: np.ndarray, name, make):
    if _SEEN is None:
        return make()
    made = _SEEN.setdefault(id(x), (x, {}))[1]
    if name not in made:
        made[name] = make()
    return made[name]


def lag(x: np.ndarray, k: int = 1) -> np.ndarray:
    out = np.full(x.shape, np.nan)
    out[..., k:] = x[..., :-k]
    return out


def change(x: np.ndarray, k: int) -> np.ndarray:
    old = lag(x, k)
    return np.where(old != 0, x / old - 1, np.nan)


def flag(condition: np.ndarray) -> np.ndarray:
    return np.where(condition, 1.0, 0.0)


def there(x: np.ndarray) -> np.ndarray:
    return _once(x, "there", lambda: np.isfinite(x))


def zero(x: np.ndarray) -> np.ndarray:
    """Zero for missing values."""
    return np.where(np.isfinite(x), x, 0.0)


def half_up(x: np.ndarray, digits: int) -> np.ndarray:
    """What Spark's round(x, digits) + 0 gives for doubles: halves of their shortest decimals go away from zero."""
    unit = 10.0**digits
    size = np.abs(x) * unit
    whole = np.floor(size)
    rest = size - whole
    out = np.sign(x) * (whole + (rest > 0.5)) / unit + 0.0
    # next to a half, or where doubles are no finer than the unit, the decimals tell; above 17 digits nothing is cut
    near = (np.abs(rest - 0.5) <= 1e-15 * size) | (size >= 2.0**52)
    for i in zip(*np.nonzero(near & (size < 1e17))):
        out[i] = float(Decimal(repr(float(x[i]))).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP, Context(prec=40))) + 0.0
    return np.where(size < 1e17, out, x)


def safe_div(a: np.ndarray, b: np.ndarray, eps: float = 1e-10) -> np.ndarray:
    return np.where(np.abs(b) > eps, a / b, np.nan)


def _within(running: np.ndarray, n: int) -> np.ndarray:
    out = running.copy()
    out[..., n:] -= running[..., :-n]
    return out


def count(x: np.ndarray, n: int) -> np.ndarray:
    return _once(x, ("count", n), lambda: _within(_once(x, "counts", lambda: np.cumsum(there(x), axis=-1)), n))


def raw(x: np.ndarray, n: int) -> np.ndarray:
    """The window's sum, zero for none, in extended precision."""
    return _within(_once(x, "sums", lambda: np.cumsum(np.where(there(x), x, 0.0), axis=-1, dtype=np.longdouble)), n)


def total(x: np.ndarray, n: int, least: int | None = None) -> np.ndarray:
    return np.where(count(x, n) >= (n if least is None else max(least, 1)), raw(x, n).astype(float), np.nan)


def mean(x: np.ndarray, n: int, least: int | None = None) -> np.ndarray:
    return total(x, n, least) / np.maximum(count(x, n), 1)


def _extreme(x: np.ndarray, n: int, op, worst: float) -> np.ndarray:
    rows = x.shape[-1]
    size = rows + n - 1
    padded = np.full((*x.shape[:-1], -(-size // n) * n), worst)
    padded[..., n - 1 : size] = np.where(there(x), x, worst)
    blocks = padded.reshape(*x.shape[:-1], -1, n)
    after, before = op.accumulate(blocks, axis=-1).reshape(padded.shape), op.accumulate(blocks[..., ::-1], axis=-1)[..., ::-1].reshape(padded.shape)
    return op(before[..., :rows], after[..., n - 1 : size])


def high(x: np.ndarray, n: int, least: int) -> np.ndarray:
    return np.where(count(x, n) >= max(least, 1), _once(x, ("high", n), lambda: _extreme(x, n, np.maximum, -np.inf)), np.nan)


def low(x: np.ndarray, n: int, least: int) -> np.ndarray:
    return np.where(count(x, n) >= max(least, 1), _once(x, ("low", n), lambda: _extreme(x, n, np.minimum, np.inf)), np.nan)


def _other(x: np.ndarray) -> np.ndarray:
    """The last place whose value differs from the last one known; -1 for none."""
    known = np.maximum.accumulate(np.where(there(x), np.arange(x.shape[-1]), -1), axis=-1)
    old = np.full(x.shape, -1)
    old[..., 1:] = known[..., :-1]
    new = there(x) & (old >= 0) & (np.take_along_axis(x, np.maximum(old, 0), axis=-1) != x)
    return np.maximum.accumulate(np.where(new, old, -1), axis=-1)


def flat(x: np.ndarray, n: int) -> np.ndarray:
    """Whether no two values of the window differ."""
    other = _once(x, "other", lambda: _other(x))
    return (other < 0) | (other <= np.arange(x.shape[-1]) - n)


def _both(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The columns without the rows that only one of them has."""
    if x is y:
        return x, y
    has, other = there(x), there(y)
    both = _once(x, ("both", id(y)), lambda: has & other)
    one, two = (both == has).all(), (both == other).all()
    return x if one else _once(x, ("beside", id(y)), lambda: np.where(both, x, np.nan)), y if two else _once(y, ("beside", id(x)), lambda: np.where(both, y, np.nan))


def _centred(x: np.ndarray) -> np.ndarray:
    if x.ndim == 1:
        return np.where(there(x), x - x[there(x)].mean(), np.nan) if there(x).any() else np.full(x.shape, np.nan)
    # a mean over an instrument's own values, as if it lay alone
    middle = np.array([v[has].mean() if has.any() else np.nan for v, has in zip(x, there(x))])
    return np.where(there(x), x - middle[:, None], np.nan)


def _cross(x: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    x, y = _both(x, y)
    a, b = (_once(v, "centred", lambda v=v: _centred(v)) for v in (x, y))
    # both are remembered before one is named by the other's id
    once, twice = raw(a, n), raw(b, n)
    sums = _within(_once(a, ("products", id(b)), lambda: np.cumsum(np.where(there(a), a.astype(np.longdouble) * b, 0.0), axis=-1)), n) - once * twice / np.maximum(count(a, n), 1)
    return np.where(flat(a, n) | flat(b, n), 0.0, sums.astype(float))


def cross(x: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    """Summed products of the deviations of the rows that have both; zero where either is flat."""
    there(x), there(y)
    return _once(x, ("cross", id(y), n), lambda: _cross(x, y, n))


def std(x: np.ndarray, n: int, least: int) -> np.ndarray:
    k = count(x, n)
    return np.where(k >= max(least, 2), np.sqrt(np.maximum(cross(x, x, n), 0) / np.maximum(k - 1, 1)), np.nan)


def corr(x: np.ndarray, y: np.ndarray, n: int, least: int) -> np.ndarray:
    """Pearson's correlation of the rows that have both; NaN where either is flat."""
    x, y = _both(x, y)
    k, over = count(x, n), np.sqrt(np.maximum(cross(x, x, n), 0)) * np.sqrt(np.maximum(cross(y, y, n), 0))
    return np.where((k >= max(least, 1)) & (over > 1e-15 * k), cross(x, y, n) / over, np.nan)


def windows(x: np.ndarray, n: int, at=None) -> np.ndarray:
    """A place's last n values, oldest first, NaN before the first: (places of x, or those asked for, n)."""
    padded = _once(x, ("padded", n), lambda: np.concatenate((np.full((*x.shape[:-1], n - 1), np.nan), np.where(there(x), x, np.nan)), axis=-1))
    return picked(sliding_window_view(padded, n, axis=-1), at)


def picked(x: np.ndarray, at) -> np.ndarray:
    return x if at is None else x[at]


def placed(values: np.ndarray, at, shape: tuple) -> np.ndarray:
    """Values of the places `at` among NaN."""
    if at is None:
        return values
    out = np.full(shape, np.nan)
    out[at] = values
    return out


def _deviations(x: np.ndarray, n: int, at) -> np.ndarray:
    w = windows(x, n, at)
    return zero(w - (zero(w).sum(axis=-1) / np.maximum(picked(count(x, n), at), 1))[..., None])


def skew(x: np.ndarray, n: int, least: int, at=None) -> np.ndarray:
    """Bias-corrected skewness of at least three values that differ."""
    d, k = _deviations(x, n, at), picked(count(x, n), at)
    square = d * d
    g = np.sqrt(k) * (square * d).sum(axis=-1) / square.sum(axis=-1) ** 1.5
    return placed(np.where((k >= max(least, 3)) & ~picked(flat(x, n), at), g * np.sqrt(k * (k - 1.0)) / (k - 2), np.nan), at, x.shape)


def kurt(x: np.ndarray, n: int, least: int, at=None) -> np.ndarray:
    """Bias-corrected excess kurtosis of at least four values that differ."""
    d, k = _deviations(x, n, at), picked(count(x, n), at).astype(float)
    square = d * d
    g = k * (square * square).sum(axis=-1) / square.sum(axis=-1) ** 2 - 3
    return placed(np.where((k >= max(least, 4)) & ~picked(flat(x, n), at), (k - 1) / ((k - 2) * (k - 3)) * ((k + 1) * g + 6), np.nan), at, x.shape)


def quantile(x: np.ndarray, p: float, n: int, least: int, at=None) -> np.ndarray:
    """Linear interpolation between order statistics."""
    ordered, k = np.sort(windows(x, n, at), axis=-1), picked(count(x, n), at)
    place = p * (np.maximum(k, 1) - 1)
    below = np.floor(place).astype(int)
    above, share = np.minimum(below + 1, np.maximum(k, 1) - 1), place - below
    lo, hi = (np.take_along_axis(ordered, i[..., None], axis=-1)[..., 0] for i in (below, above))
    return placed(np.where(k >= max(least, 1), np.where(lo == hi, lo, (1 - share) * lo + share * hi), np.nan), at, x.shape)


def mean_to(x: np.ndarray, cut: np.ndarray, n: int, at=None) -> np.ndarray:
    """The mean of the window's values up to a cut."""
    w = windows(x, n, at)
    under = w <= picked(cut, at)[..., None]
    return placed(np.where(under, w, 0.0).sum(axis=-1) / under.sum(axis=-1), at, x.shape)
