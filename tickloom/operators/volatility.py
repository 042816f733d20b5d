"""Realised volatility over rolling frames of bars, and implied volatility."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions import ordered

#: Bars a day and days a year; the rate of interest.
BARS, DAYS, RATE = 75, 252, 0.065
ANNUAL = math.sqrt(BARS * DAYS)


#: The sums that each estimator needs: terms of a bar, and how many rows fewer than n they cover.
_TERMS = {
    "_r": ("ret", 1), "_rr": ("ret * ret", 1), "_hl": ("ln(high / low) * ln(high / low)", 0), "_co": ("ln(close / open) * ln(close / open)", 0),
    "_rs": ("ln(high / open) * (ln(high / open) - ln(close / open)) + ln(low / open) * (ln(low / open) - ln(close / open))", 0),
}


def estimated(bars: DataFrame, n: int, by: str = "instrument", order: str = "k", full: str = "k") -> DataFrame:
    """bars (with ret, the log of close over the one before) with annualised volatility of the last n of their window by four
    estimators; null where `full`, a bar's place among its instrument's, is below n. Sums are ordered.rolling(), so the cost of a
    bar doesn't grow with n."""
    sums = ordered.rolling(bars, by, order, {name: (x, n - less) for name, (x, less) in _TERMS.items()})
    there, m = F.col(full) >= n, max(n - 1, 1)

    def annual(x: Column) -> Column:
        return F.when(there & (x >= 0), F.sqrt(x) * ANNUAL)

    # one return has no spread; of several the squares' mean and the mean's square are exact to 1e-16 of them
    spread = F.greatest(F.col("_rr") / m - (F.col("_r") / m) * (F.col("_r") / m), F.lit(0.0)) if m > 1 else F.lit(0.0)
    of = {
        "close_close": F.when(there & F.lit(n > 1), F.sqrt(spread) * ANNUAL),
        "parkinson": annual(F.col("_hl") / n / (4 * math.log(2))),
        "garman_klass": annual((0.5 * F.col("_hl") - (2 * math.log(2) - 1) * F.col("_co")) / n),
        "rogers_satchell": annual(F.col("_rs") / n),
    }
    return sums.withColumns(of).drop(*_TERMS)


#: The estimators' names.
METHODS = ("close_close", "parkinson", "garman_klass", "rogers_satchell")


def placed(bars: DataFrame, n: int, by: str = "instrument", size: int = 10_000, partitions: int | None = None) -> DataFrame:
    """bars in parts of about `size` with the n bars in front (ordered.parts), with ret and _key, the window of a part. Bars whose
    prices aren't all positive and finite are left out. partitions: as in ordered.dealt(), up to the numbering."""
    prices = ("open", "high", "low", "close")
    good = bars.where("timestamp IS NOT NULL").where(" AND ".join(f"{c} > 0 AND {c} < DOUBLE('Infinity')" for c in prices))
    each = ordered.parts(ordered.numbered(good, by, "timestamp", F.to_date("timestamp"), partitions), n, size).withColumn("_key", F.struct(by, "part"))
    return each.withColumn("ret", F.expr("ln(close / lag(close) OVER (PARTITION BY _key ORDER BY k))"))


def realised(bars: DataFrame, n: int, size: int = 10_000) -> DataFrame:
    """bars with the four estimators. Bars whose prices aren't all positive and finite are left out.

    The windows run over parts of about `size` bars, each with the n bars in front, so an instrument's bars needn't fit a task.
    """
    each = placed(bars.select("instrument", "timestamp", "open", "high", "low", "close"), n, size=size)
    return estimated(each, n, by="_key").where("own").select("instrument", "timestamp", *[F.round(c, 6).alias(c) for c in METHODS])


def regime(vol: Column) -> Column:
    return F.when(vol < 0.10, "Low").when(vol < 0.15, "Normal").when(vol < 0.25, "Elevated").when(vol.isNotNull(), "High")


def by_name(name: str) -> Column:
    """One of estimated()'s columns; ValueError for another name."""
    if name not in METHODS:
        raise ValueError(f"no estimator is called {name!r}; there are {', '.join(METHODS)}")
    return F.col(name)


#: Steps of the error function's values, to 6 on both sides, beyond which it is 1 but for 1e-16.
_STEP = 1 / 128
_KNOTS = np.array([math.erf(k * _STEP) for k in range(-768, 769)])


def erf(x: np.ndarray) -> np.ndarray:
    """The error function of whole arrays, to 1e-14: five terms of Taylor's series about the nearest step."""
    x = np.clip(x, -6.0, 6.0)
    k = np.rint(np.nan_to_num(x) / _STEP)
    a = k * _STEP
    d, q = x - a, a * a
    series = 1 + d * (-a + d * ((2 * q - 1) / 3 + d * (a * (3 - 2 * q) / 6 + d * (4 * q * q - 12 * q + 3) / 30)))
    return _KNOTS[k.astype(np.int64) + 768] + 2 / math.sqrt(math.pi) * np.exp(-q) * d * series


def _cdf(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + erf(x / math.sqrt(2)))


def price(spot, strike, years, sigma, call) -> np.ndarray:
    """Black-Scholes prices without dividends; without time or volatility, what exercise is worth."""
    with np.errstate(all="ignore"):
        root = sigma * np.sqrt(years)
        d1 = (np.log(spot / strike) + (RATE + sigma * sigma / 2) * years) / root
        later = strike * np.exp(-RATE * years)
        value = np.where(call, spot * _cdf(d1) - later * _cdf(d1 - root), later * _cdf(root - d1) - spot * _cdf(-d1))
    worth = np.maximum(np.where(call, spot - strike, strike - spot), 0)
    return np.where((years > 0) & (sigma > 0), value, worth)


def vega(spot, strike, years, sigma) -> np.ndarray:
    """What a price gains with sigma."""
    root = sigma * np.sqrt(years)
    d1 = (np.log(spot / strike) + (RATE + sigma * sigma / 2) * years) / root
    return spot * np.sqrt(years) * np.exp(-d1 * d1 / 2) / math.sqrt(2 * math.pi)


#: Fixed values in implied(): the bounds 0.001 and 5, the first guess, and 0.01 below exercise as the least price.
def implied(spot, strike, years, paid, call, low: float = 0.001, high: float = 5.0, steps: int = 60, near: float = 1e-9) -> np.ndarray:
    """The volatility at which price() is `paid`, for whole columns; NaN where no price between the bounds is.

    Newton's steps, each halving its bracket instead where it would leave it; rows are dropped from the work as they are found.
    """
    lo, hi = np.full(len(spot), low), np.full(len(spot), high)
    with np.errstate(all="ignore"):
        x = np.clip(np.nan_to_num(np.sqrt(2 * math.pi / years) * paid / spot, nan=0.5), 0.01, high)
        left = np.arange(len(spot))
        for _ in range(steps):
            a = [v[left] for v in (spot, strike, years)]
            off = price(*a, x[left], call[left]) - paid[left]
            over = off > 0
            hi[left], lo[left] = np.where(over, x[left], hi[left]), np.where(over, lo[left], x[left])
            step = off / vega(*a, x[left])
            to = x[left] - step
            fine = np.isfinite(to) & (to > lo[left]) & (to < hi[left])
            x[left] = np.where(fine, to, (lo[left] + hi[left]) / 2)
            left = left[~(fine & (np.abs(step) < near))]
            if not len(left):
                break
    worth = np.maximum(np.where(call, spot - strike, strike - spot), 0)
    good = (spot > 0) & (strike > 0) & (years > 0) & (paid > 0) & (paid >= worth - 0.01) & (x > low + 1e-6) & (x < high - 1e-6)
    return np.where(good, x, np.nan)


@F.pandas_udf(DoubleType())
def priced(spot: pd.Series, strike: pd.Series, years: pd.Series, sigma: pd.Series, call: pd.Series) -> pd.Series:
    return pd.Series(price(*(x.to_numpy(float) for x in (spot, strike, years, sigma)), call.to_numpy(bool)))


@F.pandas_udf(DoubleType())
def implied_vol(each: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for spot, strike, years, paid, call in each:
        out = implied(*(x.to_numpy(float) for x in (spot, strike, years, paid)), call.to_numpy(bool))
        yield pd.Series(out).astype(object).where(~np.isnan(out), None).astype(float)


def years_to(expiry: Column, day: Column) -> Column:
    return F.greatest(F.datediff(expiry, day) / F.lit(365.0), F.lit(1 / 365.0))


def nearest_strike(spot: Column, step: int) -> Column:
    """The nearest multiple of step; halves go to the even one."""
    return F.bround(spot / step) * step
