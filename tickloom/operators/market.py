"""Price, return, volatility, calendar and sentiment features of OHLCV bars."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import div, kurt_corrected, safe_sqrt, skew_corrected
from .indicators import C, H, L, O, V, add_recursive, feature
from .series import Blocks, By, Frame, rolling

PPY = 252
WINDOWS = (5, 10, 20)


def _each(fmt, values=WINDOWS):
    return [fmt.format(v) for v in values]


feature(
    "price_ratios",
    ("open_close_ratio", "high_low_ratio", "close_open_ratio"),
    0,
    lambda w: {"open_close_ratio": div(O(), C()), "high_low_ratio": div(H(), L()), "close_open_ratio": div(C(), O())},
)
feature(
    "bar_shape",
    ("daily_range", "upper_shadow", "lower_shadow", "body_size", "price_position"),
    0,
    lambda w: {
        "daily_range": H() - L(),
        "upper_shadow": H() - F.greatest(O(), C()),
        "lower_shadow": F.least(O(), C()) - L(),
        "body_size": F.abs(C() - O()),
        "price_position": div(C() - L(), H() - L()),
    },
)
# A window expression that occurs twice in a column is evaluated twice, so each one gets a column of its own
# (with a leading underscore) and later steps build on that.
MA_WINDOWS = (5, 10, 20, 50)
feature(
    "price_ma_distance",
    _each("price_ma_distance_{}", MA_WINDOWS),
    49,
    lambda w: {f"_ma{n}": w.roll(F.avg, "close", n) for n in MA_WINDOWS},
    lambda w: {f"price_ma_distance_{n}": div(C() - F.col(f"_ma{n}"), F.col(f"_ma{n}")) for n in MA_WINDOWS},
)
feature(
    "returns", _each("return_{}d", (1, 2, 3, 5, 10)), 10, lambda w: {f"return_{n}d": w.change("close", n) for n in (1, 2, 3, 5, 10)}
)
feature("log_return", ("log_return",), 1, lambda w: {"log_return": F.log(div(C(), w.lag("close")))})
# the product of (1 + r) over n bars telescopes to one ratio
feature("cum_returns", _each("cum_return_{}d"), 20, lambda w: {f"cum_return_{n}d": w.change("close", n) for n in WINDOWS})


def _return_1d(w: Frame):
    return {"_r1": w.change("close")}


feature(
    "return_stats",
    [c for n in WINDOWS for c in (f"return_mean_{n}d", f"return_std_{n}d")],
    20,
    _return_1d,
    lambda w: {
        k: c
        for n in WINDOWS
        for k, c in (
            (f"return_mean_{n}d", w.roll(F.avg, "_r1", n)),
            (f"return_std_{n}d", w.roll(F.stddev_samp, "_r1", n)),
        )
    },
)
feature(
    "return_shape",
    [c for n in WINDOWS for c in (f"return_skew_{n}d", f"return_kurt_{n}d")],
    20,
    _return_1d,
    lambda w: {
        k: c
        for n in WINDOWS
        for k, c in (
            (f"_known{n}", F.count("_r1").over(w.back(n))),
            (f"_skew{n}", F.skewness("_r1").over(w.back(n))),
            (f"_kurt{n}", F.kurtosis("_r1").over(w.back(n))),
        )
    },
    lambda w: {
        k: c
        for n in WINDOWS
        for k, c in (
            (f"return_skew_{n}d", _full(n, skew_corrected, f"_skew{n}")),
            (f"return_kurt_{n}d", _full(n, kurt_corrected, f"_kurt{n}")),
        )
    },
)


def _full(n: int, correct, moment: str) -> Column:
    """Corrected moment of a full window; NULL where the returns do not vary."""
    return F.when((F.col(f"_known{n}") == n) & ~F.isnan(moment), correct(F.col(moment), F.lit(float(n))))


def volatility(windows=(5, 10, 20, 30), ppy: int = PPY):
    return (
        _return_1d,
        lambda w: {f"volatility_{n}d": w.roll(F.stddev_samp, "_r1", n) * math.sqrt(ppy) for n in windows},
    )


def parkinson(windows=WINDOWS, ppy: int = PPY, squared: bool = False):
    """Range volatility. The plain form averages ln(h/l); ``squared`` gives the published estimator."""
    x = lambda: F.log(div(H(), L()))
    scale = 4.0 * math.log(2.0)
    if squared:
        return (lambda w: {f"parkinson_vol_{n}d": safe_sqrt(w.roll(F.avg, x() * x(), n) / scale) * math.sqrt(ppy) for n in windows},)
    return (lambda w: {f"parkinson_vol_{n}d": safe_sqrt(w.roll(F.avg, x(), n) / scale) * math.sqrt(ppy) for n in windows},)


def garman_klass(windows=WINDOWS, ppy: int = PPY, squared: bool = False):
    """As above for high, low, open and close; NULL where the mean is negative."""
    k = 2.0 * math.log(2.0)

    def x() -> Column:
        hl, co = F.log(div(H(), L())), F.log(div(C(), O()))
        return 0.5 * hl * hl - (k - 1.0) * co * co if squared else hl - k * co

    return (lambda w: {f"garman_klass_vol_{n}d": safe_sqrt(w.roll(F.avg, x(), n)) * math.sqrt(ppy) for n in windows},)


def volume_weighted_volatility(windows=WINDOWS, ppy: int = PPY):
    """Volume-weighted deviation of returns around the weighted mean of each row's own window."""

    def mean(w: Frame):
        return {f"_vd{n}": F.col("_r1") - div(w.roll(F.sum, F.col("_r1") * V(), n), w.roll(F.sum, "volume", n)) for n in windows}

    def vol(w: Frame):
        out = {}
        for n in windows:
            d = F.col(f"_vd{n}")
            var = div(w.roll(F.sum, V() * d * d, n), w.roll(F.sum, "volume", n))
            out[f"vol_weighted_volatility_{n}d"] = safe_sqrt(var) * math.sqrt(ppy)
        return out

    return _return_1d, mean, vol


feature("volatility", _each("volatility_{}d", (5, 10, 20, 30)), 30, *volatility())
feature("parkinson", _each("parkinson_vol_{}d"), 19, *parkinson())
feature("garman_klass", _each("garman_klass_vol_{}d"), 19, *garman_klass())
feature("vol_weighted", _each("vol_weighted_volatility_{}d"), 39, *volume_weighted_volatility())

# --- calendar -----------------------------------------------------------------------------------


def calendar(ts: Column, intraday: bool = False) -> dict[str, Column]:
    """Monday is day 0; market hours are 9 to 16, both included."""
    day, month = F.weekday(ts), F.month(ts)
    out = {
        "day_of_week": day,
        "is_weekend": (day >= 5).cast("int"),
        "month": month,
        "quarter": F.quarter(ts),
        "day_sin": F.sin(2.0 * math.pi * day / 7.0),
        "day_cos": F.cos(2.0 * math.pi * day / 7.0),
        "month_sin": F.sin(2.0 * math.pi * month / 12.0),
        "month_cos": F.cos(2.0 * math.pi * month / 12.0),
    }
    if intraday:
        hour = F.hour(ts)
        out |= {"hour": hour, "is_market_hours": hour.between(9, 16).cast("int")}
    return out


def add_calendar(df: DataFrame, *, ts: str = "ts", intraday: bool = False) -> DataFrame:
    return df.withColumns(calendar(F.col(ts), intraday))


# --- sentiment ----------------------------------------------------------------------------------

feature(
    "advance_decline",
    ("advance_decline_ratio",),
    20,
    lambda w: {"_up": F.coalesce(C() > w.lag(C()), F.lit(False)).cast("double")},
    lambda w: {"advance_decline_ratio": w.roll(F.avg, "_up", 20)},
)
feature(
    "momentum_sentiment",
    ("momentum_sentiment",),
    20,
    lambda w: {"momentum_sentiment": (w.change("close", 5) + w.change("close", 20)) / 2.0},
)


def sentiment_class(index: Column) -> Column:
    """Right-closed bins of the index: (0,25] -> 0, (25,45] -> 1, (45,55] -> 2, (55,75] -> 3, (75,100] -> 4."""
    return (
        F.when((index <= 0) | (index > 100), None)
        .when(index <= 25, 0.0)
        .when(index <= 45, 1.0)
        .when(index <= 55, 2.0)
        .when(index <= 75, 3.0)
        .when(index <= 100, 4.0)
    )


def add_fear_greed(
    bars: DataFrame, *, by: By = ("symbol",), ts: str = "ts", blocks: Blocks | None = None
) -> DataFrame:
    """Index of momentum (RSI 14), calm (inverted volatility rank) and volume; 50 where not defined."""
    given = "rsi_14" in bars.columns
    d = bars if given else add_recursive(bars, ["rsi_14"], by=by, ts=ts, blocks=blocks)
    d = rolling(
        d,
        _return_1d,
        lambda w: {"_v20": w.roll(F.stddev_samp, "_r1", 20), "vr_": div(V(), w.roll(F.avg, "volume", 50))},
        lambda w: {"_vmin": w.roll(F.min, "_v20", 100), "_vmax": w.roll(F.max, "_v20", 100)},
        lambda w: {"calm_": 100.0 - div(F.col("_v20") - F.col("_vmin"), F.col("_vmax") - F.col("_vmin")) * 100.0},
        before=120,
        by=by,
        ts=ts,
        blocks=blocks,
    )
    volume = F.least(F.greatest(50.0 * F.col("vr_"), F.lit(0.0)), F.lit(100.0))
    index = F.coalesce(0.4 * F.col("rsi_14") + 0.3 * F.col("calm_") + 0.3 * F.when(F.col("vr_").isNotNull(), volume), F.lit(50.0))
    d = d.withColumn("fear_greed_index", index).drop("vr_", "calm_", *([] if given else ["rsi_14"]))
    return d.withColumn("market_sentiment", sentiment_class(F.col("fear_greed_index")))


def add_bull_bear_power(
    bars: DataFrame, *, by: By = ("symbol",), ts: str = "ts", blocks: Blocks | None = None
) -> DataFrame:
    given = "ema_13" in bars.columns
    d = bars if given else add_recursive(bars, ["ema_13"], by=by, ts=ts, blocks=blocks)
    d = d.withColumns({"bull_power": H() - F.col("ema_13"), "bear_power": L() - F.col("ema_13")})
    return d if given else d.drop("ema_13")
