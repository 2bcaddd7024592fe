"""Technical indicators over OHLCV bars (published definitions; warm-up rows are NULL).

``FEATURES`` maps a feature group to its window steps. Groups are combined level by level, so any
selection of groups costs one sort per series and one pass per level. Indicators that accumulate from
the start of the series and recursive ones have functions of their own below.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import div, exp_in_range, safe_sqrt
from ..schema import OHLCV, require
from ..session import cut
from .series import Blocks, By, Frame, Step, ewm, affine, rolling, running



def _column(name: str):
    return lambda: F.col(name)


# functions, since a Column can only be made while a session is there
O, H, L, C, V = (_column(c) for c in OHLCV)


@dataclass(frozen=True)
class Feature:
    """Window steps (later ones read the columns of earlier ones) and how many rows back they reach in all."""

    steps: tuple[Step, ...]
    before: int
    columns: tuple[str, ...]


FEATURES: dict[str, Feature] = {}


def feature(name: str, columns: Sequence[str], before: int, *steps: Step) -> None:
    FEATURES[name] = Feature(tuple(steps), before, tuple(columns))


def _each(fmt: str, values: Sequence[int]) -> list[str]:
    return [fmt.format(v) for v in values]


def merge(features: Sequence[Feature]) -> tuple[list[Step], int]:
    """One list of steps for several features: their first steps together, then their second ones, ..."""
    depth = max(len(f.steps) for f in features)

    def level(i: int) -> Step:
        def step(w: Frame) -> dict[str, Column]:
            out: dict[str, Column] = {}
            for f in features:
                if i < len(f.steps):
                    out.update(f.steps[i](w))
            return out

        return step

    return [level(i) for i in range(depth)], max(f.before for f in features)


def add_features(
    bars: DataFrame,
    *names: str,
    by: By = ("symbol",),
    ts: str = "ts",
    blocks: Blocks | None = None,
) -> DataFrame:
    """Add the columns of the named feature groups."""
    require(bars, *by, ts, *OHLCV)
    unknown = [n for n in names if n not in FEATURES]
    if unknown:
        raise ValueError(f"unknown features {unknown}; have {sorted(FEATURES)}")
    steps, before = merge([FEATURES[n] for n in names])
    return rolling(bars, *steps, before=before, by=by, ts=ts, blocks=blocks)


# --- trend --------------------------------------------------------------------------------------

SMA_WINDOWS = (5, 10, 20, 50, 100, 200)
EMA_WINDOWS = (5, 10, 20, 50, 100)

feature(
    "sma",
    _each("sma_{}", SMA_WINDOWS),
    199,
    lambda w: {f"sma_{n}": w.roll(F.avg, "close", n) for n in SMA_WINDOWS},
)


def _since(w: Frame, best: Column, n: int) -> Column:
    return F.when(F.count("close").over(w.back(n + 1)) == n + 1, F.col("_bar") - best)


def _aroon(n: int = 25) -> tuple[Step, ...]:
    def number(w: Frame):
        return {"_bar": F.row_number().over(w.spec)}

    def extremes(w: Frame):
        hi = F.max(F.struct(H().alias("v"), F.col("_bar").alias("i"))).over(w.back(n + 1))["i"]
        lo = F.min(F.struct(L().alias("v"), (-F.col("_bar")).alias("i"))).over(w.back(n + 1))["i"]
        return {
            "aroon_up": 100.0 * (n - _since(w, hi, n)) / n,
            "aroon_down": 100.0 * (n - _since(w, -lo, n)) / n,
        }

    def indicator(w: Frame):
        return {"aroon_indicator": F.col("aroon_up") - F.col("aroon_down")}

    return number, extremes, indicator


# ties go to the latest bar
feature("aroon", ("aroon_up", "aroon_down", "aroon_indicator"), 25, *_aroon())

def TP() -> Column:
    return (H() + L() + C()) / 3.0



def _cci(n: int = 20) -> tuple[Step, ...]:
    def window(w: Frame):
        return {"_tps": F.collect_list(TP()).over(w.back(n)), "_tpm": w.roll(F.avg, TP(), n)}

    def cci(w: Frame):
        dev = F.aggregate("_tps", F.lit(0.0), lambda a, x: a + F.abs(x - F.col("_tpm"))) / n
        return {"cci": div(TP() - F.col("_tpm"), 0.015 * dev)}

    return window, cci


feature("cci", ("cci",), 19, *_cci())

# --- momentum -----------------------------------------------------------------------------------


def _stoch(n: int = 14, smooth: int = 3) -> tuple[Step, ...]:
    def extremes(w: Frame):
        return {"_min14": w.roll(F.min, "low", n), "_max14": w.roll(F.max, "high", n)}

    def k(w: Frame):
        return {"stoch_k": 100.0 * div(C() - F.col("_min14"), F.col("_max14") - F.col("_min14"))}

    def d(w: Frame):
        return {"stoch_d": w.roll(F.avg, "stoch_k", smooth)}

    return extremes, k, d


feature("stoch", ("stoch_k", "stoch_d"), 15, *_stoch())
feature(
    "williams_r",
    ("williams_r",),
    13,
    _stoch()[0],
    lambda w: {"williams_r": -100.0 * div(F.col("_max14") - C(), F.col("_max14") - F.col("_min14"))},
)
feature("roc", _each("roc_{}", (5, 10, 20)), 20, lambda w: {f"roc_{n}": 100.0 * w.change("close", n) for n in (5, 10, 20)})


def _mfi(n: int = 14) -> tuple[Step, ...]:
    def flows(w: Frame):
        d = TP() - w.lag(TP())
        return {
            "_pmf": F.when(d > 0, TP() * V()).otherwise(0.0),
            "_nmf": F.when(d < 0, TP() * V()).otherwise(0.0),
        }

    def sums(w: Frame):
        return {"_psum": w.roll(F.sum, "_pmf", n), "_nsum": w.roll(F.sum, "_nmf", n)}

    def mfi(w: Frame):
        return {"mfi": 100.0 * div(F.col("_psum"), F.col("_psum") + F.col("_nsum"))}

    return flows, sums, mfi


feature("mfi", ("mfi",), 14, *_mfi())


def MID() -> Column:
    return (H() + L()) / 2.0


feature(
    "awesome_oscillator",
    ("awesome_oscillator",),
    33,
    lambda w: {"awesome_oscillator": w.roll(F.avg, MID(), 5) - w.roll(F.avg, MID(), 34)},
)

# --- volume -------------------------------------------------------------------------------------

feature(
    "volume_sma",
    _each("volume_sma_{}", (10, 20, 50)),
    49,
    lambda w: {f"volume_sma_{n}": w.roll(F.avg, "volume", n) for n in (10, 20, 50)},
)


def MFV() -> Column:
    return F.when(H() == L(), 0.0).otherwise(div((C() - L()) - (H() - C()), H() - L())) * V()


feature("cmf", ("cmf",), 19, lambda w: {"cmf": div(w.roll(F.sum, MFV(), 20), w.roll(F.sum, "volume", 20))})


def ease_of_movement(n: int = 14, scale: float = 1e8) -> tuple[Step, ...]:
    return (
        lambda w: {"_eom1": div(((H() + L()) - w.lag(H() + L())) / 2.0 * (H() - L()), V()) * scale},
        lambda w: {"eom": w.roll(F.avg, "_eom1", n)},
    )


feature("eom", ("eom",), 14, *ease_of_movement())

# --- volatility ---------------------------------------------------------------------------------


def _bollinger(n: int = 20, k: float = 2.0) -> tuple[Step, ...]:
    def moments(w: Frame):
        return {"bb_middle": w.roll(F.avg, "close", n), "_bbs": w.roll(F.stddev_pop, "close", n)}

    def bands(w: Frame):
        m, s = F.col("bb_middle"), F.col("_bbs")
        return {"bb_upper": m + k * s, "bb_lower": m - k * s}

    def derived(w: Frame):
        u, m, lo = F.col("bb_upper"), F.col("bb_middle"), F.col("bb_lower")
        return {"bb_width": div(u - lo, m) * 100.0, "bb_percent": div(C() - lo, u - lo)}

    return moments, bands, derived


feature("bollinger", ("bb_upper", "bb_middle", "bb_lower", "bb_width", "bb_percent"), 19, *_bollinger())


def _width(prefix: str) -> Step:
    def width(w: Frame):
        u, m, lo = (F.col(f"{prefix}_{x}") for x in ("upper", "middle", "lower"))
        return {f"{prefix}_width": div(u - lo, m) * 100.0}

    return width


def _donchian(w: Frame, n: int = 20):
    return {"dc_upper": w.roll(F.max, "high", n), "dc_lower": w.roll(F.min, "low", n)}


def _donchian_middle(w: Frame):
    return {"dc_middle": (F.col("dc_upper") + F.col("dc_lower")) / 2.0}


def _keltner(w: Frame, n: int = 20):
    return {
        "kc_upper": w.roll(F.avg, (4.0 * H() - 2.0 * L() + C()) / 3.0, n),
        "kc_middle": w.roll(F.avg, TP(), n),
        "kc_lower": w.roll(F.avg, (-2.0 * H() + 4.0 * L() + C()) / 3.0, n),
    }


feature("donchian", _each("dc_{}", ("upper", "middle", "lower", "width")), 19, _donchian, _donchian_middle, _width("dc"))
feature("keltner", _each("kc_{}", ("upper", "middle", "lower", "width")), 19, _keltner, _width("kc"))
feature(
    "ulcer_index",
    ("ulcer_index",),
    26,
    lambda w: {"_drop": 100.0 * (div(C(), w.roll(F.max, "close", 14)) - 1.0)},
    lambda w: {"ulcer_index": safe_sqrt(w.roll(F.avg, F.col("_drop") * F.col("_drop"), 14))},
)

# --- levels -------------------------------------------------------------------------------------

feature(
    "pivots",
    ("pivot", "r1", "s1", "r2", "s2"),
    0,
    lambda w: {"pivot": TP(), "r1": 2.0 * TP() - L(), "s1": 2.0 * TP() - H(), "r2": TP() + (H() - L()), "s2": TP() - (H() - L())},
)
FIB = {"fib_236": 0.236, "fib_382": 0.382, "fib_500": 0.5, "fib_618": 0.618}
feature(
    "fibonacci",
    ("high_20", "low_20", *FIB),
    19,
    lambda w: {"high_20": w.roll(F.max, "high", 20), "low_20": w.roll(F.min, "low", 20)},
    lambda w: {n: F.col("low_20") + f * (F.col("high_20") - F.col("low_20")) for n, f in FIB.items()},
)

# --- accumulating volume indicators -------------------------------------------------------------


def add_cumulative(
    bars: DataFrame, *, by: By = ("symbol",), ts: str = "ts", nvi_start: float = 1000.0, blocks: Blocks | None = None
) -> DataFrame:
    """obv, ad, vpt, nvi in one running pass."""
    d = rolling(
        bars,
        lambda w: {
            "obv_": F.coalesce(F.signum(C() - w.lag(C())) * V(), F.lit(0.0)),
            "ad_": MFV(),
            "vpt_": F.coalesce(V() * w.change("close"), F.lit(0.0)),
            "nvi_": F.when(V() < w.lag(V()), 1.0 + F.coalesce(w.change("close"), F.lit(0.0))).otherwise(1.0),
        },
        before=1,
        by=by,
        ts=ts,
        blocks=blocks,
    )
    d = running(
        d,
        {
            "obv": ("sum", F.col("obv_")),
            "ad": ("sum", F.col("ad_")),
            "vpt": ("sum", F.col("vpt_")),
            "_nvi": ("sum", F.when(F.col("nvi_") > 0, F.log("nvi_"))),
        },
        by=by,
        ts=ts,
        blocks=blocks,
    )
    # a running product in logarithms: NULL where it leaves the range of doubles, instead of infinite from then on
    return d.withColumn("nvi", exp_in_range(math.log(nvi_start) + F.col("_nvi"))).drop("obv_", "ad_", "vpt_", "nvi_", "_nvi")


# --- recursive indicators -----------------------------------------------------------------------

RECURSIVE = (
    *_each("ema_{}", EMA_WINDOWS),
    "macd",
    "macd_signal",
    "macd_histogram",
    "adx",
    "adx_pos",
    "adx_neg",
    *_each("rsi_{}", (7, 14, 21)),
    "force_index",
    "atr",
)


def _ema(x: Column, n: int) -> tuple[Column, float, int]:
    return x, 2.0 / (n + 1.0), n


def _wilder(x: Column, n: int) -> tuple[Column, float, int]:
    return x, 1.0 / n, n


def rsi_of(gain: str, loss: str) -> Column:
    g, l = F.col(gain), F.col(loss)
    return F.when(l == 0, 100.0).otherwise(100.0 * div(g, g + l))


def add_recursive(
    bars: DataFrame,
    columns: Sequence[str] = RECURSIVE,
    *,
    by: By = ("symbol",),
    ts: str = "ts",
    blocks: Blocks | None = None,
    stored: bool = True,
) -> DataFrame:
    """EMA, MACD, ADX, RSI, force index, ATR, KAMA; also ``ema_<n>`` / ``rsi_<n>`` for other n.

    All first-order recurrences share one scan; MACD's signal line and ADX, which smooth a smoothed
    series, share a second one. Only what ``columns`` needs is computed. A scan reads its input on both
    sides of the carry join; ``stored`` writes the input of the second one first (only where there is one).
    """
    want = set(columns)
    macd = bool(want & {"macd", "macd_signal", "macd_histogram"})
    adx = bool(want & {"adx", "adx_pos", "adx_neg"})
    lead: dict[str, Step] = {}
    first: dict[str, tuple[Column, float, int]] = {}

    def need(name: str, make) -> Column:
        lead[name] = make
        return F.col(f"in{name}")

    for c in columns:
        kind, _, n = c.rpartition("_")
        if kind == "ema":
            first[c] = _ema(C(), int(n))
        elif kind == "rsi":
            diff = lambda w: C() - w.lag(C())
            first[f"_g{n}"] = _wilder(need("_gain", lambda w: F.greatest(diff(w), F.lit(0.0))), int(n))
            first[f"_l{n}"] = _wilder(need("_loss", lambda w: F.greatest(-diff(w), F.lit(0.0))), int(n))
    if macd:
        first["_e12"], first["_e26"] = _ema(C(), 12), _ema(C(), 26)
    if "force_index" in want:
        first["force_index"] = _ema(need("_force", lambda w: (C() - w.lag(C())) * V()), 13)
    if adx or "atr" in want:
        tr = need("_tr", lambda w: F.greatest(H() - L(), F.abs(H() - w.lag(C())), F.abs(L() - w.lag(C()))))
        if "atr" in want:
            first["atr"] = _wilder(tr, 14)
    if adx:
        up, down = (lambda w: H() - w.lag(H())), (lambda w: w.lag(L()) - L())
        known = lambda w: w.lag(C()).isNotNull()
        dm_pos = need("_dmp", lambda w: F.when((up(w) > down(w)) & (up(w) > 0), up(w)).when(known(w), 0.0))
        dm_neg = need("_dmn", lambda w: F.when((down(w) > up(w)) & (down(w) > 0), down(w)).when(known(w), 0.0))
        first["_sp"], first["_sn"] = _wilder(dm_pos, 14), _wilder(dm_neg, 14)
        first["_st"] = _wilder(need("_tr1", lambda w: F.when(known(w), lead["_tr"](w))), 14)

    d = bars
    if lead:
        d = rolling(
            d, lambda w: {f"in{n}": make(w) for n, make in lead.items()}, before=1, by=by, ts=ts, blocks=blocks
        )
    extra = None
    if "kama" in want:
        d, extra = _kama_input(d, by=by, ts=ts, blocks=blocks)
    d = ewm(d, first, by=by, ts=ts, blocks=blocks, extra=extra)
    if "kama" in want:
        d = d.withColumn("kama", F.when(F.col("n_") > 0, F.col("kama")))
        first["kama"] = (F.col("kama"), 0.0, 0)
    out: dict[str, Column] = {c: F.col(c) for c in columns if c in first}
    for c in columns:
        kind, _, n = c.rpartition("_")
        if kind == "rsi":
            out[c] = rsi_of(f"_g{n}", f"_l{n}")
    second: dict[str, tuple[Column, float, int]] = {}
    if macd:
        out["macd"] = F.col("_e12") - F.col("_e26")
        second["macd_signal"] = (F.col("macd"), 2.0 / 10.0, 9)
    if adx:
        out["adx_pos"] = 100.0 * div(F.col("_sp"), F.col("_st"))
        out["adx_neg"] = 100.0 * div(F.col("_sn"), F.col("_st"))
        dx = 100.0 * div(F.abs(F.col("_sp") - F.col("_sn")), F.col("_sp") + F.col("_sn"))
        out["_dx"] = F.coalesce(dx, F.when(F.col("_st").isNotNull(), 0.0))
        second["adx"] = (F.col("_dx"), 1.0 / 14.0, 14)
    base = [c for c in bars.columns if c not in out]
    d = d.select(*base, *[x.alias(n) for n, x in out.items()])
    second = {n: v for n, v in second.items() if n in want or n == "macd_signal" and "macd_histogram" in want}
    if second:
        d = ewm(cut(d) if stored else d, second, by=by, ts=ts, blocks=blocks)
    if "macd_histogram" in want:
        d = d.withColumn("macd_histogram", F.col("macd") - F.col("macd_signal"))
    return d.select(*base, *columns)


def _kama_input(
    bars: DataFrame, n: int = 10, fast: int = 2, slow: int = 30, *, by: By, ts: str, blocks: Blocks | None
) -> tuple[DataFrame, dict[str, tuple[Column, Column]]]:
    hi, lo = 2.0 / (fast + 1.0), 2.0 / (slow + 1.0)
    d = rolling(
        bars,
        lambda w: {"_step": F.abs(C() - w.lag(C()))},
        lambda w: {"er_": F.abs(C() - w.lag(C(), n)), "path_": w.roll(F.sum, "_step", n)},
        before=2 * n,
        by=by,
        ts=ts,
        blocks=blocks,
    )
    er = F.coalesce(div(F.col("er_"), F.col("path_")), F.when(F.col("path_").isNotNull(), 0.0))
    sc = er * (hi - lo) + lo
    d = d.withColumn("sc_", sc * sc)
    d = running(d, {"n_": ("count", F.col("sc_"))}, by=by, ts=ts, blocks=blocks)
    b = C() * F.when(F.col("n_") == 1, 1.0).otherwise(F.col("sc_"))
    return d, {"kama": (1.0 - F.col("sc_"), b)}


def add_kama(
    bars: DataFrame,
    *,
    n: int = 10,
    fast: int = 2,
    slow: int = 30,
    by: By = ("symbol",),
    ts: str = "ts",
    blocks: Blocks | None = None,
) -> DataFrame:
    """Kaufman's adaptive mean: a recurrence whose coefficient varies per bar but is known beforehand.

    Starts with the close of bar n; a flat window (no path) has efficiency 0.
    """
    d, item = _kama_input(bars, n, fast, slow, by=by, ts=ts, blocks=blocks)
    d = affine(d, item, by=by, ts=ts, blocks=blocks)
    return d.withColumn("kama", F.when(F.col("n_") > 0, F.col("kama"))).drop("er_", "path_", "sc_", "n_")
