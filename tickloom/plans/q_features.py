"""Checked queries: technical, market and sentiment features."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..operators import indicators as ind, market
from ..operators.market import PPY, WINDOWS
from .catalog import KEY, columns_query, lag, pct, roll, so_far, w
from .fixtures import FLAG, HOUR, SUPP, flag_bars, hour_bars, supp_bars


def window_query(name: str, feature: str, columns: dict[str, str], *, flag: bool = False, **kw) -> None:
    columns_query(
        name,
        flag_bars if flag else supp_bars,
        FLAG if flag else SUPP,
        lambda bars: ind.add_features(bars, feature),
        columns,
        **kw,
    )


TP = "((high + low + close) / 3.0)"
N = "AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn FROM bars)"

# --- trend
window_query("f01_sma", "sma", {f"sma_{n}": roll("avg", "close", n) for n in ind.SMA_WINDOWS}, flag=True)
window_query(
    "f05_aroon",
    "aroon",
    {
        "aroon_up": f"CASE WHEN count(close) OVER {w(26)} = 26 THEN 100.0 * (25 - (rn - arg_max(rn, row(high, rn)) OVER {w(26)})) / 25 END",
        "aroon_down": f"CASE WHEN count(close) OVER {w(26)} = 26 THEN 100.0 * (25 - (rn - arg_min(rn, row(low, -rn)) OVER {w(26)})) / 25 END",
        "aroon_indicator": f"CASE WHEN count(close) OVER {w(26)} = 26 THEN 100.0 * (arg_max(rn, row(high, rn)) OVER {w(26)} - arg_min(rn, row(low, -rn)) OVER {w(26)}) / 25 END",
    },
    ctes=[f"n {N}"],
    source="n",
)
window_query(
    "f07_cci",
    "cci",
    {"cci": f"({TP} - m) / nullif(0.015 * list_avg(list_transform(l, lambda x: abs(x - m))), 0)"},
    ctes=[f"a AS (SELECT *, list({TP}) OVER {w(20)} AS l, {roll('avg', TP, 20)} AS m FROM bars)"],
    source="a",
    digits=4,
)
# --- momentum
_LO, _HI = roll("min", "low", 14), roll("max", "high", 14)
window_query(
    "f09_stoch",
    "stoch",
    {"stoch_k": "k", "stoch_d": roll("avg", "k", 3)},
    ctes=[f"a AS (SELECT *, 100.0 * (close - ({_LO})) / nullif(({_HI}) - ({_LO}), 0) AS k FROM bars)"],
    source="a",
)
window_query("f10_williams_r", "williams_r", {"williams_r": f"-100.0 * (({_HI}) - close) / nullif(({_HI}) - ({_LO}), 0)"})
window_query("f11_roc", "roc", {f"roc_{n}": f"100.0 * {pct('close', n)}" for n in (5, 10, 20)})
window_query(
    "f12_mfi",
    "mfi",
    {"mfi": f"100.0 * ({roll('sum', 'p', 14)}) / nullif(({roll('sum', 'p', 14)}) + ({roll('sum', 'q', 14)}), 0)"},
    ctes=[
        f"a AS (SELECT *, {TP} AS tp, {lag(TP)} AS tp1 FROM bars)",
        "b AS (SELECT *, CASE WHEN tp > tp1 THEN tp * volume ELSE 0 END AS p, CASE WHEN tp < tp1 THEN tp * volume ELSE 0 END AS q FROM a)",
    ],
    source="b",
)
window_query(
    "f13_awesome_oscillator",
    "awesome_oscillator",
    {"awesome_oscillator": f"({roll('avg', '((high + low) / 2.0)', 5)}) - ({roll('avg', '((high + low) / 2.0)', 34)})"},
    digits=5,
)
# --- volume
window_query("f15_volume_sma", "volume_sma", {f"volume_sma_{n}": roll("avg", "volume", n) for n in (10, 20, 50)})
MFV = "(CASE WHEN high = low THEN 0.0 ELSE ((close - low) - (high - close)) / (high - low) END * volume)"
columns_query(
    "f16_obv",
    supp_bars,
    SUPP,
    ind.add_cumulative,
    {"obv": so_far("sum(s)")},
    ctes=[f"a AS (SELECT *, coalesce(sign(close - {lag('close')}) * volume, 0) AS s FROM bars)"],
    source="a",
)
columns_query("f17_ad", supp_bars, SUPP, ind.add_cumulative, {"ad": so_far(f"sum({MFV})")}, digits=4)
window_query("f18_cmf", "cmf", {"cmf": f"({roll('sum', MFV, 20)}) / nullif({roll('sum', 'volume', 20)}, 0)"}, digits=4)
window_query(
    "f20_eom",
    "eom",
    {"eom": roll("avg", "e", 14)},
    ctes=[f"a AS (SELECT *, ((high + low) - {lag('(high + low)')}) / 2.0 * (high - low) / nullif(volume, 0) * 1e8 AS e FROM bars)"],
    source="a",
    digits=0,
)
columns_query(
    "f21_vpt",
    supp_bars,
    SUPP,
    ind.add_cumulative,
    {"vpt": so_far("sum(s)")},
    ctes=[f"a AS (SELECT *, coalesce(volume * {pct('close')}, 0) AS s FROM bars)"],
    source="a",
    digits=5,
)
columns_query(
    "f22_nvi",
    supp_bars,
    SUPP,
    lambda bars: ind.add_cumulative(bars).withColumn("log_nvi", F.ln("nvi")),
    {"log_nvi": f"ln(1000.0 * {so_far('product(s)')})"},
    ctes=[f"a AS (SELECT *, CASE WHEN volume < {lag('volume')} THEN 1 + {pct('close')} ELSE 1.0 END AS s FROM bars)"],
    source="a",
)
# --- volatility
_M, _S = roll("avg", "close", 20), roll("stddev_pop", "close", 20)
window_query(
    "f23_bollinger",
    "bollinger",
    {
        "bb_upper": "m + 2 * s",
        "bb_middle": "m",
        "bb_lower": "m - 2 * s",
        "bb_width": "((m + 2 * s) - (m - 2 * s)) / nullif(m, 0) * 100",
        "bb_percent": "(close - (m - 2 * s)) / nullif((m + 2 * s) - (m - 2 * s), 0)",
    },
    ctes=[f"a AS (SELECT *, {_M} AS m, {_S} AS s FROM bars)"],
    source="a",
    digits=5,
)
_U20, _L20 = roll("max", "high", 20), roll("min", "low", 20)
window_query(
    "f25_donchian",
    "donchian",
    {"dc_upper": "u", "dc_middle": "(u + l) / 2", "dc_lower": "l", "dc_width": "(u - l) / nullif((u + l) / 2, 0) * 100"},
    raw=["dc_upper", "dc_middle", "dc_lower"],
    ctes=[f"a AS (SELECT *, {_U20} AS u, {_L20} AS l FROM bars)"],
    source="a",
)
window_query(
    "f26_keltner",
    "keltner",
    {"kc_upper": "u", "kc_middle": "m", "kc_lower": "l", "kc_width": "(u - l) / nullif(m, 0) * 100"},
    ctes=[
        f"a AS (SELECT *, {roll('avg', '((4.0 * high - 2.0 * low + close) / 3.0)', 20)} AS u, {roll('avg', TP, 20)} AS m, "
        f"{roll('avg', '((-2.0 * high + 4.0 * low + close) / 3.0)', 20)} AS l FROM bars)"
    ],
    source="a",
    digits=5,
)
window_query(
    "f27_ulcer_index",
    "ulcer_index",
    {"ulcer_index": "sqrt(m)"},
    ctes=[
        f"a AS (SELECT *, 100.0 * (close / ({roll('max', 'close', 14)}) - 1) AS d FROM bars)",
        f"b AS (SELECT *, {roll('avg', '(d * d)', 14)} AS m FROM a)",
    ],
    source="b",
)
# --- levels
window_query(
    "f28_pivots",
    "pivots",
    {"pivot": TP, "r1": f"2 * {TP} - low", "s1": f"2 * {TP} - high", "r2": f"{TP} + (high - low)", "s2": f"{TP} - (high - low)"},
    raw=["pivot", "r1", "s1", "r2", "s2"],
)
window_query(
    "f29_fibonacci",
    "fibonacci",
    {"high_20": "u", "low_20": "l", **{n: f"l + {f}::DOUBLE * (u - l)" for n, f in ind.FIB.items()}},
    raw=["high_20", "low_20", *ind.FIB],
    ctes=[f"a AS (SELECT *, {_U20} AS u, {_L20} AS l FROM bars)"],
    source="a",
)

# --- recursive indicators: the SQL walks the series with a recursive CTE


def ewm_ctes(name: str, source: str, items: dict[str, tuple[str, float]]) -> list[str]:
    """CTE ``name``: ``source`` (columns symbol, rn, ...) plus one exponential mean per item, from its first value on."""
    seed = ", ".join(f"CAST({x} AS DOUBLE) AS {n}" for n, (x, _) in items.items())
    step = ", ".join(
        f"CASE WHEN {x} IS NULL THEN p.{n} WHEN p.{n} IS NULL THEN {x} ELSE p.{n} + {a!r} * ({x} - p.{n}) END"
        for n, (x, a) in items.items()
    )
    cols = ", ".join(items)
    return [
        f"{name}_w(symbol, rn, {cols}) AS (SELECT symbol, rn, {seed} FROM {source} s WHERE rn = 1 UNION ALL "
        f"SELECT s.symbol, s.rn, {step} FROM {name}_w p JOIN {source} s ON s.symbol = p.symbol AND s.rn = p.rn + 1)",
        f"{name} AS (SELECT s.*, {', '.join('w.' + n for n in items)} FROM {source} s JOIN {name}_w w USING (symbol, rn))",
    ]


def recursive_query(name, columns, sql_columns, ctes, source, *, compute=None, flag=False, digits=5):
    columns_query(
        name,
        flag_bars if flag else supp_bars,
        FLAG if flag else SUPP,
        compute or (lambda bars: ind.add_recursive(bars, columns)),
        sql_columns,
        ctes=[f"n {N}", *ctes],
        source=source,
        digits=digits,
        recursive=True,
    )


def after(n: int, x: str) -> str:
    return f"CASE WHEN rn >= {n} THEN {x} END"


recursive_query(
    "f02_ema",
    [f"ema_{n}" for n in ind.EMA_WINDOWS],
    {f"ema_{n}": after(n, f"e{n}") for n in ind.EMA_WINDOWS},
    ewm_ctes("e", "n", {f"e{n}": ("s.close", 2.0 / (n + 1.0)) for n in ind.EMA_WINDOWS}),
    "e",
    flag=True,
)
recursive_query(
    "f03_macd",
    ["macd", "macd_signal", "macd_histogram"],
    {"macd": "m", "macd_signal": after(34, "g"), "macd_histogram": after(34, "m - g")},
    [
        *ewm_ctes("e", "n", {"a": ("s.close", 2.0 / 13.0), "b": ("s.close", 2.0 / 27.0)}),
        f"m1 AS (SELECT *, {after(26, 'a - b')} AS m FROM e)",
        *ewm_ctes("m2", "m1", {"g": ("s.m", 0.2)}),
    ],
    "m2",
)
_TR = "greatest(high - low, abs(high - pc), abs(low - pc))"
_PREV = f"v AS (SELECT *, {lag('close')} AS pc, {lag('high')} AS ph, {lag('low')} AS pl FROM n)"
recursive_query(
    "f04_adx",
    ["adx", "adx_pos", "adx_neg"],
    {"adx": after(28, "x"), "adx_pos": "dp", "adx_neg": "dn"},
    [
        _PREV,
        f"d AS (SELECT *, CASE WHEN pc IS NOT NULL THEN {_TR} END AS tr, "
        "CASE WHEN pc IS NULL THEN NULL WHEN high - ph > pl - low AND high - ph > 0 THEN high - ph ELSE 0 END AS up, "
        "CASE WHEN pc IS NULL THEN NULL WHEN pl - low > high - ph AND pl - low > 0 THEN pl - low ELSE 0 END AS dw FROM v)",
        *ewm_ctes("e", "d", {"t": ("s.tr", 1 / 14.0), "p": ("s.up", 1 / 14.0), "q": ("s.dw", 1 / 14.0)}),
        f"i AS (SELECT *, {after(15, '100 * p / nullif(t, 0)')} AS dp, {after(15, '100 * q / nullif(t, 0)')} AS dn, "
        f"{after(15, 'coalesce(100 * abs(p - q) / nullif(p + q, 0), 0)')} AS dx FROM e)",
        *ewm_ctes("a", "i", {"x": ("s.dx", 1 / 14.0)}),
    ],
    "a",
)
# the first bar has no change: gain and loss count as 0
_GAIN = f"d AS (SELECT *, greatest(close - {lag('close')}, 0) AS g, greatest({lag('close')} - close, 0) AS l, close - {lag('close')} AS dc FROM n)"
recursive_query(
    "f08_rsi",
    ["rsi_7", "rsi_14", "rsi_21"],
    {f"rsi_{n}": after(n, f"CASE WHEN l{n} = 0 THEN 100 ELSE 100 * g{n} / (g{n} + l{n}) END") for n in (7, 14, 21)},
    [_GAIN, *ewm_ctes("e", "d", {k: v for n in (7, 14, 21) for k, v in ((f"g{n}", ("s.g", 1.0 / n)), (f"l{n}", ("s.l", 1.0 / n)))})],
    "e",
)
recursive_query(
    "f14_kama",
    None,
    {"kama": "k"},
    [
        f"d AS (SELECT *, abs(close - {lag('close')}) AS st, abs(close - {lag('close', 10)}) AS ch FROM n)",
        f"r AS (SELECT *, {roll('sum', 'st', 10)} AS pa FROM d)",
        "c AS (SELECT *, CASE WHEN pa IS NOT NULL THEN pow(coalesce(ch / nullif(pa, 0), 0) * (2/3.0 - 2/31.0) + 2/31.0, 2) END AS sc FROM r)",
        "k_w(symbol, rn, k) AS (SELECT symbol, rn, NULL::DOUBLE FROM c WHERE rn = 1 UNION ALL SELECT s.symbol, s.rn, "
        "CASE WHEN s.sc IS NULL THEN p.k WHEN p.k IS NULL THEN s.close ELSE p.k + s.sc * (s.close - p.k) END "
        "FROM k_w p JOIN c s ON s.symbol = p.symbol AND s.rn = p.rn + 1)",
        "k1 AS (SELECT c.*, k FROM c JOIN k_w USING (symbol, rn))",
    ],
    "k1",
    compute=ind.add_kama,
)
recursive_query(
    "f19_force_index",
    ["force_index"],
    {"force_index": after(14, "f")},
    [_GAIN, *ewm_ctes("e", "d", {"f": ("(s.dc * s.volume)", 2.0 / 14.0)})],
    "e",
    digits=3,
)
recursive_query(
    "f24_atr",
    ["atr"],
    {"atr": after(14, "a")},
    [_PREV, f"d AS (SELECT *, {_TR} AS tr FROM v)", *ewm_ctes("e", "d", {"a": ("s.tr", 1 / 14.0)})],
    "e",
)

# --- market features
window_query("g01_price_ratios", "price_ratios", {"open_close_ratio": "open / close", "high_low_ratio": "high / low", "close_open_ratio": "close / open"})
window_query(
    "g02_bar_shape",
    "bar_shape",
    {
        "daily_range": "high - low",
        "upper_shadow": "high - greatest(open, close)",
        "lower_shadow": "least(open, close) - low",
        "body_size": "abs(close - open)",
    },
)
window_query("g03_price_position", "bar_shape", {"price_position": "(close - low) / nullif(high - low, 0)"})
window_query(
    "g04_price_ma_distance",
    "price_ma_distance",
    {f"price_ma_distance_{n}": f"(close - ({roll('avg', 'close', n)})) / ({roll('avg', 'close', n)})" for n in (5, 10, 20, 50)},
)
window_query("g05_returns", "returns", {f"return_{n}d": pct("close", n) for n in (1, 2, 3, 5, 10)})
window_query("g06_log_return", "log_return", {"log_return": f"ln(close / {lag('close')})"})
_R1 = f"r AS (SELECT *, {pct('close')} AS r1 FROM bars)"
window_query(
    "g07_cum_returns",
    "cum_returns",
    {f"cum_return_{n}d": f"({roll('product', '(1 + r1)', n)}) - 1" for n in WINDOWS},
    ctes=[_R1],
    source="r",
)
window_query(
    "g08_return_stats",
    "return_stats",
    {
        k: v
        for n in WINDOWS
        for k, v in ((f"return_mean_{n}d", roll("avg", "r1", n)), (f"return_std_{n}d", roll("stddev_samp", "r1", n)))
    },
    ctes=[_R1],
    source="r",
)
window_query(
    "g09_return_shape",
    "return_shape",
    {
        k: v
        for n in WINDOWS
        for k, v in ((f"return_skew_{n}d", roll("skewness", "r1", n)), (f"return_kurt_{n}d", roll("kurtosis", "r1", n)))
    },
    ctes=[_R1],
    source="r",
    digits=5,
)
Y = math.sqrt(PPY)
window_query(
    "g10_volatility", "volatility", {f"volatility_{n}d": f"({roll('stddev_samp', 'r1', n)}) * {Y!r}" for n in (5, 10, 20, 30)}, ctes=[_R1], source="r"
)
window_query(
    "g11_parkinson", "parkinson", {f"parkinson_vol_{n}d": f"sqrt(({roll('avg', 'ln(high / low)', n)}) / (4 * ln(2))) * {Y!r}" for n in WINDOWS}
)
window_query(
    "g12_garman_klass",
    "garman_klass",
    {f"garman_klass_vol_{n}d": f"CASE WHEN g{n} >= 0 THEN sqrt(g{n}) * {Y!r} END" for n in WINDOWS},
    ctes=[
        "a AS (SELECT *, "
        + ", ".join(f"{roll('avg', '(ln(high / low) - 2 * ln(2) * ln(close / open))', n)} AS g{n}" for n in WINDOWS)
        + " FROM bars)"
    ],
    source="a",
)
window_query(
    "g13_vol_weighted",
    "vol_weighted",
    {
        f"vol_weighted_volatility_{n}d": f"sqrt(({roll('sum', f'(volume * d{n} * d{n})', n)}) / nullif({roll('sum', 'volume', n)}, 0)) * {Y!r}"
        for n in WINDOWS
    },
    ctes=[
        _R1,
        "a AS (SELECT *, "
        + ", ".join(f"r1 - ({roll('sum', '(r1 * volume)', n)}) / nullif({roll('sum', 'volume', n)}, 0) AS d{n}" for n in WINDOWS)
        + " FROM r)",
    ],
    source="a",
)
_CAL = {
    "day_of_week": "isodow(ts) - 1",
    "is_weekend": "CASE WHEN isodow(ts) >= 6 THEN 1 ELSE 0 END",
    "month": "month(ts)",
    "quarter": "quarter(ts)",
}
_CYC = {
    "day_sin": "sin(2 * pi() * (isodow(ts) - 1) / 7)",
    "day_cos": "cos(2 * pi() * (isodow(ts) - 1) / 7)",
    "month_sin": "sin(2 * pi() * month(ts) / 12)",
    "month_cos": "cos(2 * pi() * month(ts) / 12)",
}
columns_query("g14_calendar", supp_bars, SUPP, market.add_calendar, _CAL)
columns_query(
    "g15_intraday",
    hour_bars,
    HOUR,
    lambda bars: market.add_calendar(bars, intraday=True),
    {"hour": "hour(ts)", "is_market_hours": "CASE WHEN hour(ts) BETWEEN 9 AND 16 THEN 1 ELSE 0 END"},
)
columns_query("g16_cyclic", supp_bars, SUPP, market.add_calendar, _CYC)

# --- sentiment
_FG_CTES = [
    _GAIN,
    *ewm_ctes("e", "d", {"g14": ("s.g", 1.0 / 14), "l14": ("s.l", 1.0 / 14)}),
    f"f1 AS (SELECT *, {pct('close')} AS r1 FROM e)",
    f"f2 AS (SELECT *, {roll('stddev_samp', 'r1', 20)} AS v20, volume / nullif({roll('avg', 'volume', 50)}, 0) AS vr FROM f1)",
    f"f3 AS (SELECT *, ({roll('min', 'v20', 100)}) AS lo, ({roll('max', 'v20', 100)}) AS hi FROM f2)",
    "f4 AS (SELECT *, coalesce(0.4 * CASE WHEN rn >= 14 THEN CASE WHEN l14 = 0 THEN 100 ELSE 100 * g14 / (g14 + l14) END END "
    "+ 0.3 * (100 - (v20 - lo) / nullif(hi - lo, 0) * 100) "
    "+ 0.3 * CASE WHEN vr IS NOT NULL THEN least(greatest(50 * vr, 0), 100) END, 50) AS fg FROM f3)",
]
recursive_query("h01_fear_greed", None, {"fear_greed_index": "fg"}, _FG_CTES, "f4", compute=market.add_fear_greed, flag=True)
recursive_query(
    "h02_market_sentiment",
    None,
    {
        "market_sentiment": "CASE WHEN fg <= 0 OR fg > 100 THEN NULL WHEN fg <= 25 THEN 0 WHEN fg <= 45 THEN 1 "
        "WHEN fg <= 55 THEN 2 WHEN fg <= 75 THEN 3 ELSE 4 END"
    },
    _FG_CTES,
    "f4",
    compute=market.add_fear_greed,
    flag=True,
)
recursive_query(
    "h03_bull_bear_power",
    None,
    {"bull_power": after(13, "high - e13"), "bear_power": after(13, "low - e13")},
    ewm_ctes("e", "n", {"e13": ("s.close", 2.0 / 14.0)}),
    "e",
    compute=market.add_bull_bear_power,
)
window_query(
    "h04_advance_decline",
    "advance_decline",
    {"advance_decline_ratio": roll("avg", "u", 20)},
    ctes=[f"a AS (SELECT *, CASE WHEN close > {lag('close')} THEN 1.0 ELSE 0.0 END::DOUBLE AS u FROM bars)"],
    source="a",
)
window_query("h05_momentum_sentiment", "momentum_sentiment", {"momentum_sentiment": f"({pct('close', 5)} + {pct('close', 20)}) / 2"})
