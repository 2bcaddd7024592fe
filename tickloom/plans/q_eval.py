"""Checked queries: walk-forward, risk, reports, feature selection, and the operators on long tick series."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..operators import folds, indicators, metrics, reports, risk, selection, walkforward as wf, windowruns
from ..operators.series import ewm, rolling, running
from ..session import cut
from .catalog import COLUMNS, KEY, columns_query, lag, pct, register, roll, rr, show, so_far
from .fixtures import FLAG, SUPP, flag_bars, line_blocks, line_ticks, line_ticks_sql, supp_bars
from .q_features import ewm_ctes
from .q_trading import CHAIN_SQL, DD, RETS, equity, known, returns

KEYS = ("symbol", "ts")
Y = math.sqrt(252)

# --- P: walk-forward

_N = "c AS (SELECT symbol, count(*) AS n FROM bars GROUP BY 1)"


def _windows_sql(train, test, step, expanding=True, strict=False):
    last = f"n - {test}" + (" - 1" if strict else "")
    start = "0" if expanding else f"s - {train}"
    return (
        f"WITH {SUPP}, {_N}, w AS (SELECT symbol, unnest(generate_series({train}, {last}, {step})) AS s FROM c WHERE {last} >= {train}) "
        f"SELECT symbol, CAST((s - {train}) // {step} AS INTEGER) AS window_id, CAST({start} AS BIGINT) AS train_start, CAST(s AS BIGINT) AS train_end, "
        f"CAST(s AS BIGINT) AS test_start, CAST(s + {test} AS BIGINT) AS test_end FROM w"
    )


register("p01_windows_expanding", lambda s, d: wf.windows(supp_bars(s, d), 200, 50, 50), _windows_sql(200, 50, 50))
register("p01_windows_rolling", lambda s, d: wf.windows(supp_bars(s, d), 200, 50, 50, expanding=False), _windows_sql(200, 50, 50, False))
register(
    "p02_windows_strict", lambda s, d: wf.windows(supp_bars(s, d), 252, 63, 21, expanding=False, strict=True), _windows_sql(252, 63, 21, False, True)
)


def _assign_sql(train, test, step, expanding):
    begin = "0" if expanding else f"{train} + window_id * {step} - {train}"
    return (
        f"WITH {SUPP}, n AS (SELECT *, row_number() OVER ({KEY}) - 1 AS rn, count(*) OVER (PARTITION BY symbol) AS n FROM bars), "
        f"w AS (SELECT symbol, CAST(unnest(generate_series(0, (max(n) - {test} - {train}) // {step})) AS INTEGER) AS window_id FROM n WHERE n - {test} >= {train} GROUP BY 1), "
        f"j AS (SELECT n.*, window_id, CASE WHEN rn >= {train} + window_id * {step} AND rn < {train} + window_id * {step} + {test} THEN 'test' "
        f"WHEN rn >= {begin} AND rn < {train} + window_id * {step} THEN 'train' END AS role FROM n JOIN w USING (symbol)), "
        "a AS (SELECT * FROM j WHERE role IS NOT NULL)"
    )


for _mode, _exp in (("expanding", True), ("rolling", False)):
    register(
        f"p03_assign_{_mode}",
        lambda s, d, e=_exp: wf.assign_windows(supp_bars(s, d), 200, 50, 100, expanding=e).select(*KEYS, "window_id", "role"),
        _assign_sql(200, 50, 100, _exp) + " SELECT symbol, ts, window_id, role FROM a",
    )
register(
    "p04_window_scaling",
    lambda s, d: show(
        windowruns.scaled_tests(supp_bars(s, d), ["close", "volume"], windowruns.Plan(200, 50, 100)),
        [*KEYS, "window_id"],
        6,
        ["close", "volume"],
    ),
    _assign_sql(200, 50, 100, True)
    + ", f AS (SELECT symbol, window_id, avg(close) AS mc, stddev_pop(close) AS sc, avg(volume) AS mv, stddev_pop(volume) AS sv FROM a WHERE role = 'train' GROUP BY 1, 2) "
    + f"SELECT symbol, ts, window_id, {rr(6, close='(close - mc) / sc', volume='(volume - mv) / sv')} FROM a JOIN f USING (symbol, window_id) WHERE role = 'test'",
)
register(
    "p04_window_baseline",
    lambda s, d: show(
        windowruns.baseline_results(windowruns.tested_rows(windowruns.positions(supp_bars(s, d)), windowruns.Plan(200, 50, 100))), ["symbol", "window_id"], 6, ["total_return", "sharpe_ratio", "win_rate"]
    ),
    _assign_sql(200, 50, 100, True)
    + ", t AS (SELECT *, close / lag(close) OVER (PARTITION BY symbol, window_id ORDER BY ts) - 1 AS x FROM a WHERE role = 'test') SELECT symbol, window_id, "
    + rr(6, total_return="arg_max(close, ts) / arg_min(close, ts) - 1", sharpe_ratio=f"coalesce(avg(x) / nullif(stddev_samp(x), 0) * {Y!r}, 0)",
         win_rate="avg(CASE WHEN x > 0 THEN 1.0 WHEN x IS NOT NULL THEN 0.0 END)")
    + " FROM t GROUP BY 1, 2",
)

# results of two rules per supplier and window: long after an up day, always long
HORIZONS = (1, 5)


def window_results(s, d):
    b = rolling(
        supp_bars(s, d),
        lambda w: {f"r{h}": F.try_divide(w.lead("close", h), F.col("close")) - 1 for h in HORIZONS},
        after=max(HORIZONS),
    )
    a = wf.assign_windows(b, 200, 50, 100).filter("role = 'test'")
    long = a.select(
        "symbol",
        "window_id",
        (F.col("close") > F.col("open")).alias("up"),
        F.explode(F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"r{h}").alias("r")) for h in HORIZONS])).alias("_h"),
    ).select("symbol", "window_id", "up", "_h.*")
    long = long.filter("r is not null").select(
        "*", F.explode(F.array(F.lit("up_day"), F.lit("buy_hold"))).alias("model")
    )
    held = (F.col("model") == "buy_hold") | F.col("up")
    x = F.when(held, F.col("r")).otherwise(0.0)
    return long.groupBy("horizon", "model", "symbol", "window_id").agg(
        F.avg(x).alias("total_return"),
        F.coalesce(F.try_divide(F.avg(x), F.stddev_samp(x)), F.lit(0.0)).alias("sharpe_ratio"),
        F.avg((held == (F.col("r") > 0)).cast("double")).alias("accuracy"),
    )


_RESULTS = (
    _assign_sql(200, 50, 100, True).replace(
        "n AS (SELECT *, row_number()",
        f"fw AS (SELECT *, lead(close, 1) OVER ({KEY}) / close - 1 AS r1, lead(close, 5) OVER ({KEY}) / close - 1 AS r5 FROM bars), n AS (SELECT *, row_number()",
    ).replace("OVER (PARTITION BY symbol) AS n FROM bars)", "OVER (PARTITION BY symbol) AS n FROM fw)")
    + ", lo AS (SELECT symbol, window_id, close > open AS up, unnest([1, 5])::INTEGER AS horizon, unnest([r1, r5]) AS r FROM a WHERE role = 'test'), "
    "mo AS (SELECT *, unnest(['up_day', 'buy_hold']) AS model FROM lo WHERE r IS NOT NULL), "
    "xx AS (SELECT *, CASE WHEN model = 'buy_hold' OR up THEN r ELSE 0 END AS x, (model = 'buy_hold' OR up) = (r > 0) AS hit FROM mo), "
    "re AS (SELECT horizon, model, symbol, window_id, avg(x) AS total_return, coalesce(avg(x) / nullif(stddev_samp(x), 0), 0) AS sharpe_ratio, "
    "avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END) AS accuracy FROM xx GROUP BY 1, 2, 3, 4)"
)
_AGG = (
    ", ag AS (SELECT horizon, model, avg(total_return) AS mr, stddev_pop(total_return) AS sr, median(total_return) AS md, sum(ln(1 + total_return)) AS lc, "
    "count(*) FILTER (total_return > 0) AS pos, count(*) FILTER (total_return < 0) AS neg, count(*) AS n, avg(sharpe_ratio) AS ms, avg(accuracy) AS ma FROM re GROUP BY 1, 2)"
)


def aggregated(s, d, by=("symbol", "horizon", "model")):
    return wf.aggregate_windows(window_results(s, d), by=by)


_BY_SERIES = _AGG.replace("SELECT horizon, model, avg", "SELECT symbol, horizon, model, avg").replace("GROUP BY 1, 2)", "GROUP BY 1, 2, 3)")
_AGGREGATES = ["mean_return", "std_return", "median_return", "compound_log_return", "mean_sharpe_ratio", "mean_accuracy"]
_AGGREGATES_SQL = dict(mean_return="mr", std_return="sr", median_return="md", compound_log_return="lc", mean_sharpe_ratio="ms", mean_accuracy="ma")
register(
    "p05_aggregate_windows",
    lambda s, d: show(aggregated(s, d, ("horizon", "model")), ["horizon", "model", "positive_windows", "negative_windows", "total_windows"], 6, _AGGREGATES),
    _RESULTS + _AGG + f" SELECT horizon, model, pos AS positive_windows, neg AS negative_windows, n AS total_windows, {rr(6, **_AGGREGATES_SQL)} FROM ag",
)
register(
    "p05_aggregate_series",
    lambda s, d: show(
        aggregated(s, d), ["symbol", "horizon", "model", "positive_windows", "negative_windows", "total_windows"], 6, [*_AGGREGATES, "compound_return"]
    ),
    _RESULTS + _BY_SERIES + " SELECT symbol, horizon, model, pos AS positive_windows, neg AS negative_windows, n AS total_windows, "
    + rr(6, **_AGGREGATES_SQL, compound_return="exp(lc) - 1") + " FROM ag",
)
register(
    "p06_stability",
    lambda s, d: show(
        wf.stability(window_results(s, d), ["total_return", "sharpe_ratio", "accuracy"], by=("horizon", "model")), ["horizon", "model", "metric", "n"], 6, ["mean", "std"]
    ),
    _RESULTS + ", u AS (SELECT horizon, model, unnest(['total_return', 'sharpe_ratio', 'accuracy']) AS metric, unnest([total_return, sharpe_ratio, accuracy]) AS v FROM re) "
    "SELECT horizon, model, metric, count(v) AS n, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std FROM u GROUP BY 1, 2, 3",
)
register(
    "p07_horizon_report",
    lambda s, d: show(
        wf.horizon_report(aggregated(s, d), by=("symbol",)),
        ["symbol", "horizon", "model", "positive_windows", "negative_windows", "total_windows"],
        4,
        ["mean_return_pct", "compound_return_pct", "std_return_pct", "median_return_pct", "compound_log_return", "mean_sharpe_ratio"],
    ),
    _RESULTS + _BY_SERIES + " SELECT symbol, horizon, model, pos AS positive_windows, neg AS negative_windows, n AS total_windows, "
    + rr(4, mean_return_pct="mr * 100", compound_return_pct="(exp(lc) - 1) * 100", std_return_pct="sr * 100", median_return_pct="md * 100",
         compound_log_return="lc", mean_sharpe_ratio="ms")
    + " FROM ag ORDER BY symbol, horizon, lc DESC, model",
)
# over all series together: the returns of thousands of windows are known by their logarithms
register(
    "p07_horizon_report_all",
    lambda s, d: show(
        wf.horizon_report(aggregated(s, d, ("horizon", "model"))),
        ["horizon", "model", "positive_windows", "negative_windows", "total_windows"],
        4,
        ["mean_return_pct", "std_return_pct", "median_return_pct", "compound_log_return", "mean_sharpe_ratio"],
    ),
    _RESULTS + _AGG + " SELECT horizon, model, pos AS positive_windows, neg AS negative_windows, n AS total_windows, "
    + rr(4, mean_return_pct="mr * 100", std_return_pct="sr * 100", median_return_pct="md * 100", compound_log_return="lc", mean_sharpe_ratio="ms")
    + " FROM ag ORDER BY horizon, lc DESC, model",
)
_BEST = (
    ", b AS (SELECT {by}horizon, max(lc) FILTER (model <> 'buy_hold') AS c, arg_max(model, lc) FILTER (model <> 'buy_hold') AS m, "
    "max(lc) FILTER (model = 'buy_hold') AS h FROM ag GROUP BY ALL) SELECT {by}horizon, m AS model, "
)
_LOGS = {"compound_log_return": "c", "baseline_log_return": "h", "log_gap": "c - h"}
register(
    "p08_best_per_horizon",
    lambda s, d: show(
        wf.best_per_horizon(aggregated(s, d), by=("symbol",)), ["symbol", "horizon", "model"], 6, ["compound_return", "baseline_return", "gap", *_LOGS]
    ),
    _RESULTS + _BY_SERIES + _BEST.format(by="symbol, ") + rr(6, compound_return="exp(c) - 1", baseline_return="exp(h) - 1", gap="exp(c) - exp(h)", **_LOGS) + " FROM b",
)
register(
    "p08_best_per_horizon_all",
    lambda s, d: show(wf.best_per_horizon(aggregated(s, d, ("horizon", "model"))), ["horizon", "model"], 6, list(_LOGS)),
    _RESULTS + _AGG + _BEST.format(by="") + rr(6, **_LOGS) + " FROM b",
)

# --- R: risk

_R1 = f"r AS (SELECT *, {pct('close')} AS r1 FROM bars), v AS (SELECT *, {roll('stddev_samp', 'r1', 20)} AS vol FROM r)"
_METHODS = ("fixed", "percentage", "volatility", "kelly", "risk_parity")


def _decisions(s, d):
    b = rolling(supp_bars(s, d), lambda w: {"_r": w.change("close")}, lambda w: {"vol": w.roll(F.stddev_samp, "_r", 20)}, before=20)
    return b.filter("vol > 0").withColumn("strength", F.col("low") / F.col("high"))


_STRENGTH = "d AS (SELECT *, low / high AS st FROM v WHERE vol > 0)"
_SIZES = {
    "fixed": "1000 * st",
    "percentage": "10000 * 0.05 * st",
    "volatility": "10000 * 0.1 * least(0.02 / greatest(vol, 0.001), 10) * st",
    "kelly": "10000 * greatest(least((0.02 / 0.015 * 0.55 - 0.45) / (0.02 / 0.015) * 0.25 * st, 0.1), 0)",
    "risk_parity": "10000 * 0.05 / vol * st",
}
register(
    "r01_position_size",
    lambda s, d: show(
        _decisions(s, d).select("*", *[risk.position_size(F.col("strength"), F.lit(10_000.0), F.col("vol"), m).alias(f"size_{m}") for m in _METHODS]),
        KEYS,
        4,
        [f"size_{m}" for m in _METHODS],
    ),
    f"WITH {SUPP}, {_R1}, {_STRENGTH} SELECT symbol, ts, "
    + rr(4, **{f"size_{m}": f"CASE WHEN least({e}, 1000) < 10 THEN 0 ELSE least({e}, 1000) END" for m, e in _SIZES.items()})
    + " FROM d",
)


def _proposals(s, d):
    b = metrics.drawdown_series(known(s, d), value="close")
    return b.select(
        *KEYS,
        (F.col("volume") / 100.0).alias("quantity"),
        F.col("close").alias("price"),
        F.lit(10_000.0).alias("value"),
        (F.col("volume") * 80.0).alias("held_value"),
        F.abs("ret").alias("var"),
        F.lit(300).alias("history"),
        "drawdown",
    )


_PROP = (
    f"{RETS}, p1 AS (SELECT *, {so_far('max(close)')} AS pk FROM k), p2 AS (SELECT *, (close - pk) / pk AS dd, volume / 100.0 * close AS pr FROM p1), "
    "vi AS (SELECT *, list_filter([CASE WHEN pr / 10000 > 0.1 THEN 'position_weight' END, CASE WHEN (volume * 80 + pr) / 10000 > 0.5 THEN 'concentration' END, "
    "CASE WHEN abs(x) > 0.05 THEN 'portfolio_var' END, CASE WHEN dd < -0.2 THEN 'drawdown' END], lambda e: e IS NOT NULL) AS v FROM p2)"
)
register(
    "r02_limits",
    lambda s, d: risk.check_limits(_proposals(s, d)).select(*KEYS, "allowed", F.array_join("violations", ",").alias("violations")),
    f"WITH {_PROP} SELECT symbol, ts, len(v) = 0 AS allowed, array_to_string(v, ',') AS violations FROM vi",
)


def _stops(s, d):
    b = indicators.add_recursive(_decisions(s, d), ["atr"])
    long = F.col("close") > F.col("open")
    out = {}
    for name, kw in (("vol", {"volatility": F.col("vol")}), ("atr", {"atr": F.col("atr")}), ("fixed", {})):
        out[f"sl_{name}"], out[f"tp_{name}"] = risk.stop_levels(F.col("close"), long, **kw)
    return b.select(*KEYS, *[(c / F.col("close")).alias(n) for n, c in out.items()])


_SIDE = "(CASE WHEN close > open THEN 1.0 ELSE -1.0 END)"
_TRD = f"n AS (SELECT *, row_number() OVER ({KEY}) AS rn FROM d), h AS (SELECT *, greatest(high - low, abs(high - {lag('close')}), abs(low - {lag('close')})) AS tr FROM n)"
register(
    "r03_stop_levels",
    lambda s, d: show(_stops(s, d), KEYS, 6, ["sl_vol", "tp_vol", "sl_atr", "tp_atr"]),
    f"WITH RECURSIVE {SUPP}, {_R1}, {_STRENGTH}, {_TRD}, {', '.join(ewm_ctes('e', 'h', {'a': ('s.tr', 1 / 14.0)}))}, "
    "z AS (SELECT *, CASE WHEN rn >= 14 THEN a / close END AS sh FROM e) SELECT symbol, ts, "
    + rr(6, sl_vol=f"1 - {_SIDE} * greatest(vol * 2, 0.05)", tp_vol=f"1 + {_SIDE} * greatest(vol * 3, 0.1)",
         sl_atr=f"1 - {_SIDE} * coalesce(sh * 2, 0.05)", tp_atr=f"1 + {_SIDE} * coalesce(sh * 3, 0.1)")
    + " FROM z",
)

# portfolio of the three long series, weighted
_W = {"A": 0.5, "N": 0.2, "R": 0.3}


def _weights(s):
    return s.createDataFrame(list(_W.items()), "symbol string, weight double")


def portfolio(s, d):
    return risk.portfolio_returns(flag_bars(s, d), _weights(s))


_PF = (
    f"{FLAG}, r AS (SELECT *, {pct('close')} AS r1 FROM bars), wt AS (SELECT * FROM (VALUES {', '.join(f'({k!r}, {v})' for k, v in _W.items())}) AS t(symbol, weight)), "
    "pf AS (SELECT r.ts AS ts, sum(r1 * weight) AS x FROM r JOIN wt USING (symbol) WHERE r1 IS NOT NULL GROUP BY 1 HAVING count(*) = 3)"
)
register("r04_portfolio_returns", lambda s, d: show(portfolio(s, d), ["ts"], 6, ["ret"]), f"WITH {_PF} SELECT ts, round(x, 6) AS ret FROM pf")


def _portfolio_risk(s, d):
    bench = rolling(flag_bars(s, d).filter("symbol = 'A'"), lambda w: {"bench": w.change("close")}, before=1)
    return risk.portfolio_risk(portfolio(s, d), bench.filter("bench is not null").select("ts", "bench"))


_RISK = (
    f"{_PF}, q AS (SELECT quantile_cont(x, 0.05) AS v FROM pf), "
    "va AS (SELECT ts, x, sum(ln(1 + x)) OVER (ORDER BY ts ROWS UNBOUNDED PRECEDING) AS lv FROM pf), "
    "pk AS (SELECT *, exp(lv - max(lv) OVER (ORDER BY ts ROWS UNBOUNDED PRECEDING)) - 1 AS dd FROM va), "
    "bb AS (SELECT ts, r1 AS y FROM r WHERE symbol = 'A' AND r1 IS NOT NULL), "
    "rk AS (SELECT abs(max(v)) AS pv, abs(avg(x) FILTER (x <= v)) AS pc, "
    f"stddev_samp(x) * {Y!r} AS vol, min(dd) AS mdd, arg_max(dd, pk.ts) AS cdd, (avg(x) - 0.02 / 252) / stddev_samp(x) * {Y!r} AS sh FROM pk, q), "
    "be AS (SELECT covar_samp(x, y) / var_samp(y) AS beta, corr(x, y) AS co FROM pf JOIN bb USING (ts)), al AS (SELECT * FROM rk, be)"
)
register(
    "r05_portfolio_risk",
    lambda s, d: show(
        _portfolio_risk(s, d),
        ["portfolio"],
        6,
        ["portfolio_var", "portfolio_cvar", "volatility", "max_drawdown", "current_drawdown", "sharpe_ratio", "beta", "correlation"],
    ),
    f"WITH {_RISK} SELECT 'all' AS portfolio, "
    + rr(6, portfolio_var="pv", portfolio_cvar="pc", volatility="vol", max_drawdown="mdd", current_drawdown="cdd", sharpe_ratio="sh", beta="beta", correlation="co")
    + " FROM al",
)


# risk rows of every supplier as a portfolio of its own
def _supplier_risk(s, d):
    r = known(s, d).select(F.col("symbol").alias("portfolio"), "ts", "ret")
    return risk.portfolio_risk(r).withColumn("risky_weight", F.pmod(F.col("portfolio").cast("long"), F.lit(10)) / 10.0)


_SR = (
    f"{RETS}, q AS (SELECT symbol, quantile_cont(x, 0.05) AS v FROM k GROUP BY 1), "
    f"va AS (SELECT *, {so_far('sum(ln(1 + x))')} AS lv FROM k), pk AS (SELECT *, exp(lv - {so_far('max(lv)')}) - 1 AS dd FROM va), "
    f"rk AS (SELECT symbol, abs(max(v)) AS pv, stddev_samp(x) * {Y!r} AS vol, arg_max(dd, ts) AS cdd, (avg(x) - 0.02 / 252) / stddev_samp(x) * {Y!r} AS sh, "
    "(CAST(symbol AS BIGINT) % 10) / 10.0 AS rw FROM pk JOIN q USING (symbol) GROUP BY symbol)"
)
register(
    "r06_alerts",
    lambda s, d: risk.alerts(_supplier_risk(s, d)).select("portfolio", "alert"),
    f"WITH {_SR}, a AS (SELECT symbol AS portfolio, unnest([CASE WHEN pv > 0.04 THEN 'var' END, CASE WHEN cdd < -0.16 THEN 'drawdown' END, "
    "CASE WHEN rw > 0.4 THEN 'concentration' END, CASE WHEN vol > 0.4 THEN 'volatility' END, CASE WHEN sh < 0 THEN 'sharpe' END]) AS alert FROM rk) "
    "SELECT * FROM a WHERE alert IS NOT NULL",
)
_LIM = risk.Limits(max_var=2.0, max_drawdown=1.5)
register(
    "r07_risk_level",
    lambda s, d: show(risk.risk_level(_supplier_risk(s, d), _LIM), ["portfolio", "risk_level"], 6, ["var_utilisation", "drawdown_utilisation", "risk_score"]),
    f"WITH {_SR}, z AS (SELECT symbol AS portfolio, pv / 2.0 AS vu, abs(cdd) / 1.5 AS du, "
    "0.3 * pv / 2.0 + 0.3 * abs(cdd) / 1.5 + 0.2 * least(vol / 0.3, 1) + 0.2 * CASE WHEN sh > 0 THEN greatest(0, (2 - sh) / 2) ELSE 1 END AS sc FROM rk) "
    "SELECT portfolio, CASE WHEN sc < 0.3 THEN 'LOW' WHEN sc < 0.6 THEN 'MEDIUM' WHEN sc < 0.8 THEN 'HIGH' ELSE 'CRITICAL' END AS risk_level, "
    + rr(6, var_utilisation="vu", drawdown_utilisation="du", risk_score="sc")
    + " FROM z",
)
register(
    "r08_emergency",
    lambda s, d: metrics.drawdown_series(known(s, d), value="close").select(
        *KEYS, risk.emergency(F.col("drawdown"), F.abs("ret")).alias("reason")
    ),
    f"WITH {_PROP} SELECT symbol, ts, CASE WHEN dd < -0.24 THEN 'drawdown' WHEN abs(x) > 0.1 THEN 'var' END AS reason FROM p2",
)

# --- S: reports

register(
    "s01_executive_summary",
    lambda s, d: show(
        reports.executive_summary(returns(s, d).withColumn("equity", F.col("close"))),
        ["symbol", "start", "end", "total_trades"],
        5,
        ["initial_capital", "final_capital", "total_return", "volatility", "sharpe_ratio", "max_drawdown", "win_rate"],
        ["initial_capital", "final_capital"],
    ),
    f"WITH {RETS}, {', '.join(DD)}, a AS (SELECT symbol, count(*) AS tt, product(1 + x) - 1 AS tr, stddev_samp(x) * {Y!r} AS vol, "
    f"(avg(x) - 0.02 / 252) / stddev_samp(x) * {Y!r} AS sh, avg(CASE WHEN x > 0 THEN 1.0 ELSE 0.0 END) AS wr FROM k GROUP BY 1), "
    "b AS (SELECT symbol, min(ts) AS t0, max(ts) AS t1, arg_min(close, ts) AS c0, arg_max(close, ts) AS c1 FROM bars GROUP BY 1), "
    'z AS (SELECT * FROM a JOIN b USING (symbol) JOIN dd USING (symbol)) SELECT symbol, t0 AS start, t1 AS "end", tt AS total_trades, '
    + rr(5, ["initial_capital", "final_capital"], initial_capital="c0", final_capital="c1", total_return="tr", volatility="vol", sharpe_ratio="sh", max_drawdown="maxdd", win_rate="wr")
    + " FROM z",
)
register(
    "s02_return_distribution",
    lambda s, d: show(
        reports.return_distribution(known(s, d)), ["symbol", "n", "positive", "negative", "zero"], 6, ["mean", "std", "worst", "best", "positive_pct"]
    ),
    f"WITH {RETS} SELECT symbol, count(*) AS n, count(*) FILTER (x > 0) AS positive, count(*) FILTER (x < 0) AS negative, count(*) FILTER (x = 0) AS zero, "
    + rr(6, mean="avg(x)", std="stddev_samp(x)", worst="min(x)", best="max(x)", positive_pct="avg(CASE WHEN x > 0 THEN 100.0 ELSE 0.0 END)")
    + " FROM k GROUP BY 1",
)
_RP = {}
for _n in (30, 60, 90, 252):
    _a, _b = roll("avg", "x", _n), roll("stddev_samp", "x", _n)
    _RP |= {f"rolling_vol_{_n}": f"({_b}) * {Y!r}", f"rolling_sharpe_{_n}": f"({_a}) / nullif({_b}, 0) * {Y!r}", f"rolling_return_{_n}": f"({_a}) * 252"}
register(
    "s03_rolling_performance",
    lambda s, d: show(reports.add_rolling_performance(known(s, d)), KEYS, 5, list(_RP)),
    f"WITH {RETS} SELECT symbol, ts, {rr(5, **_RP)} FROM k",
)
register(
    "s03_last_rolling",
    lambda s, d: show(reports.last_rolling(known(s, d)), ["symbol"], 5, [f"rolling_{m}_{n}" for n in (30, 90) for m in ("vol", "sharpe")]),
    f"WITH {RETS}, a AS (SELECT symbol, ts, {', '.join(f'{e} AS {n}' for n, e in _RP.items() if n.split('_')[1] != 'return' and n.endswith(('30', '90')))} FROM k) SELECT symbol, "
    + rr(5, **{f"rolling_{m}_{n}": f"arg_max(rolling_{m}_{n}, ts)" for n in (30, 90) for m in ("vol", "sharpe")})
    + " FROM a GROUP BY 1",
)
register(
    "s04_tail_risk",
    lambda s, d: show(reports.tail_risk(known(s, d)), ["symbol"], 6, ["var_95", "var_99", "cvar_95", "cvar_99", "tail_ratio"]),
    f"WITH {RETS}, q AS (SELECT symbol, quantile_cont(x, 0.05) AS v95, quantile_cont(x, 0.01) AS v99, quantile_cont(x, 0.95) AS u FROM k GROUP BY 1), "
    "j AS (SELECT * FROM k JOIN q USING (symbol)) SELECT symbol, "
    + rr(6, var_95="max(v95)", var_99="max(v99)", cvar_95="avg(x) FILTER (x <= v95)", cvar_99="avg(x) FILTER (x <= v99)", tail_ratio="max(u) / abs(max(v95))")
    + " FROM j GROUP BY 1",
)
register(
    "s05_risk_report",
    lambda s, d: show(
        reports.risk_report(returns(s, d), value="close"), ["symbol", "drawdown_periods"], 6, ["vol_of_vol", "time_underwater"]
    ),
    f"WITH {RETS}, {', '.join(DD)}, v AS (SELECT *, {roll('stddev_samp', 'x', 30)} AS v30 FROM r), a AS (SELECT symbol, stddev_samp(v30) AS vv FROM v GROUP BY 1), "
    "u AS (SELECT symbol, avg(CASE WHEN dd < 0 THEN 1.0 ELSE 0.0 END) AS uw FROM p2 GROUP BY 1), z AS (SELECT * FROM a JOIN u USING (symbol) JOIN dl USING (symbol)) "
    "SELECT symbol, np AS drawdown_periods, round(vv, 6) AS vol_of_vol, round(uw, 6) AS time_underwater FROM z",
)
_EPI = (
    f"{', '.join(DD[:4])}, nx AS (SELECT *, lead(ts) OVER ({KEY}) AS nt, lead(close) OVER ({KEY}) AS nc FROM p4), "
    "ep AS (SELECT symbol, isl, min(ts) AS st, coalesce(arg_max(nt, ts), NULL) AS n1, max(ts) AS t1, count(*) AS du, max(peak) AS pk, min(close) AS tv, bool_or(nt IS NULL) AS og FROM nx WHERE dd < 0 GROUP BY 1, 2), "
    "rc AS (SELECT ep.*, nx.nc FROM ep JOIN nx ON nx.symbol = ep.symbol AND nx.ts = ep.t1)"
)
_EP_OUT = "symbol, st AS start, CASE WHEN og THEN t1 ELSE n1 END AS \"end\", du AS duration, og AS ongoing, "
_EP_COLS = ["depth", "peak_value", "trough_value", "recovery_value"]
register(
    "s06_drawdown_episodes",
    lambda s, d: show(reports.drawdown_episodes(supp_bars(s, d), value="close"), ["symbol", "start", "end", "duration", "ongoing"], 6, _EP_COLS, _EP_COLS[1:]),
    f"WITH {SUPP}, {_EPI} SELECT {_EP_OUT}{rr(6, _EP_COLS[1:], depth='(pk - tv) / pk', peak_value='pk', trough_value='tv', recovery_value='nc')} FROM rc",
)
register(
    "s06_deepest_drawdowns",
    lambda s, d: show(reports.drawdown_episodes(supp_bars(s, d), 10, value="close"), ["symbol", "start", "duration", "rank"], 6, ["depth"]),
    f"WITH {SUPP}, {_EPI}, rk AS (SELECT *, CAST(row_number() OVER (PARTITION BY symbol ORDER BY (pk - tv) / pk DESC, st) AS INTEGER) AS rank FROM rc) "
    "SELECT symbol, st AS start, du AS duration, rank, round((pk - tv) / pk, 6) AS depth FROM rk WHERE rank <= 10",
)


# line items as the trade table
def _trade_rows(s, d):
    t = line_ticks(s, d, "l_suppkey")
    return t.select(
        "symbol", "ts", "seq", F.when(F.col("size") > 25, "buy").otherwise("sell").alias("side"), F.col("size").alias("quantity"),
        "price", (F.col("size") * 2.0).alias("value"), (F.col("size") * 0.5).alias("commission"),
    )


_TR = f"{line_ticks_sql('l_suppkey')}, t AS (SELECT *, CASE WHEN q > 25 THEN 'buy' ELSE 'sell' END AS side, q * 2.0 AS v, q * 0.5 AS c, (epoch(ts) - epoch(lag(ts) OVER ({KEY}))) / 3600.0 AS gap FROM ticks)"
register(
    "s07_trade_statistics",
    lambda s, d: show(
        reports.trade_statistics(_trade_rows(s, d), order=["seq"], blocks=line_blocks(20_000)),
        ["symbol", "total_trades", "buy_trades", "sell_trades"],
        4,
        ["average_trade_size", "total_volume", "total_commission", "average_hours_between", "min_hours_between", "max_hours_between", "trades_per_day", "average_price", "std_price"],
    ),
    f"WITH {_TR} SELECT symbol, count(*) AS total_trades, count(*) FILTER (side = 'buy') AS buy_trades, count(*) FILTER (side = 'sell') AS sell_trades, "
    + rr(4, average_trade_size="avg(q)", total_volume="sum(v)", total_commission="sum(c)", average_hours_between="avg(gap)", min_hours_between="min(gap)",
         max_hours_between="max(gap)", trades_per_day="count(*) / (floor((epoch(max(ts)) - epoch(min(ts))) / 86400) + 1)", average_price="avg(p)", std_price="stddev_samp(p)")
    + " FROM t GROUP BY 1",
)
register(
    "s08_trades_per_day",
    lambda s, d: show(reports.trades_per_day(_trade_rows(s, d)).withColumn("day", F.col("day").cast("timestamp_ntz")), ["symbol", "day", "trades"], 4, ["cumulative_volume"]),
    f"WITH {_TR}, g AS (SELECT symbol, date_trunc('day', ts)::TIMESTAMP AS day, count(*) AS trades, sum(v) AS v FROM t GROUP BY 1, 2) "
    "SELECT symbol, day, trades, round(sum(v) OVER (PARTITION BY symbol ORDER BY day ROWS UNBOUNDED PRECEDING), 4) AS cumulative_volume FROM g",
)
# monthly product of bars with wide swings: compare on a log scale
_MON = f"{RETS}, mo AS (SELECT symbol, CAST(year(ts) AS INTEGER) AS year, CAST(month(ts) AS INTEGER) AS month, product(1 + x) - 1 AS m FROM k GROUP BY 1, 2, 3)"
register(
    "s09_monthly_returns",
    lambda s, d: show(
        reports.monthly_returns(known(s, d)).withColumn("log_return", F.log1p("monthly_return")), ["symbol", "year", "month"], 6, ["log_return"]
    ),
    f"WITH {_MON} SELECT symbol, year, month, round(ln(1 + m), 6) AS log_return FROM mo",
)


def _monthly_table(s, d):
    m = reports.monthly_table(reports.monthly_returns(known(s, d)))
    return m.select("symbol", "year", *[F.round(F.log1p(f"m{i}"), 6).alias(f"m{i}") for i in range(1, 13)])


register(
    "s09_monthly_table",
    _monthly_table,
    f"WITH {_MON} SELECT symbol, year, " + ", ".join(f"round(ln(1 + max(m) FILTER (month = {i})), 6) AS m{i}" for i in range(1, 13)) + " FROM mo GROUP BY 1, 2",
)
register(
    "s10_histogram",
    lambda s, d: show(reports.histogram(known(s, d)), ["symbol", "bin", "n"], 6, ["left_edge"]),
    f"WITH {RETS}, l AS (SELECT symbol, min(x) AS lo, max(x) AS hi FROM k GROUP BY 1), "
    "b AS (SELECT *, CAST(least(coalesce(floor((x - lo) / nullif((hi - lo) / 50, 0)), 0), 49) AS INTEGER) AS bin FROM k JOIN l USING (symbol)) "
    "SELECT symbol, bin, count(*) AS n, round(max(lo) + bin * (max(hi) - max(lo)) / 50, 6) AS left_edge FROM b GROUP BY 1, 2",
)
columns_query(
    "s11_rebase",
    supp_bars,
    SUPP,
    lambda b: reports.rebase(b, "close"),
    {"rebased": "close / f * 100"},
    ctes=["a AS (SELECT *, first_value(close) OVER (PARTITION BY symbol ORDER BY ts) AS f FROM bars)"],
    source="a",
)
register(
    "s12_underwater",
    lambda s, d: show(reports.underwater(equity(s, d)), KEYS, 6, ["drawdown"]),
    f"WITH {CHAIN_SQL}, d AS (SELECT *, equity / {so_far('max(equity)')} - 1 AS dd FROM eq) SELECT symbol, ts, round(dd, 6) AS drawdown FROM d",
)

# --- I: feature frame and selection

_FEATURES = ("return_1d", "return_2d", "return_5d", "price_ma_distance_5", "price_ma_distance_20", "volatility_5d", "volatility_20d", "price_position", "high_low_ratio")


def features(s, d):
    b = indicators.add_features(supp_bars(s, d), "returns", "price_ma_distance", "volatility", "bar_shape", "price_ratios")
    return rolling(b, lambda w: {"target": F.try_divide(w.lead("close"), F.col("close")) - 1}, after=1)


_FE = (
    f"{SUPP}, r AS (SELECT *, {pct('close')} AS return_1d FROM bars), fe AS (SELECT symbol, ts, return_1d, {pct('close', 2)} AS return_2d, {pct('close', 5)} AS return_5d, "
    + ", ".join(f"(close - ({roll('avg', 'close', n)})) / ({roll('avg', 'close', n)}) AS price_ma_distance_{n}" for n in (5, 20))
    + ", "
    + ", ".join(f"({roll('stddev_samp', 'return_1d', n)}) * {Y!r} AS volatility_{n}d" for n in (5, 20))
    + f", (close - low) / nullif(high - low, 0) AS price_position, high / low AS high_low_ratio, lead(close) OVER ({KEY}) / close - 1 AS target FROM r)"
)


columns_query(
    "i02_finite",
    supp_bars,
    SUPP,
    lambda b: selection.finite_columns(
        b.withColumns({"a": F.when(F.dayofmonth("ts") == 1, float("inf")).when(F.dayofmonth("ts") == 2, float("nan")).otherwise(F.col("close"))})
    ),
    {"a": "CASE WHEN day(ts) > 2 THEN close END"},
    raw=["a"],
)
register(
    "i03_non_null_share",
    lambda s, d: show(selection.non_null_share(features(s, d).select(*_FEATURES)), ["column"], 6, ["share"]),
    f"WITH {_FE} " + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", round(count({c}) / count(*), 6) AS share FROM fe" for c in _FEATURES),
)
register(
    "i03_drop_sparse",
    lambda s, d: _sparse(s, d),
    f"WITH {SUPP} SELECT symbol, ts, close AS kept FROM bars",
)


def _sparse(s, d):
    b = supp_bars(s, d).select(*KEYS, F.col("close").alias("kept"), F.when(F.dayofmonth("ts") < 10, F.col("close")).alias("sparse"))
    return selection.drop_sparse(b, 0.5)


_CORR = " UNION ALL ".join(f"SELECT '{c}' AS feature, round(abs(corr({c}, target)), 6) AS importance FROM fe" for c in _FEATURES)
register(
    "i04_importance_correlation",
    lambda s, d: show(selection.importance(features(s, d), "target", _FEATURES), ["feature"], 6, ["importance"]),
    f"WITH {_FE} {_CORR}",
)
_BIN = "CASE WHEN {0} IS NOT NULL THEN CAST(least(coalesce(floor(({0} - (SELECT min({0}) FROM fe)) / nullif((SELECT max({0}) - min({0}) FROM fe), 0) * 10), 0), 9) AS INTEGER) END"
register(
    "i05_importance_mutual_information",
    lambda s, d: show(selection.importance(features(s, d), "target", _FEATURES, "mutual_info"), ["feature"], 6, ["importance"]),
    f"WITH {_FE}, bi AS (SELECT " + ", ".join(f"{_BIN.format(c)} AS {c}" for c in (*_FEATURES, "target")) + " FROM fe), "
    "lo AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, {c} AS x, target AS y FROM bi" for c in _FEATURES) + "), "
    "jo AS (SELECT feature, x, y, count(*) AS n FROM lo WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY 1, 2, 3), "
    "mi AS (SELECT *, sum(n) OVER (PARTITION BY feature, x) AS nx, sum(n) OVER (PARTITION BY feature, y) AS ny, sum(n) OVER (PARTITION BY feature) AS t FROM jo) "
    "SELECT feature, round(sum(n / t * ln(n * t / (nx * ny))), 6) AS importance FROM mi GROUP BY 1",
)
register(
    "i06_top_features",
    lambda s, d: show(selection.top_features(selection.importance(features(s, d), "target", _FEATURES), 4), ["feature"], 6, ["importance"]),
    f"WITH {_FE}, c AS ({_CORR}) SELECT * FROM c ORDER BY importance DESC, feature LIMIT 4",
)
_PAIRS = [(i, a, j, b) for i, a in enumerate(_FEATURES) for j, b in enumerate(_FEATURES) if i < j]
_MATRIX = " UNION ALL ".join(f"SELECT {i} AS i, '{a}' AS a, {j} AS j, '{b}' AS b, abs(corr({a}, {b})) AS r FROM fe" for i, a, j, b in _PAIRS)
register(
    "i07_correlation_matrix",
    lambda s, d: show(selection.correlation_matrix(features(s, d), _FEATURES), ["i", "a", "j", "b"], 6, ["r"]),
    f"WITH {_FE}, m AS ({_MATRIX}) SELECT i, a, j, b, round(r, 6) AS r FROM m",
)
register(
    "i08_correlated_features",
    lambda s, d: show(
        selection.correlated_features(selection.correlation_matrix(features(s, d), _FEATURES), 0.6), ["feature", "correlated_with", "n"], 6, ["correlation"]
    ),
    f"WITH {_FE}, m AS ({_MATRIX}) SELECT b AS feature, arg_min(a, i) AS correlated_with, round(arg_min(r, i), 6) AS correlation, count(*) AS n FROM m WHERE r > 0.6 GROUP BY 1",
)
register(
    "i11_mean_correlation",
    lambda s, d: show(selection.mean_correlation(selection.correlation_matrix(features(s, d), _FEATURES)), ["feature"], 6, ["mean_abs_corr"]),
    f"WITH {_FE}, m AS ({_MATRIX}), u AS (SELECT a AS feature, r FROM m UNION ALL SELECT b, r FROM m) SELECT feature, round(avg(r), 6) AS mean_abs_corr FROM u GROUP BY 1",
)

# --- F6: parabolic stop, one state machine per series, checked by a recursive CTE

_PSAR = (
    f"n AS (SELECT *, row_number() OVER ({KEY}) AS rn, {lag('high')} AS h1, {lag('high', 2)} AS h2, {lag('low')} AS l1, {lag('low', 2)} AS l2 FROM bars), "
    "ps(symbol, rn, ts, tr, sar, ep, af, o) AS (SELECT symbol, rn, ts, 1, low, high, 0.02::DOUBLE, NULL::DOUBLE FROM n WHERE rn = 1 UNION ALL "
    "SELECT symbol, rn, ts, CASE WHEN rn > 2 AND flip THEN -tr ELSE tr END, CASE WHEN rn = 2 THEN sar WHEN flip THEN ep ELSE s2 END, "
    "CASE WHEN rn = 2 THEN greatest(ep, high) WHEN flip THEN CASE WHEN tr > 0 THEN low ELSE high END WHEN tr > 0 THEN greatest(ep, high) ELSE least(ep, low) END, "
    "CASE WHEN rn = 2 THEN af WHEN flip THEN 0.02 WHEN (tr > 0 AND high > ep) OR (tr < 0 AND low < ep) THEN least(af + 0.02, 0.2) ELSE af END, "
    "CASE WHEN rn > 2 THEN CASE WHEN flip THEN ep ELSE s2 END END FROM (SELECT x.*, CASE WHEN tr > 0 THEN low < s2 ELSE high > s2 END AS flip FROM "
    "(SELECT n.symbol, n.rn, n.ts, n.high, n.low, ps.tr, ps.sar, ps.ep, ps.af, CASE WHEN ps.tr > 0 THEN least(ps.sar + ps.af * (ps.ep - ps.sar), n.l1, n.l2) "
    "ELSE greatest(ps.sar + ps.af * (ps.ep - ps.sar), n.h1, n.h2) END AS s2 FROM ps JOIN n ON n.symbol = ps.symbol AND n.rn = ps.rn + 1) x))"
)
columns_query("f06_psar", supp_bars, SUPP, folds.add_psar, {"psar": "o"}, ctes=[_PSAR], source="ps", recursive=True, raw=["psar"])

# --- long tick series: the same operators in blocks, so no task holds a whole series

TICK_ORDER = ("ts", "seq")


def flag_ticks(s, d):
    return line_ticks(s, d, "l_returnflag")


def _blocks():
    return line_blocks(2_000)


_TK = line_ticks_sql("l_returnflag")
_TKEY = "PARTITION BY symbol ORDER BY ts, k"


def _tick_keys(df):
    return df.withColumn("seq", F.col("seq").cast("string"))


_SEQ = "CAST(k.l_orderkey AS HUGEINT) * 10000000000000000000000000 + k.l_linenumber::HUGEINT * 100000000000000000000000 + k.l_partkey::HUGEINT * 100000000000 + k.l_suppkey"
_TICKS = _TK + f", t AS (SELECT symbol, ts, CAST({_SEQ} AS VARCHAR) AS seq, p, q, k FROM ticks)"
_TICKS = _TICKS.replace("row(l_orderkey, l_linenumber, l_partkey, l_suppkey) AS k", "{'l_orderkey': l_orderkey, 'l_linenumber': l_linenumber, 'l_partkey': l_partkey, 'l_suppkey': l_suppkey} AS k")
register(
    "x01_blocked_rolling_ticks",
    lambda s, d: show(
        _tick_keys(
            rolling(
                flag_ticks(s, d),
                lambda w: {"mean_50": w.roll(F.avg, "price", 50), "high_50": w.roll(F.max, "price", 50), "ahead": w.lead("price", 3)},
                before=49,
                after=3,
                ts=TICK_ORDER,
                blocks=_blocks(),
            )
        ),
        ["symbol", "ts", "seq"],
        4,
        ["mean_50", "high_50", "ahead"],
        ["high_50", "ahead"],
    ),
    f"WITH {_TICKS} SELECT symbol, ts, seq, "
    + rr(4, ["high_50", "ahead"], mean_50=roll("avg", "p", 50, key=_TKEY), high_50=roll("max", "p", 50, key=_TKEY), ahead=f"lead(p, 3) OVER ({_TKEY})")
    + " FROM t",
)
register(
    "x02_blocked_running_ticks",
    lambda s, d: show(
        _tick_keys(
            running(
                flag_ticks(s, d),
                {"volume": ("sum", F.col("size")), "peak": ("max", F.col("price")), "last_big": ("last", F.when(F.col("size") > 45, F.col("price")))},
                ts=TICK_ORDER,
                blocks=_blocks(),
            )
        ),
        ["symbol", "ts", "seq"],
        4,
        ["volume", "peak", "last_big"],
        ["peak", "last_big"],
    ),
    f"WITH {_TICKS} SELECT symbol, ts, seq, "
    + rr(4, ["peak", "last_big"], volume=so_far("sum(q)", _TKEY), peak=so_far("max(p)", _TKEY), last_big=so_far("last_value(CASE WHEN q > 45 THEN p END IGNORE NULLS)", _TKEY))
    + " FROM t",
)
register(
    "x03_blocked_ema_ticks",
    lambda s, d: show(
        _tick_keys(
            ewm(cut(flag_ticks(s, d)), {"ema_20": (F.col("price"), 2.0 / 21.0, 20), "ema_200": (F.col("price"), 2.0 / 201.0, 200)}, ts=TICK_ORDER, blocks=_blocks())
        ),
        ["symbol", "ts", "seq"],
        5,
        ["ema_20", "ema_200"],
    ),
    f"WITH RECURSIVE {_TICKS}, n AS (SELECT *, row_number() OVER ({_TKEY}) AS rn FROM t), "
    + ", ".join(ewm_ctes("e", "n", {"a": ("s.p", 2.0 / 21.0), "b": ("s.p", 2.0 / 201.0)}))
    + f" SELECT symbol, ts, seq, {rr(5, ema_20='CASE WHEN rn >= 20 THEN a END', ema_200='CASE WHEN rn >= 200 THEN b END')} FROM e",
)

# --- I: the whole feature frame, next to the SQL of each of its columns

NUDGE = 1.3e-7  # the engines round halves differently: off the halves before rounding
FRAME_COLUMNS: dict[str, tuple[str, int | None]] = {}  # column -> (query that checks it, its digits)
for _query, (_digits, _) in COLUMNS.items():
    if _query[0] in "fgh" and _query != "g15_intraday":
        for _c, _n in _digits.items():
            FRAME_COLUMNS.setdefault(_c, (_query, _n))


def frame(s, d):
    """The feature frame of the long series, rounded like its SQL."""
    f = selection.feature_frame(flag_bars(s, d)).withColumn("log_nvi", F.ln("nvi")).drop("nvi")
    columns = selection.feature_columns(f)

    def shown(c: str):
        x, digits = F.col(c).cast("double"), FRAME_COLUMNS[c][1]
        return (x if digits is None else F.round(x + NUDGE, digits)).alias(c)

    return f.select(*KEYS, *[shown(c) for c in columns])


def _quoted(column: str) -> str:
    return '"pivot"' if column == "pivot" else column  # the only one that is a word of SQL


def _frame_sql() -> str:
    parts = [f"(SELECT symbol, ts, {', '.join(_quoted(c) for c, (q, _) in FRAME_COLUMNS.items() if q == name)} FROM ({COLUMNS[name][1](FLAG, NUDGE)}))" for name in dict.fromkeys(q for q, _ in FRAME_COLUMNS.values())]
    return "SELECT * FROM " + " JOIN ".join(p if i == 0 else f"{p} USING (symbol, ts)" for i, p in enumerate(parts))


register("i01_feature_frame", frame, _frame_sql())


def _frame_correlations(s, d):
    f = cut(frame(s, d))
    return selection.correlation_matrix(f, sorted(selection.feature_columns(f)))


_NAMES = sorted(FRAME_COLUMNS)
_CORRELATIONS = ", ".join(f"corr({_quoted(a)}, {_quoted(b)})" for i, a in enumerate(_NAMES) for b in _NAMES[i + 1 :])
_ALL_PAIRS = (
    f"fr AS MATERIALIZED ({_frame_sql()}), one AS (SELECT [{_CORRELATIONS}] AS p FROM fr), "
    "k AS (SELECT unnest(p) AS r, generate_subscripts(p, 1) AS k FROM one), "
    f"nm AS (SELECT {_NAMES!r} AS names), ij AS (SELECT i, j, row_number() OVER (ORDER BY i, j) AS k FROM range({len(_NAMES)}) a(i), range({len(_NAMES)}) b(j) WHERE i < j), "
    "m AS (SELECT CAST(i AS INTEGER) AS i, names[i + 1] AS a, names[j + 1] AS b, abs(CASE WHEN NOT isnan(r) THEN r END) AS r FROM ij JOIN k USING (k), nm)"
)
register(
    "i07_frame_correlations",
    lambda s, d: show(_frame_correlations(s, d), ["a", "b"], 4, ["r"]),
    f"WITH {_ALL_PAIRS} SELECT a, b, round(r, 4) AS r FROM m",
)
register(
    "i08_frame_correlated",
    lambda s, d: show(selection.correlated_features(_frame_correlations(s, d), 0.95), ["feature", "correlated_with", "n"], 4, ["correlation"]),
    f"WITH {_ALL_PAIRS} SELECT b AS feature, arg_min(a, i) AS correlated_with, round(arg_min(r, i), 4) AS correlation, count(*) AS n FROM m WHERE r > 0.95 GROUP BY 1",
)
register(
    "i11_frame_mean_correlation",
    lambda s, d: show(selection.mean_correlation(_frame_correlations(s, d)), ["feature"], 4, ["mean_abs_corr"]),
    f"WITH {_ALL_PAIRS}, u AS (SELECT a AS feature, r FROM m UNION ALL SELECT b, r FROM m) SELECT feature, round(avg(r), 4) AS mean_abs_corr FROM u GROUP BY 1",
)
