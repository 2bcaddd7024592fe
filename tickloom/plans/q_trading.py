"""Checked queries: signals, positions and equity, performance and prediction metrics, costs."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..operators import costs, folds, ledger, metrics, prediction, signals
from ..operators.series import rolling
from .catalog import KEY, columns_query, lag, pct, register, roll, rr, show, so_far
from .fixtures import SUPP, line_blocks, supp_bars, table

KEYS = ("symbol", "ts")
Y = math.sqrt(252)

# --- K: signals on a momentum prediction

PRED = [f"r AS (SELECT *, {pct('close')} AS r1 FROM bars)", f"p AS (SELECT *, {roll('avg', 'r1', 5)} AS prediction FROM r)"]


def predicted(spark, sf):
    return signals.momentum_prediction(supp_bars(spark, sf))


def _rule(sell: str, buy: str) -> str:
    return f"CAST(CASE WHEN {sell} THEN -1 WHEN {buy} THEN 1 ELSE 0 END AS INTEGER)"


def signal_query(name, compute, signal, ctes=(), source="p"):
    register(
        name,
        lambda s, d: compute(predicted(s, d)).select(*KEYS, "signal"),
        f"WITH {', '.join([SUPP, *PRED, *ctes])} SELECT symbol, ts, {signal} AS signal FROM {source}",
    )


TH = {"buy": 0.5, "sell": -0.1}
signal_query("k01_threshold", lambda d: signals.threshold(d, **TH), _rule("prediction <= -0.1", "prediction >= 0.5"))
signal_query(
    "k02_confidence",
    lambda d: signals.threshold(
        d.withColumn("probability", F.array(1 / (1 + F.exp(-F.col("prediction"))), 1 - 1 / (1 + F.exp(-F.col("prediction"))))),
        **TH,
        confidence=signals.class_confidence(),
        min_confidence=0.6,
    ),
    f"CASE WHEN greatest(1 / (1 + exp(-prediction)), 1 - 1 / (1 + exp(-prediction))) < 0.6 THEN 0 ELSE {_rule('prediction <= -0.1', 'prediction >= 0.5')} END",
)
_VOL = f"v AS (SELECT *, {roll('stddev_samp', 'r1', 20)} AS v20 FROM p)"
_ADJ = "a AS (SELECT *, 0.3 * (1 + (v20 / avg(v20) OVER (PARTITION BY symbol) - 1) * 2.0) AS lim FROM v)"
signal_query(
    "k03_volatility_adjusted",
    lambda d: signals.volatility_adjusted(d, base=0.3),
    _rule("prediction <= -lim", "prediction >= lim"),
    [_VOL, _ADJ],
    "a",
)
signal_query(
    "k03_volatility_adjusted_past_only",
    lambda d: signals.volatility_adjusted(d, base=0.3, expanding=True),
    _rule("prediction <= -lim", "prediction >= lim"),
    [_VOL, f"a AS (SELECT *, 0.3 * (1 + (v20 / {so_far('avg(v20)')} - 1) * 2.0) AS lim FROM v)"],
    "a",
)
signal_query(
    "k04_trend_following",
    lambda d: signals.trend_following(d, limit=0.2),
    _rule("prediction <= -0.2 AND dist <= -0.02", "prediction >= 0.2 AND dist >= 0.02"),
    [f"m AS (SELECT *, {roll('avg', 'close', 50)} AS ma FROM p)", "a AS (SELECT *, (close - ma) / ma AS dist FROM m)"],
    "a",
)
signal_query(
    "k05_mean_reversion",
    lambda d: signals.mean_reversion(d, limit=0.1, z=1.0),
    _rule("prediction <= -0.1 AND z >= 1.0", "prediction >= 0.1 AND z <= -1.0"),
    [
        f"m AS (SELECT *, {roll('avg', 'close', 20)} AS ma, {roll('stddev_samp', 'close', 20)} AS sd FROM p)",
        "a AS (SELECT *, (close - ma) / nullif(sd, 0) AS z FROM m)",
    ],
    "a",
)
_WEIGHTS = {"threshold": 2.0, "trend_following": 1.0, "mean_reversion": 1.0}


def _consensus(d):
    wide = signals.threshold(d, **TH).withColumnRenamed("signal", "signal_threshold")
    wide = signals.trend_following(wide, limit=0.2).withColumnRenamed("signal", "signal_trend_following")
    wide = signals.mean_reversion(wide, limit=0.1, z=1.0).withColumnRenamed("signal", "signal_mean_reversion")
    long = signals.long_signals(wide, [c for c in wide.columns if c.startswith("signal_")])
    return signals.consensus(long, _WEIGHTS)


_THREE = [
    f"m AS (SELECT *, {roll('avg', 'close', 50)} AS m50, {roll('avg', 'close', 20)} AS m20, {roll('stddev_samp', 'close', 20)} AS sd FROM p)",
    "x AS (SELECT *, (close - m50) / m50 AS dist, (close - m20) / nullif(sd, 0) AS z FROM m)",
    f"t AS (SELECT *, {_rule('prediction <= -0.1', 'prediction >= 0.5')} AS s1, "
    f"{_rule('prediction <= -0.2 AND dist <= -0.02', 'prediction >= 0.2 AND dist >= 0.02')} AS s2, "
    f"{_rule('prediction <= -0.1 AND z >= 1.0', 'prediction >= 0.1 AND z <= -1.0')} AS s3 FROM x)",
]
signal_query(
    "k06_consensus", _consensus, _rule("(2 * s1 + s2 + s3) / 4.0 <= -0.5", "(2 * s1 + s2 + s3) / 4.0 >= 0.5"), _THREE, "t"
)
signal_query(
    "k07_dispatch",
    lambda d: signals.generate(d, "trend_following", limit=0.2),
    _rule("prediction <= -0.2 AND dist <= -0.02", "prediction >= 0.2 AND dist >= 0.02"),
    _THREE,
    "t",
)
_SIG = [*PRED, f"s AS (SELECT *, {_rule('prediction <= -0.1', 'prediction >= 0.5')} AS signal FROM p)"]


def signalled(spark, sf):
    return signals.threshold(predicted(spark, sf), **TH)


register(
    "k08_signal_quality",
    lambda s, d: show(signals.signal_quality(signalled(s, d)), ["symbol", "total", "buys", "sells", "holds"], 6, ["frequency", "buy_sell_ratio"]),
    f"WITH {', '.join([SUPP, *_SIG])} SELECT symbol, count(*) AS total, count(*) FILTER (signal > 0) AS buys, count(*) FILTER (signal < 0) AS sells, "
    "count(*) FILTER (signal = 0) AS holds, round(count(*) FILTER (signal <> 0) / count(*), 6) AS frequency, "
    "round(count(*) FILTER (signal > 0) / nullif(count(*) FILTER (signal < 0), 0), 6) AS buy_sell_ratio FROM s GROUP BY 1",
)
register(
    "k09_signal_runs",
    lambda s, d: show(signals.signal_runs(signalled(s, d)), ["symbol", "runs"], 6, ["mean_duration"]),
    f"WITH {', '.join([SUPP, *_SIG])}, f AS (SELECT *, CASE WHEN signal IS DISTINCT FROM lag(signal) OVER ({KEY}) THEN 1 ELSE 0 END AS st FROM s) "
    "SELECT symbol, CAST(sum(st) AS BIGINT) AS runs, round(count(*) / sum(st), 6) AS mean_duration FROM f GROUP BY 1",
)
register(
    "k10_forward_accuracy",
    lambda s, d: show(
        signals.forward_accuracy(rolling(signalled(s, d), lambda w: {"fr": F.try_divide(w.lead("close", 1), F.col("close")) - 1}, after=1), "fr"),
        ["symbol"],
        6,
        ["buy_accuracy", "sell_accuracy", "buy_mean_return", "sell_mean_return"],
    ),
    f"WITH {', '.join([SUPP, *_SIG])}, f AS (SELECT *, lead(close) OVER ({KEY}) / close - 1 AS fr FROM s), g AS (SELECT * FROM f WHERE fr IS NOT NULL) "
    "SELECT symbol, "
    + rr(
        6,
        buy_accuracy="avg(CASE WHEN fr > 0 THEN 1.0 ELSE 0.0 END) FILTER (signal > 0)",
        sell_accuracy="avg(CASE WHEN fr < 0 THEN 1.0 ELSE 0.0 END) FILTER (signal < 0)",
        buy_mean_return="avg(fr) FILTER (signal > 0)",
        sell_mean_return="avg(fr) FILTER (signal < 0)",
    )
    + " FROM g GROUP BY 1",
)
columns_query("k11_momentum", supp_bars, SUPP, signals.momentum_prediction, {"prediction": "prediction"}, ctes=PRED, source="p")
signal_query("k12_sign", signals.sign_signal, "CAST(coalesce(sign(prediction), 0) AS INTEGER)")
signal_query(
    "k13_class",
    lambda d: d.withColumn("signal", signals.class_at(1 / (1 + F.exp(-F.col("prediction"))))),
    "CASE WHEN 1 / (1 + exp(-prediction)) > 0.5 THEN 1 ELSE 0 END",
)

# --- L: positions, trades, equity

CAPITAL, FR, CO, SL = 10_000.0, 0.95, 0.001, 0.0005
CHAIN = [
    *_SIG,
    f"o AS (SELECT *, CASE WHEN {so_far('last_value(CASE WHEN signal <> 0 THEN signal END IGNORE NULLS)')} > 0 THEN 1 ELSE 0 END AS position FROM s)",
    f"e1 AS (SELECT *, lag(position, 1, 0) OVER ({KEY}) AS prev FROM o)",
    "e2 AS (SELECT *, CASE WHEN position = 1 AND prev = 0 THEN 'buy' WHEN position = 0 AND prev = 1 THEN 'sell' END AS side FROM e1)",
    f"e3 AS (SELECT *, CASE side WHEN 'buy' THEN close * (1 + {SL}) WHEN 'sell' THEN close * (1 - {SL}) END AS fill FROM e2)",
    f"e4 AS (SELECT *, {so_far('''last_value(CASE WHEN side = 'buy' THEN fill END IGNORE NULLS)''')} AS p0, "
    f"{so_far('''count(CASE WHEN side = 'buy' THEN 1 END)''')} AS trip FROM e3)",
    f"e5 AS (SELECT *, {so_far(f'''product(CASE WHEN side = 'sell' THEN 1 - {FR} * (1 + {CO}) + {FR} * (1 - {CO}) * fill / p0 ELSE 1.0 END)''')} AS closed FROM e4)",
    f"e6 AS (SELECT *, {so_far(f'''last_value(CASE WHEN side = 'buy' THEN {CAPITAL} * closed * {FR} / fill END IGNORE NULLS)''')} AS q, "
    f"{CAPITAL} * closed * CASE WHEN position = 1 THEN 1 - {FR} * (1 + {CO}) + {FR} * close / p0 ELSE 1.0 END AS equity FROM e5)",
    f"eq AS (SELECT *, {pct('equity')} AS ret FROM e6)",
]
CHAIN_SQL = ", ".join([SUPP, *CHAIN])


def held(spark, sf):
    return ledger.positions(signalled(spark, sf))


def equity(spark, sf):
    return ledger.equity_curve(held(spark, sf), capital=CAPITAL, fraction=FR, commission=CO, slippage=SL)


register(
    "l01_positions",
    lambda s, d: held(s, d).select(*KEYS, "position"),
    f"WITH {CHAIN_SQL} SELECT symbol, ts, CAST(position AS INTEGER) AS position FROM o",
)
register(
    "l01_positions_exit_on_zero",
    lambda s, d: ledger.positions(signalled(s, d), exit_on_zero=True).select(*KEYS, "position"),
    f"WITH {CHAIN_SQL} SELECT symbol, ts, CAST(CASE WHEN signal > 0 THEN 1 ELSE 0 END AS INTEGER) AS position FROM o",
)
# the state machine in SQL: walk the bars with a recursive CTE
register(
    "l02_positions_with_stops",
    lambda s, d: folds.positions_with_stops(signalled(s, d), 0.2, 0.4).select(*KEYS, "position", "exit_reason"),
    f"WITH RECURSIVE {', '.join([SUPP, *_SIG])}, n AS (SELECT *, row_number() OVER ({KEY}) AS rn FROM s), "
    "st(symbol, rn, ts, entry, reason) AS (SELECT symbol, rn, ts, CASE WHEN signal > 0 THEN close END, NULL::VARCHAR FROM n WHERE rn = 1 UNION ALL "
    "SELECT n.symbol, n.rn, n.ts, "
    "CASE WHEN st.entry IS NULL THEN CASE WHEN n.signal > 0 THEN n.close END "
    "WHEN n.close <= st.entry * (1 - 0.2) OR n.close >= st.entry * (1 + 0.4) OR n.signal < 0 THEN NULL ELSE st.entry END, "
    "CASE WHEN st.entry IS NULL THEN NULL WHEN n.close <= st.entry * (1 - 0.2) THEN 'stop' WHEN n.close >= st.entry * (1 + 0.4) THEN 'take_profit' "
    "WHEN n.signal < 0 THEN 'signal' END FROM st JOIN n ON n.symbol = st.symbol AND n.rn = st.rn + 1) "
    "SELECT symbol, ts, CASE WHEN entry IS NULL THEN 0 ELSE 1 END AS position, reason AS exit_reason FROM st",
)
# equity moves over many magnitudes: compare logarithms
_LOGS = ("log_quantity", "log_price", "log_value", "log_commission")


def _trades(s, d):
    t = ledger.trade_list(equity(s, d))
    return t.withColumns({f"log_{c}": F.ln(c) for c in ("quantity", "price", "value", "commission")})


register(
    "l03_trades",
    lambda s, d: show(_trades(s, d), [*KEYS, "side", "trip"], 6, _LOGS),
    f"WITH {CHAIN_SQL} SELECT symbol, ts, side, trip, "
    + rr(6, log_quantity="ln(q)", log_price="ln(fill)", log_value="ln(q * fill)", log_commission=f"ln(q * fill * {CO})")
    + " FROM eq WHERE side IS NOT NULL",
)
TRIPS = (
    "tr AS (SELECT symbol, trip, max(ts) FILTER (side = 'buy') AS t0, max(ts) FILTER (side = 'sell') AS t1, max(fill) FILTER (side = 'buy') AS f0, "
    "max(fill) FILTER (side = 'sell') AS f1, max(q) FILTER (side = 'sell') AS q FROM eq WHERE side IS NOT NULL GROUP BY 1, 2), "
    f"rt AS (SELECT *, (f1 - f0) * q - q * f1 * {CO} AS pnl, (epoch(t1) - epoch(t0)) / 3600.0 AS hours, (f1 - f0) / f0 AS rp FROM tr WHERE t1 IS NOT NULL AND t0 IS NOT NULL)"
)


def trips(s, d):
    return ledger.round_trips(ledger.trade_list(equity(s, d)))


register(
    "l04_round_trips",
    lambda s, d: show(
        trips(s, d).withColumns({"pnl_share": F.col("pnl") / (F.col("quantity") * F.col("entry_price"))}),
        ["symbol", "trip", "entry_time", "exit_time"],
        6,
        ["pnl_share", "duration_hours", "return_pct"],
    ),
    f"WITH {CHAIN_SQL}, {TRIPS} SELECT symbol, trip, t0 AS entry_time, t1 AS exit_time, {rr(6, pnl_share='pnl / (q * f0)', duration_hours='hours', return_pct='rp')} FROM rt",
)
_RT = ("total_round_trips", "profitable_trades", "losing_trades")
register(
    "l05_round_trip_summary",
    lambda s, d: show(
        ledger.round_trip_summary(trips(s, d).withColumn("pnl", F.col("pnl") / (F.col("quantity") * F.col("entry_price")))),
        ["symbol", *_RT],
        6,
        ["avg_trade_pnl", "avg_trade_return", "avg_trade_duration", "best_trade", "worst_trade", "win_rate"],
    ),
    f"WITH {CHAIN_SQL}, {TRIPS}, z AS (SELECT *, pnl / (q * f0) AS x FROM rt) SELECT symbol, count(*) AS total_round_trips, count(*) FILTER (x > 0) AS profitable_trades, "
    "count(*) FILTER (x < 0) AS losing_trades, "
    + rr(6, avg_trade_pnl="avg(x)", avg_trade_return="avg(rp)", avg_trade_duration="avg(hours)", best_trade="max(x)", worst_trade="min(x)",
         win_rate="avg(CASE WHEN x > 0 THEN 1.0 ELSE 0.0 END)")
    + " FROM z GROUP BY 1",
)
register(
    "l06_equity",
    lambda s, d: show(equity(s, d), [*KEYS, "position", "trip"], 6, ["log_equity", "ret"]),
    f"WITH {CHAIN_SQL} SELECT symbol, ts, CAST(position AS INTEGER) AS position, trip, {rr(6, log_equity='ln(equity)', ret='ret')} FROM eq",
)
register(
    "l07_unfillable",
    lambda s, d: show(ledger.equity_curve(held(s, d), fraction=1.0, commission=0.001), [*KEYS, "position"], 6, ["equity"]),
    f"WITH {CHAIN_SQL} SELECT symbol, ts, 0 AS position, 10000.0::DOUBLE AS equity FROM o",
)
register(
    "l08_slippage",
    lambda s, d: show(
        equity(s, d).filter("side is not null").withColumn("cost", F.col("fill_price") / F.col("close") - 1), [*KEYS, "side"], 8, ["cost"]
    ),
    f"WITH {CHAIN_SQL} SELECT symbol, ts, side, round(fill / close - 1, 8) AS cost FROM eq WHERE side IS NOT NULL",
)
register(
    "l09_period_returns",
    lambda s, d: show(equity(s, d).filter("ret is not null"), KEYS, 6, ["ret"]),
    f"WITH {CHAIN_SQL} SELECT symbol, ts, round(ret, 6) AS ret FROM eq WHERE ret IS NOT NULL",
)


# line items as orders of a supplier's account: returned ones are sells
def account_trades(spark, sf):
    return table(spark, sf, "lineitem").select(
        F.col("l_suppkey").cast("string").alias("symbol"),
        F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey").alias("at"),
        F.when(F.col("l_returnflag") == "R", "sell").otherwise("buy").alias("side"),
        F.col("l_quantity").alias("quantity"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        (F.col("l_tax") * F.col("l_quantity")).alias("commission"),
    )


def _ledger(s, d):
    # an account can hold any share of all trades: cut long ones into blocks
    return ledger.trade_ledger(account_trades(s, d), ts="at", blocks=line_blocks(20_000, "at.l_shipdate", "at.l_orderkey"))


_ACCOUNT = (
    "WITH RECURSIVE t AS (SELECT CAST(l_suppkey AS VARCHAR) AS symbol, CASE WHEN l_returnflag = 'R' THEN 'sell' ELSE 'buy' END AS side, l_quantity AS x, "
    "l_extendedprice / l_quantity AS p, l_tax * l_quantity AS c, l_orderkey AS o, l_linenumber AS l, l_partkey AS k, l_shipdate AS d, "
    "row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey) AS rn FROM lineitem), "
    "g(symbol, rn, q, cost, avg0) AS (SELECT symbol, rn, CASE WHEN side = 'buy' THEN x ELSE 0.0 END, CASE WHEN side = 'buy' THEN x * p ELSE 0.0 END, 0.0::DOUBLE FROM t WHERE rn = 1 "
    "UNION ALL SELECT t.symbol, t.rn, CASE WHEN t.side = 'buy' THEN g.q + t.x ELSE greatest(g.q - t.x, 0) END, "
    "CASE WHEN t.side = 'buy' THEN g.cost + t.x * t.p WHEN g.q - t.x > 0 THEN g.cost * (g.q - t.x) / g.q ELSE 0.0 END, "
    "CASE WHEN g.q > 0 THEN g.cost / g.q ELSE 0.0 END FROM g JOIN t ON t.symbol = g.symbol AND t.rn = g.rn + 1), "
    "m AS (SELECT t.*, g.q, g.cost, g.avg0 FROM t JOIN g USING (symbol, rn)), "
    "f AS (SELECT *, 10000 + sum(CASE WHEN side = 'buy' THEN -x * p - c ELSE x * p - c END) OVER (PARTITION BY symbol ORDER BY rn ROWS UNBOUNDED PRECEDING) AS cash FROM m)"
)
register(
    "l10_trade_ledger",
    lambda s, d: show(
        _ledger(s, d).select("*", F.col("at.l_orderkey").alias("o"), F.col("at.l_linenumber").alias("l"), F.col("at.l_partkey").alias("k")),
        ["symbol", "o", "l", "k", "side"],
        5,
        ["holding", "avg_price", "realised_pnl", "cash"],
    ),
    _ACCOUNT + " SELECT symbol, o, l, k, side, "
    + rr(5, holding="q", avg_price="cost / nullif(q, 0)", realised_pnl="CASE WHEN side = 'sell' THEN (p - avg0) * x - c ELSE 0 END", cash="cash")
    + " FROM f",
)
register(
    "l11_mark_to_market",
    lambda s, d: show(
        ledger.mark_to_market(
            _ledger(s, d), account_trades(s, d).withColumn("close", F.col("price")), ts="at"
        ),
        ["symbol"],
        5,
        ["quantity", "avg_price", "current_price", "market_value", "unrealised_pnl", "total_value"],
        ["current_price"],
    ),
    _ACCOUNT + ", z AS (SELECT symbol, arg_max(q, rn) AS q, arg_max(cost / nullif(q, 0), rn) AS a, arg_max(p, rn) AS p, arg_max(cash, rn) AS cash FROM f GROUP BY 1) SELECT symbol, "
    + rr(5, ["current_price"], quantity="q", avg_price="a", current_price="p", market_value="q * p", unrealised_pnl="CASE WHEN q > 0 THEN (p - a) * q ELSE 0 END", total_value="cash + q * p")
    + " FROM z",
)
register(
    "l12_strategy_comparison",
    lambda s, d: show(_comparison(s, d), ["symbol", "strategy"], 5, ["total_return", "mean_return", "volatility", "sharpe_ratio"]),
    f"WITH {CHAIN_SQL}, u AS (SELECT symbol, 'momentum' AS strategy, ts, CASE WHEN prev = 1 THEN r1 ELSE 0 END AS x FROM eq WHERE r1 IS NOT NULL "
    "UNION ALL SELECT symbol, 'buy_hold', ts, r1 FROM eq WHERE r1 IS NOT NULL) SELECT symbol, strategy, "
    + rr(5, total_return="ln(product(1 + x))", mean_return="avg(x)", volatility="stddev_samp(x)",
         sharpe_ratio=f"coalesce((avg(x) - 0.02 / 252) / nullif(stddev_samp(x), 0) * {Y!r}, 0)")
    + " FROM u GROUP BY 1, 2",
)


def _comparison(s, d):
    e = rolling(held(s, d), lambda w: {"r": w.change("close"), "was": w.lag("position", 1, 0)}, before=1).filter("r is not null")
    by = ("symbol", "strategy")
    rows = e.select("symbol", F.lit("momentum").alias("strategy"), F.when(F.col("was") == 1, F.col("r")).otherwise(0.0).alias("ret"))
    bench = e.select("symbol", F.lit("buy_hold").alias("strategy"), F.col("r").alias("ret"))

    def table_of(x):
        m = metrics.return_metrics(x, by=by).select(*by, F.ln("final_value").alias("total_return"), "mean_return")
        return m.join(metrics.risk_metrics(x, by=by).select(*by, "volatility"), list(by)).join(metrics.ratio_metrics(x, by=by), list(by))

    return ledger.compare_strategies(table_of(rows), table_of(bench))


register(
    "l13_buy_and_hold",
    lambda s, d: show(ledger.buy_and_hold(supp_bars(s, d)), ["symbol", "bars"], 6, ["total_return", "sharpe_ratio", "win_rate"]),
    f"WITH {SUPP}, r AS (SELECT *, {pct('close')} AS x FROM bars) SELECT symbol, count(*) AS bars, "
    + rr(6, total_return="arg_max(close, ts) / arg_min(close, ts) - 1", sharpe_ratio=f"(avg(x) - 0.02 / 252) / stddev_samp(x) * {Y!r}",
         win_rate="avg(CASE WHEN x > 0 THEN 1.0 WHEN x IS NOT NULL THEN 0.0 END)")
    + " FROM r GROUP BY 1",
)


def _orders(s, d):
    b = supp_bars(s, d)
    kind = F.element_at(F.array(F.lit("market"), F.lit("limit"), F.lit("stop")), (F.dayofmonth("ts") % 3 + 1).cast("int"))
    return b.select(
        *KEYS,
        F.when(F.month("ts") % 2 == 0, "buy").otherwise("sell").alias("side"),
        kind.alias("type"),
        (F.col("open") * 1.02).alias("limit_price"),
        (F.col("open") * 0.98).alias("stop_price"),
    )


register(
    "l14_order_fills",
    lambda s, d: show(ledger.fill_orders(_orders(s, d), supp_bars(s, d)), [*KEYS, "side", "type"], 6, ["fill_price"], ["fill_price"]),
    f"WITH {SUPP}, o AS (SELECT *, CASE WHEN month(ts) % 2 = 0 THEN 'buy' ELSE 'sell' END AS side, "
    "CASE day(ts) % 3 WHEN 0 THEN 'market' WHEN 1 THEN 'limit' ELSE 'stop' END AS type, open * 1.02 AS li, open * 0.98 AS sp FROM bars) "
    "SELECT symbol, ts, side, type, "
    + rr(6, ["fill_price"], fill_price="CASE WHEN type = 'market' THEN close WHEN type = 'limit' AND ((side = 'buy' AND close <= li) OR (side = 'sell' AND close >= li)) THEN li "
         "WHEN type = 'stop' AND ((side = 'buy' AND close >= sp) OR (side = 'sell' AND close <= sp)) THEN close END")
    + " FROM o",
)



def _resting(s, d):
    """An order a day, far from the price: limits and stops that wait, and some that never fill."""
    b = supp_bars(s, d)
    far, near = F.col("open") * 2.5, F.col("open") * 0.4
    buy = F.col("side") == "buy"
    o = _orders(s, d).select(*KEYS, "side", "type").join(b.select(*KEYS, "open"), list(KEYS))
    return o.select(*KEYS, "side", "type", F.when(buy, near).otherwise(far).alias("limit_price"), F.when(buy, far).otherwise(near).alias("stop_price"))


register(
    "l14_resting_orders",
    lambda s, d: show(ledger.fill_resting(_resting(s, d), supp_bars(s, d)), [*KEYS, "side", "type", "fill_ts"], 6, ["fill_price"], ["fill_price"]),
    f"WITH {SUPP}, o AS (SELECT *, CASE WHEN month(ts) % 2 = 0 THEN 'buy' ELSE 'sell' END AS side, "
    "CASE day(ts) % 3 WHEN 0 THEN 'market' WHEN 1 THEN 'limit' ELSE 'stop' END AS type FROM bars), "
    "q AS (SELECT symbol, ts, side, type, CASE side WHEN 'buy' THEN open * 0.4 ELSE open * 2.5 END AS li, CASE side WHEN 'buy' THEN open * 2.5 ELSE open * 0.4 END AS sp FROM o), "
    "m AS (SELECT q.symbol, q.ts, min(b.ts) AS hit FROM q JOIN bars b ON b.symbol = q.symbol AND b.ts >= q.ts AND "
    "(type = 'market' OR (type = 'limit' AND CASE side WHEN 'buy' THEN close <= li ELSE close >= li END) OR (type = 'stop' AND CASE side WHEN 'buy' THEN close >= sp ELSE close <= sp END)) GROUP BY 1, 2) "
    "SELECT q.symbol, q.ts, side, type, hit AS fill_ts, CAST(CASE type WHEN 'limit' THEN CASE WHEN hit IS NOT NULL THEN li END ELSE close END AS DOUBLE) AS fill_price "
    "FROM q LEFT JOIN m USING (symbol, ts) LEFT JOIN bars b ON b.symbol = q.symbol AND b.ts = hit",
)

# --- M: metrics of bar returns per supplier

RETS = f"{SUPP}, r AS (SELECT *, {pct('close')} AS x FROM bars), k AS (SELECT * FROM r WHERE x IS NOT NULL)"


def returns(spark, sf):
    return rolling(supp_bars(spark, sf), lambda w: {"ret": w.change("close")}, before=1)


def known(spark, sf):
    return returns(spark, sf).filter("ret is not null")


def metric_query(name, compute, columns, *, digits=6, ctes=(), source="k", ints=(), group="GROUP BY symbol"):
    register(
        name,
        lambda s, d: show(compute(s, d), ["symbol", *ints], digits, [c for c in columns if c not in ints]),
        f"WITH {', '.join([RETS, *ctes])} SELECT symbol, "
        + ", ".join([f"CAST({columns[c]} AS BIGINT) AS {c}" for c in ints] + [rr(digits, **{c: e for c, e in columns.items() if c not in ints})])
        + f" FROM {source} {group}",
    )


metric_query("m01_total_return", lambda s, d: metrics.return_metrics(known(s, d)), {"total_return": "product(1 + x) - 1", "final_value": "product(1 + x)", "log_return": "ln(product(1 + x))"})
metric_query("m02_annualized", lambda s, d: metrics.return_metrics(known(s, d), ppy=4), {"annualized_return": "pow(1 + avg(x), 4) - 1"}, digits=4)
metric_query(
    "m03_means",
    lambda s, d: metrics.return_metrics(known(s, d)),
    {"mean_return": "avg(x)", "median_return": "median(x)", "arithmetic_mean": "avg(x)", "geometric_mean": "exp(avg(ln(1 + x))) - 1"},
)
metric_query("m04_volatility", lambda s, d: metrics.risk_metrics(known(s, d)), {"volatility": "stddev_samp(x)", "annualized_volatility": f"stddev_samp(x) * {Y!r}"})
metric_query(
    "m05_downside",
    lambda s, d: metrics.risk_metrics(known(s, d)),
    {"downside_deviation": f"stddev_samp(x) FILTER (x < 0) * {Y!r}", "downside_variance": "var_samp(x) FILTER (x < 0) * 252"},
)
_Q = "q AS (SELECT symbol, quantile_cont(x, 0.05) AS v95, quantile_cont(x, 0.01) AS v99, avg(x) AS mu FROM k GROUP BY 1), j AS (SELECT k.*, v95, v99, mu FROM k JOIN q USING (symbol))"
metric_query("m06_var", lambda s, d: metrics.risk_metrics(known(s, d)), {"var_95": "quantile_cont(x, 0.05)", "var_99": "quantile_cont(x, 0.01)"})
metric_query(
    "m07_cvar",
    lambda s, d: metrics.risk_metrics(known(s, d)),
    {"cvar_95": "avg(x) FILTER (x <= v95)", "cvar_99": "avg(x) FILTER (x <= v99)"},
    ctes=[_Q],
    source="j",
)
metric_query("m08_moments", lambda s, d: metrics.risk_metrics(known(s, d)), {"skewness": "skewness(x)", "kurtosis": "kurtosis(x)"}, digits=5)
metric_query(
    "m09_semi_deviation",
    lambda s, d: metrics.risk_metrics(known(s, d)),
    {"semi_deviation": f"sqrt(avg(pow(x - mu, 2)) FILTER (x < mu)) * {Y!r}"},
    ctes=[_Q],
    source="j",
)
metric_query("m10_sharpe", lambda s, d: metrics.ratio_metrics(known(s, d)), {"sharpe_ratio": f"(avg(x) - 0.02 / 252) / stddev_samp(x) * {Y!r}"})
metric_query(
    "m11_sortino",
    lambda s, d: metrics.ratio_metrics(known(s, d)),
    {"sortino_ratio": f"(avg(x) - 0.02 / 252) / nullif(stddev_samp(x) FILTER (x < 0.02 / 252), 0) * {Y!r}"},
)
metric_query(
    "m12_omega",
    lambda s, d: metrics.ratio_metrics(known(s, d)),
    {"omega_ratio": "sum(greatest(x - 0.02 / 252, 0)) / nullif(sum(greatest(0.02 / 252 - x, 0)), 0)"},
    digits=5,
)
DD = [
    f"p1 AS (SELECT *, {so_far('max(close)')} AS peak FROM bars)",
    "p2 AS (SELECT *, (close - peak) / peak AS dd FROM p1)",
    f"p3 AS (SELECT *, CASE WHEN (dd < 0) IS DISTINCT FROM (lag(dd) OVER ({KEY}) < 0) THEN 1 ELSE 0 END AS st FROM p2)",
    f"p4 AS (SELECT *, {so_far('sum(st)')} AS isl FROM p3)",
    "p5 AS (SELECT symbol, isl, count(*) AS len, bool_or(dd < 0) AS under FROM p4 GROUP BY 1, 2)",
    "dl AS (SELECT symbol, coalesce(max(len) FILTER (under), 0) AS mx, coalesce(avg(len) FILTER (under), 0) AS av, count(*) FILTER (under) AS np FROM p5 GROUP BY 1)",
    "dm AS (SELECT symbol, min(dd) AS maxdd, avg(dd) FILTER (dd < 0) AS avgdd, arg_max(close, ts) / arg_min(close, ts) AS g, count(*) AS n FROM p2 GROUP BY 1)",
    "dd AS (SELECT * FROM dm JOIN dl USING (symbol))",
]


def drawdowns(s, d):
    return metrics.drawdown_metrics(supp_bars(s, d), value="close")


columns_query(
    "m13_drawdown_series",
    supp_bars,
    SUPP,
    lambda b: metrics.drawdown_series(b, value="close"),
    {"peak": "peak", "drawdown": "dd"},
    ctes=DD[:2],
    source="p2",
    raw=["peak"],
)
metric_query("m13_drawdown", drawdowns, {"max_drawdown": "maxdd", "avg_drawdown": "avgdd"}, ctes=DD, source="dd", group="")
metric_query(
    "m14_drawdown_duration",
    drawdowns,
    {"max_drawdown_duration": "mx", "avg_drawdown_duration": "av", "drawdown_periods": "np"},
    ctes=DD,
    source="dd",
    group="",
    ints=["max_drawdown_duration", "drawdown_periods"],
)
metric_query("m15_recovery", drawdowns, {"recovery_factor": "(g - 1) / nullif(abs(maxdd), 0)"}, ctes=DD, source="dd", group="")
metric_query("m16_calmar", drawdowns, {"calmar_ratio": "(pow(g, 252.0 / n) - 1) / nullif(abs(maxdd), 0)"}, ctes=DD, source="dd", group="")

# benchmark: mean return of all suppliers on the day
_BENCH = "b AS (SELECT k.ts AS ts, avg(x) AS y FROM k GROUP BY 1), j AS (SELECT k.*, y FROM k JOIN b USING (ts))"


def _with_benchmark(s, d):
    k = known(s, d)
    return metrics.benchmark_metrics(k, k.groupBy("ts").agg(F.avg("ret").alias("bench")))


_BETA = "(covar_samp(x, y) / nullif(var_samp(y), 0))"
_BM = dict(ctes=[_BENCH], source="j", digits=5)
metric_query(
    "b07_benchmark_align",
    lambda s, d: _aligned(s, d),
    {"days": "count(*)", "mean_active": "avg(x - y)"},
    ints=["days"],
    ctes=[_BENCH],
    source="j",
)


def _aligned(s, d):
    k = known(s, d)
    j = k.join(k.groupBy("ts").agg(F.avg("ret").alias("bench")), ["ts"])
    return j.groupBy("symbol").agg(F.count(F.lit(1)).alias("days"), F.avg(F.col("ret") - F.col("bench")).alias("mean_active"))


metric_query(
    "m17_tracking",
    _with_benchmark,
    {"tracking_error": f"stddev_samp(x - y) * {Y!r}", "information_ratio": f"avg(x - y) / nullif(stddev_samp(x - y), 0) * {Y!r}"},
    **_BM,
)
metric_query("m18_beta_alpha", _with_benchmark, {"beta": _BETA, "alpha": f"((avg(x) - 0.02 / 252) - {_BETA} * (avg(y) - 0.02 / 252)) * 252"}, **_BM)
metric_query("m19_treynor", _with_benchmark, {"treynor_ratio": f"(avg(x) - 0.02 / 252) * 252 / {_BETA}"}, **_BM)
metric_query(
    "m20_capture",
    _with_benchmark,
    {
        "up_capture_ratio": "avg(x) FILTER (y > 0) / avg(y) FILTER (y > 0)",
        "down_capture_ratio": "avg(x) FILTER (y < 0) / avg(y) FILTER (y < 0)",
    },
    **_BM,
)
metric_query("m24_correlation", _with_benchmark, {"correlation": "corr(x, y)"}, **_BM)
_CNT = ("total_trades", "winning_trades", "losing_trades", "zero_trades")
metric_query(
    "m21_win_counts",
    lambda s, d: metrics.trading_metrics(returns(s, d)),
    {
        "total_trades": "count(*)",
        "winning_trades": "count(*) FILTER (x > 0)",
        "losing_trades": "count(*) FILTER (x < 0)",
        "zero_trades": "count(*) FILTER (x = 0)",
        "win_rate": "count(*) FILTER (x > 0) / count(*)",
        "loss_rate": "count(*) FILTER (x < 0) / count(*)",
    },
    ints=_CNT,
)
metric_query(
    "m22_win_sizes",
    lambda s, d: metrics.trading_metrics(returns(s, d)),
    {
        "avg_win": "avg(x) FILTER (x > 0)",
        "avg_loss": "avg(x) FILTER (x < 0)",
        "profit_factor": "sum(x) FILTER (x > 0) / abs(sum(x) FILTER (x < 0))",
        "expectancy": "sum(x) / count(*)",
        "largest_win": "max(x)",
        "largest_loss": "min(x)",
    },
)
_STREAK = [
    f"s1 AS (SELECT *, CASE WHEN sign(x) IS DISTINCT FROM lag(sign(x)) OVER ({KEY}) THEN 1 ELSE 0 END AS st FROM k)",
    f"s2 AS (SELECT *, {so_far('sum(st)')} AS isl FROM s1)",
    "s3 AS (SELECT symbol, isl, min(sign(x)) AS sg, count(*) AS len FROM s2 GROUP BY 1, 2)",
]
metric_query(
    "m23_streaks",
    lambda s, d: metrics.streak_metrics(returns(s, d)),
    {
        "max_consecutive_wins": "coalesce(max(len) FILTER (sg = 1), 0)",
        "max_consecutive_losses": "coalesce(max(len) FILTER (sg = -1), 0)",
        "avg_consecutive_wins": "coalesce(avg(len) FILTER (sg = 1), 0)",
        "avg_consecutive_losses": "coalesce(avg(len) FILTER (sg = -1), 0)",
    },
    ctes=_STREAK,
    source="s3",
    ints=["max_consecutive_wins", "max_consecutive_losses"],
)
metric_query(
    "m25_value_summary",
    lambda s, d: metrics.value_summary(supp_bars(s, d), value="close"),
    {
        "total_return_pct": "(g - 1) * 100",
        "annualized_return_pct": "(pow(g, 252.0 / n) - 1) * 100",
        "volatility_pct": f"sd * {Y!r} * 100",
        "max_drawdown_pct": "maxdd * 100",
        "current_drawdown_pct": "cur * 100",
        "sharpe_ratio": f"(mu - 0.02 / 252) / sd * {Y!r}",
    },
    ctes=[
        *DD,
        "c AS (SELECT symbol, arg_max(dd, ts) AS cur FROM p2 GROUP BY 1)",
        "h AS (SELECT symbol, avg(x) AS mu, stddev_samp(x) AS sd FROM k GROUP BY 1)",
        "z AS (SELECT * FROM dd JOIN c USING (symbol) JOIN h USING (symbol))",
    ],
    source="z",
    group="",
    digits=4,
)

# --- N: prediction quality. Outcome: next close; prediction: today's close

_NX = f"n AS (SELECT *, lead(close) OVER ({KEY}) AS y FROM bars), k AS (SELECT *, close AS p FROM n WHERE y IS NOT NULL)"


def forecasts(s, d):
    return rolling(supp_bars(s, d), lambda w: {"y": w.lead("close")}, after=1).filter("y is not null").withColumn("prediction", F.col("close"))


register(
    "n01_regression",
    lambda s, d: show(prediction.regression_metrics(forecasts(s, d), by=("symbol",)), ["symbol"], 4, ["rmse", "mae", "r2_score", "mean_error", "std_error"]),
    f"WITH {SUPP}, {_NX} SELECT symbol, "
    + rr(4, rmse="sqrt(avg(pow(p - y, 2)))", mae="avg(abs(p - y))", r2_score="1 - sum(pow(p - y, 2)) / (var_pop(y) * count(*))", mean_error="avg(p - y)", std_error="stddev_pop(p - y)")
    + " FROM k GROUP BY 1",
)
register(
    "n02_mape",
    lambda s, d: show(prediction.regression_metrics(forecasts(s, d), by=("symbol",)), ["symbol"], 5, ["mape"]),
    f"WITH {SUPP}, {_NX} SELECT symbol, round(avg(abs((p - y) / nullif(y, 0))) * 100, 5) AS mape FROM k GROUP BY 1",
)
register(
    "n03_direction_accuracy",
    lambda s, d: show(prediction.direction_accuracy(forecasts(s, d)), ["symbol"], 6, ["direction_accuracy"]),
    f"WITH {SUPP}, {_NX}, f AS (SELECT symbol, sign(y - {lag('y')}) AS a, sign(p - {lag('p')}) AS b FROM k) "
    "SELECT symbol, round(avg(CASE WHEN a = b THEN 1.0 ELSE 0.0 END) FILTER (a IS NOT NULL AND b IS NOT NULL), 6) AS direction_accuracy FROM f GROUP BY 1",
)
# labelled documents: quality 0/1 against a length rule; score = squashed length
_LAB = "x AS (SELECT l.quality AS y, CASE WHEN d.n_chars > 1500 THEN 1 ELSE 0 END AS prediction, d.n_chars / (d.n_chars + 1500.0) AS score, d.lang FROM labels l JOIN documents d USING (doc_id))"


def labelled(s, d):
    j = table(s, d, "labels").join(table(s, d, "documents").select("doc_id", "lang", "n_chars"), ["doc_id"])
    n = F.col("n_chars")
    return j.select(F.col("quality").alias("y"), F.when(n > 1500, 1).otherwise(0).alias("prediction"), (n / (n + 1500.0)).alias("score"), "lang")


_CM = "c AS (SELECT count(*) AS n, count(*) FILTER (y = prediction) AS hit, count(*) FILTER (y = 1 AND prediction = 1) AS tp, count(*) FILTER (prediction = 1) AS pp, count(*) FILTER (y = 1) AS ap FROM x)"
register(
    "n04_classification",
    lambda s, d: show(prediction.classification_metrics(labelled(s, d)), [], 6, ["accuracy", "precision", "recall", "f1_score"]),
    f"WITH {_LAB}, {_CM} SELECT "
    + rr(6, accuracy="hit / n", precision="coalesce(tp / nullif(pp, 0), 0)", recall="coalesce(tp / nullif(ap, 0), 0)", f1_score="coalesce(2.0 * tp / nullif(pp + ap, 0), 0)")
    + " FROM c",
)
# three classes: sign of the day's move against the sign of the day before
_CLS = f"u AS (SELECT CAST(sign(close - open) AS INTEGER) AS y, CAST(sign({lag('close')} - {lag('open')}) AS INTEGER) AS p FROM bars), v AS (SELECT * FROM u WHERE p IS NOT NULL)"


def three_classes(s, d):
    b = rolling(supp_bars(s, d), lambda w: {"prediction": F.signum(w.lag("close") - w.lag("open")).cast("int")}, before=1)
    return b.filter("prediction is not null").withColumn("y", F.signum(F.col("close") - F.col("open")).cast("int"))


register(
    "n04_classification_weighted",
    lambda s, d: show(prediction.classification_metrics(three_classes(s, d)), [], 6, ["accuracy", "precision", "recall", "f1_score"]),
    f"WITH {SUPP}, {_CLS}, g AS (SELECT k, count(*) FILTER (y = k AND p = k) AS tp, count(*) FILTER (p = k) AS pp, count(*) FILTER (y = k) AS ap "
    "FROM v, (SELECT unnest([-1, 0, 1]) AS k) GROUP BY 1) SELECT "
    + rr(6, accuracy="sum(tp) / sum(ap)", precision="sum(coalesce(tp / nullif(pp, 0), 0) * ap) / sum(ap)", recall="sum(coalesce(tp / nullif(ap, 0), 0) * ap) / sum(ap)",
         f1_score="sum(coalesce(2.0 * tp / nullif(pp + ap, 0), 0) * ap) / sum(ap)")
    + " FROM g",
)
register(
    "n05_confusion",
    lambda s, d: prediction.confusion(three_classes(s, d)),
    f"WITH {SUPP}, {_CLS} SELECT y, p AS prediction, count(*) AS n FROM v GROUP BY 1, 2",
)
register(
    "n06_auc",
    lambda s, d: show(prediction.roc_auc(labelled(s, d)), [], 6, ["auc"]),
    f"WITH {_LAB}, r AS (SELECT *, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS rk FROM x) "
    "SELECT round((sum(rk) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0) / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0)), 6) AS auc FROM r",
)


def _ovr(s, d):
    b = three_classes(s, d).select("y", *[(F.col("prediction") == k).cast("double").alias(f"s{i}") for i, k in enumerate((-1, 0, 1))])
    return prediction.roc_auc_ovr(b, "y", {-1: "s0", 0: "s1", 1: "s2"})


register(
    "n06_auc_one_vs_rest",
    lambda s, d: show(_ovr(s, d), [], 6, ["auc"]),
    f"WITH {SUPP}, {_CLS}, e AS (SELECT k, CASE WHEN y = k THEN 1 ELSE 0 END AS y, CASE WHEN p = k THEN 1 ELSE 0 END AS s FROM v, (SELECT unnest([-1, 0, 1]) AS k)), "
    "r AS (SELECT k, y, rank() OVER (PARTITION BY k ORDER BY s) + (count(*) OVER (PARTITION BY k, s) - 1) / 2.0 AS rk FROM e), "
    "a AS (SELECT k, count(*) FILTER (y = 1) AS n1, (sum(rk) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0) / "
    "(CAST(count(*) FILTER (y = 1) AS DOUBLE) * count(*) FILTER (y = 0)) AS auc FROM r GROUP BY 1) SELECT round(sum(auc * n1) / sum(n1), 6) AS auc FROM a",
)
register(
    "n07_log_loss",
    lambda s, d: show(prediction.log_loss(labelled(s, d), by=("lang",)), ["lang"], 6, ["log_loss"]),
    f"WITH {_LAB} SELECT lang, round(-avg(CASE WHEN y = 1 THEN ln(score) ELSE ln(1 - score) END), 6) AS log_loss FROM x GROUP BY 1",
)
register(
    "n08_model_scores",
    lambda s, d: show(prediction.model_scores(_model_rows(s, d), kind="classification"), ["model"], 6, ["accuracy"]),
    f"WITH {SUPP}, m AS (SELECT CAST(sign(close - open) AS INTEGER) AS y, CAST(sign({lag('close')} - {lag('open')}) AS INTEGER) AS p1, 1 AS p2 FROM bars), "
    "k AS (SELECT * FROM m WHERE p1 IS NOT NULL) SELECT 'last' AS model, round(avg(CASE WHEN y = p1 THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM k "
    "UNION ALL SELECT 'up', round(avg(CASE WHEN y = p2 THEN 1.0 ELSE 0.0 END), 6) FROM k",
)


def _model_rows(s, d):
    b = three_classes(s, d).select("y", F.col("prediction").alias("last"), F.lit(1).alias("up"))
    return b.unpivot(["y"], ["last", "up"], "model", "prediction")


# --- O: costs. Three rule-based models with 0/1 predictions per bar

_MODELS = {"trend": "close > open", "calm": "high / low < 3", "busy": "volume > 40"}
_NEXT = f"n AS (SELECT *, lead(close) OVER ({KEY}) / close - 1 AS ret FROM bars), k AS (SELECT * FROM n WHERE ret IS NOT NULL)"
_LONG = (
    f"{SUPP}, {_NEXT}, l AS ("
    + " UNION ALL ".join(f"SELECT symbol, ts, ret, '{m}' AS model, CASE WHEN {e} THEN 1 ELSE 0 END AS signal FROM k" for m, e in _MODELS.items())
    + ")"
)
_MK = "PARTITION BY model, symbol ORDER BY ts"
_PAID = (
    f"c AS (SELECT *, lag(signal) OVER ({_MK}) AS pv, lead(signal) OVER ({_MK}) AS nx FROM l), "
    "d AS (SELECT *, CASE WHEN signal = 1 AND (coalesce(pv = 0, false) OR coalesce(nx = 0, false)) THEN 1 ELSE 0 END AS paid, abs(signal - coalesce(pv, 0)) AS turn FROM c)"
)


def wide_predictions(s, d):
    b = rolling(supp_bars(s, d), lambda w: {"ret": F.try_divide(w.lead("close"), F.col("close")) - 1}, after=1).filter("ret is not null")
    return b.select("*", *[F.expr(e).cast("int").alias(f"pred_{m}") for m, e in _MODELS.items()])


def long_predictions(s, d):
    return costs.unpivot_predictions(wide_predictions(s, d))


def paid(s, d):
    return costs.paid_bars(long_predictions(s, d))


register(
    "o01_cost_adjusted",
    lambda s, d: show(
        paid(s, d).withColumn("net", F.when(F.col("held"), F.col("ret") - 0.002 * F.col("n_paid")).otherwise(0.0)), ["model", *KEYS], 6, ["net"]
    ),
    f"WITH {_LONG}, {_PAID} SELECT model, symbol, ts, round(CASE WHEN signal = 1 THEN ret - 0.002 * paid ELSE 0 END, 6) AS net FROM d",
)
register(
    "o01_cost_both_sides",
    lambda s, d: costs.paid_bars(long_predictions(s, d), rule="both_sides").groupBy("model").agg(F.sum("n_paid").alias("n")),
    f"WITH {_LONG}, {_PAID} SELECT model, CAST(sum(CASE WHEN signal = 1 THEN CASE WHEN coalesce(pv, 0) = 0 THEN 1 ELSE 0 END + CASE WHEN coalesce(nx, 0) = 0 THEN 1 ELSE 0 END ELSE 0 END) AS BIGINT) AS n FROM d GROUP BY 1",
)
register(
    "o02_turnover",
    lambda s, d: paid(s, d).groupBy("model", "symbol").agg(F.sum("turn").alias("turnover")),
    f"WITH {_LONG}, {_PAID} SELECT model, symbol, CAST(sum(turn) AS BIGINT) AS turnover FROM d GROUP BY 1, 2",
)
_GRID = (
    "g AS (SELECT d.*, cost, CASE WHEN signal = 1 THEN ret - paid * cost ELSE 0 END AS x FROM d, (SELECT unnest([0.0005, 0.001, 0.002, 0.005, 0.01])::DOUBLE AS cost)), "
    "h AS (SELECT model, cost, sum(x) AS tr, sum(paid) * max(cost) AS tc, CAST(sum(turn) AS BIGINT) AS nt, "
    f"coalesce({Y!r} * avg(x) / nullif(stddev_pop(x), 0), 0) AS sh, count(*) FILTER (x > 0) / nullif(count(*) FILTER (x <> 0), 0) AS wr, sum(x) > 0 AS pf FROM g GROUP BY 1, 2)"
)
register(
    "o03_cost_run",
    lambda s, d: show(
        costs.cost_grid(paid(s, d), [0.002]), ["model", "num_trades", "profitable"], 5, ["total_return", "transaction_costs", "sharpe_ratio", "win_rate", "return_per_trade"]
    ),
    f"WITH {_LONG}, {_PAID}, {_GRID} SELECT model, nt AS num_trades, pf AS profitable, "
    + rr(5, total_return="tr", transaction_costs="tc", sharpe_ratio="sh", win_rate="wr", return_per_trade="tr / nullif(nt, 0)")
    + " FROM h WHERE cost = 0.002",
)
register(
    "o04_cost_grid",
    lambda s, d: show(costs.cost_grid(paid(s, d)), ["model", "cost", "num_trades"], 5, ["total_return", "transaction_costs", "sharpe_ratio", "win_rate"]),
    f"WITH {_LONG}, {_PAID}, {_GRID} SELECT model, cost, nt AS num_trades, {rr(5, total_return='tr', transaction_costs='tc', sharpe_ratio='sh', win_rate='wr')} FROM h",
)
register(
    "o05_breakeven",
    lambda s, d: show(costs.breakeven(paid(s, d), by=("model", "symbol"), max_cost=0.5), ["model", "symbol"], 6, ["breakeven_cost"]),
    f"WITH {_LONG}, {_PAID} SELECT model, symbol, round(greatest(0, least(0.5, coalesce(sum(CASE WHEN signal = 1 THEN ret ELSE 0 END) / nullif(sum(paid), 0), "
    "CASE WHEN sum(CASE WHEN signal = 1 THEN ret ELSE 0 END) > 0 THEN 0.5 ELSE 0 END))), 6) AS breakeven_cost FROM d GROUP BY 1, 2",
)
register(
    "o06_cost_summary",
    lambda s, d: show(
        costs.cost_summary(costs.cost_grid(paid(s, d))),
        ["model", "num_trades", "profitable_at_low", "profitable_at_high"],
        5,
        ["low_cost_return", "high_cost_return", "degradation", "degradation_pct"],
    ),
    f"WITH {_LONG}, {_PAID}, {_GRID}, z AS (SELECT model, arg_min(tr, cost) AS lo, arg_max(tr, cost) AS hi, arg_min(pf, cost) AS pl, arg_max(pf, cost) AS ph, arg_min(nt, cost) AS nt FROM h GROUP BY 1) "
    "SELECT model, nt AS num_trades, pl AS profitable_at_low, ph AS profitable_at_high, "
    + rr(5, low_cost_return="lo", high_cost_return="hi", degradation="lo - hi", degradation_pct="coalesce((lo - hi) / nullif(abs(lo), 0) * 100, 0)")
    + " FROM z",
)
register(
    "o07_unpivot",
    lambda s, d: long_predictions(s, d).select("model", *KEYS, "signal"),
    f"WITH {_LONG} SELECT model, symbol, ts, signal FROM l",
)
_START, _END = "1996-01-01", "2000-12-31"
register(
    "o08_buy_hold",
    lambda s, d: show(costs.buy_hold_return(supp_bars(s, d), _START, _END), ["symbol"], 6, ["buy_hold_return"]),
    f"WITH {SUPP} SELECT symbol, round(CASE WHEN count(*) < 2 THEN 0 ELSE arg_max(close, ts) / arg_min(close, ts) - 1 - 0.004 END, 6) AS buy_hold_return "
    f"FROM bars WHERE ts BETWEEN TIMESTAMP '{_START}' AND TIMESTAMP '{_END}' GROUP BY 1",
)


def evaluated(s, d):
    return costs.evaluate_models(long_predictions(s, d), costs.buy_hold_return(supp_bars(s, d), _START, _END), start=_START, end=_END)


_EVAL = (
    f"{_LONG.replace('WHERE ret IS NOT NULL', f'''WHERE ret IS NOT NULL AND ts BETWEEN TIMESTAMP '{_START}' AND TIMESTAMP '{_END}' ''')}, {_PAID}, "
    "x AS (SELECT *, CASE WHEN signal = 1 THEN ret - 0.002 * paid ELSE 0 END AS x FROM d), "
    f"v AS (SELECT model, symbol, sum(x) AS tr, CAST(sum(turn) AS BIGINT) AS nt, coalesce({Y!r} * avg(x) / nullif(stddev_pop(x), 0), 0) AS sh, "
    "coalesce(count(*) FILTER (x > 0) / nullif(count(*) FILTER (x <> 0), 0), 0) AS wr, coalesce(avg(x) FILTER (x <> 0), 0) AS ar, count(*) AS n FROM x GROUP BY 1, 2), "
    "bh AS (SELECT symbol, CASE WHEN count(*) < 2 THEN 0 ELSE arg_max(close, ts) / arg_min(close, ts) - 1 - 0.004 END AS b "
    f"FROM bars WHERE ts BETWEEN TIMESTAMP '{_START}' AND TIMESTAMP '{_END}' GROUP BY 1), w AS (SELECT v.*, b FROM v JOIN bh USING (symbol))"
)
register(
    "o09_evaluate",
    lambda s, d: show(evaluated(s, d), ["model", "symbol", "num_days", "num_trades"], 5, ["total_return", "sharpe_ratio", "win_rate", "excess_return", "excess_return_pct"]),
    f"WITH {_EVAL} SELECT model, symbol, n AS num_days, nt AS num_trades, "
    + rr(5, total_return="tr", sharpe_ratio="sh", win_rate="wr", excess_return="tr - b", excess_return_pct="coalesce((tr - b) / nullif(abs(b), 0) * 100, 0)")
    + " FROM w",
)
register(
    "o10_comparison",
    lambda s, d: show(costs.comparison_table(evaluated(s, d)), ["model", "symbol", "num_trades", "rank"], 4, ["total_return_pct", "excess_return_pct", "win_rate_pct", "avg_return_per_trade_pct"]),
    f"WITH {_EVAL}, t AS (SELECT model, symbol, nt, tr * 100 AS a, (tr - b) * 100 AS e, wr * 100 AS w, ar * 100 AS r FROM w "
    "UNION ALL SELECT 'Buy & Hold', symbol, 2, b * 100, 0, 100, b * 50 FROM bh WHERE symbol IN (SELECT symbol FROM v)) "
    "SELECT model, symbol, CAST(nt AS BIGINT) AS num_trades, CAST(row_number() OVER (PARTITION BY symbol ORDER BY a DESC, model) AS INTEGER) AS rank, "
    + rr(4, total_return_pct="a", excess_return_pct="e", win_rate_pct="w", avg_return_per_trade_pct="r")
    + " FROM t",
)
