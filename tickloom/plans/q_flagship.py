"""Checked query: the flagship on one series per supplier."""

from __future__ import annotations

import math

from .catalog import KEY, pct, register, roll, rr, show, so_far
from .fixtures import SUPP
from .flagship import flagship_suppliers

Y = math.sqrt(252)
_CHAIN = [
    f"r AS (SELECT *, {pct('close')} AS r1 FROM bars)",
    f"p AS (SELECT *, {roll('avg', 'r1', 5)} AS prediction, ({roll('stddev_samp', 'r1', 20)}) * {Y!r} AS vol FROM r)",
    "s AS (SELECT *, coalesce(sign(prediction), 0) AS signal FROM p)",
    f"o AS (SELECT *, CASE WHEN {so_far('last_value(CASE WHEN signal <> 0 THEN signal END IGNORE NULLS)')} > 0 THEN 1 ELSE 0 END AS position FROM s)",
    f"e1 AS (SELECT *, lag(position, 1, 0) OVER ({KEY}) AS prev FROM o)",
    "e2 AS (SELECT *, CASE WHEN position = 1 AND prev = 0 THEN 'buy' WHEN position = 0 AND prev = 1 THEN 'sell' END AS side FROM e1)",
    f"e3 AS (SELECT *, {so_far('''last_value(CASE WHEN side = 'buy' THEN close END IGNORE NULLS)''')} AS p0 FROM e2)",
    f"e4 AS (SELECT *, {so_far('''product(CASE WHEN side = 'sell' THEN 1 - 0.95 * 1.001 + 0.95 * 0.999 * close / p0 ELSE 1.0 END)''')} AS closed FROM e3)",
    "e5 AS (SELECT *, closed * CASE WHEN position = 1 THEN 1 - 0.95 * 1.001 + 0.95 * close / p0 ELSE 1.0 END AS equity FROM e4)",
    f"e6 AS (SELECT *, {pct('equity')} AS ret, equity / {so_far('max(equity)')} - 1 AS dd FROM e5)",
]
register(
    "flagship",
    lambda s, d: show(flagship_suppliers(s, d), ["symbol", "bars", "trades"], 5, ["log_return", "mean_volatility", "sharpe_ratio", "max_drawdown"]),
    f"WITH {', '.join([SUPP, *_CHAIN])} SELECT symbol, count(*) AS bars, count(side) AS trades, "
    + rr(5, log_return="ln(arg_max(equity, ts) / arg_min(equity, ts))", mean_volatility="avg(vol)",
         sharpe_ratio=f"(avg(ret) - 0.02 / 252) / stddev_samp(ret) * {Y!r}", max_drawdown="min(dd)")
    + " FROM e6 GROUP BY 1",
)
