"""Blocked, parallel forms equal the plain ones; recurrences equal a plain loop; nothing looks ahead."""

import math
import random

import pytest
from pyspark.sql import functions as F, types as T

from tickloom.operators import folds, indicators, ledger
from tickloom.operators.quantiles import exact_quantiles
from tickloom.operators.series import Blocks, affine, ewm, islands, number_rows, rolling, running

SCHEMA = "symbol string, ts int, open double, high double, low double, close double, volume double"


def series(sizes, seed=1):
    rng, rows = random.Random(seed), []
    for s, n in sizes.items():
        p = 100.0
        for i in range(n):
            o, p = p, max(1.0, p * (1 + rng.gauss(0, 0.03)))
            rows.append((s, i, o, max(o, p) * 1.01, min(o, p) * 0.99, p, float(rng.randint(1, 50))))
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def hot(spark):
    """One series holds most of the rows."""
    return spark.createDataFrame(series({"hot": 900, "a": 40, "b": 7, "one": 1}), SCHEMA).repartition(5).cache()


def blocks(rows=64):
    return Blocks(rows, (F.floor(F.col("ts") / 100),))


def table(df, *cols):
    rows = df.select("symbol", "ts", *cols).collect()
    assert len({(r[0], r[1]) for r in rows}) == len(rows)
    return {(r[0], r[1]): tuple(r[2:]) for r in rows}


def close(a, b, tol=1e-9):
    assert a.keys() == b.keys()
    for k in a:
        for x, y in zip(a[k], b[k]):
            if x is None or y is None or isinstance(x, str):
                assert x == y, (k, a[k], b[k])
            else:
                assert math.isclose(x, y, rel_tol=tol, abs_tol=1e-9), (k, a[k], b[k])


def test_positions(hot):
    a = table(number_rows(hot, ["symbol"], ["ts"], None), "_rn")
    b = table(number_rows(hot, ["symbol"], ["ts"], blocks()), "_rn")
    assert a == b
    assert all(v[0] == k[1] for k, v in a.items())


@pytest.mark.parametrize("size", [20, 64, 1000])
def test_blocked_rolling(hot, size):
    steps = (
        lambda w: {"_r": w.change("close"), "nxt": w.lead("close", 3)},
        lambda w: {"m": w.roll(F.avg, "_r", 15), "hi": w.roll(F.max, "close", 20)},
    )
    plain = table(rolling(hot, *steps), "m", "hi", "nxt")
    close(plain, table(rolling(hot, *steps, before=20, after=3, blocks=blocks(size)), "m", "hi", "nxt"))


def test_halo_longer_than_block_is_refused(hot):
    with pytest.raises(ValueError):
        rolling(hot, lambda w: {"m": w.roll(F.avg, "close", 200)}, before=199, blocks=blocks(64))


def test_blocked_running(hot):
    items = {
        "s": ("sum", F.col("volume")),
        "n": ("count", F.when(F.col("volume") > 25, 1)),
        "p": ("product", F.col("close") / F.col("open")),
        "hi": ("max", F.col("close")),
        "lo": ("min", F.col("close")),
        "last": ("last", F.when(F.col("volume") > 45, F.col("close"))),
    }
    close(table(running(hot, items), *items), table(running(hot, items, blocks=blocks()), *items))


def test_islands_add_up(hot):
    d = islands(hot, lambda w: {"s": (F.col("volume") > 25) != F.coalesce(w.lag("volume") > 25, F.lit(False))}, blocks=blocks())
    e = islands(hot, lambda w: {"s": (F.col("volume") > 25) != F.coalesce(w.lag("volume") > 25, F.lit(False))})
    assert table(d, "island") == table(e, "island")
    assert d.groupBy("symbol", "island").count().agg(F.sum("count")).first()[0] == hot.count()


@pytest.mark.parametrize("tile,blk", [(256, None), (8, None), (8, True)])
def test_affine_equals_a_loop(hot, tile, blk):
    a = 0.5 + (F.col("volume") % 7) / 20.0
    b = F.when(F.col("volume") != 13, F.col("close"))
    got = table(affine(hot, {"y": (a, b), "z": (0.9, b)}, tile=tile, blocks=blocks() if blk else None), "y", "z")
    want = {}
    for s in ("hot", "a", "b", "one"):
        y = z = 0.0
        for r in sorted((r for r in hot.collect() if r.symbol == s), key=lambda r: r.ts):
            if r.volume != 13:
                y, z = (0.5 + (r.volume % 7) / 20.0) * y + r.close, 0.9 * z + r.close
            want[s, r.ts] = (y, z)
    close(got, want)


def test_ewm_equals_pandas(hot):
    d = table(ewm(hot, {"e": (F.col("close"), 2 / 11.0, 10), "w": (F.col("close"), 1 / 14.0, 1), "same": (F.col("close"), 1.0, 1)}), "e", "w", "same")
    for s, p in hot.toPandas().sort_values("ts").groupby("symbol"):
        e = p.close.ewm(span=10, adjust=False, min_periods=10).mean()
        w = p.close.ewm(alpha=1 / 14, adjust=False).mean()
        for ts, x, y, c in zip(p.ts, e, w, p.close):
            g = d[s, ts]
            assert (g[0] is None) == (x != x) and (x != x or math.isclose(g[0], x, rel_tol=1e-9))
            assert math.isclose(g[1], y, rel_tol=1e-9) and g[2] == c


def test_strong_forgetting_stays_in_range(hot):
    d = table(ewm(hot, {"e": (F.col("close"), 0.95, 1), "f": (F.col("close"), 0.999999, 1)}), "e", "f")
    for s, p in hot.toPandas().sort_values("ts").groupby("symbol"):
        for ts, x, y in zip(p.ts, p.close.ewm(alpha=0.95, adjust=False).mean(), p.close.ewm(alpha=0.999999, adjust=False).mean()):
            assert math.isclose(d[s, ts][0], x, rel_tol=1e-9) and math.isclose(d[s, ts][1], y, rel_tol=1e-9)


def test_psar_skips_bars_without_prices(hot):
    gap = F.col("volume") == 13
    known = table(folds.add_psar(hot.filter(~gap)), "psar")
    got = table(folds.add_psar(hot.withColumns({c: F.when(~gap, F.col(c)) for c in ("high", "low", "close")})), "psar")
    for k, v in got.items():
        assert v == known.get(k, (None,)) or math.isclose(v[0], known[k][0], rel_tol=1e-12)


def test_blocked_ewm(hot):
    items = {"e": (F.col("close"), 2 / 51.0, 50)}
    close(table(ewm(hot, items), "e"), table(ewm(hot, items, blocks=blocks()), "e"))


def test_blocked_state_machines(hot):
    close(table(folds.add_psar(hot), "psar"), table(folds.add_psar(hot, blocks=blocks()), "psar"))
    sig = hot.withColumn("signal", F.when(F.col("volume") > 40, 1).when(F.col("volume") < 3, -1).otherwise(0))
    a = table(folds.positions_with_stops(sig, 0.05, 0.08), "position", "exit_reason")
    b = table(folds.positions_with_stops(sig, 0.05, 0.08, blocks=blocks(30)), "position", "exit_reason")
    assert a == b
    assert {"stop", "take_profit", "signal"} <= {v[1] for v in a.values()}


def test_blocked_indicators_and_equity(hot):
    close(
        table(indicators.add_features(hot, "bollinger", "aroon", "cci"), "bb_upper", "aroon_up", "cci"),
        table(indicators.add_features(hot, "bollinger", "aroon", "cci", blocks=blocks()), "bb_upper", "aroon_up", "cci"),
    )
    close(
        table(indicators.add_recursive(hot, ["rsi_14", "macd_signal", "adx", "kama"]), "rsi_14", "macd_signal", "adx", "kama"),
        table(indicators.add_recursive(hot, ["rsi_14", "macd_signal", "adx", "kama"], blocks=blocks()), "rsi_14", "macd_signal", "adx", "kama"),
        1e-8,
    )
    held = ledger.positions(hot.withColumn("signal", F.when(F.col("volume") > 30, 1).when(F.col("volume") < 10, -1).otherwise(0)))
    close(table(ledger.equity_curve(held), "equity", "trip"), table(ledger.equity_curve(held, blocks=blocks()), "equity", "trip"))


def test_partitioning_does_not_matter(hot):
    a = table(indicators.add_features(hot.repartition(1), "sma"), "sma_20")
    assert a == table(indicators.add_features(hot.repartition(11, "ts"), "sma"), "sma_20")


def test_features_do_not_look_ahead(hot):
    cols = ["sma_20", "cci", "bb_percent", "psar", "rsi_14", "kama"]

    def run(df):
        d = indicators.add_features(df, "sma", "cci", "bollinger")
        return table(indicators.add_recursive(folds.add_psar(d), ["rsi_14", "kama"]), *cols)

    full, cut_off = run(hot), run(hot.filter("ts < 500"))
    close(cut_off, {k: v for k, v in full.items() if k in cut_off})


@pytest.mark.parametrize("leaf", [1, 50, 100_000])
def test_exact_quantiles(spark, hot, leaf):
    probs = (0.0, 0.05, 0.5, 0.77, 1.0)
    skewed = hot.withColumn("x", F.when(F.col("ts") % 3 == 0, 5.0).otherwise(F.pow("close", F.lit(3.0))))
    got = {(r.symbol, r.prob): r.value for r in exact_quantiles(skewed, "x", probs, cells=16, leaf=leaf).collect()}
    for r in skewed.groupBy("symbol").agg(F.percentile("x", list(probs)).alias("q")).collect():
        for p, v in zip(probs, r.q):
            assert math.isclose(got[r.symbol, p], v, rel_tol=1e-9)


def plain_ledger(trades, capital=10_000.0):
    """(symbol, ts) -> holding, average price, realised PnL, cash: one trade after the other."""
    out = {}
    for s in {t[0] for t in trades}:
        q = cost = 0.0
        cash = capital
        for _, at, side, x, p, c in sorted(t for t in trades if t[0] == s):
            entry, pnl = cost / q if q else 0.0, 0.0
            if side == "buy":
                q, cost, cash = q + x, cost + x * p, cash - x * p - c
            else:
                left = max(q - x, 0.0)
                q, cost, cash, pnl = left, cost * left / q if left else 0.0, cash + x * p - c, (p - entry) * x - c
            out[s, at] = q, cost / q if q else None, pnl, cash
    return out


@pytest.mark.parametrize("rows", [20, 64, 10_000])
def test_ledger_in_blocks_moves_the_trades_once(spark, rows):
    rng = random.Random(5)
    trades = [
        (s, i, rng.choice(["buy", "sell"]) if i % 90 > 45 else "buy", float(rng.randint(1, 50)), rng.uniform(1, 9), 0.25)
        for s, n in {"hot": 900, "a": 40, "one": 1}.items()
        for i in range(n)
    ]
    d = spark.createDataFrame(trades, "symbol string, ts int, side string, quantity double, price double, commission double").repartition(5)
    got = ledger.trade_ledger(d, blocks=blocks(rows))
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") <= 2  # the trades; the states where there are blocks
    close(table(got, "holding", "avg_price", "realised_pnl", "cash"), plain_ledger(trades))


def test_ledger_with_unknown_quantities(spark):
    rows = [("x", 1, "buy", None, 5.0, 0.0), ("x", 2, "buy", 10.0, 7.0, 1.0), ("x", 3, "sell", 4.0, None, 1.0), ("x", 4, "sell", 3.0, 9.0, 1.0), (None, 5, "buy", 1.0, 3.0, 0.0)]
    d = spark.createDataFrame(rows, "symbol string, ts int, side string, quantity double, price double, commission double")
    for b in (None, Blocks(1, (F.col("ts"),))):
        r = table(ledger.trade_ledger(d, blocks=b), "holding", "avg_price", "realised_pnl", "cash")
        assert r == {("x", 1): (None, None, 0.0, None), ("x", 2): (10.0, 7.0, 0.0, 9929.0), ("x", 3): (6.0, 7.0, None, 9929.0), ("x", 4): (3.0, 7.0, 5.0, 9955.0)}


def test_ledger_of_short_accounts_stores_no_trades(spark, monkeypatch):
    from tickloom.operators import series as core

    stored = []
    for module, name in ((core, "cut"), (core, "stage"), (ledger, "stage")):
        monkeypatch.setattr(module, name, lambda d, *a, f=getattr(module, name): stored.append(d.count()) or f(d, *a))
    d = spark.range(400).selectExpr("cast(id % 40 AS string) AS symbol", "cast(id AS int) AS ts", "if(id % 3 = 0, 'sell', 'buy') AS side", "2.0D AS quantity", "3.0D AS price", "0.0D AS commission")
    assert ledger.trade_ledger(d, blocks=blocks(20)).count() == 400 and sum(stored) == 0
    # one account is longer than a block: its trades are cut, the others stay
    long = d.withColumn("symbol", F.expr("if(ts < 100, 'long', symbol)"))
    assert ledger.trade_ledger(long, blocks=Blocks(20, (F.floor(F.col("ts") / 10),))).count() == 400 and 100 < sum(stored) < 200


def test_ledger_walks_repeated_trades_in_one_order(spark):
    trades = [("x", i, "sell" if i % 4 == 3 else "buy", float(1 + i % 5), float(2 + i % 7), 0.5) for i in range(60)]
    d = spark.createDataFrame([t for t in trades for _ in range(3)], "symbol string, ts int, side string, quantity double, price double, commission double").repartition(7)
    apart = plain_ledger([(s, 3 * at + k, *rest) for s, at, *rest in trades for k in range(3)])
    want = sorted((at // 3, *v) for (_, at), v in apart.items())
    for b in (None, Blocks(20, (F.floor(F.col("ts") / 5),))):
        got = sorted(tuple(r) for r in ledger.trade_ledger(d, blocks=b).select("ts", "holding", "avg_price", "realised_pnl", "cash").collect())
        assert [g[0] for g in got] == [x[0] for x in want]
        assert all(math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9) for g, x in zip(got, want) for x, y in zip(g[1:], x[1:]))
