"""Hand-worked small frames: warm-up, NULL, flat prices, ties, single rows, empty input."""

import math

import pytest
from pyspark.sql import functions as F

from tickloom.operators import clean, costs, folds, indicators, labels, ledger, metrics, prediction, quality, scale, signals
from tickloom.sources import combine, files
from tickloom.sources.bars import map_symbol, ticks_to_bars

BAR = "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double"


def day(i):
    import datetime

    return datetime.datetime(2024, 1, 1) + datetime.timedelta(days=i)


def bars(spark, closes, symbol="x", volume=1.0):
    return spark.createDataFrame([(symbol, day(i), c, c, c, c, volume) for i, c in enumerate(closes)], BAR)


def col(df, name, order="ts"):
    return [r[name] for r in df.orderBy(order).collect()]


def test_ticks_to_bars(spark):
    t = spark.createDataFrame(
        [("x", day(0), 2, 5.0, 1.0), ("x", day(0), 1, 4.0, 2.0), ("x", day(0), 3, 9.0, 1.0), ("x", day(1), 1, 7.0, 1.0)],
        "symbol string, ts timestamp_ntz, seq long, price double, size double",
    )
    r = ticks_to_bars(t, order=["seq"]).orderBy("ts").first()
    assert (r.open, r.high, r.low, r.close, r.volume) == (4.0, 9.0, 4.0, 9.0, 4.0)


def test_empty_and_single_row(spark):
    none = bars(spark, []).select("*")
    assert indicators.add_features(none, "sma", "bollinger").count() == 0
    one = bars(spark, [5.0])
    r = indicators.add_features(one, "sma", "price_ratios", "bar_shape").first()
    assert r.sma_5 is None and r.open_close_ratio == 1.0 and r.price_position is None
    assert metrics.drawdown_metrics(one, value="close").first().max_drawdown == 0.0


def test_flat_prices_have_no_zero_divisions(spark):
    d = indicators.add_features(bars(spark, [5.0] * 40), "bollinger", "stoch", "cci", "williams_r", "mfi", "cmf")
    last = d.orderBy(F.desc("ts")).first()
    assert last.bb_width == 0.0 and last.bb_percent is None and last.stoch_k is None and last.cci is None and last.cmf == 0.0
    assert indicators.add_recursive(bars(spark, [5.0] * 40), ["rsi_14"]).orderBy(F.desc("ts")).first().rsi_14 == 100.0


def test_guard(spark):
    with pytest.raises(ValueError):
        indicators.add_features(bars(spark, [1.0]).drop("volume"), "sma")
    with pytest.raises(ValueError):
        indicators.add_features(bars(spark, [1.0]), "no_such_feature")


def test_two_series_do_not_mix(spark):
    d = bars(spark, [1.0, 2.0, 3.0], "a").union(bars(spark, [10.0, 20.0, 30.0], "b"))
    out = labels.add_labels(d, 1)
    assert [r.future_return_1d for r in out.filter("symbol = 'a'").orderBy("ts").collect()] == [1.0, 0.5, None]
    assert col(out.filter("symbol = 'b'"), "direction") == [1, 1, None]


def test_repair(spark):
    d = spark.createDataFrame(
        [("x", day(0), 5.0, 4.0, 6.0, 7.0, -3.0), ("x", day(1), -1.0, 4.0, 1.0, 2.0, 1.0), ("x", day(2), 5.0, 6.0, 4.0, None, None)], BAR
    )
    rows = clean.repair_prices(d).orderBy("ts").collect()
    assert [(r.high, r.low, r.volume) for r in rows] == [(7.0, 5.0, 0.0), (6.0, 4.0, None)]


def test_fill(spark):
    d = bars(spark, [None, 2.0, None, None, 5.0, None])
    assert col(clean.fill_forward(d, ["close"]), "close") == [2.0, 2.0, 2.0, 2.0, 5.0, 5.0]
    assert col(clean.fill_forward(d, ["close"], backfill=False), "close") == [None, 2.0, 2.0, 2.0, 5.0, 5.0]
    assert col(clean.interpolate(d, ["close"]), "close") == [None, 2.0, 3.0, 4.0, 5.0, 5.0]
    assert col(clean.fill_mean(d, ["close"]), "close") == [3.5, 2.0, 3.5, 3.5, 5.0, 3.5]


def test_dedup_keeps_the_first(spark):
    d = spark.createDataFrame([("x", day(0), 2, 5.0), ("x", day(0), 1, 4.0)], "symbol string, ts timestamp_ntz, seq int, price double")
    assert clean.dedup(d, tiebreak=["seq"]).first().price == 4.0


def test_outliers(spark):
    d = bars(spark, [10.0, 11.0, 12.0, 11.0, 10.0, 100.0])
    assert clean.outliers_iqr(d).count() == 5
    assert clean.outliers_iqr(d, large_groups=True).count() == 5
    assert clean.outliers_zscore(d, k=1.5).count() == 5


def test_quality(spark):
    d = bars(spark, [10.0, 12.0, 6.0]).union(spark.createDataFrame([("x", day(6), 6.0, 6.0, 6.0, 6.0, 100.0)], BAR))
    assert [r.direction for r in quality.price_jumps(d).orderBy("ts").collect()] == ["spike", "crash"]
    g = quality.gaps(d).first()
    assert (g.gap_hours, g.missing_periods) == (96.0, 3)
    f = quality.freshness(d, F.lit("2024-01-08").cast("timestamp")).first()
    assert f.age_hours == 24.0 and f.is_fresh


def test_priority_and_divergence(spark):
    s = bars(spark, [10.0, 11.0]).withColumn("source", F.lit("b")).union(bars(spark, [20.0]).withColumn("source", F.lit("a")))
    assert combine.combine_average(s).first().close == 15.0
    assert col(combine.combine_priority(s, ["a"]), "close") == [20.0]
    assert col(combine.combine_priority(s, ["a", "b"], per_bar=True), "close") == [20.0, 11.0]
    assert quality.source_divergence(s).first().divergence_pct == 0.5


def test_split_is_a_partition(spark):
    d = scale.split(bars(spark, [float(i) for i in range(10)]))
    assert col(d, "split") == ["train"] * 7 + ["val"] + ["test"] * 2
    with pytest.raises(ValueError):
        scale.split(d, (0.5, 0.2, 0.2))


def test_constant_column_scales_to_zero(spark):
    d = bars(spark, [5.0, 5.0])
    assert col(scale.scale(d, scale.fit_scaler(d, ["close"]), ["close"]), "close") == [0.0, 0.0]


def test_positions_and_equity(spark):
    d = bars(spark, [10.0, 11.0, 12.0, 6.0, 6.0]).withColumn("signal", F.element_at(F.array(*[F.lit(s) for s in (-1, 1, 0, -1, 1)]), F.dayofmonth("ts")))
    e = ledger.equity_curve(ledger.positions(d), capital=100.0, fraction=1.0, commission=0.0)
    assert col(e, "position") == [0, 1, 1, 0, 1]
    assert [round(x, 6) for x in col(e, "equity")] == [100.0, 100.0, round(1200 / 11, 6), round(600 / 11, 6), round(600 / 11, 6)]
    trips = ledger.round_trips(ledger.trade_list(e)).collect()
    assert len(trips) == 1 and math.isclose(trips[0].return_pct, 6 / 11 - 1) and trips[0].duration_hours == 48.0
    assert col(ledger.equity_curve(ledger.positions(d), fraction=1.0, commission=0.01), "position") == [0] * 5


def test_stop_then_reentry(spark):
    d = bars(spark, [10.0, 9.0, 9.0, 12.0, 12.0]).withColumn("signal", F.lit(1))
    p = folds.positions_with_stops(d, 0.05, 0.2)
    assert col(p, "position") == [1, 0, 1, 0, 1]
    assert col(p, "exit_reason") == [None, "stop", None, "take_profit", None]


def test_partial_sells(spark):
    t = spark.createDataFrame(
        [("x", 1, "buy", 10.0, 5.0, 0.0), ("x", 2, "buy", 10.0, 7.0, 0.0), ("x", 3, "sell", 5.0, 8.0, 1.0), ("x", 4, "sell", 15.0, 6.0, 0.0), ("x", 5, "buy", 1.0, 3.0, 0.0)],
        "symbol string, ts int, side string, quantity double, price double, commission double",
    )
    r = ledger.trade_ledger(t, capital=1000.0).orderBy("ts").collect()
    assert [x.holding for x in r] == [10.0, 20.0, 15.0, 0.0, 1.0]
    assert [None if x.avg_price is None else round(x.avg_price, 9) for x in r] == [5.0, 6.0, 6.0, None, 3.0]
    assert [round(x.realised_pnl, 9) for x in r] == [0.0, 0.0, 9.0, 0.0, 0.0]
    assert r[-1].cash == 1000 - 50 - 70 + 39 + 90 - 3


def test_metrics(spark):
    d = spark.createDataFrame([("x", day(i), r) for i, r in enumerate([0.1, -0.1, 0.2, 0.1, -0.3])], "symbol string, ts timestamp_ntz, ret double")
    s = metrics.streak_metrics(d).first()
    assert (s.max_consecutive_wins, s.max_consecutive_losses, s.avg_consecutive_wins) == (2, 1, 1.5)
    t = metrics.trading_metrics(d).first()
    assert (t.winning_trades, t.losing_trades, t.zero_trades, t.win_rate) == (3, 2, 0, 0.6)
    assert math.isclose(t.profit_factor, 1.0)
    wins = metrics.ratio_metrics(spark.createDataFrame([("x", 0.1), ("x", 0.1)], "symbol string, ret double")).first()
    assert wins.omega_ratio is None and wins.sharpe_ratio == 0.0
    v = metrics.drawdown_metrics(bars(spark, [10.0, 5.0, 8.0, 12.0, 6.0]), value="close").first()
    assert (v.max_drawdown, v.max_drawdown_duration, v.avg_drawdown_duration, v.drawdown_periods) == (-0.5, 2, 1.5, 2)


def test_auc_with_ties(spark):
    d = spark.createDataFrame([(1, 0.5), (0, 0.5), (1, 0.9), (0, 0.1)], "y int, score double")
    assert prediction.roc_auc(d).first().auc == 0.875
    flat = spark.createDataFrame([(1, 0.5), (0, 0.5)], "y int, score double")
    assert prediction.roc_auc(flat).first().auc == 0.5


def test_breakeven_equals_bisection(spark):
    rows = [("m", "x", day(i), s, r) for i, (s, r) in enumerate([(0, 0.1), (1, 0.03), (1, -0.01), (0, 0.2), (1, 0.02), (0, 0.0)])]
    d = costs.paid_bars(spark.createDataFrame(rows, "model string, symbol string, ts timestamp_ntz, signal int, ret double"))
    cost = costs.breakeven(d).first().breakeven_cost
    lo, hi = 0.0, 0.02
    while hi - lo > 1e-4:
        mid = (lo + hi) / 2
        total = costs.cost_grid(d, [mid]).first().total_return
        lo, hi = (mid, hi) if total > 0 else (lo, mid)
    assert abs(cost - (lo + hi) / 2) <= 1e-4


def test_consensus_counts_missing_as_hold(spark):
    d = spark.createDataFrame([("x", 1, "a", 1), ("x", 1, "b", 1), ("x", 2, "a", 1)], "symbol string, ts int, strategy string, signal int")
    assert col(signals.consensus(d, {"a": 1.0, "b": 2.0}), "signal") == [1, 0]


def test_columns_and_symbols(spark):
    d = bars(spark, [1.0]).toDF("SYMBOL", "Timestamp", "Open", "High", "Low", "Adj Close", "Volume")
    assert files.standardise_columns(d).columns == ["symbol", "ts", "open", "high", "low", "close", "volume"]
    with pytest.raises(ValueError):
        files.standardise_columns(d.drop("High"))
    s = spark.createDataFrame([("btc",), ("Eth",)], "s string").select(map_symbol(F.col("s"), {"BTC": "bitcoin"}).alias("id"))
    assert [r.id for r in s.collect()] == ["bitcoin", "eth"]


def test_stale_alert(spark):
    from tickloom.streaming import bars as st, online

    quiet = bars(spark, [10.0, 10.0], "quiet")
    busy = bars(spark, [10.0] * 12, "busy")
    fed = st.replay(quiet.union(busy), parts=3)
    with online.rocksdb_state(spark):
        out = st.run(online.online_alerts(st.file_stream(spark, fed.path, fed.schema)), "alerts", feed=fed.feed)
    assert [(r.symbol, r.alert) for r in out.collect()] == [("quiet", "stale")]


def test_simplex_equals_the_filtered_product():
    import itertools

    from tickloom.operators.ensembles import simplex

    for n, least in ((1, 0.0), (2, 0.2), (3, 0.0), (3, 0.25), (3, 0.5)):
        every = [tuple(round(x * 0.1, 10) for x in c) for c in itertools.product(range(11), repeat=n) if sum(c) == 10]
        assert simplex(n, 0.1, least) == [v for v in every if min(v) >= least - 1e-9]
    assert len(simplex(10)) == 92_378


def test_late_bars_are_folded_in_order_and_too_late_ones_counted(spark):
    """Bars of three batches, most out of order; one comes after the watermark has passed it."""
    import datetime as dt

    from tickloom.streaming import bars as st, online

    day = lambda k: dt.datetime(2024, 1, 1) + dt.timedelta(days=k)
    # (batch, day, close): day 2 comes in the second batch, day 1 when day 9 was seen and two days of delay are over
    rows = [(0, 3, 30.0), (0, 0, 10.0), (1, 2, 25.0), (1, 9, 9.0), (1, 4, 35.0), (2, 1, 99.0), (2, 8, 50.0)]
    d = spark.createDataFrame([("s", day(k), c, c, c, c, 1.0, b) for b, k, c in rows], "symbol string, ts timestamp, open double, high double, low double, close double, volume double, b int")
    fed = st.replay(d, part=F.col("b"))
    with online.rocksdb_state(spark):
        stream, folder = st.closing(st.file_stream(spark, fed.path, fed.schema))
        out = st.run(online.online_drawdown(stream, 0.5, delay="2 days"), "drawdown", feed=fed.feed, close=folder).collect()
    got = sorted((r.ts, r.peak) for r in out if r.symbol is not None)
    assert got == [(day(0), 10.0), (day(2), 25.0), (day(3), 30.0), (day(4), 35.0), (day(8), 50.0), (day(9), 50.0)]


def test_sessions_of_a_table_and_of_a_stream(spark):
    import datetime as dt

    from tickloom.streaming import bars as st

    at = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    rows = [("a", at(m), float(m), 1.0) for m in (0, 20, 39, 100, 129)] + [("b", at(39), 5.0, 2.0)]
    d = spark.createDataFrame(rows, "symbol string, ts timestamp, price double, size double")
    want = {("a", at(0), at(69), 3, 0.0, 39.0), ("a", at(100), at(159), 2, 100.0, 129.0), ("b", at(39), at(69), 1, 5.0, 5.0)}
    fed = st.replay(d, parts=2)
    stream, folder = st.closing(st.file_stream(spark, fed.path, fed.schema))
    streamed = st.run(st.stream_sessions(stream), "sessions", feed=fed.feed, close=folder)
    for out in (st.stream_sessions(d), streamed):
        assert {(r.symbol, r.ts, r.end, r.ticks, r.open, r.close) for r in out.collect() if r.symbol} == want


def test_resting_orders_fill_at_the_first_bar_that_reaches_them(spark):
    import random

    from tickloom.operators import ledger

    rng = random.Random(4)
    series = {s: [round(rng.uniform(5, 15), 1) for _ in range(60)] for s in ("p", "q")}
    b = spark.createDataFrame([(s, k, None if k == 7 else c) for s, cs in series.items() for k, c in enumerate(cs)], "symbol string, ts long, close double")
    rows = []
    for i in range(400):
        kind, side, x = rng.choice(["market", "limit", "stop"]), rng.choice(["buy", "sell"]), rng.choice([None, *(round(rng.uniform(4, 16), 1) for _ in range(9))])
        rows.append((i, rng.choice(["p", "q", "r"]), rng.randint(-2, 62), side, kind, x if kind == "limit" else None, x if kind == "stop" else None))
    o = spark.createDataFrame(rows, "id long, symbol string, ts long, side string, type string, limit_price double, stop_price double")

    def first(symbol, ts, side, kind, li, st):
        for k, c in enumerate(series.get(symbol, [])):
            if k < ts or k == 7:
                continue
            if kind == "market":
                return k, c
            if kind == "limit" and li is not None and (c <= li if side == "buy" else c >= li):
                return k, li
            if kind == "stop" and st is not None and (c >= st if side == "buy" else c <= st):
                return k, c
        return None, None

    got = {r.id: (r.fill_ts, r.fill_price) for r in ledger.fill_resting(o.repartition(3), b.repartition(3)).collect()}
    assert got == {i: first(*rest) for i, *rest in rows}


def test_auc_of_crowded_scores_spreads_over_tasks(spark):
    import random

    from tickloom.operators import prediction

    rng = random.Random(8)
    rows = [(rng.randint(0, 1), round(rng.random() * 1e-6, 9) if i % 100 else rng.random() * 1e6) for i in range(3000)] + [(1, None), (None, 0.5)]
    d = spark.createDataFrame(rows, "y int, score double")
    known = [(y, x) for y, x in rows if y is not None and x is not None]
    p, q = [x for y, x in known if y], [x for y, x in known if not y]
    want = sum((a > b) + (a == b) / 2 for a in p for b in q) / (len(p) * len(q))
    assert abs(prediction.roc_auc(d).first().auc - want) < 1e-12
    parts = prediction.score_ranges(d.filter("y IS NOT NULL AND score IS NOT NULL").groupBy(F.col("score").alias("_s")).agg(F.count("y").alias("_q")), (), 8)
    sizes = [r["count"] for r in parts.groupBy("_cell").count().collect()]
    assert len(sizes) > 4 and max(sizes) < 3 * sum(sizes) / len(sizes)


def test_products_stay_in_range_over_many_periods(spark):
    import math

    from tickloom.operators import indicators, ledger, metrics

    n = 20_000
    d = spark.range(n).select(F.lit("s").alias("symbol"), F.col("id").alias("ts"), F.lit(0.1).alias("ret"))
    m = metrics.return_metrics(d).first()
    assert m.final_value is None and m.total_return is None and abs(m.log_return - n * math.log(1.1)) < 1e-6
    signs = spark.createDataFrame([("a", -3.0), ("a", -0.5), ("b", -1.0), ("b", 4.0), ("c", -2.0), ("c", None)], "symbol string, ret double")
    got = {r.symbol: (r.final_value, r.log_return) for r in metrics.return_metrics(signs).collect()}
    assert got["a"][0] == -1.0 and got["a"][1] is None and got["b"] == (0.0, None) and got["c"] == (-1.0, None)
    # ten per cent up in every second bar, held then, sold in the other
    b = spark.range(n).select(
        F.lit("s").alias("symbol"), F.col("id").alias("ts"), F.pow(F.lit(1.1), F.col("id") % 2).alias("close"), (1 - F.col("id") % 2).cast("int").alias("position"),
        F.pow(F.lit(1.1), F.col("id") % 2).alias("high"), F.lit(0.5).alias("low"), F.lit(1.0).alias("open"), (-F.col("id")).cast("double").alias("volume"),
    )
    e = ledger.equity_curve(b, commission=0.0, fraction=1.0, capital=1.0)
    last = e.orderBy(F.desc("ts")).first()
    assert last.equity is None and abs(last.log_equity - n / 2 * math.log(1.1)) < 1e-6 and abs(last.ret - 0.1) < 1e-9
    assert e.filter("log_equity IS NULL OR isnan(ret) OR equity = double('infinity')").count() == 0
    grows = b.withColumn("close", F.lit(1.0) + F.col("ts")).withColumn("volume", F.lit(1.0))
    assert indicators.add_cumulative(grows).filter("nvi = double('infinity') OR isnan(nvi)").count() == 0
