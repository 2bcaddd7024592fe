"""Checked queries: sources, combination, cleaning, scaling, quality, labels and sequences."""

from __future__ import annotations

from pyspark.sql import functions as F, types as T

from ..operators import clean, labels, quality, scale
from ..operators.quantiles import exact_quantiles
from ..operators.series import rolling
from ..schema import OHLCV
from ..sources import bars as sb, combine, files
from .catalog import KEY, columns_query, lag, register, roll, rr, show, so_far, w
from .fixtures import (
    EVENT_TICKS_SQL, HOUR, ORDERS, SOURCES, SUPP, event_ticks, hour_bars, line_ticks, line_ticks_sql, order_bars,
    source_bars, supp_bars, table,
)

BAR = {c: c for c in OHLCV}
KEYS = ("symbol", "ts")


def bar_query(name, bars, bars_sql, compute, columns=None, **kw):
    """Bars come out as they are: both engines pick or divide the same doubles."""
    if columns is None:
        kw.setdefault("raw", OHLCV)
    columns_query(name, bars, bars_sql, compute, columns or BAR, **kw)


# --- A: sources and sinks


def _csv_round_trip(bars):
    path = files.scratch(bars.sparkSession, "bars-csv")
    files.write_table(bars, path, "csv")
    return files.read_bars(bars.sparkSession, path, "csv")


def _parquet_round_trip(bars):
    path = files.scratch(bars.sparkSession, "bars")
    files.write_table(bars, path, partition_by=["symbol"])
    return files.read_bars(bars.sparkSession, path, "parquet")


bar_query("a01_csv_scan", supp_bars, SUPP, _csv_round_trip)
bar_query("a02_partitioned_sink", hour_bars, HOUR, _parquet_round_trip)


def _report(bars):
    return bars.groupBy("symbol").agg(
        F.struct(F.count(F.lit(1)).alias("bars"), F.max("high").alias("high")).alias("summary"), F.min("ts").alias("start")
    )


def _json_report(spark, sf):
    path = files.scratch(spark, "report")
    report = _report(supp_bars(spark, sf))
    files.write_report(report, path)
    back = spark.read.schema(report.schema).json(path)
    return back.select("symbol", F.col("summary.bars").alias("bars"), F.round("summary.high", 6).alias("high"), "start")


register(
    "a03_json_report",
    _json_report,
    f"WITH {SUPP} SELECT symbol, count(*) AS bars, round(max(high), 6) AS high, min(ts) AS start FROM bars GROUP BY 1",
)


def _newest(spark, sf):
    path = files.scratch(spark, "results")
    result = hour_bars(spark, sf).groupBy("symbol").agg(F.max("close").alias("best"))
    schema = T.StructType([T.StructField("symbol", T.StringType()), T.StructField("best", T.DoubleType()), T.StructField("run", T.IntegerType())])
    for run, factor in ((1, 0.5), (2, 1.0)):
        rows = result.select("symbol", (F.col("best") * factor).alias("best"), F.lit(run).alias("run"))
        rows.coalesce(1).write.mode("append").json(path)
    d = files.read_newest(spark, path, schema, key="symbol", required=["best"], max_age_hours=1)
    return show(d, ["symbol", "run"], 6, ["best"])


register("a04_newest_result", _newest, f"WITH {HOUR} SELECT symbol, 2 AS run, round(max(close), 6) AS best FROM bars GROUP BY 1")
register(
    "a05_epoch_millis",
    lambda s, d: sb.from_epoch_millis(
        table(s, d, "events").select("event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms")), "ms"
    ).select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts")),
    "SELECT event_id, date_trunc('millisecond', ts)::TIMESTAMP AS ts FROM events",
)
bar_query(
    "a06_standard_columns",
    supp_bars,
    SUPP,
    lambda b: files.standardise_columns(b.toDF("Symbol", "Timestamp", "Open", "High", "Low", "Adj Close", "Volume")),
)
_IDS = {"CLICK": "click-id", "VIEW": "view-id", "PURCHASE": "purchase-id"}
register(
    "a07_symbol_ids",
    lambda s, d: table(s, d, "events").groupBy(sb.map_symbol(F.col("event_type"), _IDS, F.lit("other")).alias("id")).agg(F.count(F.lit(1)).alias("n")),
    "SELECT CASE upper(event_type) WHEN 'CLICK' THEN 'click-id' WHEN 'VIEW' THEN 'view-id' WHEN 'PURCHASE' THEN 'purchase-id' "
    "ELSE 'other' END AS id, count(*) AS n FROM events GROUP BY 1",
)
bar_query(
    "a08_last_bars",
    supp_bars,
    SUPP,
    lambda b: sb.last_bars(b, 10),
    ctes=["l AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS r FROM bars)", "m AS (SELECT * FROM l WHERE r <= 10)"],
    source="m",
)
register(
    "a09_latest_prices",
    lambda s, d: show(sb.latest(event_ticks(s, d).select("symbol", "source", "ts", "price")), ["symbol", "source", "ts"], 6, ["price"]),
    f"WITH {EVENT_TICKS_SQL} SELECT symbol, source, max(ts) AS ts, round(arg_max(p, ts), 6) AS price FROM ticks GROUP BY 1, 2",
)
bar_query("a10_daily_bars", supp_bars, SUPP, lambda b: b)
bar_query("a10_hourly_bars", hour_bars, HOUR, lambda b: b)
_COARSE = (
    "arg_min(open, ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, ts) AS close, sum(volume) AS volume FROM bars GROUP BY ALL"
)
bar_query(
    "a11_resample_4h",
    hour_bars,
    HOUR,
    lambda b: sb.resample(b, "4 hours"),
    ctes=[f"c AS (SELECT symbol, time_bucket(INTERVAL 4 HOUR, bars.ts) AS ts, {_COARSE})".replace("GROUP BY ALL", "GROUP BY 1, 2")],
    source="c",
)
bar_query(
    "a11_resample_1d",
    hour_bars,
    HOUR,
    lambda b: sb.resample(sb.resample(b, "4 hours"), "1 day"),
    ctes=[f"c AS (SELECT symbol, date_trunc('day', bars.ts)::TIMESTAMP AS ts, {_COARSE})".replace("GROUP BY ALL", "GROUP BY 1, 2")],
    source="c",
)
register(
    "a12_parse_timestamp",
    lambda s, d: files.with_timestamp(table(s, d, "events").select("event_id", F.col("ts").cast("string").alias("timestamp"))).select("event_id", "ts"),
    "SELECT event_id, ts FROM events",
)
register(
    "a13_date_spine",
    lambda s, d: sb.spine_of(table(s, d, "orders"), "o_orderdate").select(F.col("day").cast("timestamp_ntz").alias("day")),
    "SELECT unnest(generate_series((SELECT min(o_orderdate) FROM orders)::TIMESTAMP, (SELECT max(o_orderdate) FROM orders)::TIMESTAMP, INTERVAL 1 DAY)) AS day",
)

# --- B: combination of sources

_COMMON = [
    "ns AS (SELECT symbol, count(DISTINCT source) AS n FROM bars GROUP BY 1)",
    "c AS (SELECT symbol, bars.ts AS ts, count(DISTINCT source) AS k, avg(open) AS open, avg(high) AS high, avg(low) AS low, "
    "avg(close) AS close, avg(volume) AS volume FROM bars GROUP BY 1, 2)",
    "m AS (SELECT c.* FROM c JOIN ns USING (symbol) WHERE k = n)",
]
bar_query("b01_combine_average", source_bars, SOURCES, combine.combine_average, ctes=_COMMON, source="m", raw=())
bar_query(
    "b02_combine_first",
    source_bars,
    SOURCES,
    lambda b: combine.combine(b, "first"),
    ctes=["f AS (SELECT symbol, min(source) AS source FROM bars GROUP BY 1)", "m AS (SELECT bars.* FROM bars JOIN f USING (symbol, source))"],
    source="m",
)
bar_query(
    "b03_combine_priority",
    source_bars,
    SOURCES,
    lambda b: combine.combine(b, "priority", ["s1", "s0"]),
    ctes=["m AS (SELECT * FROM bars WHERE source = 's1')"],
    source="m",
)
bar_query(
    "b03_priority_per_bar",
    source_bars,
    SOURCES,
    lambda b: combine.combine_priority(b, ["s1", "s0"], per_bar=True),
    ctes=["r AS (SELECT *, row_number() OVER (PARTITION BY symbol, ts ORDER BY source DESC) AS r FROM bars)", "m AS (SELECT * FROM r WHERE r = 1)"],
    source="m",
)
bar_query("b04_single_source", hour_bars, HOUR, lambda b: combine.combine_average(b.withColumn("source", F.lit("only"))))
bar_query(
    "b05_align_signals",
    hour_bars,
    HOUR,
    lambda b: combine.align(b, b.filter("volume > 1").select("symbol", "ts", (F.col("close") > F.col("open")).cast("int").alias("signal"))),
    BAR | {"signal": "CASE WHEN close > open THEN 1 ELSE 0 END"},
    ctes=["m AS (SELECT * FROM bars WHERE volume > 1)"],
    source="m",
)
register(
    "b08_common_slots",
    lambda s, d: combine.common_slots(source_bars(s, d)),
    f"WITH {SOURCES}, {', '.join(_COMMON)} SELECT symbol, ts FROM m",
)

# --- C: cleaning


def dirty_bars(spark, sf):
    """Supplier bars with planted faults: missing closes, crossed and negative prices, negative volume."""
    day = F.dayofmonth("ts")
    return supp_bars(spark, sf).withColumns(
        {
            "high": F.when(day % 7 == 0, F.least("open", "close") * 0.9).otherwise(F.col("high")),
            "low": F.when(day % 11 == 0, F.greatest("open", "close") * 1.1).otherwise(F.col("low")),
            "open": F.when(day == 13, -F.col("open")).otherwise(F.col("open")),
            "volume": F.when(day % 5 == 0, -F.col("volume")).otherwise(F.col("volume")),
            "close": F.when(day % 9 != 0, F.col("close")),
        }
    )


_D = "day(ts)"
DIRTY = SUPP.replace("bars AS (", "bars0 AS (") + (
    f", bars AS (SELECT symbol, ts, CASE WHEN {_D} = 13 THEN -open ELSE open END AS open, "
    f"CASE WHEN {_D} % 7 = 0 THEN least(open, close) * 0.9 ELSE high END AS high, "
    f"CASE WHEN {_D} % 11 = 0 THEN greatest(open, close) * 1.1 ELSE low END AS low, "
    f"CASE WHEN {_D} % 9 <> 0 THEN close END AS close, CASE WHEN {_D} % 5 = 0 THEN -volume ELSE volume END AS volume FROM bars0)"
)

register(
    "c01_dedup",
    lambda s, d: show(clean.dedup(line_ticks(s, d, "l_suppkey"), tiebreak=["seq"]), KEYS, 6, ["price", "size"], ["price", "size"]),
    f"WITH {line_ticks_sql('l_suppkey')} SELECT symbol, ts, arg_min(p, k) AS price, arg_min(q, k) AS size FROM ticks GROUP BY 1, 2",
)
register(
    "c02_time_order",
    lambda s, d: rolling(supp_bars(s, d), lambda w: {"position": F.row_number().over(w.spec)}).select(*KEYS, "position"),
    f"WITH {SUPP} SELECT symbol, ts, CAST(row_number() OVER ({KEY}) AS INTEGER) AS position FROM bars",
)
_HIGH = "greatest(high, open, close)"
_LOW = "least(low, open, close)"
bar_query(
    "c03_repair_prices",
    dirty_bars,
    DIRTY,
    clean.repair_prices,
    ctes=[
        f"f AS (SELECT symbol, ts, open, {_HIGH} AS high, {_LOW} AS low, close, greatest(volume, 0) AS volume FROM bars)",
        "m AS (SELECT * FROM f WHERE coalesce(least(open, high, low, close) > 0, true))",
    ],
    source="m",
)
_FF = {c: so_far(f"last_value({c} IGNORE NULLS)") for c in OHLCV}
bar_query(
    "c07_forward_fill",
    dirty_bars,
    DIRTY,
    clean.fill_forward,
    {c: f"coalesce({x}, first_value({c} IGNORE NULLS) OVER ({KEY} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))" for c, x in _FF.items()},
    raw=OHLCV,
)
bar_query(
    "c08_interpolate",
    dirty_bars,
    DIRTY,
    lambda b: clean.interpolate(b, ["close"]),
    {"close": "coalesce(close, pv + (nv - pv) * (CAST(rn - pi AS DOUBLE) / nullif(ni - pi, 0)), pv)"},
    ctes=[
        f"n AS (SELECT *, row_number() OVER ({KEY}) AS rn FROM bars)",
        "i AS (SELECT *, CASE WHEN close IS NOT NULL THEN rn END AS kn FROM n)",
        f"m AS (SELECT *, {so_far('last_value(close IGNORE NULLS)')} AS pv, {so_far('last_value(kn IGNORE NULLS)')} AS pi, "
        f"first_value(close IGNORE NULLS) OVER ({KEY} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nv, "
        f"first_value(kn IGNORE NULLS) OVER ({KEY} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ni FROM i)",
    ],
    source="m",
    raw=["close"],
)
bar_query("c09_drop_missing", dirty_bars, DIRTY, clean.drop_missing, ctes=["m AS (SELECT * FROM bars WHERE close IS NOT NULL)"], source="m")
bar_query("c10_fill_mean", dirty_bars, DIRTY, lambda b: clean.fill_mean(b, ["close"]), {"close": "coalesce(close, avg(close) OVER (PARTITION BY symbol))"}, digits=7)
register(
    "c11_missing_count",
    lambda s, d: clean.missing_count(dirty_bars(s, d)),
    f"WITH {DIRTY} SELECT {', '.join(f'count(*) - count({c}) AS {c}' for c in OHLCV)}, "
    f"{' + '.join(f'count(*) - count({c})' for c in OHLCV)} AS total FROM bars",
)


def _iqr_ctes(k: float, start: str = "bars") -> list[str]:
    out, src = [], start
    for c in ("open", "high", "low", "close"):
        out.append(
            f"q_{c} AS (SELECT *, quantile_cont({c}, 0.25) OVER (PARTITION BY symbol) AS q1, quantile_cont({c}, 0.75) OVER (PARTITION BY symbol) AS q3 FROM {src})"
        )
        out.append(
            f"k_{c} AS (SELECT symbol, ts, open, high, low, close, volume FROM q_{c} "
            f"WHERE coalesce({c} >= q1 - {k} * (q3 - q1) AND {c} <= q3 + {k} * (q3 - q1), true))"
        )
        src = f"k_{c}"
    return out


bar_query("c12_outliers_iqr", supp_bars, SUPP, lambda b: clean.outliers_iqr(b, k=0.5), ctes=_iqr_ctes(0.5), source="k_close")
bar_query(
    "c12_outliers_iqr_large_groups",
    order_bars,
    ORDERS,
    lambda b: clean.outliers_iqr(b, k=0.4, large_groups=True),
    ctes=_iqr_ctes(0.4),
    source="k_close",
)
_Z, _src = [], "bars"
for _c in ("open", "high", "low", "close"):
    _Z += [
        f"z_{_c} AS (SELECT *, abs({_c} - avg({_c}) OVER (PARTITION BY symbol)) / nullif(stddev_samp({_c}) OVER (PARTITION BY symbol), 0) AS z FROM {_src})",
        f"k_{_c} AS (SELECT symbol, ts, open, high, low, close, volume FROM z_{_c} WHERE coalesce(z <= 1.5, true))",
    ]
    _src = f"k_{_c}"
bar_query("c13_outliers_zscore", supp_bars, SUPP, lambda b: clean.outliers_zscore(b, k=1.5), ctes=_Z, source="k_close")
bar_query(
    "c14_range",
    supp_bars,
    SUPP,
    lambda b: clean.in_range(b, 950.0, 1800.0),
    ctes=["m AS (SELECT * FROM bars WHERE " + " AND ".join(f"{c} BETWEEN 950 AND 1800" for c in OHLCV[:4]) + ")"],
    source="m",
)
bar_query(
    "c15_clean_bars",
    dirty_bars,
    DIRTY,
    lambda b: clean.clean_bars(b, k=0.5),
    ctes=[
        f"f AS (SELECT symbol, ts, open, {_HIGH} AS high, {_LOW} AS low, close, greatest(volume, 0) AS volume FROM bars)",
        "p AS (SELECT * FROM f WHERE coalesce(least(open, high, low, close) > 0, true))",
        "ff AS (SELECT symbol, ts, " + ", ".join(f"{x} AS {c}" for c, x in _FF.items()) + " FROM p)",
        *_iqr_ctes(0.5, "ff"),
        "m AS (SELECT * FROM k_close WHERE " + " AND ".join(f"{c} BETWEEN 0.01 AND 1000000" for c in OHLCV[:4]) + ")",
    ],
    source="m",
)
register(
    "c16_exact_quantiles",
    lambda s, d: show(
        exact_quantiles(line_ticks(s, d, "l_returnflag"), "price", (0.05, 0.5, 0.95), leaf=500), ["symbol", "prob"], 6, ["value"]
    ),
    f"WITH {line_ticks_sql('l_returnflag')} SELECT symbol, prob, round(CASE prob WHEN 0.05 THEN quantile_cont(p, 0.05) WHEN 0.5 THEN quantile_cont(p, 0.5) "
    "ELSE quantile_cont(p, 0.95) END, 6) AS value FROM ticks, (SELECT unnest([0.05, 0.5, 0.95])::DOUBLE AS prob) GROUP BY symbol, prob",
)

# --- D: scaling, splits, lags, rolling

PRICES = list(OHLCV[:4])


def _scaled(method):
    return lambda b: scale.scale(b, scale.fit_scaler(b, PRICES, method), PRICES)


def _scaled_sql(offset: str, width: str) -> dict[str, str]:
    return {c: f"({c} - {offset.format(c)}) / nullif({width.format(c)}, 0)" for c in PRICES}


_P = "OVER (PARTITION BY symbol)"
bar_query("d01_standard_scale", supp_bars, SUPP, _scaled("standard"), _scaled_sql(f"avg({{}}) {_P}", f"stddev_pop({{}}) {_P}"))
bar_query("d02_minmax_scale", supp_bars, SUPP, _scaled("minmax"), _scaled_sql(f"min({{}}) {_P}", f"(max({{0}}) {_P} - min({{0}}) {_P})"))
bar_query(
    "d03_robust_scale",
    supp_bars,
    SUPP,
    _scaled("robust"),
    _scaled_sql(f"quantile_cont({{}}, 0.5) {_P}", f"(quantile_cont({{0}}, 0.75) {_P} - quantile_cont({{0}}, 0.25) {_P})"),
)


def _there_and_back(b):
    params = scale.fit_scaler(b, PRICES)
    d = b.select("*", *[F.col(c).alias(f"was_{c}") for c in PRICES])
    d = scale.unscale(scale.scale(d, params, PRICES), params, PRICES)
    return d.select("symbol", "ts", *[(F.abs(F.col(c) - F.col(f"was_{c}")) < 1e-6).cast("int").alias(c) for c in PRICES])


columns_query("d04_unscale", supp_bars, SUPP, _there_and_back, {c: "1" for c in PRICES})


def _train_scaled(b):
    d = scale.split_two(b, 0.2)
    return scale.scale(d, scale.fit_scaler(d.filter("split = 'train'"), ["close", "volume"]), ["close", "volume"])


_RN = f"n AS (SELECT *, row_number() OVER ({KEY}) - 1 AS rn, count(*) OVER (PARTITION BY symbol) AS n FROM bars)"
_TWO = f"{_RN}, s AS (SELECT *, CASE WHEN rn < floor(n * (1.0 - 0.2)) THEN 'train' ELSE 'test' END AS split FROM n)"
_SPLIT_KEYS = ("symbol", "ts", "split")
bar_query(
    "d05_scale_by_train",
    supp_bars,
    SUPP,
    _train_scaled,
    {
        c: f"({c} - avg({c}) FILTER (split = 'train') {_P}) / nullif(stddev_pop({c}) FILTER (split = 'train') {_P}, 0)"
        for c in ("close", "volume")
    },
    ctes=[_TWO],
    source="s",
    keys=_SPLIT_KEYS,
)


def _scaled_sequences(b):
    d = scale.split_two(labels.add_sequences(b, 5, columns=["close", "volume"]), 0.2)
    d = scale.scale_sequences(d, "minmax", train=F.col("split") == "train")
    return d.select("symbol", "ts", "split", F.col("seq")[0]["close"].alias("first_close"), F.col("seq")[4]["volume"].alias("last_volume"))


_SEQ5 = (
    f"q AS (SELECT *, list(close) OVER {w(5)} AS lc, list(volume) OVER {w(5)} AS lv FROM bars), "
    "q5 AS (SELECT * FROM q WHERE len(lc) = 5), "
    f"n AS (SELECT *, row_number() OVER ({KEY}) - 1 AS rn, count(*) OVER (PARTITION BY symbol) AS n FROM q5), "
    "s AS (SELECT *, CASE WHEN rn < floor(n * (1.0 - 0.2)) THEN 'train' ELSE 'test' END AS split FROM n), "
    "t AS (SELECT min(list_min(lc)) AS c0, max(list_max(lc)) AS c1, min(list_min(lv)) AS v0, max(list_max(lv)) AS v1 FROM s WHERE split = 'train'), "
    "m AS (SELECT * FROM s, t)"
)
columns_query(
    "d06_scale_sequences",
    supp_bars,
    SUPP,
    _scaled_sequences,
    {"first_close": "(lc[1] - c0) / (c1 - c0)", "last_volume": "(lv[5] - v0) / (v1 - v0)"},
    ctes=[_SEQ5],
    source="m",
    keys=_SPLIT_KEYS,
)
register(
    "d07_split_three",
    lambda s, d: scale.split(supp_bars(s, d)).select(*_SPLIT_KEYS),
    f"WITH {SUPP}, {_RN} SELECT symbol, ts, CASE WHEN rn < floor(n * 0.7) THEN 'train' WHEN rn < floor(n * 0.7) + floor(n * 0.15) THEN 'val' ELSE 'test' END AS split FROM n",
)
register("d08_split_two", lambda s, d: scale.split_two(supp_bars(s, d)).select(*_SPLIT_KEYS), f"WITH {SUPP}, {_TWO} SELECT symbol, ts, split FROM s")
_LAGS = (1, 3, 7)
bar_query(
    "d09_lags",
    supp_bars,
    SUPP,
    lambda b: scale.add_lags(b, ["close", "volume"], _LAGS),
    {f"{c}_lag_{k}": f"{c}{k}" for c in ("close", "volume") for k in _LAGS},
    raw=[f"{c}_lag_{k}" for c in ("close", "volume") for k in _LAGS],
    ctes=[
        f"a AS (SELECT *, row_number() OVER ({KEY}) AS rn, " + ", ".join(f"{lag(c, k)} AS {c}{k}" for c in ("close", "volume") for k in _LAGS) + " FROM bars)",
        "m AS (SELECT * FROM a WHERE rn > 7)",
    ],
    source="m",
)
_ROLL = {"mean": "avg", "std": "stddev_samp", "min": "min", "max": "max", "median": "median"}
bar_query(
    "d10_rolling",
    supp_bars,
    SUPP,
    lambda b: scale.add_rolling(b, ["volume"], [5, 20], list(_ROLL)),
    {f"volume_{f}_{n}": f"{f}{n}" for f in _ROLL for n in (5, 20)},
    ctes=[
        f"a AS (SELECT *, row_number() OVER ({KEY}) AS rn, " + ", ".join(f"{roll(g, 'volume', n)} AS {f}{n}" for f, g in _ROLL.items() for n in (5, 20)) + " FROM bars)",
        "m AS (SELECT * FROM a WHERE rn >= 20)",
    ],
    source="m",
    digits=5,
)
register(
    "d11_time_folds",
    lambda s, d: scale.time_folds(supp_bars(s, d), 3).select("symbol", "ts", "fold", "role"),
    f"WITH {SUPP}, {_RN}, f AS (SELECT *, unnest([1, 2, 3])::INTEGER AS fold, n // 4 AS size FROM n), "
    "g AS (SELECT *, n - (4 - fold) * size AS st FROM f) "
    "SELECT symbol, ts, fold, CASE WHEN rn < st THEN 'train' ELSE 'test' END AS role FROM g WHERE rn < st + size",
)

# --- E: quality

_JUMP = f"a AS (SELECT *, {lag('close')} AS pb, close / {lag('close')} - 1 AS r FROM bars), j AS (SELECT * FROM a WHERE abs(r) > 0.5)"
register(
    "e01_price_jumps",
    lambda s, d: show(quality.price_jumps(supp_bars(s, d), 0.5), [*KEYS, "direction"], 6, ["price_before", "price_after", "ret", "magnitude"], ["price_before", "price_after"]),
    f"WITH {SUPP}, {_JUMP} SELECT symbol, ts, CASE WHEN r < 0 THEN 'crash' ELSE 'spike' END AS direction, "
    f"{rr(6, ['price_before', 'price_after'], price_before='pb', price_after='close', ret='r', magnitude='abs(r)')} FROM j",
)
_GAPS = f"g AS (SELECT *, {lag('ts')} AS ps, epoch(ts) - epoch({lag('ts')}) AS len FROM bars), h AS (SELECT * FROM g WHERE len > 48 * 3600)"
register(
    "e02_gaps",
    lambda s, d: show(quality.gaps(supp_bars(s, d)), ["symbol", "gap_start", "gap_end", "missing_periods"], 6, ["gap_hours"]),
    f"WITH {SUPP}, {_GAPS} SELECT symbol, ps AS gap_start, ts AS gap_end, CAST(floor(len / 86400) - 1 AS BIGINT) AS missing_periods, round(len / 3600.0, 6) AS gap_hours FROM h",
)
_EXT = (
    "l AS (SELECT symbol, ts, unnest(['high', 'low', 'close']) AS \"column\", unnest([high, low, close]) AS value FROM bars), "
    'z AS (SELECT *, (value - avg(value) OVER (PARTITION BY symbol, "column")) / nullif(stddev_samp(value) OVER (PARTITION BY symbol, "column"), 0) AS z FROM l)'
)
register(
    "e03_extreme_values",
    lambda s, d: show(quality.extreme_values(supp_bars(s, d), 1.8), [*KEYS, "column"], 6, ["value", "z_score", "std_deviation"]),
    f"WITH {SUPP}, {_EXT} SELECT symbol, ts, \"column\", {rr(6, value='value', z_score='abs(z)', std_deviation='z')} FROM z WHERE abs(z) > 1.8",
)
_VOL = f"v AS (SELECT *, {roll('avg', 'volume', 30, 1)} AS av FROM bars), k AS (SELECT *, CASE WHEN volume / av > 2.0 THEN 'spike' WHEN volume < 0.1 * av THEN 'low' END AS kind FROM v)"
register(
    "e04_volume_anomalies",
    lambda s, d: show(quality.volume_anomalies(supp_bars(s, d), 2.0, 0.1), [*KEYS, "kind"], 5, ["volume", "avg_volume", "spike_ratio"]),
    f"WITH {SUPP}, {_VOL} SELECT symbol, ts, kind, {rr(5, volume='volume', avg_volume='av', spike_ratio='volume / av')} FROM k WHERE kind IS NOT NULL",
)
register(
    "e05_low_volume",
    lambda s, d: quality.volume_anomalies(supp_bars(s, d), 2.0, 0.1).filter("kind = 'low'").select(*KEYS),
    f"WITH {SUPP}, {_VOL} SELECT symbol, ts FROM k WHERE kind = 'low'",
)
_AT = "CASE WHEN hi = '{}' THEN mx ELSE mn END"
_DIV = (
    "ns AS (SELECT symbol, count(DISTINCT source) AS n FROM bars GROUP BY 1), "
    "c AS (SELECT symbol, bars.ts AS ts, count(DISTINCT source) AS k, max(close) AS mx, min(close) AS mn, "
    "arg_max(source, close) AS hi FROM bars GROUP BY 1, 2), "
    "d AS (SELECT c.* FROM c JOIN ns USING (symbol) WHERE k = n AND n > 1 AND mx > 0 AND (mx - mn) / mx > 0.05)"
)
register(
    "e06_source_divergence",
    lambda s, d: show(
        quality.source_divergence(source_bars(s, d)).withColumn("s0", F.col("sources")["s0"]).withColumn("s1", F.col("sources")["s1"]),
        KEYS,
        6,
        ["max_price", "min_price", "divergence_pct", "divergence_amount", "s0", "s1"],
    ),
    f"WITH {SOURCES}, {_DIV} SELECT symbol, ts, "
    f"{rr(6, max_price='mx', min_price='mn', divergence_pct='(mx - mn) / mx', divergence_amount='mx - mn')}, "
    f"{rr(6, s0=_AT.format('s0'), s1=_AT.format('s1'))} FROM d",
)
_AS_OF = "2024-02-01 00:00:00"
register(
    "e07_freshness",
    lambda s, d: show(quality.freshness(hour_bars(s, d), F.lit(_AS_OF).cast("timestamp")), ["symbol", "latest", "is_fresh"], 6, ["age_hours"]),
    f"WITH {HOUR} SELECT symbol, max(ts) AS latest, (epoch(TIMESTAMP '{_AS_OF}') - epoch(max(ts))) / 3600.0 <= 48 AS is_fresh, "
    f"round((epoch(TIMESTAMP '{_AS_OF}') - epoch(max(ts))) / 3600.0, 6) AS age_hours FROM bars GROUP BY 1",
)
register(
    "e08_issue_counts",
    lambda s, d: quality.issue_counts(
        supp_bars(s, d), F.lit("2001-11-05 00:00:00").cast("timestamp"), jump=0.5, z_limit=1.8, spike=2.0, max_age_hours=72.0
    ),
    f"WITH {SUPP}, {_JUMP}, {_GAPS}, {_EXT}, v AS (SELECT *, {roll('avg', 'volume', 30, 1)} AS av FROM bars), "
    "i AS (SELECT 'flash_crashes' AS c FROM j UNION ALL SELECT 'data_gaps' FROM h UNION ALL SELECT 'extreme_outliers' FROM z WHERE abs(z) > 1.8 "
    "UNION ALL SELECT 'volume_anomalies' FROM v WHERE volume / av > 2.0 OR volume < 0.01 * av "
    "UNION ALL SELECT 'data_freshness' FROM bars GROUP BY symbol HAVING epoch(TIMESTAMP '2001-11-05') - epoch(max(ts)) > 72 * 3600) "
    'SELECT c AS "check", count(*) AS issues FROM i GROUP BY ROLLUP (c)',
)

# --- J: labels and sequences

_FUT = f"(lead(close, 5) OVER ({KEY}) / close - 1)"
bar_query("j01_forward_return", supp_bars, SUPP, lambda b: labels.add_labels(b, 5), {"future_return_5d": _FUT})
bar_query("j02_direction", supp_bars, SUPP, lambda b: labels.add_labels(b, 5), {"direction": f"CAST({_FUT} > 0 AS INTEGER)"})
bar_query("j03_profitable", supp_bars, SUPP, lambda b: labels.add_labels(b, 5, cost=0.1), {"profitable_trade": f"CAST({_FUT} > 0.1 AS INTEGER)"})
register(
    "j04_label_distribution",
    lambda s, d: show(labels.label_distribution(labels.add_labels(supp_bars(s, d), 5), "direction"), ["symbol", "direction", "n"], 6, ["share"]),
    f"WITH {SUPP}, a AS (SELECT *, CAST({_FUT} > 0 AS INTEGER) AS direction FROM bars) SELECT symbol, direction, count(*) AS n, "
    "round(count(*) / sum(count(*)) OVER (PARTITION BY symbol), 6) AS share FROM a WHERE direction IS NOT NULL GROUP BY 1, 2",
)


def _sequence_digest(d, seq="seq"):
    """Fixed-width view of the arrays: position-weighted sums tell the order apart."""
    last = F.element_at(seq, -1)
    return d.withColumns(
        {
            "n_steps": F.size(seq),
            "first_open": F.col(seq)[0]["open"],
            "last_close": last["close"],
            "weighted": F.aggregate(
                F.transform(seq, lambda e, i: e["close"] * (i + 1)), F.lit(0.0), lambda a, x: a + x
            ),
        }
    )


def _seq_sql(n: int, pad: int = 0) -> dict[str, str]:
    return {
        "n_steps": str(n),
        "first_open": f"lo[{1 + pad}]",
        "last_close": f"lc[{n + pad}]",
        "weighted": f"list_sum(list_transform(lc[{1 + pad}:{n + pad}], lambda x, i: x * i))",
    }


_RAW = ("first_open", "last_close", "target")
_LISTS = f"a AS (SELECT *, list(open) OVER {w(20)} AS lo, list(close) OVER {w(20)} AS lc, lead(close, 5) OVER ({KEY}) AS t5, lead(close, 1) OVER ({KEY}) AS t1 FROM bars)"
columns_query(
    "j05_sequences",
    supp_bars,
    SUPP,
    lambda b: _sequence_digest(labels.add_sequences(b, 20, target="close", offset=5)),
    _seq_sql(20) | {"target": "t5"},
    ctes=[_LISTS, "m AS (SELECT * FROM a WHERE len(lc) = 20 AND t5 IS NOT NULL)"],
    source="m",
    digits=3,
    raw=_RAW,
)
columns_query(
    "j06_raw_sequences",
    supp_bars,
    SUPP,
    lambda b: _sequence_digest(labels.add_sequences(b, 20)),
    _seq_sql(20),
    ctes=[_LISTS, "m AS (SELECT * FROM a WHERE len(lc) = 20)"],
    source="m",
    digits=3,
    raw=_RAW,
)
columns_query(
    "j07_next_step",
    supp_bars,
    SUPP,
    lambda b: _sequence_digest(labels.next_step_sequences(b, 20)),
    _seq_sql(20) | {"target": "t1"},
    ctes=[_LISTS, "m AS (SELECT * FROM a WHERE len(lc) = 20 AND t1 IS NOT NULL)"],
    source="m",
    digits=3,
    raw=_RAW,
)
columns_query(
    "j08_multiscale",
    supp_bars,
    SUPP,
    lambda b: _sequence_digest(labels.multiscale_sequences(b, (5, 14, 20)), "seq_5"),
    _seq_sql(5, pad=15),
    ctes=[_LISTS, "m AS (SELECT * FROM a WHERE len(lc) = 20)"],
    source="m",
    digits=3,
    raw=_RAW,
)
