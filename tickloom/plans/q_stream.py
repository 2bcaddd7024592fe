"""Registered queries: streams over the supplied events, replayed from files until nothing is left."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import indicators, labels, models
from ..operators.series import rolling
from ..streaming import bars as st, online
from .catalog import lag, register, roll, rr, show, so_far
from .fixtures import EVENT_TICKS_SQL, HOUR, SUPP, hour_bars, supp_bars, table
from .q_features import N, ewm_ctes

KEYS = ("symbol", "ts")


def events_stream(s, d):
    schema = table(s, d, "events").schema
    ev = st.file_stream(s, d, schema, pattern="events.parquet")
    return ev.select("event_id", F.col("event_type").alias("symbol"), "ts", F.col("value").alias("price"), F.lit(1.0).alias("size"))


def event_table(s, d):
    ev = table(s, d, "events")
    return ev.select("event_id", F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("price"), F.lit(1.0).alias("size"))


def closed(make, stream, name, feed=()):
    """Run an operator over a stream and close the stream, so that nothing waits any more."""
    stream, folder = st.closing(stream)
    return st.run(make(stream), name, feed=feed, close=folder)


def ntz(df):
    return df.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


_OHLC = ("open", "high", "low", "close", "volume")
_DAY = f"{EVENT_TICKS_SQL}, bars AS (SELECT symbol, date_trunc('day', ts)::TIMESTAMP AS ts, arg_min(p, k) AS open, max(p) AS high, min(p) AS low, arg_max(p, k) AS close, sum(q) AS volume FROM ticks GROUP BY ALL)"
register(
    "t01_stream_bars",
    lambda s, d: show(ntz(closed(lambda e: st.stream_bars(e, order=["event_id"]), events_stream(s, d), "bars")), KEYS, 6, _OHLC, _OHLC),
    f"WITH {_DAY} SELECT symbol, ts, {rr(6, _OHLC, **{c: c for c in _OHLC})} FROM bars",
)
# without the closing row: bars are held back until the watermark passes their end
_OPEN = " WHERE ts + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR"
register(
    "t01_stream_bars_open",
    lambda s, d: show(ntz(st.run(st.stream_bars(events_stream(s, d), order=["event_id"]), "bars")), KEYS, 6, _OHLC, _OHLC),
    f"WITH {_DAY} SELECT symbol, ts, {rr(6, _OHLC, **{c: c for c in _OHLC})} FROM bars{_OPEN}",
)
_SLIDE = (
    f"{EVENT_TICKS_SQL}, sl AS (SELECT symbol, unnest([date_trunc('day', ts), date_trunc('day', ts) + INTERVAL 12 HOUR, date_trunc('day', ts) - INTERVAL 12 HOUR]) AS st, ts AS t, p, q, k FROM ticks), "
    "bars AS (SELECT symbol, st::TIMESTAMP AS ts, arg_min(p, k) AS open, max(p) AS high, min(p) AS low, arg_max(p, k) AS close, sum(q) AS volume FROM sl "
    "WHERE t >= st AND t < st + INTERVAL 24 HOUR GROUP BY 1, 2)"
)
register(
    "t01_stream_sliding_bars",
    lambda s, d: show(ntz(closed(lambda e: st.stream_bars(e, slide="12 hours", order=["event_id"]), events_stream(s, d), "bars")), KEYS, 6, _OHLC, _OHLC),
    f"WITH {_SLIDE} SELECT symbol, ts, {rr(6, _OHLC, **{c: c for c in _OHLC})} FROM bars",
)
_SESSIONS = (
    f"{EVENT_TICKS_SQL}, g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 45 MINUTES THEN 0 ELSE 1 END AS st FROM ticks WINDOW w AS (PARTITION BY symbol ORDER BY ts)), "
    "i AS (SELECT *, sum(st) OVER (PARTITION BY symbol ORDER BY ts) AS id FROM g), "
    "ses AS (SELECT symbol, min(ts)::TIMESTAMP AS ts, (max(ts) + INTERVAL 45 MINUTES)::TIMESTAMP AS \"end\", count(*) AS ticks, arg_min(p, k) AS open, max(p) AS high, min(p) AS low, "
    "arg_max(p, k) AS close, sum(q) AS volume FROM i GROUP BY symbol, id)"
)
_SESSION_SQL = f"WITH {_SESSIONS} SELECT symbol, ts, \"end\", ticks, {rr(6, _OHLC, **{c: c for c in _OHLC})} FROM ses"


def _sessions(df):
    d = ntz(df).withColumn("end", F.col("end").cast("timestamp_ntz"))
    return show(d, [*KEYS, "end", "ticks"], 6, _OHLC, _OHLC)


register("t02_stream_sessions", lambda s, d: _sessions(closed(lambda e: st.stream_sessions(e, "45 minutes", order=["event_id"]), events_stream(s, d), "sessions")), _SESSION_SQL)
register("t02_batch_sessions", lambda s, d: _sessions(st.stream_sessions(event_table(s, d), "45 minutes", order=["event_id"])), _SESSION_SQL)
register(
    "t03_stream_dedup",
    lambda s, d: ntz(st.run(st.stream_dedup(events_stream(s, d).union(events_stream(s, d)), ["event_id"]), "dedup")).select("event_id", *KEYS),
    "SELECT event_id, event_type AS symbol, ts FROM events",
)


def _online(make, name):
    """Bars in three parts; a third of them comes one part late, but within the delay, so no part is in order."""

    def run(s, d):
        hours = hour_bars(s, d)
        span = F.unix_micros(F.col("ts").cast("timestamp"))
        first, last = hours.agg(F.min(span), F.max(span)).first()
        part = F.floor((span - first) / max((last - first + 1) / 3, 1))
        late = F.xxhash64("symbol", "ts") % 3 == 0
        fed = st.replay(hours, part=F.least(part + late.cast("int"), F.lit(2)))
        with online.rocksdb_state(s):
            return ntz(closed(make, st.file_stream(s, fed.path, fed.schema), name, fed.feed))

    return run


#: A part of the replay covers ten days; bars may come one part late.
DELAY = "12 days"


def _chained(make, name):
    """Events to hourly bars to state in one job."""

    def run(s, d):
        with online.rocksdb_state(s):
            return ntz(closed(lambda e: make(st.stream_bars(e, interval="1 hour", order=["event_id"])), events_stream(s, d), name))

    return run


_TR = f"greatest(high - low, abs(high - {lag('close')}), abs(low - {lag('close')}))"
_IND = (
    f"n {N}, v AS (SELECT *, greatest(close - {lag('close')}, 0) AS g, greatest({lag('close')} - close, 0) AS l, {_TR} AS tr FROM n), "
    + ", ".join(ewm_ctes("e", "v", {"em": ("s.close", 2.0 / 21.0), "eg": ("s.g", 1 / 14.0), "el": ("s.l", 1 / 14.0), "ea": ("s.tr", 1 / 14.0)}))
)
_IND_SQL = (
    f"WITH RECURSIVE {HOUR}, {_IND} SELECT symbol, ts, CASE WHEN rn < 20 THEN 0 WHEN close > em THEN 1 WHEN close < em THEN -1 ELSE 0 END AS signal, "
    + rr(5, ema="CASE WHEN rn >= 20 THEN em END", rsi="CASE WHEN rn >= 14 THEN CASE WHEN el = 0 THEN 100 ELSE 100 * eg / (eg + el) END END", atr="CASE WHEN rn >= 14 THEN ea END")
    + " FROM e"
)
register(
    "t04_online_indicators",
    lambda s, d: show(_online(lambda b: online.online_indicators(b, delay=DELAY), "indicators")(s, d), [*KEYS, "signal"], 5, ["ema", "rsi", "atr"]),
    _IND_SQL,
)
register(
    "t04_ticks_to_indicators",
    lambda s, d: show(_chained(lambda b: online.online_indicators(b, delay=None), "indicators")(s, d), [*KEYS, "signal"], 5, ["ema", "rsi", "atr"]),
    _IND_SQL,
)
register(
    "t05_online_drawdown",
    lambda s, d: show(_online(lambda b: online.online_drawdown(b, 0.5, delay=DELAY), "drawdown")(s, d), [*KEYS, "alarm"], 6, ["peak", "drawdown"], ["peak"]),
    f"WITH {HOUR}, p AS (SELECT *, {so_far('max(close)')} AS pk FROM bars) SELECT symbol, ts, (close - pk) / pk < -0.5 AS alarm, {rr(6, ['peak'], peak='pk', drawdown='(close - pk) / pk')} FROM p",
)
_STALE = (
    f"WITH {HOUR}, p AS (SELECT *, close / {lag('close')} - 1 AS r, (epoch(ts) - epoch({lag('ts')})) / 3600.0 AS g, lead(ts) OVER (PARTITION BY symbol ORDER BY ts) AS nx FROM bars) "
    "SELECT symbol, ts, 'jump' AS alert, round(r, 6) AS value FROM p WHERE abs(r) > 2.0 UNION ALL SELECT symbol, ts, 'gap', round(g, 6) FROM p WHERE g > 2"
)
register(
    "t06_online_alerts",
    lambda s, d: show(_online(lambda b: online.online_alerts(b, 2.0, 2.0, 6.0, delay=DELAY), "alerts")(s, d), [*KEYS, "alert"], 6, ["value"]).filter("alert <> 'stale'"),
    _STALE,
)
# all alerts: once the stream is closed every series is silent after its last bar
register(
    "t06_online_all_alerts",
    lambda s, d: show(_online(lambda b: online.online_alerts(b, 2.0, 2.0, 6.0, delay=DELAY), "alerts")(s, d), [*KEYS, "alert"], 6, ["value"]),
    _STALE + " UNION ALL SELECT symbol, ts + INTERVAL 6 HOURS, 'stale', 6.0 FROM p WHERE nx IS NULL",
)

_X = ("open_close_ratio", "high_low_ratio")


def _scoring(s, d):
    b = labels.add_labels(indicators.add_features(hour_bars(s, d), "price_ratios"), 1).select(*KEYS, *_X, "direction")
    fitted = models.train_models(models.training_rows(b, _X, "direction"), _X, "direction", {"linear": {"maxIter": 10}})
    fed = st.replay(b)
    scored = st.run_scoring(st.file_stream(s, fed.path, fed.schema), fitted, feed=fed.feed)
    return ntz(scored).select(*KEYS, "pred_linear", "prob_linear")


register("t07_scoring_sink", _scoring)


def _limits(s, d):
    e = table(s, d, "events")
    return e.groupBy(F.col("event_type").alias("symbol")).agg((F.avg("value") * 1.8).alias("high_limit"), (F.avg("value") * 0.1).alias("low_limit"))


register(
    "t08_stream_static_limits",
    lambda s, d: ntz(st.run(st.stream_limits(events_stream(s, d), _limits(s, d)).select("event_id", *KEYS, "breach"), "limits")),
    "WITH l AS (SELECT event_type, avg(value) * 1.8 AS hi, avg(value) * 0.1 AS lo FROM events GROUP BY 1) "
    "SELECT event_id, event_type AS symbol, ts, CASE WHEN value > hi THEN 'high' ELSE 'low' END AS breach FROM events JOIN l USING (event_type) WHERE value > hi OR value < lo",
)


def _vector(s, d):
    b = rolling(
        supp_bars(s, d),
        lambda w: {
            "_r": w.change("close"),
            "volume_ratio": F.try_divide(F.col("volume"), w.roll(F.avg, "volume", 20)) - 1,
            "sma_distance": F.try_divide(F.col("close"), w.roll(F.avg, "close", 20)) - 1,
        },
        lambda w: {"volatility": w.roll(F.stddev_samp, "_r", 20)},
        before=20,
    )
    b = b.withColumns({"body": F.col("close") / F.col("open") - 1, "range": F.col("high") / F.col("low") - 1})
    last = b.groupBy("symbol").agg(F.max("ts").alias("ts"), F.max_by(F.struct("close", "body", "range", "volume_ratio", "sma_distance", "volatility"), "ts").alias("_v"))
    return last.select("symbol", "ts", "_v.*")


register(
    "t09_last_bar_features",
    lambda s, d: show(_vector(s, d), KEYS, 6, ["close", "body", "range", "volume_ratio", "sma_distance", "volatility"], ["close"]),
    f"WITH {SUPP}, r AS (SELECT *, close / {lag('close')} - 1 AS r1, {roll('avg', 'volume', 20)} AS mv, {roll('avg', 'close', 20)} AS mc, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS k FROM bars), "
    f"v AS (SELECT *, {roll('stddev_samp', 'r1', 20)} AS sd FROM r) SELECT symbol, ts, "
    + rr(6, ["close"], close="close", body="close / open - 1", range="high / low - 1", volume_ratio="volume / mv - 1", sma_distance="close / mc - 1", volatility="sd")
    + " FROM v WHERE k = 1",
)
