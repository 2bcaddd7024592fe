"""Positions, trades and equity as table operators (long or flat; shorts are not opened)."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions.columns import div, exp_in_range, share
from ..session import stage
from .series import Blocks, By, _carries, cut_long, prepared, rolling, running, staged

FRACTION = 0.95


def positions(
    signals: DataFrame,
    *,
    exit_on_zero: bool = False,
    by: By = ("symbol",),
    ts: str = "ts",
    blocks: Blocks | None = None,
) -> DataFrame:
    """Position after each bar: a buy opens, a sell closes, 0 keeps it (``exit_on_zero``: 0 closes, for 0/1 signals)."""
    s = F.col("signal")
    if exit_on_zero:
        return signals.withColumn("position", (F.coalesce(s, F.lit(0)) > 0).cast("int"))
    d = running(signals, {"_last": ("last", F.when(s != 0, s))}, by=by, ts=ts, blocks=blocks)
    return d.withColumn("position", F.when(F.col("_last") > 0, 1).otherwise(0)).drop("_last")


def slipped(price: Column, side: Column, slippage: float) -> Column:
    """Adverse fixed slippage: buys pay more, sells get less."""
    return price * (1.0 + F.when(side == "buy", slippage).otherwise(-slippage))


def equity_curve(
    bars: DataFrame,
    *,
    capital: float = 10_000.0,
    fraction: float = FRACTION,
    commission: float = 0.001,
    slippage: float = 0.0,
    by: By = ("symbol",),
    ts: str = "ts",
    blocks: Blocks | None = None,
) -> DataFrame:
    """Trades and equity of a ``position`` column: adds side, fill_price, quantity, commission, value, trip, equity, log_equity, ret.

    A trip that starts with equity V and buys fraction f at P0 is worth V * (1 - f*(1+c) + f*P/P0) while open
    and V * (1 - f*(1+c) + f*(1-c)*P1/P0) once closed at P1, so equity is a running product of the factors of
    closed trips times the factor of the open one. Three window passes over one sort; no row loop. The product runs in logarithms:
    ``log_equity`` and ``ret`` are known over any number of trips, amounts are NULL where they are beyond the range of a double.
    A buy that costs more than the cash (f*(1+c) > 1) is never filled.
    """
    f, c = fraction, commission
    d = prepared(bars, by, ts, blocks)
    if f * (1.0 + c) > 1.0:
        d = d.withColumn("position", F.lit(0))
    d = rolling(d, lambda w: {"prev_": w.lag("position", 1, 0)}, before=1, by=by, ts=ts, blocks=blocks)
    enter = (F.col("position") == 1) & (F.col("prev_") == 0)
    leave = (F.col("position") == 0) & (F.col("prev_") == 1)
    d = d.withColumn("side", F.when(enter, "buy").when(leave, "sell"))
    d = d.withColumn("fill_price", F.when(F.col("side").isNotNull(), slipped(F.col("close"), F.col("side"), slippage)))
    d = running(
        d,
        {
            "p0_": ("last", F.when(F.col("side") == "buy", F.col("fill_price"))),
            "trip": ("sum", (F.col("side") == "buy").cast("long")),
        },
        by=by,
        ts=ts,
        blocks=blocks,
    )
    d = staged(d, blocks)
    gain = F.when(
        F.col("side") == "sell", 1.0 - f * (1.0 + c) + f * (1.0 - c) * F.col("fill_price") / F.col("p0_")
    ).otherwise(1.0)
    d = staged(running(d, {"closed_": ("sum", F.log(gain))}, by=by, ts=ts, blocks=blocks), blocks)
    worth = math.log(capital) + F.col("closed_")
    d = running(
        d,
        {"q_": ("last", F.when(F.col("side") == "buy", exp_in_range(worth) * f / F.col("fill_price")))},
        by=by,
        ts=ts,
        blocks=blocks,
    )
    open_factor = F.when(F.col("position") == 1, 1.0 - f * (1.0 + c) + f * F.col("close") / F.col("p0_")).otherwise(1.0)
    traded = F.col("side").isNotNull()
    d = d.withColumns(
        {
            "log_equity": worth + F.log(open_factor),
            "equity": exp_in_range(worth) * open_factor,
            "quantity": F.when(traded, F.col("q_")),
            "value": F.when(traded, F.col("q_") * F.col("fill_price")),
            "commission": F.when(traded, F.col("q_") * F.col("fill_price") * c),
            "trip": F.coalesce("trip", F.lit(0).cast("long")),
        }
    )
    d = rolling(d, lambda w: {"ret": F.expm1(F.col("log_equity") - w.lag("log_equity"))}, before=1, by=by, ts=ts, blocks=blocks)
    return d.drop("prev_", "p0_", "closed_", "q_", "_rn", "_blk")


def trade_list(equity: DataFrame, *, by: By = ("symbol",), ts: str = "ts") -> DataFrame:
    """Entry and exit rows."""
    return equity.filter(F.col("side").isNotNull()).select(
        *by, ts, "trip", "side", "quantity", F.col("fill_price").alias("price"), "commission", "value"
    )


def round_trips(trades: DataFrame, *, by: By = ("symbol",), ts: str = "ts") -> DataFrame:
    """Closed trips: one aggregate over (series, trip), each of which has two rows."""
    buy, sell = F.col("side") == "buy", F.col("side") == "sell"

    def at(side: Column, c: str) -> Column:
        return F.max(F.when(side, F.col(c)))

    d = trades.groupBy(*by, "trip").agg(
        at(buy, ts).alias("entry_time"),
        at(sell, ts).alias("exit_time"),
        at(buy, "price").alias("entry_price"),
        at(sell, "price").alias("exit_price"),
        at(sell, "quantity").alias("quantity"),
        at(sell, "commission").alias("_c"),
    )
    d = d.filter(F.col("exit_time").isNotNull() & F.col("entry_time").isNotNull())
    hours = (F.unix_seconds(F.col("exit_time").cast("timestamp")) - F.unix_seconds(F.col("entry_time").cast("timestamp"))) / 3_600.0
    move = F.col("exit_price") - F.col("entry_price")
    return d.select(
        *by,
        "trip",
        "entry_time",
        "exit_time",
        "entry_price",
        "exit_price",
        "quantity",
        (move * F.col("quantity") - F.col("_c")).alias("pnl"),
        hours.alias("duration_hours"),
        div(move, F.col("entry_price")).alias("return_pct"),
    )


def round_trip_summary(trips: DataFrame, *, by: By = ("symbol",)) -> DataFrame:
    pnl = F.col("pnl")
    return trips.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_round_trips"),
        F.count_if(pnl > 0).alias("profitable_trades"),
        F.count_if(pnl < 0).alias("losing_trades"),
        F.avg(pnl).alias("avg_trade_pnl"),
        F.avg("return_pct").alias("avg_trade_return"),
        F.avg("duration_hours").alias("avg_trade_duration"),
        F.max(pnl).alias("best_trade"),
        F.min(pnl).alias("worst_trade"),
        share(pnl > 0).alias("win_rate"),
    )


def buy_and_hold(bars: DataFrame, *, ppy: int = 252, rf: float = 0.02, by: By = ("symbol",), ts: str = "ts") -> DataFrame:
    """Return of holding each series, with the Sharpe ratio and share of winning bars of its returns."""
    d = rolling(bars, lambda w: {"ret": w.change("close")}, before=1, by=by, ts=ts)
    std = F.stddev_samp("ret")
    return d.groupBy(*by).agg(
        (div(F.max_by("close", ts), F.min_by("close", ts)) - 1).alias("total_return"),
        F.when(std > 0, (F.avg("ret") - rf / ppy) / F.nullif(std, F.lit(0.0)) * (ppy**0.5)).otherwise(0.0).alias("sharpe_ratio"),
        share(F.col("ret") > 0).alias("win_rate"),
        F.count(F.lit(1)).alias("bars"),
    )


def _account(state: tuple, rows: Iterable[tuple]) -> tuple[tuple, list[tuple]]:
    """Walks an account over trades (signed quantity, worth of a buy, cash flow, whether a buy) from ``state``: the state after, and what each trade leaves.

    The state is (running quantity, its minimum, cash flow, holding, cost basis, basis of an empty holding included, its factor on the first one).
    """
    s, low, cash, held, cost, basis, factor = state
    out = []
    for x, worth, flow, buy in rows:
        before, start = cost, held
        if x is not None:
            s = x if s is None else s + x
            if low is None or s < low:
                low = s
        holding = None if s is None else s - low if low < 0 else s
        if start == 0:  # a new lot
            basis = factor = 0.0
        open_ = holding is not None and holding > 0
        if buy:
            if worth is not None:
                basis += worth
        elif open_ and start:
            basis *= holding / start
            factor *= holding / start
        cost = basis if open_ else 0.0
        if flow is not None:
            cash = flow if cash is None else cash + flow
        held = holding
        out.append((holding, cost, before / start if start else 0.0, cash))
    return (s, low, cash, held, cost, basis, factor), out


#: Of a walk: what it adds to each trade, and what it leaves of each block.
_LEFT = ("holding", "cost_", "entry_", "cash")
_ENDS = ("s_", "low_", "sum_", "_p_y", "_s_y")
_ENTRY = ("e_s", "e_low", "e_cash", "e_y")


def _walked(d: DataFrame, by: By, ts: str, ends: bool = False) -> DataFrame:
    """Accounts of the trades of each block, walked in order by one task, a batch at a time; a task holds the state of one account.

    ``ends``: one row a block. A block other than the first goes on from the columns ``_ENTRY`` where the trades have them.
    """
    entered, kept = "e_s" in d.columns, [c for c in d.columns if c not in _ENTRY]
    key = [*by, "_blk"]
    d = d.repartition(*key).sortWithinPartitions(*key, ts)
    buy, sign = F.coalesce(F.col("side") == "buy", F.lit(False)), F.when(F.col("side") == "buy", 1.0).otherwise(-1.0)
    x = (sign * F.col("quantity")).cast("double")
    d = d.select(
        *(key if ends else kept),
        *(_ENTRY if entered else ()),
        x.alias("x_"),
        (F.col("quantity") * F.col("price")).cast("double").alias("worth_"),
        (-x * F.col("price") - F.col("commission")).cast("double").alias("flow_"),
        buy.alias("buy_"),
    )
    kinds = d.select(*(key if ends else kept)).schema
    added = _ENDS if ends else _LEFT
    schema = StructType([*(f for f in kinds if f.name not in added), *(StructField(c, DoubleType()) for c in added)])
    names = [f.name for f in kinds if f.name not in added]

    def entry(b: pa.RecordBatch, i: int) -> tuple:
        if not entered or not b["_blk"][i].as_py():
            return None, None, None, 0.0, 0.0, 0.0, 1.0
        s, low, cash, y = (b[c][i].as_py() for c in _ENTRY)
        holding = None if s is None else s - min(low, 0.0)
        y = y or 0.0
        return s, low, cash, holding, y if holding is not None and holding > 0 else 0.0, y, 1.0

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state, done, types = None, None, [], {}
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            new = np.zeros(n, bool)
            for c in key:
                new[1:] |= pc.not_equal(b[c].slice(1), b[c].slice(0, n - 1)).to_numpy(zero_copy_only=False)
            edges = [0, *np.flatnonzero(new).tolist(), n]
            rows = list(zip(*(b[c].to_pylist() for c in ("x_", "worth_", "flow_", "buy_"))))
            left = []
            for i, j in zip(edges, edges[1:]):
                here = tuple(b[c][i].as_py() for c in key)
                if here != at:
                    if at is not None:
                        done.append((*at, *state[:3], state[6], state[5]))
                    at, state = here, entry(b, i)
                state, more = _account(state, rows[i:j])
                left += more
            if ends:
                types = {c: b.schema.field(c).type for c in key}
            else:
                columns = [pa.array(v, pa.float64()) for v in zip(*left)]
                yield pa.RecordBatch.from_arrays([*(b[c] for c in names), *columns], names=[*names, *added])
        if ends and at is not None:
            done.append((*at, *state[:3], state[6], state[5]))
            kinds = [*types.values(), *[pa.float64()] * len(added)]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*done), kinds)], names=[*key, *added])

    return d.mapInArrow(run, schema)


def _entries(long: DataFrame, by: By, ts: str) -> DataFrame:
    """The state (``_ENTRY``) in which each block of long accounts is entered: first their quantities and cash, then, as these are known, the basis."""
    earlier = Window.partitionBy(*by).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    ends = stage(_walked(long, by, ts, ends=True), "ends")
    d = ends.withColumns({"e_s": F.sum("s_").over(earlier), "e_cash": F.sum("sum_").over(earlier)})
    reached = F.coalesce(F.col("e_s") + F.col("low_"), F.col("low_"))
    d = d.withColumn("low_", reached).select(*by, "_blk", "e_s", F.min("low_").over(earlier).alias("e_low"), "e_cash")
    d = stage(d.withColumn("e_y", F.lit(None).cast("double")), "entries")
    again = long.join(d, [*by, "_blk"])
    maps = stage(_walked(again, by, ts, ends=True).withColumn("_tile", F.col("_blk")).select(*by, "_tile", "_p_y", "_s_y"), "maps")
    carried = _carries(maps, by, ["y"], 2).select(*by, F.col("_tile").alias("_blk"), F.col("_y_y").alias("e_y"))
    return stage(d.drop("e_y").join(carried, [*by, "_blk"]).select(*by, "_blk", *_ENTRY), "entries")


def trade_ledger(
    trades: DataFrame,
    *,
    capital: float = 10_000.0,
    by: By = ("symbol",),
    ts: str = "ts",
    blocks: Blocks | None = None,
) -> DataFrame:
    """Holdings, average entry price, realised PnL and cash after each trade, partial sells included.

    Holdings are the running signed quantity, reflected at 0 (a position cannot go negative). The cost basis
    grows by each buy and shrinks in proportion at each sell, a recurrence with known coefficients, and
    restarts whenever the holdings were 0. Trades move once, to where their account is walked in order. With ``blocks``
    accounts of more rows are cut: their blocks are walked for what they do to any state, and then go on from the state they are entered in.
    Trades of no account (``by`` is NULL) are left out, with ``blocks`` also those without bucket.
    """
    if blocks is None:
        d = trades.dropna(subset=[*by]).withColumn("_blk", F.lit(0).cast("long"))
    else:
        d, long = cut_long(trades, by, blocks)
        if long is not None:
            d = d.join(_entries(long, by, ts), [*by, "_blk"], "left")
    d = _walked(d.select(*trades.columns, "_blk", *[c for c in _ENTRY if c in d.columns]), by, ts)
    sold = (F.col("price") - F.col("entry_")) * F.col("quantity") - F.col("commission")
    return d.select(
        *trades.columns,
        (capital + F.col("cash")).alias("cash"),
        "holding",
        div(F.col("cost_"), F.col("holding")).alias("avg_price"),
        F.when(F.col("side") != "buy", sold).otherwise(0.0).alias("realised_pnl"),
    )


def mark_to_market(ledger: DataFrame, bars: DataFrame, *, by: By = ("symbol",), ts: str = "ts") -> DataFrame:
    """Open positions at the latest price of their series."""
    last = ledger.groupBy(*by).agg(
        F.max_by("holding", ts).alias("quantity"), F.max_by("avg_price", ts).alias("avg_price"), F.max_by("cash", ts).alias("cash")
    )
    price = bars.groupBy(*by).agg(F.max_by("close", ts).alias("current_price"))
    value = F.col("quantity") * F.col("current_price")
    return last.join(price, [*by]).select(
        *by,
        "quantity",
        "avg_price",
        "current_price",
        value.alias("market_value"),
        F.when(F.col("quantity") > 0, (F.col("current_price") - F.col("avg_price")) * F.col("quantity")).otherwise(0.0).alias("unrealised_pnl"),
        (F.col("cash") + value).alias("total_value"),
    )


def fill_orders(orders: DataFrame, bars: DataFrame, *, by: By = ("symbol",), ts: str = "ts") -> DataFrame:
    """Price at which each order fills on the bar of its time (NULL: it does not).

    Market orders fill at the close; limit orders at their limit when the close is at least as good; stop
    orders at the close once it is through the stop.
    """
    d = orders.join(bars.select(*by, ts, "close"), [*by, ts], "left")
    p, buy, kind = F.col("close"), F.col("side") == "buy", F.col("type")
    limit, stop = F.col("limit_price"), F.col("stop_price")
    fill = (
        F.when(kind == "market", p)
        .when((kind == "limit") & F.when(buy, p <= limit).otherwise(p >= limit), limit)
        .when((kind == "stop") & F.when(buy, p >= stop).otherwise(p <= stop), p)
    )
    return d.withColumn("fill_price", fill).drop("close")


class Book:
    """Orders of a series that wait for a price: two heaps, the next to be reached on top."""

    def __init__(self) -> None:
        self.up: list[tuple] = []  # waits for a close of at least the price
        self.down: list[tuple] = []  # waits for a close of at most the price: negated
        self.market: list[dict] = []
        self.n = 0

    def add(self, order: dict) -> bool:
        """False if the order can never fill: its price is missing."""
        buy, kind = order["side"] == "buy", order["type"]
        if kind == "market":
            self.market.append(order)
            return True
        price = order["limit_price"] if kind == "limit" else order["stop_price"] if kind == "stop" else None
        if price is None:
            return False
        self.n += 1
        up = buy == (kind == "stop")
        heapq.heappush(self.up if up else self.down, (price if up else -price, self.n, order))
        return True

    def fill(self, close: float) -> Iterator[tuple[dict, float]]:
        """The orders that a bar fills, and their prices: limits at the limit, the others at the close."""
        yield from ((o, close) for o in self.market)
        self.market = []
        for heap, level in ((self.up, close), (self.down, -close)):
            while heap and heap[0][0] <= level:
                order = heapq.heappop(heap)[2]
                yield order, order["limit_price"] if order["type"] == "limit" else close

    def rest(self) -> list[dict]:
        return [*self.market, *(x[2] for x in (*self.up, *self.down))]


def fill_resting(orders: DataFrame, bars: DataFrame, *, by: By = ("symbol",), ts: str = "ts") -> DataFrame:
    """Orders that rest until a bar reaches them: adds ``fill_ts`` and ``fill_price`` (NULL: never filled).

    The first bar from the order's time on whose close satisfies ``fill_orders``' rules fills it. Orders and bars of a series are
    swept once in order of time, with a book of the waiting orders: no order meets a bar that does not fill it. A task holds the open
    orders of one series, not its bars or its filled orders.
    """
    kinds, given = orders.schema, orders.columns
    out = StructType([*kinds, StructField("fill_ts", kinds[ts].dataType), StructField("fill_price", DoubleType())])
    ticks = bars.filter(F.col("close").isNotNull()).select(
        *[F.col(c).cast(kinds[c].dataType).alias(c) if c in (*by, ts) else F.lit(None).cast(kinds[c].dataType).alias(c) for c in given],
        F.col("close").cast("double").alias("close_"),
    )
    d = orders.withColumn("close_", F.lit(None).cast("double")).unionByName(ticks)
    d = d.repartition(*by).sortWithinPartitions(*by, ts, F.col("close_").isNotNull())  # orders before the bar of their time

    def run(batches):
        key, book, schema = None, Book(), None
        for b in batches:
            schema = pa.schema([*(b.schema.field(c) for c in given), ("fill_ts", b.schema.field(ts).type), ("fill_price", pa.float64())])
            done = []
            for row in b.to_pylist():
                at = tuple(row[c] for c in by)
                if at != key:
                    done += book.rest()
                    key, book = at, Book()
                close = row.pop("close_")
                if close is None:
                    if not book.add(row):
                        done.append(row)
                else:
                    done += (o | {"fill_ts": row[ts], "fill_price": p} for o, p in book.fill(close))
            yield pa.RecordBatch.from_pylist(done, schema=schema)
        if schema is not None:
            yield pa.RecordBatch.from_pylist(book.rest(), schema=schema)

    return d.mapInArrow(run, out)


def compare_strategies(metrics: DataFrame, benchmark: DataFrame | None = None) -> DataFrame:
    """Metric rows of the strategies with the benchmark's rows below; both have the same columns."""
    return metrics if benchmark is None else metrics.unionByName(benchmark, allowMissingColumns=True)
