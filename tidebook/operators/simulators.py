"""Execution simulators: a taker, a maker, and a broker with queues and shared day risk.

The first two work on a whole session's arrays and jump from event to event: what may open a
position is one mask, and each close is the first hit of the closing masks. The broker keeps its
state in a plain dictionary and moves packet by packet, so that the same step serves batch
groups and streams.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict, dataclass, fields

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebook.functions.columns import BROKERAGE, EXCHANGE, SERVICE_TAX, STAMP, TRANSACTION_TAX, TURNOVER

TICK = 0.05


def charges(entry: float, exit_: float, qty: float, direction: int) -> float:
    buy, sell = (entry, exit_) if direction > 0 else (exit_, entry)
    buy, sell = buy * qty, sell * qty
    served = 2 * BROKERAGE + (EXCHANGE + TURNOVER) * (buy + sell)
    return served * (1 + SERVICE_TAX) + TRANSACTION_TAX * sell + STAMP * buy


@dataclass(frozen=True)
class Taker:
    threshold: float = 2.0
    cooldown: int = 10
    max_hold: int = 50
    stop_ticks: float = 12.0
    min_hold: int = 0
    reversal: float | None = None
    fresh_cross: bool = False
    slip_ticks: float = 1.0
    lot: int = 550


@dataclass(frozen=True)
class Maker:
    threshold: float = 2.0
    cooldown: int = 10
    max_hold: int = 50
    order_timeout: int = 5
    fresh_cross: bool = True
    maker_exit: bool = True
    slip_ticks: float = 1.0
    lot: int = 550


def _first(mask: np.ndarray, start: int) -> int:
    """The first true place at or after start, or the length."""
    k = int(mask[start:].argmax()) + start if start < len(mask) else len(mask)
    return k if k < len(mask) and mask[k] else len(mask)


def _next(places: np.ndarray, start: int, n: int) -> int:
    """The first of the sorted places at or after start, or n."""
    k = int(np.searchsorted(places, start))
    return int(places[k]) if k < len(places) else n


def _openings(signal: np.ndarray, valid: np.ndarray, threshold: float, fresh: bool) -> np.ndarray:
    """Packets whose signal may open: strong enough, and with `fresh` only after a weaker one.

    A packet that isn't valid counts as a signal of 0 for the next.
    """
    size = np.where(valid, np.abs(signal), 0.0)
    strong = valid & (size >= threshold)
    if fresh:
        strong &= np.concatenate([[0.0], size[:-1]]) < threshold
    return strong


def taker_session(mid: np.ndarray, signal: np.ndarray, p: Taker) -> list[tuple]:
    """(entry, exit, direction, entry price, exit price, method) of a session's trades."""
    n = len(mid)
    valid = ~(np.isnan(mid) | np.isnan(signal))
    places = np.flatnonzero(valid)
    openings = np.flatnonzero(_openings(signal, valid, p.threshold, p.fresh_cross))
    out, start = [], 0
    while (k := int(np.searchsorted(openings, start))) < len(openings):
        i = int(openings[k])
        side = 1 if signal[i] > 0 else -1
        entry = mid[i] + side * p.slip_ticks * TICK
        late = _next(places, max(i + p.max_hold, i + 1), n)
        # Nothing closes later than the holding time, so no search goes beyond it.
        part = slice(i + 1, min(late + 1, n))
        hit = valid[part] & (side * (mid[part] - entry) < -p.stop_ticks * TICK)
        out_early = hit
        if p.reversal is not None:
            turned = valid[part] & (side * signal[part] < -p.reversal)
            turned[: max(0, p.min_hold - 1)] = False
            out_early = hit | turned
        j = min(late, i + 1 + _first(out_early, 0)) if out_early.any() else late
        if j == n:
            j, method = n - 1, "eod"
        else:
            method = "max_hold" if j == late else "stop" if hit[j - i - 1] else "reversal"
        out.append((i, j, side, entry, mid[j] - side * p.slip_ticks * TICK, method))
        start = j + max(1, p.cooldown + 1) if method != "eod" else n
    return out


def maker_session(mid: np.ndarray, bid: np.ndarray, ask: np.ndarray, signal: np.ndarray, p: Maker) -> tuple[list[tuple], tuple[int, int, int]]:
    """Trades as for the taker, and the numbers of posts, fills and cancels."""
    n = len(mid)
    valid = ~(np.isnan(mid) | np.isnan(signal) | np.isnan(bid) | np.isnan(ask))
    places = np.flatnonzero(valid)
    openings = np.flatnonzero(_openings(signal, valid, p.threshold, p.fresh_cross))
    out, start, posts, fills, cancels = [], 0, 0, 0, 0

    def passed(side: int, price: float, first: int, last: int) -> int:
        """The first packet from first to last that trades through the price, or n."""
        part = slice(first, min(last + 1, n))
        mask = valid[part] & ((bid[part] < price) if side > 0 else (ask[part] > price))
        return first + int(mask.argmax()) if mask.any() else n

    while (k := int(np.searchsorted(openings, start))) < len(openings):
        i = int(openings[k])
        posts += 1
        side = 1 if signal[i] > 0 else -1
        price = bid[i] if side > 0 else ask[i]
        # No search goes beyond the packet that ends the wait.
        expired = _next(places, max(i + p.order_timeout, i + 1), n)
        filled = passed(side, price, i + 1, expired)
        if filled == expired == n:
            break  # still waiting when the session ends
        if expired < filled:
            cancels += 1
            start = expired + 1
            continue
        fills += 1
        late = _next(places, max(filled + p.max_hold, filled + 1), n)
        met, left = n, 0.0
        if p.maker_exit and (posted := _next(places, filled + 1, n)) < n:
            left = ask[posted] if side > 0 else bid[posted]
            met = passed(-side, left, posted, late)
        j = min(met, late)
        if j == n:
            out.append((filled, n - 1, side, price, mid[n - 1] - side * p.slip_ticks * TICK, "taker_eod"))
            break
        out.append((filled, j, side, price, left, "maker_exit") if met <= late else (filled, j, side, price, mid[j] - side * p.slip_ticks * TICK, "taker_max_hold"))
        start = j + max(1, p.cooldown + 1)
    return out, (posts, fills, cancels)


TRADES = "param_id int, entry_seq long, exit_seq long, hold_packets int, direction int, entry_price double, exit_price double, exit_method string, gross_pnl double, fee double, net_pnl double"


def _rows(found: list[tuple], seq: np.ndarray, qty: int, param: int) -> list[tuple]:
    out = []
    for i, j, side, entry, exit_, method in found:
        gross, fee = side * (exit_ - entry) * qty, charges(entry, exit_, qty, side)
        out.append((param, int(seq[i]), int(seq[j]), j - i, side, entry, exit_, method, gross, fee, gross - fee))
    return out


def backtest(df: DataFrame, grid: list[Taker] | list[Maker], keys: tuple[str, ...] = ("symbol", "date")) -> DataFrame:
    """Trades of every parameter set of the grid over every session.

    df: keys, ts, seq, mid, signal, and bid and ask for makers. A session is one group, and all
    sets run inside it, so no row is copied for a set; param_id is the place in the grid.
    """
    maker = isinstance(grid[0], Maker)
    wanted = ["ts", "seq", "mid", "signal"] + ["bid", "ask"] * maker
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    names = [*keys, *(c.split()[0] for c in TRADES.split(", "))]

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["ts", "seq"])
        a = {c: rows[c].to_numpy(float) for c in wanted if c not in ("ts", "seq")}
        seq, out = rows["seq"].to_numpy(), []
        for k, p in enumerate(grid):
            found = maker_session(a["mid"], a["bid"], a["ask"], a["signal"], p)[0] if maker else taker_session(a["mid"], a["signal"], p)
            out += [(*key, *r) for r in _rows(found, seq, p.lot, k)]
        return pd.DataFrame(out, columns=names)

    lean = df.select(*dict.fromkeys([*keys, *wanted]))
    return lean.groupBy(*keys).applyInPandas(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", " + TRADES)


# Broker


@dataclass(frozen=True)
class Strategy:
    entry_threshold: float = 0.15
    max_hold: int = 250
    order_timeout: int = 10
    min_hold: int = 10
    lots: int = 1
    tick: float = 0.05
    stop_ticks: float = 12.0
    edge_margin: float = 1.0
    queue_fill: float = 0.10
    queue_exit: bool = False
    queue_exit_share: float = 1.0
    exit_mode: str = "maker"
    #: Minutes of the local day from which nothing is opened.
    last_entry: int = 15 * 60 + 25


def fresh_state(p: Strategy) -> dict:
    """A symbol's state at the begin of a session. Orders are [side, price, packet, queue, consumed]."""
    return {"i": 0, "side": 0, "entry": None, "exit": None, "prev": 0.0, "last_exit": -(p.order_timeout + 1), "bid_qty": None, "ask_qty": None, "mid": 0.0, "at": 0, "price": 0.0, "posts": 0, "fills": 0, "cancels": 0, "trades": 0, "realized": 0.0}


def _close(s: dict, p: Strategy, lot: int, price: float, method: str, packet: int) -> dict:
    qty = lot * p.lots
    gross, fee = s["side"] * (price - s["price"]) * qty, round(charges(s["price"], price, qty, s["side"]), 2)
    trade = {"direction": s["side"], "entry_price": s["price"], "exit_price": round(price, 4), "exit_method": method, "hold_packets": packet - s["at"], "gross_pnl": round(gross, 2), "fee": fee, "net_pnl": round(gross - fee, 2)}
    s.update(side=0, exit=None, last_exit=packet, trades=s["trades"] + 1, realized=round(s["realized"] + trade["net_pnl"], 2))
    return trade


def _waited(order: list, share: float) -> bool:
    return order[3] <= 0 or order[4] >= share * order[3]


def step(s: dict, p: Strategy, lot: int, minute: int, bid: float, bid_qty: float, ask: float, ask_qty: float, halted: bool = False) -> dict | None:
    """Move a symbol's state by one packet; the trade that the packet closes, if any.

    Zero and crossed packets are dropped before they count. minute is of the local day.
    """
    if bid <= 0 or ask <= 0 or ask < bid:
        return None
    i = s["i"]
    s["i"] += 1
    mid = s["mid"] = (bid + ask) / 2
    total = bid_qty + ask_qty
    sig = 0.0 if total < 1e-9 else (bid * ask_qty + ask * bid_qty) / total - mid
    for order in (s["entry"], s["exit"]):
        if order and s["bid_qty"] is not None:  # what left the queue on the order's side
            order[4] += max(0.0, s["bid_qty"] - bid_qty if order[0] > 0 else s["ask_qty"] - ask_qty)
    s["bid_qty"], s["ask_qty"] = bid_qty, ask_qty
    touch = {1: (bid, bid_qty), -1: (ask, ask_qty)}
    through = lambda o: bid < o[1] if o[0] > 0 else ask > o[1]
    strong, trade = abs(sig) >= p.entry_threshold, None

    if s["side"] == 0 and not s["entry"]:
        qty = lot * p.lots
        edge = (ask - bid) / 2 >= p.edge_margin * round(charges(mid, mid, qty, 1), 2) / qty
        free = i - s["last_exit"] > p.order_timeout and s["prev"] < p.entry_threshold
        if strong and free and edge and minute < p.last_entry and not halted:
            side = 1 if sig > 0 else -1
            s["entry"] = [side, touch[side][0], i, touch[side][1], 0.0]
            s["posts"] += 1
    elif s["side"] == 0:
        order = s["entry"]
        if through(order) and _waited(order, p.queue_fill):
            s.update(side=order[0], price=order[1], at=i, entry=None)
            s["fills"] += 1
        elif i - order[2] >= p.order_timeout:
            s["entry"] = None
            s["cancels"] += 1
    else:
        held, side = i - s["at"], s["side"]
        taken = mid - side * p.tick
        if p.stop_ticks > 0 and side * (s["price"] - mid) / p.tick >= p.stop_ticks:
            trade = _close(s, p, lot, taken, "taker_stop", i)
        elif p.exit_mode == "reversal" and side * sig < 0 and strong:
            trade = _close(s, p, lot, taken, "taker_reversal", i)
        else:
            if not s["exit"] and held >= p.min_hold:
                s["exit"] = [-side, touch[-side][0], i, touch[-side][1], 0.0]
            order = s["exit"]
            if order and through(order) and (not p.queue_exit or _waited(order, p.queue_exit_share)):
                trade = _close(s, p, lot, order[1], "maker_exit", i)
            elif held >= p.max_hold:
                trade = _close(s, p, lot, taken, "taker_max_hold", i)
    s["prev"] = abs(sig)
    return trade


def force_close(s: dict, p: Strategy, lot: int, mid: float = 0.0) -> dict | None:
    """Close what is open at the end of the day, at the last good mid, or flat at the entry price."""
    if s["side"] == 0:
        return None
    last = mid if mid > 0 else s["mid"] if s["mid"] > 0 else s["price"]
    return _close(s, p, lot, last - s["side"] * p.tick, "taker_eod", s["i"])


class DayRisk:
    """Latches once the day's net result is at or below the limit (0: no limit)."""

    def __init__(self, limit: float = 0.0, net: float = 0.0, halted: bool = False):
        self.limit, self.net, self.halted = limit, net, halted

    def record(self, net: float) -> None:
        self.net += net
        self.halted = self.halted or (self.limit < 0 and self.net <= self.limit)


BROKER_TRADES = "symbol string, exit_seq long, direction int, entry_price double, exit_price double, exit_method string, hold_packets int, gross_pnl double, fee double, net_pnl double"
#: What an arm has in a symbol after a packet; the time of that packet comes beside it.
POSITIONS = "symbol string, direction int, entry_price double, last_mid double, qty long, unrealized double, pending_entry int, pending_exit boolean, posts int, fills int, cancels int, trades int, realized double, day_net double, halted boolean"


def names_of(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


class ArmDay:
    """An arm's day: the states of its symbols, which share the day's risk. Packets come in time order."""

    def __init__(self, p: Strategy, lots: dict[str, int] | None = None, limit: float = 0.0, held: dict | None = None):
        held = held or {}
        self.p, self.lots = p, lots or {}
        self.risk = DayRisk(limit, held.get("net", 0.0), held.get("halted", False))
        self.states, self.last = held.get("symbols", {}), held.get("last", {})

    def _told(self, symbol: str, trade: dict | None) -> list[dict]:
        if not trade:
            return []
        self.risk.record(trade["net_pnl"])
        return [{"symbol": symbol, "exit_seq": self.last[symbol][0], **trade}]

    def packet(self, symbol: str, ts: pd.Timestamp, seq: int, minute: int, quote: tuple) -> list[dict]:
        """The trade that the packet closes, if any, as a list."""
        s = self.states.setdefault(symbol, fresh_state(self.p))
        self.last[symbol] = (int(seq), ts.value // 1000)
        return self._told(symbol, step(s, self.p, self.lots.get(symbol, 550), minute, *quote, self.risk.halted))

    def close(self) -> list[dict]:
        return [t for symbol, s in self.states.items() for t in self._told(symbol, force_close(s, self.p, self.lots.get(symbol, 550)))]

    def positions(self, symbols: set[str] | None = None) -> list[dict]:
        """A row for each symbol seen (of `symbols`): what is held and pending, its open result before charges at the last mid."""
        out = []
        for symbol, s in self.states.items():
            if symbols is not None and symbol not in symbols:
                continue
            qty = self.lots.get(symbol, 550) * self.p.lots
            open_ = s["side"] != 0
            out.append({
                "symbol": symbol, "direction": s["side"], "entry_price": round(s["price"], 4) if open_ else None, "last_mid": round(s["mid"], 4), "qty": qty,
                "unrealized": round(s["side"] * (s["mid"] - s["price"]) * qty, 2) if open_ and s["mid"] > 0 else 0.0,
                "pending_entry": s["entry"][0] if s["entry"] else 0, "pending_exit": s["exit"] is not None,
                **{c: s[c] for c in ("posts", "fills", "cancels", "trades", "realized")}, "day_net": round(self.risk.net, 2), "halted": self.risk.halted,
                "seq": self.last[symbol][0], "packet_at": pd.Timestamp(self.last[symbol][1], unit="us"),
            })
        return out

    def kept(self) -> dict:
        return {"net": self.risk.net, "halted": self.risk.halted, "symbols": self.states, "last": self.last}


def _by_day(df: DataFrame, p: Strategy, lots: dict[str, int] | None, limit: float, keys: tuple[str, ...], offset_minutes: int, schema: str, trades: bool, tell) -> DataFrame:
    """Rows of the schema: with `trades` those that packets close, then what tell(day) gives once all packets of a group are taken.

    Spark sorts the packets of a task by group and time, so a task holds a batch of them and the state of one group.
    """
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    names = names_of(schema)
    columns = ("symbol", "ts", "seq", "bid", "bid_qty", "ask", "ask_qty")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, day = None, None
        frame = lambda out: pd.DataFrame(out, columns=[*keys, *names])
        rows_of = lambda told: [(*at, *(r[c] for c in names)) for r in told]
        for rows in parts:
            out = []
            minutes = ((rows["ts"].dt.hour * 60 + rows["ts"].dt.minute + offset_minutes) % 1440).tolist()
            groups = zip(*(rows[k].tolist() for k in keys))
            for key, minute, symbol, ts, seq, *quote in zip(groups, minutes, *(rows[c].tolist() for c in columns)):
                if day is None or key != at:
                    out += rows_of(tell(day)) if day else []
                    at, day = key, ArmDay(p, lots, limit)
                closed = day.packet(symbol, ts, seq, minute, quote)
                if closed and trades:
                    out += rows_of(closed)
            if out:
                yield frame(out)
        if day:
            yield frame(rows_of(tell(day)))

    # Numbers go through pandas as texts: beside a null they would all be floats there, and no missing one equals the next.
    numbers = [k for k in keys if kinds[k] in ("tinyint", "smallint", "int", "bigint", "float", "double")]
    lean = df.select(*keys, *(c for c in columns if c not in keys)).withColumns({k: (F.col(k) + F.lit(0).cast(kinds[k])).cast("string") for k in numbers})
    ordered = lean.repartition(*keys).sortWithinPartitions(*keys, F.asc_nulls_last("ts"), F.asc_nulls_last("seq"))
    told = ordered.mapInPandas(run, ", ".join(f"{k} {'string' if k in numbers else kinds[k]}" for k in keys) + ", " + schema)
    return told.withColumns({k: F.col(k).cast(kinds[k]) for k in numbers})


def broker(df: DataFrame, p: Strategy, lots: dict[str, int] | None = None, limit: float = 0.0, keys: tuple[str, ...] = ("arm", "date"), offset_minutes: int = 0) -> DataFrame:
    """Trades of one strategy over df(keys, symbol, ts, seq, bid, bid_qty, ask, ask_qty).

    The symbols of an arm's day share its risk, so that day is one group and its packets are taken
    in time order, then by seq. Days run side by side.
    """
    return _by_day(df, p, lots, limit, keys, offset_minutes, BROKER_TRADES, True, ArmDay.close)


def broker_positions(df: DataFrame, p: Strategy, lots: dict[str, int] | None = None, limit: float = 0.0, keys: tuple[str, ...] = ("arm", "date"), offset_minutes: int = 0) -> DataFrame:
    """What broker() holds after the last packet of df in each group, before the day is closed: a row a symbol.

    packet_at and seq are of the symbol's last packet. Take packets up to a time to see that time.
    """
    schema = POSITIONS + f", seq long, packet_at {df.schema['ts'].dataType.simpleString()}"
    return _by_day(df, p, lots, limit, keys, offset_minutes, schema, False, ArmDay.positions)


def haircut(df: DataFrame, p: Strategy, keys: tuple[str, ...] = ("symbol", "date"), share: float = 1.0) -> DataFrame:
    """Results of an exit that fills at the touch against one that waits for the queue, by symbol and day."""
    from dataclasses import replace

    df = df.withColumn("arm", F.col("symbol"))
    one = lambda q, name: broker(df, q, keys=("arm", "date")).groupBy("arm", "date").agg(F.sum("net_pnl").alias(name))
    both = one(replace(p, queue_exit=False), "touch_net").join(one(replace(p, queue_exit=True, queue_exit_share=share), "queue_net"), ["arm", "date"], "full_outer").fillna(0.0)
    gap = F.col("touch_net") - F.col("queue_net")
    return both.withColumnRenamed("arm", "symbol").withColumns({"haircut": gap, "haircut_pct": F.when(F.col("touch_net") != 0, 100 * gap / F.col("touch_net"))})


def replay_summary(trades: DataFrame, *by: str) -> DataFrame:
    """Of a replay's trades: count, net, the share that the maker exit closed, and net by the kind of exit."""
    kinds = ("maker_exit", "taker_stop", "taker_max_hold", "taker_reversal", "taker_eod")
    net = F.col("net_pnl")
    return trades.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.sum(net).alias("net"),
        F.avg(F.when(F.col("exit_method") == "maker_exit", 1.0).otherwise(0.0)).alias("maker_exit_rate"),
        *[F.sum(F.when(F.col("exit_method") == k, net).otherwise(0.0)).alias(f"net_{k}") for k in kinds],
    )


def params_frame(spark, grid: list) -> DataFrame:
    """The grid as a small table: param_id and one column a field."""
    kinds = {"int": "int", "bool": "boolean", "str": "string"}
    schema = ", ".join(["param_id int", *(f"{f.name} {kinds.get(f.type, 'double')}" for f in fields(grid[0]))])
    rows = [(k, *(float(v) if kinds.get(f.type) is None and v is not None else v for f, v in zip(fields(p), asdict(p).values()))) for k, p in enumerate(grid)]
    return spark.createDataFrame(rows, schema)
