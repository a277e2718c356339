"""Live queries: bars, side pairing, fan-out, the broker as keyed state, telemetry."""

from __future__ import annotations

import json
import time
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pandas.api.types import union_categoricals
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidebook.operators import simulators as S
from tidebook.sources.logs import read_snapshot, write_snapshot


def bar_stream(ticks: DataFrame, width: str = "1 hour", late: str = "0 seconds") -> DataFrame:
    """Last mid of each window and symbol, in streams and batches alike. ts must be a timestamp."""
    w = ticks.withWatermark("ts", late) if ticks.isStreaming else ticks
    g = w.groupBy(F.window("ts", width), "symbol").agg(F.max_by("mid", F.struct("ts", "seq")).alias("close"), F.count("*").alias("n"))
    return g.select("symbol", F.col("window.start").alias("start"), "close", "n")


def fan_out(packets: DataFrame, arms: DataFrame) -> DataFrame:
    """Packets to each arm that trades their symbol; arms(arm, symbol) is static, and sent to all tasks only if it turns out small."""
    return packets.join(arms, "symbol")


def pair_stream(messages: DataFrame, key: str = "symbol") -> DataFrame:
    """The latest bid and ask message of a key, emitted and consumed when both are there.

    messages: key, ts, seq, side. State is one number a side and key; within a batch rows go by (ts, seq).
    """

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = dict(zip(("bid", "ask"), state.get)) if state.exists else {"bid": None, "ask": None}
        rows = pd.concat(list(frames)).sort_values(["ts", "seq"])
        out = []
        for seq, side in rows[["seq", "side"]].itertuples(index=False):
            held[side] = int(seq)
            if held["bid"] is not None and held["ask"] is not None:
                out.append((k[0], held["bid"], held["ask"]))
                held = {"bid": None, "ask": None}
        state.update((held["bid"], held["ask"]))
        yield pd.DataFrame(out, columns=[key, "bid_seq", "ask_seq"])

    return messages.groupBy(key).applyInPandasWithState(run, f"{key} string, bid_seq long, ask_seq long", "bid long, ask long", "append", GroupStateTimeout.NoTimeout)


#: Rows of a sorted batch that are plain Python objects at a time.
STEP = 10_000


def _in_order(frames: Iterator[pd.DataFrame], columns: list[str]) -> Iterator[tuple]:
    """Rows by (ts, seq); all that is held of the frames are these columns, texts as numbers."""
    held = [f[columns].astype({"symbol": "category"}) for f in frames]
    symbols = union_categoricals([f["symbol"] for f in held])
    rows = {c: np.concatenate([f[c].to_numpy() for f in held]) for c in columns if c != "symbol"}
    held.clear()
    order = np.lexsort((rows["seq"], rows["ts"]))
    for k in range(0, len(order), STEP):
        part = order[k : k + STEP]
        yield from pd.DataFrame({c: symbols[part].astype(object) if c == "symbol" else rows[c][part] for c in columns}).itertuples(index=False, name=None)


def broker_stream(packets: DataFrame, p: S.Strategy, lots: dict[str, int] | None = None, limit: float = 0.0, close: int = 24 * 60, late: str = "0 seconds", positions: bool = False) -> DataFrame:
    """Trades of each arm. State of an arm's day is its symbols' states and its risk, as JSON, until the watermark has passed that day.

    packets: arm, symbol, ts, seq, bid, bid_qty, ask, ask_qty. A day is closed at its minute
    `close` (local to the session's time zone): by the arm's first packet of that day from then on
    or, through the watermark, by that of any arm, of that day or a later one. Packets from `close` to
    midnight are left out, and so are those older than the watermark. A batch's rows go by (ts, seq).
    With positions, a column kind tells trades from rows of what is held in the symbols that a batch touched.
    """
    zone = packets.sparkSession.conf.get("spark.sql.session.timeZone")
    rest = S.POSITIONS + ", seq long, packet_at timestamp"
    known = set(S.names_of(S.BROKER_TRADES))
    schema = "arm string, date string, " + "kind string, " * positions + S.BROKER_TRADES
    if positions:
        schema += "".join(f", {c}" for c in rest.split(", ") if c.split()[0] not in known)
    names = S.names_of(schema)
    columns = ["ts", "symbol", "seq", "bid", "bid_qty", "ask", "ask_qty"]

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = json.loads(state.get[0]) if state.exists else {"open": True}
        day, touched = S.ArmDay(p, lots, limit, held), set()

        def frame(kind: str, rows: list[dict]) -> pd.DataFrame:
            rows = rows if positions or kind == "trade" else []
            told = [{"arm": k[0], "date": k[1], "kind": kind, **r} for r in rows]
            return pd.DataFrame([tuple(r.get(c) for c in names) for r in told], columns=names, dtype=object)

        def shut() -> list[dict]:
            if not held["open"]:
                return []
            held["open"] = False
            touched.update(day.states)
            return day.close()

        ends, over = ((pd.Timestamp(k[1]) + pd.Timedelta(minutes=m)).tz_localize(zone, ambiguous=False, nonexistent="shift_forward").value // 1_000_000 for m in (close, 24 * 60))
        if state.hasTimedOut:
            yield frame("trade", shut())
        else:
            told = []
            for ts, symbol, seq, *quote in _in_order(frames, columns):
                minute = ts.hour * 60 + ts.minute
                if minute >= close:
                    told += shut()
                if held["open"]:
                    touched.add(symbol)
                    told += day.packet(symbol, ts, seq, minute, tuple(map(float, quote)))
                if len(told) >= STEP:
                    yield frame("trade", told)
                    told = []
            yield frame("trade", told)
        yield frame("position", day.positions(touched))
        if state.hasTimedOut and state.getCurrentWatermarkMs() >= over:
            state.remove()
            return
        state.update((json.dumps({"open": held["open"], **day.kept()}),))
        state.setTimeoutTimestamp(max(ends if held["open"] else over, state.getCurrentWatermarkMs() + 1))

    rows = packets.withWatermark("ts", late).select("arm", F.date_format("ts", "yyyy-MM-dd").alias("date"), *columns).groupBy("arm", "date")
    return rows.applyInPandasWithState(run, schema, "state string", "append", GroupStateTimeout.EventTimeTimeout)


def telemetry(batch: DataFrame, path: str, now: float | None = None, batch_id: int | None = None) -> None:
    """For foreachBatch: totals of each arm as one small snapshot, a row an arm.

    Of a batch with a column kind (broker_stream with positions) trades count, and the last position of
    each arm and symbol is told, with the open result, the arm's risk and the age of its last packet.
    foreachBatch may repeat a batch: one whose batch_id the snapshot has already is not added again.
    """
    held = read_snapshot(path) or {}
    if batch_id is not None and held.get("batch_id", -1) >= batch_id:
        return
    now = now if now is not None else time.time()
    kinds = "kind" in batch.columns
    trades = batch.filter("kind = 'trade'") if kinds else batch
    totals = trades.groupBy("arm").agg(F.count("*").alias("trades"), F.round(F.sum("net_pnl"), 2).alias("net")).collect()
    arms = held.get("arms", {})
    for r in totals:
        old = arms.setdefault(r["arm"], {"trades": 0, "net": 0.0})
        old.update(trades=old["trades"] + r["trades"], net=round(old["net"] + r["net"], 2))
    if kinds:
        told = [c for c in S.names_of(S.POSITIONS) if c != "symbol"]
        last = F.struct(*told, (F.unix_micros("packet_at") / 1e6).alias("packet_at"))
        rows = batch.filter("kind = 'position'").groupBy("arm", "symbol").agg(F.max_by(last, F.struct("packet_at", "seq", F.expr("direction = 0"))).alias("last")).collect()
        for r in rows:
            told = arms.setdefault(r["arm"], {"trades": 0, "net": 0.0}).setdefault("positions", {})
            if told.get(r["symbol"], r["last"])["packet_at"] <= r["last"]["packet_at"]:  # a day may be closed after the next has begun
                told[r["symbol"]] = r["last"].asDict()
        for arm in (a for a in arms.values() if "positions" in a):
            each = arm["positions"].values()
            newest = max(each, key=lambda x: x["packet_at"])
            arm.update(open_positions=sum(x["direction"] != 0 for x in each), unrealized=round(sum(x["unrealized"] for x in each), 2))
            arm.update(day_net=newest["day_net"], halted=newest["halted"], packet_age=round(now - newest["packet_at"], 2))
    marked = {"batch_id": batch_id} if batch_id is not None else {}
    write_snapshot({"generated_at": now, **marked, "arms": arms}, path)


def publish(rows: DataFrame, path: str, checkpoint: str, every: str | None = "1 second") -> StreamingQuery:
    """Keep the snapshot at path up to date with a stream, a batch each second; None takes what there is now and ends."""
    writer = rows.writeStream.outputMode("append").option("checkpointLocation", checkpoint)

    def tell(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()  # trades and positions are read from one run of the batch
        try:
            telemetry(batch, path, batch_id=batch_id)
        finally:
            batch.unpersist()

    writer = writer.foreachBatch(tell)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def is_live(path: str, within_s: float = 15.0, now: float | None = None) -> bool:
    snapshot = read_snapshot(path)
    return bool(snapshot) and (now if now is not None else time.time()) - snapshot["generated_at"] < within_s


def run_available(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Run a stream over what its source has now, into Parquet files."""
    df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
