"""Streams whose packets come late, twice and out of order, brought into the order of (ts, seq) by keyed state.

A key's packets wait in slots of time until the watermark has passed them; an event-time timer then hands them on slot
by slot, each sequence number of a time once. What follows sees packets as a batch would sort them, and a task holds one
slot of them.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The state store that timers and lists need.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


#: Packets that are put into slots at once.
PUT = 100_000


def _packed(rows: pd.DataFrame) -> bytes:
    batch, out = pa.RecordBatch.from_pandas(rows, preserve_index=False), pa.BufferOutputStream()
    with pa.ipc.new_stream(out, batch.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as writer:
        writer.write_batch(batch)
    return out.getvalue().to_pybytes()


def _unpacked(part: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(bytes(part)).read_pandas()


class Numbered:
    """The fold that only numbers packets: n from 1, and seconds since the packet before."""

    state = "n long, at long"
    adds = "n long, gap_s double"

    @staticmethod
    def start(_=None) -> tuple:
        return (0, 0)

    @staticmethod
    def step(rows: pd.DataFrame, held: tuple) -> tuple[pd.DataFrame, tuple]:
        n, at = held
        times = rows["at_us"].to_numpy()
        before = pd.Series([at if n else None, *times[:-1]], dtype="float64").to_numpy()
        return rows.assign(n=range(n + 1, n + 1 + len(rows)), gap_s=(times - before) / 1e6), (n + len(rows), int(times[-1]))


class Ordering(StatefulProcessor):
    """Holds a key's packets until the watermark passes them, then folds them in order."""

    def __init__(self, keys: tuple[str, ...], names: list[str], fold, starts: bool, slot_us: int):
        self.keys, self.names, self.fold, self.starts, self.slot_us = keys, names, fold, starts, slot_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("slots", "slot long, part long", "packets binary")
        self.parts = handle.getValueState("parts", "n long")
        self.passed = handle.getValueState("passed", "us long")
        self.carried = handle.getValueState("carried", self.fold.state)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        first = initialState.iloc[0, len(self.keys)]
        self.carried.update(self.fold.start(None if pd.isna(first) else float(first)))

    def _put(self, frames: list[pd.DataFrame], n: int) -> None:
        """Add packets to their slots, each slot's as its part n."""
        rows = pd.concat(frames, ignore_index=True)
        for slot, part in rows.groupby(rows["at_us"] // self.slot_us):
            self.waiting.updateValue((int(slot), n), (_packed(part),))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        passed = self.passed.get()[0] if self.passed.exists() else None
        n = self.parts.get()[0] if self.parts.exists() else 0
        least, held, size = None, [], 0
        for part in rows:
            part = part[self.names]
            if passed is not None:
                part = part[part["at_us"] > passed]
            if len(part):
                held.append(part)
                size += len(part)
                first = int(part["at_us"].min())
                least = first if least is None else min(least, first)
            if size >= PUT:
                self._put(held, n)
                n, held, size = n + 1, [], 0
        if held:
            self._put(held, n)
            n += 1
        if least is not None:
            self.parts.update((n,))
            self.handle.registerTimer(-(-least // 1000))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        slots: dict[int, list[int]] = {}
        for slot, n in self.waiting.keys():
            slots.setdefault(slot, []).append(n)
        if self.carried.exists():
            held = tuple(self.carried.get())
        else:  # where what a session starts from is not known, it is left out
            held = None if self.starts else self.fold.start()
        told = False
        for slot in sorted(slots):
            if slot * self.slot_us > mark:
                self.handle.registerTimer(slot * self.slot_us // 1000)
                break
            rows = pd.concat([_unpacked(self.waiting.getValue((slot, n))[0]) for n in sorted(slots[slot])], ignore_index=True)
            due = rows["at_us"] <= mark
            ready, rest = rows[due], rows[~due]
            if len(ready):
                told = True
                for n in slots[slot]:
                    self.waiting.removeKey((slot, n))
                if len(rest):
                    self._put([rest], slots[slot][0])
                ready = ready.drop_duplicates(["at_us", "seq"]).sort_values(["at_us", "seq"], ignore_index=True)
                if held is not None:
                    out, held = self.fold.step(ready, held)
                    for place, name in enumerate(self.keys):
                        out.insert(place, name, key[place])
                    yield out
            if len(rest):
                self.handle.registerTimer(-(-int(rest["at_us"].min()) // 1000))
                break
        if told:
            self.passed.update((mark,))
            if held is not None:
                self.carried.update(held)

    def close(self) -> None:
        pass


def ordered_stream(packets: DataFrame, late: str, fold=Numbered, keys: tuple[str, ...] = ("symbol",), initial: DataFrame | None = None, slot: float = 3600.0) -> DataFrame:
    """packets(keys, ts, seq, ...) in the order of (ts, seq) within keys, each once, with what the fold adds.

    A packet may come up to `late` behind the latest one seen; it is handed on when the watermark reaches its time,
    so packets that come again by then, or later still, are told once. Those that come for the first time after the
    watermark has passed them are left out (Spark counts them as dropped). Of packets with the same time and sequence
    number the first is taken. ts must be a timestamp; the other columns numbers or texts. initial(keys, value) is
    what the fold of a key starts from; a key without it is then left out. State of a key: the packets
    of the last `late`, by slots of so many seconds, and what the fold carries. A task holds one slot's packets at once,
    so a feed of more than some 100 000 packets a key and hour wants shorter ones.
    """
    # Spark starts the processor once more beside the driver, in a process that need not know where this package lies.
    for module in {__name__, fold.__module__}:
        cloudpickle.register_pickle_by_value(sys.modules[module])
    others = [f for f in packets.schema.fields if f.name not in (*keys, "ts")]
    names = ["at_us", *(f.name for f in others)]
    kinds = ", ".join(["at_us long", *(f"`{f.name}` {f.dataType.simpleString()}" for f in others)])
    key_kinds = ", ".join(f"`{k}` {packets.schema[k].dataType.simpleString()}" for k in keys)
    rows = packets.withColumn("at_us", F.unix_micros("ts")).withWatermark("ts", late)
    out = rows.groupBy(*keys).transformWithStateInPandas(
        Ordering(keys, names, fold, initial is not None, int(slot * 1_000_000)),
        f"{key_kinds}, {kinds}, {fold.adds}",
        outputMode="Append",
        timeMode="EventTime",
        initialState=initial.groupBy(*keys) if initial is not None else None,
    )
    return out.withColumn("ts", F.timestamp_micros("at_us")).drop("at_us")
