"""Flows of a packet stream: state holds a flow's packets until it closes, then the batch features are computed of them."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import batched

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..config import FlowConfig
from ..operators.headers import FIN, RST, SYN
from ..plans.engine import OPTIONAL, flow_features
from ..sources.packets import numbered

_PARTS = OPTIONAL | {"payload": "binary"}
_CARRIED = ["ts_us", "direction", "payload_len", "pkt_len", *_PARTS]
#: Keeps state on disk, so that an open flow's packets need no memory.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Packets of a closing flow that leave the state together.
BATCH = 10_000
TCP = 0


def _plain(value):
    if value is None or isinstance(value, str):
        return value
    return bytes(value) if isinstance(value, (bytes, bytearray)) else int(value)


class OpenFlow(StatefulProcessor):
    """A flow's packets as a list that is only appended to, and a head: how many there are, the last one's time, whether the flow is open, its timer.

    A batch costs as much as its new packets: those that the list holds are read once, when the flow closes, so many at a time.
    """

    def __init__(self, kept: T.StructType, names: list[str], idle_ms: int, require_open: bool):
        self.kept, self.names, self.idle_ms, self.require_open = kept, names, idle_ms, require_open

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.packets = handle.getListState("packets", self.kept)
        self.head = handle.getValueState("head", "n long, last_us long, is_open boolean, timer long")

    def _left(self, key: tuple) -> Iterator[pd.DataFrame]:
        if self.packets.exists():
            for rows in batched(self.packets.get(), BATCH):
                yield pd.DataFrame([(key[0], *r) for r in rows], columns=self.names)
        self.packets.clear()
        self.head.clear()

    def handleInputRows(self, key, rows, timerValues):
        n, last, is_open, timer = self.head.get() if self.head.exists() else (0, 0, not self.require_open, 0)
        closes = False
        for pdf in rows:
            new = pdf[_CARRIED].sort_values("ts_us", kind="stable").astype(object)
            new = [tuple(map(_plain, r)) for r in new.where(new.notna(), None).itertuples(index=False)]
            if not is_open:
                at = next((k for k, r in enumerate(new) if r[4] != TCP or (r[_CARRIED.index("tcp_flags")] or 0) & SYN), None)
                new, is_open = ([], False) if at is None else (new[at:], True)
            if new:
                self.packets.appendList([(n + k, *r) for k, r in enumerate(new)])
                n, last = n + len(new), max(last, new[-1][0])
                closes = closes or any((r[_CARRIED.index("tcp_flags")] or 0) & (FIN | RST) for r in new)
        if timer:
            self.handle.deleteTimer(timer)
        if closes:
            yield from self._left(key)
        elif n:
            timer = max(last // 1000 + self.idle_ms, timerValues.getCurrentWatermarkInMs() + 1)
            self.handle.registerTimer(timer)
            self.head.update((n, last, is_open, timer))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        yield from self._left(key)

    def close(self) -> None:
        pass


def closed_flows(packets: DataFrame, idle: str = "60 seconds", delay: str = "10 seconds", require_open: bool = False) -> DataFrame:
    """Packets of flows that closed, with arrival, their place in the order of coming.

    A flow closes with a FIN or RST, or when event time has passed its last packet by idle; packets later than delay are
    dropped with the watermark. With require_open, a TCP flow begins with its first SYN, and what comes before is left out. State keeps all packets of
    an open flow, on disk where the session's state store is STORE; cfg.max_sequence bounds the sequence groups alone.
    """
    missing = {c: F.lit(None).cast(t) for c, t in _PARTS.items() if c not in packets.columns}
    stream = packets.where("flow_id IS NOT NULL").withColumns(missing).withColumn("event_time", F.timestamp_micros("ts_us")).withWatermark("event_time", delay)
    fields = {f.name: f for f in stream.schema.fields}
    kept = T.StructType([T.StructField("arrival", T.LongType()), *[T.StructField(c, fields[c].dataType) for c in _CARRIED]])
    out = T.StructType([fields["flow_id"], *kept.fields])
    flow = OpenFlow(kept, [f.name for f in out.fields], int(pd.Timedelta(idle).total_seconds() * 1000), require_open)
    return stream.groupBy("flow_id").transformWithStateInPandas(flow, out, "Append", "EventTime")


def write_features(packets: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, cfg: FlowConfig = FlowConfig(), **close) -> StreamingQuery:
    """Starts a query that hands the features of each batch's closed flows to sink, with the batch's number; the same code as for a table.

    Sets the session's state store to STORE. A batch may come again after a failure, under the same number: see sources.sinks.files.
    """
    packets.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)

    def each(batch: DataFrame, number: int) -> None:
        sink(flow_features(numbered(batch, "ts_us", "arrival").drop("arrival"), cfg), number)

    return closed_flows(packets, **close).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
