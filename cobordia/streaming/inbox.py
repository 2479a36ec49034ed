"""Pop-once inboxes: an agent reads what arrived since it last read, the latest of each source, and reads it once.

Keyed state per agent is a list of messages, the latest of each source. A message replaces an unread one of its source; reading
gives all there is and clears the list, so nothing is read again, in a later micro-batch or after a restart. Messages that
nobody reads are given up ``keep`` after they came, where that is wanted. State is one message per agent and source; in
a micro-batch it is read once per agent, and only what is unread at its end is written, however many messages came.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle, TimerValues
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

#: What the state store needs for list state.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
READ = StructType([StructField("agent", LongType()), StructField("read_at", LongType()), StructField("read_id", LongType()), StructField("source", StringType()), StructField("sent_at", LongType()), StructField("value", DoubleType())])
#: ``came``: when the message was taken in, by the clock of the micro-batch, where messages are given up.
_MESSAGE = StructType([StructField("source", StringType()), StructField("sent_at", LongType()), StructField("value", DoubleType()), StructField("came", LongType())])


class Inbox(StatefulProcessor):
    def __init__(self, keep_ms: int | None = None) -> None:
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.box = handle.getListState("box", _MESSAGE, *(() if self.keep_ms is None else (self.keep_ms,)))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        columns = [np.concatenate(c) for c in zip(*([b[n].to_numpy() for n in ("t", "id", "reads", "source", "value")] for b in rows), strict=True)]
        order = np.lexsort((columns[1], columns[0]))
        now = None if self.keep_ms is None else timerValues.getCurrentProcessingTimeInMs()
        held = list(self.box.get())
        box, changed, out = {m[0]: m for m in held if now is None or m[3] + self.keep_ms > now}, False, []
        for t, id_, reads, source, value in zip(*(c[order].tolist() for c in columns), strict=True):
            if not reads:
                box[source] = (source, t, None if pd.isna(value) else float(value), now)
                changed = True
            elif box:
                out += [(key[0], t, id_, *message[:3]) for message in box.values()]
                box, changed = {}, True
        # the store is asked once and told once
        if box and changed:
            self.box.put([tuple(m) for m in box.values()])
        elif held and not box:
            self.box.clear()
        if out:
            yield pd.DataFrame(out, columns=READ.names)

    def close(self) -> None:
        pass


def read_once(traffic: DataFrame, keep_ms: int | None = None) -> DataFrame:
    """(READ) of a stream (agent, t, id, reads, source, value): messages to agents, and agents' readings (``reads``), in the
    order of (t, id) within a micro-batch. The session's state store must be ``STORE``."""
    mode = "None" if keep_ms is None else "ProcessingTime"
    return traffic.groupBy("agent").transformWithStateInPandas(Inbox(keep_ms), READ, "append", mode)
