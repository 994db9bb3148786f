"""Ping and pong as a stream: a keyed operator that answers at the first pong or at a timer, and then forgets."""

from __future__ import annotations

import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from gridloom.operators import events as ev

cloudpickle.register_pickle_by_value(sys.modules[__name__])

PAIRS = "scenario string, seq bigint, pong_seq bigint, answered boolean"
#: Keyed state of this kind needs a state store with several columns.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class FirstPong(StatefulProcessor):
    """Open pings of a scenario by ``seq``, each with a timer at the end of its wait.

    The first pong behind a ping decides: within the wait it is the answer, later there is none. Rows of a batch are
    taken in order of ``seq``.
    """

    def __init__(self, wait_seconds: float):
        self.wait_ms = int(wait_seconds * 1000)

    def init(self, handle) -> None:
        self.handle = handle
        self.open = handle.getMapState("pings", "seq bigint", "micros bigint")

    def _timer(self, micros: int) -> int:
        return micros // 1000 + self.wait_ms + 1

    def handleInputRows(self, key, rows, timerValues):
        events = pd.concat([r for r in rows]).sort_values("seq", kind="stable")
        waiting = {k[0]: v[0] for k, v in self.open.iterator()}
        known, out = set(waiting), []
        for seq, micros, kind in zip(events["seq"].tolist(), events["micros"].tolist(), events["process"].tolist()):
            if kind == "System_Ping":
                waiting[seq] = micros
                continue
            for ping in sorted(p for p in waiting if p < seq):
                near = micros - waiting.pop(ping) <= self.wait_ms * 1000
                out.append((key[0], ping, seq if near else None, near))
        for ping in known - waiting.keys():
            self.open.removeKey((ping,))
        for ping in waiting.keys() - known:
            self.open.updateValue((ping,), (waiting[ping],))
            self.handle.registerTimer(self._timer(waiting[ping]))
        if out:
            yield _frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now = expiredTimerInfo.getExpiryTimeInMs()
        over = sorted(k[0] for k, v in self.open.iterator() if self._timer(v[0]) <= now)
        for ping in over:
            self.open.removeKey((ping,))
        if over:
            yield _frame([(key[0], ping, None, False) for ping in over])

    def close(self) -> None:
        pass


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["scenario", "seq", "pong_seq", "answered"])
    return out.astype({"seq": "int64", "pong_seq": "Int64", "answered": "bool"})


def ping_pong_stream(events: DataFrame, wait_seconds: float, delay: str = "1 minute") -> DataFrame:
    """``PAIRS``: each ping once, with its first pong if that comes within the wait, by the rule of ``pair_ping_pong``.

    A ping is answered as soon as its pong is seen, or as unanswered when the watermark has passed its wait; then its
    state is gone. Pongs have to arrive in order of ``seq`` within a scenario, as the log has them: one that arrives after
    a later pong has answered changes nothing. Rows later than ``delay`` are dropped by the watermark. Handshakes are few
    messages of a scenario, so its key is no hot one. The session needs ``STATE_STORE`` as its state store provider.
    """
    good, _ = ev.decode(events)
    asked = good.filter(F.col("process").isin("System_Ping", "System_Pong")).withWatermark("ts", delay)
    rows = asked.select("scenario", "seq", "ts", F.unix_micros("ts").alias("micros"), "process")
    return rows.groupBy("scenario").transformWithStateInPandas(
        statefulProcessor=FirstPong(wait_seconds), outputStructType=PAIRS, outputMode="append", timeMode="eventTime"
    )
