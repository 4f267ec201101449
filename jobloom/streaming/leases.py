"""Leases as keyed state: each beat renews a timer, and a timer that fires is a lost lease."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

LEASE_OUT = "job_id string, kind string, last_beat_ms bigint, n_beats bigint"


class LeaseTimer(StatefulProcessor):
    """Beats (job_id, ts, token) -> lease-lost when no beat of the token came for a whole timeout.

    A beat with another token than the lease's own is late: it is answered with stale-token and
    doesn't renew the lease. A claim (kind 'claim') starts a lease anew. A terminal command (kind
    'end') counts while the lease is confirmed: then it is answered with ended, and the lease
    goes; after a whole timeout without a beat its write is suppressed, and the lease is lost.
    """

    def __init__(self, timeout_ms: int) -> None:
        if timeout_ms <= 0:
            raise ValueError("the timeout must be positive")
        self.timeout_ms = timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.lease = handle.getValueState("lease", "token string, last_ms bigint, n bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        beats = pd.concat(list(rows)).sort_values(["ts", "seq"])
        token, last, n = self.lease.get() if self.lease.exists() else (None, None, 0)
        out = []
        for kind, own, ts in zip(beats["kind"], beats["token"], beats["ts"], strict=True):
            at = int(ts.timestamp() * 1000)
            if kind == "claim":
                token, last, n = own, at, 1
            elif kind == "end" and (token is None or own != token):
                out.append((key[0], "suppressed", at, n))
            elif kind == "end" and at - last <= self.timeout_ms:
                out.append((key[0], "ended", at, n))
                token, last, n = None, None, 0
            elif kind == "end":
                out += [(key[0], "lease-lost", last, n), (key[0], "suppressed", at, n)]
                token, last, n = None, None, 0
            elif token is None or own != token:
                out.append((key[0], "stale-token", at, n))
            elif at - last > self.timeout_ms:
                out.append((key[0], "lease-lost", last, n))
                token, last, n = None, None, 0
            else:
                last, n = at, n + 1
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        if token is None:
            self.lease.clear()
        else:
            self.lease.update((token, last, n))
            self.handle.registerTimer(last + self.timeout_ms + 1)
        yield pd.DataFrame(out, columns=["job_id", "kind", "last_beat_ms", "n_beats"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if not self.lease.exists():
            return
        _, last, n = self.lease.get()
        self.lease.clear()
        yield pd.DataFrame([(key[0], "lease-lost", last, n)], columns=["job_id", "kind", "last_beat_ms", "n_beats"])

    def close(self) -> None:
        pass


def lease_events(beats: DataFrame, timeout_ms: int, late: str = "0 seconds") -> DataFrame:
    """Lost and ended leases of a stream of claims, beats and ends (job_id, ts, seq, kind, token), by event time.

    Only ends that are answered with ended are to be applied.

    It needs the RocksDB state store (spark.sql.streaming.stateStore.providerClass).
    """
    rows = beats.withWatermark("ts", late)
    return rows.groupBy("job_id").transformWithStateInPandas(LeaseTimer(timeout_ms), LEASE_OUT, "append", "EventTime")
