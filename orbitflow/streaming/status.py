"""What running queries tell: status lines, arrivals by kind, readiness, lag.

``watched`` and ``told`` put observed metrics into a query: Spark counts them as rows pass, in the tasks, and reports sums with each micro-batch's progress. Nothing
runs twice for them, and listeners read numbers only.
"""

from __future__ import annotations

import struct
import threading
import time

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQueryListener

from orbitflow.config import Config
from orbitflow.functions.codec import HEADER
from orbitflow.operators.batches import kind_of

ARRIVALS, RESULTS = "arrivals", "results"
_HEAD = HEADER.size
#: Frames that results may lie behind arrivals.
BEHIND_FRAMES = 3


@F.arrow_udf(T.DoubleType())
def stamp_of(payload: pa.Array) -> pa.Array:
    """The stamp of a datagram, which both kinds begin with."""
    return pa.array([struct.unpack_from("<d", p, _HEAD)[0] if p is not None and len(p) >= _HEAD + 8 else None for p in payload.to_pylist()], pa.float64())


def watched(datagrams: DataFrame) -> DataFrame:
    """``datagrams`` with the metrics ARRIVALS: scans, samples, dropped (what cannot be decoded; end marks aren't counted), newest stamps of both kinds."""
    known = datagrams.withColumns({"_kind": kind_of(F.col("payload")), "_stamp": stamp_of("payload")})
    of = lambda kind: F.when(F.col("_kind") == kind, F.col("_stamp"))
    lost = F.when(F.col("_kind").isNull() & F.col("payload").isNotNull(), 1)
    return known.observe(
        ARRIVALS, F.count(F.when(F.col("_kind") == "scan", 1)).alias("scans"), F.count(F.when(F.col("_kind") == "imu", 1)).alias("samples"), F.count(lost).alias("dropped"),
        F.max(of("scan")).alias("newest_scan"), F.max(of("imu")).alias("newest_sample"),
    ).drop("_kind", "_stamp")


def told(results: DataFrame, end: str) -> DataFrame:
    """``results`` with the metrics RESULTS: how many, and the newest ``end``."""
    return results.observe(RESULTS, F.count(F.lit(1)).alias("rows"), F.max(end).alias("newest_end"))


class Watch(StreamingQueryListener):
    """Totals of ARRIVALS and RESULTS as a query runs: ``ready`` once a scan and a sample have come, ``lag`` of results behind scans in seconds, ``behind`` beyond three frames."""

    def __init__(self, frame_duration: float = Config.frame_duration, say=None):
        self.frame_duration, self.say, self.came = frame_duration, say, threading.Event()
        self.scans = self.samples = self.dropped = self.rows = 0
        self.newest_scan = self.newest_sample = self.newest_end = None

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        self.take(event.progress.observedMetrics)

    def take(self, metrics: dict) -> None:
        later = lambda a, b: a if b is None else b if a is None else max(a, b)
        if (m := metrics.get(ARRIVALS)) is not None:
            self.scans, self.samples, self.dropped = self.scans + m.scans, self.samples + m.samples, self.dropped + m.dropped
            self.newest_scan, self.newest_sample = later(self.newest_scan, m.newest_scan), later(self.newest_sample, m.newest_sample)
        if (m := metrics.get(RESULTS)) is not None:
            self.rows, self.newest_end = self.rows + m.rows, later(self.newest_end, m.newest_end)
        if self.ready:
            self.came.set()
        if self.say is not None:
            self.say(self.line())

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    @property
    def ready(self) -> bool:
        return self.scans > 0 and self.samples > 0

    def wait_until_ready(self, timeout: float = 5.0) -> bool:
        """Whether at least one scan and one sample have come within ``timeout`` seconds."""
        return self.came.wait(timeout)

    @property
    def lag(self) -> float | None:
        return None if self.newest_scan is None or self.newest_end is None else self.newest_scan - self.newest_end

    @property
    def behind(self) -> bool:
        return self.lag is not None and self.lag > BEHIND_FRAMES * self.frame_duration

    def line(self) -> str:
        at = lambda t: "none" if t is None else f"{t:.3f}"
        lag = "" if self.lag is None else f", lag {1000 * self.lag:.0f} ms" + (" BEHIND" if self.behind else "")
        return f"{self.scans} scans (latest {at(self.newest_scan)}), {self.samples} samples (latest {at(self.newest_sample)}), {self.dropped} dropped, {self.rows} results{lag}"


class StatusLine(StreamingQueryListener):
    """Rows, rates and state sizes of each query, at most once in ``every`` seconds."""

    def __init__(self, every: float = 1.0, say=print):
        self.every, self.say, self.last = every, say, 0.0

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        if time.monotonic() - self.last < self.every:
            return
        self.last, p = time.monotonic(), event.progress
        held = sum(s.numRowsTotal for s in p.stateOperators)
        self.say(f"{p.name or p.id}: batch {p.batchId}, {p.numInputRows} rows, {p.inputRowsPerSecond:.0f}/s in, {p.processedRowsPerSecond:.0f}/s done, {held} keys held")

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
