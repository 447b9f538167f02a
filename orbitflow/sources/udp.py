"""Datagrams from a socket.

``capture`` drains a port into a recording, the durable form. ``UdpStream`` is a streaming source for looking at live data; a socket
cannot be read twice, so what it delivers is at-most-once, and a pipeline that must not lose data streams over recorded files instead.
"""

from __future__ import annotations

import socket
import threading
import time
from collections import deque
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from orbitflow import schemas
from orbitflow.functions.codec import HEADER, MAX_POINTS, POINT, SCAN_HEAD, decode_batch, unpack
from orbitflow.operators.buffers import checked

# Defaults of the receiver.
PORT, ANY, BUFFER, SO_RCVBUF = 12345, "0.0.0.0", 65536, 1 << 20
SMALLEST = HEADER.size + SCAN_HEAD.size + MAX_POINTS * POINT.itemsize


class Receiver:
    """A bound socket; ``raw`` gives datagrams, ``receive_once`` one decoded message or None."""

    def __init__(self, port: int = PORT, ip: str = ANY, timeout: float = 1.0, buffer_size: int = BUFFER, so_rcvbuf: int | None = SO_RCVBUF):
        if buffer_size < SMALLEST:
            raise ValueError(f"buffer_size must be at least {SMALLEST}")
        self.address, self.timeout, self.buffer_size, self.so_rcvbuf, self.socket = (ip, port), timeout, buffer_size, so_rcvbuf, None

    def open(self) -> Receiver:
        if self.socket is not None:
            raise RuntimeError("already open")
        self.socket = socket.socket(socket.AF_INET, socket.SOCK_DGRAM)
        if self.so_rcvbuf:
            self.socket.setsockopt(socket.SOL_SOCKET, socket.SO_RCVBUF, self.so_rcvbuf)
        self.socket.bind(self.address)
        self.socket.settimeout(self.timeout)
        return self

    def close(self) -> None:
        if self.socket is not None:
            self.socket.close()
            self.socket = None

    def __enter__(self) -> Receiver:
        return self.open()

    def __exit__(self, *_) -> None:
        self.close()

    def datagram(self) -> tuple[float, bytes] | None:
        if self.socket is None:
            raise RuntimeError("not open")
        try:
            data = self.socket.recvfrom(self.buffer_size)[0]
        except (TimeoutError, socket.timeout):
            return None
        return time.time(), data

    def receive_once(self) -> dict | None:
        got = self.datagram()
        row = decode_batch([got[1]])[0].as_py() if got else None
        return row if row and row["msg_type"] else None

    def raw(self, duration: float | None = None) -> Iterator[tuple[float, bytes]]:
        ends = None if duration is None else time.monotonic() + duration
        while ends is None or time.monotonic() < ends:
            if (got := self.datagram()) is not None:
                yield got


def capture(path: str, duration: float, **receiver) -> tuple[int, int]:
    """Record a port for ``duration`` seconds; datagrams and bytes written."""
    from orbitflow.sources.rawlog import write_records

    with Receiver(**receiver) as r, open(path, "wb") as f:
        return write_records(f, r.raw(duration))


class Buffered:
    """A port drained by a thread into two bounded histories, of scans and of inertial samples, oldest dropped first; a context manager.

    For looking at what comes in; a reader that must not miss anything records. ``latest`` and ``held`` read, ``drain`` hands over and empties; counters go on.
    """

    def __init__(self, scan_maxlen: int = 360, imu_maxlen: int = 500, **receiver):
        self.buffers = {"scan": deque(maxlen=checked(scan_maxlen)), "imu": deque(maxlen=checked(imu_maxlen))}
        self.counts = dict.fromkeys(("scan_received", "imu_received", "scan_dropped", "imu_dropped", "unparsed"), 0)
        self.receiver, self.news, self.running = Receiver(**receiver), threading.Condition(), False

    def take(self, data: bytes) -> None:
        message = unpack(data)
        with self.news:
            if message is None:
                self.counts["unparsed"] += 1
                return
            kind, buffer = message[0], self.buffers[message[0]]
            self.counts[f"{kind}_received"] += 1
            self.counts[f"{kind}_dropped"] += len(buffer) == buffer.maxlen
            buffer.append(message)
            self.news.notify_all()

    def latest(self, kind: str) -> tuple | None:
        with self.news:
            return self.buffers[kind][-1] if self.buffers[kind] else None

    def held(self, kind: str) -> list[tuple]:
        with self.news:
            return list(self.buffers[kind])

    def drain(self, kind: str) -> list[tuple]:
        with self.news:
            out = list(self.buffers[kind])
            self.buffers[kind].clear()
            return out

    def wait_for_new(self, kind: str, timeout: float | None = None) -> tuple | None:
        """The newest message of a kind once another one has come, or None."""
        with self.news:
            before = self.counts[f"{kind}_received"]
            came = self.news.wait_for(lambda: self.counts[f"{kind}_received"] > before, timeout)
            return self.buffers[kind][-1] if came and self.buffers[kind] else None

    def stats(self) -> dict[str, int]:
        with self.news:
            return self.counts | {f"{k}_held": len(b) for k, b in self.buffers.items()}

    def __enter__(self) -> Buffered:
        self.receiver.open()
        self.running = True

        def fill():
            while self.running:
                if (got := self.receiver.datagram()) is not None:
                    self.take(got[1])

        self.thread = threading.Thread(target=fill, daemon=True)
        self.thread.start()
        return self

    def __exit__(self, *_) -> None:
        self.running = False
        self.thread.join()
        self.receiver.close()


class _Live(SimpleDataSourceStreamReader):
    """Buffers in a thread, oldest datagrams dropped when ``maxlen`` are waiting; offsets count what was handed over."""

    def __init__(self, options: dict):
        self.name, self.seq = options.get("recording_id", "live"), 0
        self.held: deque = deque(maxlen=int(options.get("maxlen", 8192)))
        self.sent: deque = deque(maxlen=16)
        self.receiver = Receiver(int(options.get("port", PORT)), options.get("ip", ANY), 0.2)
        self.started = False

    def _start(self) -> None:
        self.started = True
        self.receiver.open()

        def drain():
            for row in self.receiver.raw():
                self.held.append(row)

        threading.Thread(target=drain, daemon=True).start()

    def initialOffset(self):
        return {"seq": 0}

    def read(self, start):
        if not self.started:
            self._start()
            self.seq = start["seq"]
        rows = []
        while self.held:
            at, data = self.held.popleft()
            rows.append((self.name, self.seq, at, data))
            self.seq += 1
        self.sent.append((start["seq"], self.seq, rows))
        return iter(rows), {"seq": self.seq}

    def readBetweenOffsets(self, start, end):
        return iter([r for a, b, rows in self.sent if a >= start["seq"] and b <= end["seq"] for r in rows])

    def commit(self, end):
        while self.sent and self.sent[0][1] < end["seq"]:
            self.sent.popleft()


class UdpStream(DataSource):
    """``readStream.format("udp")`` with options port, ip, maxlen and recording_id."""

    @classmethod
    def name(cls):
        return "udp"

    def schema(self):
        return schemas.DATAGRAMS

    def simpleStreamReader(self, schema):
        return _Live(self.options)
