"""The discrete Fourier transform of series that no task could hold, of any length.

A series of n values becomes a convolution with a chirp (Bluestein), for which any length m >= 2 n - 1 will do; m = R C is a power of two. Value i stands in row i // C and column
i % C of a matrix. One pass transforms columns and turns the results by twiddle factors, a second transforms rows, multiplies by the chirp's
transform, which went along as one more channel, and transforms rows back; a third transforms columns back. Between passes blocks of the matrix are
dealt out anew: two shuffles of at most 4 n values a channel, n log n work, and no task holds more than ``cells`` cells or a column.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Cells of the matrix that a task holds at once, unless one row or column is longer.
CELLS = 1 << 17
_BLOCK = "recording_id string, _n long, line long, block long, cells binary"


def chirp(v: np.ndarray, n: int) -> np.ndarray:
    return np.exp(-1j * np.pi * ((v * v) % (2 * n)) / n)


def shape(n: int) -> tuple[int, int]:
    """(R, C): rows and columns of the matrix for n values."""
    bits = (2 * n - 2).bit_length()
    return 1 << (bits + 1) // 2, 1 << bits // 2


def _width(lines: int, other: int, cells: int) -> int:
    """Neighbouring columns (rows) of a block, for columns (rows) of so many cells."""
    return min(other, max(1, cells // lines))


def _blocks(name: str, n: int, own: int, parts: list[tuple[int, np.ndarray]]) -> pa.Table:
    cols = [[name] * len(parts), [n] * len(parts), [line for line, _ in parts], [own] * len(parts), [np.ascontiguousarray(a).tobytes() for _, a in parts]]
    return pa.table({f.split(" ")[0]: pa.array(c, t) for f, c, t in zip(_BLOCK.split(", "), cols, (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))})


def _gathered(table: pa.Table, channels: int, rows: int, width: int) -> np.ndarray:
    """Blocks (rows, width, channels) side by side, in the order of ``block``."""
    some = sorted(zip(table["block"].to_pylist(), table["cells"].to_pylist()))
    return np.concatenate([np.frombuffer(c, complex).reshape(rows, width, channels) for _, c in some], 1)


def transform(series: DataFrame, columns: list[str], cells: int = CELLS) -> DataFrame:
    """recording_id, _n, k, and re_ and im_ of each of ``columns``, for the frequencies 0 to _n / 2.

    ``series`` has recording_id, _n (its length, 8 at least), _i (0, 1, ...) and the columns.
    """
    many = len(columns)
    bits = F.length(F.bin(2 * F.col("_n") - 2))
    rows, cols = (F.call_function("shiftleft", F.lit(1).cast("long"), F.floor(b / 2).cast("int")) for b in (bits + 1, bits))
    width = F.least(cols, F.greatest(F.lit(1).cast("long"), F.floor(F.lit(cells) / rows)))
    placed = series.select("recording_id", "_n", "_i", *columns, F.floor((F.col("_i") % cols) / width).alias("block"))

    def down(table: pa.Table) -> pa.Table:
        """Columns of samples, and of the chirp, to columns of frequencies, cut into blocks of rows."""
        name, n, own = (table[c][0].as_py() for c in ("recording_id", "_n", "block"))
        r, c = shape(n)
        wide, m = _width(r, c, cells), r * c
        at = table["_i"].to_numpy()
        a = np.zeros((r, wide, many + 1), complex)
        a[at // c, at % c - own * wide, :many] = np.stack([table[x].to_numpy() for x in columns], 1) * chirp(at, n)[:, None]
        i = np.arange(r)[:, None] * c + own * wide + np.arange(wide)
        near = np.minimum(i, m - i)
        a[:, :, many] = np.where(near < n, chirp(near, n).conj(), 0)
        y = np.fft.fft(a, axis=0) * np.exp(-2j * np.pi * (np.arange(r)[:, None] * (own * wide + np.arange(wide)) % m) / m)[:, :, None]
        tall = _width(c, r, cells)
        return _blocks(name, n, own, [(k, y[k * tall : (k + 1) * tall]) for k in range(r // tall)])

    def across(table: pa.Table) -> pa.Table:
        """Whole rows: to frequencies, times the chirp's, and back."""
        name, n, line = (table[c][0].as_py() for c in ("recording_id", "_n", "line"))
        r, c = shape(n)
        tall, wide, m = _width(c, r, cells), _width(r, c, cells), r * c
        x = np.fft.fft(_gathered(table, many + 1, tall, wide), axis=1)
        z = np.fft.ifft(x[:, :, :many] * x[:, :, many:], axis=1) * np.exp(2j * np.pi * ((line * tall + np.arange(tall))[:, None] * np.arange(c) % m) / m)[:, :, None]
        return _blocks(name, n, line, [(k, z[:, k * wide : (k + 1) * wide]) for k in range(c // wide)])

    def up(table: pa.Table) -> pa.Table:
        """Columns back; their values are the frequencies of the series, but for a turn."""
        name, n, line = (table[c][0].as_py() for c in ("recording_id", "_n", "line"))
        r, c = shape(n)
        tall, wide = _width(c, r, cells), _width(r, c, cells)
        some = sorted(zip(table["block"].to_pylist(), table["cells"].to_pylist()))
        z = np.concatenate([np.frombuffer(b, complex).reshape(tall, wide, many) for _, b in some], 0)
        k = (np.arange(r)[:, None] * c + line * wide + np.arange(wide)).reshape(-1)
        y = np.fft.ifft(z, axis=0).reshape(-1, many)[k <= n // 2]
        k = k[k <= n // 2]
        y = y * chirp(k, n)[:, None]
        return pa.table({"recording_id": pa.array([name] * len(k), pa.string()), "_n": pa.array(np.full(len(k), n)), "k": pa.array(k), **{f"re_{x}": pa.array(np.ascontiguousarray(y[:, j].real)) for j, x in enumerate(columns)}, **{f"im_{x}": pa.array(np.ascontiguousarray(y[:, j].imag)) for j, x in enumerate(columns)}})

    lines = placed.groupBy("recording_id", "_n", "block").applyInArrow(down, _BLOCK)
    lines = lines.groupBy("recording_id", "_n", "line").applyInArrow(across, _BLOCK)
    fields = ", ".join([*(f"re_{c} double" for c in columns), *(f"im_{c} double" for c in columns)])
    return lines.groupBy("recording_id", "_n", "line").applyInArrow(up, f"recording_id string, _n long, k long, {fields}")
