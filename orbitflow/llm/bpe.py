"""Byte-level BPE encoding and decoding without a regex.

Pre-tokenisation maps code points to classes and looks at most two places ahead; that makes a small automaton, whose
transition functions form a finite monoid. Composition is associative, so the state before every character comes from a
blocked scan over monoid elements: rows of characters are composed independently, the rows' products are scanned, and
each row is replayed from its entry state, all as table look-ups on arrays. Slices then go through a cache of pair
merges. Token ids and byte offsets are kept, and decoding is the concatenation of the tokens' bytes.

Rows are independent: there is no shuffle, a lost task is just run again, and a task holds one batch of about a million
code points (or one longer text) at a time.

Defined results: a null text encodes as the empty text (no tokens); every row gives one row, repeated rows and null
doc_ids included; other columns pass through ``encode``.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import struct
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orbitflow.llm.common import CHUNK, slices, with_columns

L, N, O, LEAD, SOLO, RUN, APOS1, APOS2 = range(8)
"""Letter, number, other; white space: a blank before a non-space, another last space of a run, any other; apostrophes with one or two contraction letters."""
CLASSES = 8
FRESH, IN_L, IN_N, IN_O, AFTER_LEAD, IN_RUN, NEED1, NEED2 = range(8)
STATES = 8
#: Slices up to this many bytes merge by rescanning, longer ones with a heap.
SHORT = 48
#: Rank of a pair that does not merge.
NEVER = 1 << 60
CACHE = 200_000


def step(state: int, cls: int) -> tuple[int, bool]:
    """Next state, and whether a token starts at this character."""
    if state in (NEED1, NEED2):
        return (FRESH if state == NEED1 else NEED1), False
    joins = state == AFTER_LEAD
    if cls in (L, N):
        own = IN_L if cls == L else IN_N
        return own, not (joins or state == own)
    if cls == O or (cls in (APOS1, APOS2) and (joins or state == IN_O)):
        return IN_O, not (joins or state == IN_O)
    if cls in (APOS1, APOS2):
        return (NEED1 if cls == APOS1 else NEED2), True
    if cls == LEAD:
        return AFTER_LEAD, True
    if cls == SOLO:
        return FRESH, True
    return IN_RUN, state != IN_RUN


@lru_cache(1)
def machine() -> tuple[np.ndarray, ...]:
    """NEXT[state, symbol], STARTS[state, symbol], GEN[symbol] -> element, TIMES[a, b] (a, then b), APPLY[element, state]. Symbols from CLASSES on begin a text."""
    nxt = np.array([[step(FRESH if c >= CLASSES else s, c % CLASSES)[0] for c in range(2 * CLASSES)] for s in range(STATES)], np.uint8)
    starts = np.array([[c >= CLASSES or step(s, c)[1] for c in range(2 * CLASSES)] for s in range(STATES)])
    gens = [tuple(nxt[:, c].tolist()) for c in range(2 * CLASSES)]
    found = {tuple(range(STATES)): 0}
    todo = list(found)
    while todo:
        a = todo.pop()
        for g in gens:
            b = tuple(g[x] for x in a)
            if b not in found:
                found[b] = len(found)
                todo.append(b)
    kinds = list(found)
    times = np.array([[found[tuple(b[x] for x in a)] for b in kinds] for a in kinds], np.uint16)
    return nxt, starts, np.array([found[g] for g in gens], np.uint16), times, np.array(kinds, np.uint8)


def states_before(symbols: np.ndarray, state: int, width: int = 128) -> tuple[np.ndarray, int]:
    """State before each symbol and after the last one, by a blocked associative scan."""
    nxt, _, gen, times, apply = machine()
    n = len(symbols)
    rows = -(-n // width)
    ids = np.zeros(rows * width, np.uint16)
    ids[:n] = gen[symbols]
    ids = np.ascontiguousarray(ids.reshape(rows, width).T)
    whole = ids[0].copy()
    for j in range(1, width):
        whole = times[whole, ids[j]]
    step_ = 1
    while step_ < rows:  # the rows' products, by doubling
        whole[step_:] = times[whole[:-step_], whole[step_:]]
        step_ *= 2
    now = np.empty(rows, np.uint8)
    now[0] = state
    now[1:] = apply[whole[:-1], state]
    out = np.empty((width, rows), np.uint8)
    for j in range(width):
        out[j] = now
        now = apply[ids[j], now]
    flat = np.ascontiguousarray(out.T).reshape(-1)
    return flat[:n], int(apply[whole[-1], state])


def class_table() -> np.ndarray:
    """Class of every code point (L, N, O or RUN for white space), as the tokenizer library's own regex engine sees it."""
    import tiktoken

    points = np.r_[0:0xD800, 0xE000:0x110000].astype("<u4")
    text = points.tobytes().decode("utf-32-le")
    table = np.full(0x110000, O, np.uint8)
    for cls, pattern in ((L, r"\p{L}+"), (N, r"\p{N}+"), (RUN, r"\s+")):
        probe = tiktoken.Encoding("probe", pat_str=pattern, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
        table[np.frombuffer(bytes(probe.encode_ordinary(text)).decode().encode("utf-32-le"), "<u4")] = cls
    return table


def token_starts(points: np.ndarray, begins: np.ndarray, table: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """Positions where tokens start; ``begins`` are the positions of the texts' first characters."""
    n, state, out = len(points), FRESH, []
    _, starts, *_ = machine()
    first = np.zeros(n + 3, bool)
    first[begins] = True
    first[n:] = True
    for lo in range(0, n, chunk):
        hi = min(n, lo + chunk)
        ahead = np.zeros(hi - lo + 2, np.uint32)
        ahead[: min(n, hi + 2) - lo] = points[lo : hi + 2]
        cls, here, new = table[ahead], ahead[:-2], first[lo : hi + 3]
        sym = cls[:-2].copy()
        last = (sym == RUN) & (cls[1:-1] != RUN) & ~new[1:-2]
        sym[last] = np.where(here[last] == 0x20, LEAD, SOLO)
        for i in np.flatnonzero(here == 0x27):
            if not new[i + 1]:
                one = int(ahead[i + 1])
                if one in (0x73, 0x74, 0x6D, 0x64):  # s t m d
                    sym[i] = APOS1
                elif not new[i + 2] and (one, int(ahead[i + 2])) in ((0x72, 0x65), (0x76, 0x65), (0x6C, 0x6C)):  # re ve ll
                    sym[i] = APOS2
        sym[new[: hi - lo]] += CLASSES
        before, state = states_before(sym, state)
        out.append(np.flatnonzero(starts[before, sym]) + lo)
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one slice: the pair of lowest rank merges first, the leftmost of equals before others."""
    if piece in ranks:
        return [ranks[piece]]
    if len(piece) <= SHORT:
        # Only the two pairs beside a merge change, so their ranks are kept from step to step.
        get = ranks.get
        cuts = list(range(len(piece) + 1))
        pairs = [get(piece[i : i + 2], NEVER) for i in range(len(piece) - 1)]
        while pairs and (best := min(pairs)) != NEVER:
            i = pairs.index(best)
            del cuts[i + 1], pairs[i]
            if i < len(pairs):
                pairs[i] = get(piece[cuts[i] : cuts[i + 2]], NEVER)
            if i:
                pairs[i - 1] = get(piece[cuts[i - 1] : cuts[i + 1]], NEVER)
        return [ranks[piece[a:b]] for a, b in zip(cuts, cuts[1:])]
    end = list(range(1, len(piece) + 1))  # by the start of a part: its end; 0 once it is gone
    prev = list(range(-1, len(piece) - 1))

    def offer(i: int) -> None:
        if i >= 0 and end[i] < len(piece) and (r := ranks.get(piece[i : end[end[i]]])) is not None:
            heapq.heappush(heap, (r, i, end[i], end[end[i]]))

    heap: list = []
    for i in range(len(piece) - 1):
        offer(i)
    while heap:
        _, i, mid, stop = heapq.heappop(heap)
        if end[i] != mid or end[mid] != stop:
            continue
        end[i], end[mid] = stop, 0
        if stop < len(piece):
            prev[stop] = i
        offer(i)
        offer(prev[i])
    out, i = [], 0
    while i < len(piece):
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class Coder(dict):
    """A cache from slices to their ids as packed little-endian 32-bit integers; cleared when full."""

    def __init__(self, ranks: dict[bytes, int], table: np.ndarray):
        super().__init__()
        self.ranks, self.table = ranks, table
        self.token = [b""] * (max(ranks.values()) + 1)
        for t, r in ranks.items():
            self.token[r] = t
        self.packed = [struct.pack("<I", i) for i in range(len(self.token))]

    def __missing__(self, piece: bytes) -> bytes:
        if len(self) >= CACHE:
            self.clear()
        packed = b"".join(map(self.packed.__getitem__, merge(piece, self.ranks)))
        if len(piece) <= SHORT:
            self[piece] = packed
        return packed

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text."""
        lens = np.array([len(t) for t in texts], np.int64)
        ends = np.cumsum(lens)
        joined = "".join(texts)
        points = np.frombuffer(joined.encode("utf-32-le"), "<u4")
        raw = joined.encode()
        if not len(points):
            return [b""] * len(texts)
        starts = token_starts(points, (ends - lens)[lens > 0], self.table)
        if len(raw) == len(points):
            at = starts
        else:
            width = np.ones(len(points), np.uint8)
            for least in (0x80, 0x800, 0x10000):
                width += points >= least
            at = (np.cumsum(width, dtype=np.int64) - width)[starts]
        cuts = at.tolist()
        packed = list(map(self.__getitem__, [raw[a:b] for a, b in zip(cuts, cuts[1:] + [len(raw)])]))
        upto = np.searchsorted(starts, ends).tolist()
        out, lo = [], 0
        for hi in upto:
            out.append(b"".join(packed[lo:hi]))
            lo = hi
        return out

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.token.__getitem__, np.frombuffer(packed, "<u4").tolist()))

    def offsets(self, packed: bytes) -> np.ndarray:
        """Byte offset of each token's first byte in the text."""
        sizes = np.array([len(self.token[i]) for i in np.frombuffer(packed, "<u4").tolist()], np.int64)
        return np.cumsum(sizes) - sizes


def read_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}


_coders: dict[int, Coder] = {}


def coder(shared) -> Coder:
    """One per worker process and broadcast vocabulary."""
    if shared.id not in _coders:
        _coders.clear()
        data, table = shared.value
        _coders[shared.id] = Coder(read_ranks(data), np.frombuffer(table, np.uint8))
    return _coders[shared.id]


class Vocabulary:
    """The rank file (a few MB by its format) and the class table (1.1 MB), broadcast."""

    def __init__(self, spark: SparkSession, path: str):
        with open(path, "rb") as f:
            data = f.read()
        if len(data) > 64 << 20:
            raise ValueError("the rank file is larger than any vocabulary")
        self.sent = spark.sparkContext.broadcast((data, class_table().tobytes()))
        self.id = self.sent._jbroadcast.id()


def _with(df: DataFrame, vocabulary: Vocabulary, text: str, fields: list[T.StructField], row) -> DataFrame:
    """Append columns that ``row(coder, packed ids)`` gives for each text."""
    sent, ident = vocabulary.sent, vocabulary.id

    class Held:
        id = ident

        @property
        def value(self):
            return sent.value

    def make():
        work = coder(Held())

        def run(texts):
            rows = [row(work, p) for _, some in slices(texts) for p in work.encode(some)]
            return list(zip(*rows)) or [[]] * len(fields)

        return run

    return with_columns(df, [text], fields, make)


def encode(df: DataFrame, vocabulary: Vocabulary, text: str = "text") -> DataFrame:
    """``df`` with ``ids`` and ``offsets`` (byte offset of each token)."""
    fields = [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("offsets", T.ArrayType(T.LongType()))]
    return _with(df, vocabulary, text, fields, lambda c, p: (np.frombuffer(p, "<u4").astype(np.int32), c.offsets(p)))


def decode(df: DataFrame, vocabulary: Vocabulary, ids: str = "ids") -> DataFrame:
    """``df`` with ``decoded`` (binary), the concatenated bytes of the tokens; null ids give null."""
    sent, ident = vocabulary.sent, vocabulary.id

    @F.pandas_udf(T.BinaryType())
    def run(col: pd.Series) -> pd.Series:
        work = coder(type("Held", (), {"id": ident, "value": sent.value}))
        return col.map(lambda x: None if x is None else work.decode(np.asarray(x, "<u4").tobytes()))

    return df.withColumn("decoded", run(F.col(ids)))


def digests(df: DataFrame, vocabulary: Vocabulary, text: str = "text", ids: bool = False) -> DataFrame:
    """``df`` with ``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` (and the ``ids``): encoded, then decoded from the ids, in one pass."""
    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]

    if ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))

    def row(c: Coder, p: bytes):
        more = (np.frombuffer(p, "<i4"),) if ids else ()
        return len(p) // 4, hashlib.sha256(p).hexdigest(), hashlib.sha256(c.decode(p)).hexdigest(), *more

    return _with(df, vocabulary, text, fields, row)
