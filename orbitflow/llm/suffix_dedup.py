"""Exact repeats of 400 bytes with a logarithmic family of suffix indexes.

*Suffixes.* Of each text only the suffixes at content-defined places are kept: in every 272 neighbouring 32-byte grams the one
of least hash, the leftmost of equals. Two equal 400-byte windows have their first such place at the same offset, so a window is
repeated only if the 129 bytes from its place on are. A suffix is compared by its first four bytes and a 64-bit hash of the 129.

*Family.* Documents fall into batches. A batch becomes a sorted suffix array (a table bucketed and sorted by suffix), is
merge-scanned against each level for suffixes in both (bucketed sort-merge joins, nothing is shuffled again), and then
joins the family: levels of equal size merge, like the digits of a binary counter. A further batch thus meets few levels.

*Windows.* A place with its windows is a block. Blocks whose whole bytes occur twice are settled (this is nearly all of copied text,
thousands of copies meet as one row with a count). Of the rest, windows are hashed and compared with the windows of the
same suffix's other distinct blocks: up to ``CROWD`` blocks of a suffix lie in one task. The blocks of a suffix that more surround are sorted by the
bytes from the place on and then by those before it, read backwards. The common prefixes of neighbours in these two orders bound how far each
block agrees with any other, only windows within both bounds are left, and these meet as rows of a shuffle. Nothing is left out either way, and no
task holds more than ``CROWD`` blocks of a suffix. Equality of windows is that of 128-bit hashes.

Texts are shuffled only where a bounded filter says that a document takes part. Every step can be run again after a loss:
tables lie in the shared folder.

Defined results: null and empty texts have 0 bytes and nothing removed. Rows are told apart by doc_id and text; fully equal
rows are copies of each other and both lose their repeated bytes. A null doc_id is kept as it is; extra columns are ignored.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orbitflow.llm.common import Scratch, bounded, join_to_keys, maybe_in, parts, with_columns

LENGTH, GRAM, SPAN = 400, 32, 272
#: Bytes of a suffix that are compared: those that a window always holds from its place on.
COMPARED = LENGTH - SPAN + 1
BATCHES = 4
#: Distinct blocks of a suffix that one task compares.
CROWD = 256
#: Neighbouring windows of a crowded block that are hashed as one.
RUN = 16
#: Window starts that are handled at once in a long text.
PIECE = 1 << 20
_U = np.uint64
SPANS = "array<struct<start:bigint,stop:bigint>>"


def _least(v: np.ndarray, width: int) -> np.ndarray:
    """Sliding minimum by doubling."""
    have = 1
    while have * 2 <= width:
        v, have = np.minimum(v[:-have], v[have:]), have * 2
    return np.minimum(v[: len(v) - (width - have)], v[width - have :]) if have < width else v


def places(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, first window, last window) of each block; every window of LENGTH bytes is in just one."""
    out = []
    for lo in range(0, len(raw) - LENGTH + 1, PIECE):
        some = np.frombuffer(raw, np.uint8, min(len(raw) - lo, PIECE + LENGTH - 1), lo)
        h, have = some.astype(_U), 1
        while have < GRAM:
            h, have = h[:-have] * _U(pow(0x9E3779B97F4A7C15, have, 1 << 64)) + h[have:], have * 2
        h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
        v = (h & _U(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=_U)
        at = (_least(v, SPAN)[: len(some) - LENGTH + 1] & _U(0xFFFFFFFF)).astype(np.int64)
        cut = np.flatnonzero(np.diff(at)) + 1
        first, last = np.r_[0, cut], np.r_[cut, len(at)] - 1
        out.append((at[first] + lo, first + lo, last + lo))
    if not out:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*out))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _suffixes(batches):
    for pdf in batches:
        for lo in range(0, len(pdf), 500):
            rows: list = []
            for doc, h, batch, text in zip(*(pdf[c].iloc[lo : lo + 500].tolist() for c in ("doc_id", "h", "batch", "text"))):
                raw = text.encode()
                for p, a, b in zip(*(x.tolist() for x in places(raw))):
                    suffix = raw[p : p + 4] + xxhash.xxh3_64_digest(raw[p : p + COMPARED])
                    rows.append((batch, doc, h, p, a, b, suffix, _signed(xxhash.xxh3_64_intdigest(raw[a : b + LENGTH], p - a))))
            yield pd.DataFrame(rows, columns=["batch", "doc_id", "h", "place", "first", "last", "suffix", "block"])


class Family:
    """Levels of suffix tables; ``add`` scans a batch against them, then merges levels of equal size."""

    def __init__(self, scratch: Scratch):
        self.scratch, self.spark, self.levels, self.found = scratch, scratch.spark, [], []
        self.buckets = parts(self.spark)

    def _table(self, df: DataFrame) -> str:
        name = f"suffixes_{uuid.uuid4().hex}"
        writer = df.repartition(self.buckets, "suffix").write.format("parquet").option("path", f"{self.scratch.root}/{name}")
        writer.bucketBy(self.buckets, "suffix").sortBy("suffix").saveAsTable(name)
        return name

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.scratch.delete(f"{self.scratch.root}/{name}")

    def add(self, suffixes: DataFrame) -> None:
        own = self._table(suffixes.groupBy("suffix").agg(F.count("*").alias("n")))
        array, hits = self.spark.table(own), [self.spark.table(own).where("n > 1").select("suffix")]
        hits += [array.join(self.spark.table(x).hint("merge"), "suffix", "left_semi").select("suffix") for x, _ in self.levels]
        every = hits[0]
        for x in hits[1:]:
            every = every.union(x)
        self.found.append(self.scratch.keep(every, "hits"))
        level = (own, 1)
        while self.levels and self.levels[-1][1] == level[1]:
            other = self.levels.pop()
            merged = self.spark.table(level[0]).union(self.spark.table(other[0])).groupBy("suffix").agg(F.sum("n").alias("n"))
            name = self._table(merged)
            self._drop(level[0])
            self._drop(other[0])
            level = (name, level[1] * 2)
        self.levels.append(level)

    def repeated(self) -> DataFrame:
        """Suffixes that occur more than once."""
        every = self.found[0]
        for x in self.found[1:]:
            every = every.union(x)
        return every.distinct()

    def close(self) -> None:
        for name, _ in self.levels:
            self._drop(name)


def _blocks(batches):
    """Bytes of the wanted blocks of each text."""
    for pdf in batches:
        for text, want in zip(pdf["text"], pdf["want"]):
            raw = text.encode()
            rows = [{**x, "raw": raw[x["first"] : x["last"] + LENGTH]} for x in want]
            yield pd.DataFrame(rows)[_BLOCK]


_BLOCK = ["suffix", "doc_id", "h", "place", "first", "last", "n", "raw"]
_BLOCK_TYPES = "suffix binary, doc_id long, h long, place long, first long, last long, n long, raw binary"


def _window_hashes(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, window start, 128-bit hash) of every window of the blocks; equal windows have their place at the same offset."""
    row, start, out = [], [], []
    for r, (place, first, last, raw) in enumerate(zip(pdf["place"], pdf["first"], pdf["last"], pdf["raw"])):
        for s in range(first, last + 1):
            out.append(xxhash.xxh3_128_digest(raw[s - first : s - first + LENGTH], place - s))
        row.append(np.full(last - first + 1, r))
        start.append(np.arange(first, last + 1))
    return np.concatenate(row), np.concatenate(start), np.frombuffer(b"".join(out), "V16")


def _settle(pdf: pd.DataFrame) -> pd.DataFrame:
    row, start, digest = _window_hashes(pdf)
    a, b = digest.view("<u8").reshape(-1, 2).T
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    equal = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
    twice = np.zeros(len(order), bool)
    twice[order] = np.r_[False, equal] | np.r_[equal, False]
    good = np.flatnonzero(twice & (pdf["n"].to_numpy()[row] == 1))
    if not len(good):
        return pd.DataFrame({"doc_id": [], "h": [], "start": [], "stop": []}).astype("int64")
    cut = np.flatnonzero((np.diff(row[good]) != 0) | (np.diff(start[good]) != 1)) + 1
    a, b = good[np.r_[0, cut]], good[np.r_[cut, len(good)] - 1]
    own = pdf.iloc[row[a]]
    return pd.DataFrame({"doc_id": own["doc_id"].to_numpy(), "h": own["h"].to_numpy(), "start": start[a], "stop": start[b] + LENGTH})


def _settled(batches):
    """Batches come sorted by suffix; a suffix's blocks are settled together."""
    held = None
    for pdf in batches:
        held = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
        while len(held) > 2000:
            ends = np.flatnonzero((held["suffix"].shift() != held["suffix"]).to_numpy())
            ends = ends[ends > 0]
            if not len(ends):
                break
            cut = ends[ends <= 2000][-1] if (ends <= 2000).any() else ends[0]
            yield _settle(held.iloc[:cut].reset_index(drop=True))
            held = held.iloc[cut:].reset_index(drop=True)
    if held is not None and len(held):
        yield _settle(held)


def _sides(batches):
    """Blocks with the bytes from the place on, and those before it, backwards."""
    for pdf in batches:
        at = (pdf["place"] - pdf["first"]).tolist()
        yield pdf.assign(right=[r[k : k + LENGTH] for r, k in zip(pdf["raw"], at)], left=[r[:k][::-1] for r, k in zip(pdf["raw"], at)])


def _common(one: list[bytes], two: list[bytes]) -> np.ndarray:
    """Length of the common prefix of each pair."""
    n = np.array([min(len(a), len(b)) for a, b in zip(one, two)], np.int64)
    wide = int(n.max(initial=0))
    if not wide:
        return n
    x, y = (np.frombuffer(b"".join(v[:wide].ljust(wide, b"\0") for v in side), np.uint8).reshape(-1, wide) for side in (one, two))
    differ = x != y
    return np.minimum(n, np.where(differ.any(1), differ.argmax(1), wide))


def _longest(side: str, out: str):
    """Adds the longest common prefix of ``side`` with a neighbour of the same suffix, for rows sorted by suffix and side; at the ends of a partition, where a neighbour may
    lie in another task, the whole length."""

    def run(batches):
        last = None
        for pdf in batches:
            for lo in range(0, len(pdf), 1000):
                some = pdf.iloc[lo : lo + 1000].reset_index(drop=True)
                if last is not None:
                    some = pd.concat([last, some], ignore_index=True)
                key, own = some["suffix"].tolist(), some[side].tolist()
                between = np.where([a == b for a, b in zip(key[1:], key[:-1])], _common(own[1:], own[:-1]), 0)
                before = np.r_[last[out].iloc[0] if last is not None else len(own[0]), between]
                done = np.maximum(before, np.r_[between, 0]).astype(np.int64)
                done[-1] = before[-1]
                last = some.iloc[-1:].assign(**{out: int(before[-1])})
                if len(some) > 1:
                    yield some.assign(**{out: done}).iloc[:-1]
        if last is not None:
            yield last.assign(**{out: len(last[side].iloc[0])})

    return run


def _run_rows(batches):
    """Hashes of the windows that agree with another block's as far as ``l`` and ``r`` can tell: runs of RUN neighbouring windows at equal distances from the place as one
    row with their bytes, those before and after as one row each."""
    for pdf in batches:
        for at in range(0, len(pdf), 500):
            some, rows = pdf.iloc[at : at + 500], []
            lo = np.maximum(some["first"], some["place"] - some["l"])
            hi = np.minimum(some["last"], some["place"] + some["r"] - LENGTH)
            for doc, h, place, first, raw, s, end in zip(some["doc_id"].tolist(), some["h"].tolist(), some["place"].tolist(), some["first"].tolist(), some["raw"], lo.tolist(), hi.tolist()):
                while s <= end:
                    n = RUN if (place - s) % RUN == RUN - 1 and s + RUN - 1 <= end else 1
                    own = raw[s - first : s - first + n - 1 + LENGTH]
                    rows.append((xxhash.xxh3_128_digest(own, place - s), doc, h, s, n, place, own if n > 1 else None))
                    s += n
            yield pd.DataFrame(rows, columns=["w", "doc_id", "h", "start", "n", "place", "raw"])


def _single_rows(batches):
    """The windows of runs, one by one."""
    for pdf in batches:
        for at in range(0, len(pdf), 500):
            some = pdf.iloc[at : at + 500].reset_index(drop=True)
            row, start, digest = _window_hashes(some.assign(first=some["start"], last=some["start"] + some["n"] - 1))
            yield pd.DataFrame({"w": [bytes(x) for x in digest.view("V16")], "doc_id": some["doc_id"].to_numpy()[row], "h": some["h"].to_numpy()[row], "start": start})


def _crowded(blocks: DataFrame, scratch: Scratch) -> DataFrame:
    """Spans of the blocks (with ``raw``) of suffixes that many distinct blocks surround."""
    n, two, sampled = parts(scratch.spark), "right binary, left binary", "spark.sql.execution.rangeExchange.sampleSizePerPartition"
    before = scratch.spark.conf.get(sampled)
    scratch.spark.conf.set(sampled, 10)  # keys hold up to LENGTH bytes, and the driver gets the sample
    sided = blocks.mapInPandas(_sides, f"{_BLOCK_TYPES}, {two}")
    # The order of doc_id spreads blocks that are alike on one side over several tasks.
    for side, out, types in (("right", "r", f"{_BLOCK_TYPES}, {two}, r long"), ("left", "l", f"{_BLOCK_TYPES}, {two}, r long, l long")):
        keys = ["suffix", side, "doc_id", "h", "place"]
        sided = scratch.keep(sided, "crowd").repartitionByRange(n, *keys).sortWithinPartitions(*keys).mapInPandas(_longest(side, out), types)
    one = "w binary, doc_id long, h long, start long"
    rows = scratch.keep(sided.drop("left", "right").mapInPandas(_run_rows, f"{one}, n long, place long, raw binary"), "windows")
    scratch.spark.conf.set(sampled, before)
    # Equal runs meet as one row with a count and go whole; single windows are compared between different runs, and what lies around runs.
    runs = rows.where("n > 1")
    kinds = scratch.keep(runs.groupBy("w").agg(F.count("*").alias("k"), F.min(F.struct("doc_id", "h", "start", "n", "place", "raw")).alias("at")), "runs")
    copied = kinds.where("k > 1").select("w")
    whole = maybe_in(runs, copied, "w").join(copied, "w", "left_semi").select("doc_id", "h", "start", (F.col("start") + F.col("n") - 1 + LENGTH).alias("stop"))
    singles = kinds.select("at.*").mapInPandas(_single_rows, one)
    singles = scratch.keep(singles.unionByName(rows.where("n = 1").select("w", "doc_id", "h", "start")), "singles")
    twice = singles.groupBy("w").count().where("count > 1").select("w")
    return whole.unionByName(maybe_in(singles, twice, "w").join(twice, "w", "left_semi").select("doc_id", "h", "start", (F.col("start") + LENGTH).alias("stop")))


def _cut():
    """Texts without their spans, merged."""

    def run(texts, all_spans):
        rows = []
        for text, own in zip(texts, all_spans):
            raw, out, merged, at = (text or "").encode(), [], [], 0
            for a, b in sorted((x["start"], x["stop"]) for x in own or []):
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(b, merged[-1][1])
                else:
                    merged.append([a, b])
            for a, b in merged:
                out.append(raw[at:a])
                at = b
            kept = b"".join([*out, raw[at:]])
            rows.append((len(raw), kept, [{"start": a, "stop": b} for a, b in merged], text if text is None else kept.decode(errors="replace")))
        return list(zip(*rows)) or [[]] * 4

    return run


def _repeats(docs: DataFrame, scratch: Scratch, batches: int) -> DataFrame:
    """doc_id, h and the spans (start, stop) to remove, not yet merged; ``docs`` has doc_id, text and h."""
    long_ones = docs.where(f"octet_length(text) >= {LENGTH}")
    dealt = long_ones.withColumn("batch", F.pmod(F.xxhash64("doc_id", "h"), F.lit(batches)).cast("int"))
    all_ = scratch.keep(dealt.mapInPandas(_suffixes, "batch int, doc_id long, h long, place long, first long, last long, suffix binary, block long"), "suffixes", "batch")
    family = Family(scratch)
    for b in range(batches):
        family.add(all_.where(F.col("batch") == b).select("suffix"))
    repeated = scratch.keep(family.repeated(), "repeated")
    family.close()
    # Rows stay where they were read: a suffix or block with very many of them is counted before the shuffle and dealt out where it is joined.
    key = F.concat("suffix", F.col("block").cast("string").cast("binary"))
    hit = scratch.keep(maybe_in(all_, repeated, "suffix").drop("batch").withColumn("key", key), "hit")
    scratch.drop(all_)
    blocks = hit.groupBy("key", "suffix").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "h", "place", "first", "last")).alias("at"))
    blocks = scratch.keep(blocks, "blocks")
    copied = blocks.where("n > 1").select("key", "n", F.lit(True).alias("copied"))
    whole = join_to_keys(hit, copied, "key", "n", "doc_id").where("copied")
    whole = whole.select("doc_id", "h", F.col("first").alias("start"), (F.col("last") + LENGTH).alias("stop"))
    open_ = blocks.groupBy("suffix").agg(F.count("*").alias("k"), F.count(F.when(F.col("n") == 1, 1)).alias("r")).where("k > 1 AND r > 0")
    want = join_to_keys(blocks, open_.select("suffix", "k", F.col("k").alias("members")), "suffix", "members", "key").where("k IS NOT NULL")
    want = scratch.keep(want.select("suffix", "n", "k", "at.*"), "want")

    def raw(some: DataFrame) -> DataFrame:
        by_doc = some.groupBy("doc_id", "h").agg(F.collect_list(F.struct("suffix", "doc_id", "h", "place", "first", "last", "n")).alias("want"))
        texts = maybe_in(long_ones, by_doc, "h")
        return texts.join(by_doc, ["doc_id", "h"]).select("text", "want").mapInPandas(_blocks, _BLOCK_TYPES)

    small = raw(want.where(f"k <= {CROWD}")).repartition(parts(docs.sparkSession), "suffix").sortWithinPartitions("suffix")
    settled = small.mapInPandas(_settled, "doc_id long, h long, start long, stop long")
    spans = whole.unionByName(settled)
    crowded = want.where(f"k > {CROWD}")
    if not crowded.isEmpty():
        spans = spans.unionByName(_crowded(raw(crowded), scratch))
    return scratch.keep(spans, "spans")


def remove_repeats(df: DataFrame, scratch: Scratch | None = None, batches: int = BATCHES) -> DataFrame:
    """doc_id, n_bytes, kept (binary: the remaining bytes), spans (removed runs) and text (what remains, characters cut in two as U+FFFD; null stays null)
    for each row of ``df(doc_id, text)``."""
    scratch = scratch or Scratch(df.sparkSession, "suffix")
    bounded(df.sparkSession)
    docs = df.select(F.col("doc_id").cast("long").alias("own_id"), "text", F.xxhash64("text").alias("h"))
    # Inside, a null id is the smallest number: rows that then look alike have the same text, and so the same result.
    docs = docs.withColumn("doc_id", F.coalesce("own_id", F.lit(-(1 << 63))))
    by_doc = _repeats(docs, scratch, batches).groupBy("doc_id", "h").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    flagged = maybe_in(docs, by_doc, "h", keep_all=True)
    joined = flagged.where("maybe").join(by_doc, ["doc_id", "h"], "left").select(F.col("own_id").alias("doc_id"), "text", "spans")
    fields = [T.StructField("n_bytes", T.LongType()), T.StructField("kept", T.BinaryType()), T.StructField("spans", T._parse_datatype_string(SPANS)), T.StructField("text", T.StringType())]
    cut = with_columns(joined, ["text", "spans"], fields, _cut)
    raw = F.coalesce("text", F.lit("")).cast("binary")
    plain = flagged.where("NOT maybe").select(F.col("own_id").alias("doc_id"), F.octet_length(raw).cast("long").alias("n_bytes"), raw.alias("kept"), F.array().cast(SPANS).alias("spans"), "text")
    return cut.unionByName(plain)
