"""Passages that an earlier document has: suffix automata of reference shards, which documents stream through for matching statistics.

*Reference.* Of every run of ``LENGTH`` words that two documents share, the first document's copy is reference text, so each such run is there once or few times, however many
copies there are. Which runs these are is found from 64-bit hashes, from coarse to fine. Of the grams of ``GRAM`` words in a run, the one of least hash stands for it (equal
runs have equal ones), and the neighbouring runs of one gram are a block: only blocks whose gram two documents have go on. A block that an earlier document has as well, whole, is
settled as a row. Of the others, and of each block's first copy, single runs are counted: they alone can lead to what an earlier document has in other surroundings, as the first
document with a run has it in the first copy of some block. Filters of at most ``MOST_BITS`` bits, sized by their keys, leave rows out before shuffles; the more they
let through, the more rows the exact step that follows has.

*Shards.* The reference text of a document lies in one of many shards, each of about ``SHARD`` runs. A broadcast of every shard to every task would cost shards times documents;
a document goes only where the first copy of one of its runs lies, and a shard that very many words come to is there several times, one copy for each ``LOAD`` of them. A task
reads a shard's reference words, builds its suffix automaton, and streams the documents' words through it: the length of the longest match
that ends at each word, and the smallest document it occurs in, decide. Hashes only say where to look; what is removed has been matched word by word.

Defined results: null and blank texts have no words. Rows are told apart by doc_id and text, repeated rows get the same result. A row without doc_id loses nothing and takes
nothing from others. Rows that share a doc_id are the same document to each other. Kept words are joined by one space, a text that loses nothing too. Extra columns are ignored.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orbitflow.llm.common import Scratch, bounded, maybe_in, parts, pieces, slices, with_columns

LENGTH, GRAM = 13, 5
#: Reference runs of a shard, and words that are streamed through one copy of a shard.
SHARD, LOAD = 1 << 16, 1 << 20
#: Runs of a block at most, which is what one gram can stand for in a row, and bits of a hash that is kept of a gram.
WIDEST, GRAM_BITS = LENGTH - GRAM + 1, 40
#: Bits of a filter for each of its keys, and of the largest filter.
BITS_PER_KEY, MOST_BITS = 8, 1 << 25
#: Bytes of a text whose words are hashed at once.
PIECE = 1 << 20
_U = np.uint64
_ODD = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = []


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def _powers_to(n: int) -> list[np.ndarray]:
    """Powers of _ODD and of its inverse modulo 2^64, at least n of each."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, PIECE)
        _powers[:] = [np.multiply.accumulate(np.r_[_U(1), np.full(size - 1, b, _U)]) for b in (_ODD, pow(_ODD, -1, 1 << 64))]
    return _powers


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(start byte, hash) of each word of ``raw``, by differences of running polynomial sums."""
    starts, hashes, lo = [], [], 0
    while lo < len(raw):
        hi = min(lo + PIECE, len(raw))
        if hi < len(raw):  # cut at the last gap, or at the next one if a word fills the piece
            gaps = [m.start() for m in re.finditer(rb"[\x20\x09-\x0D]", raw[max(lo, hi - 4096) : hi])]
            if gaps:
                hi = max(lo, hi - 4096) + gaps[-1] + 1
            elif m := re.compile(rb"[\x20\x09-\x0D]").search(raw, hi):
                hi = m.end()
            else:
                hi = len(raw)
        a = np.frombuffer(raw, np.uint8, hi - lo, lo)
        gap = (a == 32) | ((a >= 9) & (a <= 13))
        edge = np.diff(np.r_[True, gap, True].astype(np.int8))
        first, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        up, down = _powers_to(len(a))
        sums = np.zeros(len(a) + 1, _U)
        np.cumsum((a.astype(_U) + _U(1)) * up[: len(a)], out=sums[1:])
        hashes.append(_mixed((sums[end] - sums[first]) * down[first]))
        starts.append(first + lo)
        lo = hi
    return (np.concatenate(starts), np.concatenate(hashes)) if starts else (np.zeros(0, np.int64), np.zeros(0, _U))


def _rolled(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k, put together from those of 1, 2, 4, ..."""
    n, out, have, part, size = max(0, len(h) - k + 1), None, 0, h, 1
    while n and size <= k:
        if k & size:
            own = part[have : have + n]
            out = own if out is None else out * _U(pow(_ODD, size, 1 << 64)) + own
            have += size
        if 2 * size <= k:
            part = part[:-size] * _U(pow(_ODD, size, 1 << 64)) + part[size:]
        size *= 2
    return _mixed(out) if n else h[:0]


def _least(v: np.ndarray, width: int) -> np.ndarray:
    """Sliding minimum by doubling."""
    have = 1
    while have * 2 <= width:
        v, have = np.minimum(v[:-have], v[have:]), have * 2
    return np.minimum(v[: len(v) - (width - have)], v[width - have :]) if have < width else v


def blocks(texts: list[str], runs: bool = True) -> tuple[np.ndarray, ...]:
    """(text, first run, gram's hash, end in ``runs``) of each block of neighbouring runs that one gram stands for, and the hashes of all runs if asked."""
    raws = [t.encode() for t in texts]
    begins = np.cumsum([0, *(len(r) + 1 for r in raws)])[:-1]
    starts, h = word_hashes(b"\n".join(raws))
    if len(h) < LENGTH:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, _U), np.zeros(0, np.int64), np.zeros(0, _U))
    owner = np.searchsorted(begins, starts, "right") - 1
    zero = np.searchsorted(owner, np.arange(len(texts)))
    grams = _rolled(h, GRAM)
    v = (grams & _U(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=_U)
    at = (_least(v, LENGTH - GRAM + 1) & _U(0xFFFFFFFF)).astype(np.int64)
    run = np.flatnonzero(owner[: len(at)] == owner[LENGTH - 1 :])
    at, hashes = at[run], _rolled(h, LENGTH)[run] if runs else grams[:0]
    if not len(run):
        return run, run, grams[:0], run, hashes
    first = np.flatnonzero(np.r_[True, (np.diff(at) != 0) | (np.diff(run) != 1)])
    return owner[run[first]], run[first] - zero[owner[run[first]]], grams[at[first]], np.r_[first[1:], len(run)], hashes


def _grams(batches):
    for b in pieces(batches):
        ids = b.column("doc_id")
        for lo, some in slices(b.column("text").to_pylist()):
            text, _, gram, _, _ = blocks(some, runs=False)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(text + lo)), pa.array((gram >> _U(64 - GRAM_BITS)).view(np.int64))], names=["doc_id", "gram"])


def _places(batches):
    """Blocks; ``block`` is a hash of all their words."""
    for b in pieces(batches):
        ids, hs = b.column("doc_id"), b.column("h")
        for lo, some in slices(b.column("text").to_pylist()):
            text, first, gram, end, hashes = blocks(some)
            n = np.diff(np.r_[0, end])
            key = _mixed((hashes[end - n] * _U(_ODD) + hashes[end - 1]) * _U(_ODD) + n.astype(_U)) if len(end) else hashes[:0]
            at = pa.array(text + lo)
            yield pa.RecordBatch.from_arrays([ids.take(at), hs.take(at), pa.array(first.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array((gram >> _U(64 - GRAM_BITS)).view(np.int64)), pa.array(key.view(np.int64))], names=["doc_id", "h", "first", "n", "gram", "block"])


def _runs(batches):
    for b in pieces(batches):
        ids, hs = b.column("doc_id"), b.column("h")
        for lo, some in slices(b.column("text").to_pylist()):
            text, first, gram, end, hashes = blocks(some)
            at = pa.array(text + lo)
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, end].astype(np.int32)), pa.array(hashes.view(np.int64)))
            yield pa.RecordBatch.from_arrays([ids.take(at), hs.take(at), pa.array(first.astype(np.int32)), pa.array((gram >> _U(64 - GRAM_BITS)).view(np.int64)), lists], names=["doc_id", "h", "first", "gram", "runs"])


class Automaton:
    """Suffix automaton of several texts of words, each with an owner; ``matches`` streams words through it."""

    def __init__(self):
        self.next, self.link, self.length, self.owner, self.settled = [{}], [-1], [0], [None], True

    def add(self, words: list[str], owner: int) -> None:
        """Add a text; the automaton then accepts its substrings too."""
        nxt, link, length, own, last = self.next, self.link, self.length, self.owner, 0
        self.settled = False
        for c in words:
            q = nxt[last].get(c)
            if q is not None and length[q] == length[last] + 1:  # known already
                own[q] = owner if own[q] is None else min(own[q], owner)
                last = q
                continue
            if q is None:
                new = len(nxt)
                nxt.append({})
                link.append(0)
                length.append(length[last] + 1)
                own.append(owner)
                p = last
                while p >= 0 and c not in nxt[p]:
                    nxt[p][c] = new
                    p = link[p]
                if p >= 0:
                    q = nxt[p][c]
                    link[new] = q if length[p] + 1 == length[q] else self._split(p, c, q)
                last = new
            else:
                last = self._split(last, c, q)
                own[last] = min(own[last], owner)

    def _split(self, p: int, c: str, q: int) -> int:
        """A state of its own for what ``c`` after ``p`` makes, and q's shorter substrings."""
        new = len(self.next)
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.length.append(self.length[p] + 1)
        self.owner.append(self.owner[q])
        self.link[q] = new
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = new
            p = self.link[p]
        return new

    def _settle(self) -> None:
        """Give each state the smallest owner of all its occurrences: those of the longer states that link to it too."""
        own, link = self.owner, self.link
        for v in sorted(range(1, len(link)), key=self.length.__getitem__, reverse=True):
            if (p := link[v]) > 0:
                own[p] = min(own[p], own[v])
        self.settled = True

    def matches(self, words: list[str], most: int) -> Iterator[tuple[int, int | None]]:
        """For each word, how many words up to ``most`` that end with it occur here, and the smallest owner they occur in."""
        if not self.settled:
            self._settle()
        nxt, link, length, own, v, n = self.next, self.link, self.length, self.owner, 0, 0
        for c in words:
            while v and c not in nxt[v]:
                v = link[v]
                n = length[v]
            if c in nxt[v]:
                v, n = nxt[v][c], n + 1
            while v and length[link[v]] >= most:  # the state of the last ``most`` words alone
                v = link[v]
            if n > most:
                n = most
            yield n, own[v]


def _packed(at: str, n: Column, shard: Column, kind: Column) -> Column:
    """A hit as a long: place, number of runs (4 bits), shard (27 bits), kind (1 bit)."""
    return F.shiftleft(F.col(at).cast("long"), 32).bitwiseOR(F.shiftleft(n.cast("long"), 28)).bitwiseOR(F.shiftleft(shard.cast("long"), 1)).bitwiseOR(kind.cast("long"))


def _unpacked(x: int) -> tuple[int, int, int, int]:
    return x >> 1 & (1 << 27) - 1, x & 1, x >> 32, x >> 28 & 15


def _cut(batches):
    """Texts cut into reference pieces (kind 0) and pieces to be matched (kind 1), by the shards of their runs."""
    for b in pieces(batches):
        out: list = []
        for doc, h, text, hits in zip(*(b.column(c).to_pylist() for c in ("doc_id", "h", "text", "hits"))):
            words, begin, end, now = text.encode().split(), 0, 0, None
            for shard, kind, at, n in [*sorted(_unpacked(x) for x in hits), (-1, 0, 0, 0)]:
                if now == (shard, kind) and at <= end:
                    end = max(end, at + n)
                    continue
                if now is not None:
                    out.append((*now, doc, h, begin, b" ".join(words[begin : end + LENGTH - 1]).decode()))
                now, begin, end = (shard, kind), at, at + n
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 6, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.string()))], names=["shard", "kind", "doc_id", "h", "begin", "words"])


def _matched(batches):
    """Spans that an earlier document has; rows come by shard and copy, reference pieces first."""
    now, automaton = None, Automaton()
    for b in batches:
        out: list = []
        for shard, copy, kind, doc, h, begin, line in zip(*(b.column(c).to_pylist() for c in ("shard", "copy", "kind", "doc_id", "h", "begin", "words"))):
            if (shard, copy) != now:
                now, automaton = (shard, copy), Automaton()
            words = line.split(" ")
            if kind == 0:
                automaton.add(words, doc)
                continue
            start = stop = -1
            for i, (n, owner) in enumerate(automaton.matches(words, LENGTH)):
                if n == LENGTH and owner < doc:
                    if i - LENGTH + 1 > stop:
                        if stop > 0:
                            out.append((doc, h, begin + start, begin + stop))
                        start = i - LENGTH + 1
                    stop = i + 1
            if stop > 0:
                out.append((doc, h, begin + start, begin + stop))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 4, (pa.int64(), pa.int64(), pa.int32(), pa.int32()))], names=["doc_id", "h", "start", "stop"])


def _bits(n: int) -> int:
    return min(MOST_BITS, 1 << max(16, (BITS_PER_KEY * n).bit_length()))


def spans(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, h, spans) of those of ``rows`` (doc_id, h, text) that lose words; spans may overlap."""
    texts = rows.where("doc_id IS NOT NULL AND text IS NOT NULL")
    # Grams that two documents have, and the blocks that these stand for.
    grams = texts.select("doc_id", "text").mapInArrow(_grams, "doc_id long, gram long")
    shared = scratch.keep(_in_two(grams, "gram").select("gram"), "grams")
    bits = _bits(shared.count())
    found = maybe_in(texts.mapInArrow(_places, "doc_id long, h long, first int, n int, gram long, block long"), shared, "gram", bits=bits).drop("gram")
    found = scratch.keep(found, "blocks")
    firsts = scratch.keep(_in_two(found, "block"), "firsts")
    many = firsts.count()
    told = maybe_in(found, firsts, "block", keep_all=True, bits=_bits(many))
    met = scratch.keep(told.where("maybe").drop("maybe").join(firsts.drop("times"), "block", "left").drop("block"), "met")
    # First copies, and blocks that no other document has: their single runs.
    lead = met.where("own_id IS NULL OR own_id = doc_id").select("doc_id", "h", "first").unionByName(told.where("NOT maybe").select("doc_id", "h", "first"))
    place = F.xxhash64("doc_id", "h", "first")
    leads = scratch.keep(lead.select(place.alias("place")), "leads")
    runs = maybe_in(texts.mapInArrow(_runs, "doc_id long, h long, first int, gram long, runs array<long>"), shared, "gram", bits=bits).withColumn("place", place)
    runs = maybe_in(runs, leads, "place", bits=_bits(leads.count())).select("doc_id", "h", "first", F.posexplode("runs").alias("_i", "run"))
    runs = scratch.keep(runs.select("doc_id", "h", (F.col("first") + F.col("_i")).alias("at"), "run"), "runs")
    run_firsts = scratch.keep(_in_two(runs, "run"), "run_firsts")
    few = run_firsts.count()
    # Where each run's first copy lies.
    shards = max(parts(rows.sparkSession), -(-(many * WIDEST + few) // SHARD))
    shard, kind = F.pmod(F.xxhash64("own_id"), F.lit(shards)), (F.col("own_id") < F.col("doc_id")).cast("int")
    hits = met.where("own_id <= doc_id").select("doc_id", "h", _packed("first", F.col("n"), shard, kind).alias("hit"))
    single = maybe_in(runs, run_firsts, "run", bits=_bits(few)).join(run_firsts.drop("times"), "run").where("own_id <= doc_id")
    hits = hits.unionByName(single.select("doc_id", "h", _packed("at", F.lit(1), shard, kind).alias("hit")))
    hits = scratch.keep(hits.groupBy("doc_id", "h").agg(F.collect_list("hit").alias("hits")), "hits")  # of one document
    cut = _meeting(texts, hits).dropDuplicates(["doc_id", "h"]).join(hits, ["doc_id", "h"])
    cut = cut.mapInArrow(_cut, "shard long, kind int, doc_id long, h long, begin int, words string")
    weight = firsts.select(shard.alias("shard"), (F.col("times") * WIDEST).alias("w")).unionByName(run_firsts.select(shard.alias("shard"), F.col("times").alias("w")))
    loads = scratch.keep(weight.groupBy("shard").agg(F.ceil(F.sum("w") / LOAD).cast("int").alias("copies")), "loads")
    copy = F.when(F.col("kind") == 0, F.sequence(F.lit(0), F.col("copies") - 1)).otherwise(F.array(F.pmod(F.hash("doc_id", "begin"), F.col("copies"))))
    dealt = cut.join(loads, "shard").select("shard", "kind", "doc_id", "h", "begin", "words", F.explode(copy).alias("copy"))
    placed = dealt.repartition(max(parts(rows.sparkSession), shards), "shard", "copy").sortWithinPartitions("shard", "copy", "kind")
    return placed.mapInArrow(_matched, "doc_id long, h long, start int, stop int").groupBy("doc_id", "h").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))


def _in_two(rows: DataFrame, key: str) -> DataFrame:
    """(key, own_id, times) of what at least two documents have: the smallest of them, and how many rows."""
    return rows.groupBy(key).agg(F.min("doc_id").alias("own_id"), F.max("doc_id").alias("_hi"), F.count("*").alias("times")).where("own_id < _hi").drop("_hi")


def _meeting(rows: DataFrame, keys: DataFrame, keep_all: bool = False) -> DataFrame:
    """Those of ``rows`` that ``keys`` (doc_id, h) may hold, by a filter, so that other texts are not shuffled."""
    of = F.xxhash64("doc_id", "h")
    out = maybe_in(rows.withColumn("_of", of), keys.select(of.alias("_of")), "_of", keep_all=keep_all, bits=_bits(keys.count()))
    return out.drop("_of")


def _kept(texts, spans_):
    counts, gone, kept = [], [], []
    for text, some in zip(texts, spans_):
        words = (text or "").encode().split()  # bytes split at ASCII blanks only
        keep = np.ones(len(words), bool)
        for s in some or ():
            keep[s["start"] : s["stop"]] = False
        counts.append(len(words))
        gone.append(len(words) - int(keep.sum()))
        kept.append(b" ".join(words if not some else [w for w, k in zip(words, keep.tolist()) if k]).decode())
    return counts, gone, kept


def remove_repeats(documents: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and text (the kept words) of every row."""
    bounded(documents.sparkSession)
    scratch = Scratch(documents.sparkSession, f"substring-{uuid.uuid4().hex[:8]}")
    rows = documents.select("doc_id", F.xxhash64("text").alias("h"), "text")
    mark = Scratch.mark()
    found = scratch.keep(spans(rows, Scratch(documents.sparkSession, "substring-work")), "spans")
    Scratch.release(mark)  # all but the spans
    told = _meeting(rows, found, keep_all=True)
    known = told.where("maybe AND doc_id IS NOT NULL").drop("maybe").join(found, ["doc_id", "h"], "left")
    every = known.unionByName(told.where("NOT maybe OR doc_id IS NULL").drop("maybe"), allowMissingColumns=True).select("doc_id", "text", "spans")
    fields = [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("text", T.StringType())]
    return with_columns(every, ["text", "spans"], fields, lambda: _kept, drop=("spans",))
