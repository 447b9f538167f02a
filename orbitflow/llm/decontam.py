"""Benchmark decontamination: BM25 over an inverted index of test items with block-max bounds, then verification.

The index holds, for each term, its items with BM25 weights divided by the item's own full score, so that a passage scores 1 for an item
if it has all its terms. Postings lie in blocks of ``BLOCK`` items with the block's largest weight. Every training text is cut
into segments as long as the shard's longest item (``STRIDE`` words at least); a passage is two neighbouring segments, so that each
stretch as long as an item lies wholly in one. Bounds from block maxima are summed for all passages of a batch at once, and
only blocks whose bound reaches ``SCORE`` are opened and scored exactly: nothing at or above the threshold is lost.
A hit is verified on word 5-grams: ``OVERLAP`` of the whole item and half of its question and of its answer (the last sentence) must stand in
the passage.

Texts are only mapped over, there is no shuffle. The index is broadcast; items are dealt into shards of about
``SHARD`` characters, one pass each, whose result is written before the next one's index is built, so a larger benchmark takes more passes, not more memory. Number, mean length and greatest length of
items and the items that have a term are counted over all shards, so rows do not depend on how many there are.

Defined results: null or blank texts and items match nothing. Every row is searched, also repeated ones or those without doc_id;
``search`` gives a row for each row's item found (best passage, first of equals), ``clean`` the rows with none, as they are.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbitflow.llm.common import Scratch, pieces, slices

K1, B = 1.2, 0.75
SCORE = 0.5
GRAM, OVERLAP, PART = 5, 0.8, 0.5
STRIDE, BLOCK = 64, 16
SHARD = 8_000_000
#: Bounds of passages and blocks that are held at once.
BOUNDS = 1_000_000
FOUND = ["doc_id", "item_id", "score", "overlap", "question_overlap", "answer_overlap", "first_word"]
_WORD = re.compile(r"\w+")


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def grams(ids: list[int]) -> set[tuple]:
    k = min(GRAM, len(ids))
    return {tuple(ids[i : i + k]) for i in range(len(ids) - k + 1)} if k else set()


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """The last sentence answers the rest; of a single sentence the last third does."""
    cuts = [m.end() for m in re.finditer(r"[.!?。](?=\s)", text.strip())]
    all_ = words(text)
    n = len(words(text.strip()[: cuts[-1]])) if cuts else 0
    if not 0 < n < len(all_):
        n = len(all_) - max(1, len(all_) // 3) if len(all_) > 1 else len(all_)
    return all_[:n], all_[n:]


@dataclass
class Statistics:
    """Of all items with words: how many, their mean and greatest length, and how many have each term (terms of some items suffice)."""

    items: int
    mean: float
    longest: int
    having: dict[str, int]


class Index:
    """Inverted index of some items; weights and passages follow the statistics of all, by default these."""

    def __init__(self, items: list[tuple[int, str | None]], of_all: Statistics | None = None):
        kept = sorted(((i, t) for i, t in items if words(t)), key=lambda x: (x[0] is None, x[0], x[1]))
        self.items, self.vocabulary = [i for i, _ in kept], {}
        tf = [Counter(words(t)) for _, t in kept]
        size = [sum(c.values()) for c in tf]
        of_all = of_all or Statistics(len(kept), sum(size) / max(1, len(size)), max(size, default=0), Counter(t for c in tf for t in c))
        self.stride, mean = max(STRIDE, of_all.longest), of_all.mean
        own = sorted({t for c in tf for t in c})  # sums run in this order in every shard
        idf = {t: math.log(1 + (of_all.items - of_all.having[t] + 0.5) / (of_all.having[t] + 0.5)) for t in own}
        for t in own:
            self.vocabulary[t] = len(self.vocabulary)
        postings: dict[int, list] = defaultdict(list)
        self.parts = []
        for k, ((_, text), c, n) in enumerate(zip(kept, tf, size)):
            w = {t: idf[t] * x * (K1 + 1) / (x + K1 * (1 - B + B * n / mean)) for t, x in c.items()}
            full = sum(w.values())
            for t, x in w.items():
                postings[self.vocabulary[t]].append((k, x / full))
            self.parts.append(tuple(grams([self.vocabulary[x] for x in part]) for part in (words(text), *question_and_answer(text))))
        order = [postings[t] for t in range(len(self.vocabulary))]
        tops = []
        for p in order:
            top: dict[int, float] = defaultdict(float)
            for k, x in p:
                top[k // BLOCK] = max(top[k // BLOCK], x)
            tops.append(sorted(top.items()))
        self.blocks = -(-len(kept) // BLOCK)
        self.at = np.cumsum([0, *(len(x) for x in tops)])
        self.block_of = np.array([b for x in tops for b, _ in x], np.int64)
        self.top_of = np.array([x for y in tops for _, x in y])
        # Postings of an entry (a term's block) lie together, in the order of entries.
        self.item_at = np.array([k for p in order for k, _ in p], np.int64)
        self.weight_at = np.array([x for p in order for _, x in p])
        inside = [np.unique([k // BLOCK for k, _ in p], return_counts=True)[1] for p in order]
        self.postings = np.cumsum(np.concatenate([[0], *inside])).astype(np.int64)

    def hits(self, texts: list[str]) -> list[tuple]:
        """(text, item, score, overlap, question overlap, answer overlap, first word of the passage)."""
        if not self.items:
            return []
        get = self.vocabulary.get
        ids = [np.array([get(w, -1) for w in words(t)], np.int64) for t in texts]
        segments = np.array([max(1, -(-len(x) // self.stride)) for x in ids])
        first = np.cumsum(np.r_[0, segments])
        terms, total = len(self.vocabulary), int(first[-1])
        flat = np.concatenate(ids)
        segment = np.repeat(first[:-1], [len(x) for x in ids]) + np.concatenate([np.arange(len(x)) // self.stride for x in ids])
        known = flat >= 0
        own = np.unique(segment[known] * terms + flat[known])
        opens = np.zeros(total, bool)  # a text's first segment is nobody's second
        opens[first[:-1]] = True
        second = own[~opens[own // terms]] - terms
        pairs = np.union1d(own, second)  # the distinct terms of each passage
        passage, term = pairs // terms, pairs % terms
        best: dict[tuple, tuple] = {}
        # Bounds are held for some passages at a time: BOUNDS numbers at most.
        some = max(1, BOUNDS // self.blocks)
        for lo in range(0, total, some):
            x, y = np.searchsorted(passage, [lo, lo + some])
            for s, item, score in self._scored(passage[x:y] - lo, term[x:y], min(some, total - lo)):
                self._verify(s + lo, item, score, ids, first, best)
        return [(doc, self.items[item], *rest) for (doc, item), rest in sorted(best.items())]

    def _scored(self, passage: np.ndarray, term: np.ndarray, total: int) -> list[tuple[int, int, float]]:
        """(passage, item, score) of all items at or above SCORE, passages in order; blocks whose bound is lower stay closed."""
        row, entry = _spread(self.at[term], self.at[term + 1])
        place = passage[row] * self.blocks + self.block_of[entry]
        bound = np.bincount(place, self.top_of[entry], total * self.blocks)
        opened = bound[place] >= SCORE - 1e-9
        place, entry = place[opened], entry[opened]
        row, posting = _spread(self.postings[entry], self.postings[entry + 1])
        keys, which = np.unique((place[row] // self.blocks) * len(self.items) + self.item_at[posting], return_inverse=True)
        scores = np.bincount(which, self.weight_at[posting], len(keys))
        good = np.flatnonzero(scores >= SCORE - 1e-12)
        return list(zip((keys[good] // len(self.items)).tolist(), (keys[good] % len(self.items)).tolist(), scores[good].tolist()))

    def _verify(self, s: int, item: int, score: float, ids: list[np.ndarray], first: np.ndarray, best: dict) -> None:
        doc = int(np.searchsorted(first, s, "right")) - 1
        if best.get((doc, item), (0,))[0] >= score:
            return
        lo = (s - int(first[doc])) * self.stride
        passage = ids[doc][lo : lo + 2 * self.stride].tolist()
        share = []
        for part in self.parts[item]:
            share.append(len(part & set(zip(*(passage[j:] for j in range(len(next(iter(part)))))))) / len(part) if part else 1.0)
            if share[-1] < (PART if len(share) > 1 else OVERLAP):
                return
        best[doc, item] = (score, *share, lo)


def _spread(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, position) of every position from ``lo`` up to ``hi`` of each row."""
    n = hi - lo
    return np.repeat(np.arange(len(n)), n), np.repeat(lo - np.cumsum(n) + n, n) + np.arange(int(n.sum()))


def _counted(batches):
    for pdf in batches:
        for lo in range(0, len(pdf), 200):
            some = pdf.iloc[lo : lo + 200]
            all_ = [words(t) for t in some["text"]]
            yield pd.DataFrame({"shard": some["shard"], "n": [len(w) for w in all_], "terms": [sorted(set(w)) for w in all_]})


class Shards:
    """Indexes of about SHARD characters of items each. ``each`` builds and broadcasts one after another; the driver holds one at a time."""

    def __init__(self, items: DataFrame, scratch: Scratch):
        self.spark, self.scratch = items.sparkSession, scratch
        total = items.agg(F.sum(F.length("text"))).first()[0] or 0
        self.n, self.statistics = max(1, -(-total // SHARD)), None
        self.items = items.withColumn("shard", F.pmod(F.xxhash64("item_id", "text"), F.lit(self.n)).cast("int"))
        if self.n > 1:
            self.items = scratch.keep(self.items, "items", "shard")
            counted = scratch.keep(self.items.select("shard", "text").mapInPandas(_counted, "shard int, n long, terms array<string>").where("n > 0"), "counted")
            self.statistics = counted.agg(F.count("*"), F.sum("n"), F.max("n")).first()
            each = counted.select("shard", F.explode("terms").alias("term")).groupBy("shard", "term").count()
            self.having = scratch.keep(each.join(each.groupBy("term").agg(F.sum("count").alias("items")), "term").select("shard", "term", "items"), "terms", "shard")

    def index(self, k: int) -> Index:
        of_all = None
        if self.statistics:
            number, length, longest = self.statistics
            terms = self.having.where(F.col("shard") == k).collect()  # no more than the shard's own
            of_all = Statistics(number, (length or 0) / max(1, number), longest or 0, {r["term"]: r["items"] for r in terms})
        rows = self.items.where(F.col("shard") == k).select("item_id", "text").collect()  # about SHARD characters
        return Index([(r["item_id"], r["text"]) for r in rows], of_all)

    def each(self, work: Callable[[Broadcast], DataFrame]) -> Iterator[DataFrame]:
        """What ``work`` makes of each broadcast index; of several ones it is written before the next is built, and the index is destroyed."""
        for k in range(self.n):
            index = self.spark.sparkContext.broadcast(self.index(k))
            made = work(index)
            if self.n > 1:
                made = self.scratch.keep(made, "found")
                index.destroy()
            yield made


def _sharded(items: DataFrame, scratch: Scratch | None) -> Shards:
    return Shards(items.select(F.col("item_id").cast("long").alias("item_id"), "text"), scratch or Scratch(items.sparkSession, "decontam"))


def search(df: DataFrame, items: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, item_id, score, overlap, question_overlap, answer_overlap, first_word for each row's items found."""
    docs = df.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def found(index):
        def run(batches):
            for batch in pieces(batches):
                rows = [(at + d, *rest) for at, some in slices(batch.column("text").to_pylist()) for d, *rest in index.value.hits(some)]
                row, *made = list(zip(*rows)) or [[]] * 7
                ids = batch.column("doc_id").take(pa.array(row, pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(v, t) for v, t in zip(made, (pa.int64(), *[pa.float64()] * 4, pa.int64())))], names=FOUND)

        return docs.mapInArrow(run, "doc_id long, item_id long, score double, overlap double, question_overlap double, answer_overlap double, first_word long")

    return reduce(DataFrame.unionByName, _sharded(items, scratch).each(found))


def clean(df: DataFrame, items: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """Rows of ``df`` in whose ``text`` no item is found."""
    left = [df]

    def kept(index):
        def run(batches):
            for batch in pieces(batches):
                bad = {at + d for at, some in slices(batch.column("text").to_pylist()) for d, *_ in index.value.hits(some)}
                yield batch.filter(pa.array([i not in bad for i in range(batch.num_rows)], pa.bool_()))

        return left[0].mapInArrow(run, df.schema)

    for left[0] in _sharded(items, scratch).each(kept):
        pass
    return left[0]
