"""Near-duplicates of word shingles by fast similarity sketching, banding and exact verification.

A sketch has ``BINS`` coordinates. In round i every shingle is hashed to one bin, in the rounds after the first ``BINS`` to
bin i - BINS, and a bin keeps its least (round, hash): so each coordinate is filled after twice as many rounds at most, early
for large sets, and two sketches agree in a share of coordinates that concentrates around the sets' similarity. 32 bands of
4 coordinates miss a pair of similarity 0.85 with a probability of 6e-11. The threshold is a parameter; a lower one takes more
coordinates, so that a pair at the threshold is missed no more often (0.80: 45 bands).

* Equal sets are one group from the start (by a 128-bit digest); its smallest doc_id stands for it.
* In a bucket every member is paired with a hub, its smallest member, not with every other one. Pairs are verified on the full sets
  of shingle hashes (64 bits), and linked ones merge. Buckets that still hold several components get a second hub; what is
  left is compared in blocks: each member has one home, a block of those around the same hub, and two homes meet once if any bucket has
  members of both. There pairs of different components whose sketches agree in a share of coordinates that
  a pair at the threshold falls short of with a probability of 1e-10 at most (0.60 for 0.85) are verified on the full sets as well, and only a spanning forest of the links leaves. Members of a bucket's largest
  component have homes of their own, which are not compared with each other. No bucket is capped or left out.
* Texts are shuffled once, those that share a bucket with another only get their sets built again.

Defined results: null or blank texts have the empty set and link with nothing. The nodes are doc_ids: rows that repeat a doc_id
belong to the same node, and each of them gives a row. Rows whose doc_id is null are kept alone, with a null component.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orbitflow.llm.common import Scratch, join_to_keys, with_columns
from orbitflow.llm.components import components

WORDS = 5
BINS, ROWS = 128, 4
#: Least similarity in hundredths, unless ``classes`` is given another.
LEAST = 85
#: Most coordinates that fit a sketch: 2 * bins rounds have 9 bits.
MOST_BINS = 252
#: Bound for the probability that ``estimate_for`` costs a pair.
MISSED = 1e-10
#: Members, and shingles, in a block.
BLOCK, ITEMS = 1024, 1 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)


def bins_for(least: int) -> int:
    """Coordinates with which a pair of similarity ``least`` is missed no more often than one of LEAST with BINS."""
    if not 0 < least <= 100:
        raise ValueError(f"similarity in hundredths: {least}")
    missed = lambda x: math.log1p(-min((x / 100) ** ROWS, 1 - 1e-9))
    bins = max(BINS, ROWS * math.ceil(BINS / ROWS * missed(LEAST) / missed(least)))
    if bins > MOST_BINS:
        raise ValueError(f"a sketch is too short for similarity {least}")
    return bins


def estimate_for(least: int) -> float:
    """Share of equal coordinates, in whole hundredths, that a pair of similarity ``least`` falls short of with a probability under MISSED (Chernoff's bound)."""
    x, bins = least / 100, bins_for(least)
    y = least - 1
    while y > 1 and bins * (y / 100 * math.log(y / 100 / x) + (1 - y / 100) * math.log((1 - y / 100) / max(1 - x, 1e-9))) < -math.log(MISSED):
        y -= 1
    return y / 100


class Words(dict):
    """64-bit hashes of words; cleared when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, cache: Words) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles; words are lower-cased in A-Z and split at ASCII white space."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
    k = min(WORDS, len(h))
    out = np.full(len(h) - k + 1, k, np.uint64)
    for j in range(k):
        out = out * np.uint64(0xD6E8FEB86659FD93) + h[j : len(h) - k + 1 + j]
    return np.unique(_mix(out))


def sketch(items: np.ndarray, bins: int = BINS) -> np.ndarray:
    """``bins`` coordinates of a non-empty set: (round, hash) in one number each."""
    out = np.full(bins, np.iinfo(np.uint64).max, np.uint64)
    at, some = 0, max(1, 1200 // len(items))
    while at < 2 * bins and (out == np.iinfo(np.uint64).max).any():
        rounds = np.arange(at, min(2 * bins, at + some), dtype=np.uint64)
        x = _mix(items[None, :] + _ODD * (rounds[:, None] + np.uint64(1)))
        places = np.where(rounds[:, None] < bins, x % np.uint64(bins), rounds[:, None] - np.uint64(bins)).astype(np.int64)
        np.minimum.at(out, places.ravel(), ((rounds[:, None] << np.uint64(55)) | (x >> np.uint64(9))).ravel())
        at += some
    return out


def bands(coordinates: np.ndarray) -> np.ndarray:
    rows = coordinates.reshape(-1, ROWS)
    out = np.arange(len(rows), dtype=np.uint64)
    for j in range(ROWS):
        out = _mix(out * _ODD + rows[:, j])
    return out.view(np.int64)


_SKETCH = [T.StructField("n_shingles", T.LongType()), T.StructField("same", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("bits", T.BinaryType())]


def _sketches(bins: int):
    cache = Words()

    def run(texts):
        rows = []
        for items in (shingles(t, cache) for t in texts):
            if len(items):
                full = sketch(items, bins)
                rows.append((len(items), xxhash.xxh3_128_digest(items.tobytes()), bands(full), (full & np.uint64(255)).astype(np.uint8).tobytes()))
            else:
                rows.append((0, None, None, None))
        return list(zip(*rows)) or [[]] * 4

    return run


def _sets(batches):
    cache = Words()
    for pdf in batches:
        for lo in range(0, len(pdf), 200):
            some = pdf.iloc[lo : lo + 200]
            yield pd.DataFrame({"id": some["doc_id"], "items": [shingles(t, cache).view(np.int64) for t in some["text"]]})


def _verified(pairs: DataFrame, sets: DataFrame, least: int) -> DataFrame:
    """Those of ``pairs(a, b)`` whose full sets are similar enough."""
    a = sets.select(F.col("id").alias("a"), F.col("items").alias("x"))
    b = sets.select(F.col("id").alias("b"), F.col("items").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    return pairs.join(a, "a").join(b, "b").where(100 * both >= least * (F.size("x") + F.size("y") - both)).select("a", "b")


def _alike(n: str, m: str, least: int):
    return 100 * F.least(n, m) >= least * F.greatest(n, m)


def _meet(pdf: pd.DataFrame, least: int) -> pd.DataFrame:
    """Links between two homes (or within one) that join different components: a spanning forest of them."""
    i, j = pdf["i"].iloc[0], pdf["j"].iloc[0]
    pdf = pdf.sort_values("id", ignore_index=True)
    ids, n, label, home = (pdf[c].to_numpy().copy() for c in ("id", "n", "component", "home"))
    bits = np.frombuffer(b"".join(pdf["bits"]), np.uint8).reshape(len(pdf), -1)
    ends = np.cumsum([len(x) for x in pdf["items"]])
    universe, codes = np.unique(np.concatenate(list(pdf["items"])), return_inverse=True)
    own = np.split(codes, ends[:-1])
    seen, found, estimate = np.zeros(len(universe), bool), [], estimate_for(least)
    two = np.flatnonzero(home == j)
    for r in np.flatnonzero(home == i).tolist():
        some = two[two > r] if i == j else two
        some = some[(label[some] != label[r]) & (100 * np.minimum(n[some], n[r]) >= least * np.maximum(n[some], n[r]))]
        some = some[(bits[some] == bits[r]).mean(1) >= estimate] if len(some) else some
        if not len(some):
            continue
        seen[own[r]] = True
        sizes = np.array([len(own[x]) for x in some])
        both = np.add.reduceat(seen[np.concatenate([own[x] for x in some])].astype(np.int64), np.cumsum(sizes) - sizes)
        seen[own[r]] = False
        for x in some[100 * both >= least * (len(own[r]) + sizes - both)].tolist():
            if label[x] != label[r]:
                found.append((ids[r], ids[x]))
                label[label == label[x]] = label[r]
    return pd.DataFrame(found, columns=["a", "b"]).astype("int64")


def classes(df: DataFrame, scratch: Scratch | None = None, least: int = LEAST) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of ``df(doc_id, text)``; pairs of similarity ``least`` hundredths or more are linked."""
    bins = bins_for(least)
    scratch = scratch or Scratch(df.sparkSession, "minhash")
    docs = df.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sk = scratch.keep(with_columns(docs, ["text"], _SKETCH, lambda: _sketches(bins), drop=("text",)), "sketches")
    full = sk.where("same IS NOT NULL AND doc_id IS NOT NULL")
    same = scratch.keep(full.groupBy("same").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "same")
    reps = scratch.keep(full.join(same.select("same", F.col("rep").alias("doc_id")), ["doc_id", "same"]).dropDuplicates(["doc_id", "same"]).select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), "same", "bands", "bits"), "reps")

    lines = reps.select("id", "n", F.explode("bands").alias("key"))
    hubs = lines.groupBy("key").agg(F.min("id").alias("hub"), F.count("*").alias("members")).where("members > 1")
    buckets = scratch.keep(lines.join(hubs, "key").select("key", "id", "n", "hub", "members"), "buckets")
    size = reps.select(F.col("id").alias("hub"), F.col("n").alias("m"))
    pairs = scratch.keep(buckets.where("id <> hub").select(F.col("hub"), F.col("id"), "n").distinct().join(size, "hub").where(_alike("n", "m", least)).select(F.col("hub").alias("a"), F.col("id").alias("b")), "pairs")
    involved = buckets.select(F.col("id").alias("doc_id")).distinct()
    texts = docs.join(involved, "doc_id", "left_semi")
    sets = scratch.keep(texts.mapInPandas(_sets, "id long, items array<long>"), "sets")
    links = scratch.keep(_verified(pairs, sets, least), "links")
    found = scratch.keep(components(links, scratch), "components")

    for last in (False, True):
        of = found.select(F.col("node").alias("id"), "component")
        placed = buckets.join(of, "id", "left").withColumn("component", F.coalesce("component", "id"))
        mixed = placed.groupBy("key").agg(F.min("component").alias("c"), F.max("component").alias("d")).where("c <> d")
        rest = scratch.keep(placed.join(mixed.select("key"), "key", "left_semi"), "mixed")
        if rest.isEmpty():
            break
        if last:
            links = scratch.keep(links.unionByName(_by_blocks(rest, reps, sets, scratch, least)), "links")
        else:
            at = rest.select(F.col("id").alias("hub"), F.col("component").alias("hub_component"), "key", F.col("n").alias("m"))
            first = rest.where("id = hub").select("key", F.col("component").alias("first"))
            second = rest.join(first, "key").where("component <> first").groupBy("key").agg(F.min("id").alias("hub"))
            at = at.join(second, ["key", "hub"])
            more = rest.drop("hub", "members").join(at, "key").where((F.col("component") != F.col("hub_component")) & _alike("n", "m", least)).select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct()
            links = scratch.keep(links.unionByName(_verified(more, sets, least)), "links")
        found = scratch.keep(components(links, scratch), "components")

    # What stands alone is its own component and needs no join.
    of = same.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("same", "rep", "copies", F.coalesce("component", "rep").alias("c")).where("copies > 1 OR c <> rep").drop("rep")
    out = join_to_keys(sk.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("same")).alias("same")), of, "same", "copies", "doc_id")
    mine = F.coalesce("c", "doc_id")
    return out.select("doc_id", F.col("n_shingles"), mine.alias("component_id"), F.coalesce(F.col("doc_id") == mine, F.lit(True)).alias("kept"))


def _by_blocks(rest: DataFrame, reps: DataFrame, sets: DataFrame, scratch: Scratch, least: int) -> DataFrame:
    """Links between members of different components of the buckets in ``rest(key, id, component, n, hub, members)``."""
    # A member first goes to the hub of its largest bucket, then to the fullest such place that any of its buckets touches: few, full homes.
    start = scratch.keep(rest.groupBy("id").agg(F.max(F.struct("members", "key", "hub"))["hub"].alias("of")), "start")
    full_of = start.join(start.groupBy("of").agg(F.count("*").alias("size")), "of")
    best = rest.select("key", "id").join(full_of, "id").groupBy("key").agg(F.max(F.struct("size", "of")).alias("best"))
    home = scratch.keep(rest.join(best, "key").groupBy("id", "component", "n").agg(F.max("best")["of"].alias("of")), "of")
    top = home.groupBy("of", "component").count().groupBy("of").agg(F.max_by("component", F.struct("count", "component")).alias("top"))
    home = home.join(top, "of").withColumn("pure", F.when(F.col("component") == F.col("top"), F.col("top")))
    rank = F.coalesce("pure", F.lit(-1))
    blocks = F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / ITEMS)).cast("int").alias("blocks")
    size = home.groupBy("of", rank.alias("rank")).agg(blocks)
    home = home.withColumn("rank", rank).join(size, ["of", "rank"])
    home = scratch.keep(home.select("id", "component", "n", "pure", F.xxhash64("of", "rank", F.pmod(F.xxhash64("id"), F.col("blocks"))).alias("home")), "homes")
    places = scratch.keep(rest.select("key", "id").join(home.select("id", "home", "pure"), "id").select("key", "home", "pure").distinct(), "places")
    one, two = places.toDF("key", "i", "p"), places.toDF("key", "j", "q")
    meet = one.join(two, "key").where("i <= j AND coalesce(p <> q, true)").select("i", "j").distinct()
    full = home.drop("pure").join(reps.select("id", "bits"), "id").join(sets, "id")
    each = meet.withColumn("home", F.explode(F.array_distinct(F.array("i", "j")))).join(full, "home")
    return each.groupBy("i", "j").applyInPandas(lambda pdf: _meet(pdf, least), "a long, b long")
