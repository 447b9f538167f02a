"""Near-duplicate embeddings with a forest of random-projection trees whose splits overlap.

Each tree splits a label's vectors again and again at a random direction; vectors within ``SPILL`` of the threshold go to both
sides. Vectors that share a leaf are compared exactly (double precision), linked ones are united. For unit vectors of
cosine 0.98 a level tells a pair apart with a probability of about 0.0014, so six trees of ten levels miss one in
10**11 of the pairs that lie just at the limit, and fewer of the others.

* Equal vectors of a label (by a 128-bit digest) are one point with a weight: copies never meet each other in a leaf, and rows that belong to
  a point with very many are dealt out where the result goes back to them.
* A pair that shares several leaves is counted in the first of them only; leaves send counts and a spanning forest of their
  links, never all pairs.
* Leaves of more than ``BLOCK`` points are compared block by block, one pair of blocks a group.
* Thresholds come from a sample of ``SAMPLE`` vectors (in the order of a hash of vec_id); all vectors go through the trees. The
  depth follows the largest label's size. The forest has ``TREES * 2 ** NODES`` thresholds at most.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and those without a label, link
with nothing (0 links, a component of their own, kept). Vectors of different lengths are not compared. The nodes are vec_ids: repeated
rows are copies that link with each other. Rows with a null vec_id are returned alone, with a null component.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orbitflow.llm.common import Scratch, join_to_keys
from orbitflow.llm.components import components

COSINE = 0.98
TREES, LEAF, SPILL = 6, 48, 0.025
SAMPLE, NODES = 20_000, 10
BLOCK = 1024
SEED = 7


class Forest:
    """directions(tree, d) and thresholds[tree][level][node]; from level NODES on all nodes of a level share one."""

    def __init__(self, depth: int, sample: np.ndarray):
        self.depth, self.dim, self.cuts = depth, sample.shape[1] if len(sample) else 0, []
        for t in range(TREES):
            proj = sample @ self.directions(t, self.dim).T if len(sample) else np.zeros((0, depth))
            node, cuts = np.zeros(len(sample), np.int64), []
            for level in range(depth):
                wide = 1 << min(level, NODES)
                middle = float(np.median(proj[:, level])) if len(sample) else 0.0
                cut = np.full(wide if level < NODES else 1, middle)
                if level < NODES:
                    order = np.argsort(node, kind="stable")
                    for k, own in zip(*_groups(node[order], order)):
                        if len(own) >= 20:
                            cut[k] = np.median(proj[own, level])
                    node = 2 * node + (proj[:, level] >= cut[node])
                cuts.append(cut)
            self.cuts.append(cuts)

    def directions(self, tree: int, dim: int) -> np.ndarray:
        made = np.random.default_rng([SEED, tree, dim]).standard_normal((self.depth, dim))
        return made / np.linalg.norm(made, axis=1, keepdims=True)

    def leaves(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, code of tree and leaf) of every membership, rows in order."""
        rows, codes = [], []
        for t, cuts in enumerate(self.cuts):
            proj = units @ self.directions(t, units.shape[1]).T
            at, leaf = np.arange(len(units)), np.ones(len(units), np.int64)
            node = np.zeros(len(units), np.int64)
            for level, cut in enumerate(cuts):
                known = units.shape[1] == self.dim
                middle = (cut[node] if level < NODES else cut[0]) if known else 0.0
                p = proj[at, level]
                left, right = p < middle + SPILL, p >= middle - SPILL
                at, leaf, node = (np.concatenate(x) for x in ((at[left], at[right]), (2 * leaf[left], 2 * leaf[right] + 1), (2 * node[left], 2 * node[right] + 1)))
                if level + 1 >= NODES:
                    node = np.zeros(len(at), np.int64)
            rows.append(at)
            codes.append(leaf * TREES + t)
        rows, codes = np.concatenate(rows), np.concatenate(codes)
        order = np.lexsort((codes, rows))
        return rows[order], codes[order]


def _groups(keys: np.ndarray, values: np.ndarray):
    if not len(keys):
        return [], []
    cut = np.flatnonzero(np.diff(keys)) + 1
    return keys[np.r_[0, cut]], np.split(values, cut)


def _units(column: pd.Series) -> np.ndarray:
    x = np.stack([np.asarray(v, np.float64) for v in column])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _forest_links(ids: np.ndarray, i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links."""
    root = {}

    def top(x):
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    kept = []
    for a, b in zip(i.tolist(), j.tolist()):
        p, q = top(a), top(b)
        if p != q:
            root[max(p, q)] = min(p, q)
            kept.append((int(ids[a]), int(ids[b])))
    return kept


def _compare(pdf: pd.DataFrame) -> pd.DataFrame:
    """Counts (b the same as a) and links of a leaf, or of a pair of its blocks."""
    code, one, two = pdf["code"].iloc[0], pdf["i"].iloc[0], pdf["j"].iloc[0]
    pdf = pdf.sort_values("rep")
    ids, block, weight = pdf["rep"].to_numpy(), pdf["block"].to_numpy(), pdf["weight"].to_numpy()
    close = (u := _units(pdf["embedding"])) @ u.T >= COSINE
    i, j = np.nonzero(np.triu(close, 1))
    good = (np.minimum(block[i], block[j]) == one) & (np.maximum(block[i], block[j]) == two)
    i, j = i[good], j[good]
    before = [frozenset(x[: np.searchsorted(x, code)].tolist()) for x in pdf["codes"]] if len(i) else []
    first = np.array([before[a].isdisjoint(before[b]) for a, b in zip(i.tolist(), j.tolist())], bool)
    i, j = i[first], j[first]
    counts = np.bincount(i, weights=weight[j], minlength=len(ids)) + np.bincount(j, weights=weight[i], minlength=len(ids))
    linked = np.flatnonzero(counts)
    rows = [(int(ids[x]), int(ids[x]), int(counts[x])) for x in linked] + [(a, b, 0) for a, b in _forest_links(ids, i, j)]
    return pd.DataFrame(rows, columns=["a", "b", "links"]).astype("int64")


def classes(df: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """vec_id, n_links, component_id and kept for each row of ``df(vec_id, embedding, label)``."""
    spark = df.sparkSession
    scratch = scratch or Scratch(spark, "embeddings")
    rows = df.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", "label")
    digest = F.unhex(F.md5(F.to_json(F.struct("label", "embedding")).cast("binary")))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("embedding", lambda x: x != 0)
    usable = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite, F.lit(False))
    rows = rows.withColumn("key", F.when(usable, digest))
    points = rows.where("key IS NOT NULL").groupBy("key").agg(F.first("label").alias("label"), F.first("embedding").alias("embedding"), F.min("vec_id").alias("rep"), F.count("*").alias("weight"))
    points = scratch.keep(points.withColumn("dim", F.size("embedding")), "points")
    largest = points.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    depth = min(40, max(0, math.ceil(math.log(max(1, largest / LEAF)) / math.log(1 / 0.58))))
    taken = points.select("dim", "embedding", F.xxhash64("rep").alias("h")).orderBy("h").limit(SAMPLE).toPandas()
    dim = int(taken["dim"].mode().iloc[0]) if len(taken) else 0
    sample = _units(taken.loc[taken["dim"] == dim, "embedding"]) if len(taken) else np.zeros((0, 0))
    forest = spark.sparkContext.broadcast(Forest(depth, sample))

    def route(batches):
        for pdf in batches:
            for _, own in pdf.groupby("dim"):
                for lo in range(0, len(own), 2000):
                    part = own.iloc[lo : lo + 2000].reset_index(drop=True)
                    at, codes = forest.value.leaves(_units(part["embedding"]))
                    out = part.iloc[at].reset_index(drop=True)
                    each = np.split(codes, np.flatnonzero(np.diff(at)) + 1)
                    yield out.assign(code=codes, codes=[each[r] for r in at.tolist()])

    bare = points.drop("key")
    placed = bare.mapInPandas(route, T.StructType([*bare.schema.fields, T.StructField("code", T.LongType()), T.StructField("codes", T.ArrayType(T.LongType()))]))
    placed = scratch.keep(placed, "leaves")
    sizes = placed.groupBy("label", "dim", "code").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"), F.count("*").alias("points")).where("points > 1")
    dealt = placed.join(sizes, ["label", "dim", "code"]).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    made = scratch.keep(dealt.groupBy("label", "dim", "code", "i", "j").applyInPandas(_compare, "a long, b long, links long"), "links")
    of = components(made.where("a <> b").select("a", "b"), scratch)
    of = scratch.keep(of, "components").select(F.col("node").alias("rep"), "component")
    links = made.where("a = b").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    known = points.select("key", "rep", "weight", F.col("weight").alias("copies")).join(links, "rep", "left").join(of, "rep", "left")
    out = join_to_keys(rows.select("vec_id", "key"), known, "key", "copies", "vec_id")
    component = F.coalesce("component", "rep", "vec_id")
    n = F.coalesce(F.col("weight") - 1 + F.coalesce("links", F.lit(0)), F.lit(0)).cast("long")
    return out.select("vec_id", n.alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
