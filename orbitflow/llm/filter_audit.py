"""How filters interact: what each of five filters removes, at every step of each of their 120 orders.

A document fails a set of filters. Applied after a set ``S`` of others, a filter ``f`` meets it, removes it or finds it gone already, whatever
the order within ``S``: an order of all filters is a path of five edges ``(S, f)`` through the lattice of subsets. So documents
are counted by part, failures and labels alone, the counts go to the 80 edges, and each of the 600 steps reads the figures of its edge.

Duplicates are settled before: rows are counted by (text digest, part, failures, labels) with their smallest doc_id, so a text of very many
copies reaches the join that finds its smallest doc_id as a few rows. Equality of texts is that of their SHA-256.

Defined results: a null text is the empty text, a null source the part ''. A row without doc_id has no labels, is never a copy and makes no other row one. Rows of one doc_id
are judged each by its own text and source. A doc_id labelled several times is good (toxic) if one label says so. No documents, no rows. Extra columns are ignored.
"""

from __future__ import annotations

from itertools import combinations, permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Filters by name, in the order of their bits.
FILTERS = "ABCDE"
COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]
#: The only copies filter, which needs the whole table.
COPIES = FILTERS.index("E")
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def failures(text: Column) -> Column:
    """Bits of the filters that a text fails by itself: under 50 words, under 65 % distinct words, over 5 % capitals, a sign of markup."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n, code_points = F.size(words), F.char_length(text)
    capitals = code_points - F.char_length(F.translate(text, _UPPER, ""))
    tests = [n < 50, 100 * F.size(F.array_distinct(words)) < 65 * n, 100 * capitals > 5 * code_points, text.rlike("[#$%&*|]")]
    mask = F.lit(0)
    for bit, failed in enumerate(tests):
        mask = mask + F.when(failed, 1 << bit).otherwise(0)
    return mask


def profiles(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, good, toxic, n): how many documents of a part fail just the filters of ``mask``."""
    text = F.coalesce("text", F.lit(""))
    slim = documents.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), failures(text).alias("mask"), F.sha2(text, 256).alias("digest"))
    flags = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    known = slim.where("doc_id IS NOT NULL").join(flags, "doc_id", "left")
    own = ["part", "mask", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic")]
    # Partitioned by doc_id already: repeated rows become one row with a count, so that the smallest doc_id of a group is one row.
    rows = known.groupBy("doc_id", "digest", *own).agg(F.count("*").alias("n"))
    groups = rows.groupBy("digest", "part", "mask", "good", "toxic").agg(F.min(F.struct("doc_id", "n")).alias("low"), F.sum("n").alias("n"))
    firsts = groups.groupBy("digest").agg(F.min("low.doc_id").alias("first"))
    judged = groups.join(firsts, "digest").withColumn("unique", F.when(F.col("low.doc_id") == F.col("first"), F.col("low.n")).otherwise(F.lit(0).cast("long")))
    kinds = F.explode(F.array(F.struct(F.col("mask"), F.col("unique").alias("n")), F.struct((F.col("mask") + (1 << COPIES)).alias("mask"), (F.col("n") - F.col("unique")).alias("n"))))
    nameless = slim.where("doc_id IS NULL").select("part", "mask", F.lit(False).alias("good"), F.lit(False).alias("toxic"), F.lit(1).cast("long").alias("n"))
    told = judged.select("part", "good", "toxic", kinds.alias("k")).select("part", "k.mask", "good", "toxic", "k.n").unionByName(nameless)
    return told.groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n"))


def edges(counts: DataFrame) -> DataFrame:
    """(part, applied, filter, COUNTS, shapley) of the 80 edges of each part; ``applied`` and ``filter`` are bits."""
    places = range(len(FILTERS))
    pairs = [(sum(1 << i for i in some), f) for size in places for some in combinations(places, size) for f in places if f not in some]
    edge = F.explode(F.array(*[F.struct(F.lit(s).alias("applied"), F.lit(1 << f).alias("filter")) for s, f in pairs]))
    met = counts.select("*", edge.alias("e")).select("part", "mask", "good", "toxic", "n", "e.applied", "e.filter")
    mask, s, f = F.col("mask"), F.col("applied"), F.col("filter")
    fails, gone = mask.bitwiseAND(f) != 0, mask.bitwiseAND(s) != 0
    tests = [~fails & ~gone, fails & ~gone, fails & gone, mask == f, fails & ~gone & F.col("good"), fails & ~gone & F.col("toxic")]
    sums = met.groupBy("part", "applied", "filter").agg(*[F.sum(F.when(t, F.col("n")).otherwise(F.lit(0).cast("long"))).alias(c) for t, c in zip(tests, COUNTS)])
    # In how many orders a filter comes after just this set: the orders of the set times those of what is left.
    weights = {s: factorial(k := bin(s).count("1")) * factorial(len(FILTERS) - 1 - k) for s, _ in pairs}
    times = F.element_at(F.create_map(*[F.lit(int(x)) for kv in weights.items() for x in kv]), s)
    return sums.withColumn("shapley", F.sum(F.col("removed") * times).over(Window.partitionBy("part", "filter")))


def audit(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, COUNTS and shapley: 600 rows a part."""
    steps = [("".join(p), k + 1, sum(1 << FILTERS.index(x) for x in p[:k]), 1 << FILTERS.index(p[k])) for p in permutations(FILTERS) for k in range(len(p))]
    paths = documents.sparkSession.createDataFrame(steps, "filter_order string, step int, applied int, filter int")
    joined = edges(profiles(documents, labels)).join(F.broadcast(paths), ["applied", "filter"])
    return joined.select("part", "filter_order", "step", *COUNTS, "shapley")
