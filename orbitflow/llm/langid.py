"""Language identification with language-bitmask n-gram filters.

Training counts letter trigrams by language, keeps those that are common in a language compared with the language where
they are most common, and puts them into one Bloom filter for each language. The filters are bit-sliced: slot ``i`` holds
a mask with one bit a language, so that the AND of a trigram's slots returns all languages that contain it. A text's
score in a language is its share of trigrams found there, corrected by the filter's false-positive rate
``fill ** hashes``; the largest share wins and ties go to the language that sorts first.

Counts are aggregated by Spark (one row for each language and trigram of a chunk before the shuffle). The filter has
``slots`` rows at most, whatever the input, and only it is sent to the driver and broadcast.

Defined results: null texts and texts without a letter are ``und`` with score 0, as is everything if nothing was learned;
each row gives one row, also when rows repeat; empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orbitflow.llm.common import Scratch, slices, with_columns

SLOTS = 1 << 20
HASHES = 3
#: A trigram belongs to a language if it is this common there, against the language where it is most common.
SHARE = 0.2
#: Trigrams rarer than this share of a language's trigrams are left out: a measure of the language's own size, so that small languages keep theirs.
RARE = 2e-5
#: Languages in one mask.
BITS = 60


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Trigrams (three code points of 21 bits, non-letters as blanks, two letters at least) of lower-cased texts, and the text of each."""
    low = [t.lower() for t in texts]
    lens = np.array([len(t) + 2 for t in low], np.int64)  # a blank on both sides: no trigram has letters of two texts, and neighbours do not matter
    joined = "".join(f" {t} " for t in low)
    points = np.frombuffer(joined.encode("utf-32-le"), "<u4").astype(np.uint64)
    letter = letters()[points]
    points[~letter] = 32
    if len(points) < 3:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    grams = (points[:-2] << np.uint64(42)) | (points[1:-1] << np.uint64(21)) | points[2:]
    good = letter[:-2].astype(np.int8) + letter[1:-1] + letter[2:] >= 2
    at = np.flatnonzero(good)
    return grams[at], np.searchsorted(np.cumsum(lens), at, side="right")


_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    if not _letters:
        _letters.append(np.array([chr(c).isalpha() for c in range(0x110000)]))
    return _letters[0]


def slot(grams: np.ndarray, k: int) -> np.ndarray:
    """Slot of each trigram under hash function ``k``."""
    x = grams + np.uint64(0x9E3779B97F4A7C15 * (k + 1) % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) % np.uint64(SLOTS)).astype(np.int64)


def _count(batches):
    for pdf in batches:
        for lang, texts in pdf.groupby("lang")["text"]:
            for _, some in slices(texts):
                grams, n = np.unique(trigrams(some)[0], return_counts=True)
                yield pd.DataFrame({"lang": lang, "gram": grams.astype(np.int64), "n": n.astype(np.int64)})


def _slots(batches):
    for pdf in batches:
        for k in range(HASHES):
            yield pd.DataFrame({"slot": slot(pdf["gram"].to_numpy().astype(np.uint64), k), "word": pdf["word"], "mask": pdf["mask"]})


class Filters:
    """languages (sorted) and masks[word, slot]; BITS languages a word."""

    def __init__(self, languages: list[str], masks: np.ndarray):
        self.languages, self.masks = languages, masks
        self.false = np.array([float(((masks[i // BITS] >> (i % BITS)) & 1).mean()) ** HASHES for i in range(len(languages))])

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        grams, owner = trigrams(texts)
        n = np.bincount(owner, minlength=len(texts))
        if not self.languages:
            return ["und"] * len(texts), [0.0] * len(texts)
        at = [slot(grams, k) for k in range(HASHES)]
        shares = np.zeros((len(self.languages), len(texts)))
        for w, table in enumerate(self.masks):
            mask = table[at[0]]
            for a in at[1:]:
                mask = mask & table[a]
            for i in range(w * BITS, min((w + 1) * BITS, len(self.languages))):
                hits = np.bincount(owner, weights=((mask >> (i % BITS)) & 1), minlength=len(texts))
                found = hits / np.maximum(n, 1)
                shares[i] = np.clip((found - self.false[i]) / max(1 - self.false[i], 1e-9), 0, 1)
        best, total = shares.argmax(0), shares.sum(0)
        langs, scores = [], []
        for j, t in enumerate(texts):
            if n[j] == 0 and not any(c.isalpha() for c in t):
                langs.append("und")
                scores.append(0.0)
            else:
                langs.append(self.languages[best[j]])
                scores.append(float(shares[best[j], j] / total[j]) if total[j] else 0.0)
        return langs, scores


def train(labelled: DataFrame, scratch: Scratch | None = None) -> Filters:
    """Filters from the columns text and lang; rows where either is null are left out."""
    spark = labelled.sparkSession
    rows = labelled.select(F.col("text"), F.col("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    counts = rows.mapInPandas(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    by_gram = counts.groupBy("gram").agg(F.collect_list(F.struct("lang", "n")).alias("by"))  # as many entries as languages
    by_gram = (scratch or Scratch(spark, "language")).keep(by_gram, "trigrams")
    totals = {r["lang"]: r["n"] for r in by_gram.select(F.explode("by").alias("x")).groupBy("x.lang").agg(F.sum("x.n").alias("n")).collect()}
    languages = sorted(totals)
    if not languages:
        return Filters([], np.zeros((1, SLOTS), np.int64))
    known = spark.createDataFrame([(x, i // BITS, 1 << (i % BITS), float(totals[x])) for i, x in enumerate(languages)], "lang string, word int, mask long, total double")
    each = by_gram.select("gram", F.explode("by").alias("x")).select("gram", "x.lang", "x.n").join(F.broadcast(known), "lang")
    most = each.groupBy("gram").agg(F.max(F.col("n") / F.col("total")).alias("most"), F.collect_list(F.struct("word", "mask", "n", (F.col("n") / F.col("total")).alias("rate"))).alias("by"))
    chosen = most.select("gram", "most", F.explode("by").alias("x")).where((F.col("x.rate") >= SHARE * F.col("most")) & (F.col("x.rate") >= RARE))
    by_word = chosen.groupBy("gram", "x.word").agg(F.bit_or("x.mask").alias("mask")).select("gram", "word", "mask")
    filled = by_word.mapInPandas(_slots, "slot long, word int, mask long").groupBy("slot", "word").agg(F.bit_or("mask").alias("mask")).toPandas()
    masks = np.zeros((-(-len(languages) // BITS), SLOTS), np.int64)
    masks[filled["word"].to_numpy(), filled["slot"].to_numpy()] = filled["mask"].to_numpy()
    return Filters(languages, masks)


def predict(df: DataFrame, filters: Filters, text: str = "text") -> DataFrame:
    """``df`` with lang_pred and score instead of ``text``, which is all that is looked at."""
    shared = df.sparkSession.sparkContext.broadcast((filters.languages, filters.masks))

    def make():
        work = Filters(*shared.value)

        def run(texts):
            both = [work.predict(some) for _, some in slices(texts)]
            return [x for a, _ in both for x in a], [x for _, b in both for x in b]

        return run

    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    return with_columns(df, [text], fields, make, drop=(text,))
