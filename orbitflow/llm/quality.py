"""Document quality by co-training.

Two views of a document never see each other's features: the text (how its character classes follow each other, words
and lines that repeat) and the metadata (source, language, length). Each view has a logistic classifier. In each round every
classifier scores all unlabelled documents and labels those that it is surest of (``SURE``; the ``GROW * round`` surest of either kind), and the other one learns from them with the
labelled ones. In the end both are calibrated on labelled documents held out from training, and a logistic combination of the calibrated views
scores every document.

Features of all documents are computed once and kept in the shared folder; a round is a pass over them, and what is shuffled is an id and two numbers for
a document. Training takes at most ``LABELLED`` labelled documents, the first in the order of a hash of doc_id; the driver gets their features and those of the
pseudo-labelled ones. Scoring maps over all documents and their whole texts, with no shuffle.

Defined results: null texts count as empty, null metadata as a value of its own. Without labels of both kinds every document
scores 0.5 and is kept, and so is one that scores exactly 0.5. Each row gives a row; labels of a doc_id that repeat count each; rows with no doc_id are scored, but nothing is
learned from them; of equally sure documents those with the smaller hash, then the smaller doc_id come first; other columns pass through.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orbitflow.llm.common import Scratch, with_columns

#: Most labelled documents that are learned from.
LABELLED = 12_000
#: Rounds, least confidence of a pseudo-label, and pseudo-labels of a kind that a view adds in each round.
ROUNDS, SURE, GROW = 3, 0.97, 400
#: Documents with a lower score go.
KEEP = 0.5
#: Share of labelled documents that only calibrate.
HELD = 4
CLASSES = 24
_SINGLE = "!#$%&*|.,;:-\"'()"


def _table() -> np.ndarray:
    """Character class of each byte: some punctuation stands for itself."""
    out = np.full(256, 1, np.int64)
    for b in range(256):
        c = chr(b)
        out[b] = 2 if b >= 0x80 else 3 if c.isupper() else 4 if c.islower() else 5 if c.isdigit() else 6 if c == " " else 7 if c == "\n" else 8 + _SINGLE.index(c) if c in _SINGLE else 1
    return out


_BYTES = _table()


def text_features(text: str | None) -> np.ndarray:
    raw = np.frombuffer((text or "").encode(), np.uint8)
    words = (text or "").split()
    out = np.zeros(CLASSES * CLASSES + 6)
    if not len(raw) or not words:
        out[-1] = 1
        return out
    c = _BYTES[raw]
    pairs = np.bincount(c[:-1] * CLASSES + c[1:], minlength=CLASSES * CLASSES)
    out[:-6] = np.sqrt(pairs / max(1, len(raw) - 1))
    lines = text.split("\n")
    out[-6] = len(set(words)) / len(words)
    out[-5] = sum(a == b for a, b in zip(words, words[1:])) / len(words)
    out[-4] = len(set(lines)) / len(lines)
    out[-3] = np.log1p(len(words)) / 10
    out[-2] = min(len(raw) / len(words), 50) / 10
    return out


META = 64 + 16 + 24 + 3


def meta_features(source, lang, n_chars) -> np.ndarray:
    out = np.zeros(META)
    for value, base, size in ((source, 0, 64), (lang, 64, 16)):
        if isinstance(value, str):
            out[base + zlib.crc32(value.encode()) % size] = 1
        else:
            out[META - 3 + (base > 0)] = 1
    if n_chars is None or n_chars != n_chars:
        out[META - 1] = 1
    else:
        out[80 + min(23, int(2 * np.log2(1 + max(0, n_chars)) / 2))] = 1
    return out


def both_views(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """Features of (text, source, lang, n_chars)."""
    return np.stack([text_features(r[0]) for r in rows]), np.stack([meta_features(*r[1:]) for r in rows])


#: Rows whose standardised features are in memory at once while fitting.
AT_ONCE = 2000


class Logistic:
    """Logistic regression with an L2 penalty by Newton steps over the rows of ``x`` and of further ``more`` (x, y); features are standardised a few rows at a time, no block is copied."""

    def __init__(self, x: np.ndarray, y: np.ndarray, *more: tuple[np.ndarray, np.ndarray], penalty: float = 1.0):
        parts = [(a[i : i + AT_ONCE], b[i : i + AT_ONCE]) for a, b in ((x, y), *more) for i in range(0, len(a), AT_ONCE)]
        rows = sum(len(b) for _, b in parts)
        self.mean = sum(a.sum(0, dtype=np.float64) for a, _ in parts) / rows
        self.std = np.sqrt(sum(((a - self.mean) ** 2).sum(0) for a, _ in parts) / rows) + 1e-3
        n = x.shape[1] + 1
        self.w, ridge = np.zeros(n), np.full(n, penalty)
        ridge[-1] = 1e-6
        for _ in range(12):
            slope, bend = -ridge * self.w, np.diag(ridge)
            for a, goal in parts:
                z = self._ready(a)
                p = self._p(z @ self.w)
                slope += z.T @ (goal - p)
                bend += (z * (p * (1 - p) + 1e-6)[:, None]).T @ z
            step = np.linalg.solve(bend, slope)
            self.w += step
            if np.abs(step).max() < 1e-4:
                break

    def _ready(self, x):
        return np.hstack([np.clip((x - self.mean) / self.std, -8, 8), np.ones((len(x), 1))])

    @staticmethod
    def _p(logit):
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))

    def logit(self, x: np.ndarray, rows: np.ndarray | None = None) -> np.ndarray:
        rows = np.arange(len(x)) if rows is None else rows
        return np.concatenate([np.clip(self._ready(x[rows[i : i + AT_ONCE]]) @ self.w, -30, 30) for i in range(0, len(rows), AT_ONCE)] or [np.zeros(0)])

    def p(self, x: np.ndarray, rows: np.ndarray | None = None) -> np.ndarray:
        return self._p(self.logit(x, rows))


class CoTrained:
    """The two views' classifiers, their calibrations and the combination; ``views`` is None if nothing could be learned.

    ``x`` has both views' features of the labelled rows, ``y`` their labels, ``held`` those that only calibrate. ``surest(views, most)`` gives for each view the pseudo-labelled
    rows that it gets from the other one: their features in the view and their labels.
    """

    def __init__(self, x: tuple, y: np.ndarray, held: np.ndarray, surest: Callable):
        self.views = None
        train, calibrate = np.flatnonzero(~held), np.flatnonzero(held)
        if len(set(y[train])) < 2 or len(set(y[calibrate])) < 2:
            return
        own, extra = [x[v][train] for v in range(2)], [(x[v][:0], y[:0]) for v in range(2)]
        for r in range(ROUNDS + 1):
            views = [Logistic(own[v], y[train], extra[v]) for v in range(2)]
            if r < ROUNDS:
                extra = surest(views, GROW * (r + 1))
        self.views = views
        self.scales = [Logistic(views[v].logit(x[v], calibrate)[:, None], y[calibrate]) for v in range(2)]
        self.both = Logistic(self._calibrated(x, calibrate), y[calibrate])

    def _calibrated(self, x: tuple, rows: np.ndarray | None = None) -> np.ndarray:
        return np.stack([self.scales[v].logit(self.views[v].logit(x[v], rows)[:, None]) for v in range(2)], 1)

    def score(self, x: tuple) -> np.ndarray:
        """Columns: text view, metadata view, combination."""
        if self.views is None:
            return np.full((len(x[0]), 3), 0.5)
        logits = self._calibrated(x)
        return np.column_stack([Logistic._p(logits), self.both.p(logits)])


_COLUMNS = ["doc_id", "text", "source", "lang", "n_chars"]
_PACKED = "doc_id long, a binary, b binary"


def _pack(view: np.ndarray) -> list[bytes]:
    return [zlib.compress(row.tobytes(), 1) for row in view.astype(np.float16)]


def _unpack(column) -> np.ndarray:
    """Features as they were packed: in half precision, which is also how they are held."""
    return np.frombuffer(b"".join(map(zlib.decompress, column)), np.float16).reshape(len(column), -1)


def _features(batches):
    for pdf in batches:
        for lo in range(0, len(pdf), 200):
            part = pdf.iloc[lo : lo + 200]
            a, b = both_views(list(zip(*(part[c] for c in _COLUMNS[1:]))))
            yield pd.DataFrame({"doc_id": part["doc_id"], "a": _pack(a), "b": _pack(b)})


def train(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, scratch: Scratch | None = None) -> CoTrained:
    """Learn from ``labels(doc_id, quality)`` and all unlabelled documents."""
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "quality")
    usable = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *_COLUMNS[1:]).where("doc_id IS NOT NULL")
    views = scratch.keep(usable.mapInPandas(_features, _PACKED), "views")
    known = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("quality") > 0.5).cast("double").alias("y"))
    some = known.join(views.select("doc_id"), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(labelled)

    def fetched(wanted: list, columns: str) -> pd.DataFrame:
        """Features of ``wanted`` (doc_id, y), in the order of both; at most ``labelled``, or ``2 * GROW * ROUNDS`` rows and their repetitions."""
        rows = spark.createDataFrame(wanted, "doc_id long, y double")
        return views.select("doc_id", *columns).join(F.broadcast(rows), "doc_id").toPandas().sort_values(["doc_id", "y"], ignore_index=True)

    def surest(models: list[Logistic], most: int) -> list[tuple]:
        shared = spark.sparkContext.broadcast(models)

        def scored(batches):
            for pdf in batches:
                for lo in range(0, len(pdf), AT_ONCE):
                    part = pdf.iloc[lo : lo + AT_ONCE]
                    made = pd.DataFrame({"doc_id": part["doc_id"], **{f"p{v}": shared.value[v].p(_unpack(part["ab"[v]].tolist())) for v in range(2)}})
                    yield made[((made[["p0", "p1"]] >= SURE) | (made[["p0", "p1"]] <= 1 - SURE)).any(axis=1)]

        sure = views.mapInPandas(scored, "doc_id long, p0 double, p1 double").join(known.select("doc_id"), "doc_id", "left_anti").distinct()
        sure = scratch.keep(sure.withColumn("h", F.xxhash64("doc_id")), "sure")
        out = []
        for v in range(2):  # what the other view is surest of
            p = F.col(f"p{1 - v}")
            yes = sure.where(p >= SURE).orderBy(p.desc(), "h", "doc_id").limit(most).select("doc_id").collect()
            no = sure.where(p <= 1 - SURE).orderBy(p, "h", "doc_id").limit(most).select("doc_id").collect()
            got = fetched([*((r["doc_id"], 1.0) for r in yes), *((r["doc_id"], 0.0) for r in no)], "ab"[v])
            out.append((_unpack(got["ab"[v]].tolist()), got["y"].to_numpy(float)) if len(got) else (x[v][:0], y[:0]))
        scratch.drop(sure)
        shared.destroy()
        return out

    got = fetched([tuple(r) for r in some.collect()], "ab")
    if got.empty:
        return CoTrained((np.zeros((0, 1)),) * 2, np.zeros(0), np.zeros(0, bool), surest)
    x, y = tuple(_unpack(got.pop(c).tolist()) for c in "ab"), got["y"].to_numpy(float)
    held = np.array([zlib.crc32(str(i).encode()) % HELD == 0 for i in got["doc_id"]])
    return CoTrained(x, y, held, surest)


def score(df: DataFrame, model: CoTrained) -> DataFrame:
    """``df`` with text_score, meta_score, score and kept."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def make():
        def run(*columns):
            rows = list(zip(*columns))
            parts = [shared.value.score(both_views(rows[lo : lo + 200])) for lo in range(0, len(rows), 200)]
            out = np.vstack([*parts, np.zeros((0, 3))])
            return [*out.T, out[:, 2] >= KEEP]

        return run

    fields = [*(T.StructField(c, T.DoubleType()) for c in ("text_score", "meta_score", "score")), T.StructField("kept", T.BooleanType())]
    return with_columns(df, _COLUMNS[1:], fields, make)
