"""Toxicity by maximum-scoring segments of token log-odds.

A token's score is the logarithm of its share among toxic training texts over its
share among the others, each smoothed by a Dirichlet prior in proportion to its
share among both; tokens whose score is not significant share one, slightly
negative, score: that of meeting any of them.  Such scores have a negative mean in
clean text, so the segments of a text with the highest sums stand out; a linear
scan finds all maximal ones.  Sums of this kind follow an extreme-value law in
clean text: a segment's evidence is its sum less the logarithm of K times the
text's length, where K is fitted to the clean training texts (or, where few of
them have any segment, is the share of telling tokens in toxic ones, its bound).  A text's best
segment and all its significant ones together are mapped to a probability by a
logistic fit to the training labels.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm._batches import kept_rows, map_chunks, texts
from quire.llm.decontaminate import words
from quire.llm.store import released, written

#: Labelled rows that the classifier is fitted on at most: those whose hashed ids are least.
TRAIN_ROWS = 20_000
#: Sum of the Dirichlet prior's parameters, in tokens.
PRIOR = 2_000.0
#: A token has a score of its own if, by chance, so many of all tokens at most would have so uneven a split between the labels.
CHANCE = 0.01
#: Evidence (in nats) from which a segment counts as significant: at most one in 20 clean texts has one by chance.
SIGNIFICANT = math.log(20)
#: Tokens longer than this stand in the model as their hash, so that it stays small.
LONGEST = 64
#: Clean training texts with any segment from which K is fitted; with fewer, K is the bound that the log-odds give.
FITTED = 20


@dataclass
class Model:
    """What scoring needs: bounded by the training rows, whatever the corpus."""

    scores: dict[bytes, float] = field(default_factory=dict)
    other: float = -1e-3
    log_k: float = 0.0
    weights: tuple[float, float, float] = (-20.0, 0.0, 0.0)


def tokens(text: bytes) -> list[bytes]:
    """The words of a text; long ones as a hash of theirs."""
    found = words(text)
    if len(max(found, key=len, default=b"")) <= LONGEST:
        return found
    return [w if len(w) <= LONGEST else b"\0" + hashlib.blake2b(w, digest_size=16).digest() for w in found]


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (begin, end, sum), by the linear-time scan.

    Only positive scores start or grow a segment; a segment is joined with an
    earlier one when that one starts lower and ends lower than the new one's end.
    Each segment remembers the last one before it that starts lower, so none that
    starts as high is looked at twice for the same end.
    """
    total = np.cumsum(scores)
    found: list[tuple] = []  # begin, end, sum before it, sum at its end, the last earlier segment that starts lower
    at = np.nonzero(scores > 0)[0]
    for k, left, right in zip(at.tolist(), (total[at] - scores[at]).tolist(), total[at].tolist(), strict=True):
        begin, j = k, len(found) - 1
        while True:
            while j >= 0 and found[j][2] >= left:
                j = found[j][4]
            if j < 0 or found[j][3] >= right:
                break
            begin, _, left, _, below = found[j]
            del found[j:]
            j = below
        found.append((begin, k + 1, left, right, j))
    return [(b, e, right - left) for b, e, left, right, _ in found]


class Scorer:
    def __init__(self, model: Model) -> None:
        self.model, self.get = model, model.scores.get

    def passages(self, text: bytes) -> tuple[int, list[tuple[int, int, float]]]:
        """Number of tokens; the maximal segments with their evidence."""
        found = tokens(text)
        if self.model.scores.keys().isdisjoint(found):
            return len(found), []
        other = self.model.other
        scores = np.array([self.get(w, other) for w in found])
        chance = self.model.log_k + math.log(len(found))
        return len(found), [(b, e, s - chance) for b, e, s in segments(scores)]

    def features(self, text: bytes) -> tuple[float, float, list[tuple[int, int, float]]]:
        """Best evidence, the logarithm of all significant evidence, and the significant passages."""
        _, found = self.passages(text)
        best = max((x for *_, x in found), default=0.0)
        clear = [p for p in found if p[2] >= SIGNIFICANT]
        return max(best, 0.0), math.log1p(sum(x for *_, x in clear)), clear

    def score(self, best: float, total: float) -> float:
        a, b, c = self.model.weights
        return 1.0 / (1.0 + math.exp(-max(-500.0, min(500.0, a + b * best + c * total))))


def held_out(doc_id: str = "doc_id"):
    """Whether a row's label may not be learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Weights of a logistic regression by Newton's method with a little ridge; slopes are kept from falling below zero."""
    x = np.column_stack([np.ones(len(x)), x])
    keep = list(range(x.shape[1]))
    while True:
        w = np.zeros(len(keep))
        part = x[:, keep]
        ridge = np.diag([1e-6, *[1e-2] * (len(keep) - 1)])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(part @ w, -30, 30)))
            step = np.linalg.solve((part * (p * (1 - p))[:, None]).T @ part + ridge, part.T @ (y - p) - ridge @ w)
            w += step
            if np.abs(step).max() < 1e-8:
                break
        low = [k for k, v in zip(keep[1:], w[1:], strict=True) if v < 0]
        if not low:
            out = np.zeros(x.shape[1])
            out[keep] = w
            return tuple(float(v) for v in out)
        keep.remove(low[0])


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit a model to the labels that may be learned from, on at most `rows` of them.

    A document with labels that differ, or null, is left out; texts that repeat
    count once for each label they have.  Without both labels the model knows no
    token and scores every text alike: by the share of toxic rows, or near 0.
    """
    own = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)").where(~held_out())
    own = own.groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("z")).where("y = z").drop("z")
    own = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    spark = docs.sparkSession
    picked = spark.createDataFrame([tuple(r) for r in own.collect()], "doc_id long, y int")  # at most `rows` pairs of numbers
    sample = texts(docs, id_col, text_col).join(F.broadcast(picked), "doc_id").select("y", "text").distinct()
    sample = written(sample, "sample")  # read four times

    def make():
        def step(ys, blobs):
            counts = (Counter(), Counter())
            for y, b in zip(ys, blobs, strict=True):
                counts[y].update(set(tokens(b)))
            both = list(counts[0].keys() | counts[1].keys())
            return {"word": both, "clean": [counts[0][w] for w in both], "toxic": [counts[1][w] for w in both]}

        return step

    counted = map_chunks(sample, "word binary, clean long, toxic long", make).groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    counted = written(counted, "counted")
    n0, n1, size = (float(x or 0) for x in counted.agg(F.sum("clean"), F.sum("toxic"), F.count(F.lit(1))).first())
    share = (F.col("clean") + F.col("toxic")) / (n0 + n1 or 1.0) * PRIOR
    t, c = F.col("toxic") + share, F.col("clean") + share
    both, rate = F.col("clean") + F.col("toxic"), n1 / (n0 + n1 or 1.0)
    q = F.col("toxic") / both
    part = lambda q, p: F.when(q > 0, q * F.log(q / p)).otherwise(0.0)
    uneven = both * (part(q, rate) + part(1 - q, 1 - rate))  # Chernoff's bound: minus the logarithm of the chance
    told = counted.select("word", (t / (n1 + PRIOR)).alias("p1"), (c / (n0 + PRIOR)).alias("p0"), uneven.alias("uneven"))
    clear = told.where(F.col("uneven") >= math.log(size / CHANCE)).collect() if n0 and n1 else []
    released(counted)
    model = Model({bytes(r.word): math.log(r.p1 / r.p0) for r in clear})
    if clear:
        rest1, rest0 = 1 - sum(r.p1 for r in clear), 1 - sum(r.p0 for r in clear)
        model.log_k = math.log(max(sum(r.p1 for r in clear if r.p1 > r.p0), 1e-9))
        model.other = min(-1e-3, math.log(max(rest1, 1e-9) / max(rest0, 1e-9)))
    model = _calibrated(sample, model)
    released(sample)
    return model


def _calibrated(sample: DataFrame, model: Model) -> Model:
    """Fit K to the clean texts' best segments and the logistic map to all labels."""

    def rows(model: Model) -> list:
        held = sample.sparkSession.sparkContext.broadcast(model)

        def make():
            scorer = Scorer(held.value)

            def step(ys, blobs):
                found = [scorer.features(b) for b in blobs]
                bests = [max((x for *_, x in scorer.passages(b)[1]), default=None) for b in blobs]
                return {"y": ys, "best": [f[0] for f in found], "total": [f[1] for f in found], "raw": bests}

            return step

        return map_chunks(sample.select(F.col("y").cast("long").alias("doc_id"), "text"), "y long, best double, total double, raw double", make).collect()

    clean = [r.raw for r in rows(model) if r.y == 0]
    raw = [x for x in clean if x is not None]
    if len(raw) >= FITTED:
        # Clean texts' evidence has a Gumbel law with scale 1: its middle value, among those that have any, gives K.
        model.log_k += float(np.median(raw) + math.log(-math.log1p(-0.5 * len(raw) / len(clean))))
    found = rows(model)
    y = np.array([r.y for r in found], float)
    if not len(y):
        return model
    if y.min() == y.max():
        p = min(max(y.mean(), 1e-6), 1 - 1e-6)
        model.weights = (math.log(p / (1 - p)), 0.0, 0.0)
        return model
    model.weights = _logistic(np.array([[r.best, r.total] for r in found]), y)
    return model


def score(docs: DataFrame, model: Model, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted, passages (array of begin, end in tokens, evidence) of each whole text.

    A null or empty text scores as one without evidence; rows that repeat are each
    scored.  The label, source and language are never read.  There is no shuffle.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        scorer = Scorer(held.value)

        def step(ids, blobs):
            found = [scorer.features(b) for b in blobs]
            return {
                "doc_id": ids,
                "score": [scorer.score(best, total) for best, total, _ in found],
                "passages": [[dict(begin=b, end=e, evidence=x) for b, e, x in p] for *_, p in found],
            }

        return step

    schema = "doc_id long, score double, passages array<struct<begin:int,end:int,evidence:double>>"
    scored = map_chunks(texts(docs, id_col, text_col), schema, make)
    return scored.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"), "passages")


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The rows of `docs`, all their columns, whose own text is not predicted toxic; they are not shuffled."""
    held = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    def make():
        scorer = Scorer(held.value)
        return lambda blobs: [scorer.score(*scorer.features(b)[:2]) < threshold for b in blobs]

    return kept_rows(docs, make)
