"""Toxicity scores from a counterfactually regularised logistic regression.

Features are the words of a text and the beginnings of its longer words. Which of them say something about the label is
counted over all training rows; the weights are fitted on a bounded sample of them. For each sampled text that mentions a
group of people, a second one is made in which the terms are swapped for others of the same kind; the fit is penalised by
the squared difference of the two scores, so that a mention of a group carries no weight of its own.

A feature gets a weight if its correlation with the label is EFFECT or more, whatever the number of rows, and is no
accident of few rows (SIGNIFICANCE). A feature that correlates so much is in a certain share of the texts of its label, so
there can be no more of them than such shares have room for: their number goes with the words of a text, not with rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnpath.llm.common import durable, forget, whole

FOLDS, HELD, THRESHOLD = 4, 2, 0.3
#: Labelled rows that the weights are fitted on, about; the least correlation of a feature, and in how many standard deviations.
SAMPLE, EFFECT, SIGNIFICANCE = 20_000, 0.03, 3.0
PREFIXES = (4, 5, 6)
#: Penalties of the squared weights, and of the squared differences of scores; steps of the fit, and those it looks back on.
RIDGE, COUNTERFACTUAL, STEPS, MEMORY = 1.0, 200.0, 300, 12
#: Labelled texts whose ids are sent to where the texts are; more of them meet the texts in a shuffle.
FEW = 1 << 20
#: Features a task counts before it hands the counts on.
FLUSH = 400_000
#: Terms for groups of people; each is swapped for the next in its list.
IDENTITY = [
    ["women", "men"], ["woman", "man"], ["girl", "boy"], ["mother", "father"], ["muslim", "christian", "jewish", "hindu", "buddhist"], ["muslims", "christians", "jews", "hindus", "buddhists"],
    ["black", "white", "asian", "latino"], ["gay", "straight", "lesbian", "bisexual"], ["immigrant", "native"], ["immigrants", "natives"], ["african", "european", "american", "mexican"], ["disabled", "healthy"], ["transgender", "cisgender"], ["old", "young"],
    ["femmes", "hommes"], ["femme", "homme"], ["musulman", "chrétien", "juif"], ["frauen", "männer"], ["frau", "mann"], ["muslime", "christen", "juden"], ["mujeres", "hombres"], ["mujer", "hombre"], ["musulmán", "cristiano", "judío"],
]
SWAP = {w: group[(i + 1) % len(group)] for group in IDENTITY for i, w in enumerate(group)}
_WORD = re.compile(r"[^\W_]+")


def words(text: str) -> set[str]:
    return set(_WORD.findall(text.lower()))


def features(found: set[str]) -> set[str]:
    """Words, and beginnings marked with a star."""
    out = set(found)
    for n in PREFIXES:
        out.update(w[:n] + "*" for w in found if len(w) > n)
    return out


def fold(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % FOLDS


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tally = {0: Counter(), 1: Counter()}

    def out() -> pa.RecordBatch:
        rows = [(w, tally[0][w], tally[1][w]) for w in tally[0].keys() | tally[1].keys()]
        for t in tally.values():
            t.clear()
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64())], names=["feature", "n0", "n1"])

    for batch in batches:
        for label, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            tally[label].update(features(words(text.as_py())))
            tally[label][""] += 1
            if len(tally[0]) + len(tally[1]) > FLUSH:
                yield out()
    yield out()


def choose(training: DataFrame, effect: float = EFFECT, significance: float = SIGNIFICANCE) -> list[str]:
    """The features that correlate with the label, over all rows of training (toxic, text), and the terms for groups."""
    counted = training.select("toxic", "text").mapInArrow(_counts, "feature string, n0 long, n1 long").groupBy("feature").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    total = counted.filter("feature = ''").select(F.col("n0").alias("all0"), F.col("n1").alias("all1"))
    scored = counted.filter("feature <> '' AND n0 + n1 >= 3").crossJoin(F.broadcast(total)).filter("all0 > 0 AND all1 > 0")  # one row
    n, p, q = (F.col("all0") + F.col("all1")).cast("double"), (F.col("n0") + F.col("n1")).cast("double"), F.col("all1").cast("double")
    apart, width = F.abs(F.col("n1") * n - p * q), F.sqrt(p * (n - p) * q * (n - q))
    # The half row taken off keeps features of a few rows, all of one label by chance, from counting as sure.
    strong = (F.try_divide(apart, width) >= effect) & (F.try_divide(apart - n / 2, width) * F.sqrt(n) >= significance)
    return sorted({r[0] for r in scored.filter(strong).select("feature").collect()} | SWAP.keys())


def _vectors(names: dict[str, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = lambda found: sorted(names[f] for f in features(found) if f in names)
        for batch in batches:
            own, swapped = [], []
            for text in batch.column(1):
                found = words(text.as_py())
                own.append(at(found))
                swapped.append(at({SWAP.get(w, w) for w in found}) if found & SWAP.keys() else None)
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, kind), pa.array(swapped, kind)], names=["toxic", "own", "swapped"])

    return run


class Objective:
    """What a fit makes small: the logistic loss, RIDGE and COUNTERFACTUAL penalties; the last weight is the bias."""

    def __init__(self, y: np.ndarray, own: list[np.ndarray], swapped: list[np.ndarray | None], features: int):
        self.y, self.k = y, features
        self.rows, self.at = np.repeat(np.arange(len(own)), [len(x) for x in own]), np.concatenate(own)
        self.pairs = np.array([i for i, x in enumerate(swapped) if x is not None], np.int64)
        other = [swapped[i] for i in self.pairs]
        self.other_rows, self.other_at = np.repeat(np.arange(len(other)), [len(x) for x in other]), np.concatenate([*other, np.empty(0, np.int64)])
        self.fixed = float(np.log(y.mean() / (1 - y.mean())))

    def __call__(self, w: np.ndarray) -> tuple[float, np.ndarray]:
        """The value and the gradient."""
        sums = np.bincount(self.rows, w[self.at], len(self.y)) + w[-1]
        p = 1 / (1 + np.exp(-np.clip(sums, -60, 60)))
        value = float(np.logaddexp(0, sums).sum() - (self.y * sums).sum() + RIDGE / 2 * (w[:-1] @ w[:-1]) + 1e-3 / 2 * (w[-1] - self.fixed) ** 2)
        slope = p - self.y
        grad = np.append(RIDGE * w[:-1], slope.sum() + 1e-3 * (w[-1] - self.fixed))
        if len(self.pairs):
            other = 1 / (1 + np.exp(-np.clip(np.bincount(self.other_rows, w[self.other_at], len(self.pairs)) + w[-1], -60, 60)))
            gap = p[self.pairs] - other
            value += COUNTERFACTUAL / 2 * float(gap @ gap)
            mine, theirs = COUNTERFACTUAL * gap * p[self.pairs] * (1 - p[self.pairs]), COUNTERFACTUAL * gap * other * (1 - other)
            np.add.at(slope, self.pairs, mine)
            grad[:-1] -= np.bincount(self.other_at, theirs[self.other_rows], self.k)
            grad[-1] += mine.sum() - theirs.sum()
        grad[:-1] += np.bincount(self.at, slope[self.rows], self.k)
        return value, grad


def minimise(objective: Objective, w: np.ndarray) -> np.ndarray:
    """A limited-memory quasi-Newton descent with halved steps."""
    value, grad = objective(w)
    moves: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(STEPS):
        if np.abs(grad).max() < 1e-3:
            break
        way, used = grad.copy(), []
        for s, g in reversed(moves):
            a = (s @ way) / (s @ g)
            way -= a * g
            used.append(a)
        if moves:
            s, g = moves[-1]
            way *= (s @ g) / (g @ g)
        for (s, g), a in zip(moves, reversed(used), strict=True):
            way += s * (a - (g @ way) / (s @ g))
        step = 1.0 if moves else 1.0 / max(1.0, float(np.abs(way).max()))
        while True:
            to = w - step * way
            after, slope = objective(to)
            if after <= value - 1e-4 * step * (way @ grad) or step < 1e-10:
                break
            step /= 2
        if (to - w) @ (slope - grad) > 1e-12:
            moves = [*moves, (to - w, slope - grad)][-MEMORY:]
        else:
            moves = []
        if step < 1e-10:
            break
        w, value, grad = to, after, slope
    return w


def fit(training: DataFrame, sample: int = SAMPLE) -> tuple[dict[str, float], float]:
    """Weights of features and the bias, from rows with doc_id, toxic (0 or 1) and text. Without both labels there, all are 0.

    The sample is drawn by a hash of id and text, whatever files the rows are in.
    """
    names = {f: i for i, f in enumerate(choose(training))}
    n = training.count()
    part = training.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(max(n, 1))) < sample).select("toxic", "text")
    rows = part.mapInArrow(_vectors(names), "toxic int, own array<int>, swapped array<int>").toArrow()
    y = rows.column("toxic").to_numpy().astype(np.float64)
    if len(set(y.tolist())) < 2:
        return {}, 0.0
    lists = [[None if x is None else np.array(x, np.int64) for x in rows.column(c).to_pylist()] for c in ("own", "swapped")]
    objective = Objective(y, *lists, len(names))
    w = minimise(objective, np.append(np.zeros(len(names)), objective.fixed))
    return {f: float(w[i]) for f, i in names.items() if abs(w[i]) > 1e-6}, float(w[-1])


def score(docs: DataFrame, weights: dict[str, float], bias: float) -> DataFrame:
    """doc_id and score of each row: the logistic function of the bias and the weights of the features that its text has."""
    plain = {f: w for f, w in weights.items() if not f.endswith("*")}
    starts = {n: {f[:-1]: w for f, w in weights.items() if f.endswith("*") and len(f) == n + 1} for n in PREFIXES}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = []
            for text in batch.column(1):
                found = words(text.as_py())
                total = bias + sum(plain[w] for w in found & plain.keys())
                for n, known in starts.items():
                    if known:
                        total += sum(known[p] for p in known.keys() & {w[:n] for w in found if len(w) > n})
                sums.append(total)
            scores = 1 / (1 + np.exp(-np.clip(np.array(sums, np.float64), -60, 60)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), whole("text").alias("text")).mapInArrow(run, "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted (1 from a score of 0.3 on).

    Learnt from the labels of documents whose fold (crc32 of doc_id as text, modulo 4) isn't 2; null labels and labels of
    no document count for nothing, and of several labels of a document the largest. Null is the empty text; it has the
    score of the bias. Without labels of both kinds each score is 0.5. A null doc_id is in fold 0 and never learnt from.
    Repeated rows are repeated; an empty table gives no rows; further columns are ignored.
    """
    known = labels.filter("toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).filter(fold(F.col("doc_id")) != HELD)
    # Of equal texts with a label one is learnt from, so that many copies don't make their words look telling.
    shas = docs.filter(fold(F.col("doc_id")) != HELD).select("doc_id", F.sha2(whole("text"), 256).alias("sha")).join(known, "doc_id")
    chosen = shas.groupBy("sha").agg(F.min_by("toxic", "doc_id").alias("toxic"), F.min("doc_id").alias("doc_id")).select("doc_id", "toxic").distinct()
    # Ids go before texts: only labelled texts are moved, and kept for the passes over them.
    texts = docs.filter(fold(F.col("doc_id")) != HELD).select("doc_id", whole("text").alias("text"))
    chosen = durable(chosen, "chosen")
    training = durable(texts.join(F.broadcast(chosen) if chosen.count() <= FEW else chosen, "doc_id"), "labelled")
    forget(chosen)
    weights, bias = fit(training)
    forget(training)
    scored = score(docs, weights, bias)
    return scored.select("doc_id", (fold(F.col("doc_id")) == HELD).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
