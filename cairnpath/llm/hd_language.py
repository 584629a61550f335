"""Language identification with hyperdimensional profiles.

Each letter has a random vector of ones and minus ones. A trigram is the product of its letters' vectors, the first
permuted twice and the second once; a text is the sum of its trigrams' vectors, and a language the sum over its training
texts. A text gets the language whose sum has the largest cosine with its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairnpath.llm.common import whole

DIMENSIONS, SEED, FOLDS = 1024, 20_011, 5
#: Trigram vectors that a worker keeps, and that it works with at a time; texts that are compared with the languages at a time.
KEEP, TOGETHER, AT_ONCE = 1 << 15, 1 << 13, 64
#: Languages that profiles are learnt of; more distinct values of lang than there are languages are none.
MOST_LANGUAGES = 8192
#: The likeness that a document of the corpus needs: three times what unrelated vectors of 1024 dimensions come to by chance.
LEAST = 3 / DIMENSIONS**0.5
UNKNOWN = "und"
_LETTERS: np.ndarray | None = None


def _letters() -> np.ndarray:
    global _LETTERS
    if _LETTERS is None:
        _LETTERS = np.array([chr(c).isalpha() for c in range(0x110000)])
    return _LETTERS


def trigrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The distinct trigrams of a text's letters, as numbers, and their counts; none if it has no letter."""
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    code = np.where(_letters()[code], code, 32)
    code = np.concatenate([[32], code, [32]])
    gap = code == 32
    code = code[~(gap & np.concatenate([[False], gap[:-1]]))]
    if len(code) < 3:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.unique(code[:-2] << 42 | code[1:-1] << 21 | code[2:], return_counts=True)


class Space:
    """The vectors of trigrams."""

    def __init__(self, dimensions: int = DIMENSIONS, seed: int = SEED):
        self.dimensions, self.seed = dimensions, seed
        self._letter: dict[int, np.ndarray] = {}
        self._row: dict[int, int] = {}
        self._rows = np.empty((KEEP, dimensions), np.int8)

    def letter(self, code: int) -> np.ndarray:
        v = self._letter.get(code)
        if v is None:
            if len(self._letter) >= KEEP:
                self._letter.clear()
            v = self._letter[code] = np.random.default_rng([self.seed, code]).integers(0, 2, self.dimensions, np.int8) * 2 - 1
        return v

    def _new(self, grams: np.ndarray) -> np.ndarray:
        """The vectors of some trigrams: products of their letters', the first permuted twice and the second once."""
        out = np.ones((len(grams), self.dimensions), np.int8)
        for shift, turns in ((42, 2), (21, 1), (0, 0)):
            codes, at = np.unique(grams >> shift & 0x1FFFFF, return_inverse=True)
            out *= np.array([np.roll(self.letter(c), turns) for c in codes.tolist()])[at]
        return out

    def vectors(self, grams: np.ndarray) -> np.ndarray:
        """A row for each of TOGETHER trigrams at most."""
        fresh = [g for g in grams.tolist() if g not in self._row]
        if len(self._row) + len(fresh) > KEEP:
            self._row.clear()
            fresh = grams.tolist()
        if fresh:
            start = len(self._row)
            self._rows[start : start + len(fresh)] = self._new(np.array(fresh))
            self._row.update(zip(fresh, range(start, start + len(fresh)), strict=True))
        return self._rows[[self._row[g] for g in grams.tolist()]].astype(np.float32)

    def bundle(self, counted: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """The sums of several texts, a row for each; their trigrams are worked through TOGETHER at a time."""
        out = np.zeros((len(counted), self.dimensions), np.float32)
        grams = np.unique(np.concatenate([g for g, _ in counted])) if counted else np.empty(0, np.int64)
        for at in range(0, len(grams), TOGETHER):
            some = grams[at : at + TOGETHER]
            weight = np.zeros((len(counted), len(some)), np.float32)
            for i, (g, n) in enumerate(counted):
                low, high = np.searchsorted(g, some[0]), np.searchsorted(g, some[-1], "right")
                weight[i, np.searchsorted(some, g[low:high])] = n[low:high]
            out += weight @ self.vectors(some)
        return out


_SPACES: dict[tuple[int, int], Space] = {}


def _space(dimensions: int, seed: int) -> Space:
    return _SPACES.setdefault((dimensions, seed), Space(dimensions, seed))


def fold(doc_id: Column, folds: int) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % folds


def prototypes(docs: DataFrame, dimensions: int = DIMENSIONS, seed: int = SEED) -> dict[str, np.ndarray]:
    """The vector of each language, from all rows of docs with a text and a lang.

    Tasks add up their own rows, Spark adds up the tasks; what reaches the driver is one vector a language, of
    MOST_LANGUAGES at most: a lang column with more distinct values is refused.
    """

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space, total = _space(dimensions, seed), {}
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1)
            for at in range(0, len(langs), AT_ONCE):
                rows = space.bundle([trigrams(t.as_py()) for t in texts[at : at + AT_ONCE]])
                for lang, row in zip(langs[at : at + AT_ONCE], rows, strict=True):
                    total[lang] = total.get(lang, 0) + row.astype(np.float64)
            if len(total) > MOST_LANGUAGES:
                raise ValueError(f"more than {MOST_LANGUAGES} distinct values of lang")
        for lang, row in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * dimensions), pa.array(range(dimensions), pa.int32()), pa.array(row)], names=["lang", "dim", "value"])

    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("lang").cast("string"), "text")
    summed = known.mapInArrow(sums, "lang string, dim int, value double").groupBy("lang", "dim").agg(F.sum("value").alias("value"))
    vectors = summed.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("dim", "value"))).alias("v")).select("lang", F.col("v.value"))  # of one language
    found = vectors.limit(MOST_LANGUAGES + 1).collect()
    if len(found) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} distinct values of lang")
    out = {lang: np.array(v) for lang, v in found}
    return {lang: v for lang, v in sorted(out.items()) if np.any(v)}


def identify(docs: DataFrame, profiles: dict[str, np.ndarray], seed: int = SEED) -> DataFrame:
    """row (all columns of docs as a struct), lang_pred and score for each row of docs, without a shuffle.

    score is the cosine with the chosen language, 0 if it is negative. A null text, one without letters, and every text
    if there is no profile, has lang_pred "und" and score 0. Of languages with the same cosine the first by name counts.
    """
    names = sorted(profiles)
    matrix = np.array([profiles[n] / np.linalg.norm(profiles[n]) for n in names], np.float32).T if names else None
    dimensions = len(matrix) if names else DIMENSIONS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space = _space(dimensions, seed)
        for batch in batches:
            texts, langs, scores = batch.column(1), [], []
            for at in range(0, len(texts), AT_ONCE):
                counted = [trigrams(t.as_py()) for t in texts[at : at + AT_ONCE]]
                if not names:
                    langs += [UNKNOWN] * len(counted)
                    scores += [0.0] * len(counted)
                    continue
                rows = space.bundle(counted)
                norm = np.linalg.norm(rows, axis=1)
                cosine = (rows @ matrix) / np.maximum(norm, 1e-9)[:, None]
                best = cosine.argmax(axis=1)
                langs += [names[b] if n else UNKNOWN for b, n in zip(best, norm, strict=True)]
                scores += [float(min(1.0, max(0.0, c[b]))) if n else 0.0 for b, n, c in zip(best, norm, cosine, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["row", "lang_pred", "score"])

    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), whole("text").alias("text"))
    schema = T.StructType([packed.schema["row"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return packed.mapInArrow(run, schema)


def languages(docs: DataFrame, folds: int = FOLDS) -> DataFrame:
    """One row per row of docs: doc_id, held_out, lang_pred, score.

    Profiles are learnt from all rows with a lang whose fold (crc32 of doc_id as text, modulo folds) isn't 0; a null
    doc_id is in fold 0. Repeated rows are repeated; an empty table gives no rows; further columns are ignored.
    """
    used = docs.select("doc_id", "text", "lang")
    held = fold(F.col("doc_id"), folds) == 0
    profiles = prototypes(used.filter(~held))
    return identify(used.select("doc_id", "text"), profiles).select("row.doc_id", (fold(F.col("row.doc_id"), folds) == 0).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, folds: int = FOLDS, wanted: set[str] | None = None, least: float = LEAST) -> DataFrame:
    """The rows of docs in a wanted language (all that are learnt, if none are named), all columns as they are.

    A row goes if its text is no more like any learnt language than chance makes it (a score under least), is null or
    without letters, or if the language that it is most like isn't wanted. Ties go to the first language by name. Repeated
    rows are decided alike; an empty table gives no rows; columns may have any names.
    """
    profiles = prototypes(docs.filter(fold(F.col("doc_id"), folds) != 0))
    named = identify(docs, profiles).filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least))
    return (named if wanted is None else named.filter(F.col("lang_pred").isin(sorted(wanted)))).select("row.*")
