"""Operator 4: language identification by string kernels.

A text is the presence of its character n-grams of lengths 1 to ``longest`` (the
blended spectrum), each by its exact number; how often one occurs does not count. The
kernel of two texts is the cosine of their presence vectors, which are kept sparse, so
long texts of large scripts stay apart. Landmarks (Nystroem), drawn for each language,
turn kernels into features: K(x, landmarks) K(landmarks, landmarks)**-1/2.
One-versus-rest kernel ridge regression on these gives a value for each language. A
batch is scored by sparse products of its n-grams with those of the landmarks.

The model is fitted on at most ``per_language`` rows of each language, chosen by a
hash of the id; languages are as many as the labels have. Scoring is one narrow pass
over whole texts. Letters are lower-cased.

Cases: NULL text, or text without a letter, is ``und`` with score 0. NULL languages
are not learned. Rows that repeat an id are predicted each. With nothing to learn
all is ``und``. Empty tables give empty results; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearsay.llm.common import slices, staged
from hearsay.llm.pieces import LETTER, classes

LONGEST = 3
POINT_BITS = 21


def grams(text: str, longest: int = LONGEST) -> np.ndarray:
    """The different n-grams of a text as ascending numbers: exact up to length 3, 64-bit hashes beyond."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)
    step = np.uint64(1 << POINT_BITS if longest <= 3 else 0x9E3779B97F4A7C15)
    found, last = [], np.zeros(len(points), np.uint64)
    for n in range(1, longest + 1):
        if len(points) < n:
            break
        last = last[: len(points) - n + 1] * step + points[n - 1:]
        found.append(np.unique(last))
    return np.unique(np.concatenate(found)) if len(found) else np.zeros(0, np.uint64)


def has_letter(texts: list[str]) -> np.ndarray:
    return np.array([bool((classes()[np.frombuffer(t.encode("utf-32-le", "surrogatepass"), "<u4")] == LETTER).any()) for t in texts], bool)


@dataclass
class Landmarks:
    """The n-grams of the landmarks, ascending, and for each of them the landmarks that have it."""

    grams: np.ndarray
    ends: np.ndarray  # in ``marks``, where the landmarks of the n-grams before end
    marks: np.ndarray
    sizes: np.ndarray  # different n-grams of each landmark

    @classmethod
    def of(cls, sets: list[np.ndarray]) -> Landmarks:
        sizes = np.array([len(s) for s in sets], np.int64)
        every = np.concatenate([*sets, np.zeros(0, np.uint64)])
        order = np.argsort(every, kind="stable")
        different, counts = np.unique(every[order], return_counts=True)
        marks = np.repeat(np.arange(len(sets), dtype=np.int32), sizes)[order]
        return cls(different, np.concatenate(([0], np.cumsum(counts))), marks, sizes)

    def products(self, sets: list[np.ndarray], weights: np.ndarray) -> np.ndarray:
        """Kernels of texts, given as n-grams, with the landmarks, times ``weights``."""
        out = np.zeros((len(sets), weights.shape[1]))
        if not len(self.grams) or not sets:
            return out
        every = np.concatenate(sets)
        row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        at = np.minimum(np.searchsorted(self.grams, every), len(self.grams) - 1)
        known = self.grams[at] == every
        at, row = at[known], row[known]
        if not len(at):
            return out
        # The weighted sum over the landmarks of an n-gram, once for all texts that have it.
        distinct, which = np.unique(at, return_inverse=True)
        counts = self.ends[distinct + 1] - self.ends[distinct]
        begins = np.cumsum(counts) - counts
        taken = self.marks[np.repeat(self.ends[distinct] - begins, counts) + np.arange(counts.sum())]
        scaled = weights / np.sqrt(np.maximum(self.sizes, 1))[:, None]
        starts = np.nonzero(np.diff(row, prepend=-1))[0]
        for k in range(weights.shape[1]):
            sums = np.add.reduceat(scaled[taken, k], begins)
            out[row[starts], k] = np.add.reduceat(sums[which], starts)
        return out / np.sqrt(np.maximum([len(s) for s in sets], 1))[:, None]

    def kernels(self, sets: list[np.ndarray]) -> np.ndarray:
        """Kernels of texts with each landmark, a text at a time."""
        out = np.zeros((len(sets), len(self.sizes)))
        for k, some in enumerate(sets):
            at = np.searchsorted(self.grams, some)
            inside = at < len(self.grams)
            at = at[inside][self.grams[at[inside]] == some[inside]]
            counts = self.ends[at + 1] - self.ends[at]
            taken = self.marks[np.repeat(self.ends[at] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())]
            out[k] = np.bincount(taken, minlength=len(self.sizes)) / np.sqrt(np.maximum(self.sizes, 1) * max(len(some), 1))
        return out


@dataclass
class Model:
    languages: list[str]
    landmarks: Landmarks
    weights: np.ndarray  # of landmarks and a constant, for each language

    def values(self, sets: list[np.ndarray]) -> np.ndarray:
        return self.landmarks.products(sets, self.weights[:-1]) + self.weights[-1]


def train(marks: Landmarks, between: np.ndarray, kernels: np.ndarray, languages: list[str], ridge: float = 1e-3) -> Model:
    """Fit on the kernels of texts with the landmarks; ``between`` are those of the landmarks with each other."""
    names = sorted(set(languages))
    values, vectors = np.linalg.eigh(between)
    keep = values > 1e-6 * values.max(initial=1e-12)
    root = vectors[:, keep] / np.sqrt(values[keep])
    phi = np.column_stack((kernels @ root, np.ones(len(kernels))))
    target = (np.array(languages)[:, None] == np.array(names)[None, :]) * 2.0 - 1
    inner = phi.T @ phi + ridge * len(kernels) * np.diag([1.0] * (phi.shape[1] - 1) + [1e-6])
    solved = np.linalg.solve(inner, phi.T @ target)
    return Model(names, marks, np.vstack((root @ solved[:-1], solved[-1:])))


def fit(
    docs: DataFrame, learn_from: Column, per_language: int = 1200, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    landmarks: int = 160,
) -> Model | None:
    """Fit on rows with a language for which ``learn_from``, a condition on the id, holds; None if there are none.

    Ids are chosen before any text is read; each task ranks its own rows first. The
    landmarks are dealt evenly to the languages, two at least to each. Tasks send the
    n-grams of the landmarks, and for every other text its kernels with them alone.
    """
    known = docs.select(id_col, F.col(lang_col).alias("lang")).filter(F.col("lang").isNotNull() & F.col(id_col).isNotNull() & learn_from)
    by_hash = Window.partitionBy("lang").orderBy(F.xxhash64(F.col(id_col), F.lit(4)), id_col)
    chosen = known.withColumn("nth", F.row_number().over(by_hash)).filter(F.col("nth") <= per_language)
    chosen = chosen.groupBy(id_col, "lang").agg(F.min("nth").alias("nth"))
    texts = docs.select(F.col(id_col), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    # At most per_language ids for each language.
    rows = staged(texts.join(F.broadcast(chosen), [id_col, "lang"]).select(F.col(id_col).alias("id"), "lang", "nth", "text"), "language-sample")
    n_languages = rows.select("lang").distinct().count()
    if not n_languages:
        return None
    each = max(2, -(-landmarks // n_languages))

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, 2):
            found = [grams(t or "").tobytes() for t in piece.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), pa.array(found, pa.binary())], ["lang", "nth", "f"])

    # One text for each id, also where rows repeat it.
    drawn = rows.filter(F.col("nth") <= each).groupBy("lang", "nth").agg(F.min("text").alias("text"))
    found = [(r["lang"], r["nth"], r["f"]) for r in drawn.mapInArrow(sparse, "lang string, nth int, f binary").toLocalIterator()]
    sets = [np.frombuffer(f, np.uint64) for _, _, f in sorted(found)]
    marks = Landmarks.of(sets)
    shared = docs.sparkSession.sparkContext.broadcast(marks)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, 2):
            found = shared.value.kernels([grams(t or "") for t in piece.column(2).to_pylist()]).astype(np.float32)
            yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), pa.array([f.tobytes() for f in found], pa.binary())], ["id", "lang", "f"])

    kind = docs.schema[id_col].dataType.simpleString()
    sample = rows.select("id", "lang", "text").mapInArrow(features, f"id {kind}, lang string, f binary").collect()
    sample.sort(key=lambda r: (str(r["id"]), r["f"]))
    kernels = np.frombuffer(b"".join(r["f"] for r in sample), np.float32).reshape(len(sample), -1)
    return train(marks, marks.kernels(sets), kernels.astype(np.float64), [r["lang"] for r in sample])


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, ``lang_pred``, ``score``); the score is the softmax of the values, sharpened."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(id_col, text_col)
    kind = rows.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for piece in slices(batches, 1, 1 << 20):
            texts = [t or "" for t in piece.column(1).to_pylist()]
            sure = has_letter(texts)
            names, scores = np.full(len(texts), "und", dtype=object), np.zeros(len(texts))
            if model is not None and sure.any():
                values = model.values([grams(t) for t in texts])
                odds = np.exp(4 * (values - values.max(axis=1, keepdims=True)))
                names[sure] = np.array(model.languages, dtype=object)[values.argmax(axis=1)][sure]
                scores[sure] = (1 / odds.sum(axis=1))[sure]
            yield pa.RecordBatch.from_arrays(
                [piece.column(0), pa.array(names.tolist(), pa.string()), pa.array(scores, pa.float64())], [id_col, "lang_pred", "score"]
            )

    return rows.mapInArrow(run, f"`{id_col}` {kind}, lang_pred string, score double")
