"""Operator 2: quality classifier on random-indexing word vectors.

Every token, the hashed word or the shape of the word (runs of upper case, lower
case, digits, other signs), has a sparse random index vector. A token's vector is
its index vector plus the index vectors of the tokens around it, summed over all
documents to learn from, labelled or not: random indexing. A document is the mean of its word vectors and of its
shape vectors, with the log of its number of words and its share of different
words. A two-layer numpy network scores it; a temperature, fitted on documents
that training did not see, calibrates the probability.

The network is fitted on at most ``sample_rows`` labelled documents, chosen by a hash
of the id; word vectors are a table of fixed size, so what is broadcast is bounded.
Scoring is one narrow pass over whole texts.

Cases: NULL text is empty; empty text is scored like any other, from a zero mean.
NULL ids are in the fold of empty text. A label is NULL or no label: not learned
from. Rows that repeat an id are scored each. Without a labelled row of both kinds
the score is 0.5. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearsay.llm.common import slices
from hearsay.llm.words import IS_SPACE, finish, hash_words, text_values

VOCABULARY_BITS = 14
DIMENSIONS = 48
WINDOW = 2
# Small rows, so that an Arrow batch of them stays small.
SUM_BLOCKS = 1024
# Classes of bytes in a shape: lower case and UTF-8 letters, upper case, digits, and each other sign as itself.
SHAPE = np.arange(256, dtype=np.uint64)
SHAPE[ord("a"):ord("z") + 1] = SHAPE[128:] = ord("a")
SHAPE[ord("A"):ord("Z") + 1] = ord("A")
SHAPE[ord("0"):ord("9") + 1] = ord("0")


def index_vectors(seed: int = 2, nonzero: int = 6) -> np.ndarray:
    """A sparse vector of +1 and -1 for each token number."""
    rng = np.random.default_rng(seed)
    rows = 1 << VOCABULARY_BITS
    out = np.zeros((rows, DIMENSIONS), np.float32)
    where = rng.permuted(np.tile(np.arange(DIMENSIONS), (rows, 1)), axis=1)[:, :nonzero]
    out[np.arange(rows)[:, None], where] = rng.choice([-1.0, 1.0], (rows, nonzero))
    return out


def shape_hashes(texts: list[bytes]) -> np.ndarray:
    """A hash of the shape of every word of all texts: its classes with repeats left out."""
    raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    space = IS_SPACE[raw]
    kind = SHAPE[raw]
    keep = ~space
    keep[1:] &= (kind[1:] != kind[:-1]) | space[:-1]
    edges = ~space
    edges[1:] &= space[:-1]
    word_of = np.cumsum(edges)[keep] - 1
    n = int(edges.sum())
    starts = np.nonzero(np.diff(np.concatenate(([-1], word_of))))[0]
    place = np.arange(len(word_of)) - starts[word_of] if n else word_of
    mixed = finish((kind[keep] + np.uint64(1)) * finish(place.astype(np.uint64) + np.uint64(7)))
    return finish(np.add.reduceat(mixed, starts)) if n else np.zeros(0, np.uint64)


def token_numbers(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token numbers of words and of shapes, and the number of words of each text."""
    words = hash_words(texts)
    shift = np.uint64(64 - VOCABULARY_BITS)
    return (words.hashes >> shift).astype(np.int64), (finish(shape_hashes(texts) + np.uint64(5)) >> shift).astype(np.int64), words.counts


def contexts(tokens: np.ndarray, counts: np.ndarray, index: np.ndarray, into: np.ndarray, block: int = 1 << 16) -> None:
    """Add to each token the index vectors of its neighbours within the text."""
    # A token without a vector, WINDOW times, keeps texts apart.
    none = len(index)
    apart = np.full(len(tokens) + WINDOW * (len(counts) + 1), none, np.uint16)
    apart[np.arange(len(tokens)) + WINDOW * (1 + np.repeat(np.arange(len(counts)), counts))] = tokens
    vectors = np.vstack((index, np.zeros((1, index.shape[1]), index.dtype)))
    for lo in range(WINDOW, len(apart) - WINDOW, block):
        hi = min(lo + block, len(apart) - WINDOW)
        near = vectors[apart[lo - WINDOW:hi + WINDOW]]
        n = hi - lo
        around = np.zeros((n, index.shape[1]), index.dtype)
        for step in range(1, WINDOW + 1):
            around += near[WINDOW - step:WINDOW - step + n]
            around += near[WINDOW + step:WINDOW + step + n]
        order = np.argsort(apart[lo:hi], kind="stable")
        owner = apart[lo:hi][order]
        first = np.nonzero(np.diff(owner.astype(np.int64), prepend=-1))[0]
        sums = np.add.reduceat(around[order], first, axis=0)
        kept = owner[first] < none
        into[owner[first][kept]] += sums[kept]


def pooled(texts: list[bytes], vectors: np.ndarray) -> np.ndarray:
    """Features of each text."""
    words, shapes, counts = token_numbers(texts)
    out = np.zeros((len(texts), 2 * DIMENSIONS + 2), np.float32)
    filled = np.nonzero(counts)[0]
    if not len(filled):
        return out
    begins = (np.cumsum(counts) - counts)[filled]
    ends = begins + counts[filled]
    for k, tokens in enumerate((words, shapes)):
        for row, lo, hi in zip(filled.tolist(), begins.tolist(), ends.tolist(), strict=True):
            out[row, k * DIMENSIONS:(k + 1) * DIMENSIONS] = vectors[tokens[lo:hi]].mean(axis=0)
    out[:, -2] = np.log1p(counts)
    for row, lo, hi in zip(filled.tolist(), begins.tolist(), ends.tolist(), strict=True):
        seen = np.zeros(1 << VOCABULARY_BITS, bool)
        seen[words[lo:hi]] = True
        out[row, -1] = seen.sum() / min(hi - lo, 1 << VOCABULARY_BITS)
    return out


@dataclass
class Model:
    vectors: np.ndarray  # of tokens
    mean: np.ndarray
    spread: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float

    def logits(self, features: np.ndarray) -> np.ndarray:
        x = (features - self.mean) / self.spread
        return np.tanh(x @ self.w1 + self.b1) @ self.w2 + self.b2

    def scores(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(features) / self.temperature, -30, 30)))


def train(vectors: np.ndarray, x: np.ndarray, y: np.ndarray, hidden: int = 32, epochs: int = 60, seed: int = 4) -> Model:
    """Fit the network on four fifths of the rows by Adam, and the temperature on the rest."""
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(x))
    x, y = x[order].astype(np.float64), y[order].astype(np.float64)
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-3
    parts = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)]
    if len(np.unique(y)) < 2:
        return Model(vectors, mean, spread, parts[0] * 0, parts[1], parts[2] * 0, 0.0, 1.0)
    z = (x - mean) / spread
    cut = max(1, len(z) // 5)
    first, second = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts]
    step = 0
    for _ in range(epochs):
        for rows in np.array_split(rng.permutation(np.arange(cut, len(z))), max(1, (len(z) - cut) // 128)):
            h = np.tanh(z[rows] @ parts[0] + parts[1])
            p = 1 / (1 + np.exp(-(h @ parts[2] + parts[3][0])))
            error = (p - y[rows]) / max(1, len(rows))
            back = np.outer(error, parts[2]) * (1 - h * h)
            slopes = [z[rows].T @ back + 1e-4 * parts[0], back.sum(axis=0), h.T @ error + 1e-4 * parts[2], np.array([error.sum()])]
            step += 1
            for k, g in enumerate(slopes):
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                parts[k] = parts[k] - 0.003 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    model = Model(vectors, mean, spread, parts[0], parts[1], parts[2], float(parts[3][0]), 1.0)
    held = model.logits(x[:cut])
    choices = np.geomspace(0.25, 8, 60)

    def loss(t: float) -> float:
        p = 1 / (1 + np.exp(-np.clip(held / t, -30, 30)))
        return float(-(y[:cut] * np.log(p + 1e-12) + (1 - y[:cut]) * np.log(1 - p + 1e-12)).sum())

    model.temperature = float(min(choices, key=loss))
    return model


def fit(
    docs: DataFrame, labels: DataFrame, learn_from: Column, sample_rows: int = 4_000,
    id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
) -> Model:
    """Fit on at most ``sample_rows`` labelled rows for which ``learn_from``, a condition on the id, holds.

    The word vectors are summed over all rows of ``docs`` for which it holds. Ids of the
    labelled rows are chosen before any text is read. Tasks send the sums of context
    vectors, added up by blocks of tokens, then the pooled features: sizes that do not
    depend on the texts.
    """
    spark = docs.sparkSession
    known = labels.select(F.col(id_col), F.col(label_col).cast("int").alias("y")).filter(F.col("y").isin(0, 1) & F.col(id_col).isNotNull() & learn_from)
    known = known.groupBy(id_col).agg(F.max("y").alias("y"))
    chosen = known.orderBy(F.xxhash64(F.col(id_col), F.lit(2)), id_col).limit(sample_rows)
    rows = docs.select(F.col(id_col), F.col(text_col).alias("text")).join(F.broadcast(chosen), id_col).select(id_col, "y", "text")
    index = spark.sparkContext.broadcast(index_vectors())
    # Whole numbers, so the sums do not depend on their order.
    size = (1 << VOCABULARY_BITS) // SUM_BLOCKS

    def sum_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        into = np.zeros((1 << VOCABULARY_BITS, DIMENSIONS))
        for piece in slices(batches, 0):
            words, shapes, counts = token_numbers(text_values(piece.column(0)))
            contexts(words, counts, index.value, into)
            contexts(shapes, counts, index.value, into)
        blocks = [k for k in range(SUM_BLOCKS) if into[k * size:(k + 1) * size].any()]
        sums = [into[k * size:(k + 1) * size].tobytes() for k in blocks]
        yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int32()), pa.array(sums, pa.binary())], ["block", "sums"])

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, sums in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                part = np.frombuffer(sums.as_buffer(), np.float64)
                total[block] = total[block] + part if block in total else part.copy()
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(total), pa.int32()), pa.array([t.tobytes() for t in total.values()], pa.binary())], ["block", "sums"]
        )

    kinds = "block int, sums binary"
    partial = docs.filter(learn_from).select(F.col(text_col).alias("text")).mapInArrow(sum_contexts, kinds)
    vectors = index.value.astype(np.float64)
    for row in partial.repartition(16, "block").mapInArrow(add_up, kinds).collect():
        vectors[row["block"] * size:(row["block"] + 1) * size] += np.frombuffer(row["sums"], np.float64).reshape(size, DIMENSIONS)
    vectors = (vectors / (np.sqrt((vectors * vectors).sum(axis=1, keepdims=True)) + 1e-6)).astype(np.float32)
    shared = spark.sparkContext.broadcast(vectors)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, 2):
            found = pooled(text_values(piece.column(2)), shared.value)
            yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), pa.array([f.tobytes() for f in found], pa.binary())], ["id", "y", "f"])

    kind = docs.schema[id_col].dataType.simpleString()
    sample = rows.mapInArrow(features, f"id {kind}, y int, f binary").collect()
    sample.sort(key=lambda r: (str(r["id"]), r["f"]))
    if not sample:
        return train(vectors, np.zeros((1, 2 * DIMENSIONS + 2)), np.zeros(1))
    return train(vectors, np.array([np.frombuffer(r["f"], np.float32) for r in sample]), np.array([r["y"] for r in sample]))


def score(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.3, to: str = "score", predicted: str = "predicted") -> DataFrame:
    """``docs`` with two more columns: the score of the whole text, and 1 where it reaches ``threshold``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + f", `{to}` double, `{predicted}` int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, at):
            p = shared.value.scores(pooled(text_values(piece.column(at)), shared.value.vectors))
            yield pa.RecordBatch.from_arrays(
                [*piece.columns, pa.array(p, pa.float64()), pa.array((p >= threshold).astype(np.int32))], [*piece.schema.names, to, predicted]
            )

    return docs.mapInArrow(run, schema)
