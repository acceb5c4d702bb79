"""Quality classifier: hashed word n-gram logistic regression, trained with follow-the-regularised-leader updates.

Features are word uni- and bigrams of two kinds, hashed into ``2 ** bits`` slots: the distinct n-grams of the words
themselves, all of one weight, and the n-grams of the words' shapes (letters and digits folded, runs collapsed, a word
that repeats the one before it marked as such) by the root of their frequency. Each kind has unit length. Training takes
at most ``max_rows`` labelled rows, those with the least hash of their id (then of their text), in that order, with all their features, as in
scoring. The features are written, and pass through the driver by about DRIVER_BYTES at once (one row at least), where
per-coordinate FTRL-proximal steps make the weights. Scoring is a sparse dot product over whole texts.

Defined results: a null or blank text has no features and the score of the bias alone; labels other than 0 and 1 are not
learned from; without labelled rows every score is 0.5; repeated rows score alike; null ids score like others; an empty
table gives an empty table; other columns are ignored, and one that bears the score's name is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skarn.llm.common import claim, materialise, mix64, pick, release, slices

BITS, MAX_ROWS, DRIVER_BYTES, EPOCHS = 20, 10_000, 32_000_000, 2
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.0005, 0.0005
REMEMBERED, TEXTS_AT_ONCE = 300_000, 1_000


_FOLD = bytes(
    ord("A") if chr(c).isupper() and c < 128 else ord("0") if 48 <= c < 58 else ord("a") if c >= 128 or chr(c).isalpha() else c for c in range(256)
)
_RUNS = re.compile(rb"(.)\1+", re.DOTALL)
_REPEAT = np.uint64(xxhash.xxh64_intdigest(b" repeat"))


class _WordHash(dict):
    """Word to the hashes of itself and of its shape, remembered up to a bound."""

    def __missing__(self, word: bytes) -> tuple[int, int]:
        if len(self) >= REMEMBERED:
            self.clear()
        value = self[word] = (xxhash.xxh64_intdigest(word), xxhash.xxh64_intdigest(_RUNS.sub(rb"\1", word.translate(_FOLD)), 1))
        return value


_words = _WordHash()


def features(text: str | None, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Slots and values of a text."""
    words = (text or "").encode().split()
    if not words:
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    both = np.array([_words[w] for w in words], np.uint64)
    one, shape = both[:, 0], both[:, 1].copy()
    shape[1:][one[1:] == one[:-1]] = _REPEAT
    with np.errstate(over="ignore"):
        two = mix64(one[:-1] * np.uint64(3) + one[1:])
        shapes = mix64(np.concatenate([shape, shape[:-1] * np.uint64(5) + shape[1:]]))
    own = np.unique(np.concatenate([one, two]) >> np.uint64(64 - bits))
    kinds, times = np.unique(shapes >> np.uint64(64 - bits), return_counts=True)
    values = np.concatenate([np.full(len(own), 1.0 / np.sqrt(len(own))), np.sqrt(times / times.sum())])
    return np.concatenate([own, kinds]).astype(np.int32), values.astype(np.float32)


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def score(self, slots: np.ndarray, values: np.ndarray) -> float:
        z = self.bias + float(self.weights[slots].astype(np.float64) @ values)
        return float(1.0 / (1.0 + np.exp(-np.clip(z, -35.0, 35.0))))


def fit(rows: Iterable[tuple[np.ndarray, np.ndarray, int]], bits: int = BITS, epochs: int = EPOCHS) -> Model:
    """FTRL-proximal: each coordinate keeps the sum z of its adjusted gradients and n of their squares. rows are gone through once an epoch."""
    size = (1 << bits) + 1  # the last is the bias
    z, n = np.zeros(size), np.zeros(size)

    def weights(at: np.ndarray | slice) -> np.ndarray:
        za = z[at]
        return np.where(np.abs(za) <= L1, 0.0, -(za - np.sign(za) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    for _ in range(epochs):
        for slots, values, label in rows:
            at, back = np.unique(np.append(slots, size - 1), return_inverse=True)  # a slot of both kinds is one coordinate
            x = np.bincount(back, np.append(values, np.float32(1.0)).astype(np.float64))
            w = weights(at)
            p = 1.0 / (1.0 + np.exp(-np.clip(w @ x, -35.0, 35.0)))
            g = (p - label) * x
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    w = weights(slice(None))
    return Model(w[:-1].astype(np.float32), float(w[-1]))


class _Rows:
    """Slots, values and label of each row of a sorted table, a partition at a time."""

    def __init__(self, table: DataFrame) -> None:
        self.table = table

    def __iter__(self) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        for r in self.table.toLocalIterator():
            yield np.frombuffer(bytes(r["slots"]), np.int32), np.frombuffer(bytes(r["vals"]), np.float32), r["label"]


def held_out(id_col: Column) -> Column:
    """Rows whose label no model may see: crc32 of the id as text leaves 1 divided by 3."""
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", bits: int = BITS, max_rows: int = MAX_ROWS
) -> Model:
    """A model from the labelled rows that are not held out, ``max_rows`` of them at most; rows alike in id and text count once."""
    known = pick(labels, id=id_col, label=label_col).where(F.col("label").isin(0, 1) & F.col("id").isNotNull() & ~held_out(F.col("id")))
    sample = known.groupBy("id").agg(F.min("label").alias("label")).orderBy(F.xxhash64("id"), "id").limit(max_rows)
    texts = pick(docs, id=id_col, text=text_col).join(F.broadcast(sample), "id").withColumn("hash", F.xxhash64("text"))
    rows = texts.select("id", "hash").distinct().orderBy(F.xxhash64("id"), "id", "hash").limit(max_rows)  # an id may have many texts
    once = texts.join(F.broadcast(rows), ["id", "hash"]).groupBy("id", "hash").agg(F.first("text").alias("text"), F.first("label").alias("label"))
    marked = once.select("id", "text", "label", "hash")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("classifier", _words.clear)
        for b in slices(batches, 1, TEXTS_AT_ONCE):
            made = [features(t, bits) for t in b.column(1).to_pylist()]
            blobs = [pa.array([m[k].tobytes() for m in made], pa.binary()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2).cast(pa.int32()), b.column(3), *blobs], names=["id", "label", "hash", "slots", "vals"])

    kind = docs.schema[id_col].dataType.simpleString()
    got = marked.mapInArrow(run, f"id {kind}, label int, hash long, slots binary, vals binary").withColumn("at", F.xxhash64("id"))
    made = materialise(got, "features")
    held = made.agg(F.sum(F.length("slots") + F.length("vals")).alias("n")).first()["n"] or 0
    parts = 1 + held // DRIVER_BYTES
    model = fit(_Rows(made.repartitionByRange(parts, "at", "id", "hash").sortWithinPartitions("at", "id", "hash")), bits)
    release(made)
    return model


def with_scores(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score", bits: int = BITS) -> DataFrame:
    """``docs`` with the column ``score_col``: how likely label 1 is."""
    docs = docs.drop(score_col)
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("classifier", _words.clear)
        m = shipped.value
        for b in slices(batches, at, TEXTS_AT_ONCE):
            scores = pa.array([m.score(*features(t, bits)) for t in b.column(at).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns, scores], names=[*b.schema.names, score_col])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(score_col, T.DoubleType())]))
