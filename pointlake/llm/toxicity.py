"""Operator 9: toxicity by FTRL-proximal logistic regression over hashed word n-grams.

Features of a document are the distinct hashes of its words, of pairs of neighbouring words
and of pairs with one word skipped between them, case folded (ASCII). Training goes through
a bounded, hashed sample of labelled rows; each coordinate has its own learning rate, and
the L1 penalty leaves few weights above zero, and only those go to the tasks. They are 2**bits at
most, so their size doesn't depend on the corpus.

Edge cases: null and empty texts have no features and get the score of the bias; without
labels of both kinds the score is the share of ones (0.5 without any labels). Repeated rows
each get a row; very long texts are read whole, in slices.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointlake.llm.common import doc_slices, fields, give_back, mix64, prefix_hash, span_hash, text_buffer, word_bounds
from pointlake.llm.sampling import labelled_sample, one_text_each

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_EDGE = np.zeros(256, bool)
_EDGE[[c for c in range(33, 127) if not chr(c).isalnum()]] = True


def word_features(data: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(document number, feature) of every word, pair and skip pair, in no order, with repeats."""
    low = _LOWER[data]
    starts, ends, first = word_bounds(low, offsets)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    for _ in range(3):  # punctuation at a word's edges isn't part of it
        wide = ends - starts > 1
        starts = starts + (wide & _EDGE[low[np.minimum(starts, max(len(low) - 1, 0))]])
        wide = ends - starts > 1
        ends = ends - (wide & _EDGE[low[ends - 1]])
    word = span_hash(prefix_hash(low), starts, ends)
    docs, keys = [doc], [word]
    for gap in (1, 2):
        if len(word) > gap:
            same = doc[gap:] == doc[:-gap]
            docs.append(doc[gap:][same])
            keys.append((word[:-gap] * np.uint64(31) + word[gap:] * np.uint64(2 * gap + 1) + np.uint64(gap))[same])
    key = mix64(np.concatenate(keys)) >> np.uint64(64 - bits)
    return np.concatenate(docs), key.astype(np.int64)


@dataclass
class SparseLogit:
    bits: int
    weights: np.ndarray
    base: float

    def __getstate__(self) -> dict:
        """Only the weights that aren't zero travel."""
        at = np.flatnonzero(self.weights)
        return {"bits": self.bits, "base": self.base, "at": at.astype(np.uint32), "kept": self.weights[at]}

    def __setstate__(self, state: dict) -> None:
        self.bits, self.base, self.weights = state["bits"], state["base"], np.zeros(1 << state["bits"], np.float32)
        self.weights[state["at"]] = state["kept"]

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        logit = np.full(len(offsets) - 1, self.base)
        for i, j in doc_slices(offsets):
            doc, key = word_features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], self.bits)
            hit = self.weights[key] != 0
            both = np.unique((doc[hit] << self.bits) | key[hit])  # a feature counts once in a document
            logit[i:j] += np.bincount(both >> self.bits, self.weights[both & ((1 << self.bits) - 1)], j - i)
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def fit_ftrl(
    rows: list[np.ndarray], y: np.ndarray, bits: int, alpha: float = 1.0, beta: float = 1.0, l1: float = 10.0,
    l2: float = 0.0, passes: int = 6,
) -> SparseLogit:
    """FTRL-proximal over the sample's feature lists, in the given order, `passes` times."""
    share = float(np.mean(y)) if len(y) else 0.5
    base = float(np.clip(np.log(max(share, 1e-6) / max(1 - share, 1e-6)), -12, 12)) if len(y) else 0.0
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    if not 0 < share < 1:
        return SparseLogit(bits, z.astype(np.float32), base)
    bias_z = bias_n = 0.0

    def solve(z_: np.ndarray, n_: np.ndarray, penalty: float) -> np.ndarray:
        return np.where(np.abs(z_) <= penalty, 0.0, -(z_ - np.sign(z_) * penalty) / ((beta + np.sqrt(n_)) / alpha + l2))

    for _ in range(passes):
        for f, t in zip(rows, y, strict=True):
            w = solve(z[f], n[f], l1)
            bias = float(solve(np.float64(bias_z), np.float64(bias_n), 0.0))
            g = 1 / (1 + np.exp(-np.clip(base + bias + w.sum(), -30, 30))) - t
            for_all = (np.sqrt(n[f] + g * g) - np.sqrt(n[f])) / alpha
            z[f] += g - for_all * w
            n[f] += g * g
            bias_z += g - (np.sqrt(bias_n + g * g) - np.sqrt(bias_n)) / alpha * bias
            bias_n += g * g
    weights = solve(z, n, l1).astype(np.float32)
    return SparseLogit(bits, weights, base + float(solve(np.float64(bias_z), np.float64(bias_n), 0.0)))


def sample_features(rows: DataFrame, bits: int) -> DataFrame:
    """doc_id, y and the distinct features of each row's text as packed 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column("text"))
            packed: list[bytes] = []
            for i, j in doc_slices(offsets):
                doc, key = word_features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], bits)
                both = np.unique((doc << bits) | key)
                cut = np.searchsorted(both, np.arange(j - i + 1) << bits)
                flat = (both & ((1 << bits) - 1)).astype(np.uint32)
                packed += [flat[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("y"), pa.array(packed, pa.binary())], ["doc_id", "y", "f"]
            )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "y", "text").mapInArrow(run, f"doc_id {kind}, y int, f binary")


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, train: Column | None = None, max_train: int = 8_000, bits: int = 20
) -> SparseLogit:
    """Fit on at most max_train labelled rows, drawn by a hash of doc_id (of a repeated one, one text counts); their hashed features come to the driver."""
    sample = labelled_sample(labels, "toxic", F.lit(True) if train is None else train, max_train)
    rows = one_text_each(docs, sample)
    got = sample_features(rows, bits).withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id", "f").toPandas()
    return fit_ftrl([np.frombuffer(f, np.uint32) for f in got["f"]], got["y"].to_numpy(float), bits)


def score_toxicity(docs: DataFrame, model: SparseLogit, column: str = "score") -> DataFrame:
    """All columns of docs and the score of the whole text; a column of docs that is called like it gives way."""
    docs = docs.drop(column)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = model.score(*text_buffer(batch.column("text")))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], [*names, column])
            give_back()

    return docs.mapInArrow(run, fields(docs.schema, f"`{column}` double"))
