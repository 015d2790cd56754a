"""Operator 8: language by sparse multinomial logistic regression on TF-IDF character n-grams.

N-grams of one to three characters (letters folded to lower case, anything else read as a
blank) are hashed into 2**bits features. Document frequencies are counted over all training
texts, in Spark; the weights are fitted by follow-the-regularised-leader with L1 and L2
penalties on a bounded, hashed sample, and a temperature is then fitted on the part of the
sample that training left out. The model is 2**bits numbers a language.

Edge cases: null texts and texts without a letter are `und` with score 0; without any
labelled row every text with letters is `und`, score 0. A text of any length is read whole.
Languages are few (each takes a column of weights): at most `max_languages`, else an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointlake.llm.common import doc_slices, fields, give_back, materialise, mix64, text_buffer, uniform

_TABLES: dict[str, np.ndarray] = {}


def _characters() -> tuple[np.ndarray, np.ndarray]:
    """For every code point: its folded form (blank if no letter), and whether it is a letter."""
    if not _TABLES:
        letter = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
        fold = np.where(letter, np.arange(0x110000), 32).astype(np.uint32)
        for c in np.flatnonzero(letter):
            low = chr(c).lower()
            if len(low) == 1:
                fold[c] = ord(low)
        _TABLES["letter"], _TABLES["fold"] = letter, fold
    return _TABLES["fold"], _TABLES["letter"]


def gram_counts(data: np.ndarray, offsets: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """For each document: its features, their counts, and whether it has a letter."""
    fold, letter = _characters()
    for i, j in doc_slices(offsets):
        part = data[offsets[i] : offsets[j]]
        first = np.concatenate([[0], np.cumsum((part & 0xC0) != 0x80)])[offsets[i : j + 1] - offsets[i]]
        points = np.frombuffer(part.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        chars = fold[points].astype(np.uint64)
        one = mix64(chars + np.uint64(1))
        two = mix64(one[:-1] * np.uint64(3) + chars[1:] + np.uint64(7)) if len(chars) > 1 else one[:0]
        three = mix64(two[:-1] * np.uint64(5) + chars[2:] + np.uint64(11)) if len(chars) > 2 else one[:0]
        keys = [(k >> np.uint64(64 - bits)).astype(np.int64) for k in (one, two, three)]
        letters = np.concatenate([[0], np.cumsum(letter[points])])
        for a, b in zip(first[:-1], first[1:], strict=True):
            count = np.zeros(1 << bits, np.int64)
            for n, k in enumerate(keys):
                if b - n > a:
                    count += np.bincount(k[a : b - n], minlength=1 << bits)
            at = np.flatnonzero(count)
            yield at, count[at], bool(letters[b] > letters[a])


def _tfidf(at: np.ndarray, count: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = (1 + np.log(count)) * idf[at]
    size = float(np.sqrt(x @ x))
    return x / size if size else x


@dataclass
class LanguageModel:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    bits: int

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> tuple[list[str], np.ndarray]:
        names, scores = [], np.zeros(len(offsets) - 1)
        for d, (at, count, letters) in enumerate(gram_counts(data, offsets, self.bits)):
            if not letters or not self.languages:
                names.append("und")
                continue
            p = _softmax((_tfidf(at, count, self.idf) @ self.weights[at] + self.bias) / self.temperature)
            names.append(self.languages[int(p.argmax())])
            scores[d] = p.max()
        return names, scores


def _softmax(logit: np.ndarray) -> np.ndarray:
    e = np.exp(logit - logit.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def document_frequency(docs: DataFrame, bits: int) -> np.ndarray:
    """In how many texts each feature occurs, and at the end the number of texts; over all docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((1 << bits) + 1, np.int64)
        for batch in batches:
            for at, _, _ in gram_counts(*text_buffer(batch.column("text")), bits):
                total[at] += 1
                total[-1] += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["feature", "n"])

    rows = docs.select("text").mapInArrow(run, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n"))
    out = np.zeros((1 << bits) + 1)
    for r in rows.collect():  # at most 2**bits + 1 rows
        out[r.feature] = r.n
    return out


def fit_ftrl(
    rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, classes: int, bits: int,
    alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.01, passes: int = 3,
) -> tuple[np.ndarray, np.ndarray]:
    """Follow the regularised leader, all classes at once, with an elastic net."""
    z, n = np.zeros((1 << bits, classes)), np.zeros((1 << bits, classes))
    bz, bn = np.zeros(classes), np.zeros(classes)

    def solve(z_: np.ndarray, n_: np.ndarray, penalty: float) -> np.ndarray:
        return np.where(np.abs(z_) <= penalty, 0.0, -(z_ - np.sign(z_) * penalty) / ((beta + np.sqrt(n_)) / alpha + l2))

    for _ in range(passes):
        for (at, x), t in zip(rows, y, strict=True):
            zf, nf = z[at], n[at]
            w, b = solve(zf, nf, l1), solve(bz, bn, 0.0)
            g = _softmax(x @ w + b)
            g[t] -= 1
            each = x[:, None] * g
            z[at] = zf + each - (np.sqrt(nf + each**2) - np.sqrt(nf)) / alpha * w
            n[at] = nf + each**2
            bz += g - (np.sqrt(bn + g**2) - np.sqrt(bn)) / alpha * b
            bn += g**2
    return solve(z, n, l1).astype(np.float32), solve(bz, bn, 0.0)


def _temperature(logit: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least log loss on held-back rows."""
    if not len(y):
        return 1.0
    grid = np.exp(np.linspace(np.log(0.02), np.log(10), 80))
    loss = [-np.log(np.maximum(_softmax(logit / t)[np.arange(len(y)), y], 1e-12)).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])


def fit_language(
    docs: DataFrame, train: Column | None = None, max_train: int = 3_000, bits: int = 15, max_languages: int = 200
) -> LanguageModel:
    """Fit on the rows of docs with a lang for which train holds.

    Document frequencies cover all those rows. Weights are fitted on about max_train of them,
    as many of each language where it has so many; the sample is drawn by a hash of doc_id (of a
    repeated one, one text counts) and only its hashed features come to the driver.
    """
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.lit(True) if train is None else train))
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(max_languages + 1).collect()}
    if len(sizes) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    languages = sorted(sizes)
    if not languages:
        return LanguageModel([], np.zeros(1), np.zeros((1, 0), np.float32), np.zeros(0), 1.0, bits)
    df = document_frequency(rows, bits)
    idf = np.log((1 + df[-1]) / (1 + df[:-1])) + 1
    share = F.lit(0.0)
    for name, n in sizes.items():
        share = F.when(F.col("lang") == name, F.lit(min(1.0, max_train / len(languages) / n))).otherwise(share)
    met = rows.where(uniform(F.lit(11), "doc_id") < share).select("doc_id", "lang", "text")
    one = met.groupBy("doc_id").agg(F.min_by(F.struct("lang", "text"), F.struct(F.xxhash64("text"), "text", "lang")).alias("r"))
    drawn = materialise(one.select("doc_id", "r.lang", "r.text"), "language-sample")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, langs, ats, xs = batch.column("doc_id"), batch.column("lang"), [], []
            for at, count, _ in gram_counts(*text_buffer(batch.column("text")), bits):
                ats.append(at.astype(np.uint32).tobytes())
                xs.append(_tfidf(at, count, idf).astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([ids, langs, pa.array(ats, pa.binary()), pa.array(xs, pa.binary())], ["doc_id", "lang", "at", "x"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    got = (
        drawn.mapInArrow(run, f"doc_id {kind}, lang string, at binary, x binary")
        .orderBy(F.xxhash64("doc_id", F.lit(5)), "doc_id", "lang", "at").limit(2 * max_train).toPandas()
    )
    data = [(np.frombuffer(a, np.uint32), np.frombuffer(x, np.float32)) for a, x in zip(got["at"], got["x"], strict=True)]
    y = got["lang"].map({n: i for i, n in enumerate(languages)}).to_numpy(int)
    cut = max(1, len(y) * 4 // 5)
    weights, bias = fit_ftrl(data[:cut], y[:cut], len(languages), bits)
    logit = np.array([x @ weights[at] + bias for at, x in data[cut:]]).reshape(-1, len(languages))
    return LanguageModel(languages, idf, weights, bias, _temperature(logit, y[cut:]), bits)


def predict_language(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """All columns of docs, lang_pred and score; columns of docs that are called so give way."""
    docs = docs.drop("lang_pred", "score")
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, score = model.predict(*text_buffer(batch.column("text")))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(score)], [*names, "lang_pred", "score"])
            give_back()

    return docs.mapInArrow(run, fields(docs.schema, "lang_pred string, score double"))
