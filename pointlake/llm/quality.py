"""Operator 10: quality by a generalised additive model with pairwise interactions.

Every document becomes a row of text statistics (all from its whole text). Boosting goes
round the features in turn: each visit fits a shallow tree on one feature's bins to the
residuals and adds it to that feature's lookup table. Then the strongest pairs get tables
of their own in the same way. A score is a sum of table entries, so scoring is bin search
and addition. The model is a few hundred kilobytes at most, whatever the corpus.

Edge cases: null and empty texts get the statistics of an empty text and a score like any
other; without labels of both kinds the score is the share of ones (0.5 without any).
Repeated rows each get their own output row; columns other than those named are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointlake.llm.common import doc_slices, fields, give_back, mix64, prefix_hash, span_hash, text_buffer, word_bounds
from pointlake.llm.sampling import labelled_sample, one_text_each

FEATURES = (
    "log_words", "mean_word", "upper", "digits", "symbols", "non_ascii", "bang", "pipe", "distinct_words",
    "repeated_next", "word_ends_symbol", "short_words", "words_per_stop", "log_line", "repeated_lines",
    "long_words", "commas", "capital_words",
)

ACCEPT_FROM = 0.7  # from this score up a text counts as good, in operator 10 and in the pipeline
_KIND = np.zeros((6, 256), np.int8)
_KIND[0, 65:91] = 1
_KIND[1, 48:58] = 1
_KIND[2, [c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,;:'\"()-?"]] = 1
_KIND[3, 128:] = 1
_KIND[4, [46, 63]] = 1
_KIND[5, 97:123] = 1


def _per_doc(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def _distinct(keys: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Number of distinct keys of each document."""
    n = np.diff(bounds)
    doc = np.repeat(np.arange(len(n)), n)
    order = np.argsort(mix64(keys + mix64(doc.astype(np.uint64) + np.uint64(1))), kind="stable")
    k, d = keys[order], doc[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (d[1:] != d[:-1])
    return np.bincount(d[new], minlength=len(n)).astype(float)


def text_statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of FEATURES for each document of a text buffer."""
    size = np.maximum(np.diff(offsets), 1).astype(float)
    starts, ends, first = word_bounds(data, offsets)
    words = np.diff(first).astype(float)
    some = np.maximum(words, 1)
    counts = [_per_doc(_KIND[k][data], offsets) for k in range(6)]
    length = (ends - starts).astype(float)
    prefix = prefix_hash(data)
    word = span_hash(prefix, starts, ends)
    again = np.zeros(len(word))
    again[1:] = word[1:] == word[:-1]
    again[first[:-1][first[:-1] < len(again)]] = 0
    lasts = data[ends - 1] if len(ends) else np.zeros(0, np.uint8)
    line_end = data == 10
    edge = np.unique(np.concatenate([np.flatnonzero(line_end), offsets[1:][np.diff(offsets) > 0] - 1]))
    begin = np.concatenate([[0], edge[:-1] + 1]) if len(edge) else edge
    stop = edge + ~line_end[edge] if len(edge) else edge
    begin = np.minimum(begin, stop)
    filled = stop > begin
    begin, stop = begin[filled], stop[filled]
    lines_at = np.searchsorted(begin, offsets)
    lines = np.diff(lines_at).astype(float)
    line = span_hash(prefix, begin, stop)
    per = lambda mask: _per_doc(mask.astype(np.int8), first)
    heads = data[starts] if len(starts) else np.zeros(0, np.uint8)
    return np.column_stack(
        [
            np.log1p(words),
            _per_doc(length, first) / some,
            counts[0] / np.maximum(counts[0] + counts[5], 1),
            counts[1] / size,
            counts[2] / size,
            counts[3] / size,
            _per_doc((data == 33).astype(np.int8), offsets) / some,
            _per_doc((data == 124).astype(np.int8), offsets) / some,
            _distinct(word, first) / np.sqrt(some),
            _per_doc(again, first) / some,
            per(_KIND[2][lasts] == 1) / some,
            per(length <= 3) / some,
            np.minimum(some / np.maximum(counts[4], 1), 500),
            np.log1p(size / np.maximum(lines, 1)),
            1 - _distinct(line, lines_at) / np.maximum(lines, 1),
            per(length > 15) / some,
            _per_doc((data == 44).astype(np.int8), offsets) / some,
            per((heads >= 65) & (heads <= 90)) / some,
        ]
    )


def _batch_statistics(column: pa.Array) -> np.ndarray:
    data, offsets = text_buffer(column)
    parts = [text_statistics(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in doc_slices(offsets)]
    return np.vstack(parts) if parts else np.zeros((0, len(FEATURES)))


@dataclass
class AdditiveModel:
    """Cut points and lookup tables of the single features and of the pairs."""

    cuts: list[np.ndarray]
    tables: list[np.ndarray]
    coarse: list[np.ndarray]
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)
    base: float = 0.0

    def logit(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for f, (cuts, table) in enumerate(zip(self.cuts, self.tables, strict=True)):
            out += table[np.searchsorted(cuts, x[:, f], "right")]
        if self.pairs:
            bins = {f: np.searchsorted(self.coarse[f], x[:, f], "right") for f in {f for p in self.pairs for f in p}}
            for (f, g), table in zip(self.pairs, self.pair_tables, strict=True):
                out += table[bins[f], bins[g]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x), -30, 30)))


def _leaf(g: np.ndarray, h: np.ndarray, ridge: float) -> np.ndarray:
    return g / (h + ridge)


def _shallow_tree(g: np.ndarray, h: np.ndarray, leaves: int, ridge: float) -> np.ndarray:
    """Values by bin of the greedy tree with up to `leaves` leaves on the bins' gradient sums."""
    cuts = [0, len(g)]
    cg, ch = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    worth = lambda a, b: (cg[b] - cg[a]) ** 2 / (ch[b] - ch[a] + ridge)
    for _ in range(leaves - 1):
        best, at = 1e-9, None
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b - a > 1:
                k = np.arange(a + 1, b)
                gain = worth(a, k) + worth(k, b) - worth(a, b)
                if gain.max() > best:
                    best, at = gain.max(), int(k[gain.argmax()])
        if at is None:
            break
        cuts = sorted([*cuts, at])
    out = np.zeros(len(g))
    for a, b in zip(cuts, cuts[1:], strict=False):
        out[a:b] = _leaf(cg[b] - cg[a], ch[b] - ch[a], ridge)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """The best split of a pair's grid into four parts, and its values."""
    cg, ch = (np.pad(v.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for v in (g, h))
    tg, th = cg[-1, -1], ch[-1, -1]
    i, j = slice(1, -1), slice(1, -1)
    parts = [
        (cg[i, j], ch[i, j]),
        (cg[i, -1:] - cg[i, j], ch[i, -1:] - ch[i, j]),
        (cg[-1:, j] - cg[i, j], ch[-1:, j] - ch[i, j]),
        (tg - cg[i, -1:] - cg[-1:, j] + cg[i, j], th - ch[i, -1:] - ch[-1:, j] + ch[i, j]),
    ]
    gain = sum(a**2 / (b + ridge) for a, b in parts)
    if not gain.size:
        return 0.0, np.zeros_like(g)
    r, c = np.unravel_index(gain.argmax(), gain.shape)
    out = np.empty_like(g, float)
    values = [a[r, c] / (b[r, c] + ridge) for a, b in parts]
    out[: r + 1, : c + 1], out[: r + 1, c + 1 :], out[r + 1 :, : c + 1], out[r + 1 :, c + 1 :] = values
    return float(gain[r, c] - tg**2 / (th + ridge)), out


def fit_additive_model(
    x: np.ndarray, y: np.ndarray, bins: int = 64, rounds: int = 120, rate: float = 0.15, leaves: int = 3,
    pairs: int = 8, pair_rounds: int = 40, pair_bins: int = 12, ridge: float = 2.0,
) -> AdditiveModel:
    """Cyclic boosting on the bounded sample."""
    width = len(FEATURES) if not len(x) else x.shape[1]
    cut = lambda k: [np.unique(np.quantile(x[:, f], np.arange(1, k) / k)) if len(x) else np.zeros(0) for f in range(width)]
    cuts, coarse = cut(bins), cut(pair_bins)
    model = AdditiveModel(cuts, [np.zeros(len(c) + 1) for c in cuts], coarse)
    share = float(np.mean(y)) if len(y) else 0.5
    if not 0 < share < 1:
        model.base = float(np.clip(np.log(max(share, 1e-6) / max(1 - share, 1e-6)), -12, 12)) if len(y) else 0.0
        return model
    model.base = float(np.log(share / (1 - share)))
    at = [np.searchsorted(c, x[:, f], "right") for f, c in enumerate(cuts)]
    logit = np.full(len(y), model.base)
    for _ in range(rounds):
        for f in range(width):
            p = 1 / (1 + np.exp(-logit))
            n = len(cuts[f]) + 1
            step = rate * _shallow_tree(
                np.bincount(at[f], y - p, n), np.bincount(at[f], p * (1 - p), n), leaves, ridge
            )
            model.tables[f] += step
            logit += step[at[f]]
    rough = [np.searchsorted(c, x[:, f], "right") for f, c in enumerate(coarse)]

    def grid(f: int, g: int, values: np.ndarray) -> np.ndarray:
        a, b = len(coarse[f]) + 1, len(coarse[g]) + 1
        return np.bincount(rough[f] * b + rough[g], values, a * b).reshape(a, b)

    p = 1 / (1 + np.exp(-logit))
    gains = [
        (_quadrants(grid(f, g, y - p), grid(f, g, p * (1 - p)), ridge)[0], f, g)
        for f in range(width) for g in range(f + 1, width)
    ]
    model.pairs = [(f, g) for gain, f, g in sorted(gains, reverse=True)[:pairs] if gain > 0]
    model.pair_tables = [np.zeros((len(coarse[f]) + 1, len(coarse[g]) + 1)) for f, g in model.pairs]
    for _ in range(pair_rounds):
        for k, (f, g) in enumerate(model.pairs):
            p = 1 / (1 + np.exp(-logit))
            step = rate * _quadrants(grid(f, g, y - p), grid(f, g, p * (1 - p)), ridge)[1]
            model.pair_tables[k] += step
            logit += step[rough[f], rough[g]]
    return model


def quality_features(docs: DataFrame, keep: list[str]) -> DataFrame:
    """keep columns and `features array<double>` of the whole `text`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _batch_statistics(batch.column("__text"))
            rest = [batch.column(c) for c in keep]
            flat = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(FEATURES)).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*rest, flat], [*keep, "features"])
            give_back()

    return docs.select(*keep, F.col("text").alias("__text")).mapInArrow(run, fields(docs.select(*keep).schema, "features array<double>"))


def fit_quality(docs: DataFrame, labels: DataFrame, train: Column | None = None, max_train: int = 20_000) -> AdditiveModel:
    """Fit on at most max_train labelled rows, drawn by a hash of doc_id; of a repeated doc_id one text counts.

    Only their statistics (18 numbers each) come to the driver, never their texts.
    """
    sample = labelled_sample(labels, "quality", F.lit(True) if train is None else train, max_train)
    rows = one_text_each(docs, sample)
    got = quality_features(rows, ["doc_id", "y"]).orderBy("doc_id", "features").toPandas()
    x = np.stack(got["features"].to_numpy()) if len(got) else np.zeros((0, len(FEATURES)))
    return fit_additive_model(x, got["y"].to_numpy(float))


def score_quality(docs: DataFrame, model: AdditiveModel, column: str = "score") -> DataFrame:
    """All columns of docs and the score of the whole text; a column of docs that is called like it gives way."""
    docs = docs.drop(column)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = model.score(_batch_statistics(batch.column("text")))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], [*names, column])
            give_back()

    return docs.mapInArrow(run, fields(docs.schema, f"`{column}` double"))
