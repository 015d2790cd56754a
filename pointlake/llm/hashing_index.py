"""Operator 6: approximate nearest neighbours by multi-index hashing.

Codes are signs of learned rotations: vectors are lengthened by one component so that nearness
is a matter of angle, centred, and rotated; each rotation is fitted on a bounded sample by
alternating between codes and the orthogonal map that brings the sample closest to them. A few
rotations give `bits` bits. Rows are indexed in cells of a hash of their id, each with its own
tables: codes are split into substrings of 16 bits, each with a table of postings.

A code within Hamming radius r agrees with the query up to r // substrings bits in at least one
substring. A query probes the tables with all masks of so many bits and checks the whole
distance; the radius grows until enough codes lie within it, and of every code within the
radius at which they do, the inner product of the original vectors is computed. How many are
enough is measured: for a bounded number of sampled queries the true neighbours among all rows
are found, and `keep` of them are among so many nearest codes. It is never fewer than k in a
cell, so a query gets k rows wherever there are k. There is no cap on candidates.

Edge cases: vectors that are null, zero or hold null, NaN or infinite components take no part;
a shorter vector counts as filled up with zeros; copies tie and rank by id; a query leaves out
every row with its id; a query row that comes several times is asked once, and one id with
several vectors asks for each of them, with a list of k for each; with fewer candidates than asked for all are returned.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointlake.llm.blocks import best, block_join, numbered_queries, stack, top, usable
from pointlake.llm.common import materialise

_SUB = 16
_WEIGHT = np.bitwise_count(np.arange(1 << _SUB, dtype=np.uint16))
_BY_WEIGHT = [np.flatnonzero(_WEIGHT == w).astype(np.uint16) for w in range(_SUB + 1)]


@dataclass
class Codes:
    mean: np.ndarray
    maps: list[np.ndarray]
    longest: float

    def of(self, x: np.ndarray) -> np.ndarray:
        """n x bits / 8 bytes."""
        up = self._lift(x) - self.mean
        return np.packbits(np.hstack([up @ m > 0 for m in self.maps]), axis=1)

    def _lift(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([x, np.sqrt(np.maximum(self.longest - np.einsum("ij,ij->i", x, x), 0))]) / np.sqrt(self.longest)


def learn_codes(sample: np.ndarray, longest: float, bits: int = 256, rounds: int = 20, seed: int = 4) -> Codes:
    """Rotations by iterative quantisation on the sample's principal directions."""
    codes = Codes(np.zeros(sample.shape[1] + 1), [], longest)
    up = codes._lift(sample)
    codes.mean = up.mean(0)
    up = up - codes.mean
    basis = np.linalg.svd(up, full_matrices=False)[2]
    rng, left = np.random.default_rng(seed), bits
    while left > 0:
        width = min(left, len(basis))
        own = basis[:width].T
        flat = up @ own
        turn = np.linalg.qr(rng.normal(size=(width, width)))[0]
        for _ in range(rounds):
            u, _, v = np.linalg.svd(np.sign(flat @ turn).T @ flat)
            turn = (u @ v).T
        codes.maps.append(own @ turn)
        left -= width
    return codes


class Tables:
    """The postings of a cell: for each substring its values and the rows that have them."""

    def __init__(self, codes: np.ndarray, order: np.ndarray) -> None:
        self.words, self.postings = codes.view(np.uint64), []
        for s, (o, sub) in enumerate(zip(order, codes.view(np.uint16).T, strict=True)):
            values, first = np.unique(sub[o], return_index=True)
            slot = np.full(1 << _SUB, -1, np.int32)
            slot[values] = np.arange(len(values))
            self.postings.append((s, o, values, slot, first, np.diff(np.append(first, len(o)))))

    def _probe(self, query: np.ndarray, level: int, upto: bool) -> np.ndarray:
        """The rows with a substring that differs in `level` bits (or up to so many), once for each such substring."""
        out = []
        masks = _BY_WEIGHT[level]
        for s, order, values, slot, first, count in self.postings:
            if upto or len(masks) > len(values):  # fewer values than masks: look at the values
                weight = np.bitwise_count(values ^ query[s])
                at = np.flatnonzero(weight <= level if upto else weight == level)
            else:
                at = slot[masks ^ query[s]]
                at = at[at >= 0]
            begin, size = first[at], count[at]
            out.append(order[np.repeat(begin - np.cumsum(size) + size, size) + np.arange(size.sum())])
        return np.concatenate(out)

    def nearest(self, code: np.ndarray, enough: int, level: int = 0) -> np.ndarray:
        """All rows within the Hamming radius that holds `enough` of them (all rows if there are fewer).

        Substrings that differ in at most `level` bits give every code within tables * (level + 1) - 1;
        the level grows from the given one until enough lie within that.
        """
        words, subs, tables = code.view(np.uint64), code.view(np.uint16), len(self.postings)
        far = np.iinfo(np.int64).max
        distance = np.full(len(self.words), far)
        upto = level > 0
        while True:
            rows = np.unique(self._probe(subs, level, upto))
            rows = rows[distance[rows] == far]
            distance[rows] = np.bitwise_count(self.words[rows] ^ words).sum(1, dtype=np.int64)
            sure = np.flatnonzero(distance < tables * (level + 1))
            if len(sure) >= enough:
                radius = np.partition(distance[sure], enough - 1)[enough - 1]
                return sure[distance[sure] <= radius]
            if level == _SUB:
                return np.arange(len(self.words))
            level, upto = level + 1, False


def hamming_top_k(
    rows: DataFrame, is_query: Column, k: int = 20, bits: int = 256, sample_rows: int = 4_000, sample_queries: int = 64,
    keep: float = 0.97, cell_rows: int = 100_000, least_cells: int = 8, chunk_queries: int = 50_000,
) -> DataFrame:
    """query_id, rank, vec_id, score (inner product) from rows (vec_id, vector array<float or double>)."""
    vector = F.transform("vector", lambda x: x.cast("double"))
    rows = rows.where(usable(F.col("vector")) & F.exists("vector", lambda x: x != 0)).select("vec_id", vector.alias("vector"))
    rows = materialise(rows, "index-rows")
    norm = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)
    n, longest, width, asked = rows.agg(F.count(F.lit(1)), F.max(norm), F.max(F.size("vector")), F.count_if(is_query)).first()
    if not n or not asked:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    drawn = rows.orderBy(F.xxhash64("vec_id", F.lit(21)), "vec_id").limit(sample_rows).toPandas()  # at most sample_rows vectors
    codes = learn_codes(stack(drawn["vector"], width, np.float64), longest, bits)
    probe = rows.where(is_query).orderBy(F.xxhash64("vec_id", F.lit(22)), "vec_id").limit(sample_queries).toPandas()
    probe_x, probe_id = stack(probe["vector"], width, np.float64), probe["vec_id"].to_numpy()
    probe_code = codes.of(probe_x)

    def truth(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each sampled query the batch's nearest rows, and how many codes lie at each distance (as rows without score)."""
        for batch in batches:
            x, ids = stack(pd.Series(batch.column("vector").to_pylist()), width, np.float64), np.array(batch.column("vec_id"))
            scores, own, out = x @ probe_x.T, codes.of(x), []
            for j, qid in enumerate(probe_id):  # a repeated id is as many queries
                some = np.flatnonzero(ids != qid)
                d = np.bitwise_count(own ^ probe_code[j]).sum(1, dtype=np.int64)
                n_at = np.bincount(d[some], minlength=bits + 1)
                some = some[top(ids[some], scores[some, j], k)]
                out.append((np.full(len(some) + bits + 1, j), np.append(ids[some], n_at), np.append(scores[some, j], np.full(bits + 1, np.nan)), np.append(d[some], np.arange(bits + 1))))
            cols = [np.concatenate([o[c] for o in out]) for c in range(4)]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(t)) for c, t in zip(cols, (np.int64, np.int64, float, np.int64), strict=True)], ["q", "vec_id", "score", "d"])

    near = materialise(rows.mapInArrow(truth, "q long, vec_id long, score double, d long"), "index-truth")
    far = best(near.where(~F.isnan("score")).select("q", F.lit(0).alias("query_id"), F.struct("score", "d").alias("score"), "vec_id"), k).select("q", "score.d").toPandas()  # k a sampled query
    at = near.where(F.isnan("score")).groupBy("q", "d").agg(F.sum("vec_id").alias("n")).toPandas()  # bits + 1 a sampled query
    at = at.pivot(index="q", columns="d", values="n").cumsum(axis=1)
    ranks = [at.loc[q, d] for q, d in zip(far["q"], far["d"], strict=True)]
    wanted_codes = int(np.quantile(ranks, keep, method="higher")) if ranks else n
    usual = np.quantile([np.searchsorted(r, min(wanted_codes, r[-1])) for r in at.to_numpy()], 0.1, method="lower") if len(at) else 0

    cells = max(least_cells, -(-n // cell_rows))
    share = wanted_codes / cells  # of the nearest codes, in a cell; and what chance may add
    enough, first_level = k + int(np.ceil(share + 2 * np.sqrt(share))), int(usual) // (bits // _SUB)
    celled = rows.withColumn("cell", F.pmod(F.xxhash64("vec_id", F.lit(31)), F.lit(cells)).cast("int"))

    def index(frame: pd.DataFrame) -> pd.DataFrame:
        """A cell's tables: for each substring the order of the rows by its value."""
        x = stack(frame["vector"], width, np.float64)
        own = np.ascontiguousarray(codes.of(x))
        subs = own.view(np.uint16)
        order = np.argsort(subs, axis=0, kind="stable").T.astype(np.int32)
        return pd.DataFrame(
            {"cell": [frame["cell"].iloc[0]], "ids": [frame["vec_id"].to_numpy().tobytes()], "vectors": [x.tobytes()],
             "codes": [own.tobytes()], "order": [np.ascontiguousarray(order).tobytes()]}
        )

    table = celled.groupBy("cell").applyInPandas(index, "cell int, ids binary, vectors binary, codes binary, order binary")
    table = materialise(table, "index-tables")

    def search(cell: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        row = cell.iloc[0]
        ids, x = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["vectors"]).reshape(-1, width)
        own = np.frombuffer(row["codes"], np.uint8).reshape(-1, bits // 8)
        tables = Tables(own, np.frombuffer(row["order"], np.int32).reshape(bits // _SUB, -1))
        q = stack(wanted["vector"], width, np.float64)
        code = np.ascontiguousarray(codes.of(q))
        out = []
        for i, (number, qid) in enumerate(zip(wanted["q"], wanted["query_id"], strict=True)):
            some = tables.nearest(code[i], enough, first_level)
            some = some[ids[some] != qid]
            score = np.einsum("ij,j->i", x[some], q[i])
            keep_ = top(ids[some], score, k)
            out.append((np.full(len(keep_), number), np.full(len(keep_), qid), ids[some][keep_], score[keep_]))
        cols = [np.concatenate([o[c] for o in out]) for c in range(4)]
        return pd.DataFrame({c: cols[i].astype(float if c == "score" else np.int64) for i, c in enumerate(("q", "query_id", "vec_id", "score"))})

    queries = numbered_queries(rows.where(is_query)).withColumn("visits", F.sequence(F.lit(0), F.lit(cells - 1)))
    found = block_join(table, queries, -(-asked // chunk_queries), search, "q long, query_id long, vec_id long, score double")
    return best(found, k).drop("q")
