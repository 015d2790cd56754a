"""Searches over vectors against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointlake.llm.hashing_index import hamming_top_k
from pointlake.llm.mtree import exact_top_k


def brute(ids, x, queries, k):
    out = {}
    for i in np.flatnonzero(queries):
        score = x @ x[i]
        order = [j for j in np.lexsort((ids, -score)) if ids[j] != ids[i]][:k]
        out[int(ids[i])] = [(int(ids[j]), float(score[j])) for j in order]
    return out


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(700, 16))
    x[100:250] = x[100]  # many copies
    x[300:400] = x[300] + 0.01 * rng.normal(size=(100, 16))
    x /= np.linalg.norm(x, axis=1)[:, None]
    return np.arange(700), np.rint(x * 1024).astype(np.int64)


def test_exact(spark, vectors):
    ids, x = vectors
    rows = [(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)] + [(701, None), (702, [None] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, vector array<long>")
    got = {}
    for r in exact_top_k(df, F.col("vec_id") % 10 == 0, 10, routes=16, page_rows=16).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, float(r.score)))
    assert got == brute(ids, x, ids % 10 == 0, 10)


def test_exact_small_and_empty(spark):
    schema = "vec_id long, vector array<long>"
    assert exact_top_k(spark.createDataFrame([], schema), F.lit(True)).count() == 0
    few = spark.createDataFrame([(0, [1, 2]), (1, [3]), (2, [])], schema)
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in exact_top_k(few, F.col("vec_id") == 0).orderBy("rank").collect()]
    assert got == [(0, 1, 1, 3), (0, 2, 2, 0)]


def test_approximate(spark, vectors):
    ids, x = vectors
    x = x / 1024
    bad = [(800, None), (801, [0.0] * 16), (802, [float("nan")] * 16), (803, [float("inf")] * 16), (804, [None] * 16)]
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)] + bad, "vec_id long, vector array<double>")
    want = brute(ids, x, ids % 10 == 0, 10)
    got = {}
    for r in hamming_top_k(df, F.col("vec_id") % 10 == 0, 10).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(got) == set(want)
    hits = [len({round(s, 9) for _, s in got[q]} & {round(s, 9) for _, s in want[q]}) / len({round(s, 9) for _, s in want[q]}) for q in want]
    assert np.mean(hits) >= 0.9
    assert hamming_top_k(df.limit(0), F.lit(True)).count() == 0


@pytest.mark.parametrize("search", [exact_top_k, hamming_top_k])
def test_repeated_query_ids(spark, vectors, search):
    """A repeated row is asked once; an id with two vectors has a list of k for each; candidates count row by row."""
    ids, x = vectors
    rows = [(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)]
    rows += [rows[0]] * 3 + [(10, x[500].tolist())] + [rows[33]]
    df = spark.createDataFrame(rows, "vec_id long, vector array<long>")
    all_ids, all_x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    want = []
    for q, v in {(r[0], tuple(r[1])) for r in rows if r[0] % 10 == 0}:
        score = all_x @ np.array(v)
        want.append((q, [float(score[j]) for j in np.lexsort((all_ids, -score)) if all_ids[j] != q][:10]))
    got = {}
    for r in search(df, F.col("vec_id") % 10 == 0, 10).collect():
        got.setdefault(r.query_id, []).append((r.rank, float(r.score)))
    assert {q: len(v) for q, v in got.items()} == {int(q): 20 if q == 10 else 10 for q in ids[ids % 10 == 0]}
    if search is exact_top_k:
        flat = sorted((q, i + 1, s) for q, scores in want for i, s in enumerate(scores))
        assert sorted((q, *v) for q, vs in got.items() for v in vs) == flat


def test_isolated_queries_find_as_many(spark):
    """Most rows in one tight cluster, a few far from everything: every query gets k rows, the cluster's and the others'."""
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=16) + 0.01 * rng.normal(size=(900, 16)), 3 * rng.normal(size=(60, 16))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, vector array<double>")
    asked = (F.col("vec_id") % 9 == 0) | (F.col("vec_id") >= 940)
    got = hamming_top_k(df, asked, 20, sample_queries=16).groupBy("query_id").count().collect()
    assert len(got) == sum(i % 9 == 0 or i >= 940 for i in range(960)) and {r["count"] for r in got} == {20}
    few = hamming_top_k(df.where("vec_id < 7"), F.lit(True), 20).groupBy("query_id").count().collect()
    assert [r["count"] for r in few] == [6] * 7


def test_tables_give_every_code_within_the_radius():
    from pointlake.llm.hashing_index import Tables

    rng = np.random.default_rng(1)
    codes = rng.integers(0, 256, (600, 8)).astype(np.uint8)
    codes[200:300] = codes[0]
    codes[300:400, :7] = codes[1, :7]
    order = np.argsort(codes.view(np.uint16), axis=0, kind="stable").T.astype(np.int32)
    tables = Tables(codes, order)
    for q in (codes[0], codes[1], codes[599], rng.integers(0, 256, 8).astype(np.uint8)):
        d = np.bitwise_count(codes ^ q).sum(1)
        for enough, level in ((1, 0), (5, 0), (150, 0), (150, 3), (600, 0), (700, 0)):
            got = set(tables.nearest(np.ascontiguousarray(q), enough, level).tolist())
            radius = np.sort(d)[min(enough, 600) - 1]
            assert got == set(np.flatnonzero(d <= radius).tolist())
