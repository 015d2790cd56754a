"""Operator 4: exact top-k by inner product with M-trees, best first.

A vector x gets one more component so that all have the length of the longest; then the
largest inner product is the least Euclidean distance, and the space is metric. The rows form
a forest: a bounded number of routing vectors (drawn by a hash) splits them into cells, cells
of too many rows are split again by a hash of the id, and each cell is cut into pages by
nearness. A page is a node of the tree: its routing vector, covering radius, and of each entry
the distance to that vector. All of it is a written table.

Search is best first in two rounds. In the first a query visits the cells of its nearest
routing vector; its k-th score then bounds the second, where it visits only cells whose
covering radius lets them hold something better. Inside a cell pages are taken in the order of
their least possible distance until that is beyond the k-th; inside a page the stored parent
distances rule out entries by the triangle inequality before any score is computed. Scores
are exact integers; bounds give way by a small slack, so that rounding loses nothing.

Edge cases: vectors that are null or hold null, NaN or infinite components take no part; a
shorter vector counts as filled up with zeros; copies of a vector rank by id; rows with a
repeated id are candidates of their own, and a query leaves out every row with its id. A query
row that comes several times is asked once; one id with several vectors asks for each of them, and
has a list of k for each. Sums must stay within 2**53.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointlake.llm.blocks import best, block_join, numbered_queries, stack, top, usable
from pointlake.llm.common import materialise


def _lifted(x: np.ndarray, longest: float) -> np.ndarray:
    return np.column_stack([x, np.sqrt(np.maximum(longest - np.einsum("ij,ij->i", x, x), 0))])


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    square = np.einsum("ij,ij->i", a, a)[:, None] + np.einsum("ij,ij->i", b, b)[None, :] - 2 * a @ b.T
    return np.sqrt(np.maximum(square, 0))


def _pages(x: np.ndarray, size: int) -> list[np.ndarray]:
    """Row numbers by page: halved between two far members, by nearness, until a page fits."""
    todo, out = [np.arange(len(x))], []
    while todo:
        rows = todo.pop()
        if len(rows) <= size:
            out.append(rows)
            continue
        a = int(_distances(x[rows], x[rows[:1]])[:, 0].argmax())
        d = _distances(x[rows], x[rows[[a]]])[:, 0]
        b = int(d.argmax())
        lean = np.argsort(d - _distances(x[rows], x[rows[[b]]])[:, 0], kind="stable")
        todo += [rows[lean[: len(rows) // 2]], rows[lean[len(rows) // 2 :]]]
    return out


def exact_top_k(
    rows: DataFrame, is_query: Column, k: int = 10, routes: int = 64, page_rows: int = 128, most_cell_rows: int = 20_000,
    chunk_queries: int = 20_000,
) -> DataFrame:
    """query_id, rank, vec_id, score from rows (vec_id, vector array<long>); every query's own id is left out."""
    rows = materialise(rows.where(usable(F.col("vector"))), "mtree-rows")
    norm = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    n, longest, width, asked = rows.agg(F.count(F.lit(1)), F.max(norm), F.max(F.size("vector")), F.count_if(is_query)).first()
    schema = "q long, query_id long, vec_id long, score long"
    if not n or not asked:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    width = max(width, 1)
    drawn = rows.orderBy(F.xxhash64("vec_id", F.lit(3)), "vec_id").limit(routes).toPandas()  # at most `routes` vectors
    centre = _lifted(stack(drawn["vector"], width, np.float64), longest)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = stack(pd.Series(batch.column("vector").to_pylist()), width, np.float64)
            d = _distances(_lifted(x, longest), centre)
            near = d.argmin(1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("vector"), pa.array(near.astype(np.int32)), pa.array(d[np.arange(len(d)), near])],
                ["vec_id", "vector", "route", "d"],
            )

    routed = materialise(rows.select("vec_id", "vector").mapInArrow(route, "vec_id long, vector array<long>, route int, d double"), "mtree-routed")
    stats = {r.route: (r.n, r.d) for r in routed.groupBy("route").agg(F.count(F.lit(1)).alias("n"), F.max("d").alias("d")).collect()}
    cell_rows = max(2 * page_rows, min(most_cell_rows, -(-n // 128)))
    first, cells = {}, 0
    for r in sorted(stats):
        first[r] = (cells, -(-stats[r][0] // cell_rows))
        cells += first[r][1]
    lookup = F.create_map(*[F.lit(x) for r, (a, m) in first.items() for x in (r, a)])
    parts = F.create_map(*[F.lit(x) for r, (a, m) in first.items() for x in (r, m)])
    celled = routed.withColumn("cell", (lookup[F.col("route")] + F.pmod(F.xxhash64("vec_id", F.lit(9)), parts[F.col("route")])).cast("int"))

    def build(frame: pd.DataFrame) -> pd.DataFrame:
        x = stack(frame["vector"], width, np.float64)
        up, ids, out = _lifted(x, longest), frame["vec_id"].to_numpy(), []
        for own in _pages(up, page_rows):
            mid = own[int(_distances(up[own], up[own].mean(0)[None, :])[:, 0].argmin())]
            d = _distances(up[own], up[[mid]])[:, 0]
            out.append((frame["cell"].iloc[0], up[mid].tobytes(), d.max(), ids[own].tobytes(), x[own].tobytes(), d.tobytes()))
        return pd.DataFrame(out, columns=["cell", "centre", "radius", "ids", "vectors", "parents"])

    pages = materialise(
        celled.groupBy("cell").applyInPandas(build, "cell int, centre binary, radius double, ids binary, vectors binary, parents binary"), "mtree-pages"
    )

    def search(nodes: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        q = stack(wanted["vector"], width, np.float64)
        up = np.column_stack([q, np.zeros(len(q))])
        mids = np.stack([np.frombuffer(c) for c in nodes["centre"]])
        to_mid, radius = _distances(up, mids), nodes["radius"].to_numpy()
        ids = [np.frombuffer(i, np.int64) for i in nodes["ids"]]
        vectors = [np.frombuffer(v).reshape(-1, width) for v in nodes["vectors"]]
        parents = [np.frombuffer(p) for p in nodes["parents"]]
        slack = 1e-6 * (1 + np.sqrt(longest))
        out = []
        for i, (number, qid, floor) in enumerate(zip(wanted["q"], wanted["query_id"], wanted["floor"], strict=True)):
            square = q[i] @ q[i] + longest
            least = np.maximum(to_mid[i] - radius - slack, 0)
            got_ids, got, bar = np.zeros(0, np.int64), np.zeros(0, np.int64), floor
            for p in np.argsort(least, kind="stable"):
                if (square - least[p] ** 2) / 2 + 1 < bar:
                    break
                gap = np.maximum(np.abs(to_mid[i, p] - parents[p]) - slack, 0)
                some = np.flatnonzero(((square - gap**2) / 2 + 1 >= bar) & (ids[p] != qid))
                if len(some):
                    got_ids = np.concatenate([got_ids, ids[p][some]])
                    got = np.concatenate([got, np.rint(vectors[p][some] @ q[i]).astype(np.int64)])
                    keep = top(got_ids, got, k)
                    got_ids, got = got_ids[keep], got[keep]
                    if len(got) == k:
                        bar = max(bar, int(got[-1]))
            out.append((np.full(len(got), number), np.full(len(got), qid), got_ids, got))
        return pd.DataFrame({c: np.concatenate([o[j] for o in out]).astype(np.int64) for j, c in enumerate(("q", "query_id", "vec_id", "score"))})

    queries = numbered_queries(routed.where(is_query), "route")
    chunks = -(-asked // chunk_queries)
    none = np.iinfo(np.int64).min
    at_home = F.element_at(F.create_map(*[y for r, (a, m) in first.items() for y in (F.lit(r), F.array(*[F.lit(c) for c in range(a, a + m)]))]), F.col("route"))
    near = block_join(pages, queries.select("q", "query_id", "vector", F.lit(none).alias("floor"), at_home.alias("visits")), chunks, search, schema)
    near = materialise(near, "mtree-near")
    kth = best(near, k).where(F.col("rank") == k).select(F.col("q").alias("__q"), F.col("score").alias("kth"))
    reach = {r: stats[r][1] for r in first}

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = stack(pd.Series(batch.column("vector").to_pylist()), width, np.float64)
            d = _distances(np.column_stack([q, np.zeros(len(q))]), centre)
            square = np.einsum("ij,ij->i", q, q) + longest
            slack, out = 1e-6 * (1 + np.sqrt(longest)), []
            for i, (home, bar) in enumerate(zip(batch.column("route").to_pylist(), batch.column("floor").to_pylist(), strict=True)):
                bound = {r: (square[i] - max(d[i, r] - reach[r] - slack, 0) ** 2) / 2 + 1 for r in first if r != home}
                out.append([c for r, b in bound.items() if b >= bar for c in range(first[r][0], sum(first[r]))])
            cols = [batch.column(c) for c in ("q", "query_id", "vector", "floor")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(out, pa.list_(pa.int32()))], ["q", "query_id", "vector", "floor", "visits"])

    bounded = queries.join(kth, F.col("q") == F.col("__q"), "left").select("q", "query_id", "vector", "route", F.coalesce("kth", F.lit(none)).alias("floor"))
    onward = bounded.mapInArrow(visits, "q long, query_id long, vector array<long>, floor long, visits array<int>")
    return best(near.union(block_join(pages, onward, chunks, search, schema)), k).drop("q")
