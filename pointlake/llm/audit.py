"""Filter interaction audit: what five text filters remove, in every order, and what each would remove alone.

Words are exploded and aggregated by (document, word), then by document, for totals and distinct
words; the flags of the other filters are outer-joined to them. A document then is one of 32 sets
of failed filters, and a part of the corpus is 32 conditional counts (three times: all, good and
toxic documents). Every figure of every order follows from those counts.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointlake.llm.common import materialise

FILTERS = "ABCDE"
#: The bounds of the filters.
LEAST_WORDS, LEAST_DISTINCT_PERCENT, MOST_CAPITALS_PERCENT = 50, 65, 5
SYMBOLS = r"[#$%&*|]"
WORD_BREAK = r"[\x20\x09-\x0D]+"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def failed_filters(docs: DataFrame) -> DataFrame:
    """doc_id, part, mask (bit k: filter k of FILTERS fails) and n, the number of rows of docs of which that is true.

    docs: doc_id, text, source; other columns are not looked at. A null text is empty, a null
    source the empty string. A text is told apart from others of the same doc_id by its hash, so
    repeated rows and repeated doc_ids count row by row. A null doc_id is neither smaller nor
    larger than another: E never holds for it, and its text makes no other one a copy. Equal
    texts of one doc_id aren't copies of each other, as neither doc_id is smaller.

    Texts are shuffled once, to where all words of a document then meet: repeated rows are one
    before that. Copies, also thousands of them, meet only in an aggregate (the least doc_id of a
    digest), and find out by an equality on (digest, doc_id) whether they are the first one.
    """
    rows = docs.select(
        F.coalesce("doc_id", F.lit(0).cast("long")).alias("id"), F.col("doc_id").isNotNull().alias("known"),
        F.coalesce("source", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"),
    ).withColumn("key", F.xxhash64("text"))
    row = ["id", "known", "part", "key"]
    texts = rows.groupBy(*row).agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("n"))

    capitals = F.length("text") - F.length(F.translate("text", CAPITALS, ""))
    flags = texts.select(
        *row, "n", F.unhex(F.sha2("text", 256)).alias("digest"),
        (capitals * 100 > F.length("text") * MOST_CAPITALS_PERCENT).alias("c"), F.col("text").rlike(SYMBOLS).alias("d"),
    )
    # n goes along with the words, so that both sides read the same shuffled texts
    words = texts.select(*row, "n", F.explode(F.split("text", WORD_BREAK)).alias("word")).where("word <> ''")
    words = words.groupBy(*row, "n", "word").agg(F.count(F.lit(1)).alias("times"))
    totals = words.groupBy(*row, "n").agg(F.sum("times").alias("words"), F.count(F.lit(1)).alias("distincts")).drop("n")
    told = materialise(flags.join(totals, row, "left"), "filter-flags")  # one small row a document

    first = told.where("known").groupBy("digest").agg(F.min("id").alias("id")).withColumn("first", F.lit(True)).withColumn("known", F.lit(True))
    met = told.join(first, ["id", "known", "digest"], "left")
    n_words, n_distinct = F.coalesce("words", F.lit(0)), F.coalesce("distincts", F.lit(0))
    fails = {
        "A": n_words < LEAST_WORDS,
        "B": n_distinct * 100 < n_words * LEAST_DISTINCT_PERCENT,
        "C": F.col("c"),
        "D": F.col("d"),
        "E": F.col("known") & F.col("first").isNull(),
    }
    mask = sum((F.when(fails[f], 1 << k).otherwise(0) for k, f in enumerate(FILTERS)), F.lit(0))
    doc_id = F.when(F.col("known"), F.col("id")).alias("doc_id")
    return met.select(doc_id, "part", mask.alias("mask"), "n").groupBy("doc_id", "part", "mask").agg(F.sum("n").alias("n"))


def interaction_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part: n0 ... n31, good0 ... good31 and toxic0 ... toxic31, by the mask of failed filters.

    labels: doc_id, quality, toxic. Of repeated doc_ids the largest label counts; rows without a label are neither good nor toxic.
    """
    marks = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("__q"), F.max("toxic").alias("__t"))
    marks = marks.withColumnRenamed("doc_id", "__label_id")
    failed = failed_filters(docs)  # of a doc_id one row per part and mask, however many rows it has
    met = failed.join(marks, F.col("doc_id") == F.col("__label_id"), "left")
    kinds = {"n": F.lit(True), "good": F.col("__q") == 1, "toxic": F.col("__t") == 1}
    sums = [
        F.coalesce(F.sum(F.when((F.col("mask") == m) & kind, F.col("n"))), F.lit(0)).cast("long").alias(f"{name}{m}")
        for name, kind in kinds.items()
        for m in range(1 << len(FILTERS))
    ]
    return met.groupBy("part").agg(*sums)


def audit_orders(counts: DataFrame) -> DataFrame:
    """part, filter_order, step and the figures of that step, for every order of the filters.

    kept: rows that pass this and all earlier filters. removed: those that fail this one and passed
    the earlier ones. redundant: those that fail it and were gone. unique_fails: those that fail
    this filter only. good_lost, toxic_lost: labelled rows removed here. shapley: rows that the
    filter removes, summed over all orders. All follow from the 32 counts of a part.
    """
    size, orders = len(FILTERS), list(permutations(range(len(FILTERS))))
    cases, steps = [], []
    for f in range(size):
        for before in (b for b in range(1 << size) if not b >> f & 1):
            for m in range(1 << size):
                fails, gone = bool(m >> f & 1), bool(m & before)
                # a filter removes a row in those orders that put it before the row's other failed filters
                first_in = len(orders) // m.bit_count() if fails else 0
                cases.append((f, before, m, not fails and not gone, fails and not gone, fails and gone, m == 1 << f, first_in))
    for order in orders:
        before = 0
        for k, f in enumerate(order):
            steps.append(("".join(FILTERS[i] for i in order), k + 1, f, before))
            before |= 1 << f
    spark = counts.sparkSession  # 2,560 and 600 rows, whatever the corpus
    told = spark.createDataFrame(cases, "filter int, before int, mask int, keeps boolean, removes boolean, late boolean, alone boolean, first_in int")
    plan = spark.createDataFrame(steps, "filter_order string, step int, filter int, before int")

    sets = [F.struct(F.lit(m).alias("mask"), *[F.col(f"{c}{m}").alias(c) for c in ("n", "good", "toxic")]) for m in range(1 << size)]
    sets = counts.select("part", F.explode(F.array(*sets)).alias("s")).select("part", "s.*")
    total = lambda count, when, name: F.sum(F.when(F.col(when), F.col(count)).otherwise(0)).alias(name)
    figures = sets.join(F.broadcast(told), "mask").groupBy("part", "filter", "before").agg(
        total("n", "keeps", "kept"), total("n", "removes", "removed"), total("n", "late", "redundant"), total("n", "alone", "unique_fails"),
        total("good", "removes", "good_lost"), total("toxic", "removes", "toxic_lost"), F.sum(F.col("n") * F.col("first_in")).alias("shapley"),
    )
    return figures.join(F.broadcast(plan), ["filter", "before"]).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"
    )


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the five filters and step; see `failed_filters` for odd rows. No documents: no rows."""
    return audit_orders(interaction_counts(docs, labels))


#: DuckDB SQL of the same rows, straight from each document's failed filters.
AUDIT_SQL = r"""
WITH docs AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents
), words AS (
  SELECT doc_id, part, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM docs
), firsts AS (
  SELECT text, min(doc_id) AS first_id FROM docs GROUP BY text
), marks AS (
  SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), flags AS (
  SELECT w.part,
    len(w.w) < 50 AS a,
    100 * len(list_distinct(w.w)) < 65 * len(w.w) AS b,
    100 * length(regexp_replace(w.text, '[^A-Z]', '', 'g')) > 5 * length(w.text) AS c,
    regexp_matches(w.text, '[#$%&*|]') AS d,
    coalesce(w.doc_id > f.first_id, false) AS e,
    coalesce(m.quality = 1, false) AS good, coalesce(m.toxic = 1, false) AS toxic
  FROM words AS w JOIN firsts AS f ON w.text = f.text LEFT JOIN marks AS m ON w.doc_id = m.doc_id
), sets AS (
  SELECT part, concat(CASE WHEN a THEN 'A' ELSE '' END, CASE WHEN b THEN 'B' ELSE '' END, CASE WHEN c THEN 'C' ELSE '' END,
      CASE WHEN d THEN 'D' ELSE '' END, CASE WHEN e THEN 'E' ELSE '' END) AS failed,
    count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
  FROM flags GROUP BY ALL
), letters AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f
), orders AS (
  SELECT concat(p.f, q.f, r.f, s.f, t.f) AS filter_order
  FROM letters AS p, letters AS q, letters AS r, letters AS s, letters AS t
  WHERE p.f NOT IN (q.f, r.f, s.f, t.f) AND q.f NOT IN (r.f, s.f, t.f) AND r.f NOT IN (s.f, t.f) AND s.f <> t.f
), steps AS (
  SELECT filter_order, CAST(step AS INT) AS step, substr(filter_order, step, 1) AS f, substr(filter_order, 1, step - 1) AS earlier
  FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step) AS k
), told AS (
  SELECT s.part, t.filter_order, t.step, t.f, s.failed, s.n, s.good, s.toxic,
    contains(s.failed, t.f) AS fails, t.earlier <> '' AND s.failed <> translate(s.failed, t.earlier, '') AS gone
  FROM sets AS s, steps AS t
), figures AS (
  SELECT part, filter_order, step, f,
    coalesce(sum(n) FILTER (NOT fails AND NOT gone), 0) AS kept,
    coalesce(sum(n) FILTER (fails AND NOT gone), 0) AS removed,
    coalesce(sum(n) FILTER (fails AND gone), 0) AS redundant,
    coalesce(sum(n) FILTER (failed = f), 0) AS unique_fails,
    coalesce(sum(good) FILTER (fails AND NOT gone), 0) AS good_lost,
    coalesce(sum(toxic) FILTER (fails AND NOT gone), 0) AS toxic_lost
  FROM told GROUP BY part, filter_order, step, f
)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
  CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM figures
"""
