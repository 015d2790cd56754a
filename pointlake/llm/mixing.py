"""Operator 1: mixing sources to target weights, in DataFrame functions only.

Sizes are words. Every source has a target (`source_targets`): its share of all words by
weight, never above `most` times its own size, the excess shared out again by weight. A
target is first met with whole epochs of the source and then with a prefix of its documents
in a hashed order, so that taken words hit the target to the word.

The drawn words of a source form a stream that is cut into blocks of `block_words`; how many
blocks of each source an output shard gets is drawn by a splitting tree: a node's blocks are
split between its two children by a multivariate hypergeometric draw, source by source, down
to single shards (`split_quotas`). A quota is then a range of the source's permuted blocks,
so shards get disjoint blocks, and every shard is shuffled by a hash of its rows.

One row per source (and for the tree one row per node, with an array over sources) is all
that is gathered. Sources may be as uneven as they like: documents are ranked within hash
buckets of their source, whose sums are added up first.

Edge cases: null and empty texts have no words and are never drawn; a null source is a
source of its own and comes last; repeated rows each count; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointlake.llm.common import materialise, pack_rest, running_rank, uniform, unpack_rest

#: Fixed value: what a word is.
WORD = r"[^\x20\x09-\x0D]+"
SPREAD = 8.0  # standard deviations that a hypergeometric draw looks at on either side


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, cycle: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """From (source, source_size): adds weight and target.

    Sources in code point order, null last, have the weights of `cycle` again and again.
    With sources in the order of size / weight, those below some point are full (most times
    their size) and the others share what is left by weight; the window finds that point.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in cycle]), ((F.row_number().over(by_name) - 1) % len(cycle) + 1).cast("int"))
    df = sizes.withColumn("weight", weight).withColumn("__cap", F.col("source_size").cast("double") * most)
    fill = Window.orderBy(F.col("__cap") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    every = Window.partitionBy()
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    full = F.coalesce(F.sum("__cap").over(before), F.lit(0.0))
    left = F.sum("weight").over(fill.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    df = df.withColumn("__level", (F.sum(F.col("source_size").cast("double")).over(every) - full) / left)
    open_ = F.col("__level") * F.col("weight") <= F.col("__cap")
    level = F.min(F.when(open_, F.struct((F.col("__cap") / F.col("weight")).alias("r"), "__level"))).over(every)["__level"]
    target = F.least(F.col("__cap"), F.coalesce(level * F.col("weight"), F.col("__cap")))
    return df.withColumn("target", target).drop("__cap", "__level")


def _hypergeometric(total: Column, good: Column, drawn: Column, u: Column) -> Column:
    """How many of `good` are among `drawn` of `total`, by the inverse of the distribution at u.

    Weights are built from the mode outwards by their ratios, over SPREAD standard deviations.
    """
    n, g, d = (c.cast("double") for c in (total, good, drawn))
    mean = F.when(n > 0, d * g / F.greatest(n, F.lit(1.0))).otherwise(0.0)
    var = F.when(n > 1, mean * (1 - g / F.greatest(n, F.lit(1.0))) * (n - d) / F.greatest(n - 1, F.lit(1.0))).otherwise(0.0)
    low = F.greatest(F.lit(0.0), d - (n - g))
    high = F.least(g, d)
    reach = F.ceil(F.sqrt(F.greatest(var, F.lit(0.0))) * SPREAD) + 2
    start = F.greatest(low, F.floor(mean - reach)).cast("long")
    stop = F.greatest(start, F.least(high, F.ceil(mean + reach)).cast("long"))
    log_ratio = lambda k: F.log(F.greatest((g - k) * (d - k), F.lit(1e-300))) - F.log(
        F.greatest((k + 1) * (n - g - d + k + 1), F.lit(1e-300))
    )
    steps = F.sequence(start, stop)
    names = ("log", "sum", "top", "goal", "k")

    def state(*values: Column) -> Column:
        return F.struct(*[v.alias(n) for n, v in zip(names, values, strict=True)])

    none, zero = F.lit(0.0), F.lit(0).cast("long")
    grow = lambda s, k: s["log"] + log_ratio(k.cast("double"))
    more = lambda s: s["sum"] + F.exp(s["log"] - s["top"])
    # three walks: the largest log weight, the sum of weights against it, and the draw itself
    top = F.aggregate(
        steps, state(none, none, none, none, zero),
        lambda s, k: state(grow(s, k), s["sum"], F.greatest(s["top"], s["log"]), s["goal"], s["k"]),
    )["top"]
    whole = F.aggregate(
        steps, state(none, none, top, none, zero), lambda s, k: state(grow(s, k), more(s), s["top"], s["goal"], s["k"])
    )
    count = F.aggregate(
        steps, state(none, none, whole["top"], u * whole["sum"], zero),
        lambda s, k: state(
            grow(s, k), more(s), s["top"], s["goal"], s["k"] + F.when(more(s) < s["goal"], F.lit(1)).otherwise(F.lit(0)).cast("long")
        ),
    )["k"]
    return F.least(start + count, stop)


def split_quotas(blocks: DataFrame, shards: int, seed: int = 1) -> DataFrame:
    """From (source, blocks): (source, shard, first, last), disjoint ranges of each source's blocks.

    The root holds all blocks; every level splits each node's capacity as evenly as its shards
    allow and draws the left child's blocks of each source from what is left of the others.
    """
    root = blocks.agg(
        F.array_sort(F.collect_list(F.struct(F.col("source").isNull().alias("last"), "source", F.col("blocks").cast("long").alias("n")))).alias("own")
    )
    node = root.select(F.lit(0).alias("lo"), F.lit(shards).alias("hi"), "own", F.transform("own", lambda x: F.lit(0).cast("long")).alias("at"))
    for _ in range((shards - 1).bit_length()):
        mid = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
        total = F.aggregate("own", F.lit(0).cast("long"), lambda s, x: s + x["n"])
        capacity = F.floor(total * (mid - F.col("lo")) / (F.col("hi") - F.col("lo"))).cast("long")
        # remaining blocks, remaining capacity, and what the left child has drawn so far
        start = F.struct(total.alias("rest"), capacity.alias("room"), F.array().cast("array<bigint>").alias("got"))

        def take(s: Column, x: Column) -> Column:
            u = uniform(F.coalesce(x["source"], F.lit("\0")), F.col("lo"), F.col("hi"), F.lit(seed))
            k = _hypergeometric(s["rest"], x["n"], s["room"], u)
            return F.struct((s["rest"] - x["n"]).alias("rest"), (s["room"] - k).alias("room"), F.concat(s["got"], F.array(k)).alias("got"))

        node = node.withColumn("left", F.aggregate("own", start, take)["got"]).withColumn("mid", mid)
        part = lambda own, n: F.zip_with(own, n, lambda x, k: F.struct(x["last"].alias("last"), x["source"].alias("source"), k.alias("n")))
        right = F.zip_with("own", "left", lambda x, k: x["n"] - k)
        down = F.when(
            F.col("hi") - F.col("lo") <= 1, F.array(F.struct("lo", "hi", "own", "at"))
        ).otherwise(
            F.array(
                F.struct("lo", F.col("mid").alias("hi"), part(F.col("own"), F.col("left")).alias("own"), "at"),
                F.struct(F.col("mid").alias("lo"), "hi", part(F.col("own"), right).alias("own"), F.zip_with("at", "left", lambda a, k: a + k).alias("at")),
            )
        )
        node = materialise(node.select(F.explode(down).alias("x")).select("x.*"), "mix-tree")
    return (
        node.select(F.col("lo").alias("shard"), F.explode(F.arrays_zip("own", "at")).alias("x"))
        .select("shard", F.col("x.own.source").alias("source"), F.col("x.at").alias("first"), (F.col("x.at") + F.col("x.own.n")).alias("last"))
        .where("last > first")
    )


def mix(
    docs: DataFrame, shards: int = 8, block_words: int = 1024, buckets: int = 1024, seed: int = 1,
    cycle: tuple[int, ...] = (1, 2, 3), most: int = 3, keep: tuple[str, ...] = (),
) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, `draws` and the columns in keep for every row of docs.

    draws: array of (epoch, words, shard, position), one for each time the document is taken;
    words is below size only where a target ends within a document. position orders a shard.
    Reruns on the same rows draw the same. block_words is what moves together to a shard.
    """
    rows = docs.select(
        "doc_id", "source", word_count(F.col("text")).alias("size"),
        F.xxhash64(F.col("doc_id"), F.col("text"), F.lit(seed)).alias("__h"),
        *[F.col(c).alias(f"__k{i}") for i, c in enumerate(keep)],
    )
    rows = rows if keep else materialise(rows, "mix-sizes")
    sizes = materialise(source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), cycle, most), "mix-targets")
    blocks = sizes.select("source", F.ceil(F.col("target") / block_words).alias("blocks"))
    ends = split_quotas(blocks, shards, seed).groupBy("source").agg(F.array_sort(F.collect_list(F.struct("last", "shard"))).alias("ends"))
    plan = sizes.alias("s").join(ends.alias("e"), F.col("s.source").eqNullSafe(F.col("e.source")), "left")
    plan = materialise(plan.select(F.col("s.source").alias("__source"), "source_size", "target", "ends"), "mix-plan")
    width = buckets.bit_length() - 1
    ranked = running_rank(rows, ["source"], ["__h", "doc_id", "size"], F.shiftright("__h", 64 - width), weight="size", out="__at")
    joined = ranked.join(plan, F.col("source").eqNullSafe(F.col("__source")), "left").drop("__source")
    goal = F.round("target").cast("long")
    # epoch e of the stream starts at e * source_size; the mix takes the first `goal` words
    begin = lambda e: e.cast("long") * F.col("source_size") + F.col("__at")
    words = lambda e: F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), goal - begin(e)))
    # documents are permuted, so the i-th block of the stream is the i-th permuted block
    block = lambda e: F.least(F.floor(begin(e) / block_words), F.element_at("ends", -1)["last"] - 1)
    shard = lambda e: F.element_at(F.filter("ends", lambda x: x["last"] > block(e)), 1)["shard"]
    drawn = lambda e: F.struct(
        e.alias("epoch"), words(e).alias("words"), F.when(words(e) > 0, shard(e)).alias("shard"),
        F.xxhash64(F.col("__h"), e, F.lit("place")).alias("position"),
    )
    epochs = F.when(F.col("size") > 0, F.sequence(F.lit(0), F.lit(most - 1))).otherwise(F.array().cast("array<int>"))
    out = joined.withColumn("draws", F.filter(F.transform(epochs, drawn), lambda d: d["words"] > 0))
    taken = F.aggregate("draws", F.lit(0).cast("long"), lambda s, d: s + d["words"])
    return out.withColumn("taken", taken).select(
        "doc_id", "source", "size", "source_size", "target", "taken", "draws", *[F.col(f"__k{i}").alias(c) for i, c in enumerate(keep)]
    )


def mixed_documents(docs: DataFrame, shards: int = 8, **options: object) -> DataFrame:
    """docs itself mixed, with its own columns: a row for each time that a document is taken.

    Documents are taken whole: one of which a target takes a part counts if that is at least
    half of it. Rows are dealt out by range of (shard, position), so each shard lies together
    in shuffled order and may span any number of partitions.
    """
    packed = pack_rest(docs, "doc_id", "source", "text")
    taken = mix(packed, shards, keep=("text", "__rest"), **options)
    rows = taken.withColumn("__d", F.explode(F.filter("draws", lambda d: d["words"] * 2 >= F.col("size"))))
    placed = rows.repartitionByRange(F.col("__d.shard"), F.col("__d.position")).sortWithinPartitions("__d.shard", "__d.position")
    return unpack_rest(placed, docs.columns, "doc_id", "source", "text")
