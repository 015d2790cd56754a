"""Operator 5: sharding by a hierarchical weighted hash tree, in DataFrame functions only.

A tree has regions, racks and shards. A row descends it: at each level every child draws
-ln(u) / weight, with u a hash of doc_id and the child's own name, and the least draw wins,
so that a child gets rows in proportion to its weight. A draw depends on nothing but the row,
the child and its weight. When weights change, rows move only into or out of the subtrees
whose weights changed. A shard that joins does so as a subtree of its own beside the regions
(`with_shard`): the other draws stay, so rows move only into the new shard.

Each level compares its own few children: regions + racks + shards of one path, all of it
inside one projection. There is no shuffle until slots are counted.

Edge cases: a null doc_id hashes like any value (all such rows go to one shard); rows with
the same doc_id share a shard; null texts have size 1 and crc32 0, empty ones as well. A hot
doc_id or shard is no trouble: slots are counted within buckets of a hash of the row and then
added up. Only rows that are equal in every column share a bucket for certain.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointlake.llm.common import running_rank, uniform


@dataclass(frozen=True)
class Rack:
    name: str
    shards: tuple[tuple[int, float], ...]

    @property
    def weight(self) -> float:
        return sum(w for _, w in self.shards)


@dataclass(frozen=True)
class Region:
    name: str
    racks: tuple[Rack, ...]

    @property
    def weight(self) -> float:
        return sum(r.weight for r in self.racks)


@dataclass(frozen=True)
class ShardTree:
    regions: tuple[Region, ...]

    @staticmethod
    def balanced(shards: int, racks: int = 2, per_rack: int = 2) -> ShardTree:
        """Regions of racks * per_rack shards of weight 1 each; the last one may be smaller."""
        regions, each = [], racks * per_rack
        for start in range(0, shards, each):
            ids = range(start, min(start + each, shards))
            own = [tuple((s, 1.0) for s in ids[k : k + per_rack]) for k in range(0, len(ids), per_rack)]
            name = f"region{start // each}"
            regions.append(Region(name, tuple(Rack(f"{name}/rack{k}", s) for k, s in enumerate(own))))
        return ShardTree(tuple(regions))

    def with_shard(self, shard: int, weight: float = 1.0) -> ShardTree:
        """One more shard, as a region of its own: it takes rows only into itself."""
        name = f"joined{shard}"
        return ShardTree((*self.regions, Region(name, (Rack(f"{name}/rack0", ((shard, weight),)),))))

    def place(self, key: Column) -> Column:
        """The shard of each key."""

        def rack(r: Rack) -> Column:
            return _draw(key, [(f"{r.name}/shard{s}", w, F.lit(s)) for s, w in r.shards])

        def region(r: Region) -> Column:
            return _draw(key, [(x.name, x.weight, rack(x)) for x in r.racks])

        return _draw(key, [(r.name, r.weight, region(r)) for r in self.regions])


def _draw(key: Column, children: list[tuple[str, float, Column]]) -> Column:
    """Of the children (name, weight, what follows), the one with the least draw."""
    if len(children) == 1:
        return children[0][2]
    draws = [-F.log(uniform(key, F.lit(name))) / F.lit(float(weight)) for name, weight, _ in children]
    least = F.least(*draws)
    out = children[-1][2]
    for draw, (_, _, then) in list(zip(draws, children, strict=True))[-2::-1]:
        out = F.when(draw == least, then).otherwise(out)
    return out


def shard_rows(docs: DataFrame, tree: ShardTree, key: str = "doc_id", buckets: int = 1024) -> DataFrame:
    """All columns of docs, `shard int`, and `slot long`: gapless from 0 in each shard.

    Slots follow a hash of the row, so that rows of one key are spread as well. Each of `buckets` hash ranges of a shard is counted on its
    own, so that no task sees a whole shard.
    """
    spread = F.xxhash64(*docs.columns, F.lit("slot"))
    df = docs.withColumn("shard", tree.place(F.col(key)).cast("int")).withColumn("__h", spread)
    width = buckets.bit_length() - 1
    rest = [c for c in docs.columns if c != key]
    return running_rank(df, ["shard"], ["__h", key, *rest], F.shiftright("__h", 64 - width), out="slot").drop("__h")


def shard_documents(docs: DataFrame, shards: int = 8, grown: bool = True) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard for every document."""
    tree = ShardTree.balanced(shards)
    body = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select("doc_id", (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body).alias("text_crc32"))
    placed = shard_rows(rows, tree).withColumn("law", F.lit("key"))
    more = tree.with_shard(shards).place(F.col("doc_id")).cast("int") if grown else F.lit(None).cast("int")
    return placed.withColumn("grown_shard", more).select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"
    )
