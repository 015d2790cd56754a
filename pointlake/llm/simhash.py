"""Operator 3: near duplicates by SimHash fingerprints and a generalised pigeonhole search.

A fingerprint has bit b where more than half of the hashes of a document's shingles have it.
Two fingerprints link at `radius` or fewer differing bits. The search permutes the 64 bits so
that bits that go together lie in the same part, and gives each part its own threshold with

    thresholds sum to radius - parts + 1 (a part at -1 isn't searched),

so that two linked fingerprints must lie within the threshold in at least one part. Thresholds
come from dynamic programming over the parts, on candidate numbers estimated from all
fingerprints: the exact number of pairs that agree in a part, and how often each bit differs.
Of each pair one fingerprint lists the values within half of the threshold of its own, the
other those within the rest; a join on (part, value) checks the whole distance as its condition. The cheapest number of parts is taken.

Copies share a fingerprint and are one row of the search, however many there are. All links
between different fingerprints are found; components come from alternating stars.

Edge cases: null and empty texts have fingerprint zero and link like any other; fewer words
than a shingle count as one; null doc_ids come after all others in a component's smallest id
(null only if all are null); repeated rows each get a row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointlake.llm.common import doc_slices, fields, give_back, materialise, mix64, pack_rest, prefix_hash, scratch, shared_path, span_hash, text_buffer, unpack_rest, word_bounds
from pointlake.llm.components import connected_components

_SLICE = 1 << 17  # shingles hashed at once


def _bit_votes(shingles: list[bytes]) -> np.ndarray:
    h = np.fromiter((xxhash.xxh64_intdigest(s, 42) for s in shingles), np.uint64, len(shingles))
    return np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)


def fingerprint(text: str | None, words: int) -> int:
    """The 64-bit fingerprint of a text, as a signed integer."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()  # lower() of bytes folds A-Z only
    if not parts:
        return 0
    n = max(1, len(parts) - words + 1)
    joined = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[:n].tolist()
    stops = ends[min(words, len(parts)) - 1 :].tolist()
    votes = np.zeros(64, np.int64)
    for k in range(0, n, _SLICE):
        votes += _bit_votes([joined[a:b] for a, b in zip(starts[k : k + _SLICE], stops[k : k + _SLICE], strict=True)])
    return int(np.packbits(votes * 2 > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """All columns of docs and `fp long`, from the whole text."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = [fingerprint(t.as_py(), words) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fp, pa.int64())], [*names, "fp"])
            give_back()

    return docs.mapInArrow(run, fields(docs.schema, "fp long"))


@dataclass
class Parts:
    """The order of the bits, and of each part its first place, width and threshold."""

    order: list[int]
    cuts: list[tuple[int, int, int]]


def _bit_statistics(codes: DataFrame) -> tuple[int, np.ndarray]:
    """Number of codes, and how many have each pair of bits set; over all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((65, 65))
        for batch in batches:
            h = np.array(batch.column("fp")).astype(np.int64)
            for k in range(0, len(h), 1 << 16):
                bits = np.unpackbits(h[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                x = np.column_stack([bits, np.ones(len(bits), np.uint8)]).astype(np.float32)
                total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(65 * 65)), pa.array(total.ravel())], ["k", "n"])

    rows = codes.select("fp").mapInArrow(run, "k long, n double").groupBy("k").agg(F.sum("n").alias("n")).collect()  # 4,225 rows
    out = np.zeros(65 * 65)
    for r in rows:
        out[r.k] = r.n
    out = out.reshape(65, 65)
    return int(out[64, 64]), out


def _grouped_order(n: int, both: np.ndarray, parts: int) -> tuple[list[int], list[int]]:
    """Bits in the order of their parts, correlated bits together, and the parts' widths."""
    p = np.diag(both)[:64] / n
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    related = np.abs((both[:64, :64] / n - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(related, 0)
    left, order = set(range(64)), []
    widths = [64 // parts + (k < 64 % parts) for k in range(parts)]
    for width in widths:
        own = [max(left, key=lambda b: (related[b, list(left)].sum(), -b))]
        left.remove(own[0])
        while len(own) < width:
            nxt = max(left, key=lambda b: (related[b, own].mean(), -b))
            own.append(nxt)
            left.remove(nxt)
        order += sorted(own)
    return order, widths


def _take_bits(fp: Column, bits: list[int]) -> Column:
    """The named bits of fp, packed into a long, in order."""
    out = F.lit(0).cast("long")
    for k, b in enumerate(bits):
        out = out.bitwiseOR(F.shiftleft(F.shiftright(fp, b).bitwiseAND(F.lit(1).cast("long")), k))
    return out


def _allot(costs: list[dict[int, float]], total: int) -> tuple[float, list[int]]:
    """Thresholds of the parts with the given sum and the least cost, by dynamic programming."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for cost in costs:
        nxt: dict[int, tuple[float, list[int]]] = {}
        for s, (c, ts) in best.items():
            for t, more in cost.items():
                if s + t not in nxt or c + more < nxt[s + t][0]:
                    nxt[s + t] = (c + more, [*ts, t])
        best = nxt
    return best.get(total, (float("inf"), []))


def plan_parts(codes: DataFrame, radius: int = 3, part_counts: tuple[int, ...] = (1, 2, 3, 4), most_probes: int = 600) -> Parts:
    """Grouping and thresholds of least estimated work for these distinct codes."""
    n, both = _bit_statistics(codes)
    if n < 2:
        return Parts(list(range(64)), [])  # no pairs, nothing to search
    p = np.diag(both)[:64] / n
    differ = np.clip(2 * p * (1 - p), 1e-9, 1 - 1e-9)
    layouts = {m: _grouped_order(n, both, m) for m in part_counts if m > 1}
    values = [
        F.struct(F.lit(f"{m}.{k}").alias("part"), _take_bits(F.col("fp"), order[sum(widths[:k]) : sum(widths[: k + 1])]).alias("value"))
        for m, (order, widths) in layouts.items() for k in range(m)
    ]
    met = codes.select(F.explode(F.array(*values)).alias("x")).groupBy("x.part", "x.value").agg(F.count(F.lit(1)).alias("c"))
    pairs = {r.part: float(r.p) for r in met.groupBy("part").agg(F.sum(F.col("c").cast("double") * (F.col("c") - 1)).alias("p")).collect()}
    plans = []
    for m, (order, widths) in layouts.items():
        costs: list[dict[int, float]] = []
        for k, width in enumerate(widths):
            bits = order[sum(widths[:k]) : sum(widths[: k + 1])]
            odds = differ[bits] / (1 - differ[bits])
            near, cost, sums = np.array([1.0]), {-1: 0.0}, 0.0
            for b in odds:  # relative numbers of pairs that differ in 0, 1, 2 ... of the part's bits
                near = np.convolve(near, [1.0, b])[: radius + 1]
            for t in range(radius + 1):
                sums += near[t] if t < len(near) else 0.0
                probes = sum(comb(width, i) for i in range(t - t // 2 + 1)) + sum(comb(width, i) for i in range(t // 2 + 1))
                if probes <= most_probes:
                    cost[t] = (max(pairs[f"{m}.{k}"], n * n * float(np.prod(1 - differ[bits])) * 0.5) * sums) + 2.0 * n * probes
            costs.append(cost)
        work, ts = _allot(costs, radius - m + 1)
        if ts:
            plans.append((work, m, ts))
    _, m, ts = min(plans)
    order, widths = layouts[m]
    return Parts(order, [(sum(widths[:k]), w, t) for k, (w, t) in enumerate(zip(widths, ts, strict=True))])


def _masks(width: int, radius: int) -> list[int]:
    """All masks of at most `radius` of `width` bits."""
    out = [0]
    layer = [(0, 0)]
    for _ in range(radius):
        layer = [(m | 1 << b, b + 1) for m, start in layer for b in range(start, width)]
        out += [m for m, _ in layer]
    return out


def hamming_links(codes: DataFrame, radius: int = 3, parts: Parts | None = None, node: str = "fp") -> DataFrame:
    """All pairs (u, v) of nodes, u < v, whose fingerprints `fp` differ in at most radius bits.

    A part's threshold is shared out: one side lists the values within half of it, the other
    those within the rest. A pair is made only in the first part that can find it.
    """
    parts = parts or plan_parts(codes, radius)
    if not parts.cuts:
        return codes.select(F.col(node).alias("u"), F.col(node).alias("v")).where("u < v")
    probes, entries, earlier, fresh = [], [], [], F.lit(True)
    differing = F.col("fp").bitwiseXOR(F.col("fp2"))
    for k, (at, width, t) in enumerate(parts.cuts):
        if t < 0:
            continue
        bits = parts.order[at : at + width]
        value = _take_bits(F.col("fp"), bits)
        probes.append(_around(_masks(width, t - t // 2), value, k))
        entries.append(_around(_masks(width, t // 2), value, k))
        fresh = F.when(F.col("part") == k, F.lit(True) if not earlier else ~_any(earlier)).otherwise(fresh)
        mask = sum(1 << b for b in bits)
        earlier.append(F.bit_count(differing.bitwiseAND(F.lit(mask - (mask >> 63 << 64)).cast("long"))) <= t)
    probe = codes.select(F.col(node).alias("u"), "fp", F.explode(F.flatten(F.array(*probes))).alias("x"))
    probe = probe.select("u", "fp", "x.part", "x.value")
    index = codes.select(F.col(node).alias("v"), F.col("fp").alias("fp2"), F.explode(F.flatten(F.array(*entries))).alias("x"))
    index = index.select("v", "fp2", F.col("x.part").alias("part2"), F.col("x.value").alias("value2"))
    near = (F.col("u") < F.col("v")) & (F.bit_count(differing) <= radius)
    met = (F.col("part") == F.col("part2")) & (F.col("value") == F.col("value2")) & near & fresh
    return probe.join(index, met).select("u", "v")


def _any(of: list[Column]) -> Column:
    out = of[0]
    for c in of[1:]:
        out = out | c
    return out


def _around(masks: list[int], value: Column, part: int) -> Column:
    """(part, value) for value changed by each of the masks."""
    listed = F.array(*[F.lit(m - (m >> 63 << 64)).cast("long") for m in masks])
    return F.transform(listed, lambda m: F.struct(F.lit(part).alias("part"), value.bitwiseXOR(m).alias("value")))


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 3) -> DataFrame:
    """All columns of docs but text, `fp long`, `component_id` (smallest doc_id reachable).

    Columns of docs that are called fp or component_id give way.
    """
    columns = [c for c in docs.columns if c not in ("text", "fp", "component_id")]
    packed = pack_rest(docs.select("text", *columns), "doc_id", "text")
    marked = materialise(fingerprints(packed, words).drop("text"), "simhash-fp")
    codes = materialise(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-codes")
    # components on dense code ids would need a rank; the codes themselves do as nodes
    linked = connected_components(hamming_links(codes.select("fp"), radius))
    linked = materialise(linked, "simhash-linked")
    group = codes.join(linked, codes.fp == linked.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("g"))
    best = group.groupBy("g").agg(F.min("least").alias("component_id"))
    of_code = materialise(group.select("fp", "g").join(best, "g").select(F.col("fp").alias("__fp"), "component_id"), "simhash-groups")
    found = marked.join(of_code, F.col("fp") == F.col("__fp"))
    return found.select(*[F.col(c) if c == "doc_id" else F.col("__rest")[c].alias(c) for c in columns], "fp", "component_id")


# --- similar documents: fingerprints first, bands of minima for the rest, similarity by the sets themselves ---

KEYS = ("k0", "k1")
SKETCH = ("s0", "s1", "s2", "s3")
_CODE_WORDS = 3  # words of a fingerprint's shingle, as in operator 3
_BAND, _BANDS = 5, 28  # minima in a band, bands
_RNG = np.random.default_rng(97)
_ADDED = _RNG.integers(0, 1 << 32, 256, dtype=np.uint32)
_TIMES = _RNG.integers(0, 1 << 32, 256, dtype=np.uint32) | np.uint32(1)
_BAND_TIMES = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(1, _BAND + 1)], np.uint64)
_BLOCK = 1 << 11  # shingles whose 256 hashes are held at once


def _shingle_sets(texts: pa.Array, words: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles; fewer words than a shingle are one, no words none."""
    data, offsets = text_buffer(texts)
    for i, j in doc_slices(offsets):
        part, own = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        part = np.where((part >= 65) & (part <= 90), part + np.uint8(32), part)
        starts, ends, first = word_bounds(part, own)
        w = span_hash(prefix_hash(part), starts, ends)
        scaled, shingle = [np.uint64(pow(0x9E3779B97F4A7C15, k, 1 << 64)) for k in range(words)], np.zeros(len(w), np.uint64)
        for k, times in enumerate(scaled):
            shingle[: max(len(w) - k, 0)] += w[k:] * times
        shingle = mix64(shingle)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a >= words:
                yield np.unique(shingle[a : b - words + 1])
            elif b > a:
                yield mix64((w[a:b] * np.array(scaled[: b - a], np.uint64)).sum(dtype=np.uint64).reshape(1))
            else:
                yield np.zeros(0, np.uint64)


def _minima(h: np.ndarray) -> np.ndarray:
    """The least values of 256 hash functions over a set."""
    out = np.full(256, 0xFFFFFFFF, np.uint32)
    short = (h >> np.uint64(32)).astype(np.uint32)[:, None]
    for k in range(0, len(h), _BLOCK):
        np.minimum(out, ((short[k : k + _BLOCK] ^ _ADDED) * _TIMES).min(0), out=out)
    return out


def similar_documents(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """All columns of docs, `rid` (a row number) and `group` (the smallest rid that is linked, over any number of links).

    Two texts link if the Jaccard similarity of their sets of words-shingles is at least
    similarity. First comes the operator's own search: fingerprints of three-word shingles that
    differ in at most 3 bits, by the generalised pigeonhole (`_fingerprint_links`). It can't find
    all such pairs (at 0.8 about 9 of 64 bits differ), so what it leaves apart is looked for in
    28 bands of five minima of the sets, which a pair at 0.8 misses with a chance of 0.000015, at
    0.85 of 2e-7, whatever the edits and the length. Every candidate's sets are made again and
    compared whole. Texts with equal sets are one.

    Large families don't become all their pairs: each text is compared with one leader, of its
    fingerprint's links and then of its bands. Texts of a band that have no leader in common after
    that are paired by prefixes of their sets (`_prefix_pairs`), if 256 one-bit minima don't rule
    it out (by 5.5 standard errors).
    """
    marked, group = _families(docs, words, similarity)
    return _with_group(marked, group).select(*docs.columns, "rid", "group")


def _families(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(docs with rid, keys of the set, fingerprint, bands and one-bit minima; the group of each set), both written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            keys, bands, bits = np.zeros((n, 2), np.uint64), np.zeros((n, _BANDS), np.uint64), np.zeros((n, 256), np.uint8)
            filled = np.zeros(n, bool)
            for i, h in enumerate(_shingle_sets(batch.column("text"), words)):
                if len(h):
                    filled[i] = True
                    keys[i] = h.sum(dtype=np.uint64), mix64(h ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
                    least = _minima(h)
                    bands[i] = mix64((least[: _BAND * _BANDS].reshape(_BANDS, _BAND) * _BAND_TIMES).sum(1, dtype=np.uint64))
                    bits[i] = (least * np.uint32(0x9E3779B1)) >> np.uint32(31)
            sketch = np.packbits(bits, axis=1).view(np.int64).T
            short = (bands >> np.uint64(32)).astype(np.uint32).view(np.int32)
            ends = np.concatenate([[0], np.cumsum(filled) * _BANDS]).astype(np.int32)
            listed = pa.ListArray.from_arrays(pa.array(ends), pa.array(short[filled].ravel()))
            code = pa.array([fingerprint(t.as_py(), _CODE_WORDS) for t in batch.column("text")], pa.int64())
            more = [*map(pa.array, keys.view(np.int64).T), code, listed, *map(pa.array, sketch)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, *KEYS, "code", "bands", *SKETCH])
            give_back()

    numbered = docs.withColumn("rid", F.monotonically_increasing_id())
    schema = fields(numbered.schema, "k0 long, k1 long, code long, bands array<int>, " + ", ".join(f"{s} long" for s in SKETCH))
    marked = materialise(numbered.mapInArrow(run, schema), "similar-marked")
    stays = shared_path(docs.sparkSession, "similar-groups")
    with scratch(docs.sparkSession):  # only the groups stay of what follows
        first = F.min(F.struct("rid", "code", "bands", *SKETCH)).alias("x")
        codes = marked.groupBy(*KEYS).agg(first).select(*KEYS, F.col("x.rid").alias("node"), F.col("x.code").alias("fp"), "x.bands", *[f"x.{s}" for s in SKETCH])
        codes = materialise(codes, "similar-codes")
        linked = _linked(codes, marked.select("rid", "text"), words, similarity)
        at = F.col("__node")
        group = codes.select(*[F.col(c).alias(f"__{c}") for c in KEYS], F.col("node").alias("__node")).join(linked, at == F.col("node"), "left")
        group = group.select(*[f"__{c}" for c in KEYS], F.coalesce("component", at).alias("group"))
        return marked, materialise(group, "similar-groups", stays)


def _fingerprint_links(codes: DataFrame, texts: DataFrame, words: int, similarity: float, radius: int = 3) -> DataFrame:
    """Links (u, v) of nodes whose fingerprints differ in at most radius bits and whose whole sets are similar; v leads u.

    A fingerprint's first text leads its others; itself it is led by the one of its links that has
    the most links, if that has more than itself. So links go up, and there are fewer than nodes.
    """
    first = materialise(codes.groupBy("fp").agg(F.min("node").alias("node")), "similar-fingerprints")
    links = materialise(hamming_links(first, radius, node="node"), "similar-near")
    both = links.union(links.select("v", "u"))
    degree = both.groupBy("u").agg(F.count(F.lit(1)).alias("n_v")).select(F.col("u").alias("__v"), "n_v")
    lead = both.join(degree, F.col("v") == F.col("__v")).groupBy("u").agg(F.max(F.struct("n_v", "v")).alias("x"), F.count(F.lit(1)).alias("n"))
    lead = lead.where("x.n_v > n OR x.n_v = n AND x.v > u").select("u", "x.v")
    alike = codes.select(F.col("node").alias("u"), "fp").join(first.select(F.col("fp").alias("__fp"), F.col("node").alias("v")), F.col("fp") == F.col("__fp"))
    pairs = materialise(lead.union(alike.where("u <> v").select("u", "v")), "similar-pairs")
    return materialise(_as_similar(pairs, texts, words, similarity), "similar-near-links")


def _follow(own: DataFrame, up: DataFrame, jumps: int) -> DataFrame:
    """(node, own) with each own led on by up (u, v), one v a u at most, so many times."""
    up = up.select(F.col("u").alias("__u"), F.col("v").alias("__v"))
    for _ in range(jumps):
        own = own.join(up, F.col("own") == F.col("__u"), "left").select("node", F.coalesce("__v", "own").alias("own"))
    return own


def _with_own(pairs: DataFrame, own: DataFrame) -> DataFrame:
    """The pairs (u, v) with own_u and own_v."""
    first = own.select(F.col("node").alias("__u"), F.col("own").alias("own_u"))
    second = own.select(F.col("node").alias("__v"), F.col("own").alias("own_v"))
    return pairs.join(first, F.col("u") == F.col("__u")).join(second, F.col("v") == F.col("__v")).select("u", "v", "own_u", "own_v")


def _linked(codes: DataFrame, texts: DataFrame, words: int, similarity: float, jumps: int = 3) -> DataFrame:
    """(node, component) of the nodes that are linked to others."""
    # texts of one `own` are known to be linked: at first by their fingerprints
    near_links = _fingerprint_links(codes, texts, words, similarity)
    known = materialise(_follow(codes.select("node", F.col("node").alias("own")), near_links, jumps), "similar-known")
    entries = codes.select("node", F.posexplode("bands").alias("band", "short"))
    value = F.shiftleft(F.col("band").cast("long"), 32).bitwiseOR(F.col("short").cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))
    entries = entries.select("node", value.alias("value"))
    shared = entries.groupBy("value").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("value").alias("__value"), "n")
    met = materialise(entries.join(shared, F.col("value") == F.col("__value")).select("value", "node", "n"), "similar-met")
    wrong = (1 - similarity) / 2  # share of one-bit minima that differ
    apart = int(np.ceil(256 * wrong + 5.5 * np.sqrt(256 * wrong * (1 - wrong))))
    other = [F.col(s).alias(f"{s}_2") for s in SKETCH]
    near = sum((F.bit_count(F.col(s).bitwiseXOR(F.col(f"{s}_2"))) for s in SKETCH), F.lit(0)) <= apart
    # a leader of each band: the text that shares the most bands, as the base of a family does; leaders always share more
    central = met.groupBy("node").agg(F.sum("n").alias("central")).select(F.col("node").alias("__c"), "central")
    of = codes.select(F.col("node").alias("__n"), *SKETCH).join(central, F.col("__n") == F.col("__c"))
    seen = materialise(met.join(of, F.col("node") == F.col("__n")).select("value", "node", "central", *SKETCH), "similar-seen")
    lead = seen.groupBy("value").agg(F.max(F.struct("central", "node", *SKETCH)).alias("x"))
    lead = lead.select(F.col("value").alias("value_2"), F.col("x.node").alias("lead"), F.col("x.central").alias("central_2"), *[F.col(f"x.{s}").alias(f"{s}_2") for s in SKETCH])
    led = seen.join(lead, (F.col("value") == F.col("value_2")) & (F.col("node") != F.col("lead")) & near)
    led = led.groupBy("node").agg(F.max(F.struct("central_2", "lead")).alias("x")).select(F.col("node").alias("u"), F.col("x.lead").alias("v"))
    led = materialise(_with_own(led, known), "similar-pairs")  # what the fingerprints have linked isn't compared again
    fresh = _as_similar(led.where("own_u <> own_v").select("u", "v"), texts, words, similarity)
    led = materialise(led.where("own_u = own_v").select("u", "v").union(fresh), "similar-led")
    # each text's leader, and that one's, and so on; then what the fingerprints link, from smaller to larger ones
    own = materialise(_follow(met.select("node").distinct().withColumn("own", F.col("node")), led, jumps), "similar-own")
    up = _with_own(near_links, own).where("own_u <> own_v").select(F.least("own_u", "own_v").alias("u"), F.greatest("own_u", "own_v").alias("v"))
    own = materialise(_follow(own, materialise(up.groupBy("u").agg(F.max("v").alias("v")), "similar-up"), jumps), "similar-own")
    seen = met.select("value", "node").join(own.select(F.col("node").alias("__n"), "own"), F.col("node") == F.col("__n"))
    mixed = seen.groupBy("value").agg(F.min("own").alias("low"), F.max("own").alias("high")).where("low <> high").select(F.col("value").alias("__value"))
    left = seen.select("value", "node", "own").join(mixed, F.col("value") == F.col("__value")).groupBy("node").agg(F.min("own").alias("own"))
    pairs = _prefix_pairs(materialise(left, "similar-open"), texts, words, similarity)
    first, second = codes.select(F.col("node").alias("__u"), *SKETCH), codes.select(F.col("node").alias("__v"), *other)
    pairs = pairs.join(first, F.col("u") == F.col("__u")).join(second, F.col("v") == F.col("__v")).where(near).select("u", "v")
    found = materialise(_as_similar(materialise(pairs, "similar-pairs"), texts, words, similarity), "similar-links")
    return materialise(connected_components(near_links.union(led).union(found)), "similar-linked")


def _prefix_pairs(left: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """Of the sets of `left` (node, own) all pairs (u, v) of different `own` that can reach the similarity, and few others.

    Prefix and positional filters: in an order of all shingles, two similar sets x and y, y not
    the larger, have a first common shingle behind which enough is left on both sides, so it is
    within the first fifth of x and the first ninth of y. In the order those come first that
    sets of one `own` alone have, then the rare ones. A text that differs by more than a fifth
    from all others, however many share the rest of it, then meets none.
    """
    t, eps = similarity, 1e-9

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(_shingle_sets(batch.column("text"), words))
            ends = pa.array(np.cumsum([0, *map(len, sets)]).astype(np.int32))
            listed = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("own"), pa.array([len(h) for h in sets], pa.int32()), listed], ["node", "own", "n", "tokens"])
            give_back()

    sets = texts.join(left, F.col("rid") == F.col("node")).select("node", "own", "text").mapInArrow(run, "node long, own long, n int, tokens array<long>")
    tokens = materialise(sets.select("node", "own", "n", F.explode("tokens").alias("token")), "similar-tokens")
    shared = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("f"), F.min("own").alias("low"), F.max("own").alias("high")).where("low <> high")
    hits = tokens.join(shared.select(F.col("token").alias("__t"), "f"), F.col("token") == F.col("__t"))
    of = Window.partitionBy("node")
    at = F.col("n") - F.count(F.lit(1)).over(of) + F.row_number().over(of.orderBy("f", "token")) - 1
    hits = hits.select("node", "own", "n", "token", at.cast("int").alias("p"))
    # the largest and the least size of a smaller partner that this place still allows
    most = F.least(F.col("n").cast("double"), (F.col("n") - F.col("p")) * ((1 + t) / t) - F.col("n") + eps)
    least = F.col("n") * t - eps
    step = lambda size: F.floor(F.log(size) / float(np.log(1.1))).cast("int")
    probe = hits.where(most >= least).withColumn("size", F.explode(F.sequence(step(F.greatest(least, F.lit(1.0)) - eps), step(F.greatest(most, F.lit(1.0)) + eps)))).withColumn("probe", F.lit(True))
    entry = hits.where(F.col("p") <= F.col("n") - F.col("n") * (2 * t / (1 + t)) + eps).withColumn("size", step(F.col("n").cast("double") + eps)).withColumn("probe", F.lit(False))
    keyed = materialise(probe.unionByName(entry), "similar-prefixes")
    # of a key's components the one with the most rows isn't paired with itself
    owns = keyed.groupBy("token", "size", "own").agg(F.count(F.lit(1)).alias("c")).groupBy("token", "size").agg(F.max_by("own", F.struct("c", "own")).alias("mode"), F.count(F.lit(1)).alias("owns"))
    owns = owns.where("owns > 1").select(F.col("token").alias("__t"), F.col("size").alias("__s"), "mode")
    keyed = keyed.join(owns, (F.col("token") == F.col("__t")) & (F.col("size") == F.col("__s"))).withColumn("main", F.col("own") == F.col("mode"))
    keyed = materialise(keyed.select("token", "size", "probe", "node", "own", "n", "p", "main"), "similar-keyed")
    x = keyed.where("probe").select("token", "size", *[F.col(c).alias(f"{c}_x") for c in ("node", "own", "n", "p", "main")])
    y = keyed.where("not probe").select(F.col("token").alias("__t"), F.col("size").alias("__s"), *[F.col(c).alias(f"{c}_y") for c in ("node", "own", "n", "p", "main")])
    enough = F.least(F.col("n_x") - F.col("p_x"), F.col("n_y") - F.col("p_y")) >= (F.col("n_x") + F.col("n_y")) * (t / (1 + t)) - eps
    fit = (F.col("token") == F.col("__t")) & (F.col("size") == F.col("__s")) & (F.col("own_x") != F.col("own_y")) & (F.col("n_y") <= F.col("n_x")) & (F.col("n_y") >= F.col("n_x") * t - eps) & enough
    met = x.where("not main_x").join(y, fit).unionByName(x.where("main_x").join(y.where("not main_y"), fit))
    return met.select(F.least("node_x", "node_y").alias("u"), F.greatest("node_x", "node_y").alias("v")).distinct()


def _as_similar(pairs: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """The pairs (u, v) whose texts have that Jaccard similarity of shingles, by their whole sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(_shingle_sets(batch.column("a"), words), _shingle_sets(batch.column("b"), words), strict=True):
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(both >= similarity * (len(a) + len(b) - both) - 1e-9)
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))
            give_back()

    first = texts.select(F.col("rid").alias("__a"), F.col("text").alias("a"))
    second = texts.select(F.col("rid").alias("__b"), F.col("text").alias("b"))
    met = pairs.join(first, F.col("u") == F.col("__a")).join(second, F.col("v") == F.col("__b"))
    return met.select("u", "v", "a", "b").mapInArrow(run, "u long, v long")


def _with_group(marked: DataFrame, group: DataFrame) -> DataFrame:
    same = F.lit(True)
    for c in KEYS:
        same = same & (F.col(c) == F.col(f"__{c}"))
    return marked.join(group, same)


def keep_one_of_each(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs without near copies: of each group the row with the smallest doc_id stays (of equal ones, the first row).

    Null doc_ids come last. Columns are those of docs.
    """
    marked, group = _families(pack_rest(docs, "doc_id", "text"), words, similarity)
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")
    grouped = _with_group(marked.select("doc_id", "rid", *KEYS), group)
    first = grouped.groupBy("group").agg(F.min(key).alias("k")).select(F.col("k.rid").alias("__rid"))
    first = materialise(first, "similar-kept")  # ids only: texts are written once, and meet one join
    return unpack_rest(marked.join(first, F.col("rid") == F.col("__rid"), "left_semi"), docs.columns, "doc_id", "text")
