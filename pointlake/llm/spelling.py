"""Spelling variants: words at one edit from each other, by two-dimensional range reporting.

A word is a point: its place among all words in forward order, and its place in reverse order
(words read from the end). For an edit at some position, the words before it share the prefix, an
interval of the forward order, and those behind it the suffix, an interval of the reverse order;
the points in both intervals differ from the word at that position only. A wavelet tree over the
reverse places, kept in forward order, reports them in a time that grows with their number.

The vocabulary is too large for one tree. An edit in the second half of a word leaves its first
half as it is, and one in the first half the second; so words are dealt by halves, twice, and a
tree is made for the halves that one task holds. Halves shared by very many words are cut into
pieces that each meet each chunk of the asking words.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointlake.llm.common import materialise

#: What a run of letters is, and which of its occurrences lose a letter.
RUN = r"[^A-Za-zÀ-ÿ]+"
LOSES_ONE_IN = 199
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class WaveletTree:
    """Values 0 ... n - 1 in some order; reports those within an interval of places and an interval of values."""

    def __init__(self, values: np.ndarray) -> None:
        self.n, self.depth = len(values), max(1, int(len(values) - 1).bit_length())
        self.zeros, self.split = [], []  # per level: zeros before each place, and in all
        now = values.astype(np.int64)
        for level in range(self.depth - 1, -1, -1):
            bit = now >> level & 1
            before = np.zeros(self.n + 1, np.int32)
            np.cumsum(bit == 0, out=before[1:])
            self.zeros.append(before)
            self.split.append(int(before[-1]))
            now = np.concatenate([now[bit == 0], now[bit == 1]])

    def report(self, left: np.ndarray, right: np.ndarray, low: np.ndarray, high: np.ndarray, slice_: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
        """(asking, value): the values in low ... high - 1 at the places left ... right - 1, for each asking row."""
        out = [self._report(np.arange(a, min(a + slice_, len(left))), left, right, low, high) for a in range(0, len(left), slice_)]
        return (np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])) if out else (np.zeros(0, np.int64),) * 2

    def _report(self, who: np.ndarray, left: np.ndarray, right: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        who = who[(left[who] < right[who]) & (low[who] < high[who])]
        a, b, base = left[who], right[who], np.zeros(len(who), np.int64)
        for k, (zeros, split) in enumerate(zip(self.zeros, self.split, strict=True)):
            half = 1 << (self.depth - 1 - k)
            za, zb = zeros[a], zeros[b]
            down = (base, za, zb), (base + half, a - za + split, b - zb + split)
            kept = []
            for start, x, y in down:
                on = (x < y) & (start < high[who]) & (start + half > low[who])
                kept.append((who[on], x[on], y[on], start[on]))
            who, a, b, base = (np.concatenate([p[i] for p in kept]) for i in range(4))
        # at the leaves a value stands at one place, as values are distinct
        return who, base


def codes(words: list[str], length: int) -> np.ndarray:
    """The code points of words of one length, a word a row."""
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), length)


def prefix_intervals(tree: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """The order of the tree's words, and for each p the interval of places whose words begin with the asked words' first p letters.

    Prefixes are numbered letter by letter, the tree's and the asked ones together, so that numbers keep the order of letters.
    """
    n, width = tree.shape
    number = np.zeros(n + len(asked), np.int64)
    steps, out = [number], []
    for p in range(min(width, asked.shape[1])):
        letters = np.concatenate([tree[:, p], asked[:, p]]).astype(np.int64)
        _, number = np.unique(number << 32 | letters, return_inverse=True)
        steps.append(number)
    for p in range(len(steps), width + 1):  # letters that only the tree's words have
        _, number = np.unique(number[:n] << 32 | tree[:, p - 1].astype(np.int64), return_inverse=True)
    order = np.argsort(number[:n], kind="stable")
    for number in steps:
        placed = number[:n][order]
        out.append((np.searchsorted(placed, number[n:], "left"), np.searchsorted(placed, number[n:], "right")))
    return order, out


def near_in(tree: list[str], asked: list[str], edits: range) -> tuple[np.ndarray, np.ndarray]:
    """(asking, tree word) where the words differ by one edit at one of the positions `edits`.

    All tree words have one length. The asking words have that length too (a letter is replaced)
    or one letter more (a letter goes; of equal neighbours the last one, so that no pair comes twice).
    """
    length, more = len(tree[0]), len(asked[0]) - len(tree[0])
    t, q = codes(tree, length), codes(asked, length + more)
    forward, starts = prefix_intervals(t, q)
    backward, ends = prefix_intervals(t[:, ::-1], q[:, ::-1])
    reverse_place = np.empty(len(tree), np.int64)
    reverse_place[backward] = np.arange(len(tree))
    wavelet = WaveletTree(reverse_place[forward])
    found = []
    for p in edits:
        ok = np.ones(len(q), bool)
        if more and p + 1 < q.shape[1]:
            ok = q[:, p] != q[:, p + 1]
        rows = np.flatnonzero(ok)
        (left, right), (low, high) = starts[p], ends[length + more - 1 - p]
        who, place = wavelet.report(left[rows], right[rows], low[rows], high[rows])
        who, place = rows[who], backward[place]
        differ = np.ones(len(who), bool) if more else q[who, p] != t[place, p]
        found.append((who[differ], place[differ]))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


PAIRS = "word string, n long, near string, near_n long"


def _search(frame: pd.DataFrame) -> pd.DataFrame:
    """Pairs of one task, each in both directions: for each length, half and piece the tree's words against those that ask."""
    out = [pd.DataFrame({"word": [], "n": [], "near": [], "near_n": []})]
    for (length, side, _), group in frame.groupby(["length", "side", "piece"], sort=False):
        cut = int(length) // 2
        tree, asking = group[group["role"] == 0], group[group["role"] == 1]
        for more, asked in asking.groupby(asking["word"].str.len() - int(length)):
            if not len(tree):
                continue
            # where the first half is kept, edits are from `cut` on, else before it
            edits = range(cut, int(length) + int(more)) if side == 0 else range(cut)
            who, place = near_in(tree["word"].tolist(), asked["word"].tolist(), edits)
            a, b = asked.iloc[who], tree.iloc[place]
            pairs = {"word": a["word"].to_numpy(), "n": a["n"].to_numpy(), "near": b["word"].to_numpy(), "near_n": b["n"].to_numpy()}
            out.append(pd.DataFrame(pairs))
            if more:  # replaced letters are found from either side, a lost one from the longer word only
                out.append(pd.DataFrame({"word": pairs["near"], "n": pairs["near_n"], "near": pairs["word"], "near_n": pairs["n"]}))
    return pd.concat(out)


def near_words(words: DataFrame, shortest: int, task_rows: int = 60_000, piece_rows: int = 30_000) -> DataFrame:
    """word, n, near, near_n: every pair of words (word, n; distinct words) at exactly one inserted, deleted or replaced code point, in both directions."""
    size = F.length("word")

    def place(role: int, length: Column, side: int, key: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), length.alias("length"), F.lit(side).alias("side"), key.alias("key"))

    def half(length: Column, side: int, more: int) -> Column:
        cut = F.floor(length / 2).cast("int")
        return F.substring("word", F.lit(1), cut) if side == 0 else F.substring("word", cut + 1 + more, size)

    places = [place(role, size - more, side, half(size - more, side, more)) for role, more in ((0, 0), (1, 0), (1, 1)) for side in (0, 1)]
    rows = words.select("word", "n", F.explode(F.array(*places)).alias("p")).select("word", "n", "p.*").where(F.col("length") >= shortest)

    group = ["length", "side", "key"]
    counts = rows.groupBy(*group).agg(F.count_if(F.col("role") == 0).alias("trees"), F.count_if(F.col("role") == 1).alias("asks"))
    pieces = counts.where("trees > 0 AND asks > 0").select(*group, F.ceil(F.col("trees") / piece_rows).alias("ts"), F.ceil(F.col("asks") / piece_rows).alias("qs"))
    dealt = rows.join(pieces, group)
    own = F.when(F.col("role") == 0, F.pmod(F.xxhash64("word"), "ts")).otherwise(F.pmod(F.xxhash64("word"), "qs"))
    others = F.sequence(F.lit(0).cast("long"), F.when(F.col("role") == 0, F.col("qs")).otherwise(F.col("ts")) - 1)
    dealt = dealt.withColumn("own", own).withColumn("other", F.explode(others))
    cell = F.when(F.col("role") == 0, F.concat_ws("/", "key", "own", "other")).otherwise(F.concat_ws("/", "key", "other", "own"))
    # halves of usual size share a task's trees; a piece of a large one has a tree of its own
    dealt = dealt.withColumn("piece", F.when((F.col("ts") > 1) | (F.col("qs") > 1), cell).otherwise(""))
    tasks = max(1, -(-6 * words.count() // task_rows))
    dealt = dealt.withColumn("task", F.pmod(F.xxhash64(*group, "piece"), F.lit(tasks)))
    return dealt.select("task", "role", "length", "side", "piece", "word", "n").groupBy("task").applyInPandas(_search, PAIRS)


def count_words(docs: DataFrame, shortest: int = 6, least: int = 5) -> DataFrame:
    """word and n: runs of letters of at least `shortest` code points after A to Z are made small, with at least `least` occurrences.

    An occurrence whose crc32 (of doc_id, a colon and the run) is a multiple of LOSES_ONE_IN counts
    as the run without one of its letters. A null text has no runs, a null doc_id is written as nothing.
    """
    text = F.translate(F.coalesce("text", F.lit("")), CAPITALS, SMALL)
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.split(text, RUN)).alias("run"))
    runs = runs.where(F.length("run") >= shortest)
    hashed = runs.select("run", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    shorter = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    word = F.when(F.col("h") % LOSES_ONE_IN == 0, shorter).otherwise(F.col("run"))
    counted = hashed.select(word.alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.where((F.length("word") >= shortest) & (F.col("n") >= least))


def spelling_variants(docs: DataFrame, shortest: int = 6, least: int = 5, factor: int = 5) -> DataFrame:
    """word, n, n_near, form, form_n, root of each word that `count_words` counts.

    docs: doc_id and text; other columns aren't looked at, and repeated rows count as often as they
    come. Two words are near at exactly one inserted, deleted or replaced code point. form is the
    near word with the largest n (ties: the smallest by code points) if that is at least `factor`
    times the word's own, else null; root is where following forms from the word ends. No
    documents, or none with such words: no rows.
    """
    words = materialise(count_words(docs, shortest, least), "words")
    near = near_words(words, shortest).groupBy("word", "n").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), F.col("near").alias("word"))).alias("best")
    )
    enough = -F.col("best.minus") >= F.col("n") * factor
    near = near.select("word", "n_near", F.when(enough, F.col("best.word")).alias("form"), F.when(enough, -F.col("best.minus")).alias("form_n"))
    near = materialise(near, "near-words")
    roots = follow(near.where(F.col("form").isNotNull()).select("word", F.col("form").alias("to")))
    found = words.join(near, "word", "left").join(roots.withColumnRenamed("to", "root"), "word", "left")
    return found.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form", "form_n", F.coalesce("root", "word").alias("root"))


def follow(links: DataFrame) -> DataFrame:
    """word and to, the end of the chain of links from word: each round doubles the steps taken. Links lead to larger counts, so there are no rings."""
    links = materialise(links, "links")
    while not links.isEmpty():
        after = links.select(F.col("word").alias("to"), F.col("to").alias("next"))
        met = materialise(links.join(after, "to", "left").select("word", F.coalesce("next", "to").alias("to"), F.col("next").isNull().alias("ended")), "links")
        moved = met.where(~F.col("ended"))
        if moved.isEmpty():
            return met.select("word", "to")
        links = met.select("word", "to")
    return links
