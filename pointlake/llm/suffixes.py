"""Operator 2: removing repeated passages by sorting suffixes, deep-shallow.

Every byte that lies in a `length`-byte string which also starts in a document with a smaller
doc_id goes. Which strings those are is found in scans of the whole texts, dealt out in
batches of documents (a bucketed table, so that no scan shuffles the texts again):

1. Anchors. In each string of `length` bytes the k-mer of least hash is its anchor. Equal
   strings have equal anchors at equal places, so only anchors that occur twice matter.
   Batches send the distinct hashes of their anchors, packed by bucket; buckets return those
   that two batches have.
2. Strings. The suffix of a repeated anchor starts where the first string that the anchor
   stands for starts and ends where the last one ends. A batch sorts its own suffixes
   deep-shallow: multikey quicksort on super-characters of eight bytes down to a shallow
   depth, then blind tries for groups that still agree. What equals something of a smaller
   doc_id of the batch is marked; of equal strings one of the smallest doc_id goes on. Their
   hashes go out like those of the anchors.
3. Suffixes. Only suffixes that hold a string which another batch has as well are sent, one of
   each kind and batch, to the bucket of their anchor and of half of what lies beside it.
   There they are sorted the same way, and each is answered which of its strings have a
   smaller doc_id. Other occurrences in the same document follow the one that was sent.
4. Removal. Marks meet their batch again, are merged to runs, and the rest is kept.

All anchors go one way, however often they occur: a passage that a third of all documents
hold is one suffix a batch, and the differing texts around it are sent only if they repeat.
Comparison is always of bytes; hashes only choose what to compare. Work follows the text plus
the repeated part of it.

Edge cases: null texts are empty; texts shorter than `length` stay whole; a null doc_id counts
as larger than all others (such rows lose what others hold, never each other's); rows with
equal doc_ids don't remove from each other; runs may end inside a UTF-8 character, so what is
kept is bytes.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointlake.llm.common import catalogued, doc_slices, fields, free_shuffles, give_back, materialise, mix64, pack_rest, powers, prefix_hash, shared_path, text_buffer

_SLICE = 1 << 16  # suffixes that are compared at once
_NO_ID = np.iinfo(np.int64).max
_SHALLOW = 2  # super-characters of eight bytes that the quicksort looks at


# --- deep-shallow sorting ---------------------------------------------------------------


def deep_shallow(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of equally long byte strings, and of each sorted one whether it differs from the one before.

    rows: n x width bytes. First each group is split by its next super-character, as multikey
    quicksort does; groups that agree to the shallow depth go on to blind tries.
    """
    n, width = rows.shape
    wide = -(-width // 8) * 8
    if width < wide:
        rows = np.pad(rows, ((0, 0), (0, wide - width)))
    keys = np.ascontiguousarray(rows).view(">u8").astype(np.uint64)
    order = np.argsort(keys[:, 0], kind="stable") if n else np.zeros(0, np.int64)
    new = np.ones(n, bool)
    new[1:] = keys[order[1:], 0] != keys[order[:-1], 0]
    for depth in range(1, min(_SHALLOW, wide // 8)):
        order, new = _split(order, new, keys[:, depth])
    if wide // 8 > _SHALLOW:
        order, new = _blind_tries(order, new, keys, _SHALLOW)
    return order, new


def _tied(new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in groups of two or more, and the number of each place's group."""
    group = np.cumsum(new) - 1
    places = np.flatnonzero(np.bincount(group, minlength=1)[group] > 1)
    return places, group[places]


def _split(order: np.ndarray, new: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Split every tied group by one more super-character."""
    places, group = _tied(new)
    if len(places):
        k = key[order[places]]
        by = np.lexsort((k, group))
        order, new = order.copy(), new.copy()
        order[places] = order[places][by]
        k = k[by]
        new[places[1:]] |= k[1:] != k[:-1]
    return order, new


def _blind_tries(order: np.ndarray, new: np.ndarray, keys: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Order tied groups by tries that look at branching super-characters only.

    A node of a group's trie skips to the first place where its members differ, branches
    there, and its children go on behind it. All groups' tries are descended together.
    """
    width = keys.shape[1]
    places, group = _tied(new)
    while len(places):
        members = keys[order[places]]
        first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        leader = np.repeat(first, np.diff(np.append(first, len(group))))
        unlike = members[:, depth:] != members[leader, depth:]
        skip = np.where(unlike.any(1), unlike.argmax(1), width)
        branch = np.minimum.reduceat(skip, first)  # the node's first branching place, by group
        open_ = np.repeat(branch < width, np.diff(np.append(first, len(group))))
        places, group, members = places[open_], group[open_], members[open_]
        if not len(places):
            break
        at = np.repeat(branch, np.diff(np.append(first, len(open_))))[open_] + depth
        k = members[np.arange(len(members)), at]
        by = np.lexsort((k, group))
        order, new = order.copy(), new.copy()
        order[places] = order[places][by]
        k = k[by]
        new[places[1:]] |= (k[1:] != k[:-1]) & (group[1:] == group[:-1])
        places, group = _tied(new)
        # groups that agree to the end leave here, as they have no branching place left
    return order, new


def least_of_equals(rows: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of the rows, run number of each sorted one, and the smallest id of each run."""
    order, new = deep_shallow(rows)
    run = np.cumsum(new) - 1
    least = np.minimum.reduceat(ids[order], np.flatnonzero(new)) if len(order) else ids
    return order, run, least


# --- anchors ------------------------------------------------------------------------------


def anchor_size(length: int) -> int:
    """Bytes of an anchor: most of a string, so that few anchors repeat by chance."""
    return max(length * 16 // 25, length - 60)


def anchors(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document number, place and hash of every anchor: of each window the k-mers of least hash."""
    k = anchor_size(length)
    docs, places, hashes = [], [], []
    for i, j in doc_slices(offsets, 1 << 19):
        lo, part = offsets[i], data[offsets[i] : offsets[j]]
        kmers = len(part) - k + 1
        windows = len(part) - length + 1
        if windows < 1:
            continue
        prefix = prefix_hash(part)
        _, down = powers(kmers)
        h = np.maximum(mix64((prefix[k:] - prefix[:kmers]) * down), np.uint64(1))
        span = length - k + 1
        best = _sliding(h, span, np.minimum)
        # only windows that lie within one document choose
        ends, starts = offsets[i + 1 : j + 1] - lo, offsets[i:j] - lo
        inside = np.zeros(windows + 1, np.int64)
        ok = ends - starts >= length
        np.add.at(inside, starts[ok], 1)
        np.add.at(inside, ends[ok] - length + 1, -1)
        best[np.cumsum(inside[:-1]) == 0] = 0
        # a k-mer is the least of some window if the largest least of its windows is its own hash
        edge = np.zeros(span - 1, np.uint64)
        at = np.flatnonzero(_sliding(np.concatenate([edge, best, edge]), span, np.maximum) == h)
        docs.append(i + np.searchsorted(ends, at, "right"))
        places.append(at + lo)
        hashes.append(h[at])
    if not docs:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(docs), np.concatenate(places), np.concatenate(hashes)


def own_windows(
    of: np.ndarray, doc: np.ndarray, place: np.ndarray, h: np.ndarray, offsets: np.ndarray, length: int
) -> tuple[np.ndarray, np.ndarray]:
    """Of the anchors numbered `of` the least and largest shift (place less the window's start) of the windows they stand for.

    A window belongs to its anchor of least hash, the leftmost of equals, so it counts once.
    """
    side = length - anchor_size(length)
    low = np.maximum(0, place[of] + length - offsets[doc[of] + 1])
    high = np.minimum(side, place[of] - offsets[doc[of]])
    for step in (-1, 1):
        todo = np.arange(len(of))
        for d in range(1, side + 1):
            todo = todo[(of[todo] + step * d >= 0) & (of[todo] + step * d < len(place))]
            me, other = of[todo], of[todo] + step * d
            gap = np.abs(place[other] - place[me])
            near = (gap <= side) & (doc[other] == doc[me])
            todo, me, other, gap = todo[near], me[near], other[near], gap[near]
            if not len(todo):
                break
            wins = h[other] <= h[me] if step < 0 else h[other] < h[me]
            if step < 0:
                high[todo[wins]] = np.minimum(high[todo[wins]], gap[wins] - 1)
            else:
                low[todo[wins]] = np.maximum(low[todo[wins]], side - gap[wins] + 1)
            todo = todo[~wins]  # the nearest one that wins decides
    return low, high


def _sliding(values: np.ndarray, span: int, of: np.ufunc) -> np.ndarray:
    """The least (or largest) of each run of `span` values, by doubling."""
    have = 1
    while have < span:
        step = min(have, span - have)
        values = of(values[: len(values) - step], values[step:])
        have += step
    return values


def _distinct(x: np.ndarray) -> np.ndarray:
    """The sorted distinct values (by sorting: quicker here than by hashing)."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def _found(x: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Which of x are among the sorted values."""
    if not len(ordered):
        return np.zeros(len(x), bool)
    return ordered[np.minimum(np.searchsorted(ordered, x), len(ordered) - 1)] == x


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64)


def _key(h: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket and 32 bits of a hash, which is what batches tell each other."""
    return (_bucket(h, buckets).astype(np.uint64) << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF))


def _contexts(padded: np.ndarray, place: np.ndarray, low: np.ndarray, high: np.ndarray, length: int) -> np.ndarray:
    """The bytes from `side` before each anchor to `side` behind it; zero outside its own windows.

    padded: the batch's bytes with `side` zeros at both ends.
    """
    side = length - anchor_size(length)
    rows = np.lib.stride_tricks.sliding_window_view(padded, length + side)[place]
    column = np.arange(length + side)
    return rows * ((column >= (side - high)[:, None]) & (column < (side - low + length)[:, None]))


def _string_hashes(rows: np.ndarray, length: int) -> np.ndarray:
    """Of each row of contexts the hashes of its strings; column s is that of shift s."""
    side = rows.shape[1] - length
    up, down = powers(rows.shape[1] + 1)
    total = np.zeros((len(rows), rows.shape[1] + 1), np.uint64)
    np.cumsum((rows.astype(np.uint64) + np.uint64(1)) * up[:-1], axis=1, out=total[:, 1:])
    first = np.arange(side, -1, -1)
    return mix64((total[:, first + length] - total[:, first]) * down[first])


def _runs(doc: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Union of ranges by document: overlapping and touching ones become one."""
    if not len(doc):
        return doc, start, stop
    by = np.lexsort((start, doc))
    doc, start, stop = doc[by], start[by], stop[by]
    base = doc.astype(np.int64) << 40
    reach = np.maximum.accumulate(base + stop)
    fresh = np.ones(len(doc), bool)
    fresh[1:] = base[1:] + start[1:] > reach[:-1]
    first = np.flatnonzero(fresh)
    return doc[first], start[first], reach[np.append(first[1:], len(doc)) - 1] - base[first]


def _spread(mask: np.ndarray, side: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, shift) of every bit that is set."""
    parts = [np.flatnonzero(mask >> s & 1) for s in range(side + 1)]
    return np.concatenate(parts), np.repeat(np.arange(side + 1), [len(p) for p in parts])


def _bits(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """A mask of the shifts from low to high."""
    return np.where(high >= low, (np.int64(1) << (high + 1)) - (np.int64(1) << low), 0)


# --- a batch ------------------------------------------------------------------------------


def _batch(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, offsets and doc_ids of a batch's rows."""
    open_ = zstandard.ZstdDecompressor().decompress
    bodies = [open_(x) for x in frame["body"]]
    offsets = np.concatenate([[0], np.cumsum([len(b) for b in bodies], dtype=np.int64)])
    return np.frombuffer(b"".join(bodies), np.uint8), offsets, frame["id"].to_numpy(np.int64)


def _with_lead(docs: DataFrame) -> DataFrame:
    """docs and `lead`: the least hash of the text's k-mers that start at some bytes, equal for most near copies."""
    names, k = docs.columns, 32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column("text"))
            lead = np.full(batch.num_rows, np.iinfo(np.uint64).max, np.uint64)
            for i, j in doc_slices(offsets, 1 << 19):
                part = data[offsets[i] : offsets[j]]
                at = np.flatnonzero(part[: max(len(part) - k + 1, 0)] & 7 == 0)
                doc = i + np.searchsorted(offsets[i + 1 : j + 1] - offsets[i], at, "right")
                fits = at + k <= offsets[doc + 1] - offsets[i]
                at, doc = at[fits], doc[fits]
                prefix = prefix_hash(part)
                h = mix64((prefix[at + k] - prefix[at]) * powers(len(prefix))[1][at])
                first = np.flatnonzero(np.diff(doc, prepend=-1))
                if len(first):
                    lead[doc[first]] = np.minimum.reduceat(h, first)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lead.view(np.int64))], [*names, "lead"])
            give_back()

    return docs.mapInArrow(run, fields(docs.schema, "lead long"))


def _packed(docs: DataFrame) -> DataFrame:
    """docs with `text` replaced by `body`: the UTF-8 bytes, compressed, so that they travel small."""
    names = [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            data, offsets = text_buffer(batch.column("text"))
            whole = data.tobytes()
            body = [pack(whole[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(body, pa.binary())], [*names, "body"])
            give_back()

    return docs.mapInArrow(run, fields(docs.schema, "body binary", "text"))


@dataclass
class Slice:
    """What a batch knows of some of its repeated anchors before it hears of the other batches.

    Suffixes are numbered by `who` (places in the batch's anchors). `alive` are those with
    strings to be compared elsewhere, `mask` which shifts; of equal strings of the batch only
    one of the smallest doc_id is alive, all of a larger doc_id are `gone`, and the others of
    the same doc_id follow the one that is alive: by shift (`twins`) or whole (`copies`).
    """

    who: np.ndarray
    rows: np.ndarray
    alive: np.ndarray
    mask: np.ndarray
    gone: tuple[np.ndarray, np.ndarray]  # suffix, mask
    twins: tuple[np.ndarray, np.ndarray, np.ndarray]  # suffix, shift, the suffix it follows
    copies: tuple[np.ndarray, np.ndarray]  # suffix, the suffix it follows


def _first_of_run(order: np.ndarray, run: np.ndarray, is_least: np.ndarray) -> np.ndarray:
    """For each sorted row the first row of its run that has the run's smallest id."""
    at = np.flatnonzero(is_least)
    _, where = np.unique(run[at], return_index=True)
    return order[at[where]][run]


def _compare_within(rows: np.ndarray, who: np.ndarray, h: np.ndarray, ids: np.ndarray, low: np.ndarray, high: np.ndarray, length: int) -> Slice:
    """Whole suffixes first, then, where an anchor has several, their strings shift by shift."""
    side = rows.shape[1] - length
    order, run, least = least_of_equals(np.hstack([rows, np.column_stack([low, high]).astype(np.uint8)]), ids)
    later = ids[order] > least[run]
    first = _first_of_run(order, run, ~later)
    copy = ~later & (first != order)
    full = _bits(low, high)
    gone = [(order[later], full[order[later]])]
    copies = order[copy], first[copy]
    alive = np.sort(order[~later & ~copy])
    mask = full[alive]
    _, kind, n = np.unique(h[alive], return_inverse=True, return_counts=True)
    several = n[kind] > 1
    twins = []
    for s in range(side + 1):
        at = np.flatnonzero(several & ((mask >> s & 1) == 1))
        if len(at) < 2:
            continue
        order, run, least = least_of_equals(rows[alive[at], side - s : side - s + length], ids[alive[at]])
        later = ids[alive[at[order]]] > least[run]
        first = _first_of_run(order, run, ~later)
        twin = ~later & (first != order)
        gone.append((alive[at[order[later]]], np.full(later.sum(), np.int64(1) << s)))
        twins.append((alive[at[order[twin]]], np.full(twin.sum(), s), alive[at[first[twin]]]))
        mask[at[order[later | twin]]] &= ~(np.int64(1) << s)
    joined = lambda parts, n: tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64),) * n
    return Slice(who, rows, alive[mask != 0], mask[mask != 0], joined(gone, 2), joined(twins, 3), copies)


def _slices(data: np.ndarray, offsets: np.ndarray, ids: np.ndarray, known: np.ndarray, buckets: int, length: int) -> Iterator[tuple[Slice, tuple[np.ndarray, ...]]]:
    """The batch's suffixes whose anchors other places have as well, some anchors at a time.

    With each slice (doc, place, h) of all anchors. Anchors of one hash stay together.
    """
    doc, place, h = anchors(data, offsets, length)
    by = np.argsort(h)
    again = np.zeros(len(h) + 1, bool)  # of sorted anchors: equal to the one before
    again[1:-1] = h[by[1:]] == h[by[:-1]]
    elsewhere = np.zeros(len(h), bool)
    elsewhere[by] = _found(_key(h[by], buckets), known)
    by = by[again[:-1] | again[1:] | elsewhere[by]]
    low, high = own_windows(by, doc, place, h, offsets, length)
    by, low, high = by[low <= high], low[low <= high], high[low <= high]
    side = length - anchor_size(length)
    padded = np.concatenate([np.zeros(side, np.uint8), data, np.zeros(side, np.uint8)])
    at = 0
    while at < len(by):
        stop = min(at + _SLICE, len(by))
        while stop < len(by) and stop < at + 4 * _SLICE and h[by[stop]] == h[by[stop - 1]]:
            stop += 1
        who = by[at:stop]
        rows = _contexts(padded, place[who], low[at:stop], high[at:stop], length)
        own = _compare_within(rows, who, h[who], ids[doc[who]], low[at:stop], high[at:stop], length)
        go = elsewhere[who[own.alive]]  # a string that another batch has has an anchor there
        yield replace(own, alive=own.alive[go], mask=own.mask[go]), (doc, place, h)
        at = stop


def _by_bucket(at: np.ndarray, values: np.ndarray, batch: int) -> pd.DataFrame:
    """A row for each bucket that gets something."""
    by = np.argsort(at)
    at, values = at[by], values[by]
    cut = np.flatnonzero(np.diff(at, prepend=-1))
    packed = [x.tobytes() for x in np.split(values, cut[1:])] if len(cut) else []
    return pd.DataFrame({"bucket": at[cut].astype(np.int32), "batch": np.full(len(cut), batch, np.int32), "packed": packed})


def _hashes_by_bucket(h: np.ndarray, batch: int, buckets: int) -> pd.DataFrame:
    h = _distinct(h)
    return _by_bucket(_bucket(h, buckets), (h & np.uint64(0xFFFFFFFF)).astype(np.uint32), batch)


def _seen_twice(frame: pd.DataFrame) -> pd.DataFrame:
    """A bucket of hashes: each batch gets back those of its own that another batch has as well."""
    give_back()
    own = [np.frombuffer(x, np.uint32) for x in frame["packed"]]
    every = np.sort(np.concatenate(own))  # each batch's are distinct
    shared = _distinct(every[1:][every[1:] == every[:-1]])
    back = pd.DataFrame({"batch": frame["batch"], "bucket": frame["bucket"], "packed": [x[_found(x, shared)].tobytes() for x in own]})
    return back[back["packed"].map(len) > 0]


def _keys_of(told: pd.DataFrame, role: int) -> np.ndarray:
    """The sorted keys that a batch was told in that role."""
    told = told[told["role"] == role]
    parts = [(np.uint64(b) << np.uint64(32)) | np.frombuffer(x, np.uint32).astype(np.uint64) for b, x in zip(told["bucket"], told["packed"], strict=True)]
    return np.sort(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def _suffix_type(length: int) -> np.dtype:
    side = length - anchor_size(length)
    return np.dtype([("h", "u8"), ("rid", "i8"), ("id", "i8"), ("place", "i8"), ("mask", "i8"), ("text", "u1", (length + side,))])


def _meet(frame: pd.DataFrame, length: int) -> pd.DataFrame:
    """A bucket of suffixes: what batches have to remove, (rid, place, mask), packed by batch."""
    give_back()
    own = [np.frombuffer(zstandard.decompress(x), _suffix_type(length)) for x in frame["packed"]]
    batch = np.repeat(frame["batch"].to_numpy(np.int64), [len(x) for x in own])
    items = np.concatenate(own)
    ids, mask, text = items["id"], items["mask"].copy(), items["text"]
    removed = np.zeros(len(items), np.int64)
    order, run, least = least_of_equals(np.hstack([text, np.ascontiguousarray(mask).view(np.uint8).reshape(len(mask), 8)]), ids)
    later = order[ids[order] > least[run]]
    removed[later] = mask[later]
    mask[later] = 0
    # of equal suffixes those of the smallest doc_id stay to be compared string by string
    left = np.flatnonzero(mask)
    _, kind, n = np.unique(items["h"][left], return_inverse=True, return_counts=True)
    left = left[n[kind] > 1]
    side = text.shape[1] - length
    for s in range(side + 1):
        at = left[(mask[left] >> s & 1) == 1]
        if len(at) > 1:
            order, run, least = least_of_equals(text[at, side - s : side - s + length], ids[at])
            removed[at[order[ids[at[order]] > least[run]]]] |= np.int64(1) << s
    at = np.flatnonzero(removed)
    out = _by_bucket(batch[at], np.column_stack([items["rid"][at], items["place"][at], removed[at]]), 0)
    return pd.DataFrame({"batch": out["bucket"], "role": np.int32(_REPLY), "packed": out["packed"]})


_RANGE, _REPLY, _TWIN, _COPY, _SUFFIX = range(5)  # what a packed value is


#: What a row counts besides its text.
ROW_BYTES = 64


def repeated_spans(docs: DataFrame, length: int = 50, batch_bytes: int = 16 << 20, least_batches: int = 12) -> tuple[DataFrame, DataFrame]:
    """(the batched rows, what to remove from them) of docs (doc_id, text, and anything in __rest).

    The rows have batch, rid, id, no_id, none, body and __rest; the second table, for remove_ranges(), batch, role, packed.
    """
    spark = docs.sparkSession
    side = length - anchor_size(length)
    if not 1 <= side <= 60:
        raise ValueError("length must be 8 bytes or more")
    # texts with much in common go to one batch, which then sends what they share once; a group of
    # such texts that is large for a batch is dealt out over several
    size = F.octet_length(F.coalesce("text", F.lit(""))).cast("long") + ROW_BYTES  # so that very many empty texts are dealt out as well
    groups = materialise(_with_lead(docs.select("text")).groupBy("lead").agg(F.sum(size).alias("n")), "passage-groups")
    total = groups.agg(F.sum("n")).first()[0] or 0
    batches = max(least_batches, -(-total // batch_bytes))  # by the data alone: batches tell each other through as many buckets
    files = -(-batches // 2)
    part = max(1, min(batch_bytes, total // batches) // 8)
    large = groups.where(F.col("n") > part).select(F.col("lead").alias("__lead"), F.ceil(F.col("n") / part).alias("__parts"))
    rows = _with_lead(docs.withColumn("rid", F.monotonically_increasing_id()))
    rows = rows.join(large, F.col("lead") == F.col("__lead"), "left").withColumn("__parts", F.coalesce("__parts", F.lit(1)))
    rows = rows.withColumn("batch", F.pmod(F.xxhash64("lead", F.pmod(F.xxhash64("rid"), F.col("__parts"))), F.lit(batches)).cast("int"))
    rows = rows.drop("lead", "__lead", "__parts")
    rows = rows.withColumn("id", F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID))).withColumn("no_id", F.col("doc_id").isNull())
    rows = rows.withColumn("none", F.col("text").isNull()).withColumn("digest", F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)))
    rows = _packed(rows.drop("doc_id"))
    table = f"passages_{uuid.uuid4().hex}"
    rows.repartition(files, "batch").write.bucketBy(files, "batch").option("path", shared_path(spark, "passages")).saveAsTable(table)
    catalogued(table)
    free_shuffles(spark)
    rows = spark.table(table)
    texts = rows.select("batch", "rid", "id", "body")
    # a copy of a text with a smaller doc_id goes whole, so it needn't be looked at
    least = rows.groupBy("digest").agg(F.min("id").alias("__least"), F.count(F.lit(1)).alias("__n")).where("__n > 1")
    least = least.select(F.col("digest").alias("__digest"), "__least")
    copied = rows.select("batch", "rid", "id", "digest").join(least, (F.col("digest") == F.col("__digest")) & (F.col("id") > F.col("__least")))
    copied = materialise(copied.select("batch", "rid"), "passage-copies")

    def anchors_of(frame: pd.DataFrame, without: pd.DataFrame) -> pd.DataFrame:
        give_back()
        frame = frame[~frame["rid"].isin(without["rid"])]
        batch = int(frame["batch"].iloc[0]) if len(frame) else 0
        data, offsets, _ = _batch(frame)
        return _hashes_by_bucket(anchors(data, offsets, length)[2], batch, batches)

    hashes, told = "bucket int, batch int, packed binary", "batch int, bucket int, packed binary"
    seen = texts.groupBy("batch").cogroup(copied.groupBy("batch")).applyInPandas(anchors_of, hashes)
    known = seen.groupBy("bucket").applyInPandas(_seen_twice, told).withColumn("role", F.lit(0)).withColumn("rid", F.lit(-1).cast("long"))
    known = known.unionByName(copied.withColumn("role", F.lit(2)), allowMissingColumns=True)
    known = materialise(known, "passage-anchors")

    def strings_of(frame: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        give_back()
        frame = frame[~frame["rid"].isin(known["rid"])]
        batch = int(frame["batch"].iloc[0]) if len(frame) else 0
        out = [np.zeros(0, np.uint64)]
        for own, _ in _slices(*_batch(frame), _keys_of(known, 0), batches, length):
            row, shift = _spread(own.mask, side)
            out.append(_string_hashes(own.rows[own.alive], length)[row, shift])
        return _hashes_by_bucket(np.concatenate(out), batch, batches)

    strings = texts.groupBy("batch").cogroup(known.groupBy("batch")).applyInPandas(strings_of, hashes)
    strings = strings.groupBy("bucket").applyInPandas(_seen_twice, told).withColumn("role", F.lit(1)).withColumn("rid", F.lit(-1).cast("long"))
    all_known = known.unionByName(strings)

    def suffixes_of(frame: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        give_back()
        batch = int(frame["batch"].iloc[0]) if len(frame) else 0
        whole = frame["rid"].isin(known["rid"])
        size = np.diff(_batch(frame[whole])[1])
        ranges = [np.column_stack([frame["rid"][whole].to_numpy()[size >= length], np.zeros((size >= length).sum(), np.int64), size[size >= length]])]
        frame, twins, copies, out = frame[~whole], [], [], []
        data, offsets, ids = _batch(frame)
        rid, shared = frame["rid"].to_numpy(np.int64), _keys_of(known, 1)
        for own, (doc, place, h) in _slices(data, offsets, ids, _keys_of(known, 0), batches, length):
            who = own.who
            at = place[who] - offsets[doc[who]]  # within the document
            row = rid[doc[who]]
            suffix, mask = own.gone
            n, shift = _spread(mask, side)
            gd, gs, ge = _runs(doc[who[suffix[n]]], at[suffix[n]] - shift, at[suffix[n]] - shift + length)
            ranges.append(np.column_stack([rid[gd], gs, ge]))
            # copies of a suffix lose what it has lost here; what it loses elsewhere they hear of later
            lost = np.zeros(len(who), np.int64)
            np.bitwise_or.at(lost, suffix, mask)
            suffix, lead = own.copies
            n, shift = _spread(lost[lead], side)
            ranges.append(np.column_stack([row[suffix[n]], at[suffix[n]] - shift, at[suffix[n]] - shift + length]))
            live = own.mask.copy()
            hashes = _string_hashes(own.rows[own.alive], length)
            n, shift = _spread(live, side)
            alone = ~_found(_key(hashes[n, shift], batches), shared)
            np.bitwise_and.at(live, n[alone], ~(np.int64(1) << shift[alone]))
            sent = np.zeros(len(who), np.int64)
            sent[own.alive] = live
            suffix, shift, lead_ = own.twins
            use = (sent[lead_] >> shift & 1) == 1
            suffix, shift, lead_ = suffix[use], shift[use], lead_[use]
            twins.append(np.column_stack([row[suffix], at[suffix], np.int64(1) << shift, row[lead_], at[lead_]]))
            waits = sent != 0
            waits[suffix] = True
            use = waits[lead]
            suffix, lead = own.copies[0][use], lead[use]
            copies.append(np.column_stack([row[suffix], at[suffix], row[lead], at[lead]]))
            # strings with half of the sides before the anchor meet by that half, the others by the one behind
            half = side // 2
            for part, of in ((_bits(np.int64(half), np.int64(side)), slice(side - half, length)), (_bits(np.int64(0), np.int64(half - 1)), slice(side, length + half))):
                go = own.alive[(live & part) != 0]
                items = np.zeros(len(go), _suffix_type(length))
                items["h"], items["rid"], items["id"], items["place"] = h[who[go]], row[go], ids[doc[who[go]]], at[go]
                items["mask"], items["text"] = (live & part)[(live & part) != 0], own.rows[go]
                key = mix64(_row_hash(own.rows[go][:, of]))
                sent_ = _by_bucket(_bucket(key, batches), items, batch)
                out.append(sent_.assign(role=_SUFFIX, packed=[zstandard.compress(x, 1) for x in sent_["packed"]]))
        for role, parts in ((_RANGE, ranges), (_TWIN, twins), (_COPY, copies)):
            packed = np.concatenate(parts).astype(np.int64) if parts else np.zeros(0, np.int64)
            out.append(pd.DataFrame({"bucket": [-1 - batch], "batch": [batch], "role": [role], "packed": [packed.tobytes()]})[: int(packed.size > 0)])
        return pd.concat(out)[["bucket", "batch", "role", "packed"]]

    def meet(frame: pd.DataFrame) -> pd.DataFrame:
        own = frame["role"] != _SUFFIX
        return frame[own][["batch", "role", "packed"]] if own.all() else _meet(frame, length)

    found = texts.groupBy("batch").cogroup(all_known.groupBy("batch")).applyInPandas(suffixes_of, "bucket int, batch int, role int, packed binary")
    return rows, found.groupBy("bucket").applyInPandas(meet, "batch int, role int, packed binary")


def _row_hash(rows: np.ndarray) -> np.ndarray:
    up, _ = powers(rows.shape[1])
    return ((rows.astype(np.uint64) + np.uint64(1)) * up).sum(1, dtype=np.uint64)


def _merged(key: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys with the union of their masks."""
    by = np.argsort(key, kind="stable")
    key, mask = key[by], mask[by]
    first = np.flatnonzero(np.diff(key, prepend=-1))
    return key[first], np.bitwise_or.reduceat(mask, first) if len(first) else mask


def _look_up(key: np.ndarray, keys: np.ndarray, masks: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.zeros(len(key), np.int64)
    at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
    return np.where(keys[at] == key, masks[at], 0)


def ranges_to_remove(told: pd.DataFrame, row_of: pd.Series, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, stop), merged, from everything that a batch was told; row_of gives the row of a rid."""
    side = length - anchor_size(length)

    def all_of(role: int, width: int) -> np.ndarray:
        parts = [np.frombuffer(x, np.int64).reshape(-1, width) for x in told["packed"][told["role"] == role]]
        return np.concatenate(parts) if parts else np.zeros((0, width), np.int64)

    at = lambda rid, place: (row_of.loc[rid].to_numpy(np.int64) << 40) + place
    reply, twin, copy, range_ = all_of(_REPLY, 3), all_of(_TWIN, 5), all_of(_COPY, 4), all_of(_RANGE, 3)
    keys, masks = _merged(at(reply[:, 0], reply[:, 1]), reply[:, 2])
    bit = _look_up(at(twin[:, 3], twin[:, 4]), keys, masks) & twin[:, 2]
    keys, masks = _merged(np.concatenate([keys, at(twin[:, 0], twin[:, 1])]), np.concatenate([masks, bit]))
    more = _look_up(at(copy[:, 2], copy[:, 3]), keys, masks)
    keys, masks = _merged(np.concatenate([keys, at(copy[:, 0], copy[:, 1])]), np.concatenate([masks, more]))
    n, shift = _spread(masks, side)
    place = (keys[n] & ((1 << 40) - 1)) - shift
    rows = row_of.loc[range_[:, 0]].to_numpy(np.int64)
    return _runs(np.concatenate([rows, keys[n] >> 40]), np.concatenate([range_[:, 1], place]), np.concatenate([range_[:, 2], place + length]))


OUTPUTS = ("n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept", "text")


def remove_repeats(docs: DataFrame, length: int = 50, keep: bool = True, **options: int) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans, kept, text (both null unless keep) and the other columns.

    A row for each row of docs. `kept` is what remains of the bytes, `text` the same as text:
    parts of characters that a cut left are dropped, and a null text stays null. Other columns
    of docs that are called like one of these give way.
    """
    others = [c for c in docs.columns if c not in ("doc_id", *OUTPUTS)]
    rows, told = repeated_spans(pack_rest(docs.select("doc_id", "text", *[F.col(f"`{c}`") for c in others]), "doc_id", "text"), length, **options)
    told = materialise(told, "passage-ranges")  # small; the shuffled strings go before the texts are shuffled

    def cut(frame: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        give_back()
        frame = frame.reset_index(drop=True)
        d, start, stop = ranges_to_remove(told, pd.Series(frame.index, index=frame["rid"]), length)
        at = np.searchsorted(d, np.arange(len(frame) + 1))
        out, open_ = [], zstandard.ZstdDecompressor().decompress
        for k, (body, none) in enumerate(zip(map(open_, frame["body"]), frame["none"], strict=True)):
            starts, stops = start[at[k] : at[k + 1]].tolist(), stop[at[k] : at[k + 1]].tolist()
            rest = b"".join(body[a:b] for a, b in zip([0, *stops], [*starts, len(body)], strict=True))
            spans = [{"start": a, "stop": b} for a, b in zip(starts, stops, strict=True)]
            out.append((len(body), len(body) - len(rest), len(spans), hashlib.sha256(rest).hexdigest(), spans, rest if keep else None, rest.decode("utf-8", "ignore") if keep and not none else None))
        got = pd.DataFrame(out, columns=[*OUTPUTS])
        return pd.concat([frame[["rid", "id", "no_id"]], got], axis=1)

    kind = "rid long, id long, no_id boolean, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start: long, stop: long>>, kept binary, text string"
    got = rows.select("batch", "rid", "id", "no_id", "body", "none").groupBy("batch").cogroup(told.groupBy("batch")).applyInPandas(cut, kind)
    if others:
        got = got.join(rows.select(F.col("rid").alias("__rid"), "__rest"), F.col("rid") == F.col("__rid"))
    doc_id = F.when(~F.col("no_id"), F.col("id")).cast(docs.schema["doc_id"].dataType).alias("doc_id")
    return got.select(doc_id, *OUTPUTS, *[F.col("__rest")[c].alias(c) for c in others])
