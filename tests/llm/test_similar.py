"""Near copies by five-word shingles, against brute force over all pairs."""

import numpy as np

from pointlake.llm import simhash
from pointlake.llm.simhash import fingerprint, similar_documents


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def components(sets, least):
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= least * (len(sets[i]) + len(sets[j]) - both) - 1e-9:
                root[find(i)] = find(j)
    return {frozenset(j for j in range(len(sets)) if find(j) == find(i)) for i in range(len(sets))}


def test_every_pair_from_the_similarity_up_is_linked(spark):
    """Appended, cut and scattered edits from 0.75 to 0.95, short and long texts, and a dense family."""
    rng = np.random.default_rng(8)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 10**6, n)]
    texts = []
    for n in (12, 30, 120, 600):
        for goal in (0.75, 0.79, 0.8, 0.81, 0.85, 0.9, 0.95):
            for _ in range(3):
                base = word(n)
                more = round((n - 4) * (1 / goal - 1))
                texts += [" ".join(base), " ".join(base + word(max(more, 1)))]
                base = word(n)
                texts += [" ".join(base), " ".join(base[: 4 + round((n - 4) * goal)])]
                base = word(n)
                changed = list(base)
                for at in rng.choice(n, max(1, round(n * (1 - goal) / (1 + goal) / 5)), replace=False):
                    changed[at] = "changed"
                texts += [" ".join(base), " ".join(changed)]
    base = word(80)
    for _ in range(40):  # members of a family differ by 0.6 to 1 from one another
        own = list(base)
        for at in rng.choice(80, 2, replace=False):
            own[at] = word(1)[0]
        texts.append(" ".join(own))
    texts += ["", "  \n", "one", "One", "one two"]
    want = components([shingles(t) for t in texts], 0.8)
    want = {g for g in want if texts[min(g)].split()} | {frozenset(i for i, t in enumerate(texts) if not t.split())}
    rows = similar_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).toPandas()
    got = {frozenset(g) for g in rows.groupby("group")["doc_id"].apply(list)}
    assert got == want


def test_near_copies_go_through_the_fingerprints(spark, monkeypatch):
    """Links within 3 bits come from operator 3's search and are checked by whole sets; the rest is found as well."""
    rng = np.random.default_rng(21)
    texts = []
    for n in (60, 400, 1500):
        for _ in range(6):
            base = [f"w{x}" for x in rng.integers(0, 10**6, n)]
            for at in (None, 0, n - 1, n // 2):
                own = list(base)
                if at is not None:
                    own[at] = f"w{rng.integers(0, 10**6)}"
                texts.append(" ".join(own))
            texts.append(" ".join(base + [f"w{x}" for x in rng.integers(0, 10**6, n // 6)]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    codes = [fingerprint(t, 3) % (1 << 64) for t in texts]
    sets = [shingles(t) for t in texts]
    linked, similar = set(), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    for a in range(len(texts)):
        linked |= {(a, b) for b in range(a) if (codes[a] ^ codes[b]).bit_count() <= 3 and similar(a, b)}
    searched, found = [], []
    search, checked = simhash.hamming_links, simhash._fingerprint_links

    def searching(of, *more, **named):
        searched.append([r.fp % (1 << 64) for r in of.collect()])
        return search(of, *more, **named)

    def finding(*given):
        links = checked(*given)
        found.extend(links.collect())  # its table goes with the scratch
        return links

    monkeypatch.setattr(simhash, "hamming_links", searching)
    monkeypatch.setattr(simhash, "_fingerprint_links", finding)
    rows = similar_documents(docs).toPandas()
    assert [sorted(s) for s in searched] == [sorted(set(codes))]
    doc_of = dict(zip(rows["rid"], rows["doc_id"], strict=True))
    pairs = {(max(p), min(p)) for p in ((doc_of[r.u], doc_of[r.v]) for r in found)}
    assert len(pairs) > 20 and pairs <= linked  # each within 3 bits and similar as a whole
    assert together(pairs) == together(linked)
    assert {frozenset(g) for g in rows.groupby("group")["doc_id"].apply(list)} == components(sets, 0.8)


def together(pairs):
    """The groups of what is paired."""
    groups = []
    for p in map(set, pairs):
        met = [g for g in groups if g & p]
        groups = [g for g in groups if not g & p] + [p.union(*met)]
    return {frozenset(g) for g in groups}
