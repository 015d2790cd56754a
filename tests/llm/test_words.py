"""Operators 11 to 13 against plain versions, and their edge cases."""

import re
import zlib
from collections import Counter
from itertools import permutations

import duckdb
import numpy as np
import pytest

from pointlake.llm.audit import AUDIT_SQL, audit_filters
from pointlake.llm.licenses import PHRASES, TEMPLATES, scan_licenses, scan_sql
from pointlake.llm.queries import QUERIES
from pointlake.llm.spelling import WaveletTree, follow, near_words, spelling_variants

SMALL_DIR = "/root/testdata/sf0.001"
LETTERS = re.compile("[A-Za-zÀ-ÿ]+")


def small_ascii(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text)


def near(a, b):
    """Exactly one edit apart."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants(rows, factor=5):
    counts = Counter()
    for doc_id, text in rows:
        for run in LETTERS.findall(text or ""):
            run = small_ascii(run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    out = {}
    for w, n in words.items():
        others = [x for x in words if near(w, x)]
        top = min(others, key=lambda x: (-words[x], x), default=None)
        form = top if top is not None and words[top] >= factor * n else None
        out[w] = (n, len(others), form, words[form] if form else None)
    for w in words:
        root = w
        while out[root][2]:
            root = out[root][2]
        out[w] = (*out[w][:4], root)
    return out


def got_variants(df):
    return {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in df.collect()}


def test_wavelet_tree():
    rng = np.random.default_rng(0)
    for n in (1, 2, 3, 64, 100):
        values = rng.permutation(n)
        tree = WaveletTree(values)
        left, right, low, high = (rng.integers(0, n + 1, 50) for _ in range(4))
        who, value = tree.report(left, right, low, high)
        want = sorted((i, v) for i in range(50) for v in values[left[i] : right[i]] if low[i] <= v < high[i])
        assert sorted(zip(who.tolist(), value.tolist())) == want


@pytest.mark.parametrize("piece_rows", [30_000, 7])
def test_near_words(spark, piece_rows):
    """All pairs, once in each direction, also where halves are cut into pieces."""
    rng = np.random.default_rng(1)
    words = {"".join(rng.choice(list("abé"), rng.integers(6, 10))) for _ in range(400)} | {"aaaaaa", "aaaaaaa", "b" * 3000, "b" * 2999, "b" * 2999 + "a"}
    df = spark.createDataFrame([(w, 10) for w in sorted(words)], "word string, n long")
    got = sorted((r.word, r.near) for r in near_words(df, 6, task_rows=300, piece_rows=piece_rows).collect())
    assert got == sorted((a, b) for a in words for b in words if near(a, b))


def test_variants_on_documents(spark):
    docs = spark.read.parquet(f"{SMALL_DIR}/documents.parquet").select("doc_id", "text")
    got = got_variants(QUERIES["op12_spelling_variants"](spark, SMALL_DIR))
    assert got == variants([tuple(r) for r in docs.collect()]) and got


def test_variants_edge_cases(spark, odd_docs, no_docs):
    chain = [(i, "colour " * 200 + "colours " * 30 + "colourss " * 5 + "colouss " * 6 + "STRASSE strasse ÀPRÈSMIDI Àprèsmidi ", "x") for i in range(3)]
    extra = spark.createDataFrame([*chain, (None, "colours " * 40, "y")], "doc_id long, text string, word string")
    for df in (odd_docs, extra, extra.union(extra)):
        assert got_variants(spelling_variants(df)) == variants([(r.doc_id, r.text) for r in df.collect()])
    assert spelling_variants(no_docs).count() == 0
    assert spelling_variants(odd_docs.where("text IS NULL OR text = ''")).count() == 0


def test_follow(spark):
    links = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(21)] + [("u", "w5")], "word string, to string")
    assert {r.word: r.to for r in follow(links).collect()} == {**{f"w{i}": "w21" for i in range(21)}, "u": "w21"}


def audit(rows, labels):
    """Every order applied row by row."""
    texts = {}
    for i, t, _ in rows:
        if i is not None:
            texts[t or ""] = min(i, texts.get(t or "", i))
    marked = {}
    for i, q, t in labels:
        if i is not None:
            old = marked.get(i, (0, 0))
            marked[i] = (max(old[0], q or 0), max(old[1], t or 0))
    told = []
    for i, t, s in rows:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
            "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and texts[t] < i,
        }
        told.append((s or "", {f for f in fails if fails[f]}, *marked.get(i, (0, 0))))
    out, shapley = {}, Counter()
    for order in permutations("ABCDE"):
        left = list(told)
        for k, f in enumerate(order):
            for part in {t[0] for t in told}:
                here = [t for t in left if t[0] == part and f in t[1]]
                own = [t for t in told if t[0] == part]
                out[part, "".join(order), k + 1] = [
                    sum(t[0] == part for t in left) - len(here), len(here), sum(f in t[1] for t in own) - len(here),
                    sum(t[1] == {f} for t in own), sum(t[2] == 1 for t in here), sum(t[3] == 1 for t in here), (part, f),
                ]
                shapley[part, f] += len(here)
            left = [t for t in left if f not in t[1]]
    return {k: (*v[:-1], shapley[v[-1]]) for k, v in out.items()}


def got_audit(df):
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in df.collect()}


def test_audit(spark, odd_docs, no_docs):
    good = " ".join(f"word{i}" for i in range(60))
    more = [(20 + i, t, "en", s, 1, i, "x", 1, "y", 0.5) for i, (t, s) in enumerate([(good, "a"), (good, "b"), (good + " $", "a"), (good.upper(), None), ("x " * 80, ""), (good, "a"), (None, "a"), ("", "c")])]
    docs = odd_docs.union(spark.createDataFrame(more, odd_docs.schema)).union(odd_docs.where("doc_id = 9"))
    labels = [(1, 1, 0), (20, 1, 1), (20, 0, 0), (21, None, 1), (22, 1, None), (None, 1, 1), (7, 0, 1), (99, 1, 1)]
    marks = spark.createDataFrame([(*x, 3) for x in labels], "doc_id long, quality int, toxic int, part int")
    got = got_audit(audit_filters(docs, marks))
    assert got == audit([(r.doc_id, r.text, r.source) for r in docs.collect()], labels)
    assert audit_filters(no_docs, marks).count() == 0
    assert {k: v[4:6] for k, v in got_audit(audit_filters(docs, marks.limit(0))).items()} == dict.fromkeys(got, (0, 0))


def test_audit_and_scan_against_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL_DIR}/{t}.parquet')")
    for name, sql in (("op11_filter_audit", AUDIT_SQL), ("op13_license_scan", scan_sql())):
        df = QUERIES[name](spark, SMALL_DIR)
        assert sorted(map(str, con.execute(f"SELECT {', '.join(df.columns)} FROM ({sql})").fetchall())) == sorted(str(tuple(r)) for r in df.collect())


def scan(rows, threshold=0.8):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", small_ascii(t or ""))
    out = []
    for doc_id, text in rows:
        words = split(text)
        hits = [(i, label) for p, label in PHRASES for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
        base, found, share = {h[1] for h in hits}, set(), 0.0
        for label, template in TEMPLATES:
            t = split(template)
            for b in range(max(1, -(-len(words) // len(t)) - 1)):
                held = len(set(t) & set(words[b * len(t) : (b + 2) * len(t)])) / len(set(t))
                if held >= threshold:
                    found.add(label)
                    share = max(share, held)
        places = [h[0] for h in hits]
        out.append((doc_id, len(words), len(hits), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | found)), 1.0 if hits else share))
    return out


def test_scan(spark, odd_docs, no_docs):
    mit, gpl = TEMPLATES[2][1], TEMPLATES[0][1]
    rng = np.random.default_rng(2)

    def without(text, share):
        return " ".join(w for w in text.split() if rng.random() > share)

    texts = ["cc by nc cc-by-nc CC BY NC", "Under the MIT License. under the mit license, version 2 apache license version 2", "fill " * 70 + mit + " fill" * 33, gpl.upper(), "Ünder the mit license"]
    texts += [("w " * int(rng.integers(0, 90))) + without(t, s) + " z" * int(rng.integers(0, 60)) for _, t in TEMPLATES for s in (0.05, 0.15, 0.25, 0.4) for _ in range(4)]
    more = spark.createDataFrame([(30 + i, t, "en", "a", 1, i, "x", 1, "y", 0.5) for i, t in enumerate([*texts, texts[0], texts[2]])], odd_docs.schema)
    docs = odd_docs.union(more).union(more.where("doc_id = 32")).union(more.where("doc_id = 30"))
    got = sorted((str(tuple(r)) for r in scan_licenses(docs).collect()))
    want = scan([(r.doc_id, r.text) for r in docs.collect()])
    assert got == sorted(map(str, want))
    assert sum(w[6] != w[5] for w in want) > 20 and sum(not w[6] for w in want) > 20
    assert scan_licenses(no_docs).count() == 0
