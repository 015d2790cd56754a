"""Operators on documents: edge cases and brute force."""

import hashlib
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from pointlake.llm.language import fit_language, predict_language
from pointlake.llm.mixing import mix, mixed_documents, source_targets
from pointlake.llm.pieces import PieceModel, decode_ids, encode_texts
from pointlake.llm.quality import fit_quality, score_quality
from pointlake.llm.queries import PIECE_MODEL
from pointlake.llm.sharding import ShardTree, shard_documents
from pointlake.llm.simhash import keep_one_of_each, near_duplicates, plan_parts, similar_documents
from pointlake.llm.suffixes import deep_shallow, remove_repeats
from pointlake.llm.toxicity import fit_toxicity, score_toxicity

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def shares(sizes, weights, most=3):
    """Targets by filling up: the plain loop."""
    total, out, open_ = sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    while open_:
        level = (total - sum(out[i] for i in range(len(sizes)) if i not in open_)) / sum(weights[i] for i in open_)
        over = [i for i in open_ if level * weights[i] > most * sizes[i]]
        if not over:
            for i in open_:
                out[i] = level * weights[i]
            break
        for i in over:
            out[i] = most * sizes[i]
            open_.discard(i)
    return out


@pytest.mark.parametrize("sizes", [[100, 100, 100], [1, 1000, 5], [0, 10, 10], [5], [1, 1, 1, 1, 10_000]])
def test_targets_fill_up(spark, sizes):
    rows = spark.createDataFrame([(f"s{i}", s) for i, s in enumerate(sizes)], "source string, source_size long")
    got = {r.source: r.target for r in source_targets(rows).collect()}
    want = shares(sizes, [(1, 2, 3)[i % 3] for i in range(len(sizes))])
    assert np.allclose([got[f"s{i}"] for i in range(len(sizes))], want)


def test_mix(spark, odd_docs, no_docs):
    got = mix(odd_docs, block_words=64).collect()
    assert len(got) == odd_docs.count()
    again = mix(odd_docs, block_words=64).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    by_source = {}
    for r in got:
        assert 0 <= r.taken <= 3 * r.size and sum(d.words for d in r.draws) == r.taken
        assert r.size == (len(SPACE.findall(r_text(odd_docs, r.doc_id))) if r.doc_id else r.size)
        taken, target, size = by_source.get(r.source, (0, r.target, r.source_size))
        by_source[r.source] = (taken + r.taken, target, size)
    for taken, target, size in by_source.values():
        assert abs(taken - target) <= 1 and target <= 3 * size + 1e-9
    assert abs(sum(t for _, t, _ in by_source.values()) - sum(s for _, _, s in by_source.values())) < 1e-6
    assert mix(no_docs).collect() == []
    mixed = mixed_documents(odd_docs)
    assert mixed.columns == odd_docs.columns and mixed.count() > 0
    assert mixed_documents(no_docs).count() == 0


def r_text(docs, doc_id):
    return docs.where(F.col("doc_id") == doc_id).first().text or ""


def test_shards(spark, odd_docs, no_docs):
    docs = odd_docs.select("doc_id", "text").union(spark.range(100, 2100).select("id", F.lit("t")))
    got = shard_documents(docs).toPandas()
    assert len(got) == docs.count()
    for _, own in got.groupby("shard"):
        assert sorted(own["slot"]) == list(range(len(own)))
    moved = got[got["grown_shard"] != got["shard"]]
    assert set(moved["grown_shard"]) == {8} and 0.05 < len(moved) / len(got) < 0.18
    assert got["shard"].between(0, 7).all() and (got["law"] == "key").all()
    assert got.groupby(got["doc_id"].fillna(-1))["shard"].nunique().max() == 1
    assert shard_documents(no_docs).count() == 0
    hot = shard_documents(spark.range(3000).select(F.lit(5).cast("long").alias("doc_id"), F.col("id").cast("string").alias("text"))).toPandas()
    assert hot["shard"].nunique() == 1 and sorted(hot["slot"]) == list(range(3000))
    tree = ShardTree.balanced(4).with_shard(4, 2.0)
    heavy = spark.range(6000).select(tree.place(F.col("id")).alias("s")).groupBy("s").count().toPandas().set_index("s")["count"]
    assert 0.28 < heavy[4] / 6000 < 0.39


def brute_removal(rows, length=50):
    """What goes of each row, by a set of all strings of smaller ids."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0))
    seen, waiting, last, out = set(), [], object(), [None] * len(rows)
    for i in order:
        if rows[i][0] != last:
            for grams in waiting:
                seen |= grams
            waiting, last = [], rows[i][0]
        b = (rows[i][1] or "").encode()
        gone = np.zeros(len(b), bool)
        grams = {b[q : q + length] for q in range(len(b) - length + 1)}
        for q in range(len(b) - length + 1):
            if b[q : q + length] in seen:
                gone[q : q + length] = True
        waiting.append(grams)
        edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(int)])) == 1)
        out[i] = (rows[i][0], len(b), int(gone.sum()), len(edges), hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest())
    return sorted(out, key=str)


def test_removal(odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    got = remove_repeats(odd_docs)
    assert {"rid", "batch", "fp", "size"} <= set(got.columns) and {(r.rid, r.batch, r.fp, r.size) for r in got.collect()} == {(5, "b", 6, "s")}
    got = got.collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got), key=str) == brute_removal(rows)
    assert remove_repeats(no_docs.select("doc_id", "text")).count() == 0


@pytest.mark.parametrize("letters", ["ab", "abcd "])
def test_removal_of_shared_pieces(spark, letters):
    """Passages in any combination, runs of one letter, repeated and null doc_ids, copies with other doc_ids."""
    rng = np.random.default_rng(len(letters))
    bases = [*("".join(rng.choice(list(letters), 400)) for _ in range(6)), "a" * 300, "xy" * 150, "\0" * 200]
    rows = []
    for i in rng.permutation(120).tolist():
        text = "".join(bases[k][a : a + n] for k, a, n in zip(rng.integers(0, 9, 6), rng.integers(0, 300, 6), rng.integers(10, 120, 6), strict=True))
        i = i if i % 17 else (None if i % 2 else 34)
        rows.append((i, text))
        if i is not None:
            rows += [(i, text)] * (i % 11 == 0) + [(i + 1000, text)] * (i % 13 == 0)
    got = remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got), key=str) == brute_removal(rows)


def test_a_hot_line_goes_out_once_a_batch(spark):
    """A line in all of many documents, and a document that repeats it: few suffixes leave a batch."""
    from pointlake.llm.suffixes import repeated_spans

    line = "this very line stands in each and every document of the corpus, again and again and again"
    rng = np.random.default_rng(4)
    noise = lambda: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 60))
    rows = [(i, f"{noise()} {line} {noise()}") for i in range(600)] + [(700, " ".join([line] * 300))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = remove_repeats(docs).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got), key=str) == brute_removal(rows)
    _, told = repeated_spans(docs.withColumn("__rest", F.struct(F.lit(0).alias("none"))))
    replies = told.where("role = 1").agg(F.sum(F.length("packed") / 24)).first()[0]
    assert replies < 8 * 100  # 8 batches, and in each some letters of noise beside the line that repeat; not the 600 documents


def test_deep_shallow_sorts():
    rng = np.random.default_rng(1)
    rows = rng.integers(97, 99, (3000, 53)).astype(np.uint8)
    rows[500:1500, :45] = rows[0, :45]
    rows[2000:2600] = rows[7]
    order, new = deep_shallow(rows)
    listed = [r.tobytes() for r in rows]
    assert [listed[i] for i in order] == sorted(listed)
    assert new.sum() == len(set(listed))
    assert len(deep_shallow(rows[:0])[0]) == 0


def fingerprint_by_hand(text, words=3):
    parts = [w.lower() if w.isascii() else "".join(c.lower() if c.isascii() else c for c in w) for w in SPACE.findall(text or "")]
    if not parts:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(parts[i : i + words]).encode(), 42) for i in range(max(1, len(parts) - words + 1))]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def test_simhash(spark, odd_docs, no_docs):
    got = near_duplicates(odd_docs).collect()
    assert len(got) == odd_docs.count()
    fps = {r.doc_id: r.fp % (1 << 64) for r in got}
    for r in odd_docs.collect():
        assert fps[r.doc_id] == fingerprint_by_hand(r.text)
    parent = {f: f for f in fps.values()}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in fps.values():
        for b in fps.values():
            if (a ^ b).bit_count() <= 3:
                parent[find(a)] = find(b)
    for r in got:
        ids = [i for i, f in fps.items() if find(f) == find(fps[r.doc_id]) and i is not None]
        assert r.component_id == (min(ids) if ids else None)
    assert near_duplicates(no_docs).count() == 0
    one = near_duplicates(odd_docs.where("doc_id = 1")).collect()
    assert [(r.doc_id, r.component_id) for r in one] == [(1, 1)]


def test_pigeonhole_finds_all_links(spark):
    from pointlake.llm.simhash import Parts, hamming_links

    rng = np.random.default_rng(5)
    centres = rng.integers(0, 1 << 63, 40)
    codes = sorted({int(c) ^ sum(1 << int(b) for b in rng.integers(0, 64, k)) for c in centres for k in range(9)})
    codes = [c - (1 << 64) if c >= 1 << 63 else c for c in codes]
    df = spark.createDataFrame([(c,) for c in codes], "fp long")
    for radius, parts in ((3, None), (8, Parts(list(range(64)), [(0, 16, 2), (16, 16, 1), (32, 16, 1), (48, 16, 1)])), (3, Parts(list(range(64)), [(0, 20, 1), (20, 20, 0), (40, 24, 0)]))):
        got = [(r.u, r.v) for r in hamming_links(df, radius, parts).collect()]
        want = {(a, b) for a in codes for b in codes if a < b and ((a ^ b) % (1 << 64)).bit_count() <= radius}
        assert set(got) == want
    assert sum(w for _, w, _ in plan_parts(df).cuts) == 64


def test_similar_documents(spark, odd_docs, no_docs):
    rng = np.random.default_rng(2)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows = []
    for i in range(30):
        base = list(rng.choice(vocabulary, 300))
        for k in range(4):  # one word in three hundred changes: similarity over 0.9
            own = list(base)
            own[int(rng.integers(0, 300))] = f"new{i}x{k}"
            rows.append((i * 4 + k, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    groups = similar_documents(docs).toPandas().groupby("group")["doc_id"].apply(sorted).tolist()
    assert sorted(groups) == [[i * 4 + k for k in range(4)] for i in range(30)]
    kept = keep_one_of_each(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert 1 in ids and 2 not in ids and ids.count(7) == 1
    assert keep_one_of_each(no_docs).count() == 0


def test_pieces_round_trip(spark, odd_docs, no_docs):
    model = PieceModel.load(PIECE_MODEL)
    got = encode_texts(odd_docs, model, check=True)
    assert all(r.intact for r in got.collect()) and got.where("ids IS NULL").count() == 1
    back = {str(r.doc_id): r.text for r in decode_ids(got.select("doc_id", "ids"), model).collect()}
    assert back == {str(r.doc_id): r.text for r in odd_docs.collect()}
    assert encode_texts(no_docs, model).count() == 0


def best_path(model, text):
    """Score of the best segmentation, by the plain quadratic recursion."""
    chars = (" " + text).replace("▁", "\udfff").replace(" ", "▁")
    best = [0.0] + [float("-inf")] * len(chars)
    for end in range(1, len(chars) + 1):
        for start in range(max(0, end - model.longest), end):
            hit = model.prefixes.get(chars[start:end])
            if hit:
                best[end] = max(best[end], best[start] + hit[0])
        if not model.prefixes.get(chars[end - 1]):
            best[end] = max(best[end], best[end - 1] + model.unknown)
    return best[-1]


def test_pieces_take_the_best_path():
    model = PieceModel.load(PIECE_MODEL, paths=True)
    for text in ("the cat sat on the mat", "Unbelievable internationalization!", "a" * 120, "x1y2  z3", "élève 日本 ▁"):
        ids = model.encode(text)
        score, k = 0.0, 0
        ids = ids.tolist()
        byte = {int.from_bytes(b, "little") for b in model.byte_ids}
        pieces = {int.from_bytes(v[1], "little"): v[0] for v in model.prefixes.values() if v}
        while k < len(ids):
            if ids[k] in byte:
                first = model.text_of[ids[k]][0]
                k += 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
                score += model.unknown
            else:
                score += pieces[ids[k]]
                k += 1
        assert abs(score - best_path(model, text)) < 1e-6
        streamed = np.frombuffer(b"".join(model.stream([(" " + text).replace("▁", "\udfff").replace(" ", "▁")])), np.int32)
        assert streamed.tolist() == ids


def test_language(spark, odd_docs, no_docs):
    rng = np.random.default_rng(0)
    rows = [(i, " ".join("".join(rng.choice(list(a), 6)) for _ in range(30)), lang) for i in range(200) for a, lang in [(("abcde", "l1"), ("fghij", "l2"), ("klmno", "l3"))[i % 3]]]
    train = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = fit_language(train, F.col("doc_id") < 150)
    got = predict_language(train, model).where("doc_id >= 150").toPandas()
    assert (got["lang"] == got["lang_pred"]).mean() > 0.95 and got["score"].between(0, 1).all()
    odd = {r.doc_id: r for r in predict_language(odd_docs.select("doc_id", "text"), model).collect()}
    assert odd[4].lang_pred == odd[5].lang_pred == odd[6].lang_pred == "und" and odd[4].score == 0
    empty = fit_language(no_docs)
    assert {r.lang_pred for r in predict_language(odd_docs.select("doc_id", "text"), empty).collect()} == {"und"}
    assert predict_language(no_docs.select("doc_id", "text"), model).count() == 0


@pytest.mark.parametrize("fit, score, label", [(fit_toxicity, score_toxicity, "toxic"), (fit_quality, score_quality, "quality")])
def test_classifiers(spark, odd_docs, no_docs, fit, score, label):
    rng = np.random.default_rng(0)
    texts = [" ".join(rng.choice(["aa", "bb", "cc", "dd"], 20)) + (" awful!!! $$$" if i % 3 == 0 else " fine") for i in range(300)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)], f"doc_id long, {label} int")
    model = fit(docs, labels, F.col("doc_id") < 200)
    got = score(docs, model).where("doc_id >= 200").toPandas()
    assert ((got["score"] >= 0.5) == (got["doc_id"] % 3 == 0)).mean() > 0.95
    odd = score(odd_docs.select("doc_id", "text"), model).collect()
    assert len(odd) == odd_docs.count() and all(0 <= r.score <= 1 for r in odd)
    assert score(no_docs.select("doc_id", "text"), model).count() == 0
    none = fit(docs, labels.limit(0))
    assert {r.score for r in score(odd_docs.select("doc_id", "text"), none).collect()} == {0.5}


def test_pipeline_stages(spark, odd_docs, no_docs, tmp_path):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(1, 13)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"file://{tmp_path}/labels.parquet")
    for turn, docs in enumerate((odd_docs, no_docs)):
        for name, stage in corpus_pipeline.STAGES:
            made = stage(spark, docs, f"file://{tmp_path}")
            path = f"file://{tmp_path}/{name}-{turn}"
            made.write.parquet(path)
            if name != "pieces":
                assert made.columns == docs.columns
                docs = spark.read.parquet(path)


def test_old_columns_give_way(spark, odd_docs):
    """The new columns' names may be in use already."""
    clash = odd_docs.withColumns({"ids": F.lit("old"), "intact": F.lit("old"), "lang_pred": F.lit(1), "score": F.lit("old")})
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(1, 13)], "doc_id long, quality int, toxic int")
    lang = predict_language(clash, fit_language(clash))
    assert dict(lang.dtypes)["lang_pred"] == "string" and {r.doc_id: r.lang_pred for r in lang.collect()}[4] == "und"
    for df in (score_toxicity(clash, fit_toxicity(clash, labels)), score_quality(clash, fit_quality(clash, labels)), lang):
        assert df.columns.count("score") == 1 and all(0 <= r.score <= 1 for r in df.collect())
    pieces = encode_texts(clash, PieceModel.load(PIECE_MODEL), check=True)
    assert len(set(pieces.columns)) == len(pieces.columns) and all(r.intact is True for r in pieces.collect())
    back = decode_ids(pieces.withColumn("text", F.lit(0)), PieceModel.load(PIECE_MODEL))
    assert sorted(map(str, (r.text for r in back.collect()))) == sorted(map(str, (r.text for r in odd_docs.collect())))


def test_language_sample_of_a_hot_id(spark):
    """A third of all rows on one doc_id is one text of the sample."""
    texts = {"en": "the quick brown fox and the lazy dog", "de": "der schnelle braune Fuchs und der faule Hund"}
    rows = [(i, f"{texts[la]} {i}", la) for i in range(300) for la in texts]
    rows = [(2 * i + (la == "de"), t, la) for i, t, la in rows] + [(1_000_000, f"zzz qqq xxx {i}", "en") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = predict_language(docs, fit_language(docs, max_train=200)).where("doc_id < 1000000")
    assert got.where("lang_pred <> lang").count() == 0


def test_blank_texts_are_dealt_out(spark):
    """Three quarters of the rows are empty: no batch holds most of them."""
    from pointlake.llm.common import pack_rest
    from pointlake.llm.suffixes import repeated_spans

    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 4 == 0, F.concat(F.lit("text number "), F.col("id").cast("string"))).otherwise("").alias("text"))
    rows, _ = repeated_spans(pack_rest(docs, "doc_id", "text"), 50)
    sizes = [r["count"] for r in rows.groupBy("batch").count().collect()]
    assert sum(sizes) == 4000 and max(sizes) < 1000
    assert remove_repeats(docs).where("n_removed > 0").count() == 0


def test_held_out_accuracy(spark):
    """On the driver's tables, rows that no model has seen."""
    from pointlake.llm.queries import QUERIES

    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), spark.read.parquet(f"{sf}/labels.parquet")
    lang = QUERIES["op8_language_id"](spark, sf).where("held_out").join(docs.where("lang IS NOT NULL"), "doc_id").toPandas()
    assert len(lang) > 100 and (lang["lang"] == lang["lang_pred"]).mean() >= 0.97

    def auc(name, label):
        f = QUERIES[name](spark, sf).where("held_out").join(labels.select("doc_id", F.col(label).alias("y")), "doc_id").toPandas()
        good, bad = f["score"][f["y"] == 1].to_numpy(), f["score"][f["y"] == 0].to_numpy()
        return (good[:, None] > bad[None, :]).mean() + (good[:, None] == bad[None, :]).mean() / 2

    assert auc("op9_toxicity", "toxic") >= 0.9 and auc("op10_quality", "quality") >= 0.95
