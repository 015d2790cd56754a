"""Every stage of the pipeline against a plain version, and the quotas of the mix."""

import numpy as np
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from pointlake.llm.mixing import mix, split_quotas
from pointlake.llm.quality import fit_quality, score_quality
from pointlake.llm.queries import PIECE_MODEL
from tests.llm.test_documents import brute_removal
from tests.llm.test_similar import components, shingles

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rng = np.random.default_rng(12)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 3000, n)]
    passage = " ".join(word(60))
    rows = []
    for i in range(24):
        base = word(90)
        rows.append(" ".join(base))
        if i % 3 == 0:
            rows += [" ".join([*base[:-1], "other"]), " ".join(base)]
        if i % 4 == 0:
            rows.append(" ".join(word(40)) + " " + passage + " " + " ".join(word(40)))
    rows += [None, "", "one", "one two three"]
    ids = rng.permutation(len(rows)).tolist()
    return [(d, t, "en", ("a", "b", None)[d % 3], None if t is None else len(t)) for d, t in zip(ids, rows, strict=True)]


def test_stages(spark, tmp_path):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(r[0], int(r[1] is not None and len(r[1]) > 20)) for r in rows if r[0] % 4], "doc_id long, quality int")
    labels.write.parquet(f"file://{tmp_path}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)

    kept = stages["quality"](spark, docs, f"file://{tmp_path}")
    scored = score_quality(docs, fit_quality(docs, labels)).collect()
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in scored if r.score >= 0.7)

    texts = [r[1] or "" for r in rows]
    groups = components([shingles(t) for t in texts], 0.8)
    blank = frozenset(i for i, t in enumerate(texts) if not t.split())
    groups = {g for g in groups if not g & blank} | {blank}
    first = {min(rows[i][0] for i in g) for g in groups}
    near = stages["near_duplicates"](spark, docs, "")
    assert near.columns == docs.columns and {r.doc_id for r in near.collect()} == first and near.count() == len(first)

    cut = {r.doc_id: r for r in stages["repeated_passages"](spark, docs, "").collect()}
    for doc_id, n_bytes, n_removed, _, _ in brute_removal([(r[0], r[1]) for r in rows]):
        assert len((cut[doc_id].text or "").encode()) == n_bytes - n_removed
        assert cut[doc_id].text is None or cut[doc_id].n_chars == len(cut[doc_id].text)

    drawn = {r.doc_id: sum(d.words * 2 >= r.size for d in r.draws) for r in mix(docs).collect()}
    mixed = {r.doc_id: r.n for r in stages["mixing"](spark, docs, "").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert mixed == {d: n for d, n in drawn.items() if n}

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)
    got = stages["pieces"](spark, docs, "").collect()
    text_of = {r[0]: r[1] for r in rows}
    assert len(got) == len(rows) and all(r.intact for r in got)
    assert all((r.ids is None) if text_of[r.doc_id] is None else list(r.ids) == sp.encode(text_of[r.doc_id]) for r in got)


def test_quotas(spark):
    sizes = {"a": 1000, "b": 37, None: 3, "c": 0}
    blocks = spark.createDataFrame(list(sizes.items()), "source string, blocks long")
    got = split_quotas(blocks, 5).collect()
    for source, n in sizes.items():
        own = sorted((r["first"], r["last"]) for r in got if r.source == source)
        assert sum(b - a for a, b in own) == n and all(x[1] == y[0] for x, y in zip(own, own[1:], strict=False))
    per = [sum(r["last"] - r["first"] for r in got if r.shard == s) for s in range(5)]
    assert sum(per) == 1040 and max(per) - min(per) <= 2
    share = [sum(r["last"] - r["first"] for r in got if r.shard == s and r.source == "b") for s in range(5)]
    assert all(0 <= x <= 20 for x in share)  # about 7.4 of each: hypergeometric, standard deviation 2.4
