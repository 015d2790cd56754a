"""Ids of a BPE model against the library's own."""

import numpy as np
import sentencepiece

from pointlake.llm import pieces
from pointlake.llm.pieces import PieceModel, encode_texts
from pointlake.llm.queries import PIECE_MODEL


def test_ids_are_those_of_sentencepiece(spark, odd_docs):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)
    texts = [
        "the cat sat on the mat", "", " ", "  a  b\n\n c ", "<s> <0x0A> </s>", "日本語 \u0000 é ① 🙂", "a" * 500, "\ttabs\tand\r\nends ",
        "The quick brown fox, which jumped over 1,234 lazy dogs; isn't that odd?",
    ]
    docs = odd_docs.select("doc_id", "text").union(spark.createDataFrame(list(enumerate(texts, 100)), "doc_id long, text string"))
    for r in encode_texts(docs.select("doc_id", "text", docs.text.alias("kept")), PieceModel.load(PIECE_MODEL), check=True).collect():
        assert r.intact
        if r.kept is None:
            assert r.ids is None
        elif pieces.BLANK not in r.kept:  # that character has to stay apart from blanks
            assert r.ids == library.encode(r.kept)


def test_parts_of_a_long_text_join(monkeypatch):
    library, model = sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL), PieceModel.load(PIECE_MODEL)
    monkeypatch.setattr(pieces, "_PART", 50)
    rng = np.random.default_rng(3)
    for _ in range(20):
        text = "".join(rng.choice(["the", "ing", "re", " ", "  ", "\n", "é", "日", ".", "x" * 60], 300))
        assert model.ids_of([text])[0].tolist() == library.encode(text)
        assert model.decode(model.ids_of([text + pieces.BLANK + text])[0]) == text + pieces.BLANK + text
