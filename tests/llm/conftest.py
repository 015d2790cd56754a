import os
import sys

import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `rid` int, size string, fp int, `batch` string, score double"

PASSAGE = "the quick brown fox jumps over the lazy dog while seven wizards watch quietly from the hill"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns whose names the operators use inside."""
    words = [f"word{i % 97}x{i % 31}" for i in range(4000)]
    rows = [
        (1, " ".join(words[:300]), "en", "a"), (2, " ".join(words[:300]), "en", "a"), (3, " ".join([*words[:299], "changed"]), "en", None),
        (4, None, "en", "b"), (5, "", None, "b"), (6, "   \n\t ", "de", "b"), (7, "one", "de", "c"), (7, "one", "de", "c"),
        (None, PASSAGE + " and more text follows here", "en", "a"), (8, "Before it comes this. " + PASSAGE, "en", "a"),
        (9, PASSAGE + " " + PASSAGE, "fr", None), (10, " ".join(words * 20), "fr", "a"), (11, "é" * 200 + " 日本語 " + "▁x  y", "xx", "d"), (12, "a" * 500, "en", "d"),
    ]
    full = [(i, t, la, s, None if t is None else len(t), 5, "s", 6, "b", 0.25) for i, t, la, s in rows]
    return spark.createDataFrame(full, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
