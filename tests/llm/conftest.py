import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

DOCS = "doc_id long, text string, lang string, source string, n_chars long, words string, value long, node long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents with extra columns whose names clash with the operators' own."""
    def make(rows):
        return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "w", 1, 2) for i, t in rows], DOCS)
    return make


@pytest.fixture(scope="session")
def nasty(docs_of):
    """Nulls, empty and long texts, ties and repeated rows."""
    rng = random.Random(1)
    long_text = " ".join(f"w{rng.randrange(5000)}" for _ in range(9000))
    return docs_of([(1, None), (2, ""), (3, "   "), (4, "one"), (5, long_text), (6, long_text), (6, long_text), (7, "one\n\none"),
                    (None, "no id here at all, none"), (8, "É é ß 日本語 İ")])


@pytest.fixture(scope="session")
def no_docs(docs_of):
    return docs_of([])
