import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))


@pytest.fixture(scope="module")
def docs(spark):
    """Small documents with what operators must stand: nulls, nothing, long texts, copies, near copies, other columns."""
    base = " ".join(f"w{i * 7919 % 1009}" for i in range(120))
    near = base.replace("w0 ", "other ", 1)
    rows = [(1, base, "en", "a", 0), (2, base, "en", None, 1), (3, near, "en", "b", 2), (3, near, "en", "b", 2), (4, None, None, "a", 3), (5, "", "de", "a", 4), (6, " \n\t ", "de", "b", 5), (7, "one two", "de", "b", 6), (8, "ONE two", "de", "b", 7), (9, "x " * 30_000, "en", "c", 8), (10, "Ünï cödé 日本 \x85 w1 w2", "fr", "ü", 9), (None, "no id at all here", "en", "a", 10), (11, "12345 !!! 67", "en", "a", 11), (12, near + " tail of other words entirely", "en", "a", 12)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_shingles int")
