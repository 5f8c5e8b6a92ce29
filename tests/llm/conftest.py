import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

HERE = Path(__file__).resolve().parent
sys.path[:0] = [str(HERE.parents[1]), str(HERE)]

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """A documents table from (doc_id, text) or (doc_id, text, lang), with clashing extra columns."""

    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", len(r[1] or "")) for r in rows]
        extra = {c: F.lit("extra") for c in ("digest", "pos", "word", "block", "tag", "node", "first", "bands", "token", "h", "key", "_spans")}
        return spark.createDataFrame(full, DOCS).withColumns(extra)

    return make
