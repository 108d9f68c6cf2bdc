import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(__file__))))

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int"


@pytest.fixture(scope="session")
def docs(spark):
    """Builds a documents table from (doc_id, text) rows, with clashing extra columns."""
    def make(rows, **extra):
        out = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)
        for name, value in {"bucket": 7, "score": 1.0, "n_words": 3, "node": "x", **extra}.items():
            from pyspark.sql import functions as F

            out = out.withColumn(name, F.lit(value))
        return out

    return make
