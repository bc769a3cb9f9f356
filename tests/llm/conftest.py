from __future__ import annotations

import pytest

DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """Documents from (doc_id, text) pairs, with an extra column of a clashing name."""
    def build(*rows, **extra):
        data = [(i, t, "en", f"s{n % 3}", len(t or "")) for n, (i, t) in enumerate(rows)]
        return spark.createDataFrame(data, DOCUMENT)
    return build
