import os

import pytest

SMALL = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def texts(spark):
    """Rows of (doc_id, text, lang, source, n_chars) that cover the odd cases: null, empty, wordless, repeated, very long, clashing extra columns."""

    def make(*rows):
        full = [(i, t, lang, source, None if t is None else len(t), "x", 1) for i, t, lang, source in rows]
        return spark.createDataFrame(full, "doc_id bigint, text string, lang string, source string, n_chars bigint, hash string, size int")

    return make
