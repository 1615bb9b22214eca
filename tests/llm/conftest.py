import os

import pytest

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


def frame(spark, rows, schema="doc_id bigint, text string, lang string, source string, n_chars bigint"):
    """Documents from (id, text) pairs."""
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], schema)
