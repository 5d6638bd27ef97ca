import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """Documents of texts; ids count from 1 unless pairs are given."""

    def make(texts, schema=SCHEMA):
        rows = [t if isinstance(t, tuple) else (k + 1, t) for k, t in enumerate(texts)]
        return spark.createDataFrame([(*r, "en", "src1", len(r[1] or "")) for r in rows], schema)

    return make
