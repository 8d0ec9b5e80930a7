import pytest

#: Columns whose names the operators use themselves.
CLASHES = ["rep", "f0", "group_id", "keep", "mix_source", "gone", "rank", "h", "verdict", "task", "copy", "n_tokens", "lang_pred", "c0", "_c0", "key", "again"]


@pytest.fixture(scope="session")
def documents(spark):
    """make(rows) from (doc_id, text, lang, source), with clashing extra columns."""

    def make(rows):
        from pyspark.sql import functions as F

        df = spark.createDataFrame([(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
        return df.withColumns({c: F.lit("x") for c in CLASHES})

    return make


def words(rng, n, tag=""):
    return " ".join(f"{tag}w{x}" for x in rng.integers(0, 5000, n))
