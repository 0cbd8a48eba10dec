import pytest

from braidwork.llm.common import prepare

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    """Makes a documents table; with extra columns that clash with names used inside."""
    prepare(spark)

    def make(rows, extra=True):
        df = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], SCHEMA)
        if extra:
            for name in ("block", "bucket", "shard", "start", "key", "score", "train", "class_id", "n"):
                df = df.selectExpr("*", f"'clash' as {name}")
        return df

    return make
