import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture
def docs(spark):
    """Documents from (doc_id, text) or (doc_id, text, source) tuples."""

    def make(rows, extra=""):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "src0", None if r[1] is None else len(r[1])) for r in rows]
        df = spark.createDataFrame(full, DOCS)
        for name in extra.split():
            df = df.selectExpr("*", f"'x' AS `{name}`")
        return df

    return make
