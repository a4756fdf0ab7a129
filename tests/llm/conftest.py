import pytest



def with_extras(df):
    return df.selectExpr("*", "1L AS sim", "2 AS salt", "'x' AS path", "'y' AS set_id", "3 AS size", "'z' AS _row", "0.5D AS p", "7 AS items", "8 AS keep")


@pytest.fixture(scope="session")
def make(spark):
    """A documents table of ``(doc_id, text[, source])`` rows with clashing extra columns."""

    def build(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s0", None if r[1] is None else len(r[1])) for r in rows]
        return with_extras(spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long"))

    return build
