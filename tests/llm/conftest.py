import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from (id, text) or (id, text, source) rows, with the columns of ``documents``."""

    def make(rows, extra=False):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "host", None if r[1] is None else len(r[1])) for r in rows]
        df = spark.createDataFrame(full, DOC)
        if extra:  # names that operators use themselves
            for name in ("start", "key", "print", "raw", "kept", "score", "n_words", "sequence_id", "common_lines", "mark", "owner", "group", "spans", "hits", "bad_key", "bad_print", "gone_key", "gone_mark"):
                df = df.selectExpr("*", f"'x' AS `{name}`")
        return df

    return make
