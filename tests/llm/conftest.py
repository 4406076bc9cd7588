from __future__ import annotations

import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def docs(spark):
    """A documents table of texts, or of ``(doc_id, text)`` pairs."""
    def make(*texts):
        rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
        return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)

    return make


@pytest.fixture(scope="session")
def clashing(docs):
    """The same with columns named like the operators' own, one differing in case only."""
    def make(*texts):
        df = docs(*texts)
        for name in ("fingerprint", "component_id", "score", "fp", "key", "rep", "x", "node", "component", "unit",
                     "piece", "start", "end", "spans", "first", "a", "b"):
            df = df.selectExpr("*", f"'other' AS `{name}`")
        return df.selectExpr("*", "'other' AS `TEXT`")

    return make
