"""Fixtures: awkward documents, read from files."""

import pytest
from brute import awkward_docs, empty_like

SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def docs(spark, tmp_path_factory):
    return awkward_docs(spark, str(tmp_path_factory.mktemp("docs") / "documents.parquet"))


@pytest.fixture(scope="session")
def rows(docs):
    """The documents as Python rows, in no particular order."""
    return docs.select("doc_id", "text", "source").collect()


@pytest.fixture(scope="session")
def no_docs(spark, docs, tmp_path_factory):
    return empty_like(spark, docs, str(tmp_path_factory.mktemp("none") / "documents.parquet"))
