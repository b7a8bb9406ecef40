"""Every query of the library over the smallest tables, against its SQL."""

import pytest
from oracle import connection, rows_of, rows_of_sql

from tessera.plans import library, queries  # noqa: F401 - they register their queries
from tessera.plans.registry import ORACLE_SQL, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connection(FOLDER)


def test_each_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    assert rows_of(QUERIES[name](spark, FOLDER)) == rows_of_sql(con, ORACLE_SQL[name])


def test_tree_under_one_root_keeps_documents_of_large_ids(spark, con, tmp_path):
    """The same documents with ids of a million and more give the same tree. Its SQL keeps ids under 100,000 only, so it is asked about the small ids."""
    name, shift = "tree_under_one_root", 1_000_000
    documents = spark.read.parquet(f"{FOLDER}/documents.parquet")
    documents.withColumn("doc_id", documents["doc_id"] + shift).write.parquet(f"{tmp_path}/documents.parquet")
    names, expected = rows_of_sql(con, ORACLE_SQL[name])

    def moved(node):
        if node is None or node == "all":
            return node
        root, document, *rest = node.split(".")
        return ".".join([root, str(int(document) + shift), *rest])

    ids = [names.index(c) for c in ("node_id", "parent_id")]
    assert rows_of(QUERIES[name](spark, str(tmp_path))) == (names, sorted((tuple(moved(v) if k in ids else v for k, v in enumerate(r)) for r in expected), key=repr))
