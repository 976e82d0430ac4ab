"""Every query of the subpackage at the smallest scale; SQL where there is some."""

import pytest

from cairnlake.llm import registry
from tests.oracle import compare, connect

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, name):
    df = registry.queries()[name](spark, FOLDER)
    sql = registry.oracle_sql().get(name)
    assert compare(df, connect(FOLDER), sql) if sql else df.count()


def test_found_columns(spark):
    want = {"p2_found": ["embedding_model", "hash_a", "hash_b"], "p3_found": ["src", "row_id", "line_no"], "p4_found": ["repository_id", "path"], "p5_found": ["repository_id", "blob_sha"], "p6_found": ["chunk_id"],
            "p8_found": ["doc_id", "case_id"], "p9_found": ["doc_id"]}
    for name, cols in want.items():
        df = registry.queries()[name](spark, FOLDER)
        assert df.columns == cols and df.count() == df.distinct().count()
