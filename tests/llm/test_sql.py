"""The training-data queries against their SQL on the smallest tables."""

import pytest

from conftest import SF, compare
from marlspike.llm import queries

SQL = queries.oracle_sql()


@pytest.mark.parametrize("name", SQL)
def test_query(name, spark, duck):
    assert compare(queries.queries()[name](spark, str(SF)), duck, SQL[name]) > 0


def test_scoring_returns_what_it_has_to(spark, duck):
    """Columns and types, and the number of tokens by SQL."""
    sql = r"select doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) + 1 as n_tokens from documents"
    got = queries.op13_lattice_scoring(spark, str(SF))
    assert dict(got.dtypes) == {"doc_id": "bigint", "n_tokens": "bigint", "n_known": "bigint", "train_tokens": "bigint", "base_score": "double", "score": "double", "held_out": "boolean"}
    assert compare(got.select("doc_id", "n_tokens"), duck, sql) > 0
