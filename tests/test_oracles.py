"""Every query with SQL against that SQL; the others run and give rows."""

import pytest

from oddsloom.plans import catalog

from .compare import spark_rows, sql_rows


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, sf, name):
    columns, rows = spark_rows(catalog.queries()[name](spark, sf))
    if (text := catalog.oracle_sql().get(name)) is None:
        assert rows and columns
        return
    assert (columns, rows) == sql_rows(sf, text)


def test_review_candidates_go_past_rank_three(spark):
    near = catalog.queries()["nearest_candidates"](spark, "/root/testdata/sf0.01").count()
    rows = catalog.queries()["review_candidates"](spark, "/root/testdata/sf0.01").collect()
    assert 3 < max(r.rank for r in rows) <= 50 and sum(r.rank <= 3 for r in rows) == near < len(rows)
