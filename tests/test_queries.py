"""Every query of the library against its SQL, and that its rule fired on some rows and not on all."""

import pytest

from lectern import queries as core
from tests.oracle import connect, rows_of, rows_of_sql

SQL = core.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf, con, name):
    got, names = rows_of(core.queries()[name](spark, sf))
    want, columns = rows_of_sql(con, SQL[name])
    assert names == columns
    assert got and got == want


@pytest.mark.parametrize("name", sorted(set(core.queries()) - set(SQL)))
def test_query_has_rows(spark, sf, name):
    assert core.queries()[name](spark, sf).count() > 0


def test_rules_fire_on_some_rows_and_not_on_all(spark, sf):
    q = core.queries()
    def share(name, condition):
        return q[name](spark, sf).selectExpr(f"avg(cast({condition} as int)) s").first().s
    checks = {"heading_detect": "is_heading or shouted", "page_artifacts": "kind = 'page_artifact'", "boilerplate_text_strip": "rejected", "chapter_sections": "names", "fold_small_sections": "prelude <> ''", "greedy_chunks": "over_limit", "guarded_rewrite": "reason = 'accepted'", "completeness_check": "n_segments > 0", "queue_duplicates": "claimed", "script_utterances": "chapter_idx > 0"}
    for name, condition in checks.items():
        got = share(name, condition)
        assert got is not None and 0 < got <= 1 and (got < 1 or name == "completeness_check"), name
