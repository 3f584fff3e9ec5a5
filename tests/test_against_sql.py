"""Every query against its SQL, values and types, on the supplied tables."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from checks.compare import arrow_types, differences
from checks.queries import ORACLE as SQL
from checks.queries import QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(name, spark, sf_dir, con):
    got = QUERIES[name](spark, sf_dir).toArrow()
    want = con.execute(SQL[name]).to_arrow_table()
    assert differences(got.to_pandas(), want.to_pandas()) is None
    assert arrow_types(got) == {k: arrow_types(want)[k] for k in arrow_types(got)}


def test_every_query_has_sql():
    assert set(SQL) == set(QUERIES)
    assert set(QUERIES) <= set(queries()) and set(SQL) <= set(oracle_sql())


def test_entry(spark):
    assert entry(spark).count() > 0


# figures found independently with plain loops over the same views
@pytest.mark.parametrize(
    "sql, want",
    [
        ("select count(*) from ({rate_limit_decisions}) where not allowed", 2896),
        ("select count(*) from ({rate_utilisation}) where prior_calls >= 2", 4004),
        ("select count(*) from ({prompt_reuse}) where hit", 4535),
        ("select count(*) from ({key_cooldown_audit})", 2438),
        ("select count(*) from ({breaker_trace}) where state_before = 'OPEN'", 57),
        ("select count(*) from ({breaker_trace}) where state_before = 'HALF_OPEN'", 28),
        ("select sum(n_requests) from ({admission_funnel})", 10000),
    ],
)
def test_known_figures(sql, want, con):
    assert con.execute(sql.format(**SQL)).fetchone()[0] == want
