"""Every core query against its SQL."""

import pytest

from tessera import queries as core
from tests.oracle import same

D = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(core.oracle_sql()))
def test_against_sql(spark, name):
    same(spark, D, core.queries()[name], core.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(core.queries()) - set(core.oracle_sql()) - {"q1_run_summary"}))
def test_runs(spark, name):
    assert core.queries()[name](spark, D).count() > 0
