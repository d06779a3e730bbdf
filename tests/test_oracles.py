"""Every query that has an oracle gives its rows, on the smallest tables that have any for it."""

import os

import pytest

from tests.oracle_compare import connect, difference

SMALL, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
if not os.path.isdir(SMALL) or not os.path.isdir(LARGER):
    pytest.skip("no test tables", allow_module_level=True)

from panelloom.plans import registry  # noqa: E402

#: These need twenty names a month, a run of months of an IC, or more customers than the smallest tables have.
NEED_NAMES = {"quantile_spread", "factor_turnover", "quantile_shape", "direction_audit", "decay_weights", "factor_duplicates", "screening_funnel", "weight_floors", "tilt_fraction", "name_turnover", "first_names"}


@pytest.fixture(scope="module")
def connections():
    return {sf: connect(sf) for sf in (SMALL, LARGER)}


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_and_oracle_agree(spark, connections, name):
    sf = LARGER if name in NEED_NAMES else SMALL
    assert difference(spark, connections[sf], registry.QUERIES[name], registry.ORACLES[name], sf) is None


@pytest.mark.parametrize("name", sorted(NEED_NAMES))
def test_there_are_rows_to_compare(connections, name):
    assert connections[LARGER].execute(f"select count(*) from ({registry.ORACLES[name]})").fetchone()[0] > 0
