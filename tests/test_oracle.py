"""Every registered query of the library itself against its DuckDB SQL."""

from __future__ import annotations

import os

import pytest

from ortholens.plans import core, domain, files
from tests.oracle import connect, same

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLES = core.QUERIES | domain.QUERIES | files.QUERIES, core.ORACLES | domain.ORACLES | files.ORACLES


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    same(QUERIES[name](spark, SF).toPandas(), duck.sql(ORACLES[name]).df())


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


def test_sample_does_not_depend_on_partitioning(spark):
    from ortholens.operators.groups import seeded_sample
    from ortholens.plans.views import pred

    a, b = seeded_sample(pred(spark, SF), "gene"), seeded_sample(pred(spark, SF).repartition(7), "gene")
    assert [r["gene"] for r in a.collect()] == [r["gene"] for r in b.collect()]
