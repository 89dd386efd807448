import pytest

import __spark_entry__ as driver
from conftest import DATA, duck, duck_result, spark_result
from dwellgrid.plans import registry
from dwellgrid.plans.oracle import oracle_statements

SF = "0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.fixture(scope="module", autouse=True)
def shared_stages():
    """Queries of this module reuse each other's stages; one runs as the driver runs it, see below."""
    build, built = registry._pipeline, {}

    def shared(spark, sf_dir, **params):
        key = (sf_dir, tuple(sorted(params.items())))
        if key not in built:
            built[key] = build(spark, sf_dir, **params)
        return built[key]

    registry._pipeline = shared
    yield build
    registry._pipeline = build


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_matches_sql(spark, con, name):
    got = spark_result(driver.queries()[name](spark, f"{DATA}/sf{SF}"))
    assert got == duck_result(con, driver.oracle_sql()[name])
    assert got[1]


def test_every_query_has_sql():
    assert registry.QUERIES.keys() == oracle_statements().keys()
    assert registry.QUERIES.keys() <= driver.queries().keys()
    assert driver.oracle_sql().keys() <= driver.queries().keys()


def test_queries_as_the_driver_runs_them(spark, con, monkeypatch, shared_stages):
    """Nothing shared: each query starts from the tables."""
    monkeypatch.setattr(registry, "_pipeline", shared_stages)
    for name in ("recommend_text_compat", "region_at"):
        assert spark_result(driver.queries()[name](spark, f"{DATA}/sf{SF}")) == duck_result(con, driver.oracle_sql()[name])


def test_entry(spark):
    assert driver.entry(spark).count() == 46
