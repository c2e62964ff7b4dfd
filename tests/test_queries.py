"""Every query with SQL against DuckDB, over the smallest tables."""

import duckdb
import pytest

from starmill.plans.catalogue import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def text(frame):
    out = frame.astype(object).where(frame.notna(), None).map(str)
    return sorted(tuple(x.removesuffix(".0") for x in row) for row in out.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name in ORACLES:
        want = duck.sql(ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert text(got) == text(want[list(got.columns)])


def test_samples_repeat(spark):
    for name in ("s1_sample_models", "s2_synthetic_catalog", "s3_thinned_sample", "s5_flux_bin_models", "j20_positions_near_catalog", "j21_positions_from_map"):
        one, two = (text(QUERIES[name](spark, SF).toPandas()) for _ in range(2))
        assert one == two and one


def test_positions_of_all_models(spark):
    ids = lambda name: {r.model_id for r in QUERIES[name](spark, SF).select("model_id").distinct().collect()}
    assert ids("j21_positions_from_map") == ids("j15_distance_grid")
