import os
from decimal import Decimal

import duckdb
import pytest

from cohortrank.queries import oracle_sql, queries

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="the given tables are not here")


def value(x):
    if x is None or x != x:
        return None
    if isinstance(x, (bool, int, float, Decimal)):
        return round(float(x), 6) + 0.0
    return str(x)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(value(r[i]) for i in order) for r in rows), key=str)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_agrees_with_its_sql(spark, duck, name):
    df = queries()[name](spark, DIR)
    got = table(df.columns, df.collect())
    cur = duck.execute(oracle_sql()[name])
    assert got == table([c[0] for c in cur.description], cur.fetchall())


@pytest.mark.parametrize("name", sorted(set(queries()) - set(oracle_sql()) - {"kmeans_roles", "gbt_projection", "aft_quantiles"}))
def test_query_without_sql_runs(spark, name):
    assert queries()[name](spark, DIR).count() > 0


def test_models(spark):
    q = {n: queries()[n](spark, DIR) for n in ("kmeans_roles", "gbt_projection", "aft_quantiles")}
    assert q["kmeans_roles"].where("confidence < 0 OR confidence > 1 OR primary_role IS NULL").count() == 0
    assert q["gbt_projection"].where("p10 > p50 OR p50 > p90").count() == 0
    assert q["aft_quantiles"].where("q10 > q50 OR q50 > q90").count() == 0


@pytest.mark.parametrize("name, key, source", [("unit_reconcile", "a", "orders"), ("entity_resolution", "record", "customer"), ("fuzzy_match", "asked", "part")])
def test_matching_takes_all_rows(spark, name, key, source):
    n = spark.read.parquet(f"{DIR}/{source}.parquet").count()
    assert queries()[name](spark, DIR).select(key).distinct().count() == n
