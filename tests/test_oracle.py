"""Every query with SQL against DuckDB on the same tables, on one and on several shuffle partitions."""

import math

import duckdb
import pytest

from granary import plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    clean = lambda v: "nan" if isinstance(v, float) and math.isnan(v) else v
    return sorted((tuple(clean(r[i]) for i in order) for r in rows), key=lambda t: tuple((v is None, str(v)) for v in t))


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_rows_equal_sql(spark, duck, sf, name):
    df = plans.QUERIES[name](spark, sf)
    sql = duck.sql(plans.SQL[name])
    assert sorted(df.columns) == sorted(sql.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(sql.columns, sql.fetchall())


@pytest.mark.parametrize("name", ["i02_bm25", "i06_hybrid", "i19_merge_collections", "a06_latency", "w09_page_ranges", "w12_merged_articles", "t09_deadline_order"])
def test_partitions_and_adaptive_plans_do_not_matter(spark, sf, name):
    found = []
    for n, adaptive in (("1", "false"), ("7", "true")):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        df = plans.QUERIES[name](spark, sf)
        found.append(rows_of(df.columns, df.collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    assert found[0] == found[1]


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.SQL)))
def test_others_run(spark, sf, name):
    assert plans.QUERIES[name](spark, sf).count() > 0
