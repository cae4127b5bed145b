"""Every query of the catalog against its SQL, on the smallest tables, and properties that any size must have."""

import pytest
from pyspark.sql import functions as F

from pulsefold.plans import catalog, catalog_log, catalog_store

duckdb = pytest.importorskip("duckdb")

TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def sql(tiny):
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tiny}/{t}.parquet')")
    return connection


def shown(value):
    return f"{value:.4f}" if isinstance(value, float) else str(value)


QUERIES, ORACLES = (a | b | c for a, b, c in zip(*((m.QUERIES, m.ORACLES) for m in (catalog, catalog_log, catalog_store)), strict=True))


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_its_sql(spark, tiny, sql, name):
    df = QUERIES[name](spark, tiny)
    result = sql.execute(ORACLES[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted(tuple(shown(r[columns.index(c)]) for c in df.columns) for r in result.fetchall())
    assert sorted(tuple(shown(x) for x in r) for r in df.collect()) == want


def test_filters_reach_the_scan(spark, tiny):
    df = catalog.QUERIES["filter_conjunctive"](spark, tiny)
    plan = df._jdf.queryExecution().toString()
    assert "EqualTo(event_type,purchase)" in plan
    assert "props" not in plan.split("ReadSchema:")[-1].split("\n")[0]


def test_capped_axes_do_not_depend_on_partitions(spark, tiny):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        results = []
        for n in ("1", "7"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            results.append(sorted(map(tuple, catalog.QUERIES["hist_capped_129"](spark, tiny).collect())))
        assert results[0] == results[1]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_counts_are_not_lost(spark, tiny):
    total = spark.read.parquet(f"{tiny}/events.parquet").count()
    for name in ("hist_capped_10", "hist_runtimes", "releases_capped", "hist_versions"):
        assert catalog.QUERIES[name](spark, tiny).agg(F.sum("n")).first()[0] == total
