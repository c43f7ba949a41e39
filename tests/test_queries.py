"""Every query with SQL gives the SQL's rows on the smallest tables."""

import os

import duckdb
import pytest

from meshnet.queries import ORACLE_SQL, QUERIES, trade

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return con


def comparable(rows, columns):
    plain = lambda v: repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted(tuple(plain(r[c]) for c in columns) for r in rows)


@pytest.mark.parametrize("name", ORACLE_SQL)
def test_same_rows_as_sql(spark, oracle, name):
    df = QUERIES[name](spark, SF)
    want = oracle.sql(ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    columns = sorted(df.columns)
    got = comparable((r.asDict() for r in df.collect()), columns)
    assert got == comparable((dict(zip(want.columns, r, strict=True)) for r in want.fetchall()), columns)


def test_entry_module():
    import __spark_entry__

    assert set(ORACLE_SQL) <= set(__spark_entry__.oracle_sql()) and set(QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_lines_are_dealt_out_by_their_own_keys_alone(spark):
    """Where no table is broadcast, lines are shuffled for their supplier, order and part; customers meet the orders, not the lines."""
    keep = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = trade(spark, SF)._jdf.queryExecution().executedPlan()
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)
    dealt, seen = [], [plan]
    while seen:
        node = seen.pop()
        seen += [node.children().apply(i) for i in range(node.children().size())]
        if node.nodeName() == "Exchange" and "flow" in {node.output().apply(i).name() for i in range(node.output().size())}:
            dealt.append(node.outputPartitioning().toString().split("(")[1].split("#")[0])
    assert sorted(dealt) == ["l_orderkey", "l_partkey", "l_suppkey"]
