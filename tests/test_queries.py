"""Every query with SQL against DuckDB on the smallest tables; the rest must run."""

import pytest
from conftest import DATA, canonical

import __spark_entry__ as entry

QUERIES, SQL = entry.queries(), entry.oracle_sql()
CORE = sorted(n for n in QUERIES if not QUERIES[n].__module__.startswith("palabre.llm"))


@pytest.mark.parametrize("name", [n for n in CORE if n in SQL])
def test_equals_sql(spark, duck, name):
    got = QUERIES[name](spark, DATA)
    rel = duck.sql(SQL[name])
    assert sorted(got.columns) == sorted(rel.columns)
    assert canonical([tuple(r) for r in got.collect()], got.columns) == canonical(rel.fetchall(), rel.columns)


@pytest.mark.parametrize("name", [n for n in CORE if n not in SQL])
def test_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() >= 0
    assert set(SQL) <= set(QUERIES)


def test_input_order_and_partitions_change_nothing(spark):
    from palabre.operators.relational import asof_barrier, segments

    s = spark.createDataFrame([("g", i, i != 3) for i in range(1, 7)], "g string, n int, complete boolean")
    p = spark.createDataFrame([("g", n, who, n * 10 + len(who)) for n in range(1, 7) for who in ("a", "bb")], "g string, n int, who string, v int")
    outs = []
    for parts in (1, 8, 64):
        x = p.repartition(parts).join(segments(s.repartition(parts), "g", "n", "complete"), ["g", "n"])
        outs.append(sorted(map(tuple, asof_barrier(x, "g", "who", "n", "v").select("who", "n", "prev").collect())))
    assert outs[0] == outs[1] == outs[2]
