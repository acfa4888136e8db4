"""Every registered query is callable and every SQL belongs to a query."""

import __spark_entry__ as entry


def test_registry():
    q, s = entry.queries(), entry.oracle_sql()
    assert all(callable(f) for f in q.values()) and set(s) <= set(q) and len(q) >= 55
    assert "p1_found" in s


def test_small_broadcasts_only(spark):
    from auditloom.runtime import broadcast_if_small, small_enough, spread

    df = spark.range(100)
    assert small_enough(df, 100) and not small_enough(df, 99)
    assert broadcast_if_small(df, 10) is df
    assert spread(df.repartition(1)).count() == 100
