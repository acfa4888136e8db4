"""Changes between snapshots."""

import datetime as dt

from auditloom.operators.history import audit_diffs
from auditloom.operators.snapshots import audit_changes, latest_versions, snapshot_changes

T = dt.datetime(2025, 1, 1)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_changes_with_nulls_and_empty_text(spark):
    kind = "k string, v string, w int"
    old = spark.createDataFrame([("a", None, 1), ("b", "", 1), ("c", "x", None), (None, "n", 1), ("gone", "g", 1)], kind)
    new = spark.createDataFrame([("a", "", 1), ("b", "", 1), ("c", "x", None), (None, "m", 1), ("fresh", "f", 1)], kind)
    assert rows(snapshot_changes(new, old, ["k"], ["v", "w"])) == sorted(
        [("a", "changed"), (None, "changed"), ("gone", "removed"), ("fresh", "added")], key=repr
    )


def test_empty_snapshots(spark):
    empty = spark.createDataFrame([], "k string, v string")
    some = spark.createDataFrame([("a", "x")], "k string, v string")
    assert rows(snapshot_changes(some, empty, ["k"], ["v"])) == [("a", "added")]
    assert rows(snapshot_changes(empty, some, ["k"], ["v"])) == [("a", "removed")]
    assert rows(snapshot_changes(empty, empty, ["k"], ["v"])) == []


def test_latest_version_and_ties(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, None), ("a", 2, None), ("b", None, "n"), ("b", None, "m")], "k string, id int, v string")
    assert rows(latest_versions(df, ["k"], "id", ["v"])) == [("a", None), ("b", "n")]


def tables(spark):
    audits = spark.createDataFrame(
        [(1, 1, "completed", T, 60.0), (1, 1, "completed", T, 60.0), (2, 1, "partial", T, None), (3, 1, "completed", T, 55.5), (4, 2, "completed", T, 1.0)],
        "id long, project_id long, status string, finished_at timestamp, health_score double",
    )
    pages = spark.createDataFrame(
        [(1, 1, "/a", "A", 200), (2, 1, "/b", "B", 200), (3, 1, "/gone", None, 200), (4, 3, "/a", "A", 200), (5, 3, "/b", "B", 500), (6, 3, "/b", "B", 404), (7, 3, "/fresh", "F", None), (8, 4, "/z", "Z", 200)],
        "id long, audit_id long, url string, title string, status int",
    ).withColumnRenamed("title", "title")
    issues = spark.createDataFrame(
        [(1, 1, "/a", "MISSING_H1"), (2, 1, "/b", "THIN_CONTENT"), (3, 1, "/b", "MISSING_ALT"), (4, 3, "/a", "MISSING_H1"), (5, 3, "/b", "STATUS_404"), (6, 3, "/fresh", "MISSING_ALT"), (6, 3, "/fresh", "MISSING_ALT")],
        "id long, audit_id long, url string, code string",
    )
    return audits, pages, issues


def test_audit_changes_with_repeats_ties_and_extra_columns(spark):
    audits, pages, issues = tables(spark)
    from pyspark.sql import functions as F

    got = rows(audit_changes(audits.withColumn("url", F.lit("x")), pages.withColumn("code", F.lit("y")), issues.withColumn("status", F.lit("z"))))
    assert got == sorted([
        (3, "page", "/b", "", "changed"), (3, "page", "/gone", "", "removed"), (3, "page", "/fresh", "", "added"),
        (3, "issue", "/b", "THIN_CONTENT", "removed"), (3, "issue", "/b", "MISSING_ALT", "removed"),
        (3, "issue", "/b", "STATUS_404", "added"), (3, "issue", "/fresh", "MISSING_ALT", "added"),
    ], key=repr)


def test_audit_diffs(spark):
    from pyspark.sql import functions as F

    audits, pages, issues = tables(spark)
    d = audit_diffs(audits, pages.where("id <> 5"), issues.withColumn("severity", F.lit("info")).withColumn("message", F.lit("m")))
    assert {(r.url, r.code, r.change) for r in d["issues"].collect()} == {
        ("/b", "STATUS_404", "new"), ("/fresh", "MISSING_ALT", "new"), ("/b", "THIN_CONTENT", "fixed"), ("/b", "MISSING_ALT", "fixed")
    }
    assert d["persisting"].count() == 1
    assert {(r.url, r.change) for r in d["pages"].collect()} == {("/fresh", "added"), ("/gone", "removed")}
    assert [(r.url, r.old_status, r.new_status) for r in d["statuses"].collect()] == [("/b", 200, 404)]
    assert d["scores"].first().change == -4.5


def test_heavy_keys_are_joined_apart(spark):
    """Keys of many rows, few rows and no partner, and an empty side, against a plain join."""
    from auditloom.runtime import join_per_key

    many = spark.createDataFrame([(0, i) for i in range(400)] + [(i, i) for i in range(1, 40)] + [(None, 1)], "k int, v int")
    one = spark.createDataFrame([(i, f"x{i}") for i in range(0, 60, 2)], "k int, name string")
    for least in (10, 10_000):
        assert sorted(map(tuple, join_per_key(many, one, "k", least=least).collect())) == sorted(map(tuple, many.join(one, "k").collect()))
    assert join_per_key(many.limit(0), one, "k").count() == join_per_key(many, one.limit(0), "k", least=10).count() == 0


def test_sides_are_broadcast_by_rows_and_bytes(spark):
    from auditloom.runtime import broadcast_if_small

    df = spark.createDataFrame([("x" * 1000, [1, 2])] * 20, "t string, a array<bigint>")
    hinted = lambda d: "ResolvedHint" in d._jdf.queryExecution().logical().toString() or "broadcast" in d._jdf.queryExecution().logical().toString()
    assert hinted(broadcast_if_small(df)) and not hinted(broadcast_if_small(df, rows=19)) and not hinted(broadcast_if_small(df, bytes_=10_000))
