"""Copies, groups and percentiles against brute force, with nulls, ties, repeats and empty tables."""

import datetime as dt
import math
import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

from auditloom.llm import components as C
from auditloom.llm.components import address_groups, connected_components, union_find
from auditloom.llm.copies import canonical_address, collapse_copies, repeat_filter
from auditloom.llm.percentiles import exact_percentiles, page_parts, value_parts

import numpy as np
import pyarrow as pa


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def canon(s):
    if s is None:
        return None
    base, _, rest = s.partition("?")
    bare = lambda x: re.sub(r"[^\w]|_", "", x.lower())
    return bare(base) + "".join(sorted(bare(p) for p in rest.split("&")))


def test_canonical_address(spark):
    same = ["https://E.com/a-b?x=1&y=2", " https://e.com/ab?y=2&x=1​", "HTTPS://e.com/a_b;?y=2&x=1&", "https://e.com/a­b?Y=2& X=1"]
    other = ["http://e.com/ab?x=1&y=2", "https://www.e.com/ab?x=1&y=2", "https://e.com/ab?x=1&y=3", "https://e.com/ab?x=1"]
    df = spark.createDataFrame([(s,) for s in [*same, *other, None, ""]], "s string")
    got = [r.c for r in df.select(canonical_address(F.col("s")).alias("c")).collect()]
    assert len(set(got[:4])) == 1 and len(set(got)) == 1 + 4 + 2 and got[-2] is None and got[-1] == ""


def test_copies_against_brute_force(spark):
    rng = random.Random(7)
    data = []
    for i in range(600):
        word = rng.choice(["page", "item", "hot"]) if i % 3 else "hot"  # a third of all rows in one group
        n = rng.randrange(60) if word != "hot" else 1
        u = f"https://e.com/{word}-{n}?a=1&b={n}"
        u = rng.choice([u, u.upper(), u.replace("-", "_"), u + " ", u.replace(f"a=1&b={n}", f"b={n}&a=1")])
        data.append((i, rng.randrange(3), u, rng.choice([u, u, None]), rng.choice(["", None, "x"])))
    data += data[:50] + [(None, 1, "u", "u", "u"), (900, None, "u", "u", "u")]
    kind = "id long, scope int, url string, final_url string, canonical string"
    groups = defaultdict(set)
    for i, s, *rest in data:
        if i is not None and s is not None:
            groups[(s, *map(canon, rest))].add(i)
    want = sorted(((i, min(g), len(g)) for g in groups.values() for i in g), key=repr)
    df = spark.createDataFrame(data, kind).repartition(7).withColumn("h1", F.lit("clash")).withColumn("possible", F.lit("clash"))
    for most in (64 << 20, 1 << 10):  # also with a filter far too small: results stay exact
        assert rows(collapse_copies(df, "id", "scope", ["url", "final_url", "canonical"], most).distinct()) == want
    assert rows(collapse_copies(df.limit(0), "id", "scope", ["url", "final_url", "canonical"])) == []


def test_no_repeat_is_missed_by_the_filter(spark):
    values = [(i % 5000, -i % 5000) for i in range(5200)]
    df = spark.createDataFrame(values, "h1 long, h2 long").repartition(40)
    filt, bits = repeat_filter(df, len(values))
    from auditloom.llm.copies import _positions, _test

    a = np.array(values, np.int64)
    hit = _test(filt, _positions(a[:, 0].copy(), a[:, 1].copy(), bits))
    assert hit[:200].all() and hit[200:5000].mean() < 0.05


def brute_groups(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {n: find(n) for n in parent}


def test_union_find():
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)]
    a, b = (np.array([e[i] for e in edges if e[0] != e[1]], np.int64) for i in (0, 1))
    x, y = union_find(a, b)
    assert dict(zip(x.tolist(), y.tolist())) == {n: g for n, g in brute_groups([e for e in edges if e[0] != e[1]]).items() if n != g}


def test_forests_are_shrunk_a_logarithmic_number_of_times(monkeypatch):
    """A forest that stays large is not gone over again with every batch."""
    calls = []
    monkeypatch.setattr(C, "MAX_TASK_EDGES", 100)
    monkeypatch.setattr(C, "union_find", lambda a, b: (calls.append(len(a)), union_find(a, b))[1])
    n = 20_000
    batches = (pa.RecordBatch.from_arrays([pa.array(range(i, i + 50)), pa.array(range(i + 1, i + 51))], ["a", "b"]) for i in range(0, n, 50))
    out = pa.Table.from_batches(C._forest(batches))
    assert out.num_rows == n and set(out["b"].to_pylist()) == {0} and len(calls) <= 12 and sum(calls) <= 5 * n


def test_components_in_bounded_partitions(spark, monkeypatch):
    rng = random.Random(5)
    chain = [(i, i + 1) for i in range(1000, 1200)]
    star = [(5000, 5000 + i) for i in range(1, 300)]  # a third of the pairs at one node
    edges = chain + star + [(rng.randrange(400), rng.randrange(400)) for _ in range(250)] + chain[:9] + [(7, 7), (99999, 99999)]
    want = sorted(brute_groups(edges).items(), key=repr)
    df = spark.createDataFrame([*edges, (None, 3), (3, None)], "a long, b long").repartition(9)
    assert rows(connected_components(df)) == want
    monkeypatch.setattr(C, "MAX_TASK_EDGES", 60)
    assert rows(connected_components(df, 60)) == want  # no single task may hold all: star contractions take over
    assert rows(connected_components(df.limit(0))) == []


def test_address_groups(spark):
    kind = "page_id long, audit_id long, url string, alias_of string, duplicate_of string, component string"
    data = [
        (5, 1, "a", None, "x", "c"), (4, 1, "b", "x", None, "c"), (3, 1, "c", None, None, "c"), (5, 1, "a", None, "x", "c"),
        (9, 2, "b", "a", None, None), (8, 2, "a", None, None, None), (7, 2, "q", "zz", None, None), (6, 3, "b", "b", None, None), (2, 3, "b", None, None, None), (1, 1, None, "a", None, None), (None, 1, "c", "a", None, None),
    ]
    df = spark.createDataFrame(data, kind)
    got = rows(address_groups(df, "page_id", "audit_id", "url", ["alias_of", "duplicate_of"]).select("group_id", "id"))
    assert got == [(2, 2), (2, 6), (4, 4), (4, 5), (8, 8), (8, 9)]
    assert rows(address_groups(df.limit(0), "page_id", "audit_id", "url", ["alias_of", "duplicate_of"])) == []


def test_percentiles_against_brute_force(spark):
    rng = random.Random(2)
    data = []
    for i in range(900):
        g = "hot" if i % 3 == 0 else rng.choice("abc")
        v = rng.choice([rng.expovariate(0.01), 5.0, 5.0, 0.0, 1e12 * rng.random(), 1e-300, float("inf")])
        data.append((g, v, rng.choice([None, 1, 2, 2])))
    data += [("a", None, 1), ("a", float("nan"), 1), ("a", -1.0, 3), ("only-null", None, None), (None, 4.0, 4)]
    df = spark.createDataFrame(data, "g string, v double, w int").repartition(5)
    groups = {"g": F.col("g"), "all": F.lit("all")}
    got = {(r.kind, r.key, r.metric, r.percentile): (r.value, r.n) for r in exact_percentiles(value_parts(df, groups, ["v", "w"]), (1, 50, 90, 99, 100)).collect()}
    want = {}
    for metric, at in (("v", 1), ("w", 2)):
        by = defaultdict(list)
        for r in data:
            x = r[at]
            if x is not None and not math.isnan(x) and x >= 0:
                x = min(float(x), 1.7976931348623157e308)
                by["all", "all"].append(x)
                if r[0] is not None:
                    by["g", r[0]].append(x)
        for (kind, key), xs in by.items():
            xs.sort()
            for p in (1, 50, 90, 99, 100):
                want[kind, key, metric, p] = (xs[max(1, -(-len(xs) * p // 100)) - 1], len(xs))
    assert got == want


def test_percentile_parts_combine(spark):
    df = spark.createDataFrame([("a", float(i % 40), 1) for i in range(100)], "g string, v double, w int")
    whole = exact_percentiles(value_parts(df, {"g": F.col("g")}, ["v"]))
    halves = value_parts(df.where("v < 20"), {"g": F.col("g")}, ["v"]).unionByName(value_parts(df.where("v >= 20"), {"g": F.col("g")}, ["v"]))
    assert rows(exact_percentiles(halves)) == rows(whole)
    assert rows(exact_percentiles(halves.limit(0))) == []


def test_page_parts(spark):
    t = dt.datetime(2025, 1, 1, 23, 59)
    pages = spark.createDataFrame([(1, 1, t, 5.0, 1), (1, 1, t, 5.0, 1), (2, 9, None, 7.0, None)], "page_id long, audit_id long, fetched_at timestamp, response_time_ms double, depth int")
    audits = spark.createDataFrame([(1, 77), (1, 77)], "id long, project_id long")
    got = {(r.kind, r.key, r.metric): (r.value, r.n) for r in exact_percentiles(page_parts(pages, audits), (50,)).collect()}
    assert got[("project", "77", "response_time_ms")] == (5.0, 1) and got[("overall", "all", "response_time_ms")] == (5.0, 2)
    assert got[("day", "2025-01-01", "depth")] == (1.0, 1) and ("audit", "9", "depth") not in got
