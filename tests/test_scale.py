"""Operators whose point is scale: heavy hitters, and levels of visited keys."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sitegrain import tables
from sitegrain.operators import heavy, visited


def brute_top(values, most):
    counts, first = Counter(v for _, v in values if v is not None), {}
    for seq, v in sorted(values):
        first.setdefault(v, seq)
    return sorted(counts.items(), key=lambda x: (-x[1], first[x[0]]))[:most]


@pytest.mark.parametrize("case", ["skewed", "equal", "adversarial", "few", "empty", "nulls"])
def test_top_counts(spark, monkeypatch, case):
    """Summaries of 16 values over up to 3000 distinct ones, in orders that are bad for them: the top is exact."""
    draw = random.Random(1)
    values = {
        "skewed": [f"v{int(draw.paretovariate(0.7))}" for _ in range(8000)],
        "equal": [f"v{i % 3000}" for i in range(9000)],
        "adversarial": [x for i in range(700) for x in ("late" if i > 600 else f"u{i}", *(f"n{i}-{k}" for k in range(4)))] + ["late"] * 3,
        "few": ["a", "b", "b"], "empty": [], "nulls": [None, "x", None, None],
    }[case]
    if case == "skewed":
        draw.shuffle(values)
    rows = list(enumerate(values))
    monkeypatch.setattr(heavy, "WIDEST", 1024)
    table = spark.createDataFrame(rows, "seq long, v string").repartition(5, "seq")
    found = heavy.top_counts(table, "v", 2 if case != "equal" else 5, width=16).collect()
    assert [(r.v, r.n) for r in found] == brute_top(rows, 2 if case != "equal" else 5)


@pytest.mark.parametrize("seed", range(20))
def test_no_value_counts_more_than_its_bound(seed):
    """Merged in any shape, a summary's counts and its lack bound each value from both sides."""
    draw = random.Random(seed)
    values = [f"v{int(draw.paretovariate(0.5)) % 500}" for _ in range(3000)]
    parts = [heavy.Summary(10).add(Counter(values[i : i + 150])).narrow() for i in range(0, 3000, 150)]
    while len(parts) > 1:
        a, b = parts.pop(draw.randrange(len(parts))), parts.pop(draw.randrange(len(parts)))
        parts.append(heavy.Summary(10).add(a.counts, a.lack).add(b.counts, b.lack).narrow())
    (whole,) = parts
    assert len(whole.counts) <= 10 and whole.lack <= len(values) / 11
    for v, n in Counter(values).items():
        assert whole.counts[v] <= n <= whole.counts[v] + whole.lack


def test_levels_of_visited_keys(spark, monkeypatch):
    """Only what was visited, and few others, reaches the exact join; a hot key is dealt out; nothing is lost."""
    monkeypatch.setattr(tables, "HOT_ROWS", 100)
    seen = visited.Visited(spark, parts=7)
    keys = spark.createDataFrame([("hot",), (None,)], "key string").unionByName(spark.range(6000).selectExpr("concat('k', id) AS key"))
    rows = spark.range(6000, 10_000).selectExpr("id", "concat('k', id) AS key").unionByName(spark.range(500).selectExpr("id", "concat('k', id * 3) AS key")).unionByName(spark.range(800).selectExpr("id", "'hot' AS key")).unionByName(spark.range(700).selectExpr("id", "'warm' AS key")).unionByName(spark.range(3).selectExpr("id", "cast(null as string) AS key"))
    assert seen.unseen(rows).count() == rows.count()
    seen.add(keys.where("key < 'k3'"))
    seen.add(keys.where("key >= 'k3' or key is null"))
    seen.add(keys.limit(0))
    got = Counter(map(tuple, seen.unseen(rows).collect()))
    known = {r.key for r in keys.collect()}
    assert got == Counter(tuple(r) for r in rows.collect() if r.key is None or r.key not in known)
    hot = tables.hot_keys(rows.where("key is not null").groupBy("key").agg(F.count("*").alias("_n")), rows.count())
    assert {r.key for r in hot.collect()} == {"hot", "warm"}
    tested = seen.tested(rows, hot)
    assert tested.where("key = 'warm'").select(F.spark_partition_id()).distinct().count() > 1
    reach = tested.where("maybe").groupBy("key").count().count()
    assert 501 <= reach <= 501 + 4001 * 0.02
