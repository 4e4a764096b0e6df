"""Pairs in bounded groups, stars and components against plain Python."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from servertide.llm.components import components
from servertide.llm.meet import KEY, compare, stars


def plain_components(links):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


@pytest.mark.parametrize("cap", [1, 3, 7, 1000])
def test_every_two_rows_of_a_key_meet_once(spark, cap):
    random.seed(cap)
    rows = [(i, random.choice([1, 1, 1, 2, 3, i])) for i in range(60)]
    postings = spark.createDataFrame(rows, f"id long, {KEY} long")

    def judge(table):
        ids = np.asarray(table.column("id"))

        def links(left, right):
            yield pa.RecordBatch.from_arrays([pa.array(ids[left]), pa.array(ids[right])], names=["a", "b"])

        return links

    for most in (5, 10_000):
        met = [tuple(sorted(r)) for r in compare(postings, "id", cap, most, judge, "a long, b long").collect()]
        assert sorted(met) == sorted((a, b) for a, k in rows for b, m in rows if a < b and k == m)


def test_stars_keep_components():
    random.seed(5)
    links = [(random.randint(-50, 50), random.randint(-50, 50)) for _ in range(60)]
    a, b = (np.array(x) for x in zip(*links))
    assert {x: y for x, y in plain_components(zip(*(x.tolist() for x in stars(a, b)))).items()} == {
        x: y for x, y in plain_components(links).items() if len([z for z in plain_components(links).values() if z == y]) > 1
    }


@pytest.mark.parametrize("links", [
    [], [(1, 1)], [(1, 2), (2, 1), (1, 2)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 40)],
    [(i, j) for i in range(0, 30, 3) for j in range(1, 30, 4)] + [(100, -5), (None, 3), (3, None)],
])
def test_components(spark, links):
    found = components(spark.createDataFrame(links, "a long, b long")).collect()
    expected = plain_components((a, b) for a, b in links if a is not None and b is not None and a != b)
    groups, plain = {}, {}
    for r in found:
        groups.setdefault(r.root, set()).add(r.node)
    for x, y in expected.items():
        plain.setdefault(y, set()).add(x)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, plain.values()))
