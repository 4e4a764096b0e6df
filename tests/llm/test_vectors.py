"""Embedding near-dedup against brute force, and its recall at the threshold."""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from servertide.llm import vectors
from servertide.llm.meet import whole_groups
from servertide.llm.vectors import near_duplicates


def brute(rows, threshold=0.93):
    """rows: (id, vector, label). Links between row numbers."""
    def sound(v):
        return v and all(x is not None and math.isfinite(x) for x in v) and any(v)

    links = set()
    for i, (_, v, a) in enumerate(rows):
        for j, (_, w, b) in enumerate(rows[:i]):
            if a is None or a != b or not sound(v) or not sound(w) or len(v) != len(w):
                continue
            x, y = np.array(v, float), np.array(w, float)
            if x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= threshold:
                links.add((j, i))
    return links


def expected(rows):
    links = brute(rows)
    label = list(range(len(rows)))
    for _ in rows:
        for i, j in links:
            label[i] = label[j] = min(label[i], label[j])
    out = []
    for i, (own, _, _) in enumerate(rows):
        ids = [rows[k][0] for k in range(len(rows)) if label[k] == label[i] and rows[k][0] is not None]
        component = min(ids) if ids else own
        out.append((own, sum(i in link for link in links), component, own is not None and own == component))
    return sorted(out, key=repr)


def found(spark, rows, extra=""):
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    if extra:
        table = table.selectExpr("*", *extra.split(";"))
    return sorted(map(tuple, near_duplicates(table).collect()), key=repr)


def test_edge_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (3, [2.0, 0.25], 1), (4, [0.0, 1.0], 1), (5, None, 1), (6, [], 1), (7, [0.0, 0.0], 1),
        (8, [nan, 1.0], 1), (9, [inf, 1.0], 1), (10, [None, 1.0], 1), (11, [1.0, 0.0], 2), (12, [1.0, 0.0], None), (13, [1.0, 0.0], None),
        (14, [1.0, 0.0, 0.0], 1), (15, [-1.0, 0.0], 1), (16, [1e-30, 0.0], 1), (17, [1e30, 0.0], 1), (18, [-0.0, 1.0], 1),
        (2, [1.0, 0.0], 1), (None, [0.0, 1.0], 1),
    ]
    assert found(spark, rows) == expected(rows)
    assert found(spark, rows, "1 AS weight;2 AS class_id;3 AS n_links;4 AS hash") == expected(rows)
    assert found(spark, []) == []


def test_clusters_of_copies(spark):
    random = np.random.default_rng(3)
    rows = []
    for group in range(25):
        centre = random.normal(size=16)
        for _ in range(int(random.integers(1, 12))):
            rows.append((len(rows), [float(np.float32(x)) for x in centre + random.normal(size=16) * 0.05], int(group % 3)))
    rows += [(len(rows) + i, rows[0][1], 0) for i in range(300)]
    assert found(spark, rows) == expected(rows)


def test_recall_at_the_threshold(spark):
    """Pairs at a cosine of 0.93 to 0.95, the hardest ones: at least nine in ten are found, and no false one."""
    random = np.random.default_rng(8)
    rows = []
    for _ in range(400):
        a, noise = random.normal(size=64), random.normal(size=64)
        a /= np.linalg.norm(a)
        noise -= noise @ a * a
        noise /= np.linalg.norm(noise)
        cosine = random.uniform(0.931, 0.95)
        b = cosine * a + math.sqrt(1 - cosine * cosine) * noise
        rows += [(len(rows), a.tolist(), 1), (len(rows) + 1, b.tolist(), 1)]
    true = {r[0]: r[1] for r in expected(rows)}
    got = {r[0]: r[1] for r in found(spark, rows)}
    assert all(got[i] <= true[i] for i in true)
    assert sum(got.values()) >= 0.9 * sum(true.values())


def test_recall_with_many_pivots():
    """Pairs at a cosine of 0.932 among 4,096 pivots, which a table of four million vectors has."""
    random = np.random.default_rng(5)
    a, noise = random.normal(size=(2, 1000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    noise -= (noise * a).sum(1, keepdims=True) * a
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    b = 0.932 * a + math.sqrt(1 - 0.932**2) * noise
    pivots = vectors.choose_pivots(list(random.normal(size=(5000, 64))), vectors.pivots_for(4_194_304, 64))
    assert len(pivots[64][0]) == 4096
    batch = pa.record_batch({
        "class_id": pa.array(range(2000)), "weight": pa.array([1] * 2000), "label": pa.array([0] * 2000),
        "vector": pa.array(list(np.concatenate([a, b])), pa.list_(pa.float64())),
    })
    (out,) = vectors._described(pivots)([batch])
    near = [r.as_py() for r in out.column("nearest")]
    first = vectors.LISTED
    met = sum(bool({*near[k][:first]} & {*near[k + 1000][:first]}) and len({*near[k]} & {*near[k + 1000]}) > 1 for k in range(1000))
    assert met >= 960


def random_lists(spark, rows):
    table = spark.range(rows, numPartitions=8).selectExpr("xxhash64(id) AS class_id", "1L AS weight", "0 AS label", "id")
    normal = "sqrt(-2 * ln(abs(xxhash64(id, {k}) / 9.3e18) + 1e-9)) * cos(xxhash64(id, -{k}) / 2.95e18)"
    return vectors.inverted_lists(table.withColumn("vector", F.array(*(F.expr(f"cast({normal.format(k=k)} AS float)") for k in range(1, 41)))))


def test_comparisons_grow_with_the_rows(spark):
    """Counted in the tasks: fourfold rows give at most 4**1.3 times the pairs."""

    def work(batches):
        for lists in whole_groups(batches):
            yield pa.RecordBatch.from_arrays([pa.array([sum(len(left) for left, _ in vectors.met(lists))])], names=["n"])

    small, large = (random_lists(spark, n).mapInArrow(work, "n long").agg(F.sum("n")).first()[0] for n in (20_000, 80_000))
    assert 0 < small < 20_000 * 500 and large <= small * 4**1.3


def test_pairs_meet_once(spark):
    def work(batches):
        for lists in whole_groups(batches):
            ids = np.asarray(lists.column("class_id"))
            for left, right in vectors.met(lists):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(ids[left], ids[right])), pa.array(np.maximum(ids[left], ids[right]))], names=["a", "b"])

    met = random_lists(spark, 3_000).mapInArrow(work, "a long, b long")
    assert met.count() == met.distinct().count() > 0


def test_crowded_lists(spark, monkeypatch):
    """Lists of many blocks, and rows that meet all with all, give the same."""
    monkeypatch.setattr(vectors, "LIST_CAP", 16)
    random = np.random.default_rng(4)
    centre = random.normal(size=16)
    rows = [(k, (centre + random.normal(size=16) * 0.15).tolist(), 0) for k in range(150)] + [(200 + k, random.normal(size=16).tolist(), k % 2) for k in range(150)]
    assert found(spark, rows) == expected([(i, np.float32(v).tolist(), l) for i, v, l in rows])
