"""Inverted lists give the exact nearest vectors."""

import numpy as np
import pytest

from lexmill.operators import vector_index
from lexmill.operators.vector_index import VectorIndex


def made(seed, n, size=8, groups=6):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, size)) * 3
    return [(int(i), [float(x) for x in centres[i % groups if i % 3 else 0] + rng.normal(size=size) * 0.3]) for i in range(n)]  # a third in one group and more


def exact(rows, asked, k):
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v in rows if v is not None and None not in v and np.isfinite(v).all() and np.linalg.norm(v) > 0}
    out = set()
    for q in asked:
        if q in unit:
            near = sorted(((-round(float(unit[q] @ u), 9), i) for i, u in unit.items() if i != q))[:k]
            out |= {(q, i, r + 1) for r, (_, i) in enumerate(near)}
    return out


@pytest.mark.parametrize(("n", "k", "sample", "piece"), [(1500, 5, 20_000, 2048), (900, 3, 200, 10), (7, 10, 100, 2048)])
def test_exact(spark, tmp_path, monkeypatch, n, k, sample, piece):
    monkeypatch.setattr(vector_index, "PIECE", piece)
    monkeypatch.setattr(vector_index, "BLOCK", 16)
    monkeypatch.setattr(vector_index, "RING", 20)
    rows = made(n, n) + [(10_000, rows0) for rows0 in ([0.0] * 8, None, [float("nan")] * 8, [1.0] * 7 + [None])]
    rows = [(i if v is not None else 10_001, v) for i, v in rows]
    frame = spark.createDataFrame(rows, "id long, v array<double>")
    index = VectorIndex.build(frame, "id", "v", str(tmp_path / "ix"), sample)
    asked = [i for i, _ in rows if i % 20 == 0]
    got = index.search(frame.where("id % 20 = 0"), "id", "v", k, str(tmp_path / "s")).collect()
    assert {(r["query_id"], r["id"], r["rank"]) for r in got} == exact(rows, asked, k)
    share = index.share_read(str(tmp_path / "s"))
    assert 0 < share <= 1
    if n == 1500:
        assert share < 0.6, share


def test_ties_and_empty_tables(spark, tmp_path):
    rows = [(i, [1.0, float(i % 2)]) for i in range(40)]  # two directions only
    frame = spark.createDataFrame(rows, "id long, v array<float>")
    index = VectorIndex.build(frame, "id", "v", str(tmp_path / "ix"))
    got = index.search(frame.where("id < 2"), "id", "v", 3, str(tmp_path / "s")).collect()
    assert sorted((r["query_id"], r["rank"], r["id"]) for r in got) == [(0, 1, 2), (0, 2, 4), (0, 3, 6), (1, 1, 3), (1, 2, 5), (1, 3, 7)]
    none = VectorIndex.build(frame.limit(0), "id", "v", str(tmp_path / "none"))
    assert none.search(frame, "id", "v", 3, str(tmp_path / "n")).collect() == []


def test_the_sample_is_drawn_in_the_tasks(spark):
    """Rows that reach the driver for the centroids follow the sample, not the number of tasks, and are the same ones."""
    from pyspark.sql import functions as F

    units = spark.range(5000).select("id", F.array(F.col("id").cast("double")).alias("u")).repartition(16)
    some = vector_index.drawn(units, 100)
    first = lambda df: [r["id"] for r in df.orderBy(F.xxhash64("id"), "id").limit(100).collect()]
    assert 100 <= some.count() <= 300 and first(some) == first(units)
    assert vector_index.drawn(units.withColumn("id", F.lit(1)), 100).count() == 5000
