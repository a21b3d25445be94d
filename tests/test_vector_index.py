"""The vector index against brute force."""

import pickle

import numpy as np
import pytest

from quern.operators.vector_index import VectorIndex

SCHEMA = "id long, embedding array<double>"


def exact(v, q, k):
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    return np.argsort(-(u[q] @ u.T), axis=1)[:, :k]


def clustered(n, dim, seed=1):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(n // 20, dim))[rng.integers(0, n // 20, n)] + 0.7 * rng.normal(size=(n, dim))


@pytest.mark.parametrize("dim, make", [(64, "clusters"), (384, "clusters"), (1024, "clusters"), (64, "noise")])
def test_recall_against_all_rows(spark, rows, tmp_path, dim, make):
    n = 3_000 if dim < 1000 else 1_500
    v = clustered(n, dim) if make == "clusters" else np.random.default_rng(2).normal(size=(n, dim))
    table = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], SCHEMA).repartition(4)
    index = VectorIndex(spark, f"{tmp_path}/i").build(table)
    asked = list(range(0, n, 20))
    got = {}
    for r in index.nearest(table.where("id % 20 = 0").withColumnRenamed("id", "query_id"), 10).collect():
        got.setdefault(r.query_id, set()).add(r.id)
    recall = np.mean([len(got[q] & set(want.tolist())) / 10 for q, want in zip(asked, exact(v, asked, 10))])
    print(dim, make, "recall", recall, "cells asked", index.versions.newest()[1]["probes"], "of", len(index.versions.newest()[1]["centres"]))
    assert recall >= 0.9


def test_all_pairs_within_an_angle_and_rows_without_a_direction(spark, rows, tmp_path, monkeypatch):
    v = clustered(400, 16, 3)
    v[7] = v[8] = v[9]
    odd = [(None, v[9].tolist()), (1000, None), (1001, []), (1002, [0.0] * 16), (1003, [float("nan")] * 16), (1004, [1.0] * 3), (1005, [None] * 16)]
    table = rows("id long, embedding array<double>, cell int", *[(k, x.tolist(), 1) for k, x in enumerate(v)], *[(*r, 1) for r in odd]).repartition(3)
    index = VectorIndex(spark, f"{tmp_path}/i").build(table, 25)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    near = u @ u.T >= 0.8 - 1e-12
    asked = table.where("id < 400").withColumnRenamed("id", "query_id")
    monkeypatch.setattr("quern.operators.vector_index.BLOCK_BYTES", 16 * 8 * 150)  # three blocks of queries
    found = index.within(asked, 0.8).collect()
    assert {(r.query_id, r.id) for r in found if r.id is not None} == {(int(a), int(b)) for a, b in zip(*np.nonzero(near))}
    assert {r.query_id for r in found if r.id is None} == set(np.flatnonzero(near[9]).tolist()) and len(found) == near.sum() + near[9].sum()
    top = index.nearest(asked.where("query_id = 9"), 3, probes=25).orderBy("rank").collect()
    assert [r.similarity for r in top] == [1.0] * 3 and VectorIndex(spark, f"{tmp_path}/none").build(table.where("id = 1000")).nearest(asked).count() == 0
    plan = index.nearest(asked.where("query_id = 9"), 3, probes=1)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan.replace("isnotnull(cell", "cell")


def test_what_tasks_get_does_not_grow_with_the_cells(spark, tmp_path, monkeypatch):
    """Lists of each query's cells took queries times cells; a task needs queries and centres."""
    v = np.random.default_rng(5).normal(size=(600, 16))
    table = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], SCHEMA).repartition(2)
    index = VectorIndex(spark, f"{tmp_path}/i").build(table, 200)
    sent, send = [], spark.sparkContext.broadcast
    monkeypatch.setattr(spark.sparkContext, "broadcast", lambda x: sent.append(len(pickle.dumps(x))) or send(x))
    monkeypatch.setattr("quern.operators.vector_index.MOST_COSINES", 1000, raising=False)  # several slices
    asked = table.withColumnRenamed("id", "query_id")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    found = index.within(asked, 0.45).select("query_id", "id").collect()
    assert {tuple(r) for r in found} == {(int(a), int(b)) for a, b in zip(*np.nonzero(u @ u.T >= 0.45))} and len(found) == len(set(found))
    assert index.nearest(asked, 3, probes=200).count() == 3 * 600
    assert max(sent) < 2 * (600 + 200) * 16 * 8
