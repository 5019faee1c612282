"""Vector search against brute force."""

import random

import numpy as np
import pytest

from tidewell.llm import vector_search


def brute(rows, queries, k):
    """query -> [(vec_id, score)], sums from the first component on, every row but those of the query's own id."""
    out = {}
    for q, v in queries:
        scored = [(-sum_in_order(v, w), i) for i, w in rows if i != q]
        out[q] = [(i, -s) for s, i in sorted(scored)[:k]]
    return out


def sum_in_order(a, b):
    total = 0.0
    for x, y in zip(a, b):
        total += float(x) * float(y)
    return total


def found(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    return {q: [of[i] for i in sorted(of)] for q, of in out.items() if sorted(of) == list(range(1, len(of) + 1))}


@pytest.fixture(scope="module")
def rows():
    """Clusters with noise, of different norms; copies of one vector, and vectors that tie in integers."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 24))
    points = np.float32(centres[rng.integers(0, 12, 3000)] + 0.5 * rng.normal(size=(3000, 24))) * np.float32(rng.uniform(0.5, 2, (3000, 1)))
    rows = [(i, [float(x) for x in p]) for i, p in enumerate(points)]
    rows += [(4000 + i, rows[7][1]) for i in range(90)]
    return rows + [(5000 + i, [float(i % 3), 1.0, *[0.0] * 22]) for i in range(60)]


def test_recall_and_exact_scores(spark, rows):
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, low string, rank int").repartition(5)
    queries = [r for r in rows if r[0] % 20 == 0]
    got = found(vector_search.search(docs, docs.where("vec_id % 20 = 0").selectExpr("vec_id as query_id", "embedding", "low"), leaf_rows=32, block_rows=40))
    want = brute(rows, queries, 20)
    assert got.keys() == want.keys() and all(len(x) == 20 for x in got.values())
    vectors = dict(rows)
    assert all(score == sum_in_order(vectors[q], vectors[i]) and i != q for q, of in got.items() for i, score in of)
    assert all(of == sorted(of, key=lambda x: (-x[1], x[0])) for of in got.values())
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want]) > 0.93


def test_small_and_odd_tables(spark, tmp_path):
    nan, inf, rng = float("nan"), float("inf"), random.Random(1)
    good = [(20 * i, [rng.choice([-1.0, 0.0, 1.0, 2.0]) for _ in range(3)] + [1.0]) for i in range(9)]
    odd = [(100001, None), (100020, [0.0] * 4), (100040, [1.0, None, 1.0, 1.0]), (100060, [nan, 1.0, 1.0, 1.0]), (100080, [inf, 1.0, 1.0, 1.0]), (None, [1.0] * 4), (100100, [1.0] * 5), (100120, [])]
    schema = "vec_id long, embedding array<float>, label int"
    spark.createDataFrame([(*r, 1) for r in good + odd], schema).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert found(vector_search.op13_vector_search(spark, str(tmp_path))) == brute(good, good, 20)
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/none/embeddings.parquet")
    assert vector_search.op13_vector_search(spark, f"{tmp_path}/none").count() == 0
