import collections

import numpy as np
import pytest

from geoquilt.llm import hnsw

SCHEMA = "vec_id long, embedding array<float>, score int, v int"


def frame(spark, rows):
    return spark.createDataFrame([(*x, 1, 2) for x in rows], SCHEMA).repartition(3)


def brute(rows, k=10, every=100):
    """Every query's k nearest by comparing it with all rows."""
    good = [(i, np.array(v, np.float32).astype(np.float64)) for i, v in rows if i is not None and v is not None and len(v) and None not in v and np.isfinite(v).all() and np.any(np.array(v))]
    out = {}
    for i in {i for i, _ in good if i % every == 0}:
        best = {}
        for q in (v for j, v in good if j == i):
            for j, v in good:
                if j != i and len(v) == len(q):
                    best[j] = min(best.get(j, np.inf), float(np.sqrt(((v - q) ** 2).sum())))
        out[i] = sorted(best.items(), key=lambda x: (x[1], x[0]))[:k]
    return out


def answers(df):
    got = collections.defaultdict(list)
    for x in sorted(df.collect()):
        got[x.query_id].append((x.vec_id, x.score))
        assert x["rank"] == len(got[x.query_id])
    return got


def equal(got, want):
    assert set(got) == {i for i, x in want.items() if x}
    for i, x in got.items():
        assert [j for j, _ in x] == [j for j, _ in want[i]] and np.allclose([d for _, d in x], [d for _, d in want[i]], rtol=1e-12)


def points(n, dims, seed):
    return np.random.Generator(np.random.PCG64(seed)).normal(size=(n, dims)).astype(np.float32)


def test_recall_and_exact_scores(spark):
    rows = [(i * 5, v.tolist()) for i, v in enumerate(points(3000, 24, 1))]
    want = brute(rows)
    got = answers(hnsw.nearest(frame(spark, rows), shard=800))
    hits = sum(len({j for j, _ in got[i]} & {j for j, _ in x}) for i, x in want.items())
    assert hits >= 0.95 * sum(map(len, want.values())) and all(len(got[i]) == 10 for i in want)
    real = dict(rows)
    for i, x in got.items():
        q = np.array(real[i], np.float32).astype(np.float64)
        assert all(d == pytest.approx(float(np.sqrt(((np.array(real[j], np.float32) - q) ** 2).sum())), rel=1e-12) for j, d in x)


def test_odd_rows(spark):
    rows = [(i * 50, v.tolist()) for i, v in enumerate(points(60, 6, 2))]
    dead = [(3, None), (4, [0.0] * 6), (200, [float("nan")] + [1.0] * 5), (7, [float("inf")] + [1.0] * 5), (8, [None] + [1.0] * 5), (None, rows[0][1]), (11, [])]
    rows += [(10_000 + 25 * i, [0.5] * 6) for i in range(40)] + rows[:3] + [(100, [9.0] * 6), (150, rows[2][1]), (300, [1.0, 2.0]), (301, [1.0, 2.5]), (400, [3.0]), (20_000, [3e38] * 6), (20_001, [1e-38] * 6)]
    equal(answers(hnsw.nearest(frame(spark, rows + dead), keep=128)), brute(rows + dead))
    assert hnsw.nearest(frame(spark, dead)).count() == 0
    assert hnsw.nearest(frame(spark, rows).limit(0)).count() == 0


def test_many_copies_of_one_vector(spark):
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(900)] + [(1000 + i, v.tolist()) for i, v in enumerate(points(300, 3, 4))]
    equal(answers(hnsw.nearest(frame(spark, rows), shard=200)), brute(rows))


def test_graph_survives_its_table(spark):
    rows = [(i, v.tolist()) for i, v in enumerate(points(700, 8, 3))]
    vectors = hnsw._vectors(frame(spark, rows), "vec_id", "embedding")
    table = hnsw.index(vectors, shard=10_000, links=4).toArrow()
    graph, ids = hnsw.loaded(table, 4)
    order, built = hnsw.built(np.array([v for _, v in rows], np.float64)[[i for i, _ in rows]], 4, 40)
    assert sorted(i for x in ids for i in x) == list(range(700)) and len(graph.links) == len(built.links) > 2
    assert all((a == b).all() for a, b in zip(graph.links, built.links)) and [x[0] for x in ids] == order.tolist()
    for k, x in enumerate(graph.links):
        used = x[x >= 0]
        assert used.max(initial=0) < len(x) and x.shape[1] == (8 if k == 0 else 4)
