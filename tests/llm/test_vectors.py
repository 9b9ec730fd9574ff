import duckdb
import numpy as np
import pytest

from geoquilt.llm import near_vectors, topk

SCHEMA = "vec_id long, embedding array<float>, rep int, n int"


def vectors(seed=0, n=260, dims=12):
    r = np.random.Generator(np.random.PCG64(seed))
    rows = []
    for i in range(n):
        x = r.normal(size=dims)
        if i > 10 and r.random() < 0.5:
            x = np.array(rows[r.integers(10, i)][1]) * r.uniform(0.5, 2) + r.normal(size=dims) * r.choice([0.0, 0.1, 0.2, 0.35])
        rows.append((i * 5, x.astype(np.float32).tolist()))
    dead = [(3, None), (4, [0.0] * dims), (6, [float("nan")] + [1.0] * (dims - 1)), (7, [float("inf")] + [1.0] * (dims - 1)), (8, [None] + [1.0] * (dims - 1)), (9, [1.0]), (None, rows[0][1]), (11, [])]
    return rows, dead


def brute(rows, t):
    x = np.array([v for _, v in rows], np.float64)
    u = np.linalg.norm(x, axis=1)
    link = (x @ x.T) / np.outer(u, u) >= t
    np.fill_diagonal(link, False)
    label = np.arange(len(rows))
    while True:
        new = np.array([min([label[i], *label[link[i]]]) for i in range(len(rows))])
        if (new == label).all():
            break
        label = new
    return {rows[i][0]: (int(link[i].sum()), rows[label[i]][0], bool(label[i] == i)) for i in range(len(rows))}


def frame(spark, rows):
    return spark.createDataFrame([(*x, 1, 2) for x in rows], SCHEMA).repartition(3)


def test_near_duplicates(spark):
    for blocks, tile in ((4, 8192), (3, 40)):
        rows, dead = vectors(blocks)
        got = near_vectors.near_duplicates(frame(spark, rows + dead), 0.9, blocks, tile).collect()
        want = brute(rows, 0.9) | {i: (0, i, i is not None) for i, _ in dead}
        assert {x[0]: tuple(x[1:]) for x in got} == want and len(got) == len(want)
    assert near_vectors.near_duplicates(frame(spark, dead)).count() == len(dead)
    assert near_vectors.near_duplicates(frame(spark, rows).limit(0)).count() == 0
    twice = {tuple(x) for x in near_vectors.near_duplicates(frame(spark, [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0])])).collect()}
    assert twice == {(1, 1, 1, True), (2, 1, 1, False)}


def test_top_k(spark):
    rows, dead = vectors(5)
    rows += [(5000 + 7 * i, [0.25] * 12) for i in range(15)]
    df = frame(spark, rows + dead + rows[:3])
    got = sorted(map(tuple, topk.top_k(df, shard=50, query_block=2).collect()))
    x = np.floor(np.array([v for _, v in rows], np.float32).astype(np.float64) * 1024).astype(np.int64)
    ids = np.array([i for i, _ in rows])
    want = []
    for i in np.flatnonzero(ids % 100 == 0):
        s = x @ x[i]
        order = [j for j in np.lexsort((ids, -s)) if j != i][:10]
        want += [(int(ids[i]), r + 1, int(ids[j]), int(s[j])) for r, j in enumerate(order)]
    assert got == sorted(want)
    assert topk.top_k(df.limit(0)).count() == 0


def test_top_k_of_mixed_lengths_equals_sql(spark):
    rows, dead = vectors(6, 120)
    rows += dead + [(100 * i + 1000, [0.5 * i, -0.25, 1.0]) for i in range(4)] + [(200 * i, [0.5, float(i)]) for i in range(3)] + [(300, [])]
    spark.createDataFrame([(i, v) for i, v in rows], "vec_id long, embedding array<float>").coalesce(1).createOrReplaceTempView("vectors_of_lengths")
    embeddings = spark.table("vectors_of_lengths").toArrow()  # noqa: F841
    got = sorted(map(tuple, topk.top_k(spark.table("vectors_of_lengths")).collect()))
    assert got == sorted(duckdb.sql(topk.ORACLE).fetchall()) and {x[0] for x in got} >= {1000, 400}
    with pytest.raises(ValueError, match="64 bits"):
        topk.top_k(spark.createDataFrame([(0, [1e9, 0.0]), (1, [1e9, 1.0])], "vec_id long, embedding array<double>"))


def test_near_vectors_of_mixed_lengths_and_scales(spark):
    rows = [(1, [1.0, 0.0, 0.0]), (2, [0.9, 0.1, 0.0]), (3, [1.0, 0.0]), (4, [0.0, 1.0]), (5, [1.0, 0.01]), (6, [1e200, 0.0]), (7, [1e-200, 1e-203]), (8, [0.0, 5e-324])]
    got = {tuple(x) for x in near_vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {(1, 1, 1, True), (2, 1, 1, False), (3, 3, 3, True), (5, 3, 3, False), (6, 3, 3, False), (7, 3, 3, False), (4, 1, 4, True), (8, 1, 4, False)}


def test_threshold_stops_early():
    r = np.random.Generator(np.random.PCG64(1))
    x = r.integers(0, 50, (5000, 3))
    x[7] = 900
    lists = topk.Lists(np.arange(5000), x)
    ids, scores = lists.top(np.array([1, 2, 0]), -1, 1, 4)
    assert ids.tolist() == [7] and scores.tolist() == [2700]


def test_oracle_runs():
    embeddings = duckdb.sql("select 0::BIGINT as vec_id, [0.5::FLOAT, -0.1] as embedding union all select 1, [0.3::FLOAT, 0.2]")  # noqa: F841
    assert duckdb.sql(topk.ORACLE).fetchall() == [(0, 1, 1, 512 * 307 + -103 * 204)]
