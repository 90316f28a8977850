import random

import numpy as np

from weftgraph.llm import ann, exact_topk
from pyspark.sql import functions as F


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank string, score string")


def vectors(n, dim, seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim)).astype(np.float32)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def brute(rows, is_query, k, score):
    """Per query row: the k best other rows of its length, by score and then id."""
    use = [(i, v) for i, v, *_ in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for at, (q, v) in enumerate(use):
        if is_query(q):
            found = sorted((-score(v, w), c) for to, (c, w) in enumerate(use) if to != at and len(w) == len(v))[:k]
            out += [(q, n + 1, c, -s) for n, (s, c) in enumerate(found)]
    return sorted(out)


def whole_product(v, w):
    return int(np.floor(256 * np.float32(v).astype(float)) @ np.floor(256 * np.float32(w).astype(float)))


def test_exact_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(exact_topk, "SAMPLE", 20)
    x = vectors(700, 24, 1)
    x[100:160] = x[100]  # ties
    x[300:] *= np.linspace(0.05, 3, 400)[:, None]
    rows = [(i, x[i].tolist(), "a", "b") for i in range(700)]
    rows += [(700, None, "", ""), (701, [float("nan")] * 24, "", ""), (702, [None] * 24, "", ""), (703, [], "", ""), (None, x[0].tolist(), "", ""), (704, [float("inf")] + [0.0] * 23, "", "")]
    rows += [(100, x[100].tolist(), "", ""), (100, x[7].tolist(), "", ""), (7, x[8].tolist(), "", "")] + [(i, [1.0 * i, 2.0], "", "") for i in (50, 705, 706, 100, 708, 709, 710)] + [(150, [3.0], "", "")]
    for queries in (2048, 5):
        monkeypatch.setattr(exact_topk, "QUERIES", queries)
        monkeypatch.setattr(exact_topk, "BLOCK", 64)
        got = exact_topk.top_k(frame(spark, rows), F.col("vec_id") % 50 == 0, 5).collect()
        assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == brute(rows, lambda i: i % 50 == 0, 5, whole_product)


def test_envelopes_bound_the_product():
    rng = np.random.default_rng(8)
    q, x = rng.normal(0.3, 1, (40, 30)), rng.normal(-0.2, 2, (50, 30))
    bound = exact_topk.largest(np.stack([exact_topk.envelope(q), exact_topk.envelope(q[:1])]), exact_topk.envelope(x))
    assert bound[0] >= (q @ x.T).max() - 1e-9 and bound[1] >= (q[:1] @ x.T).max() - 1e-9 and bound[1] <= bound[0]


def test_blocks_out_of_reach_are_not_sent(spark, monkeypatch):
    monkeypatch.setattr(exact_topk, "BLOCK", 16)
    largest = exact_topk.largest
    x = vectors(64, 8, 5)
    rows = [(i, (x[i] * (10 if i < 32 else 0.01)).tolist(), "", "") for i in range(64)]
    q = np.abs(x[:1]) * 10
    known = exact_topk.Best(np.array([0]), np.array([0]), q, 2)
    known.add(np.arange(1, 33), np.arange(1, 33), np.abs(x[:32]) * 10)
    far = exact_topk.envelope(x[32:] * 0.01)
    assert largest(exact_topk.envelope(q)[None], far)[0] < known.least.min()
    got = exact_topk.top_k(frame(spark, rows), F.col("vec_id") % 50 == 0, 5).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == brute(rows, lambda i: i % 50 == 0, 5, whole_product)


def test_exact_with_few_and_huge(spark):
    rows = [(0, [1e30, 1.0], "", ""), (1, [1e30, 2.0], "", ""), (2, [-1e30, 0.0], "", "")]
    got = sorted((r["rank"], r["vec_id"], r["score"]) for r in exact_topk.top_k(frame(spark, rows), F.col("vec_id") == 0, 5).collect())
    assert got == [(1, 1, (1 << 63) - 1), (2, 2, -(1 << 63))]
    assert exact_topk.top_k(frame(spark, []), F.col("vec_id") == 0, 5).count() == 0


def test_statistics_bound_the_product():
    x, y = vectors(200, 30, 2).astype(float), vectors(200, 30, 3).astype(float)
    for segments in (1, 4, 7, 30, 64):
        bound = exact_topk.statistics(x, segments) @ exact_topk.statistics(y, segments).T
        assert (bound >= x @ y.T - 1e-9).all()


def recall(spark, n, dim, **options):
    x = vectors(n, dim, 4)
    rows = [(i * 3, x[i].tolist(), "", "") for i in range(n)]
    got = ann.search(frame(spark, rows), lambda ids: ids % 60 == 0, 10, **options).collect()
    s = x.astype(np.float64) @ x.astype(np.float64).T
    hits = 0
    for r in got:
        q, c = r["query_id"] // 3, r["vec_id"] // 3
        assert q != c and abs(r["score"] - s[q, c]) < 1e-12
        hits += s[q, c] >= np.sort(np.delete(s[q], q))[-10] - 1e-12
    assert len(got) == 10 * len(range(0, n, 20))
    return hits / len(got)


def test_recall_over_several_blocks(spark):
    assert recall(spark, 1500, 32, block=300) >= 0.9


def test_ann_edges(spark):
    assert ann.search(frame(spark, []), lambda ids: ids >= 0, 3).count() == 0
    rows = [(0, [1.0, 0.0], "", ""), (1, [1.0, 0.0], "", ""), (2, [0.0, 0.0], "", ""), (3, None, "", ""), (4, [float("nan"), 1.0], "", ""), (5, [0.5, 0.0], "", ""), (5, [0.5, 0.0], "", ""), (6, [1.0], "", "")]
    got = sorted((r["query_id"], r["rank"], r["vec_id"]) for r in ann.search(frame(spark, rows), lambda ids: ids == 0, 3).collect())
    assert got == [(0, 1, 1), (0, 2, 5), (0, 3, 5)]


def test_repeated_ids_and_lengths(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=d).astype(np.float32).tolist(), "", "") for d, ids in ((2, range(100, 130)), (3, range(95, 115)), (7, [100])) for i in ids]
    rows += [(1, [1.0, 0.5], "", ""), (1, [1.0, 0.9], "", ""), (100, rows[0][1], "", "")]
    got = ann.search(frame(spark, rows), lambda ids: ids % 20 == 0, 25).collect()
    want = brute(rows, lambda i: i % 20 == 0, 25, lambda v, w: float(np.float32(v).astype(float) @ np.float32(w).astype(float)))
    assert sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in got) == [(q, k, c, round(s, 9)) for q, k, c, s in want]


def test_walk_is_repeatable(spark):
    random.seed(1)
    x = vectors(400, 16, 9)
    rows = [(i, x[i].tolist(), "", "") for i in range(400)]
    runs = [sorted(map(tuple, ann.search(frame(spark, rows).repartition(p), lambda ids: ids % 40 == 0, 5, block=100).collect())) for p in (2, 5)]
    assert runs[0] == runs[1]
