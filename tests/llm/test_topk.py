import random

from comarca.llm import topk

SCHEMA = "vec_id long, embedding array<float>, label int, score double, rank int"


def expected(vectors, asked, k):
    import math

    import numpy as np

    whole = []
    for i, v in vectors:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v):
            whole.append((i, [math.floor(1024 * float(np.float32(x))) for x in v]))
    out = []
    for q, v in [w for w in whole if w[0] in asked]:
        scored = [(sum(a * b for a, b in zip(v, u, strict=True)), i) for i, u in whole if i != q and len(u) == len(v)]
        for n, (s, i) in enumerate(sorted(scored, key=lambda t: (-t[0], t[1]))[:k]):
            out.append((q, n + 1, i, s))
    return sorted(out, key=repr)


def table(n, dim, seed, spread=1.0):
    draw = random.Random(seed)
    return [(i, [draw.gauss(0, spread) for _ in range(dim)]) for i in range(n)]


def run(spark, rows, vectors, k=10, **settings):
    df = spark.createDataFrame([(i, v, 0, 0.0, 1) for i, v in vectors], SCHEMA).repartition(3)
    return rows(topk.search(df, df.where("vec_id % 20 = 0"), k), "query_id", "rank", "vec_id", "score")


def test_against_brute_force(spark, rows):
    vectors = table(400, 12, 1)
    assert run(spark, rows, vectors) == expected(vectors, set(range(0, 400, 20)), 10)


def test_ties_repeats_and_invalid_vectors(spark, rows):
    vectors = [(i, [float(i % 3), 1.0]) for i in range(60)] + [(7, [1.0, 1.0]), (20, [9.0, 9.0])]
    vectors += [(100, None), (101, []), (102, [1.0, None]), (103, [float("nan"), 1.0]), (104, [float("inf"), 0.0])]
    vectors += [(None, [1.0, 1.0]), (120, [1.0, 2.0, 3.0]), (121, [1e9, 1e9, -1e9]), (122, [-1e9, 1e9, 3.0])]
    asked = {0, 20, 40, 100, 120}
    assert run(spark, rows, vectors, 5) == expected(vectors, asked, 5)


def test_few_candidates_and_empty(spark, rows):
    assert run(spark, rows, [(0, [1.0]), (1, [2.0])]) == [(0, 1, 1, 2048 * 1024)]
    assert run(spark, rows, [(0, [1.0])]) == []
    df = spark.createDataFrame([], SCHEMA)
    assert topk.search(df, df).collect() == []


def test_queries_in_several_passes(monkeypatch, spark, rows):
    monkeypatch.setattr(topk, "QUERY_BYTES", 100)
    vectors = table(200, 4, 2)
    assert run(spark, rows, vectors, 3) == expected(vectors, set(range(0, 200, 20)), 3)


def test_few_exact_vectors_are_read(spark):
    df = spark.createDataFrame([(i, v, 0, 0.0, 1) for i, v in table(4000, 16, 3)], SCHEMA).repartition(4)
    asked = topk.settle(topk.packed(df.where("vec_id % 400 = 0")).withColumn("query", topk.F.col("vec_id")), "asked")
    file = topk.index_of(df)
    assert "body" not in file.cells.columns and "embedding" not in file.cells.columns
    found = topk.candidates(file, asked, 10)
    read = topk.read_in_order(file, asked, found, 10)
    assert 100 <= read.count() <= found.count() < 0.1 * 10 * 4000


def test_scores_beyond_64_bits_keep_their_rank(spark, rows):
    vectors = [(0, [3e9, 1.0]), (1, [3e9, 2.0]), (2, [3e9, 2.0]), (3, [-3e9, 0.0]), (4, [1.0, 1.0]), (5, [3e30, 0.0])]
    full = expected(vectors, {0}, 5)
    assert [r[2] for r in full] == [5, 1, 2, 4, 3]
    fits = lambda s: s if -(1 << 63) <= s < 1 << 63 else None
    assert run(spark, rows, vectors, 5) == [(q, n, i, fits(s)) for q, n, i, s in full]


def test_cells_bound_the_scores():
    import numpy as np

    draw = np.random.default_rng(0)
    for dim, scale in ((1, 3), (5, 1e3), (7, 1e12)):
        body = np.floor(draw.normal(0, scale, (300, dim)))
        low, width, codes = topk.cells_of(body)
        assert (topk.unpack(topk.pack(codes), len(body), dim) == codes).all()
        lower, upper = topk.bounds_of(body[:20], low, width, codes)
        scores = body[:20] @ body.T
        assert (lower <= scores).all() and (scores <= upper).all()
