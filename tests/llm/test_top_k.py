import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from segtable.llm import topk


def brute(rows, k=5):
    ok = {}
    for i, v in sorted((r for r in rows if r[0] is not None and r[1]), key=lambda r: (r[0], r[1] is None)):
        if all(x is not None and np.isfinite(x) for x in v):
            ok.setdefault(i, []).append([int(np.floor(256 * float(np.float32(x)))) for x in v])
    out = []
    for q in sorted(ok):
        if q % 50:
            continue
        mine = min(ok[q])
        scored = sorted(((-sum(a * b for a, b in zip(mine, v, strict=True)), i) for i, vs in ok.items() if i != q for v in vs if len(v) == len(mine)))[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)]
    return sorted(out)


@pytest.mark.parametrize("sizes", [dict(), dict(query_bytes=96, shard_bytes=1280, fan=2)])
def test_top_k(spark, sizes):
    rng = random.Random(6)
    rows = [(k, [rng.choice([-1.5, 0.25, 0.3, 1.0]) for _ in range(4)], "x") for k in range(400)]
    rows += [(None, [1.0] * 4, "x"), (500, None, "x"), (550, [1.0, None, 1.0, 1.0], "x"), (551, [float("nan")] * 4, "x"), (552, [float("inf")] * 4, "x"), (600, [], "x"), (650, [1.0, 2.0], "x"), (651, [1.0, 2.0], "x"), (7, rows[7][1], "x"), (-50, [9.0] * 4, "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, key string").repartition(3)
    got = sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") % 50 == 0, **sizes).collect())
    assert got == brute([r[:2] for r in rows])
    assert topk.top_k(df.where("false"), F.col("vec_id") % 50 == 0).count() == 0
    two = df.where("vec_id in (0, 1)")
    assert topk.top_k(two, F.col("vec_id") % 50 == 0).count() == 1


@pytest.mark.parametrize("sizes", [dict(), dict(query_bytes=8, shard_bytes=64, fan=2)])
def test_large_components(spark, sizes):
    """Components and scores of any size are compared exactly; scores beyond a long are given as the nearest."""
    rng = random.Random(8)
    big = [0.5, -3.0, 1e17, -1e17, 1e17 + 64, 2.0**200, -(2.0**200), 1e306, 3e15]
    rows = [(k, [rng.choice(big) for _ in range(3)]) for k in range(0, 200, 5)] + [(1000 + k, [float(rng.randrange(-9, 9)) for _ in range(3)]) for k in range(30)]
    rows += [(50, [1e17, 1.0, 2.0]), (50, [1.0, 1.0, 2.0]), (7, [float("inf"), 1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") % 50 == 0, **sizes).collect())
    whole = lambda x: int(x) * 256 if abs(x) >= 2.0**53 else int(np.floor(x * 256))
    ok = [(i, [whole(x) for x in v]) for i, v in rows if all(map(np.isfinite, v))]
    want = []
    for q in sorted({i for i, _ in ok if i % 50 == 0}):
        mine = min(v for i, v in ok if i == q)
        scored = sorted((-sum(a * b for a, b in zip(mine, v, strict=True)), i) for i, v in ok if i != q)[:5]
        want += [(q, n + 1, i, max(-(2**63), min(2**63 - 1, -s))) for n, (s, i) in enumerate(scored)]
    assert got == want


def test_copies_go_in_bounded_batches():
    some = list(topk.bounded(((k, k, b"x" * 10) for k in range(100)), 35))
    assert max(map(len, some)) == 3 and sum(map(len, some)) == 100


@pytest.mark.parametrize("sizes", [dict(), dict(query_bytes=8, shard_bytes=8, fan=2)])
def test_empty_and_clashing(spark, sizes):
    """Nothing, nothing usable, and columns named like the letters', through all levels."""
    schema = "vec_id long, embedding array<float>, src string, payload int, rank string, score double, query_id int"
    rows = [(k, v, "a", 1, "b", 0.5, 7) for k, v in enumerate([None, [], [None], [float("nan")]])]
    for some in ([], rows, [(0, [1.0, 2.0], "a", 1, "b", 0.5, 7)]):
        assert topk.top_k(spark.createDataFrame(some, schema), F.col("vec_id") % 50 == 0, **sizes).count() == 0
    some = [(k, [float(k % 3), 1.0], "a", 1, "b", 0.5, 7) for k in range(60)]
    got = sorted(tuple(r) for r in topk.top_k(spark.createDataFrame(some, schema), F.col("vec_id") % 50 == 0, **sizes).collect())
    assert got == brute([r[:2] for r in some])
