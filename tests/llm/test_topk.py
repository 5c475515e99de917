"""Top-k search against all scores."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchflow.llm import topk

VECTORS = "vec_id long, vector array<double>"


def brute(candidates, queries, k):
    asked = {}
    for i, v in queries:
        if i is not None:
            asked[i] = min(asked.get(i, v), v)
    out = []
    for q, v in asked.items():
        scores = [(-sum(a * b for a, b in zip(v, w)), i) for i, w in candidates if i is not None and i != q]
        out += [(q, r + 1, i, int(-s)) for r, (s, i) in enumerate(sorted(scores)[:k])]
    return sorted(out)


@pytest.mark.parametrize("block,shard,rows", [(4, 2, 3), (128, 64, 256)])
def test_equals_all_scores(spark, monkeypatch, block, shard, rows):
    monkeypatch.setattr(topk, "BLOCK_ROWS", block)
    monkeypatch.setattr(topk, "SHARD_BLOCKS", shard)
    monkeypatch.setattr(topk, "QUERY_ROWS", rows)
    rng = random.Random(block)
    vectors = [(i, [float(rng.randrange(-3, 4)) for _ in range(6)]) for i in range(90)]  # many ties
    vectors += [(200 + i, [1.0] * 6) for i in range(10)] + [(None, [9.0] * 6), (300, [2.0] * 4), (301, [])]
    vectors += [(0, [5.0] * 6), (77, vectors[77][1])]  # ids that repeat
    frame = spark.createDataFrame(vectors, VECTORS).repartition(3).withColumn("block", F.lit("x"))
    queries = [(i, v) for i, v in vectors if i is not None and i % 10 == 0]
    got = topk.top_k(frame, frame.filter("vec_id % 10 = 0"), 5).collect()
    assert sorted(map(tuple, got)) == brute(vectors, queries, 5)


def test_few_candidates_and_empty_tables(spark):
    two = spark.createDataFrame([(1, [1.0]), (2, [3.0])], VECTORS)
    none = spark.createDataFrame([], VECTORS)
    assert sorted(map(tuple, topk.top_k(two, two, 5).collect())) == [(1, 1, 2, 3), (2, 1, 1, 3)]
    assert topk.top_k(two, none, 5).count() == 0
    assert topk.top_k(none, two, 5).count() == 0


def test_bounds_leave_blocks_unscored():
    rng = np.random.default_rng(1)
    blocks = [(np.arange(i * 50, i * 50 + 50), np.floor(rng.normal(30 * (i % 10), 3, (50, 8)))) for i in range(40)]
    queries = np.floor(rng.normal(20, 3, (7, 8)))
    number, ids, scores, scored = topk.search_blocks(blocks, np.full(7, -1), queries, 5)
    assert scored < 7 * 40 / 2
    every = np.vstack([m for _, m in blocks])
    for q in range(7):
        want = sorted(((-s, i) for i, s in enumerate(every @ queries[q])))[:5]
        assert sorted(zip((-scores[number == q]).tolist(), ids[number == q].tolist())) == want


def test_what_takes_part(spark):
    rows = [(1, [0.5, -0.001]), (2, None), (3, [1.0, None]), (4, [math.nan, 1.0]), (5, [math.inf, 0.0]), (6, [])]
    frame = spark.createDataFrame(rows, "vec_id long, e array<float>")
    kept = frame.filter(topk.usable(F.col("e"))).select("vec_id", topk.scaled(F.col("e"), 256).alias("v")).collect()
    assert [(r["vec_id"], r["v"]) for r in kept] == [(1, [128.0, -1.0]), (6, [])]
