"""Hard negatives against all scores."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchflow.llm import negatives

ROWS = "vec_id long, label int, vector array<double>"


def brute(rows, anchors, k=5):
    rows = [r for r in rows if None not in r]
    asked = {}
    for i, label, v in (a for a in anchors if None not in a):
        asked[i] = min(asked.get(i, (label, v)), (label, v))
    out = []
    for a, (label, v) in asked.items():
        scored = sorted((-sum(x * y for x, y in zip(v, w)), i, other == label) for i, other, w in rows if i != a)
        for s, p, _ in [x for x in scored if x[2]][:k]:
            fits = [(t, i) for t, i, same in scored if not same and 80 * -s <= 100 * -t <= 100 * -s][:k]
            out += [(a, p, r + 1, i, int(-s), int(-t)) for r, (t, i) in enumerate(fits)]
    return sorted(out)


def vectors(n, seed, spread):
    rng = random.Random(seed)
    centres = [[rng.randrange(-20, 21) for _ in range(6)] for _ in range(5)]
    return [
        (i, rng.randrange(4), [float(c + rng.randrange(-spread, spread + 1)) for c in centres[i % 5]]) for i in range(n)
    ]


@pytest.mark.parametrize("cluster,shard,step,spread", [(4, 9, 3, 3), (256, 4096, 128, 25)])
def test_equals_all_scores(spark, monkeypatch, cluster, shard, step, spread):
    monkeypatch.setattr(negatives, "CLUSTER_ANCHORS", cluster)
    monkeypatch.setattr(negatives, "SHARD_ROWS", shard)
    monkeypatch.setattr(negatives, "STEP", step)
    rows = vectors(240, cluster, spread)
    rows += [(300 + i, i % 2, rows[3][2]) for i in range(120)]  # a third are copies: ties
    rows += [(7, 2, rows[8][2]), (10, 3, rows[10][2]), (None, 1, [1.0] * 6), (500, None, [1.0] * 6), (501, 1, None)]
    rows += [(502, 1, [4.0] * 3), (510, 1, []), (520, 2, [0.0] * 6)]
    frame = spark.createDataFrame(rows, ROWS).withColumns({n: F.lit("x") for n in ("id", "cell", "cluster", "score")})
    got = negatives.mine(frame.repartition(3), frame.filter("vec_id % 10 = 0")).collect()
    want = brute(rows, [r for r in rows if r[0] is not None and r[0] % 10 == 0])
    assert sorted(map(tuple, got)) == want
    assert len(want) > 200


def test_few_rows_and_empty_tables(spark):
    none = spark.createDataFrame([], ROWS)
    two = spark.createDataFrame([(1, 1, [3.0]), (2, 1, [2.0]), (3, 2, [2.0])], ROWS)
    assert sorted(map(tuple, negatives.mine(two, two).collect())) == [(1, 2, 1, 3, 6, 6), (2, 1, 1, 3, 6, 4)][:1]
    assert negatives.mine(none, two).count() == 0
    assert negatives.mine(two, none).count() == 0


def test_bounds_end_the_walk():
    """Members of a narrow cluster leave most of a wide list unread."""
    rng = np.random.default_rng(3)
    centre = np.eye(16)[0]
    members = np.round(100 * (centre + rng.normal(0, 0.02, (20, 16))))
    rows = np.round(100 * rng.normal(0, 1, (4000, 16)))
    rows[:40] = np.round(300 * (centre + rng.normal(0, 0.05, (40, 16))))
    angles = np.arccos((members @ centre) / np.linalg.norm(members, axis=1))
    side = {"ids": np.arange(20), "labels": np.zeros(20, int), "rows": members}
    shard = {"ids": np.arange(1000, 5000), "labels": np.zeros(4000, int), "rows": rows}
    wanted = negatives.Wanted(np.full((20, 1), -np.inf), np.full((20, 1), np.inf), True, 5)
    scored = negatives.walk(centre, angles.max(), side, shard, wanted)
    assert scored < 20 * 4000 / 4
    every = members @ rows.T
    for m in range(20):
        want = sorted(zip((-every[m]).tolist(), shard["ids"].tolist()))[:5]
        assert list(zip((-wanted.score[m, 0]).tolist(), wanted.id[m, 0].tolist())) == want


def test_far_cones_are_not_opened(spark):
    """Clusters that point elsewhere meet no shard whose cone cannot reach."""
    rows = [(i, i % 2, [100.0 * (i % 4 == d) + (i * 7 + d) % 5 for d in range(4)]) for i in range(400)]
    frame = spark.createDataFrame(rows, ROWS)
    picked = frame.selectExpr("vec_id AS id", "CAST(label AS BIGINT) AS label", "vector")
    index = negatives._Index(picked, picked.filter("id % 3 = 0"))
    clusters, shards = (index.anchors.select("cluster").distinct().count(), index.shards.select("shard").distinct().count())
    wishes = index.anchors.select("id", "cluster", F.array(F.lit(9000.0)).alias("low"))
    opened = index.units(wishes, F.lit(True)).count()
    assert shards >= 4 and opened < clusters * shards / 2
