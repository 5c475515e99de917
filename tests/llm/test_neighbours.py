"""Approximate neighbours against all distances."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from matchflow.llm import neighbours
from tests.conftest import DATA

ROWS = "vec_id long, vector array<double>"


def brute(rows, asked, k):
    near = {}
    out = {}
    for q, v in asked.items():
        near = {}
        for i, w in rows:
            if i != q:
                near[i] = min(near.get(i, math.inf), math.dist(v, w))
        out[q] = sorted(near.items(), key=lambda x: (x[1], x[0]))[:k]
    return out


@pytest.mark.parametrize("piece,queries", [(5, 3), (4096, 16384)])
def test_all_buckets_give_all_neighbours(spark, monkeypatch, piece, queries):
    """With every bucket probed the answer is exact, whatever the pieces."""
    monkeypatch.setattr(neighbours, "PIECE_ROWS", piece)
    monkeypatch.setattr(neighbours, "PIECE_QUERIES", queries)
    rng = random.Random(piece)
    rows = [(i, [rng.gauss(0, 1) for _ in range(5)]) for i in range(120)]
    rows += [(200 + i, rows[0][1]) for i in range(60)]  # a third are copies: one hot bucket, ties
    rows += [(0, [9.0] * 5), (50, rows[50][1])]  # ids that repeat
    left_out = [(900, None), (910, [0.0] * 5), (920, [math.nan] * 5), (930, [None] * 5), (940, []), (950, [math.inf] * 5)]
    frame = spark.createDataFrame(rows + left_out + [(None, [1.0] * 5)], ROWS)
    frame = frame.withColumns({n: F.lit("x") for n in ("id", "tab", "bucket", "score", "hashes")}).repartition(4)
    got = neighbours.nearest(frame, frame.filter("vec_id % 10 = 0"), 7, tables=1, probes=16).collect()
    asked = {}
    for i, v in rows:
        if i % 10 == 0:
            asked[i] = min(asked.get(i, v), v)
    want = brute(rows, asked, 7)
    have = {}
    for r in sorted(got, key=lambda r: r.rank):
        have.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert have.keys() == want.keys()
    for q in want:
        assert [i for i, _ in have[q]] == [i for i, _ in want[q]]
        assert [s for _, s in have[q]] == pytest.approx([s for _, s in want[q]])


def test_few_rows_and_empty_tables(spark):
    two = spark.createDataFrame([(1, [1.0]), (2, [3.0, 1.0])], ROWS)
    none = spark.createDataFrame([], ROWS)
    got = neighbours.nearest(two, two, 10, probes=99).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == [
        (1, 1, 2, math.sqrt(5)), (2, 1, 1, math.sqrt(5))]
    assert neighbours.nearest(two, none).count() == 0
    assert neighbours.nearest(none, two).count() == 0


def test_rotations_keep_lengths_and_angles():
    rows = np.random.default_rng(1).normal(size=(20, 32))
    turned = neighbours.rotated(rows, 3)
    assert np.allclose(turned @ turned.T, rows @ rows.T)
    dense = np.array([[(-1) ** bin(i & j).count("1") for j in range(32)] for i in range(32)]) / math.sqrt(32)
    assert np.allclose(neighbours.hadamard(rows), rows @ dense)


def test_probes_are_the_best_buckets():
    """Of all pairs of axes those come first that lose least."""
    rows = np.random.default_rng(2).normal(size=(10, 4))
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    found = neighbours.buckets(rows, 2, 2, 12)
    for n in range(10):
        for t in range(2):
            loss = []
            for number in (2 * t, 2 * t + 1):
                y = neighbours.rotated(rows[n:n + 1], number)[0]
                signed = np.stack([y, -y], axis=1).ravel()
                loss.append((signed.max() - signed) ** 2)
            every = (loss[0][:, None] + loss[1][None, :]).ravel()
            assert np.allclose(np.sort(every)[:12], every[found[n, t]])


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall(spark, sf):
    """At least nine of ten true neighbours on the given vectors, with exact distances."""
    table = spark.read.parquet(f"{DATA}/{sf}/embeddings.parquet").toPandas().sort_values("vec_id")
    rows, ids = np.array(table["embedding"].tolist(), dtype="f8"), table["vec_id"].to_numpy()
    got = {}
    for r in entry.queries()["op13_neighbours"](spark, f"{DATA}/{sf}").collect():
        got.setdefault(r.query_id, {})[r.vec_id] = r.score
    hits = total = 0
    for at in np.flatnonzero(ids % 100 == 0):
        distance = np.sqrt(((rows - rows[at]) ** 2).sum(axis=1))
        distance[at] = np.inf
        best = ids[np.lexsort((ids, distance))[:10]]
        own = got[ids[at]]
        assert len(own) == 10
        assert all(s == pytest.approx(distance[np.searchsorted(ids, i)], abs=1e-12) for i, s in own.items())
        hits, total = hits + len(own.keys() & set(best.tolist())), total + 10
    assert hits >= 0.9 * total
