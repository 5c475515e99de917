"""The Jaccard join against all pairs."""

import random
import re

import pytest
from pyspark.sql import functions as F

from matchflow.llm import ngram_join
from matchflow.llm.components import components


def shingles(text):
    lowered = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return set()
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))}


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = find(i), find(j)
                label[max(x, y)] = min(x, y)
    out = []
    for i, (doc, _) in enumerate(rows):
        ids = [d for j, (d, _) in enumerate(rows) if find(j) == find(i) and d is not None]
        out.append((doc, len(sets[i]), (min(ids) if ids else None) if sets[i] else doc))
    return sorted(out, key=str)


def result(frame):
    rows = ngram_join.classes(frame).select("doc_id", "n_shingles", "component_id").collect()
    return sorted(map(tuple, rows), key=str)


def edited(text, rng, share):
    words = text.split(" ")
    for i in range(len(words)):
        if rng.random() < share:
            words[i] = f"x{rng.randrange(10 ** 6)}"
    return " ".join(words)


def corpus(words, seed):
    """Near copies at all distances, a passage that many share, exact copies, short and empty texts."""
    rng = random.Random(seed)
    passage = words(60, seed)
    rows = []
    for family in range(12):
        base = words(rng.randrange(30, 200), seed * 100 + family)
        rows += [edited(base, rng, rng.choice([0, 0.005, 0.01, 0.02, 0.03, 0.05])) for _ in range(rng.randrange(1, 9))]
    rows += [passage + " " + words(rng.randrange(5, 120), seed * 1000 + i) for i in range(40)]
    rows += ["", None, "one", "One", "one two three", "ONE  two\tthree", "a b c d e", "A B C D E f", " \n "]
    rows += [rows[0]] * 3
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("seed", [1])
def test_equals_all_pairs(documents, words, seed, monkeypatch):
    # Small limits, so that chunks, slices of groups and units of queries all occur.
    monkeypatch.setattr(ngram_join, "GROUP_MEMBERS", 4)
    monkeypatch.setattr(ngram_join, "UNIT_QUERIES", 3)
    monkeypatch.setattr(ngram_join, "LEADERS", 1)
    monkeypatch.setattr(ngram_join, "KEYS", 1)
    rows = corpus(words, seed)
    assert result(documents(rows).repartition(5)) == brute(rows)


def test_large_group_of_near_copies(documents, words):
    rng = random.Random(4)
    base = words(120, 4)
    rows = [(i, edited(base, rng, 0.012)) for i in range(150)] + [(1000 + i, words(80, 500 + i)) for i in range(20)]
    assert result(documents(rows).repartition(4)) == brute(rows)


def test_null_and_repeated_ids(documents, words):
    a, b = words(50, 1), words(50, 2)
    rows = [(None, a), (7, a), (None, b), (None, b), (3, words(40, 3)), (3, words(40, 3)), (9, None), (None, "")]
    assert result(documents(rows)) == brute(rows)


def test_empty_table_and_long_text(documents, words):
    assert result(documents([])) == []
    long = words(60_000, 8, 50_000)
    rows = [(2, long), (1, long + " end"), (5, "x" * 100_000)]
    assert result(documents(rows)) == brute(rows)


def test_one_of_each_keeps_columns_that_clash(documents, words):
    a = words(80, 1)
    rows = [(4, a), (2, a + " more"), (2, a + " more"), (8, words(80, 2)), (9, ""), (10, ""), (None, None)]
    frame = documents(rows)
    for name in ("id", "raw", "own_id", "own_raw", "n", "row", "key"):
        frame = frame.withColumn(name, F.lit("kept"))
    kept = ngram_join.one_of_each(frame)
    assert kept.columns == frame.columns
    out = kept.collect()
    assert sorted((r["doc_id"] for r in out), key=str) == [10, 2, 8, 9, None]
    assert all(r["row"] == r["key"] == r["own_raw"] == "kept" for r in out)


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (101, 100), (7, 7), (100, 150), (200, 3)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(31)}, 200: 0, 100: 100, 101: 100, 150: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_links_are_counted(documents, words, monkeypatch):
    monkeypatch.setattr(ngram_join, "GROUP_MEMBERS", 4)
    monkeypatch.setattr(ngram_join, "UNIT_QUERIES", 3)
    monkeypatch.setattr(ngram_join, "KEYS", 2)
    rows = corpus(words, 3)
    rng, base = random.Random(8), words(200, 77)
    rows += [(10_000 + i, edited(base, rng, 0.02)) for i in range(20)] + [(20_000 + i, base) for i in range(3)]
    sets = [shingles(t) for _, t in rows]
    want = sorted(((d, sum(i != j and bool(a) and 100 * len(a & b) >= 75 * len(a | b) for j, b in enumerate(sets)))
                   for i, ((d, _), a) in enumerate(zip(rows, sets))), key=str)
    got = ngram_join.classes(documents(rows), links=True).select("doc_id", "n_links").collect()
    assert sorted(map(tuple, got), key=str) == want and max(n for _, n in want) > 5
