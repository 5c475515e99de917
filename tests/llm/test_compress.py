"""Product quantisation against sums over all rows and entries."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchflow.llm import compress

ROWS = "vec_id long, label int, vector array<double>"


def brute(rows, parts, entries, rounds):
    """Codes in input order and the codebooks, one difference after the other."""
    width = -(-max(len(v) for _, _, v in rows) // parts) * parts
    full = [[int(x) for x in v] + [0] * (width - len(v)) for _, _, v in rows]
    each = width // parts
    order = sorted(range(len(rows)), key=lambda r: (rows[r][0] is None, rows[r][0] or 0, rows[r][2]))
    books = [[full[r][p * each:(p + 1) * each] for r in order[:entries]] for p in range(parts)]

    def assign():
        out = []
        for v in full:
            best = []
            for p in range(parts):
                ds = [sum((a - b) ** 2 for a, b in zip(v[p * each:(p + 1) * each], e)) for e in books[p]]
                best.append((ds.index(min(ds)), min(ds)))
            out.append(best)
        return out

    for _ in range(rounds):
        codes = assign()
        for p in range(parts):
            for e in range(len(books[p])):
                own = [full[r][p * each:(p + 1) * each] for r in range(len(rows)) if codes[r][p][0] == e]
                if own:
                    books[p][e] = [sum(c) // len(own) for c in zip(*own)]
    return [(bytes(e for e, _ in c), sum(d for _, d in c)) for c in assign()], books


@pytest.mark.parametrize("chunk", [7, 4096])
def test_equals_every_difference(spark, monkeypatch, chunk):
    monkeypatch.setattr(compress, "CHUNK_ROWS", chunk)
    rng = random.Random(chunk)
    rows = [(i, i % 3, [float(rng.randrange(-9, 9)) for _ in range(8)]) for i in range(60)]
    rows += [(100 + i, None, rows[5][2]) for i in range(40)]  # a third are copies
    rows += [(5, 1, rows[5][2]), (5, 2, [9.0] * 8), (None, 0, [1.0] * 8), (200, 9, [3.0]), (201, 9, [])]
    frame = spark.createDataFrame(rows, ROWS).withColumn("code", F.lit("x")).withColumn("error", F.lit(1)).repartition(3)
    codes, book = compress.compress(frame, 4, 6, 2)
    want, books = brute(rows, 4, 6, 2)
    got = sorted(((r.vec_id is None, r.vec_id or 0), bytes(r.code), r.error) for r in codes.collect())
    assert got == sorted(((i is None, i or 0), *c) for (i, _, _), c in zip(rows, want))
    assert [[book[e, p * 2:(p + 1) * 2].tolist() for e in range(6)] for p in range(4)] == books
    assert compress.codebook_text(book, 4) == ",".join(str(x) for p in books for e in p for x in e)
    vectors = {r.vec_id: r.vector for r in compress.decompress(codes, book, 4).collect()}
    full = {i: [int(x) for x in v] + [0] * (8 - len(v)) for i, _, v in rows}
    error = {r.vec_id: r.error for r in codes.collect()}
    assert all(sum((a - b) ** 2 for a, b in zip(vectors[i], full[i])) == error[i] for i in range(60) if i != 5)


def test_label_errors_keep_nulls_and_empty_labels_apart(spark):
    rows = [(1, "a", b"\0", 5), (2, "a", b"\1", 7), (3, None, b"\0", 1), (4, None, b"\0", 2), (5, "", b"\0", 4)]
    frame = spark.createDataFrame(rows, "vec_id long, label string, code binary, error long")
    got = {r.vec_id: r.label_error for r in compress.with_label_error(frame).collect()}
    assert got == {1: 12, 2: 12, 3: 3, 4: 3, 5: 4}


def test_few_and_no_rows(spark):
    codes, book = compress.compress(spark.createDataFrame([], ROWS))
    assert codes.count() == 0 and compress.codebook_text(book) == ""
    codes, book = compress.compress(spark.createDataFrame([(1, None, [1.0, -2.0]), (2, 3, [])], ROWS))
    assert [(r.vec_id, r.error) for r in codes.orderBy("vec_id").collect()] == [(1, 0), (2, 0)]
    assert book.shape == (2, 16)
    nothing, _ = compress.compress(spark.createDataFrame([(1, 1, []), (2, 1, [])], ROWS))
    assert [r.error for r in nothing.collect()] == [0, 0]


def test_components_beyond_the_range_are_refused(spark):
    codes = lambda: compress.compress(spark.createDataFrame([(1, 1, [1e12])], ROWS))
    with pytest.raises(Exception, match="below"):
        codes()


def test_differences_are_taken_once_per_distinct_value():
    """The table of a dimension has a row per distinct value, however many rows gather from it."""
    dictionaries = [np.array([2, 7])]
    codes, errors = compress.nearest(dictionaries, np.array([[0, 1, 1, 0]]), np.array([[1], [7], [3]]), 1)
    assert codes[:, 0].tolist() == [0, 1, 1, 0]  # 2 lies between 1 and 3: the lower entry
    assert errors[:, 0].tolist() == [1, 0, 0, 1]
