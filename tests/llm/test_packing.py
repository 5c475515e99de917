"""Packing against plain best fit, and every id back from the files."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from matchflow.llm import bpe, packing
from matchflow.llm.common import scratch, shared_uri


def plain_best_fit(sizes, length):
    room, rows = [], []
    for piece in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        fits = [r for r in room if r >= sizes[piece]]
        if fits:
            at = room.index(min(fits))
            room[at] -= sizes[piece]
            rows[at].append(piece)
        else:
            room.append(length - sizes[piece])
            rows.append([piece])
    return rows


@pytest.mark.parametrize("length", [1, 7, 16, 100])
def test_best_fit(length):
    rng = random.Random(length)
    for _ in range(100):
        sizes = [rng.randint(1, length) for _ in range(rng.randrange(60))]
        got, want = packing.best_fit(sizes, length), plain_best_fit(sizes, length)
        assert sorted(i for row in got for i in row) == list(range(len(sizes)))
        assert sorted(sum(sizes[i] for i in row) for row in got) == sorted(sum(sizes[i] for i in row) for row in want)


@pytest.mark.parametrize("length,pool", [(16, 200), (64, 5_000)])
def test_files_hold_every_id_once(spark, documents, words, length, pool):
    texts = [words(n % 90, n) for n in range(120)] + ["", None, words(900, 1), words(900, 1), "same", "same"]
    rows = [(i, t) for i, t in enumerate(texts)]
    folder = shared_uri(scratch(spark, "packed-test"))
    frame = documents(rows).repartition(3).withColumn("ids", F.lit(1)).withColumn("row", F.lit("x"))
    packed = packing.write_packed(frame, folder, length, pool)
    listed = {(r["part"], r["row"]): r for r in packed.collect()}
    back = {(r["part"], r["row"]): r for r in packing.read_packed(packed, folder, length).collect()}
    assert listed.keys() == back.keys()
    ids = defaultdict(dict)
    for key, row in listed.items():
        assert row["cu_seqlens"][-1] == row["n_tokens"] <= length
        assert back[key]["resets"] == row["cu_seqlens"][:-1]
        for doc, offset, segment in zip(row["doc_ids"], row["offsets"], back[key]["segments"]):
            ids[doc][offset] = segment
    import public_tokenizers
    encode = bpe.encoding_of(public_tokenizers.path(bpe.VOCABULARY)).encode_ordinary
    for doc, text in rows:
        joined = []
        for offset in sorted(ids[doc]):
            assert offset == len(joined)
            joined += ids[doc][offset]
        assert joined == encode(text or "")


def test_rows_are_well_filled(spark, documents, words):
    packed = packing.write_packed(documents([words(n % 200 + 1, n) for n in range(300)]).coalesce(1),
                                  shared_uri(scratch(spark, "packed-test")), 256, 60_000)
    fill = packed.agg(F.sum("n_tokens") / F.count("*") / 256).first()[0]
    assert fill > 0.97


def test_pieces_that_fit_badly_do_not_wait_for_ever(spark, documents, words):
    packed = packing.write_packed(documents([words(30, n) for n in range(60)]).coalesce(1),
                                  shared_uri(scratch(spark, "packed-test")), 110, 1_000)
    assert packed.agg(F.sum(F.size("doc_ids"))).first()[0] >= 60


def test_empty_and_null(spark, documents):
    folder = shared_uri(scratch(spark, "packed-test"))
    assert packing.write_packed(documents([]), folder).count() == 0
    rows = packing.write_packed(documents([(None, "a"), (None, "a"), (1, None), (2, "")]), folder + "-2").collect()
    assert [d for r in rows for d in r["doc_ids"]] == [None, None]
