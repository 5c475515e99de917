"""Ids equal those of the tiktoken library; decoding gives the bytes back."""

import base64
import hashlib
import re

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from matchflow.llm import bpe, toxicity

TEXTS = [
    "", None, " ", "\n\n  \t x", "Hello world, it's 2024!  two  spaces", "naïve café — déjà vu 12³ ½ Ⅷ", "日本語のテキスト 😀😀 emojí",
    "a b c\u0085d\x1ce", "'s 't 'LL don't", "x" * 3000, "word " * 5000, "\u0000� control \x07", "same text", "same text",
    "trailing space ", " leading", "tabs\t\tand\r\nlines\r\n\r\n", "1234567890 " * 300, "ﬁ ligature ẞ İ ı",
]


@pytest.fixture(scope="module")
def library():
    with open(public_tokenizers.path(bpe.VOCABULARY), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("chars", [40, 8_000_000])
def test_ids_and_bytes(documents, library, monkeypatch, chars):
    monkeypatch.setattr(bpe, "CHUNK_CHARS", chars)
    frame = documents(TEXTS).repartition(3).withColumn("ids", F.lit(1)).withColumn("slice", F.lit("x"))
    rows = {r["doc_id"]: r for r in bpe.decode(bpe.encode(frame)).collect()}
    assert len(rows) == len(TEXTS)
    for i, text in enumerate(TEXTS):
        assert rows[i]["ids"] == library.encode_ordinary(text or ""), text
        assert bytes(rows[i]["bytes"]) == (text or "").encode()


def test_digests_and_repeated_rows(documents, library):
    rows = [(None, "a b c"), (None, "a b c"), (4, "a b c"), (4, None)]
    got = bpe.digests(bpe.encode(documents(rows))).collect()
    ids = library.encode_ordinary("a b c")
    full = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(b"a b c").hexdigest())
    none = (0, hashlib.sha256(b"").hexdigest(), hashlib.sha256(b"").hexdigest())
    assert sorted(((r[0], *r[1:]) for r in got), key=str) == sorted(
        [(None, *full), (None, *full), (4, *full), (4, *none)], key=str)


def test_empty_table(documents):
    encoded = bpe.with_digests(bpe.encode(documents([])))
    assert encoded.collect() == []
    assert encoded.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"]


def test_words_of_all_tasks_are_encoded_alike(documents, library, words, monkeypatch):
    monkeypatch.setattr(bpe, "MEMORY_WORDS", 5)
    texts = [words(60, i, 300) for i in range(40)]
    got = {r["doc_id"]: r["ids"] for r in bpe.encode(documents(texts).repartition(6)).collect()}
    assert got == {i: library.encode_ordinary(t) for i, t in enumerate(texts)}


def test_digests_come_with_the_ids(documents, monkeypatch):
    monkeypatch.setattr(bpe, "CHUNK_CHARS", 40)
    frame = documents([*TEXTS, (None, "a b c"), (None, "a b c")]).repartition(3)
    got, want = bpe.encode(frame, digested=True), bpe.with_digests(bpe.encode(frame))
    assert got.columns == want.columns and got.dtypes == want.dtypes
    assert sorted(got.collect(), key=str) == sorted(want.collect(), key=str)
    assert bpe.encode(documents([]), digested=True).collect() == []


def test_the_pipeline_ends_in_one_python_worker_for_each_task(documents):
    plan = corpus_pipeline.as_token_ids(None, documents(TEXTS), "")._jdf.queryExecution().executedPlan().toString()
    last = re.split("Exchange|FileScan", plan)[0]  # what runs in one task
    assert last.count("InArrow") == 1


def test_a_worker_drops_what_other_operators_remember():
    toxicity._automaton(("idiot",)).edits("idiot")
    bpe.ranks_of(public_tokenizers.path(bpe.VOCABULARY))
    list(bpe._digester(public_tokenizers.path(bpe.VOCABULARY))(iter([])))
    assert toxicity._automaton.cache_info().currsize == 0
    assert bpe.ranks_of.cache_info().currsize == 1
