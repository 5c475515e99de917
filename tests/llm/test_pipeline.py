"""Each stage of the pipeline against what it must do to its own input."""

import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from matchflow.llm.common import stored
from tests.conftest import DATA
from tests.llm.test_ngram_join import brute

SF = f"{DATA}/sf0.001"
STAGE = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """Input of the first stage and output of each."""
    folder = tmp_path_factory.mktemp("pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]

    def kept(frame, name):
        frame.write.parquet(f"{folder}/{name}")
        out.append(spark.read.parquet(f"{folder}/{name}"))
        return out[-1]

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(corpus_pipeline, "stored", kept)
        out.append(corpus_pipeline.run(spark, SF).persist())
    return out


def texts(frame):
    return {r["doc_id"]: r["text"] for r in frame.select("doc_id", "text").collect()}


def test_order_of_stages():
    assert list(STAGE) == ["toxicity", "ngram_join", "decontamination", "pii", "byte_bpe"]


def test_columns_stay(steps):
    assert all(s.columns == steps[0].columns for s in steps[:-1])
    assert {"doc_id", "ids", "n_tokens"} <= set(steps[-1].columns)


def test_toxic_documents_go(spark, steps):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    kept = steps[1].join(labels, "doc_id")
    before = steps[0].join(labels, "doc_id")
    assert kept.filter("toxic = 0").count() == before.filter("toxic = 0").count()
    assert kept.filter("toxic = 1").count() < before.filter("toxic = 1").count()


def test_one_of_each_group_stays(steps):
    before = texts(steps[1])
    groups = {d: c for d, _, c in brute(sorted(before.items()))}
    assert sorted(texts(steps[2])) == sorted(d for d, c in groups.items() if c == d)


def test_leaks_go(spark, steps):
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    before, after = texts(steps[2]), texts(steps[3])
    plain = lambda t: re.sub(r"[\W_]+", " ", t.lower())
    leaking = {d for d, t in before.items() if any(plain(i).strip() in plain(t) for i in items)}
    assert set(after) == set(before) - leaking


def test_personal_data_is_masked(steps):
    before, after = texts(steps[3]), texts(steps[4])
    assert before.keys() == after.keys()
    mail = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    assert not any(mail.search(t) for t in after.values())
    assert all(after[d] == t for d, t in before.items() if not re.search(r"[0-9@]", t))


def test_ids_decode_to_the_text(spark, steps):
    import hashlib
    want = {d: hashlib.sha256(t.encode()).hexdigest() for d, t in texts(steps[4]).items()}
    assert {r["doc_id"]: r["decoded_sha256"] for r in steps[5].collect()} == want


def test_stages_take_odd_rows_and_no_rows(spark, documents):
    rows = [(None, None), (1, ""), (2, "a b c d e f g"), (2, "a b c d e f g"), (3, "x" * 50_000), (4, "mail a@b.cd now")]
    for docs in (documents(rows), documents([])):
        count = docs.count()
        docs = docs.withColumn("toxicity", F.lit(1.0)).withColumn("spans", F.lit("s"))
        for name, stage in corpus_pipeline.STAGES:
            docs = stored(stage(spark, docs, SF), f"test-{name}")
        assert docs.count() == (5 if count else 0)
