"""The automaton against edit distances, the score against held-out labels."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from matchflow.llm import toxicity
from tests.conftest import DATA


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        fresh = [i + 1]
        for j, y in enumerate(b):
            fresh.append(min(row[j] + (x != y), row[j + 1] + 1, fresh[j] + 1))
        row = fresh
    return row[-1]


def test_automaton_equals_edit_distance():
    rng = random.Random(2)
    terms = ("abc", "abcab", "bcabca", "cabbage", "abcabcabcab", "bbbbbbbbbbcc", "abcabcabcac")
    automaton = toxicity.Automaton(terms)
    for _ in range(4000):
        word = list(rng.choice(terms)) if rng.random() < 0.7 else [rng.choice("abcx") for _ in range(rng.randrange(14))]
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(word) + 1)
            word[at:at + rng.randrange(2)] = rng.choice(["a", "b", "c", "x", "", "é"])
        word = "".join(word)
        near = [d for t in terms if (d := distance(word, t)) <= toxicity.edits_for(len(t))]
        assert automaton.edits(word) == (min(near) if near else -1), word


def test_no_terms():
    assert toxicity.Automaton(()).edits("word") == -1


def features(text):
    return toxicity.Matcher(("idiot", "disgusting"), frozenset({"idiom"})).features(text)


def test_context_tells_quoting_from_abuse():
    assert features("an Idiot!")[:4] == (1, 0, 0, 0)
    assert features('the word "idiot" is old')[:4] == (0, 1, 0, 0)
    assert features("she wrote idiot and left")[:4] == (0, 1, 0, 0)
    assert features('you said "idiot"')[:4] == (1, 0, 0, 0)
    assert features("«idiot» he read")[:4] == (0, 1, 0, 0)
    assert features("idi0t and disgustng, idiott")[:4] == (0, 0, 3, 0)
    assert features("idiom")[:4] == (0, 0, 0, 0)
    assert features("")[:4] == (0, 0, 0, 0)
    assert features("idiot " * 50_000)[:5] == (3, 0, 0, 0, 3)


def test_held_out_accuracy(spark):
    documents, labels = (spark.read.parquet(f"{DATA}/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.op2_toxicity(spark, f"{DATA}/sf0.1").join(labels, "doc_id").filter("held_out").groupBy("toxic", "predicted").count().collect()
    counts = {(r["toxic"], r["predicted"]): r["count"] for r in rows}
    assert counts[1, 1] / (counts[1, 1] + counts.get((1, 0), 0)) > 0.9
    assert counts.get((0, 1), 0) / counts[0, 0] < 0.01
    assert documents.count() == 10_000


@pytest.fixture
def labelled(spark, documents, words):
    rng = random.Random(5)
    rows = []
    for i in range(160):
        text = words(40, i).translate(str.maketrans("0123456789", "abcdefghij")).split()
        if i % 4 == 0:
            for _ in range(4):
                text.insert(rng.randrange(len(text)), rng.choice(["vileword", "horridterm"]))
        rows.append((i, " ".join(text)))
    return documents(rows), spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(160)], "doc_id long, quality int, toxic int")


def test_learned_terms_and_misspellings(spark, documents, labelled):
    asked = documents([(1, "a vileword b"), (2, "a vilewrd b horidterm"), (3, "calm text"), (None, None), (3, ""), (3, "calm text")])
    frame = asked.withColumn("toxicity", F.lit("old")).withColumn("label", F.lit(1))
    rows = toxicity.without_toxic(labelled[0], labelled[1])
    assert sorted(r["doc_id"] for r in rows.collect()) == [i for i in range(160) if i % 4]
    model = toxicity.learn(*labelled)
    assert {"vileword", "horridterm"} <= set(model.terms)
    score = toxicity.scorer(spark, model)
    got = frame.withColumn("s", score(F.coalesce("text", F.lit("")))).collect()
    assert [r["s"] >= 0.5 for r in got] == [True, True, False, False, False, False]
    assert all(0 <= r["s"] <= 1 for r in got) and got[2]["s"] == got[5]["s"] and got[0]["toxicity"] == "old"


def test_held_out_labels_change_nothing(labelled):
    rows, labels = labelled
    flipped = labels.withColumn("toxic", F.when(toxicity.in_training(F.col("doc_id")), F.col("toxic")).otherwise(1 - F.col("toxic")))
    assert toxicity.learn(rows, flipped) == toxicity.learn(rows, labels)


def test_empty_tables(spark, documents, labelled):
    rows, labels = labelled
    none = labels.filter("false")
    assert toxicity.scored(rows, none).filter("toxicity >= 0.5").count() == 0
    assert toxicity.scored(documents([]), labels).count() == 0
    assert toxicity.scored(rows, labels.withColumn("toxic", F.lit(None).cast("int"))).filter("toxicity >= 0.5").count() == 0


def test_quotes():
    pairs = list(itertools.product(['"a', "“a", "a", '"a" b', "“a” b"], ['c"', "c”", "c"]))
    got = [toxicity.in_quotes(b, a) for b, a in pairs]
    assert got == [True, True, False, True, True, False] + [False] * 9


def test_neighbours_are_spared_and_misspellings_still_match(documents, labelled):
    rows, labels = labelled
    near = rows.withColumn("text", F.when(F.col("doc_id") % 4 != 0, F.concat("text", F.lit(" vileworm"))).otherwise(F.col("text")))
    matcher = toxicity.matcher_of(toxicity.learn(near, labels))
    assert [matcher.kind(w) for w in ("vileword", "vileworm", "vilewrd", "vilewordd")] == [0, -1, 1, 1]


def test_rates_of_families_decide(spark, documents, words):
    """Of 400 texts 40 are toxic, and a toxic text has 150 copies; clean texts quote the terms now and then."""
    rows, toxic = [], []
    for i in range(600):
        text = words(20, i if i < 440 else 7000).translate(str.maketrans("0123456789", "abcdefghij"))
        bad = i < 40 or i >= 440
        if i < 24:
            text += " idiot badterm"
        elif 40 <= i < 75:
            text += " idiot"
        if 40 <= i < 49:
            text += " badterm"
        rows.append((i, text))
        toxic.append((i, int(bad)))
    labels = spark.createDataFrame(toxic, "doc_id long, toxic int")
    model = toxicity.learn(documents(rows), labels)
    assert {"idiot", "badterm"} <= set(model.terms) and "badterm" in model.weak
