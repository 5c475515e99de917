"""Toxicity by a learned lexicon, matched with a Levenshtein automaton, weighed by context.

1. Labelled rows give the lexicon: words that toxic texts hold far more often,
   beside a fixed list of insults, from which labels can strike words.
2. The lexicon is a trie. The automaton of all strings within an edit or two of
   a term is walked together with it, as a deterministic automaton whose states
   (sets of trie nodes with their edits) are made when first reached. So
   misspelled terms are found at a step per character. Words near a term that
   clean texts use are spared; other misspellings of the term still match.
3. A window around each hit tells quoting from abuse: quotation marks and words
   of reporting against words that address the reader.
4. A logistic model over counts of hits gives the score.

Neither labels nor language, source or doc_id are inputs of a score.
"""

from __future__ import annotations

import math
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchflow.llm.common import ready, remembered, table, tidy, whole_text

#: Labelled rows that the lexicon and the weights are fitted on at most: the first by a hash of doc_id.
TRAINING_ROWS = 20_000
#: Terms of the lexicon at most; texts that must hold a term; least log of its rate in toxic over clean texts.
MAX_TERMS, SUPPORT, LOG_RATIO = 400, 5, 2.5
#: Terms below this log are quoted by clean texts too; they count like misspelled ones.
CLEAR_RATIO = 4.0
#: Words on either side of a hit that count as its context.
WINDOW = 8
#: Words whose match a task remembers.
MEMORY_WORDS = 150_000
FOLDS = 5

# Words that report speech, words that address someone, marks of quotation.
REPORTING = frozenset(
    "said says say called calls wrote writes quote quoted quotes quoting term word phrase slur cited "
    "dit disait appelle mot sagte sagt nannte wort zitat dijo dice llamó palabra cita".split())
ADDRESSING = frozenset("you your yours youre u ur du dich dir dein deine ihr tu te toi ton ta vous tú ti usted eres".split())
OPENING, CLOSING = "\"“«„‘", "\"”»“’"
SEEDS = frozenset(
    "idiot idiots moron morons imbecile stupid dumb dumbass loser losers trash garbage scum scumbag filth vermin worthless "
    "pathetic disgusting clown fool jerk bastard bitch asshole whore slut retard retarded freak pig swine cretin degenerate "
    "dummkopf arschloch abschaum schwachkopf connard crétin imbécile salope ordure idiota estúpido imbécil basura escoria".split())
LOOKALIKES = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t"})

_words = re.compile(r"[^\W_]+")


def edits_for(length: int) -> int:
    """Edits by which a term of some length may be misspelled."""
    return 0 if length < 5 else 1 if length < 10 else 2


class Automaton:
    """Strings within the allowed edits of a term, as a deterministic automaton made on the way."""

    def __init__(self, terms: tuple[str, ...]):
        self.children: list[dict[str, int]] = [{}]
        self.limit = [0]  # edits that any term below a node allows
        self.accepts = [-1]  # edits that the term ending at a node allows
        for term in terms:
            node, allowed = 0, edits_for(len(term))
            self.limit[0] = max(self.limit[0], allowed)
            for letter in term:
                if letter not in self.children[node]:
                    self.children[node][letter] = len(self.children)
                    self.children.append({})
                    self.limit.append(0)
                    self.accepts.append(-1)
                node = self.children[node][letter]
                self.limit[node] = max(self.limit[node], allowed)
            self.accepts[node] = allowed
        self.alphabet = {letter for c in self.children for letter in c}
        self.numbers: dict[frozenset, int] = {}
        self.states: list[frozenset] = []
        self.steps: list[dict[str, int]] = []
        self.verdicts: list[int] = []
        self.start = self._number(self._closed({(0, 0)})) if terms else -1

    def _closed(self, places: set) -> frozenset:
        """With the places reached by leaving out letters of a term; of a node only the fewest edits matter."""
        best: dict[int, int] = {}
        queue = deque(places)
        while queue:
            node, edits = queue.popleft()
            if edits > self.limit[node] or best.get(node, 99) <= edits:
                continue
            best[node] = edits
            queue.extend((child, edits + 1) for child in self.children[node].values())
        return frozenset(best.items())

    def _number(self, state: frozenset) -> int:
        if not state:
            return -1
        if state not in self.numbers:
            self.numbers[state] = len(self.states)
            self.states.append(state)
            self.steps.append({})
            self.verdicts.append(min((e for node, e in state if e <= self.accepts[node]), default=-1))
        return self.numbers[state]

    def _step(self, number: int, letter: str) -> int:
        reached = set()
        for node, edits in self.states[number]:
            reached.add((node, edits + 1))
            for other, child in self.children[node].items():
                reached.add((child, edits + (other != letter)))
        return self._number(self._closed(reached))

    def edits(self, word: str) -> int:
        """Fewest edits to a term that allows so many; -1 if there is none."""
        state = self.start
        for letter in word:
            if state < 0:
                return -1
            if letter not in self.alphabet:
                letter = ""
            following = self.steps[state].get(letter)
            if following is None:
                following = self.steps[state][letter] = self._step(state, letter)
            state = following
        return self.verdicts[state] if state >= 0 else -1


@dataclass(frozen=True)
class Model:
    terms: tuple[str, ...] = ()
    exceptions: frozenset = frozenset()  # words near a term that are words of their own
    weak: frozenset = frozenset()  # learned terms that few texts bear out; they count like misspelled ones
    weights: tuple[float, ...] = ()


@remembered
def _automaton(terms: tuple[str, ...]) -> Automaton:
    return Automaton(terms)


@dataclass
class Matcher:
    """Finds hits in texts: 0 for a term as it is, 1 for a misspelled or weakly supported one."""

    terms: tuple[str, ...]
    exceptions: frozenset
    weak: frozenset = frozenset()
    known: dict = field(default_factory=dict)

    def kind(self, word: str) -> int:
        found = self.known.get(word)
        if found is None:
            if len(self.known) >= MEMORY_WORDS:
                self.known.clear()
            plain = word.translate(LOOKALIKES) if not word.isalpha() else word
            edits = _automaton(self.terms).edits(plain) if word not in self.exceptions else -1
            found = self.known[word] = -1 if edits < 0 or plain.isdigit() else 0 if edits == 0 and plain == word and word not in self.weak else 1
        return found

    def features(self, text: str) -> tuple[int, ...]:
        """Counts, at most 3 each, of plain and misspelled hits, direct and quoted; steps of density; whether addressed."""
        words = _words.findall(text.lower())
        kinds = {w: k for w in set(words) if (k := self.kind(w)) >= 0}
        if not kinds:
            return 0, 0, 0, 0, 0, 0
        counts, addressed = [0, 0, 0, 0], 0
        lowered = text.lower()
        places = [(m.start(), m.end()) for m in _words.finditer(lowered)]
        for at, word in enumerate(words):
            if word in kinds:
                low, high = max(0, at - WINDOW), min(len(words) - 1, at + WINDOW)
                near = words[low:high + 1]
                before, after = lowered[max(0, places[low][0] - 1):places[at][0]], lowered[places[at][1]:places[high][1] + 1]
                quoted = in_quotes(before, after) or any(w in REPORTING for w in words[max(0, at - 4):at])
                direct = any(w in ADDRESSING for w in near)
                addressed |= direct
                counts[2 * kinds[word] + (quoted and not direct)] += 1
        total = sum(counts)
        density = min(3, int(math.log2(1 + 1000 * total / len(words)) / 2))
        return (*(min(3, c) for c in counts), density, int(addressed))


def matcher_of(model: Model) -> Matcher:
    return Matcher(model.terms, model.exceptions, model.weak)


def in_quotes(before: str, after: str) -> bool:
    """Whether a quotation that opens before goes on at least to what follows."""
    opened = max(before.rfind(c) for c in OPENING)
    closed = max((before.rfind(c) for c in CLOSING if c not in OPENING), default=-1)
    straight = before.count('"') % 2 == 1
    open_now = straight or (opened > closed and opened >= 0 and before[opened] != '"')
    return open_now and any(c in after for c in CLOSING)


def _design(features: np.ndarray) -> np.ndarray:
    """Plain, misspelled and quoted hits with weights of their own; one misspelled hit alone shows little."""
    plain, quoted, wrong, wrong_quoted, density, addressed = features.astype(float).T
    cited = np.minimum(quoted + wrong_quoted, 3)
    return np.column_stack([
        np.ones(len(features)), plain, plain >= 1, wrong, wrong >= 2, cited, cited >= 1, density, addressed]).astype(float)


#: Before any label is seen, direct hits speak for toxicity, misspelled ones less, quoted ones hardly.
_PRIOR = np.array([0.0, 0.5, 1.5, 1.0, 1.5, 0.1, 0.2, 0.5, 0.2])


def fit_weights(features: np.ndarray, positive: np.ndarray, total: np.ndarray, strength: float = 0.5) -> np.ndarray:
    """Logistic regression on counts per cell, drawn to the prior; Newton's method with shortened steps."""
    x, w = _design(features), _PRIOR.copy()
    penalty = np.full(len(w), strength)
    penalty[0] = 1e-3

    def loss(v: np.ndarray) -> float:
        z = x @ v
        return float((total * np.logaddexp(0, z) - positive * z).sum() + (penalty * (v - _PRIOR) ** 2).sum() / 2)

    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (positive - total * p) - penalty * (w - _PRIOR)
        hessian = (x * (total * p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(hessian, gradient)
        while np.abs(step).max() >= 1e-8 and loss(w + step) > loss(w) + 1e-9:  # a whole step may overshoot
            step = step / 2
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def in_training(doc_id: Column) -> Column:
    """Rows whose labels may be learned from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(FOLDS)) != 0, F.lit(False))


def training_rows(documents: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> DataFrame:
    """toxic, text of labelled rows outside the held-out fold: ``rows`` at most, so their ids can be broadcast."""
    known = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").cast("int").alias("toxic")).filter(
        F.col("toxic").isNotNull() & in_training(F.col("id")))
    chosen = known.groupBy("id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("id"), "id").limit(rows)
    texts = documents.select(F.col("doc_id").cast("long").alias("id"), whole_text("text").alias("text"))
    return texts.join(F.broadcast(chosen), "id").select("id", "toxic", "text")


def families(rows: DataFrame) -> DataFrame:
    """toxic, words and family of each text. Texts that share the three least hashes of their words (copies) are a family."""
    words = rows.select("toxic", F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}{3,}+"), F.lit(0))).alias("words"))
    hashes = F.array_sort(F.transform("words", lambda w: F.xxhash64(w)))
    return words.select("toxic", "words", F.xxhash64(F.slice(hashes, 1, 3)).alias("family"))


def word_counts(rows: DataFrame) -> DataFrame:
    """Families of texts with each word: word, bad, good."""
    single = families(rows).select("family", "toxic", F.explode("words").alias("word")).groupBy("family", "word").agg(F.max("toxic").alias("toxic"))
    return single.groupBy("word").agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good"))


def learn(documents: DataFrame, labels: DataFrame) -> Model:
    """The model of the labelled rows; without toxic rows it knows no term."""
    spark = ready(documents.sparkSession)
    rows = training_rows(documents, labels).persist()
    try:
        total = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("bad")).first()
        if not total["bad"]:
            return Model()
        # Rates are over families, as the words' counts are, so a text of many copies does not lower those of others.
        of = families(rows).groupBy("family").agg(F.max("toxic").alias("toxic")).agg(
            F.count("*").alias("n"), F.sum("toxic").alias("bad")).first()
        n_bad, n_good = of["bad"], of["n"] - of["bad"]
        counts = word_counts(rows).persist()
        rate = F.log((F.col("bad") + 0.5) / (n_bad + 1)) - F.log((F.col("good") + 0.5) / (n_good + 1))
        # A word that stands in `bad` toxic texts and no other by chance alone, among that many words, is left out.
        tried = counts.filter("bad > 0").count()
        least = max(SUPPORT, math.ceil(math.log(tried + 1) / math.log((of["n"] + 1) / (n_bad + 0.5))))
        strong = counts.filter((F.col("bad") >= least) & (rate >= LOG_RATIO)).orderBy(F.desc(F.col("bad") * rate), "word")
        learned = {r["word"]: r for r in strong.select("word", "bad", rate.alias("rate")).limit(MAX_TERMS).collect()}
        weak = frozenset(
            w for w, r in learned.items() if (r["bad"] < 3 * least or r["rate"] < CLEAR_RATIO) and w not in SEEDS)
        refuted = {r["word"] for r in counts.filter(F.col("word").isin(*SEEDS) & (rate < 0)).collect()}
        terms = tuple(sorted(learned.keys() | (SEEDS - refuted)))
        spared = counts.filter(rate < 0).filter(_near_udf(spark, terms)(F.col("word")))
        exceptions = frozenset(r["word"] for r in spared.select("word").collect())  # of the training rows' words
        counts.unpersist()
        cells = rows.select("toxic", _features_udf(spark, Model(terms, exceptions, weak))(F.col("text")).alias("f")).groupBy("f").agg(
            F.sum("toxic").alias("bad"), F.count("*").alias("n")).collect()  # 4 ** 5 * 2 cells at most
        features = np.array([r["f"] for r in cells])
        weights = fit_weights(features, np.array([float(r["bad"]) for r in cells]), np.array([float(r["n"]) for r in cells]))
        return Model(terms, exceptions, weak, tuple(weights.tolist()))
    finally:
        rows.unpersist()


def _near_udf(spark: SparkSession, terms: tuple[str, ...]):
    @F.pandas_udf("boolean")
    def near(words: pd.Series) -> pd.Series:
        automaton = _automaton(terms)
        return pd.Series([automaton.edits(w) > 0 for w in words], dtype=bool)

    return near


def _features_udf(spark: SparkSession, model: Model):
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("array<int>")
    @tidy
    def features(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        matcher = matcher_of(shared.value)
        for texts in batches:
            yield pd.Series([list(matcher.features(t)) for t in texts])

    return features


def scorer(spark: SparkSession, model: Model):
    """A column function: score of a text, 0 to 1."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    @tidy
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = shared.value
        matcher, known = matcher_of(own), {}
        for texts in batches:
            out = []
            for text in texts:
                cell = matcher.features(text)
                if cell not in known:
                    x = _design(np.array([cell]))[0] @ np.array(own.weights) if own.weights else -30.0
                    known[cell] = float(1 / (1 + np.exp(-np.clip(x, -30, 30))))
                out.append(known[cell])
            yield pd.Series(out, dtype="float64")

    return score


def scored(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """All rows and columns of the documents, and ``toxicity``, 0 to 1.

    Null and empty texts get the score of a text without hits. Equal texts get
    equal scores. Without toxic labels all scores are near 0. An empty table
    gives no row. A column named toxicity is replaced.
    """
    model = learn(documents, labels)
    return documents.withColumn("toxicity", scorer(documents.sparkSession, model)(whole_text("text")))


def without_toxic(documents: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """The documents that score below ``least``, with all their columns as they are."""
    return documents.filter(scorer(documents.sparkSession, learn(documents, labels))(whole_text("text")) < least)


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(FOLDS)) == 0, F.lit(False))
    return scored(documents.select("doc_id", "text"), labels).select(
        "doc_id", held_out.alias("held_out"), F.col("toxicity").alias("score"),
        (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op2_toxicity": op2_toxicity}
ORACLE: dict[str, str] = {}
