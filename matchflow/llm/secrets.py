"""Secrets: known forms, and strings that pass a battery of randomness tests.

Candidates are long runs of the characters that keys are written in. The
smallest usual alphabet that holds all characters of a candidate is taken for
its encoding. Three tests ask whether it is a random string over that alphabet:
chi-squared for uniform use of the characters, the number of runs above and
below the middle of the alphabet, and the correlation of neighbours. Fisher's
method joins their p-values to one score.

Ordinary text may look random by chance, short strings more often than long
ones. So letters of the words before a candidate, cut to its length, go through
the same tests as controls. Per alphabet and length these give the chance of a
score under ordinary text, and the Benjamini-Hochberg procedure over all candidates of the
corpus bounds the share of false discoveries.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchflow.llm.common import ready, stored, table, whole_text

#: Least length of a candidate; controls of each; share of false discoveries.
LEAST, CONTROLS, ALPHA = 20, 100, 0.01
#: Controls that a class should have.
ENOUGH = 2000
#: Characters before a candidate that its controls are cut from.
REACH = 4000
#: Steps of the score; lengths at which a new class of length begins.
LEVELS = 64
LENGTHS = (20, 24, 28, 32, 40, 48, 64, 96, 128)

# The kinds in order, and their patterns.
KINDS = ("assign", "access", "hex")
RANDOM = "random"
_NAMES = ("password", "passwd", "secret", "token", "api")
_assign = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_access = re.compile(r"AKIA[A-Z0-9]+")
_hex = re.compile(r"[0-9a-f]{32,}")
_candidate = re.compile(r"[A-Za-z0-9+/_-]{%d,}={0,2}" % LEAST)
_letters = re.compile(r"[^A-Za-z]+")

# Alphabets, the smaller ones first.
ALPHABETS = (
    "0123456789", "0123456789abcdef", "0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "0123456789abcdefghijklmnopqrstuvwxyz", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_",
)
_PLACES = [{c: i for i, c in enumerate(a)} for a in ALPHABETS]
_SETS = [frozenset(a) for a in ALPHABETS]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """Start, number of the kind, end of the known forms, in order."""
    out = []
    lowered = text.lower()
    if any(name in lowered for name in _NAMES):
        out += [(m.start(), 0, m.end()) for m in _assign.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _access.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), 2, m.end()) for m in _hex.finditer(text)]
    return sorted(out)


def _tail(z: np.ndarray) -> np.ndarray:
    """Chance of a standard normal value beyond z (Abramowitz and Stegun 26.2.17)."""
    a = np.abs(z)
    t = 1 / (1 + 0.2316419 * a)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    upper = np.exp(-a * a / 2) / np.sqrt(2 * np.pi) * poly
    return np.where(z >= 0, upper, 1 - upper)


def randomness(values: np.ndarray, size: int) -> tuple[float, float, float]:
    """p-values of a string of numbers below ``size``: uniformity, runs, serial correlation."""
    n = len(values)
    expected = n / size
    chi, free = float(((np.bincount(values, minlength=size) - expected) ** 2).sum() / expected), size - 1
    cube = 2 / (9 * free)
    uniform = _tail(np.array(((chi / free) ** (1 / 3) - (1 - cube)) / cube ** 0.5))
    high = values >= size / 2
    ups = int(high.sum())
    downs = n - ups
    if ups and downs:
        mean = 2 * ups * downs / n + 1
        spread = max((mean - 1) * (mean - 2) / (n - 1), 1e-9) ** 0.5
        runs = 2 * _tail(np.abs((1 + int((high[1:] != high[:-1]).sum()) - mean) / np.array(spread)))
        # A lopsided share of high values is itself evidence.
        runs = min(float(runs), float(2 * _tail(np.abs(np.array(2 * ups - n) / n ** 0.5))) * 2, 1.0)
    else:
        runs = 2.0 ** (1 - n)
    centred = values - (size - 1) / 2
    power = float((centred ** 2).sum())
    serial = 2 * _tail(np.abs(np.array((centred[1:] * centred[:-1]).sum() / power * n ** 0.5))) if power else 0.0
    return float(uniform), float(runs), float(serial)


def encoding_of(string: str) -> int | None:
    """Number of the smallest alphabet that holds all characters."""
    used = frozenset(string.rstrip("="))
    return next((i for i, s in enumerate(_SETS) if used <= s), None)


def score(string: str, encoding: int | None) -> float:
    """Fisher's joint p-value of the tests, for a random string over an alphabet; 0 if it has other characters."""
    string = string.rstrip("=")
    if encoding is None or len(set(string)) < 2 or not _SETS[encoding].issuperset(string):
        return 0.0
    values = np.fromiter(map(_PLACES[encoding].__getitem__, string), np.int64, len(string))
    half = -sum(np.log(max(p, 1e-300)) for p in randomness(values, len(ALPHABETS[encoding])))
    return float(np.exp(-half) * (1 + half + half * half / 2))


def level(value: float) -> int:
    """The score on a scale of even steps of its logarithm; the highest step holds all above a half."""
    return max(0, LEVELS - 1 - int(-np.log2(max(value, 1e-12)) * 1.5))


def class_of(encoding: int | None, length: int) -> int:
    """Strings of one alphabet and like length are judged together."""
    own = len(ALPHABETS) if encoding is None else encoding
    return own * len(LENGTHS) + int(np.searchsorted(LENGTHS, length, "right")) - 1


CLASSES = (len(ALPHABETS) + 1) * len(LENGTHS)


def candidates(text: str, taken: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, int, int, list[int]]]:
    """Start, end, class, level, and levels of the controls under the same alphabet."""
    for match in _candidate.finditer(text):
        start, end = match.span()
        if any(a < end and b > start for a, _, b in taken):
            continue
        length = end - start
        before = _letters.sub("", text[max(0, start - REACH):start])
        step = max(1, (len(before) - length) // CONTROLS)
        controls = [before[i:i + length] for i in range(0, len(before) - length + 1, step)][-CONTROLS:]
        own = encoding_of(match.group())
        yield start, end, class_of(own, length), level(score(match.group(), own)), [level(score(c, own)) for c in controls]


_SCAN = "doc_id long, kinds array<int>, starts array<int>, ends array<int>, c_starts array<int>, c_ends array<int>, " \
    "c_class array<int>, c_level array<int>, x_class array<int>, x_level array<int>"


def _scanner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ints = pa.list_(pa.int32())
    names = ("kinds", "starts", "ends", "c_starts", "c_ends", "c_class", "c_level", "x_class", "x_level")
    for batch in batches:
        columns: dict[str, list] = {name: [] for name in names}
        for text in batch.column(1).to_pylist():
            base = base_spans(text)
            found = list(candidates(text, base))
            rows = ([k for _, k, _ in base], [s for s, _, _ in base], [e for _, _, e in base],
                    [f[0] for f in found], [f[1] for f in found], [f[2] for f in found], [f[3] for f in found],
                    [f[2] for f in found for _ in f[4]], [x for f in found for x in f[4]])
            for name, row in zip(names, rows):
                columns[name].append(row)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(columns[n], ints) for n in names)], names=["doc_id", *names])


def least_levels(found: dict[tuple[int, int], int], controls: dict[tuple[int, int], int], alpha: float = ALPHA) -> dict[int, int]:
    """Per class the least level that counts as a discovery; from counts by (class, level).

    The p-value of a level is the share of controls at it or above. A class with
    few controls takes those of its alphabet's shorter strings, which pass more
    easily, and then of longer ones. Without any, only strings that pass every
    test stand.
    """
    tails: dict[int, np.ndarray] = {}
    for group in range(CLASSES):
        first = group - group % len(LENGTHS)
        counts = np.zeros(LEVELS)
        for own in (*range(group, first - 1, -1), *range(group + 1, first + len(LENGTHS))):
            counts += [controls.get((own, step), 0) for step in range(LEVELS)]
            if counts.sum() >= ENOUGH:
                break
        tails[group] = (1 + counts[::-1].cumsum()[::-1]) / (1 + counts.sum())
        if not counts.sum():
            tails[group] = np.where(np.arange(LEVELS) >= LEVELS - 4, 0.0, 1.0)
    p_values = sorted((tails[g][l], n) for (g, l), n in found.items())
    total, seen, limit = sum(n for _, n in p_values), 0, -1.0
    for p, n in p_values:
        seen += n
        if p <= alpha * seen / total:
            limit = p
    return {g: min((l for l in range(LEVELS) if tails[g][l] <= limit), default=LEVELS) for g in tails}


def find(documents: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """One row per document: doc_id, spans (kind, start, end; by start, then kind).

    Kinds are assign, access, hex, and random for strings that the tests find.
    Offsets are code points, ends exclusive. Null and empty texts have no spans.
    Every row gives a row, repeated ones too, and doc_id may be null; other
    columns are ignored. An empty table gives no row.
    """
    ready(documents.sparkSession)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text("text").alias("text"))
    scan = stored(rows.mapInArrow(_scanner, _SCAN), "secrets")

    def histogram(group: str, step: str) -> dict[tuple[int, int], int]:
        pairs = scan.select(F.explode(F.arrays_zip(F.col(group).alias("g"), F.col(step).alias("l"))).alias("x"))
        counts = pairs.groupBy("x.g", "x.l").agg(F.count("*").alias("n")).collect()  # classes times levels at most
        return {(r["g"], r["l"]): r["n"] for r in counts}

    least = least_levels(histogram("c_class", "c_level"), histogram("x_class", "x_level"), alpha)
    needed = F.array(*(F.lit(least[g]) for g in range(CLASSES)))
    order = F.array(*map(F.lit, KINDS))
    base = F.transform(F.arrays_zip("kinds", "starts", "ends"), lambda x: F.struct(
        x["starts"].alias("start"), x["kinds"].alias("number"), x["ends"].alias("end")))
    more = F.transform(
        F.filter(F.arrays_zip("c_starts", "c_ends", "c_class", "c_level"), lambda x: x["c_level"] >= F.get(needed, x["c_class"])),
        lambda x: F.struct(x["c_starts"].alias("start"), F.lit(len(KINDS)).alias("number"), x["c_ends"].alias("end")))
    spans = F.transform(F.array_sort(F.concat(base, more)), lambda x: F.struct(
        F.coalesce(F.get(order, x["number"]), F.lit(RANDOM)).alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    return scan.select("doc_id", spans.alias("spans"))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op3_secrets(spark, sf_dir: str) -> DataFrame:
    rows = find(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"] != RANDOM)
    return rows.select(
        "doc_id", *(count(kind) for kind in (*KINDS, RANDOM)), F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"))


def digest(spans: list[tuple[int, int, int]]) -> str:
    """Digest of base spans as ``base_spans`` gives them."""
    return hashlib.sha256(",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans).encode()).hexdigest()


QUERIES = {"op3_secrets": op3_secrets}
ORACLE: dict[str, str] = {}
