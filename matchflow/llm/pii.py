"""Personal data, and the terms that give it away, with DataFrame functions only.

E-mail addresses, IP addresses, card and phone numbers are found by pattern and
check. They are the protected entities. A term in a document with an entity
discloses it if the corpus says so: with n(e) documents that hold entity e, n(t)
that hold term t, n(e,t) that hold both, and N in all,

    PMI(e;t) = log2(N n(e,t) / (n(e) n(t)))  and  IC(e) = log2(N / n(e)),

t discloses e if PMI(e;t) >= SHARE * IC(e) and n(e,t) >= SUPPORT. All counts
are over whole texts of all documents. Sanitising generalises entities to their
kind and removes every occurrence of a disclosing term in documents with its entity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchflow.llm.common import ready, stored, table, whole_text

#: Share of an entity's information that a term may give away, and documents that must bear it out.
SHARE, SUPPORT = 0.9, 2
#: Code points on either side of an entity in which terms are looked at: as many as a text can have.
REACH = (1 << 31) - 1

# The kinds in order, with their patterns. Possessive repeats match
# the same as greedy ones here, without recursion; the starts left out by the
# lookbehinds are inside a run whose first character fails just as well.
KINDS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
TERM = "term"
_TERMS = r"\p{L}++"
#: Stands for a character of an entity; a word that touches one is no term.
_MARK = "\ufdd0"
_FREE_START, _FREE_END = rf"(?<![\p{{L}}{_MARK}])", rf"(?!{_MARK})"
_FREE_TERMS = _FREE_START + _TERMS + _FREE_END
#: What must be in a text for a kind to be looked for.
_NEEDS = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}


def found(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def gaps(text: Column, pattern: str) -> Column:
    """Lengths of what lies between the matches, in code points."""
    return F.transform(F.split(text, pattern, -1), lambda x: F.length(x))


def placed(matches: Column, between: Column, offset: Column | int = 0) -> Column:
    """Start, end (exclusive) and value of matches, from the lengths between them."""
    start = offset if isinstance(offset, Column) else F.lit(offset)
    empty = F.array().cast("array<struct<start:int,end:int,value:string>>")

    def step(state: Column, i: Column) -> Column:
        begin = state["at"] + F.get(between, i)
        value = F.get(matches, i)
        end = begin + F.length(value)
        one = F.struct(begin.alias("start"), end.alias("end"), value.alias("value"))
        return F.struct(end.alias("at"), F.concat(state["out"], F.array(one)).alias("out"))

    steps = F.aggregate(
        F.sequence(F.lit(0), F.size(matches) - 1),
        F.struct(start.cast("int").alias("at"), empty.alias("out")), step, lambda s: s["out"])
    return F.when(F.size(matches) > 0, steps).otherwise(empty)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether the check digit of a string of digits holds."""
    def step(total: Column, i: Column) -> Column:
        digit = F.substring(number, F.length(number) - i, F.lit(1)).cast("int")
        twice = F.when(digit > 4, digit * 2 - 9).otherwise(digit * 2)
        return total + F.when(i % 2 == 1, twice).otherwise(digit)

    total = F.aggregate(F.sequence(F.lit(0), F.length(number) - 1), F.lit(0), step)
    return total % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (
            F.coalesce(F.nullif(F.right(p, F.lit(3)), F.lit("")), F.lit("0")).cast("int") <= 255))
    if kind == "card":
        count = F.length(digits(value))
        return F.when(count.between(16, 19), luhn(digits(value))).otherwise(False)
    if kind == "phone":
        return F.length(digits(value)).between(8, 15)
    return F.lit(True)


_SPANS = "array<struct<kind:string,start:int,end:int,value:string>>"


def _kept(kind: str, at: Column) -> Column:
    """The spans that pass the check of their kind."""
    return F.transform(
        F.filter(at, lambda s: _valid(kind, s["value"])),
        lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")))


def detected(documents: DataFrame) -> DataFrame:
    """``row`` (all columns), ``text``, and ``spans``: kind, start, end, value, by kind and start."""
    rows = documents.select(F.struct("*").alias("row"), whole_text("text").alias("text"))
    none = F.array().cast("array<string>")
    for kind, pattern in KINDS.items():
        rows = rows.withColumn(f"found_{kind}", F.when(F.col("text").rlike(_NEEDS[kind]), found(F.col("text"), pattern)).otherwise(none))
    for kind, pattern in KINDS.items():
        rows = rows.withColumn(f"gaps_{kind}", F.when(F.size(f"found_{kind}") > 0, gaps(F.col("text"), pattern)))
    spans = [_kept(kind, placed(F.col(f"found_{kind}"), F.col(f"gaps_{kind}"))) for kind in KINDS]
    return rows.select("row", "text", F.concat(*spans).cast(_SPANS).alias("spans"))


def entity_of(kind: Column, value: Column) -> Column:
    """One name for the ways an entity is written."""
    return F.concat_ws(":", kind, F.when(kind.isin("card", "phone"), digits(value)).otherwise(F.lower(value)))


def blanked(text: Column, spans: Column) -> Column:
    """The text with a mark for each character of the spans."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))

    def step(state: Column, s: Column) -> Column:
        gap = F.substring(text, state["at"] + 1, F.greatest(s["start"] - state["at"], F.lit(0)))
        marks = F.repeat(F.lit(_MARK), F.greatest(s["end"] - F.greatest(state["at"], s["start"]), F.lit(0)))
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), F.concat(state["out"], gap, marks).alias("out"))

    return F.aggregate(ordered, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step,
                       lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))))


def _lowered(words: Column) -> Column:
    return F.array_distinct(F.transform(words, lambda w: F.lower(w)))


def disclosing(documents: DataFrame, held: DataFrame, share: float = SHARE, support: int = SUPPORT) -> DataFrame:
    """The terms that give an entity away: entity, told. ``held``: rid, entities, blank."""
    entities = held.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count("*").alias("n_entity")).filter(
        F.col("n_entity") >= support)  # no term can stand with the others often enough
    known = held.select("rid", F.explode("entities").alias("entity")).join(entities.select("entity"), "entity").groupBy("rid").agg(
        F.collect_list("entity").alias("known"))
    words = held.join(known, "rid").select("known", F.explode(_lowered(found(F.col("blank"), _FREE_TERMS))).alias("term"))
    pairs = words.select(F.explode("known").alias("entity"), "term").groupBy("entity", "term").agg(
        F.count("*").alias("n_both")).filter(F.col("n_both") >= support)
    terms = documents.select(F.explode(_lowered(found(whole_text("text"), _TERMS))).alias("term")).groupBy("term").agg(
        F.count("*").alias("n_term"))
    total = documents.agg(F.count("*").alias("total"))
    scored = pairs.join(entities, "entity").join(terms, "term").crossJoin(F.broadcast(total))  # one row
    pmi = F.log2(F.col("total") * F.col("n_both") / (F.col("n_entity") * F.greatest("n_term", "n_both")))
    content = F.log2(F.col("total") / F.col("n_entity"))
    return scored.filter(pmi >= share * content).groupBy("entity").agg(F.collect_set("term").alias("told"))


def term_spans(base: DataFrame, documents: DataFrame) -> DataFrame:
    """Spans of disclosing terms by row: rid, terms. ``base``: rid, text, spans.

    A term is a word in lower case that lies outside of every entity; all its
    places in a document with the entity count.
    """
    held = stored(base.filter(F.size("spans") > 0).select(
        "rid", F.array_distinct(F.transform("spans", lambda s: entity_of(s["kind"], s["value"]))).alias("entities"),
        blanked(F.translate("text", _MARK, " "), F.col("spans")).alias("blank")), "pii-entities")
    told = held.select("rid", F.explode("entities").alias("entity")).join(disclosing(documents, held), "entity").groupBy("rid").agg(
        F.array_distinct(F.flatten(F.collect_list("told"))).alias("told"))
    forms = F.filter(F.array_distinct(found(F.col("blank"), _FREE_TERMS)), lambda w: F.array_contains("told", F.lower(w)))
    asked = held.join(told, "rid").select("rid", "blank", forms.alias("forms")).filter(F.size("forms") > 0).withColumn(
        "pattern", F.concat(F.lit(_FREE_START + "(?:"), F.array_join("forms", "|"), F.lit(r")(?!\p{L})" + _FREE_END)))
    at = placed(F.regexp_extract_all(F.col("blank"), F.col("pattern"), F.lit(0)),
                F.transform(F.split(F.col("blank"), F.col("pattern"), -1), lambda x: F.length(x)))
    return asked.select("rid", F.transform(at, lambda t: F.struct(
        F.lit(TERM).alias("kind"), t["start"].alias("start"), t["end"].alias("end"),
        F.lit(None).cast("string").alias("value"))).alias("terms"))


def find(documents: DataFrame) -> DataFrame:
    """One row per document: doc_id, spans (base) and terms, arrays of kind, start, end, value.

    Offsets are code points, ends exclusive. Null and empty texts have none. Rows
    are kept apart, so equal rows give a row each and doc_id may be null. Other
    columns are ignored, an empty table gives no row.
    """
    ready(documents.sparkSession)
    base = detected(documents).select(
        F.monotonically_increasing_id().alias("rid"), F.col("row.doc_id").cast("long").alias("doc_id"),
        F.when(F.size("spans") > 0, F.col("text")).alias("text"), "spans")
    base = stored(base, "pii")
    terms = term_spans(base, documents)
    return base.join(terms, "rid", "left").select(
        "doc_id", "spans", F.coalesce("terms", F.array().cast(_SPANS)).alias("terms"))


def masked(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind; spans that overlap become one, named by the first and longest."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(
        s["start"].alias("start"), (-s["end"]).alias("minus_end"), s["kind"].alias("kind"))))

    def step(state: Column, s: Column) -> Column:
        end = -s["minus_end"]
        gap = F.substring(text, state["at"] + 1, s["start"] - state["at"])
        more = F.struct(end.alias("at"), F.concat(state["out"], gap, F.lit("["), F.upper(s["kind"]), F.lit("]")).alias("out"))
        longer = F.struct(F.greatest(state["at"], end).alias("at"), state["out"].alias("out"))
        return F.when(s["start"] >= state["at"], more).otherwise(longer)

    return F.aggregate(
        ordered, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step,
        lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))))


def sanitised(documents: DataFrame) -> DataFrame:
    """The documents with entities and disclosing terms masked in ``text``; n_chars follows where it is a column.

    Rows, columns and texts without entities stay as they are.
    """
    ready(documents.sparkSession)
    # The text is in the row already; kept beside it, it would be written and shuffled twice.
    base = stored(detected(documents).select("row", "spans", F.monotonically_increasing_id().alias("rid")), "pii")
    text = whole_text("row.text")
    held = F.size("spans") > 0
    terms = term_spans(base.filter(held).withColumn("text", text), documents)
    # Terms are there only where entities are, so the other rows need not move.
    both = base.filter(held).join(terms, "rid", "left").select(
        "row", F.concat("spans", F.coalesce("terms", F.array().cast(_SPANS))).alias("all"))
    both = both.unionByName(base.filter(~held).select("row", F.col("spans").alias("all")))
    changed = both.withColumn("clean", F.when(F.size("all") > 0, masked(text, F.col("all"))).otherwise(F.col("row.text")))
    out = []
    for name, kind in documents.dtypes:
        old = F.col("row").getField(name)
        if name == "text":
            old = F.col("clean")
        elif name == "n_chars":
            old = F.when(F.size("all") > 0, F.length("clean").cast(kind)).otherwise(old)
        out.append(old.alias(name))
    return changed.select(*out)


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op9_pii(spark, sf_dir: str) -> DataFrame:
    rows = find(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return rows.select(
        "doc_id", *(count(kind) for kind in KINDS), F.sha2(joined(F.col("spans")), 256).alias("base_sha256"),
        joined(F.concat("spans", "terms")).alias("spans"))


QUERIES = {"op9_pii": op9_pii}
ORACLE: dict[str, str] = {}
