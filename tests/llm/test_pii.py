"""Personal data against Python's patterns; disclosure against counts by hand."""

import math
import re

from pyspark.sql import functions as F

from matchflow.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
TEXTS = [
    "a@b.c%d@e.f x@y..z q@w.ee. é@é.com aé@b.co a.b+c-d_e%f@x-y.z-w.info@other.org",
    "1.2.3.4.5.6 999.1.1.1 0000255.1.2.3 10.0.0.1:80 256.1.1.1 1.1.1.1.1.1.1.1 000.00.0.00000 1.2.3.00000000000000000255",
    "4111 1111 1111 1111 😀 4111-1111-1111-1112 4111111111111111 5500-0000 0000 0004 12345678901234567890 0000000000000000",
    "+1 (555) 123-4567. +++1234567890 +12 3 +1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 +49-30-123456 +1........",
    "", None, "none here", "😀 mail: x@y.zz 😀 +1 555 123 4567 😀", "a" * 50_000, "1" * 30_000, "1 " * 20_000 + "@" * 500, "1.1.1." * 2000,
    "+1" + " 2" * 3000, "a@b" * 3000,
]


def luhn(number):
    total = 0
    for i, c in enumerate(reversed(number)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def valid(kind, value):
    number = re.sub("[^0-9]", "", value)
    return {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in value.split(".")),
            "card": lambda: 16 <= len(number) <= 19 and luhn(number), "phone": lambda: 8 <= len(number) <= 15}[kind]()


def brute(text):
    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if valid(k, m.group())]


def test_base_spans(documents):
    frame = documents(TEXTS)
    for name in ("rid", "spans", "found_email", "row", "start"):
        frame = frame.withColumn(name, F.lit("clash"))
    got = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["spans"]] for r in pii.find(frame).collect()}
    assert got == {i: brute(t) for i, t in enumerate(TEXTS)}


def test_no_python_runs(documents):
    plan = pii.find(documents(TEXTS[:3]))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def near(text, spans):
    """(entity, term, start, end) by hand."""
    out = []
    for kind, start, end in spans:
        value = text[start:end]
        entity = f"{kind}:{re.sub('[^0-9]', '', value) if kind in ('card', 'phone') else value.lower()}"
        for m in re.finditer(r"[^\W\d_]{4,}", text):
            inside = (start - pii.REACH <= m.start() and m.end() <= start) or (end <= m.start() and m.end() <= end + pii.REACH)
            if inside and not any(a < m.end() and m.start() < b for _, a, b in spans):
                out.append((entity, m.group().lower(), m.start(), m.end()))
    return out


def test_disclosing_terms(documents):
    common = "this line goes with anything and everyone writes those words here "
    rows = [f"{common} zanzibar ambassador x{i}@mail.org consul {common}" for i in range(2)]
    rows += [f"Zanzibar ambassador hello one@mail.org consul, {common} tag{'e' * i}nd" for i in range(4)]
    rows += [common + "consul " + "abcdefgh"[i % 8] * 5 for i in range(30)] + [common + f"ip 10.0.0.{i % 4} router" for i in range(8)]
    rows += [rows[2], None, ""]
    spans = [brute(t) for t in rows]
    seen = [(i, *x) for i, t in enumerate(rows) if t for x in near(t, spans[i])]
    n_e, n_et = {}, {}
    for i, e, t, _, _ in seen:
        n_e.setdefault(e, set()).add(i)
        n_et.setdefault((e, t), set()).add(i)
    holds = [set(re.findall(r"[^\W\d_]{4,}", (t or "").lower())) for t in rows]
    told = set()
    for (e, t), both in n_et.items():
        n_t = sum(t in h for h in holds)
        pmi = math.log2(len(rows) * len(both) / (len(n_e[e]) * n_t))
        if len(both) >= pii.SUPPORT and pmi >= pii.SHARE * math.log2(len(rows) / len(n_e[e])) - 1e-12:
            told.add((e, t))
    assert told
    want = {i: sorted({(a, b) for j, e, t, a, b in seen if j == i and (e, t) in told}) for i in range(len(rows))}
    got = {r["doc_id"]: [(s["start"], s["end"]) for s in r["terms"]] for r in pii.find(documents(rows).repartition(3)).collect()}
    assert got == want


def test_masking_keeps_rows_and_columns(documents):
    rows = [(1, "write to a@b.cd or +1 555 123 4567!"), (2, "nothing"), (2, "nothing"), (None, None), (4, ""),
            (5, "1.2.3.4@x.yz and 10.0.0.1 end")]
    frame = documents(rows)
    for name in ("rid", "spans", "all", "clean", "terms"):
        frame = frame.withColumn(name, F.lit(name))
    out = pii.sanitised(frame)
    assert out.columns == frame.columns and out.dtypes == frame.dtypes
    got = sorted(((r["doc_id"], r["text"], r["n_chars"], r["spans"]) for r in out.collect()), key=str)
    want = [(1, "write to [EMAIL] or [PHONE]!"), (2, "nothing"), (2, "nothing"), (None, None), (4, ""), (5, "[EMAIL] and [IP] end")]
    assert got == sorted(((i, t, None if t is None else len(t), "spans") for i, t in want), key=str)


def test_empty_table(documents):
    assert pii.find(documents([])).count() == 0
    assert pii.sanitised(documents([])).count() == 0


def test_terms_far_off_and_short_ones_are_masked(documents):
    filler = " and so on with words that all the mails have" * 20
    rows = [f"Kim Zanzibar writes{filler} kim@mail.org{filler} yours kim" for _ in range(3)]
    rows += [f"somebody writes{filler} yours" for _ in range(60)]
    got = sorted(r["text"] for r in pii.sanitised(documents(rows)).collect())
    assert got[60:] == [f"somebody writes{filler} yours"] * 3
    assert got[:3] == [f"[TERM] [TERM] writes{filler} [EMAIL]{filler} yours [TERM]"] * 3


def test_texts_are_kept_once_and_plain_rows_do_not_move(documents, monkeypatch):
    kept, keep = {}, pii.stored

    def stored(df, name):
        kept[name] = keep(df, name)
        return kept[name]

    monkeypatch.setattr(pii, "stored", stored)
    out = pii.sanitised(documents([f"x{i}@mail.org" if i % 9 == 0 else f"plain {i}" for i in range(90)]))
    assert sorted(kept["pii"].columns) == ["rid", "row", "spans"]
    assert kept["pii-entities"].count() == 10
    join = re.search(r"Join LeftOuter.*?(?=\nUnion|\Z)", out._jdf.queryExecution().optimizedPlan().toString(), re.S).group()
    assert re.search(r"Filter .*size\(spans", join)
    assert out.count() == 90 and out.filter("text like 'plain%'").count() == 80
