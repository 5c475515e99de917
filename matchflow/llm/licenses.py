"""Licences by the sentences they are made of.

A text is cut into sentences, each is normalised, and known sentences become
identifiers. A licence is an ordered rule over identifiers: its sentences must
come in that order, with at most a few other sentences between two of them. So
a full licence text, its short notice and a tag are told apart, and a quoted
single sentence of a longer licence counts for little.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchflow.llm.common import ready, table, whole_text

#: Unknown sentences that may lie between two sentences of a rule.
SLACK = 3

# Sentences of licences, by identifier, as they are published. "<...>" stands
# for a name, a year or a version; a bracketed part may be missing.
SENTENCES = {
    "mit-tag": ["released under the mit license", "licensed under the mit license", "distributed under the mit license",
                "this project is licensed under the mit license", "available under the mit license"],
    "mit-title": ["mit license", "the mit license", "the mit license mit"],
    "permission-granted": [
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
        "documentation files the software to deal in the software without restriction including without limitation the "
        "rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit "
        "persons to whom the software is furnished to do so subject to the following conditions"],
    "notice-included": [
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions "
        "of the software"],
    "as-is": ["the software is provided as is without warranty of any kind express or implied including but not limited to "
              "the warranties of merchantability fitness for a particular purpose and noninfringement"],
    "no-liability": [
        "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in "
        "an action of contract tort or otherwise arising from out of or in connection with the software or the use or "
        "other dealings in the software"],
    "isc-permission": [
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
        "granted provided that the above copyright notice and this permission notice appear in all copies"],
    "isc-as-is": ["the software is provided as is and the author disclaims all warranties with regard to this software "
                  "including all implied warranties of merchantability and fitness"],
    "apache-2-tag": ["licensed under the apache license version 2 0", "released under the apache license version 2 0",
                     "distributed under the apache license version 2 0",
                     "licensed under the apache license version 2 0 the license"],
    "apache-2-title": ["apache license version 2 0 january 2004", "apache license version 2 0"],
    "apache-compliance": ["you may not use this file except in compliance with the license"],
    "apache-copy": ["you may obtain a copy of the license at"],
    "apache-as-is": [
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed "
        "on an as is basis without warranties or conditions of any kind either express or implied"],
    "apache-see": ["see the license for the specific language governing permissions and limitations under the license"],
    "bsd-conditions": [
        "redistribution and use in source and binary forms with or without modification are permitted provided that the "
        "following conditions are met"],
    "bsd-source": [
        "redistributions of source code must retain the above copyright notice this list of conditions and the following "
        "disclaimer"],
    "bsd-binary": [
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the "
        "following disclaimer in the documentation and or other materials provided with the distribution"],
    "bsd-endorse": [
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
        "products derived from this software without specific prior written permission"],
    "bsd-as-is": ["this software is provided by the copyright holders and contributors as is and any express or implied "
                  "warranties including but not limited to the implied warranties of merchantability and fitness for a "
                  "particular purpose are disclaimed"],
    "bsd-2-tag": ["licensed under the bsd 2 clause license", "released under the bsd 2 clause license"],
    "bsd-3-tag": ["licensed under the bsd 3 clause license", "released under the bsd 3 clause license"],
    "gpl-free": ["this program is free software you can redistribute it and or modify it under the terms of the gnu general "
                 "public license as published by the free software foundation either version <> of the license or at your "
                 "option any later version"],
    "gpl-3-tag": ["this work is licensed under the gnu general public license version 3",
                  "licensed under the gnu general public license version 3",
                  "released under the gnu general public license version 3"],
    "gpl-2-tag": ["this work is licensed under the gnu general public license version 2",
                  "licensed under the gnu general public license version 2",
                  "released under the gnu general public license version 2"],
    "gpl-hope": ["this program is distributed in the hope that it will be useful but without any warranty without even the "
                 "implied warranty of merchantability or fitness for a particular purpose"],
    "gpl-received": ["you should have received a copy of the gnu general public license along with this program"],
    "lgpl-free": ["this library is free software you can redistribute it and or modify it under the terms of the gnu lesser "
                  "general public license as published by the free software foundation either version <> of the license "
                  "or at your option any later version"],
    "lgpl-tag": ["licensed under the gnu lesser general public license version <>",
                 "licensed under the gnu lesser general public license"],
    "agpl-tag": ["licensed under the gnu affero general public license version 3"],
    "mpl-2": ["this source code form is subject to the terms of the mozilla public license v 2 0",
              "licensed under the mozilla public license version 2 0"],
    "mpl-copy": ["if a copy of the mpl was not distributed with this file you can obtain one at"],
    "epl-2": ["this program and the accompanying materials are made available under the terms of the eclipse public license 2 0"],
    "cc-by-tag": ["licensed under cc by 4 0", "licensed under a creative commons attribution 4 0 international license",
                  "this work is licensed under a creative commons attribution 4 0 international license"],
    "cc-by-sa-tag": ["licensed under cc by sa 4 0",
                     "this work is licensed under a creative commons attribution sharealike 4 0 international license"],
    "cc-by-nc-tag": ["licensed under cc by nc 4 0",
                     "this work is licensed under a creative commons attribution noncommercial 4 0 international license"],
    "cc-by-nd-tag": ["licensed under cc by nd 4 0"],
    "cc0-tag": ["licensed under cc0 1 0", "released under cc0", "dedicated to the public domain under cc0 1 0"],
    "unlicense": ["this is free and unencumbered software released into the public domain"],
    "rights-reserved": ["all rights reserved"],
    "apache-terms": ["terms and conditions for use reproduction and distribution"],
    "gpl-3-title": ["gnu general public license version 3 29 june 2007"],
    "gpl-2-title": ["gnu general public license version 2 june 1991"],
    "lgpl-3-title": ["gnu lesser general public license version 3 29 june 2007"],
    "lgpl-21-title": ["gnu lesser general public license version 2 1 february 1999"],
    "agpl-3-title": ["gnu affero general public license version 3 19 november 2007"],
    "gnu-verbatim": ["everyone is permitted to copy and distribute verbatim copies of this license document but changing "
                     "it is not allowed"],
}

# Rules as licence, kind of evidence, and the sentences in order; longer rules first.
RULES = [
    ("MIT", "text", ["permission-granted", "notice-included", "as-is", "no-liability"]),
    ("MIT", "text", ["permission-granted", "notice-included", "as-is"]),
    ("ISC", "text", ["isc-permission", "isc-as-is"]),
    ("Apache-2.0", "text", ["apache-2-title", "apache-terms"]),
    ("GPL-3.0", "text", ["gpl-3-title", "gnu-verbatim"]), ("GPL-2.0", "text", ["gpl-2-title", "gnu-verbatim"]),
    ("LGPL-3.0", "text", ["lgpl-3-title", "gnu-verbatim"]), ("LGPL-2.1", "text", ["lgpl-21-title", "gnu-verbatim"]),
    ("AGPL-3.0", "text", ["agpl-3-title", "gnu-verbatim"]),
    ("Apache-2.0", "notice", ["apache-2-tag", "apache-compliance", "apache-copy", "apache-as-is", "apache-see"]),
    ("Apache-2.0", "notice", ["apache-2-tag", "apache-compliance"]),
    ("BSD-3-Clause", "text", ["bsd-conditions", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-as-is"]),
    ("BSD-3-Clause", "text", ["bsd-conditions", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("BSD-2-Clause", "text", ["bsd-conditions", "bsd-source", "bsd-binary", "bsd-as-is"]),
    ("BSD-2-Clause", "text", ["bsd-conditions", "bsd-source", "bsd-binary"]),
    ("GPL", "notice", ["gpl-free", "gpl-hope", "gpl-received"]),
    ("GPL", "notice", ["gpl-free"]),
    ("LGPL", "notice", ["lgpl-free"]),
    ("MPL-2.0", "notice", ["mpl-2", "mpl-copy"]),
    ("MIT", "tag", ["mit-tag"]), ("Apache-2.0", "tag", ["apache-2-tag"]), ("BSD-2-Clause", "tag", ["bsd-2-tag"]),
    ("BSD-3-Clause", "tag", ["bsd-3-tag"]), ("GPL-3.0", "tag", ["gpl-3-tag"]), ("GPL-2.0", "tag", ["gpl-2-tag"]),
    ("LGPL", "tag", ["lgpl-tag"]), ("AGPL-3.0", "tag", ["agpl-tag"]), ("MPL-2.0", "tag", ["mpl-2"]),
    ("EPL-2.0", "tag", ["epl-2"]), ("CC-BY-4.0", "tag", ["cc-by-tag"]), ("CC-BY-SA-4.0", "tag", ["cc-by-sa-tag"]),
    ("CC-BY-NC-4.0", "tag", ["cc-by-nc-tag"]), ("CC-BY-ND-4.0", "tag", ["cc-by-nd-tag"]), ("CC0-1.0", "tag", ["cc0-tag"]),
    ("Unlicense", "tag", ["unlicense"]),
]

_odd = re.compile(r"[^a-z0-9<>]+")
_version = re.compile(r"(?<=version )[0-9]+(?: [0-9]+)?\b|\b[0-9]+(?: [0-9]+)*(?= of the license)")
# A sentence may end at a line break, at a stop that white space follows, and at a colon or semicolon that ends a line.
_stop = re.compile(r"\n|[.!?](?=\s|$)|[;:](?=[ \t]*(?:\n|$))")
_spdx = re.compile(r"SPDX-License-Identifier:\s*([A-Za-z0-9.+-]+(?:\s+(?:AND|OR|WITH)\s+[A-Za-z0-9.+-]+)*)")
#: Every known sentence holds one of these words; other texts need no second look.
_hints = re.compile(r"licen[sc]|copyright|permission|redistribut|warrant|liab|cc0|spdx|public domain|free software|rights reserved|provided|endorse|mpl", re.I)


def normal(sentence: str) -> str:
    """Lower case, letters and digits only, one space between words."""
    plain = unicodedata.normalize("NFKC", sentence).lower()
    return _odd.sub(" ", plain).strip()


def _known() -> dict[str, str]:
    return {s: name for name, forms in SENTENCES.items() for s in forms}


KNOWN = _known()
_OPEN = {re.compile(re.escape(s).replace("<>", "[0-9]+(?: [0-9]+)?")): n for s, n in KNOWN.items() if "<>" in s}
#: Known sentences are found at the start of longer ones too, if a whole word ends there.
_PREFIXES = sorted(((s, n) for s, n in KNOWN.items() if len(s.split()) >= 4 and "<>" not in s), key=lambda x: -len(x[0]))
_START = {}
for _text, _name in _PREFIXES:
    _START.setdefault(" ".join(_text.split()[:3]), []).append((_text + " ", _name))


#: Words of known sentences, one after the other; a version has one or two numbers.
_TRIE: dict = {}
for _text in [form for s in KNOWN for form in {s, s.replace("<>", "<> <>")}]:
    _node = _TRIE
    for _word in _text.split():
        _node = _node.setdefault(_word, {})


def followed(nodes: list[dict], words: str) -> list[dict]:
    """The places in known sentences that some words lead to."""
    for word in words.split():
        nodes = [n[w] for n in nodes for w in {word, "<>" if word.isdigit() else word} if w in n]
    return nodes


def identifier(sentence: str) -> str | None:
    """The identifier of a normalised sentence."""
    name = KNOWN.get(sentence)
    if name is None:
        name = next((n for text, n in _START.get(" ".join(sentence.split(" ", 3)[:3]), ()) if (sentence + " ").startswith(text)), None)
    if name is None and "version" in sentence:
        name = next((n for pattern, n in _OPEN.items() if pattern.match(sentence)), None)
    return name


@dataclass(frozen=True)
class Sentence:
    number: int
    start: int
    end: int
    name: str


def _pieces(text: str) -> Iterator[tuple[int, int]]:
    """Where the text is cut: at stops and at line breaks."""
    at = 0
    for match in _stop.finditer(text):
        if at < match.start():
            yield at, match.start()
        at = match.end()
    if at < len(text):
        yield at, len(text)


def sentences(text: str) -> list[Sentence]:
    """The known sentences of a text, by their place among all its sentences."""
    if not _hints.search(text):
        return []
    spans = list(_pieces(text))
    words = [normal(text[a:b]) for a, b in spans]
    out, at, number = [], 0, 0
    while at < len(spans):
        best, number = None, number + bool(words[at])
        if not words[at]:
            at += 1
            continue
        # A sentence may be wrapped over lines: pieces without a stop between them, as long as they begin a known one.
        whole, until, nodes = words[at], at, followed([_TRIE], words[at])
        while True:
            name = identifier(whole) if whole else None
            if name and (best is None or name != best[0] or whole in KNOWN):
                best = (name, until)
                if until == at and KNOWN.get(whole) == name and len(whole.split()) >= 12:
                    break
            following = until + 1
            if not nodes or following >= len(spans) or text[spans[until][1]:spans[following][0]].strip(" \t\r\n*/#-"):
                break
            whole, until = f"{whole} {words[following]}".strip(), following
            nodes = followed(nodes, words[following])
        if best:
            out.append(Sentence(number, spans[at][0], spans[best[1]][1], best[0]))
            at = best[1] + 1
        else:
            at += 1
    return out


def recognised(text: str) -> list[dict]:
    """Licences in the order of their first sentences: licence, kind, start, end, rule."""
    found = sentences(text)
    used: set[int] = set()
    out = []
    for licence, kind, names in RULES:
        for first in range(len(found)):
            chain, last = [], None
            for i in range(first, len(found)):
                if len(chain) == len(names) or (last is not None and found[i].number - last > SLACK + 1):
                    break
                if i not in used and found[i].name == names[len(chain)]:
                    chain.append(i)
                    last = found[i].number
                elif not chain:
                    break
            if len(chain) == len(names):
                used.update(chain)
                out.append({"licence": licence, "kind": kind, "start": found[chain[0]].start, "end": found[chain[-1]].end,
                            "rule": ">".join(names)})
    for match in _spdx.finditer(text):
        out.append({"licence": match[1], "kind": "spdx", "start": match.start(), "end": match.end(), "rule": "spdx"})
    return sorted(out, key=lambda x: (x["start"], x["end"], x["licence"]))


_LICENCES = "array<struct<licence:string,kind:string,start:int,end:int,rule:string>>"


def _scanner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([
        ("licence", pa.string()), ("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("rule", pa.string())]))
    for batch in batches:
        found = [recognised(text) for text in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], names=["doc_id", "licences"])


def scan(documents: DataFrame) -> DataFrame:
    """One row per document: doc_id, licences (licence, kind, start, end, rule), in order.

    Kinds are text, notice, tag and spdx. Of rules that claim one sentence the
    longer one gets it. Offsets are code points, ends exclusive. Null and empty
    texts have none. Rows that repeat give a row each, doc_id may be null, other
    columns are ignored, an empty table gives no row.
    """
    ready(documents.sparkSession)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text("text").alias("text"))
    return rows.mapInArrow(_scanner, f"doc_id long, licences {_LICENCES}")


def op7_licenses(spark, sf_dir: str) -> DataFrame:
    rows = scan(table(spark, sf_dir, "documents"))
    names = F.transform("licences", lambda x: F.concat_ws(":", x["licence"], x["kind"], x["start"].cast("string"), x["end"].cast("string")))
    return rows.select("doc_id", F.size("licences").cast("long").alias("n_licences"), F.array_join(names, ",").alias("licences"))


QUERIES = {"op7_licenses": op7_licenses}
ORACLE: dict[str, str] = {}
