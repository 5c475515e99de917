"""Licence texts, notices and tags; order and completeness of rules."""

from pyspark.sql import functions as F

from matchflow.llm import licenses

MIT = """MIT License

Copyright (c) 2020 Some One

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
APACHE = """# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0
#
# Unless required by applicable law or agreed to in writing, software
# distributed under the License is distributed on an "AS IS" BASIS,
# WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
# See the License for the specific language governing permissions and
# limitations under the License.
"""


def found(text):
    return [(x["licence"], x["kind"]) for x in licenses.recognised(text)]


def test_texts_notices_and_tags():
    assert found(MIT) == [("MIT", "text")]
    assert found(APACHE) == [("Apache-2.0", "notice")]
    assert found("some prose. Released under the MIT License.\nmore") == [("MIT", "tag")]
    assert found("THIS WORK IS LICENSED UNDER THE GNU GENERAL PUBLIC LICENSE, VERSION 3.") == [("GPL-3.0", "tag")]
    assert found("SPDX-License-Identifier: MIT OR Apache-2.0") == [("MIT OR Apache-2.0", "spdx")]
    assert found("Licensed under CC BY-NC 4.0. Licensed under CC BY 4.0.") == [("CC-BY-NC-4.0", "tag"), ("CC-BY-4.0", "tag")]
    assert found(MIT + APACHE) == [("MIT", "text"), ("Apache-2.0", "notice")]


def test_order_and_gaps_matter():
    parts = MIT.split("\n\n")
    assert found("\n\n".join([*parts[:2], parts[4], parts[3], parts[2]])) == []
    filler = "An unknown sentence about a license. " * 10
    assert found("\n\n".join([*parts[:3], filler, *parts[3:]])) == []
    assert found(parts[3]) == []  # a sentence that many licences share is no licence
    assert found("We do not use the MIT license here") == []


def test_spans_are_where_the_sentences_stand():
    text = "😀 x\n" + MIT
    (one,) = licenses.recognised(text)
    assert text[one["start"]:one["end"]].startswith("Permission is") and text[one["start"]:one["end"]].rstrip(".").endswith("SOFTWARE")


def test_every_rule_is_found_from_its_sentences():
    for licence, kind, names in licenses.RULES:
        text = ".\n".join(licenses.SENTENCES[n][0].replace("<>", "3") for n in names) + "."
        assert licence in [x["licence"] for x in licenses.recognised(text)], (licence, kind)


def test_table_with_odd_rows(documents):
    rows = [(1, MIT), (1, MIT), (None, APACHE), (3, None), (4, ""), (5, "license " * 20_000), (6, "no")]
    frame = documents(rows).withColumn("licences", F.lit("clash"))
    got = sorted(((r["doc_id"], len(r["licences"])) for r in licenses.scan(frame).collect()), key=str)
    assert got == sorted([(1, 1), (1, 1), (None, 1), (3, 0), (4, 0), (5, 0), (6, 0)], key=str)
    assert licenses.scan(documents([])).count() == 0


def test_narrow_lines_and_full_texts():
    names = ("permission-granted", "notice-included", "as-is", "no-liability")
    words = [w for n in names for w in (licenses.SENTENCES[n][0] + ".").split()]
    narrow = "\n//\n".join("// " + " ".join(words[i:i + 3]) for i in range(0, len(words), 3))
    assert [(x["licence"], x["kind"]) for x in licenses.recognised(narrow)] == [("MIT", "text")]
    gpl = ("GNU GENERAL PUBLIC LICENSE\n Version 3, 29 June 2007\n\nCopyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>\n"
           "Everyone is permitted to copy and distribute verbatim copies\nof this license document, but changing it is not allowed.\n")
    assert [(x["licence"], x["kind"]) for x in licenses.recognised(gpl)] == [("GPL-3.0", "text")]
    apache = "Apache License\nVersion 2.0, January 2004\nhttp://www.apache.org/licenses/\n\nTERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION\n"
    assert [(x["licence"], x["kind"]) for x in licenses.recognised(apache)] == [("Apache-2.0", "text")]
