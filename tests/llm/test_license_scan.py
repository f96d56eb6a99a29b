"""License scans against plain loops, and the expression parser."""

import random
import re

import pytest

from normlens.llm import catalog
from normlens.llm.license_scan import BASE_PHRASES, evaluate, read_expression, scan, scan_licenses, to_postfix


def slow(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    places, labels = [], set()
    for phrase, label in BASE_PHRASES.items():
        own = phrase.split()
        for i in range(len(words) - len(own) + 1):
            if words[i:i + len(own)] == own:
                places.append(i)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_base_part_against_loops():
    rng = random.Random(0)
    words = ["CC", "by", "General", "public", "LICENSE", "gnu", "lesser", "all", "rights", "reserved", "é", "x9", "a-b", "sa", "mozilla", "nc"]
    for _ in range(3000):
        text = "".join(rng.choice(words) + rng.choice([" ", "\n", "-", ", ", "\0", "©"]) for _ in range(rng.randrange(25)))
        got = scan(text.encode())
        assert got[:5] == slow(text), text
        assert set(filter(None, got[4].split(","))) <= set(got[5].split(",")) and 0 <= got[6] <= 1


@pytest.mark.parametrize("text, ids, choice", [
    ("MIT", {"mit"}, True),
    ("GPL-2.0-only", {"gpl-2.0-only"}, False),
    ("MIT OR GPL-2.0-only", {"mit", "gpl-2.0-only"}, True),
    ("MIT AND GPL-2.0-only", {"mit", "gpl-2.0-only"}, False),
    ("GPL-2.0-only WITH Classpath-exception-2.0 OR MIT", {"gpl-2.0-only", "mit"}, True),
    ("MIT OR GPL-3.0 AND LGPL-2.1", {"mit", "gpl-3.0", "lgpl-2.1"}, True),
    ("(MIT OR GPL-3.0) AND LGPL-2.1", {"mit", "gpl-3.0", "lgpl-2.1"}, False),
    ("Apache-2.0 WITH LLVM-exception", {"apache-2.0"}, True),
    ("Apache-2.0. This file is part", {"apache-2.0"}, True),
    ("(MIT OR", {"mit"}, None),
    ("", set(), None),
    (") MIT", set(), None),
])
def test_expressions(text, ids, choice):
    assert read_expression(text) == (ids, choice)


def test_postfix_against_python():
    rng = random.Random(1)

    def make(depth):
        if not depth or rng.random() < 0.3:
            return rng.choice(["mit", "gpl"])
        a, b = make(depth - 1), make(depth - 1)
        made = f"{a} {rng.choice(['and', 'or'])} {b}"
        return f"( {made} )" if rng.random() < 0.5 else made
    for _ in range(400):
        text = make(4)
        want = eval(text.replace("mit", "True").replace("gpl", "False"))
        assert evaluate(to_postfix(text.split()))[1] is want
    assert to_postfix("mit mit".split()) is None and to_postfix("( mit".split()) is None and to_postfix(["or"]) is None


def test_tags_and_notices():
    got = scan(b"// SPDX-License-Identifier: MIT OR Apache-2.0\ncode\n/* All rights reserved. Licensed under the Apache License, Version 2.0 */")
    assert got[4:6] == ("reserved", "apache-2.0,mit,reserved") and got[7] is True and 0.9 < got[6] < 1
    assert scan(b"nothing here")[4:] == ("", "", 0.0, None)


def test_frame(spark):
    docs = spark.createDataFrame([(1, None, "a"), (None, "CC BY-SA 4.0", "b"), (1, "cc by " * 5000, "c"), (1, "", "d")],
                                 "doc_id long, text string, labels string")
    got = sorted(tuple(r)[1:6] for r in scan_licenses(docs).collect() if r.n_base) + [scan_licenses(docs.limit(0)).count()]
    assert got == [(5, 1, 0, 0, "cc-by"), (10000, 5000, 0, 9998, "cc-by"), 0]


def test_query_over_whole_table(spark):
    folder = "/root/testdata/sf0.001"
    want = {r.doc_id: slow(r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = {r.doc_id: tuple(r)[1:6] for r in catalog.QUERIES["op4_license_scan"](spark, folder).collect()}
    assert got == want
