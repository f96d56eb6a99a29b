"""Fill-in-middle against plain slicing, and its round trip."""

import hashlib

import numpy as np
import pytest
from check_queries import compare, connect
from hypothesis import given, settings
from hypothesis import strategies as st

import __spark_entry__ as entry
from normlens.llm import fim

SF = "/root/testdata/sf0.001"
TEXTS = ["", "a", "é", "日本語テキスト", "plain words here", "x<P>y", "x<S>", "<M", "\0\0\0", "ab\0", "12345678", "1234567é",
         "😀" * 7, "\n", "a\nb\n\nc", "<" * 9, "é" * 4001, "tail>"]


def by_slices(text, doc_id):
    h = hashlib.sha256(f"1:{doc_id}".encode()).hexdigest()
    h = [int(h[i:i + 8], 16) for i in (0, 8, 16, 24)]
    n = len(text)
    p, q = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return text, "plain", n, None, None
    a, m, s = text[:p], text[p:q], text[q:]
    if h[3] % 100 < 20:
        return f"<S>{s}<P>{a}<M>{m}", "spm", n, p, q - p
    return f"<P>{a}<S>{s}<M>{m}", "psm", n, p, q - p


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=40), min_size=1, max_size=6))
def test_offsets_of_every_unit(texts):
    coded = [t.encode() for t in texts]
    for unit in fim.UNITS:
        index = fim.UnitIndex(coded, unit)
        cuts = [list(t) if unit == "char" else t.split("\n") for t in texts]
        if unit == "line":
            cuts = [[x + "\n" for x in c[:-1]] + ([c[-1]] if c[-1] else []) for c in cuts]
        assert index.n.tolist() == [len(c) for c in cuts]
        for k in range(max(map(len, cuts)) + 1):
            units = np.minimum(index.n, k)
            want = [len("".join(c[:k]).encode()) for c in cuts]
            assert index.offsets(units).tolist() == want


def test_transform_and_restore(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS * 20)] + [(None, "no id"), (None, None), (3, None), (3, "again"), (3, "again")]
    docs = spark.createDataFrame([(i, t, "old", 1) for i, t in rows], "doc_id long, text string, form string, `_k1` int")
    made = fim.restore(fim.transform(docs)).collect()
    assert len(made) == len(rows)
    got = sorted([(r.doc_id, r.text, r.fim, r.form, r.n_units, r.prefix_units, r.middle_units) for r in made], key=repr)
    want = sorted([(i, t, *by_slices(t or "", "" if i is None else i)) for i, t in rows], key=repr)
    assert got == want
    assert all(r.restored == (r.text or "") and r._k1 == 1 for r in made)
    assert {r.form for r in made} == {"plain", "psm", "spm"}


def test_lines_and_all_forms(spark):
    docs = spark.createDataFrame([(i, "one\ntwo\nthree") for i in range(50)], "doc_id int, text string")
    made = fim.restore(fim.transform(docs, unit="line", plain_percent=0, spm_percent=50)).collect()
    assert {r.form for r in made} == {"psm", "spm"} and {r.n_units for r in made} == {3}
    assert all(r.restored == r.text for r in made)
    with pytest.raises(ValueError):
        fim.UnitIndex([b"x"], "word")


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert fim.restore(fim.transform(docs)).count() == 0


def test_query_agrees_with_sql(spark):
    assert compare(entry.queries()["op11_fim"](spark, SF), connect(SF), entry.oracle_sql()["op11_fim"]).startswith("ok")
