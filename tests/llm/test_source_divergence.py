"""The audit against plain sums over all terms, its trees, and edge cases."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
from check_queries import compare, connect
from hypothesis import given, settings
from hypothesis import strategies as st

import __spark_entry__ as entry
from normlens.llm import source_divergence as sd

SF = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def plain(rows, least, top):
    groups, by_lang, docs = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        lang, words = lang or "", TERM.findall(lowered(text or ""))
        groups[lang, source or ""].update(words)
        by_lang[lang].update(words)
        docs[lang].update(set(words))
    out = []

    def share(c, n, v):
        return 1 + 1000000000 * (c + 2) // (n + 2 * v)
    for (lang, source), mine in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= least]
        v, total = len(kept), {s: sum(c[t] for t in kept) for (la, s), c in groups.items() if la == lang}
        cost = [(sum((share(mine[t], total[source], v) - share(other[t], total[s], v)) ** 2
                     // (share(mine[t], total[source], v) + share(other[t], total[s], v)) for t in kept), s)
                for (la, s), other in groups.items() if la == lang and s != source]
        whole = sum(by_lang[lang][t] for t in kept)
        terms = []
        for t in kept:
            if mine[t]:
                p, q = share(mine[t], total[source], v), share(by_lang[lang][t], whole, v)
                if p > q:
                    terms.append(((p - q) ** 2 // (p + q), t))
        for part, found, limit in (("pair", cost, None), ("term", terms, top)):
            found.sort(key=lambda x: (-x[0], x[1].encode()))
            out.extend((lang, source, part, item, value, i + 1) for i, (value, item) in enumerate(found[:limit]))
    return sorted(out)


def some_rows(n, sources, seed=3):
    rng = random.Random(seed)
    words = ["Ab", "cD", "é", "ÉCOLE", "日本", "x1y", "don't", "zz"] + [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(90)]
    rows = []
    for _ in range(n):
        source = f"s{min(int(rng.expovariate(0.4)), sources - 1)}"
        rows.append((" ".join(rng.choices(words, [1 / (k + 1) for k in range(len(words))], k=rng.randint(0, 40))),
                     rng.choice(["en", "en", "en", "de", None]), source))
    return rows + [(None, "en", "silent"), ("...", "xx", "only"), ("", "xx", None), (None, None, None), ("Ab ab", "yy", "alone")]


def result(df):
    return sorted((r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in df.collect())


def test_audit_against_plain_sums(spark):
    rows = some_rows(400, 9)
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "text string, lang string, source string, term string, n int").repartition(5)
    want = plain(rows, 10, 10)
    assert result(sd.audit(docs)) == want
    # Several blocks, and several chunks of sources.
    assert result(sd.audit(docs, block_terms=7, chunk=2)) == want
    assert result(sd.audit(docs, least_docs=2, top=3, block_terms=16, chunk=3)) == plain(rows, 2, 3)


def test_repeated_rows_and_no_kept_terms(spark):
    rows = [("same words", "en", "a")] * 30 + [("other words", "en", "b")] * 9 + [("few", "de", "a"), ("few", "de", "b")]
    docs = spark.createDataFrame(rows, "text string, lang string, source string")
    got = result(sd.audit(docs))
    assert got == plain(rows, 10, 10)
    assert ("de", "a", "pair", "b", 0, 1) in got


def test_empty_table(spark):
    assert sd.audit(spark.createDataFrame([], "text string, lang string, source string")).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 40), st.integers(2, 6), st.integers(0, 10**6))
def test_trees_price_like_plain_arrays(terms, trees, seed):
    rng = np.random.default_rng(seed)
    counts = rng.integers(0, 4, (trees, terms)) * rng.integers(0, 2, (trees, terms))
    totals = counts.sum(axis=1) + 2 * terms
    first, second = np.triu_indices(trees, 1)
    p = [sd.shares(c, t) for c, t in zip(counts, totals)]
    want = [int(((p[a] - p[b]) ** 2 // (p[a] + p[b])).sum()) for a, b in zip(first, second)]
    forest = sd.Forest(counts)
    assert forest.divergence(first, second, totals).tolist() == want


def test_equal_subtrees_are_one_node():
    sparse = np.zeros((50, 4096), dtype=np.int64)
    sparse[np.arange(50), np.arange(50)] = 1
    assert sd.Forest(sparse).nodes < 50 * 14 + 60 < 50 * 4096


def test_shares_are_exact_for_large_counts():
    for count, total in ((9 * 10**9, 10**13), (4 * 10**15, 8 * 10**15 + 1), (0, 3), (10**12, 10**12 + 4)):
        assert int(sd.shares(np.array([count]), np.array([total]))[0]) == 1 + 1000000000 * (count + 2) // total


def test_long_texts_are_read_in_pieces(monkeypatch):
    monkeypatch.setattr(sd, "PIECE", 5)
    text = "Abc défgh  日本語日本語,x".encode()
    assert [w for part in sd.terms_of(text) for w in part] == [t.encode() for t in TERM.findall(lowered(text.decode()))]


def test_query_agrees_with_sql(spark):
    name = "op12_source_divergence"
    assert compare(entry.queries()[name](spark, SF), connect(SF), entry.oracle_sql()[name]).startswith("ok")
