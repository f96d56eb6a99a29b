"""Substring dedup against counting all windows in memory."""

import collections
import random
from hashlib import sha256

import pytest

from normlens.llm import catalog
from normlens.llm.substring_dedup import SuffixAutomaton, remove_repeated


def slow(texts, width):
    words = [(t or "").encode().split() for t in texts]
    times = collections.Counter(tuple(w[i:i + width]) for w in words for i in range(len(w) - width + 1))
    out = []
    for w in words:
        gone = set()
        for i in range(len(w) - width + 1):
            if times[tuple(w[i:i + width])] > 1:
                gone.update(range(i, i + width))
        out.append((len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return out


def test_automaton_counts_windows():
    rng = random.Random(0)
    for _ in range(30):
        sequences = [([rng.randrange(3) for _ in range(rng.randrange(1, 30))], rng.randrange(1, 4)) for _ in range(5)]
        made = SuffixAutomaton(sequences)
        for width in (1, 3, 5):
            times = collections.Counter()
            for s, weight in sequences:
                for i in range(len(s) - width + 1):
                    times[tuple(s[i:i + width])] += weight
            for s in [s for s, _ in sequences] + [[rng.randrange(4) for _ in range(20)]]:
                assert made.window_counts(s, width) == [times[tuple(s[i:i + width])] for i in range(len(s) - width + 1)]


def corpus(seed, vocabulary):
    rng = random.Random(seed)
    words = [f"w{i}é" for i in range(vocabulary)]
    passages = [[rng.choice(words) for _ in range(rng.randrange(3, 40))] for _ in range(6)]
    texts = []
    for _ in range(100):
        parts = []
        for _ in range(rng.randrange(6)):
            parts += rng.choice(passages) if rng.random() < 0.5 else [rng.choice(words) for _ in range(rng.randrange(30))]
        texts.append(rng.choice(["", "\n", " \t"]) + rng.choice([" ", "\n", " \x0b"]).join(parts) if parts else rng.choice([None, "", " "]))
    return texts + ["a " * 300, "b c " * 40, texts[0], texts[1]]


@pytest.mark.parametrize("vocabulary, hot", [(4, 5), (60, 200), (4000, 3)])
def test_against_all_windows(spark, vocabulary, hot):
    texts = corpus(vocabulary, vocabulary)
    # Ids repeat and are null; columns clash with those made inside.
    docs = spark.createDataFrame([(i % 50 if i % 7 else None, t, i, "x") for i, t in enumerate(texts)],
                                 "doc_id long, text string, lo int, anchor string").repartition(5)
    cut = remove_repeated(docs, width=6, gram=4, hot=hot)
    assert cut.columns == ["doc_id", "text", "lo", "anchor", "n_words", "n_removed"]
    got = {r.lo: (r.n_words, r.n_removed, " ".join((r.text or "").split())) for r in cut.collect()}
    assert got == dict(enumerate(slow(texts, 6)))


def test_texts_without_repeats_stay_as_they_are(spark):
    docs = spark.createDataFrame([(1, " a \n\n b  c "), (2, None), (3, "")], "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in remove_repeated(docs).collect()) == [(1, " a \n\n b  c "), (2, None), (3, "")]
    assert remove_repeated(docs.limit(0)).count() == 0


def test_query_over_whole_table(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    want = {r.doc_id: (n, gone, sha256(kept.encode()).hexdigest()) for r, (n, gone, kept) in zip(docs, slow([r.text for r in docs], 35))}
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in catalog.QUERIES["op8_substring_dedup"](spark, folder).collect()}
    assert got == want
