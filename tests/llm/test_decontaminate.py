"""Decontamination: retrieval and order checks against brute force and planted cases."""

import random

import numpy as np

from normlens.llm import decontaminate as d


def slow_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def test_common_subsequence():
    rng = random.Random(0)
    for _ in range(300):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(1, 90))] for _ in range(2))
        assert d.covered_words(np.array(a), b) == slow_common(a, b)


def test_cells_count_terms_of_passages():
    rng = np.random.default_rng(1)
    term = rng.integers(-1, 4, 200).astype(np.int32)
    first, size = np.array([0, 16, 100, 190]), np.array([32, 32, 5, 10])
    got = {(p, t): n for p, t, n in zip(*(x.tolist() for x in d._cells(term, first, size)))}
    want = {(p, t): int((term[a:a + n] == t).sum()) for p, (a, n) in enumerate(zip(first, size)) for t in range(4)}
    assert got == {k: n for k, n in want.items() if n}


def corpus():
    rng = random.Random(2)
    common = "the of and to in is that for".split()
    rare = ["".join(rng.choices("bcdfglmnprst", k=3)) + rng.choice("aeiou") + "".join(rng.choices("bdklmnst", k=2)) for _ in range(3000)]

    def prose(n):
        return [rng.choice(common) if rng.random() < 0.5 else rng.choice(rare) for _ in range(n)]
    items = [(i, " ".join(prose(rng.randrange(15, 50))) + ". " + " ".join(prose(6)) + ".") for i in range(30)]
    docs, leaks = [], set()
    for i in range(150):
        words = prose(rng.randrange(0, 250))
        if i % 5 == 0:
            item, text = items[i % 30]
            own = text.split()
            if i % 2:  # a paraphrase: every eighth word replaced, the answer kept
                own = [w if j >= len(own) - 6 or j % 8 else rng.choice(rare) for j, w in enumerate(own)]
            at = rng.randrange(len(words) + 1)
            words[at:at] = [w.upper() if i % 3 else w for w in own]
            leaks.add((i, item))
        docs.append((i, " ".join(words) if words else None, 1.0))
    return items, docs, leaks


def test_planted_leaks(spark):
    items, rows, leaks = corpus()
    rows += [(500, "", 0.0), (501, items[3][1], 0.0), (501, items[3][1], 0.0), (None, items[4][1], 0.0), (502, "the of and " * 3000, 0.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, cosine double").repartition(4)
    bench = spark.createDataFrame(items + [(99, None), (98, "")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in d.find_leaks(docs, bench).collect()}
    assert got == leaks | {(501, 3), (None, 4)}
    kept = d.remove_leaks(docs, bench)
    bad = {i for i, _ in got}
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, *_ in rows if i not in bad)


def test_blocks_of_items_find_the_same(spark, monkeypatch):
    items, rows, leaks = corpus()
    monkeypatch.setattr(d, "BLOCK_ITEMS", 12)
    docs = spark.createDataFrame(rows, "doc_id long, text string, cosine double")
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in d.find_leaks(docs, bench).collect()} == leaks


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "some text of a document")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "some text of a document")], "item_id long, text string")
    assert d.find_leaks(docs.limit(0), bench).count() == 0
    assert d.find_leaks(docs, bench.limit(0)).count() == 0
    assert d.remove_leaks(docs, bench.limit(0)).count() == 1


def test_an_item_in_a_third_of_all_rows_is_found_in_each(spark):
    items, rows, leaks = corpus()
    rng, words = random.Random(5), sorted({w for _, text, _ in rows for w in (text or "").lower().split()} - {""})
    short = min((i for i, _ in items), key=lambda i: len(items[i][1].split()))
    more = []
    for i in range(1000, 1150):
        text = rng.choices(words, k=120)
        if i % 2:
            at = rng.randrange(len(text) + 1)
            text[at:at] = items[short][1].split()
            more.append((i, short))
        rows.append((i, " ".join(text), 0.0))
    docs = spark.createDataFrame(rows, "doc_id long, text string, cosine double")
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in d.find_leaks(docs, bench).collect()} == leaks | set(more)


def test_weights_do_not_follow_leaks():
    items = d.read_items([(1, "alpha beta gamma delta epsilon zeta")])
    table = d.WordTable([b"alpha beta gamma other", b"gamma other", b"alpha", b"beta"], lower=True, member=d._WORD)
    own = d._own_words(items.lookup(table.hash), table, items.pairs())
    assert (own >= 0).tolist() == [False] * 4 + [True, False] + [True, True]
    weights = d.term_weights(items, np.array([900, 0, 0, 0, 0, 0]), 1000)
    assert weights.min() >= d.FLOOR * np.log(1001 / 1) ** 2 * 5 / 6


def test_space_holds_every_item_as_corpus_rows_multiply(spark):
    items, _, _ = corpus()
    read = d.read_items(items)
    rows, owner = read.passages()
    idf = np.random.default_rng(3).uniform(1, 9, len(read.terms))
    queries = d._dense(rows, idf)
    lengths = d._lengths(rows, idf)
    # Many different passages of the words of half of the items, a hundred times; the other items have none.
    rng = np.random.default_rng(4)
    words = np.unique(np.concatenate(read.words[:15]))
    like = [rng.choice(words, d.PASSAGE) for _ in range(400)]
    leaks = [(w.tobytes(), float(n), True) for w, n in zip(like, d._lengths(like, idf))] * 100
    kept = spark.createDataFrame(leaks, "inside binary, length double, like boolean").repartition(4)
    basis = d.latent_basis(kept, read, idf)
    assert np.allclose(basis.T @ basis, np.eye(basis.shape[1]), atol=1e-8)
    assert np.allclose(np.linalg.norm(basis.T @ queries, axis=0), 1)
    # Brute-force cosines of all passages with all items, and those in the space.
    mixed = [np.concatenate((w[:10], rows[(q + 7) % len(rows)][:10])) for q, w in enumerate(rows)]
    passages = d._dense(mixed, idf)
    assert np.allclose((basis.T @ passages).T @ (basis.T @ queries), passages.T @ queries)
    # The corpus rows add directions beyond the items' span.
    assert basis.shape[1] > d._span(queries).shape[1]


def test_short_items_are_found_in_long_texts(spark):
    rng = random.Random(6)
    words = ["".join(rng.choices("bcdfglmnprst", k=4)) for _ in range(3000)]
    common = "the of and to in is that for".split()
    items, rows = [], []
    for n in range(1, 15):
        for kind in (words, common + words[:20]):  # rare words, and a question of common ones
            items.append((len(items), " ".join(rng.sample(kind, n)) if n > 1 else f"single{len(items)}"))
    for i, text in items:
        prose = [rng.choice(common) if rng.random() < 0.5 else rng.choice(words[:-1]) for _ in range(400)]
        at = rng.randrange(401)
        rows.append((i, " ".join(prose[:at] + text.split() + prose[at:])))
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in d.find_leaks(docs, bench).collect()}
    assert got >= {(i, i) for i, _ in items}


def test_an_item_nearly_fills_half_of_its_passages():
    assert [d.passage_words(n) for n in (1, 2, 3, 6, 7, 14, 15, 500)] == [2, 4, 4, 8, 8, 16, 32, 32]


def test_a_task_that_runs_again_emits_the_same_keys(spark):
    rows = [(np.array([i % 5, 5], dtype=np.int32).tobytes(), 1.5) for i in range(64)]
    like = spark.createDataFrame(rows, "inside binary, length double").repartition(8)
    sums = d._partial_sums(like, np.ones(6), np.eye(6, 2))
    keys = [sorted((r.block, r.share) for r in sums.select("block", "share").collect()) for _ in range(2)]
    assert keys[0] == keys[1] == [(0, p) for p in range(8)]


def topics():
    """Items, rows and leaks: paraphrases that put, for ten words of an item, those that the corpus uses in their place."""
    rng = random.Random(8)
    names = iter(dict.fromkeys("".join(rng.choices("bcdfghklmnprst", k=6)) for _ in range(4000)))
    pairs = [[(next(names), next(names)) for _ in range(10)] for _ in range(12)]
    frame, others = [next(names) for _ in range(60)], list(names)

    def told(topic, way):
        """An item's words: ten of the topic, either word of each pair, among fifteen that stand anywhere."""
        rest = rng.sample(frame, 15)
        return [w for p, k, x in zip(pairs[topic], way, rest) for w in (x, p[k])] + rest[10:]
    items, rows, leaks = [], [], set()

    def text(words):
        return f"{' '.join(words[:20])}. {' '.join(words[20:])}."
    told_items = []
    for topic in range(12):
        for way in ([0, 1] * 5, [1, 0] * 5):
            told_items.append(told(topic, way))
            items.append((len(items), text(told_items[-1])))
    swap = {a: b for ps in pairs for p in ps for a, b in (p, p[::-1])}
    for i in range(900):
        words = [rng.choice(p) for p in rng.choice(pairs) ] + rng.choices(frame, k=22)
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
    for i, words in enumerate(told_items):
        rows.append((1000 + i, " ".join([text([swap.get(w, w) for w in words]), *rng.sample(others, 60)])))
        leaks.add((1000 + i, i))
    return items, rows, leaks


def test_images_of_items_find_paraphrases(spark, monkeypatch):
    items, rows, leaks = topics()
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in d.find_leaks(docs, bench).collect()}
    monkeypatch.setattr(d, "corpus_product", lambda passages, idf, basis: np.zeros((basis.shape[1], basis.shape[1])))
    plain = {(r.doc_id, r.item_id) for r in d.find_leaks(docs, bench).collect()}
    assert got <= leaks and len(got) >= 0.9 * len(leaks)
    assert not plain  # no shared word but common ones


def test_nearest_cosine_against_a_grid():
    rng = np.random.default_rng(9)
    for _ in range(50):
        x, q, u = (v / np.linalg.norm(v) for v in rng.normal(size=(3, 4)))
        u = u if q @ u > 0 else -u
        way = np.linspace(0, 1, 5001)[:, None]
        grid = (1 - way) * q + way * u
        want = (grid @ x / np.linalg.norm(grid, axis=1)).max()
        assert abs(d.nearest_cosine(*(np.array([v]) for v in (x @ q, x @ u, q @ u)))[0] - want) < 1e-5


def scattered(topics=40):
    """As topics(), but the words put for an item's stand in other items that have one of each of ten topics."""
    rng = random.Random(8)
    names = iter(dict.fromkeys("".join(rng.choices("bcdfghklmnprst", k=6)) for _ in range(20 * topics + 4000)))
    pairs = [[(next(names), next(names)) for _ in range(10)] for _ in range(topics)]
    frame, others = [next(names) for _ in range(60)], list(names)

    def told(words):
        rest = rng.sample(frame, 15)
        return [w for both in zip(rest, words) for w in both] + rest[10:]

    def text(words):
        return f"{' '.join(words[:20])}. {' '.join(words[20:])}."
    own = [told([a for a, _ in p]) for p in pairs]
    loose = [b for p in pairs for _, b in p]
    items = list(enumerate(map(text, own + [told(rng.sample(loose[i::topics], 10)) for i in range(topics)])))
    rows = []
    for i in range(60 * topics):
        words = [rng.choice(p) for p in rng.choice(pairs)] + rng.choices(frame, k=22)
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
    for i, words in enumerate(own):
        swap = dict(pairs[i])
        rows.append((10000 + i, " ".join([text([swap.get(w, w) for w in words]), *rng.sample(others, 60)])))
    return items, rows, {(10000 + i, i) for i in range(topics)}


def test_singular_directions_decide_what_is_found(spark, monkeypatch):
    items, rows, leaks = scattered()
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in d.find_leaks(docs, bench).collect()}
    assert got <= leaks and len(got) >= 0.9 * len(leaks)
    # The items' span alone, as if nothing had been learned from the corpus.
    monkeypatch.setattr(d, "latent_basis", lambda passages, items, idf: d._span(d._dense(items.passages()[0], idf)))
    assert not d.find_leaks(docs, bench).count()


def crowded():
    """As scattered(), among other items whose words the corpus has together more often, more than the leading directions hold."""
    items, rows, leaks = scattered()
    rng = random.Random(12)
    names = iter(dict.fromkeys("".join(rng.choices("bcdfghklmnprst", k=7)) for _ in range(2000)))
    frame = [next(names) for _ in range(60)]
    for i in range(d.RANK + 32):
        topic = [next(names) for _ in range(10)]
        items.append((1000 + i, " ".join(topic + rng.sample(frame, 10)) + ". " + " ".join(rng.sample(frame, 5)) + "."))
        for j in range(60):
            words = topic + rng.choices(frame, k=22)
            rng.shuffle(words)
            rows.append((20000 + 60 * i + j, " ".join(words)))
    return items, rows, leaks


def test_directions_of_each_item_are_found_among_heavier_ones(spark):
    items, rows, leaks = crowded()
    assert len(items) <= d.BLOCK_ITEMS
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in d.find_leaks(docs, bench).collect()}
    assert got <= leaks and len(got) >= 0.9 * len(leaks)


def test_many_passages_share_the_seeds(spark, monkeypatch):
    items, _, _ = corpus()
    read = d.read_items(items)
    rows, _ = read.passages()
    monkeypatch.setattr(d, "SEEDS", 20)
    monkeypatch.setattr(d, "RANK", 20)
    assert len(rows) > 20 and d.directions_for(read) == 20 + d.EXTRA
    idf = np.ones(len(read.terms))
    kept = spark.createDataFrame([(w.tobytes(), float(n)) for w, n in zip(rows, d._lengths(rows, idf))], "inside binary, length double")
    basis = d.latent_basis(kept, read, idf)
    assert np.allclose(basis.T @ basis, np.eye(basis.shape[1]), atol=1e-8)
    assert np.allclose(np.linalg.norm(basis.T @ d._dense(rows, idf), axis=0), 1)


def test_leading_directions_are_those_of_an_exact_svd(spark):
    rng = np.random.default_rng(10)
    terms, topics = 60, 6
    rows = [rng.choice(10, d.PASSAGE).astype(np.int32) + 10 * (i % topics) for i in range(600)]  # topics of ten terms
    idf = rng.uniform(1, 9, terms)
    kept = spark.createDataFrame([(w.tobytes(), float(n)) for w, n in zip(rows, d._lengths(rows, idf))], "inside binary, length double")
    kept = kept.repartition(4)
    exact = np.linalg.svd(d._dense(rows, idf).T, full_matrices=False)[2][:topics].T
    got = d.singular_directions(kept, idf, rank=2 * topics)
    assert np.linalg.norm(got.T @ exact, axis=0).min() > 0.999
    whole = d._dense(rows, idf)
    assert np.allclose(d.corpus_product(kept, idf, got), got.T @ whole @ whole.T @ got, rtol=1e-4, atol=1e-3)
