"""SimHash fingerprints, BK-trees, links and components against brute force."""

import random

import pytest
import xxhash

from normlens.llm import catalog
from normlens.llm.components import components
from normlens.llm.simhash import BKTree, fingerprint_links, keep_one, near_duplicates


def slow_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    values = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(v >> k & 1 for v in values) > len(values))


def slow_groups(values, radius):
    head = {v: v for v in values}

    def find(x):
        while head[x] != x:
            x = head[x]
        return x
    values = sorted(set(values))
    for i, a in enumerate(values):
        for b in values[:i]:
            if (a ^ b).bit_count() <= radius:
                head[find(a)] = find(b)
    return {v: find(v) for v in values}


def same_grouping(a, b):
    keys = sorted(a)
    first, second = {}, {}
    return sorted(b) == keys and all(first.setdefault(a[k], k) == second.setdefault(b[k], k) for k in keys)


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_tree_finds_all_within_the_radius():
    rng = random.Random(1)
    values = [rng.getrandbits(64) for _ in range(50)]
    values += [v ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64) for v in values for _ in range(5)]
    tree = BKTree()
    for v in values + values[:5]:
        tree.insert(v)
    for q in values[::7] + [0]:
        assert sorted(tree.within(q, 3)) == sorted({v for v in values if (v ^ q).bit_count() <= 3})


@pytest.mark.parametrize("shard_rows", [1500, 7])
def test_links_match_all_pairs(spark, shard_rows):
    rng = random.Random(2)
    values = {rng.getrandbits(64) for _ in range(120)} | {0, (1 << 64) - 1}
    for v in list(values)[:30]:
        for _ in range(8):
            v ^= sum({1 << rng.randrange(64) for _ in range(rng.choice([2, 3, 4]))})
            values.add(v)
    dense = rng.getrandbits(64)
    values |= {dense ^ (1 << a) ^ (1 << b) for a in range(20) for b in range(a)}
    frame = spark.createDataFrame([(signed(v),) for v in values], "fp long")
    links = fingerprint_links(frame, 3, shard_rows)
    found = {r.v % (1 << 64): r.root % (1 << 64) for r in components(links).collect()}
    assert same_grouping({v: found.get(v, v) for v in values}, slow_groups(values, 3))
    if shard_rows > len(values):
        assert links.count() < 16 * len(values)


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(40)] + [(5, 5), (3000, 2000), (2000, 3000)]
    got = {r.v: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = {i: 0 for i in range(301)} | {1000 + i: 1000 for i in range(40)} | {2000: 2000, 3000: 2000}
    assert same_grouping(got, want) and set(got.values()) <= set(want)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def texts(rng):
    base = [" ".join(rng.choice("abcdefghij") * 3 + str(rng.randrange(50)) for _ in range(rng.randrange(5, 90))) for _ in range(25)]
    near = [t.replace(" ", "\n", 1) + rng.choice(["", " x", " Y z"]) for t in base]
    return base + near + [base[0], base[0].upper(), "", None, " \t\n", "One", "one two", "é ü ñ ß", "a b c", "x " * 4000]


def test_documents_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, t, "clash", i) for i, t in enumerate(texts(rng))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string, root long").repartition(4)
    want = {i: slow_fingerprint(t) for i, t, *_ in rows}
    groups = slow_groups(list(want.values()), 3)
    least = {}
    for i in sorted(want, reverse=True):
        least[groups[want[i]]] = i
    got = {r.doc_id: (r.fp % (1 << 64), r.component_id, r.kept) for r in near_duplicates(docs).collect()}
    assert got == {i: (want[i], least[groups[want[i]]], least[groups[want[i]]] == i) for i in want}
    kept = keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(least.values())


def test_repeated_rows_null_ids_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (None, "a b c d"), (None, "q"), (None, "q"), (2, "q")],
                                 "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.component_id) for r in near_duplicates(docs).collect()) == [
        (0, 1), (0, 2), (0, 2), (1, 1), (1, 1), (2, 2)]
    assert sorted(r.doc_id for r in keep_one(docs).collect()) == [1, 2]
    assert near_duplicates(docs.limit(0)).count() == 0 and keep_one(docs.limit(0)).count() == 0


def test_query_over_whole_table(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    want = {r.doc_id: slow_fingerprint(r.text) for r in docs}
    groups = slow_groups(list(want.values()), 3)
    least = {}
    for i in sorted(want, reverse=True):
        least[groups[want[i]]] = i
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in catalog.QUERIES["op7_simhash"](spark, folder).collect()}
    assert got == {i: (f"{want[i]:016x}", least[groups[want[i]]]) for i in want}
