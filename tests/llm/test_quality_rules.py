"""Rule measurements against plain loops, policies and ablations."""

import collections
import random
import re

from normlens.llm import quality_rules as rules


def slow(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    times = collections.Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    repeated = {j for i in range(len(words) - 7) if times[tuple(words[i:i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines),
            sum(x in lines[:i] for i, x in enumerate(lines)), len(repeated)]


def texts():
    rng = random.Random(0)
    parts = ["alpha", "be#ta", "ß", "漢字", "<b>", "x|y", "\n", "\n\n", " \x0b ", "a b c d e f g h i", "🙂", "line one\nline one\n"]
    return ["".join(rng.choice(parts) + rng.choice([" ", "\n", ""]) for _ in range(rng.randrange(60))) for _ in range(300)] + [
        "", None, " \n ", "w " * 5000, "\n".join(["same words on a line"] * 40)]


def test_measurements():
    made = texts()
    got = [c.tolist() for c in rules.measure([(t or "").encode() for t in made])]
    assert [list(row) for row in zip(*got)] == [slow(t) for t in made]


def test_ledger_policies_and_ablations(spark):
    made = texts()
    docs = spark.createDataFrame([(i if i % 9 else None, t, 1) for i, t in enumerate(made)], "doc_id long, text string, failed int")
    stored = rules.ledger(docs).cache()
    rows = stored.collect()
    assert len(rows) == len(made)
    for r in rows:
        assert (r.failed & rules.BIT["few_words"] != 0) == (r.n_words < 20)
        assert (r.failed & rules.BIT["repeated_windows"] != 0) == (100 * r.n_repeat_words > 30 * r.n_words)
    for policy, names in rules.POLICIES.items():
        mask = sum(rules.BIT[n] for n in names)
        assert stored.where(rules.fails(policy)).count() == sum(r.failed & mask != 0 for r in rows)
        want = [(n, sum(r.failed & rules.BIT[n] != 0 for r in rows), sum(r.failed & mask == rules.BIT[n] for r in rows)) for n in names]
        assert [tuple(r) for r in rules.ablations(stored, policy).collect()] == want
    assert set(rules.POLICIES["v1"]) <= set(rules.POLICIES["v2"])
    assert rules.ledger(docs.limit(0)).count() == 0
    assert [r.n_alone for r in rules.ablations(stored.limit(0), "v1").collect()] == [0, 0]
