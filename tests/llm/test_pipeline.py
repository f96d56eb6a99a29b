"""The pipeline on a planted table, stage by stage against brute force."""

import random
from collections import Counter

import pytest
import public_tokenizers
import tiktoken
from xxhash import xxh64_intdigest

import corpus_pipeline
from test_decontaminate import crowded, scattered, topics
from normlens.llm import decontaminate
from normlens.llm.byte_bpe import read_ranks

ITEMS = [(1, "which planet of the outer system has the widest visible rings when seen through a small telescope saturn of course"),
         (2, "name the river that crosses the old capital and reaches the northern sea after nine hundred miles the long river elbe")]
#: Columns that operators use inside; a table may bring its own.
CLASHING = ("_k1", "_k2", "spans", "fp", "kept", "n_words", "severity")


def words_of(rng, n):
    return " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(3, 9))) for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """doc_id, text and what was planted."""
    rng, root = random.Random(5), str(tmp_path_factory.mktemp("pipeline"))
    base = [words_of(rng, rng.randint(40, 90)) for _ in range(120)]
    insults = ["vile filthy scum", "worthless filthy vermin scum", "vile vermin filthy"]
    rows = [(i, t) for i, t in enumerate(base)]
    toxic = [(1000 + i, f"{words_of(rng, 30)} {rng.choice(insults)} {words_of(rng, 10)} {rng.choice(insults)}") for i in range(60)]
    passage = words_of(rng, 60)
    shared = [(2000 + i, f"{words_of(rng, 40)} {passage} {words_of(rng, 40)}") for i in range(4)]
    copies = [(3000, base[3]), (3001, base[3]), (3002, base[4].upper())]
    leaks = [(4000 + i, f"{words_of(rng, 30)} {text} {words_of(rng, 30)}") for i, (_, text) in enumerate(ITEMS)]
    odd = [(5000, None), (5001, ""), (None, words_of(rng, 50)), (5003, words_of(rng, 30_000)), (5004, "é 日本語 " + words_of(rng, 40))]
    table = rows + toxic + shared + copies + leaks + odd
    clash = ", ".join(f"{c} int" for c in CLASHING)
    spark.createDataFrame([(i, t, "en", "web", len(t or ""), *[7] * len(CLASHING)) for i, t in table],
                          f"doc_id long, text string, lang string, source string, n_chars long, {clash}"
                          ).repartition(4).write.parquet(f"{root}/documents.parquet")
    marks = [(i, 1, 0) for i, _ in rows[:90]] + [(i, 0, 1) for i, _ in toxic[:45]]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return root, {"toxic": {i for i, _ in toxic}, "shared": {i for i, _ in shared}, "leaks": {i for i, _ in leaks}, "passage": passage}


@pytest.fixture(scope="module")
def stages(spark, folder):
    """The rows before and after each stage."""
    root, _ = folder
    docs = spark.read.parquet(f"{root}/documents.parquet")
    columns, out = docs.columns, [docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, root).write.parquet(f"{root}/after-{name}")
        docs = spark.read.parquet(f"{root}/after-{name}")
        assert docs.columns[:len(columns)] == columns, name
        out.append(docs.collect())
    assert all(r[c] == 7 for rows in out for r in rows for c in CLASHING)
    return out


def key(r):
    return r.doc_id, r.text


def test_toxic_documents_go(stages, folder):
    planted = folder[1]["toxic"]
    before, after = {key(r) for r in stages[0]}, {key(r) for r in stages[1]}
    assert after <= before
    assert not planted & {i for i, _ in after}
    assert {i for i, _ in before - after} == planted


def fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").split()
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def test_one_document_of_each_group_stays(stages):
    rows = [(r.doc_id, r.text, fingerprint(r.text)) for r in stages[1]]
    group = list(range(len(rows)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            if bin(rows[i][2] ^ rows[j][2]).count("1") <= 3:
                group[root(i)] = root(j)
    least = {}
    for i, (doc_id, _, _) in enumerate(rows):
        least.setdefault(root(i), []).append((doc_id is None, doc_id or 0))
    want = Counter(min(v) for v in least.values())
    assert Counter((r.doc_id is None, r.doc_id or 0) for r in stages[2]) == want
    assert not {3000, 3001, 3002} & {r.doc_id for r in stages[2]}


def test_repeated_windows_are_cut(stages, folder):
    words = {r.doc_id: (r.text or "").split() for r in stages[2]}
    windows = Counter(tuple(w[i:i + 35]) for w in words.values() for i in range(len(w) - 34))
    cut = set()
    for r in stages[3]:
        w = words[r.doc_id]
        gone = {j for i in range(len(w) - 34) if windows[tuple(w[i:i + 35])] > 1 for j in range(i, i + 35)}
        assert (r.text or "").split() == [x for i, x in enumerate(w) if i not in gone]
        assert r.n_chars == len(r.text or "")
        cut |= {r.doc_id} if gone else set()
    assert cut == folder[1]["shared"] and len(stages[3]) == len(stages[2])


def test_leaks_go(stages, folder):
    before, after = {r.doc_id for r in stages[3]}, {r.doc_id for r in stages[4]}
    assert before - after == folder[1]["leaks"]


def test_ids_are_those_of_the_public_encoder(stages):
    plain = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, special_tokens={},
                              mergeable_ranks=read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")))
    assert len(stages[5]) == len(stages[4])
    for r in stages[5]:
        assert r.ids == plain.encode_ordinary(r.text or "")


def test_empty_tables(spark, folder, tmp_path):
    root = str(tmp_path)
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder[0]}/{name}.parquet").limit(0).write.parquet(f"{root}/{name}.parquet")
    assert corpus_pipeline.run(spark, root).count() == 0


def test_run_gives_the_last_stage(spark, folder, stages):
    got = Counter((r.doc_id, tuple(r.ids)) for r in corpus_pipeline.run(spark, folder[0]).collect())
    assert got == Counter((r.doc_id, tuple(r.ids)) for r in stages[5])


def test_paraphrases_by_the_words_of_the_corpus_go(spark, tmp_path):
    items, rows, leaks = topics()
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = {r.doc_id for r in dict(corpus_pipeline.STAGES)["decontamination"](spark, docs, str(tmp_path)).collect()}
    gone = {i for i, _ in rows} - kept
    assert gone <= {i for i, _ in leaks} and len(gone) >= 0.9 * len(leaks)


def test_paraphrases_by_words_of_many_items_go(spark, tmp_path):
    items, rows, leaks = scattered()
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = {r.doc_id for r in dict(corpus_pipeline.STAGES)["decontamination"](spark, docs, str(tmp_path)).collect()}
    gone = {i for i, _ in rows} - kept
    assert gone <= {i for i, _ in leaks} and len(gone) >= 0.9 * len(leaks)


def test_paraphrases_go_among_heavier_topics(spark, tmp_path, monkeypatch):
    items, rows, leaks = crowded()
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    stage = dict(corpus_pipeline.STAGES)["decontamination"]
    gone = {i for i, _ in rows} - {r.doc_id for r in stage(spark, docs, str(tmp_path)).collect()}
    assert gone <= {i for i, _ in leaks} and len(gone) >= 0.9 * len(leaks)
    # The items' span alone leaves them all.
    monkeypatch.setattr(decontaminate, "latent_basis", lambda passages, items, idf: decontaminate._span(decontaminate._dense(items.passages()[0], idf)))
    assert stage(spark, docs, str(tmp_path)).count() == len(rows)
