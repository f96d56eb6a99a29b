"""Packed token files against the tokenizers library on whole texts."""

import random
import zlib
from functools import partial

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from normlens.llm import catalog
from normlens.llm.byte_bpe import REMEMBERED_CHARS
from normlens.llm.token_file import Image, WordEncoder, bits_for, image, open_image, pack, read, save, unpack, word_encoder, write

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("bits", [1, 3, 8, 11, 16, 17, 24, 31, 32])
def test_packing_round_trip(bits):
    rng = np.random.default_rng(bits)
    for n in (0, 1, 7, 8, 9, 1000):
        ids = rng.integers(0, 1 << bits, n, dtype=np.uint64)
        packed = pack(ids, bits)
        assert len(packed) == -(-n // 8) * bits
        assert (unpack(packed, bits, n) == ids).all()


def test_fewest_bits():
    assert [bits_for(v) for v in (1, 2, 3, 256, 257, 49408, 65536, 65537)] == [1, 1, 2, 8, 9, 16, 16, 17]


def test_image_random_access(tmp_path):
    rng = np.random.default_rng(0)
    docs = [rng.integers(0, 5000, n, dtype=np.uint32) for n in (3, 0, 100, 1, 5000, 17)]
    data = image([5, None, 7, 7, 9, 10], [d.astype("<u4").tobytes() for d in docs], 13, block=64)
    save(data, str(tmp_path / "ids"))
    for made in (Image(data), open_image(str(tmp_path / "ids"))):
        assert made.doc_ids.tolist() == [5, -(1 << 63), 7, 7, 9, 10]
        for i in (4, 0, 5, 2, 1, 3):
            assert (made.document(i) == docs[i]).all()
        assert (made.ids(100, 300) == np.concatenate(docs)[100:300]).all()
    with pytest.raises(ValueError):
        image([1], [np.uint32(8).tobytes()], 3)
    with pytest.raises(ValueError):
        Image(b"nonsense" * 10)


def odd_texts():
    rng = random.Random(4)
    parts = ["Hello", "DON'T", "x's", "<|endoftext|>", "<|startoftext|>a", "<|", "É", "é", "Σ", "ς", "ΣΑΣ", "12", "...", "a.b", "!?",
             "ﬁ", "İ", "漢字", "🙂", " ", "\x1c", "́", "\x00", "#", "İ's", "ſ"]
    seps = [" ", "\n", "\t ", "", "\r\n", "\x0b"]
    texts = ["".join(rng.choice(parts) + rng.choice(seps) for _ in range(rng.randrange(0, 12))) for _ in range(300)]
    return texts + [None, "", "   ", "word " * 3000, "z" * 5000]


def test_written_and_read(spark, tmp_path):
    rows = [((i * 37) % 1000 if i != 5 else None, t) for i, t in enumerate(odd_texts())] + [(12, "again"), (12, "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    write(docs, partial(word_encoder, PATH), str(tmp_path / "out"), 2, image_ids=500)
    got = sorted(((r.start, r.doc_id, np.frombuffer(r.ids, "<u4").tolist()) for r in read(spark, str(tmp_path / "out")).collect()))
    library = Tokenizer.from_file(PATH)
    want = {}
    for d, t in rows:
        want.setdefault(d, []).append([*library.encode(t or "", add_special_tokens=False).ids, 2])
    assert [d if d is not None else -1 for _, d, _ in got] == sorted(d if d is not None else -1 for d, _ in rows)
    start = 0
    for s, d, ids in got:
        assert s == start and ids in want[d]
        want[d].remove(ids)
        start += len(ids)


def test_no_rows(spark, tmp_path):
    write(spark.createDataFrame([], "doc_id long, text string"), partial(word_encoder, PATH), str(tmp_path / "none"), 2)
    assert read(spark, str(tmp_path / "none")).count() == 0


def test_query_over_whole_table(spark):
    folder = "/root/testdata/sf0.001"
    library, start, want = Tokenizer.from_file(PATH), 0, {}
    for r in sorted(spark.read.parquet(f"{folder}/documents.parquet").collect(), key=lambda r: r.doc_id):
        ids = [*library.encode(r.text or "", add_special_tokens=False).ids, 2]
        want[r.doc_id] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in catalog.QUERIES["op2_token_file"](spark, folder).collect()}
    assert got == want


def test_words_of_letters_as_the_library_has_them(monkeypatch):
    rng, library = random.Random(6), Tokenizer.from_file(PATH)
    letters = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, [*range(0xE0, 0xF7), *range(0xF8, 0x100)]))
    words = ["".join(rng.choices(letters, k=rng.randrange(1, 14))) for _ in range(3000)] + ["z" * 300]
    texts = [" ".join(w + rng.choice(["", ".", ",", "***", "'s", "\u0301", "\u00f7"]) for w in rng.choices(words, k=40)) for _ in range(100)]
    texts += ["\u0301 \u00e9\u0301. \u00c9a, a\u0301.", ", . a. ,", " ".join(words)]
    encoder, learned = WordEncoder(PATH), []
    encoder.remembered = 500  # both tables turn over
    monkeypatch.setattr(encoder, "_words", lambda some, make=encoder._words: learned.extend(some) or make(some))
    for lo in range(0, len(texts), 20):
        got = encoder.encode([t.encode() for t in texts[lo:lo + 20]])
        assert [np.frombuffer(x, "<u4").tolist() for x in got] == [library.encode(t, add_special_tokens=False).ids for t in texts[lo:lo + 20]]
    assert learned and not set(learned) & set(words)  # none of them needs offsets
    assert max(map(len, [*encoder.new, *encoder.old])) <= REMEMBERED_CHARS


def test_marks_at_letters_are_pieces_of_their_own(monkeypatch):
    rng, library = random.Random(7), Tokenizer.from_file(PATH)
    parts = ["ab", "Zß", "é", "É", "÷", "×", "c3", "7", "'", "''", "'s", "'ll", "***", "&", "=", "≠", "̸", "<", "|", "\"", "(", ".", ",",
             "\x00", "\x1c", "\x7f", " ", "　", "я", "Σ", "漢", "s", "t", "ve", "`", "_"]
    texts = ["".join(rng.choice(parts) + rng.choice(["", "", "", " ", "\n"]) for _ in range(rng.randrange(0, 30))) for _ in range(4000)]
    encoder = WordEncoder(PATH)
    got = encoder.encode([t.encode() for t in texts])
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    # A word before marks is looked up as the word alone: the library sees it once, and only the marks need offsets.
    learned, letters = [], []
    encoder = WordEncoder(PATH)
    monkeypatch.setattr(encoder, "_words", lambda some, make=encoder._words: learned.extend(some) or make(some))
    monkeypatch.setattr(encoder, "_letters", lambda some, make=encoder._letters: letters.extend(some) or make(some))
    encoder.encode(['Ab*** ab&&& "ab" (ab), ab!! ab\'s maß'.encode()])
    assert sorted(letters) == ["ab", "maß"]
    assert not any(c.isalpha() for w in learned for c in w if w != "'s")
