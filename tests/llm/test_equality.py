"""Equal hashes never stand for equal bytes: patterned texts that meet under powers of any base modulo 2**64, and hashes made weak on purpose."""

import random

import numpy as np
import pytest

from tessitura.llm import bpe, near_dup, suffix_dedup, words
from tests.llm.test_operators import removed


def thue_morse(n):
    s = [0]
    while len(s) < n:
        s += [1 - x for x in s]
    return s[:n]


@pytest.fixture(scope="module")
def vocabulary():
    from tessitura.llm.queries import vocabulary_path

    return vocabulary_path()


def patterned():
    out = []
    for n in (1024, 2048, 4096):
        s = thue_morse(n)
        out += ["".join("ab"[x] for x in s), "".join("ba"[x] for x in s)]
    return out


def test_bpe_patterned_words(vocabulary):
    from tokenizers import Tokenizer

    t, v = Tokenizer.from_file(vocabulary), bpe.Vocabulary.from_file(vocabulary)
    texts = [*patterned(), " ".join(patterned())]
    assert [g.tolist() for g in v.encode_many(texts)] == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_bpe_when_all_hashes_meet(vocabulary, monkeypatch):
    from tokenizers import Tokenizer

    t, v = Tokenizer.from_file(vocabulary), bpe.Vocabulary.from_file(vocabulary)
    monkeypatch.setattr(bpe, "sum_hashes", lambda cps, sizes: np.zeros(len(sizes), np.uint64))
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    text = "the same words and other words, the same once more: the end the end"
    for _ in range(3):
        assert next(iter(v.encode_many([text]))).tolist() == t.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("longest", [1, 8, 256])
def test_bpe_rounds_of_long_words(vocabulary, monkeypatch, longest):
    from tokenizers import Tokenizer

    monkeypatch.setattr(bpe, "LONG", longest)
    t, v, r = Tokenizer.from_file(vocabulary), bpe.Vocabulary.from_file(vocabulary), random.Random(8)
    texts = ["".join(r.choice("etaoinshrdlu") for _ in range(r.randrange(1, 700))) for _ in range(60)] + ["a" * 1001, "ab" * 700 + "a", "".join(r.choice(["the", "ing", "er", "aa", "-", "=="]) for _ in range(900))]
    assert [g.tolist() for g in v.encode_many(texts)] == [t.encode(x, add_special_tokens=False).ids for x in texts]


@pytest.mark.parametrize("change", [{"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"added_tokens": [{"id": 0, "content": "x", "lstrip": True}]}, {"model": {"ignore_merges": True}}])
def test_bpe_refuses_other_files(vocabulary, tmp_path, change):
    import json

    with open(vocabulary, encoding="utf-8") as f:
        raw = json.load(f)
    raw = raw | change | {"model": raw["model"] | change.get("model", {})}
    path = tmp_path / "v.json"
    path.write_text(json.dumps(raw))
    with pytest.raises(ValueError, match="plain byte-level"):
        bpe.Vocabulary.from_file(str(path))


def test_word_hashes_of_patterned_words():
    h, n = words.hash_words(patterned())
    assert len(set(h.tolist())) == len(h) == 6 and n.tolist() == [1] * 6


def marked(flip):
    """128 blocks: 32 bytes that all share, 31 bytes of their own, one of two marks."""
    own = [f"{k:03d}".ljust(31, "u") for k in range(128)]
    return "".join("g" * 16 + "h" * 16 + o + "xy"[m ^ flip] for o, m in zip(own, thue_morse(128)))


def test_suffix_dedup_patterned_texts(spark):
    rows = [(1, marked(0)), (2, marked(1)), (3, patterned()[2]), (4, patterned()[3])]
    want = removed([(i, t.encode()) for i, t in rows], 100)
    assert want[2][0][1] == 0
    for r in suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        assert (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) == want[r.doc_id][0]


def test_runs_are_told_by_their_bytes():
    data = np.frombuffer(b"abcdabcdabceabcd", np.uint8)
    at, size, zero = np.array([0, 4, 8, 12]), np.full(4, 4), np.zeros(4, np.uint64)
    assert suffix_dedup._first_of(data, at, size, zero, zero).tolist() == [True, False, True, False]
    back, none = np.arange(4)[::-1], np.zeros(4, np.int64)
    assert suffix_dedup._first_of(data, at, size, zero, zero, back, none, none).tolist() == [False, False, True, True]


@pytest.mark.parametrize("hot", [20_000, 2])
def test_suffix_dedup_rows_without_id(spark, hot, monkeypatch):
    """Rows without id, some repeated between others, come after all others; each text loses what stands in those before it."""
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    r = random.Random(4)
    part = ["".join(r.choice("abcdef ") for _ in range(150)) for _ in range(6)]
    a, b, c = part[0] + part[1], part[1] + part[2] + part[3], part[4] + part[5]
    rows = [(None, a), (None, b), (None, a), (None, c), (None, b), (5, part[3]), (7, part[3] + part[4]), (7, part[2]), (7, part[2])]
    got = sorted(((x.doc_id, x.n_bytes, x.n_removed) for x in suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()), key=str)
    assert len(got) == len(rows)
    named = sorted(x for x in got if x[0] is not None)
    assert named == [(5, 150, 0), (7, 150, 0), (7, 150, 150), (7, 300, 150)]
    # Of a and b, whichever comes first keeps the part that they share.
    nameless = sorted(x[1:] for x in got if x[0] is None)
    assert nameless.count((300, 300)) == 1 and nameless.count((450, 450)) >= 1 and sum(n - g for n, g in nameless) == 150 * 3


def test_near_duplicates_keep_patterned_texts_apart(spark):
    texts = [" ".join("ab"[x] * 3 for x in thue_morse(600)), *patterned()[:2]]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    assert sorted(r.class_id for r in near_dup.near_duplicates(rows).collect()) == [0, 1, 2]


def test_near_duplicates_sign_many_short_texts_in_bounded_memory():
    """A batch of very short texts is signed in groups, as every text throws hundreds of darts."""
    texts = [f"five words of text {i}" for i in range(5000)]
    assert max(b - a for a, b in near_dup._groups(texts)) <= 1024
    keys, sketches, sizes = near_dup.sign(texts)
    again = near_dup.sign(texts[4000:4001])
    assert len(keys) == len(sketches) == len(sizes) == 5000 and (keys[4000] == again[0][0]).all() and sketches[4000] == again[1][0]


def test_wide_ids_beside_null(spark, vocabulary):
    """Ids beyond 2**53 stay exact in batches that hold a null id."""
    from tessitura.llm import ctph

    rows = [(2**62 + 1, "some text"), (None, "nameless"), (-(2**63) + 1, "another"), (5, "short")]
    d = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    want = sorted((str(i) for i, _ in rows))
    for done in (ctph.fingerprint_edits(d), bpe.encode_texts(d, vocabulary), suffix_dedup.remove_repeats(d), near_dup.near_duplicates(d)):
        assert sorted(str(r.doc_id) for r in done.collect()) == want
