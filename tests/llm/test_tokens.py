import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from gridloom.llm import packing, token_counts

BYTE = packing.tokenizer_path("byte_bpe_50k.json")
WORD = packing.tokenizer_path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, sequence_id int, rank string"
TEXTS = [
    None, "", "   \n ", "Hello, World! it's 2024  ok", "naïve café é ÉÀ", "x" * 5000, "ends<|endoftext|> here", "Σίσυφος ΟΔΟΣ İstanbul",
    "a\x1cb\x85c", "日本語 テキスト", "emoji 😀😀 end", "don't  can't\t\tstop", "twice", "twice",
]


def rows(texts):
    return [(i, t, None, "s", None, 1, "r") for i, t in enumerate(texts)]


@pytest.mark.parametrize("chunk", [16, 40, 200])
def test_splices_give_the_whole_count(chunk):
    own = Tokenizer.from_file(BYTE)
    encode = lambda s: own.encode(s, add_special_tokens=False)
    rng = random.Random(chunk)
    for _ in range(250):
        words = ["a", "the", "don't", "  ", "\n", "\n\n ", "xyzzy" * 3, "é", "😀", "12345", "...", "<|endoftext|>", "日本", " \t "]
        text = "".join(rng.choice(words) + rng.choice(["", " ", " ", "  "]) for _ in range(rng.randint(0, 120)))
        assert token_counts.count_huge(encode, text, chunk, max(4, chunk // 4)) == len(encode(text).ids)


def test_no_white_space_widens_to_the_end():
    own = Tokenizer.from_file(BYTE)
    encode = lambda s: own.encode(s, add_special_tokens=False)
    text = "ab" * 3000
    assert token_counts.count_huge(encode, text, 100, 10) == len(encode(text).ids)


def test_counts(spark):
    own = Tokenizer.from_file(BYTE)
    texts = [*TEXTS, "some words in a long text, " * 4000]
    got = {r.doc_id: r for r in token_counts.token_counts(spark.createDataFrame(rows(texts), SCHEMA), BYTE).collect()}
    for i, t in enumerate(texts):
        n = len(own.encode(t or "", add_special_tokens=False).ids)
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (n, len((t or "").encode()), n > 1024)
    assert token_counts.token_counts(spark.createDataFrame([], SCHEMA), BYTE).count() == 0


def test_encoder_is_the_library():
    own = Tokenizer.from_file(WORD)
    alphabet = [chr(c) for c in range(1, 0x250)]
    rng = random.Random(5)
    texts = [t or "" for t in TEXTS] + ["".join(rng.choices(alphabet, k=rng.randint(1, 40))) for _ in range(1500)] + [f"a{c}b {c} {c}{c}" for c in alphabet]
    for text, got in zip(texts, packing.encoder(WORD).batch(texts), strict=True):
        assert got.tolist() == own.encode(text, add_special_tokens=False).ids, repr(text)


def test_encoder_forgets_and_clashes(monkeypatch):
    own = Tokenizer.from_file(WORD)
    rng = random.Random(6)
    letters = "abcdéß01.,'"
    texts = ["".join(rng.choices(letters, k=rng.randint(1, 30))) + " " + "x" * rng.randint(1, 40) for _ in range(600)] + ["", " \n"]
    monkeypatch.setattr(packing, "CACHE", 50)
    monkeypatch.setattr(packing, "LONG_CACHE", 5)
    monkeypatch.setattr(packing, "mix", lambda x: x % np.uint64(7))  # many different words of one order
    encoder = packing.Encoder(WORD)
    for _ in range(2):
        for low in range(0, len(texts), 100):
            part = texts[low : low + 100]
            for text, got in zip(part, encoder.batch(part), strict=True):
                assert got.tolist() == own.encode(text, add_special_tokens=False).ids, repr(text)


def test_pack_with_every_length_wide(spark, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK_ROWS", 1)
    texts = ["w " * n for n in range(1, 1500)] * 2
    bins, total = check_packing(spark, texts, 1600)
    assert bins <= 1.02 * total / 1600 + 2


def check_packing(spark, texts, limit):
    own = Tokenizer.from_file(WORD)
    got = packing.pack(spark, spark.createDataFrame(rows(texts), SCHEMA).repartition(3), WORD, limit).collect()
    want = {i: [*own.encode(t or "", add_special_tokens=False).ids, 1] for i, t in enumerate(texts)}
    by_doc, by_bin = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_bin[r.sequence_id].append(r)
    assert set(by_doc) == set(want)
    for i, ids in want.items():
        at = 0
        for k, r in enumerate(sorted(by_doc[i], key=lambda r: r.piece)):
            part = ids[r.start : r.start + r.length]
            assert (r.piece, r.start, r.ids_crc32) == (k, at, zlib.crc32(np.asarray(part, "<u4").tobytes())) and len(part) == r.length
            assert r.length == limit or at + r.length == len(ids)
            at += r.length
        assert at == len(ids)
    for inside in by_bin.values():
        at = 0
        for r in sorted(inside, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= limit
    return len(by_bin), sum(r.length for r in got)


def test_pack(spark):
    rng = random.Random(2)
    texts = TEXTS + [" ".join(rng.choices(["one", "two", "words"], k=rng.randint(0, 90))) for _ in range(300)]
    bins, total = check_packing(spark, texts, 64)
    assert bins <= -(-total // 64) + 3
    assert packing.pack(spark, spark.createDataFrame([], SCHEMA), WORD).count() == 0


def plain_best_fit(lengths, limit):
    left = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, c in enumerate(left) if c >= n]
        if fits:
            left[min(fits, key=lambda i: left[i])] -= n
        else:
            left.append(limit - n)
    return sorted(left)


def test_runs_are_best_fit_decreasing():
    rng = random.Random(3)
    for _ in range(300):
        limit = rng.randint(1, 60)
        lengths = [rng.randint(1, limit) for _ in range(rng.randint(0, 80))]
        histogram = {n: lengths.count(n) for n in set(lengths)}
        runs = packing.best_fit_decreasing(histogram, limit)
        used, seen = defaultdict(int), defaultdict(int)
        for n, first, last, low, each, at in runs:
            assert first == seen[n]
            seen[n] = last
            for r in range(last - first):
                assert used[low + r // each] == at + r % each * n
                used[low + r // each] += n
        assert seen == histogram
        assert sorted(limit - u for u in used.values()) == plain_best_fit(lengths, limit)
