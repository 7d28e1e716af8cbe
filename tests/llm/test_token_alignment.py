import hashlib
import random
from collections import Counter

import pyarrow as pa
import pyarrow.compute as pc
import pytest
import sentencepiece

from gridloom.llm import token_alignment as A
from gridloom.llm.packing import tokenizer_path

A_PATH, B_PATH = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, n_a int, slice string, segment string"
PARTS = ["a", "the", "don't", "I'm", "  ", "\n", "\n\n ", "\r\n", "\t", "xyzzy" * 3, "é", "😀", "12345", "...", "<|endoftext|>", "<s>", "<0x41>", "日本", " \t ", " ", "　", "\x00", "\x85", " ", "(x)", "```", "naïve,", "\\n", "​", "﻿", "_", "'s", "́"]


def texts(seed, n, longest=40, more=()):
    rng = random.Random(seed)
    parts = PARTS + list(more)
    return ["".join(rng.choice(parts) + rng.choice(["", " ", " ", "  "]) for _ in range(rng.randint(0, longest))) for _ in range(n)]


def whole(own, text):
    """Ids of both libraries over the whole text, or none."""
    a, b = own.a.encode(" " + text, add_special_tokens=False).ids, own.b.encode(text)
    same = b"".join(own.a_bytes[i] for i in a) == (" " + text).encode() == b"".join(own.b_bytes[i] for i in b)
    return (a, b) if text and same else ([], [])


def brute(own, docs):
    each, counts = [], Counter()
    for text in docs:
        a, b = whole(own, text or "")
        ends = []
        for ids, table in ((a, own.a_bytes), (b, own.b_bytes)):
            at, out = 0, []
            for i in ids:
                at += len(table[i])
                out.append((at, i))
            ends.append(out)
        cuts = sorted({e for e, _ in ends[0]} & {e for e, _ in ends[1]})
        groups, low = [], 0
        for c in cuts:
            groups.append("|".join(",".join(str(i) for e, i in side if low < e <= c) for side in ends))
            low = c
        links = [(i, j) for e, i in ends[0] for f, j in ends[1] if e == f]
        counts.update(links)
        each.append((len(a), len(b), groups, links))
    top = Counter()
    for (_, j), n in counts.items():
        top[j] = max(top[j], n)
    return [(n_a, n_b, len(g), len(links), sum(counts[p] == top[p[1]] for p in links), sum(counts[p] for p in links), hashlib.sha256(";".join(g).encode()).hexdigest() if n_a else "") for n_a, n_b, g, links in each]


def found(spark, docs, **kw):
    frame = spark.createDataFrame([(i, t, 1, "s", "g") for i, t in enumerate(docs)], SCHEMA)
    rows = A.align_documents(spark, frame.select("doc_id", "text"), A_PATH, B_PATH, ["doc_id"], **kw).collect()
    return {r.doc_id: r for r in rows}, len(rows)


def test_segments_have_the_tokens_of_the_text():
    """The cut is a boundary of both tokenizers whatever stands around it."""
    own = A.tokens(A_PATH, B_PATH)
    assert own.cuts
    plain = ["a b\nc", "one,\ntwo (x) don't", "end\n", " x", "\nx", "ﬁ é 日本 x", "x\u200by z"]
    for text in filter(None, texts(1, 3000) + plain):
        parts = own.segments(" " + text)
        assert "".join(parts) == " " + text and parts == A._CUT.findall(" " + text)
        ids = own.encode(parts)
        assert [i for x, _ in ids for i in x] == own.a.encode(" " + text, add_special_tokens=False).ids, repr(text)
        assert [i for _, y in ids for i in y] == own.b.encode(text), repr(text)


def test_real_texts_have_the_tokens_of_the_text(spark):
    own = A.tokens(A_PATH, B_PATH)
    b = sentencepiece.SentencePieceProcessor(model_file=B_PATH)
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect():
        ids = own.encode(own.segments(" " + r.text))
        assert own.segments(" " + r.text) == A._CUT.findall(" " + r.text)
        assert [i for x, _ in ids for i in x] == own.a.encode(" " + r.text, add_special_tokens=False).ids
        assert [i for _, y in ids for i in y] == b.encode(r.text)


@pytest.mark.parametrize("slice_,frequent", [(A.SLICE, A.FREQUENT), (60, 5), (200, 0)])
def test_equals_brute_force(spark, monkeypatch, slice_, frequent):
    monkeypatch.setattr(A, "SLICE", slice_)
    monkeypatch.setattr(A, "FREQUENT", frequent)
    docs = [None, "", " ", "\n", "▁", "x ▁y", "twice", "twice", *texts(7, 250), *texts(8, 12, more=["▁"])]
    own = A.tokens(A_PATH, B_PATH)
    want = brute(own, docs)
    got, n = found(spark, docs)
    assert n == len(docs) and any(w[0] == 0 for w in want[8:])
    for i, w in enumerate(want):
        assert tuple(got[i][c] for c in (*A.FIGURES, "groups_sha256")) == w, repr(docs[i])


def test_pairs_joined_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(A, "PAIRS", 0)
    docs = texts(9, 60)
    want = brute(A.tokens(A_PATH, B_PATH), docs)
    got, _ = found(spark, docs)
    assert [tuple(got[i][c] for c in (*A.FIGURES, "groups_sha256")) for i in range(len(docs))] == want


def test_long_texts_groups_and_empty_table(spark):
    docs = ["word, and " * 30_000, "x" * 60_000, "\n" * 3000]
    want = brute(A.tokens(A_PATH, B_PATH), [docs[1], docs[2]])
    got, _ = found(spark, docs, groups=True)
    for i, w in ((1, want[0]), (2, want[1])):
        assert (got[i].n_a, got[i].n_groups, got[i].groups_sha256) == (w[0], w[2], w[6])
    assert got[0].n_a == 90_001 and hashlib.sha256(got[0].groups.encode()).hexdigest() == got[0].groups_sha256
    assert A.align_documents(spark, spark.createDataFrame([], SCHEMA).select("doc_id", "text"), A_PATH, B_PATH, ["doc_id"]).count() == 0


def test_a_slice_hashes_its_segments_once_for_many_texts(monkeypatch):
    texts = ["ab cd " * 170_000, None, "", "cd", *["ab  ef\n" * 140_000] * 3]
    names = sorted({s for t in texts if t for s in A.cut(" " + t)})
    rows = lambda some: pa.table({"segment": pa.array(some, pa.string()), "ok": [s != " cd" for s in some], **{f: pa.array([len(s) + k for s in some]) for k, f in enumerate(A.FIGURES)}, "groups": [f"{len(s)}|1" for s in some]})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows(names[:1]).schema) as out:
        out.write_table(rows(names[:1]))
    sent = type("Sent", (), {"value": sink.getvalue().to_pybytes()})
    docs = pa.table({"slice": [0] * len(texts), "doc_id": range(len(texts)), "text": pa.array(texts, pa.string())})
    calls, look = [], pc.index_in
    monkeypatch.setattr(A.pc, "index_in", lambda *a, **b: calls.append(1) or look(*a, **b))
    found = A._fold(True, True, sent, docs, rows(names[1:])).to_pylist()
    assert len(calls) == 1
    for r, t in zip(found, texts, strict=True):
        own = A.cut(" " + t) if t else []
        good = own and " cd" not in own
        whole = ";".join(f"{len(s)}|1" for s in own) if good else None
        assert r["groups"] == whole and r["groups_sha256"] == (hashlib.sha256(whole.encode()).hexdigest() if good else "")
        assert [r[f] for f in A.FIGURES] == [sum(len(s) + k for s in own) if good else 0 for k in range(len(A.FIGURES))]
