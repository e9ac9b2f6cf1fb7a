"""Operators 11 and 12 against the tokenizers themselves, text by text."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from parley.llm import chunks, packing, token_links

from .test_operators import DOCS, SF, clashing, odd_rows

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
PARTS = ["the", " quick", " ", "  ", "\n", "\n\n", "\r\n", "\t", "'s", "don't", "12.5%", "...", ",", "é", "é", "你好", "日本語テキスト", "ß", "<|endoftext|>", "<s>", "</s>", "<0x41>", " ", "　", " ", "\u0085", "\x1c", "\x1f", "\x00", "▁", "🙂", "👩‍👩‍👧", "(x){\r", "for(;;)", "Ünder", "ﬁ", "​", "﻿", "ａ", "٣", "Ⅷ", "́", "x" * 300, "_", "--", "ĠĊ"]


def odd_texts(n=4000, seed=11):
    r = random.Random(seed)
    return ["".join(r.choice(PARTS) for _ in range(r.randint(1, 12))) for _ in range(n)]


@pytest.fixture(scope="module")
def both():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def spelling():
    """The byte for each letter of the byte-level alphabet, by encoding single bytes' own letters."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


def tokens(both, text):
    """((id, bytes) of A, (id, bytes) of B), or two empty lists where their bytes aren't those of space + text."""
    a, b = both
    letters = spelling()
    x = [(i, bytes(letters[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
    y = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
    whole = b" " + text.encode()
    return (x, y) if text and b"".join(t for _, t in x) == whole == b"".join(t for _, t in y) else ([], [])


def brute_alignment(both, texts):
    """(n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each text."""
    found, counts = [], Counter()
    for text in texts:
        x, y = tokens(both, text or "")
        ends = []
        for side in (x, y):
            at, own = 0, {}
            for i, t in side:
                at += len(t)
                own[at] = i
            ends.append(own)
        links = [(ends[0][e], ends[1][e]) for e in sorted(ends[0].keys() & ends[1].keys())]
        groups, held = [], ([], [])
        for e in sorted(ends[0].keys() | ends[1].keys()):
            for k in (0, 1):
                if e in ends[k]:
                    held[k].append(str(ends[k][e]))
            if e in ends[0] and e in ends[1]:
                groups.append(",".join(held[0]) + "|" + ",".join(held[1]))
                held = ([], [])
        counts.update(links)
        found.append((len(x), len(y), groups, links))
    best = defaultdict(int)
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    return [(na, nb, len(g), len(ln), sum(counts[p] == best[p[1]] for p in ln), sum(counts[p] for p in ln), hashlib.sha256(";".join(g).encode()).hexdigest() if na else "") for na, nb, g, ln in found]


NUMBERS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def rows_of(df, key="doc_id"):
    return sorted((r[key], *(r[c] for c in NUMBERS)) for r in df.collect())


# 11 -----------------------------------------------------------------------------------------------------------------
def test_links_of_whole_table(spark, both):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    expected = sorted((r.doc_id, *x) for r, x in zip(rows, brute_alignment(both, [r.text for r in rows]), strict=True))
    assert rows_of(token_links.report(docs.repartition(5))) == expected
    assert rows_of(token_links.report(docs.repartition(5), max_pairs=10)) == expected


def test_links_of_odd_texts(spark, both):
    texts = odd_texts()
    expected = brute_alignment(both, texts)
    assert sum(x[0] > 0 for x in expected) > 2000
    assert sum(x[0] == 0 for x in expected) > 100
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    assert [r[1:] for r in rows_of(token_links.report(docs))] == expected


def test_links_of_odd_rows(spark, both):
    df = clashing(spark.createDataFrame([*odd_rows(), (12, "x▁y", "en", "a", 3), (13, " ", "en", "a", 1)], DOCS))
    rows = df.collect()
    found = token_links.report(df).collect()
    key = lambda r: (str(r.doc_id), *(getattr(r, c) for c in NUMBERS))
    expected = [(str(r.doc_id), *x) for r, x in zip(rows, brute_alignment(both, [r.text for r in rows]), strict=True)]
    assert sorted(map(key, found)) == sorted(expected)
    assert token_links.report(spark.createDataFrame([], DOCS)).collect() == []


def test_invalid_utf8(spark):
    df = spark.createDataFrame([(1,)], "doc_id long").withColumn("text", F.expr("cast(X'FF41' as string)"))
    r = token_links.report(df).collect()[0]
    assert (r.n_a, r.n_links, r.groups_sha256) == (0, 0, "")


def test_all_links_are_those_of_dense_matrices(spark, both):
    texts = ["", "hello wörld, hello", "日本語テキスト and more 🙂", *odd_texts(60, 5)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in token_links.all_links(df).collect():
        x, y = tokens(both, texts[r.doc_id])
        assert (r.a_ids, r.b_ids) == ([i for i, _ in x], [i for i, _ in y])
        n = sum(len(t) for _, t in x)
        dense = []
        for side in (x, y):
            m, at = np.zeros((len(side), n), int), 0
            for i, (_, t) in enumerate(side):
                m[i, at : at + len(t)] = 1
                at += len(t)
            dense.append(m)
        shared = dense[0] @ dense[1].T
        assert [(p.a, p.b, p.bytes) for p in r.overlaps] == [(i, j, shared[i, j]) for i, j in zip(*np.nonzero(shared), strict=True)]
        ends = [np.cumsum([len(t) for _, t in side]).tolist() for side in (x, y)]
        common = sorted(set(ends[0]) & set(ends[1]))
        group = [[sum(c < e for c in common) for e in own] for own in ends]
        assert {(p.a, p.b) for p in r.shared} == {(i, j) for i, g in enumerate(group[0]) for j, h in enumerate(group[1]) if g == h}
        assert len(r.shared) == len({(p.a, p.b) for p in r.shared})


def test_product_of_random_matrices(monkeypatch):
    monkeypatch.setattr(token_links, "BLOCK", 7)
    r = np.random.default_rng(3)
    for _ in range(40):
        n, k, m = r.integers(1, 9, 3)
        a, b = (r.random((n, k)) < 0.4).astype(int), (r.random((k, m)) < 0.4).astype(int)
        made = [token_links.Csr.of(x.sum(axis=1), np.nonzero(x)[1], x.shape[1]) for x in (a, b)]
        c = token_links.product(*made)
        dense = np.zeros((n, m), int)
        for i in range(n):
            dense[i, c.indices[c.indptr[i] : c.indptr[i + 1]]] = c.data[c.indptr[i] : c.indptr[i + 1]]
        assert (dense == a @ b).all()


def test_long_texts_go_in_parts(both, monkeypatch):
    monkeypatch.setattr(token_links, "PART", 5)
    texts = odd_texts(600, 8)
    one = token_links.Aligner(A, B)
    numbers, groups, *_ = one.align([t.encode() for t in texts])
    expected = brute_alignment(both, texts)
    assert [(*n, g) for n, g in zip(numbers.tolist(), groups, strict=True)] == [(*x[:4], x[6]) for x in expected]
    # A text of many parts by itself.
    for text, x in zip(texts[:200], expected, strict=False):
        n, g, a, b = one.align([text.encode()])
        assert (*n[0].tolist(), g[0]) == (*x[:4], x[6])
        assert len(a) == len(b) == x[3]


def test_cut_gives_the_text_back():
    for t in [*odd_texts(2000, 4), "", " ", "a b\nc", "a  b", " a"]:
        assert "".join(chunks.cut(t)) == t


# 12 -----------------------------------------------------------------------------------------------------------------
def check_packing(rows, texts, length=2048, path=A):
    """``texts``: (doc_id, text), doc_ids unlike each other."""
    tokenizer = Tokenizer.from_file(path)
    pieces, places = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        places[r.sequence_id].append((r.offset, r.length))
    assert len(texts) == len(pieces)
    total = 0
    for doc, text in texts:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        total += len(ids)
        at = 0
        for p in sorted(pieces[doc], key=lambda r: r.start):
            assert (p.start, p.doc_tokens) == (at, len(ids))
            at += p.length
            assert p.ids_crc32 == zlib.crc32(np.array(ids[p.start : at], "<u4").tobytes())
        assert at == len(ids)
    for spots in places.values():
        at = 0
        for offset, n in sorted(spots):
            assert offset == at
            at += n
        assert at <= length
    assert sorted(places) == list(range(-(-total // length)))


def test_packing_of_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    for n in (1, 7):
        check_packing(packing.report(docs.repartition(n)).collect(), texts)


def test_packing_of_odd_texts(spark):
    texts = list(enumerate(odd_texts(3000, 12)))
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(6)
    check_packing(packing.report(docs).collect(), texts)
    check_packing(packing.report(docs, length=16).collect(), texts, 16)


def test_packing_of_odd_rows(spark, monkeypatch):
    df = clashing(spark.createDataFrame(odd_rows(), DOCS)).repartition(3)
    rows = packing.report(df).collect()
    tokenizer = Tokenizer.from_file(A)
    assert sum(r.length for r in rows) == sum(len(tokenizer.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in df.collect())
    assert sum(r.start == 0 for r in rows) == len(odd_rows())
    assert packing.report(spark.createDataFrame([], DOCS)).collect() == []
    # Offsets by a shuffled table of partitions give the same pieces.
    tokens = packing.encoded(df, A, 1)
    sent, joined = (sorted(map(tuple, packing.placed(tokens, n).select("spot", "n_tokens").collect())) for n in (10, 0))
    assert sent == joined


@pytest.mark.parametrize("length", [8, 2048])
def test_sequences_are_the_ids_in_a_row(spark, length):
    texts = odd_texts(200, 3)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    parts = packing.written(packing.packed(docs, length=length), "parts")
    rows = sorted(packing.sequences(parts, length, pad_id=9).collect(), key=lambda r: r.sequence_id)
    tokenizer = Tokenizer.from_file(A)
    of = {i: [*tokenizer.encode(t, add_special_tokens=False).ids, 1] for i, t in enumerate(texts)}
    for r in rows:
        ids = np.frombuffer(bytes(r.ids), "<u4").tolist()
        made = []
        for p in r.pieces:
            assert p.offset == len(made)
            made += of[p.doc_id][p.start : p.start + p.length]
        assert r.length == len(made)
        assert ids == made + [9] * (length - len(made)) if r.length & (r.length - 1) else ids == made
    assert all(r.length == length for r in rows[:-1])


def test_another_tokenizer_has_whole_texts(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    texts = list(enumerate(["It's 12.5% ...", "été   naïve", None, "", "A <|endoftext|> b"]))
    check_packing(packing.report(spark.createDataFrame(texts, "doc_id long, text string"), tokenizer=path).collect(), texts, path=path)
