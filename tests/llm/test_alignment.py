"""Cross-tokenizer alignment against a literal version on every row."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from phrasemill.llm import alignment as A
from phrasemill.llm import queries as Q
from phrasemill.llm import tables as T

A_PATH, B_PATH = T.tokenizer("byte_bpe_50k.json"), T.tokenizer("piece_bpe_32k.model")


def _literal(rows):
    """By the libraries and byte ranges, a pair at a time."""
    import sentencepiece
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(A_PATH)
    t.encode_special_tokens = True
    p = sentencepiece.SentencePieceProcessor(model_file=B_PATH)
    _, (va, aa, sa) = A.byte_level(A_PATH)
    found, pairs = [], Counter()
    for i, text in rows:
        a = t.encode(" " + text, add_special_tokens=False).ids if text else []
        b = p.encode(text) if text else []
        raw = (" " + (text or "")).encode()
        bytes_a = [bytes(va[aa[x]:aa[x] + sa[x]]) for x in a]
        bytes_b = [bytes([int(p.id_to_piece(x)[1:-1], 16)]) if p.is_byte(x) else p.id_to_piece(x).replace("▁", " ").encode() for x in b]
        if not text or b"".join(bytes_a) != raw or b"".join(bytes_b) != raw:
            found.append((i, [], [], [], []))
            continue
        ends = []
        for tokens in (bytes_a, bytes_b):
            end, out = 0, []
            for x in tokens:
                out.append((end, end + len(x)))
                end += len(x)
            ends.append(out)
        links, k = [], 0
        for x, (lo, hi) in enumerate(ends[0]):
            while ends[1][k][1] <= lo:
                k += 1
            y = k
            while y < len(b) and ends[1][y][0] < hi:
                links.append((x, y))
                y += 1
        cuts = sorted({e for _, e in ends[0]} & {e for _, e in ends[1]})
        groups, x, y = [], 0, 0
        for c in cuts:
            x2 = next(n for n in range(x, len(a)) if ends[0][n][1] == c) + 1
            y2 = next(n for n in range(y, len(b)) if ends[1][n][1] == c) + 1
            groups.append(",".join(map(str, a[x:x2])) + "|" + ",".join(map(str, b[y:y2])))
            x, y = x2, y2
        pairs.update((a[m], b[n]) for m, n in links)
        found.append((i, a, b, groups, links))
    top = {}
    for (_, y), n in pairs.items():
        top[y] = max(n, top.get(y, 0))
    out = []
    for i, a, b, groups, links in found:
        n = [pairs[a[x], b[y]] for x, y in links]
        best = sum(c == top[b[y]] for c, (_, y) in zip(n, links, strict=True))
        out.append((i, len(a), len(b), len(groups), len(links), best, sum(n), ";".join(groups)))
    return sorted(out, key=str)


def _got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


ODD = ["<|endoftext|> a <s></s> <0x41> ▁ b", "a  b   c\n\n\td ", " lead", "日本語 テスト 😀👩‍👩‍👧 é é ﬁ", "a" * 5000, "x " * 4000, "\x00\x01 null", "don't 's 1234567 ...!!",
       "ＡＢＣ ½ ①", "▁▁", " ", "  ", "ñandú İstanbul ΣΑΣ", "\r\n\x0b\x0c tabs\t\t", "مرحبا नमस्ते", "﻿bom  nbsp "]


def test_odd_rows(spark, nasty, no_docs, monkeypatch):
    monkeypatch.setattr(A, "WRITE_LINKS", 100)
    rows = [(r.doc_id, r.text) for r in nasty.collect()] + [(100 + i, t) for i, t in enumerate(ODD)]
    df = nasty.select("doc_id", "text", "block").unionByName(
        spark.createDataFrame([(i, t, 5) for i, t in rows[-len(ODD):]], "doc_id long, text string, block int")).withColumn("a", A.F.lit(1))
    for cap in (1 << 26, 0):      # counts by broadcast, and by joins
        assert _got(A.align(df, A_PATH, B_PATH, block_bytes=2000, max_broadcast_bytes=cap)) == _literal(rows)
    for cap in (1 << 26, 0):
        assert A.align(no_docs, A_PATH, B_PATH, max_broadcast_bytes=cap).count() == 0


def test_random(spark):
    r = random.Random(3)
    some = ["the", "cat", "sat", "naïve", "東京", "😀", "  ", "\n", "don't", "123", "zzz", "Ω", "un", "believ", "able"]
    rows = [(i, "".join(r.choice(some) + r.choice(["", " "]) for _ in range(r.randint(0, 60)))) for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert _got(A.align(df, A_PATH, B_PATH, block_bytes=3000)) == _literal(rows)


def test_table(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in T.read(spark, sf_dir, "documents").collect()]
    want = [(*x[:-1], hashlib.sha256(x[-1].encode()).hexdigest() if x[1] else "") for x in _literal(rows)]
    assert _got(Q.op12_alignment(spark, sf_dir)) == sorted(want, key=str)


@pytest.mark.parametrize("lane", [1, 2, 7, 512])
def test_lanes_give_the_same_steps(lane):
    texts = [*ODD, "word " * 300, None, ""]
    na, nb, nl, a, b, codes = A.align_texts(texts, A_PATH, B_PATH, lane)
    whole = A.align_texts(texts, A_PATH, B_PATH, 1 << 30)[-1]
    assert np.array_equal(codes, whole) and nl.sum() == len(codes) and (codes == A.BOTH_END).sum() > 0
    i, j = A.places(codes)
    assert i.max() + 1 == len(a) == na.sum() and j.max() + 1 == len(b) == nb.sum()


def test_tokens_and_steps(spark):
    rows = [(1, "some unbelievable text"), (2, ""), (None, "naïve 東京")]
    for r in A.align(spark.createDataFrame(rows, "doc_id long, text string"), A_PATH, B_PATH, tokens=True).collect():
        if r.n_a:
            assert A.groups_of(np.frombuffer(r.a_ids, "<u4"), np.frombuffer(r.b_ids, "<u4"), np.frombuffer(r.steps, np.uint8),
                               np.array([r.n_a]), np.array([r.n_b]))[0].decode() == r.groups
        assert (len(r.a_ids), len(r.b_ids), len(r.steps)) == (4 * r.n_a, 4 * r.n_b, r.n_links) and r.steps.count(2) == r.n_groups
