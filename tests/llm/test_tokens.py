"""Packing and byte-level BPE against the tokenizer libraries themselves."""

import zlib
from collections import defaultdict
from functools import cache

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from phrasemill.llm import byte_bpe
from phrasemill.llm import tables as T
from phrasemill.llm.packing import WordTokens, pack_documents

WORD, RANKS = T.tokenizer("word_bpe_49k.json"), T.tokenizer("byte_bpe_50k.tiktoken")


def _word_ids(text):
    from tokenizers import Tokenizer
    return Tokenizer.from_file(WORD).encode(text or "", add_special_tokens=False).ids + [2]


def _check_pieces(pieces, docs, window):
    """Every id of every document lies in exactly one piece; sequences are gapless and not too long."""
    from collections import Counter
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_seq[p.sequence_id].append(p)
        assert len(p.ids) == 4 * p.length > 0
    for seq in by_seq.values():
        at = 0
        for p in sorted(seq, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= window
    want = Counter((i, tuple(_word_ids(t))) for i, t in docs)
    assert set(by_doc) == {i for i, _ in docs}
    for i in {i for i, n in Counter(i for i, _ in docs).items() if n == 1}:
        parts = sorted(by_doc[i], key=lambda p: p.start)
        ids = tuple(int(x) for p in parts for x in np.frombuffer(p.ids, "<u4"))
        assert want[(i, ids)] == 1 and {p.doc_tokens for p in parts} == {len(ids)}
        assert [p.start for p in parts] == list(np.cumsum([0] + [p.length for p in parts])[:-1])
    for i in by_doc:
        assert sum(p.length for p in by_doc[i]) == sum(len(ids) * n for (j, ids), n in want.items() if j == i)
    used = [sum(p.length for p in s) for s in by_seq.values()]
    return used


@pytest.mark.parametrize("window,keep,parts", [(64, 4, 3), (4096, 48, 3), (16, 1, 20)])
def test_packing_pieces(nasty, window, keep, parts):
    docs = [(r.doc_id, r.text) for r in nasty.collect()]
    got = pack_documents(nasty.repartition(parts), WORD, 2, window=window, open_windows=keep, fan_in=3).collect()
    used = _check_pieces(got, docs, window)
    assert sum(u < window for u in used) <= 1  # only the last window is padded


def test_packing_empty(no_docs):
    assert pack_documents(no_docs, WORD, 2).count() == 0


def test_packing_table(spark, sf_dir):
    docs = T.read(spark, sf_dir, "documents")
    got = pack_documents(docs.repartition(7), WORD, 2).collect()
    _check_pieces(got, [(r.doc_id, r.text) for r in docs.collect()], 4096)


def test_query_crc(spark, sf_dir):
    from phrasemill.llm import queries as Q
    row = Q.op2_packing(spark, sf_dir).filter("doc_id = 1 and start = 0").first()
    ids = _word_ids(T.read(spark, sf_dir, "documents").filter("doc_id = 1").first().text)[:row.length]
    assert row.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())


def _tiktoken():
    import public_tokenizers as P
    import tiktoken
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={})


@pytest.mark.parametrize("block_bytes,per_bucket", [(1000, 10), (8 << 20, 500_000)])
def test_bpe_same_as_library(nasty, block_bytes, per_bucket):
    enc = _tiktoken()
    got = byte_bpe.decode(byte_bpe.encode(nasty, RANKS, T.pretoken_pattern(), block_bytes=block_bytes,
                                          words_per_bucket=per_bucket), RANKS).collect()
    key = lambda x: (str(x[0]), x[1], x[2])
    want = [(r.doc_id, np.array(enc.encode_ordinary(r.text or ""), "<u4").tobytes(), (r.text or "").encode()) for r in nasty.collect()]
    assert sorted(((r.doc_id, bytes(r.ids), bytes(r.decoded)) for r in got), key=key) == sorted(want, key=key)


def test_bpe_table(spark, sf_dir):
    enc = _tiktoken()
    docs = {r.doc_id: r.text for r in T.read(spark, sf_dir, "documents").collect()}
    got = byte_bpe.encode(T.read(spark, sf_dir, "documents"), RANKS, T.pretoken_pattern()).collect()
    assert len(got) == len(docs)
    for r in got:
        assert np.frombuffer(r.ids, "<u4").tolist() == enc.encode_ordinary(docs[r.doc_id] or "")


def test_bpe_decoded_in_one_pass(nasty):
    one = byte_bpe.encode(nasty, RANKS, T.pretoken_pattern(), decoded=True)
    two = byte_bpe.decode(byte_bpe.encode(nasty, RANKS, T.pretoken_pattern()), RANKS)
    key = lambda r: (str(r.doc_id), bytes(r.ids), bytes(r.decoded))
    assert sorted(map(key, one.collect())) == sorted(map(key, two.collect()))


def test_bpe_empty(no_docs):
    out = byte_bpe.decode(byte_bpe.encode(no_docs, RANKS, T.pretoken_pattern()), RANKS)
    assert out.count() == 0 and out.columns == ["doc_id", "ids", "decoded"]


@cache
def _both():
    from tokenizers import Tokenizer
    return WordTokens(WORD), Tokenizer.from_file(WORD)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(st.one_of(st.characters(max_codepoint=0x24f, exclude_categories=["Cs"]), st.characters(exclude_categories=["Cs"]),
                                  st.sampled_from("AaZz09'.,!\u0301\u0130\u03a3\u1e9e\u00df<|>")), max_size=12), max_size=8))
def test_word_tokens_same_as_library(parts):
    text = " ".join([*parts, "<|endoftext|>", "it's", "Don'T", "x" * 50])
    ours, library = _both()
    assert np.frombuffer(ours([text])[0], "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


@settings(max_examples=6, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from(" \t\n\r\x0b\x1c\x85    ab'sZ09.,é日😀"), st.characters(exclude_categories=["Cs"])), max_size=40),
                min_size=60, max_size=90))
def test_bpe_random_same_as_library(spark, texts):
    enc = _tiktoken()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    got = byte_bpe.encode(df, RANKS, T.pretoken_pattern(), block_bytes=1500, words_per_bucket=20, decoded=True).collect()
    assert {r.doc_id: (np.frombuffer(r.ids, "<u4").tolist(), bytes(r.decoded)) for r in got} == {
        i: (enc.encode_ordinary(t), t.encode()) for i, t in enumerate(texts)}
