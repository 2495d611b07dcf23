"""Substring dedup and line dedup against literal versions."""

import random
import string
from collections import defaultdict

import pytest

from phrasemill.llm import line_dedup as L
from phrasemill.llm.substring_dedup import substring_dedup


def _literal_substrings(rows, k):
    first = {}
    for i, t in rows:
        w = (t or "").encode().split()
        for p in range(len(w) - k + 1) if i is not None else ():
            g = tuple(w[p:p + k])
            first[g] = min(first.get(g, i), i)
    out = []
    for i, t in rows:
        w, gone = (t or "").encode().split(), set()
        for p in range(len(w) - k + 1) if i is not None else ():
            if first[tuple(w[p:p + k])] < i:
                gone |= set(range(p, p + k))
        out.append((i, len(w), len(gone), b" ".join(x for j, x in enumerate(w) if j not in gone).decode()))
    return sorted(out, key=str)


def _substrings(df, **how):
    got = substring_dedup(df, **how).collect()
    for r in got:  # the reported ranges are the removed words
        assert sum(s.end - s.start for s in r.removed) == r.n_removed
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got), key=str)


def _passages(seed, n):
    rnd = random.Random(seed)
    base = [" ".join(rnd.choice("abc") for _ in range(12)) for _ in range(8)]
    piece = lambda: rnd.choice(base) if rnd.random() < .6 else " ".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(0, 9)))
    rows = [(i, "  ".join(piece() for _ in range(rnd.randint(0, 6)))) for i in range(n)]
    return [*rows, (None, base[0]), (None, None), (n, None), (n, base[0]), (n, base[0]), (n + 1, ""), (5, base[1])]


@pytest.mark.parametrize("key_bits", [40, 6])  # 6: most keys collide, so digests must settle them
@pytest.mark.parametrize("seed", [5, 6])
def test_substrings_same_as_literal(spark, seed, key_bits):
    rows = _passages(seed, 100)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = _substrings(df, k=5, key_bits=key_bits, block_bytes=500, edges_per_bucket=50)
    assert got == _literal_substrings(rows, 5)


def test_substrings_odd_rows(spark, nasty):
    rows = [(r.doc_id, r.text) for r in nasty.collect()]
    assert _substrings(nasty, k=3) == _literal_substrings(rows, 3)


def test_substrings_hot_passage(spark):
    """A third of the documents hold one passage, in one block's answer each."""
    rows = [(i, f"own{i} words{i} " + ("p q r s t u v w " if i % 3 == 0 else f"x{i} ") + f"tail{i}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in substring_dedup(df, k=4, block_bytes=1000).collect()}
    assert got[0].n_removed == 0 and all(got[i].n_removed == 8 for i in range(3, 300, 3))
    assert all(got[i].n_removed == 0 for i in range(300) if i % 3)


def test_substrings_empty(no_docs):
    assert substring_dedup(no_docs).count() == 0


def _literal_lines(rows, at_least):
    lower = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
    key = lambda s: s.strip(L.WHITE).translate(lower)
    docs = defaultdict(set)
    for i, t in rows:
        for s in (t or "").split("\n"):
            docs[key(s)].add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [s for s in lines if not key(s) or len(docs[key(s)]) < at_least]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def _lines(df, at_least, n="n_lines"):
    got = L.line_dedup(df, min_docs=at_least).collect()
    return sorted(((r.doc_id, r[n], r.n_dropped, r.text or "") for r in got), key=str)


@pytest.mark.parametrize("at_least", [1, 2, 3])
def test_lines_same_as_literal(spark, at_least):
    rnd = random.Random(3)
    some = ["Home", " home\t", "About US", "", "  ", "Ünïcode É", "ünïcode é", "x\x0b", "\x1cx", "z" * 3000]
    rows = [(i, "\n".join(rnd.choice(some) if rnd.random() < .7 else f"own {i} {j}" for j in range(rnd.randint(0, 8)))) for i in range(60)]
    rows += [(3, "Home\nHome\nHome"), (3, "Home\nHome\nHome"), (None, "Home\nx"), (None, None), (99, None), (100, "\n\n")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert _lines(df, at_least) == _literal_lines(rows, at_least)


def test_lines_odd_rows(nasty):
    rows = [(r.doc_id, r.text) for r in nasty.collect()]
    assert _lines(nasty, 2, "n_lines_1") == _literal_lines(rows, 2)
    out = L.line_dedup(nasty, min_docs=2)
    assert out.columns == [*nasty.columns, "n_lines_1", "n_dropped"]
    assert out.filter("text is null").count() == nasty.filter("text is null").count()


def test_lines_empty(no_docs):
    assert L.line_dedup(no_docs).count() == 0


def test_lines_native_and_text_split_once_per_row(spark, sf_dir):
    from phrasemill.llm import tables as T
    plan = L.line_dedup(T.read(spark, sf_dir, "documents"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
