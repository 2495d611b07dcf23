"""The pipeline's stages against literal versions, on a small fixture with planted cases."""

import sys
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as T_F

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
import corpus_pipeline as P  # noqa: E402

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _fp(text):
    w = (text or "").encode().lower().split()
    grams = [b" ".join(w[i:i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def _docs(spark, rows):
    full = [(i, t, "en", "src1", None if t is None else len(t)) for i, t in rows]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)


ROWS = [(i, f"Home page\nclean text number {i} about the ferry and its crew of {i} people at the quay") for i in range(12)]
ROWS += [(20, "one copy of a longer text that stands here twice without any change at all"),
         (21, "one copy of a longer text that stands here twice without any change at all"),
         (30, "write to someone.else@mail.example or 10.0.0.1 now"), (31, None), (32, ""), (33, "")]


def test_line_stage(spark):
    out = P.drop_lines(spark, _docs(spark, ROWS), "")
    assert out.columns == COLUMNS
    got = {r.doc_id: r for r in out.collect()}
    for i, t in ROWS:
        want = t if t is None else "\n".join(s for s in t.split("\n") if s != "Home page")
        assert got[i].text == want and got[i].n_chars == (None if t is None else len(want))


def test_simhash_stage(spark):
    rows = [(i, t if t is None else t.replace("Home page\n", "")) for i, t in ROWS]
    out = P.one_of_each(spark, _docs(spark, rows), "")
    groups = defaultdict(list)
    fps = {i: _fp(t) for i, t in rows}
    root = {i: i for i in fps}
    for a in sorted(fps):
        for b in sorted(fps):
            if a < b and (fps[a] ^ fps[b]).bit_count() <= 4:
                ra, rb = root[a], root[b]
                root = {k: min(ra, rb) if v in (ra, rb) else v for k, v in root.items()}
    for i, c in root.items():
        groups[c].append(i)
    kept = sorted(r.doc_id for r in out.collect())
    assert kept == sorted(min(g) for g in groups.values()) and 21 not in kept and 20 in kept
    assert out.columns == COLUMNS


def test_pii_stage(spark):
    out = {r.doc_id: r for r in P.hide_personal(spark, _docs(spark, ROWS), "").collect()}
    assert out[30].text == "write to [EMAIL] or [IP] now" and out[30].n_chars == len(out[30].text)
    assert all(out[i].text == t for i, t in ROWS if i != 30)


def test_packing_stage(spark):
    out = P.pack(spark, _docs(spark, ROWS), "").collect()
    assert {r.doc_id for r in out} == {i for i, _ in ROWS}
    assert all(len(r.ids) == 4 * r.length for r in out)


def test_run(spark, sf_dir):
    """Labelled clean documents stay, copies and personal data go, and every kept token is packed once."""
    from phrasemill.llm import tables as T
    docs = {r.doc_id: r.text for r in T.read(spark, sf_dir, "documents").collect()}
    pieces = P.run(spark, sf_dir).collect()
    kept = {r.doc_id for r in pieces}
    labels = T.read(spark, sf_dir, "labels").collect()
    good = [r.doc_id for r in labels if r.quality == 1]
    first_of = {}
    for i in sorted(docs):
        first_of.setdefault(docs[i], i)
    unique_good = [i for i in good if first_of[docs[i]] == i]
    assert np.mean([i in kept for i in unique_good]) > 0.8
    assert np.mean([r.doc_id in kept for r in labels if r.quality == 0]) < 0.3
    texts = Counter(docs[i] for i in kept)
    assert max(texts.values()) == 1                       # no exact copies are left
    by_doc = defaultdict(int)
    for r in pieces:
        by_doc[r.doc_id] += r.length
    assert all(by_doc[r.doc_id] == r.doc_tokens for r in pieces)


BLANK = " \t\n\x0b\x0c\r"


def _literal_run(spark, sf_dir):
    """The five stages by plain loops: {doc_id: token ids}.  Only the model is the trained one."""
    from test_text import _literal_sanitise
    from tokenizers import Tokenizer

    from phrasemill.llm import quality
    from phrasemill.llm import tables as T
    table = T.read(spark, sf_dir, "documents")
    labels = T.read(spark, sf_dir, "labels").filter(~quality.held_out(T_F.col("doc_id")))
    model = quality.train(table, labels, "quality")
    docs = sorted((r.doc_id, r.text, r.n_chars) for r in table.collect())
    scores = model.score([t for _, t, _ in docs], np.array([[np.nan if n is None else float(n)] for _, _, n in docs]))
    rows = [(i, t) for (i, t, _), s in zip(docs, scores, strict=True) if s >= 0.3]
    upper = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
    held = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            held[line.strip(BLANK).translate(upper)].add(i)
    rows = [(i, t if t is None else "\n".join(x for x in t.split("\n") if not (
        (k := x.strip(BLANK).translate(upper)) and len(held[k]) >= 10))) for i, t in rows]
    fps = [_fp(t) for _, t in rows]
    root = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if root[a] != root[b] and (fps[a] ^ fps[b]).bit_count() <= 4:
                low, high = sorted((root[a], root[b]))
                root = [low if r == high else r for r in root]
    rows = [r for n, r in enumerate(rows) if root[n] == n]
    encode = Tokenizer.from_file(T.tokenizer("word_bpe_49k.json")).encode
    return {i: [*encode(t or "", add_special_tokens=False).ids, 2] for i, t, _ in _literal_sanitise(rows)}


def test_run_same_as_literal(spark, sf_dir):
    """run() keeps the documents, and of each the very tokens, that the chained literal stages keep."""
    parts = defaultdict(list)
    for r in P.run(spark, sf_dir).collect():
        parts[r.doc_id].append((r.start, bytes(r.ids)))
    got = {i: np.frombuffer(b"".join(x for _, x in sorted(p)), "<u4").tolist() for i, p in parts.items()}
    want = _literal_run(spark, sf_dir)
    assert set(got) == set(want) and 0 < len(got) < 200
    assert [i for i in got if got[i] != want[i]] == []


def test_odd_rows_in_every_stage(spark, nasty, sf_dir):
    """Nulls, empty and long texts, repeated rows and ids go through the first and the last stage, too."""
    odd = nasty.withColumn("n_chars", T_F.length("text").cast("long")).withColumn("doc_id", T_F.col("doc_id"))
    kept = P.keep_quality(spark, odd, sf_dir)
    assert kept.columns == odd.columns and kept.count() <= odd.count()
    packed = P.pack(spark, odd, sf_dir)
    assert packed.agg(T_F.sum("length")).first()[0] > 0 and packed.filter("start = 0").count() == odd.count()


def test_empty(spark, no_docs, sf_dir):
    assert P.keep_quality(spark, no_docs, sf_dir).count() == 0
    for stage in (P.drop_lines, P.one_of_each, P.hide_personal, P.pack):
        assert stage(spark, no_docs, "").count() == 0


def test_repeated_rows_and_extra_columns(spark, nasty):
    for stage in (P.drop_lines, P.one_of_each, P.hide_personal):
        out = stage(spark, nasty, "")
        assert out.columns == nasty.columns
    assert P.drop_lines(spark, nasty, "").count() == nasty.count()


@pytest.mark.parametrize("missing", ["n_chars"])
def test_quality_stage_without_metadata(spark, sf_dir, missing):
    from phrasemill.llm import tables as T
    docs = T.read(spark, sf_dir, "documents").drop(missing)
    out = P.keep_quality(spark, docs, sf_dir)
    assert out.columns == docs.columns and 0 < out.count() <= docs.count()
