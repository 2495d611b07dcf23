"""PII spans and language-model scores against literal versions."""

import hashlib
import math
import re
from collections import Counter

import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from phrasemill.llm import blocks, byte_bpe, lm_score, pii
from phrasemill.llm import queries as Q
from phrasemill.llm import tables as T

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _valid(kind, m):
    digits = re.sub("[^0-9]", "", m)
    total = sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(digits)))
    return {"email": True, "ip": all(int(p) <= 255 for p in m.split(".")) if kind == "ip" else 0,
            "card": 14 <= len(digits) <= 19 and total % 10 == 0, "phone": 10 <= len(digits) <= 15}[kind]


def _literal_spans(text):
    found = [(m.start(), i, m.end(), k) for i, (k, p) in enumerate(PATTERNS.items()) for m in re.finditer(p, text or "") if _valid(k, m.group())]
    return sorted(found)


def _check(df, rows, **how):
    out = pii.sanitise(df, **how)
    got = sorted(((r[0], tuple((s.start, s.rank, s.end, s.kind) for s in r[1])) for r in
                  out.select("doc_id", F.filter("spans", lambda s: s["rank"] < 4)).collect()), key=str)
    assert got == sorted(((i, tuple(_literal_spans(t))) for i, t in rows), key=str)
    return out


def _window_hash(left, right):
    """Spark's xxhash64 of two strings."""
    h = xxhash.xxh64_intdigest(right.encode(), xxhash.xxh64_intdigest(left.encode(), 42))
    return h - 2**64 if h >= 2**63 else h


def _literal_sanitise(rows, window=96, alpha=0.9, support=3):
    """(id, clean text, spans) of each row, by plain loops."""
    word = re.compile(r"[^\W_]+")
    blank, n_t, n_e, n_te, seen = [], Counter(), Counter(), Counter(), {}
    for _, t in rows:
        b = list(t or "")
        for lo, _, hi, _ in _literal_spans(t):
            b[lo:hi] = " " * (hi - lo)
        blank.append("".join(b))
        n_t.update(m.group().lower() for m in word.finditer(blank[-1]))
    for (_, t), b in zip(rows, blank, strict=True):
        places = set()
        for lo, rank, hi, _ in _literal_spans(t):
            e = t[lo:hi].lower() if rank == 0 else t[lo:hi] if rank == 1 else re.sub("[^0-9]", "", t[lo:hi])
            n_e[rank, e] += 1
            left, right = max(lo - window, 0), min(hi + window, len(t))
            for part, at in ((b[left:lo], left), (b[hi:right], hi)):
                for m in word.finditer(part):
                    cut = m.start() == 0 < left if at == left and part is not b[hi:right] else hi + m.end() == right < len(t)
                    if not cut:
                        places.add((rank, e, at + m.start(), m.group().lower()))
                        seen.setdefault((rank, e, m.group().lower()), {}).setdefault(t, set()).add(_window_hash(b[left:lo], b[hi:right]))
        n_te.update((r, e, w) for r, e, _, w in places)
    total, terms = sum(n_t.values()), set()
    for (rank, e, w), n in n_te.items():
        texts = seen[rank, e, w]
        different = len({min(v) for v in texts.values()})
        ic = -math.log2(n_e[rank, e] / total)
        if different >= support and ic > 0 and (math.log2(n / n_t[w]) + ic) / ic >= alpha - 1e-12:
            terms.add(w)
    out = []
    for (i, t), b in zip(rows, blank, strict=True):
        spans = sorted(_literal_spans(t) + [(m.start(), 4, m.end(), "term") for m in word.finditer(b) if m.group().lower() in terms])
        at, parts = 0, []
        for lo, _, hi, kind in spans:
            if lo >= at:
                w = t[lo:hi]
                parts += [t[at:lo], f"[{kind.upper()}]" if kind != "term" else "[NUMBER]" if w.isnumeric() else ""]
            at = max(at, hi)
        out.append((i, None if t is None else "".join(parts) + t[at:], tuple(spans)))
    return out


TRICKY = [
    "a@b.c", "a@b.c._x@d.e", "..a@b..c a@b-.c. x@y z@w.1", "@@a@@b.c@d.e", "a" * 5000 + "@x.y " + "b" * 5000, "é@x.fr ñu@a.es ü",
    "1.2.3.4 256.1.1.1 1.2.3 1.2.3.4.5.6.7.8 0001.002.255.000 99999999999.1.1.1 1.2.3.4567", "1." * 3000,
    "4111 1111 1111 1111, 4111-1111-1111-1112 4111  1111 1111 1111 0000 0000 0000 00 5-5-0-0-0-0-0-0-0-0-0-0-0-0-0-4",
    "4111111111111111 4111111111111111 378282246310005-", "9" * 4000, "+1 (743) 555-3824 +12345 +1234567890123456 ++1-2-3-4-5-6-7-8-9-0 +1((((((((((2",
    "+33 1 23 45 67 89\n+44 20 7946 0958.", "日本 a@b.jp 😀 1.1.1.1 😀😀 4111111111111111", "", None, "no data here", "+1 555 123 4567 8.8.8.8 a@b.co",
    "a@b.c " * 500,
]


def test_pii_tricky(spark):
    rows = list(enumerate(TRICKY)) + [(3, TRICKY[3]), (3, "c@d.e"), (None, "n@ul.l"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = _check(df, rows)
    clean = {(r.doc_id, r.text) for r in out.collect()}
    assert {(None, "[EMAIL]"), (15, None), (16, "no data here"), (17, "[PHONE] [EMAIL]"),
            (13, "日本 [EMAIL] 😀 [IP] 😀😀 [CARD]")} <= clean
    assert (5, "é@x.fr ñ[EMAIL] ü") in clean     # a letter outside the pattern's class begins no address
    want = _literal_sanitise(rows)
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted(((i, t) for i, t, _ in want), key=str)


@settings(max_examples=3, deadline=None)
@given(st.lists(st.text("a1@. +-()9\n4é_%", max_size=60), min_size=40, max_size=60))
def test_pii_random(spark, texts):
    rows = list(enumerate(texts))
    _check(spark.createDataFrame(rows, "doc_id long, text string").coalesce(2), rows)


def test_pii_odd_rows(nasty, no_docs):
    for name in ("d", "x", "l", "s", "t", "hits", "term"):
        nasty = nasty.withColumn(name, F.lit(name))
    out = _check(nasty, [(r.doc_id, r.text) for r in nasty.collect()])
    assert out.columns == [*nasty.columns, "spans"] and out.count() == nasty.count()
    assert pii.sanitise(no_docs).count() == 0


def test_pii_table(spark, sf_dir):
    got = {r.doc_id: r for r in Q.op4_pii(spark, sf_dir).collect()}
    for r in T.read(spark, sf_dir, "documents").collect():
        want = _literal_spans(r.text)
        row = got[r.doc_id]
        assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == [sum(s[3] == k for s in want) for k in PATTERNS]
        assert row.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, b, k in want).encode()).hexdigest()


def test_pii_revealing_terms(spark):
    """Only words that stand beside an entity, in several windows, and hardly elsewhere, are terms."""
    rows = [(i, f"Notes {i} from the desk of Zarathustra Quill at zq@corp.example about item {i}") for i in range(4)]
    rows += [(10 + i, f"Something about the desk and the item {i} from other people at home") for i in range(40)]
    rows += [(60 + i, "copied text: Hapaxword wrote to hw@corp.example") for i in range(9)]     # one window, copied
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: r for r in pii.sanitise(df).collect()}
    for i in range(4):
        words = {rows[i][1][s.start:s.end] for s in out[i].spans if s.kind == "term"}
        assert {"Zarathustra", "Quill"} <= words and not words & {"the", "item", "from", "about"}
        assert "Zarathustra" not in out[i].text and "[EMAIL]" in out[i].text
    assert all(not out[10 + i].spans and out[10 + i].text == rows[4 + i][1] for i in range(40))
    assert [s.kind for s in out[60].spans] == ["email"]


def test_pii_terms_everywhere(spark):
    """A revealing term is removed far from its entity and in documents without it; a window goes past other numbers."""
    far = "plain words of no meaning " * 12
    rows = [(i, f"Memo {i}: Zarathustra Quill, 日本 😀 QUILL. {far} Note {i} by Zarathustra Quill at zq@corp.example.") for i in range(4)]
    rows += [(5, f"{far}only zarathustra knows"), (6, "zarathustra@corp.example is not Zarathustra's")]
    rows += [(20 + i, f"paid {i}7 by Xanthippe 2024 on card 4111 1111 1111 1111") for i in range(3)]
    rows += [(30 + i, f"Memo and note, paid on card by others at item {i} {far}") for i in range(40)]
    rows += [(90, None), (91, "")]
    out = {r.doc_id: r for r in pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), alpha=0.8).collect()}
    for i, t in rows:
        want = [(m.start(), m.end()) for m in re.finditer(r"\b(zarathustra|quill|xanthippe)\b(?!@)", t or "", re.I)]
        spans = {(s.start, s.end): t[s.start:s.end] for s in out[i].spans if s.kind == "term"}
        assert set(want) <= set(spans), (i, spans)
        assert not {w.lower() for w in spans.values()} & {"plain", "words", "memo", "note", "paid", "card", "others", "item"}
    assert out[5].text == f"{far}only  knows" and out[6].text == "[EMAIL] is not 's"
    assert out[90].text is None and out[91].text == "" and all(out[30 + i].text == rows[9 + i][1] for i in range(40))


def test_pii_short_terms(spark):
    """Names of one or two code points are terms; common short words are not."""
    rows = [(i, f"{i} is to Wu or 李 at wl@corp.example") for i in range(4)]
    rows += [(10 + i, f"it is up to us or at {i} of it") for i in range(60)]
    out = pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    for r in out:
        words = [dict(rows)[r.doc_id][s.start:s.end] for s in r.spans if s.kind == "term"]
        assert words == (["Wu", "李"] if r.doc_id < 4 else []), (r.doc_id, words)


def test_pii_no_terms_from_values(spark):
    """Parts of a value are no words beside its other copies, and one document is no support."""
    rows = [(1, "a@b.c " * 500), (2, "plan a, plan b, plan c of the day"), (3, "anna.berg@hilltop.example " * 4 + "wrote"),
            (4, "anna walked up the berg to the hilltop"), (5, "mail x@y.zz mail x@y.zz and rarely " * 3)]
    rows += [(10 + i, f"other words of item {i}") for i in range(30)]
    out = {r.doc_id: r for r in pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[2].text == rows[1][1] and out[4].text == rows[3][1]
    assert not [s for r in out.values() for s in r.spans if s.kind == "term"]


@settings(max_examples=3, deadline=None)
@given(st.data())
def test_pii_terms_same_as_literal(spark, data):
    """Information content, support and spans on random tables that hold terms."""
    names = data.draw(st.lists(st.sampled_from(["Zoë", "Quill", "李", "Ng", "Ørsted", "77"]), min_size=3, max_size=6, unique=True))
    rows = []
    for i in range(60):
        w = data.draw(st.lists(st.sampled_from(["a", "the", "of", "x1", "notes", *names]), min_size=1, max_size=9))
        if data.draw(st.booleans()):
            k = i % len(names)
            at = data.draw(st.integers(0, len(w)))
            w[at:at] = [names[k], data.draw(st.sampled_from([f"{k}u@corp.example", f"10.0.0.{k}", f"+1 555 000 000{k}"])), f"n{i}"]
        rows.append((i, " ".join(w)))
    rows += [(70 + i, f"more of the a notes and x{i}") for i in range(40)] + [(200, None), (201, ""), (3, rows[3][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    how = {"alpha": 0.6, "window": data.draw(st.sampled_from([8, 20, 96])), "support": 2}
    got = sorted(((r.doc_id, r.text, tuple((s.start, s.rank, s.end, s.kind) for s in r.spans)) for r in pii.sanitise(df, **how).collect()), key=str)
    assert got == sorted(_literal_sanitise(rows, **how), key=str)


def test_pii_linear_in_spans(spark):
    """Eight times the spans take about eight times the time; the rewritten text is whole."""
    import time

    def seconds(n):
        text = "".join(f"note {i} by user{i}@corp.example, " for i in range(n))
        df = spark.createDataFrame([(1, text)], "doc_id long, text string")
        best = []
        for _ in range(2):
            t = time.time()
            s = F.col("__pii_s")
            row = pii._with_blank(df, "text").select(
                F.size(s).alias("n"), pii._rewrite(F.col("__pii_t"), s, lambda x, _: pii._label(x)).alias("c"),
                F.size(pii._beside(F.col("__pii_b"), s, 96)).alias("w")).first()
            best.append(time.time() - t)
        assert row["n"] == n and row["c"] == "".join(f"note {i} by [EMAIL], " for i in range(n)) and row["w"] > n
        return min(best)

    seconds(100)
    small, large = seconds(2000), seconds(16000)
    assert large < 16 * small + 2, (small, large)


def test_pii_is_native(spark, sf_dir):
    plan = pii.sanitise(T.read(spark, sf_dir, "documents"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# ---------------------------------------------------------------- language model
def _literal_scores(rows):
    docs = [(t or "").encode().split() for _, t in rows]
    grams = lambda w, n: [tuple(w[i:i + n]) for i in range(len(w) - n + 1)]
    total = {n: Counter(g for w in docs for g in grams(w, n)) for n in (1, 2, 3)}
    size = sum(map(len, docs))
    out = []
    for (i, _), w in zip(rows, docs, strict=True):
        c = {n: Counter(total[n]) for n in (1, 2, 3)}
        for n in (1, 2, 3):
            c[n].subtract(grams(w, n))
        kinds, score = [0, 0, 0, 0], 0.0
        for p in range(len(w)):
            back, n = 0, min(p, 2) + 1
            while n and not c[n][tuple(w[p - n + 1:p + 1])]:
                back, n = back + 1, n - 1
            ctx = size if n <= 1 else c[n - 1][tuple(w[p - n + 1:p])]
            score += back * math.log(.4) + math.log(c[n][tuple(w[p - n + 1:p + 1])] / ctx if n else 1 / size)
            kinds[3 - n if n else 3] += 1
        out.append((i, len(w), *kinds, round(score, 6)))
    return sorted(out, key=str)


@pytest.mark.parametrize("block_bytes,per_table", [(300, 100), (4 << 20, 8_000_000)])
def test_lm_same_as_literal(spark, nasty, block_bytes, per_table):
    rows = [(r.doc_id, r.text) for r in nasty.collect()] + [(100 + i, "the cat sat on the mat " * (i % 4) + f"and {i}") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [(r.doc_id, r.n_words, r.n_trigram, r.n_bigram, r.n_unigram, r.n_unseen, round(r.log_score, 6))
           for r in lm_score.lm_scores(df, block_bytes=block_bytes, grams_per_table=per_table).collect()]
    for a, b in zip(sorted(got, key=str), _literal_scores(rows), strict=True):
        assert a[:6] == b[:6] and math.isclose(a[6], b[6], rel_tol=1e-9, abs_tol=2e-6)


def test_lm_empty(no_docs):
    assert lm_score.lm_scores(no_docs).count() == 0


@pytest.mark.parametrize("one_id", [None, 7])
def test_rows_of_one_id_are_in_many_blocks(spark, monkeypatch, one_id):
    """Token ids and language-model scores: the rows of one id don't meet in one task."""
    packed, pack = [], blocks.pack_blocks
    monkeypatch.setattr(blocks, "pack_blocks", lambda *a, **k: packed.append(pack(*a, **k)) or packed[-1])
    rows = [(one_id, f"text {i} of one id with words {i % 3} {i % 5}") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((r.n_words, round(r.log_score, 4)) for r in lm_score.lm_scores(df, block_bytes=200).collect())
    byte_bpe.encode(df, T.tokenizer("byte_bpe_50k.tiktoken"), T.pretoken_pattern(), block_bytes=200)
    assert len(packed) == 2 and all(p.select("block").distinct().count() > 5 for p in packed)
    unique = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], df.schema)
    assert got == sorted((r.n_words, round(r.log_score, 4)) for r in lm_score.lm_scores(unique).collect())
