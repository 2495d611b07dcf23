"""SimHash, cover trees, components and Lempel-Ziv fingerprints against literal versions."""

import hashlib
import math
import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from phrasemill.llm import cover_tree as C
from phrasemill.llm import lz_fingerprint as Z
from phrasemill.llm import simhash as S
from phrasemill.llm import tables as T
from phrasemill.llm.links import Forest, components


def _literal_components(nodes, links):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("links", [[], [(1, 1)], [(1, 2), (2, 1), (1, 2)], [(i, i + 1) for i in range(40)],
                                   [(0, i) for i in range(1, 60)], [(50, i) for i in range(50)]])
def test_components(spark, links):
    df = spark.createDataFrame(links, "a long, b long")
    got = {r.node: r.component for r in components(df, "a", "b").collect()}
    want = _literal_components({x for ab in links for x in ab}, links)
    assert got == {n: c for n, c in want.items() if any(n in ab and ab[0] != ab[1] for ab in links)}


def test_components_random(spark):
    rnd = random.Random(2)
    links = [(rnd.randint(0, 300), rnd.randint(0, 300)) for _ in range(220)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    want = _literal_components(range(301), links)
    assert all(got.get(n, n) == c for n, c in want.items())
    f = Forest(301)
    f.add(np.array([a for a, _ in links]), np.array([b for _, b in links]))
    assert f.root.tolist() == [want[n] for n in range(301)]


def _literal_simhash(text, n=4):
    w = (text or "").encode().lower().split()
    grams = [b" ".join(w[i:i + n]) for i in range(max(1, len(w) - n + 1))] if w else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def _literal_near(rows, bits):
    fp = [_literal_simhash(t) for _, t in rows]
    links = [(i, j) for i in range(len(fp)) for j in range(i) if (fp[i] ^ fp[j]).bit_count() <= bits]
    comp, least = _literal_components(range(len(fp)), links), defaultdict(list)
    for i, c in comp.items():
        least[c].append(rows[i][0])
    name = {c: min((x for x in ids if x is not None), default=None) for c, ids in least.items()}
    return sorted(((rows[i][0], f"{fp[i]:016x}", name[comp[i]]) for i in range(len(fp))), key=str)


def _near(df, **how):
    return sorted(((r.doc_id, f"{r.fp % 2**64:016x}", r.component_id) for r in S.simhash_near_dedup(df, **how).collect()), key=str)


def test_simhash_odd_rows(nasty):
    rows = [(r.doc_id, r.text) for r in nasty.collect()]
    assert _near(nasty) == _literal_near(rows, 4)
    assert _near(nasty, bits=20, shard_rows=2, sample=8) == _literal_near(rows, 20)


@pytest.mark.parametrize("shard_rows,bits", [(10, 4), (50, 9), (10_000, 4)])
def test_simhash_near_copies(spark, shard_rows, bits):
    rnd = random.Random(4)
    rows = []
    for i in range(220):
        if rows and rnd.random() < .5:
            w = rnd.choice(rows)[1].split()
            w[rnd.randrange(len(w))] = f"edit{i}"
            rows.append((i, " ".join(w)))
        else:
            rows.append((i, " ".join(rnd.choice("abcdefghijklmnop") * 2 for _ in range(rnd.randint(30, 200)))))
    rows += [(500 + i, rows[3][1]) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert _near(df, shard_rows=shard_rows, bits=bits, sample=60) == _literal_near(rows, bits)


def test_simhash_empty(no_docs):
    assert S.simhash_near_dedup(no_docs).count() == 0


def test_keep_one(spark, nasty):
    rows = [(1, "a b c d e f"), (2, "a b c d e f"), (2, "a b c d e f"), (9, "a b c d e f"), (9, "other words are here now"),
            (9, "other words are here now"), (None, ""), (None, None), (7, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(((r.doc_id, r.text) for r in S.keep_one(df).collect()), key=str)
    assert kept == [(1, "a b c d e f"), (7, ""), (9, "other words are here now")]
    out = S.keep_one(nasty)
    assert out.columns == nasty.columns
    assert out.count() == len({c for _, _, c in _literal_near([(r.doc_id, r.text) for r in nasty.collect()], 4)})


# ---------------------------------------------------------------- cover trees
def _vectors(seed, n, dim=8):
    rng = np.random.default_rng(seed)
    rows, x = [], []
    for i in range(n):
        v = x[rng.integers(len(x))] + rng.normal(0, rng.choice([0, .01, .05, .1]), dim) if x and rng.random() < .6 else rng.normal(size=dim)
        x.append(v)
        rows.append((int(i), [float(a) for a in v * rng.uniform(.5, 2)], int(rng.integers(3))))
    return rows


def _literal_links(rows, cosine):
    ok = [v is not None and lab is not None and len(v) > 0 and all(a is not None and math.isfinite(a) for a in v) and any(v)
          for _, v, lab in rows]
    unit = [np.array(v, float) / np.linalg.norm(v) if o else None for (_, v, _), o in zip(rows, ok, strict=True)]
    links = [(i, j) for i in range(len(rows)) if ok[i] for j in range(i) if ok[j] and rows[i][2] == rows[j][2]
             and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= cosine]
    comp, least, n = _literal_components(range(len(rows)), links), defaultdict(list), defaultdict(int)
    for a, b in links:
        n[a] += 1
        n[b] += 1
    for i, c in comp.items():
        least[c].append(rows[i][0])
    name = {c: min((x for x in ids if x is not None), default=None) for c, ids in least.items()}
    return sorted(((r[0], n[i], name[comp[i]], r[0] is not None and r[0] == name[comp[i]]) for i, r in enumerate(rows)), key=str)


def _links(spark, rows, **how):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    return sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in C.near_duplicates(df, **how).collect()), key=str)


@pytest.mark.parametrize("seed,shard_rows,cosine", [(1, 20, .98), (2, 7, .9), (3, 4096, .98)])
def test_cover_tree(spark, seed, shard_rows, cosine):
    rows = _vectors(seed, 250)
    assert _links(spark, rows, shard_rows=shard_rows, sample=30, cosine=cosine) == _literal_links(rows, cosine)


def test_cover_tree_odd_vectors(spark):
    v, nan, inf = [1.0, 2.0, 3.0], float("nan"), float("inf")
    rows = [(1, v, 0), (2, v, 0), (3, [2.0, 4.0, 6.0], 0), (4, v, 1), (5, v, None), (6, None, 0), (7, [0.0, 0.0, 0.0], 0), (8, [], 0),
            (9, [1.0, nan, 3.0], 0), (10, [1.0, inf, 3.0], 0), (11, [1.0, None, 3.0], 0), (12, [1.0, 2.0], 0), (13, [-1.0, -2.0, -3.0], 0),
            (None, v, 0), (None, [0.0, 1.0, 0.0], 0), (2, v, 0), (2, [9.0, 1.0, 1.0], 0), (14, [0.0, 1.0, 0.0], 2), (15, [-0.0, 1.0, -0.0], 2)]
    assert _links(spark, rows) == _literal_links(rows, .98)


def test_cover_tree_dense_group_and_pairs(spark):
    """A hot vector and a dense cloud: counted whole, one link per vector and shard pair."""
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in np.r_[1, rng.normal(0, 1e-3, 5)]], 0) for i in range(300)] + [(300 + i, [1.0, *[0.0] * 5], 0) for i in range(100)]
    assert _links(spark, rows, shard_rows=64, sample=16) == _literal_links(rows, .98)
    df = spark.createDataFrame(_vectors(1, 120), "vec_id long, embedding array<double>, label int")
    got = {(r.vec_id_a, r.vec_id_b) for r in C.threshold_pairs(df, shard_rows=16, sample=16).collect()}
    _, d = C.distinct_vectors(df, "vec_id", "embedding", "label")
    reps = d.collect()
    x = {r.least_id: (np.array(r.v) / np.linalg.norm(r.v), r.label) for r in reps}
    want = {(a, b) for a in x for b in x if a < b and x[a][1] == x[b][1] and x[a][0] @ x[b][0] >= .98}
    assert got == want


def test_cover_tree_levels_halve_and_cover():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 5))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    tree = C.grow(x, np.arange(500), 0, np.linalg.norm(x - x[0], axis=1))

    def walk(node):
        far = np.linalg.norm(x[node.points] - x[node.center], axis=1)
        assert math.isclose(far.max(), node.radius, abs_tol=1e-6)
        if node.children:
            assert sorted(np.concatenate([c.points for c in node.children])) == sorted(node.points)
            assert node.children[0].center == node.center                  # nested
            assert all(c.radius < node.radius for c in node.children)
            for c in node.children:
                walk(c)

    walk(tree)


def test_cover_tree_empty(spark):
    assert _links(spark, []) == []


# ---------------------------------------------------------------- Lempel-Ziv
def _check_neighbours(rows, got):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""), reverse=True)
    want = []
    for (i, t), (_, n) in zip(order, order[1:] + order[:1], strict=True):
        e = Z.edited(t or "", n or "")
        fp = [Z.signature(Z.Phrases()(x or "")) for x in (t, e, n)]
        want.append((i, len(t or ""), hashlib.sha256(e.encode()).hexdigest(), fp[0].hex(), fp[1].hex(),
                     Z.likeness(fp[0], fp[1]), Z.likeness(fp[0], fp[2])))
    assert sorted(got, key=str) == sorted(want, key=str)


@pytest.mark.parametrize("block_bytes", [200, 4 << 20])
def test_lz_neighbours(nasty, block_bytes):
    rows = [(r.doc_id, r.text) for r in nasty.collect()]
    _check_neighbours(rows, [tuple(r) for r in Z.compare_neighbours(nasty, block_bytes=block_bytes).collect()])


@pytest.mark.parametrize("ids, size", [([1, 2], 5000), ([1] * 40 + list(range(2, 62)), 100), ([7] * 9, 100)])
def test_lz_first_range_is_not_empty(spark, ids, size):
    """The first quantile may be the smallest id: texts longer than a block, or many rows of the smallest id."""
    rows = [(i, f"{n} words {n * n} of text {n % 7} " * (size // 20)) for n, i in enumerate(ids)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    total = sum(len(t) for _, t in rows)
    _check_neighbours(rows, [tuple(r) for r in Z.compare_neighbours(docs, block_bytes=total // 5 + 1).collect()])


def test_lz_table(spark, sf_dir):
    docs = T.read(spark, sf_dir, "documents")
    got = Z.compare_neighbours(docs.repartition(5), block_bytes=50_000).collect()
    _check_neighbours([(r.doc_id, r.text) for r in docs.collect()], [tuple(r) for r in got])
    edited, other = np.median([r.near_edited for r in got]), np.median([r.near_next for r in got])
    assert edited > 0.4 and other < 0.15


def test_lz_one_row_and_empty(spark, no_docs):
    one = spark.createDataFrame([(3, "only one text here")], "doc_id long, text string")
    assert Z.compare_neighbours(one).first().near_next == 1
    assert Z.compare_neighbours(no_docs).count() == 0
    assert Z.fingerprints(no_docs).count() == 0


def test_lz_signature_estimates_jaccard():
    rng = random.Random(1)
    a, b = {rng.getrandbits(64) for _ in range(900)}, {rng.getrandbits(64) for _ in range(300)}
    c = set(list(a)[:600]) | b
    want = len(a & c) / len(a | c)
    assert abs(Z.likeness(Z.signature(a), Z.signature(c)) - want) < .15
    assert Z.likeness(b"", b"") == 1 and Z.likeness(b"", Z.signature(a)) == 0


def test_slack_is_above_rounding_errors():
    x = np.random.default_rng(3).normal(size=(2000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    assert np.sqrt(np.abs(2 - 2 * (x * x).sum(axis=1))).max() < C.SLACK


def _literal_fingerprint(text):
    """LZ78 with a dictionary of symbol tuples; bins and minima by plain numbers."""
    import regex
    mask, known, phrase = 2**64 - 1, {}, ()
    for s in regex.findall(r"\w{1,12}|[^\w\s]", text or ""):
        phrase += (s,)
        if phrase not in known:
            known[phrase] = True
            phrase = ()
    bins = {}
    for p in known:
        h = 0
        for s in p:
            h = (h * 0x9E3779B97F4A7C15 + int.from_bytes(hashlib.blake2b(s.encode(), digest_size=8).digest(), "little")) & mask
        h = _literal_mix(h)
        bins[h >> 57] = min(h << 7 & mask, bins.get(h >> 57, mask))
    out = []
    for i in range(128) if bins else ():
        far = next(d for d in range(128) if (i + d) % 128 in bins)
        v = bins[(i + far) % 128]
        if len(bins) < 128:
            v = (v + far * 0x9E3779B97F4A7C15) & mask
        out.append(_literal_mix(v) >> 56)
    return bytes(out)


def _literal_mix(h):
    mask = 2**64 - 1
    h ^= h >> 33
    h = h * 0xFF51AFD7ED558CCD & mask
    h ^= h >> 33
    h = h * 0xC4CEB9FE1A85EC53 & mask
    return h ^ h >> 33


@pytest.mark.parametrize("block_bytes", [500, 4 << 20])
def test_lz_same_as_literal(spark, nasty, block_bytes):
    """Fingerprints and likenesses of every row, of its edited text and of its neighbour."""
    rnd = random.Random(4)
    rows = [(r.doc_id, r.text) for r in nasty.collect()] + [
        (200 + i, " ".join(rnd.choice(["ab", "abc", "d", "naïve", "日本", "x,y", "...", "q" * 30]) for _ in range(rnd.randint(0, 150)))) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    want = []
    for i, (doc, text) in enumerate(order):
        text, following = text or "", order[i - 1][1] or ""
        n = len(text) // 3
        other = text[:len(text) - n] + following[:n]
        a, b, c = map(_literal_fingerprint, (text, other, following))

        def like(x, y):
            same = sum(p == q for p, q in zip(x, y, strict=False)) / 128
            return float(x == y) if not x or not y else round(max(0.0, (same - 1 / 256) / (1 - 1 / 256)), 6)

        want.append((doc, len(text), hashlib.sha256(other.encode()).hexdigest(), a.hex(), b.hex(), like(a, b), like(a, c)))
    got = [tuple(r) for r in Z.compare_neighbours(df, block_bytes=block_bytes).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
