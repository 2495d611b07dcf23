"""Conversation repair against a literal search over all edit sequences."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

from phrasemill.llm import conversations as C
from phrasemill.llm import queries as Q
from phrasemill.llm import tables as T

BLANK = " \t\n\x0b\x0c\r"


def _damage(rows):
    out = {}
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        mine = out.setdefault(conv, [])
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        mine += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def _cheapest(rows, faults):
    """Least (cost, audit) by Dijkstra over (row, state): no vectors, no chunks."""
    turn = {0: ("u", 2), 1: ("u", 2), 3: ("u", 2), 2: ("a", 3)}
    legal = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
    heap, done = [(0, "", 0, 0, ())], set()
    while heap:
        cost, audit, i, s, out = heapq.heappop(heap)
        if i == len(rows) and s in (0, 3):
            return cost, audit, list(out)
        if (i, s) in done:
            continue
        done.add((i, s))
        who = {"u": "user", "a": "assistant"}[turn[s][0]]
        heapq.heappush(heap, (cost + 3, audit + "I", i, turn[s][1], (*out, f"{who}:")))
        if i < len(rows):
            _, role, text = rows[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, s, out))
            if faults[i] not in ("blank", "duplicate"):
                late = 3 if faults[i] else 0
                heapq.heappush(heap, (cost + 3 + late, audit + "R", i + 1, turn[s][1], (*out, f"{who}:{text}")))
                to = legal.get((s, role[:1]))
                if to is not None:
                    heapq.heappush(heap, (cost + late, audit + "K", i + 1, to, (*out, f"{role}:{text}")))


def _literal(rows):
    out = []
    for conv, mine in _damage(rows).items():
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0))
        seen, faults = set(), []
        for _, role, text in mine:
            bare = text.strip(BLANK)
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None)
            seen.add((role, text))
        turns = [t for t, _, _ in mine if t is not None]
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:], strict=False))
        cost, audit, kept = _cheapest(mine, faults)
        out.append((conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count("blank"), faults.count("duplicate"),
                    faults.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def _got(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


def _random_rows(seed, convs, longest):
    r = random.Random(seed)
    rows = []
    for c in range(convs):
        turns = r.sample(range(-2, 3 * longest), r.randint(1, longest))
        for t in turns:
            role = r.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "User"])
            rows.append((c, t, role, r.choice(["Yes.", "Go on!", "no end", "", " \t", "Why? ", None, f"text {r.randint(0, 9)}."])))
    return rows


def _frame(spark, rows, parts=3):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(parts)


def _run(spark, rows, **how):
    return C.repair(C.damaged(_frame(spark, rows)), gone=C.F.col("gone"), **how)


def test_table(spark, sf_dir):
    rows = [tuple(r) for r in T.read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").collect()]
    out = Q.op13_conversation_repair(spark, sf_dir)
    assert _got(out) == _literal(rows)


@pytest.mark.parametrize("partitions,chunk_rows", [(1, 4096), (7, 3), (5, 1)])
def test_random(spark, partitions, chunk_rows):
    """Whatever the chunks, results are those of one pass; long conversations take fix-up passes."""
    rows = _random_rows(partitions, 40, 9) + [(1000 + c, t, role, text) for c in range(2) for _, t, role, text in
                                              [(0, i, ["user", "assistant", "system"][i * 7 % 3], f"row {i % 11}{'.' * (i % 2)}") for i in range(70)]]
    out = _run(spark, rows, partitions=partitions, chunk_rows=chunk_rows)
    assert _got(out.conversations) == _literal(rows)
    pieces = {}
    for r in out.pieces.orderBy("conv_id", "no").collect():
        pieces.setdefault(r.conv_id, []).append(r)
    for conv, *_, audit, sha in _got(out.conversations):
        assert "".join(p.audit for p in pieces[conv]) == audit
        assert hashlib.sha256("\n".join(p.repaired for p in pieces[conv] if p.repaired).encode()).hexdigest() == sha
    assert out.passes <= 70 and (chunk_rows > 100 or out.passes > 0)


def test_odd_rows(spark):
    rows = [(None, 1, "user", "Hi."), (None, None, "assistant", "Null turn."), (1, None, None, None), (1, None, "user", "a."),
            (2, 2**62, "user", "far."), (2, -5, "assistant", "x" * 100_000 + "."), (3, 1, "", ""), (4, 7, "user", "日本。"), (4, 8, "assistant", "😀!")]
    assert _got(_run(spark, rows).conversations) == _literal(rows)
    extra = _frame(spark, rows).withColumn("k", C.F.lit(1)).withColumn("part", C.F.lit("p")).withColumn("codes", C.F.lit(2))
    assert _got(C.repair(C.damaged(extra), gone=C.F.col("gone")).conversations) == _literal(rows)
    none = _frame(spark, [])
    assert C.repair(none).conversations.count() == 0


def test_all_rows_dropped(spark):
    conv = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    got = _got(_run(spark, [(conv, 0, "user", "Hi.")]).conversations)
    assert got == [(conv, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_one_conversation_holds_most_rows(spark):
    """A hot conversation, with a row that repeats throughout, is spread over partitions and chunks."""
    rows = [(1, i, ("user", "assistant")[i % 2], "same." if i % 3 == 0 else f"row {i}.") for i in range(600)] + [(2, 0, "user", "x.")]
    out = _run(spark, rows, partitions=6, chunk_rows=40)
    assert _got(out.conversations) == _literal(rows)
    assert out.pieces.filter("conv_id = 1").count() >= 12


def test_copies_of_one_row(spark):
    """Copies of one row (also of its turn) may lie in several partitions."""
    df = _frame(spark, [(1, 1, "user", "Hi.")] * 50 + [(1, 2, "assistant", "Yes.")] * 30)
    r = C.repair(df, partitions=8, chunk_rows=4).conversations.first()
    assert (r.duplicate, r.audit, r.cost, r.gaps, r.illegal) == (78, "K" + "D" * 49 + "K" + "D" * 29, 78 * 4, 0, 78)


def test_rerun_stops_where_runs_meet():
    codes = bytes([1, 2] * 500)
    old, old_lows = C.backward(codes, (0, 0, 0, 0))
    left, total, rerun = C.backward_again(codes, (0, 0, 0, 0), C._END, old[0], sum(old_lows))
    vectors, lows = C.backward(codes, C._END)
    assert (left, total) == (vectors[0], sum(lows)) and rerun < 10
