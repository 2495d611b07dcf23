"""Conversation structure repair (operator 13): rank-convergence parallel Viterbi.

A conversation's rows, in order of turn, become a legal one by the cheapest
edits: Keep 0, Rerole to user or assistant 3, Delete 4 (blank and duplicate
rows must go), Insert an empty user or assistant row 3, and 3 more for a
truncated row that stays.  The kept role initials must read `(s?(ua)+)?`.  The
automaton has four states (0 nothing yet, 1 after s, 2 after u, 3 after a), so
the cost of finishing from a row on is a vector of four numbers.

1. Rows are range-partitioned by (conversation, turn), so a conversation of any
   size is spread over tasks.  A task cuts conversations into chunks; those that
   lie whole in one chunk inside a partition are repaired there and then.
2. Chunks of the others run backwards from speculative cost vectors (only the
   last chunk knows its own).  A vector counts up to a constant, so two runs
   are the same from the row on where their vectors differ by a constant.
3. Fix-up passes: a chunk whose assumed vector differs from the one that its
   right neighbour found runs again, until it meets its old run; passes go on
   until no chunk's assumption changes.
4. The constants along a conversation add up to its cost.  Each chunk's trace
   maps entry states to exit states; these maps, one short row a chunk, give
   every chunk its entry state, and the chunks write their part of the audit.

The audit is the least string of edit initials (D < I < K < R) among the
cheapest: in every state each letter leads to one state, so the trace takes
the least letter that the costs allow.

Results: a null turn sorts first, a null role or text reads as one space; rows
of one turn are ordered by role and the text's hash, so equal rows are
neighbours.  A null id is a conversation of its own.  A conversation without
rows has zeros, an empty audit and no rows.  The first fault of a row counts:
blank, duplicate (role and text seen earlier), truncated.  An empty table has
no conversations; other columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phrasemill.llm import blocks as B
from phrasemill.llm import tables as T

PARTITION_BYTES = 32 << 20
CHUNK_ROWS, CHUNK_BYTES = 4096, 4 << 20
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
_USER, _ASSISTANT = "user", "assistant"
_TURN = (2, 2, 3, 2)                 # state after a user or assistant row that belongs there
_END = (0, 2 * INSERT, INSERT, 0)    # cost of finishing after the last row
_LEGAL = {"su", "ua", "au"}
_CLASS = {"s": 0, "u": 1, "a": 2}    # 3: any other initial; +4 truncated; +8 must go
_COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


# ---------------------------------------------------------------- one row
def _after(state: int, code: int) -> int | None:
    """State after keeping a row, if it may stand there."""
    cls = code & 3
    if cls == 0:
        return 1 if state == 0 else None
    if cls == 1:
        return 2 if state != 2 else None
    return 3 if cls == 2 and state == 2 else None


def _options(state: int, code: int) -> list[tuple[str, int, int]]:
    """(letter, cost, next state) of a row's edits, letters ascending."""
    out = [("D", DELETE, state)]
    if code < 8:
        late = TRUNCATED if code & 4 else 0
        kept = _after(state, code)
        if kept is not None:
            out.append(("K", KEEP + late, kept))
        out.append(("R", REROLE + late, _TURN[state]))
    return out


_steps: dict = {}
_moves: dict = {}


def _step(code: int, right: tuple) -> tuple[tuple, int]:
    """Cost vector before a row from that behind it, less its smallest cost, and that cost."""
    got = _steps.get((code, right))
    if got is None:
        v = [min(c + right[s] for _, c, s in _options(state, code)) for state in range(4)]
        for _ in range(2):          # inserting pays twice at most
            v = [min(v[s], INSERT + v[_TURN[s]]) for s in range(4)]
        low = min(v)
        got = _steps[code, right] = (tuple(x - low for x in v), low)
    return got


def _move(code: int, right: tuple, state: int) -> tuple[str, int]:
    """Letters from before a row to behind it, and the state there."""
    got = _moves.get((code, right, state))
    if got is None:
        left, low = _step(code, right)
        at, letters = state, ""
        while True:
            options = [("I", INSERT + left[_TURN[at]] + low, None)]
            options += [(x, c + right[s], s) for x, c, s in _options(at, code)]
            letter, _, to = min(o for o in options if o[1] == left[at] + low)
            letters += letter
            if to is not None:
                break
            at = _TURN[at]
        got = _moves[code, right, state] = (letters, to)
    return got


# ---------------------------------------------------------------- one chunk
def backward(codes: bytes, right: tuple) -> tuple[list[tuple], list[int]]:
    """Vectors behind each row (and before the first, last in the list reversed), and each row's constant."""
    vectors, lows = [right], []
    for c in reversed(codes):
        right, low = _step(c, right)
        vectors.append(right)
        lows.append(low)
    return vectors[::-1], lows[::-1]


def backward_again(codes: bytes, old: tuple, new: tuple, left: tuple, total: int) -> tuple[tuple, int, int]:
    """Left vector and sum of constants when the right vector turns from `old` to `new`; left and total are those of
    the old run, which counts from the row on where both are the same.  Third: rows rerun."""
    i = len(codes)
    while i and old != new:
        i -= 1
        old, before = _step(codes[i], old)
        new, now = _step(codes[i], new)
        total += now - before
    return left if old == new else new, total, len(codes) - i


def trace(codes: bytes, vectors: list[tuple], state: int, last: bool) -> tuple[str, int]:
    letters = []
    for c, v in zip(codes, vectors[1:], strict=True):
        some, state = _move(c, v, state)
        letters.append(some)
    if last:
        letters.append({1: "II", 2: "I"}.get(state, ""))
    return "".join(letters), state


def rewrite(audit: str, state: int, roles: list[str], texts: list[str], codes: bytes) -> list[str]:
    """Repaired `role:text` rows of a chunk that starts in `state`."""
    out, row = [], 0
    for letter in audit:
        if letter in "IR":
            role = _ASSISTANT if state == 2 else _USER
            out.append(f"{role}:{texts[row]}" if letter == "R" else f"{role}:")
            state = _TURN[state]
        elif letter == "K":
            out.append(f"{roles[row]}:{texts[row]}")
            state = _after(state, codes[row])
        row += letter != "I"
    return out


class _Rows:
    """Rows of one conversation that a task holds at a time."""

    def __init__(self, conv_id: int | None, first: bool):
        self.id, self.open, self.seq = conv_id, first, 0
        self.clear()

    def clear(self) -> None:
        self.turns, self.roles, self.texts, self.flags, self.size = [], [], [], [], 0

    def add(self, turn, role: str, text: str, blank: bool, truncated: bool) -> None:
        self.turns.append(turn)
        self.roles.append(role)
        self.texts.append(text)
        self.flags.append((blank, truncated))
        self.size += len(text)

    def stats(self) -> dict:
        turns = [t for t in self.turns if t is not None]
        first = [r[:1] for r in self.roles]
        return {"rows": len(first), "low_turn": turns[0] if turns else None, "high_turn": turns[-1] if turns else None,
                "turns": len(set(turns)), "first_role": first[0] if first else None, "last_role": first[-1] if first else None,
                "illegal": sum(a + b not in _LEGAL for a, b in zip(first, first[1:], strict=False))}


def _codes(roles: list[str], flags: list[tuple], seen_before: list[bool]) -> tuple[bytes, dict]:
    out = bytearray()
    n = {"blank": 0, "duplicate": 0, "truncated": 0}
    for role, (blank, truncated), dup in zip(roles, flags, seen_before, strict=True):
        fault = "blank" if blank else "duplicate" if dup else "truncated" if truncated else None
        if fault:
            n[fault] += 1
        out.append(_CLASS.get(role[:1], 3) + (8 if fault in ("blank", "duplicate") else 4 if fault else 0))
    return bytes(out), n


def _repeated(keys: list) -> list[bool]:
    seen, out = set(), []
    for k in keys:
        out.append(k in seen)
        seen.add(k)
    return out


def _gaps(low: int | None, high: int | None, turns: int) -> int:
    return min(high - low + 1 - turns, (1 << 63) - 1) if turns else 0


def _digest(role: str, text: str) -> bytes:
    return hashlib.blake2b(f"{len(role)}:{role}{text}".encode("utf-8", "surrogatepass"), digest_size=16).digest()


_STATS = [("rows", pa.int64()), ("low_turn", pa.int64()), ("high_turn", pa.int64()), ("turns", pa.int64()),
          ("first_role", pa.string()), ("last_role", pa.string()), ("illegal", pa.int64())]
_PACKED = pa.schema([("whole", pa.bool_()), ("conv_id", pa.int64()), ("part", pa.int32()), ("seq", pa.int32()), *_STATS,
                     ("gaps", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()),
                     ("cost", pa.int64()), ("audit", pa.string()), ("repaired", pa.string()),
                     ("flags", pa.binary()), ("digests", pa.binary()), ("data", pa.binary())])
_SQL = {pa.bool_(): "boolean", pa.int32(): "int", pa.int64(): "long", pa.string(): "string", pa.binary(): "binary"}


def _ddl(schema) -> str:
    return ", ".join(f"{f.name} {_SQL[f.type]}" for f in schema)


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], f.type) for f in schema], schema=schema)


def _rows_of(data: bytes) -> tuple[list[str], list[str]]:
    t = pa.ipc.open_stream(B.unsqueeze(data)).read_all()
    return t.column("role").to_pylist(), t.column("text").to_pylist()


def _pack(chunk_rows: int, chunk_bytes: int):
    def whole(c: _Rows) -> dict:
        codes, n = _codes(c.roles, c.flags, _repeated(list(zip(c.roles, c.texts, strict=True))))
        vectors, lows = backward(codes, _END)
        audit, _ = trace(codes, vectors, 0, True)
        s = c.stats()
        return {"whole": True, "conv_id": c.id, **s, **n, "gaps": _gaps(s["low_turn"], s["high_turn"], s["turns"]),
                "cost": vectors[0][0] + sum(lows), "audit": audit,
                "repaired": "\n".join(rewrite(audit, 0, c.roles, c.texts, codes))}

    def chunk(c: _Rows, part: int) -> dict:
        sink = pa.BufferOutputStream()
        own = pa.RecordBatch.from_arrays([pa.array(c.roles, pa.string()), pa.array(c.texts, pa.string())], names=["role", "text"])
        with pa.ipc.new_stream(sink, own.schema) as w:
            w.write_batch(own)
        out = {"whole": False, "conv_id": c.id, "part": part, "seq": c.seq, **c.stats(),
               "flags": bytes(blank + 2 * cut for blank, cut in c.flags),
               "digests": b"".join(map(_digest, c.roles, c.texts)), "data": B.squeeze_text(sink.getvalue().to_pybytes())}
        c.seq += 1
        c.clear()
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, now, out, size = TaskContext.get().partitionId(), None, [], 0
        for b in batches:
            for conv_id, turn, role, text, gone, blank, cut in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if now is None or conv_id != now.id:
                    if now is not None:
                        size += now.size
                        out.append(chunk(now, part) if now.open else whole(now))
                    now = _Rows(conv_id, now is None)
                if not gone:
                    if len(now.roles) >= chunk_rows or now.size + len(text) > chunk_bytes and now.roles:
                        now.open = True
                        size += now.size
                        out.append(chunk(now, part))
                    now.add(turn, role, text, blank, cut)
                if len(out) >= 1000 or size > chunk_bytes:
                    yield _batch(out, _PACKED)
                    out, size = [], 0
        if now is not None:
            out.append(chunk(now, part))    # the next partition may go on with it
        yield _batch(out, _PACKED)
    return run


# ---------------------------------------------------------------- conversations of several chunks
def _map(df: DataFrame, f, schema: pa.Schema) -> DataFrame:
    """f(row) -> list of rows, for chunk rows."""
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = {n: b.column(j)[i].as_py() for j, n in enumerate(names)}
                got = f(row)
                if got:
                    yield _batch(got, schema)

    return df.mapInArrow(run, _ddl(schema))


_DIGEST = pa.schema([("k", pa.string()), ("no", pa.int64()), ("digest", pa.binary())])
_CODED = pa.schema([("k", pa.string()), ("no", pa.int64()), ("codes", pa.binary()), ("blank", pa.int64()),
                    ("duplicate", pa.int64()), ("truncated", pa.int64())])
_V = [f"{side}{i}" for side in "rl" for i in range(4)]
_RUN = pa.schema([("k", pa.string()), ("no", pa.int64()), ("last", pa.bool_()), *[(v, pa.int32()) for v in _V],
                  ("total", pa.int64()), ("rerun", pa.int64())])
_ENTRY = pa.schema([("k", pa.string()), ("no", pa.int64()), ("entry", pa.int32()), ("cost", pa.int64())])
_EXITS = pa.schema([("k", pa.string()), ("no", pa.int64()), *[(f"e{i}", pa.int32()) for i in range(4)], *[(f"l{i}", pa.int32()) for i in range(4)],
                    ("total", pa.int64())])
_PIECE = pa.schema([("k", pa.string()), ("no", pa.int64()), ("audit", pa.string()), ("repaired", pa.string())])


def _split(row: dict) -> list[dict]:
    d = row["digests"]
    return [{"k": row["k"], "no": row["no"], "digest": x} for x in {d[i:i + 16] for i in range(0, len(d), 16)}]


def _code(row: dict) -> list[dict]:
    """A chunk's codes; `known`: digests that earlier chunks hold."""
    d, known = row["digests"], set(row["known"] or [])
    keys = [d[i:i + 16] for i in range(0, len(d), 16)]
    dup = [again or x in known for again, x in zip(_repeated(keys), keys, strict=True)]
    codes, n = _codes(list(row["classes"]), [(bool(f & 1), bool(f & 2)) for f in row["flags"]], dup)
    return [{"k": row["k"], "no": row["no"], "codes": codes, **n}]


def _vec(row: dict, side: str) -> tuple:
    return tuple(row[f"{side}{i}"] for i in range(4))


def _run_row(row: dict, right: tuple, left: tuple, total: int, rerun: int) -> list[dict]:
    return [{"k": row["k"], "no": row["no"], "last": row["last"], **{f"r{i}": x for i, x in enumerate(right)},
             **{f"l{i}": x for i, x in enumerate(left)}, "total": total, "rerun": rerun}]


def _speculate(row: dict) -> list[dict]:
    right = _END if row["last"] else (0, 0, 0, 0)
    vectors, lows = backward(row["codes"], right)
    return _run_row(row, right, vectors[0], sum(lows), len(lows))


def _fix(row: dict) -> list[dict]:
    new = _vec(row, "n")
    left, total, rerun = backward_again(row["codes"], _vec(row, "r"), new, _vec(row, "l"), row["total"])
    return _run_row(row, new, left, total, rerun)


def _exits(row: dict) -> list[dict]:
    vectors, _ = backward(row["codes"], _vec(row, "r"))
    return [{"k": row["k"], "no": row["no"], "total": row["total"], **{f"l{i}": x for i, x in enumerate(vectors[0])},
             **{f"e{s}": trace(row["codes"], vectors, s, False)[1] for s in range(4)}}]


def _entries(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
    """Entry state of each chunk of a conversation, one short row a chunk; its cost on the first."""
    rows = t.sort_by("no").to_pylist()
    state, out = 0, []
    for r in rows:
        out.append({"k": r["k"], "no": r["no"], "entry": state, "cost": None})
        state = r[f"e{state}"]
    out[0]["cost"] = rows[0]["l0"] + sum(r["total"] for r in rows)
    return pa.Table.from_batches([_batch(out, _ENTRY)])


def _write(row: dict) -> list[dict]:
    codes = row["codes"]
    vectors, _ = backward(codes, _vec(row, "r"))
    audit, _ = trace(codes, vectors, row["entry"], row["last"])
    roles, texts = _rows_of(row["data"])
    return [{"k": row["k"], "no": row["no"], "audit": audit,
             "repaired": "\n".join(rewrite(audit, row["entry"], roles, texts, codes))}]


_TOTAL = pa.schema([("conv_id", pa.int64()), *[(c, pa.int64()) for c in _COUNTS], ("audit", pa.string()), ("repaired_sha256", pa.string())])


def _sum_up(names: list[str]):
    """Streams pieces in (k, no) order; a conversation's texts are hashed as they pass."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for b in batches:
            done = []
            for i in range(b.num_rows):
                r = {n: b.column(j)[i].as_py() for j, n in enumerate(names)}
                if now is None or now["k"] != r["k"]:
                    if now is not None:
                        done.append(end(now))
                    now = {"k": r["k"], "conv_id": r["conv_id"], **dict.fromkeys(_COUNTS, 0), "low": None, "high": None, "turns": 0,
                           "role": None, "audit": [], "hash": hashlib.sha256(), "any": False}
                for c in ("blank", "duplicate", "truncated", "illegal"):
                    now[c] += r[c]
                now["cost"] += r["cost"] or 0
                if r["rows"]:
                    now["illegal"] += now["role"] is not None and now["role"] + r["first_role"] not in _LEGAL
                    now["role"] = r["last_role"]
                if r["turns"]:
                    now["turns"] += r["turns"] - (now["high"] == r["low_turn"])
                    now["low"] = r["low_turn"] if now["low"] is None else now["low"]
                    now["high"] = r["high_turn"]
                now["audit"].append(r["audit"])
                if r["repaired"]:
                    now["hash"].update(("\n" * now["any"] + r["repaired"]).encode("utf-8", "surrogatepass"))
                    now["any"] = True
            if done:
                yield _batch(done, _TOTAL)
        if now is not None:
            yield _batch([end(now)], _TOTAL)

    def end(c: dict) -> dict:
        return {**c, "gaps": _gaps(c["low"], c["high"], c["turns"]), "audit": "".join(c["audit"]), "repaired_sha256": c["hash"].hexdigest()}
    return run


def _long(packed: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """(totals, pieces, passes) of the conversations that lie in several chunks or at a partition's edge."""
    key = F.coalesce(F.col("conv_id").cast("string"), F.lit("null"))
    chunks = packed.filter(~F.col("whole")).withColumn("k", key)
    order = Window.partitionBy("k").orderBy("part", "seq")
    number = T.write_shared(chunks.select("k", "part", "seq").withColumn("no", F.row_number().over(order).cast("long"))
                            .withColumn("last", F.lead("no").over(order).isNull()), "chunk-numbers")
    chunks = T.write_shared(chunks.join(number, ["k", "part", "seq"]), "chunks")
    # rows that an earlier chunk of the conversation holds
    held = _map(chunks.join(number.filter("no = 2").select("k"), "k", "left_semi").select("k", "no", "digests"), _split, _DIGEST)
    held = T.write_shared(held, "digests")
    first = held.groupBy("k", "digest").agg(F.min("no").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    known = held.join(first, ["k", "digest"]).filter("no > first").groupBy("k", "no").agg(F.collect_list("digest").alias("known"))
    classes = _map(chunks.select("k", "no", "data"), _initials, pa.schema([("k", pa.string()), ("no", pa.int64()), ("classes", pa.string())]))
    coded = T.write_shared(_map(chunks.select("k", "no", "flags", "digests").join(classes, ["k", "no"]).join(known, ["k", "no"], "left"),
                                _code, _CODED), "codes")
    narrow = coded.select("k", "no", "codes").join(number.select("k", "no", "last"), ["k", "no"])
    state, passes = T.write_shared(_map(narrow, _speculate, _RUN), "vectors"), 0
    while True:
        right = state.select("k", (F.col("no") - 1).alias("no"), *[F.col(f"l{i}").alias(f"n{i}") for i in range(4)])
        both = state.join(right, ["k", "no"], "left")
        stale = F.coalesce(F.concat_ws(",", *[f"n{i}" for i in range(4)]) != F.concat_ws(",", *[f"r{i}" for i in range(4)]), F.lit(False)) & ~F.col("last")
        again = both.filter(stale).drop("last", "rerun")
        if again.isEmpty():
            break
        fixed = _map(again.join(narrow.select("k", "no", "codes", "last"), ["k", "no"]), _fix, _RUN)
        state = T.write_shared(both.filter(~stale).select(*state.columns).unionByName(fixed), "vectors")
        passes += 1
    exits = _map(coded.select("k", "no", "codes").join(state, ["k", "no"]), _exits, _EXITS)
    entry = T.write_shared(exits.groupBy("k").applyInArrow(_entries, _ddl(_ENTRY)), "entries")
    pieces = T.write_shared(_map(
        chunks.select("k", "no", "last", "data").join(coded.select("k", "no", "codes"), ["k", "no"]).join(entry.select("k", "no", "entry"), ["k", "no"])
        .join(state.select("k", "no", *[f"r{i}" for i in range(4)]), ["k", "no"]), _write, _PIECE), "pieces")
    rows = (chunks.select("k", "no", "conv_id", *[n for n, _ in _STATS]).join(coded.drop("codes"), ["k", "no"])
            .join(entry.select("k", "no", "cost"), ["k", "no"]).join(pieces, ["k", "no"]))
    rows = rows.repartition("k").sortWithinPartitions("k", "no")
    totals = rows.mapInArrow(_sum_up(rows.columns), _ddl(_TOTAL))
    return totals, chunks.select("k", "no", "conv_id").join(pieces, ["k", "no"]), passes


def _initials(row: dict) -> list[dict]:
    roles, _ = _rows_of(row["data"])
    return [{"k": row["k"], "no": row["no"], "classes": "".join(r[:1] if r[:1] in _CLASS else "x" for r in roles)}]


class Repaired(NamedTuple):
    """conversations: (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256);
    pieces: (conv_id, no, audit, repaired), the repaired `role:text` lines, in one piece or in several by `no`;
    passes: fix-up passes that conversations of several chunks took."""
    conversations: DataFrame
    pieces: DataFrame
    passes: int


def repair(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
           gone: Column | None = None, partitions: int | None = None, chunk_rows: int = CHUNK_ROWS,
           chunk_bytes: int = CHUNK_BYTES) -> Repaired:
    """gone: rows that count for their conversation's being there, but not among its rows.

    Copies of one row are spread by their place in the input's partitions, which a scan or a written table keeps."""
    spark = rows.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(" "))
    src = rows.select(F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"),
                      F.coalesce(F.col(role_col).cast("string"), F.lit(" ")).alias("role"), text.alias("text"),
                      F.coalesce(gone if gone is not None else F.lit(False), F.lit(False)).alias("gone"))
    src = src.select("*", (~F.col("text").rlike(r"[^\x20\x09-\x0D]")).alias("blank"),
                     (~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")).alias("cut"),
                     F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("copy"))
    n = partitions or max(spark.sparkContext.defaultParallelism, B.block_count(src, "text", PARTITION_BYTES))
    order = ["conv_id", "turn", "role", "h", "copy"]
    dealt = src.repartitionByRange(n, *order).sortWithinPartitions(*order).drop("h", "copy")
    packed = T.write_shared(dealt.mapInArrow(_pack(chunk_rows, chunk_bytes), _ddl(_PACKED)), "conversations")
    whole = packed.filter("whole")
    totals, pieces, passes = _long(packed)
    done = whole.select("conv_id", *_COUNTS, "audit", F.sha2("repaired", 256).alias("repaired_sha256"))
    parts = whole.select("conv_id", F.lit(1).cast("long").alias("no"), "audit", "repaired")
    return Repaired(done.unionByName(totals), parts.unionByName(pieces.select(*parts.columns)), passes)


def damaged(rows: DataFrame) -> DataFrame:
    """Rows of (conv_id, turn, role, text) damaged by crc32(`conv_id:turn`) mod 20, dropped ones marked `gone`."""
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    kind = F.crc32(name.cast("binary")) % 20
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    out = rows.select("conv_id", "turn", F.when(kind == 4, F.lit(_USER)).otherwise(role).alias("role"),
                      F.when(kind == 1, F.lit("")).when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
                      (kind == 0).alias("gone"), F.when(kind == 3, 2).otherwise(1).alias("times"))
    return out.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("times")))).drop("times", "__copy")
