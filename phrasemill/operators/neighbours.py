"""Phrases found by comparing the occurrences that stand side by side in a document.

Occurrences of the phrases' tokens travel packed (see ``packed``) to a part by
their line, and so do the documents' own columns, once per document.  A part
puts its occurrences in order of document and place and looks up every window
of one to SHORT tokens among the phrases; a longer phrase is compared whole
where its first SHORT tokens stand.  Matches are counted where they are found.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phrasemill.operators import packed as PK
from phrasemill.session import DEFAULT_MAX_BROADCAST_BYTES, estimated_bytes, maybe_broadcast

SHORT = 3                       # tokens of a window that is looked up
ROWS_AT_ONCE = 2_000_000        # occurrences packed together, and about those of a part
ROWS_OUT = 100_000
OCCURRENCES, DOCUMENTS, PAIRS = 0, 1, 2
CARRY = {"n_tokens": np.int32, "score": np.float64, "docid": np.int64}
_TYPES = {OCCURRENCES: [np.int32, np.int32, np.int32, np.int32, np.int64],
          DOCUMENTS: [np.int64, *[t for c in CARRY.values() for t in (c, np.uint8)]],
          PAIRS: [np.int64, np.int64]}


class Phrases:
    """A phrase table of bounded size: its tokens numbered in their order, and windows of tokens as whole numbers."""

    def __init__(self, rows: list[tuple[int, list[str]]]):
        self.term_no = np.array([no for no, _ in rows], np.int64)
        self.tokens = sorted({t for _, toks in rows for t in toks}, key=str.encode)
        number = {t: k for k, t in enumerate(self.tokens)}
        self.base = max(len(self.tokens), 1)
        self.codes = np.array([number[t] for _, toks in rows for t in toks], np.int64)
        self.size = np.array([len(toks) for _, toks in rows], np.int64)
        self.at = np.cumsum(self.size) - self.size
        # per length of a window (SHORT: the longer phrases' heads, too, from SHORT + 1 on), ascending: its number, its phrase
        self.windows = []
        for n, mine in [*((n, self.size == n) for n in range(1, SHORT + 1)), (SHORT, self.size > SHORT)]:
            of = np.flatnonzero(mine)
            key = np.zeros(len(of), np.int64)
            for k in range(n):
                key = key * self.base + self.codes[self.at[of] + k]
            order = np.argsort(key, kind="stable")
            self.windows.append((n, key[order], of[order]))

    @staticmethod
    def of(terms: DataFrame, max_broadcast_bytes: int | None) -> "Phrases | None":
        """None where the table is not small, or a phrase or a number stands there twice."""
        cap = DEFAULT_MAX_BROADCAST_BYTES if max_broadcast_bytes is None else max_broadcast_bytes
        if estimated_bytes(terms.select("term_no", "phrase"), ["phrase"]) > cap:
            return None
        rows = [(r["term_no"], r["toks"]) for r in terms.select("term_no", "toks").collect()]
        if any(not isinstance(no, int) for no, _ in rows) or len({no for no, _ in rows}) < len(rows) or len({tuple(t) for _, t in rows}) < len(rows):
            return None
        found = Phrases(rows)
        return found if found.base ** SHORT < 2 ** 63 else None

    def matches(self, code: np.ndarray, doc: np.ndarray, pos: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(phrase, row where it begins) of occurrences in order of document and place, which are unique."""
        follows = np.append((doc[1:] == doc[:-1]) & (pos[1:] == pos[:-1] + 1), False)[:len(code)]
        at, key = np.arange(len(code)), code
        for n, keys, phrases in self.windows:
            if n > 1 and n > size:
                more = follows[at + n - 2]
                at = at[more]
                key = key[more] * self.base + code[at + n - 1]
            size = n
            if not len(keys) or not len(at):
                continue
            lo = np.searchsorted(keys, key, "left")
            hit = np.flatnonzero(keys[np.minimum(lo, len(keys) - 1)] == key)
            lo, first = lo[hit], at[hit]
            count = np.searchsorted(keys, key[hit], "right") - lo
            row = np.repeat(first, count)
            phrase = phrases[np.repeat(lo - (np.cumsum(count) - count), count) + np.arange(len(row))]
            yield self._whole(phrase, row, code, doc, pos)

    def _whole(self, phrase: np.ndarray, row: np.ndarray, code: np.ndarray, doc: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those whose tokens behind the first SHORT follow as well."""
        if (self.size[phrase] <= SHORT).all():
            return phrase, row
        last = row + self.size[phrase] - 1
        there = last < len(code)
        there[there] = (doc[last[there]] == doc[row[there]]) & (pos[last[there]] - pos[row[there]] == self.size[phrase[there]] - 1)
        phrase, row = phrase[there], row[there]
        for k in range(SHORT, int(self.size[phrase].max(initial=0))):
            on = np.flatnonzero(self.size[phrase] > k)
            differ = on[code[row[on] + k] != self.codes[self.at[phrase[on]] + k]]
            if len(differ):
                phrase, row = np.delete(phrase, differ), np.delete(row, differ)
        return phrase, row


def _packets(part: np.ndarray, kind: int, of) -> pa.RecordBatch:
    """Rows dealt to their parts; ``of(rows)`` gives the arrays of a packet."""
    order = np.argsort(part, kind="stable")
    begins = PK.starts_of_runs(part[order])
    packets = [PK.pack(*of(order[lo:hi])) for lo, hi in zip(begins, np.append(begins[1:], len(order)))]
    return pa.RecordBatch.from_arrays([pa.array(part[order][begins], pa.int32()), pa.array(np.full(len(begins), kind, np.int32)),
                                       pa.array(packets, pa.binary())], names=["part", "kind", "packet"])


def _dealer(kind: int, parts: int):
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in PK.gathered(batches, lambda b: np.ones(len(b), np.int64), ROWS_AT_ONCE):
            line = batch["line_no"].to_numpy(zero_copy_only=False)
            part = (PK.spread(line) % np.uint64(parts)).astype(np.int16 if parts < 2 ** 15 else np.int32)
            if kind == OCCURRENCES:
                code, pos = (batch[c].to_numpy(zero_copy_only=False) for c in ("code", "pos"))

                def of(rows):
                    lines, own = np.unique(line[rows], return_inverse=True)
                    run = PK.starts_of_runs(code[rows])
                    return code[rows][run], np.diff(np.append(run, len(rows))).astype(np.int32), PK.steps(own), pos[rows], lines
            elif kind == DOCUMENTS:
                columns = [a for c, t in CARRY.items() for a in PK.column(batch[c], t)]

                def of(rows):
                    return line[rows], *[a[rows] for a in columns]
            else:
                term = batch["term_no"].to_numpy(zero_copy_only=False).astype(np.int64)

                def of(rows):
                    return term[rows], line[rows]
            yield _packets(part, kind, of)

    return deal


def _finder(phrases: Phrases, only: bool, positions: bool):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packets: dict[int, dict[int, list]] = {}
        for batch in batches:
            for part, kind, packet in zip(*(batch[c].to_pylist() for c in ("part", "kind", "packet"))):
                packets.setdefault(part, {}).setdefault(kind, []).append(PK.unpack(packet, *_TYPES[kind]))
        for part in sorted(packets):
            if len(held := packets.pop(part)) > 1:
                yield from _found(phrases, held, only, positions)

    return find


def _found(phrases: Phrases, held: dict[int, list], only: bool, positions: bool) -> Iterator[pa.RecordBatch]:
    if OCCURRENCES not in held:
        return
    line, *carry = (np.concatenate(c) for c in zip(*held.pop(DOCUMENTS)))
    order = np.argsort(line)
    line, carry = line[order], [c[order] for c in carry]
    rows = held.pop(OCCURRENCES)
    code = np.concatenate([np.repeat(c, n) for c, n, *_ in rows])
    doc = np.concatenate([np.searchsorted(line, lines)[PK.summed(own)] for _, _, own, _, lines in rows])
    pos = np.concatenate([p for *_, p, _ in rows])
    del rows
    order = np.argsort((doc << 32) + pos)
    code, doc, pos = code[order].astype(np.int64), doc[order], pos[order]
    phrase, at = (np.concatenate(c) for c in zip(*[(np.empty(0, np.int64),) * 2, *phrases.matches(code, doc, pos)]))
    key = phrase * len(line) + doc[at]
    if only:
        term, where = (np.concatenate(c) for c in zip(*held.get(PAIRS, [(np.empty(0, np.int64),) * 2])))
        by_no = np.argsort(phrases.term_no)
        of = by_no[np.minimum(np.searchsorted(phrases.term_no[by_no], term), len(by_no) - 1)]
        here = np.minimum(np.searchsorted(line, where), len(line) - 1)
        known = (phrases.term_no[of] == term) & (line[here] == where)
        some = np.isin(key, of[known] * len(line) + here[known])
        key, at = key[some], at[some]
    order = np.argsort(key, kind="stable")      # a phrase's matches come in order of place
    key, first = key[order], pos[at[order]].astype(np.int32)
    begins = PK.starts_of_runs(key)
    ends = np.append(begins[1:], len(key)).astype(np.int64)
    for lo in range(0, len(begins), ROWS_OUT):
        b, e = begins[lo:lo + ROWS_OUT], ends[lo:lo + ROWS_OUT]
        of, d = np.divmod(key[b], len(line))
        columns = [pa.array(phrases.term_no[of]), pa.array(line[d]), *[pa.array(carry[2 * k][d], mask=carry[2 * k + 1][d] == 0) for k in range(len(CARRY))],
                   pa.array(e - b)]
        if positions:
            starts = pa.ListArray.from_arrays(pa.array(np.append(b, e[-1:]) - b[0], pa.int32()), pa.array(first[b[0]:e[-1]]))
            columns += [starts, pa.array(first[b])]
        yield pa.RecordBatch.from_arrays(columns, names=["term_no", "line_no", *CARRY, "tf", *["starts", "first_pos"] * positions])


def hits(found: DataFrame, docs: DataFrame, phrases: Phrases, n_tokens: float, positions: bool, only: DataFrame | None = None,
         max_broadcast_bytes: int | None = None) -> DataFrame:
    """(term_no, line_no, n_tokens, score, docid, tf) and, with ``positions``, starts and first_pos.

    ``found``: (token, line_no, pos), of which there are at most ``n_tokens``; ``docs`` has a row a line."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(math.ceil(n_tokens / ROWS_AT_ONCE), min(parts, math.ceil(n_tokens * 20 / ROWS_AT_ONCE)), 1)
    numbered = spark.createDataFrame(pa.table({"token": pa.array(phrases.tokens, pa.string()), "code": pa.array(range(len(phrases.tokens)), pa.int32())}))
    sent = "part int, kind int, packet binary"
    rows = found.join(F.broadcast(numbered), "token").select("code", "line_no", "pos")
    if only is not None:
        lines, small = maybe_broadcast(only.select("line_no").distinct(), [], max_broadcast_bytes)
        rows = rows.join(lines, "line_no", "left_semi") if small else rows
    packets = rows.mapInArrow(_dealer(OCCURRENCES, parts), sent).unionByName(
        docs.select("line_no", *CARRY).mapInArrow(_dealer(DOCUMENTS, parts), sent))
    if only is not None:
        packets = packets.unionByName(only.select("line_no", "term_no").mapInArrow(_dealer(PAIRS, parts), sent))
    out = "term_no long, line_no long, n_tokens int, score double, docid long, tf long" + ", starts array<int>, first_pos int" * positions
    return packets.repartitionById(parts, F.col("part")).mapInArrow(_finder(phrases, only is not None, positions), out)
