"""Document fingerprints from Lempel-Ziv phrases (operator 7).

A text's symbols are its runs of up to 12 word characters and its other
non-blank characters.  The LZ78 parse cuts them into dictionary phrases: each
phrase is a known phrase and one more symbol.  Texts that compress each other
well share phrases; the fingerprint keeps the minimum hash of the phrase set in
each of 128 bins (one permutation, empty bins filled from the next full one),
8 bits of each.  The likeness of two fingerprints is the share of equal bins,
less what chance gives: an estimate of the phrase sets' Jaccard similarity.

`compare_neighbours` sets each document against the next one in descending
doc_id and against its text with the last third replaced by the next one's
beginning.  Documents are packed by range of id (see `blocks`), so a neighbour
is in the same block or is the last of the range below; only those cross.

Results: equal texts have equal fingerprints; a null text is an empty one.  A
text without symbols has the fingerprint "", like only to "".  Equal doc_ids
follow each other in order of text, null ids come last (after the smallest id).
The only row of a table is its own neighbour.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phrasemill.llm import blocks as B

BINS = 128
CACHE_SYMBOLS = 400_000
_MASK = (1 << 64) - 1


class Phrases:
    """Phrase hashes of texts; symbols' hashes are kept for the next text (emptied when full)."""

    def __init__(self):
        import regex
        self.find, self.known = regex.compile(r"\w{1,12}|[^\w\s]").findall, {}

    def __call__(self, text: str) -> set[int]:
        return self._parse(text, set(), 0)[0]

    def both(self, text: str, other: str, same: int) -> tuple[set[int], set[int]]:
        """The phrases of two texts that begin with the same characters: the
        parse of the common part (up to a space) is done once."""
        cut = text.rfind(" ", 0, same) + 1
        begun, phrase = self._parse(text[:cut], set(), 0)
        return self._parse(text[cut:], set(begun), phrase)[0], self._parse(other[cut:], begun, phrase)[0]

    def _parse(self, text: str, seen: set[int], phrase: int) -> tuple[set[int], int]:
        symbols, known = self.find(text), self.known
        new = set(symbols).difference(known)
        if len(known) + len(new) > CACHE_SYMBOLS:
            known.clear()
            new = set(symbols)
        for s in new:
            known[s] = int.from_bytes(hashlib.blake2b(s.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        add = seen.add
        for s in map(known.__getitem__, symbols):
            phrase = (phrase * 0x9E3779B97F4A7C15 + s) & _MASK
            if phrase not in seen:
                add(phrase)
                phrase = 0
        return seen, phrase


def signature(phrases: set[int]) -> bytes:
    """128 bytes; b"" without phrases."""
    if not phrases:
        return b""
    h = B._mix(np.fromiter(phrases, np.uint64, len(phrases)))
    low = np.full(BINS, _MASK, np.uint64)
    np.minimum.at(low, (h >> np.uint64(57)).astype(np.int64), h << np.uint64(7))
    full = low != np.uint64(_MASK)
    if not full.all():                       # an empty bin takes the next full one's value and how far it is
        at = np.flatnonzero(full)
        src = at[np.searchsorted(at, np.arange(BINS)) % len(at)]
        far = (src - np.arange(BINS)) % BINS
        low = B._mix(low[src] + far.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    else:
        low = B._mix(low)
    return (low >> np.uint64(56)).astype(np.uint8).tobytes()


def likeness(a: bytes, b: bytes) -> float:
    if not a or not b:
        return float(a == b)
    same = np.count_nonzero(np.frombuffer(a, np.uint8) == np.frombuffer(b, np.uint8)) / BINS
    return round(max(0.0, (same - 1 / 256) / (1 - 1 / 256)), 6)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint): hex digits."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parse = Phrases()
        for b in batches:
            fp = [signature(parse(t or "")).hex() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp, pa.string())], names=["doc_id", "fingerprint"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(
        run, "doc_id long, fingerprint string")


def edited(text: str, following: str) -> str:
    """The last third of the code points replaced by as many of the following text's first."""
    n = len(text) // 3
    return text[:len(text) - n] + following[:n]


def _last(n: int):
    """The text of the largest id of each range, for the range above it (for the lowest one: the highest's)."""
    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        _, texts = B.open_block(t.column("data").to_pylist())
        return pa.table({"block": pa.array([(key[0].as_py() + 1) % n], pa.int32()), "text": pa.array([texts[-1] or ""])})
    return run


def _compare(key: tuple[pa.Scalar, ...], docs: pa.Table, before: pa.Table) -> pa.Table:
    ids, texts = B.open_block(docs.column("data").to_pylist())
    texts, parse = [t or "" for t in texts], Phrases()
    follow = [before.column("text")[0].as_py(), *texts[:-1]]     # descending ids: the one below comes next
    other = [edited(t, f) for t, f in zip(texts, follow, strict=True)]
    pairs = [[signature(p) for p in parse.both(t, o, len(t) - len(t) // 3)] for t, o in zip(texts, other, strict=True)]
    own, of_other = [a for a, _ in pairs], [b for _, b in pairs]
    of_next = [signature(parse(follow[0])), *own[:-1]]
    return pa.table({
        "doc_id": pa.array(ids, pa.int64()), "n_chars": pa.array(map(len, texts), pa.int64()),
        "edited_sha256": pa.array([hashlib.sha256(t.encode()).hexdigest() for t in other], pa.string()),
        "fingerprint": pa.array([s.hex() for s in own], pa.string()),
        "edited_fingerprint": pa.array([s.hex() for s in of_other], pa.string()),
        "near_edited": pa.array(map(likeness, own, of_other), pa.float64()),
        "near_next": pa.array(map(likeness, own, of_next), pa.float64())})


def compare_neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       block_bytes: int = B.BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next), one row per row."""
    bounds = B.id_bounds(docs, id_col, B.block_count(docs, text_col, block_bytes))
    by_range = B.pack_ranges(docs, id_col, text_col, bounds).groupBy("block")
    last = by_range.applyInArrow(_last(len(bounds)), "block int, text string")
    return by_range.cogroup(last.groupBy("block")).applyInArrow(
        _compare, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
                  "near_edited double, near_next double")
