"""Token-clustered index (IDX-4, SRC-8, SNK-3) and phrase search on it (QRY-2, QRY-3, QRY-9).

An index is a folder of four Parquet tables:

* ``docs``: the document table, sorted by line number inside each file;
* ``postings``: one row per token occurrence (token, line_no, pos, start
  in the original content, from which the end follows, and the document columns ranking needs), in folders
  by hash of the token, sorted by token inside each file with small row groups,
  so that the files' own statistics lead a reader to a token.  A token of very
  many occurrences is split by document over its folder's files, so no task
  writes it whole; the number of folders follows from the number of tokens,
  and a folder's files from its rows;
* ``df``: documents and occurrences per token; ``stats``: documents, average length, folders, the hash that deals them.

A search reads the folders of the phrases' tokens and nothing else, and for a
few tokens only the row groups that can hold them.  It starts at each phrase's
rarest token and checks the phrase's other tokens at their positions.  Where
many short phrases would have more candidates than their tokens have postings,
these postings are put in order of their places instead, and neighbours are
compared with the phrases, so the work is in proportion to the postings (see
``neighbours`` for a phrase table of small measured size, which long phrases are
part of; a larger one is joined).  From the rarest token, a long phrase costs more look-ups per candidate, never more columns.  Counts come
first; positions are read again for the documents that a ranking keeps.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from phrasemill.functions import analysis as A
from phrasemill.functions import patterns as P
from phrasemill.operators import index as IDX
from phrasemill.operators import neighbours as NB
from phrasemill.operators import packed as PK
from phrasemill.operators.phrases import distinct_phrases, for_each_term, one_row_a_line
from phrasemill.session import cut_lineage, maybe_broadcast

TOKENS_PER_BUCKET = 16_000_000
TOKENS_PER_FILE = 4_000_000
MIN_BUCKETS, MAX_BUCKETS = 16, 8192
ROW_GROUP_BYTES = 8 << 20
HASH = "crc32"
TOKENS_AT_ONCE = 1_000_000   # tokens that a task packs together
HOT = 4               # a token of more rows than a file's HOTth part lies in all files of its folder
FEW_TOKENS = 10       # up to here Parquet readers test the tokens themselves, beyond only their range
SHORT = 3             # tokens of the phrases that neighbouring postings are compared with
CARRY = ["n_tokens", "score", "docid"]
STARTS = "starts"     # the tokens' offsets, written beside the document table's columns
# whole numbers as differences; the files are read by token, row group by row group
FILES = {"compression": "zstd", "parquet.writer.version": "PARQUET_2_0", "parquet.enable.dictionary#line_no": "false",
         f"parquet.enable.dictionary#{STARTS}.list.element": "false"}
DOC_COLUMNS = ["line_no", "title", "content", "score", "docid", "toks", "n_tokens"]


# Columns of a document that its postings repeat, as they travel.
PER_DOCUMENT = {"line_no": np.int64, "n_tokens": np.int32, "score": np.float64, "docid": np.int64}
PER_DOCUMENT_SQL = {"line_no": "long", "n_tokens": "int", "score": "double", "docid": "long"}
POSTINGS_SQL = "token string, line_no long, pos int, start int, n_tokens int, score double, docid long, bucket int"
_PACKET = [np.int32, np.uint8, np.int32, np.int32, np.int32, np.int32, *[t for c in PER_DOCUMENT.values() for t in (c, np.uint8)]]


def bucket(token: Column, buckets: int) -> Column:
    """A token's folder, by HASH."""
    return F.pmod(F.crc32(token), F.lit(buckets)).cast("int")


def _dealer(buckets: int, first: np.ndarray, files: np.ndarray, hot: list[str]):
    """Document rows as packets (task, packet): the occurrences for one file from TOKENS_AT_ONCE tokens, by token."""
    hot = pa.array(hot, pa.string())

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in PK.gathered(batches, lambda b: PK.column(pc.list_value_length(b["toks"]), np.int64)[0], TOKENS_AT_ONCE):
            size, n_starts = (PK.column(pc.list_value_length(batch[c]), np.int64)[0] for c in ("toks", STARTS))
            words = batch["toks"].flatten().dictionary_encode()
            doc = np.repeat(np.arange(len(size), dtype=np.int32), size)
            pos = np.arange(len(doc), dtype=np.int32) - np.repeat((np.cumsum(size) - size).astype(np.int32), size)
            start = batch[STARTS].flatten().to_numpy(zero_copy_only=False)
            if (size != n_starts).any():
                known, at = pos < n_starts[doc], (np.cumsum(n_starts) - n_starts)[doc] + pos
                start = np.where(known, np.append(start, -1)[np.where(known, at, -1)], -1).astype(np.int32)
            # the blanked first token and over-long ones are left out
            text = words.dictionary
            code = PK.column(words.indices, np.int32)[0]
            wanted = pc.invert(pc.is_in(text, pa.array(["", P.SENTINEL], pa.string()))).to_numpy(zero_copy_only=False)
            rows = np.flatnonzero(wanted[code] & words.indices.is_valid().to_numpy(zero_copy_only=False)) if len(text) else np.empty(0, np.int64)
            if not len(rows):
                continue
            crc = np.fromiter(map(zlib.crc32, text.cast(pa.binary()).to_pylist()), np.int64, len(text))
            folder = crc % buckets
            share = np.maximum(files[folder], 1)
            task = first[folder] + crc // buckets % share
            code, doc, pos, start = code[rows], doc[rows], pos[rows], start[rows]
            lines = PK.spread(PK.column(batch["line_no"], np.int64)[0]).astype(np.int64)
            frequent = pc.is_in(text, hot).to_numpy(zero_copy_only=False)
            to = np.where(frequent[code], first[folder][code] + lines[doc] % share[code], task[code])
            order = np.argsort(to * len(text) + code, kind="stable").astype(np.int32)
            to, code, doc, pos, start = to[order], code[order], doc[order], pos[order], start[order]
            columns = [PK.column(batch[c], t) for c, t in PER_DOCUMENT.items()]
            begins = PK.starts_of_runs(to)
            packets = []
            for lo, hi in zip(begins, np.append(begins[1:], len(to))):
                token = PK.starts_of_runs(code[lo:hi])
                there = np.zeros(len(size), bool)
                there[doc[lo:hi]] = True
                own = text.take(pa.array(code[lo:hi][token])).cast(pa.binary())
                packets.append(PK.pack(
                    PK.column(pc.binary_length(own), np.int32)[0], np.frombuffer(b"".join(own.to_pylist()), np.uint8),
                    np.diff(np.append(token, hi - lo)).astype(np.int32), PK.steps((np.cumsum(there) - 1)[doc[lo:hi]]),
                    pos[lo:hi], start[lo:hi], *[a[there] for c in columns for a in c]))
            yield pa.RecordBatch.from_arrays([pa.array(to[begins], pa.int32()), pa.array(packets, pa.binary())], names=["task", "packet"])
            pa.default_memory_pool().release_unused()

    return deal


ROWS_OUT = 50_000
ROWS_SORTED = 500_000


def _sorter(first: np.ndarray, folders: np.ndarray):
    """Packets as the rows of their files, sorted by token, line and place."""
    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packets: dict[int, list[bytes]] = {}
        for batch in batches:
            for task, packet in zip(batch["task"].to_pylist(), batch["packet"].to_pylist()):
                packets.setdefault(task, []).append(packet)
        for task in sorted(packets):
            yield from _sorted_rows(packets.pop(task), int(folders[np.searchsorted(first, task, "right") - 1]))
            pa.default_memory_pool().release_unused()

    return sort


def _sorted_rows(packets: list[bytes], folder: int) -> Iterator[pa.RecordBatch]:
    n_rows = sum(PK.lengths(p, len(_PACKET))[3] for p in packets)
    doc, pos, start = (np.empty(n_rows, np.int32) for _ in range(3))
    words, counts, columns, at, n_docs = [], [], [[] for _ in range(2 * len(PER_DOCUMENT))], 0, 0
    while packets:      # what is unpacked is not held twice
        length, letters, count, own, where, begin, *rest = PK.unpack(packets.pop(), *_PACKET)
        ends = np.concatenate(([0], np.cumsum(length))).astype(np.int32)
        words.append(pa.StringArray.from_buffers(len(length), pa.py_buffer(ends), pa.py_buffer(letters)))
        counts.append(count)
        to = at + len(own)
        doc[at:to], pos[at:to], start[at:to] = PK.summed(own) + n_docs, where, begin
        for c, r in zip(columns, rest):
            c.append(r)
        at, n_docs = to, n_docs + len(rest[0])
    words, count = pa.concat_arrays(words).dictionary_encode(), np.concatenate(counts)
    # strings in order of their bytes
    order = pc.sort_indices(words.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    token, text = rank[words.indices.to_numpy()], words.dictionary.take(pa.array(order))
    fields = []
    while columns:
        values, valid = np.concatenate(columns.pop(0)), np.concatenate(columns.pop(0))
        if not fields:
            line = np.empty(n_docs, np.int32)
            line[np.lexsort((values, valid))] = np.arange(n_docs)
        fields.append(pa.array(values, mask=valid == 0))
    # sorted piece by piece: some tokens, or some lines of a token of more rows than a piece
    size = np.bincount(token, weights=count, minlength=len(text)).astype(np.int64)
    piece = np.cumsum(np.where(size > ROWS_SORTED, ROWS_SORTED, size)) // ROWS_SORTED
    begins = PK.starts_of_runs(np.where(size > ROWS_SORTED, -1 - np.arange(len(size)), piece))
    for lo, hi in zip(begins, np.append(begins[1:], len(size))):
        mine = np.repeat((token >= lo) & (token < hi), count)
        cuts = -(-int(size[lo]) // ROWS_SORTED) if hi == lo + 1 else 1
        for k in range(cuts):
            rows = np.flatnonzero(mine if cuts == 1 else mine & (line[doc].astype(np.int64) * cuts // n_docs == k))
            run = np.searchsorted(np.cumsum(count), rows, "right")
            key = token[run] * n_docs + line[doc[rows]]
            order = np.argsort(key, kind="stable")
            rows, key = rows[order], key[order]
            for at in range(0, len(rows), ROWS_OUT):
                some = rows[at:at + ROWS_OUT]
                of = pa.array(doc[some])
                line_no, *carry = (f.take(of) for f in fields)
                yield pa.RecordBatch.from_arrays(
                    [text.take(pa.array(key[at:at + ROWS_OUT] // n_docs)), line_no, pa.array(pos[some]), pa.array(start[some], mask=start[some] < 0),
                     *carry, pa.array(np.full(len(some), folder, np.int32))], names=["token", "line_no", "pos", "start", *CARRY, "bucket"])


@dataclass(frozen=True)
class Index:
    """A stored index; searches take it in place of the document table."""
    docs: DataFrame
    postings: DataFrame
    df: DataFrame
    n_docs: int
    avgdl: float
    buckets: int
    texts: DataFrame      # the documents' titles and contents with the tokens' offsets


@contextmanager
def one_folder_a_task(spark: SparkSession) -> Iterator[None]:
    """Tasks of one folder each keep the order of their rows: Spark need not sort by folder first, and compares the
    tokens' first bytes instead of equal folder numbers."""
    key = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "1")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def write_index(docs: DataFrame, path: str, buckets: int | None = None, tokens_per_file: int = TOKENS_PER_FILE,
                row_group_bytes: int = ROW_GROUP_BYTES) -> None:
    """Create or overwrite the index; ``docs`` is the document table with tokens, read once.  Where it has no
    column of offsets (``build_docs(..., starts=STARTS)``), these are made here by a mask and a token pass of their own."""
    spark = docs.sparkSession

    def write(df: DataFrame, name: str, *folders: str) -> DataFrame:
        out = df.write.mode("overwrite").options(**FILES).option("parquet.block.size", row_group_bytes)
        (out.partitionBy(*folders) if folders else out).parquet(f"{path}/{name}")
        return spark.read.parquet(f"{path}/{name}")

    if STARTS not in docs.columns:
        c = F.col("content")
        docs = (docs.sortWithinPartitions("line_no").withColumn("_marked", A.mask_marked(c)).withColumn("_masked", A.unmark(F.col("_marked")))
                .withColumn(STARTS, A.original_token_starts(F.col("_marked"), F.col("_masked"))))
    # analysed once: what follows reads the written table
    docs = write(docs.select(*DOC_COLUMNS, STARTS), "docs")
    n, avgdl = IDX.corpus_stats(docs)
    if buckets is None:
        buckets = min(max(math.ceil(n * avgdl / TOKENS_PER_BUCKET), MIN_BUCKETS), MAX_BUCKETS)
    counts = IDX.token_counts(docs).filter(F.col("token") != P.SENTINEL).withColumn("bucket", bucket(F.col("token"), buckets))
    df = write(counts.repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket", "token"), "df", "bucket")
    # A folder has as many files as its rows fill, each written by a task of its own (by number, not by hash: no task
    # gets two).  A token of more rows than a part of a file is dealt out by document, the others by token.
    per_bucket = df.groupBy("bucket").agg(F.sum("n").alias("n")).orderBy("bucket").collect()
    first, files = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
    tasks = 0
    for r in per_bucket:
        first[r["bucket"]], files[r["bucket"]] = tasks, math.ceil(r["n"] / tokens_per_file)
        tasks += int(files[r["bucket"]])
    own = np.flatnonzero(files)
    # at most HOT for each file's worth of occurrences
    hot = [r["token"] for r in df.filter(F.col("n") > tokens_per_file // HOT).select("token").collect()]
    # Occurrences travel packed, some bytes each, and a file's are sorted in its task's Arrow buffers.
    rows = docs.select(*[F.col(c).cast(PER_DOCUMENT_SQL[c]).alias(c) for c in PER_DOCUMENT], "toks", STARTS)
    packets = rows.mapInArrow(_dealer(buckets, first, files, hot), "task int, packet binary")
    rows = packets.repartitionById(max(tasks, 1), F.col("task")).mapInArrow(_sorter(first[own], own), POSTINGS_SQL)
    with one_folder_a_task(spark):
        write(rows, "postings", "bucket")
    stats = spark.range(1, numPartitions=1).select(F.lit(n).cast("long").alias("n_docs"), F.lit(avgdl).alias("avgdl"),
                                                   F.lit(buckets).cast("int").alias("buckets"), F.lit(HASH).alias("hash"))
    write(stats, "stats")


def load_index(spark: SparkSession, path: str) -> Index:
    s = spark.read.parquet(f"{path}/stats").first().asDict()
    if s.get("hash") != HASH:
        raise ValueError(f"the index at {path} has another layout: write it again")
    start = F.col("start").cast("long")
    postings = spark.read.parquet(f"{path}/postings").select(
        "token", "line_no", "pos", start.alias("start"), (start + F.length("token")).alias("end"), *CARRY, "bucket")
    docs = spark.read.parquet(f"{path}/docs")
    return Index(docs.drop(STARTS), postings, spark.read.parquet(f"{path}/df").drop("n"), s["n_docs"], s["avgdl"], s["buckets"],
                 docs.select("line_no", "title", "content", STARTS))


def buckets_of(tokens: DataFrame, buckets: int) -> list[int]:
    return sorted(r["b"] for r in tokens.select(bucket(F.col("token"), buckets).alias("b")).distinct().collect())


def rows_of(table: DataFrame, tokens: DataFrame, buckets: int, max_broadcast_bytes: int | None = None) -> DataFrame:
    """The rows of the wanted tokens: their folders, then the tokens, which for a few are tested by the scan."""
    table = table.filter(F.col("bucket").isin(buckets_of(tokens, buckets))).drop("bucket")
    few = [r["token"] for r in tokens.select("token").distinct().limit(FEW_TOKENS + 1).collect()]
    if len(few) <= FEW_TOKENS:
        return table.filter(F.col("token").isin(few))
    small, _ = maybe_broadcast(tokens, ["token"], max_broadcast_bytes)
    return table.join(small, "token", "left_semi")


def token_df(index: Index, tokens: DataFrame, max_broadcast_bytes: int | None = None) -> DataFrame:
    """IDX-6 from the index: (token, df)."""
    return rows_of(index.df, tokens.select("token").distinct(), index.buckets, max_broadcast_bytes)


def _neighbours(index: Index, terms: DataFrame, max_broadcast_bytes: int | None, only: DataFrame | None) -> DataFrame:
    """Where phrases of up to SHORT tokens begin: the postings of their tokens by document and place, each with those
    right behind it.  All rows of a document are in one partition, in which its matches can be counted."""
    found = rows_of(index.postings, terms.select(F.explode("toks").alias("token")).distinct(), index.buckets, max_broadcast_bytes)
    found = found.select("token", "line_no", "pos", *CARRY)
    if only is not None:
        lines, _ = maybe_broadcast(only.select("line_no").distinct(), [], max_broadcast_bytes)
        found = found.join(lines, "line_no", "left_semi")
    here = Window.partitionBy("line_no").orderBy("pos")
    behind = [F.when(F.lead("pos", k).over(here) == F.col("pos") + k, F.lead("token", k).over(here)).alias(f"t{k}") for k in range(1, SHORT)]
    rows = found.select("line_no", *CARRY, F.col("pos").alias("first"), F.col("token").alias("t0"), *behind)
    grams = rows.select("line_no", *CARRY, "first", F.inline(F.array(*[F.struct(
        F.lit(n).alias("n_toks"), F.concat_ws(" ", *[f"t{k}" for k in range(n)]).alias("phrase"),
        F.col(f"t{n - 1}").isNotNull().alias("_ok")) for n in range(1, SHORT + 1)]))).filter("_ok")
    small, _ = maybe_broadcast(terms.select("term_no", "n_toks", "phrase"), ["phrase"], max_broadcast_bytes)
    out = grams.join(small, ["n_toks", "phrase"]).select("term_no", "line_no", *CARRY, "first")
    if only is not None:
        only, _ = maybe_broadcast(only, [], max_broadcast_bytes)
        out = out.join(only, ["term_no", "line_no"], "left_semi")
    return out


def _looked_up(index: Index, terms: DataFrame, max_broadcast_bytes: int | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The phrases' tokens, these with their df, and each phrase's rarest token (none where no document has one of them)."""
    toks = cut_lineage(terms.filter("n_toks > 0").select("term_no", "n_toks", F.posexplode("toks").alias("k", "token")))
    tokens = toks.select("token").distinct()
    rare = toks.join(token_df(index, tokens, max_broadcast_bytes), "token", "left").fillna({"df": 0})
    # a phrase's rarest token; one that no document has rules the phrase out
    anchors = cut_lineage(rare.groupBy("term_no").agg(F.min(F.struct("df", "k", "token", "n_toks")).alias("a")).filter("a.df > 0").select(
        "term_no", F.col("a.k").alias("k"), F.col("a.token").alias("token"), F.col("a.n_toks").alias("n_toks"), F.col("a.df").alias("df")))
    return toks, rare, anchors


def _many(index: Index, rare: DataFrame, anchors: DataFrame) -> bool:
    """Whether the short phrases would have more candidates than their tokens have postings."""
    short = F.col("n_toks") <= SHORT
    row = anchors.agg(F.sum(F.when(short & (F.col("n_toks") > 1), F.col("df") * F.col("n_toks"))).alias("candidates")).first()
    if (row["candidates"] or 0) == 0:
        return False
    apart = rare.filter(short).select("token", "df").distinct().agg(F.sum("df").alias("n")).first()["n"]
    return row["candidates"] > 2 * apart and one_row_a_line(index.docs)


def _matched(index: Index, terms: DataFrame, max_broadcast_bytes: int | None, only: DataFrame | None = None,
             looked_up: tuple[DataFrame, DataFrame, DataFrame] | None = None, many: bool | None = None) -> list[DataFrame]:
    """(term_no, line_no, n_tokens, score, docid, first): where each phrase begins, in tables that share no term.
    ``only``: (term_no, line_no) pairs to look at."""
    toks, rare, anchors = looked_up or _looked_up(index, terms, max_broadcast_bytes)
    if _many(index, rare, anchors) if many is None else many:
        short = F.col("n_toks") <= SHORT
        near = _neighbours(index, terms.filter(short & (F.col("n_toks") > 0)), max_broadcast_bytes, only)
        anchors = anchors.filter(~short)
        return [near] if anchors.isEmpty() else [near, _from_rarest(index, toks.filter(~short), anchors, max_broadcast_bytes, only)]
    return [_from_rarest(index, toks, anchors, max_broadcast_bytes, only)]


def _from_rarest(index: Index, toks: DataFrame, anchors: DataFrame, max_broadcast_bytes: int | None, only: DataFrame | None) -> DataFrame:
    tokens = toks.select("token").distinct()
    if only is not None:
        only, _ = maybe_broadcast(only, [], max_broadcast_bytes)

    def begins(which: str) -> DataFrame:
        mine = anchors.filter(which)
        found = rows_of(index.postings, mine.select("token").distinct(), index.buckets, max_broadcast_bytes)
        small, _ = maybe_broadcast(mine, ["token"], max_broadcast_bytes)
        out = found.join(small, "token").withColumn("first", F.col("pos") - F.col("k")).filter("first >= 0").select(
            "term_no", "n_toks", "k", "line_no", *CARRY, "first")
        return out if only is None else out.join(only, ["term_no", "line_no"], "left_semi")

    keep = ["term_no", "line_no", *CARRY, "first"]
    hits = begins("n_toks = 1").select(*keep)
    if anchors.filter("n_toks > 1").isEmpty():
        return hits
    others = cut_lineage(begins("n_toks > 1").join(toks.select("term_no", F.col("k").alias("j"), "token"), "term_no").filter("j <> k").select(
        "term_no", "n_toks", "line_no", *CARRY, "first", "token", (F.col("first") + F.col("j")).alias("pos")))
    near = rows_of(index.postings, tokens, index.buckets, max_broadcast_bytes).select("token", "line_no", "pos")
    # few candidates: the frequent tokens' lists are probed where they lie
    small, _ = maybe_broadcast(others, ["token"], max_broadcast_bytes, extra=F.lit(48))
    whole = (near.join(small, ["token", "line_no", "pos"]).groupBy("term_no", "n_toks", "line_no", *CARRY, "first")
             .agg(F.count(F.lit(1)).alias("same")).filter(F.col("same") == F.col("n_toks") - 1))
    return hits.unionByName(whole.select(*keep))


def _per_document(index: Index, terms: DataFrame, max_broadcast_bytes: int | None, only: DataFrame | None, positions: bool) -> DataFrame:
    once, same = (terms, None) if only is not None else distinct_phrases(terms, max_broadcast_bytes)
    looked_up = _looked_up(index, once, max_broadcast_bytes)
    many = _many(index, *looked_up[1:])
    phrases = NB.Phrases.of(once.filter("n_toks > 0"), max_broadcast_bytes) if many else None
    if phrases is not None:
        # a phrase table of small measured size is compared with neighbours where a document's occurrences meet
        found = index.postings.filter(F.col("bucket").isin(buckets_of(looked_up[0], index.buckets))).select("token", "line_no", "pos")
        hits = NB.hits(found, index.docs, phrases, index.n_docs * index.avgdl, positions, only, max_broadcast_bytes)
        return for_each_term(hits.withColumn("term_no", F.col("term_no").cast(terms.schema["term_no"].dataType)), same)
    more = [F.sort_array(F.collect_list("first")).alias("starts"), F.min("first").alias("first_pos")] if positions else []
    parts = [m.groupBy("term_no", "line_no", *CARRY).agg(F.count(F.lit(1)).alias("tf"), *more)
             for m in _matched(index, once, max_broadcast_bytes, only, looked_up, many)]
    return for_each_term(parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1]), same)


def phrase_counts(index: Index, terms: DataFrame, max_broadcast_bytes: int | None = None) -> DataFrame:
    """(term_no, line_no, tf, n_tokens, score, docid): documents and occurrences, without positions."""
    return _per_document(index, terms, max_broadcast_bytes, None, False)


def phrase_hits(index: Index, terms: DataFrame, max_broadcast_bytes: int | None = None,
                only: DataFrame | None = None) -> DataFrame:
    """QRY-2: (term_no, line_no, tf, starts, first_pos, n_tokens, score, docid), as the
    n-gram search gives them; ``terms`` must be normalised."""
    return _per_document(index, terms, max_broadcast_bytes, only, True)
