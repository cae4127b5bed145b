"""Language-model scores: a stupid-backoff model of the whole corpus, applied to each of its documents.

Documents are put in blocks of a few megabytes, which keep the hashes of their words and not the texts. A block's n-grams
are hashed, sorted and counted, and the sorted array is cut into parts by ranges of the hash: what travels is one row for
each block and part, with all its n-grams, and not one row for each n-gram. The rows of a part meet in one group, which adds the counts up and answers each row with an
array in the same order: how often other blocks have its n-grams. The block sorts its n-grams once more, lays the
answers beside them, and sums every document.

The parts are worked off in SLICES, one after the other. A slice leaves its answers, which are small, and its shuffle files
go before the next one begins.

With c the counts in all other documents (a document's own occurrences are left out at every order), a word w after
its context v of up to ORDER - 1 words has

    S(w | v) = c(v w) / c(v) if c(v w) > 0, else BACKOFF S(w | v without its first word)

and, at the end, S(w) = max(c(w), UNSEEN) / c(all words). N-grams are known by 64-bit hashes.
"""

from __future__ import annotations

import math
from contextlib import ExitStack
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsefold.sources.scratch import bucketed, shuffles_removed, temporary

from .base import text_of, written
from .kernels import grams, texts_of

#: Longest n-gram, the factor of a step back, the count of a word that no other document has.
ORDER, BACKOFF, UNSEEN = 3, 0.4, 0.5
#: Bytes of text in a block, and documents in it, at most; a longer text is a block of its own.
BLOCK, BLOCK_DOCUMENTS = 8 << 20, 1 << 14
#: Slices of the n-grams, and the words of a corpus for which one more slice is worth it.
SLICES, SLICE_WORDS = 3, 1 << 19
#: N-grams in a part, about; n-grams are dealt by their hashes, and a block has each of them once.
PART = 1 << 21
#: Bytes of text in a bucket of blocks, about.
BUCKET = 16 << 20
#: Logarithms are added up as whole numbers of this unit, so that their order does not matter.
UNIT = 1e-6


def _blocked(batches):
    """(block, id, words, n_words), words: their hashes. Blocks are named by task and number; they are kept, so a name stays what it is."""
    task, number, size, rows = TaskContext.get().partitionId(), 0, 0, 0
    for batch in batches:
        for first, last, t in texts_of(batch.column(1)):
            counts, names = t.words_per_text(), np.empty(last - first, np.int64)
            for i, own in enumerate(np.diff(t.bounds).tolist()):
                if rows and (size + own > BLOCK or rows == BLOCK_DOCUMENTS):
                    number, size, rows = number + 1, 0, 0
                size, rows = size + own, rows + 1
                names[i] = (task << 32) + number
            columns = [pa.array(names), batch.column(0).slice(first, last - first), _packed(t.hashes(), counts), pa.array(counts, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["block", "id", "words", "n_words"])


def _words(texts: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text and hash of each word, words of each text) of a block."""
    sizes = texts["n_words"].to_numpy()
    return np.repeat(np.arange(len(sizes)), sizes), _unpacked(texts["words"], np.uint64), sizes


def _grams(words: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(last words, hashes) of all n-grams."""
    hashes, at = grams(words ^ np.uint64(n), doc, n)
    return at + n - 1, hashes


def _parts(grams: np.ndarray, parts: int) -> np.ndarray:
    """The part of each n-gram; sorted n-grams have sorted parts."""
    return ((grams >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Where runs of equal rows begin, and the number of rows at the end."""
    n = len(columns[0])
    new = np.ones(n + 1, bool)
    if n:
        new[1:n] = reduce(np.logical_or, (x[1:] != x[:-1] for x in columns))
    return np.flatnonzero(new)


def _packed(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Binary values of `lengths` numbers each."""
    offsets = np.concatenate([[0], np.cumsum(lengths)]) * values.itemsize
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())


def _unpacked(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    """The numbers of binary values in a row."""
    return np.concatenate([np.empty(0, kind), *(_numbers(x, kind) for x in column.chunks)])


def _numbers(column: pa.Array, kind: type) -> np.ndarray:
    if not len(column):
        return np.empty(0, kind)
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]].view(kind)


def _cut(texts: pa.Table, order: int, parts: int, low: int, high: int) -> pa.Table:
    """(part, block, n, size, grams, counts) of the n-grams of a block in the parts from `low` to before `high`, sorted by their hashes."""
    doc, words, _ = _words(texts)
    block, rows = texts["block"][0].as_py(), []
    for n in range(1, order + 1):
        _, found = _grams(words, doc, n)
        part = _parts(found, parts)
        found = np.sort(found[(part >= low) & (part < high)])
        at = _runs(found)
        own, counts = found[at[:-1]], np.diff(at).astype(np.int32)
        part = _parts(own, parts).astype(np.int64)
        cut = _runs(part)
        sizes = np.diff(cut)
        same = lambda x, kind: pa.array(np.full(len(sizes), x), kind)  # noqa: B023, E731
        rows.append([pa.array(part[cut[:-1]]), same(block, pa.int64()), same(n, pa.int32()), pa.array(sizes, pa.int64()), _packed(own, sizes), _packed(counts, sizes)])
    names = ["part", "block", "n", "size", "grams", "counts"]
    return pa.concat_tables([pa.Table.from_arrays(x, names=names) for x in rows])


def _added(rows: pa.Table) -> pa.Table:
    """(block, n, part, size, elsewhere) of the rows of a part: how often other blocks have each n-gram of a row."""
    found, counts = _unpacked(rows["grams"], np.uint64), _unpacked(rows["counts"], np.int32).astype(np.int64)
    order = np.argsort(found)
    at = _runs(found[order])
    totals = np.add.reduceat(counts[order], at[:-1]) if len(found) else counts
    elsewhere = np.empty(len(found), np.int64)
    elsewhere[order] = np.repeat(totals, np.diff(at))
    elsewhere -= counts
    return pa.table({**{x: rows[x] for x in ("block", "n", "part", "size")}, "elsewhere": _packed(elsewhere, rows["size"].to_numpy())})


def _by_hash(hashes: np.ndarray) -> np.ndarray:
    """The stable order of hashes, from one sort of their high bits with the places below; where those bits don't tell apart, by argsort."""
    bits = np.uint64(len(hashes).bit_length())
    places = np.arange(len(hashes), dtype=np.uint64)
    order = (np.sort(((hashes >> bits) << bits) | places) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    ordered = hashes[order]
    return order if (ordered[1:] >= ordered[:-1]).all() else np.argsort(hashes, kind="stable")


def _counts(doc: np.ndarray, hashes: np.ndarray, elsewhere: np.ndarray) -> np.ndarray:
    """How often all other texts have each n-gram of a block; elsewhere: how often other blocks have it, by its hash."""
    order = _by_hash(hashes)  # so the occurrences of an n-gram stay in the order of their texts
    g = hashes[order]
    at, own = np.diff(_runs(g)), np.diff(_runs(g, doc[order]))
    if len(at) != len(elsewhere):
        raise ValueError(f"{len(elsewhere)} answers for {len(at)} n-grams")
    out = np.empty(len(g), np.int64)
    out[order] = np.repeat(elsewhere + at, at) - np.repeat(own, own)
    return out


def _scores(texts: pa.Table, answers: pa.Table, all_words: int, order: int, backoff: float) -> np.ndarray:
    """The score of each text of a block, in UNITs."""
    doc, words, sizes = _words(texts)
    place = np.arange(len(doc)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    value, level = np.zeros(len(doc)), np.zeros(len(doc), np.int64)
    answers = answers.sort_by([("n", "ascending"), ("part", "ascending")])
    numbers, before = answers["n"].to_numpy(), np.zeros(0, np.int64)
    for n in range(1, order + 1):
        at, found = _grams(words, doc, n)
        first, last = np.searchsorted(numbers, [n, n + 1])
        c = np.zeros(len(doc), np.int64)
        c[at] = _counts(doc[at], found, _unpacked(answers["elsewhere"].slice(first, last - first), np.int64))
        if n == 1:
            value = np.log(np.maximum(c, UNSEEN)) - np.log(np.maximum(all_words - sizes, 1))[doc]
        else:
            seen = np.flatnonzero(c > 0)
            value[seen] = np.log(c[seen]) - np.log(before[seen - 1])
            level[seen] = n - 1
        before = c
    value += (np.minimum(place, order - 1) - level) * math.log(backoff)  # steps back to the single word
    out = np.zeros(len(sizes), np.int64)
    np.add.at(out, doc, np.rint(value / UNIT).astype(np.int64))
    return out


def score(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", backoff: float = BACKOFF, order: int = ORDER) -> DataFrame:
    """(id, n_words, log_score, mean_log_score), one row per row of `df`.

    Words are split at white space. A null or empty text has no words, the score 0 and a null mean. Repeated rows
    count as other documents for each other, and ids need not be unique. Texts are scored whole. An empty table
    gives an empty one. Other columns are left out.
    """
    kind = df.schema[id_column].dataType.simpleString()
    spark = df.sparkSession
    slim = df.select(F.col(id_column).alias("id"), text_of(text_column).alias("text"))
    n_bytes = slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    with shuffles_removed(spark), ExitStack() as kept:
        blocks = kept.enter_context(bucketed(slim.mapInArrow(_blocked, f"block long, id {kind}, words binary, n_words long"), "block", max(tasks, n_bytes // BUCKET + 1)))
        all_words = blocks.agg(F.sum("n_words")).first()[0] or 0
        slices = min(SLICES, 1 + all_words // SLICE_WORDS)
        each = max(tasks, order * all_words // (slices * PART) + 1)
        answers = reduce(DataFrame.unionAll, [kept.enter_context(_slice(blocks, order, slices * each, turn * each, (turn + 1) * each)) for turn in range(slices)])

        def scored(texts: pa.Table, answers: pa.Table) -> pa.Table:
            units = _scores(texts, answers, all_words, order, backoff)
            return pa.table({"id": texts["id"], "n_words": texts["n_words"], "units": pa.array(units, pa.int64())})

        out = written(blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(scored, f"id {kind}, n_words long, units long"))
    out = out.withColumn("log_score", F.col("units") / F.lit(1 / UNIT))
    return out.select("id", "n_words", "log_score", F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words")).alias("mean_log_score"))


def _slice(blocks: DataFrame, order: int, parts: int, low: int, high: int):
    """(block, n, part, size, elsewhere) of the parts from `low` to before `high`, kept for as long as the block lasts."""
    rows = blocks.select("block", "words", "n_words").groupBy("block").applyInArrow(lambda texts: _cut(texts, order, parts, low, high), "part long, block long, n int, size long, grams binary, counts binary")
    return temporary(rows.groupBy("part").applyInArrow(_added, "block long, n int, part long, size long, elsewhere binary"), "zstd")


ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
n AS (SELECT sum(len(w)) AS words FROM d),
t AS (SELECT r, unnest(range(1, len(w) + 1)) AS i, w FROM d),
k AS (
  SELECT r, i, w[i] AS a, CASE WHEN i > 1 THEN w[i - 1] || ' ' || w[i] END AS b, CASE WHEN i > 2 THEN w[i - 2] || ' ' || w[i - 1] || ' ' || w[i] END AS c FROM t),
o AS (
  SELECT r, i, count(*) OVER (PARTITION BY a) - count(*) OVER (PARTITION BY r, a) AS a,
         CASE WHEN b IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY b) - count(*) OVER (PARTITION BY r, b) END AS b,
         CASE WHEN c IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY c) - count(*) OVER (PARTITION BY r, c) END AS c
  FROM k),
x AS (SELECT *, lag(a) OVER (PARTITION BY r ORDER BY i) AS before_a, lag(b) OVER (PARTITION BY r ORDER BY i) AS before_b FROM o),
v AS (
  SELECT x.r, CASE WHEN c > 0 THEN ln(c) - ln(before_b)
              WHEN b > 0 THEN ln(b) - ln(before_a) + (least(i - 1, 2) - 1) * {math.log(BACKOFF)!r}::DOUBLE
              ELSE ln(greatest(a::DOUBLE, {UNSEEN!r}::DOUBLE)) - ln(greatest(n.words - len(d.w), 1)) + least(i - 1, 2) * {math.log(BACKOFF)!r}::DOUBLE END AS s
  FROM x JOIN d ON d.r = x.r, n),
s AS (SELECT r, sum(CAST(round(s / {UNIT!r}::DOUBLE) AS BIGINT)) AS units FROM v GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(units, 0)::DOUBLE / {1 / UNIT!r}::DOUBLE AS log_score,
       CASE WHEN len(w) > 0 THEN units::DOUBLE / {1 / UNIT!r}::DOUBLE / len(w) END AS mean_log_score
FROM d LEFT JOIN s ON s.r = d.r
"""
