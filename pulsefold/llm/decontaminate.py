"""Benchmark decontamination: SimHash fingerprints of item-sized windows, matched by Hamming blocks and verified.

A window is as many words of a document as an item has, or the whole document where it has fewer. Its fingerprint and the item's are compared only if
they agree, up to SLACK bits, in one of BLOCKS blocks, which holds for all fingerprints within RADIUS. The pairs
that remain are verified by the weighted Jaccard similarity of their word-shingle multisets.

A window that reaches the similarity s shares at least the share s of its shingles with its item. Windows
with fewer shingles of any benchmark item are not fingerprinted: a bit table, set for the hashes of all items' shingles,
tells them apart, and can only err towards more windows. It has 16 bits for a shingle, up to a largest size. Of windows and items
the fewer are written under every mask of a block, so that the join's rows follow the smaller side.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import small_or_plain, text_of, written
from .kernels import grams, lists, texts_of

#: Words of a shingle and least similarity.
WORDS, SIMILARITY = 5, 0.8
#: Bits of a fingerprint, its blocks, bits by which a block may differ, and the radius that this guarantees.
BITS, BLOCKS, SLACK = 64, 4, 3
RADIUS = BLOCKS * (SLACK + 1) - 1
#: Bits of the table of item shingles: for each of them, at least and at most.
BITS_EACH, LEAST_BITS, MOST_BITS = 16, 1 << 23, 1 << 30

_WIDTH = BITS // BLOCKS
_MASKS = [sum(1 << b for b in bits) for n in range(SLACK + 1) for bits in combinations(range(_WIDTH), n)]


def _shingle_size(n_words: np.ndarray | int) -> np.ndarray | int:
    return np.minimum(n_words, WORDS)


def simhash(elements: np.ndarray) -> np.ndarray:
    """The fingerprint of each row of (m, k) shingle hashes; each occurrence has the weight 1."""
    bits = np.unpackbits(np.ascontiguousarray(elements).view(np.uint8).reshape(*elements.shape, 8), axis=-1)
    return np.packbits(bits.sum(axis=1, dtype=np.int32) * 2 > elements.shape[1], axis=-1).view(np.uint64).ravel()


def _items(batches):
    for batch in batches:
        for first, last, t in texts_of(batch.column(1)):
            words, counts = t.hashes(fold=True), t.words_per_text()
            ends = np.cumsum(counts)
            keep, all_elements = [], []
            for i in np.flatnonzero(counts):
                own = words[ends[i] - counts[i] : ends[i]]
                keep.append(i)
                all_elements.append(grams(own, np.zeros(len(own), np.int64), int(_shingle_size(len(own))))[0])
            prints = np.array([simhash(x[None])[0] for x in all_elements], np.uint64)
            rows = pa.array(np.array(keep, np.int64))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(first, last - first).take(rows),
                    pa.array(counts[keep].astype(np.int32)),
                    pa.array(prints.view(np.int64)),
                    lists(np.concatenate([np.empty(0, np.uint64), *all_elements]).view(np.int64), np.array([len(x) for x in all_elements], np.int64), pa.int64()),
                ],
                names=["item_id", "n", "print", "elements"],
            )


def items_of(benchmark: DataFrame, item_column: str = "item_id", text_column: str = "text") -> DataFrame:
    """(item_id, n, print, elements) of the items with a word."""
    kind = benchmark.schema[item_column].dataType.simpleString()
    return benchmark.select(F.col(item_column).alias("item_id"), text_of(text_column)).mapInArrow(_items, f"item_id {kind}, n int, print long, elements array<long>")


def _bit_table(items: DataFrame) -> np.ndarray:
    """The table of all items' shingles, a power of two of bits; its largest size bounds what is read from Spark and broadcast."""
    shingles = items.agg(F.sum(F.size("elements"))).first()[0] or 0
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (BITS_EACH * shingles - 1).bit_length() if shingles else 0))
    slot = F.pmod("element", F.lit(bits))
    slots = items.select(F.explode("elements").alias("element")).select(F.floor(slot / 32768).alias("part"), F.pmod(slot, F.lit(32768)).alias("bit"))
    table = bytearray(bits // 8)
    for row in slots.groupBy("part").agg(F.bitmap_construct_agg("bit").alias("bits")).toLocalIterator():
        table[row["part"] * 4096 : row["part"] * 4096 + 4096] = row["bits"]
    return np.frombuffer(bytes(table), np.uint8)


def windows(df: DataFrame, sizes: list[int], table: np.ndarray, similarity: float) -> DataFrame:
    """(id, key, start, n, print, elements): windows of df (id, key, text) with enough shingles in the table.

    n is the number of words of the items that a window is for; a whole document may have fewer.
    """
    shared = df.sparkSession.sparkContext.broadcast((sizes, table))

    def run(batches):
        sizes, table = shared.value
        for batch in batches:
            for first, last, t in texts_of(batch.column(2)):
                words = t.hashes(fold=True)
                size = t.words_per_text()
                ends = np.cumsum(size)
                at_doc, at_start, at_n, prints, elements, counts = [], [], [], [], [], []
                for k in sorted({int(_shingle_size(n)) for n in sizes}):
                    own = [n for n in sizes if _shingle_size(n) == k]
                    g, at = grams(words, t.doc, k)
                    slot = g.view(np.int64) % (8 * len(table))
                    hit = table[slot >> 3] >> (slot & 7).astype(np.uint8) & 1
                    if not hit.any():
                        continue
                    full = np.zeros(len(words), np.int64)
                    full[at] = hit
                    by_word = np.zeros(len(words), np.uint64)
                    by_word[at] = g
                    sums = np.concatenate([[0], np.cumsum(full)])
                    near = np.flatnonzero(full)
                    for n in own:
                        m = n - k + 1
                        # a window with enough hits starts at most m - least words before a hit
                        least = int(np.ceil(similarity * m - 1e-9))
                        start = np.unique((near[:, None] - np.arange(m - least + 1)[None, :]).ravel()) if len(near) * (m - least + 1) < len(words) else np.arange(len(words))
                        start = start[start >= 0]
                        start = start[start + n <= ends[t.doc[start]]]
                        start = start[sums[start + m] - sums[start] >= least]
                        taken = [(part, m) for part in np.array_split(start, max(1, len(start) * m // 65536))]
                        # documents with fewer words than the item, but enough shingles
                        brief = np.flatnonzero((size < n) & (size >= max(least, 1) + k - 1))
                        for words_of_doc in np.unique(size[brief]):
                            own_m = int(words_of_doc) - k + 1
                            first_word = (ends - size)[brief[size[brief] == words_of_doc]]
                            taken.append((first_word[sums[first_word + own_m] - sums[first_word] >= least], own_m))
                        for part, of in taken:
                            if len(part):
                                e = by_word[part[:, None] + np.arange(of)]
                                at_doc.append(t.doc[part])
                                at_start.append(part - (ends - size)[t.doc[part]])
                                at_n.append(np.full(len(part), n, np.int32))
                                prints.append(simhash(e))
                                elements.append(e.ravel())
                                counts.append(np.full(len(part), of))
                if at_doc:
                    rows = pa.array(np.concatenate(at_doc))
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).slice(first, last - first).take(rows),
                            batch.column(1).slice(first, last - first).take(rows),
                            pa.array(np.concatenate(at_start)),
                            pa.array(np.concatenate(at_n)),
                            pa.array(np.concatenate(prints).view(np.int64)),
                            lists(np.concatenate(elements).view(np.int64), np.concatenate(counts), pa.int64()),
                        ],
                        names=["id", "key", "start", "n", "print", "elements"],
                    )

    kind = df.schema["id"].dataType.simpleString()
    return df.mapInArrow(run, f"id {kind}, key binary, start long, n int, print long, elements array<long>")


def _block(print_, i: int):
    return F.shiftrightunsigned(print_, i * _WIDTH).bitwiseAND(F.lit((1 << _WIDTH) - 1))


def _verified(pairs: DataFrame, similarity: float) -> DataFrame:
    def run(batches):
        for batch in batches:
            out = []
            for x, y in zip(batch.column("elements"), batch.column("item_elements"), strict=True):
                (e, v), (f, w) = (np.unique(np.asarray(s.values), return_counts=True) for s in (x, y))
                _, i, j = np.intersect1d(e, f, assume_unique=True, return_indices=True)
                common = int(np.minimum(v[i], w[j]).sum())
                out.append(common / (int(v.sum()) + int(w.sum()) - common))
            out = np.array(out)
            keep = pa.array(out >= similarity)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "key", "start", "n", "item_id")), pa.array(out)], names=["id", "key", "start", "n", "item_id", "similarity"]).filter(keep)

    kinds = {f.name: f.dataType.simpleString() for f in pairs.schema}
    return pairs.mapInArrow(run, f"id {kinds['id']}, key binary, start long, n int, item_id {kinds['item_id']}, similarity double")


def leaks(
    df: DataFrame,
    benchmark: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_column: str = "item_id",
    item_text_column: str = "text",
    similarity: float = SIMILARITY,
) -> DataFrame:
    """(id, key, item_id, similarity, start, n): the best window of each document and item that it holds.

    Words are split at white space, with A-Z as a-z. start is the window's first word, n its words; key is the MD5
    of the text. An item of fewer than WORDS words has one shingle, all its words. A document
    of fewer words than an item is that item's one window. Items without a word match
    nothing, and a null or empty text holds nothing. Documents are read whole. Rows with equal id and text give
    one row; rows with equal id and different texts one each, told apart by key. Empty tables on either side
    give an empty table, as do other columns of any name, which are not read.
    """
    items = written(items_of(benchmark, item_column, item_text_column))
    sizes = [r["n"] for r in items.select("n").distinct().orderBy("n").collect()]  # as many as items have lengths
    slim = df.select(F.col(id_column).alias("id"), F.unhex(F.md5(text_of(text_column))).alias("key"), text_of(text_column).alias("text"))
    found = written(windows(slim, sizes, _bit_table(items), similarity))
    blocks = lambda p: F.array(*[F.struct(F.lit(i).alias("block"), _block(p, i).alias("value")) for i in range(BLOCKS)])
    asked = written(found.select("n", "print").distinct())
    known = items.select("item_id", "n", F.col("print").alias("item_print"))
    cut = lambda p: F.explode(blocks(F.col(p))).alias("b")
    # a block that differs by SLACK bits at most is the other one's under some mask
    masked = F.explode(F.transform(F.array(*map(F.lit, _MASKS)), lambda m: F.col("b.value").bitwiseXOR(m.cast("long")))).alias("value")
    few = asked.count() < known.count()
    one = asked.select("n", "print", cut("print")).select("n", "print", F.col("b.block").alias("block"), masked if few else F.col("b.value").alias("value"))
    two = known.select("item_id", "n", "item_print", cut("item_print")).select("item_id", "n", "item_print", F.col("b.block").alias("block"), F.col("b.value").alias("value") if few else masked)
    met = one.join(two, ["n", "block", "value"])
    met = met.filter(F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))) <= RADIUS).select("n", "print", "item_id").distinct()
    pairs = found.join(met, ["n", "print"]).join(items.select("item_id", F.col("elements").alias("item_elements")), "item_id")
    own = (F.size("elements") + F.least("n", F.lit(WORDS)) - 1).alias("n")  # words of the window
    pairs = pairs.select("id", "key", "start", own, "item_id", "elements", "item_elements")
    best = F.max_by(F.struct("similarity", "start", "n"), F.struct("similarity", -F.col("start"), -F.col("n")))
    return _verified(pairs, similarity).groupBy("id", "key", "item_id").agg(best.alias("best")).select("id", "key", "item_id", "best.similarity", "best.start", "best.n")


def clean(df: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text", similarity: float = SIMILARITY, **columns: str) -> DataFrame:
    """The rows of `df` whose text holds no benchmark item."""
    found = written(leaks(df, benchmark, id_column, text_column, similarity=similarity, **columns).select(F.col("key").alias("__of")).distinct())
    keyed = df.withColumn("__key", F.unhex(F.md5(text_of(text_column))))
    return keyed.join(small_or_plain(found), F.col("__key") == F.col("__of"), "left_anti").drop("__key")
