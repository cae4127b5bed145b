"""Near-duplicate classes: BagMinHash signatures of word-shingle multisets, banded, then verified by multiset overlap.

Texts are told apart by their MD5, so exact copies are one node from the start. Nodes that agree in a band share
a bucket; a pair of similarity 0.8 agrees in none of the 30 bands with a probability of 1e-4.

A bucket can hold a large group, so its pairs are never listed. Its members are compared with one of them, the
hub: the member that shares most bucket places, which for near copies of one text is the text nearest to them all.
That joins nearly all groups to one component. Only the texts of buckets that still hold several components are
looked at again: the shingles of each, a shingle that stands w times taken as w elements, are put in order, those
that fewest of these texts have first. Two texts that reach the similarity must then have one of their first
elements in common (prefix filter), with enough elements after it on either side (position filter). The elements that
no other text has come first and meet nothing, so texts that share a long passage but have much of their own are
never paired. Pairs within a component are not made at all. What is left is verified.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bagminhash import bands, signatures
from .base import held, small_or_plain, text_of, written
from .graph import components
from .kernels import counted, lists, mixed, shingles, texts_of

#: Words of a shingle, least similarity, registers of a signature and registers of a band.
WORDS, SIMILARITY, REGISTERS, ROWS = 5, 0.8, 180, 6
#: Rows of one join key that go to one task; a key with more is dealt to several.
SPLIT = 1024
#: Bits of the table that lets through the texts whose shingles are needed.
FILTER_BITS = 1 << 23
#: Slack for bounds that are taken in doubles; the comparison of a pair is exact.
SLACK = 1e-6


def _bags(strings: pa.Array) -> Iterator[tuple[int, int, int, tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    for first, last, t in texts_of(strings):
        yield first, last, t.n, counted(*shingles(t, t.hashes(), WORDS))


def _signed(registers: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, n, (doc, element, weight) in _bags(batch.column(2)):
                some = np.flatnonzero(np.bincount(doc, minlength=n))
                keys = bands(signatures(doc, element, weight, n, registers)[some], rows).view(np.int64)
                part = batch.slice(first, last - first).take(pa.array(some))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), lists(keys.ravel(), np.full(len(some), keys.shape[1]), pa.int64())], names=["id", "key", "bands"])

    return run


def content_key(column: str) -> Column:
    """The MD5 of the text, as 16 bytes."""
    return F.unhex(F.md5(text_of(column)))


def _slot(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(FILTER_BITS))


def _bit_table(keys: DataFrame) -> bytes:
    """A table of FILTER_BITS bits, one set for each key. Its size does not depend on the number of keys."""
    slot = _slot(F.col("key"))
    parts = keys.select((F.floor(slot / 32768)).alias("part"), F.pmod(slot, F.lit(32768)).alias("bit")).groupBy("part").agg(F.bitmap_construct_agg("bit").alias("bits"))
    table = bytearray(FILTER_BITS // 8)
    for row in parts.toLocalIterator():
        table[row["part"] * 4096 : row["part"] * 4096 + 4096] = row["bits"]
    return bytes(table)


def _bags_of(df: DataFrame, keys: DataFrame, text_column: str) -> DataFrame:
    """(key, element, weight): the shingle multisets of the texts with one of `keys`."""
    table = df.sparkSession.sparkContext.broadcast(_bit_table(keys))

    def run(batches):
        bits = np.frombuffer(table.value, np.uint8)
        for batch in batches:
            slot = batch.column(2).to_numpy()
            batch = batch.take(pa.array(np.flatnonzero(bits[slot >> 3] >> (slot & 7) & 1)))
            for first, last, n, (doc, element, weight) in _bags(batch.column(1)):
                sizes = np.bincount(doc, minlength=n)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), lists(element.view(np.int64), sizes, pa.int64()), lists(weight, sizes, pa.int32())], names=["key", "element", "weight"])

    texts = df.select(content_key(text_column).alias("key"), text_of(text_column).alias("text")).withColumn("slot", _slot(F.col("key")))
    bags = texts.mapInArrow(run, "key binary, element array<long>, weight array<int>")
    # copies of a text are one bag, and each task sends it once
    single = bags.groupBy("key").agg(F.first("element").alias("element"), F.first("weight").alias("weight"))
    return written(single.join(keys.select("key"), "key", "left_semi"))


def _parts(n: Column) -> Column:
    """Over how many tasks `n` rows of one key are dealt."""
    return F.ceil(n / SPLIT).cast("int")


def _dealt(key: str, parts: Column) -> Column:
    return F.pmod(F.xxhash64(key), parts.cast("long")).cast("int")


def _linked_pairs(pairs: DataFrame, bags: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) that reach the similarity. An `a` with many partners is dealt to several tasks."""
    many = small_or_plain(held(pairs.groupBy("a").agg(_parts(F.count("*")).alias("parts")).filter("parts > 1")))
    parts = F.coalesce("parts", F.lit(1))
    dealt = pairs.join(many, "a", "left").select("a", "b", _dealt("b", parts).alias("part"))
    bag = lambda c: bags.select(F.col("key").alias(c), F.struct("element", "weight").alias(f"bag_{c}"))
    # a bag of `a` stands once in each of its tasks
    first = bag("a").join(many, "a", "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    both = dealt.join(first, ["a", "part"]).join(bag("b"), "b")

    def run(batches):
        for batch in batches:
            linked = np.zeros(len(batch), bool)
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                (e, v), (f, w) = ((np.asarray(s["element"].values), np.asarray(s["weight"].values)) for s in (x, y))
                _, at, of = np.intersect1d(e, f, assume_unique=True, return_indices=True)
                common = int(np.minimum(v[at], w[of]).sum())
                linked[i] = common >= similarity * (int(v.sum()) + int(w.sum()) - common)
            yield batch.select(["a", "b"]).filter(pa.array(linked))

    return held(both.select("a", "b", "bag_a", "bag_b").mapInArrow(run, "a binary, b binary"))


def _labelled(df: DataFrame, labels: DataFrame, key: str, label: str) -> DataFrame:
    """`df` with the component of its column `key`: the node itself where it has no link."""
    of = labels.select(F.col("node").alias("__node"), F.col("label").alias("__label"))
    return df.join(of, F.col(key) == F.col("__node"), "left").withColumn(label, F.coalesce("__label", key)).drop("__node", "__label")


def _elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, label, size, elements): a shingle of weight w as w elements."""
    for batch in batches:
        for i in range(len(batch)):
            element, weight = (np.asarray(batch.column(c)[i].values) for c in (2, 3))
            copy = np.arange(weight.sum()) - np.repeat(np.cumsum(weight) - weight, weight)
            out = mixed(np.repeat(element.view(np.uint64), weight) + copy.astype(np.uint64)).view(np.int64)
            n = np.array([len(out)])
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), batch.column(1).slice(i, 1), pa.array(n), lists(out, n, pa.int64())], names=["key", "label", "size", "elements"])


def _candidates(bags: DataFrame, open_: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of the texts `open_` (key, label) with different labels that pass the filters.

    Of texts x and y, y not the smaller one, that reach the similarity s, each shares s / (1 + s) (size_x + size_y)
    elements with the other at least. So one stands among the first size_y - s size_y + 1 of y, and among the first
    size_x - 2 s / (1 + s) size_x + 1 of x, and of the first such one the elements that follow make up the rest.
    """
    bag = bags.join(open_, "key").select("key", "label", "element", "weight")
    each = bag.mapInArrow(_elements, "key binary, label binary, size long, elements array<long>")
    rows = written(each.select("key", "label", "size", F.explode("elements").alias("element")))
    # elements of one text alone come first, and need no row; those of one component alone pair nothing
    common = rows.groupBy("element").agg(F.count("*").alias("n"), (F.min("label") < F.max("label")).alias("meets")).filter("n > 1")
    own = Window.partitionBy("key")
    placed = (
        rows.join(common, "element")
        .withColumn("place", F.row_number().over(own.orderBy("n", "element")) + F.col("size") - F.count("*").over(own) - 1)
        .filter(F.col("meets") & (F.col("place") <= F.col("size") * (1 - similarity) + SLACK))
        .select("element", "key", "label", "size", "place")
    )
    placed = held(placed)
    by_label = placed.groupBy("element", "label").agg(F.count("*").alias("n"))
    # of two labels one is not the element's most frequent, so rows of that one needn't meet each other
    top = by_label.groupBy("element").agg(F.max_by("label", F.struct("n", "label")).alias("top"), F.count("*").alias("labels")).filter("labels > 1").drop("labels")
    marked = held(placed.join(top, "element").withColumn("top", F.col("label") == F.col("top")))
    share = 2 * similarity / (1 + similarity)
    x = marked.filter(F.col("place") <= F.col("size") * (1 - share) + SLACK).alias("x")
    y = marked.alias("y")
    smaller = F.struct("x.size", "x.key") < F.struct("y.size", "y.key")
    least = similarity / (1 + similarity) * (F.col("x.size") + F.col("y.size")) - SLACK
    fits = (
        (F.col("x.element") == F.col("y.element"))
        & (F.col("x.label") != F.col("y.label"))
        & smaller
        & (F.col("x.size") >= similarity * F.col("y.size") - SLACK)
        & (F.least(F.col("x.size") - F.col("x.place"), F.col("y.size") - F.col("y.place")) >= least)
    )
    met = x.filter("NOT x.top").join(y, fits).select("x.key", "y.key").union(x.filter("x.top").join(y.filter("NOT y.top"), fits).select("x.key", "y.key"))
    return met.toDF("a", "b").distinct()


def _linked(df: DataFrame, buckets: DataFrame, text_column: str, similarity: float) -> DataFrame:
    """The components (node, label) of the links between keys that share one of `buckets` (bucket, key)."""
    sizes = buckets.groupBy("bucket").agg(F.count("*").alias("members")).filter("members > 1")
    live = written(buckets.join(sizes, "bucket"))
    weight = live.groupBy("key").agg(F.sum("members").alias("weight"))
    hubs = live.join(weight, "key").groupBy("bucket").agg(F.max(F.struct("weight", "key"))["key"].alias("hub"), F.first("members").alias("members"))
    # a large bucket is dealt to several tasks, each of which has the hub
    dealt = hubs.select("bucket", "hub", F.explode(F.sequence(F.lit(0), _parts(F.col("members")) - 1)).alias("part"))
    met = live.withColumn("part", _dealt("key", _parts(F.col("members")))).join(dealt, ["bucket", "part"])
    pairs = held(met.filter(F.col("key") != F.col("hub")).select(F.col("hub").alias("a"), F.col("key").alias("b")).distinct())
    bags = _bags_of(df, live.select("key").distinct(), text_column)
    links = _linked_pairs(pairs, bags, similarity)
    labels = components(links)
    named = _labelled(live.select("bucket", "key"), labels, "key", "label")
    divided = named.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high").select("bucket")
    open_ = held(named.join(divided, "bucket", "left_semi").select("key", "label").distinct())
    more = _linked_pairs(held(_candidates(bags, open_, similarity)), bags, similarity)
    return components(links.unionByName(more))


def classes(
    df: DataFrame, id_column: str = "doc_id", text_column: str = "text", similarity: float = SIMILARITY, registers: int = REGISTERS, band: int = ROWS
) -> tuple[DataFrame, DataFrame]:
    """(rows, contents): rows has id, key of each row with a word; contents has key, class_id, chief of each distinct text.

    class_id is the least id of the texts linked, directly or through others, by a similarity of `similarity`
    or more, and chief the key of the text that has it (the least key of several). Texts of fewer than WORDS words
    have one shingle, all their words. `band` of the `registers` of a signature make a band.
    """
    slim = df.select(F.col(id_column).alias("id"), content_key(text_column).alias("key"), text_of(text_column).alias("text"))
    rows = written(slim.mapInArrow(_signed(registers, band), f"id {df.schema[id_column].dataType.simpleString()}, key binary, bands array<long>"))
    signed = written(rows.groupBy("key").agg(F.min("id").alias("least"), F.first("bands").alias("bands")))
    buckets = signed.select(F.posexplode("bands").alias("band", "value"), "key").select(F.xxhash64("band", "value").alias("bucket"), "key")
    labels = _linked(df, buckets, text_column, similarity)
    named = held(_labelled(signed.select("key", "least"), labels, "key", "label"))
    lowest = named.groupBy("label").agg(F.min(F.struct(F.col("least").isNull().alias("unnamed"), "least", "key")).alias("first"))
    chief = lowest.select("label", F.col("first.least").alias("class_id"), F.col("first.key").alias("chief"))
    return rows.select("id", "key"), written(named.join(chief, "label").select("key", "class_id", "chief"))


def mark(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """`df` with class_id: the least id of the row's class of exact and near copies.

    A null or empty text, or one of white space only, is a copy of nothing: its class is its own id. Repeated
    rows share a class. A null id never names a class unless all ids of the class are null. Very long texts are
    compared whole. An empty table gives an empty one. An input column class_id is replaced.
    """
    df = df.drop(*[c for c in df.columns if c == "class_id"])
    _, contents = classes(df, id_column, text_column, similarity)
    keyed = df.withColumn("__key", content_key(text_column))
    of = contents.select(F.col("key").alias("__of"), "class_id")
    return keyed.join(of, F.col("__key") == F.col("__of"), "left").withColumn("class_id", F.coalesce("class_id", F.col(id_column))).drop("__key", "__of")


def deduplicated(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One row of each class: the one whose id names the class. Of rows with that same id and text one stays.

    Texts without a word are copies of nothing: all stay, but of rows with the same id and text one, unless the id is null.
    """
    _, contents = classes(df, id_column, text_column, similarity)
    of = contents.select(F.col("key").alias("__of"), F.col("class_id").alias("__class"), F.col("chief").alias("__chief"))
    keyed = df.withColumn("__key", content_key(text_column)).join(of, F.col("__key") == F.col("__of"), "left")
    bare = F.col("__of").isNull()
    named = keyed.filter((bare & F.col(id_column).isNotNull()) | ((F.col("__key") == F.col("__chief")) & F.col("__class").eqNullSafe(F.col(id_column))))
    kept = named.dropDuplicates([id_column, "__key"]).unionByName(keyed.filter(bare & F.col(id_column).isNull()))
    return kept.select(*df.columns)
