"""Spelling variants: words at distance one, found by a self-join of the vocabulary's trie with active-node sets.

Two words at distance one, each of seven code points or more, have their first three or their last three code points in common. So the
vocabulary is cut by its first three code points into the subtrees of a trie, and, written backwards, by its last three into those of
another; every pair meets in a subtree of one of them, and counts in the first if it can. A subtree with many words is
opened: pairs that differ in its next code point are matched by what is left of them, and its children take its place.

A task walks down its subtrees level by level. The active nodes of a node are those whose distance to it is at most one; itself at none, its
parent and its siblings at one, and, below, the children by the same code point of two nodes at distance one. Where both nodes end a word the pair is
emitted. Levels are numpy arrays, so a step is a lookup of all pairs' children at once.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import small_or_plain, text_of, written
from .kernels import texts_of
from .terms import latin_letters, runs

#: Least code points and occurrences of a word, the factor by which a form is more frequent, and one run in how many is cut.
LEAST_LENGTH, LEAST_COUNT, FACTOR, CUT_ONE_IN = 7, 2, 10, 31
#: Code points that a subtree's words share, and words of a subtree beyond which it is opened.
DEPTH, SUBTREE = 3, 100_000
#: Words that a task counts before it hands them on, and words of subtrees that it walks down together.
HELD, TOGETHER = 1 << 17, 1 << 14


# words


def _words(batches):
    """(word, n) of batches (id as text, text)."""
    held: dict[str, int] = {}

    def flushed():
        out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
        held.clear()
        return out

    def add(words, counts):
        for w, c in zip(words, counts, strict=True):
            held[w] = held.get(w, 0) + c

    for batch in batches:
        ids = batch.column(0).to_pylist()
        for first, _, t in texts_of(batch.column(1), 4 << 20):
            doc, found = runs(t.data, t.bounds, latin_letters(t.data))
            terms = found.dictionary.to_pylist()
            lengths = np.fromiter(map(len, terms), np.int64, len(terms))
            code = found.indices.to_numpy().astype(np.int64)
            long = lengths[code] >= LEAST_LENGTH
            pair, n = np.unique(doc[long] * max(1, len(terms)) + code[long], return_counts=True)
            at, word = np.divmod(pair, max(1, len(terms)))
            seeds = [zlib.crc32(f"{ids[first + i]}:".encode()) for i in range(t.n)]
            raw = [w.encode() for w in terms]
            h = np.fromiter((zlib.crc32(raw[w], seeds[d]) for d, w in zip(at.tolist(), word.tolist(), strict=True)), np.int64, len(pair))
            whole = h % CUT_ONE_IN != 0
            total = np.bincount(word[whole], n[whole], len(terms)).astype(np.int64)
            some = np.flatnonzero(total)
            add([terms[i] for i in some.tolist()], total[some].tolist())
            cut = np.flatnonzero(~whole & (lengths[word] > LEAST_LENGTH))
            shorter = []
            for w, x in zip(word[cut].tolist(), h[cut].tolist(), strict=True):
                k = x % len(terms[w])
                shorter.append(terms[w][:k] + terms[w][k + 1 :])
            add(shorter, n[cut].tolist())
            if len(held) > HELD:
                yield flushed()
    yield flushed()


def vocabulary(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(word, n): words of LEAST_LENGTH code points and LEAST_COUNT occurrences at least, n of them, in all texts."""
    slim = df.select(F.coalesce(F.col(id_column).cast("string"), F.lit("")).alias("id"), text_of(text_column).alias("text"))
    return slim.mapInArrow(_words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_COUNT)


# the trie


class _Level:
    """Nodes of one depth, by parent, then code point: parent, char, the word that ends there (-1: none), and first child by node."""

    def __init__(self, parent: np.ndarray, char: np.ndarray, ends: np.ndarray) -> None:
        self.parent, self.char, self.ends = parent, char, ends
        self.key = parent << 21 | char

    def children(self, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in `of`, child) of the nodes `of` of the level above."""
        low, high = np.searchsorted(self.parent, of), np.searchsorted(self.parent, of, "right")
        n = high - low
        return np.repeat(np.arange(len(of)), n), np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)

    def child(self, of: np.ndarray, char: np.ndarray) -> np.ndarray:
        """The child of each node by its code point, -1 if there is none."""
        key = of << 21 | char
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[at] == key, at, -1) if len(self.key) else np.full(len(key), -1)


def _below(pairs: tuple[np.ndarray, np.ndarray], here: _Level, there: _Level, without: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Children by the same code point of both nodes of each pair: of the first in `here`, of the second in `there`; `without` names one code point a pair that doesn't count."""
    at, first = here.children(pairs[0])
    char = here.char[first]
    if without is not None:
        some = char != without[at]
        at, first, char = at[some], first[some], char[some]
    second = there.child(pairs[1][at], char)
    both = second >= 0
    return first[both], second[both]


def near_in(block: np.ndarray, chars: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (u, v) of words of the same block at distance one, each pair once.

    Word i is chars[start[i] : start[i] + length[i]]; words are different and sorted by block, then by code points.
    """
    none = np.empty(0, np.int64)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    word, node = np.arange(len(block)), np.unique(block, return_inverse=True)[1].astype(np.int64)
    ends = np.full(int(node[-1]) + 1 if len(node) else 0, -1)
    ends[node[length == 0]] = word[length == 0]
    above, depth = _Level(np.zeros(len(ends), np.int64), np.arange(len(ends)), ends), 0
    beside, shorter, fresh = (none, none), (none, none), (none, none)  # at one level; a node and one of the level above; nodes and their parents
    fresh_char = none
    while True:
        some = length[word] > depth
        word, node = word[some], node[some]
        if not len(word):
            return (np.concatenate([a for a, _ in found] or [none]), np.concatenate([b for _, b in found] or [none]))
        char = chars[start[word] + depth].astype(np.int64)
        new = np.ones(len(word), bool)
        new[1:] = (node[1:] != node[:-1]) | (char[1:] != char[:-1])
        first = np.flatnonzero(new)
        parent, node = node[first], np.cumsum(new) - 1
        ends = np.full(len(first), -1)
        over = length[word] == depth + 1
        ends[node[over]] = word[over]
        level = _Level(parent, char[first], ends)
        beside = _below(beside, level, level)
        # siblings: each node and those after it below the same parent
        last = np.searchsorted(parent, parent, "right")
        n = last - np.arange(len(first)) - 1
        a = np.repeat(np.arange(len(first)), n)
        b = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + a + 1
        beside = np.concatenate([beside[0], a]), np.concatenate([beside[1], b])
        old, begun = _below(shorter, level, above), _below(fresh, level, above, fresh_char)
        shorter = np.concatenate([old[0], begun[0]]), np.concatenate([old[1], begun[1]])
        fresh, fresh_char = (np.arange(len(first)), parent), level.char
        for (u, v), (x, y) in ((beside, (level, level)), (shorter, (level, above)), (fresh, (level, above))):
            both = np.flatnonzero((x.ends[u] >= 0) & (y.ends[v] >= 0))
            found.append((x.ends[u[both]], y.ends[v[both]]))
        above, depth = level, depth + 1


def _near(together: int = TOGETHER):
    """(word, near, near_n), both ways, of batches (side, depth, block, key, word, n) sorted by side, depth, block and key."""

    def joined(rows: list[tuple]):
        block = np.array([r[0] for r in rows], np.int64)
        keys = [r[3] for r in rows]
        chars = np.frombuffer("".join(keys).encode("utf-32-le"), np.uint32)
        length = np.fromiter(map(len, keys), np.int64, len(keys))
        start = np.cumsum(length) - length
        depth = np.array([r[2] for r in rows], np.int64)
        u, v = near_in(block, chars, start + depth, length - depth)
        # what shares its first code points counts among the words as they are written
        head = np.unique(np.array([r[4][:DEPTH] for r in rows]), return_inverse=True)[1]
        side = np.array([r[1] for r in rows])
        own = (side[u] == 0) | (head[u] != head[v])
        u, v = u[own], v[own]
        words, n = pa.array([r[4] for r in rows], pa.string()), pa.array([r[5] for r in rows], pa.int64())
        for a, b in ((u, v), (v, u)):
            yield pa.RecordBatch.from_arrays([words.take(pa.array(a)), words.take(pa.array(b)), n.take(pa.array(b))], names=["word", "near", "near_n"])

    def run(batches):
        rows: list[tuple] = []
        number, last = 0, None
        for batch in batches:
            for side, depth, block, key, word, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (side, depth, block) != last:
                    if len(rows) >= together:
                        yield from joined(rows)
                        rows = []
                    number, last = number + 1, (side, depth, block)
                rows.append((number, side, depth, key, word, n))
        if rows:
            yield from joined(rows)

    return run


def _matched(cuts: DataFrame) -> DataFrame:
    """(word, near, near_n), both ways, of opened subtrees: rows (side, depth, key, word, n), the words below a node of `depth`.

    Two words differ in the code point after `depth` if what is left of both without it is equal, or of one without it and of the
    other whole, unless that one goes on with the same code point, which is a difference further down.
    """
    at = (F.col("depth") + 1).cast("int")
    char = F.substring("key", at, F.lit(1))
    rest = F.concat(F.substring("key", F.lit(1), F.col("depth")), F.substring("key", at + 1, F.length("key")))
    cut = cuts.filter(F.length("key") > F.col("depth")).select("side", "depth", rest.alias("left"), char.alias("char"), "word", "n")
    whole = cuts.select("side", "depth", F.col("key").alias("left"), char.alias("char"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    other = cut.select("side", "depth", "left", F.col("char").alias("c"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    replaced = cut.join(other, ["side", "depth", "left"]).filter("char <> c").select("side", "word", "n", "near", "near_n")
    longer = cut.withColumnRenamed("char", "c").join(whole, ["side", "depth", "left"]).filter("char <> c").select("side", "word", "n", "near", "near_n")
    back = longer.select("side", F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    own = (F.col("side") == 0) | (F.substring("word", 1, DEPTH) != F.substring("near", 1, DEPTH))
    return replaced.unionByName(longer).unionByName(back).filter(own).select("word", "near", "near_n")


def near_words(words: DataFrame, limit: int = SUBTREE) -> DataFrame:
    """(word, near, near_n): every pair of different words of `words` (word, n) at distance one, both ways.

    Words have LEAST_LENGTH code points at least and are distinct. Subtrees of more than `limit` words are opened.
    """
    sides = words.select(F.lit(0).alias("side"), F.col("word").alias("key"), "word", "n").unionByName(words.select(F.lit(1).alias("side"), F.reverse("word").alias("key"), "word", "n"))
    block: Column = F.substring("key", F.lit(1), F.col("depth"))
    open_ = sides.withColumn("depth", F.lit(DEPTH)).withColumn("block", block)
    settled, cuts = None, None
    while True:
        sizes = open_.groupBy("side", "block").agg(F.count("*").alias("size"))
        hot = written(sizes.filter(F.col("size") > limit).select("side", "block"))
        if not hot.take(1):
            settled = open_ if settled is None else settled.unionByName(open_)
            break
        marked = written(open_.join(small_or_plain(hot.withColumn("hot", F.lit(True))), ["side", "block"], "left"))
        calm = marked.filter("hot IS NULL").drop("hot")
        settled = calm if settled is None else settled.unionByName(calm)
        opened = marked.filter("hot").select("side", "depth", "key", "word", "n")
        cuts = opened if cuts is None else cuts.unionByName(opened)
        open_ = opened.filter(F.length("key") > F.col("depth")).withColumn("depth", F.col("depth") + 1).withColumn("block", block)
    order = ["side", "depth", "block"]
    dealt = settled.select(*order, "key", "word", "n").repartition(*order).sortWithinPartitions(*order, "key")
    near = dealt.mapInArrow(_near(), "word string, near string, near_n long")
    return near if cuts is None else near.unionByName(_matched(cuts))


def variants(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", limit: int = SUBTREE, factor: int = FACTOR) -> DataFrame:
    """(word, form, root, n, n_near, form_n), one row per word of `vocabulary`.

    form is the near word of most occurrences (then the least by code points), if it has `factor` times the word's at least, else null; root is the last
    form on the way from form to form, the word itself if it has none; n_near counts the near words.

    A null text has no words; a null id counts as empty text. Repeated rows count each. An empty table, or one without such words,
    gives an empty one. Other columns are left out. Texts are read whole, and words of any length are compared whole.
    """
    words = written(vocabulary(df, id_column, text_column))
    best = near_words(words, limit).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    joined = words.join(best, "word", "left")
    formed = -F.col("best.less") >= factor * F.col("n")
    linked = written(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(formed, F.col("best.near")).alias("form"), F.when(formed, -F.col("best.less")).alias("form_n")))
    most = words.agg(F.max("n")).first()[0] or 1
    # each step multiplies n by `factor`, so the way has so many steps at most, and a round doubles the steps
    steps = math.floor(math.log(most, max(2, factor))) + 1
    way = linked.filter("form IS NOT NULL").select("word", F.col("form").alias("to"))
    for _ in range(math.ceil(math.log2(steps)) if steps > 1 else 0):
        on = way.select(F.col("word").alias("to"), F.col("to").alias("next"))
        way = written(way.join(on, "to", "left").select("word", F.coalesce("next", "to").alias("to")))
    return linked.join(way, "word", "left").select("word", "form", F.coalesce("to", "word").alias("root"), "n", "n_near", "form_n")


ORACLE = rf"""
WITH RECURSIVE tab AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab),
d AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
c AS (SELECT id, run, count(*) AS n FROM d WHERE length(run) >= {LEAST_LENGTH} GROUP BY ALL),
x AS (SELECT *, hex(encode(id || ':' || run)) AS h FROM c),
b AS (SELECT *, list_transform(range(length(h) // 2), lambda i: CAST('0x' || h[2 * i + 1 : 2 * i + 2] AS BIGINT)) AS bytes FROM x),
k AS (SELECT run, n, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), bytes), lambda c, v: xor(c >> 8, tab[1 + (xor(c, v) & 255)])), 4294967295) AS crc FROM b, tab),
m AS (SELECT CASE WHEN crc % {CUT_ONE_IN} = 0 THEN substr(run, 1, CAST(crc % length(run) AS INTEGER)) || substr(run, CAST(crc % length(run) AS INTEGER) + 2) ELSE run END AS word, n FROM k),
w AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM m WHERE length(word) >= {LEAST_LENGTH} GROUP BY word HAVING sum(n) >= {LEAST_COUNT}),
s AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w),
r AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM s),
p AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM r a JOIN r b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT r.word, w.word, w.n FROM r JOIN w ON r.rest = w.word
  UNION SELECT w.word, r.word, r.n FROM r JOIN w ON r.rest = w.word),
e AS (SELECT word, count(*) AS n_near, first(near ORDER BY near_n DESC, encode(near)) AS near, max(near_n) AS near_n FROM p GROUP BY word),
f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= {FACTOR} * n THEN near END AS form, CASE WHEN near_n >= {FACTOR} * n THEN near_n END AS form_n FROM w LEFT JOIN e USING (word)),
way AS (SELECT word, word AS at FROM f UNION ALL SELECT way.word, f.form FROM way JOIN f ON f.word = way.at WHERE f.form IS NOT NULL)
SELECT f.word, f.form, way.at AS root, f.n, f.n_near, f.form_n FROM f JOIN way USING (word) JOIN f l ON l.word = way.at WHERE l.form IS NULL
"""
