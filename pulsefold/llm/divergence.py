"""Divergence of sources: how far the term probabilities of each source of a language are from the others' and from the language's.

Each task counts the terms of its texts by group, which is a language and a source, and in how many documents of the
group a term stands. Terms in enough documents of a language are kept, sorted by ranges and numbered: a term's id is
its place among the language's terms. CHUNK ids make a chunk, in which a term is found by searchsorted in the sorted ids,
and the counts of a source are one dense vector (bincount). Ids follow the order of UTF-8, so sums run over dense vectors
and ties go to the lower id. All arithmetic is in whole numbers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import small_or_plain, text_of, written
from .kernels import texts_of
from .terms import runs, wide_letters

#: Documents of a language that a kept term is in at least, the weight of a count of none, the unit of probabilities, and the rank to which terms are listed.
LEAST_DOCUMENTS, SMOOTHING, UNIT, TOP = 30, 5, 1_000_000_000, 50
#: Terms of a chunk, and counts that a task holds before it hands them on.
CHUNK, HELD = 4096, 1 << 19


def _counted(batches):
    """(lang, source, term, n, documents) of batches (lang, source, text); each group has a row without a term, too."""
    held: dict[tuple[str, str], dict[str, list[int]]] = {}
    size = 0

    def flushed():
        nonlocal size
        for (lang, source), own in held.items():
            n = len(own) + 1
            values = np.array(list(own.values()), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * n), pa.array([source] * n), pa.array(["", *own]), pa.array(np.append(0, values[:, 0])), pa.array(np.append(0, values[:, 1]))],
                names=["lang", "source", "term", "n", "documents"],
            )
        held.clear()
        size = 0

    for batch in batches:
        names = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        place = {g: i for i, g in enumerate(dict.fromkeys(names))}
        groups = list(place)
        group_of = np.array([place[g] for g in names])
        for g in groups:
            held.setdefault(g, {})
        for first, last, t in texts_of(batch.column(2), 8 << 20):
            doc, words = runs(t.data, t.bounds, wide_letters(t.data))
            code, terms = words.indices.to_numpy().astype(np.int64), words.dictionary.to_pylist()
            # a number for each pair of a document and a term, then for each pair of a group and a term
            pair, n = np.unique(doc * len(terms) + code, return_counts=True) if len(code) else (np.empty(0, np.int64), np.empty(0, np.int64))
            group = group_of[first:last][pair // max(1, len(terms))]
            key, at = np.unique(group * len(terms) + pair % max(1, len(terms)), return_inverse=True)
            total, documents = np.zeros(len(key), np.int64), np.bincount(at, minlength=len(key))
            np.add.at(total, at, n)
            for k, c, d in zip(key.tolist(), total.tolist(), documents.tolist(), strict=True):
                g, w = divmod(k, len(terms))
                own = held[groups[g]]
                old = own.get(terms[w])
                if old is None:
                    own[terms[w]] = [c, d]
                    size += 1
                else:
                    old[0] += c
                    old[1] += d
            if size > HELD:
                yield from flushed()
                for g in groups:
                    held.setdefault(g, {})
    yield from flushed()


def term_counts(df: DataFrame, least: int = LEAST_DOCUMENTS, text_column: str = "text") -> DataFrame:
    """(lang, source, term, n, first): the occurrences of each kept term in each group that has it, and one row with an empty term for each group.

    `first` marks one row of each kept term of a language. Null languages, sources and texts count as empty.
    """
    slim = df.select(text_of("lang").alias("lang"), text_of("source").alias("source"), text_of(text_column).alias("text"))
    part = slim.mapInArrow(_counted, "lang string, source string, term string, n long, documents long")
    counts = part.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("documents").alias("documents"))
    by_term = Window.partitionBy("lang", "term")
    all_ = counts.withColumns({"in_lang": F.sum("documents").over(by_term), "least": F.min("source").over(by_term)})
    return all_.filter((F.col("term") == "") | (F.col("in_lang") >= least)).select("lang", "source", "term", "n", (F.col("source") == F.col("least")).alias("first"))


def _numbered(batches):
    """(lang, part, place, term, source, n) of batches sorted by lang and term: place counts the terms of the partition, part names it."""
    part, place, last = TaskContext.get().partitionId(), -1, (None, None)
    for batch in batches:
        if not len(batch):
            continue
        lang, term = batch.column("lang"), batch.column("term")
        new = np.ones(len(batch), bool)
        new[0] = (lang[0].as_py(), term[0].as_py()) != last
        if len(batch) > 1:
            new[1:] = pc.or_(pc.not_equal(lang[1:], lang[:-1]), pc.not_equal(term[1:], term[:-1])).to_numpy(zero_copy_only=False)
        places = place + np.cumsum(new)
        place, last = int(places[-1]), (lang[-1].as_py(), term[-1].as_py())
        yield pa.RecordBatch.from_arrays([lang, pa.array(np.full(len(batch), part)), pa.array(places), term, batch.column("source"), batch.column("n")], names=["lang", "part", "place", "term", "source", "n"])


def numbered(counts: DataFrame) -> DataFrame:
    """`counts` (lang, term, source, n) with id: the place of the term, from 0, among all terms of the language in the order of UTF-8."""
    dealt = counts.select("lang", "term", "source", "n").repartitionByRange("lang", "term").sortWithinPartitions("lang", "term")
    rows = written(dealt.mapInArrow(_numbered, "lang string, part long, place long, term string, source string, n long"))
    parts = rows.groupBy("lang", "part").agg(F.min("place").alias("low"), F.max("place").alias("high"), F.min("term").alias("least"))
    before = F.sum(F.col("high") - F.col("low") + 1).over(Window.partitionBy("lang").orderBy("least").rowsBetween(Window.unboundedPreceding, -1))
    shift = parts.select("lang", "part", (F.coalesce(before, F.lit(0)) - F.col("low")).alias("shift"))  # a row per language and task
    return rows.join(small_or_plain(shift), ["lang", "part"]).select("lang", (F.col("place") + F.col("shift")).alias("id"), "term", "source", "n")


def _p(counts: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(UNIT * counts / total) for counts below totals, by long division: no step leaves 64 bits up to totals of 9e15."""
    rest, out = counts.astype(np.int64), np.zeros_like(counts)
    step = 1000
    for _ in range(3):
        rest = rest * step
        digit = rest // total
        out, rest = out * step + digit, rest - digit * total
    return out + 1


def _compared(top: int):
    """The parts of a chunk: rows of all sources of the language with their totals, and rows with the counts (source, id, term, n)."""

    def run(table: pa.Table) -> pa.Table:
        own = sorted(table.filter(pc.is_valid(table["total"])).select(["source", "total", "v"]).to_pylist(), key=lambda r: r["source"].encode())
        names, v = [r["source"] for r in own], own[0]["v"]
        found = table.filter(pc.is_valid(table["n"])).combine_chunks()
        ids = found["id"].to_numpy()
        kept, first = np.unique(ids, return_index=True)
        terms = found["term"].take(pa.array(first)).to_pylist()
        where = pc.index_in(found["source"], pa.array(names)).to_numpy() * len(kept) + np.searchsorted(kept, ids)
        n, size = found["n"].to_numpy(), len(names) * len(kept)
        # high and low halves apart: bincount adds up doubles
        dense = (np.bincount(where, n >> 26, size).astype(np.int64) << 26) + np.bincount(where, n & (1 << 26) - 1, size).astype(np.int64)
        counts = dense.reshape(len(names), -1)
        totals = np.array([r["total"] for r in own], np.int64) + SMOOTHING * v
        p = _p(counts + SMOOTHING, totals[:, None])
        q = _p(counts.sum(0) + SMOOTHING, np.int64(sum(r["total"] for r in own) + SMOOTHING * v))
        out: dict[str, list] = {c: [] for c in ("source", "part", "item", "value")}

        def add(source: str, part: str, items: list[str], values: list[int]) -> None:
            out["source"] += [source] * len(items)
            out["part"] += [part] * len(items)
            out["item"] += items
            out["value"] += values

        for i, name in enumerate(names):
            apart = np.abs(p - p[i]).sum(1)
            others = [j for j in range(len(names)) if j != i]
            add(name, "pair", [names[j] for j in others], apart[others].tolist())
            some = np.flatnonzero((counts[i] > 0) & (p[i] > q))
            best = some[np.lexsort((some, q[some] - p[i][some]))[:top]]
            add(name, "term", [terms[j] for j in best], (p[i][best] - q[best]).tolist())
        lang = pa.array([table["lang"][0].as_py()] * len(out["source"]), pa.string())
        return pa.table({"lang": lang} | {c: pa.array(x, pa.int64() if c == "value" else pa.string()) for c, x in out.items()})

    return run


def audit(df: DataFrame, least: int = LEAST_DOCUMENTS, top: int = TOP, chunk: int = CHUNK, text_column: str = "text") -> DataFrame:
    """(lang, source, part, item, value, rank) for every group of `df`, which has lang, source and a text.

    With p = 1 + floor(UNIT (count + 5) / (N + 5 V)) of the V kept terms, N the group's occurrences of them: `pair` has each other source of the
    language with the sum of |p - q| over all kept terms, q the other source's (0 without a kept term); `term` has the kept terms that the
    group has and for which p exceeds the language's, by the difference, `top` at most. Ranks go by value, then by the item's UTF-8.

    Null languages, sources and texts count as empty; a group without any term is compared like others. Repeated rows
    count as documents of their own. An empty table gives an empty one. Other columns are left out. A chunk's task
    holds `chunk` numbers for each source of the language; pairs of sources are the result, so languages have few enough of them to list these.
    """
    counts = written(term_counts(df, least, text_column))
    groups = counts.groupBy("lang", "source").agg(F.sum("n").alias("kept_n"), F.count_if(F.col("first") & (F.col("term") != "")).alias("v"))
    groups = groups.withColumn("total", F.col("kept_n")).withColumn("v", F.sum("v").over(Window.partitionBy("lang"))).select("lang", "source", "total", "v")
    groups = written(groups)
    found = written(numbered(counts.filter("term <> ''")).withColumn("chunk", F.floor(F.col("id") / chunk)))
    none = {c: F.lit(None).cast(t) for c, t in (("id", "long"), ("term", "string"), ("n", "long"), ("total", "long"), ("v", "long"))}
    every = groups.join(found.select("lang", "chunk").distinct(), "lang")
    columns = ["lang", "chunk", "source", *none]
    rows = every.withColumns({c: none[c] for c in ("id", "term", "n")}).select(*columns).unionByName(found.withColumns({c: none[c] for c in ("total", "v")}).select(*columns))
    parts = written(rows.groupBy("lang", "chunk").applyInArrow(_compared(top), "lang string, source string, part string, item string, value long"))
    others = groups.select("lang", "source").join(groups.select("lang", F.col("source").alias("item")), "lang").filter("source <> item").withColumn("value", F.lit(0).cast("bigint"))
    pairs = parts.filter("part = 'pair'").select("lang", "source", "item", "value").unionByName(others).groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).withColumn("part", F.lit("pair"))
    both = pairs.unionByName(parts.filter("part = 'term'"), allowMissingColumns=True)
    order = Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), "item")
    return both.withColumn("rank", F.row_number().over(order)).filter((F.col("part") == "pair") | (F.col("rank") <= top)).select("lang", "source", "part", "item", "value", "rank")


ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT r, lang, source, unnest(w) AS term FROM d),
c AS (SELECT r, lang, source, term, count(*) AS n FROM t GROUP BY ALL),
k AS (SELECT lang, term FROM c GROUP BY ALL HAVING count(*) >= {LEAST_DOCUMENTS}),
g AS (SELECT DISTINCT lang, source FROM d),
n AS (SELECT c.lang, c.source, c.term, sum(n) AS n FROM c JOIN k USING (lang, term) GROUP BY ALL),
e AS (SELECT g.lang, g.source, k.term, coalesce(n.n, 0) AS n FROM g JOIN k USING (lang) LEFT JOIN n USING (lang, source, term)),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
gt AS (SELECT lang, source, sum(n) AS total FROM e GROUP BY ALL),
p AS (SELECT e.*, 1 + ({UNIT}::HUGEINT * (n + {SMOOTHING})::HUGEINT) // (total + {SMOOTHING} * v)::HUGEINT AS p FROM e JOIN gt USING (lang, source) JOIN v USING (lang)),
ls AS (SELECT lang, term, sum(n) AS n FROM e GROUP BY lang, term),
lt AS (SELECT *, sum(n) OVER (PARTITION BY lang) AS total FROM ls),
q AS (SELECT lang, term, 1 + ({UNIT}::HUGEINT * (n + {SMOOTHING})::HUGEINT) // (total + {SMOOTHING} * v)::HUGEINT AS q FROM lt JOIN v USING (lang)),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
both_ AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
  UNION ALL SELECT p.lang, p.source, 'term', p.term, CAST(p.p - q.q AS BIGINT) FROM p JOIN q USING (lang, term) WHERE p.n > 0 AND p.p > q.q),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM both_)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= {TOP}
"""
