"""Quality rules: two fixed rules, and thresholds that adapt to each language and source.

Four measures of every text go into mergeable quantile sketches: counts by logarithmic bin, whose sums over any
rows are the sketch of those rows, with a relative error of ACCURACY for each quantile. Texts that fail a fixed rule
stay out of them. A group's fence lies beyond a high quantile, by a multiple of what that is above the median. A source's threshold in a language is the mean of its
own fence, weighted by its texts, and that of the language, weighted by PRIOR texts; the language's is
made of its own and that of all texts in the same way. So a group of few texts follows the wider one, and no size
changes the rule.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import held, small_or_plain
from .kernels import Texts, appended, counted, grams, texts_of

#: Least words of a text, and largest share (percent) of its words in repeated windows.
LEAST_WORDS, MOST_REPEATED = 50, 50
SYMBOLS = b"#*$%&|<>"
#: Relative error of a sketch's quantiles.
ACCURACY = 0.01
#: Measures: symbols, repeated lines and repeated words by word, code points by word. For each the quantile beyond which a
#: fence lies, the multiple of its distance from the median by which it does, and how many of the things counted are free.
MEASURES = {"symbols": (0.9, 2.0, 3), "lines": (0.99, 0.5, 3), "repeats": (0.99, 0.5, 3), "length": (0.9, 2.0, 0)}
#: The weight of the wider group, in texts.
PRIOR = 100

_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_GAMMA = (1 + ACCURACY) / (1 - ACCURACY)
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True
_LEAD = (np.arange(256) & 0xC0) != 0x80


def _between(flags: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(flags)])
    return sums[end] - sums[start]


def _repeated_lines(t: Texts) -> np.ndarray:
    """Lines with a word that equal an earlier line of their text, for each text."""
    cuts = np.flatnonzero(t.data == ord("\n"))
    start = np.sort(np.concatenate([t.bounds[:-1], cuts + 1]))
    # an empty text begins where the next one does; its line is empty and has no word
    doc = np.searchsorted(t.bounds[1:-1], start, "right")
    end = np.append(start[1:], len(t.data))
    end -= np.isin(end - 1, cuts)
    word = np.zeros(len(t.data) + 1, np.int64)
    word[t.start + 1] = 1
    lines = np.flatnonzero(_between(word[1:].astype(bool), start, np.maximum(end, start)))
    hashes = Texts(t.data, t.bounds, start[lines], end[lines], doc[lines]).hashes()
    of, _, n = counted(hashes, doc[lines])
    return np.bincount(of, n - 1, t.n).astype(np.int64)


def measures(strings: pa.Array) -> dict[str, pa.Array]:
    """The five counts of each text."""
    out = {c: np.zeros(len(strings), np.int64) for c in _COUNTS}
    for first, last, t in texts_of(strings):
        rows = slice(first, last)
        out["n_words"][rows] = t.words_per_text()
        out["word_chars"][rows] = np.bincount(t.doc, _between(_LEAD[t.data], t.start, t.end), t.n).astype(np.int64)
        out["n_dup_lines"][rows] = _repeated_lines(t)
        out["n_symbols"][rows] = _between(_SYMBOL[t.data], t.bounds[:-1], t.bounds[1:])
        triple, at = grams(t.hashes(), t.doc, 3)
        if len(at):
            order = np.lexsort((triple, t.doc[at]))
            same = (triple[order][1:] == triple[order][:-1]) & (t.doc[at[order]][1:] == t.doc[at[order]][:-1])
            twice = np.zeros(len(at), bool)
            twice[order[1:][same]] = twice[order[:-1][same]] = True
            inside = np.zeros(len(t.doc), bool)
            for k in range(3):
                inside[at[twice] + k] = True
            out["n_repeat_words"][rows] = np.bincount(t.doc[inside], minlength=t.n)
    return {c: pa.array(v) for c, v in out.items()}


_OF = {"symbols": "n_symbols", "lines": "n_dup_lines", "repeats": "n_repeat_words", "length": "word_chars"}


def _failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def sketches(measured: DataFrame, language: str, source: str) -> DataFrame:
    """(lang, source, measure, bin, n): texts that fail no fixed rule by logarithmic bin; bin null holds the zeros."""
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("measure"), (F.col(c) / F.col("n_words")).alias("x")) for name, c in _OF.items()]))
    binned = measured.filter(~_failed()).select(F.col(language).alias("lang"), F.col(source).alias("source"), each.alias("m"))
    place = F.when(F.col("m.x") > 1e-9, F.ceil(F.log("m.x") / float(np.log(_GAMMA))).cast("int"))
    return binned.groupBy("lang", "source", F.col("m.measure").alias("measure"), place.alias("bin")).agg(F.count("*").alias("n"))


def fences(sketch: DataFrame, by: list[str]) -> DataFrame:
    """(by..., measure, texts, fence) of the merged sketches. The windows run over the bins of one group, a few hundred at most."""
    group = [*by, "measure"]
    merged = sketch.groupBy(*group, "bin").agg(F.sum("n").alias("n"))
    upward = Window.partitionBy(*group).orderBy(F.col("bin").asc_nulls_first())
    ranked = merged.withColumn("upto", F.sum("n").over(upward)).withColumn("texts", F.sum("n").over(Window.partitionBy(*group)))
    value = F.when(F.col("bin").isNull(), 0.0).otherwise(2 * F.pow(F.lit(_GAMMA), F.col("bin")) / (_GAMMA + 1))
    at = lambda share: F.min(F.when(F.col("upto") >= F.ceil(F.col("texts") * share), value))
    return ranked.groupBy(*group).agg(F.max("texts").alias("texts"), F.coalesce(*[F.when(F.col("measure") == m, at(tail) + margin * (at(tail) - at(0.5))) for m, (tail, margin, _) in MEASURES.items()]).alias("fence"))


def thresholds(sketch: DataFrame) -> DataFrame:
    """(lang, source, t_<measure>...), one row per language and source."""

    def named(by: list[str], tag: str) -> DataFrame:
        df = fences(sketch, by)
        return df.select(*[F.col(c).alias(f"{tag}_{c}") for c in by], F.col("measure").alias(f"{tag}_measure"), F.col("texts").alias(f"{tag}_texts"), F.col("fence").alias(tag))

    blended = lambda own, n, wide: (F.col(n) * F.col(own) + PRIOR * wide) / (F.col(n) + PRIOR)
    own, lang, every = named(["lang", "source"], "own"), named(["lang"], "wide"), named([], "every")
    rows = own.join(lang, F.col("own_lang").eqNullSafe(F.col("wide_lang")) & (F.col("own_measure") == F.col("wide_measure"))).join(every, F.col("own_measure") == F.col("every_measure"))
    limit = blended("own", "own_texts", blended("wide", "wide_texts", F.col("every")))
    return rows.groupBy(F.col("own_lang").alias("__lang"), F.col("own_source").alias("__source")).agg(*[F.max(F.when(F.col("own_measure") == m, limit)).alias(f"t_{m}") for m in MEASURES])


def measured(df: DataFrame, text_column: str = "text", keep: list[str] | None = None) -> DataFrame:
    """`df` with the five counts; input columns of their names are replaced."""
    df = df.drop(*[c for c in df.columns if c in _COUNTS and c != text_column])
    return appended(df, ", ".join(f"{c} long" for c in _COUNTS), text_column, measures, keep)


def judge(counts: DataFrame, language: str = "lang", source: str = "source", statistics: DataFrame | None = None) -> DataFrame:
    """`counts`, the outcome of `measured`, with base_failed and kept.

    base_failed: fewer than LEAST_WORDS words, or more than MOST_REPEATED percent of them in three-word windows
    that occur twice. kept: base_failed is false and no count exceeds what its threshold gives for the words of the
    text, and what is free. `statistics` are the rows
    from which the thresholds come (default: `counts`).

    A null text has no words and fails. A null language or source is a group of its own. Repeated rows count
    each time and get equal verdicts. An empty table gives an empty one. Texts are measured whole.
    """
    counts = counts.drop("base_failed", "kept")
    limits = held(thresholds(sketches(counts if statistics is None else statistics, language, source)))
    joined = counts.join(small_or_plain(limits), F.col(language).eqNullSafe(F.col("__lang")) & F.col(source).eqNullSafe(F.col("__source")), "left")
    above = F.lit(False)
    for name, (_, _, free) in MEASURES.items():
        above = above | F.coalesce(F.col(_OF[name]) > F.col(f"t_{name}") * F.col("n_words") + free, F.lit(False))
    return joined.withColumn("base_failed", _failed()).withColumn("kept", ~_failed() & ~above).drop("__lang", "__source", *[f"t_{m}" for m in MEASURES])


ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
ln AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d),
lines AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM ln WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
pos AS (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) > 2),
tri AS (SELECT r, i, count(*) OVER (PARTITION BY r, w[i], w[i + 1], w[i + 2]) AS c FROM pos),
rep AS (SELECT r, count(DISTINCT i + k) AS n FROM tri, (VALUES (0), (1), (2)) t(k) WHERE c > 1 GROUP BY r),
c AS (
  SELECT d.r, doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(coalesce(lines.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN lines ON lines.r = d.r LEFT JOIN rep ON rep.r = d.r),
f AS (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed FROM c),
m AS (
  SELECT r, lang, source, base_failed, n_words, measure, CASE measure WHEN 'symbols' THEN n_symbols WHEN 'lines' THEN n_dup_lines WHEN 'repeats' THEN n_repeat_words ELSE word_chars END AS n
  FROM f, (VALUES ('symbols'), ('lines'), ('repeats'), ('length')) t(measure)),
x AS (SELECT *, n / n_words::DOUBLE AS x FROM m WHERE NOT base_failed),
b AS (SELECT *, CASE WHEN x > 1e-9 THEN CAST(ceil(ln(x) / {float(np.log(_GAMMA))!r}::DOUBLE) AS INTEGER) END AS bin FROM x),
g AS (
  SELECT 0 AS level, measure, lang, source, bin, count(*) AS n FROM b GROUP BY ALL
  UNION ALL SELECT 1, measure, lang, NULL, bin, count(*) FROM b GROUP BY ALL
  UNION ALL SELECT 2, measure, NULL, NULL, bin, count(*) FROM b GROUP BY ALL),
u AS (SELECT *, sum(n) OVER (PARTITION BY level, measure, lang, source ORDER BY bin NULLS FIRST) AS upto, sum(n) OVER (PARTITION BY level, measure, lang, source) AS texts,
             CASE WHEN bin IS NULL THEN 0.0::DOUBLE ELSE 2 * pow({_GAMMA!r}::DOUBLE, bin) / {_GAMMA + 1!r}::DOUBLE END AS v FROM g),
q AS (SELECT level, measure, lang, source, max(texts) AS texts, min(v) FILTER (WHERE upto >= ceil(texts * CASE measure WHEN 'symbols' THEN {MEASURES['symbols'][0]!r}::DOUBLE WHEN 'lines' THEN {MEASURES['lines'][0]!r}::DOUBLE WHEN 'repeats' THEN {MEASURES['repeats'][0]!r}::DOUBLE WHEN 'length' THEN {MEASURES['length'][0]!r}::DOUBLE END)) AS high, min(v) FILTER (WHERE upto >= ceil(texts * 0.5::DOUBLE)) AS mid FROM u GROUP BY level, measure, lang, source),
t AS (SELECT *, high + CASE measure WHEN 'symbols' THEN {MEASURES['symbols'][1]!r}::DOUBLE WHEN 'lines' THEN {MEASURES['lines'][1]!r}::DOUBLE WHEN 'repeats' THEN {MEASURES['repeats'][1]!r}::DOUBLE WHEN 'length' THEN {MEASURES['length'][1]!r}::DOUBLE END * (high - mid) AS fence FROM q),
a AS (
  SELECT m.r, bool_or(n > (o.texts * o.fence + {PRIOR} * ((l.texts * l.fence + {PRIOR} * e.fence) / (l.texts + {PRIOR}))) / (o.texts + {PRIOR}) * n_words + CASE m.measure WHEN 'length' THEN {MEASURES["length"][2]} ELSE {MEASURES["lines"][2]} END) AS above
  FROM m JOIN t o ON o.level = 0 AND o.measure = m.measure AND o.lang IS NOT DISTINCT FROM m.lang AND o.source IS NOT DISTINCT FROM m.source
  JOIN t l ON l.level = 1 AND l.measure = m.measure AND l.lang IS NOT DISTINCT FROM m.lang JOIN t e ON e.level = 2 AND e.measure = m.measure GROUP BY m.r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT coalesce(above, false) AS kept
FROM f LEFT JOIN a ON a.r = f.r
"""
