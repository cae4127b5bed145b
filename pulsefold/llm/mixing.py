"""Mixing sources to target weights with hash-threshold histograms.

Every row gets a hash of its id. For each source, sizes are summed by the leading bits of that hash, the
bucket in which the running sum meets the source's budget is found, and only the rows of that bucket are
summed again by the next bits, until the bucket holds one hash value. The outcome is one cut per source; a
row is taken if its hash lies below the cut, so no row is ever sorted and the passes shrink by the bucket
factor each time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import WORD, held, small_or_plain, text_of

#: Bits of the hash, and bits that one histogram resolves.
HASH_BITS, LEVEL_BITS = 60, 12
#: Weights of the sources in the order of their names, repeated as often as needed.
WEIGHTS = (5, 2, 1)
#: Share of all sizes that the mix takes, and how often a row can be taken.
BUDGET, REPEATS = 1.5, 2


def hash_of(column: str) -> Column:
    """A 60-bit hash of the id, the same in every run and engine (leading hex digits of its MD5; null: of the empty string)."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col(column).cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, budget: float = BUDGET, repeats: int = REPEATS) -> DataFrame:
    """(source, source_size, target): each source's share of budget x all sizes.

    `sizes` has one row per source. A target stops at repeats x source_size; the excess goes to the others by
    weight until none is above, which is the level at which min(limit, level x weight) sums to the budget.
    The windows run over one row per source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    limits = sizes.withColumn("w", weight).withColumn("limit", F.lit(float(repeats)) * F.col("source_size"))
    by_ratio = Window.orderBy(F.col("limit") / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    levels = limits.withColumn(
        "level",
        (F.lit(float(budget)) * F.sum("source_size").over(every) - F.coalesce(F.sum("limit").over(by_ratio), F.lit(0.0)))
        / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(by_ratio), F.lit(0.0))),
    ).withColumn("at", F.row_number().over(Window.orderBy(F.col("limit") / F.col("w"), F.col("source").asc_nulls_last())))
    first = F.min(F.when(F.col("limit") / F.col("w") > F.col("level"), F.struct("at", "level"))).over(every)["level"]
    level = F.coalesce(first, F.lit(float("inf")))
    return levels.withColumn("target", F.round(F.least("limit", level * F.col("w")), 6)).select("source", "source_size", "target")


def cuts(rows: DataFrame, goals: DataFrame, level_bits: int = LEVEL_BITS) -> DataFrame:
    """(source, cut): of the rows (source, size, hash), those with hash < cut add up to the budget of their source.

    `goals` has (source, budget). The rows of the last bucket share one hash value; they are taken if that
    brings the sum nearer to the budget.
    """
    end = 1 << HASH_BITS
    open_ = held(goals.select("source", "budget", F.lit(0).cast("long").alias("low"), F.lit(0).cast("long").alias("below")))
    done = None
    shift = HASH_BITS
    while True:
        last, shift = shift, shift - level_bits
        inside = rows.join(small_or_plain(open_.withColumnRenamed("source", "of")), F.col("source").eqNullSafe(F.col("of")))
        if last < HASH_BITS:
            inside = inside.filter(F.shiftright("hash", last) == F.shiftright("low", last))
        sums = (
            inside.groupBy("source", "budget", "below", F.shiftleft(F.shiftright("hash", shift), shift).alias("bucket"))
            .agg(F.sum("size").alias("words"), F.min("hash").alias("least"), F.max("hash").alias("most"))
            .withColumn("before", F.col("below") + F.coalesce(F.sum("words").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        )
        met = sums.filter((F.col("before") + F.col("words") > F.col("budget")) & (F.col("before") <= F.col("budget")))
        edge = held(met.groupBy("source", "budget").agg(F.min_by(F.struct("before", "words", "bucket", "least", "most"), "bucket").alias("b")).select("source", "budget", "b.*"))
        nearer = (F.col("before") + F.col("words") - F.col("budget")) < (F.col("budget") - F.col("before"))
        single = F.col("least") == F.col("most")
        closed = edge.filter(single).select("source", F.when(nearer, F.col("most") + 1).otherwise(F.col("least")).alias("cut"))
        done = closed if done is None else done.unionByName(closed)
        open_ = held(edge.filter(~single).select("source", "budget", F.col("bucket").alias("low"), F.col("before").alias("below")))
        if shift == 0 or not open_.take(1):
            break
    found = done.withColumnRenamed("source", "of")
    return held(goals.join(small_or_plain(found), F.col("source").eqNullSafe(F.col("of")), "left").select("source", F.coalesce("cut", F.lit(end)).alias("cut")))


def mix(
    df: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
    weights=WEIGHTS,
    budget: float = BUDGET,
    repeats: int = REPEATS,
) -> DataFrame:
    """`df` with size (long), source_size (long), target (double), taken (long) and copies (int).

    size: words of the text, 0 for a null or empty one. taken: size x copies. Each row is taken
    floor(target / source_size) times, and once more if its hash lies below its source's cut. A null source is
    a source of its own. Rows with equal ids share a hash and so a fate; rows with a null id too. A source with
    no words has the target 0. An empty table gives an empty one. Input columns with the names of the new ones
    are replaced; very long texts are counted whole.
    """
    new = ("size", "source_size", "target", "taken", "copies")
    df = df.drop(*[c for c in df.columns if c in new])
    sized = df.withColumn("size", F.regexp_count(text_of(text_column), F.lit(WORD)).cast("long")).withColumn("__hash", hash_of(id_column))
    rows = held(sized.select(F.col(source_column).alias("source"), "size", F.col("__hash").alias("hash")))
    goals = held(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, budget, repeats))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("int")
    rest = goals.select("source", (F.col("target") - whole * F.col("source_size")).alias("budget"))
    edges = cuts(rows, rest)
    plan = goals.withColumn("whole", whole).join(edges.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")))
    plan = plan.select(F.col("source").alias("__of"), "source_size", "target", F.col("whole").alias("__whole"), F.col("cut").alias("__cut"))
    out = sized.join(small_or_plain(held(plan)), F.col(source_column).eqNullSafe(F.col("__of")), "left")
    # a target of exactly `whole` times the source leaves no budget, and the cut is then the least hash
    copies = F.col("__whole") + F.when(F.col("__hash") < F.col("__cut"), 1).otherwise(0)
    return out.withColumn("copies", F.least(copies, F.lit(repeats))).withColumn("taken", F.col("size") * F.col("copies")).drop("__of", "__whole", "__cut", "__hash")


def repeated(mixed: DataFrame) -> DataFrame:
    """The rows of `mix`, each as often as it is taken, without the columns that `mix` added."""
    copies = F.explode(F.sequence(F.lit(1), F.col("copies")))
    return mixed.filter(F.col("copies") > 0).withColumn("__copy", copies).drop("__copy", "size", "source_size", "target", "taken", "copies")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS r FROM d GROUP BY source),
w AS (SELECT source, source_size, CASE (r - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w, 2.0::DOUBLE * source_size AS lim FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY lim / w, source NULLS LAST) AS k FROM w),
l AS (
  SELECT a.source, a.source_size, a.w, a.lim, a.k,
         (1.5::DOUBLE * (SELECT sum(source_size) FROM o) - coalesce((SELECT sum(b.lim) FROM o b WHERE b.k < a.k), 0))
         / ((SELECT sum(w) FROM o) - coalesce((SELECT sum(b.w) FROM o b WHERE b.k < a.k), 0)) AS lev
  FROM o a),
f AS (SELECT min(k) AS k FROM l WHERE lim / w > lev),
t AS (
  SELECT source, source_size,
         round(CASE WHEN (SELECT k FROM f) IS NULL THEN lim ELSE least(lim, (SELECT lev FROM l WHERE k = (SELECT k FROM f)) * w) END, 6) AS target
  FROM l),
g AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t),
m AS (
  SELECT d.doc_id, d.size, d.h, g.source_size, g.target, g.whole, g.target - g.whole * g.source_size AS budget,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
         sum(d.size) OVER (PARTITION BY d.source, d.h) AS tie
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
       CAST(size * least(2, whole + CASE WHEN upto <= budget THEN 1 WHEN upto - tie <= budget AND upto - budget < budget - (upto - tie) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM m
"""
