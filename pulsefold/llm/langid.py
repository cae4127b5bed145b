"""Language identification: averaged hashed subword embeddings with a linear softmax, trained by SGD in numpy.

Subwords are the byte 3-grams and 4-grams of the text with A-Z as a-z and everything in ASCII but letters as a
space. Training reads a bounded sample of labelled rows; prediction reads every text whole.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import text_of
from .kernels import appended, lists, texts_of

#: Hash buckets of the subwords and length of an embedding.
BUCKETS, DIM = 1 << 15, 16
#: Labelled rows of each language that training reads at most, on average (they are drawn by a hash of their id).
SAMPLE = 500
#: Languages that are learnt at most, those with most rows; the model has a column for each.
LANGUAGES = 1000
#: Subwords whose embeddings are looked up at once.
SLICE = 1 << 18
#: Passes over the sample, rows of a step, its rate, and the share of the sample kept for calibration.
EPOCHS, STEP, RATE, HELD = 12, 32, 0.5, 0.2
#: Share of the calibration rows whose prediction is accepted.
ACCEPTED = 0.995

_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[:128] = 32
_FOLD[ord("a") : ord("z") + 1] = _FOLD[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)


def _subwords(data: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """The bucket of the 3-gram and of the 4-gram at each byte; BUCKETS where a text ends before."""
    b = np.concatenate([_FOLD[data], np.zeros(3, np.uint32)])
    n = len(data)
    three = b[:n] << 16 | b[1 : n + 1] << 8 | b[2 : n + 2]
    four = three << 8 | b[3 : n + 3]
    out = []
    shift = np.uint32(32 - (BUCKETS.bit_length() - 1))
    for size, gram, odd in ((3, three, 0x9E3779B1), (4, four, 0x85EBCA77)):
        bucket = ((gram * np.uint32(odd)) >> shift).astype(np.int32)
        for back in range(1, size):
            ends = bounds[1:] - back
            bucket[ends[ends >= bounds[:-1]]] = BUCKETS
        out.append(bucket)
    return out


def _features(batches):
    """(lang, buckets, counts) of each text."""
    for batch in batches:
        for first, last, t in texts_of(batch.column(1)):
            sizes, buckets, counts = [], [], []
            three, four = _subwords(t.data, t.bounds)
            for a, b in zip(t.bounds[:-1], t.bounds[1:], strict=True):
                count = np.bincount(np.concatenate([three[a:b], four[a:b]]), minlength=BUCKETS + 1)[:BUCKETS]
                some = np.flatnonzero(count)
                sizes.append(len(some))
                buckets.append(some)
                counts.append(count[some])
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), lists(np.concatenate(buckets), np.array(sizes), pa.int32()), lists(np.concatenate(counts), np.array(sizes), pa.int32())], names=["lang", "buckets", "counts"])


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # (BUCKETS + 1, languages): what each subword adds to the logits
    bias: np.ndarray
    temperature: float
    least: float  # a prediction with a lower score is not accepted


def fit(labelled: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang", sample: int = SAMPLE, seed: int = 7, languages_at_most: int = LANGUAGES) -> Model | None:
    """A model from about `sample` rows of each language at most, of the languages with most rows (ties: by name); None without a labelled text."""
    usable = labelled.filter(F.col(lang_column).isNotNull() & (F.length(text_of(text_column)) > 0))
    counts = {r[0]: r[1] for r in usable.groupBy(lang_column).count().orderBy(F.col("count").desc(), lang_column).limit(languages_at_most).collect()}
    if not counts:
        return None
    share = F.create_map(*[F.lit(x) for lang, n in sorted(counts.items()) for x in (lang, min(1.0, sample / n))])
    drawn = F.pmod(F.xxhash64(F.col(id_column), F.lit(seed)), F.lit(1 << 30)) / float(1 << 30) < F.element_at(share, F.col(lang_column))
    rows = usable.filter(drawn).select(F.col(lang_column).alias("lang"), F.col(text_column).alias("text")).mapInArrow(_features, "lang string, buckets array<int>, counts array<int>").toArrow()
    if not rows.num_rows:
        return None
    rows = rows.combine_chunks()
    size = np.asarray(pc.list_value_length(rows["buckets"]))
    edge = np.concatenate([[0], np.cumsum(size)])
    bucket, count = (np.asarray(pc.list_flatten(rows[c])) for c in ("buckets", "counts"))
    languages = sorted(counts)
    y = np.searchsorted(languages, rows["lang"].to_numpy(zero_copy_only=False).astype(str))
    # an order that does not depend on how the rows came
    order = np.lexsort(([int(count[a:b].sum()) for a, b in zip(edge[:-1], edge[1:], strict=True)], [int((bucket[a:b] * np.int64(31) + count[a:b]).sum()) for a, b in zip(edge[:-1], edge[1:], strict=True)], y))
    rng = np.random.default_rng(seed)
    order = rng.permutation(order)
    order = order[size[order] > 0]
    held, train = order[: int(len(order) * HELD)], order[int(len(order) * HELD) :]
    embedding = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    weight, bias = np.zeros((DIM, len(languages)), np.float32), np.zeros(len(languages), np.float32)
    scale = [np.full(x.shape, 1e-6, np.float32) for x in (embedding, weight, bias)]

    def step(x: np.ndarray, s: np.ndarray, g: np.ndarray, at=slice(None)) -> None:
        s[at] += g * g
        x[at] -= RATE * 0.1 * g / np.sqrt(s[at])

    def averaged(i: int) -> tuple[np.ndarray, np.ndarray]:
        b, c = bucket[edge[i] : edge[i + 1]], count[edge[i] : edge[i + 1]].astype(np.float32)
        return b, c / c.sum()

    for _ in range(EPOCHS):
        for batch in np.array_split(rng.permutation(train), max(1, len(train) // STEP)):
            if not len(batch):
                continue
            parts = [averaged(i) for i in batch]
            mean = np.stack([c @ embedding[b] for b, c in parts])
            logits = mean @ weight + bias
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(batch)), y[batch]] -= 1
            p /= len(batch)
            back = p @ weight.T
            step(weight, scale[1], mean.T @ p)
            step(bias, scale[2], p.sum(axis=0))
            all_buckets = np.concatenate([b for b, _ in parts])
            unique, place = np.unique(all_buckets, return_inverse=True)
            grad = np.zeros((len(unique), DIM), np.float32)
            at = 0
            for (b, c), g in zip(parts, back, strict=True):
                grad[place[at : at + len(b)]] += c[:, None] * g  # the buckets of one text are distinct
                at += len(b)
            step(embedding, scale[0], grad, unique)
    table = np.concatenate([embedding @ weight, np.zeros((1, len(languages)), np.float32)])
    held = held if len(held) else train
    logits = np.stack([c @ table[b] + bias for b, c in map(averaged, held)])

    def probabilities(t: float) -> np.ndarray:
        p = np.exp((logits - logits.max(axis=1, keepdims=True)) / t)
        return p / p.sum(axis=1, keepdims=True)

    loss = lambda t: -np.log(probabilities(t)[np.arange(len(held)), y[held]] + 1e-12).mean()
    temperature = min(np.geomspace(0.1, 10, 41), key=loss)
    least = float(np.quantile(probabilities(temperature).max(axis=1), 1 - ACCEPTED))
    return Model(languages, table.astype(np.float32), bias, float(temperature), least)


def predict(df: DataFrame, model: Model | None, text_column: str = "text", keep: list[str] | None = None) -> DataFrame:
    """`df` with lang_pred, score (0 to 1, calibrated) and accepted.

    A null text or one without a letter is `und` with the score 0 and not accepted, and so is every text without
    a model. accepted is false too where the score is lower than for nearly all calibration texts. Texts are read
    whole; repeated rows get equal predictions; an empty table gives an empty one. Input columns with the names
    of the new ones are replaced.
    """
    df = df.drop(*[c for c in df.columns if c in ("lang_pred", "score", "accepted") and c != text_column])
    keep = [c for c in df.columns if c in keep] if keep else list(df.columns)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def make(strings: pa.Array) -> dict[str, pa.Array]:
        m = shared.value
        lang, score = np.full(len(strings), "und", object), np.zeros(len(strings))
        for first, last, t in texts_of(strings) if m else ():
            total = np.zeros((t.n, len(m.languages)))
            grams = np.zeros(t.n)
            for bucket in _subwords(t.data, t.bounds):
                for at in range(0, len(bucket), SLICE):  # a very long text isn't looked up whole
                    part = bucket[at : at + SLICE]
                    begin, end = np.maximum(t.bounds[:-1], at), np.minimum(t.bounds[1:], at + len(part))
                    some = np.flatnonzero(begin < end)
                    if len(some):
                        total[some] += np.add.reduceat(m.table[part], begin[some] - at, axis=0)
                        grams[some] += np.add.reduceat((part != BUCKETS).astype(np.int64), begin[some] - at)
            logits = (total / np.maximum(grams, 1)[:, None] + m.bias) / m.temperature
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            lang[first:last] = np.array(m.languages, object)[p.argmax(axis=1)]
            score[first:last] = p.max(axis=1)
        return {"__lang": pa.array(lang, pa.string()), "__score": pa.array(score)}

    lettered = df.withColumn("__lettered", has_letter(F.col(text_column)))
    made = appended(lettered, "__lang string, __score double", text_column, make, [*keep, "__lettered"])
    known = F.col("__lettered") & (F.col("__lang") != "und")
    least = model.least if model else 1.0
    return made.withColumns(
        {"lang_pred": F.when(known, F.col("__lang")).otherwise(F.lit("und")), "score": F.when(known, F.col("__score")).otherwise(F.lit(0.0)), "accepted": known & (F.col("__score") >= least)}
    ).drop("__lang", "__score", "__lettered")


def has_letter(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike(r"\p{L}")


def held_out(column: str) -> Column:
    """Rows whose id's CRC-32 leaves the remainder 2 by 4; they are never learnt from."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % 4 == 2
