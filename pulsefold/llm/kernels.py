"""Numpy kernels over Arrow text batches: words, hashes and shingles of many texts at once."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at once; one longer text is worked on alone.
CHUNK = 1 << 20

_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE, _UNIT = _U(0x9E3779B97F4A7C15), _U(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """Each 64-bit number, well stirred (the finalizer of SplitMix64)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE = mixed(np.arange(1, 257, dtype=_U) * _BASE)
_FOLDED = _BYTE.copy()
_FOLDED[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]


class _Powers:
    """Powers of an odd number and of its inverse modulo 2^64, as far as needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, _U)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            base = int(_BASE) | 1
            self.up, self.down = (np.multiply.accumulate(np.concatenate([np.ones(1, _U), np.full(n, b, _U)])) for b in (base, pow(base, -1, 1 << 64)))
        return self.up, self.down


_powers = _Powers()


@dataclass
class Raw:
    """Texts end to end: data (bytes), bounds (n + 1 offsets)."""

    data: np.ndarray
    bounds: np.ndarray

    @property
    def n(self) -> int:
        return len(self.bounds) - 1


@dataclass
class Texts(Raw):
    """Texts end to end, and their words by start, end and text."""

    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray

    def words_per_text(self) -> np.ndarray:
        return np.bincount(self.doc, minlength=self.n)

    def hashes(self, fold: bool = False) -> np.ndarray:
        """A 64-bit hash of each word; `fold` takes A-Z as a-z."""
        up, down = _powers.to(len(self.data) + 1)
        sums = np.zeros(len(self.data) + 1, _U)
        np.cumsum((_FOLDED if fold else _BYTE)[self.data] * up[: len(self.data)], out=sums[1:])
        return mixed((sums[self.end] - sums[self.start]) * down[self.start] + (self.end - self.start).astype(_U))


def texts_of(strings: pa.Array, chunk: int | None = None) -> Iterator[tuple[int, int, Texts]]:
    """(first, last, Texts) for runs of rows of about `chunk` (CHUNK) bytes; a null counts as the empty text."""
    for first, last, raw in raw_of(strings, chunk):
        yield first, last, _split(raw.data, raw.bounds)


def raw_of(strings: pa.Array, chunk: int | None = None) -> Iterator[tuple[int, int, Raw]]:
    """As texts_of(), without the words."""
    strings = pc.fill_null(strings.combine_chunks() if isinstance(strings, pa.ChunkedArray) else strings, "").cast(pa.large_string())
    if not len(strings):
        return
    offsets = np.frombuffer(strings.buffers()[1], np.int64)[strings.offset : strings.offset + len(strings) + 1]
    data = np.frombuffer(strings.buffers()[2] or b"", np.uint8)
    first = 0
    while first < len(strings):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + (chunk or CHUNK), "right")) - 1)
        bounds = offsets[first : last + 1] - offsets[first]
        part = data[offsets[first] : offsets[last]]
        yield first, last, Raw(part, bounds)
        first = last


def _split(data: np.ndarray, bounds: np.ndarray) -> Texts:
    inside = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[bounds] = True
    before = np.empty(len(data), bool)
    after = np.empty(len(data), bool)
    if len(data):
        before[0] = after[-1] = False
        before[1:], after[:-1] = inside[:-1], inside[1:]
    start = np.flatnonzero(inside & ~(before & ~edge[:-1]))
    end = np.flatnonzero(inside & ~(after & ~edge[1:])) + 1
    return Texts(data, bounds, start, end, np.searchsorted(bounds, start, "right") - 1)


def grams(hashes: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, position of the first word) of each run of n words within a text."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.empty(0, _U), np.empty(0, np.int64)
    out = np.zeros(m, _U)
    for i in range(n):
        out = mixed(out * _BASE + hashes[i : i + m])
    at = np.flatnonzero(doc[:m] == doc[n - 1 :])
    return out[at], at


def gram_at(hashes: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """The hash of the run of n words that begins at each position `at`, as in grams()."""
    out = np.zeros(len(at), _U)
    for i in range(n):
        out = mixed(out * _BASE + hashes[at + i])
    return out


def shingles(texts: Texts, hashes: np.ndarray, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of each n-word shingle; a text of fewer words, but one at least, has a single shingle of them all."""
    out, at = grams(hashes, texts.doc, n)
    doc = texts.doc[at]
    count = texts.words_per_text()
    for k in range(1, n):
        some = np.flatnonzero(count == k)
        if len(some):
            rows = np.searchsorted(texts.doc, some)
            short = np.zeros(len(some), _U)
            for i in range(k):
                short = mixed(short * _BASE + hashes[rows + i])
            out, doc = np.concatenate([out, short]), np.concatenate([doc, some])
    order = np.argsort(doc, kind="stable")
    return out[order], doc[order]


def counted(hashes: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, hash, count) of the distinct pairs, by doc and hash."""
    order = np.lexsort((hashes, doc))
    h, d = hashes[order], doc[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    at = np.flatnonzero(first)
    return d[at], h[at], np.diff(np.append(at, len(h)))


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list array of `counts` values each."""
    return pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32), pa.array(values, kind))


def appended(df, fields: str, column: str, make: Callable[[pa.Array], dict[str, pa.Array]], keep: list[str] | None = None):
    """`df` (or its columns `keep`) with the columns that `make` derives from the texts in `column`, by Arrow batch."""
    from pyspark.sql.types import StructType

    keep = list(df.columns) if keep is None else keep
    added = StructType.fromDDL(fields)
    schema = StructType([df.schema[c] for c in keep] + list(added))
    at = df.columns.index(column)
    keep_at = [df.columns.index(c) for c in keep]
    names = [f.name for f in schema]

    def run(batches):
        for batch in batches:
            made = make(batch.column(at))
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in keep_at] + [made[f.name] for f in added], names=names)

    return df.mapInArrow(run, schema)
