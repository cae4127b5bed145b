"""Token ids as binary files: frequency-ranked ids in byte-aligned variable-length coding with separate control bytes.

Texts become token ids by a tokenizer of the tokenizers library. The ids of all documents are counted, and the
more often an id occurs, the lower its rank. A rank takes one to four bytes, least byte first; how many stands in two bits of a
control byte, four ranks to a byte, the first in the low bits. Control bytes and data bytes of a document are streams of
their own, so a reader looks the lengths of four ranks up in a table and never tests a byte.

A folder holds `ranks`, the ids by rank (unsigned 32-bit, little-endian), and `shards`, files of blocks that cover the documents in
ascending order of id (null first; equal ids by a hash of the text). A block is

    magic "PFT2", then seven unsigned 64-bit numbers: ids in all documents before the block, documents, control bytes,
    data bytes, bytes of the document table, and two that are 0
    document table: id (signed 64-bit), 1 if there is an id (8 bits), number of ids (unsigned 64-bit), as three columns
    control bytes of each document in turn, each document beginning a new byte
    data bytes
    a line feed (Spark's text writer ends each row so; it commits files whole, whatever executors are lost)
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from bisect import bisect_right
from dataclasses import dataclass
from functools import lru_cache
from itertools import compress, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import shared_folder, text_of, written
from .kernels import Raw, raw_of

#: Ids of a shard and of a block, at most but for one longer document; the documents of a block.
SHARD_IDS, BLOCK_IDS, BLOCK_DOCUMENTS = 1 << 24, 1 << 20, 1 << 14
#: Entries of a worker's memory of encoded pieces, but for those of one chunk of text; new pieces that are encoded by one call.
PIECES, TOGETHER = 1 << 19, 500
MAGIC = b"PFT2"
#: Split pattern of tokenizers that drop white space and never join a letter with what is no letter (fixed value).
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Lower-case Latin letters.
PLAIN = re.compile("[a-z\u00DF-\u00F6\u00F8-\u00FF]+")

_LENGTHS = (np.arange(256)[:, None] >> np.arange(0, 8, 2) & 3).astype(np.uint8) + 1
_MASKS = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)
#: Kinds of bytes: white space, letter, digit, other ASCII, and beyond.
_SPACE, _LETTER, _DIGIT, _OTHER, _BEYOND = range(5)
_KIND = np.full(256, _BEYOND, np.uint8)
_KIND[:128] = _OTHER
_KIND[[0x20, *range(0x09, 0x0E)]] = _SPACE
_KIND[ord("0") : ord("9") + 1] = _DIGIT
for _a in "Aa":
    _KIND[ord(_a) : ord(_a) + 26] = _LETTER


# coding


def _fields(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which 2-bit fields stand for a rank, control bytes of each document): a document begins a new byte."""
    control_counts = -(-counts // 4)
    ends, unused = 4 * np.cumsum(control_counts), 4 * control_counts - counts
    there = np.ones(4 * int(control_counts.sum()), bool)
    for k in (1, 2, 3):
        there[ends[unused >= k] - k] = False
    return there, control_counts


def packed(ranks: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(control, data, control bytes, data bytes) of documents of `counts` ranks each, end to end."""
    width = 2 if int(ranks.max(initial=0)) <= 0xFFFF else 4
    values = ranks.astype(f"<u{width}")
    extra = (values > 0xFF).astype(np.uint8)
    if width > 2:
        extra += values > 0xFFFF
        extra += values > 0xFFFFFF
    there, control_counts = _fields(counts)
    fields = np.zeros(len(there), np.uint8)
    fields[there] = extra
    quads = fields.view("<u4")
    control = (quads | quads >> 6 | quads >> 12 | quads >> 18).astype(np.uint8)
    data = values.view(np.uint8).reshape(-1, width)[np.arange(width, dtype=np.uint8) <= extra[:, None]]
    more = np.concatenate([[0], np.cumsum(extra, dtype=np.int64)])
    return control, data, control_counts, np.diff(more[np.concatenate([[0], np.cumsum(counts)])]) + counts


def unpacked(control: np.ndarray, data: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The ranks of documents of `counts` ranks each, by a lookup of the lengths of each control byte."""
    lengths = _LENGTHS[control].reshape(-1)[_fields(counts)[0]]
    at = np.cumsum(lengths, dtype=np.int64)
    at -= lengths
    # at each byte the number that begins there, of as many bytes as the longest; each rank takes as many of them as it has
    wide = np.concatenate([data, np.zeros(3, np.uint8)])
    numbers = data.astype(np.uint32)
    for k in range(1, int(lengths.max(initial=1))):
        numbers |= wide[k : k + len(data)].astype(np.uint32) << np.uint32(8 * k)
    return numbers[at] & _MASKS[lengths]


# tokens


class Encoder:
    """Ids of whole texts, as the library gives them; pieces that no token can cross are encoded once and remembered.

    Where the tokenizer splits by WORD_PATTERN, a text falls apart at white space, after an ASCII letter that another
    ASCII character follows, and after an ASCII digit, whatever stands around. Where it lower-cases, A-Z before an ASCII character (which composes
    with nothing) is taken as a-z first. Texts with a name of a special token are encoded whole, as all texts are with another tokenizer.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.kind = np.dtype(np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32)
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [spec.get("pre_tokenizer") or {}])
        pieces = steps[0].get("type") == "Split" and steps[0].get("pattern", {}).get("Regex") == WORD_PATTERN and steps[0].get("invert") and steps[0].get("behavior") == "Removed"
        changes = [x.get("type") for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        self.by_piece = bool(pieces) and set(changes) <= {"NFC", "Replace", "Lowercase"}
        self.lowers = self.by_piece and "Lowercase" in changes
        self.special = [t["content"].encode() for t in spec.get("added_tokens", [])]
        # remembered pieces: the number of each, their ids end to end, where each one's begin, and how many chunks of text had it
        self.known: dict[str, int] = {}
        self.flat, self.at, self.seen = np.empty(0, self.kind), np.zeros(1, np.int64), np.zeros(0, np.int64)
        # tokens that end a word; a run of letters is one word, so they tell where each of many runs ends
        suffix = (spec.get("model") or {}).get("end_of_word_suffix")
        self.ends = np.zeros(max(self.tokenizer.get_vocab().values(), default=0) + 1, bool)
        if suffix:
            self.ends[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith(suffix)]] = True
        # the same model for lower-case Latin letters: NFC and lower-casing leave them as they are, and white space alone parts them
        self.plain = None
        if self.by_piece and suffix and len(steps) == 2 and steps[1].get("type") == "ByteLevel" and not steps[1].get("add_prefix_space", True) and not steps[1].get("use_regex", True):
            self.plain = Tokenizer.from_file(path)
            self.plain.normalizer = None
            self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind)

    def texts(self, t: Raw) -> tuple[np.ndarray, np.ndarray]:
        """(ids end to end, number of each text's)."""
        raw, data = t.data.tobytes(), t.data
        if self.lowers:
            upper = (data - np.uint8(ord("A"))) < 26
            upper[:-1] &= data[1:] < 0x80
            data = data | upper.view(np.uint8) << 5
        lower = data.tobytes()
        if not self.by_piece or any(s in raw or s in lower for s in self.special):
            each = [self.whole(raw[a:b].decode()) for a, b in zip(t.bounds[:-1], t.bounds[1:], strict=True)]
            return np.concatenate([np.empty(0, self.kind), *each]), np.array([len(x) for x in each], np.int64)
        kinds = _KIND[data]
        inside = kinds != _SPACE
        edge = np.zeros(len(kinds) + 1, bool)
        edge[1:-1] = ~inside[:-1]
        edge[t.bounds] = True
        now, after = kinds[:-1], kinds[1:]
        edge[1:-1] |= (now == _LETTER) & ((after == _DIGIT) | (after == _OTHER)) | (now == _DIGIT) & (after != _SPACE) & (after != _BEYOND)
        start = np.flatnonzero(edge[:-1] & inside)
        if not len(start):
            return np.empty(0, self.kind), np.zeros(t.n, np.int64)
        solid = data[inside]
        before = np.cumsum(inside, dtype=np.int32 if len(data) < 1 << 31 else np.int64)
        bounds = np.append(before[start] - 1, len(solid)).astype(np.int64)
        pieces = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(bounds), pa.py_buffer(solid)).dictionary_encode()
        # no piece holds a line feed
        names = pc.binary_join(pa.ListArray.from_arrays([0, len(pieces.dictionary)], pieces.dictionary), pa.scalar("\n", pa.large_string()))[0].as_py().split("\n")
        found = self._ids(names).take(pieces.indices)
        ends = np.frombuffer(found.buffers()[1], np.int64)[: len(found) + 1]
        ids = np.frombuffer(found.buffers()[2] or b"", np.uint8)[: ends[-1]].view(self.kind)
        return ids, np.diff(ends[np.searchsorted(start, t.bounds)]) // self.kind.itemsize

    def _ids(self, pieces: list[str]) -> pa.LargeBinaryArray:
        """The ids of each of the pieces, which differ."""
        numbers = np.fromiter(map(self.known.get, pieces, repeat(-1)), np.int64, len(pieces))
        at = np.flatnonzero(numbers < 0)
        if len(at):
            new = [pieces[i] for i in at.tolist()]
            self._learn(new)
            numbers[at] = np.fromiter(map(self.known.__getitem__, new), np.int64, len(new))
        self.seen[numbers] += 1
        held = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(self.known), [None, pa.py_buffer(self.at * self.kind.itemsize), pa.py_buffer(self.flat)])
        found = held.take(pa.array(numbers))
        if len(self.known) > PIECES:
            self._forget()
        return found

    def _learn(self, new: list[str]) -> None:
        """Encode pieces and remember them."""
        plain, words, rest = [], [], []
        for p in new:
            (plain if self.plain and PLAIN.fullmatch(p) else words if p.isalpha() else rest).append(p)
        flat, at = [self.flat], [self.at[:-1]]
        size = len(self.flat)
        for many, tokenizer in ((plain, self.plain), (words, self.tokenizer), (rest, None)):
            for i in range(0, len(many), TOGETHER):
                part = many[i : i + TOGETHER]
                ids, cut = self._by_word(part, tokenizer) if tokenizer else self._by_offset(part)
                flat.append(ids)
                at.append(cut + size)
                size += len(ids)
        self.flat, self.at = np.concatenate(flat), np.concatenate([*at, [size]])
        self.known.update(zip([*plain, *words, *rest], range(len(self.known), len(self.known) + len(new)), strict=True))
        self.seen = np.concatenate([self.seen, np.zeros(len(new), np.int64)])

    def _forget(self) -> None:
        """Keep the half of the pieces that most chunks had, of late above all."""
        kept = np.zeros(len(self.seen), bool)
        kept[np.argsort(-self.seen, kind="stable")[: PIECES // 2]] = True
        sizes = np.diff(self.at)
        self.flat, self.at = self.flat[np.repeat(kept, sizes)], np.concatenate([[0], np.cumsum(sizes[kept])])
        self.known = {p: i for i, p in enumerate(compress(self.known, kept.tolist()))}
        self.seen = self.seen[kept] // 2

    def _by_word(self, part: list[str], tokenizer) -> tuple[np.ndarray, np.ndarray]:
        """(ids end to end, where each piece's begin) of runs of letters."""
        ids = np.array(tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, self.kind)
        ends = np.flatnonzero(self.ends[ids]) + 1
        return (ids, np.append(0, ends[:-1])) if len(ends) == len(part) and ends[-1] == len(ids) else self._by_offset(part)

    def _by_offset(self, part: list[str]) -> tuple[np.ndarray, np.ndarray]:
        made = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
        starts = np.cumsum([0, *(len(p) + 1 for p in part[:-1])])
        return np.array(made.ids, self.kind), np.searchsorted(np.array(made.offsets, np.int64).reshape(-1, 2)[:, 0], starts)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _encoded(path: str, end_id: int | None):
    """(id, tie, n, ids) of batches (id, tie, text)."""

    def run(batches):
        own = encoder(path)
        for batch in batches:
            for first, last, t in raw_of(batch.column(2), 4 << 20):
                ids, counts = own.texts(t)
                if end_id is not None:
                    ids, counts = np.insert(ids, np.cumsum(counts), end_id), counts + 1
                offsets = np.concatenate([[0], np.cumsum(counts)]) * own.kind.itemsize
                raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(ids))])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), batch.column(1).slice(first, last - first), pa.array(counts), raw.cast(pa.binary())], names=["id", "tie", "n", "ids"])

    return run


def _runs(column: pa.Array, kind: np.dtype):
    """(first row, last row, ids end to end, number of each row's) for runs of rows of about BLOCK_IDS ids."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    values = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + BLOCK_IDS * kind.itemsize, "right")) - 1)
        yield first, last, values[offsets[first] : offsets[last]].copy().view(kind), np.diff(offsets[first : last + 1].astype(np.int64)) // kind.itemsize
        first = last


def _counted(kind: np.dtype, size: int):
    """(token, n) of batches of ids: one row for each token that the task has."""

    def run(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            for _, _, ids, _ in _runs(batch.column(0), kind):
                total += np.bincount(ids, minlength=size)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["token", "n"])

    return run


def _place(row_id, tie: int) -> tuple:
    """What documents are ordered by."""
    return (row_id is not None, row_id or 0, tie)


def _ranked(rank_of: np.ndarray, kind: np.dtype, edges: list[tuple]):
    """(shard, id, tie, n, control, data) of batches (id, tie, n, ids); `edges` are the first places of all shards but the first."""

    def binary(values: np.ndarray, counts: np.ndarray) -> pa.Array:
        return pa.BinaryArray.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])

    def run(batches):
        for batch in batches:
            shards = [bisect_right(edges, _place(*x)) for x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            for first, last, ids, counts in _runs(batch.column(3), kind):
                control, data, n_control, n_data = packed(rank_of[ids], counts)
                kept = [batch.column(c).slice(first, last - first) for c in range(3)]
                yield pa.RecordBatch.from_arrays([pa.array(shards[first:last], pa.int64()), *kept, binary(control, n_control), binary(data, n_data)], names=["shard", "id", "tie", "n", "control", "data"])

    return run


def _blocks(starts: list[int]):
    """(shard, value): the blocks of batches sorted by shard and place."""

    def made(rows: list[tuple], start: int) -> bytes:
        ids = np.array([r[0] or 0 for r in rows], "<i8").tobytes() + np.array([r[0] is not None for r in rows], np.uint8).tobytes() + np.array([r[1] for r in rows], "<u8").tobytes()
        control, data = b"".join(r[2] for r in rows), b"".join(r[3] for r in rows)
        return b"".join([MAGIC, np.array([start, len(rows), len(control), len(data), len(ids), 0, 0], "<u8").tobytes(), ids, control, data])

    def run(batches):
        shard, rows, size, at = -1, [], 0, 0

        def flushed():
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([made(rows, at - size)], pa.binary())], names=["shard", "value"])

        for batch in batches:
            for s, i, n, control, data in zip(*(batch.column(c).to_pylist() for c in ("shard", "id", "n", "control", "data")), strict=True):
                if rows and (s != shard or size + n > BLOCK_IDS or len(rows) == BLOCK_DOCUMENTS):
                    yield flushed()
                    rows, size = [], 0
                if s != shard:
                    shard, at = s, starts[s]
                rows.append((i, n, control, data))
                size, at = size + n, at + n
        if rows:
            yield flushed()

    return run


@dataclass(frozen=True)
class Written:
    """Where the files are, and how many ids and documents they hold."""

    folder: str
    n_ids: int
    n_documents: int


def write(df: DataFrame, path: str, folder: str | None = None, end_id: int | None = None, id_column: str = "doc_id", text_column: str = "text", shard_ids: int = SHARD_IDS) -> Written:
    """Write the ids of all texts to `folder` (default: one in the shared folder) in ascending order of the integer ids.

    `path` names the tokenizer's file, which every executor has; special tokens are not added, and `end_id` is appended to each document. A
    null text counts as empty. Null ids come first, and rows with equal ids are ordered by a hash of their text, so equal rows stand side by
    side. Other columns are left out. An empty table gives a folder without shards. What goes to the driver: a count for each id of the vocabulary, and
    the first place and number of ids of each shard. Rows that are alike share one place, and so one shard.
    """
    spark = df.sparkSession
    folder = folder or f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    own = encoder(path)
    size = max(own.tokenizer.get_vocab_size(), (end_id or 0) + 1)
    slim = df.select(F.col(id_column).cast("long").alias("id"), text_of(text_column).alias("text")).select("id", F.xxhash64("text").alias("tie"), "text")
    coded = written(slim.mapInArrow(_encoded(path, end_id), "id long, tie long, n long, ids binary"), compression="zstd")
    counts = coded.select("ids").mapInArrow(_counted(own.kind, size), "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()
    ranks = [r["token"] for r in sorted(counts, key=lambda r: (-r["n"], r["token"]))]
    total = sum(r["n"] for r in counts)
    spark.createDataFrame([(bytearray(np.array(ranks, "<u4").tobytes()),)], "value binary").select(F.col("value").cast("string").alias("value")).coalesce(1).write.text(f"{folder}/ranks")
    rank_of = np.zeros(size, np.uint32)
    rank_of[ranks] = np.arange(len(ranks))

    # places of the documents alone are sorted to find the shards' first places and sums
    order = [F.col("id").asc_nulls_first(), F.col("tie").asc()]
    n_shards = max(-(-total // shard_ids), spark.sparkContext.defaultParallelism)
    places = coded.select("id", "tie", "n").repartitionByRange(n_shards, *order)
    shards = places.groupBy(F.spark_partition_id().alias("p")).agg(F.min(F.struct(F.col("id").isNotNull().alias("there"), F.coalesce("id", F.lit(0)).alias("id"), "tie")).alias("first"), F.sum("n").alias("n"), F.count("*").alias("rows")).collect()
    shards.sort(key=lambda r: r["first"])
    starts = [0, *np.cumsum([r["n"] for r in shards]).tolist()]
    edges = [tuple(r["first"]) for r in shards[1:]]
    ranked = coded.mapInArrow(_ranked(rank_of, own.kind, edges), "shard long, id long, tie long, n long, control binary, data binary")
    dealt = ranked.repartition(max(1, len(shards)), "shard").sortWithinPartitions("shard", *order)
    blocks = dealt.mapInArrow(_blocks(starts), "shard long, value binary")
    blocks.select("shard", F.col("value").cast("string").alias("value")).write.partitionBy("shard").text(f"{folder}/shards")
    return Written(folder, total, sum(r["rows"] for r in shards))


def _read(id_of: np.ndarray, with_ids: bool):
    """(id, start, n, ids_crc32[, ids]) of batches (content): whole files."""

    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                raw, at = np.frombuffer(content.as_buffer(), np.uint8), 0
                while at < len(raw):
                    if raw[at : at + 4].tobytes() != MAGIC:
                        raise ValueError(f"no block at byte {at}")
                    start, documents, n_control, n_data, n_table, _, _ = (int(x) for x in raw[at + 4 : at + 60].view("<u8"))
                    table, at = raw[at + 60 : at + 60 + n_table], at + 60 + n_table
                    ids, there, counts = table[: 8 * documents].view("<i8"), table[8 * documents : 9 * documents].astype(bool), table[9 * documents :].copy().view("<u8").astype(np.int64)
                    tokens = id_of[unpacked(raw[at : at + n_control], raw[at + n_control : at + n_control + n_data], counts)]
                    at += n_control + n_data + 1
                    ends = np.cumsum(counts)
                    own = [tokens[a:b] for a, b in zip(ends - counts, ends, strict=True)]
                    out = [pa.array(ids, mask=~there), pa.array(start + ends - counts), pa.array(counts), pa.array([zlib.crc32(x) for x in own], pa.int64())]
                    names = ["id", "start", "n", "ids_crc32"]
                    yield pa.RecordBatch.from_arrays(out + [pa.array([x.tolist() for x in own], pa.list_(pa.int64()))] * with_ids, names=names + ["ids"] * with_ids)

    return run


def read(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """(id, start, n, ids_crc32), and `ids` if asked for: a row per document from the files of `folder`.

    start counts the ids of all documents before, n those of the document; ids_crc32 is the CRC-32 of its ids as little-endian unsigned 32-bit
    integers. Files are read whole, each by one task; the ids by rank are bounded by the vocabulary.
    """
    schema = "id long, start long, n long, ids_crc32 long" + ", ids array<bigint>" * with_ids
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*")
    ranks = b"".join(bytes(r["content"]) for r in raw.load(f"{folder}/ranks").select("content").collect())
    id_of = np.frombuffer(ranks[: len(ranks) // 4 * 4], "<u4")
    if not len(id_of):
        return spark.createDataFrame([], schema)
    return raw.load(f"{folder}/shards").select("content").mapInArrow(_read(id_of, with_ids), schema)
