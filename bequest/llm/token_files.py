"""Token files: concatenated ids, and document boundaries as Elias-Fano lists.

A file holds consecutive documents: a header, the Elias-Fano list of their ids in ascending order, that of
the places at which they begin in the array of token ids, and the array itself.  A folder of such files has
an index, a table with a row for each file, that says how many documents and tokens come before it.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bequest.sources.tables import literal_rows

from .common import kept, small_batches
from .tokens import encoded, id_kind

#: Token ids of a file; a file holds more only if its last document is that long.
FILE_IDS = 1 << 22
#: Documents of a file.
FILE_DOCS = 1 << 20
#: Ones of a list for which one place is remembered.
SAMPLED = 256

_ONES = np.array([i.bit_count() for i in range(256)], np.uint8)
_LIST = struct.Struct("<QQBxxxI")  # numbers, bytes of the upper bits, lower bits of a number, samples


class EliasFano:
    """A list of non-negative, non-decreasing integers in about 2 + log2(largest / length) bits each.

    Every number's lower bits stand in an array of that width.  The upper bits stand in a bit vector, in
    which bit `i + (number i >> lower)` is set, so the i-th number follows from the place of the i-th one
    (select).  For every SAMPLED-th one its place is kept in 32 bits, and select scans from there.
    """

    def __init__(self, count: int, low_bits: int, samples: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        self.count, self.low_bits, self.samples, self.low, self.high = count, low_bits, samples, low, high

    @classmethod
    def of(cls, numbers: np.ndarray) -> EliasFano:
        numbers = np.asarray(numbers, np.int64)
        count = len(numbers)
        largest = int(numbers[-1]) if count else 0
        bits = max(0, (largest // count).bit_length() - 1) if count else 0
        low = (numbers[:, None] >> np.arange(bits)) & 1
        ones = (numbers >> bits) + np.arange(count)
        high = np.zeros((int(ones[-1]) + 1 if count else 0), np.uint8)
        high[ones] = 1
        packed = (np.packbits(a.ravel().astype(np.uint8), bitorder="little") for a in (low, high))
        return cls(count, bits, ones[::SAMPLED].astype("<u4"), *packed)

    def to_bytes(self) -> bytes:
        head = _LIST.pack(self.count, len(self.high), self.low_bits, len(self.samples))
        return head + self.samples.tobytes() + self.low.tobytes() + self.high.tobytes()

    @classmethod
    def read(cls, data: memoryview, at: int) -> tuple[EliasFano, int]:
        """The list that begins at a place of the data, and the place behind it."""
        count, high, bits, samples = _LIST.unpack_from(data, at)
        at += _LIST.size
        parts = []
        for size, kind in ((4 * samples, "<u4"), (-(-count * bits // 8), np.uint8), (high, np.uint8)):
            parts.append(np.frombuffer(data[at : at + size], kind))
            at += size
        return cls(count, bits, *parts), at

    def __len__(self) -> int:
        return self.count

    def __getitem__(self, i: int) -> int:
        """The i-th number by select, without unpacking the list."""
        if not 0 <= i < self.count:
            raise IndexError(i)
        place, left = int(self.samples[i // SAMPLED]), i % SAMPLED
        at = place >> 3
        byte = int(self.high[at]) >> (place & 7) << (place & 7)
        while (ones := byte.bit_count()) <= left:
            left -= ones
            at += 1
            byte = int(self.high[at])
        for _ in range(left):
            byte &= byte - 1
        one = 8 * at + (byte & -byte).bit_length() - 1
        return (one - i) << self.low_bits | self._low(i)

    def _low(self, i: int) -> int:
        first = i * self.low_bits
        last = first + self.low_bits
        held = int.from_bytes(self.low[first >> 3 : (last + 7) >> 3].tobytes(), "little")
        return held >> (first & 7) & ((1 << self.low_bits) - 1)

    def all(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))
        numbers = (ones - np.arange(self.count)) << self.low_bits
        if self.low_bits:
            bits = np.unpackbits(self.low, bitorder="little")[: self.count * self.low_bits]
            numbers |= bits.reshape(-1, self.low_bits).astype(np.int64) @ (1 << np.arange(self.low_bits))
        return numbers


MAGIC = b"EFTOKEN1"
_HEAD = struct.Struct("<8sIIQQQqB7x")  # magic, part, number, documents, of them without id, tokens, least id, id bytes


class TokenFile:
    """One file's documents: their ids, boundaries and token ids."""

    def __init__(self, part: int, number: int, ids: EliasFano, least: int, nulls: int, bounds: EliasFano, tokens: np.ndarray) -> None:
        self.part, self.number, self.ids, self.least, self.nulls = part, number, ids, least, nulls
        self.bounds, self.tokens = bounds, tokens

    @staticmethod
    def packed(part: int, number: int, ids: list[int | None], sizes: np.ndarray, tokens: np.ndarray) -> bytes:
        """Documents in ascending order of id, those without an id last."""
        known = np.array([i for i in ids if i is not None], np.int64)
        least = int(known[0]) if len(known) else 0
        head = _HEAD.pack(MAGIC, part, number, len(ids), len(ids) - len(known), len(tokens), least, tokens.itemsize)
        bounds = np.r_[0, np.cumsum(sizes)]
        return b"".join([head, EliasFano.of(known - least).to_bytes(), EliasFano.of(bounds).to_bytes(), tokens.tobytes()])

    @classmethod
    def read(cls, data) -> TokenFile:
        data = memoryview(data)
        magic, part, number, _, nulls, count, least, width = _HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a token file")
        ids, at = EliasFano.read(data, _HEAD.size)
        bounds, at = EliasFano.read(data, at)
        tokens = np.frombuffer(data[at : at + count * width], f"<u{width}")
        return cls(part, number, ids, least, nulls, bounds, tokens)

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def doc_id(self, i: int) -> int | None:
        return self.ids[i] + self.least if i < len(self.ids) else None

    def document(self, i: int) -> np.ndarray:
        """Token ids of the i-th document of the file."""
        return self.tokens[self.bounds[i] : self.bounds[i + 1]]


#: Rows that are compared for the splitters of the range partitions, for each partition.
SPLIT_ROWS = 50

_ENCODED = "doc_id long, place long, tokens binary"


def _encode(path: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, kind = encoded(path), np.dtype(id_kind(path, end))
        for batch in batches:
            first = 0
            for sizes, ids in ids_of(batch.column("text")):
                rows = len(sizes)
                # The end id goes behind every document.
                ids = np.insert(ids, np.cumsum(sizes), end).astype(kind)
                bounds = np.r_[0, np.cumsum(sizes + 1)] * kind.itemsize
                tokens = pa.LargeBinaryArray.from_buffers(
                    pa.large_binary(), rows, [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(ids)]
                )
                part = batch.slice(first, rows)
                first += rows
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("place"), tokens.cast(pa.binary())], ["doc_id", "place", "tokens"]
                )

    return run


def _read(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("place"), text.alias("text"))


def token_ids(docs: DataFrame, tokenizer: str, end: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, place, tokens) of every row: ids as little-endian integers, the end id last.

    An id takes two bytes if all of the tokenizer's do, else four.  Null texts are empty and have the end id
    alone.  place orders rows that share an id.
    """
    small_batches(docs.sparkSession)
    return _read(docs, id_col, text_col).mapInArrow(_encode(tokenizer, end), _ENCODED)


def _splitters(rows: DataFrame, parts: int) -> list[tuple]:
    """Where to cut rows (doc_id, place) in order into about equal parts; from a bounded sample of them."""
    share = min(1.0, SPLIT_ROWS * parts / max(1, rows.count()))
    sample = sorted((i is None, i or 0, p or 0) for i, p in rows.sample(share, 20240607).collect())
    return [sample[len(sample) * i // parts] for i in range(1, parts)] if sample else []


def _placed(splitters: list[tuple]):
    """The partition of each row; of rows that equal several splitters, any between these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for n, (i, p) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("place").to_pylist())):
                key = (i is None, i or 0, p or 0)
                first, last = bisect_left(splitters, key), bisect_right(splitters, key)
                parts.append(first + n % (last - first + 1))
            yield batch.append_column("part", pa.array(parts, pa.int32()))

    return run


def _pack(kind: str, file_ids: int, file_docs: int):
    width = np.dtype(kind).itemsize

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        ids: list[int | None] = []
        pieces: list[bytes] = []
        size = 0

        def packed() -> pa.RecordBatch:
            tokens = np.frombuffer(b"".join(pieces), kind)
            sizes = np.array([len(p) // width for p in pieces], np.int64)
            return pa.RecordBatch.from_pydict({"file": [TokenFile.packed(part, number, ids, sizes, tokens)]})

        for batch in batches:
            for one, piece in zip(batch.column("doc_id").to_pylist(), batch.column("tokens")):
                ids.append(one)
                pieces.append(piece.as_buffer().to_pybytes())
                size += len(pieces[-1]) // width
                if size >= file_ids or len(ids) >= file_docs:
                    yield packed()
                    number, size = number + 1, 0
                    ids.clear()
                    pieces.clear()
        if ids:
            yield packed()

    return run


def write_token_files(
    docs: DataFrame,
    tokenizer: str,
    end: int,
    folder: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    file_ids: int = FILE_IDS,
    file_docs: int = FILE_DOCS,
) -> None:
    """Writes the documents' token ids as token files, and their index, in ascending order of id.

    Rows that share an id stand in the order of a hash of their texts, those without an id come last.
    Spark's own writer puts down every file whole or not at all, through whatever file system the folder is
    in.  Splitters between partitions are taken from a sample of (id, hash), so an id that repeats fills
    several partitions and texts are encoded once, on their way into the only shuffle.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    small_batches(spark)
    read = _read(docs, id_col, text_col)
    splitters = _splitters(read.select("doc_id", "place"), parts)
    encode, placed = _encode(tokenizer, end), _placed(splitters)
    tokens = read.mapInArrow(lambda batches: placed(encode(batches)), f"{_ENCODED}, part int")
    order = [F.col("doc_id").asc_nulls_last(), F.col("place").asc_nulls_last()]
    ranged = tokens.repartitionById(len(splitters) + 1, "part").sortWithinPartitions(*order, "tokens")
    files = ranged.select("doc_id", "tokens").mapInArrow(_pack(id_kind(tokenizer, end), file_ids, file_docs), "file binary")
    # A text row may hold any bytes; the line end behind it lies outside the lists and the array.
    files.select(F.col("file").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).text(f"{folder}/files")
    _write_index(spark, folder)


def _files(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{folder}/files").filter("length > 0")


def _heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        heads = [_HEAD.unpack(h) for h in batch.column("head").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("path"), *(pa.array([h[i] for h in heads], pa.int64()) for i in (1, 2, 3, 5))],
            ["path", "part", "number", "n_docs", "n_tokens"],
        )


def _write_index(spark: SparkSession, folder: str) -> None:
    heads = _files(spark, folder).select("path", F.substring("content", 1, _HEAD.size).alias("head"))
    heads = kept(heads.mapInArrow(_heads, "path string, part long, number long, n_docs long, n_tokens long"), "heads")
    totals = heads.groupBy("part").agg(F.sum("n_docs").alias("d"), F.sum("n_tokens").alias("t")).orderBy("part").collect()
    # A row for each partition that wrote files.
    bases, docs, ids = [], 0, 0
    for part, d, t in totals:
        bases.append((part, docs, ids))
        docs, ids = docs + d, ids + t
    bases = literal_rows(spark, bases, "part long, base_docs long, base_tokens long")
    earlier = Window.partitionBy("part").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c).over(earlier), F.lit(0))
    heads.withColumns({"d": before("n_docs"), "t": before("n_tokens")}).join(bases, "part").select(
        "path", "part", "number", "n_docs", "n_tokens",
        (F.col("base_docs") + F.col("d")).alias("first_doc"), (F.col("base_tokens") + F.col("t")).alias("first_token"),
    ).write.parquet(f"{folder}/index")


def token_index(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each file: path, part, number, n_docs, n_tokens, first_doc, first_token."""
    return spark.read.parquet(f"{folder}/index")


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column("content"):
            file = TokenFile.read(content.as_buffer())
            bounds, tokens = file.bounds.all(), file.tokens.astype("<u4")
            ids = np.r_[file.ids.all() + file.least, np.zeros(file.nulls, np.int64)]
            mask = np.arange(len(ids)) >= len(file.ids)
            crcs = [zlib.crc32(tokens[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64(), mask=mask),
                    pa.array(np.full(len(ids), file.part)),
                    pa.array(np.full(len(ids), file.number)),
                    pa.array(bounds[:-1]),
                    pa.array(np.diff(bounds)),
                    pa.array(crcs, pa.int64()),
                ],
                ["doc_id", "part", "number", "begin", "n_tokens", "ids_crc32"],
            )


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each document of the files: doc_id, start, n_tokens, ids_crc32.

    start counts the ids of all documents before it, ids_crc32 is taken over the ids as little-endian
    32-bit integers.  No files give no rows.
    """
    rows = _files(spark, folder).select("content").mapInArrow(
        _listed, "doc_id long, part long, number long, begin long, n_tokens long, ids_crc32 long"
    )
    index = token_index(spark, folder).select("part", "number", "first_token")
    return rows.join(index, ["part", "number"]).select(
        "doc_id", (F.col("first_token") + F.col("begin")).alias("start"), "n_tokens", "ids_crc32"
    )


def read_document(spark: SparkSession, folder: str, place: int) -> tuple[int | None, np.ndarray]:
    """Id and token ids of the document at a place of the whole order; reads the index and one file."""
    index = token_index(spark, folder)
    found = index.filter((F.col("first_doc") <= place) & (F.col("first_doc") + F.col("n_docs") > place)).first()
    if found is None:
        raise IndexError(place)
    content = spark.read.format("binaryFile").load(found["path"]).select("content").first()[0]
    file = TokenFile.read(content)
    at = place - found["first_doc"]
    return file.doc_id(at), file.document(at)
