"""Alignment of two tokenizers over the bytes of a text, by products of sparse incidence matrices."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, small_batches
from .tokens import TEXT, Pools, byte_encoder, flat, split
from .words import chunks, hashes

#: Entries a matrix product writes down at once.
BLOCK = 1 << 22


class Csr:
    """A sparse matrix by rows: the columns of row i are indices[indptr[i]:indptr[i + 1]], their values likewise."""

    def __init__(self, indptr: np.ndarray, indices: np.ndarray, values: np.ndarray, width: int) -> None:
        self.indptr, self.indices, self.values, self.width = indptr, indices, values, width

    @classmethod
    def intervals(cls, sizes: np.ndarray) -> Csr:
        """Ones: row i has the next sizes[i] columns."""
        indptr = np.r_[0, np.cumsum(sizes)]
        width = int(indptr[-1])
        return cls(indptr, np.arange(width), np.ones(width, np.int64), width)

    def __len__(self) -> int:
        return len(self.indptr) - 1

    def rows(self) -> np.ndarray:
        """The row of every entry."""
        return np.repeat(np.arange(len(self)), np.diff(self.indptr))

    def transposed(self) -> Csr:
        order = np.argsort(self.indices, kind="stable")
        indptr = np.r_[0, np.cumsum(np.bincount(self.indices, minlength=self.width))]
        return Csr(indptr, self.rows()[order], self.values[order], len(self))

    def times(self, other: Csr) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """The product's entries (row, column, value), row by row (Gustavson).

        A row of the product is the sum of the other's rows that this one's entries name, each times the
        entry; rows are taken together up to BLOCK terms.
        """
        terms = np.diff(other.indptr)[self.indices]
        before = np.r_[0, np.cumsum(terms)][self.indptr]
        first = 0
        while first < len(self):
            last = max(first + 1, int(np.searchsorted(before, before[first] + BLOCK, "right")) - 1)
            a, b = self.indptr[first], self.indptr[last]
            count = terms[a:b]
            inner = np.repeat(other.indptr[self.indices[a:b]] - (np.cumsum(count) - count), count)
            inner += np.arange(len(inner))
            row = np.repeat(np.repeat(np.arange(first, last), np.diff(self.indptr[first : last + 1])), count)
            column = other.indices[inner]
            value = np.repeat(self.values[a:b], count) * other.values[inner]
            key = row * other.width + column
            if (key[1:] < key[:-1]).any():
                order = np.argsort(key, kind="stable")
                key, row, column, value = key[order], row[order], column[order], value[order]
            begins = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)
            yield row[begins], column[begins], np.add.reduceat(value, begins) if len(begins) else value
            first = last


def product(a: Csr, b: Csr) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    parts = list(a.times(b))
    return tuple(np.concatenate([p[i] for p in parts]) if parts else np.empty(0, np.int64) for i in range(3))


class Aligned:
    """Tokens of two tokenizers over the same bytes, given by their lengths in bytes."""

    def __init__(self, a_sizes: np.ndarray, b_sizes: np.ndarray) -> None:
        self.a, self.b = Csr.intervals(a_sizes), Csr.intervals(b_sizes)  # token x byte
        self.a_ends, self.b_ends = self.a.indptr[1:], self.b.indptr[1:]
        self.cuts = np.intersect1d(self.a_ends, self.b_ends)
        # group x token
        self.a_groups, self.b_groups = (
            Csr.intervals(np.diff(np.r_[0, np.searchsorted(ends, self.cuts, "right")])) for ends in (self.a_ends, self.b_ends)
        )

    def overlap_links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(a token, b token, common bytes) of all that share a byte: A times B transposed."""
        return product(self.a, self.b.transposed())

    def group_links(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(a token, b token) of all that share a group, in parts of bounded size."""
        for a, b, _ in self.a_groups.transposed().times(self.b_groups):
            yield a, b

    def end_links(self) -> tuple[np.ndarray, np.ndarray]:
        """(a token, b token) of the overlapping ones that end together."""
        a, b, _ = self.overlap_links()
        same = self.a_ends[a] == self.b_ends[b]
        return a[same], b[same]


# Bytes of the broad sense of white space before which no text is cut; how their UTF-8 begins.
_SPACES = np.zeros(256, bool)
_SPACES[[0x20, *range(0x09, 0x0E), *range(0x1C, 0x20)]] = True
_TWO = [b"\xc2\x85", b"\xc2\xa0"]
_THREE = [b"\xe1\x9a\x80", b"\xe1\xa0\x8e", b"\xe2\x81\x9f", b"\xe3\x80\x80", b"\xef\xbb\xbf"]
_THREE += [bytes([0xE2, 0x80, c]) for c in (*range(0x80, 0x8C), 0xA8, 0xA9, 0xAF)]


def units(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of the units of texts that each begin with a space: before blanks and line ends behind other signs.

    No token of either tokenizer spans two units, and none depends on another unit.
    """
    blank = (data == 0x20) | (data == 0x0A)
    at = np.flatnonzero(blank[1:] & ~_SPACES[data[:-1]]) + 1
    last = data[at - 1].astype(np.int64)
    two = data[np.maximum(at - 2, 0)].astype(np.int64) << 8 | last
    three = data[np.maximum(at - 3, 0)].astype(np.int64) << 16 | two
    wide = np.isin(two, [int.from_bytes(c) for c in _TWO]) | np.isin(three, [int.from_bytes(c) for c in _THREE])
    starts = offsets[:-1][offsets[1:] > offsets[:-1]]
    return np.union1d(at[~wide], starts)


def byte_signs() -> dict[str, int]:
    """The byte each sign of a byte-level vocabulary stands for: printable Latin-1 bytes are their own signs,
    the others follow from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = (b for b in range(256) if b not in own)
    return {chr(b): b for b in own} | {chr(0x100 + n): b for n, b in enumerate(others)}


class Tokenizers:
    """A byte-level tokenizer (A) and a model of pieces with byte fallback (B), and what they know of units."""

    def __init__(self, a_path: str, b_path: str) -> None:
        import sentencepiece

        self.encode_a = byte_encoder(a_path)
        self.model = sentencepiece.SentencePieceProcessor(model_file=b_path)
        vocabulary = self.encode_a.tokenizer.get_vocab(with_added_tokens=True)
        signs = byte_signs()
        size = max(vocabulary.values()) + 1
        self.a_bytes = [b""] * size
        for token, number in vocabulary.items():
            self.a_bytes[number] = bytes(signs[s] for s in token)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        usual = [p for i, p in enumerate(pieces) if not self.model.is_byte(i)]
        if any("\n" in p or "▁" in p.lstrip("▁") for p in usual):
            raise ValueError(f"{b_path} has pieces that span words or lines")
        self.b_bytes = [
            bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode()
            for i, p in enumerate(pieces)
        ]
        self.space = self.model.piece_to_id("▁")
        self.a_sizes, self.b_sizes = (np.array([len(t) for t in known], np.int64) for known in (self.a_bytes, self.b_bytes))
        self.pools = Pools([np.uint32, np.uint32, np.uint8])

    def encode_b(self, texts: list[str]) -> list[list[int]]:
        """Ids of units; the model itself puts a space before what it is given."""
        found = self.model.encode([t[1:] if t[0] == " " else t for t in texts], num_threads=1)
        return [ids[1:] if t[0] == "\n" else ids if t != " " else [self.space] for t, ids in zip(texts, found)]

    def learn(self, keys: np.ndarray, texts: list[bytes]) -> None:
        strings = [t.decode() for t in texts]
        a, b = self.encode_a(strings), self.encode_b(strings)
        whole = [
            b"".join([self.a_bytes[i] for i in one]) == text == b"".join([self.b_bytes[i] for i in two])
            for one, two, text in zip(a, b, texts)
        ]
        self.pools.add(keys, [flat(a), flat(b), (np.ones(len(texts), np.int64), ~np.array(whole, bool))])

    def pairs(self) -> np.ndarray:
        """All pairs of ids that can end together, as a * (number of B's ids) + b, ascending.

        The bytes of one are the end of the other's, so their number follows from the vocabularies.
        """
        by_bytes: list[dict[bytes, list[int]]] = []
        for known in (self.a_bytes, self.b_bytes):
            index: dict[bytes, list[int]] = {}
            for number, token in enumerate(known):
                if token:
                    index.setdefault(token, []).append(number)
            by_bytes.append(index)
        found = set()
        for long, short, first in ((0, 1, True), (1, 0, False)):
            for token, numbers in by_bytes[long].items():
                for begin in range(len(token)):
                    for other in by_bytes[short].get(token[begin:], ()):
                        found.update((n, other) if first else (other, n) for n in numbers)
        return np.sort(np.fromiter((a * len(self.b_bytes) + b for a, b in found), np.int64, len(found)))


@lru_cache(maxsize=1)
def _opened(a_path: str, b_path: str) -> Tokenizers:
    return Tokenizers(a_path, b_path)


@lru_cache(maxsize=1)
def _pairs(a_path: str, b_path: str) -> np.ndarray:
    return _opened(a_path, b_path).pairs()


def _tokens(texts: pa.Array, known: Tokenizers) -> Iterator[tuple[np.ndarray, ...]]:
    """(first row, a ids, a ids per text, b ids, b ids per text) of parts of a column, a few megabytes each.

    A text that is null or empty, or whose tokens' bytes are not the text's, has none.
    """
    for row, _, data, offsets in chunks(texts, TEXT):
        rows = len(offsets) - 1
        full = offsets[1:] > offsets[:-1]
        data = np.insert(data, offsets[:-1][full], 0x20)
        offsets = offsets + np.r_[0, np.cumsum(full)]
        if not len(data):
            yield row, *[np.empty(0, np.uint32), np.zeros(rows, np.int64)] * 2
            continue
        starts = units(data, offsets)
        ends = np.r_[starts[1:], len(data)]
        keys = hashes(data, starts, ends, False)
        distinct, first, which = np.unique(keys, return_index=True, return_inverse=True)
        new = known.pools.missing(distinct)
        places = first[new]
        known.learn(distinct[new], [data[a:b].tobytes() for a, b in zip(starts[places].tolist(), ends[places].tolist())])
        ranks = known.pools.ranks(distinct)[which]
        at = np.searchsorted(starts, offsets)
        broken = split(known.pools.take(2, ranks).astype(np.int64), at) > 0
        sound = ~np.repeat(broken, np.diff(at))
        out = [row]
        for pool in (0, 1):
            counts = np.where(sound, known.pools.counts(pool, ranks), 0)
            out += [known.pools.take(pool, ranks[sound]), split(counts, at)]
        yield tuple(out)


def _numbers(text: pa.Array, ids: np.ndarray, groups: Csr) -> pa.Array:
    """The ids of each group, written out and joined by commas."""
    written = text.take(pa.array(ids.astype(np.int32)))
    return pc.binary_join(pa.ListArray.from_arrays(groups.indptr.astype(np.int32), written), ",")


_ALIGNED = {
    "doc_id": pa.int64(),
    "n_a": pa.int64(),
    "n_b": pa.int64(),
    "n_groups": pa.int64(),
    "n_links": pa.int64(),
    "groups_sha256": pa.string(),
    "links": pa.list_(pa.int32()),
}
_ALIGNED_DDL = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links array<int>"


def _align(a_path: str, b_path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, pairs = _opened(a_path, b_path), _pairs(a_path, b_path)
        width = len(known.b_bytes)
        written = pa.array([str(i) for i in range(max(len(known.a_bytes), width))])
        for batch in batches:
            for row, a, n_a, b, n_b in _tokens(batch.column("text"), known):
                found = Aligned(known.a_sizes[a], known.b_sizes[b])
                first = np.r_[0, np.cumsum(n_a)]
                link_a, link_b = found.end_links()
                of_pair = np.searchsorted(pairs, a[link_a].astype(np.int64) * width + b[link_b])
                link_at = np.searchsorted(link_a, first)
                ends = np.r_[0, found.a_ends][first]  # in bytes, of every text
                group_at = np.searchsorted(found.cuts, ends, "right")
                groups = pc.binary_join_element_wise(
                    _numbers(written, a, found.a_groups), _numbers(written, b, found.b_groups), "|"
                )
                joined = pc.binary_join(pa.ListArray.from_arrays(group_at.astype(np.int32), groups), ";")
                shas = [hashlib.sha256(j.encode()).hexdigest() if j else "" for j in joined.to_pylist()]
                columns = [
                    batch.column("doc_id").slice(row, len(n_a)),
                    n_a,
                    n_b,
                    np.diff(group_at),
                    np.diff(link_at),
                    shas,
                    pa.ListArray.from_arrays(link_at.astype(np.int32), pa.array(of_pair.astype(np.int32))),
                ]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) if not isinstance(c, pa.Array) else c for c, k in zip(columns, _ALIGNED.values())], list(_ALIGNED))

    return run


def _read(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))


def _link_rows(a_path: str, b_path: str, groups: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _opened(a_path, b_path)
        for batch in batches:
            for row, a, n_a, b, n_b in _tokens(batch.column("text"), known):
                found = Aligned(known.a_sizes[a], known.b_sizes[b])
                first_a, first_b = (np.r_[0, np.cumsum(n)] for n in (n_a, n_b))
                ids = batch.column("doc_id").slice(row, len(n_a))
                parts = ((x, y, None) for x, y in found.group_links()) if groups else found.a.times(found.b.transposed())
                for x, y, common in parts:
                    doc = np.searchsorted(first_a, x, "right") - 1
                    shared = pa.nulls(len(x), pa.int64()) if common is None else pa.array(common)
                    columns = [ids.take(pa.array(doc)), pa.array(x - first_a[doc]), pa.array(y - first_b[doc])]
                    columns += [pa.array(v.astype(np.int64)) for v in (a[x], b[y])]
                    columns += [shared, pa.array(found.a_ends[x] == found.b_ends[y])]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "a_place", "b_place", "a_id", "b_id", "n_bytes", "end_together"])

    return run


_LINK_DDL = "doc_id long, a_place long, b_place long, a_id long, b_id long, n_bytes long, end_together boolean"


def overlap_links(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All pairs of an A and a B token of a document that have bytes in common, and how many.

    Columns: doc_id, a_place and b_place (places of the tokens in the document), a_id, b_id, n_bytes,
    end_together.  Documents as for `alignment`.
    """
    return _read(docs, id_col, text_col).mapInArrow(_link_rows(a_path, b_path, False), _LINK_DDL)


def group_links(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All pairs of an A and a B token of a document that lie in one group; columns as `overlap_links`, n_bytes null.

    A group has as many pairs as the product of its sizes; they are written in parts of bounded size.
    """
    return _read(docs, id_col, text_col).mapInArrow(_link_rows(a_path, b_path, True), _LINK_DDL)


def _counted(n_pairs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_pairs, np.int64)
        for batch in batches:
            total += np.bincount(batch.column("links").flatten().to_numpy(zero_copy_only=False), minlength=n_pairs)
        held = np.flatnonzero(total)
        if len(held):
            yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(total[held])], ["pair", "n"])

    return run


def _summed(counts, best):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            links = batch.column("links")
            at = links.offsets.to_numpy().astype(np.int64)
            of = links.flatten().to_numpy(zero_copy_only=False)
            at -= at[0]
            sums = [pa.array(split(values.value[of].astype(np.int64), at)) for values in (best, counts)]
            names = [n for n in batch.schema.names if n != "links"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *sums], [*names, "n_best", "count_sum"])

    return run


def alignment(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """How the tokens of a byte-level tokenizer (A) and of a model of pieces (B) align over each document's bytes.

    Both encode space + text, special tokens' strings as ordinary text.  Returns per row: doc_id, n_a and n_b
    (tokens), n_groups (runs between bytes at which tokens of both end), n_links (pairs of tokens that end
    together), n_best (links whose pair of ids is, over all documents, the commonest of its B id, or as common),
    count_sum (over the links, how often their pair is linked over all documents), groups_sha256 (of the groups'
    ids, written a,a|b;a|b,b; empty without tokens).  Null and empty texts, and texts whose tokens' bytes are
    not the text's (U+2581 is a space to B), have no tokens.  A token without bytes would link with nothing;
    neither kind of tokenizer has any.  Null ids and rows that repeat are like others; other columns are not read.

    Texts are cut into units that both tokenizers treat alone, so every unit is encoded once for each worker;
    units are told apart by 64-bit hashes.  Links are entries of the product of the token-byte matrices.  Ids
    that end together are of a number fixed by the vocabularies (some 10^5), so their counts may be broadcast.
    """
    spark = docs.sparkSession
    found = kept(_read(docs, id_col, text_col).mapInArrow(_align(a_path, b_path), _ALIGNED_DDL), "aligned")
    pairs = _pairs(a_path, b_path)
    counted = found.select("links").mapInArrow(_counted(len(pairs)), "pair int, n long")
    totals = counted.groupBy("pair").agg(F.sum("n").alias("n")).toArrow()  # at most a row for each pair
    counts = np.zeros(len(pairs), np.int64)
    counts[totals.column("pair").to_numpy()] = totals.column("n").to_numpy()
    of_b = pairs % len(_opened(a_path, b_path).b_bytes)
    highest = np.zeros(int(of_b.max()) + 1, np.int64)
    np.maximum.at(highest, of_b, counts)
    shared = [spark.sparkContext.broadcast(v) for v in (counts, counts == highest[of_b])]
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    return found.mapInArrow(_summed(*shared), _ALIGNED_DDL.replace("links array<int>", "n_best long, count_sum long")).select(
        *columns[:5], "n_best", "count_sum", "groups_sha256"
    )
