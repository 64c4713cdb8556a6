"""Line deduplication with a log-template tree."""

from __future__ import annotations

import hashlib
import math
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, small_batches
from .words import _PLACE, cut, chunks, hashes, mixed

#: Leading tokens that, with the number of tokens, lead to a leaf of the tree.
DEPTH = 3
#: Share of a line's tokens that must equal a template's for the line to join it.
SIMILAR = 0.6
#: Templates of a leaf beyond which they are found by their fields instead of one by one.
WIDE = 256
_WILDCARD = 0


def _lines(data: np.ndarray, offsets: np.ndarray):
    """Tokens and lines of several texts.

    Returns token hashes (0 for tokens with digits), the first token of every line with tokens and
    the end, and of every such line: its text, its number in the text, and a hash of its tokens.
    """
    starts, ends, at = cut(data, offsets)
    if not len(starts):
        none = np.empty(0, np.int64)
        return np.empty(0, np.uint64), none, none, none, none, np.empty(0, np.uint64)
    token = hashes(data, starts, ends, False)
    digits = np.r_[0, np.cumsum((data >= 48) & (data <= 57))]
    token[digits[ends] > digits[starts]] = _WILDCARD
    breaks = np.r_[0, np.cumsum(data == 10)]
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))
    number = breaks[starts] - breaks[offsets[:-1]][text]
    new = np.r_[True, (text[1:] != text[:-1]) | (number[1:] != number[:-1])]
    first = np.flatnonzero(new)
    end = np.r_[first[1:], len(token)]
    place = np.arange(len(token)) - np.repeat(first, end - first)
    spread = mixed(token ^ mixed(place.astype(np.uint64)))
    line = mixed(np.add.reduceat(spread, first) + (end - first).astype(np.uint64))
    return token, first, end, text[first], number[first], line


def _leaves(token: np.ndarray, first: np.ndarray, end: np.ndarray, depth: int) -> np.ndarray:
    leaf = mixed((end - first).astype(np.uint64) + np.uint64(depth << 32))
    for level in range(depth):
        here = np.minimum(first + level, len(token) - 1)
        inside = first + level < end
        leaf = np.where(inside, mixed(leaf * _PLACE[level] + token[here]), leaf)
    return leaf


def _leaf_rows(least_tokens: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id").to_numpy()
            for begin, _, data, offsets in chunks(batch.column("text")):
                token, first, end, text, _, _ = _lines(data, offsets)
                wide = end - first >= least_tokens
                if not wide.any():
                    continue
                pairs = np.stack([text[wide].astype(np.uint64), _leaves(token, first[wide], end[wide], DEPTH)], 1)
                pairs = np.unique(pairs, axis=0)
                yield pa.RecordBatch.from_pydict(
                    {"id": ids[begin + pairs[:, 0].astype(np.int64)], "leaf": pairs[:, 1].view(np.int64)}
                )

    return run


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed for a shuffle, in half the bytes Spark's own compression leaves."""
    press = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        packed = [press.compress((t or "").encode()) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(packed, pa.binary())], ["id", "packed"])


def _unpacked(column: pa.Array) -> list[bytes]:
    loose = zstandard.ZstdDecompressor()
    return [loose.decompress(b) for b in column.to_pylist()]


_LINE_ROWS = "id long, leaf long, line long, tokens array<long>"


def _line_rows(least_tokens: int) -> Callable:
    """The distinct lines of a document that lie in recurring leaves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch.column("leaves")
            out: list[tuple] = []
            for row, (number, raw) in enumerate(zip(batch.column("id").to_pylist(), _unpacked(batch.column("packed")))):
                data = np.frombuffer(raw, np.uint8)
                token, first, end, _, _, line = _lines(data, np.array([0, len(data)]))
                if not len(first):
                    continue
                leaf = _leaves(token, first, end, DEPTH)
                chosen = np.isin(leaf.view(np.int64), wanted[row].values.to_numpy()) & (end - first >= least_tokens)
                _, once = np.unique(np.where(chosen, line, 0), return_index=True)
                once = once[chosen[once]]
                for p in once.tolist():
                    tokens = token[first[p] : end[p]].view(np.int64)
                    out.append((number, leaf[p].view(np.int64), line[p].view(np.int64), tokens))
            if out:
                kinds = [pa.int64()] * 3 + [pa.list_(pa.int64())]
                names = ["id", "leaf", "line", "tokens"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    return run


class Leaf:
    """Templates of one leaf: token hashes, 0 where the field varies.

    Beyond `wide` templates a list for each place and token names the templates that have held it, so
    that a line is compared with those that can be similar only.  What a line joins stays the same.
    """

    def __init__(self, wide: int = WIDE) -> None:
        self.templates = np.empty((0, 0), np.int64)
        self.size = 0
        self.wide = wide
        self.holders: list[dict[int, array]] | None = None

    def add(self, tokens: np.ndarray, similar: float) -> int:
        """The number of the most similar template, generalised to hold the line, or of a new one.

        Ties go to the older template.  The first line of all has number 0.
        """
        if self.size:
            near = self._near(tokens, similar) if self.size > self.wide else None
            share = (self.templates[: self.size] if near is None else self.templates[near]) == tokens
            share = share.mean(1)
            most = share.max(initial=-1.0)
            if most >= similar:
                best = int(share.argmax()) if near is None else int(near[share == most].min())
                template = self.templates[best]
                varies = np.flatnonzero((template != tokens) & (template != _WILDCARD))
                template[varies] = _WILDCARD
                if self.holders is not None:
                    for place in varies.tolist():
                        self._hold(place, _WILDCARD, best)
                return best
        if self.size == len(self.templates):
            more = np.zeros((max(4, 2 * self.size), len(tokens)), np.int64)
            if self.size:
                more[: self.size] = self.templates
            self.templates = more
        self.templates[self.size] = tokens
        self.size += 1
        if self.holders is not None:
            for place, token in enumerate(tokens.tolist()):
                self._hold(place, token, self.size - 1)
        return self.size - 1

    def _hold(self, place: int, token: int, number: int) -> None:
        held = self.holders[place]
        if token not in held:
            held[token] = array("q")
        held[token].append(number)

    def _near(self, tokens: np.ndarray, similar: float) -> np.ndarray | None:
        """The templates that may be similar, some more than once, or None for all.

        One that differs in no more places than allowed is in one of any (that many and one) lists.
        """
        if self.holders is None:
            self.holders = [{} for _ in range(len(tokens))]
            for number in range(self.size):
                for place, token in enumerate(self.templates[number].tolist()):
                    self._hold(place, token, number)
        total = len(tokens)
        equal = math.ceil(similar * total)
        if (equal - 1) / total >= similar:
            equal -= 1
        lists = [held.get(token, ()) for held, token in zip(self.holders, tokens.tolist())]
        lists.sort(key=len)
        lists = lists[: total - equal + 1]
        if equal < 1 or sum(map(len, lists)) >= self.size:
            return None
        return np.concatenate([np.array(x, np.int64) for x in lists]) if lists else np.empty(0, np.int64)


def _templates(similar: float, wide: int) -> Callable:
    """A template for every distinct line; input by leaf, most frequent lines first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leaf, tree = None, Leaf(wide)
        for batch in batches:
            column, out = batch.column("tokens"), []
            offsets, values = column.offsets.to_numpy(), column.values.to_numpy()
            for row, (key, line) in enumerate(zip(batch.column("leaf").to_pylist(), batch.column("line").to_pylist())):
                if key != leaf:
                    leaf, tree = key, Leaf(wide)
                number = tree.add(values[offsets[row] : offsets[row + 1]], similar)
                out.append((line, key, number))
            if out:
                kinds = [pa.int64(), pa.int64(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["line", "leaf", "number"])

    return run


_RESULT = "id long, n_lines long, n_dropped long, kept_sha256 string, kept_text string"


def _cleaned(with_text: bool) -> Callable:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    names = [c.split()[0] for c in _RESULT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            drop, out = batch.column("lines"), []
            for row, (number, raw) in enumerate(zip(batch.column("id").to_pylist(), _unpacked(batch.column("packed")))):
                lines = raw.split(b"\n")
                total = len(lines)
                if drop[row].is_valid:
                    data = np.frombuffer(raw, np.uint8)
                    _, _, _, _, place, line = _lines(data, np.array([0, len(data)]))
                    gone = set(place[np.isin(line.view(np.int64), drop[row].values.to_numpy())].tolist())
                    lines = [x for i, x in enumerate(lines) if i not in gone]
                left = b"\n".join(lines)
                digest = hashlib.sha256(left).hexdigest()
                out.append((number, total, total - len(lines), digest, left.decode() if with_text else None))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    return run


def drop_recurring_lines(
    docs: DataFrame,
    least_docs: int = 10,
    least_tokens: int = 3,
    similar: float = SIMILAR,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_text: bool = False,
) -> DataFrame:
    """Drops the lines whose template occurs in at least `least_docs` documents.

    Lines end at \\n, tokens at white space; tokens with digits are variable.  A line's number of
    tokens and leading tokens lead to a leaf of the tree.  In a leaf, lines join the template that
    shares most tokens with them, `similar` of all at least, and fields that differ become variable;
    lines in more documents come first, ties by hash.  Lines with fewer than `least_tokens` tokens
    stay.  Returns a row for each input row: id_col, n_lines, n_dropped, kept_sha256 of the kept lines,
    and kept_text if asked for.  Null texts are empty (one empty line); rows with a null id lose no
    lines and count for no template; rows that repeat an id are one document.  Tokens are compared
    by 64-bit hashes.  Other columns are not read.

    Only lines of leaves that enough documents reach travel further, each distinct line once.
    """
    small_batches(docs.sparkSession)
    read = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    known = read.filter("id is not null")
    reached = kept(known.mapInArrow(_leaf_rows(least_tokens), "id long, leaf long"), "leaves")
    often = reached.groupBy("leaf").agg(F.count("*").alias("n")).filter(F.col("n") >= least_docs).select("leaf")
    leaves = reached.join(often, "leaf", "left_semi").groupBy("id").agg(F.collect_set("leaf").alias("leaves"))
    packed = read.mapInArrow(_pack, "id long, packed binary")
    lines = kept(packed.join(leaves, "id").mapInArrow(_line_rows(least_tokens), _LINE_ROWS), "lines")

    distinct = lines.groupBy("leaf", "line").agg(F.count_distinct("id").alias("docs"), F.min("tokens").alias("tokens"))
    parsed = (
        distinct.repartition("leaf")
        .sortWithinPartitions("leaf", F.desc("docs"), "line")
        .mapInArrow(_templates(similar, WIDE), "line long, leaf long, number int")
    )
    parsed = kept(parsed.withColumn("template", F.xxhash64("leaf", "number")).select("line", "template"), "templates")
    used = lines.select("id", "line").join(parsed, "line")
    recurring = used.groupBy("template").agg(F.count_distinct("id").alias("docs")).filter(F.col("docs") >= least_docs)
    dropped = used.join(recurring.select("template"), "template", "left_semi")
    dropped = dropped.groupBy("id").agg(F.collect_set("line").alias("lines"))
    rows = packed.join(dropped, "id", "left")
    result = rows.select("id", "packed", "lines").mapInArrow(_cleaned(with_text), _RESULT)
    return (result if with_text else result.drop("kept_text")).withColumnRenamed("id", id_col)
