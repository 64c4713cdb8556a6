"""N-gram Jaccard join: a grouped prefix join over shingle sets, exact, linear in its written rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, kept, small_batches, stars
from .words import mixed, runs, word_hashes

#: Buckets of the frequency sketch that orders shingles; a fixed size, 1 MB when broadcast.
SKETCH = 1 << 18
_SLICE = 1 << 14
#: Bytes of text whose sets are made at once; their arrays fit into a core's cache.
TEXT = 1 << 17
#: Words of the parity bitmap of a set, 64 bits each.
BITS = 8
#: Larger sets fill that bitmap; they have another one of so many words.
WIDE, WIDE_BITS = 640, 32
#: Places of the bitmap of ids that says which texts clusters need; a fixed size when broadcast.
MARKS = 1 << 24
#: Groups of a posting list, and documents of a cluster, that one task compares at once.
BLOCK = 512
#: Shingles of the documents that are compared at once, unless one pair has more.
BLOCK_SHINGLES = 400_000

#: Members whose hash lies below a share of all hashes are counted, so that members that only one set
#: holds come first in the order.  The share is this many times the prefix's share of a set.
COUNTED = 5 / 3

_LEVEL = np.uint64(58)
_LOW = np.uint64((1 << 58) - 1)


def _sets(texts: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, words of each row, hashes of the rows' distinct k-word shingles, where each row's begin).

    A row's hashes ascend.  A text of fewer words is one shingle.
    """
    for first, _, hashed, at in word_hashes(texts, True, TEXT):
        words = np.diff(at)
        sizes = np.maximum(words - k + 1, np.minimum(words, 1))
        place = np.arange(len(hashed)) - np.repeat(at[:-1], words)
        found = np.zeros(len(hashed), np.uint64)
        found[: max(0, len(hashed) - k + 1)] = runs(hashed, k)
        for few in range(1, k):
            begin = at[:-1][words == few]
            if len(begin):
                found[begin] = runs(hashed[(begin[:, None] + np.arange(few)).ravel()], few)[::few]
        found = found[place < np.repeat(sizes, words)]
        bounds = np.r_[0, np.cumsum(sizes)]
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            found[a:b].sort()
        new = np.ones(len(found), bool)
        new[1:] = found[1:] != found[:-1]
        new[bounds[:-1][sizes > 0]] = True
        yield first, words, found[new], np.r_[0, np.cumsum(new)][bounds]


#: A filled bucket of a slice of the sketch.
_FILLED = np.dtype([("bucket", "<u2"), ("n", "<i8")])


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, counts in zip(*(c.to_pylist() for c in batch.columns)):
            now = np.frombuffer(counts, _FILLED)
            total.setdefault(part, np.zeros(_SLICE, np.int64))[now["bucket"]] += now["n"]
    if total:
        yield pa.RecordBatch.from_pydict(
            {
                "slice": pa.array(list(total), pa.int32()),
                "counts": pa.array([c.tobytes() for c in total.values()], pa.binary()),
            }
        )


def _levels(parts: DataFrame) -> np.ndarray:
    """How far each bucket's count lies above the mean, in powers of two; 0 for most."""
    slices = SKETCH // _SLICE
    parts = parts.repartition(slices, "slice").coalesce(slices).mapInArrow(_summed, "slice int, counts binary")
    counts = np.zeros(SKETCH, np.int64)
    for part, blob in parts.collect():  # SKETCH numbers
        counts[part * _SLICE : (part + 1) * _SLICE] += np.frombuffer(blob, np.int64)
    mean = max(1.0, counts.sum() / SKETCH)
    return np.floor(np.log2(np.maximum(counts / mean, 1.0))).astype(np.uint8)


def _prefix_length(n, num: int, den: int):
    """Two sets that link share one of the first members in any global order."""
    return n - -(-n * num // den) + 1


def _sum(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums between consecutive places."""
    summed = np.r_[values.dtype.type(0), np.cumsum(values, dtype=values.dtype)]
    return summed[at[1:]] - summed[at[:-1]]


def _set_hashes(spread: np.ndarray, at: np.ndarray) -> np.ndarray:
    return _sum(spread, at).view(np.int64)


def _lists_of(values: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values.view(np.int64)))


_SKETCHED = "slice int, counts binary"
_SIGNED = "id long, words int, n int, one long, two long, bits array<long>, wide array<long>"
_SIGNED_KINDS = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), *[pa.list_(pa.int64())] * 2]


def _parities(row: np.ndarray, spread: np.ndarray, rows: int, words: int) -> np.ndarray:
    """Parity bitmaps of the rows' values, one after the other."""
    places = 64 * words
    flips = np.bincount(row * places + (spread % np.uint64(places)).astype(np.int64), minlength=rows * places) & 1
    return np.packbits(flips.astype(np.uint8)).view(np.uint64)


def _signed(k: int, beside: list[str]) -> Callable:
    """A row for each set: words, size, two hashes and parity bitmaps; then rows of the frequency sketch.

    Columns beside id and text stay with their rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SKETCH, np.int64)
        names = [*(c.split()[0] for c in f"{_SIGNED}, {_SKETCHED}".split(", ")), *beside]
        kept_kinds = []
        for batch in batches:
            kept_kinds = [batch.schema.field(c).type for c in beside]
            sketched = []
            for first, words, found, at in _sets(batch.column("text"), k):
                rows = len(words)
                spread = mixed(found)
                row = np.repeat(np.arange(rows), np.diff(at))
                large = np.diff(at) > WIDE
                wide_at = np.r_[0, np.cumsum(large)]
                wide = _parities(wide_at[row[large[row]]], spread[large[row]], int(wide_at[-1]), WIDE_BITS)
                sketched.append((found % np.uint64(SKETCH)).astype(np.int32))
                part = batch.slice(first, rows)
                columns = [
                    part.column("id"),
                    pa.array(words, pa.int32()),
                    pa.array(np.diff(at), pa.int32()),
                    pa.array(_set_hashes(spread, at)),
                    pa.array(_set_hashes(mixed(found ^ np.uint64(0xABCDEF)), at)),
                    _lists_of(_parities(row, spread, rows, BITS), np.arange(rows + 1) * BITS),
                    _lists_of(wide, wide_at * WIDE_BITS),
                    pa.nulls(rows, pa.int32()),
                    pa.nulls(rows, pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays([*columns, *(part.column(c) for c in beside)], names)
            if sketched:
                counts += np.bincount(np.concatenate(sketched), minlength=SKETCH)
        if counts.any():
            filled = np.flatnonzero(counts)
            cells = np.empty(len(filled), _FILLED)
            cells["bucket"], cells["n"] = filled % _SLICE, counts[filled]
            cuts = np.searchsorted(filled, np.arange(0, SKETCH + 1, _SLICE))
            parts = [(i, cells[a:b].tobytes()) for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])) if a < b]
            columns = [pa.nulls(len(parts), kind) for kind in _SIGNED_KINDS]
            columns += [pa.array([i for i, _ in parts], pa.int32()), pa.array([c for _, c in parts], pa.binary())]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.nulls(len(parts), kind) for kind in kept_kinds)], names)

    return run


def _in_order(k: int, num: int, den: int, levels) -> Callable:
    """The first members of every set: all that are counted, and a prefix's length at least.

    A set that repeats under one id is told once by each task.  The global order: buckets of the sketch near the mean first, then by hash.
    """
    below = np.uint64(int(min(1.0, COUNTED * (den - num) / den) * (1 << 58)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            ids = batch.column("id").to_pylist()
            for first, _, found, at in _sets(batch.column("text"), k):
                spread = mixed(found)
                ones, sizes = _set_hashes(spread, at), np.diff(at)
                level = levels.value[(found % np.uint64(SKETCH)).astype(np.int64)].astype(np.uint64)
                order = (level << _LEVEL) | (spread & _LOW)
                for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
                    order[a:b].sort()
                counted = _sum((order < below).astype(np.int64), at)
                taken = np.minimum(np.maximum(counted, _prefix_length(sizes, num, den)), sizes)
                rank = np.arange(len(order)) - np.repeat(at[:-1], sizes)
                members = _lists_of(order[rank < np.repeat(taken, sizes)], np.r_[0, np.cumsum(taken)])
                rows = []
                for row, (key, size) in enumerate(zip(zip(ids[first : first + len(sizes)], ones.tolist()), sizes.tolist())):
                    if size and key not in seen:
                        seen.add(key)
                        rows.append(row)
                columns = [batch.column("id").slice(first, len(sizes)), pa.array(ones), pa.array(counted, pa.int32()), members]
                told = pa.RecordBatch.from_arrays(columns, ["id", "one", "counted", "members"])
                yield told if len(rows) == len(sizes) else told.take(pa.array(rows, pa.int64()))

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose token another row has too; input sorted by token."""
    held = None  # the last row, if the rows so far do not show another one
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        tokens, ids = batch.column("token").to_numpy(), batch.column("id").to_numpy()
        start = tokens[0] == last
        if held is not None:
            tokens, ids = np.r_[held[0], tokens], np.r_[held[1], ids]
            start = False
        same = tokens[1:] == tokens[:-1]
        shared = np.r_[start, same] | np.r_[same, False]
        held = None if shared[-1] else (tokens[-1:], ids[-1:])
        last = tokens[-1]
        yield pa.RecordBatch.from_pydict({"token": tokens[shared], "id": ids[shared]})


def _forest(n: int, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Edges that connect what the given edges connect, without cycles."""
    up = list(range(n))
    kept_edges = []
    for a, b in zip(left.tolist(), right.tolist()):
        x, y = a, b
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        while up[y] != y:
            up[y] = up[up[y]]
            y = up[y]
        if x != y:
            up[max(x, y)] = min(x, y)
            kept_edges.append((a, b))
    return kept_edges


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries of posting lists with at least two groups, numbered in blocks; input by token, n."""
    held = token = None
    number = 0
    for batch in batches:
        tokens = batch.column("token").to_numpy()
        if not len(tokens):
            continue
        groups, sizes = batch.column("gid").to_numpy(), batch.column("n").to_numpy()
        if held is not None:
            tokens, groups, sizes = (np.r_[h, x] for h, x in zip(held, (tokens, groups, sizes)))
        new = np.r_[True, tokens[1:] != tokens[:-1]]
        begins = np.flatnonzero(new)
        rank = np.arange(len(tokens)) - np.repeat(begins, np.diff(np.r_[begins, len(tokens)]))
        if tokens[0] == token:  # goes on from the batch before
            rank[: begins[1] if len(begins) > 1 else len(rank)] += number
        token, number = tokens[-1], int(rank[-1]) + 1
        alone = np.r_[new[1:], True] & (rank == 0)
        held = None
        if alone[-1]:  # perhaps not alone; the next batch tells
            held, token, number = (tokens[-1:], groups[-1:], sizes[-1:]), None, 0
        yield pa.RecordBatch.from_pydict(
            {
                "token": tokens[~alone],
                "block": (rank[~alone] // BLOCK).astype(np.int32),
                "gid": groups[~alone],
                "n": sizes[~alone],
            }
        )


def _grouped(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.Table]:
    """Tables of whole groups, cut where the key columns change; input is sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch.column(n).to_numpy() for n in names]
        change = np.zeros(batch.num_rows, bool)
        for key in keys:
            change[1:] |= key[1:] != key[:-1]
        change[0] = last is not None and tuple(k[0] for k in keys) != last
        last = tuple(k[-1] for k in keys)
        cuts = np.flatnonzero(change)
        if len(cuts):
            end = int(cuts[-1])
            held.append(batch.slice(0, end))
            if sum(b.num_rows for b in held):
                yield pa.Table.from_batches(held)
            held = [batch.slice(end)]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def _bounds(found: pa.Table, names: list[str]) -> np.ndarray:
    change = np.zeros(found.num_rows, bool)
    change[0] = True
    for name in names:
        key = found.column(name).to_numpy()
        change[1:] |= key[1:] != key[:-1]
    return np.r_[np.flatnonzero(change), found.num_rows]


def _matrix(column, words: int = BITS) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy().reshape(-1, words).view(np.uint64)


def _candidates(num: int, den: int) -> Callable:
    """Edges between groups that may link, of every posting list or pair of its blocks."""

    def passing(a, b, sizes, same, ones, wide, row):
        small, large = np.minimum(sizes[a], sizes[b]), np.maximum(sizes[a], sizes[b])
        known = same[a] & same[b]
        apart = np.bitwise_count((ones[a] ^ ones[b]) & known).sum(-1)
        # |A xor B| <= (den - num) / (den + num) * (|A| + |B|) for sets that link
        most = (den - num) * (small + large) // (den + num)
        ok = (den * small >= num * large) & (apart <= most)
        if len(wide):
            x, y = np.broadcast_arrays(row[a], row[b])
            both = ok & (x >= 0) & (y >= 0)
            ok[both] = np.bitwise_count(wide[x[both]] ^ wide[y[both]]).sum(-1) <= most[both]
        return ok

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["token", "i", "j"]
        for found in _grouped(batches, names):
            at = _bounds(found, names)
            groups, sizes = found.column("gid").to_numpy(), found.column("n").to_numpy().astype(np.int64)
            ones, both = _matrix(found.column("all_ones")), _matrix(found.column("any_ones"))
            same = ~(ones ^ both)  # positions at which the members of a group agree
            wide = _matrix(found.column("wide"), WIDE_BITS)
            large = found.column("wide").combine_chunks().value_lengths().to_numpy() > 0
            row = np.where(large, np.cumsum(large) - 1, -1)  # of the wide bitmap, where there is one
            lengths = np.diff(at)
            left, right = [], []
            for length in np.unique(lengths[(lengths > 1) & (lengths <= 16)]):
                begins = at[:-1][lengths == length]
                i, j = np.triu_indices(length, 1)
                a, b = (begins[:, None] + i).ravel(), (begins[:, None] + j).ravel()
                ok = passing(a, b, sizes, same, ones, wide, row)
                left.append(groups[a[ok]])
                right.append(groups[b[ok]])
            for list_number in np.flatnonzero(lengths > 16):
                begin, length = int(at[list_number]), int(lengths[list_number])
                pairs_a, pairs_b = [], []
                all_of_it = np.arange(begin, begin + length)
                for x in range(0, length, 64):
                    a, b = all_of_it[x : x + 64, None], all_of_it[None, x:]
                    ok_a, ok_b = np.nonzero(passing(a, b, sizes, same, ones, wide, row) & (a < b))
                    pairs_a.append(ok_a + x)
                    pairs_b.append(ok_b + x)
                for a, b in _forest(length, np.concatenate(pairs_a), np.concatenate(pairs_b)):
                    left.append(groups[begin + a : begin + a + 1])
                    right.append(groups[begin + b : begin + b + 1])
            a = np.concatenate(left) if left else np.empty(0, np.int64)
            b = np.concatenate(right) if right else np.empty(0, np.int64)
            pairs = np.unique(np.stack([np.maximum(a, b), np.minimum(a, b)], 1), axis=0)
            yield pa.RecordBatch.from_pydict({"a": pairs[:, 0], "b": pairs[:, 1]})

    return run


_PLACE = ("cluster", "id", "block", "last")


def _placed(clusters: DataFrame, classes: DataFrame) -> DataFrame:
    """Every member of a cluster with its block, so that a block's shingles stay bounded."""
    least = BLOCK_SHINGLES // BLOCK
    sized = clusters.join(classes.select(F.col("rep").alias("node"), "n"), "node")
    blocks = sized.groupBy("component").agg(
        F.ceil(F.sum(F.greatest("n", F.lit(least))) / BLOCK_SHINGLES).cast("int").alias("blocks")
    )
    placed = clusters.join(blocks, "component")
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    return placed.select(
        F.col("component").alias("cluster"), F.col("node").alias("id"), block.alias("block"), (F.col("blocks") - 1).alias("last")
    )


def _marked(read: DataFrame, clusters: DataFrame) -> DataFrame:
    """Rows with an id of a cluster, and few others: those whose place in a bitmap of ids is marked."""
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(MARKS))
    marks = clusters.select(place("node").alias("place")).groupBy(F.expr("place div 64").alias("word"))
    marks = marks.agg(F.expr("bit_or(shiftleft(1L, int(place % 64)))").alias("marks"))
    rows = read.withColumn("place", place("id")).withColumn("word", F.expr("place div 64"))
    return rows.join(F.broadcast(marks), "word").filter("getbit(marks, int(place % 64)) = 1").select(*read.columns)


def _members(k: int) -> Callable:
    """The sets of the members of clusters; one that repeats under one id is told once by each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int, int]] = set()
        for batch in batches:
            places = list(zip(batch.column("id").to_pylist(), batch.column("block").to_pylist()))
            for first, words, found, at in _sets(batch.column("text"), k):
                rows, ones = [], _set_hashes(mixed(found), at)
                for row, one in enumerate(ones.tolist()):
                    if (*places[first + row], one) not in seen:
                        seen.add((*places[first + row], one))
                        rows.append(row)
                part = batch.slice(first, len(words))
                columns = [*(part.column(c) for c in _PLACE), pa.array(ones), _lists_of(found, at)]
                told = pa.RecordBatch.from_arrays(columns, [*_PLACE, "one", "shingles"])
                yield told if len(rows) == len(words) else told.take(pa.array(rows, pa.int64()))

    return run


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count[column] > 1
    _, column = np.unique(column[shared], return_inverse=True)
    owner = owner[shared]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    found = np.zeros((len(sets), len(sets)), np.float32)
    width = 4096
    top = int(column[-1]) + 1 if len(column) else 0
    cuts = np.searchsorted(column, np.arange(0, top + width, width))
    for number, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
        if a == b:
            continue
        part = np.zeros((len(sets), width), np.float32)
        part[owner[a:b], column[a:b] - number * width] = 1
        found += part @ part.T
    return found.astype(np.int64)


def _verified(num: int, den: int) -> Callable:
    """Links of every cluster, or pair of its blocks, thinned to a forest."""
    names = ["cluster", "i", "j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in _grouped(batches, names):
            at = _bounds(found, names)
            ids = found.column("id").to_numpy()
            column = found.column("shingles").combine_chunks()
            offsets, values = column.offsets.to_numpy(), column.values.to_numpy().view(np.uint64)
            out_a, out_b = [], []
            for begin, end in zip(at[:-1].tolist(), at[1:].tolist()):
                sets = [values[offsets[r] : offsets[r + 1]] for r in range(begin, end)]
                if len(sets) < 2:
                    continue
                sizes = np.array([len(s) for s in sets])
                common = _overlaps(sets)
                union = sizes[:, None] + sizes[None, :] - common
                a, b = np.nonzero(np.triu(den * common >= num * union, 1))
                for x, y in _forest(len(sets), a, b):
                    out_a.append(ids[begin + x])
                    out_b.append(ids[begin + y])
            yield pa.RecordBatch.from_pydict(
                {"a": pa.array(out_a, pa.int64()), "b": pa.array(out_b, pa.int64())}
            )

    return run


def _block_pairs(rows: DataFrame) -> DataFrame:
    """Rows (.., block, last) once for every pair i <= j of the last + 1 blocks they belong to."""
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("last"))))
    i, j = F.least("block", "other"), F.greatest("block", "other")
    return rows.withColumns({"i": i, "j": j}).drop("block", "last", "other")


def jaccard_components(
    docs: DataFrame,
    k: int = 5,
    num: int = 80,
    den: int = 100,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Components of documents that share num/den of their k-word shingles.

    Texts are lower-cased in A-Z and cut at white space.  A document's set holds its distinct k-word
    shingles, or its whole word sequence where that is shorter; without words the set is empty and
    links with nothing.  Two documents link when den * |A and B| >= num * |A or B|.  Returns a row
    for each input row: id_col, n_shingles, component_id (smallest id reachable by links, itself
    included).  Null texts are empty; a null id links with nothing.  Other columns are not read.
    Shingles are told apart by 58 bits of a hash.

    Equal sets are one class, rows that repeat an id with its set are one row, and classes with equal size and equal prefix (the first members in a
    global order, rare first) are one group.  A class whose whole prefix no other class holds drops
    out.  Groups that share a prefix member and have fitting sizes and bitmaps are candidates; the
    members of connected candidates are compared in full; only their texts are shuffled.  Long posting lists and large clusters
    are cut into blocks, compared pair by pair, and every block gives a forest, not all its pairs.
    """
    read = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return joined(read, k, num, den).select(
        F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), F.col("component").alias("component_id")
    )


def joined(read: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(id, words, n, component, others): the components of `jaccard_components` with the texts' numbers of words.

    Columns of the documents (id, text, others) beside id and text stay with their rows.
    """
    spark = read.sparkSession
    small_batches(spark)
    candidates, verified = _candidates(num, den), _verified(num, den)
    beside = [f for f in read.schema.fields if f.name not in ("id", "text")]
    others = [f.name for f in beside]
    kinds = "".join(f", {f.name} {f.dataType.simpleString()}" for f in beside)
    signed = kept(read.mapInArrow(_signed(k, others), f"{_SIGNED}, {_SKETCHED}{kinds}"), "sets")
    read = read.select("id", "text")
    levels = spark.sparkContext.broadcast(_levels(signed.filter("slice is not null").select("slice", "counts")))
    signed = signed.filter("slice is null").drop("slice", "counts")

    bits = [f"b{i}" for i in range(BITS)]
    classes = signed.filter("n > 0 and id is not null").groupBy("n", "one", "two").agg(
        F.min("id").alias("rep"), F.min("bits").alias("bits"), F.min("wide").alias("wide")
    )
    classes = kept(
        classes.select("n", "one", "two", "rep", "wide", *(F.col("bits")[i].alias(b) for i, b in enumerate(bits))), "classes"
    )
    first = kept(
        read.filter("id is not null")
        .mapInArrow(_in_order(k, num, den, levels), "id long, one long, counted int, members array<long>")
        .join(classes.select(F.col("rep").alias("id"), "one", "n"), ["id", "one"])
        .select("id", "one", "n", "counted", "members"),
        "first-members",
    )
    repeats = first.count() > classes.count()  # several tasks told a set that repeats under its id
    if repeats:
        first = kept(first.dropDuplicates(["id", "one"]), "first-members")
    counted = first.select("id", F.explode(F.slice("members", F.lit(1), F.col("counted"))).alias("token"))
    shared = (
        counted.repartition("token")
        .sortWithinPartitions("token")
        .mapInArrow(_shared, "token long, id long")
        .groupBy("id")
        .agg(F.sort_array(F.collect_list("token")).alias("shared"))
    )
    # Counted members of one set alone come first in the order, then the others.
    wanted = F.expr(f"n - int((n * {num} + {den - 1}) div {den}) + 1 - (counted - size(shared))")
    nothing = F.array().cast("array<long>")
    rest = F.slice("members", F.col("counted") + 1, F.greatest(F.size("members") - F.col("counted"), F.lit(0)))
    prefixes = first.withColumn("rest", rest).drop("members", "one").join(shared, "id", "left")
    prefixes = prefixes.withColumn("shared", F.coalesce("shared", nothing)).withColumn("wanted", wanted)
    prefixes = prefixes.filter("wanted > 0").select(
        "id", "n", F.slice(F.concat("shared", "rest"), F.lit(1), F.col("wanted")).alias("prefix")
    )
    prefixes = kept(prefixes.withColumn("shape", F.xxhash64("prefix")), "prefixes")
    members = kept(
        prefixes.select("id", "n", "shape").join(classes.select(F.col("rep").alias("id"), "wide", *bits), "id"), "members"
    )
    groups = members.groupBy("n", "shape").agg(
        F.min("id").alias("gid"),
        F.when(F.count("*") == 1, F.min("wide")).alias("wide"),
        *(F.expr(f"bit_and({b})").alias(f"and_{b}") for b in bits),
        *(F.expr(f"bit_or({b})").alias(f"or_{b}") for b in bits),
    )
    groups = kept(
        groups.select(
            "n", "shape", "gid",
            F.array(*(f"and_{b}" for b in bits)).alias("all_ones"),
            F.array(*(f"or_{b}" for b in bits)).alias("any_ones"),
            F.coalesce("wide", nothing).alias("wide"),
        ),
        "groups",
    )
    postings = (
        prefixes.select("id", "n", "prefix")
        .join(groups.select(F.col("gid").alias("id")), "id", "left_semi")
        .select(F.explode("prefix").alias("token"), F.col("id").alias("gid"), "n")
    )
    lists = kept(
        postings.repartition("token")
        .sortWithinPartitions("token", "n", "gid")
        .mapInArrow(_lists, "token long, block int, gid long, n int"),
        "lists",
    )
    long_lists = lists.filter("block > 0").groupBy("token").agg(F.max("block").alias("last"))
    entries = lists.join(long_lists, "token", "left").fillna(0, ["last"])
    entries = _block_pairs(entries).join(groups.select("gid", "all_ones", "any_ones", "wide"), "gid")
    near = (
        entries.repartition("token", "i", "j")
        .sortWithinPartitions("token", "i", "j")
        .mapInArrow(lambda batches: stars(candidates(batches)), "a long, b long")
    )
    within = members.join(groups.select("n", "shape", "gid"), ["n", "shape"]).filter("id <> gid")
    within = within.select(F.col("id").alias("a"), F.col("gid").alias("b"))
    clusters = kept(components(near.unionByName(within), "candidates"), "clusters")

    sets = (
        _marked(read, clusters).join(_placed(clusters, classes), "id")
        .select(*_PLACE, "text")
        .mapInArrow(_members(k), "cluster long, id long, block int, last int, one long, shingles array<long>")
    )
    compared = _block_pairs((sets.dropDuplicates([*_PLACE, "one"]) if repeats else sets).drop("one"))
    links = (
        compared.repartition("cluster", "i", "j")
        .sortWithinPartitions("cluster", "i", "j")
        .mapInArrow(lambda batches: stars(verified(batches)), "a long, b long")
    )
    linked = components(links, "links")
    reps = classes.join(linked, classes["rep"] == linked["node"], "left").select(
        "n", "one", "two", F.coalesce("component", "rep").alias("component")
    )
    reps = kept(reps, "class-components")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return signed.join(reps, ["n", "one", "two"], "left").select("id", "words", "n", component.alias("component"), *others)


def without_near_copies(
    docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The documents with the smallest id of their component, with all columns."""
    found = jaccard_components(docs, k, num, den, id_col, text_col)
    lost = found.filter(F.col("component_id") < F.col(id_col)).select(id_col).distinct()
    return docs.join(lost, id_col, "left_anti")
