"""Substring deduplication with suffix automata of reference shards."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, small_batches
from .words import chunks, cut, hashes, mixed, runs, word_hashes

#: Words of an anchor; the smallest of the anchors in a window names the window's shard.
ANCHOR = 5
#: Reference passages of one automaton.
SHARD = 2048
_ANCHOR_BITS = np.uint64((1 << 40) - 1)


def _passages(hashed: np.ndarray, at: np.ndarray, window: int):
    """Maximal runs of windows with one smallest anchor: (first window, windows, anchor, hash, text).

    Which run a window falls into depends on its own words alone, except for the run's ends: equal
    windows always have equal anchors.
    """
    n = len(hashed) - window + 1
    empty = np.empty(0, np.int64)
    if n <= 0:
        return empty, empty, empty.view(np.uint64), empty.view(np.uint64), empty
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
    inside = owner[:n] == owner[window - 1 :]
    grams = runs(hashed, ANCHOR)
    best, place = grams[:n].copy(), np.arange(n)
    for j in range(1, window - ANCHOR + 1):
        less = grams[j : j + n] < best
        best = np.where(less, grams[j : j + n], best)
        place = np.where(less, np.arange(j, j + n), place)
    whole = runs(hashed, window)
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | (place[1:] != place[:-1])
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | (place[1:] != place[:-1])
    first, last = np.flatnonzero(begins), np.flatnonzero(ends)
    count = last - first + 1
    text = mixed(whole[first] * np.uint64(3) + mixed(whole[last] + count.astype(np.uint64)))
    return first, count, mixed(best[first]) & _ANCHOR_BITS, text, owner[first]


def _anchored(window: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id").to_numpy()
            for begin, _, hashed, at in word_hashes(batch.column("text"), False):
                _, _, anchor, text, owner = _passages(hashed, at, window)
                # A passage that repeats within its document is one row.
                order = np.lexsort((text, owner))
                new = np.ones(len(order), bool)
                new[1:] = (text[order][1:] != text[order][:-1]) | (owner[order][1:] != owner[order][:-1])
                once = order[new]
                for a in range(0, len(once), 65536):
                    z = once[a : a + 65536]
                    yield pa.RecordBatch.from_pydict(
                        {
                            "anchor": anchor[z].view(np.int64),
                            "passage": text[z].view(np.int64),
                            "id": ids[begin + owner[z]],
                        }
                    )

    return run


_MARKS = "id long, passage long, anchor long, block int"


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Passages to remove whole (block null) or to look up, from rows by anchor, passage, id.

    A passage that a smaller id also holds goes whole.  The first document of each passage is
    looked up against the other passages of the anchor, if there are any.
    """
    anchor_now = passage_now = first_now = None
    several, rank_now = False, 0
    held: dict[str, np.ndarray] | None = None  # rows of an anchor's only passage so far

    def batch_of(rows: dict[str, np.ndarray], block) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict(
            {
                "id": rows["id"],
                "passage": rows["passage"],
                "anchor": rows["anchor"],
                "block": block if block is not None else pa.nulls(len(rows["id"]), pa.int32()),
            }
        )

    for batch in batches:
        rows = {name: batch.column(name).to_numpy() for name in ("id", "passage", "anchor")}
        n = len(rows["id"])
        if not n:
            continue
        anchor, passage, ids = rows["anchor"], rows["passage"], rows["id"]
        goes_on = anchor[0] == anchor_now
        same_passage = goes_on and passage[0] == passage_now
        new_anchor = np.r_[not goes_on, anchor[1:] != anchor[:-1]]
        new_passage = new_anchor | np.r_[not same_passage, passage[1:] != passage[:-1]]
        start = np.maximum.accumulate(np.where(new_passage, np.arange(n), -1))
        firsts = np.where(start >= 0, ids[np.maximum(start, 0)], first_now if same_passage else 0)
        copy = ids > firsts
        # passages of every anchor, as far as seen
        run = np.cumsum(new_anchor)  # 0: the anchor at hand
        found = np.bincount(run[new_passage], minlength=run[-1] + 1)
        many = found > 1
        many[0] = several or (goes_on and found[0] > 0)
        if held is not None and (many[0] or not goes_on or run[-1] > 0):
            if many[0]:
                yield batch_of(held, np.zeros(len(held["id"]), np.int32))
            held = None
        look = ~copy & many[run]
        # numbers of looked-up rows within their anchor
        counted = np.cumsum(~copy)
        before = np.where(new_anchor, counted - ~copy, 0)
        base = np.maximum.accumulate(before)
        rank = counted - base - 1
        rank[run == 0] += rank_now if goes_on else 0
        if copy.any():
            yield batch_of({k: v[copy] for k, v in rows.items()}, None)
        if look.any():
            yield batch_of({k: v[look] for k, v in rows.items()}, (rank[look] // SHARD).astype(np.int32))
        tail = run == run[-1]
        if not many[run[-1]]:
            wait = {k: v[tail & ~copy] for k, v in rows.items()}
            if held is not None:
                wait = {k: np.r_[held[k], wait[k]] for k in wait}
            held = wait
        several = bool(many[run[-1]])
        rank_now = int((tail & ~copy).sum()) + (rank_now if run[-1] == 0 else 0)
        anchor_now, passage_now, first_now = anchor[-1], passage[-1], firsts[-1]


_LOOKUP = "anchor long, shard int, visiting boolean, id long, passage long, words array<long>"


def _looked_up(window: int) -> Callable:
    """The words of the passages to look up, once for each shard they meet."""
    names = ("anchor", "shard", "visiting", "id", "passage", "words")
    kinds = [pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.list_(pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, marks = batch.column("id").to_pylist(), batch.column("marks")
            out: list[list] = [[] for _ in names]
            for begin, end, hashed, at in word_hashes(batch.column("text"), False):
                first, count, _, text, owner = _passages(hashed, at, window)
                bounds = np.searchsorted(owner, np.arange(end - begin + 1))
                for row in range(begin, end):
                    a, b = bounds[row - begin], bounds[row - begin + 1]
                    place = dict(zip(text[a:b].view(np.int64).tolist(), range(a, b)))
                    for mark in marks[row].as_py():
                        p = place.get(mark["passage"])
                        if p is None:
                            continue
                        words = hashed[first[p] : first[p] + count[p] + window - 1].view(np.int64)
                        for shard in range(mark["last"] + 1):
                            values = (
                                mark["anchor"],
                                shard,
                                shard != mark["block"],
                                ids[row],
                                mark["passage"],
                                words,
                            )
                            for column, value in zip(out, values):
                                column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], list(names))

    return run


class SuffixAutomaton:
    """Suffix automaton of several word sequences; each state knows the first id that reached it.

    Sequences are added in the order of their ids, so the first id of a state is the smallest id of
    all sequences in which the state's strings occur.
    """

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.first = [-1], [0], [0]

    def add(self, words: list[int], number: int) -> None:
        next_, link, length, first = self.next, self.link, self.length, self.first
        last = 0
        for word in words:
            q = next_[last].get(word)
            if q is not None and length[q] == length[last] + 1:
                last = q
                continue
            if q is None:
                state = len(next_)
                next_.append({})
                link.append(0)
                length.append(length[last] + 1)
                first.append(number)
                p = last
                while p != -1 and word not in next_[p]:
                    next_[p][word] = state
                    p = link[p]
                if p == -1:
                    last = state
                    continue
                q = next_[p][word]
                if length[p] + 1 == length[q]:
                    link[state] = q
                    last = state
                    continue
            else:
                state, p = -1, last
            clone = len(next_)
            next_.append(next_[q].copy())
            link.append(link[q])
            length.append(length[p] + 1)
            first.append(first[q])
            while p != -1 and next_[p].get(word) == q:
                next_[p][word] = clone
                p = link[p]
            link[q] = clone
            if state >= 0:
                link[state] = clone
            last = state if state >= 0 else clone

    def matches(self, words: list[int], least: int) -> Iterator[tuple[int, int]]:
        """(end, first id) for every position at which the longest match has `least` words or more."""
        next_, link, length, first = self.next, self.link, self.length, self.first
        state = matched = 0
        for end, word in enumerate(words, 1):
            while state and word not in next_[state]:
                state = link[state]
                matched = length[state]
            if word in next_[state]:
                state = next_[state][word]
                matched += 1
            if matched >= least:
                up = state
                while length[link[up]] >= least:
                    up = link[up]
                yield end, first[up]


def _streamed(window: int) -> Callable:
    """Which windows of each passage a smaller id holds; input by anchor, shard, visiting, id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, own, automaton = None, [], SuffixAutomaton()
        out: list[tuple] = []

        def look(number: int, passage: int, words: list[int]) -> None:
            gone = 0
            for end, holder in automaton.matches(words, window):
                if holder < number:
                    gone |= 1 << (end - window)
            if gone:
                out.append((number, passage, gone))

        def look_at_own() -> None:
            for row in own:
                look(*row)
            own.clear()

        for batch in batches:
            columns = [batch.column(n).to_pylist() for n in ("anchor", "shard", "visiting", "id", "passage")]
            words = batch.column("words")
            offsets, values = words.offsets.to_numpy(), words.values.to_numpy()
            for r, (anchor, part, visiting, *row) in enumerate(zip(*columns)):
                if (anchor, part) != shard:
                    look_at_own()
                    shard, automaton = (anchor, part), SuffixAutomaton()
                sequence = values[offsets[r] : offsets[r + 1]].tolist()
                if visiting:
                    look_at_own()
                    look(*row, sequence)
                else:
                    automaton.add(sequence, row[0])
                    own.append((*row, sequence))
            if out:
                yield _as_batch(out)
                out.clear()
        look_at_own()
        if out:
            yield _as_batch(out)

    return run


def _as_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 3
    names = ["id", "passage", "windows"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


_RESULT = "id long, n_words long, n_removed long, kept_sha256 string, kept_text string"


def _cleaned(window: int, with_text: bool) -> Callable:
    names = [c.split()[0] for c in _RESULT.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def removed_words(data: np.ndarray, marks: list[dict]) -> np.ndarray:
        offsets = np.array([0, len(data)])
        starts, ends, at = cut(data, offsets)
        first, count, _, text, _ = _passages(hashes(data, starts, ends, False), at, window)
        gone = np.zeros(len(starts) + 1, np.int64)
        held: dict[int, int] = {}
        for mark in marks:
            held[mark["passage"]] = held.get(mark["passage"], 0) | mark["windows"]
        text = text.view(np.int64)
        for p in np.flatnonzero(np.isin(text, list(held))).tolist():
            windows = held[int(text[p])]
            for j in range(count[p]):
                if windows >> j & 1:
                    gone[first[p] + j] += 1
                    gone[first[p] + j + window] -= 1
        return np.cumsum(gone[:-1]) > 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks, out = batch.column("marks"), []
            ids = batch.column("id").to_pylist()
            for begin, end, data, offsets in chunks(batch.column("text")):
                for row in range(begin, end):
                    own = data[offsets[row - begin] : offsets[row - begin + 1]]
                    words = own.tobytes().split()
                    total, lost = len(words), 0
                    if marks[row].is_valid:
                        gone = removed_words(own, marks[row].as_py())
                        lost = int(gone.sum())
                        words = list(compress(words, (~gone).tolist()))
                    left = b" ".join(words)
                    digest = hashlib.sha256(left).hexdigest()
                    out.append((ids[row], total, lost, digest, left.decode() if with_text else None))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    return run


def remove_repeated_passages(
    docs: DataFrame,
    window: int = 13,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_text: bool = False,
) -> DataFrame:
    """Removes the words of passages that a document with a smaller id also holds.

    Words are cut at white space and compared unchanged (by 64-bit hashes).  Every word covered by
    `window` consecutive words that also occur in a document with a smaller id goes; windows are
    judged on the input.  Returns a row for each input row: id_col, n_words, n_removed, kept_sha256
    of the kept words joined by one space, and kept_text if asked for.  Null texts are empty; rows
    with a null id neither lose words nor take any from others.  Rows that repeat an id do not
    take words from each other.  Other columns are not read.

    The corpus is its own reference.  Each window belongs to the shard of its smallest anchor, so
    equal windows meet in one shard and the reference shards, which grow with the corpus, travel
    through a shuffle instead of a broadcast.  Equal passages are one; passages whose anchor has
    several forms are streamed through the suffix automaton of the shard for matching statistics.
    Shards hold at most SHARD reference passages; a longer list of one anchor fills several shards,
    all of which its passages visit.
    """
    if not ANCHOR < window <= 60:
        raise ValueError(f"window must be above {ANCHOR} and at most 60")
    small_batches(docs.sparkSession)
    read = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    known = read.filter("id is not null")
    anchored = known.mapInArrow(_anchored(window), "anchor long, passage long, id long")
    marks = kept(
        anchored.repartition("anchor")
        .sortWithinPartitions("anchor", "passage", "id")
        .mapInArrow(_marked, _MARKS),
        "passages",
    )
    shards = marks.filter("block > 0").groupBy("anchor").agg(F.max("block").alias("last"))
    lookups = marks.filter("block is not null").join(shards, "anchor", "left").fillna(0, ["last"])
    lookups = lookups.groupBy("id").agg(
        F.collect_list(F.struct("passage", "anchor", "block", "last")).alias("marks")
    )
    partial = (
        known.join(lookups, "id")
        .mapInArrow(_looked_up(window), _LOOKUP)
        .repartition("anchor", "shard")
        .sortWithinPartitions("anchor", "shard", "visiting", "id")
        .mapInArrow(_streamed(window), "id long, passage long, windows long")
    )
    whole = marks.filter("block is null").select("id", "passage", F.lit(-1).cast("long").alias("windows"))
    gone = whole.unionByName(partial).groupBy("id").agg(
        F.collect_list(F.struct("passage", "windows")).alias("marks")
    )
    rows = known.join(gone, "id", "left").unionByName(
        read.filter("id is null").withColumn("marks", F.lit(None).cast(gone.schema["marks"].dataType))
    )
    result = rows.select("id", "text", "marks").mapInArrow(_cleaned(window, with_text), _RESULT)
    return (result if with_text else result.drop("kept_text")).withColumnRenamed("id", id_col)
