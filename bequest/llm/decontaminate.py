"""Benchmark decontamination: passages as queries to a BM25 index of test items, block-max WAND."""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, small_batches
from .words import chunks, cut, hashes

#: BM25's saturation and length weights.
K1, B = 1.2, 0.75
#: Postings of one block of a list, whose largest weight is kept.
BLOCK = 32
#: Groups of items for which a passage's bound is taken before the lists are walked.
GROUPS = 64
#: Characters of the test items that are broadcast at once; more items make several passes.
INDEX_CHARS = 4_000_000
#: Shortest passage, in words; longer test items make longer passages.
PASSAGE = 64
#: Words of a piece that must occur in one go to count as overlap.
PIECE = 5
#: Words of a question that tell a leak without the answer.
LONG_QUESTION = 13

_OTHER = np.ones(256, bool)
_OTHER[[*b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"]] = False
_OTHER[128:] = False
_SENTENCE = re.compile(r"(?<=[.!?。])\s+|\n+")


def _words(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode(), np.uint8)
    starts, ends, _ = cut(data, np.array([0, len(data)]), _OTHER)
    return hashes(data, starts, ends, True)


def _question_and_answer(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The last sentence answers the ones before it; a single sentence is both."""
    parts = [p for p in _SENTENCE.split(text.strip()) if len(_words(p))]
    if len(parts) < 2:
        return _words(text), _words(text)
    return _words("\n".join(parts[:-1])), _words(parts[-1])


def _pieces(words: np.ndarray) -> set[tuple[int, ...]]:
    size = min(PIECE, len(words))
    listed = words.tolist()
    return {tuple(listed[i : i + size]) for i in range(len(listed) - size + 1)} if size else set()


class Statistics(NamedTuple):
    """What BM25 needs of all items: their number, mean length, and how many hold each term."""

    items: int
    mean: float
    held: dict[int, int]

    @classmethod
    def of(cls, bags: list[Counter]) -> Statistics:
        total = sum(sum(bag.values()) for bag in bags)
        return cls(len(bags), total / len(bags) if bags else 1.0, Counter(t for bag in bags for t in bag))


class ItemIndex:
    """Inverted index of test items.  A posting's weight is its BM25 share of the item's own score,
    so that a passage that holds all of an item's words scores 1.  `known` are the statistics of all items
    where the index has only some of them; `size` is the length of passages, that of the longest item else."""

    def __init__(self, items: list[tuple[int, str]], known: Statistics | None = None, size: int | None = None) -> None:
        self.items = []
        bags = []
        for item, text in items:
            words = _words(text)
            if len(words):
                question, answer = _question_and_answer(text)
                self.items.append((item, len(words), len(question), _pieces(question), _pieces(answer)))
                bags.append(Counter(words.tolist()))
        lengths = [sum(bag.values()) for bag in bags]
        count, mean, held = known or Statistics.of(bags)
        self.longest = size or max(lengths, default=1)
        self.terms = np.array(sorted({t for bag in bags for t in bag}), np.uint64)
        number = {t: i for i, t in enumerate(self.terms.tolist())}
        lists: list[list[tuple[int, float]]] = [[] for _ in number]
        for doc, (bag, length) in enumerate(zip(bags, lengths)):
            norm = K1 * (1 - B + B * length / mean)
            raw = {
                t: math.log1p((count - held[t] + 0.5) / (held[t] + 0.5)) * n * (K1 + 1) / (n + norm)
                for t, n in bag.items()
            }
            own = sum(raw.values())
            for t, weight in raw.items():
                lists[number[t]].append((doc, weight / own))
        self.docs = [[d for d, _ in postings] for postings in lists]
        self.weights = [[w for _, w in postings] for postings in lists]
        self.block_max = [
            [max(weights[a : a + BLOCK]) for a in range(0, len(weights), BLOCK)] for weights in self.weights
        ]
        self.most = np.array([max(w) for w in self.weights]) if lists else np.empty(0)
        # The largest weight of each term in each group of neighbouring items; the last row is no term.
        self.per_group = per_group = max(1, -(-len(bags) // GROUPS))
        self.group_max = np.zeros((len(lists) + 1, max(1, -(-len(bags) // per_group))), np.float32)
        for t, postings in enumerate(lists):
            for doc, weight in postings:
                # rounded up, so that a bound is never too low
                weight = np.nextafter(np.float32(weight), np.float32(2))
                self.group_max[t, doc // per_group] = max(self.group_max[t, doc // per_group], weight)
        self.sieve = np.zeros(1 << 16, bool)
        self.sieve[(self.terms & np.uint64(0xFFFF)).astype(np.int64)] = True

    def look_up(self, hashed: np.ndarray) -> np.ndarray:
        """The number of each word's term, -1 for words of no item."""
        out = np.full(len(hashed), -1, np.int64)
        if len(self.terms):
            maybe = np.flatnonzero(self.sieve[(hashed & np.uint64(0xFFFF)).astype(np.int64)])
            at = np.minimum(np.searchsorted(self.terms, hashed[maybe]), len(self.terms) - 1)
            known = self.terms[at] == hashed[maybe]
            out[maybe[known]] = at[known]
        return out

    def hopeful(
        self, term: np.ndarray, text: np.ndarray, first: np.ndarray, end: np.ndarray, step: int, threshold: float
    ) -> tuple[np.ndarray, np.ndarray]:
        """(passage, group of items) wherever the passage's bound reaches the threshold.

        Passages of a text half overlap, so each half is summed once: a passage is its first half
        and that of the next one, or, for the last, what is left of it.
        """
        if not len(text):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        last = np.r_[text[1:] != text[:-1], True]
        place = np.arange(len(text)) + np.cumsum(np.r_[0, last[:-1]])
        begins = np.empty(len(text) + int(last.sum()), np.int64)
        begins[place] = first
        begins[place[last] + 1] = np.minimum(first + step, end)[last]
        known = np.flatnonzero(term >= 0)
        at = np.searchsorted(known, begins)
        weights = np.vstack([self.group_max[term[known]], self.group_max[-1:]])
        sums = np.add.reduceat(weights, at, axis=0)
        sums[np.r_[at[1:], len(known)] <= at] = 0
        bound = sums[place] + sums[place + 1]
        return np.nonzero(bound >= threshold * (1 - 1e-4))

    def above(self, terms: list[int], threshold: float, group: int | None = None) -> list[tuple[int, float]]:
        """All items (of a group) whose score reaches the threshold, by WAND with block maxima."""
        found = []
        low, high = (0, len(self.items)) if group is None else (group * self.per_group, (group + 1) * self.per_group)
        cursors = []
        for t in terms:
            place = bisect_left(self.docs[t], low)
            if place < len(self.docs[t]) and self.docs[t][place] < high:
                cursors.append([self.docs[t][place], t, place])
        while cursors:
            cursors.sort(key=lambda c: c[0])
            bound, pivot = 0.0, -1
            for i, (_, t, _) in enumerate(cursors):
                bound += self.most[t]
                if bound >= threshold:
                    pivot = i
                    break
            if pivot < 0:
                break
            doc = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == doc:
                pivot += 1
            # The lists' blocks that doc would lie in, and where the first of them ends.
            blocked, edge = 0.0, cursors[pivot + 1][0] if pivot + 1 < len(cursors) else math.inf
            for _, t, place in cursors[: pivot + 1]:
                docs = self.docs[t]
                place = bisect_left(docs, doc, place)
                if place < len(docs):
                    block = place // BLOCK
                    blocked += self.block_max[t][block]
                    edge = min(edge, docs[min(len(docs), (block + 1) * BLOCK) - 1] + 1)
            if blocked < threshold:
                target = max(edge, doc + 1)
            else:
                score = 0.0
                for _, t, place in cursors[: pivot + 1]:
                    place = bisect_left(self.docs[t], doc, place)
                    if place < len(self.docs[t]) and self.docs[t][place] == doc:
                        score += self.weights[t][place]
                if score >= threshold:
                    found.append((doc, score))
                target = doc + 1
            for cursor in cursors[: pivot + 1]:
                docs = self.docs[cursor[1]]
                cursor[2] = bisect_left(docs, target, cursor[2]) if target < math.inf else len(docs)
                cursor[0] = docs[cursor[2]] if cursor[2] < len(docs) else math.inf
            cursors = [c for c in cursors if c[0] < high]
        return found


def _windows(at: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, end word) of passages of two steps, the second of which begins the next."""
    size = 2 * step
    lengths = np.diff(at)
    counts = np.where(lengths > 0, np.maximum(1, -(-(lengths - size) // step) + 1), 0)
    text = np.repeat(np.arange(len(lengths)), counts)
    number = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)
    first = at[text] + number * step
    return text, first, np.minimum(first + size, at[text + 1])


_HIT = "id long, item_id long, score double, question double, answer double, question_words int, first_word int, end_word int"


def _overlap(pieces: set[tuple[int, ...]], words: list[int]) -> float:
    size = len(next(iter(pieces)))
    return len(pieces & {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}) / len(pieces)


def _found(indexes: list[ItemIndex], texts: pa.Array, threshold: float) -> Iterator[tuple]:
    """(row, item, score, question, answer, question words, first word, end word) of every hit."""
    for begin, _, data, offsets in chunks(texts):
        starts, ends, at = cut(data, offsets, _OTHER)
        hashed = hashes(data, starts, ends, True)
        for index in indexes:
            step = -(-max(PASSAGE, index.longest) // 2)
            term = index.look_up(hashed)
            text, first, end = _windows(at, step)
            passage, group = index.hopeful(term, text, first, end, step, threshold)
            places = (column[passage].tolist() for column in (text, first, end))
            for row, a, b, items in zip(*places, group.tolist()):
                terms = np.unique(term[a:b])
                for doc, score in index.above(terms[terms >= 0].tolist(), threshold, items):
                    item, length, asked, question, answer = index.items[doc]
                    near = hashed[max(at[row], a - length) : min(at[row + 1], b + length)].tolist()
                    overlaps = _overlap(question, near), _overlap(answer, near)
                    yield begin + row, item, score, *overlaps, asked, int(a - at[row]), int(b - at[row])


def _hits(shared, threshold: float):
    names = [c.split()[0] for c in _HIT.split(", ")]
    kinds = [pa.int64(), pa.int64(), *[pa.float64()] * 3, *[pa.int32()] * 3]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id").to_pylist()
            out = [(ids[row], *hit) for row, *hit in _found(shared.value, batch.column("text"), threshold)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    return run


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Items with words: their number, and each distinct one's hash."""
    for batch in batches:
        words = [_words(text) for text in batch.column("text").to_pylist()]
        full = pa.array([i for i, w in enumerate(words) if len(w)], pa.int64())
        words = [w for w in words if len(w)]
        yield pa.RecordBatch.from_arrays(
            [
                *(batch.column(c).take(full) for c in ("item_id", "text")),
                pa.array([len(w) for w in words], pa.int32()),
                pa.array([np.unique(w).view(np.int64) for w in words], pa.list_(pa.int64())),
            ],
            ["item_id", "text", "words", "terms"],
        )


def _indexes(items: DataFrame) -> Iterator[list[ItemIndex]]:
    """Indexes of all items, INDEX_CHARS characters together.

    Items of like length share an index and the length of passages: the next power of two, PASSAGE at least.
    Statistics are those of all items, so neither they nor passages depend on how items are dealt out.
    """
    read = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    read = kept(read.mapInArrow(_terms, "item_id long, text string, words int, terms array<long>"), "items")
    count, mean, chars = read.agg(F.count("*"), F.avg("words"), F.sum(F.length("text"))).first()
    held = read.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    parts = max(1, -(-(chars or 0) // INDEX_CHARS))
    for part in range(parts):
        mine = read.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part)
        own = held.join(mine.select(F.explode("terms").alias("term")).distinct(), "term", "left_semi") if parts > 1 else held
        known = Statistics(count, mean or 1.0, {t % (1 << 64): n for t, n in own.collect()})
        by_size: dict[int, list[tuple[int, str]]] = {}
        for item, text, words in mine.orderBy("item_id", "text").select("item_id", "text", "words").collect():
            by_size.setdefault(max(PASSAGE, 1 << (words - 1).bit_length()), []).append((item, text))
        yield [ItemIndex(listed, known, size) for size, listed in sorted(by_size.items())]


def retrieved_items(
    docs: DataFrame,
    items: DataFrame,
    threshold: float = 0.5,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Test items that passages of the documents resemble: a row for each passage and item.

    Every passage of every document is a query; all items whose BM25 score reaches `threshold` of
    the item's own score are retrieved.  question and answer are the shares of the item's pieces of
    five words that occur, in one go, in the passage or an item's length around it.

    Items (item_id, text) are indexed whole, INDEX_CHARS characters at a time, which are broadcast for a
    pass of their own over the documents; scores do not depend on that.  Passages are as long as the
    item, PASSAGE words at least, rounded up to a power of two.  Null texts are empty; empty texts and items
    without words give no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    read = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    found = None
    for indexes in _indexes(items):
        hits = read.mapInArrow(_hits(spark.sparkContext.broadcast(indexes), threshold), _HIT)
        found = hits if found is None else found.unionByName(hits)
    return found.withColumnRenamed("id", id_col)


def is_leak(question, answer, question_words):
    """Question and answer both overlap, or a long question almost whole; for numbers and columns."""
    long_question = (question >= 0.8) & (question_words >= LONG_QUESTION)
    return ((question >= 0.6) & (answer >= 0.6)) | long_question


def _leaks(shared, threshold: float):
    @F.pandas_udf("boolean")
    def leaks(texts):
        out = np.zeros(len(texts), bool)
        found = _found(shared.value, pa.Array.from_pandas(texts, type=pa.string()), threshold)
        for row, _, _, question, answer, asked, _, _ in found:
            out[row] |= is_leak(question, answer, asked)
        return pd.Series(out)

    return leaks


def without_leaks(docs: DataFrame, items: DataFrame, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The documents that leak no test item, with all columns; texts are judged where they lie."""
    small_batches(docs.sparkSession)
    for indexes in _indexes(items):
        leaks = _leaks(docs.sparkSession.sparkContext.broadcast(indexes), threshold)
        docs = docs.filter(~leaks(F.col(text_col).cast("string")))
    return docs


def contamination(docs: DataFrame, items: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: id_col, contaminated, item_ids (sorted), best_score.

    best_score is the highest retrieval score, null where no item was retrieved.  Rows that repeat
    an id share their findings; rows with a null id are never contaminated.
    """
    hits = retrieved_items(docs, items, threshold, id_col, text_col).filter(F.col(id_col).isNotNull())
    leak = is_leak(F.col("question"), F.col("answer"), F.col("question_words"))
    by_doc = hits.groupBy(id_col).agg(
        F.max(leak).alias("contaminated"),
        F.array_sort(F.collect_set(F.when(leak, F.col("item_id")))).alias("item_ids"),
        F.max("score").alias("best_score"),
    )
    return (
        docs.select(F.col(id_col).cast("long").alias(id_col))
        .join(by_doc, id_col, "left")
        .withColumns(
            {
                "contaminated": F.coalesce("contaminated", F.lit(False)),
                "item_ids": F.coalesce("item_ids", F.array().cast("array<long>")),
            }
        )
    )
