"""Toxicity scores: a learned lexicon, looked up with Levenshtein automata over its trie."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, smallest_hashes
from .words import chunks, cut

#: Labelled documents a model is fitted on, at most.
TRAIN_DOCS = 20_000
#: Log-odds a term counts for, at most.
HEAVIEST = 6.0
#: Shortest term, shortest term that may be misspelled, and shortest stem that stands for its inflections.
SHORTEST, SHORTEST_FUZZY, SHORTEST_STEM, LONGEST_STEM = 4, 5, 4, 8
#: Bytes of a letter, at most.
LETTER_BYTES = 4
#: Words on either side of a hit that tell quotation and address.
CONTEXT = 8

# Letters that stand for others in disguised words.
_DISGUISE = str.maketrans("013457@$", "oieastas")
_QUOTES = set("\"“”„«»‘’")
# Words that introduce quoted or discussed speech, and words that address a reader.
_REPORT = set(
    "said says called word words term insult slur quote quoted wrote dit mot appelé sagte wort "
    "genannt dijo palabra llamado".split()
)
_ADDRESS = set("you your youre u ur tu te toi vous du dich dir ihr usted tú eres".split())

# What separates the words of a text here: ASCII other than letters, digits, @ and $.
_OTHER = np.ones(256, bool)
_OTHER[[*b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789@$"]] = False
_OTHER[128:] = False
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
for _a, _b in zip(b"013457@$", b"oieastas"):
    _FOLD[_a] = _b


class LexiconTrie:
    """A trie of words and stems, walked together with the Levenshtein automaton of a token.

    A word ends a match only at the token's end; a stem also matches every token it begins.
    """

    def __init__(self, terms: list[tuple[str, bool]]) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.end: list[tuple[int, bool] | None] = [None]
        self.terms = terms
        for number, (term, stem) in enumerate(terms):
            state = 0
            for letter in term:
                if letter not in self.next[state]:
                    self.next[state][letter] = len(self.next)
                    self.next.append({})
                    self.end.append(None)
                state = self.next[state][letter]
            if self.end[state] is None or stem:
                self.end[state] = (number, stem)

    def find(self, token: str) -> tuple[int, int] | None:
        """(term, edits) with the fewest edits, at most one; exact stems before longer ones."""
        state = 0
        best = None
        for at, letter in enumerate(token):  # the walk without edits
            state = self.next[state].get(letter, -1)
            if state < 0:
                break
            end = self.end[state]
            if end and (end[1] or at + 1 == len(token)):
                best = (end[0], 0)
        return best or self._fuzzy(token)

    def _fuzzy(self, token: str) -> tuple[int, int] | None:
        """Depth-first walk of the trie together with the token's Levenshtein automaton.

        Bit j of `none` and `one`: the path can stand for the first j letters of the token, with no
        edit or with at most one (a letter left out, put in, changed, or swapped with the next).
        """
        places: dict[str, int] = {}
        for j, letter in enumerate(token):
            places[letter] = places.get(letter, 0) | 1 << j
        whole = 1 << len(token)
        found: tuple[int, int] | None = None
        stack = [(0, 1, 3, 0, 0)]
        while stack:
            state, none, one, before, last = stack.pop()
            end = self.end[state]
            if end and len(self.terms[end[0]][0]) >= SHORTEST_FUZZY and (end[1] or one & whole):
                if found is None or end[0] < found[0]:
                    found = (end[0], 1)
            for letter, below in self.next[state].items():
                here = places.get(letter, 0)
                same = (none & here) << 1
                edited = ((one & here) << 1) | none | (none << 1) | same | (same << 1)
                edited |= (((before & here) << 1) & last) << 1
                edited &= 2 * whole - 1
                if edited:
                    stack.append((below, same, edited, none, here))
        return found


def _pair(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The two folded bytes at each of the given places, as one number."""
    return (data[at].astype(np.uint16) << np.uint16(8)) | data[at + 1]


def _spellings(letters: str) -> list[list[bytes]]:
    """The letters' bytes, each letter in both cases."""
    return [[x.encode() for x in way] for way in product(*({c, c.upper()} for c in letters))]


def _number(two: bytes) -> int:
    """Two bytes as `_pair` gives them."""
    return int(_FOLD[two[0]]) << 8 | int(_FOLD[two[1]])


class Lexicon:
    """Terms behind a first filter over pairs of bytes, so that few words reach the trie.

    One edit leaves a word's first or last two bytes in place and its length nearly so.  A stem's end
    may lie anywhere: where its first two letters are not in place, its third and fourth still meet,
    or, with the second and third swapped, its second and fourth.  The bytes on either side of that
    joint are looked for near their place.  Terms that are too short to be misspelled have both pairs
    in place.
    """

    def __init__(self, terms: list[tuple[str, bool, float]]) -> None:
        self.trie = LexiconTrie([t[:2] for t in terms])
        self.weights = [t[2] for t in terms]
        # Lengths at which a word with this first or last pair may be a term, as bits.
        self.begin, self.close = np.zeros(1 << 16, np.uint64), np.zeros(1 << 16, np.uint64)
        # Places at which this pair may be the joint in a stem, as bits.
        self.middle = np.zeros(1 << 16, np.uint64)
        self.first, self.second = np.zeros(1 << 16, bool), np.zeros(1 << 16, bool)
        self.known: dict[bytes, tuple[int, int] | None] = {}
        self.longest = max((len(t[0]) for t in terms), default=0) + 2
        places: set[int] = set()
        for term, stem, _ in terms:
            size = len(term.encode())
            heads = {_number(b"".join(way)[:2]) for way in _spellings(term[:2])}
            if len(term) < SHORTEST_FUZZY:
                for way in map(b"".join, _spellings(term)):
                    self.first[_number(way[:2])] = self.second[_number(way[2:4])] = True
            elif stem:
                self.begin[list(heads)] = ~np.uint64(0)
                place = len(term[:3].encode()) - 1
                gone = max(len(c.encode()) for c in term[:2])
                near = range(max(0, place - gone), place + LETTER_BYTES + 1)
                places.update(near)
                joints = {_number(x[-1:] + y[:1]) for x, y in _spellings(term[2:4])}
                swapped = {_number(x[-1:] + y[:1]) for x, y in _spellings(term[1] + term[3])}
                self.middle[list(joints)] |= np.uint64(sum(1 << p for p in near))
                self.middle[list(swapped)] |= np.uint64(1 << place)
            else:
                tails = {_number(b"".join(way)[-2:]) for way in _spellings(term[-2:])}
                for length in range(max(1, size - LETTER_BYTES), min(62, size + LETTER_BYTES) + 1):
                    self.begin[list(heads)] |= np.uint64(1 << length)
                    self.close[list(tails)] |= np.uint64(1 << length)
        self.places = sorted(places)

    def look_up(self, word: str) -> tuple[int, int] | None:
        # No term looks further than this, whatever follows.
        return self.trie.find(word.lower().translate(_DISGUISE)[: self.longest])

    def hits(self, data: np.ndarray, offsets: np.ndarray):
        """(text, word, term, edits) of every hit, and where the words are."""
        starts, ends, at = cut(data, offsets, _OTHER)
        if not len(starts):
            return [], starts, ends, at
        folded = np.r_[_FOLD[data], np.zeros(4 * LETTER_BYTES + 2, np.uint8)]
        length = np.minimum(ends - starts, 63).astype(np.uint64)
        head, next_pair = _pair(folded, starts), _pair(folded, starts + 2)
        lengths = self.begin[head] | self.close[_pair(folded, np.maximum(ends - 2, 0))]
        maybe = (lengths >> length & np.uint64(1)).astype(bool) | (self.first[head] & self.second[next_pair])
        for place in self.places:
            maybe |= (self.middle[_pair(folded, starts + place)] >> np.uint64(place) & np.uint64(1)).astype(bool)
        words = np.flatnonzero(maybe & (ends - starts >= SHORTEST - 1))
        raw, found, known, reach = data.tobytes(), [], self.known, 4 * self.longest
        for word, a, b in zip(words.tolist(), starts[words].tolist(), ends[words].tolist()):
            key = raw[a : min(b, a + reach)]
            if key not in known:
                if len(known) > 500_000:
                    known.clear()
                known[key] = self.look_up(key.decode("utf-8", "replace"))
            if known[key]:
                found.append((int(np.searchsorted(at, word, "right")) - 1, word, *known[key]))
        return found, starts, ends, at


#: Evidence of a document: weights of the distinct terms found exactly, misspelled, the same inside
#: quotations, hits that address the reader, and hits among 100 words, each as its logarithm.
FEATURES = 6


def _features(lexicon: Lexicon, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    hits, starts, ends, at = lexicon.hits(data, offsets)
    found = np.zeros((len(offsets) - 1, FEATURES))
    seen: set[tuple[int, int, int]] = set()
    for text, word, term, edits in hits:
        low, high = max(at[text], word - CONTEXT), min(at[text + 1] - 1, word + CONTEXT)
        before = bytes(data[starts[low] : starts[word]]).decode("utf-8", "replace").lower()
        after = bytes(data[ends[word] : ends[high]]).decode("utf-8", "replace").lower()
        opened = sum(c in _QUOTES for c in before)
        quoted = opened % 2 == 1 and any(c in _QUOTES for c in after)
        around = set(before.split()) | set(after.split())
        quoted = quoted or (bool(around & _REPORT) and (opened > 0 or any(c in _QUOTES for c in after)))
        kind = 2 * quoted + (edits > 0)
        if (text, kind, term) not in seen:
            seen.add((text, kind, term))
            found[text, kind] += lexicon.weights[term]
        found[text, 4] += bool(around & _ADDRESS) and not quoted
        found[text, 5] += not quoted and not edits
    found[:, 5] *= 100 / np.maximum(np.diff(at), 1)
    return np.log1p(found)


def _fitted(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of a logistic regression with a small ridge, by Newton steps; hits never count against."""
    x = np.c_[np.ones(len(x)), x]
    weights = np.zeros(x.shape[1])
    ridge = np.diag([1e-3, *[0.1] * (x.shape[1] - 1)])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        slope = x.T @ (y - p) - ridge @ weights
        bend = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + ridge
        step = np.linalg.solve(bend, slope)
        weights = weights + step
        weights[1:] = np.maximum(weights[1:], 0)
        if np.abs(step).max() < 1e-6:
            break
    return weights


def _terms_of(text: str) -> set[str]:
    """Distinct words of a text, and their beginnings marked with *."""
    out = set()
    data = np.frombuffer(text.encode(), np.uint8)
    starts, ends, _ = cut(data, np.array([0, len(data)]), _OTHER)
    for word in {bytes(data[a:b]).decode("utf-8", "replace").lower() for a, b in zip(starts, ends)}:
        if len(word) >= SHORTEST:
            out.add(word)
            out.update(word[:n] + "*" for n in range(SHORTEST_STEM, min(len(word), LONGEST_STEM) + 1))
    return out


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bad, all_ = Counter(), Counter()
    for batch in batches:
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
            terms = _terms_of(text or "")
            all_.update(terms)
            if toxic:
                bad.update(terms)
    if bad:
        terms = list(bad)
        yield pa.RecordBatch.from_pydict(
            {
                "term": terms,
                "bad": pa.array([bad[t] for t in terms], pa.int64()),
                "good": pa.array([all_[t] - bad[t] for t in terms], pa.int64()),
            }
        )
    rest = [t for t in all_ if t not in bad]
    for a in range(0, len(rest), 50_000):
        terms = rest[a : a + 50_000]
        yield pa.RecordBatch.from_pydict(
            {
                "term": terms,
                "bad": pa.array([0] * len(terms), pa.int64()),
                "good": pa.array([all_[t] for t in terms], pa.int64()),
            }
        )


def _chance(bad: int, good: int, rate: float) -> float:
    """Probability of `bad` or more toxic documents among bad + good if the term told nothing."""
    n, total = bad + good, 0.0
    for k in range(bad, n + 1):
        term = math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
        term = math.exp(term + k * math.log(rate) + (n - k) * math.log1p(-rate))
        total += term
        if k > n * rate and term < 1e-3 * total:
            break
    return total


def _contexts(shared) -> Callable:
    """(term, word, context) of every suspect in a text: the word it is or begins, and its neighbours."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        suspects = shared.value
        for batch in batches:
            out = set()
            for text in batch.column("text").to_pylist():
                data = np.frombuffer(text.encode(), np.uint8)
                starts, ends, _ = cut(data, np.array([0, len(data)]), _OTHER)
                words = [bytes(data[a:b]).decode("utf-8", "replace").lower() for a, b in zip(starts, ends)]
                for before, word, after in zip(["", *words], words, [*words[1:], ""]):
                    forms = [word, *(word[:n] + "*" for n in range(SHORTEST_STEM, min(len(word), LONGEST_STEM) + 1))]
                    out.update((form, word, f"{before} {after}") for form in forms if form in suspects)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], ["term", "word", "context"])

    return run


def _told(texts: DataFrame, suspects: dict[str, tuple[int, int]]) -> dict[str, tuple[int, int, int]]:
    """For each suspect its contexts, the words it is or begins, and the most contexts one of these has alone."""
    shared = texts.sparkSession.sparkContext.broadcast(frozenset(suspects))
    found = texts.mapInArrow(_contexts(shared), "term string, word string, context string")
    found = found.select("term", "word", F.xxhash64("context").alias("context")).distinct().persist()
    told = found.groupBy("term").agg(F.count_distinct("context").alias("contexts"), F.count_distinct("word").alias("words"))
    ended = found.filter("term <> word").select("term", "word").distinct()
    alone = ended.join(told.select(F.col("term").alias("word"), "contexts"), "word").groupBy("term").agg(F.max("contexts").alias("alone"))
    rows = told.join(alone, "term", "left").fillna(0, ["alone"]).collect()  # a row for each suspect
    found.unpersist()
    return {r["term"]: (r["contexts"], r["words"], r["alone"]) for r in rows}


def _chosen(suspects: dict[str, tuple[int, int]], told: dict[str, tuple[int, int, int]], bad: int, good: int):
    """Terms and weights: suspects that occur in several contexts, beyond chance.

    Copies of one toxic document share all its words; a term must follow and precede different
    words.  A stem must have several endings, none of which makes up most of it, and a longer term
    must tell more than a stem it has.
    """
    rate, found = bad / (bad + good), []
    for term in sorted(suspects, key=lambda t: (len(t.rstrip("*")), not t.endswith("*"), t)):
        in_bad, in_good = suspects[term]
        contexts, endings, alone = told.get(term, (0, 0, 0))
        support = min(in_bad, contexts)
        if support < 3:
            continue
        if term.endswith("*") and (endings < 3 or support < 1.5 * alone):
            continue
        weight = min(HEAVIEST, math.log(((support + 0.5) / (bad + 1)) / ((in_good + 0.5) / (good + 1))))
        if weight < 1.5 or _chance(support, in_good, rate) > 1e-4:
            continue
        word = term.rstrip("*")
        above = max((w for t, stem, w, _ in found if stem and word.startswith(t)), default=0.0)
        if weight > above + 0.7 * (above > 0):
            found.append((word, term.endswith("*"), weight, support))
    found.sort(key=lambda t: (-t[3], t[0]))
    return [t[:3] for t in found]


class Model:
    """A lexicon and the weights of its evidence."""

    def __init__(self, terms: list[tuple[str, bool, float]], weights: np.ndarray) -> None:
        self.terms, self.weights, self._lexicon = terms, weights, None

    def __getstate__(self):
        return {"terms": self.terms, "weights": self.weights, "_lexicon": None}

    @property
    def lexicon(self) -> Lexicon:
        if self._lexicon is None:
            self._lexicon = Lexicon(self.terms)
        return self._lexicon

    def scores(self, texts: pa.Array) -> np.ndarray:
        out = np.empty(len(texts))
        for first, end, data, offsets in chunks(texts):
            x = _features(self.lexicon, data, offsets)
            z = self.weights[0] + x @ self.weights[1:]
            out[first:end] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        return out


def held_out(id_col) -> F.Column:
    return F.coalesce(F.crc32(id_col.cast("string")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> Model:
    """A model from at most train_docs labelled documents that are not held out.

    The sample is the labels with the smallest hashes of their ids.  Labels without toxic, and
    documents without text, are left out; a document is toxic if any of its labels says so; without toxic
    documents every score is low.  The lexicon has every term of the sample that passes the tests.
    """
    spark = docs.sparkSession
    small_batches(spark)
    chosen = labels.filter("doc_id is not null and toxic is not null").filter(~held_out(F.col("doc_id")))
    chosen = chosen.groupBy("doc_id").agg((F.max("toxic") > 0).alias("toxic"))
    chosen = smallest_hashes(chosen, "doc_id", train_docs)
    sample = docs.select("doc_id", "text").filter("text is not null").join(F.broadcast(chosen), "doc_id")
    sample = sample.select("text", "toxic").persist()
    total = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    bad, good = total.get(True, 0), total.get(False, 0)
    if not bad:
        sample.unpersist()
        return Model([], np.r_[math.log(0.01), np.zeros(FEATURES)])
    counts = sample.mapInArrow(_counted, "term string, bad long, good long").groupBy("term")
    counts = counts.agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    # Several times as likely in a toxic document as in another.
    rate = (F.col("bad") / bad) / ((F.col("good") + 0.5) / (good + 1))
    # The sample bounds them; only terms and numbers leave the executors.
    suspects = counts.filter((F.col("bad") >= 3) & (rate >= 4)).collect()
    suspects = {r["term"]: (r["bad"], r["good"]) for r in suspects}
    terms = _chosen(suspects, _told(sample.filter("toxic").select("text").distinct(), suspects), bad, good)
    if not terms:
        sample.unpersist()
        return Model([], np.r_[math.log(0.05), np.zeros(FEATURES)])
    model = Model(terms, np.zeros(FEATURES + 1))

    def evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.zeros((batch.num_rows, FEATURES))
            for first, end, data, offsets in chunks(batch.column("text")):
                x[first:end] = _features(model.lexicon, data, offsets)
            yield pa.RecordBatch.from_arrays(
                [batch.column("toxic"), *(pa.array(x[:, i]) for i in range(FEATURES))],
                ["toxic", *(f"x{i}" for i in range(FEATURES))],
            )

    schema = "toxic boolean, " + ", ".join(f"x{i} double" for i in range(FEATURES))
    rows = sample.mapInArrow(evidence, schema).toPandas()
    sample.unpersist()
    x, y = rows.drop(columns="toxic").to_numpy(), rows["toxic"].to_numpy().astype(float)
    model.weights = _fitted(x, y)
    return model


def scored(docs: DataFrame, model: Model, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """The documents with score (0 to 1) and predicted (1 from the threshold on).

    Whole texts are scored, nothing else is looked at; null and empty texts get the score of a text
    without hits.  All columns stay; a column named score or predicted is replaced.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts):
        return pd.Series(shared.value.scores(pa.Array.from_pandas(texts, type=pa.string())))

    found = docs.withColumn("score", score(F.col(text_col).cast("string")))
    return found.withColumn("predicted", (F.col("score") >= threshold).cast("int"))

