"""Token ids of Arrow text columns by a tokenizer file, each distinct word encoded once.

Tokenizer libraries spend some 20 microseconds on a word, and a corpus repeats its words.  Where a
tokenizer provably treats every word alone, texts are cut into words by array operations, and only words a
worker has not met yet go to the library.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa

from .words import chunks, cut, hashes

#: Words a worker remembers, and values of a pool; beyond either it starts anew.
REMEMBERED = 1 << 19
POOLED = 1 << 23
#: Bytes of text taken at once; every one costs some hundred bytes of memory on the way.
TEXT = 1 << 19
#: Pieces of words a worker remembers, and those whose ids stand in one array.
PIECES = 1 << 16
LISTED = 1 << 17


class Pools:
    """Remembered keys (64-bit hashes) with, for each of several pools, a run of values.

    `missing` tells which keys are new, `add` takes them, `take` gives the runs of many keys at once, `counts`
    their lengths.  Without room for new keys, those that were not asked for since the last time go.
    """

    def __init__(self, kinds: list) -> None:
        self.kinds = kinds
        self._hold(np.empty(0, np.uint64), [(np.empty(0, np.int64), np.empty(0, k)) for k in kinds])

    def _hold(self, keys: np.ndarray, runs: list[tuple[np.ndarray, np.ndarray]]) -> None:
        self.keys, self.rank, self.used = keys, np.arange(len(keys), dtype=np.int32), np.zeros(len(keys), bool)
        self.starts = [np.r_[0, np.cumsum(lengths)].astype(np.int32) for lengths, _ in runs]
        self.values = [values for _, values in runs]

    def _forget(self) -> None:
        stays = self.used[self.rank]
        if 2 * int(stays.sum()) > len(self.keys):
            stays[:] = False
        ranks = self.rank[stays]
        self._hold(self.keys[stays], [(self.counts(p, ranks), self.take(p, ranks)) for p in range(len(self.kinds))])

    def missing(self, keys: np.ndarray) -> np.ndarray:
        """Which of the sorted, distinct keys are not remembered; makes room for them."""
        if len(self.keys) + len(keys) > REMEMBERED or max(map(len, self.values)) > POOLED:
            self._forget()
        if not len(self.keys):
            return np.ones(len(keys), bool)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return self.keys[at] != keys

    def add(self, keys: np.ndarray, runs: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """Sorted new keys; runs: for every pool the lengths of their runs and all their values."""
        at = np.searchsorted(self.keys, keys)
        self.rank = np.insert(self.rank, at, len(self.rank) + np.arange(len(keys), dtype=np.int32))
        self.keys = np.insert(self.keys, at, keys)
        self.used = np.r_[self.used, np.zeros(len(keys), bool)]
        for pool, (lengths, values) in enumerate(runs):
            self.values[pool] = np.r_[self.values[pool], values.astype(self.kinds[pool])]
            self.starts[pool] = np.r_[self.starts[pool], (self.starts[pool][-1] + np.cumsum(lengths)).astype(np.int32)]

    def ranks(self, keys: np.ndarray) -> np.ndarray:
        found = self.rank[np.searchsorted(self.keys, keys)]
        self.used[found] = True
        return found

    def counts(self, pool: int, ranks: np.ndarray) -> np.ndarray:
        return (self.starts[pool][ranks + 1] - self.starts[pool][ranks]).astype(np.int64)

    def take(self, pool: int, ranks: np.ndarray) -> np.ndarray:
        """The runs of the given ranks, one after the other."""
        first, lengths = self.starts[pool][ranks], self.counts(pool, ranks)
        before = np.cumsum(lengths) - lengths
        place = np.repeat(first - before, lengths)
        place += np.arange(len(place))
        return self.values[pool][place]


def split(total: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of `total` between consecutive places."""
    summed = np.r_[0, np.cumsum(total)]
    return summed[at[1:]] - summed[at[:-1]]


# The parts of a tokenizer file under which every word is encoded alone.
_WORDWISE_NORMALIZERS = {"NFC", "Replace", "Lowercase"}
_WORDWISE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
# That pattern, and the one byte-level tokenizers have built in, for texts of plain letters, digits and signs.
_PLAIN_WORDWISE = r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|[0-9]|(?:[^\w\s]|_)+"
_PLAIN_BYTEWISE = r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?[0-9]+| ?(?:[^\w\s]|_)+|\s+(?!\S)|\s+"
#: Characters whose lower case and composition concern no other character, and whose kind is beyond doubt.
_PLAIN = re.compile(r"[ \n\x21-\x7EÀ-ÖØ-öø-įĴ-ňŊ-ž]+")


class PieceEncoder:
    """Ids of short texts by a tokenizer of the tokenizers library.

    Plain texts are cut by the tokenizer's own pattern here and only merged by the library, whose
    preparation of a text takes much longer; others go through the library alone.
    """

    def __init__(self, tokenizer, description: dict, pattern: str, lower: bool) -> None:
        from tokenizers import pre_tokenizers

        self.tokenizer, self.pattern, self.lower = tokenizer, re.compile(pattern), lower
        #: Texts with the first sign of a special token are left to the library.
        self.marks = {t["content"][0] for t in description["added_tokens"]}
        spelled = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        letters = [chr(c) for c in range(0x180) if _PLAIN.fullmatch(chr(c))]
        self.spelled = {ord(c): spelled.pre_tokenize_str(c)[0][0] for c in letters}
        self.known: dict[str, list[int]] = {}

    def piece(self, piece: str) -> list[int]:
        found = self.known.get(piece)
        if found is None:
            if len(self.known) >= PIECES:
                self.known.clear()
            found = [t.id for t in self.tokenizer.model.tokenize(piece.translate(self.spelled))]
            self.known[piece] = found
        return found

    def __call__(self, texts: list[str]) -> list[list[int]]:
        out: list = [None] * len(texts)
        others = []
        for place, text in enumerate(texts):
            if text.isascii() and text.isalpha():
                out[place] = self.piece(text.lower() if self.lower else text)
            elif _PLAIN.fullmatch(text) and not any(m in text for m in self.marks):
                pieces = self.pattern.findall(text.lower() if self.lower else text)
                out[place] = self.piece(pieces[0]) if len(pieces) == 1 else [i for p in pieces for i in self.piece(p)]
            else:
                others.append(place)
        found = self.tokenizer.encode_batch_fast([texts[p] for p in others], add_special_tokens=False)
        for place, one in zip(others, found):
            out[place] = one.ids
        return out


class WordEncoder:
    """Ids of many words at once by a tokenizer that treats every word alone.

    Plain words are lower-cased and cut as one text, and pieces are told apart once for all words of a call.
    """

    def __init__(self, encoder: PieceEncoder) -> None:
        self.encoder = encoder
        self.pattern = re.compile(f"{encoder.pattern.pattern}|\\n")
        #: Whether a character is plain, by code point; all from the last on are not.
        self.plain = np.array([bool(_PLAIN.fullmatch(chr(c))) and chr(c) not in encoder.marks for c in range(0x180)] + [False])
        self._forget()

    def _forget(self) -> None:
        # The line end is a piece without ids.
        self.known = {"\n": 0}
        self.sizes, self.ids = np.zeros(1, np.int64), np.empty(0, np.uint32)

    def _learn(self, pieces: list[str]) -> None:
        new = set(pieces).difference(self.known)
        if len(self.known) + len(new) > LISTED:
            self._forget()
            new = set(pieces).difference(self.known)
        tokenize, spelled = self.encoder.tokenizer.model.tokenize, self.encoder.spelled
        sizes, ids = flat([[t.id for t in tokenize(p if p.isascii() else p.translate(spelled))] for p in new])
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
        self.sizes, self.ids = np.r_[self.sizes, sizes], np.r_[self.ids, ids]

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the words' ids, and all their ids; a line end stands behind every word."""
        points = np.frombuffer(text.encode("utf-32-le"), "<u4")
        odd = np.flatnonzero(~self.plain[np.minimum(points, len(self.plain) - 1)])
        odd = np.unique(np.searchsorted(np.flatnonzero(points == 10), odd))
        others = []
        if len(odd):
            words = text.split("\n")
            for place in odd.tolist():
                others.append(words[place])
                words[place] = ""
            text = "\n".join(words)
        pieces = self.pattern.findall(text.lower() if self.encoder.lower else text)
        self._learn(pieces)
        which = np.fromiter(map(self.known.__getitem__, pieces), np.int64, len(pieces))
        sizes = self.sizes[which]
        summed = np.cumsum(sizes)
        place = np.repeat((np.cumsum(self.sizes) - self.sizes)[which] - (summed - sizes), sizes)
        ids = self.ids[place + np.arange(len(place))]
        ends = summed[which == 0]
        lengths = np.diff(ends, prepend=0)
        if others:
            found = self.encoder.tokenizer.encode_batch_fast(others, add_special_tokens=False)
            lengths[odd], more = flat([one.ids for one in found])
            ids = np.insert(ids, np.repeat(ends[odd], lengths[odd]), more)
        return lengths, ids


def flat(found: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of lists, and all their entries."""
    lengths = np.fromiter(map(len, found), np.int64, len(found))
    return lengths, np.fromiter(chain.from_iterable(found), np.uint32, int(lengths.sum()))


def wordwise(description: dict) -> bool:
    """True if a tokenizer file's parts are such that a text's ids are those of its words, one after the other.

    White space is dropped, so no piece spans two words, and neither composition of characters nor lower
    case looks past white space.
    """
    normalizer, splitter = description["normalizer"] or {}, description["pre_tokenizer"] or {}
    first = normalizer.get("normalizers", [normalizer] if normalizer else [])
    then = splitter.get("pretokenizers", [])
    return (
        {n["type"] for n in first} == _WORDWISE_NORMALIZERS
        and all(n["content"] == " " and n["pattern"] == {"Regex": r"\s+"} for n in first if n["type"] == "Replace")
        and [p["type"] for p in then] == ["Split", "ByteLevel"]
        and then[0]["pattern"] == {"Regex": _WORDWISE_PATTERN}
        and (then[0]["behavior"], then[0]["invert"]) == ("Removed", True)
        and not (then[1]["add_prefix_space"] or then[1].get("use_regex", True))
        and description["model"]["type"] == "BPE"
        and not description["post_processor"]
        and not (description["truncation"] or description["padding"])
    )


def bytewise(description: dict) -> bool:
    """True if a tokenizer file is a byte-level one that cuts texts before white space and takes them as they are."""
    splitter = description["pre_tokenizer"] or {}
    return (
        not description["normalizer"]
        and splitter.get("type") == "ByteLevel"
        and splitter.get("use_regex", True)
        and not splitter["add_prefix_space"]
        and description["model"]["type"] == "BPE"
        and not (description["truncation"] or description["padding"])
    )


@lru_cache(maxsize=2)
def _opened(path: str):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    description = json.loads(tokenizer.to_str())
    if not wordwise(description):
        tokenizer.no_truncation()
        tokenizer.no_padding()
        return tokenizer, None, None
    encoder = WordEncoder(PieceEncoder(tokenizer, description, _PLAIN_WORDWISE, True))
    return tokenizer, encoder, Pools([np.uint32])


def _lines(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> str:
    """Words of the data, a line end behind each."""
    behind = np.cumsum(ends - starts + 1)
    place = np.repeat(ends + 1 - behind, ends - starts + 1)
    place += np.arange(len(place))
    lines = data[np.minimum(place, len(data) - 1)]
    lines[behind - 1] = ord("\n")
    return lines.tobytes().decode()


def _word_ids(texts: pa.Array, encoder: WordEncoder, pools: Pools) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for _, _, data, offsets in chunks(texts, TEXT):
        starts, ends, at = cut(data, offsets)
        if not len(starts):
            yield np.zeros(len(offsets) - 1, np.int64), np.empty(0, np.uint32)
            continue
        keys = hashes(data, starts, ends, False)
        distinct, first, which = np.unique(keys, return_index=True, return_inverse=True)
        new = pools.missing(distinct)
        places = first[new]
        pools.add(distinct[new], [encoder(_lines(data, starts[places], ends[places]))])
        ranks = pools.ranks(distinct)[which]
        yield split(pools.counts(0, ranks), at), pools.take(0, ranks)


def encoded(path: str) -> Callable[[pa.Array], Iterator[tuple[np.ndarray, np.ndarray]]]:
    """A function of a text column: (ids per text, all ids) of its parts, a few megabytes at a time.

    The ids are those of the tokenizers library for each whole text, without special tokens added; nulls
    are empty.  Words are told apart by 64-bit hashes.
    """

    def run(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        tokenizer, encoder, pools = _opened(path)
        if encoder is not None:
            yield from _word_ids(texts, encoder, pools)
            return
        for _, _, data, offsets in chunks(texts, TEXT):
            whole = data.tobytes()
            cuts = offsets.tolist()
            found = tokenizer.encode_batch_fast(
                [whole[a:b].decode() for a, b in zip(cuts, cuts[1:])], add_special_tokens=False
            )
            ids = [np.array(one.ids, np.uint32) for one in found]
            yield np.array([len(i) for i in ids], np.int64), np.concatenate(ids) if ids else np.empty(0, np.uint32)

    return run


def id_kind(path: str, *others: int) -> str:
    """The integers, little-endian, that hold every id of a tokenizer and the others given."""
    largest = max(_opened(path)[0].get_vocab_size(with_added_tokens=True) - 1, *others)
    return "<u2" if largest < 1 << 16 else "<u4"


def byte_encoder(path: str) -> PieceEncoder:
    """The encoder of a byte-level tokenizer file, to which special tokens in a text are ordinary text."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    description = json.loads(tokenizer.to_str())
    if not bytewise(description):
        raise ValueError(f"{path} is no byte-level tokenizer")
    tokenizer.encode_special_tokens = True
    return PieceEncoder(tokenizer, description | {"added_tokens": []}, _PLAIN_BYTEWISE, False)
