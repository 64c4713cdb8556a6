"""Personal data: patterns, and a semi-Markov conditional random field for what they miss."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, smallest_hashes

KINDS = ("email", "ip", "card", "phone")

# The patterns of the base kinds.  An e-mail's local part is found backwards from its @,
# and an address starts where its digits do, which gives the same matches in linear time.
_AFTER_AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: Tokens of an entity, at most: the bound of the dynamic program.
LONGEST = 15
#: Documents, and texts around digits or @ in them, that a model is fitted on, at most.
TRAIN_DOCS, TRAIN_TEXTS = 2_000, 300
#: Of each of these documents so many texts around digits at most, and their characters at most.
REGIONS, REGION = 3, 300
#: Generated examples of each kind, and of numbers that are none, that join them.
EXAMPLES = 60
#: Probability a span needs to be added.
SURE = 0.8

# Host names after a spelled @: their dots are words between spaces, or in brackets with or without spaces.
_LABEL = r"\w[\w.-]*"
_HOST = rf"\x20*{_LABEL}(?:(?:\x20+[Dd][Oo][Tt]\x20+|\x20*(?:\([Dd][Oo][Tt]\)|\[[Dd][Oo][Tt]\])\x20*){_LABEL})+"
_AT = re.compile(r"\b[Aa][Tt]\b|\([Aa][Tt]\)|\[[Aa][Tt]\]")
_SPELLED = re.compile(rf"(?:\b[Aa][Tt](?=\x20)|\([Aa][Tt]\)|\[[Aa][Tt]\]){_HOST}")
_ADDRESS = re.compile(rf"[\w.%+-]+\x20*{_SPELLED.pattern}(?<!\.)")
# A digit, an @, or _SPELLED; its first letter is one of a set, which is searched for fast.
_TRIGGER = re.compile(
    rf"[0-9@Aa(\[](?:(?<=[0-9@])|(?:(?<!\w.)(?<=[Aa])[Tt](?=\x20)|(?<=\()[Aa][Tt]\)|(?<=\[)[Aa][Tt]\]){_HOST})"
)
_TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|[^\sA-Za-z0-9\x80-\U0010ffff]|[\x80-\U0010ffff]+")
_CUES = {
    "mail": "email", "email": "email", "e-mail": "email", "contact": "email",
    "tel": "phone", "phone": "phone", "call": "phone", "mobile": "phone", "fax": "phone",
    "ip": "ip", "host": "ip", "server": "ip", "address": "ip",
    "card": "card", "visa": "card", "credit": "card", "mastercard": "card",
}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base patterns, sorted."""
    found, last = [], 0
    for m in _AFTER_AT.finditer(text):
        start = m.start()
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            found.append((0, start, m.end()))
            last = m.end()
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
            found.append((1, m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            found.append((2, m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                found.append((3, m.start(), m.end()))
    return sorted(found)


def regions(text: str, taken: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Stretches of text around digits and @, also a spelled one, with a word on either side, between the taken spans."""
    taken = sorted(taken)
    place = at = 0
    while True:
        m = _TRIGGER.search(text, place)
        if not m:
            return
        while at < len(taken) and taken[at][1] <= m.start():
            at += 1
        if at < len(taken) and taken[at][0] <= m.start():
            place = taken[at][1]
            continue
        low = taken[at - 1][1] if at else 0
        high = taken[at][0] if at < len(taken) else len(text)
        start = _word_back(text, _word_back(text, m.start(), low), low)
        end = _word_on(text, min(m.end(), high), high)
        end = max(end, _spelled_to(text, m.end(), end, high))
        while end < high:  # go on as long as the next word has a trigger too
            after = _word_on(text, end, high)
            far = _spelled_to(text, end, after, high)
            if after == end or not (far or _TRIGGER.search(text, end, after)):
                break
            end = max(after, far)
        end = _word_on(text, end, high)
        yield start, end
        place = max(end, m.start() + 1)


def _spelled_to(text: str, low: int, stop: int, high: int) -> int:
    """The end of the word in which the last spelled address that starts in the stretch ends, or 0."""
    found = 0
    for at in _AT.finditer(text, low, stop):
        m = _SPELLED.match(text, at.start(), high)
        found = _word_on(text, m.end() - 1, high) if m else found
    return found


def _word_back(text: str, place: int, low: int) -> int:
    while place > low and text[place - 1].isspace():
        place -= 1
    while place > low and not text[place - 1].isspace():
        place -= 1
    return place


def _word_on(text: str, place: int, high: int) -> int:
    while place < high and text[place].isspace():
        place += 1
    while place < high and not text[place].isspace():
        place += 1
    return place


def _kind_of(c: str) -> str:
    return "edge" if not c else "space" if c.isspace() else "word" if c.isalnum() else "sign"


def _may_be(piece: str) -> bool:
    """Spans with enough digits, or with an @ or a spelled one; others are never entities."""
    digits = sum(c.isdigit() for c in piece)
    if digits >= 7 or (digits >= 4 and piece.count(".") == 3) or "@" in piece:
        return True
    folded = piece.lower()
    return "dot" in folded and "at" in folded


def span_features(before: str, piece: str, after: str) -> list[str]:
    """Features of a whole span."""
    digits = [c for c in piece if c.isdigit()]
    shape = re.sub(r"[0-9]+", "9", re.sub(r"[^\W\d_]+", "a", piece))
    groups = re.findall(r"[0-9]+", piece)
    out = [
        "always",
        f"shape={shape[:24]}",
        f"digits={min(len(digits), 20)}",
        f"groups={min(len(groups), 8)}",
        f"before={_kind_of(before[-1:])}",
        f"after={_kind_of(after[:1])}",
        f"ends={_kind_of(piece[:1])},{_kind_of(piece[-1:])}",
        f"letters={any(c.isalpha() for c in piece)}",
    ]
    out += [f"has={c}" for c in "+@.()-/ " if c in piece]
    if re.search(r"\bat\b", piece, re.IGNORECASE) and re.search(r"\bdot\b", piece, re.IGNORECASE):
        out.append("spelled")
    if _ADDRESS.fullmatch(piece):
        out.append("spelled-whole")
    if len(groups) == 4 and all(len(g) <= 3 and int(g) <= 255 for g in groups):
        out.append("four-bytes")
    if 13 <= len(digits) <= 19:
        out.append(f"luhn={luhn(''.join(digits))}")
    for word in re.findall(r"[\w-]+", before.lower())[-3:]:
        if word in _CUES:
            out.append(f"cue={_CUES[word]}")
    return out


class SemiMarkovField:
    """A conditional random field over segmentations of a token sequence.

    A segment is one token outside entities, or a span of at most LONGEST tokens of one kind; its
    score is the sum of the weights of its whole-span features.
    """

    def __init__(self) -> None:
        self.weights: dict[tuple[int, str], float] = defaultdict(float)

    @staticmethod
    def lattice(text: str) -> tuple[list[tuple[int, int]], list[tuple[int, int, list[str]]]]:
        """Tokens, and candidate spans as (first token, end token, features)."""
        tokens = [m.span() for m in _TOKEN.finditer(text)]
        spans = []
        for i in range(len(tokens)):
            for j in range(i + 1, min(len(tokens), i + LONGEST) + 1):
                a, b = tokens[i][0], tokens[j - 1][1]
                if _may_be(text[a:b]):
                    spans.append((i, j, span_features(text[max(0, a - 40) : a], text[a:b], text[b : b + 1])))
        return tokens, spans

    def scores(self, spans) -> list[list[float]]:
        w = self.weights
        return [[sum(w.get((k, f), 0.0) for f in features) for k in range(len(KINDS))] for _, _, features in spans]

    def marginals(self, n: int, spans, scores) -> list[list[float]]:
        """Probability of every span and kind, summed over all segmentations."""
        by_end, by_start = defaultdict(list), defaultdict(list)
        for s, (i, j, _) in enumerate(spans):
            by_end[j].append(s)
            by_start[i].append(s)
        total = [_log_sum(row) for row in scores]
        forward, backward = [0.0] * (n + 1), [0.0] * (n + 1)
        for j in range(1, n + 1):
            forward[j] = _log_sum([forward[j - 1], *(forward[spans[s][0]] + total[s] for s in by_end[j])])
        for i in range(n - 1, -1, -1):
            backward[i] = _log_sum([backward[i + 1], *(backward[spans[s][1]] + total[s] for s in by_start[i])])
        return [
            [math.exp(min(0.0, forward[i] + value + backward[j] - forward[n])) for value in row]
            for (i, j, _), row in zip(spans, scores)
        ]

    def fit(self, examples: list[tuple[str, list[tuple[int, int, int]]]], rounds: int = 6, rate: float = 0.5) -> None:
        """Stochastic gradient of the likelihood; examples are (text, [(kind, start, end)])."""
        ready = []
        for text, gold in examples:
            tokens, spans = self.lattice(text)
            places = {(tokens[i][0], tokens[j - 1][1]): s for s, (i, j, _) in enumerate(spans)}
            right = {(places[(a, b)], k) for k, a, b in gold if (a, b) in places}
            if spans:
                ready.append((len(tokens), spans, right))
        order, steps = random.Random(7), defaultdict(float)
        for _ in range(rounds):
            order.shuffle(ready)
            for n, spans, right in ready:
                for s, row in enumerate(self.marginals(n, spans, self.scores(spans))):
                    for k, p in enumerate(row):
                        error = ((s, k) in right) - p
                        if abs(error) > 1e-3:
                            for f in spans[s][2]:
                                steps[k, f] += error * error
                                self.weights[k, f] += rate * error / math.sqrt(1.0 + steps[k, f])

    def best(self, text: str, sure: float = SURE) -> list[tuple[int, int, int]]:
        """The best segmentation's entities whose probability is at least `sure`."""
        tokens, spans = self.lattice(text)
        if not spans:
            return []
        scores, n = self.scores(spans), len(tokens)
        value, back = [0.0] * (n + 1), [None] * (n + 1)
        by_end = defaultdict(list)
        for s, (_, j, _) in enumerate(spans):
            by_end[j].append(s)
        for j in range(1, n + 1):
            value[j] = value[j - 1]
            for s in by_end[j]:
                k = max(range(len(KINDS)), key=lambda k: scores[s][k])
                if value[spans[s][0]] + scores[s][k] > value[j]:
                    value[j], back[j] = value[spans[s][0]] + scores[s][k], (s, k)
        likely, out, j = None, [], n
        while j > 0:
            if back[j] is None:
                j -= 1
                continue
            s, k = back[j]
            likely = likely or self.marginals(n, spans, scores)
            if likely[s][k] >= sure:
                out.append((k, tokens[spans[s][0]][0], tokens[spans[s][1] - 1][1]))
            j = spans[s][0]
        return out[::-1]


def _log_sum(values: list[float]) -> float:
    top = max(values)
    return top + math.log(sum(math.exp(v - top) for v in values))


#: How the @ and the dot of an e-mail address are written.
_FORMS = (
    ("@", "."), (" @ ", "."), (" at ", " dot "), (" AT ", " DOT "),
    (" (at) ", " (dot) "), (" [at] ", " [dot] "), ("(at)", "(dot)"), ("[at]", "[dot]"), ("(AT)", "(DOT)"), (" [At] ", " [Dot] "),
)


def _examples(seed: int = 11) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Entities as people write them, also in ways the patterns miss, and other numbers."""
    r = random.Random(seed)
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    name = lambda: "".join(r.choice("abcdefghiklmnoprstuvw") for _ in range(r.randint(3, 8)))

    def card() -> str:
        body = digits(15)
        return next(body + str(c) for c in range(10) if luhn(body + str(c)))

    def cut_up(text: str, sign: str, size: int) -> str:
        return sign.join(text[i : i + size] for i in range(0, len(text), size))

    def email() -> str:
        at, dot = r.choice(_FORMS)
        return f"{name()}{r.choice(['', '.' + name(), digits(2)])}{at}{name()}{dot}{r.choice(['com', 'org', 'net', 'edu'])}"

    def ip() -> str:
        return r.choice([".", " . ", "[.]"]).join(str(r.randint(0, 255)) for _ in range(4))

    def phone() -> str:
        a, b, c = digits(3), digits(3), digits(4)
        forms = [f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+1 ({a}) {b}-{c}", f"00{digits(2)} {a} {b} {c}", f"1-{a}-{b}-{c}"]
        return r.choice(forms)

    def other() -> str:
        forms = [digits(r.randint(5, 15)), f"{digits(4)}-{digits(2)}-{digits(2)}", f"{digits(3)},{digits(3)}.{digits(2)}"]
        forms += [f"v{digits(1)}.{digits(2)}.{digits(1)}", f"{digits(2)}:{digits(2)}:{digits(2)}", f"@{name()}", digits(16), digits(24)]
        forms += [f"{digits(2)}/{digits(2)}/{digits(4)}", f"ISBN {digits(3)}-{digits(1)}-{digits(5)}-{digits(3)}-{digits(1)}"]
        return r.choice([f for f in forms if not luhn("".join(c for c in f if c.isdigit()) or "1")] or forms[:3])

    makers = (email, ip, lambda: cut_up(card(), r.choice([".", " ", "-", "  ", "/"]), 4), phone)
    out = []
    for _ in range(EXAMPLES):
        for kind, make in enumerate(makers):
            cue = r.choice(["", "", r.choice([c for c, k in _CUES.items() if k == KINDS[kind]]) + r.choice([": ", " "])])
            lead, piece = f"{name()} {cue}", make()
            out.append((f"{lead}{piece}{r.choice(['', ',', '.'])} {name()}", [(kind, len(lead), len(lead) + len(piece))]))
        out.append((f"{name()} {other()} {name()}", []))
        out.append((f"{name()} {other()}, {other()} {name()}", []))
    for at, dot in _FORMS[1:] * 8:  # also where a text begins or ends
        piece = f"{name()}{r.choice(['', '.' + name(), digits(r.randint(1, 2))])}{at}{name()}{dot}{r.choice(['com', 'org', 'net', 'edu'])}"
        lead, rest = r.choice(["", f"{name()} ", f"{name()}: "]), r.choice(["", ".", f", {name()}", f" {name()}"])
        out.append((lead + piece + rest, [(0, len(lead), len(lead) + len(piece))]))
    return out


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> SemiMarkovField:
    """A field fitted on generated examples and a bounded sample of the corpus.

    The sample is the TRAIN_DOCS documents with digits or @ with the smallest hashes of their ids, and of
    the first REGIONS surroundings of each, of REGION characters at most, the TRAIN_TEXTS with the smallest
    hashes; it does not depend on how the rows lie.  Spans of the base patterns are right there, and
    whatever else has digits is taken for no entity.  Surroundings with a spelled address, which no pattern
    judges, are left out.
    """
    some = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    some = some.filter("id is not null and text rlike '[0-9@]'")
    chosen = smallest_hashes(some.select("id"), "id", TRAIN_DOCS)
    some = some.join(F.broadcast(chosen), "id", "left_semi")
    examples = _examples()
    # Only the surroundings of the digits leave the executors.
    around = some.mapInArrow(_surroundings, "text string, spans array<array<int>>")
    mixed = F.xxhash64("text"), "text", "spans"
    for row in around.orderBy(*mixed).limit(TRAIN_TEXTS).collect():
        examples.append((row["text"], [tuple(s) for s in row["spans"]]))
    field = SemiMarkovField()
    field.fit(examples)
    field.weights = {k: w for k, w in field.weights.items() if abs(w) > 1e-4}
    return field


def _surroundings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, spans = [], []
        for text in batch.column("text").to_pylist():
            found = base_spans(text)
            for start, end in list(regions(text, []))[:REGIONS]:
                if end - start <= REGION and not _SPELLED.search(text, start, end):
                    texts.append(text[start:end])
                    spans.append([[k, a - start, b - start] for k, a, b in found if start <= a and b <= end])
        yield pa.RecordBatch.from_arrays(
            [pa.array(texts, pa.string()), pa.array(spans, pa.list_(pa.list_(pa.int32())))], ["text", "spans"]
        )


_RESULT = "id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string"


def _as_text(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def _scan(shared):
    names = [c.split()[0] for c in _RESULT.split(", ")]
    kinds = [pa.int64()] * (1 + len(KINDS)) + [pa.string()] * 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = lru_cache(100_000)(shared.value.best)
        for batch in batches:
            out = []
            for number, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
                text = text or ""
                base = base_spans(text)
                added = []
                for start, end in regions(text, [(a, b) for _, a, b in base]):
                    added += [(k, start + a, start + b) for k, a, b in best(text[start:end])]
                counts = [sum(k == kind for k, _, _ in base) for kind in range(len(KINDS))]
                digest = hashlib.sha256(_as_text(base).encode()).hexdigest()
                out.append((number, *counts, digest, _as_text(sorted(base + added))))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    return run


def personal_data(docs: DataFrame, field: SemiMarkovField, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Personal data of each document: a row for each input row.

    Columns: id_col, n_email, n_ip, n_card, n_phone (base spans), base_sha256 (of the base spans as
    text) and spans (kind:start:end by kind, then start; code points, end exclusive).  Base spans are
    patterns and always stay; the field adds spans to the text between them.  Null and empty texts
    have no spans; ids may be null or repeat; other columns are not read.
    """
    small_batches(docs.sparkSession)
    read = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(field)
    return read.mapInArrow(_scan(shared), _RESULT).withColumnRenamed("id", id_col)
