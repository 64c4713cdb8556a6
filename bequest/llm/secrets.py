"""Secret scans: patterns, and tests of randomness with control of false discoveries."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, small_batches

# The patterns of the base kinds.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
ASSIGN_LEAST, ACCESS_LEAST = 8, 16

KINDS = ("assign", "access", "hex", "random")
_RANDOM = KINDS.index("random")

# Runs of [0-9a-f]+ with 32 or more characters.
_HEX_RUN = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
# Strings of 20 or more characters; = only pads their end, since inside it parts a name from a value.
_TOKEN = re.compile(r"[A-Za-z0-9+/_-]{20,}(?:=++(?![A-Za-z0-9+/_-]))?")

#: Encodings from the narrowest alphabet to the widest.
ENCODINGS = (
    ("hex", "0123456789abcdef"),
    ("HEX", "0123456789ABCDEF"),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("alnum", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("base62", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64url", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
)
_PLACES = [{c: i for i, c in enumerate(letters)} for _, letters in ENCODINGS]

#: Expected share of benign strings that are reported as random, in each stratum.
FALSE_DISCOVERIES = 0.05
#: Bins of the p-values that a stratum's threshold is chosen from.
BINS = 1000
#: Lengths at which a new stratum begins.
LENGTHS = (20, 24, 32, 40, 64, 128, 256)


def _normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def _chi_squared_two_sided(value: float, freedom: int) -> float:
    """By the cube-root transform; both too uneven and too even count."""
    spread = 2 / (9 * freedom)
    return _normal_two_sided(((value / freedom) ** (1 / 3) - (1 - spread)) / math.sqrt(spread))


def infer_encoding(token: str) -> int | None:
    """The narrowest encoding whose alphabet holds the token, padding aside."""
    letters = set(token.rstrip("="))
    for number, places in enumerate(_PLACES):
        if letters and letters <= places.keys():
            return number
    return None


def randomness(token: str, encoding: int) -> float:
    """p-value of three tests that the token is drawn evenly from its alphabet.

    Chi-squared over bands of the alphabet wide enough for the length, runs above and below the
    middle, serial correlation of neighbours; the smallest of the three, Bonferroni-corrected.
    """
    letters = ENCODINGS[encoding][1]
    places = _PLACES[encoding]
    values = np.array([places[c] for c in token.rstrip("=")])
    n, size = len(values), len(letters)
    bands = max(2, min(size, n // 5))
    band = values * bands // size
    width = np.bincount(np.arange(size) * bands // size, minlength=bands) / size
    expected = n * width
    observed = np.bincount(band, minlength=bands)
    p = [_chi_squared_two_sided(float(((observed - expected) ** 2 / expected).sum()), bands - 1)]
    high = values >= size // 2
    ones = int(high.sum())
    zeros = n - ones
    if ones and zeros:
        runs = 1 + int((high[1:] != high[:-1]).sum())
        mean = 2 * ones * zeros / n + 1
        variance = (mean - 1) * (mean - 2) / (n - 1)
        p.append(_normal_two_sided((runs - mean) / math.sqrt(variance)) if variance > 0 else 0.0)
        deviation = values - values.mean()
        correlation = float((deviation[1:] * deviation[:-1]).sum() / (deviation**2).sum())
        p.append(_normal_two_sided((correlation + 1 / n) * math.sqrt(n)))
    else:
        p += [0.0, 0.0]
    # Letters of words have kinds in a row: cases and digits of a random token mix.
    kinds = np.array([c.isdigit() + 2 * c.isupper() for c in token.rstrip("=")])
    share = {k: sum((c.isdigit() + 2 * c.isupper()) == k for c in letters) / size for k in (0, 1, 2)}
    stay = sum(s * s for s in share.values())
    if 0 < stay < 1:
        same = int((kinds[1:] == kinds[:-1]).sum())
        p.append(_normal_two_sided((same - (n - 1) * stay) / math.sqrt((n - 1) * stay * (1 - stay))))
    return min(1.0, len(p) * min(p))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, sorted."""
    found = [
        (m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST
    ]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    found += [(m.start(), 2, m.end()) for m in _HEX_RUN.finditer(text)]
    return sorted(found)


def _tokens(text: str, spans: list[tuple[int, int, int]]) -> Iterator[re.Match]:
    """Strings to be tested, in what the base spans leave."""
    low = 0
    for start, _, stop in spans:
        if start > low:
            yield from _TOKEN.finditer(text, low, start)
        low = max(low, stop)
    yield from _TOKEN.finditer(text, low)


_SCANNED = (
    "id long, base array<struct<start:int,kind:int,stop:int>>, "
    "tokens array<struct<start:int,stop:int,stratum:int,bin:int>>"
)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    base_type = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("stop", pa.int32())]))
    token_type = pa.list_(
        pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("stratum", pa.int32()), ("bin", pa.int32())])
    )
    for batch in batches:
        base, tokens = [], []
        for text in batch.column("text").to_pylist():
            text = text or ""
            spans = base_spans(text)
            base.append([{"start": a, "kind": k, "stop": b} for a, k, b in spans])
            found = []
            for m in _tokens(text, spans):
                encoding = infer_encoding(m[0])
                if encoding is None or len(m[0].rstrip("=")) < LENGTHS[0]:
                    continue
                band = sum(len(m[0]) >= least for least in LENGTHS) - 1
                place = min(BINS - 1, int(randomness(m[0], encoding) * BINS))
                found.append(
                    {"start": m.start(), "stop": m.end(), "stratum": encoding * len(LENGTHS) + band, "bin": place}
                )
            tokens.append(found)
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), pa.array(base, base_type), pa.array(tokens, token_type)], ["id", "base", "tokens"]
        )


def _thresholds(tokens: DataFrame, rate: float) -> list[tuple[int, int]]:
    """(stratum, least bin) above which strings are reported.

    p-values of random strings are even over the bins, those of other strings gather in the lowest.
    In each stratum the upper half of the bins tells how many random strings a bin holds; what the
    bins from some bin to the middle hold beyond that is benign.  A stratum reports the bins from the least on, as long as no more than `rate` of the
    reported strings are expected to be benign; a stratum of benign strings alone reports none.
    """
    counted = tokens.groupBy("stratum", "bin").agg(F.count("*").alias("n")).collect()  # strata times bins
    table: dict[int, np.ndarray] = {}
    for stratum, place, n in counted:
        table.setdefault(stratum, np.zeros(BINS))[place] += n
    out = []
    half = BINS // 2
    for stratum, counts in sorted(table.items()):
        random_in_bin = counts[half:].sum() / (BINS - half)
        reported = np.cumsum(counts[::-1])[::-1]
        lower = np.cumsum(counts[:half][::-1])[::-1]
        wrong = np.r_[np.maximum(lower - random_in_bin * np.arange(half, 0, -1), 0), np.zeros(BINS - half)]
        good = np.flatnonzero((reported > 0) & (wrong <= rate * reported))
        if len(good):
            out.append((stratum, int(good[0])))
    return out


def _as_text(spans: F.Column) -> F.Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"], s["stop"])), ","
    )


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = FALSE_DISCOVERIES) -> DataFrame:
    """Secrets of each document: a row for each input row.

    Columns: id_col, n_assign, n_access, n_hex, base_sha256 (of the base spans as text), spans (text:
    kind:start:end by start, then kind; code points, end exclusive) and found, the same as an array.
    Base kinds are patterns.  Kind `random` adds strings of 20 or more characters, outside base
    spans, that pass the tests of randomness of their encoding; how sure a string must be is chosen
    for each encoding and length so that few reported strings are benign.  Null and empty texts
    have no spans; ids may be null or repeat; other columns are not read.
    """
    small_batches(docs.sparkSession)
    read = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    scanned = kept(read.mapInArrow(_scan, _SCANNED), "secret-scan")
    limits = _thresholds(scanned.select(F.explode("tokens").alias("t")).select("t.*"), rate)
    least = F.create_map(*(F.lit(x) for pair in limits for x in pair)) if limits else None
    passing = (
        F.filter("tokens", lambda t: t["bin"] >= F.coalesce(least[t["stratum"]], F.lit(BINS)))
        if limits
        else F.slice("tokens", 1, 0)
    )
    added = F.transform(
        passing,
        lambda t: F.struct(t["start"].alias("start"), F.lit(_RANDOM).alias("kind"), t["stop"].alias("stop")),
    )
    found = F.array_sort(F.concat(F.col("base"), added.cast("array<struct<start:int,kind:int,stop:int>>")))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return scanned.withColumn("found", found).select(
        F.col("id").alias(id_col),
        *(count(k).alias(f"n_{name}") for k, name in enumerate(KINDS[:_RANDOM])),
        F.sha2(_as_text(F.col("base")), 256).alias("base_sha256"),
        _as_text(F.col("found")).alias("spans"),
        "found",
    )
