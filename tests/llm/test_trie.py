"""The prefix trie against a plain one, over many small shards."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from bequest.llm.prefix_trie import DoubleArray, paths, prefix_trie, shared_starts, turn_digests

COLUMNS = "conv_id long, turn long, role string, text string, one string, path string, shard long"


def turns_of(spark, rows):
    wide = [(*r, "x", "y", 3) for r in rows]
    return spark.createDataFrame(wide, COLUMNS).repartition(3)


def digest(role, text):
    """Spark's xxhash64 over (role, text)."""
    seed = xxhash.xxh64_intdigest(role.encode(), 42)
    return xxhash.xxh64(text.encode(), seed).intdigest() - (xxhash.xxh64(text.encode(), seed).intdigest() >> 63 << 64)


def trie_truth(rows, rebuild):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            own[conv].append((turn is not None, turn or 0, digest(role, text), role, text))
    own = {c: [t[3:] for t in sorted(listed)] for c, listed in own.items()}
    built = {}
    for conv, listed in own.items():
        h = zlib.crc32(str(conv).encode()) % 4 if rebuild and conv % 20 else 0
        built[conv] = own.get(conv - conv % 20, [])[:h] + listed[h:]
    members = defaultdict(list)
    for conv, listed in built.items():
        for depth in range(len(listed) + 1):
            members[tuple(listed[:depth])].append(conv)
    kids = defaultdict(list)
    for path in members:
        if path:
            kids[path[:-1]].append(path)
    below = defaultdict(lambda: [0, 0])
    for path in members:
        words = len(re.findall(r"[^\x20\x09-\x0D]+", path[-1][1])) if path else 0
        for depth in range(len(path) + 1):
            below[path[:depth]][0] += not kids[path]
            below[path[:depth]][1] += (len(members[path]) - 1) * words
    out = []
    for path, convs in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in convs if len(built[c]) == len(path)))
        parent = min(members[path[:-1]]) if path else None
        sha = hashlib.sha256(ends.encode()).hexdigest()
        out.append((min(convs), len(path), parent, len(convs), len(kids[path]), *below[path], sha))
    return sorted(out, key=str)


def conversations(seed, size=200):
    rnd = random.Random(seed)
    texts = ["a", "b c", "", None, "hello  there\nyou", "a b c d", "é ü", "x" * 4000 + " y"]
    rows = []
    common = [("system", "be good"), ("user", "hi there"), ("assistant", "hello you")]
    for conv in rnd.sample(range(size * 2), size):
        start = common[: rnd.randrange(4)] if rnd.random() < 0.6 else []
        listed = start + [(rnd.choice(["user", "assistant", None]), rnd.choice(texts)) for _ in range(rnd.randrange(5))]
        for turn, (role, text) in enumerate(listed):
            rows.append((conv, rnd.choice([turn, turn, turn, None]), role, text))
    rows += [(7_000_000_000, t, "user", f"turn {t}") for t in range(60)]
    rows += [(None, 0, "user", "nobody's"), (5, 1, "user", "same"), (5, 1, "user", "same"), (5, 1, "user", "other")]
    return rows


@pytest.mark.parametrize("seed, convs, turns", [(1, 1, 1000), (2, 7, 1000), (3, 40, 9), (4, 10_000, 100_000)])
def test_nodes(spark, seed, convs, turns):
    rows = conversations(seed)
    for rebuild in (True, False):
        read = turn_digests(turns_of(spark, rows))
        found = prefix_trie(paths(shared_starts(read) if rebuild else read), convs, turns)
        assert sorted((tuple(r) for r in found.collect()), key=str) == trie_truth(rows, rebuild)


def test_copies_over_many_shards(spark):
    rows = [(c, t, "user", f"turn {t}") for c in range(300) for t in range(3 if c % 3 else 2)]
    found = prefix_trie(paths(turn_digests(turns_of(spark, rows))), 16, 1000)
    assert sorted((tuple(r) for r in found.collect()), key=str) == trie_truth(rows, False)


def test_no_conversations(spark):
    rows = turns_of(spark, [(1, 1, "a", "b")])
    assert prefix_trie(paths(shared_starts(turn_digests(rows.limit(0))))).count() == 0
    assert prefix_trie(paths(shared_starts(turn_digests(rows.withColumn("conv_id", rows.conv_id - 1).filter("conv_id > 0"))))).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_double_array(seed):
    rnd = random.Random(seed)
    parents, codes, level, known = [], [], [0], 1
    for _ in range(6):
        following = []
        for parent in level:
            few = rnd.choice([0, 1, 1, 1, 2, 3, 200 if seed % 2 else 5])
            for code in sorted(rnd.sample(range(1, 900), few)):
                parents.append(parent)
                codes.append(code)
                following.append(known)
                known += 1
        level = following[:400]
    trie = DoubleArray(np.array(parents, np.int64), np.array(codes, np.int64))
    assert len(set(trie.slots.tolist())) == known
    where = {(p, c): n + 1 for n, (p, c) in enumerate(zip(parents, codes))}
    for node in rnd.sample(range(known), min(known, 150)):
        tried = np.array(rnd.sample(range(1, 900), 60) + [c for p, c in where if p == node])
        got = trie.step(np.full(len(tried), trie.slots[node]), tried)
        assert got.tolist() == [trie.slots[where[node, c]] if (node, c) in where else -1 for c in tried.tolist()]


def test_families_of_near_codes_pack_densely():
    rnd = random.Random(1)
    parents = sorted(rnd.randrange(1, 4000) for _ in range(9000))
    trie = DoubleArray(np.array([0] * 4000 + parents), np.arange(1, 13001))
    assert len(trie.check) < 1.02 * 13001
