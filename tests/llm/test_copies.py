"""Exact and near copies and repeated passages, against brute force."""

from __future__ import annotations

import hashlib
import random
import re
from collections import defaultdict

import pyarrow as pa
import pytest
from corpus import corpus, frame, sentence

from bequest.llm import exact_dedup, ngram_join, packing, substring_dedup
from bequest.llm.common import components
from bequest.llm.exact_dedup import exact_duplicates, without_copies
from bequest.llm.ngram_join import jaccard_components, without_near_copies
from bequest.llm.substring_dedup import SuffixAutomaton, remove_repeated_passages

SPACE = r"[\x20\x09-\x0D]+"


def words_of(text):
    return [w for w in re.split(SPACE, text or "") if w]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def exact_truth(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(SPACE, " ", t or "")].append(i)
    return {i: (min(g), len(g), i == min(g), sha(t)) for t, g in groups.items() for i in g}


def near_truth(rows, k, num, den):
    sets = {}
    for i, t in rows:
        w = words_of(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    up = {i: i for i in sets}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in sets:
        for j in sets:
            common = len(sets[i] & sets[j])
            if i < j and common and den * common >= num * (len(sets[i]) + len(sets[j]) - common):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def passage_truth(rows, window=13):
    first = {}
    listed = {i: words_of(t) for i, t in rows}
    for i, w in listed.items():
        for j in range(len(w) - window + 1):
            key = tuple(w[j : j + window])
            first[key] = min(first.get(key, i), i)
    out = {}
    for i, w in listed.items():
        gone = set()
        for j in range(len(w) - window + 1):
            if first[tuple(w[j : j + window])] < i:
                gone.update(range(j, j + window))
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out[i] = (len(w), len(gone), sha(kept))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_exact(spark, seed):
    rows = corpus(seed)
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_duplicates(frame(spark, rows)).collect()}
    assert got == exact_truth(rows)


def test_copies_over_many_partitions_and_hashes_that_meet(spark, monkeypatch):
    """A text in most rows fills many partitions; with one hash for all, neighbours still differ."""
    rnd = random.Random(5)
    rows = [(i, "same  text" if rnd.random() < 0.6 else f"same text {rnd.randrange(9)}") for i in rnd.sample(range(999), 300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    monkeypatch.setattr(exact_dedup, "PREFIX", 3)
    monkeypatch.setattr(exact_dedup.F, "xxhash64", lambda *c: exact_dedup.F.lit(7).cast("long"))
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_duplicates(docs).collect()}
    assert got == exact_truth(rows)


def test_exact_with_null_and_repeated_ids(spark):
    rows = [(3, "a b"), (None, "a  b"), (3, "a b"), (None, "c"), (4, None), (None, "")]
    found = exact_duplicates(frame(spark, rows)).collect()
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept) for r in found) == sorted(
        [("3", "3", 3, True), ("3", "3", 3, False), ("None", "3", 3, False), ("None", "None", 1, True), ("4", "4", 2, True), ("None", "4", 2, False)]
    )
    left = without_copies(frame(spark, rows))
    assert left.columns == frame(spark, rows).columns
    assert sorted((str(r.doc_id), str(r.text)) for r in left.collect()) == [("3", "a b"), ("4", "None"), ("None", "c")]


@pytest.mark.parametrize("seed,k,num,den", [(1, 4, 85, 100), (2, 5, 80, 100), (3, 2, 50, 100)])
def test_near(spark, seed, k, num, den):
    rows = corpus(seed)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(frame(spark, rows), k, num, den).collect()}
    assert got == near_truth(rows, k, num, den)


def test_near_in_small_blocks(spark, monkeypatch):
    """Long posting lists and large clusters are cut up; no link gets lost."""
    rnd = random.Random(9)
    base = sentence(rnd, 60).split()
    rows = []
    for i in range(90):
        words = list(base)
        for _ in range(rnd.randrange(5)):
            words[rnd.randrange(60)] = f"new{rnd.randrange(50)}"
        rows.append((i, " ".join(words)))
    run = lambda: {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(docs, 3, 85, 100).collect()}
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    truth = near_truth(rows, 3, 85, 100)
    assert run() == truth and 1 < len({c for _, c in truth.values()}) < 60
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    monkeypatch.setattr(ngram_join, "BLOCK_SHINGLES", 300)
    monkeypatch.setattr(ngram_join, "COUNTED", 0.0)
    pairs = ngram_join._candidates(85, 100)
    assert pairs and run() == truth


def test_near_with_null_and_repeated_ids(spark):
    text = "p q r s t u v w x y z"
    rows = [(5, text), (None, text), (5, text), (2, text + " z"), (None, None), (7, "")]
    docs = frame(spark, rows)
    found = jaccard_components(docs, 5, 80, 100).collect()
    assert sorted((str(r.doc_id), str(r.component_id)) for r in found) == sorted(
        [("5", "2"), ("5", "2"), ("None", "None"), ("None", "None"), ("2", "2"), ("7", "7")]
    )
    left = without_near_copies(docs)
    assert sorted(left.columns) == sorted(docs.columns)
    assert sorted(str(r.doc_id) for r in left.collect()) == ["2", "7", "None", "None"]


def test_components(spark):
    rnd = random.Random(2)
    edges = [(a, a + 1) for a in range(100, 140)] + [(rnd.randrange(60), rnd.randrange(60)) for _ in range(40)] + [(7, 7)]
    up = {n: n for e in edges for n in e}

    def find(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    got = components(spark.createDataFrame(edges, "a long, b long"), "test").collect()
    touched = {n for a, b in edges if a != b for n in (a, b)}
    assert sorted((r.node, r.component) for r in got) == sorted((n, find(n)) for n in touched)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_passages(spark, seed):
    rows = corpus(seed)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in remove_repeated_passages(frame(spark, rows)).collect()}
    assert got == passage_truth(rows)


def test_passages_in_small_shards(spark, monkeypatch):
    rnd = random.Random(4)
    passage = sentence(rnd, 20)
    rows = [(i, f"{sentence(rnd, 15)} {passage} {sentence(rnd, 15)}") for i in rnd.sample(range(500), 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(substring_dedup, "SHARD", 4)
    got = remove_repeated_passages(docs, with_text=True).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == passage_truth(rows)
    assert all(sha(r.kept_text) == r.kept_sha256 for r in got)


def test_passages_with_null_and_repeated_ids(spark):
    text = " ".join(f"w{i}" for i in range(20))
    found = remove_repeated_passages(frame(spark, [(3, text), (3, text), (None, text), (9, text), (1, None)])).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed) for r in found) == [
        ("1", 0, 0), ("3", 20, 0), ("3", 20, 0), ("9", 20, 20), ("None", 20, 0),
    ]


def test_automaton_knows_the_first_holder():
    rnd = random.Random(1)
    texts = [[rnd.randrange(3) for _ in range(rnd.randrange(1, 30))] for _ in range(12)]
    automaton = SuffixAutomaton()
    for number, text in enumerate(texts):
        automaton.add(text, number)
    holds = lambda text, part: any(text[i : i + len(part)] == part for i in range(len(text)))
    for query in [*texts, [rnd.randrange(3) for _ in range(50)]]:
        expected = []
        for end in range(4, len(query) + 1):
            holders = [n for n, t in enumerate(texts) if holds(t, query[end - 4 : end])]
            if holders:
                expected.append((end, holders[0]))
        assert list(automaton.matches(query, 4)) == expected


def test_nothing(spark):
    docs = frame(spark, [(1, "a")]).limit(0)
    assert exact_duplicates(docs).count() == 0
    assert jaccard_components(docs).count() == 0
    assert remove_repeated_passages(docs).count() == 0


def test_long_sets_are_candidates_by_their_wide_bitmap():
    rnd = random.Random(5)
    words = lambda: [f"w{rnd.randrange(10**6)}" for _ in range(1500)]
    near = words()
    texts = [" ".join(t) for t in (near, words(), near[:1400] + words()[:60], words())]
    batch = pa.RecordBatch.from_pydict({"id": [1, 2, 3, 4], "text": texts})
    rows = pa.Table.from_batches([next(ngram_join._signed(5, [])(iter([batch])))])
    entries = pa.table(
        {
            "token": [7] * 4, "i": [0] * 4, "j": [0] * 4, "gid": rows["id"], "n": rows["n"],
            "all_ones": rows["bits"], "any_ones": rows["bits"], "wide": rows["wide"],
        }
    )
    found = pa.Table.from_batches(list(ngram_join._candidates(80, 100)(iter(entries.combine_chunks().to_batches()))))
    assert found.to_pylist() == [{"a": 3, "b": 1}]


def test_clusters_of_unique_ids_take_their_words_from_the_join(spark, monkeypatch):
    rows = [(1, "a b c d e f g"), (2, "A b c d  e f g"), (3, "x"), (4, None)]
    monkeypatch.setattr(packing, "measured", None)
    found = packing.clustered(frame(spark, rows)).collect()
    assert sorted((r.id, r.source, r.words, r.cluster) for r in found if r.words) == [
        (1, "src1", 7, 1), (2, "src2", 7, 1), (3, "src0", 1, 3)
    ]
    assert [(r.id, r.source, r.words, r.cluster) for r in found if not r.words] == [(4, "src1", 0, None)]
