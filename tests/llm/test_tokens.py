"""Token files and alignment of tokenizers against the libraries on whole texts."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from corpus import corpus, frame, sentence
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from bequest.llm import token_files, tokens
from bequest.llm.alignment import Csr, Tokenizers, alignment, group_links, overlap_links, product
from bequest.llm.queries import QUERIES
from bequest.llm.token_files import EliasFano, TokenFile, read_document, read_token_files, token_ids, write_token_files

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")

ODD = [
    "Don't STOP_it 12345 3rd ½ ²x can't've 'RE",
    "<|endoftext|> a<|startoftext|>b <|ENDOFTEXT|>",
    "Straße ΣΑΣ İstanbul ŉ é ́x ﬁ  nbsp wide \x1cfs\x85nel",
    "日本語 テキスト 👩‍👩‍👧 \U0001f600️ ​zero ﻿bom",
    "a\x00b \x7f\x01 ÀÉÎÕÜ àéîõü ÿŸ Łódź ǅ ß",
    "x" * 5000 + " " + "é" * 700,
    "tab\tsep\r\nline\x0bvt\x0cff   three",
]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 1 << 40), max_size=700).map(sorted), st.booleans())
def test_lists_by_select_and_whole(numbers, close):
    numbers = [n % 3000 for n in numbers] if close else numbers
    data = b"xyz" + EliasFano.of(np.sort(np.array(numbers, np.int64))).to_bytes() + b"!"
    found, end = EliasFano.read(memoryview(data), 3)
    assert end == len(data) - 1 and len(found) == len(numbers)
    assert found.all().tolist() == sorted(numbers)
    assert [found[i] for i in range(len(numbers))] == sorted(numbers)


def test_lists_are_small():
    bounds = np.cumsum(np.random.default_rng(3).integers(1, 1200, 50_000))
    bits = 8 * len(EliasFano.of(bounds).to_bytes()) / len(bounds)
    assert bits < 2 + np.log2(bounds[-1] / len(bounds)) + 0.2


def token_truth(rows):
    tokenizer = Tokenizer.from_file(WORD_BPE)
    ids = [(i, tokenizer.encode(t or "", add_special_tokens=False).ids + [2]) for i, t in rows]
    out, start = {}, 0
    for i, found in sorted(ids):
        out[i] = (start, len(found), zlib.crc32(np.array(found, "<u4").tobytes()))
        start += len(found)
    return out


@pytest.fixture
def shares():
    def small(docs, folder):
        write_token_files(docs, WORD_BPE, 2, folder, file_ids=900, file_docs=40)

    return small


def test_files_of_a_corpus(spark, tmp_path, shares):
    rows = corpus(4) + [(100_000 + i, t) for i, t in enumerate(ODD)]
    shares(frame(spark, rows), str(tmp_path / "t"))
    read = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in read_token_files(spark, str(tmp_path / "t")).collect()}
    truth = token_truth(rows)
    assert read == truth
    assert token_files.token_index(spark, str(tmp_path / "t")).count() > 5
    tokenizer = Tokenizer.from_file(WORD_BPE)
    texts, order = dict(rows), sorted(truth)
    for place in (0, 7, len(order) - 1):
        one, ids = read_document(spark, str(tmp_path / "t"), place)
        assert one == order[place]
        assert ids.tolist() == tokenizer.encode(texts[one] or "", add_special_tokens=False).ids + [2]
    with pytest.raises(IndexError):
        read_document(spark, str(tmp_path / "t"), len(order))


def test_null_and_repeated_ids(spark, tmp_path, shares):
    rnd = random.Random(5)
    rows = [(rnd.choice([None, 7, -3, i]), sentence(rnd, rnd.randrange(40))) for i in range(300)]
    shares(frame(spark, rows), str(tmp_path / "t"))
    read = read_token_files(spark, str(tmp_path / "t")).orderBy("start").collect()
    assert [r.doc_id for r in read] == sorted((i for i, _ in rows), key=lambda i: (i is None, i or 0))
    begins = np.cumsum([0] + [r.n_tokens for r in read])
    assert [r.start for r in read] == begins[:-1].tolist()
    tokenizer = Tokenizer.from_file(WORD_BPE)
    crc = lambda t: zlib.crc32(np.array(tokenizer.encode(t, add_special_tokens=False).ids + [2], "<u4").tobytes())
    assert sorted((r.doc_id or 0, r.ids_crc32) for r in read) == sorted((i or 0, crc(t)) for i, t in rows)


def test_no_documents(spark, tmp_path, shares):
    shares(frame(spark, [(1, "x")]).limit(0), str(tmp_path / "t"))
    assert read_token_files(spark, str(tmp_path / "t")).count() == 0


def test_wide_ids_take_four_bytes():
    data = TokenFile.packed(1, 2, [5, 9, None], np.array([2, 0, 1]), np.array([70_000, 1, 3], "<u4"))
    file = TokenFile.read(data + b"\n")
    assert [file.doc_id(i) for i in range(3)] == [5, 9, None]
    assert [file.document(i).tolist() for i in range(3)] == [[70_000, 1], [], [3]]


def test_other_tokenizers_encode_whole_texts(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = list(enumerate(ODD))
    found = {r.doc_id: np.frombuffer(r.tokens, "<u2").tolist() for r in token_ids(frame(spark, rows), path, 9).collect()}
    tokenizer = Tokenizer.from_file(path)
    assert found == {i: tokenizer.encode(t, add_special_tokens=False).ids + [9] for i, t in rows}


def test_a_row_repeated_without_end(spark, tmp_path, shares):
    rows = [(5, "same words again")] * 400 + [(i, f"word {i}") for i in range(100)]
    shares(frame(spark, rows), str(tmp_path / "t"))
    read = read_token_files(spark, str(tmp_path / "t")).orderBy("start").collect()
    assert [r.doc_id for r in read] == sorted(i for i, _ in rows)
    parts = token_files.token_index(spark, str(tmp_path / "t")).groupBy("part").sum("n_docs").collect()
    assert max(r[1] for r in parts) < 250


BYTE_BPE, PIECES = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
STRANGE = ODD + [
    "  two  spaces\n\n lines \n end  ",
    " ",
    "\n",
    "\nfirst",
    "a\u2581b is lost",
    "\u2581",
    "x\u00a0 y\u00a0z\t q \t\n r\u3000 s\x1c t\x85 u\ufeff v\u200b w",
    "it's 'llama'll we'd 12 345.67 a_b __c",
    "<s> </s><unk> <0x0A> <|endoftext|>",
    "日本 語\n日本語 \U0001f469\u200d\U0001f467 x",
]


@pytest.fixture(scope="module")
def known():
    return Tokenizers(BYTE_BPE, PIECES)


def whole(text, known):
    """Ids of both tokenizers by their libraries on the whole text."""
    tokenizer = Tokenizer.from_file(BYTE_BPE)
    tokenizer.encode_special_tokens = True
    a = tokenizer.encode(" " + text, add_special_tokens=False).ids
    b = known.model.encode(text, num_threads=1)
    lost = not text or any(
        b"".join(v[i] for i in ids) != (" " + text).encode() for v, ids in ((known.a_bytes, a), (known.b_bytes, b))
    )
    return ([], []) if lost else (a, b)


def spans(ids, vocabulary):
    ends = np.cumsum([len(vocabulary[i]) for i in ids]).tolist()
    return list(zip([0] + ends, ends))


def alignment_truth(rows, known):
    tokens = [(i, *whole(t or "", known)) for i, t in rows]
    linked = []
    for _, a, b in tokens:
        ends = {e: n for n, (_, e) in enumerate(spans(b, known.b_bytes))}
        linked.append([(n, ends[e]) for n, (_, e) in enumerate(spans(a, known.a_bytes)) if e in ends])
    counts = Counter((a[x], b[y]) for (_, a, b), links in zip(tokens, linked) for x, y in links)
    highest = defaultdict(int)
    for (_, b), n in counts.items():
        highest[b] = max(highest[b], n)
    out = []
    for (i, a, b), links in zip(tokens, linked):
        groups, x0, y0 = [], 0, 0
        for x, y in links:
            groups.append(",".join(map(str, a[x0 : x + 1])) + "|" + ",".join(map(str, b[y0 : y + 1])))
            x0, y0 = x + 1, y + 1
        seen = [counts[a[x], b[y]] for x, y in links]
        best = sum(n == highest[b[y]] for n, (_, y) in zip(seen, links))
        sha = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        out.append((i, len(a), len(b), len(groups), len(links), best, sum(seen), sha))
    return sorted(out, key=str)


def test_alignment(spark, known):
    rows = corpus(6) + [(100_000 + i, t) for i, t in enumerate(STRANGE)] + [(None, "no id"), (7, "twice"), (7, "twice")]
    found = alignment(frame(spark, rows), BYTE_BPE, PIECES)
    assert sorted((tuple(r) for r in found.collect()), key=str) == alignment_truth(rows, known)
    assert alignment(frame(spark, [(1, "x")]).limit(0), BYTE_BPE, PIECES).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("aB é\n \t'.1_\u00a0\u2581\u3000\u200b\x1c漢\U0001f600s"), max_size=40))
def test_units_are_encoded_as_in_the_text(known, text):
    import pyarrow as pa

    from bequest.llm.alignment import _tokens

    ((_, a, n_a, b, n_b),) = _tokens(pa.array(["x", text, "y z"]), known)
    one, two = whole(text, known)
    assert a[n_a[0] : n_a[0] + n_a[1]].tolist() == one
    assert b[n_b[0] : n_b[0] + n_b[1]].tolist() == two


def test_links(spark, known):
    rows = [(1, "straße naïvely\n tokenized — 日本語"), (2, None), (3, "unbelievable"), (None, "a b")]
    docs = frame(spark, rows)
    overlaps, shared = set(), set()
    for i, t in rows:
        a, b = whole(t or "", known)
        group = lambda end, cuts: sum(c < end for c in cuts)
        one, two = spans(a, known.a_bytes), spans(b, known.b_bytes)
        cuts = {e for _, e in one} & {e for _, e in two}
        for x, (s, e) in enumerate(one):
            for y, (u, v) in enumerate(two):
                both = min(e, v) - max(s, u)
                if both > 0:
                    overlaps.add((i, x, y, a[x], b[y], both, e == v))
                if group(e, cuts) == group(v, cuts):
                    shared.add((i, x, y, a[x], b[y], None, e == v))
    assert {tuple(r) for r in overlap_links(docs, BYTE_BPE, PIECES).collect()} == overlaps
    assert {tuple(r) for r in group_links(docs, BYTE_BPE, PIECES).collect()} == shared


@pytest.mark.parametrize("seed", range(5))
def test_product_of_sparse_matrices(seed, monkeypatch):
    monkeypatch.setattr("bequest.llm.alignment.BLOCK", 7)
    rnd = np.random.default_rng(seed)
    dense = [rnd.integers(0, 3, shape) * (rnd.random(shape) < 0.4) for shape in ((9, 12), (12, 8))]
    sparse = []
    for m in dense:
        row, column = np.nonzero(m)
        indptr = np.r_[0, np.cumsum(np.bincount(row, minlength=len(m)))]
        sparse.append(Csr(indptr, column, m[row, column], m.shape[1]))
    got = np.zeros((9, 8), np.int64)
    row, column, value = product(*sparse)
    assert len(set(zip(row.tolist(), column.tolist()))) == len(row)
    got[row, column] = value
    assert (got == dense[0] @ dense[1]).all()
    back = sparse[0].transposed()
    assert (back.rows() == np.repeat(np.arange(12), np.diff(back.indptr))).all()
    flipped = np.zeros((12, 9), np.int64)
    flipped[back.rows(), back.indices] = back.values
    assert (flipped == dense[0].T).all()


def test_every_linked_pair_is_among_those_that_can_end_together(known):
    pairs, width = set(known.pairs().tolist()), len(known.b_bytes)
    assert len(pairs) < 1_000_000
    rnd = random.Random(2)
    for _ in range(40):
        a, b = whole(sentence(rnd, 30) + rnd.choice(STRANGE), known)
        ends = {e: i for i, (_, e) in zip(b, spans(b, known.b_bytes))}
        assert all(i * width + ends[e] in pairs for i, (_, e) in zip(a, spans(a, known.a_bytes)) if e in ends)


def test_queries_over_the_generated_documents(spark, known):
    folder = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    files = QUERIES["op11_token_files"](spark, folder).collect()
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in files} == token_truth(rows)
    found = QUERIES["op12_tokenizer_alignment"](spark, folder)
    assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted((tuple(r) for r in found.collect()), key=str) == alignment_truth(rows, known)


def test_pieces_of_many_words_are_told_apart_once(monkeypatch):
    words = "Abc abc, ABC. d'abc été Été ß 日本 a<b x9 abc".split()
    tokenizer, encoder, _ = tokens._opened(WORD_BPE)
    encoder._forget()
    lengths, ids = encoder("".join(f"{w}\n" for w in words))
    truth = [tokenizer.encode(w, add_special_tokens=False).ids for w in words]
    assert lengths.tolist() == [len(t) for t in truth] and ids.tolist() == [i for t in truth for i in t]
    assert set(encoder.known) == {"\n", "abc", ",", ".", "d", "'", "été", "x", "9", "ß"}
    monkeypatch.setattr(tokens, "LISTED", 4)
    assert encoder("".join(f"{w}\n" for w in words))[1].tolist() == ids.tolist()
