"""Recurring lines, packing, pages, and the pipeline."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from corpus import corpus, frame, sentence
from test_copies import near_truth

from pyspark.sql import functions as F

import corpus_pipeline
from bequest.llm import line_dedup, packing, toxicity
from bequest.llm.html_text import rendered, visible_text
from bequest.llm.line_dedup import drop_recurring_lines
from bequest.llm.packing import Bins, best_fit_packing, clustered, measured
from bequest.llm.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


def masked(line):
    return tuple("0" if re.search("[0-9]", w) else w for w in re.split(r"[\x20\x09-\x0D]+", line) if w)


def lines_truth(rows, least_docs, least_tokens, similar, depth=3):
    """The tree over all lines at once, in plain Python."""
    docs = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(masked(line)) >= least_tokens:
                docs[masked(line)].add(i)
    reached = defaultdict(set)
    for line, ids in docs.items():
        reached[len(line), line[:depth]] |= ids
    leaves = defaultdict(list)
    for line, ids in docs.items():
        if len(reached[len(line), line[:depth]]) >= least_docs:
            leaves[len(line), line[:depth]].append((len(ids), line))
    return docs, leaves


def test_lines_with_variable_fields(spark):
    rnd = random.Random(1)
    rows = []
    for i in range(60):
        lines = [sentence(rnd, 9).replace("1", "") for _ in range(3)]
        lines = [re.sub("[0-9]", "q", x) for x in lines]
        if i % 2:
            lines.append(f"page was visited on 2024-01-{i:02d} by {rnd.choice(['ann', 'bob', 'cem'])} from {i}.0.0.{i}")
        if i % 3 == 0:
            lines.insert(0, "all rights reserved by the owner")
        if i < 9:
            lines.append("only nine documents have this")
        lines.append("ok")
        rows.append((i, "\n".join(lines)))
    rows += [(100, None), (101, ""), (None, "all rights reserved by the owner"), (0, rows[0][1])]
    found = drop_recurring_lines(frame(spark, rows), with_text=True).collect()
    got = defaultdict(list)
    for r in found:
        got[r.doc_id].append(r)
    assert len(found) == len(rows)
    for i, text in rows:
        kept = [x for x in (text or "").split("\n") if i is None or not x.startswith(("page was", "all rights"))]
        for r in got[i]:
            assert r.kept_text == "\n".join(kept)
            assert (r.n_lines, r.n_dropped) == (len((text or "").split("\n")), r.n_lines - len(kept))
            assert r.kept_sha256 == hashlib.sha256(r.kept_text.encode()).hexdigest()


@pytest.mark.parametrize("wide", [4096, 0])
def test_lines_against_whole_tree(spark, monkeypatch, wide):
    """Templates of exact lines: with similar = 1 only lines equal but for digits are one."""
    monkeypatch.setattr(line_dedup, "WIDE", wide)
    rows = [(i, "\n".join(re.findall(r"\S+ \S+ \S+ ?\S*", t or ""))) for i, t in corpus(4)]
    docs, leaves = lines_truth(rows, 4, 3, 1.0)
    drop = {line for line, ids in docs.items() if len(ids) >= 4}
    assert drop <= {line for group in leaves.values() for _, line in group}
    got = drop_recurring_lines(frame(spark, rows), least_docs=4, similar=1.0).collect()
    expected = {i: sum(masked(x) in drop for x in t.split("\n")) for i, t in rows}
    assert {r.doc_id: r.n_dropped for r in got} == expected and sum(expected.values()) > 10


def test_leaf_generalises():
    import numpy as np

    leaf = line_dedup.Leaf()
    rows = [[1, 2, 3, 4, 5], [1, 2, 3, 9, 5], [1, 2, 8, 9, 7], [1, 2, 3, 6, 5]]
    assert [leaf.add(np.array(r), 0.6) for r in rows] == [0, 0, 1, 0]
    assert leaf.templates[0].tolist() == [1, 2, 3, 0, 5]


def test_a_leaf_of_any_size_has_one_depth(spark):
    rnd = random.Random(8)
    name = lambda: "".join(rnd.choice("abcdefghij") for _ in range(9))
    rows = [(i, f"written by the user {name()} for all who read it") for i in range(4300)]
    rows.append((5000, "written by the user of another line altogether but once"))
    got = {r.doc_id: r.n_dropped for r in drop_recurring_lines(frame(spark, rows)).collect()}
    assert got == {i: int(i < 5000) for i, _ in rows}


@pytest.mark.parametrize("similar", [0.3, 0.6, 0.8, 1.0])
def test_wide_leaf_joins_as_a_small_one(similar):
    import numpy as np

    rnd = np.random.default_rng(5)
    rows = np.minimum(rnd.zipf(1.3, (3000, 9)), 500) - 1
    rows[:, :3] = [7, 0, 9]
    small, wide = line_dedup.Leaf(10**9), line_dedup.Leaf(20)
    assert [small.add(r, similar) for r in rows] == [wide.add(r, similar) for r in rows]
    assert (small.templates[: small.size] == wide.templates[: wide.size]).all() and (similar < 0.5 or wide.size > 20)


def test_bins_against_a_plain_search():
    rnd = random.Random(3)
    bins, plain = Bins(100), []
    for _ in range(800):
        length, source, cluster = rnd.randint(1, 100), 1 << rnd.randrange(6), (1 << rnd.randrange(40)) * (rnd.random() < 0.7)
        fits = [(room, n) for n, (room, s, c) in enumerate(plain) if room >= length and not (s & source or c & cluster) and room]
        expected = min(fits, default=(100, len(plain)))[1]
        assert bins.put(length, source, cluster) == expected
        if expected == len(plain):
            plain.append((100, 0, 0))
        room, s, c = plain[expected]
        plain[expected] = (room - length, s | source, c | cluster)


@pytest.mark.parametrize("shard", [8192, 30])
def test_packing(spark, monkeypatch, shard):
    monkeypatch.setattr(packing, "SHARD", shard)
    rows = [*corpus(5), (None, "a b c"), (10**6, "x " * 350), (10**6, "x " * 350)]
    docs = frame(spark, rows)
    pieces = best_fit_packing(measured(docs), capacity=100).collect()
    words = lambda t: len([w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w])
    total = Counter()
    for p in pieces:
        total[p.id] += p.n_words
    expected = Counter()
    for i, t in rows:
        expected[i] += words(t)
    assert total == expected
    source, cluster = dict((r.id, r.source) for r in measured(docs).collect()), {r.id: r.cluster for r in measured(docs).collect()}
    by_bin = defaultdict(list)
    for p in pieces:
        assert (p.bin_id is None) == (p.n_words == 0)
        if p.n_words:
            by_bin[p.bin_id].append(p)
    for held in by_bin.values():
        assert sum(p.n_words for p in held) <= 100
        assert len({source[p.id] for p in held}) == len({cluster[p.id] for p in held}) == len(held)
        assert sorted(p.place for p in held) == list(range(len(held)))
    equal = {r.id: r.cluster for r in measured(frame(spark, [(1, "A  b"), (2, "a\nB"), (3, "b a")])).collect()}
    assert equal[1] == equal[2] != equal[3]
    assert best_fit_packing(measured(docs.limit(0))).count() == 0


def test_near_copies_share_no_sequence(spark, tmp_path):
    words = [f"w{i}" for i in range(200)]
    texts = [" ".join(words), " ".join([*words[:-1], "x"]), " ".join(["y", *words[1:-1], "x"]), "quite another text of its own", "a b", "A  b"]
    rows = [(i % 5 or None, t, f"source {i}") for i, t in enumerate(texts)]  # ids are null or repeat
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    packed = QUERIES["op6_best_fit_packing"](spark, str(tmp_path)).collect()
    assert len(packed) == len(rows)
    long = [r.bin_id for r in packed if r.n_words == 200]
    short = [r.bin_id for r in packed if r.n_words == 2]
    assert len(set(long)) == 3 and len(set(short)) == 2 and len({r.bin_id for r in packed}) == 3


def test_clusters_of_near_copies(spark):
    """Clusters are the components of a comparison of all pairs; copies and null or repeated ids make no difference."""
    rows = corpus(11, 90)
    rows += [(None, t) for _, t in rows[:30]] + [(rows[0][0], t) for _, t in rows[30:50]]
    numbered = list(enumerate(t for _, t in rows))
    truth = {i: component for i, (_, component) in near_truth(numbered, 5, 80, 100).items()}
    docs = spark.createDataFrame([(f"s{i}", t, 1, "x") for i, t in numbered], "source string, text string, words int, cluster string")
    found = clustered(docs.withColumn("doc_id", F.lit(None).cast("long"))).collect()
    of = {r.source: r.cluster for r in found}
    groups = defaultdict(set)
    for i, t in numbered:
        # Texts without words have none.
        groups[truth[i] if (t or "").strip() else "none"].add(of[f"s{i}"])
    assert all(len(clusters) == 1 for clusters in groups.values())
    assert len({c for clusters in groups.values() for c in clusters}) == len(groups)
    by_id = clustered(docs.withColumn("doc_id", F.substring("source", 2, 9).cast("long"))).collect()
    one, other = ({r.source: r.cluster for r in part} for part in (found, by_id))
    assert len(set(one.values())) == len(set(other.values())) == len({(one[s], other[s]) for s in one})
    assert clustered(frame(spark, rows).limit(0)).count() == 0
    same = frame(spark, [(i, "one two three four five six seven") for i in range(2000)])
    assert clustered(same).select("cluster").distinct().count() == 1


PAGES = [
    ("<title>t</title><p>One<p>Two<br>three", "One\n\nTwo\nthree"),
    ("<ul><li>a<li>b<ol start=3><li>c<li value=9>d<li>e</ol></ul>after", "- a\n- b\n  3. c\n  9. d\n  10. e\n\nafter"),
    ("<table><tr><th>Name<th>No<tr><td>Al<td>5<tr><td colspan=2>both of them</table>", "Name  No\nAl    5\nboth of them"),
    ("<table><tr><td>a<br>b<td>c</table>", "a  c\nb"),
    ("x<script>var a='<p>no</p>'</script>y<style>p{}</style>z<!-- no -->", "xyz"),
    ("<div hidden>no</div><div style='color:red; DISPLAY : none'>no<p>no</div><span>yes</span>", "yes"),
    ("<pre>\n a  b\n\tc</pre>d", " a  b\n        c\n\nd"),
    ("&lt;b&gt; &amp;amp; &eacute; a&nbsp;b", "<b> &amp; é a\xa0b"),
    ("<div>a<div>b</div>c</div>", "a\nb\nc"),
    ("<p>a <b> b</b> <i>c </i>d", "a b c d"),
    ("</p></div>x<b>y</i></b><img alt=pic>z<input type=hidden value=no><input value=go>", "xypicz go"),
    ("<a title=\"x > y\">k</a><p", "k<p"),
    ("a < b > c", "a < b > c"),
    ("", ""),
    ("<select><option>one<option>two</select>", "one\ntwo"),
    ("<dl><dt>t<dd>d<dt>u</dl><blockquote>q<p>r</blockquote>", "t\n    d\nu\n\n    q\n\n    r"),
]


@pytest.mark.parametrize("page,text", PAGES)
def test_rendered(page, text):
    assert rendered(page) == text


SPANNED = [
    ("so <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>no</annotation></math> holds", "so x=2 holds"),
    ("<svg><title>no</title><desc>no</desc><defs><text>no</text></defs>no<path d='M0'/><g><text>one</text><text>two <tspan>b</tspan></text></g>no</svg>c", "one two b c"),
    ("a<svg><defs/><text/><rect><foreignObject><p>html</p></foreignObject></svg>b", "a\n\nhtml\n\nb"),
    ("<svg><g>no<p>shown", "shown"),
    ("<table><tr><td rowspan=2>a<td>bb<td>c<tr><td>d<td>e<tr><td>f<td>g<td>h</table>", "a  bb  c\n   d   e\nf  g   h"),
    ("<table><tr><td>a<td rowspan=3 colspan=2>b<td>c<tr><td>d<td>e<tr><td>f<td>g</table>", "a  b   c\nd      e\nf      g"),
    ("<table><tbody><tr><td rowspan=0>a<td>b<tr><td>c<tbody><tr><td>d<td>e</table>", "a  b\n   c\nd  e"),
]


@pytest.mark.parametrize("page,text", SPANNED)
def test_formulas_drawings_and_spanning_rows(page, text):
    assert rendered(page) == text


VISIBLE = [
    ("<div style='visibility:hidden'>a<span style='visibility:visible'>b</span>c</div>d", "b\nd"),
    ("<div style='display:none;display:block'>a</div>b", "a\nb"),
    ("<p style='display:block;display:none'>a</p>b", "b"),
    ("<p style='display:none !important;display:block'>a</p>b", "b"),
    ("<p style='display:none;display:nonsense'>a</p><p style='nodisplay:none; /* display:none */'>c", "c"),
    ("<p hidden style='display:block'>a</p><p hidden style='color:red'>b</p>", "a"),
    ("<details><summary>s<b>t</b></summary>no<summary>no</summary></details><details open><summary>s</summary>yes</details>", "st\n\ns\nyes"),
    ("<ruby>k<rp>(</rp><rt>r</rt><rp>)</rp></ruby>", "kr"),
    ("<ul style='visibility:collapse'><li>a<li style='visibility:inherit'>b<li style='visibility:initial'>c</ul>", "- c"),
    ("<dialog>a</dialog><dialog open>b</dialog><dialog style='display:block'>c</dialog>", "b\nc"),
    ("<img style='visibility:hidden' alt=a><img alt=b><input style='visibility:hidden' value=c>", "b"),
]


@pytest.mark.parametrize("page,text", VISIBLE)
def test_visibility(page, text):
    assert re.sub("\n+", "\n", rendered(page)) == re.sub("\n+", "\n", text)


@pytest.mark.parametrize("seed", range(25))
def test_visible_words_against_a_plain_walk(seed):
    """Random trees: the words a walk from the top sees, in order, are the words of the rendered page."""
    rnd = random.Random(seed)
    styles = ["", "", "display:none", "visibility:hidden", "visibility:visible", "color:red;display:inline", "display:none;display:block", "visibility:hidden;visibility:inherit"]
    number = iter(range(10_000))

    def tree(depth):
        """(markup, words seen if the surroundings are visible, or if they are not)"""
        page, seen, unseen = "", [], []
        for _ in range(rnd.randrange(1, 5)):
            if depth == 0 or rnd.random() < 0.4:
                word = f"w{next(number)}"
                page += f" {word} "
                seen.append(word)
                continue
            inner, visible, invisible = tree(depth - 1)
            name, style = rnd.choice(["div", "span", "p", "section", "b"]), rnd.choice(styles)
            if name == "p":
                name = "div"
            attribute = rnd.choice(["", "", "", " hidden"])
            page += f"<{name}{attribute} style='{style}'>{inner}</{name}>"
            if style == "display:none" or (attribute and "display" not in style):
                continue
            if style == "visibility:hidden":
                visible = invisible
            elif style == "visibility:visible":
                invisible = visible
            seen += visible
            unseen += invisible
        return page, seen, unseen

    page, seen, _ = tree(5)
    assert rendered(page).split() == seen


def test_pages(spark):
    rows = [(1, "<p>a"), (None, None), (3, ""), (1, "<p>a"), (4, "<div>" * 20000 + "deep" + "</table>" * 3000), (5, "<table>" * 300 + "x")]
    pages = spark.createDataFrame([(i, h, "clash", "u") for i, h in rows], "page_id long, html string, text string, url string")
    got = visible_text(pages).collect()
    assert sorted((str(r.page_id), r.text) for r in got) == sorted(
        [("1", "a"), ("1", "a"), ("None", ""), ("3", ""), ("4", "deep"), ("5", "x")]
    )
    assert visible_text(pages.limit(0)).count() == 0


def test_pipeline_against_brute_force(spark):
    raw = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = {r.doc_id: r for r in raw.collect()}
    model = toxicity.fit(raw.select("doc_id", "text"), spark.read.parquet(f"{FOLDER}/labels.parquet"))
    calm = {r.doc_id for r in toxicity.scored(raw, model, corpus_pipeline.TOXIC).collect() if not r.predicted}
    first = {}
    for i in sorted(calm):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", rows[i].text), i)
    near = near_truth([(i, rows[i].text) for i in first.values()], 5, 80, 100)
    left = [i for i, (_, c) in near.items() if c == i]
    items = [" ".join(r.text.lower().split()) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    clean = {i for i in left if not any(t in " ".join(rows[i].text.lower().split()) for t in items)}
    packed = corpus_pipeline.run(spark, FOLDER).collect()
    assert {r.doc_id for r in packed} == clean
    total = Counter()
    for r in packed:
        total[r.doc_id] += r.n_words
    assert all(total[i] == len(rows[i].text.split()) for i in clean)


def test_stages_keep_the_columns(spark):
    docs = frame(spark, [*corpus(6), (None, "loose words here"), (None, None)])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, FOLDER).columns == docs.columns, name
        assert stage(spark, docs.limit(0), FOLDER).count() == 0, name
    docs = corpus_pipeline.STAGES[1][1](spark, docs, FOLDER)
    assert docs.where("doc_id is null").count() == 1  # the null text equals the empty one of a smaller id


def test_every_operator_is_a_query():
    numbers = sorted(int(re.match(r"op(\d+)_", name)[1]) for name in QUERIES)
    assert numbers == list(range(1, 11)) and set(ORACLES) <= set(QUERIES)
