"""Quality rules, HTML extraction and the pipeline."""

import itertools
import random
import time
from html.parser import HTMLParser

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from chronolith.llm import registry
from chronolith.llm.html_cut import block_gains, extract_main_text, label_blocks, main_text, minimum_cut, page_blocks
from chronolith.llm.quality import LineField, base_counts, kept_documents, line_parts, quality_rules, repeated_words


def plain_repeats(words):
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = set()
    for i, g in enumerate(grams):
        if grams.count(g) > 1:
            covered |= {i, i + 1, i + 2}
    return len(covered)


@given(st.lists(st.sampled_from(["a", "b", "c"]), max_size=30))
def test_repeated_words(words):
    assert repeated_words([w.encode() for w in words]) == plain_repeats(words)


def test_base_counts():
    text = "Ünï code\nline $$#\n\n \nline $$#\nline $$# \nx".encode()
    lines, words = line_parts(text)
    assert base_counts(text, lines, words) == (9, 3 + 4 + 3 * (4 + 3) + 1, 9, 1, plain_repeats("Ünï code line $$# line $$# line $$# x".split()))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(-4, 4), st.integers(-4, 4)), min_size=1, max_size=8), st.lists(st.integers(-3, 3), min_size=4, max_size=4))
def test_viterbi_is_the_best_labelling(scores, moves):
    field = LineField(np.zeros((1, 2)), np.array(moves, float).reshape(2, 2))
    total = lambda y: sum(s[k] for s, k in zip(scores, y)) + sum(field.transition[a, b] for a, b in zip(y, y[1:]))
    best = max(map(total, itertools.product((0, 1), repeat=len(scores))))
    assert total(field.decode(np.array(scores, float))) == pytest.approx(best)


_random = random.Random(2)
_word = lambda: "".join(_random.choice("abcdefghij") for _ in range(_random.randint(3, 7)))
GOOD = "\n".join(" ".join(_word() for _ in range(12)).capitalize() + "." for _ in range(8))
JUNK = "\n".join(f"| {_word()}$$$ | {_word()}### | {_word()}%%% | {_word()} |" for _ in range(20))


def test_quality_rules(spark):
    texts = [GOOD] * 6 + [JUNK] * 6 + [None, "", "too short", "again and again " * 40, GOOD + "\n" + " ".join(_word() + str(i) for i in range(5000))]
    docs = spark.createDataFrame([(i, t, True, "s") for i, t in enumerate(texts)], "doc_id long, text string, kept boolean, source string")
    labels = spark.createDataFrame([(i, int(i < 6), None) for i in range(12)] + [(None, 1, 1), (3, None, 0)], "doc_id long, quality int, toxic int")
    rows = {r.doc_id: r for r in quality_rules(docs, labels).collect()}
    assert [rows[i].kept for i in range(12)] == [True] * 6 + [False] * 6
    assert all(rows[i].base_failed and not rows[i].kept for i in (12, 13, 14, 15))
    assert rows[12].n_words == 0 and rows[16].n_words == 5000 + len(GOOD.split()) and not rows[16].base_failed
    kept = kept_documents(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in rows.items() if r.kept}
    assert quality_rules(docs.limit(0), labels).count() == 0
    assert quality_rules(docs, labels.limit(0)).where("kept AND doc_id < 6").count() == 6


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    found = quality_rules(docs, labels.where("doc_id % 2 = 0")).join(labels.where("doc_id % 2 = 1"), "doc_id").where("NOT base_failed")
    right = found.where("kept = (quality = 1)").count()
    assert right >= 0.95 * found.count()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(-5, 5), min_size=1, max_size=7), st.lists(st.tuples(st.integers(0, 6), st.integers(0, 6), st.integers(0, 4)), max_size=10))
def test_minimum_cut_is_minimal(gains, edges):
    links: dict = {}
    for a, b, c in edges:
        if a < b < len(gains):
            links[a, b] = links.get((a, b), 0) + c
    cost = lambda y: sum(abs(g) for g, k in zip(gains, y) if k != (g >= 0) and g) + sum(c for (a, b), c in links.items() if y[a] != y[b])
    best = min(map(cost, itertools.product((True, False), repeat=len(gains))))
    assert cost(minimum_cut(list(map(float, gains)), links)) == best


PAGE = """<!DOCTYPE html><html><head><title>T &amp; x</title><style>p{}</style><script>var t="</p>";</script></head><body class="has-sidebar">
<header><a href="/">Site</a></header><nav><ul><li><a href="/a">A</a></li><li><a href="/b">B</a></li></ul></nav><!-- ad <p>no</p> -->
<div class="cookie-notice">We use cookies.</div><div id="sidebar">Side text here, with a sentence.</div>
<article><header><h1>Title &amp; more</h1></header><p>First   <b>bold</b> para&shy;graph<br>with break. <p>Second &lt;tag&gt; &#233;&nbsp;x.</p>
<div class="share">Share this</div><ul><li>one<li>two</ul><form><input value="q"><label>Mail</label></form>
<section id="comments"><article class="comment"><p>Nice read, thank you very much for it.</p></article></section></article>
<aside>Related things</aside><div class="ad">Buy now.</div><footer>&copy; site &middot; legal words.</footer></body></html>"""


def test_main_text():
    assert main_text(PAGE) == "Title & more\nFirst bold para­graph with break.\nSecond <tag> é x.\none\ntwo"
    assert main_text("") == "" and main_text("<p>") == "" and main_text("a < b") == "a < b"
    assert [b.text for b in page_blocks("<div>one<div>two</div>three</div>")] == ["one", "two", "three"]


def test_extraction_edge_cases(spark):
    rows = [(1, "u", PAGE, "x"), (2, None, None, "x"), (3, "u", "", "x"), (3, "u", "", "x"), (None, "u", "<article><p>Text.", "x"), (4, "u", "<main>" + "<p>A sentence of words.</p>" * 3000, "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    found = extract_main_text(pages).collect()
    assert len(found) == 6 and all(r.n_chars == len(r.text) for r in found)
    by_id = {r.page_id: r.text for r in found}
    assert by_id[2] == by_id[3] == "" and by_id[None] == "Text." and by_id[4].count("\n") == 2999
    assert extract_main_text(pages.limit(0)).count() == 0


class PlainArticle(HTMLParser):
    """Another way to the main text of well-formed pages: the words in article, a block a paragraph or heading."""

    def __init__(self):
        super().__init__()
        self.inside, self.blocks = False, [""]

    def handle_starttag(self, tag, attrs):
        self.inside |= tag == "article"
        if tag in ("article", "h1", "p"):
            self.blocks.append("")
        elif tag == "br":
            self.handle_data(" ")

    def handle_endtag(self, tag):
        self.inside &= tag != "article"
        if tag in ("h1", "p"):
            self.blocks.append("")

    def handle_data(self, data):
        if self.inside:
            self.blocks[-1] += data


def test_extraction_of_the_given_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    for r in extract_main_text(pages).join(pages.select("page_id", "html"), "page_id").collect():
        plain = PlainArticle()
        plain.feed(r.html)
        assert r.text == "\n".join(" ".join(b.split()) for b in plain.blocks if b.strip())


LONG = "<p>A long paragraph of words that says something about the matter in hand.</p>"
LINK = "<p><a href=x>See the list</a></p>"


def test_the_cut_changes_labels():
    """What a block says by itself is overruled by its neighbours, and only where they are close enough."""
    changed = 0
    for page, kept in ((f"<div>{LONG}{LINK}{LONG}</div>", 3), (f"<div>{LONG}{LONG}</div><div>{LINK * 5}</div>", 2), (f"<article>{LONG}<p class='search'><a href=x>Find it</a></p>{LONG}</article>", 3)):
        blocks = page_blocks(page)
        labels = label_blocks(blocks)
        assert sum(labels) == kept
        changed += sum((g >= 0) != y for g, y in zip(block_gains(blocks), labels))
    assert changed == 2


def test_names_are_judged_whole():
    for name in ("social-history", "main-comment-text", "responsive-share-index story"):
        assert main_text(f"<article>{LONG}<div class='{name}'>{LONG}</div></article>").count("\n") == 1
    for name in ("share-buttons", "post-comments", "comment-list", "comment-body", "related-posts", "ad-300x250", "newsletter-signup"):
        assert main_text(f"<article>{LONG}<div class='{name}'>{LONG}</div></article>").count("\n") == 0


def test_broken_markup_loses_no_text():
    assert main_text(f'<div>{LONG}<a href="foo>link</a> and the rest of it.</div>').endswith("\nlink and the rest of it.")
    assert main_text("<article><p>First.</p><button>Save<p>Second.</p>").split("\n") == ["First.", "Save", "Second."]
    assert main_text("<main><p>One.<svg><p>Two.</main>") == "One.\nTwo."


@pytest.mark.parametrize("page", ["<div>" * 10_000 + "<p>text</p>", ("<div class='ad'>Buy now.</div>" + LONG) * 5000, "<button>a<p>b" * 10_000, "<a href=\"x'y>b</a>'" * 10_000, "<svg>" * 10_000, LONG * 10_000])
def test_very_long_pages_take_seconds(page):
    begin = time.process_time()
    main_text(page)
    assert time.process_time() - begin < 8


def test_pipeline(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows, columns = docs, docs.columns
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        rows = stage(spark, rows, "/root/testdata/sf0.001")
        if name != "packing":
            assert rows.columns == columns and rows.schema.fieldNames() == docs.schema.fieldNames()
            rows = rows.checkpoint()
            counts.append(rows.count())
    assert counts[0] > counts[1] > counts[2] == counts[3] > counts[4] > 0
    final = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert sorted(map(tuple, final.collect())) == sorted(map(tuple, rows.collect()))


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 14))


def test_class_words_are_weighed():
    text = "<p>A first sentence of the text, which is long enough.</p><p>And a second one follows it here.</p>"
    whole = main_text(f"<article>{text}</article>")
    assert whole.count("\n") == 1
    for around in ("article class='post has-sidebar comments-open'", "div class='layout with-sidebar'", "div class='layout layout--with-sidebar'", "main class='content ads-enabled'", "div class='sidebar'><div class='post-content'"):
        assert main_text(f"<{around}>{text}") == whole
    for around in ("div class='sidebar'", "div class='post-comments'", "article class='comment'", "div id='main-nav'"):
        assert main_text(f"<{around}>{text}") == ""


def test_unclosed_raw_elements_end_at_their_tag():
    for tag in ("button", "select", "object", "video", "audio", "svg", "iframe"):
        assert main_text(f"<article><p>Before it.</p><{tag}><p>After it.</p></article>") == "Before it.\nAfter it."
    assert main_text("<article><p>Before it.</p><script>var x = 1;</article>") == "Before it."
