import html as references
import re
import tracemalloc

from actionflow.llm.html_blocks import leaf_blocks
from actionflow.llm.html_extraction import extract, labelled_blocks, labelled_pages, main_text, train, trained
from pyspark.sql import functions as F

PAGE = """<!DOCTYPE html><html><head><title>Not this</title><style>p{color:red}</style><script>var t="</p><p>no";</script></head><body>
<header class="site-header"><a href="/">Site name</a></header><nav><ul><li><a href="/x">One</a><li><a href="/y">Two</a></ul></nav>
<div class="cookie-banner"><p>We use cookies, please accept them all.</p><button>OK</button></div><!-- <p>hidden</p> -->
<article><h1>The   title &amp; more</h1><p>First <b>para&shy;graph</b>,\n with a <a href="#">link</a> &lt;kept&gt;.<br><p>Second&nbsp;one 5 < 6
<div class="ad">Buy this thing now.</div><blockquote>Quoted words</blockquote><ul><li>item a<li>item b</ul><form><label>Name</label><input><p>Send it to us.</p></form>
<p>Last of all</p></article><aside class="sidebar"><h3>Related</h3><p>Another story you may like, with many words in it.</p></aside>
<section class="comments"><h3>Comments</h3><article class="comment"><p>I think this is a great text, thank you for it.</p></article></section>
<footer><p>&copy; 2024 The site</p></footer></body>"""

WANT = "The title & more\nFirst para\xadgraph, with a link <kept>.\nSecond one 5 < 6\nQuoted words\nitem a\nitem b\nLast of all"


def test_page():
    assert main_text(trained(), PAGE) == WANT


def test_leaf_blocks():
    text = lambda h: [b.text for b in leaf_blocks(h)]
    assert text("") == text("<p></p> \n <!-- x") == text("<script>a<p>b") == []
    assert text("a<p>b<p>c</div>d") == ["a", "b", "cd"]
    assert text('<p title="a > b">c</p>') == ["c"]
    assert text("<p title='x>y") == ["y"] or text("<p title='x>y") == []
    assert text("1 < 2 &lt;b&gt; &#233;&bogus; <") == ["1 < 2 <b> é&bogus; <"]
    assert text("x<br>y<wbr>z<i>!</i>") == ["x yz!"]
    assert text("<ul><li>a<ul><li>b</ul><li>c</ul>") == ["a", "b", "c"]
    assert [[e.tag for e in b.path] for b in leaf_blocks("<ul><li>a<ul><li>b</ul><li>c</ul>")] == [["ul", "li"], ["ul", "li", "ul", "li"], ["ul", "li"]]
    assert len(text("<div>" * 5000 + "deep" + "<p" + " a='" * 2000)) >= 1


def test_what_is_no_markup_of_the_page_and_what_is():
    text = lambda h: [b.text for b in leaf_blocks(h)]
    assert text("<p>Energy is <math><mi>E</mi><mo>=</mo><mi>mc</mi></math> here") == ["Energy is E=mc here"]
    assert text('a<script src="x" /> var leak = 1; </script>b') == ["ab"]
    assert text("a<svg><svg><text>x</text></svg><text>leak</text></svg>b<svg width='>' />c") == ["abc"]
    assert text("a<template><template>x</template>leak</template>b") == ["ab"]
    assert text("<p>a</p><xmp><b>&amp; < x</b></xmp>c") == ["a", "<b>&amp; < x</b>", "c"]
    assert text("<object>one</object> <video>two</video> <canvas>three</canvas>") == ["one two three"]
    assert text("a<style>p{}</style><iframe><p>x</p></iframe><textarea>t<p></textarea>b<noframes>n</noframes>") == ["ab"]
    page = "<article><p>Energy is <math><mi>E</mi></math> for all of us.</p><script src='x' />var leak = 1;</script><p>More of the text comes after it.</p></article>"
    assert main_text(trained(), page) == "Energy is E for all of us.\nMore of the text comes after it."


def test_deep_pages_take_memory_by_their_size():
    for page in ("<div>x" * 100_000, "<div>x" * 50_000 + "</section>" * 50_000, "<a>" + "<div>x" * 50_000 + "</a>" * 50_000, "<ul><li>" * 50_000):
        tracemalloc.start()
        main_text(trained(), page)
        assert tracemalloc.get_traced_memory()[1] < 250 * len(page)
        tracemalloc.stop()


def test_paths_of_shared_nodes():
    a, b = leaf_blocks('<main class="Main-part"><p>one</p><div>two</div></main>')
    assert [e.tag for e in a.path] == ["main", "p"] and [e.tag for e in b.path] == ["main", "div"]
    assert a.node.parent is b.node.parent and a.path[0].words == ("main", "part")


def test_field_on_pages_it_was_not_trained_on():
    field = train(labelled_pages(250, seed=1), 150)
    held = labelled_pages(120, seed=2)
    right = sum(p == q for blocks, labels in held for p, q in zip(field.decode(blocks), labels, strict=True))
    assert right / sum(len(y) for _, y in held) > 0.97


def test_viterbi_is_the_best_of_all_labellings():
    from itertools import product

    field = trained()
    for blocks, _ in labelled_pages(15, seed=3):
        blocks = blocks[:9]
        s = field.scores(blocks)
        value = lambda ys: field.first[ys[0]] + sum(x * y for x, y in zip(s, ys, strict=True)) + sum(field.pair[a, b] for a, b in zip(ys, ys[1:], strict=False))  # noqa: B023, E731
        best = max(product((0, 1), repeat=len(blocks)), key=value)
        assert [int(y) for y in field.decode(blocks)] == list(best)


def test_frames(spark):
    rows = [(1, PAGE, "x"), (2, None, "x"), (3, "", "x"), (3, "", "x"), (4, "<article><p>" + "word " * 200_000, "x"), (5, "<nav>a</nav>", "x")]
    df = spark.createDataFrame(rows, "page_id int, html string, path string")
    got = [(r.page_id, r.text) for r in extract(df).orderBy("page_id").collect()]
    assert got == [(1, WANT), (2, ""), (3, ""), (3, ""), (4, ("word " * 200_000).strip()), (5, "")]
    assert extract(df.limit(0)).collect() == []
    blocks = df.where("page_id = 1").select(F.explode(labelled_blocks(F.col("html"))).alias("b")).select("b.*").collect()
    assert [b.text for b in blocks if b.content] == WANT.split("\n")


def test_articles_of_the_pages_table(spark):
    for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect():
        parts = re.split(r"</?(?:p|h1)>", re.search(r"<article>(.*)</article>", r.html, re.S)[1])
        want = [" ".join(references.unescape(re.sub(r"<[^>]*>", " " if "<br" in p else "", p)).split()) for p in parts]
        assert main_text(trained(), r.html) == "\n".join(p for p in want if p)
