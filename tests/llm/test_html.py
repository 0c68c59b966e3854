import itertools
import math
import random

from pyspark.sql import functions as F

from verilane.llm import html_text as ht
from verilane.llm import layouts
from verilane.llm.dom import parse


def test_messages_give_the_marginals_of_enumeration():
    rng = random.Random(1)
    model = ht.TreeModel()
    model.pairs = {k: [rng.uniform(-2, 2) for _ in range(3)] for k in model.pairs}
    nodes = parse("<body><div><p>a</p><nav>b<ul><li>c</li></ul></nav></div><article><h1>d</h1></article></body>")
    own = [rng.uniform(-2, 2) for _ in nodes]
    place = {id(n): k for k, n in enumerate(nodes)}
    weight = {}
    for labels in itertools.product((0, 1), repeat=len(nodes)):
        total = sum(o for o, y in zip(own, labels, strict=True) if y)
        for k, n in enumerate(nodes[1:], 1):
            state = 2 * labels[place[id(n.parent)]] + labels[k]
            total += model.pairs[ht.kind(n.tag)][state - 1] if state else 0.0
        weight[labels] = math.exp(total)
    belief = model.marginals(nodes, own)
    for k in range(len(nodes)):
        one = sum(w for y, w in weight.items() if y[k])
        assert abs(belief[k] - math.log(one / (sum(weight.values()) - one))) < 1e-9


def test_blocks_of_unseen_labelled_pages():
    model, maker = ht.trained(), layouts.Maker(777)
    right = total = 0
    for _ in range(100):
        nodes = ht.labelled(maker.page())
        belief = model.marginals(nodes, [model.own(n) for n in nodes])
        for n, b in zip(nodes, belief, strict=True):
            right += sum((b >= 0) == n.label for _ in n.blocks)
            total += len(n.blocks)
    assert right / total > 0.97


PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav><!-- ad <p>no</p> --><div class="ad">Buy &amp; save.</div>
<article><h1>The  title &amp; more</h1><p><b>First&nbsp;line<br>goes
 on 5 < 6.<p>Second &eacute;t&#233; &lt;b&gt;</p><form><label>Mail</label><input></form></article>
<div class="comments"><p>I disagree with all of this, said a reader.</p></div><footer>&copy; us</footer></body></html>"""


def test_page_by_hand(spark):
    want = "The title & more\n\nFirst line goes on 5 < 6.\n\nSecond été <b>"
    rows = [(1, "u", PAGE), (2, None, None), (3, "v", ""), (4, "w", PAGE[: PAGE.index("goes")]), (5, "x", "<p>" * 20_000), (1, "u", PAGE), (6, "y", "<body><nav><a>x</a></nav><article><h1>Cut title &am</h1><")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash")).withColumn("n_chars", F.lit(0))
    out = ht.main_text(pages).collect()
    assert len(out) == len(rows) and all(r.n_chars == len(r.text) for r in out)
    by = {r.page_id: r for r in out}
    assert by[1].text == want and by[2].text == by[3].text == by[5].text == "" and by[2].url is None
    assert by[4].text == "The title & more\n\nFirst line" and by[6].text == "Cut title &am"
    assert ht.main_text(pages.limit(0)).count() == 0


def test_reader_mends_broken_markup():
    nodes = parse("<ul><li>a<li>b<ul><li>c</ul><li>d</ul></p></div>tail<table><tr><td>x<td>y<tr><td>z</table><p>un<b>closed <i>x<p>next<a")
    assert [(n.tag, [t for _, t in n.blocks]) for n in nodes if n.blocks] == [
        ("html", ["tail"]), ("li", ["a"]), ("li", ["b"]), ("li", ["c"]), ("li", ["d"]), ("td", ["x"]), ("td", ["y"]), ("td", ["z"]), ("p", ["unclosed x"]), ("p", ["next"]),
    ]


def text_of(html):
    return ht.trained().extract(html)


def test_nothing_is_lost_to_elements_that_never_end():
    assert text_of("<article><p>before<object data='a'><p>after</article>") == "before\n\nafter"
    for name in "select object svg canvas audio video template math textarea title iframe noscript".split():
        got = text_of(f"<body><article><p>before</p><{name}><p>after one<p>after two</article></body>")
        assert got == "before\n\nafter one\n\nafter two", name
        assert text_of(f"<article><p>a</p><{name}>no</{name} ><p>b</p></article>") == "a\n\nb", name
    assert [t for n in parse("<article><p>a<svg><svg>x</svg>y</svg>b</p></article>") for _, t in n.blocks] == ["ab"]
    assert text_of("<head><article><p>no body tag, an open head</p></article>") == "no body tag, an open head"
    assert [t for n in parse("<article><p>a\0b &#0; c</p></article>") for _, t in n.blocks] == ["a\0b \ufffd c"]
    assert text_of("<article><p>kept</p><script>var x = '<!-- </p>';</script><p>too</p></article><script>open") == "kept\n\ntoo"
    assert text_of('<article><p title="a > b">x</p><p class="open>y</p><p>z</p></article>').startswith("x")


def test_cost_is_linear():
    import time

    hostile = [
        lambda n: "<div></p>" * n, lambda n: "<head><body ><script></script>" * n, lambda n: "<object>" * n, lambda n: "<table><tr><td><table>" + "</td><div><td>" * n,
        lambda n: "<a '\">x" * n, lambda n: "<!--" * n, lambda n: "<textarea>" * n, lambda n: "<svg></object>" * n, lambda n: "<p " * n, lambda n: "<li><dd>" * n, lambda n: "<a x=\"" * n + "<b>" * n,
    ]
    for k, make in enumerate(hostile):
        page = make(1_000_000 // len(make(1)))
        began = time.process_time()
        parse(page)
        assert time.process_time() - began < 8, k


#: Pages in the manner of several kinds of sites, written by hand, with their main text.
OUTSIDE = [
    ("""<html><head><title>Rain</title></head><body><div id="top-bar"><a href="/">Home</a> | <a href="/contact">Contact</a></div><div id="wrapper"><div id="sidebar"><h3>Related</h3><ul><li><a href="1">One</a></li>
     <li><a href="2">Two</a></li></ul></div><div id="content"><h2>Rain over the valley</h2><p>The valley saw three days of steady rain, and the river rose by a metre before it fell again on Monday.</p>
     <p>Farmers said that the fields had needed it, after a spring in which hardly any water had fallen.</p></div></div><div id="footer">Copyright 2020</div></body></html>""",
     "Rain over the valley\n\nThe valley saw three days of steady rain, and the river rose by a metre before it fell again on Monday.\n\nFarmers said that the fields had needed it, after a spring in which hardly any water had fallen."),
    ("""<body><header><h1>Site name</h1><nav><a href="/a">A</a><a href="/b">B</a></nav></header><main><article class="post"><h1>How to sharpen a knife</h1><div class="entry-content"><p>Begin with a coarse stone and hold the blade
     at a steady angle of some twenty degrees.</p><ol><li>Draw the blade across the stone from heel to tip.</li><li>Turn it over and do the same again.</li></ol><blockquote>A dull knife is a dangerous knife.</blockquote></div></article>
     <section class="comments"><h2>2 comments</h2><p>Thanks, this helped me a lot with my kitchen knives.</p></section></main><aside class="widget"><p>Subscribe to our newsletter</p></aside><footer><p>All rights reserved.</p></footer></body>""",
     "How to sharpen a knife\n\nBegin with a coarse stone and hold the blade at a steady angle of some twenty degrees.\n\nDraw the blade across the stone from heel to tip.\n\nTurn it over and do the same again.\n\nA dull knife is a dangerous knife."),
    ("""<body><div class="cookie-notice"><p>We use cookies to improve your experience. <button>Accept</button></p></div><div class="navbar"><ul><li><a href="/">Start</a></li></ul></div><div class="article-body"><h1>A short history of tin</h1>
     <p>Tin was traded along the coasts long before anyone wrote about it, and its sources were kept secret.</p><figure><img src="a.png"><figcaption>An ingot found off the coast.</figcaption></figure><p>Later the mines ran deep under the sea.</p></div>
     <div class="share-buttons"><a href="#">Share</a><a href="#">Post</a></div><div class="advert">Cheap flights today</div></body>""",
     "A short history of tin\n\nTin was traded along the coasts long before anyone wrote about it, and its sources were kept secret.\n\nAn ingot found off the coast.\n\nLater the mines ran deep under the sea."),
]


def test_pages_of_other_makers():
    """Recall and precision in blocks over pages that the maker of the training pages did not make."""
    hits = found = wanted = 0
    for html, text in OUTSIDE:
        got, want = set(text_of(html).split("\n\n")) - {""}, set(text.split("\n\n"))
        hits, found, wanted = hits + len(got & want), found + len(got), wanted + len(want)
    assert hits / wanted >= 0.9 and hits / found >= 0.85, (hits, found, wanted)


def test_query(spark, tmp_path):
    spark.createDataFrame([(1, "u", PAGE, 5), (None, None, None, 6)], "page_id long, url string, html string, n_chars int").write.parquet(f"{tmp_path}/pages.parquet")
    out = ht.query(spark, str(tmp_path)).collect()
    assert sorted(r.n_chars for r in out)[0] == 0 and len(out) == 2


#: Pages with short or unwrapped articles, and their main text.
BRIEF = [
    ("<article><p>Short news.</p></article>", "Short news."),
    ("<article>" + "direct text of an article that no paragraph wraps, and more of it. " * 9 + "</article>", ("direct text of an article that no paragraph wraps, and more of it. " * 9).strip()),
    ("<p>one</p><p>two</p>", "one\n\ntwo"),
    ("plain text only, no markup at all", "plain text only, no markup at all"),
    ("<body>line one<br>line two<br>line three</body>", "line one line two line three"),
    ("<div class=content>Hello world.</div>", "Hello world."),
    ("<html><head><title>T</title></head><body><main>Some text here<br>and there</main><aside>Related links</aside></body></html>", "Some text here and there"),
    ("<body><h1>Title</h1><p>Text.</p></body>", "Title\n\nText."),
    ("<body><nav><ul><li><a href='/'>Home</a></li></ul></nav><article>Just this.</article><footer>&copy; us</footer></body>", "Just this."),
]


def test_short_and_unwrapped_articles():
    assert [text_of(html) for html, _ in BRIEF] == [text for _, text in BRIEF]
