from tenure.llm import site_templates as s

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header>Site head</header><nav><ul><li><a href="/a">Home</a></li></ul></nav><div class="ad">Buy</div><div id="cookie-notice">Cookies?</div>
<article><h1>Title &amp; more</h1><p>First   <b>bold</b>
line.<br>next<p>Second &eacute;&#233;&#x1F642; &lt;tag&gt;</p><ul><li>one<li>two</ul><div class="comments"><article class="comment">Me too</article></div>
<form><input><button>Send</button></form><aside>See also</aside></article><footer>&copy; us</footer></body></html>"""


def test_article_without_its_surroundings():
    assert s.main_text(PAGE) == "Title & more\n\nFirst bold line. next\n\nSecond éé🙂 <tag>\n\none\n\ntwo"


def test_nothing_is_capped_or_lost(long_text):
    page = f"<nav>menu</nav><article><p>{long_text}</p>{'<div>' * 3000}deep{'</div>' * 3000}</article>"
    assert s.main_text(page) == f"{long_text}\n\ndeep"


def test_broken_markup():
    assert s.main_text(None) == s.main_text("") == s.main_text("<article></article>") == ""
    assert s.main_text("just text & more") == "just text & more"
    assert s.main_text("<article><p>a<b>b<p>c</i>d</article>tail") == "ab\n\ncd"
    assert s.main_text("<article>x < y and a<3 <p class='q>r'>z</p><!-- no --><![CDATA[raw &amp;]]>") == "x < y and a<3\n\nz\n\nraw &amp;"
    assert s.main_text("<article><p>one<script>if (a<b) {'</p>'}</script>two</p></article><script>open") == "onetwo"
    assert s.main_text("<ARTICLE><P>Up</P></ARTICLE>") == "Up"


def test_wrappers_with_layout_names_are_kept():
    assert s.main_text('<div class="page with-sidebar"><div class="sidebar">x</div><article>kept</article></div>') == "kept"
    assert s.main_text("<main><nav>x</nav><article>a</article><section>rest</section></main>") == "a\n\nrest"
    assert s.main_text('<main><article>a</article><section class="related">x</section><div class="ads">x</div></main>') == "a"
    assert s.main_text("<main><p>a</p><aside>x</aside></main>") == "a"


def test_a_word_in_a_name_does_not_drop_the_page():
    assert s.main_text('<article class="hentry comments-enabled"><p>kept</p></article>') == "kept"
    assert s.main_text('<div class="page no-ads"><div class="ad">x</div><article>kept</article></div>') == "kept"
    assert s.main_text('<main id="ad-free"><p>kept</p></main>') == "kept"
    assert s.main_text('<article class="sponsored"><p>kept</p><article class="comment">x</article><div class="ad-slot-2">x</div></article>') == "kept"
    assert s.main_text('<article>kept</article><div class="sidebar"><ol class="comment-list"><li><article class="comment">x</article></ol></div>') == "kept"
    assert s.main_text('<section id="comments"><article>x</article></section><p>kept</p>') == "kept"


def test_main_parts_are_kept_whole():
    page = "<main><h1>Head</h1><p>Lead</p><nav>x</nav><div><article>card</article><p>between</p></div><ul><li>one</ul></main><article>beside</article><p>x</p>"
    assert s.main_text(page) == "Head\n\nLead\n\ncard\n\nbetween\n\none\n\nbeside"
    assert s.main_text("<main><section><h2>Part</h2><article>a</article></section></main>") == "Part\n\na"
    assert s.main_text("<main><section>a</section><section>b</section></main>") == "a\n\nb"


def test_sections_beside_an_article_stay():
    page = "<main><h1>T</h1><p>Lead</p><section><p>Intro section text</p></section><article><p>Body</p></article></main>"
    assert s.main_text(page) == "T\n\nLead\n\nIntro section text\n\nBody"


def test_class_names_inside_an_article_decide_nothing():
    page = '<article><header><h1>Head</h1><p>By X</p></header><p class="notice">n</p><p class="related">r</p><p class="header">h</p>'
    page += '<div class="search-results"><p>found</p></div><p class="ad">kept</p><header>site</header><div class="comments"><p>x</p></div></article>'
    assert s.main_text(page) == "Head\n\nBy X\n\nn\n\nr\n\nh\n\nfound\n\nkept"
    assert s.main_text('<main><p class="notice">kept</p><div class="sidebar">x</div></main>') == "kept"


def test_time_grows_with_the_length():
    import time

    broken = ["<p ", "<p a=\"", "</x>", "<b>", "<article>", "<li>", "<p><b>", "<!-- ", "<![CDATA[", "<div class='", "<svg/", "<header><h1>", "<div class=footer>"]
    for part in broken:
        for page in (part * (400_000 // len(part)), "<b>" * 50_000 + part * (100_000 // len(part))):
            began = time.process_time()
            s.main_text(page)
            assert time.process_time() - began < 15, part
    assert s.main_text("<article><p>a</p>tail <p b") == "a\n\ntail <p b"
    assert s.main_text('<article><p title="x>a</p><p>b</p></article><p>') == "a\n\nb"


def test_formulas_and_fallback_text_are_kept():
    assert s.main_text("<article><p>If <math><mi>x</mi><mo>=</mo><mn>1</mn></math> then</p></article>") == "If x=1 then"
    assert s.main_text("<article><math><mspace/><mi>x</mi><p>rest</p></article>") == "x\n\nrest"
    assert s.main_text('<article><object data="a.pdf"><p>Read it here</p></object></article>') == "Read it here"
    assert s.main_text("<article><object><p>rest</p></article><article>more</article>") == "rest\n\nmore"


def test_an_unclosed_drawing_ends_with_its_parent():
    assert s.main_text('<article><p>a</p><div><svg><path d="M0"/><text>x</text></div><p>b</p><span><svg><g></svg></span>c</article>') == "a\n\nb\n\nc"


def pages(host, n, body):
    return [f"<body><div><p>Shared intro of {host}</p><span>Contact us</span></div><div>{body(i)}</div><section><p>About {host}</p></section></body>" for i in range(n)]


def test_recurring_subtrees_of_a_host_go(frame):
    rows = [(i, f"http://a.com/{i}", h) for i, h in enumerate(pages("a", 12, lambda i: f"<p>Text {i}</p>" + ("<p>Said twice</p>" if i < 2 else "")))]
    rows += [(100 + i, f"http://b.com/{i}", h) for i, h in enumerate(pages("b", 3, lambda i: f"<p>Other {i}</p>"))]
    rows += [(200 + i, f"http://c.com/{i}", "<article><p>Same article</p></article>") for i in range(10)]
    rows += [(300, None, None), (301, "no scheme", "<p>x</p>"), (302, "http://a.com/x", ""), (0, *rows[0][1:])]
    out = s.extract(frame("page_id long, url string, html string", rows))
    text = {r["page_id"]: r["main_text"] for r in out.collect()}
    assert text[0] == "Text 0\n\nSaid twice" and text[5] == "Text 5"
    assert text[100] == "Shared intro of b\n\nContact us\n\nOther 0\n\nAbout b"
    assert {text[200 + i] for i in range(10)} == {"Same article"}
    assert text[300] == text[302] == "" and text[301] == "x"
    assert out.count() == len(rows)


def test_boxes_that_most_articles_have_go(frame):
    box = "<div><p>Read our newsletter</p></div>"
    rows = [(i, f"http://a.com/{i}", f"<article><p>Text {i}</p><p>Shared line</p>{box}<div>own {i}</div></article>") for i in range(8)]
    rows += [(100 + i, f"http://b.com/{i}", f"<article><p>Copy</p>{box}</article>") for i in range(8)]
    text = {r["page_id"]: r["main_text"] for r in s.extract(frame("page_id long, url string, html string", rows)).collect()}
    assert text[3] == "Text 3\n\nShared line\n\nown 3"
    assert text[100] == "Copy\n\nRead our newsletter"


def test_every_article_text_of_the_tables(spark):
    """Against a plain reading of the one page form that the tables have."""
    import html
    import re

    df = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    for r in s.extract(df).collect():
        article = re.search(r"(?s)<article>(.*?)</article>", r["html"] or "")
        blocks = re.split(r"</?(?:p|h1)>", article[1]) if article else []
        blocks = [" ".join(html.unescape(re.sub(r"</?b>", "", b).replace("<br>", " ")).split()) for b in blocks]
        assert r["main_text"] == "\n\n".join(b for b in blocks if b)
        assert r["n_chars"] == len(r["main_text"])


def test_empty_table_and_clashing_columns(frame):
    assert s.extract(frame("page_id long, url string, html string", [])).count() == 0
    out = s.extract(frame("page_id long, N_chars int, html string, url string, host string, n int", [(1, 2, "<p>x</p>", "http://a/b", "h", 3)] * 2))
    assert out.columns == ["page_id", "html", "url", "host", "n", "main_text", "n_chars"]
    assert [(r["host"], r["n"], r["n_chars"]) for r in out.collect()] == [("h", 3, 1)] * 2
