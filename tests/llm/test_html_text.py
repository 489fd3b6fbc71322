from pyspark.sql import functions as F

from quantloom.llm.html_text import Page, extract, host_paths, path_key

HTML = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header class="site-header"><a href="/">Home</a> A site header that is long enough to look like text</header>
<nav><ul><li><a href="/x">x</a></li></ul></nav><div class="cookie-notice">We use cookies and so on and on</div><div class="ad">Buy this now, and that too</div>
<div class="wrap"><div class="post post-17"><h1>Title &amp; more</h1><p><b>First   para<br><p>Second&nbsp;para
 with <a href="/l">a link</a>.</p><ul><li>one</li><li>two</li></ul></div>
<aside>Side words</aside><div id="comments"><p>I am a reader and I comment at great length on this, on and on and on and on and on and on and on and on</p></div>
<form><p>Subscribe</p></form></div><footer>&copy; someone</footer>"""


def test_article_without_the_rest():
    page = Page(HTML)
    assert page.best().path().endswith("div.post.post-")
    assert page.extract(None) == "Title & more\nFirst para\nSecond para with a link.\none\ntwo"


def test_path_and_empty_pages():
    page = Page(HTML)
    assert page.extract("/nowhere") == page.extract(page.best().path())
    assert Page("").extract(None) == ""
    assert Page("plain text &lt;b&gt;").extract("/html/body") == "plain text <b>"
    assert Page("<p>unclosed <b>and").extract(None) == "unclosed and"


def test_article_with_a_lead_and_one_long_container():
    for tag in ("section", "ul", "table", "blockquote"):
        long = f"<{tag}>{'<p>' + 'words of the body ' * 60 + '</p>'}</{tag}>"
        source = f"<body><nav><a href=/>home</a></nav><div class=page><article><h1>T</h1><p>{'a lead ' * 14}</p>{long}</article><div class=more><a href=/1>another story</a></div></div></body>"
        page = Page(source)
        assert page.best().tag == "article"
        assert page.extract(None).split("\n")[:2] == ["T", ("a lead " * 14).strip()] and "another" not in page.extract(None)
        page = Page(source.replace("article>", "div>"))
        assert page.extract(page.best().path()).startswith("T\na lead")


def test_names_on_blocks():
    source = '<article><p class="cookie-notice">We use cookies</p><p>Real text here.</p><li class=advert>Buy now</li><p class="advert">Buy this</p><p class="lead">And more.</p><h2 id="related">Other</h2></article>'
    assert Page(source).extract(None) == "Real text here.\nAnd more."
    assert Page("<p class=notice>a<b>b</b></p>c").extract(None) == "c"


def test_names_on_outer_containers_and_inline_elements():
    story = "<article><h1>T</h1><p>Some words of a story.</p>%s</article>"
    for outer in ('class="page no-sidebar"', 'class="site menu-closed"', 'id="post-with-comments"', 'class="layout sidebar"', 'id="banner"', "class=with-footer"):
        assert Page(f"<body><div {outer}>{story % ''}<div class=ad>Buy</div></div></body>").extract(None) == "T\nSome words of a story.", outer
    plain = f"<div class='widget content'><h1>T</h1><p>{'many words of a story ' * 9}</p></div><div class=menu>a b</div>"
    assert Page(f"<body>{plain}</body>").extract(None).startswith("T\nmany words")
    assert Page(f"<body><div class=comments><p>{'a reader says much ' * 90}</p></div>{story % ''}</body>").extract(None) == "T\nSome words of a story."
    body = {
        '<section class="related-work"><h2>Related work</h2><p>Others did it.</p></section>': "\nRelated work\nOthers did it.",
        '<section class="related-posts"><p>Another story</p></section>': "",
        '<ul><li>one</li><li class="advert"><p>Buy now</p><p>and here</p></li><li>two</li></ul>': "\none\ntwo",
        '<ul><li class="advert"><div>Buy <b>now</b></div> more</li></ul><p>end</p>': "\nend",
        '<p>a <span class="advert">Buy <span>now</span> it</span> b</p>': "\na b",
        "<p>a</p><amp-ad width=1>Buy</amp-ad><p>b</p>": "\na\nb",
        "<video controls><p>Your browser is old</p></video><p>b</p>": "\nb",
        '<p class="notice">Look</p><p>b <a class="share-link" href="/s">Share</a></p>': "\nb",
        '<p>a <span class="advert">open <p>b</p>': "\na\nb",
        '<p class="advert">x<div>y</div>': "\ny",
        '<div class="searching-for-gold"><p>gold</p></div><span class="commentary">c</span>': "\ngold\nc",
        '<nav><main>m</main></nav><header><h2>inner</h2></header>': "\ninner",
    }
    for part, text in body.items():
        assert Page(f"<body>{story % part}</body>").extract(None) == "T\nSome words of a story." + text, part


def test_deep_pages_take_linear_memory():
    page = Page("<div class=x>" * 20000 + "<p>deep text</p>" + "</div>" * 20000 + "<p>after</p>")
    assert page.extract(None) == "deep text" and len(page.nodes) == 20001
    path = page.nodes[-1].path()
    assert path.count("/div.x") == 20000 and path_key(path) == page.nodes[-1].key
    assert len({n.key for n in page.nodes}) == 20001
    long = Page("<article>" + "<p>some words of a very long page</p>" * 60000 + "</article>")
    assert long.extract(None).count("\n") == 59999


def _pages():
    own = '<body><article class="post">%s</article><div class="shop"><p>%s</p></div></body>'
    rows = [(i, f"https://A.example.com/{i}", own % (f"<p>story {i} {'word ' * 30}</p>", "offer " * 5), "h") for i in range(6)]
    rows += [(6, "http://a.example.com:80/x", own % ("<p>short story</p>", "a longer text of the shop " * 20), "h")]  # its own best is the shop, its host's the post
    rows += [(7, "http://b.example.com/", own % ("<p>one post</p>", "a longer text of the shop"), "h"), (8, "http://b.example.com/", '<body><article class="zoo"><p>the zoo of b, much longer</p></article></body>', "h")]
    rows += [(9, None, own % ("", "lonely"), "h"), (10, "http://[bad", own % ("", "broken"), "h"), (11, "http://c.example.com", None, "h"), (12, "http://c.example.com", "", "h"), (None, "http://c.example.com", "plain &amp; simple", "h")]
    return rows


def test_votes_of_hosts(spark):
    pages = spark.createDataFrame(_pages(), "page_id long, url string, html string, host string").withColumns({"path": F.lit(1), "text": F.lit("t"), "salt": F.lit(2)})
    paths = {r["host"]: r["path"] for r in host_paths(pages.repartition(5)).collect()}
    assert paths["a.example.com"] == "/body/article.post"
    assert paths["b.example.com"] == "/body/article.zoo"  # one vote each: the greatest path
    for limit in (1 << 20, 0):  # broadcast, and dealt with a salt
        got = {r["page_id"]: r for r in extract(pages.repartition(3), limit).collect()}
        assert len(got) == 14
        assert got[3]["text"] == "story 3 " + "word " * 29 + "word" and got[6]["text"] == "short story"
        assert got[7]["text"] == "one post\na longer text of the shop" and got[8]["text"] == "the zoo of b, much longer"
        assert [got[k]["text"] for k in (9, 10, 11, 12, None)] == ["lonely", "broken", "", "", "plain & simple"]
        assert all(r["n_chars"] == len(r["text"]) for r in got.values()) and got[0]["url"] == "https://A.example.com/0"
    assert extract(pages.union(pages)).count() == 28
    assert extract(pages.where("false")).count() == 0
