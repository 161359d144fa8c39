import time

import pytest

from turnstile.llm.pages import Page, host_of, main_texts


def blocks(text):
    return Page(text).main()[0]


@pytest.mark.parametrize(("page", "expected"), [
    ("", []),
    ("plain  text", ["plain text"]),
    ("<p>a &amp; b&nbsp;&#x41;<br>c</p>", ["a & b A c"]),
    ("<body><nav>menu</nav><header>top</header><p>x<b>y<p>z</b>w<footer>f</footer>", ["xy", "zw"]),
    ("<article><h1>T</h1><p>one</p><ul><li>a<li>b</ul><aside>s</aside></article><p>out</p>",
     ["T", "one", "a", "b"]),
    ("<main><div class='post'>in</div><div class=\"ad\">buy</div></main><div>out</div>", ["in"]),
    ("<article><p>text</p><section id=comments><p>first!</p></section></article>", ["text"]),
    ("<article><p>t</p><div class='cookie-notice'>c</div><form><p>f</p></form></article>", ["t"]),
    ("<p>a<script>if (1 < 2) '<p>'</script>b</p><style>p{}</style><!-- <p>c</p> -->", ["ab"]),
    ("<p title=\"a>b\">q</p><p hidden>h</p><p style='display: none'>n</p>", ["q"]),
    ("<table><tr><td>a<td>b<tr><td>c</table>", ["a", "b", "c"]),
    ("<p>1 < 2 and 3 > 2 &lt;p&gt;</p><p>unclosed <i", ["1 < 2 and 3 > 2 <p>", "unclosed <i"]),
    ("<div>a<div>b</div>c</div></div></p>d", ["a", "b", "c", "d"]),
    ("<article><header><h1>T</h1></header><p>x</p></article>", ["T", "x"]),
    ("<body class='has-sidebar'><p>kept</p><div role=navigation>n</div></body>", ["kept"]),
    ("<main><h1>Title</h1><p>Lead</p><article><p>Body</p></article><p>After</p></main>",
     ["Title", "Lead", "Body", "After"]),
    ("<main><p>long main text</p><article><p>teaser card</p></article></main>", ["long main text", "teaser card"]),
    ("<article><p>a</p></article><main><header><h1>T</h1></header>m</main>", ["T", "m"]),
    ("<form><div><h1>T</h1><p>x<label>Your name</label><button>Go</button></div></form><form>Mail<input></form>",
     ["T", "x"]),
    ("<form><form><main><p>x</p></main></form><p>y</p></form>", ["x"]),
    ("<div>a<form><p>f</p></form>b</div>", ["a", "b"]),
    ("<article><p class='share price'>a</p><p id=related-work>b</p><p class=advert>x</p><ul class=share><li>s</ul>"
     "</article>", ["a", "b"]),
    ("<p>keep <button>Subscribe</button> this <label>Your name</label> <object>o</object> end</p>", ["keep this end"]),
    ("<label>a<label>b<p>c", ["c"]),
    ("<div class=menu title=\"a<b\">Menu</div><p>t</p>", ["t"]),
    ("<div class='menu' title='a<b>c' id=x>Menu</div><p>t</p>", ["t"]),
    ("<div class=menu title=\"it\"s\">Menu</div><p>t</p>", ["t"]),
])
def test_blocks(page, expected):
    assert blocks(page) == expected


def test_hosts():
    assert host_of("https://User@Blog.Example.com:8080/a?b#c") == "blog.example.com"
    assert host_of("//x.org") == "x.org" and host_of(None) == host_of("nonsense") == ""


def test_depth_and_length_are_no_limit():
    assert blocks("<div>" * 20000 + "x") == ["x"]
    assert blocks("<p>" + "word " * 200000) == [("word " * 200000).strip()]


def pages(spark, rows):
    full = [(i, url, text, "extra", 3) for i, (url, text) in enumerate(rows)]
    return spark.createDataFrame(full, "page_id long, url string, html string, text string, host int")


def texts(spark, rows, **settings):
    return [r.text for r in sorted(main_texts(pages(spark, rows), **settings).collect(), key=lambda r: r.page_id)]


def test_site_templates_go(spark):
    """Blocks without telling names are removed where their host repeats them, and only there."""
    template = "<div><div>Our site</div><p>Follow us</p></div>"
    rows = [("http://a.com/%d" % i, f"<body>{template}<div><p>text {i}</p></div></body>") for i in range(12)]
    rows += [("http://b.com/%d" % i, f"<body>{template}<p>other {i}</p></body>") for i in range(3)]
    got = texts(spark, rows)
    assert got[:12] == [f"text {i}" for i in range(12)]
    assert got[12:] == [f"Our site\nFollow us\nother {i}" for i in range(3)]


def test_copies_do_not_make_their_text_a_template(spark):
    rows = [("http://a.com/copy", "<div>bar</div><div><p>one page</p><p>stored often</p></div>")] * 8
    rows += [("http://a.com/copy", "<article><div><p>an article</p></div></article>")] * 8
    rows += [(f"http://a.com/{i}", f"<div>bar</div><p>text {i}</p>") for i in range(6)]
    got = texts(spark, rows)
    assert got == ["one page\nstored often"] * 8 + ["an article"] * 8 + [f"text {i}" for i in range(6)]


def test_templates_of_a_small_share_go(spark):
    """The menu of a language on a tenth of the pages, and one on few of very many pages."""
    rows = [("http://a.com/", f"<div>menu</div><p>{i}</p>" if i % 10 else f"<div>Karte</div><p>{i}</p>")
            for i in range(100)]
    rows += [("http://b.com/", f"<div>rare</div><p>{i}</p>" if i < 50 else f"<p>{i}</p>") for i in range(1200)]
    got = texts(spark, rows)
    assert got == [str(i) for i in range(100)] + [str(i) for i in range(1200)]


def test_passages_of_articles_stay(spark):
    rows = [("http://a.com/", f"<article><p>quoted everywhere</p><p>own {i}</p></article>") for i in range(9)]
    assert texts(spark, rows) == [f"quoted everywhere\nown {i}" for i in range(9)]


def test_one_host_with_most_pages(spark):
    rows = [("http://hot.com/", f"<div>bar</div><p>{i}</p>") for i in range(40)]
    rows += [(f"http://h{i}.com/", f"<div>bar</div><p>{i}</p>") for i in range(20)]
    got = texts(spark, rows)
    assert got[:40] == [str(i) for i in range(40)] and got[40] == "bar\n0"


def test_odd_and_empty_tables(spark):
    rows = [(None, None), ("", ""), ("http://a.com", "<p>x</p>"), ("http://a.com", "<p>x</p>")]
    assert texts(spark, rows) == ["", "", "x", "x"]
    assert main_texts(pages(spark, rows).limit(0)).count() == 0
    row = main_texts(pages(spark, [("u", "<p>\U0001F600é</p>")])).first()
    assert (row.page_id, row.url, row.n_chars) == (0, "u", 2)


@pytest.mark.parametrize(("page", "count"), [
    ("<div>t" * 40_000, 40_000), ("<blockquote>t" * 20_000, 20_000), ("<form>t" * 20_000, 0),
    ("<p>t</q></section>" * 20_000, 20_000), ("<label>t" * 20_000 + "<p>x" * 20_000, 20_000),
    ("x " + "<a title=\"<y\" " * 4_000, 1), ("<p>x</p>" + "<a \"" * 20_000, 2)])
def test_time_and_memory_follow_the_length(page, count):
    begun = time.perf_counter()
    read = Page(page)
    assert time.perf_counter() - begun < 10
    assert len(read.main()[0]) == count and len(read.spans) <= page.count("<")


def test_deep_pages_of_one_host(spark):
    deep = "".join(f"<div>level {i}" for i in range(5_000))
    pages = [(i, "http://h/", f"<body>{deep}<section>page {i}</section></body>") for i in range(6)]
    pages += [(9, "http://other/", f"<body>{deep}</body>")]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.page_id: r.text.split("\n") for r in main_texts(frame).collect()}
    assert all(got[i][-1] == f"page {i}" for i in range(6)) and len(got[9]) == 5_000
