import html
import re

from orrery.llm import html_text
from orrery.llm.html_text import main_text


def test_pages_by_their_article(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    source = {r.page_id: r.html for r in pages.collect()}
    rows = html_text.extract(pages).collect()
    assert len(rows) == len(source)
    for r in rows:
        inner = re.search(r"<article>(.*?)</article>", source[r.page_id], re.S).group(1).replace("<br>", " ")
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
        assert r.text == "\n\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


def test_what_goes_and_what_stays():
    page = """<html><head><title>T</title><style>p{}</style></head><body><header>Site</header><nav><a href=x>Menu</a></nav><div id="content">
    <h1>Head &amp; line</h1><p>First <b>bold</b><br>part &#233;&lt;x&gt;.<p class="notice">cookies!</p><ul><li>one<li>two</ul><script>var p="<p>no</p>"</script>
    <table><tr><td>cell</td><td>cell 2</td></tr></table><form><label>Name</label><input></form><div class="ad">buy</div><p>Last.</p></div>
    <aside>side</aside><div class="comments"><p>nice post</p></div><footer>foot</footer></body></html>"""
    assert main_text(page) == "Head & line\n\nFirst bold part é<x>.\n\none\n\ntwo\n\ncell\n\ncell 2\n\nLast."


def test_article_inside_noise_names_and_comments_in_it():
    page = "<div>before</div><article class='post comments-open'><p>a</p><section class=comments><p>reader</p></section><p>b</p></article><div>after</div>"
    assert main_text(page) == "a\n\nb"


def test_stretches():
    assert html_text.stretches([0, 0, 5, 0, 3, 0, 0, 0, 0, 7], window=3) == [(2, 7), (9, 10)]
    assert html_text.stretches([], window=3) == [] and html_text.stretches([0, 0], window=3) == []


LONG = "This paragraph is long enough to be told from menus and notices by its length alone, as the text of an article is. "


def test_pages_without_a_marked_article_by_their_distribution():
    menu, foot = "<div><p>Home</p><p>News</p><p>Contact us</p></div>", "<div><p>Imprint</p><p>Example Ltd 2020</p></div>"
    inner = f"<div><h1>Title</h1><p>by A. Writer</p><p>{LONG}</p><p>Short one.</p><ul><li>one</li><li>two</li></ul><p>{LONG}</p><table><tr><td>cell</td></tr></table><p>End.</p></div>"
    long = LONG.strip()
    assert main_text(f"<body>{menu}{inner}{foot}</body>") == "\n\n".join(["Title", "by A. Writer", long, "Short one.", "one", "two", long, "cell", "End."])
    # A menu in the same block, text that is mostly links, and a page without long text, which keeps all.
    assert main_text(f"<body><p>Home</p><p>News</p><p>Sport</p><p>Today</p><p>{LONG}</p></body>") == f"Sport\n\nToday\n\n{long}"
    links = "<div>" + " | ".join(f"<a href=x>{LONG}</a>" for _ in range(3)) + "</div>"
    assert main_text(f"<body>{links}<div><p>{LONG}</p></div>{links}</body>") == long
    assert main_text(f"<body>{menu}</body>") == "Home\n\nNews\n\nContact us"


def test_class_words_drop_no_article_and_no_main_text():
    for name in ("class='page-with-sidebar'", "class='layout no-sidebar'", "id='social-science'", "class='sidebar'", "class='x ads-enabled'", "class='with-comments'"):
        assert main_text(f"<div>x</div><div {name}><article><p>a</p></article></div>") == "a", name
        assert main_text(f"<div {name}><div class=ads>buy</div><p>{LONG}</p><p>{LONG}</p></div>") == f"{LONG.strip()}\n\n{LONG.strip()}", name
    readers = f"<div class=comments><article><p>{LONG}</p></article></div>"
    assert main_text(f"<div class=sidebar><article><p>a</p></article>{readers}</div>") == "a"
    assert main_text(f"<article><p>a</p></article>{readers}<div class='share-wide'><article>b</article></div>") == "a\n\nb"
    assert main_text("<p>a <span class=ad>buy</span> b</p>") == "a\n\nb"


def test_broken_markup():
    assert main_text("<p>a<p>b</div></span>c") == "a\n\nbc" and main_text("a < b and <i>c") == "a < b and c"
    assert main_text("<script>never closed <p>x") == "" and main_text("<!-- open <p>x") == ""
    assert main_text(None) == main_text("") == main_text("<nav>x</nav>") == ""
    deep = "<div>" * 3000 + "text" + "</div>" * 3000
    assert main_text(deep) == "text" and len(main_text("<p>" + "word " * 200_000)) == 999_999


def test_edge_cases(spark):
    rows = [(1, "u", "<p>x</p>", 1), (1, "u", "<p>x</p>", 1), (2, None, None, None), (None, "v", "<p>y", 2), (3, "w", "", 3)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    out = sorted(((r.page_id, r.url, r.text, r.n_chars) for r in html_text.extract(df).collect()), key=str)
    assert out == sorted([(1, "u", "x", 1), (1, "u", "x", 1), (2, None, "", 0), (None, "v", "y", 1), (3, "w", "", 0)], key=str)
    assert html_text.extract(df.limit(0)).count() == 0


def test_attributes_as_html_reads_them():
    assert main_text("<p>one <a title=it's>two</a> three</p><p>it's four</p><p>five</p>") == "one two three\n\nit's four\n\nfive"
    assert main_text("<p>a <a title='x > y' data-id=\"ad\" id = main>b</a></p><p>c") == "a b\n\nc"
    assert main_text("<article><p>a</p><div class='legal'>b</div><div class=related-work>c</div></article><div class=legal>d</div>") == "a\n\nb\n\nc"


def test_windows_decide_on_pages_without_a_marked_article():
    """Brute force: windows summed one by one; and with every line taken for a surge the result is another."""
    sizes = [3, 0, 90, 0, 0, 40, 50, 0, 0, 0, 5]
    sums = [sum(sizes[max(0, i - 2) : i + 1]) for i in range(len(sizes))]
    above = [i for i, x in enumerate(sums) if x > 86]
    found = html_text.stretches(sizes, 3, 86)
    assert [i for a, b in found for i in range(a, b)] == above
    page = f"<body><div><p>Home</p></div><div><p>{LONG}</p></div><div><p>Imprint</p></div></body>"
    kept = main_text(page)
    every = "\n\n".join(x.text for x in html_text.lines(page) if x.text)
    assert kept == LONG.strip() != every


def test_time_grows_with_the_page():
    import time

    for page in (lambda n: "<div>" * n + "x</div>" * n, lambda n: "<p><div>" + "<b>" * n + "<hr>" * n, lambda n: "<h1>" * n + "a<p>" * n, lambda n: "<a " * n, lambda n: "<div class=ad>" * n + "x"):
        took = []
        for n in (10_000, 80_000):
            began = time.perf_counter()
            main_text(page(n))
            took.append(time.perf_counter() - began)
        assert took[1] < 24 * took[0] + 0.2
