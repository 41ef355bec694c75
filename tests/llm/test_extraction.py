import html
import re

from fourthtick.llm import extraction as ext
from fourthtick.llm.common import read_table


def text_of(page):
    return [t for _, t in ext.blocks_of(page)]


def test_blocks():
    page = (
        "<html><head><title>t</title><style>p{a:b}</style></head><body>"
        '<script>var t="</p>";x(1<2)</script><p>One <b>bold</b> &amp; two<br>three<p>Four&nbsp;&#233;'
        "<ul><li>a<li>b</ul><!-- <p>no --><div>c<span>d</span></div>tail<p cl"
    )
    assert text_of(page) == ["One bold & two three", "Four é", "a", "b", "cd", "tail"]
    assert text_of(None) == text_of("") == text_of("<p>") == []
    assert text_of("1 < 2 &am") == ["1 < 2 &am"]
    assert text_of('<p title="a>b">x</p></div></p>y') == ["x", "y"]


def test_given_pages(spark):
    pages = read_table(spark, "/root/testdata/sf0.01", "pages")
    found = {r["page_id"]: r for r in ext.extract_main_text(pages).collect()}
    rows = pages.collect()
    assert len(found) == len(rows)
    for r in rows:
        article = re.search("<article>(.*?)(</article>|$)", r["html"], re.S)
        inner = re.sub(r"<[^>]*>|<[^>]*$", " ", article[1] if article else "")
        assert found[r["page_id"]]["text"] == " ".join(html.unescape(inner).split())
        assert found[r["page_id"]]["n_chars"] == len(found[r["page_id"]]["text"])


def test_unmarked_boilerplate_is_learned_from_the_site(spark):
    """Repeated content goes although its tags and classes tell nothing."""
    rows = [
        (
            i,
            f"http://one.example/{i}",
            f"<body><div class=x><p>Always the same words</p></div><div class=y><p>Story {i} is new</p>"
            f"<p>And so is {i * i + 7}</p></div><div class=comments><p>Nice {i}</p></div>"
            "<form><label>Mail</label></form><div class=z>Follow us</div></body>",
        )
        for i in range(30)
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for r in ext.extract_main_text(pages).collect():
        i = r["page_id"]
        assert r["text"] == f"Story {i} is new And so is {i * i + 7}"
    tree = {(r["host"], r["path"]): r["importance"] for r in ext.style_tree(pages).collect()}
    assert tree["one.example", "body/div.x/p"] == 0.0
    assert tree["one.example", "body/div.y/p"] > 0.9


def test_edge_cases(spark):
    rows = [
        (1, None, None, "a"),
        (1, None, None, "a"),
        (2, "no url", "<article><p>Text</article>", "b"),
        (3, "http://h.example", "", "c"),
        (None, "http://h.example", "plain", "d"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    found = sorted(
        ((r["page_id"], r["text"]) for r in ext.extract_main_text(pages).collect()), key=repr
    )
    assert found == sorted([(1, ""), (1, ""), (2, "Text"), (3, ""), (None, "plain")], key=repr)
    assert ext.extract_main_text(pages.where("false")).count() == 0


def test_small_hosts_are_cut_by_their_own_marks(spark):
    """Few pages with class names of their own; unmarked templates of all hosts go as well."""
    rows = [
        (
            10 * h + i,
            f"http://h{h}.example/{i}",
            f"<body><div class=wrap{chr(97 + h)}><nav>Menu {h}</nav><p>Story {h} {i}</p><footer>Mail us</footer>"
            f"</div><div class=common><p>Powered by us</p></div><section>Only {h} {i}</section></body>",
        )
        for h in range(12)
        for i in range(2)
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for r in ext.extract_main_text(pages).collect():
        h, i = divmod(r["page_id"], 10)
        assert r["text"] == f"Story {h} {i} Only {h} {i}"


def test_class_words_do_not_cost_the_article(spark):
    """Marks by words never take a whole page, on hosts of many pages or of few."""
    forms = {
        "a": '<body class="single-post has-sidebar"><p>{}</p><nav>Menu</nav></body>',
        "b": '<body><div id="content-with-comments"><p>{}</p></div><nav>Menu</nav></body>',
        "c": '<body><article class="post no-banner"><p>{}</p></article><nav>Menu</nav></body>',
        "d": '<body class="sidebar"><main role="search"><p>{}</p></main><footer>Foot</footer></body>',
        "e": '<body><div class="widget"><p>{}</p><div class="share"><p>Share {}</p></div></div></body>',
        "f": '<body><div class="comments"><p>Nice {}</p></div><div class="widget"><p>Ad {}</p></div>'
        "<section><p>{}</p></section></body>",
    }
    rows = [
        (ord(f) * 100 + i, f"http://{f}{n}.example/{i}", page.replace("{}", f"Story {i * i + 7}"))
        for f, page in forms.items()
        for n in (20, 3)
        for i in range(n)
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for r in ext.extract_main_text(pages).collect():
        i = r["page_id"] % 100
        assert r["text"] == f"Story {i * i + 7}", (r["url"], r["text"])


def extracted(spark, rows):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    return {r["page_id"]: r["text"] for r in ext.extract_main_text(pages).collect()}


def test_repeated_and_syndicated_articles_stay(spark):
    page = "<body><nav>Menu</nav><div class=y><p>One story</p><p>told again</p></div></body>"
    rows = [(i, "http://r.example/", page) for i in range(9)]
    rows += [
        (100 + i, f"http://s.example/{i}", f"<body><nav>Menu</nav><p>Seen {i} times</p><article><h1>News</h1>"
         "<p>For all</p><div class=share>Share</div></article></body>")
        for i in range(12)
    ]
    found = extracted(spark, rows)
    assert {found[i] for i in range(9)} == {"One story told again"}
    assert [found[100 + i] for i in range(12)] == [f"Seen {i} times News For all" for i in range(12)]


def test_compound_names_and_headers(spark):
    """Comments and site headers under compound names go on hosts of any size, an article's header stays."""
    rows = [
        (
            1000 * n + i,
            f"http://n{n}.example/{i}",
            f"<body><div class=site-header><p>Welcome {i}</p></div><article><header><h1>Title {i}</h1></header>"
            f"<p>Story {i} {i * i + 5} alpha</p><footer>Filed {i}</footer></article>"
            f"<ul class=comment-list><li>Reader {i} says {i + 1}</li></ul></body>",
        )
        for n in (1, 3, 30)
        for i in range(n)
    ]
    for page_id, text in extracted(spark, rows).items():
        i = page_id % 1000
        assert text == f"Title {i} Story {i} {i * i + 5} alpha"


def test_names_of_states_are_no_marks():
    for value in ("comment-list", "site_header", "top-ad", "sidebar", "menu--main"):
        assert ext.style_of("div", f'class="{value}"').endswith("!"), value
    for value in ("no-banner", "has-sidebar", "content-with-comments", "headerless", "shared"):
        assert not ext.style_of("div", f"class={value}").endswith("!"), value
    assert not ext.style_of("div", "class=entry-header", inside=True).endswith("!")
    assert ext.style_of("div", "class=entry-footer", inside=True).endswith("!")
