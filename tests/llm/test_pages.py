import pytest

from conftest import rows
from tillsight.llm import pages

SCHEMA = "page_id long, url string, html string"


def page(i, body="", end="</body></html>"):
    return (
        f'<!DOCTYPE html><html><head><title>T{i}</title><style>p{{}}</style><script>var t="</p>";</script>'
        f'</head><body><nav><ul><li><a href="/{i}">Menu {i}</a></li></ul></nav><!-- ad > {i} -->'
        f'<div class="ad box">Buy {i}</div>{body}<footer>&copy; foot {i}</footer>{end}'
    )


def article(i):
    return (
        f"<article><h1>Head &amp; {i}</h1><p><b>First\n  bold{i}.<br><p>Second <i>in</i>line&nbsp;x &lt;b&gt;</p>"
        f'<form>Sign up</form><div class="comments"><p>Me too</p></div><p>Same on all</p></article>'
    )


def wanted(i):
    return f"Head & {i}\nFirst bold{i}.\nSecond inline x <b>\nSame on all"


@pytest.fixture(scope="module")
def site(spark):
    data = [(i, f"https://User@Host.example.com:80/{i}", page(i, article(i))) for i in range(12)]
    return spark.createDataFrame(data, SCHEMA)


def test_article_of_each_page(site):
    found = {r.page_id: r for r in pages.extract(site).collect()}
    assert {i: r.text for i, r in found.items()} == {i: wanted(i) for i in range(12)}
    assert all(r.n_chars == len(r.text) and r.url.endswith(str(i)) for i, r in found.items())


def test_template_has_what_all_pages_share(site):
    template = pages.templates(site).collect()
    assert len(template) == 1 and template[0].host == "host.example.com"
    tokens = set(template[0].template)
    assert pages.number("tag", "/html/body/article") in tokens
    assert pages.number("text", "/html/body/article/p", "Same on all") in tokens
    assert pages.number("text", "/html/body/footer", "© foot 1") not in tokens


def test_pages_without_article_lose_fixed_text_and_links(spark):
    def body(i):
        return (
            f'<div><p>Read this first</p><p>Story number {i} is told here.</p></div>'
            f'<div><a href="#">Link {i}</a> <a href="#">Other {i}</a></div><div id="sidebar">Side {i}</div>'
        )

    data = [(i, "http://h.example.org/x", page(i, body(i))) for i in range(8)]
    found = rows(pages.extract(spark.createDataFrame(data, SCHEMA)).select("page_id", "text"))
    assert sorted(found) == [(i, f"Story number {i} is told here.") for i in range(8)]


def test_broken_markup():
    assert pages.main_text("<article><p>a &am</p><p>b</arti", frozenset()) == "a &am\nb"
    assert pages.main_text("plain < text & more", frozenset()) == "plain < text & more"
    assert pages.main_text('<article><a title="x > y">t</a><br>u</article>', frozenset()) == "t u"
    assert pages.main_text('<article><a title="x>t</a> u', frozenset()) == "t u"
    assert pages.main_text("<article><ul><li>a<li>b</ul><script>x", frozenset()) == "a\nb"
    assert pages.main_text("<p>a<!-- never closed <p>b", frozenset()) == "a"
    assert pages.main_text("<article><header><h1>T</h1></header><aside>s</aside>x</article>", frozenset()) == "T\nx"


def test_edges(spark):
    data = [
        (1, None, None), (2, "", ""), (3, "not a url", "<p>x</p>"), (None, "http://a/b", "<article>y</article>"),
        (1, None, None), (4, "http://a/c", "<article>" + "<p>long words</p>" * 20_000),
    ]
    frame = spark.createDataFrame(data, SCHEMA).selectExpr("*", "'c' AS host", "'c' AS template", "1 AS page")
    found = {(r.page_id, r.n_chars) for r in pages.extract(frame).collect()}
    assert found == {(1, 0), (2, 0), (3, 1), (None, 1), (4, 20_000 * 11 - 1)}
    assert pages.extract(frame).count() == 6
    assert pages.extract(spark.createDataFrame([], SCHEMA)).count() == 0


def test_copies_are_one_page_of_a_host(spark):
    def story(i):
        return page(i, f"<div><p>Opening {i}.</p><p>Middle {i}.</p><p>End {i}.</p></div>")

    copies = [(i, "http://h.example.org/x", story(50)) for i in range(6)]
    others = [(10 + i, "http://h.example.org/x", story(10 + i)) for i in range(8)]
    few = [(30 + i, "http://few.example.org/x", story(60 + min(i, 1))) for i in range(3)]
    frame = spark.createDataFrame(copies + others + few, SCHEMA).repartition(4)
    found = {r.page_id: r.text for r in pages.extract(frame).collect()}
    assert found == {i: f"Opening {n}.\nMiddle {n}.\nEnd {n}." for i, n in [
        *((i, 50) for i in range(6)), *((i, i) for i in range(10, 18)), (30, 60), (31, 61), (32, 61)
    ]}


def test_names_around_the_article_take_nothing_away():
    nothing = frozenset()
    body = "<article><h2 id='related-work'>R</h2><p id='notice'>N</p><div class='notice'>x</div></article>"
    assert pages.main_text(f"<div class='layout with-sidebar'>{body}</div>", nothing) == "R\nN"
    assert pages.main_text(f"<form id='page'>{body}</form>", nothing) == "R\nN"
    more = "<div class='related'><article>Other story</article></div>"
    assert pages.main_text(f"<main><h1>T</h1>{body}{more}</main>", nothing) == "T\nR\nN"
    wrapped = f"<main><h1>T</h1><div class='with-sidebar'>{body}</div></main>"
    assert pages.main_text(wrapped, nothing) == "T\nR\nN"


def test_fixed_boxes_inside_the_article_are_template(spark):
    fixed = "<div class='zz9'><h4>Great offers</h4><p>Only today</p><p><a href='#'>Order</a></p></div>"

    def story(i):
        varied = f"<div class='zz8'><h4>Facts</h4><p>Fact {i}</p></div>"
        return page(i, f"<article><p>Story {i}</p><p>Same words</p>{varied}{fixed}</article>")

    data = [(i, "http://h.example.org/x", story(i)) for i in range(8)]
    frame = spark.createDataFrame(data, SCHEMA)
    found = {r.page_id: r.text for r in pages.extract(frame).collect()}
    assert found == {i: f"Story {i}\nSame words\nFacts\nFact {i}" for i in range(8)}
    assert "Great offers" in pages.main_text(story(1), frozenset())
    template = frozenset(pages.templates(frame).first().template)
    assert pages.main_text(f"<html><body><article>{fixed}</article>", template) == "Great offers\nOnly today\nOrder"


def test_hints_inside_the_article_need_the_template(spark):
    """A name with a listed word among others decides only if the element recurs on the host."""
    advert = "<div class='promo-teaser-7'><p>Offer {0} of today</p></div>"

    def story(i):
        own = "<div id='search-history'><p>How search began.</p></div>" if i == 3 else ""
        return page(i, f"<article><h1>Story {i}</h1><p>Text {i}.</p>{own}{advert.format(i)}</article>")

    data = [(i, "http://h.example.org/x", story(i)) for i in range(8)]
    frame = spark.createDataFrame(data, SCHEMA)
    found = {r.page_id: r.text for r in pages.extract(frame).collect()}
    more = {3: "\nHow search began."}
    assert found == {i: f"Story {i}\nText {i}.{more.get(i, '')}" for i in range(8)}
    # Without a template the adverts would stay.
    assert pages.main_text(story(1), frozenset()) == "Story 1\nText 1.\nOffer 1 of today"


def test_names_that_say_nothing_else_decide_alone():
    def text(body):
        return pages.main_text(f"<article><p>Story</p>{body}</article>", frozenset())

    assert text("<p class='advert'>Buy now</p>") == "Story"
    assert text("<div class='comment-list'><p>Me too</p></div>") == "Story"
    assert text("<section id='comments'>Me too</section>") == "Story"
    assert text("<div id='search-history'>Real text</div>") == "Story\nReal text"
    assert text("<p id='notice'>N</p><h2 id='search'>S</h2>") == "Story\nN\nS"
    assert text("<math><mi>x</mi><mo>=</mo><mn>2</mn></math>") == "Story\nx=2"


def test_articles_within_an_article_are_comments():
    comments = "".join(f"<article{c}><p>Me {i}</p></article>" for i, c in enumerate([" class='comment'", ""]))
    assert pages.main_text(f"<article><h1>Story</h1><p>Told</p>{comments}</article>", frozenset()) == "Story\nTold"
    boxed = f"<article><p>Told</p><section>{comments}</section><p>End</p></article>"
    assert pages.main_text(boxed, frozenset()) == "Told\nEnd"
    # Where nothing else is in it, they are what the page is about.
    assert pages.main_text("<article><article>One</article><article>Two</article></article>", frozenset()) == "One\nTwo"


def plain_template(markup, support=pages.SUPPORT, size=pages.CLASS_SIZE):
    """Valid classes by whole occurrence vectors over the distinct pages of one host."""
    contents = sorted(set(markup))
    counts = [pages.page_tokens(m) for m in contents]
    vectors = {t: tuple(c.get(t, 0) for c in counts) for c in counts for t in c}
    least = max(2, min(pages.LEAST, len(contents)))
    classes = {}
    for token, vector in vectors.items():
        on = sum(n > 0 for n in vector)
        if on >= least and on >= support * len(contents):
            classes.setdefault(vector, []).append(token)
    return sorted(t for members in classes.values() if len(members) >= size for t in members)


def test_templates_and_texts_equal_whole_vectors(spark):
    """The query on a given table against templates by brute force, host by host."""
    table = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    hosts = {}
    for r in table.select("page_id", "html", pages.host_of(table.url).alias("host")).collect():
        hosts.setdefault(r.host, []).append(r)
    learned = {r.host: r.template for r in pages.templates(table).collect()}
    found = {r.page_id: r.text for r in pages.extract(table).collect()}
    for host, group in hosts.items():
        template = plain_template([r.html for r in group])
        assert learned.get(host, []) == template
        for r in group:
            assert found[r.page_id] == pages.main_text(r.html, frozenset(template))
