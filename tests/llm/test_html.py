import time
from html.parser import HTMLParser

import numpy as np
import pytest

from fieldlark.llm import html_text
from fieldlark.session import small_table

ARTICLE = "<article><h1>A &amp; B</h1><p>First\n  <b>bold</b>er&nbsp;text &lt;x&gt;.</p><p>S.<br>Last</p></article>"
TEXT = "A & B First bolder text <x>. S. Last"


def page(before="", after="", inside=ARTICLE):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{a:b}}</style><script>var x='<p>no</p>';</script></head><body>{before}{inside}{after}</body></html>"


@pytest.mark.parametrize("noise", [
    "<nav><ul><li><a href='/x'>Menu</a></li></ul></nav>", "<header><h2>Site</h2></header>", "<footer>&copy; me</footer>",
    "<aside><p>Side text of some length, really</p></aside>", "<form><label>Mail</label><input name=a><button>Go</button></form>",
    "<div class=\"ad\">Buy this now please</div>", "<div id='cookie-notice'><p>We use cookies</p><div>ok</div></div>",
    "<section class='comments'><h3>Comments</h3><article class='comment'><p>I agree</p></article></section>",
    "<div class=\"sidebarLeft\">x</div>", "<!-- a comment with <p>text</p> -->", "<noscript>Enable it</noscript>",
    "<div role=navigation>go</div>", "<p hidden>unseen</p>", "<script>if (a < b) { c('</p>') }</script>", "<p class='advert'>Buy", "<p>stray"])
def test_noise_around_the_article_goes(noise):
    assert html_text.main_text(page(noise)) == TEXT
    assert html_text.main_text(page("", noise)) == TEXT


@pytest.mark.parametrize("noise", [
    "<div class='ad'>Buy</div>", "<aside>side</aside>", "<form><p>Mail <input></p></form>", "<div class='newsletter-box'><p>Join</p></div>",
    "<script>x</script>", "<ul class='share'><li>Tweet</li></ul>", "<style>x</style>", "<div class='related'><a href=x>More</a></div>"])
def test_noise_within_the_article_goes(noise):
    inside = ARTICLE.replace("</p><p>", "</p>" + noise + "<p>")
    assert html_text.main_text(page(inside=inside)) == TEXT


def test_everything_in_the_article_stays():
    short = "<article><h1>x</h1><p><b>Open.<br><p>a</p><ul><li>one<li>two</ul><table><tr><td>c<td>d</table><p>&amp;am; &am</article>"
    assert html_text.main_text(page("<nav>n</nav>", "<footer>f</footer>", short)) == "x Open. a one two c d &am; &am"


def test_pages_without_an_article_are_cut_by_the_line_lengths():
    body = "".join(f"<p>{'Some sentence of the text. ' * 5}{i}</p>" for i in range(5))
    links = "".join(f"<div><a href=/{i}>Link number {i}</a></div>" for i in range(8))
    got = html_text.main_text(page(links, links, f"<div>{body}</div>"))
    assert got.startswith("Some sentence") and got.endswith(". 4") and "Link" not in got


def test_short_pages_and_layout_words():
    assert html_text.main_text("<body><div class='menu'>Home</div><div>Only this.</div></body>") == "Only this."
    assert html_text.main_text(f"<div class='page has-sidebar with_comments'>{ARTICLE}</div>") == TEXT


@pytest.mark.parametrize("opening", [
    "<article class='post hentry category-social tag-search'>", "<article id='discussion'>", "<article class='entry comments-open related-work'>"])
def test_what_an_article_is_about_does_not_matter(opening):
    assert html_text.main_text(page("<nav>n</nav>", "<footer>f</footer>", ARTICLE.replace("<article>", opening))) == TEXT


@pytest.mark.parametrize("part", [
    "<section id='discussion'><p>Kept</p></section>", "<section id=search-trees><p>Kept</p></section>", "<section id='related-work'>Kept</section>",
    "<h2 id='binary-search'>Kept</h2>", "<p class='legal'>Kept</p>", "<div class='entry-header'><p>Kept</p></div>",
    "<section class='discussion'>Kept</section>"])
def test_parts_of_an_article_stay(part):
    assert html_text.main_text(page(inside=ARTICLE.replace("</p><p>", "</p>" + part + "<p>"))) == TEXT.replace("S. Last", "Kept S. Last")


@pytest.mark.parametrize("noise", [
    "<article class='comment even'><p>I agree</p></article>", "<article class='teaser-card'><p>Read on</p></article>",
    "<article id='div-comment-12'><p>I agree</p></article>", "<div class='site-footer'>f</div>", "<div id='main-nav'>n</div>"])
def test_comments_and_teasers_go(noise):
    assert html_text.main_text(page(noise)) == html_text.main_text(page("", noise)) == TEXT


def test_surge_and_dive_points():
    weights = np.array([0, 5, 0, 0, 0, 90, 10, 0, 20, 0, 0, 0, 5])
    assert np.flatnonzero(html_text.between(weights, 3, 80)).tolist() == [5, 6, 7, 8]
    assert html_text.between(np.empty(0, int), 3, 80).tolist() == []


@pytest.mark.parametrize("text", ["", None, "<", "<p", "<<>>", "<script>", "<!--", "</p></div>", "<a b='c>", "<div class='>x</div>"])
def test_broken_pages_do_not_fail(text):
    assert isinstance(html_text.main_text(text), str)


def test_table(spark):
    rows = [(1, page(), "u"), (1, page(), "u"), (2, None, "u"), (3, "", "u"), (None, page(inside="<article>" + "<p>w</p>" * 50000 + "</article>"), "u")]
    df = small_table(spark, rows, "page_id long, html string, text string")
    out = html_text.extract(df)
    assert out.columns == ["page_id", "html", "text"]
    got = sorted((r.page_id or 0, len(r.text)) for r in out.collect())
    assert got == [(0, 99999), (1, len(TEXT)), (1, len(TEXT)), (2, 0), (3, 0)]
    assert html_text.extract(df.limit(0)).collect() == []


@pytest.mark.parametrize("part", [
    "<div class='cookie-recipe'>Kept</div>", "<div class='widget-theory'><p>Kept</p></div>", "<div id='related-work'>Kept</div>",
    "<p>Kept</p>", "<p><math><mi>Kept</mi></math></p>", "<div class='ad-hoc-networks'>Kept</div>"])
def test_subjects_of_an_article_stay(part):
    assert html_text.main_text(page(inside=ARTICLE.replace("</p><p>", "</p>" + part + "<p>"))) == TEXT.replace("S. Last", "Kept S. Last")


@pytest.mark.parametrize("noise", [
    "<section class='article-comments'><p>I agree</p></section>", "<div class='post-ad'>Buy</div>", "<div class='ad-slot-top'>Buy</div>",
    "<div id='comments'><p>I agree</p></div>", "<ol class='comment-list'><li>I agree</ol>", "<div class='cookie-notice'>ok</div>"])
def test_comments_and_adverts_in_an_article_go(noise):
    assert html_text.main_text(page(inside=ARTICLE.replace("</p><p>", "</p>" + noise + "<p>"))) == TEXT


SENTENCES = "".join(f"<p>{'Some sentence of the text. ' * 5}{i}.</p>" for i in range(4))
LINKS = "".join(f"<div><a href=/{i}>Link {i}</a></div>" for i in range(4))


def test_text_behind_a_dive_goes_on():
    got = html_text.main_text(f"<body><div>{SENTENCES}{LINKS}<p>A last short one.</p></div><div>{LINKS}<div><p>Made by us.</p></div></div></body>")
    assert got.endswith("3. A last short one.") and "Link" not in got


@pytest.mark.parametrize("opening", ["<a name=x>", "<p><a href=/x>Up</p>", "<a id='top'><a name=y>"])
def test_links_that_are_not_closed(opening):
    got = html_text.main_text(f"<body><div>{opening}</div><div class='legal-history'>{SENTENCES}</div></body>")
    assert got.endswith("3.") and got.count("Some sentence") == 20


def test_the_window_sums_decide_on_pages_that_mark_nothing(monkeypatch):
    text = f"<body><div>Home</div><div>About us</div>{LINKS}<div>{SENTENCES}</div>{LINKS}<div>Tel. 12 34</div></body>"
    got = html_text.main_text(text)
    assert got.startswith("Some sentence") and got.endswith("3.")
    monkeypatch.setattr(html_text, "between", lambda weights, window, surge: weights > 0)
    assert html_text.main_text(text) != got


def test_deep_nesting_takes_linear_time():
    def seconds(n):
        began = time.perf_counter()
        assert html_text.main_text("<div>" * n + "<p>x</p>" + "</div>" * n) == "x"
        return time.perf_counter() - began

    assert seconds(40000) < 2


class Articles(HTMLParser):
    """The text of the article by the parser of the standard library: every element but those by name left out."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks, self.depth, self.skipped = [[]], 0, 0

    def handle_starttag(self, tag, attrs):
        self.depth += tag == "article"
        self.skipped += tag in ("nav", "footer", "script", "style") or tag == "div" and ("class", "ad") in attrs
        if tag in html_text.BLOCKS:
            self.blocks.append([])

    def handle_endtag(self, tag):
        self.depth -= tag == "article"
        self.skipped -= tag in ("nav", "footer", "script", "style") or tag == "div" and self.skipped > 0
        if tag in html_text.BLOCKS:
            self.blocks.append([])

    def handle_data(self, data):
        if self.depth and not self.skipped:
            self.blocks[-1].append(data)

    def text(self):
        return " ".join(t for t in (" ".join("".join(b).split()) for b in self.blocks) if t)


def test_given_pages_agree_with_a_parser(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    for r in html_text.extract(pages).select("html", "text").collect():
        parser = Articles()
        parser.feed(r.html or "")
        parser.close()
        assert r.text == parser.text()
