"""HTML extraction: style trees, presentation and broken markup."""

from __future__ import annotations

import html
import math
import random
import re
from collections import Counter

import pytest

from stratalake.fixtures import table
from stratalake.llm import html_tree
from stratalake.llm.queries import QUERIES


def article_of(page):
    """The article of the benchmark pages, block by block."""
    inside = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    blocks = re.split(r"</?(?:p|h1)>", inside)
    plain = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in blocks)
    return "\n".join(b for b in plain if b)


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_whole_table(spark, sf):
    d = f"/root/testdata/sf{sf}"
    want = {r.page_id: article_of(r.html) for r in table(spark, d, "pages").collect()}
    rows = QUERIES["op7_html_extraction"](spark, d).collect()
    assert {r.page_id: r.text for r in rows} == want
    assert all(r.n_chars == len(r.text) for r in rows)


def page(i, body):
    return f"<html><body>{body}<p>Own words number {i} here.</p></body></html>"


PAGES = "page_id bigint, url string, html string"
MENU = "<div class=x1><a href=/a>Start</a><a href=/b>About</a></div><div class=x2>All rights</div>"


@pytest.mark.parametrize("size", [5, 50, 500])
@pytest.mark.parametrize("others", [False, True])
def test_the_tree_finds_boilerplate_without_names(spark, size, others):
    """Divisions without telling names are removed because they say the same on every page."""
    rows = [(i, f"http://site.example/{i}", page(i, MENU)) for i in range(size)]
    if others:  # hosts with the same template, other menus
        for h in range(20):
            menu = MENU.replace("Start", f"Go {h}").replace("About", f"On {h}").replace("All", f"Some {h}")
            rows += [(9000 + 10 * h + i, f"http://h{h}.example/{i}", page(f"{h}x{i}", menu)) for i in range(5)]
    rows += [(8000, "http://lone.example/", "<table><tr><td>a cell</td></tr></table>")]
    got = {r.page_id: r for r in html_tree.report(spark.createDataFrame(rows, PAGES)).collect()}
    for i in range(size):
        assert got[i].text == f"Own words number {i} here."
        assert got[i].removed_branches == 2
    assert got[8000].text == "a cell"


def article(text, *, beside="", inside=""):
    return f"<html><body>{beside}<article><h1>T {text}</h1><p>{text} one.</p><p>{text} two.</p>{inside}</article></body></html>"


def words_of(text):
    return f"T {text}\n{text} one.\n{text} two."


@pytest.mark.parametrize("beside", ["", "<div>way {copy}</div>"])
def test_a_mirror_keeps_its_articles(spark, beside):
    """50 articles with 20 copies each, exact ones or with a line of their own beside them."""
    rows = []
    for a in range(50):
        for c in range(20):
            markup = article(f"story {a}", beside=MENU + beside.format(copy=f"{a}-{c}"))
            rows.append((20 * a + c, f"http://mirror.example/{a}/{c}", markup))
    got = {r.page_id: r.text for r in html_tree.report(spark.createDataFrame(rows, PAGES)).collect()}
    for i, text in got.items():
        own = "\n" if not beside else f"way {i // 20}-{i % 20}\n"
        assert text == (own + words_of(f"story {i // 20}")).lstrip()


def test_two_pages_with_nearly_the_same_article(spark):
    long = "".join(f"<p>paragraph {i}</p>" for i in range(12))
    rows = [(i, f"http://two.example/{i}", article("same", inside=f"{long}<p>edit {i}</p>")) for i in range(2)]
    got = {r.page_id: r.text for r in html_tree.report(spark.createDataFrame(rows, PAGES)).collect()}
    for i in range(2):
        assert got[i] == "\n".join([words_of("same"), *(f"paragraph {k}" for k in range(12)), f"edit {i}"])


@pytest.mark.parametrize(
    "part", ['<p class="share-price">Up {i}.</p>', '<div class="search-results">Found {i}.</div>',
             '<section id="related-work">Work {i}.</section>', '<blockquote class="notice">Note {i}.</blockquote>'],
)
@pytest.mark.parametrize("size", [1, 4, 60])
def test_names_alone_remove_nothing_from_an_article(spark, part, size):
    rows = [(i, f"http://a.example/{i}", article(f"text {i}", inside=part.format(i=i))) for i in range(size)]
    got = {r.page_id: r.text for r in html_tree.report(spark.createDataFrame(rows, PAGES)).collect()}
    inside = re.sub("<[^>]*>", "", part)
    assert got == {i: f"{words_of(f'text {i}')}\n{inside.format(i=i)}" for i in range(size)}


def test_what_all_articles_share_goes(spark):
    """Many pages without a name for it, fewer with one."""
    for part, size in (("<div class=x9>Read on.</div>", 60), ('<div class="promo">Read on.</div>', 8)):
        rows = [(i, f"http://a.example/{i}", article(f"text {i}", inside=part)) for i in range(size)]
        got = {r.page_id: r.text for r in html_tree.report(spark.createDataFrame(rows, PAGES)).collect()}
        assert got == {i: words_of(f"text {i}") for i in range(size)}


def test_trees_decide(spark, monkeypatch):
    """Without them the unnamed parts stay."""
    rows = [(i, f"http://site.example/{i}", page(i, MENU)) for i in range(6)]
    pages = spark.createDataFrame(rows, PAGES)
    with_trees = {r.page_id: r.text for r in html_tree.report(pages).collect()}
    monkeypatch.setattr(html_tree, "IMPORTANT", -1.0)
    monkeypatch.setattr(html_tree, "REPEATED", -1.0)
    without = {r.page_id: r.text for r in html_tree.report(pages).collect()}
    assert all("All rights" in without[i] and "All rights" not in with_trees[i] for i in range(6))


def plain_tree(rows):
    """Importance of each (host, path), by its definition."""
    sites = {}
    for _, url, markup in sorted(rows, key=lambda r: r[2]):
        ident, found = html_tree.nodes(markup)
        sites.setdefault(re.search("//([^/]*)", url)[1], {}).setdefault(ident, found)
    everything = [of for site in sites.values() for of in site.values()]

    def importance(pages, path):
        have = [p[path] for p in pages if path in p]
        m = len(have)
        if m < 2:
            return m, 1.0
        pieces = {x: sum(x in h[2] for h in have) for h in have for x in h[2]}
        if pieces:
            return m, 1 - sum(math.log(k) for k in pieces.values()) / len(pieces) / math.log(m)
        styles = Counter(h[1] for h in have)
        return m, -sum(k / m * math.log(k / m) for k in styles.values()) / math.log(m)

    out = {}
    for site, of in sites.items():
        for path in {p for found in of.values() for p in found}:
            inside = next(f[path][3] for f in of.values() if path in f)
            m, own = importance(of.values(), path)
            prior = 1.0 if inside else importance(everything, path)[1]
            out[site, path] = (m * own + html_tree.PRIOR * prior) / (m + html_tree.PRIOR)
    best = {}
    for (site, path), value in out.items():
        for found in sites[site].values():
            if path in found:
                for up in [path, *found[path][0]]:
                    best[site, up] = max(best.get((site, up), 0), value)
    return best


def test_importance_against_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for i in range(120):
        parts = [f"<div class=c{k}><p>{rng.choice(['all', f'h{i % 4}', f'own {i}'])} {k}</p></div>" for k in range(rng.randint(1, 5))]
        inner = "".join(f"<p>{rng.choice(['same', f'body {i % 7}', f'body {i}'])}</p>" for _ in range(3))
        rows.append((i, f"http://h{i % 4}.example/", f"<body>{''.join(parts)}<main>{inner}<ul><li>{i % 2}</ul></main></body>"))
    rows += rows[:10]
    got = {}
    for r in html_tree.style_trees(spark.createDataFrame(rows, PAGES)).collect():
        got[r.site] = (set(r.low), set(r.repeated))
    best = plain_tree(rows)
    hosts = spark.createDataFrame([(h,) for h in {h for h, _ in best}], "h string")
    site = {r.h: r.s for r in hosts.selectExpr("h", "xxhash64(h) AS s").collect()}
    for h, s in site.items():
        for limit, found in zip((html_tree.IMPORTANT, html_tree.REPEATED), got.get(s, (set(), set()))):
            sure = {p for (x, p), v in best.items() if x == h and v < limit - 1e-9}
            assert sure <= found <= {p for (x, p), v in best.items() if x == h and v < limit + 1e-9}
    assert any(low for low, _ in got.values())


CASES = [
    ("<p>a &amp; b&nbsp;c<br>d<p>e", "a & b c d\ne"),
    ("<ul><li>1<li>2</ul><table><tr><td>x<td>y</table>", "1\n2\nx\ny"),
    ("<script>var t='</p>';</script>x <style>p{}</style>y", "x y"),
    ("t < 3 &lt; <b>q</b>r", "t < 3 < qr"),
    ('<a href="x>y">l</a> <a href="broken>m', "l m"),
    ("<article><header><h1>T</h1></header><p>b</p><aside>no</aside></article><footer>f</footer>", "T\nb"),
    ("<header>site</header><div id='cookie-notice'>c</div><main><p>m</p></main>", "m"),
    ("<p>a</p><section class='reader-comments'><p>c</p></section><form><p>f</p></form>", "a"),
    ("<div class='adBox'>x</div><div class='shadow'>y</div>", "y"),
    ("a<!-- c -->b<!-- open", "ab"),
    ("</p></div>stray<p>end</b>s", "stray\nends"),
    ("<p>nested <div>block</div> after", "nested\nblock\nafter"),
    ("", ""),
    (None, ""),
    ("&#x41;&#66;&unknown; &copy;", "AB&unknown; ©"),
]


@pytest.mark.parametrize("markup, text", CASES)
def test_markup(markup, text):
    assert html_tree.main_text(markup, frozenset())[0] == text


def test_long_broken_markup_ends():
    for markup in ('<a "' * 20_000, "<p>" * 3_000, "<" * 100_000, "<a b='" + "x" * 100_000):
        html_tree.main_text(markup, frozenset())
    deep = "<div>" * 20_000 + "in" + "</div>" * 20_000 + "<p>after"
    assert html_tree.main_text(deep, frozenset()) == ("in\nafter", 0)
    assert len(html_tree.nodes(deep)[1]) <= html_tree.MAX_DEPTH + 1


def test_odd_rows(spark):
    rows = [(1, None, None), (1, None, None), (None, "no url", "<p>x"), (2, "http://[bad", "<p>y")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    pages = pages.selectExpr("*", "'c' AS host", "'c' AS text", "1 AS low", "2 AS result")
    got = html_tree.extract(pages, text="main")
    assert got.columns == [*pages.columns, "main"]
    assert sorted(r.main for r in got.collect()) == ["", "", "x", "y"]
    assert html_tree.extract(pages).where("text <> 'c'").count() == 4


def test_empty_table(spark):
    pages = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert html_tree.report(pages).collect() == []


def test_trees_too_large_to_broadcast_are_joined(spark, monkeypatch):
    menu = "<div class=x1><a href=/a>Start</a></div>"
    rows = [(i, f"http://site.example/{i}", page(i, menu)) for i in range(60)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    small = sorted(map(tuple, html_tree.report(pages).collect()))
    monkeypatch.setattr(html_tree, "BROADCAST_NODES", -1)
    assert sorted(map(tuple, html_tree.report(pages).collect())) == small
