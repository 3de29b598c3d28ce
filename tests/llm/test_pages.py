"""Archives and main texts against plain Python."""

import base64
import gzip
import hashlib
import html as html_lib
import re

import pytest
from pyspark.sql import functions as F

from terrapanel.llm import html, warc
from terrapanel.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
PAGES = "page_id long, url string, html string, host string, path string, digest string"


def pages_of(spark):
    return [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]


def edge_pages(spark):
    texts = [
        "<p>one</p>",
        None,
        "",
        "<p>one</p>",
        "WARC/1.0\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.0\r\n",
        "ends in line ends\r\n\r\n",
        "\r\n",
        "é漢\U0001f600" * 3000,
        "<p>one</p>",
    ]
    rows = [(i, f"https://h{i % 2}.example.com/a?b=c d\r\n#x" if i % 4 else None, t, "h", "p", "d") for i, t in enumerate(texts)]
    return rows + [rows[7], (None, None, "<p>one</p>", None, None, None), (3, "https://other.example.com/", "<p>one</p>", "", "", "")]


def plain_records(rows, least=0):
    first = {}
    for page_id, url, text in rows:
        data = (text or "").encode()
        order = (page_id is None, page_id or 0, url is not None, url or "")
        first[data] = min(first.get(data, (order, page_id, url)), (order, page_id, url))
    want = []
    for page_id, url, text in rows:
        data = (text or "").encode()
        _, first_id, first_url = first[data]
        response = len(data) < least or (page_id, url) == (first_id, first_url)
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        want.append((page_id, len(data), digest, "response" if response else "revisit", None if response else first_id))
    return want


def same(found, want):
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted((tuple(r) for r in found), key=key) == sorted(want, key=key)


@pytest.mark.parametrize("least", [0, 5, 100])
def test_archives_edges(spark, least):
    rows = edge_pages(spark)
    pages = spark.createDataFrame(rows, PAGES)
    same(warc.digest(warc.stored_and_read(pages, least)).collect(), plain_records([r[:3] for r in rows], least))
    assert warc.digest(warc.stored_and_read(pages.limit(0))).count() == 0


def test_archives_are_small_and_well_formed(spark, tmp_path):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    warc.write_archives(pages, str(tmp_path / "out"), archive_bytes=30_000)
    files = list((tmp_path / "out").glob("*.gz"))
    assert len(files) > 3
    kinds = []
    for file in files:
        data = gzip.decompress(file.read_bytes())
        assert len(data) < 300_000
        kinds += [dict(headers)["warc-type"] for headers, _ in warc.records_of(data)]
    n = pages.count()
    assert kinds.count("request") == kinds.count("metadata") == n


def test_broken_archives_are_refused():
    record = b"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    assert len(list(warc.records_of(record * 2))) == 2
    for broken in (record[:-6], record.replace(b"3", b"2"), b"x" + record):
        with pytest.raises(ValueError):
            list(warc.records_of(broken))
    assert warc.unzipped(gzip.compress(record) + gzip.compress(record)) == record * 2


def test_assembly_through_links_of_any_direction(spark):
    def record(record_id, kind, *links):
        return (record_id, kind, list(links), None, f"http://{record_id}/", None, None, None, {"of": record_id}, None)

    rows = [
        record("r1", "response"), record("q1", "request", "r1"), record("m1", "metadata", "r1"),
        record("r2", "response", "q2"), record("q2", "request"), record("m2", "metadata", "q2"),
        record("r3", "revisit"), record("m3a", "metadata", "r3"), record("m3b", "metadata", "r3"),
        record("q9", "request", "gone"), record("w", "warcinfo"),
        record("r4", "response"), record("r4", "response"), record("q4", "request", "r4"), record("q4", "request", "r4"),
    ]
    found = warc.captures(spark.createDataFrame(rows, warc.RECORD_DDL)).collect()
    shown = sorted(
        (r.record_id, r.request and r.request.record_id, r.metadata and r.metadata.record_id, r.n_metadata) for r in found
    )
    want = [("r1", "q1", "m1", 1), ("r2", "q2", "m2", 1), ("r3", None, "m3a", 2), ("r4", "q4", None, 0), ("r4", "q4", None, 0)]
    assert shown == sorted(want, key=str)


# -- main texts ------------------------------------------------------------------------------


def article_text(page):
    """For pages whose text is in one article of paragraphs and headings."""
    found = re.search("<article[^>]*>(.*)</article>", page or "", re.S)
    blocks = re.split("</?(?:p|h1)>", found[1]) if found else []
    texts = [" ".join(html_lib.unescape(re.sub("<[^>]*>", "", b)).split()) for b in blocks]
    return "\n".join(t for t in texts if t)


def test_main_texts_whole_table(spark):
    found = QUERIES["op9_html_extraction"](spark, SF).collect()
    want = [(i, u, article_text(x), len(article_text(x))) for i, u, x in pages_of(spark)]
    same(found, want)


MESSY = """<!doctype html><html><head><title>T &amp; t</title><script>if (a < b) { "</p>" }</script></head>
<body class="page-1"><!-- <p>no</p> --><header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></ul></nav>
<div class="cookie-notice">We use cookies</div><aside>Aside</aside>
<div id="wrap"><div class="post post-123"><h1>Title &eacute; &#x41;&nbsp;b</h1>
<p>First <b>bold</b>text<br>after a <a href="/x">link</a> in
 the middle.
<p>Second &lt;tag&gt;<ul><li>one<li>two</ul><form><input name=q><button>Go</button></form>
<blockquote>Quoted <i>words</blockquote><pre>a   b</pre><table><tr><td>c1<td>c2</table>
<div class="share">Share</div><div hidden>never</div><div style="display: none">nor</div></div>
<div class="comments"><p>I disagree, and at some length, for a reader.</p></div></div>
<footer>&copy; Site</footer></body></html>"""
MESSY_TEXT = "Title é A b\nFirst boldtext after a link in the middle.\nSecond <tag>\none\ntwo\nQuoted words\na b\nc1\nc2"


def test_messy_page():
    assert html.extracted(MESSY, None) == MESSY_TEXT
    page = html.Page(MESSY)
    assert page.path(page.best(page.scores())) == "html/body.page-#/div/div.post.post-#"


def test_host_path_and_boxes_beside_it(spark):
    """Pages that leave a box out, as it stands beside their article, tell that it belongs to the host's template."""
    def page(text, box, tag="div"):
        return f"<html><body><div class='main-{len(text)}'><{tag} class=text><p>{text}</p></{tag}></div><div class=box><p>{box}</p></div></body></html>"

    rows = [(i, "https://a.example/x", page("long text " * 30, "box", "article"), "clash", None, None) for i in range(4)]
    rows += [(9, "https://A.example/y", page("short text " * 9, "box and more " * 20, "article"), "clash", None, None)]
    rows += [(10, "https://b.example/y", page("short text " * 9, "box and more " * 20), "clash", None, None)]
    rows += [(11, None, None, None, None, None), (12, "not a url", "", None, None, None), (11, None, None, None, None, None)]
    rows += [(13, "https://a.example/z", "plain &amp; bare text", None, None, None)]
    found = {r.page_id: r.text for r in html.main_texts(spark.createDataFrame(rows, PAGES)).collect()}
    assert found[0] == ("long text " * 30).strip()
    assert found[9] == ("short text " * 9).strip()
    # one page alone says nothing about an unmarked box, whatever its size
    assert found[10] == ("short text " * 9).strip() + "\n" + ("box and more " * 20).strip()
    assert found[11] == found[12] == "" and found[13] == "plain & bare text"
    assert html.main_texts(spark.createDataFrame([], PAGES)).count() == 0


def test_votes_match_plain_counting(spark):
    pages = pages_of(spark)
    pages += [(1000 + k, "https://votes.example/", f"<body><div class=c{k % 3}{'x' * (k % 2)}><p>{'t ' * (9 + k % 4)}</p></div></body>") for k in range(30)]
    votes = {}
    for _, url, value in pages:
        page = html.Page(value or "")
        totals = page.scores()
        own = page.best(totals)
        if totals[own] > 0:
            host = (re.match(r"[A-Za-z][\w+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", url or "") or [None, ""])[1].lower()
            tally = votes.setdefault(host, {}).setdefault(page.path(own), [0, 0])
            tally[0] += 1
            tally[1] += totals[own]
    want = {h: min(((-n, -w, p) for p, (n, w) in tally.items()))[2] for h, tally in votes.items()}
    frame = spark.createDataFrame([(u, x) for _, u, x in pages], "url string, html string")
    found = html.host_paths(frame.select(html.host_of(F.col("url")).alias("host"), "html")).collect()
    assert {r.host: r.path for r in found} == want and len(found) > 3


def body_of(*parts):
    return f"<html><body>{''.join(parts)}</body></html>"


ONE, TWO = "first part of it " * 12, "second part " * 10
SPLITS = [
    f"<div class=content><div class=a><p>{ONE}</p></div><div class=b><p>{TWO}</p></div></div>",
    f"<section><p>{ONE}</p></section><section><p>{TWO}</p></section>",
    f"<div class=a><p>{ONE * 9}</p></div><div class=b><p>{TWO}</p></div>",
    f"<div class=title><h1>T</h1></div><div class=body><p>{ONE * 9}</p></div>",
    f"<div class=content><div class=a><p>{ONE * 20}</p></div><div class=b><p>Last line.</p></div></div>",
]


@pytest.mark.parametrize("split", SPLITS)
def test_text_in_several_containers_is_whole(split):
    want = "\n".join(" ".join(t.split()) for t in re.split("<[^>]*>", split) if t)
    assert html.extracted(body_of("<nav>Home</nav>", split, "<footer>F</footer>"), None) == want


def test_names_that_only_contain_a_boilerplate_word():
    for name in ("has-sidebar", "layout-with-sidebar", "no-sidebar", "sidebar", "legal-text", "search-result", "alert", "social-history"):
        assert html.extracted(body_of(f"<div class='{name}'><article><h1>T</h1><p>{ONE}</p></article></div>"), None) == "T\n" + ONE.strip()
        assert html.extracted(body_of(f"<div id='{name}'><p>{ONE}</p></div><div class=share>Share</div>"), None) == ONE.strip()
    for title in ("<header class='entry-header'>", "<header class='header'>", "<div class='article-header'>", "<div class='header'>"):
        tag = title[1:].split()[0]
        page = body_of("<div class=header>Site</div>", f"<article>{title}<h1>T</h1></{tag}><p>{ONE}</p></article>")
        assert html.extracted(page, None) == "T\n" + ONE.strip()


@pytest.mark.parametrize("name", ["sidebar", "sidebar-left", "site-footer", "share-buttons", "cookie-banner", "comments", "nav menu", "ad-3"])
def test_boilerplate_names_are_still_dropped(name):
    page = body_of(f"<div class=post><p>{ONE}</p><div class='{name}'><p>{TWO}</p></div></div>", f"<div id='{name}'><p>{TWO}</p></div>")
    assert html.extracted(page.replace(ONE, ONE * 4), None) == " ".join((ONE * 4).split())


REPLY_NAMES = "post-comments user-comments commentlist comment-thread reader-comments article-comments discussion comments-area".split()
OTHER_NAMES = "related-articles cookie-policy google-ads article-sidebar navlinks share-this".split()


@pytest.mark.parametrize("name", REPLY_NAMES + OTHER_NAMES)
@pytest.mark.parametrize("outer", ["article", "div"])
def test_one_known_word_beside_an_unknown_one(name, outer):
    page = body_of(f"<{outer} class=post><h1>T</h1><p>{ONE * 3}</p><div class='{name}'><p>{TWO}</p></div></{outer}>")
    assert html.extracted(page, None) == "T\n" + " ".join((ONE * 3).split())
    if name in REPLY_NAMES:  # however long they are
        assert html.extracted(page.replace(TWO, TWO * 9), None) == "T\n" + " ".join((ONE * 3).split())
    held = body_of(f"<div class='{name}'><article><p>{ONE}</p></article></div>")
    assert html.extracted(held, None) == ONE.strip()


@pytest.mark.parametrize("name", ["no-comments", "comments-open", "has-sidebar", "with-related", "commentary", "cookies-recipe-page"])
def test_names_about_something_else(name):
    assert html.extracted(body_of(f"<div class='{name}'><p>{ONE}</p></div><div><p>{TWO}</p></div>"), None) == f"{ONE.strip()}\n{TWO.strip()}"


@pytest.mark.parametrize("wrap", ["<form action=/x>{}</form>", "<aside>{}</aside>", "<dialog open>{}</dialog>", "<div style='display:none'>{}</div>"])
def test_a_page_inside_a_form_or_the_like(wrap):
    for inner in (f"<article><h1>T</h1><p>{ONE}</p></article>", f"<div><h1>T</h1><p>{ONE}</p></div>"):
        page = body_of("<nav><a href=/>Home</a></nav>", wrap.format(inner))
        assert html.extracted(page, None) == "T\n" + ONE.strip()
    beside = body_of(f"<article><p>{ONE}</p></article>", wrap.format(f"<p>{TWO * 9}</p>"))
    assert html.extracted(beside, None) == ONE.strip()
    small = body_of(f"<div><p>{ONE * 9}</p></div>", wrap.format(f"<p>{TWO}</p>"))
    assert html.extracted(small, None) == " ".join((ONE * 9).split())


def test_a_hidden_body_is_read():
    page = f"<html><body style='visibility:hidden'><article><p>{ONE}</p></article></body></html>"
    assert html.extracted(page, None) == ONE.strip() == html.extracted(page.replace("article", "div"), None)


def test_host_of_several_templates(spark):
    """A box with the host's path beside, or inside, a longer text on pages of another template; a box of the template."""
    short, text = "short " * 60, "long text " * 90

    def page(*parts):
        return body_of(f"<div class=box><p>{short}</p></div>", *parts)

    pages = [page("<div class=tip>tip</div>")] * 4
    pages += [page(f"<div class=story><p>{text}</p></div>"), page(f"<div class=tip><p>{short}{short}</p></div>")]
    pages += [body_of(f"<div class=story><p>{text}</p><div class=box><p>{short}</p></div></div>")]
    rows = [(i, "https://a.example/x", p, None, None, None) for i, p in enumerate(pages)]
    found = {r.page_id: r.text for r in html.main_texts(spark.createDataFrame(rows, PAGES)).collect()}
    assert found[0] == short.strip() + "\ntip" and found[5] == short.strip() + "\n" + (short + short).strip()
    assert found[4] == short.strip() + "\n" + text.strip()
    assert found[6] == text.strip() + "\n" + short.strip()


@pytest.mark.parametrize("part", ["<a ", "<!--", "<!x ", "<p", "</", "<div>", "<a b='", "&amp", "<b><p>", "<script>"])
def test_long_and_broken_markup(part):
    html.extracted(part * 20_000, None)


def test_digest_counts_code_points(spark):
    found = html.digest(spark.createDataFrame([(1, "u", "é\U0001f600")], "page_id long, url string, text string"))
    assert found.select(F.max("n_chars")).first()[0] == 2
