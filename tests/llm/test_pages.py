import base64
import hashlib
import os

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from korpusflow.llm import html, warc

SF = "/root/testdata/sf0.01"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def warc_brute(rows, min_bytes=0):
    largest, n = {}, {}
    for page_id, _, text in rows:
        key = hashlib.sha1((text or "").encode()).digest()
        n[key] = n.get(key, 0) + 1
        if page_id is not None:
            largest[key] = max(largest.get(key, page_id), page_id)
    out = []
    for page_id, _, text in rows:
        raw = (text or "").encode()
        key = hashlib.sha1(raw).digest()
        to = largest.get(key) if len(raw) >= min_bytes and n[key] > 1 and largest.get(key) != page_id else None
        out.append((page_id, len(raw), base64.b32encode(key).decode(), "response" if to is None else "revisit", to))
    return sorted(out, key=str)


def test_archive_round_trip(spark):
    rows = [(1, "http://www.a.example/x?b=1", "<p>é</p>"), (2, "https://a.example/x", "<p>é</p>"), (3, None, None), (4, "http://b c/ d", ""), (5, "nohost", "<b>\r\n\r\n</b>"), (None, "http://z/", "<p>é</p>"), (2, "https://a.example/x", "<p>é</p>"), (7, "http://[bad", "y" * 100_000)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, file string").repartition(3)
    for min_bytes in (0, 5):
        got = sorted((tuple(r) for r in warc.archive_and_read(df, min_bytes).collect()), key=str)
        assert got == warc_brute(rows, min_bytes)
    assert warc.archive_and_read(df.limit(0)).count() == 0


def test_lookup_over_many_blocks(spark, tmp_path):
    rows = [(i, f"http://h{i % 7}.example/p/{i // 3}", f"page {i}") for i in range(400)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    folder = f"file://{tmp_path}"
    directory = warc.build_index(warc.write_archives(df, folder), folder, block_captures=7, page_blocks=4)
    assert directory.agg({"blocks": "sum"}).first()[0] > 40 and directory.count() > 10
    asked = [(i, warc.url_key(rows[i * 5][1])) for i in range(80)] + [(1000, "com,none)/"), (None, "x"), (1001, None)]
    got = {}
    for r in warc.lookup(spark.createDataFrame(asked, "lookup_id long, capture_key string"), directory, folder).collect():
        got.setdefault(r.lookup_id, set()).add(r.page_id)
    assert got == {i: {r[0] for r in rows if warc.url_key(r[1]) == key} for i, key in asked[:80]}


def test_spaces_in_keys(spark):
    ends = ["a b", "a!b", "a$b", 'a"b', "a%20b", "a b c", "a!", "a", "a  b", "a#b", "a%b", "a'b"]
    rows = [(i, f"http://h/{x}", f"page {i}") for i, x in enumerate(ends)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert sorted((tuple(r) for r in warc.archive_and_read(df).collect()), key=str) == warc_brute(rows)


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(st.sampled_from(list("ab/?&=% !\"#$'+,-.\n\t\r\x0b\x1fé~")), max_size=6), min_size=20, max_size=60))
def test_odd_urls(spark, ends):
    rows = [(i, f"http://h.example/{x}", f"page {i % 9}") for i, x in enumerate(ends)] + [(1000, "\n", "x"), (1001, " ", "y"), (1002, "http://h.example", "z")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert sorted((tuple(r) for r in warc.archive_and_read(df).collect()), key=str) == warc_brute(rows)


def test_long_and_common_payloads(spark):
    rows = [(i, f"http://h/{i}", "common" if i % 2 else ("long é" * 700_000 if i == 2 else f"own {i}")) for i in range(1500)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(6)
    assert sorted((tuple(r) for r in warc.archive_and_read(df).collect()), key=str) == warc_brute(rows)


@needs_tables
def test_warc_query(spark):
    from korpusflow.llm.registry import QUERIES

    rows = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    assert sorted((tuple(r) for r in QUERIES["op3_warc"](spark, SF).collect()), key=str) == warc_brute(rows)


PAGE = """<html><head><title>T</title><style>p{}</style><script>var a="</p><p>no";</script></head><body>
<header><h1>Site</h1></header><nav><a href=/>Home</a></nav><div class="cookie-notice">We use cookies on the site.</div>
<article><header><h1>The &eacute;vent</h1></header><p>One of   the<br>lines &amp; more.</p><aside>See also</aside><form><label>Name</label></form>
<p>Be.</p><ul><li>first</li><li>second</li></ul><section id="comments"><p>Nice one of the best!</p></section></article>
<footer>&copy; all rights</footer></body></html>"""


def test_main_text(spark):
    rows = [(1, "u", PAGE), (2, None, None), (3, "v", ""), (4, "w", "<article><p>cut &am"), (5, "x", "<div class=ad>buy</div><p>only <a href=1>link</a"), (None, "y", "<p>" * 2000 + "deep"), (1, "u", PAGE)]
    df = spark.createDataFrame([(*r, 3) for r in rows], "page_id long, url string, html string, text int")
    got = {(r.page_id, r.url): r for r in html.main_text(df).collect()}
    assert got[1, "u"].text == "The évent\nOne of the lines & more.\nBe.\nfirst\nsecond"
    assert got[2, None].text == "" and got[3, "v"].n_chars == 0 and got[4, "w"].text == "cut &am"
    assert html.main_text(df).count() == 7 and html.main_text(df.limit(0)).count() == 0


def test_density_rules_without_an_article():
    long = "The quick brown fox is in the house and it was on the way to the market with all of that."
    page = f"<body><div><a href=1>Home</a> <a href=2>About us</a></div><h2>Title</h2><p>{long}</p><p>Short.</p><p>{long}</p><div><a href=3>More stories from the archive</a></div></body>"
    assert html.extract(page) == f"Title\n{long}\nShort.\n{long}"


LONG = "The quick brown fox is in the house and it was on the way to the market with all of that."


def test_names_alone_do_not_drop_text():
    for part, want in (
        (f'<p class="legal">{LONG}</p>', LONG),
        ('<p class="legal">Short.</p>', "Short."),
        ('<header class="entry-header"><h2>Title</h2></header>', "Title"),
        ('<h1 class="page-header">Title</h1>', "Title"),
        ("<p>The sum <math><mi>x</mi><mo>+</mo><mn>1</mn></math> of the parts is<script>a()</script> here.</p>", "The sum x+1 of the parts is here."),
        ("<p>See <object data=x><b>the</b> object</object> and <video src=y>no player</video> it.</p>", "See the object and it."),
        (f'<section id="comments"><p>{LONG}</p></section>', ""),
        (f'<article class="comment"><p>{LONG}</p></article>', ""),
        (f"<aside><p>{LONG}</p></aside><form><p>{LONG}</p></form><div class=ad>{LONG}</div>", ""),
        ("<ul><li><a href=1>One</a></li><li><a href=2>Two</a></li><li><a href=3>Three</a></li></ul>", ""),
        ("<p><a href=1>One source</a></p>", "One source"),
        (f"<a href=1><div>{LONG}</div></a>", ""),
        (f"<p><a name=top>{LONG}</p>", LONG),
    ):
        for page in (f"<article><p>{LONG}</p>{part}<p>{LONG}</p></article>", f"<body><nav><a href=1>x</a></nav><main><p>{LONG}</p>{part}<p>{LONG}</p></main><footer>{LONG}</footer>"):
            assert html.extract(page) == "\n".join([LONG, *([want] if want else []), LONG]), part


def test_pages_without_an_article():
    teaser = f"<a href=1><div>{LONG}</div></a>"
    words = "Tõepoolest kõik sõnad siin lauses kuuluvad hoopis teise keelde " * 4
    for body, want in (
        (f"<div>{teaser}{teaser}</div><h2>Title</h2><p>{LONG}</p><p>Be.</p><p>{LONG}</p>", f"Title\n{LONG}\nBe.\n{LONG}"),
        (f"<div class=menu>{LONG}</div><div>Home</div><p>{LONG}</p>", f"Home\n{LONG}"),
        (f"<div><a href=1>Home</a></div><div>Log</div><div><a href=1>About</a></div><p>{LONG}</p>", LONG),
        (f"<p>{words}</p>", words.strip()),
        (f"<header>{LONG}</header><div class=header>{LONG}</div>", ""),
    ):
        assert html.extract(f"<body>{body}</body>") == want, body
    assert len(html.extract("<article>" + f"<p>{LONG}</p>" * 20_000)) == 20_000 * (len(LONG) + 1) - 1


def test_each_rule_changes_results(monkeypatch):
    page = f"<body><div><a href=1>Home</a> now</div><p>{LONG}</p><div>{'Xyz Abc ' * 9}</div><p>{LONG}</p><p>ok</p><div><a href=2>{LONG}</a></div>"
    plain = html.extract(page)
    for rule, value in (("STOPS_AT_LEAST", 0.0), ("LINKS_AT_MOST", 2.0), ("MIN_LONG", 10_000)):
        with monkeypatch.context() as m:
            m.setattr(html, rule, value)
            assert html.extract(page) != plain, rule
    monkeypatch.setattr(html, "nearest", lambda found: [(None, 0)] * len(found))
    assert html.extract(page) != plain


@needs_tables
def test_html_query_keeps_articles_only(spark):
    import re
    from html import unescape

    from korpusflow.llm.registry import QUERIES

    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in QUERIES["op7_html"](spark, SF).collect():
        inside = re.search(r"<article>(.*?)(?:</article>|\Z)", pages[r.page_id].html, re.S)[1]
        want = [" ".join(unescape(re.sub(r"<[^>]*>?", "", x)).split()) for x in re.split(r"</?p>|<br>|</?h1>", inside)]
        assert r.text == "\n".join(x for x in want if x) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


def test_stores_are_opened_by_the_name_that_arrow_has():
    from korpusflow.llm import warc

    assert [warc.store_uri(u) for u in ("s3a://b/x", "wasbs://c/x", "file:///tmp/x", "/tmp/x")] == ["s3://b/x", "abfs://c/x", "file:///tmp/x", "/tmp/x"]


LONG = "It was one of the days on which they had to go to the sea and the wind was not with them, as it had been for a week."


@pytest.mark.parametrize("page, want", [
    (f'<article><p>{LONG}</p><p class="comments">{LONG} A</p></article>', f"{LONG}\n{LONG} A"),
    (f'<article><p>{LONG}</p><div class="comments"><p>{LONG} A</p></div></article>', LONG),
    (f'<article><h2>Dinner</h2><section class="menu"><p>{LONG}</p><p>Home</p></section></article>', f"Dinner\n{LONG}"),
    (f'<article><p>{LONG}</p><div class="menu"><a href="x">Home</a> <a href="y">News</a></div></article>', LONG),
    (f'<div class="subscriber-story"><p>{LONG}</p></div>', LONG),
    (f'<article><p>{LONG}</p></article><div><p>{LONG} B</p></div>', LONG),
    (f'<article><p>A short teaser of it.</p></article><div><p>{LONG} B</p><p>{LONG} C</p></div>', f"{LONG} B\n{LONG} C"),
    (f'<article><p>{LONG}</p></article><div><p>{LONG} B</p><p>{LONG} C</p><p>{LONG} D</p></div>', f"{LONG} B\n{LONG} C\n{LONG} D"),
    (f'<article><p>{LONG}</p></article><div class="cookie-notice"><p>{LONG} B</p><p>{LONG} C</p><p>{LONG} D</p></div>', LONG),
    ("<article><p>foo <i>x</i> <br>bar</p></article>", "foo x bar"),
    ("<article><p>foo <i>x</i> <br> <br>bar</p><p>foo<br><br>bar</p></article>", "foo x bar\nfoo\nbar"),
])
def test_names_and_articles_are_evidence(page, want):
    assert html.extract(page) == want


@pytest.mark.parametrize("rule, value", [("STOPS_AT_LEAST", 1.1), ("MIN_LONG", 10**6), ("LINKS_AT_MOST", 2.0), ("MORE_OUTSIDE", 10**6)])
def test_each_rule_decides(monkeypatch, rule, value):
    links = "".join(f'<p><a href="{i}">The links of the page and of the day {i}</a></p>' for i in range(4))
    pages = [f"<div><p>{LONG}</p><p>Short.</p>{links}</div>", f"<article><p>{LONG}</p></article><div><p>{LONG} A</p><p>{LONG} B</p><p>{LONG} C</p></div>", f"<article><p>{LONG}</p>{links}</article>"]
    before = [html.extract(p) for p in pages]
    monkeypatch.setattr(html, rule, value)
    assert [html.extract(p) for p in pages] != before
