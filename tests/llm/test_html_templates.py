"""Template removal against a brute-force count, and what an article keeps."""

import re

from lexmill.llm import html_text


def page(host, i, body):
    return (i, f"http://{host}/{i}", f"<html><head><title>t</title></head><body>{body}</body></html>")


def brute(pages, least, share):
    """Subtrees on many different pages of their host, counted one by one."""
    seen, of = {}, {}
    for _, url, html in pages:
        host = re.match(r"http://([^/]*)", url)[1]
        of.setdefault(host, set()).add(html)
        for tree in {h for h, may in html_text.parse(html)[1] if may}:
            seen.setdefault((host, tree), set()).add(html)
    return {k for k, v in seen.items() if len(v) >= least and len(v) >= share * len(of[k[0]])}


def test_templates_match_brute_force_whatever_their_names(spark):
    box = "<div><div class='x'><h3>From the shop</h3><ul><li>one</li><li>two</li></ul></div></div>"
    said = "<p>This sentence of the site stands below every story.</p>"
    pages = [page("big.com", i, f"{box}<section><p>Story {i} tells of {i * 7}.</p><p>Yes.</p></section>{said if i % 2 else ''}") for i in range(40)]
    pages += [page("small.com", 100 + i, f"{box}<p>Story {i}</p>") for i in range(3)]
    pages += [page("copies.com", 200 + i, "<div><p>The same page again and again, with one text.</p></div>") for i in range(30)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    for least, share in ((4, 0.002), (4, 0.6), (41, 0.0)):
        got = {(r.host, r.tree) for r in html_text.site_templates(df, least_pages=least, share=share).collect()}
        assert got == brute(pages, least, share)
    by = {r.page_id: r.text for r in html_text.extract_pages(df).collect()}
    assert by[7] == "Story 7 tells of 49.\nYes." and by[8] == "Story 8 tells of 56.\nYes."
    assert by[101] == "From the shop\none\ntwo\nStory 1" and by[205] == "The same page again and again, with one text."
    assert html_text.extract_pages(df.limit(0)).count() == 0


def test_an_article_keeps_its_own_parts(spark):
    inside = "<div class='entry-header'><h1>Title</h1></div><div class='side-note related-work'>Note</div><header class='header'>By me</header><p class='share'>Share of it</p>"
    out = "<div class='ads'>buy</div><div class='comments'>reader</div><nav>menu</nav><form>f</form><div class='sidebar'>s</div>"
    long = "word " * 60_000
    pages = [(1, "http://a.b/1", f"<article>{inside}{out}<p>End</p></article>"), (2, "http://a.b/2", f"<main><p>{long}</p></main>"), (3, "http://a.b/3", "<p>a &amp;&#x41; <b>b</b>")]
    by = {r.page_id: (r.text, r.n_chars) for r in html_text.extract_pages(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert by[1][0] == "Title\nNote\nBy me\nShare of it\nEnd"
    assert by[2] == (long.strip(), len(long.strip())) and by[3][0] == "a &A b"
