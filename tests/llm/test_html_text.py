import random
import re
from contextlib import contextmanager

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from granary.llm import html_text
from granary.llm.common import saved
from granary.llm.html_text import Lines, blocks, compared, extracted, shared_lines


def texts(page):
    return [(b.text, b.main, b.furniture) for b in blocks(page)]


def main(page):
    """As if the corpus shared all slots of the page."""
    found = blocks(page)
    return html_text.main_text(found, set(), {b.slot for b in found if b.slot})


def test_article_alone_is_kept():
    page = """<!DOCTYPE html><html><head><title>T</title><script>var t="</p><p>no";</script></head><body><header>Site</header><nav><ul><li><a href="/">Menu</a></li></ul></nav><!-- <p>gone</p> -->
    <div class="ad">Buy</div><article><header><h1>The &amp;amp; title</h1><div class="byline">By me</div></header><p>One&nbsp; two<br>three <b>bold</b>x</p><p>Open <i>tag<p>next &#8212; &lt;b&gt;
    <aside>Side</aside><form>Form <input> <button>Go</button></form><div class="cookie-notice">We use</div><ul><li>a<li>b</ul><section id="comments"><p>Reader</p></section><style>p{}</style></article><footer>&copy; x</footer>"""
    assert main(page) == "The &amp; title\n\nOne two three boldx\n\nOpen tag\n\nnext — <b>\n\na\n\nb"


def test_lenient_about_odd_pages():
    assert texts(None) == texts("") == texts("<p> \n </p>") == []
    assert main("<p>1 < 2 & 3 > 2 &unknown; <") == "1 < 2 & 3 > 2 &unknown; <"
    assert main("</p></div>a<article>b</article></article>c") == "a\n\nb\n\nc"
    assert main("<script>never closed <p>x") == ""
    assert main("<p title='a>b'>x</p><img alt=\"<p>y\">z") == "x\n\nz"
    assert main("<P>UPPER</P><DIV CLASS=Sidebar>s</DIV>") == "UPPER"
    assert len(main("<p>" + "long " * 200_000)) == 999_999
    assert main("<div>" * 3_000 + "deep") == "deep"


def lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            t[i + 1][j + 1] = t[i][j] + 1 if a[i] == b[j] else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def is_subsequence(x, b):
    it = iter(b)
    return all(v in it for v in x)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 5), max_size=25), st.lists(st.integers(0, 5), max_size=25), st.sampled_from([1 << 27, 20]))
def test_alignment_is_a_longest_common_subsequence(a, b, bits):
    before, html_text.TABLE_BITS = html_text.TABLE_BITS, bits
    try:
        at = shared_lines(a, b)
    finally:
        html_text.TABLE_BITS = before
    assert at == sorted(set(at)) and len(at) == lcs(a, b) and is_subsequence([a[i] for i in at], b)


def test_copies_have_no_say():
    pages = [([1, 7, 8, 4], 90), ([1, 2, 3, 4], 90), ([1, 2, 3, 4], 90), ([1, 9], 5), ([9], 5)]
    rows = [{"row": i, "range": 0, "host": "a", "halo": False, "keys": k, "sizes": [5, *[n] * (len(k) - 2), 5][: len(k)]} for i, (k, n) in enumerate(pages)]
    got = list(compared(rows))
    # a thin page that shares much of its own text is no copy
    assert [r["at"] for r in got] == [None, [0, 3], [0, 3], [0], [0]] and [r["start"] for r in got] == [True, True, False, True, True]
    assert not any(r["open"] for r in got)
    late = list(compared([rows[1] | {"halo": True}, rows[2], rows[3]]))
    assert [(r["row"], r["open"], r["at"]) for r in late] == [(2, True, None), (3, False, [0])]


def test_slots_are_named_and_stand_as_one_line():
    found = blocks("<div class='Promo-12 x'>a<p>b</p></div><nav><ul><li>c<li>d</ul></nav><p>e</p><div id='page7'><p>" + "long text " * 9 + "</p></div>")
    assert [b.slot for b in found] == ["div.promo.x", "div.promo.x", "nav", "nav", None, None]
    assert html_text.line_numbers(found) == [0, 0, 1, 1, 2, 3]
    assert [b.slot for b in blocks("<article><p class='lead'>a</p><div class='comments'>b</div></article><p class='lead'>c</p>")] == [None, "div.comments", "p.lead"]


ADS = ["Buy now", "Sale", "Cheap", "Last chance", "New"]


def page(i, site, article, ad=True, body=()):
    """HTML and the parts from which a test can tell what must come out: (kind, text)."""
    parts = [("shared", f"Welcome to {site}"), ("nav", f"Home of {site}")]
    parts += [("ad", ADS[i % 5])] * ad
    parts += [("own", t) for t in body or (f"Own text {i} of {site}.", f"More {i * 31 % 1009} of that.")]
    parts += [("foot", f"Page {i}"), ("shared", f"Bottom of {site}")]
    tags = {"shared": "<div>{}</div>", "nav": "<nav><a>{}</a></nav>", "ad": "<div class='ad'>{}</div>", "own": "<p>{}", "foot": "<footer>{}</footer>"}
    html = "".join(("<article>" if article and k == 2 + ad else "") + tags[kind].format(t) for k, (kind, t) in enumerate(parts[: 2 + ad + len(body or (1, 1))]))
    return html + ("</article>" if article else "") + "".join(tags[kind].format(t) for kind, t in parts[-2:]), parts


def table(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in reversed(range(len(a))):
        for j in reversed(range(len(b))):
            t[i][j] = t[i + 1][j + 1] + 1 if a[i] == b[j] else max(t[i + 1][j], t[i][j + 1])
    return t


def brute(rows):
    """From the parts that pages were made of: all pages sorted, each compared by a plain table of common subsequences with
    the nearest on either side of its host that is no copy; nav and footer always go, an ad that a neighbour has too."""
    rows = sorted(rows, key=lambda r: (r["host"], r["path"], r["id"]))
    lines = [[f"<{kind}>" if kind in ("nav", "ad", "foot") else t for kind, t in r["parts"]] for r in rows]
    weight = lambda x: sum(len(t) for t in x if not t.startswith("<"))

    def common(a, b):
        """Length of the text that the two have in common, and the places in a."""
        t, i, j, at = table(a, b), 0, 0, []
        while i < len(a) and j < len(b):
            if a[i] == b[j] and t[i][j] == t[i + 1][j + 1] + 1:
                at.append(i)
                i, j = i + 1, j + 1
            elif t[i + 1][j] >= t[i][j + 1]:
                i += 1
            else:
                j += 1
        return at

    def copies(k, m):
        return 100 * weight([lines[k][i] for i in common(lines[k], lines[m])]) >= 80 * max(weight(lines[k]), weight(lines[m]))

    out = {}
    for k, r in enumerate(rows):
        same = lambda m: 0 <= m < len(rows) and rows[m]["host"] == r["host"]
        near = []
        for step in (-1, 1):
            m = k + step
            while same(m) and copies(m, m - step):
                m += step
            near += [m] * same(m)
        near = [m for m in near if not copies(k, m)]
        template = {i for m in near for i in common(lines[k], lines[m])}
        kept = [t for i, (kind, t) in enumerate(r["parts"]) if kind in ("own", "shared") and i not in template]
        if near and r["article"]:  # what stands in the article is restored
            kept = [t for i, (kind, t) in enumerate(r["parts"]) if kind == "own" or kind == "shared" and i not in template]
        out[r["id"]] = "\n\n".join(kept)
    return out


def test_pages_lose_what_neighbours_share(spark):
    rng = random.Random(7)
    rows = []
    for i in range(400):
        hot = i % 3
        host, path = ("hot.org", f"/{i % 7}/{i:05d}") if hot else (f"h{i % 5}.net", f"/{i:05d}")
        body = ("The same long story that many pages copy, word for word.", "It goes on and on, in copies.") if i % 10 in (3, 4) else ()
        html, parts = page(i, host, article=rng.random() < 0.3, body=body)
        rows.append({"id": i, "host": host, "path": path, "html": html, "parts": parts, "article": "<article>" in html})
    html, parts = page(1, "alone.org", False)
    rows.append({"id": 1002, "host": "alone.org", "path": "/", "html": html, "parts": [p for p in parts if p[0] != "ad"], "article": False})
    want = brute(rows)
    assert want[1] == "Own text 1 of hot.org.\n\nMore 31 of that."
    wide = [(r["id"], f"http://{r['host']}{r['path']}", r["html"], "x", 1, "y") for r in rows] + [(1000, None, "<p>x</p>", "x", 1, "y"), (1001, "bad", None, "x", 1, "y")]
    rng.shuffle(wide)
    want |= {1000: "x", 1001: ""}
    df = spark.createDataFrame(wide, "page_id long, url string, html string, text string, n_chars int, host string")
    for n in (1, 9):
        found = extracted(spark, df.repartition(n)).collect()
        assert {r["page_id"]: r["text"] for r in found} == want and len(found) == len(wide)
        assert all(r["n_chars"] == len(r["text"]) for r in found)


def test_differencing_decides_on_pages_with_an_article(spark, monkeypatch):
    """Without it, what marks name stays, and so does unmarked template."""
    rows = [(i, f"http://a.org/{i:03d}", page(i, "a.org", True)[0]) for i in range(30)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = {r["page_id"]: r["text"] for r in extracted(spark, df).collect()}
    assert all(found[i] == f"Own text {i} of a.org.\n\nMore {i * 31 % 1009} of that." for i in range(30))
    off = html_text.main_text(blocks(rows[3][2]), set(), set())
    assert off == "Welcome to a.org\n\nLast chance\n\nOwn text 3 of a.org.\n\nMore 93 of that.\n\nBottom of a.org"


def test_believed_marks_go_where_neighbours_lack_them_and_others_stay(spark):
    def html(i):
        mark = "<div class='comments'>Reader says " + str(i) + "</div>" if i < 20 or i == 35 else ""
        note = "<div class='notice'>A notice that is text.</div>" if i == 30 else ""
        return f"<article><p>Own {i} text.</p>{note}</article>{mark}<div>Bottom</div>"

    df = spark.createDataFrame([(i, f"http://a.org/{i:03d}", html(i)) for i in range(40)], "page_id long, url string, html string")
    found = {r["page_id"]: r["text"] for r in extracted(spark, df).collect()}
    assert found[35] == "Own 35 text." and found[5] == "Own 5 text." and found[30] == "Own 30 text.\n\nA notice that is text."


@contextmanager
def partitions(spark, n):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", n)
    try:
        yield
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("n", [1, 4, 20])
def test_runs_of_copies_and_thin_pages_lose_the_template(spark, n):
    menu = "".join(f"<div>Entry {k} of the menu of this site</div>" for k in range(12))
    rows = [(i, f"http://a.org/{i:03d}", f"{menu}<p>A copied story, the same on many pages.</p>") for i in range(40)]
    rows += [(i, f"http://a.org/{i:03d}", f"{menu}<p>Thin {i}</p>") for i in range(40, 60)]
    rows.append((60, "http://a.org/060", menu + "".join(f"<p>A long page, line {k} of very many, nothing of which is said elsewhere.</p>" for k in range(40))))
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    with partitions(spark, n):
        found = {r["page_id"]: r["text"] for r in extracted(spark, df).collect()}
    assert all(found[i] == f"Thin {i}" for i in range(40, 60)) and "Entry" not in found[60]
    assert all(found[i] == "A copied story, the same on many pages." for i in range(40))


@pytest.mark.parametrize("n", [1, 4, 20])
def test_runs_of_copies_over_the_edges_of_ranges(spark, n):
    """The pages beside a run decide, however far from a page they are and however ranges cut the run."""
    story = lambda i: "".join(f"<p>Story {i // 8}, line {k}, which eight pages in a row have.</p>" for k in range(9))
    rows = [(i, f"http://a.org/{i:03d}", f"<div>Top of the site</div>{story(i)}<div>Bottom, {'odd' if i % 16 < 8 else 'even'}</div>") for i in range(40)]
    rows += [(100 + i, f"http://b.org/{i:03d}", f"<div>Only copies here</div>{story(0)}") for i in range(20)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    with partitions(spark, n):
        found = {r["page_id"]: r["text"] for r in extracted(spark, df).collect()}
    for i in range(40):
        assert found[i] == "\n\n".join([*(f"Story {i // 8}, line {k}, which eight pages in a row have." for k in range(9)), f"Bottom, {'odd' if i % 16 < 8 else 'even'}"])
    assert all(found[100 + i].startswith("Only copies here") for i in range(20))


def test_on_the_given_pages_differencing_alone_decides(spark, monkeypatch):
    """No word list is needed, and without neighbours the advert of every page stays."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    rows = {r["page_id"]: r for r in pages.collect()}
    clean = {i: html_text.main_text([b for b in blocks(re.search("<article>.*</article>", r["html"], re.S)[0])], set(), set()) for i, r in rows.items()}
    monkeypatch.setattr(html_text, "MARKS", set())
    assert {r["page_id"]: r["text"] for r in extracted(spark, pages).collect()} == clean
    monkeypatch.setattr(html_text, "shared_with_neighbours", lambda light, n: saved(spark.createDataFrame([], "row long, at array<int>"), "none"))
    off = {r["page_id"]: r["text"] for r in extracted(spark, pages).collect()}
    assert all(off[i] != clean[i] for i in clean)


def test_repeated_rows_null_ids_and_empty_table(spark):
    rows = [(None, "http://a.org/1", "<p>a</p>")] * 6 + [(1, None, None)] * 2
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert sorted((r["page_id"] is None, r["text"]) for r in extracted(spark, df).collect()) == [(False, "")] * 2 + [(True, "a")] * 6
    assert extracted(spark, df.limit(0)).collect() == []


def test_text_outside_the_article_is_decided_by_differencing(spark):
    def with_teaser(i):
        return f"<div>Site name</div><article><p>Teaser {i}.</p><p>Quoted.</p></article><div>Body text {i} beside the teaser.</div><div class='ad'>Ad {i}</div><div>Bottom</div>"

    rows = [(i, f"http://a.org/{i}", with_teaser(i)) for i in range(40)] + [(99, "http://alone.org/", with_teaser(99))]
    found = {r["page_id"]: r["text"] for r in extracted(spark, spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(found[i] == f"Teaser {i}.\n\nQuoted.\n\nBody text {i} beside the teaser." for i in range(40))
    assert found[99] == "Site name\n\nTeaser 99.\n\nQuoted.\n\nBody text 99 beside the teaser.\n\nBottom"  # nothing to compare with; the slot goes
