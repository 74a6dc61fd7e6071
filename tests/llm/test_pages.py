"""URL filter, HTML extraction, WARC."""

import gzip
import hashlib
import random
import tracemalloc

import pytest
from pyspark.sql import functions as F

from .conftest import key
from tillroll.llm import html_text, urls, warc

PAGES = "page_id long, url string, html string, host string, rule string, slot string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], PAGES).repartition(3)


# -------------------------------------------------------------------- url

URLS = [
    (1, "http://www.example.org/es/1"), (2, "https://example.org/en/12?x#y"), (3, "http://EXAMPLE.ORG/en/2"),
    (4, "http://a.example.com/fr/3"), (5, "http://b.example.com/de/"), (6, "http://notexample.org/es/"), (7, None),
    (8, "no scheme"), (9, "http://cheappills.example.net/en/5"), (10, "https://freecasino-bets.example.net?q=1"),
    (11, "http://quiet.example.net/en/7"), (11, "http://quiet.example.net/en/7"), (None, "http://Host.net#frag"),
    (13, "http://h.org"), (14, "x://" + "a" * 300 + ".net/p"), (15, "http://org/x"), (16, "a://b://c/d"),
]


def brute_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, tail = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
    return host, tail[:min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]


def test_url_rules(spark):
    got = sorted(((r.page_id, r.host, r.path, r.rule) for r in urls.judge_urls(frame(spark, [(*u, None) for u in URLS])).collect()), key=key)
    want = []
    for i, u in URLS:
        host, path = brute_parts(u)
        fits = [h + p for _, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        want.append((i, host, path, max(fits, key=len, default=None)))
    assert got == sorted(want, key=key)


def test_url_verdicts(spark):
    rows = {r.page_id: r for r in urls.judge_urls(frame(spark, [(*u, None) for u in URLS])).collect()}
    assert rows[1].verdict == rows[2].verdict == rows[5].verdict == "block"
    assert rows[3].verdict == rows[4].verdict == rows[13].verdict == "allow"
    assert rows[9].host_words[:2] == ["cheap", "pills"] and rows[9].verdict == "block"
    assert rows[10].host_words[:3] == ["free", "casino", "bets"] and rows[10].verdict == "block"
    assert rows[11].verdict == rows[7].verdict == "allow"
    assert urls.judge_urls(frame(spark, [(1, "u", None)]).limit(0)).count() == 0


def test_viterbi():
    counts = {"cheap": 40, "pills": 30, "pill": 20, "s": 1}
    assert urls.viterbi("cheappills", counts, 1000.0) == ["cheap", "pills"]
    assert urls.viterbi("zzz", counts, 1000.0) == ["zzz"]
    assert "".join(urls.viterbi("q" * 200, counts, 1000.0)) == "q" * 200


def test_clean_hosts_that_hold_listed_words(spark):
    clean = "essex alphabet freedom farmington farming sussex trackside beads winter freestyle".split()
    bad = "ads-track adult-x freebets spamfarm casinowin cheappills".split()
    rows = [(i, f"http://{w}.example.net/{p}/{i}", None) for i, w in enumerate(clean + bad) for p in ("es", "en")]
    got = {r.page_id: r for r in urls.judge_urls(frame(spark, rows)).collect()}
    for i, w in enumerate(clean):
        assert got[i].host_words[0] == w or w == "trackside"
        assert got[i].verdict == "allow"
    assert [got[len(clean) + i].verdict for i in range(len(bad))] == ["block"] * len(bad)
    one = urls.judge_urls(frame(spark, [(1, "http://freedom.net/es/", None), (2, "http://trackside.net/es/", None)]))
    assert {r.verdict for r in one.collect()} == {"allow"}


# ------------------------------------------------------------------- html

def text(html, slot=None, template=()):
    return html_text.main_text(html, slot, set(template))


@pytest.mark.parametrize(("html", "want"), [
    ("", ""), ("plain", "plain"), ("a &amp; b&nbsp;c &lt;x&gt;", "a & b c <x>"),
    ("<p>one<p>two <b>bo</b>ld<br>next", "one two bold next"),
    ("<nav>menu</nav><main><h1>T</h1><p>x</p><aside>s</aside></main><footer>f</footer>", "T x"),
    ("<article><script>var t='</p>';</script><p><b>open<br><p>y</article> tail", "open y"),
    ("<div class='sidebar x'>s</div><div id=cookie-notice>c</div><p>text</p>", "text"),
    ("<article><p>t</p><section class='comments'><p>reader</p></section></article>", "t"),
    ("<style>p{}</style><!-- <p>no</p> --><form>f<input></form><p title=\"a > b\">yes", "yes"),
    ("<ul><li>a<li>b</ul><table><tr><td>c<td>d</table>", "a b c d"),
    ("1 < 2 and <b", "1 < 2 and <b"), ("<p>x</div></p></b>y", "x y"), ("<script>never closed <p>x", ""),
])
def test_main_text(html, want):
    assert text(html) == want


def test_deep_and_long_pages():
    assert text("<div>" * 5000 + "deep" + "</div>" * 5000) == "deep"
    html_text.Tree(html_text.Page("<div>" * 5000 + "deep"))
    assert len(text("<article>" + "<p>word</p>" * 20_000)) == 5 * 20_000 - 1


def test_simple_tree_matching():
    def shape(html):
        return html_text.Tree(html_text.Page(html)).shape()

    a, b = shape("<div><p>x</p><ul><li>1</li></ul></div>"), shape("<div><h1>t</h1><p>y</p><ul><li>2</li></ul></div>")
    pairs = html_text.align(a, b)
    assert len(pairs) == len(a.split(" "))
    assert html_text.align(a, a) == tuple((i, i) for i in range(len(a.split(" "))))


def brute_pairs(shape_a, shape_b):
    """The size of the largest matching, by the recursion on forests."""
    la, ca = html_text._children(shape_a)
    lb, cb = html_text._children(shape_b)

    def forests(x, y):
        if not x or not y:
            return 0
        best = max(forests(x[:-1], y), forests(x, y[:-1]))
        if la[x[-1]] == lb[y[-1]]:
            best = max(best, forests(x[:-1], y[:-1]) + 1 + forests(ca[x[-1]], cb[y[-1]]))
        return best

    return 1 + forests(ca[0], cb[0])


@pytest.mark.parametrize("cells", [html_text.MAX_CELLS, 4])
def test_alignment_against_brute_force(monkeypatch, cells):
    monkeypatch.setattr(html_text, "MAX_CELLS", cells)  # 4: tables are cut
    html_text.align.cache_clear()
    r = random.Random(cells)

    def shape():
        out, above = ["-1:#"], [0]
        for k in range(1, r.randint(1, 9)):
            while len(above) > 1 and r.random() < 0.45:
                above.pop()
            out.append(f"{above[-1]}:{r.choice('ab')}")
            above.append(k)
        return " ".join(out)

    for _ in range(300):
        a, b = shape(), shape()
        pairs = html_text.align(a, b)
        assert len(pairs) == brute_pairs(a, b), (a, b)
        to = dict(pairs)
        label_a, label_b = html_text._children(a)[0], html_text._children(b)[0]
        above_a, above_b = ([int(x.split(":")[0]) for x in s.split(" ")] for s in (a, b))
        assert sorted(to.values()) == [y for _, y in pairs] and len(to) == len(pairs)  # order
        assert all(label_a[x] == label_b[y] and (not x or to[above_a[x]] == above_b[y]) for x, y in pairs)
    html_text.align.cache_clear()


def test_alignment_of_long_pages():
    def page(seed):
        r = random.Random(seed)
        return "".join(f"<h2>head {i}</h2><p>{'words ' * 6}</p>" if r.random() < 0.9 else "<ul><li>x</ul>" for i in range(3600))

    shapes = [html_text.Tree(html_text.Page("<body><div>" + page(s) + "</div></body>")).shape() for s in (1, 2)]
    assert len(page(1)) > 190_000
    tracemalloc.start()
    pairs = html_text.align(*shapes)
    assert len(pairs) > 6000 and html_text.align(shapes[0], shapes[0])[-1][0] == shapes[0].count(" ")
    assert tracemalloc.get_traced_memory()[1] < 100e6
    tracemalloc.stop()


def test_articles_keep_their_constant_text(spark):
    # headings that all articles of a site have, the first before any varying text
    want = {i: f"Background {prose(i)} Summary {prose(i + 50)}" for i in range(6)}
    got = site(spark, [f"<body><div>Home</div><article><h2>Background</h2><p>{prose(i)}</p><h2>Summary</h2><p>{prose(i + 50)}</p></article></body>"
                       for i in range(6)])
    assert got == want
    # a paragraph that all articles share, at the start, inside and at the end
    shared = "This paragraph stands in every article of the site."
    for place in range(3):
        parts = [[f"<p>{prose(i)}</p>", f"<p>{prose(i + 50)}</p>"] for i in range(4)]
        for p in parts:
            p.insert(place, f"<p>{shared}</p>")
        got = site(spark, [f"<body><div>Home</div><article>{''.join(p)}</article></body>" for p in parts])
        assert got == {i: text("".join(p)) for i, p in enumerate(parts)}
    # near copies of one article
    lines = "".join(f"<p>{prose(k)}.</p>" for k in range(5))
    got = site(spark, [f"<body><article>{lines}<p>copy {i}</p></article></body>" for i in range(8)])
    assert got == {i: f"{text(lines)} copy {i}" for i in range(8)}
    # headings of flat pages, between varying text
    got = site(spark, [f"<body><p>{prose(i)}</p><h2>Summary</h2><p>{prose(i + 50)}</p></body>" for i in range(6)])
    assert got == {i: f"{prose(i)} Summary {prose(i + 50)}" for i in range(6)}


def test_article_blocks():
    def kept(blocks, held=True):
        return html_text.article_blocks(blocks, held)

    head, own, label = ("Summary", True, "h2"), ("own", False, "p"), ("Share this", True, "p")
    assert kept([]) == kept([], False) == [] and kept([head, label]) == ["Summary", "Share this"]
    assert kept([label, head, own, label]) == ["Summary", "own"]
    assert kept([own, label, own, head]) == ["own", "Share this", "own"]
    assert kept([head, own, ("We are here to help.", True, "p")], False) == ["own"]
    assert kept([own, ("We are here to help.", True, "p")]) == ["own", "We are here to help."]
    assert kept([own, ("x" * html_text.LONG_TEXT, True, "div"), ("漢字。", True, "div"), ("Ads", True, "div"), own])[1:3] == [
        "x" * html_text.LONG_TEXT, "漢字。"]


def test_hot_groups_are_dealt_out(spark):
    """One layout of one host holds nine tenths of the pages."""
    rows = [(i, "http://hot.net/", f"<body><div>Menu</div><div><p>{prose(i)}</p></div></body>") for i in range(900)]
    rows += [(1000 + i, f"http://cold{i}.net/", f"<body><p>{prose(i)}</p></body>") for i in range(100)]
    out = html_text.extract(frame(spark, rows))
    assert {x.page_id: x.text for x in out.collect()} == {i: prose(i % 1000) for i, *_ in rows}
    groups = spark.createDataFrame([("hot", 1)] * 900 + [(f"cold{i}", 1) for i in range(100)], "host string, layout long")
    hot = html_text.Dealt(groups)
    found = {(r.host, r.deal): r.n for r in hot.rows(groups, F.monotonically_increasing_id()).groupBy("host", "deal").agg(F.count("*").alias("n")).collect()}
    most = [n for (h, _), n in found.items() if h == "hot"]
    assert len(most) == hot.parts and max(most) <= 2 * 900 / hot.parts
    assert {(r.host, r.deal) for r in hot.copies(groups.distinct()).collect()} >= set(found)


def test_wrapper_drops_the_template(spark):
    """Pages without telling names: what is constant goes."""
    r = random.Random(2)
    words = "sun moon star sky rain wind tree leaf".split()
    rows, want = [], {}
    for i in range(12):
        body = " ".join(r.choices(words, k=40)) + f" {i}"
        rows.append((i, "http://h.net/a", f"<body><div><span>Home | About</span></div><div><div>{body}</div></div><div>Copyright us</div></body>"))
        want[i] = body
    rows += [(100, "http://one.net/", "<body><div>only page</div></body>"), (101, None, None), (None, "http://h.net/b", ""),
             (102, "http://two.net/", "<p>same</p>"), (102, "http://two.net/", "<p>same</p>")]
    out = html_text.extract(frame(spark, rows)).collect()
    got = {x.page_id: x.text for x in out}
    assert {i: got[i] for i in want} == want
    assert got[100] == "only page" and got[101] == "" and got[102] == "same" and got[None] == ""
    assert len(out) == len(rows) and all(x.n_chars == len(x.text) for x in out)


def site(spark, pages):
    """The texts by page id of one host's pages."""
    rows = [(i, "http://site.net/a", html) for i, html in enumerate(pages)]
    return {x.page_id: x.text for x in html_text.extract(frame(spark, rows)).collect()}


def prose(i, n=30):
    r = random.Random(i)
    return " ".join("".join(r.choices("abcdefgh", k=5)) for _ in range(n))


def test_wrapper_decides_on_pages_with_articles(spark):
    card = "<article class=card><a class=more href=x><h3>Teaser {0}</h3></a></article>"
    got = site(spark, ["<body><div><a href=/>Home</a></div><div><div><p>" + prose(i) + "</p></div>" + card.format(i) + "</div></body>" for i in range(8)])
    assert all(prose(i) in got[i] and "Home" not in got[i] for i in range(8))
    # boilerplate inside every article, among its paragraphs too
    got = site(spark, [f"<body><article><div>Our house rules</div><p>{prose(i)}</p><p>{prose(i + 50)}</p><p>Share this page</p></article></body>"
                       for i in range(8)])
    assert got == {i: f"{prose(i)} {prose(i + 50)}" for i in range(8)}
    # a page without the slot, and copies that differ in their heads only
    got = site(spark, [*(f"<body><div><div><p>{prose(i)}</p></div></div><div>Imprint</div></body>" for i in range(8)), "<main>alone</main>"])
    assert got == {i: prose(i) for i in range(8)} | {8: "alone"}
    assert set(site(spark, [f"<title>{i}</title><body><article><p>copy</p></article>" for i in range(8)]).values()) == {"copy"}


@pytest.mark.parametrize("name", ["class='no-sidebar'", "class='x has-sidebar'", "class=social-history", "id='related-work'",
                                  "id=comment-on-x", "class='widget'", "id=related"])
def test_names_drop_no_article(spark, name):
    assert text(f"<body><div {name}><article><p>body</p></article></div></body>") == "body"
    assert text(f"<body><article {name}><p>body</p></article></body>") == "body"
    if "widget" not in name and name != "id=related":  # not names of other parts
        assert text(f"<body><div {name}><p>body</p></div></body>") == "body"


def test_names_drop_no_slot(spark):
    got = site(spark, [f"<body><p>Home</p><div class=widget><div id=related><p>{prose(i)}</p></div></div><div class=sidebar>s {i}</div></body>"
                       for i in range(8)])
    assert got == {i: prose(i) for i in range(8)}
    assert text("<article>t<section class=comments><article class=x>reader</article></section></article>") == "t"
    assert text("<article>t</article><div class=comments><article class=comment>reader</article></div>") == "t"


def test_every_layout_has_a_wrapper(spark):
    """More layouts on a host than references for all of its pages."""
    pages, want = [], {}
    for i in range(10 * 8):
        k, own = i % 10, prose(i)
        want[i] = own
        side = f"<div class=s{k}><p>Shared by layout {k}</p><p>{prose(1000 + i, 5)}</p></div>"
        body = f"<div class=c{k}><div class=d{k}><p>{own}</p><p>Tail of layout {k}</p></div></div>"
        pages.append(f"<body>{side * (k % 2)}{body}{side * (1 - k % 2)}</body>")
    assert site(spark, pages) == want


def test_layouts():
    def layout(html):
        return html_text.Tree(html_text.Page(html)).layout()

    assert layout("<body><div><p>a<h2>b</h2></div></body>") == layout("<body><div><p>a</div><div><ul><li>b</ul></div></body>")
    assert layout("<article><div>a</div></article>") == layout("<article>a</article>")
    assert layout("<div class=a>x</div>") != layout("<div class=b>x</div>")
    assert layout("") == layout("plain") > 0


def test_extraction_of_no_pages(spark):
    assert html_text.extract(frame(spark, [(1, "u", "h")]).limit(0)).count() == 0


# ------------------------------------------------------------------- warc

BIG = "<p>" + "equal payload " * 20 + "</p>"
WARC_ROWS = [(3, "http://a/", BIG), (1, "http://b/\r\nX: y", BIG), (2, None, BIG), (None, "http://n/", BIG), (1, "http://b/", BIG),
             (4, "http://c/", "tiny"), (5, "http://d/", "tiny"), (6, "http://e/", None), (7, "http://f/", "ünïcode " * 30)]


def test_warc_round_trip(spark):
    archives = warc.write_archives(frame(spark, WARC_ROWS))
    rows = warc.read_archives(archives).filter("record_type != 'warcinfo'").collect()
    assert all(r.fault is None for r in rows)
    got = sorted(((r.record_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows), key=key)
    want = []
    for i, _, h in WARC_ROWS:
        raw = (h or "").encode()
        revisit = h == BIG and i != 1
        want.append((f"<urn:x-page:{i}>", len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response",
                     "<urn:x-page:1>" if revisit else None))
    assert got == sorted(want, key=key)
    assert {bytes(r.payload) for r in rows if r.record_type == "response"} == {(h or "").encode() for _, _, h in WARC_ROWS}
    assert warc.read_archives(warc.write_archives(frame(spark, WARC_ROWS).limit(0))).count() == 0


def test_very_long_urls(spark):
    rows = [(1, "http://a/" + "x" * 70_000, "one"), (2, "http://b/" + "\x01" * 30_000, "two"), (3, "http://c/", "three")]
    assert {r.record_id for r in warc.own_records(warc.write_archives(frame(spark, rows))).collect()} == {f"<urn:x-page:{i}>" for i in (1, 2, 3)}


def test_gaps_in_own_archives_raise(spark):
    archives = warc.write_archives(frame(spark, WARC_ROWS))
    cut = archives.withColumn("content", F.expr("substring(content, 1, length(content) - 20)"))
    with pytest.raises(Exception, match="gap in pages-"):
        warc.own_records(cut).count()


def some_records(n=6):
    return [warc.page_record(i, f"http://x/{i}", b"payload %d " % i * 30, hashlib.sha256(b"payload %d " % i * 30).hexdigest(), None)
            for i in range(n)]


def ids(data):
    out = list(warc.salvage(data))
    assert sum(n for _, n, *_ in out) == len(data)  # gaps and records cover it
    return [h[b"warc-record-id"] for _, _, fault, h, _ in out if fault is None], [(o, n, f) for o, n, f, *_ in out if f]


def name(i):
    return b"<urn:x-page:%d>" % i


def test_salvage_of_damaged_members():
    members = [warc.member(r) for r in some_records()]
    assert ids(b"".join(members)) == ([name(i) for i in range(6)], [])
    bad = bytearray(members[2])
    bad[len(bad) // 2] ^= 0xFF
    found, gaps = ids(b"".join([*members[:2], bytes(bad), *members[3:]]))
    assert found == [name(i) for i in (0, 1, 3, 4, 5)] and len(gaps) == 1
    assert gaps[0][0] == len(members[0]) + len(members[1]) and gaps[0][1] == len(bad)
    found, gaps = ids(b"garbage" + members[0] + b"\x1f\x8b\x08junk" + members[1] + members[2][:50])
    assert found == [name(0), name(1)] and len(gaps) == 3


def test_salvage_of_plain_records():
    records = some_records()
    assert ids(b"".join(records)) == ([name(i) for i in range(6)], [])
    wrong_length = records[1].replace(b"Content-Length: ", b"Content-Length: 9", 1)
    wrong_digest = records[3].replace(b"payload 3", b"payload 9", 1)
    found, gaps = ids(b"".join([records[0], wrong_length, records[2], wrong_digest, records[4], b"\r\n", records[5]]))
    assert found == [name(i) for i in (0, 2, 4, 5)] and [g[2] for g in gaps][1] == "payload digest differs"
    assert ids(b"") == ([], []) and ids(b"no archive") == ([], [(0, 10, "no version line")])


def test_reading_a_foreign_archive(spark, tmp_path):
    """Files as Spark's binaryFile source gives them."""
    (tmp_path / "a.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in some_records(3)))
    (tmp_path / "b.warc").write_bytes(b"".join(some_records(2)))
    files = spark.read.format("binaryFile").load(str(tmp_path)).select(F.col("path").alias("archive"), "content")
    assert warc.read_archives(files).filter("record_type = 'response' and fault is null").count() == 5
