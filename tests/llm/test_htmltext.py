import html
import random
import re
from collections import Counter
from html.parser import HTMLParser

from pyspark.sql import functions as F

from postflock.llm import htmltext


def text(source, template=frozenset()):
    return htmltext.main_text(htmltext.parse(source), template)


def test_blocks_and_references():
    assert text("<body><article><h1>A &amp; B</h1><p>x <b>y</b>\n\n z<br>w<p>caf&eacute; &#8364;&nbsp;5 &lt;i&gt;</article></body>") == "A & B\n\nx y z w\n\ncafé € 5 <i>"
    assert text("<ul><li>a<li>b</ul><table><tr><td>c<td>d</table>") == "a\n\nb\n\nc\n\nd"
    assert text("") == "" and text("plain  text") == "plain text" and text("a <!-- b > c --> d<![CDATA[x]]>") == "a d"
    assert text("<p>a < b, 3<4 & 5 &am") == "a < b, 3<4 & 5 &am"
    assert text('<p title="a>b">c</p><a href="/cut off') == "c"
    assert text("<article><p>cut <b") == "cut"


PAGE = """<html><head><title>t</title><style>p{}</style></head><body class="has-sidebar"><header>site</header>
<nav><ul><li>menu</ul></nav><div class="cookie-notice">we use</div><main><article><header><p>by x</p><h1>Title</h1></header><p>one</p>
<aside>side</aside><form>mail <input></form><div id="ad-3">buy</div><script>if (a < b) "</p>"</script><p>two</p>
<section class="comments"><p>nice</p></section><footer>tags</footer></article></main><div class="sidebar">s</div><footer>f</footer></body></html>"""


def test_what_is_no_article():
    assert text(PAGE, htmltext.AllFrames()) == "Title\n\none\n\ntwo"
    # a class alone deletes nothing
    assert text(PAGE) == "we use\n\nTitle\n\none\n\nbuy\n\ntwo\n\nnice\n\ns"


def test_prose_with_telling_classes_stays():
    for source in ('<p class="share price">x</p>', '<div class="related-work"><p>x</div>', '<div class="entry-content-widget-area">x</div>'):
        assert text(f"<article>{source}</article>") == "x"
    assert text('<article><p class="share price">x</p></article>', htmltext.AllFrames()) == "x"


def test_deep_and_long_pages():
    deep = "<div>" * 20_000 + "x" + "</div>" * 20_000
    assert text(deep) == "x" and htmltext.subtrees(htmltext.parse(deep))
    assert text("<b>" * 50_000 + "<p>y") == "y"
    assert len(text("<p>" + "word " * 400_000)) == 5 * 400_000 - 1


def test_templates_by_host(spark, monkeypatch):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(6))
    rows, want = [], {}
    for i in range(120):
        host = ["http://one.example/", "https://two.example/x?"][i % 2]
        body = [" ".join(word() for _ in range(9)) for _ in range(3)]
        if i % 4 == 0:
            body.append("said often in articles")
        blocks = "".join(f"<p>{x}</p>" for x in body)
        if i % 2:  # no article element: only counting tells the frame from the text
            page = f"<div><span>Great site two</span></div><div>{blocks}</div><div><i>All our pages</i></div>"
        else:  # a notice in the article, which no class tells; an advert that is new each time
            page = f"<div>Great site one</div><article>{blocks}<div>Read our <b>letter</b></div><ul><li><a href='/'>More to read</a></ul><div class='ad ad-{i}'>Buy {word()}</div></article>"
        rows.append((i, f"{host}{i}", page, 1))
        want[i] = "\n\n".join(body)
    # one page alone: what recurs nowhere stays, whatever its class
    rows += [(600, "http://four.example/", "<article><p>x<div class='share box'>y</div></article>", 1)]
    want[600] = "x\n\ny"
    rows += [(500, None, None, 1), (501, "http://[broken", "<p>x &amp; y", 1), (502, "http://three.example", "", 1), (502, "http://three.example", "", 1), (None, "u", "<p>z", 1)]
    want |= {500: "", 501: "x & y", 502: "", None: "z"}
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, URL int")
    for small in (htmltext.SMALL, 0):  # sent to all tasks, or joined
        monkeypatch.setattr(htmltext, "SMALL", small)
        out = htmltext.extract(pages).collect()
        assert len(out) == len(rows)
        for r in out:
            assert (r.text, r.n_chars) == (want[r.page_id], len(r.text))
    assert htmltext.extract(pages.limit(0)).count() == 0


def test_frames_of_many_hosts_go_on_small_ones(spark):
    rows = [(i, f"http://h{i}.example/", f"<article><p>text {i}</p></article><div class='promo'>p{i}</div>", 1) for i in range(6)]
    rows.append((9, "http://h9.example/", "<div><p>told</p></div><div class='promo box'>one</div><div class='promo'>two</div>", 1))
    out = {r.page_id: r.text for r in htmltext.extract(spark.createDataFrame(rows, "page_id long, url string, html string, n int")).collect()}
    assert out == {i: f"text {i}" for i in range(6)} | {9: "told\n\none"}


def test_a_block_on_many_pages_of_a_large_host(spark):
    """A hundred pages are enough, however many others there are; syndicated prose on
    a few pages of a small host is none."""
    rows = [(i, "http://big.example/", f"<div><p>text {i}</p></div>" + ("<div><i>Section menu</i></div>" if i < 110 else ""), 1) for i in range(2500)]
    rows += [(5000 + i, "http://small.example/", f"<div><p>own {i}</p>" + ("<p>told by an agency</p>" if i < 6 else "") + "</div>", 1) for i in range(60)]
    out = {r.page_id: r.text for r in htmltext.extract(spark.createDataFrame(rows, "page_id long, url string, html string, n int")).collect()}
    assert all(out[i] == f"text {i}" for i in range(2500))
    assert all(out[5000 + i] == (f"own {i}\n\ntold by an agency" if i < 6 else f"own {i}") for i in range(60))


class Skeleton(HTMLParser):
    """Subtrees of well-formed pages as nested tuples, by another parser."""

    def __init__(self, source):
        super().__init__()
        self.open, self.found, self.frames = [["", []]], [], set()
        self.feed(source)

    def handle_starttag(self, tag, attrs):
        if tag in ("meta", "br"):
            self.open[-1][1].append((tag, ()))
            return
        # the pages of the test leave one b open, which the next p ends up in
        self.open.append([tag, []])
        if ("class", "ad") in attrs:
            self.frames.add("ad")

    def handle_endtag(self, tag):
        while len(self.open) > 1:
            name, parts = self.open.pop()
            tree = (name, tuple(parts))
            self.open[-1][1].append(tree)
            self.found.append(tree)
            if name == tag:
                return

    def handle_data(self, data):
        self.open[-1][1].append(data.strip())


def test_counts_against_brute_force(spark):
    """Subtrees of the given pages that recur on a host, counted one by one."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    rows, seen, on, sizes, frames = pages.collect(), set(), Counter(), Counter(), set()
    for r in rows:
        host, inner = re.search(r"//([^/:?#]*)", r.url)[1], re.search(r"<article>.*?(?:</article>|\Z)", r.html, re.S)[0]
        if (host, inner) in seen:
            continue  # a copy of a page
        tree = Skeleton(r.html.replace(inner, ""))
        sizes[host] += 1
        on.update((host, x) for x in set(tree.found) if x[0] in ("nav", "div", "footer"))
        frames |= {host} if tree.frames else set()
        seen.add((host, inner))
    want = Counter(host for (host, x), n in on.items() if n >= 5 and (20 * n >= sizes[host] or n >= 100))
    assert len(frames) >= htmltext.LEAST_HOSTS and sum(want.values()) >= 10
    found = htmltext.template_subtrees(pages.select("url", "html")).collect()
    assert sum(r.host == htmltext.ANY_HOST for r in found) == 1
    # nav, div and footer of the pages: containers that hold text or other elements
    parsed = {}
    for r in rows:
        host = re.search(r"//([^/:?#]*)", r.url)[1]
        for node in htmltext.walk(htmltext.parse(r.html)):
            if node.name in ("nav", "div", "footer"):
                parsed[host, node.code()] = node.name
    got = Counter(r.host for r in found if (r.host, r.hash) in parsed)
    assert got == want


def test_counting_decides_on_the_tables_of_the_query(spark, monkeypatch):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    whole = {r.page_id: r.text for r in htmltext.extract(pages).collect()}
    # the page's own word for what its article is changes nothing
    plain = pages.withColumn("html", F.regexp_replace("html", "</?article>", ""))
    assert {r.page_id: r.text for r in htmltext.extract(plain).collect()} == whole
    monkeypatch.setattr(htmltext, "template_subtrees", lambda rows: spark.createDataFrame([], "host string, hash long"))
    empty = {r.page_id: r.text for r in htmltext.extract(pages).collect()}
    assert all(empty[k] != whole[k] for k in whole)


def test_copies_of_a_page_are_no_template(spark):
    rows = [(i, "http://one.example/", "<div>Only once</div><div><p>told</div>") for i in range(50)]
    out = htmltext.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.text for r in out} == {"Only once\n\ntold"}


def test_against_a_plain_reading_of_the_test_pages(spark):
    """Articles of the given pages have paragraphs, headings, b and br alone."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    out = {r.page_id: r.text for r in htmltext.extract(pages).collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)(?:</article>|\Z)", r.html, re.S)[1]
        inner = re.sub(r"</?b>|<br>", lambda m: " " if m[0] == "<br>" else "", inner)
        blocks = (" ".join(html.unescape(x).split()) for x in re.split(r"</?(?:p|h1)>", inner))
        assert out[r.page_id] == "\n\n".join(x for x in blocks if x)
