"""Main text of web pages: site templates are found by counting and removed.

A page is parsed into a tree. The hash of an element stands for its whole subtree:
name, text and children. Spark counts on how many different pages of a host each
subtree stands; those that recur on many are the site's template and are deleted
wherever they stand. In the article that holds for containers: its prose is never
taken for template, however often it recurs.

What changes from page to page, such as an advert or readers' comments, recurs as a
frame only: by name, class and id. Frames whose class speaks of an advert, a menu, a
share bar and the like are counted too, on pages of a host and on different hosts, and
are deleted where they recur. A class alone deletes nothing. What HTML itself marks as
no part of the text (scripts, navigation, footers, forms, hidden elements) always goes.
"""

from __future__ import annotations

import re
from html import unescape
from urllib.parse import urlsplit

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .core import pick, stage

#: A subtree is template if it stands on this many different pages of its host ...
LEAST_PAGES = 5
#: ... and on at least one of so many of them, or on so many pages whatever the share.
ONE_IN, MANY_PAGES = 20, 100
#: Prose outside an article must stand on one of so many.
PROSE_ONE_IN = 4
#: A frame is template for all hosts if it stands on so many of them.
LEAST_HOSTS = 5
#: Elements that are nested more deeply stand side by side.
DEEPEST = 512
#: With more template subtrees than this they are joined to their pages, not sent
#: to every task.
SMALL = 200_000

# Element names of the HTML standard, by how they are treated.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
GONE = frozenset("head script style noscript template svg math canvas object embed iframe noframes noembed nav footer aside form button select textarea dialog menu title xmp audio video".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - frozenset("body html caption dd dt li tbody td tfoot th thead tr".split())
# an open element of the value is ended by a start of the key
SIBLINGS = {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "tbody": "tr td th thead tbody", "tfoot": "tr td th thead tbody", "option": "option"}
SIBLINGS = {k: frozenset(v.split()) for k, v in SIBLINGS.items()}
SCOPE = frozenset("ul ol dl table article section div main body td th".split())
# what is prose or part of a text; recurring, it is no template inside an article
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre figure figcaption table caption thead tbody tfoot tr td th li dl dt dd address a b i em strong span small sub sup code q cite mark u s br".split())
UNFRAMED = frozenset("html body main p h1 h2 h3 h4 h5 h6 blockquote pre a b i em strong span small sub sup code q cite mark u s br".split())
# lists are template inside an article only if they are mostly links
LISTS = frozenset("ul ol menu".split())
# words in class, id and role that speak of what is not the article
MARKS = frozenset("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments cookie cookies consent disqus footer masthead menu nav navbar navigation newsletter notice notices pagination pager popup modal promo promoted promotion related respond share sharing sidebar social sponsor sponsored subscribe subscription widget widgets complementary contentinfo search".split())

TAG = re.compile(r"""<(?:!--(?P<comment>.*?)(?:--!?>|\Z)|(?P<other>[!?][^>]*>?)|(?P<end>/)?(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>"']|"[^"]*"|'[^']*')*?)(?:>|\Z)|/[^a-zA-Z>][^>]*>?)""", re.S)
ANY_HOST = "*"
# the last two bits of a hash tell what it stands for
CONTAINER, TEXT, FRAME = 0, 1, 2

ATTR = re.compile(r"""(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=[\s/>]|\Z)""", re.I)



class Node:
    __slots__ = ("name", "attrs", "parts", "parent", "depth", "_hash")

    def __init__(self, name: str, attrs: str, parent):
        self.name, self.attrs, self.parts, self.parent, self.depth, self._hash = name, attrs, [], parent, 0, None

    def hash(self) -> int:
        if self._hash is None:
            todo = [self]
            while todo:  # children first
                node = todo[-1]
                open_ = [x for x in node.parts if not isinstance(x, str) and x._hash is None]
                if open_:
                    todo += open_
                    continue
                h = xxhash.xxh3_64(node.name)
                for x in node.parts:
                    h.update(b"\x01" + x.strip().encode("utf-8", "replace") if isinstance(x, str) else b"\x02%d" % x._hash)
                node._hash = h.intdigest()
                todo.pop()
        return self._hash

    def code(self) -> int:
        """The hash with the kind of the element."""
        return (self.hash() - (1 << 63)) & ~3 | (TEXT if self.name in PROSE else CONTAINER)

    def gone(self) -> bool:
        """Whether HTML itself says that it is no part of the text."""
        if self.name in GONE:
            return True
        return any(what.lower() == "hidden" or what.lower() == "aria-hidden" and "".join(value).lower() == "true" for what, *value in ATTR.findall(self.attrs))

    def frame(self, inside: bool) -> int | None:
        """A hash of name, class, id and role, if these speak of what is not the
        article; numbers in them do not count. None for paragraphs and words, for the
        page's large parts and for an article that is in no other."""
        if not self.attrs or self.name in UNFRAMED or self.name == "article" and not inside:
            return None
        tokens = [f"{what.lower()}={x}" for what, *values in ATTR.findall(self.attrs) if what.lower() in ("class", "id", "role") for x in "".join(values).lower().split()]
        # has-sidebar and the like speak of the page around
        spoken = [x.split("=", 1)[1] for x in tokens]
        if not any(not re.match("(?:has|with|no|without|is|show|hide)[-_]", x) and not MARKS.isdisjoint(re.split(r"[^a-z0-9]+", x)) for x in spoken):
            return None
        plain = " ".join(sorted({re.sub(r"\d+", "#", x) for x in tokens}))
        return (xxhash.xxh3_64_intdigest(f"{self.name} {plain}".encode("utf-8", "replace")) - (1 << 63)) & ~3 | FRAME


class AllFrames:
    """A template of every frame, for the text by which copies of a page are known."""

    def __contains__(self, code: int) -> bool:
        return code & 3 == FRAME


def parse(html: str) -> Node:
    """The tree of a page. Ends that are left out are supplied as the standard has
    it for paragraphs, list items and cells; a stray end tag is ignored."""
    root = here = Node("", "", None)
    at, size = 0, len(html)
    for found in iter(lambda: TAG.search(html, at), None):
        if found.start() > at:
            here.parts.append(html[at : found.start()])
        at = found.end()
        name = found["name"]
        if not name:
            continue
        name = name.lower()
        if found["end"]:
            node = here
            while node is not root and node.name != name:
                node = node.parent if node.name not in SCOPE or name in SCOPE else root
            if node is not root:
                here = node.parent
            continue
        if name in CLOSES_P:
            node = here
            while node is not root and node.name not in SCOPE:
                if node.name == "p":
                    here = node.parent
                    break
                node = node.parent
        if name in SIBLINGS:
            ends, node = SIBLINGS[name], here
            stops = frozenset("ul ol dl table".split())
            while node is not root and node.name not in stops:
                if node.name in ends:
                    here = node.parent
                node = node.parent
        node = Node(name, found["attrs"], here)
        here.parts.append(node)
        node.depth = here.depth + 1
        if name in RAW:
            close = re.compile(rf"</{name}(?=[\s/>])[^>]*>?|\Z", re.I).search(html, at)
            if name not in ("script", "style"):
                node.parts.append(html[at : close.start()])
            at = close.end()
        elif name not in VOID and not found["attrs"].endswith("/") or name in BLOCK and name not in VOID:
            if node.depth < DEEPEST:
                here = node
    if at < size:
        # a tag that the page's end cuts off is no text
        rest = html[at:]
        cut = re.search(r"<[a-zA-Z/!][^>]*\Z", rest)
        here.parts.append(rest[: cut.start()] if cut else rest)
    return root


def walk(node: Node):
    todo = [node]
    while todo:
        here = todo.pop()
        yield here
        todo += [x for x in reversed(here.parts) if isinstance(x, Node)]


def length(node: Node, name: str | None = None) -> int:
    """Characters of text below a node, or below those of its nodes with a name."""
    total = 0
    for x in walk(node):
        if name is None:
            total += sum(len(p) for p in x.parts if isinstance(p, str))
        elif x.name == name:
            total += length(x)
    return total


def holds_article(node: Node) -> bool:
    return node.name in ("article", "main") or bool(node.attrs) and re.search(r"role\s*=\s*[\"']?main\b", node.attrs) is not None


def links_mostly(node: Node) -> bool:
    total = length(node)
    return total > 0 and 2 * length(node, "a") >= total


def in_frame(node: Node, template, inside: bool) -> bool:
    found = node.frame(inside)
    return found is not None and found in template


def removable(node: Node, inside: bool) -> bool:
    """Whether a subtree may be deleted if it recurs: anything outside the article,
    in it containers, and lists of links."""
    if node.name in ("", "html", "head", "body", "script", "style") or holds_article(node):
        return False
    return not inside or node.name not in PROSE and (node.name not in LISTS or links_mostly(node))


def subtrees(root: Node) -> list[int]:
    """Codes of the elements that may be deleted as template, and of the frames."""
    found: set[int] = set()
    todo = [(root, False)]
    while todo:
        node, inside = todo.pop()
        if (node.parts or node.name not in VOID) and removable(node, inside):
            found.add(node.code())
        frame = node.frame(inside)
        if frame is not None:
            found.add(frame)
        inside = inside or holds_article(node)
        if node.name not in ("head", "script", "style"):
            todo += [(x, inside) for x in node.parts if isinstance(x, Node)]
    return sorted(found)


def main_text(root: Node, template) -> str:
    """Blocks of what the template, a set of codes, leaves, joined by an empty line.
    An ``article`` or ``main`` element protects the prose in it; what stands outside
    is not deleted for that alone."""
    blocks: list[str] = []
    words: list[str] = []

    def flush():
        text = " ".join(unescape("".join(words)).split())
        if text:
            blocks.append(text)
        words.clear()

    # a text, an element and whether it is inside the article, or () where a block
    # ends; deep pages do not recurse
    todo: list = [(root, False)]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            words.append(x)
            continue
        if not x:
            flush()
            continue
        x, inside = x
        if x.name == "header" and inside:
            # a heading inside the article's own header is the article's title
            flush()
            todo += [(y, True) for y in reversed(list(walk(x))) if re.fullmatch("h[1-6]", y.name)]
            continue
        if x.name == "header" or x.gone() or in_frame(x, template, inside) or (template and removable(x, inside) and x.code() in template):
            if x.name in BLOCK:
                flush()
            continue
        if x.name in BLOCK:
            flush()
            todo.append(())
        elif x.name == "br":
            words.append(" ")
        inside = inside or holds_article(x)
        todo += [p if isinstance(p, str) else (p, inside) for p in reversed(x.parts)]
    flush()
    return "\n\n".join(blocks)


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


def template_subtrees(pages: DataFrame) -> DataFrame:
    """``pages`` (url, html) -> staged (host, hash): codes of the subtrees and frames
    that recur on a host, and of frames that recur on many hosts."""

    def run(batches):
        for batch in batches:
            hosts, whole, hashes = [], [], []
            for url, html in zip(batch.column(0), batch.column(1)):
                text = html.as_py() or ""
                hosts.append(host_of(url.as_py()))
                root = parse(text)
                # pages that are copies of each other count as one
                whole.append(xxhash.xxh3_64_intdigest(main_text(root, AllFrames())) - (1 << 63))
                hashes.append(subtrees(root))
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(whole, pa.int64()), pa.array(hashes, pa.list_(pa.int64()))], names=["host", "page", "hashes"])

    seen = stage(pages.mapInArrow(run, "host string, page bigint, hashes array<bigint>"), "subtrees")
    sizes = seen.select("host", "page").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    each = seen.select("host", "page", F.explode("hashes").alias("hash")).distinct().groupBy("host", "hash").agg(F.count(F.lit(1)).alias("n"))
    each = stage(each.where((F.col("n") >= LEAST_PAGES) | (F.col("hash").bitwiseAND(3) == FRAME)), "counts")
    often = each.where(F.col("n") >= LEAST_PAGES).join(sizes, "host")
    share = F.when(F.col("hash").bitwiseAND(3) == TEXT, F.col("n") * PROSE_ONE_IN >= F.col("pages")).otherwise((F.col("n") * ONE_IN >= F.col("pages")) | (F.col("n") >= MANY_PAGES))
    frames = each.where(F.col("hash").bitwiseAND(3) == FRAME).groupBy("hash").agg(F.count(F.lit(1)).alias("hosts")).where(F.col("hosts") >= LEAST_HOSTS)
    return stage(often.where(share).select("host", "hash").unionByName(frames.select(F.lit(ANY_HOST).alias("host"), "hash")), "templates")


def extract(pages: DataFrame, *, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """A row for each row of ``pages``: key, url, text, n_chars (code points).

    A null html is as an empty page, with empty text; a null or broken url counts
    to one nameless host. Character references are decoded, white space in a block
    becomes one space, and the blocks stand in page order with an empty line
    between. Repeated rows each get their row; copies of a page count once among
    the pages of a host. An empty table gives no row. Other columns are not looked
    at, whatever their names. Ties cannot occur: a subtree recurs often enough or not.
    """
    rows = pick(pages, key=key, url=url, html=html)
    templates = template_subtrees(rows.select("url", "html"))
    schema = f"`{key}` {rows.schema['key'].dataType.simpleString()}, `{url}` string, text string, n_chars bigint"
    names = [key, url, "text", "n_chars"]

    def result(batch, texts):
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=names)

    if templates.limit(SMALL + 1).count() <= SMALL:
        by_host: dict[str, set] = {}
        for r in templates.collect():
            by_host.setdefault(r.host, set()).add(r.hash)
        anywhere = by_host.pop(ANY_HOST, set())
        by_host = {host: codes | anywhere for host, codes in by_host.items()}
        shared = pages.sparkSession.sparkContext.broadcast((by_host, anywhere))

        def run(batches):
            own, others = shared.value
            for batch in batches:
                texts = [main_text(parse(h.as_py() or ""), own.get(host_of(u.as_py()), others)) for u, h in zip(batch.column(1), batch.column(2))]
                yield result(batch, texts)

        return rows.mapInArrow(run, schema)

    # too many to send: each page with the template subtrees that it has
    def own(batches):
        for batch in batches:
            hosts = pa.array([host_of(u.as_py()) for u in batch.column(1)], pa.string())
            hashes = pa.array([subtrees(parse(h.as_py() or "")) for h in batch.column(2)], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, hosts, hashes], names=["key", "url", "html", "host", "hashes"])

    kind = rows.schema["key"].dataType.simpleString()
    each = rows.withColumn("row", F.xxhash64("key", "url", "html"))
    there = rows.mapInArrow(own, f"key {kind}, url string, html string, host string, hashes array<bigint>").select(F.xxhash64("key", "url", "html").alias("row"), "host", F.explode("hashes").alias("hash")).distinct()
    found = there.join(templates, ["host", "hash"]).select("row", "hash").unionByName(there.join(templates.where(F.col("host") == ANY_HOST).select("hash"), "hash").select("row", "hash"))
    lists = found.groupBy("row").agg(F.collect_set("hash").alias("hashes"))
    joined = each.join(lists, "row", "left").select("key", "url", "html", "hashes")

    def run_joined(batches):
        for batch in batches:
            texts = [main_text(parse(h.as_py() or ""), frozenset(t.as_py() or ())) for h, t in zip(batch.column(2), batch.column(3))]
            yield result(batch, texts)

    return joined.mapInArrow(run_joined, schema)
