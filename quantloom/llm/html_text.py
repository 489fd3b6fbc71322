"""Main-text extraction with consensus host paths.

1. Every page is parsed (tolerantly) to a tree of containers and text blocks.  Navigation, page headers,
   footers, sidebars, notices, adverts, forms, scripts, styles and reader comments are known by tag, role,
   class or id, of containers, blocks and inline elements, and count for nothing with all within them; a name does not
   count for a container that holds the article.  A container's score is the text of the blocks in
   it that isn't link text, less for each level that a block lies deeper.  From the container of highest score the best
   one is found by climbing: within an article (else main) to it, else to the outermost ancestor up to the body
   that adds text of which most isn't links.
2. A page votes for the generalised path (tags with classes, digits left out) of its best container;
   Spark sums the votes per host, and the path with most votes wins (ties: the greatest path).
3. Every page is extracted again from the containers at its host's path; a page that has none, or no
   text there, from its own best container.  The table of hosts and paths is broadcast where its measured size is
   at most ``BROADCAST_BYTES``; a larger one is joined with pages dealt by host and a salt of ``SALT`` values, so
   that a host with a third of the pages is in many tasks.

A node knows its parent and a hash of its path; a path is written out for the best container alone, so memory
is linear in the page however deep its elements are.  White space in a block becomes one space, character
references are decoded, blocks are joined by line feeds.  Nothing else is dropped or cut.

Defined results: a null or empty page, or one without text, gives the empty text; a null or broken url is of the
host without a name; a null page_id stays null; repeated rows are extracted each; an empty table gives no rows; extra
columns are ignored, whatever their names; a very long page is parsed as a whole, in memory linear in its length.
"""

from __future__ import annotations

import hashlib
import html as references
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import cut

#: Bytes of the hosts and paths that are sent to every executor, at most.
BROADCAST_BYTES = 16 << 20
SALT = 32

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|template|noscript|svg|iframe|textarea|select|button|canvas|object|video|audio)\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_DIGITS = re.compile(r"[\d/]+")

_CONTAINERS = frozenset("html body article section main div nav header footer aside form ul ol table tbody thead tfoot tr td th blockquote figure dl fieldset details center menu dialog head".split())
_BLOCKS = _CONTAINERS | frozenset("p h1 h2 h3 h4 h5 h6 li pre dt dd figcaption caption hr address summary title".split())
_VOID = frozenset("br hr img input meta link area base col embed source track wbr".split())
_SKIPPED_TAGS = frozenset("nav footer aside form head title menu dialog fieldset".split())
_SKIPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert".split())
# Parts of a class or id that mark boilerplate wherever they stand in it.
_SKIPPED_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored banner cookie cookies gdpr newsletter comment comments disqus sidebar widget widgets breadcrumb breadcrumbs menu nav navbar navigation footer masthead toolbar pagination".split()
)
# Those that do so only if nothing but such parts and words of layout are beside them.
_WEAK_NAMES = frozenset(
    "promo promotion consent notice notices notification popup modal overlay subscribe subscription respond reply replies related recommended share sharing social pager login signup search copyright skip".split()
)
_LAYOUT = frozenset(
    "area article articles bar block blog bottom box column container content entry form global inner item items left link links list main news outer page panel post posts primary right row secondary section site slot stories story text top unit view wrap wrapper".split()
)
# With one of these a name tells of a state or of what is not there.
_STATES = frozenset("active closed collapsed disabled enabled expanded has hide hides no non not off open toggled with without".split())
_COMMENTS = frozenset("comment comments disqus respond reply replies".split())
_DECAY = 0.8
#: Share of a page's text from which a container is no boilerplate whatever its name.
_MOST = 0.8
#: Blocks that end where any other begins.
_PLAIN = frozenset("p h1 h2 h3 h4 h5 h6 pre".split())


class _Node:
    __slots__ = ("held", "key", "linked", "name", "parent", "plain", "score", "skipped", "step", "tag", "whole")

    def __init__(self, tag: str, step: str, parent: _Node | None, skipped: bool, name: str = "") -> None:
        self.tag, self.step, self.parent, self.skipped, self.score = tag, step, parent, skipped, 0.0
        #: What its name says (see ``_named``), whether it holds an article, characters of all blocks within that no tag or role marks.
        self.name, self.whole, self.held = name, False, 0
        #: Identifies the path.
        self.key = _next_key(parent.key, step) if parent else b""
        #: Characters outside and in links, in all unskipped blocks within.
        self.plain = self.linked = 0

    def path(self) -> str:
        steps, up = [], self
        while up.parent is not None:
            steps.append(up.step)
            up = up.parent
        return "".join(f"/{x}" for x in reversed(steps))


def _next_key(key: bytes, step: str) -> bytes:
    return hashlib.blake2b(key + step.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def path_key(path: str) -> bytes:
    key = b""
    for step in path.split("/")[1:]:
        key = _next_key(key, step)
    return key


def _boilerplate(names: str) -> str:
    """What classes and ids say: "" (nothing), "comment" or "other" boilerplate."""
    found = ""
    for token in names.split():
        parts = {x.lower() for x in _PART.findall(token)}
        if parts & _STATES:
            continue
        if parts & _SKIPPED_NAMES or parts & _WEAK_NAMES and parts <= _WEAK_NAMES | _LAYOUT:
            found = "comment" if parts & _COMMENTS else found or "other"
    return found


def _named(attributes: str, tag: str, inside_article: bool) -> tuple[str, bool, str]:
    """(generalised step of a path, whether tag, role or a header's name make the element boilerplate, what its other names say)."""
    classes, names, role = "", "", ""
    for key, a, b, c in _ATTRIBUTE.findall(attributes):
        value = a or b or c
        key = key.lower()
        if key == "class":
            classes = value
        if key == "role":
            role = value.strip().lower()
        else:
            names += f" {value}"
    step = ".".join([tag, *sorted({_DIGITS.sub("", x) for x in classes.split()} - {""})])
    skipped = tag in _SKIPPED_TAGS or role in _SKIPPED_ROLES or tag == "header" and not inside_article
    name = ""
    if names and tag not in ("html", "body", "main"):
        name = _boilerplate(names)
        if not inside_article and tag != "article" and any(parts <= _LAYOUT | {"header"} and "header" in parts for parts in ({x.lower() for x in _PART.findall(t)} for t in names.split())):
            name = name or "other"
    return step, skipped, name


class Page:
    """The blocks of a page: (container, text), in page order.

    A container that its name marks is still no boilerplate if the page's main element or an article is within it, or, unless it is
    named after comments, nearly all text.  Blocks and inline elements that are marked hide all within them.
    """

    def __init__(self, source: str) -> None:
        root = _Node("", "", None, False)
        self.nodes = [root]
        blocks: list[tuple[_Node, str, int]] = []
        stack: list[_Node] = [root]
        open_tags: dict[str, int] = {}  # how many elements of a tag are open
        parts: list[str] = []
        links, in_link, end = 0, False, 0
        hidden: tuple[str, int] | None = None  # tag and depth of a marked block, such as a list item, that is open
        inline, nested = "", 0  # tag of a marked inline element, and how many of that tag are open

        def close() -> None:
            nonlocal links
            if parts:
                text = " ".join(references.unescape("".join(parts)).split())
                if text and not hidden:
                    blocks.append((stack[-1], text, max(0, len(text) - links)))
                parts.clear()
            links = 0

        for m in _TOKEN.finditer(source):
            if m.start() > end and not inline:
                text = source[end : m.start()]
                parts.append(text)
                if in_link:
                    links += len(text)
            end = m.end()
            tag = m[3]
            if not tag:
                continue
            tag = tag.lower()
            if inline and tag == inline:
                nested += -1 if m[2] else 1
                inline = inline if nested else ""
            if tag == "br":
                parts.append(" ")
                continue
            if tag not in _BLOCKS:
                if not m[2] and not inline and tag not in _VOID and not m[4].rstrip().endswith("/") and (_named(m[4], tag, True)[2] if m[4] else "") + ("-" in tag and _boilerplate(tag) or ""):
                    inline, nested = tag, 1
                if tag == "a":
                    in_link = not m[2]
                continue
            close()
            in_link, inline = False, ""
            if tag not in _CONTAINERS or tag in _VOID:
                if hidden and (hidden[0] == tag or hidden[0] in _PLAIN or len(stack) < hidden[1]):
                    hidden = None
                if not hidden and m[4] and not m[2] and _named(m[4], tag, bool(open_tags.get("article") or open_tags.get("main")))[2]:
                    hidden = tag, len(stack)
                continue
            if hidden and hidden[0] in _PLAIN and not m[2]:
                hidden = None
            if m[2]:
                if open_tags.get(tag):
                    while True:
                        top = stack.pop()
                        open_tags[top.tag] -= 1
                        if top.tag == tag:
                            break
                if hidden and len(stack) < hidden[1]:
                    hidden = None
            else:
                if tag == "body" or stack[-1].tag == "head" and tag != "head":
                    while stack[-1].tag == "head":
                        open_tags[stack.pop().tag] -= 1
                if tag in ("html", "body") and open_tags.get(tag):
                    continue
                top = stack[-1]
                step, skipped, name = _named(m[4], tag, bool(open_tags.get("article") or open_tags.get("main")))
                if tag == "main" or tag == "article" and not name:
                    up: _Node | None = top
                    while up is not None and not up.whole:
                        up.whole, up = True, up.parent
                node = _Node(tag, step, top, skipped or top.skipped, "" if tag == "article" else name)
                self.nodes.append(node)
                stack.append(node)
                open_tags[tag] = open_tags.get(tag, 0) + 1
        if end < len(source) and not inline:
            parts.append(source[end:])
        close()
        for node, text, _ in blocks:
            if not node.skipped:
                node.held += len(text)
        for node in reversed(self.nodes[1:]):  # children come after their parents
            node.parent.held += node.held
        for node in self.nodes[1:]:
            marked = node.name and not node.whole and (node.name == "comment" or node.held < _MOST * root.held)
            node.skipped = node.skipped or node.parent.skipped or bool(marked)
        self.blocks = [(node, text) for node, text, _ in blocks if not node.skipped]
        for node, text, worth in blocks:
            if not node.skipped:
                node.score += worth
                node.plain += worth
                node.linked += len(text) - worth
        for node in reversed(self.nodes[1:]):
            node.parent.score += node.score * _DECAY
            node.parent.plain += node.plain
            node.parent.linked += node.linked

    def best(self) -> _Node | None:
        """The container of most worth (of equal ones the outermost, first in the page), or what it is a part of."""
        found = max(self.nodes, key=lambda n: n.score)
        if found.score <= 0:
            return self.nodes[0] if self.blocks else None
        above, up = [], found.parent
        while up is not None and up.tag not in ("", "html"):
            above.append(up)
            up = up.parent
        for tag in ("article", "main"):
            whole = [n for n in [found, *above] if n.tag == tag]
            if whole:
                above = above[: above.index(whole[-1]) + 1] if whole[-1] is not found else []
                break
        best = found
        for n in above:
            plain, linked = n.plain - best.plain, n.linked - best.linked
            if plain > linked:
                best = n
        return best

    def text(self, chosen: set[int]) -> str:
        """The blocks within these containers."""
        out, known = [], {}
        for node, text in self.blocks:
            inside = known.get(id(node))
            if inside is None:
                up: _Node | None = node
                while up is not None and id(up) not in chosen:
                    up = up.parent
                inside = known[id(node)] = up is not None
            if inside:
                out.append(text)
        return "\n".join(out)

    def extract(self, path: str | None) -> str:
        key = path_key(path) if path else None
        found = self.text({id(n) for n in self.nodes if n.key == key and not n.skipped}) if path else ""
        if not found and (best := self.best()) is not None:
            found = self.text({id(best)})
        return found


def _vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts: dict[tuple[str, str], int] = {}
        for host, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            best = Page(source).best() if source else None
            if best is not None:
                key = host, best.path()
                counts[key] = counts.get(key, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in counts], pa.string()), pa.array([k[1] for k in counts], pa.string()), pa.array(counts.values(), pa.int64())], names=["host", "path", "n"])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [Page(source).extract(path) if source else "" for source, path in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])


def _with_host(pages: DataFrame) -> DataFrame:
    host = F.lower(F.coalesce(F.try_parse_url(F.trim("url"), F.lit("HOST")), F.lit("")))
    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).withColumn("host", host)


def host_paths(pages: DataFrame) -> DataFrame:
    """host and its winning path; votes are summed in each batch, then by Spark."""
    votes = _with_host(pages).select("host", "html").mapInArrow(_vote, "host string, path string, n long")
    summed = votes.groupBy("host", "path").agg(F.sum("n").alias("n"))
    return summed.groupBy("host").agg(F.max_by("path", F.struct("n", "path")).alias("path"))


def extract(pages: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    keyed, paths = _with_host(pages), cut(host_paths(pages))
    size = paths.agg(F.sum(F.octet_length("host") + F.octet_length("path") + 32)).first()[0] or 0
    if size <= broadcast_bytes:
        joined = keyed.join(F.broadcast(paths), "host", "left")
    else:
        salted = paths.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        joined = keyed.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALT)).cast("int")).join(salted, ["host", "salt"], "left")
    return joined.select("page_id", "url", "html", "path").mapInArrow(_extract, "page_id long, url string, text string, n_chars long")


def op9_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
