"""Main text of web pages by consensus host paths.

Each page's containers are scored by the text that lies in their own blocks, less link text, and the
page votes with those shares for the generalised tag-and-class path of each container. Where a text is
split over sibling containers of one path, or over those of an article, the container round them gets
their scores. Votes are added up per host and path in Spark. Pages are then read again and the text comes
from all containers with the host's winning path; a page that has no such container uses its own best path.
A path is named by a hash over its steps, so its length doesn't grow with the depth of a page. Only the
votes are shuffled; html stays where it is read while the winning paths fit a broadcast.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factorloom.llm.batches import map_batches, texts
from factorloom.session import Scratch

#: The table of winning paths is broadcast up to so many hosts, some 20 MB; beyond, pages are joined with it, hot hosts in SALT parts.
BROADCAST_HOSTS = 200_000
SALT = 32

#: HTML elements by what they do to text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
SKIPPED = frozenset(
    "script style noscript template head title nav header footer aside button select option textarea input iframe object embed svg canvas audio video "
    "dialog menu map xmp noembed noframes".split()
)
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header "
    "hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
CONTAINERS = frozenset("article main section div body td html center".split())
CLOSES_P = BLOCKS - frozenset("body html tbody td tfoot th thead tr caption legend option optgroup dd dt li summary figcaption".split()) | {"p"}
ENDS_SIBLING = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",),
                "thead": ("tbody", "tr", "td", "th"), "tbody": ("thead", "tbody", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th")}
SCOPES = frozenset("ul ol dl table td th article section div body html main aside nav header footer form blockquote select".split())
#: A class, id or role marks what isn't the article if its last word is one of these.
NOISE = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adbox banner banners sponsor sponsored promo promos promotion promoted nav navbar navigation menu menus "
    "breadcrumb breadcrumbs sidebar sidebars aside header masthead topbar footer footnav colophon contentinfo complementary cookie cookies consent gdpr notice notices "
    "notification notifications alert alerts popup popups modal overlay newsletter subscribe subscription signup login share sharing social related recommended "
    "recommendations pager pagination toolbar comment comments commentlist respond disqus reply replies search widget widgets hidden tags".split()
)
#: Words before the last that say what the rest of the page is like, as in has-sidebar.
STATES = frozenset("has have no not with without hide show is".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|$)", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.IGNORECASE | re.ASCII) for tag in RAW}
_SPACE = re.compile(r"\s+")
_SPLIT = re.compile(r"[^a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


def path_name(*steps: str) -> str:
    """The name of a container's path from its generalised steps below html, as ("body", "div.story")."""
    name = "html"
    for step in steps:
        name = xxhash.xxh64_hexdigest(f"{name}>{step}")
    return name


class Node:
    """An open or closed element: its path, whether it is left out, and the blocks of text inside it.

    mark: itself or the nearest element round it that names or a form mark as noise, and that Page drops unless it holds
    the text; article: the nearest article or main element that isn't marked, of articles such.
    """

    __slots__ = ("tag", "path", "noise", "linked", "blocks", "score", "parent", "container", "mark", "plain", "holds", "dropped", "article", "articles")

    def __init__(self, tag: str, path: str, noise: bool, linked: bool, parent, marked: bool = False):
        self.tag, self.path, self.noise, self.linked, self.parent = tag, path, noise, linked, parent
        self.blocks: tuple[int, int] = (0, 0)
        self.score = 0.0
        self.mark: Node | None = self if marked and not noise else parent.mark if parent else None
        self.plain, self.holds, self.dropped = 0, 0, False
        own = tag in ("article", "main") and not noise and not self.mark
        self.article: Node | None = self if own else parent.article if parent else None
        self.articles: int = (parent.articles if parent else 0) + own
        self.container = self if tag in CONTAINERS and not noise else parent.container if parent else None


def _marks(name: str) -> bool:
    """Whether a class, id or role says that an element isn't the article."""
    words = [w for w in _SPLIT.split(_CAMEL.sub("-", name).lower()) if w]
    return bool(words) and words[-1] in NOISE and STATES.isdisjoint(words)


def _general(tag: str, attributes: str) -> tuple[str, bool, bool]:
    """(tag.class.class without digits, whether it is hidden, whether its names or a form mark it as not the article)."""
    marked = tag == "form"
    if not attributes or "=" not in attributes and "hidden" not in attributes:
        return tag, False, marked
    found = {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(attributes)}
    classes = sorted({re.sub(r"[\d_-]+$|\d+", "", c) for c in found.get("class", "").split()} - {""})
    noise = "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "")
    if tag not in ("html", "body"):
        for name in ("class", "id", "role"):
            if name in found and any(map(_marks, found[name].split())):
                marked = True
    return ".".join([tag, *classes]), noise, marked


class Page:
    """Blocks of a page in order, and its containers with what they hold."""

    def __init__(self, html: str):
        self.blocks: list[str] = []
        self.nodes: list[Node] = []
        self.parts: list[tuple[str, Node]] = []
        self.made: list[tuple[list[tuple[str, Node]], Node | None]] = []
        self.marked: list[Node] = []
        self.articles: list[Node] = []
        self.open: list[Node] = []
        self.at: dict[str, list[int]] = {}  # where each tag is open, innermost last
        self.blocks_open: list[int] = [0]  # open block elements up to each depth
        self._push(Node("html", "html", False, False, None))
        self.nodes.append(self.open[0])
        at = 0
        for m in _TOKEN.finditer(html):
            if m.start() < at:
                continue
            if m.start() > at:
                self._text(html[at : m.start()])
            at = m.end()
            if not m[2]:
                continue
            tag = m[2].lower()
            if m[1]:
                self._end(tag)
            else:
                self._start(tag, m[3])
                if tag in RAW:
                    end = _RAW_END[tag].search(html, at)
                    at = end.start() if end else len(html)
        self._text(html[at:])
        self._break()
        while self.open:
            self._close()
        self._settle()

    def _text(self, text: str) -> None:
        top = self.open[-1]
        if top.noise or not text:
            return
        text = unescape(text) if "&" in text else text
        self.parts.append((text, top))

    def _break(self) -> None:
        """Ends the block at hand."""
        if self.parts:
            if not all(t.isspace() for t, _ in self.parts):
                self.made.append((self.parts, self.open[-1].container))
            self.parts = []

    def _push(self, node: Node) -> None:
        self.at.setdefault(node.tag, []).append(len(self.open))
        self.blocks_open.append(self.blocks_open[-1] + (node.tag in BLOCKS))
        self.open.append(node)

    def _depth(self, tags) -> int:
        """Depth of the innermost open element of tags, -1 if none is open."""
        return max((places[-1] for t in tags if (places := self.at.get(t))), default=-1)

    def _close(self) -> None:
        node = self.open.pop()
        self.at[node.tag].pop()
        self.blocks_open.pop()
        node.blocks = (node.blocks[0], len(self.made))

    def _settle(self) -> None:
        """Keeps the marked elements that hold the page's article, drops the others, and credits containers with their blocks.

        They hold it if they have an article or main element, or most of the text outside of links of the page
        or of the article round them, and no article or main element with text stands elsewhere unmarked.
        """
        if self.marked:
            self._judge()
        self.nodes = [n for n in self.nodes if not (n.mark and n.mark.dropped)]
        for parts, node in self.made:
            if self.marked:
                parts = [p for p in parts if not (p[1].mark and p[1].mark.dropped)]
            text = _SPACE.sub(" ", "".join(p[0] for p in parts)).strip()
            self.blocks.append(text)
            if text and node:
                worth = max(0, sum((len(t) - t.count(" ")) * (-1 if top.linked else 1) for t, top in parts))
                node.score += worth
                if node.parent and node.parent.container:
                    node.parent.container.score += worth / 3

    def _judge(self) -> None:
        whole = outside = 0
        for text, top in (p for parts, _ in self.made for p in parts):
            if not top.linked:
                n = sum(map(len, text.split()))
                whole += n
                for node in (top.mark, top.article):
                    if node:
                        node.plain += n
        for node in reversed(self.articles):
            if not node.mark and (up := node.parent.article):
                up.plain += node.plain
            if node.blocks[1] > node.blocks[0]:
                if node.mark:
                    node.mark.holds += 1
                else:
                    outside += 1
        for node in reversed(self.marked):  # inner ones first
            if up := node.parent.mark:
                up.plain += node.plain
                up.holds += node.holds
        for node in self.marked:
            up = node.parent.mark
            held = (node.holds or 2 * node.plain > (node.article.plain if node.article else whole)) and outside <= node.articles
            node.dropped = not held or bool(up and up.dropped)

    def _start(self, tag: str, attributes: str) -> None:
        if tag in BLOCKS:
            self._break()
            if tag in CLOSES_P:
                self._end_open(("p",), frozenset(("td", "th", "table", "button")))
        if tag in ENDS_SIBLING:
            self._end_open(ENDS_SIBLING[tag], SCOPES - {"td", "th"} if tag in ("td", "th", "tr", "thead", "tbody", "tfoot") else SCOPES)
        if tag in VOID:
            if tag in ("br", "wbr", "img", "input"):
                self._text(" " if tag != "wbr" else "")
            return
        top = self.open[-1]
        if tag in ("html", "body") and len(self.open) <= 2 and self.at.get(tag):
            return
        name, noise, marked = _general(tag, attributes)
        path = xxhash.xxh64_hexdigest(f"{top.path}>{name}") if tag in BLOCKS else top.path
        node = Node(tag, path, top.noise or noise or tag in SKIPPED, top.linked or tag == "a", top, marked)
        node.blocks = (len(self.made), 0)
        self._push(node)
        if node.mark is node:
            self.marked.append(node)
        if tag in ("article", "main") and not node.noise:
            self.articles.append(node)
        if node.container is node:
            self.nodes.append(node)

    def _end_open(self, tags: tuple, scope: frozenset) -> None:
        """Closes the nearest open element of tags, and what is open inside it, unless a scope stands between."""
        at = self._depth(tags)
        if at > 0 and self._depth(scope.difference(tags)) < at:
            self._break()
            while len(self.open) > at:
                self._close()

    def _end(self, tag: str) -> None:
        if tag in BLOCKS:
            self._break()
        at = self._depth((tag,))
        if tag in ("html", "body") or at < 1:
            return
        if tag not in BLOCKS and tag not in SKIPPED and self.blocks_open[-1] > self.blocks_open[at + 1]:
            return  # an inline end tag does not close the blocks around it
        while len(self.open) > at:
            self._close()

    def scores(self) -> list[tuple[Node, float]]:
        """Containers with their scores, after siblings of one path and all containers in an article have passed theirs on."""
        inside: dict[Node, dict[str, list[tuple[Node, float]]]] = {}
        found = []
        for node in reversed(self.nodes):  # inner ones come after the ones round them
            score = node.score
            for parts in inside.pop(node, {}).values():
                if len(parts) > 1 or node.tag == "article":
                    score += sum(x for _, x in parts)
                else:
                    found += parts
            if score > 0:
                outer = node.parent.container if node.parent else None
                if outer:
                    inside.setdefault(outer, {}).setdefault(node.path, []).append((node, score))
                else:
                    found.append((node, score))
        return found

    def votes(self) -> dict[str, float]:
        """Share of the page's score for each container path; an article or main element counts double."""
        found: dict[str, float] = {}
        for node, score in self.scores():
            found[node.path] = found.get(node.path, 0.0) + score * (2.0 if node.tag in ("article", "main") else 1.0)
        total = sum(found.values())
        return {path: score / total for path, score in found.items()}

    def text(self, path: str | None) -> str:
        """Blocks of all containers with that path, or with the page's own best path, in page order and joined by empty lines."""
        chosen = [n for n in self.nodes if n.path == path]
        if not chosen:
            own = max(self.votes().items(), key=lambda x: (x[1], x[0]), default=(None, 0))[0]
            chosen = [n for n in self.nodes if n.path == own] or self.nodes[:1]
        return "\n\n".join(block for n in chosen for block in self.blocks[slice(*n.blocks)] if block)


def host_of(url: Column) -> Column:
    """Lower-case host of a URL without port and user; what has none is its own host, null is ''."""
    found = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1))
    return F.when(found != "", found).otherwise(F.coalesce(url, F.lit("")))


def path_votes(pages: DataFrame) -> DataFrame:
    """(host, path, votes): added up over the pages of a host, with partial sums in each task."""

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            sums: dict[tuple[str, str], float] = {}
            for host, html in zip(batch.column("host").to_pylist(), texts(batch, "html"), strict=True):
                for path, share in Page(html).votes().items():
                    sums[host, path] = sums.get((host, path), 0.0) + share
            yield {"host": [k[0] for k in sums], "path": [k[1] for k in sums], "votes": list(sums.values())}

    cast = map_batches(pages.select(host_of(F.col("url")).alias("host"), "html"), vote, "host string, path string, votes double")
    return cast.groupBy("host", "path").agg(F.round(F.sum("votes"), 6).alias("votes"))


def host_paths(votes: DataFrame) -> DataFrame:
    """(host, path): the path with the most votes of each host; of equal ones the first by name."""
    best = votes.groupBy("host").agg(F.min(F.struct((-F.col("votes")).alias("v"), "path")).alias("b"))
    return best.select("host", F.col("b.path").alias("path"))


def extract_pages(pages: DataFrame, broadcast_hosts: int = BROADCAST_HOSTS) -> DataFrame:
    """page_id, url, text, n_chars for each row of pages(page_id, url, html), from the whole html.

    Null html counts as empty and gives an empty text; a null url is a host of its own. Repeated rows
    vote and come out as often as they stand there; other columns are ignored. The table of winning
    paths is written and counted: up to broadcast_hosts rows it is broadcast, beyond that each row is
    repeated SALT times and pages are dealt to one of them by their html's hash.
    """
    paths = Scratch(pages.sparkSession, "html-paths").keep(host_paths(path_votes(pages)).withColumnRenamed("host", "_host"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", host_of(F.col("url")).alias("host"))
    if paths.count() <= broadcast_hosts:
        joined = rows.join(F.broadcast(paths), F.col("host") == F.col("_host"), "left")
    else:
        salted = paths.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("html"), F.lit(SALT)).cast("int"))
        joined = rows.join(salted, (F.col("host") == F.col("_host")) & (F.col("salt") == F.col("_salt")), "left")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            made = [Page(h).text(p) for h, p in zip(texts(batch, "html"), batch.column("path").to_pylist(), strict=True)]
            yield {"page_id": batch.column("page_id"), "url": batch.column("url"), "text": made, "n_chars": [len(t) for t in made]}

    return map_batches(joined.select("page_id", "url", "html", "path"), extract, "page_id long, url string, text string, n_chars long")
