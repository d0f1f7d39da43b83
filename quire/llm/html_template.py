"""Main text of web pages by site template removal.

Every element subtree of a page is hashed, listed ones (nav, footer, a class ``sidebar``) included, in two ways: by
its text, and by its shape, that is by tag, class, id, role and, where it has none of these, the shapes within.
Spark counts, per host, the distinct pages that hold each hash; what recurs across pages of its host is the site's
template and is deleted:

* text that recurs, on few pages outside a content root and on most pages of the host inside one, as articles quote
  and copy each other;
* containers whose shape recurs outside the page's content root, so menus, adverts and footers go though they say
  something else on every page; inside it, only those that also say what they are.

The content root is ``main``, else ``article``, else the deepest container that holds half of the page's text.  Only
where a shape is on fewer than ``SHAPE_PAGES`` pages of its host, and so on every host of fewer pages, is there nothing
to count: such an element goes if it names itself, or if it stands outside a ``main`` or ``article``.

Pages are parsed twice rather than shuffled: what the second pass needs is a short list of hashes per host.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import materialise

#: Outside a content root: a template subtree is on this many pages of the host and on this share of them.
OUTER_PAGES, OUTER_SHARE = 3, 0.05
#: Inside one.
INNER_PAGES, INNER_SHARE = 10, 0.6
#: A shape is judged by its count from this many pages of the host on.
SHAPE_PAGES = 3
#: Of a page without ``main`` or ``article``: the share of text that makes a container its root, and from which an unnamed block is no template.
ROOT_SHARE, BLOCK_SHARE = 0.5, 0.15
#: Rows of (host, hash) that are broadcast at most: 16 bytes each and the host's name; beyond, a join, salted so often.
BROADCAST_ROWS, SALTS = 200_000, 16

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes title textarea".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rb rp rt rtc ruby s samp small span strike strong sub sup time tt u var wbr img".split())
#: Never text of an article, wherever they stand.
NEVER = frozenset("head script style template noscript iframe noembed noframes xmp svg math object embed canvas audio video map select textarea button dialog".split())
#: Elements whose tag says that they are no part of an article.
SAYING = frozenset("nav footer aside form menu".split())
#: Elements that are judged by their shape whatever they are called.
CONTAINERS = frozenset("div section nav header footer aside form ul ol dl table center menu fieldset details hgroup address".split())
CLOSES = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])), "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])), "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])), "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])), "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
}
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
HOLDS_P = frozenset("article aside section div td th table blockquote li dd main body html header footer nav form figure button caption".split())
NAMES = frozenset("ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert popup modal overlay sidebar sidenav menu menus nav navbar navigation breadcrumb breadcrumbs footer masthead topbar toolbar comment comments disqus replies respondents related recommended share sharing social newsletter subscribe subscription widget widgets pagination pager signup login search skip".split())
#: Of these the ones that an article's own blocks may be called.
MILD = frozenset("notice notices alert search widget widgets skip overlay promotion banner".split())
BODY_NAMES = frozenset("article content main post entry body text page container wrapper site layout".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|<([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^>"'])*)(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
WORD = re.compile(r"[a-z]+")

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"


def host_of(url: Column) -> Column:
    """Lower-cased host name of an address; empty where there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), HOST, 1))


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): next((x for x in m.groups()[1:] if x is not None), "") for m in ATTRIBUTE.finditer(raw)} if raw.strip(" /") else {}


def _hidden(at: dict[str, str]) -> bool:
    return "hidden" in at or at.get("aria-hidden", "").lower() == "true" or bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", at.get("style", ""), re.I))


def _says(tag: str, at: dict[str, str], names: set[str], in_root: bool) -> bool:
    """Whether an element says itself that it is no part of an article."""
    if tag in SAYING or tag == "header" and not in_root:
        return True
    if tag in ("html", "body", "main") or not at:
        return False
    if at.get("role", "").lower() in ROLES:
        return True
    bad = names & NAMES - (MILD if in_root else set())
    if tag == "article" and names & {"post", "entry", "story", "content"}:  # its own class may tell of its comments
        return False
    return bool(bad) and not (names & BODY_NAMES and not bad & {"comment", "comments", "ad", "ads"})


class Node:
    __slots__ = ("parent", "tag", "never", "says", "own", "parts", "shapes", "chars", "text_hash", "shape_hash", "root", "inside", "holds_root")

    def __init__(self, parent: Node | None, tag: str, never: bool = False, says: bool = False, own: str = ""):
        self.parent, self.tag, self.never, self.says, self.own = parent, tag, never, says, own
        self.parts: list[str] = []
        self.shapes: set[str] = set()
        self.chars, self.text_hash, self.shape_hash = 0, 0, 0
        self.root = self.inside = self.holds_root = False


def _hash(*parts: str) -> int:
    return xxhash.xxh64_intdigest("\x1f".join(parts).encode("utf-8", "surrogatepass"))


#: What the lowest bits of a hash tell: it is a shape, it lies inside a main or article, the element says what it is.
SHAPE, INSIDE, SAYS, TOLD = 1, 2, 4, 3


class Page:
    """One pass over a page: its elements with their hashes, and its pieces of text with the element each belongs to."""

    def __init__(self, html: str | None):
        self.html = html or ""
        self.top = Node(None, "")
        self.nodes: list[Node] = [self.top]
        self.pieces: list[tuple[Node, str]] = []
        self._walk()
        self._roots()

    def _walk(self) -> None:
        html, pieces = self.html, self.pieces
        stack = [self.top]

        def close(to: int) -> None:
            while len(stack) > to:
                node = stack.pop()
                up = stack[-1]
                if node.never:
                    continue
                up.chars += node.chars
                if node.tag in INLINE:
                    up.parts += node.parts
                    up.shapes |= node.shapes
                    continue
                if node.parts:
                    node.text_hash = _hash(node.tag, *node.parts)
                    up.parts.append(f"{node.text_hash:x}")
                shape = node.own if node.own != node.tag or node.tag in SAYING or node.tag == "header" else f"{node.tag}({' '.join(sorted(node.shapes))})"
                node.shape_hash = _hash(shape)
                up.shapes.add(f"{node.shape_hash:x}" if node.parts else "")
                pieces.append((up, "\n"))

        def text(raw: str) -> None:
            node = stack[-1]
            if node.never or not raw:
                return
            raw = unescape(raw) if "&" in raw else raw
            pieces.append((node, raw))
            if flat := " ".join(raw.split()):
                node.parts.append(flat)
                node.shapes.add("#")
                node.chars += len(flat)

        at = 0
        while m := TOKEN.search(html, at):
            text(html[at : m.start()])
            at = m.end()
            if m[1]:
                tag = m[1].lower()
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == tag:
                        if tag in INLINE and any(s.tag not in INLINE for s in stack[i + 1 :]):
                            break  # a formatting element that a block has outlived: nothing to close
                        close(i)
                        break
                    if stack[i].tag in ("article", "main", "body") and tag in INLINE | {"p"}:
                        break
                continue
            if not m[2]:
                continue
            tag = m[2].lower()
            if tag in ENDS_P:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == "p":
                        close(i)
                        break
                    if stack[i].tag in HOLDS_P:
                        break
            if tag in CLOSES:
                ends, holds = CLOSES[tag]
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag in holds:
                        break
                    if stack[i].tag in ends:
                        close(i)
                        if tag not in ("tr",):
                            break
            up = stack[-1]
            if tag in VOID:
                if tag in ("br", "hr") and not up.never:
                    pieces.append((up, "\n"))
                continue
            at_of = _attributes(m[3])
            names = set(WORD.findall(unescape(f"{at_of.get('class', '')} {at_of.get('id', '')}").lower()))
            never = up.never or tag in NEVER or tag not in ("html", "body") and _hidden(at_of)
            if tag in RAW:
                end = re.compile(rf"</{tag}\s*>|</{tag}(?=[\s/])[^>]*>", re.I).search(html, at)
                if not never and tag != "title":
                    text(html[at : end.start() if end else len(html)])
                at = end.end() if end else len(html)
                continue
            if m[3].endswith("/") and tag not in INLINE | ENDS_P:
                continue
            in_root = up.inside or up.tag in ("main", "article")
            own = ".".join([tag, *sorted(names), *([at_of["role"].lower()] if at_of.get("role") else [])])
            node = Node(up, tag, never, _says(tag, at_of, names, in_root), own)
            node.inside = in_root
            if not never and tag not in INLINE:
                pieces.append((node, "\n"))
            stack.append(node)
            self.nodes.append(node)
        text(html[at:])
        close(1)

    def _roots(self) -> None:
        """Mark the content root: main, else article, else the deepest container with half of the text."""
        live = [n for n in self.nodes if not n.never and n.chars]
        roots = [n for n in live if n.tag == "main"] or [n for n in live if n.tag == "article" and not n.says]
        self.explicit = bool(roots)
        if not roots:
            half = [n for n in live if n.tag in CONTAINERS and not n.says and n.chars >= ROOT_SHARE * self.top.chars]
            roots = half[-1:]  # the later of two such holds the other's half or lies within it
        for n in roots:
            n.root = True
            while n := n.parent:
                n.holds_root = True
        self.rooted = bool(roots)
        for n in self.nodes[1:]:  # parents come first
            n.inside = n.parent.root or n.parent.inside if self.rooted else False

    def _text_key(self, n: Node) -> int | None:
        if not n.text_hash or n.holds_root or n.tag in ("html", "body", "main", "article"):
            return None
        return n.text_hash >> TOLD << TOLD | (INSIDE if n.inside or n.root else 0)

    def _shape_key(self, n: Node) -> int | None:
        """The hash by which an element's shape is counted; none where shape alone would not tell."""
        if not n.shape_hash or not n.chars or n.never or n.root or n.holds_root or n.tag in ("html", "body", "main"):
            return None
        told = n.shape_hash >> TOLD << TOLD | SHAPE
        if n.says:
            return told | SAYS | (INSIDE if n.inside else 0)
        if n.inside or not self.rooted or n.tag not in CONTAINERS:
            return None
        return told if self.explicit or n.chars < BLOCK_SHARE * self.top.chars else None

    def subtrees(self) -> set[int]:
        """Signed hashes of all subtrees that are counted."""
        keys = {k for n in self.nodes[1:] if not n.never for k in (self._text_key(n), self._shape_key(n)) if k is not None}
        return {k - (1 << 64) if k >> 63 else k for k in keys}

    def text(self, template: frozenset[int] = frozenset(), counted: frozenset[int] = frozenset()) -> str:
        """Blocks in page order, white space turned into single spaces, without what is deleted.

        template: hashes to delete; counted: other shapes that are on pages enough to be judged by their count.
        """
        signed = lambda k: k - (1 << 64) if k is not None and k >> 63 else k
        gone, judged = {self.top: False}, {self.top: False}
        for n in self.nodes[1:]:
            judged[n] = judged[n.parent]
            if gone[n.parent] or n.never:
                gone[n] = True
                continue
            shape = signed(self._shape_key(n))
            if shape in template or signed(self._text_key(n)) in template:
                gone[n] = True
            elif shape is not None and shape in counted:
                gone[n], judged[n] = False, True
            else:  # nothing was counted: what says so goes, and what stands outside of a main or article
                outside = self.explicit and not (n.inside or n.root or n.holds_root)
                gone[n] = n.says and not n.root and not n.holds_root or outside and not judged[n]
        loose = {n for n in self.nodes if self.explicit and (n is self.top or n.holds_root)}  # text there stands between blocks
        return " ".join("".join("\n" if n in loose else t for n, t in self.pieces if not gone[n]).split())


def subtree_hashes(pages: DataFrame) -> DataFrame:
    """(host, page_id, hashes) of each page."""

    def run(batches):
        for b in batches:
            hashes = [list(Page(h).subtrees()) for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(hashes, pa.list_(pa.int64()))], ["host", "page_id", "hashes"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select(host_of(F.col("url")).alias("host"), "page_id", "html").mapInArrow(run, f"host string, page_id {kind}, hashes array<bigint>")


def template_subtrees(pages: DataFrame) -> DataFrame:
    """(host, h, template): the subtrees that recur on their host; pages of equal id count once.

    Text is listed only where it is template; shapes from SHAPE_PAGES pages on, template or not.
    """
    held = materialise(subtree_hashes(pages), "subtrees")
    size = held.groupBy("host", "page_id").agg(F.lit(1).alias("one")).groupBy("host").agg(F.count("*").alias("pages"))
    counts = held.select("host", "page_id", F.explode("hashes").alias("h")).groupBy("host", "h", "page_id").agg(F.lit(1).alias("one")).groupBy("host", "h").agg(F.count("*").alias("n"))
    has = lambda bit: F.col("h").bitwiseAND(F.lit(bit)) != 0
    least, share = (F.when(has(INSIDE), F.lit(x)).otherwise(y) for x, y in ((INNER_PAGES, OUTER_PAGES), (INNER_SHARE, OUTER_SHARE)))
    # a shape outside the content root, or one that says what it is, needs no share of the pages
    template = F.when(has(SHAPE), F.col("n") >= SHAPE_PAGES).otherwise((F.col("n") >= least) & (F.col("n") >= share * F.col("pages")))
    listed = counts.where(F.col("n") >= min(SHAPE_PAGES, OUTER_PAGES)).join(size, "host").select("host", "h", template.alias("template"))
    return listed.where(F.col("template") | has(SHAPE))


def extract(pages: DataFrame, recurring: DataFrame | None = None) -> DataFrame:
    """(page_id, url, text, n_chars), one row per input row.

    recurring: (host, h, template) as of ``template_subtrees``, which is counted here where it is not given.
    A null or empty html has an empty text; a null or broken url belongs to a host without name; repeated
    rows get equal texts and count as one page; an empty table gives an empty one.  Other columns are not read.
    """
    heavy = materialise(template_subtrees(pages), "template") if recurring is None else recurring
    per_host = heavy.groupBy("host").agg(F.sort_array(F.collect_list(F.when(F.col("template"), F.col("h")))).alias("template"), F.sort_array(F.collect_list(F.when(~F.col("template"), F.col("h")))).alias("counted"))  # bounded: a share of a page's elements
    named = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    if heavy.count() <= BROADCAST_ROWS:
        joined = named.join(F.broadcast(per_host), "host", "left")
    else:  # a host with a third of all pages is spread
        salted = per_host.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = named.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"], "left")

    def run(batches):
        known: dict[tuple, tuple[frozenset[int], frozenset[int]]] = {}
        for b in batches:
            texts = []
            for host, html, template, counted in zip(*(b.column(k).to_pylist() for k in (0, 3, 4, 5)), strict=True):
                if host not in known:
                    if len(known) > 100:
                        known.clear()
                    known[host] = (frozenset(template or ()), frozenset(counted or ()))
                texts.append(Page(html).text(*known[host]))
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return joined.select("host", "page_id", "url", "html", "template", "counted").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars bigint")
