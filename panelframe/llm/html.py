"""Operator 9: main text of web pages by site template removal.

A page is read once as a tree. The hash of an element's subtree covers its tag, class, id, role and
text below. Spark counts by host on how many different articles' pages a hash occurs, and what the counts say goes:

- a container, which is a block element that is no passage, that recurs on `min_beside` of them beside an article (or main), or on `min_pages` inside one or
  on pages without one, is template; so is a passage (paragraph, heading, list item, inline element) on `min_passages` pages without an article;
- a place beside the article (the path of tags and classes down to an element) is a template slot if `min_pages` of
  what stands there recurs, and a quarter of all that stands there: what stands there once goes too (rotating adverts);
- a place where `sure` different things stand and less than a twentieth recurs holds text: it stays, though it lies outside the article;
- where there are too few pages to say either, the article breaks the tie: what stands in such a place goes.

Thresholds are counts of articles, or shares of one place beside articles, so that a host's growth never makes text of its template.
Copies of an article on a host count once. Inside an article passages are never template: a paragraph that many
articles quote is text.

What counts can't see goes by what it is: script, style and form controls, nav, footer, aside and a page's header (ROLES), and
readers' comments, which differ from page to page, by whole names of classes or ids (COMMENTS). Text that stands in no block beside an article goes too.
All else is the text, with all articles of the page and their headers; it is split at block elements. `report` says how
many code points went by count, role, comment and article.

Null and empty pages have empty text. Equal rows are equal results. A null or odd url is the host ''. An empty table
gives an empty result. df's own columns may have any names; one called as the result is replaced.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelframe.llm.shared import bounded_batches, narrow, saved

# Element names and words of classes, in the sense of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp template noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
PASSAGE = HEADING | frozenset("p li blockquote pre dd dt td th tr tbody thead tfoot summary figcaption".split())
CONTAINER = BLOCK - PASSAGE - frozenset("html head body main article hr title".split())
WHOLE = RAW | frozenset("html head body main article".split())
ROLES = frozenset("nav footer aside form script style noscript iframe template dialog menu button select textarea input svg head title canvas object audio video search".split())
COMMENTS = frozenset("comments comment-list commentlist comments-area disqus_thread respond".split())
CLOSES_P = BLOCK - frozenset("td th tr tbody thead tfoot body html head title".split())
SAME = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr",), "th": ("tr",), "option": ("select",)}
PEERS = {"dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th")}

# possessive: a tag is read once, whatever its quotes are
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+)(?:>|\Z)""", re.S)
_MAIN = re.compile(r"""\brole\s*=\s*["']?main\b""", re.I)
_ATTR = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_RAW_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in RAW}
_HALF = 1 << 63


class _Node:
    __slots__ = ("attrs", "below", "by", "hash", "parent", "slot", "tag", "top")

    def __init__(self, tag: str, attrs: str, parent: _Node):
        self.tag, self.parent, self.attrs, words = tag, parent, "", ()
        if "=" in attrs:
            said = [x for m in _ATTR.findall(attrs) for x in m[1:] if x]
            if said:
                self.attrs = " ".join(sorted(" ".join(said).lower().split()))
                words = self.attrs.split()
        self.top = parent.top  # the outermost article around, or else the outermost main
        if tag == "article" and (self.top is None or self.top.tag != "article"):
            self.top = self
        elif self.top is None and (tag == "main" or "main" in words and _MAIN.search(attrs)):
            self.top = self
        self.by = parent.by  # what says itself what it is
        if self.by is None and (tag in ROLES or tag == "header" and parent.top is None):
            self.by = "role"
        elif self.by is None and words and tag in CONTAINER and not COMMENTS.isdisjoint(words):
            self.by = "comment"
        self.slot = xxhash.xxh64_intdigest(f"{tag}\1{self.attrs}", parent.slot)
        self.below: list[str] = []
        self.hash = 0


class _Root:
    tag, parent, top, by, attrs, slot = "#root", None, None, None, "", 0

    def __init__(self):
        self.below = []


def parse(page: str) -> tuple[list[tuple[str, _Node, int]], list[_Node]]:
    """(text, element around it, number of its block) pieces and all elements of a page, in document order.

    `open_at` holds where in the stack the open elements of each name are, so that no end tag searches the stack.
    """
    stack, nodes, pieces, block, at, n = [_Root()], [], [], 0, 0, len(page)
    open_at: dict[str, list[int]] = {}
    blocks_to = [0]  # open block elements up to each place of the stack

    def close(depth: int) -> None:
        while len(stack) > depth:
            node = stack.pop()
            blocks_to.pop()
            open_at[node.tag].pop()
            digest = xxhash.xxh64_intdigest("\0".join((node.tag, node.attrs, *node.below)))
            node.hash = digest - _HALF
            if node.below:
                stack[-1].below.append(f"{digest:016x}")
                node.below = [""]  # something is below; the parts have been read

    def last(*tags: str) -> int:
        return max((at[-1] for t in tags if (at := open_at.get(t))), default=0)

    def text(raw: str) -> None:
        if raw:
            said = html.unescape(raw) if "&" in raw else raw
            pieces.append((said, stack[-1], block))
            plain = " ".join(said.split())
            if plain:
                stack[-1].below.append(plain)

    def push(node: _Node) -> None:
        open_at.setdefault(node.tag, []).append(len(stack))
        stack.append(node)
        blocks_to.append(blocks_to[-1] + (node.tag in BLOCK))

    while at < n:
        m = _TAG.search(page, at)
        if not m:
            text(page[at:])
            break
        text(page[at : m.start()])
        at, tag = m.end(), (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if tag in BLOCK:
                block += 1
            depth = last(tag)
            if depth and (tag in BLOCK or blocks_to[-1] == blocks_to[depth]):
                close(depth)
            elif tag == "p":
                block += 1
            continue
        if tag in CLOSES_P:
            depth = last("p")
            if depth > last("table", "button", "object"):
                close(depth)
        if tag in SAME:
            depth = last(*PEERS.get(tag, (tag,)))
            if depth > last(*SAME[tag]):
                close(depth)
        if tag in BLOCK:
            block += 1
        node = _Node(tag, m[3] or "", stack[-1])
        nodes.append(node)
        if tag in VOID:
            if tag == "br":
                pieces.append((" ", stack[-1], block))
            elif tag == "hr":
                block += 1
            continue
        if tag in RAW:
            end = _RAW_END[tag].search(page, at)
            push(node)
            node.below.append(page[at : end.start() if end else n])
            close(len(stack) - 1)
            at = end.end() if end else n
            continue
        if (m[3] or "").rstrip().endswith("/") and tag in ("svg", "path", "use"):
            continue
        push(node)
    close(1)
    return pieces, nodes


# the last three bits of a key say what it is
PASSAGES, INSIDE, BESIDE, SLOT, OPEN = range(5)


class _Page:
    """A page's pieces and elements, and which of them counts can remove."""

    def __init__(self, page: str):
        self.pieces, self.nodes = parse(page)
        tops = {x.top for x in self.nodes if x.top is not None}
        self.tops = {x for x in tops if x.tag == "article"} or tops
        self.around: set[_Node] = set()  # the articles and what they stand in, which is never template
        for x in self.tops:
            while x.parent is not None and x not in self.around:
                self.around.add(x)
                x = x.parent

    def inside(self, x: _Node) -> bool:
        return not self.tops or x.top in self.tops

    def identity(self) -> int:
        """Of the article; of all text if there is none."""
        own = "".join(f" {said}" for said, node, _ in self.pieces if self.inside(node))
        return xxhash.xxh64_intdigest(" ".join(own.split())) - _HALF

    def keys(self, x: _Node) -> tuple[int, int]:
        """The subtree with its kind, and the place beside an article; 0 where there is nothing to count."""
        if x in self.around or not x.below:
            return 0, 0
        if self.inside(x):
            kind = INSIDE if x.tag in CONTAINER else PASSAGES if not self.tops and x.tag not in WHOLE else None
            return (0, 0) if kind is None else (x.hash & ~7 | kind, 0)
        if x.tag in CONTAINER or x.tag in BLOCK - WHOLE and (x.parent.tag in ("body", "html", "#root") or x.parent in self.around):
            return x.hash & ~7 | BESIDE, (x.slot - _HALF) & ~7 | SLOT
        return 0, 0


def read_page(page: str | None) -> tuple[int, list[tuple[int, int]]]:
    """Hash of the article, and (subtree, slot) of what may be template."""
    if not page:
        return 0, []
    p = _Page(page)
    return p.identity(), sorted({k for x in p.nodes if (k := p.keys(x))[0]})


def main_text(page: str | None, gone: set[int]) -> tuple[str, int, int, int, int]:
    """The text that the counts leave, and the code points that went by count, role, comment and article.

    gone: template subtrees and slots, and the slots that are open. Nothing is known of a page for which it is empty: then all
    that is visible stays.
    """
    went = {"count": 0, "role": 0, "comment": 0, "article": 0}
    if not page:
        return "", 0, 0, 0, 0
    p, why, counted = _Page(page), {}, set()
    for x in p.nodes:  # parents come first
        subtree, slot = p.keys(x)
        if subtree or x.parent in counted:
            counted.add(x)
        if x.parent in why:
            why[x] = why[x.parent]
        elif subtree and (subtree in gone or slot and slot in gone):
            why[x] = "count"
        elif slot and slot - SLOT + OPEN in gone:
            why[x] = "article"
    blocks: list[tuple[int, list[str]]] = []
    for said, node, block in p.pieces:
        reason = why.get(node) or node.by or (None if p.inside(node) or node in counted else "article")
        if reason:
            went[reason] += len(" ".join(said.split()))
        elif blocks and blocks[-1][0] == block:
            blocks[-1][1].append(said)
        else:
            blocks.append((block, [said]))
    parts = (" ".join("".join(x).split()) for _, x in blocks)
    return "\n\n".join(x for x in parts if x), *went.values()


def _subtrees(column: pa.Array) -> pa.Array:
    whole, found = [], []
    for v in column:
        a, pairs = read_page(v.as_py())
        whole.append(a)
        found.append([{"subtree": h, "slot": s} for h, s in pairs])
    kind = pa.list_(pa.struct([("subtree", pa.int64()), ("slot", pa.int64())]))
    return pa.StructArray.from_arrays([pa.array(whole, pa.int64()), pa.array(found, kind)], names=["article", "subtrees"])


_SAID = "struct<text:string,by_count:bigint,by_role:bigint,by_comment:bigint,by_article:bigint>"


def _text(page: pa.Array, gone: pa.Array) -> pa.Array:
    rows = [main_text(p.as_py(), set(g.as_py() or ())) for p, g in zip(page, gone, strict=True)]
    kinds = [pa.string(), *[pa.int64()] * 4]
    return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], kinds[i]) for i in range(5)], names=["text", "by_count", "by_role", "by_comment", "by_article"])


def template_keys(pages: DataFrame, min_beside: int = 2, min_pages: int = 3, min_passages: int = 10, sure: int = 30) -> DataFrame:
    """(page, host, html) to (page, gone): the subtrees and slots of the page that are its host's template, and its open slots."""
    found = pages.select("page", "host", F.arrow_udf(_subtrees, "article bigint, subtrees array<struct<subtree:bigint,slot:bigint>>")("html").alias("f"))
    found = saved(found.select("page", "host", "f.*"), "html-subtrees")
    each = found.select("host", "article", F.explode("subtrees").alias("s")).groupBy("host", "article", "s.subtree").agg(F.min("s.slot").alias("slot"))
    on = saved(each.groupBy("host", "subtree", "slot").agg(F.count(F.lit(1)).alias("pages")), "html-counts")
    least = F.element_at(F.array(*map(F.lit, (min_passages, min_pages, min_beside))), F.col("subtree").bitwiseAND(F.lit(7)).cast("int") + 1)
    often = on.groupBy("host", "subtree").agg(F.sum("pages").alias("n")).where(F.col("n") >= least)
    slots = on.where("slot <> 0").join(often.select("host", "subtree", F.lit(True).alias("often")), ["host", "subtree"], "left").groupBy("host", "slot")
    slots = slots.agg(F.sum("pages").alias("n"), F.sum(F.when(F.col("often"), F.col("pages")).otherwise(0)).alias("recur"))
    template = (F.col("recur") >= min_pages) & (4 * F.col("recur") >= F.col("n"))
    text = (F.col("n") >= sure) & (20 * F.col("recur") < F.col("n"))
    slots = slots.where(template | ~text).select("host", (F.col("slot") + F.when(template, 0).otherwise(OPEN - SLOT)).alias("key"), "n")
    keys = saved(often.select("host", F.col("subtree").alias("key"), "n").unionByName(slots), "html-keys")
    places = F.filter("subtrees.slot", lambda x: x != 0)
    own = found.select("page", "host", F.explode(F.array_distinct(F.concat(F.col("subtrees.subtree"), places, F.transform(places, lambda x: x + (OPEN - SLOT))))).alias("key"))
    # keys of very many pages (a large host's menu) are few: a hundred thousand at most by the bound, so that they are broadcast; no other key is hot
    bound = max(10_000, (keys.agg(F.sum("n")).first()[0] or 0) // 100_000)
    hot = F.broadcast(keys.where(F.col("n") >= bound).select("host", "key"))
    rest = own.join(hot, ["host", "key"], "left_anti").join(keys.where(F.col("n") < bound).select("host", "key"), ["host", "key"])
    return own.join(hot, ["host", "key"]).unionByName(rest).groupBy("page").agg(F.collect_set("key").alias("gone"))


def extract(df: DataFrame, url: str = "url", page: str = "html", min_beside: int = 2, min_pages: int = 3, min_passages: int = 10, sure: int = 30, out: str = "text", report: str | None = None) -> DataFrame:
    """df's columns but the page's source, and its main text as `out`; `report` names a struct of what went by count, role, comment and article."""
    bounded_batches(df.sparkSession)
    made = [out, *([report] if report else [])]
    keep = [c for c in df.columns if c != page and c not in made]
    key = F.xxhash64(*[F.col(f"`{c}`") for c in (url, page)])
    own = narrow(df, url=url, html=page).select(F.xxhash64("url", "html").alias("page"), F.lower(F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)).alias("host"), F.col("html").cast("string").alias("html"))
    # as a table of known size: Spark broadcasts it if it is small, else it sorts both sides
    gone = saved(template_keys(own, min_beside, min_pages, min_passages, sure), "html-template").select(F.col("page").alias("\u0001page"), F.col("gone").alias("\u0001gone"))
    found = df.withColumn("\u0001key", key).join(gone, F.col("\u0001key") == F.col("\u0001page"), "left")
    found = found.withColumn("\u0001said", F.arrow_udf(_text, _SAID)(F.col(f"`{page}`").cast("string"), F.col("\u0001gone")))
    said = F.col("\u0001said")
    return found.select(*[F.col(f"`{c}`") for c in keep], said["text"].alias(out), *([said.dropFields("text").alias(report)] if report else []))
