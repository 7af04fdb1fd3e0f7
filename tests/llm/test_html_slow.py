"""Operator 9 against an independent slow version: another parser, a tree of lists, counts in dicts."""

import collections
import html as stdlib
import random
import re
from html.parser import HTMLParser

from pyspark.sql import functions as F

from panelframe.llm import html, queries

SF = "/root/testdata/sf0.01"
# of this test's own, in the sense of HTML: what its pages have and some more
BLOCKS = frozenset("address article aside body blockquote div dl dd dt fieldset figure footer form h1 h2 h3 head header hr html li main nav ol p pre section table td th tr title ul".split())
VOID = frozenset("br hr img input link meta".split())
PASSAGES = frozenset("p li blockquote pre dd dt td th tr h1 h2 h3".split())
CONTAINERS = BLOCKS - PASSAGES - frozenset("html head body main article hr title".split())
NEVER = frozenset("script style title html head body main article".split())
UNSEEN = frozenset("nav footer aside form script style head title".split())


class Tree(HTMLParser):
    """Elements as dicts, texts with the element around and the number of their block."""

    def __init__(self, page):
        super().__init__(convert_charrefs=False)
        self.root = {"tag": "#", "attrs": "", "kids": [], "up": None}
        self.at, self.block, self.texts, self.running = self.root, 0, [], False
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        self.running = False
        if tag in BLOCKS and tag not in ("td", "th", "tr", "body", "html", "head", "title"):
            x = self.at
            while x is not self.root and x["tag"] != "p":
                x = x["up"]
            if x is not self.root:
                self.at = x["up"]
        if tag == "li":
            x = self.at
            while x is not self.root and x["tag"] not in ("li", "ul", "ol"):
                x = x["up"]
            if x["tag"] == "li":
                self.at = x["up"]
        if tag in BLOCKS:
            self.block += 1
        said = sorted(" ".join(v for k, v in attrs if k in ("class", "id", "role") and v).lower().split())
        node = {"tag": tag, "attrs": " ".join(said), "kids": [], "up": self.at}
        self.at["kids"].append(node)
        if tag == "br":
            self.texts.append((" ", self.at, self.block))
        if tag not in VOID:
            self.at = node

    def handle_comment(self, data):
        self.running = False

    def handle_endtag(self, tag):
        self.running = False
        if tag in BLOCKS:
            self.block += 1
        x = self.at
        while x is not self.root and x["tag"] != tag:
            if tag not in BLOCKS and x["tag"] in BLOCKS:
                return
            x = x["up"]
        if x is not self.root:
            self.at = x["up"]

    def said(self, raw):
        self.at["kids"].append(raw)
        if self.running:
            raw = self.texts.pop()[0] + raw
        if self.at["tag"] not in ("script", "style", "title"):
            self.texts.append((raw, self.at, self.block))
            self.running = True

    handle_data = said

    def handle_entityref(self, name):
        self.said(stdlib.unescape(f"&{name};"))

    def handle_charref(self, name):
        self.said(stdlib.unescape(f"&#{name};"))


def ups(node):
    while node["up"] is not None:
        yield node
        node = node["up"]


def key(node):
    """Tag, attributes and what is below, as nested tuples; neighbouring texts count as one, empty elements as none."""
    below, run = [], ""
    for k in [*node["kids"], None]:
        if isinstance(k, str):
            run += k
            continue
        if run.split():
            below.append(" ".join(run.split()))
        run = ""
        if k is not None and (sub := key(k)) is not None:
            below.append(sub)
    return (node["tag"], node["attrs"], *below) if below else None


def slot(node):
    return tuple((x["tag"], x["attrs"]) for x in ups(node))


def walk(node):
    for k in node["kids"]:
        if not isinstance(k, str):
            yield k
            yield from walk(k)


def named(node):
    """Why what an element is removes it."""
    for x in reversed(list(ups(node))):
        if x["tag"] in UNSEEN or x["tag"] == "header" and not any(y["tag"] in ("article", "main") for y in ups(x)):
            return "role"
        if x["tag"] in CONTAINERS and {"comments", "respond", "comment-list"} & set(x["attrs"].split()):
            return "comment"
    return None


def slow(pages, least=(10, 3, 2), sure=30):
    """(text, code points that went by count, by article) of (url, html) pages; and the texts without any counts."""
    read = []
    for url, page in pages:
        host = m[1].lower() if (m := re.match(r"[a-zA-Z][\w+.-]*://([^/?#]*)", url or "")) else ""
        t = Tree(page or "")
        tops = [x for x in walk(t.root) if x["tag"] == "article"] or [x for x in walk(t.root) if x["tag"] == "main"]
        inside = lambda n, tops=tops: not tops or any(x is y for x in ups(n) for y in tops)
        around = {id(y) for x in tops for y in ups(x)}
        article = " ".join("".join(f" {x}" for x, n, _ in t.texts if inside(n)).split())
        may = {}
        for x in walk(t.root):
            if id(x) in around or key(x) is None:
                continue
            if inside(x):
                if x["tag"] in CONTAINERS:
                    may[id(x)] = ((1, key(x)), None)
                elif not tops and x["tag"] not in NEVER:
                    may[id(x)] = ((0, key(x)), None)
            elif x["tag"] in CONTAINERS or x["tag"] in PASSAGES and (x["up"]["tag"] in ("body", "html", "#") or id(x["up"]) in around):
                may[id(x)] = ((2, key(x)), slot(x))
        read.append((host, article, t, inside, may))
    seen = collections.defaultdict(dict)
    for host, article, _, _, may in read:
        for k, s in may.values():
            old = seen[host, k].get(article)
            seen[host, k][article] = s if old is None or repr(s) < repr(old) else old
    often = {k for k, v in seen.items() if len(v) >= least[k[1][0]]}
    stand, recur = collections.Counter(), collections.Counter()
    for k, by_article in seen.items():
        for s in by_article.values():
            if s is not None:
                stand[k[0], s] += 1
                recur[k[0], s] += k in often
    template = {k for k, n in recur.items() if n >= least[1] and 4 * n >= stand[k]}
    text = {k for k, n in stand.items() if n >= sure and 20 * recur[k] < n} - template
    out = []
    for host, _, t, inside, may in read:
        verdict = {}
        for i, (k, s) in may.items():
            if (host, k) in often or s is not None and (host, s) in template:
                verdict[i] = "count"
            elif s is not None and (host, s) not in text:
                verdict[i] = "article"
        both = []
        for known in (verdict, {}):
            blocks, went = [], collections.Counter()
            for said, node, block in t.texts:
                why = next((known[id(x)] for x in reversed(list(ups(node))) if id(x) in known), None) or named(node)
                if why is None and not inside(node) and not any(id(x) in may for x in ups(node)):
                    why = "article"
                if why:
                    went[why] += len(" ".join(said.split()))
                else:
                    if not blocks or blocks[-1][0] != block:
                        blocks.append((block, ""))
                    blocks[-1] = (block, blocks[-1][1] + said)
            both.append(("\n\n".join(x for x in (" ".join(b.split()) for _, b in blocks) if x), went["count"], went["article"]))
        out.append((*both[0], both[1][0]))
    return out


def made(i, rng):
    """A page of one of four hosts: menus, rotating adverts, notices without a telling name, an article or plain divisions."""
    host = f"h{i % 4}.example"
    menu = "".join(f"<li><a href='/{w}'>{w}</a></li>" for w in ("home", "news", host[:2]))
    advert = f"<div class='box{i % 2}'><p>Offer {rng.randrange(3)} of {host}</p></div>"
    once = f"<div class='counter'><span>{rng.randrange(10**6)} visits</span></div>"
    body = "".join(f"<p>{' '.join(rng.choice('red green blue old new tall river house'.split()) for _ in range(rng.randrange(1, 9)))} {i}.{j}</p>" for j in range(rng.randrange(1, 5)))
    quote = "<p>Said by many &amp; quoted.</p>" * (i % 3 == 0)
    share = "<div class='tools'>Print this page</div>"
    text = f"<article><h1>Story {i}</h1>{body}{quote}{share}<ul><li>one {i}</li><li>two</li></ul></article>" if i % 4 < 3 else f"<div class='story'>{body}{quote}</div>"
    return f"http://{host}/p{i}", f"<html><head><title>T{i}</title></head><body><div class='top'><ul>{menu}</ul></div>{advert}{once}{text}<div class='end'>About {host}</div></body></html>"


def test_counts_against_the_slow_version(spark):
    rng = random.Random(3)
    pages = [made(i, rng) for i in range(160)]
    pages += [("http://h1.example/copy", pages[1][1])] * 4  # copies of one article count once
    pages += [(None, None), ("http://h0.example/", ""), ("odd", "<p>alone")]
    df = spark.createDataFrame([(i, u, p, "mine", 7) for i, (u, p) in enumerate(pages)], "page_id long, url string, html string, gone string, host int")
    got = {r.page_id: r for r in html.extract(df, report="went").collect()}
    want = slow(pages)
    assert len(got) == len(pages)
    for i, (text, counted, tied, _) in enumerate(want):
        assert (got[i].text, got[i].went.by_count, got[i].went.by_article) == (text, counted, tied), pages[i]
        assert got[i].gone == "mine" and got[i].host == 7
    # without the counts every page with a template keeps it: they, and no name, class or article, remove it
    for i in range(160):
        alone = html.main_text(pages[i][1], set())[0]
        assert alone == want[i][3] != got[i].text and "Offer" in alone and "Offer" not in got[i].text and "About" not in got[i].text
    assert "Story 1" in got[1].text and "Print this page" not in got[1].text and "Said by many" in got[0].text
    assert [sum(getattr(r.went, c) for r in got.values()) for c in ("by_role", "by_comment")] == [0, 0]


def test_given_pages_by_counts(spark):
    """The texts are the slow version's, and those of the articles; without counts no page has its right text."""
    rows = queries.op9_template_removal(spark, SF).collect()
    pages = {r.page_id: (r.url, r.html) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    ids = sorted(pages)
    want = dict(zip(ids, slow([pages[i] for i in ids]), strict=True))
    for r in rows:
        text, counted, tied, alone = want[r.page_id]
        assert (r.text, r.by_count, r.by_article, r.n_chars) == (text, counted, tied, len(text))
        article = "".join(re.findall("<article>.*?</article>", pages[r.page_id][1], re.S))
        assert r.text == html.main_text(article, set())[0] != alone == html.main_text(pages[r.page_id][1], set())[0]


def test_text_beside_the_article_stays_where_it_never_recurs(spark):
    """A place where thirty pages say thirty things holds text, in or out of the article; menus and rotating adverts of the same pages go; so do readers' comments."""
    def page(i):
        return f"<body><div class='menu'>Home News {i % 3}</div><div class='lead'><p>Lead of story {i}.</p></div><article><header><p>First words {i}</p></header><p>Body {i}</p></article><article><p>Second story {i}</p></article><div class='ad'>Buy {i % 12}</div><div class='comments'><p>Reader {i} says</p></div></body>"

    rows = [(i, "http://a.example/p", page(i)) for i in range(40)] + [(100 + i, "http://few.example/", page(i)) for i in range(5)]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"Lead of story {i}.\n\nFirst words {i}\n\nBody {i}\n\nSecond story {i}" for i in range(40))
    assert all(got[100 + i] == f"First words {i}\n\nBody {i}\n\nSecond story {i}" for i in range(5))  # five pages can't say: the articles do


def test_pages_without_article_or_main(spark):
    def page(i):
        return f"<body><div id='x1'><ul><li>Home</li><li>About</li></ul></div><div id='x2'>Offer {i % 4}</div><div id='x3'><h1>Story {i}</h1><p class='reply-to-critics'>It was {i}.</p><p>Shared words.</p></div><div id='x4'>Contact</div></body>"

    rows = [(i, "http://a.example/p", page(i)) for i in range(30)]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"Story {i}\n\nIt was {i}." for i in range(30))
    assert html.main_text(rows[7][2], set())[0] == "Home\n\nAbout\n\nOffer 3\n\nStory 7\n\nIt was 7.\n\nShared words.\n\nContact"


def test_words_in_names_decide_nothing():
    page = "<article><section class='cookie-recipes'><p>Mix flour</p></section><div class='share-prices'>Up</div><p id='reply-to-critics'>No</p><div id='comments-on-the-law'>Yes</div></article>"
    assert html.main_text(page, set())[0] == "Mix flour\n\nUp\n\nNo\n\nYes"


def test_large_and_small_hosts(spark):
    """A host's growth never makes text of its template; a host of one page has nothing to count."""
    rows = [(i, "http://big.example/", f"<body><div class='s{i % 40}'>Section {i % 40}</div><div class='t'><p>Story number {i}</p></div></body>") for i in range(400)]
    rows += [(1000, "http://small.example/", "<body><div>Once</div><nav>Menu</nav><div id='comments'>Me too</div></body>")]
    got = {r.page_id: r for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), report="w").collect()}
    assert all(got[i].text == f"Story number {i}" for i in range(400))
    assert got[1000].text == "Once" and (got[1000].w.by_count, got[1000].w.by_role, got[1000].w.by_comment) == (0, 4, 6)


def test_own_columns_may_clash(spark):
    df = spark.createDataFrame([(1, "http://a/", "<p>x</p>", "old", 3, 4)], "page_id long, url string, html string, text string, page long, subtrees int")
    out = html.extract(df)
    assert out.columns == ["page_id", "url", "page", "subtrees", "text"] and out.first().text == "x"
    kept = html.extract(df, out="main").first()
    assert kept.text == "old" and kept.main == "x"
    assert html.extract(df.limit(0)).agg(F.count("text")).first()[0] == 0
