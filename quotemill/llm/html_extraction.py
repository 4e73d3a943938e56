"""Main text of web pages by wrapper induction.

A page becomes a tree of its block elements; the runs of text between block borders are its slots. One page
of each host, chosen by a hash, is the pivot. Every page of the host is aligned to it by simple tree matching
(the largest set of node pairs that keeps order and ancestry; equal text counts extra). Over all pages the
job sums, for each slot of the pivot, how often it was aligned and how often its text was the same.
A slot that is the same on nearly all pages belongs to the template; the others vary and hold content. A page
whose article is mostly the pivot's own (a copy) says nothing about the template and has no vote.

What varies may still be a menu or an advert, so a slot counts as content only outside regions that the
markup itself so names (``nav``, ``footer``, ``class="ad"`` and so on; within an article fewer names do), and inside
``article`` or ``main`` if that holds at least a third of the text left, so that a teaser card does not stand for
the page. In a page without either, slots that are mostly link are left out too.

Pages are read by one position that only moves on, trees are walked with stacks of their own: broken tags and deep
nesting cost time in proportion to the page and end no job.

Alignment is per page and the votes are sums, so a host with a third of all pages is no group in any task. The rows
chosen as pivots are a written table of a row per host, so finding their pages moves no page while it is small.
Pivots are broadcast while all of them together are below ``PIVOT_BYTES``, and joined by host beyond that.

* null or empty html: empty text; * null url: all such pages share the host ''; * a host with few pages: no
template, the markup alone decides; * repeated rows: each gets a row; * a very long page: more than ``PAIRS`` pairs of
siblings are aligned in order between equal ones, not by the quadratic table; * empty table: empty result.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotemill.llm.common import map_batches
from quotemill.session import settle

PIVOT_BYTES = 64 << 20
PAIRS = 20_000
# share of equal text, number of votes: inside an article or main element, and elsewhere
INSIDE, OUTSIDE = (0.9, 10), (0.8, 3)

# Fixed values of the HTML language, and words that name regions beside the article.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template textarea title iframe svg object canvas audio video select".split())
BLOCK = set(
    "address article aside blockquote body button center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody "
    "td tfoot th thead tr ul caption".split()
)
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "tbody": {"thead", "tr", "td", "th"}, "body": {"head"},
}
KEEPS_P = {"button", "td", "th", "caption", "object"}
ASIDE_TAGS = {"nav", "footer", "aside", "form", "head", "menu", "dialog", "search", "button", "fieldset"}
ASIDE_WORDS = set(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar side menu nav navbar "
    "navigation breadcrumb breadcrumbs footer cookie cookies consent gdpr notice notices notification popup modal overlay "
    "newsletter subscribe subscription signup share sharing social related recommended recommendations comment comments reply "
    "replies disqus respond discussion widget login search skip copyright legal pagination pager toolbar alert toast paywall "
    "masthead topbar hidden".split()
)
ASIDE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu", "menubar"}
# names that an article uses for its own parts
ARTICLE_WORDS = {"alert", "legal", "search", "side"}
MARKUP = re.compile(r"<!--|<(/?)([a-zA-Z][^\s/>]*)|<[!?/]")
SPECIAL = re.compile(r"[>\"']")
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
TOLD = re.compile(r"(?i)class|id|role|hidden|style|itemprop")
EXCLUDED, BODY, MAIN, ARTICLE = 0, 1, 2, 3


class Node:
    """A block element, or a slot (``kids`` is None). ``key`` is what two aligned nodes share."""

    __slots__ = ("key", "tag", "kids", "zone", "text", "linked", "place")

    def __init__(self, tag: str, key: str, zone: int):
        self.tag, self.key, self.zone = tag, key, zone
        self.kids: list[Node] | None = []
        self.text, self.linked, self.place = "", False, -1


def zone_of(tag: str, told: str, outer: int) -> int:
    """The zone inside an element, from its tag, its attributes and the zone around it."""
    if outer == EXCLUDED or tag in ASIDE_TAGS or (tag == "header" and outer < ARTICLE):
        return EXCLUDED
    zone = max(outer, ARTICLE if tag == "article" else MAIN if tag == "main" else BODY)
    if told and TOLD.search(told):
        given = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(told)}
        names = set(re.split(r"[^a-z]+", f"{given.get('class', '')} {given.get('id', '')}".lower()))
        shown = "hidden" not in given and not re.search(r"display:\s*none", given.get("style", ""), re.I)
        words = ASIDE_WORDS - ARTICLE_WORDS if outer == ARTICLE else ASIDE_WORDS
        if not shown or names & words and tag not in ("body", "html", "main") or given.get("role", "").lower() in ASIDE_ROLES:
            return EXCLUDED
        if "header" in names and outer < ARTICLE and tag not in ("body", "html", "main", "article"):
            return EXCLUDED
        if given.get("itemprop", "").lower() == "articlebody":
            zone = ARTICLE
        elif given.get("role", "").lower() == "main":
            zone = max(zone, MAIN)
    return zone


def tags(html: str) -> Iterator[tuple[int, int, bool, str, str]]:
    """Start, end, whether it closes, name and attributes of each tag; comments and the like have no name.

    A tag ends at the first ``>`` outside quotes, or at the first at all if the quotes do not end. A quote from which
    the end of the page was met is not tried again, so the whole is linear.
    """
    at, last = 0, html.rfind(">")
    hopeless: set[int] = set()
    while match := MARKUP.search(html, at):
        start = match.start()
        if match[0] == "<!--":
            end = html.find("-->", start + 4)
            at = len(html) if end < 0 else end + 3
            yield start, at, False, "", ""
            continue
        if start > last:  # no tag ends any more: only an open comment can follow
            start = html.find("<!--", start)
            if start >= 0:
                yield start, len(html), False, "", ""
            return
        close, name = match[1], match[2]
        end, tried = match.end(), []
        while name:
            sign = SPECIAL.search(html, end)
            if sign is None or sign.start() in hopeless:
                name = None
            elif sign[0] == ">":
                end = sign.start()
                break
            else:
                tried.append(sign.start())
                end = html.find(sign[0], sign.end()) + 1
                name = name if end else None
        if name:
            at = end + 1
            yield start, at, bool(close), name.lower(), html[match.end() : end]
        else:
            hopeless.update(tried)
            at = html.find(">", match.end()) + 1
            if not at:
                return
            yield start, at, False, "", ""


def parse(html: str) -> tuple[Node, list[Node]]:
    """The tree of a page and its slots in page order."""
    root = Node("#root", "#root", BODY)
    stack, slots = [root], []
    pieces: list[str] = []
    seen = {"link": 0, "all": 0, "open": 0, "out": 0}
    inner: list[tuple[str, bool]] = []  # inline elements that name a region of their own, open now
    depths: dict[str, list[int]] = defaultdict(list)  # where in the stack each tag is open

    def put(text: str) -> None:
        if text and stack[-1].zone != EXCLUDED and not seen["out"]:
            pieces.append(text)
            size = len(text) - text.count(" ")
            seen["all"] += size
            seen["link"] += size if seen["open"] else 0

    def flush() -> None:
        if pieces:
            text = " ".join(entities.unescape("".join(pieces)).split())
            if text:
                slot = Node("#text", "#text", stack[-1].zone)
                slot.kids, slot.text, slot.place = None, text, len(slots)
                slot.linked = 2 * seen["link"] > seen["all"]
                stack[-1].kids.append(slot)
                slots.append(slot)
        pieces.clear()
        seen["all"] = seen["link"] = 0

    def close(tags: set[str], stops: set[str]) -> None:
        depth, stop = (max((depths[t][-1] for t in names if depths.get(t)), default=0) for names in (tags, stops))
        if depth and depth >= stop:
            flush()
            for node in stack[depth:]:
                depths[node.tag].pop()
            del stack[depth:]
            leave()

    def leave() -> None:
        inner.clear()
        seen["out"] = 0

    at = skip = 0
    lower = None
    for start, stop, closes, tag, told in tags(html):
        if start < skip:
            continue
        put(html[max(at, skip) : start])
        at = stop
        if not tag:
            continue
        if closes:
            if tag in BLOCK:
                close({tag}, {"html"})
            elif tag == "a":
                seen["open"] = max(0, seen["open"] - 1)
            if inner and inner[-1][0] == tag:
                seen["out"] -= inner.pop()[1]
        elif tag in RAW:
            if told.rstrip().endswith("/") and tag == "svg":
                continue
            lower = html.lower() if lower is None else lower
            end = lower.find(f"</{tag}", stop)
            skip = len(html) if end < 0 else end
            at = skip
        elif tag == "br":
            put(" ")
        elif tag in BLOCK:
            if tag in CLOSES:
                close(CLOSES[tag], {"ul", "ol", "table", "dl", "div", "article", "select"} - {tag})
            close({"p"}, KEEPS_P)
            flush()
            if tag != "hr":
                zone = zone_of(tag, told, stack[-1].zone)
                named = re.search(r"class\s*=\s*[\"']?([\w-]*)", told)
                node = Node(tag, f"{tag}.{named[1]}" if named else tag, zone)
                if zone != EXCLUDED:
                    stack[-1].kids.append(node)
                depths[tag].append(len(stack))
                stack.append(node)
                leave()
        elif tag == "a":
            seen["open"] += 1
        if tag not in BLOCK and tag not in VOID and tag not in RAW and not closes and (inner or TOLD.search(told)):
            inner.append((tag, zone_of(tag, told, stack[-1].zone) == EXCLUDED))
            seen["out"] += inner[-1][1]
    put(html[max(at, skip) :])
    flush()
    return fold(root), slots


def fold(node: Node) -> Node:
    """Elements that hold one slot and nothing else become that slot; empty ones go."""
    below = [node]
    for element in below:  # grows while it is walked: elements before what they hold
        below += (kid for kid in element.kids if kid.kids is not None)
    for element in reversed(below):
        kids = []
        for kid in element.kids:
            if kid.kids is not None and len(kid.kids) == 1 and kid.kids[0].kids is None:
                path = f"{kid.key}>{kid.kids[0].key}"
                # a digest keeps the keys of deep chains short, and equal where the paths are
                kid.kids[0].key = path if len(path) < 500 else hashlib.blake2b(path.encode(errors="replace")).hexdigest()
                kids.append(kid.kids[0])
            elif kid.kids is None or kid.kids:
                kids.append(kid)
        element.kids = kids
    return node


def ends(a: list[Node], b: list[Node]) -> tuple[int, int]:
    """How many siblings at the head and at the tail of two lists are equal slots."""
    equal = lambda x, y: x.kids is None and y.kids is None and x.text == y.text and x.key == y.key
    head = tail = 0
    while head < len(a) and head < len(b) and equal(a[head], b[head]):
        head += 1
    while tail < min(len(a), len(b)) - head and equal(a[-1 - tail], b[-1 - tail]):
        tail += 1
    return head, tail


def matching(a: list[Node], b: list[Node], memo: dict) -> tuple[int, list[tuple[int, int]]]:
    """The best order-keeping pairing of two lists of siblings, and its weight. Pairs of elements below come first."""
    todo: list[tuple[tuple[int, int] | None, list[Node], list[Node], bool]] = [(None, a, b, False)]
    while todo:
        name, left, right, ready = todo.pop()
        if name in memo:
            continue
        if ready:
            memo[name] = pairing(left, right, memo)
            continue
        if name is not None:
            todo.append((name, left, right, True))
        head, tail = ends(left, right)
        left, right = left[head : len(left) - tail], right[head : len(right) - tail]
        if len(left) * len(right) > PAIRS:
            continue
        likes = defaultdict(list)
        for y in right:
            if y.kids is not None:
                likes[y.key].append(y)
        for x in left:
            if x.kids is not None:
                todo += (
                    ((id(x), id(y)), x.kids, y.kids, False) for y in likes.get(x.key, ()) if (id(x), id(y)) not in memo
                )
    return pairing(a, b, memo)


def pairing(a: list[Node], b: list[Node], memo: dict) -> tuple[int, list[tuple[int, int]]]:
    """One level of ``matching``: the weights of pairs of elements are in ``memo``."""
    head, tail = ends(a, b)
    pairs = [(i, i) for i in range(head)] + [(len(a) - 1 - i, len(b) - 1 - i) for i in range(tail)]
    total = 2 * (head + tail)
    left, right = a[head : len(a) - tail], b[head : len(b) - tail]
    if not left or not right:
        return total, pairs
    if len(left) * len(right) > PAIRS:
        return total, pairs + [(head + i, head + j) for i, j in in_order(left, right)]
    width = len(right)
    rows = [[0] * (width + 1)]
    weights = []
    for x in left:
        above, row, own = rows[-1], [0], []
        for j, y in enumerate(right):
            w = weight(x, y, memo)
            own.append(w)
            best = above[j] + w if w else 0
            if above[j + 1] > best:
                best = above[j + 1]
            if row[j] > best:
                best = row[j]
            row.append(best)
        rows.append(row)
        weights.append(own)
    i, j = len(left), width
    while i and j:
        w = weights[i - 1][j - 1]
        if w and rows[i][j] == rows[i - 1][j - 1] + w:
            i, j = i - 1, j - 1
            pairs.append((head + i, head + j))
        elif rows[i][j] == rows[i - 1][j]:
            i -= 1
        else:
            j -= 1
    return total + rows[-1][-1], pairs


def in_order(a: list[Node], b: list[Node]) -> list[tuple[int, int]]:
    """Pairs of long lists: slots whose text is unique and equal, then like nodes in order between them."""
    once = lambda nodes: Counter((n.key, n.text) for n in nodes if n.kids is None)
    in_a, in_b = once(a), once(b)
    spot = {(n.key, n.text): j for j, n in enumerate(b) if n.kids is None}
    anchors, last = [], -1
    for i, n in enumerate(a):
        name = (n.key, n.text)
        if n.kids is None and in_a[name] == 1 and in_b.get(name) == 1 and spot[name] > last:
            last = spot[name]
            anchors.append((i, last))
    pairs, i, j = [], 0, 0
    for x, y in [*anchors, (len(a), len(b))]:
        while i < x and j < y:
            if a[i].key == b[j].key:
                pairs.append((i, j))
                i, j = i + 1, j + 1
            elif x - i >= y - j:
                i += 1
            else:
                j += 1
        if x < len(a):
            pairs.append((x, y))
        i, j = x + 1, y + 1
    return pairs


def weight(a: Node, b: Node, memo: dict) -> int:
    """Simple tree matching: how many node pairs two trees share; equal text counts one more."""
    if a.key != b.key or (a.kids is None) != (b.kids is None):
        return 0
    if a.kids is None:
        return 2 if a.text == b.text else 1
    name = (id(a), id(b))
    if name not in memo:
        memo[name] = matching(a.kids, b.kids, memo)
    return 1 + memo[name][0]


def align(pivot: Node, page: Node, memo: dict, found: dict[int, Node]) -> None:
    """Fill ``found``: the slot of the pivot for each place of a slot of the page."""
    todo = [(pivot, page)]
    while todo:
        a, b = todo.pop()
        name = (id(a), id(b))
        _, pairs = memo[name] if name in memo else matching(a.kids, b.kids, memo)
        for i, j in pairs:
            x, y = a.kids[i], b.kids[j]
            if x.kids is None and y.kids is None:
                found[y.place] = x
            elif x.kids is not None and y.kids is not None:
                todo.append((x, y))


SLOT = "struct<text: string, place: int, same: boolean, zone: int, linked: boolean>"


def slots_of(html: str | None, pivot: tuple[Node, list[Node]]) -> tuple[list[dict], bool]:
    """The slots of a page that are not excluded, with their place in the pivot, and whether the page may vote."""
    tree, slots = parse(html or "")
    found: dict[int, Node] = {}
    align(pivot[0], tree, {}, found)
    best = max((s.zone for s in pivot[1]), default=BODY)
    whole = sum(len(s.text) for s in pivot[1] if s.zone == best)
    equal = sum(len(x.text) for y, x in found.items() if x.zone == best and slots[y].text == x.text)
    out = []
    for slot in slots:
        mate = found.get(slot.place)
        same = mate is not None and mate.text == slot.text
        out.append({"text": slot.text, "place": mate.place if mate else -1, "same": same, "zone": slot.zone, "linked": slot.linked})
    return out, bool(slots) and 2 * equal <= whole


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out a single time, however often it is used."""
    return F.transform(F.array(value), use)[0]


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars``."""
    host = F.lower(F.coalesce(F.regexp_extract("url", r"^[A-Za-z][\w+.-]*://([^/?#]*)", 1), F.lit("")))
    keyed = pages.select(F.col("page_id").cast("long"), "url", "html", host.alias("host"))
    rank = F.struct(F.xxhash64("url", "page_id").alias("rank"), "page_id", "url")
    chosen = keyed.filter("html is not null and html <> ''").groupBy("host").agg(F.min(rank).alias("best"))
    chosen = settle(chosen, "html-chosen")
    same_row = (
        (keyed["host"] == F.col("at"))
        & keyed["page_id"].eqNullSafe(F.col("best.page_id"))
        & keyed["url"].eqNullSafe(F.col("best.url"))
    )
    pivots = settle(
        keyed.join(chosen.withColumnRenamed("host", "at"), same_row).groupBy("host").agg(F.min("html").alias("pivot")), "html-pivots"
    )
    size = pivots.agg(F.sum(F.octet_length("pivot"))).first()[0] or 0
    joined = keyed.join(F.broadcast(pivots) if size <= PIVOT_BYTES else pivots, "host", "left")

    def setup():
        known: dict[str, tuple[Node, list[Node]]] = {}

        def work(ids, urls, hosts, htmls, sources):
            made = []
            for name, page, source in zip(hosts, htmls, sources, strict=True):
                if name not in known:
                    if len(known) >= 256:
                        known.clear()
                    known[name] = parse(source or "")
                made.append(slots_of(page, known[name]))
            return ids, urls, hosts, [m[0] for m in made], [m[1] for m in made]

        return work

    schema = f"page_id long, url string, host string, slots array<{SLOT}>, votes boolean"
    slots = settle(
        map_batches(joined.select("page_id", "url", "host", "html", "pivot"), setup, schema, rows=128), "html-slots"
    )
    voters = slots.filter("votes").select("host", F.size("slots").alias("n"), "slots")
    per_host = voters.groupBy("host").agg(F.count("*").alias("n_pages"))
    votes = (
        voters.select("host", F.explode("slots").alias("s"))
        .filter("s.place >= 0")
        .groupBy("host", "s.place")
        .agg(F.count("*").alias("n"), F.sum(F.col("s.same").cast("int")).alias("n_same"))
        .join(per_host, "host")
        .filter("2 * n >= n_pages")
    )
    # bounded by the slots of a pivot, for each host
    template = votes.groupBy("host").agg(
        *(
            F.array_compact(F.collect_list(F.when((F.col("n_same") >= share * F.col("n")) & (F.col("n") >= least), F.col("place")))).alias(name)
            for name, (share, least) in (("inside", INSIDE), ("outside", OUTSIDE))
        )
    )
    template = settle(template, "html-template")
    none = F.array().cast("array<int>")

    def own(s: Column) -> Column:  # another text at a place of the template is content
        inside, outside = (
            ~(s["same"] & F.array_contains(F.coalesce(name, none), s["place"])) for name in ("inside", "outside")
        )
        return F.when(s["zone"] > BODY, inside).otherwise(outside & ~s["linked"])

    def zone_in(kept: Column) -> Column:
        sizes = F.aggregate(
            kept,
            F.struct(*(F.lit(0).cast("long").alias(name) for name in ("body", "main", "article"))),
            lambda n, s: F.struct(
                *(
                    (n[name] + F.when(s["zone"] >= zone, F.length(s["text"])).otherwise(0)).alias(name)
                    for name, zone in (("body", BODY), ("main", MAIN), ("article", ARTICLE))
                )
            ),
        )
        enough = lambda n, name: (n[name] > 0) & (3 * n[name] >= n["body"])
        return once(sizes, lambda n: F.when(enough(n, "article"), ARTICLE).when(enough(n, "main"), MAIN).otherwise(BODY))

    def content(kept: Column) -> Column:
        within = once(zone_in(kept), lambda zone: F.filter(kept, lambda s: s["zone"] >= zone))
        return F.array_join(F.transform(within, lambda s: s["text"]), " ")

    # numbers of slots of the pivots: smaller than the pivots
    texts = slots.join(F.broadcast(template) if size <= PIVOT_BYTES else template, "host", "left")
    text = once(F.filter("slots", own), content)
    return texts.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))
