"""Main text of web pages by wrapper induction.

Pages of one host share a template. All pages of a host, and of each of its layouts
(pages with the same containers), are aligned with pivot pages by simple tree matching,
furniture included. Nodes that are constant over more than half of the pages are
template, the slots whose text varies are content. At least three of these pages must
be no near copies of each other, so that copies don't make a text constant. Elements
whose tag, role, class or id says menu, header, footer, sidebar, notice, advert, form
or comments are no content, also where a host has too few pages to compare. A name says
so if it is such a word or consists of such words and of words for parts of a page
("cookie-notice", "share-buttons"), not if it merely has one ("search-engines"). If a page
marks its article, only that is read; elsewhere what is hidden from view is no content
either, and neither is a list of links ahead of the first prose.

Counts are aggregated before they are shuffled by host, layout and node, so a host
with a third of all pages is never gathered; its pages stay where they are.

Edge cases: null html has no text; an empty table gives an empty result; of pages that are
equally good pivots the one of the least content hash counts; pages without a host or with
unlike pages only use roles and names alone; markup that is cut off ends where the page ends, and of an element
whose end is missing the text stays; pages of any depth and width are read whole, an
unmatched end costs no search; repeated rows give repeated rows; other columns are not
read. White space is Unicode's, so a no-break space counts as a space too.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from functools import lru_cache, reduce

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftcorpus.llm.alignment import Tree, match
from weftcorpus.llm.common import drop, small_batches, table, trim, written

# Element and role names of HTML, and the usual names of page parts.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style iframe textarea title".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_CHROME_TAGS = frozenset("head nav header footer aside form button dialog menu noscript template svg select".split()) | _RAW
_CHROME_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
_CHROME_NAMES = frozenset(
    "nav navbar navigation menu submenu breadcrumb breadcrumbs masthead sidebar aside widget widgets ad ads adv advert adverts advertisement advertising adsense adslot banner promo promotion sponsor sponsored "
    "cookie cookies consent gdpr notice notices notification popup modal overlay newsletter subscribe subscription signup login share sharing social comment comments reply replies respond disqus "
    "related recommended recommendations pagination pager toolbar search searchbox copyright skip hidden".split()
)
#: Elements that hold prose: what a part of their name or their id says is no ground to drop them.
_PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre figure figcaption math dl dt dd".split())
_EDGE_NAMES = frozenset("header footer topbar bottombar".split())
_OWN_NAMES = frozenset("article post entry story content main body".split())
#: What names of page parts are made of besides: places, shapes and things on a page.
_PART_NAMES = frozenset(
    "area bar bars block blocks body bottom box btn button buttons center col column component container content desktop entry field fixed float foot form global group head icon icons info inner input item items js label layer left "
    "link links list lists main message mobile module msg outer page pages panel policy post posts primary reader readers region right row secondary section sections site slot slots sticky story stories text thread title top unit user users wrap wrapper zone article articles".split()
)
_CLOSES = {
    "p": frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul li dd dt".split()),
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "tbody", "tfoot", "thead"]),
    "td": frozenset(["td", "th", "tr", "tbody", "tfoot"]), "th": frozenset(["td", "th", "tr", "tbody", "tfoot"]), "option": frozenset(["option", "optgroup"]), "head": frozenset(["body"]),
}
_CLOSES |= {"select": _CLOSES["p"] - {"hr"} | {"select", "input", "textarea"}, "svg": _CLOSES["p"]}
_CLOSED_BY = {tag: [x for x, by in _CLOSES.items() if tag in by] for tag in frozenset().union(*_CLOSES.values())}
_SCOPE = frozenset("html body article main section div table td th ul ol nav header footer aside form foreignobject".split())

_CONTAINERS = frozenset("body main article section div table".split())

_CLASS = re.compile(r"(?:^|\s)class\s*=\s*[\"']?([^\"'>]*)", re.I)
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(>|\Z)", re.S)
_ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")


class Node:
    __slots__ = ("tag", "names", "children", "text", "chrome", "classes")

    def __init__(self, tag, names="", chrome=False, text=None, classes=""):
        self.tag, self.names, self.chrome, self.text, self.children, self.classes = tag, names, chrome, text, [], classes


@lru_cache(4096)
def _furniture(name: str) -> bool:
    """Whether a class or an id names a part of the page that is no content."""
    parts = [p for p in re.split(r"[-_:]+", name) if p and not p.isdigit()]
    if not all(p in _CHROME_NAMES or p in _EDGE_NAMES or p in _PART_NAMES for p in parts):
        return False
    return any(p in _CHROME_NAMES for p in parts) or any(p in _EDGE_NAMES for p in parts) and not any(p in _OWN_NAMES for p in parts)


def _is_chrome(tag: str, raw: str, inside: bool = False) -> tuple[bool, str]:
    """Whether an element is page furniture by its tag or attributes; its role for finding the main part. inside: an article."""
    if not raw or raw.isspace():
        return tag in _CHROME_TAGS, ""
    attrs = {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(raw)}
    role = attrs.get("role", "").lower()
    if tag in _CHROME_TAGS or role in _CHROME_ROLES:
        return True, role
    if not inside and ("hidden" in attrs or attrs.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", attrs.get("style", ""))):
        return True, role
    names = attrs.get("class", "").lower().split()
    if tag in _PROSE:
        return any(name in _CHROME_NAMES for name in names), role
    names += attrs.get("id", "").lower().split()
    if tag in ("html", "body", "article", "main"):
        # such an element is named after what it is: only an article that is a comment or an advert goes
        return tag == "article" and any(re.match(r"(comment|comments|reply|ad|advert|sponsored|promo)\b", name) and _furniture(name) for name in names), role
    return any(map(_furniture, names)), role


def parse(page: str) -> Node:
    """A DOM tree that is good enough for text: implied ends, void and raw elements, cut-off markup."""
    root = Node("#root")
    stack, at, n, ends, open_ = [root], 0, len(page), {}, defaultdict(int)

    def cut(i):
        for x in stack[i:]:
            open_[x.tag] -= 1
        del stack[i:]

    while at < n:
        m = _TOKEN.search(page, at)
        text = page[at : m.start() if m else n]
        if text:
            stack[-1].children.append(Node("#text", text=html.unescape(text)))
        if not m:
            break
        at = m.end()
        close, tag, raw, end = m[1] or m[5], (m[2] or m[6] or "").lower(), m[3] or m[7] or "", m[4] if m[2] else m[8]
        if not tag or not end:
            continue
        if close:
            for i in range(len(stack) - 1, 0, -1) if open_[tag] else ():
                if stack[i].tag == tag:
                    cut(i)
                    break
                if tag in _INLINE and stack[i].tag in _SCOPE:
                    break
            continue
        while len(stack) > 1 and any(open_[x] for x in _CLOSED_BY.get(tag, ())):
            for i in range(len(stack) - 1, 0, -1):
                if tag in _CLOSES.get(stack[i].tag, ()):
                    cut(i)
                    break
                if stack[i].tag in _SCOPE:
                    i = 0
                    break
            else:
                i = 0
            if i == 0:
                break
        chrome, role = _is_chrome(tag, raw, open_["article"] > 0)
        if tag == "header" and open_["article"]:
            chrome = False  # an article's own header has its title
        named = _CLASS.search(raw) if tag in _CONTAINERS else None
        node = Node(tag, role, chrome, classes=re.sub(r"\d+", "", named[1]).strip() if named else "")
        stack[-1].children.append(node)
        if tag in _VOID or raw.endswith("/") and (tag in ("svg", "math") or open_["svg"] or open_["math"]):
            continue
        if tag in ("noscript", "template"):
            # without an end it would hide all that follows
            if tag not in ends:
                ends[tag] = max((m.start() for m in re.finditer(rf"</{tag}(?=[\s/>])", page, re.I)), default=-1)
            if ends[tag] < at:
                continue
        if tag in _RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at = end.end() if end else n
            continue
        stack.append(node)
        open_[tag] += 1
    return root


def _main(root: Node) -> list[Node]:
    """The page's outermost articles, else its main part, else all of it."""
    for is_main in (lambda x: x.tag == "article" or x.names == "article", lambda x: x.tag == "main" or x.names == "main"):
        found, todo = [], [root]
        while todo:
            x = todo.pop()
            if x.chrome:
                continue
            if is_main(x):
                found.append(x)
            else:
                todo.extend(reversed(x.children))
        if found:
            return found
    return [root]


def _plain(x: Node) -> str:
    """All text below a node, white space collapsed."""
    out, todo = [], [x]
    while todo:
        y = todo.pop()
        if y.text is not None:
            out.append(y.text)
        else:
            if y.tag not in _INLINE:
                out.append(" ")
            todo.extend(reversed(y.children))
    return " ".join("".join(out).split())


def _signed(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


@lru_cache(4096)
def _label(name: str) -> int:
    return _signed(name) >> 32


_RUN = _label("#run")


def skeleton(root: Node) -> tuple[Tree, list[list[Node]]]:
    """The tree of block elements and runs of text of a whole page, furniture included, and the text nodes
    of each of its nodes. An element that holds one run and nothing else is a node with that text."""
    parent, label, text, link, nodes = [0], [_label("#root")], [0], [False], [[]]
    at, count, run = [0], [0], []

    def add(name, words, links, held):
        parent.append(at[-1])
        label.append(_label(name))
        text.append(words)
        link.append(links)
        nodes.append(held)
        count[-1] += 1

    def flush():
        words = " ".join("".join(x.text for x, _ in run).split())
        if words:
            add("#run", _signed(words) or 1, all(a for x, a in run if not x.text.isspace()), [x for x, _ in run])
        run.clear()

    todo = [(x, False, False) for x in reversed(root.children)]
    while todo:
        x, linked, leaves = todo.pop()
        if leaves:
            flush()
            own, k = at.pop(), count.pop()
            if not k or k == 1 and label[-1] == _RUN:
                if k:
                    text[own], link[own], nodes[own] = text[-1], link[-1], nodes[-1]
                else:
                    count[-1] -= 1
                for column in (parent, label, text, link, nodes):
                    column.pop()
        elif x.text is not None:
            run.append((x, linked))
        else:
            if x.tag not in _INLINE:
                flush()
                add(f"{x.tag}.{x.classes}", 0, False, [])
                at.append(len(parent) - 1)
                count.append(0)
                todo.append((x, False, True))
            todo.extend((c, linked or x.tag == "a", False) for c in reversed(x.children))
    flush()
    return Tree(parent, label, text, link), nodes


def layout_of(root: Node) -> int:
    """A hash of the containers of a page that are no furniture, as a set of paths of tags with classes."""
    paths, todo = set(), [(root, 0)]
    while todo:
        x, path = todo.pop()
        if x.chrome or x.text is not None:
            continue
        if x.tag in _CONTAINERS:
            path = _label(f"{path}/{x.tag}.{x.classes}")
            paths.add(path)
        todo.extend((c, path) for c in x.children)
    return _signed(str(sorted(paths))) or 1


def sketch_of(content: str, size: int = 64) -> list[int]:
    """The least hashes of the words of a text; all of them if there are few."""
    return sorted(map(_signed, set(content.split())))[:size]


def alike(a: frozenset[int], b: frozenset[int], size: int = 64) -> bool:
    """Whether two sketches are those of near copies: four fifths of their words are shared, as far as the sketches show."""
    least = sorted(a | b)[:size]
    return 5 * sum(x in a and x in b for x in least) >= 4 * len(least)


def _link_lists(parts: list[Node], prose: int = 5) -> set[int]:
    """The ids of the elements ahead of the first prose (a text of so many words that is no link) that hold three links
    or more and no other text: menus. A list of links further down is content unless the host's pages say otherwise."""
    out, todo, sums, begun = set(), [(x, False, False) for x in reversed(parts)], {}, False
    while todo:
        x, ready, linked = todo.pop()
        if x.text is not None:
            words = x.text.strip(" \t\r\n|>/»·•-")
            sums[id(x)] = 0, 0 if linked else len(words)
            begun = begun or not linked and len(words.split()) >= prose
        elif not ready:
            if not x.chrome:
                todo.append((x, True, linked))
                todo.extend((c, False, linked or x.tag == "a") for c in reversed(x.children))
        else:
            links, loose = tuple(map(sum, zip((0, 0), *(sums.pop(id(c), (0, 0)) for c in x.children))))
            sums[id(x)] = links + (x.tag == "a"), loose
            if links >= 3 and not loose and not begun:
                out.add(id(x))
    return out


def template_of(root: Node, wrappers: list[tuple[Tree, set[int]]], marked: bool) -> set[int]:
    """The ids of the text nodes of a page that align with constant nodes of a wrapper: those of
    the same text, and on a page that marks no article those in links where the host has links."""
    wrappers = [x for x in wrappers if not marked or any(k % 2 == 0 for k in x[1])]
    if not wrappers:
        return set()
    tree, nodes = skeleton(root)
    out = set()
    for pivot, constant in wrappers:
        for u, v in match(pivot, tree)[1]:
            if 2 * u in constant and tree.text[v] and tree.text[v] == pivot.text[u] or 2 * u + 1 in constant and tree.link[v] and not marked:
                out.update(map(id, nodes[v]))
    return out


def extract(root: Node, wrappers: list[tuple[Tree, set[int]]] = ()) -> str:
    """The text of a parsed page's main part without furniture and without what the wrappers find to be template."""
    parts = _main(root)
    marked = parts != [root]
    template = template_of(root, wrappers, marked)
    lists = set() if marked else _link_lists(parts)
    out, todo = [], list(reversed(parts))
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
        elif x.text is not None:
            if id(x) not in template:
                out.append(x.text)
        elif not x.chrome and not (x.tag in ("ul", "ol", "div", "table") and id(x) in lists):
            if x.tag not in _INLINE:
                out.append(" ")
                todo.append(" ")
            todo.extend(reversed(x.children))
    return " ".join("".join(out).split())


def host():
    """The host of url in lower case; empty if there is none."""
    return F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def _summary(batches):
    for batch in batches:
        out = []
        for name, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            root = parse(page)
            content = extract(root)
            if content:
                out.append((name, _signed(content), layout_of(root), skeleton(root)[0].packed(), sketch_of(content)))
        columns = list(zip(*out)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64())))], ["host", "content", "layout", "tree", "sketch"])


def _unlike(net: list, sketch: frozenset[int], least: int) -> None:
    """Adds a page to the pages of which no two are near copies, up to least."""
    if len(net) < least and not any(alike(sketch, x) for x in net):
        net.append(sketch)


def _keys(batches):
    for batch in batches:
        keys = [sorted(set(Tree.unpacked(x).keys())) for x in batch.column(3).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(keys, pa.list_(pa.int64()))], ["host", "layout", "content", "keys"])


def _aligned(batches):
    """For each page the constant nodes that it speaks for: of pivot node u, 2u if the text is the same and 2u + 1 if both are links."""
    for batch in batches:
        keys, pivots = [], {}
        for *at, raw, mine in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 4, 5))):
            if tuple(at) not in pivots:
                pivots[tuple(at)] = Tree.unpacked(raw)
            pivot, tree, own = pivots[tuple(at)], Tree.unpacked(mine), []
            for u, v in match(pivot, tree)[1]:
                if tree.text[v] and tree.text[v] == pivot.text[u]:
                    own.append(2 * u)
                if tree.link[v] and pivot.link[u]:
                    own.append(2 * u + 1)
            keys.append(own)
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(keys, pa.list_(pa.int32())), batch.column(3)], ["host", "layout", "round", "keys", "sketch"])


def wrappers(pages: DataFrame, least: int = 3) -> DataFrame:
    """(host, layout, tree, keys): pivot trees of all pages of a host (layout 0) or of one layout, and their constant nodes.

    Texts in one place of the tree are counted over all pages. The pivots are pages that have them: the one with the
    most texts of more than half of the pages, then while there are others the one with the most of those. Every page
    is aligned with its pivots. A node is constant if more than half of the pages have it aligned with the same text
    (or with a link, where it is one), among them at least `least` of which no two are near copies."""
    summary = pages.where("host <> '' AND html IS NOT NULL").select("host", "html").mapInArrow(_summary, "host string, content long, layout long, tree binary, sketch array<long>")
    every = written(summary, "pages")
    levels = every.select("host", F.explode(F.array(F.lit(0).cast("long"), "layout")).alias("layout"), "content", "tree", "sketch")
    sizes = levels.groupBy("host", "layout").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    # a host of one layout has no level above it
    alone = sizes.where("layout <> 0").select(F.col("host").alias("h"), F.col("n").alias("m"))
    sizes = written(sizes.join(alone, (F.col("layout") == 0) & (F.col("host") == F.col("h")) & (F.col("n") == F.col("m")), "left_anti"), "sizes")
    few = sizes.count() <= 200_000
    side = lambda x: F.broadcast(x) if few else x
    keyed = levels.mapInArrow(_keys, "host string, layout long, content long, keys array<long>")
    often = keyed.select("host", "layout", F.explode("keys").alias("key")).groupBy("host", "layout", "key").agg(F.count("*").alias("c")).where(F.col("c") >= least).join(side(sizes), ["host", "layout"]).where("2 * c > n")
    open_ = written(sizes.join(often.groupBy("host", "layout").agg(F.collect_list("key").alias("missing")), ["host", "layout"], "left").select("host", "layout", F.coalesce("missing", F.expr("cast(array() as array<bigint>)")).alias("missing")), "missing")
    rounds = []
    while not open_.isEmpty():
        # the page with the most of what no pivot has; of pages alike the one of least content hash
        has = keyed.join(side(open_), ["host", "layout"]).withColumn("own", F.array_intersect("missing", "keys"))
        best = has.groupBy("host", "layout").agg(F.min_by(F.struct("content", "own"), F.struct(-F.size("own"), "content")).alias("p"))
        best = written(best.select("host", "layout", F.col("p.content").alias("content"), F.col("p.own").alias("own")), "best")
        rounds.append(best)
        after = written(open_.join(best, ["host", "layout"]).select("host", "layout", F.array_except("missing", "own").alias("missing")).where(F.size("missing") > 0), "missing")
        drop(open_)
        open_ = after
    chosen = reduce(DataFrame.unionByName, [r.withColumn("round", F.lit(i)) for i, r in enumerate(rounds)]) if rounds else None
    if chosen is None:
        return written(pages.sparkSession.createDataFrame([], "host string, layout long, tree binary, keys array<int>"), "wrappers")
    pivots = levels.join(side(chosen), ["host", "layout", "content"]).groupBy("host", "layout", "round").agg(F.min("tree").alias("pivot"))
    pivots = written(pivots, "pivots")
    weight = pivots.agg(F.coalesce(F.sum(F.length("pivot") + 100), F.lit(0))).first()[0]
    both = levels.join(F.broadcast(pivots) if weight <= 8 << 20 else pivots, ["host", "layout"]).select("host", "layout", "round", "sketch", "pivot", "tree")
    aligned = written(both.mapInArrow(_aligned, "host string, layout long, round int, keys array<int>, sketch array<long>"), "aligned")
    counts = aligned.select("host", "layout", "round", F.explode("keys").alias("key")).groupBy("host", "layout", "round", "key").agg(F.count("*").alias("c")).where(F.col("c") >= least)
    common = written(counts.join(side(sizes), ["host", "layout"]).where("2 * c > n").groupBy("host", "layout", "round").agg(F.collect_list("key").alias("common")), "common")
    size = common.agg(F.coalesce(F.sum(F.size("common") * 4 + 100), F.lit(0))).first()[0]

    def first(batches):
        nets: dict[tuple, list] = {}
        for batch in batches:
            for *at, keys, sketch in zip(*(batch.column(i).to_pylist() for i in range(5))):
                sketch = frozenset(sketch)
                for key in keys:
                    _unlike(nets.setdefault((*at, key), []), sketch, least)
        rows = [(*k, sorted(x)) for k, net in nets.items() for x in net]
        for i in range(0, len(rows), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[i : i + 10_000]), (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64())))], ["host", "layout", "round", "key", "sketch"])

    def merged(batches):
        at, net = None, []
        for batch in batches:
            found = []
            for *own, sketch in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if at != own:
                    at, net = own, []
                was = len(net)
                _unlike(net, frozenset(sketch), least)
                if was < least == len(net):
                    found.append(at)
            columns = list(zip(*found)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.int32(), pa.int32()))], ["host", "layout", "round", "key"])

    shared = aligned.join(F.broadcast(common) if size <= 8 << 20 else common, ["host", "layout", "round"]).select("host", "layout", "round", F.array_intersect("keys", "common").alias("keys"), "sketch").where(F.size("keys") > 0)
    nets = shared.mapInArrow(first, "host string, layout long, round int, key int, sketch array<long>")
    kept = nets.repartition("host", "layout", "round", "key").sortWithinPartitions("host", "layout", "round", "key", "sketch").mapInArrow(merged, "host string, layout long, round int, key int")
    constant = kept.groupBy("host", "layout", "round").agg(F.array_sort(F.collect_list("key")).alias("keys"))
    out = written(constant.join(pivots, ["host", "layout", "round"]).select("host", "layout", F.col("pivot").alias("tree"), "keys"), "wrappers")
    drop(every, sizes, open_, *rounds, pivots, aligned, common)
    return out


def main_text(pages: DataFrame, least: int = 3) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages (page_id, url, html)."""
    small_batches(pages.sparkSession)
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", host().alias("host"))
    found = wrappers(pages, least)
    size = found.agg(F.coalesce(F.sum(F.length("tree") + F.size("keys") * 4 + 100), F.lit(0))).first()[0]
    small = size <= 8 << 20
    if small:
        known = defaultdict(list)
        for r in found.collect():
            known[r.host, r.layout].append((bytes(r.tree), frozenset(r.keys)))
        shared = pages.sparkSession.sparkContext.broadcast(dict(known))
        rows = pages.withColumn("w", F.lit(None).cast("array<struct<layout:bigint,tree:binary,keys:array<int>>>"))
    else:
        shared = None
        rows = pages.join(found.groupBy("host").agg(F.collect_list(F.struct("layout", "tree", "keys")).alias("w")), "host", "left")

    def text_of(page, name, w, trees):
        if not page:
            return ""
        root = parse(page)
        layout = layout_of(root) if small and shared.value or w else 0
        if small:
            own = [x for at in (0, layout) for x in shared.value.get((name, at), ())]
        else:
            own = [(x["tree"], frozenset(x["keys"])) for x in w or () if x["layout"] in (0, layout)]
        if len(trees) > 2000:
            trees.clear()
        for raw, _ in own:
            if raw not in trees:
                trees[raw] = Tree.unpacked(raw)
        return extract(root, [(trees[raw], constant) for raw, constant in own])

    def run(batches):
        trees: dict[bytes, Tree] = {}
        for batch in batches:
            texts = [text_of(*row, trees) for row in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])
        trim()

    return rows.select("page_id", "url", "html", "host", "w").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))
