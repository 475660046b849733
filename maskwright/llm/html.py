"""Main text of web pages, with wrappers inferred per host as union-free regular expressions.

A page is a tree of tags and texts.  Its token stream is first folded on
itself: neighbours of one kind, and squares of up to four kinds, become
repeated groups.  Streams of one host are then aligned pairwise: equal tokens
match, different texts at one place become a slot, different counts a repeated
group, and what only one side has becomes optional.  The result has no unions
and is again a stream, so a host's pages are aligned over a tree, ``BRANCH`` at a
time, however many there are.  A page's place in the tree hangs on its stream's
hash alone: results don't hang on how the table is dealt out.

What a wrapper holds as literal text where its pages have slots elsewhere in
the article is the site's own ("Share this"), and goes.  Menus, headers,
footers, sidebars, notices, adverts, forms, scripts, styles and reader comments
go by element, role, class or id.  The article is the ``article`` element, else
``main``, else the body.

Defined cases: null html is an empty page; broken markup is closed as browsers
do for the common cases; a null or strange url is a host of its own; hosts with
fewer than ``LEAST`` different pages (copies count once) or without a slot keep
their literals; so do blocks more than ``DEEP`` levels down; very long pages are
read whole, in memory that grows with the page; each row of a repeated or null id
is extracted by its own html; an empty table gives an empty result; extra columns
aren't read, whatever their names.
"""

from __future__ import annotations

import hashlib
import html
import json
import math
import re
import uuid
from collections.abc import Iterator
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.llm.common import ensure_checkpoint_dir, slices
from maskwright.session import remove

#: Pages that a wrapper must come from before its literals count, and the longest literal that is held as text (longer ones by their hash).
LEAST, LITERAL = 8, 120
#: Items of one level from which on runs of optionals are merged, so that wrappers stay small; what every page has stays.
LEVEL = 60
#: Wrappers that meet at a time (a power of two), and levels of a page that wrappers look at.
BRANCH, DEEP = 64, 150

# Element and class names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg xmp noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
NAMED = HEADINGS | {"article", "main", "section", "p", "li", "tr", "figure"}
NOISE = frozenset("head script style noscript template iframe svg nav aside footer form button select textarea input label fieldset dialog menu object embed canvas audio video map".split())
NOISE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adslot adsense banner banners sponsor sponsored sponsors promo promos promotion cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login sidebar sidebars sidenav rail menu menus nav navbar navigation breadcrumb breadcrumbs topbar header footer masthead copyright comment comments commentlist disqus reply replies respond share sharing social related recommended recommendations widget widgets toolbar pagination pager skip search contentinfo complementary announcement disclaimer tracking hidden".split()
)
OWN_WORDS = frozenset("article post entry story content".split())
CLOSES = {**{t: frozenset(["p"]) for t in BLOCK - {"body", "html"}}, "li": frozenset(["li", "p"]), "dt": frozenset(["dt", "dd", "p"]), "dd": frozenset(["dt", "dd", "p"]), "tr": frozenset(["tr", "td", "th", "p"]), "td": frozenset(["td", "th", "p"]), "th": frozenset(["td", "th", "p"]), "option": frozenset(["option"])}
SCOPES = {"li": frozenset("ul ol menu dir".split()), "dt": frozenset(["dl"]), "dd": frozenset(["dl"]), "tr": frozenset(["table"]), "td": frozenset("tr table".split()), "th": frozenset("tr table".split()), "option": frozenset(["select"])}

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)\]\]>|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'=<>/]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_WORDS = re.compile("[a-z0-9]+")


class Node:
    """An element; ``children`` are nodes and strings (decoded text)."""

    __slots__ = ("tag", "words", "children", "kind", "noise", "main")

    def __init__(self, tag: str, words: frozenset[str] = frozenset(), hidden: bool = False, named: frozenset[str] = frozenset()):
        self.tag, self.words, self.children = tag, words, []
        self.kind = tag + "".join(f".{w}" for w in sorted(named)[:3])
        self.noise = hidden or tag in NOISE
        self.main = False


def _attributes(text: str, tag: str) -> tuple[frozenset[str], bool, frozenset[str]]:
    """Words of class, id and role, whether the element is hidden, and the words that tell its kind.

    Those are the same on each page of a site: no numbers but short ones of a
    class ("col-6"), and an id's words only where there are no others and the
    element isn't one that ids tend to name by its content.
    """
    if not text or text.isspace():
        return frozenset(), False, frozenset()
    words: set[str] = set()
    named: set[str] = set()
    own: set[str] = set()
    hidden = False
    for name, value in _ATTRIBUTE.findall(text):
        name = name.lower()
        if name in ("class", "id", "role"):
            found = _WORDS.findall(html.unescape(value).lower())
            words.update(found)
            if name == "id":
                own.update(w for w in found if w.isalpha())
            else:
                named.update(w for w in found if sum(map(str.isdigit, w)) < 3)
        elif name == "hidden" or (name == "aria-hidden" and "true" in value.lower()) or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value.lower())):
            hidden = True
    return frozenset(words), hidden, frozenset() if tag == "body" else frozenset(named or (own if tag not in NAMED else ()))


def parse(page: str) -> Node:
    """The page's tree."""
    root = Node("html")
    stack, at, size = [root], 0, len(page)
    while at < size:
        found = _TOKEN.search(page, at)
        if found is None:
            stack[-1].children.append(html.unescape(page[at:]))
            break
        if found.start() > at:
            stack[-1].children.append(html.unescape(page[at : found.start()]))
        at = found.end()
        tag = found[3]
        if tag is None:
            if found[1] is not None:
                stack[-1].children.append(found[1])
            continue
        tag = tag.lower()
        if found[2]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
            continue
        if tag in ("html", "body") and len(stack) > 1 and any(x.tag == tag for x in stack):
            continue
        if tag == "html":
            continue
        closed = CLOSES.get(tag)
        if closed:
            limit = SCOPES.get(tag, frozenset(["td", "th", "table", "button"]))
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in closed:
                    del stack[i:]
                    if stack[-1].tag not in closed:
                        break
                elif stack[i].tag in limit or stack[i].tag in BLOCK and stack[i].tag not in closed:
                    break
        node = Node(tag, *_attributes(found[4], tag))
        stack[-1].children.append(node)
        if tag in RAW:
            end = re.compile(f"</{re.escape(tag)}[\\s/>]", re.I).search(page, at)
            if tag in ("textarea", "title"):
                node.children.append(html.unescape(page[at : end.start() if end else size]))
            at = (page.find(">", end.start()) + 1 or size) if end else size
        elif tag not in VOID and not found[4].rstrip().endswith("/"):
            stack.append(node)
    _mark(root)
    return root


def _mark(root: Node) -> None:
    """Which elements are noise by their names; not what holds the article, whatever its name."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack.extend(c for c in node.children if isinstance(c, Node))
    for node in reversed(order):
        named = NOISE_WORDS & node.words
        if named == {"header"} and not OWN_WORDS.isdisjoint(node.words):
            named = frozenset()  # the article's own head
        node.main = node.tag in ("article", "main") and not named or "main" in node.words and not named or any(c.main for c in node.children if isinstance(c, Node) and not c.noise)
        if named and not node.main and node.tag not in ("html", "body", "p", *HEADINGS):
            node.noise = True
        elif named and node.tag == "p":
            node.noise = True


# ---------------------------------------------------------------- wrappers
# An item is [kind, how often ("", "?", "+", "*"), text or children]: a text has kind "#" and a literal or None (a slot).

_OFTEN = {"": (1, 1), "?": (0, 1), "+": (1, 2), "*": (0, 2)}
_SIGN = {v: k for k, v in _OFTEN.items()}


def _join_often(a: str, b: str) -> str:
    return _SIGN[min(_OFTEN[a][0], _OFTEN[b][0]), max(_OFTEN[a][1], _OFTEN[b][1])]


def _optional(item: list) -> list:
    return [item[0], _SIGN[0, _OFTEN[item[1]][1]], item[2]]


def merge_items(a: list, b: list, often: str | None = None) -> list:
    """One item that both of one kind match."""
    often = _join_often(a[1], b[1]) if often is None else often
    if a[0] == "#":
        return ["#", often, a[2] if a[2] == b[2] else None]
    return [a[0], often, align(a[2], b[2])]


def fold(items: list) -> list:
    """Repeated groups within one stream: squares of one to four kinds."""
    items = list(items)
    for size in (1, 2, 3, 4):
        out: list = []
        at = 0
        while at < len(items):
            kinds = [x[0] for x in items[at : at + size]]
            count = 1
            while len(kinds) == size and [x[0] for x in items[at + count * size : at + (count + 1) * size]] == kinds:
                count += 1
            if count == 1 or (size > 1 and len(set(kinds)) == 1):
                out.append(items[at])
                at += 1
                continue
            group = items[at : at + size]
            for k in range(1, count):
                group = [merge_items(x, y) for x, y in zip(group, items[at + k * size : at + (k + 1) * size], strict=True)]
            if size == 1:
                out.append([group[0][0], _SIGN[_OFTEN[group[0][1]][0], 2], group[0][2]])
            else:
                out.append(["(" + " ".join(kinds) + ")", "+", group])
            at += count * size
        items = out
    return items if len(items) <= LEVEL else _gaps(items)


def _gaps(items: list) -> list:
    """The stream with each run of optionals as one group, which holds a slot if they do; what every page has stays as it is."""
    out: list = []
    run: list = []
    for item in [*items, None]:
        if item is not None and _OFTEN[item[1]][0] == 0:
            run.append(item)
            continue
        if run:
            out.append(["(...)", "*", [["#", "*", None]] if literals(run)[1] else []])
            run = []
        if item is not None:
            out.append(item)
    return out


def _literal(text: str) -> str:
    """How wrappers hold a text."""
    return text if len(text) <= LITERAL else f"\0{hashlib.blake2b(text.encode('utf-8', 'surrogatepass'), digest_size=16).hexdigest()}"


def align(a: list, b: list) -> list:
    """The stream that both streams match."""
    if [x[0] for x in a] == [x[0] for x in b]:
        return [merge_items(x, y) for x, y in zip(a, b, strict=True)]
    out: list = []
    for what, i, j, k, m in SequenceMatcher(None, [x[0] for x in a], [x[0] for x in b], autojunk=False).get_opcodes():
        if what == "equal":
            out += [merge_items(x, y) for x, y in zip(a[i:j], b[k:m], strict=True)]
        else:
            out += [_optional(x) for x in a[i:j]] + [_optional(x) for x in b[k:m]]
    return fold(out)


def stream(node: Node, depth: int = 0) -> list:
    """The folded stream of what an element holds; noise and inline markup leave no items."""
    items: list = []
    for child in node.children:
        if isinstance(child, str):
            text = " ".join(child.split())
            if text and not (items and items[-1][0] == "#"):
                items.append(["#", "", _literal(text)])
            elif text:
                items[-1] = ["#", "", None]
        elif not child.noise and child.tag in BLOCK:
            items.append([child.kind, "", stream(child, depth + 1) if depth < DEEP else []])
        elif not child.noise and child.tag not in VOID:
            inner = stream(child, depth + 1) if depth < DEEP else []
            if inner and not (items and items[-1][0] == "#"):
                items.append(["#", "", inner[0][2] if len(inner) == 1 and inner[0][0] == "#" else None])
            elif inner:
                items[-1] = ["#", "", None]
    return fold(items)


def literals(wrapper: list, path: str = "") -> tuple[list[list[str]], bool]:
    """([path, text] of the literals that every page has, whether there is a slot)."""
    found, slot = [], False
    for kind, often, inner in wrapper:
        if kind == "#":
            if inner is None:
                slot = True
            elif often == "":
                found.append([path, inner])
        elif kind.startswith("("):
            slot |= literals(inner, path)[1]
        else:
            more, inside = literals(inner, f"{path}/{kind}")
            slot |= inside
            if often == "" and kind.split(".")[0] not in HEADINGS:
                found += more
    return found, slot


def _identity(root: Node) -> int:
    """A 64-bit hash of a page's texts outside headings and noise: copies of a page have one identity."""
    digest, stack = hashlib.blake2b(digest_size=8), [root]
    while stack:
        node = stack.pop()
        if isinstance(node, str):
            digest.update(" ".join(node.split()).encode("utf-8", "surrogatepass") + b"\0" if node.strip() else b"")
        elif not node.noise and node.tag not in HEADINGS:
            stack.extend(reversed(node.children))
    return int.from_bytes(digest.digest(), "big", signed=True)


def page_streams(pages: DataFrame) -> DataFrame:
    """(host, mark, identity, wrapper) of (host, html): each page's stream, copies within a batch once; ``mark`` is the stream's hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            found: dict[tuple[str, int], tuple[int, str]] = {}
            for host, page in set(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                root = parse(page or "")
                one = json.dumps(stream(root), ensure_ascii=True, separators=(",", ":"))
                mark = int.from_bytes(hashlib.blake2b(one.encode(), digest_size=8).digest(), "big", signed=True)
                identity = _identity(root)
                found[host, mark] = min((identity, one), found.get((host, mark), (identity, one)))
            yield pa.RecordBatch.from_arrays(
                [pa.array([h for h, _ in found], pa.string()), pa.array([m for _, m in found], pa.int64()), pa.array([i for i, _ in found.values()], pa.int64()), pa.array([w for _, w in found.values()], pa.string())],
                names=["host", "mark", "identity", "wrapper"],
            )

    return pages.select("host", "html").mapInArrow(run, "host string, mark long, identity long, wrapper string")


def _aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One wrapper of each (host, bucket), from rows sorted by host, bucket and mark."""
    key, last, wrapper, row = None, None, None, None

    def settled() -> pa.RecordBatch:
        host, mark, level = row
        text = wrapper if isinstance(wrapper, str) else json.dumps(wrapper, ensure_ascii=True, separators=(",", ":"))
        return pa.RecordBatch.from_arrays([pa.array([host], pa.string()), pa.array([mark], pa.int64()), pa.array([level], pa.int32()), pa.array([text], pa.string())], names=["host", "mark", "level", "wrapper"])

    for batch in batches:
        for host, bucket, mark, level, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if (host, bucket) != key:
                if key is not None:
                    yield settled()
                key, last, wrapper, row = (host, bucket), text, text, (host, mark, level)  # a lone page stays as it is
            elif text != last:
                wrapper, last = align(json.loads(wrapper) if isinstance(wrapper, str) else wrapper, json.loads(text)), text
    if key is not None:
        yield settled()


def fit_wrappers(pages: DataFrame, path: str) -> DataFrame:
    """(host, literals: JSON) of (host, html): hosts whose wrapper has literals that count; the pages' streams are kept under ``path``."""
    spark = pages.sparkSession
    page_streams(pages).write.parquet(path)  # each page is parsed once
    streams = spark.read.schema("host string, mark long, identity long, wrapper string").parquet(path)
    # different pages over the whole table: copies count once, wherever they lie
    each = streams.groupBy("host", "mark").agg(F.min("identity").alias("identity"))
    sites = each.groupBy("host").agg(F.count("*").alias("n"), F.count_distinct("identity").alias("pages")).where(F.col("pages") >= LEAST)
    # levels of the tree that a host's pages need, so that about BRANCH of them meet at a time; which ones hangs on their contents alone
    sites = sites.select(F.col("host").alias("site"), F.greatest(F.lit(0), F.ceil(F.log(F.col("n") / BRANCH) / math.log(BRANCH))).cast("int").alias("level")).checkpoint()
    rows = streams.join(sites, F.col("host") == F.col("site")).select("host", "mark", "level", "wrapper")
    merged = None
    for level in range(sites.agg(F.max("level")).first()[0] or 0, -1, -1):
        here = rows.where(F.col("level") == level)
        here = here if merged is None else here.union(merged)
        bits = level * int(math.log2(BRANCH))
        bucket = F.shiftrightunsigned("mark", 64 - bits) if bits else F.lit(0).cast("long")
        dealt = here.select("host", bucket.alias("bucket"), "mark", "level", "wrapper").repartition("host", "bucket").sortWithinPartitions("host", "bucket", "mark")
        merged = dealt.mapInArrow(_aligned, "host string, mark long, level int, wrapper string")

    def constants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for host, wrapper in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                texts, slot = literals(json.loads(wrapper))
                if texts and slot:
                    rows.append((host, json.dumps(texts, ensure_ascii=False)))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string())], names=["host", "literals"])

    return merged.select("host", "wrapper").mapInArrow(constants, "host string, literals string")


# ---------------------------------------------------------------- extraction


def _blocks(node: Node, path: str, out: list, inside_article: bool) -> None:
    """Appends [path, text] of the blocks below an element, in order; an open block is out[-1] with None in third place."""
    stack = [(node, iter(node.children), path, inside_article)]
    while stack:
        node, children, path, inside = stack[-1]
        child = next(children, None)
        if child is None:
            stack.pop()
            if node.tag in BLOCK:
                out.append(None)  # a break
            continue
        if isinstance(child, str):
            if out and out[-1] is not None:
                out[-1][1].append(child)
            else:
                out.append([path, [child]])
        elif child.tag == "br":
            if out and out[-1] is not None:
                out[-1][1].append(" ")
        elif child.noise:
            continue
        elif child.tag == "header":
            if inside:  # an article's own head: its headings only
                out.append(None)
                for heading in _headings(child):
                    _blocks(heading, f"{path}/{child.kind}/{heading.kind}", out, inside)
                out.append(None)
        elif child.tag not in VOID:
            if child.tag in BLOCK:
                out.append(None)
            stack.append((child, iter(child.children), f"{path}/{child.kind}" if child.tag in BLOCK else path, inside))
        elif child.tag == "hr":
            out.append(None)


def _headings(node: Node) -> list[Node]:
    found, stack = [], [node]
    while stack:
        x = stack.pop()
        if x.tag in HEADINGS:
            found.append(x)
        else:
            stack.extend(c for c in reversed(x.children) if isinstance(c, Node) and not c.noise)
    return found


def _regions(root: Node, test) -> list[tuple[Node, str]]:
    """The outermost elements that pass, with their paths."""
    found, stack = [], [(root, "")]
    while stack:
        node, path = stack.pop()
        if test(node):
            found.append((node, path))
            continue
        stack.extend((c, f"{path}/{c.kind}" if c.tag in BLOCK else path) for c in reversed(node.children) if isinstance(c, Node) and not c.noise)
    return found


def extract(page: str, site: set[tuple[str, str]] | None = None) -> str:
    """The main text: blocks joined by line feeds; ``site`` are a wrapper's (path, text) literals."""
    root = parse(page)
    regions = _regions(root, lambda n: n.tag == "article") or _regions(root, lambda n: n.tag == "main" or "main" in n.words) or [(root, "")]
    texts = []
    for node, path in regions:
        raw: list = []
        _blocks(node, path, raw, node is not root)
        lines = [(p, " ".join("".join(parts).split())) for p, parts in (x for x in raw if x is not None)]
        texts.append([t for p, t in lines if t and not (site and (p, _literal(t)) in site)])
    return "\n".join(line for t in texts for line in t)


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1))


def extract_pages(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    spark = pages.sparkSession
    ensure_checkpoint_dir(spark)
    kind = pages.schema[id_column].dataType.simpleString()
    given = pages.select(pages[id_column].alias("page_id"), pages[url_column].alias("url"), F.coalesce(pages[html_column], F.lit("")).alias("html"), host_of(pages[url_column]).alias("host"))
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/wrappers-{uuid.uuid4().hex}"
    streams = f"{path}-streams"
    fit_wrappers(given, streams).write.parquet(path)
    remove(spark, streams)
    sites = spark.read.schema("host string, literals string").parquet(path).withColumnRenamed("host", "_host")  # all names here are this module's
    # few hosts have literals; Spark broadcasts them only below its size limit
    joined = given.join(sites, F.col("host") == F.col("_host"), "left").select("page_id", "url", "html", "literals")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, set] = {}
        for batch in slices(batches, "html"):
            out = []
            for page, text in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if text is not None and text not in known:
                    if len(known) > 1000:
                        known.clear()
                    known[text] = set(map(tuple, json.loads(text)))
                out.append(extract(page, known[text] if text is not None else None))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array(map(len, out), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return joined.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
