"""HTML extraction by wrappers: union-free regular expressions inferred for each host.

Pages are read as token streams of block tags and text (inline tags melt into the text, scripts and comments vanish,
implied end tags are added), nested by element. A host's wrapper begins as the stream of one page and is aligned
with the next page again and again, until all pages of the host are in it. Mismatches are resolved without unions: neighbours with one label become a repeated
group, tokens that only one side has become optional, and texts that differ become slots. The wrapper so tells a host's template from its data, and its text slots show which element
holds the main text: `article` or `main` where the wrapper has one, else the whole page.

Each page is then matched against its host's wrapper, and the slots in the main element, less template text and the
elements of menus, headers, footers, sidebars, notices, adverts, forms and comments, give the blocks of the text. A page
whose stream lacks the wrapper's main element is its own sample of one.

Template text: a text outside article and main, in no repeated group, that is the same on all pages of the host that have
its place in the wrapper, and on pages of `LEAST` different main texts or more. The wrapper proposes places; texts are
counted over all pages of the host, so a text that differs on one page, or on copies of one page alone, is never dropped.

Inference, counting and extraction read every page. For inference a host's pages are dealt by a hash of url and id to `DEAL` partial wrappers, which are
merged as their rows stream by, and then to one; only shapes of pages, without their texts, are shuffled, and a task holds one wrapper. Wrappers are broadcast up to `broadcast_bytes`, beyond that joined by host.

Cases: null and empty html give an empty text; broken and cut-off markup is closed at the end; a null url is a host of
its own; elements nested deeper than DEPTH are read at that depth (those that are no main text stay out); repeated rows are extracted each; extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import html
import itertools
import json
import re
import zlib
from collections.abc import Callable, Iterator
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.batches import map_texts
from quarry.llm.shared import bound_batches, stage

DEPTH = 120
#: Partial wrappers of a host that are merged side by side.
DEAL = 256
#: Different main texts that template text must be seen with.
LEAST = 4
#: Elements that flow within a block.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not text of the page.
RAW = frozenset("script style noscript template iframe svg math object audio video canvas title head".split())
#: Elements that end an open element of the same group.
IMPLIED = {t: g for g in ("li", "dt dd", "tr", "td th", "option", "thead tbody tfoot") for t in g.split()}
#: Elements and roles that are never main text, and words in class and id names that mark such parts.
CHROME = frozenset("nav footer aside form button select textarea menu dialog fieldset input".split())
CHROME_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
CHROME_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus "
    "footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted promotion "
    "recommended related replies reply respond search share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar widget widgets".split()
)
#: What is left of a compound class name in an article, besides such words, shows that it names a part of the article.
GENERIC_WORDS = frozenset("area bar block box button buttons container form inner item items link links list panel post posts slot unit wrap wrapper".split())
#: With a header's, these words in a name show the head of the article, if a h1 is in it.
ARTICLE_WORDS = frozenset("article content entry post story".split())
#: Attributes. Quotes count only right after =, there without a limit; elsewhere a tag holds no <, so a broken one costs no scan of the rest.
ATTRS = r"(?:=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s<>\"'][^\s<>]*+)|[^<>=]|=)*+"
TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|iframe|svg|math|object|audio|video|canvas|title|textarea)\b{ATTRS}>.*?(?:</\1\s*>|\Z)"
    rf"|<(/?)([a-zA-Z][^\s/<>]*+)({ATTRS})>|<[!?][^<>]*+>|([^<]+|<)",
    re.S | re.I,
)
NAMES = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
SPLIT = re.compile(r"[^a-z]+")


class Node:
    """An element of a page or of a wrapper. Children are Nodes; a text is a Node with the label "#"."""

    __slots__ = ("label", "tag", "kids", "text", "size", "chrome", "many", "maybe", "pages", "marks", "main", "soft")

    def __init__(self, label: str, tag: str, chrome: bool = False, text: str = "", soft: str = "") -> None:
        self.label, self.tag, self.chrome, self.text, self.soft = label, tag, chrome, text, soft
        self.kids: list[Node] = []
        self.size, self.many, self.maybe, self.pages, self.main = len(text), False, False, 1, False
        self.marks = {zlib.crc32(text.encode("utf-8", "surrogatepass"))} if label == "#" else set()


def is_chrome(tag: str, names: dict[str, str], inside: bool) -> tuple[bool, str]:
    """Whether an element is no main text by its tag, role, class and id, and what a class or id alone says: `pure`, `mixed`, `head` or nothing. A header within an article is its own.

    Outside of article and main a class name counts by any of its words. Inside, a compound name counts only if it says
    nothing else (comment-list, share-buttons), so that a section of the article such as related-work stays.
    """
    if tag in CHROME or tag == "header" and not inside:
        return True, ""
    if names.get("role", "") in CHROME_ROLES:
        return True, ""
    if tag in ("body", "html", "article", "main"):
        return False, ""
    said = ""
    for name in f"{names.get('class', '')} {names.get('id', '')}".split():
        words = {w for w in SPLIT.split(name) if w}
        if not words & CHROME_WORDS:
            continue
        pure = words <= CHROME_WORDS | GENERIC_WORDS
        if words & CHROME_WORDS == {"header"} and words & ARTICLE_WORDS:
            said = said or "head"
        elif pure or not inside:
            said = "pure" if pure and said != "mixed" else "mixed"
    if said and len(names.get("class", "").split()) > 1 and said == "pure" and any(not ({w for w in SPLIT.split(n) if w} & CHROME_WORDS) for n in names["class"].split()):
        said = "mixed"  # other classes of the element say something else
    return bool(said) and not (inside and said == "head"), said


def reconsider(root: Node) -> None:
    """A name alone doesn't hide an element that holds `main`, nor one of several words that holds an article or most of the page's text, nor an article's head with its h1."""

    def look(node: Node) -> tuple[int, frozenset[str]]:
        size, tags = len(node.text), frozenset({node.tag} & {"main", "article", "h1"})
        for kid in node.kids:
            n, t = look(kid)
            size, tags = size + n, tags | t
        node.size = 0 if node.chrome and not node.soft else size
        return node.size, tags if node.size else frozenset()

    def decide(node: Node) -> frozenset[str]:
        tags = frozenset({node.tag} & {"main", "article", "h1"}).union(*(decide(k) for k in node.kids))
        if node.chrome and node.soft and ("main" in tags or node.soft == "mixed" and ("article" in tags or 2 * node.size > total) or node.soft == "head" and "h1" in tags):
            node.chrome = False
        return tags

    total = look(root)[0]
    decide(root)


def parse(page: str | None) -> Node:
    """The nested block tokens of a page."""
    root = Node("", "")
    stack, inside, text = [root], [0], []
    deep: list[tuple[str, bool]] = []  # open elements beyond DEPTH, and whether they are no main text

    def flush() -> None:
        block = " ".join("".join(text).split())
        text.clear()
        if block and not any(hidden for _, hidden in deep):
            stack[-1].kids.append(Node("#", "#", text=block))

    for m in TOKEN.finditer(page or ""):
        raw, close, tag, attrs, words = m.groups()
        if words:
            text.append(html.unescape(words))
            continue
        if raw or not tag:
            continue
        tag = tag.lower()
        if tag in INLINE:
            if tag == "br":
                text.append(" ")
            continue
        flush()
        if close and any(t == tag for t, _ in deep):
            del deep[len(deep) - 1 - [t for t, _ in deep][::-1].index(tag) :]
            continue
        if close:
            open_tags = [n.tag for n in stack]
            if tag in open_tags[1:]:
                keep = len(open_tags) - 1 - open_tags[::-1].index(tag)
                del stack[keep:], inside[keep:]
                deep.clear()
            continue
        if stack[-1].tag == "p" and not deep:
            stack.pop(), inside.pop()
        if tag in IMPLIED and not deep:
            for k in range(len(stack) - 1, 0, -1):
                if IMPLIED.get(stack[k].tag) == IMPLIED[tag]:
                    del stack[k:], inside[k:]
                    break
                if stack[k].tag in ("ul", "ol", "dl", "table", "select"):
                    break
        names = {k.lower(): (a or b or c or "").lower() for k, a, b, c in NAMES.findall(attrs)} if attrs else {}
        chrome, soft = is_chrome(tag, names, bool(inside[-1]))
        leaf = tag in VOID or attrs.rstrip().endswith("/")
        if deep or len(stack) >= DEPTH and not leaf:
            if not leaf:
                deep.append((tag, chrome))
            continue
        node = Node(f"{tag}.{names.get('class', '')}" if names.get("class") else tag, tag, chrome, soft=soft)
        stack[-1].kids.append(node)
        if not leaf:
            stack.append(node)
            inside.append(inside[-1] or tag in ("article", "main"))
    flush()
    reconsider(root)
    return root


def fold(node: Node) -> Node:
    """Bottom-up, runs of neighbours with one label become one repeated group."""
    kids: list[Node] = []
    for kid in node.kids:
        fold(kid)
        if kids and kids[-1].label == kid.label and kid.label != "#":
            merge(kids[-1], kid)
            kids[-1].many = True
        else:
            kids.append(kid)
    node.kids = kids
    return node


def merge(a: Node, b: Node) -> Node:
    """Align b's tokens with a's: a becomes the least union-free expression here that covers both."""
    a.size += b.size
    a.chrome &= b.chrome
    a.many |= b.many
    a.maybe |= b.maybe
    a.marks = a.marks if len(a.marks) > 1 else a.marks | b.marks
    out: list[Node] = []
    x, y = [k.label for k in a.kids], [k.label for k in b.kids]
    steps = [("equal", 0, len(x), 0, len(y))] if x == y else SequenceMatcher(None, x, y, autojunk=False).get_opcodes()
    for kind, i, j, k, m in steps:
        if kind == "equal":
            out += (merge(p, q) for p, q in zip(a.kids[i:j], b.kids[k:m], strict=True))
        else:
            for kid in a.kids[i:j] + b.kids[k:m]:
                kid.maybe = True
                out.append(kid)
    if len(out) > len(a.kids):  # optional groups may have become neighbours with one label
        kids: list[Node] = []
        for kid in out:
            if kids and kids[-1].label == kid.label and kid.label != "#":
                merge(kids[-1], kid)
                kids[-1].many = True
            else:
                kids.append(kid)
        out = kids
    a.kids = out
    return a


def count_pages(a: Node, b: Node) -> None:
    """Add one page to the elements of wrapper a that page b has."""
    have = {k.label: k for k in b.kids}
    for kid in a.kids:
        if kid.label in have:
            kid.pages += 1
            count_pages(kid, have[kid.label])


def weigh(node: Node) -> int:
    """The text below each node that is not chrome."""
    if node.chrome:
        node.size = 0
        return 0
    node.size = node.size if node.label == "#" else sum(map(weigh, node.kids))
    return node.size


def choose_main(root: Node) -> bool:
    """Mark the main element: article or main with most text, else the root, as text may lie anywhere on its pages."""
    total = weigh(root)
    found: list[Node] = []

    def look(node: Node) -> None:
        if not node.chrome:
            if node.tag in ("article", "main"):
                found.append(node)
            for kid in node.kids:
                look(kid)

    look(root)
    articles = [n for n in found if n.tag == "article" and n.size]
    mains = [n for n in found if n.tag == "main" and n.size]
    if articles and (not mains or 2 * sum(n.size for n in articles) >= max(n.size for n in mains)):
        for n in articles:
            n.main = True
    elif mains:
        max(mains, key=lambda n: n.size).main = True
    else:
        root.main = True
    return total > 0


def infer(pages: list[Node]) -> Node:
    """The wrapper of some pages of one host."""
    wrapper = pages[0]
    for page in pages[1:]:
        count_pages(wrapper, page)
        merge(wrapper, page)
    choose_main(wrapper)
    return wrapper


def pack(node: Node, n_pages: int, free: bool = True, slots: Iterator[int] | None = None) -> list:
    """A wrapper as JSON: label, flags (1 chrome, 2 main, 4 place of a text that may be the template's), children. A text has its place's number instead of children, or -1."""
    slots = itertools.count() if slots is None else slots
    if node.label == "#":
        maybe = free and n_pages >= LEAST and len(node.marks) == 1
        return ["#", 4 * maybe, next(slots) if maybe else -1]
    free &= node.tag not in ("article", "main")
    kids = [] if node.chrome else [pack(k, n_pages if not node.many else 0, free, slots) for k in node.kids]
    return [node.label, node.chrome + 2 * node.main, kids]


def count_places(w: list) -> int:
    return int(w[1] & 4 > 0) if w[0] == "#" else sum(map(count_places, w[2]))


def digest(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def extract(page: Node, wrapper: list) -> list[tuple[str, int]] | None:
    """The blocks of a page's main text by its host's wrapper, each with its place (-1: no template text); None if the page has no main element of the wrapper."""
    blocks: list[tuple[str, int]] = []
    met = False

    def walk(node: Node, w: list | None, in_main: bool) -> None:
        nonlocal met
        if node.label == "#":
            if in_main:
                blocks.append((node.text, w[2] if w else -1))
            return
        if node.chrome or w and w[1] & 1:
            return
        if w and w[1] & 2:
            in_main = met = True
        at, kids = 0, w[2] if w else []
        for kid in node.kids:
            hit = next((i for i in range(at, len(kids)) if kids[i][0] == kid.label), None)
            if hit is None:
                hit = next((i for i in range(min(at, len(kids))) if kids[i][0] == kid.label), None)
            else:
                at = hit
            walk(kid, kids[hit] if hit is not None else None, in_main)

    walk(page, wrapper, False)
    return blocks if met else None


def main_text(page: str | None, wrapper: list | None, template: dict[str, int] | None = None) -> str:
    """template: the digest of the template text at a place (its number as text)."""
    tree = parse(page)
    blocks = extract(tree, wrapper) if wrapper else None
    if blocks is None:
        blocks = extract(tree, pack(infer([fold(parse(page))]), 1)) or []
    return "\n".join(x for x, at in blocks if not (template and at >= 0 and str(at) in template and template[str(at)] == digest(x)))


def places(page: str | None, wrapper: list) -> tuple[int, list[tuple[int, int]]]:
    """A digest of a page's main text, and the places in it that may hold template text with the digests of their texts."""
    blocks = extract(parse(page), wrapper) or []
    return digest("\n".join(x for x, _ in blocks)), [(at, digest(x)) for x, at in blocks if at >= 0]


def skeleton(node: Node) -> list:
    """A folded page as JSON, its texts as checksum and length."""
    if node.label == "#":
        return ["#", min(node.marks), node.size, len(node.marks)]
    return [node.label, int(node.chrome) + 2 * node.many + 4 * node.maybe, [skeleton(k) for k in node.kids]]


def revive(x: list) -> Node:
    if x[0] == "#":
        node = Node("#", "#")
        node.marks, node.size = {x[1]} if x[3] == 1 else {x[1], -1}, x[2]
        return node
    node = Node(x[0], x[0].split(".")[0], bool(x[1] & 1))
    node.many, node.maybe = bool(x[1] & 2), bool(x[1] & 4)
    node.kids = [revive(k) for k in x[2]]
    return node


def merged(shapes: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """keys, shape and n: the shapes of rows with equal keys merged in the given order, and how many pages they are of."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, node, n = None, None, 0
        done = lambda: pa.RecordBatch.from_pydict({**{k: [v] for k, v in zip(keys, at, strict=True)}, "shape": [json.dumps(skeleton(node))], "n": [n]}, pa.schema([*((k, pa.string() if k == "host" else pa.int64()) for k in keys), ("shape", pa.string()), ("n", pa.int64())]))
        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in (*keys, "shape", "n")]
            for *key, shape, count in zip(*columns, strict=True):
                page = revive(json.loads(shape))
                if key == at:
                    merge(node, page)
                    n += count
                    continue
                if at is not None:
                    yield done()
                at, node, n = key, page, count
        if at is not None:
            yield done()

    dealt = shapes.repartition(*keys).sortWithinPartitions(*keys, *order).select(*keys, "shape", "n")
    return dealt.mapInArrow(run, ", ".join(f"{k} {'string' if k == 'host' else 'long'}" for k in keys) + ", shape string, n long")


def wrappers(pages: DataFrame) -> DataFrame:
    """host, wrapper (JSON) and n_places (of texts that may be the template's), from all pages of each host."""

    def shape(part: pa.RecordBatch) -> dict:
        return {"shape": [json.dumps(skeleton(fold(parse(x)))) for x in part.column("html").to_pylist()]}

    shapes = map_texts(pages.withColumn("k", F.xxhash64("url", "page_id")), shape, "shape string", ["host", "k"], "html")
    parts = merged(shapes.withColumn("deal", F.pmod("k", F.lit(DEAL))).withColumn("n", F.lit(1).cast("long")), ["host", "deal"], ["k", "shape"])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for s, n in zip(batch.column("shape").to_pylist(), batch.column("n").to_pylist(), strict=True):
                wrapper = revive(json.loads(s))
                choose_main(wrapper)
                found.append(pack(wrapper, n))
            yield pa.RecordBatch.from_pydict({"host": batch.column("host"), "wrapper": [json.dumps(w) for w in found], "n_places": pa.array(map(count_places, found), pa.int64())})

    return merged(parts, ["host"], ["deal"]).mapInArrow(whole, "host string, wrapper string, n_places long")


def by_wrapper(pages: DataFrame, found: DataFrame, f: Callable[[list, list], dict], schema: str, keep: list[str], broadcast_bytes: int) -> DataFrame:
    """f gets html and the decoded wrapper of its host (None where found has none) and gives the new columns."""
    n_bytes = found.agg(F.sum(F.octet_length("wrapper") + F.octet_length("host"))).first()[0] or 0
    if n_bytes <= broadcast_bytes:
        table = pages.sparkSession.sparkContext.broadcast({r["host"]: r["wrapper"] for r in found.select("host", "wrapper").toArrow().to_pylist()})
        memory: dict[str, list] = {}

        def decoded(part: pa.RecordBatch) -> Iterator[list | None]:
            for h in part.column("host").to_pylist():
                if h not in memory and h in table.value:
                    memory[h] = json.loads(table.value[h])
                yield memory.get(h)

        rows, extra = pages, ["host"]
    else:

        def decoded(part: pa.RecordBatch) -> Iterator[list | None]:
            for w in part.column("wrapper").to_pylist():
                yield json.loads(w) if w else None

        rows, extra = pages.join(found.select("host", "wrapper"), "host", "left"), ["host", "wrapper"]
    return map_texts(rows, lambda part: f(part.column("html").to_pylist(), list(decoded(part))), schema, [*keep, *extra], "html")


def template_texts(pages: DataFrame, found: DataFrame, broadcast_bytes: int) -> DataFrame:
    """host and texts (array of place and digest): the template texts, counted over all pages of each host."""

    def f(htmls: list, wrapped: list) -> dict:
        got = [places(x, w) if w else (0, []) for x, w in zip(htmls, wrapped, strict=True)]
        return {"body": [b for b, _ in got], "places": [[{"place": k, "mark": m} for k, m in p] for _, p in got]}

    seen = by_wrapper(pages, found.where("n_places > 0"), f, "body long, places array<struct<place:int,mark:long>>", [], broadcast_bytes)
    seen = seen.select("host", "body", F.explode("places").alias("p")).select("host", "body", "p.place", "p.mark")
    # copies of a main text count once; both steps are combined in each task, and the first is dealt by main text
    once = seen.groupBy("host", "place", "body").agg(F.min("mark").alias("low"), F.max("mark").alias("high"))
    same = once.groupBy("host", "place").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.count("*").alias("n")).where((F.col("low") == F.col("high")) & (F.col("n") >= LEAST))
    return same.groupBy("host").agg(F.collect_list(F.struct("place", F.col("low").alias("mark"))).alias("texts"))


def extract_pages(pages: DataFrame, broadcast_bytes: int = 16 << 20) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    bound_batches(pages.sparkSession)
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))
    pages = pages.select("page_id", "url", "html", host.alias("host"))
    found = stage(wrappers(pages), "wrappers")
    pair = lambda x: F.concat(F.lit('"'), x["place"].cast("string"), F.lit('":'), x["mark"].cast("string"))
    texts = F.lit("")
    if not found.where("n_places > 0").isEmpty():
        found = stage(found.join(template_texts(pages, found, broadcast_bytes), "host", "left"), "wrappers-texts")
        texts = F.coalesce(F.array_join(F.transform("texts", pair), ","), F.lit(""))
    found = found.select("host", F.concat(F.lit("["), "wrapper", F.lit(",{"), texts, F.lit("}]")).alias("wrapper"))

    def f(htmls: list, wrapped: list) -> dict:
        return {"text": [main_text(x, *(w or (None, None))) for x, w in zip(htmls, wrapped, strict=True)]}

    out = by_wrapper(pages, found, f, "text string", ["page_id", "url"], broadcast_bytes)
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
