"""Main text of web pages by a site style tree.

The pages of a host are merged into one tree whose nodes are paths of block elements with their classes. A node knows in
how many ways pages lay out its children (presentation) and which texts stand in it (content), both as counts over the
host of its distinct pages, so that copies are no template. Entropy makes importances of them: a layout that varies is
important, a text that all pages share isn't. Branches without an important node are removed from every page of the host.

Marks of the page enter as importances. Elements whose tag, class or role says what they are (navigation, advert, form,
...) have 0. The element marked as article or main has 1, and so has its h1; what lies below it goes by the tree, unless
that would take most of the marked text. Important branches beside an article stay where they are the larger text.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.shared import kept

#: Elements that never hold main text.
NOISE_TAGS = frozenset(
    "head script style noscript template nav footer aside form menu dialog iframe object embed svg canvas map audio video "
    "button select option textarea input datalist fieldset applet frameset noframes title".split()
)
#: Words in a class, id or role that name something beside the main text.
NOISE_WORDS = frozenset(
    "ad ads adbox advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent "
    "gdpr notice newsletter subscribe subscription popup modal overlay sidebar sidenav menu nav navbar navigation "
    "breadcrumb breadcrumbs pagination pager footer comment comments disqus reply replies respond related recommended "
    "recommendations share sharing social widget toolbar login signup search masthead contentinfo complementary alert "
    "skip legal copyright".split()
)
#: Words after the one that names an element, and words that say what an element has or lacks rather than what it is.
BOXES = frozenset("list box area bar wrap wrapper container block section links buttons left right top bottom inner outer slot item items form posts articles stories".split())
RELATIONS = frozenset("has have no not with without hide show js".split())
#: What a class or id never makes noise.
WHOLE_TAGS = frozenset("html body main".split())
#: Noise that is text of its own, however long: never taken for the article while there is other text.
READERS = frozenset("comment comments disqus reply replies respond related recommended recommendations".split())
#: What says that an article element stands for another page.
TEASERS = frozenset("teaser card preview excerpt snippet".split())
MAIN_TAGS, MAIN_ROLES = frozenset(("article", "main")), frozenset(("main", "article"))
INLINE_TAGS = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q ruby rb rt rp s samp small "
    "span strike strong sub sup time tt u var wbr".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input keygen link meta param source track wbr".split())
RAW_TAGS = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: An open element of the second kind ends where one of the first kind begins.
ENDED_BY = {
    "li": frozenset(("li",)), "dt": frozenset(("dt", "dd")), "dd": frozenset(("dt", "dd")), "tr": frozenset(("tr",)),
    "td": frozenset(("td", "th")), "th": frozenset(("td", "th")), "option": frozenset(("option",)),
}

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^\"'>])*+|[^>]*)>", re.S
)
NAMED = re.compile(r"""(?:^|[\s"'/])(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
PIECES = re.compile(r"[^a-zA-Z]+|(?<=[a-z])(?=[A-Z])")
HIDDEN_STYLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
MASK = (1 << 63) - 1


def stable(text: str) -> int:
    """A 63-bit hash that every worker agrees on."""
    import xxhash

    return xxhash.xxh3_64_intdigest(text) & MASK


@dataclass
class Element:
    tag: str
    path: str
    noise: bool
    main: bool
    named: bool = False
    reader: bool = False
    at: int = -1
    sole: bool = False
    children: list[str] = field(default_factory=list)


@dataclass
class Block:
    text: str
    path: str
    branches: tuple[str, ...]
    #: In a marked element, and the branches below it; in the element that a page has once for its main text.
    main: bool
    below: tuple[str, ...]
    sole: bool
    linked: int
    #: In an element that was spared.
    spared: bool


def head_word(name: str) -> str:
    """The word of a class or id that says what its element is: empty for has-sidebar, science for social-science."""
    words = [w.lower() for w in PIECES.split(name) if w]
    while len(words) > 1 and words[-1] in BOXES:
        words.pop()
    return words[-1] if words and not RELATIONS & set(words) else ""


def _described(tag: str, attributes: str) -> tuple[str, bool, bool, set[str], bool]:
    """(label, noise, main, named, sole) of a start tag; ``named``: words of class and id that say that it is noise."""
    noise, main, named, label, sole = tag in NOISE_TAGS, tag in MAIN_TAGS, set(), tag, tag == "main"
    words = NOISE_WORDS | TEASERS if tag == "article" else NOISE_WORDS
    for name, value in NAMED.findall(attributes) if attributes else ():
        name, value = name.lower(), value.strip("\"'")
        if name == "role":
            noise |= bool({w.lower() for w in PIECES.split(value) if w} & NOISE_WORDS)
            main |= value.strip().lower() in MAIN_ROLES
            sole |= value.strip().lower() == "main"
        elif name in ("class", "id"):
            named |= words & set(map(head_word, value.split()))
            if name == "class":
                label += "." + ".".join(value.split())
        else:
            noise |= name == "hidden" or value.lower() == "true" if name != "style" else bool(HIDDEN_STYLE.search(value))
    return label, noise and not main, main, named, sole


def parsed(html: str | None) -> tuple[list[Block], list[tuple[str, str]]]:
    """(blocks of text outside noise in page order, (path, layout of its children) of every element outside noise).

    White space in a block is one space; character references are decoded. Unclosed and stray tags are tolerated as
    browsers do: a block element ends an open paragraph, an end tag closes everything inside its element. An element that
    is noise by its class or id alone isn't if it is or holds a marked article with more text than all that is left of
    the page. Comments and related articles have to be all there is.
    """
    blocks, layouts, holders = _walked(html, frozenset())
    quiet = frozenset(at for at, reader in holders.items() if not reader)
    tries = [quiet] if quiet else []
    if not blocks and len(quiet) < len(holders):
        tries.append(frozenset(holders))
    for spared in tries:
        again, layouts_again, _ = _walked(html, spared)
        if sum(len(b.text) for b in again if b.spared and b.main) > sum(len(b.text) for b in blocks):
            return again, layouts_again
    return blocks, layouts


def _walked(html: str | None, spared: frozenset[int]) -> tuple[list[Block], list[tuple[str, str]], dict[int, bool]]:
    """Blocks, layouts, and the places of named elements around marked articles: whether all of these are comments or related."""
    blocks: list[Block] = []
    layouts: list[tuple[str, str]] = []
    stack = [Element("", "", False, False)]
    noise = main = linked = 0
    in_link = False
    holders: dict[int, bool] = {}
    buffer: list[str] = []

    def flush() -> None:
        nonlocal linked
        if buffer:
            text = " ".join("".join(buffer).split())
            buffer.clear()
            if text:
                mark = next((k for k, e in enumerate(stack) if e.main), len(stack) - 1)
                below = tuple(dict.fromkeys(e.path for e in stack[mark + 1 :] if e.path != stack[mark].path))
                held = any(e.at in spared for e in stack)
                blocks.append(Block(text, stack[-1].path, tuple(dict.fromkeys(e.path for e in stack[1:])), main > 0, below, any(e.sole for e in stack), linked, held))
            linked = 0

    def pop() -> None:
        nonlocal noise, main
        gone = stack.pop()
        noise -= gone.noise
        main -= gone.main
        if not noise and not gone.noise:
            layouts.append((gone.path, " ".join(gone.children)))

    at, html = 0, html or ""
    for found in iter(lambda: TOKEN.search(html, at), None):
        if not noise and found.start() > at:
            text = html[at : found.start()]
            buffer.append(entities.unescape(text) if "&" in text else text)
            linked += len(text.strip()) if in_link else 0
        at = found.end()
        closing, name, attributes = found.groups()
        if name is None:
            if not noise and found.group().startswith("<![CDATA["):
                buffer.append(found.group()[9:-3])
            continue
        tag = name.lower()
        in_link = not closing if tag == "a" else in_link
        if closing:
            if tag in INLINE_TAGS and not any(e.tag == tag for e in stack[-4:]):
                continue
            depth = next((k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == tag), 0)
            if depth:
                if tag not in INLINE_TAGS:
                    flush()
                while len(stack) > depth:
                    pop()
            elif tag not in INLINE_TAGS:
                flush()
            continue
        label, is_noise, is_main, words, is_sole = _described(tag, attributes)
        is_named = bool(words) and not is_noise and tag not in WHOLE_TAGS and not is_sole and found.start() not in spared
        reader = bool(words & READERS)
        if is_main and (noise or is_named) and all(e.named for e in stack if e.noise):
            around = [(e.at, e.reader) for e in stack if e.noise] + [(found.start(), reader)] * is_named
            any_reader = any(r for _, r in around)
            holders.update((place, any_reader and holders.get(place, True)) for place, _ in around)
        is_noise, is_main = is_noise or is_named, is_main and not is_named
        if tag in RAW_TAGS:
            end = re.compile(f"</{re.escape(tag)}", re.I).search(html, at)
            at = html.find(">", end.end()) + 1 or len(html) if end else len(html)
            continue
        if tag in VOID_TAGS:
            if not noise:
                if tag in ("br", "img", "wbr"):
                    buffer.append(" " if tag == "br" else "")
                else:
                    flush()
            continue
        if tag in INLINE_TAGS and not is_noise:
            continue
        if tag not in INLINE_TAGS:
            flush()
            ends = ENDED_BY.get(tag)
            while len(stack) > 1 and (stack[-1].tag == "p" or stack[-1].tag in INLINE_TAGS or ends and stack[-1].tag in ends):
                pop()
            if tag == "header":  # the heading of an article, or else of the page
                is_noise, is_named = is_noise or not main, is_named and main > 0
        if not noise:
            stack[-1].children.append(label)
        if attributes.rstrip().endswith("/") and tag not in ("p", "div", "article", "section"):
            continue
        parent = stack[-1]
        path = parent.path if parent.path.rpartition("/")[2] == label else f"{parent.path}/{label}"
        stack.append(Element(tag, path, is_noise, is_main, is_named, reader, found.start(), is_sole and is_main))
        noise += is_noise
        main += is_main
    if not noise and at < len(html):
        buffer.append(entities.unescape(html[at:]))
    flush()
    while len(stack) > 1:
        pop()
    return blocks, layouts, holders


def main_text(blocks: list[Block], noisy: frozenset[int]) -> str:
    """The blocks of a page without the noisy branches of its host, in page order.

    Of marked blocks those in a noisy branch below the mark go, but for an h1, if they are the smaller part of the marked
    text. Blocks beside marked ones stay if none is in a main element, they are outside noisy branches, less than half of
    each is links, and together they are longer than the marked text.
    """

    def outside(branches: tuple[str, ...]) -> bool:
        return not any(stable(p) in noisy for p in branches)

    def size(some: list[Block]) -> int:
        return sum(len(b.text) for b in some)

    marked = [b for b in blocks if b.main]
    beside = [b for b in blocks if not b.main and outside(b.branches)]
    if marked:
        important = [b for b in marked if outside(b.below) or b.path.endswith("/h1")]
        if 2 * size(important) > size(marked):
            marked = important
        beside = [] if any(b.sole for b in marked) else [b for b in beside if 2 * b.linked < len(b.text)]
        if size(beside) <= size(marked):
            beside = []
    chosen = {id(b) for b in marked + beside}
    return "\n\n".join(b.text for b in blocks if id(b) in chosen)


HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"


def hosts(pages: DataFrame):
    """The host of the url in lower case; empty if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit("")), HOST, 1))


def page_nodes(pages: DataFrame) -> DataFrame:
    """host, page (a hash of its html), nodes (is_text, path, value, branches above) of every distinct page of a host.

    Only hashes travel, so a page is a small part of its html here; copies are left out by the tasks that read them first.
    """
    node = pa.struct([("is_text", pa.bool_()), ("path", pa.int64()), ("value", pa.int64()), ("branches", pa.list_(pa.int64()))])

    def grow(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: dict[tuple[str, int], list[dict]] = {}
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                key = host, stable(page or "")
                if key in rows:
                    continue
                blocks, layouts = parsed(page)
                nodes = {(False, stable(path), stable(layout)): [] for path, layout in layouts}
                nodes |= {(True, stable(b.path), stable(b.text)): [stable(p) for p in b.branches] for b in blocks}
                rows[key] = [{"is_text": k[0], "path": k[1], "value": k[2], "branches": above} for k, above in nodes.items()]
            names, hashes = [k[0] for k in rows], [k[1] for k in rows]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(hashes, pa.int64()), pa.array(list(rows.values()), pa.list_(node))], ["host", "page", "nodes"])

    schema = "host string, page long, nodes array<struct<is_text:boolean,path:long,value:long,branches:array<long>>>"
    rows = pages.select(hosts(pages).alias("host"), "html").mapInArrow(grow, schema)
    return rows.dropDuplicates(["host", "page"])


def style_tree(distinct: DataFrame) -> DataFrame:
    """The merged tree of ``page_nodes``: host, kind (layout or text), path, branches above it, value, pages with it.

    A task adds up what it reads, so a host or a text that many pages have is a few rows of each task.
    """
    rows = distinct.select("host", F.inline("nodes"))
    return rows.groupBy("host", "is_text", "path", "value").agg(F.count(F.lit(1)).alias("n"), F.first("branches").alias("branches"))


def noisy_branches(distinct: DataFrame, threshold: float, gamma: float) -> DataFrame:
    """(host, noisy): the branches of each host whose nodes are all of low importance; a row per host.

    m: distinct pages of the host. Presentation: entropy of the layouts of a node to base m. Content: 1 - mean entropy, to base m,
    of the texts of a node, so that a text of one page counts 1 and a text of all pages 0. Both are 1 on a host with one
    page. A node's importance is (1 - gamma ** layouts) * presentation + gamma ** layouts * content, as in the published
    style tree; a branch is as important as the most important text in it.
    """
    m = distinct.groupBy("host").agg(F.count(F.lit(1)).alias("m"))
    nodes = kept(style_tree(distinct), "style-tree").groupBy("host", "is_text", "path").agg(
        F.sum("n").alias("all"), F.count(F.lit(1)).alias("values"), F.sum(F.col("n") * F.log("n")).alias("nlogn"),
        F.sum(F.log("n")).alias("logs"), F.first("branches").alias("branches"),
    )
    nodes = nodes.join(m, "host")
    base = F.log(F.col("m").cast("double"))
    nodes = nodes.withColumn("presentation", F.when(F.col("m") > 1, (F.log("all") - F.col("nlogn") / F.col("all")) / base).otherwise(1.0))
    nodes = nodes.withColumn("content", F.when(F.col("m") > 1, 1 - F.col("logs") / F.col("values") / base).otherwise(1.0))
    layout = nodes.where("not is_text").select("host", "path", "presentation", F.col("values").alias("layouts"))
    texts = nodes.where("is_text").select("host", "path", "content", "branches").join(layout, ["host", "path"], "left")
    fade = F.pow(F.lit(gamma), F.coalesce("layouts", F.lit(0)))
    importance = (1 - fade) * F.coalesce("presentation", F.lit(0.0)) + fade * F.col("content")
    branch = texts.select("host", F.explode("branches").alias("branch"), importance.alias("importance"))
    branch = branch.groupBy("host", "branch").agg(F.max("importance").alias("importance")).where(F.col("importance") < threshold)
    return branch.groupBy("host").agg(F.collect_set("branch").alias("noisy"))


def extracted(pages: DataFrame, threshold: float = 0.3, gamma: float = 0.9) -> DataFrame:
    """page_id, url, text, n_chars: the main text of every row of ``pages`` (page_id, url, html).

    Blocks are joined in page order by two line feeds; inside a block white space is one space. Null and empty html, and
    pages without main text, give an empty text. A null or odd url belongs to the host without a name. Repeated rows are
    rows of their own but count once in the tree. An empty table gives no rows. Other columns are ignored.
    """
    distinct = kept(page_nodes(pages), "page-nodes")
    noisy = kept(noisy_branches(distinct, threshold, gamma), "noisy-branches", 8)
    rows = pages.select("page_id", "url", "html", hosts(pages).alias("host")).join(noisy, "host", "left").drop("host")

    def extract(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(parsed(page)[0], frozenset(low or ())) for page, low in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    kinds = {f.name: f.dataType for f in pages.schema.fields}
    schema = T.StructType([T.StructField("page_id", kinds["page_id"]), T.StructField("url", kinds["url"]), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return rows.mapInArrow(extract, schema)
