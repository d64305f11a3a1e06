"""Main text of web pages by tag-path ratios.

A page becomes its text blocks in order, each with the path of tags (and
first class) from the root. Per path, over the whole page, two ratios are
formed: characters per block, and the same weighted with the punctuation
per block. Both are smoothed over the sequence of blocks with a Gaussian
window in which a neighbour counts the less the farther its path is away,
scaled to the page's mean, fused by their product and averaged per path;
paths whose value reaches a share of the standard deviation are content.
The article is the innermost section that holds nearly all content
characters; its blocks are returned, headings and short lines included, and
so are content blocks elsewhere with the headings just before them. What
goes first are subtrees that are no article text by their tag, role or a
class that names just that (menus, forms, adverts, notices, comments, ...);
sections named by their place only (sidebar, banner, ...) come back if
nothing outside them is content. Lists of links that are no content by
their ratio go, unless they lie in an ``article`` element.

Defined results: NULL, empty and text-free pages give an empty string; tags
left open are closed by the rules for their kind; repeated rows give
repeated results; nothing is cut, however long the page.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

TOKEN = re.compile(
    r"<!--.*?(?:-->|--!>|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<(?:[!?]|/[^a-zA-Z])[^>]*(?:>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)"
    r"|</?[a-zA-Z][^>]*(?:>|\Z)",  # a quote that is never closed
    re.S,
)
ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
PUNCTUATION = re.compile(r"[.,;:!?…。，；：！？、؟،।]")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

# Kinds of HTML elements.
RAW = frozenset("script style noscript template iframe noembed noframes xmp textarea title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img".split()
)
SECTIONS = frozenset("html body main article section div center td".split())
LISTS = frozenset("ul ol dl table div section".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: an opening tag ends the open elements of these kinds, up to the given borders
CLOSES = {
    "li": ("li", frozenset("ul ol menu".split())),
    "dt": ("dt dd", frozenset(["dl"])),
    "dd": ("dt dd", frozenset(["dl"])),
    "option": ("option", frozenset(["select"])),
    "tr": ("tr td th", frozenset(["table"])),
    "td": ("td th", frozenset("tr table".split())),
    "th": ("td th", frozenset("tr table".split())),
    "tbody": ("tbody thead tfoot tr td th", frozenset(["table"])),
}
ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split()
)
P_BORDERS = frozenset("button td th table caption article section div body html li blockquote".split())
# What is no article text.
SKIP_TAGS = frozenset(
    "nav aside footer header head dialog menu button select input fieldset svg math object audio video canvas map datalist search".split()
)
SKIP_ROLES = frozenset(
    "navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar tablist feed".split()
)
SKIP_WORDS = frozenset(
    """ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner
    nav navbar navigation menu breadcrumb breadcrumbs pager pagination sitemap
    sidebar aside widget widgets related recommended recommendations trending popular teaser
    header masthead topbar footer foot copyright
    comment comments commentlist disqus respond reply replies reactions
    share sharing social follow subscribe subscription newsletter signup login paywall
    cookie cookies consent gdpr notice notices notification popup modal overlay alert toast
    search searchform toolbar toc skip hidden""".split()
)
#: words that also name what surrounds an article; they count less where hardly anything else is left
LAYOUT_WORDS = frozenset("nav navbar navigation menu sidebar aside widget widgets header masthead topbar footer foot banner toc skip hidden".split())
SPARE_TAGS = frozenset("html body main".split())
#: "has-sidebar", "no-ads", "with-comments" say what is around, not what this is
AROUND = frozenset("has no with without".split())
#: what may follow one of the words above ("comment-list"); other words make a name of their own ("follow-up", "share-price")
HOLDERS = frozenset(
    """area articles author bar block body bottom box button buttons card carousel center column container content
    desktop form frame grid group heading holder icons inner item items label large left line link links list meta
    mobile module now outer panel placeholder post posts right row section slot small space stories strip text this
    thread title top unit us wrap wrapper x you zone""".split()
)

SIGMA = 0.6  # blocks: width of the smoothing window
REACH = 3  # blocks on either side
NEAR = 0.5  # weight of a neighbour per step between the paths
SHARE = 1.0  # of the paths' standard deviation: threshold of the fused ratios
MOST = 0.9  # of the content characters: what the article must hold
LINKED = 0.6  # share of a list's characters in links that makes it a menu
ARTICLE_WORDS = frozenset("comment comments reply ad promo teaser related".split())
DEEPEST = 512  # elements below this depth are laid side by side
SLICE = 128


class Node:
    __slots__ = ("depth", "links", "parent", "path", "skip", "tag", "total", "weight")

    def __init__(self, tag: str, parent: Node | None, path: int, skip: int):
        self.tag, self.parent, self.path, self.skip = tag, parent, path, skip
        self.depth = parent.depth + 1 if parent else 0
        self.total = self.links = self.weight = 0


def _skipped(tag: str, attrs: str, parent: Node) -> tuple[int, str]:
    """Whether a subtree is no article text (2), or none by a layout word only (1), and the first class."""
    name, cls = "", ""
    if attrs.strip(" /"):
        found = {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in ATTR.finditer(attrs)}
        cls = (found.get("class", "").split() or [""])[0]
        name = f"{found.get('class', '')} {found.get('id', '')}"
        if "hidden" in found or found.get("aria-hidden", "").lower() == "true":
            return 2, cls
        if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", ""), re.I):
            return 2, cls
        if found.get("role", "").lower() in SKIP_ROLES:
            return 2, cls
    inside = any(up.tag in ("article", "main") for up in _above(parent))
    if tag in SKIP_TAGS:  # an article's own header has its title
        return 2 * (tag != "header" or not inside), cls
    if name and tag not in SPARE_TAGS:
        words = [[w.lower() for w in WORD.findall(part)] for part in name.split()]
        marked: set[str] = set()
        for x in words:
            if not x or not AROUND.isdisjoint(x):
                continue
            if x[-1] in SKIP_WORDS:
                marked.add(x[-1])
            elif x[0] in SKIP_WORDS and all(w in HOLDERS or w in SKIP_WORDS or w.isdigit() for w in x[1:]):
                marked.add(x[0])
        if inside:
            marked -= {"header"}
        if tag == "article":
            marked &= ARTICLE_WORDS
        if marked:
            return 1 + bool(marked - LAYOUT_WORDS), cls
    return 0, cls


def blocks(page: str) -> list[tuple[Node, str, int]]:
    """The page's text blocks in order: innermost block element, text, characters in links."""
    root = Node("html", None, 0, 0)
    paths: dict[tuple, int] = {}  # number of a path by its parent's, tag and class
    node, out, parts, linked = root, [], [], 0
    anchor = 0  # open <a> elements

    def flush() -> None:
        nonlocal parts, linked
        text = " ".join("".join(parts).split())
        if text:
            block = node
            while block.tag in INLINE and block.parent:
                block = block.parent
            out.append((block, text, linked))
        parts, linked = [], 0

    def put(text: str, entities: bool = True) -> None:
        nonlocal linked
        if text:
            if entities and "&" in text:
                text = html.unescape(text)
            parts.append(text)
            if anchor:
                linked += len(text.strip())

    def leave(kinds: frozenset, borders: frozenset) -> None:
        nonlocal node, anchor
        at = node
        while at.parent and at.tag not in borders:
            if at.tag in kinds:
                flush()
                while node is not at.parent:
                    anchor -= node.tag == "a"
                    node = node.parent
                return
            at = at.parent

    at, n = 0, len(page)
    while at < n:
        m = TOKEN.search(page, at)
        if not m:
            put(page[at:])
            break
        put(page[at : m.start()])
        at = max(m.end(), m.start() + 1)
        if m["cdata"] is not None:
            put(m["cdata"], False)
        if not m["tag"]:
            continue
        tag = m["tag"].lower()
        if m["close"]:
            if tag == "p" or tag not in INLINE:
                flush()
            if tag in VOID or tag in RAW:
                continue
            up, found = node, None
            while up.parent:
                if up.tag == tag:
                    found = up
                    break
                if tag in INLINE and up.tag not in INLINE:
                    break  # an inline end tag doesn't close blocks
                up = up.parent
            while found and node is not found.parent:
                anchor -= node.tag == "a"
                node = node.parent
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at = end.end() if end else n
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag not in INLINE:
            flush()
            if tag in ENDS_P:
                leave(frozenset(["p"]), P_BORDERS)
            if tag in HEADINGS:
                leave(HEADINGS, P_BORDERS)
            if tag in CLOSES:
                kinds, borders = CLOSES[tag]
                leave(frozenset(kinds.split()), borders)
        if tag in VOID:
            continue
        if tag == "html" and not node.parent:
            continue
        skip, cls = _skipped(tag, m["attrs"], node) if m["attrs"] or tag in SKIP_TAGS else (0, "")
        path = node.path if tag in INLINE else paths.setdefault((node.path, tag, cls), len(paths) + 1)
        above = node if node.depth < DEEPEST else node.parent
        node = Node(tag, above, path, max(node.skip, skip))
        anchor += tag == "a"
    flush()
    return out


def _smooth(x: np.ndarray, weights: list[np.ndarray]) -> np.ndarray:
    """``x`` averaged with its neighbours; ``weights[k - 1][i]`` is that of the blocks i and i + k for each other."""
    total, norm = x.copy(), np.ones(len(x))
    for k, w in enumerate(weights, 1):
        total[:-k] += w * x[k:]
        total[k:] += w * x[:-k]
        norm[:-k] += w
        norm[k:] += w
    return total / norm


def _weights(nodes: list[Node], at: np.ndarray) -> list[np.ndarray]:
    """Weights of neighbouring blocks, by their distance on the page and the steps between their paths."""
    chains: dict[int, list[int]] = {}
    for k, node in zip(at.tolist(), nodes, strict=True):
        if k not in chains:
            chains[k] = list(dict.fromkeys(up.path for up in _above(node)))[::-1]
    steps: dict[tuple[int, int], int] = {}
    out = []
    for k in range(1, min(REACH, len(at) - 1) + 1):
        apart = []
        for pair in zip(at[:-k].tolist(), at[k:].tolist(), strict=True):
            if pair not in steps:
                a, b = chains[pair[0]], chains[pair[1]]
                same = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
                steps[pair] = len(a) + len(b) - 2 * same
            apart.append(steps[pair])
        out.append(np.exp(-0.5 * (k / SIGMA) ** 2) * NEAR ** np.array(apart, dtype=float))
    return out


def path_ratios(found: list[tuple[Node, str, int]]) -> np.ndarray:
    """The smoothed, fused ratio of each block's path."""
    nodes = [n for n, _, _ in found]
    at = np.unique([n.path for n in nodes], return_inverse=True)[1]
    count = np.bincount(at)
    chars = np.bincount(at, [max(0, len(text) - linked) for _, text, linked in found]) / count
    marks = np.bincount(at, [len(PUNCTUATION.findall(text)) for _, text, _ in found]) / count
    weights = _weights(nodes, at)
    fused = np.ones(len(found))
    for x in (_smooth(chars[at], weights), _smooth((chars * marks)[at], weights)):
        mean = x.mean()
        if mean > 0:
            fused *= np.sqrt(x / mean)
    return (np.bincount(at, fused) / count)[at]


def content_blocks(found: list[tuple[Node, str, int]]) -> np.ndarray:
    """Whether each block's path is content."""
    ratio = path_ratios(found)
    first = np.unique([n.path for n, _, _ in found], return_index=True)[1]  # every path counts once
    return ratio >= SHARE * ratio[first].std()


def _above(node: Node | None) -> Iterator[Node]:
    while node:
        yield node
        node = node.parent


def outside_forms(found: list[tuple[Node, str, int]]) -> list[tuple[Node, str, int]]:
    """The blocks without those of forms; a form around half of the text or more, sentences in paragraphs among it, only wraps the page."""
    forms: dict[Node, list] = {}
    total = 0
    for node, text, linked in found:
        size, prose = max(0, len(text) - linked), False
        total += size
        for up in _above(node):
            prose = prose or (up.tag in ("p", "article", "main") and bool(PUNCTUATION.search(text)))
            if up.tag == "form":
                held = forms.setdefault(up, [0, False])
                held[0] += size
                held[1] = held[1] or prose
                break
    gone = {form for form, (size, prose) in forms.items() if not prose or 2 * size < total}
    return [b for b in found if not any(up in gone for up in _above(b[0]))] if gone else found


def extract(page: str | None) -> str:
    """The article of a page: its blocks joined by line breaks."""
    every = outside_forms([b for b in blocks(page or "") if b[0].skip < 2])
    found = [b for b in every if not b[0].skip]
    if len(found) < len(every):
        content = content_blocks(every)
        if not any(good and not b[0].skip for b, good in zip(every, content.tolist(), strict=True)):
            if not any(up.tag in ("article", "main") for b in found for up in _above(b[0])):
                found = every
    if not found:
        return ""
    content = content_blocks(found)
    total = 0
    for (node, text, linked), good in zip(found, content.tolist(), strict=True):
        size = max(0, len(text) - linked) if good else 0
        total += size
        for up in _above(node):
            up.weight += size
            up.total += len(text)
            up.links += linked
    article: Node | None = None
    if total:
        for node, _, _ in found:
            for up in _above(node):
                if article is not None and up.depth <= article.depth:
                    break
                if up.tag in SECTIONS and up.weight >= MOST * total:
                    article = up
                    break
    if article is not None:  # <div>s inside an <article> or <main> belong to it
        for up in _above(article):
            if up.tag in ("article", "main"):
                article = up
                break
    keep = []
    title = None
    heads: list[str] = []  # headings just before, outside the article
    for (node, text, linked), good in zip(found, content.tolist(), strict=True):
        ups = list(_above(node))
        menu = not any(u.tag == "article" for u in ups) and any(u.links > LINKED * u.total for u in ups if u.links and u.tag in LISTS and u is not article)
        menu = not good and (menu or (linked > LINKED * len(text) and node.tag in SECTIONS - {"article"}))
        if article is not None and article not in ups and (not good or linked >= len(text)):
            if node.tag == "h1" and not keep and article.parent in ups:
                title = text  # a title just before the article's section
            heads = [*heads, text] if node.tag in HEADINGS and not menu else []
            continue
        if article is not None and article not in ups:
            keep += heads
        heads = []
        if not menu:
            keep.append(text)
    if title and keep and title not in keep:
        keep.insert(0, title)
    return "\n".join(keep)


def extract_main_text(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` for every row of ``pages(page_id, url, html)``; no shuffle."""
    rows = pages.select("page_id", "url", "html")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                texts = [extract(x) for x in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())],
                    names=["page_id", "url", "text", "n_chars"],
                )

    return rows.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
