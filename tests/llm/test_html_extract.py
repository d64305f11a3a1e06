"""Main text by tag-path ratios: structure, malformed markup, odd tables."""

from __future__ import annotations

import html
import math
import re
import statistics

import numpy as np
import pyarrow.parquet as pq
import pytest

from tracklens.llm import html_extract
from tracklens.llm.html_extract import NEAR, REACH, SHARE, SIGMA, blocks, content_blocks, extract, extract_main_text

PARA = "A sentence with some words, a comma and more. Then another one; and a third."
PAGE = f"""<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{{}}</style><script>var x="<p>no</p>";</script></head>
<body><header><h1>Site name</h1><nav><a href="/">Home</a></nav></header>
<div class="sidebar"><p>{PARA} In the side bar.</p></div>
<article><h1>Title &lt;1&gt;</h1><p>{PARA}<p>{PARA} <b>Bold</b>
 and   <a href="x">link</a>.<ul><li>One item, ok.<li>Two items.</ul><div class="advert">Buy, now. Really!</div>
<section class="comments"><h2>Comments</h2><p>{PARA} I agree.</p></section></article>
<div class="cookie-notice">{PARA}</div><form><p>{PARA}</p></form><footer>&copy; Site</footer></body></html>"""


def test_article_only():
    assert extract(PAGE).split("\n") == [
        "Title <1>", PARA, f"{PARA} Bold and link.", "One item, ok.", "Two items."
    ]


def test_short_article_keeps_its_heading():
    page = "<body><nav><ul><li><a href=a>Menu</a></li></ul></nav><main><h2>Head</h2><p>One line.</p></main></body>"
    assert extract(page) == "Head\nOne line."


def test_words_in_classes():
    page = f'<body><div class="content-with-sidebar"><p>{PARA}</p><p>{PARA}</p></div><footer>x</footer></body>'
    assert extract(page) == f"{PARA}\n{PARA}"  # hardly anything else is on the page
    inner = f'<article><div class="entry-header"><h1>Head</h1></div><p>{PARA}</p><div class="post-comments">{PARA}</div></article>'
    assert extract(inner) == f"Head\n{PARA}"
    comments = f'<div id="a"><p>Short, real.</p></div><div class="comments">{"".join(f"<p>{PARA}</p>" for _ in range(30))}</div>'
    assert extract(comments) == "Short, real."


def test_text_across_sibling_sections():
    lead = "The lead says it all, in short. It has a second sentence, too."
    body = "".join(f"<p>{PARA} {i}.</p>" for i in range(20))
    page = f"""<body><div class=top><a href=/>Home</a></div><div id=post><div class=lead><h2>Lead</h2><p>{lead}</p></div>
<div class=body>{body}</div><div class=end><p>{PARA} At the end.</p></div></div></body>"""
    got = extract(page).split("\n")
    assert got == ["Lead", lead, *(f"{PARA} {i}." for i in range(20)), f"{PARA} At the end."]
    cell = f"<table><tr><td><p>{lead}</p></td></tr><tr><td>{body}</td></tr></table>"
    assert extract(cell).split("\n")[:2] == [lead, f"{PARA} 0."]


def test_linked_lists_that_read_as_text_stay():
    items = "".join(f'<li>Author {i}, A.; Other, B.: <a href="x">A long title of the source, with a subtitle that goes on and on, number {i}</a>, 2019.</li>' for i in range(8))
    page = f"<article><p>{PARA}</p><p>{PARA}</p><h2>Sources</h2><ul>{items}</ul></article>"
    assert extract(page).count("A long title of the source") == 8


def test_odd_markup():
    assert extract('<p>a</p><a "x>b') in ("a", "a\nb")
    assert extract(None) == extract("") == extract("<html></html>") == extract("<!-- never closed") == ""
    assert extract("just text &amp; more") == "just text & more"
    assert extract("<p>a<p>b</div></span>c") == "a\nb\nc"
    assert extract("<p>5 < 6 and <3</p>") == "5 < 6 and <3"
    assert extract("<p>x<br>y&nbsp;z</p>") == "x y z"
    assert extract("<div>" * 20_000 + "deep") == "deep"
    assert len(extract("".join(f"<p>{PARA} {i}.</p>" for i in range(20_000))).split("\n")) == 20_000


def test_pages_table(spark, tmp_path):
    src = "/root/testdata/sf0.001/pages.parquet"
    got = {r.page_id: r for r in extract_main_text(spark.read.parquet(src)).collect()}
    for row in pq.read_table(src).to_pylist():
        body = re.search(r"<article>(.*?)</article>", row["html"], re.S)[1]
        blocks = [html.unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " "))) for b in re.split(r"</?(?:p|h1)>", body)]
        want = "\n".join(" ".join(b.split()) for b in blocks if b.strip())
        r = got[row["page_id"]]
        assert (r.text, r.n_chars, r.url) == (want, len(want), row["url"])


def test_odd_rows(spark):
    kinds = "text string, html string, n_chars string, page_id long, url string"
    rows = [("x", PAGE, "n", 1, "u"), ("x", PAGE, "n", 1, "u"), (None, None, None, None, None), ("y", "", "n", 2, None)]
    got = extract_main_text(spark.createDataFrame(rows, kinds)).collect()
    n = len(extract(PAGE))
    want = [(1, "u", n), (1, "u", n), (2, None, 0), (None, None, 0)]
    assert sorted(((r.page_id, r.url, r.n_chars) for r in got), key=repr) == sorted(want, key=repr)
    empty = extract_main_text(spark.createDataFrame([], kinds))
    assert empty.columns[:4] == ["page_id", "url", "text", "n_chars"] and empty.count() == 0


def test_a_form_around_the_page_is_no_form_of_the_article():
    prose = "".join(f"<p>Sentence number {i}, which says something about the matter, as sentences do.</p>" for i in range(6))
    article = f"<h1>The title</h1>{prose}"
    want = extract(f"<html><body><article>{article}</article></body></html>")
    assert want.startswith("The title") and want.count("\n") == 6
    for inner in (f"<article>{article}</article>", f"<div>{article}</div>"):
        page = f"<body><form id=aspnetForm method=post><input type=hidden value=x>{inner}<button>Send</button></form></body>"
        assert extract(page) == want
    form = "<form action=/reply><p>Your name</p><label>Mail</label><textarea>typed</textarea><p>Your reply, if you want to give one.</p></form>"
    assert extract(f"<body><article>{article}{form}</article></body>") == want
    assert extract("<body><form><p>User</p><label>Password</label></form></body>") == ""


def unmarked(page: str) -> str:
    """The page without anything that tells its parts apart but their paths."""
    page = re.sub(r' (class|id|role)="[^"]*"', "", page)
    return re.sub(r"<(/?)(?:article|main|section|header|aside|nav|footer)>", r"<\1div>", page)


SITE = f"""<body><div class="top"><span>Our site</span></div><nav><ul><li><a href=a>Home</a></li><li><a href=b>About us</a></li></ul></nav>
<div class="ad">Buy this now, please.</div><article><h1>A title of its own</h1>{"".join(f"<p>{PARA} {i}. {PARA}</p>" for i in range(6))}
<p>Short, too.</p></article><div class="ad">Sold.</div><footer>Copyright of us all</footer></body>"""


def test_ratios_select_where_nothing_is_marked(monkeypatch):
    want = extract(SITE)
    assert want.split("\n")[0] == "A title of its own" and want.split("\n")[-1] == "Short, too." and want.count("\n") == 7
    assert extract(unmarked(SITE)) == want
    monkeypatch.setattr(html_extract, "path_ratios", lambda found: np.ones(len(found)))
    assert extract(unmarked(SITE)) != want


def test_unmarked_test_pages():
    pages = [r["html"] for r in pq.read_table("/root/testdata/sf0.01/pages.parquet").to_pylist() if r["html"]]
    same = sum(extract(unmarked(p)) == extract(p) for p in pages)
    assert same >= 0.75 * len(pages)


def plain_content(found) -> list[bool]:
    """The method block by block, without arrays."""
    chains = []
    for node, _, _ in found:
        chain = []
        while node:
            chain.insert(0, node.path)
            node = node.parent
        chains.append(list(dict.fromkeys(chain)))

    def apart(a, b):
        same = 0
        while same < min(len(a), len(b)) and a[same] == b[same]:
            same += 1
        return len(a) + len(b) - 2 * same

    def mean_of(path, value):
        return statistics.fmean(value(b) for b, c in zip(found, chains, strict=True) if c == path)

    def smooth(x):
        out = []
        for i in range(len(x)):
            near = [j for j in range(len(x)) if abs(i - j) <= REACH]
            w = [math.exp(-0.5 * ((i - j) / SIGMA) ** 2) * NEAR ** apart(chains[i], chains[j]) for j in near]
            out.append(sum(a * x[j] for a, j in zip(w, near, strict=True)) / sum(w))
        return out

    chars = [mean_of(c, lambda b: max(0, len(b[1]) - b[2])) for c in chains]
    marks = [mean_of(c, lambda b: len(html_extract.PUNCTUATION.findall(b[1]))) for c in chains]
    fused = [1.0] * len(found)
    for x in (smooth(chars), smooth([a * b for a, b in zip(chars, marks, strict=True)])):
        mean = statistics.fmean(x)
        if mean > 0:
            fused = [f * math.sqrt(v / mean) for f, v in zip(fused, x, strict=True)]
    paths: dict[tuple, list[float]] = {}
    for c, v in zip(chains, fused, strict=True):
        paths.setdefault(tuple(c), []).append(v)
    value = {c: statistics.fmean(v) for c, v in paths.items()}
    limit = SHARE * statistics.pstdev(value.values())
    return [value[tuple(c)] >= limit for c in chains]


@pytest.mark.parametrize("page", [SITE, PAGE, unmarked(SITE), unmarked(PAGE), "<p>one</p>", "<ul><li><a>x</a><li><a>y</a></ul>"])
def test_against_the_plain_method(page):
    found = blocks(page)
    assert content_blocks(found).tolist() == plain_content(found)


def test_names_that_only_begin_like_a_mark():
    for name in "follow-up related-work search-results share-price popular-science notice-board promo-code".split():
        page = f'<body><div class="{name}"><p>{PARA}</p><p>{PARA} Again.</p></div><footer>x</footer></body>'
        assert extract(page) == f"{PARA}\n{PARA} Again.", name
    for name in "comment-list post-comments share-buttons related-posts cookie-banner ad-300x250 commentBody searchBox".split():
        page = f'<body><div id=post><p>{PARA}</p></div><div class="{name}"><p>{PARA} Not this.</p></div></body>'
        assert extract(page) == PARA, name


def test_reference_lists_and_linked_pages():
    items = "".join(f'<li><a href="x">Source number {i}</a></li>' for i in range(8))
    assert extract(f"<article><p>{PARA}</p><p>{PARA}</p><ul>{items}</ul></article>").count("Source number") == 8
    assert "Source" not in extract(f"<body><ul>{items}</ul><div><p>{PARA}</p><p>{PARA}</p></div></body>")
    linked = "".join(f'<p><a href="x">{PARA} {i}.</a></p>' for i in range(5))
    assert extract(f"<article>{linked}</article>").count("\n") == 4


def test_sections_named_by_place():
    page = f'<body><div class="banner"><div class="x"><article><h1>Head</h1><p>{PARA}</p></article></div></div></body>'
    assert extract(page) == f"Head\n{PARA}"
    side = f'<body><div class="x"><p>{PARA}</p><p>{PARA} More.</p></div><div class="sidebar"><p>{PARA} Side.</p></div></body>'
    assert extract(side) == f"{PARA}\n{PARA} More."
    assert extract(f'<article><p>Short, real.</p></article><div class="sidebar">{"".join(f"<p>{PARA}</p>" for _ in range(30))}</div>') == "Short, real."
