"""Main text of web pages by tag-path ratios.

Method: a page's text is cut into leaf nodes, each known by its path of tags (with classes and ids) from the root. Text length,
punctuation and length inside links are summed for each path. A path's text ratio (length a node) and punctuation ratio
(marks a node) are smoothed over the paths in page order (a binomial window), so that a heading takes
part in what its article's paragraphs weigh, and fused into one weight by their product. Paths whose weight reaches a share of the
page's mean weight by text are content, unless their text is mostly links. Elements that never hold article text
(scripts, forms, navigation, page headers and footers, asides) and containers named as adverts, notices or reader comments are
cut before. Where a page marks its article, paths in it weigh ARTICLE_WEIGHT times as much and others that many times less; the page's mean
stays that of the plain weights, so marking adds to the decision and doesn't make it.

The content's blocks are joined in page order. Nothing is cut short: a page is one row and is worked on whole.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillflow.llm.common import map_batches

#: A tag behind its "<", with quoted values; and without heed of quotes, once a page has shown that they don't match up.
TAG = re.compile(r"(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>")
PLAIN_TAG = re.compile(r"(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
#: Elements whose content is no markup, with what ends them.
RAW = {t: re.compile(rf"</{t}\s*>", re.I) for t in "script style noscript template textarea title iframe xmp noembed".split()}
ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike "
    "strong sub sup time tt u var wbr".split()
)
#: Elements whose text is never article text.
CUT = frozenset(
    "nav header footer aside form button select option input menu dialog noscript script style template head svg canvas object "
    "audio video map math iframe".split()
)
#: Words of classes, ids and roles that mark a container as no part of the article.
CUT_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr "
    "notice notices alert popup modal overlay nav navbar navigation menu breadcrumb breadcrumbs sidebar aside comment comments "
    "disqus replies reply respond footer header masthead social share sharing newsletter subscribe subscription signup login "
    "related recommended widget toolbar pagination pager skip search searchbox contentinfo complementary form".split()
)
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"},
}
HOLDERS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "tbody": {"table"}}
#: What <article> or <main> around a path adds to its weight.
ARTICLE_WEIGHT = 3.0
MARKS = re.compile(r"[.,;:!?…。、，！？]")
NAME = re.compile(r"[a-z]+")


class Block:
    __slots__ = ("path", "text", "linked", "article", "cut")

    def __init__(self, path: int, text: str, linked: int, article: bool, cut: bool):
        self.path, self.text, self.linked, self.article, self.cut = path, text, linked, article, cut


#: With one of these, a ``header`` is the article's own.
OWN_HEADER = frozenset("article entry post story content section".split())
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def _cut_by_name(token: str) -> bool:
    words = set(NAME.findall(token))
    if "header" in words and words & OWN_HEADER:
        words.discard("header")
    return not CUT_NAMES.isdisjoint(words) or any(w.startswith(("advert", "sponsor")) for w in words)


def _named_away(attributes: str) -> bool:
    for m in ATTRIBUTE.finditer(attributes):
        name = m[1].lower()
        if name in ("hidden",) or name == "aria-hidden" and (m[2] or "").strip("\"'").lower() == "true":
            return True
        if name == "style" and m[2] and HIDDEN.search(m[2]):
            return True
        if name in ("class", "id", "role") and m[2] and any(map(_cut_by_name, m[2].strip("\"'").lower().split())):
            return True
    return False


def _label(tag: str, attributes: str) -> str:
    kept = [m[2].strip("\"'").lower() for m in ATTRIBUTE.finditer(attributes) if m[1].lower() in ("class", "id") and m[2]]
    return ".".join([tag, *kept])


def markup(page: str) -> Iterator[tuple[str, str, str, str]]:
    """The page as (text, "", "", "") and ("", "/" or "", tag, attributes), in one pass: every character is looked at a fixed number of times.

    Comments, declarations and elements without markup are left out. A tag that never ends is text, but for the last one.
    """
    at, end, last = 0, len(page), page.rfind(">")
    tag = TAG
    while at < end:
        i = page.find("<", at)
        if i < 0:
            yield page[at:], "", "", ""
            return
        if i > at:
            yield page[at:i], "", "", ""
        head = page[i + 1 : i + 3]
        if page.startswith("<!--", i):
            j = page.find("-->", i + 4)
            at = end if j < 0 else j + 3
        elif head[:1] in ("!", "?") or head[:1] == "/" and not (head[1:].isascii() and head[1:].isalpha()):
            j = page.find(">", i)
            at = end if j < 0 else j + 1
        elif not (head.lstrip("/")[:1].isascii() and head.lstrip("/")[:1].isalpha()):
            yield "<", "", "", ""
            at = i + 1
        elif i > last:
            if page.find("<", i + 1) < 0:
                return
            yield "<", "", "", ""
            at = i + 1
        else:
            m = tag.match(page, i + 1)
            if m is None:
                tag = PLAIN_TAG
                m = tag.match(page, i + 1)
            at = m.end()
            name = m[2].lower()
            if name in RAW and not m[1]:
                close = RAW[name].search(page, at)
                at = close.end() if close else end
            else:
                yield "", m[1], name, m[3]


def blocks(page: str) -> list[Block]:
    """The page's text blocks in order, with the path that each began in."""
    out: list[Block] = []
    stack: list[tuple[str, int, bool]] = []  # tag, number of its path, whether the element or one around it is cut
    numbers: dict[tuple[int, str], int] = {}  # of paths: (number of the path around it, label)
    parts: list[str] = []
    state = {"linked": 0, "articles": 0, "links": 0, "p": 0}

    def flush() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                path = stack[-1][1] if stack else 0
                out.append(Block(path, text, state["linked"], state["articles"] > 0, bool(stack) and stack[-1][2]))
            parts.clear()
        state["linked"] = 0

    places: defaultdict[str, list[int]] = defaultdict(list)  # of open elements in the stack, by tag
    barriers: list[int] = []  # places of those that no closing inline tag reaches across

    def pop_to(depth: int) -> None:
        while len(stack) > depth:
            tag = stack.pop()[0]
            places[tag].pop()
            if tag not in INLINE:
                barriers.pop()
            state["articles"] -= tag in ("article", "main")
            state["links"] -= tag == "a"
            state["p"] -= tag == "p"

    def innermost(tags: set[str]) -> int:
        return max((places[t][-1] for t in tags if places[t]), default=-1)

    def text(piece: str) -> None:
        parts.append(piece)
        if state["links"]:
            state["linked"] += len(piece)

    def close(tags: set[str], within: set[str]) -> None:
        """Close those of these elements that are open inside the nearest holder."""
        holder = innermost(within)
        while (at := innermost(tags)) > holder:
            pop_to(at)

    for piece, slash, tag, attributes in markup(page):
        if piece:
            text(piece)
            continue
        inline = tag in INLINE
        if not inline:
            flush()
        if slash:
            at = innermost({tag})
            if at >= 0 and not (inline and barriers and barriers[-1] > at):
                pop_to(at)
            continue
        if tag in VOID:
            continue
        if not inline:
            if state["p"]:
                close({"p"}, {"td", "th", "table", "button", "object"})
            if tag in CLOSES:
                close(CLOSES[tag], HOLDERS.get(tag, set()))
        cut = bool(stack) and stack[-1][2] or tag in CUT or tag not in ("html", "body", "article", "main") and _named_away(attributes)
        if cut and tag == "header" and state["articles"] and not (stack and stack[-1][2]) and not _named_away(attributes):
            cut = False  # an article's own header holds its heading
        state["articles"] += tag in ("article", "main")
        state["links"] += tag == "a"
        if attributes.rstrip().endswith("/") and tag not in INLINE and tag in ("svg", "path"):
            continue
        state["p"] += tag == "p"
        path = stack[-1][1] if stack else 0
        if not inline:
            path = numbers.setdefault((path, _label(tag, attributes) if attributes else tag), len(numbers) + 1)
        places[tag].append(len(stack))
        if not inline:
            barriers.append(len(stack))
        stack.append((tag, path, cut))
    flush()
    return out


def main_text(page: str | None, share: float = 0.25, most_linked: float = 0.5) -> str:
    """The page's article; empty for null and empty pages and pages without text."""
    found = [b for b in blocks(page or "") if not b.cut]
    marked = any(b.article for b in found)
    inside: dict[int, bool] = {}
    paths: dict[int, list[float]] = {}
    for b in found:
        total = paths.setdefault(b.path, [0.0, 0.0, 0.0, 0.0])
        inside[b.path] = b.article
        for i, x in enumerate((1, len(b.text), len(MARKS.findall(b.text)), min(b.linked, len(b.text)))):
            total[i] += x
    if not paths:
        return ""
    sums = np.array(list(paths.values()))
    nodes, length, marks, linked = sums.T

    def smooth(x: np.ndarray) -> np.ndarray:
        wide = np.pad(x, 1, mode="edge")
        return (wide[:-2] + 2 * wide[1:-1] + wide[2:]) / 4

    weight = smooth(length / nodes) * (1 + smooth(marks / nodes))
    mean = float((weight * length).sum() / length.sum())
    if marked:
        weight = weight * np.where(list(inside.values()), ARTICLE_WEIGHT, 1 / ARTICLE_WEIGHT)
    content = (linked <= most_linked * length) & (weight >= share * mean)
    keep = {p for p, ok in zip(paths, content) if ok}
    return "\n".join(b.text for b in found if b.path in keep)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) for every row; n_chars counts code points. Null html is empty; repeated rows repeat."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(x) for x in batch.column(2).to_pylist()]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            names=["page_id", "url", "text", "n_chars"],
        )

    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html")
    )
    return map_batches(rows, run, "page_id long, url string, text string, n_chars long")


def op6_query(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
