"""Main text of web pages by the maximum-scoring subsequence.

A page becomes a sequence of tags and runs of words. Words score by their context, tags
score below zero, and one linear scan finds the contiguous stretch of the largest sum: the
content region. The region's text blocks, without the elements that are boilerplate by
their name or class, are the main text.

Context weights are the smoothed log-odds of a word lying in the content of labelled
pages. A context is the word's innermost block element and whether a content element
(article, main) is open. Labels are the pages' own content elements that are not furniture:
a bounded sample of ``TRAIN_PAGES`` pages with one, smallest id hash first. Where a page has no
such element, or the text outside outweighs it ``TRUST`` times, words score by the shape of
their block (element, size, links) and tags by their own log-odds, learned from the
same pages with the content elements hidden; shapes never seen back off to size and links.

Defined results: null, empty and text-free pages give an empty text; unclosed and stray
tags are tolerated; an unclosed script, style or comment runs to the end of the page;
repeated rows give equal rows; an empty table gives an empty result; without labelled
pages the fixed weights alone decide. Extra columns are not looked at.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

TRAIN_PAGES = 400
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|</?[a-zA-Z](?:[^<>\"']|\"[^\"]*\"|'[^']*')*>|</?[a-zA-Z][^<>]*>?", re.S)
NAME = re.compile(r"</?([a-zA-Z][a-zA-Z0-9:-]*)")
MARK = re.compile(r"""\b(?:class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
HIDDEN = re.compile(r"""\shidden(?:[\s=>/]|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)

# Element names of HTML and words that name page furniture.
RAW = frozenset("script style noscript template textarea title iframe svg math object canvas".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul caption".split())
CONTENT = frozenset(("article", "main"))
FURNITURE = frozenset("nav aside footer header form head menu button select option dialog label input fieldset".split())
FURNITURE_WORDS = frozenset(
    "ad ads adsbygoogle adslot advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices notification "
    "alert popup modal overlay newsletter subscribe signup sidebar rail menu nav navbar navigation breadcrumb breadcrumbs header masthead footer "
    "comment comments commentlist disqus respond replies reply share sharing social related recommended widget toolbar pagination pager login search "
    "complementary contentinfo dialog form".split())
ARTICLE_WORDS = frozenset("comment comments reply replies respond related recommended promo promotion ad ads advert advertisement sponsored".split())
HEADER_WORDS = frozenset("header masthead".split())
PLACE_WORDS = frozenset(
    "list lists box slot slots bar block blocks container wrapper wrap section area item items link links button buttons post posts articles stories inner "
    "unit panel module zone top bottom left right site page global primary secondary main icons tools text content body row col column group thread "
    "count title heading meta info desktop mobile fixed sticky floating native inline dfp google js the by user reader".split())
TEXT_RAW = frozenset("script style textarea title noscript template iframe".split())
LIST_ENDS = frozenset("ul ol dl table select tbody".split())
P_CLOSERS = BLOCK - {"body", "html", "head"}
TAG_SCORE, WORD_SCORE, FURNITURE_SCORE = -0.1, 1.0, 0.0
MAX_SCORE = 3.0
# Where nothing marks the content: words in links, and tags other than these.
LINK_SCORE, STRUCTURE_SCORE = -1.0, -0.5
PLAIN = frozenset("p br b i em strong span code h1 h2 h3 h4 h5 h6 blockquote pre body html article main".split())
#: Marked content is believed until the words outside score so many times more.
TRUST = 2


def marked_furniture(tag: str, words: frozenset[str], inside: bool) -> bool:
    """Whether a class, id or role names furniture: alone, or joined only with words of place and shape.

    ``related-posts`` and ``site-header`` do, ``related-work`` and ``search-enabled`` do not. Inside of content, a
    header is that of the content.
    """
    for values in MARK.findall(tag) if "=" in tag else ():
        for token in re.sub(r"(?<=[a-z])(?=[A-Z])", "-", "".join(values)).lower().split():
            parts = [x for x in re.split(r"[_-]+", token) if x]
            named = [x for x in parts if x in words and not (inside and x in HEADER_WORDS)]
            if named and all(x in words or x in PLACE_WORDS or x.isdigit() for x in parts):
                return True
    return False


def furniture(name: str, tag: str, inside: bool) -> tuple[bool, bool]:
    """Whether an element is page furniture, and whether by its name alone."""
    if name in FURNITURE:
        return True, True
    if name in ("body", "html", "main"):
        return False, False
    # An article is furniture only as a comment or a teaser of something else.
    if marked_furniture(tag, ARTICLE_WORDS if name == "article" else FURNITURE_WORDS, inside):
        return True, False
    low = tag.lower()
    return ("hidden" in low or "display" in low) and HIDDEN.search(tag) is not None, True


def tokens(page: str) -> tuple[list[tuple], bool]:
    """The page as (kind, value, context, in furniture, in content), and whether it has content elements.

    Kinds: ``text`` (value: raw text), ``block`` (a block boundary), ``tag`` (any other tag). Takes time linear in
    the page: how often a name is open is counted, and the stack is searched from its top.
    """
    out: list[list] = []  # kind, value, innermost block element
    spans: list[list] = []  # element, from, to, furniture, by its name
    open_: list[tuple[str, int]] = []  # element, its place in spans
    blocks: list[str] = []
    count: dict[str, int] = {}
    content = 0
    at = 0

    def push(kind: str, value: str) -> None:
        out.append([kind, value, blocks[-1] if blocks else ""])

    def close(name: str, span: int) -> None:
        nonlocal content
        count[name] -= 1
        content -= name in CONTENT
        if name in BLOCK:
            blocks.pop()
        spans[span][2] = len(out)

    def pop_through(spot: int) -> None:
        while len(open_) > spot:
            close(*open_.pop())

    def above(names: frozenset | tuple, stop: frozenset) -> int:
        """The topmost open element of these names that no element of ``stop`` covers, or -1."""
        if not any(count.get(n) for n in names):
            return -1
        for i in range(len(open_) - 1, -1, -1):
            if open_[i][0] in names:
                return i
            if open_[i][0] in stop:
                return -1
        return -1

    size = len(page)
    while at < size:
        m = TOKEN.search(page, at)
        start = m.start() if m else size
        if start > at:
            push("text", page[at:start])
        if not m:
            break
        at, tag = m.end(), m.group()
        named = NAME.match(tag)
        if not named:
            continue
        name = named.group(1).lower()
        if tag[1] == "/":
            if name in RAW:
                continue
            # An inline end tag does not close the blocks opened inside it.
            spot = above((name,), frozenset() if name in BLOCK else BLOCK)
            if spot >= 0:
                pop_through(spot)
            push("block" if name in BLOCK else "tag", "/" + name)
            continue
        if name in RAW:
            # Of these only text elements run on when they are left open.
            if not (tag.endswith("/>") and name not in TEXT_RAW):
                end = re.compile(rf"</{name}\s*>", re.I).search(page, at)
                at = end.end() if end else size if name in TEXT_RAW else at
            push("tag", name)
            continue
        if name in P_CLOSERS:
            # A block start ends an open paragraph and whatever inline elements it holds.
            spot = above(("p",), BLOCK - {"p"})
            if spot >= 0:
                pop_through(spot)
        if name in ("li", "dt", "dd", "option", "tr"):
            spot = above((name,), LIST_ENDS)
            if spot >= 0:
                pop_through(spot)
        push("block" if name in BLOCK else "tag", name)
        if name not in VOID and not tag.endswith("/>"):
            bad, by_name = furniture(name, tag, content > 0)
            open_.append((name, len(spans)))
            spans.append([name, len(out), size, bad, by_name])
            count[name] = count.get(name, 0) + 1
            content += name in CONTENT
            if name in BLOCK:
                blocks.append(name)
    pop_through(0)
    return placed(out, spans)


def placed(out: list[list], spans: list[list]) -> tuple[list[tuple], bool]:
    """The tokens with what lies in furniture and in content.

    What only calls itself furniture, but holds half of the page's words or content that
    is none, is a wrapper.
    """
    n = len(out)
    words = np.concatenate([[0], np.cumsum([len(t[1].split()) if t[0] == "text" else 0 for t in out])]) if n else np.zeros(1, np.int64)
    marks = np.zeros(n + 1, np.int64)
    for name, a, _, bad, _ in spans:
        marks[a] += name in CONTENT and not bad
    marks = np.append(0, np.cumsum(marks))
    deep = np.zeros(n + 1, np.int64)
    for span in spans:
        name, a, b, bad, by_name = span
        if bad and not by_name and name != "article" and (2 * (words[b] - words[a]) >= words[-1] or marks[b + 1] > marks[a + 1]):
            bad = span[3] = False
        if bad:
            deep[a] += 1
            deep[b] -= 1
    deep = np.cumsum(deep)
    inside = np.zeros(n + 1, np.int64)
    has_content = False
    for name, a, b, bad, _ in spans:
        # A comment or a teaser, or what lies in furniture, marks no content.
        if name in CONTENT and not bad and not deep[a]:
            has_content = True
            inside[a] += 1
            inside[b] -= 1
    inside = np.cumsum(inside)
    return [(k, v, block, bool(d), bool(c)) for (k, v, block), d, c in zip(out, deep.tolist(), inside.tolist())], has_content


def context(block: str, content: bool, has_content: bool) -> str:
    return f"{block}|{int(content)}|{int(has_content)}"


def shapes(seq: list[tuple]) -> list[tuple | None]:
    """Per text its block's element, size class and whether links hold half of its words.

    Content elements are left out, so that pages without them look alike.
    """
    out: list[tuple | None] = [None] * len(seq)
    group: list[int] = []
    words = linked = link = 0
    for i, (kind, value, *_) in enumerate([*seq, ("block", "")]):
        if kind == "text" and (n := len(value.split())):
            group.append(i)
            words += n
            linked += n * link
        elif kind == "tag" and value in ("a", "/a"):
            link = int(value == "a")
        elif kind == "block":
            for k in group:
                out[k] = ("" if seq[k][2] in CONTENT else seq[k][2], min(words.bit_length(), 6), 2 * linked >= words)
            group, words, linked = [], 0, 0
    return out


def shape_weight(weights: dict[str, float], shape: tuple) -> float:
    """Weight of a word by its block's shape, else by size and links alone, else fixed."""
    name, size, links = shape
    return weights.get(f"~{name}|{size}|{links}", weights.get(f"~{size}|{links}", LINK_SCORE if links else WORD_SCORE))


def tag_weight(weights: dict[str, float], name: str) -> float:
    name = name.lstrip("/")
    return weights.get(f"<{name}", TAG_SCORE if name in PLAIN else STRUCTURE_SCORE)


def learn_weights(pages: list[str]) -> dict[str, float]:
    """Log-odds of words being content, per context, from pages that mark their content."""
    inside: dict[str, float] = {}
    total: dict[str, float] = {}

    def count(key: str, n: int, good: bool) -> None:
        total[key] = total.get(key, 0) + n
        inside[key] = inside.get(key, 0) + n * good

    for page in pages:
        seq, has_content = tokens(page)
        if not has_content:
            continue
        for (kind, value, block, bad, content), shape in zip(seq, shapes(seq)):
            good = content and not bad
            if kind != "text":
                if value.lstrip("/") not in CONTENT:
                    count("<" + value.lstrip("/"), 1, good)
            elif shape:
                n, (name, size, links) = len(value.split()), shape
                count(context(block, content, True), n, good)
                count(f"~{size}|{links}", n, good)
                count(f"~{name}|{size}|{links}", n, good)
    odds = {k: float(np.clip(np.log((inside[k] + 1) / (n - inside[k] + 1)), -MAX_SCORE, MAX_SCORE)) for k, n in total.items()}
    # No tag counts for the content.
    return {k: min(w, TAG_SCORE) if k[0] == "<" else w for k, w in odds.items()}


def best_region(scores: list[float]) -> tuple[int, int]:
    """The half-open range of the largest sum; the longest of equals, empty when no sum is positive."""
    best, best_range, run, start = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if run < 0:
            run, start = 0.0, i
        run += s
        if run > best:
            best, best_range = run, (start, i + 1)
    return best_range


def main_text(page: str | None, weights: dict[str, float]) -> str:
    """The main text of a page: its blocks joined by empty lines."""
    if not page:
        return ""
    seq, has_content = tokens(page)
    # By shape alone, as if nothing marked the content.
    plain = [0.0 if not x else shape_weight(weights, x) * len(t[1].split()) for t, x in zip(seq, shapes(seq))]
    if has_content:
        inside, outside = (sum(max(w, 0) for w, t in zip(plain, seq) if not t[3] and t[4] == side) for side in (True, False))
        has_content = outside <= TRUST * inside or not outside
    scores = []
    for (kind, value, block, bad, content), by_shape in zip(seq, plain):
        if bad:
            scores.append(FURNITURE_SCORE)
        elif kind != "text":
            scores.append(TAG_SCORE if has_content else tag_weight(weights, value))
        elif has_content:
            unseen = WORD_SCORE if content else -MAX_SCORE
            scores.append(weights.get(context(block, content, True), unseen) * len(value.split()))
        else:
            scores.append(by_shape)
    a, b = best_region(scores)
    if b > a:
        # The region's edges are widened to the whole blocks they cut.
        while a > 0 and seq[a][0] != "block" and seq[a - 1][0] != "block" and seq[a - 1][4] == seq[a][4]:
            a -= 1
        while b < len(seq) and seq[b][0] != "block" and seq[b][4] == seq[b - 1][4]:
            b += 1
    blocks, now = [], []
    for kind, value, block, bad, content in seq[a:b]:
        if kind == "text":
            if not bad:
                now.append(value)
        elif kind == "block":
            blocks.append("".join(now))
            now = []
        elif value == "br" or value in ("td", "th", "/td", "/th"):
            now.append(" ")
    blocks.append("".join(now))
    clean = (" ".join(html.unescape(x).split()) for x in blocks)
    return "\n\n".join(x for x in clean if x)


def labelled_pages(pages: DataFrame, id_col: str, html_col: str) -> list[str]:
    """The training sample: pages with a content element, smallest id hash first."""
    rank = F.xxhash64(id_col)
    marked = pages.filter(F.col(html_col).rlike("(?i)<(article|main)[ >]"))
    # Only hashes are ranked; the pages are fetched afterwards.
    last = marked.select(rank.alias("h")).orderBy("h").limit(TRAIN_PAGES).agg(F.max("h")).first()[0]
    if last is None:
        return []
    rows = marked.filter(rank <= last).select(rank.alias("h"), html_col).limit(TRAIN_PAGES).collect()
    return [r[1] for r in sorted(rows)]


def extracted(pages: DataFrame, *, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(key, text) with the main text of every page; ``key`` holds the other columns of ``pages``."""
    weights = learn_weights(labelled_pages(pages, id_col, html_col))
    packed = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns if c != html_col]).alias("key"), F.col(html_col).alias("page"))
    kind = packed.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p.as_py(), weights) for p in batch.column("page")]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(texts, pa.string())], names=["key", "text"])

    return packed.mapInArrow(run, f"key {kind}, text string")


def op9_extract_html(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extracted(pages).select("key.page_id", "key.url", "text", F.char_length("text").cast("bigint").alias("n_chars"))
