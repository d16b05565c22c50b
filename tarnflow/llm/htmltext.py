"""Main text of web pages by two-pass block rules.

A scanner cuts the page into a tree of elements and the text between tags. What a page marks as menu, header, footer,
sidebar, notice, advert, form or reader comments (by element, role, class or id) is left out, unless it holds the main
content: the largest article, main part or part whose class or id says that it is the content, or, where no page part
says so, most of the text. If there are articles, only they count, unless they are but teasers of a much longer
content; or else the smallest part that holds most of what main and content parts hold; or else the whole page. Pass
one classifies each block by length, link density and stop-word density: good, bad, or ambiguous. In pass two an
ambiguous block takes the label of the nearest decided blocks before and after it. If these differ, it is good inside
the content and takes the label of the nearer one, by the characters between, elsewhere; if there are none, it is good
inside the content, and elsewhere where nothing else is.

Null and empty pages, and pages without main text, have an empty text. A page cut off in the middle keeps what comes
before. Tags without an end stop at the next tag, quotes without an end are no quotes. Repeated rows have equal
results, null page_ids stay, an empty table gives no rows, other columns are not read. Nothing is capped: pages of any
length are scanned whole, each character a bounded number of times.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import arrow_rows, pieces, table

#: A tag. No two alternatives begin alike and none gives back what it took, so it ends after one pass, at the latest before the next tag or at the end of the page.
TAG = re.compile(r"<(/?)([a-z][a-z0-9:-]*+)((?:[^<>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)>?+", re.IGNORECASE)
ATTRIBUTE = re.compile(r"([a-z][a-z-]*+)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?+|\"[^\"]*+\"|'[^']*+'", re.IGNORECASE)
_CLASS = re.compile(r"class|id|role|hidden|style|itemprop", re.IGNORECASE)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)

# Elements that part blocks, elements left out, and the words of classes, ids and roles that mark what is left out.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
STRONG = frozenset("nav footer head menu button label select datalist template noscript svg math canvas object audio video".split())
WEAK = frozenset("header aside form dialog fieldset".split())
CLOSED_BY_NEXT = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "td": ("tr", "table"), "th": ("tr", "table"), "tr": ("table",), "option": ("select", "datalist")}
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr",), "option": ("option",)}
BARRIERS = frozenset("table td th caption template object".split())
TABLES = frozenset("table tbody thead tfoot tr td th caption template object".split())
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising banner billboard breadcrumb breadcrumbs byline captcha consent cookie cookies copyright disclaimer foot footer gdpr header hidden login masthead menu menubar modal "
    "nav navbar navigation newsletter notice notices overlay pager paginate pagination paywall popup privacy promo promoted promotion recommended related rss search share sharing sidebar signin signup skip social sponsor sponsored sponsors subscribe subscription "
    "tags teaser toolbar topbar widget widgets".split()
)
READERS = frozenset("comment commentlist comments disqus feedback replies reply respond".split())
STATES = frozenset("has is js no not with without".split())
CONTENT = frozenset("article content entry main post story".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar status".split())
STOP_WORDS = frozenset(
    "a about all also an and are as at be been but by can for from had has have he her his if in into is it its more no not of on one or she so than that the their them there they this to was we were what when which who will with would you your "
    "aber als am an auch auf aus bei bis das dass dem den der des die durch ein eine einem einen einer es für haben hat ich ihr im in ist mit nach nicht noch nur oder sein sich sie sind so über um und uns von vor war wenn wie wir wird zu zum zur "
    "au aux avec ce ces cette comme dans de des du elle en est et il ils je la le les leur lui mais ne nous on ou où par pas plus pour qu que qui sa sans se ses son sont sur tout un une vous "
    "al como con cual de del desde donde el ella en entre era es esta este fue ha hay la las le lo los más me mi muy no nos o para pero por que se ser si sin sobre son su sus también un una y ya".split()
)
#: Of pass one: characters of a short and of a long block, densities of stop words and of links.
SHORT, LONG = 70, 200
STOPS_LOW, STOPS_HIGH = 0.2, 0.3
LINKS = 0.5
#: Articles are teasers if the content parts hold more than so many times their text, or the rest of the page's good blocks do.
TEASER, TEASER_OF_PAGE = 3, 8
#: Kana, Han and Hangul: characters of scripts that take about a third of the characters for the same text.
_WIDE = re.compile(r"[⺀-鿿가-힯豈-﫿\U00020000-\U0003ffff]")
_WORD = re.compile(r"\w(?:\S*\w)?")
_ENDS = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)", re.IGNORECASE) for name in RAW}


@dataclass
class Block:
    text: str
    links: int  # characters within links
    inside: bool  # of the content
    label: str = ""


@dataclass
class Page:
    """Elements in the order of their start, the page itself first; kind: how an element is marked (strong, weak, readers or not at all); content: article, main, content or not at all; texts: (element, link, text), and None wherever blocks part."""

    parent: list[int]
    kind: list[str]
    content: list[str]
    ended: list[bool]  # by a tag of its own
    texts: list[tuple[int, int, str] | None]
    linked: list[bool]  # links that end


def _judged(name: str, attributes: str, in_article: bool) -> tuple[str, str]:
    """How an element is marked, and whether it holds content."""
    kind = "strong" if name in STRONG else "weak" if name in WEAK and not (name == "header" and in_article) else ""
    content = name if name in ("article", "main") else ""
    if name in ("html", "body") or not _CLASS.search(attributes):
        return kind, content
    for m in ATTRIBUTE.finditer(attributes):
        key, value = (m[1] or "").lower(), m[2] or m[3] or m[4] or ""
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and _UNSEEN.search(value):
            kind = kind or "weak"
        elif key == "role":
            if value.lower() == "main":
                content = content or "main"
            elif value.lower() in ROLES:
                kind = kind or "weak"
        elif key == "itemprop" and value.lower() == "articlebody":
            content = content or "content"
        elif key in ("class", "id"):
            for token in value.split():
                parts = [p.lower() for p in _PARTS.findall(token)]
                for before, part in zip(["", *parts], parts, strict=False):
                    if before in STATES:
                        continue
                    if part in READERS:
                        kind = "readers"
                    elif part in MARKS and content != "article" and not (part == "header" and in_article):
                        kind = kind or "weak"
                    elif part in CONTENT and name in ("div", "section", "td"):
                        content = content or "content"
    return kind, content


def parsed(page: str) -> Page:
    out = Page([-1], [""], [""], [False], [], [])
    stack: list[tuple[str, int, int]] = [("", 0, -1)]  # name, element, its link
    open_: dict[str, list[int]] = {}  # name -> places in the stack
    blocks = [0]  # places of elements that part blocks
    barriers = [0]
    endless: set[str] = set()  # of RAW, those without another end tag
    contents = breaks = 0

    def close_to(place: int, ended: bool = False) -> None:
        nonlocal contents
        while len(stack) > place:
            name, element, link = stack.pop()
            open_[name].pop()
            if blocks[-1] == len(stack):
                blocks.pop()
            if barriers[-1] == len(stack):
                barriers.pop()
            contents -= bool(out.content[element])
            if ended and len(stack) == place:
                out.ended[element] = True
                if link >= 0:
                    out.linked[link] = True

    def last(*names: str) -> int:
        return max((open_[n][-1] for n in names if open_.get(n)), default=-1)

    def add(text: str) -> None:
        nonlocal breaks
        if text:
            links = open_.get("a")
            out.texts.append((stack[-1][1], stack[links[-1]][2] if links else -1, unescape(text) if "&" in text else text))
            if not text.isspace():
                breaks = 0

    at, n = 0, len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            add(page[at:])
            break
        if page.startswith("<!--", lt):
            add(page[at:lt])
            end = page.find("-->", lt + 2)
            at = n if end < 0 else end + 3
            continue
        m = TAG.match(page, lt)
        if m is None:
            if page[lt + 1 : lt + 2] in ("!", "?", "/"):
                add(page[at:lt])
                end = page.find(">", lt)
                at = n if end < 0 else end + 1
            else:
                add(page[at : lt + 1])
                at = lt + 1
            continue
        add(page[at:lt])
        at = m.end()
        closing, name, attributes = bool(m[1]), m[2].lower(), m[3]
        if name == "br":
            out.texts.append((stack[-1][1], -1, " "))
            breaks += 1
            if breaks == 2:
                out.texts.append(None)
            continue
        if name in RAW and not closing:
            end = None if name in endless else _ENDS[name].search(page, at)
            if end is not None:
                at = end.start()
            elif name in ("script", "style"):
                break
            else:
                endless.add(name)
            continue
        if name in BLOCKS:
            out.texts.append(None)
            breaks = 0
        if closing:
            places = open_.get(name)
            if places and places[-1] > (blocks[-1] if name not in BLOCKS and name != "a" else barriers[-1] if name not in TABLES else -1):
                close_to(places[-1], ended=True)
            continue
        if name in VOID:
            continue
        if name in BLOCKS:
            if stack[blocks[-1]][0] == "p":
                close_to(blocks[-1])
            if (head := last("head")) >= 0:
                close_to(head)
        if name in CLOSED_BY_NEXT and (mine := last(*CLOSES[name])) > last(*CLOSED_BY_NEXT[name]):
            close_to(mine)
        if name == "a" and (before := last("a")) > blocks[-1]:
            close_to(before, ended=True)
        kind, content = _judged(name, attributes, contents > 0)
        if attributes.endswith("/") and attributes[-2:-1] in ("", " ", '"', "'"):
            continue
        link = -1
        if name == "a":
            if "href" in attributes.lower():
                link = len(out.linked)
                out.linked.append(False)
            elif links := open_.get("a"):
                link = stack[links[-1]][2]
        out.parent.append(stack[-1][1])
        out.kind.append(kind)
        out.content.append(content)
        out.ended.append(False)
        place = len(stack)
        stack.append((name, len(out.parent) - 1, link))
        open_.setdefault(name, []).append(place)
        if name in BLOCKS:
            blocks.append(place)
        if name in BARRIERS:
            barriers.append(place)
        contents += bool(content)
    return out


def _clean(page: Page, prose: list[int]) -> list[int]:
    """Characters of each element without its marked parts."""
    out = prose.copy()
    for i in range(len(out) - 1, 0, -1):
        if not page.kind[i]:
            out[page.parent[i]] += out[i]
    return out


def _below(page: Page, tops: Iterable[int]) -> list[bool]:
    """Whether an element is one of tops or within one."""
    out = [False] * len(page.parent)
    for i in tops:
        out[i] = True
    for i in range(1, len(out)):
        out[i] = out[i] or out[page.parent[i]]
    return out


def _unmark(page: Page, prose: list[int]) -> None:
    """Takes the mark from what holds the main content."""
    n = len(page.parent)
    clean = _clean(page, prose)
    marked = _below(page, [i for i in range(1, n) if page.kind[i]])
    readers = _below(page, [i for i in range(1, n) if page.kind[i] == "readers"])
    parts = [i for i in range(1, n) if page.content[i] and not readers[i] and (page.content[i] != "content" or not page.kind[i])]
    best = max(parts, key=lambda i: (clean[i], -i), default=0)
    if best and clean[best]:
        if TEASER_OF_PAGE * max((clean[i] for i in parts if not marked[i]), default=0) < clean[best]:
            while best > 0:
                page.kind[best], best = "", page.parent[best]
        share = {i: 0.9 for i in parts}
    else:
        share = {0: 0.5}
    whole = prose.copy()
    for i in range(n - 1, 0, -1):
        whole[page.parent[i]] += whole[i]
    # An element that holds so much of the part that it is in is that part, however it is called.
    least = [0.0] * n
    for i in range(n):
        least[i] = share[i] * whole[i] if i in share else least[page.parent[i]] if i else 0.0
        if i and whole[i] and least[i] and whole[i] > least[i] and (page.kind[i] == "weak" or page.kind[i] == "strong" and not page.ended[i]):
            page.kind[i] = ""


def _roots(page: Page, prose: list[int]) -> tuple[list[int], list[int]]:
    """Articles, and what holds the content if they don't."""
    clean = _clean(page, prose)
    dropped = _below(page, [i for i in range(1, len(page.parent)) if page.kind[i]])

    def tops(kinds: tuple[str, ...]) -> list[int]:
        """Parts of the kinds that aren't within another one."""
        found = [i for i in range(1, len(page.parent)) if page.content[i] in kinds and not dropped[i] and clean[i]]
        within = _below(page, found)
        return [i for i in found if not within[page.parent[i]]]

    articles, others = tops(("article",)), tops(("main", "content"))
    most, all_ = max((clean[i] for i in others), default=0), sum(clean[i] for i in others)
    if most >= 0.8 * all_:
        named = [i for i in range(1, len(page.parent)) if page.content[i] in ("main", "content") and not dropped[i] and clean[i] >= 0.8 * most]
        others = [min(named, key=lambda i: (clean[i], -i))] if named else []
    if TEASER * sum(clean[i] for i in articles) < sum(clean[i] for i in others):
        articles = []
    return articles, others


def _blocks(page: Page, roots: list[int]) -> list[Block]:
    dropped, within = _below(page, [i for i in range(1, len(page.parent)) if page.kind[i]]), _below(page, roots)
    out: list[Block] = []
    parts: list[str] = []
    links, inside = 0, False

    def cut() -> None:
        nonlocal parts, links, inside
        if text := " ".join("".join(parts).split()):
            out.append(Block(text, links, inside))
        parts, links, inside = [], 0, False

    for event in page.texts:
        if event is None:
            if parts:
                cut()
            continue
        element, link, text = event
        if not dropped[element]:
            parts.append(text)
            inside = inside or within[element]
            if link >= 0 and page.linked[link]:
                links += len(" ".join(text.split()))
    cut()
    return out


def blocks(html: str) -> list[Block]:
    """The blocks of a page's content, or all that no mark leaves out, in order."""
    page = parsed(html)
    prose = [0] * len(page.parent)
    for event in page.texts:
        if event and (event[1] < 0 or not page.linked[event[1]]):
            prose[event[0]] += len(event[2].strip())
    _unmark(page, prose)
    articles, others = _roots(page, prose)
    if articles:
        found = _blocks(page, articles)
        inside = [b for b in found if b.inside]
        if sum(len(b.text) for b in found if not b.inside and first_pass(b) == "good") <= TEASER_OF_PAGE * sum(len(b.text) for b in inside):
            return inside
    found = _blocks(page, others)
    return [b for b in found if b.inside] if others else found


def first_pass(b: Block, long: int = 0) -> str:
    """With long, stop words don't count: a block of so many characters (wide ones count for three) is good by its link density alone."""
    n = len(b.text)
    density = min(1.0, b.links / n)
    if density > LINKS:
        return "bad"
    if not b.inside and (n < 400 and "©" in b.text):
        return "bad"
    if n < SHORT:
        if not long or n + 2 * len(_WIDE.findall(b.text)) < SHORT:
            return "" if b.inside or not b.links else "bad"
    if long:
        return "good" if n + 2 * len(_WIDE.findall(b.text)) >= long else ""
    words = _WORD.findall(b.text.lower())
    stops = sum(map(STOP_WORDS.__contains__, words)) / max(1, len(words))
    if stops >= STOPS_HIGH and n > LONG:
        return "good"
    if stops >= STOPS_LOW:
        return "good" if b.inside or n > LONG else ""
    return "" if b.inside else "bad"


def second_pass(found: list[Block]) -> None:
    decided = [b.label for b in found]
    none_good = "good" not in decided
    before: list[tuple[str, int]] = []
    label, gap = "", 0
    for b, d in zip(found, decided, strict=True):
        before.append((label, gap))
        label, gap = (d, 0) if d else (label, gap + len(b.text))
    label, gap = "", 0
    for i in range(len(found) - 1, -1, -1):
        b = found[i]
        if decided[i]:
            label, gap = decided[i], 0
            continue
        (left, left_gap), (right, right_gap) = before[i], (label, gap)
        gap += len(b.text)
        if b.inside:
            b.label = "bad" if left == right == "bad" and not none_good else "good"
        elif left and right and left != right and left_gap != right_gap:
            b.label = left if left_gap < right_gap else right
        elif left and right and left != right:
            b.label = "bad"
        else:
            b.label = left or right or ("good" if none_good else "bad")


def extract(page: str | None) -> str:
    if not page:
        return ""
    found = blocks(page)
    for b in found:
        b.label = first_pass(b)
    # The stop words are of four languages. A page of another has no good block: then length and links decide.
    for long in (LONG, SHORT):
        if any(b.inside or b.label == "good" for b in found):
            break
        for b in found:
            b.label = first_pass(b, long)
    second_pass(found)
    return "\n".join(b.text for b in found if b.label == "good")


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of each of pages (page_id, url, html)."""
    arrow_rows(pages.sparkSession)
    kinds = dict(pages.dtypes)

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "html"):
                texts = [extract(h.as_py()) for h in batch.column(2)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(each, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))


QUERIES = {"op5_html_text": op5_html_text}
