"""Main text of web pages by the distribution of text over lines of blocks.

Markup is stripped into a line for each block element, in page order. What can't be article text
(scripts, styles, comments, menus, page headers and footers, sidebars, forms, adverts, notices and
reader comments, told by element, role, class or id) leaves its line empty. Where a page marks its article
(article or main, or an element named as such), the lines in it are the text. Any other page is cut by
its distribution: lengths, without what is in links, are summed over windows of WINDOW lines, in which
two boundaries of layout elements between texts make a gap. Text surges where a window rises above SURGE
and dives where it falls to nothing; lines from the first surge, or the heading above it, to the
dive after the last surge are kept. A page without a surge has no long text to tell from others and
keeps all lines but those of links alone.

Edge cases: null or empty html, html without text, and pages of boilerplate alone give the empty
string; unclosed elements end with what holds them; text of any length is one linear pass; repeated rows are
extracted each; null ids and urls stay null; an empty table gives an empty result.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import arrow_map

#: Lines in a window, and the letters above which its sum is a surge.
WINDOW, SURGE = 3, 86

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|template|noscript|textarea|svg|iframe|object|math)\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:=\s*(?:\"[^\"]*\"|'[^']*')|[^>])*+)(?:>|\Z)|<[!?][^>]*+(?:>|\Z)", re.S | re.I)
_ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role|hidden|aria-hidden|style)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
#: Words that tell boilerplate anywhere in a class or id, and such as also name layouts and subjects: those must be the whole class, or follow a word of place.
_NOISE = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|adsense|sponsor(?:ed)?|navbar|navigation|breadcrumbs?|cookies?|gdpr|popup|newsletter|subscribe|"
    r"comments?|comment-list|disqus|pagination|pager)(?=$|[\s_-])"
    r"|(?:^|\s)(?:(?:site|global|main|top|bottom|left|right|primary|secondary|page|blog)[_-])?(?:nav|menu|sidebar|aside|widget|footer|header|masthead|banner|promo(?:tion)?|consent|notice|modal|share|sharing|social|related|"
    r"recommended|respond|replies|login|signup|search|toolbar|skip|copyright|legal)"
    r"(?:[_-](?:links?|buttons?|icons?|posts|articles|form|box|bar|menu|nav|area|widgets?|list|items?))?(?=$|\s)",
    re.I,
)
_READERS = re.compile(r"(?:(?:user|reader|post|site|blog)[_-])?comments?(?:[_-](?:list|area|section|thread))?|disqus(?:[_-]thread)?|respond|replies", re.I)
#: Words that tell boilerplate around an article, and text in one.
_ONLY_OUTSIDE = re.compile(r"legal", re.I)
_NOISE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu", "menubar"}
_DROPPED = {"nav", "header", "footer", "aside", "form", "button", "select", "dialog", "menu", "head", "title", "label", "input", "option", "audio", "video", "canvas", "figure-ad"}
_VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr", "param"}
_BLOCKS = set(
    "address article blockquote body caption center dd details dir div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 hgroup hr html li main ol p pre section summary table tbody td tfoot th thead tr ul".split()
) | _DROPPED
#: Blocks that lay out a page; between others (paragraphs, lists, cells) text isn't parted.
_LAYOUT = {"address", "body", "center", "details", "dir", "div", "fieldset", "figure", "hr", "html", "main", "article", "section"} | _DROPPED
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
_SPACE = re.compile(r"\s+")
#: Elements that a start of the same kind, or a block, ends.
_CLOSES_ITSELF = {"p", "li", "dt", "dd", "tr", "td", "th", "option"}


def _named(name: str, attributes: str, inside: bool) -> tuple[bool, bool, str]:
    """Whether an element is noise, whether it is marked as the article, and the class and id if only they
    say that it is noise; inside: in an article."""
    found = {k.lower(): v.strip("\"'") for k, v in _ATTRIBUTE.findall(attributes)} if attributes else {}
    role = found.get("role", "").lower()
    names = f"{found.get('class', '')} {found.get('id', '')}"
    article = name in ("article", "main") or role in ("article", "main") or "articlebody" in names.lower()
    noise = name in _DROPPED or role in _NOISE_ROLES or "hidden" in attributes.lower().split() or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "").lower()
    told = not noise and not article and name not in ("body", "html") and _NOISE.search(_ONLY_OUTSIDE.sub("", names) if inside else names)
    return noise, article, names if told else ""


class Line(NamedTuple):
    text: str  # empty for boilerplate
    inside: bool  # a marked article
    own: int  # letters that aren't in links
    heading: str  # the heading element that it stands in, or nothing
    gap: bool  # ended by the boundary of a layout element
    named: int  # the innermost element that its class or id tells as noise, or -1
    home: int  # the same of the article that it stands in


def lines(page: str) -> list[Line]:
    """The text of each block in page order."""
    out: list[Line] = []
    open_: list[tuple[str, bool, bool, bool]] = []  # name, noise, article, named
    named: list[tuple[int, str]] = []  # of elements that class or id tell as noise: the one around, the names
    within, homes = [-1], [-1]  # open ones of them, and where the open articles stand
    headings: list[str] = []  # open ones
    opened: Counter[str] = Counter()
    blocks: list[int] = []  # where open_ has blocks
    noise = article = links = linked = size = 0
    held: list[str] = []

    def hold(text: str) -> None:
        nonlocal linked, size
        held.append(text)
        n = len(text.strip())
        linked, size = linked + (n if links else 0), size + n

    def end_block(by: str = "") -> None:
        nonlocal linked, size
        text = _SPACE.sub(" ", html.unescape("".join(held))).strip() if held else ""
        # Outside a marked article, a line of links alone is a menu.
        text = "" if not article and linked and linked == size else text
        heading = headings[0] if text and headings else ""
        out.append(Line(text, article > 0, max(0, len(text) - linked), heading, by in _LAYOUT, within[-1], homes[-1]))
        held.clear()
        linked = size = 0

    def shut() -> None:
        nonlocal noise, article, links
        if open_[-1][3]:
            if held:
                end_block()
            within.pop()
        name, n, a, _ = open_.pop()
        opened[name] -= 1
        if name in _BLOCKS:
            blocks.pop()
        if name in _HEADINGS:
            headings.pop()
        if a:
            homes.pop()
        noise, article, links = noise - n, article - a, links - (name == "a")

    def close(kind: str) -> None:
        """Ends an open element of kind, unless something that holds blocks stands between."""
        if blocks and open_[blocks[-1]][0] == kind:
            for _ in range(len(open_) - blocks[-1]):
                shut()

    last = 0
    for m in _TOKEN.finditer(page):
        if m.start() > last and not noise:
            hold(page[last : m.start()])
        last = m.end()
        name = m.group(3)
        if not name:
            continue
        name = name.lower()
        if m.group(2):
            if opened[name]:
                if name in _BLOCKS:
                    end_block(name)
                while True:
                    top = open_[-1][0]
                    shut()
                    if top == name:
                        break
            continue
        if name == "br":
            if not noise:
                held.append(" ")
            continue
        if name in _BLOCKS:
            end_block(name)
            close("p")
            if name in _CLOSES_ITSELF and name != "p":
                close(name)
        if name in _VOID or m.group(4).endswith("/"):
            continue
        is_noise, is_article, names = _named(name, m.group(4), article > 0)
        if name in _DROPPED or is_noise or names:
            if name not in _BLOCKS:
                end_block()
        opened[name] += 1
        if name in _BLOCKS:
            blocks.append(len(open_))
        if name in _HEADINGS:
            headings.append(name)
        open_.append((name, is_noise, is_article, bool(names)))
        if names:
            named.append((within[-1], names))
            within.append(len(named) - 1)
        if is_article:
            homes.append(within[-1])
        noise, article, links = noise + is_noise, article + is_article, links + (name == "a")
    if last < len(page) and not noise:
        hold(page[last:])
    end_block()
    return _without_named(out, named) if named else out


def _without_named(rows: list[Line], named: list[tuple[int, str]]) -> list[Line]:
    """rows with empty lines for the elements that class or id tell as noise. One that holds most of the
    page's text, or a marked article, is no noise; but where there is an article outside them, those
    of reader comments, and those whose whole class is such a word (related, sidebar), stay noise with theirs."""
    n = len(named)
    own, marked, free, total = [0] * n, [0] * n, 0, 0
    for x in rows:
        total += x.own
        if x.named >= 0:
            own[x.named] += x.own
        if x.inside and x.text and x.home == x.named:
            if x.home < 0:
                free += len(x.text)
            else:
                marked[x.home] += len(x.text)
    direct = list(marked)
    for k in range(n - 1, -1, -1):  # what stands around comes first
        if (up := named[k][0]) >= 0:
            own[up] += own[k]
            marked[up] += marked[k]
    readers = [any(map(_READERS.fullmatch, names.split())) for _, names in named]
    whole = [any(map(_NOISE.fullmatch, names.split())) for _, names in named]
    stays = [not readers[k] and (own[k] > SURGE and 2 * own[k] > total or marked[k] > 0 and not whole[k]) for k in range(n)]

    def walls() -> list[int]:
        """How many elements around each one, itself included, are noise."""
        out: list[int] = []
        for k, (up, _) in enumerate(named):
            out.append((out[up] if up >= 0 else 0) + (not stays[k]))
        return out

    around = walls()
    least = 0 if free else min((around[k] for k in range(n) if direct[k]), default=0)
    if least:  # no article is outside of noise: the outermost are let through
        stays = [stays[k] or marked[k] > 0 and around[k] <= least for k in range(n)]
        around = walls()
    return [x if x.named < 0 or not around[x.named] else x._replace(text="", own=0, heading="") for x in rows]


def stretches(sizes: list[int], window: int = WINDOW, surge: int = 0) -> list[tuple[int, int]]:
    """[start, end) of the lines between each surge and its dive."""
    sums, total = [], 0
    for i, n in enumerate(sizes):
        total += n - (sizes[i - window] if i >= window else 0)
        sums.append(total)
    found, start = [], None
    for i, x in enumerate(sums):
        if x > surge and start is None:
            start = i
        elif x <= surge and start is not None:
            found.append((start, i))
            start = None
    if start is not None:
        found.append((start, len(sizes)))
    return found


def body(blocks: list[Line]) -> list[Line]:
    """The lines of a page without a marked article from its first surge to the dive after its last one."""
    at, sizes = [], []  # the block of each place of the distribution
    for k, x in enumerate(blocks):
        if x.text:
            at.append(k)
            sizes.append(x.own)
        if x.gap:
            at += [k] * (WINDOW - 1)
            sizes += [0] * (WINDOW - 1)
    surges = stretches(sizes, WINDOW, SURGE)
    if not surges:
        return blocks
    start = at[max(0, surges[0][0] - WINDOW + 1)]
    dive = next(b for a, b in stretches(sizes) if a <= surges[-1][0] < b)
    end = at[dive - 1] + 1
    # The heading above: the nearest h1, or else the nearest headings that stand together.
    above = [k for k in range(start + 1) if blocks[k].heading]
    first = max((k for k in above if blocks[k].heading == "h1"), default=None)
    if first is None and above:
        for k in range(above[-1], -1, -1):
            if blocks[k].text and not blocks[k].heading:
                break
            first = k
    return blocks[start if first is None else min(start, first) : end]


def main_text(page: str | None) -> str:
    if not page:
        return ""
    blocks = lines(page)
    inside = [x for x in blocks if x.inside and x.text]
    return "\n\n".join(x.text for x in inside or body(blocks) if x.text)


def _batch(b: pa.RecordBatch) -> pa.RecordBatch:
    texts = [main_text(x) for x in b.column("html").to_pylist()]
    return pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages (page_id, url, html)."""
    return arrow_map(pages.select("page_id", F.col("url").cast("string"), "html"), _batch, "page_id long, url string, text string, n_chars long")
