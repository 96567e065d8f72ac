"""Main text of HTML pages by tree scoring.

A page becomes a tree (start tags close what HTML lets them close, end tags
without a start are ignored). Parts that never belong to an article (scripts,
navigation, footers, forms, adverts, notices, reader comments and the like,
by element or role) are cut. Class and id names only cut where they are names of such a
part as a whole and it isn't the text: a name made of such words alone, or that ends in one (``comments``,
``cookie-notice``), unless the part holds an article or main element; one of such words and
words for a box or a list (``related-posts``), unless it holds those or half of the page's paragraph
points; parts that are mostly links are cut in both cases, and where a name has such a word among others
(``related-work``) only those are. Names that also are titles (``discussion``, ``social-comment``) count as the
second kind, if the points come from paragraphs of the part itself and it holds no part with such a name. Where nothing would
be left, names cut nothing. A form is cut unless it holds an article or main element or half of the paragraph
points (pages of some servers are one form); labels and legends in a form always are. Lists of links are cut as menus, but
not inside an article, or the main element of a page without one. Every paragraph then scores 1 (a ``p``, ``pre``,
``blockquote`` or ``dd`` of under 25 characters its part of that), plus 1 for
each comma and for each 100 characters (3 at most), and passes that to its
parent, half to its grandparent, a third, a fourth and a fifth further up. An
ancestor's score is discounted by its link density; the best one, widened to
the article or main element around it, is the container. Its siblings are
kept where they score at least a fifth of it, are paragraphs of prose or, beside a section, sections with
a title and text.

Parsing takes time in proportion to the page: the ends of tags are looked up
in a list of quotes and angles made once, and the depths of open elements are kept by name, so
neither open quotes nor deep nests are searched again and again.

Blocks are the runs of text between block elements, in page order, with
character references decoded and white space turned into single spaces.

Defined cases: null html and a page without text give an empty text; a page
without paragraphs keeps all that was not cut; unclosed tags end with the
page; quotes that never end don't swallow the page; rows are treated one by
one, so repeated rows repeat; extra columns are kept, and replaced if they are
called ``text`` or ``n_chars``; an empty table gives no rows.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coexnet.llm.common import table, text_slices

NAME = re.compile(r"(/?)([a-zA-Z][^\s/<>]*)")
COMMENT_END = re.compile("--!?>")
SPECIAL, ANGLE = re.compile("[\"'>]"), re.compile("[<>]")
ATTR = re.compile(r"""(?<![\w-])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=[\s/"']|\Z)""", re.I | re.S)

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template svg".split())
CUT = frozenset("head nav footer aside annotation annotation-xml button select option datalist dialog menu object canvas audio video".split()) | RAW
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
PARAGRAPH = frozenset("p pre blockquote td dd li div section article main body".split())
CLOSES_P = BLOCK - frozenset("body html tbody td tfoot th thead tr caption legend dd dt".split()) | {"dd", "dt"}
#: An open element of the first kind ends where one of the second kind starts, up to an element of the third.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tr", "td", "th", "thead", "tbody"}, {"table"}), "tfoot": ({"tr", "td", "th", "thead", "tbody"}, {"table"}), "option": ({"option"}, {"select"}), "body": ({"head"}, {"html"}),
}
ROLES = frozenset("navigation banner contentinfo complementary search alert dialog alertdialog menu menubar form status".split())
WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adslot adsense sponsor sponsored sponsors promo promoted promotion banner cookie cookies consent gdpr notice notices alert disclaimer popup modal overlay comment comments commentlist disqus discussion replies reply respond sidebar aside widget menu nav navbar navigation breadcrumb breadcrumbs footer masthead topbar toolbar share sharing social related recommended newsletter subscribe subscription signup login search pagination pager skip hidden tags tagcloud taglist toc".split()
)
HEADER_WORDS = frozenset(("header", "siteheader", "pageheader"))
#: Of an article or main element only these say that it isn't the text itself.
INNER = frozenset("comment comments reply replies ad ads advert advertisement sponsored promo related recommended".split())
#: Names that end in these among other words are names of layouts.
WHOLE = frozenset("hidden sidebar widget share sharing social skip".split())
#: Names that end in these may be titles of a text, unless they say whose comment it is.
TITLES, WHOSE = frozenset(("discussion", "comment")), frozenset("user users reader readers guest visitor customer".split())
#: Words for boxes and lists, which add nothing to what a name says.
BOXES = frozenset("area articles bar block body box bottom button buttons col column container content entries feed form group head heading holder icons inner items left links list main media module outer page panel post posts right row section site slot stories thread top unit wrap wrapper zone".split())
#: A name with one of these says what a part has, not what it is.
TELLS = frozenset("has no not with without show allow enabled disabled open closed".split())
HARD, IS, LIKELY, TITLE, MENTIONS = 5, 4, 3, 2, 1
SHARE, DENSE, SIBLING = 0.5, 0.5, 0.2
COMMAS = re.compile("[,،、，﹐﹑]")
PIECES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


def _named(names: set[str], words: frozenset[str]) -> int:
    """IS, LIKELY, TITLE, MENTIONS or 0: whether one of the names says that a part is, may be, may be called or has to do with, one of the words."""
    level = 0
    for name in names:
        pieces = [w.lower() for w in PIECES.findall(name)]
        if words.isdisjoint(pieces) or not TELLS.isdisjoint(pieces):
            continue
        if pieces[-1] in TITLES and pieces != ["comment"] and WHOSE.isdisjoint(pieces):
            level = max(level, TITLE)
            continue
        if all(w in words for w in pieces) or pieces[-1] in words - WHOLE:
            return IS
        level = max(level, LIKELY if all(w in words or w in BOXES for w in pieces) else MENTIONS)
    return level


def _cut(tag: str, attrs: str, in_article: bool, in_form: bool) -> int:
    """HARD, IS, LIKELY, TITLE, MENTIONS or 0."""
    if tag in CUT or in_form and tag in ("label", "legend"):
        return HARD
    if tag == "header" and not in_article:
        return HARD
    if not attrs:
        return 0
    names: set[str] = set()
    for m in ATTR.finditer(attrs):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "role" and value.strip().lower() in ROLES and tag not in ("html", "body", "main", "article") and (tag, value.strip().lower()) != ("form", "form"):
            return HARD
        if name == "hidden" or name == "aria-hidden" and value.strip().lower() == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return HARD if tag not in ("html", "body") else 0
        if name in ("class", "id"):
            names.update(value.split())
    if tag in ("html", "body"):
        return 0
    if tag in ("article", "main"):
        return _named(names, INNER)
    return _named(names, WORDS if in_article else WORDS | HEADER_WORDS)


def tokens(page: str):
    """(start, end, closing, name, attributes) of the page's tags and, with a name of None, of its comments and declarations."""
    marks = [m.start() for m in SPECIAL.finditer(page)]
    never: set[int] = set()  # quotes from which no tag's end is reached
    last = {q: page.rfind(q) for q in "\"'>"}

    def tag_end(at: int) -> int:
        met = []
        k = bisect_left(marks, at)
        while k < len(marks) and marks[k] not in never:
            at = marks[k]
            if page[at] == ">":
                return at
            met.append(at)
            if last[page[at]] <= at:
                break
            k = bisect_left(marks, page.find(page[at], at + 1) + 1)
        never.update(met)
        return -1

    at = page.find("<")
    while 0 <= at < last[">"]:
        m = NAME.match(page, at + 1)
        if m:
            end = tag_end(m.end())
            if end < 0:  # a quote that never ends is an attribute's text
                angle = ANGLE.search(page, m.end())
                end = angle.start() if angle and angle[0] == ">" else -1
            if end >= 0:
                after = yield at, end + 1, bool(m[1]), m[2].lower(), page[m.end() : end]
                at = page.find("<", max(end + 1, after or 0))
                continue
        elif page.startswith("!--", at + 1):
            m = COMMENT_END.search(page, at + 4)
            end = m.end() if m else len(page)
            yield at, end, False, None, ""
            at = page.find("<", end)
            continue
        elif page[at + 1] in "!?/":
            end = page.find(">", at) + 1
            yield at, end, False, None, ""
            at = page.find("<", end)
            continue
        at = page.find("<", at + 1)
    if at >= 0 and (at := page.find("<!--", at)) >= 0:
        yield at, len(page), False, None, ""


def parse(page: str) -> tuple[list[str], list[int], list[bool], list[int], list[tuple[int, str | None]]]:
    """(tags, parents, cut, named, events) of a page; an event is (node, text), or (node, None) at a block's edge."""
    tags, parents, cut, named, inside = ["#root"], [-1], [False], [0], [False]
    in_form = [False]
    events: list[tuple[int, str | None]] = []
    stack, at = [0], 0
    depths: dict[str, list[int]] = {}  # where the open elements of a name are in the stack

    def depth(*names: str) -> int:
        return max((depths[n][-1] for n in names if depths.get(n)), default=0)

    def pop(to: int) -> bool:
        """Closes the elements from depth ``to`` on; was a block among them?"""
        block = False
        while len(stack) > to:
            name = tags[stack.pop()]
            depths[name].pop()
            block = block or name in BLOCK
        return block

    source = tokens(page)
    token = next(source, None)
    while token:
        start, end, close, tag, attrs = token
        if start > at:
            events.append((stack[-1], page[at:start]))
        at, skip = end, None
        if tag is None:
            pass
        elif close:
            k = depth(tag)
            if tag == "br" or tag == "p" and not k:
                events.append((stack[-1], None if tag == "p" else " "))
            elif k and (tag in BLOCK or k > depth("table", "body")):
                node = stack[k]
                if pop(k):
                    events.append((node, None))
        elif tag == "br":
            events.append((stack[-1], " "))
        else:
            if tag in CLOSES_P and (k := depth("p")) > depth("td", "th", "table", "button"):
                pop(k)
            if tag in ENDS:
                ends, stop = ENDS[tag]
                low = depth(*stop)
                while (k := depth(*ends)) > low:
                    pop(k)
                    if tag not in ("tr", "tbody", "tfoot"):
                        break
            up, node = stack[-1], len(tags)
            tags.append(tag)
            parents.append(up)
            inside.append(inside[up] or tag in ("article", "main"))
            in_form.append(in_form[up] or tag == "form")
            level = HARD if cut[up] else _cut(tag, attrs, inside[up], in_form[up])
            cut.append(level == HARD)
            named.append(0 if level == HARD else level)
            if tag in BLOCK:
                events.append((node, None))
            if tag in VOID or attrs.endswith("/") and (tag in ("svg", "math") or depths.get("math")):
                pass
            elif tag in RAW:
                shut = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(page, at)
                at = skip = shut.end() if shut else len(page)
            else:
                depths.setdefault(tag, []).append(len(stack))
                stack.append(node)
        try:
            token = source.send(skip)
        except StopIteration:
            token = None
    if at < len(page):
        events.append((stack[-1], page[at:]))
    return tags, parents, cut, named, events


def _measure(tags, parents, cut, block, linked, texts):
    """(cut, own, gains, points, size, links, density) of the nodes; lists of links outside the article join ``cut``."""
    n, cut = len(tags), cut[:]
    own, commas, size, links, n_links = [0] * n, [0] * n, [0] * n, [0] * n, [0] * n
    for i, t in texts:
        if t is not None and not cut[i]:
            length = len(" ".join(t.split()))
            own[block[i]] += length
            commas[block[i]] += len(COMMAS.findall(t))
            size[i] += length
            links[i] += length if linked[i] else 0
    for i in range(n - 1, 0, -1):
        n_links[i] += tags[i] == "a"
        for x in (size, links, n_links):
            x[parents[i]] += x[i]
    article, within = "article" if any(t == "article" and not c for t, c in zip(tags, cut)) else "main", [False] * n
    for i in range(1, n):  # lists of links elsewhere are menus, whatever they are called
        within[i] = within[parents[i]] or tags[i] == article
        if not cut[i]:
            cut[i] = cut[parents[i]] or not within[i] and tags[i] in ("ul", "ol", "table", "div", "dl") and n_links[i] >= 3 and links[i] > 0.8 * size[i]
    density = [links[i] / size[i] if size[i] else 0.0 for i in range(n)]
    points, gains = [0.0] * n, [0.0] * n
    for i in range(1, n):
        if (own[i] >= 25 and tags[i] in PARAGRAPH or own[i] and tags[i] in ("p", "pre", "blockquote", "dd")) and not cut[i]:
            gain, up = (min(own[i] / 25, 1) + commas[i] + min(own[i] // 100, 3)) * (1 - density[i]), parents[i]
            gains[i] = gain
            if tags[i] in ("div", "section", "article", "main", "body"):
                up = i
            for share in (1, 2, 3, 4, 5):
                if up < 0:
                    break
                points[up] += gain / share
                up = parents[up]
    return cut, own, gains, points, size, links, density


def _totals(tags, parents, cut, named, gains) -> tuple[list[float], list[bool]]:
    """Paragraph points below each node, and whether it holds an article or main element."""
    total, holds = gains[:], [False] * len(tags)
    for i in range(len(tags) - 1, 0, -1):
        total[parents[i]] += total[i]
        if holds[i] or tags[i] in ("article", "main") and not cut[i] and named[i] == 0:
            holds[parents[i]] = True
    return total, holds


def _cut_forms(tags, parents, cut, named, gains) -> list[bool]:
    """``cut`` with the forms that are not the page itself."""
    total, holds = _totals(tags, parents, cut, named, gains)
    out = cut[:]
    for i in range(1, len(tags)):
        out[i] = cut[i] or out[parents[i]] or tags[i] == "form" and not holds[i] and not (total[i] > 0 and total[i] >= SHARE * total[0])
    return out


def _cut_named(tags, parents, cut, named, gains, size, density) -> list[bool]:
    """``cut`` with the parts that their names cut."""
    n = len(tags)
    total, holds = _totals(tags, parents, cut, named, gains)
    direct, thread = [0.0] * n, [False] * n
    for i in range(n - 1, 0, -1):
        if tags[i] in ("p", "pre", "blockquote"):
            direct[parents[i]] += gains[i]
        thread[parents[i]] = thread[parents[i]] or thread[i] or named[i] > MENTIONS
    if total[0] <= 0:
        total = size
    out = cut[:]
    for i in range(1, n):
        likely = named[i] == LIKELY or named[i] == TITLE and not thread[i] and direct[i] > SHARE * total[i]
        text = named[i] == MENTIONS or holds[i] or likely and total[i] > 0 and total[i] >= SHARE * total[0]
        out[i] = cut[i] or out[parents[i]] or named[i] > 0 and (not text or density[i] > DENSE)
    return out


def main_text(page: str | None) -> str:
    """The blocks of the page's article joined by empty lines."""
    if not page:
        return ""
    tags, parents, cut, named, events = parse(page)
    n = len(tags)
    decode = lambda s: entities.unescape(s) if "&" in s else s
    texts = [(i, t if t is None or cut[i] else decode(t)) for i, t in events]
    block, linked = list(range(n)), [False] * n
    for i in range(1, n):
        block[i] = i if tags[i] in BLOCK else block[parents[i]]
        linked[i] = tags[i] == "a" or linked[parents[i]]
    cut, own, gains, points, size, links, density = _measure(tags, parents, cut, block, linked, texts)
    if "form" in tags:
        cut, own, gains, points, size, links, density = _measure(tags, parents, _cut_forms(tags, parents, cut, named, gains), block, linked, texts)
    if any(named):
        part = _measure(tags, parents, _cut_named(tags, parents, cut, named, gains, size, density), block, linked, texts)
        if part[4][0]:
            cut, own, _, points, _, links, density = part
    rank = [points[i] * (1 - density[i]) for i in range(n)]
    best = max(range(n), key=lambda i: (rank[i], -i))
    keep = [False] * n
    if rank[best] <= 0:
        keep[0] = True
    else:
        top, around = best, best
        while around > 0:
            if tags[around] in ("article", "main"):
                top = around
                if tags[around] == "article":
                    break
            around = parents[around]
        keep[top] = True
        whole = tags[top] in ("article", "main")  # what stands beside one has to be prose by its length
        titled = {parents[i] for i in range(1, n) if tags[i] in ("h1", "h2", "h3", "h4", "h5", "h6") and not cut[i] and not links[i]}
        for i in range(1, n):
            if parents[i] == parents[top] and i != top and not cut[i]:
                prose = tags[i] == "p" and (own[i] > 80 and density[i] < 0.25 or not whole and own[i] > 0 and not links[i])
                title = tags[i] in ("h1", "h2", "h3") and i < top and not links[i]
                section = tags[i] == tags[top] == "section" and i in titled and rank[i] > 0 and density[i] < 0.25
                keep[i] = rank[i] > 0 and rank[i] >= SIBLING * rank[best] or prose or title or section
    for i in range(1, n):
        keep[i] = keep[i] or keep[parents[i]]
    blocks, part, last = [], [], -1
    for i, t in texts:
        if t is None or block[i] != last:
            if part and (s := " ".join("".join(part).split())):
                blocks.append(s)
            part, last = [], block[i]
        if t is not None and keep[i] and not cut[i]:
            part.append(t)
    if part and (s := " ".join("".join(part).split())):
        blocks.append(s)
    return "\n\n".join(blocks)


def extract_main_text(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``pages`` with ``text`` and ``n_chars`` (code points) in place of the html."""
    rest = [c for c in pages.columns if c not in (html_col, "text", "n_chars")]
    schema = T.StructType([pages.schema[c] for c in rest] + [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches):
        for b in text_slices(batches, html_col, 8 << 20):
            texts = [main_text(x) for x in b.column(html_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in rest] + [pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=[*rest, "text", "n_chars"])

    return pages.select(*(F.col(f"`{c}`") for c in [*rest, html_col])).mapInArrow(run, schema)


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    return extract_main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
