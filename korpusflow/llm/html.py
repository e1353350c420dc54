"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags. Pass one looks at each block's stop-word density, length and link density:
a long block of running words is text, a long or serial block of links is not, and short blocks stay undecided. What the
page itself says is evidence beside that: elements for menus, footers, asides and forms, and plain names of adverts and
notices, or of a part with readers' comments, are never text; names of menus outside an article are so too, while in one
they, and names of other tools of a page (sharing, subscription), make short blocks boilerplate and leave running text; names that can mean several things (a header, legal, related) only take
away a block's own claim, so that its neighbours decide. An article's borders keep its blocks' neighbours together, and the
main text is looked for in articles, unless the page has more than twice as much running text outside them: then they are
teasers. Pass two gives each undecided block the label of its nearest decided neighbours in the same region: theirs if both
agree, else that of the side with less text between; a heading goes with what follows. Where no block of a region is text
by itself, the undecided ones are text in an article and not elsewhere.

Text in an element that a browser does not show (scripts, styles, controls, fallbacks of players) is left out without
breaking its sentence; formulas and embedded objects are part of theirs.

Cases: null and empty pages, and pages without main text, give an empty text; unclosed elements end with their parent;
comments, scripts and styles without an end reach to the page's end; unknown character references stay as they are;
very long pages are read whole; repeated rows are extracted alike; equal distances go with the following block; a null
url stays null; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Code points from which a block can decide itself, and without stop words (tables, other languages) even so.
MIN_LONG, MIN_LONG_ALONE = 60, 180
LINKS_AT_MOST, FEW_LINKS = 0.5, 0.2
STOPS_AT_LEAST = 0.08
#: So many linked blocks in a row are a list of links.
LINK_RUN = 3
#: Frequent function words of the languages served.
STOP_WORDS = frozenset("""
the of and to in is it that for was on are as with by this be from at or an not have he his they which you were a but
der die und das den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach
de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec ou son elle
el los las y del se por con no una su para lo como más pero sus al
""".split())  # fmt: skip
#: Elements by their part in a page. Of the unseen ones those with a box leave a gap between words.
UNSEEN = frozenset("script style noscript template title annotation annotation-xml".split())
BOXES = frozenset("textarea select option button svg iframe canvas audio video datalist".split())
CHROME = frozenset("nav footer aside form menu dialog fieldset".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("""
a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img
math mi mn mo ms mtext mrow mfrac msup msub msubsup msqrt mroot mover munder munderover mstyle mpadded semantics object picture ruby rb rt rp output
""".split())  # fmt: skip
#: Words in names that mean boilerplate whatever its text; readers' remarks, if a whole part is named so; parts
#: of a page that hold no running text, so that a block which has it is not one; and words that can mean other things as well.
PLAIN_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|sidebar\w*|footer\w*|cookies?|consent|gdpr|popup|modal|newsletter\w*|login|signup)(?:$|[\s_-])",
    re.I,
)
REMARK_NAMES = re.compile(r"(?:^|[\s_-])(?:comments?|commentlist|disqus|replies)(?:$|[\s_-])", re.I)
TOOL_NAMES = re.compile(r"(?:^|[\s_-])(?:masthead|sharing|social\w*|subscri\w*)(?:$|[\s_-])", re.I)
MENU_NAMES = re.compile(r"(?:^|[\s_-])(?:nav\w*|menu\w*|breadcrumb\w*|toolbar|pagination|pager)(?:$|[\s_-])", re.I)
DOUBTFUL_NAMES = re.compile(r"(?:^|[\s_-])(?:banner|side|foot|header|notices?|overlay|share\w*|related|recommend\w*|respond|reactions|search\w*|widget\w*|copyright|legal|skip)(?:$|[\s_-])", re.I)
MAIN_NAMES = re.compile(r"(?:^|[\s_-])(?:article\w*|post-?(?:body|content|text)|entry-?content|main-?content|story-?body|content-?body)(?:$|[\s_-])", re.I)
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search alert dialog alertdialog menu menubar toolbar form".split())
#: What an element says of its blocks.
CHROME_HERE, TOOLS, DOUBTFUL, NOTHING = 3, 2, 1, 0
#: How many times as much running text outside a page's articles shows that these are not its main part.
MORE_OUTSIDE = 2
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([A-Za-z][^\s/><]*)([^<>]*)>", re.S)
ATTRIBUTE = re.compile(r"""([A-Za-z_:-][\w:.-]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
SPACE = re.compile(r"\s+")
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BREAK = "  "  # this very object: a line break is white space, two in a row end a block
WORD = re.compile(r"[^\W\d_]+")


class Block:
    __slots__ = ("text", "linked", "evidence", "region", "heading", "label")

    def __init__(self, text, linked, evidence, region, heading):
        self.text, self.linked, self.evidence, self.region, self.heading, self.label = text, linked, evidence, region, heading, None


def attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(raw)}


def part_of_page(tag: str, raw: str, inside: bool) -> tuple[int, bool]:
    """What an element says of the blocks in it, and whether it is an article. inside: whether it lies in an article."""
    evidence, article = CHROME_HERE if tag in CHROME else NOTHING, tag in ("article", "main")
    if tag == "header":  # of the page; that of an article has its title
        evidence = DOUBTFUL if inside else CHROME_HERE
    if raw:
        found = attributes(raw)
        names, role = f"{found.get('class', '')} {found.get('id', '')}", found.get("role", "").lower()
        if "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "") or role in BOILER_ROLES:
            return CHROME_HERE, False
        main_name = bool(MAIN_NAMES.search(names))
        if tag not in ("html", "body") and not (article and not inside) and not main_name:
            menu = MENU_NAMES.search(names)
            if PLAIN_NAMES.search(names) or (tag != "p" and REMARK_NAMES.search(names)) or (menu and not inside):
                return CHROME_HERE, False
            if menu or TOOL_NAMES.search(names) or REMARK_NAMES.search(names):
                evidence = max(evidence, TOOLS)
            if DOUBTFUL_NAMES.search(names):
                evidence = max(evidence, DOUBTFUL if inside or tag in HEADINGS else CHROME_HERE)
        article = article or role in ("main", "article") or main_name
    return evidence, article and evidence < CHROME_HERE


def blocks(page: str) -> list[Block]:
    """The page's blocks in order, with white space made single."""
    found: list[Block] = []
    stack: list[tuple[str, int, int]] = []  # tag, evidence, region
    text: list[str] = []
    linked, link_depth, regions = 0, None, 0
    heading = False
    at = 0

    def flush():
        nonlocal linked
        if text:
            whole = SPACE.sub(" ", "".join(text)).strip()
            if whole:
                _, evidence, region = stack[-1] if stack else ("", NOTHING, 0)
                found.append(Block(whole, min(1.0, linked / len(whole)), evidence, region, heading))
        text.clear()
        linked = 0

    def take(raw: str):
        nonlocal linked
        if raw:
            plain = entities.unescape(raw)
            text.append(plain)
            if link_depth is not None:
                linked += len(SPACE.sub(" ", plain))

    for m in TOKEN.finditer(page):
        if m.start() < at:
            continue
        take(page[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        closing, raw = (m[1] if m[2] else m[4]) == "/", (m[3] if m[2] else m[6]) or ""
        if tag == "a":  # a link ends with its element, with the next link, or with what encloses it
            link_depth = None if closing or "href" not in raw.lower() else len(stack)
            continue
        if tag == "br":
            if text and text[-1] is BREAK:
                flush()
            else:
                text.append(BREAK)
            continue
        if tag in UNSEEN or tag in BOXES:
            if not closing and not raw.endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
                at = end.end() if end else len(page)
                if tag in BOXES and text:
                    text.append(" ")
            continue
        if tag in INLINE:
            continue
        flush()
        if closing:
            if any(x[0] == tag for x in stack):
                while stack.pop()[0] != tag:
                    pass
            heading = False
        elif tag not in VOID and not raw.endswith("/"):
            if tag in ("p", "li", "dt", "dd", "tr", "td", "th") and stack and stack[-1][0] == tag:
                stack.pop()  # these end where the next begins
            _, above, region = stack[-1] if stack else ("", NOTHING, 0)
            evidence, article = part_of_page(tag, raw, region > 0)
            if article and not region and above < CHROME_HERE:
                regions += 1
                region = regions
            stack.append((tag, max(above, evidence), region))
            heading = tag in HEADINGS
        if link_depth is not None and len(stack) < link_depth:
            link_depth = None
    if at < len(page):
        rest = page[at:]
        cut = re.search(r"<(?:[A-Za-z/!?]|\Z)", rest)  # a tag that the page's end cuts off
        take(rest[: cut.start()] if cut else rest)
    flush()
    return found


def stop_density(text: str) -> float:
    found = WORD.findall(text.lower())
    return sum(w in STOP_WORDS for w in found) / len(found) if found else 0.0


def is_running(b: Block) -> bool:
    """Whether a block is running text by itself: long, few links, and stop words or more length."""
    if len(b.text) < MIN_LONG or b.linked > LINKS_AT_MOST:
        return False
    return stop_density(b.text) >= STOPS_AT_LEAST or (len(b.text) >= MIN_LONG_ALONE and b.linked < FEW_LINKS)


def own_label(b: Block, links_around: int, outside: bool) -> bool | None:
    """Pass one: what a block is by itself, or None. outside: not in the part of the page that holds its main text."""
    if b.evidence == CHROME_HERE or outside:
        return False
    if b.evidence == TOOLS:  # running text is none of a page's tools
        return is_running(b)
    if b.linked > LINKS_AT_MOST:
        return False if len(b.text) >= MIN_LONG or links_around >= LINK_RUN or not b.region else None
    if b.evidence == DOUBTFUL or len(b.text) < MIN_LONG:
        return None
    if is_running(b):
        return True
    return None if b.region else False


def main_is_outside(found: list[Block]) -> bool:
    """Whether a page's articles are teasers: by the running text of blocks that nothing speaks against, in and outside them."""
    inside = outside = 0
    for b in found:
        if b.evidence == NOTHING and is_running(b):
            inside, outside = inside + len(b.text) * (b.region > 0), outside + len(b.text) * (b.region == 0)
    return outside > MORE_OUTSIDE * inside


def nearest(found: list[Block]) -> list[tuple[bool | None, int]]:
    """For each block the label of the last one before it in its region that its own text decided, and the text between."""
    out, last = [], {}
    for b in found:
        label, gap = last.get(b.region, (None, 0))
        out.append((label, gap))
        if b.evidence < CHROME_HERE:
            last[b.region] = (b.label, 0) if b.label is not None else (label, gap + len(b.text))
    return out


def extract(page: str | None) -> str:
    found = blocks(page or "")
    has_article = any(b.region and b.evidence < CHROME_HERE for b in found)
    teasers = has_article and main_is_outside(found)
    runs = [0] * len(found)
    for i, b in enumerate(found):  # linked blocks in a row, up to here
        runs[i] = (runs[i - 1] if i else 0) + 1 if b.linked > LINKS_AT_MOST else 0
    for i in range(len(found) - 2, -1, -1):  # and in the whole row
        runs[i] = max(runs[i], runs[i + 1]) if runs[i] and runs[i + 1] else runs[i]
    for b, run in zip(found, runs):
        b.label = own_label(b, run, has_article and (b.region > 0) == teasers)
    with_text = {b.region for b in found if b.label}
    before, after = nearest(found), nearest(found[::-1])[::-1]
    for b, left, right in zip(found, before, after):  # pass two; both sides are of pass one
        if b.label is None:
            if b.region not in with_text:
                b.label = b.region > 0 and not teasers
            elif left[0] is None or right[0] is None or left[0] == right[0]:
                b.label = right[0] if left[0] is None else left[0]
            else:
                b.label = right[0] if b.heading or right[1] <= left[1] else left[0]
    return "\n".join(b.text for b in found if b.label)


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text (empty if none) and n_chars of every row."""

    def run(batches):
        for batch in batches:
            texts = [extract(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
