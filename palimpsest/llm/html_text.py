"""Main text of web pages by tree scoring.

The page is read into a tree of elements in one pass, forgiving what isn't closed.  Every block of text gives points for itself,
its commas and its length to the elements above it, in full to the nearest container and less to those further up; a container's
points are discounted by the share of its text that lies in links.  The best container says where the text is: in an article or
main, the outermost one is kept whole, with other articles and those siblings that score well too; else all of the page is kept but
containers elsewhere whose text is mostly links.  Menus, forms, notices and the like are left out wherever they stand, by their tag,
role or name, and so are lists of nothing but short links; but a name (``social-history``, ``content-sidebar-wrap``) doesn't count
against an element that holds most of the page's text, unless it is that of reader comments.

Every step goes over the page, or its tree, once: the time is linear in the length of the page, however deep it nests.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements by what they are.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript iframe noframes xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
DROPPED = RAW | frozenset("head nav footer aside form button select option optgroup datalist template svg math object applet canvas audio video map menu dialog fieldset label input".split())
SCOPE = frozenset("table td th caption button article section main body html".split())
#: Starting the one closes an open other, as long as nothing in SCOPE stands between.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",)}
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar toolbar".split())
#: Parts of a class or id that name what isn't the article.
NAMES = re.compile(
    r"(?:^|[\s_-])(?<!\bno-)(?<!\bhas-)(?<!\bwith-)(?:ads?|adverts?|advertis\w*|adsense|banners?|breadcrumbs?|cookies?|consent|disclaimer|footers?|gdpr|hidden|login|mast-?head|menus?|modal|nav|navbar|navigation|"
    r"newsletter|notices?|outbrain|overlay|pagination|pager|paywall|popups?|promo\w*|recommend\w*|related|share|sharing|sidebars?|signup|skip|social|sponsor\w*|subscribe|taboola|toolbar|topbar|widgets?)"
    r"(?:$|[\s_-])|(?:^|\s)(?:page|site|top|global)-?header(?:$|\s)",
    re.IGNORECASE,
)
COMMENTS = re.compile(r"(?:^|[\s_-])(?<!\bno-)(?<!\bhas-)(?<!\bwith-)(?:comments?|commentlist|disqus|replies|respond)(?:$|[\s_-])", re.IGNORECASE)
HEADERS = re.compile(r"^header$", re.IGNORECASE)
MARKUP = re.compile(r"<(?:!--|(/?)([a-zA-Z][^\s/>]*)|[!?])")
REST = re.compile(r"""[^>"']*+(?:"[^"]*+"[^>"']*+|'[^']*+'[^>"']*+)*+>""")
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.IGNORECASE)
COMMA = re.compile("[,，、،]")
#: Blocks that hold a text of their own rather than other blocks.
LEAVES = frozenset("p li h1 h2 h3 h4 h5 h6 tr hr dt dd".split())
#: How many levels up a block's points reach: to its container in full, and less and less to those above.
LEVELS = 6
#: What a list of links has: so many at least, so much of its text, and links of at most so many characters.
MENU_LINKS, MENU_SHARE, MENU_CHARS = 3, 0.9, 40
#: What an element needs to be kept against its name: so much of the page's text, as characters at least, and links no more than this.
NAMED_SHARE, NAMED_CHARS, NAMED_LINKS = 0.5, 200, 0.3


class Element:
    __slots__ = ("tag", "parent", "kids", "out", "named", "within", "score", "chars", "linked")

    def __init__(self, tag: str, parent: Element | None, out: bool):
        self.tag, self.parent, self.out = tag, parent, out  # out: not part of an article
        self.named = False  # out by its name alone
        self.within = parent is not None and parent.within or tag in ("article", "main")
        self.kids: list = []  # elements and strings, in page order
        self.score, self.chars, self.linked = 0.0, 0, 0


def _judge(e: Element, rest: str) -> None:
    """Whether an element is out, by its tag and attributes."""
    if e.tag in DROPPED or e.tag == "header" and not e.within:  # an article may have a header of its own
        e.out = True
    if e.tag in ("body", "html", "article", "main") and not COMMENTS.search(rest) or len(rest) < 4:
        return
    for m in ATTRIBUTE.finditer(rest):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id"):
            if COMMENTS.search(value) and e.tag not in ("body", "html", "main"):
                e.out, e.named = True, False
                return
            if not e.out and e.tag not in ("body", "html", "article", "main") and (NAMES.search(value) or HEADERS.match(value.strip())):
                e.out = e.named = True
        elif name == "role" and e.tag not in ("body", "html", "article", "main"):
            if value.lower() in ROLES:
                e.out, e.named = True, False
        elif e.tag not in ("body", "html", "article", "main") and (name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.IGNORECASE)):
            e.out, e.named = True, False


def parse(page: str) -> Element:
    """The tree of a page, with what isn't part of an article marked as out."""
    root = Element("#root", None, False)
    stack, top, at, n = [root], root, 0, len(page)
    places: dict[str, list[int]] = {}  # of each open tag, where in the stack
    scopes = [0]  # and of those in SCOPE

    def close_to(k: int) -> None:
        nonlocal top
        for e in stack[k:]:
            places[e.tag].pop()
            if e.tag in SCOPE:
                scopes.pop()
        del stack[k:]
        top = stack[-1]

    def find(tags: tuple[str, ...]) -> int:
        """Where in the stack one of the tags is open, with nothing in SCOPE above it; 0 if nowhere."""
        k = max(places[t][-1] if places.get(t) else 0 for t in tags)
        return k if k >= scopes[-1] else 0

    while at < n:
        m = MARKUP.search(page, at)
        if not m:
            top.kids.append(page[at:])
            break
        if m.start() > at:
            top.kids.append(page[at : m.start()])
        if page.startswith("<!--", m.start()):
            end = page.find("-->", m.end() - 2 if page.startswith("<!-->", m.start()) else m.end())
            at = n if end < 0 else end + 3
            continue
        if not m[2]:  # a declaration
            end = page.find(">", m.end())
            at = n if end < 0 else end + 1
            continue
        tag = m[2].lower()
        r = REST.match(page, m.end())
        if r:
            rest, at = r[0], r.end()
        else:  # a quote isn't closed
            end = page.find(">", m.end())
            if end < 0:
                break  # the page ends inside a tag
            rest, at = page[m.end() : end], end + 1
        if m[1]:
            if places.get(tag):
                close_to(places[tag][-1])
            elif tag in ("br", "p"):
                top.kids.append(" " if tag == "br" else Element("p", top, False))
            continue
        if tag in BLOCK and (k := find(("p",))):
            close_to(k)
        if tag in CLOSES and (k := find(CLOSES[tag])):
            close_to(k)
        if tag in ("tr", "td", "th", "tbody", "thead", "tfoot") and places.get("table"):
            over = {"td": ("td", "th"), "th": ("td", "th"), "tr": ("td", "th", "tr")}.get(tag, ("td", "th", "tr", "tbody", "thead", "tfoot"))
            while top.tag in over or top.tag not in SCOPE and top.tag not in BLOCK and len(stack) > 2:
                close_to(len(stack) - 1)
        if tag in VOID:
            if tag == "hr":
                top.kids.append(Element("hr", top, False))
            elif tag in ("br", "wbr"):
                top.kids.append(" " if tag == "br" else "")
            continue
        if tag in RAW:  # what is inside isn't markup
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.IGNORECASE).search(page, at)
            at = n if not end else end.start()
            if end:
                close = page.find(">", at)
                at = n if close < 0 else close + 1
            top.kids.append(" ")
            continue
        e = Element(tag, top, False)
        _judge(e, rest)
        top.kids.append(e)
        if not rest.endswith("/>") or tag in BLOCK:
            places.setdefault(tag, []).append(len(stack))
            if tag in SCOPE:
                scopes.append(len(stack))
            stack.append(e)
            top = e
    return root


def _blocks(root: Element, score: bool = False) -> list[str]:
    """The blocks of text below an element, in page order, without what is out.  score: give their points to what is above."""
    blocks: list[str] = []
    texts: list[str] = []
    linked, holders = 0, [root]

    def flush() -> None:
        nonlocal linked
        if texts:
            text = " ".join(html.unescape("".join(texts)).split())
            if text:
                blocks.append(text)
                if score:
                    holder = holders[-1]
                    points, up, level = 1 + len(COMMA.findall(text)) + min(len(text) / 100, 3), holder, 0
                    if up.tag in ("p", "pre", "li", "td", "h1", "h2", "h3", "h4", "h5", "h6", "dd", "dt", "blockquote", "figcaption") and up.parent is not None:
                        up.score, up = up.score + points, up.parent  # the block itself, and then its container in full
                    while up is not None and level < LEVELS:
                        up.score += points / (1 if level == 0 else 2 if level == 1 else 3 * level)
                        up, level = up.parent, level + 1
                    holder.chars += len(text)
                    holder.linked += min(linked, len(text))
            texts.clear()
        linked = 0

    todo: list = [(root, 0)]
    links = 0
    while todo:
        e, i = todo.pop()
        if i == 0 and e is not root:
            if e.tag in BLOCK:
                flush()
                holders.append(e)
            elif e.tag == "a":
                links += 1
        kids = e.kids
        while i < len(kids):
            k = kids[i]
            i += 1
            if k.__class__ is str:
                texts.append(k)
                if links and k.strip():
                    linked += len(k)
            elif not k.out:
                todo.append((e, i))
                todo.append((k, 0))
                break
            elif k.tag in BLOCK:
                flush()
        else:
            if e is root:
                flush()
            elif e.tag in BLOCK:
                flush()
                holders.pop()
            elif e.tag == "a":
                links -= 1
    return blocks


def _listed(root: Element, through: bool = False) -> list[Element]:
    """The elements below one, it included, from the top down; without what is out, unless through."""
    order, todo = [], [root]
    while todo:
        e = todo.pop()
        order.append(e)
        todo += [k for k in e.kids if k.__class__ is not str and (through or not k.out)]
    return order


def _keep_named(root: Element) -> None:
    """Take back what names have put out where it holds most of the page's text."""
    named = [e for e in _listed(root, True) if e.named]
    if not named:
        return
    # Texts are measured roughly, straight from the tree: a hard reason to be out counts, a name doesn't.
    size: dict[int, tuple[int, int]] = {}
    order, todo = [], [(root, False)]
    while todo:
        e, link = todo.pop()
        order.append(e)
        link = link or e.tag == "a"
        own = sum(len(k.strip()) for k in e.kids if k.__class__ is str)
        size[id(e)] = (own, own if link else 0)
        todo += [(k, link) for k in e.kids if k.__class__ is not str and (k.named or not k.out)]
    for e in reversed(order):
        if e.parent is not None and id(e.parent) in size:
            (a, b), (c, d) = size[id(e.parent)], size[id(e)]
            size[id(e.parent)] = (a + c, b + d)
    whole = size[id(root)][0]
    for e in named:
        chars, linked = size.get(id(e), (0, 0))
        if chars >= NAMED_CHARS and chars > NAMED_SHARE * whole and linked <= NAMED_LINKS * chars:
            e.out = False


LISTS = frozenset(("ul", "ol", "dl", "dir"))


def _drop_menus(root: Element) -> None:
    """Lists whose text is short links and little else are out; of lists in each other, the innermost are looked at."""
    found: dict[int, list] = {}  # of each innermost list: itself, its links, their characters and all characters
    outer, todo = set(), [(root, None, False)]
    while todo:
        e, lst, link = todo.pop()
        if e.tag in LISTS:
            if lst is not None:
                outer.add(id(lst))
            lst, link = e, False
            found[id(e)] = [e, 0, 0, 0]
        if lst is not None:
            counts, own = found[id(lst)], sum(len(k.strip()) for k in e.kids if k.__class__ is str)
            counts[1] += e.tag == "a"
            link = link or e.tag == "a"
            counts[2] += own if link else 0
            counts[3] += own
        todo += [(k, lst, link) for k in e.kids if k.__class__ is not str and not k.out]
    for key, (e, links, said, text) in found.items():
        if key not in outer and links >= MENU_LINKS and said >= MENU_SHARE * text and said <= MENU_CHARS * links:
            e.out = True


def main_text(page: str | None) -> str:
    """The text of the article around the best container, or of the page: blocks joined by an empty line; '' if there is none."""
    if not page:
        return ""
    root = parse(page)
    _keep_named(root)
    _drop_menus(root)
    _blocks(root, score=True)
    # Lengths are summed from the leaves up; the tree is walked without recursion, since pages may nest without bound.
    order = _listed(root)
    for e in reversed(order):
        if e.parent is not None:
            e.parent.chars += e.chars
            e.parent.linked += e.linked
    best, most = None, 0.0
    for e in order:
        if e.tag in BLOCK and e.tag not in LEAVES and e.chars or e is root and e.chars:
            value = e.score * (1 - e.linked / e.chars) * (1.25 if e.tag in ("article", "main") else 1)
            if value > most:
                best, most = e, value
    if best is None:
        return ""
    path, top = set(), None
    up: Element | None = best
    while up is not None:
        path.add(up)
        top = up if up.tag in ("article", "main") else top
        up = up.parent
    if top is None:
        # From the leaves up, so that what stands beside a list of links stays.
        inside = {best}
        for e in order:
            if e.parent in inside:
                inside.add(e)
        lost: dict[Element, list[int]] = {}
        for e in reversed(order):
            chars, linked = lost.pop(e, (0, 0))
            left = e.chars - chars
            if e not in path and e not in inside and e.tag in BLOCK and e.tag not in LEAVES and left and e.linked - linked >= 0.5 * left:
                e.out, chars, linked = True, e.chars, e.linked
            if chars and e.parent is not None:
                sums = lost.setdefault(e.parent, [0, 0])
                sums[0] += chars
                sums[1] += linked
        return "\n\n".join(_blocks(root))
    kept, todo = [], [root]
    while todo:
        e = todo.pop()
        good = e is top
        if e not in path and e.chars:
            density = e.linked / e.chars
            good = e.tag in ("article", "main") and density < 0.5
            if e.parent is top.parent and not good:
                paragraph = e.tag in ("p", "blockquote", "pre") and density < 0.25 and e.chars > 80
                good = paragraph or e.tag in BLOCK and density < 0.5 and e.score * (1 - density) >= max(5, 0.2 * most)
        if good:
            kept.append(e)
        else:
            todo += [k for k in reversed(e.kids) if k.__class__ is not str and not k.out]
    return "\n\n".join(b for e in kept for b in _blocks(e))


def _extract(batches):
    for b in batches:
        keys, urls, pages = b.column(0), b.column(1), b.column(2)
        for at in range(0, b.num_rows, 256):
            n = min(256, b.num_rows - at)
            texts = pa.array([main_text(p.as_py()) for p in pages.slice(at, n)], pa.string())
            yield pa.RecordBatch.from_arrays([keys.slice(at, n), urls.slice(at, n), texts], ["page_id", "url", "text"])


def extract_main_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """``(page_id, url, text)`` for each row of ``pages``, from the whole page.

    A null, empty or textless page has the text ''.  Of containers equally good the first is best.  Null ids and urls and repeated rows
    stay as they are.  Only the three named
    columns are read, so that others may have any name; an empty table gives an empty result.
    """
    given = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(page).alias("html"))
    return given.mapInArrow(_extract, f"page_id {given.schema['page_id'].dataType.simpleString()}, url string, text string")
