"""Main text of web pages by tag-path ratios: which paths from the root to a block carry running text, and which carry menus and notes."""

from __future__ import annotations

import html
import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map

# Elements by what HTML makes of them.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What is inside is not markup: it goes on to the element's own end tag.
RAW = frozenset("script style title textarea iframe noembed noframes xmp".split())
#: Never text of a page.
NEVER = frozenset("head script style template noscript svg canvas audio video object iframe noembed noframes textarea select datalist option button title map applet".split())
#: Boilerplate by name of the element.
PLAIN_BOILERPLATE = {"nav": "menu", "menu": "menu", "header": "header", "footer": "footer", "aside": "side", "form": "form", "fieldset": "form", "dialog": "notice", "search": "form", "label": "form"}
#: What a start tag ends, if it is open, unless one of the second kind is open inside.
ENDS = {"li": ("li", ("ul", "ol", "menu", "dir")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th caption", ("table",)), "td": ("td th", ("table", "tr")), "th": ("td th", ("table", "tr")), "tbody": ("tbody thead tfoot tr td th caption", ("table",)), "thead": ("tbody thead tfoot tr td th caption", ("table",)), "tfoot": ("tbody thead tfoot tr td th caption", ("table",))}
for _h in ("h1", "h2", "h3", "h4", "h5", "h6"):
    ENDS[_h] = ("h1 h2 h3 h4 h5 h6", tuple(BLOCKS - {"h1", "h2", "h3", "h4", "h5", "h6"}))
ENDS = {k: (tuple(a.split()), b) for k, (a, b) in ENDS.items()}
#: End tags don't reach out of these.
SCOPE = ("table", "td", "th", "caption")
# Words in the class, id or role of an element that say what it is.
NAMED = {
    "menu": "nav navbar navigation navigations menu menus menubar breadcrumb breadcrumbs crumbs pagination pager paginator toc skip skiplink toolbar topbar tabs sitemap",
    "header": "header masthead banner topnav pagehead",
    "footer": "footer foot colophon contentinfo copyright credits disclaimer",
    "side": "sidebar sidebars aside rail complementary widget widgets related recommended recommendations recirc trending popular teaser teasers",
    "notice": "cookie cookies consent gdpr notice notices alert alerts popup popover modal overlay lightbox toast dialog alertdialog paywall newsletter subscribe subscription notification notifications announcement snackbar interstitial",
    "advert": "ad ads adv advert adverts advertisement advertisements advertising adsense adslot adbox adunit adcontainer adwrapper dfp sponsor sponsored sponsors promo promos promotion promoted promotional outbrain taboola affiliate",
    "form": "form signup login signin register search searchbox searchform",
    "comment": "comment comments commentlist commenting disqus reply replies respond response responses discussion reviews feedback guestbook",
    "share": "share sharing sharebar social socials follow sharedaddy addthis byline-tools",
}
#: What longer words begin or end with that are of a kind.
BEGIN = (("cookie", "notice"), ("newsletter", "notice"), ("advert", "advert"), ("adsby", "advert"), ("sponsor", "advert"), ("breadcrumb", "menu"), ("sidebar", "side"), ("disqus", "comment"))
END = (("sidebar", "side"), ("comments", "comment"), ("menu", "menu"), ("navbar", "menu"), ("footer", "footer"), ("header", "header"), ("banner", "header"))
_SAYS = {word: kind for kind, words in NAMED.items() for word in words.split()}
_PIECE = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")

_TAG = re.compile(r"<(?:!--|(/?)([A-Za-z][^\s/>]*)|[!?/])")
_ATTRIBUTE = re.compile(r"""[\s/]*(?:>|([^\s/>=][^\s/>=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"'][^\s>]*)))?|(["'=]))""")
_PUNCTUATION = re.compile(r"[.,;:!?…。、，；：！？؟،]")
_CLOSE_RAW = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}
#: What makes an element one that holds the article: certainly, or likely.
HOLDS = {"article": 2, "main": 2, "h1": 1}
#: Elements that are pieces of running text, not what holds it.
PIECES = frozenset("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre figure figcaption address hgroup details summary".split())
#: Width of the smoothing over neighbouring blocks, in blocks.
SMOOTH = 1.0


def named(attributes: dict[str, str]) -> str:
    """The kind of boilerplate that an element's class, id or role names; empty if none."""
    for key in ("role", "id", "class"):
        if value := attributes.get(key):
            for word in map(str.lower, _PIECE.findall(value)):
                if kind := _SAYS.get(word) or next((k for w, k in BEGIN if word.startswith(w)), "") or next((k for w, k in END if word.endswith(w)), ""):
                    return kind
    return ""


def hidden(attributes: dict[str, str]) -> bool:
    return "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or "display:none" in attributes.get("style", "").replace(" ", "").lower()


class Page:
    """The elements of a page that matter, in their order, and its blocks of text; markup that is not well-formed is taken as browsers take it, near enough.

    One pass, each end tag finds its element by a table of open ones, so the time grows with the page's length and not with its depth.
    """

    def __init__(self, text: str):
        #: Of each element: its parent, its tag, the kind of boilerplate that it says it is, the id of its tag path.
        self.parent, self.tag, self.kind, self.path = [-1], [""], [""], [0]
        self._paths: dict[tuple[int, str], int] = {}
        #: Blocks of text: (element, text, characters within links), white space put right.
        self.blocks: list[tuple[int, str, int]] = []
        self._text: list[str] = []
        self._link_chars = 0
        #: Open elements, and the places in the stack of those of each name.
        self._stack, self._open = [0], {}
        #: Names of the inline elements that are open in the innermost block, and how many of them hide what is in them.
        self._inline: list[list[tuple[str, bool]]] = [[]]
        self._counts: list[Counter] = [Counter()]
        self._mute, self._links = 0, 0
        self._read(text)
        self._flush()

    def _flush(self) -> None:
        if self._text:
            if said := " ".join("".join(self._text).split()):
                self.blocks.append((self._stack[-1], said, min(self._link_chars, len(said))))
            self._text, self._link_chars = [], 0

    def _say(self, raw: str) -> None:
        if raw and not self._mute:
            said = html.unescape(raw) if "&" in raw else raw
            self._text.append(said)
            if self._links:
                self._link_chars += len(said.strip())

    def _push(self, name: str, kind: str) -> None:
        self._flush()
        parent = self._stack[-1]
        self.parent.append(parent)
        self.tag.append(name)
        self.kind.append(kind)
        self.path.append(self._paths.setdefault((self.path[parent], name), len(self._paths) + 1))
        self._open.setdefault(name, []).append(len(self._stack))
        self._stack.append(len(self.tag) - 1)
        self._inline.append([])
        self._counts.append(Counter())

    def _pop_to(self, place: int) -> None:
        """Ends all elements from that place in the stack on."""
        self._flush()
        while len(self._stack) > place:
            self._open[self.tag[self._stack.pop()]].pop()
            for name, mute in self._inline.pop():
                self._mute -= mute
                self._links -= name == "a"
            self._counts.pop()

    def _last(self, names) -> int:
        return max((self._open[n][-1] for n in names if self._open.get(n)), default=0)

    def _start(self, name: str, attributes: dict[str, str], alone: bool) -> None:
        kind = "hidden" if hidden(attributes) and name not in ("html", "body") else "" if name in ("html", "body", "main", "a") else named(attributes)
        if name in BLOCKS:
            if name in ENDS:
                ended, but = ENDS[name]
                if (place := self._last(ended)) > self._last(but):
                    # the outermost of those that end
                    while (further := max((p for n in ended for p in self._open.get(n, ())[-2:] if p < place), default=0)) > self._last(but):
                        place = further
                    self._pop_to(place)
            if (place := self._last(("p",))) > self._last(SCOPE):
                self._pop_to(place)
            if name == "hr":
                self._flush()
                return
            self._push(name, "never" if name in NEVER else kind or PLAIN_BOILERPLATE.get(name, ""))
        elif name == "br":
            self._say(" ")
        elif name not in VOID and not alone:
            if name == "a" and self._counts[-1]["a"]:
                self._end_inline("a")
            mute = name in NEVER or bool(kind) or name in PLAIN_BOILERPLATE
            self._inline[-1].append((name, mute))
            self._counts[-1][name] += 1
            self._mute += mute
            self._links += name == "a"

    def _end_inline(self, name: str) -> None:
        while True:
            was, mute = self._inline[-1].pop()
            self._counts[-1][was] -= 1
            self._mute -= mute
            self._links -= was == "a"
            if was == name:
                return

    def _end(self, name: str) -> None:
        if name in BLOCKS:
            same = [name] if name[:1] != "h" or name[1:] not in "123456" else ["h1", "h2", "h3", "h4", "h5", "h6"]
            place = self._last(same)
            if place and (place >= self._last(SCOPE) or name in ("table", "tr", "tbody", "thead", "tfoot", "html", "body")):
                # the end of body or html is taken as what follows goes on in it
                if name not in ("html", "body"):
                    self._pop_to(place)
                    return
            self._flush()
        elif self._counts[-1][name]:
            self._end_inline(name)

    def _read(self, text: str) -> None:
        at, size = 0, len(text)
        while at < size:
            m = _TAG.search(text, at)
            if not m:
                self._say(text[at:])
                return
            self._say(text[at : m.start()])
            name = m[2]
            if name is None:
                if m[0] == "<!--":
                    if text.startswith((">", "->"), m.end()):
                        at = text.index(">", m.end()) + 1
                        continue
                    end, step = text.find("-->", m.end()), 3
                else:
                    end, step = text.find(">", m.end()), 1
                at = end + step if end >= 0 else size
                continue
            name, attributes, at, alone = name.lower(), {}, m.end(), False
            while True:
                a = _ATTRIBUTE.match(text, at)
                if not a:  # the page ends within the tag
                    return
                at = a.end()
                if a[0].endswith(">") and a[1] is None and a[5] is None:
                    alone = a[0].rstrip(">").endswith("/")
                    break
                if a[1] is not None and not m[1]:
                    key = a[1].lower()
                    if key in ("class", "id", "role", "hidden", "aria-hidden", "style"):
                        attributes.setdefault(key, html.unescape(next((v for v in a.group(2, 3, 4) if v is not None), "")))
            if m[1]:
                self._end(name)
                continue
            if name in RAW and not (alone and name == "title"):
                end = _CLOSE_RAW[name].search(text, at)
                if name == "xmp" and end:
                    self._push("pre", "")
                    self._text.append(text[at : end.start()])
                    self._pop_to(len(self._stack) - 1)
                if not end:
                    return
                close = text.find(">", end.end())
                at = close + 1 if close >= 0 else size
                continue
            self._start(name, attributes, alone)


def boilerplate(page: Page) -> list[str]:
    """Of each element the kind of boilerplate in which it lies, empty if in none.

    An element that holds an article, a main part or a main heading, and more text than there is outside of boilerplate, is none, whatever it is named, as names like "with-sidebar" stand
    on wrappers and some elements are never closed; for headers a heading is not enough. A heading in the header of an article is part of the article.
    """
    n = len(page.tag)
    #: Text of an element that lies in no boilerplate within it, but for such as may be a wrapper.
    own, holds, never, flagged, free = [0] * n, [0] * n, [False] * n, [False] * n, 0
    for e in range(1, n):
        never[e] = never[page.parent[e]] or page.kind[e] in ("never", "hidden")
        flagged[e] = flagged[page.parent[e]] or bool(page.kind[e])
    for e, text, _ in page.blocks:
        if not never[e]:
            own[e] += len(text)
            free += 0 if flagged[e] else len(text)
    for e in range(n - 1, 0, -1):
        if not page.kind[e]:
            holds[e] = max(holds[e], HOLDS.get(page.tag[e], 0))
        up = page.parent[e]
        # comments that are articles, or hold them, make no wrapper
        if page.kind[e] != "comment":
            holds[up] = max(holds[up], holds[e])
        if not page.kind[e] or holds[e]:
            own[up] += own[e]
    out, inside = [""] * n, [False] * n
    for e in range(1, n):
        up, kind, tag = page.parent[e], page.kind[e], page.tag[e]
        inside[e] = inside[up] or (tag in ("article", "main") and not out[up])
        if kind and kind not in ("never", "hidden") and holds[e] > (kind == "header") and own[e] > free and (kind != "comment" or tag not in ("article", "section", "ol", "ul", "li")):
            kind = ""
        if kind == "header" and inside[up] and not out[up]:
            kind = "header of an article"
        out[e] = out[up] or kind
        if out[up] == "header of an article" and tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            out[e] = kind
    return out


def smooth(values: np.ndarray, width: float = SMOOTH) -> np.ndarray:
    """A Gaussian mean over neighbouring places."""
    reach = int(np.ceil(2 * width))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / width) ** 2)
    padded = np.convolve(values, kernel)[reach : reach + len(values)]
    return padded / np.convolve(np.ones(len(values)), kernel)[reach : reach + len(values)]


def content(page: Page) -> list[int]:
    """Which blocks are content.

    For each tag path the text outside of links and the punctuation of all its blocks are put in proportion to how many blocks it has: a path of running text
    has much in each, one of menus little. Both ratios are smoothed over the blocks in page order, so that a heading or a short
    block among long ones is lifted, multiplied, and summed up again by path; paths over the standard deviation of all blocks are content paths. The articles
    that hold their blocks, or else the smallest element that holds all of them, are the content nodes: their blocks that are in no
    boilerplate are returned. Where that is the whole body, a block of another path is content if its own smoothed ratio is over the threshold or it is a heading between content blocks.
    """
    outside = boilerplate(page)
    mine = [k for k, (e, _, _) in enumerate(page.blocks) if not outside[e]]
    if not mine:
        return []
    element = np.array([page.blocks[k][0] for k in mine])
    path = np.unique(np.array(page.path)[element], return_inverse=True)[1]
    size = np.array([len(page.blocks[k][1]) for k in mine], float)
    link = np.array([page.blocks[k][2] for k in mine], float)
    marks = np.array([len(_PUNCTUATION.findall(page.blocks[k][1])) for k in mine], float)
    count = np.bincount(path)
    # links count a tenth: what is nothing but links is still text where there is no other
    ratio = (np.bincount(path, size - 0.9 * link) / count)[path]
    points = (np.bincount(path, marks * (1 - 0.9 * link / size)) / count)[path]
    fused = smooth(ratio) * (1 + smooth(points))
    threshold = float(fused.std())
    chosen = (np.bincount(path, fused) / count >= threshold)[path]
    if not chosen.any():
        chosen = fused >= fused.max()
    menu = _menus(page, mine)
    chosen &= ~menu & (link < 0.9 * size)
    if not chosen.any():
        # links and nothing else: only what an article says is one
        chosen = np.array([bool(h) for h in np.array(_innermost(page, "article"))[element]]) | (np.array(_innermost(page, "main"))[element] > 0)
    if not chosen.any():
        return []
    # the innermost article of each block that is in one
    article = _innermost(page, "article")
    holders = {article[e] for e in element[chosen].tolist()} - {0}
    if not holders:
        main = _innermost(page, "main")
        article, holders = main, {main[e] for e in element[chosen].tolist()} - {0}
    if holders:
        weight = Counter()
        for e, n in zip(element.tolist(), size.tolist()):
            weight[article[e]] += n
        # articles within one that has text of its own are comments on it; ones far smaller than another are notes that point elsewhere
        most = max(weight[h] for h in holders)
        holders = {h for h in holders if 4 * weight[h] >= most and not any(up in holders for up in _above(page, h, article))}
        if 4 * sum(weight[h] for h in holders) >= float(size[chosen].sum()):
            # in an article nothing but boilerplate is left out, also no list of links
            return [k for k, e in zip(mine, element.tolist()) if article[e] in holders]
    low, high = _common(page, element[chosen])
    if page.tag[low] not in ("", "html", "body"):
        return [k for k, e, m in zip(mine, element.tolist(), menu) if low <= e <= high and not m]
    places = np.flatnonzero(chosen)
    heading = np.array([page.tag[e] in ("h1", "h2", "h3", "h4", "h5", "h6") for e in element.tolist()])
    between = (np.arange(len(mine)) >= places[0] - 1) & (np.arange(len(mine)) <= places[-1])
    return [k for k, ok in zip(mine, (chosen | ((fused >= threshold) & (link < 0.9 * size) | heading) & between & ~menu).tolist()) if ok]


def _above(page: Page, e: int, article: list[int]):
    """The articles that an article lies in."""
    while e := article[page.parent[e]]:
        yield e


def _innermost(page: Page, tag: str) -> list[int]:
    out = [0] * len(page.tag)
    for e in range(1, len(out)):
        out[e] = e if page.tag[e] == tag else out[page.parent[e]]
    return out


def _common(page: Page, all_: np.ndarray) -> tuple[int, int]:
    """(element, last element inside it) of the smallest container of all of some elements; elements are numbered as they begin."""
    low, high = int(all_.min()), int(all_.max())
    a, b = low, high
    while a != b:
        if a > b:
            a = page.parent[a]
        else:
            b = page.parent[b]
    # one paragraph or list is no container
    while page.tag[a] in PIECES:
        a = page.parent[a]
    end = [*range(len(page.tag))]
    for e in range(len(end) - 1, 0, -1):
        end[page.parent[e]] = max(end[page.parent[e]], end[e])
    return a, end[a]


def _menus(page: Page, mine: list[int]) -> np.ndarray:
    """Blocks of lists in which each item is links and nothing else, two items at least."""
    lists = [0] * len(page.tag)
    for e in range(1, len(lists)):
        lists[e] = e if page.tag[e] in ("ul", "ol", "menu", "dir", "table") else lists[page.parent[e]]
    items, linked = Counter(), Counter()
    for k in mine:
        e, text, link = page.blocks[k]
        items[lists[e]] += 1
        linked[lists[e]] += link >= len(text.replace(" ", "")) * 0.9
    return np.array([bool(at := lists[page.blocks[k][0]]) and items[at] > 1 and items[at] == linked[at] for k in mine])


def main_text(source: str) -> str:
    """The main text of a page, its blocks joined by one space."""
    page = Page(source)
    return " ".join(page.blocks[k][1] for k in content(page))


def extract_pages(pages: DataFrame) -> DataFrame:
    """-> page_id, url, text, n_chars; one row for each input row.

    The article of each page, as ``content`` finds it: character references decoded, white space within a block one space, blocks joined by one space in
    page order. A null or empty page, or one without text outside of boilerplate, has an empty text. Pages are read whole, whatever their length, each by itself in the task that
    reads it; null ids and urls and repeated rows stand as they are; other columns are ignored. Nothing is shuffled.
    """

    def run(batch):
        texts = [main_text(t or "") for t in batch.column("text").to_pylist()]
        return {"page_id": batch.column("page_id"), "url": batch.column("url"), "text": texts, "n_chars": [len(t) for t in texts]}

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").alias("text"))
    return arrow_map(rows, run, "page_id long, url string, text string, n_chars long", pieces=2 << 20)
