"""Main text of web pages by boosted trees over the nodes of the DOM, decoded from the root down.

A page becomes a tree of elements (unclosed and stray tags are mended as browsers do, in essence). Each block element is
described by its tag, the words of its class and id, its depth and place, the density of text, tags and links in its
subtree, and statistics of its siblings; boosted trees say how likely it holds main text. A decision for each node alone
could keep a paragraph of a menu that was dropped, so nodes are decided together: a node that is dropped drops all below
it, and the assignment with the greatest sum of log odds, weighted by text, is found bottom-up.

Text is cut into blocks at block elements. Character references are decoded, white space in a block becomes one space,
blocks are trimmed and joined by one line feed, in page order; empty blocks go. The trees are fitted on the driver on
pages made by rule from a seed, so they need no table and are the same everywhere.

A null or empty html has an empty text. Truncated pages are read to their end. Repeated rows are extracted row by row; an
empty table gives no rows; other columns are ignored. Time is linear in the page.
"""

from __future__ import annotations

import functools
import html as entities
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.boosting import Trees
from ledgerloom.llm.columns import text_slices
from ledgerloom.shipping import ship

# Elements of HTML by how they are read.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("head script style title template noscript svg annotation annotation-xml object select option datalist canvas audio video iframe xmp noembed noframes textarea".split())
BLOCK = frozenset("html body address article aside blockquote center details dialog dd div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section summary table caption thead tbody tfoot tr td th ul button label legend".split())
#: elements that can stand in head; any other closes it
IN_HEAD = frozenset("html head base basefont bgsound link meta noframes noscript script style template title".split())
#: an opening tag of LEAVES leaves an open svg or math, unless it stands in an element of POINTS, which can hold HTML
FOREIGN = frozenset(["svg", "math"])
POINTS = frozenset("foreignobject desc title annotation-xml mi mo mn ms mtext".split())
LEAVES = BLOCK | frozenset("b big br code em embed head hr i img meta nobr ruby s small span strong strike sub sup tt u var".split())
SHELLS = POINTS | BLOCK
CLOSES_P = BLOCK - frozenset("td th tr tbody thead tfoot caption html body button label legend".split())
#: an opening tag closes open elements of these names, up to the nearest of the second
ENDED_BY = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])), "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])), "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr"]), frozenset(["table"])), "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])), "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
}
_WALLS = frozenset("html body table td th caption button article aside section main nav header footer div ul ol dl form fieldset blockquote".split())

_TAG = re.compile(r"""<!--(?:.*?--!?>|.*)|<!\[CDATA\[(?:.*?\]\]>|.*)|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>?""", re.S)
_ATTR = re.compile(r"""(?i)(?<![^\s"'/])(class|id|role|itemprop|aria-label|hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_WORD = re.compile(r"[A-Za-z][a-z]*|[A-Z]+(?![a-z])")

#: groups of words in attributes
HINTS = {
    "content": "article content main post entry story text body page prose read copy",
    "menu": "nav navbar menu menus breadcrumb breadcrumbs crumbs pagination pager toc tabs skip links sitemap navigation",
    "head": "header head masthead top topbar banner logo brand hero",
    "foot": "footer foot bottom copyright legal colophon imprint",
    "side": "sidebar side aside rail widget widgets related recommended recommend popular trending more teaser",
    "advert": "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion dfp outbrain taboola adsense",
    "notice": "cookie cookies consent gdpr notice notices alert popup modal overlay privacy banner message newsletter subscribe signup paywall",
    "form": "form login search signin register input contact field",
    "comment": "comment comments reply replies discussion disqus respond review reviews thread feedback",
    "share": "share sharing social follow tweet facebook twitter author bio meta tags byline date",
}
_GROUP = {w: k for k, words in enumerate(HINTS.values()) for w in words.split()}
TAGS = ("article", "main", "section", "div", "p", "heading", "li", "list", "table", "nav", "header", "footer", "aside", "form", "quote", "other")
_TAG_CODE = {t: k for k, t in enumerate(TAGS)} | {f"h{k}": 5 for k in range(1, 7)} | dict.fromkeys(("ul", "ol", "dl", "menu"), 7) | dict.fromkeys(("dt", "dd"), 6) | dict.fromkeys(("tr", "td", "th", "thead", "tbody", "tfoot", "caption"), 8) | dict.fromkeys(("fieldset", "button", "label", "legend", "search", "dialog"), 13) | dict.fromkeys(("blockquote", "pre", "figure", "figcaption"), 14)


class Page:
    """The block elements of a page, parents before children, and its blocks of text."""

    def __init__(self, source: str):
        self.tag: list[str] = ["html"]
        self.parent: list[int] = [-1]
        self.attrs: list[str] = [""]
        self.hidden: list[bool] = [False]
        self.tags: list[int] = [0]  # opening tags directly inside
        self.own: list[int] = [0]  # letters of text directly inside, and of it in links
        self.linked: list[int] = [0]
        self.stops: list[int] = [0]
        self.blocks: list[tuple[int, str]] = []  # element, text
        self._read(source)

    def _read(self, source: str) -> None:
        stack: list[tuple[str, int]] = [("html", 0)]  # open elements and their block elements
        # where in the stack the open elements of a name and of some sets of names are, so nothing has to look for them
        opened: dict[str, list[int]] = {}
        walls, shells, roots = [], [], []  # of _WALLS; of POINTS and BLOCK; of FOREIGN
        unseen = links = foreign = 0
        begun = False  # whether the body has
        pieces: list[str] = []

        def flush() -> None:
            if pieces:
                joined = "".join(pieces)
                pieces.clear()
                if line := " ".join(joined.split()):
                    self.blocks.append((stack[-1][1], line))
                    self.own[stack[-1][1]] += len(line)
                    self.stops[stack[-1][1]] += line.count(".") + line.count(",")

        def pop() -> None:
            nonlocal unseen, links, foreign
            name, _ = stack[-1]
            if name in BLOCK:
                flush()
            stack.pop()
            opened[name].pop()
            for places in (walls, shells, roots):
                if places and places[-1] == len(stack):
                    places.pop()
            unseen -= name in UNSEEN
            links -= name == "a"
            foreign -= name in FOREIGN

        def push(name: str, block: int) -> None:
            opened.setdefault(name, []).append(len(stack))
            for places, names in ((walls, _WALLS), (shells, SHELLS), (roots, FOREIGN)):
                if name in names:
                    places.append(len(stack))
            stack.append((name, block))

        def last(names) -> int:
            """Where the innermost open element of these names is; 0 if there is none."""
            return max((opened[x][-1] for x in names if opened.get(x)), default=0)

        def cut(k: int) -> None:
            while len(stack) > k:
                pop()

        def in_head() -> bool:
            return len(stack) > 1 and stack[1][0] == "head"

        def text(raw: str) -> None:
            nonlocal begun
            if raw and not raw.isspace() and (len(stack) == 1 or (len(stack) == 2 and in_head())):
                begun = True
                if in_head():
                    pop()
            if raw and not unseen:
                said = entities.unescape(raw) if "&" in raw else raw
                pieces.append(said)
                if links:
                    self.linked[stack[-1][1]] += len(said.strip())

        at, n = 0, len(source)
        while at < n:
            m = _TAG.search(source, at)
            if m is None:
                text(source[at:])
                break
            text(source[at : m.start()])
            at = m.end()
            name = (m[2] or m[5] or "").lower()
            if not name:
                continue
            if m[1] or m[4]:
                if name in ("html", "body"):
                    continue
                k = last((name,))
                if name == "p" and not k:
                    flush()
                if k and (name in BLOCK or not walls or walls[-1] <= k):
                    cut(k)
                continue
            if m[6] is not None and m.end() == n and not source.endswith(">"):
                break  # cut off inside a tag
            if in_head():
                if (name == "body" and not opened.get("template")) or (len(stack) == 2 and name not in IN_HEAD):
                    cut(1)
                    begun = True
            elif name not in IN_HEAD:
                begun = True
            if name in ("html", "body") or (name == "head" and (begun or in_head())):
                continue
            if foreign and name in LEAVES and (not shells or shells[-1] < roots[-1]):
                cut(roots[-1])
            if (name in CLOSES_P or name == "p") and (k := last(("p",))) and (not walls or walls[-1] < k):
                cut(k)
            if name in ENDED_BY:
                same, stop = ENDED_BY[name]
                if (k := last(same)) and last(stop) < k:
                    cut(k)
            if name in ("br", "wbr", "img", "hr"):
                if name == "hr":
                    flush()
                elif name != "wbr" and not unseen:
                    pieces.append(" ")
            self.tags[stack[-1][1]] += 1
            if name in VOID:
                continue
            if name in RAW:
                end = re.compile(rf"</{name}(?=[\s/>])", re.I).search(source, at)
                if end is None:
                    at = n
                else:
                    close = source.find(">", end.end())
                    at = n if close < 0 else close + 1
                continue
            attrs = m[3] if m[3] is not None else m[6] or ""
            if (foreign or name in FOREIGN) and re.search(r"""(?:^|[\s"'])/$""", attrs):
                continue  # only these close themselves
            if name in BLOCK:
                flush()
                kept, hidden = "", False
                if attrs.strip():
                    for a in _ATTR.finditer(attrs):
                        key, value = a[1].lower(), (a[2] or "").strip("\"'")
                        if key == "hidden" or (key == "style" and re.search(r"display\s*:\s*none", value, re.I)):
                            hidden = True
                        elif key != "style":
                            kept += f" {value}"
                self.tag.append(name)
                self.parent.append(stack[-1][1])
                self.attrs.append(kept)
                self.hidden.append(hidden)
                for column in (self.tags, self.own, self.linked, self.stops):
                    column.append(0)
                push(name, len(self.tag) - 1)
            else:
                push(name, stack[-1][1])
                unseen += name in UNSEEN
                links += name == "a"
                foreign += name in FOREIGN
        cut(1)
        flush()

    def features(self) -> np.ndarray:
        n = len(self.tag)
        parent = self.parent
        text, links, tags, stops, inside = list(self.own), list(self.linked), list(self.tags), list(self.stops), [0] * n
        paragraphs = [int(t == "p") for t in self.tag]
        kids: list[int] = [0] * n
        for v in range(n - 1, 0, -1):
            u = parent[v]
            text[u] += text[v]
            links[u] += links[v]
            tags[u] += tags[v]
            stops[u] += stops[v]
            paragraphs[u] += paragraphs[v]
            inside[u] += inside[v] + 1
            kids[u] += 1
        total = max(text[0], 1)
        place, seen = [0] * n, 0
        first = [0] * n
        depth = [0] * n
        order = [0] * n
        count: list[int] = [0] * n
        upper = [[0] * len(HINTS) for _ in range(n)]
        groups = [[0] * len(HINTS) for _ in range(n)]
        same: dict[tuple[int, str], int] = {}
        sib_text: dict[int, list[int]] = {}
        kinds = [_TAG_CODE.get(t, 15) for t in self.tag]
        above = [0] * n
        for v in range(n):
            for w in _WORD.findall(self.attrs[v]):
                if (k := _GROUP.get(w.lower())) is not None:
                    groups[v][k] = 1
            if v:
                u = parent[v]
                depth[v] = depth[u] + 1
                order[v] = count[u]
                count[u] += 1
                upper[v] = [a | b for a, b in zip(upper[u], groups[u], strict=True)]
                above[v] = above[u] | (1 << kinds[u])
                same[u, self.tag[v]] = same.get((u, self.tag[v]), 0) + 1
                sib_text.setdefault(u, [0, 0])
                sib_text[u][0] += text[v]
                sib_text[u][1] += links[v]
                first[v] = first[u] + place[u]
                place[u] += text[v]
        rows = []
        for v in range(n):
            u, t = parent[v], max(text[v], 1)
            mates, mates_text = (sib_text[u], kids[u]) if v else ([0, 0], 1)
            rows.append([
                *(float(kinds[v] == k) for k in range(len(TAGS))), *groups[v], *upper[v],
                *(float(above[v] >> k & 1) for k in (0, 1, 6, 7, 8, 9, 10, 11, 12, 13)),
                depth[v], order[v], order[v] / max(mates_text, 1), mates_text, kids[v], inside[v],
                np.log1p(text[v]), np.log1p(self.own[v]), text[v] / total, links[v] / t, tags[v] / t * 100, stops[v] / t * 100, paragraphs[v], text[v] / (inside[v] + 1),
                first[v] / total, (mates[0] - text[v]) / max(mates_text - 1, 1), (mates[1] - links[v]) / max(mates[0] - text[v], 1), same.get((u, self.tag[v]), 0) / max(mates_text, 1) if v else 1.0,
                float(self.hidden[v]),
            ])
        return np.array(rows, float)

    def decode(self, odds: np.ndarray) -> list[bool]:
        """Which elements are kept: none below one that is dropped, with the greatest sum of weighted log odds."""
        n = len(self.tag)
        weight = [1.0 + np.log1p(x) for x in self.own]
        keep, drop = [float(odds[v]) * weight[v] for v in range(n)], [-float(odds[v]) * weight[v] for v in range(n)]
        for v in range(n):
            if self.hidden[v]:
                keep[v] = -1e9
        for v in range(n - 1, 0, -1):
            keep[self.parent[v]] += max(keep[v], drop[v])
            drop[self.parent[v]] += drop[v]
        kept = [True] * n
        for v in range(1, n):
            kept[v] = kept[self.parent[v]] and keep[v] > drop[v]
        return kept

    def text(self, odds: np.ndarray) -> str:
        kept = self.decode(odds)
        return "\n".join(t for v, t in self.blocks if kept[v])


def made_page(rnd: random.Random) -> tuple[str, list[str]]:
    """A page made by rule, and its main blocks."""
    word = lambda: "".join(rnd.choice("abcdefghilmnoprstuvwyéü") for _ in range(rnd.randint(1, 9)))
    words = lambda a, b: " ".join(word() for _ in range(rnd.randint(a, b)))
    sentence = lambda: words(3, 18).capitalize() + rnd.choice(".,.!")
    prose = lambda a, b: " ".join(sentence() for _ in range(rnd.randint(a, b)))
    pick = rnd.choice
    link = lambda: f'<a href="/{word()}">{words(1, 3)}</a>'
    cls = lambda *names: pick([f' class="{pick(names)}"', f' id="{pick(names)}"', f' class="{pick(names)} {word()}"', f' class="{word()}-{pick(names)}"'])
    main: list[str] = []

    def said(tag: str, text: str) -> str:
        main.append(" ".join(text.split()))
        return f"<{tag}>{text}" + (f"</{tag}>" if rnd.random() < 0.9 or tag[0] == "h" else "")

    def noise(inside: bool) -> str:
        kind = pick(["menu", "advert", "notice", "form", "comment", "side", "share", "foot", "head"] if not inside else ["advert", "share", "form", "notice", "side", "comment"])
        if kind == "menu":
            items = "".join(f"<li>{link()}</li>" for _ in range(rnd.randint(2, 9)))
            return pick([f"<nav><ul>{items}</ul></nav>", f"<ul{cls('menu', 'nav', 'breadcrumb', 'navbar')}>{items}</ul>", f"<div{cls('menu', 'nav', 'pagination')}>{' | '.join(link() for _ in range(rnd.randint(2, 8)))}</div>", f"<nav>{' '.join(link() for _ in range(4))}</nav>"])
        if kind == "advert":
            return pick([f"<div{cls('ad', 'ads', 'advert', 'sponsored', 'promo')}>{prose(1, 2)}</div>", f"<aside{cls('ad', 'promo')}><p>{prose(1, 2)}</p></aside>", f"<section{cls('sponsor', 'advertisement')}><h4>{words(1, 3)}</h4><p>{prose(1, 1)} {link()}</p></section>"])
        if kind == "notice":
            return pick([f"<div{cls('cookie', 'cookie-banner', 'consent', 'notice', 'gdpr', 'alert')}><p>{prose(1, 3)}</p><button>{word()}</button></div>", f"<div{cls('newsletter', 'popup', 'paywall', 'notice')}>{prose(1, 2)}</div>", f'<dialog open>{prose(1, 2)}</dialog>', f'<div role="alert">{prose(1, 1)}</div>'])
        if kind == "form":
            return pick([f"<form><label>{words(1, 3)}</label><input type=text><button>{word()}</button></form>", f"<form{cls('search', 'login')}><p>{prose(1, 1)}</p><select><option>{word()}<option>{word()}</select></form>"])
        if kind == "comment":
            each = "".join(pick([f"<li><p>{prose(1, 3)}</p></li>", f"<div{cls('comment', 'reply')}><b>{word()}</b><p>{prose(1, 4)}</p></div>"]) for _ in range(rnd.randint(1, 5)))
            return pick([f"<section{cls('comments', 'discussion', 'replies')}><h3>{words(1, 2)}</h3>{each}</section>", f"<div{cls('comments', 'reviews', 'respond')}><ul>{each}</ul></div>", f"<ol{cls('comment-list', 'comments')}>{each}</ol>"])
        if kind == "side":
            return pick([f"<aside><h3>{words(1, 3)}</h3><p>{prose(1, 3)}</p></aside>", f"<div{cls('sidebar', 'related', 'widget', 'popular')}><h4>{words(1, 3)}</h4><ul>{''.join(f'<li>{link()}</li>' for _ in range(rnd.randint(2, 6)))}</ul></div>", f"<aside{cls('sidebar', 'rail')}><p>{prose(1, 2)}</p>{link()}</aside>"])
        if kind == "share":
            return pick([f"<div{cls('share', 'social', 'follow')}>{' '.join(link() for _ in range(3))}</div>", f"<ul{cls('share', 'social')}><li>{link()}</li><li>{link()}</li></ul>"])
        if kind == "foot":
            return pick([f"<footer>&copy; {words(1, 3)} &middot; {prose(1, 1)}</footer>", f"<div{cls('footer', 'copyright', 'legal')}>{prose(1, 2)} {link()}</div>", f"<div{cls('footer', 'copyright', 'legal')}>{prose(1, 2)}</div>", f"<footer><p>{prose(1, 1)}</p><ul><li>{link()}</li></ul></footer>"])
        return pick([f"<header><h2>{words(1, 3)}</h2>{link()}</header>", f"<div{cls('header', 'masthead', 'topbar')}><p>{words(2, 6)}</p>{link()}</div>"])

    def article() -> str:
        parts = [said(pick(["h1", "h1", "h2"]), words(3, 12))] if rnd.random() < 0.9 else []
        for _ in range(pick([1, 1, 1, 2, 3, 5, 8, 15, 30])):
            r = rnd.random()
            if r < 0.72:
                parts.append(said("p", pick(["", "<b>"]) + prose(1, 6) + pick(["", "", "<br>", f' {link()} {words(1, 4)}'])) if rnd.random() < 0.2 else said("p", pick([prose(1, 6), prose(1, 6), prose(1, 6), words(1, 4)])))
            elif r < 0.8:
                parts.append(said(pick(["h2", "h3"]), words(1, 8)))
            elif r < 0.88:
                parts.append("<ul>" + "".join(said("li", prose(1, 2)) for _ in range(rnd.randint(2, 5))) + "</ul>")
            elif r < 0.92:
                parts.append("<blockquote>" + said("p", prose(1, 3)) + "</blockquote>")
            elif r < 0.95:
                parts.append("<table>" + "".join("<tr>" + said("td", words(1, 3)) + said("td", words(1, 3)) + "</tr>" for _ in range(rnd.randint(1, 4))) + "</table>")
            elif r < 0.97:
                parts.append(f'<div{cls("section", "box", "text")}>' + said("p", prose(1, 4)) + "</div>")
            else:
                parts.append(noise(True))
        if rnd.random() < 0.2:
            parts.append(noise(True))
        return "".join(parts)

    # words that mislead: what holds an article may be named after anything
    astray = lambda: f"{pick(HINTS[pick(list(HINTS))].split())}-{pick(['body', 'content', 'text', 'main', 'wrap', 'area', 'inner'])}"
    wrap = pick([
        "<article>{}</article>", "<main>{}</main>", "<main><article>{}</article></main>", '<div class="content">{}</div>', '<div id="main"><div class="post">{}</div></div>', '<section class="entry">{}</section>', "<article{}>",
        '<div class="page-body"><article>{}</article></div>', "<div>{}</div>", f'<div class="{astray()}">{{}}</div>', f'<article class="{astray()}">{{}}</article>', f'<div class="{astray()}"><div id="{word()}">{{}}</div></div>',
        f'<div class="{word()}"><div class="{word()}">{{}}</div></div>', "<section>{}</section>", '<div role="main"><section>{}</section></div>', f"<table><tr><td>{noise(False)}</td><td>{{}}</td></tr></table>", "<center><table><tr><td>{}</td></tr></table></center>",
    ])
    before = "".join(noise(False) for _ in range(rnd.randint(0, 4)))
    body = wrap.replace("{}", article()) if wrap != "<article{}>" else f"<article{cls('post', 'story')}>{article()}</article>"
    after = "".join(noise(False) for _ in range(rnd.randint(0, 4)))
    page = f"{before}<!-- {word()} -->{body}{after}"
    if rnd.random() < 0.25:
        page = f'<div{cls("wrapper", "container", "layout", "page")}>{page}</div>'
    return f"<!DOCTYPE html><html><head><title>{words(2, 5)}</title><script>var a='</p>';</script></head><body>{page}" + pick(["</body></html>", "</body></html>", ""]), main


@functools.cache
def trees(pages: int = 1300, seed: int = 5) -> Trees:
    rnd = random.Random(seed)
    x, y = [], []
    for _ in range(pages):
        source, main = made_page(rnd)
        page = Page(source)
        wanted = [0] * len(page.tag)
        left = {}
        for b in main:
            # a link inside a block is text of the block
            left[" ".join(entities.unescape(re.sub(r"<[^>]*>", "", b)).split())] = 1
        for v, t in page.blocks:
            if t in left:
                wanted[v] = 1
        for v in range(len(wanted) - 1, 0, -1):
            wanted[page.parent[v]] |= wanted[v]
        x.append(page.features())
        y.append(np.array(wanted, float))
    return Trees(rounds=60, depth=5, rate=0.2).fit(np.concatenate(x), np.concatenate(y))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text of every page."""
    ship(pages.sparkSession)
    shared = pages.sparkSession.sparkContext.broadcast(trees())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "html"):
            found = [Page(x or "") for x in part.column("html").to_pylist()]
            rows = [p.features() for p in found]
            odds = np.split(shared.value.margin(np.concatenate(rows)), np.cumsum([len(r) for r in rows])[:-1])
            yield pa.record_batch([part.column("page_id"), part.column("url"), pa.array([p.text(o) for p, o in zip(found, odds, strict=True)], pa.string())], names=["page_id", "url", "text"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(run, "page_id long, url string, text string")


def summary(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    return extract(pages).withColumn("n_chars", F.length("text").cast("long"))
