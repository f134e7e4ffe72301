"""Main-text extraction from HTML: boosted trees over DOM nodes, decoded as a hierarchy.

A page becomes a tree of block elements and text blocks (inline markup joins the block around it).
Trees boosted on generated, labelled pages give each node the log-odds that it holds main text,
from subtree density, attribute words, depth, sibling statistics and what stands above it. Decoding
picks the best set closed under ancestors: a node's worth is its log-odds plus the positive worth
of its children, so a block is never kept under a dropped ancestor, nor an ancestor for nothing.
"""

from __future__ import annotations

import html as entities
import math
import random
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm import trees
from tallyforge.llm.common import arrow_map, release

#: HTML's element groups.
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style title textarea iframe noembed noframes xmp template".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
          "tbody": {"thead", "tbody", "tr", "td", "th"}, "thead": {"tbody", "tr"}, "tfoot": {"tbody", "tr", "td", "th"}, "body": {"head"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}, "tbody": {"table"}, "thead": {"table"}, "tfoot": {"table"}}
GROUPS = ("html body", "article main", "p", "h1", "h2 h3 h4 h5 h6", "ul ol dl menu", "li dt dd", "div", "section", "nav", "aside", "footer", "header",
          "form fieldset button select option input legend datalist", "table thead tbody tfoot tr td th caption", "blockquote pre figure figcaption address details summary", "head noscript dialog object applet frameset svg canvas audio video")
GROUP = {t: i for i, ts in enumerate(GROUPS) for t in ts.split()}
#: Words of class, id and role attributes, by what they tell.
TOLD = {
    "content": "article content main post entry body story text prose blog news read reading",
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager tabs toc skip links sitemap toolbar dropdown",
    "advert": "ad ads adv advert advertisement adsense sponsor sponsored promo promotion banner affiliate outbrain taboola commercial dfp",
    "comment": "comment comments commentlist reply replies respond discussion disqus thread reviews responses",
    "edge": "header footer masthead logo copyright colophon legal bottom top site",
    "side": "sidebar side aside widget widgets rail related recommended recommendations popular trending more secondary complementary teaser",
    "notice": "cookie cookies consent notice alert warning gdpr modal popup overlay message announcement disclaimer subscribe newsletter paywall",
    "form": "form login signup signin search register subscribe contact feedback captcha",
    "social": "social share sharing follow tweet facebook like tags tag byline meta author print rating vote",
}
WORD = {w: i for i, ws in enumerate(TOLD.values()) for w in ws.split()}
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*>|<([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>", re.S)
NAMES = re.compile(r"(?:class|id|role|itemprop|aria-label|data-[a-z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|visibility\s*:\s*hidden|aria-hidden\s*=\s*[\"']?true", re.I)
PARTS = re.compile(r"[a-z]+|[A-Z][a-z]*")


class Page:
    """Nodes in page order: parent, tag, attributes, and the text of text blocks."""

    __slots__ = ("attrs", "depth", "linked", "parent", "tags", "texts")

    def __init__(self, source: str):
        self.parent, self.depth, self.tags, self.attrs = [-1], [0], ["html"], [""]
        self.texts: list[str | None] = [None]
        self.linked: list[int] = [0]
        stack, names = [0], ["html"]
        places: dict[str, list[int]] = {}  # where each tag is open, so that deep pages cost no more per tag
        buffer: list[str] = []
        links = 0  # open links
        linked = 0
        opened = False

        def add(tag: str, attrs: str, text: str | None, link: int) -> int:
            self.parent.append(stack[-1])
            self.depth.append(len(stack))
            self.tags.append(tag)
            self.attrs.append(attrs)
            self.texts.append(text)
            self.linked.append(link)
            return len(self.parent) - 1

        def put(raw: str):
            nonlocal linked
            buffer.append(raw)
            if links:
                linked += len(raw)

        def flush():
            nonlocal linked
            if buffer:
                text = " ".join(entities.unescape("".join(buffer)).split())
                if text:
                    add("#text", "", text, min(linked, len(text)))
                buffer.clear()
            linked = 0

        def close(k: int):
            nonlocal links
            flush()
            links = 0
            for name in reversed(names[k:]):
                places[name].pop()
            del stack[k:], names[k:]

        def nearest(tags) -> int:
            return max((places[t][-1] for t in tags if places.get(t)), default=0)

        at, end = 0, len(source)
        while at < end:
            found = source.find("<", at)
            if found < 0:
                put(source[at:])
                break
            if found > at:
                put(source[at:found])
            m = TOKEN.match(source, found)
            if not m:
                put("<")
                at = found + 1
                continue
            at = m.end()
            if m[1]:
                tag = m[1].lower()
                if tag in INLINE:
                    if tag == "a" and links:
                        links -= 1
                elif places.get(tag) and tag != "body":
                    close(places[tag][-1])
                elif tag == "p" or tag in GROUP:
                    flush()
                continue
            tag = (m[2] or m[4] or "").lower()
            if not tag:
                continue
            attrs = m[3] or m[5] or ""
            if tag in RAW:
                shut = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(source, at)
                at = shut.end() if shut else end
                continue
            if tag in INLINE:
                if tag == "br":
                    put(" ")
                elif tag == "a":
                    links = 1
                continue
            flush()
            if tag in VOID:
                continue
            if tag == "html" or (tag == "body" and opened):
                if not opened:
                    self.attrs[0] = attrs
                continue
            if tag == "body":
                opened = True
            k = nearest(("p",))
            if k > nearest(("td", "th", "button", "object")):
                close(k)
            if tag in CLOSES:
                scope, k = nearest(SCOPE.get(tag, ())), nearest(CLOSES[tag])
                while k > scope:
                    close(k)
                    k = nearest(CLOSES[tag]) if tag in ("td", "th", "tr", "tbody", "tfoot") else 0
            places.setdefault(tag, []).append(len(stack))
            stack.append(add(tag, attrs, None, 0))
            names.append(tag)
        flush()


def told(attrs: str) -> int:
    """Bits of what the attribute words of an element tell; the last bit: hidden."""
    if not attrs:
        return 0
    bits = 1 << len(TOLD) if HIDDEN.search(attrs) else 0
    for m in NAMES.finditer(attrs):
        for w in PARTS.findall(m[1] or m[2] or m[3] or ""):
            i = WORD.get(w.lower())
            if i is not None:
                bits |= 1 << i
    return bits


FEATURES = (
    ["text block"] + [f"tag {g}" for g in GROUPS] + [f"own {k}" for k in (*TOLD, "hidden")] + [f"above {k}" for k in (*TOLD, "hidden")]
    + ["under article", "under nav", "under aside", "under footer", "under header", "under form", "under list", "depth", "log length", "link share", "log tags", "length per tag",
       "share of page", "paragraphs", "place", "siblings", "siblings' length", "stops per character", "ends with stop", "headings below", "share of parent", "first share"]
)
UNDER = (1, 9, 10, 11, 12, 13, 5)


def features(page: Page) -> np.ndarray:
    n = len(page.parent)
    length, link, tags, paragraphs, stops, heads, ends = ([0] * n for _ in range(7))
    own, above, under = [0] * n, [0] * n, [0] * n
    group = [GROUP.get(t, 7) for t in page.tags]
    children: list[list[int]] = [[] for _ in range(n)]
    for i in range(n):
        up = page.parent[i]
        own[i] = told(page.attrs[i])
        if up >= 0:
            children[up].append(i)
            above[i] = above[up] | own[up]
            under[i] = under[up] | 1 << group[up]
        t = page.texts[i]
        if t is not None:
            length[i], link[i] = len(t), page.linked[i]
            stops[i] = t.count(".") + t.count(",") + t.count("!") + t.count("?") + t.count(";")
            ends[i] = t[-1] in ".!?:;\"»”…"
        else:
            tags[i] = 1
    for i in range(n - 1, 0, -1):
        up = page.parent[i]
        length[up] += length[i]
        link[up] += link[i]
        tags[up] += tags[i]
        stops[up] += stops[i]
        paragraphs[up] += page.tags[i] == "p"
        heads[up] += heads[i] + (group[i] in (3, 4))
    whole = length[0] or 1
    k = len(TOLD) + 1
    x = np.zeros((n, len(FEATURES)), np.float32)
    g0 = 1 + len(GROUPS)
    for i in range(n):
        up = page.parent[i]
        row = x[i]
        if page.texts[i] is not None:
            row[0] = 1
            row[1 + group[up]] = 1
        else:
            row[1 + group[i]] = 1
        for b in range(k) if own[i] or above[i] else ():
            row[g0 + b], row[g0 + k + b] = own[i] >> b & 1, above[i] >> b & 1
        kin = children[up] if up >= 0 else [i]
        at = g0 + 2 * k
        size = length[i]
        row[at : at + len(UNDER)] = [under[i] >> g & 1 for g in UNDER]
        first = page.texts[i] is not None and kin[0] == i
        row[at + len(UNDER) :] = (
            page.depth[i], math.log1p(size), link[i] / size if size else 0, math.log1p(tags[i]), math.log1p(size / (1 + tags[i])), size / whole, paragraphs[i], 0, len(kin),
            math.log1p((length[up] - size) / max(1, len(kin) - 1)) if up >= 0 else 0, stops[i] / size if size else 0, ends[i], heads[i], size / (length[up] or 1) if up >= 0 else 1, first,
        )
    for kin in children:
        for place, i in enumerate(kin):
            x[i, len(FEATURES) - 8] = place / len(kin)
    return x


def decode(page: Page, odds: np.ndarray) -> list[int]:
    """Nodes of the best set that holds the parent of each of its nodes."""
    worth = np.clip(odds, -6, 6).tolist()
    for i in range(len(worth) - 1, 0, -1):
        if worth[i] > 0:
            worth[page.parent[i]] += worth[i]
    kept = [False] * len(worth)
    for i, w in enumerate(worth):
        up = page.parent[i]
        kept[i] = w > 0 and (up < 0 or kept[up])
    return [i for i, k in enumerate(kept) if k]


# -- generated, labelled pages ---------------------------------------------------------------------
SYLLABLES = "an be co de er fi gra hol in ka lo mer no os pre qui ra sen ti und ver wo xi yel za ción ä é ou th tion".split()


def generated_page(rng: random.Random) -> tuple[str, list[str]]:
    """A page of random layout, and its main-text blocks in order."""
    main: list[str] = []

    def words(lo, hi, stop=True):
        ws = ["".join(rng.choices(SYLLABLES, k=rng.randint(1, 4))) for _ in range(rng.randint(lo, hi))]
        text, n = "", 0
        for w in ws:
            text += (" " if text else "") + (w.capitalize() if not n else w)
            n += 1
            if stop and n > 4 and rng.random() < 0.12:
                text, n = text + rng.choice(".,.!?"), 0 if rng.random() < 0.6 else n
        return text + ("." if stop and rng.random() < 0.9 else "")

    def keep(text):
        main.append(text)
        return text

    pick = rng.choice

    def name(*options):
        kind = pick(("class", "class", "id"))
        return f' {kind}="{pick(options)}"' if rng.random() < 0.9 else ""

    def link_list(n=None):
        items = "".join(f'<li><a href="/{words(1, 1, False)}">{words(1, 3, False)}</a></li>' for _ in range(n or rng.randint(2, 9)))
        return f"<ul>{items}</ul>"

    def menu():
        return pick((lambda: f"<nav{name('main-nav', 'navbar', 'menu')}>{link_list()}</nav>", lambda: f"<nav>{link_list()}</nav>", lambda: f'<div class="{pick(("menu", "nav-links", "breadcrumb", "pagination"))}">{link_list()}</div>'))()

    def advert():
        inner = pick((lambda: words(3, 40), lambda: f"<p>{words(3, 40)}</p>", lambda: f'<a href="/x">{words(3, 20)}</a>'))()
        return f'<{(t := pick(("div", "aside", "section")))} {pick(("class", "id"))}="{pick(("ad", "ads", "advert", "sponsored", "promo-box", "banner-ad", "ad-slot", "advertisement"))}">{inner}</{t}>'

    def notice():
        return f'<div {pick(("class", "id"))}="{pick(("cookie-notice", "notice", "consent-banner", "alert", "gdpr", "newsletter", "popup"))}"><p>{words(5, 40)}</p>{pick(("", "<button>OK</button>"))}</div>'

    def form():
        return f"<form{name('search', 'login', 'newsletter-form', 'contact')}><label>{words(1, 4, False)}</label><input><p>{words(2, 20)}</p><select><option>{words(1, 2, False)}</option></select><button>{words(1, 2, False)}</button></form>"

    def side():
        tag = pick(("aside", "aside", "div"))
        attr = f' class="{pick(("sidebar", "widget", "related", "popular-posts", "side"))}"' if tag == "div" or rng.random() < 0.6 else ""
        body = "".join(pick((lambda: f"<h3>{words(1, 4, False)}</h3>{link_list()}", lambda: f"<p>{words(4, 60)}</p>", advert))() for _ in range(rng.randint(1, 3)))
        return f"<{tag}{attr}>{body}</{tag}>"

    def comments():
        tag = pick(("div", "section", "ol"))
        item = pick(("div", "article", "li"))
        one = lambda: f'<{item} class="{pick(("comment", "reply", "comment-body"))}"><{pick(("b", "span"))}>{words(1, 2, False)}</b> <p>{words(3, 70)}</p></{item}>'
        return f'<{tag} {pick(("class", "id"))}="{pick(("comments", "comment-list", "discussion", "responses"))}"><h3>{words(1, 3, False)}</h3>{"".join(one() for _ in range(rng.randint(1, 6)))}</{tag}>'

    def social():
        return f'<div class="{pick(("share", "social-links", "tags", "post-meta"))}">{" ".join(f"<a href=x>{words(1, 2, False)}</a>" for _ in range(rng.randint(2, 6)))}</div>'

    def footer():
        inner = pick((lambda: f"&copy; {words(1, 2, False)} &middot; {words(2, 14)}", lambda: f"<p>&copy; {words(3, 25)}</p>{link_list()}", lambda: words(3, 30)))()
        return pick((lambda: f"<footer>{inner}</footer>", lambda: f'<div {pick(("id", "class"))}="{pick(("footer", "site-footer", "copyright"))}">{inner}</div>'))()

    def header():
        inner = pick((lambda: f"<h2>{words(1, 4, False)}</h2>", lambda: f'<a href="/">{words(1, 3, False)}</a><p>{words(2, 10, False)}</p>', lambda: f"<h1>{words(1, 3, False)}</h1>", lambda: words(1, 8, False)))()
        return pick((lambda: f"<header{name('site-header', 'masthead', 'top')}>{inner}{pick(('', menu()))}</header>", lambda: f'<div {pick(("id", "class"))}="{pick(("header", "masthead", "logo"))}">{inner}</div>'))()

    def paragraph():
        k = rng.random()
        if k < 0.72:
            text, lead = words(1, pick((3, 20, 80, 160))), words(1, 12)
            if rng.random() < 0.2:
                keep(f"{lead} {text}")
                return f"<p><b>{lead}{pick(('</b>', ''))}<br>{text}" + pick(("</p>", ""))
            if rng.random() < 0.25:
                keep(f"{text} {lead} end")
                return f'<p>{text} <a href="/y">{lead}</a> end</p>'
            return f"<p>{keep(text)}</p>"
        if k < 0.8:
            return f"<h{(h := rng.randint(2, 4))}>{keep(words(1, 7, False))}</h{h}>"
        if k < 0.87:
            return f"<{(t := pick(('ul', 'ol')))}>" + "".join(f"<li>{keep(words(2, 25))}</li>" for _ in range(rng.randint(2, 5))) + f"</{t}>"
        if k < 0.92:
            return f"<blockquote>{pick(('<p>', ''))}{keep(words(5, 40))}</blockquote>"
        if k < 0.95:
            return "<table>" + "".join("<tr>" + "".join(f"<td>{keep(words(1, 4, False))}</td>" for _ in range(3)) + "</tr>" for _ in range(2)) + "</table>"
        if k < 0.98:
            return f"<figure><img src=x><figcaption>{keep(words(2, 15))}</figcaption></figure>"
        return f"<pre>{keep(words(3, 20, False))}</pre>"

    def article():
        title = f"<h1>{keep(words(2, 12, rng.random() < 0.3))}</h1>" if rng.random() < 0.85 else ""
        if title and rng.random() < 0.15:
            title = f"<header>{title}</header>"
        body = ""
        short = rng.random() < 0.15
        if short:
            body = f"<p>{keep(words(1, 9))}</p>"
        for _ in range(0 if short else rng.randint(1, 14)):
            body += paragraph()
            if rng.random() < 0.07:
                body += pick((advert, social, side, form, notice))()
        tail = (comments() if rng.random() < 0.12 else "") + (f"<footer>{social()}</footer>" if rng.random() < 0.1 else "")
        tag = pick(("article", "article", "article", "main", "div", "div", "section"))
        attr = f' {pick(("class", "id"))}="{pick(("content", "post-content", "article-body", "entry", "story", "main", "post", "text"))}"' if (tag in ("div", "section") and rng.random() < 0.9) or rng.random() < 0.3 else ""
        wrap = pick(("", "", "<div>", '<div class="inner">', "<section>"))
        shut = "</" + wrap[1:].split()[0].rstrip(">") + ">" if wrap else ""
        return f"<{tag}{attr}>{title}{wrap}{body}{shut}{tail}</{tag}>"

    before = [x() for x in rng.sample((menu, header, advert, notice, form, side, social), rng.randint(0, 5))]
    after = [x() for x in rng.sample((comments, side, advert, social, form, notice, menu), rng.randint(0, 4))]
    if rng.random() < 0.85:
        after.append(footer())
    core = article()
    if rng.random() < 0.3:
        core = pick((f"<main>{core}{pick(('', side(), comments()))}</main>", f'<div class="container">{core}{pick(("", side()))}</div>', f'<div id="wrapper"><div class="row">{pick(("", side()))}{core}</div></div>'))
    head = f"<head><meta charset=utf-8><title>{words(1, 5)}</title><style>p{{margin:0}}</style></head>"
    return f"<!DOCTYPE html><html>{head}<body>{''.join(before)}<!-- {words(1, 3)} -->{core}{''.join(after)}{pick(('</body></html>', ''))}", main


#: Bound of the labelled sample: generated pages.
TRAINING_PAGES, DEPTH = 700, 4


def labels(page: Page, main: list[str]) -> np.ndarray:
    """1 for text blocks of the main text and for whatever holds one."""
    y = np.zeros(len(page.parent))
    want = iter([*main, None])
    now = next(want)
    for i, t in enumerate(page.texts):
        if t is not None and now is not None and t == " ".join(entities.unescape(now).split()):
            y[i] = 1
            now = next(want)
    for i in range(len(y) - 1, 0, -1):
        y[page.parent[i]] = max(y[page.parent[i]], y[i])
    return y


@lru_cache(1)
def model(pages: int = TRAINING_PAGES, seed: int = 3) -> trees.Flat:
    """Trees boosted on the generated pages; made on the driver and sent with the tasks."""
    rng = random.Random(seed)
    x, y = [], []
    for _ in range(pages):
        source, main = generated_page(rng)
        page = Page(source)
        x.append(features(page))
        y.append(labels(page, main))
    return trees.Flat(trees.boost(np.concatenate(x), np.concatenate(y), 50, DEPTH), DEPTH)


def extract(sources: list[str], boosted: trees.Flat) -> list[str]:
    pages = [Page(s) for s in sources]
    if not pages:
        return []
    rows = [features(p) for p in pages]
    odds = boosted.score(np.concatenate(rows))
    out, at = [], 0
    for page, x in zip(pages, rows):
        kept = decode(page, odds[at : at + len(x)])
        out.append(" ".join(page.texts[i] for i in kept if page.texts[i] is not None))
        at += len(x)
    return out


def main_text(pages: DataFrame, html: str = "html", key: str = "page_id", url: str = "url") -> DataFrame:
    """``key, url, text, n_chars`` of every page; null or textless html: an empty text.

    Rows map one to one, repeated ones too; null keys and urls stay null; other columns are ignored,
    whatever their names. Nesting and length are unbounded. Empty table: no rows.
    """
    boosted = model()

    def make():
        release()

        def step(keys, urls, sources):
            texts = []
            for at in range(0, len(sources), 128):
                texts += extract([s or "" for s in sources[at : at + 128]], boosted)
            return {"key": keys, "url": urls, "text": texts, "n_chars": list(map(len, texts))}

        return step

    out = arrow_map(pages.select(F.col(key).alias("key"), F.col(url).alias("url"), F.col(html).alias("html")), "key bigint, url string, text string, n_chars bigint", make)
    return out.withColumnRenamed("key", key).withColumnRenamed("url", url)
