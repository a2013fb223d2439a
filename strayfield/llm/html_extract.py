"""The main text of a web page by two passes over its blocks.

A page is cut into blocks at block-level tags. Pass one looks at each block alone: a block inside a menu, header, footer,
sidebar, notice, advert or comment section, or in a form with little text for its controls, is bad, whatever its text; a block with many links is bad; a long block
with many stop words is good, one with few is bad; what is left (short, or of middling stop words) is undecided. Pass two
gives an undecided block the label of its nearest decided neighbours: equal labels settle it, and between a good and a
bad one it goes with the nearer, good at equal distance. Neighbours count inside the block's own section only, so a menu
next to an article doesn't decide for it: in an ``article`` or ``main`` section undecided blocks without a decided
neighbour are good, elsewhere bad. If a page marks an article, blocks outside it are no part of the main text.

Stop words exist for four languages. Where they don't fit, a long block with few links is good whatever its words, and so
is a shorter one that ends as a sentence does: in a block of mostly other than Latin letters, and in all blocks of a page
whose text (weighed by length, links and bad places left out) has few stop words on the whole. A Chinese, Japanese or
Korean character counts as three.

What an element is called condemns it if a part of a class name says so by itself (``ad-box``), or if the whole name does
(``sidebar``, ``main-menu``, ``cookie-notice``). A whole name that may as well hold text (``notice``, ``widget``) only
makes its element a place of its own: its long blocks are judged by their text, its short ones by those inside it. Such
words as a part of a name (``elementor-widget-container``) say nothing, and ``ad-free`` is no advert. A form is a place of its
own while it is judged; one around the text of a page is none. ``hidden`` is the attribute, not a word in one.

Each page is handled by itself: no shuffle. Edge cases: a NULL or empty page has an empty text; unclosed tags, tags cut off
at the end of the page and unknown character references are read as browsers do; repeated pages are extracted alike.
"""

from __future__ import annotations

import html as entities
import re

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from strayfield.llm.common import replace

# HTML element names, and the commonest words of four languages.
SKIPPED = frozenset("script style noscript template iframe object svg math canvas select textarea button head title".split())
RAW = frozenset("script style textarea title noscript iframe".split())
BAD = frozenset("nav header footer aside dialog menu".split())
SECTIONS = frozenset("article main".split())
FOREIGN_ROOTS = frozenset("svg math".split())  # inside them, and for them, a slash closes an element
CONTROLS = frozenset("input select textarea button".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCKS - {"option", "col", "colgroup", "caption", "body", "html"}
STOP_WORDS = frozenset(
    "a an and are as at be been but by for from had has have he her his i in is it its not of on or she that the their they this to was we were which with you"
    " au aux avec ce ces dans de des du elle en est et il ils je la le les leur mais ne nous on ou par pas plus pour qu que qui sa se ses son sont sur un une vous"
    " aber als am an auch auf aus bei das dass dem den der des die ein eine einem einen einer er es für hat ich ihr im ist mit nach nicht noch oder sich sie sind so über um und uns von vor war wie wir zu zum zur"
    " al como con del el ella ellos era es esta este ha hay las lo los más me mi muy no nos o para pero por que se sin sobre su sus también un una y ya".split()
)
FIRM = frozenset(  # condemn as any part of a name
    "ad ads advert adverts advertisement advertisements advertising adbox adsense sponsored promo navbar breadcrumb breadcrumbs masthead"
    " comment comments disqus pagination".split()
)
WHOLE = frozenset(  # condemn as a whole name
    "sponsor promotion nav menu footer sidebar cookie cookies consent gdpr notification popup modal newsletter subscribe signup login social"
    " sharing related recommended reply replies respond pager toolbar navigation contentinfo complementary dialog".split()
)
LAST = frozenset("footer menu nav navigation pager toolbar".split())  # condemn as the last part of a name as well
DOUBTFUL = frozenset("widget header notice notices share search alert banner".split())  # as a whole name: a place of its own
ROLES = frozenset("banner search alert alertdialog dialog navigation contentinfo complementary menu menubar toolbar".split())
AROUND = frozenset("site main top bottom global primary secondary mobile bar box".split())  # may stand beside them in a whole name
FOREIGN = frozenset("comment comments reply replies related recommended ad ads advert advertisement sponsored promo".split())
SECTIONED = frozenset("article main".split())  # condemned by the names in FOREIGN only
SAFE = frozenset("html body".split())
QUALIFIED = frozenset("free supported blocker".split())  # beside them a word such as ad says nothing
LONG, SHORT = 200, 70  # characters
PER_CONTROL = 150  # characters of a form for each of its controls, and for one at least, from which on its text counts
MANY, FEW = 0.20, 0.08  # stop words among the words
FITS = 0.15  # stop words on a page in one of the four languages
LINKED, ARTICLE_LINKED = 0.33, 0.9  # characters inside links

TOKEN = re.compile(r"<!--(?:-?>|.*?(?:--!?>|$))|<(?:!|\?)[^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+(?:[\"'][^>]*)?)(?:>|$)", re.S)
ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?")
HREF = re.compile(r"(?:^|[\s\"'/])href\s*=", re.I)
TELLING = re.compile("class|id|role|hidden|style", re.I)
PARTS = re.compile(r"[^a-z0-9]+")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
LAYOUT = re.compile("(?:has|with|no|without|is|sticky|category|tag)[-_]")  # says what an element has or is about, not what it is
WIDE = re.compile("[\u1100-\u11ff\u3005-\u30ff\u3130-\u318f\u31f0-\u31ff\u3400-\u9fff\uac00-\ud7af\uf900-\ufaff\U00020000-\U0003ffff]")
SENTENCE = re.compile("[.!?\u2026;\u037e\u0589\u06d4\u061f\u0964\u0965\u1362\u104b\u17d4\u3002\uff0e\uff01\uff1f\uff61][\\s\"'\u2019\u201d\u00bb)\\]\u300d\u300f\uff09]*$")
CLEAR, DOUBT, CONDEMNED = 0, 1, 2


def named(name: str) -> int:
    """What one class name or id says of its element."""
    parts = [p for p in PARTS.split(name) if p]
    if not parts or LAYOUT.match(name) or not QUALIFIED.isdisjoint(parts):
        return CLEAR
    if not FIRM.isdisjoint(parts) or parts[-1] in LAST:
        return CONDEMNED
    if not all(p in WHOLE or p in DOUBTFUL or p in AROUND for p in parts):
        return CLEAR
    return CONDEMNED if not WHOLE.isdisjoint(parts) else CLEAR if DOUBTFUL.isdisjoint(parts) else DOUBT


def judged(tag: str, attributes: str) -> int:
    """What an element's tag and attributes say of its text."""
    if tag in BAD:
        return CONDEMNED
    if tag in SAFE or not TELLING.search(attributes):
        return CLEAR
    out = CLEAR
    for found in ATTRIBUTE.finditer(attributes):
        key, value = found[1].lower(), (found[2] or found[3] or found[4] or "").lower()
        if key in ("class", "id", "role"):
            for name in value.split():
                if tag in SECTIONED:
                    if not LAYOUT.match(name) and not FOREIGN.isdisjoint(PARTS.split(name)):
                        return CONDEMNED
                elif key == "role":
                    out = CONDEMNED if name in ROLES else out
                else:
                    out = max(out, named(name))
        elif tag not in SECTIONED and (
            (key == "hidden" and not value.startswith("until")) or (key == "aria-hidden" and value.strip() == "true") or (key == "style" and HIDDEN.search(value))
        ):
            return CONDEMNED
    return out


def blocks(page: str) -> list[tuple[str, int, bool, int, int]]:
    """``(text, linked characters, bad by its place, article section, doubtful element)`` of each block with a text; 0 is none."""
    out: list[tuple[str, int, bool, int, int]] = []
    stack: list[tuple[str, bool, int, int]] = []  # open elements: name, bad from here on, section, doubtful element
    links: list[int] = []  # places in the stack of the open links
    forms: list[list[int]] = []  # open forms: place in the stack, first block, controls, doubtful element, the one around it
    texts: list[str] = []
    linked, skip, foreign, bad, section, doubt, sections, doubts, at = 0, 0, 0, False, 0, 0, 0, 0, 0

    def flush() -> None:
        nonlocal linked, texts
        text = " ".join("".join(texts).split())
        if text:
            out.append((text, linked, bad, section, doubt))
        linked, texts = 0, []

    def add(raw: str) -> None:
        nonlocal linked
        if raw and not skip:
            text = entities.unescape(raw) if "&" in raw else raw
            texts.append(text)
            if links:
                linked += len("".join(text.split()))

    def settle(_: int, first: int, controls: int, own: int, around: int) -> None:
        """A form with little text for its controls is bad; one around a page's text is no place of its own."""
        little = sum(len(b[0]) for b in out[first:]) < PER_CONTROL * max(1, controls)
        for i in range(first, len(out)):
            text, of_links, was_bad, where, place = out[i]
            out[i] = (text, of_links, was_bad or little, where, around if place == own else place)

    def close(n: int) -> None:
        """Close the elements from place ``n`` of the stack on."""
        nonlocal bad, section, doubt, foreign, skip
        for name, *_ in stack[n:]:
            foreign -= name in FOREIGN_ROOTS
            skip -= name in SKIPPED
        del stack[n:]
        while links and links[-1] >= n:
            links.pop()
        while forms and forms[-1][0] >= n:
            settle(*forms.pop())
        bad, section, doubt = stack[-1][1:] if stack else (False, 0, 0)

    end = len(page)
    while at < end:
        found = TOKEN.search(page, at)
        if not found:
            add(page[at:])
            break
        add(page[at : found.start()])
        at = found.end()
        tag = found[2]
        if tag is None:
            continue
        tag = tag.lower()
        if found[1]:  # an end tag closes up to its start tag; without one it is ignored
            if tag in BLOCKS:
                flush()
            elif tag == "br":
                texts.append(" ")
            for n in range(len(stack) - 1, -1, -1):
                if stack[n][0] == tag:
                    close(n)
                    break
                if tag not in BLOCKS and stack[n][0] in BLOCKS:
                    break
            continue
        if tag in BLOCKS:
            flush()
            if stack and stack[-1][0] == "head" and tag != "html":
                close(len(stack) - 1)
            if tag in CLOSES_P:
                for n in range(len(stack) - 1, -1, -1):
                    if stack[n][0] == "p":
                        close(n)
                        break
                    if stack[n][0] in BLOCKS:
                        break
        elif tag in ("br", "img"):
            texts.append(" ")
        attributes = found[3] or ""
        if forms and tag in CONTROLS and "hidden" not in attributes.lower():
            forms[-1][2] += 1
        if tag in VOID or (attributes.endswith("/") and (foreign or tag in FOREIGN_ROOTS)):
            continue
        if tag in RAW and not foreign:
            stop = re.compile(rf"</{tag}\b[^>]*(?:>|$)", re.I).search(page, at)
            at = stop.end() if stop else end
            continue
        if tag == "a":  # a link ends where the next one begins
            for n in range(len(stack) - 1, -1, -1):
                if stack[n][0] == "a":
                    close(n)
                    break
                if stack[n][0] in BLOCKS:
                    break
        says = judged(tag, attributes)
        bad = bad or says == CONDEMNED
        if tag in SECTIONS and not section:
            sections += 1
            section, doubt = sections, 0
        elif says == DOUBT or tag == "form":
            doubts += 1
            if tag == "form":
                forms.append([len(stack), len(out), 0, doubts, doubt])
            doubt = doubts
        stack.append((tag, bad, section, doubt))
        if tag == "a" and HREF.search(attributes):
            links.append(len(stack) - 1)
        foreign += tag in FOREIGN_ROOTS
        skip += tag in SKIPPED
    flush()
    close(0)
    return out


def latin(text: str) -> bool:
    """Whether at least half of the letters are Latin ones."""
    if text.isascii():
        return True
    letters = [c for c in text if c.isalpha()]
    return 2 * sum(c < "\u0250" or "\u1e00" <= c < "\u1f00" for c in letters) >= len(letters)


def length(text: str) -> int:
    return len(text) if text.isascii() else len(text) + 2 * len(WIDE.findall(text))


def density(text: str) -> float:
    """The share of stop words among the words."""
    words = re.findall(r"[^\W\d_]+", text.lower())
    return sum(map(STOP_WORDS.__contains__, words)) / max(1, len(words))


def linking(text: str, linked: int, section: int) -> bool:
    return linked > (ARTICLE_LINKED if section else LINKED) * len(text.replace(" ", ""))


def fitting(parts: list[tuple[str, int, bool, int, int]]) -> bool:
    """Whether the page's Latin text is in a language of the stop words."""
    texts = [text for text, linked, bad, _, _ in parts if not bad and len(text) >= SHORT and not linking(text, linked, 0) and latin(text)]
    return sum(len(t) * density(t) for t in texts) >= FITS * sum(map(len, texts))


def first_pass(text: str, linked: int, bad: bool, section: int, fits: bool = True) -> int:
    """1 good, -1 bad, 0 undecided. In a marked article few stop words don't condemn: it may hold tables or code."""
    if bad or linking(text, linked, section):
        return -1
    size = length(text)
    if size < SHORT:
        return 0
    share = density(text)
    if share >= MANY or (size >= LONG and share >= FEW):
        return 1
    if not fits or not latin(text):
        return 1 if size >= LONG or SENTENCE.search(text) else 0
    return 0 if section or size < LONG or share > 0 else -1


def second_pass(labels: list[int], places: list[tuple[int, int]]) -> list[int]:
    """Undecided blocks take the label of their nearest decided neighbours in the same place: section and doubtful element."""
    n = len(labels)
    before, after = _nearest(labels, places, range(n)), _nearest(labels, places, range(n - 1, -1, -1))
    out = list(labels)
    for i, label in enumerate(labels):
        if label == 0:
            (b, bd), (a, ad) = before[i], after[i]
            if b == 0 and a == 0:
                out[i] = 1 if places[i][0] and not places[i][1] else -1
            elif b == 0 or a == 0 or a == b:
                out[i] = a or b
            else:
                out[i] = b if bd < ad else a if ad < bd else 1
    return out


def _nearest(labels: list[int], places: list[tuple[int, int]], order: range) -> dict[int, tuple[int, int]]:
    found, last = {}, {}
    for i in order:
        label, where = last.get(places[i], (0, 0))
        found[i] = label, abs(i - where)
        if labels[i]:
            last[places[i]] = labels[i], i
    return found


def main_text(page: str | None) -> str:
    """The main text: white space inside a block is one space, and blocks are joined by one space."""
    parts = blocks(page or "")
    if any(section and not bad for _, _, bad, section, _ in parts):
        parts = [p for p in parts if p[3] and not p[2]]  # the page says where its article is; an advert in it is no neighbour
    fits = fitting(parts)
    labels = second_pass([first_pass(*p[:4], fits) for p in parts], [p[3:] for p in parts])
    return " ".join(p[0] for p, label in zip(parts, labels) if label > 0)


def extracted(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` without its html, with ``text`` (the main text) and ``n_chars`` (its code points)."""

    @F.pandas_udf("string")
    def text_of(page: pd.Series) -> pd.Series:
        return page.map(main_text, na_action=None).astype(object)

    out = replace(pages, text=text_of(F.col(f"`{html}`"))).drop(html)
    return replace(out, n_chars=F.length("text").cast("long"))

