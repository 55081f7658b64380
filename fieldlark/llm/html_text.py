"""Main text of web pages by the distribution of text over lines.

Markup is stripped into lines (blocks). Each line has a weight: its text length,
or zero where it belongs to a menu, header, footer, form, advert, comment and the
like, or lies outside the article that the page marks. Sums of the weights over
sliding windows rise at a surge point and fall to nothing at a dive point; the
text between each surge and the next dive is kept.
"""

from __future__ import annotations

import html
import re
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

WINDOW = 3  # lines in a window
SURGE = 80  # characters in a window that start a text on a page that marks no article

# fixed values: elements by their role in HTML
RAW = "script|style|noscript|template|textarea|iframe|svg|object|canvas|noframes|title"
BLOCKS = frozenset(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search "
    "section select summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
LEFT_OUT = frozenset(
    "head nav header footer aside form menu button select dialog search fieldset legend label audio video map".split())
MAIN = frozenset(("article", "main"))
CLOSED_BY_BLOCK = frozenset(("p",))
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th"}, "th": {"td", "th"},
            "option": {"option"}}
NOT_CONTENT = frozenset(
    "ad ads adv advert adverts advertisement adsense adslot banner banners breadcrumb breadcrumbs byline comment comments "
    "commentlist consent cookie cookies disclaimer discussion disqus feedback footer form gdpr header legal login masthead "
    "menu menus modal nav navbar navigation newsletter notice notices notification pager pagination paywall popup "
    "privacy promo promos promotion recommended related replies reply respond search share sharing sidebar signup skip "
    "social sponsor sponsored subscribe subscription tags teaser toolbar tooltip topbar widget widgets".split())
# words that name a part of an article as well as something beside it: on the text elements of an article they mean nothing
TOPICS = frozenset(
    "consent cookie cookies disclaimer discussion feedback footer header legal menu menus nav navigation notice notices "
    "notification notifications privacy promotion recommended related respond response search share sharing social "
    "subscription toolbar widget widgets".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
TEXT_PARTS = HEADINGS | frozenset(
    "section p blockquote pre figure figcaption dt dd table tr td th details summary".split())
# words that follow such a word where it names a part of the layout, not a subject
PLACES = frozenset(
    "area bar block body bottom box button buttons card cards center col column container content feed form group header "
    "footer icon icons inner item items layer left link links list main module outer panel position posts right row section "
    "slot space strip tab tabs title top unit wrap wrapper zone".split())
NOT_AN_ARTICLE = frozenset("comment comments reply replies teaser teasers".split())
NOT_CONTENT_ROLES = frozenset(
    "navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())

_PIECE = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>" + RAW + r")\b(?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][\w:-]*)(?P<attrs>(?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|</?[a-zA-Z][^<>]*+>|<[!?][^>]*+>", re.S | re.I)
_ATTR = re.compile(r"([a-zA-Z_:][\w:.-]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_HREF = re.compile(r"(?:^|\s)href\s*=", re.I)
_SENTENCE = re.compile(r"[.!?…。！？][\"'”’»)\]]*$")
_LAYOUT = re.compile(r"\b(?:has|with|no|without|is|js)[-_]\w+", re.I)  # words about the layout, not the element
_TAXONOMY = re.compile(r"(?:category|tag|post_tag|topic|author)[-_].+|comments?[-_](?:open|closed|on|off|status.*)", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


def says_not_content(name: str, key: str, value: str, inside: bool) -> bool:
    """Whether a class or an id says that an element holds no main text.

    A token counts as a whole: where all its words after a word of the list name places (nav-bar, comment-list-item) or
    are of the list too, and where it ends with such a word (site-footer, post-ad). One that goes on to something else
    is a subject (cookie-recipe), as are the tokens of a taxonomy (category-*, tag-*). Within an article words that
    may be a subject count at the end of a token only alone or after another word of the list, and on its text
    elements never; the id of a heading never counts, that of another text element not inside an article. An article
    goes only if it says that it is a comment or a teaser.
    """
    if key == "id" and (name in HEADINGS or inside and name in TEXT_PARTS):
        return False
    for token in _LAYOUT.sub("", value).split():
        words = [w.lower() for w in _WORD.findall(token)]
        if not words or _TAXONOMY.fullmatch(token):
            continue
        if name == "article":
            if words[0] in NOT_AN_ARTICLE or "comment" in words[:2] and key == "id" or len(words) == 1 and (
                    words[0] in NOT_CONTENT and words[0] not in TOPICS):
                return True
            continue
        if key == "id" and name in TEXT_PARTS and len(words) > 1:
            continue
        listed = NOT_CONTENT - TOPICS if inside and name in TEXT_PARTS else NOT_CONTENT
        if words[0] in listed and all(w in PLACES or w in NOT_CONTENT for w in words[1:]):
            return True
        if words[-1] in (NOT_CONTENT - TOPICS if inside else NOT_CONTENT):
            return True
    return False


def is_left_out(name: str, attrs: str, inside: bool = False) -> bool:
    """Whether an element, inside a marked article or not, holds no main text, by its name, role, class, id or being
    hidden."""
    if name in LEFT_OUT:
        return True
    if not attrs or name in ("body", "html", "main"):
        return False
    for key, a, b, c in _ATTR.findall(attrs):
        key, value = key.lower(), a or b or c
        if key in ("class", "id"):
            if says_not_content(name, key, value, inside):
                return True
        elif key == "role" and value.lower() in NOT_CONTENT_ROLES:
            return True
        elif key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            return True
        elif key == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return True
    return False


class Line(NamedTuple):
    text: str
    left: bool  # left out
    inside: bool  # in a marked article
    linked: int  # length of its link text
    holder: int  # number of the element that its block lies in


def lines_of(page: str) -> list[Line]:
    """Lines of a page in order."""
    lines: list[Line] = []
    stack: list[tuple[str, bool, int]] = []  # open elements: name, whether it is left out, its number
    open_at: dict[str, list[int]] = {}  # by name, where in the stack
    out = inside = linked = number = 0
    link: int | None = None  # the open elements around an open link
    text: list[str] = []

    def flush() -> None:
        nonlocal linked
        joined = " ".join(html.unescape("".join(text)).split())
        if joined:
            lines.append(Line(joined, out > 0, inside > 0, linked, stack[-2][2] if len(stack) > 1 else 0))
        text.clear()
        linked = 0

    def start(name: str, left: bool) -> None:
        nonlocal out, inside, number
        number += 1
        open_at.setdefault(name, []).append(len(stack))
        stack.append((name, left, number))
        out += left
        inside += name in MAIN and not left

    def close(name: str) -> None:
        """Closes the innermost open element of this name, with all in it."""
        nonlocal out, inside, link
        at = open_at[name][-1]
        while len(stack) > at:
            own, left, _ = stack.pop()
            open_at[own].pop()
            out -= left
            inside -= own in MAIN and not left
        if link is not None and link > len(stack):  # what it was opened in is closed
            link = None

    at = 0
    for m in _PIECE.finditer(page):
        piece = page[at: m.start()]
        at = m.end()
        if piece:
            text.append(piece)
            linked += len(piece) if link is not None else 0
        name = (m["name"] or "").lower()
        if not name:
            continue
        if name == "a":
            link = len(stack) if not m["end"] and _HREF.search(m["attrs"]) else None
            continue
        if name not in BLOCKS and name not in LEFT_OUT:
            if not m["end"] and name not in VOID and not m["attrs"].endswith("/") and is_left_out(
                    name, m["attrs"], inside > 0):
                flush()
                start(name, True)
            elif m["end"] and open_at.get(name):
                flush()
                close(name)
            elif not m["end"] and stack and stack[-1][:2] == (name, True):
                start(name, False)
            continue
        flush()
        if name in VOID:
            continue
        if m["end"]:
            if open_at.get(name):
                close(name)
            continue
        if name == "body" and open_at.get("head"):
            close("head")
        if stack and stack[-1][0] in CLOSED_BY_BLOCK:
            close(stack[-1][0])
        if stack and stack[-1][0] in SIBLINGS.get(name, ()):
            close(stack[-1][0])
        start(name, is_left_out(name, m["attrs"], inside > 0))
    if at < len(page):
        text.append(page[at:])
        linked += len(page) - at if link is not None else 0
    flush()
    return lines


def between(weights: np.ndarray, window: int, surge: int) -> np.ndarray:
    """Mask of the lines between surge and dive points of the window sums.

    A surge is a line whose window (it and the next ones) sums to *surge* or more and which has weight itself;
    its dive is the first line after it from which a whole window sums to zero.
    """
    n = len(weights)
    kept = np.zeros(n, bool)
    padded = np.concatenate([[0], np.cumsum(np.concatenate([weights, np.zeros(window, weights.dtype)]))])
    sums = padded[window: window + n] - padded[:n]
    i = 0
    while i < n:
        if weights[i] > 0 and sums[i] >= surge:
            j = i
            while j < n and sums[j] > 0:
                j += 1
            kept[i:j] = True
            i = j
        i += 1
    return kept


def main_text(page: str | None, window: int = WINDOW, surge: int = SURGE) -> str:
    """The main text of one page; empty where there is none."""
    if not page:
        return ""
    lines = lines_of(page)
    marked = any(x.inside and not x.left for x in lines)
    weights = np.array([
        0 if x.left or (marked and not x.inside) else len(x.text) if marked else max(len(x.text) - 2 * x.linked, 0)
        for x in lines], np.int64)
    kept = between(weights, window, 1 if marked else surge)
    if not kept.any():  # a page of a few short lines has no surge but its first line
        kept = between(weights, window, 1)
    # sentences that stand beside kept text go on with it, also behind a dive
    holders = {x.holder for x, keep, w in zip(lines, kept, weights) if keep and w and _SENTENCE.search(x.text[-12:])}
    kept |= np.array([bool(w) and x.holder in holders and _SENTENCE.search(x.text[-12:]) is not None
                      for x, w in zip(lines, weights)], bool)
    return " ".join(x.text for x, keep in zip(lines, kept) if keep and not x.left and (x.inside or not marked))


def extract(df: DataFrame, html_column: str = "html", text_column: str = "text", window: int = WINDOW,
            surge: int = SURGE) -> DataFrame:
    """*df* with the main text of each page in *text_column* (replaced if there).

    Null and empty pages, and pages without text, give an empty text; so does markup alone. Each row counts by
    itself, repeated ones too; an empty table stays empty.
    """
    @F.pandas_udf("string")
    def texts(pages: pd.Series) -> pd.Series:
        return pd.Series([main_text(p, window, surge) for p in pages], dtype=object)

    page: Column = F.col(f"`{html_column}`")
    return df.withColumn(text_column, texts(page))
