"""Main text of web pages by the distribution of text over line blocks.

Markup is stripped into lines, one for each block of text. Lines in a menu, footer, sidebar, notice, advert,
form or comment element (by tag, role, class or id) are left out; the others weigh their characters
outside links. Weights are summed over windows of three lines, and the page's heaviest window
sets the scale: a surge is where a window sum reaches an eighth of it, a dive where it falls back to zero.
Weighted lines between a surge and its dive are the main text. An article or main element bounds the text if
one of its own windows reaches a surge; inside it every weighted line counts, and so does the text of links. An
element that holds only a teaser therefore does not hide the text beside it.

Reading a page takes time in proportion to its length, whatever its markup: very long texts, unclosed
quotes, tags, comments and scripts included.

Defined cases: a missing or empty page gives an empty text; unclosed and crossing tags are
tolerated; a ``<`` that starts no tag is text; a quote counts only after ``=``; an unclosed comment or script runs to the
end of the page; repeated rows give equal rows; extra columns pass through.
"""
from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from .tables import map_texts

WINDOW = 3
SHARE = 8

_OPEN = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
_STOP = re.compile(r">|=\s*[\"']")
_RAW = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I) for name in ("script", "style", "noscript", "template", "textarea", "title")}
_ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HREF = re.compile(r"(?<![\w-])href\s*=", re.I)
_NAME = re.compile(r"[A-Za-z]+")
# Elements that begin a new block of text.
_BLOCK = frozenset("""address article aside blockquote body br button canvas caption center dd details dialog dir div dl dt
    fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html iframe legend li main menu nav ol option
    p pre section select summary table tbody td tfoot th thead tr ul video""".split())
# Elements that never hold main text.
_ASIDE = frozenset("nav footer aside form menu select button dialog iframe svg head".split())
# Words in class, id or role that mark such elements.
_MARKS = frozenset("""ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments
    complementary consent contentinfo cookie cookies copyright disqus footer menu modal nav navbar navigation newsletter
    notice notices popup promo promoted related respond search share sharing sidebar social sponsor sponsored subscribe
    widget""".split())
_HEADER = frozenset(["header", "masthead", "topbar"])
# A name with one of these words tells what a page has, not what the element is ("has-sidebar").
_STATES = frozenset("has no not with without open closed is".split())
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_MAIN = frozenset(["article", "main"])
_IN_HEAD = frozenset("base head link meta noscript script style template title".split())


def _is_aside(tag: str, attributes: str, in_main: bool) -> bool:
    if tag in ("main", "body", "html"):
        return False
    if tag in _ASIDE or (tag == "header" and not in_main):
        return True
    for match in _ATTRIBUTE.finditer(attributes):
        for name in (match[2] or match[3] or match[4] or "").lower().split():
            words = set(_NAME.findall(name))
            if not words & _STATES and (words & _MARKS or (not in_main and tag != "article" and words & _HEADER)):
                return True
    return False


def _tags(page: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """Start, end, name, whether it closes, and attributes of each tag; markup to drop has no name.

    Every search that fails is not made again, so no part of the page is read more than a few times.
    """
    at, last = 0, page.rfind(">")
    quoted, absent = True, set()
    while (at := page.find("<", at)) >= 0:
        name, closes, attributes = "", False, ""
        if at > last or page.startswith("<!--", at):
            at = page.find("<!--", at)
            if at < 0:
                return
            end = page.find("-->", at + 4)
            end = len(page) if end < 0 else end + 3
        elif page[at + 1] in "!?":
            end = page.find(">", at) + 1
        elif found := _OPEN.match(page, at):
            begin = pos = found.end()
            end = 0
            while quoted and not end:
                stop = _STOP.search(page, pos)
                if not stop:
                    quoted = False
                elif stop[0] == ">":
                    end = stop.end()
                else:
                    pos, quote = stop.end(), stop[0][-1]
                    close = -1 if quote in absent else page.find(quote, pos)
                    if close < 0:
                        absent.add(quote)
                    else:
                        pos = close + 1
            end = end or page.find(">", begin) + 1
            name, closes, attributes = found[2].lower(), bool(found[1]), page[begin:end - 1]
            if not closes and name in _RAW:
                close = _RAW[name].search(page, end)
                name, end = "", close.end() if close else len(page)
        else:
            at += 1
            continue
        yield at, end, name, closes, attributes
        at = end


def lines_of(page: str) -> tuple[list[str], list[int], list[bool]]:
    """The page's text blocks outside aside elements, with their weights, and which stand in an article or main element."""
    lines: list[str] = []
    weights: list[int] = []
    inside: list[bool] = []
    stack: list[tuple[str, bool, bool]] = []     # tag, is aside, is main
    held: Counter = Counter()                    # open tags
    asides = mains = linked = 0
    in_p = p_aside = False
    link: tuple[int, bool] | None = None         # open elements when the link began, and whether it began in a paragraph
    block: list[str] = []

    def flush() -> None:
        nonlocal linked
        if block and not asides and not p_aside:
            line = " ".join("".join(block).split())
            if line:
                lines.append(line)
                weights.append(max(0, len(line) - linked))
                inside.append(mains > 0)
        block.clear()
        linked = 0

    def say(raw: str) -> None:
        nonlocal linked
        if raw:
            text = html.unescape(raw)
            block.append(text)
            if link and not mains:
                linked += len(text.strip())

    def close(tag: str) -> None:
        nonlocal asides, mains, link
        while held[tag]:
            name, aside, main = stack.pop()
            held[name] -= 1
            asides -= aside
            mains -= main
            if name == tag:
                break
        if link and len(stack) < link[0]:
            link = None

    at = 0
    for start, end, tag, closes, attributes in _tags(page):
        say(page[at:start])
        at = end
        if not tag:
            continue
        if tag == "a":
            link = (len(stack), in_p) if not closes and _HREF.search(attributes) else None
            continue
        if tag in _BLOCK:
            flush()
            if tag != "br":
                in_p = p_aside = False
                if link and link[1]:
                    link = None
        if closes:
            close(tag)
            continue
        if held["head"] and stack[-1][0] == "head" and tag not in _IN_HEAD:
            close("head")
        if tag == "p":
            in_p, p_aside = True, _is_aside(tag, attributes, mains > 0)
        elif tag not in _VOID and not attributes.endswith("/"):
            aside, main = _is_aside(tag, attributes, mains > 0), tag in _MAIN
            if tag in _BLOCK or aside:
                flush()
                stack.append((tag, aside, main))
                held[tag] += 1
                asides += aside
                mains += main
    say(page[at:])
    flush()
    return lines, weights, inside


def _sums(weight: np.ndarray, window: int) -> np.ndarray:
    """Of each line and those after it, as many as the window takes."""
    total = np.concatenate([[0], np.cumsum(weight)])
    return total[np.minimum(np.arange(len(weight)) + window, len(weight))] - total[:-1]


def main_text(page: str, window: int = WINDOW, share: int = SHARE) -> str:
    lines, weights, inside = lines_of(page)
    weight = np.array(weights, np.int64)
    sums = _sums(weight, window)
    surge = max(1, int(sums.max(initial=0)) // share)
    own = np.where(np.array(inside, bool), weight, 0)
    own_sums = _sums(own, window)
    if own_sums.max(initial=0) >= surge:
        weight, sums, surge = own, own_sums, 1
    kept = []
    begun = False
    for line, w, s in zip(lines, weight.tolist(), sums.tolist()):
        begun = s > 0 and (begun or s >= surge)
        if begun and w:
            kept.append(line)
    return " ".join(kept)


def extract(pages: DataFrame, keep: list[str] | None = None, page: str = "html") -> DataFrame:
    """Kept columns, text and n_chars of every page."""
    def run(texts: pa.Array) -> list:
        found = [main_text(t) for t in texts.to_pylist()]
        return [found, [len(t) for t in found]]

    fields = [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]
    return map_texts(pages, pages.columns if keep is None else keep, fields, run, text=page)
