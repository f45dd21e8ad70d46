"""Main text of web pages by the distribution of line blocks.

Markup is stripped to lines: a block element starts a new line, and elements that are no prose by their meaning (head, scripts,
menus, footers, headers outside the article, and those whose class names say nothing but advert, comment, cookies and the like)
leave a gap. A line's weight is its text outside links; headings and long linked lines weigh whole. Sums of weights over a window of
the lines from each on surge to ``SURGE`` where text starts and dive to nothing where it ends; what stands between a surge and the
next dive is kept, also its short lines.

An article or main element is one stretch: where such elements hold most of the text that surges, each that surges is kept
whole and nothing else is. Other class names (notice, related, legal, share and the like) and forms are weak evidence: such a part is left out
unless it wraps the page's text, that is holds a main heading, a main element or the page's first article, or nothing else surges.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oddsmill.llm._shared import by_bytes, table

WINDOW = 3
SURGE = 86
LONG_LINK = 80
# Element names of the HTML standard by what they hold.
_SKIPPED = frozenset("head script style noscript template svg math iframe object canvas select option textarea button nav footer aside dialog menu audio video map title".split())
_RAW = frozenset("script style noscript template textarea title iframe svg math".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html "
    "legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_HOLDERS = frozenset("div section article main body td form fieldset".split())
_UNIT = frozenset("article main".split())
# Words of class names and ids: those that say boilerplate, those that may, and those that say nothing.
_STRONG = frozenset(
    "ad ads advert adverts advertisement advertising adsbygoogle sponsor sponsored cookie cookies consent gdpr newsletter subscribe signup login nav navbar navigation menu breadcrumb breadcrumbs "
    "sidebar comment comments replies disqus footer masthead topbar toolbar pagination pager popup modal".split()
)
_WEAK = frozenset("notice alert banner promo promotion overlay side rail widget related recommended share sharing social respond discussion header copyright legal disclaimer form search feedback survey rating privacy".split())
_UNLESS = frozenset("free less no none off without with has enabled disabled closed open count article story".split())
_NEUTRAL = frozenset("box wrapper wrap container block slot area section list item items top bottom left right inner outer content body text panel bar unit zone group row col column primary secondary global site page reader user post posts the".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())
_MARKED = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_NAME, _STOP, _FILLED, _BARE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)"), re.compile("[=>]"), re.compile(r"\s*"), re.compile(r"[^\s>]*")
_WORDS = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]*")


_CLOSING = {name: re.compile(rf"</{name}\s*>", re.I) for name in _RAW}


@dataclass
class Line:
    text: str
    weight: int
    unit: int  # number of the outermost article or main element around it, 0 outside any
    part: int  # number of the outermost part with weak evidence around it, 0 outside any
    holder: int  # number of the element that holds it
    stretch: int  # lines with a gap between them have different ones


def evidence(name: str, attributes: str, in_unit: bool) -> str:
    """What an element's name, class, id and role say of it: ``strong``, ``weak`` or nothing.

    A class name or id counts by its words: strong if one of them, at the front or among at least as many listed words as others, says
    boilerplate; weak, on a block, if one that may does so. Words that turn the meaning (ad-free, has-sidebar) take it out.
    """
    if name in _SKIPPED or (name == "header" and not in_unit):
        return "strong"
    found = "weak" if name == "form" else ""
    if name in ("html", "body", "main") or not attributes:
        return found
    for key, *values in _MARKED.findall(attributes):
        key, value = key.lower(), next((v for v in values if v), "")
        if key == "hidden" or (key == "aria-hidden" and value.lower() == "true") or (key == "role" and value.lower() in _ROLES):
            return "strong"
        if key in ("class", "id"):
            for one in value.split():
                words = [w.lower() for w in _WORDS.findall(one) if len(w) > 1]
                if not words or _UNLESS & set(words):
                    continue
                likely = words[0] in _STRONG or 2 * sum(w in _STRONG | _WEAK | _NEUTRAL for w in words) >= len(words)
                if likely and _STRONG & set(words):
                    return "strong"
                if (likely or words[0] in _WEAK) and _WEAK & set(words) and name in _BLOCK:
                    found = "weak"
    return found


def tags(page: str):
    """Tags, comments and declarations of a page in order: start, end, name (None for those that are no tag), whether it closes, and its
    attributes as they stand. One pass: a quote counts only behind an equals sign and if it is closed; what is never closed is text."""
    last, lost = page.rfind(">"), {'"': False, "'": False}
    at = page.find("<")
    while 0 <= at < last:
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            end = len(page) if end < 0 else end + 3
            yield at, end, None, False, ""
        elif page.startswith("<![CDATA[", at) and (end := page.find("]]>", at + 9)) >= 0:
            end += 3
            yield at, end, None, False, ""
        elif page[at + 1] in "!?":
            end = page.find(">", at) + 1
            yield at, end, None, False, ""
        elif m := _NAME.match(page, at):
            end = m.end()
            while (stop := _STOP.search(page, end)) and stop[0] != ">":
                end = _FILLED.match(page, stop.end()).end()
                quote = page[end : end + 1]
                if quote in lost and quote and not lost[quote]:
                    close = page.find(quote, end + 1)
                    lost[quote] = close < 0
                    end = close + 1 if close >= 0 else end + 1
                else:
                    end = _BARE.match(page, end).end()
            if stop is None:
                return  # never closed
            yield at, stop.end(), m[2].lower(), bool(m[1]), page[m.end() : stop.start()]
            end = stop.end()
        else:
            end = at + 1
        at = page.find("<", end)
    if at >= 0 and page.startswith("<!--", at):
        yield at, len(page), None, False, ""


def to_lines(page: str) -> list[Line]:
    """The lines of text of a page outside what is boilerplate by strong evidence."""
    lines: list[Line] = []
    text: list[str] = []
    weight = linked = 0
    stack: list[tuple[str, int]] = []  # element and its number
    holders: list[tuple[int, int]] = []  # places in the stack of elements that hold lines, and their numbers
    opened: Counter[str] = Counter()  # elements of the stack by name
    skip_from = unit_from = part_from = -1  # places in the stack of the outermost such elements
    links = headings = unit = part = stretch = count = articles = 0
    wraps: set[int] = set()  # weak parts that hold the page's text
    at = 0

    def flush() -> None:
        nonlocal weight, linked
        line = " ".join("".join(text).split())
        if line:
            holder = holders[-1][1] if holders else 0
            lines.append(Line(line, weight + (linked if headings or linked >= LONG_LINK else 0), unit, part, holder, stretch))
        text.clear()
        weight = linked = 0

    def say(raw: str) -> None:
        nonlocal weight, linked
        if skip_from < 0 and raw:
            said = html.unescape(raw)
            text.append(said)
            if links:
                linked += len(said.strip())
            else:
                weight += len(said.strip())

    def drop(k: int) -> None:
        opened.subtract(x for x, _ in stack[k:])
        del stack[k:]
        while holders and holders[-1][0] >= k:
            holders.pop()

    for begin, end, name, closes, attributes in tags(page):
        if begin < at:
            continue
        say(page[at:begin])
        at = end
        if name is None:
            if page.startswith("<![CDATA[", begin):
                say(html.escape(page[begin + 9 : end - 3]))
            continue
        if closes:
            k = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name), -1) if opened[name] else -1
            if k >= 0:
                if skip_from < 0 and (name in _BLOCK or any(0 <= x and k <= x for x in (unit_from, part_from))):
                    flush()
                links -= sum(x == "a" for x, _ in stack[k:])
                headings -= sum(x in _HEADINGS for x, _ in stack[k:])
                drop(k)
                if k <= unit_from:
                    unit, unit_from = 0, -1
                if k <= part_from:
                    part, part_from = 0, -1
                if k <= skip_from:
                    skip_from, stretch = -1, stretch + 1
            elif name in _BLOCK and skip_from < 0:
                flush()
            continue
        if name in _VOID:
            if skip_from < 0:
                if name == "hr":
                    flush()
                elif name == "br":
                    text.append(" ")
            continue
        if name in _BLOCK:
            if skip_from < 0:
                flush()
            while stack and stack[-1][0] == "p":
                drop(len(stack) - 1)
        if attributes.rstrip().endswith("/") and name not in _BLOCK:
            continue
        count += 1
        if skip_from < 0:
            says = evidence(name, attributes, unit_from >= 0)
            if says == "strong":
                flush()
                skip_from, stretch = len(stack), stretch + 1
            elif says == "weak" and part_from < 0:
                flush()
                part, part_from = count, len(stack)
            if skip_from < 0 and name in _UNIT and unit_from < 0:
                unit, unit_from = count, len(stack)
            if skip_from < 0 and part and (name in ("h1", "main") or name == "article" and not articles):
                wraps.add(part)
            articles += skip_from < 0 and name == "article"
        if name in _HOLDERS:
            holders.append((len(stack), count))
        stack.append((name, count))
        opened[name] += 1
        links += name == "a"
        headings += name in _HEADINGS
        if name in _RAW:
            closing = _CLOSING[name].search(page, at)
            at = closing.start() if closing else len(page)
    say(page[at:])
    flush()
    for x in lines:
        x.part = 0 if x.part in wraps else x.part
    return lines


def window_sums(weights: np.ndarray, group: np.ndarray) -> np.ndarray:
    """For each line, the weight of the window of lines from it on that are in its group."""
    out = np.zeros(len(weights), np.int64)
    for k in range(WINDOW):
        out[: len(out) - k] += np.where(group[k:] == group[: len(out) - k], weights[k:], 0)
    return out


def surging(weights: np.ndarray, sums: np.ndarray, group: np.ndarray, least: int) -> np.ndarray:
    """Which lines stand between a surge of the sums to ``least`` and their next dive to nothing, group by group; lines without
    weight at either end are no text."""
    kept = np.zeros(len(sums), bool)
    start = last = -1  # of the run: its first line with weight, and its latest
    for i in range(len(sums)):
        if start >= 0 and (group[i] != group[start] or not sums[i]):
            kept[start : last + 1] = True
            start = -1
        if start < 0 and sums[i] >= least and weights[i]:
            start = i
        if start >= 0 and weights[i]:
            last = i
    if start >= 0:
        kept[start : last + 1] = True
    return kept


def main_text(page: str | None) -> str:
    """The text between surges and dives of a page's line blocks; empty if there is none."""
    lines = to_lines(page) if page else []
    weights = np.array([x.weight for x in lines], np.int64)
    if not weights.any():
        return ""
    of = {name: np.array([getattr(x, name) for x in lines], np.int64) for name in ("unit", "part", "holder", "stretch")}
    sums = window_sums(weights, of["stretch"] * (of["part"].max() + 1) + of["part"])
    # Weak parts go, unless nothing beside them surges as the page's text does.
    beside = of["part"] == 0
    some = beside if int(sums[beside].max(initial=0)) >= min(SURGE, int(sums.max())) else np.ones(len(lines), bool)
    of["stretch"] = of["stretch"] * (len(lines) + 1) + np.cumsum(~some)  # what is left out leaves a gap
    lines = [x for x, keep in zip(lines, some, strict=True) if keep]
    weights, of = weights[some], {k: v[some] for k, v in of.items()}
    # An article is one stretch, whatever was left out of it.
    group = np.where(of["unit"] > 0, -of["unit"], of["stretch"])
    sums = window_sums(weights, group)
    least = min(SURGE, int(sums.max()))
    kept = surging(weights, sums, group, least)
    units = {int(u) for u in of["unit"][kept] if u}
    if 2 * weights[kept & (of["unit"] > 0)].sum() >= weights[kept].sum():
        kept = np.isin(of["unit"], list(units))
    else:
        kept |= np.isin(of["unit"], list(units))
        # Short stretches beside a kept one in the same element were parted from it by what was left out between them.
        near = np.unique(of["holder"][kept])
        for g in np.unique(group[np.isin(of["holder"], near) & ~kept & (weights > 0)]):
            own = (group == g) & np.isin(of["holder"], near)
            kept |= own & ~np.any(kept[group == g])
    return "\n\n".join(x.text for x, keep in zip(lines, kept, strict=True) if keep)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text of each row of ``pages`` (page_id, url, html); other columns are ignored.

    A null or empty page, or one without text, gives an empty text; whole pages are read; repeated rows are
    each extracted; an empty table gives no rows.
    """

    def run(batches):
        for b in batches:
            for part in by_bytes(b, 2):
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([main_text(x) for x in part.column(2).to_pylist()], pa.string())], ["page_id", "url", "text"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string")


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
