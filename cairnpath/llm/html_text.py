"""Main text of web pages by line-block distribution.

Markup is stripped so that each block element gives a line. A line weighs as much as the text in it that isn't linked; in an
article element as much as all its text and more; nothing in a part of the page that its tags or class names mark as
something else, or that is readers' comments by its form. Weights are summed over a sliding window of lines; text is kept
from where the sums surge to where they dive to nothing, and may surge again. Any line of an article element is a surge of
its own, so nothing of it is lost behind what isn't the article; elsewhere linked lines between kept ones are text too. A
mark from class names doesn't count on an element that holds most of the page's text and its article or headline: that is
a wrapper, whatever it is called.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnpath.llm.common import whole

#: Lines a window; the sum that a surge needs, or this share of the page's largest sum if that is less; what an article element adds to a line.
WINDOW, SURGE, SURGE_SHARE, IN_ARTICLE = 3, 80, 0.3, 40

_TOKEN = re.compile(
    r"<!--(?:.*?-->|.*\Z)|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?>\"[^\"]*\"|'[^']*'|[^>\"'])*+)>|</?[a-zA-Z][^>]*(?:>|\Z)|<[!?][^>]*(?:>|\Z)", re.S
)
_HINTS = re.compile(r"""(?i)\b(class|id|role|style|aria-hidden|hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

#: Element names of HTML by what they do to a line.
RAW = {"script", "style", "title", "textarea", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "button", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "option", "p", "pre", "search", "section", "select", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
ASIDE = {"aside", "button", "canvas", "dialog", "footer", "head", "iframe", "label", "legend", "menu", "nav", "noscript", "object", "option", "search", "select", "svg", "template"}
#: Words of class names, ids and roles that mark a part as something else than the article.
MARKED = {
    "ad", "ads", "adslot", "advert", "adverts", "advertisement", "advertising", "alert", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "complementary", "consent", "contentinfo", "cookie", "cookies", "copyright", "dialog", "discussion", "disqus", "footer", "form", "gdpr", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "notification", "overlay", "pager", "pagination", "popup", "promo", "promoted", "promotion", "recommended", "related", "replies", "reply", "respond", "search", "share", "sharing", "sidebar", "signup", "skip", "social", "sponsor", "sponsored", "subscribe", "subscription", "teaser", "toolbar", "topbar", "widget",
}
#: Headings above readers' comments, and lines that name who wrote one and when.
_COMMENTS = re.compile(r"(?i)(?:\d+ )?(?:reader |user |visitor )?(?:comments?|responses|replies)(?: \(\d+\))?:?|readers (?:say|write|respond)|what (?:our )?readers (?:say|think)|(?:leave|post|add|write) a (?:comment|reply)|join the (?:discussion|conversation)")
_SAID = re.compile(r"(?i).{0,60}?(?:\b(?:\d+|an?|one) (?:second|minute|hour|day|week|month|year)s? ago\b.{0,20}|\b(?:says|wrote|said|writes):)")
#: Elements around a line that are looked at for the form of comments.
NEAR = 5
#: Elements that a following one of the same name ends.
ITEMS = {"li", "dd", "dt", "td", "th", "tr", "option"}
ARTICLE, PLAIN, FORM, OUT, MARK = 1, 0, 2, 3, 4


def _kind(name: str, rest: str, inside: bool) -> int:
    """What a start tag says of its element: the article, something else by its name (OUT) or by its class (MARK), a form, or nothing."""
    if name in ASIDE:
        return OUT
    words: set[str] = set()
    if rest:
        for key, value in _HINTS.findall(rest):
            key, value = key.lower(), value.strip("\"'")
            if key in ("class", "id", "role"):
                words.update(w.lower() for w in _PART.findall(value))
            elif key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value) or key == "hidden" or key == "aria-hidden" and value == "true":
                return OUT
    if words & MARKED and name not in ("html", "body") and not (name in ("article", "main") and not words & {"comment", "comments", "reply", "teaser", "related", "promo", "ad", "sponsored"}):
        return MARK
    if name == "header" or "header" in words and name not in HEADINGS and name not in ("article", "main", "html", "body"):
        return PLAIN if inside else OUT
    if name == "form":
        return FORM
    return ARTICLE if name in ("article", "main") or "main" in words and name in ("div", "section") else PLAIN


def _comments(found: list[tuple[str, tuple[int, ...], bool]], cores: set[int]) -> set[int]:
    """Elements that hold readers' comments: those with a heading that says so, and those with several parts that begin with who wrote them and when."""
    out, said = set(), Counter()
    for text, near, heading in found:
        if heading and len(near) > 1 and _COMMENTS.fullmatch(text):
            out.add(near[-2])
        elif _SAID.fullmatch(text):
            said.update(set(near[:-1]))
    return {e for e in out if e not in cores} | {e for e, n in said.items() if n > 1 and e not in cores}


def lines(html: str) -> list[tuple[str, int, bool, bool, bool]]:
    """The lines of a page: text, length without links, whether in an article, in a form, in a part that is something else."""
    out: list[tuple[str, int, bool, bool, int]] = []
    placed: list[tuple[str, tuple[int, ...], bool]] = []
    near: list[int] = [0]  # numbers of the block elements around
    cores = {0}
    serial = 0
    stack: list[tuple[str, int]] = []
    blocks: list[int] = []  # where in the stack block elements are
    opened: Counter[str] = Counter()
    text: list[str] = []
    linked = links = at = 0
    counts = [0] * 5
    #: Marked parts: the one around it, whether by class, whether the article or a headline is in it, and its unlinked text.
    around, by_class, core, held = [0], [True], [True], [0]
    marks = [0]

    def put(s: str) -> None:
        nonlocal linked
        if s:
            text.append(s)
            if links:
                linked += len(s)

    def flush() -> None:
        nonlocal linked
        if text:
            raw = "".join(text)
            if clean := " ".join(unescape(raw).split()):
                n = round(max(0, len(raw) - linked) / len(raw) * len(clean))
                out.append((clean, n, counts[ARTICLE] > 0, counts[FORM] > 0, marks[-1]))
                placed.append((clean, tuple(near[-NEAR:]), any(opened[h] for h in HEADINGS)))
                held[marks[-1]] += n
            text.clear()
        linked = 0

    def pop() -> None:
        nonlocal links
        name, kind = stack.pop()
        opened[name] -= 1
        counts[kind] -= 1
        links -= name == "a"
        if kind >= OUT:
            marks.pop()
        if blocks and blocks[-1] == len(stack):
            blocks.pop()
            near.pop()

    while m := _TOKEN.search(html, at):
        put(html[at : m.start()])
        at = m.end()
        name = (m["name"] or "").lower()
        if not name:
            continue
        if name in BLOCK:
            flush()
        if m["end"]:
            while opened[name]:  # an end tag without a start tag ends nothing
                last = stack[-1][0]
                pop()
                if last == name:
                    break
            continue
        if name == "br":
            put(" ")
        if name in VOID:
            continue
        if name in RAW:
            close = re.compile(rf"</{name}\b[^>]*>", re.I).search(html, at)
            at = close.end() if close else len(html)
            continue
        if name in BLOCK and blocks:
            # A new block ends an open paragraph, and an item the item before it.
            last = stack[blocks[-1]][0]
            if last == "p" or last == name and name in ITEMS:
                for _ in range(len(stack) - blocks[-1]):
                    pop()
        if not m["rest"].endswith("/") or name in BLOCK:
            kind = _kind(name, m["rest"], counts[ARTICLE] > 0)
            if name == "h1" or kind == ARTICLE:
                core[marks[-1]] = True
            if kind >= OUT:
                around.append(marks[-1])
                by_class.append(kind == MARK)
                core.append(False)
                held.append(0)
                marks.append(len(around) - 1)
            if name in BLOCK:
                blocks.append(len(stack))
                serial += 1
                near.append(serial)
            if name in ("h1", "body", "html") or kind == ARTICLE:
                cores.update(near[-NEAR:])
            stack.append((name, kind))
            opened[name] += 1
            counts[kind] += 1
            links += name == "a"
    put(html[at:])
    flush()
    for k in range(len(around) - 1, 0, -1):
        held[around[k]] += held[k]
        core[around[k]] |= core[k]
    aside = [False]
    for k in range(1, len(around)):
        aside.append(aside[around[k]] or not (by_class[k] and core[k] and 2 * held[k] >= held[0]))
    said = _comments(placed, cores)
    others = [bool(said and said.intersection(p[1])) for p in placed]
    return [(clean, n, article, form, aside[mark] or other) for (clean, n, article, form, mark), other in zip(out, others, strict=True)]


def main_text(html: str, window: int = WINDOW, surge: float = SURGE, surge_share: float = SURGE_SHARE, in_article: int = IN_ARTICLE) -> str:
    """The article's blocks, one a line; empty if there is none.

    Lines of an article element weigh more, linked or not, and those outside of it nothing, if it has half the text that
    isn't marked as something else. Forms weigh nothing unless all is in forms.
    """
    found = lines(html)
    formless = any(not form and not aside for _, _, _, form, aside in found)
    text = [not aside and not (form and formless) for _, _, _, form, aside in found]
    own = [n if ok else 0 for ok, (_, n, *_) in zip(text, found, strict=True)]
    inside = sum(n for n, line in zip(own, found, strict=True) if line[2])
    need = surge
    if inside > 0 and 2 * inside >= sum(own):
        text = [ok and line[2] for ok, line in zip(text, found, strict=True)]
        own = [len(line[0]) + in_article if ok else 0 for ok, line in zip(text, found, strict=True)]
        need = min(surge, in_article)
    sums, total = [0] * len(own), 0
    for i in range(len(own) - 1, -1, -1):
        total += own[i] - (own[i + window] if i + window < len(own) else 0)
        sums[i] = total
    need = min(need, surge_share * max(sums, default=0))
    kept, on, end = [], False, 0
    for i in range(len(found)):
        if not on and own[i] and sums[i] >= need:
            # Short lines right before a surge, as headlines are, belong to it.
            start = i
            while start > max(end, i - window + 1) and own[start - 1]:
                start -= 1
            kept += range(start, i)
            on = True
        elif on and not sums[i]:
            on, end = False, i
        if on and own[i]:
            # Linked lines since the last kept one, if nothing else stands between, are text as well.
            gap = range(kept[-1] + 1, i) if kept and i - kept[-1] <= window else range(0)
            kept += gap if all(text[j] for j in gap) else []
            kept.append(i)
    return "\n".join(found[i][0] for i in kept)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(h.as_py()) for h in batch.column(2)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """One row per row of pages: page_id, url, text, n_chars.

    A null or empty html, or one without an article, has the empty text. Ids and urls may be null and rows repeated;
    an empty table gives no rows; further columns are ignored. Each page is handled where it is read.
    """
    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), whole("html")).mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
