"""Main text of web pages by two-pass block rules.

The page is cut into blocks at block-level tags. Pass one decides blocks by where they stand (menus, footers, forms, adverts by
tag, class or id), by link density, and by length with stop-word density. Pass two gives the short or odd blocks that are left
the label of the nearest decided neighbour, the nearer side first; within an article element (or main) a list of links
passes nothing on, as text goes on behind it. Where an article has text, what stands outside of it is not main text.

A null or empty page, or one without main text, gives an empty string. Unclosed, wrongly nested and unknown tags are
taken as browsers do in the main: an end tag closes up to its element or nothing. Rows are taken one by one, so ties, repeated
rows and extra columns change nothing; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from faultspark.llm.common import texts
from faultspark.llm.quality import STOP_WORDS

# Element names by role.
_BLOCK = frozenset("""address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form
h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul
caption head title""".split())
_RAW = frozenset("script style title textarea noscript template iframe noframes noembed xmp svg math object audio video canvas".split())
_NEVER = frozenset("nav footer aside form menu dialog select button head".split())
_CONTAINER = _BLOCK - frozenset("p hr li dt dd option h1 h2 h3 h4 h5 h6".split()) | frozenset(["select", "button", "label"])
_NAMED = re.compile(r"(?<![a-z])(?:ads?|advert\w*|adsense|banner|sponsor\w*|promo\w*|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|"
                    r"newsletter|subscri\w*|signup|login|side-?bar|rail|widget\w*|menus?|nav|navbar|navigation|breadcrumbs?|pagination|pager|"
                    r"footer|masthead|site-?header|page-?header|top-?bar|comments?|disqus|replies|respond|share|sharing|social|related|"
                    r"recommend\w*|toolbar|skip-?link|search)(?![a-z])", re.I)
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|"
                    r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>", re.S)
_ATTRIBUTE = re.compile(r"(?:^|\s)(?:class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORD = re.compile(r"[^\W\d_]+")

LINK_LIMIT, LONG, STOP_LIMIT = 0.5, 60, 0.12
GOOD, BAD, OPEN = 1, 0, -1


@dataclass
class Block:
    text: str
    linked: int
    scope: int  # the article it is in, 0 for none
    banned: bool
    heading: bool = False
    label: int = OPEN


def blocks(html: str) -> list[Block]:
    """Blocks in page order, with decoded references and single spaces."""
    out: list[Block] = []
    stack: list[tuple[str, bool, int]] = []  # container, banned, scope
    parts: list[tuple[str, bool]] = []
    links, scopes, at, heading = 0, 0, 0, False

    def close() -> None:
        if parts:
            text = " ".join(unescape("".join(p for p, _ in parts)).split())
            if text:
                linked = sum(len("".join(unescape(p).split())) for p, in_link in parts if in_link)
                _, banned, scope = stack[-1] if stack else ("", False, 0)
                out.append(Block(text, linked, scope, banned, heading))
            parts.clear()

    while True:
        m = _TOKEN.search(html, at)
        end = m.start() if m else len(html)
        if end > at:
            parts.append((html[at:end], links > 0))
        if not m:
            break
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if m[1]:
            if name == "a":
                links = max(0, links - 1)
            if name in _BLOCK or name in _CONTAINER:
                close()
                heading = False
                if name in _CONTAINER:
                    for i in range(len(stack) - 1, -1, -1):
                        if stack[i][0] == name:
                            del stack[i:]
                            links = 0
                            break
            continue
        if name in _RAW:
            if not m[3].endswith("/") or name not in ("svg", "math"):
                stop = re.compile(f"</{name}(?=[\\s/>])[^>]*>", re.I).search(html, at)
                at = stop.end() if stop else len(html)
            if name == "title":
                close()
            continue
        if name == "a":
            links += 1
        elif name == "br":
            parts.append((" ", False))
        if name in _BLOCK or name in _CONTAINER:
            close()
            heading = name[0] == "h" and name[1:].isdigit()
        if name in _CONTAINER:
            _, banned, scope = stack[-1] if stack else ("", False, 0)
            if name in ("article", "main") and not scope and not banned:
                scopes += 1
                scope = scopes
            elif name in _NEVER or (name == "header" and not scope):
                banned = True
            if not banned and name not in ("body", "html", "article", "main"):
                names = " ".join(a or b or c for a, b, c in _ATTRIBUTE.findall(m[3]))
                banned = bool(names) and bool(_NAMED.search(names))
            stack.append((name, banned, scope))
    close()
    return out


def classify(found: list[Block]) -> None:
    """Both passes; sets every block's label."""
    scoped = any(b.scope and not b.banned for b in found)
    for b in found:
        size = len(b.text)
        if b.banned or (scoped and not b.scope):
            b.label = BAD
        elif b.linked > LINK_LIMIT * len(b.text.replace(" ", "")):
            b.label = BAD
        elif size >= LONG and not b.heading:
            words = _WORD.findall(b.text.lower())
            if sum(map(STOP_WORDS.__contains__, words)) >= STOP_LIMIT * max(1, len(words)):
                b.label = GOOD
    n = len(found)
    before, after = [None] * n, [None] * n  # nearest decided block of the same scope on either side
    for order, side in ((range(n), before), (range(n - 1, -1, -1), after)):
        last: dict[int, int] = {}
        for i in order:
            side[i] = last.get(found[i].scope)
            if found[i].label == GOOD or (found[i].label == BAD and not found[i].banned and not found[i].scope):
                last[found[i].scope] = i
    given = []
    for i, b in enumerate(found):
        if b.label == OPEN:
            near = sorted((abs(i - j), -found[j].label) for j in (before[i], after[i]) if j is not None)
            given.append((b, -near[0][1] if near else (GOOD if b.scope else BAD)))
    for b, label in given:
        b.label = label


def main_text(html: str | None) -> str:
    found = blocks(html or "")
    classify(found)
    return "\n\n".join(b.text for b in found if b.label == GOOD)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every page: one narrow pass."""
    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [main_text(h) for h in texts(b, "html")]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(found, pa.string()),
                                              pa.array([len(t) for t in found], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kinds = dict(pages.dtypes)
    return pages.select("page_id", "url", "html").mapInArrow(per_batch, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
