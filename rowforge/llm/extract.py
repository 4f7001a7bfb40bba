"""Main text of web pages by line-block distribution.

Markup is stripped to lines: every block-level tag ends a line, so markup between blocks leaves empty lines.
What HTML itself or its naming marks as menu, header, footer, sidebar, notice, advert, form or comment leaves
empty lines too. Text lengths are summed over windows of ``WINDOW`` lines. Text starts at a surge (a sum over
``SURGE`` after empty lines) and ends at a dive (a sum of 0); linked text has no length. The stretch with most
text is the main one; others of at least ``SHARE`` of its length, mostly unlinked, belong to the text as well. So
do mostly unlinked lines of any length beside the main stretch, in the element around it that holds more than it.
Where stretches lie in article or main elements, the text is exactly what those elements hold."""

from __future__ import annotations

import html
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 3
SURGE = 80
SHARE = 0.2
TEXTS = "page_id long, url string, text string, n_chars long"

RAW = "script style noscript template iframe svg canvas object textarea select math audio video xmp noembed".split()
TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({'|'.join(RAW)})\b[^>]*(?:/>|>.*?(?:</\1\s*>|\Z))|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 "
    "h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BREAKS = {"br", "img", "wbr", "hr"}
CLOSED_BY_NEXT = {"p": BLOCKS, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "tr": {"tr"}, "head": {"body"}}
CONTAINERS = {"article", "main"}
GROUPS = BLOCKS - set(CLOSED_BY_NEXT) - CONTAINERS  # elements with an end tag
# Elements and names that mark what is not the article.
AROUND = set("nav header footer aside form menu dialog search head title button label input legend fieldset".split())
NAMES = (
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion promoted banner sidebar side-bar aside menu nav navbar "
    "navigation topnav breadcrumb breadcrumbs footer header site-header masthead topbar toolbar cookie cookies cookiebar consent gdpr notice notices notification alert "
    "announcement popup modal overlay newsletter subscribe subscription signup sign-up login comment comments commentlist comment-list disqus respond replies share "
    "sharing social related recommended recommendations widget widgets pagination pager skip-link search searchbox form copyright paywall"
).split()
NAMED = re.compile(rf"(?:(?!has-|with-|no-|without-|is-).*[-_])?(?:{'|'.join(NAMES)})(?:[-_]?\d+|[-_].*)?\Z", re.I)
ROLES = set("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar note".split())
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(text)}


def around(name: str, text: str, inside: bool) -> bool:
    """Whether an element is not part of the article. A header inside one belongs to it."""
    if name in AROUND and not (inside and name == "header"):
        return True
    if not text or name in ("html", "body", "main"):
        return False
    found = attributes(text)
    if "hidden" in found or found.get("aria-hidden") == "true" or found.get("role", "").lower() in ROLES or HIDDEN.search(found.get("style", "")):
        return True
    if inside and name in ("header", "h1", "h2"):
        return False
    return any(NAMED.match(word) for word in f"{found.get('class', '')} {found.get('id', '')}".split())


class Lines:
    """Lines of stripped text, their unlinked lengths, and the container each lies in (0: none)."""

    def __init__(self, page: str):
        self.text: list[str] = []
        self.size: list[int] = []
        self.home: list[int] = []
        self.group: list[int] = []  # the innermost open group of each line
        self.parent, self.last = [-1], [0]  # of each group: the one around it, the last one opened inside
        self.stack = [("", 0)]
        self.names: dict[str, int] = {}
        self.parts: list[str] = []
        self.linked = 0
        self.container = self.opened = 0
        self.depth = 0  # of nested containers
        links = skipped = 0
        skip, unclosed = "", False
        lower = page.lower()
        at = 0
        for m in TOKEN.finditer(page):
            if not skip and m.start() > at:
                self.add(page[at : m.start()], links > 0)
            at = m.end()
            name = (m[3] or m[6] or "").lower()
            if not name:
                continue
            closing, rest = m[2] or m[5], m[4] or m[7] or ""
            if skip:
                if name == skip:
                    if closing:
                        skipped -= 1
                    elif not (rest.endswith("/") or skip in CLOSED_BY_NEXT and name in CLOSED_BY_NEXT[skip]):
                        skipped += 1
                over = not closing and name in CLOSED_BY_NEXT.get(skip, ()) or closing and skip in CLOSED_BY_NEXT and name != skip and name in BLOCKS and skip != "head"
                if skipped and not over and not (unclosed and name in CONTAINERS and not closing and not self.depth):
                    continue
                skip = ""
                if not over and name not in CONTAINERS:
                    continue
            if not closing and name not in VOID and around(name, rest, self.depth > 0):
                if not rest.endswith("/"):
                    skip, skipped, unclosed = name, 1, lower.find(f"</{name}", at) < 0
                if name in BLOCKS:
                    self.end()
                    if not self.depth:
                        self.blank()
                continue
            if name in CONTAINERS:
                self.end()
                self.nest(-1 if closing else 1)
            elif name in BLOCKS:
                self.end()
                if name in GROUPS and name not in VOID:
                    self.enter(name, bool(closing))
            elif name in BREAKS:
                self.parts.append(" ")
            elif name == "a":
                links = 0 if closing else 1
        if not skip:
            self.add(page[at:], links > 0)
        self.end()
        while self.stack:
            self.last[self.stack.pop()[1]] = len(self.parent) - 1

    def add(self, raw: str, linked: bool) -> None:
        text = html.unescape(raw) if "&" in raw else raw
        self.parts.append(text)
        if linked:
            self.linked += len(text.strip())

    def end(self) -> None:
        """Close the line; markup without text leaves an empty one."""
        text = " ".join("".join(self.parts).split())
        self.text.append(text)
        self.size.append(max(0, len(text) - self.linked))
        self.home.append(self.container)
        self.group.append(self.stack[-1][1])
        self.parts, self.linked = [], 0

    def enter(self, name: str, closing: bool) -> None:
        if not closing:
            self.parent.append(self.stack[-1][1])
            self.last.append(0)
            self.stack.append((name, len(self.parent) - 1))
            self.names[name] = self.names.get(name, 0) + 1
        elif self.names.get(name):
            found = ""
            while found != name:
                found, group = self.stack.pop()
                self.names[found] -= 1
                self.last[group] = len(self.parent) - 1

    def beside(self, first: int, to: int) -> tuple[int, int]:
        """Range of the groups around lines ``first`` to ``to``: where these lie in one part of it, it holds other text as well."""
        texts = sorted(g for g, n in zip(self.group, self.size, strict=True) if n)
        own = [g for g, n in zip(self.group[first:to], self.size[first:to], strict=True) if n]
        low, high, around = min(own), max(own), min(own)
        while self.last[around] < high:
            around = self.parent[around]
        inside = lambda g: bisect_right(texts, self.last[g]) - bisect_left(texts, g)
        if low == high or around in own:
            held = inside(around)
            while self.parent[around] >= 0:
                around = self.parent[around]
                if inside(around) > held:
                    break
        return around, self.last[around]

    def blank(self) -> None:
        for _ in range(WINDOW):
            self.end()

    def nest(self, step: int) -> None:
        if step > 0:
            if not self.depth:
                self.blank()
                self.opened += 1
                self.container = self.opened
            self.depth += 1
        elif self.depth:
            self.depth -= 1
            if not self.depth:
                self.container = 0
                self.blank()


def stretches(size: list[int]) -> list[tuple[int, int, int, int]]:
    """(first line, past the last, text, largest window sum) between dives of the line-block distribution."""
    sums = [sum(size[k : k + WINDOW]) for k in range(len(size))]
    out, k = [], 0
    while k < len(size):
        if not size[k]:
            k += 1
            continue
        to = k
        while to < len(size) and sums[to]:
            to += 1
        out.append((k, to, sum(size[k:to]), max(sums[k:to])))
        k = to
    return out


def main_text(page: str | None) -> str:
    """Blocks of the article joined by newlines; empty for null, empty or textless pages."""
    lines = Lines(page or "")
    found = stretches(lines.size)
    if not found:
        return ""
    most = max(f[2] for f in found)
    linked = lambda a, b: sum(len(t) for t in lines.text[a:b]) - sum(lines.size[a:b])
    largest = next(f for f in found if f[2] == most)
    chosen = [f for f in found if f is largest or f[3] > SURGE and f[2] >= SHARE * most and linked(f[0], f[1]) < f[2]]
    homes = {lines.home[k] for a, b, *_ in [largest] for k in range(a, b) if lines.size[k]} - {0}
    if homes:
        homes |= {lines.home[k] for a, b, *_ in chosen for k in range(a, b)} - {0}
        kept = [t for t, home in zip(lines.text, lines.home, strict=True) if home in homes]
    else:
        low, high = lines.beside(*largest[:2])
        taken = {k for a, b, *_ in chosen for k in range(a, b)}
        near = lambda k: low <= lines.group[k] <= high and len(lines.text[k]) < 2 * lines.size[k]
        kept = [t for k, t in enumerate(lines.text) if k in taken or near(k)]
    return "\n".join(t for t in kept if t)


def extract(pages: DataFrame) -> DataFrame:
    """TEXTS of every page; null html counts as empty, repeated rows and null ids stay as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page.as_py()) for page in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    return pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(run, TEXTS)
