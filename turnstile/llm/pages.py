"""Main text of web pages, with each site's template removed.

A page is read once, tag by tag.  Elements that by their name, role, class or
visibility are menus, headers, sidebars, notices, adverts, forms, comments and
the like are skipped.  A form is one of them unless it holds a main element, an article
or a first heading and so is wrapped around the page.  What is left is cut into blocks
at block elements; the blocks of the main element are the main text, else those of
articles, else those of the body.

Independently of names, every element that may be part of a site's template is
hashed with all it contains.  Spark counts on how many pages of its host a
subtree occurs; those on at least ``LEAST_PAGES`` pages and either ``SHARE`` of
the host's pages or ``MANY_PAGES`` of them are template and their blocks go.  So
the template of a language or a section counts, however large the host is.  Pages of a host with the same
main blocks count as one, so that copies of a page do not vote for its text.  Inside an article, paragraphs,
headings, lists' items and quotes are never template, as sites repeat passages,
too.  Pages meet templates by (host, hash) rows; no list grows with a host.  An element
covers a run of blocks, so a page keeps one (hash, first block, end) for each element,
however deep it stands.

Defined cases: a null or empty page has an empty text; markup without a body is
read as one; unclosed elements end with their parents, and what is after an
unclosed comment or script is part of it; a page without a url belongs to the
host without a name; a host of fewer than ``LEAST_PAGES`` different pages has no
templates, as recurrence tells nothing there; repeated rows keep a text each, but count
once for templates; pages that differ in a block are different pages.  Other columns are not
read.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnstile.llm.common import staged

LEAST_PAGES = 5
SHARE = 0.05
MANY_PAGES = 50

# Element names by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p "
    "pre search section summary table tbody td tfoot th thead tr ul".split())
SKIPPED = frozenset(
    "head title nav footer aside button select input textarea iframe object svg canvas math menu dialog "
    "audio video label fieldset datalist template noscript search".split())
TEXT_BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre td th tr figcaption".split())
CLOSED_BY = {
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "td", "th"]), "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]),
    "option": frozenset(["option"]),
}
LIMITS = frozenset("ul ol menu dl table tbody thead tfoot select article section div body html main td th".split())
ROLES = frozenset(
    "navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
PARTS = re.compile(
    r"(?:ads?|advert\w*|adsbygoogle|sponsor\w*|promo\w*|banners?|sidebars?|aside|widgets?|menus?|nav|navbar|"
    r"navigation|breadcrumbs?|footer|masthead|topbar|cookies?|consent|gdpr|notices?|notifications?|alerts?|popups?|"
    r"modal|overlay|newsletter|subscribe|subscription|signup|login|share|sharing|social|related|"
    r"recommend\w*|comments?|commentlist|disqus|replies|pagination|pager|toolbar|searchbox|searchform)")
# Words that a paragraph of the main text may well be named by.
AMBIGUOUS = re.compile(r"(?:shar(?:e|ing)|social|related|recommend\w*|aside|menus?|login|overlay)")
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre figcaption dt dd caption".split())

# A quoted value may hold "<" or ">", if it is not long; one that holds both is taken only where it
# ends like one.  All that may fail to end is bounded, so that broken markup costs no more than whole.
VALUE = "(?>" + "|".join(
    rf"{q}[^{q}<]*{q}|{q}[^{q}>]{{0,300}}{q}|{q}[^{q}]{{0,300}}{q}(?=[\s/>])" for q in "\"'") + ")"
TAG = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|textarea|title|template|iframe|svg)\b[^>]{0,4000}>.*?(?:</(?P=raw)\s*>|\Z)"
    rf"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]{{0,100}})(?P<attrs>(?:[^<>\"']++|{VALUE}){{0,400}}+)>"
    r"|<(?P<loose_close>/?)(?P<loose_name>[a-zA-Z][^\s/>]{0,100})(?P<loose_attrs>[^>]{0,4000})>"
    r"|</?[!?][^>]{0,4000}>",
    re.S | re.I)
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
HOST = re.compile(r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)")


def host_of(url: str | None) -> str:
    found = HOST.match(url or "")
    return found.group(1).lower() if found else ""


def attributes(text: str) -> dict[str, str]:
    return {m.group(1).lower(): m.group(2) or m.group(3) or m.group(4) or ""
            for m in ATTRIBUTE.finditer(text)} if text.strip() else {}


def skipped(name: str, attrs: dict[str, str], inside: bool) -> bool:
    """Whether an element is no part of the main text, whatever it holds; ``inside`` an article
    or the main element, headers and oddly named paragraphs are."""
    if name in SKIPPED or (name == "header" and not inside):
        return True
    if not attrs or name in ("html", "body", "main"):
        return False
    if "hidden" in attrs or attrs.get("aria-hidden") == "true" or attrs.get("role", "").lower() in ROLES:
        return True
    if "display:none" in attrs.get("style", "").replace(" ", "").lower():
        return True
    words = re.split(r"[^a-z0-9]+", f"{attrs.get('class', '')} {attrs.get('id', '')}".lower())
    named = [w for w in words if PARTS.fullmatch(w)]
    if inside and name in PROSE:
        named = [w for w in named if not AMBIGUOUS.fullmatch(w)]
    return bool(named) or (not inside and "header" in words)


def digest(text: str) -> int:
    return int.from_bytes(
        blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True)


@dataclass
class Element:
    """An open element."""

    name: str
    parts: list[str]  # what its hash is of
    skip: bool = False
    articles: int = 0  # open articles around it, itself included
    main: bool = False  # in a main element
    first: int = 0  # its first block
    wraps: bool = False  # a form around the page's text


class Page:
    """Blocks of a page and hashes of its subtrees, gathered in one pass over its tags."""

    def __init__(self, text: str):
        self.blocks: list[tuple[str, int]] = []  # text, level
        self.spans: list[tuple[int, int, int]] = []  # hash, first block and end of a subtree
        self.stack: list[Element] = []
        self.open: Counter[str] = Counter()  # names on the stack
        self.forms: list[Element] = []
        self.words: list[str] = []
        at = 0
        for found in TAG.finditer(text):
            if found.start() > at:
                self.text(text[at:found.start()])
            at = found.end()
            loose = "loose_" if found["name"] is None else ""
            name, attrs = found[f"{loose}name"], found[f"{loose}attrs"]
            if name is None:
                continue
            name = name.lower()
            if found[f"{loose}close"]:
                self.end(name)
            elif name == "br":
                self.text(" ")
            elif name in VOID:
                if name in BLOCKS:
                    self.flush()
            else:
                self.start(name, attributes(attrs), attrs.rstrip().endswith("/"))
        self.text(text[at:])
        while self.stack:
            self.pop()
        self.flush()

    def text(self, text: str) -> None:
        if self.stack:
            self.stack[-1].parts.append(text)
            if self.stack[-1].skip:
                return
        self.words.append(text)

    def flush(self) -> None:
        """The words since the last border as a block of the innermost element."""
        if self.words:
            text = " ".join(html.unescape("".join(self.words)).split())
            self.words.clear()
            if text:
                top = self.stack[-1] if self.stack else Element("", [])
                self.blocks.append((text, 2 if top.main else 1 if top.articles else 0))

    def start(self, name: str, attrs: dict[str, str], alone: bool) -> None:
        if name in BLOCKS:
            # A block ends an open paragraph or label, a list item the one before.
            while self.stack and self.stack[-1].name == "label":
                self.pop()
            self.close_up_to(frozenset(["p"]), LIMITS)
            if name in CLOSED_BY:
                self.close_up_to(CLOSED_BY[name], LIMITS - CLOSED_BY[name] - ({"td", "th"} if name == "tr" else set()))
            if not self.stack or not self.stack[-1].skip:
                self.flush()
        elif not attrs and name not in SKIPPED:
            return  # plain inline markup is no element to us
        if alone and name not in BLOCKS:
            return
        top = self.stack[-1] if self.stack else Element("", [])
        skip = top.skip or skipped(name, attrs, top.main or top.articles > 0)
        mark = f"{attrs.get('class', '')} {attrs.get('id', '')}" if attrs else ""
        main = not skip and (name == "main" or attrs.get("role") == "main")
        opened = Element(name, [name, " ", mark, ">"], skip, top.articles + (name == "article" and not skip),
                         top.main or main, len(self.blocks))
        self.stack.append(opened)
        self.open[name] += 1
        if self.forms and not skip and (main or name in ("article", "h1")):
            self.forms[-1].wraps = True
        if name == "form" and not skip:
            self.forms.append(opened)

    def close_up_to(self, names: frozenset, limits: frozenset) -> None:
        if not any(self.open[name] for name in names):
            return
        for back in range(len(self.stack) - 1, -1, -1):
            if self.stack[back].name in names:
                while len(self.stack) > back:
                    self.pop()
                return
            if self.stack[back].name in limits:
                return

    def end(self, name: str) -> None:
        inline = name not in BLOCKS
        for back in range(len(self.stack) - 1, -1, -1) if self.open[name] else ():
            here = self.stack[back].name
            if here == name:
                while len(self.stack) > back:
                    self.pop()
                return
            if inline and here in BLOCKS or here in ("article", "main", "body") and name not in (
                    "article", "main", "body", "html"):
                break
        if not inline and (not self.stack or not self.stack[-1].skip):
            self.flush()

    def pop(self) -> None:
        top = self.stack[-1]
        name = top.name
        if not top.skip and name in BLOCKS:
            self.flush()
        self.stack.pop()
        self.open[name] -= 1
        code = digest(" ".join("".join(top.parts).split()))
        if self.stack:
            self.stack[-1].parts.append(f"<{code}>")
        if self.forms and top is self.forms[-1]:
            self.forms.pop()
            if top.wraps and self.forms:
                self.forms[-1].wraps = True
            if not top.wraps:
                del self.blocks[top.first:]
                while self.spans and self.spans[-1][1] >= top.first:
                    self.spans.pop()
        elif len(self.blocks) > top.first and name in BLOCKS and name not in ("html", "body", "article", "main") and not (
                top.articles and name in TEXT_BLOCKS):
            self.spans.append((code, top.first, len(self.blocks)))

    def main(self) -> tuple[list[str], list[tuple[int, int, int]]]:
        """Blocks of the main text, and the subtrees that cover some of them."""
        level = max((at for _, at in self.blocks), default=0)
        kept = np.array([at == level for _, at in self.blocks], dtype=np.int64)
        place = np.concatenate([[0], np.cumsum(kept)]).tolist()
        spans = [(code, place[first], place[end]) for code, first, end in self.spans if place[first] < place[end]]
        return [text for text, at in self.blocks if at == level], spans


class MainText:
    """Main texts of ``pages`` (``page_id``, ``url``, ``html``)."""

    def __init__(self, pages: DataFrame, least_pages: int = LEAST_PAGES, share: float = SHARE,
                 many_pages: int = MANY_PAGES):
        self.pages = staged(parsed(pages).withColumn("row", F.monotonically_increasing_id()), "pages")
        on_host = self.pages.groupBy("host").agg(F.count_distinct("content").alias("pages"))
        self.templates = staged(
            self.pages.select("host", "content", F.explode("spans.hash").alias("hash"))
            .groupBy("host", "hash").agg(F.count_distinct("content").alias("n"))
            .filter(F.col("n") >= least_pages)
            .join(on_host, "host").filter(
                (F.col("n") >= share * F.col("pages")) | (F.col("n") >= many_pages))
            .select("host", "hash", "n"),
            "templates")

    def texts(self) -> DataFrame:
        # Written first: where few pages hold templates, their texts need not be shuffled to meet them.
        per_page = staged(
            self.pages.select("row", "host", F.inline("spans"))
            .join(self.templates.select("host", "hash"), ["host", "hash"], "left_semi")
            .groupBy("row").agg(F.collect_list("first").alias("first"), F.collect_list("end").alias("end")),
            "covers")
        kind = self.pages.schema["page_id"].dataType.simpleString()
        return self.pages.join(per_page, "row", "left").select("page_id", "url", "blocks", "first", "end").mapInArrow(
            uncovered, f"page_id {kind}, url string, text string, n_chars bigint")


def uncovered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of the blocks that no template covers."""
    for batch in batches:
        texts = []
        for blocks, first, end in zip(*[batch.column(i).to_pylist() for i in (2, 3, 4)]):
            if first:
                edges = np.zeros(len(blocks) + 1, dtype=np.int64)
                np.add.at(edges, first, 1)
                np.add.at(edges, end, -1)
                blocks = [blocks[i] for i in np.flatnonzero(np.cumsum(edges[:-1]) == 0)]
            texts.append("\n".join(blocks))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()),
             pa.array([len(text) for text in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def parsed(pages: DataFrame) -> DataFrame:
    """Per page its host, the blocks of its main text and the hashes of its subtrees."""
    kind = pages.schema["page_id"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([
            ("host", pa.string()), ("content", pa.int64()), ("blocks", pa.list_(pa.string())),
            ("spans", pa.list_(pa.struct([("hash", pa.int64()), ("first", pa.int32()), ("end", pa.int32())])))])
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                rows = []
                for url, page in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                    blocks, spans = Page(page or "").main()
                    rows.append({
                        "host": host_of(url), "content": digest("\n".join(blocks)), "blocks": blocks,
                        "spans": [dict(zip(("hash", "first", "end"), span)) for span in spans]})
                made = pa.RecordBatch.from_pylist(rows, schema=schema)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), *made.columns],
                    ["page_id", "url", "host", "content", "blocks", "spans"])

    return pages.select("page_id", "url", "html").mapInArrow(
        read, f"page_id {kind}, url string, host string, content bigint, "
              "blocks array<string>, spans array<struct<hash:bigint,first:int,end:int>>")


def main_texts(pages: DataFrame, **settings) -> DataFrame:
    return MainText(pages, **settings).texts()
