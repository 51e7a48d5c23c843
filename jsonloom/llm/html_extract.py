"""Main text of web pages by equivalence classes of template tokens.

Tokens are elements with their path of tags and classes, and text nodes with
theirs. Tokens that share their occurrence vector over the pages of a host
(how often each page has them) form a class; the vector is summed up into a
fingerprint, so no task gathers a host's pages. Classes that nearly all pages
have are valid. Nested in each other by the paths of their elements, they make the
host's template, and each of its elements that a page has once is a slot for what
is inside it, but not inside a deeper one.

The main region is the slot of an article or main element, or else the one
reached by following, from the body down, the slot that holds most of the text
outside links. The slots in it are extracted, without those whose text is mostly links or
whose element bears a class or id of what stands beside a text (SIDE_WORDS), and
without the template's own text nodes, unless these are most of a page's region,
which then is a copied article. On a page whose host has no template, or that
lacks its main region, articles or main elements count, or else the whole body,
without elements of such a class or id.

Menus, footers, asides, forms, scripts and hidden elements are left out by tag or
role wherever they are, headers outside articles. Classes and ids count as whole
words and on containers only, never on headings, paragraphs, cells or inline elements; and an element is never
left out for them if it holds more than half of a page's text outside links or,
unless it is inside a main element itself, an article or main element.

Null or empty html gives an empty text, and so do pages with no such text. A
null or unusable url counts as a host of its own. Rows are kept as they are,
repeated ones too, and an empty table gives none. Truncated pages give what they
have, and very long ones are handled whole. Other columns are dropped, so none clashes.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, slices, small_batches

#: A class's tokens are in the template if so many pages of the host, and this share of them, have them.
MIN_PAGES, MIN_SHARE = 5, 0.9
#: Bytes of templates that are broadcast, at most.
MAX_BROADCAST = 16 << 20
TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|$)", re.S)
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template svg math iframe object canvas video audio textarea select title xmp".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
#: What a start tag closes if it is open, up to an element of the second group.
CLOSES = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select")}
CLOSES = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in CLOSES.items()}
SIDE_TAGS = frozenset("nav footer aside form button menu dialog head".split())
SIDE_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog alertdialog menu menubar".split())
SIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner masthead header footer sidebar aside nav navbar navigation menu breadcrumb breadcrumbs pagination pager "
    "comment comments disqus reply replies respond notice notices cookie cookies consent gdpr alert popup modal overlay newsletter subscribe subscription signup login share sharing social "
    "related recommended recommendations widget toolbar copyright disclaimer skip search tags toc".split()
)
MAIN_TAGS = frozenset(["article", "main"])
#: Elements that a class or id may leave out.
CONTAINERS = frozenset("dd details div dl fieldset figure header hgroup ol section table ul".split())
#: Elements that may be the region of the main text.
REGIONS = frozenset("article center dd details dialog div dl fieldset main section table tbody td tr".split())
#: A slot with this share of its text in links, at least, is a list of links.
LINKED = 0.6
#: From the body down, a slot with this share of the text outside links holds the main text.
HOLDS = 0.6


def attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape((m[2] or "").strip("\"'")) for m in ATTRIBUTE.finditer(text)}


_kinds: dict[tuple[str, str], tuple[str, bool, bool, bool]] = {}


def kind_of(tag: str, rest: str) -> tuple[str, bool, bool, bool]:
    """Name in paths, whether it is left out by tag or role, whether by class or id alone, whether it is a main element."""
    key = (tag, rest)
    if (known := _kinds.get(key)) is None:
        a = attributes(rest) if rest else {}
        words = set(f"{a.get('class', '')} {a.get('id', '')}".lower().split()) if tag in CONTAINERS else set()
        role = a.get("role", "").lower()
        hidden = "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in a.get("style", "").replace(" ", "").lower()
        main = tag in MAIN_TAGS or role in ("main", "article") or a.get("itemprop", "") == "articleBody"
        side = tag in SIDE_TAGS or role in SIDE_ROLES or hidden
        named = bool(words & SIDE_WORDS) and not side and not main
        classes = ".".join(sorted(c for c in a.get("class", "").split() if not any(x.isdigit() for x in c)))
        known = (f"{tag}.{classes}" if classes else tag, side, named, main)
        if len(_kinds) > 20_000:
            _kinds.clear()
        _kinds[key] = known
    return known


class Page:
    """The elements and blocks of a page.

    elements: path -> [count, characters of text inside, of those in links, whether it is main]
    named: number -> (path, whether it is spared), of elements with a class or id of what stands beside a text
    blocks: (text, path of the innermost element at its start, whether a main element is around, numbers of the named elements around)
    """

    def __init__(self, text: str) -> None:
        self.elements: dict[str, list] = {}
        self.blocks: list[tuple[str, str, bool, tuple[int, ...]]] = []
        self.named: dict[int, tuple[str, bool]] = {}
        self.buffer: list[str] = []
        self._named: list[tuple[int, str, int, bool]] = []
        # of each open element: tag, path, left out, numbers of the main elements around with the named ones around these, in a link, characters, in links,
        # characters outside links, whether a main element is inside, its number if it is named, numbers of the named elements around, whether a main element is around
        self.stack: list[list] = [["", "", False, (), False, 0, 0, 0, False, 0, (), False]]
        self.opened = 0
        self.parse(text)
        total = self.stack[0][7]
        self.named = {i: (path, holds or 2 * size > total > 0) for i, path, size, holds in self._named}
        # a main element inside what is left out is none
        self.blocks = [(t, path, any(all(self.named[i][1] for i in around) for around in mains), names) for t, path, mains, names in self.blocks]

    def parse(self, text: str) -> None:
        at, n = 0, len(text)
        for m in iter(lambda: TOKEN.search(text, at), None):
            if m.start() > at:
                self.text(text[at : m.start()])
            at = m.end()
            tag = (m[2] or m[5] or "").lower()
            if not tag:
                if text.startswith("<![CDATA[", m.start()):
                    self.text(html.escape(text[m.start() + 9 : at].removesuffix("]]>")))
                continue
            if m[1] or m[4]:
                self.close(tag)
            else:
                rest = m[3] or m[6] or ""
                if tag in RAW:
                    end = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(text, at)
                    if rest.endswith("/") and tag in ("svg", "math"):
                        continue
                    at = (text.find(">", end.end() - 1) + 1 or n) if end else n
                    continue
                self.open(tag, rest.strip().removesuffix("/").strip())
        if at < n:
            self.text(text[at:])
        self.flush()
        while len(self.stack) > 1:
            self.pop()

    def text(self, text: str) -> None:
        top = self.stack[-1]
        if top[2]:
            return
        self.buffer.append(text)
        size = len(text.strip())
        top[5] += size
        if top[4]:
            top[6] += size
        else:
            top[7] += size

    def open(self, tag: str, rest: str) -> None:
        if tag in BLOCK:
            self.flush()
            if any(x[0] == "p" for x in self.stack):  # a block ends a paragraph
                self.close("p")
        elif tag == "br":
            self.buffer.append(" ")
        if tag in VOID:
            return
        if rule := CLOSES.get(tag):
            for x in range(len(self.stack) - 1, 0, -1):
                if self.stack[x][0] in rule[0]:
                    while len(self.stack) > x:
                        self.pop()
                elif self.stack[x][0] in rule[1]:
                    break
        top = self.stack[-1]
        name, side, named, main = kind_of(tag, rest)
        self.opened += 1
        side = side or top[2] or (tag == "header" and not top[11])
        main = main and not side
        # inline elements do not make a path
        path = f"{top[1]}/{name}" if tag in BLOCK else top[1]
        names = (*top[10], self.opened) if named and not side else top[10]
        self.stack.append([tag, path, side, (*top[3], names) if main else top[3], tag == "a" or top[4], 0, 0, 0, main, self.opened if named and not side else 0, names, main or top[11]])
        if tag in BLOCK:
            known = self.elements.setdefault(path, [0, 0, 0, main])
            known[0] += 1

    def close(self, tag: str) -> None:
        if tag in BLOCK:
            self.flush()
        for x in range(len(self.stack) - 1, 0, -1):
            if self.stack[x][0] == tag:
                while len(self.stack) > x:
                    self.pop()
                return

    def pop(self) -> None:
        tag, path, _, _, _, size, linked, plain, holds, number, _, _ = self.stack.pop()
        top = self.stack[-1]
        top[5] += size
        top[6] += linked
        top[7] += plain
        top[8] = top[8] or holds
        if number:
            self._named.append((number, path, plain, holds and not top[11]))
        if tag in BLOCK:
            known = self.elements[path]
            known[1] += size
            known[2] += linked

    def flush(self) -> None:
        if self.buffer:
            text = " ".join(html.unescape("".join(self.buffer)).split())
            self.buffer = []
            if text:
                top = self.stack[-1]
                self.blocks.append((text, top[1], top[3], top[10]))


def host_of(url: str | None) -> str:
    m = re.match(r"[a-zA-Z][\w+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", url or "")
    return m[1].lower() if m else ""


def node_key(path: str, text: str) -> str:
    return f"\t{xxhash.xxh64_hexdigest(f'{path}\t{text}')}"


def occurrences(pages: DataFrame) -> DataFrame:
    """host, token (an element's path, or a tab and the hash of a text node; '' for the page itself), and what its pages add up to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html", 2 << 20):
            sums: dict[tuple[str, str], list] = {}
            for url, text, key in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                host = host_of(url)
                page = Page(text)
                tokens = {p: v for p, v in page.elements.items()}
                for block, path, _, _ in page.blocks:
                    tokens.setdefault(node_key(path, block), [0, 0, 0, False])[0] += 1
                tokens[""] = [1, 0, 0, False]
                for token, (count, size, linked, main) in tokens.items():
                    s = sums.setdefault((host, token), [0, 0, 0, 0, 0, False])
                    s[0] += 1
                    s[1] += count
                    # the fingerprint of an occurrence vector: a sum over pages, whatever their order
                    s[2] += xxhash.xxh64_intdigest(f"{key}\t{count}") >> 24
                    s[3] += size
                    s[4] += linked
                    s[5] |= main
            hosts, tokens = zip(*sums, strict=True)
            cols = list(zip(*sums.values(), strict=True))
            yield pa.record_batch([pa.array(hosts), pa.array(tokens), *(pa.array(c, pa.int64()) for c in cols[:5]), pa.array(cols[5], pa.bool_())], ["host", "token", "pages", "total", "print", "size", "linked", "main"])

    rows = pages.where("html IS NOT NULL AND html <> ''").select("url", "html", F.xxhash64("page_id", "url", F.length("html")).alias("key"))
    found = rows.mapInArrow(run, "host string, token string, pages long, total long, print long, size long, linked long, main boolean")
    sums = {c: F.sum(c).alias(c) for c in ("pages", "total", "print", "size", "linked")}
    return found.groupBy("host", "token").agg(*sums.values(), F.max("main").alias("main"))


def templates(pages: DataFrame, min_pages: int, min_share: float) -> DataFrame:
    """host and its template: valid classes, each an array of tokens as structs (token, once, size, linked, main)."""
    tokens = checkpoint(occurrences(pages))
    hosts = tokens.where("token = ''").where(F.col("pages") >= min_pages).select("host", F.col("pages").alias("of"))
    # what few pages have goes before anything is dealt by host, so a host's share does not grow with its pages
    known = tokens.where("token <> '' AND host <> ''").where(F.col("pages") >= min_pages)
    frequent = known.join(hosts, "host").where(F.col("pages") >= min_share * F.col("of"))
    token = F.struct("token", (F.col("pages") == F.col("total")).alias("once"), "size", "linked", "main")
    classes = frequent.groupBy("host", "pages", "total", "print").agg(F.sort_array(F.collect_list(token)).alias("tokens"))
    return classes.groupBy("host").agg(F.sort_array(F.collect_list("tokens")).alias("template"))


def above(path: str, slots) -> str:  # noqa: ANN001
    """The deepest of the slots that a path is in, or that it is; '' if there is none."""
    while path and path not in slots:
        path = path[: path.rindex("/")]
    return path


def tag_of(path: str) -> str:
    return path[path.rindex("/") + 1 :].split(".", 1)[0]


class Slots:
    """A nest of slots, and the region of the main text in it.

    elements: path -> (characters inside, of those in links, whether it is main)
    """

    def __init__(self, elements: dict[str, tuple[int, int, bool]]) -> None:
        self.size = elements
        self.below: dict[str, list[str]] = {}
        for path in elements:
            self.below.setdefault(above(path[: path.rindex("/")], elements), []).append(path)
        # what a slot holds itself, without the slots in it
        self.own = {p: tuple(elements[p][i] - sum(elements[c][i] for c in self.below.get(p, [])) for i in (0, 1)) for p in elements}
        self.root = self._main()

    def plain(self, path: str) -> int:
        return self.size[path][0] - self.size[path][1]

    def _main(self) -> str | None:
        mains = [p for p, (size, _, main) in self.size.items() if main and size > 0]
        if mains:
            return max(mains, key=lambda p: (self.plain(p), -len(p), p))
        here = next((p for p in sorted(self.size) if tag_of(p) == "body"), None)
        while here is not None:
            inside = self.below.get(here, [])
            deeper = [c for c in inside if tag_of(c) in REGIONS and self.plain(c) >= HOLDS * self.plain(here) > 0]
            # what has a title of its own is whole
            if not deeper or (tag_of(here) != "body" and any(tag_of(c) == "h1" for c in inside)):
                return here
            here = max(deeper, key=lambda p: (self.plain(p), p))
        return None

    def links(self, path: str) -> bool:
        """Whether a slot inside the region is a list of links."""
        size, linked = self.own[path]
        return path != self.root and linked > LINKED * size > 0


class Template:
    """A host's classes, nested: the classes inside each, its slots, and the text nodes that belong to it."""

    def __init__(self, classes: list[list[dict]]) -> None:
        elements = [[t for t in c if t["token"][0] == "/"] for c in classes]
        self.nodes = {t["token"] for c in classes for t in c if t["token"][0] == "\t" and t["once"]}
        self.slots = Slots({t["token"]: (t["size"], t["linked"], t["main"]) for c in elements for t in c if t["once"]})
        #: Every element that nearly all pages have, and the number of its class.
        self.classes = {t["token"]: i for i, c in enumerate(elements) for t in c}
        self.inside = {i: self._around(c) for i, c in enumerate(elements) if c}

    def _around(self, tokens: list[dict]) -> int | None:
        """The class that a class is nested in: that of the deepest element around all of its own."""
        own = {t["token"] for t in tokens}
        paths = sorted(own)
        common = paths[0][: paths[0].rindex("/")]
        while common and not all(p.startswith(common + "/") for p in paths):
            common = common[: common.rindex("/")]
        around = above(common, self.classes)
        return self.classes[around] if around else None

    def extract(self, page: Page) -> list[str] | None:
        """The blocks in the slots of the main region; None if the page lacks it."""
        root = self.slots.root
        if root is None or root not in page.elements:
            return None
        # a name leaves out only what the template has
        out = {i for i, (path, spared) in page.named.items() if not spared and path in self.classes and path != root and not root.startswith(path + "/")}
        blocks = [(text, node_key(path, text) in self.nodes) for text, path, _, names in page.blocks if (path == root or path.startswith(root + "/")) and out.isdisjoint(names) and not self.slots.links(above(path, self.slots.size))]
        fixed = sum(len(t) for t, own in blocks if own)
        whole = 2 * fixed > sum(len(t) for t, _ in blocks)
        return [t for t, own in blocks if whole or not own]


def by_itself(page: Page) -> list[str]:
    """The main text of a page without a template."""
    out = {i for i, (_, spared) in page.named.items() if not spared}
    blocks = [(text, main) for text, _, main, names in page.blocks if out.isdisjoint(names)]
    return [text for text, main in blocks if main] or [text for text, _ in blocks]


def extract(text: str, template: Template | None) -> str:
    page = Page(text)
    blocks = template.extract(page) if template else None
    return "\n\n".join(by_itself(page) if blocks is None else blocks)


def main_text(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """Columns page_id, url, text, n_chars, of pages with page_id, url, html."""
    small_batches(pages.sparkSession)
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    known = checkpoint(templates(rows, min_pages, min_share))
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][\w+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    rows = rows.withColumn("host", host)
    size = known.agg(F.coalesce(F.sum(F.length(F.to_json("template"))), F.lit(0))).first()[0]
    few = None
    if size <= MAX_BROADCAST:
        few = {r["host"]: [[t.asDict() for t in c] for c in r["template"]] for r in known.collect()}
    else:
        rows = rows.join(known, "host", "left").select("page_id", "url", "html", "host", "template")
    shared = rows.sparkSession.sparkContext.broadcast(few)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[str, Template | None] = {}
        for batch in slices(batches, "html", 2 << 20):
            out = []
            for i, (text, name) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                if name not in made:
                    tokens = shared.value.get(name) if shared.value is not None else batch.column(4)[i].as_py()
                    if len(made) > 1000:
                        made.clear()
                    made[name] = Template(tokens) if tokens else None
                out.append(extract(text, made[name]) if text else "")
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array(np.fromiter(map(len, out), np.int64, len(out)))], ["page_id", "url", "text", "n_chars"])

    kind = dict(rows.dtypes)["page_id"]
    return rows.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
