"""Main text of web pages by site style trees.

The pages of a host are merged into one tree. A node stands for a block element
reached by the same path of tags and class names; it keeps how many pages show it,
which presentations (sequences of child elements) it takes and which contents it
holds. Its importance follows the entropies: a node that looks different on every
page, or whose contents differ from page to page, matters; one that repeats itself
is part of the site's frame.

    leaf      1 - mean over contents of log(pages with it) / log(pages with the node)
    inner     (1 - g^l) * entropy of presentations + g^l * mean importance of children

with l children and g = ``DECAY``. Branches that are below ``THRESHOLD`` with all
that hangs on them are removed from each page of the host, inside a stated article
too. Presentation can also state a role: elements for navigation, adverts, comments
and so on (and forms, unless an article is in them) have importance 0, whatever their
entropies, since menus and comments may differ from page to page. The article itself
has a prior: a branch inside it is frame only if it hardly ever changes while the
article as a whole does. If a page has an article or main block, its text is what is
left of the strongest such blocks; otherwise what is left of the body.

Statistics cover all pages. Only nodes on at least ``MIN_SHARE`` of a host's pages
can be frame, so the model of a host is bounded by the size of a page.

Inputs: null html is empty; a null url belongs to the host ''. Pages are read
whole, of any length, and may end anywhere. Of two nodes with equal importance both or
none are frame, so ties need no rule. Repeated rows are extracted alike. Extra columns are
ignored. Empty tables give empty results.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import HOT_SHARE, materialize, release_memory, slices

THRESHOLD, DECAY, MIN_PAGES, MIN_SHARE = 0.4, 0.9, 4, 0.1
#: Importance that a node inside a stated article has before anything is known of it.
STATED = 0.35
_REMEMBERED = 20_000

#: Fixed values of HTML: element classes and elements without content.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCKS - frozenset("body caption head html legend optgroup option tbody td tfoot th thead tr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("iframe noembed noframes noscript script style textarea title xmp".split())
IN_HEAD = frozenset("base link meta noscript script style template title".split())
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "tbody": ("tbody", "thead", "tr", "td", "th"), "tfoot": ("tbody", "thead", "tr", "td", "th")}
FENCES = frozenset("table ul ol dl menu select html body article section div".split())
#: Roles stated by tags, ARIA roles and class or id words.
NOISE_TAGS = frozenset("aside button canvas dialog footer form head iframe input label menu nav noscript object option script select style svg template textarea title".split())
NOISE_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
NOISE_WORDS = frozenset("ad ads adbox adslot advert adverts advertisement advertising banner banners breadcrumb breadcrumbs byline comment comments commentlist consent cookie cookies copyright discussion disqus footer gdpr legal login masthead menu menubar menus modal nav navbar navigation newsletter notice notices notification overlay pager pagination paywall popup promo promos promotion recommended related replies reply respond responses share sharing sidebar sidebars signup skip social sponsor sponsored subscribe subscription toolbar topbar widget widgets".split())
MAIN_WORDS = frozenset("article content entry main post story".split())
PLAIN_WORDS = MAIN_WORDS | frozenset("area body container inner page section text wrap wrapper".split())

_TAG = re.compile(r"""<(?:!--(?:-?>|.*?(?:--!?>|\Z))|(/?)([A-Za-z][^\s/>]*)([^>"']*(?:"[^"]*"[^>"']*|'[^']*'[^>"']*)*)(>?)|[!?/][^>]*(?:>|\Z))""", re.S)
_ATTRIBUTE = re.compile(r"""(?:^|[\s"'/])(class|id|role|itemprop|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?(?=[\s/]|$)""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_HOST = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)"

NEUTRAL, NOISE, WEAK, STRONG, HEADER = range(5)
#: What leaves an element's text out: a form around it (until an article begins), or a role that nothing inside undoes.
FORM, OUT = 1, 2
_described: dict[tuple[str, str], tuple[str, int]] = {}


def describe(tag: str, attributes: str) -> tuple[str, int]:
    """Signature (tag and class words) and stated role of a start tag."""
    key = (tag, attributes)
    if (found := _described.get(key)) is None:
        if len(_described) > _REMEMBERED:
            _described.clear()
        found = _described[key] = _describe(tag, attributes)
    return found


def _describe(tag: str, attributes: str) -> tuple[str, int]:
    role, words = NEUTRAL, []
    if tag in NOISE_TAGS:
        role = NOISE
    elif tag == "header":
        role = HEADER
    elif tag in ("article", "main"):
        role = STRONG
    for m in _ATTRIBUTE.finditer(attributes) if attributes else ():
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            role = NOISE
        elif name == "role":
            own = value.lower().split()
            if NOISE_ROLES & set(own):
                role = NOISE
            elif {"main", "article"} & set(own) and role == NEUTRAL:
                role = STRONG
        elif name == "itemprop":
            role = STRONG if value == "articleBody" and role == NEUTRAL else role
        elif name in ("class", "id"):
            words += [w.lower() for w in _WORD.findall(unescape(value))]
    if words and tag not in ("html", "body"):
        own = set(words)
        if NOISE_WORDS & own:
            role = NOISE
        elif role == NEUTRAL and "header" in own:
            role = HEADER
        elif role == NEUTRAL and own <= PLAIN_WORDS and own & MAIN_WORDS:
            role = WEAK
    return tag + "".join(f".{w}" for w in sorted(set(words))), role


class _Element:
    """An open element. Its path holds the signature's hash and, lowest, whether it is inside a stated article."""

    __slots__ = ("tag", "path", "noise", "main", "block", "children", "branch")

    def __init__(self, tag, path, noise, main, block, branch):
        self.tag, self.path, self.noise, self.main, self.block, self.branch = tag, path, noise, main, block, branch
        self.children: list[str] = []


_paths: dict[tuple[int, str], int] = {}


def _path(parent: int, signature: str) -> int:
    key = (parent, signature)
    if (found := _paths.get(key)) is None:
        if len(_paths) > _REMEMBERED:
            _paths.clear()
        h = xxhash.xxh64_intdigest(signature.encode("utf-8", "replace"), seed=parent & (2**64 - 1))
        found = _paths[key] = h - (1 << 64) if h >> 63 else h
    return found


class Page:
    """One parsed page: its blocks in order and the presentation of its nodes."""

    def __init__(self, html: str | None):
        #: (path, strength of the article it is in, paths of all elements around it, text)
        self.blocks: list[tuple[int, int, tuple[int, ...], str]] = []
        #: path -> (parent, presentations seen)
        self.nodes: dict[int, tuple[int, set[str]]] = {}
        self._stack = [_Element("", 0, 0, NEUTRAL, True, ())]
        self._text: list[str] = []
        self._parse(html or "")

    def _flush(self) -> None:
        if self._text:
            text = " ".join("".join(self._text).split())
            self._text = []
            if text:
                top = next(e for e in reversed(self._stack) if e.block)
                self.blocks.append((top.path, top.main, top.branch, text))

    def _pop(self, to: int) -> None:
        """Close all elements from position ``to`` on."""
        if any(e.block for e in self._stack[to:]):
            self._flush()
        for e in self._stack[to:]:
            if e.block and not e.noise:
                collapsed = [c for i, c in enumerate(e.children) if not i or e.children[i - 1] != c]
                self.nodes.setdefault(e.path, (e.branch[-2] if len(e.branch) > 1 else 0, set()))[1].add(" ".join(collapsed))
        del self._stack[to:]

    def _find(self, tags: tuple[str, ...], fences: frozenset[str]) -> int:
        for i in range(len(self._stack) - 1, 0, -1):
            if self._stack[i].tag in tags:
                return i
            if self._stack[i].tag in fences:
                break
        return 0

    def _start(self, tag: str, attributes: str) -> None:
        stack = self._stack
        if tag == "br":
            self._text.append("\n")
        if tag in VOID and tag != "hr":
            return
        if stack[-1].tag == "head" and tag not in IN_HEAD or tag == "body" and (at := self._find(("head",), frozenset())):
            self._pop(at if tag == "body" and stack[-1].tag != "head" else len(stack) - 1)
        if tag in CLOSES_P and (at := self._find(("p",), frozenset(("table", "td", "th", "caption", "button", "object", "html")))):
            self._pop(at)
        if tag in ENDS:
            while at := self._find(ENDS[tag], FENCES - {"select"} if tag == "option" else FENCES):
                self._pop(at)
        if len(tag) == 2 and tag[0] == "h" and tag[1] in "123456" and len(stack[-1].tag) == 2 and stack[-1].tag[0] == "h" and stack[-1].tag[1] in "123456":
            self._pop(len(stack) - 1)
        signature, role = describe(tag, attributes)
        parent, block = stack[-1], tag in BLOCKS
        if block:
            self._flush()
        if tag == "hr":
            return
        main = max(parent.main, role if role in (WEAK, STRONG) else NEUTRAL)
        noise = max(parent.noise, FORM if tag == "form" else OUT if role == NOISE or role == HEADER and parent.main < STRONG else 0)
        if role == STRONG and noise == FORM:  # a form around the whole page
            noise = 0
        if block:
            nearest = parent if parent.block else next(e for e in reversed(stack) if e.block)
            path = _path(nearest.path, signature) & ~1 | (main > NEUTRAL)
            nearest.children.append(signature)
            stack.append(_Element(tag, path, noise, main, True, (*nearest.branch, path)))
        else:
            stack.append(_Element(tag, parent.path, noise, main, False, parent.branch))

    def _end(self, tag: str) -> None:
        if tag in ("html", "body"):
            return
        if tag == "br":
            self._text.append("\n")
        block = tag in BLOCKS
        for i in range(len(self._stack) - 1, 0, -1):
            e = self._stack[i]
            if e.tag == tag:
                self._pop(i)
                return
            if e.block and not block or e.tag in ("td", "th") and tag not in ("table", "tr", "tbody", "thead", "tfoot"):
                return

    def _say(self, piece: str) -> None:
        if not self._stack[-1].noise:
            self._text.append(unescape(piece) if "&" in piece else piece)

    def _parse(self, html: str) -> None:
        at = 0
        while m := _TAG.search(html, at):
            if m.start() > at:
                self._say(html[at : m.start()])
            at = m.end()
            if m[2] is None:
                continue
            tag = m[2].lower()
            if not m[4]:  # a quote that is never closed: the tag ends at the next '>'
                at = html.find(">", at) + 1 or len(html)
            if m[1]:
                self._end(tag)
                continue
            self._start(tag, m[3])
            if tag in RAW:
                close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(html, at)
                at = close.end() if close else len(html)
                self._pop(len(self._stack) - 1)
        if at < len(html):
            self._say(html[at:])
        self._pop(1)
        self._flush()

    def text(self, frame: frozenset[int] | set[int]) -> str:
        best = max((b[1] for b in self.blocks), default=NEUTRAL)
        return "\n".join(b[3] for b in self.blocks if b[1] >= best and not frame.intersection(b[2]))


def host_of(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, _HOST, 1), F.lit("")))


def _content(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "replace")) - (1 << 63)


def composite(nodes: pd.DataFrame) -> list[int]:
    """Paths that are frame. ``nodes`` (path, parent, looks, contents; the last null without text) are one host's.

    Inside a stated article a node starts with the prior ``STATED``, and only branches of
    an article that matters as a whole can be frame: if a host shows one article again
    and again, entropies cannot tell its text from its frame.
    """
    rows = {r.path: r for r in nodes.itertuples()}
    children: dict[int, list[int]] = {}
    for r in rows.values():
        children.setdefault(r.parent, []).append(r.path)
    importance: dict[int, float] = {}
    order, todo = [], [p for p, r in rows.items() if r.parent not in rows]
    while todo:
        order.append(p := todo.pop())
        todo += children.get(p, [])
    for p in reversed(order):
        r, below = rows[p], children.get(p, [])
        parts = [importance[c] for c in below]
        if r.contents is not None and not math.isnan(r.contents):
            parts.append(r.contents)
        inner = sum(parts) / len(parts) if parts else r.looks
        weight = DECAY ** len(below)
        importance[p] = (1 - weight) * max(r.looks, inner) + weight * inner if below else inner
    silent: set[int] = set()  # parts of articles of which nothing can be told, their tops first
    for p in order:
        parent = rows[p].parent
        if p & 1 and (parent in silent or not (parent in rows and parent & 1) and importance[p] < THRESHOLD):
            silent.add(p)
    noise: set[int] = set()
    for p in reversed(order):
        own = STATED + (1 - STATED) * importance[p] if p & 1 else importance[p]
        if own < THRESHOLD and p not in silent and all(c in noise for c in children.get(p, [])):
            noise.add(p)
    return sorted(noise)


def frames(pages: DataFrame) -> DataFrame:
    """host and the paths of its frame (array<long>), from all pages (host, html)."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "html"):
                n: Counter[tuple[str, int, int, int, int]] = Counter()
                for host, html in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
                    page = Page(html)
                    for path, (parent, shown) in page.nodes.items():
                        n[host, path, parent, 0, _content("|".join(sorted(shown)))] += 1
                    for path, feature in {(b[0], _content(b[3])) for b in page.blocks}:
                        n[host, path, 0, 1, feature] += 1
                columns = list(zip(*(k for k in n))) if n else [()] * 5
                arrays = [pa.array(c, t) for c, t in zip([*columns, list(n.values())], (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()))]
                yield pa.RecordBatch.from_arrays(arrays, ["host", "path", "parent", "kind", "feature", "n"])

    seen = pages.select("host", "html").mapInArrow(look, "host string, path long, parent long, kind int, feature long, n long")
    seen = seen.groupBy("host", "path", "kind", "feature").agg(F.sum("n").alias("n"), F.max("parent").alias("parent"))
    n, look_ = F.col("n"), F.col("kind") == 0
    node = seen.groupBy("host", "path").agg(
        F.sum(F.when(look_, n)).alias("m"),
        F.max(F.when(look_, F.col("parent"))).alias("parent"),
        F.sum(F.when(look_, n * F.log(n))).alias("look_nlogn"),
        F.sum(F.when(~look_, n)).alias("content_n"),
        F.sum(F.when(~look_, n * F.log(n))).alias("content_nlogn"),
    )
    log_m = F.log("m")
    node = node.where(F.col("m") >= MIN_PAGES).select("host", "path", "parent", "m", (1 - F.col("look_nlogn") / F.col("m") / log_m).alias("looks"), (1 - F.col("content_nlogn") / F.col("content_n") / log_m).alias("contents"))
    sizes = pages.groupBy("host").agg(F.count("*").alias("pages"))
    node = node.join(sizes, "host").where(F.col("m") >= F.col("pages") * MIN_SHARE)

    def weigh(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"host": [key[0]], "frame": [composite(rows)]})

    return node.groupBy("host").applyInPandas(weigh, "host string, frame array<bigint>")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), host_of(F.col("url").cast("string")).alias("host"))
    model = materialize(frames(rows), "frames")
    sizes = materialize(rows.groupBy("host").agg(F.count("*").alias("pages")), "hosts")
    total = sizes.agg(F.coalesce(F.sum("pages"), F.lit(0))).first()[0]
    hot = sizes.where(F.col("pages") > F.lit(total * HOT_SHARE)).join(model, "host", "left").select("host", "frame")  # at most 1 / HOT_SHARE hosts
    cold = rows.join(F.broadcast(hot.select("host")), "host", "left_anti").join(model, "host", "left")
    dealt = rows.join(F.broadcast(hot), "host").unionByName(cold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "html"):
                texts = [Page(html).text(frozenset(frame or ())) for html, frame in zip(batch.column("html").to_pylist(), batch.column("frame").to_pylist())]
                yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])
            release_memory()

    return dealt.select("page_id", "url", "html", "frame").mapInArrow(run, "page_id long, url string, text string, n_chars long")
