"""Main text of web pages by consensus of each host's pages.

Each page's containers are scored by the clean text below them, and the page votes for the generalised tag-class path (digits
left out) of the container that it finds best. A path goes by an 8-byte hash of the whole of it, however long it is. Spark sums the votes
of each host, whose templates are all paths of two pages or more with ``TEMPLATE_SHARE`` of its votes or more. A page whose own best container lies on one of them
is taken from the containers on that path. Any other page is taken from the template that scores best on it, an inner one in place of an
outer one that adds little, or from its own best container if it has no template's text or but a small part of its own best. The path given
with a page is that of the containers its text is from, null if it has no text.

Inside the chosen containers, menus, headers, footers, asides, forms, scripts, styles, adverts, notices and reader comments are left out by
tag, role or, of a box, class word. Character references are decoded, each stretch between two tags by itself, white space inside a block becomes one space, and blocks are joined by
one space. A null or empty page, or one without text, gives an empty text; a null url belongs to a host of its own (empty
name). A null page_id stays null; an element that is never closed ends with
the page, and depth costs nothing beyond the nodes. Repeated rows give repeated results; further columns are left out.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factspark.llm.text import chunks
from factspark.session import shared_dir, ship

#: Hosts whose templates may be broadcast, the name and at most 1 / TEMPLATE_SHARE keys of 8 bytes each; beyond it they are joined.
BROADCAST_HOSTS = 20_000
#: A path with less of its host's votes, or of one page alone, is no template; its pages still have their own best container.
TEMPLATE_SHARE = 0.1
#: Text on a template that is a lesser part of the text of the page's own best container is a stray block.
STRAY_PART = 0.15

# Names of HTML elements by their role in the standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template svg select object canvas audio video math".split())
BLOCK = frozenset("address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
CONTAINER = frozenset("article body div main section td".split())
BOXES = frozenset("div section ul ol dl table figure details blockquote".split())
DROPPED = frozenset("nav header footer aside form menu head button dialog label fieldset".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar alert dialog".split())
DROPPED_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus disclaimer discussion footer gdpr header hidden masthead menu modal nav navbar navigation newsletter notice notices notification outbrain pager pagination popup promo promoted promotion related reply replies respond share sharing sidebar signup skip social sponsor sponsored subscribe subscription taboola teaser toolbar topbar widget widgets".split()
)
#: A start of one of these ends an open one of the same group.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPE = frozenset("ul ol dl table article section div main body td th blockquote aside nav header footer form".split())
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^"'>]|"[^"]*"|'[^']*')*)>|</?[a-zA-Z][^<>]*(?:>|\Z)""", re.S)
_ATTR = re.compile(r"""(class|id|role|hidden|style|aria-hidden)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_SPLIT = re.compile(r"[^a-zA-Z]+|(?<=[a-z])(?=[A-Z])")
_SPACE = re.compile(r"\s+")


@lru_cache(maxsize=1 << 14)
def step_key(above: int, step: str) -> int:
    """Stands for a whole path: hashes the last step with the key of the path above, so a deep path costs no more than a shallow one."""
    return int.from_bytes(hashlib.blake2b(step.encode("utf-8", "surrogatepass"), digest_size=8, salt=above.to_bytes(8, "big", signed=True)).digest(), "big", signed=True)


def path_key(path: str) -> int:
    key = 0
    for step in path.split(">")[1:]:
        key = step_key(key, step)
    return key


@dataclass
class Node:
    tag: str
    step: str
    key: int
    parent: int
    chars: int = 0
    links: int = 0
    begin: int = 0
    end: int = -1
    children: list[int] = field(default_factory=list)


class Page:
    """Containers of a page, and its clean blocks in order; each block is (text, container)."""

    def __init__(self, source: str):
        self.nodes: list[Node] = [Node("", "", 0, -1)]
        self.blocks: list[str] = []
        self._read(source or "")

    def _read(self, source: str) -> None:
        stack: list[tuple[str, int, bool]] = [("", 0, False)]  # tag, container, dropped
        buffer: list[str] = []
        linked = 0
        at, n = 0, len(source)
        opened: Counter[str] = Counter()  # open elements of each tag
        unended: set[str] = set()  # raw elements without an end from here on

        def flush() -> None:
            nonlocal linked
            text = _SPACE.sub(" ", "".join(buffer)).strip() if buffer else ""
            buffer.clear()
            if text:
                self.blocks.append(text)
                node = self.nodes[stack[-1][1]]
                node.chars += len(text)
                node.links += min(linked, len(text))
            linked = 0

        def close(depth: int) -> None:
            while len(stack) > depth:
                if stack[-1][0] in BLOCK:
                    flush()
                tag, node, _ = stack.pop()
                opened[tag] -= 1
                if stack[-1][1] != node:
                    self.nodes[node].end = len(self.blocks)

        links = 0
        while at < n:
            m = _TAG.search(source, at)
            piece = source[at : m.start() if m else n]
            if piece and not stack[-1][2]:
                buffer.append(html.unescape(piece))  # a reference doesn't go on beyond a tag
                if links:
                    linked += len(piece)
            if not m:
                break
            at = m.end()
            tag = (m[2] or "").lower()
            if not tag:
                continue
            if m[1]:
                if tag == "a":
                    links = max(0, links - 1)
                if opened[tag]:
                    close(next(depth for depth in range(len(stack) - 1, 0, -1) if stack[depth][0] == tag))
                elif tag in BLOCK and not stack[-1][2]:
                    flush()
                continue
            if tag in RAW:
                stop = None if tag in unended else re.compile(rf"</{tag}\s*>", re.I).search(source, at)
                if not stop:
                    unended.add(tag)
                at = stop.end() if stop else (n if tag in ("script", "style") else at)
                continue
            if tag in VOID:
                if tag in BLOCK and not stack[-1][2]:
                    if tag == "br":
                        buffer.append(" ")
                    else:
                        flush()
                continue
            if tag in BLOCK:
                ends = _ENDS.get(tag)
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth][0] == "p" or ends and stack[depth][0] in ends:
                        close(depth)
                        if stack[-1][0] not in (ends or ()):
                            break
                    elif stack[depth][0] in _SCOPE:
                        break
                flush()
            attrs = {a.lower(): b or c or d or "" for a, b, c, d in _ATTR.findall(m[3])} if m[3] else {}
            _, node, dropped = stack[-1]
            dropped = dropped or tag in DROPPED or attrs.get("role", "").lower() in DROPPED_ROLES or not DROPPED_WORDS.isdisjoint(_words(tag, attrs)) or "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" or "display:none" in attrs.get("style", "").replace(" ", "").lower()
            if m[3].endswith("/") and tag not in BLOCK:
                continue
            if tag == "a":
                links += 1
            if tag in CONTAINER and not dropped:
                step = re.sub(r"\d+", "", ".".join([tag, *sorted(attrs.get("class", "").split())]))
                parent, node = node, len(self.nodes)
                self.nodes.append(Node(tag, step, step_key(self.nodes[parent].key, step), parent, begin=len(self.blocks)))
                self.nodes[parent].children.append(node)
            stack.append((tag, node, dropped))
            opened[tag] += 1
        close(1)
        flush()
        self.nodes[0].end = len(self.blocks)
        for node in reversed(self.nodes[1:]):  # a container comes after the one it is in
            self.nodes[node.parent].chars += node.chars
            self.nodes[node.parent].links += node.links

    def path(self, k: int) -> str:
        steps = []
        while k > 0:
            steps.append(self.nodes[k].step)
            k = self.nodes[k].parent
        return "".join(f">{x}" for x in reversed(steps))

    def score(self, k: int) -> float:
        """Clean characters below a container, those in links counted against it."""
        return self.nodes[k].chars - 1.5 * self.nodes[k].links

    def best(self) -> int:
        """From the root down to the last container that still holds nearly all of the score; an article outweighs its neighbours."""
        k = 0
        while True:
            weight = {c: self.score(c) * (3 if self.nodes[c].tag in ("article", "main") else 1) for c in self.nodes[k].children}
            top = max(weight, key=weight.get, default=None)
            if top is None or weight[top] <= 0:
                return k
            if weight[top] < 0.6 * (sum(max(0.0, w) for w in weight.values()) + max(0.0, self.score(k) - sum(self.score(c) for c in weight))):
                return k
            k = top

    def text(self, k: int) -> str:
        return " ".join(self.blocks[self.nodes[k].begin : self.nodes[k].end])

    def on_path(self, key: int) -> list[int]:
        """The containers on the path that aren't inside another one on it."""
        out, until = [], -1
        for k, node in enumerate(self.nodes):
            if node.key == key and node.begin >= until:
                out.append(k)
                until = node.end
        return out

    def chosen(self, keys: list[int] | None) -> tuple[str, str | None]:
        """(text, path) on the template of the host that fits the page, or of the page's own best container."""
        k = self.best()
        own, key = self.text(k), self.nodes[k].key
        if keys:
            voted = {n.key for n in self.nodes} & set(keys)
            at = key if key in voted else self._template(voted)
            if at is not None:
                found = self.on_path(at)
                text = " ".join(t for t in map(self.text, found) if t)
                if text and (at == key or len(text) >= STRAY_PART * len(own)):
                    return text, self.path(found[0])
        return own, self.path(k) if own else None

    def _template(self, voted: set[int]) -> int | None:
        """The path whose containers score best, then any inner one that holds most of that, as in ``best``."""
        on = {p: self.on_path(p) for p in sorted(voted)}
        score = {p: sum(map(self.score, ks)) for p, ks in on.items()}
        above = {p: self._above(ks[0]) for p, ks in on.items()}
        at = max(score, key=score.get, default=None)
        while at is not None:
            inner = {p: v for p, v in score.items() if at in above[p] and v >= 0.6 * score[at]}
            if not inner or score[at] <= 0:
                break
            at = max(inner, key=inner.get)
        return at

    def _above(self, k: int) -> set[int]:
        """The paths of all containers that a container is in."""
        out = set()
        while (k := self.nodes[k].parent) > 0:
            out.add(self.nodes[k].key)
        return out


def _words(tag: str, attrs: dict[str, str]) -> set[str]:
    """The words by which an element may be left out: all of a box, whole classes of a paragraph or an item, none of what stands in a sentence."""
    if tag in BOXES:
        return {w.lower() for w in _SPLIT.split(attrs.get("class", "") + " " + attrs.get("id", ""))}
    return {w.lower() for w in attrs.get("class", "").split()} if tag in ("p", "li") else set()


def _pages(df: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    ship(df.sparkSession)
    url = df[url_col].cast("string")
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))
    return df.select(df[id_col].alias("id"), url.alias("url"), host.alias("host"), F.coalesce(df[html_col].cast("string"), F.lit("")).alias("html"))


def votes(pages: DataFrame) -> DataFrame:
    """(host, keys): the templates of each host, by the best paths of its pages, each weighed by the root of its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: dict[tuple[str, int], tuple[float, int]] = {}
            for i, j in chunks(b["html"]):
                for host, source in zip(b["host"][i:j].to_pylist(), b["html"][i:j].to_pylist(), strict=True):
                    page = Page(source)
                    k = page.best()
                    if page.nodes[k].chars:
                        at = host, page.nodes[k].key
                        vote, n = found.get(at, (0.0, 0))
                        found[at] = vote + page.nodes[k].chars ** 0.5, n + 1
            yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in found], pa.string()), pa.array([p for _, p in found], pa.int64()), pa.array([v for v, _ in found.values()], pa.float64()), pa.array([n for _, n in found.values()], pa.int64())], ["host", "key", "votes", "n"])

    counted = pages.select("host", "html").mapInArrow(run, "host string, key long, votes double, n long").groupBy("host", "key").agg(F.sum("votes").alias("votes"), F.sum("n").alias("n"))
    whole = counted.groupBy(F.col("host").alias("of")).agg(F.sum("votes").alias("whole"))
    enough = counted.join(whole, counted["host"] == whole["of"]).where("n > 1").where(F.round("votes", 6) >= F.round(TEMPLATE_SHARE * F.col("whole"), 6))
    return enough.groupBy("host").agg(F.sort_array(F.collect_list("key")).alias("keys"))  # few a host


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars, path) of each page."""
    pages = _pages(df, id_col, url_col, html_col)
    shared_dir(df.sparkSession)
    winners = votes(pages).checkpoint()
    if winners.count() <= BROADCAST_HOSTS:
        winners = F.broadcast(winners)
    kind = dict(pages.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j in chunks(b["html"]):
                found = [Page(source).chosen(keys) for source, keys in zip(b["html"][i:j].to_pylist(), b["keys"][i:j].to_pylist(), strict=True)]
                texts = [t for t, _ in found]
                yield pa.RecordBatch.from_arrays([b["id"][i:j], b["url"][i:j], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array([p for _, p in found], pa.string())], ["id", "url", "text", "n_chars", "path"])

    joined = pages.join(winners, "host", "left").select("id", "url", "html", "keys")
    return joined.mapInArrow(run, f"id {kind}, url string, text string, n_chars long, path string").withColumnRenamed("id", id_col)
