"""Main text of web pages, by the container paths a host's pages agree on.

A page's containers are scored by their prose (text outside links and outside
elements that are never article text); the innermost one that holds most of it
votes for its path of generalised tags and classes.  Spark counts the votes of each
host, and every page is extracted anew along the path with most votes among those
that hold all of its prose.
"""

from __future__ import annotations

import hashlib
import html as entities
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import checked_broadcast, durable
from .tokens import small_batches
from .urls import host_of

_TAG = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*)([^>]*)>?|!--|[!?/][^>]*>?)")
_CLASS = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_DIGITS = re.compile(r"\d+")
_GAP = re.compile(r"\s+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rb rt rp s samp small span "
    "strike strong sub sup time tt u var wbr img input".split()
)
CONTAINERS = frozenset("body main article section div td center".split())
#: Elements that never hold article text, by tag, by role and by a word of class or id.
DROPPED = frozenset(
    "head nav header footer aside form button menu dialog noscript template iframe svg math object select".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies "
    "copyright disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notification "
    "outbrain pager pagination popup promo promotion recommended related replies reply respond share sharing sidebar signup "
    "skip social sponsor sponsored subscribe subscription taboola toolbar widget".split()
)
NEVER_DROPPED = frozenset("html body main article".split())
CLOSES = {
    "li": ("li", {"ul", "ol", "menu"}), "td": ("td", {"tr", "table"}), "th": ("th", {"tr", "table"}),
    "tr": ("tr", {"table"}), "dt": ("dd", {"dl"}), "dd": ("dt", {"dl"}), "option": ("option", {"select"}),
}


def _named(names: str) -> bool:
    for name in names.split():
        parts = [p.lower() for p in _PARTS.findall(name)]
        if parts and parts[0] not in ("has", "with", "no", "without") and (parts[0] in NAMES or parts[-1] in NAMES):
            return True
    return False


class _Names:
    """What class, id, role and style of a start tag say, kept per distinct tag."""

    def __init__(self):
        self.seen: dict[tuple[str, str], tuple[str, bool]] = {}

    def __call__(self, tag: str, attributes: str) -> tuple[str, bool]:
        key = (tag, attributes)
        found = self.seen.get(key)
        if found is None:
            step, drop = tag, tag in DROPPED
            for name, a, b, c in _CLASS.findall(attributes):
                name, value = name.lower(), a or b or c
                if name == "class":
                    step = ".".join([tag, *sorted(_DIGITS.sub("#", x) for x in value.split())])
                if name in ("class", "id"):
                    drop |= _named(value)
                elif name == "role":
                    drop |= value.lower() in ROLES
                elif name == "style":
                    drop |= "display:none" in value.replace(" ", "").lower()
                else:
                    drop |= name == "hidden" or value.lower() == "true"
            found = step, drop and tag not in NEVER_DROPPED
            if len(self.seen) < 50_000:
                self.seen[key] = found
        return found


class Page:
    """The text chunks of a page and its containers.

    ``chunks`` are pieces of text in page order, None where a block ends; text of
    dropped elements is left out.  ``prose[i]`` counts the characters outside
    links before chunk i.  ``containers`` holds (path, first chunk, end chunk).
    """

    def __init__(self, source: str, names: _Names):
        self.chunks: list[str | None] = []
        self.prose = [0]
        self.containers: list[list] = []
        stack: list[tuple] = []  # tag, container number, dropped, in link, path
        at, end, dropped, linked, path = 0, len(source), False, False, ""

        def text(piece: str) -> None:
            if not dropped and piece:
                self.chunks.append(piece)
                self.prose.append(self.prose[-1] + (0 if linked or piece.isspace() else len(piece)))

        def gap() -> None:
            if self.chunks and self.chunks[-1] is not None:
                self.chunks.append(None)
                self.prose.append(self.prose[-1])

        def pop(to: int) -> None:
            nonlocal dropped, linked, path
            while len(stack) > to:
                tag, number, dropped, linked, path = stack.pop()
                if number is not None:
                    self.containers[number][2] = len(self.chunks)
                if tag not in INLINE:
                    gap()

        while at < end:
            m = _TAG.search(source, at)
            if m is None:
                text(source[at:])
                break
            if m.start() > at:
                text(source[at : m.start()])
            at = m.end()
            tag = m[2]
            if tag is None:
                if m[0] == "<!--":
                    close = source.find("-->", at)
                    at = end if close < 0 else close + 3
                continue
            tag, attributes = tag.lower(), m[3]
            if attributes.count('"') % 2:  # a > inside quotes
                quote = source.find('"', at)
                close = source.find(">", quote) if quote >= 0 else -1
                if close >= 0:
                    attributes, at = source[m.start(3) : close], close + 1
            if m[1]:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == tag:
                        pop(k)
                        break
                else:
                    if tag == "p":
                        gap()
                continue
            if tag in VOID:
                if tag in ("br", "hr"):
                    gap()
                continue
            if tag in RAW:
                close = _raw_end(source, tag, at)
                at = end if close < 0 else close
                stop = source.find(">", at)
                at = end if stop < 0 else stop + 1
                continue
            if attributes.endswith("/") and tag in INLINE:
                continue
            if tag not in INLINE:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == "p":
                        pop(k)
                        break
                    if stack[k][0] not in INLINE:
                        break
                if tag in CLOSES:
                    other, within = CLOSES[tag]
                    for k in range(len(stack) - 1, -1, -1):
                        if stack[k][0] in (tag, other):
                            pop(k)
                            break
                        if stack[k][0] in within:
                            break
                gap()
            step, drop = names(tag, attributes)
            number = None
            before = dropped, linked, path
            if tag not in INLINE and tag != "p":
                path = f"{path}/{step}"
                if tag in CONTAINERS and not dropped and not drop:
                    number = len(self.containers)
                    self.containers.append([path, len(self.chunks), None])
            stack.append((tag, number, *before))
            dropped |= drop
            linked |= tag == "a"
        pop(0)

    def score(self, container: list) -> int:
        return self.prose[container[2]] - self.prose[container[1]]

    def best(self, share: float = 0.8) -> list:
        """The innermost container with ``share`` of the page's prose, or the whole page."""
        whole = ["", 0, len(self.chunks)]
        least, found = share * self.score(whole), whole
        for c in self.containers:
            if c[1] >= found[1] and c[2] <= found[2] and self.score(c) >= least:
                found = c
        return found

    def fitting(self) -> dict[str, list[list]]:
        """By key of their path, the containers of every path that together hold all of the page's prose."""
        total = self.prose[-1]
        by_path: dict[str, list] = {}
        for c in self.containers if total else ():
            by_path.setdefault(c[0], []).append(c)
        return {_key(path): found for path, found in by_path.items() if sum(map(self.score, found)) >= total}

    def chosen(self, key: str | None) -> list[list]:
        """The containers under ``key`` if they hold all of the prose, else the innermost
        container that does, or the whole page."""
        found = self.fitting().get(key) if key else None
        return found or [self.best(1.0) if self.prose[-1] else ["", 0, len(self.chunks)]]

    def text(self, containers: list[list]) -> str:
        blocks: list[str] = []
        for c in containers:
            inline: list[str] = []
            for piece in [*self.chunks[c[1] : c[2]], None]:
                if piece is not None:
                    inline.append(piece)
                elif inline:
                    block = _GAP.sub(" ", entities.unescape("".join(inline))).strip()
                    if block:
                        blocks.append(block)
                    inline = []
        return " ".join(blocks)


def _raw_end(source: str, tag: str, at: int) -> int:
    """Where the end tag of ``tag`` begins, in the source's own offsets (lower-casing may change its length)."""
    m = re.compile(f"</{tag}", re.I | re.A).search(source, at)
    return m.start() if m else -1


def _key(path: str) -> str:
    return hashlib.md5(path.encode(errors="replace")).hexdigest()


def _cast(pages: DataFrame) -> DataFrame:
    """(host, path, fits) of every page: its vote and the keys of the paths that hold all of its prose."""

    def vote(batches):
        names = _Names()
        for batch in small_batches(batches):
            read = [Page(h or "", names) for h in batch.column(1).to_pylist()]
            paths = pa.array([page.best()[0] for page in read], pa.string())
            fits = pa.array([sorted(page.fitting()) for page in read], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column(0), paths, fits], ["host", "path", "fits"])

    return pages.select(host_of(F.col("url")).alias("host"), "html").mapInArrow(
        vote, "host string, path string, fits array<string>")


def votes(pages: DataFrame) -> DataFrame:
    """(host, path, votes): how many of a host's pages have their best container on a path."""
    return _cast(pages).where("path <> ''").groupBy("host", "path").agg(F.count("*").alias("votes"))


def consensus(cast: DataFrame) -> DataFrame:
    """(host, fits, key): of the paths a page can use, the one with most votes of its
    host; ties by path.  Every path with a vote counts; pages whose paths are the
    same are answered once."""
    seen = durable(cast.groupBy("host", "path", "fits").agg(F.count("*").alias("n")))
    counted = seen.where("path <> ''").groupBy(F.col("host").alias("h"), "path").agg(F.sum("n").alias("votes"))
    asked = seen.where(F.size("fits") > 1).select("host", "fits").distinct()
    return (
        asked.select("host", "fits", F.explode("fits").alias("key"))
        .join(counted.withColumn("k", F.md5("path")), (F.col("host") == F.col("h")) & (F.col("key") == F.col("k")))
        .groupBy("host", "fits").agg(F.min(F.struct(-F.col("votes"), "path", "key"))["key"].alias("key"))
    )


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text and path (of the container used) for every row of ``pages``.

    A null or empty html has an empty text.  Pages whose url has no host vote
    together.  Rows may repeat; each votes and is extracted.  A host's path is used
    only where it holds all of a page's prose; otherwise the page's innermost container
    that does is used.  Only links outside the container are lost, and none of a page
    without prose.
    """
    chosen = checked_broadcast(durable(consensus(_cast(pages)).select(
        F.col("host").alias("h"), F.col("fits").alias("f"), "key")))
    kind = dict(pages.dtypes)["page_id"]

    def fit(batches):
        names = _Names()
        for batch in small_batches(batches):
            fits = [sorted(Page(h or "", names).fitting()) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(fits, pa.list_(pa.string()))], ["page_id", "url", "html", "host", "fits"])

    rows = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host")).mapInArrow(
        fit, f"page_id {kind}, url string, html string, host string, fits array<string>")
    rows = rows.join(chosen, (F.col("host") == F.col("h")) & (F.col("fits") == F.col("f")), "left").select(
        "page_id", "url", "html", "key")

    def extract(batches):
        names = _Names()
        for batch in small_batches(batches):
            texts, used = [], []
            for source, key in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                page = Page(source or "", names)
                found = page.chosen(key)
                texts.append(page.text(found))
                used.append(found[0][0])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(used, pa.string())],
                ["page_id", "url", "text", "path"])

    return rows.mapInArrow(extract, f"page_id {kind}, url string, text string, path string")
