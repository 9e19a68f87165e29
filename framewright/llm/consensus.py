"""Main text of pages by consensus host paths.

Each page's containers are scored by the text of their blocks; a container's path is its tag and class names from the root,
digits generalised. Spark sums the scores of each path over a host's pages, combined before the shuffle, and
the path with the largest sum wins; the text of a page is then extracted again, from the containers on
the winning path of its host. A page without such a container falls back on its own best one.

Never text: what stands in ``SKIP`` elements or in elements whose class, id or role names a ``NOISE`` word. Ties between paths go to the
smaller path. Defined results: null or empty html gives an empty text; pages with a null url or without a host vote together as the
host ''; repeated pages each vote and each get their text; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.llm.common import text_batches, written

SKIP = frozenset("script style nav header footer aside form noscript template iframe svg select button textarea object head title dialog menu".split())
RAW = frozenset("script style textarea title noscript iframe".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCKS = frozenset("p div article section main body html h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table tbody thead tfoot tr td th pre blockquote figure figcaption hr address details summary center br".split())
NOISE = frozenset("ad ads advert advertisement advertising adverts sponsor sponsored promo banner comment comments reply replies discussion disqus sidebar menu nav navigation navbar breadcrumb breadcrumbs footer header masthead cookie cookies consent notice notices notification alert popup modal newsletter subscribe signup social share sharing related widget pagination login".split())
#: A tag ends before the next ``<`` outside quotes, and nothing is tried twice, so that a page of unclosed tags takes linear time.
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/<>]*+)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[!?][^>]*+(?:>|\Z)", re.S)
_OPEN_END = re.compile(r"</?[a-zA-Z]")
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_CLOSES_P = frozenset("p div article section main h1 h2 h3 h4 h5 h6 ul ol dl table pre blockquote figure hr address details form nav header footer aside".split())
_SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}


def _names(attributes: str) -> tuple[str, bool]:
    """The generalised classes of a tag, and whether it is noise."""
    classes, noise = [], False
    for kind, a, b, c in _ATTRIBUTE.findall(attributes):
        words = (a or b or c).lower().split()
        if kind.lower() == "class":
            classes += [re.sub(r"\d+", "0", w) for w in words]
        noise = noise or any(p in NOISE for w in words for p in re.split(r"[-_\d]+", w))
    return "".join("." + c for c in sorted(classes)), noise


def blocks(html: str) -> list[tuple[tuple[str, ...], str, int]]:
    """(path, text, container) of each text block of a page in order; container numbers the block's innermost element of kind block."""
    out: list[tuple[tuple[str, ...], str, int]] = []
    stack: list[tuple[str, str, bool, int]] = []  # tag, step, skipped, number
    held: list[str] = []
    opened: Counter[str] = Counter()  # how often each tag stands in the stack
    number = at = 0
    skipped = 0

    def close() -> None:
        text = " ".join(unescape("".join(held)).split())
        held.clear()
        if text:
            inner = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] in BLOCKS), -1)
            out.append((tuple(s[1] for s in stack[: inner + 1]), text, stack[inner][3] if inner >= 0 else 0))

    def pop() -> None:
        nonlocal skipped
        tag, _, skip, _ = stack[-1]
        if tag in BLOCKS or skip:
            close()
        stack.pop()
        opened[tag] -= 1
        skipped -= skip

    tail = _OPEN_END.search(html, html.rfind(">") + 1)  # a tag that never ends is no text
    if tail:
        html = html[: tail.start()]
    end = len(html)
    while at < end:
        m = _TOKEN.search(html, at)
        if not m:
            if not skipped:
                held.append(html[at:])
            break
        if m.start() > at and not skipped:
            held.append(html[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if opened[tag]:
                while stack[-1][0] != tag:
                    pop()
                pop()
            continue
        if tag in BLOCKS or tag in SKIP:
            if not skipped:
                close()
            if tag in _CLOSES_P and opened["p"] and stack[-1][0] not in ("td", "th", "li", "div"):
                while opened["p"]:
                    pop()
            while stack and stack[-1][0] in _SAME.get(tag, ()):
                pop()
        if tag in VOID or m[3].endswith("/"):
            continue
        classes, noise = _names(m[3]) if "=" in m[3] else ("", False)
        skip = tag in SKIP or (noise and tag not in ("html", "body"))
        number += 1
        stack.append((tag, tag + classes, skip, number))
        opened[tag] += 1
        skipped += skip
        if tag in RAW:
            stop = re.compile(rf"</{tag}[\s>/]", re.I).search(html, at)
            at = stop.start() if stop else end
    while stack:
        pop()
    close()
    return out


def scores(found) -> dict[str, int]:
    """Score of each container path of a page: the text of its own blocks, and half of its children's."""
    out: dict[str, int] = {}
    for path, text, _ in found:
        weight = len(text) + 20 * text.count(",")
        # a block of text is a leaf: its parent holds it, its grandparent holds half of it
        for level, share in ((1, 2), (2, 1)):
            if len(path) > level:
                key = "/".join(path[:-level])
                out[key] = out.get(key, 0) + weight * share
    return out


def main_text(found, winner: str | None) -> str:
    """The blocks under the winning path, or under the page's own best path, joined by a space."""
    def under(key: str) -> list[str]:
        steps = tuple(key.split("/"))
        return [text for path, text, _ in found if path[: len(steps)] == steps]

    texts = under(winner) if winner else []
    if not texts and (own := scores(found)):
        texts = under(min(own, key=lambda k: (-own[k], k)))
    return " ".join(texts or [text for _, text, _ in found])


def host_of(url: str = "url"):
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def winning_paths(pages: DataFrame) -> DataFrame:
    """(host, path): the container path with the largest sum of scores over each host's pages."""

    def run(batches):
        for b in batches:
            votes: dict[tuple[str, str], int] = {}
            for host, html in zip(b.column(0).to_pylist(), b.column(1)):
                for path, n in scores(blocks(html.as_py() or "")).items():
                    votes[host, path] = votes.get((host, path), 0) + n
            yield pa.RecordBatch.from_pylist([{"host": h, "path": p, "n": n} for (h, p), n in votes.items()], schema=pa.schema([("host", pa.string()), ("path", pa.string()), ("n", pa.int64())]))

    votes = pages.select(host_of().alias("host"), F.col("html").cast("string")).mapInArrow(run, "host string, path string, n bigint")
    votes = votes.groupBy("host", "path").agg(F.sum("n").alias("n"))
    return votes.groupBy("host").agg(F.min_by("path", F.struct(-F.col("n"), "path")).alias("path"))


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) of each row of ``pages``."""
    text_batches(pages.sparkSession)
    winners = written(winning_paths(pages), "paths")
    rows = pages.select(F.col("page_id").cast("bigint"), F.col("url").cast("string"), F.col("html").cast("string"), host_of().alias("host"))

    def run(batches):
        for b in batches:
            texts = [main_text(blocks(h or ""), w) for h, w in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    both = rows.join(winners, "host", "left").select("page_id", "url", "html", "path")
    return both.mapInArrow(run, "page_id bigint, url string, text string")
