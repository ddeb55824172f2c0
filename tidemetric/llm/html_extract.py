"""HTML extraction by consensus host paths.

1. Every page scores its containers: the share of the page's clean text that each holds.
   Its vote is the generalised tag-class path of the deepest container that holds most.
2. Spark counts votes per (host, path) and keeps each host's winning path. Votes are
   pre-aggregated map-side, so a host with a third of all pages is a few rows a task.
3. Every page is read again: the text of the containers on its host's winning path, or
   of its own best container where the page has none on that path.

Menus, headers, footers, sidebars, notices, adverts, forms and comments are left out by tag
and role, and by class and id: by a name that is listed, or that is made of listed and
structural words alone (``site-header``, ``comment-list``), never by one word among others
(``with-sidebar``, ``share-prices``). A form, or a name with structural words, that holds most of the page's
text and all its headings wraps the page and stays, unless it names comments. Paths of hosts with many
pages are broadcast, a bounded number of them; pages of all other hosts meet theirs by host.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemetric.llm.common import cut, join_by_key, small_batches, table
from tidemetric.llm.url_filter import url_host

SHARE = 0.7

# HTML element kinds.
RAW = frozenset("script style noscript template textarea title svg math iframe object select button canvas xmp noembed noframes".split())
CONTAINERS = frozenset("body main article section div table tbody thead tfoot tr td th ul ol dl center fieldset details figure blockquote nav header footer aside form menu dialog search address hgroup".split())
BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre caption figcaption legend summary hr option optgroup".split())
HEADINGS = frozenset("h1 h2".split())
LEFT_OUT = frozenset("nav header footer aside menu dialog search address head".split())
LEFT_OUT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar".split())
# Class names and ids that mark parts which are not the article, those of them that mark comments, and words that add nothing to them.
LEFT_OUT_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense adslot banner banners breadcrumb breadcrumbs comment comments commentlist "
    "consent cookie cookies disqus footer foot gdpr header masthead menu menus modal nav navbar navigation navi newsletter notice notices pager pagination "
    "popup promo promoted promotion recommended related replies reply respond share sharing sidebar skip social sponsor sponsored subscribe subscription toolbar topbar widget widgets".split()
)

COMMENTS = frozenset("comment comments commentlist disqus replies reply respond".split())
STRUCTURAL = frozenset(
    "area bar block bottom box buttons center column container div form global group holder icons inner item items left link links list local main middle nav outer page panel "
    "post posts primary right row secondary section signup site slot strip thread top unit user wrap wrapper zone".split()
)

_OPEN = re.compile(r"<(?:!--|[!?]|(/?)([a-zA-Z][^\s/<>]*+)|/)")
_PLAIN = re.compile(r"[^>\"']*+>")
_QUOTED = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>")
_MARK = re.compile(r"[>\"']")
_ATTR = re.compile(r"([^\s=/\"'<>]++)\s*+(?:=\s*+(\"[^\"]*+\"|'[^']*+'|[^\s\"'>]++))?+")
_LONG_NUMBER = re.compile(r"&#0*+([0-9]++)")
_WORD = re.compile(r"[a-z]+")
_VARYING = re.compile(r"[0-9]+")


class Node:
    """A container: its path's last step, what lies in it, and whether it is left out.

    ``weak`` marks a part that is left out only where it is small: ``kept_parts`` decides.
    ``at`` is the number of steps of a given path that its own path equals, or -1;
    ``inside`` is whether it or a container above it ends that path.
    """

    __slots__ = ("at", "clean", "heading", "inside", "kids", "label", "marks", "out", "parent", "tag", "weak")

    def __init__(self, tag: str, parent: Node | None, label: str, out: bool, weak: bool, steps: list[str]):
        self.tag, self.parent, self.label, self.out, self.weak = tag, parent, label, out, weak
        self.clean, self.heading, self.kids, self.marks = 0, False, [], int(tag in ("article", "main"))
        above = 0 if parent is None else parent.at
        self.at = above + 1 if 0 <= above < len(steps) and steps[above] == label else -1
        self.inside = (parent is not None and parent.inside) or (self.at > 0 and self.at == len(steps))


def path_of(node: Node) -> str:
    """The steps from the root, parted by blanks; steps hold none."""
    steps = []
    while node is not None:
        steps.append(node.label)
        node = node.parent
    return " ".join(reversed(steps))


class _Scanner:
    """Tags of a page in one pass: every character is looked at a bounded number of times."""

    def __init__(self, page: str):
        self.page, self.last, self.ends = page, page.rfind(">"), None

    def tag_end(self, at: int) -> int:
        """Position after the ``>`` that closes a tag; one within quotes counts where no other does; -1 for none."""
        page = self.page
        if at > self.last:
            return -1
        found = _PLAIN.match(page, at)
        if found:
            return found.end()
        if self.ends is None:
            found = _QUOTED.match(page, at)
            if found:
                return found.end()
            self.ends = self._closings(at)
        mark = _MARK.search(page, at).start()
        end = self.ends[mark]
        return end if end >= 0 else page.find(">", at) + 1

    def _closings(self, at: int) -> dict[int, int]:
        """For every quote or ``>`` from ``at`` on, read outside of quotes, where its tag ends."""
        ends: dict[int, int] = {-1: -1}
        later: dict[int, int] = {-1: -1}  # the mark after each mark
        same = {">": -1, '"': -1, "'": -1}  # the next mark of each kind
        after = -1
        for found in reversed(list(_MARK.finditer(self.page, at))):
            where, kind = found.start(), found.group()
            ends[where] = where + 1 if kind == ">" else ends[later[same[kind]]]
            later[where] = after
            same[kind] = after = where
        return ends

    def tags(self) -> Iterator[tuple[int, int, str, bool, str]]:
        """(start, end, name, whether it ends a container, attributes); comments and raw parts have no name."""
        page, at = self.page, 0
        while (found := _OPEN.search(page, at)) is not None:
            start, name = found.start(), found.group(2)
            if page.startswith("<!--", start):
                end = page.find("-->", start + 4) + 3
                end = end if end > 2 else len(page)
                yield start, end, "", False, ""
            else:
                end = self.tag_end(found.end()) if name else page.find(">", found.end()) + 1
                if end <= 0:
                    return
                name = (name or "").lower()
                if name in RAW and not found.group(1):
                    close = re.compile(rf"</{name}(?![^\s/>])", re.IGNORECASE).search(page, end)
                    end = page.find(">", close.end()) + 1 if close else 0
                    end = end or len(page)
                    name = ""
                yield start, end, name, bool(found.group(1)), page[found.end() : end - 1]
            at = end


def _attributes(text: str) -> dict[str, str]:
    return {k.lower(): (v or "").strip("\"'") for k, v in _ATTR.findall(text)}


def _label(tag: str, attrs: dict[str, str]) -> str:
    """Tag with its classes and id, digits made alike, as the path's step."""
    names = sorted(set(_VARYING.sub("0", attrs.get("class", "").lower()).split()))
    own = "".join(_VARYING.sub("0", attrs.get("id", "").lower()).split())
    return tag + "".join(f".{n}" for n in names) + (f"#{own}" if own else "")


def _left_out(tag: str, attrs: dict[str, str]) -> tuple[bool, bool]:
    """Whether a container is left out, and whether it is if it holds a minor part of the page."""
    role = attrs.get("role", "").lower()
    if tag in LEFT_OUT or role in LEFT_OUT_ROLES or "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true":
        return True, False
    if "display:none" in attrs.get("style", "").replace(" ", "").lower():
        return True, False
    known = COMMENTS if tag in ("body", "article", "main") else LEFT_OUT_NAMES
    weak = tag == "form" or role == "form"
    for name in f"{attrs.get('class', '')} {attrs.get('id', '')}".lower().split():
        if name in known:
            return True, False
        words = _WORD.findall(name)
        listed = [w for w in words if w in known]
        if listed and all(w in known or w in STRUCTURAL for w in words):
            if len(listed) == len(words) or any(w in COMMENTS for w in listed):
                return True, False
            weak = True
    return False, weak


def kept_parts(nodes: list[Node]) -> None:
    """Leaves out the weak containers that do not wrap the page, and sums clean text upwards.

    A container wraps the page that holds half of its clean text or more, and every article and heading. Every container comes after its parent in ``nodes``; ``clean`` is its own text before, and all below it afterwards.
    """
    own = [n.clean for n in nodes]
    for node in nodes:
        node.marks = 0 if node.out else node.marks + node.heading
    for node in reversed(nodes[1:]):
        node.parent.clean += node.clean
        node.parent.marks += node.marks
    total, marks = nodes[0].clean, nodes[0].marks
    for node in nodes[1:]:
        node.out = node.out or node.parent.out or (node.weak and (2 * node.clean < total or node.marks < marks))
    for node, clean in zip(nodes, own, strict=True):
        node.clean = 0 if node.out else clean
    for node in reversed(nodes[1:]):
        node.parent.clean += node.clean


def decoded(text: str) -> str:
    """Character references decoded; numbers past the last code point are U+FFFD, however long."""
    if "&" not in text:
        return text
    return html.unescape(_LONG_NUMBER.sub(lambda m: f"&#{m[1]}" if len(m[1]) < 8 else "&#65533", text))


def parse(page: str, path: str | None = None) -> tuple[Node, list[tuple[Node, str, int]]]:
    """Root container and the page's text blocks in order, as (container, text, characters in links).

    Containers nest to any depth: nothing here recurses, and each is visited once.
    """
    steps = path.split(" ") if path else []
    root = node = Node("body", None, "body", False, False, steps)
    nodes, opened = [root], Counter()
    blocks: list[tuple[Node, str, int]] = []
    run: list[str] = []
    at = links = depth = gone = 0
    heading = False

    def close() -> None:
        nonlocal run, links
        if run:
            text = " ".join(decoded("".join(run)).split())
            if text and not gone:
                blocks.append((node, text, links))
                if not node.out:
                    if heading:
                        node.heading = True
                    if links * 2 <= len(text):
                        node.clean += len(text)
        run, links = [], 0

    for start, end, tag, ends, attributes in _Scanner(page).tags():
        if start > at:
            run.append(page[at:start])
            if depth:
                links += start - at
        at = end
        if tag == "br":
            run.append(" ")
        elif tag == "a":
            depth = 0 if ends else 1
        elif tag in BLOCKS:
            close()
            heading = tag in HEADINGS and not ends
        elif tag == "head":
            close()
            gone = 0 if ends else 1
        elif tag == "body":
            close()
            gone = 0
        elif tag in CONTAINERS:
            close()
            depth, gone, heading = 0, 0, False
            if not ends:
                attrs = _attributes(attributes)
                out, weak = _left_out(tag, attrs)
                inner = Node(tag, node, _label(tag, attrs), node.out or out, weak, steps)
                node.kids.append(inner)
                nodes.append(inner)
                opened[tag] += 1
                node = inner
            elif opened[tag]:
                while node.tag != tag:
                    opened[node.tag] -= 1
                    node = node.parent
                opened[tag] -= 1
                node = node.parent
    if at < len(page):
        run.append(page[at:])
    close()
    kept_parts(nodes)
    return root, blocks


def best_container(root: Node) -> Node:
    """The deepest container with most of the clean text; an article, or what has a heading of its own, is not cut up."""
    node = root
    while not (node.tag == "article" or node.heading):
        kid = max((k for k in node.kids if not k.out), key=lambda k: k.clean, default=None)
        if kid is None or not node.clean or kid.clean < SHARE * node.clean:
            break
        node = kid
    return node


def main_text(page: str | None, path: str | None = None) -> str:
    """Text of the containers on ``path``, or of the best container where the page has none there."""
    root, blocks = parse(page or "", path)
    kept = [b for b in blocks if not b[0].out and b[0].inside]
    if not kept:
        todo, below = [best_container(root)], set()
        while todo:
            node = todo.pop()
            below.add(id(node))
            todo += node.kids
        kept = [b for b in blocks if not b[0].out and id(b[0]) in below]
    return "\n".join(text for _, text, _ in kept)


def _votes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(host, path) of every page; a page without clean text has no path."""
    for batch in batches:
        rows = []
        for host, page in zip(batch["host"], batch["html"], strict=True):
            best = best_container(parse(page or "")[0])
            rows.append((host, path_of(best) if best.clean else None))
        yield pd.DataFrame(rows, columns=["host", "path"])


def host_paths(pages: DataFrame) -> DataFrame:
    """(host, path, rows_of_key): each host's path with most votes, ties to the smaller path, null without votes; and its number of pages."""
    votes = pages.select(url_host(F.col("url")).alias("host"), "html").mapInPandas(_votes, "host string, path string")
    counted = votes.groupBy("host", "path").agg(F.count("*").alias("votes"))
    best = F.min(F.when(F.col("path").isNotNull(), F.struct((-F.col("votes")).alias("minus"), "path")))
    return counted.groupBy("host").agg(best["path"].alias("path"), F.sum("votes").alias("rows_of_key"))


def extract_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of ``pages`` (page_id, url, html).

    The whole html is read. A null html gives an empty text; a null url belongs to host ''.
    Blocks have white space runs as one space, are trimmed, and are joined by a line feed.
    Repeated rows are extracted each; other columns are ignored.
    """
    small_batches(pages.sparkSession)
    winners = cut(host_paths(pages))
    total = winners.agg(F.coalesce(F.sum("rows_of_key"), F.lit(0))).first()[0]

    @F.pandas_udf("string")
    def extracted(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for sources, paths in batches:
            yield pd.Series([main_text(s, p) for s, p in zip(sources, paths, strict=True)])

    own = pages.select("page_id", "url", "html", url_host(F.col("url")).alias("host"))
    return join_by_key(own, winners, "host", total).select("page_id", "url", extracted("html", "path").alias("text")).withColumn("n_chars", F.length("text").cast("long"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
