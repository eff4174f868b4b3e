"""Main text of web pages, with removal of site templates.

Each page is parsed into elements. Outside the main content (``article``, else ``main``, else nothing), a
hash of every element's subtree is counted over the pages of its host, and subtrees on at least
``min_pages`` pages and one in ``share_of`` of the host's pages are templates, which are deleted. What
names itself as something else than text is dropped as well: menus, headers, footers, sidebars, notices,
adverts, forms, scripts, styles and comments, by element name, role, class or id. The main content itself is
never taken for a template, since pages may carry the same article.

A class, an id or a form drops no element that holds main content or is it, and none with more than half
of the text: of the main content's text, or of the page's where it has no main content. A head ends where
the body's content begins, with or without its end tag.

Text: character references are decoded, white space inside a block becomes one space, blocks are joined in
page order by one space. Nothing is cut short.

Size: subtree hashes are combined per task before their only shuffle. A host's list of templates is bounded
by ``share_of`` times the subtrees of a page, and meets the pages in a join that adaptive execution makes a
broadcast where it is small and splits where a host is hot.

Defined cases: null html is an empty page; a null url, or one without a host, belongs to the empty host;
equal rows give equal rows and count as pages each; broken markup never fails; other columns are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

import html as references
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promptscore.llm.words import written

MIN_PAGES = 5
SHARE_OF = 4
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[!?/][^>]*+>", re.S
)
_ATTRIBUTE = re.compile(r"([^\s=/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s]+)))?")
_RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp"}
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = set(
    "a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong "
    "sub sup time tt u var wbr".split()
)
_DROPPED = set(
    "aside audio button canvas datalist dialog footer head iframe math menu nav noscript object script select "
    "style svg template textarea title video".split()
)
_ROLES = set("alert alertdialog banner complementary contentinfo dialog menu menubar navigation search".split())
_OF_HEAD = set("base link meta noscript script style template title".split())
_NAMES = set(
    "ad ads adv advert advertisement advertising adverts banner breadcrumb breadcrumbs comment comments consent cookie "
    "cookies disqus footer masthead menu modal nav navbar navigation newsletter notice pager pagination popup promo "
    "promoted promotion related share sharing sidebar social sponsor sponsored subscribe toolbar widget".split()
)
#: opening one of these closes an open one of its values, up to the container
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
_SECTIONS = {"article", "main", "section", "div", "body", "table", "td", "th", "li", "blockquote", "aside", "nav"}


class Page:
    """The elements of a page in opening order, and its text and breaks in page order."""

    def __init__(self, html: str | None):
        self.tag, self.parent, self.mark, self.aside = ["#root"], [-1], [""], [False]
        #: by class, id or form only, which does not hold where the content is
        self.perhaps = [False]
        #: (element, text) in page order; None for a break between blocks
        self.content: list[tuple[int, str | None]] = []
        self._parse(html or "")

    def _parse(self, html: str) -> None:
        stack, at, end = [0], 0, len(html)
        while at < end:
            m = _TOKEN.search(html, at)
            if m is None:
                self._text(stack, html[at:])
                break
            if m.start() > at:
                self._text(stack, html[at : m.start()])
            at = m.end()
            name = m[2]
            if name is None:
                continue
            name = name.lower()
            if m[1]:
                self._close(stack, name)
                continue
            self._imply(stack, name)
            node = self._open(stack[-1], name, m[3])
            if name in _VOID:
                continue
            if name in _RAW:
                stop = re.compile(f"</{name}[\\s/>]", re.I).search(html, at)
                stop_at = stop.start() if stop else end
                at = html.find(">", stop_at) + 1 if stop and html.find(">", stop_at) >= 0 else end
                continue
            if not m[3].endswith("/") or name in ("a", "p", "div", "span", "article"):
                stack.append(node)

    def _text(self, stack: list[int], text: str) -> None:
        if self.tag[stack[-1]] == "head" and not text.isspace():
            stack.pop()
        self.content.append((stack[-1], text))

    def _open(self, parent: int, name: str, attributes: str) -> int:
        node = len(self.tag)
        mark, aside, perhaps = "", name in _DROPPED, name == "form"
        if attributes and not attributes.isspace():
            found = {k.lower(): a or b or c for k, a, b, c in _ATTRIBUTE.findall(attributes)}
            mark = f"{found.get('class', '')} {found.get('id', '')}".lower()
            role = found.get("role", "").lower()
            aside = aside or "hidden" in found or role in _ROLES
            named = not _NAMES.isdisjoint(re.split(r"[^a-z0-9]+", mark))
            perhaps = perhaps or role == "form" or (name not in ("html", "body") and named)
            if role == "main":
                name = "main"
        self.tag.append(name)
        self.parent.append(parent)
        self.mark.append(mark)
        self.aside.append(aside)
        self.perhaps.append(perhaps)
        if name not in _INLINE:
            self.content.append((node, None))
        return node

    def _close(self, stack: list[int], name: str) -> None:
        if name not in _INLINE:
            self.content.append((stack[-1], None))
        for depth in range(len(stack) - 1, 0, -1):
            open_ = self.tag[stack[depth]]
            if open_ == name:
                del stack[depth:]
                return
            if name in _INLINE and open_ not in _INLINE:
                return

    def _imply(self, stack: list[int], name: str) -> None:
        if self.tag[stack[-1]] == "head" and name not in _OF_HEAD:
            stack.pop()
        elif name == "body":
            heads = [depth for depth in range(1, len(stack)) if self.tag[stack[depth]] == "head"]
            if heads:
                del stack[heads[0] :]
        closed, until = _CLOSES.get(name, (set(), set()))
        if name not in _INLINE and name not in _VOID:
            closed, until = closed | {"p"}, until | (set() if closed else _SECTIONS)
        for depth in range(len(stack) - 1, 0, -1):
            open_ = self.tag[stack[depth]]
            if open_ in until:
                return
            if open_ in closed:
                del stack[depth:]
                return

    def regions(self) -> tuple[list[bool], list[bool]]:
        """For each element: whether it is in the main content, and whether it is dropped by its name."""
        dropped, in_article, in_main = [False], [False], [False]
        content = self._content()
        for node in range(1, len(self.tag)):
            up, name = self.parent[node], self.tag[node]
            gone = dropped[up] or self.aside[node] or (self.perhaps[node] and not content[node])
            gone = gone or (name == "header" and not (in_article[up] or in_main[up]))
            dropped.append(gone)
            in_article.append(in_article[up] or (name == "article" and not gone))
            in_main.append(in_main[up] or (name == "main" and not gone))
        return (in_article if any(in_article) else in_main), dropped

    def _content(self) -> list[bool]:
        """For each element whether it is main content or around it, or has more than half of the text."""
        if not any(self.perhaps):
            return self.perhaps
        gone, inside = [False], [False]
        for node in range(1, len(self.tag)):
            up, name = self.parent[node], self.tag[node]
            gone.append(gone[up] or self.aside[node] or (name == "header" and not inside[up]))
            inside.append(inside[up] or (name in ("article", "main") and not gone[node]))
        any_main, size, holds = any(inside), [0] * len(self.tag), [False] * len(self.tag)
        for node, text in self.content:
            if text is not None and not gone[node] and (inside[node] or not any_main):
                size[node] += sum(map(len, text.split()))
        for node in range(len(self.tag) - 1, 0, -1):
            up = self.parent[node]
            size[up] += size[node]
            holds[node] = holds[node] or (inside[node] and not inside[up])
            holds[up] = holds[up] or holds[node]
        return [holds[node] or 2 * size[node] > size[0] for node in range(len(self.tag))]

    def subtrees(self) -> list[int]:
        """A hash of each element with all below it: names, classes, ids and text."""
        inside: list[list] = [[] for _ in self.tag]
        for node in range(1, len(self.tag)):
            inside[self.parent[node]].append(node)
        own: list[list[str]] = [[] for _ in self.tag]
        for node, text in self.content:
            if text is not None:
                own[node].extend(text.split())
        hashes = [0] * len(self.tag)
        for node in range(len(self.tag) - 1, -1, -1):
            below = ",".join([str(hashes[child]) for child in inside[node]])
            said = f"{self.tag[node]}\x00{self.mark[node]}\x00{' '.join(own[node])}\x00{below}"
            hashes[node] = xxhash.xxh64_intdigest(said.encode("utf-8", "surrogatepass")) - (1 << 63)
        return hashes

    def candidates(self) -> set[int]:
        """Hashes of the subtrees that may be templates: outside the main content and not around it."""
        main, _ = self.regions()
        around = set()
        for node in range(1, len(self.tag)):
            if main[node]:
                up = node
                while up > 0 and up not in around:
                    around.add(up)
                    up = self.parent[up]
        return {
            h
            for node, h in enumerate(self.subtrees())
            if node and node not in around and self.tag[node] not in ("html", "body", "head")
        }

    def main_text(self, templates: set[int]) -> str:
        main, dropped = self.regions()
        if templates:
            hashes, gone = self.subtrees(), [False] * len(self.tag)
            for node in range(1, len(self.tag)):
                gone[node] = gone[self.parent[node]] or (not main[node] and hashes[node] in templates)
            dropped = [a or b for a, b in zip(dropped, gone)]
        wanted = main if any(main) else [True] * len(self.tag)
        pieces = []
        for node, text in self.content:
            if text is None:
                pieces.append(" ")
            elif wanted[node] and not dropped[node]:
                pieces.append(references.unescape(text) if "&" in text else text)
        return " ".join("".join(pieces).split())


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1))


def templates(pages: DataFrame, url: str, html: str, min_pages: int, share_of: int) -> DataFrame:
    """(host, templates): the subtree hashes that recur on each host."""
    own = pages.select(host_of(F.col(url)).alias("_host"), F.col(html).alias("_html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(Page(x.as_py()).candidates()) for x in batch.column(1)]
            at = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]))
            hashes = pa.array([h for f in found for h in f], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), hashes], names=["_host", "tree"])

    trees = own.mapInArrow(run, "_host string, tree long").groupBy("_host", "tree").agg(F.count(F.lit(1)).alias("n"))
    sizes = own.groupBy("_host").agg(F.count(F.lit(1)).alias("pages"))
    return (
        trees.where(F.col("n") >= min_pages)
        .join(sizes, "_host")
        .where(F.col("n") * share_of >= F.col("pages"))
        .groupBy("_host")
        .agg(F.collect_set("tree").alias("_templates"))
    )


def extract(
    spark: SparkSession,
    pages: DataFrame,
    root: str,
    id_col: str = "page_id",
    url: str = "url",
    html: str = "html",
    min_pages: int = MIN_PAGES,
    share_of: int = SHARE_OF,
) -> DataFrame:
    """(id, url, text) for every page. The templates are written under ``root`` first, so that Spark knows
    their size when it plans the join and sends a small table to the pages instead of shuffling these."""
    own = pages.select(
        F.col(id_col), F.col(url), F.col(html).alias("_html"), host_of(F.col(url)).alias("_host")
    )
    known = written(spark, templates(pages, url, html, min_pages, share_of), f"{root}/templates")
    met = own.join(known, "_host", "left").select(id_col, url, "_html", "_templates")
    schema = T.StructType([met.schema[0], met.schema[1], T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [
                Page(x.as_py()).main_text(set(t.as_py() or ())) for x, t in zip(batch.column(2), batch.column(3))
            ]
            columns = [batch.column(0), batch.column(1), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return met.mapInArrow(run, schema)
