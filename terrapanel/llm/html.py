"""Main-text extraction with consensus host paths.

Each page's containers are scored by the text they hold outside menus, adverts and the like. The page votes for the generalised
tag-class path of its best container; votes are summed per host in Spark, and every page is extracted again with its
host's winning path. What a page's own best container holds beside that path is kept as well, unless it stands in a container
that the pages which voted for the path leave out too (at least BESIDE_PAGES and BESIDE_SHARE of them): so an unmarked
box of the host's template goes, and the text of a page of another template stays.

Text is split into blocks at block-level tags; character references are decoded, white space in a block becomes one
space (a line-break tag counts as white space), blocks are trimmed and joined by a line break. Nothing else is left
out but what the names of tags, classes and roles below say. Null or empty html gives an empty text, a null url the
empty host. Rows are handled alone but for the votes, so repeated pages repeat their result and their vote.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrapanel.session import staged

BATCH_BYTES = 8_000_000
# Element names by role, and words of class, id or role attributes that mark boilerplate.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe noembed noframes title textarea xmp".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table "
    "tbody td tfoot th thead tr ul".split()
)
CONTAINERS = frozenset("article body center div form main section table tbody td tr".split())
LEFT_OUT = frozenset("head nav button select option menu svg math canvas object audio video map footer".split())
WRAPPING = frozenset("aside form dialog".split())  # left out as well, but some sites put a whole page or its text into one
BOILERPLATE = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion nav navbar navigation menu "
    "breadcrumb breadcrumbs sidebar aside footer header masthead topbar toolbar cookie cookies consent gdpr notice "
    "notices notification alert popup modal overlay newsletter subscribe subscription signup login search share "
    "sharing social related recommended comment comments commentlist discussion discussions disqus replies respond pagination "
    "pager widget widgets copyright legal disclaimer skip complementary contentinfo navlinks navlist sharethis addthis".split()
)
# Words that leave a boilerplate name what it is: sidebar-left, site-footer, share-buttons; but not has-sidebar, entry-header.
NEUTRAL = frozenset(
    "area bar bars block blocks bottom box boxes button buttons col column container desktop fixed first global icon icons "
    "inner item items left link links list main mobile outer panel posts primary right row second secondary section site "
    "slot sticky third top unit wrap wrapper zone".split()
)
TITLES = frozenset("header masthead".split())  # no boilerplate inside an article
AMBIGUOUS = frozenset("alert legal".split())  # boilerplate only beside another such word
REPLIES = frozenset("comment comments commentlist discussion discussions disqus replies respond".split())
# Words that make a boilerplate name together with one unknown word: related-articles, google-ads, article-sidebar.
TELLING = REPLIES | frozenset(
    "ad ads advert adverts advertisement adsense sponsor sponsored promo nav navbar navlinks navlist navigation breadcrumb breadcrumbs "
    "sidebar cookie cookies consent newsletter subscribe share sharing sharethis addthis related recommended pagination".split()
)
# Words that say something about the element's surroundings instead: has-sidebar, comments-open.
ABOUT = frozenset("has have no not with without open closed enabled disabled off on allow allows hide show".split())
# An open element on the left ends where an element on the right begins.
ENDS = {
    "p": BLOCKS - {"html", "body"},
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "td": frozenset("td th tr tbody thead tfoot".split()),
    "th": frozenset("td th tr tbody thead tfoot".split()),
    "tr": frozenset("tr tbody thead tfoot".split()),
    "option": frozenset(["option"]),
}
FENCES = frozenset("article aside body div footer header main nav ol section table td th ul".split())
BESIDE_PAGES, BESIDE_SHARE = 2, 0.1  # of the pages with the host's path, for a container beside it to belong to the template

TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/><]*)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)>", re.S
)
NAMED = re.compile(r"(?<![\w-])(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
WORDS = re.compile(r"[a-z]+")


class Page:
    """The elements of a page, and its text blocks outside boilerplate.

    Of element i: `keys[i]` its generalised tag and classes, `parents[i]`, `names[i]`. Blocks are
    [element, text, characters in links].
    """

    def __init__(self, html: str):
        self.names, self.keys, self.parents, self.dropped = ["#"], [""], [-1], [False]
        self.marked: dict[int, str] = {}  # elements that may be boilerplate: "reply" or "name" by their name, "wrap" by their kind
        self.blocks: list[list] = []
        self._settle(self._parse(html))

    def _parse(self, html: str) -> list[list[tuple[int, str, int]]]:
        """The pieces of each block outside the elements left out: (element, text, characters in links)."""
        names, parents, dropped = self.names, self.parents, self.dropped
        stack, at, links = [0], 0, 0
        text: list[tuple[int, str, int]] = []
        blocks = []

        def cut() -> None:
            nonlocal text
            if text:
                blocks.append(text)
                text = []

        size = len(html)
        while at < size:
            found = TOKEN.search(html, at)
            start = found.start() if found else size
            if start > at and not dropped[stack[-1]]:
                piece = html[at:start]
                if "&" in piece:
                    piece = unescape(piece)
                text.append((stack[-1], piece, len(piece) if links else 0))
            if not found:
                break
            at = found.end()
            name = found[2]
            if name is None:
                continue
            name = name.lower()
            if found[1]:
                if name in BLOCKS:
                    cut()
                for depth in range(len(stack) - 1, 0, -1):
                    open_name = names[stack[depth]]
                    if open_name == name:
                        del stack[depth:]
                        if name == "a":
                            links = 0
                        break
                    if open_name in FENCES and name not in FENCES:
                        break
                continue
            if name in BLOCKS:
                cut()
            if name == "br":
                text.append((stack[-1], " ", 0))
            if name in VOID:
                continue
            attributes = found[3]
            if name in RAW:
                if not attributes.endswith("/"):
                    end = re.compile(f"</{name}(?![a-zA-Z0-9])[^>]*>?", re.I).search(html, at)
                    at = end.end() if end else size
                continue
            for depth in range(len(stack) - 1, 0, -1):
                open_name = names[stack[depth]]
                if name in ENDS.get(open_name, ()):
                    del stack[depth:]
                    break
                if open_name in FENCES:
                    break
            parent = stack[-1]
            key, boilerplate, marked = self._named(name, attributes, parent)
            if marked is not None:
                self.marked[len(names)] = marked
            names.append(name)
            self.keys.append(key)
            parents.append(parent)
            dropped.append(dropped[parent] or boilerplate)
            if not attributes.endswith("/"):
                stack.append(len(names) - 1)
                if name == "a":
                    links = 1
                elif name in BLOCKS:
                    links = 0
        cut()
        return blocks

    def _settle(self, blocks: list[list[tuple[int, str, int]]]) -> None:
        """Drop what is inside elements that may be boilerplate, unless one holds the article or, by the text outside links, most of
        the page. Replies are dropped however long they are, if there is any other text; what is no boilerplate by name, only wrapped or hidden, also
        stays out if there is an article elsewhere."""
        dropped, parents = self.dropped, self.parents
        if self.marked:
            totals = [0] * len(parents)
            for block in blocks:
                for element, text, linked in block:
                    totals[element] += len(text.strip()) - 2 * min(linked, len(text.strip()))
            for element in range(len(totals) - 1, 0, -1):
                totals[parents[element]] += totals[element]
            under = [False] * len(parents)  # inside a marked element
            rest, holding = totals[0], set()
            articles = []
            for element in range(1, len(parents)):
                parent = parents[element]
                if element in self.marked and not under[parent]:
                    rest -= max(totals[element], 0)
                under[element] = under[parent] or element in self.marked
                if self.names[element] in ("article", "main") and totals[element] > 0 and not self._inside(parent, ("article", "main")):
                    articles.append(element)
            if len(articles) == 1:
                element = articles[0]
                while element > 0:
                    holding.add(element)
                    element = parents[element]
            for element in range(1, len(parents)):
                drop, kind = False, self.marked.get(element)
                if kind is not None and element not in holding:
                    drop = 2 * totals[element] <= totals[0] or totals[element] <= 0
                    if kind == "reply":
                        drop = drop or rest > 0
                    elif kind == "wrap":
                        drop = drop or bool(articles)
                dropped[element] = dropped[element] or dropped[parents[element]] or drop
        for block in blocks:
            kept = [piece for piece in block if not dropped[piece[0]]]
            joined = " ".join("".join([text for _, text, _ in kept]).split())
            if joined:
                self.blocks.append([kept[0][0], joined, sum(linked for _, _, linked in kept)])

    def _named(self, name: str, attributes: str, parent: int) -> tuple[str, bool, str | None]:
        """The element's generalised name, whether it is left out for sure, and as what it may be boilerplate."""
        classes, marks, boilerplate = "", "", name in LEFT_OUT
        marked = "wrap" if name in WRAPPING else None
        if "=" in attributes or "hidden" in attributes:
            for attribute, value in NAMED.findall(attributes):
                attribute, value = attribute.lower(), unescape(value.strip("\"'"))
                if attribute == "class":
                    classes = ".".join(sorted({re.sub(r"\d+", "#", c) for c in value.lower().split()}))
                if attribute in ("class", "id", "role"):
                    marks += " " + value.lower()
                elif (HIDDEN.search(value) if attribute == "style" else value.lower() != "false") and marked is None:
                    marked = "wrap"
        if name not in ("html", "body", "main", "article") and not boilerplate:
            for mark in marks.split():
                words = set(WORDS.findall(mark))
                found, unknown = words & BOILERPLATE, words - BOILERPLATE - NEUTRAL
                whole = not found <= AMBIGUOUS and not unknown
                if whole or (len(unknown) == 1 and words & TELLING and not words & ABOUT):
                    if not found <= TITLES or not self._inside(parent, ("article", "main")):
                        marked = "reply" if marked == "reply" or words & REPLIES else "name"
            if name == "header" and marked is None:
                boilerplate = not self._inside(parent, ("article", "main"))
        return (f"{name}.{classes}" if classes else name), boilerplate, marked

    def _inside(self, element: int, wanted: tuple[str, ...]) -> bool:
        while element > 0:
            if self.names[element] in wanted:
                return True
            element = self.parents[element]
        return False

    def path(self, element: int) -> str:
        steps = []
        while element > 0:
            steps.append(self.keys[element])
            element = self.parents[element]
        return "/".join(reversed(steps))

    def scores(self) -> list[int]:
        """Of each element, the characters of its text, less twice those in links."""
        totals = [0] * len(self.names)
        for element, text, linked in self.blocks:
            totals[element] += len(text) - 2 * min(linked, len(text))
        for element in range(len(totals) - 1, 0, -1):  # parents come before their children
            totals[self.parents[element]] += totals[element]
        return totals

    def best(self, totals: list[int]) -> int:
        """The page's only outermost article or main element with text, whatever stands beside it; without one, the smallest container that
        holds the whole text: from the root down while one child container has all of it."""
        outer = [
            e
            for e, name in enumerate(self.names)
            if name in ("article", "main") and totals[e] > 0 and not self._inside(self.parents[e], ("article", "main"))
        ]
        if len(outer) == 1:
            return outer[0]
        texts = [0] * len(totals)  # linked or not
        for element, text, _ in self.blocks:
            texts[element] += len(text)
        direct = {element for element, _, _ in self.blocks}
        for element in range(len(texts) - 1, 0, -1):
            texts[self.parents[element]] += texts[element]
        children: dict[int, list[int]] = {}
        for element in range(1, len(texts)):
            if texts[element] > 0:
                children.setdefault(self.parents[element], []).append(element)
        element = 0
        while element not in direct:
            inner = children.get(element, [])
            if len(inner) != 1 or self.names[inner[0]] not in CONTAINERS | {"html"}:
                break
            element = inner[0]
        return element

    def beside(self, element: int) -> set[str]:
        """Paths of the largest elements with blocks that neither hold the element nor are inside it."""
        line = set()
        while element >= 0:
            line.add(element)
            element = self.parents[element]
        paths = set()
        lowest = max(line)
        for home in {element for element, _, _ in self.blocks}:
            under = None
            while home not in line:
                under, home = home, self.parents[home]
            if under is not None and home != lowest:
                paths.add(self.path(under))
        return paths

    def at(self, paths: Iterable[str]) -> set[int]:
        """The elements with one of the paths."""
        wanted = set(paths)
        last = {path.rpartition("/")[2] for path in wanted}
        return {e for e in range(1, len(self.keys)) if self.keys[e] in last and self.path(e) in wanted}

    def text(self, elements: set[int], own: int | None = None, without: set[int] = frozenset()) -> str:
        """The blocks inside the elements, and those inside own but not inside `without`, in page order."""
        size = len(self.names)
        inside, other, out = [False] * size, [False] * size, [False] * size
        for element in range(size):
            parent = self.parents[element]
            inside[element] = element in elements or (element > 0 and inside[parent])
            other[element] = element == own or (element > 0 and other[parent])
            out[element] = element in without or (element > 0 and out[parent])
        return "\n".join(
            text for element, text, _ in self.blocks if inside[element] or (other[element] and not out[element])
        )


def extracted(html: str, host_path: str | None, beside: Iterable[str] = ()) -> str:
    page = Page(html)
    own = page.best(page.scores())
    if host_path:
        named = page.at([host_path])
        if named:
            return page.text(named, own, page.at(beside))
    return page.text({own})


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row of each page's vote, and one without weight for each path beside it."""
    for batch in batches:
        rows = []
        for host, value in zip(batch["host"], batch["html"]):
            page = Page(value.as_py() or "")
            totals = page.scores()
            own = page.best(totals)
            if totals[own] > 0:
                path = page.path(own)
                rows.append((host.as_py(), path, None, totals[own]))
                rows += [(host.as_py(), path, beside, 0) for beside in page.beside(own)]
        columns = list(zip(*rows)) or [()] * 4
        kinds = (pa.string(), pa.string(), pa.string(), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, kind) for c, kind in zip(columns, kinds)], ["host", "path", "beside", "weight"]
        )


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["page_id", "url", "text"]
    for batch in batches:
        start, size, texts = 0, 0, []
        for at, (value, path, beside) in enumerate(zip(batch["html"], batch["path"], batch["beside"]), 1):
            texts.append(extracted(value.as_py() or "", path.as_py(), beside.as_py() or ()))
            size += len(texts[-1])
            if size >= BATCH_BYTES or at == len(batch):
                part = batch.slice(start, at - start)
                yield pa.RecordBatch.from_arrays([part["page_id"], part["url"], pa.array(texts, pa.string())], names)
                start, size, texts = at, 0, []


def host_of(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def host_paths(pages: DataFrame) -> DataFrame:
    """(host, path, beside): the path with most votes, then most text, then the first by name, and the paths beside it on
    many of its pages, of which there are at most 1 / BESIDE_SHARE times those of a page. From rows of (host, html)."""
    counts = (
        pages.select("host", "html")
        .mapInArrow(_votes, "host string, path string, beside string, weight long")
        .groupBy("host", "path", "beside")
        .agg(F.count("*").alias("n"), F.sum("weight").alias("weight"))
    )
    votes = staged(counts, "host_votes")
    rank = F.struct((-F.col("n")).alias("n"), (-F.col("weight")).alias("weight"), F.col("path"))
    best = votes.where("beside IS NULL").groupBy("host").agg(F.min(rank).alias("best"))
    best = best.select("host", F.col("best.path").alias("path"), (-F.col("best.n")).alias("pages"))
    often = (F.col("n") >= BESIDE_PAGES) & (F.col("n") >= BESIDE_SHARE * F.col("pages"))
    found = votes.where("beside IS NOT NULL").join(best, ["host", "path"]).where(often)
    lists = found.groupBy("host").agg(F.collect_list("beside").alias("beside"))
    return best.join(lists, "host", "left").select("host", "path", "beside")


def main_texts(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """(page_id, url, text) of every page. Other columns are not carried. Writes the winning paths to the shared folder, so
    that the join's form follows their size."""
    plain = pages.select(
        F.col(id_col).alias("page_id"),
        F.col(url_col).cast("string").alias("url"),
        F.col(html_col).cast("string").alias("html"),
        host_of(F.col(url_col).cast("string")).alias("host"),
    )
    paths = staged(host_paths(plain), "host_paths")
    kind = plain.schema["page_id"].dataType.simpleString()
    return (
        plain.join(paths, "host", "left")
        .select("page_id", "url", "html", "path", "beside")
        .mapInArrow(_texts, f"page_id {kind}, url string, text string")
    )


def digest(found: DataFrame) -> DataFrame:
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
