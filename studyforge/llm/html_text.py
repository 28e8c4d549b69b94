"""Main text of web pages by consensus host paths.

Every page's containers are scored by the text of the blocks in them, links weighing
against; a container is known by its path of tags and classes, with digits generalised.
From the best one the path climbs as long as the parent adds text that is not mostly links,
and up to the outermost article, so that titles, introductions, lists and tables beside the
longest part stay with it. Pages vote for the paths they reach, Spark counts the votes by
host, and every page is extracted again: what lies in any of its host's winning paths (where that is not mostly links), or in its own,
so that an article in several containers stays whole. What lies in a
menu, header, footer, sidebar, notice, advert, form, script, style or comment section is
left out wherever it stands and whatever its size. Such parts are told by their element or by the words of their class, id or role, in
compounds too (comment-list, site-footer, adSlot); a named element that holds the title, main or an article is a wrapper and
stays (one of comments only with a title or main), and a form also if most of the page's paragraphs are in it.

A block's text is what lies between the borders of block elements, with character
references decoded and white space turned into one space; br counts as white space. Defined
results: null or empty html gives empty text; a null url is a host of its own; repeated
rows vote and are extracted each; an empty table gives no rows; html of any nesting takes time in proportion to its length.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from html import unescape

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import arrow_map, cut, only, slices

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^>"'])*)>""", re.S)
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
#: HTML's void, raw-text, block and container elements, and those that end an open p or their like.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript template iframe svg xmp".split())
CONTAINERS = frozenset("html body main article section div td th tr table tbody center blockquote dd li ul ol dl figure form nav aside header footer details fieldset".split())
BLOCKS = CONTAINERS | frozenset("p h1 h2 h3 h4 h5 h6 pre hr address dt caption figcaption summary head thead tfoot legend option".split())
ENDS_P = BLOCKS - {"td", "th", "tr", "tbody", "head", "option"}
ALIKE = {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr", "td": "td th", "th": "td th", "option": "option"}
NAMES = ("class", "id", "role")
#: Elements whose contents are not the article.
LEFT_OUT_TAGS = frozenset("head nav footer aside button select dialog menu".split()) | RAW
#: Words of class, id or role. An element is furniture if a word of the first list stands anywhere in a
#: name, one of the second at its beginning or end, one of the third at its end; names that begin with a word of the fourth tell a state.
ANYWHERE = frozenset(
    "comment comments commentlist commenter disqus sidebar sidebars footer masthead cookie cookies consent gdpr newsletter advert adverts advertisement advertising adsense "
    "sponsor sponsored promo promotion breadcrumb breadcrumbs pagination popup modal overlay navbar subscribe subscription signup login recommended recommendations outbrain taboola contentinfo complementary".split()
)
AT_AN_END = frozenset("ad ads adv banner menu menus nav navigation notice notices share sharing social reply replies respond widget widgets toc pager toolbar".split())
AT_THE_END = frozenset("related search".split())
RELATED = frozenset("posts post articles article content contents links link stories story items news topics reading pages videos products".split())
STATES = frozenset("has with no without is not".split())
CLOSED = frozenset("open opened closed enabled disabled on off".split())
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
WINNERS = 5


def furniture(name: str) -> str:
    """What a name (one class, id or role) makes of its element: "comment", "other" furniture, or nothing."""
    words = [w.lower() for w in WORD.findall(name)]
    if not words or words[0] in STATES or words[-1] in CLOSED:
        return ""
    if any(w.startswith("comment") for w in words):
        return "comment"
    if not ANYWHERE.isdisjoint(words) or words[0] in AT_AN_END or words[-1] in AT_AN_END | AT_THE_END:
        return "other"
    if words[0] == "related" and words[1] in RELATED or words[-1].endswith(("footer", "sidebar", "navbar")):
        return "other"
    return "other" if len(words) > 1 and words[-1] == "header" and words[0] in ("site", "page", "global", "top", "main") else ""


class Page:
    """Blocks of a page, each with the path of its innermost container; one pass, linear in the html whatever its nesting."""

    def __init__(self, html: str):
        #: Paths as (parent, label of tag and classes); a path's parent has a smaller number.
        self.paths: list[tuple[int, str]] = [(-1, "")]
        self.known: dict[tuple[int, str], int] = {}
        #: Forms and elements with furniture names: (parent, kind), whether a title or main, or an article, is in them, their text in paragraphs.
        self.marks: list[tuple[int, str]] = [(-1, "")]
        self.titled, self.storied, self.prose = [False], [False], [0]
        #: Open elements: (tag, path, mark, left out).
        self.stack: list[tuple[str, int, int, bool]] = [("", 0, 0, False)]
        self.open: dict[str, int] = defaultdict(int)
        self.found: list[tuple[int, int, str, int]] = []
        self.text: list[str] = []
        self.linked, self.in_link = 0, False
        self._read(html)
        gone = self._dropped()
        self.blocks = [(path, text, linked) for path, mark, text, linked in self.found if not gone[mark]]

    def _flush(self) -> None:
        if self.text:
            text = " ".join(unescape("".join(self.text)).split())
            _, path, mark, out = self.stack[-1]
            if text and not out:
                self.found.append((path, mark, text, 0 if self.open["h1"] else min(self.linked, len(text))))
                if self.open["p"]:
                    self.prose[mark] += len(text)
            self.text = []
        self.linked = 0

    def _open(self, tag: str, attributes: str) -> None:
        names = {k.lower(): (a or b or c) for k, a, b, c in ATTRIBUTE.findall(attributes) if k.lower() in NAMES} if attributes else {}
        _, path, mark, out = self.stack[-1]
        out = out or tag in LEFT_OUT_TAGS or (tag == "header" and not self.open["article"] and not self.open["main"])
        kind = "form" if tag == "form" else ""
        if names and tag not in ("html", "body", "main"):
            kinds = {furniture(n) for value in names.values() for n in value.split()}
            # an article is left out as a comment only
            kind = "comment" if "comment" in kinds else kind or ("other" if "other" in kinds and tag != "article" else "")
        if kind:
            self.marks.append((mark, kind))
            mark = len(self.marks) - 1
            for flags in (self.titled, self.storied):
                flags.append(False)
            self.prose.append(0)
        if tag in ("h1", "main"):
            self._tell(self.titled, mark)
        elif tag == "article" and kind != "comment":
            self._tell(self.storied, mark)
        if tag in CONTAINERS:
            label = ".".join([tag, *sorted(re.sub(r"\d+", "#", names.get("class", "").lower()).split())])
            key = (path, label)
            if key not in self.known:
                self.known[key] = len(self.paths)
                self.paths.append(key)
            path = self.known[key]
        self.stack.append((tag, path, mark, out))
        self.open[tag] += 1

    def _tell(self, flags: list[bool], mark: int) -> None:
        """Flag a mark and those around it; each is flagged once."""
        while mark > 0 and not flags[mark]:
            flags[mark] = True
            mark = self.marks[mark][0]

    def _dropped(self) -> list[bool]:
        """Whether each mark is left out: those of furniture, unless they hold the title, main or (but for comments) an article; forms also stay if most paragraphs are in them."""
        prose = list(self.prose)
        for k in range(len(prose) - 1, 0, -1):
            prose[self.marks[k][0]] += prose[k]
        gone = [False] * len(self.marks)
        for k in range(1, len(gone)):
            around, kind = self.marks[k]
            stays = self.titled[k] or (self.storied[k] and kind != "comment") or (kind == "form" and 2 * prose[k] > prose[0] > 0)
            gone[k] = gone[around] or not stays
        return gone

    def _pop(self, k: int) -> None:
        for tag, *_ in self.stack[k:]:
            self.open[tag] -= 1
        del self.stack[k:]

    def _close(self, tag: str) -> None:
        if not self.open[tag]:
            return
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k][0] == tag:
                self._pop(k)
                return
            if tag not in CONTAINERS and self.stack[k][0] in CONTAINERS:
                return

    def _read(self, html: str) -> None:
        at = 0
        while True:
            m = TOKEN.search(html, at)
            if m is None:
                self._take(html[at:])
                break
            if m.start() > at:
                self._take(html[at : m.start()])
            at = m.end()
            if m[2] is None:
                continue
            tag = m[2].lower()
            if tag == "a":
                self.in_link = not m[1]
            if m[1]:
                if tag in BLOCKS:
                    self._flush()
                self._close(tag)
                continue
            if tag == "svg" and m[3].endswith("/"):
                continue
            if tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(html, at)
                at = end.end() if end else len(html)
                continue
            if tag == "br":
                self.text.append(" ")
            if tag in BLOCKS:
                self._flush()
                if tag in ENDS_P:
                    self._close("p")
                for other in ALIKE.get(tag, "").split():
                    self._close_alike(other)
            if tag not in VOID:
                self._open(tag, m[3])
        self._flush()

    def _close_alike(self, tag: str) -> None:
        """End an open element of this kind unless a list or table has been opened in it."""
        if not self.open[tag]:
            return
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k][0] == tag:
                self._pop(k)
                return
            if self.stack[k][0] in ("ul", "ol", "dl", "table"):
                return

    def _take(self, text: str) -> None:
        self.text.append(text)
        if self.in_link:
            self.linked += len(text)

    def _sums(self) -> tuple[list[float], list[int], list[int]]:
        """Of each path: score (a block counts for its container, half for the next one out, and so on), text inside, and that less twice what is in links."""
        score, size, net = [0.0] * len(self.paths), [0] * len(self.paths), [0] * len(self.paths)
        for path, text, linked in self.blocks:
            score[path] += max(0.0, len(text) - 2.0 * linked) + 1.0
            size[path] += len(text)
            net[path] += len(text) - 2 * linked
        for p in range(len(self.paths) - 1, 0, -1):
            up = self.paths[p][0]
            score[up] += 0.5 * score[p]
            size[up] += size[p]
            net[up] += net[p]
        return score, size, net

    def best(self) -> int | None:
        """From the path of the highest score (the outer and earlier one of equal ones) outwards, while the parent adds text that is not mostly links, and to the outermost article."""
        if not self.blocks:
            return None
        score, size, net = self._sums()
        at = max(range(len(score)), key=lambda p: (score[p], -p))
        chain = []
        while at >= 0:
            chain.append(at)
            at = self.paths[at][0]
        outermost = next((k for k in range(len(chain) - 1, -1, -1) if self.paths[chain[k]][1].split(".")[0] == "article"), -1)
        at = 0
        for k in range(1, len(chain)):
            if size[chain[k]] != size[chain[at]]:
                if k > outermost and net[chain[k]] <= net[chain[at]]:
                    break
                at = k
        return chain[max(at, 0)]

    def name(self, path: int) -> str:
        labels = []
        while path > 0:
            path, label = self.paths[path]
            labels.append(label)
        return ">".join(reversed(labels))

    def place(self, name: str) -> int | None:
        """The path of a name, if the page has it."""
        path: int | None = 0
        for label in filter(None, name.split(">")):
            path = self.known.get((path, label)) if path is not None else None
        return path

    def extract(self, winners: list[str]) -> str:
        """Blocks inside the page's own best path or any winning one whose text here is not mostly links, in page order."""
        inside = [False] * len(self.paths)
        own, net = self.best(), self._sums()[2]
        for path in [own, *map(self.place, winners)]:
            if path is not None and (path == own or net[path] > 0):
                inside[path] = True
        for p in range(1, len(inside)):
            inside[p] = inside[p] or inside[self.paths[p][0]]
        return "\n".join(text for path, text, _ in self.blocks if inside[path])


def _host(url):
    # without scheme and user, up to port, path, query or fragment
    return F.lower(F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def host_paths(pages: DataFrame) -> DataFrame:
    """host and its winning paths, most votes first: those that a tenth of its pages find best, WINNERS at most."""

    def run(batches) -> Iterator[dict]:
        for whole in batches:
            for b in slices(whole, "html"):
                pages_ = [Page(h) if h else None for h in b.column(1).to_pylist()]
                best = [None if p is None or (at := p.best()) is None else p.name(at) for p in pages_]
                yield {"host": b.column(0), "path": best}

    votes = arrow_map(pages.select(_host(F.col("url")).alias("host"), F.col("html").cast("string").alias("html")), run, "host string, path string")
    count = votes.where(F.col("path").isNotNull()).groupBy("host", "path").agg(F.count(F.lit(1)).alias("votes"))
    order = W.partitionBy("host").orderBy(F.col("votes").desc(), "path")
    ranked = count.withColumn("rank", F.row_number().over(order)).withColumn("all", F.sum("votes").over(W.partitionBy("host")))
    return ranked.where((F.col("rank") <= WINNERS) & (10 * F.col("votes") >= F.col("all"))).groupBy("host").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "path"))), lambda x: x["path"]).alias("winners"))


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, host for every row of pages."""
    keyed = pages.select(F.col("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), _host(F.col("url")).alias("host"))
    # a table of a row for each host, which is broadcast while it is small, so that the html stays where it is
    joined = only(keyed, cut(host_paths(pages), "host-paths"), ["host"], "left", 50_000).select("page_id", "url", "host", "html", "winners")
    kind = pages.schema["page_id"].dataType.simpleString()

    def run(batches) -> Iterator[dict]:
        for whole in batches:
            for b in slices(whole, "html"):
                texts = [Page(h).extract(w or []) if h else "" for h, w in zip(b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True)]
                yield {"page_id": b.column(0), "url": b.column(1), "text": texts, "n_chars": [len(t) for t in texts], "host": b.column(2)}

    return arrow_map(joined, run, f"page_id {kind}, url string, text string, n_chars long, host string")
